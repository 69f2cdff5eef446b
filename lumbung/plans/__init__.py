"""Plans over the operators: mart builders, dashboards, the job runner and the query catalogue."""
