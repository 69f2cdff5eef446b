"""lumbung: a PySpark-native analytics engine for stock and inventory marts.

Layers, from the inside out:

* ``functions``  column expressions that recur in the mart,
* ``sources``    table readers and JDBC connectors,
* ``operators``  data-processing operators on DataFrames (merge, write methods,
  intervals, skew-safe aggregation, reference checks, profiles, histories, diffs),
* ``plans``      mart builders, dashboard queries and the job runner,
* ``streaming``  micro-batch use of the write methods,
* ``llm``        operators on text; nothing else imports it.
"""

__version__ = "0.1.0"
