"""Database connectors: URLs, dialects, reading and key or count scans over JDBC."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from lumbung.session import Scratch, hadoop_path, is_local, work_folder

#: Rows that the driver holds at a time where it reads or writes a database of its own process.
CHUNK = 10_000


@dataclass(frozen=True)
class Dialect:
    """What differs between databases.

    ``url`` builds a JDBC URL; ``scheme`` recognises one; ``sql_url`` is the scheme and suffix of a
    URL for executor-side Python drivers; ``truncate`` is the statement that empties a table and
    ``ping`` one that any session may run. ``missing`` are the SQL states and error codes by which it
    tells that a table isn't there; ``create`` goes behind the columns of a new table; ``embedded``
    matches the URLs of databases that run inside the process that opens them; ``nested_loops`` is set
    where tables beyond a megabyte are joined row by row unless there is an index.
    """

    name: str
    scheme: str
    url: Callable[[str, str, str], str]
    driver: str
    sql_url: tuple[str, str] | None = None
    quote: str = '"'
    truncate: str = "TRUNCATE TABLE {table}"
    ping: str = "SELECT 1"
    missing: tuple[str | int, ...] = ()
    transactions: bool = True
    create: str = ""
    embedded: str = ""
    nested_loops: bool = False

    def is_missing(self, state: str | None, code: int, message: str) -> bool:
        return state in self.missing or code in self.missing or (self.name == "sqlite" and "no such table" in message)


# URL forms, driver classes and URL options that connections need.
DIALECTS: dict[str, Dialect] = {
    d.name: d
    for d in (
        Dialect("postgres", "postgresql", lambda h, p, d: f"jdbc:postgresql://{h}:{p}/{d}", "org.postgresql.Driver", ("postgresql+psycopg2", ""), truncate="TRUNCATE TABLE {table} CASCADE", missing=("42P01",)),
        Dialect("mssql", "sqlserver", lambda h, p, d: f"jdbc:sqlserver://{h}:{p};databaseName={d};encrypt=true;trustServerCertificate=true;", "com.microsoft.sqlserver.jdbc.SQLServerDriver", ("mssql+pyodbc", "?driver=ODBC+Driver+17+for+SQL+Server&TrustServerCertificate=yes"), missing=("S0002", 208)),
        Dialect("mysql", "mysql", lambda h, p, d: f"jdbc:mysql://{h}:{p}/{d}", "com.mysql.cj.jdbc.Driver", ("mysql+pymysql", ""), quote="`", missing=("42S02", 1146)),
        Dialect("mariadb", "mariadb", lambda h, p, d: f"jdbc:mariadb://{h}:{p}/{d}", "org.mariadb.jdbc.Driver", ("mariadb+pymysql", ""), quote="`", missing=("42S02", 1146)),
        Dialect("oracle", "oracle", lambda h, p, d: f"jdbc:oracle:thin:@{h}:{p}/{d}", "oracle.jdbc.OracleDriver", ("oracle+cx_oracle", ""), truncate="TRUNCATE TABLE {table} CASCADE", ping="SELECT 1 FROM DUAL", missing=(942,)),
        Dialect("clickhouse", "clickhouse", lambda h, p, d: f"jdbc:clickhouse://{h}:{p}/{d}", "com.clickhouse.jdbc.ClickHouseDriver", quote="`", truncate="TRUNCATE TABLE {table}", missing=(60,), transactions=False, create="ENGINE = MergeTree ORDER BY tuple()"),
        Dialect("derby", "derby", lambda h, p, d: f"jdbc:derby:memory:{d};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver", ping="VALUES 1", missing=("42X05", "42Y07"), embedded="jdbc:derby:(?!//)", nested_loops=True),
        Dialect("sqlite", "sqlite", lambda h, p, d: f"jdbc:sqlite:{d}", "org.sqlite.JDBC", truncate="DELETE FROM {table}"),
    )
}
#: Options that the batch job adds to a MySQL source.
MYSQL_JOB_OPTIONS = "useSSL=false&allowPublicKeyRetrieval=true&serverTimezone=UTC"


def dialect(name: str) -> Dialect:
    """The dialect of that name in any letter case; ValueError for an unknown one."""
    try:
        return DIALECTS[name.lower()]
    except KeyError:
        raise ValueError(f"unsupported database type: {name}") from None


def jdbc_url(db_type: str, host: str, port: int | str, database: str) -> str:
    return dialect(db_type).url(host, str(port), database)


def job_url(db_type: str, host: str, port: int | str, database: str) -> str:
    """URL of the batch job, which takes a MySQL source and a ClickHouse target and nothing else."""
    if db_type not in ("mysql", "clickhouse"):
        raise ValueError(f"unsupported database type: {db_type}")
    return jdbc_url(db_type, host, port, database) + (f"?{MYSQL_JOB_OPTIONS}" if db_type == "mysql" else "")


def dialect_of_url(url: str) -> Dialect:
    """The dialect that a JDBC URL names; ValueError if none does."""
    m = re.match(r"jdbc:(\w+):", url)
    for d in DIALECTS.values():
        if m and m[1].lower() == d.scheme:
            return d
    raise ValueError(f"no database type in the URL: {url.split('?')[0]}")


def parse_url(url: str) -> tuple[str, str, str]:
    """(host, port, database) of a JDBC URL of the five transactional databases."""
    m = re.match(r"jdbc:\w+:(?:thin:@)?(?://)?([^:/;?]+):(\d+)(?:/([^?;]+)|;.*?databaseName=([^;]+))", url)
    if not m:
        raise ValueError(f"host, port and database not found in the URL: {url.split('?')[0]}")
    return m[1], m[2], m[3] or m[4]


def sql_url(db_type: str, host: str, port: int | str, database: str, user: str, password: str) -> str:
    """URL for executor-side Python drivers; user and password are escaped."""
    d = dialect(db_type)
    if d.sql_url is None:
        raise ValueError(f"no Python driver URL for: {db_type}")
    scheme, suffix = d.sql_url
    return f"{scheme}://{quote(user, safe='')}:{quote(password, safe='')}@{host}:{port}/{database}{suffix}"


@dataclass(frozen=True)
class Target:
    """A database table with its connection; the password never shows in ``repr``."""

    url: str
    table: str
    user: str = ""
    password: str = field(default="", repr=False)
    driver: str | None = None

    @property
    def dialect(self) -> Dialect:
        return dialect_of_url(self.url)

    def options(self) -> dict[str, str]:
        out = {"url": self.url, "driver": self.driver or self.dialect.driver}
        if self.user:
            out |= {"user": self.user, "password": self.password}
        return out


def in_driver(spark: SparkSession, target: Target) -> bool:
    """Whether the driver alone can reach the target: its database runs inside a process, and tasks run in other ones."""
    d = target.dialect
    return bool(d.embedded and re.match(d.embedded, target.url)) and not is_local(spark)


def open_connection(spark: SparkSession, target: Target):
    """A connection of the driver, through the same JDBC driver that Spark uses."""
    jvm = spark._jvm
    jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(target.options()["driver"])
    manager = jvm.java.sql.DriverManager
    return manager.getConnection(target.url, target.user, target.password) if target.user else manager.getConnection(target.url)


def close_database(spark: SparkSession, target: Target) -> None:
    """Shut down a Derby database of the driver's process, which holds its pages until then; the next connection opens it again."""
    try:
        open_connection(spark, replace(target, url=f"{target.url.partition(';')[0]};shutdown=true"))
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # by which it says that it is done
            raise


@dataclass(frozen=True)
class Split:
    """How a scan is cut into parallel reads: equal ranges of a numeric, date or timestamp column."""

    column: str
    lower: object
    upper: object
    partitions: int


def split_of(spark: SparkSession, target: Target, column: str, partitions: int) -> Split | None:
    """Equal ranges of a column of the target, between its least and greatest value; None for an empty table or a column of nulls."""
    c = quoted(target, [column])
    low, high = read_query(spark, target, f"SELECT MIN({c}) AS low, MAX({c}) AS high FROM {target.table}").first()
    return None if low is None or partitions < 2 else Split(column, low, high, partitions)


def read_query(spark: SparkSession, target: Target, sql: str, split: Split | None = None, fetch_size: int = 10_000) -> DataFrame:
    """The result of ``sql``, evaluated in the database, as a lazy scan.

    Without ``split`` one task reads everything; with it, ``partitions`` tasks read a range each. What
    the driver alone can reach is read at once, by threads of it in the place of tasks.
    """
    reader = spark.read.format("jdbc").options(**target.options()).option("dbtable", f"({sql}) source_data").option("fetchsize", fetch_size)
    if split:
        reader = reader.options(partitionColumn=split.column, lowerBound=str(split.lower), upperBound=str(split.upper), numPartitions=split.partitions)
    scan = reader.load()
    return _read_in_driver(spark, target, sql, scan, fetch_size) if in_driver(spark, target) else scan


def _local_rows(spark: SparkSession, rows, schema) -> DataFrame:
    """A DataFrame of a list of rows and a schema, both of the JVM."""
    return DataFrame(spark._jsparkSession.createDataFrame(rows, schema), spark)


def _read_in_driver(spark: SparkSession, target: Target, sql: str, scan: DataFrame, fetch_size: int) -> DataFrame:
    """The rows of ``scan``, copied by the driver to files in the shared folder chunk by chunk, ranges side by side."""
    jvm, schema = spark._jvm, scan._jdf.schema()
    in_sql = jvm.org.apache.spark.sql
    utils = getattr(getattr(in_sql.execution.datasources.jdbc, "JdbcUtils$"), "MODULE$")
    arrow = getattr(getattr(in_sql.execution.arrow, "ArrowConverters$"), "MODULE$")
    numbered = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(scan.schema)])  # any name will do for a file
    columns = to_arrow_schema(numbered, timestamp_utc=True)
    folder = work_folder(spark, "read")

    def save(batch: pa.RecordBatch, path: str) -> None:
        held = pa.BufferOutputStream()
        pq.write_table(pa.Table.from_batches([batch]), held, coerce_timestamps="us")
        fs, at = hadoop_path(spark, path)
        out = fs.create(at, True)
        try:
            out.write(bytearray(held.getvalue()))
        finally:
            out.close()

    def copy(of: tuple[int, str | None]) -> None:
        in_sql.SparkSession.setActiveSession(spark._jsparkSession)
        connection = open_connection(spark, target)
        try:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            statement.setFetchSize(fetch_size)
            found = statement.executeQuery(f"SELECT * FROM ({sql}) source_data" + (f" WHERE {of[1]}" if of[1] else ""))
            rows = utils.resultSetToSparkInternalRows(found, in_sql.jdbc.JdbcDialects.get(target.url), schema, jvm.org.apache.spark.executor.InputMetrics(), jvm.scala.Option.empty())
            batches, n = arrow.toBatchIterator(rows, schema, CHUNK, "UTC", False, False, None), 0
            while batches.hasNext():
                save(pa.ipc.read_record_batch(pa.py_buffer(batches.next()), columns), f"{folder}/{of[0]}-{n}.parquet")
                n += 1
        finally:
            connection.rollback()
            connection.close()

    ranges = [p.whereClause() for p in scan._jdf.rdd().partitions()]
    with ThreadPoolExecutor(len(ranges)) as threads:
        list(threads.map(copy, enumerate(ranges)))
    return spark.read.schema(numbered).parquet(folder).toDF(*scan.columns)


def write_in_driver(spark: SparkSession, target: Target, table: str, df: DataFrame, **options: object) -> int:
    """Append ``df`` to a table that the driver alone can reach, and make that if it isn't there. Rows written.

    Executors make the rows and leave them in the shared folder; the driver writes them chunk by chunk, each
    in a transaction, by what tasks of Spark's JDBC writer run. ``options`` are those of that writer.
    """
    jvm, schema = spark._jvm, df._jdf.schema()
    given = {**target.options(), "dbtable": table, **{k: str(v) for k, v in options.items()}}
    # without rows no task runs: the table is made or its columns are checked
    _local_rows(spark, jvm.java.util.ArrayList(), schema).write.format("jdbc").options(**given).mode("append").save()
    spark_jdbc = jvm.org.apache.spark.sql
    utils, d = spark_jdbc.execution.datasources.jdbc.JdbcUtils, spark_jdbc.jdbc.JdbcDialects.get(target.url)
    as_options = spark_jdbc.execution.datasources.jdbc.JdbcOptionsInWrite(target.url, table, jvm.PythonUtils.toScalaMap(given))
    connection = open_connection(spark, target)
    try:
        there = utils.getSchemaOption(connection, as_options)
    finally:
        connection.close()
    insert = utils.getInsertStatement(table, schema, there, spark.conf.get("spark.sql.caseSensitive") == "true", d)
    # the writer counts its rows in, and takes its settings from, the context of a task
    contexts = getattr(getattr(jvm.org.apache.spark, "TaskContext$"), "MODULE$")
    context = contexts.empty()
    for k, v in spark.conf.getAll.items():
        context.getLocalProperties().setProperty(k, v)
    named = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    with Scratch(spark) as scratch:
        path = f"{scratch.path}/rows"
        named.write.option("maxRecordsPerFile", CHUNK).parquet(path)
        for file in spark.read.schema(named.schema).parquet(path).inputFiles():
            at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).toString()
            rows = jvm.scala.jdk.javaapi.CollectionConverters.asScala(spark.read.schema(named.schema).parquet(at)._jdf.collectAsList().iterator())
            contexts.setTaskContext(context)
            try:
                utils.savePartition(table, rows, schema, insert, as_options.batchSize(), d, as_options.isolationLevel(), as_options)
            finally:
                contexts.unset()
    return int(context.taskMetrics().outputMetrics().recordsWritten())


def quoted(target: Target, columns: Sequence[str]) -> str:
    q = target.dialect.quote
    return ", ".join(f"{q}{c}{q}" for c in columns)


def read_columns(spark: SparkSession, target: Target, columns: Sequence[str]) -> DataFrame:
    """Some columns of the target; a table that can't be read raises."""
    return read_query(spark, target, f"SELECT {quoted(target, columns)} FROM {target.table}")


def read_keys(spark: SparkSession, target: Target, keys: Sequence[str]) -> DataFrame:
    """The distinct keys of the target; the database removes the duplicates."""
    return read_query(spark, target, f"SELECT DISTINCT {quoted(target, keys)} FROM {target.table}")


def count_rows(spark: SparkSession, target: Target) -> int:
    """Rows of the target, counted by the database."""
    return int(read_query(spark, target, f"SELECT COUNT(*) AS n FROM {target.table}").first()[0])


def truncate_sql(target: Target) -> str:
    """The statement that empties the target in its dialect."""
    return target.dialect.truncate.format(table=target.table)
