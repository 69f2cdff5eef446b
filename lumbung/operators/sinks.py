"""Places to write: a Parquet table with staged publishing, a JDBC table, and rows over a Python driver."""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lumbung.operators.merge import UNCOMPARED, check_unique, row_hashes
from lumbung.operators.upsert_sql import bound_sql, staged_sql
from lumbung.session import Scratch, cut, delete_path, hadoop_path, rows_written
from lumbung.sources.jdbc import Target, count_rows, in_driver, open_connection, read_columns, read_query, truncate_sql, write_in_driver

BATCH_SIZE, WORKERS, PARTITIONS = 5000, 4, 8


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df`` that counts its rows while it is written; no second run of the plan."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def observed(seen: Observation) -> dict[str, int]:
    """What was observed while rows were written; nothing if the optimiser found that there are none and dropped the observation."""
    try:
        return dict(seen.get)
    except Py4JJavaError as e:
        if "AssertionError" not in str(e.java_exception):
            raise
        return {}


class ParquetSink:
    """A Parquet table at ``path``.

    As a whole it is replaced by writing to ``path.staging-…`` and publishing: the live folder moves
    to ``path.old``, the staged one to ``path``, then the old is deleted. A run that dies between the
    moves is repaired by the next access, which moves ``path.old`` back.

    An upsert rewrites only the files that hold changed rows. The files to add and to delete are
    listed in ``path.journal`` before any of them is touched; the next access finishes what a run that
    died has begun. Readers that don't go through this class may see both states while files move.
    """

    failed: DataFrame | None = None  # a Parquet write succeeds or fails as a whole

    def __init__(self, spark: SparkSession, path: str, sort: Sequence[str] = (), partition_by: str | None = None):
        self.spark, self.path, self.sort, self.partition_by = spark, path.rstrip("/"), list(sort), partition_by

    def _exists(self, path: str) -> bool:
        fs, p = hadoop_path(self.spark, path)
        return fs.exists(p)

    def _rename(self, a: str, b: str) -> None:
        fs, p = hadoop_path(self.spark, a)
        if not fs.rename(p, hadoop_path(self.spark, b)[1]):
            raise OSError(f"could not move {a} to {b}")

    def recover(self) -> None:
        """Undo or finish a publication that was interrupted."""
        if self._exists(f"{self.path}.journal"):
            self._finish()
        old = f"{self.path}.old"
        if self._exists(old):
            if self._exists(self.path):
                delete_path(self.spark, old)
            else:
                self._rename(old, self.path)

    def exists(self) -> bool:
        self.recover()
        return self._exists(self.path)

    def read(self) -> DataFrame | None:
        """The table, or None if there is none; a table that can't be read raises."""
        return self.spark.read.parquet(self.path) if self.exists() else None

    def count(self) -> int:
        now = self.read()
        return 0 if now is None else now.count()

    def _write(self, df: DataFrame, path: str, mode: str) -> None:
        if self.partition_by:
            # a partition goes to one task unless it is large: AQE splits those and joins small ones
            df = df.hint("rebalance", self.partition_by)
        if self.sort:
            # the writer wants rows by partition; with it first in the order it need not sort again
            df = df.sortWithinPartitions(*filter(None, [self.partition_by]), *self.sort)
        writer = df.write.mode(mode)
        (writer.partitionBy(self.partition_by) if self.partition_by else writer).parquet(path)

    def _staged(self, df: DataFrame, publish: Callable[[str], bool]) -> None:
        """Write ``df`` beside the table, then put it in the table's place if ``publish`` of the staged path says so."""
        self.recover()
        staging = f"{self.path}.staging-{uuid.uuid4().hex}"
        try:
            self._write(df, staging, "errorifexists")
            if not publish(staging):
                delete_path(self.spark, staging)
                return
            if self._exists(self.path):
                self._rename(self.path, f"{self.path}.old")
            self._rename(staging, self.path)
        except BaseException:
            delete_path(self.spark, staging)
            self.recover()
            raise
        delete_path(self.spark, f"{self.path}.old")

    def replace(self, df: DataFrame, keep_if_empty: bool = False) -> int:
        """Rows written. ``df`` may read the table that it replaces; ``keep_if_empty`` leaves the table alone if it has no row."""
        rows, seen = counted(df)
        n = 0

        def publish(staged: str) -> bool:
            nonlocal n
            told = observed(seen)
            n = told["n"] if told else self.spark.read.schema(df.schema).parquet(staged).count()
            return n > 0 or not keep_if_empty

        self._staged(rows, publish)
        return n

    def append(self, df: DataFrame, keys: Sequence[str] | None = None) -> int:
        """Rows added. Spark's committer publishes the files of a job only when all tasks succeeded."""
        self.recover()
        rows, seen = counted(df)
        self._write(rows, self.path, "append")
        told = observed(seen)
        return told["n"] if told else df.count()

    def _changes(self, source: DataFrame, target: DataFrame, keys: Sequence[str], ignore: Sequence[str], scratch: Scratch) -> tuple[DataFrame, dict[str, int]]:
        """The new and changed rows of ``source`` with ``__change`` and the ``__file`` of the row that each replaces, and counts by change.

        The table sends its keys, hashes of the compared columns and file names only. Repeated keys of
        either side are counted on the way.
        """
        types = dict(target.dtypes)
        both = [c for c in target.columns if c in source.columns]
        compared = [c for c in both if c not in keys and c not in ignore]
        q = lambda c: F.col(f"`{c}`")
        keyed = lambda: [q(k).isNotNull() for k in keys]
        s = source.select(*(q(c).cast(types[c]).alias(c) for c in both))
        a, b = row_hashes([q(c) for c in compared])
        s = s.withColumns({"__a": a, "__b": b})
        there = target.select(*map(q, keys), a.alias("__ta"), b.alias("__tb"), F.col("_metadata.file_path").alias("__file"))
        for k in keyed():
            there = there.where(k)
        of_target, of_source = Observation(), Observation()
        there = there.groupBy(*map(q, keys)).agg(F.count("*").alias("__times"), *(F.first(c).alias(c) for c in ("__ta", "__tb", "__file")))
        there = there.observe(of_target, F.count_if(F.col("__times") > 1).alias("repeated"))
        change = F.when(F.col("__ta").isNull(), "new").when((F.col("__a") != F.col("__ta")) | (F.col("__b") != F.col("__tb")), "changed").otherwise("unchanged")
        joined = s.join(there, list(keys), "left").withColumn("__change", change)
        joined = joined.withColumn("__nth", F.row_number().over(Window.partitionBy(*map(q, keys)).orderBy(F.lit(0))))
        has_key = F.lit(True)
        for k in keyed():
            has_key = has_key & k
        kinds = ("new", "changed", "unchanged")
        joined = joined.observe(of_source, F.count_if(has_key & (F.col("__nth") > 1)).alias("repeated"), *(F.count_if(F.col("__change") == k).alias(k) for k in kinds))
        found = scratch.table("changes", joined.where("__change <> 'unchanged'").select(*map(q, both), "__change", "__file"))
        told = observed(of_source)
        if not told and not found.isEmpty():
            raise RuntimeError("changes were written but not counted")
        if told.get("repeated"):
            check_unique(source, keys, "the source")
            raise ValueError("the source holds keys more than once")
        if observed(of_target).get("repeated"):
            check_unique(target, keys, "the target")
        return found, {k: told.get(k, 0) for k in kinds}

    def upsert(self, source: DataFrame, keys: Sequence[str], ignore: Sequence[str] = UNCOMPARED) -> dict[str, int]:
        """Rows of ``source`` by change (``new``, ``changed``, ``unchanged``), after the first two have been written.

        Changes are found first; if there is none nothing is written. Of the table only the files are
        rewritten that hold a row that changed. Columns that the source lacks keep their old values;
        columns that the table lacks are not added; values are cast to the table's types. Repeated keys
        raise ValueError before anything is written; a null key matches nothing and is new.
        """
        target = self.read()
        q = lambda c: F.col(f"`{c}`")
        with Scratch(self.spark) as scratch:
            changes, counts = self._changes(source, target, keys, ignore, scratch)
            if not counts["new"] and not counts["changed"]:
                return counts
            both = [c for c in target.columns if c in source.columns]
            fresh = changes.where("__change = 'new'").select(*(q(c) if c in both else F.lit(None).cast(t).alias(c) for c, t in target.dtypes))
            files = [r[0] for r in changes.where("__change = 'changed'").select("__file").distinct().collect()] if counts["changed"] else []
            paths = [self.spark._jvm.org.apache.hadoop.fs.Path(self.spark._jvm.java.net.URI(f)).toString() for f in files]
            out = fresh
            if files:
                old = self.spark.read.schema(target.schema).option("basePath", self.path).parquet(*paths).alias("t")
                won = changes.where("__change = 'changed'").select(*map(q, both), F.lit(True).alias("__won")).alias("s")
                on = [F.col(f"t.`{k}`") == F.col(f"s.`{k}`") for k in keys]
                pick = lambda c: F.when(F.col("s.__won"), F.col(f"s.`{c}`")).otherwise(F.col(f"t.`{c}`")).alias(c) if c in both else F.col(f"t.`{c}`")
                out = old.join(won, on, "left").select(*map(pick, target.columns))
                out = out.unionByName(fresh) if counts["new"] else out
            staging = f"{self.path}.staging-{uuid.uuid4().hex}"
            try:
                self._write(out, staging, "errorifexists")
                self._journal(staging, paths)
            except BaseException:
                delete_path(self.spark, staging)
                raise
            self._finish()
            return counts

    def _journal(self, staging: str, remove: Sequence[str]) -> None:
        """List what is to be moved and deleted; the list appears at its place whole or not at all."""
        fs, root = hadoop_path(self.spark, staging)
        base = fs.makeQualified(root).toUri().getPath()
        found, add = fs.listFiles(root, True), []
        while found.hasNext():
            at = found.next().getPath()
            if not at.getName().startswith(("_", ".")):
                add.append(at.toUri().getPath()[len(base) :].lstrip("/"))
        draft = f"{self.path}.journal-{uuid.uuid4().hex}"
        out = fs.create(hadoop_path(self.spark, draft)[1], True)
        out.write(bytearray(json.dumps({"staging": staging, "add": add, "remove": list(remove)}).encode()))
        out.close()
        self._rename(draft, f"{self.path}.journal")

    def _finish(self) -> None:
        """Do what the journal says, as far as it isn't done yet."""
        fs, at = hadoop_path(self.spark, f"{self.path}.journal")
        stream = fs.open(at)
        todo = json.loads(bytes(stream.readAllBytes()))
        stream.close()
        for name in todo["add"]:
            if self._exists(f"{todo['staging']}/{name}"):
                if "/" in name:
                    fs.mkdirs(hadoop_path(self.spark, f"{self.path}/{name.rpartition('/')[0]}")[1])
                self._rename(f"{todo['staging']}/{name}", f"{self.path}/{name}")
        for path in todo["remove"]:
            delete_path(self.spark, path)
        delete_path(self.spark, f"{self.path}.journal")
        delete_path(self.spark, todo["staging"])


class JdbcSink:
    """A database table written by Spark's JDBC writer.

    An overwrite empties the table by its dialect's statement and appends, so the declared schema, keys
    and rights stay; Spark's own overwrite drops and makes anew the tables of databases it has no
    dialect for. Rows are counted by the writer's own tasks.

    With ``connect``, which is called on executors and returns a DB-API connection, upserts send only
    the changed rows, and a native write that fails is done again row-wise with failing rows set aside
    in ``failed``: after a truncation, or by key, where repeating a row changes nothing. An append
    without keys is not repeated, because a part of it may have been written. Without ``connect`` an
    upsert writes the changed rows to a staging table and brings them over by statements.

    A database inside the driver's process is written by the driver where tasks run in other processes.

    ``transaction`` makes every write all or nothing: rows go to a staging table first, and are brought
    over in one transaction of the database (ValueError if it has none).
    """

    def __init__(
        self, spark: SparkSession, target: Target, batch_size: int = 10_000, partitions: int = PARTITIONS, isolation: str = "READ_COMMITTED", connect: Callable[[], object] | None = None, workers: int = WORKERS, transaction: bool = False
    ):
        self.spark, self.target, self.batch_size, self.partitions, self.isolation, self.connect = spark, target, batch_size, partitions, isolation, connect
        self.workers, self.transaction = workers, transaction
        self.failed: DataFrame | None = None

    def _save(self, df: DataFrame, table: str, **more: str) -> int:
        more = {"batchsize": self.batch_size, "isolationLevel": self.isolation, **more}
        if in_driver(self.spark, self.target):
            return write_in_driver(self.spark, self.target, table, df, **more)
        writer = df.write.format("jdbc").options(**self.target.options(), **more).option("dbtable", table)
        return rows_written(self.spark, writer.option("numPartitions", self.partitions).mode("append").save)

    def _write(self, df: DataFrame, mode: str) -> int:
        if mode == "overwrite" and self.exists():
            self.truncate()
        return self._save(df, self.target.table)

    def _row_wise(self, df: DataFrame, keys: Sequence[str] | None) -> int:
        out = write_rows(df, self.connect, self.target.dialect.name, self.target.table, keys, self.batch_size, self.workers)
        self.failed = out.failed if out.failed_count else None
        return out.success

    def _execute(self, *statements: str) -> None:
        """Run statements from the driver in one transaction, through the same JDBC driver that Spark uses."""
        connection = open_connection(self.spark, self.target)
        try:
            if len(statements) > 1 and self.target.dialect.transactions:
                connection.setAutoCommit(False)
            for sql in statements:
                statement = connection.createStatement()
                statement.execute(sql)
                statement.close()
            if not connection.getAutoCommit():
                connection.commit()
        except BaseException:
            if not connection.getAutoCommit():
                connection.rollback()
            raise
        finally:
            connection.close()

    def _names(self, columns: Sequence[str]) -> list[str]:
        """The table's own names of some columns, which may differ in case."""
        known = {c.lower(): c for c in self.read().columns}
        return [known.get(c.lower(), c) for c in columns]

    def _through_staging(self, df: DataFrame, statements: Callable[[str], Sequence[str]]) -> int:
        """Write ``df`` to a staging table and run statements with its name, all in one transaction. Rows staged.

        Where the database has no transactions, and a statement fails, the staging table stays, and the error names it.
        """
        staging = f"{self.target.table}_stage_{uuid.uuid4().hex[:8]}"
        d = self.target.dialect
        try:
            n = self._save(df, staging, **({"createTableOptions": d.create} if d.create else {}))
            self._execute(*statements(staging))
        except BaseException as e:
            if not d.transactions:
                raise RuntimeError(f"rows not brought over are in {staging}") from e
            self._drop(staging)
            raise
        self._drop(staging)
        return n

    def _drop(self, table: str) -> None:
        if self._is_there(table):
            self._execute(f"DROP TABLE {table}")

    def _whole(self, df: DataFrame, first: Sequence[str]) -> int:
        if not self.target.dialect.transactions:
            raise ValueError(f"no transactions in: {self.target.dialect.name}")
        q = self.target.dialect.quote
        into, given = (", ".join(f"{q}{c}{q}" for c in names) for names in (self._names(df.columns), df.columns))
        return self._through_staging(df, lambda staging: [*first, f"INSERT INTO {self.target.table} ({into}) SELECT {given} FROM {staging}"])

    def truncate(self) -> None:
        self._execute(truncate_sql(self.target))

    def replace(self, df: DataFrame, keep_if_empty: bool = False) -> int:
        self.failed = None
        if keep_if_empty and df.isEmpty():
            return 0
        if self.transaction and self.exists():
            return self._whole(df, [f"DELETE FROM {self.target.table}"])
        try:
            return self._write(df, "overwrite")
        except Exception:  # noqa: BLE001  whatever the driver raises
            if self.connect is None:
                raise
            self.truncate()
            return self._row_wise(df, None)

    def append(self, df: DataFrame, keys: Sequence[str] | None = None) -> int:
        self.failed = None
        if self.transaction and self.exists():
            return self._whole(df, [])
        try:
            return self._write(df, "append")
        except Exception:  # noqa: BLE001
            if self.connect is None or not keys:
                raise
            return self._row_wise(df, keys)

    def apply(self, changes: DataFrame, whole: DataFrame, keys: Sequence[str]) -> int:
        """Bring the rows that differ into the table; ``whole`` is its merged state. Rows written."""
        self.failed = None
        d = self.target.dialect
        if self.connect is not None and not self.transaction:
            return self._row_wise(changes, keys)
        if self.transaction and not d.transactions:
            raise ValueError(f"no transactions in: {d.name}")
        if not d.transactions:  # rows are deleted and come back whole
            changes = whole.join(changes.select(*(f"`{k}`" for k in keys)), list(keys), "left_semi")
        changes = cut(changes)  # it reads the table that is written
        return self._through_staging(changes, lambda staging: staged_sql(d.name, self.target.table, staging, changes.columns, self._names(changes.columns), keys))

    def _is_there(self, table: str) -> bool:
        try:
            self._execute(f"SELECT 1 FROM {table} WHERE 1 = 0")
        except Py4JJavaError as e:
            cause = e.java_exception
            while cause is not None:
                if self.spark._jvm.java.lang.Class.forName("java.sql.SQLException").isInstance(cause) and self.target.dialect.is_missing(cause.getSQLState(), cause.getErrorCode(), str(cause.getMessage())):
                    return False
                cause = cause.getCause()
            raise
        return True

    def exists(self) -> bool:
        """Whether the table is there; anything but the database's own word that it isn't raises: rights, time-outs, locks."""
        self._execute(self.target.dialect.ping)
        return self._is_there(self.target.table)

    def count(self) -> int:
        return count_rows(self.spark, self.target)

    def read(self, columns: Sequence[str] | None = None) -> DataFrame:
        """The table, or some columns of it, as a lazy scan; a table that can't be read raises."""
        return read_columns(self.spark, self.target, columns) if columns else read_query(self.spark, self.target, f"SELECT * FROM {self.target.table}")


@dataclass(frozen=True)
class RowsWritten:
    """``failed`` holds the rows that could not be written with ``_error``, as a DataFrame on the shared storage."""

    success: int
    failed_count: int
    failed: DataFrame


class _Rows:
    """Writes batches over one connection of a task, opened when needed and again after it broke."""

    def __init__(self, connect: Callable[[], object], db_type: str, table: str, columns: Sequence[str], keys: Sequence[str] | None):
        self.connect, self.args, self.columns = connect, (db_type, table, columns, keys), list(columns)
        self.connection = None

    def open(self) -> object:
        if self.connection is None:
            self.connection = self.connect()
            module = sys.modules.get(type(self.connection).__module__.partition(".")[0])
            self.sql, self.named = bound_sql(*self.args, getattr(module, "paramstyle", None) or "named")
            self.plain = module is not None and module.__name__ == "sqlite3"
        return self.connection

    def close(self) -> None:
        if self.connection is not None:
            self.connection.close()
            self.connection = None

    def _values(self, row: dict) -> dict | tuple:
        values = [row[c] for c in self.columns]
        if self.plain:  # a driver without types of its own for times and decimals
            values = [v.isoformat(" ") if isinstance(v, datetime) else v.isoformat() if isinstance(v, date) else str(v) if isinstance(v, Decimal) else v for v in values]
        return {f"p{i}": v for i, v in enumerate(values)} if self.named else tuple(values)

    def execute(self, rows: list[dict]) -> None:
        connection = self.open()
        # a driver that opens placeholders by the styles above takes either kind of values
        cursor = connection.cursor()
        try:
            cursor.executemany(self.sql, [self._values(r) for r in rows])
        finally:
            cursor.close()

    def attempt(self, rows: list[dict]) -> Exception | None:
        try:
            self.execute(rows)
            self.connection.commit()
            return None
        except Exception as e:  # noqa: BLE001  whatever the driver raises
            try:
                self.connection.rollback()
            except Exception:  # noqa: BLE001  the connection is gone: the next attempt opens another
                self.connection = None
            return e

    def write(self, rows: list[dict], error: str = "_error") -> Iterator[dict]:
        """Write a batch; on failure in tenths (of ten rows at least), on failure row by row. Yields failed rows."""
        try:
            self.open()
        except Exception as e:  # noqa: BLE001
            yield from ({**r, error: f"Connection error: {str(e)[:100]}"} for r in rows)
            return
        if self.attempt(rows) is None:
            return
        step = max(10, len(rows) // 10)
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            if self.attempt(part) is None:
                continue
            for row in part:
                if (e := self.attempt([row])) is not None:
                    yield {**row, error: str(e)[:200]}


def write_rows(
    df: DataFrame, connect: Callable[[], object], db_type: str, table: str, keys: Sequence[str] | None = None, batch_size: int = BATCH_SIZE, workers: int = WORKERS, transaction: bool = False
) -> RowsWritten:
    """Write ``df`` with one statement per row from the executors, and return what failed.

    ``connect`` is called on executors, once per task, and returns a DB-API connection; parameters are
    marked as its module's ``paramstyle`` says. Values are Python's own by the column's type: NaN stays
    NaN, null is None. At most ``workers`` tasks write at a time; what ``df`` is made of runs in as many
    as it has. Upserts are idempotent, so a repeated task changes nothing; a plain insert (no ``keys``) may
    repeat rows if a task is lost after it committed. ``transaction`` writes everything from one task in
    one transaction and raises if any row fails. An empty ``df`` gives zeros.
    """
    columns, schema = df.columns, df.schema
    out = StructType([*schema.fields, StructField("_error", StringType()), StructField("_written", LongType())])
    loose = StructType([StructField(f.name, f.dataType, True) for f in out])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(loose)

    def told(failed: list[dict], written: int) -> pa.RecordBatch:
        records = [{**f, "_written": None} for f in failed] + [{"_written": written}]
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in records], type=t) for n, t in zip(arrow.names, arrow.types)], schema=arrow)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(connect, db_type, table, columns, keys)
        try:
            if transaction:
                n = 0
                for batch in batches:
                    for i in range(0, batch.num_rows, batch_size):
                        part = batch.slice(i, batch_size).to_pylist()
                        rows.execute(part)
                        n += len(part)
                if rows.connection is not None:
                    rows.connection.commit()
                yield told([], n)
                return
            for batch in batches:
                for i in range(0, batch.num_rows, batch_size):
                    part = batch.slice(i, batch_size).to_pylist()
                    failed = list(rows.write(part))
                    yield told(failed, len(part) - len(failed))
        except BaseException:
            if rows.connection is not None:
                rows.connection.rollback()
            raise
        finally:
            rows.close()

    done = cut(df.repartition(1 if transaction else workers).mapInArrow(work, loose))
    failed = done.where(F.col("_error").isNotNull()).drop("_written")
    n = done.agg(F.coalesce(F.sum("_written"), F.lit(0)), F.count("_error")).first()
    return RowsWritten(int(n[0]), int(n[1]), failed)
