"""Merge, write methods, sinks, statements, connectors and the runner."""

import random
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from lumbung.operators import merge
from lumbung.operators.methods import run_method
from lumbung.operators.quality import check_mart
from lumbung.operators.sinks import JdbcSink, ParquetSink, write_rows
from lumbung.operators.upsert_sql import upsert_sql
from lumbung.plans import ddl, pipeline
from lumbung.session import hadoop_path
from lumbung.sources import jdbc
from catalogue.adapter import AdaptedTables
from lumbung.streaming import latest_per_key, upsert_stream


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- merge ---------------------------------------------------------------------------------------


def test_key_that_is_not_first_keeps_columns_apart(spark):
    source = spark.createDataFrame([("x", 1, "p"), ("y", 2, "q")], "a string, id int, b string")
    target = spark.createDataFrame([("old", 1, "p")], "a string, id int, b string")
    c = merge.compare(source, target, ["id"])
    assert rows(c.of("changed")) == [("x", 1, "p")] and rows(c.of("new")) == [("y", 2, "q")]
    assert rows(merge.merged(source, target, ["id"])) == [("x", 1, "p"), ("y", 2, "q")]


@pytest.mark.parametrize("old,new", [((1, None, "c"), (1, "NULL", "c")), ((1, "a||b", "c"), (1, "a", "b||c"))])
def test_no_two_rows_look_alike(spark, old, new):
    schema = "id int, a string, b string"
    c = merge.compare(spark.createDataFrame([new], schema), spark.createDataFrame([old], schema), ["id"])
    assert c.of("changed").count() == 1
    both = spark.createDataFrame([old, new], schema)
    assert both.select(merge.row_digest(both.columns)).distinct().count() == 2


def test_stamps_do_not_count_with_keys_but_do_without(spark):
    schema = "id int, v int, updated_at int"
    s, t = spark.createDataFrame([(1, 1, 2)], schema), spark.createDataFrame([(1, 1, 1)], schema)
    assert merge.compare(s, t, ["id"]).of("unchanged").count() == 1
    assert merge.missing_rows(s, t).count() == 1


def test_null_key_is_new_unless_null_safe(spark):
    schema = "id int, v int"
    s, t = spark.createDataFrame([(None, 1)], schema), spark.createDataFrame([(None, 1)], schema)
    assert merge.compare(s, t, ["id"]).of("new").count() == 1
    assert merge.compare(s, t, ["id"], null_safe_keys=True).of("unchanged").count() == 1


def test_keyless_keeps_repeated_source_rows(spark):
    s = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert rows(merge.missing_rows(s, s.where("a = 2"))) == [(1, None), (1, None)]


def test_extra_columns_and_empty_sides(spark):
    s = spark.createDataFrame([(1, "n", 5)], "id int, v string, `extra.col` int")
    t = spark.createDataFrame([(1, "o", 7), (9, "x", 8)], "id int, v string, kept int")
    assert rows(merge.merged(s, t, ["id"])) == [(1, "n", 7), (9, "x", 8)]
    assert merge.compare(s.where("false"), t, ["id"]).rows.count() == 0
    assert merge.compare(s, t.where("false"), ["id"]).of("new").columns == s.columns


def test_merged_changes(spark):
    s = spark.createDataFrame([("n", 1, 9), ("b", 2, 9), ("d", 4, 9), ("e", None, 9)], "v string, id int, updated_at int")
    t = spark.createDataFrame([(1, "a", 1, 5), (2, "b", 1, 6), (3, "c", 1, 7), (None, "e", 1, 8)], "id int, v string, updated_at int, kept int")
    assert rows(merge.merged_changes(s, t, ["id"])) == sorted(
        [(1, "n", 9, 5, "changed"), (2, "b", 1, 6, "unchanged"), (3, "c", 1, 7, "kept"), (4, "d", 9, None, "new"), (None, "e", 9, None, "new"), (None, "e", 1, 8, "kept")], key=repr
    )
    assert merge.merged_changes(s, t, ["id"], null_safe_keys=True).where("id IS NULL").first()["__change"] == "unchanged"


def test_nothing_is_published_if_nothing_changed(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1)], "id int, v string, updated_at int")
    sink = ParquetSink(spark, f"{tmp_path}/t")
    sink.replace(df)
    files = sorted(p.name for p in (tmp_path / "t").iterdir())
    assert run_method(df.withColumn("updated_at", F.lit(2)), sink, "upsert", ["id"]).skipped == 1
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == files and len(list(tmp_path.iterdir())) == 1


def test_properties_of_upserts(spark, tmp_path):
    r = random.Random(3)
    for k in range(3):
        make = lambda: spark.createDataFrame([(i, r.choice([None, "a", "b"]), r.choice([None, 1, 2])) for i in r.sample(range(30), 15)], "id int, a string, b int")
        old, new = make(), make()
        sink = ParquetSink(spark, f"{tmp_path}/t{k}")
        sink.replace(old)
        first = run_method(new.select("b", "id", "a"), sink, "upsert", ["id"])
        assert first.new_rows + first.existing_rows == 15 == first.processed + first.skipped
        expected = {x["id"]: tuple(x) for x in old.collect()} | {x["id"]: tuple(x) for x in new.collect()}
        assert rows(sink.read().select("id", "a", "b")) == sorted(expected.values(), key=repr)
        again = run_method(new, sink, "upsert", ["id"])
        assert again.processed == 0 and again.count_after == again.count_before


def test_upsert_rewrites_touched_files_only(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "id AS v", "id % 4 AS part", "'k' AS kept").repartitionByRange(8, "id")
    for by in (None, "part"):
        sink = ParquetSink(spark, f"{tmp_path}/t{by}", partition_by=by)
        sink.replace(df)
        files = lambda: {x[0] for x in sink.read().select("_metadata.file_path").distinct().collect()}  # noqa: B023, E731
        before = files()
        changed = spark.createDataFrame([(4, 40, 0), (2000, 1, 0), (None, 5, 0)], "id int, v int, part int")
        stats = run_method(changed, sink, "upsert", ["id"])
        assert (stats.inserted, stats.updated, stats.skipped, stats.count_after, sink.count()) == (2, 1, 0, 1002, 1002)
        assert len(before - files()) == 1 and len(before & files()) == len(before) - 1
        assert rows(sink.read().where("id = 4 OR id >= 1000 OR id IS NULL").select("id", "v", "part", "kept")) == sorted([(4, 40, 0, "k"), (2000, 1, 0, None), (None, 5, 0, None)], key=repr)
        assert dict(sink.read().dtypes)["v"] == "bigint" and run_method(changed.where("id > 0"), sink, "upsert", ["id"]).skipped == 2
        moved = run_method(spark.createDataFrame([(4, 40, 3)], "id int, v int, part int"), sink, "upsert", ["id"])
        assert moved.updated == 1 and sink.count() == 1002 and sink.read().where("id = 4").first()["part"] == 3
    assert not [p for p in tmp_path.iterdir() if "journal" in p.name or "staging" in p.name]


def test_interrupted_upsert_is_finished(spark, tmp_path, monkeypatch):
    sink = ParquetSink(spark, f"{tmp_path}/t")
    sink.replace(spark.range(10).selectExpr("id", "0 AS v").repartition(3))

    def dies(self):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(ParquetSink, "_finish", dies)
        with pytest.raises(KeyboardInterrupt):
            sink.upsert(spark.createDataFrame([(1, 5), (77, 5)], "id long, v int"), ["id"])
    assert sink.count() == 11 and rows(sink.read().where("v = 5")) == [(1, 5), (77, 5)] and len(list(tmp_path.iterdir())) == 1


def test_hashes_tell_nulls_and_order_apart(spark):
    data = [(None, "a"), ("a", None), ("a", "a"), ("aa", ""), ("", "aa"), (None, None), (None, ""), ("", None)]
    df = spark.createDataFrame(data, "a string, b string")
    assert df.select(*merge.row_hashes([F.col("a"), F.col("b")])).distinct().count() == len(data)
    zero = spark.createDataFrame([(0.0,), (-0.0,)], "a double")
    assert zero.select(*merge.row_hashes([F.col("a")])).distinct().count() == 1


# --- write methods and the staged sink -------------------------------------------------------------


def test_empty_source(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    sink = ParquetSink(spark, f"{tmp_path}/t")
    assert run_method(df, sink, "overwrite").as_dict() == {"source_count": 2, "count_before": 0, "count_after": 2, "processed": 2, "inserted": 2, "failed": 0}
    assert run_method(df.where("false"), sink, "overwrite").processed == 0 and sink.count() == 2
    assert run_method(df.where("false"), sink, "append").inserted == 0 and sink.count() == 2
    stats = run_method(df.where("false"), sink, "truncate")
    assert stats.truncated and sink.count() == 0 and sink.read().columns == ["id"]


def test_empty_plans_of_every_kind(spark, tmp_path):
    """The optimiser drops empty plans, with what observes them."""
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    sink = ParquetSink(spark, f"{tmp_path}/t")
    sink.replace(df)
    for empty in (df.where("false"), spark.createDataFrame([], df.schema), df.limit(0), spark.range(0).selectExpr("int(id) AS id", "'x' AS v"), df.join(df.where("false").select("id"), "id")):
        stats = run_method(empty, sink, "upsert", ["id"])
        assert (stats.source_count, stats.processed, stats.count_after) == (0, 0, 2)
        assert run_method(empty, sink, "append").inserted == run_method(empty, sink, "overwrite").inserted == 0 and sink.count() == 2
    sink.replace(df.where("false"))
    assert run_method(df.where("false"), sink, "upsert", ["id"]).processed == 0
    assert run_method(df, sink, "upsert", ["id"]).inserted == 2 and sink.count() == 2


def test_append_and_keyless_upsert(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    sink = ParquetSink(spark, f"{tmp_path}/t")
    run_method(df, sink, "upsert")
    assert run_method(df, sink, "append").count_after == 4
    stats = run_method(df.union(spark.createDataFrame([(3, "c")], df.schema)), sink, "upsert")
    assert (stats.inserted, stats.skipped, sink.count()) == (1, 2, 5)


def test_repeated_keys_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "id int, v string")
    sink = ParquetSink(spark, f"{tmp_path}/t")
    with pytest.raises(ValueError, match="the source"):
        run_method(df, sink, "upsert", ["id"])
    assert not sink.exists()
    sink.replace(df)
    with pytest.raises(ValueError, match="the target"):
        run_method(df.limit(1), sink, "upsert", ["id"])


def test_unknown_method(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown method"):
        run_method(spark.range(1), ParquetSink(spark, f"{tmp_path}/t"), "replace")


def test_interrupted_publication_is_repaired(spark, tmp_path):
    sink = ParquetSink(spark, f"{tmp_path}/t")
    sink.replace(spark.range(3))
    fs, live = hadoop_path(spark, sink.path)
    fs.rename(live, hadoop_path(spark, f"{sink.path}.old")[1])
    assert sink.count() == 3
    with pytest.raises(Exception, match="boom|DIVIDE"):
        sink.replace(spark.range(3).select((F.lit(1) / (F.col("id") - 1)).alias("id")))
    assert sink.count() == 3 and len(list(tmp_path.iterdir())) == 1


def test_layout_prunes_and_sorts(spark, tmp_path):
    df = spark.createDataFrame([(m, d) for m in (202401, 202402) for d in range(5)], "stock_month int, d int")
    sink = ParquetSink(spark, f"{tmp_path}/t", ["d"], "stock_month")
    sink.replace(df)
    text = sink.read().where("stock_month = 202402")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(stock_month" in text


# --- statements ------------------------------------------------------------------------------------

COLUMNS, KEYS = ["id", "v"], ["id"]


@pytest.mark.parametrize(
    "db,keys,expected",
    [
        ("postgres", None, 'INSERT INTO t ("id", "v") VALUES (:id, :v)'),
        ("MySQL", None, "INSERT INTO t (`id`, `v`) VALUES (:id, :v)"),
        ("oracle", None, 'INSERT INTO t ("id", "v") VALUES (:id, :v)'),
        ("postgres", KEYS, 'INSERT INTO t ("id", "v") VALUES (:id, :v) ON CONFLICT ("id") DO UPDATE SET "v" = EXCLUDED."v"'),
        ("postgres", COLUMNS, 'INSERT INTO t ("id", "v") VALUES (:id, :v) ON CONFLICT ("id", "v") DO NOTHING'),
        ("mariadb", KEYS, "INSERT INTO t (`id`, `v`) VALUES (:id, :v) ON DUPLICATE KEY UPDATE `v` = VALUES(`v`)"),
        ("mysql", COLUMNS, "INSERT IGNORE INTO t (`id`, `v`) VALUES (:id, :v)"),
        ("mssql", KEYS, 'MERGE INTO t target USING (SELECT :id AS "id", :v AS "v") source ON target."id" = source."id" WHEN MATCHED THEN UPDATE SET target."v" = source."v" WHEN NOT MATCHED THEN INSERT ("id", "v") VALUES (source."id", source."v");'),
        ("oracle", KEYS, 'MERGE INTO t target USING (SELECT :id AS "id", :v AS "v" FROM DUAL) source ON (target."id" = source."id") WHEN MATCHED THEN UPDATE SET target."v" = source."v" WHEN NOT MATCHED THEN INSERT ("id", "v") VALUES (source."id", source."v")'),
        ("mssql", COLUMNS, 'MERGE INTO t target USING (SELECT :id AS "id", :v AS "v") source ON target."id" = source."id" AND target."v" = source."v" WHEN NOT MATCHED THEN INSERT ("id", "v") VALUES (source."id", source."v");'),
    ],
)
def test_upsert_statements(db, keys, expected):
    assert upsert_sql(db, "t", COLUMNS, keys) == expected


def test_upsert_statement_errors():
    with pytest.raises(ValueError):
        upsert_sql("clickhouse", "t", COLUMNS, KEYS)
    with pytest.raises(ValueError):
        upsert_sql("nosuch", "t", COLUMNS, KEYS)
    with pytest.raises(ValueError):
        upsert_sql("postgres", "t", COLUMNS, ["other"])


@pytest.mark.parametrize("db", ["postgres", "mssql", "mysql", "mariadb", "oracle"])
def test_urls_round_trip(db):
    url = jdbc.jdbc_url(db.upper(), "host", 1234, "base")
    assert jdbc.dialect_of_url(url).name == db and jdbc.parse_url(url) == ("host", "1234", "base")
    assert "p%40ss" in jdbc.sql_url(db, "host", 1, "base", "user", "p@ss")


def test_url_errors_and_job_urls():
    for f in (lambda: jdbc.jdbc_url("db2", "h", 1, "d"), lambda: jdbc.dialect_of_url("jdbc:db2://h"), lambda: jdbc.job_url("oracle", "h", 1, "d"), lambda: jdbc.parse_url("jdbc:mysql:x"), lambda: jdbc.sql_url("derby", "h", 1, "d", "u", "p")):
        with pytest.raises(ValueError):
            f()
    assert jdbc.job_url("mysql", "h", 3306, "d").startswith("jdbc:mysql://h:3306/d?useSSL=false")
    assert jdbc.job_url("clickhouse", "h", 8123, "d") == "jdbc:clickhouse://h:8123/d"
    assert "secret" not in repr(jdbc.Target("jdbc:mysql://h:1/d", "t", "u", "secret"))


# --- JDBC on the embedded database -----------------------------------------------------------------


def test_jdbc_round_trip(spark):
    target = jdbc.Target(jdbc.jdbc_url("derby", "", 0, "mart"), "T1")
    sink = JdbcSink(spark, target, partitions=2)
    df = spark.createDataFrame([(i, f"v{i}") for i in range(10)], "id int, v string")
    assert sink.replace(df) == 10 and sink.append(df.limit(2)) == 2 and sink.count() == 12
    assert sink.replace(df) == 10 and sink.count() == 10
    assert rows(jdbc.read_keys(spark, target, ["id"]))[:2] == [(0,), (1,)]
    split = jdbc.read_query(spark, target, 'SELECT "id", "v" FROM T1', jdbc.Split("id", 0, 10, 3))
    assert split.rdd.getNumPartitions() == 3 and split.count() == 10
    assert "PushedFilters: [*IsNotNull(id), *EqualTo(id,2)]" in sink.read(["id", "v"]).where("id = 2")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception):
        jdbc.count_rows(spark, jdbc.Target(target.url, "NOSUCH"))


def test_methods_on_a_database(spark):
    target = jdbc.Target(jdbc.jdbc_url("derby", "", 0, "methods"), "T")
    sink = JdbcSink(spark, target, partitions=1)
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    sink.replace(df)
    assert run_method(df.where("false"), sink, "overwrite").processed == 0 and sink.count() == 3
    changes = spark.createDataFrame([(2, "B"), (3, None), (4, "d")], df.schema)
    stats = run_method(changes, sink, "upsert", ["id"])
    assert (stats.inserted, stats.updated, stats.skipped, stats.failed, stats.count_after) == (1, 1, 1, 0, 4)
    assert rows(sink.read()) == [(1, "a"), (2, "B"), (3, None), (4, "d")]
    assert run_method(changes, sink, "upsert", ["id"]).processed == 0
    assert run_method(changes, sink, "append").count_after == 7
    assert run_method(changes, sink, "upsert").inserted == 0
    assert run_method(df.where("false"), sink, "truncate").truncated and sink.count() == 0
    sink.replace(df)
    sink.truncate()
    assert sink.count() == 0 and sink.read().columns == ["id", "v"]
    assert jdbc.truncate_sql(target) == "TRUNCATE TABLE T" and jdbc.truncate_sql(jdbc.Target("jdbc:postgresql://h:1/d", "t")) == "TRUNCATE TABLE t CASCADE"


def test_overwrite_keeps_the_declared_schema(spark):
    sink = JdbcSink(spark, jdbc.Target(jdbc.jdbc_url("derby", "", 0, "declared"), "T"))
    assert not sink.exists()
    sink._execute('CREATE TABLE T ("id" INT NOT NULL PRIMARY KEY, "v" VARCHAR(5))')
    assert sink.exists() and sink.count() == 0
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sink.replace(df) == 2 and sink.replace(df) == 2 and sink.count() == 2
    with pytest.raises(Exception, match="truncation|A truncation error"):
        sink.replace(spark.createDataFrame([(1, "too long")], df.schema))
    with pytest.raises(Exception):
        JdbcSink(spark, jdbc.Target("jdbc:derby:memory:nosuch", "T")).exists()


def test_a_probe_that_fails_is_no_missing_table(spark):
    sink = JdbcSink(spark, jdbc.Target(jdbc.jdbc_url("derby", "", 0, "rights"), "T"), partitions=1)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    sink.replace(df)

    class Locked(JdbcSink):
        def _is_there(self, table):
            return super()._is_there(f"{table} WITH NOTHING")  # a statement that the database refuses for another reason

    locked = Locked(spark, sink.target, partitions=1)
    with pytest.raises(Exception, match="Syntax|syntax"):
        run_method(df, locked, "overwrite")
    assert sink.count() == 2
    d = jdbc.DIALECTS
    assert d["postgres"].is_missing("42P01", 0, "") and d["mssql"].is_missing("x", 208, "") and not d["mysql"].is_missing("42000", 1142, "denied") and d["sqlite"].is_missing(None, 1, "no such table: t")


def test_all_or_nothing_on_a_database(spark):
    sink = JdbcSink(spark, jdbc.Target(jdbc.jdbc_url("derby", "", 0, "whole"), "T"), partitions=2)
    sink._execute('CREATE TABLE T ("id" INT NOT NULL PRIMARY KEY, "v" VARCHAR(5), "kept" INT)')
    df = spark.createDataFrame([(i, "a") for i in range(20)], "id int, v string")
    assert run_method(df, sink, "append", transaction=True, batch_size=3, partitions=1).inserted == 20 and sink.transaction is False
    sink._execute('UPDATE T SET "kept" = 7')
    bad = df.union(spark.createDataFrame([(99, "too long")], df.schema))
    for method, keys in (("append", None), ("overwrite", None), ("truncate", None), ("upsert", ["id"])):
        with pytest.raises(Exception):
            run_method(bad, sink, method, keys, transaction=True)
        assert sink.count() == 20 and sink.read().where('"kept" = 7' if False else "kept = 7").count() == 20
    stats = run_method(spark.createDataFrame([(3, "b"), (50, "n")], df.schema), sink, "upsert", ["id"])
    assert (stats.inserted, stats.updated, sink.count()) == (1, 1, 21)
    assert rows(sink.read().where("id IN (3, 50)")) == [(3, "b", 7), (50, "n", None)]  # columns that the source lacks stay
    assert run_method(df.limit(5), sink, "overwrite", transaction=True).inserted == 5 and sink.count() == 5
    with pytest.raises(ValueError, match="unknown options"):
        run_method(df, sink, "append", colour=1)


@pytest.mark.parametrize("transaction", [False, True])
def test_upserts_on_a_database_grow_with_the_rows(spark, transaction):
    n = 16_000
    sink = JdbcSink(spark, jdbc.Target(jdbc.jdbc_url("derby", "", 0, f"large{transaction}"), "T"), partitions=2)
    ids = lambda low, high, v: spark.range(low, high).selectExpr("int(id div 2) AS a", "int(IF(id = 5, NULL, id % 2)) AS b", f"'{v}' AS v", "id AS w", "2 * id AS x")
    sink.replace(ids(0, n, "old"))
    began = time.monotonic()
    stats = run_method(ids(n // 2, n + n // 2, "new").union(ids(5, 6, "none")), sink, "upsert", ["a", "b"], transaction=transaction)
    took = time.monotonic() - began
    assert (stats.inserted, stats.updated, stats.skipped) == (n // 2 + 1, n // 2, 0)  # a null key matches nothing
    assert rows(sink.read().groupBy("v").count()) == [("new", n), ("none", 1), ("old", n // 2)]
    assert sink.read().where("x <> 2 * w OR b <> w % 2").count() == 0
    assert took < 60  # row by row over all rows it took minutes


def test_statements_from_a_staging_table():
    from lumbung.operators.upsert_sql import staged_sql

    update, insert = staged_sql("postgres", "t", "s1", ["id", "v"], ["id", "V"], ["id"])
    assert update == 'UPDATE t SET "V" = (SELECT s."v" FROM s1 s WHERE t."id" = s."id") WHERE EXISTS (SELECT 1 FROM s1 s WHERE t."id" = s."id")'
    assert insert == 'INSERT INTO t ("id", "V") SELECT s."id", s."v" FROM s1 s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t."id" = s."id")'
    assert staged_sql("mysql", "t", "s1", ["id"], ["id"], ["id"]) == ["INSERT INTO t (`id`) SELECT s.`id` FROM s1 s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.`id` = s.`id`)"]
    delete, insert = staged_sql("clickhouse", "t", "s1", ["id", "v"], ["id", "v"], ["id"])
    assert delete.startswith("ALTER TABLE t DELETE WHERE (`id`) IN (SELECT `id` FROM s1)") and insert == "INSERT INTO t (`id`, `v`) SELECT s.`id`, s.`v` FROM s1 s"


@pytest.mark.parametrize("style,expected", [("named", ":p0, :p1"), ("pyformat", "%(p0)s, %(p1)s"), ("qmark", "?, ?"), ("format", "%s, %s"), ("numeric", ":1, :2")])
def test_parameter_styles_of_drivers(style, expected):
    from lumbung.operators.upsert_sql import bound_sql

    sql, named = bound_sql("postgres", "t", ["id", "id2"], ["id"], style)
    assert sql == f'INSERT INTO t ("id", "id2") VALUES ({expected}) ON CONFLICT ("id") DO UPDATE SET "id2" = EXCLUDED."id2"' and named == (style in ("named", "pyformat"))
    assert bound_sql("mssql", "t", ["a%", "b"], ["b"], style)[0].count('"a%%"' if style in ("pyformat", "format") else '"a%"') > 0


class _SqliteSink(JdbcSink):
    """A sink whose native writer always fails, over a database that only a Python driver reaches."""

    def __init__(self, spark, path):
        super().__init__(spark, jdbc.Target(f"jdbc:sqlite:{path}", "t"), connect=lambda: sqlite3.connect(path, timeout=60))
        self.path = path

    def _write(self, df, mode):
        raise OSError("no native writer")

    def exists(self):
        return True

    def truncate(self):
        with sqlite3.connect(self.path) as c:
            c.execute(jdbc.truncate_sql(self.target))

    def read(self, columns=None):
        with sqlite3.connect(self.path) as c:
            return self.spark.createDataFrame(c.execute("SELECT id, v FROM t").fetchall(), "id int, v string")

    def count(self):
        return self.read().count()


def test_fallback_sets_refused_rows_aside(spark, tmp_path):
    path = f"{tmp_path}/f.db"
    with sqlite3.connect(path) as c:
        c.execute('CREATE TABLE t ("id" INTEGER PRIMARY KEY, "v" TEXT NOT NULL)')
    sink = _SqliteSink(spark, path)
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, v string")
    stats = run_method(df, sink, "overwrite")
    assert (stats.inserted, stats.failed, sink.count()) == (2, 1, 2) and sink.failed.first()["id"] == 2
    stats = run_method(spark.createDataFrame([(1, None), (3, "C"), (4, "d"), (5, None)], df.schema), sink, "upsert", ["id"])
    assert (stats.inserted, stats.updated, stats.failed, stats.success, stats.count_after) == (1, 1, 2, 2, 3)
    assert rows(sink.read()) == [(1, "a"), (3, "C"), (4, "d")]
    stats = run_method(df, sink, "append", ["id"])
    assert (stats.inserted, stats.failed, stats.count_after) == (2, 1, 3)
    with pytest.raises(OSError):
        run_method(df, sink, "append")


def test_rows_over_a_driver(spark, tmp_path):
    path = f"{tmp_path}/x.db"
    with sqlite3.connect(path) as c:
        c.execute('CREATE TABLE t ("id" INTEGER PRIMARY KEY, "v" TEXT NOT NULL)')
        c.execute("INSERT INTO t VALUES (1, 'old')")
    connect = lambda: sqlite3.connect(path, timeout=60)
    df = spark.createDataFrame([(i, None if i in (3, 57) else f"v{i}") for i in range(1, 101)], "id int, v string")
    out = write_rows(df, connect, "sqlite", "t", ["id"], batch_size=40, workers=2)
    assert (out.success, out.failed_count) == (98, 2)
    assert [r["id"] for r in out.failed.orderBy("id").collect()] == [3, 57] and "NOT NULL" in out.failed.first()["_error"]
    with sqlite3.connect(path) as c:
        assert c.execute("SELECT count(*), min(v) FROM t WHERE id <= 2").fetchone() == (2, "v1")
    with pytest.raises(Exception, match="NOT NULL"):
        write_rows(df.where("id > 2").withColumn("id", F.col("id") + 1000), connect, "sqlite", "t", ["id"], transaction=True)
    with sqlite3.connect(path) as c:
        assert c.execute("SELECT count(*) FROM t").fetchone() == (98,)
    assert write_rows(df.where("id < 0"), connect, "sqlite", "t").success == 0

    kinds = spark.sql("SELECT 1 AS id, DATE '2024-01-02' AS d, TIMESTAMP_NTZ '2024-01-02 03:04:05' AS t, CAST(1.50 AS DECIMAL(9, 2)) AS m, DOUBLE('NaN') AS f, CAST(NULL AS DOUBLE) AS g, 9007199254740993 AS n")
    with sqlite3.connect(path) as c:
        c.execute('CREATE TABLE k ("id" INTEGER, "d" TEXT, "t" TEXT, "m" TEXT, "f", "g", "n" INTEGER)')
    assert write_rows(kinds, connect, "sqlite", "k").success == 1
    with sqlite3.connect(path) as c:  # the database itself keeps NaN as null
        assert c.execute("SELECT * FROM k").fetchone() == (1, "2024-01-02", "2024-01-02 03:04:05", "1.50", None, None, 9007199254740993)

    def broken():
        raise OSError("no route")

    out = write_rows(df.limit(5), broken, "sqlite", "t", ["id"])
    assert out.failed_count == 5 and out.failed.first()["_error"] == "Connection error: no route"


# --- runner, checks, stream ------------------------------------------------------------------------


def test_runner_and_checks(spark, sf, tmp_path):
    stats = pipeline.run(spark, AdaptedTables(spark, sf), str(tmp_path))
    assert list(stats) == [j.name for j in pipeline.JOBS] and stats["fact_stock_snapshot"].inserted == 6000
    found = {(r["table"], r["check"]): r["violations"] for r in pipeline.validate(spark, str(tmp_path)).collect()}
    assert found["dim_entity", "unique(entity_id)"] == 0 and found["fact_stock_snapshot", "references(entity_id)"] > 0


def test_empty_mart_and_its_statements(spark, sf, tmp_path):
    assert ddl.create_mart(spark, str(tmp_path)) == list(ddl.MART) and ddl.create_mart(spark, str(tmp_path)) == []
    assert spark.read.parquet(f"{tmp_path}/fact_stock_snapshot.parquet").columns[-1] == "stock_month"
    pipeline.run(spark, AdaptedTables(spark, sf), str(tmp_path), [pipeline.TableJob("dim_entity")])
    spark.sql(ddl.create_table_sql("dim_entity", str(tmp_path)))
    try:
        spark.sql("MSCK REPAIR TABLE dim_entity")
        assert spark.table("dim_entity").count() == 147
    finally:
        spark.sql("DROP TABLE dim_entity")
    assert "PARTITIONED BY (stock_month)" in ddl.create_table_sql("fact_stock_snapshot", "/x")


def test_runner_stops_at_the_first_failure(spark, sf, tmp_path):
    with pytest.raises(KeyError):
        pipeline.run(spark, {}, str(tmp_path), [pipeline.TableJob("dim_date"), pipeline.TableJob("dim_material"), pipeline.TableJob("dim_entity")])
    assert [p.name for p in tmp_path.iterdir()] == ["dim_date.parquet"]


def test_checks_find_violations(spark):
    mart = {"dim_activity": spark.createDataFrame([(1, None, None, 0, 0, 0, None, None)] * 2, "activity_id int, activity_code string, activity_name string, is_ordered_sales int, is_ordered_purchase int, is_patient_id int, created_at timestamp_ntz, updated_at timestamp_ntz")}
    assert [r["violations"] for r in check_mart(mart, ["dim_activity"]).collect()] == [1, 2]


def test_command_line():
    a = pipeline.parser().parse_args("--source_type mysql --source_host a --source_port 1 --source_user u --source_db d --target_type clickhouse --target_host b --target_port 2 --target_user v --target_db e --source_password x".split())
    assert a.source_password == "x" and a.target_db == "e"
    with pytest.raises(SystemExit):
        pipeline.parser().parse_args(["--source_type", "oracle"])


def test_latest_per_key(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, None, "x")], "id int, n int, v string")
    assert rows(latest_per_key(df, ["id"], ["n"])) == [(1, 2, "c"), (2, None, "x")]


def test_stream_keeps_a_table_current(spark, tmp_path):
    folder, sink = f"{tmp_path}/in", ParquetSink(spark, f"{tmp_path}/t")
    schema = "id int, n int, v string"
    for batch in ([(1, 1, "a"), (1, 2, "b")], [(1, 3, "c"), (2, 1, "x")]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(folder)
        upsert_stream(spark.readStream.schema(schema).parquet(folder), sink, ["id"], ["n"], f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert rows(sink.read()) == [(1, 3, "c"), (2, 1, "x")]
