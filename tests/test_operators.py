"""The general operators against plain versions on small data, with nulls, ties, repeats, empty tables and clashing names."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumbung.operators import history, intervals, profile, references, skew, snapshot_diff

DAY = date(2024, 1, 1)


def day(n):
    return None if n is None else DAY + timedelta(days=n)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- intervals -------------------------------------------------------------------------------------


def plain_periods(data):
    out, by = [], {}
    for k, s, e in set(data):
        if k is not None and s is not None and (e is None or e >= s):
            by.setdefault(k, set()).add((s, e))
    for k, pairs in by.items():
        merged = []
        for s, e in sorted(pairs, key=lambda p: (p[0], p[1] or date.max)):
            e = e or date.max
            if merged and (merged[-1][1] == date.max or s <= merged[-1][1] + timedelta(days=1)):
                merged[-1] = (merged[-1][0], max(merged[-1][1], e), merged[-1][2] + 1)
            else:
                merged.append((s, e, 1))
        for s, e, n in merged:
            out.append((k, "period", s, None if e == date.max else e, n > 1))
        for (_, e, _), (s, _, _) in zip(merged, merged[1:]):
            out.append((k, "gap", e + timedelta(days=1), s - timedelta(days=1), False))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_periods_against_plain_version(spark, seed):
    r = random.Random(seed)
    data = []
    for _ in range(600):
        s = r.choice([None, *range(0, 400)] if r.random() < 0.1 else range(0, 400))
        e = None if s is None or r.random() < 0.02 else s + r.randint(-2, 8)
        data.append((r.choice([None, 1, 1, 1, 2, 3, 4]), day(s), day(e)))
    data += data[:50]
    df = spark.createDataFrame(data, "key int, start date, `end` date").withColumn("many", F.lit("x")).withColumn("block", F.lit(1)).repartition(5)
    assert rows(intervals.periods_and_gaps(df, "key", "start", "end")) == plain_periods(data)


def test_periods_of_one_hot_key_and_text_keys(spark):
    data = [("a b", day(3 * i), day(3 * i + i % 3)) for i in range(500)] * 3 + [("c", day(0), None), ("c", day(5), day(6))]
    df = spark.createDataFrame(data, "k string, f date, t date").repartition(9)
    got = rows(intervals.periods_and_gaps(df, "k", "f", "t"))
    assert got == plain_periods(data) and ("c", "period", day(0), None, True) in got


def test_tree_of_any_depth_gives_the_same(spark):
    r = random.Random(8)
    data = [(r.randint(1, 3), day(s), day(s + r.randint(0, 3))) for s in (r.randint(0, 3000) for _ in range(900))]
    df = spark.createDataFrame(data, "k int, f date, t date").repartition(30)
    for fan_in, partitions in ((2, 30), (4, 30), (32, 30), (2, 1)):
        got = intervals.continuous_periods(df, "k", "f", "t", fan_in, partitions)
        assert rows(got.selectExpr("k", "'period' AS kind", "inline(periods)")) == [x for x in plain_periods(data) if x[1] == "period"]
    with pytest.raises(ValueError):
        intervals.continuous_periods(df.selectExpr("double(k) AS k", "f", "t"), "k", "f", "t")


def test_full_states_are_sent_on_and_lists_span_batches(spark, monkeypatch):
    import pyarrow as pa

    n = 3000
    keys = np.sort(np.random.default_rng(1).integers(0, 5, n))
    start = np.concatenate([np.sort(np.random.default_rng(k).integers(0, 9000, (keys == k).sum())) for k in range(5)])
    end = start + np.random.default_rng(9).integers(0, 4, n)
    schema = pa.schema([("key", pa.int64()), ("periods", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("many", pa.bool_())]))), ("gaps", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])
    whole = pa.RecordBatch.from_pydict({"key": keys, "start": start, "end": end, "many": np.zeros(n, bool)})
    want = None
    for size in (n, 700, 7, 1):
        out = pa.Table.from_batches(intervals._final(schema)(iter([whole.slice(i, size) for i in range(0, n, size)]))).to_pylist()
        want = want or out
        assert out == want and [x["key"] for x in out] == list(range(5)) and all(len(x["gaps"]) == len(x["periods"]) - 1 for x in out)
    monkeypatch.setattr(intervals, "BUFFER_ROWS", 50)
    state = intervals._State()
    import pandas as pd

    order = np.random.default_rng(2).permutation(n)
    for i in range(0, n, 40):
        at = order[i : i + 40]
        state.add(pd.DataFrame({"key": keys[at], "start": start[at], "end": end[at], "many": False}))
    got = pd.concat(state.frames(0)).sort_values(["key", "start"])
    assert got["start"].tolist() == [p["start"] for x in want for p in x["periods"]] and got["many"].tolist() == [p["many"] for x in want for p in x["periods"]]


def test_periods_of_nothing(spark):
    df = spark.createDataFrame([(None, DAY, DAY), (1, None, DAY), (2, DAY, day(-1))], "k int, f date, t date")
    assert intervals.continuous_periods(df, "k", "f", "t").count() == 0
    assert intervals.continuous_periods(df.where("false"), "k", "f", "t").columns == ["k", "periods", "gaps"]


def test_merge_is_associative():
    r = np.random.default_rng(0)
    k, s = r.integers(0, 3, 300), r.integers(0, 2000, 300)
    e = s + r.integers(0, 9, 300)
    one = lambda i: intervals.merge(k[i], s[i], e[i], np.zeros(len(i), bool))
    join = lambda *x: intervals.merge(*(np.concatenate(c) for c in zip(*x)))
    a, b, c = np.split(r.permutation(300), [100, 200])
    whole = one(np.arange(300))
    for other in (join(join(one(a), one(b)), one(c)), join(one(c), join(one(b), one(a)))):
        assert all((x == y).all() for x, y in zip(whole, other))


# --- skew ------------------------------------------------------------------------------------------


def test_key_totals(spark):
    nan, inf = float("nan"), float("inf")
    r = random.Random(1)
    data = [(7 if i % 3 else r.choice([None, 1, 2]), r.choice([None, 5, 6]), r.choice([None, nan, inf, -1.0, 0.1, 2.5]), r.choice([None, i % 10])) for i in range(900)]
    df = spark.createDataFrame(data, "entity_id int, material_id int, q double, at int").repartition(6)
    got = {(x["in_field"], x["key_id"]): x for x in skew.key_totals(df, ["entity_id", "material_id"], "q", ["at", "q"]).collect()}
    for n, field in enumerate(("entity_id", "material_id")):
        for key in {d[n] for d in data}:
            own = [d for d in data if d[n] == key]
            values = [d[2] for d in own if d[2] is not None and np.isfinite(d[2])]
            x = got[field, key]
            assert (x["n_rows"], x["n_values"]) == (len(own), len(values)) and x["sum_value"] == pytest.approx(sum(values)) and x["share"] == len(own) / 900
            order = [d[3] for d in own if d[3] is not None]
            assert (x["first_order"], x["last_order"]) == (min(order), max(order))
    assert rows(skew.heavy_keys(df, ["entity_id"], "q", ["at"], 0.5).select("key_id")) == [(7,)]
    assert rows(skew.heavy_keys(df.selectExpr("'k' || entity_id AS t", "q", "at"), ["t"], "q", ["at"], 0.5).select("key_id")) == [("k7",)]
    assert skew.key_totals(df.where("false"), ["entity_id"], "q", ["at"]).count() == 0
    clash = df.selectExpr("entity_id AS value", "q AS key_id", "at AS in_field", "1 AS n", "2 AS o0", "3 AS share")
    assert rows(skew.heavy_keys(clash, ["value"], "key_id", ["in_field"], 0.5).select("in_field", "key_id")) == [("value", 7)]


def test_a_hot_key_is_cut_over_partitions(spark):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(20_000).select(F.lit(1).alias("entity_id"), F.col("id").alias("at"), F.lit(1.0).alias("q"))
        sizes = [r["count"] for r in skew.key_ranges(df, ["entity_id"], ["at"], "q").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


# --- references ------------------------------------------------------------------------------------


def ts(n):
    return None if n is None else datetime(2024, 1, 15) + timedelta(days=n)


def orphans(spark, refs, parents, deleted):
    fact = spark.createDataFrame(refs, "id long, key_id int, created timestamp_ntz").withColumn("month", F.lit("x"))
    dim = spark.createDataFrame(parents, "key_id int, created_at timestamp_ntz")
    gone = spark.createDataFrame([(d,) for d in deleted], "key_id int")
    ref = references.Reference("fact", "key_id", fact, F.col("id").cast("string"), "created", "created", dim, "key_id", "created_at", gone)
    return references.orphan_references([ref])


def plain_orphans(refs, parents, deleted):
    made = {}
    for k, c in parents:
        c = c or datetime.min
        if k is not None:
            made[k] = min(made.get(k, c), c)
    out = set()
    for i, k, c in refs:
        if k is not None:
            kind = ("deleted" if k in deleted else "missing") if k not in made else "late" if c and made[k] > c else None
            if kind:
                out.add(("fact", "key_id", str(i), c.strftime("%Y-%m") if c else None, k, kind))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_orphans_against_plain_version(spark, seed, monkeypatch):
    r = random.Random(seed)
    key = lambda: r.choice([None, 0, -1, -40_000, 1, 32_768, 32_769, 65_536, *range(2, 60)])
    refs = [(i, key(), ts(r.choice([None, *range(0, 200, 7)]))) for i in range(400)] + [(1, 1, ts(0))] * 3
    parents = [(key(), ts(r.choice([None, -5, *range(0, 200, 5)]))) for _ in range(40)] + [(None, ts(1))]
    deleted = [key() for _ in range(20)]
    assert rows(orphans(spark, refs, parents, deleted)) == plain_orphans(refs, parents, deleted)
    monkeypatch.setattr(references, "FEW_KEYS", 0)
    assert rows(orphans(spark, refs, parents, deleted)) == plain_orphans(refs, parents, deleted)


def test_orphans_without_parents_or_rows(spark):
    assert rows(orphans(spark, [(1, 5, ts(0))], [], [])) == [("fact", "key_id", "1", "2024-01", 5, "missing")]
    assert rows(orphans(spark, [], [(5, ts(0))], [5])) == []
    report = references.orphan_report(orphans(spark, [(1, 5, ts(0)), (2, 5, ts(1)), (3, 6, ts(2))], [], [6]))
    assert rows(report) == [("fact", "key_id", "2024-01", "deleted", 1, 1), ("fact", "key_id", "2024-01", "missing", 2, 1)]


def test_bitmaps_round_trip(spark):
    keys = sorted({*range(-5, 6), 32_767, 32_768, 32_769, -32_768, -32_769, 10**9, -(10**9)})
    found = references._bitmaps(spark.createDataFrame([(k,) for k in keys], "code long"), []).collect()
    none = np.zeros(references.BITS // 8, np.uint8)
    assert sorted(int(k) for r in found for k in references._decode(r["bucket"], references._and_not(r["bits"], none))) == keys


def test_containers_and_not():
    r = np.random.default_rng(3)
    for a, b in ((5, 9), (5, 20_000), (20_000, 5), (20_000, 20_000), (0, 7)):
        x, y = (np.sort(r.choice(references.BITS, n, replace=False)) for n in (a, b))
        bits = []
        for at in (x, y):
            one = np.zeros(references.BITS, np.uint8)
            one[at] = 1
            bits.append(np.packbits(one, bitorder="little"))
        p, q = (references.pack(v.tobytes()) for v in bits)
        there = np.zeros(references.BITS // 8, np.uint8)
        references._into(there, q)
        assert (there == bits[1]).all() and references._and_not(p, there).tolist() == np.setdiff1d(x, y).tolist()
        assert len(p) <= 1 + min(2 * a, references.BITS // 8)


def test_text_and_sparse_keys(spark):
    big = 9_000_000_000_000_000_000
    for kind, keys in (("string", ["b", "a", "ä", "", "zz"]), ("long", [big, -big, 5, 0, big - 7])):
        fact = spark.createDataFrame([(i, k, ts(0)) for i, k in enumerate([*keys, None])], f"id int, ref {kind}, at timestamp_ntz")
        dim = spark.createDataFrame([(keys[0], ts(-40)), (keys[1], ts(3))], f"ref {kind}, made timestamp_ntz")
        gone = spark.createDataFrame([(keys[2],)], f"k {kind}")
        got = references.orphan_references([references.Reference("t", "ref", fact, F.col("id").cast("string"), "at", "at", dim, "ref", "made", gone)])
        assert sorted((x["record_key"], x["kind"]) for x in got.collect()) == [("1", "late"), ("2", "deleted"), ("3", "missing"), ("4", "missing")]


def test_filter_keeps_every_row_that_it_was_made_of(spark):
    made = spark.range(0, 3000, 3).selectExpr("id", "string(id) AS t")
    every = spark.range(0, 3000).selectExpr("id", "string(id) AS t", "1 AS words")
    got = [x["id"] for x in references._may_hold(every.drop("words"), references._filter(made, "id", "t"), "id", "t").collect()]
    assert set(range(0, 3000, 3)) <= set(got) and len(got) < 1100


def test_dictionary_is_dense_and_ordered(spark):
    words = ["b", "a", None, "c", "a", "", "é"]
    assert rows(references.dictionary(spark.createDataFrame([(w,) for w in words], "w string"), "w")) == [("", 0), ("a", 1), ("b", 2), ("c", 3), ("é", 4)]


# --- profile ---------------------------------------------------------------------------------------


def profiled(spark, data, schema="k int, load_no int, n double, t string"):
    df = spark.createDataFrame(data, schema)
    return profile.Profiled("tab", df, "k", "load_no", ("n",), ("t",), {"n": profile.whole_number("n", 1, 100), "t": profile.matches("t", "[0-9]{2}")})


def test_rules_and_broken_values(spark):
    nan, inf = float("nan"), float("inf")
    good, bad = [1.0, 100.0, 7.0], [0.0, 101.0, 1.5, nan, inf, -inf, -3.0]
    texts_bad = ["1", "123", "1a", " 12", "12\n", "", "１２"]
    data = [(i, 1, v, "12") for i, v in enumerate([*good, *bad, None])] + [(100 + i, 1, None, t) for i, t in enumerate([*texts_bad, "07", None])]
    p = profiled(spark, data + data[:4])
    got = rows(profile.broken_values(p))
    assert got == sorted([("tab", "n", str(i + 3)) for i in range(len(bad))] + [("tab", "t", str(100 + i)) for i in range(len(texts_bad))], key=repr)
    c = {r["in_field"]: r for r in profile.column_profile(p).collect()}
    assert (c["n"]["n_null"], c["n"]["n_broken"], c["n"]["low"], c["n"]["high"]) == (10, 8, -3.0, 101.0)
    assert (c["t"]["n_broken"], c["t"]["low"], c["t"]["high"], c["k"]["n_distinct"]) == (7, 0.0, 3.0, 20)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 999, 1000, 20_001])
def test_exact_medians(spark, n):
    r = np.random.default_rng(n)
    values = np.round(r.lognormal(3, 2, n), 1)
    df = spark.createDataFrame([(1, float(v)) for v in values] + [(2, 5.0)] * 4, "load_no int, v double").groupBy("load_no", "v").agg(F.count("*").alias("k"))
    got = {x["load_no"]: x["median"] for x in profile._exact_medians(df).collect()}
    assert got[1] == pytest.approx(float(np.median(values))) and got[2] == 5.0


def test_shifted_loads(spark):
    r = np.random.default_rng(0)
    data = []
    for load in range(1, 6):
        for i in range(2000):
            n = float(r.integers(40, 50)) if load == 3 else float(r.integers(10, 20))
            n = None if load == 5 and r.random() < 0.3 else n
            t = "77" if load == 4 and r.random() < 0.6 else f"{r.integers(10, 60)}"
            data.append((load * 10_000 + i, load, n, t))
    p = profiled(spark, data)
    assert rows(profile.shifted_loads([p])) == [("tab", "n", 3), ("tab", "n", 4), ("tab", "n", 5), ("tab", "t", 4), ("tab", "t", 5)]
    d = {(x["in_field"], x["load_no"]): x for x in profile.load_discrimination([p]).collect()}
    assert d["n", 3]["auc"] > 0.95 and d["n", 3]["auc_alone"] > 0.95 and d["n", 3]["auc_without"] < 0.6
    assert 0.45 < d["n", 2]["auc"] < 0.55 and d["t", 4]["auc_alone"] > 0.7


def test_shifts_that_codes_cannot_show_in_large_loads(spark):
    n = 60_000
    same: dict[int, list[str]] = {}
    for x in spark.range(10, 100).selectExpr("string(id) AS v", "pmod(xxhash64(string(id)), 16) AS c").collect():
        same.setdefault(x["c"], []).append(x["v"])
    one, other = max(same.values(), key=len)[:2]
    i, load = F.col("id") % n, F.floor(F.col("id") / n + 1).cast("int")
    # in load 2 half of the most frequent value's rows take another value of its class, and the median crosses a gap
    t = F.when(i % 10 >= 6, "99x").when((load == 2) & (i % 2 == 0), other).otherwise(one)
    v = F.when(i < F.when(load == 2, n // 2 - 20).otherwise(n // 2 + 20), 10.0).otherwise(30.0)
    df = spark.range(2 * n).select(F.col("id").cast("int").alias("k"), load.alias("load_no"), v.alias("n"), t.alias("t"))
    p = profile.Profiled("tab", df, "k", "load_no", ("n",), ("t",), {"n": profile.whole_number("n", 1, 100), "t": profile.matches("t", "[0-9]{2}")})
    assert rows(profile.shifted_loads([p])) == [("tab", "n", 2)]
    p = profile.Profiled("tab", df.where("t <> '99x'"), *("k", "load_no", ("n",), ("t",)), p.valid)
    assert ("tab", "t", 2) in rows(profile.shifted_loads([p]))
    (got,) = [x for x in profile.load_discrimination([p]).collect() if x["in_field"] == "t"]
    assert got["in_reach"]


def test_loads_alike_are_not_suspected(spark):
    r = np.random.default_rng(5)
    for n in (60, 3000):
        p = profiled(spark, [(i, 1 + i // n, float(r.integers(10, 20)), f"{r.integers(10, 14)}") for i in range(6 * n)])
        got = profile.load_discrimination([p]).collect()
        assert len(got) == 10 and sum(x["suspected"] for x in got) <= 1 and sum(x["in_reach"] for x in got) <= 2, got


def test_ablation_refits(spark):
    """Of two columns that say the same either can be left out at little loss, though both shift."""
    r = np.random.default_rng(6)
    data = []
    for i in range(4000):
        n = float(r.integers(10, 20) + 6 * (i >= 2000))
        data.append((i, 1 + i // 2000, n, str(int(n))))
    d = {x["in_field"]: x for x in profile.load_discrimination([profiled(spark, data)]).collect()}
    for x in d.values():
        assert x["suspected"] and x["auc_alone"] > 0.8 and x["auc"] - x["auc_without"] < 0.1


def test_octave_ranges_hold_their_values(spark):
    r = np.random.default_rng(7)
    values = [0.0, 1e-9, 1.0, 2.0, 3.0, 1e6, 2.0**40, *np.exp(r.uniform(-5, 14, 300)).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "n double")
    for x in df.select("n", profile._octave(F.col("n")).alias("c")).collect():
        low, high = profile._octave_bounds(x["c"])
        assert low <= x["n"] <= high and x["c"] < profile.OCTAVES + 4


def test_every_column_is_told_apart(spark, sf):
    from catalogue.general import p4_discrimination

    got = {(x["in_table"], x["in_field"]) for x in p4_discrimination(spark, sf).select("in_table", "in_field").distinct().collect()}
    tables = {"fact_stock_snapshot": "stock_id", "dim_entity": "entity_id", "dim_material": "material_id"}
    want = {(t, c) for t, key in tables.items() for c in spark.read.parquet(f"{sf}/{t}.parquet").columns if c not in (key, "load_no")}
    assert got == want and len(want) > 40
    rows_ = [(i, 1 + i // 1000, date(2024, 1, 1) + timedelta(i % 50 + 40 * (i >= 1000)), datetime(2024, 1, 1) + timedelta(hours=i % 90), i % 7 if i < 1000 else 90 + i % 7) for i in range(2000)]
    p = profile.Profiled.every_column("tab", spark.createDataFrame(rows_, "k int, load_no int, day date, at timestamp_ntz, ref_id int"), "k", "load_no")
    assert p.numbers == ("day", "at") and p.texts == ("ref_id",)
    d = {x["in_field"]: x["auc_alone"] for x in profile.load_discrimination([p]).collect()}
    assert d["day"] > 0.9 and d["ref_id"] > 0.7 and d["at"] < 0.6


def test_profile_of_few_rows_or_loads(spark):
    assert profile.load_discrimination([profiled(spark, [(1, 1, 5.0, "12")])]).count() == 0
    empty = profiled(spark, [])
    assert profile.shifted_loads([empty]).count() == 0 and profile.column_profile(empty).count() == 0 and profile.broken_values(empty).count() == 0
    two = profiled(spark, [(1, 1, 5.0, "12"), (2, 2, None, None), (3, None, 5.0, "12")])
    assert rows(profile.shifted_loads([two])) == [("tab", "n", 2), ("tab", "t", 2)]


# --- history ---------------------------------------------------------------------------------------


def plain_versions(data):
    best = {}
    for k, t, s, d, rec in data:
        if k is not None and d is not None:
            order = (rec is not None, rec, (t is not None, t or ""), (s is not None, s or 0))
            if (k, d) not in best or order > best[k, d][0]:
                best[k, d] = (order, (t, s))
    out = []
    for k in {k for k, _ in best}:
        starts = []
        for d in sorted(d for kk, d in best if kk == k):
            if not starts or starts[-1][1] != best[k, d][1]:
                starts.append((d, best[k, d][1]))
        for i, (d, v) in enumerate(starts):
            out.append((k, d, starts[i + 1][0] - timedelta(days=1) if i + 1 < len(starts) else None, i + 1, len(starts), *v))
    return sorted(out, key=repr)


@pytest.mark.parametrize("every", [1, 3, 8])
def test_history_against_plain_version(spark, every):
    r = random.Random(every)
    data = [(r.choice([None, 1, 1, 2, 3]), r.choice([None, "a", "b"]), r.choice([None, 0, 1]), day(r.choice([None, *range(40)])), ts(r.choice([None, *range(30)]))) for _ in range(300)]
    df = spark.createDataFrame(data + data[:40], "seq int, valid_from string, s int, d date, received timestamp_ntz").withColumnsRenamed({"seq": "key", "valid_from": "kind"})
    h = history.store(df, "key", ["kind", "s"], "d", "received", every)
    assert rows(history.reconstruct(h)) == plain_versions(data)
    assert h.checkpoints.count() + h.patches.count() == len(plain_versions(data))


def test_history_all_null_and_as_of(spark):
    df = spark.createDataFrame([(1, None, day(0), ts(0)), (1, "x", day(5), ts(1)), (1, "x", day(6), ts(2)), (1, None, day(9), ts(3))], "k int, a string, d date, r timestamp_ntz")
    h = history.store(df, "k", ["a"], "d", "r")
    assert [r["a"] for r in history.reconstruct(h).orderBy("valid_from").collect()] == [None, "x", None]
    assert rows(history.as_of(h, F.lit(day(7))).select("a", "valid_to")) == [("x", day(8))]
    assert history.as_of(h, F.lit(day(-1))).count() == 0
    assert history.reconstruct(history.store(df.where("false"), "k", ["a"], "d", "r")).count() == 0


@pytest.mark.parametrize("every", [1, 3])
def test_history_grows_by_deliveries(spark, tmp_path, every):
    r = random.Random(every)
    states = lambda days, got: [(r.choice([1, 2, 3, 4]), r.choice([None, "a", "b"]), r.choice([None, 0, 1]), day(r.choice(days)), ts(got)) for _ in range(30)]
    schema = "key int, kind string, s int, d date, received timestamp_ntz"
    first, later, late = states(range(20), 1), states(range(30, 50), 2) + [(9, "a", 1, day(33), ts(2))], states(range(5, 60), 3)[:6]
    late = [x for x in late if x[0] != 4] + [(4, "z", 1, day(70), ts(3))]
    h = history.save(history.store(spark.createDataFrame(first, schema), "key", ["kind", "s"], "d", "received", every), f"{tmp_path}/h0")
    data = list(first)
    for n, more in enumerate((later, late), 1):
        before = {name: set(rows(getattr(h, name).drop("year"))) for name in ("checkpoints", "patches")}
        h = history.save(history.extend(h, spark.createDataFrame(more, schema), "d", "received"), f"{tmp_path}/h{n}")
        data += more
        assert rows(history.reconstruct(h)) == plain_versions(data)
        if n == 1:  # every key only goes on: what was stored stays
            assert all(before[name] <= set(rows(getattr(h, name).drop("year"))) for name in before)
    for d in (-1, 7, 33, 200):
        want = sorted([(x[0], x[1], *x[5:]) for x in plain_versions(data) if x[1] <= day(d) and (x[2] is None or x[2] >= day(d))], key=repr)
        assert rows(history.as_of(h, day(d), ends=False)) == want
        assert rows(history.as_of(h, day(d)).drop("valid_to")) == want


# --- snapshot changes ------------------------------------------------------------------------------


def plain_changes(data):
    nan = lambda v: "nan" if v is not None and v != v else v
    best = {}
    for d, k, q, a, u in data:
        if d is not None and k is not None:
            order = (u is not None, u or 0)
            if (d, k) not in best or order > best[d, k][0]:
                best[d, k] = (order, (nan(q), nan(a)))
    days = sorted({d for d, _ in best})
    out = []
    for before, now in zip(days, days[1:]):
        old, new = ({k: v[1] for (d, k), v in best.items() if d == x} for x in (before, now))
        out += [(now, k, "added") for k in new.keys() - old.keys()] + [(now, k, "removed") for k in old.keys() - new.keys()]
        out += [(now, k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]]
    return sorted(out, key=repr)


SNAPSHOT = "snap date, id long, q double, a double, u long"


@pytest.mark.parametrize("cells,bucket", [(384, 512), (6, 64), (3, 4000)])
def test_changes_against_plain_version(spark, cells, bucket):
    r = random.Random(cells)
    value = lambda: r.choice([None, float("nan"), 0.0, -0.0, 1.0, 2.5, float("inf")])
    data, n = [], 0
    for d in (0, 30, 61, 92):
        for k in r.sample(range(-50, 250), 200):
            n += 1
            data.append((day(d), k, value(), value(), n))
            if r.random() < 0.1:
                n += 1
                data.append((day(d), k, value(), value(), r.choice([n, -n])))
    data += [(None, 1, 1.0, 1.0, 1), (day(0), None, 1.0, 1.0, 1)] + data[:30]
    r.shuffle(data)
    df = spark.createDataFrame(data, SNAPSHOT).withColumn("bucket", F.lit(1)).withColumn("day", F.lit("x"))
    assert rows(snapshot_diff.snapshot_changes(df, "id", "snap", "u", ["q", "a"], bucket, cells)) == plain_changes(data)


def test_changes_of_one_delivery_or_none(spark):
    df = spark.createDataFrame([(day(0), 1, 1.0, None, 1)], SNAPSHOT)
    for x in (df, df.where("false")):
        got = snapshot_diff.snapshot_changes(x, "id", "snap", "u", ["q", "a"])
        assert got.count() == 0 and got.columns == ["snap", "id", "how_changed"]


def test_nulls_in_different_columns_differ(spark):
    df = spark.createDataFrame([(day(0), 1, None, 5.0, 1), (day(1), 1, 5.0, None, 1), (day(2), 1, 5.0, None, 9)], SNAPSHOT)
    assert rows(snapshot_diff.snapshot_changes(df, "id", "snap", "u", ["q", "a"])) == [(day(1), 1, "changed")]


def test_a_key_delivered_over_and_over_stays_small():
    import pyarrow as pa

    n = 10_000
    batch = pa.RecordBatch.from_pydict({"no": [0] * n, "key": [7] * n, "updated": [None, *range(n - 1)], "digest": [1] * n})
    (out,) = snapshot_diff._fresh([batch])
    assert out.column("updated").to_pylist() == [None, n - 2]
    batch = pa.RecordBatch.from_pydict({"no": [0] * 4 + [1], "key": [7] * 5, "updated": [5, 5, 5, 4, 4], "digest": [1, 2, 1, 9, 9]})
    (out,) = snapshot_diff._fresh([batch])
    assert list(zip(*(out.column(c).to_pylist() for c in ("no", "updated")))) == [(0, 5), (0, 5), (1, 4)] and out.schema.names == ["no", "key", "updated"]


def test_kept_tables_give_the_same_changes(spark):
    old = spark.createDataFrame([(i, i, float(i)) for i in range(400)], "id int, u int, q double")
    new = spark.createDataFrame([(i, i, float(i + (i % 9 == 0))) for i in range(5, 410)], "id int, u int, q double")
    a, b = (snapshot_diff.delivery_tables(x, "id", "u", ["q"], buckets=4).cache() for x in (old, new))
    changes, failed = snapshot_diff.changes_of_tables(a, b)
    want = [(i, "removed") for i in range(5)] + [(i, "changed") for i in range(9, 400, 9)] + [(i, "added") for i in range(400, 410)]
    assert rows(changes) == sorted(want, key=repr) and failed.count() == 0
    small = [snapshot_diff.delivery_tables(x, "id", "u", ["q"], 4, cells=9) for x in (old, new)]
    assert snapshot_diff.changes_of_tables(*small, cells=9)[1].count() == 4
    assert rows(snapshot_diff.changes_between(*small, old, new, "id", "u", ["q"], 4, cells=9)) == sorted(want, key=repr)


def test_many_buckets_with_one_change_each_stay_small(spark):
    """A task that peels far more buckets than cells are filled holds a bounded number of tables."""
    import tracemalloc

    n = 60_000
    key = np.arange(n, dtype=np.uint64)
    check = snapshot_diff.check_hash(key, key)
    cell = snapshot_diff.cells_of(check, snapshot_diff.CELLS)
    pdf = {"bucket": np.repeat(np.arange(n), 3), "pair": np.ones(3 * n, np.int64), "cell": cell.T.ravel(), "n": np.ones(3 * n, np.int64)}
    pdf |= {c: np.repeat(v, 3).view(np.int64) for c, v in (("key", key), ("digest", key), ("check", check))}

    class Plan:
        """Stands for the sorted plan that the function is mapped over."""

        def sortWithinPartitions(self, *_):
            return self

        def mapInPandas(self, work, _):
            import pandas as pd

            whole = pd.DataFrame(pdf)
            return list(work(whole.iloc[i : i + 10_000] for i in range(0, 3 * n, 10_000)))

    tracemalloc.start()
    out = snapshot_diff._peeled(Plan(), snapshot_diff.CELLS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(x) for x in out) == n and all((x["sign"] == 1).all() for x in out) and peak < 150e6


def test_hash_equals_the_one_of_spark(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "a long, b long").selectExpr("a", "b", "xxhash64(a, b) AS h").toPandas()
    assert (snapshot_diff.check_hash(df["a"].to_numpy().view(np.uint64), df["b"].to_numpy().view(np.uint64)).view(np.int64) == df["h"].to_numpy()).all()
