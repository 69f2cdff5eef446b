"""Column-level quality profile of tables that come in loads.

Base aggregates are exact: rows, nulls, broken values, distinct values, ranges, the median of valid
values and the most frequent value per load. Whether a load differs from the one before is asked of a
classifier two-sample test: logistic regressions try to tell the two loads apart from the codes of
their columns (null, broken, range or class of the value). They are cross-fitted on two folds, so a
column that carries no difference discriminates no better than chance. Ablation refits the regression
without each column in turn; what is lost is the column's own part, and what it tells alone its whole.
A column is suspected if either exceeds chance by three standard errors.

Regressions are fitted on a bounded sample of labelled rows (``FIT_ROWS`` of each load and fold), one
task per pair of loads and fold; codes, counts and scores cover all rows. The driver holds counts per
code and histograms of scores: their number depends on columns and loads, not on rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from lumbung import functions as fn
from lumbung.session import Scratch, cut

#: Quantile ranges of numbers, hash classes of texts, bins of scores.
RANGES, CLASSES, BINS = 8, 16, 256
#: Rows of each load and fold that regressions are fitted on, about; steps of a fit at most, and the
#: step of a coefficient that ends it.
FIT_ROWS, STEPS, CONVERGED = 4_000, 100, 0.002
#: Standard errors above chance that make a suspicion.
SIGMAS = 3
#: Ranges of numbers with a rule: quarters of an octave from 2 ** (LOWEST / 4), so that two medians in
#: the same range are never apart by a reportable factor.
OCTAVE_PARTS, LOWEST, OCTAVES = 4, -40, 150


@dataclass(frozen=True)
class Profiled:
    """A table in loads. ``valid`` gives the rule of a column, true for values that are allowed.

    ``numbers`` and ``texts`` are the columns the classifier sees.
    """

    table: str
    rows: DataFrame
    key: str
    load: str
    numbers: tuple[str, ...]
    texts: tuple[str, ...]
    valid: Mapping[str, Column] = field(default_factory=dict)

    @classmethod
    def every_column(cls, table: str, rows: DataFrame, key: str, load: str, valid: Mapping[str, Column] | None = None) -> Profiled:
        """All columns but the key and the load: numbers, dates and times as numbers, ids (``_id``) and the rest as texts."""
        fields = [f for f in rows.schema.fields if f.name not in (key, load)]
        numbers = tuple(f.name for f in fields if isinstance(f.dataType, (NumericType, DateType, TimestampType, TimestampNTZType)) and not f.name.endswith("_id"))
        return cls(table, rows, key, load, numbers, tuple(f.name for f in fields if f.name not in numbers), valid or {})

    def number(self, c: str) -> Column:
        """The value of one of ``numbers``: days since 1970 of a date, seconds of a time."""
        kind, v = self.rows.schema[c].dataType, F.col(f"`{c}`")
        if isinstance(kind, DateType):
            v = F.unix_date(v)
        elif isinstance(kind, (TimestampType, TimestampNTZType)):
            v = F.unix_seconds(v.cast("timestamp"))
        return v.cast("double")

    def is_valid(self, c: str) -> Column:
        rule = self.valid.get(c)
        if rule is None:
            rule = fn.is_finite(self.number(c)) if c in self.numbers else F.col(f"`{c}`").isNotNull()
        return F.coalesce(rule, F.lit(False))


def whole_number(c: str, low: float, high: float) -> Column:
    v = F.col(c)
    return in_range(c, low, high) & (F.floor(F.when(in_range(c, low, high), v)) == v)


def in_range(c: str, low: float, high: float) -> Column:
    return fn.is_finite(c) & F.col(c).between(low, high)


def matches(c: str, pattern: str) -> Column:
    """The whole value matches, line ends included."""
    return F.col(c).rlike(rf"\A(?:{pattern})\z")


def _plain(c: Column, kind) -> Column:
    """A value as text for counting, so that columns of all types share a plan; equal values give equal texts."""
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("string")
    if isinstance(kind, NumericType):
        return F.when(c == 0, F.lit("0")).otherwise(c.cast("string"))
    return c.cast("string")


def column_profile(p: Profiled) -> DataFrame:
    """``in_table, in_field, load_no, n_rows, n_null, n_broken, n_distinct, low, high`` of every column and load.

    ``n_broken`` counts non-null values that break the column's rule (NaN and infinite values where
    it has none). ``low`` and ``high`` are the least and greatest finite value, days since 1970 of a
    date, seconds of a time, the length of a text. ``n_distinct`` counts the different non-null values
    exactly (NaN is one, -0.0 is 0.0): each task sends a value of a load once. Columns of types that
    have no text get null there. An empty table gives no row.
    """
    aggs, packed, values = [F.count("*").alias("n")], [], []
    for i, f in enumerate(p.rows.schema.fields):
        if f.name == p.load:
            continue
        c = F.col(f"`{f.name}`")
        broken = F.lit(False)
        if isinstance(f.dataType, NumericType):
            size, broken = F.when(fn.is_finite(c.cast("double")), c.cast("double")), ~fn.is_finite(c.cast("double"))
        elif isinstance(f.dataType, StringType):
            size = F.char_length(c).cast("double")
        elif isinstance(f.dataType, DateType):
            size = F.unix_date(c).cast("double")
        elif isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            size = F.unix_seconds(c.cast("timestamp")).cast("double")
        else:
            size = F.lit(None).cast("double")
        if f.name in p.valid:
            broken = ~p.is_valid(f.name)
        if isinstance(f.dataType, (NumericType, StringType, DateType, TimestampType, TimestampNTZType, BooleanType)):
            values.append(F.struct(F.lit(f.name).alias("in_field"), _plain(c, f.dataType).alias("v")))
        aggs += [F.count_if(c.isNull()).alias(f"a{i}"), F.count_if(c.isNotNull() & broken).alias(f"b{i}"), F.min(size).alias(f"l{i}"), F.max(size).alias(f"h{i}")]
        names = {"a": "n_null", "b": "n_broken", "l": "low", "h": "high"}
        packed.append(F.struct(F.lit(f.name).alias("in_field"), *(F.col(f"{k}{i}").alias(v) for k, v in names.items())))
    load = F.col(f"`{p.load}`").alias("load_no")
    per_load = p.rows.groupBy(load).agg(*aggs).select("load_no", F.col("n").alias("n_rows"), F.explode(F.array(*packed)).alias("x")).select("load_no", "n_rows", "x.*")
    different = p.rows.select(load, F.explode(F.array(*values)).alias("x")).select("load_no", "x.*").distinct()
    n_distinct = different.groupBy("load_no", "in_field").agg(F.count("v").alias("n_distinct"))
    both = per_load.alias("a").join(n_distinct.alias("b"), F.col("a.load_no").eqNullSafe(F.col("b.load_no")) & (F.col("a.in_field") == F.col("b.in_field")), "left")
    return both.select(F.lit(p.table).alias("in_table"), "a.in_field", "a.load_no", "n_rows", "n_null", "n_broken", "n_distinct", "low", "high")


def broken_values(p: Profiled) -> DataFrame:
    """``in_table, in_field, case_key`` (distinct) of the non-null values that break their column's rule."""
    parts = [F.when(F.col(f"`{c}`").isNotNull() & ~p.is_valid(c), F.lit(c)) for c in p.valid]
    rows = p.rows.select(F.col(f"`{p.key}`").cast("string").alias("case_key"), F.explode(F.array_compact(F.array(*parts))).alias("in_field"))
    return rows.select(F.lit(p.table).alias("in_table"), "in_field", "case_key").distinct()


def _exact_medians(counted: DataFrame) -> DataFrame:
    """``load_no, median`` of ``load_no, v, k`` (``k`` rows have the value ``v``): the mean of the middle two.

    Values are range-partitioned by load and value; the sizes of the ranges tell which of them hold the
    middle, and only those are ranked. No task sees more than a range.
    """
    ranged = cut(counted.where("load_no IS NOT NULL").repartitionByRange("load_no", "v").select("load_no", "v", "k", F.spark_partition_id().alias("part")))
    sizes = ranged.groupBy("load_no", "part").agg(F.sum("k").alias("size"))
    loads = Window.partitionBy("load_no")
    before = F.sum("size").over(loads.orderBy("part")) - F.col("size")
    placed = sizes.select("load_no", "part", before.alias("before"), "size", F.sum("size").over(loads).alias("n"))
    middle = placed.withColumns({"lower": F.floor((F.col("n") + 1) / 2), "upper": F.floor(F.col("n") / 2) + 1}).where("before < upper AND before + size >= lower").drop("size", "n")
    upto = F.col("before") + F.sum("k").over(Window.partitionBy("load_no", "part").orderBy("v"))
    ranked = ranged.join(F.broadcast(middle), ["load_no", "part"]).withColumn("upto", upto)
    holds = lambda r: (F.col("upto") >= F.col(r)) & (F.col("upto") - F.col("k") < F.col(r))
    found = ranked.groupBy("load_no").agg(F.max(F.when(holds("lower"), F.col("v"))).alias("a"), F.max(F.when(holds("upper"), F.col("v"))).alias("b"))
    return found.select("load_no", ((F.col("a") + F.col("b")) / 2).alias("median"))


def load_statistics(p: Profiled) -> DataFrame:
    """Exact ``in_table, in_field, load_no, n_rows, n_null, n_distinct, median, top_count`` of the columns with a rule.

    ``n_distinct`` counts the different non-null values (NaN is one). ``median`` is that of the valid
    values of a number; ``top_count`` the rows of the most frequent non-null value of a text. All come
    from the rows per load and value, which every task counts before they are shuffled.
    """
    load = F.col(f"`{p.load}`").alias("load_no")
    out = []
    for c in p.valid:
        v = F.col(f"`{c}`")
        counted = p.rows.groupBy(load, v).agg(F.count("*").alias("k"))
        base = counted.groupBy("load_no").agg(F.sum("k").alias("n_rows"), F.coalesce(F.sum(F.when(v.isNull(), F.col("k"))), F.lit(0)).alias("n_null"), F.count(v).alias("n_distinct"), F.max(F.when(v.isNotNull(), F.col("k"))).alias("top_count"))
        if c in p.numbers:
            medians = _exact_medians(counted.where(p.is_valid(c)).select("load_no", v.cast("double").alias("v"), "k"))
            base = base.join(medians, "load_no", "left").withColumn("top_count", F.lit(None).cast("long"))
        else:
            base = base.withColumn("median", F.lit(None).cast("double"))
        out.append(base.select(F.lit(p.table).alias("in_table"), F.lit(c).alias("in_field"), "load_no", "n_rows", "n_null", "n_distinct", "median", "top_count"))
    return reduce(DataFrame.unionByName, out)


# --- classifier two-sample test ------------------------------------------------------------------


@dataclass(frozen=True)
class _Coded:
    """A table's columns with the widths of their codes, its loads, and where these lie among all loads."""

    p: Profiled
    columns: tuple[str, ...]
    widths: tuple[int, ...]
    loads: tuple
    first_group: int

    def shares(self, counts: np.ndarray, g: int, j: int) -> np.ndarray:
        """Rows of a load by the code of a column, both folds together."""
        return counts[g, :, j, : self.widths[j]].sum(axis=0)


#: Codes of nulls and of values that break the rule; the rest follow.
_NULL, _BROKEN = 0, 1


def _octave_bounds(code: int) -> tuple[float, float]:
    """Least and greatest value of the range of a number with a rule."""
    at = code - 3
    if at < 0:
        return (0.0, 0.0) if code == 2 else (-math.inf, math.inf)
    if at in (0, OCTAVES):
        return (-math.inf, 2.0 ** (LOWEST / OCTAVE_PARTS)) if at == 0 else (2.0 ** ((LOWEST + OCTAVES - 1) / OCTAVE_PARTS), math.inf)
    low = LOWEST + at - 1
    return 2.0 ** (low / OCTAVE_PARTS) * (1 - 1e-9), 2.0 ** ((low + 1) / OCTAVE_PARTS) * (1 + 1e-9)


def _octave(x: Column) -> Column:
    """The code of a number that obeys its rule."""
    quarters = F.log2(F.when(x > 0, x)) * OCTAVE_PARTS - (LOWEST - 1)
    place = F.floor(F.least(F.greatest(quarters, F.lit(0.0)), F.lit(float(OCTAVES)))).cast("int")
    return F.when(x == 0, 2).otherwise(F.coalesce(place, F.lit(0)) + 3)


def _encoder(columns: Sequence[tuple[int, Sequence[float] | None]], words: int):
    """Codes of a batch's columns, a byte each, in words of eight.

    ``columns`` are their places with the edges of number ranges, None where the column is a code already.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, 8 * words), np.uint8)
            for j, edges in columns:
                column = batch.column(f"c{j}")
                x = column.to_numpy(zero_copy_only=False)
                if edges is None:
                    out[:, j] = x
                else:
                    out[:, j] = np.where(np.isfinite(x), 2 + np.searchsorted(edges, x, "left"), _BROKEN)
                    if column.null_count:
                        out[column.is_null().to_numpy(zero_copy_only=False), j] = _NULL
            packed = out.view("<i8")
            names = ["grp", "fold", "u"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(packed[:, w]) for w in range(words))], names=[*names, *(f"w{w}" for w in range(words))])

    return encode


def _classed(v: Column, ok: Column, own: Sequence[str]) -> Column:
    """The code of a text: values of their own, broken or not, come before hash classes."""
    code = F.when(v.isNull(), _NULL)
    for i, top in enumerate(own):
        code = code.when(v == top, 2 + CLASSES + i)
    return code.when(~ok, _BROKEN).otherwise(F.lit(2) + F.pmod(F.xxhash64(v), F.lit(CLASSES)))


def _frequent(p: Profiled, c: str) -> list[str]:
    """The most frequent value of each load of a text with a rule, a handful, as loads are; none if they are more than codes are left."""
    counted = p.rows.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{p.load}`").alias("load_no"), F.col(f"`{c}`").alias("v")).agg(F.count("*").alias("k"))
    found = counted.groupBy("load_no").agg(F.max_by("v", F.struct("k", "v")).alias("v")).select("v").distinct().collect()
    return sorted(r["v"] for r in found) if len(found) <= 256 - 2 - CLASSES else []


def _each(f: Callable, tables: Sequence[Profiled]) -> list:
    """``f`` of every table; the small jobs of one run beside those of another."""
    with ThreadPoolExecutor(max(1, len(tables))) as pool:
        return list(pool.map(f, tables))


def _looked_over(p: Profiled) -> tuple:
    """What coding a table needs: its columns, their values under names of their own, validity, places with ranges, quantiles and loads, and frequent values."""
    columns = (*p.numbers, *p.texts)
    marks = [i / RANGES for i in range(1, RANGES)]
    # values are made once; what reads them several times stands above
    values = [p.number(c) if c in p.numbers else F.col(f"`{c}`") for c in columns]
    plain = p.rows.select(
        F.col(f"`{p.load}`").alias("load"), F.xxhash64(F.col(f"`{p.key}`"), *(F.col(f"`{c}`") for c in columns)).alias("h"),
        *(v.alias(f"c{j}") for j, v in enumerate(values)), *(p.is_valid(c).alias(f"ok{j}") for j, c in enumerate(columns) if c in p.valid),
    )
    ok = [F.col(f"ok{j}") if c in p.valid else fn.is_finite(f"c{j}") if c in p.numbers else F.lit(True) for j, c in enumerate(columns)]
    ranged = [j for j, c in enumerate(columns) if c in p.numbers and c not in p.valid]
    found = plain.agg(F.collect_set("load").alias("loads"), *(F.percentile_approx(F.when(ok[j], F.col(f"c{j}")), marks, 100).alias(f"q{j}") for j in ranged)).first()
    return columns, plain, ok, ranged, found, {c: _frequent(p, c) for c in p.texts if c in p.valid}


def _coded(tables: Sequence[Profiled]) -> tuple[list[_Coded], DataFrame]:
    """Rows ``grp, fold, u, w0, w1…`` of all tables: the load, the fold, a number drawn by hash, and the codes, a byte each, in words of eight."""
    layout, parts, group = [], [], 0
    words = -(-max(len(p.numbers) + len(p.texts) for p in tables) // 8)
    for p, (columns, plain, ok, ranged, found, own) in zip(tables, _each(_looked_over, tables)):
        loads = tuple(sorted(found["loads"]))
        widths, coded, edges = [], [], []
        for j, c in enumerate(columns):
            v = F.col(f"c{j}")
            if c not in p.numbers:
                widths.append(CLASSES + 2 + len(own.get(c, ())))
                coded.append(_classed(v, ok[j], own.get(c, ())).cast("int"))
            elif c in p.valid:
                widths.append(OCTAVES + 4)
                coded.append(F.when(v.isNull(), _NULL).when(~ok[j], _BROKEN).otherwise(_octave(v)))
            else:
                widths.append(RANGES + 2)
                coded.append(v)
            edges.append(np.unique(found[f"q{j}"] or []) if j in ranged else None)
        layout.append(_Coded(p, columns, tuple(widths), loads, group))
        number = F.create_map(*(x for i, v in enumerate(loads) for x in (F.lit(v), F.lit(group + i)))) if loads else F.lit(None).cast("map<int,int>")
        rows = plain.where("load IS NOT NULL").select(F.element_at(number, F.col("load")).alias("grp"), F.pmod("h", F.lit(2)).cast("int").alias("fold"), F.shiftrightunsigned("h", 40).cast("int").alias("u"), *(x.alias(f"c{j}") for j, x in enumerate(coded)))
        # so many comparisons would make a method too long for the JVM to compile; numpy searches the edges
        parts.append(rows.mapInArrow(_encoder(list(enumerate(edges)), words), "grp int, fold int, u int, " + ", ".join(f"w{w} long" for w in range(words))))
        group += len(loads)
    return layout, reduce(DataFrame.unionByName, parts)


def _widths(layout: Sequence[_Coded]) -> dict[int, tuple[int, ...]]:
    """The widths of the codes of each load's table."""
    return {g: at.widths for at in layout for g in range(at.first_group, at.first_group + len(at.loads))}


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    """The codes of a batch of rows, a row each; places beyond a table's columns are 0."""
    words = [batch.column(i).to_numpy() for i, name in enumerate(batch.schema.names) if name[0] == "w"]
    return np.stack(words, axis=1).astype("<i8").view(np.uint8).reshape(batch.num_rows, -1)


def _sums(names: Sequence[str], totals: Mapping[tuple[int, ...], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The nonzero entries of arrays by key, as rows of the key, the place and the value."""
    for key, values in totals.items():
        flat = values.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(at), k, np.int32)) for k in key), pa.array(at.astype(np.int32)), pa.array(flat[at].astype(np.int64))], names=list(names))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(load, fold, codes) of the rows of a batch."""
    if not batch.num_rows:
        return
    codes = _codes(batch)
    kind = batch.column("grp").to_numpy().astype(np.int64) * 2 + batch.column("fold").to_numpy()
    for k in np.unique(kind).tolist():
        yield k // 2, k % 2, codes[kind == k]


def _gathered(parts: DataFrame, value: str) -> list[np.ndarray]:
    """The keys of partial sums, and the sums, as arrays on the driver; their number is bounded by columns and loads."""
    keys = [c for c in parts.columns if c != value]
    table = parts.groupBy(*keys).agg(F.sum(value).alias(value)).toArrow()
    return [table.column(c).to_numpy() for c in (*keys, value)]


def _counted(rows: DataFrame, layout: Sequence[_Coded]) -> np.ndarray:
    """Rows by load, fold, column and code."""
    n_columns = max(len(at.columns) for at in layout)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, ...], np.ndarray] = {}
        for batch in batches:
            for grp, fold, codes in _blocks(batch):
                places = codes[:, :n_columns].astype(np.int64) + 256 * np.arange(n_columns)
                total[grp, fold] = total.get((grp, fold), 0) + np.bincount(places.ravel(), minlength=256 * n_columns)
        yield from _sums(("grp", "fold", "place", "n"), total)

    out = np.zeros((max((at.first_group + len(at.loads) for at in layout), default=0), 2, n_columns * 256), np.int64)
    grp, fold, place, n = _gathered(rows.mapInArrow(count, "grp int, fold int, place int, n long"), "n")
    out[grp, fold, place] = n
    return out.reshape(len(out), 2, n_columns, 256)


def fit(codes: np.ndarray, label: np.ndarray, widths: Sequence[int], steps: int = STEPS) -> np.ndarray:
    """Coefficients [code, model] of the logistic regression on all columns, and on all but one for each column.

    Loads weigh the same. Each row has exactly one code per column, so a quarter of the column count
    times the code's rows bounds the curvature; steps scaled by it always descend, and momentum speeds
    them up. A column that a model leaves out has zeros there.
    """
    n_columns, n_codes = len(widths), int(sum(widths))
    offsets = np.r_[0, np.cumsum(widths)[:-1]].astype(np.int64)
    used, places = np.unique((codes.astype(np.int64) + offsets).ravel(), return_inverse=True)
    x = np.zeros((len(codes), len(used)), np.float32)
    x[np.repeat(np.arange(len(codes)), n_columns), places.ravel()] = 1
    kept = np.ones((len(used), n_columns + 1), np.float32)
    kept[np.arange(len(used)), 1 + np.searchsorted(offsets, used, "right") - 1] = 0
    weight = np.where(label == 1, len(label) / (2 * max(1, (label == 1).sum())), len(label) / (2 * max(1, (label == 0).sum()))).astype(np.float32)[:, None]
    scale = kept * (4 / (n_columns * (x.T @ weight + 1)))
    beta = np.zeros_like(kept)
    ahead, before = beta, beta
    for step in range(steps):
        residual = (label[:, None] - 1 / (1 + np.exp(-(x @ ahead)))) * weight
        change = scale * (x.T @ residual - ahead)  # a row's worth of shrinking keeps rare codes bounded
        beta = ahead + change
        ahead = beta + (step / (step + 3)) * (beta - before)
        before = beta
        if np.abs(change).max() < CONVERGED:
            break
    out = np.zeros((n_codes, n_columns + 1), np.float32)
    out[used] = beta
    return out


def _fitted(rows: DataFrame, layout: Sequence[_Coded], sizes: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Coefficients of the models of each pair of loads that did not see the fold, by (later load, fold)."""
    share = np.minimum(1.0, FIT_ROWS / np.maximum(1, sizes))
    limits = F.create_map(*(x for (g, f), s in np.ndenumerate(share) for x in (F.lit(2 * int(g) + int(f)), F.lit(int(s * (1 << 24))))))
    sample = rows.where(F.col("u") < F.element_at(limits, F.col("grp") * 2 + F.col("fold")))
    widths = _widths(layout)
    pairs = [g for at in layout for g in range(at.first_group + 1, at.first_group + len(at.loads))]
    sides = F.array(*(F.struct((F.col("grp") + (1 - y)).alias("pair"), F.lit(y).alias("label")) for y in (0, 1)))
    both = sample.select("*", F.explode(sides).alias("s")).select("*", "s.*").drop("s", "u", "grp").where(F.col("pair").isin(pairs)).withColumn("held_out", 1 - F.col("fold"))

    def work(key: tuple, table: pa.Table) -> pa.Table:
        pair, held_out = (k.as_py() for k in key)
        codes = np.concatenate([_codes(b) for b in table.to_batches() if b.num_rows])
        beta = fit(codes[:, : len(widths[pair])], table.column("label").to_numpy(), widths[pair])
        return pa.table([pa.array([pair], pa.int32()), pa.array([held_out], pa.int32()), pa.array([beta.tobytes()])], names=["pair", "fold", "beta"])

    fits = both.repartition(2 * len(pairs), "pair", "held_out").groupBy("pair", "held_out").applyInArrow(work, "pair int, fold int, beta binary")
    return {(r["pair"], r["fold"]): np.frombuffer(r["beta"], np.float32).reshape(-1, len(widths[r["pair"]]) + 1) for r in fits.collect()}


def _auc(positive: np.ndarray, negative: np.ndarray) -> float:
    """Area under the ROC curve of two histograms over the same ascending scores; ties count half."""
    n = positive.sum() * negative.sum()
    below = np.cumsum(negative) - negative
    return float((positive * (below + negative / 2)).sum() / n) if n else 0.5


def _alone(counts: np.ndarray, at: _Coded, g: int, j: int) -> float:
    """Cross-fitted discrimination of one column: its saturated regression from one fold, scored on the other."""
    total = []
    for fold in range(2):
        fitted, test = (counts[g - 1 : g + 1, f, j, : at.widths[j]] for f in (1 - fold, fold))
        rate = (fitted + 0.5) / (fitted.sum(axis=1, keepdims=True) + 0.5 * at.widths[j])
        order = np.argsort(np.log(rate[1] / rate[0]), kind="stable")
        total.append(_auc(test[1][order], test[0][order]))
    return float(np.mean(total))


def _scored(rows: DataFrame, layout: Sequence[_Coded], beta: Mapping[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """Histograms [label, model, bin] of held-out scores of all rows per (pair, fold)."""
    widths = _widths(layout)
    sent = rows.sparkSession.sparkContext.broadcast(dict(beta))

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, ...], np.ndarray] = {}
        for batch in batches:
            for grp, fold, codes in _blocks(batch):
                for pair, label in ((grp, 1), (grp + 1, 0)):
                    b = sent.value.get((pair, fold))
                    if b is None:
                        continue
                    score = np.zeros((len(codes), b.shape[1]), np.float32)
                    at = 0
                    for j, width in enumerate(widths[grp]):
                        score += b[at : at + width][codes[:, j]]
                        at += width
                    bins = ((score / (1 + np.abs(score)) + 1) * (BINS / 2)).astype(np.int32)
                    np.minimum(bins, BINS - 1, out=bins)
                    bins += BINS * np.arange(b.shape[1], dtype=np.int32)
                    h = np.bincount(bins.ravel(), minlength=BINS * b.shape[1])
                    total[pair, fold, label] = total.get((pair, fold, label), 0) + h
        yield from _sums(("pair", "fold", "label", "place", "n"), total)

    out = {k: np.zeros((2, b.shape[1] * BINS)) for k, b in beta.items()}
    pair, fold, label, place, n = _gathered(rows.mapInArrow(histogram, "pair int, fold int, label int, place int, n long"), "n")
    for k, h in out.items():
        own = (pair == k[0]) & (fold == k[1])
        h[label[own], place[own]] = n[own]
    return {k: h.reshape(2, -1, BINS) for k, h in out.items()}


def _middle(counts: np.ndarray) -> tuple[float, float] | None:
    """Bounds of the median of a number with a rule, from its rows by range; None without values."""
    values = counts.copy()
    values[: _BROKEN + 1] = 0
    n = int(values.sum())
    if not n:
        return None
    upto = np.cumsum(values)
    low, high = (_octave_bounds(int(np.searchsorted(upto, r))) for r in ((n + 1) // 2, n // 2 + 1))
    return (low[0] + high[0]) / 2, (low[1] + high[1]) / 2


def _in_reach(at: _Coded, counts: np.ndarray, g: int, j: int, null_shift: float, factor: float, top_shift: float) -> bool:
    """Whether the codes of all rows leave it possible that a base aggregate moved by a reportable amount.

    A little slack is given to every bound, so that rounding can't hide a shift.
    """
    old, new = at.shares(counts, g - 1, j), at.shares(counts, g, j)
    gap = np.abs(new / max(1, new.sum()) - old / max(1, old.sum()))
    if gap[_NULL] > null_shift - 1e-9:
        return True
    if at.columns[j] not in at.p.numbers:
        # the most frequent value of each load has a code of its own, if there are codes enough
        own = gap[2 + CLASSES : at.widths[j]]
        return not len(own) or bool(own.max() > top_shift - 1e-9)
    a, b = _middle(old), _middle(new)
    return a is not None and b is not None and (b[1] >= factor * a[0] or b[0] <= a[1] / factor)


SHIFT_SCHEMA = "in_table string, in_field string, load_no long, previous_load long, auc double, auc_without double, auc_alone double, standard_error double, suspected boolean, in_reach boolean"
#: Differences of base aggregates that are reported: share of nulls, factor of the median, share of the most frequent value.
NULL_SHIFT, FACTOR, TOP_SHIFT = 0.10, 2.0, 0.20


def load_discrimination(tables: Sequence[Profiled], null_shift: float = NULL_SHIFT, factor: float = FACTOR, top_shift: float = TOP_SHIFT) -> DataFrame:
    """Per table, column and load but the first: how well the load is told from the next lower one.

    ``auc`` is the discrimination by all columns, ``auc_without`` that of the regression without the
    column, ``auc_alone`` by the column alone. ``suspected`` says that the column tells the loads apart,
    alone or beside the others, by more than ``SIGMAS`` standard errors. For columns with a rule
    ``in_reach`` says whether the codes of all rows leave it possible that the share of nulls, the
    median or the share of the most frequent value moved by a reportable amount, however little the
    loads can be told apart; for others it is null. Rows without a load number count for nothing; a
    table with fewer than two loads gives no row. Loads are listed on the driver; their number is taken
    to be small.
    """
    spark = tables[0].rows.sparkSession
    layout, rows = _coded(tables)
    out = []
    if any(len(at.loads) > 1 for at in layout):
        with Scratch(spark) as scratch:
            rows = scratch.table("codes", rows)
            counts = _counted(rows, layout)
            scores = _scored(rows, layout, _fitted(rows, layout, counts[:, :, 0].sum(axis=2)))
        for at in layout:
            for i in range(1, len(at.loads)):
                g = at.first_group + i
                n0, n1 = (float(counts[x, :, 0].sum()) for x in (g - 1, g))
                error = float(np.sqrt((n0 + n1 + 1) / (12 * n0 * n1)))
                model = lambda m: float(np.mean([_auc(scores[g, f][1, m], scores[g, f][0, m]) for f in range(2) if (g, f) in scores] or [0.5]))  # noqa: B023, E731
                auc = model(0)
                for j, c in enumerate(at.columns):
                    without, alone = model(j + 1), _alone(counts, at, g, j)
                    suspected = max(alone - 0.5, auc - without) > SIGMAS * error
                    reach = _in_reach(at, counts, g, j, null_shift, factor, top_shift) if c in at.p.valid else None
                    out.append((at.p.table, c, int(at.loads[i]), int(at.loads[i - 1]), auc, without, alone, error, bool(suspected), reach))
    return spark.createDataFrame(out, SHIFT_SCHEMA)


def shifted_loads(tables: Sequence[Profiled], null_shift: float = NULL_SHIFT, factor: float = FACTOR, top_shift: float = TOP_SHIFT) -> DataFrame:
    """``in_table, in_field, load_no`` of loads that differ from the next lower one of the table, of the columns with a rule.

    The classifier names the loads and columns: those that it suspects, and those where its codes can't
    rule a reportable shift out. The exact aggregates of these confirm a share of nulls that differs by
    more than ``null_shift``, a median of at least ``factor`` times or at most its inverse (and not
    equal), or a share of the most frequent value that differs by more than ``top_shift``. Rows without
    a load number count for nothing.
    """
    with ThreadPoolExecutor(1) as beside:
        exact = beside.submit(_each, load_statistics, tables)
        named = load_discrimination(tables, null_shift, factor, top_shift).where("in_reach IS NOT NULL AND (suspected OR in_reach)").select("in_table", "in_field", "load_no")
        stats = reduce(DataFrame.unionByName, exact.result()).where(F.col("load_no").isNotNull())
    before = Window.partitionBy("in_table", "in_field").orderBy("load_no")
    both = stats.withColumns({f"old_{c}": F.lag(c).over(before) for c in ("n_rows", "n_null", "median", "top_count")}).where(F.col("old_n_rows").isNotNull())
    share = lambda c, o="": F.coalesce(F.col(f"{o}{c}"), F.lit(0)) / F.col(f"{o}n_rows")
    nulls = F.abs(share("n_null") - share("n_null", "old_")) > null_shift
    top = (F.col("top_count").isNotNull() | F.col("old_top_count").isNotNull()) & (F.abs(share("top_count") - share("top_count", "old_")) > top_shift)
    m, o = F.col("median"), F.col("old_median")
    median = F.coalesce((m != o) & ((m >= factor * o) | (m <= o / factor)), F.lit(False))
    return both.where(nulls | top | median).select("in_table", "in_field", "load_no").join(F.broadcast(named), ["in_table", "in_field", "load_no"], "left_semi")
