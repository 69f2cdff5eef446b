"""What changed between consecutive full snapshots, by subtracting invertible Bloom lookup tables.

Every delivery is cut into hash buckets of its keys. Per bucket a table of cells is built: each
(key, digest of values) pair goes to three cells, which hold the number of pairs and the XOR of keys,
digests and check hashes. The tables of two consecutive deliveries are subtracted; what both hold
cancels, and the pairs that differ are peeled off cells that hold a single one, as its check hash
verifies. A bucket whose cells don't all come to zero is done again with more cells. A key with a
pair on the new side only was added, on the old side only removed, on both changed.

Rows are shuffled once, by bucket, after repeated and outdated ones have been dropped where they are
read. A delivery's cells are made, subtracted and peeled in the partition of their bucket; only what
differs leaves it. ``delivery_tables`` are worth keeping: a new delivery is then compared by its own
rows and the kept cells of the one before.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumbung.session import cut, shuffle_partitions

BUCKET_KEYS, CELLS, GROWTH, LEVELS = 512, 768, 4, 8
#: Cells that a task holds at once, filled or not; one bucket's at least.
CHUNK_CELLS = 1_000_000
#: Failed buckets that are sent to every task, two numbers each.
FEW_BUCKETS = 100_000
_SLICE = (1 << 21) - 1

# The primes of the public xxHash64 specification, which Spark's xxhash64 uses.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxhash64_long(values: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """xxHash64 of 8-byte values; chained over two columns it equals Spark's ``xxhash64(a, b)``."""
    with np.errstate(over="ignore"):
        h = np.asarray(seed).astype(np.uint64) + _P5 + np.uint64(8)
        h = h ^ (_rotl(values.astype(np.uint64) * _P2, 31) * _P1)
        h = _rotl(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def check_hash(key: np.ndarray, digest: np.ndarray) -> np.ndarray:
    return xxhash64_long(digest, xxhash64_long(key, 42))


def cells_of(check: np.ndarray, cells: int) -> np.ndarray:
    """The three cells of each pair, one in each third of the table."""
    third = np.uint64(cells // 3)
    return np.stack([(check >> np.uint64(21 * j)) % np.uint64(1 << 21) % third + np.uint64(j) * third for j in range(3)]).astype(np.int64)


def peel(group: np.ndarray, cell: np.ndarray, count: np.ndarray, key: np.ndarray, digest: np.ndarray, check: np.ndarray, cells: int):
    """Peel subtracted tables of many buckets at once.

    ``group`` is 0…G-1. Returns (group, key, digest, sign) of the recovered pairs and whether each
    group was recovered in full.
    """
    n = int(group.max()) + 1 if len(group) else 0
    at = group * cells + cell
    c, k, d, h = (np.zeros(n * cells, t) for t in (np.int64, np.uint64, np.uint64, np.uint64))
    c[at], k[at], d[at], h[at] = count, key, digest, check
    found = []
    todo = np.flatnonzero(np.abs(c) == 1)
    while len(todo):
        todo = todo[(np.abs(c[todo]) == 1)]
        todo = todo[check_hash(k[todo], d[todo]) == h[todo]]
        if not len(todo):
            break
        # a pair may lie alone in several of its cells: take it once
        pair = np.unique(np.stack([(todo // cells).astype(np.uint64), k[todo], d[todo], c[todo].astype(np.uint64)]), axis=1)
        g, pk, pd_, sign = pair[0].astype(np.int64), pair[1], pair[2], pair[3].astype(np.int64)
        ph = check_hash(pk, pd_)
        touched = cells_of(ph, cells) + g * cells
        for where in touched:
            np.subtract.at(c, where, sign)
            np.bitwise_xor.at(k, where, pk)
            np.bitwise_xor.at(d, where, pd_)
            np.bitwise_xor.at(h, where, ph)
        found.append((g, pk, pd_, sign))
        todo = np.unique(touched)
    bad = (c != 0) | (k != 0) | (d != 0) | (h != 0)
    ok = ~bad.reshape(n, cells).any(axis=1) if n else np.empty(0, bool)
    if not found:
        e = np.empty(0, np.int64)
        return (e, e.astype(np.uint64), e.astype(np.uint64), e), ok
    return tuple(np.concatenate(x) for x in zip(*found)), ok


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch, the rows of a delivery and key with the latest update, equal ones once; ties are left to come together.

    Of a key that is delivered over and over a task sends on a row or two per batch. Rows without a
    comparable update are sent on.
    """
    for batch in batches:
        rows = pd.DataFrame({c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("no", "key", "digest")})
        twice = rows.duplicated(["no", "key"], keep=False).to_numpy()
        if twice.any():
            some = rows[twice].assign(order=pd.factorize(batch.column("updated").filter(pa.array(twice)).to_pandas(), sort=True)[0])
            latest = some.groupby(["no", "key"])["order"].transform("max")
            known = some["order"] >= 0
            keep = ~twice
            keep[twice] = ~known | ((some["order"] == latest) & ~some.duplicated())
            batch = batch.filter(pa.array(keep))
        yield batch.drop_columns(["digest"])


def _elements(rows: DataFrame, partitions: int, values: Sequence[str], kinds: Mapping[str, str]) -> DataFrame:
    """``bucket, no, key, digest`` of the row of each key that holds in its delivery, partitioned by bucket."""
    fresh = rows.withColumn("digest", _digest(values, kinds)).mapInArrow(_fresh, rows.schema).repartition(partitions, "bucket")
    # the partitioning by bucket serves this and all later groups of a bucket
    held = fresh.groupBy("bucket", "no", "key").agg(F.max(F.struct("updated", *values)).alias("r"))
    return held.select("bucket", "no", "key", "r.*").select("bucket", "no", "key", _digest(values, kinds).alias("digest"))


def _digest(values: Sequence[str], kinds: Mapping[str, str]) -> Column:
    """Digest of some values; nulls equal each other only, NaNs too, and -0.0 equals 0.0."""
    parts = []
    for v in values:
        c = F.col(v)
        zero = F.when(c == 0, F.lit(0).cast(kinds[v])).otherwise(c) if kinds[v] in ("double", "float") else c
        parts += [F.coalesce(F.xxhash64(zero), F.lit(0)), c.isNull()]
    return F.xxhash64(*parts)


_CELL = ("n", "key", "digest", "check")


def _tables(elements: DataFrame, cells: int) -> DataFrame:
    """``bucket, no, cell, n, key, digest, check``: a table per bucket and delivery."""
    third = cells // 3
    cell = [F.pmod(F.shiftrightunsigned("check", 21 * j).bitwiseAND(F.lit(_SLICE)), F.lit(third)) + j * third for j in range(3)]
    spread = elements.withColumn("check", F.xxhash64("key", "digest")).withColumn("cell", F.explode(F.array(*cell)))
    return spread.groupBy("bucket", "no", "cell").agg(F.count("*").alias("n"), *(F.bit_xor(c).alias(c) for c in _CELL[1:]))


def _subtracted(tables: DataFrame, last: int) -> DataFrame:
    """``bucket, pair, cell`` and the cells of each delivery less those of the one before; empty ones are left out."""
    sides = F.array(F.struct(F.col("no").alias("pair"), F.col("n").alias("n")), F.struct((F.col("no") + 1).alias("pair"), (-F.col("n")).alias("n")))
    both = tables.select("bucket", "cell", *_CELL[1:], F.explode(sides).alias("s")).select("bucket", "cell", *_CELL[1:], "s.*").where(f"pair BETWEEN 1 AND {last}")
    less = both.groupBy("bucket", "pair", "cell").agg(F.sum("n").alias("n"), *(F.bit_xor(c).alias(c) for c in _CELL[1:]))
    return less.where("n <> 0 OR key <> 0 OR digest <> 0 OR check <> 0")


def _peeled(subtracted: DataFrame, cells: int) -> DataFrame:
    """``pair, bucket, key, digest, sign`` of the recovered pairs; ``sign`` 0 marks a bucket that failed."""

    def run(held: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Rows are sorted by group; some groups at a time, so that their tables, empty cells and all, stay small."""
        bucket, pair = (held[c].to_numpy(np.int64) for c in ("bucket", "pair"))
        begins = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (pair[1:] != pair[:-1])])
        step = max(1, CHUNK_CELLS // cells)
        ends = np.r_[begins[1:], len(held)]
        for i in range(0, len(begins), step):
            first, some = begins[i], held.iloc[begins[i] : ends[min(i + step, len(begins)) - 1]]
            own = begins[i : i + step]
            group = np.searchsorted(own, np.arange(first, first + len(some)), "right") - 1
            u = lambda c: some[c].to_numpy(np.int64).view(np.uint64)  # noqa: B023, E731
            (g, k, d, sign), ok = peel(group, some["cell"].to_numpy(np.int64), some["n"].to_numpy(np.int64), u("key"), u("digest"), u("check"), cells)
            keep = ok[g] if len(g) else np.empty(0, bool)
            at = np.r_[own[g[keep]], own[np.flatnonzero(~ok)]]
            none = np.zeros(int((~ok).sum()), np.int64)
            yield pd.DataFrame({"pair": pair[at], "bucket": bucket[at], "key": np.r_[k[keep].view(np.int64), none], "digest": np.r_[d[keep].view(np.int64), none], "sign": np.r_[sign[keep], none]})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= CHUNK_CELLS:
                whole = pd.concat(held)
                tail = ((whole["bucket"] == whole["bucket"].iloc[-1]) & (whole["pair"] == whole["pair"].iloc[-1])).to_numpy()
                if not tail.all():
                    yield from run(whole[~tail])
                held, rows = [whole[tail]], int(tail.sum())
        if rows:
            yield from run(pd.concat(held))

    return subtracted.sortWithinPartitions("bucket", "pair").mapInPandas(work, "pair long, bucket long, key long, digest long, sign long")


def _rows(df: DataFrame, key: str, updated: str, values: Sequence[str], no: Column, buckets: int) -> tuple[DataFrame, list[str], dict[str, str]]:
    """``bucket, no, key, updated`` and the values under names of their own."""
    c = lambda name: F.col(f"`{name}`")
    names = [f"v{i}" for i in range(len(values))]
    rows = df.select(no.alias("no"), c(key).cast("long").alias("key"), c(updated).alias("updated"), *(c(v).alias(n) for v, n in zip(values, names))).where("no IS NOT NULL AND key IS NOT NULL")
    return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))), names, {n: df.schema[v].dataType.simpleString() for v, n in zip(values, names)}


def bucket_count(n_rows: int, deliveries: int, bucket_keys: int = BUCKET_KEYS) -> int:
    return max(1, -(-n_rows // (max(1, deliveries) * bucket_keys)))


def delivery_tables(delivery: DataFrame, key: str, updated: str, values: Sequence[str], buckets: int, no: int = 0, cells: int = CELLS) -> DataFrame:
    """``bucket, no, cell, n, key, digest, check``: the tables of one delivery, to be kept beside it.

    Deliveries that are to be compared must have the same ``buckets`` and ``cells``.
    """
    rows, names, kinds = _rows(delivery, key, updated, values, F.lit(no), buckets)
    return _tables(_elements(rows, shuffle_partitions(delivery.sparkSession), names, kinds), cells)


def changes_of_tables(old: DataFrame, new: DataFrame, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """``key, how_changed`` between two deliveries by their ``delivery_tables``, and the ``bucket`` numbers that differ too much for them."""
    both = old.withColumn("no", F.lit(0)).unionByName(new.withColumn("no", F.lit(1)))
    peeled = cut(_peeled(_subtracted(both, 1).repartition(shuffle_partitions(old.sparkSession), "bucket"), cells))
    return _told(peeled.where("sign <> 0").select("pair", "key", "sign")).drop("pair"), peeled.where("sign = 0").select("bucket")


def changes_between(old: DataFrame, new: DataFrame, old_rows: DataFrame, new_rows: DataFrame, key: str, updated: str, values: Sequence[str], buckets: int, cells: int = CELLS) -> DataFrame:
    """``key, how_changed`` between two deliveries by their kept ``delivery_tables``; of their rows only buckets that differ too much are read."""
    changes, failed = changes_of_tables(old, new, cells)
    changes = changes.select(F.col("key").cast(new_rows.schema[key].dataType).alias(key), "how_changed")
    n = failed.count()
    if not n:
        return changes
    few = F.broadcast(failed) if n <= FEW_BUCKETS else failed
    sides = []
    for rows, day in ((old_rows, "2000-01-01"), (new_rows, "2000-01-02")):
        bucket = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("long")), F.lit(buckets))
        picked = rows.select(*(F.col(f"`{c}`") for c in (key, updated, *values)), bucket.alias("bucket"), F.lit(day).cast("date").alias("__day"))
        sides.append(picked.join(few, "bucket", "left_semi"))
    again = snapshot_changes(sides[0].unionByName(sides[1]), key, "__day", updated, values, cells=cells * GROWTH)
    return changes.unionByName(again.drop("__day"))


def _told(signs: DataFrame) -> DataFrame:
    how = F.when(F.min("sign") != F.max("sign"), "changed").when(F.max("sign") > 0, "added").otherwise("removed")
    return signs.groupBy("pair", "key").agg(how.alias("how_changed"))


def snapshot_changes(df: DataFrame, key: str, day: str, updated: str, values: Sequence[str], bucket_keys: int = BUCKET_KEYS, cells: int = CELLS) -> DataFrame:
    """``day, key, how_changed`` per delivery but the first, against the delivery before.

    ``how_changed`` is ``added``, ``removed`` or ``changed`` (any of ``values`` differs; nulls, and
    NaNs, equal each other). In one delivery the row of a key with the latest ``updated`` holds (null
    is earliest, ties are decided by the values). Rows without key or day count for nothing. ``key``
    is an integer. Fewer than two deliveries give no row. The days are listed on the driver: a table
    has one delivery a day at most.
    """
    spark = df.sparkSession
    c = lambda name: F.col(f"`{name}`")
    days = [r[0] for r in df.select(F.to_date(c(day)).alias("d")).where("d IS NOT NULL").distinct().orderBy("d").collect()]
    key_type = df.schema[key].dataType
    if len(days) < 2:
        return spark.createDataFrame([], f"`{day}` date, `{key}` {key_type.simpleString()}, how_changed string")
    number = F.create_map(*(F.lit(x) for i, d in enumerate(days) for x in (d, i)))
    rows, names, kinds = _rows(df, key, updated, values, F.element_at(number, F.to_date(c(day))), bucket_count(df.count(), len(days), bucket_keys))
    partitions, last = shuffle_partitions(spark), len(days) - 1
    recovered, todo, small = [], None, None
    for level in range(LEVELS + 1):
        # buckets that failed are read again; rows of others are dropped before the shuffle
        elements = _elements(rows if todo is None else rows.join(small(todo.select("bucket").distinct()), "bucket", "left_semi"), partitions, names, kinds)
        if level == LEVELS:  # hash values that repeat: count the pairs themselves
            sides = F.array(F.struct(F.col("no").alias("pair"), F.lit(1).alias("sign")), F.struct((F.col("no") + 1).alias("pair"), F.lit(-1).alias("sign")))
            pairs = elements.select("bucket", "key", "digest", F.explode(sides).alias("s")).select("bucket", "key", "digest", "s.*")
            rest = pairs.join(todo, ["pair", "bucket"], "left_semi").groupBy("pair", "bucket", "key", "digest").agg(F.sum("sign").alias("sign")).where("sign <> 0")
            recovered.append(rest.select("pair", "key", "sign"))
            break
        size = cells * GROWTH**level
        cellwise = _subtracted(_tables(elements, size), last)
        result = cut(_peeled(cellwise if todo is None else cellwise.join(small(todo), ["pair", "bucket"], "left_semi"), size))
        recovered.append(result.where("sign <> 0").select("pair", "key", "sign"))
        todo = result.where("sign = 0").select("pair", "bucket")
        failed = todo.count()
        if not failed:
            break
        # the plan can't know how few they are; beyond this many both sides are shuffled
        small = F.broadcast if failed <= FEW_BUCKETS else (lambda x: x)
    named = spark.createDataFrame(list(enumerate(days)), "no int, day date")
    changes = _told(reduce(DataFrame.unionByName, recovered))
    return changes.join(F.broadcast(named), changes["pair"] == named["no"]).select(F.col("day").alias(day), F.col("key").cast(key_type).alias(key), "how_changed")
