"""References to records that don't exist, were deleted or came later.

Keys of any type are dictionary-encoded as dense integers, over the distinct keys of references and
parents. References become bitmaps per field, month and range of 32,768 codes; parents become bitmaps
per code range and month of creation. Bitmaps are kept in containers: sorted 16-bit places where few
bits are set, the bits where many are. Per code range, the references of a month AND NOT the parents
created before that month leave a few codes: keys that are missing, or whose parent was created in
that month or later. These are decoded by the dictionary. If they are few they go to the rows' scan;
if not, a hash filter of fixed size over them does, so that only rows that may be orphans are shuffled
to be looked up one by one. A key's number of rows never matters to the bitmaps, and a code range holds
at most one bitmap per field and month, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

from lumbung.session import cut

BITS = 32_768
#: Bits of the filter for rows, and in each of its blocks, which are joined by their number.
FILTER_BITS, BLOCK_BITS = 1 << 23, 1 << 15
#: Keys by field and month that are sent to every task, some 100 bytes each; more are shuffled to the rows that may hold them.
FEW_KEYS = 100_000
_NEVER = -(2**31)


@dataclass(frozen=True)
class Reference:
    """A field of ``rows`` that refers to the key ``parent_key`` of ``parents``.

    ``record_key`` names the referring row, ``created`` is its time, ``month_of`` the time it is
    reported under. ``deleted`` holds the deleted keys in its first column.
    """

    table: str
    field: str
    rows: DataFrame
    record_key: Column
    created: str
    month_of: str
    parents: DataFrame
    parent_key: str
    parent_created: str
    deleted: DataFrame


def dictionary(values: DataFrame, *columns: str) -> DataFrame:
    """The distinct ``columns`` without nulls, and ``code``: dense integers from 0 in their order.

    Values are range-partitioned and numbered per partition; the partitions' offsets come from one
    count per partition. No task sees more than its range.
    """
    cols = [F.col(f"`{c}`") for c in columns]
    distinct = values.select(*cols).dropna().distinct()
    ranged = cut(distinct.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("__part", F.spark_partition_id()))
    sizes = sorted((r["__part"], r["count"]) for r in ranged.groupBy("__part").count().collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    starts = values.sparkSession.createDataFrame(offsets, "__part int, __start long")
    # monotonically_increasing_id counts from partition << 33 in the partition's own order
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = ranged.withColumn("__within", within)
    return numbered.join(F.broadcast(starts), "__part").select(*cols, (F.col("__start") + F.col("__within")).alias("code"))


def _month(c: Column) -> Column:
    """Months since year 0; null time gives the earliest possible."""
    return F.coalesce(F.year(c) * 12 + F.month(c), F.lit(_NEVER))


def pack(bitmap: bytes) -> bytes:
    """A container: ``p`` and sorted 16-bit places, or ``b`` and the bits, whichever is shorter."""
    bits = np.frombuffer(bitmap, np.uint8)
    at = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
    return b"p" + at.astype("<u2").tobytes() if 2 * len(at) < len(bits) else b"b" + bits.tobytes()


def _into(bits: np.ndarray, packed: bytes) -> None:
    """Set the container's places in ``bits``."""
    if packed[:1] == b"b":
        np.bitwise_or(bits, np.frombuffer(packed, np.uint8, offset=1), out=bits)
    else:
        at = np.frombuffer(packed, "<u2", offset=1)
        np.bitwise_or.at(bits, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


def _and_not(packed: bytes, bits: np.ndarray) -> np.ndarray:
    """The container's places that ``bits`` doesn't have; only the container's own are looked at."""
    if packed[:1] == b"b":
        return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, offset=1) & ~bits, bitorder="little"))
    at = np.frombuffer(packed, "<u2", offset=1)
    return at[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 0].astype(np.int64)


def _bitmaps(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Containers of the distinct ``code`` per ``by`` and code range ``bucket``."""
    packed = F.pandas_udf(lambda s: s.map(pack), "binary")
    made = rows.groupBy(*by, F.bitmap_bucket_number("code").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits"))
    return made.select(*by, "bucket", packed("bits").alias("bits"))


def _decode(bucket: int, at: np.ndarray) -> np.ndarray:
    """Codes of places; Spark counts buckets from 1, and puts 0 into bucket 0."""
    return (bucket - 1) * BITS + at + 1 if bucket > 0 else bucket * BITS - at


def _survivors(refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    """Of one parent and code range: the codes of each field and month that no earlier parent has."""
    out = []
    if len(refs):
        parents = parents.sort_values("month")
        months, packed = parents["month"].tolist(), parents["bits"].tolist()
        ever = np.zeros(BITS // 8, np.uint8)
        for p in packed:
            _into(ever, p)
        there, i = np.zeros(BITS // 8, np.uint8), 0
        for r in refs.sort_values("month").itertuples(index=False):
            # without a time of its own a reference is late for no parent
            while r.month != _NEVER and i < len(months) and months[i] < r.month:
                _into(there, packed[i])
                i += 1
            codes = _decode(int(r.bucket), _and_not(r.bits, ever if r.month == _NEVER else there))
            out.append((r.in_table, r.in_field, r.month, codes))
    times = [len(x[3]) for x in out]
    named = [np.repeat(np.array([x[i] for x in out], dtype=t), times) for i, t in ((0, object), (1, object), (2, np.int32))]
    return pd.DataFrame({"in_table": named[0], "in_field": named[1], "month": named[2], "code": np.concatenate([np.empty(0, np.int64), *(x[3] for x in out)])})


def _hash(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))


def _filter(rows: DataFrame, *columns: str) -> DataFrame:
    """``block, words``: the hashes of some columns as bits, in blocks of 512 words; never more than ``FILTER_BITS``."""
    h = rows.select(_hash(*columns).alias("h")).distinct()
    words = h.groupBy(F.floor(F.col("h") / BLOCK_BITS).alias("block"), F.floor(F.col("h") % BLOCK_BITS / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h % 64 AS INT))")).alias("bits"))
    held = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    return held.select("block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("words"))


def _may_hold(rows: DataFrame, kept: DataFrame, *columns: str) -> DataFrame:
    """The rows whose columns may be among those of the filter ``kept``, which is a megabyte at most."""
    h = rows.withColumn("__h", _hash(*columns)).withColumn("block", F.floor(F.col("__h") / BLOCK_BITS))
    word = F.element_at("words", F.floor(F.col("__h") % BLOCK_BITS / 64).cast("int") + 1)
    return h.join(F.broadcast(kept), "block").where(F.getbit(word, (F.col("__h") % 64).cast("int")) == 1).drop("block", "words", "__h")


def _flat(refs: Sequence[Reference]) -> DataFrame:
    """All references as rows; fields of the same table are read in one scan."""
    by_table: dict[str, list[Reference]] = {}
    for r in refs:
        by_table.setdefault(r.table, []).append(r)
    parts = []
    for table, group in by_table.items():
        first = group[0]
        picked = F.array(*(F.struct(F.lit(r.field).alias("in_field"), F.col(f"`{r.field}`").cast("string").alias("key_id")) for r in group))
        rows = first.rows.select(
            F.lit(table).alias("in_table"), first.record_key.alias("record_key"), F.col(f"`{first.created}`").cast("timestamp_ntz").alias("created"), F.date_format(F.col(f"`{first.month_of}`"), "yyyy-MM").alias("ref_month"), F.explode(picked).alias("k")
        )
        parts.append(rows.select("in_table", "record_key", "created", "ref_month", "k.in_field", "k.key_id", _month(F.col("created")).alias("month")).where("key_id IS NOT NULL"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orphan_references(refs: Sequence[Reference]) -> DataFrame:
    """Distinct rows ``in_table, in_field, record_key, ref_month, key_id, kind`` of references without a parent in time.

    kind is ``deleted`` or ``missing`` for a key without a parent row (``deleted`` if the list of
    deletions has it), ``late`` if the parent was created after the referring row. Null references
    are none. A referring row without a time is never late; a parent without one always existed; of
    repeated parents the earliest counts. References of one table must share rows, record key and
    times; keys are compared as text, and ``key_id`` is text unless all fields are integers. Empty tables
    give no row, an empty parent leaves every reference missing.
    """
    flat = _flat(refs)
    spark = flat.sparkSession
    fields = spark.createDataFrame([(r.table, r.field, f"{r.table}.{r.field}") for r in refs], "in_table string, in_field string, parent string")
    parents, deleted = None, None
    for r in refs:
        name = F.lit(f"{r.table}.{r.field}").alias("parent")
        p = r.parents.select(name, F.col(f"`{r.parent_key}`").cast("string").alias("key_id"), F.col(f"`{r.parent_created}`").cast("timestamp_ntz").alias("made")).where("key_id IS NOT NULL")
        d = r.deleted.select(name, F.col(r.deleted.columns[0]).cast("string").alias("key_id")).where("key_id IS NOT NULL")
        parents, deleted = (p, d) if parents is None else (parents.unionByName(p), deleted.unionByName(d))
    earliest = F.min(F.coalesce("made", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))).alias("made")
    parents = parents.groupBy("parent", "key_id").agg(earliest)
    deleted = deleted.distinct().withColumn("gone", F.lit(True))

    # what the rows come down to: each key once per field and month
    used = cut(flat.select("in_table", "in_field", "month", "key_id").distinct().join(F.broadcast(fields), ["in_table", "in_field"]))
    codes = dictionary(used.select("parent", "key_id").unionByName(parents.select("parent", "key_id")), "parent", "key_id")
    ref_bits = _bitmaps(used.join(codes, ["parent", "key_id"]), ["parent", "in_table", "in_field", "month"])
    parent_bits = _bitmaps(parents.join(codes, ["parent", "key_id"]).withColumn("month", _month(F.col("made"))), ["parent", "month"])
    alone = (
        ref_bits.groupBy("parent", "bucket")
        .cogroup(parent_bits.groupBy("parent", "bucket"))
        .applyInPandas(_survivors, "in_table string, in_field string, month int, code long")
    )
    known = cut(
        alone.join(codes, "code")
        .join(parents, ["parent", "key_id"], "left")
        .join(deleted, ["parent", "key_id"], "left")
        .select("in_table", "in_field", "month", "key_id", "made", "gone")
    )
    named = ["in_table", "in_field", "month", "key_id"]
    kind = F.when(F.col("made").isNull(), F.when(F.col("gone"), "deleted").otherwise("missing")).when(F.col("made") > F.col("created"), "late")
    if known.count() <= FEW_KEYS:  # sent to the rows' scan, so that no key's rows come together, however many they are
        rows = flat.join(F.broadcast(known), named)
    else:
        rows = _may_hold(flat, _filter(known, *named), *named).join(known, named)
    rows = rows.withColumn("kind", kind).where("kind IS NOT NULL")
    whole = all(isinstance(r.rows.schema[r.field].dataType, IntegralType) for r in refs)
    return rows.select("in_table", "in_field", "record_key", "ref_month", F.col("key_id").cast("long" if whole else "string").alias("key_id"), "kind").distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """``in_table, in_field, ref_month, kind, n_references, n_keys`` of ``orphan_references``."""
    per_key = orphans.groupBy("in_table", "in_field", "ref_month", "kind", "key_id").agg(F.count("*").alias("n"))
    return per_key.groupBy("in_table", "in_field", "ref_month", "kind").agg(F.sum("n").alias("n_references"), F.count("*").alias("n_keys"))
