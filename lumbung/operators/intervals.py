"""Continuous periods and gaps of time intervals per key.

The state of a key is a list of disjoint, sorted intervals. It is a mergeable aggregate: two lists
merge in one linear pass, in any order and grouping. Lists are made inside every input partition
without a shuffle, merged in a reduction tree as deep as the number of input partitions asks for, and
emitted with the gaps between them. A key's list never holds more intervals than half the days that
its intervals span, however many rows the key has, so a key with a third of all rows sends a few short
lists and no task receives its rows. Tasks hold a bounded number of intervals: a full state is sent on
and a new one begun, and the last step reads intervals in order and keeps one key's at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from lumbung.session import input_partitions, shuffle_partitions

#: Day number of an end that never comes.
OPEN = 2**31 - 1
#: Rows that a task buffers at least before it merges them into its state, intervals of a state before
#: it is sent on, and of a frame.
BUFFER_ROWS, STATE_ROWS, FRAME_ROWS = 200_000, 4_000_000, 100_000
#: Lists that a step of the tree merges into one.
FAN_IN = 32
_SPAN = 2**33

Lists = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def sweep(key: np.ndarray, start: np.ndarray, end: np.ndarray, many: np.ndarray) -> Lists:
    """Disjoint intervals of sorted ones (by key code and start), for all keys at once, in one pass.

    Days are int64. ``many`` says that an interval comes from two or more different ones; an interval
    that doesn't is its own only origin, so comparing bounds tells whether a merge joins different
    ones. Touching intervals (end + 1 = next start) merge.
    """
    if not len(key):
        return key, start, end, many
    first_of_key = np.r_[True, key[1:] != key[:-1]]
    shift = np.cumsum(first_of_key).astype(np.int64) * _SPAN  # one running maximum over all keys
    reach = np.maximum.accumulate(end + shift) - shift
    begins = first_of_key.copy()
    begins[1:] |= start[1:] > reach[:-1] + 1
    at = np.flatnonzero(begins)
    group = np.cumsum(begins) - 1
    differs = (start != start[at][group]) | (end != end[at][group])
    return key[at], start[at], np.maximum.reduceat(end, at), np.logical_or.reduceat(many | differs, at)


def merge(key: np.ndarray, start: np.ndarray, end: np.ndarray, many: np.ndarray) -> Lists:
    """Disjoint sorted intervals per key code of any intervals."""
    order = np.lexsort((end, start, key))
    return sweep(key[order], start[order], end[order], many[order])


def merge_lists(a: Lists, b: Lists) -> Lists:
    """Two lists as one, in linear time: a stable sort takes two ascending runs as they are and merges them."""
    if not len(a[0]) or not len(b[0]):
        return b if not len(a[0]) else a
    key, start, end, many = (np.concatenate(x) for x in zip(a, b))
    order = np.argsort(key * _SPAN + start, kind="stable")
    return sweep(key[order], start[order], end[order], many[order])


_NONE: Lists = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))


class _State:
    """Interval lists of the keys that a task has seen.

    Rows are merged into the lists when they are as many as these hold, so each interval is merged a
    logarithmic number of times, however long the lists grow.
    """

    def __init__(self) -> None:
        self.codes: dict[object, int] = {}
        self.buffer: list[Lists] = []
        self.held = 0
        self.lists = _NONE

    def add(self, pdf: pd.DataFrame) -> None:
        code, values = pd.factorize(pdf["key"])
        known = np.array([self.codes.setdefault(v, len(self.codes)) for v in values.tolist()], dtype=np.int64)
        self.buffer.append((known[code], pdf["start"].to_numpy(np.int64), pdf["end"].to_numpy(np.int64), pdf["many"].to_numpy(bool)))
        self.held += len(pdf)
        if self.held > max(BUFFER_ROWS, len(self.lists[0])):
            self.merge()

    def merge(self) -> None:
        if self.buffer:
            self.lists = merge_lists(self.lists, merge(*(np.concatenate(x) for x in zip(*self.buffer))))
            self.buffer, self.held = [], 0

    def frames(self, block: int) -> Iterator[pd.DataFrame]:
        self.merge()
        names = list(self.codes)
        k, s, e, m = self.lists
        for i in range(0, len(k), FRAME_ROWS):
            part = slice(i, i + FRAME_ROWS)
            yield pd.DataFrame({"key": [names[c] for c in k[part].tolist()], "block": np.int32(block), "start": s[part], "end": e[part], "many": m[part]})


def _partial(blocks: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Lists of a task's intervals, which go to one of ``blocks`` parts of the next step."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, state = TaskContext.get().partitionId() % blocks, _State()
        for pdf in batches:
            state.add(pdf)
            if len(state.lists[0]) > STATE_ROWS:
                yield from state.frames(block)
                state = _State()
        yield from state.frames(block)

    return work


def _listed(keys: pa.Array, counts: np.ndarray, start: np.ndarray, end: np.ndarray, many: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """A row per key of its periods and the gaps between them."""
    day = lambda x: pa.array(x.astype(np.int32))
    offsets = lambda n: pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
    ends = pa.array(np.where(end == OPEN, 0, end).astype(np.int32), mask=end == OPEN)
    periods = pa.ListArray.from_arrays(offsets(counts), pa.StructArray.from_arrays([day(start), ends, pa.array(many)], ["start", "end", "many"]))
    follows = np.ones(len(start), bool)
    follows[np.r_[0, np.cumsum(counts)[:-1]]] = False
    at = np.flatnonzero(follows)
    gaps = pa.ListArray.from_arrays(offsets(counts - 1), pa.StructArray.from_arrays([day(end[at - 1] + 1), day(start[at] - 1)], ["first", "last"]))
    return pa.RecordBatch.from_arrays([keys.cast(schema.field(0).type), periods.cast(schema.field(1).type), gaps.cast(schema.field(2).type)], schema=schema)


def _final(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lists of keys from intervals sorted by key and start; holds the list of one key beside a batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[pa.Array, list[Lists]] | None = None  # the last key and its list so far; the last interval may grow
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key")
            values = keys.to_pandas().to_numpy()
            code = np.r_[0, np.cumsum(values[1:] != values[:-1])].astype(np.int64)
            rows: Lists = (code, *(batch.column(c).to_numpy().astype(np.int64) for c in ("start", "end")), batch.column("many").to_numpy(zero_copy_only=False).astype(bool))
            chunks: list[Lists] = []
            first = [np.flatnonzero(np.r_[True, code[1:] != code[:-1]])]
            names = keys.take(pa.array(first[0]))
            if held:
                same = held[0][0].as_py() == keys[0].as_py()
                if not same:
                    rows = (rows[0] + 1, *rows[1:])
                    names = pa.concat_arrays([held[0], names])
                chunks, last = held[1][:-1], held[1][-1]
                rows = tuple(np.concatenate(x) for x in zip(last, rows))
            k, s, e, m = sweep(*rows)
            open_key = int(k[-1])
            done = int(np.searchsorted(k, open_key))
            if done:
                parts = [tuple(np.concatenate(x) for x in zip(*chunks, (k[:done], s[:done], e[:done], m[:done])))] if chunks else [(k[:done], s[:done], e[:done], m[:done])]
                dk, ds, de, dm = parts[0]
                yield _listed(names.slice(0, open_key), np.bincount(dk, minlength=open_key), ds, de, dm, schema)
                chunks = []
            zero = np.zeros(len(k) - done, np.int64)
            rest: Lists = (zero, s[done:], e[done:], m[done:])
            if len(zero) > 1:
                chunks = [*chunks, tuple(x[:-1] for x in rest)]
            held = names.slice(open_key, 1), [*chunks, tuple(x[-1:] for x in rest)]
        if held:
            k, s, e, m = (np.concatenate(x) for x in zip(*held[1]))
            yield _listed(held[0], np.array([len(k)]), s, e, m, schema)

    return work


def _intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    day = lambda c: F.unix_date(F.to_date(F.col(f"`{c}`")))
    rows = df.select(F.col(f"`{key}`").alias("key"), day(start).alias("start"), F.coalesce(day(end), F.lit(OPEN)).alias("end"), F.lit(False).alias("many"))
    return rows.where("key IS NOT NULL AND start IS NOT NULL AND end >= start")


def continuous_periods(df: DataFrame, key: str, start: str, end: str, fan_in: int = FAN_IN, partitions: int | None = None) -> DataFrame:
    """Per key ``key, periods, gaps``: arrays of structs sorted by day.

    ``periods`` have ``start_day, end_day, many``; both days belong to the period, a null end_day
    means it never ends, and ``many`` says that two or more different intervals make it up. ``gaps``
    have the ``first_day`` and ``last_day`` that no interval covers between two periods. Rows with a
    null key, a null start or an end before the start count for nothing; repeated rows count once; a
    null end never ends. Empty input gives no row. Other columns are ignored, whatever their names.
    Keys that are fractions raise ValueError.

    ``partitions`` is the number of input partitions, estimated if not given; there is a step of the
    tree for each power of ``fan_in`` in it.
    """
    spark = df.sparkSession
    rows = _intervals(df, key, start, end)
    key_type = rows.schema["key"].dataType
    if isinstance(key_type, (FloatType, DoubleType)):
        raise ValueError("keys of intervals can't be fractions")
    flat = StructType([StructField("key", key_type), StructField("block", IntegerType()), StructField("start", LongType()), StructField("end", LongType()), StructField("many", BooleanType())])
    period = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("many", BooleanType())])
    gap = StructType([StructField("first", IntegerType()), StructField("last", IntegerType())])
    listed = StructType([StructField("key", key_type), StructField("periods", ArrayType(period)), StructField("gaps", ArrayType(gap))])

    n = shuffle_partitions(spark)
    blocks = max(1, -(-(partitions or input_partitions(df)) // fan_in))
    lists = rows.mapInPandas(_partial(blocks), flat)
    while blocks > 1:
        merged = max(1, math.ceil(blocks / fan_in))
        lists = lists.repartition(n, "key", "block").mapInPandas(_partial(merged), flat)
        blocks = merged
    lists = lists.drop("block").repartition(n, "key").sortWithinPartitions("key", "start").mapInArrow(_final(_arrow_schema(listed)), listed)
    return lists.select(
        F.col("key").alias(key),
        F.transform("periods", lambda p: F.struct(F.date_from_unix_date(p["start"]).alias("start_day"), F.date_from_unix_date(p["end"]).alias("end_day"), p["many"].alias("many"))).alias("periods"),
        F.transform("gaps", lambda g: F.struct(F.date_from_unix_date(g["first"]).alias("first_day"), F.date_from_unix_date(g["last"]).alias("last_day"))).alias("gaps"),
    )


def _arrow_schema(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def periods_and_gaps(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Rows ``key, kind, start_day, end_day, many`` of ``continuous_periods``; kind is ``period`` or ``gap``."""
    lists = continuous_periods(df, key, start, end)
    return lists.select(
        key,
        F.explode(
            F.concat(
                F.transform("periods", lambda p: F.struct(F.lit("period").alias("kind"), p["start_day"].alias("start_day"), p["end_day"].alias("end_day"), p["many"].alias("many"))),
                F.transform("gaps", lambda g: F.struct(F.lit("gap").alias("kind"), g["first_day"].alias("start_day"), g["last_day"].alias("end_day"), F.lit(False).alias("many"))),
            )
        ).alias("x"),
    ).select(key, "x.*")
