"""Full history of changing attributes, kept as checkpoints and patches.

Storage: per key every ``every``-th version is a checkpoint with all attributes; each version between
is a patch with only the attributes that changed. ``reconstruct`` folds patches forward from the
nearest checkpoint and gives every version with its period; ``as_of`` starts at the nearest checkpoint
before its day and reads no other segment. ``save`` writes a history, partitioned so that a day's
checkpoints are found without reading the rest, and ``extend`` adds a delivery: keys whose new states
come after all they had get further patches, behind the last segment; only keys with late or corrected
states are made anew, from the daily states that are kept beside.

Before any key's rows come together they are collapsed to one row per key and day (partially
aggregated in each task), so a key's rows in one task are bounded by the days of its history, however
often it was delivered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Versions from one checkpoint to the next.
EVERY = 8


@dataclass(frozen=True)
class History:
    """``checkpoints``: key, segment, valid_from, attributes. ``patches``: key, segment, seq, valid_from,
    and per attribute a struct ``v`` that is null where the attribute didn't change. ``states``: what
    they were made of, as ``daily_states`` gives it."""

    key: str
    attributes: tuple[str, ...]
    checkpoints: DataFrame
    patches: DataFrame
    states: DataFrame
    every: int = EVERY


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def daily_states(df: DataFrame, key: str, attributes: Sequence[str], day: str, received: str) -> DataFrame:
    """Per key and day the row received last; ``__key, __day, __s`` with the attributes in a struct.

    Rows without key or day count for nothing; a null ``received`` is earliest; rows received at the
    same time are ordered by their attributes, so that a rerun gives the same row.
    """
    last = F.max(F.struct(_c(received).alias("__received"), *(_c(a).alias(a) for a in attributes)))
    rows = df.where(_c(key).isNotNull() & _c(day).isNotNull())
    return rows.groupBy(_c(key).alias("__key"), F.to_date(_c(day)).alias("__day")).agg(last.alias("__s"))


def _versions(states: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """``__key, __day, __s, __p, __seq``: the days on which any attribute changed, numbered from 0 per key.

    A row with ``__base`` is the last version that a key has already: it is not given again, and
    numbers go on from it.
    """
    w = Window.partitionBy("__key").orderBy("__day")
    plain = states.select("__key", "__day", "__base", F.struct(*(F.col("__s").getField(a).alias(a) for a in attributes)).alias("__s"))
    # a field of its own says whether there is a row before: its attributes may all be null
    before = plain.withColumn("__p", F.lag("__s").over(w)).withColumn("__first", F.row_number().over(w) == 1)
    changed = before.where(F.col("__first") | ~F.col("__s").eqNullSafe(F.col("__p")))
    start = F.coalesce(F.first("__base").over(w), F.lit(0))
    return changed.withColumn("__seq", start + F.row_number().over(w) - 1).where("__base IS NULL")


def _parts(v: DataFrame, key: str, attributes: Sequence[str], every: int) -> tuple[DataFrame, DataFrame]:
    base = [F.col("__key").alias(key), F.floor(F.col("__seq") / every).cast("int").alias("segment")]
    checkpoints = v.where(F.col("__seq") % every == 0).select(*base, F.col("__day").alias("valid_from"), *(F.col("__s").getField(a).alias(a) for a in attributes))
    patch = [F.when(~F.col("__s").getField(a).eqNullSafe(F.col("__p").getField(a)), F.struct(F.col("__s").getField(a).alias("v"))).alias(a) for a in attributes]
    patches = v.where(F.col("__seq") % every != 0).select(*base, (F.col("__seq") % every).cast("int").alias("seq"), F.col("__day").alias("valid_from"), *patch)
    return checkpoints, patches


def store(df: DataFrame, key: str, attributes: Sequence[str], day: str, received: str, every: int = EVERY) -> History:
    """Checkpoints and patches of a stream of states; nulls are values and equal each other."""
    states = daily_states(df, key, attributes, day, received)
    v = _versions(states.withColumn("__base", F.lit(None).cast("int")), attributes)
    return History(key, tuple(attributes), *_parts(v, key, attributes, every), states, every)


_TABLES = ("checkpoints", "patches", "states")


def save(h: History, folder: str) -> History:
    """Write a history to three tables under ``folder``, which must be new, and return a reader of them."""
    for name in _TABLES:
        table = getattr(h, name)
        (table.write if name == "states" else table.withColumn("year", F.year("valid_from")).write.partitionBy("year")).parquet(f"{folder}/{name}")
    return load(h.states.sparkSession, folder, h.key, h.attributes, h.every)


def load(spark: SparkSession, folder: str, key: str, attributes: Sequence[str], every: int = EVERY) -> History:
    """A saved history. The types of all its tables are those of its states: a table without rows has no file."""
    states = spark.read.parquet(f"{folder}/states")
    of = {f.name: f.dataType.simpleString() for f in states.schema["__s"].dataType}
    base = f"`{key}` {states.schema['__key'].dataType.simpleString()}, segment int, {{}}valid_from date, "
    plain, patch = (", ".join(f"`{a}` {kind.format(of[a])}" for a in attributes) for kind in ("{}", "struct<v: {}>"))
    read = lambda name, schema: spark.read.schema(f"{schema}, year int").parquet(f"{folder}/{name}")
    return History(key, tuple(attributes), read("checkpoints", base.format("") + plain), read("patches", base.format("seq int, ") + patch), states, every)


def _tail(h: History) -> DataFrame:
    """``__key, __day, __base, __s``: the last version of every key and its number, from the last segment of each."""
    last = h.checkpoints.groupBy(_c(h.key)).agg(F.max_by(F.struct("segment", "valid_from", *map(_c, h.attributes)), "segment").alias("c")).select(h.key, "c.*")
    full = _folded(last, h.patches, h)
    return full.select(_c(h.key).alias("__key"), F.col("valid_from").alias("__day"), (F.col("segment") * h.every + F.col("seq")).alias("__base"), F.struct(*map(_c, h.attributes)).alias("__s"))


def _folded(checkpoints: DataFrame, patches: DataFrame, h: History) -> DataFrame:
    """Each of ``checkpoints``, one per key, with all of ``patches`` of its segment laid over it; ``seq`` and ``valid_from`` are the last one's."""
    of = F.struct("seq", "valid_from").alias("at")
    over = patches.join(checkpoints.select(h.key, "segment"), [h.key, "segment"]).select(h.key, of, *map(_c, h.attributes))
    laid = over.groupBy(_c(h.key)).agg(F.max("at").alias("at"), *(F.max_by(_c(a), F.when(_c(a).isNotNull(), F.col("at.seq"))).alias(f"p_{i}") for i, a in enumerate(h.attributes)))
    values = [F.when(F.col(f"p_{i}").isNotNull(), F.col(f"p_{i}").getField("v")).otherwise(_c(a)).alias(a) for i, a in enumerate(h.attributes)]
    return checkpoints.join(laid, h.key, "left").select(h.key, "segment", F.coalesce("at.seq", F.lit(0)).alias("seq"), F.coalesce("at.valid_from", "valid_from").alias("valid_from"), *values)


def extend(h: History, df: DataFrame, day: str, received: str) -> History:
    """``h`` with further rows of the same stream, as if ``store`` had had them all; nothing of ``h`` is changed.

    Tables of untouched keys, and of keys that only go on, are taken over as they are.
    """
    new = daily_states(df, h.key, h.attributes, day, received)
    states = h.states.unionByName(new).groupBy("__key", "__day").agg(F.max("__s").alias("__s"))
    known = h.states.groupBy("__key").agg(F.max("__day").alias("__last"))
    late = new.groupBy("__key").agg(F.min("__day").alias("__from")).join(known, "__key").where("__from <= __last").select("__key")
    on = new.join(late, "__key", "left_anti").withColumn("__base", F.lit(None).cast("int"))
    base = _tail(h).join(on.select("__key").distinct(), "__key", "left_semi")
    again = states.join(late, "__key", "left_semi").withColumn("__base", F.lit(None).cast("int"))
    plain = lambda x: x.select("__key", "__day", F.col("__base").cast("int").alias("__base"), F.struct(*(F.col("__s").getField(a).alias(a) for a in h.attributes)).alias("__s"))
    v = _versions(plain(on).unionByName(plain(base)).unionByName(plain(again)), h.attributes)
    kept = [t.join(late.select(F.col("__key").alias(h.key)), h.key, "left_anti") for t in (h.checkpoints, h.patches)]
    made = _parts(v, h.key, h.attributes, h.every)
    return History(h.key, h.attributes, *(k.select(*m.columns).unionByName(m) for k, m in zip(kept, made)), states, h.every)


def reconstruct(h: History) -> DataFrame:
    """Rows ``key, valid_from, valid_to, version, n_versions`` and the attributes of every version.

    Within a segment each attribute takes the last patch that names it, else the checkpoint's value.
    ``valid_to`` is the day before the next version, null for the last.
    """
    full = h.checkpoints.select(h.key, "segment", F.lit(0).alias("seq"), "valid_from", *(F.struct(_c(a).alias("v")).alias(a) for a in h.attributes))
    chain = full.unionByName(h.patches.select(*full.columns))
    fold = Window.partitionBy(h.key, "segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = chain.select(h.key, "segment", "seq", "valid_from", *(F.last(_c(a), ignorenulls=True).over(fold).getField("v").alias(a) for a in h.attributes))
    w = Window.partitionBy(h.key).orderBy("valid_from")
    return rows.select(
        h.key,
        "valid_from",
        F.date_sub(F.lead("valid_from").over(w), 1).alias("valid_to"),
        F.row_number().over(w).alias("version"),
        F.count("*").over(Window.partitionBy(h.key)).alias("n_versions"),
        *map(_c, h.attributes),
    )


def as_of(h: History, day: Column | date, ends: bool = True) -> DataFrame:
    """``key, valid_from``, the attributes, of every key, that hold on ``day``; keys that begin later are absent.

    Of each key the last checkpoint up to the day is taken, and the patches of its segment up to the
    day. ``ends`` adds ``valid_to``, for which the next version's day is looked up; without it nothing
    after the day is read, and of a saved history no later partition.
    """
    at = day if isinstance(day, Column) else F.lit(day)
    until = [F.col("valid_from") <= at]
    if "year" in h.checkpoints.columns and isinstance(day, date):  # partitions of a saved history
        until.append(F.col("year") <= day.year)
    checkpoints, patches = (reduce(DataFrame.where, until, t) for t in (h.checkpoints, h.patches))
    nearest = checkpoints.groupBy(_c(h.key)).agg(F.max_by(F.struct("segment", "valid_from", *map(_c, h.attributes)), "segment").alias("c")).select(h.key, "c.*")
    out = _folded(nearest, patches, h).select(h.key, "valid_from", *map(_c, h.attributes))
    if not ends:
        return out
    later = h.checkpoints.select(h.key, "valid_from").unionByName(h.patches.select(h.key, "valid_from")).where(F.col("valid_from") > at)
    after = later.groupBy(_c(h.key)).agg(F.min("valid_from").alias("__next"))
    return out.join(after, h.key, "left").select(*out.columns[:2], F.date_sub("__next", 1).alias("valid_to"), *map(_c, h.attributes))
