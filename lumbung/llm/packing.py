"""Filling containers of fixed capacity with documents, none cut unless it alone exceeds the capacity.

Documents are dealt to shards of a bounded number of items. A shard is packed by best fit, largest
first, and then improved by local search: documents move, or are exchanged one for one or two for
one, from a bin to a fuller one, so that the sum of squared fills grows with every step until bins
fall empty. The search ends when the bins are as few as the tokens allow, or no step is left. What
the shards waste is a part of a container each.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lumbung.llm.tokens import VOCABULARY, with_token_counts
from lumbung.session import shuffle_partitions

#: Items of a shard, about.
SHARD_ITEMS = 4096


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers; each item, from the largest, into the fullest bin that has room."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect.bisect_left(rooms, (size, -1))
        if at == len(rooms):
            bins.append([i])
            room, b = capacity - size, len(bins) - 1
        else:
            room, b = rooms.pop(at)
            room -= size
            bins[b].append(i)
        bisect.insort(rooms, (room, b))
    return bins


def _step(a: list[int], b: list[int], sizes: np.ndarray, room: int) -> tuple[list[int], list[int]] | None:
    """Items to take from ``a`` and to give back from ``b`` so that ``b``, with ``room`` left, gets fuller by most."""
    if not a:
        return None
    xa = np.array([sizes[i] for i in a])
    xb = np.array([sizes[i] for i in b]) if b else np.empty(0, int)
    best, gain = None, 0

    def offer(gains: np.ndarray, what) -> None:
        nonlocal best, gain
        fits = np.where((gains <= room) & (gains > 0), gains, 0)
        at = int(fits.argmax()) if fits.size else 0
        if fits.size and fits.flat[at] > gain:
            gain, best = int(fits.flat[at]), what(at)

    offer(xa, lambda k: ([a[k]], []))
    if gain < room and len(xb):
        n = len(xb)
        offer(xa[:, None] - xb[None, :], lambda k: ([a[k // n]], [b[k % n]]))
        if gain < room and len(a) > 1:
            i, j = np.triu_indices(len(a), 1)
            offer((xa[i] + xa[j])[:, None] - xb[None, :], lambda k: ([a[i[k // n]], a[j[k // n]]], [b[k % n]]))
    return best


def improve(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search; every step raises the sum of squared fills, so it ends.

    The emptiest bin gives to fuller ones, in passes over them, until it is empty or nothing fits. Each
    bin is tried once: one that can't be emptied is not tried again after later exchanges. A bin that
    holds more than all the room in fuller bins can't be emptied, nor can a fuller one.
    """
    fill = [int(sizes[b].sum()) for b in map(np.array, bins)] if bins else []
    fewest = math.ceil(int(sizes.sum()) / capacity)
    alive = set(range(len(bins)))
    stuck: set[int] = set()
    while len(alive) > fewest:
        below = sorted((b for b in alive if fill[b] < capacity), key=lambda b: fill[b])
        source = next((b for b in below if b not in stuck), None)
        if source is None:
            break
        targets = below[below.index(source) + 1 :]
        if sum(capacity - fill[t] for t in targets) < fill[source]:
            break
        moved = True
        while moved and bins[source]:
            moved = False
            for target in reversed(targets):
                if not bins[source]:
                    break
                room = capacity - fill[target]
                step = _step(bins[source], bins[target], sizes, room) if room and fill[target] >= fill[source] else None
                if step:
                    take, give = step
                    bins[source] = [i for i in bins[source] if i not in take] + give
                    bins[target] = [i for i in bins[target] if i not in give] + take
                    change = int(sizes[take].sum() - (sizes[give].sum() if give else 0))
                    fill[source] -= change
                    fill[target] += change
                    moved = True
        if bins[source]:
            stuck.add(source)
        else:
            alive.discard(source)
    return [bins[b] for b in sorted(alive)]


def pack(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers for items of at most ``capacity``; items without size join the first bin."""
    items = np.flatnonzero(sizes > 0)
    inner = improve(best_fit(sizes[items], capacity), sizes[items], capacity)
    bins = [items[np.array(b, dtype=int)].tolist() for b in inner]
    empty = np.flatnonzero(sizes <= 0).tolist()
    if empty:
        bins = bins or [[]]
        bins[0] = bins[0] + empty
    return bins


def pack_documents(df: DataFrame, id_column: str, text_column: str, capacities: Mapping[str, int], vocabulary: str = VOCABULARY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``window_name, container_id, position, <id>, piece, n_pieces, n_tokens`` of every document and capacity.

    A document beyond the capacity is cut into full pieces and a rest; only the rest shares its
    container. Documents in a container are ordered by id. Null and empty texts take no room and are
    placed all the same. Container ids are unique per window. An empty table gives no row.
    """
    spark = df.sparkSession
    shards = max(1, -(-df.count() // shard_items))
    counted = with_token_counts(df, id_column, text_column, vocabulary).withColumn("shard", F.pmod(F.xxhash64(F.col(f"`{id_column}`"), F.col("n_tokens")), F.lit(shards)).cast("int"))
    windows = F.array(*(F.struct(F.lit(name).alias("window_name"), F.lit(int(c)).cast("long").alias("capacity")) for name, c in capacities.items()))
    items = counted.withColumnRenamed(id_column, "id").select("id", "n_tokens", "shard", F.explode(windows).alias("w")).select("id", "n_tokens", "shard", "w.*")
    id_type = df.schema[id_column].dataType.simpleString()

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity, window, shard = int(pdf["capacity"].iloc[0]), pdf["window_name"].iloc[0], int(pdf["shard"].iloc[0])
        pdf = pdf.sort_values("id", kind="stable")
        tokens = pdf["n_tokens"].to_numpy()
        pieces = np.maximum(1, -(-tokens // capacity))
        whole = np.where(pieces > 1, pieces - 1, 0)  # full pieces; the last piece is packed
        rest = tokens - whole * capacity
        ids = pdf["id"].to_numpy()
        container, position = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        bins = pack(rest, capacity)
        for n, b in enumerate(bins):
            order = sorted(b)
            container[order] = n
            position[order] = np.arange(len(order))
        base = np.int64(shard) << 32
        out = [pd.DataFrame({"container_id": base + container, "position": position, "id": ids, "piece": pieces - 1, "n_pieces": pieces, "n_tokens": rest})]
        if whole.any():
            at = np.repeat(np.arange(len(pdf)), whole)
            number = np.concatenate([np.arange(k) for k in whole if k])
            out.append(pd.DataFrame({"container_id": base + len(bins) + np.arange(len(at)), "position": 0, "id": ids[at], "piece": number, "n_pieces": pieces[at], "n_tokens": capacity}))
        return pd.concat(out).assign(window_name=window)[["window_name", "container_id", "position", "id", "piece", "n_pieces", "n_tokens"]]

    # a number of partitions given by hand is not merged into few for being small: packing is work
    packed = items.repartition(shuffle_partitions(spark), "window_name", "shard").groupBy("window_name", "shard").applyInPandas(work, f"window_name string, container_id long, position long, id {id_type}, piece long, n_pieces long, n_tokens long")
    return packed.withColumnRenamed("id", id_column)


def fill_report(packed: DataFrame, capacities: Mapping[str, int]) -> DataFrame:
    """``window_name, containers, tokens, fewest, fill``: how full the containers are, beside the least possible number."""
    capacity = F.create_map(*(F.lit(x) for kv in capacities.items() for x in kv))[F.col("window_name")]
    per = packed.groupBy("window_name", "container_id").agg(F.sum("n_tokens").alias("t")).groupBy("window_name").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    return per.select("window_name", "containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("fewest"), F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("fill"))
