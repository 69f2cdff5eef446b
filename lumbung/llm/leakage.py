"""Held-out test items inside documents: rare n-gram seeds, then Smith-Waterman alignment.

Texts are compared as streams of letters and digits of any script: case, accents, punctuation, white
space and markup are dropped, which undoes most retouching (split words, other separators in numbers,
tags). Character n-grams that occur in a single item are its seeds. Documents that hold enough seeds
of an item are aligned with it: windows around the seeds against the item, with local alignments found
one after the other until no seed is left outside, so pieces in any order count. A match weighs more
where the item's text is its own than where items of the same make share it, so a template with other
names and numbers does not align; text beside an accepted piece is aligned with equal weights. Text
that several items share over a long run (instructions) counts for nothing. Equal items are aligned
once, and all of them are reported.

Items of bounded size go to the executors as one index. Beyond that the seeds are a table: document
grams that pass a bit filter of fixed size are joined with them, and only candidates meet their texts
again. Both ways give the same rows. Nothing about documents is gathered anywhere but the leaks found.
Seeds are rare among items, not in the corpus: an item may have leaked into a third of all documents.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Bytes of a seed; different seeds that a document, and a window of it, must hold of an item. A third
#: of an item is a hundred characters and more; sixteen seeds are 27 of them in a row, or fewer in
#: several places. Of an item with few seeds half of them will do (``Item.least``).
SEED, MIN_SEEDS, WINDOW_SEEDS = 12, 16, 3
#: Bytes of items that are sent to the executors as one index; more are joined as a table.
INDEX_BYTES = 4_000_000
#: Runs of this many characters and more that so many items share are instructions.
INSTRUCTION, INSTRUCTION_ITEMS = 70, 5
#: Distance of seeds in one window, and context beside them.
REACH, CONTEXT = 300, 150
#: Weights of the alignment, the least score of a piece, and the part of the item's own characters
#: in the aligned span that must match: a template filled with other names and numbers stays below.
OWN, SHARED, MISMATCH, GAP, MIN_SCORE, OWN_MATCHED = 3, 1, -4, -4, 30, 0.5
#: Characters between two aligned pieces in a row that count as retouched, and how far beside a piece
#: its continuation is looked for.
BRIDGE, BESIDE = 30, 100
#: Part of an item's words that makes a leak, and part of a word's characters that make it held.
LEAK, HELD = 1 / 3, 0.6
#: Characters hashed at once, and cells of the alignment table that are kept at once.
CHUNK_CHARS, BATCH_CELLS = 2_000_000, 12_000_000

# Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans("аеорсухіѕјһԁԛԝкмтвнгАЕОРСУХІЅЈКМТВНοαερτυιικνАΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxisjhdqwkmtbhrAEOPCYXISJKMTBHoaeptuiikvABEZHIKMNOPTYX")

#: A tag begins like one: a less-than sign before a number or a space is text.
_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>")
_DROPPED = bytes(b for b in range(128) if not chr(b).isalnum())
_NO_LETTER = re.compile(r"[^\w\x00-\x7f]+")
# Scripts written without spaces between words, whose characters count as words.
_IDEOGRAMS = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORD = re.compile(rf"[{_IDEOGRAMS}]|[^\W_{_IDEOGRAMS}]+(?:[.,]\d+)*")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


def stream(text: str | None) -> bytes:
    """Letters and digits of ``text`` in lower case, without accents and markup, as UTF-8."""
    if not text:
        return b""
    if "<" in text:
        text = _TAG.sub("", text)
    if text.isascii():
        return text.lower().encode().translate(None, _DROPPED)
    text = unicodedata.normalize("NFKD", text.translate(_LOOKALIKES)).lower().replace("ς", "σ")
    return _NO_LETTER.sub("", text).encode("utf-8", "ignore").translate(None, _DROPPED)


def word_spans(text: str) -> list[tuple[int, int]]:
    """Begin and end of each word of ``text`` in its stream; words that leave nothing are left out."""
    out, at = [], 0
    for w in _WORD.findall(_TAG.sub("", text)):
        n = len(stream(w))
        if n:
            out.append((at, at + n))
            at += n
    return out


def gram_hashes(data: np.ndarray, size: int = SEED) -> np.ndarray:
    """A hash of every ``size`` bytes of a stream, by doubling; the size is part of it."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h, length, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
        rest, power = size, _BASE
        while rest:
            if rest & 1:
                part = h[done : done + n]
                out = part.copy() if out is None else out * power + part
                done += length
            rest >>= 1
            if rest:
                h = h[:-length] * power + h[length:]
                power = power * power
                length *= 2
        out = (out + np.uint64(SEED - size)) * _BASE
        return out ^ (out >> np.uint64(29))


@dataclass(frozen=True)
class Item:
    """Stream of an item, match weight of each byte (0 in instructions), its words outside instructions, and its seeds.

    ``seeds`` are the places of grams of ``size`` bytes that no other item has. An item shorter than a
    seed has one, its whole stream. ``least`` of them make a document a candidate.
    """

    key: int
    data: np.ndarray
    weight: np.ndarray
    words: np.ndarray
    seeds: np.ndarray
    hashes: np.ndarray
    size: int

    @property
    def least(self) -> int:
        return min(MIN_SEEDS, max(1, -(-len(self.seeds) // 2)))

    @property
    def least_score(self) -> int:
        """Half of what a short item can score at all."""
        return min(MIN_SCORE, max(1, int(self.weight.sum()) // 2))


@dataclass(frozen=True)
class Index:
    """Sorted seed hashes with their item and position, a bit filter over them, and the sizes of seeds."""

    items: list[Item]
    hashes: np.ndarray
    item: np.ndarray
    position: np.ndarray
    bits: np.ndarray
    sizes: tuple[int, ...]


def _runs(marked: np.ndarray, least: int) -> np.ndarray:
    """``marked`` without its runs shorter than ``least``."""
    out = np.zeros(len(marked), bool)
    edges = np.flatnonzero(np.diff(np.r_[0, marked.astype(np.int8), 0]))
    for a, b in zip(edges[::2], edges[1::2]):
        out[a:b] = b - a >= least
    return out


def make_item(key: int, question: str, shared: Mapping[int, int]) -> Item:
    """``shared`` has the hashes of the item's grams that other items hold too, with their numbers of items."""
    data = np.frombuffer(stream(question), np.uint8)
    grams = gram_hashes(data)
    times = np.array([shared.get(g, 1) for g in grams.tolist()], dtype=np.int64)
    common, often = times > 1, times >= INSTRUCTION_ITEMS
    shared_chars, often_chars = (np.convolve(x, np.ones(SEED))[: len(data)] > 0 if len(x) else np.zeros(len(data), bool) for x in (common, often))
    instruction = _runs(often_chars, INSTRUCTION)
    weight = np.where(instruction, 0, np.where(~shared_chars, OWN, SHARED)).astype(np.int16)
    spans = [(a, b) for a, b in word_spans(question) if b <= len(data) and instruction[a:b].mean() < 0.5]
    size = min(SEED, len(data))
    if size < SEED:
        grams, own = gram_hashes(data, size), np.arange(1)
    else:
        own = np.flatnonzero(~common)
    return Item(key, data, weight, np.array(spans, dtype=np.int64).reshape(-1, 2), own, grams[own], size)


def build_index(items: Sequence[tuple[int, str, Mapping[int, int]]]) -> Index:
    """The index of (key, question, shared grams) of items."""
    built = [make_item(*x) for x in items]
    h = np.concatenate([x.hashes for x in built] or [np.empty(0, np.uint64)])
    order = np.argsort(h, kind="stable")
    h = h[order]
    cat = lambda parts: np.concatenate([*parts, np.empty(0, np.int64)])[order].astype(np.int64)
    owner, position = cat([np.full(len(x.seeds), n) for n, x in enumerate(built)]), cat([x.seeds for x in built])
    return Index(built, h, owner, position, _filter(h), tuple(sorted({x.size for x in built})))


def _bit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def _filter(h: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << _FILTER_BITS, bool)
    bits[_bit(h)] = True
    return bits


def filtered_grams(streams: list[bytes], bits: np.ndarray, sizes: Iterable[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, position, hash) of the grams of some streams that pass the filter, in parts."""
    for first, last in _chunks(streams):
        part = streams[first:last]
        data = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        starts = np.cumsum([0] + [len(s) + 1 for s in part[:-1]])
        for size in sizes:
            grams = gram_hashes(data, size)
            at = np.flatnonzero(bits[_bit(grams)])
            text = np.searchsorted(starts, at, "right") - 1
            yield text + first, at - starts[text], grams[at]


def seed_hits(streams: list[bytes], index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, item, item position) of every seed in some streams."""
    out = []
    for text, at, found in filtered_grams(streams, index.bits, index.sizes):
        low, high = np.searchsorted(index.hashes, found, "left"), np.searchsorted(index.hashes, found, "right")
        times = high - low
        which = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        out.append((np.repeat(text, times), np.repeat(at, times), index.item[which], index.position[which]))
    if not out:
        e = np.empty(0, np.int64)
        return e, e, e, e
    return tuple(np.concatenate(x) for x in zip(*out))


def _chunks(streams: list[bytes]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, s in enumerate(streams):
        size += len(s) + 1
        if size >= CHUNK_CHARS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(streams):
        yield first, len(streams)


@dataclass
class _Task:
    """A window of a text against an item; ``covered`` marks the item's characters found so far."""

    pair: int
    window: np.ndarray
    item: Item
    seeds: np.ndarray  # (window position, item position)
    covered: np.ndarray
    used: np.ndarray
    pieces: list[tuple[int, int, int, int]] = field(default_factory=list)  # (first, last) of the item and of the window

    def add(self, a: int, b: int, wa: int, wb: int) -> None:
        """A piece that aligns; what lies between two of them in both texts, and is short, was retouched."""
        for c, d, wc, wd in self.pieces:
            if 0 <= a - d <= BRIDGE and 0 <= wa - wd <= BRIDGE:
                self.covered[d:a] = True
            if 0 <= c - b <= BRIDGE and 0 <= wc - wb <= BRIDGE:
                self.covered[b:c] = True
        self.covered[a : b + 1] = True
        self.used[wa : wb + 1] = True
        self.pieces.append((a, b, wa, wb))

    def accepts(self, score: int, least: int, at: np.ndarray) -> bool:
        """Whether an alignment of this score, at these places of the item, is a piece."""
        if score < least or not len(at):
            return False
        own = self.item.weight[at.min() : at.max() + 1] == OWN
        return (self.item.weight[at] == OWN).sum() >= OWN_MATCHED * own.sum()


def align(windows: list[np.ndarray], items: list[np.ndarray], weights: list[np.ndarray], cells: int | None = None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Best local alignment of each pair: its score and the matched (window, item) positions.

    All pairs advance together, one window character a step; gaps cost linearly, so the best gap
    inside a row is a running maximum. Rows of the table are kept if they have no more than ``cells``
    cells in all. Else every k-th row is, k the root of their number, and those between are computed
    again, block by block, when the path is traced back, so memory grows with the root of the table.
    """
    n_pairs, rows, columns = len(windows), max(map(len, windows)), max(map(len, items))
    # no score or tilted score can exceed the longest item's weight and gaps
    exact = np.int16 if (OWN - GAP) * (columns + 1) < 32_000 else np.int32
    w = np.zeros((n_pairs, rows), np.uint8)
    q = np.full((n_pairs, columns), 1, np.uint8)
    gain = np.zeros((n_pairs, columns), exact)
    for i, (a, b, g) in enumerate(zip(windows, items, weights)):
        w[i, : len(a)], q[i, : len(b)], gain[i, : len(b)] = a, b, g
    slope = (np.arange(1, columns + 1) * -GAP).astype(exact)
    matched = np.where(gain > 0, gain, exact(MISMATCH))

    def below(above: np.ndarray, r: int, out: np.ndarray) -> None:
        diagonal = above[:, :-1] + np.where(q == w[:, r, None], matched, exact(MISMATCH))
        row = np.maximum(np.maximum(diagonal, above[:, 1:] + exact(GAP)), 0)
        # best over gaps to the left: max of row[k] + GAP * (j - k)
        row += slope
        np.maximum.accumulate(row, axis=1, out=row)
        np.maximum(row - slope, 0, out=out[:, 1:])

    whole = (rows + 1) * n_pairs * (columns + 1) <= (BATCH_CELLS if cells is None else cells)
    size = rows if whole else math.isqrt(rows) + 1
    block = np.zeros((size + 1, n_pairs, columns + 1), exact)
    kept = []
    score, i, j = (np.zeros(n_pairs, np.int64) for _ in range(3))
    for r in range(rows):
        here = r % size
        if here == 0:
            if r:
                block[0] = block[size]
            if not whole:
                kept.append(block[0].copy())
        below(block[here], r, block[here + 1])
        at = block[here + 1].argmax(axis=1)
        value = block[here + 1][np.arange(n_pairs), at]
        better = value > score
        score[better], i[better], j[better] = value[better], r + 1, at[better]
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    who = np.arange(n_pairs)
    alive = score > 0
    for b in range((rows - 1) // size, -1, -1):
        low = b * size
        if not (alive & (i > low)).any():
            continue
        if not whole:
            block[0] = kept[b]
            for r in range(low, min(rows, low + size)):
                below(block[r - low], r, block[r - low + 1])
        while len(a := who[alive & (i > low)]):
            ia, ja = i[a], j[a]
            here = block[ia - low, a, ja]
            same = q[a, ja - 1] == w[a, ia - 1]
            diagonal = here == block[ia - low - 1, a, ja - 1] + np.where(same, matched[a, ja - 1], MISMATCH)
            up = ~diagonal & (here == block[ia - low - 1, a, ja] + GAP)
            hit = diagonal & same & (gain[a, ja - 1] > 0)
            steps.append((a[hit], ia[hit] - 1, ja[hit] - 1))
            i[a] -= diagonal | up
            j[a] -= ~up
            alive[a] = (i[a] > 0) & (j[a] > 0) & (block[i[a] - low, a, j[a]] > 0)
    if not steps:
        e = np.empty(0, np.int64)
        return score, [(e, e)] * n_pairs
    p, pi, pj = (np.concatenate(x) for x in zip(*steps))
    order = np.argsort(p, kind="stable")
    p, pi, pj = p[order], pi[order], pj[order]
    cuts = np.searchsorted(p, np.arange(n_pairs + 1))
    return score, [(pi[a:b], pj[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def _verbatim(t: _Task) -> bool:
    """Align a window that repeats the item word for word, without the table: all seeds lie on one
    diagonal and everything between them is equal. Equal characters beyond the seeds belong to it."""
    shift = t.seeds[:, 0] - t.seeds[:, 1]
    if (shift != shift[0]).any():
        return False
    low = max(0, -int(shift[0]))
    high = min(len(t.item.data), len(t.window) - int(shift[0]))
    equal = t.window[low + shift[0] : high + shift[0]] == t.item.data[low:high]
    first, last = t.seeds[:, 1].min() - low, t.seeds[:, 1].max() + SEED - low
    if not equal[first:last].all():
        return False
    before, after = np.flatnonzero(~equal[:first]), np.flatnonzero(~equal[last:])
    a = low + (int(before[-1]) + 1 if len(before) else 0)
    b = low + last + (int(after[0]) if len(after) else len(equal) - last)
    t.add(a, b - 1, a + int(shift[0]), b - 1 + int(shift[0]))
    return True


def _batches(tasks: list[_Task]) -> Iterator[list[_Task]]:
    """Tasks of like size together; the cells of a batch are bounded, a larger task is alone."""
    tasks = sorted(tasks, key=lambda t: (len(t.window), len(t.item.data)))
    batch: list[_Task] = []
    columns = 0
    for t in tasks:
        columns = max(columns, len(t.item.data))
        if batch and (len(batch) + 1) * (len(t.window) + 1) * (columns + 1) > BATCH_CELLS:
            yield batch
            batch, columns = [], len(t.item.data)
        batch.append(t)
    if batch:
        yield batch


def _windows(stream_: bytes, positions: np.ndarray, item_positions: np.ndarray, n_item: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows around seeds, each with its seeds; a window is not longer than a few times the item."""
    order = np.argsort(positions, kind="stable")
    positions, item_positions = positions[order], item_positions[order]
    limit = 4 * n_item + 2 * CONTEXT
    begin = 0
    for k in range(1, len(positions) + 1):
        if k == len(positions) or positions[k] - positions[k - 1] > REACH or positions[k] - positions[begin] > limit:
            a, b = max(0, positions[begin] - CONTEXT), min(len(stream_), positions[k - 1] + SEED + CONTEXT)
            yield np.frombuffer(stream_, np.uint8)[a:b], np.stack([positions[begin:k] - a, item_positions[begin:k]], axis=1)
            begin = k


def _extend(tasks: list[_Task]) -> list[tuple[int, int]]:
    """Continue the pieces of tasks beside their ends, with equal weights, for as long as something aligns there.

    Text that items share has no seeds, and little weight; next to a piece it belongs to the passage.
    Returns (pair, score) of what was added.
    """
    out = []
    ends = [(t, piece, after) for t in tasks for piece in t.pieces for after in (True, False)]
    while ends:
        jobs = []
        for t, (a, b, wa, wb), after in ends:
            at, w_at = (b + 1, wb + 1) if after else (max(0, a - BESIDE), max(0, wa - BESIDE))
            own, window = (slice(at, at + BESIDE), slice(w_at, w_at + BESIDE)) if after else (slice(at, a), slice(w_at, wa))
            weight = np.where(t.covered[own] | (t.item.weight[own] == 0), 0, OWN).astype(np.int16)
            if weight.any() and window.start < min(window.stop, len(t.window)):
                jobs.append((t, after, at, w_at, np.where(t.used[window], 0, t.window[window]).astype(np.uint8), t.item.data[own], weight))
        ends = []
        if not jobs:
            break
        scores, hits = align([j[4] for j in jobs], [j[5] for j in jobs], [j[6] for j in jobs])
        for (t, after, at, w_at, window, own, _), s, (wi, qj) in zip(jobs, scores, hits):
            if not t.accepts(int(s), t.item.least_score, qj + at):
                continue
            near = qj.min() <= BRIDGE and wi.min() <= BRIDGE if after else len(own) - 1 - qj.max() <= BRIDGE and len(window) - 1 - wi.max() <= BRIDGE
            piece = int(qj.min()) + at, int(qj.max()) + at, int(wi.min()) + w_at, int(wi.max()) + w_at
            if near and not t.covered[piece[0] : piece[1] + 1].all() and not t.used[piece[2] : piece[3] + 1].any():
                t.add(*piece)
                out.append((t.pair, int(s)))
                ends.append((t, piece, after))
    return out


@dataclass(frozen=True)
class Candidate:
    """A text that holds enough seeds of an item, and where: places in its stream and in the item's."""

    text: str
    stream: bytes
    item: Item
    at: np.ndarray
    item_at: np.ndarray


def _whole_words(c: Candidate) -> bool:
    """Whether an item shorter than a seed occurs as words of their own."""
    spans = word_spans(c.text)
    begins, ends = {a for a, _ in spans}, {b for _, b in spans}
    return any(int(a) in begins and int(a) + c.item.size in ends for a in c.at)


def scored(found: Sequence[Candidate]) -> list[tuple[int, int, int, int]]:
    """(seeds, words held, words, score) of each candidate."""
    tasks: list[_Task] = []
    covered = [np.zeros(len(c.item.data), bool) for c in found]
    score = [0] * len(found)
    for n, c in enumerate(found):
        it = c.item
        if it.size < SEED:
            if _whole_words(c):
                covered[n][:], score[n] = True, int(it.weight.sum())
            continue
        for window, where in _windows(c.stream, c.at, c.item_at, len(it.data)):
            if len(np.unique(where[:, 1])) >= min(WINDOW_SEEDS, it.least):
                tasks.append(_Task(n, window, it, where, np.zeros(len(it.data), bool), np.zeros(len(window), bool)))
    todo = []
    for t in tasks:
        if _verbatim(t):
            score[t.pair] += int(t.item.weight[t.covered].sum())
        else:
            todo.append(t)
    while todo:
        again = []
        for batch in _batches(todo):
            windows = [np.where(t.used, 0, t.window).astype(np.uint8) for t in batch]
            weights = [np.where(t.covered, 0, t.item.weight).astype(np.int16) for t in batch]
            scores, hits = align(windows, [t.item.data for t in batch], weights)
            for t, s, (wi, qj) in zip(batch, scores, hits):
                if s < t.item.least_score or not len(qj):
                    continue
                if t.accepts(int(s), t.item.least_score, qj):
                    t.add(int(qj.min()), int(qj.max()), int(wi.min()), int(wi.max()))
                    score[t.pair] += int(s)
                t.used[wi.min() : wi.max() + 1] = True
                t.seeds = t.seeds[~t.used[t.seeds[:, 0]] & ~t.covered[t.seeds[:, 1]]]
                if len(t.seeds):
                    again.append(t)
        todo = again
    for n, s in _extend(tasks):
        score[n] += s
    for t in tasks:
        covered[t.pair] |= t.covered
    out = []
    for c, cov, s in zip(found, covered, score):
        words = c.item.words
        total = np.r_[0, np.cumsum(cov & (c.item.weight > 0))]
        held = int(((total[words[:, 1]] - total[words[:, 0]]) >= HELD * (words[:, 1] - words[:, 0])).sum()) if len(words) else 0
        out.append((len(np.unique(c.item_at)), held, len(words), s))
    return out


def leaks_in(texts: Sequence[str], index: Index) -> list[tuple[int, int, int, int, int, int]]:
    """(text number, item key, seeds, words held, words, score) of every candidate that aligns."""
    streams = [stream(t) for t in texts]
    text, at, item, item_at = seed_hits(streams, index)
    if not len(text):
        return []
    order = np.lexsort((at, item, text))
    text, at, item, item_at = text[order], at[order], item[order], item_at[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])]), len(text)]
    found, of = [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        n, it = int(text[a]), index.items[item[a]]
        if len(np.unique(item_at[a:b])) >= it.least:
            found.append(Candidate(texts[n], streams[n], it, at[a:b], item_at[a:b]))
            of.append(n)
    return [(n, c.item.key, *s) for n, c, s in zip(of, found, scored(found))]


def _item_streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(stream=[stream(q) for q in pdf["question"]])


def _item_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for key, data in zip(pdf["key"], pdf["stream"]):
            grams = np.unique(gram_hashes(np.frombuffer(data, np.uint8)))
            yield pd.DataFrame({"key": key, "gram": grams.view(np.int64)})


def _unsigned(grams: Iterable, times: Iterable) -> dict[int, int]:
    return {int(g) % (1 << 64): int(n) for g, n in zip(grams, times)}


def _prepared(items: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """``key, question, size, grams, times`` of every different stream, with the grams that other items share; and ``key, item_id``."""
    c = lambda name: F.col(f"`{name}`")
    asked = items.where(c(item_id).isNotNull() & c(item_text).isNotNull()).select(c(item_id).cast("long").alias("item_id"), c(item_text).alias("question"))
    streams = asked.mapInPandas(_item_streams, "item_id long, question string, stream binary").where("length(stream) > 0").withColumn("key", F.xxhash64("stream"))
    members = streams.select("key", "item_id").distinct()
    folded = streams.groupBy("key").agg(F.min(F.struct("item_id", "question", "stream")).alias("x")).select("key", "x.question", "x.stream")
    grams = folded.select("key", "stream").mapInPandas(_item_grams, "key long, gram long")
    common = grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    own = grams.join(common, "gram").groupBy("key").agg(F.collect_list("gram").alias("grams"), F.collect_list("n").alias("times"))
    out = folded.join(own, "key", "left").select("key", "question", F.length("stream").alias("size"), F.coalesce("grams", F.array().cast("array<bigint>")).alias("grams"), F.coalesce("times", F.array().cast("array<bigint>")).alias("times"))
    return out, members


_FOUND = "n_seeds long, words_held long, words long, score long"


def _by_index(rows: DataFrame, prepared: DataFrame) -> DataFrame:
    """Leaks of documents against items that are sent to every executor as one index."""
    index = build_index(sorted((r["key"], r["question"], _unsigned(r["grams"], r["times"])) for r in prepared.collect()))
    sent = rows.sparkSession.sparkContext.broadcast(index)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = leaks_in(pdf["text"].tolist(), sent.value)
            ids = pdf["id"].to_numpy()
            yield pd.DataFrame({"id": ids[[f[0] for f in found]] if found else [], **{n: [f[k + 1] for f in found] for k, n in enumerate(("key", "n_seeds", "words_held", "words", "score"))}})

    return rows.mapInPandas(work, f"id {rows.schema['id'].dataType.simpleString()}, key long, {_FOUND}")


def _by_join(rows: DataFrame, prepared: DataFrame) -> DataFrame:
    """Leaks of documents against any number of items: seeds are joined as a table."""
    from lumbung.session import cut

    spark = rows.sparkSession
    id_type = rows.schema["id"].dataType.simpleString()
    prepared = cut(prepared)

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                it = make_item(r.key, r.question, _unsigned(r.grams, r.times))
                yield pd.DataFrame({"key": it.key, "gram": it.hashes.view(np.int64), "bit": _bit(it.hashes), "size": it.size, "item_at": it.seeds, "least": it.least})

    table = cut(prepared.mapInPandas(seeds, "key long, gram long, bit long, size int, item_at int, least int"))
    # the filter has a fixed number of bits, however many seeds there are
    packed = table.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    bits = np.zeros(1 << _FILTER_BITS, bool)
    for r in packed:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little"))
        bits[ones + (r["bucket"] - 1) * 32_768 + 1 if r["bucket"] else ones] = True
    sizes = sorted(r["size"] for r in table.select("size").distinct().collect())
    sent = spark.sparkContext.broadcast(bits)
    # rows are told apart by id and text, so that an id that occurs with two texts keeps both
    rows = rows.select("id", F.xxhash64("text").alias("of_text"), "text")

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, of_text = pdf["id"].to_numpy(), pdf["of_text"].to_numpy()
            for text, at, gram in filtered_grams([stream(t) for t in pdf["text"]], sent.value, sizes):
                yield pd.DataFrame({"id": ids[text], "of_text": of_text[text], "gram": gram.view(np.int64), "at": at})

    hits = rows.mapInPandas(grams, f"id {id_type}, of_text long, gram long, at int").join(table.select("gram", "key", "item_at", "least"), "gram")
    pairs = hits.groupBy("id", "of_text", "key").agg(F.collect_set(F.struct("at", "item_at")).alias("hits"), F.count_distinct("item_at").alias("n"), F.max("least").alias("least")).where("n >= least").drop("n", "least")
    whole = pairs.join(rows.dropDuplicates(["id", "of_text"]), ["id", "of_text"]).join(prepared.drop("size"), "key")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for r in pdf.itertuples(index=False):
                at = np.array(sorted((h["at"], h["item_at"]) for h in r.hits), dtype=np.int64)
                found.append(Candidate(r.text, stream(r.text), make_item(r.key, r.question, _unsigned(r.grams, r.times)), at[:, 0], at[:, 1]))
            out = scored(found)
            yield pd.DataFrame({"id": pdf["id"], "key": pdf["key"], **{n: [s[k] for s in out] for k, n in enumerate(("n_seeds", "words_held", "words", "score"))}})

    return whole.select("id", "key", "hits", "text", "question", "grams", "times").mapInPandas(work, f"id {id_type}, key long, {_FOUND}")


def leaked_items(documents: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "question") -> DataFrame:
    """Distinct ``<id>, item_id, n_seeds, words_held, words, share, score`` of documents that align with an item.

    ``words`` counts the item's words outside instructions, ``share`` is the part of them that the
    document holds. Rows with a null id or text give nothing; so do items without letters or digits,
    and items whose whole text lies inside other, different ones. Items with equal streams get equal rows. An item
    shorter than a seed is found where it stands word for word. An id with two texts gives rows of both.
    """
    c = lambda name: F.col(f"`{name}`")
    prepared, members = _prepared(items, item_id, item_text)
    rows = documents.where(c(id_column).isNotNull() & c(text_column).isNotNull()).select(c(id_column).alias("id"), c(text_column).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length(c(item_text))), F.lit(0))).first()[0]
    found = (_by_index if size <= INDEX_BYTES else _by_join)(rows, prepared).join(members, "key")
    share = F.when(F.col("words") > 0, F.col("words_held") / F.col("words")).otherwise(0.0)
    return found.select(c("id").alias(id_column), "item_id", "n_seeds", "words_held", "words", share.alias("share"), "score").distinct()


def exhaustive_shares(texts: Sequence[str | None], questions: Sequence[tuple[int, str, Mapping[int, int]]]) -> Iterator[tuple[int, int, float]]:
    """(text number, item key, share of words held) of every text against every item, without seeds; for measuring recall.

    The whole text is one window, and local alignments are taken until none scores enough. Text that
    items share makes no piece by itself.
    """
    items = [make_item(*q) for q in questions]
    for n, text in enumerate(texts):
        whole = stream(text)
        if not whole:
            continue
        tasks = [_Task(k, np.frombuffer(whole, np.uint8), it, np.empty((0, 2), np.int64), np.zeros(len(it.data), bool), np.zeros(len(whole), bool)) for k, it in enumerate(items) if it.weight.any()]
        todo = list(tasks)
        while todo:
            again = []
            for batch in _batches(todo):
                weights = [np.where(t.covered, 0, t.item.weight).astype(np.int16) for t in batch]
                scores, hits = align([np.where(t.used, 0, t.window).astype(np.uint8) for t in batch], [t.item.data for t in batch], weights)
                for t, s, (wi, qj) in zip(batch, scores, hits):
                    if s < t.item.least_score or not len(qj):
                        continue
                    if t.accepts(int(s), t.item.least_score, qj) and (t.item.weight[qj] == OWN).sum() >= min(SEED, len(t.item.data)):
                        t.add(int(qj.min()), int(qj.max()), int(wi.min()), int(wi.max()))
                    t.used[wi.min() : wi.max() + 1] = True
                    again.append(t)
            todo = again
        _extend(tasks)
        for t in tasks:
            words = t.item.words
            total = np.r_[0, np.cumsum(t.covered & (t.item.weight > 0))]
            if len(words):
                yield n, t.item.key, float(((total[words[:, 1]] - total[words[:, 0]]) >= HELD * (words[:, 1] - words[:, 0])).mean())
