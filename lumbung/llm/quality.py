"""Statistics of text quality per document, and which documents are no prose.

A document's lines are told apart first: prose, list entries, rows of a table, or junk, by combined
rules on their own features (separators, share of digits and symbols, length, common words, sentence
ends) and on what repeats in the document: duplicate lines and paragraphs, the share of characters
that the most frequent word n-gram covers, and the share inside n-grams that recur, wherever lines end. The document is what more than half of its
visible characters are; if that is no prose, the kind with most characters names it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

LIST, TABLE, JUNK, PROSE = "list", "table", "junk", "prose"

#: A text whose most frequent n-gram covers this share of its characters is endlessly repeated; a
#: line that occurs so many times is repeated.
REPEATED_NGRAM, COPIES = 0.5, 4
#: A text of prose with more than this share of its characters in copies of earlier lines or paragraphs is
#: repeated: two copies of each are half.
DUPLICATES = 0.6
#: Words belong to endlessly repeated text inside an n-gram of a length that occurs ``COPIES`` times, and at
#: least once in so many words (0: no matter how many). Long prose shares phrases: up to a fifth of it is
#: found repeated so, and less than ``SOME_REPEATED`` says nothing.
RECURRING, SOME_REPEATED = ((5, 100), (16, 0)), 0.25
#: Words in an open line that can be a list entry, in a bulleted entry, and between two separators.
ENTRY_WORDS, BULLET_WORDS, PART_WORDS = 4, 12, 4
#: Share of words that no language spells like this, and of common words that inline lists stay under,
#: with commas and with semicolons.
UNSPOKEN, COMMA_COMMON, SEMICOLON_COMMON = 0.25, 0.12, 0.34
#: Lengths of n-grams, and words of texts that are counted together; a longer text is alone.
NGRAMS, CHUNK_WORDS = (2, 3, 4), 300_000

_LINES = re.compile(r"\r\n|\r|\n")
_PARAGRAPHS = re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*")
_WORDS = re.compile(r"\w+(?:['’.,-]\w+)*")
#: A tag begins like one: a less-than sign before a number or a space is text.
_TAGS = re.compile(r"<[a-zA-Z/!?][^<>]*>")
_BLOCK_TAGS = re.compile(r"<(/?)\s*(table|ul|ol|tr|li|br|p)\b[^<>]*>", re.I)
_BULLET = re.compile(r"(?:[-*+•·–—‣◦▪]\s|\[[ xX✓]?\]|\(?\d{1,3}[.)]\s|[a-zA-Z][.)]\s|☐|☑)")
_LOG = re.compile(r"\b\w+=\S|\b0x[0-9a-f]{4,}|\[?\d\d:\d\d:\d\d\]?")
_HEX = re.compile(r"(?:[0-9a-f]{2}[ :]){8,}")
_LONG = re.compile(r"\S{40,}")
_COLUMNS = re.compile(r"\S {2,}\S")
#: A line without these is words, numbers and plain punctuation with single spaces.
_ODD = re.compile(r"[|\t<>{}\[\]=#@~^*+\\_$&]|[^\x00-\x7f]|  ")
_UNSPOKEN = re.compile(r"[bcdfghjklmnpqrstvwxz]{4,}|\b[bcdfghjklmnpqrstvwxz]{2,}\b")
_SENTENCE = (".", "!", "?", '."', '!"', '?"')
_PUNCTUATION = tuple(".!?…\"”»:;,)")
_MOJIBAKE = re.compile("[\u00c3\u00c2\u00c5\u00e2\u00c4][\u0080-\u00bf\u0152-\u0178\u2013-\u2122\u20ac]|\ufffd|\u00e2\u20ac|[\u0000-\u0008\u000e-\u001f]")
_PIPE_SPLIT = re.compile(r"\s*\|\s*")
_NOT_ALNUM = bytes(c for c in range(256) if not chr(c).isalnum() or c > 127)

#: A plain line, whose kind its block decides, and a short one alone, which belongs to what follows.
_PLAIN, _HEADING = "plain", "heading"


def _lines(text: str) -> list[str]:
    return _LINES.split(text) if "\r" in text else text.split("\n")


def _paragraphs(text: str) -> list[str]:
    """Parts between blank lines, stripped, without empty ones."""
    parts = _PARAGRAPHS.split(text) if "\n" in text or "\r" in text else [text]
    return [p for p in map(str.strip, parts) if p]


def _visible(text: str) -> int:
    return len(text) - sum(map(text.count, " \t\n\r\x0b\x0c\u00a0"))


def _alnum(text: str) -> int:
    return len(text.encode().translate(None, _NOT_ALNUM)) if text.isascii() else sum(map(str.isalnum, text))


def _common_share(words: list[str], common: frozenset[str]) -> float:
    return sum(w.strip(".,;:!?()\"'").lower() in common for w in words) / len(words)


def line_kind(line: str, common: frozenset[str]) -> str:
    """Kind of one stripped, non-empty line by itself, or plain."""
    n, words = len(line), line.split()
    odd = _ODD.search(line) is not None
    bullet = _BULLET.match(line)
    if odd:
        if (found := len(_MOJIBAKE.findall(line))) and found * 25 > n:
            return JUNK
        pipes = line.count("|")
        if not line.strip("|-+=: "):
            return TABLE if n > 2 and ("|" in line or "+" in line or " " in line) else JUNK
        if pipes >= 2:
            cells = [c for c in _PIPE_SPLIT.split(line) if c]
            menu = line[0] != "|" and not any(map(str.isdigit, line)) and len(set(cells)) < 0.8 * len(cells)
            return JUNK if menu else TABLE
        if line.count("\t") >= 2:
            return TABLE
        if len(_LOG.findall(line)) >= 2:
            return JUNK
        columns = len(_COLUMNS.findall(line))
        if columns >= 2 and columns >= 0.5 * (len(words) - 1) and not bullet:
            numeric = sum(w[0].isdigit() or w[-1].isdigit() for w in words)
            if numeric >= 0.3 * len(words) or len(words) <= 8 and columns >= 0.8 * (len(words) - 1) and _common_share(words, common) < 0.2 and not line.endswith(_SENTENCE):
                return TABLE
    elif not line.strip("-.,:; "):
        return JUNK
    if n < 4 * len(words):
        if len(words) >= 8 and sum(len(w) == 1 for w in words) > 0.6 * len(words):
            return JUNK  # spaced out
        if _HEX.search(line):
            return JUNK
    if n >= 40 and max(map(len, words)) >= 40 and 2 * sum(len(w) for w in words if len(w) >= 40) > n:
        # runs without a space; a row of many short cells is a table all the same
        cells = line.count(",") + line.count(";")
        return TABLE if cells >= 3 and n <= 25 * (cells + 1) else JUNK
    if 2 * _alnum(line) < n - line.count(" "):
        return JUNK
    commas = line.count(",") + line.count(";")
    if commas >= 3 and line.count(", ") + line.count("; ") == 0 and len(words) <= 3 * (commas + 1):
        return TABLE
    if bullet:
        sentence = line.endswith(_SENTENCE) and len(words) > 5
        return _PLAIN if len(words) > BULLET_WORDS or sentence else LIST
    if len(words) >= 3 and sum(map(str.isdigit, [w[0] for w in words])) > 0.7 * len(words):
        return TABLE
    if len(words) >= 4 and common.isdisjoint(words) and len(_UNSPOKEN.findall(line.lower())) > UNSPOKEN * len(words):
        return JUNK
    if commas >= 3 and len(words) <= PART_WORDS * (commas + 1) and not line.endswith(_SENTENCE) and _common_share(words, common) < (SEMICOLON_COMMON if 2 * line.count(";") > commas else COMMA_COMMON):
        return LIST
    return _PLAIN


def _plain_block(lines: list[str], common: frozenset[str]) -> str:
    """Prose, or a list of short entries, for consecutive plain lines.

    Entries are a few words each, and hold one or two different common words at most. Wrapped prose
    has longer lines, whatever ends the block.
    """
    counts = [x.count(" ") + 1 for x in lines]
    n = len(lines)
    if max(counts) > 2 * ENTRY_WORDS or sum(x.endswith(_SENTENCE) for x in lines) > 0.3 * n:
        return PROSE
    if sum(counts) > (ENTRY_WORDS + 0.3) * n:
        return PROSE
    if n == 1:
        return _HEADING
    words = [w.strip(".,;:()").lower() for x in lines for w in x.split()]
    found = [w for w in words if w in common]
    return PROSE if len(set(found)) > 2 and len(found) > 0.12 * len(words) else LIST


def _unwrap(text: str) -> list[tuple[str, str | None]]:
    """Lines of a text with the kind that markup gives them, if it does; tags are taken out."""
    if "<" not in text or not _TAGS.search(text):
        return [(x, None) for x in _lines(text)]
    out: list[tuple[str, str | None]] = []
    depth = {"table": 0, "ul": 0}
    at = 0

    def add(part: str) -> None:
        tags = sum(len(t) for t in _TAGS.findall(part))
        plain = _TAGS.sub(" ", part)
        kind = TABLE if depth["table"] else LIST if depth["ul"] else None
        if tags > 2 * _visible(plain) and kind is None and tags > 40:
            out.append(("<" * tags, JUNK))  # markup without text
        out.extend((x, kind) for x in _lines(plain))

    for m in _BLOCK_TAGS.finditer(text):
        add(text[at : m.start()])
        at = m.end()
        name = m[2].lower()
        if name in ("table", "ul", "ol"):
            key = "table" if name == "table" else "ul"
            depth[key] = max(0, depth[key] + (-1 if m[1] else 1))
    add(text[at:])
    return out


@dataclass(frozen=True)
class WordStatistics:
    """Of some texts: words, characters in them, share of common words, covers by the most frequent n-gram per length, and
    the share of characters in shortest ``RECURRING`` n-grams that occur ``COPIES`` times."""

    n: np.ndarray
    characters: np.ndarray
    common: np.ndarray
    covers: np.ndarray
    recurring: np.ndarray


def word_statistics(texts: Sequence[list[str]], common: frozenset[str]) -> WordStatistics:
    """Statistics of texts given as words, counted for all texts at once.

    An n-gram can't occur more often than the shorter ones in it, so longer ones are counted only
    where those occur three times; this leaves none out. The first of equally frequent n-grams counts;
    one that occurs less than three times covers nothing.
    """
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), n)
    code, values = pd.factorize(np.fromiter((w for words in texts for w in words), object, int(n.sum())))
    code = code.astype(np.int64)
    size = np.fromiter(map(len, values), np.int64, len(values))[code]
    known = np.fromiter(map(common.__contains__, values), bool, len(values))[code]
    per = lambda x: np.bincount(doc, x, len(texts))
    characters = per(size)
    at_least = np.maximum(characters, 1)
    upto = np.r_[0, np.cumsum(size)]
    covers, recurring = np.zeros((len(texts), len(NGRAMS))), np.zeros(len(texts))
    starts, gram, length = np.arange(len(code)), code, 1

    def longer(to: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places where n-grams of ``to`` words that occur ``least`` times in their text begin, their numbers and counts."""
        held = np.zeros(len(code) + to, bool)
        held[starts] = True
        tried = starts + to <= len(code)
        for j in range(1, to - length + 1):
            tried &= held[starts + j]
        at, own = starts[tried], gram[tried]
        inside = doc[at] == doc[at + to - 1]
        at, own = at[inside], own[inside]
        # shorter n-grams have numbers of their own in each text, but for single words
        key = own if length > 1 else doc[at] * len(values) + own
        for j in range(length, to):
            key = pd.factorize(key)[0].astype(np.int64) * len(values) + code[at + j]
        number = pd.factorize(key)[0].astype(np.int64)
        times = np.bincount(number)[number] if len(number) else number
        often = times >= least
        return at[often], number[often], times[often]

    for k, to in enumerate(NGRAMS):
        starts, gram, times = longer(to, 3)
        length = to
        if not len(starts):
            break
        order = np.lexsort((starts, -times, doc[starts]))
        of = doc[starts][order]
        best = order[np.r_[True, of[1:] != of[:-1]]]
        covers[doc[starts[best]], k] = np.minimum(1.0, times[best] * (upto[starts[best] + to] - upto[starts[best]]) / at_least[doc[starts[best]]])
    else:
        to = RECURRING[0][0]
        starts, _, _ = longer(to, COPIES)
        edges = np.zeros(len(code) + 1, np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + to, -1)
        recurring = per(np.where(np.cumsum(edges[:-1]) > 0, size, 0)) / at_least
    return WordStatistics(n, characters, per(known) / np.maximum(n, 1), covers, recurring)


def ngram_cover(words: list[str]) -> tuple[float, ...]:
    """For each length in ``NGRAMS``, the share of the characters of all words that the most frequent n-gram covers."""
    return tuple(word_statistics([words], frozenset()).covers[0].tolist())


def repeated_share(words: list[str]) -> float:
    """Share of the characters of all words that lie in endlessly repeated text, wherever lines end (``RECURRING``)."""
    size = len(words)
    if size < RECURRING[0][0] + COPIES - 1:
        return 0.0
    grams = {1: pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)}
    repeated = np.zeros(size + 1, np.int64)
    for n, half in ((2, 1), (4, 2), (5, 4), (8, 4), (16, 8)):
        if size < n:
            break
        last = grams[n - half][half:]
        grams[n] = pd.factorize(grams[half][: len(last)] * size + last)[0].astype(np.int64)
        for length, one_in in RECURRING:
            if n == length:
                starts = np.flatnonzero(np.bincount(grams[n])[grams[n]] >= max(COPIES, size / one_in if one_in else 0))
                repeated[starts] += 1
                repeated[starts + n] -= 1
    lengths = np.fromiter(map(len, words), np.int64, size)
    return float(lengths[np.cumsum(repeated[:-1]) > 0].sum() / lengths.sum())


def _duplicate_share(parts: list[str]) -> float:
    """Share of the characters in parts that are copies of an earlier one."""
    total = sum(map(len, parts))
    return (total - sum(map(len, set(parts)))) / total if total else 0.0


def composition(text: str, common: frozenset[str], recurs: bool = True) -> dict[str, int]:
    """Visible characters of a text by kind.

    Prose and open entries that are endlessly repeated are junk; they are looked for if the text ``recurs``.
    """
    lines: list[tuple[str, str]] = []
    block: list[str] = []
    copies: Counter[str] = Counter()

    def close() -> None:
        if block:
            kind = _plain_block(block, common)
            lines.extend((x, kind) for x in block)
            block.clear()

    for raw, given in _unwrap(text):
        x = raw.strip()
        if x.startswith("> "):
            x = x[2:].lstrip()
        if not x:
            close()
            continue
        copies[x] += 1
        kind = given or line_kind(x, common)
        if kind == _PLAIN:
            block.append(x)
        else:
            if block and kind == LIST and len(block) == 1 and block[0].endswith(":"):
                lines.append((block.pop(), LIST))  # the heading of a list
            close()
            lines.append((x, kind))
    close()
    out = dict.fromkeys((PROSE, LIST, TABLE, JUNK), 0)
    follows = None
    for i in range(len(lines) - 1, -1, -1):
        if lines[i][1] == _HEADING:
            lines[i] = (lines[i][0], follows or (lines[i - 1][1] if i and lines[i - 1][1] != _HEADING else LIST))
        follows = lines[i][1]
    open_lines: dict[str, list[str]] = {PROSE: [], LIST: []}
    for x, kind in lines:
        if kind in (PROSE, LIST) and not _BULLET.match(x):
            if copies[x] >= COPIES and len(x) > 3:
                kind = JUNK
            else:
                open_lines[kind].append(x)
        out[kind] += len(x) - x.count(" ") - x.count("\t")
    for kind, own in open_lines.items() if recurs else ():
        share = repeated_share(_WORDS.findall("\n".join(own).lower()))
        if share > SOME_REPEATED:
            moved = round(share * sum(len(x) - x.count(" ") - x.count("\t") for x in own))
            out[kind] -= moved
            out[JUNK] += moved
    return out


STATISTICS = (
    "n_words long, mean_word_length double, symbol_share double, punctuated_lines double, common_share double, duplicate_lines double, duplicate_paragraphs double, "
    "top_2gram double, top_3gram double, top_4gram double, prose_share double, list_share double, table_share double, junk_share double"
)


def _tokens(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def _described(text: str, n: int, characters: float, common_share: float, grams: Sequence[float], recurring: float, common: frozenset[str]) -> tuple:
    """The statistics of a text in the order of ``STATISTICS``, and its kind."""
    visible = _visible(text)
    lines = [x for x in map(str.strip, _lines(text)) if x]
    mean = characters / n if n else 0.0
    symbols = (visible - _alnum(text)) / visible if visible else 0.0
    punctuated = sum(x.endswith(_PUNCTUATION) for x in lines) / len(lines) if lines else 0.0
    # a quarter of the half that decides is an eighth of the text; tags between words can hide what recurs
    parts = composition(text, common, recurring > 0.1 or "<" in text)
    total = sum(parts.values())
    duplicate_lines, duplicate_paragraphs = _duplicate_share(lines), _duplicate_share(_paragraphs(text))
    repeated = n >= 10 and (max(grams) > REPEATED_NGRAM or max(duplicate_lines, duplicate_paragraphs) > DUPLICATES and parts[PROSE] * 2 >= total)
    if not total or repeated and parts[TABLE] * 2 < total:
        kind = JUNK
    elif 2 * parts[PROSE] >= total:
        kind = PROSE
    else:
        kind = max((JUNK, TABLE, LIST), key=parts.__getitem__)
    shares = tuple(parts[k] / total if total else 0.0 for k in (PROSE, LIST, TABLE, JUNK))
    return (n, mean, symbols, punctuated, common_share, duplicate_lines, duplicate_paragraphs, *grams, *shares, kind)


def all_statistics(texts: Sequence[str | None], common: frozenset[str]) -> list[tuple]:
    """The statistics of each text in the order of ``STATISTICS``, and its kind. Null counts as empty; empty is junk."""
    out: list[tuple] = []
    held: list[str] = []
    words: list[list[str]] = []
    size = 0

    def close() -> None:
        w = word_statistics(words, common)
        out.extend(_described(t, int(n), c, k, g, r, common) for t, n, c, k, g, r in zip(held, w.n.tolist(), w.characters.tolist(), w.common.tolist(), w.covers.tolist(), w.recurring.tolist()))

    for text in texts:
        held.append(text or "")
        words.append(_tokens(held[-1]))
        size += len(words[-1])
        if size > CHUNK_WORDS:
            close()
            held, words, size = [], [], 0
    if held:
        close()
    return out


def statistics(text: str | None, common: frozenset[str]) -> tuple:
    """``all_statistics`` of one text."""
    return all_statistics([text], common)[0]


def quality_statistics(df: DataFrame, id_column: str, text_column: str, common_words: DataFrame, word_column: str = "word") -> DataFrame:
    """``<id>``, the columns of ``STATISTICS`` and ``kind`` (``prose``, ``list``, ``table`` or ``junk``) of every row.

    Null and empty texts are ``junk`` with zeros. The words of ``common_words`` of all languages count
    alike, because a row's language may be wrong; they are a list of function words, small by nature,
    and sent to every task (more than 100,000 are refused).
    """
    words = common_words.select(F.lower(F.col(f"`{word_column}`"))).where(F.col(f"`{word_column}`").isNotNull()).distinct().limit(100_001).collect()
    if len(words) > 100_000:
        raise ValueError("common words: a list of at most 100,000 words is expected")
    common = frozenset(r[0] for r in words)
    names = [x.split()[0] for x in STATISTICS.split(", ")] + ["kind"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = all_statistics(pdf["text"].tolist(), common)
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), **{name: [r[i] for r in rows] for i, name in enumerate(names)}})

    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    return rows.mapInPandas(work, f"id {rows.schema['id'].dataType.simpleString()}, {STATISTICS}, kind string").withColumnRenamed("id", id_column)
