"""Token counts by public tokenizers; the vocabulary file is a parameter and stays where it is."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Default vocabulary; any file of the same kinds does.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published splitting pattern of byte-level BPE vocabularies.
BYTE_BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are counted in parts where the vocabulary's pattern has a sure boundary, which leaves the count exact.
PART_CHARS = 400_000
#: No token of ``BYTE_BPE_PATTERN`` holds white space after anything else, and none looks back.
_BOUNDARY = re.compile(r"(?<=\S)(?=[ \t\n\r])")


@functools.cache
def _counter(path: str):
    """Function from texts to their numbers of tokens; loaded once per worker."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("vocabulary", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(list(texts), add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(list(texts), num_threads=1)]
    raise ValueError(f"unknown kind of vocabulary: {path}")


def parts(text: str, size: int) -> Iterator[str]:
    """``text`` in parts of ``size`` characters and more, cut before white space only; nothing left out."""
    begin = 0
    while len(text) - begin > size and (cut := _BOUNDARY.search(text, begin + size)):
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def count_tokens(texts: Sequence[str | None], path: str = VOCABULARY) -> list[int]:
    """Tokens of each text; null and empty texts have none.

    Long texts are counted in parts if the vocabulary is of the kind whose pattern is known here; other
    kinds count them whole.
    """
    count = _counter(path)
    if not path.endswith(".tiktoken"):
        return count([t or "" for t in texts])
    return [sum(count(list(parts(t, PART_CHARS)))) if t and len(t) > PART_CHARS else count([t or ""])[0] for t in texts]


def with_token_counts(df: DataFrame, id_column: str, text_column: str, path: str = VOCABULARY) -> DataFrame:
    """``id_column, n_tokens`` of every row."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({id_column: pdf["id"], "n_tokens": count_tokens(pdf["text"].tolist(), path)})

    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    return rows.mapInPandas(work, f"`{id_column}` {rows.schema['id'].dataType.simpleString()}, n_tokens long")
