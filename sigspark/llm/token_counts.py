"""Token counts by a whole-token shortcut: pre-tokens that are one token are counted, only the rest is merged.

Offline, before any text is read, two things are proven about the vocabulary of a sentencepiece BPE model:

* where a text may be cut. No piece has the word mark after another character, so no merge reaches from a
  word into the mark before the next; and a character that no piece of two or more characters holds (line
  feed, tab) never merges with a neighbour. If a vocabulary breaks the first rule, ``prove`` raises.
* which vocabulary strings, encoded alone, are one token.

A text is cut there, its segments are looked up in the table of proven strings, and the segments that are
missing go through the library's own merges, once each for as long as the table holds them. The table starts
with the vocabulary (of fixed size, shipped to the tasks once) and grows to ``MEMO`` entries at most.

Defined results: null counts as the empty text, of 0 bytes and 0 tokens; texts of any length are counted
whole; repeated rows get equal counts; input columns pass through but for those named as a result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_batches, text_of, with_results

MARK = "▁"
LIMIT = 4096
#: Segments remembered by a task beside the vocabulary, and the longest that is remembered.
MEMO, MEMO_CHARS = 200_000, 48


@lru_cache(maxsize=2)
def _processor(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode_segments(path: str, segments: list[str]) -> list[list[int]]:
    """The ids of segments, each as it is encoded within a text.

    The library puts a mark before what it encodes: a marked segment goes without its first mark, another
    one behind a line feed, and the two ids of mark and line feed are dropped.
    """
    marked = [s.startswith(MARK) for s in segments]
    found = _processor(path).encode([s[1:] if m else "\n" + s for s, m in zip(segments, marked, strict=True)], num_threads=1)
    out = []
    for segment, ids, m in zip(segments, found, marked, strict=True):
        if m and len(segment) == 1:
            ids = [_processor(path).piece_to_id(MARK)]  # of an empty text the library makes nothing
        out.append(ids if m else ids[2:])
    return out


def prove(path: str) -> tuple[list[str], str]:
    """(strings that encode alone as one token, characters beside the mark at which texts may be cut)."""
    model = _processor(path)
    ordinary = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = [model.id_to_piece(i) for i in ordinary]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece of this vocabulary holds a word mark after another character")
    merging = {c for p in pieces if len(p) > 1 for c in p}
    cuts = "".join(c for c in "\n\t" if c not in merging)
    if "\n" not in cuts:
        raise ValueError("a piece of this vocabulary merges line feeds")
    alone = [p for p, i, ids in zip(pieces, ordinary, encode_segments(path, pieces), strict=True) if ids == [i]]
    return alone, cuts


class Counts:
    """Token counts of texts, one task's."""

    def __init__(self, path: str, alone: list[str], cuts: str):
        self.path = path
        self.base = dict.fromkeys(alone, 1)
        self.memo = dict(self.base)
        self.segments = re.compile(f"{MARK}+[^{MARK}{cuts}]*|[{cuts}]|[^{MARK}{cuts}]+").findall

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        segments = self.segments(MARK + text.replace(" ", MARK))
        counts = list(map(self.memo.get, segments))
        if None not in counts:
            return sum(counts)
        total, rest = 0, []
        for segment, n in zip(segments, counts, strict=True):
            if n is None:
                rest.append(segment)
            else:
                total += n
        merged = {}
        new = list(dict.fromkeys(rest))
        for segment, ids in zip(new, encode_segments(self.path, new), strict=True):
            merged[segment] = len(ids)
        if len(self.memo) > len(self.base) + MEMO:
            self.memo = dict(self.base)
        self.memo.update((s, n) for s, n in merged.items() if len(s) <= MEMO_CHARS)
        return total + sum(map(merged.__getitem__, rest))


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Every row with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    spark = docs.sparkSession
    small_batches(spark)
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    proven = spark.sparkContext.broadcast(prove(path))  # as large as the vocabulary

    @F.pandas_udf("bigint")
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = Counts(path, *proven.value)
        for texts in parts:
            yield pd.Series([counts.count(t) for t in texts], dtype="int64")

    rows = docs.withColumn("__n", tokens(text_of()))
    return with_results(
        rows,
        docs.columns,
        {"n_bytes": F.octet_length(text_of()).cast("bigint"), "n_tokens": F.col("__n"), "over_limit": F.col("__n") > limit},
    )


def op4_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
