"""Byte-level BPE encoding and decoding by the tiktoken library, from a local file of ranks.

Long texts are cut before they are encoded, at places where the pattern always ends a match: between an
ASCII letter, digit or stop and a space or line feed. No match reaches over such a place and none looks
behind, so the parts' ids, put together, are the text's. A text without such a place goes whole.

The pattern takes white space up to the last one before a word as one match, and its engine runs out of stack where
that is very long. Runs of ``RUN`` white spaces or more are therefore cut out first, by the same rule (all of it at
the text's end, else all but the last), and handed to the library as the single match they are.

Decoding puts raw bytes together, whether or not they are valid UTF-8.

Defined results: null is the empty text, with no ids; texts of any length are encoded whole; repeated rows
get equal ids; an empty table gives an empty result; input columns pass through but for those named as a result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_batches, text_of, with_results

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters after which the next safe boundary is taken.
PART = 16_384
BOUNDARY = re.compile(r"(?<=[A-Za-z0-9.,])(?=[ \n])")
RUN = 2_048
#: White space as the pattern's engine has it.
BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[str]:
    """``text`` cut at safe boundaries, each the first after ``size`` characters."""
    begin = 0
    while len(text) - begin > size and (cut := BOUNDARY.search(text, begin + size)):
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def pieces(text: str) -> Iterator[tuple[str, bool]]:
    """``text`` in parts, and whether a part is one long match of white space."""
    begin = 0
    for blank in BLANK.finditer(text) if len(text) >= RUN else ():
        end = blank.end() if blank.end() == len(text) else blank.end() - 1
        yield from ((part, False) for part in parts(text[begin : blank.start()]))
        yield text[blank.start() : end], True
        begin = end
    yield from ((part, False) for part in parts(text[begin:]))


def encode_text(path: str, text: str | None) -> list[int]:
    """The ids of a text."""
    library, out = encoding(path), []
    for part, single in pieces(text or ""):
        out += library._encode_single_piece(part) if single else library.encode_ordinary(part)
    return out


def encode(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """Every row with ``ids``, little-endian 32-bit integers as bytes, and ``n_tokens``."""
    small_batches(docs.sparkSession)
    path = ranks or public_tokenizers.path(RANKS)

    @F.pandas_udf("binary")
    def ids_of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(encode_text(path, t), "<u4").tobytes() for t in texts], dtype=object)

    rows = docs.withColumn("__ids", ids_of(text_of()))
    return with_results(rows, docs.columns, {"ids": F.col("__ids"), "n_tokens": (F.octet_length("__ids") / 4).cast("bigint")})


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """Every row with ``decoded``: the raw bytes of its ``ids``; null ids decode to no bytes."""
    small_batches(encoded.sparkSession)
    path = ranks or public_tokenizers.path(RANKS)

    @F.pandas_udf("binary")
    def bytes_of(ids: pd.Series) -> pd.Series:
        return pd.Series([encoding(path).decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in ids], dtype=object)

    rows = encoded.withColumn("__decoded", bytes_of("ids"))
    return with_results(rows, encoded.columns, {"decoded": F.col("__decoded")})


def round_trip(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """Every row with ``ids``, ``n_tokens`` and ``decoded``: ``decode(encode(docs))`` in one call a batch."""
    small_batches(docs.sparkSession)
    path = ranks or public_tokenizers.path(RANKS)

    @F.pandas_udf("ids binary, decoded binary")
    def both_of(texts: pd.Series) -> pd.DataFrame:
        ids = [encode_text(path, t) for t in texts]
        decode_bytes = encoding(path).decode_bytes
        return pd.DataFrame({"ids": [np.array(x, "<u4").tobytes() for x in ids], "decoded": [decode_bytes(x) for x in ids]}, dtype=object)

    # Called once a row, however many columns read the result.
    rows = docs.withColumn("__both", both_of.asNondeterministic()(text_of()))
    ids, decoded = F.col("__both.ids"), F.col("__both.decoded")
    return with_results(rows, docs.columns, {"ids": ids, "n_tokens": (F.octet_length(ids) / 4).cast("bigint"), "decoded": decoded})


def op7_tiktoken_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
