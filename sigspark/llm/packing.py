"""Packing along a space-filling curve.

1. Every document gets a vector: the counts of its byte triples (A-Z as a-z), damped by a logarithm, hashed to
   ``WIDTH`` signed dimensions and scaled to length one. A fixed random projection takes it to ``DIMS``
   dimensions, whose values are put on a grid of ``BITS`` bits each; the Hilbert curve through that grid
   gives the key.
2. Rows are dealt to partitions by ranges of (key, id), and sorted in each by (key, id, text), so that neighbours on
   the curve, near copies and texts of one language among them, end up side by side. The id takes part in the ranges:
   a group of copies with one key is spread over partitions like any other rows. The ranges hold about ``TASK_BYTES``
   of text each. Their bounds come from a sample of ``PER_RANGE`` rows a range (``SAMPLE`` rows at most), weighted by
   size; every row's key is computed once, and together with it the number of its range.
3. A task tokenises its rows in order and fills sequences of ``length`` tokens, cutting documents wherever a
   sequence is full. What is left at its end is cut into sequences of powers of two (those need no padding),
   eleven at most a task. A task holds one batch of rows at a time.

The sequence id has the partition in its upper bits: the result is meant to be written once; it holds for one
run, as partition bounds are drawn from samples.

Words are encoded once for as long as a worker's table of ``MEMO`` words holds them: the tokenizer drops white
space and never merges over it, nor from letters into signs, so a text's ids are those of its words, and of a
word's letters and the signs behind them. Letters that need no normalising are handed to the tokenizer's model many
words at a time; the tokens that end a word part the ids again.

Defined results: a null or empty text is the closing id alone; very long texts are cut over many sequences;
rows that repeat are each packed, also where ids are null; an empty table gives no pieces. The result has its own
columns alone: other columns of the input, whatever their names, are left out.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left
from codecs import charmap_decode
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .common import read_table, small_batches, text_of

LENGTH, CLOSE = 2048, 1
WIDTH, DIMS, BITS = 512, 4, 15
MEMO, MEMO_CHARS, TOGETHER = 700_000, 48, 1_000_000
#: Bytes of text a range holds; beyond ``RANGES`` ranges they hold more.
TASK_BYTES, RANGES = 16 << 20, 100_000
PER_RANGE, SAMPLE = 200, 1_000_000
#: Signs that are tokens apart from letters before them; none is part of a contraction or of a special token.
SIGNS = "!#$%&()*+,-./:;=?@[]^_`{}~"


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class Encoder:
    """The ids of whole texts, with words remembered."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.memo: dict[str, bytes] = {}
        # The same model for words that are lower case already, parted by spaces; ``letters`` has the letter for each byte.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        table = [chr(b) for b in range(256)]
        for c in range(128, 256):
            if chr(c).isalpha():
                for b, letter in zip(chr(c).encode(), to_bytes.pre_tokenize_str(chr(c))[0][0], strict=True):
                    table[b] = letter
        self.letters = "".join(table)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def ids(self, text: str | None) -> bytes:
        return next(self.each([text]))

    def each(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of many texts, in order; words of ``TOGETHER`` characters or so are looked up at a time."""
        waiting, size = [], 0
        for text in texts:
            words = (text or "").replace("\n", " ").split(" ")
            waiting.append(words)
            size += len(text or "")
            if size > TOGETHER:
                yield from self._found(waiting)
                waiting, size = [], 0
        yield from self._found(waiting)

    def _found(self, texts: list[list[str]]) -> Iterator[bytes]:
        if len(self.memo) > MEMO:
            self.memo = {}
        fresh = set().union(*texts).difference(self.memo)
        passing = self._learn(fresh) if fresh else []
        found = [b"".join(map(self.memo.__getitem__, words)) for words in texts]
        for w in passing:
            self.memo.pop(w, None)
        return iter(found)

    def _learn(self, words: set[str]) -> list[str]:
        """Remember the ids of words, and those of their letters and signs; the ones too long to be kept come back."""
        memo, letters, rest, both = self.memo, set(), set(), []
        for w in words:
            stem = w if w.isalpha() else w.rstrip(SIGNS)
            # Within Latin-1 lower case goes letter by letter, as in the tokenizer, and nothing is left to compose.
            if stem.isalpha() and (stem.isascii() or max(stem) < "\u0100"):
                low = stem.lower()
                if low not in memo:
                    letters.add(low)
                if low != w:
                    sign = w[len(stem) :]
                    both.append((w, low, sign))
                    if sign not in memo:
                        rest.add(sign)
            else:
                rest.add(w)
        if letters:
            self._learn_letters(list(letters))
        if rest:
            whole = list(rest)
            for w, e in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True):
                memo[w] = np.array(e.ids, "<u4").tobytes()
        for w, low, sign in both:
            memo[w] = memo[low] + memo[sign]
        if max(map(len, words)) <= MEMO_CHARS:  # letters and signs are no longer than their words
            return []
        return [w for w in (*words, *letters, *rest) if len(w) > MEMO_CHARS]

    def _learn_letters(self, words: list[str]) -> None:
        """Words of lower-case letters of Latin-1 in one call; the tokens that end a word part their ids."""
        joined = " ".join(words)
        ids = np.array(self.words.encode_batch_fast([charmap_decode(joined.encode(), "strict", self.letters)[0]], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        raw, begin = ids.tobytes(), 0
        for w, end in zip(words, ends, strict=True):
            self.memo[w] = raw[begin:end]
            begin = end


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """A worker's encoder, which its tasks share."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Encoder(path)


def projection(seed: int = 11) -> np.ndarray:
    """From ``WIDTH`` dimensions to ``DIMS``; of a vector of length one each result is about standard normal."""
    return np.random.default_rng(seed).standard_normal((WIDTH, DIMS)).astype(np.float32)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def document_vector(text: str | None) -> np.ndarray:
    raw = _LOWER[np.frombuffer((text or "").encode(), np.uint8)].astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(WIDTH)
    triples = (raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]) * np.uint32(0x9E3779B1)
    counts = np.log1p(np.bincount(triples >> np.uint32(32 - (2 * WIDTH).bit_length() + 1), minlength=2 * WIDTH))
    vector = counts[:WIDTH] - counts[WIDTH:]  # a sign for each triple, from the same hash
    norm = np.sqrt((vector * vector).sum())
    return vector / norm if norm else vector


def hilbert_key(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of each row of ``grid`` (unsigned integers below 2**bits)."""
    x = grid.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):  # undo the turns of the larger cells, from the top
        q, low = 1 << level, (1 << level) - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):  # to Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where(x[n - 1] & (1 << level), flip ^ ((1 << level) - 1), flip)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def keys_of(texts: pd.Series) -> np.ndarray:
    vectors = np.array([document_vector(t) for t in texts]).reshape(-1, WIDTH)
    grid = np.clip((vectors @ projection() / 3 + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1)
    return hilbert_key(grid.astype(np.int64))


LEAST = -(1 << 63)  # stands for a null id, which sorts first


def range_bounds(docs: DataFrame) -> list[tuple[int, int]]:
    """The last (key, id) of each range of ``docs`` but the last one, sorted."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1
    rows, total = docs.agg(F.count(F.lit(1)), F.sum(size)).first()
    ranges = min(-(-(total or 0) // TASK_BYTES), RANGES)
    if ranges <= 1:
        return []

    @F.pandas_udf("bigint")
    def key(texts: pd.Series) -> pd.Series:
        return pd.Series(keys_of(texts), dtype="int64")

    share = min(1.0, min(PER_RANGE * ranges, SAMPLE) / rows)
    drawn = docs.select("doc_id", "text").sample(share, seed=23).select(key(text_of()), F.coalesce("doc_id", F.lit(LEAST)), size).collect()
    drawn = sorted(tuple(r) for r in drawn)
    ends = np.cumsum([r[2] for r in drawn])
    if not len(ends):
        return []
    picked = np.searchsorted(ends, ends[-1] * np.arange(1, ranges) / ranges)
    return sorted({drawn[i][:2] for i in picked.tolist()})


def ranged(docs: DataFrame) -> DataFrame:
    """(doc_id, text, hilbert), a range of (hilbert, doc_id) a partition, sorted in it."""
    small_batches(docs.sparkSession)
    bounds = range_bounds(docs)
    keys, ids = np.array([b[0] for b in bounds], np.int64), [b[1] for b in bounds]

    @F.pandas_udf("hilbert bigint, place int")
    def placed(texts: pd.Series, doc_ids: pd.Series) -> pd.DataFrame:
        key = keys_of(texts)
        low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        for i in np.flatnonzero(low < high).tolist():  # bounds with this very key: the id decides
            low[i] = bisect_left(ids, doc_ids.iloc[i], low[i], high[i])
        return pd.DataFrame({"hilbert": key, "place": low.astype(np.int32)})

    found = placed(text_of(), F.coalesce("doc_id", F.lit(LEAST)))
    rows = docs.select("doc_id", "text", found.alias("f")).select("doc_id", "text", "f.hilbert", "f.place")
    return rows.repartitionById(len(bounds) + 1, "place").drop("place").sortWithinPartitions("hilbert", "doc_id", "text")


def powers(n: int) -> list[int]:
    """``n`` as falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


PIECES = "doc_id bigint, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, hilbert bigint"
NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "hilbert"]


def cut(doc: tuple, at: int, base: int, length: int) -> list[tuple]:
    """The pieces of one document whose first token has place ``at`` among the task's tokens."""
    doc_id, ids, hilbert = doc
    count, out, done = len(ids) // 4, [], 0
    while done < count:
        sequence, offset = divmod(at + done, length)
        n = min(count - done, length - offset)
        out.append((doc_id, done, n, ids[4 * done : 4 * (done + n)], count, base + sequence, offset, hilbert))
        done += n
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, ids: bool = True) -> DataFrame:
    """The pieces of all documents: ids, their checksum, and their place in the document and in the sequence.

    Without ``ids`` the checksums come alone, and the ids themselves stay with the workers.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    closing = np.array([CLOSE], "<u4").tobytes()
    schema = PIECES if ids else PIECES.replace("ids binary, ", "")

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 40
        encode = encoder(path).each
        at, waiting = 0, []  # the documents that have tokens in the sequence that is not full yet

        def pieces(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=NAMES)
            out = out.assign(doc_id=out["doc_id"].astype("Int64"), ids_crc32=[zlib.crc32(r[3]) for r in rows])
            return out if ids else out.drop(columns="ids")

        for frame in frames:
            rows = []
            ids_of = [None if x is pd.NA else int(x) for x in frame["doc_id"].astype("Int64")]
            for doc in zip(ids_of, (i + closing for i in encode(frame["text"])), frame["hilbert"].tolist(), strict=True):
                waiting += cut(doc, at, base, length)
                at += len(doc[1]) // 4
                full = base + at // length
                if waiting[0][5] < full:
                    rows += [p for p in waiting if p[5] < full]
                    waiting = [p for p in waiting if p[5] >= full]
            if rows:
                yield pieces(rows)
        if waiting:
            yield pieces(split_tail(waiting, at % length))

    return ranged(docs).mapInPandas(fill, schema)


def split_tail(tail: list[tuple], total: int) -> list[tuple]:
    """The last, unfilled sequence as sequences of powers of two."""
    ends = np.cumsum(powers(total)).tolist()
    out = []
    for doc_id, start, n, ids, count, sequence, offset, hilbert in tail:
        done = 0
        while done < n:
            k = int(np.searchsorted(ends, offset + done, "right"))
            begin = ends[k - 1] if k else 0
            m = min(n - done, ends[k] - offset - done)
            out.append((doc_id, start + done, m, ids[4 * done : 4 * (done + m)], count, sequence + k, offset + done - begin, hilbert))
            done += m
    return out


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
