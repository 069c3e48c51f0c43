"""Grouping of spelling variants by full neighbourhoods.

Every word emits all distinct words that one deletion, one replacement or one insertion over the observed alphabet
makes of it, and those are hash-joined to the vocabulary: a match is a near word, no distance is computed. Words
and candidates are known by sums of code points times powers of a base, modulo three primes of 31 bits, and their length
(93 bits beside the length): one edit changes such a sum in constant time, so a task makes a word's candidates as arrays,
and a word of any length costs time linear in it.

Before a candidate leaves its task it is looked up in a bitmap of the vocabulary: ``BITS`` bits, 8 MB whatever the
vocabulary's size, built by Spark's bitmap aggregates. What passes is joined to the vocabulary by a shuffle; the bitmap
only spares the shuffle what cannot match. The same plan runs at all sizes.

Words are counted in the tasks first, text by text, and merged by a grouping that pre-aggregates, so a very frequent word
is as cheap as a rare one.

Defined results: a null text has no words; a null id is the empty string in the checksum; repeated rows count
as often as they occur; an empty table gives no words; a word without near words has ``n_near`` 0, no form, and is its
own root. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read_table, small_batches, spread_join, text_of, written
from .conversation_trie import CRC32

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
MIN_LENGTH, MIN_COUNT = 5, 3
#: One run in so many, by its checksum, loses a code point.
NOISE = 97
BITS = 26
PRIMES, BASES = (2147483647, 2147483629, 2147483587), (1103515245, 1566083941, 1812433253)
#: Words that a task holds before it sends its counts on; candidates that it makes at a time.
HELD, AT_ONCE = 200_000, 1 << 19


def lowered(run: str) -> str:
    """With A to Z, and no other letter, lower-cased."""
    return run if run.islower() else run.lower() if run.isascii() else run.translate(LOWER)


def noisy(name: str, run: str, noise: int = NOISE) -> str:
    """``run``, or where ``noise`` divides the checksum of ``name:run``, the run less one code point."""
    h = crc32(f"{name}:{run}".encode())
    if h % noise:
        return run
    return run[: h % len(run)] + run[h % len(run) + 1 :]


def words_in(name: str, text: str, noise: int | None) -> Iterator[tuple[str, int]]:
    """Words of one text with their numbers; a word may come more than once."""
    found = Counter(RUN.findall(text)) if len(text) < 1 << 20 else Counter(m.group() for m in RUN.finditer(text))
    for run, n in found.items():
        low = lowered(run)
        yield noisy(name, low, noise) if noise else low, n


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise: int | None = None) -> DataFrame:
    """(word, n) of the words of ``docs`` (doc_id, text) that have the length and occur as often."""
    small_batches(docs.sparkSession)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for frame in frames:
            for name, text in zip(frame["name"], frame["text"], strict=True):
                for word, n in words_in(name, text, noise):
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held.clear()
        yield pd.DataFrame({"word": list(held), "n": np.array(list(held.values()), np.int64)})

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), text_of().alias("text"))
    return rows.mapInPandas(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


@lru_cache(8)
def powers(lane: int, n: int) -> np.ndarray:
    """The first ``n`` powers of a lane's base."""
    p, out = PRIMES[lane], np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(BASES[lane], len(out), p)) % np.uint64(p)])
    return out[:n]


class Sums:
    """What one edit makes of the sums of words of one length, in one lane. ``codes``: words x code points."""

    def __init__(self, lane: int, codes: np.ndarray):
        self.p = np.uint64(PRIMES[lane])
        self.base, self.inverse = np.uint64(BASES[lane]), np.uint64(pow(BASES[lane], -1, PRIMES[lane]))
        self.power = powers(lane, 1 << int(codes.shape[1] + 1).bit_length())[: codes.shape[1] + 1]
        self.terms = codes * self.power[:-1] % self.p
        self.before = np.concatenate([np.zeros((len(codes), 1), np.uint64), np.cumsum(self.terms, 1) % self.p], 1)
        self.total = self.before[:, -1]

    def deleted(self, w: np.ndarray, i: np.ndarray) -> np.ndarray:
        return (self.before[w, i] + (self.total[w] + self.p - self.before[w, i + 1]) * self.inverse) % self.p

    def left(self, edit: str, w: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The sum but for the code point that comes to place ``i``."""
        if edit == "replace":
            return (self.total[w] + self.p - self.terms[w, i]) % self.p
        return (self.before[w, i] + (self.total[w] + self.p - self.before[w, i]) * self.base) % self.p

    def placed(self, i: np.ndarray, letters: np.ndarray) -> np.ndarray:
        return letters * self.power[i] % self.p


def keys(sums: list[np.ndarray], length: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    a, b, c = (s.astype(np.int64) for s in sums)
    return a | b << 31, c | np.int64(length) << 31


def coded(words: list[str]) -> np.ndarray:
    """Words of one length as code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def by_length(words: list[str]) -> Iterator[list[int]]:
    """Places of words of one length, few enough to be handled as one array."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        found, step = np.flatnonzero(lengths == n), max(1, AT_ONCE // (64 * int(n) + 1))
        for begin in range(0, len(found), step):
            yield found[begin : begin + step].tolist()


def word_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    k1, k2 = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for places in by_length(words):
        codes = coded([words[i] for i in places])
        k1[places], k2[places] = keys([Sums(lane, codes).total for lane in range(3)], codes.shape[1])
    return k1, k2


def marked(bitmap: np.ndarray, sums: np.ndarray) -> np.ndarray:
    place = sums & sums.dtype.type((1 << BITS) - 1)
    return (bitmap[place >> sums.dtype.type(3)] >> (place & sums.dtype.type(7)).astype(np.uint8)) & np.uint8(1) == 1


def neighbours(words: list[str], letters: np.ndarray, bitmap: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of words, both keys) of every distinct candidate that the bitmap doesn't rule out."""
    alphabet = letters.astype(np.uint64)
    for places in by_length(words):
        codes = coded([words[i] for i in places])
        count, n = codes.shape
        lanes, at = [Sums(lane, codes) for lane in range(3)], np.array(places)
        p = np.uint32(PRIMES[0])
        # Of a run of one letter, only the first goes, and a letter comes only before it.
        first = np.concatenate([np.ones((count, 1), bool), codes[:, 1:] != codes[:, :-1]], 1)
        w, i = np.nonzero(first)
        ok = marked(bitmap, lanes[0].deleted(w, i))
        w, i = w[ok], i[ok]
        yield at[w], *keys([x.deleted(w, i) for x in lanes], n - 1)
        for edit, slots, length in (("replace", n, n), ("insert", n + 1, n + 1)):
            step = max(1, AT_ONCE // (count * len(alphabet)))
            for begin in range(0, slots, step):
                i = np.arange(begin, min(slots, begin + step))
                every = np.arange(count)[:, None]
                rest = lanes[0].left(edit, every, i[None]).astype(np.uint32)
                new = lanes[0].placed(i[:, None], alphabet[None]).astype(np.uint32)
                sums = rest[:, :, None] + new[None]
                sums = np.minimum(sums, sums - p)  # both parts lie below p, so at most one p is too much
                ww, ii, aa = np.nonzero(marked(bitmap, sums))
                ii, letter = ii + begin, alphabet[aa]
                if edit == "replace":
                    ok = codes[ww, ii] != letter
                else:
                    ok = (ii == 0) | (codes[ww, np.maximum(ii, 1) - 1] != letter)
                ww, ii, letter = ww[ok], ii[ok], letter[ok]
                if not len(ww):
                    continue
                found = [(x.left(edit, ww, ii) + x.placed(ii, letter)) % x.p for x in lanes]
                ok = marked(bitmap, found[1])
                yield at[ww[ok]], *keys([x[ok] for x in found], length)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of ``words`` (word, n, k1, k2) that one edit parts, in both directions."""
    spark, low = words.sparkSession, (1 << 31) - 1
    letters = sorted(ord(r[0]) for r in words.select(F.explode(F.array_distinct(F.split("word", "")))).distinct().collect() if r[0])
    places = words.select(F.explode(F.array(F.col("k1").bitwiseAND(low), F.shiftright("k1", 31))).alias("s")).select((F.col("s").bitwiseAND((1 << BITS) - 1) + 1).alias("s"))
    parts = places.groupBy(F.bitmap_bucket_number("s").alias("i")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    bitmap = np.zeros(1 << BITS - 3, np.uint8)
    for r in parts:
        bitmap[(r["i"] - 1) * 4096 : r["i"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast((np.array(letters, np.int64), bitmap))

    def candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, bitmap = shared.value
        for frame in frames:
            of = frame["word"].to_numpy()
            for at, k1, k2 in neighbours(of.tolist(), letters, bitmap):
                if len(at):
                    yield pd.DataFrame({"word": of[at], "k1": k1, "k2": k2})

    # Words are dealt evenly: making candidates costs far more than reading words.
    dealt = words.select("word").repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "word")
    emitted = dealt.mapInPandas(candidates, "word string, k1 bigint, k2 bigint")
    return emitted.join(words.select("k1", "k2", F.col("word").alias("near"), F.col("n").alias("near_n")), ["k1", "k2"]).select("word", "near", "near_n")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of ``links`` (word, form): a word's form's form's ... form. Each round doubles the steps taken."""
    now = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(spread_join(now, ahead, "root", "word", "inner").select("word", "next"), "ahead")
        if new.isEmpty():
            discard(new)
            return now
        new_now = written(now.join(new, "word", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        discard(now, new)
        now = new_now


def spelling_variants(words: DataFrame) -> DataFrame:
    """``words`` (word, n; words are distinct) with ``n_near``, ``form``, ``form_n`` and ``root``."""

    @F.pandas_udf("k1 bigint, k2 bigint")
    def keyed(of: pd.Series) -> pd.DataFrame:
        k1, k2 = word_keys(of.tolist())
        return pd.DataFrame({"k1": k1, "k2": k2})

    known = written(words.select("word", "n", keyed("word").alias("k")).select("word", "n", "k.k1", "k.k2"), "words")
    best = near_words(known).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    taken = -F.col("best.less") >= 2 * F.col("n")
    found = known.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")
    )
    found = written(found, "forms")
    discard(known)
    return found.join(roots(found.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_neighbourhood_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(vocabulary(read_table(spark, sf_dir, "documents"), noise=NOISE))


CODES = "flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || low, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x) - 64] END))"

OP13_SQL = f"""
WITH RECURSIVE
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
l AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT low, n, {CRC32.format(codes=CODES)} AS h FROM l),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(low, 1, h % length(low)) || substr(low, h % length(low) + 2) ELSE low END AS word, sum(n)::BIGINT AS n
      FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
k AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
cut AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM k),
hole AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS pattern FROM k),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM hole a JOIN hole b ON a.pattern = b.pattern AND a.word <> b.word
         UNION SELECT a.word, w.word, w.n FROM cut a JOIN w ON w.word = a.short
         UNION SELECT w.word, a.word, a.n FROM cut a JOIN w ON w.word = a.short),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
      FROM w LEFT JOIN best ON best.word = w.word),
climb AS (SELECT word, word AS at FROM f UNION ALL SELECT climb.word, f.form FROM climb JOIN f ON f.word = climb.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, climb.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN climb ON climb.word = f.word JOIN f AS top ON top.word = climb.at AND top.form IS NULL
"""
