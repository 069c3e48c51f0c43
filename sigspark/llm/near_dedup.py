"""Near-duplicate components by HyperMinHash signatures, banding, and verification on full shingle sets.

1. A document's shingles are hashed to 64 bits. One pass of HyperMinHash puts each hash into one of
   ``REGISTERS`` buckets by its first bits and keeps the bucket's least remainder, compressed to a count of
   leading zeros (6 bits) and the ``MANTISSA`` bits that follow. Empty buckets borrow from others in a fixed order,
   so that bands of small sets are no weaker than those of large ones.
2. Documents with the same shingle set become one class, so copies cost one row from here on.
3. Bands of ``ROWS`` registers are hashed; classes that share a band are candidates. Every class is tied to
   the least class it shares a band with, those least classes to each other where they meet in a band, and the
   components of those ties are the candidate clusters.
4. A cluster is dealt into blocks of ``BLOCK_SETS`` sets or ``BLOCK_SHINGLES`` shingles; each pair of blocks is one
   group of a grouped map, which holds two blocks of sets. There a pair whose collision-corrected Jaccard estimate is far below the
   threshold is passed over, pairs already connected are skipped, and the rest are compared on their
   full sets. What leaves the group is a spanning forest of verified links, never all pairs.
5. The components of the forests give the result.

No candidate is dropped by a cap. What can be lost is a link that shares no band: with 64 bands of 8 rows a
link at similarity 0.85 is missed with probability (1 - 0.85**8)**64 < 2e-9, at 0.8 with 8e-6; and one whose
estimate is off by more than ``SIGMAS`` standard deviations. Pairs of similarity 0.4 share a band with 4 %.

Cost: the rows that leave for the groups grow with the square of a cluster's distinct sets beyond one block.

Defined results: null or blank texts have an empty set and link with nothing; texts of fewer words than a
shingle count as one shingle; repeated rows, and rows that share an id, belong to one component and have one verdict;
rows without an id link with nothing, have no component_id and are kept; an empty table gives an empty result. The
components' table has its own columns alone; ``keep_one_of_each`` returns the input's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read_table, small_batches, spread_join, written
from .components import connected_components

REGISTERS, MANTISSA, ROWS = 512, 10, 8
BANDS = REGISTERS // ROWS
BUCKET_BITS = REGISTERS.bit_length() - 1
EMPTY = 0xFFFF
SIGMAS = 6.0
#: Sets and shingles a block has (about, as sets are dealt by hashes), beyond which a cluster has more blocks.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 2_000_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash, on arrays."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word k-grams."""
    words = (text or "").encode().translate(LOWER).split()  # bytes.split() parts at the six ASCII white spaces
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    each = np.fromiter(map(digest, words), np.uint64, len(words))
    if len(words) < k:
        return np.array([digest(b" ".join(words), seed=1)], np.uint64)
    n = len(words) - k + 1
    rolled = np.zeros(n, np.uint64)
    for i in range(k):
        rolled = _mix(rolled * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n])
    return np.unique(rolled)


def registers_of(hashes: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of a set: least remainder of each bucket as leading zeros and mantissa."""
    out = np.full(REGISTERS, EMPTY, np.uint16)
    if not len(hashes):
        return out
    hashes = _mix(hashes ^ np.uint64(0x2545F4914F6CDD1D))
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bucket, (hashes << np.uint64(BUCKET_BITS)) >> np.uint64(1))  # 63 bits, so that the maximum stays free
    full = np.unique(bucket)
    rest = least[full]
    zeros = 63 - np.frexp(np.maximum(rest >> np.uint64(10), np.uint64(1)).astype(np.float64))[1] - 10  # of the upper 53 bits, exact in a double
    mantissa = ((rest << (zeros + 2).astype(np.uint64)) >> np.uint64(64 - MANTISSA)).astype(np.uint16)
    out[full] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa
    return _dense(out, full)


@lru_cache(maxsize=1)
def _probes() -> np.ndarray:
    """For each register the others, in an order of its own that is the same for all sets."""
    rng = np.random.default_rng(20_240_301)
    return np.array([rng.permutation(REGISTERS) for _ in range(REGISTERS)], np.int64)


def _dense(out: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Empty registers take the value of the first full one in their order, so that each agrees between two sets
    with the sets' similarity, also where sets are smaller than ``REGISTERS``."""
    if len(full) == REGISTERS:
        return out
    filled, empty = out != EMPTY, np.flatnonzero(out == EMPTY)
    order = _probes()
    dense = out.copy()
    for begin, end in ((0, 16), (16, REGISTERS)):
        found = filled[order[empty, begin:end]]
        hit = found.any(1)
        dense[empty[hit]] = out[order[empty[hit], begin + found[hit].argmax(1)]]
        empty = empty[~hit]
        if not len(empty):
            break
    return dense


def estimate(agree: np.ndarray, registers: int, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard from registers that agree, less those expected to agree by chance.

    Two minima of different sets share zeros and mantissa with a probability of about
    2**-MANTISSA * 2 * r / (1 + r)**2, with r the ratio of sizes: their densities overlap that much.
    """
    ratio = size_a / np.maximum(size_b, 1)
    chance = 2.0**-MANTISSA * 2 * ratio / (1 + ratio) ** 2
    share = agree / registers
    return (share - chance) / (1 - chance)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, digest, registers) of every row; the digest names the shingle set."""

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [shingle_set(t, k) for t in frame["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"].astype("Int64"),
                    "n": np.array([len(s) for s in sets], np.int64),
                    "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                    "registers": [registers_of(s).tobytes() for s in sets],
                }
            )

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(sign, "doc_id bigint, n bigint, digest binary, registers binary")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, digest, shingles: the hashes as bytes) of every row."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [shingle_set(t, k).tobytes() for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "digest": [xxhash.xxh3_128_digest(s) for s in found], "shingles": found})

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(build, "doc_id bigint, digest binary, shingles binary")


def forest_of(frame: pd.DataFrame, tau_num: int, tau_den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within each cluster of ``frame``, or between two blocks (column ``side``)."""
    frame = frame.assign(n=frame["shingles"].str.len() // 8).sort_values(["cluster", "n", "node"], ignore_index=True)
    n, side, nodes = frame["n"].to_numpy(), frame["side"].to_numpy(), frame["node"].tolist()
    regs = np.frombuffer(b"".join(frame["registers"]), np.uint16).reshape(len(frame), REGISTERS)
    shingles = frame["shingles"].tolist()
    filled = REGISTERS * -np.expm1(-np.maximum(n, 1) / REGISTERS)  # registers that are full before others borrow
    tau, tree, out = tau_num / tau_den, np.arange(len(frame)), []
    last = np.searchsorted(frame["cluster"].to_numpy(), frame["cluster"].to_numpy(), "right")
    sets: dict[int, set] = {}

    def members(i: int) -> set:
        if i not in sets:
            sets[i] = set(np.frombuffer(shingles[i], np.uint64).tolist())
        return sets[i]

    for i in range(len(frame)):
        # Within the cluster sets rise in size; the later ones are too large to reach the threshold.
        end = i + int(np.searchsorted(n[i : last[i]], n[i] * tau_den // tau_num, "right"))
        if i and last[i - 1] == i:
            sets.clear()
        if end <= i + 1:
            continue
        # Only those that no link has tied to this set yet, and between two blocks only the other block's.
        apart = tree[i + 1 : end] != tree[i]
        if side[i] >= 0:
            apart &= side[i + 1 : end] != side[i]
        others = np.flatnonzero(apart) + i + 1
        if not len(others):
            continue
        agree = (regs[others] == regs[i]).sum(1)
        guess = estimate(agree, REGISTERS, n[i], n[others])
        slack = np.maximum(0.1, SIGMAS * np.sqrt(tau * (1 - tau) / filled[i]))
        near = np.flatnonzero(guess >= tau - slack)
        for j in others[near[np.argsort(-guess[near], kind="stable")]].tolist():
            if tree[i] != tree[j]:
                common = len(members(i) & members(j))
                if tau_den * common >= tau_num * (int(n[i]) + int(n[j]) - common):
                    tree[tree == tree[j]] = tree[i]
                    out.append((nodes[i], nodes[j]))
    return out


def shared_bands(classes: DataFrame) -> DataFrame:
    """(node, key, b): a row for each band that a class shares with others; ``b`` is the least node of the band."""
    spark = classes.sparkSession
    part = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("i"), F.substring("registers", i * (2 * ROWS) + 1, F.lit(2 * ROWS)).alias("part")))
    bands = classes.select("node", F.explode(part).alias("band")).select("node", F.xxhash64("band.i", "band.part").alias("key"))
    shared = bands.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("last"), F.count(F.lit(1)).alias("m")).where("b <> last")
    shared = written(shared.select("key", "b", "m"), "bands")
    # Hot keys are dealt by salts. Each has more than 1 / most of all rows, so there are fewer than ``most``.
    most = 8 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    fair = classes.count() * BANDS // most + 1
    hot = F.broadcast(shared.where(F.col("m") > fair).select("key", F.ceil(F.col("m") / fair).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    dealt = bands.join(hot, "key", "left").select("node", "key", F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"))
    least = shared.join(hot, "key", "left").select("key", "b", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    tied = written(dealt.join(least, ["key", "salt"]).drop("salt"), "tied")
    discard(shared)
    return tied


def near_components(docs: DataFrame, k: int = 5, tau: tuple[int, int] = (80, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; ``component_id`` is the least id it can reach by links.

    ``tau``: a link has tau[1] * |intersection| >= tau[0] * |union|.
    """
    whole = written(signatures(docs, k), "signatures")
    # Copies become one class, named by its least id.
    named = whole.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest")
    classes = written(named.agg(F.min("doc_id").alias("node"), F.first("registers").alias("registers"), F.first("n").alias("n")), "classes")
    signed = written(whole.select("doc_id", "n", "digest"), "signed")
    discard(whole)

    tied = shared_bands(classes)
    # One tie for each class, to the least class of its bands; then those least classes of a band are tied to each other.
    least = tied.groupBy("node").agg(F.min("b").alias("least"))
    met = written(tied.join(least, "node").select("key", "least").distinct(), "met")
    lowest = met.groupBy("key").agg(F.min("least").alias("b"))
    ties = spread_join(met, lowest, "key", "least").select(F.col("least").alias("a"), "b").unionByName(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    clusters = connected_components(ties.where("a <> b").distinct())
    discard(tied, met)

    # Clusters of one block share groups; of others each pair of blocks is a group.
    member = clusters.join(classes, "node").select("node", "digest", F.col("label").alias("cluster"), "registers", "n")
    sizes = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("total") / BLOCK_SHINGLES), F.ceil(F.col("sets") / BLOCK_SETS), F.lit(1)).cast("int")
    sizes = written(sizes.select("cluster", "total", blocks.alias("blocks")), "clusters")
    member = written(spread_join(member, sizes.drop("total"), "cluster", "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "members")
    nodes = written(member.select(F.col("node").alias("doc_id")).distinct(), "nodes")
    # Rows of one id that have different texts keep their sets apart; repeated rows have one set.
    sets = _sets(docs.select("doc_id", "text").join(nodes, "doc_id", "left_semi"), k)
    sets = sets.groupBy(F.col("doc_id").alias("node"), "digest").agg(F.first("shingles").alias("shingles"))
    whole = (sizes.agg(F.sum("total")).first()[0] or 0) // BLOCK_SHINGLES * 8 + 8
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = member.join(sets, ["node", "digest"]).select("cluster", "node", "registers", "shingles", "blocks", "block", other)
    rows = rows.select(
        F.when(F.col("blocks") > 1, F.xxhash64("cluster")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(whole))).alias("group"),
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        "cluster",
        "node",
        "registers",
        "shingles",
        F.when(F.col("block") == F.col("other"), F.lit(-1)).otherwise((F.col("block") > F.col("other")).cast("int")).alias("side"),
    )

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(forest_of(frame, *tau), columns=["a", "b"])

    linked = connected_components(rows.groupBy("group", "low", "high").applyInPandas(verify, "a bigint, b bigint"))
    discard(sizes, member, nodes)
    # Back from classes to rows; a row's own id may name the class of another text with that id.
    component = classes.select("digest", "node").join(linked, "node", "left").select("digest", F.coalesce("label", "node").alias("component_id"))
    out = spread_join(signed, component, "digest", "doc_id", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, k: int = 5, tau: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with the columns they came with."""
    gone = near_components(docs, k, tau).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op8_hyperminhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_components(docs, k=3, tau=(85, 100))
