"""The prefix trie of conversations, with subtree sums by heavy-path decomposition.

A node is a distinct sequence of first turns. It is known by its depth and a 128-bit sum of its turns' hashes, each
salted with its place, so that prefixes are running sums and a conversation of any length may be cut into blocks.
Every node's heavy child is the one that most conversations pass (of equals that with the smallest ``conv_id``). A leaf's
path climbs as long as nodes are heavy children, so every node lies on one path, and along one conversation all
paths are found by their light nodes alone: no walk from node to node is needed. A path's level is the number of light
nodes above it; a light child holds at most half its parent's conversations, so levels are logarithmic in
their number. Level by level, the lowest first, whole paths' sums are attached to the nodes they hang from; then one suffix
sum along each path gives every node its subtree.

Skew: turns are numbered by range-sorted parts, not conversation by conversation; prefixes and paths run in blocks
of ``BLOCK`` turns with one row a block carried between them; a node that very many conversations share (the root) and a
conversation of very many turns meet their tables dealt by salts (``spread_join``). The ids that end at one node are
put together in blocks of 65,536 id values; SHA-256 is sequential, so the blocks of one node stream through one
worker, which holds a batch of them at a time.

Defined results: rows without ``conv_id`` belong to no conversation; null turns come first, ties in ``turn`` are ordered
by the SHA-256 of role and text, and repeated rows count as often as they occur; null roles and texts are empty.
Remainders have the sign of ``conv_id``, as in SQL. An empty table gives no node, not even the root.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, read_table, spread_join, text_of, written

BLOCK = 4096
#: Turns that a conversation may take from the first of its hundred, and how many conversations share one.
SHARED, FAMILY = 5, 100
IDS = 1 << 16
LANE = 0xFFFFFFFF


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(c, n, total, digest, chars): the turns of each conversation, from 1, and how many it has. Written.

    Rows are sorted by ranges; a row's number is its place in its range and what earlier ranges hold of
    its conversation, so that no conversation has to fit one task. Texts stay where they are: digests are sorted.
    """
    role = text_of("role")
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text_of()), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("c"), "turn", digest.alias("digest"), F.length(text_of()).cast("bigint").alias("chars"), F.monotonically_increasing_id().alias("nth")
    )
    dealt = rows.repartitionByRange(parts_of(rows), "c", "turn", "digest", "nth").sortWithinPartitions("c", "turn", "digest", "nth")
    placed = written(dealt.select("c", "digest", "chars", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "places")
    shares = placed.groupBy("part", "c").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("m"))
    whole = Window.partitionBy("c")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select("part", "c", (F.coalesce(F.sum("m").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"), F.sum("m").over(whole).alias("total"))
    out = written(placed.join(shares, ["part", "c"]).select("c", (F.col("place") + F.col("shift")).alias("n"), "total", "digest", "chars"), "turns")
    discard(placed)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows (c, depth, length, digest, chars), conversations (c, length)) in which conversation c begins with the first h
    turns of conversation c - c % 100 in place of its own first h; h is the checksum of c modulo 6."""
    convs = turns.where("n = 1").select("c", "total")
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % (SHARED + 1)).cast("bigint")
    heads = convs.where(F.col("c") % FAMILY == 0).select(F.col("c").alias("head"), F.col("total").alias("has"))
    known = convs.withColumns({"h": h, "head": F.col("c") - F.col("c") % FAMILY}).join(heads, "head", "left")
    known = known.withColumn("m", F.least("h", F.coalesce("has", F.lit(0))))
    known = known.withColumn("length", F.col("m") + F.greatest(F.col("total") - F.col("h"), F.lit(0)))
    known = written(known.select("c", "head", "h", "m", "length"), "known")
    # Turns of hot conversations are dealt over all tasks by their numbers.
    own = spread_join(turns, known.drop("head"), "c", "n").where("n > h").select("c", (F.col("n") - F.col("h") + F.col("m")).alias("depth"), "length", "digest", "chars")
    lent = turns.where((F.col("n") <= SHARED) & (F.col("c") % FAMILY == 0)).select(F.col("c").alias("head"), "n", "digest", "chars")
    taken = known.where("m > 0").join(lent, "head").where("n <= m").select("c", F.col("n").alias("depth"), "length", "digest", "chars")
    return own.unionByName(taken), known.select("c", "length")


def node_of(depth: Column, high: Column, low: Column) -> Column:
    return F.struct(depth.cast("bigint").alias("d"), high.alias("a"), low.alias("b"))


def prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(c, depth, length, chars, node, parent): each conversation's prefixes from the empty one on. Written."""
    lanes = ["x0", "x1", "x2", "x3"]
    one, two = (F.xxhash64(F.lit(salt), F.col("depth"), F.col("digest")) for salt in (0, 1))
    rows = rows.select(
        "c", "depth", "length", "chars", F.floor((F.col("depth") - 1) / BLOCK).alias("block"),
        *[x.alias(n) for n, x in zip(lanes, (one.bitwiseAND(LANE), F.shiftrightunsigned(one, 32), two.bitwiseAND(LANE), F.shiftrightunsigned(two, 32)), strict=True)],
    )
    rows = written(rows, "lanes")
    earlier = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("c", "block").agg(*[F.sum(x).alias(x) for x in lanes])
    before = blocks.select("c", "block", *[F.coalesce(F.sum(x).over(earlier) % (LANE + 1), F.lit(0)).alias(f"b{x}") for x in lanes])
    upto = Window.partitionBy("c", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.join(before, ["c", "block"]).select("c", "depth", "length", "chars", *lanes, *[(F.sum(x).over(upto) + F.col(f"b{x}")).alias(f"s{x}") for x in lanes])

    def key(depth: Column, sums: list[Column]) -> Column:
        a, b, c, d = [x % (LANE + 1) for x in sums]
        return node_of(depth, F.shiftleft(a, 32).bitwiseOR(b), F.shiftleft(c, 32).bitwiseOR(d))

    own = key(F.col("depth"), [F.col(f"s{x}") for x in lanes])
    # Depth 0 is the root, whose sums are 0.
    out = summed.select("c", "depth", "length", "chars", own.alias("node"), key(F.col("depth") - 1, [F.col(f"s{x}") - F.col(x) for x in lanes]).alias("parent"))
    zero = F.lit(0).cast("bigint")
    root = convs.select("c", zero.alias("depth"), "length", zero.alias("chars"), node_of(zero, zero, zero).alias("node"), F.lit(None).cast(out.schema["parent"].dataType).alias("parent"))
    out = written(out.unionByName(root), "prefixes")
    discard(rows)
    return out


def ends(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end."""
    blocks = rows.where("depth = length").groupBy("node", F.floor(F.col("c") / IDS).alias("block"))
    ids = F.array_sort(F.collect_list("c"))  # distinct ids: IDS of them at most
    pieces = blocks.agg(F.concat_ws(",", F.transform(ids, lambda c: c.cast("string"))).alias("ids"))
    pieces = pieces.select("node.*", "block", "ids")

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, digest = None, hashlib.sha256()
        for frame in frames:
            out = []
            for d, a, b, ids in zip(frame["d"], frame["a"], frame["b"], frame["ids"], strict=True):
                if (d, a, b) != node:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (d, a, b), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield pd.DataFrame(out, columns=["d", "a", "b", "ends_sha256"])
        if node:
            yield pd.DataFrame([(*node, digest.hexdigest())], columns=["d", "a", "b", "ends_sha256"])

    sorted_ = pieces.repartition(parts_of(rows), "d", "a", "b").sortWithinPartitions("d", "a", "b", "block")
    found = sorted_.mapInPandas(hashed, "d bigint, a bigint, b bigint, ends_sha256 string")
    return found.select(node_of(F.col("d"), F.col("a"), F.col("b")).alias("node"), "ends_sha256")


def heavy_paths(rows: DataFrame) -> DataFrame:
    """Every node once, on its path: (path: the conversation it follows, level, top, depth, node, parent, conv_id, n_convs,
    n_children, leaf, saved). Written."""
    leaf = F.max("length") == F.first("depth")
    nodes = rows.groupBy("node").agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), F.max("parent").alias("parent"), leaf.alias("leaf"))
    nodes = written(nodes, "nodes")
    rank = F.struct("n_convs", (-F.col("conv_id")).alias("o"), "node")
    families = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.max(rank)["node"].alias("heavy"))
    families = written(families, "families")
    known = nodes.join(families.select(F.col("parent").alias("node"), "n_children"), "node", "left")
    known = known.join(families.select(F.col("heavy").alias("node"), F.lit(True).alias("heavy")), "node", "left")
    light = F.col("heavy").isNull()
    # A leaf's path follows the smallest conversation that ends there.
    followed = nodes.where("leaf").select(F.col("conv_id").alias("c"))
    climbs = spread_join(spread_join(rows.select("c", "depth", "node"), followed, "c", "depth"), known, "node", "c")
    climbs = written(climbs.withColumn("light", light).drop("heavy"), "climbs")
    tops = climbs.groupBy("c").agg(F.max(F.when(F.col("light"), F.col("depth"))).alias("top"), (F.count_if("light") - 1).alias("level"))
    out = spread_join(climbs, tops, "c", "depth").where("depth >= top")
    saved = (F.col("n_convs") - 1) * F.col("chars")
    out = out.select(F.col("c").alias("path"), "level", "top", "depth", "node", "parent", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("leaf").cast("bigint").alias("leaf"), saved.alias("saved"))
    out = written(out, "paths")
    discard(nodes, families, climbs)
    return out


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``nodes`` with ``sum_<value>``: each value summed over the node's subtree. ``nodes`` comes from ``heavy_paths``."""
    own = nodes.groupBy("path").agg(F.max("level").alias("level"), F.max(F.when(F.col("depth") == F.col("top"), F.col("parent"))).alias("parent"), *[F.sum(v).alias(v) for v in values])
    hung = spread_join(own.where("level > 0"), nodes.select(F.col("node").alias("parent"), F.col("path").alias("host")), "parent", "path")
    hung = written(hung, "hung")
    deepest = hung.agg(F.max("level")).first()[0] or 0
    done, below = [], None
    for level in range(deepest, 0, -1):
        here = hung.where(F.col("level") == level)
        if below is not None:
            here = here.join(below, "path", "left").select("parent", "host", *[(F.col(v) + F.coalesce(f"below_{v}", F.lit(0))).alias(v) for v in values])
        done.append(written(here.select("parent", "host", *values), "level"))
        below = done[-1].groupBy(F.col("host").alias("path")).agg(*[F.sum(v).alias(f"below_{v}") for v in values])
    rows = nodes.withColumns({f"sum_{v}": F.col(v) for v in values})
    if done:
        whole = done[0]
        for other in done[1:]:
            whole = whole.unionByName(other)
        attached = whole.groupBy(F.col("parent").alias("node")).agg(*[F.sum(v).alias(f"hung_{v}") for v in values])
        rows = nodes.join(attached, "node", "left").withColumns({f"sum_{v}": F.col(v) + F.coalesce(f"hung_{v}", F.lit(0)) for v in values})
    rows = written(rows.withColumn("block", F.floor(F.col("depth") / BLOCK)), "attached")
    discard(hung, *done)
    later = Window.partitionBy("path").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("path", "block").agg(*[F.sum(f"sum_{v}").alias(f"all_{v}") for v in values])
    beyond = blocks.select("path", "block", *[F.coalesce(F.sum(f"all_{v}").over(later), F.lit(0)).alias(f"all_{v}") for v in values])
    from_here = Window.partitionBy("path", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(beyond, ["path", "block"]).select(*nodes.columns, *[(F.sum(f"sum_{v}").over(from_here) + F.col(f"all_{v}")).alias(f"sum_{v}") for v in values])


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``rows`` (c, depth, length, digest, chars) over ``convs`` (c, length), one row each:
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = prefixes(rows, convs)
    nodes = subtree_sums(heavy_paths(rows), ["leaf", "saved"])
    nodes = written(nodes.select("node", "parent", "conv_id", "depth", "n_convs", "n_children", "sum_leaf", "sum_saved"), "summed")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = spread_join(nodes.where("depth > 0"), above, "parent", "conv_id")
    root = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    found = below.unionByName(root, allowMissingColumns=True).join(ends(rows), "node", "left")
    none = hashlib.sha256(b"").hexdigest()
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("sum_leaf").alias("n_leaves"), F.col("sum_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame, share_heads: bool = False) -> DataFrame:
    """The trie of (conv_id, turn, role, text); with ``share_heads`` conversations are first rebuilt (``rebuilt``)."""
    turns = numbered_turns(conversations)
    if share_heads:
        return trie(*rebuilt(turns))
    rows = turns.select("c", F.col("n").alias("depth"), F.col("total").alias("length"), "digest", "chars")
    return trie(rows, turns.where("n = 1").select("c", F.col("total").alias("length")))


def op11_heavy_path_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read_table(spark, sf_dir, "conversations"), share_heads=True)


#: The checksum is that of zlib, bit by bit; DuckDB has no function for it.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda c, b:
    list_reduce(list_prepend(xor(c, b), range(8)), lambda k, i: xor(k >> 1, 3988292384 * (k & 1)))))"""

OP11_SQL = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS n,
                  {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x
           FROM conversations WHERE conv_id IS NOT NULL),
     k AS (SELECT c, count(*) AS total, c - c % 100 AS head,
                  {CRC32.format(codes="list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 6 AS h FROM t GROUP BY c),
     r AS (SELECT t.c, t.n - k.h + least(k.h, coalesce(f.total, 0)) AS d, t.x
           FROM t JOIN k ON t.c = k.c LEFT JOIN k AS f ON f.c = k.head WHERE t.n > k.h
           UNION ALL
           SELECT k.c, t.n, t.x FROM k JOIN t ON t.c = k.head AND t.n <= k.h),
     s AS (SELECT k.c, coalesce(list(r.x ORDER BY r.d) FILTER (r.d IS NOT NULL), []) AS s FROM k LEFT JOIN r ON r.c = k.c GROUP BY k.c),
     p AS (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM s),
     nodes AS (SELECT d AS depth, s[1:d] AS key, min(c) AS conv_id, count(*) AS n_convs,
                      coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(s) = d), '') AS ends
               FROM p GROUP BY d, s[1:d]),
     kids AS (SELECT a.depth, a.conv_id, count(b.conv_id) AS n_children, min(a.n_convs) AS n_convs
              FROM nodes a LEFT JOIN nodes b ON b.depth = a.depth + 1 AND b.key[1:a.depth] = a.key GROUP BY a.depth, a.conv_id),
     below AS (SELECT a.depth, a.conv_id, sum((b.n_convs - 1) * CASE WHEN b.depth = 0 THEN 0 ELSE length(b.key[-1].t) END)::BIGINT AS saved_tokens,
                      count(*) FILTER (q.n_children = 0) AS n_leaves
               FROM nodes a JOIN nodes b ON b.depth >= a.depth AND b.key[1:a.depth] = a.key JOIN kids q ON q.depth = b.depth AND q.conv_id = b.conv_id
               GROUP BY a.depth, a.conv_id)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, kids.n_children, below.n_leaves, below.saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN kids ON kids.depth = n.depth AND kids.conv_id = n.conv_id JOIN below ON below.depth = n.depth AND below.conv_id = n.conv_id
LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.key = n.key[1:n.depth - 1]
"""
