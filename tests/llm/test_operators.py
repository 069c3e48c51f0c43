"""The operators against plain versions: on the small tables, and on rows that are odd in every way."""

import base64
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import corpus_pipeline
from sigspark.llm import byte_bpe, components, exact_dedup, near_dedup, packing, pii, quality_classifier, quality_rules, sharding, token_counts, url_filter

from . import brute

LONG = "the of and thing. " * 4000
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (5, "word"), (None, "word"), (None, None), (7, LONG), (8, LONG + "more"), (9, "a" * 30_000),
    (10, "Éa ñÇ ΣΑΣ İx é don't <|endoftext|>!! ▁x  y z 12 3."), (11, "one two three four five six seven eight"), (12, "mail a.b@c.example, +1 (504) 555-2652; 10.0.0.1 4111 1111 1111 1111"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string")
    return df.withColumns({"n_tokens": F.lit(1), "Kept": F.lit("x"), "size": F.lit(None).cast("int"), "spans": F.lit(0)})


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def both(docs, odd, run):
    """Rows of ``run`` for either table, and for an empty one."""
    assert run(odd.limit(0)).count() == 0
    return [r for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text", "Kept")) for r in run(df).collect()]


def test_token_counts(docs, odd):
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in both(docs, odd, token_counts.count_tokens):
        assert r.n_tokens == len(model.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode())


def test_byte_bpe(docs, odd):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in both(docs, odd, lambda df: byte_bpe.decode(byte_bpe.encode(df))):
        assert bytes(r.ids) == brute.ids32(library.encode_ordinary(r.text or "")) and bytes(r.decoded) == (r.text or "").encode()


def test_packing(docs, odd):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for df in (docs.select("doc_id", "text"), odd.where("doc_id IS NOT NULL AND doc_id <> 5")):
        want = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [1] for r in df.collect()}
        pieces = packing.pack(df).toPandas()
        for i, g in pieces.sort_values(["doc_id", "start"]).groupby("doc_id"):
            assert b"".join(g["ids"]) == brute.ids32(want.pop(i)) and (g["start"] == g["length"].cumsum() - g["length"]).all()
        assert not want
        totals = pieces.groupby("sequence_id")["length"].sum()
        assert totals.max() <= 2048 and all(n == 2048 or n & (n - 1) == 0 for n in totals)
        ordered = pieces.sort_values(["sequence_id", "offset"])
        assert (ordered["offset"] == ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"]).all()


def test_hilbert_neighbours():
    grid = np.array([[x, y] for x in range(8) for y in range(8)])
    path = grid[np.argsort(packing.hilbert_key(grid, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_exact_dedup(docs, odd):
    for df in (docs.select("doc_id", "text"), odd):
        rows = exact_dedup.exact_dedup(df).collect()
        best, size = {}, {}
        for r in df.collect():
            t = r.text or ""
            best[t] = max(best.get(t, -1), -1 if r.doc_id is None else r.doc_id)
            size[t] = size.get(t, 0) + 1
        assert len(rows) == sum(size.values()) and sum(r.kept for r in rows) == len(size)
        assert all((r.keep_id, r.group_size) == (best[r.text or ""], size[r.text or ""]) for r in rows)


def test_distinct_texts_pass_whole(odd):
    """Rows that stay, with the columns they came with, those named as the operator's own among them."""
    df = odd.withColumns({"__row": F.lit(3), "keep_id": F.lit("x")})
    kept = exact_dedup.distinct_texts(df)
    assert kept.columns == df.columns and kept.count() == len({r.text or "" for r in odd.collect()})
    assert {r["keep_id"] for r in kept.collect()} == {"x"}


def test_failed_batch_is_run_again(spark, odd, monkeypatch):
    """A job that dies between its append and its read gives the same verdicts when it is run again."""
    want = sorted(map(str, exact_dedup.exact_dedup(odd).collect()))
    index = exact_dedup.DigestIndex(spark, buckets=4)
    monkeypatch.setattr(exact_dedup.DigestIndex, "rows", lambda self: (_ for _ in ()).throw(RuntimeError("lost")) if self.spark.table(self.table).count() else self.spark.table(self.table))
    with pytest.raises(RuntimeError):
        exact_dedup.exact_dedup(odd, index, batch="monday")
    monkeypatch.undo()
    assert sorted(map(str, exact_dedup.exact_dedup(odd, index, batch="monday").collect())) == want
    assert exact_dedup.exact_dedup(odd, index, batch="tuesday").where("kept").count() == 0
    index.close(delete=True)


def test_index_remembers(spark, odd):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    assert exact_dedup.exact_dedup(odd, index).where("kept").count() > 0
    assert exact_dedup.exact_dedup(odd, index).where("kept").count() == 0


def test_near_dedup(docs, odd):
    for k, tau in ((3, 85), (5, 80)):
        for df in (docs.select("doc_id", "text"), odd.where("doc_id IS NOT NULL")):
            want = brute.components([(r.doc_id, r.text) for r in df.collect()], k, tau)
            for r in near_dedup.near_components(df, k, (tau, 100)).collect():
                assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert near_dedup.near_components(odd.limit(0)).count() == 0


def test_near_dedup_in_many_blocks(spark, monkeypatch):
    """Revisions of a few texts, each some words from the last, so that bands hold several components and many blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 4)
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(3):
        words = [f"w{x}" for x in rng.integers(0, 400, 120)]
        for _ in range(60):
            words = list(words)
            for place in rng.integers(0, len(words), int(rng.integers(1, 6))):
                words[place] = f"w{rng.integers(0, 400)}"
            rows.append(" ".join(words))
    ids = rng.permutation(len(rows)).tolist()
    rows = [*zip(ids, rows), (None, rows[0]), (None, rows[0]), (ids[3], "another text with the same id as a revision")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for k, tau in ((3, 85), (5, 80)):
        want = brute.components([r for r in rows[:-3]], k, tau)
        assert 3 < len({root for _, root in want.values()}) < 170
        found = near_dedup.near_components(docs, k, (tau, 100)).collect()
        assert len(found) == len(rows)
        for r in found:
            assert (r.component_id, r.kept) == ((want[r.doc_id][1], r.doc_id == want[r.doc_id][1]) if r.doc_id is not None else (None, True))
    kept = near_dedup.keep_one_of_each(docs).collect()
    assert sum(r.doc_id is None for r in kept) == 2


def test_components_of_long_chains(spark):
    rng = np.random.default_rng(5)
    chains = [rng.permutation(1000).tolist(), [1000, *range(1999, 1000, -1)], [*range(2000, 2300)]]
    found = {r.node: r.label for r in components.connected_components(spark.createDataFrame([e for c in chains for e in zip(c, c[1:])], "a bigint, b bigint")).collect()}
    up = list(range(2300))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for c in chains:
        for a, b in zip(c, c[1:]):
            low, high = sorted((root(a), root(b)))
            up[high] = low
    assert found == {i: root(i) for i in range(2300)}
    with pytest.raises(RuntimeError):
        components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a bigint, b bigint"), rounds=2)


def test_quality_rules(spark, sf_dir, docs, odd):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for r in both(docs, odd, lambda df: quality_rules.judge(df, labels=labels)):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality_counts(r.text)
        assert not (r.kept and r.base_failed)


def test_personal_data(spark, docs, odd):
    model = pii.fit_pii(spark)
    for r in both(docs, odd, lambda df: pii.find_spans(df, model)):
        base = [tuple(s) for s in r.base]
        assert base == brute.base_spans(r.text) and set(base) <= {tuple(s) for s in r.spans}
    text = spark.createDataFrame([(1, "Call: (504) 555-2652 or jane.doe (at) river (dot) example, a@b.example")], "doc_id bigint, text string")
    assert pii.redact(text, model).first().text == "Call: <PHONE> or <EMAIL>, <EMAIL>"


def test_whole_words_are_scored(spark):
    good, junk = (" ".join(a + b for a in lead for b in ("ing", "tion", "ed")) for lead in (("walk", "read", "build", "farm"), ("zzqx", "kkvw", "xxjq", "wwpz")))
    docs = spark.createDataFrame([(i, good if i < 20 else junk) for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id bigint, quality int")
    score = {r.doc_id: r.score for r in quality_rules.judge(docs, labels=labels).collect()}
    assert score[15] > score[25] + 1000


def test_every_trusted_document_counts(spark):
    # All are trusted, so both multinomials are equal.
    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"))
    judged = quality_rules.judge(docs, labels=docs.select("doc_id", F.lit(1).alias("quality")))
    assert judged.where("score <> 0").count() == 0


def test_every_loose_address_passes_its_gate(spark):
    at = [" at ", "@", *[f"{a}{x}{b}" for x in ("@", "(at)", "[at]", "{at}") for a in ("", " ") for b in ("", " ")]]
    dot = [".", " dot ", *[f"{a}{x}{b}" for x in ("(dot)", "[dot]", "{dot}") for a in ("", " ") for b in ("", " ")]]
    rows = spark.createDataFrame([(f"jane.doe{a}river{d}example",) for a in at for d in dot], "text string").withColumn("__text", F.col("text"))
    fits = rows.where(F.regexp("text", F.lit(pii.LOOSE["email"])))
    assert fits.count() == (len(at) - 1) * len(dot) + 9  # after " at " no plain dot and no curly one
    assert pii.with_candidates(fits).where(~F.exists("__all", lambda c: (c["kind"] == "email") & (c["found"] == F.col("text")))).count() == 0


def test_classifier(spark, sf_dir, docs, odd):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.fit_on_labels(docs, labels)
    scores = {r.doc_id: r.score for r in quality_classifier.classify(docs, model).collect()}
    held = [(r.quality, scores[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good, bad = ([s for q, s in held if q == v] for v in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.9
    assert quality_classifier.classify(odd, model).where("score BETWEEN 0 AND 1").count() == len(ODD)


def test_sharding(docs, odd):
    for df in (docs.select("doc_id", "text"), odd):
        rows = sharding.shard(df).toPandas()
        counts = rows.groupby("shard").size()
        assert len(rows) == df.count() and counts.max() - counts.min() <= 1
        assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in rows.groupby("shard"))
    assert sharding.shard(odd.limit(0)).count() == 0


@pytest.fixture
def sixteen(spark):
    """16 tasks a shuffle, which Spark must not even out by itself."""
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("hot", ["null, cast(null as string)", "7, 'one text'", "id, 'one text'"])
def test_copies_fill_all_tasks(spark, sixteen, monkeypatch, hot):
    """A third of the rows repeat each other, with and without an id: no task gets much more than the others."""
    monkeypatch.setattr(sharding, "ROWS_PER_TASK", 64)
    few = spark.range(13_333).selectExpr(*[f"{x} AS {n}" for n, x in zip(("doc_id", "text"), hot.split(", ", 1), strict=True)])
    docs = few.unionByName(spark.range(100_000, 126_667).selectExpr("id AS doc_id", "concat('text ', id) AS text")).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    for found in (sharding.shard(docs), exact_dedup.exact_dedup(docs)):
        sizes = sorted(r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect())
        assert sum(sizes) == 40_000 and len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]
    assert exact_dedup.exact_dedup(docs).where("kept").count() == 26_668
    rows = sharding.shard(docs).toPandas()
    assert all(sorted(g["slot"]) == list(range(5000)) for _, g in rows.groupby("shard"))


def test_sharding_does_not_depend_on_partitions(spark, docs, odd):
    told = lambda df: sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard(df).collect())
    odd = odd.select("doc_id", "text")
    both = docs.select("doc_id", "text").unionByName(odd).unionByName(odd)
    assert told(both) == told(both.repartition(9))


def test_url_filter(spark):
    rows = [(1, "https://A.example.ORG/es/1?x"), (2, None), (3, "no scheme"), (4, "http://x.com/fr/2"), (5, "http://x.com"), (6, "https://cheap-pills.example.net/en/3"), (7, "https://therin.example.net/en/3")]
    good = [f"https://{w}.example.net/en/{i}" for i in range(40) for w in ("thering", "ondthe", "athere")]
    bad = [f"https://{w}.example.net/en/{i}" for i in range(40) for w in ("casino-win", "free-bets", "cheap-pills")]
    model = url_filter.fit_urls(url_filter.seed_labels(spark.createDataFrame([(u,) for u in good + bad], "url string")))
    found = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string"), url_filter.RULES, model).collect()}
    assert (found[1].host, found[1].path, found[1].rule, found[1].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert (found[2].host, found[3].path, found[4].verdict, found[5].rule) == ("", "", "allow", None)
    assert (found[6].verdict, found[7].verdict) == ("block", "allow")


def test_urls_without_scheme_keep_their_features(spark):
    labelled = [(f"{c * n}", int(c == "7")) for c in "a7" for n in range(20, 60)]
    model = url_filter.fit_urls(spark.createDataFrame(labelled, "url string, label int"))
    rows = spark.createDataFrame([(1, "a" * 33), (2, "7" * 33)], "page_id bigint, url string")
    found = {r.page_id: r for r in url_filter.judge_urls(rows, url_filter.RULES, model).collect()}
    assert (found[1].verdict, found[2].verdict) == ("allow", "block") and {r.host + r.path for r in found.values()} == {""}


def test_long_rule_lists(spark):
    hosts = ["org", "example.org", "a.example.org", "b.org", "com", "x.com", "deep.a.b.x.com", "", "net."]
    paths = ["", "/", "/a", "/a/", "/a/b", "/é", "/a/b/c/d"]
    rules = [(("allow", "block")[(i + j) % 2], h, p) for i, h in enumerate(hosts) for j, p in enumerate(paths)]
    rules += [("block", "com", "/"), ("allow", "b.org", "/a")] + [("block", f"h{i}.example", f"/{i % 7}") for i in range(url_filter.MAX_RULES)]
    urls = [f"http://{h}{p}{t}" for h in (*hosts, "EXAMPLE.org", "xorg", "z.y.x.com", "net", "h7.example", "s.h14.example") for p in (*paths, "/0", "/ab") for t in ("", "?q=1", "x")]
    urls += [None, "", "no scheme", "http://" + "a." * 3000 + "com/" + "a/" * 3000] + ["http://x.com/a"] * 500
    rows = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)], "page_id bigint, url string, `Rule` string").repartition(5)
    model = url_filter.UrlModel([], [[0.0] * url_filter.BUCKETS] * 2)
    found = url_filter.judge_urls(rows, rules, model).collect()
    assert sorted(r.page_id for r in found) == list(range(len(urls)))
    for r in found:
        fit = [x for x in rules if (r.host == x[1] or r.host.endswith("." + x[1])) and r.path.startswith(x[2])]
        best = max(fit, key=lambda x: (len(x[1] + x[2]), x), default=None)
        assert (r.rule, r.verdict) == ((best[1] + best[2], best[0]) if best else (None, "allow")), urls[r.page_id]
    few = url_filter.judge_urls(rows, url_filter.RULES, model)
    table = spark.createDataFrame(url_filter.RULES, "action string, host string, path string")
    assert sorted(few.collect()) == sorted(url_filter.judge_urls(rows, table, model).collect())
    none = url_filter.judge_urls(rows, table.limit(0), model)
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "allow")}
    assert url_filter.judge_urls(rows.limit(0), table, model).count() == 0


def test_pipeline(spark, sf_dir, docs):
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, step = step, corpus_pipeline.written(stage(spark, step, sf_dir), name)
        assert step.columns == docs.columns and 0 < step.count() <= before.count()
        if name == "exact_dedup":
            assert step.count() == before.select("text").distinct().count()
    assert packing.pack(step).select("doc_id").distinct().count() == step.count()


def test_windows_are_sorted_once(docs):
    """Twice a document at most: windows by their hashes, and twins by their places; no expression that sorts stands inside another one twice."""
    plan = quality_rules.judge(docs, weights=F.array(F.lit(0)))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("sort_array|array_sort|arraysort", plan)) == 2


def test_words_are_learned_once():
    """Words that are their own lower-case letters are learned as such, with nothing put together again; all letters of Latin-1 are the library's."""
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = packing.Encoder(path)
    encoder.ids("word stra\u00dfe")
    assert set(encoder.memo) == {"word", "stra\u00dfe"}
    letters = [chr(c) for c in range(256) if chr(c).isalpha()]
    texts = [*letters, " ".join(a + b for a in letters for b in letters), "\u00d1AND\u00da! \u00f1and\u00fa, Word WORD. " + "\u00c9" * 99 + "!"]
    library = Tokenizer.from_file(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.each(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
