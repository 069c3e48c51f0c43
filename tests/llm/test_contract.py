"""The registered queries, by name, on a small fixture with odd rows: columns, types and values against plain versions."""

import base64
import math
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import __spark_entry__ as entry

from . import brute
from .test_operators import ODD

BLANKS = " " * 1_200_000 + "a"
URLS = [(1, "https://A.example.ORG/es/1?x"), (2, None), (3, "no scheme"), (4, "http://x.com/fr/2"), (5, "http://x.com"), (None, "http://b.example.org/en/12#y"), (6, "http://org"), (6, "http://a.org/en/1")]


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id BETWEEN 100 AND 219")
    odd = spark.createDataFrame([*ODD, (20, BLANKS)], "doc_id bigint, text string")
    docs.unionByName(odd).withColumns({"n_tokens": F.lit("x"), "Kept": F.lit(1)}).write.parquet(f"{place}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame(URLS, "page_id bigint, url string").withColumn("host", F.lit("x")).write.parquet(f"{place}/pages.parquet")
    return place


@pytest.fixture(scope="module")
def rows(spark, tables):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]


def run(spark, tables, number):
    name = next(n for n in entry.queries() if n.startswith(f"op{number}_"))
    return entry.queries()[name](spark, tables)


def bag(found, *columns):
    return Counter(tuple(r[c] for c in columns) for r in found.collect())


def types(df, *columns):
    return [df.schema[c].dataType.simpleString() for c in columns]


def test_op1(spark, tables, rows):
    found = run(spark, tables, 1)
    assert types(found, "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset") == ["bigint"] * 7
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(i, library.encode(t, add_special_tokens=False).ids + [1]) for i, t in rows]
    pieces = found.collect()
    # Rows of one id can't be told apart, so the starts of each id are held against all its rows together.
    tokens = Counter()
    for i, x in ids:
        tokens[i] += len(x)
    got = Counter()
    for r in pieces:
        got[r.doc_id] += r.length
    assert got == tokens
    single = {i: x for i, x in ids if sum(j == i for j, _ in ids) == 1}
    assert all(r.ids_crc32 == zlib.crc32(brute.ids32(single[r.doc_id][r.start : r.start + r.length])) and r.doc_tokens == len(single[r.doc_id]) for r in pieces if r.doc_id in single)


def test_op2(spark, tables):
    found = {(r.page_id, r.host, r.path): r for r in run(spark, tables, 2).collect()}
    want = {
        (1, "a.example.org", "/es/1"): ("example.org/es/", "block"), (4, "x.com", "/fr/2"): ("com/fr/", "allow"), (None, "b.example.org", "/en/12"): ("example.org/en/1", "block"),
        (6, "org", ""): (None, None), (6, "a.org", "/en/1"): ("org/", "allow"), (2, "", ""): (None, None), (3, "", ""): (None, None), (5, "x.com", ""): (None, None),
    }
    assert found.keys() == want.keys()
    for key, (rule, verdict) in want.items():
        r = found[key]
        assert r.rule == rule and r.verdict == (verdict or ("block" if r.score > 0.5 else "allow"))


def test_op3(spark, tables, rows):
    found = run(spark, tables, 3)
    assert types(found, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans") == ["bigint"] * 4 + ["string"] * 2
    want = Counter()
    for i, t in rows:
        spans = brute.base_spans(t)
        want[(i, *[sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")], brute.sha(brute.span_digest(spans).encode()))] += 1
    assert bag(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want


def test_op4_and_op7(spark, tables, rows):
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((i, len(t.encode()), n := len(model.encode(t)), n > 4096) for i, t in rows)
    assert bag(run(spark, tables, 4), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    # The library runs out of stack on the long run of spaces, of which all but the last are one match.
    ids = [(i, t, library._encode_single_piece(" " * 1_199_999) + library.encode_ordinary(" a") if t == BLANKS else library.encode_ordinary(t)) for i, t in rows]
    want = Counter((i, len(x), brute.sha(brute.ids32(x)), brute.sha(t.encode())) for i, t, x in ids)
    assert bag(run(spark, tables, 7), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_op5(spark, tables, rows):
    found = run(spark, tables, 5)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert bag(found, "doc_id", *names) == Counter((i, *brute.quality_counts(t)) for i, t in rows)
    trusted = {r.doc_id for r in spark.read.parquet(f"{tables}/labels.parquet").where("quality = 1").collect()}
    size = 1 << 16
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    number = lambda x, seed=42: xxhash.xxh64_intdigest(struct.pack("<q", x), seed)

    def grams(t):
        hashes = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in brute.words(t)]
        return [h % size for h in hashes] + [signed(number(b, number(a))) % size for a, b in zip(hashes, [*hashes[1:], 0])]

    of = [(i, grams(t)) for i, t in rows]
    everyone, target = Counter(g for _, x in of for g in x), Counter(g for i, x in of if i in trusted for g in x)
    log_p = lambda n, total: math.log((n + 1) / (total + size))
    totals = target.total(), everyone.total()
    weight = [round(1000 * (log_p(target[g], totals[0]) - log_p(everyone[g], totals[1]))) for g in range(size)]
    score = Counter((i, round(sum(weight[g] for g in x) / max(1, len(x)), 6)) for i, x in of)
    assert Counter((r.doc_id, round(r.score, 6)) for r in found.collect()) == score
    assert all(r.kept == (not r.base_failed and r.score >= -200) for r in found.collect())


def test_op6(spark, tables, rows):
    found = run(spark, tables, 6).collect()
    assert Counter((r.doc_id, r.held_out) for r in found) == Counter((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in found)
    assert all(r.score == 0 for r in found if r.doc_id in (1, 2, 3))


def test_op8_to_op10(spark, tables, rows):
    want = brute.components([r for r in rows if r[0] is not None and r[1] != BLANKS], 3, 85) | {20: (1, 20)}
    found = run(spark, tables, 8)
    assert types(found, "doc_id", "n_shingles", "component_id", "kept") == ["bigint"] * 3 + ["boolean"]
    for r in found.collect():
        assert r.doc_id is None or (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    shards = run(spark, tables, 9)
    assert bag(shards, "doc_id", "size", "text_crc32", "law", "grown_shard") == Counter((i, len(t.encode()) + 1, brute.crc(t), "rows", None) for i, t in rows)
    top, size = {}, Counter(t for _, t in rows)
    for i, t in rows:
        top[t] = max(top.get(t, -1), -1 if i is None else i)
    assert bag(run(spark, tables, 10), "doc_id", "keep_id", "group_size", "text_sha256") == Counter((i, top[t], size[t], brute.sha(t.encode())) for i, t in rows)


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "pages"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for number in (1, 2, 4, 5, 6, 7, 9, 10):
        assert run(spark, str(tmp_path), number).count() == 0, number
