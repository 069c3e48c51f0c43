"""The conversation trie, toxicity and spelling variants against plain versions, also on odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.llm import conversation_trie, spelling, toxicity

TURNS = "conv_id bigint, turn bigint, role string, text string"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_sequences(rows, share):
    """conv_id -> its turns, rebuilt if ``share``; ties in turn by the digest of role and text."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [x[3:] for x in sorted(found)] for c, found in convs.items()}
    if not share:
        return turns
    out = {}
    for c, own in turns.items():
        h, head = zlib.crc32(str(c).encode()) % 6, int(c / 100) * 100
        out[c] = turns.get(head, [])[:h] + own[h:]
    return out


def plain_trie(sequences):
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    out = []

    def walk(key):
        leaves, saved = (1, 0) if not children[key] else (0, 0)
        for child in children[key]:
            a, b = walk(child)
            leaves, saved = leaves + a, saved + b
        saved += (len(members[key]) - 1) * (len(key[-1][1]) if key else 0)
        told = hashlib.sha256(",".join(map(str, sorted(ends[key]))).encode()).hexdigest()
        out.append((min(members[key]), len(key), min(members[key[:-1]]) if key else None, len(members[key]), len(children[key]), leaves, saved, told))
        return leaves, saved

    if members:
        walk(())
    return Counter(out)


def trie_of(spark, rows, share):
    df = spark.createDataFrame(rows, TURNS).withColumns({"depth": F.lit("x"), "c": F.lit(1)})
    return Counter(tuple(r[c] for c in NODE) for r in conversation_trie.conversation_trie(df, share).collect())


def drawn(seed, convs, longest, words):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant", None]), r.choice(words)) for c in convs for t in range(r.randint(0, longest))]


@pytest.mark.parametrize("share", [False, True])
def test_trie(spark, share):
    words = ["a", "bb", "", None, "é" * 7]
    rows = drawn(1, [*range(90, 130), *range(200, 260), -5, -205, 7_000_000_000], 6, words)
    rows += [(None, 1, "user", "lost"), (95, None, "user", "first"), (95, None, None, None), (96, 2, "user", "twice"), (96, 2, "user", "twice"), (300, 5, "user", "late"), (301, None, None, None)]
    assert trie_of(spark, rows, share) == plain_trie(plain_sequences(rows, share))


def test_trie_of_copies_and_a_long_conversation(spark, monkeypatch):
    """Prefixes, paths and ids in small blocks; a third of all rows in one conversation, another third in copies."""
    monkeypatch.setattr(conversation_trie, "BLOCK", 7)
    monkeypatch.setattr(conversation_trie, "IDS", 4)
    rows = [(1, i, "user", f"t{i % 11}") for i in range(120)] + [(c, i, "user", f"t{i}") for c in range(10, 40) for i in range(4)]
    rows += [(c, i, "user", f"t{i}" if i < c - 50 else f"{c}") for c in range(50, 80) for i in range(c - 48)]
    for share in (False, True):
        assert trie_of(spark, rows, share) == plain_trie(plain_sequences(rows, share))


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert trie_of(spark, [], True) == Counter()
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)  # loses its turn, and there is no head
    rows = [(c, 0, "user", "hello")]
    assert trie_of(spark, rows, True) == plain_trie({c: []})


def test_every_node_has_one_path(spark):
    """Levels are logarithmic, every node is on one path, and a path's nodes lie behind one another."""
    rows = drawn(5, range(200), 7, ["a", "b"])
    turns = conversation_trie.numbered_turns(spark.createDataFrame(rows, TURNS))
    lined = turns.select("c", F.col("n").alias("depth"), F.col("total").alias("length"), "digest", "chars")
    convs = turns.where("n = 1").select("c", F.col("total").alias("length"))
    paths = conversation_trie.heavy_paths(conversation_trie.prefixes(lined, convs)).toPandas()
    assert len(paths) == len(plain_trie(plain_sequences(rows, False))) and not paths.duplicated(["conv_id", "depth"]).any()
    assert paths["level"].max() <= np.log2(200)
    for _, g in paths.groupby("path"):
        assert sorted(g["depth"]) == list(range(g["depth"].min(), g["depth"].max() + 1)) and g["leaf"].sum() == 1


def plain_words(rows, noise):
    counts = Counter()
    for name, text in rows:
        for run in spelling.RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def variants_of(found):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()}


def test_spelling(spark):
    r = random.Random(2)
    stems = ["banana", "bananas", "Straße", "straÞe", "aaaaa", "aaaaaa", "élèves", "elèves", "house", "horse", "hoarse"]

    def word():
        w = list(r.choice(stems))
        if r.random() < 0.5:
            w[r.randrange(len(w))] = r.choice("abéÀsx")
        return "".join(w)

    rows = [(r.choice([None, 1, 2, i]), " ".join(word() for _ in range(r.randint(0, 60))) + r.choice(["", "!", "\n9"])) for i in range(60)]
    rows += [(3, None), (4, ""), (4, ""), (5, "x" * 3000 + " " + "x" * 2999 + "y"), (6, "x" * 3000), (7, "x" * 3000 + " " + ("x" * 2999 + "y ") * 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"n": F.lit("x"), "word": F.lit(0)})
    for noise in (None, 3):
        words = plain_words(rows, noise)
        assert len(words) > 10
        found = spelling.spelling_variants(spelling.vocabulary(df, noise=noise))
        assert found.count() == len(words) and variants_of(found) == plain_variants(words)
    assert spelling.spelling_variants(spelling.vocabulary(df.limit(0))).count() == 0


def test_long_chains_of_forms(spark):
    words = {"abcde" + "f" * i: 3 * 2**i for i in range(12)}
    found = spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n bigint"))
    assert variants_of(found) == plain_variants(words) and {r.root for r in found.collect()} == {"abcde" + "f" * 11}


def test_neighbourhoods_are_whole_and_distinct():
    """Every deletion, replacement and insertion once, for a bitmap that rules nothing out."""
    letters = np.array([ord(c) for c in "abc"], np.int64)
    everything = np.full(1 << spelling.BITS - 3, 255, np.uint8)
    for w in ("abc", "aab", "aaaa", "bacab"):
        got = [k for _, k1, k2 in spelling.neighbours([w], letters, everything) for k in zip(k1.tolist(), k2.tolist(), strict=True)]
        want = {w[:i] + w[i + 1 :] for i in range(len(w))}
        want |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "abc"} - {w}
        want |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "abc"}
        k1, k2 = spelling.word_keys(sorted(want))
        assert len(got) == len(set(got)) and set(got) == set(zip(k1.tolist(), k2.tolist(), strict=True))


INSULTS = {"en": "zorkhead", "de": "quatschig", "fr": "vlanbête"}


def labelled(spark, n=900):
    r = random.Random(4)
    calm = [f"{a}{b}" for a in ("wa", "lo", "mi", "ter", "son") for b in ("ra", "nel", "dor", "pin", "vas", "kel")]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(calm) for _ in range(r.randint(15, 60))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), INSULTS[r.choice(list(INSULTS))] + r.choice(["", "s", "!!"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"), dict(labels)


def test_toxicity(spark):
    docs, labels, truth = labelled(spark)
    held = {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    # What the held-out labels say must not matter.
    model = toxicity.fit_on_labels(docs, labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    odd = spark.createDataFrame([(None, None), (None, " \n\t"), (-1, ""), (-2, "wara zorkhead lonel, you zorkhead! wara zorkhead " * 3), (-3, "z0rkhead zzzorkhead wara you z0rkh3ad " * 4), (-4, "x" * 1_000_000)], docs.schema)
    both = docs.unionByName(odd).withColumns({"Score": F.lit("x"), "held_out": F.lit(0)})
    found = toxicity.classify(both, model)
    assert [c.lower() for c in found.columns].count("score") == 1
    rows = found.collect()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == len(truth) + 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    right = [by_id[i].predicted == truth[i] for i in held]
    assert sum(right) / len(right) > 0.98
    assert all(r.score == 0 for r in rows if not (r.text or "").split())
    assert by_id[-2].predicted == 1 and by_id[-3].score > 0.5 and by_id[-4].predicted == 0
    again = toxicity.fit_on_labels(docs.repartition(7), labels.repartition(3))
    assert again.lexicon == model.lexicon and np.array_equal(again.chances, model.chances) and again.trees == model.trees


def test_scores_by_a_plain_version(spark):
    docs, labels, _ = labelled(spark, 300)
    model = toxicity.fit(docs, labels)
    boundaries = list(zip(model.margins.tolist(), model.chances.tolist(), strict=True))

    def value(tree, x):
        while not isinstance(tree, float):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    for r in toxicity.classify(docs, model).limit(60).collect():
        x = toxicity.Scorer(model.lexicon).features(r.text)
        margin = sum(w * value(t, x) for w, t in model.trees)
        below, above = [b for b in boundaries if b[0] <= margin], [b for b in boundaries if b[0] > margin]
        if not below or not above:
            want = (below[-1] if below else above[0])[1]
        else:
            (a, p), (b, q) = below[-1], above[0]
            want = p + (q - p) * (margin - a) / (b - a)
        assert abs(r.score - want) < 1e-9


def test_features(spark):
    s = toxicity.Scorer({"zorkhead": 4.0, "quat-": 3.5, "wara": 1.0})
    x = dict(zip(toxicity.NAMES, s.features("You zorkhead!! quatschig WARA w4ra z0rkhead a b c d e f zorkheads"), strict=True))
    assert round(x["strong"] * 13) == 3 and x["strongest"] == 4.0 and round(x["near_second"] * 13) == 2
    assert round(x["mixed"] * 13) == 2 and round(x["shouted"] * 13) == 1 and round(x["loud"] * 13) == 1
    assert round(x["disguised"] * 13) == 1 and round(x["hits"] * 13) == 4
    assert s.features(" \n") == [0.0] * len(toxicity.NAMES)


def test_toxicity_without_labels_or_rows(spark):
    docs, labels, _ = labelled(spark, 40)
    for some in (labels.limit(0), labels.where("toxic = 0")):
        scores = {r.score for r in toxicity.classify(docs, toxicity.fit(docs, some)).collect()}
        assert scores == {0.5}
    model = toxicity.fit(docs.limit(0), labels)
    assert toxicity.classify(docs.limit(0), model).count() == 0
