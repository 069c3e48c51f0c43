"""Personal data: spans by fixed formats, and further candidates judged by boosted trees.

Base spans (four kinds, with their checks) are found by fixed patterns and always stay. High-recall generators
then propose further spans of the same kinds, loosely written, which may overlap each other and base spans:
addresses with spelt-out or bracketed signs, number groups that may be calls, cards or internet addresses.
Boosted trees judge each candidate by its format (digits, groups, separators, a check digit, the largest part)
and its context (cue words near it, what stands at either side). Each kind has a threshold of its own, calibrated on
held-out candidates to a precision of ``PRECISION``. Candidates that pass and touch no stronger span are added.

There is no table of labelled spans, so the trees are trained on ``EXAMPLES`` composed examples: texts with one
candidate each, of forms that are personal data or only look like it (measures, dates, versions, sums, serial
numbers), between cue words or others. The composition is deterministic.

How places are found: a pattern splits the text; the lengths of the parts before a match, in code points, add
up to its start. Sums and running maxima go in blocks of ``BLOCK``, so a text of very many matches costs little more
than its length. Spans are sorted once: what touches a candidate shows in the running maximum of the ends before
it and in the next start; only candidates that touch another one are compared, with those within ``REACH`` places, as
candidates have a greatest and a least length. The patterns use possessive repeats and anchors at the ends of earlier matches, which leave the leftmost
matches as they are and make long runs of characters linear; what must not stand before a match is looked at
behind its first character, so that most places are passed over by that character alone. Everything is a projection: no row is shuffled.

Defined results: null is the empty text, with no span; repeated rows get equal spans; an empty table gives an empty
result; input columns pass through but for those named as a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosted import Tree, fit_trees, probability
from .common import read_table, text_of, with_results, written

KINDS = ["email", "ip", "card", "phone"]
#: The contract's patterns, written so that no run of characters is read more than a fixed number of times.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates, by kind.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?(?:@|\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}+(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| ?\{dot\} ?| dot )[A-Za-z0-9-]{2,63}+){1,4}+| at [A-Za-z0-9-]{1,63}+(?:(?: dot | ?\(dot\) ?| ?\[dot\] ?)[A-Za-z0-9-]{2,63}+){1,4}+)",
    "ip": r"[0-9](?<![0-9.][0-9])[0-9]{0,2}+(?:(?: ?\. ?|\[\.\]|\(\.\)| dot )[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"[0-9](?<![0-9][0-9])(?:[ ./_-]?[0-9]){11,22}(?![0-9])",
    "phone": r"[0-9(](?<![0-9A-Za-z+][0-9(])(?:[ ()./-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])",
}
BLOCK = 256
#: The longest candidate (an address, 413 characters) can touch at most 413 / 6 + 413 / 7 + 413 / 12 + 413 / 7 others
#: on either side: candidates of one kind don't overlap, and have at least 6, 7, 12 and 7 characters.
REACH = 256
CHUNK = 1024
EXAMPLES, PRECISION = 12_000, 0.98
#: Cue words, by kind.
CUES = {
    "email": "mail|e-mail|contact|write|reach|address",
    "ip": "ip|host|server|address|login|client|from",
    "card": "card|visa|pay|credit|debit|account|charge",
    "phone": "phone|tel|call|mobile|fax|contact|dial|number",
}
AROUND = 24


#: What a text must hold for a pattern to be tried on it at all.
GATES = {
    "base_email": lambda t: t.contains("@"),
    "base_phone": lambda t: t.contains("+"),
    "loose_email": lambda t: t.contains("@") | t.contains("(at)") | t.contains("[at]") | t.contains("{at}") | (t.contains(" at ") & (t.contains(" dot ") | t.contains("(dot)") | t.contains("[dot]"))),
}
MATCH = "array<struct<kind:string,start:int,end:int,found:string,before:string,after:string>>"


def with_matches(rows: DataFrame, patterns: dict[str, str], prefix: str) -> DataFrame:
    """For each kind a column ``__<prefix>_<kind>`` of the matches in ``__text``, null without any.

    A match: kind, start, end (code points, end exclusive), found, and up to ``AROUND`` characters at either side
    that belong to no other match. Each step is a column of its own, so that none is computed twice.
    """
    text, kept, add, zero = F.col("__text"), rows.columns, (lambda s, n: s + n), F.lit(0)
    name = {step: {k: f"__{step}_{k}" for k in patterns} for step in ("m", "p", "l", "b", "s", prefix)}

    def step(of: str, make) -> DataFrame:
        return rows.withColumns({name[of][k]: make(k) for k in patterns})

    def found(k: str):
        every = F.regexp_extract_all(text, F.lit(patterns[k]), F.lit(0))
        gate = GATES.get(f"{prefix}_{k}")
        return F.when(gate(text), every) if gate else every

    rows = step("m", found)
    rows = step("p", lambda k: F.when(F.size(name["m"][k]) > 0, F.split(text, patterns[k], -1)))
    rows = step("l", lambda k: F.zip_with(name["p"][k], name["m"][k], lambda p, m: F.length(p) + F.coalesce(F.length(m), zero)))

    def block_sums(k: str) -> Column:
        lengths = F.col(name["l"][k])
        return F.transform(F.sequence(zero, F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)), zero, add))

    rows = step("b", lambda k: F.when(F.col(name["l"][k]).isNotNull(), block_sums(k)))
    rows = step("s", lambda k: F.transform(name["b"][k], lambda _, b: F.aggregate(F.slice(F.col(name["b"][k]), F.lit(1), b), zero, add)))

    def places(k: str) -> Column:
        lengths, before, parts = F.col(name["l"][k]), F.col(name["s"][k]), F.col(name["p"][k])

        def match(m: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            part = F.element_at(parts, i + 1)
            start = F.element_at(before, block + 1) + F.aggregate(F.slice(lengths, block * BLOCK + 1, i % BLOCK), zero, add) + F.length(part)
            return F.struct(
                F.lit(k).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), m.alias("found"),
                F.right(part, F.lit(AROUND)).alias("before"), F.left(F.element_at(parts, i + 2), F.lit(AROUND)).alias("after"),
            )

        return F.when(parts.isNotNull(), F.transform(name["m"][k], match))

    rows = step(prefix, places)
    return rows.select(*kept, *name[prefix].values())


def joined(columns: list[Column]) -> Column:
    """The arrays of matches as one; a null array is empty."""
    return F.concat(*[F.coalesce(c, F.array().cast(MATCH)) for c in columns])


def digits_of(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10 == 0


def small_parts(found: Column) -> Column:
    """Whether every number between dots is 255 at most; zeros may lead."""
    return ~F.exists(F.split(found, r"\."), lambda p: ~F.regexp(p, F.lit(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))


CHECKS = {
    "email": lambda r: F.lit(True),
    "ip": lambda r: small_parts(r["found"]),
    "card": lambda r: F.length(digits_of(r["found"])).between(16, 19) & luhn(digits_of(r["found"])),
    "phone": lambda r: F.length(digits_of(r["found"])).between(8, 15),
}


def with_base(rows: DataFrame) -> DataFrame:
    """``__base``: the base spans of ``__text``, by kind and start."""
    kept = rows.columns
    rows = with_matches(rows, BASE, "base")
    return rows.select(*kept, joined([F.filter(f"__base_{k}", CHECKS[k]) for k in KINDS]).alias("__base"))


def with_candidates(rows: DataFrame) -> DataFrame:
    """``__all``: the candidates in ``__text``."""
    kept = rows.columns
    rows = with_matches(rows, LOOSE, "loose")
    return rows.select(*kept, joined([F.col(f"__loose_{k}") for k in KINDS]).alias("__all"))


NAMES = ["kind", "length", "digits", "separators", "groups", "luhn", "largest", "bracket", "spelt", "dot_spelt", "dot_space", "at", "dots", "leading_zero", "cue_before", "cue_near", "colon_before", "money_before", "unit_after", "same_separator", "letters", "first_group", "last_group"]


def prepared(candidate: Column) -> Column:
    """A candidate with what several features read."""
    found = candidate["found"]
    return F.struct(
        candidate.alias("c"),
        F.lower(candidate["before"]).alias("before"),
        F.lower(candidate["after"]).alias("after"),
        digits_of(found).alias("number"),
        F.filter(F.split(found, "[^0-9]+"), lambda g: g != "").alias("groups"),
        F.regexp_replace(found, "[A-Za-z0-9]", "").alias("signs"),
    )


def candidate_features(x: Column) -> Column:
    """A struct of the features of one candidate, ``prepared``."""
    found, kind, before, after, number, groups = x["c"]["found"], x["c"]["kind"], x["before"], x["after"], x["number"], x["groups"]
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    at = lambda pattern, where: yes(F.regexp(where, F.lit(pattern)))

    def cue(where: Column, tail: str) -> Column:
        out = F.lit(0.0)
        for k in KINDS:
            out = F.when(kind == k, at(rf"\b(?:{CUES[k]})\b{tail}", where)).otherwise(out)
        return out

    values = [
        F.array_position(F.array(*map(F.lit, KINDS)), kind),
        F.length(found),
        F.length(number),
        F.length(x["signs"]),
        F.size(groups),
        yes(luhn(number) & (F.length(number) > 0)),
        F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)),
        at(r"[()\[\]{}]", found),
        at(r"\b(?:at|dot)\b", found),
        at(r"[(\[{ ](?:dot)[)\]} ]", found),
        at(r"\. ", found),
        at("@", found),
        F.length(found) - F.length(F.replace(found, F.lit("."))),
        at("^0", found),
        cue(before, r"[^a-z0-9]*$"),
        cue(before, ""),
        at(r"[:=#] ?$", before),
        at(r"[$€£%] ?$", before),
        at(r"^ ?(?:km|kg|eur|usd|euro|dollars?|percent|%|items|units|pages|people|words|rows)", after),
        F.size(F.array_distinct(F.filter(F.split(x["signs"], ""), lambda c: c != ""))),
        F.length(F.regexp_replace(found, "[^A-Za-z]", "")),
        F.length(F.coalesce(F.try_element_at(groups, F.lit(1)), F.lit(""))),
        F.length(F.coalesce(F.try_element_at(groups, F.lit(-1)), F.lit(""))),
    ]
    return F.struct(*[v.cast("double").alias(n) for n, v in zip(NAMES, values, strict=True)])


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """(text, kind, label): composed texts, each with one candidate; ``label`` 1 where it is personal data."""
    part = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    num = lambda k, w: F.lpad(part(k, 10**w).cast("string"), w, "0")
    low = lambda k, a, b: (part(k, b - a + 1) + a).cast("string")
    word = lambda k: F.element_at(F.split(F.lit("amber brook cedar delta ember fjord grove heron inlet joker kayak lemon maple north ocean pearl"), " "), part(k, 16).cast("int") + 1)
    name = F.concat(word(1), F.lit("."), word(2))
    host = F.concat(word(3), F.lit(".example"))
    body, check = F.col("body"), F.col("check")
    total = F.aggregate(F.transform(F.filter(F.split(F.reverse(body), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))), F.lit(0), lambda s, d: s + d)
    card = F.concat(body, check.cast("string"))
    wrong = F.concat(body, F.pmod(check + 1 + part(12, 9), F.lit(10)).cast("string"))

    def spaced(c: Column, by: str) -> Column:
        return F.concat_ws(by, *[F.substring(c, i, 4) for i in (1, 5, 9, 13)])

    text = F.concat
    forms = [
        ("email", 1, text(name, F.lit(" (at) "), word(3), F.lit(" (dot) example"))),
        ("email", 1, text(name, F.lit("[at]"), host)),
        ("email", 1, text(name, F.lit(" at "), word(3), F.lit(" dot example"))),
        ("email", 1, text(name, F.lit(" @ "), host)),
        ("email", 0, text(word(1), F.lit(" at "), low(5, 1, 99), F.lit(" dot "), num(6, 2))),
        ("email", 0, text(low(5, 1, 99), F.lit(" @ "), low(6, 1, 99), F.lit("."), num(7, 2))),
        ("ip", 1, text(low(21, 1, 255), F.lit("[.]"), low(22, 0, 255), F.lit("[.]"), low(23, 0, 255), F.lit("[.]"), low(24, 1, 254))),
        ("ip", 1, text(low(21, 1, 255), F.lit(" . "), low(22, 0, 255), F.lit(" . "), low(23, 0, 255), F.lit(" . "), low(24, 1, 254))),
        ("ip", 0, text(low(21, 300, 999), F.lit(". "), low(22, 300, 999), F.lit(". "), low(23, 0, 999), F.lit(". "), low(24, 300, 999))),
        ("ip", 0, text(low(21, 1, 9), F.lit(". "), low(22, 1, 9), F.lit(". "), low(23, 1, 9), F.lit(". "), low(24, 1, 9))),
        ("card", 1, spaced(card, ".")),
        ("card", 1, spaced(card, "/")),
        ("card", 0, spaced(wrong, ".")),
        ("card", 0, wrong),
        ("card", 0, text(num(31, 6), num(32, 6), F.lit("/"), num(33, 6))),
        ("card", 0, spaced(wrong, " ")),
        ("phone", 1, text(F.lit("("), num(41, 3), F.lit(") "), num(42, 3), F.lit("-"), num(43, 4))),
        ("phone", 1, text(num(41, 3), F.lit("-"), num(42, 3), F.lit("-"), num(43, 4))),
        ("phone", 1, text(F.lit("00"), low(41, 30, 49), F.lit(" "), num(42, 3), F.lit(" "), num(43, 7))),
        ("phone", 0, text(low(41, 1900, 2030), F.lit("-"), F.lpad(low(42, 1, 12), 2, "0"), F.lit("-"), F.lpad(low(43, 1, 28), 2, "0"))),
        ("phone", 0, text(F.lpad(low(43, 1, 28), 2, "0"), F.lit("/"), F.lpad(low(42, 1, 12), 2, "0"), F.lit("/"), low(41, 1900, 2030))),
        ("phone", 0, num(41, 8)),
        ("phone", 0, num(41, 12)),
        ("phone", 0, wrong),
        ("phone", 0, text(low(41, 1, 99), F.lit(" "), num(42, 3), F.lit(" "), num(43, 3))),
    ]
    cue_of = {k: CUES[k].split("|") for k in KINDS}
    rows = spark.range(n).withColumns({"form": F.pmod("id", F.lit(len(forms))).cast("int"), "body": num(11, 15)})
    rows = rows.withColumn("check", F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("int"))
    content, kind, label, cue = F.lit(""), F.lit(""), F.lit(0), F.lit("")
    for i, (k, y, c) in enumerate(forms):
        here = F.col("form") == i
        content, kind, label = F.when(here, c).otherwise(content), F.when(here, k).otherwise(kind), F.when(here, y).otherwise(label)
        cue = F.when(here, F.element_at(F.array(*map(F.lit, cue_of[k])), part(51, len(cue_of[k])).cast("int") + 1)).otherwise(cue)
    cued = part(52, 10) < F.when(label == 1, 7).otherwise(1)
    lead = F.concat(F.initcap(word(53)), F.lit(" "), word(54), F.when(cued, F.concat(F.lit(" "), cue, F.lit(": "))).otherwise(F.concat(F.lit(" "), word(55), F.lit(" is "))))
    return rows.select("id", F.concat(lead, content, F.lit(" "), word(56), F.lit(" "), word(57)).alias("text"), kind.alias("kind"), label.alias("label"))


class PiiModel:
    """Trees, and a threshold for each kind."""

    def __init__(self, trees: list[tuple[float, Tree]], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds


def fit_pii(spark: SparkSession, labelled: DataFrame | None = None, precision: float = PRECISION, seed: int = 7) -> PiiModel:
    """``labelled``: (id, text, kind, label) like ``examples``, which are taken without it. A third calibrates."""
    rows = (labelled or examples(spark)).select("id", "text", "kind", "label")
    rows = written(rows, "examples").withColumn("__text", text_of())
    found = with_candidates(rows).select("id", F.col("kind").alias("of"), "label", F.explode("__all").alias("c"))
    label = F.when(F.col("c.kind") == F.col("of"), F.col("label")).otherwise(0)
    found = found.select(prepared(F.col("c")).alias("x"), F.col("c.kind").alias("kind"), label.alias("label"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("held"))
    table = found.select(candidate_features(F.col("x")).alias("f"), "kind", "label", "held")
    table = written(table.select("f.*", F.col("kind").alias("of"), "label", "held"), "candidates")
    trees = fit_trees(table.where("NOT held"), NAMES, rounds=16, depth=4, seed=seed)
    scored = table.where("held").select("of", "label", F.round(probability(trees, [F.col(n) for n in NAMES]), 2).alias("p"))
    counts = scored.groupBy("of", "p").agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n")).collect()  # a row for each kind and hundredth
    thresholds = {}
    for kind in KINDS:
        ones = n = 0
        best = 2.0
        for r in sorted((r for r in counts if r["of"] == kind), key=lambda r: -r["p"]):
            ones, n = ones + r["ones"], n + r["n"]
            if ones >= precision * n and r["p"] > 0.5:
                best = r["p"] - 0.005
        thresholds[kind] = best
    return PiiModel(trees, thresholds)


def with_running_max(rows: DataFrame, values: str, name: str) -> DataFrame:
    """``name``: for each place of the array of integers ``values`` the largest value up to it, itself included."""
    x, tops = F.col(values), f"__tops_{name}"
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.array_max(F.slice(x, b * BLOCK + 1, F.lit(BLOCK))))
    rows = rows.withColumn(tops, F.when(F.size(x) > 0, blocks))

    def top(_: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        inside = F.array_max(F.slice(x, block * BLOCK + 1, i % BLOCK + 1))
        return F.greatest(inside, F.coalesce(F.array_max(F.slice(F.col(tops), F.lit(1), block)), inside))

    # A column that a lambda reads is also read outside of it, lest its expression be moved into the lambda.
    return rows.withColumn(name, F.when(F.col(tops).isNotNull(), F.transform(x, top))).drop(tops)


def with_free(rows: DataFrame) -> DataFrame:
    """``__free``: the candidates of ``__all`` that touch no base span, by start; null without candidates."""
    kept = rows.columns
    entry = lambda base: lambda r: F.struct(r["start"].alias("start"), F.lit(base).alias("base"), r.alias("r"))
    both = F.array_sort(F.concat(F.transform("__base", entry(1)), F.transform("__all", entry(0))))
    rows = rows.withColumn("__both", F.when((F.size("__all") > 0) & (F.size("__base") > 0), both))
    rows = rows.withColumn("__ends", F.transform("__both", lambda e: F.when(e["base"] == 1, e["r"]["end"]).otherwise(-1)))
    rows = with_running_max(rows, "__ends", "__until")
    far = 2**31 - 1
    rows = rows.withColumn("__starts", F.reverse(F.transform("__both", lambda e: F.when(e["base"] == 1, -e["start"]).otherwise(-far))))
    rows = with_running_max(rows, "__starts", "__next")
    judged = F.zip_with("__both", F.zip_with("__until", F.reverse("__next"), lambda u, n: F.struct(u.alias("until"), (-n).alias("next"))), lambda e, s: F.struct(e["r"].alias("r"), ((e["base"] == 0) & (s["until"] <= e["start"]) & (s["next"] >= e["r"]["end"])).alias("free")))
    free = F.transform(F.filter(judged, lambda e: e["free"]), lambda e: e["r"])
    alone = F.array_sort(F.transform("__all", entry(0)))
    return rows.select(*kept, F.when(F.size("__all") > 0, F.when(F.col("__both").isNull(), F.transform(alone, lambda e: e["r"])).otherwise(free)).alias("__free"))


def with_best(rows: DataFrame) -> DataFrame:
    """``__added``: of ``__passed`` (p, c; by start) the candidates that touch no likelier one; null without any."""
    kept, passed = rows.columns, F.col("__passed")
    rows = rows.withColumn("__ends", F.when(F.size(passed) > 0, F.transform(passed, lambda s: s["c"]["end"])))
    rows = with_running_max(rows, "__ends", "__until")
    touches = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    stronger = lambda a, b: (a["p"] > b["p"]) | ((a["p"] == b["p"]) & ((a["c"]["start"] < b["c"]["start"]) | ((a["c"]["start"] == b["c"]["start"]) & (a["c"]["kind"] < b["c"]["kind"]))))

    def placed(s: Column, i: Column) -> Column:
        clear_before = (i == 0) | (F.coalesce(F.try_element_at("__until", F.greatest(i, F.lit(1))), F.lit(0)) <= s["c"]["start"])
        clear_after = F.coalesce(F.try_element_at(passed, i + 2)["c"]["start"] >= s["c"]["end"], F.lit(True))
        near = F.slice(passed, F.greatest(i + 1 - REACH, F.lit(1)), F.lit(2 * REACH + 1))
        best = F.when(clear_before & clear_after, True).otherwise(~F.exists(near, lambda o: touches(o["c"], s["c"]) & stronger(o, s)))
        return F.struct(s["c"].alias("c"), best.alias("best"))

    marked = F.filter(F.transform(passed, placed), lambda s: s["best"])
    return rows.select(*kept, F.when((F.size(passed) > 0) & F.col("__until").isNotNull(), F.transform(marked, lambda s: s["c"])).alias("__added"))


def find_spans(docs: DataFrame, model: PiiModel) -> DataFrame:
    """Every row with ``base`` and ``spans``: arrays of (kind, start, end), by kind as listed, then start.

    An added span overlaps no base span and no likelier candidate.
    """
    rows = with_free(with_candidates(with_base(docs.withColumn("__text", text_of()))))
    rows = rows.withColumn("__seen", F.when(F.size("__free") > 0, F.transform("__free", prepared)))
    rows = rows.withColumn("__seen", F.transform("__seen", lambda x: F.struct(x["c"].alias("c"), candidate_features(x).alias("f"))))
    rows = rows.withColumn("__judged", F.transform("__seen", lambda s: F.struct(probability(model.trees, [s["f"][n] for n in NAMES]).alias("p"), s["c"].alias("c"))))
    enough = F.lit(2.0)

    def passes(s: Column) -> Column:
        need = enough
        for k, t in model.thresholds.items():
            need = F.when(s["c"]["kind"] == k, t).otherwise(need)
        return s["p"] >= need

    rows = with_best(rows.withColumn("__passed", F.filter("__judged", passes)))
    plain = lambda spans: F.transform(spans, lambda r: F.struct(r["kind"].alias("kind"), r["start"].alias("start"), r["end"].alias("end")))
    place = F.array(*map(F.lit, KINDS))
    keyed = F.transform(F.concat("__base", F.col("__added").cast(MATCH)), lambda r: F.struct(F.array_position(place, r["kind"]).alias("at"), r["start"].alias("start"), r["end"].alias("end"), r["kind"].alias("kind")))
    rows = rows.withColumn("__spans", F.when(F.col("__added").isNull(), plain(F.col("__base"))).otherwise(plain(F.array_sort(keyed))))
    return with_results(rows, docs.columns, {"base": plain(F.col("__base")), "spans": F.col("__spans")})


def digest_of(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda r: F.concat_ws(":", r["kind"], r["start"].cast("string"), r["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: PiiModel) -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one.

    What stands between spans is put together from chunks of ``CHUNK`` characters, so that no place is counted from
    the text's start.
    """
    found = find_spans(docs.withColumn("__doc", F.struct("*")).select("__doc", text_of().alias("text")), model)
    by_start = F.array_sort(F.transform("spans", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["kind"].alias("kind"))))
    some = F.size("spans") > 0
    rows = found.select("__doc", "text", F.when(some, by_start).alias("spans"), F.when(some, F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))).alias("__chunks"))
    rows = with_running_max(rows.withColumn("__ends", F.transform("spans", lambda r: r["end"])), "__ends", "__until")
    chunks = F.col("__chunks")
    chunk = lambda k: F.coalesce(F.try_element_at(chunks, k + 1), F.lit(""))

    def between(a: Column, b: Column) -> Column:
        low, high = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        first = F.substring(chunk(low), a % CHUNK + 1, b - a)
        rest = F.concat(F.array_join(F.slice(chunks, low + 2, F.greatest(high - low - 1, F.lit(0))), ""), F.substring(chunk(high), F.lit(1), b % CHUNK))
        return F.when(b <= a, "").when(low == high, first).otherwise(F.concat(first, rest))

    # Where a span begins inside an earlier one, only what reaches beyond that one is cut out with it.
    def piece(r: Column, i: Column) -> Column:
        before = F.when(i == 0, 0).otherwise(F.try_element_at("__until", F.greatest(i, F.lit(1))))
        return F.concat(between(before, r["start"]), F.when(r["start"] >= before, F.concat(F.lit("<"), F.upper(r["kind"]), F.lit(">"))).otherwise(""))

    rows = rows.withColumn("__pieces", F.transform("spans", piece))
    redacted = F.when(F.col("spans").isNotNull(), F.concat(F.array_join("__pieces", ""), between(F.element_at("__until", -1), F.length("text")))).otherwise(F.col("__doc.text"))
    values = {"text": redacted} | ({"n_chars": F.length(redacted).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[values.get(c, F.col("__doc")[c]).alias(c) for c in docs.columns])


def op3_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, fit_pii(spark))
    number = lambda k: F.size(F.filter("base", lambda r: r["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(number, KINDS), F.sha2(digest_of(F.col("base")), 256).alias("base_sha256"), digest_of(F.col("spans")).alias("spans"))
