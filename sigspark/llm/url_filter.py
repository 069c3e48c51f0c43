"""URL filters: explicit rules first, else boosted trees on lexical features of the url.

A rule is (action, host, path). It fits its host and all subdomains if the url's path starts with the rule's;
of the rules that fit the longest decides. Other urls get the verdict of trees trained from labelled urls
(``url``, ``label``: 1 unwanted), at most ``LABELLED`` of them, those with the lowest hashes. Features: lengths,
depth, shares of digits, hyphens and vowels, entropies, counts of labels and parameters, and suffix statistics:
the smoothed log-odds of the top two labels' and of the name's last three characters' hash buckets, counted over
the labelled urls of the other half (each half gets the other's statistics in training), and kept as arrays of
``BUCKETS`` numbers. The trees are a projection over ``url``; no url is shuffled to be judged by them.

Up to ``MAX_RULES`` rules are one expression. Longer lists, and tables of rules, are joined: a url meets the rules of
each suffix of its host, and there the beginnings of its path that have the length of a rule's path. Both joins deal
hot suffixes over all tasks, and the verdicts are the same as the expression's.

Defined results: a null url or one without ``://`` has empty host and path, and fits no rule; its features are
those of the url as it is (a null one's: of the empty url). Of fitting rules of one length the last by (action, host,
path) decides; a rule without a path fits every path of its host, and one with a null action or host fits none. Without labelled urls of
both kinds the trees allow. Repeated rows are judged alike; an empty table gives an empty result; input columns pass
through but for those named as a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosted import Tree, fit_trees, probability
from .common import lowest_hashes, read_table, spread_join, with_results, written

LABELLED = 20_000
BUCKETS = 512
BLOCK_AT = 0.5
MAX_RULES = 2_000
#: The rules of the query.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Seed words of unwanted hosts: a url whose host has one as a whole part between dots and hyphens is labelled 1.
SEED_WORDS = ["ad", "ads", "adult", "banner", "bet", "bets", "betting", "casino", "clickbait", "gambling", "malware", "phishing", "pills", "poker", "popup", "porn", "scam", "slots", "spam", "track", "tracker", "viagra", "warez", "xxx"]


def host_of(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, else nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        action = F.when(fits, F.lit(verdict)).otherwise(action)
    return rule, action


def with_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (with ``__host`` and ``__path``) with ``__rule`` and ``__action`` of the longest of any number of rules.

    ``rules``: (action, host, path).
    """
    path = F.coalesce("path", F.lit(""))
    found = F.struct(F.length(F.concat("host", path)).alias("length"), "action", "host", path.alias("path"))
    listed = rules.where("action IS NOT NULL AND host IS NOT NULL").select(F.struct("host", path.alias("path")).alias("__key"), found.alias("__found"))
    listed = written(listed.groupBy("__key").agg(F.max("__found").alias("__found")), "rules")
    host = F.col("__key.host")
    lengths = listed.groupBy(host.alias("__suffix")).agg(F.collect_set(F.length("__key.path")).alias("__lengths"))
    deepest = listed.agg(F.max(F.size(F.split(host, r"\.")))).first()[0] or 1  # no rule has a host of more labels
    # The numbers of rows must not change when a task is run again.
    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    depth = F.least(F.size(F.split("__host", r"\.")), F.lit(deepest))
    suffix = F.explode(F.transform(F.sequence(F.lit(1), depth), lambda i: F.call_function("substring_index", F.col("__host"), F.lit("."), -i)))
    met = spread_join(rows.select("__row", "__host", "__path", suffix.alias("__suffix")), lengths, "__suffix", "__row")
    met = met.select("__row", "__suffix", "__path", F.explode(F.filter("__lengths", lambda n: n <= F.length("__path"))).alias("__length"))
    keyed = met.select("__row", F.struct(F.col("__suffix").alias("host"), F.left("__path", F.col("__length")).alias("path")).alias("__key"))
    longest = spread_join(keyed, listed, "__key", "__row").groupBy("__row").agg(F.max("__found").alias("__found"))
    rows = rows.join(longest, "__row", "left")
    return rows.withColumns({"__rule": F.concat("__found.host", "__found.path"), "__action": F.col("__found.action")}).drop("__row", "__found")


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c))) / n
    letters = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.when(n > 0, F.aggregate(letters, F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))).otherwise(0.0)


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]", ""))


def suffixes(host: Column) -> tuple[Column, Column]:
    """Hash buckets of the top two labels, and of the last three characters of the label before them."""
    labels = F.split(host, r"\.")
    name = F.coalesce(F.try_element_at(labels, F.lit(-3)), F.lit(""))
    top = F.substring_index(host, ".", -2)
    return tuple(F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int") for x in (top, F.right(name, F.lit(3))))


NAMES = ["url_length", "host_length", "path_length", "depth", "digits", "host_digits", "host_hyphens", "host_labels", "name_length", "vowels", "parameters", "query_length", "host_entropy", "path_entropy", "longest_part", "top_odds", "ending_odds"]


def lexical(url: Column, host: Column, path: Column, top_odds: Column, ending_odds: Column) -> dict[str, Column]:
    """The features by name."""
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    values = [
        F.length(url),
        F.length(host),
        F.length(path),
        count_of(path, "/"),
        count_of(url, "0-9") / F.greatest(F.length(url), F.lit(1)),
        count_of(host, "0-9"),
        count_of(host, "-"),
        F.size(labels),
        F.length(F.coalesce(F.try_element_at(labels, F.lit(-3)), F.lit(""))),
        count_of(host, "aeiou") / F.greatest(F.length(host), F.lit(1)),
        F.size(F.filter(F.split(query, "&"), lambda x: x != "")),
        F.length(query),
        entropy(host),
        entropy(path),
        F.coalesce(F.array_max(F.transform(F.split(path, "/"), F.length)), F.lit(0)),
        top_odds,
        ending_odds,
    ]
    return {n: v.cast("double") for n, v in zip(NAMES, values, strict=True)}


def seed_labels(urls: DataFrame, words: list[str] = SEED_WORDS) -> DataFrame:
    """(url, label) of distinct urls, by the seed words of their hosts; ``LABELLED`` at most."""
    host = host_of(F.col("url"))
    label = F.arrays_overlap(F.split(host, r"[.-]"), F.array(*map(F.lit, words))).cast("int")
    found = urls.where(F.col("url").isNotNull()).select("url").distinct()
    return lowest_hashes(found, LABELLED).select("url", label.alias("label"))


def _odds(counted: dict[int, tuple[int, int]], n: int, ones: int) -> list[float]:
    """By bucket, the smoothed share of ones, as log-odds against the share overall."""
    rate = (ones + 1) / (n + 2)
    logit = lambda p: math.log(p / (1 - p))
    out = []
    for b in range(BUCKETS):
        all_of, ones_of = counted.get(b, (0, 0))
        out.append(logit((ones_of + 10 * rate) / (all_of + 10)) - logit(rate))
    return out


def _array(values: list[float]) -> Column:
    return F.expr("cast(split('" + ",".join(repr(v) for v in values) + "', ',') as array<double>)")


class UrlModel:
    """Trees, and the suffix statistics that they read."""

    def __init__(self, trees: list[tuple[float, Tree]], odds: list[list[float]]):
        self.trees, self.odds = trees, odds


def fit_urls(labelled: DataFrame, seed: int = 7) -> UrlModel:
    """``labelled``: (url, label). Beyond ``LABELLED`` rows those with the lowest hashes are taken."""
    rows = lowest_hashes(labelled.where("label IS NOT NULL").select("url", F.col("label").cast("int").alias("label")), LABELLED)
    host = host_of(F.col("url"))
    top, ending = suffixes(host)
    rows = written(rows.select("url", "label", host.alias("host"), path_of(F.col("url")).alias("path"), top.alias("top"), ending.alias("ending"), F.pmod(F.xxhash64(F.lit(seed), host), F.lit(2)).cast("int").alias("half")), "urls")
    counts = rows.select("half", "label", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("top").alias("b")), F.struct(F.lit(1).alias("k"), F.col("ending").alias("b")))).alias("s"))
    counted = counts.groupBy("half", "s.k", "s.b").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).collect()  # 4 x BUCKETS rows at most

    def odds(halves: tuple[int, ...], k: int) -> list[float]:
        by: dict[int, tuple[int, int]] = {}
        for r in counted:
            if r["half"] in halves and r["k"] == k:
                n, ones = by.get(r["b"], (0, 0))
                by[r["b"]] = (n + r["n"], ones + r["ones"])
        return _odds(by, sum(n for n, _ in by.values()), sum(o for _, o in by.values()))

    crossed = [F.when(F.col("half") == 0, F.element_at(_array(odds((1,), k)), F.col(c) + 1)).otherwise(F.element_at(_array(odds((0,), k)), F.col(c) + 1)) for k, c in enumerate(("top", "ending"))]
    table = rows.select("label", *[v.alias(n) for n, v in lexical(F.col("url"), F.col("host"), F.col("path"), *crossed).items()])
    return UrlModel(fit_trees(table, NAMES, seed=seed), [odds((0, 1), k) for k in (0, 1)])


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, model: UrlModel, block_at: float = BLOCK_AT) -> DataFrame:
    """Every row with ``host``, ``path``, ``rule``, ``score`` (probability of being unwanted) and ``verdict``."""
    if isinstance(rules, list) and len(rules) > MAX_RULES:
        rules = pages.sparkSession.createDataFrame(rules, "action string, host string, path string")
    url, host, path = F.col("__url"), F.col("__host"), F.col("__path")
    rows = pages.withColumn("__url", F.coalesce("url", F.lit("")))
    rows = rows.withColumns({"__host": host_of(url), "__path": path_of(url)})
    if isinstance(rules, DataFrame):
        rows = with_rules(rows, rules)
    else:
        rows = rows.withColumns(dict(zip(("__rule", "__action"), rule_for(host, path, rules), strict=True)))
    top, ending = suffixes(host)
    features = lexical(url, host, path, *(F.element_at(_array(o), b + 1) for o, b in zip(model.odds, (top, ending), strict=True)))
    rows = rows.withColumn("__f", F.struct(*[v.alias(n) for n, v in features.items()]))
    rows = rows.withColumn("__score", probability(model.trees, [F.col("__f")[n] for n in NAMES]))
    verdict = F.coalesce("__action", F.when(F.col("__score") > block_at, F.lit("block")).otherwise("allow"))
    return with_results(rows, pages.columns, {"host": host, "path": path, "rule": F.col("__rule"), "verdict": verdict, "score": F.col("__score")})


def op2_boosted_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    model = fit_urls(seed_labels(pages))
    return judge_urls(pages, RULES, model).select("page_id", "host", "path", "rule", "verdict", "score")
