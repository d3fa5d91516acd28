"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

DataFrame functions and Spark's own boosted trees only. Labelled URLs are those that a rule decides, or a
given table (url, blocked). From them at most `sample` of each label, least hash of the url first, train
the trees; features are length, depth, digit ratio, entropy, parameter counts and the smoothed share of
blocked URLs among the labelled ones with the same host suffix (last label, last two labels). For a URL
that trains the trees the share comes from the other folds of hosts only, so its own label and host say
nothing about it, and a rule about a path says nothing about a suffix: URLs that it decides train the trees
but count in no share. URLs that no rule fits get the verdict of the trees.

Defined cases: a null url, or one without ://, has an empty host and path, fits no rule and is judged by
the trees on its features like any other; without labelled URLs everything else is allowed, with one
label only everything else gets that label; repeated rows are judged alike; a label of NULL is none; a url
labelled several times counts each time.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlapse.llm.common import written

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "params", "query_length", "tld_rate", "domain_rate"]
SAMPLE = 5000
SMOOTH = 10.0
#: Folds of hosts for the shares of the labelled URLs themselves.
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _parsed(pages: DataFrame, *keep: str) -> DataFrame:
    place = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
    part = lambda i: F.coalesce(F.regexp_extract("url", place, i), F.lit(""))
    return pages.select(*keep, "url", F.translate(part(1), UPPER, LOWER).alias("host"), part(2).alias("path"), part(3).alias("tail"))


def _ruled(d: DataFrame, rules: tuple) -> DataFrame:
    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
    best, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        best = F.when(fits(h, p), F.lit(h + p)).otherwise(best)
        verdict = F.when(fits(h, p), F.lit(word)).otherwise(verdict)
    return d.select("*", best.alias("rule"), verdict.alias("rule_verdict"), F.coalesce(best.endswith("/") & (F.instr(best, "/") == F.length(best)), F.lit(False)).alias("of_host"))


def _entropy(s: Column) -> Column:
    """Shannon entropy of the characters that lexical filters look at: each letter and digit."""
    n = F.greatest(F.length(s), F.lit(1)).cast("double")
    terms = []
    for c in "abcdefghijklmnopqrstuvwxyz0123456789.-":
        k = (F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))) / n
        terms.append(F.when(k > 0, -k * F.log2(k)).otherwise(0.0))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def lexical(d: DataFrame) -> DataFrame:
    u = F.coalesce("url", F.lit(""))
    count = lambda s, c: (F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))).cast("double")
    host, path, tail = F.col("host"), F.col("path"), F.col("tail")
    digits = F.length(F.regexp_replace(u, "[^0-9]", "")) / F.greatest(F.length(u), F.lit(1))
    return d.select(
        "*", F.length(u).cast("double").alias("length"), F.length(host).cast("double").alias("host_length"), F.length(path).cast("double").alias("path_length"),
        count(path, "/").alias("depth"), count(host, ".").alias("labels"), digits.cast("double").alias("digit_ratio"), count(u, "-").alias("hyphens"), _entropy(F.lower(u)).alias("entropy"),
        (count(tail, "&") + count(tail, "?")).alias("params"), F.length(tail).cast("double").alias("query_length"),
        F.substring_index(host, ".", -1).alias("tld"), F.substring_index(host, ".", -2).alias("domain"),
    )


def _rates(known: DataFrame, by: str, overall: float) -> tuple[DataFrame, DataFrame]:
    """The smoothed shares by suffix: of all labelled URLs, and of those outside each fold of hosts."""
    share = lambda s, n: (s + SMOOTH * overall) / (n + SMOOTH)
    told = known.where("of_host").groupBy(F.col(by).alias(f"__{by}"))
    whole = told.agg(F.sum("label").alias("__s"), F.count("*").alias("__n"))
    parts = known.where("of_host").groupBy(F.col(by).alias(f"__{by}"), F.col("fold").alias("__fold")).agg(F.sum("label").alias("__fs"), F.count("*").alias("__fn"))
    folds = whole.join(F.broadcast(known.select(F.col("fold").alias("__fold")).distinct()), F.lit(True))  # at most FOLDS rows
    folds = folds.join(parts, [f"__{by}", "__fold"], "left").fillna({"__fs": 0.0, "__fn": 0})
    return whole.select(f"__{by}", share(F.col("__s"), F.col("__n")).alias(f"{by}_rate")), folds.select(f"__{by}", "__fold", share(F.col("__s") - F.col("__fs"), F.col("__n") - F.col("__fn")).alias(f"{by}_rate"))


def url_filter(pages: DataFrame, rules: tuple = RULES, labelled: DataFrame | None = None, sample: int = SAMPLE, trees: int = 12, depth: int = 4, seed: int = 5) -> DataFrame:
    """page_id, host, path, rule, verdict and the score of the trees (share of block; null where none were trained)."""
    d = lexical(_ruled(_parsed(pages, "page_id"), rules))
    if labelled is None:
        known = d.where("rule is not null").withColumn("label", (F.col("rule_verdict") == "block").cast("double"))
    else:
        known = lexical(_parsed(labelled.select("url", F.col("blocked").cast("double").alias("label")).where("label is not null"), "label")).withColumn("of_host", F.lit(True))
    key = F.xxhash64(F.coalesce("url", F.lit("")))
    per = [known.where(f"label = {x}").orderBy(key, "url").limit(sample) for x in (0.0, 1.0)]
    known = per[0].union(per[1]).coalesce(1).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS).cast("long")))
    known = written(known, "urls-labelled")
    seen = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        only = "block" if 1.0 in seen else "allow"
        return d.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    overall = seen[1.0] / sum(seen.values())
    # at most 2 * sample suffixes each, FOLDS times: bounded tables
    shares = {by: [written(x, "urls-suffix") for x in _rates(known, by, overall)] for by in ("tld", "domain")}

    def full(x: DataFrame, own_folds: bool) -> DataFrame:
        for by, (whole, folds) in shares.items():
            on = F.col(by) == F.col(f"__{by}")
            x = x.join(F.broadcast(folds), on & (F.col("fold") == F.col("__fold")), "left").drop("__fold") if own_folds else x.join(F.broadcast(whole), on, "left")
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(x.fillna({f"{by}_rate": overall for by in shares}))

    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, cacheNodeIds=False).fit(full(known, True).coalesce(1).select("features", "label"))
    judged = model.transform(full(d, False))
    score = F.round(F.get(vector_to_array("probability"), F.lit(1)), 6)
    says = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", says).alias("verdict"), score.alias("score"))
