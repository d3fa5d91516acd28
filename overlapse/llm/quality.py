"""Quality rules by cross-document line frequency, with DataFrame functions only.

Lines are normalised (lower case, runs of white space made one space) and hashed. For each host
(the `source` of a document) the number of distinct documents that hold a line is counted; exact
copies of a text count as one document, so copies alone make no line common. A line is common if
more than min_docs documents hold it and these are more than a share of the host's distinct documents
by two standard deviations, or if more than max_docs documents hold it, whatever the host's size. So a
line on most documents of a host of five is common, and so is one on a small part of a very large
host. Common lines are removed, and a document that this depletes is rejected.

Defined cases: null text counts as empty; an empty text has no words and fails the base rules;
null source is a host of its own; repeated rows get the same result each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlapse.llm.common import SPACE, WORD, named, private

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class LineLimits:
    min_docs: int = 4
    share: float = 0.05
    max_docs: int = 10_000
    max_removed_share: float = 0.70
    min_left: int = 5


def _normal(line: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(line, SPACE, " ")))


def base_metrics(docs: DataFrame, *keep: Column) -> DataFrame:
    """doc_id, the columns in keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    names = [docs.select(c).columns[0] for c in keep]
    d = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("__t"))
    d = d.select(
        "doc_id", *names, "__t",
        F.regexp_extract_all("__t", F.lit(WORD), F.lit(0)).alias("__w"),
        F.filter(F.split("__t", "\n"), lambda x: x.rlike(WORD)).alias("__l"),
    )
    d = d.select(
        "doc_id", *names,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.size(F.regexp_extract_all("__t", F.lit(SYMBOLS), F.lit(0))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.transform("__w", lambda x: F.xxhash64(x)).alias("__h"),
    )
    # __h is named twice, so that no projection moves into the lambda and is computed for each window
    d = d.withColumn(
        "__g",
        F.when(
            F.size("__h") > WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("__h") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__h", i, F.lit(WINDOW)))),
        ),
    )
    d = d.withColumn(
        "__s",
        F.when(F.size("__g") > F.size(F.array_distinct("__g")), F.sort_array(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    at = lambda k: F.get("__s", k)["h"]
    starts = F.array_sort(F.filter(F.transform("__s", lambda x, k: F.when((at(k - 1) == x["h"]) | (at(k + 1) == x["h"]), x["i"])), lambda i: i.isNotNull()))
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    d = d.withColumn("__p", F.when(F.col("__s").isNotNull(), starts))
    covered = F.aggregate("__p", zero, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")))["n"]
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return d.select("doc_id", *names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each distinct line of a document: its hash, and the words of all its occurrences."""
    d = docs.select("doc_id", F.col("source").alias("__src"), F.coalesce("text", F.lit("")).alias("__t"))
    d = d.withColumn("__doc", F.xxhash64("__t"))
    lines = F.filter(F.transform(F.split("__t", "\n"), _normal), lambda x: x != "")
    d = d.select("doc_id", "__src", "__doc", F.explode(lines).alias("__line"))
    return d.select("doc_id", "__src", "__doc", F.xxhash64("__line").alias("__hash"), F.size(F.split("__line", " ")).cast("long").alias("__n"))


def common_lines(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """(__src, __hash, n_docs) of the lines above the limits of their host."""
    lines = _lines(docs)
    seen = lines.groupBy("__src", "__hash", "__doc").agg(F.lit(1).alias("one"))
    n = seen.groupBy("__src", "__hash").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > limits.min_docs)
    hosts = (
        docs.select(F.col("source").alias("__host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__doc"))
        .distinct().groupBy("__host").agg(F.count("*").alias("host_docs"))
    )
    joined = n.join(hosts, F.col("__src").eqNullSafe(F.col("__host")))
    mean = F.col("host_docs") * limits.share
    above = (F.col("n_docs") > mean + 2 * F.sqrt(mean)) | (F.col("n_docs") > limits.max_docs)
    return joined.where(above).select("__src", "__hash", "n_docs")


def removed_lines(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """(__id, __of, __from, removed_words, __hashes) for each document that has common lines.

    A document is known by id, text hash and host. Rows repeated k times would add up k times, so the
    words are counted for each line and then divided by the number of repetitions.
    """
    found = _lines(docs).withColumnsRenamed({"__src": "__from", "__hash": "__lh"})
    common = common_lines(docs, limits).withColumnsRenamed({"__hash": "__ch"})
    hit = found.join(common, (F.col("__lh") == F.col("__ch")) & F.col("__from").eqNullSafe(F.col("__src")))
    return hit.groupBy(F.col("doc_id").alias("__id"), F.col("__doc").alias("__of"), "__from").agg(
        F.sum("__n").alias("__words"), F.collect_set("__lh").alias("__hashes")
    )


def judged(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """One row per document row: base metrics, base_failed, n_removed_words, depleted, kept (and __of, __from, __hashes)."""
    text = F.coalesce("text", F.lit(""))
    base = base_metrics(docs, F.xxhash64(text).alias("__key"), F.col("source").alias("__source"))
    # identical rows are merged and dealt out again, as their lines were counted together; as aggregates the
    # metrics also stay below filters on them, which would else move into the scan and compute them again
    by = ["doc_id", "__key", "__source"]
    base = base.groupBy(*by).agg(*[F.max(c).alias(c) for c in base.columns if c not in by], F.count("*").alias("__rows"))
    gone = removed_lines(docs, limits)
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__of")) & F.col("__source").eqNullSafe(F.col("__from"))
    out = base.join(gone, on, "left")
    out = out.withColumn("n_removed_words", F.coalesce(F.expr("__words div __rows"), F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((F.col("n_removed_words") > F.col("n_words") * limits.max_removed_share) | (left < limits.min_left))
    out = out.withColumn("depleted", depleted).withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    return out


def quality_rules(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """The verdict on every document row."""
    out = judged(docs, limits).withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__rows").cast("int"))))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words", "depleted")


def cleaned(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """The kept documents without their common lines; columns as they came, n_chars set to the new length."""
    own = private(docs)
    key, id_, of, host, gone = own("key"), own("id"), own("of"), own("host"), own("gone")
    verdict = judged(docs, limits).where("kept").select(F.col("doc_id").alias(id_), F.col("__key").alias(of), F.col("__source").alias(host), F.col("__hashes").alias(gone))
    d = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    on = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(of)) & F.col("source").eqNullSafe(F.col(host))
    d = d.join(verdict, on)
    stay = F.filter(F.split(F.col("text"), "\n"), lambda x: ~F.array_contains(F.col(gone), F.xxhash64(_normal(x))))
    d = d.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return d.select(*map(named, docs.columns))


#: The same verdicts in DuckDB; lines are compared as text there, not as hashes.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 8)) AS k) GROUP BY rid),
l AS (SELECT rid, source, t, trim(lower(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS line FROM (SELECT rid, source, t, unnest(ls) AS x FROM w)),
h AS (SELECT source, count(DISTINCT t) AS host_docs FROM d GROUP BY source),
f AS (SELECT l.source, line FROM l JOIN h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, line, host_docs
      HAVING count(DISTINCT t) > 4 AND (count(DISTINCT t) > host_docs * 0.05::DOUBLE + 2 * sqrt(host_docs * 0.05::DOUBLE) OR count(DISTINCT t) > 10000)),
x AS (SELECT rid, sum(len(string_split(l.line, ' ')))::BIGINT AS gone FROM l JOIN f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(gone, 0)::BIGINT AS n_removed_words
      FROM w LEFT JOIN c USING (rid) LEFT JOIN x USING (rid)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             n_removed_words > 0 AND (n_removed_words > n_words * 0.7::DOUBLE OR n_words - n_removed_words < 5) AS depleted FROM m)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM v
"""
