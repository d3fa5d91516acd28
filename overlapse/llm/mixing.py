"""Mixing sources to target weights by Poisson replication, with DataFrame functions.

A document of source s has the target rate r_s = weight_s * total / size_s. Its count is the value at
which the cumulative Poisson distribution of mean r_s passes a hash of (seed, doc_id), so the result is
the same in any order and partitioning, and a lost task draws the same counts again. Rates above CHUNK
are drawn as a sum of equal Poisson parts, as exp(-rate) would underflow. Each document is exploded by
its count; one global sort on a hash of (seed, doc_id, copy) shuffles the copies.

Defined cases: a null source is a source of its own; without given weights all present sources weigh
the same; a source with weight 0 or none given is left out; repeated rows draw the same count each, as do
rows without doc_id; an empty table gives an empty table; texts may be null or of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlapse.llm.common import named, private, written

CHUNK = 32.0
#: Above a mean of 32, counts past 160 have a probability below the 2**-52 steps of the hash.
REACH = 160


def _uniform(*parts: Column) -> Column:
    """In [0, 1), from the first 13 hex digits of an md5."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(2**52)


def _poisson(u: Column, mean: Column) -> Column:
    """The least k whose cumulative probability passes u."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), (u >= first).cast("int").alias("k"))
    step = lambda s, i: F.struct((s["p"] * mean / i).alias("p"), (s["c"] + s["p"] * mean / i).alias("c"), (s["k"] + (u >= s["c"] + s["p"] * mean / i).cast("int")).alias("k"))
    reach = F.least(F.lit(REACH), F.ceil(mean * 4 + 24).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), reach), start, step)["k"]


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """(__src, __rate): expected copies of a document of each source, size measured in documents."""
    n = docs.groupBy(F.col("source").alias("__src")).agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("w", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items() if v > 0], "name string, w double")
        n = n.join(given, F.col("__src").eqNullSafe(F.col("name"))).drop("name")
    total = n.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    everything = docs.agg(F.count("*").alias("all_docs"))
    return n.join(F.broadcast(total), F.lit(True)).join(F.broadcast(everything), F.lit(True)).select("__src", (F.col("w") / F.col("all_w") * F.col("all_docs") / F.col("n")).alias("__rate"))


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = 17, with_key: bool = False) -> DataFrame:
    """Copies of the documents in global random order.

    with_key adds copy (from 0), rate and shuffle_key; they take the place of columns of docs of these names.
    """
    own = private(docs)
    src, rate, parts, mean, count, copy, key = map(own, ("src", "rate", "parts", "mean", "count", "copy", "key"))
    # as a written table the rates have a known size: where it is small they go to the documents, which
    # then need no shuffle by source; beyond the broadcast threshold the join shuffles and splits hot sources
    r = written(rates(docs, weights), "mixing-rates").withColumnsRenamed({"__src": src, "__rate": rate})
    d = docs.join(r, F.col("source").eqNullSafe(F.col(src)))
    d = d.withColumn(parts, F.greatest(F.lit(1), F.ceil(F.col(rate) / CHUNK).cast("int"))).withColumn(mean, F.col(rate) / F.col(parts))
    drawn = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda a, j: a + _poisson(_uniform(F.lit(seed), j, F.col("doc_id")), F.col(mean)))
    d = d.withColumn(count, drawn).where(F.col(count) > 0)
    d = d.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(count) - 1)))
    d = d.withColumn(key, F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col(copy))))
    d = d.orderBy(key)
    extra = {"copy": F.col(copy), "rate": F.round(rate, 9), "shuffle_key": F.col(key)} if with_key else {}
    return d.select(*[named(c) for c in docs.columns if c.lower() not in extra], *[c.alias(n) for n, c in extra.items()])


ORACLE = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (1.0::DOUBLE / (SELECT count(*)::DOUBLE FROM n)) * (SELECT count(*) FROM documents) / n AS rate FROM n),
p AS (SELECT source, rate, greatest(1, ceil(rate / 32.0))::INT AS parts FROM r),
t AS (SELECT source, k, sum(exp(k * ln(rate / parts) - rate / parts - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
      FROM p, (SELECT unnest(range(0, 161)) AS k)),
j AS (SELECT row_number() OVER () AS rid, d.*, rate, parts FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
u AS (SELECT rid, source, ('0x' || substr(md5('17:' || i || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0 AS u
      FROM (SELECT rid, doc_id, source, unnest(range(1, parts + 1)) AS i FROM j)),
c AS (SELECT rid, count(*) AS c FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source AND u.u >= t.c GROUP BY rid),
e AS (SELECT j.*, unnest(range(0, c.c)) AS k FROM j JOIN c USING (rid))
SELECT doc_id, text, lang, source, n_chars, k::INT AS copy, round(rate, 9) AS rate, md5('17:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || k) AS shuffle_key FROM e
"""
