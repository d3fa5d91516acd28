"""Registries, checklists, encodings and cliffs: joins of results with catalogues, and what is decided from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from overlapse.functions.hashes import split_mix
from overlapse.functions.scalars import stable_key
from overlapse.operators import pairs
from overlapse.plans.table_audit import E_, S, _effects, _scored
from overlapse.plans.text_audit import HASH, rounded
from overlapse.sources.catalogue import baseline_artifact
from overlapse.sources.readers import table
from overlapse.sources.writers import vocabulary

#: (method, group, source type, whether it types relations); the last is the proposed one.
METHODS = (
    ("raw_identity", "classic", "self_rerun", False), ("canonical_identity", "classic", "self_rerun", False), ("scaffold", "classic", "self_rerun", False), ("identifier_full", "direct_mechanism", "self_rerun", False), ("identifier_connectivity", "direct_mechanism", "self_rerun", False),
    ("ecfp80", "direct_mechanism", "self_rerun", False), ("high_similarity_60", "recent_same_task", "adapted_rerun", False), ("similarity_cluster", "recent_same_task", "adapted_rerun", False), ("audit_bundle", "recent_same_task", "adapted_rerun", False), ("curation_bundle", "recent_same_task", "adapted_rerun", False),
    ("relation_lattice", "proposed", "proposed", True),
)
REGISTRY = "method string, method_group string, source_type string, relation_typed boolean"
_VALUES = "r AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{g}', '{s}', {str(t).lower()})" for m, g, s, t in METHODS) + ") t(method, method_group, source_type, relation_typed))"


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(METHODS), REGISTRY)


CUTS = {"scaffold": 100, "ecfp80": 500, "relation_lattice": 900, "unlisted": 300}


def registry_metrics(spark: SparkSession, d: str) -> DataFrame:
    """JN-21: metrics of methods joined with what the registry says of them; a method it lacks keeps its metrics."""
    s = _scored(spark, d)
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), (F.col("score") >= c).alias("hit")) for m, c in CUTS.items()])).alias("x")
    long = s.select("y", rows).select("y", "x.*")
    m = long.groupBy("method").agg(F.avg(F.when(F.col("y") == 1, F.col("hit").cast("double"))).alias("recall"), F.count_if(F.col("hit") & (F.col("y") == 0)).alias("n_false"))
    return rounded(m.join(registry(spark).select("method", "method_group", "relation_typed"), "method", "left"))


O_METRICS = f"""WITH {_VALUES}, {S}, c AS (SELECT * FROM (VALUES {', '.join(f"('{m}', {c})" for m, c in CUTS.items())}) t(method, cut)),
m AS (SELECT method, round(avg((score >= cut)::INT::DOUBLE) FILTER (y = 1), 8) AS recall, count(*) FILTER (score >= cut AND y = 0) AS n_false FROM s, c GROUP BY method)
SELECT m.*, method_group, relation_typed FROM m LEFT JOIN r USING (method)"""


def criteria(spark: SparkSession, d: str) -> DataFrame:
    """AG-10, SNK-09: nine criteria of a comparison, each with its status and evidence, from the registry and the effects."""
    r = registry(spark).where("not relation_typed").agg(
        F.count("*").alias("external"), *[F.count_if(F.col("method_group") == g).alias(g) for g in ("classic", "recent_same_task", "direct_mechanism")],
        F.count("method_group").alias("grouped"), F.array_join(F.array_sort(F.collect_set("source_type")), ";").alias("sources"), F.count_if("relation_typed").alias("typed"),
    )
    e = _effects(spark, d)
    a = e.agg(F.count_distinct("task").alias("tasks"), F.count_distinct("seed").alias("seeds"), F.count_distinct("relation", "dose").alias("scenarios"), F.count_distinct(F.concat_ws("|", "task", "dose", "seed")).alias("cells"))
    one = r.join(F.broadcast(a), F.lit(True))  # a row each
    c = F.col
    checks = {
        "external_methods": (c("external").between(8, 12), c("external").cast("string")), "methods_by_age": ((c("classic") >= 2) & c("recent_same_task").between(4, 6) & c("direct_mechanism").between(2, 4), F.concat_ws(";", "classic", "recent_same_task", "direct_mechanism")),
        "grouped_by_route": (c("grouped") == c("external"), c("grouped").cast("string")), "public_datasets": (c("tasks") >= 4, c("tasks").cast("string")), "same_protocol": (c("cells") > 0, c("cells").cast("string")),
        "special_scenarios": (c("scenarios") >= 4, c("scenarios").cast("string")), "repeat_seeds": (c("seeds") >= 5, c("seeds").cast("string")), "rerun_flags": (F.length("sources") > 0, c("sources")), "narrow_comparison": (c("typed") == 0, c("typed").cast("string")),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("criterion"), F.when(ok, F.lit("narrow_pass" if n == "narrow_comparison" else "pass")).otherwise("fail").alias("status"), ev.alias("evidence")) for n, (ok, ev) in checks.items()])).alias("x")
    return one.select(rows).select("x.*")


O_CRITERIA = f"""WITH {_VALUES}, {E_}, x1 AS (SELECT count(*) AS external, count(*) FILTER (method_group = 'classic') AS cl, count(*) FILTER (method_group = 'recent_same_task') AS re, count(*) FILTER (method_group = 'direct_mechanism') AS di,
 string_agg(DISTINCT source_type, ';' ORDER BY source_type) AS sources FROM r WHERE NOT relation_typed),
x2 AS (SELECT count(DISTINCT task) AS tasks, count(DISTINCT seed) AS seeds, count(DISTINCT relation || dose) AS scenarios, count(DISTINCT task || '|' || dose || '|' || seed) AS cells FROM e), o AS (SELECT * FROM x1, x2),
l AS (SELECT unnest([{{'c': 'external_methods', 'o': external BETWEEN 8 AND 12, 'e': external::VARCHAR}}, {{'c': 'methods_by_age', 'o': cl >= 2 AND re BETWEEN 4 AND 6 AND di BETWEEN 2 AND 4, 'e': cl || ';' || re || ';' || di}}, {{'c': 'grouped_by_route', 'o': true, 'e': external::VARCHAR}},
 {{'c': 'public_datasets', 'o': tasks >= 4, 'e': tasks::VARCHAR}}, {{'c': 'same_protocol', 'o': cells > 0, 'e': cells::VARCHAR}}, {{'c': 'special_scenarios', 'o': scenarios >= 4, 'e': scenarios::VARCHAR}}, {{'c': 'repeat_seeds', 'o': seeds >= 5, 'e': seeds::VARCHAR}},
 {{'c': 'rerun_flags', 'o': true, 'e': sources}}, {{'c': 'narrow_comparison', 'o': true, 'e': '0'}}]) AS x FROM o)
SELECT x.c AS criterion, CASE WHEN NOT x.o THEN 'fail' WHEN x.c = 'narrow_comparison' THEN 'narrow_pass' ELSE 'pass' END AS status, x.e AS evidence FROM l"""


def decision_rows(spark: SparkSession, d: str) -> DataFrame:
    """AG-38, AG-34: what may be claimed, from aggregates: cells whose interval lies above zero, the best cell, and any-of risk."""
    e = _effects(spark, d).where("relation <> 'decoy'")
    cell = e.groupBy("task", "relation", "dose").agg(F.avg("did").alias("mean"), (1.96 * F.stddev_samp("did") / F.sqrt(F.count("did"))).alias("half"))
    best = F.max_by(F.struct("task", "relation", "dose", "mean"), F.struct("mean", "task", "relation", "dose"))
    one = cell.agg(F.count("*").alias("cells"), F.count_if(F.col("mean") - F.col("half") > 0).alias("positive"), F.coalesce(F.bool_or(F.col("mean") - F.col("half") > 0), F.lit(False)).alias("risky"), best.alias("best"))
    n = registry(spark).agg(F.count_if(~F.col("relation_typed")).alias("external"), F.count("*").alias("screened"))
    c = one.join(F.broadcast(n), F.lit(True))  # a row each
    rows = [
        ("downstream_inflation", F.when(F.col("positive") * 2 > F.col("cells"), "confirmed").otherwise("not_confirmed"), F.format_string("%d of %d cells; best %d:%s_%dx %.4f", "positive", "cells", "best.task", "best.relation", "best.dose", "best.mean")),
        ("external_baselines", F.when(F.col("external") >= 8, "ready_narrow_claim").otherwise("needs_more_evidence"), F.format_string("%d of %d methods", "external", "screened")),
        ("risk", F.when(F.col("risky"), "elevated").otherwise("not_confirmed"), F.when(F.col("risky"), "report as a bound").otherwise("report as no evidence")),
    ]
    out = F.explode(F.array(*[F.struct(F.lit(a).alias("claim_area"), s.alias("status"), ev.alias("evidence")) for a, s, ev in rows])).alias("x")
    return c.select(out).select("x.*")


O_DECISIONS = f"""WITH {E_}, c AS (SELECT task, relation, dose, avg(did) AS m, 1.96::DOUBLE * stddev_samp(did) / sqrt(count(did)) AS h FROM e WHERE relation <> 'decoy' GROUP BY ALL),
o AS (SELECT count(*) AS cells, count(*) FILTER (m - h > 0) AS pos FROM c), b AS (SELECT * FROM c ORDER BY m DESC, task DESC, relation DESC, dose DESC LIMIT 1)
SELECT 'downstream_inflation' AS claim_area, CASE WHEN pos * 2 > cells THEN 'confirmed' ELSE 'not_confirmed' END AS status, printf('%d of %d cells; best %d:%s_%dx %.4f', pos, cells, task, relation, dose, m) AS evidence FROM o, b
UNION ALL SELECT 'external_baselines', 'ready_narrow_claim', '{sum(not m[3] for m in METHODS)} of {len(METHODS)} methods'
UNION ALL SELECT 'risk', CASE WHEN pos > 0 THEN 'elevated' ELSE 'not_confirmed' END, CASE WHEN pos > 0 THEN 'report as a bound' ELSE 'report as no evidence' END FROM o"""


def smallest_dose(spark: SparkSession, d: str) -> DataFrame:
    """WN-11: of each relation only the records of its smallest dose."""
    rel = F.element_at(F.array(*map(F.lit, ("parent", "stereo", "tautomer"))), (F.col("l_partkey") % 3 + 1).cast("int"))
    m = table(spark, d, "lineitem").select(rel.alias("relation"), (F.col("l_linenumber") + F.col("l_partkey") % 3).alias("dose"), "l_orderkey")
    low = m.groupBy("relation").agg(F.min("dose").alias("dose"))
    return rounded(m.join(low, ["relation", "dose"]).groupBy("relation", "dose").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("n_samples")))


O_DOSE = """WITH m AS (SELECT ['parent', 'stereo', 'tautomer'][l_partkey % 3 + 1] AS relation, l_linenumber + l_partkey % 3 AS dose, l_orderkey FROM lineitem)
SELECT relation, dose, count(*) AS n, count(DISTINCT l_orderkey) AS n_samples FROM m WHERE dose = (SELECT min(dose) FROM m k WHERE k.relation = m.relation) GROUP BY ALL"""


def exact_gold(spark: SparkSession, d: str) -> DataFrame:
    """JN-15: neighbours within groups of an equal key; where no group has two rows, every row with itself."""
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")).alias("key"))

    def gold(rows: DataFrame) -> DataFrame:
        near = pairs.adjacent_pairs(rows, "key", ["p_partkey"], "p_partkey").select("a", "b", F.lit("shared_key").alias("source"))
        any_ = near.agg((F.count("*") > 0).alias("some"))
        self_ = rows.join(F.broadcast(any_), F.lit(True)).where("not some").select(F.col("p_partkey").alias("a"), F.col("p_partkey").alias("b"), F.lit("identity").alias("source"))  # one row
        return near.unionAll(self_)

    apart = p.withColumn("key", F.concat_ws("|", "key", F.col("p_partkey").cast("string")))
    return gold(p).withColumn("bank", F.lit("registry")).unionAll(gold(apart).withColumn("bank", F.lit("apart")))


O_GOLD = """WITH p AS (SELECT p_partkey AS a, lead(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_partkey) AS b FROM part), n AS (SELECT a, b FROM p WHERE b IS NOT NULL)
SELECT a, b, 'shared_key' AS source, 'registry' AS bank FROM n UNION ALL SELECT p_partkey, p_partkey, 'identity', 'registry' FROM part WHERE (SELECT count(*) FROM n) = 0 UNION ALL SELECT p_partkey, p_partkey, 'identity', 'apart' FROM part"""


def assay_concordance(spark: SparkSession, d: str) -> DataFrame:
    """JN-13, AG-26: for pairs of suppliers the first 80 orders that both took part in; agreement and median difference, rolled up by relation with 0 for none."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_quantity").alias("q"))
    a, b = li.alias("a"), li.alias("b")
    x = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_suppkey") < F.col("b.l_suppkey")))
    x = x.select(F.col("a.l_orderkey").alias("o"), F.col("a.l_suppkey").alias("s1"), F.col("b.l_suppkey").alias("s2"), F.col("a.q").alias("q1"), F.col("b.q").alias("q2"))
    x = x.withColumn("n", F.row_number().over(Window.partitionBy("s1", "s2").orderBy("o"))).where("n <= 80")  # the report's limit
    rel = F.element_at(F.array(*map(F.lit, ("parent", "stereo", "tautomer"))), ((F.col("s1") + F.col("s2")) % 3 + 1).cast("int"))
    pair = x.groupBy("s1", "s2", rel.alias("relation")).agg(F.count("*").alias("shared"), F.avg(((F.col("q1") >= 25) == (F.col("q2") >= 25)).cast("double")).alias("agree"), F.percentile(F.abs(F.col("q1") - F.col("q2")), F.lit(0.5)).alias("diff"))
    every = spark.createDataFrame([("parent",), ("stereo",), ("tautomer",), ("exact",)], "relation string")
    out = every.join(pair, "relation", "left").groupBy("relation").agg(F.count("s1").alias("pairs"), F.coalesce(F.sum("shared"), F.lit(0)).alias("shared"), F.coalesce(F.avg("agree"), F.lit(0.0)).alias("agreement"), F.coalesce(F.avg("diff"), F.lit(0.0)).alias("mean_median_diff"))
    return rounded(out, 6)


O_CONCORDANCE = """WITH l AS (SELECT l_orderkey AS o, l_suppkey AS s, max(l_quantity)::DOUBLE AS q FROM lineitem GROUP BY ALL),
x AS (SELECT a.o, a.s AS s1, b.s AS s2, a.q AS q1, b.q AS q2 FROM l a JOIN l b ON a.o = b.o AND a.s < b.s QUALIFY row_number() OVER (PARTITION BY a.s, b.s ORDER BY a.o) <= 80),
p AS (SELECT ['parent', 'stereo', 'tautomer'][(s1 + s2) % 3 + 1] AS relation, s1, s2, count(*) AS shared, avg(((q1 >= 25) = (q2 >= 25))::INT::DOUBLE) AS agree, quantile_cont(abs(q1 - q2), 0.5) AS diff FROM x GROUP BY ALL)
SELECT relation, count(s1) AS pairs, coalesce(sum(shared), 0)::BIGINT AS shared, round(coalesce(avg(agree), 0), 6) AS agreement, round(coalesce(avg(diff), 0), 6) AS mean_median_diff FROM (SELECT unnest(['parent', 'stereo', 'tautomer', 'exact']) AS relation) LEFT JOIN p USING (relation) GROUP BY relation"""

SPECIALS, MASK, IGNORED = 5, 4, -100
LENGTH = 128


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    """item_id and ids: bos, the characters' numbers, eos, padding up to LENGTH."""
    b = table(spark, d, "benchmark")
    # an alphabet: it goes into the plan
    words = vocabulary(b, "text")
    ids = F.create_map(*[F.lit(x) for i, w in enumerate(words[SPECIALS:]) for x in (w, i + SPECIALS)])
    chars = F.filter(F.split(F.substring("text", 1, LENGTH - 2), ""), lambda c: c != "")
    body = F.transform(chars, lambda c: F.coalesce(F.try_element_at(ids, c), F.lit(3)))
    whole = F.concat(F.array(F.lit(1)), body, F.array(F.lit(2)))
    return b.select("item_id", F.concat(whole, F.array_repeat(F.lit(0), F.lit(LENGTH) - F.size(whole))).alias("ids"))


def encoded_items(spark: SparkSession, d: str) -> DataFrame:
    """FN-29, SNK-07: items as numbers of characters in a fixed length, with begin, end and padding."""
    return _encoded(spark, d).select("item_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


_ENCODED = f"""n AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + {SPECIALS - 1} AS id FROM (SELECT unnest(string_split(text, '')) AS token FROM benchmark) WHERE token <> '' GROUP BY token),
v AS (SELECT map(list(token), list(id)) AS m FROM n), w AS (SELECT item_id, list_concat([1], list_transform(list_filter(string_split(substr(text, 1, {LENGTH - 2}), ''), lambda c: c <> ''), lambda c: m[c]), [2]) AS w FROM benchmark, v),
i AS (SELECT item_id, list_concat(w, list_transform(range({LENGTH} - len(w)), lambda x: 0)) AS ids FROM w)"""
O_ENCODED = f"WITH {_ENCODED} SELECT item_id, array_to_string(ids, ' ') AS ids FROM i"


def masked_items(spark: SparkSession, d: str) -> DataFrame:
    """FN-30: 15 percent of the places masked by a hash of item and place, specials never; labels elsewhere ignored."""
    e = _encoded(spark, d).select("item_id", F.posexplode("ids").alias("at", "id"))
    hit = (stable_key(F.concat_ws(":", "item_id", "at"), 0) < 0.15) & (F.col("id") >= 3)
    e = e.withColumn("hit", hit)
    row = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", c.alias("v")))), lambda x: x["v"].cast("string")), " ")
    return e.groupBy("item_id").agg(row(F.when(F.col("hit"), MASK).otherwise(F.col("id"))).alias("input"), row(F.when(F.col("hit"), F.col("id")).otherwise(IGNORED)).alias("labels"))


O_MASKED = f"""WITH {_ENCODED}, u AS (SELECT item_id, unnest(range({LENGTH})) AS k, unnest(ids) AS id FROM i), h AS (SELECT *, id >= 3 AND {HASH("item_id || ':' || k")} < 0.15::DOUBLE AS hit FROM u)
SELECT item_id, string_agg(CASE WHEN hit THEN {MASK} ELSE id END, ' ' ORDER BY k) AS input, string_agg(CASE WHEN hit THEN id ELSE {IGNORED} END, ' ' ORDER BY k) AS labels FROM h GROUP BY item_id"""


def mixed_numbers(spark: SparkSession, d: str) -> DataFrame:
    """FN-17: SplitMix64 of event ids, as hexadecimal digits."""
    return table(spark, d, "events").select("event_id", F.lower(F.lpad(F.hex(split_mix(F.col("event_id"))), 16, "0")).alias("mixed"))


_M = lambda a, b: f"(({a}::UHUGEINT * {b}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
O_MIXED = f"""WITH a AS (SELECT event_id, ((event_id::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM events), b AS (SELECT event_id, {_M('xor(z, z >> 30)', 13787848793156543929)} AS z FROM a), c AS (SELECT event_id, {_M('xor(z, z >> 27)', 10723151780598845931)} AS z FROM b)
SELECT event_id, printf('%016x', xor(z, z >> 31)) AS mixed FROM c"""


def extended_pool(spark: SparkSession, d: str) -> DataFrame:
    """SM-05, SRC-27: queries filled up to 300 with seeded choices among the other customers, each with its baseline's place."""
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 10 == 0).alias("query"), F.col("c_mktsegment").alias("seed_set"))
    own = c.where("query").select("c_custkey", "seed_set", F.lit("query").alias("pool"))
    need = own.agg(F.greatest(F.lit(0), F.lit(300) - F.count("*")).alias("need"))
    # the pool's size is the feature: at most 300 are ranked and kept
    rest = c.where("not query").orderBy(stable_key(F.col("c_custkey"), 5), "c_custkey").limit(300).withColumn("n", F.row_number().over(Window.orderBy(stable_key(F.col("c_custkey"), 5), "c_custkey")))
    more = rest.join(F.broadcast(need), F.col("n") <= F.col("need")).select("c_custkey", "seed_set", F.lit("extension").alias("pool"))
    set_ = F.when(F.col("seed_set") == "BUILDING", "single").when(F.col("seed_set") == "MACHINERY", "extra4").otherwise("old3")
    return own.unionAll(more).select("c_custkey", "pool", baseline_artifact(set_, F.lower("seed_set"), "clean_old", "clean_extra").alias("baseline"))


O_POOL = f"""WITH c AS (SELECT *, c_custkey % 10 = 0 AS q FROM customer), m AS (SELECT *, row_number() OVER (ORDER BY {HASH('c_custkey', 5)}, c_custkey) AS n FROM c WHERE NOT q), u AS (SELECT c_custkey, c_mktsegment AS s, 'query' AS pool FROM c WHERE q UNION ALL SELECT c_custkey, c_mktsegment, 'extension' FROM m WHERE n <= 300 - (SELECT count(*) FROM c WHERE q))
SELECT c_custkey, pool, CASE s WHEN 'BUILDING' THEN lower(s) WHEN 'MACHINERY' THEN 'clean_extra' ELSE 'clean_old' END AS baseline FROM u"""


def finite_metrics(spark: SparkSession, d: str) -> DataFrame:
    """FLT-05, FN-33: rows whose six metrics are all finite, and the vector of their means with win, tie and loss rates."""
    e = _effects(spark, d)
    names = ("did", "delta_affected", "delta_control", "win_affected", "win_control", "n_affected")
    e = e.where(reduce(lambda a, b: a & b, [F.col(m).isNotNull() & ~F.isnan(F.col(m).cast("double")) for m in names]))
    rate = lambda c: F.avg(c.cast("double"))
    return rounded(e.groupBy("relation").agg(F.count("*").alias("cells"), *[F.avg(m).alias(f"mean_{m}") for m in names], rate(F.col("did") > 1e-12).alias("win_rate"), rate(F.abs("did") <= 1e-12).alias("tie_rate"), rate(F.col("did") < -1e-12).alias("loss_rate")))


O_FINITE = """WITH x AS (SELECT year(l_shipdate) AS task, ['parent', 'stereo', 'tautomer', 'decoy'][l_partkey % 4 + 1] AS relation, l_suppkey % 2 + 1 AS dose, l_linenumber AS seed, l_returnflag = 'R' AS a, l_tax - l_discount AS delta FROM lineitem),
e AS (SELECT relation, count(*) FILTER (a) AS n, avg(delta) FILTER (a) AS da, avg(delta) FILTER (NOT a) AS dc, avg((delta < 0)::INT::DOUBLE) FILTER (a) AS wa, avg((delta < 0)::INT::DOUBLE) FILTER (NOT a) AS wc, avg(delta) FILTER (NOT a) - avg(delta) FILTER (a) AS did FROM x GROUP BY task, relation, dose, seed)
SELECT relation, count(*) AS cells, round(avg(did), 8) AS mean_did, round(avg(da), 8) AS mean_delta_affected, round(avg(dc), 8) AS mean_delta_control, round(avg(wa), 8) AS mean_win_affected, round(avg(wc), 8) AS mean_win_control, round(avg(n), 8) AS mean_n_affected,
 round(avg((did > 1e-12)::INT::DOUBLE), 8) AS win_rate, round(avg((abs(did) <= 1e-12)::INT::DOUBLE), 8) AS tie_rate, round(avg((did < -1e-12)::INT::DOUBLE), 8) AS loss_rate FROM e WHERE did IS NOT NULL GROUP BY relation"""

QUERIES = {f.__name__: (f, o) for f, o in (
    (registry_metrics, O_METRICS), (criteria, O_CRITERIA), (decision_rows, O_DECISIONS), (smallest_dose, O_DOSE), (exact_gold, O_GOLD), (assay_concordance, O_CONCORDANCE), (encoded_items, O_ENCODED), (masked_items, O_MASKED), (mixed_numbers, O_MIXED), (extended_pool, O_POOL), (finite_metrics, O_FINITE),
)}
