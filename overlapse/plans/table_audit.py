"""Effects, pair banks, registries and reports on the driver's tables; roles are mapped in the README."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from overlapse.functions.scalars import as_bool, ci_text, decision_support, dose_of, effect_support, relation_of, seed_support
from overlapse.operators import audit, detect, effect, pairs, report, selection
from overlapse.plans.text_audit import HASH, rounded
from overlapse.sources.readers import table


#: l_orderkey and l_linenumber repeat in the generated table; with these a row is one prediction.
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def _losses(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Clean and contaminated predictions, one loss a row."""
    li = table(spark, d, "lineitem")
    keys = KEYS
    common = [*keys, (F.col("l_returnflag") == "R").alias("affected"), (F.col("l_linestatus") == "O").cast("double").alias("y"), F.col("l_suppkey").alias("cluster")]
    return li.select(*common, F.col("l_discount").alias("loss")), li.select(*keys, F.col("l_tax").alias("loss"))


def _paired(spark: SparkSession, d: str) -> DataFrame:
    return effect.paired(*_losses(spark, d), KEYS).withColumn("seed", F.col("l_linenumber"))


P = "p AS (SELECT l_linenumber AS seed, l_returnflag = 'R' AS affected, (l_linestatus = 'O')::INT::DOUBLE AS y, l_suppkey AS cluster, l_tax - l_discount AS delta, l_discount AS clean_loss FROM lineitem)"


def did_by_seed(spark: SparkSession, d: str) -> DataFrame:
    """JN-01, AG-11: difference in differences of paired losses, per seed."""
    return rounded(effect.did(_paired(spark, d), "seed"))


O_DID = f"""WITH {P} SELECT seed, count(*) AS n_test, count(*) FILTER (affected) AS n_affected, count(*) FILTER (NOT affected) AS n_control, round(avg(delta) FILTER (affected), 8) AS delta_affected, round(avg(delta) FILTER (NOT affected), 8) AS delta_control,
 round(avg((delta < 0)::INT::DOUBLE) FILTER (affected), 8) AS win_affected, round(avg((delta < 0)::INT::DOUBLE) FILTER (NOT affected), 8) AS win_control, round(avg(delta) FILTER (NOT affected) - avg(delta) FILTER (affected), 8) AS did FROM p GROUP BY seed"""


def did_label_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """AG-12: differences per label weighted by affected rows."""
    return rounded(effect.did_label_adjusted(_paired(spark, d), "y", "seed"))


_LA = "l AS (SELECT seed, y, count(*) FILTER (affected) AS n, avg(delta) FILTER (NOT affected) - avg(delta) FILTER (affected) AS did FROM p GROUP BY ALL)"
O_LABEL = f"WITH {P}, {_LA} SELECT seed, round(sum(n * did) / sum(n), 8) AS did_label_adjusted, round(avg(did), 8) AS did_label_equal, count(*) AS n_labels FROM l WHERE did IS NOT NULL GROUP BY seed"


def pairing_check(spark: SparkSession, d: str) -> DataFrame:
    """JN-01, JN-06: rows of either side without a partner."""
    clean, other = _losses(spark, d)
    return rounded(effect.unmatched(clean, other.where("loss > 0"), ["l_orderkey", "l_linenumber"]).distinct())


O_PAIRING = "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem GROUP BY ALL HAVING NOT bool_or(l_tax > 0)"


def three_way(spark: SparkSession, d: str) -> DataFrame:
    """JN-02, JN-03: clean, semantic and decoy losses side by side, per supplier."""
    li = table(spark, d, "lineitem")
    one = lambda c, n: li.select(*KEYS, F.col(c).alias(n))
    j = one("l_discount", "clean").join(one("l_tax", "semantic"), KEYS).join(one("l_quantity", "decoy"), KEYS)
    return rounded(j.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg(F.col("semantic") - F.col("clean")).alias("semantic_delta"), F.avg(F.col("decoy") - F.col("clean")).alias("decoy_delta")))


O_THREE = "SELECT l_suppkey, count(*) AS n, round(avg(l_tax - l_discount), 8) AS semantic_delta, round(avg(l_quantity - l_discount), 8) AS decoy_delta FROM lineitem GROUP BY l_suppkey"


def _effects(spark: SparkSession, d: str) -> DataFrame:
    """Effects per (task, relation, dose, seed); relations stand for ship mode of a line, decoy among them."""
    li = table(spark, d, "lineitem")
    rel = F.element_at(F.array(*[F.lit(x) for x in ("parent", "stereo", "tautomer", "decoy")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    x = li.select(F.year("l_shipdate").alias("task"), rel.alias("relation"), (F.col("l_suppkey") % 2 + 1).cast("int").alias("dose"), F.col("l_linenumber").alias("seed"), (F.col("l_returnflag") == "R").alias("affected"), (F.col("l_tax") - F.col("l_discount")).alias("delta"))
    return effect.did(x, "task", "relation", "dose", "seed")


E_ = """x AS (SELECT year(l_shipdate) AS task, ['parent', 'stereo', 'tautomer', 'decoy'][l_partkey % 4 + 1] AS relation, l_suppkey % 2 + 1 AS dose, l_linenumber AS seed, l_returnflag = 'R' AS a, l_tax - l_discount AS delta FROM lineitem),
e AS (SELECT task, relation, dose, seed, count(*) FILTER (a) AS n_affected, avg(delta) FILTER (NOT a) - avg(delta) FILTER (a) AS did FROM x GROUP BY ALL)"""


def minus_decoy(spark: SparkSession, d: str) -> DataFrame:
    """JN-05: effects less the decoy's of the same task, dose and seed."""
    e = effect.minus_decoy(_effects(spark, d), ["task", "dose", "seed"])
    return rounded(e.select("task", "relation", "dose", "seed", "did", "decoy_value", "net"))


O_MINUS = f"WITH {E_} SELECT a.task, a.relation, a.dose, a.seed, round(a.did, 8) + 0 AS did, round(b.did, 8) + 0 AS decoy_value, round(a.did - b.did, 8) + 0 AS net FROM e a LEFT JOIN e b ON b.relation = 'decoy' AND a.task = b.task AND a.dose = b.dose AND a.seed = b.seed WHERE a.relation <> 'decoy'"


def relation_pivot(spark: SparkSession, d: str) -> DataFrame:
    """AG-15: mean effect of each relation as columns."""
    return rounded(_effects(spark, d).groupBy("task", "dose").pivot("relation", ["parent", "stereo", "tautomer", "decoy"]).agg(F.avg("did")))


O_PIVOT = f"WITH {E_} SELECT task, dose, {', '.join(f'round(avg(did) FILTER (relation = {chr(39)}{r}{chr(39)}), 8) AS {r}' for r in ('parent', 'stereo', 'tautomer', 'decoy'))} FROM e GROUP BY task, dose"


def relation_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """AG-16: columns back to rows, nulls dropped."""
    p = relation_pivot(spark, d)
    return p.unpivot(["task", "dose"], ["parent", "stereo", "tautomer", "decoy"], "relation", "mean_did").where("mean_did is not null")


O_UNPIVOT = f"WITH {E_} SELECT task, dose, relation, round(avg(did), 8) AS mean_did FROM e GROUP BY ALL HAVING avg(did) IS NOT NULL"


def quartile_summary(spark: SparkSession, d: str) -> DataFrame:
    """AG-13, AG-14, FN-36, AG-33: spread of effects over seeds, with a support label."""
    s = effect.seed_summary(_effects(spark, d), "did", "task", "relation", "dose")
    return rounded(s.withColumn("support", seed_support(F.col("n_positive"), F.col("n"))), 7)


O_QUARTILES = f"""WITH {E_}, g AS (SELECT task, relation, dose, count(did) AS n, avg(did) AS mean, stddev_samp(did) AS sd, quantile_cont(did, 0.25) AS q25, quantile_cont(did, 0.5) AS median, quantile_cont(did, 0.75) AS q75, min(did) AS least, max(did) AS most, count(*) FILTER (did > 0) AS n_positive FROM e GROUP BY ALL)
SELECT task, relation, dose, n, round(mean, 7) AS mean, round(sd, 7) AS sd, round(q25, 7) AS q25, round(median, 7) AS median, round(q75, 7) AS q75, round(least, 7) AS least, round(most, 7) AS most, n_positive, round(sd / sqrt(n), 7) AS sem, round(1.96 * sd / sqrt(n), 7) AS half_width,
 CASE WHEN n_positive = n THEN 'all seeds' WHEN n_positive * 2 >= n THEN 'most seeds' ELSE 'few seeds' END AS support FROM g"""


def task_top(spark: SparkSession, d: str) -> DataFrame:
    """TK-03, TK-07, AG-31: the three greatest effects of each task."""
    w = Window.partitionBy("task").orderBy(F.desc_nulls_last("did"), "relation", "dose", "seed")
    return rounded(_effects(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("task", "rank", "relation", "dose", "seed", "did"))


O_TOP = f"WITH {E_} SELECT task, row_number() OVER (PARTITION BY task ORDER BY did DESC NULLS LAST, relation, dose, seed) AS rank, relation, dose, seed, round(did, 8) AS did FROM e QUALIFY rank <= 3"


def global_top(spark: SparkSession, d: str) -> DataFrame:
    """TK-01, TK-04: the twenty greatest effects of all."""
    e = _effects(spark, d).orderBy(F.desc_nulls_last("did"), "task", "relation", "dose", "seed").limit(20)
    return rounded(e.select("task", "relation", "dose", "seed", "did"))


O_GLOBAL = f"WITH {E_} SELECT task, relation, dose, seed, round(did, 8) AS did FROM e ORDER BY e.did DESC NULLS LAST, task, relation, dose, seed LIMIT 20"


def relation_dose(spark: SparkSession, d: str) -> DataFrame:
    """AG-31: means by relation and dose, and in how many tasks they are positive; totals by grouping sets."""
    e = _effects(spark, d).groupBy("task", "relation", "dose").agg(F.avg("did").alias("m"))
    g = e.groupingSets([["relation", "dose"], ["relation"], []], "relation", "dose")
    return rounded(g.agg(F.count("*").alias("n_cells"), F.avg("m").alias("mean"), F.count_if(F.col("m") > 0).alias("n_positive")))


O_RELDOSE = f"WITH {E_}, c AS (SELECT task, relation, dose, avg(did) AS m FROM e GROUP BY ALL) SELECT relation, dose, count(*) AS n_cells, round(avg(m), 8) AS mean, count(*) FILTER (m > 0) AS n_positive FROM c GROUP BY GROUPING SETS ((relation, dose), (relation), ())"


def meta_fixed_effect(spark: SparkSession, d: str) -> DataFrame:
    """AG-28, FN-24: inverse-variance mean of the tasks' effects, Q and I²."""
    s = effect.seed_summary(_effects(spark, d), "did", "task", "relation")
    m = effect.fixed_effect(s, "mean", "sem", "relation")
    return rounded(m.withColumn("text", ci_text(F.col("mean"), F.col("low"), F.col("high"))), 6)


O_META = f"""WITH {E_}, s AS (SELECT task, relation, avg(did) AS x, stddev_samp(did) / sqrt(count(did)) AS se FROM e GROUP BY ALL), w AS (SELECT relation, count(*) AS k, sum(1 / (se * se)) AS sw, sum(x / (se * se)) AS swx, sum(x * x / (se * se)) AS swxx FROM s WHERE se > 0 GROUP BY relation),
m AS (SELECT relation, k, swx / sw AS mean, 1 / sqrt(sw) AS se, greatest(0, swxx - swx * swx / sw) AS q FROM w)
SELECT relation, k, round(mean, 6) AS mean, round(se, 6) AS se, round(q, 6) AS q, round(mean - 1.96 * se, 6) AS low, round(mean + 1.96 * se, 6) AS high, round(greatest(0, coalesce((q - (k - 1)) / nullif(q, 0), 0)), 6) AS i2, printf('%.4f [%.4f, %.4f]', mean, mean - 1.96 * se, mean + 1.96 * se) AS text FROM m"""


def equivalence(spark: SparkSession, d: str) -> DataFrame:
    """AG-29, AG-33: equivalence of effects within two margins."""
    s = effect.seed_summary(_effects(spark, d), "did", "task", "relation", "dose")
    low, high = F.col("mean") - F.col("half_width"), F.col("mean") + F.col("half_width")
    x = s.select("relation", decision_support(low, high).alias("support"), F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), effect.equivalence(low, high, m).alias("status")) for m in (0.01, 0.02)])).alias("x"))
    return x.groupBy("relation", "x.margin", "x.status", "support").agg(F.count("*").alias("n"))


O_EQUIVALENCE = f"""WITH {E_}, s AS (SELECT relation, avg(did) - 1.96 * (stddev_samp(did) / sqrt(count(did))) AS lo, avg(did) + 1.96 * (stddev_samp(did) / sqrt(count(did))) AS hi FROM e GROUP BY task, relation, dose)
SELECT relation, m::DOUBLE AS margin, CASE WHEN lo > -m AND hi < m THEN 'equivalent' WHEN lo > m THEN 'above' WHEN hi < -m THEN 'below' ELSE 'undecided' END AS status,
 CASE WHEN lo > 0 THEN 'positive' WHEN hi < 0 THEN 'negative' ELSE 'inconclusive' END AS support, count(*) AS n FROM s, (SELECT unnest([0.01, 0.02]) AS m) GROUP BY ALL"""


def support_buckets(spark: SparkSession, d: str) -> DataFrame:
    """AG-33: effects by support of their affected rows."""
    return _effects(spark, d).select(effect_support(F.col("n_affected")).alias("support")).groupBy("support").agg(F.count("*").alias("n"))


O_SUPPORT = f"WITH {E_} SELECT CASE WHEN n_affected >= 100 THEN 'strong' WHEN n_affected >= 30 THEN 'moderate' WHEN n_affected >= 10 THEN 'limited' ELSE 'sparse' END AS support, count(*) AS n FROM e GROUP BY 1"


def ols_affected(spark: SparkSession, d: str) -> DataFrame:
    """AG-35: the affected coefficient with covariates, per seed."""
    return rounded(effect.ols_affected(_paired(spark, d), "seed"), 6)


def slope_affected(spark: SparkSession, d: str) -> DataFrame:
    """AG-35, one covariate."""
    return rounded(effect.slope_affected(_paired(spark, d), "seed"), 7)


O_SLOPE = f"WITH {P} SELECT seed, round(regr_slope(delta, affected::INT::DOUBLE), 7) AS affected_coef FROM p GROUP BY seed"


#: Eight picks from each digest.
PICKS = """h AS (SELECT draw, b, k, sha256('0:' || draw || '|' || b) AS digest FROM e8), h8 AS (SELECT draw, k, digest, unnest(range(0, least(8, k - 8 * b))) AS p FROM h),
i AS (SELECT draw, (('0x' || substr(digest, 8 * p + 1, 8))::BIGINT * k) >> 32 AS pick FROM h8)"""


def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """BS-01, BS-05: 20,000 draws of suppliers with replacement."""
    b = effect.cluster_bootstrap(_paired(spark, d), "cluster", "delta", 20_000)
    return rounded(effect.draw_summary(b, "value"), 7)


O_CLUSTER = f"""WITH {P}, g AS (SELECT cluster, sum(delta) AS s, count(delta) AS n, row_number() OVER (ORDER BY cluster) - 1 AS r FROM p GROUP BY cluster),
k AS (SELECT count(*) AS k FROM g), e8 AS (SELECT draw, unnest(range(0, (k + 7) // 8)) AS b, k FROM k, (SELECT unnest(range(0, 20000)) AS draw)), {PICKS},
v AS (SELECT draw, sum(s) / sum(n) AS v FROM i JOIN g ON pick = r GROUP BY draw)
SELECT count(v) AS draws, round(avg(v), 7) AS mean, round(quantile_cont(v, 0.025), 7) AS low, round(quantile_cont(v, 0.975), 7) AS high, round(avg((v > 0)::INT::DOUBLE), 7) AS p_positive FROM v"""


def seed_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """BS-02: 2,000 draws of seeds with replacement."""
    return rounded(effect.draw_summary(effect.seed_bootstrap(effect.did(_paired(spark, d), "seed"), "seed", "did", 2000), "value"), 7)


O_SEED = f"""WITH {P}, e AS (SELECT seed, avg(delta) FILTER (NOT affected) - avg(delta) FILTER (affected) AS did FROM p GROUP BY seed), g AS (SELECT did, row_number() OVER (ORDER BY seed) - 1 AS r FROM e),
k AS (SELECT count(*) AS k FROM g), e8 AS (SELECT draw, unnest(range(0, (k + 7) // 8)) AS b, k FROM k, (SELECT unnest(range(0, 2000)) AS draw)), {PICKS},
v AS (SELECT draw, avg(did) AS v FROM i JOIN g ON pick = r GROUP BY draw)
SELECT count(v) AS draws, round(avg(v), 7) AS mean, round(quantile_cont(v, 0.025), 7) AS low, round(quantile_cont(v, 0.975), 7) AS high, round(avg((v > 0)::INT::DOUBLE), 7) AS p_positive FROM v"""


def _cell_draws(spark: SparkSession, d: str, draws: int = 2000) -> DataFrame:
    p = _paired(spark, d).withColumn("task", F.col("cluster") % 5)
    return effect.two_level_bootstrap(p, draws, 0, "task")


def two_level_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """BS-03: seeds, then clusters, with replacement; label-adjusted."""
    return rounded(effect.draw_summary(_cell_draws(spark, d), "value", "task"), 6)


def global_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """BS-04: cells' draws joined draw by draw over resampled tasks."""
    return rounded(effect.draw_summary(effect.global_bootstrap(_cell_draws(spark, d), "task"), "value"), 6)


def dispersion(spark: SparkSession, d: str) -> DataFrame:
    """AG-36: variance between cells against centred draws."""
    p = _paired(spark, d).withColumn("task", F.col("cluster") % 5)
    cells = effect.did_label_adjusted(p, "y", "task").select("task", F.col("did_label_adjusted").alias("value"))
    return rounded(effect.dispersion(cells, _cell_draws(spark, d), "task"), 10)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score")), "doc_id").select("doc_id", "lang", F.col("quality").alias("y"), "toxic", "score")


S = "s AS (SELECT doc_id, lang, quality AS y, toxic, n_chars::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"
CURVE = "g AS (SELECT score, count(*) AS n, sum(y) AS pos FROM s GROUP BY score), c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n - pos) OVER (ORDER BY score DESC) AS fp, (SELECT sum(pos) FROM g) AS p, (SELECT sum(n - pos) FROM g) AS q FROM g)"


def auroc(spark: SparkSession, d: str) -> DataFrame:
    """WN-04, AG-19."""
    return rounded(pairs.auroc(_scored(spark, d), "score", "y"))


O_AUROC = f"WITH {S}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM s) SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))), 8) AS auroc FROM r"


def auprc(spark: SparkSession, d: str) -> DataFrame:
    """WN-05, AG-19: ties as one step."""
    return rounded(pairs.auprc(_scored(spark, d), "score", "y"))


O_AUPRC = f"WITH {S}, {CURVE} SELECT round(sum(pos / p::DOUBLE * tp / (tp + fp)), 8) AS auprc FROM c"


def auprc_ordered(spark: SparkSession, d: str) -> DataFrame:
    """WN-05: ties in order of the id."""
    return rounded(pairs.average_precision_ordered(_scored(spark, d), "score", "y", "doc_id"))


O_AP = f"WITH {S}, r AS (SELECT y, row_number() OVER w AS k, sum(y) OVER (w ROWS UNBOUNDED PRECEDING) AS tp FROM s WINDOW w AS (ORDER BY score DESC, doc_id)) SELECT round(sum(tp / k::DOUBLE) FILTER (y = 1) / (SELECT sum(y) FROM s), 8) AS auprc_ordered FROM r"


def threshold95(spark: SparkSession, d: str) -> DataFrame:
    """WN-06."""
    return rounded(pairs.threshold_at(_scored(spark, d), "score", "y"))


O_THRESHOLD = f"WITH {S}, {CURVE} SELECT score AS threshold, round(tp / p::DOUBLE, 8) AS tpr, round(fp / q::DOUBLE, 8) AS fpr, round(tp / (tp + fp)::DOUBLE, 8) AS precision_at FROM c WHERE tp / p::DOUBLE >= 0.95 ORDER BY fp / q::DOUBLE, -tp / (tp + fp)::DOUBLE, -score LIMIT 1"


def pair_metrics(spark: SparkSession, d: str) -> DataFrame:
    """AG-18, AG-20, AG-21: counts at a threshold, Wilson bounds, and PPV at four prevalences, per language."""
    return rounded(pairs.with_ppv(pairs.confusion_counts(_scored(spark, d), F.col("score") >= 500, "y", "lang")))


_W = lambda z, s: f"((fp / n::DOUBLE + {z * z} / (2 * n)) / (1 + {z * z} / n) {s} {z} / (1 + {z * z} / n) * sqrt(fp / n::DOUBLE * (1 - fp / n::DOUBLE) / n + {z * z} / (4.0::DOUBLE * n * n)))"
O_METRICS = f"""WITH {S}, c AS (SELECT lang, count(*) FILTER (score >= 500 AND y = 1) AS tp, count(*) FILTER (score >= 500 AND y <> 1) AS fp, count(*) FILTER (score < 500 AND y = 1) AS fn, count(*) FILTER (score < 500 AND y <> 1) AS tn FROM s GROUP BY lang),
r AS (SELECT *, fp + tn AS n, tp / nullif(tp + fn, 0)::DOUBLE AS tpr, fp / nullif(fp + tn, 0)::DOUBLE AS fpr FROM c)
SELECT lang, tp, fp, fn, tn, round(tpr, 8) AS tpr, round(fpr, 8) AS fpr, CASE WHEN n > 0 THEN round(greatest(0, {_W(1.959963984540054, '-')}), 8) END AS fpr_low, CASE WHEN n > 0 THEN round(least(1, {_W(1.959963984540054, '+')}), 8) END AS fpr_high, CASE WHEN n > 0 THEN round(least(1, {_W(1.6448536269514722, '+')}), 8) END AS fpr_upper,
 p::DOUBLE AS prevalence, round(tpr * p / nullif(tpr * p + fpr * (1 - p), 0), 8) AS ppv FROM r, (SELECT unnest([0.001::DOUBLE, 0.01::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE]) AS p)"""


def negative_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """AG-22, JN-21: negatives by language: false positives, mean score, shares above two thresholds."""
    n = _scored(spark, d).where("y = 0")
    return rounded(n.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 500).alias("n_false"), F.avg("score").alias("mean_score"), F.avg((F.col("score") >= 800).cast("double")).alias("share_800"), F.avg((F.col("score") >= 900).cast("double")).alias("share_900")))


O_NEGATIVES = f"WITH {S} SELECT lang, count(*) AS n, count(*) FILTER (score >= 500) AS n_false, round(avg(score), 8) AS mean_score, round(avg((score >= 800)::INT::DOUBLE), 8) AS share_800, round(avg((score >= 900)::INT::DOUBLE), 8) AS share_900 FROM s WHERE y = 0 GROUP BY lang"


def task_metrics(spark: SparkSession, d: str) -> DataFrame:
    """AG-19: RMSE, MAE and R² of a prediction."""
    x = table(spark, d, "part").select("p_brand", F.col("p_retailprice").alias("y"), (F.col("p_size") * 10 + 1000.0).alias("p"))
    return rounded(pairs.regression_metrics(x, "y", "p", "p_brand"), 5)


O_TASK = "WITH x AS (SELECT p_brand, p_retailprice AS y, p_size * 10 + 1000.0::DOUBLE AS p FROM part) SELECT p_brand, round(sqrt(avg((y - p) * (y - p))), 5) AS rmse, round(avg(abs(y - p)), 5) AS mae, round(1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(y), 0), 5) AS r2 FROM x GROUP BY p_brand"


def _classes(spark: SparkSession, d: str) -> DataFrame:
    """Event types as gold classes, and what the next class of the id says."""
    names = F.col("event_type")
    said = F.when(F.col("event_id") % 5 == 0, F.lit("none")).otherwise(names)
    return table(spark, d, "events").select("event_id", names.alias("gold"), said.alias("said"))


CLASSES = ("click", "error", "purchase", "signup", "view")


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """AG-17, JN-22: gold pairs joined with predictions on id and class, one missing being its own class; counts as a pivot."""
    x = _classes(spark, d)
    gold = x.select("event_id", "gold")
    said = x.where("event_id % 7 <> 0")
    j = gold.join(said, ["event_id", "gold"], "left").withColumn("said", F.coalesce("said", F.lit("missing")))
    return rounded(pairs.confusion_matrix(j, "gold", "said", [*CLASSES, "none", "missing"]))


C = "c AS (SELECT event_type AS gold, CASE WHEN event_id % 5 = 0 THEN 'none' ELSE event_type END AS said FROM events)"
O_CONFUSION = "WITH m AS (SELECT event_type AS gold, CASE WHEN event_id % 7 = 0 THEN 'missing' WHEN event_id % 5 = 0 THEN 'none' ELSE event_type END AS said FROM events) SELECT gold, " + ", ".join(f'count(*) FILTER (said = \'{c}\') AS "{c}"' for c in (*CLASSES, "none", "missing")) + " FROM m GROUP BY gold"


def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    """AG-18: precision, recall and F1 of each class, and the macro F1."""
    return rounded(pairs.class_metrics(_classes(spark, d), "gold", "said"))


O_CLASSES = f"""WITH {C}, k AS (SELECT DISTINCT gold AS cls FROM c UNION SELECT said FROM c),
m AS (SELECT cls, (SELECT count(*) FROM c WHERE gold = cls AND said = cls) AS tp, (SELECT count(*) FROM c WHERE gold = cls) AS support, (SELECT count(*) FROM c WHERE said = cls) AS said FROM k),
f AS (SELECT *, 2 * tp / nullif(said + support, 0)::DOUBLE AS f1 FROM m)
SELECT cls, tp, support, said, round(tp / nullif(said, 0)::DOUBLE, 8) AS precision, round(tp / nullif(support, 0)::DOUBLE, 8) AS recall, round(f1, 8) AS f1, round((SELECT avg(coalesce(f1, 0)) FROM f WHERE support > 0), 8) AS macro_f1 FROM f"""


def hard_negatives_band(spark: SparkSession, d: str) -> DataFrame:
    """JN-16, JN-17, FLT-06: for each part one other of its brand within a price and size band and of another type, by hash."""
    ok = F.col("a.p_type") != F.col("b.p_type")
    return pairs.banded_negatives(table(spark, d, "part"), "p_partkey", "p_brand", {"p_retailprice": 25.0, "p_size": 1.0}, ok)


O_BAND = f"""SELECT query_id, target_id FROM (SELECT a.p_partkey AS query_id, b.p_partkey AS target_id FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) <= 25 AND abs(a.p_size - b.p_size) <= 1 AND a.p_type <> b.p_type)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {HASH("query_id || '|' || target_id")}, target_id) = 1"""


def high_similarity_negatives(spark: SparkSession, d: str) -> DataFrame:
    """JN-18, JN-19, TK-05: for each query vector the five most similar vectors of another label."""
    c = detect.cosine_top(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0, 5, 5, label="label")
    return c.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("neighbour").alias("vec_id"))


_DOT = lambda a, b: f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
_COS = f"{_DOT('a.embedding', 'b.embedding')} / sqrt({_DOT('a.embedding', 'a.embedding')} * {_DOT('b.embedding', 'b.embedding')})"
O_SIMILAR = f"SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 5) DESC, b.vec_id) AS rank, b.vec_id FROM embeddings a JOIN embeddings b ON a.label <> b.label WHERE a.vec_id % 50 = 0 QUALIFY rank <= 5"


def similar_bands(spark: SparkSession, d: str) -> DataFrame:
    """JN-18, JN-19, TK-05: negatives of another label at 0.90 and 0.80, at most 5 a query and 200 a band, the most similar first; a scan ends at its threshold."""
    c = detect.cosine_top(table(spark, d, "embeddings"), F.col("vec_id") % 10 == 0, 5, 5, label="label", least=0.2)
    both = c.select("query_id", "neighbour", "score", F.explode(F.array(F.lit(0.9), F.lit(0.8), F.lit(0.2))).alias("band")).where(F.col("score") >= F.col("band"))
    w = Window.partitionBy("band").orderBy(F.desc("score"), "query_id", "neighbour")
    return both.withColumn("n", F.row_number().over(w)).where("n <= 200").select("band", "query_id", "neighbour")


def cosine_top1(spark: SparkSession, d: str) -> DataFrame:
    """JN-09 by cosine: the most similar other vector of each query vector."""
    c = detect.cosine_top(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0, 1, 6)
    return c.select("query_id", "neighbour", F.round("score", 4).alias("score"))


O_BANDS = f"""WITH c AS (SELECT a.vec_id AS q, b.vec_id AS t, round({_COS}, 5) AS s FROM embeddings a JOIN embeddings b ON a.label <> b.label WHERE a.vec_id % 10 = 0), k AS (SELECT * FROM c WHERE s >= 0.2 QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, t) <= 5)
SELECT band::DOUBLE AS band, q AS query_id, t AS neighbour FROM k, (SELECT unnest([0.9, 0.8, 0.2]) AS band) WHERE s >= band QUALIFY row_number() OVER (PARTITION BY band ORDER BY s DESC, q, t) <= 200"""
O_COSINE = f"SELECT a.vec_id AS query_id, b.vec_id AS neighbour, round(round({_COS}, 6), 4) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, b.vec_id) = 1"


def registry_parent_pairs(spark: SparkSession, d: str) -> DataFrame:
    """JN-12: hierarchy joined with structures twice: each order's customer, and the first customer of that nation."""
    c = table(spark, d, "customer")
    h = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("parent"))
    x = c.join(h, "c_nationkey").join(c.select(F.col("c_custkey").alias("parent"), F.col("c_name").alias("parent_name")), "parent")
    return x.where("c_custkey <> parent and c_name <> parent_name").select("c_custkey", "parent", "parent_name")


O_PARENTS = "SELECT c.c_custkey, p.c_custkey AS parent, p.c_name AS parent_name FROM customer c JOIN (SELECT c_nationkey, min(c_custkey) AS k FROM customer GROUP BY 1) h USING (c_nationkey) JOIN customer p ON p.c_custkey = k WHERE c.c_custkey <> k AND c.c_name <> p.c_name"


def shared_assays(spark: SparkSession, d: str) -> DataFrame:
    """JN-13, AG-26: parts supplied in the same order, per pair: orders shared, agreement, median difference."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    li = li.groupBy("l_orderkey", "l_suppkey").agg(F.max("l_quantity").alias("q"))
    a, b = li.alias("a"), li.alias("b")
    x = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_suppkey") < F.col("b.l_suppkey")))
    x = x.select(F.col("a.l_suppkey").alias("s1"), F.col("b.l_suppkey").alias("s2"), F.col("a.q").alias("q1"), F.col("b.q").alias("q2"))
    return rounded(x.groupBy("s1", "s2").agg(F.count("*").alias("n"), F.avg(((F.col("q1") >= 25) == (F.col("q2") >= 25)).cast("double")).alias("agreement"), F.percentile(F.abs(F.col("q1") - F.col("q2")), F.lit(0.5)).alias("median_diff")))


O_ASSAYS = """WITH l AS (SELECT l_orderkey, l_suppkey, max(l_quantity)::DOUBLE AS q FROM lineitem GROUP BY ALL)
SELECT a.l_suppkey AS s1, b.l_suppkey AS s2, count(*) AS n, round(avg(((a.q >= 25) = (b.q >= 25))::INT::DOUBLE), 8) AS agreement, round(quantile_cont(abs(a.q - b.q), 0.5), 8) AS median_diff FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL"""


def adjacent_stereo(spark: SparkSession, d: str) -> DataFrame:
    """JN-14, JN-15, WN-10: neighbours by (signature, id) within a group, with different signatures."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return pairs.adjacent_pairs(o, "o_custkey", ["o_orderpriority", "o_orderkey"], "o_orderkey", "o_orderpriority")


O_ADJACENT = "SELECT o_custkey, a, b FROM (SELECT o_custkey, o_orderkey AS a, lead(o_orderkey) OVER w AS b, o_orderpriority AS s, lead(o_orderpriority) OVER w AS t FROM orders WHERE o_custkey IS NOT NULL WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey)) WHERE b IS NOT NULL AND s <> t"


def disjoint_negatives(spark: SparkSession, d: str) -> DataFrame:
    """JN-20: greedy pairs of suppliers of different nations with distant keys, each used once."""
    return pairs.disjoint_pairs(table(spark, d, "supplier"), "s_suppkey", "s_nationkey", "s_suppkey", 3)


def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    """FLT-07: a systematic sample of orders."""
    return table(spark, d, "orders").where("o_orderkey % 97 < 3").select("o_orderkey")


O_SYSTEMATIC = "SELECT o_orderkey FROM orders WHERE o_orderkey % 97 < 3"


def condition_names(spark: SparkSession, d: str) -> DataFrame:
    """SRC-20, SRC-14, FN-23: relation and dose of condition names, and text as booleans."""
    c = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") == 0, "clean").otherwise(F.format_string("rel_%d_%dx", F.col("n_regionkey"), F.col("n_nationkey"))).alias("c"), F.element_at(F.array(F.lit("1"), F.lit(" True "), F.lit("no")), F.col("n_nationkey") % 3 + 1).alias("b"))
    return rounded(c.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), relation_of(F.col("c")).alias("relation"), dose_of(F.col("c")).alias("dose"), as_bool(F.col("b")).alias("flag")))


O_CONDITIONS = "SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_nationkey = 0 THEN 'clean' ELSE 'rel_' || n_regionkey END AS relation, CASE WHEN n_nationkey > 0 THEN n_nationkey::BIGINT END AS dose, n_nationkey % 3 < 2 AS flag FROM nation"


def planned_jobs(spark: SparkSession, d: str) -> DataFrame:
    """OR-02, OR-07: customers (planned) without orders (finished)."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return report.planned_left(c, table(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])


O_PLANNED = "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"


def checksum_audit(spark: SparkSession, d: str) -> DataFrame:
    """QA-01: a manifest of digests against what is there, both ways."""
    n = table(spark, d, "nation")
    have = n.where("n_nationkey % 5 <> 1").select(F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("sha256"))
    want = n.where("n_nationkey % 5 <> 2").select(F.col("n_name").alias("path"), F.sha2(F.when(F.col("n_nationkey") % 5 == 3, "x").otherwise(F.col("n_name")), 256).alias("sha256"))
    return report.checksum_audit(want, have)


O_CHECKSUM = "SELECT n_name AS path, CASE n_nationkey % 5 WHEN 1 THEN 'missing' WHEN 2 THEN 'unlisted' WHEN 3 THEN 'changed' ELSE 'ok' END AS status FROM nation"


def readiness(spark: SparkSession, d: str) -> DataFrame:
    """AG-10, AG-34, AG-38, SNK-09: criteria of a release from one pass of aggregates."""
    e = _effects(spark, d)
    return audit.readiness({"has_decoys": F.bool_or(F.col("relation") == "decoy"), "three_relations": F.count_distinct("relation") >= 4, "seeds": F.count_distinct("seed") >= 3, "all_supported": F.bool_and(F.col("n_affected") >= 10)}, e)


O_READINESS = f"WITH {E_}, r AS (SELECT bool_or(relation = 'decoy') AS has_decoys, count(DISTINCT relation) >= 4 AS three_relations, count(DISTINCT seed) >= 3 AS seeds, bool_and(n_affected >= 10) AS all_supported FROM e) SELECT unnest(['has_decoys', 'three_relations', 'seeds', 'all_supported']) AS criterion, unnest([has_decoys, three_relations, seeds, all_supported]) AS passed FROM r"


_ALL = (
    (did_by_seed, O_DID), (did_label_adjusted, O_LABEL), (pairing_check, O_PAIRING), (three_way, O_THREE), (minus_decoy, O_MINUS), (relation_pivot, O_PIVOT), (relation_unpivot, O_UNPIVOT), (quartile_summary, O_QUARTILES), (task_top, O_TOP), (global_top, O_GLOBAL),
    (relation_dose, O_RELDOSE), (meta_fixed_effect, O_META), (equivalence, O_EQUIVALENCE), (support_buckets, O_SUPPORT), (ols_affected, None), (slope_affected, O_SLOPE), (cluster_bootstrap, O_CLUSTER), (seed_bootstrap, O_SEED), (two_level_bootstrap, None), (global_bootstrap, None), (dispersion, None),
    (auroc, O_AUROC), (auprc, O_AUPRC), (auprc_ordered, O_AP), (threshold95, O_THRESHOLD), (pair_metrics, O_METRICS), (negative_breakdown, O_NEGATIVES), (task_metrics, O_TASK), (confusion_matrix, O_CONFUSION), (class_metrics, O_CLASSES), (hard_negatives_band, O_BAND), (high_similarity_negatives, O_SIMILAR),
    (similar_bands, O_BANDS), (cosine_top1, O_COSINE), (registry_parent_pairs, O_PARENTS), (shared_assays, O_ASSAYS), (adjacent_stereo, O_ADJACENT), (disjoint_negatives, None), (systematic_sample, O_SYSTEMATIC), (condition_names, O_CONDITIONS), (planned_jobs, O_PLANNED), (checksum_audit, O_CHECKSUM), (readiness, O_READINESS),
)
QUERIES = {f.__name__: (f, o) for f, o in _ALL}
