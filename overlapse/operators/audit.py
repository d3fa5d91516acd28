"""Retrieval audits: background, injection, decoys, claims, methods and scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-12


def share(c: Column) -> Column:
    return F.avg(c.cast("double"))


def background(hits: DataFrame, *by: str) -> DataFrame:
    """Per group of (…, n): queries, hit rate, mean and greatest number of matches."""
    return hits.groupBy(*by).agg(F.count("*").alias("n_queries"), share(F.col("n") > 0).alias("hit_rate"), F.avg("n").alias("mean_matches"), F.max("n").alias("max_matches"))


def injection(hits: DataFrame, *by: str) -> DataFrame:
    """Per group of (…, clean_hit, hit, changed): recall, what injection added, recall after it, recall of changed queries."""
    clean, hit, changed = F.col("clean_hit"), F.col("hit"), F.col("changed")
    return hits.groupBy(*by).agg(
        F.count("*").alias("n_queries"), share(hit).alias("injection_recall"), share(hit & ~clean).alias("incremental_recall"), share(hit | clean).alias("post_hit_rate"),
        F.count_if(changed).alias("changed_queries"), F.avg(F.when(changed, hit.cast("double"))).alias("changed_only_recall"),
    )


def decoy_adjusted(cells: DataFrame, keys: list[str], relation: str = "relation", decoy: str = "decoy") -> DataFrame:
    """Cells of the other relations with the decoy cell's recall as false-positive proxy (0 where missing), and net recalls. One window, so cells are computed once."""
    proxy = F.max(F.when(F.col(relation) == decoy, F.col("injection_recall"))).over(Window.partitionBy(*keys))
    d = cells.withColumn("decoy_fp", F.coalesce(proxy, F.lit(0.0))).where(F.col(relation) != decoy)
    return d.withColumn("net_recall", F.col("injection_recall") - F.col("decoy_fp")).withColumn("net_changed_recall", F.col("changed_only_recall") - F.col("decoy_fp"))


def claim_matrix(cells: DataFrame, keys: list[str], family: str = "family", detector: str = "detector", order: str = "rank") -> DataFrame:
    """Per cell: the best detector of each family by net changed recall (net recall where that is undefined), and gains of the lattice."""
    score = F.coalesce("net_changed_recall", "net_recall")
    best = lambda f: F.max_by(F.when(F.col(family) == f, F.col(detector)), F.when(F.col(family) == f, F.struct(score, -F.col(order))))
    top = lambda f: F.max(F.when(F.col(family) == f, score))
    d = cells.groupBy(*keys).agg(*[x for f in ("lattice", "exact", "similarity") for x in (best(f).alias(f"best_{f}"), top(f).alias(f"{f}_score"))])
    return d.withColumn("gain_exact", F.col("lattice_score") - F.col("exact_score")).withColumn("gain_similarity", F.col("lattice_score") - F.col("similarity_score"))


def method_summary(cells: DataFrame, method: str, seed: str, metrics: list[str]) -> DataFrame:
    """Means within a repeat, then mean and standard deviation over repeats."""
    inner = cells.groupBy(method, seed).agg(*[F.avg(m).alias(m) for m in metrics])
    return inner.groupBy(method).agg(F.count("*").alias("n_repeats"), *[x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd"))])


def win_tie_loss(cells: DataFrame, keys: list[str], method: str, ours: str, score: str, *by: str) -> DataFrame:
    """Per group: rates of cells where our score beats, ties or trails the best other method; undefined cells count in the total."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), method)
    other = cells.where(F.col(method) != ours).withColumn("n", F.row_number().over(w)).where("n = 1").select(*keys, F.col(method).alias("best_other"), F.col(score).alias("other"))
    d = cells.where(F.col(method) == ours).join(other, keys).withColumn("gain", F.col(score) - F.col("other"))
    rate = lambda c: F.avg(F.coalesce(c.cast("int"), F.lit(0)).cast("double"))
    return d.groupBy(*by).agg(F.count("*").alias("cells"), F.avg("gain").alias("mean_gain"), rate(F.col("gain") > TOLERANCE).alias("win_rate"), rate(F.abs("gain") <= TOLERANCE).alias("tie_rate"), rate(F.col("gain") < -TOLERANCE).alias("loss_rate"))


def scenarios(d: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """A row for each scenario that a row belongs to."""
    return d.withColumn("scenario", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))))


def exposure(queries: DataFrame, keys: DataFrame, order: tuple[str, ...], ids: list[str]) -> DataFrame:
    """(ids, exposure) of queries (ids, detector, key): the first relation whose key the corpus' (detector, key) rows hold, else none.

    The corpus is read once for all relations; only keys that are asked for go on.
    """
    seen = keys.join(queries.select("detector", "key").distinct(), ["detector", "key"], "left_semi").distinct()
    d = queries.join(seen.withColumn("seen", F.lit(True)).select("detector", "key", "seen"), ["detector", "key"], "left")
    place = F.array_position(F.array(*map(F.lit, order)), F.col("detector"))
    d = d.groupBy(*ids).agg(F.min(F.when(F.col("seen"), place)).alias("first"))
    return d.select(*ids, F.coalesce(F.try_element_at(F.array(*map(F.lit, order)), F.col("first").cast("int")), F.lit("none")).alias("exposure"))


def shares_by_label(d: DataFrame, by: str, label: str, labels: list[str]) -> DataFrame:
    """Counts and shares of each label per group, 0 where a label has none."""
    n = lambda x: F.count_if(F.col(label) == x)
    return d.groupBy(by).agg(F.count("*").alias("n"), *[y for x in labels for y in (n(x).alias(f"n_{x}"), (n(x) / F.count("*")).alias(f"share_{x}"))])


def abstention(keys: DataFrame, routes: list[str]) -> DataFrame:
    """(route, n, n_abstained, rate)."""
    long = keys.select(*[F.col(r).isNull().alias(r) for r in routes]).unpivot([], routes, "route", "abstained")
    return long.groupBy("route").agg(F.count("*").alias("n"), F.count_if("abstained").alias("n_abstained"), share(F.col("abstained")).alias("rate"))


def readiness(checks: dict[str, Column], d: DataFrame) -> DataFrame:
    """One row a check, from one pass of aggregates."""
    one = d.agg(*[c.alias(n) for n, c in checks.items()])
    return one.unpivot([], list(checks), "criterion", "passed")
