"""Splits, selections and samples that a hash key decides, whatever the order or partitioning of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from overlapse.functions.scalars import stable_key


def group_split(df: DataFrame, group: str, seed: int = 0, train: float = 0.8, valid: float = 0.9) -> DataFrame:
    """df with `split`: whole groups in hash order, by where the middle of their running count falls.

    Only a row a group is ordered globally. An empty val or test part is then filled with whole groups
    from the end, as long as more than one group is left for the part before.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    w = Window.orderBy("key", group)
    g = sizes.withColumn("key", stable_key(F.col(group), seed)).withColumn("before", F.sum("n").over(w) - F.col("n") / 2.0)
    g = g.crossJoin(F.broadcast(total))  # one row
    cut = lambda share: F.floor(F.col("total") * share)
    g = g.withColumn("split", F.when(F.col("before") < cut(train), "train").when(F.col("before") < cut(valid), "val").otherwise("test"))
    have = F.collect_set("split").over(Window.partitionBy(F.lit(1)))
    last = F.row_number().over(Window.orderBy(F.desc("key"), F.desc(group)))
    count = F.count("*").over(Window.partitionBy(F.lit(1)))
    g = g.withColumns({"have": have, "last": last, "count": count})
    fixed = (
        F.when((F.col("last") == 1) & ~F.array_contains("have", "test") & (F.col("count") > 1), "test")
        .when((F.col("last") == 2) & ~F.array_contains("have", "val") & (F.col("count") > 2), "val")
        .otherwise(F.col("split"))
    )
    return df.join(g.select(F.col(group).alias("__g"), fixed.alias("split")), F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def stratified_top(df: DataFrame, label: str, id_: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in hash order with labels in equal parts; labels that run out are made up for from the rest."""
    key = stable_key(F.col(id_), seed)
    labels = df.select(label).distinct().agg(F.count("*").alias("labels"))
    d = df.withColumn("__key", key).withColumn("__rank", F.row_number().over(Window.partitionBy(label).orderBy("__key", id_)))
    d = d.crossJoin(F.broadcast(labels)).withColumn("__fill", (F.col("__rank") > F.floor(F.lit(n) / F.col("labels"))).cast("int"))
    return d.orderBy("__fill", "__key", id_).limit(n).drop("__key", "__rank", "__fill", "labels")


def stratified_share(df: DataFrame, label: str, id_: str, share: float, seed: int = 0) -> DataFrame:
    """For each label max(1, round half even(share * count)) rows in hash order."""
    w = Window.partitionBy(label)
    d = df.withColumn("__key", stable_key(F.col(id_), seed)).withColumn("__n", F.count("*").over(w))
    d = d.withColumn("__rank", F.row_number().over(w.orderBy("__key", id_)))
    return d.where(F.col("__rank") <= F.greatest(F.lit(1), F.bround(F.col("__n") * share))).drop("__key", "__n", "__rank")


def hash_sample(df: DataFrame, id_: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in hash order."""
    return df.orderBy(stable_key(F.col(id_), seed), id_).limit(n)


def with_replacement(df: DataFrame, id_: str, n: int, seed: int = 0) -> DataFrame:
    """n draws with replacement: draw i takes the row whose rank is a hash of i."""
    spark = df.sparkSession
    total = df.agg(F.count("*").alias("total"))
    base = df.withColumn("__rank", F.row_number().over(Window.orderBy(id_)) - 1)
    draws = spark.range(n).select(F.col("id").alias("draw")).crossJoin(F.broadcast(total))
    draws = draws.select("draw", F.floor(stable_key(F.col("draw"), seed) * F.col("total")).cast("int").alias("__pick"))
    return draws.join(base, F.col("__pick") == F.col("__rank")).drop("__pick", "__rank")


def first_occurrence(df: DataFrame, value: str, order: str) -> DataFrame:
    """The first row of each value."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(value).orderBy(order))).where("__n = 1").drop("__n")


def shuffled(df: DataFrame, id_: str, seed: int = 0) -> DataFrame:
    return df.orderBy(stable_key(F.col(id_), seed), id_)


def prefix_pools(parts: list[tuple[str, DataFrame, int]], order: str) -> DataFrame:
    """The first n rows of each source in its own order, with the source's name."""
    out = None
    for name, df, n in parts:
        d = df.orderBy(order).limit(n).withColumn("pool", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def within_length(df: DataFrame, text: str, most: int, need: int) -> DataFrame:
    """Rows no longer than `most`, or all rows where fewer than `need` are."""
    fit = F.length(text) <= most
    enough = df.agg((F.count(F.when(fit, 1)) >= need).alias("__enough"))
    return df.crossJoin(F.broadcast(enough)).where(~F.col("__enough") | fit).drop("__enough")


def excluding(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return df.join(others.select(key).distinct(), key, "left_anti")
