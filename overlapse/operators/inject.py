"""Controlled injection: length-matched background rows give way to typed variants of the queries."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from overlapse.functions.scalars import stable_key

RELATIONS = ("exact", "parent", "stereo", "tautomer")
DOSES = (1, 5, 20)


def variants(queries: DataFrame, id_: str, text: str, relations: tuple[str, ...] = RELATIONS) -> DataFrame:
    """(sample_id, relation, variant): exact copy, a fragment added, decoration changed, words in reverse."""
    t = F.col(text)
    made = {
        "exact": t,
        "parent": F.concat(t, F.lit("\nion")),
        "stereo": F.concat(F.upper(F.substring(t, 1, 1)), F.regexp_replace(F.substring(t, F.lit(2), F.length(t)), "[.,]", ""), F.lit("!")),
        "tautomer": F.array_join(F.reverse(F.split(t, " ")), " "),
    }
    d = queries.select(F.col(id_).alias("sample_id"), *[made[r].alias(r) for r in relations])
    return d.unpivot("sample_id", list(relations), "relation", "variant")


def decoys(queries: DataFrame, pool: DataFrame, id_: str, text: str, seed: int = 0) -> DataFrame:
    """(sample_id, decoy): of the pool's rows of the nearest length (the shorter on equal distance), one by hash, with replacement."""
    lengths = pool.select(F.length(text).alias("at"), F.lit(True).alias("there")).distinct()
    wanted = queries.select(F.length(text).alias("at"), F.lit(False).alias("there")).distinct()
    # one row a length, both ways to the next that is there; lengths are integers up to the longest text
    w = Window.orderBy("at")
    have = F.when(F.col("there"), F.col("at"))
    low, high = F.last(have, True).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.first(have, True).over(w.rangeBetween(0, Window.unboundedFollowing))
    near = lengths.union(wanted).select("at", "there", low.alias("low"), high.alias("high")).where("not there")
    near = near.select(F.col("at").alias("want"), F.when((F.col("at") - F.col("low") <= F.col("high") - F.col("at")) | F.col("high").isNull(), F.col("low")).otherwise(F.col("high")).alias("len"))
    ranked = pool.select(F.col(text).alias("decoy"), F.length(text).alias("len"), id_).join(near.select("len").distinct(), "len", "left_semi")
    w = Window.partitionBy("len")
    ranked = ranked.withColumn("n", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(id_)) - 1)
    sizes = ranked.groupBy("len").agg(F.max("n").alias("n"))
    pick = queries.select(F.col(id_).alias("sample_id"), F.length(text).alias("want")).join(near, "want").join(sizes, "len")
    pick = pick.withColumn("place", F.floor(stable_key(F.col("sample_id"), seed) * F.col("n")).cast("int"))
    return pick.join(ranked.select("len", "place", "decoy"), ["len", "place"]).select("sample_id", "decoy")


def allocate(requests: list[int], buckets: dict[int, int]) -> list[int]:
    """The length taken for each request in turn: the nearest with rows left, the shorter on equal distance."""
    left = Counter(buckets)
    free = sorted(x for x, n in left.items() if n > 0)  # lengths with rows left
    out = []
    for want in requests:
        if not free:
            raise ValueError("the background has no rows left")
        at = bisect_left(free, want)
        hit = min(free[max(0, at - 1) : at + 1], key=lambda x: (abs(x - want), x))
        left[hit] -= 1
        if not left[hit]:
            free.remove(hit)
        out.append(hit)
    return out


def replace_background(background: DataFrame, injected: DataFrame, seed: int = 0) -> DataFrame:
    """The manifest of replacing rows of background(idx, text) by injected(request, sample_id, relation, dose, rep, text).

    Every relation and dose has a corpus of its own. Which length each of its requests takes depends only on
    lengths and counts, so that greedy pass runs over integers, one task a corpus; which row of a length is
    taken goes by hash rank, in a join. The numbers of rows by length, a row for each length there is, go to all tasks.
    """
    counts = {r["len"]: r["n"] for r in background.groupBy(F.length("text").alias("len")).agg(F.count("*").alias("n")).collect()}

    def plan(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("request", ignore_index=True)
        p["len"] = allocate(list(p["want"]), counts)
        p["rank"] = p.groupby("len").cumcount() + 1
        return p[["relation", "dose", "request", "len", "rank"]]

    kind = ", ".join(f"{c} {injected.schema[c].dataType.simpleString()}" for c in ("relation", "dose", "request"))
    taken = injected.select("relation", "dose", "request", F.length("text").alias("want")).groupBy("relation", "dose").applyInPandas(plan, f"{kind}, len int, rank int")
    b = background.select("idx", F.col("text").alias("old"), F.length("text").alias("len"))
    b = b.withColumn("rank", F.row_number().over(Window.partitionBy("len").orderBy(stable_key(F.col("idx"), seed), "idx")))
    m = taken.join(b, ["len", "rank"]).join(injected, ["relation", "dose", "request"])
    return m.select(
        "sample_id", "relation", "dose", "rep", F.col("idx").alias("background_index"), F.sha2("old", 256).alias("background_sha256"), F.col("len").alias("background_len"),
        F.sha2("text", 256).alias("injected_sha256"), F.col("text").alias("injected_text"), F.length("text").alias("injected_len"), (F.length("text") - F.col("len")).alias("length_delta"),
    )


def contaminated(background: DataFrame, manifest: DataFrame) -> DataFrame:
    """background with the rows of one relation's and dose's manifest in place."""
    m = manifest.select(F.col("background_index").alias("idx"), "injected_text")
    return background.join(m, "idx", "left").select("idx", F.coalesce("injected_text", "text").alias("text"))
