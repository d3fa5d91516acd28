"""Pair banks: hard negatives, gold pairs, and metrics of scores and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from overlapse.functions.scalars import ppv, stable_key, wilson


def blocked_negatives(d: DataFrame, id_: str, block: str, admissible: Column, seed: int = 0, per: int = 1) -> DataFrame:
    """(id, target): for each row the first `per` admissible rows of its block in hash order. `admissible` is over aliases a and b."""
    a, b = d.alias("a"), d.alias("b")
    pairs = a.join(b, (F.col(f"a.{block}") == F.col(f"b.{block}")) & (F.col(f"a.{id_}") != F.col(f"b.{id_}")) & admissible)
    pairs = pairs.select(F.col(f"a.{id_}").alias("query_id"), F.col(f"b.{id_}").alias("target_id"))
    w = Window.partitionBy("query_id").orderBy(stable_key(F.concat_ws("|", "query_id", "target_id"), seed), "target_id")
    return pairs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per).drop("n")


def banded_negatives(d: DataFrame, id_: str, block: str, widths: dict[str, float], admissible: Column, seed: int = 0, per: int = 1) -> DataFrame:
    """blocked_negatives with bands: rows meet only where every column of widths lies within its width.

    Each column is cut into buckets of its width; a row meets its own bucket and those beside it, so rows
    meet by equality of block and buckets and never all pairs of a block. Every pair is hashed inside the join,
    but leaves it only below a bound that about 16 + 8 * per of a row's candidates reach. A row with fewer than
    `per` targets below its bound gets all its pairs in a second join, so the bound decides nothing.
    """
    from itertools import product

    few = 16 + 8 * per
    cut = {c: F.floor(F.col(c) / w).cast("long") for c, w in widths.items()}
    keys = [block, *[f"__{c}" for c in widths]]
    shifts = list(product((-1, 0, 1), repeat=len(widths)))
    beside = lambda at: F.explode(F.array(*[F.struct(*[(F.col(f"{at}{c}") + i).alias(f"__{c}") for c, i in zip(widths, step, strict=True)]) for step in shifts])).alias("__to")
    b = d.withColumns({**{f"__{c}": x for c, x in cut.items()}, "__text": F.col(id_).cast("string")})

    # candidates of each bucket, and the share of hashes that `few` of them reach, as a number and as the digits of a digest
    met = b.groupBy(*keys).agg(F.count("*").alias("__n")).select(block, "__n", beside("__")).groupBy(block, *[F.col(f"__to.__{c}").alias(f"__{c}") for c in widths]).agg(F.sum("__n").alias("__n"))
    sixty = F.least(F.lit(1.0), few / F.col("__n")) * float(1 << 60)
    met = met.select(*keys, (F.floor(sixty) / float(1 << 60)).alias("__bound"), F.when(F.col("__n") <= few, "g").otherwise(F.lower(F.lpad(F.hex(F.floor(sixty)), 15, "0"))).alias("__digits"))
    rows = b.join(met.hint("merge"), keys).withColumnsRenamed({f"__{c}": f"__at_{c}" for c in widths}).withColumn("__head", F.concat(F.lit(f"{seed}:"), F.col("__text"), F.lit("|")))

    def meet(a: DataFrame, *more: Column) -> DataFrame:
        a = a.select("*", beside("__at_")).select("*", "__to.*").drop("__to").alias("a")
        near = [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= w for c, w in widths.items()]
        found = a.join(b.alias("b"), [*[F.col(f"a.{x}") == F.col(f"b.{x}") for x in keys], *near, F.col(f"a.{id_}") != F.col(f"b.{id_}"), admissible, *more])
        found = found.select(F.col(f"a.{id_}").alias("query_id"), "a.__bound", F.col(f"b.{id_}").alias("target_id"))
        return found.withColumn("key", stable_key(F.concat_ws("|", "query_id", "target_id"), seed))

    low = meet(rows, F.sha2(F.concat("a.__head", "b.__text"), 256) < F.col("a.__digits")).select("query_id", "__bound", F.struct("key", "target_id").alias("x"))
    none = rows.select(F.col(id_).alias("query_id"), "__bound", F.lit(None).cast(low.schema["x"].dataType).alias("x"))
    # without null ids, both uses of it below have one plan, so Spark makes its exchange once
    first = low.unionAll(none).where("query_id is not null").groupBy("query_id").agg(F.min("__bound").alias("__bound"), F.collect_list("x").alias("x"))
    # a rounded hash that equals the bound may tie with one beyond it
    sure = F.when(F.col("__bound") < 1, F.filter("x", lambda x: x["key"] < F.col("__bound"))).otherwise(F.col("x"))
    first = first.withColumn("x", F.slice(F.array_sort(sure), 1, per)).withColumn("done", (F.col("__bound") >= 1) | (F.size("x") >= per))
    ready = first.where("done").select("query_id", F.explode("x").alias("x")).select("query_id", "x.target_id")
    left = first.where("not done").select(F.col("query_id").alias(id_))
    w = Window.partitionBy("query_id").orderBy("key", "target_id")
    rest = meet(rows.join(left, id_, "left_semi")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= per)
    return ready.unionAll(rest.select("query_id", "target_id"))


def adjacent_pairs(d: DataFrame, group: str, order: list[str], id_: str, signature: str | None = None) -> DataFrame:
    """(group, a, b): neighbours in each group's order, with different signatures where one is given."""
    w = Window.partitionBy(group).orderBy(*order)
    out = d.where(F.col(group).isNotNull()).withColumn("b", F.lead(id_).over(w))
    if signature:
        out = out.withColumn("s", F.lead(signature).over(w)).where(F.col("s") != F.col(signature))
    return out.where("b is not null").select(group, F.col(id_).alias("a"), "b")


def disjoint_pairs(d: DataFrame, id_: str, formula: str, size: str, gap: int, seed: int = 0, block: int = 1000) -> DataFrame:
    """Greedy pairs of unlike rows, each used once: rows in hash order, each taking the next free one that differs enough.

    Serial by nature, so ranges of the hash of about `block` rows are matched on their own, and what they leave
    is matched in one further pass. Up to `block` rows that is the plain greedy order. Rows left by a block are
    all alike, so they are few unless most rows are alike; they go to one task.
    """
    import pandas as pd

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        # an arriving row goes to the earliest waiting row it differs from; waiting rows are kept by formula
        waiting, out = {}, []
        for i, b in enumerate(rows.sort_values(["key", "id"]).itertuples(index=False)):
            firsts = (next(((j, a, f) for j, a in w.items() if abs(b.size - a.size) >= gap), None) for f, w in waiting.items() if f != b.formula)
            hit = min((x for x in firsts if x is not None), key=lambda x: x[0], default=None)
            if hit is None:
                waiting.setdefault(b.formula, {})[i] = b
                continue
            j, a, f = hit
            del waiting[f][j]
            if not waiting[f]:
                del waiting[f]
            out.append((a.id, b.id, True, a.formula, a.size, a.key))
        out += [(a.id, a.id, False, a.formula, a.size, a.key) for w in waiting.values() for a in w.values()]
        return pd.DataFrame(out, columns=["a", "b", "paired", "formula", "size", "key"])

    x = d.select(F.col(id_).alias("id"), F.col(formula).alias("formula"), F.col(size).alias("size"), stable_key(F.col(id_), seed).alias("key"))
    kind = {c: x.schema[c].dataType.simpleString() for c in x.columns}
    out = f"a {kind['id']}, b {kind['id']}, paired boolean, formula {kind['formula']}, size {kind['size']}, key double"
    blocks = d.agg(F.ceil(F.count("*") / block).alias("blocks"))
    first = x.crossJoin(F.broadcast(blocks)).withColumn("block", F.floor(F.col("key") * F.col("blocks"))).drop("blocks")
    first = first.groupBy("block").applyInPandas(lambda p: greedy(p), out)
    left = first.where("not paired").select(F.col("a").alias("id"), "formula", "size", "key")
    second = left.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda p: greedy(p), out)
    return first.where("paired").select("a", "b").unionAll(second.where("paired").select("a", "b"))


def auroc(d: DataFrame, score: str, y: str) -> DataFrame:
    """One row: area under the ROC curve with average ranks of ties; counts by distinct score come first, so no row is ranked twice."""
    g = d.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(y)).alias("pos"))
    w = Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    rank = F.col("below") + (F.col("n") + 1) / 2.0
    s = g.agg(F.sum(rank * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return s.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0, F.col("p") * (F.col("n") - F.col("p"))).alias("auroc"))


def curve(d: DataFrame, score: str, y: str) -> DataFrame:
    """Per distinct score, as a threshold: true and false positives at or above it, and totals."""
    g = d.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.count("*").alias("n"), F.sum(F.col(y)).alias("pos"))
    w = Window.orderBy(F.desc("threshold"))
    g = g.withColumns({"tp": F.sum("pos").over(w), "fp": F.sum(F.col("n") - F.col("pos")).over(w)})
    t = g.agg(F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return g.crossJoin(F.broadcast(t))  # one row


def auprc(d: DataFrame, score: str, y: str) -> DataFrame:
    """One row: average precision, ties as one step."""
    c = curve(d, score, y)
    return c.agg(F.sum(F.col("pos") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("auprc"))


def average_precision_ordered(d: DataFrame, score: str, y: str, order: str) -> DataFrame:
    """One row: average precision with ties in the order given."""
    w = Window.orderBy(F.desc(score), order)
    r = d.withColumns({"k": F.row_number().over(w), "tp": F.sum(y).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return r.agg(F.try_divide(F.sum(F.when(F.col(y) == 1, F.col("tp") / F.col("k"))), F.sum(y)).alias("auprc_ordered"))


def threshold_at(d: DataFrame, score: str, y: str, recall: float = 0.95) -> DataFrame:
    """One row: of the thresholds that reach the recall, the one of least false-positive rate, then most precision, then greatest."""
    c = curve(d, score, y).select("threshold", (F.col("tp") / F.col("p")).alias("tpr"), (F.col("fp") / F.col("q")).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("prec"))
    c = c.where(F.col("tpr") >= recall)
    best = F.min(F.struct("fpr", (-F.col("prec")).alias("np"), (-F.col("threshold")).alias("nt"), "tpr")).alias("b")
    return c.agg(best).select((-F.col("b.nt")).alias("threshold"), F.col("b.tpr").alias("tpr"), F.col("b.fpr").alias("fpr"), (-F.col("b.np")).alias("precision_at"))


def confusion_counts(d: DataFrame, hit: Column, y: str, *by: str) -> DataFrame:
    """Counts at a threshold, rates, Wilson interval of the false-positive rate and its one-sided bound."""
    pos = F.col(y) == 1
    c = d.groupBy(*by).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    n = F.col("fp") + F.col("tn")
    low, high = wilson(F.col("fp"), n)
    c = c.withColumns({"tpr": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), "fpr": F.try_divide(F.col("fp"), n), "fpr_low": low, "fpr_high": high, "fpr_upper": wilson(F.col("fp"), n, 1.6448536269514722)[1]})
    return c


def with_ppv(c: DataFrame, prevalences: tuple[float, ...] = (0.001, 0.01, 0.05, 0.1)) -> DataFrame:
    """A row for each prevalence."""
    rows = F.array(*[F.struct(F.lit(p).alias("prevalence"), ppv(F.col("tpr"), F.col("fpr"), p).alias("ppv")) for p in prevalences])
    return c.withColumn("x", F.explode(rows)).select(*c.columns, "x.prevalence", "x.ppv")


def confusion_matrix(d: DataFrame, gold: str, said: str, classes: list[str]) -> DataFrame:
    return d.groupBy(gold).pivot(said, classes).agg(F.count(F.lit(1))).fillna(0)


def class_metrics(d: DataFrame, gold: str, said: str) -> DataFrame:
    """Per class: support, precision, recall, F1, and the macro F1 over classes with support, from one matrix of counts."""
    m = d.groupBy(F.col(gold).alias("g"), F.col(said).alias("s")).agg(F.count("*").alias("n"))
    one = m.select(F.explode(F.array("g", "s")).alias("cls"), "g", "s", "n").distinct()
    k = one.groupBy("cls").agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(a) for a, c in (("tp", (F.col("g") == F.col("cls")) & (F.col("s") == F.col("cls"))), ("support", F.col("g") == F.col("cls")), ("said", F.col("s") == F.col("cls")))])
    k = k.withColumns({"precision": F.try_divide("tp", "said"), "recall": F.try_divide("tp", "support"), "f1": F.try_divide(2 * F.col("tp"), F.col("said") + F.col("support"))})
    return k.withColumn("macro_f1", F.avg(F.when(F.col("support") > 0, F.coalesce("f1", F.lit(0.0)))).over(Window.partitionBy(F.lit(1))))


def regression_metrics(d: DataFrame, y: str, p: str, *by: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    return d.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"))
