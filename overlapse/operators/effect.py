"""Downstream effects: paired losses, difference in differences, resampling and summaries."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from overlapse.functions.scalars import stable_key


def paired(clean: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Both losses side by side; `matched` says whether every row found its partner."""
    d = clean.select(*keys, F.col("loss").alias("clean_loss"), "affected", "y", "cluster").join(other.select(*keys, F.col("loss").alias("other_loss")), keys)
    return d.withColumn("delta", F.col("other_loss") - F.col("clean_loss"))


def unmatched(clean: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of either side without a partner; a caller that needs full pairing asserts that there are none."""
    return clean.select(*keys).join(other.select(*keys), keys, "left_anti").union(other.select(*keys).join(clean.select(*keys), keys, "left_anti"))


def did(d: DataFrame, *by: str) -> DataFrame:
    """Per group: counts, mean deltas of the affected and the rest, their difference (positive: affected improved), win rates."""
    a, c = F.col("affected"), ~F.col("affected")
    better = (F.col("delta") < 0).cast("double")
    g = d.groupBy(*by).agg(
        F.count("*").alias("n_test"), F.count_if(a).alias("n_affected"), F.count_if(c).alias("n_control"), F.avg(F.when(a, F.col("delta"))).alias("delta_affected"),
        F.avg(F.when(c, F.col("delta"))).alias("delta_control"), F.avg(F.when(a, better)).alias("win_affected"), F.avg(F.when(c, better)).alias("win_control"),
    )
    return g.withColumn("did", F.col("delta_control") - F.col("delta_affected"))


def did_label_adjusted(d: DataFrame, label: str, *by: str) -> DataFrame:
    """Per group: the labels' differences weighted by their affected rows, their plain mean, and how many have both arms."""
    inner = did(d, *by, label).where("did is not null")
    return inner.groupBy(*by).agg((F.sum(F.col("n_affected") * F.col("did")) / F.sum("n_affected")).alias("did_label_adjusted"), F.avg("did").alias("did_label_equal"), F.count("*").alias("n_labels"))


def minus_decoy(effects: DataFrame, keys: list[str], relation: str = "relation", value: str = "did") -> DataFrame:
    """Effects less the decoy's of the same keys; NULL where there is none. One window, no self-join."""
    decoy = F.max(F.when(F.col(relation) == "decoy", F.col(value))).over(Window.partitionBy(*keys))
    return effects.withColumn("decoy_value", decoy).withColumn("net", F.col(value) - F.col("decoy_value")).where(F.col(relation) != "decoy")


def ols_affected(d: DataFrame, *by: str) -> DataFrame:
    """Per group: the coefficient of affected on the delta, with the standardised clean loss and up to 12 label dummies (else the standardised label).

    Normal equations are summed per group by rows of one Arrow batch at a time: groups may be of any size.
    """
    import numpy as np
    import pandas as pd

    labels = d.groupBy(*by).agg(F.collect_set("y").alias("labels"), F.avg("clean_loss").alias("m"), F.stddev_pop("clean_loss").alias("s"), F.avg(F.col("y")).alias("ym"), F.stddev_pop(F.col("y")).alias("ys"))
    labels = labels.withColumn("labels", F.when(F.size("labels") <= 12, F.array_sort("labels")).otherwise(F.array().cast("array<double>")))
    x = d.select(*by, "affected", "clean_loss", "y", "delta").join(F.broadcast(labels), list(by))  # a row a group
    width = 16

    def part(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in rows:
            out = []
            for key, g in p.groupby(list(by), sort=False):
                first = g.iloc[0]
                cols = [np.ones(len(g)), g["affected"].to_numpy(float), (g["clean_loss"].to_numpy() - first["m"]) / (first["s"] or 1.0)]
                names = list(first["labels"])
                cols += [(g["y"].to_numpy() == v).astype(float) for v in names[1:]] if names else [(g["y"].to_numpy() - first["ym"]) / (first["ys"] or 1.0)]
                a = np.zeros((len(g), width))
                a[:, : len(cols)] = np.stack(cols, 1)
                out.append((*key, (a.T @ a).ravel().tolist(), (a.T @ g["delta"].to_numpy()).tolist(), len(cols)))
            yield pd.DataFrame(out, columns=[*by, "xx", "xy", "width"])

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        k = int(g["width"].iloc[0])
        xx = np.sum([np.asarray(v).reshape(width, width) for v in g["xx"]], 0)[:k, :k]
        beta = np.linalg.lstsq(xx, np.sum([np.asarray(v) for v in g["xy"]], 0)[:k], rcond=None)[0]
        return g[list(by)].head(1).assign(affected_coef=beta[1])

    kinds = ", ".join(f"{b} {d.schema[b].dataType.simpleString()}" for b in by)
    sums = x.mapInPandas(part, f"{kinds}, xx array<double>, xy array<double>, width int")
    return sums.groupBy(*by).applyInPandas(solve, f"{kinds}, affected_coef double")


def slope_affected(d: DataFrame, *by: str) -> DataFrame:
    """The one-covariate form."""
    return d.groupBy(*by).agg(F.regr_slope("delta", F.col("affected").cast("double")).alias("affected_coef"))


def seed_summary(d: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, spread, quartiles, extremes, positive count, standard error and half-width over rows (seeds)."""
    v = F.col(value)
    q = lambda p: F.percentile(v, F.lit(p))
    g = d.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"), F.min(v).alias("least"), F.max(v).alias("most"), F.count_if(v > 0).alias("n_positive"))
    return g.withColumn("sem", F.col("sd") / F.sqrt("n")).withColumn("half_width", 1.96 * F.col("sem"))


def draw_summary(draws: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, 2.5 and 97.5 percent points, and the share of draws above zero."""
    v = F.col(value)
    return draws.groupBy(*by).agg(F.count(v).alias("draws"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.025)).alias("low"), F.percentile(v, F.lit(0.975)).alias("high"), F.avg((v > 0).cast("double")).alias("p_positive"))


#: Clusters that one task of a bootstrap holds; of more, each block of so many is summed on its own.
BLOCK = 1 << 20


def cluster_bootstrap(d: DataFrame, cluster: str, value: str, draws: int, seed: int = 0) -> DataFrame:
    """(draw, value): the mean over clusters drawn with replacement, from sums and counts of each cluster.

    Rows are reduced to one a cluster first. A hash of (seed, draw, number of the eight) holds eight picks of a
    draw, 32 bits each, scaled to the number of clusters. The sums lie as arrays by rank, which every task gets
    (16 bytes a cluster), and draws are dealt over tasks; picks are looked up there and never become rows.
    Without clusters there are no draws.
    """
    import hashlib

    import numpy as np
    import pyarrow as pa

    g = d.groupBy(cluster).agg(F.sum(value).cast("double").alias("s"), F.count(value).alias("n"))
    g = g.withColumn("rank", F.row_number().over(Window.orderBy(F.col(cluster).asc_nulls_last())) - 1).select("rank", F.coalesce("s", F.lit(0.0)).alias("s"), "n")
    blocks = g.groupBy(F.floor(F.col("rank") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("rank", "s", "n"))).alias("x"))
    blocks = blocks.select((F.col("block") * BLOCK).alias("low"), F.col("x.s").alias("s"), F.col("x.n").alias("n")).crossJoin(F.broadcast(g.agg(F.count("*").alias("k"))))
    tasks = max(1, min(draws, 4 * d.sparkSession.sparkContext.defaultParallelism))
    dealt = d.sparkSession.range(0, tasks, 1, tasks).select(F.col("id").alias("first")).crossJoin(F.broadcast(blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for batch in batches:
            for row in range(batch.num_rows):
                first, low, k = (batch.column(c)[row].as_py() for c in ("first", "low", "k"))
                s, n = (batch.column(c)[row].values.to_numpy() for c in ("s", "n"))
                eights = [b"|%d" % e for e in range(-(-k // 8))]
                mine, sums, counts = range(first, draws, tasks), [], []
                for draw in mine:
                    head = f"{seed}:{draw}".encode()
                    digests = np.frombuffer(b"".join([sha(head + e).digest() for e in eights]), ">u4")[:k]
                    pick = (digests.astype(np.uint64) * np.uint64(k) >> np.uint64(32)).astype(np.int64) - low
                    if k > len(s):
                        pick = pick[(pick >= 0) & (pick < len(s))]
                    sums.append(s[pick].sum())
                    counts.append(n[pick].sum())
                yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int64()), pa.array(sums, pa.float64()), pa.array(counts, pa.int64())], ["draw", "s", "n"])

    return dealt.mapInArrow(run, "draw long, s double, n long").groupBy("draw").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("value"))


def seed_bootstrap(d: DataFrame, seed_col: str, value: str, draws: int, seed: int = 0) -> DataFrame:
    """(draw, value): means of seeds drawn with replacement."""
    return cluster_bootstrap(d.groupBy(seed_col).agg(F.avg(value).alias(value)), seed_col, value, draws, seed)


def two_level_bootstrap(d: DataFrame, draws: int, seed: int = 0, *by: str) -> DataFrame:
    """(by, draw, value): seeds with replacement, clusters with replacement within each, label-adjusted difference.

    Each cell is reduced to sums by (seed, cluster, label, arm) before it goes to one task.
    """
    import numpy as np
    import pandas as pd

    g = d.groupBy(*by, "seed", "cluster", "y", "affected").agg(F.sum("delta").alias("s"), F.count("*").alias("n"))
    kinds = ", ".join(f"{b} {d.schema[b].dataType.simpleString()}" for b in by)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        r = np.random.default_rng(seed)
        labels = {v: i for i, v in enumerate(sorted(p["y"].unique()))}
        cubes = []
        for _, one in p.groupby("seed"):
            ids = {v: i for i, v in enumerate(sorted(one["cluster"].unique()))}
            cube = np.zeros((len(ids), len(labels), 2, 2))
            np.add.at(cube, (one["cluster"].map(ids), one["y"].map(labels), one["affected"].astype(int)), one[["s", "n"]].to_numpy(float))
            cubes.append(cube)
        out = np.empty(draws)
        for i in range(draws):
            total = []
            for s in r.integers(0, len(cubes), len(cubes)):
                c = cubes[s]
                m = np.tensordot(r.multinomial(len(c), np.full(len(c), 1 / len(c))), c, 1)
                both = (m[:, 0, 1] > 0) & (m[:, 1, 1] > 0)
                if both.any():
                    m = m[both]
                    diff = m[:, 0, 0] / m[:, 0, 1] - m[:, 1, 0] / m[:, 1, 1]
                    total.append((diff * m[:, 1, 1]).sum() / m[:, 1, 1].sum())
            out[i] = np.mean(total) if total else np.nan
        frame = pd.DataFrame({"draw": np.arange(draws), "value": out})
        for b in by:
            frame[b] = p[b].iloc[0]
        return frame[[*by, "draw", "value"]]

    return g.groupBy(*by).applyInPandas(run, f"{kinds}, draw long, value double")


def global_bootstrap(draws: DataFrame, task: str, seed: int = 0) -> DataFrame:
    """(draw, value): cells' draws joined draw by draw, tasks drawn with replacement in each."""
    m = draws.groupBy("draw", task).agg(F.avg("value").alias("v"))
    w = Window.partitionBy("draw").orderBy(task)
    m = m.withColumns({"rank": F.row_number().over(w) - 1, "k": F.count("*").over(Window.partitionBy("draw"))})
    picks = m.select("draw", "k", (F.col("rank") + 1).alias("j")).withColumn("rank", F.floor(stable_key(F.concat_ws("|", "draw", "j"), seed) * F.col("k")).cast("int"))
    return picks.select("draw", "rank").join(m.select("draw", "rank", "v"), ["draw", "rank"]).groupBy("draw").agg(F.avg("v").alias("value"))


def dispersion(cells: DataFrame, draws: DataFrame, cell: str) -> DataFrame:
    """One row: the variance of cell effects and the share of centred draws that reach it."""
    seen = cells.agg(F.var_samp("value").alias("observed"))
    means = draws.groupBy(cell).agg(F.avg("value").alias("m"))
    null = draws.join(means, cell).groupBy("draw").agg(F.var_samp(F.col("value") - F.col("m")).alias("v"))
    return null.crossJoin(F.broadcast(seen)).agg(F.first("observed").alias("observed"), F.avg((F.col("v") >= F.col("observed")).cast("double")).alias("p_value"))


def fixed_effect(d: DataFrame, value: str, se: str, *by: str) -> DataFrame:
    """Inverse-variance mean, its error and interval, Cochran's Q and I², in one pass."""
    w = 1 / (F.col(se) * F.col(se))
    ok = d.where((F.col(se) > 0) & F.col(value).isNotNull())
    g = ok.groupBy(*by).agg(F.count("*").alias("k"), F.sum(w).alias("sw"), F.sum(w * F.col(value)).alias("swx"), F.sum(w * F.col(value) * F.col(value)).alias("swxx"))
    q = F.greatest(F.lit(0.0), F.col("swxx") - F.col("swx") * F.col("swx") / F.col("sw"))
    g = g.withColumns({"mean": F.col("swx") / F.col("sw"), "se": 1 / F.sqrt("sw"), "q": q})
    return g.withColumns({"low": F.col("mean") - 1.96 * F.col("se"), "high": F.col("mean") + 1.96 * F.col("se"), "i2": F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("q") - (F.col("k") - 1), F.col("q")), F.lit(0.0)))}).drop("sw", "swx", "swxx")


def equivalence(low: Column, high: Column, margin: float) -> Column:
    return F.when((low > -margin) & (high < margin), "equivalent").when(low > margin, "above").when(high < -margin, "below").otherwise("undecided")
