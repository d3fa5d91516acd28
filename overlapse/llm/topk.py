"""Exact top-k search by inner product, with bounds from segment means and deviations.

Components become whole numbers, floor(scale * x). A vector is cut into equal segments at several
resolutions; for a segment of length L with means m, n and deviations s, t (population) the part of the
inner product is at most L * (m n + s t), which is the lower bound L * ((m - n)^2 + (s - t)^2) of the
squared distance, put as a product.

Coarse to fine: rows of a length that many rows have are put into groups by their segment statistics, and a
box of means and deviations bounds a whole group. Every query first meets one block of its most promising
group, which gives a first k-th score; groups whose box cannot reach it are never sent to it. Blocks of
queries meet blocks of the groups that are left in a grid, so a task holds one block of each whatever the
table's size. Within a block the bounds of single rows go from one segment to many, for each query on its
own, and only what still may reach the k-th score gets an exact product. Where the vectors have no such
structure, every row is met and nothing is left out either way.

Defined cases: vectors that are null, or hold null or non-finite components (also those that only scaling
makes infinite), take no part; neither do rows without id; only vectors of equal length are compared; scores beyond 64 bits are held at the ends of long;
a row repeated is a candidate each time, and rows with the query's id are its own; a query repeated is
answered once, for its least vector where these differ; ties go to the smaller id; an empty vector scores 0
with other empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from overlapse.llm.common import written

LEVELS = (1, 4, 16, 32)
#: Segments of the statistics that groups are made of.
SEGMENTS = 16
QUERIES = 2048
ROWS = 16384
#: At most so many groups for a length, and so many lengths with groups: what goes to the driver is bounded by both.
GROUPS, LENGTHS = 256, 16


def _bounds(x: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, sqrt(L) times the means and the deviations of its segments, side by side."""
    edges = np.linspace(0, x.shape[1], min(level, x.shape[1]) + 1).astype(int)
    means, devs = [], []
    for a, b in zip(edges, edges[1:]):
        part = x[:, a:b]
        w = np.sqrt(b - a)
        means.append(part.mean(1) * w)
        devs.append(part.std(1) * w)
    return np.stack(means, 1), np.stack(devs, 1)


def _whole(q: np.ndarray, c: np.ndarray) -> bool:
    """Whether floats carry all these products exactly, as whole numbers below 2**53."""
    return float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1]) < 2**53


def _long(n: int) -> int:
    return min(max(n, -(2**63)), 2**63 - 1)


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All inner products, exactly."""
    if _whole(q, c):
        return (q @ c.T).astype(np.int64)
    big = np.array([[int(v) for v in r] for r in q], object).reshape(q.shape) @ np.array([[int(v) for v in r] for r in c], object).reshape(c.shape).T
    return np.array([[_long(int(v)) for v in r] for r in big], np.int64).reshape(big.shape)


def _exact_pairs(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The inner products of rows i of q with rows j of c, exactly."""
    if _whole(q, c):
        return np.concatenate([np.empty(0, np.int64), *[np.einsum("ij,ij->i", q[i[a : a + 65536]], c[j[a : a + 65536]]).astype(np.int64) for a in range(0, len(i), 65536)]])
    return np.array([_long(sum(int(a) * int(b) for a, b in zip(q[x], c[y], strict=True))) for x, y in zip(i, j, strict=True)], np.int64)


def block_top(qi: np.ndarray, q: np.ndarray, ci: np.ndarray, c: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """(query, candidate, score) of the k best candidates of each query within the block, and how many exact products that took.

    floors are scores that k other candidates of a query are known to reach.
    """
    seen: list[tuple[int, int, int]] = []
    products = 0
    levels = [(_bounds(q, s), _bounds(c, s)) for s in (LEVELS if q.shape[1] else ()) if s == 1 or s < q.shape[1]]
    # room for rounding: a bound must never fall below the product
    with np.errstate(over="ignore", invalid="ignore"):
        room = 1e-9 * np.sqrt((q * q).sum(1))[:, None], np.sqrt((c * c).sum(1))[None]

    def upper(l: int, i: np.ndarray, j: np.ndarray | slice) -> np.ndarray:
        (qm, qs), (cm, cs) = levels[l]
        with np.errstate(over="ignore", invalid="ignore"):
            return qm[i] @ cm[j].T + qs[i] @ cs[j].T + room[0][i] * room[1][:, j] + 1e-6

    first = min(len(ci), 4 * (k + 1))
    for lo in range(0, len(qi), 128):
        some = np.arange(lo, min(lo + 128, len(qi)))
        floor = np.full(len(some), -np.inf) if floors is None else floors[some].astype(float)
        if levels and len(ci) > 4 * first:
            # the k-th best of a few promising candidates is a lower limit of the k-th best of all
            top = np.argpartition(-np.nan_to_num(upper(-1, some, slice(None)), nan=np.inf), first, 1)[:, :first]
            products += top.size
            for n, i in enumerate(some):
                s = _exact(q[i : i + 1], c[top[n]])[0][ci[top[n]] != qi[i]]
                if len(s) >= k:
                    floor[n] = max(floor[n], np.sort(s)[-k])
        left = np.ones((len(some), len(ci)), bool)
        rows = np.arange(len(ci))
        for l in range(len(levels)):
            if not len(rows):
                break
            left[:, rows] &= ~(upper(l, some, rows) < floor[:, None])
            rows = np.flatnonzero(left.any(0))
        if not len(rows):
            continue
        i, j = np.nonzero(left[:, rows])
        if 4 * len(i) < len(some) * len(rows):
            score = _exact_pairs(q, c, some[i], rows[j])
            products += len(i)
        else:
            score = _exact(q[some], c[rows])[i, j]
            products += len(some) * len(rows)
        other = ci[rows[j]] != qi[some[i]]
        i, ids, score = i[other], ci[rows[j[other]]], score[other]
        starts = np.searchsorted(i, np.arange(len(some) + 1))
        for n in range(len(some)):
            s, d = score[starts[n] : starts[n + 1]], ids[starts[n] : starts[n + 1]]
            if len(s) > k:
                least = np.partition(s, len(s) - k)[-k]
                s, d = s[s >= least], d[s >= least]
            best = np.lexsort((d, -s))[:k]
            seen += [(int(qi[some[n]]), int(d[b]), int(s[b])) for b in best]
    return seen, products


class Boxes:
    """Bounds of the groups of one length: least and greatest segment means, greatest deviations and norms."""

    def __init__(self, low: np.ndarray, high: np.ndarray, dev: np.ndarray, norm: np.ndarray):
        self.low, self.high, self.dev, self.norm = low, high, dev, norm

    def upper(self, q: np.ndarray) -> np.ndarray:
        """(queries, groups): no row of the group scores more."""
        m, s = _bounds(q, SEGMENTS)
        with np.errstate(over="ignore", invalid="ignore"):
            u = np.maximum(m, 0) @ self.high.T + np.minimum(m, 0) @ self.low.T + s @ self.dev.T
            return u + 1e-9 * np.sqrt((q * q).sum(1))[:, None] * self.norm[None] + 1e-6


def _rows(t: pa.Table | pa.RecordBatch, v: str, scale: float) -> np.ndarray:
    """The vectors of a column, all of one length, as whole numbers."""
    if not t.num_rows:
        return np.empty((0, 0))
    column = t.column(v)
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        return np.floor(flat.astype(np.float64) * scale).reshape(t.num_rows, -1)


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = b.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), b.filter(pa.array(dims == dim)) if (dims != dim).any() else b


def _features(x: np.ndarray) -> np.ndarray:
    return np.nan_to_num(np.concatenate(_bounds(x, SEGMENTS), 1))


def grouped(d: DataFrame, large: dict[int, int], scale: float) -> DataFrame:
    """d with g, the nearest by segment statistics of a few rows of its length; 0 for lengths with one group."""
    least = Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id", "v")
    seeds = d.where(F.col("dim").isin(list(large))).withColumn("n", F.row_number().over(least)).where(F.col("n") <= GROUPS)
    found: dict[int, list] = {}
    for r in seeds.orderBy("dim", "n").collect() if large else ():
        found.setdefault(r["dim"], []).append(np.floor(np.asarray(r["v"], np.float64) * scale))
    centres = {dim: _features(np.stack(v[: large[dim]])) for dim, v in found.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part in _by_length(b):
                g = np.zeros(part.num_rows, np.int32)
                if dim in centres:
                    f, at = _features(_rows(part, "v", scale)), centres[dim]
                    with np.errstate(over="ignore", invalid="ignore"):
                        g = np.nan_to_num(f @ at.T - (at * at).sum(1) / 2, nan=-np.inf).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(g)], names=["id", "dim", "v", "g"])

    return d.mapInArrow(run, f"id long, dim int, v {d.schema['v'].dataType.simpleString()}, g int")


def boxes(d: DataFrame, large: dict[int, int], scale: float) -> dict[int, Boxes]:
    """The bounds of all groups: at most GROUPS for each of at most LENGTHS lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for dim, part in _by_length(b):
                x, g = _rows(part, "v", scale), part.column("g").to_numpy()
                m, s = _bounds(x, SEGMENTS)
                with np.errstate(over="ignore"):
                    norm = np.sqrt((x * x).sum(1))
                out += [(dim, int(k), i, lo, hi, dev, norm[g == k].max()) for k in np.unique(g) for i, (lo, hi, dev) in enumerate(zip(m[g == k].min(0), m[g == k].max(0), s[g == k].max(0), strict=True))]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32()] * 3 + [pa.float64()] * 4, strict=True)], names=["dim", "g", "i", "low", "high", "dev", "norm"])

    part = d.where(F.col("dim").isin(list(large))).mapInArrow(run, "dim int, g int, i int, low double, high double, dev double, norm double")
    rows = part.groupBy("dim", "g", "i").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("dev").alias("dev"), F.max("norm").alias("norm")).collect() if large else []
    out = {}
    for dim in large:
        cube = np.zeros((4, large[dim], min(SEGMENTS, dim)))
        cube[0], cube[1] = np.inf, -np.inf
        for r in rows:
            if r["dim"] == dim:
                cube[:, r["g"], r["i"]] = r["low"], r["high"], r["dev"], r["norm"]
        empty = np.isinf(cube[0]).any(1)
        cube[:2, empty] = 0
        out[dim] = Boxes(cube[0], cube[1], cube[2], cube[3].max(1))
    return out


FOUND = "query_id long, dim int, vec_id long, score long, products long"


def searched(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, queries: int = QUERIES, rows: int = ROWS) -> DataFrame:
    """(query_id, dim, vec_id, score, products): the best k of each block that a query met; rows without query_id count products."""
    x = F.col("embedding")
    fine = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double") * scale) == float("inf")))
    d = vectors.where("vec_id is not null").where(fine).select(F.col("vec_id").cast("long").alias("id"), F.size(x).alias("dim"), x.alias("v"))
    sizes = d.groupBy("dim").agg(F.count("*").alias("n")).where((F.col("n") > rows) & (F.col("dim") > 0)).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()
    large = {r["dim"]: min(GROUPS, -(-r["n"] // rows)) for r in sizes}
    d = written(grouped(d, large, scale), "topk-rows")
    kind = d.schema["v"].dataType.simpleString()
    box = boxes(d, large, scale)
    # a group is cut into blocks of about `rows`, so that one which holds most rows is many blocks
    blocks = written(d.groupBy("dim", "g").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks")), "topk-blocks")
    place = lambda c, n, *salt: F.pmod(F.xxhash64(c, *salt), n.cast("long")).cast("int")
    c = d.join(blocks, ["dim", "g"]).select("dim", "g", place("id", F.col("blocks")).alias("b"), "id", "v")

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part in _by_length(b):
                home = np.zeros(part.num_rows, np.int32)
                if dim in box:
                    home = np.nan_to_num(box[dim].upper(_rows(part, "v", scale)), nan=-np.inf).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("dim"), part.column("v"), pa.array(home)], names=["id", "dim", "v", "home"])

    asked = d.where(F.col("id") % every == 0).groupBy("id", "dim").agg(F.min("v").alias("v"))
    q = asked.mapInArrow(aim, f"id long, dim int, v {kind}, home int")
    q = q.join(blocks.withColumnsRenamed({"g": "home"}), ["dim", "home"], "left").fillna({"blocks": 1})
    # queries are blocked by their first group and a hash
    share = q.groupBy("dim", "home").agg(F.ceil(F.count("*") / queries).cast("int").alias("of"))
    q = q.join(share, ["dim", "home"]).select("id", "dim", "v", "home", place("id", F.col("of"), F.lit("part")).alias("part"), place("id", F.col("blocks")).alias("b"))
    q = written(q, "topk-queries")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found, n = [], 0
        if left.num_rows and right.num_rows:
            floors = left.column("q_floor").to_numpy(zero_copy_only=False)
            found, n = block_top(left.column("q_id").to_numpy(), _rows(left, "q_v", scale), right.column("id").to_numpy(), _rows(right, "v", scale), k, floors)
        dim = left.column("q_dim")[0].as_py() if left.num_rows else None
        cols = list(zip(*[(a, dim, b, s, None) for a, b, s in found], (None, None, None, None, n), strict=True))
        return pa.table({name: pa.array(v, t) for name, v, t in zip(("query_id", "dim", "vec_id", "score", "products"), cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)})

    def met(asking: DataFrame) -> DataFrame:
        """Blocks of queries with the blocks of rows that any of them asks for; others are not moved."""
        cell = ["dim", "g", "b", "home", "part"]
        wanted = asking.select(*cell).distinct()
        right = c.join(wanted, ["dim", "g", "b"])
        left = asking.withColumnsRenamed({x: f"q_{x}" for x in asking.columns})
        return left.groupBy(*[f"q_{x}" for x in cell]).cogroup(right.groupBy(*cell)).applyInArrow(meet, FOUND)

    first = written(met(q.select("*", F.col("home").alias("g"), F.lit(float("-inf")).alias("floor"))), "topk-first")
    ranked = first.where("query_id is not null").withColumn("n", F.row_number().over(Window.partitionBy("query_id", "dim").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") == k)
    # a long at the end of its range may stand for more; as a double it is no less than what it stands for
    floors = ranked.select(F.col("query_id").alias("id"), "dim", F.col("score").cast("double").alias("floor"))
    rest = q.join(floors, ["id", "dim"], "left").fillna({"floor": float("-inf")})

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part in _by_length(b):
                if dim in box:
                    upper, floor = box[dim].upper(_rows(part, "v", scale)), part.column("floor").to_numpy()
                    groups = [np.flatnonzero(~(u < f)).astype(np.int32) for u, f in zip(upper, floor, strict=True)]
                else:
                    groups = [np.zeros(1, np.int32)] * part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(groups, pa.list_(pa.int32()))], names=[*names, "groups"])

    names = ["id", "dim", "v", "home", "part", "b", "floor"]
    rest = rest.select(*names).mapInArrow(reach, f"id long, dim int, v {kind}, home int, part int, b int, floor double, groups array<int>")
    rest = rest.withColumn("g", F.explode("groups")).join(blocks, ["dim", "g"]).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.where((F.col("g") != F.col("home")) | (F.col("at") != F.col("b"))).select("id", "dim", "v", "home", "part", "g", F.col("at").alias("b"), "floor")
    return first.union(met(rest))


def top_k(vectors: DataFrame, k: int = 5, **how: int) -> DataFrame:
    """query_id, rank, vec_id, score for the queries, the rows whose vec_id is divisible by `every` (50)."""
    best = searched(vectors, k, **how).where("query_id is not null")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
