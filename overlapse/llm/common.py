"""Shared folder, materialised tables and whitespace rules for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def private(df: DataFrame) -> Callable[[str], str]:
    """Names for columns of our own beside those of df: no column of df begins with their mark, in any case."""
    mark = "__"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    return lambda name: mark + name


def named(column: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor and the driver reach.

    Only where that setting is absent is a temporary folder made for it, and only under a local master: on a
    cluster each executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="overlapse-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Folders written and not removed yet.
_WRITTEN: list[str] = []


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and a lost executor costs nothing.

    It stays until removed() is called, or the end of tidied(), as what is returned lazily may read it.
    """
    path = shared_dir(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Removes folders that written() has made; nothing may read them any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _WRITTEN.remove(path)


@contextmanager
def tidied(spark: SparkSession, keep: int = 0) -> Iterator[None]:
    """Removes at its end what was written within, but for the last `keep` folders."""
    before = set(_WRITTEN)
    yield
    new = [p for p in _WRITTEN if p not in before]
    removed(spark, new[: len(new) - keep])


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 21, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many bytes of the column, or of one row, and of at most so many rows."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        before = int(ends[lo - 1]) if lo else 0
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(ends, before + most, "right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components: (id, label) for every id in edges, label = least id of its component.

    Every round takes the least label among neighbours, hooks the old root onto it and jumps
    pointers; rounds are few (logarithmic in practice) and each is written to the shared folder.
    Hub ids stay cheap: only minima are aggregated, after partial aggregation.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = written(pairs.union(pairs.select("v", "u")).distinct(), "cc-edges")
    labels = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("label")), "cc-labels")
    *_, edge_path, path = _WRITTEN
    while True:
        near = both.join(labels.withColumnsRenamed({"u": "v"}), "v").groupBy("u").agg(F.min("label").alias("near"))
        old = labels.join(near, "u")
        best = old.select("u", F.least("label", "near").alias("label")).union(old.select(F.col("label").alias("u"), F.col("near").alias("label")))
        best = best.groupBy("u").agg(F.min("label").alias("label"))
        jump = best.select(F.col("u").alias("p"), F.col("label").alias("p_label"))
        nxt = best.join(jump, F.col("label") == F.col("p")).select("u", F.least("label", "p_label").alias("label"))
        nxt = written(nxt.join(labels.withColumnsRenamed({"label": "was"}), "u"), "cc-labels")
        removed(spark, [path])
        path = _WRITTEN[-1]
        labels = nxt.select("u", "label")
        if nxt.where("label <> was").isEmpty():
            removed(spark, [edge_path])
            return labels.withColumnsRenamed({"u": "id"})
