"""Writers: line corpora, JSON lines, sorted CSV, partitioned conditions, metadata; and a verified unpack."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tarfile
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, path: str, one_file: bool = True) -> None:
    """(idx, text) as lines in the order of idx."""
    d = df.orderBy("idx").select("text")
    (d.coalesce(1) if one_file else d).write.mode("overwrite").text(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str, order: list) -> None:
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def conditions(df: DataFrame, path: str) -> None:
    """Corpora of all conditions, a folder for each relation and dose."""
    df.repartition("relation", "dose").sortWithinPartitions("idx").write.mode("overwrite").partitionBy("relation", "dose").parquet(path)


def metadata(values: dict, path: str) -> None:
    from overlapse.operators.report import plain

    Path(path).write_text(json.dumps(plain(values), sort_keys=True, indent=1) + "\n")


def vocabulary(df: DataFrame, text: str, specials: tuple[str, ...] = ("<pad>", "<bos>", "<eos>", "<unk>", "<mask>")) -> list[str]:
    """Characters by frequency after the special tokens; an alphabet, so it fits the driver."""
    n = df.select(F.explode(F.split(text, "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    return [*specials, *[r["c"] for r in n.orderBy(F.desc("n"), "c").collect()]]


def sha256_file(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def unpack(archive: str, sha256: str, target: str) -> None:
    """Unpacks a pinned archive: wrong hash, links and paths that leave the target are refused; all or nothing."""
    if sha256_file(archive) != sha256:
        raise ValueError("the archive is not the pinned one")
    stage = tempfile.mkdtemp(dir=os.path.dirname(os.path.abspath(target)))
    try:
        with tarfile.open(archive) as t:
            for m in t.getmembers():
                if m.issym() or m.islnk() or not (m.isfile() or m.isdir()) or m.name.startswith("/") or ".." in Path(m.name).parts:
                    raise ValueError(f"unsafe member: {m.name}")
            t.extractall(stage, filter="data")
        os.rename(stage, target)
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise
