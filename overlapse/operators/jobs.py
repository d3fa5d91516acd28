"""Planned runs: grids of tasks, conditions and seeds, run over a bounded number of slots, finished ones skipped."""

from __future__ import annotations

import json
import os
import random
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from itertools import product
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

JOB = "task string, condition string, seed int"
#: Sizes of a run: the whole, and one that shows in minutes that all parts work.
PRESETS = {
    "full": {"max_clean": 5000, "max_queries": 1000, "draws": 20000, "minhash_size": 128},
    "quick": {"max_clean": 100, "max_queries": 100, "draws": 200, "minhash_size": 16},
}


def cpu_budget(asked: int | None = None, spare: int = 30, most: int = 96) -> int:
    """Workers for a host: what is asked, else its cores less some to spare, within bounds."""
    return max(1, min(most, asked if asked else (os.cpu_count() or 1) - spare))


def seeded(seed: int) -> np.random.Generator:
    """Seeds Python's and NumPy's global generators and returns one of its own."""
    random.seed(seed)
    np.random.seed(seed % 2**32)
    return np.random.default_rng(seed)


def grid(spark: SparkSession, tasks: Iterable[str], conditions: Iterable[str], seeds: Iterable[int]) -> DataFrame:
    """A row for each job."""
    return spark.createDataFrame(list(product(tasks, conditions, seeds)), JOB)


def output(folder: str, task: str, condition: str, seed: int) -> Path:
    return Path(folder) / f"{task}__{condition}__seed{seed}.csv"


def run(jobs: DataFrame, work: Callable[[str, str, int, Path], None], folder: str, slots: int = 4, skip_existing: bool = True) -> DataFrame:
    """(task, condition, seed, status, error): every planned job once, `slots` at a time.

    work writes to the path it is given, which gets its final name only after it returns, so a file that is
    there is whole. One failure stops no other job. Jobs are a plan made by hand, so they fit the driver.
    """
    planned = [tuple(r) for r in jobs.select("task", "condition", "seed").orderBy("task", "condition", "seed").collect()]

    def one(job: tuple[str, str, int]) -> tuple:
        target = output(folder, *job)
        if skip_existing and target.exists():
            return (*job, "skipped", None)
        part = target.with_suffix(".part")
        try:
            work(*job, part)
            part.rename(target)
        except Exception as e:  # a job may fail in any way; it is reported
            return (*job, "failed", f"{type(e).__name__}: {e}")
        return (*job, "done", None)

    with ThreadPoolExecutor(slots) as pool:
        rows = list(pool.map(one, planned))
    return jobs.sparkSession.createDataFrame(rows, f"{JOB}, status string, error string")


def heartbeat(jobs: DataFrame, folder: str, path: str) -> dict:
    """Writes how many of the planned jobs have their file, and when that was looked up."""
    planned = [tuple(r) for r in jobs.select("task", "condition", "seed").collect()]
    there = sum(output(folder, *j).exists() for j in planned)
    state = {"planned": len(planned), "finished": there, "complete": there == len(planned), "at": int(time.time())}
    Path(path).write_text(json.dumps(state, sort_keys=True))
    return state
