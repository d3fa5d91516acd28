"""64-bit hashes that Spark has no function for, on Arrow batches; numbers are the bit patterns of longs."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64 of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def stable_int(text: str) -> int:
    """The first 8 bytes of BLAKE2b, big-endian."""
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big")


def split_mix(c: Column) -> Column:
    """SplitMix64 of the bits of a long."""

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        from overlapse.functions import hashes as here

        return pd.Series(here.mixed(x.to_numpy(np.int64).view(np.uint64)).view(np.int64))

    return F.when(c.isNotNull(), run(F.coalesce(c, F.lit(0).cast("long"))))


def token_number(c: Column) -> Column:
    """stable_int of a text as the bits of a long; NULL for NULL."""

    @F.pandas_udf("long")
    def run(t: pd.Series) -> pd.Series:
        from overlapse.functions import hashes as here

        return pd.Series(np.fromiter((here.stable_int(x or "") for x in t), np.uint64, len(t)).view(np.int64))

    return F.when(c.isNotNull(), run(c))
