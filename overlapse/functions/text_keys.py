"""Relation keys of the text family, as columns. NULL is abstention: no two NULLs are ever equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The lattice, in order of precedence for the relation of a pair.
ROUTES = ("raw", "canonical", "parent", "stereo", "tautomer", "scaffold")
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def _nullif_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def canonical(text: Column) -> Column:
    """Lower case, ends trimmed, runs of white space made one space."""
    return _nullif_empty(F.regexp_replace(F.lower(F.trim(text)), "[ \t\n\r]+", " "))


def _stereo(form: Column) -> Column:
    return _nullif_empty(F.regexp_replace(form, PUNCTUATION, ""))


def _words(form: Column) -> Column:
    return F.sort_array(F.split(form, " "))


def _tautomer(words: Column) -> Column:
    return _nullif_empty(F.array_join(words, " "))


def _scaffold(words: Column) -> Column:
    return _nullif_empty(F.array_join(F.array_distinct(words), " "))


def stereo(text: Column) -> Column:
    """Without decoration: the canonical form with ASCII punctuation dropped."""
    return _stereo(canonical(text))


def tautomer(text: Column) -> Column:
    """Free of order: the sorted words of the canonical form."""
    return _tautomer(_words(canonical(text)))


def parent(text: Column) -> Column:
    """The largest fragment: the canonical form of the longest line, the greater text among equals."""
    best = F.array_max(F.transform(F.split(text, "\n"), lambda x: F.struct(F.length(x).alias("n"), x.alias("t"))))
    return canonical(best["t"])


def scaffold(text: Column) -> Column:
    """The frame: the sorted distinct words."""
    return _scaffold(_words(canonical(text)))


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct n-character shingles of a key; the whole key where it is no longer than n."""
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))
    return F.when(F.length(text) <= n, F.array(text)).when(text.isNotNull(), many)


NORMALISERS = {"raw": lambda c: _nullif_empty(c), "canonical": canonical, "parent": parent, "stereo": stereo, "tautomer": tautomer, "scaffold": scaffold}


def with_keys(df: DataFrame, text: str = "text", routes: tuple[str, ...] = ROUTES, prefix: str = "") -> DataFrame:
    """df with a column for each route. The canonical form and its sorted words are made once and used by all routes."""
    form, words = f"__form_{prefix}{text}", f"__words_{prefix}{text}"
    made = {"raw": lambda: _nullif_empty(F.col(text)), "canonical": lambda: F.col(form), "parent": lambda: parent(F.col(text)), "stereo": lambda: _stereo(F.col(form)), "tautomer": lambda: _tautomer(F.col(words)), "scaffold": lambda: _scaffold(F.col(words))}
    d = df.withColumn(form, canonical(F.col(text)))
    if {"tautomer", "scaffold"} & set(routes):
        d = d.withColumn(words, _words(F.col(form)))
    return d.withColumns({f"{prefix}{r}": made[r]() for r in routes}).drop(form, words)


def key_hash(key: Column) -> Column:
    """128 bits that stand for a key in shuffles and joins; NULL for an abstention."""
    return F.when(key.isNotNull(), F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b")))


def hashed(df: DataFrame, routes: tuple[str, ...] = ROUTES) -> DataFrame:
    """df with hashes in place of its keys."""
    return df.withColumns({r: key_hash(F.col(r)) for r in routes})


def long_keys(df: DataFrame, ids: list[str], routes: tuple[str, ...] = ROUTES) -> DataFrame:
    """(ids, detector, key) without abstentions; keys are hashed before they are laid out in rows."""
    return hashed(df, routes).unpivot(ids, list(routes), "detector", "key").where("key is not null")


def sentences(df: DataFrame, text: str, ids: list[str], least: int = 20) -> DataFrame:
    """(ids, unit): the sentences of the canonical text longer than `least`."""
    units = df.select(*ids, F.explode(F.split(canonical(F.col(text)), r"\. ")).alias("unit"))
    return units.where(F.length("unit") > least)
