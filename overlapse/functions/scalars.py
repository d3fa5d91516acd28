"""Scalar functions of the audit, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO64 = 18446744073709551616.0
#: A prime below 2**31 and multipliers that keep every product below 2**62.
PRIME, STEP, SHIFT = 2147483647, 48271, 11


def stable_key(text: Column, seed: object = 0) -> Column:
    """A number in [0, 1) from the first 16 hex digits of SHA-256 of "seed:text"; the random key of all selections."""
    digest = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), text.cast("string")), 256), 1, 16)
    return F.conv(digest, 16, 10).cast("decimal(20,0)").cast("double") / TWO64


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def as_bool(c: Column) -> Column:
    """True for 1, true, t and yes in any case."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "t", "yes"), F.lit(False))


def finite(c: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def token_hash(token: Column) -> Column:
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % PRIME


def minhash(tokens: Column, size: int) -> Column:
    """Signature of a token set by `size` linear functions modulo a prime; zeros for an empty set."""
    places = F.sequence(F.lit(1).cast("bigint"), F.lit(size).cast("bigint"))
    # the hashes are bound to a variable, so they are made once and not for each place
    sign = lambda h: F.transform(places, lambda i: F.array_min(F.transform(h, lambda v: (i * STEP * v + i * SHIFT) % PRIME)))
    sig = F.get(F.transform(F.array(F.transform(tokens, token_hash)), sign), 0)
    return F.when(F.size(tokens) > 0, sig).otherwise(F.array_repeat(F.lit(0).cast("bigint"), size))


def agreement(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)


def tanimoto(a: Column, b: Column) -> Column:
    """Intersection over union of two sets; NULL where one is missing or both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def ci_text(mid: Column, low: Column, high: Column, digits: int = 4) -> Column:
    f = f"%.{digits}f"
    return F.format_string(f"{f} [{f}, {f}]", mid, low, high)


def mean_sd_text(mean: Column, sd: Column, digits: int = 4) -> Column:
    f = f"%.{digits}f"
    return F.when(sd.isNull(), F.format_string(f, mean)).otherwise(F.format_string(f"{f} ± {f}", mean, sd))


def inchi_layers(inchi: Column, stereo: bool) -> Column:
    """The stereo layers (b, t, m, s) of an identifier, or everything else."""
    is_stereo = lambda x: x.rlike("^[btms]")
    parts = F.split(inchi, "/")
    return F.array_join(F.filter(parts, (lambda x: is_stereo(x)) if stereo else (lambda x: ~is_stereo(x))), "/")


def inchi_formula(inchi: Column) -> Column:
    return F.get(F.split(inchi, "/"), F.lit(1))


def heavy_atoms(formula: Column) -> Column:
    """Atoms of a formula other than hydrogen."""
    tokens = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)([0-9]*)"), F.lit(0))
    count = lambda t: F.when(F.regexp_extract(t, "^([A-Z][a-z]?)", 1) == "H", 0).otherwise(F.coalesce(F.regexp_extract(t, "([0-9]+)$", 1).try_cast("int"), F.lit(1)))
    return F.aggregate(tokens, F.lit(0), lambda s, t: s + count(t))


def connectivity_block(inchikey: Column) -> Column:
    return F.when(inchikey != "", F.get(F.split(inchikey, "-"), F.lit(0)))


def charged_atoms(smiles: Column) -> Column:
    return F.size(F.regexp_extract_all(smiles, F.lit(r"\[[^\]]*[+-][^\]]*\]"), F.lit(0)))


def aromatic_atoms(smiles: Column) -> Column:
    bare = F.regexp_replace(smiles, r"\[([0-9]*)(se|as|[bcnops])[^\]]*\]|\[[^\]]*\]|Cl|Br", "$2")
    return F.size(F.regexp_extract_all(bare, F.lit("se|as|[bcnops]"), F.lit(0)))


#: Atomic weights of the organic subset.
WEIGHTS = {"H": 1.008, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "P": 30.974, "S": 32.06, "Cl": 35.45, "Br": 79.904, "I": 126.904}


def formula_weight(formula: Column) -> Column:
    tokens = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)([0-9]*)"), F.lit(0))
    table = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    return F.aggregate(tokens, F.lit(0.0), lambda s, t: s + F.try_element_at(table, F.regexp_extract(t, "^([A-Z][a-z]?)", 1)) * F.coalesce(F.regexp_extract(t, "([0-9]+)$", 1).try_cast("int"), F.lit(1)))


EXPECTED = {"exact": "canonical", "random": "canonical", "parent": "parent", "stereo": "stereo", "tautomer": "tautomer"}
FAMILY = {"raw": "exact", "canonical": "exact", "parent": "lattice", "stereo": "lattice", "tautomer": "lattice", "scaffold": "similarity"}


def _lookup(c: Column, table: dict[str, str], other: str) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), F.lit(other))


def expected_detector(relation: Column) -> Column:
    return _lookup(relation, EXPECTED, "canonical")


def detector_family(detector: Column) -> Column:
    return _lookup(detector, FAMILY, "similarity")


def relation_of(condition: Column) -> Column:
    """The relation of a condition name such as parent_5x; `clean` as it is."""
    r = F.regexp_extract(condition, r"^(.+)_(\d+)x$", 1)
    return F.when(r != "", r).otherwise(condition)


def dose_of(condition: Column) -> Column:
    return F.regexp_extract(condition, r"^(.+)_(\d+)x$", 2).try_cast("int")


def primary_relation(flags: dict[str, Column]) -> Column:
    """The first true flag in order of precedence, else none."""
    out = F.lit("none")
    for name in reversed(list(flags)):
        out = F.when(F.coalesce(flags[name], F.lit(False)), F.lit(name)).otherwise(out)
    return out


def effect_support(n: Column) -> Column:
    """Support of an effect by its number of affected rows."""
    return F.when(n >= 100, "strong").when(n >= 30, "moderate").when(n >= 10, "limited").otherwise("sparse")


def decision_support(low: Column, high: Column) -> Column:
    """Support by whether the interval excludes zero."""
    return F.when(low > 0, "positive").when(high < 0, "negative").otherwise("inconclusive")


def seed_support(positive: Column, n: Column) -> Column:
    """Support by the share of seeds with a positive effect."""
    return F.when(positive == n, "all seeds").when(positive * 2 >= n, "most seeds").otherwise("few seeds")


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    n = F.when(n > 0, n)  # without rows there is no interval
    p = k.cast("double") / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), mid - half)), F.when(n.isNotNull(), F.least(F.lit(1.0), mid + half))


def ppv(tpr: Column, fpr: Column, prevalence: float) -> Column:
    return F.try_divide(tpr * prevalence, tpr * prevalence + fpr * (1 - prevalence))


PRIVACY = {
    "home_path": r"/(?:home|Users)/[A-Za-z0-9._-]+", "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "access_key": r"AKIA[0-9A-Z]{16}", "token": r"token *= *.[0-9a-f]{20,}", "password": r"password=[^ ]+", "phone": r"\+[0-9]{1,3} ?\(?[0-9]{3}\)? ?[0-9]{3}-[0-9]{4}",
}


def privacy_flags(text: Column) -> dict[str, Column]:
    return {k: F.coalesce(text.rlike(p), F.lit(False)) for k, p in PRIVACY.items()}
