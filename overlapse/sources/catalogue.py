"""Task tables by name, and loaders of queries, stored keys, records, pairs and registry entries."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from overlapse.functions import smiles
from overlapse.sources import readers

#: Fixed values: (type, file names, label columns in order of preference) of the known tasks.
TASKS = {
    "esol": ("regression", ("esol.csv", "delaney-processed.csv"), ("measured log solubility in mols per litre", "logSolubility", "y")),
    "bace": ("classification", ("bace.csv", "BACE.csv"), ("Class", "class", "label", "y")),
    "bbbp": ("classification", ("BBBP.csv", "bbbp.csv"), ("p_np", "Class", "label", "y")),
    "hiv": ("classification", ("HIV.csv", "hiv.csv"), ("HIV_active", "label", "y")),
    "clintox_tox": ("classification", ("clintox.csv", "ClinTox.csv"), ("CT_TOX", "ct_tox", "label", "y")),
    "clintox_fda": ("classification", ("clintox.csv", "ClinTox.csv"), ("FDA_APPROVED", "fda_approved", "label", "y")),
    "tox21_ahr": ("classification", ("tox21.csv", "tox21.csv.gz", "Tox21.csv"), ("NR-AhR", "nr_ahr", "label", "y")),
    "tox21_are": ("classification", ("tox21.csv", "tox21.csv.gz", "Tox21.csv"), ("SR-ARE", "sr_are", "label", "y")),
    "tox21_mmp": ("classification", ("tox21.csv", "tox21.csv.gz", "Tox21.csv"), ("SR-MMP", "sr_mmp", "label", "y")),
    "sider_gastro": ("classification", ("sider.csv", "SIDER.csv"), ("Gastrointestinal disorders", "gastrointestinal_disorders", "label", "y")),
}


def load_task(spark: SparkSession, name: str, root: str) -> DataFrame:
    """A known task from the largest of its files below a folder, with keys; rows whose text has no canonical key are dropped."""
    kind, files, labels = TASKS[name]
    found = readers.scan(root, files)
    if not found:
        raise FileNotFoundError(f"none of {files} below {root}")
    rows = readers.task(readers.delimited(spark, readers.largest(spark, found)), name, labels, task_type=kind)
    keyed = smiles.with_keys(rows).where("canonical is not null")
    return keyed.select("smiles", "y", "task", "task_type", "sample_id", "canonical", "parent", F.col("stereo").alias("stereo_stripped"), "scaffold")


def task_queries(spark: SparkSession, folder: str) -> DataFrame:
    """(task, sample_id, split, y, smiles) of all split files of a folder; the canonical text where a file has one."""
    parts = []
    for path in readers.scan(folder, ("*.csv",)):
        d = readers.delimited(spark, path)
        stem = Path(path).stem
        has = lambda c, other, d=d: F.coalesce(F.col(c), other) if c in d.columns else other
        text = has("canonical", F.col("smiles"))
        parts.append(d.select(has("task", F.lit(stem)).alias("task"), F.col("sample_id") if "sample_id" in d.columns else F.concat(F.lit(f"{stem}_"), F.monotonically_increasing_id().cast("string")).alias("sample_id"), has("split", F.lit("")).alias("split"), has("y", F.lit("")).cast("string").alias("y"), text.alias("smiles")))
    if not parts:
        raise FileNotFoundError(f"no split files in {folder}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stored_keys(affected: DataFrame) -> DataFrame:
    """(sample_id, detector, key) from the keys that a table holds already; only tautomers, and frames that are missing, are worked out."""
    fresh = smiles.with_keys(affected.select(F.col("canonical").alias("text")).distinct(), "text")
    fresh = fresh.select("text", F.col("tautomer").alias("__tautomer"), F.col("scaffold").alias("__scaffold"))
    d = affected.join(fresh, F.col("canonical") == F.col("text"), "left")
    known = {"raw": F.col("smiles"), "canonical": F.col("canonical"), "parent": F.col("parent"), "stereo": F.col("stereo_stripped"), "tautomer": F.col("__tautomer"), "scaffold": F.coalesce(F.nullif("scaffold", F.lit("")), F.col("__scaffold"))}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("detector"), F.nullif(c, F.lit("")).alias("key")) for k, c in known.items()])).alias("x")
    return d.select("sample_id", rows).select("sample_id", "x.*").where("key is not null")


def records(pool: DataFrame, id_: str, task: str, text: str) -> DataFrame:
    """(id, task, smiles, keys, bits, formula) of a pool of molecules; texts without a canonical key are dropped."""
    d = smiles.with_keys(pool.select(F.col(id_).alias("id"), F.col(task).alias("task"), F.col(text).alias("smiles"))).where("canonical is not null")
    return smiles.with_formula(d)


def converted_pairs(spark: SparkSession, path: str, first: str, second: str) -> DataFrame:
    """(query, target) of a tab-separated table of pairs that was converted before; pairs that do not parse or are the same molecule are dropped."""
    d = readers.delimited(spark, path, "\t").select(F.col(first).alias("query"), F.col(second).alias("target"))
    texts = smiles.with_keys(d.select(F.explode(F.array("query", "target")).alias("smiles")).distinct()).select("smiles", "canonical")
    side = lambda p, c: texts.select(F.col("smiles").alias(c), F.col("canonical").alias(p))
    return d.join(side("q", "query"), "query").join(side("t", "target"), "target").where("q <> t").select("query", "target")


def structures(registry: DataFrame, need: str = "smiles", limit: int | None = None) -> DataFrame:
    """Registry entries in order of their number: those with a text, with a key too, or with an identifier that has stereo layers."""
    c = F.col
    ok = {"smiles": c("canonical_smiles").isNotNull(), "key": c("canonical_smiles").isNotNull() & c("standard_inchi_key").isNotNull(), "stereo": c("canonical_smiles").isNotNull() & c("standard_inchi").rlike("/[btms]")}[need]
    d = registry.where(ok).orderBy("molregno")
    return d.limit(limit) if limit is not None else d


def baseline_artifact(seed_set: Column, own: Column, old: str, extra: str) -> Column:
    """Where the clean or decoy runs of a set of seeds lie: a single artifact has its own."""
    return F.when(seed_set == "single", own).when(seed_set == "extra4", F.lit(extra)).otherwise(F.lit(old))


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()
