"""Readers: task tables, corpora, manifests, predictions, certificates and catalogues."""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overlapse.functions.scalars import dose_of, relation_of

#: Names of the columns that hold a molecule's text, in order of preference.
TEXT_COLUMNS = ("smiles", "SMILES", "mol", "Molecule", "compound_iso_smiles", "smiles_raw")
MANIFEST = T.StructType([
    T.StructField("sample_id", T.StringType()), T.StructField("task", T.StringType()), T.StructField("relation", T.StringType()), T.StructField("dose", T.IntegerType()), T.StructField("rep", T.IntegerType()),
    T.StructField("background_index", T.LongType()), T.StructField("background_sha256", T.StringType()), T.StructField("background_len", T.IntegerType()), T.StructField("injected_sha256", T.StringType()),
    T.StructField("injected_smiles", T.StringType()), T.StructField("injected_len", T.IntegerType()), T.StructField("length_delta", T.IntegerType()),
])


def resolve(columns: list[str], wanted: tuple[str, ...]) -> str:
    """The first wanted column there is: by its exact name, then in any case."""
    for w in wanted:
        if w in columns:
            return w
    lower = {c.lower(): c for c in reversed(columns)}
    for w in wanted:
        if w.lower() in lower:
            return lower[w.lower()]
    raise KeyError(f"none of {wanted} in {columns}")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, split: int = 128 << 20) -> DataFrame:
    """df dealt over all cores where its files are less than a split a core; larger tables come in enough splits and stay as they are.

    Small files often hold all rows in one row group, which one task reads. What this moves is bounded by cores times a split.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df


def delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """CSV, or tab-separated by suffix; gzip by suffix."""
    bare = path.removesuffix(".gz")
    return spark.read.option("header", True).option("sep", sep or ("\t" if bare.endswith((".tab", ".tsv")) else ",")).csv(path)


def largest(spark: SparkSession, paths: list[str]) -> str:
    """Of several copies of a table the one with most rows, the first among equals."""
    counts = [(delimited(spark, p).count(), -i) for i, p in enumerate(paths)]
    return paths[-max(counts)[1]]


def task(df: DataFrame, name: str, labels: tuple[str, ...], text: tuple[str, ...] = TEXT_COLUMNS, task_type: str = "classification", order: str | None = None) -> DataFrame:
    """smiles, y, task, task_type, sample_id: numeric labels, no nulls, the first row of a repeated text.

    Rows are numbered before any is dropped, so ids have gaps. `order` names a column of the file order;
    without it the order is that of one input split, read as it lies.
    """
    t, y = resolve(df.columns, text), resolve(df.columns, labels)
    rank = F.row_number().over(Window.orderBy(order)) - 1 if order else F.monotonically_increasing_id()
    d = df.select(F.col(t).alias("smiles"), F.col(y).cast("string").try_cast("double").alias("y"), rank.alias("i"))
    d = d.where(F.col("smiles").isNotNull() & F.col("y").isNotNull() & ~F.isnan("y"))
    d = d.withColumn("n", F.row_number().over(Window.partitionBy("smiles").orderBy("i"))).where("n = 1")
    return d.select("smiles", "y", F.lit(name).alias("task"), F.lit(task_type).alias("task_type"), F.concat(F.lit(f"{name}_"), F.lpad(F.col("i").cast("string"), 6, "0")).alias("sample_id"))


def lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(idx, text): the non-empty lines of a corpus in file order; a limit counts lines in that order."""
    d = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("idx", "text"))
    d = d.where(F.trim("text") != "").select("idx", F.trim("text").alias("text"))
    d = d.withColumn("idx", F.row_number().over(Window.orderBy("idx")) - 1)
    return d.where(F.col("idx") < limit) if limit is not None else d


def first_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(text): the first token of each line that could be a molecule."""
    d = spark.read.text(path).select(F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)).alias("text"))
    return d.where(F.col("text").rlike(r"[A-Za-z\[\]()=#@]") & (F.col("text") != ""))


def one_column(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(text): of a delimited file only the first column whose name holds "smiles", else the first."""
    d = delimited(spark, path)
    name = next((c for c in d.columns if "smiles" in c.lower()), d.columns[0])
    d = d.select(F.col(name).alias("text")).where("text is not null")
    return d.limit(limit) if limit is not None else d


def scan(root: str, patterns: tuple[str, ...], most: int = 2000) -> list[str]:
    """Files below a local folder that match any pattern, sorted, at most so many."""
    return sorted({str(p) for g in patterns for p in Path(root).rglob(g) if p.is_file()})[:most]


def budgeted(parts: list[tuple[str, DataFrame]], budget: int) -> DataFrame:
    """(source, text): sources in turn until `budget` rows, each text at its first place."""
    out = None
    for i, (name, df) in enumerate(parts):
        d = df.select(F.lit(i).alias("part"), F.lit(name).alias("source"), "text", F.monotonically_increasing_id().alias("at"))
        out = d if out is None else out.unionByName(d)
    out = out.withColumn("n", F.row_number().over(Window.orderBy("part", "at"))).where(F.col("n") <= budget)
    out = out.withColumn("k", F.row_number().over(Window.partitionBy("text").orderBy("n"))).where("k = 1")
    return out.select("source", "text")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of an injection, blanks skipped."""
    return spark.read.schema(MANIFEST).json(path)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction files with task, condition, relation, dose and seed from names like task__parent_5x__seed3."""
    name = r"([^/]+)__([^/]+)__seed(\d+)\.csv$"
    d = spark.read.option("header", True).option("inferSchema", True).csv(path).select("*", F.col("_metadata.file_path").alias("__f"))
    got = {"task": F.regexp_extract("__f", name, 1), "condition": F.regexp_extract("__f", name, 2), "seed": F.regexp_extract("__f", name, 3).cast("int")}
    d = d.withColumns(got)
    return d.withColumns({"relation": relation_of(F.col("condition")), "dose": dose_of(F.col("condition"))}).drop("__f")


def named_tables(spark: SparkSession, path: str) -> DataFrame:
    """CSV tables of several runs, with `artifact` from the folder of each."""
    d = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return d.select("*", F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("artifact"))


def certificates(spark: SparkSession, path: str) -> DataFrame:
    """(file, level, best_effect): nested documents as rows, with the greatest effect of each."""
    shape = "risk struct<level:string>, effects array<struct<task:string,mean:double>>"
    d = spark.read.schema(shape).option("multiLine", True).json(path)
    best = F.array_max(F.transform("effects", lambda e: F.struct(e["mean"].alias("mean"), e["task"].alias("task"))))
    return d.select(F.col("_metadata.file_name").alias("file"), "risk.level", best["task"].alias("best_task"), best["mean"].alias("best_effect"))


def optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table, or an empty one where it is absent."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def renamed(df: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """df with other names of its columns brought to the usual ones."""
    for usual, others in names.items():
        if usual not in df.columns:
            hit = next((o for o in others if o in df.columns), None)
            df = df.withColumnRenamed(hit, usual) if hit else df.withColumn(usual, F.lit(None).cast("double"))
    return df


def registry(spark: SparkSession, url: str, name: str, driver: str = "org.sqlite.JDBC") -> DataFrame:
    """A table of a relational registry, filters and columns pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, driver=driver).load()


def keyword_flags(pages: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """page_id and, for each word, whether the page holds it in any case."""
    low = F.lower("html")
    return pages.select("page_id", *[F.coalesce(F.contains(low, F.lit(w)), F.lit(False)).alias(f"has_{w}") for w in words])
