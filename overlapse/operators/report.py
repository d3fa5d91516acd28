"""Reports: Markdown tables, provenance certificates with a schema check, manifests and status rows."""

from __future__ import annotations

import hashlib
import json
import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown(df: DataFrame, order: list[str], digits: int = 4) -> str:
    """A small result as a Markdown table, in the order given."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    rows = [[show(v) for v in r] for r in df.orderBy(*order).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows]) + "\n"


def utc_stamp(text: str) -> datetime:
    """An ISO-8601 time that names its zone, which must be UTC."""
    t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    if t.utcoffset() is None or t.utcoffset() != timedelta(0):
        raise ValueError(f"not a time in UTC: {text}")
    return t


def plain(x: object) -> object:
    """Values as JSON has them: NaN and infinities become null, NumPy scalars Python's."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    x = x.item() if hasattr(x, "item") else x
    return None if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))) else x


_KIND = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def violations(x: object, schema: dict, at: str = "$", root: dict | None = None) -> list[str]:
    """What breaks a JSON schema: type, const, enum, required, properties, additionalProperties, items, pattern, minimum, minLength, format, $ref."""
    root = root or schema
    if "$ref" in schema:
        for part in schema["$ref"].lstrip("#/").split("/"):
            schema = root[part] if schema.get("$ref", "").startswith("#/") and part in root else schema if part not in schema else schema[part]
    out: list[str] = []

    def is_a(kind: str) -> bool:
        if kind in ("integer", "number"):
            return isinstance(x, int) and not isinstance(x, bool) or kind == "number" and isinstance(x, float) or kind == "integer" and isinstance(x, float) and x.is_integer()
        return isinstance(x, _KIND[kind])

    kinds = schema.get("type")
    if kinds and not any(map(is_a, [kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: is no {kinds}"]
    if "const" in schema and x != schema["const"]:
        out.append(f"{at}: is not {schema['const']!r}")
    if "enum" in schema and x not in schema["enum"]:
        out.append(f"{at}: is none of {schema['enum']}")
    if isinstance(x, str):
        if "pattern" in schema and not re.search(schema["pattern"], x):
            out.append(f"{at}: does not match {schema['pattern']}")
        if len(x) < schema.get("minLength", 0):
            out.append(f"{at}: is too short")
        if schema.get("format") == "date-time":
            try:
                datetime.fromisoformat(x.replace("Z", "+00:00"))
            except ValueError:
                out.append(f"{at}: is no time")
    if isinstance(x, (int, float)) and not isinstance(x, bool) and x < schema.get("minimum", x):
        out.append(f"{at}: is below {schema['minimum']}")
    if isinstance(x, list) and "items" in schema:
        out += [e for i, v in enumerate(x) for e in violations(v, schema["items"], f"{at}[{i}]", root)]
    if isinstance(x, dict):
        known = schema.get("properties", {})
        out += [f"{at}: lacks {k}" for k in schema.get("required", []) if k not in x]
        for k, v in x.items():
            rest = schema.get("additionalProperties", True)
            if k in known:
                out += violations(v, known[k], f"{at}.{k}", root)
            elif rest is False:
                out.append(f"{at}: has {k}")
            elif isinstance(rest, dict):
                out += violations(v, rest, f"{at}.{k}", root)
    return out


CERTIFICATE = {
    "type": "object", "additionalProperties": False, "required": ["generated_at_utc", "schema_sha256", "corpora", "manifest", "splits", "effects", "risk"],
    "properties": {
        "generated_at_utc": {"type": "string", "format": "date-time"}, "schema_sha256": {"type": "string", "pattern": "^[0-9a-f]{64}$"},
        "corpora": {"type": "array", "items": {"type": "object", "required": ["name", "n_lines"], "properties": {"name": {"type": "string", "minLength": 1}, "n_lines": {"type": "integer", "minimum": 0}}}},
        "manifest": {"type": "array", "items": {"type": "object", "required": ["relation", "dose", "n_records"], "properties": {"relation": {"type": "string"}, "dose": {"type": "integer", "minimum": 1}, "n_records": {"type": "integer", "minimum": 0}}}},
        "splits": {"type": "object", "additionalProperties": {"type": "integer", "minimum": 0}},
        "effects": {"type": "array", "items": {"type": "object"}}, "risk": {"type": "object", "required": ["level"], "properties": {"level": {"enum": ["none", "low", "elevated"]}}},
    },
}


def schema_hash(schema: dict = CERTIFICATE) -> str:
    return hashlib.sha256(json.dumps(schema, sort_keys=True).encode()).hexdigest()


def manifest_rollup(manifest: DataFrame) -> DataFrame:
    """Per (relation, dose): records, samples, injected texts, mean and greatest absolute length change."""
    return manifest.groupBy("relation", "dose").agg(F.count("*").alias("n_records"), F.count_distinct("sample_id").alias("n_samples"), F.count_distinct("injected_sha256").alias("n_injected"), F.avg("length_delta").alias("mean_length_delta"), F.max(F.abs("length_delta")).alias("max_abs_length_delta"))


def counts_map(df: DataFrame, column: str, by: str) -> DataFrame:
    """(by, counts): a map from value to number of rows."""
    n = df.groupBy(by, column).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(column).cast("string"), "n")))).alias("counts"))


def certificate(generated_at: str, corpora: DataFrame, manifest: DataFrame, splits: DataFrame, effects: DataFrame) -> dict:
    """A certificate from small result tables; raises where it breaks its schema."""
    utc_stamp(generated_at)
    eff = [r.asDict(True) for r in effects.orderBy(*effects.columns).collect()]
    risky = any((e.get("low") or 0) > 0 for e in eff)
    doc = plain({
        "generated_at_utc": generated_at, "schema_sha256": schema_hash(), "corpora": [r.asDict(True) for r in corpora.orderBy("name").collect()],
        "manifest": [r.asDict(True) for r in manifest_rollup(manifest).orderBy("relation", "dose").collect()], "splits": {r[0]: r[1] for r in splits.collect()},
        "effects": eff, "risk": {"level": "elevated" if risky else "low" if eff else "none"},
    })
    wrong = violations(doc, CERTIFICATE)
    if wrong:
        raise ValueError("; ".join(wrong))
    return doc


def checksum_audit(pinned: DataFrame, present: DataFrame) -> DataFrame:
    """(path, status): a full outer join of a manifest (path, sha256) with the files there."""
    d = pinned.withColumnsRenamed({"sha256": "want"}).join(present.withColumnsRenamed({"sha256": "have"}), "path", "full")
    return d.select("path", F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("want") == F.col("have"), "ok").otherwise("changed").alias("status"))


def status_rows(spark: SparkSession, expected: dict[str, str]) -> DataFrame:
    """(name, path, present, n_rows): one row per expected table."""
    rows = []
    for name, path in expected.items():
        try:
            rows.append((name, path, True, spark.read.parquet(path).count()))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows.append((name, path, False, 0))
    return spark.createDataFrame(rows, "name string, path string, present boolean, n_rows long")


def planned_left(planned: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Planned jobs that are not finished."""
    return planned.join(finished.select(*keys).distinct(), keys, "left_anti")
