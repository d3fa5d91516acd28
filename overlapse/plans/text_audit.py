"""Audits of `documents` against `benchmark` on the text family: keys, probes, injection, claims, exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from overlapse.functions.scalars import PRIVACY, detector_family, expected_detector, minhash, privacy_flags, stable_key
from overlapse.functions.text_keys import NORMALISERS, ROUTES, hashed, key_hash, long_keys, sentences, shingles, with_keys
from overlapse.operators import audit, detect, inject, report, selection
from overlapse.sources.readers import keyword_flags, spread, table

DOC, BENCH = "documents", "benchmark"


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*[(F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name).cast("long").alias(f.name) if f.dataType.typeName() == "integer" else F.col(f.name) for f in df.schema])


def duck_keys(x: str) -> dict[str, str]:
    """The routes in DuckDB over a text expression."""
    can = f"nullif(regexp_replace(lower(trim({x})), '[ \\t\\n\\r]+', ' ', 'g'), '')"
    longest = f"list_max(list_transform(string_split({x}, chr(10)), lambda s: {{'n': length(s), 't': s}})).t"
    return {
        "raw": f"nullif({x}, '')", "canonical": can, "parent": f"nullif(regexp_replace(lower(trim({longest})), '[ \\t\\n\\r]+', ' ', 'g'), '')",
        "stereo": f"nullif(regexp_replace({can}, '[!-/:-@\\[-`{{-~]', '', 'g'), '')", "tautomer": f"nullif(array_to_string(list_sort(string_split({can}, ' ')), ' '), '')",
        "scaffold": f"nullif(array_to_string(list_sort(list_distinct(string_split({can}, ' '))), ' '), '')",
    }


def duck_all(x: str, alias: str = "") -> str:
    return ", ".join(f"{e} AS {alias}{r}" for r, e in duck_keys(x).items())


def duck_sentences(tbl: str, id_: str) -> str:
    return f"SELECT {id_}, u AS unit FROM (SELECT {id_}, unnest(string_split({duck_keys('text')['canonical']}, '. ')) AS u FROM {tbl}) WHERE length(u) > 20"


UNPIVOT = ", ".join(f"'{r}'" for r in ROUTES)
LONG = "unnest([" + ", ".join(f"{{'d': '{r}', 'k': {r}}}" for r in ROUTES) + "])"
TASK = "'b' || (item_id % 3)"


def _task(c: str = "item_id") -> Column:
    return F.concat(F.lit("b"), (F.col(c) % 3).cast("string"))


def key_index(spark: SparkSession, d: str) -> DataFrame:
    """FN-01..06, AG-01, AG-37: per detector, rows, distinct keys, the most frequent, and an estimate of the index's size."""
    keys = with_keys(spread(table(spark, d, DOC).select("text")))
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("detector"), key_hash(F.col(r)).alias("key"), F.octet_length(r).alias("size")) for r in ROUTES])).alias("x")
    long = keys.select(rows).select("x.*").where("key is not null")
    index = long.groupBy("detector", "key").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return index.groupBy("detector").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.max("n").alias("most"), F.sum(F.col("size") + 16).alias("index_bytes"))


O_KEY_INDEX = f"""
WITH k AS (SELECT doc_id, {duck_all('text')} FROM documents), l AS (SELECT {LONG} AS x FROM k),
i AS (SELECT x.d AS detector, x.k AS key, count(*) AS n FROM l WHERE x.k IS NOT NULL GROUP BY ALL)
SELECT detector, sum(n)::BIGINT AS n_rows, count(*) AS n_keys, max(n) AS most, sum(strlen(key) + 16)::BIGINT AS index_bytes FROM i GROUP BY detector"""


def _unit_keys(spark: SparkSession, d: str, routes: tuple[str, ...] = ROUTES) -> tuple[DataFrame, DataFrame]:
    docs = sentences(spread(table(spark, d, DOC)), "text", ["doc_id"])
    bench = sentences(table(spark, d, BENCH), "text", ["item_id"]).select(_task().alias("task"), F.monotonically_increasing_id().alias("row"), "unit")
    keyed = lambda x, ids: long_keys(with_keys(x, "unit", routes), ids, routes)
    return keyed(docs, ["doc_id"]), keyed(bench, ["task", "row"])


def background_hits(spark: SparkSession, d: str) -> DataFrame:
    """JN-07, AG-02: sentences of benchmark items probed against those of the documents."""
    docs, bench = _unit_keys(spark, d)
    return rounded(audit.background(detect.probe(bench, docs), "task", "detector"))


O_BACKGROUND = f"""
WITH a AS ({duck_sentences('documents', 'doc_id')}), b AS ({duck_sentences('benchmark', 'item_id')}),
ak AS (SELECT {LONG} AS x FROM (SELECT {duck_all('unit')} FROM a)), i AS (SELECT x.d AS d, x.k AS k, count(*) AS n FROM ak WHERE x.k IS NOT NULL GROUP BY ALL),
bk AS (SELECT {TASK} AS task, {LONG} AS x FROM (SELECT item_id, {duck_all('unit')} FROM b)),
p AS (SELECT task, x.d AS detector, coalesce(i.n, 0) AS n FROM bk LEFT JOIN i ON x.d = i.d AND x.k = i.k WHERE x.k IS NOT NULL)
SELECT task, detector, count(*) AS n_queries, round(avg((n > 0)::INT::DOUBLE), 8) AS hit_rate, round(avg(n::DOUBLE), 8) AS mean_matches, max(n) AS max_matches FROM p GROUP BY ALL"""


def passage_containment(spark: SparkSession, d: str) -> DataFrame:
    """SRC-08, JN-08: benchmark passages that lie within documents."""
    return detect.containment(spread(table(spark, d, DOC)), table(spark, d, BENCH), "doc_id", "item_id")


CAN = duck_keys("text")["canonical"]
O_CONTAINMENT = f"SELECT doc_id, item_id FROM (SELECT doc_id, {CAN} AS t FROM documents) JOIN (SELECT item_id, {CAN} AS p FROM benchmark) ON contains(t, p)"


def exposure_by_task(spark: SparkSession, d: str) -> DataFrame:
    """JN-11, AG-23: the first relation by which a benchmark sentence is in the documents, per task."""
    order = ("canonical", "parent", "stereo", "tautomer", "scaffold")
    docs, bench = _unit_keys(spark, d, order)
    seen = audit.exposure(bench, docs, order, ["task", "row"])
    return rounded(audit.shares_by_label(seen, "task", "exposure", [*order, "none"]))


_ORDER = ("canonical", "parent", "stereo", "tautomer", "scaffold")
O_EXPOSURE = f"""
WITH a AS (SELECT {duck_all('unit')} FROM ({duck_sentences('documents', 'doc_id')})), b AS (SELECT {TASK} AS task, {duck_all('unit')} FROM ({duck_sentences('benchmark', 'item_id')})),
e AS (SELECT task, CASE {' '.join(f"WHEN {r} IN (SELECT {r} FROM a WHERE {r} IS NOT NULL) THEN '{r}'" for r in _ORDER)} ELSE 'none' END AS e FROM b)
SELECT task, count(*) AS n, {', '.join(f"count(*) FILTER (e = '{r}') AS n_{r}, round(count(*) FILTER (e = '{r}') / count(*)::DOUBLE, 8) AS share_{r}" for r in (*_ORDER, 'none'))} FROM e GROUP BY task"""

HASH = lambda x, seed=0: f"(('0x' || substr(sha256('{seed}:' || {x}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE)"


def scaffold_split(spark: SparkSession, d: str) -> DataFrame:
    """WN-01, WN-02, FN-21: whole sources to train, val and test."""
    s = selection.group_split(spread(table(spark, d, DOC).select("doc_id", "source")), "source")
    return s.groupBy("source", "split").agg(F.count("*").alias("n"))


O_SPLIT = f"""
WITH g AS (SELECT source, count(*) AS n, {HASH('source')} AS k FROM documents GROUP BY source),
c AS (SELECT *, sum(n) OVER (ORDER BY k, source) - n / 2.0 AS b, (SELECT count(*) FROM documents) AS t, row_number() OVER (ORDER BY k DESC, source DESC) AS last, count(*) OVER () AS m FROM g),
s AS (SELECT *, CASE WHEN b < floor(t * 0.8::DOUBLE) THEN 'train' WHEN b < floor(t * 0.9::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM c)
SELECT source, n, CASE WHEN last = 1 AND m > 1 AND (SELECT count(*) FROM s WHERE split = 'test') = 0 THEN 'test'
  WHEN last = 2 AND m > 2 AND (SELECT count(*) FROM s WHERE split = 'val') = 0 THEN 'val' ELSE split END AS split FROM s"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, DOC).select("doc_id", "n_chars", "lang")).join(table(spark, d, "labels"), "doc_id")


def affected_selection(spark: SparkSession, d: str) -> DataFrame:
    """WN-03, TK-02: 60 labelled documents, quality in equal parts, in hash order."""
    return selection.stratified_top(_labelled(spark, d), "quality", "doc_id", 60).select("doc_id", "quality")


O_AFFECTED = f"""
WITH l AS (SELECT doc_id, quality, {HASH('doc_id')} AS k FROM labels JOIN documents USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY k, doc_id) > floor(60 / (SELECT count(DISTINCT quality) FROM l)) AS fill FROM l)
SELECT doc_id, quality FROM r ORDER BY fill, k, doc_id LIMIT 60"""


def train_subsample(spark: SparkSession, d: str) -> DataFrame:
    """WN-07: a quarter of each quality class, rounded half to even, in hash order."""
    return selection.stratified_share(_labelled(spark, d), "quality", "doc_id", 0.25).select("doc_id", "quality")


O_SUBSAMPLE = f"""
WITH l AS (SELECT doc_id, quality, {HASH('doc_id')} AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels JOIN documents USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY k, doc_id) AS r FROM l)
SELECT doc_id, quality FROM r WHERE r <= greatest(1, round_even(n * 0.25::DOUBLE, 0))"""


def draws_with_replacement(spark: SparkSession, d: str) -> DataFrame:
    """SM-03: 100 draws of benchmark items with replacement."""
    return selection.with_replacement(table(spark, d, BENCH).select("item_id"), "item_id", 100).select("draw", "item_id")


O_DRAWS = f"""
WITH b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS r FROM benchmark), i AS (SELECT unnest(range(0, 100)) AS draw)
SELECT draw, item_id FROM i JOIN b ON r = floor({HASH('draw')} * (SELECT count(*) FROM benchmark))::BIGINT"""


def ordered_dedup(spark: SparkSession, d: str) -> DataFrame:
    """WN-09, SRC-01: the first document of each canonical text."""
    docs = with_keys(spread(table(spark, d, DOC).select("doc_id", "text")), routes=("canonical",)).where("canonical is not null")
    return selection.first_occurrence(docs, "canonical", "doc_id").select("doc_id")


O_DEDUP = f"SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, {CAN} AS c FROM documents) WHERE c IS NOT NULL GROUP BY c"


def unseen_sentences(spark: SparkSession, d: str) -> DataFrame:
    """FLT-08, SO-02, SO-03: distinct benchmark sentences that no document holds."""
    b = sentences(table(spark, d, BENCH), "text", ["item_id"]).select("unit").distinct()
    return selection.excluding(b, sentences(spread(table(spark, d, DOC)), "text", ["doc_id"]), "unit")


O_UNSEEN = f"SELECT DISTINCT unit FROM ({duck_sentences('benchmark', 'item_id')}) WHERE unit NOT IN (SELECT unit FROM ({duck_sentences('documents', 'doc_id')}))"


def _injected(spark: SparkSession, d: str) -> DataFrame:
    """Queries with their injected text per relation, decoys among them."""
    bench = table(spark, d, BENCH)
    pool = sentences(spread(table(spark, d, DOC)), "text", ["doc_id"]).groupBy("unit").agg(F.min("doc_id").alias("item_id")).select("item_id", F.col("unit").alias("text"))
    pool = pool.withColumn("item_id", F.concat_ws("|", "item_id", "text"))
    v = inject.variants(bench, "item_id", "text")
    decoy = inject.decoys(bench, pool, "item_id", "text").select("sample_id", F.lit("decoy").alias("relation"), F.col("decoy").alias("variant"))
    return v.unionByName(decoy).join(bench.select(F.col("item_id").alias("sample_id"), "text"), "sample_id")


def _injected_cells(spark: SparkSession, d: str) -> DataFrame:
    """Injection metrics per (task, relation, detector), decoy-adjusted."""
    x = _injected(spark, d)
    bench = x.withColumn("task", _task("sample_id"))
    q = hashed(hashed(with_keys(with_keys(bench, "text", prefix="q_"), "variant", prefix="t_"), tuple(f"q_{r}" for r in ROUTES)), tuple(f"t_{r}" for r in ROUTES))
    q = q.withColumn("changed", F.col("q_canonical") != F.col("t_canonical"))
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("detector"), F.col(f"q_{r}").alias("key"), F.coalesce(F.col(f"q_{r}") == F.col(f"t_{r}"), F.lit(False)).alias("hit"), F.lit(i).alias("rank")) for i, r in enumerate(ROUTES)])).alias("x")
    long = q.select("task", "sample_id", "relation", "changed", rows).select("task", "sample_id", "relation", "changed", "x.*").where("key is not null")
    docs = long_keys(with_keys(spread(table(spark, d, DOC).select("doc_id", "text"))), ["doc_id"])
    hits = detect.probe(long, docs).withColumn("clean_hit", F.col("n") > 0)
    cells = audit.injection(hits, "task", "relation", "detector", "rank")
    return audit.decoy_adjusted(cells, ["task", "detector"])


def injection_recall(spark: SparkSession, d: str) -> DataFrame:
    """JN-08, JN-24, AG-03, AG-04, JN-04: recall of injected variants per task, relation and detector, net of decoys."""
    return rounded(_injected_cells(spark, d).drop("rank"))


_V = """
b AS (SELECT item_id, text FROM benchmark),
p AS (SELECT unit, length(unit) AS len, min(doc_id)::VARCHAR || '|' || unit AS id FROM (%s) GROUP BY unit),
pr AS (SELECT *, row_number() OVER (PARTITION BY len ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY len) AS n FROM p),
near AS (SELECT item_id, (SELECT len FROM (SELECT DISTINCT len FROM p) ORDER BY abs(len - length(b.text)), len LIMIT 1) AS len FROM b),
dec AS (SELECT near.item_id, unit FROM near JOIN pr ON near.len = pr.len AND place = floor(%s * n)::BIGINT),
v AS (SELECT item_id, 'exact' AS relation, text AS variant, text FROM b
 UNION ALL SELECT item_id, 'parent', text || chr(10) || 'ion', text FROM b
 UNION ALL SELECT item_id, 'stereo', upper(substr(text, 1, 1)) || regexp_replace(substr(text, 2), '[.,]', '', 'g') || '!', text FROM b
 UNION ALL SELECT item_id, 'tautomer', array_to_string(list_reverse(string_split(text, ' ')), ' '), text FROM b
 UNION ALL SELECT item_id, 'decoy', unit, text FROM dec JOIN b USING (item_id))""" % (duck_sentences("documents", "doc_id"), HASH("near.item_id"))
_CELLS = f"""{_V},
q AS (SELECT {TASK} AS task, item_id, relation, {duck_all('text', 'q_')}, {duck_all('variant', 't_')} FROM v),
l AS (SELECT task, item_id, relation, q_canonical <> t_canonical AS changed, unnest([{', '.join(f"{{'d': '{r}', 'q': q_{r}, 't': t_{r}, 'r': {i}}}" for i, r in enumerate(ROUTES))}]) AS x FROM q),
di AS (SELECT {LONG} AS x FROM (SELECT {duck_all('text')} FROM documents)), ix AS (SELECT DISTINCT x.d AS d, x.k AS k FROM di WHERE x.k IS NOT NULL),
h AS (SELECT task, relation, changed, x.d AS detector, x.r AS rank, coalesce(x.q = x.t, false) AS hit, ix.k IS NOT NULL AS clean FROM l LEFT JOIN ix ON x.d = ix.d AND x.q = ix.k WHERE x.q IS NOT NULL),
c AS (SELECT task, relation, detector, rank, count(*) AS n_queries, avg(hit::INT::DOUBLE) AS injection_recall, avg((hit AND NOT clean)::INT::DOUBLE) AS incremental_recall, avg((hit OR clean)::INT::DOUBLE) AS post_hit_rate,
  count(*) FILTER (changed) AS changed_queries, avg(hit::INT::DOUBLE) FILTER (changed) AS changed_only_recall FROM h GROUP BY ALL),
a AS (SELECT c.*, coalesce(d.injection_recall, 0) AS decoy_fp, c.injection_recall - coalesce(d.injection_recall, 0) AS net_recall, c.changed_only_recall - coalesce(d.injection_recall, 0) AS net_changed_recall
  FROM c LEFT JOIN c d ON d.relation = 'decoy' AND c.task = d.task AND c.detector = d.detector WHERE c.relation <> 'decoy')"""
O_INJECTION = f"""WITH {_CELLS} SELECT task, relation, detector, n_queries, changed_queries, {', '.join(f'round({m}, 8) AS {m}' for m in ('injection_recall', 'incremental_recall', 'post_hit_rate', 'changed_only_recall', 'decoy_fp', 'net_recall', 'net_changed_recall'))} FROM a"""


def claim_matrix(spark: SparkSession, d: str) -> DataFrame:
    """AG-06, FN-25: per cell the best detector of each family, and what the lattice gains; the lattice's is the expected one."""
    cells = _injected_cells(spark, d).withColumn("family", detector_family(F.col("detector")))
    ours = cells.where(F.col("detector") == expected_detector(F.col("relation"))).withColumn("family", F.lit("lattice"))
    others = cells.where("family <> 'lattice'")
    return rounded(audit.claim_matrix(ours.unionByName(others), ["task", "relation"]))


O_CLAIMS = f"""WITH {_CELLS},
f AS (SELECT *, coalesce(net_changed_recall, net_recall) AS s, CASE WHEN detector IN ('raw', 'canonical') THEN 'exact' WHEN detector = 'scaffold' THEN 'similarity' END AS family FROM a),
u AS (SELECT * FROM f WHERE family IS NOT NULL UNION ALL SELECT * REPLACE ('lattice' AS family) FROM f WHERE detector = CASE relation WHEN 'exact' THEN 'canonical' ELSE relation END),
m AS (SELECT task, relation, {', '.join(f"arg_max(detector, {{'s': s, 'r': -rank}}) FILTER (family = '{x}') AS best_{x}, max(s) FILTER (family = '{x}') AS {x}_score" for x in ('lattice', 'exact', 'similarity'))} FROM u GROUP BY ALL)
SELECT task, relation, best_lattice, best_exact, best_similarity, round(lattice_score, 8) AS lattice_score, round(exact_score, 8) AS exact_score, round(similarity_score, 8) AS similarity_score,
  round(lattice_score - exact_score, 8) AS gain_exact, round(lattice_score - similarity_score, 8) AS gain_similarity FROM m"""


def method_summary(spark: SparkSession, d: str) -> DataFrame:
    """AG-05, AG-07: means per task taken as a repeat, then over tasks."""
    return rounded(audit.method_summary(_injected_cells(spark, d), "detector", "task", ["injection_recall", "net_recall", "net_changed_recall"]))


O_METHODS = f"""WITH {_CELLS}, i AS (SELECT detector, task, avg(injection_recall) AS x, avg(net_recall) AS y, avg(net_changed_recall) AS z FROM a GROUP BY ALL)
SELECT detector, count(*) AS n_repeats, round(avg(x), 8) AS injection_recall_mean, round(stddev_samp(x), 8) AS injection_recall_sd, round(avg(y), 8) AS net_recall_mean, round(stddev_samp(y), 8) AS net_recall_sd,
  round(avg(z), 8) AS net_changed_recall_mean, round(stddev_samp(z), 8) AS net_changed_recall_sd FROM i GROUP BY detector"""


def claim_win_tie_loss(spark: SparkSession, d: str) -> DataFrame:
    """AG-08: the order-free key against the best of the other detectors, per relation."""
    return rounded(audit.win_tie_loss(_injected_cells(spark, d), ["task", "relation"], "detector", "tautomer", "net_changed_recall", "relation"))


O_WTL = f"""WITH {_CELLS}, o AS (SELECT task, relation, net_changed_recall AS o FROM a WHERE detector <> 'tautomer' QUALIFY row_number() OVER (PARTITION BY task, relation ORDER BY net_changed_recall DESC NULLS LAST, detector) = 1),
g AS (SELECT a.relation, net_changed_recall - o AS g FROM a JOIN o USING (task, relation) WHERE detector = 'tautomer')
SELECT relation, count(*) AS cells, round(avg(g), 8) AS mean_gain, round(avg(coalesce((g > 1e-12)::INT, 0)::DOUBLE), 8) AS win_rate, round(avg(coalesce((abs(g) <= 1e-12)::INT, 0)::DOUBLE), 8) AS tie_rate,
  round(avg(coalesce((g < -1e-12)::INT, 0)::DOUBLE), 8) AS loss_rate FROM g GROUP BY relation"""


def scenario_summary(spark: SparkSession, d: str) -> DataFrame:
    """FLT-09, AG-09: recall by scenario of the query; scenarios overlap."""
    x = with_keys(with_keys(_injected(spark, d), "text", prefix="q_"), "variant", prefix="t_")
    flags = {"semantic": F.col("relation").isin("parent", "stereo", "tautomer"), "long": F.length("text") > 250, "short": F.length("text") <= 150, "many_words": F.size(F.split("text", " ")) > 40, "changed": F.col("q_canonical") != F.col("t_canonical"), "decoy": F.col("relation") == "decoy"}
    s = audit.scenarios(x, flags)
    rows = [F.avg(F.coalesce(F.col(f"q_{r}") == F.col(f"t_{r}"), F.lit(False)).cast("double")).alias(f"recall_{r}") for r in ROUTES]
    return rounded(s.groupBy("scenario").agg(F.count("*").alias("n"), *rows))


O_SCENARIOS = f"""WITH {_V}, k AS (SELECT relation, text, {duck_all('text', 'q_')}, {duck_all('variant', 't_')} FROM v),
s AS (SELECT *, unnest([CASE WHEN relation IN ('parent', 'stereo', 'tautomer') THEN 'semantic' END, CASE WHEN length(text) > 250 THEN 'long' END, CASE WHEN length(text) <= 150 THEN 'short' END,
  CASE WHEN len(string_split(text, ' ')) > 40 THEN 'many_words' END, CASE WHEN q_canonical <> t_canonical THEN 'changed' END, CASE WHEN relation = 'decoy' THEN 'decoy' END]) AS scenario FROM k)
SELECT scenario, count(*) AS n, {', '.join(f'round(avg(coalesce(q_{r} = t_{r}, false)::INT::DOUBLE), 8) AS recall_{r}' for r in ROUTES)} FROM s WHERE scenario IS NOT NULL GROUP BY scenario"""


def _requests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The background, and a request for every item, relation (decoys among them), dose and repetition."""
    background = sentences(spread(table(spark, d, DOC)), "text", ["doc_id"]).select("unit").distinct()
    background = background.select(F.xxhash64("unit").alias("idx"), F.col("unit").alias("text"))
    v = _injected(spark, d).select("sample_id", "relation", F.col("variant").alias("text"), F.explode(F.array(*map(F.lit, inject.DOSES))).alias("dose"))
    v = v.withColumn("rep", F.explode(F.sequence(F.lit(0), F.col("dose") - 1)))
    return background, v.select((F.col("sample_id") * F.col("dose") + F.col("rep")).alias("request"), F.col("sample_id").cast("string").alias("sample_id"), "relation", "dose", "rep", "text")


def variant_injection(spark: SparkSession, d: str) -> DataFrame:
    """JN-23, D4, SNK-02: the manifest of replacing background sentences of the nearest free length."""
    return inject.replace_background(*_requests(spark, d)).drop("injected_text")


def certificate_rollup(spark: SparkSession, d: str) -> DataFrame:
    """AG-32: what a certificate says of a manifest."""
    return rounded(report.manifest_rollup(inject.replace_background(*_requests(spark, d))))


def decoy_pick(spark: SparkSession, d: str) -> DataFrame:
    """JN-24: for each query a sentence of the nearest length, by hash."""
    return _injected(spark, d).where("relation = 'decoy'").select("sample_id", "variant")


O_DECOYS = f"WITH {_V} SELECT item_id AS sample_id, variant FROM v WHERE relation = 'decoy'"


def _nearest(spark: SparkSession, d: str, size: int = 128) -> DataFrame:
    q, c = sentences(table(spark, d, BENCH), "text", ["item_id"]), sentences(spread(table(spark, d, DOC)), "text", ["doc_id"])
    return rounded(detect.nearest_of_all(q, c, "item_id", size))


def shingle_tanimoto_max(spark: SparkSession, d: str) -> DataFrame:
    """FN-15, FN-20, JN-09: the greatest similarity of an item's sentences with one of the documents', and how many of these share a shingle."""
    return _nearest(spark, d, 0).select("item_id", "best", "n_share")


SHINGLE = "CASE WHEN length(unit) <= 3 THEN [unit] ELSE list_distinct(list_transform(range(1, length(unit) - 1), lambda i: substr(unit, i, 3))) END"
_SETS = f"""b AS (SELECT row_number() OVER () AS bi, item_id, {SHINGLE} AS g FROM (SELECT DISTINCT item_id, unit FROM ({duck_sentences('benchmark', 'item_id')}))),
a AS (SELECT row_number() OVER () AS ai, {SHINGLE} AS g FROM (SELECT DISTINCT unit FROM ({duck_sentences('documents', 'doc_id')})))"""
O_TANIMOTO = f"""WITH {_SETS}, x AS (SELECT bi, unnest(g) AS s FROM b), y AS (SELECT ai, unnest(g) AS s FROM a), p AS (SELECT bi, ai, count(*) AS n FROM x JOIN y USING (s) GROUP BY ALL)
SELECT item_id, round(max(n / (len(b.g) + len(a.g) - n)::DOUBLE), 8) AS best, count(DISTINCT ai) AS n_share FROM p JOIN b USING (bi) JOIN a USING (ai) GROUP BY item_id"""


def minhash_max(spark: SparkSession, d: str) -> DataFrame:
    """FN-18, FN-19, JN-10: the greatest agreement of signatures of 128 places of an item's sentences with one of the documents'."""
    return _nearest(spark, d).select("item_id", F.col("best_minhash").alias("best"))


_H = lambda g: f"list_transform({g}, lambda t: (('0x' || substr(md5(t), 1, 8))::BIGINT) % 2147483647)"
_SIG = lambda h: f"list_transform(range(1, 129), lambda i: list_min(list_transform({h}, lambda v: (48271 * i * v + 11 * i) % 2147483647)))"
O_MINHASH = f"""WITH {_SETS}, bh AS (SELECT item_id, bi, {_H('g')} AS h FROM b), ah AS (SELECT ai, {_H('g')} AS h FROM a),
x AS (SELECT item_id, bi, unnest({_SIG('h')}) AS v, unnest(range(128)) AS k FROM bh), y AS (SELECT ai, unnest({_SIG('h')}) AS v, unnest(range(128)) AS k FROM ah),
p AS (SELECT item_id, bi, ai, count(*) AS n FROM x JOIN y USING (k, v) GROUP BY ALL)
SELECT item_id, round(coalesce(max(n), 0) / 128.0::DOUBLE, 8) AS best FROM (SELECT DISTINCT item_id FROM b) LEFT JOIN p USING (item_id) GROUP BY item_id"""


def nearest_sentences(spark: SparkSession, d: str) -> DataFrame:
    """FN-15, FN-18, FN-20, JN-09, JN-10: both of the above in one search."""
    return _nearest(spark, d)


def minhash_signature(spark: SparkSession, d: str) -> DataFrame:
    """FN-16, FN-18: signatures of 128 places of every distinct sentence of the benchmark."""
    q = sentences(table(spark, d, BENCH), "text", ["item_id"]).select("item_id", "unit").distinct()
    return q.select("item_id", "unit", F.array_join(minhash(shingles(F.col("unit")), 128), ",").alias("signature"))


O_SIGNATURE = f"SELECT DISTINCT item_id, unit, array_to_string({_SIG('h')}, ',') AS signature FROM (SELECT *, {_H(SHINGLE)} AS h FROM ({duck_sentences('benchmark', 'item_id')}))"


def bundle_hits(spark: SparkSession, d: str) -> DataFrame:
    """§2.11: hit rate of every method per relation over pairs of a query and its injected text."""
    pairs = _injected(spark, d)
    hits = detect.pair_hits(pairs, "text", "variant", ["sample_id", "relation"])
    return rounded(hits.groupBy("relation", "method").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("hit_rate")))


_M = {
    "raw_identity": "raw", "canonical_identity": "canonical", "parent_identity": "parent", "stereo_identity": "stereo", "tautomer_identity": "tautomer", "scaffold": "scaffold", "similarity_60": "sim >= 0.6", "similarity_70": "sim >= 0.7", "similarity_80": "sim >= 0.8", "similarity_90": "sim >= 0.9",
    "cluster": "scaffold OR sim >= 0.7", "audit_bundle": "canonical OR stereo OR scaffold OR sim >= 0.8", "curation_bundle": "canonical OR raw OR scaffold OR sim >= 0.8", "minhash_50": "agree >= 0.5", "minhash_80": "agree >= 0.8", "typed_certificate": "canonical OR parent OR stereo OR tautomer", "relation_lattice": "CASE relation WHEN 'parent' THEN parent WHEN 'stereo' THEN stereo WHEN 'tautomer' THEN tautomer ELSE canonical END", "superparent": "super",
}
_SUPER = lambda x: duck_keys(duck_keys(x)["stereo"])["tautomer"]
O_BUNDLES = f"""WITH {_V}, k AS (SELECT item_id, relation, {duck_all('text', 'q_')}, {duck_all('variant', 't_')} FROM v),
s AS (SELECT *, {SHINGLE.replace('unit', 'q_canonical')} AS qs, {SHINGLE.replace('unit', 't_canonical')} AS ts, {_SUPER('q_parent')} AS q_super, {_SUPER('t_parent')} AS t_super FROM k),
g AS (SELECT *, {_SIG(_H('qs'))} AS qh, {_SIG(_H('ts'))} AS th FROM s),
m AS (SELECT relation, {', '.join(f'coalesce(q_{r} = t_{r}, false) AS {r}' for r in (*ROUTES, 'super'))}, len(list_intersect(qs, ts)) / len(list_distinct(list_concat(qs, ts)))::DOUBLE AS sim,
  list_sum(list_transform(range(1, 129), lambda i: (qh[i] = th[i])::INT)) / 128.0::DOUBLE AS agree FROM g),
u AS (SELECT relation, unnest([{', '.join(f"{{'m': '{n}', 'h': {e}}}" for n, e in _M.items())}]) AS x FROM m)
SELECT relation, x.m AS method, count(*) AS n, round(avg(x.h::INT::DOUBLE), 8) AS hit_rate FROM u GROUP BY ALL"""


def abstention(spark: SparkSession, d: str) -> DataFrame:
    """AG-24: routes that give no key, over document lines."""
    rows = spread(table(spark, d, DOC)).select(F.explode(F.split("text", "\n")).alias("text"))
    return rounded(audit.abstention(with_keys(rows), list(ROUTES)))


O_ABSTENTION = f"""WITH k AS (SELECT {duck_all('text')} FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents)), l AS (SELECT unnest([{', '.join(f"{{'d': '{r}', 'k': {r}}}" for r in ROUTES)}]) AS x FROM k)
SELECT x.d AS route, count(*) AS n, count(*) FILTER (x.k IS NULL) AS n_abstained, round(avg((x.k IS NULL)::INT::DOUBLE), 8) AS rate FROM l GROUP BY x.d"""


def path_stability(spark: SparkSession, d: str) -> DataFrame:
    """AG-25: do routes commute, and do they change on a second pass."""
    docs = spread(table(spark, d, DOC).select("text"))
    n, t = NORMALISERS, F.col("text")
    one = {"parent_stereo": (n["stereo"](n["parent"](t)), n["parent"](n["stereo"](t))), "stereo_tautomer": (n["tautomer"](n["stereo"](t)), n["stereo"](n["tautomer"](t))), "parent_twice": (n["parent"](t), n["parent"](n["parent"](t))), "tautomer_twice": (n["tautomer"](t), n["tautomer"](n["tautomer"](t)))}
    rows = [F.struct(F.lit(k).alias("path"), (a != b).alias("differs")) for k, (a, b) in one.items()]
    x = docs.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return rounded(x.groupBy("path").agg(F.count("*").alias("n"), F.count_if("differs").alias("n_differ"), F.avg(F.coalesce(F.col("differs"), F.lit(False)).cast("double")).alias("rate")))


_K = duck_keys
O_STABILITY = f"""WITH k AS (SELECT text, {duck_all('text')} FROM documents),
x AS (SELECT unnest([{{'p': 'parent_stereo', 'd': {_K('parent')['stereo']} <> {_K('stereo')['parent']}}}, {{'p': 'stereo_tautomer', 'd': {_K('stereo')['tautomer']} <> {_K('tautomer')['stereo']}}},
 {{'p': 'parent_twice', 'd': parent <> {_K('parent')['parent']}}}, {{'p': 'tautomer_twice', 'd': tautomer <> {_K('tautomer')['tautomer']}}}]) AS x FROM k)
SELECT x.p AS path, count(*) AS n, count(*) FILTER (x.d) AS n_differ, round(avg(coalesce(x.d, false)::INT::DOUBLE), 8) AS rate FROM x GROUP BY x.p"""


def privacy_scan(spark: SparkSession, d: str) -> DataFrame:
    """FN-28: privacy patterns over documents and pages."""
    one = lambda t, c: table(spark, d, t).select(F.lit(t).alias("source_table"), *[x.alias(k) for k, x in privacy_flags(F.col(c)).items()])
    both = one(DOC, "text").unionByName(one("pages", "html"))
    return both.unpivot(["source_table"], list(PRIVACY), "pattern", "hit").groupBy("source_table", "pattern").agg(F.count_if("hit").alias("n_hits"))


O_PRIVACY = "WITH t AS (SELECT 'documents' AS s, text AS t FROM documents UNION ALL SELECT 'pages', html FROM pages) " + " UNION ALL ".join(f"SELECT s AS source_table, '{k}' AS pattern, count(*) FILTER (coalesce(regexp_matches(t, '{p}'), false)) AS n_hits FROM t GROUP BY s" for k, p in PRIVACY.items())


def page_keywords(spark: SparkSession, d: str) -> DataFrame:
    """SRC-16: keywords in raw pages."""
    return keyword_flags(table(spark, d, "pages"), ("license", "copyright", "login"))


O_KEYWORDS = "SELECT page_id, " + ", ".join(f"coalesce(contains(lower(html), '{w}'), false) AS has_{w}" for w in ("license", "copyright", "login")) + " FROM pages"


def vocabulary_counts(spark: SparkSession, d: str) -> DataFrame:
    """FN-29: characters of the benchmark by frequency."""
    return table(spark, d, BENCH).select(F.explode(F.split("text", "")).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


O_VOCABULARY = "SELECT token, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS token FROM benchmark) WHERE token <> '' GROUP BY token"


def stable_keys(spark: SparkSession, d: str) -> DataFrame:
    """FN-21, FN-22: hash keys and digests of items."""
    return table(spark, d, BENCH).select("item_id", F.round(stable_key(F.col("text"), 7), 12).alias("key"), F.sha2("text", 256).alias("digest"))


O_STABLE = f"SELECT item_id, round({HASH('text', 7)}, 12) AS key, sha256(text) AS digest FROM benchmark"


def first_records(spark: SparkSession, d: str) -> DataFrame:
    """WN-08: the first turn of each conversation."""
    return selection.first_occurrence(table(spark, d, "conversations").where("conv_id is not null"), "conv_id", "turn").select("conv_id", "turn", "role")


O_FIRST = "SELECT conv_id, turn, role FROM conversations WHERE conv_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1"


def length_cap(spark: SparkSession, d: str) -> DataFrame:
    """FLT-03: items of at most 120 characters, or all where fewer than 10 are."""
    return selection.within_length(table(spark, d, BENCH), "text", 120, 10).select("item_id")


O_CAP = "SELECT item_id FROM benchmark WHERE (SELECT count(*) FROM benchmark WHERE length(text) <= 120) < 10 OR length(text) <= 120"


def split_counts(spark: SparkSession, d: str) -> DataFrame:
    """AG-32: documents by language within each source, as text of a map."""
    m = report.counts_map(spread(table(spark, d, DOC)), "lang", "source")
    return m.select("source", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("counts"))


O_SPLIT_COUNTS = "SELECT source, string_agg(lang || '=' || n, ',' ORDER BY lang) AS counts FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source"

QUERIES = {f.__name__: (f, o) for f, o in (
    (key_index, O_KEY_INDEX), (background_hits, O_BACKGROUND), (passage_containment, O_CONTAINMENT), (exposure_by_task, O_EXPOSURE), (scaffold_split, O_SPLIT), (affected_selection, O_AFFECTED), (train_subsample, O_SUBSAMPLE),
    (draws_with_replacement, O_DRAWS), (ordered_dedup, O_DEDUP), (unseen_sentences, O_UNSEEN), (injection_recall, O_INJECTION), (claim_matrix, O_CLAIMS), (method_summary, O_METHODS), (claim_win_tie_loss, O_WTL), (scenario_summary, O_SCENARIOS),
    (variant_injection, None), (certificate_rollup, None), (decoy_pick, O_DECOYS), (shingle_tanimoto_max, O_TANIMOTO), (minhash_max, O_MINHASH), (nearest_sentences, None), (minhash_signature, O_SIGNATURE), (bundle_hits, O_BUNDLES), (abstention, O_ABSTENTION), (path_stability, O_STABILITY),
    (privacy_scan, O_PRIVACY), (page_keywords, O_KEYWORDS), (vocabulary_counts, O_VOCABULARY), (stable_keys, O_STABLE), (first_records, O_FIRST), (length_cap, O_CAP), (split_counts, O_SPLIT_COUNTS),
)}
