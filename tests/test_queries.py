"""Every query that has SQL against DuckDB, and invariants of those that have none."""

import pytest
from conftest import DATA, rows

from overlapse.plans import molecules, registry_audit, table_audit, text_audit

ALL = text_audit.QUERIES | table_audit.QUERIES | molecules.QUERIES | registry_audit.QUERIES


@pytest.mark.parametrize("name", [n for n, (_, o) in ALL.items() if o])
def test_against_sql(spark, duck, name):
    query, sql = ALL[name]
    got, want = query(spark, str(DATA)).toPandas(), duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_manifest_against_a_greedy_loop(spark):
    """Every dose and relation: requests in order take the nearest length that has rows left, and its next row by hash."""
    from collections import defaultdict

    from pyspark.sql import functions as F

    from overlapse.functions.scalars import stable_key
    from overlapse.operators.inject import DOSES

    m = text_audit.variant_injection(spark, str(DATA)).toPandas()
    assert len(m) == 40 * 5 * sum(DOSES) and set(m.relation) == {"exact", "parent", "stereo", "tautomer", "decoy"}
    assert (m.length_delta == m.injected_len - m.background_len).all() and set(m.groupby("dose").rep.nunique().items()) == {(x, x) for x in DOSES}
    background, asked = text_audit._requests(spark, str(DATA))
    rows = defaultdict(list)
    for r in background.select("idx", F.length("text").alias("n"), stable_key(F.col("idx"), 0).alias("k")).orderBy("k", "idx").collect():
        rows[r.n].append(r.idx)
    for (relation, dose), part in asked.toPandas().groupby(["relation", "dose"]):
        left = {n: list(x) for n, x in rows.items()}
        want = {}
        for r in part.sort_values("request").itertuples():
            n = min((x for x in left if left[x]), key=lambda x: (abs(x - len(r.text)), x))
            want[r.sample_id, r.rep] = left[n].pop(0)
        mine = m[(m.relation == relation) & (m.dose == dose)]
        assert {(s, k): i for s, k, i in zip(mine.sample_id, mine.rep, mine.background_index)} == want
    roll = text_audit.certificate_rollup(spark, str(DATA)).toPandas()
    assert len(roll) == 15 and (roll.n_records == 40 * roll.dose).all()
    for r in roll.itertuples():
        mine = m[(m.relation == r.relation) & (m.dose == r.dose)]
        assert r.n_samples == 40 and r.n_injected == mine.injected_sha256.nunique() and abs(r.mean_length_delta - mine.length_delta.mean()) < 1e-7 and r.max_abs_length_delta == mine.length_delta.abs().max()


def test_least_squares_against_numpy(spark):
    import numpy as np

    p = table_audit._paired(spark, str(DATA)).toPandas()
    got = {r.seed: r.affected_coef for r in table_audit.ols_affected(spark, str(DATA)).collect()}
    for seed, g in p.groupby("seed"):
        s = g.clean_loss.std(ddof=0) or 1.0
        x = np.stack([np.ones(len(g)), g.affected, (g.clean_loss - g.clean_loss.mean()) / s, *[(g.y == v) for v in sorted(g.y.unique())[1:]]], 1).astype(float)
        assert abs(np.linalg.lstsq(x, g.delta.to_numpy(), rcond=None)[0][1] - got[seed]) < 1e-5


def test_draws_against_loops(spark):
    """Global draws and dispersion from the cells' own draws; two levels without choice give the estimate itself."""
    import hashlib

    import numpy as np

    from overlapse.operators import effect

    draws = table_audit._cell_draws(spark, str(DATA), 50).cache()
    d = draws.toPandas()
    key = lambda x: int(hashlib.sha256(f"0:{x}".encode()).hexdigest()[:16], 16) / 2**64
    want = {}
    for i, g in d.groupby("draw"):
        v = g.sort_values("task").value.to_numpy()
        want[i] = np.mean([v[int(key(f"{i}|{j}") * len(v))] for j in range(1, len(v) + 1)])
    got = {r.draw: r.value for r in effect.global_bootstrap(draws, "task").collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    cells = spark.createDataFrame([(t, 0.001 * t) for t in sorted(d.task.unique().tolist())], "task long, value double")
    one = effect.dispersion(cells, draws, "task").first()
    wide = d.pivot(index="draw", columns="task", values="value")
    null = (wide - wide.mean()).var(axis=1, ddof=1)
    seen = np.var([0.001 * t for t in wide.columns], ddof=1)
    assert abs(one.observed - seen) < 1e-15 and abs(one.p_value - (null >= seen).mean()) < 1e-12
    rows = spark.createDataFrame([("a", 1, 1, y, a, 0.1 * k * (1 + a)) for k, (y, a) in enumerate([(0.0, True), (0.0, False), (1.0, True), (1.0, False)] * 3)], "cell string, seed int, cluster int, y double, affected boolean, delta double")
    point = effect.did_label_adjusted(rows, "y", "cell").first().did_label_adjusted
    assert all(abs(r.value - point) < 1e-12 for r in effect.two_level_bootstrap(rows, 20, 0, "cell").collect())


def test_containment_finds_passages(spark):
    assert text_audit.passage_containment(spark, str(DATA)).count() == 3


def test_resampling_is_deterministic(spark):
    a, b = (table_audit.two_level_bootstrap(spark, str(DATA)).toPandas() for _ in range(2))
    assert rows(a) == rows(b) and (a.low <= a.high).all()


def test_disjoint_pairs(spark):
    p = table_audit.disjoint_negatives(spark, str(DATA)).toPandas()
    used = [*p.a, *p.b]
    assert len(used) == len(set(used)) and ((p.a - p.b).abs() >= 3).all()


def test_same_result_in_one_partition(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        one = rows(text_audit.background_hits(spark, str(DATA)).toPandas())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == rows(text_audit.background_hits(spark, str(DATA)).toPandas())
