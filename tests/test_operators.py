"""Laws of the key families, and operators on small fixtures."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from overlapse.functions import smiles
from overlapse.functions.scalars import minhash, stable_key
from overlapse.functions.text_keys import ROUTES, shingles, with_keys
from overlapse.operators import detect, effect, inject, pairs, report
from overlapse.plans import table_audit, text_audit
from overlapse.sources import readers, writers


@pytest.mark.parametrize(("route", "a", "b"), [("canonical", "OCC", "CCO"), ("parent", "CCO.Cl", "CCO"), ("stereo", "F[C@H](Cl)Br", "F[C@@H](Cl)Br"), ("tautomer", "O=C1NC=CC=C1", "OC1=NC=CC=C1")])
def test_molecules_related(route, a, b):
    assert smiles.ROUTES[route](a) == smiles.ROUTES[route](b) is not None
    assert route == "canonical" or smiles.canonical(a) != smiles.canonical(b)


def test_molecules_abstain_and_hold():
    assert all(f("not-a-smiles") is None and f("") is None and f(None) is None for f in smiles.ROUTES.values())
    for s in ("CC(N)C(=O)O", "c1ccc2[nH]ccc2c1", "F[C@H](Cl)Br", "C1CC1C(=O)N"):
        assert smiles.canonical(smiles.canonical(s)) == smiles.canonical(s)
    assert smiles.canonical("F[C@H](Cl)Br") == smiles.canonical("Br[C@@H](Cl)F")
    assert smiles.canonical("F/C=C/F") is None and smiles.stereo("F/C=C/F")


def test_molecules_in_tables(spark):
    """The laws through the table form, abstention included; routes fail on their own."""
    rows = ["OCC", "CCO", "CCO.Cl", "F[C@H](Cl)Br", "F[C@@H](Cl)Br", "O=C1NC=CC=C1", "OC1=NC=CC=C1", "not-a-smiles", "", None, "F/C=C/F", "CCO", "C" * 230]
    k = {r.smiles: r for r in smiles.with_keys(spark.createDataFrame([(x,) for x in rows], "smiles string")).collect()}
    assert smiles.with_keys(spark.createDataFrame([(x,) for x in rows], "smiles string")).count() == len(rows)
    assert k["OCC"].canonical == k["CCO"].canonical and k["OCC"].bits == k["CCO"].bits
    assert k["CCO.Cl"].canonical != k["CCO"].canonical and k["CCO.Cl"].parent == k["CCO"].parent
    a, b = k["F[C@H](Cl)Br"], k["F[C@@H](Cl)Br"]
    assert a.canonical != b.canonical and a.stereo == b.stereo and a.identifier != b.identifier and a.identifier.split("-")[0] == b.identifier.split("-")[0]
    a, b = k["O=C1NC=CC=C1"], k["OC1=NC=CC=C1"]
    assert a.canonical != b.canonical and a.tautomer == b.tautomer and a.identifier == b.identifier
    assert all(k[x][c] is None for x in ("not-a-smiles", "", None) for c in (*smiles.KEYS, "bits"))
    # a route that fails abstains, and no other route stands in for it
    assert k["F/C=C/F"].canonical is None and k["F/C=C/F"].stereo is not None
    assert k["C" * 230].tautomer is None and k["C" * 230].canonical is not None


def test_a_failing_route_abstains_alone(monkeypatch):
    def broken(*_):
        raise ValueError

    good = smiles.canonical("C[C@H](N)O")
    monkeypatch.setattr(smiles, "parse", broken)
    assert smiles.stereo("F[C@H](Cl)I") is None and smiles.parent("CCI") is None and smiles.tautomer("CCI") is None and good


def test_fingerprints_and_graphs(spark):
    for a, b in (("OCC", "CCO"), ("c1(C)ccccc1", "Cc1ccccc1"), ("F[C@H](Cl)Br", "F[C@@H](Cl)Br")):
        assert smiles.on_bits(a) == smiles.on_bits(b)
    # methane has one environment, ethane one atom kind and one of the shared bond
    assert len(smiles.on_bits("C")) == 1 and len(smiles.on_bits("CC")) == 2
    assert set(smiles.on_bits("CCCC", radius=1)) < set(smiles.on_bits("CCCC")) or smiles.on_bits("CCCC", radius=1) == smiles.on_bits("CCCC")
    assert smiles.on_bits("x") is None and all(0 <= i < 2048 for i in smiles.on_bits("CC(=O)Oc1ccccc1C(=O)O"))
    assert smiles.graph("CCO") == (["C", "C", "O"], [(0, 1), (1, 0), (1, 2), (2, 1)]) and smiles.graph("?") == (["?"], [])
    assert smiles.formula("CCO") == "C2H6O" and smiles.formula("c1ccccc1") == "C6H6" and smiles.formula("x") is None


def test_text_keys(spark):
    d = spark.createDataFrame([(1, "  The cat,  sat "), (2, "the cat, sat"), (3, "sat cat, the"), (4, "The cat sat!\nx"), (5, "   "), (6, ""), (7, None)], "id int, text string")
    k = {r.id: r for r in with_keys(d).collect()}
    assert k[1].canonical == k[2].canonical and k[3].canonical != k[2].canonical and k[3].tautomer == k[2].tautomer
    assert k[4].parent == "the cat sat!" and k[2].stereo == "the cat sat"
    assert all(k[i][r] is None for i in (6, 7) for r in ROUTES) and k[5].canonical is None


def test_allocation_is_greedy():
    assert inject.allocate([5, 5, 5], {4: 1, 5: 1, 6: 1}) == [5, 4, 6]
    with pytest.raises(ValueError):
        inject.allocate([5, 5], {5: 1})


def test_schema_check():
    bad = {"generated_at_utc": "x", "corpora": [{"name": "", "n_lines": -1}], "more": 1}
    wrong = report.violations(bad, report.CERTIFICATE)
    assert any("has more" in w for w in wrong) and any("too short" in w for w in wrong) and any("below" in w for w in wrong) and any("lacks risk" in w for w in wrong)
    assert report.utc_stamp("2026-01-02T03:04:05Z")
    for text in ("2026-01-02T03:04:05", "2026-01-02T03:04:05+01:00"):
        with pytest.raises(ValueError):
            report.utc_stamp(text)


def test_task_reader(spark):
    d = spark.createDataFrame([(0, "CCO", "1"), (1, None, "0"), (2, "CCO", "0"), (3, "CCN", "x"), (4, "CCC", "0")], "i int, Smiles string, p_np string")
    t = readers.task(d, "bbb", ("p_np",), order="i").orderBy("sample_id").collect()
    assert [(r.sample_id, r.smiles, r.y) for r in t] == [("bbb_000000", "CCO", 1.0), ("bbb_000004", "CCC", 0.0)]
    with pytest.raises(KeyError):
        readers.resolve(["a"], ("b",))


def test_files(spark, tmp_path):
    d = spark.createDataFrame([(1, "b"), (0, "a"), (2, "c")], "idx long, text string")
    writers.lines(d, str(tmp_path / "c"))
    assert [(r.idx, r.text) for r in readers.lines(spark, str(tmp_path / "c"), 2).orderBy("idx").collect()] == [(0, "a"), (1, "b")]
    writers.metadata({"b": float("nan"), "a": 1}, str(tmp_path / "m.json"))
    assert (tmp_path / "m.json").read_text().index('"a"') < (tmp_path / "m.json").read_text().index("null")
    p = spark.createDataFrame([(1, 0.5)], "sample_id int, sample_loss double")
    p.toPandas().to_csv(tmp_path / "bbb__parent_5x__seed3.csv", index=False)
    r = readers.predictions(spark, str(tmp_path / "*.csv")).first()
    assert (r.task, r.relation, r.dose, r.seed) == ("bbb", "parent", 5, 3)


def test_certificate(spark):
    m = inject.replace_background(spark.createDataFrame([(0, "abc"), (1, "abcd")], "idx long, text string"), spark.createDataFrame([(1, "s", "exact", 1, 0, "xyz")], "request long, sample_id string, relation string, dose int, rep int, text string"))
    c = report.certificate("2026-01-02T03:04:05Z", spark.createDataFrame([("clean", 2)], "name string, n_lines long"), m, spark.createDataFrame([("train", 1)], "split string, n long"), spark.createDataFrame([("t", 0.1, 0.05)], "task string, mean double, low double"))
    assert c["risk"]["level"] == "elevated" and c["manifest"][0]["max_abs_length_delta"] == 0


def _greedy(rows, gap):
    """(a, b) over rows (id, formula) in order: each takes the next free one that differs."""
    free, out = list(rows), []
    while free:
        a = free.pop(0)
        hit = next((i for i, b in enumerate(free) if b[1] != a[1] and abs(b[0] - a[0]) >= gap), None)
        if hit is not None:
            out.append((a[0], free.pop(hit)[0]))
    return out


def test_disjoint_pairs_take_every_supplier(spark, tmp_path):
    spark.range(2500).select(F.col("id").alias("s_suppkey"), F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.lit(2)).alias("s_nationkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    got = [(r.a, r.b) for r in table_audit.disjoint_negatives(spark, str(tmp_path)).collect()]
    used = {x for p in got for x in p}
    # a third is of the rarer nation, and each of it finds a partner
    assert len(used) == 2 * len(got) and len(got) == len(range(0, 2500, 3)) and max(used) > 1000
    assert all((a % 3 > 0) != (b % 3 > 0) and abs(a - b) >= 3 for a, b in got)


def test_disjoint_pairs_in_one_block_are_the_greedy_ones(spark):
    d = spark.range(300).select("id", (F.col("id") % 4).alias("f"))
    keyed = d.withColumn("key", stable_key(F.col("id"), 0)).orderBy("key", "id").collect()
    got = {(r.a, r.b) for r in pairs.disjoint_pairs(d, "id", "f", "id", 3).collect()}
    assert got == set(_greedy([(r.id, r.f) for r in keyed], 3))


def test_nearest_sentences_see_every_sentence(spark, tmp_path):
    # the copied sentence is the first neither of its item nor of its document
    copied = "zebras graze on the wide plain at dusk"
    docs = [(1, f"aardvarks dig for ants in dry soil. {copied}. more of it follows here"), (2, "éclairs and other cakes of the old town"), (3, "Aardvarks dig for ants in dry soil")]
    items = [(7, f"about another thing altogether now. {copied}"), (8, "one xylophone makes quite enough noise"), (9, "short")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.item_id: r for r in text_audit.nearest_sentences(spark, str(tmp_path)).collect()}
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    units = lambda rows: [(k, s) for k, t in rows for s in t.lower().split(". ") if len(s) > 20]
    corpus = {u for _, u in units(docs)}
    every = sorted({u for _, u in units(items)} | corpus)
    signed = spark.createDataFrame([(u,) for u in every], "unit string").select("unit", minhash(shingles(F.col("unit")), 128).alias("s"))
    sign = {r.unit: r.s for r in signed.collect()}
    assert sorted(got) == [7, 8] and got[7].best == got[7].best_minhash == 1.0
    for k, r in got.items():
        mine = [u for x, u in units(items) if x == k]
        assert r.best == round(max(len(grams(a) & grams(b)) / len(grams(a) | grams(b)) for a in mine for b in corpus), 8)
        assert r.best_minhash == round(max(sum(x == y for x, y in zip(sign[a], sign[b], strict=True)) for a in mine for b in corpus) / 128, 8)
        assert r.n_share == sum(any(grams(a) & grams(b) for a in mine) for b in corpus)
    tasks = detect.nearest_of_all(spark.createDataFrame(units(items), "item_id long, unit string"), spark.createDataFrame(units(docs), "doc_id long, unit string"), "item_id", asked=1, block=1)
    assert {r.item_id: (round(r.best, 8), r.n_share) for r in tasks.collect()} == {k: (r.best, r.n_share) for k, r in got.items()}


def test_two_level_draws_are_the_reference_s(spark):
    assert {r.draws for r in table_audit.two_level_bootstrap(spark, str(DATA)).collect()} == {2000}
    assert table_audit.global_bootstrap(spark, str(DATA)).first().draws == 2000


def test_hashes(spark):
    import hashlib

    from overlapse.functions import hashes

    d = spark.createDataFrame([(0, "a"), (1, "é"), (-5, ""), (None, None)], "x long, t string")
    got = d.select("x", "t", hashes.split_mix(F.col("x")).alias("m"), hashes.token_number(F.col("t")).alias("n")).collect()
    unsigned = lambda v: v % 2**64
    assert unsigned(got[0].m) == 0xE220A8397B1DCDAF and got[3].m is None and got[3].n is None  # the generator's first number from 0
    assert all(unsigned(r.n) == int.from_bytes(hashlib.blake2b(r.t.encode(), digest_size=8).digest(), "big") for r in got[:3])


def test_jobs(spark, tmp_path):
    from overlapse.operators import jobs

    plan = jobs.grid(spark, ["a", "b"], ["clean", "parent_5x"], [0, 1])
    (tmp_path / "a__clean__seed0.csv").write_text("there")

    def work(task, condition, seed, path):
        if task == "b" and seed == 1:
            path.write_text("half")
            raise OSError("no room")
        path.write_text("whole")

    got = {(r.task, r.condition, r.seed): r.status for r in jobs.run(plan, work, str(tmp_path), 2).collect()}
    assert len(got) == 8 and got["a", "clean", 0] == "skipped" and got["b", "clean", 1] == "failed" and got["a", "parent_5x", 1] == "done"
    assert (tmp_path / "a__clean__seed0.csv").read_text() == "there" and not (tmp_path / "b__clean__seed1.csv").exists()
    assert jobs.heartbeat(plan, str(tmp_path), str(tmp_path / "s.json"))["finished"] == 6
    assert jobs.cpu_budget(500) == 96 and jobs.cpu_budget() >= 1 and jobs.PRESETS["quick"]["draws"] == 200
    a, b = jobs.seeded(3).random(), jobs.seeded(3).random()
    assert a == b


def test_catalogue(spark, tmp_path):
    from overlapse.sources import catalogue

    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "bbbp.csv").write_text("smiles,p_np\nOCC,1\nCCO,0\nbad,1\n,1\nCCN,\n")
    (tmp_path / "BBBP.csv").write_text("smiles,p_np\nC,1\n")
    t = {r.smiles: r for r in catalogue.load_task(spark, "bbbp", str(tmp_path)).collect()}
    assert set(t) == {"OCC", "CCO"} and t["OCC"].canonical == t["CCO"].canonical and t["CCO"].task_type == "classification"
    with pytest.raises(FileNotFoundError):
        catalogue.load_task(spark, "hiv", str(tmp_path))
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "one.csv").write_text("sample_id,smiles,canonical,task,split,y\na,OCC,CCO,t,test,1\n")
    (tmp_path / "s" / "two.csv").write_text("sample_id,smiles\nb,CCN\n")
    q = {r.sample_id: r for r in catalogue.task_queries(spark, str(tmp_path / "s")).collect()}
    assert q["a"].smiles == "CCO" and q["b"].smiles == "CCN" and q["b"].task == "two" and q["b"].split == ""
    stored = spark.createDataFrame([("a", "OCC", "CCO", "stored parent", "", "")], "sample_id string, smiles string, canonical string, parent string, stereo_stripped string, scaffold string")
    k = {r.detector: r.key for r in catalogue.stored_keys(stored).collect()}
    assert k["parent"] == "stored parent" and "stereo" not in k and k["scaffold"] and k["tautomer"]
    r = catalogue.records(spark.createDataFrame([(1, "t", "OCC"), (2, "t", "bad")], "n long, task string, text string"), "n", "task", "text").collect()
    assert len(r) == 1 and r[0].formula == "C2H6O" and r[0].bits
    (tmp_path / "p.tsv").write_text("l\tr\nOCC\tCCO\nO=C1NC=CC=C1\tOC1=NC=CC=C1\nx\tCCO\n")
    assert [tuple(x) for x in catalogue.converted_pairs(spark, str(tmp_path / "p.tsv"), "l", "r").collect()] == [("O=C1NC=CC=C1", "OC1=NC=CC=C1")]
    reg = spark.createDataFrame([(3, "C", "InChI=1S/C/t1", "K"), (1, "C", None, None), (2, None, None, "K"), (4, "N", "InChI=1S/N", "L")], "molregno long, canonical_smiles string, standard_inchi string, standard_inchi_key string")
    ids = lambda **how: [x.molregno for x in catalogue.structures(reg, **how).collect()]
    assert ids() == [1, 3, 4] and ids(need="key") == [3, 4] and ids(need="stereo") == [3] and ids(limit=2) == [1, 3]
    assert catalogue.line_count(spark, str(tmp_path / "p.tsv")) == 4


def test_random_writings():
    for s in ("CCO", "Cc1ccncc1", "OC1=NC=CC=C1", "CC(N)C(=O)O.Cl", "C1CC1C(=O)N", "c1ccc2[nH]ccc2c1"):
        forms = {smiles.random_form(s, k) for k in range(40)}
        assert {smiles.canonical(f) for f in forms} == {smiles.canonical(s)}
        assert len(forms) > 1 and smiles.random_form(s, 7) == smiles.random_form(s, 7)
    assert smiles.random_form("no molecule", 3) == "no molecule"


def test_unpack(tmp_path):
    import io
    import tarfile

    def archive(name, **member):
        with tarfile.open(tmp_path / "a.tgz", "w:gz") as t:
            i = tarfile.TarInfo(name)
            for k, v in member.items():
                setattr(i, k, v)
            i.size = 2 if i.isfile() else 0
            t.addfile(i, io.BytesIO(b"hi"))
        return writers.sha256_file(str(tmp_path / "a.tgz"))

    pin = archive("in/file.txt")
    with pytest.raises(ValueError):
        writers.unpack(str(tmp_path / "a.tgz"), "0" * 64, str(tmp_path / "out"))
    writers.unpack(str(tmp_path / "a.tgz"), pin, str(tmp_path / "out"))
    assert (tmp_path / "out" / "in" / "file.txt").read_text() == "hi"
    for name, how in (("../up", {}), ("/abs", {}), ("link", {"type": tarfile.SYMTYPE, "linkname": "x"})):
        pin = archive(name, **how)
        with pytest.raises(ValueError):
            writers.unpack(str(tmp_path / "a.tgz"), pin, str(tmp_path / "out2"))
    assert not (tmp_path / "out2").exists()


def test_cluster_bootstrap_draws(spark):
    d = spark.createDataFrame([(c, float(c), r) for c in range(11) for r in range(2)], "c int, v double, r int")
    v = [r.value for r in effect.cluster_bootstrap(d, "c", "v", 4000).collect()]
    mean = sum(v) / len(v)
    # eleven picks of 0 to 10, each with variance 10
    assert len(v) == 4000 and abs(mean - 5) < 0.06 and abs(sum((x - mean) ** 2 for x in v) / len(v) - 10 / 11) < 0.08
    assert effect.cluster_bootstrap(d.where("false"), "c", "v", 10).count() == 0


def test_cluster_bootstrap_brute_force(spark, monkeypatch):
    """Every draw, by blocks of clusters, with a null cluster (last, as in SQL) and a cluster without values; picks never meet clusters in a join."""
    import hashlib

    monkeypatch.setattr(effect, "BLOCK", 8)
    rows = [(c, None if c == 3 else float(c * c + r)) for c in [*range(20), 50] for r in range(c % 3 + 1)]
    d = spark.createDataFrame([(None if c == 50 else c, v) for c, v in rows], "c int, v double")
    order = [*range(20), 50]
    sums = [(sum(v for x, v in rows if x == c and v is not None), sum(1 for x, v in rows if x == c and v is not None)) for c in order]
    k, want = len(order), {}
    for draw in range(40):
        digests = [hashlib.sha256(f"5:{draw}|{e}".encode()).digest() for e in range((k + 7) // 8)]
        picks = [int.from_bytes(digests[i // 8][4 * (i % 8) : 4 * (i % 8) + 4], "big") * k >> 32 for i in range(k)]
        want[draw] = sum(sums[p][0] for p in picks) / sum(sums[p][1] for p in picks)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = effect.cluster_bootstrap(d, "c", "v", 40, 5)
        assert {r.draw: round(r.value, 9) for r in b.collect()} == {x: round(v, 9) for x, v in want.items()}
        assert "SortMergeJoin" not in b._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [r.value for r in effect.cluster_bootstrap(d.where("c = 3"), "c", "v", 3).collect()] == [None] * 3


def _join_rows(node):
    """Rows that the joins of an executed plan gave out, without joins of one exchange counted twice."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return _join_rows(node.executedPlan())
    if "QueryStage" in name:
        return _join_rows(node.plan())
    kids = node.children()
    own = node.metrics().apply("numOutputRows").value() if "Join" in name else 0
    return own + sum(_join_rows(kids.apply(i)) for i in range(kids.size()))


def test_banded_negatives_large_bucket(spark):
    """Few pairs of a large bucket leave the join; rows that find too little below their bound still get their targets."""
    import hashlib

    # 600 rows in reach of each other; those of kind "rare" may only meet two others
    data = [(i, "b", 100.0 + i % 30, "rare" if i % 40 == 0 else "usual") for i in range(600)] + [(None, "b", 101.0, "usual"), (700, None, 101.0, "usual"), (701, "b", None, "usual"), (702, "b", 190.0, "usual")]
    d = spark.createDataFrame(data, "id long, block string, price double, kind string")
    ok = (F.col("a.kind") == "usual") | F.col("b.id").isin(5, 6)
    key = lambda a, b: (int(hashlib.sha256(f"3:{a}|{b}".encode()).hexdigest()[:16], 16) / 2.0**64, b)
    for per in (1, 3):
        out = pairs.banded_negatives(d, "id", "block", {"price": 20.0}, ok, 3, per)
        want = []
        for a, _, p, kind in data[:600]:
            near = [b for b, _, q, _ in data[:600] if b != a and abs(p - q) <= 20 and (kind == "usual" or b in (5, 6))]
            want += [(a, b) for b in sorted(near, key=lambda b: key(a, b))[:per]]
        assert sorted(map(tuple, out.collect())) == sorted(want)
        assert _join_rows(out._jdf.queryExecution().executedPlan()) < 600 * 600 / 4
