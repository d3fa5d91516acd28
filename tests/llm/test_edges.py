"""Names that clash, bounds on memory, kept state, pruning, held-out labels, and the pipeline against brute force."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from overlapse.llm import arrow_store, common, langid, mixing, ngram_join, pieces, pii, quality, queries, sp_codec, token_counts, topk, urls

SF = str(DATA)
BPE, PIECE = (queries.vocabulary(x) for x in (queries.BYTE_BPE, queries.PIECE_BPE))
TEXT = "one two three four five six seven eight nine ten eleven twelve more words to come in here and there a@b.org 10.0.0.1"
OWN = ("t", "o", "p", "spans", "spans_hits_email", "key", "hashes", "rate", "src", "count", "copy", "keep", "text", "order", "parts", "v_id", "gone", "id", "of", "host", "mean")


@pytest.mark.parametrize("stage", [pii.redacted, quality.cleaned, mixing.mixed, ngram_join.first_of_each])
@pytest.mark.parametrize("mark", ["__", "___", ""])
def test_own_names_leave_columns_alone(spark, stage, mark):
    names = [mark + n for n in OWN if mark or n != "text"] + ["a.b", "c`d"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    row = (1, TEXT, "s", *[f"kept {n}" for n in names])
    got = stage(spark.createDataFrame([row], schema)).collect()
    assert got and all(list(r.asDict().values())[3:] == list(row)[3:] for r in got)


def test_mixing_key_names(spark):
    d = spark.createDataFrame([(1, "x", "s", "mine")], "doc_id long, text string, source string, rate string")
    out = mixing.mixed(d, with_key=True)
    assert out.columns == ["doc_id", "text", "source", "copy", "rate", "shuffle_key"] and all(r.rate == 1.0 for r in out.collect())


def test_shared_folder_needs_a_local_master(monkeypatch):
    class Context:
        master = "spark://x:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(RuntimeError):
        common.shared_dir(Session(), "x")


def test_written_tables_are_removed(spark):
    d = spark.range(3).toDF("a")
    with common.tidied(spark, keep=1):
        common.written(d, "one")
        last = common.written(d, "two")
    assert last.count() == 3 and len([p for p in common._WRITTEN if "/one-" in p]) == 0
    before = list(common._WRITTEN)
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31)], "x long, y long")
    assert {(r.id, r.label) for r in common.connected(edges, "x", "y").collect()} == {*((i, 0) for i in range(21)), (30, 30), (31, 30)}
    assert len(common._WRITTEN) == len(before) + 1


def test_slices_go_by_bytes():
    b = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 0, 30, 2, 2, 2, 2)] + [None, "x"]})
    parts = [p.column("text").to_pylist() for p in common.slices(b, most=6, rows=3)]
    assert [t for p in parts for t in p] == b.column("text").to_pylist()
    assert all(len(p) == 1 or sum(map(len, filter(None, p))) <= 6 and len(p) <= 3 for p in parts)


def test_special_tokens_are_the_library_s(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    texts = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|>  x\n<|endoftext|><|endoftext|> y", "<|endoftext", "|>"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in arrow_store.read_store(spark, *arrow_store.write_store(d, BPE)).collect()}
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(d, BPE).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x, add_special_tokens=False).ids
        assert got[i].ids_crc32 == zlib.crc32(np.asarray([*ids, 0], "<u4").tobytes()) and counts[i] == len(ids)


def test_rows_without_id_are_held_out(spark, tmp_path):
    d = spark.createDataFrame([(None, "ein Satz", "de"), (None, None, None), (3, "a sentence", "en"), (9, "words", "en")], "doc_id long, text string, lang string")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_language_id(spark, str(tmp_path)).collect()
    assert len(got) == 4 and all(r.held_out is not None for r in got)
    assert all(r.held_out and r.lang_pred != "de" for r in got if r.doc_id is None)


def test_language_in_parts_and_many_labels(spark, monkeypatch):
    r = np.random.default_rng(1)
    d = spark.createDataFrame([(i, " ".join(r.choice(list("abcdef" if i % 2 else "uvwxyz"), 200)), "x" if i % 2 else "y") for i in range(60)] + [(100 + i, "junk", f"label{i}") for i in range(9)], "doc_id long, text string, lang string")
    net = langid.trained(d, most=2)
    assert net.langs == ["x", "y"]
    texts = ["a b c " * 4000, None, "u", "x y z " * 50, "123", "f" * 700]
    whole = langid.judge(net, texts)
    monkeypatch.setattr(langid, "STEP", 3)
    parts = langid.judge(net, texts)
    assert whole[0] == parts[0] == ["x", "und", "y", "y", "und", "x"] and np.allclose(whole[1], parts[1], atol=1e-4)


def test_long_texts_and_unspaced_text_are_bounded():
    import resource

    from pyarrow import RecordBatch

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    texts = [("w%d " % i) * 600_000 for i in range(6)]
    b = RecordBatch.from_pydict({"doc_id": list(range(6)), "text": texts})
    assert all(p.num_rows == 1 for p in common.slices(b))
    for p in common.slices(b):
        list(ngram_join.gram_sets(p.column("text")))
        langid.judge(langid.Net(["a", "b"]).tables(), p.column("text").to_pylist())
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 900_000  # KB
    c, s = pieces.Pieces(BPE), sp_codec.codec(PIECE)
    lines = ["".join(chr(0x4E00 + (7 * i + j) % 900) for j in range(3000)) for i in range(20)]
    c.encode(lines)
    s.encode(lines)
    assert not c.ids and not [w for w in s.known if len(w) > sp_codec.LONG]


def test_unigram_viterbi_against_all_segmentations():
    r = np.random.default_rng(2)
    letters = "ab▁c"
    plain = {p for n in (1, 2, 3) for p in map("".join, itertools.product("abc", repeat=n)) if n == 1 or r.random() < 0.4} | {"▁", "▁a", "▁ab", "▁▁"}
    vocabulary = [("<unk>", 0.0, "other"), *[(f"<0x{i:02X}>", 0.0, "byte") for i in range(256)], *[(p, -float(r.integers(1, 9)), "plain") for p in sorted(plain)]]
    c = sp_codec.Codec(vocabulary, "unigram")
    score = {p: s for p, s, k in vocabulary if k == "plain"}

    def best(word):
        """The greatest score of all ways to cut a word; a character of no piece costs the unknown score."""
        if not word:
            return 0.0
        return max(best(word[n:]) + s for n in range(1, min(3, len(word)) + 1) if (s := score.get(word[:n], c.unknown if n == 1 else None)) is not None)

    words = sorted({"".join(r.choice(list(letters + "é"), r.integers(1, 8))) for _ in range(300)})
    of = {i: p for i, (p, _, _) in enumerate(vocabulary)}
    for word, flat in c.words(words):
        ids = np.frombuffer(flat, c.dtype).tolist()
        assert c.decode(np.asarray(ids)).replace(" ", "▁") == word[word[:1] == "▁" :]
        total = sum(score[of[i]] if of[i] in score else 0.0 for i in ids) + c.unknown * word.count("é")
        assert math.isclose(total, best(word)), word
    with pytest.raises(ValueError):
        sp_codec.Codec(vocabulary, "word")
    with pytest.raises(ValueError):
        sp_codec.Codec([*vocabulary, ("a▁b", -1.0, "plain")], "unigram")
    assert sp_codec.model_kind(open(PIECE, "rb").read()) == "bpe" and sp_codec.model_kind(b"\x12\x02\x18\x03") == "word" and sp_codec.model_kind(b"") == "unigram"


def test_kept_trees_against_whole_encoding(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    n = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    rows = [(1, "call 12345 or 99 " * 200), (2, None), (3, ""), (4, "no digits here " * 90), (5, "123" * 700), (None, "a 1000 b"), (1, "call 12345 or 99 " * 200)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, at string")
    got = token_counts.token_counts(d, BPE, leaf=64).collect()
    want = sorted((i is None, i or 0, n(x or ""), len(re.findall("[0-9]{3,}", x or "")), n(re.sub("[0-9]{3,}", "0", x or ""))) for i, x in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_edits, r.n_tokens_after) for r in got) == want
    # one edit in a long text encodes a few leaves only, twice in turn, from what was kept
    kept = token_counts.trees(d.where("doc_id = 4"), BPE, 64)
    edits = spark.createDataFrame([(4, 500, 502, "XYZ 7"), (4, 900, 900, " in")], "doc_id long, start int, end int, put string")
    once = token_counts.apply_edits(token_counts.with_edits(kept, edits), BPE)
    twice = token_counts.apply_edits(token_counts.with_edits(once, edits), BPE).first()
    old = rows[3][1]
    new = old
    for _ in range(2):
        new = new[:500] + "XYZ 7" + new[502:900] + " in" + new[900:]
    assert twice.text == new and twice.n_tokens_after == n(new) == twice.sums[1] and 0 < twice.n_leaves_encoded <= 6 < len(twice.at) - 1
    assert token_counts.token_counts(d.where("false"), BPE).count() == 0


def _clustered(n=1500, dim=64):
    r = np.random.default_rng(1)
    centres = r.normal(0, 1, (20, 4)).repeat(dim // 4, 1)
    return [(i, (centres[i % 20] + r.normal(0, 0.05, dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("rows", "asked"), [(16384, 2048), (100, 8)])
def test_top_k_prunes(spark, rows, asked):
    v = _clustered()
    d = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    found = topk.searched(d, rows=rows, queries=asked).cache()
    pairs = 30 * 1500
    assert found.agg(F.sum("products")).first()[0] < 0.1 * pairs
    x = np.floor(np.asarray([e for _, e in v]) * 256)
    want = sorted((i, k + 1, j, -s) for i in range(0, 1500, 50) for k, (s, j) in enumerate(sorted((-int(p), j) for j, p in enumerate(x @ x[i]) if j != i)[:5]))
    assert sorted(tuple(r) for r in topk.top_k(d, rows=rows, queries=asked).collect()) == want
    if rows == 100:
        # blocks of groups that cannot reach a query's floor are not met at all
        assert found.where("query_id is null").count() < 0.5 * len({i % 20 for i in range(0, 1500, 50)}) * 15


def test_top_k_large_and_repeated_vectors(spark):
    big = [(0, [1e300, -1e300]), (50, [-1e200, 1e305]), (150, [1e308, 1.0]), (1, [1e300, 1.0]), (2, [0.5, 0.25]), (100, [2.0, 2.0]), (100, [1.0, 1.0])]
    d = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    clip = lambda n: min(max(n, -(2**63)), 2**63 - 1)
    ints = [(i, [int(np.floor(256 * a)) for a in e]) for i, e in big if i != 150]
    least = {0: ints[0][1], 50: ints[1][1], 100: ints[-1][1]}
    want = sorted((q, k + 1, j, -s) for q, a in least.items() for k, (s, j) in enumerate(sorted((-clip(a[0] * b[0] + a[1] * b[1]), j) for j, b in ints if j != q)[:5]))
    for rows in (16384, 2):
        assert sorted(tuple(r) for r in topk.top_k(d, rows=rows).collect()) == want


def test_urls_learn_from_other_hosts(spark):
    """Held-out accuracy on hosts never seen, features by hand, and repeated labels."""
    r = np.random.default_rng(3)
    junk = lambda: "".join(r.choice(list("0123456789abcdef"), 24))
    bad = [f"http://h{i}.bad{i % 40}.zz/{junk()}/{junk()}?a=1&b=2&c={junk()}" for i in range(400)]
    good = [f"http://h{i}.fine{i % 40}.yy/news/today-{'abcde'[i % 5]}" for i in range(400)]
    every = [(u, b) for us, b in ((bad, True), (good, False)) for u in us]
    held = lambda u: zlib.crc32(u.split("/")[2].encode()) % 5 == 0
    labelled = spark.createDataFrame([x for x in every if not held(x[0])] * 2 + [(None, None), ("x", None)], "url string, blocked boolean")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(every) if held(u)], "page_id long, url string")
    got = {x.page_id: x.verdict for x in urls.url_filter(pages, rules=(), labelled=labelled).collect()}
    right = [got[i] == ("block" if b else "allow") for i, (u, b) in enumerate(every) if held(u)]
    assert len(right) > 100 and np.mean(right) >= 0.95
    u = "http://www.Ex-A.org/a/b/c1?x=1&y=22#z"
    f = urls.lexical(urls._parsed(spark.createDataFrame([(1, u)], "page_id long, url string"), "page_id")).first()
    n = {c: u.lower().count(c) / len(u) for c in "abcdefghijklmnopqrstuvwxyz0123456789.-"}
    assert (f.length, f.host_length, f.path_length, f.depth, f.labels, f.hyphens, f.params, f.query_length) == (len(u), 12, 7, 3, 2, 1, 2, 11)
    assert math.isclose(f.digit_ratio, 4 / len(u)) and math.isclose(f.entropy, -sum(p * math.log2(p) for p in n.values() if p)) and (f.tld, f.domain) == ("org", "ex-a.org")
    # a rule about a path tells nothing of the suffix
    known = urls.lexical(urls._ruled(urls._parsed(spark.createDataFrame([(1, "http://example.com/de/1"), (2, "http://a.net/")], "page_id long, url string"), "page_id"), urls.RULES))
    assert {x.page_id: x.of_host for x in known.collect()} == {1: False, 2: True}


def test_common_lines_of_small_and_hot_hosts(spark, monkeypatch):
    body = lambda h, i: " ".join(f"{h}{i}x{k}" for k in range(30))
    rows = [(i, f"all rights to this page are ours\n{body('s', i)}", "small") for i in range(6)]
    rows += [(100 + i, (f"subscribe to the letter\n{body('h', i)}" if i % 40 == 0 else body("h", i)), "hot") for i in range(2000)]
    rows += [(5000 + i, (f"twice only\n{body('o', i)}" if i < 2 else body("o", i)), "other") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    removed = lambda limits: {r.source: r.n for r in quality.removed_lines(d, limits).groupBy(F.col("__from").alias("source")).agg(F.count("*").alias("n")).collect()}
    assert removed(quality.LineLimits()) == {"small": 6}
    assert removed(quality.LineLimits(max_docs=40)) == {"small": 6, "hot": 50}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    assert sp_codec.round_trips(docs, PIECE).count() == 0 and pii.personal_data(docs).count() == 0 and pii.redacted(docs).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert langid.language(docs, langid.trained(docs)).count() == 0


def _brute_quality(docs):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    normal = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).lower().strip(" ")
    hosts = {h: {t or "" for _, t, s in docs if s == h} for h in {s for *_, s in docs}}
    common = {}
    for h, texts in hosts.items():
        held = [x for t in texts for x in {normal(x) for x in t.split("\n")} - {""}]
        mean = 0.05 * len(texts)
        common[h] = {x for x in set(held) if held.count(x) > 4 and held.count(x) > mean + 2 * math.sqrt(mean)}
    out = []
    for i, t, s in docs:
        w = words(t)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
        lines = (t or "").split("\n")
        gone = sum(len(words(x)) for x in lines if normal(x) in common[s])
        if len(w) < 20 or 100 * len(covered) > 30 * len(w) or gone and (gone > 0.7 * len(w) or len(w) - gone < 5):
            continue
        out.append((i, "\n".join(x for x in lines if normal(x) not in common[s]) if gone else t, s))
    return out


def _brute_first(docs):
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t, _ in docs if (w := [x.lower() for x in t.split()]) is not None}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {k: new if v == old else v for k, v in root.items()}
    return [d for d in docs if root[d[0]] == d[0]]


def _brute_redacted(docs):
    email, ip = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
    return [(i, re.sub(ip, "[IP]", re.sub(email, "[EMAIL]", t)), s) for i, t, s in docs]


def _brute_copies(docs):
    out, names = [], {s for *_, s in docs}
    for i, t, s in docs:
        rate = len(docs) / len(names) / sum(x == s for *_, x in docs)
        u, k = int(hashlib.md5(f"17:1:{i}".encode()).hexdigest()[:13], 16) / 2**52, 0
        p = c = math.exp(-rate)
        while u >= c:
            k += 1
            p *= rate / k
            c += p
        out += [(i, t)] * k
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline

    r = np.random.default_rng(6)
    lexicon = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    body = lambda n: [str(x) for x in r.choice(lexicon, n)]
    docs = []
    for i in range(60):
        w = body(int(r.integers(25, 60)))
        docs.append((i, " ".join(w) + (f"\nmail me at u{i}@x.org or 10.0.{i}.1 now" if i % 4 == 0 else "") + ("\nThis  LINE is on most pages of the host" if i % 3 == 0 else ""), f"h{i % 3}"))
        if i % 10 == 0:
            near = list(w)
            near[0] = "changed"
            docs += [(100 + i, " ".join(w), "h1"), (200 + i, " ".join([*w, *body(120)]), "h2"), (300 + i, " ".join(near), "h2")]
    docs += [(400, "too short", "h0"), (401, "again and again and so on it goes " * 9, "h1"), (402, None, "h1")]
    spark.createDataFrame([(*d, "en", len(d[1] or "")) for d in docs], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    kept = _brute_quality(docs)
    first = _brute_first(kept)
    assert len(docs) - 3 > len(kept) - 1 > len(first) > 55 and {"changed"} & set(" ".join(t for _, t, _ in kept).split())
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = sorted((i, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())) for i, t in _brute_copies(_brute_redacted(first)) for ids in [sp.encode(t)])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id, x.n_ids, x.ids_crc32) for x in got) == want and all(x.round_trip for x in got)
