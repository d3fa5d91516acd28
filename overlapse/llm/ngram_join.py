"""Jaccard join on word n-grams: MinHash banding, then checks on the full n-gram sets.

Words are runs without white space, A-Z lower-cased; a text of fewer words than n has one n-gram of all
its words. Band and row counts follow from the target recall at the threshold: the most rows a band whose
hash budget still reaches it. Rows with the same n-gram set are one class of copies, stood for by its first
row (by doc_id, nulls last, then by a hash of the text), so copies are never paired. A class is known by its
n-gram set and by a number given as the classes are written; doc_id only names rows in the result. Classes that share a band hash are put together by the components
of those meetings; within a component, blocks of bounded size meet in a grid, and each task computes the
Jaccard similarity of its block's pairs from the full sets (counted per n-gram, never listed as pairs) and
returns, for each class, how many documents it is linked to and its root in a forest over the links. So
what is moved grows with classes and blocks and no link found is left out.

Defined cases: null texts and texts without words have no n-gram set: they link to nothing, and class_id is
their own doc_id. Rows without doc_id, and rows that share one with another text, are linked by their texts as
all others are; where no row of linked ones has a doc_id, class_id is null. Repeated rows are copies, each
counted. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlapse.llm.common import WORD, connected, named, private, slices, written

N, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.995, 256
BLOCK_DOCS, BLOCK_GRAMS = 512, 500_000
#: Bytes of text that are hashed at once.
CHUNK = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15)
_K = np.uint64(0xD6E8FEB86659FD93)


def bands_and_rows(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands, at a similarity of the threshold, reach the recall in the budget."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + 1)
            inverse = np.uint64(pow(int(_P), -1, 1 << 64))
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, p, np.uint64)])) for p in (_P, inverse))
        return self.up, self.down


_POWERS = _Powers()


def gram_sets(column: pa.Array, n: int = N) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit n-gram hashes of each text of a column."""
    column = column.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + CHUNK, "right")) - 1)
        # a text longer than CHUNK stands alone here, and its words are hashed in parts
        parts = [_word_hashes(part, np.clip(ends[lo : hi + 1] - ends[lo] - start, 0, len(part))) for start, part in _cut(data[ends[lo] : ends[hi]])]
        h, places = parts[0]
        if len(parts) > 1:
            h = np.concatenate([p for p, _ in parts])
            places = np.asarray([0, len(h)])
        yield from _grams(h, places, n)
        lo = hi


def _cut(b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(start, bytes) of parts of about CHUNK bytes that end before white space."""
    lo = 0
    while len(b) - lo > CHUNK:
        hi = lo + CHUNK
        while hi < len(b):
            some = b[hi : hi + 4096]
            space = np.flatnonzero((some == 32) | ((some >= 9) & (some <= 13)))
            if len(space):
                hi += int(space[0])
                break
            hi += len(some)
        yield lo, b[lo:hi]
        lo = hi
    yield lo, b[lo:]


def _word_hashes(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and how many of them lie before each place of at."""
    b = b + ((b >= 65) & (b <= 90)).astype(np.uint8) * np.uint8(32)
    word = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.zeros(len(b) + 1, bool)
    edge[at] = True
    before, after = np.zeros(len(b), bool), np.zeros(len(b), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    stops = np.flatnonzero(word & (~after | edge[1:])) + 1
    up, down = _POWERS.upto(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    h = _mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    return h, np.searchsorted(starts, at)


def _grams(h: np.ndarray, places: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The n-gram sets of texts whose words lie between places."""
    g = none = np.empty(0, np.uint64)
    if len(h) >= n:
        g = h[: len(h) - n + 1].copy()
        for j in range(1, n):
            g = g * _K + h[j : len(h) - n + 1 + j]
        g = _mix(g)
    for a, z in zip(places[:-1], places[1:], strict=True):
        if z - a >= n:
            yield np.unique(g[a : z - n + 1])
        elif z > a:
            x = h[a : a + 1].copy()
            for j in range(a + 1, z):
                x = x * _K + h[j : j + 1]
            yield _mix(x + np.uint64(z - a))
        else:
            yield none


class Signer:
    """Band hashes of n-gram sets."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        r = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = r.integers(0, 1 << 31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = r.integers(0, 1 << 32, bands * rows, np.uint32)

    def sign(self, sets: list[np.ndarray]) -> np.ndarray:
        """(sets, bands) hashes of non-empty sets."""
        x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        out = np.empty((len(sets), self.bands), np.uint64)
        value = np.empty_like(x)
        for band in range(self.bands):
            h = np.full(len(sets), band + 1, np.uint64)
            for i in range(band * self.rows, (band + 1) * self.rows):
                np.multiply(x, self.a[i], out=value)
                value += self.b[i]
                h = _mix(h * _K + np.minimum.reduceat(value, starts))
            out[:, band] = h
        return out


def signatures(docs: DataFrame, n: int = N, bands: int = 29, rows: int = 8) -> DataFrame:
    """doc_id, name (a hash of the text), key (of the n-gram set), n_grams, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for b in batches:
            for part in slices(b, rows=64):
                sets = list(gram_sets(part.column("text"), n))
                full = [s for s in sets if len(s)]
                found = iter(signer.sign(full).view(np.int64).tolist() if full else ())
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
                made = [pa.array(keys, pa.string()), pa.array([len(s) for s in sets], pa.int64()), pa.array([next(found) if len(s) else None for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("name"), *made], names=["doc_id", "name", "key", "n_grams", "bands"])

    d = docs.select("doc_id", F.md5("text").alias("name"), "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, name string, key string, n_grams long, bands array<long>")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of the sets of two lists (or of one with itself)."""
    sets = left + (right or [])
    base, wide = (0, len(left)) if right is None else (len(left), len(right))
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(values)]]))
    out = np.zeros((len(left), wide), np.float32)
    # n-grams of few sets: their pairs one by one; of many: products of 0/1 columns
    few = (sizes > 1) & (sizes <= 12)
    for size in np.unique(sizes[few]):
        members = owner[first[few & (sizes == size)][:, None] + np.arange(size)]
        for i in range(size):
            for j in range(i + 1, size):
                x, y = members[:, i], members[:, j]
                if right is not None:
                    across = (x < base) & (y >= base)
                    x, y = x[across], y[across]
                np.add.at(out, (x, y - base), 1)
    if right is None:
        out += out.T.copy()
    many = np.flatnonzero(sizes > 12)
    for lo in range(0, len(many), 512):
        some = many[lo : lo + 512]
        m = np.zeros((len(sets), len(some)), np.float32)
        for col, i in enumerate(some):
            m[owner[first[i] : first[i] + sizes[i]], col] = 1
        out += m[: len(left)] @ m[base:].T
    if right is None:
        np.fill_diagonal(out, 0)
    return out


def _block(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(documents linked to each member, root of each member); side 0 and 1 are met with each other, side 2 with itself."""
    one, two = np.flatnonzero(side != 1), np.flatnonzero(side == 1)
    apart = not (side == 2).any()  # one side may be empty
    if not apart:
        two = one
    sizes = np.asarray([len(s) for s in sets], np.float64)
    n = shared_counts([sets[i] for i in one], [sets[i] for i in two] if apart else None)
    links = np.zeros(len(sets), np.int64)
    root = np.arange(len(sets))
    for i, common in zip(one, n, strict=True):
        near = two[common >= threshold * (sizes[i] + sizes[two] - common) - 1e-6]
        links[i] += copies[near].sum()
        if apart:
            links[near] += copies[i]
        met = root[near]
        if (met != root[i]).any():
            met = np.append(met, root[i])
            root[np.isin(root, met)] = met.min()
    return links, root


def _linked(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[DataFrame, DataFrame]:
    """(signatures, classes): key, first row, n_links of each class, and top, the first row of the classes linked to it."""
    bands, rows = bands_and_rows(threshold, recall, hashes)
    sig = written(signatures(docs, n, bands, rows), "ngram-signatures")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "name")
    heads = sig.where("key is not null").groupBy("key").agg(F.min(row).alias("first"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    # the numbers differ from run to run, but are fixed once written and are not seen in the result
    heads = written(heads.withColumn("rep", F.monotonically_increasing_id()), "ngram-classes")
    meets = heads.select("rep", F.explode("bands").alias("bucket"))
    hubs = meets.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", "hub")
    edges = meets.join(hubs, "bucket").where("rep <> hub").select("rep", "hub").distinct()
    group = connected(edges, "rep", "hub").withColumnsRenamed({"id": "rep", "label": "part"})
    members = written(group.join(heads.select("rep", "first", "n_grams", "copies"), "rep"), "ngram-members")
    blocks = members.groupBy("part").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int").alias("block")
    members = members.join(blocks, "part").select(F.col("first.doc_id").alias("of"), F.col("first.name").alias("of_name"), "rep", "part", "copies", "blocks", block)
    texts = docs.select("doc_id", F.md5("text").alias("name"), "text")
    # the plan of large inputs at every size: members grow with the input and are never broadcast
    texts = texts.join(members.hint("merge"), texts["doc_id"].eqNullSafe(F.col("of")) & (F.col("name") == F.col("of_name")))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            for part in slices(b, rows=64):
                reps = part.column("rep").to_pylist()
                new = [k for k, rep in enumerate(reps) if rep != (reps[k - 1] if k else last)]  # repeated rows lie together
                last = reps[-1]
                part = part.take(pa.array(new, pa.int64()))
                sets = pa.array([s.tobytes() for s in gram_sets(part.column("text"), n)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("rep", "part", "copies", "blocks", "block")], sets], names=["rep", "part", "copies", "blocks", "block", "grams"])

    sets = texts.select("rep", "part", "copies", "blocks", "block", "text").mapInArrow(grams, "rep long, part long, copies long, blocks int, block int, grams binary")
    grid = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
    sets = sets.withColumn("at", F.explode(grid)).select("part", "at.i", "at.j", "block", "rep", "copies", "grams")

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        ids = t.column("rep").to_pylist()
        keep = [k for k in range(len(ids)) if k == 0 or ids[k] != ids[k - 1]]  # a repeated row stands once
        t = t.take(keep)
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        block = t.column("block").to_numpy()
        side = np.where(block == i, 0, 1) if i != j else np.full(len(block), 2)
        sets = [np.frombuffer(x, np.uint64) for x in t.column("grams").to_pylist()]
        links, root = _block(sets, t.column("copies").to_numpy(), side, threshold)
        rep = t.column("rep").combine_chunks()
        return pa.table({"rep": rep, "root": rep.take(pa.array(root)), "links": pa.array(links)})

    found = written(sets.groupBy("part", "i", "j").applyInArrow(meet, "rep long, root long, links long"), "ngram-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = connected(found.where("rep <> root"), "rep", "root").withColumnsRenamed({"id": "rep"})
    tops = labels.join(heads.select("rep", "first"), "rep").groupBy("label").agg(F.min("first").alias("top"))
    heads = heads.join(links, "rep", "left").join(labels.join(tops, "label"), "rep", "left")
    heads = heads.select("key", "first", F.coalesce("top", "first").alias("top"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return sig, written(heads, "ngram-linked")


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> DataFrame:
    """doc_id, class_id (least doc_id of the linked documents), n_links (documents linked to it), n_grams, for every row."""
    sig, heads = _linked(docs, n, threshold, recall, hashes)
    out = sig.select("doc_id", "key", "n_grams").join(heads.withColumnsRenamed({"key": "of"}), F.col("key") == F.col("of"), "left")
    class_id = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_grams")


def first_of_each(docs: DataFrame, **how: float) -> DataFrame:
    """One document of each class, the first by doc_id, nulls last; rows without words all stay, columns as they came."""
    mine = private(docs)
    name, of, of_name = map(mine, ("name", "of", "of_name"))
    _, heads = _linked(docs, **how)
    keep = heads.where("first = top").select(F.col("top.doc_id").alias(of), F.col("top.name").alias(of_name))
    words = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    marked = docs.where(words).withColumn(name, F.md5("text"))
    # rows that repeat a document are copies of it; of those without doc_id each task keeps one before the shuffle
    known = marked.where("doc_id is not null").join(keep, (F.col("doc_id") == F.col(of)) & (F.col(name) == F.col(of_name))).dropDuplicates(["doc_id", name])
    other = marked.where("doc_id is null").dropDuplicates([name]).join(keep.where(F.col(of).isNull()), F.col(name) == F.col(of_name))
    kept = [d.select(*map(named, docs.columns)) for d in (known, other, docs.where(~words))]
    return kept[0].union(kept[1]).union(kept[2])


ORACLE = """
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM t),
g AS (SELECT doc_id, unnest(g) AS gram FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE n >= 0.8 * (len(x.g) + len(y.g) - n)),
r AS (WITH RECURSIVE r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a) SELECT a, min(b) AS class_id FROM r GROUP BY a)
SELECT s.doc_id, class_id, (SELECT count(*) FROM l WHERE l.a = s.doc_id)::BIGINT AS n_links, len(g)::BIGINT AS n_grams FROM s JOIN r ON r.a = s.doc_id
"""
