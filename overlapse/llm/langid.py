"""Language identification by a byte convolutional network, trained in numpy on labelled text.

Windows of WINDOW bytes go through an embedding, convolutions of several widths, max pooling over the
window and a softmax. Training takes windows at hashed places of at most SAMPLE labelled documents of each
of the LANGS most frequent languages, least hash first among those below a share of the hashes that holds
twice as many on average. For prediction the embedding and the filters are folded into tables over byte
pairs and single bytes, which give the same convolutions by look-up; every window of the whole text counts
by its letters, and the mean log-probability decides.

Defined cases: a text that is null or has no letter is `und` with score 0; so is every text where no
labelled one is given; with one language every text with a letter gets it; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from overlapse.llm.common import slices, written

WINDOW = 128
SAMPLE = 1500
#: The languages that are learned, those with most documents first.
LANGS = 128
#: The greatest key of a document.
KEYS = (1 << 63) - 1
WIDTHS = (2, 3, 4)
FILTERS = 8
DIM = 6


class Net:
    """Weights and the forward pass; bytes below are 0 to 255, padding is byte 0."""

    def __init__(self, langs: list[str], seed: int = 3):
        r = np.random.default_rng(seed)
        self.langs = langs
        self.w = {"e": r.normal(0, 0.5, (256, DIM)).astype(np.float32), "o": r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32), "b": np.zeros(len(langs), np.float32)}
        for k in WIDTHS:
            self.w[f"f{k}"] = r.normal(0, 1 / np.sqrt(k * DIM), (k, DIM, FILTERS)).astype(np.float32)
            self.w[f"c{k}"] = np.zeros(FILTERS, np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, size: int = 64, rate: float = 0.01, seed: int = 4) -> Net:
        """x: windows of bytes, y: numbers of languages. Adam on the cross-entropy."""
        r, w = np.random.default_rng(seed), self.w
        m, v, t = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for lo in range(0, len(x), size):
                some = order[lo : lo + size]
                b, n = x[some], len(some)
                e = w["e"][b]
                pooled, kept = [], []
                for k in WIDTHS:
                    span = b.shape[1] - k + 1
                    a = sum(e[:, j : j + span] @ w[f"f{k}"][j] for j in range(k)) + w[f"c{k}"]
                    at = a.argmax(1)
                    top = np.take_along_axis(a, at[:, None], 1)[:, 0]
                    pooled.append(np.maximum(top, 0))
                    kept.append((at, top > 0))
                h = np.concatenate(pooled, 1)
                z = h @ w["o"] + w["b"]
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(n), y[some]] -= 1
                p /= n
                g = {"o": h.T @ p, "b": p.sum(0), "e": np.zeros_like(w["e"])}
                dh = p @ w["o"].T
                rows = np.arange(n)[:, None]
                for i, k in enumerate(WIDTHS):
                    at, on = kept[i]
                    d = dh[:, i * FILTERS : (i + 1) * FILTERS] * on
                    g[f"c{k}"], g[f"f{k}"] = d.sum(0), np.zeros_like(w[f"f{k}"])
                    for j in range(k):
                        byte = b[rows, at + j]  # of the winning place of each filter
                        g[f"f{k}"][j] = np.einsum("nfd,nf->df", w["e"][byte], d)
                        np.add.at(g["e"], byte, d[:, :, None] * w[f"f{k}"][j].T)
                t += 1
                for k in w:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def tables(self) -> Net:
        """Folds embedding and filters into what a pair of bytes, or a byte, adds at each offset."""
        e, self.pairs, self.single = self.w["e"], {}, {}
        for k in WIDTHS:
            one = [e @ self.w[f"f{k}"][j] for j in range(k)]
            for j in range(0, k - 1, 2):
                self.pairs[k, j] = (one[j][:, None] + one[j + 1][None]).reshape(-1, FILTERS) + (self.w[f"c{k}"] if j == 0 else 0)
            if k % 2:
                self.single[k] = one[k - 1]
        return self

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """For windows of bytes (n, WINDOW)."""
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        pooled = []
        for k in WIDTHS:
            span = x.shape[1] - k + 1
            a = self.pairs[k, 0].take(pair[:, :span], 0)
            for j in range(2, k - 1, 2):
                a += self.pairs[k, j].take(pair[:, j : j + span], 0)
            if k % 2:
                a += self.single[k].take(x[:, k - 1 : k - 1 + span], 0)
            pooled.append(np.maximum(a.max(1), 0))
        z = np.concatenate(pooled, 1) @ self.w["o"] + self.w["b"]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def _windows(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    n = max(1, -(-len(b) // WINDOW))
    if len(b) < n * WINDOW:
        b = np.concatenate([b, np.zeros(n * WINDOW - len(b), np.uint8)])
    return b.reshape(n, WINDOW)


#: Bytes of letters: ASCII letters, and lead bytes of two and more bytes (one for each such character).
_LETTERS = np.zeros(256, np.float32)
_LETTERS[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = 1


#: Windows worked on at once.
STEP = 256


def judge(net: Net, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language and score of each text; what is held at once beside the texts is one text and STEP windows."""
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    todo = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if net.langs else []
    sums, total = np.zeros((len(texts), max(1, len(net.langs)))), np.zeros(len(texts))

    def add(x: np.ndarray, owner: np.ndarray) -> None:
        weight = _LETTERS[x].sum(1) + 1e-3
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        sums[owner[first]] += np.add.reduceat(net.log_probs(x) * weight[:, None], first)
        total[owner[first]] += np.add.reduceat(weight, first)

    held, owners, n = [], [], 0
    for i in todo:
        w = _windows(texts[i].encode("utf-8", "replace"))
        for lo in range(0, len(w), STEP):
            held.append(w[lo : lo + STEP])
            owners.append(np.full(len(held[-1]), i))
            n += len(held[-1])
            if n >= STEP:
                add(np.concatenate(held), np.concatenate(owners))
                held, owners, n = [], [], 0
    if n:
        add(np.concatenate(held), np.concatenate(owners))
    if todo:
        mean = sums[todo] / total[todo][:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for i, best, row in zip(todo, p.argmax(1), p, strict=True):
            langs[i], scores[i] = net.langs[best], float(min(1.0, row[best]))
    return langs, scores


def trained(labelled: DataFrame, sample: int = SAMPLE, windows: int = 4, most: int = LANGS) -> Net:
    """A network from (doc_id, text, lang); `sample` bounds the documents of each language that are taken, `most` the languages."""
    d = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    key = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit("langid")), 1)
    # pieces at hashed places of the text, not its beginning
    cut = lambda i: F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(F.lit(1), F.length("text") - WINDOW).cast("long")) + 1).cast("int"), F.lit(WINDOW))
    d = d.select("lang", "doc_id", key.alias("key"), F.array(*[cut(i) for i in range(windows)]).alias("cuts"))
    # a share of each language's keys that holds twice the sample on average, so what is sorted and collected
    # does not grow with the documents or their partitions, nor with labels that are no languages
    sizes = {r["lang"]: r["count"] for r in d.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()}
    langs = sorted(sizes)
    if not langs:
        return Net(langs).tables()
    share = F.create_map(*[F.lit(v) for name in langs for v in (name, min(KEYS, KEYS * 2 * sample // sizes[name]))])
    few = written(d.where(F.col("key") <= F.element_at(share, F.col("lang"))), "langid-sample")
    least = Window.partitionBy("lang").orderBy("key", "doc_id", "cuts")
    rows = few.withColumn("at", F.row_number().over(least)).where(F.col("at") <= sample).orderBy("lang", "at").select("lang", "cuts").collect()
    x = [(np.frombuffer(c.encode("utf-8", "replace")[:WINDOW].ljust(WINDOW, b"\0"), np.uint8), langs.index(r["lang"])) for r in rows for c in r["cuts"] if any(map(str.isalpha, c))]
    net = Net(langs)
    if len(langs) > 1:
        net.fit(np.stack([a for a, _ in x]), np.array([b for _, b in x]))
    return net.tables()


def language(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, lang_pred and score of every document row, from its text alone."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(net)  # a few megabytes, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                langs, scores = judge(sent.value, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    d = docs.select("doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
