"""Edit-aware token counts: a segment tree per document, re-encoding only what an edit touches.

A text is cut into leaves of about LEAF characters, only before white space that follows another
character; there the vocabulary's pattern always cuts, so counts of leaves add up. A tree of sums is kept
over the leaves. An edit re-encodes the leaves that it touches, and one more on a side on which the edge is
no safe cut any more, and then updates the sums above them; all other leaves keep their counts. Trees are
kept as a table beside their texts, so a later edit starts from them and not from the text.

Defined cases: null text is empty and has one leaf of no tokens; edits are taken in order of their start in
the old text, must not overlap and may be empty on either side; repeated rows are counted alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlapse.llm.common import slices, written

LEAF = 512
Edit = tuple[int, int, str]
_SAFE = re.compile(r"(?<=\S)(?=\s)")
_SPACE = re.compile(r"\s")


def leaves(text: str, size: int = LEAF) -> list[int]:
    """Where the leaves of a text start, and its end."""
    at = [0]
    while len(text) - at[-1] > size:
        m = _SAFE.search(text, at[-1] + size)
        if not m:
            break
        at.append(m.start())
    return [*at, len(text)]


class Tree:
    """Token counts of the leaves of one text, with sums over subtrees in one array."""

    def __init__(self, text: str, count: Callable[[list[str]], list[int]], size: int = LEAF):
        at = leaves(text, size)
        n = len(at) - 1
        width = 1 << max(0, (n - 1).bit_length())
        sums = [0] * (2 * width)
        sums[width : width + n] = count([text[a:b] for a, b in zip(at, at[1:])])
        for i in range(width - 1, 0, -1):
            sums[i] = sums[2 * i] + sums[2 * i + 1]
        self._take(text, count, at, sums)

    @classmethod
    def kept(cls, text: str, count: Callable[[list[str]], list[int]], at: list[int], sums: list[int]) -> Tree:
        """A tree as it was kept; nothing is encoded."""
        t = cls.__new__(cls)
        t._take(text, count, at, sums)
        return t

    def _take(self, text: str, count: Callable[[list[str]], list[int]], at: list[int], sums: list[int]) -> None:
        self.text, self.count, self.at, self.sums = text, count, at, sums
        self.width, self.encoded = len(sums) // 2, 0

    @property
    def total(self) -> int:
        return self.sums[1]

    def _set(self, leaf: int, n: int) -> None:
        i = self.width + leaf
        by = n - self.sums[i]
        while i and by:
            self.sums[i] += by
            i //= 2

    def _safe(self, text: str, at: int) -> bool:
        return at in (0, len(text)) or bool(_SPACE.match(text[at])) and not _SPACE.match(text[at - 1])

    def edit(self, edits: list[Edit]) -> None:
        """Applies edits given in places of the present text."""
        edits = sorted(edits)
        if any(a > b for a, b, _ in edits) or any(x[1] > y[0] for x, y in zip(edits, edits[1:])):
            raise ValueError("edits must not overlap")
        n, old = len(self.at) - 1, self.at
        touched: set[int] = set()
        parts, place, leaf, moved = [], 0, 0, 0
        new = list(old)
        marks: list[tuple[int, int]] = []
        for a, b, put in edits:
            parts += [self.text[place:a], put]
            place = b
            marks.append((b, len(put) - (b - a)))
        parts.append(self.text[place:])
        # the leaves that each edit reaches, and how far it moves later starts
        for a, b, put in edits:
            while leaf < n - 1 and old[leaf + 1] < a:
                leaf += 1
            k = leaf
            while k < n and (old[k] <= b):
                if old[k + 1] >= a:
                    touched.add(k)
                k += 1
        k = 0
        for i in range(1, n):
            while k < len(marks) and marks[k][0] <= old[i]:
                moved += marks[k][1]
                k += 1
            cut = next(((a, b, put) for a, b, put in edits[k : k + 1] if a < old[i] < b), None)
            # a start inside what goes away moves to where that began
            new[i] = moved + (cut[0] if cut else old[i])
        self.text = "".join(parts)
        new[n] = len(self.text)
        self.at = new
        if not touched:
            return
        # runs of touched leaves, wider where an edge is no safe cut
        runs: list[list[int]] = []
        for i in sorted(touched):
            if runs and i <= runs[-1][1] + 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        wide: list[list[int]] = []
        for lo, hi in runs:
            while lo > 0 and not self._safe(self.text, new[lo]):
                lo -= 1
            while hi < n - 1 and not self._safe(self.text, new[hi + 1]):
                hi += 1
            if wide and lo <= wide[-1][1] + 1:
                wide[-1] = [min(lo, wide[-1][0]), max(hi, wide[-1][1])]
            else:
                wide.append([lo, hi])
        # a run keeps its leaves where they can be counted apart; else the first of them takes all
        for lo, hi in wide:
            groups: list[list[int]] = [[lo, lo]]
            for i in range(lo + 1, hi + 1):
                if new[i] > new[groups[-1][0]] and self._safe(self.text, new[i]):
                    groups.append([i, i])
                else:
                    groups[-1][1] = i
            counted = self.count([self.text[new[a] : new[b + 1]] for a, b in groups])
            self.encoded += hi - lo + 1
            for (a, b), c in zip(groups, counted, strict=True):
                self._set(a, c)
                for i in range(a + 1, b + 1):
                    self._set(i, 0)


NUMBER = re.compile(r"[0-9]{3,}")


def masked_numbers(text: str) -> list[Edit]:
    """An edit for each run of three digits or more: 0 stands in its place."""
    return [(m.start(), m.end(), "0") for m in NUMBER.finditer(text)]


TREES = "doc_id {}, text string, at array<int>, sums array<int>"


def trees(docs: DataFrame, tokenizer: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, text, at, sums): the tree of every document row, to be written and kept.

    `at` holds where the leaves start and the end of the text, `sums` the counts of the subtrees, the root at
    place 1 and the leaves in the second half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from overlapse.llm.pieces import pieces

        coder = pieces(tokenizer)
        for b in batches:
            for part in slices(b):
                made = [Tree(t, coder.count, leaf) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), *[pa.array(x, pa.list_(pa.int32())) for x in ([t.at for t in made], [t.sums for t in made])]], names=["doc_id", "text", "at", "sums"])

    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInArrow(run, TREES.format(d.schema["doc_id"].dataType.simpleString()))


def with_edits(kept: DataFrame, edits: DataFrame) -> DataFrame:
    """Kept trees with a column `edits`, from a table (doc_id, start, end, put) of edits of their texts."""
    one = edits.groupBy(F.col("doc_id").alias("__id")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "put"))).alias("edits"))
    return kept.join(one, F.col("doc_id") == F.col("__id"), "left").drop("__id")


def apply_edits(kept: DataFrame, tokenizer: str, edits_of: Callable[[str], list[Edit]] | None = None) -> DataFrame:
    """Kept trees after edits: of their column `edits`, or those that edits_of gives for a text.

    Only the leaves that edits touch are encoded. Returns doc_id, text, at and sums, again to be kept, with
    n_tokens (before), n_edits, n_tokens_after and n_leaves_encoded.
    """
    given = "edits" in kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from overlapse.llm.pieces import pieces

        coder = pieces(tokenizer)
        for b in batches:
            for part in slices(b):
                made, numbers = [], []
                lists = [part.column(c).to_pylist() for c in ("text", "at", "sums")]
                asked = part.column("edits").to_pylist() if given else [None] * part.num_rows
                for text, at, sums, put in zip(*lists, asked, strict=True):
                    t = Tree.kept(text, coder.count, at, sums)
                    before = t.total
                    edits = [(e["start"], e["end"], e["put"]) for e in put or ()] if given else edits_of(text)
                    if edits:
                        t.edit(edits)
                    made.append(t)
                    numbers.append((before, len(edits), t.total, t.encoded))
                arrays = [pa.array([t.text for t in made], pa.string()), *[pa.array(x, pa.list_(pa.int32())) for x in ([t.at for t in made], [t.sums for t in made])], *[pa.array(c, pa.int64()) for c in zip(*numbers, strict=True)]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=["doc_id", "text", "at", "sums", "n_tokens", "n_edits", "n_tokens_after", "n_leaves_encoded"])

    columns = ["doc_id", "text", "at", "sums", *(["edits"] if given else [])]
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.select(*columns).mapInArrow(run, TREES.format(kind) + ", n_tokens long, n_edits long, n_tokens_after long, n_leaves_encoded long")


def token_counts(docs: DataFrame, tokenizer: str, edits_of: Callable[[str], list[Edit]] = masked_numbers, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, n_leaves, n_edits, n_tokens_after, n_leaves_encoded (again) of every document row.

    The trees are written to the shared folder; the edits are then applied to the trees as they were kept.
    """
    kept = written(trees(docs, tokenizer, leaf), "token-trees")
    done = apply_edits(kept, tokenizer, edits_of)
    return done.select("doc_id", "n_tokens", (F.size("at") - 1).cast("long").alias("n_leaves"), "n_edits", "n_tokens_after", "n_leaves_encoded")
