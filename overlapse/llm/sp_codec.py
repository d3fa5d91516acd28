"""SentencePiece encoding and decoding by a shared-prefix forward pass over a trie of distinct words.

The distinct marked words (a run of spaces as marks, then other characters) of a batch are sorted, which
lays out a trie, and walked depth-first: the forward state of every prefix is kept on a stack, so words
with a common prefix share it and only new characters are worked on. What a worker has encoded is kept,
but for words of more than LONG characters.

For a unigram model the forward state is the Viterbi score of each prefix with its last piece: the greatest
sum of piece scores, the longer last piece among equals. A character of no piece counts as unknown, 10 below
the least score, and becomes its bytes. The public model is of the BPE kind, whose segmentation such a search
does not give; there the state is the last piece of the encoding of each prefix. A piece extends a prefix only
if it and the last piece there are what the merges make of the two side by side (tried once per pair and
kept); exactly one piece does for each prefix. The ids are those of the sentencepiece library; tests compare
them. Models of other kinds, and those whose pieces reach over a space, are refused.

Defined cases: null text is encoded like an empty one, to no ids; a text's own mark character U+2581 is a
space, as in the library, so decoding gives a space for it; characters outside the vocabulary are encoded
as bytes; ids of control pieces decode to nothing and bytes that form no UTF-8 to U+FFFD; texts may be of
any length; repeated rows are encoded alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlapse.llm.common import slices

MARK = "▁"
KEPT = 400_000
#: Longer words, as in text without spaces, are encoded anew each time.
LONG = 64
PAIRS = 500_000
_WORD = re.compile(r" *[^ \n]+| +|\n+")


def model_kind(model: bytes) -> str:
    """unigram, bpe, word or char: field 3 of the trainer's part (field 2) of the model file, unigram where absent."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                value |= (data[at] & 127) << shift
                shift += 7
                at += 1
                if data[at - 1] < 128:
                    return value

        while at < len(data):
            key = number()
            if key & 7 == 0:
                yield key >> 3, number()
            else:
                size = number() if key & 7 == 2 else 4 if key & 7 == 5 else 8
                yield key >> 3, data[at : at + size]
                at += size

    trainer = next((v for k, v in fields(model) if k == 2), b"")
    return {1: "unigram", 2: "bpe", 3: "word", 4: "char"}[next((v for k, v in fields(trainer) if k == 3), 1)]


class Codec:
    """Pieces are (text, score, kind), by id; kind is byte, other (control, unknown, unused) or plain."""

    def __init__(self, pieces: list[tuple[str, float, str]], kind: str):
        if kind not in ("bpe", "unigram"):
            raise ValueError(f"models of kind {kind} are not covered")
        n = len(pieces)
        self.kind = kind
        self.dtype = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")
        self.bytes_id: dict[int, int] = {}
        self.piece_id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.table: list[bytes] = []
        for i, (piece, score, of) in enumerate(pieces):
            if of == "byte":
                self.bytes_id[int(piece[3:5], 16)] = i
                self.table.append(bytes([int(piece[3:5], 16)]))
            elif of == "other":
                self.table.append(b"")
            else:
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"a piece that reaches over a space is not covered: {piece!r}")
                self.piece_id[piece] = i
                self.score[piece] = score
                self.table.append(piece.replace(MARK, " ").encode())
        if len(self.bytes_id) < 256:
            raise ValueError("models without a piece for every byte are not covered")
        self.unknown = min(self.score.values()) - 10
        self.pieces = {i: p for p, i in self.piece_id.items()}
        self.fits: dict[int, bool] = {}
        # only the pieces that their own merges make, and the lengths of those by their last character
        self.own = {p: i for p, i in self.piece_id.items() if kind == "unigram" or self.merged(p) == [p]}
        ends: dict[str, set[int]] = {}
        for p in self.own:
            ends.setdefault(p[-1], set()).add(len(p))
        self.sizes = {c: sorted(s) for c, s in ends.items()}
        self.long = {i: len(p) for p, i in self.own.items()}
        self.flat = {i: i.to_bytes(self.dtype.itemsize, "little") for i in self.own.values()}
        # ids of words met lately, in a newer and an older half
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging makes of a short text: best score first, leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether piece b can stand after piece a in an encoding; a is -1 after a character of no piece."""
        r = self.fits.get(a << 32 | b) if a >= 0 else True
        if r is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            x, y = self.pieces[a], self.pieces[b]
            r = self.fits[a << 32 | b] = self.merged(x + y) == [x, y]
        return r

    def words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """(word, ids) for distinct words, in sorted order."""
        if self.kind == "unigram":
            yield from self._viterbi(words)
            return
        last: list[int] = [-1]  # the last piece of the encoding of each prefix of the word before
        before = ""
        own, sizes, fits, follows = self.own, self.sizes, self.fits, self.follows
        for word in sorted(words):
            k, most = 0, min(len(before), len(word))
            while k < most and before[k] == word[k]:
                k += 1
            del last[k + 1 :]
            for i in range(k + 1, len(word) + 1):
                for n in sizes.get(word[i - 1], ()):
                    if n > i:
                        continue
                    at = own.get(word[i - n : i])
                    if at is None:
                        continue
                    if n < i and (a := last[i - n]) >= 0:
                        r = fits.get(a << 32 | at)
                        if not (follows(a, at) if r is None else r):
                            continue
                    last.append(at)
                    break
                else:
                    last.append(-1)
            before = word
            yield word, self._back(word, last)

    def _viterbi(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """The same by the greatest sum of scores; the scores of shared prefixes are kept."""
        best, last, before = [0.0], [-1], ""
        own, score = self.own, self.score
        # the longest first: it stays among equals
        sizes = {c: s[::-1] for c, s in self.sizes.items()}
        for word in sorted(words):
            k, most = 0, min(len(before), len(word))
            while k < most and before[k] == word[k]:
                k += 1
            del best[k + 1 :], last[k + 1 :]
            for i in range(k + 1, len(word) + 1):
                top, at = -np.inf, -1
                for n in sizes.get(word[i - 1], ()):
                    if n <= i and (piece := word[i - n : i]) in own and best[i - n] + score[piece] > top:
                        top, at = best[i - n] + score[piece], own[piece]
                if word[i - 1] not in own and best[i - 1] + self.unknown > top:
                    top, at = best[i - 1] + self.unknown, -1
                best.append(top)
                last.append(at)
            before = word
            yield word, self._back(word, last)

    def _back(self, word: str, last: list[int]) -> bytes:
        """The pieces from the end of the word back; a character of no piece stands alone, as its bytes."""
        i, parts, long, flat = len(word), [], self.long, self.flat
        while i:
            a = last[i]
            if a < 0:
                i -= 1
                parts.append(self._raw(word[i]))
            else:
                i -= long[a]
                parts.append(flat[a])
        parts.reverse()
        return b"".join(parts)

    def _raw(self, c: str) -> bytes:
        width = self.dtype.itemsize
        return b"".join(self.bytes_id[x].to_bytes(width, "little") for x in c.encode("utf-8", "replace"))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of self.dtype."""
        cut = [_WORD.findall(f" {t}".replace(MARK, " ")) if t else [] for t in texts]
        new = set().union(*cut).difference(self.known)
        # words met again move from the older half of what is kept to the newer
        again = [w for w in new if w in self.older]
        new.difference_update(again)
        if len(self.known) + len(again) + len(new) > KEPT // 2:
            keep = self.known
            self.known = {w: keep[w] for w in set().union(*cut) if w in keep}
            self.known.update((w, self.older[w]) for w in again)
            self.older = keep
        else:
            self.known.update((w, self.older[w]) for w in again)
        for word, ids in self.words([w.replace(" ", MARK) for w in new]):
            self.known[word.replace(MARK, " ")] = ids
        out = [b"".join(map(self.known.__getitem__, c)) for c in cut]
        for w in new:
            if len(w) > LONG:
                del self.known[w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.table.__getitem__, ids.tolist()))
        return text[text[:1] == b" " :].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(model: str) -> Codec:
    import sentencepiece

    with open(model, "rb") as f:
        raw = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    of = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "plain"
    return Codec([(sp.id_to_piece(i), sp.get_score(i), of(i)) for i in range(sp.get_piece_size())], model_kind(raw))


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, text (null as empty) and ids, an array of int."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            for part in slices(b, most=1 << 20):
                flat = c.encode(part.column("text").to_pylist())
                sizes = np.asarray([len(x) // c.dtype.itemsize for x in flat], np.int32)
                values = np.frombuffer(b"".join(flat), c.dtype).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), ids], names=["doc_id", "text", "ids"])

    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text string, ids array<int>")


def decoded(tokens: DataFrame, model: str) -> DataFrame:
    """tokens with the decoded text, and the CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    names = tokens.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            lists = b.column(names.index("ids"))
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            texts, crcs = [], []
            for i, j in zip(ends[:-1], ends[1:], strict=True):
                texts.append(c.decode(values[i:j]))
                crcs.append(zlib.crc32(values[i:j].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string()), pa.array(crcs, pa.int64())], names=[*names, "decoded", "ids_crc32"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(run, f"{out}, decoded string, ids_crc32 long")


def round_trips(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 and round_trip (the decoded text is the text) of every document row.

    Encodes and decodes in one pass over the texts, so no ids travel between the two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from overlapse.llm.pieces import blocks

        c = codec(model)
        for b in batches:
            for part in slices(b):
                sizes, crcs, same = [], [], []
                for texts in blocks(part.column("text").to_pylist(), 1_000_000):
                    for text, flat in zip(texts, c.encode(texts), strict=True):
                        ids = np.frombuffer(flat, c.dtype)
                        sizes.append(len(ids))
                        crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        same.append(c.decode(ids) == text.replace(MARK, " "))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_ids long, ids_crc32 long, round_trip boolean")
