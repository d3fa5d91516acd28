"""Byte-level BPE through the tokenizers library, each distinct piece of text encoded once per worker.

A text is cut only where the vocabulary's pattern cuts it too: before white space that follows other
characters, around runs of plain letters, and around punctuation. An apostrophe may start a contraction,
so a piece with one reaches to the next white space. Encoding the pieces one by one therefore gives the
ids of the whole text; what a worker has encoded is kept up to KEPT pieces of at most LONG characters.

The vocabulary's added tokens, such as <|endoftext|>, are cut out first and get their own ids where a text
holds them, as in the library's plain call.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

KEPT = 500_000
#: Longer pieces, as in text without spaces, are encoded anew each time.
LONG = 64
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_CUT = re.compile(
    rf" ?[{_LETTER}]+(?=[\x00-\x26\x28-\x40\x5b-\x60\x7b-\x7f]|\Z)"  # a word; what follows is no letter and no apostrophe
    r"| ?[!-&(-/:-@\[-`{-~]+(?=[A-Za-z0-9 \n]|\Z)"  # punctuation
    r"|\n(?=\S)"
    r"|\s*\S+|\s+"
)


class Pieces:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.ids: dict[str, bytes] = {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that take in what is beside them are not covered")
        # the longest first, as one may begin another
        words = sorted((t.content for t in added), key=len, reverse=True)
        self.added = re.compile(f"({'|'.join(map(re.escape, words))})") if words else None

    def cut(self, text: str) -> list[str]:
        """The pieces of a text; put together they are the text."""
        parts = self.added.split(text) if self.added else [text]
        if len(parts) == 1:
            return _CUT.findall(text)
        return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else _CUT.findall(part))]

    def learn(self, cut: list[list[str]]) -> list[str]:
        """Encodes what the pieces of these texts have that is not known yet; returns the long ones, to be forgotten."""
        new = set().union(*cut).difference(self.ids)
        if len(self.ids) + len(new) > KEPT:
            self.ids.clear()
            new = set().union(*cut)
        new = list(new)
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            for piece, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.ids[piece] = np.asarray(e.ids, self.dtype).tobytes()
        return [p for p in new if len(p) > LONG]

    def _forget(self, pieces: list[str]) -> None:
        for p in pieces:
            del self.ids[p]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of self.dtype."""
        out: list[bytes] = []
        for some in blocks(texts):
            cut = [self.cut(t) for t in some]
            long = self.learn(cut)
            out += [b"".join(map(self.ids.__getitem__, c)) for c in cut]
            self._forget(long)
        return out

    def count(self, texts: list[str]) -> list[int]:
        """The number of ids of each text."""
        cut = [self.cut(t) for t in texts]
        long = self.learn(cut)
        size = self.dtype.itemsize
        n = [sum(map(len, map(self.ids.__getitem__, c))) // size for c in cut]
        self._forget(long)
        return n


def blocks(texts: list[str], chars: int = 4_000_000):
    """Consecutive lists of texts, each of about so many characters or one text."""
    some: list[str] = []
    n = 0
    for t in texts:
        some.append(t)
        n += len(t)
        if n >= chars:
            yield some
            some, n = [], 0
    if some:
        yield some


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)
