"""Cutting texts where no byte-level pre-token crosses, and encoding each distinct piece once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa

from .common import give_back

SPACES = re.compile(r"\s\s")
CUT = re.compile(r"(?<=\S)(?= \S)")
OTHER_ASCII_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
BATCH_CHARS = 3_000_000
MAX_KEPT_BYTES = 160_000_000
ENDS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NEWER_LETTERS = "\u0500"
ENTRY_BYTES = 180        # of a kept piece besides its text and ids: two objects and their places in the table


def has_runs(text: str) -> bool:
    """Whether two white-space characters stand side by side; texts of ASCII letters, spaces and line feeds are told fast."""
    if text.isascii() and not any(c in text for c in OTHER_ASCII_SPACES):
        return "  " in text or "\n\n" in text or " \n" in text or "\n " in text
    return SPACES.search(text) is not None


def pieces(text: str) -> list[str]:
    """``text`` cut before each single space and around each single line feed.

    No pre-token of the byte-level pattern holds white space after its first character,
    or before another but a space, except in runs of white space; texts with such runs
    are cut only at single spaces between two other characters.
    """
    if "\0" in text or has_runs(text):
        return CUT.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def cut_up(texts: list[str]) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The pieces of all texts, none empty, and how many of them there are up to the end of each text.

    The cuts of ``pieces`` stand at bytes, so they are found in the UTF-8 of all texts at
    once; only texts with runs of white space are cut one by one.
    """
    parts = [t.encode() for t in texts]
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    line = data == ord("\n")
    starts = line | (data == ord(" "))
    starts[1:] |= line[:-1]
    begins = np.append(0, ends[:-1])
    starts[begins[begins < ends]] = True
    for i, text in enumerate(texts):
        if "\0" in text or has_runs(text):
            sizes = [len(p.encode()) for p in pieces(text)]
            starts[begins[i]:ends[i]] = False
            starts[begins[i] + np.cumsum([0, *sizes[:-1]])] = True
    at = np.flatnonzero(starts)
    offsets = np.append(at, len(data))
    cut = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))
    return cut, np.searchsorted(at, ends)


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, each distinct piece once.

    ``encode`` maps a list of distinct pieces to their ids as bytes; ``special`` are texts
    that it takes as one token.  If they are given, a piece that ends in ASCII punctuation
    behind a letter or digit is made of what stands before that and the punctuation, as no
    pre-token holds both.

    Kept pieces are bounded by their bytes: beyond half of ``max_bytes`` they become the
    older half, from which those that are met again are taken over, and the older half
    before them is dropped, which costs time, not results.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], max_bytes: int = MAX_KEPT_BYTES,
                 special: Iterable[str] | None = None):
        self.encode, self.max_bytes = encode, max_bytes
        self.special = None if special is None else re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bytes = 0

    def _keep(self, texts: list[str], ids: list[bytes]) -> None:
        self.known.update(zip(texts, ids, strict=True))
        self.bytes += ENTRY_BYTES * len(texts) + sum(map(len, texts)) + sum(map(len, ids))

    def _not_older(self, texts: list[str]) -> list[str]:
        """Those of distinct texts that the older half does not have either; the others are taken over."""
        found = list(map(self.older.get, texts))
        again = [(t, ids) for t, ids in zip(texts, found, strict=True) if ids is not None]
        self._keep([t for t, _ in again], [ids for _, ids in again])
        return [t for t, ids in zip(texts, found, strict=True) if ids is None] if again else texts

    def _ended(self, texts: list[str]) -> dict[str, tuple[str, str]]:
        """What stands before the punctuation and the punctuation, of those pieces that are made of both."""
        out = {}
        if self.special is None:
            return out
        some_special = self.special.search("\n".join(texts))
        for text in texts:
            stem = text.rstrip(ENDS)
            if (len(stem) < len(text) and (last := stem[-1:]).isalnum() and last < NEWER_LETTERS
                    and not (some_special and self.special.search(text))):
                out[text] = stem, text[len(stem):]
        return out

    def _learn(self, texts: list[str]) -> None:
        """Make distinct pieces known that are not."""
        new = self._not_older(texts)
        ended = self._ended(new)
        whole = dict.fromkeys(filterfalse(ended.__contains__, new))
        parts = filterfalse(self.known.__contains__, dict.fromkeys(chain.from_iterable(ended.values())))
        whole |= dict.fromkeys(self._not_older(list(parts)))
        self._keep(list(whole), list(self.encode(list(whole))))
        find = self.known.__getitem__
        self._keep(list(ended), [find(stem) + find(end) for stem, end in ended.values()])

    def _batch(self, texts: list[str]) -> list[bytes]:
        if self.bytes > self.max_bytes / 2:
            self.known, self.older, self.bytes = {}, self.known, 0
        # Pieces become Python texts once a batch; Arrow numbers them and puts their ids in place.
        cut, until = cut_up(texts)
        cut = cut.dictionary_encode()
        distinct = cut.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, distinct))
        gaps = [i for i, found in enumerate(ids) if found is None]
        missing = [distinct[i] for i in gaps]
        self._learn(missing)
        for i, piece in zip(gaps, missing, strict=True):
            ids[i] = self.known[piece]
        placed = pa.array(ids, pa.large_binary()).take(cut.indices)
        data = placed.buffers()[2]
        stops = np.frombuffer(placed.buffers()[1], dtype=np.int64)[until].tolist()
        return [data[a:b].to_pybytes() for a, b in zip([0, *stops], stops, strict=False)]

    def __call__(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text, in order; null counts as empty."""
        batch, size = [], 0
        for text in texts:
            batch.append(text or "")
            size += len(batch[-1])
            if size >= BATCH_CHARS:
                yield from self._batch(batch)
                batch, size = [], 0
                give_back()
        if batch:
            yield from self._batch(batch)
