"""Byte-level BPE by speculation: propose tokens greedily, verify pairs, repair the rest.

A token sequence is the BPE encoding of its word exactly if every two neighbours are
what BPE makes of their joined bytes.  So each word is cut by longest match, all
neighbouring pairs of a batch are checked at once with array operations, and only the
words with a failing pair are merged step by step.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType
from tokenizers import Tokenizer

from .chunks import NEWER_LETTERS, PieceEncoder
from .common import OneByOne, in_parts, one_at_a_time


KEPT_BYTES = 48_000_000    # of kept pieces in a worker, beside the tables of the vocabulary
PLAIN = re.compile(r" ?\S+")


def byte_of_symbol() -> dict[str, int]:
    """The byte each printable symbol of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves, the other bytes in ascending
    order for the characters from 256 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in printable}
    hidden = [b for b in range(256) if b not in set(printable)]
    return table | {chr(256 + i): b for i, b in enumerate(hidden)}


class KeyTable:
    """Places of distinct keys of at least 0, for many keys at once: an open hash table in two arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.places = np.zeros(1 << bits, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free, first = np.unique(slot, return_index=True)
            first = first[self.keys[free] < 0]
            self.keys[slot[first]], self.places[slot[first]] = keys[left[first]], left[first]
            rest = self.keys[slot] != keys[left]
            left, slot = left[rest], slot[rest] + 1 & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        slot = self._slots(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.places[slot], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        slot = slot[left]
        while len(left):
            slot = slot + 1 & self.mask
            there, want = self.keys[slot], keys[left]
            hit = there == want
            out[left[hit]] = self.places[slot[hit]]
            go = ~hit & (there >= 0)
            left, slot = left[go], slot[go]
        return out


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        to_byte = byte_of_symbol()
        ids = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(pattern)
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
                                             or r"(?!)")
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in ids.items():
            if token not in self.special:
                self.bytes_of[i] = bytes(to_byte[c] for c in token)
        self.id_of = {b: i for i, b in enumerate(self.bytes_of) if b}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.arrow_bytes = pa.array(self.bytes_of, pa.large_binary())
        # made[t]: when token t is merged, -1 for single bytes; left, right: from what.
        self.made = np.full(size, -1, dtype=np.int64)
        self.left = np.arange(size)
        self.right = np.arange(size)
        self.made_by = np.zeros(len(merges), dtype=np.int64)
        self.byte_ids = np.array([self.id_of[bytes([b])] for b in range(256)], dtype=np.int64)
        keys = np.empty(len(merges), dtype=np.int64)
        for rank, (a, b) in enumerate(merges):
            x, y, z = ids[a], ids[b], ids[a + b]
            self.made_by[rank] = z
            self.made[z], self.left[z], self.right[z] = rank, x, y
            keys[rank] = x * size + y
        self.size, self.ranks = size, KeyTable(keys)
        self._build_trie()

    def _build_trie(self) -> None:
        """Edges (node, byte) -> node of all tokens, and the token that ends at a node."""
        nodes: dict[bytes, int] = {b"": 0}
        edges, ends = {}, {}
        for token, i in self.id_of.items():
            at = 0
            for n in range(1, len(token) + 1):
                nxt = nodes.setdefault(token[:n], len(nodes))
                edges[at * 256 + token[n - 1]] = nxt
                at = nxt
            ends[at] = i
        keys = np.fromiter(edges, dtype=np.int64, count=len(edges))
        self.edges = KeyTable(keys)
        self.edge_to = np.fromiter(edges.values(), dtype=np.int64, count=len(edges))
        self.token_at = np.full(len(nodes), -1, dtype=np.int64)
        self.token_at[list(ends)] = list(ends.values())

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words by longest match from the left: (tokens, number of the word of each).

        All words walk the token trie at once, a byte per step; where one cannot go on, its
        longest token so far is taken and its walk starts anew behind it.
        """
        data = np.frombuffer(b"".join(words) + b"\0", dtype=np.uint8).astype(np.int64)
        end = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        at = np.concatenate([[0], end[:-1]]) if len(words) else end
        word = np.arange(len(words))
        live = at < end
        word, at, end = word[live], at[live], end[live]
        begin, node = at.copy(), np.zeros_like(at)
        best, best_end = np.full_like(at, -1), at.copy()
        found = []
        while len(word):
            place = self.edges.find(node * 256 + data[at])
            goes = (place >= 0) & (at < end)
            node = np.where(goes, self.edge_to[place], 0)
            at = at + goes
            token = self.token_at[node]
            better = goes & (token >= 0)
            best, best_end = np.where(better, token, best), np.where(better, at, best_end)
            if not goes.all():
                stop = ~goes
                found.append((begin[stop], best[stop], word[stop]))
                begin, at = np.where(stop, best_end, begin), np.where(stop, best_end, at)
                live = at < end
                live |= goes
                word, at, end, begin, node, best, best_end = (
                    v[live] for v in (word, at, end, begin, node, best, best_end))
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        starts, tokens, owners = (np.concatenate(v) for v in zip(*found, strict=True))
        order = np.argsort(starts)
        return tokens[order], owners[order]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE keeps tokens a[i], b[i] apart, for all i at once.

        The merges of both are undone, latest first.  A pair fails if its current inner
        ends would be merged before the merge just undone; of equal merges the left one
        comes first.
        """
        fine = np.ones(len(a), dtype=bool)
        at = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(at):
            rank = self.ranks.find(a * self.size + b)
            fails = (rank >= 0) & (rank < limit)
            fine[at[fails]] = False
            made_a, made_b = self.made[a], self.made[b]
            undo_a = made_a > made_b
            limit = np.where(undo_a, made_a, made_b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            go = ~fails & ((made_a >= 0) | (made_b >= 0))
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return fine

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words by exact merging: (tokens, number of the word of each).

        In each round every word merges its earliest-ranked pair wherever it stands, from
        the left, until no word has a pair to merge.
        """
        never = len(self.made_by)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        token = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]

        def ranks(at: np.ndarray) -> np.ndarray:
            """Rank of the merge of the tokens at ``at`` and behind it."""
            after = np.minimum(at + 1, len(token) - 1)
            found = self.ranks.find(token[at] * self.size + token[after])
            return np.where((found >= 0) & (after > at) & (word[after] == word[at]), found, never)

        rank = ranks(np.arange(len(token)))
        done = []
        while len(token):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            going = lowest < never
            done.append((token[~going], word[~going]))
            hit = (rank == lowest) & going
            # Of overlapping hits (one letter repeated) every second one counts.
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(~hit, np.arange(len(hit)), -1))
            hit &= run % 2 == 1
            token = np.where(hit, self.made_by[np.where(hit, rank, 0)], token)
            keep = going & ~np.append(False, hit[:-1])
            token, word, rank, hit = token[keep], word[keep], rank[keep], hit[keep]
            # Only pairs with a new token have another rank.
            fresh = np.flatnonzero(hit | np.append(hit[1:], False))
            rank[fresh] = ranks(fresh)
        if not done:
            return token, word
        token, word = (np.concatenate(v) for v in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return token[order], word[order]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, and where each word's end: proposed, verified over the whole batch, repaired where needed."""
        token, word = self.propose(words)
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(token[inner] * self.size + token[inner + 1], return_inverse=True)
        fine = self.compatible(pairs // self.size, pairs % self.size)
        failed = np.unique(word[inner[~fine[back]]])
        if len(failed):
            wrong = np.zeros(len(words), dtype=bool)
            wrong[failed] = True
            again, owner = self.merged([words[i] for i in failed])
            token = np.concatenate([token[~wrong[word]], again])
            word = np.concatenate([word[~wrong[word]], failed[owner]])
            order = np.argsort(word, kind="stable")
            token, word = token[order], word[order]
        return token, np.cumsum(np.bincount(word, minlength=len(words)))

    def encode_pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Texts without white space but for a space in front are cut into words in one go: a
        line feed put between two of them is a word of its own.
        """
        together = "\n".join(texts)
        newer = not together.isascii() and max(together) >= NEWER_LETTERS
        special = self.special_pattern.search(together)
        plain = [t for t in texts if PLAIN.fullmatch(t) and not (newer and max(t) >= NEWER_LETTERS)
                 and not (special and self.special_pattern.search(t))]
        out = dict(zip(plain, self._encode_plain(plain), strict=True))
        if len(out) == len(texts):
            return list(out.values())
        split = {t: self._pretokens(t) for t in texts if t not in out}
        words = list({w for parts in split.values() for w in parts if isinstance(w, bytes)})
        token, ends = self.encode_words(words)
        data, ends = token.astype("<u4").tobytes(), (4 * ends).tolist()
        known: dict[bytes | int, bytes] = {w: data[a:b] for w, a, b in zip(words, [0, *ends], ends, strict=False)}
        known |= {i: np.array([i], dtype="<u4").tobytes() for i in self.special.values()}
        out |= {t: b"".join(map(known.__getitem__, parts)) for t, parts in split.items()}
        return [out[t] for t in texts]

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        line = self.pattern.findall("\n".join(texts))
        if not line:
            return []
        number = {w: i for i, w in enumerate(dict.fromkeys(line))}
        word = np.fromiter(map(number.__getitem__, line), dtype=np.int64, count=len(line))
        token, ends = self.encode_words([w.encode() for w in number])
        begin = np.concatenate([[0], ends[:-1]])
        cut = word == number.get("\n", -1)
        n = np.where(cut, 0, (ends - begin)[word])
        until = np.cumsum(n)
        data = token[np.repeat(begin[word] - until + n, n) + np.arange(until[-1])].astype("<u4").tobytes()
        stops = (4 * np.append(until[cut], until[-1])).tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def _pretokens(self, text: str) -> list[bytes | int]:
        """Words as bytes; special tokens, wherever their string stands, as ids."""
        out, at = [], 0
        for hit in self.special_pattern.finditer(text):
            out += self._words(text[at:hit.start()])
            out.append(self.special[hit.group()])
            at = hit.end()
        return out + self._words(text[at:])

    def _words(self, text: str) -> list[bytes]:
        """Pre-tokens of a text without special tokens.

        The two libraries know the letters of different Unicode versions, so characters
        beyond the old alphabets are left to the tokenizer's own rules.
        """
        if text.isascii() or max(text) < NEWER_LETTERS:
            return [w.encode() for w in self.pattern.findall(text)]
        return [text[a:b].encode() for _, (a, b) in self.library.pre_tokenize_str(text)]

    def decode(self, ids: bytes) -> str:
        found = self.arrow_bytes.take(pa.array(np.frombuffer(ids, dtype="<u4")))
        if not len(found):
            return ""
        end = np.frombuffer(found.buffers()[1], dtype=np.int64)[len(found)]
        return found.buffers()[2][:end].to_pybytes().decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str) -> PieceEncoder:
    known = vocabulary(path, pattern)
    return PieceEncoder(known.encode_pieces, KEPT_BYTES, known.special)


def encode(text: Column, path: str, pattern: str) -> Column:
    """Ids of a text as binary, four little-endian bytes each; empty for null and empty texts.

    ``path`` is a byte-level BPE file that every executor can read, ``pattern`` its
    pre-token pattern.  Texts are encoded whole at any length, once each: Spark would run
    a UDF that is no iterator again for every other UDF that takes its ids.
    """
    @F.arrow_udf(BinaryType())
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in one_at_a_time(batches):
            yield from in_parts(_encoder(path, pattern)(OneByOne(texts)), pa.binary())

    return ids(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The text of ids as ``encode`` gives them; bytes that are no UTF-8 read as U+FFFD.

    Null counts as no ids and gives an empty text.
    """
    @F.arrow_udf(StringType())
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = vocabulary(path, pattern).decode
        for column in one_at_a_time(batches):
            yield from in_parts((of(i or b"") for i in OneByOne(column)), pa.string())

    return texts(ids)
