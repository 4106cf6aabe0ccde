"""Periodic runs in word sequences by descending-LCP Kruskal.

Suffixes of a text are sorted and neighbours are united from the longest common prefix
(LCP) down.  A class of suffixes that share a prefix is an ordered set of positions; when
two classes meet, positions that become neighbours in the merged set share exactly the LCP
of the moment.  Neighbours at a distance within it make a stretch whose period is the
distance: were there a smaller period, a position between them would already be in the
class.  A stretch that the word before it does not extend is a run, found just once.

Only prefixes as long as the shortest run's overlap matter, so texts without a repeated
window of that many words, most of them, are done after one vectorised look.  Texts of a
batch are sorted together: words are numbered apart for each text, so no class spans two.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_LENGTH = 24          # words of a run, at least
MIN_PERIODS = 3          # periods of a run, at least
BATCH_CHARS = 1_000_000
RESULT = "runs array<struct<start: long, length: long, period: long>>, collapsed string, n_words long"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeating_texts(codes: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the texts in which the hash of some ``width`` words stands twice.

    Equal windows have equal hashes, so no text with a repeated window is missed.
    """
    if len(codes) < width:
        return np.zeros(0, dtype=text.dtype)
    hashes = _mixed(codes.astype(np.uint64) + np.uint64(1))
    total = np.zeros(len(codes) - width + 1, dtype=np.uint64)
    have, done = 1, 0
    while done < width:                       # width as a sum of powers of two, largest hashes built by doubling
        if width & have:
            total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[done:done + len(total)])
            done += have
        if done < width:
            hashes = _mixed(hashes[:-have] * np.uint64(0xA0761D6478BD642F) + hashes[have:])
            have *= 2
    first = text[:len(total)]
    inside = first == text[width - 1:]
    keys = _mixed(total[inside] ^ _mixed(first[inside].astype(np.uint64)))
    order = np.argsort(keys)
    again = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    return np.unique(first[inside][order[again]])


def neighbours(codes: np.ndarray, text: np.ndarray, least: int) -> tuple[list[int], list[int], list[int]]:
    """(LCP, suffix, next suffix in order) of neighbours that share ``least`` words or more, longest first."""
    n = len(codes)
    ends = np.searchsorted(text, text, side="right")
    place = np.arange(n)
    _, ranks = np.unique(text.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)
    levels, width = [ranks.astype(np.int32)], 1
    while True:
        inside = place + width < ends
        key = ranks.astype(np.int64) * (n + 1)
        key[inside] += ranks[place[inside] + width] + 1
        kinds, ranks = np.unique(key, return_inverse=True)
        if len(kinds) == n:
            break
        width *= 2
        levels.append(ranks.astype(np.int32))
    order = np.empty(n, dtype=np.int64)
    order[ranks] = place
    a, b = order[:-1], order[1:]
    lcp = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + lcp, b + lcp
        both = np.flatnonzero((i < ends[a]) & (j < ends[b]))
        same = both[levels[k][i[both]] == levels[k][j[both]]]
        lcp[same] += 1 << k
    long = np.flatnonzero(lcp >= least)
    long = long[np.argsort(-lcp[long], kind="stable")]
    return lcp[long].tolist(), a[long].tolist(), b[long].tolist()


def seeds(lcps: list[int], left: list[int], right: list[int], min_length: int, min_periods: int) -> Iterator[tuple[int, int, int]]:
    """(start, period, LCP) where positions that become neighbours repeat often enough, by merging classes."""
    home: dict[int, list[int]] = {}
    for lcp, a, b in zip(lcps, left, right, strict=True):
        large, small = home.get(a) or home.setdefault(a, [a]), home.get(b) or home.setdefault(b, [b])
        if len(large) < len(small):
            large, small = small, large
        if len(small) * 16 > len(large):
            large += small
            large.sort()
        else:
            for p in small:
                insort(large, p)
        for p in small:
            home[p] = large
        most = min(lcp // (min_periods - 1), max(large[-1] - large[0], 0))
        before = None
        for x, p in enumerate(small):
            at = bisect_left(large, p)
            if at and (q := large[at - 1]) != before and p - q <= most and p - q + lcp >= min_length:
                yield q, p - q, lcp
            after = small[x + 1] if x + 1 < len(small) else None
            if at + 1 < len(large) and (q := large[at + 1]) != after and q - p <= most and q - p + lcp >= min_length:
                yield p, q - p, lcp
            before = p


def find_runs(sequences: list[np.ndarray], min_length: int = MIN_LENGTH,
              min_periods: int = MIN_PERIODS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each sequence of word numbers, by start and period.

    A run is a longest stretch with smallest period q that holds at least ``min_length``
    words and ``min_periods`` (two or more) times q.
    """
    least = max(1, math.ceil(min_length * (min_periods - 1) / min_periods))
    out: list[list[tuple[int, int, int]]] = [[] for _ in sequences]
    if not sequences:
        return out
    codes = np.concatenate(sequences)
    text = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
    hit = repeating_texts(codes, text, least)
    if not len(hit):
        return out
    chosen = np.isin(text, hit)
    codes, text = codes[chosen], text[chosen]
    starts = np.searchsorted(text, hit)
    at, owner, words = starts.tolist(), hit.tolist(), codes.tolist()
    for start, period, lcp in seeds(*neighbours(codes, text, least), min_length, min_periods):
        x = bisect_left(at, start + 1) - 1
        if start == at[x] or words[start - 1] != words[start - 1 + period]:
            out[owner[x]].append((start - at[x], period + lcp, period))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that any run holds after its first period."""
    if runs:
        change = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


def _batches(texts: pd.Series) -> Iterator[list[str]]:
    batch, size = [], 0
    for text in texts:
        batch.append(text or "")
        size += len(batch[-1])
        if size >= BATCH_CHARS:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def periodic_runs(text: Column, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> Column:
    """struct(runs array of (start, length, period), collapsed text, n_words) of a text column.

    Words are what stands between ASCII white space, numbered from 0; runs are ordered by
    start and period.  The collapsed text has the words outside runs and each run's first
    period, joined by one space.  Null and empty texts have no words, no runs and an empty
    collapsed text.  A text is worked on as a whole, in about 100 bytes for each of its
    words where a passage repeats; equal texts have equal results.
    """
    @F.pandas_udf(RESULT)
    def udf(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for batch in _batches(texts):
            words = [t.encode("utf-8", "surrogatepass").split() for t in batch]
            number = _Numbers().__getitem__
            found = find_runs([np.fromiter(map(number, w), dtype=np.int64, count=len(w)) for w in words],
                              min_length, min_periods)
            rows += [([{"start": s, "length": n, "period": q} for s, n, q in runs],
                      _collapsed(w, runs).decode("utf-8", "surrogatepass"), len(w))
                     for w, runs in zip(words, found, strict=True)]
        return pd.DataFrame(rows, columns=["runs", "collapsed", "n_words"])

    return udf(text)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, of equal ones the first; null if there is none."""
    def better(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)
    return F.aggregate(runs, F.get(runs, F.size(runs)), better)


def runs_text(runs: Column) -> Column:
    """A line ``start,length,period`` for each run."""
    line = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return F.array_join(F.transform(line, lambda t: F.concat(t, F.lit("\n"))), "")
