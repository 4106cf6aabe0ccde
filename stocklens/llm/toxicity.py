"""Toxicity by a string-kernel support vector machine with Nyström landmarks.

The kernel of two word windows counts the four-letter subsequences they share, across the
words as well; each counts less the further it is spread, so letters or spaces put between
those of an insult weaken a match but do not undo it.  The machine learns from windows of
one to three words, and a document is as toxic as its worst window.

The decision of the machine is a sum over landmarks of kernel values, and each kernel
value a sum over subsequences.  Summed over the landmarks first, that is one weight per
subsequence: the same decision from one small table, whatever the number of landmarks.
Sums over the places of a text then give the decisions of all of its windows at once.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .common import PART_ROWS, OneByOne, fresh, in_parts, one_at_a_time, stored

THRESHOLD = 0.7
DECAY = 0.7
REACH = 6               # letters from the first to the last of a subsequence, at most
WIDTH = 24              # letters of a unit; longer ones are cut into overlapping units
SHORTEST = 0.1          # added to the squared length of a row, so that rows of a letter or two match nothing fully
CLASSES = 32            # 0 none, 1-26 letters, 27 between words, 28 between texts, 29-31 other alphabets
BETWEEN, APART, DROPPED = 27, 28, 255
WORDS = 3               # words of a window, at most
CHUNK = 150_000         # characters of a text at most; longer ones are cut between words
TOGETHER = 40_000       # characters of several texts worked on at once, in about 130 bytes each
NO_WORDS = -1.5         # decision for a text without words
MAX_TRAINING_DOCS = 20_000
MAX_UNITS, MAX_OTHER_UNITS, LANDMARKS = 600, 3_000, 400
SENTENCE_END = r"[.!?\n]+"
ROUNDS = 3              # fits; after each but the last the worst windows of clean texts join
MARGIN = 0.9            # from this decision on the machine was taught "toxic": there the score is THRESHOLD at least
FALSE_SHARE = 0.05      # expected share of false ones among the windows that count as toxic
BITS = 1 << 24          # size of the filter in front of the count of clean documents
EDGES = ".,;:!?\"'()[]{}<>«»„“”…"

_letters = {ord(c): chr(i) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz", 1)}


class _Classes(dict):
    """Character to letter class: other letters by number, anything else none."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = chr(29 + code % 3) if c.isalpha() else "" if unicodedata.combining(c) else "\0"
        return self[code]


CLASS_OF = _Classes(_letters)


def units(text: str | None) -> set[str]:
    """The distinct words of a text in lower case, and runs of three or more single letters as one."""
    words = (text or "").lower().split()
    found = set(words)
    if sum(len(w) == 1 for w in words) >= 3:
        run: list[str] = []
        for w in [*words, "  "]:
            if len(w.strip(EDGES)) == 1:
                run.append(w.strip(EDGES))
            else:
                if len(run) >= 3:
                    found.add(" ".join(run))
                run = []
    return found


def class_rows(unit: str) -> list[str]:
    """A window as rows of letter classes with the ends of its words marked."""
    between = chr(BETWEEN)
    words = [w for w in (w.translate(CLASS_OF).strip("\0") for w in plain(unit).split()) if w]
    if len(words) == 1 and len(words[0]) > WIDTH:
        word = words[0]
        return [between + word[s:s + WIDTH] + between for s in range(0, len(word) - WIDTH // 2, WIDTH // 2)]
    spelled = len(words) >= 3 and all(len(w) == 1 for w in words)
    return [between + ("\0" if spelled else between).join(words) + between]


def plain(text: str | None) -> str:
    text = (text or "").lower()
    return text if text.isascii() else unicodedata.normalize("NFKD", text)


@cache
def class_table() -> np.ndarray:
    """The class of every character, as ``class_rows`` has it."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for code in range(len(table)):
        c = chr(code)
        if c.isspace():
            table[code] = BETWEEN
        elif c.isalpha() or unicodedata.combining(c):
            table[code] = ord(CLASS_OF[code] or chr(DROPPED))
    return table


def parts(text: str | None) -> list[str]:
    """A text in parts of about CHUNK characters that overlap by some words."""
    text, out = text or "", []
    while len(text) > CHUNK:
        cut = max(text.rfind(" ", CHUNK // 2, CHUNK), text.rfind("\n", CHUNK // 2, CHUNK))
        cut = cut if cut > 0 else CHUNK
        out.append(text[:cut])
        back = max(text.rfind(" ", cut - 400, cut - 200), text.rfind("\n", cut - 400, cut - 200))
        text = text[back if back > 0 else cut - 200:]
    return [*out, text]


class Windows:
    """The windows of some texts, as stretches of one row of letter classes."""

    def __init__(self, texts: list[str]):
        ready = [plain(t) for t in texts]
        codes = np.frombuffer(("\n" + "\n".join(ready) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(t) + 1 for t in ready])
        row, owner = class_table()[codes], np.concatenate([[0], np.repeat(np.arange(len(ready)), sizes)])
        row[np.concatenate([[0], np.cumsum(sizes)])] = APART
        row, owner = row[row != DROPPED], owner[row != DROPPED]
        # Other characters count within words alone.
        at, full = np.arange(len(row)), row != 0
        before = row[np.maximum.accumulate(np.where(full, at, 0))]
        after = row[np.minimum.accumulate(np.where(full, at, len(row) - 1)[::-1])[::-1]]
        kept = full | ~(self.edge(before) | self.edge(after))
        row, owner = row[kept], owner[kept]
        edge = self.edge(row)
        first = edge & ~np.concatenate([[False], edge[:-1]])
        runs, firsts = np.cumsum(first) - 1, np.flatnonzero(first)
        row[firsts[runs[row == APART]]] = APART
        kept = ~edge | first
        row, owner = row[kept], owner[kept]
        # Three or more single letters are one word with gaps.
        edges = np.flatnonzero(self.edge(row))
        single = np.concatenate([[False], np.diff(edges) == 2, [False]])
        hard = row[edges] == APART
        joint = single[:-1] & single[1:] & ~hard
        near = np.concatenate([[False], joint[:-1]]) | np.concatenate([joint[1:], [False]])
        row[edges[joint & near]] = 0
        self.row, self.place = row, np.flatnonzero(row)
        self.letters = row[self.place]
        edges = np.flatnonzero(self.edge(self.letters))
        begin, end = edges[:-1], edges[1:] + 1
        if (wide := end - begin - 2 > WIDTH).any():
            cuts = [(s, min(s + WIDTH + 1, e)) for b, e in zip(begin[wide], end[wide], strict=True)
                    for s in range(b, e - 2 - WIDTH // 2, WIDTH // 2)]
            pieces = np.array(sorted([*zip(begin[~wide], end[~wide], strict=True), *cuts]))
            begin, end = pieces[:, 0], pieces[:, 1]
        self.begin, self.end = begin, end
        self.owner = owner[self.place[begin + 1]] if len(begin) else begin

    @staticmethod
    def edge(row: np.ndarray) -> np.ndarray:
        return (row == BETWEEN) | (row == APART)

    def of_size(self, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, begin, end) of the windows of so many words."""
        last = np.arange(words - 1, len(self.begin))
        first = last - words + 1
        same = self.owner[first] == self.owner[last]
        return first[same], self.begin[first[same]], self.end[last[same]]

    def rows(self) -> list[set[str]]:
        """Per text its windows as class rows."""
        text = np.where(self.row == APART, BETWEEN, self.row).astype(np.uint8).tobytes().decode("latin-1")
        found = [set() for _ in range(int(self.owner.max()) + 1 if len(self.owner) else 0)]
        for words in range(1, WORDS + 1):
            first, begin, end = self.of_size(words)
            for o, b, e in zip(self.owner[first].tolist(), self.place[begin].tolist(), self.place[end - 1].tolist(), strict=True):
                found[o].add(text[b:e + 1])
        return found

    def worst(self, weights: np.ndarray, bias: float, texts: int) -> tuple[np.ndarray, list[str]]:
        """Per text the largest decision of its windows, and the window as class row."""
        n, letters = len(self.letters), self.letters.astype(np.int32)
        letters[letters == APART] = BETWEEN
        decay = (DECAY ** np.arange(WIDTH * 4)).astype(np.float64)
        sums, squares = {}, {}
        for d in range(3, REACH + 1):
            total = np.zeros(max(0, n - d), dtype=np.float32)
            if n > d:
                for b, c in combinations(range(1, d), 2):
                    code = ((letters[:n - d] * CLASSES + letters[b:n - d + b]) * CLASSES + letters[c:n - d + c]) * CLASSES + letters[d:]
                    total += weights[code]
                weight = decay[np.minimum(self.place[d:] - self.place[:-d] + 1, len(decay) - 1)]
                sums[d] = np.concatenate([[0.0], np.cumsum(total * weight)])
                squares[d] = np.concatenate([[0.0], np.cumsum(weight * weight * math.comb(d - 1, 2))])
        best, until = np.full(len(self.begin), -np.inf), np.zeros(len(self.begin), dtype=np.int64)
        for words in range(1, WORDS + 1):
            first, begin, end = self.of_size(words)
            value, square = np.zeros(len(first)), np.full(len(first), SHORTEST)
            for d in sums:
                to = np.maximum(end - d, begin)
                to = np.minimum(to, n - d)
                to = np.maximum(to, np.minimum(begin, n - d))
                start = np.minimum(begin, n - d)
                value += sums[d][to] - sums[d][start]
                square += squares[d][to] - squares[d][start]
            value = value / np.sqrt(np.maximum(square, SHORTEST)) + bias
            more = value > best[first]
            until[first[more]] = end[more]
            best[first[more]] = value[more]
        out, rows = np.full(texts, NO_WORDS), [""] * texts
        order = np.lexsort((-best, self.owner))
        chosen = order[np.unique(self.owner[order], return_index=True)[1]] if len(order) else order
        for j in chosen:
            o = self.owner[j]
            out[o] = best[j]
            row = self.row[self.place[self.begin[j]]:self.place[until[j] - 1] + 1]
            rows[o] = np.where(row == APART, BETWEEN, row).astype(np.uint8).tobytes().decode("latin-1")
        return out, rows


def subsequences(rows: list[str]):
    """(codes, weights) of each place where a subsequence can stand, for all rows at once."""
    size = max(map(len, rows))
    grid = np.frombuffer("".join(r.ljust(size, "\0") for r in rows).encode("latin-1"), dtype=np.uint8)
    grid = grid.reshape(len(rows), size).astype(np.int32)
    place = np.argsort(grid == 0, axis=1, kind="stable")
    letters = np.take_along_axis(grid, place, axis=1)
    decay = (DECAY ** np.arange(size + 1)).astype(np.float32)
    for first in range(size - 3):
        for rest in combinations(range(first + 1, min(first + REACH + 1, size)), 3):
            last = letters[:, rest[2]]
            if not last.any():
                continue
            code = ((letters[:, first] * CLASSES + letters[:, rest[0]]) * CLASSES + letters[:, rest[1]]) * CLASSES + last
            spread = place[:, rest[2]] - place[:, first] + 1
            yield code, np.where(last > 0, decay[np.minimum(spread, size)], 0.0)


class Tables:
    """Columns of numbers over subsequences, kept only for those that some row has."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.values = np.hstack([np.zeros((len(values), 1), np.float32), values.astype(np.float32, copy=False)])
        self.index = np.zeros(CLASSES ** 4, dtype=np.int32)
        self.index[codes] = np.arange(1, len(codes) + 1)

    @classmethod
    def of_rows(cls, rows: list[str]) -> tuple[Tables, np.ndarray]:
        """The subsequence weights of each row, of length 1, and the codes they are for."""
        found = [own_weights(r) for r in rows]
        codes = np.unique(np.concatenate([c for c, _ in found]))
        values = np.zeros((len(rows), len(codes)), dtype=np.float32)
        for i, (code, weight) in enumerate(found):
            np.add.at(values[i], np.searchsorted(codes, code), weight)
        return cls(codes, values), codes

    def sums(self, rows: list[str]) -> np.ndarray:
        """Per row and table: the entries of the row's subsequences, over the row's length."""
        total = np.zeros((len(rows), len(self.values)), dtype=np.float32)
        square = np.full(len(rows), SHORTEST, dtype=np.float32)
        for code, weight in subsequences(rows):
            total += (self.values[:, self.index[code]] * weight).T
            square += weight * weight
        return total / np.sqrt(square)[:, None]


def own_weights(row: str) -> tuple[np.ndarray, np.ndarray]:
    found = [(c[0], w[0]) for c, w in subsequences([row]) if w[0] > 0]
    codes = np.array([c for c, _ in found], dtype=np.int64)
    weights = np.array([w for _, w in found], dtype=np.float32)
    return codes, weights / np.sqrt((weights ** 2).sum() + SHORTEST)


def with_insertions(row: str) -> list[str]:
    """A class row, and as it is often disguised: letters parted, one put in, one doubled, a space put in."""
    between = chr(BETWEEN)
    inner = row[1:-1]
    if between in inner:
        return [row]
    half = len(inner) // 2
    forms = [inner, "\0".join(inner), inner[:half] + "\0" + inner[half:], inner[:half] + inner[half - 1:half] + inner[half:],
             *[inner[:i] + between + inner[i:] for i in range(2, len(inner) - 1)]]
    return [between + f + between for f in forms]


def batches(texts):
    """(indexes, parts of texts) of about TOGETHER characters each, a longer part alone."""
    owners, some, size = [], [], 0
    for i, t in enumerate(texts):
        for part in parts(t):
            if some and size + len(part) > TOGETHER:
                yield owners, some
                owners, some, size = [], [], 0
            owners.append(i)
            some.append(part)
            size += len(part)
    if some:
        yield owners, some


@dataclass
class Model:
    """Weight per subsequence, bias, and the logistic scale of the document score."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 4.0
    shift: float = 0.0

    def table(self) -> Tables:
        if not hasattr(self, "_table"):
            self._table = Tables(self.codes, self.weights[None, :])
        return self._table

    def worst(self, texts) -> tuple[list[float], list[str]]:
        """Per text the largest decision of its windows, and that window as class row."""
        if not hasattr(self, "_dense"):
            self._dense = np.zeros(CLASSES ** 4, dtype=np.float32)
            self._dense[self.codes] = self.weights
        value, row = [NO_WORDS] * len(texts), [""] * len(texts)
        for owners, some in batches(texts):
            for o, v, r in zip(owners, *Windows(some).worst(self._dense, self.bias, len(some)), strict=True):
                if r and (not row[o] or v > value[o]):
                    value[o], row[o] = float(v), r
        return value, row

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in self.__dataclass_fields__}

    def decisions(self, words: list[str]) -> np.ndarray:
        """Decision per unit: above 0 toxic."""
        table = self.table()
        rows = [(i, r) for i, w in enumerate(words) for r in class_rows(w)]
        rows.sort(key=lambda x: len(x[1]))
        out = np.full(len(words), -np.inf)
        for at in range(0, len(rows), 4_096):
            part = rows[at:at + 4_096]
            owner = np.fromiter((i for i, _ in part), dtype=np.int64, count=len(part))
            np.maximum.at(out, owner, table.sums([r for _, r in part])[:, 0] + self.bias)
        return out


def fit_machine(x: np.ndarray, label: np.ndarray, importance: np.ndarray, cost: float = 2e4) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps; either class has half of the cost.

    The last column of ``x`` is 1, for the bias.
    """
    of_class = np.where(label > 0, importance[label > 0].sum(), importance[label < 0].sum())
    share = importance / of_class * cost / 2
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        margin = 1 - label * (x @ w)
        on = margin > 0
        part = x[on]
        gradient = ridge @ w - 2 * (part.T @ (share[on] * label[on] * margin[on]))
        hessian = ridge + 2 * (part.T @ (part * share[on, None]))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit_words(toxic: dict[str, float], clean: dict[str, float], landmarks: int = LANDMARKS) -> Model:
    """The machine over class rows of windows: toxic and clean ones with their importance.

    Nyström landmarks are the most important toxic windows and the first clean ones.
    """
    pos: dict[str, float] = {}
    for unit, importance in toxic.items():
        for i, row in enumerate(with_insertions(unit)):
            pos[row] = max(pos.get(row, 0.0), importance if i == 0 else importance / 4)
    neg = list(clean)
    bare = list(toxic)[:landmarks // 2]
    marks = [r for r in dict.fromkeys(bare + neg[:landmarks - len(bare)]) if len(r) >= 4]
    tables, codes = Tables.of_rows(marks)
    taken = set(neg)
    rows = [r for r in pos if r not in taken] + neg
    label = np.array([1.0] * (len(rows) - len(neg)) + [-1.0] * len(neg))
    importance = np.array([pos[r] if y > 0 else clean[r] for r, y in zip(rows, label, strict=True)])
    values, vectors = np.linalg.eigh(tables.sums(marks).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-4)) @ vectors.T
    # One array for all rows: this runs in the driver's Python.
    x = np.ones((len(rows), len(marks) + 1))
    for i in range(0, len(rows), 512):
        x[i:i + 512, :-1] = tables.sums(rows[i:i + 512]).astype(np.float64) @ root
    w, bias = fit_machine(x, label, importance)
    return Model(codes, ((root @ w) @ tables.values[:, 1:]).astype(np.float32), bias)


def fit_scale(worst: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of toxic documents over the worst decision.

    Some documents are called toxic for no window that the machine knows; their share is
    fitted along, so that they do not flatten the curve.
    """
    x = np.stack([worst, np.ones_like(worst)], axis=1)
    toxic = label > 0
    most, least = (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2)
    shown, w = np.where(toxic, 1.0, 0.0), np.zeros(2)
    for _ in range(30):
        target = np.where(toxic, shown * most, least)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + 1e-3 * np.eye(2)
            step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * w)
            w -= step
            if np.abs(step).max() < 1e-7:
                break
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        other = max(1e-3, (1 - shown)[toxic].sum()) / max(1e-9, (1 - p).sum())
        # The first time by the share of toxic documents that decide as clean ones do.
        if shown[toxic].min(initial=1.0) == 1.0:
            other = (toxic & (worst <= np.median(worst[~toxic]))).sum() / max(1, (~toxic & (worst <= np.median(worst[~toxic]))).sum())
        shown = np.where(toxic, p / np.maximum(p + (1 - p) * other, 1e-12), 0.0)
    return float(w[0]), float(w[1])


def packed(places: np.ndarray) -> bytes:
    """A filter of BITS bits with those at ``places`` set."""
    bits = np.zeros(BITS, dtype=bool)
    bits[places] = True
    return np.packbits(bits, bitorder="little").tobytes()


def in_filter(bits: bytes, row: str) -> int:
    place = zlib.crc32(row.encode()) % BITS
    return bits[place >> 3] >> (place & 7) & 1


def windows_of(text: Column, bits=None) -> Column:
    """The distinct windows of a text as class rows; with ``bits`` those that the broadcast filter has."""
    def rows_of(texts: pa.Array) -> Iterator[list[str]]:
        # Windows take some hundred times the memory of their text, so those of a few texts are held.
        for at in range(0, len(texts), PART_ROWS):
            some_texts = OneByOne(texts.slice(at, PART_ROWS))
            out = [set() for _ in range(len(some_texts))]
            for owners, some in batches(some_texts):
                for o, rows in zip(owners, Windows(some).rows(), strict=False):
                    out[o] |= rows if bits is None else {r for r in rows if in_filter(bits.value, r)}
            yield from map(list, out)

    @F.arrow_udf(ArrayType(StringType()))
    def found(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in one_at_a_time(columns):
            yield from in_parts(rows_of(texts), pa.list_(pa.string()))

    return found(text)


def worst_window(text: Column, model) -> Column:
    """Struct (worst, row): the largest decision of a text's windows and that window; ``model`` is a broadcast Model."""
    @F.arrow_udf("struct<worst: double, row: string>")
    def worst(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in one_at_a_time(columns):
            value, row = model.value.worst(OneByOne(texts))
            yield pa.StructArray.from_arrays([pa.array(value, pa.float64()), pa.array(row, pa.string())], ["worst", "row"])

    return worst(text)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def toxic_windows(sentences: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Windows that stand in toxic documents too often for chance, with their evidence.

    Of their documents as many are toxic as THRESHOLD asks of a score; windows with fewer
    are clean ones where they stand in clean documents.
    The chance that so many of a window's documents are toxic is a binomial tail; by
    Benjamini and Hochberg at most FALSE_SHARE of the windows taken are expected to be
    false, over all windows of the same number of words.  The rule is alike at every size.
    """
    share, spark = n_toxic / (n_toxic + n_clean), sentences.sparkSession
    words = F.char_length(F.regexp_replace("unit", f"[^{chr(BETWEEN)}]", "")) - 1
    all_windows = sentences.select("bad", "doc_id", F.explode(windows_of(F.col("sentence"))).alias("unit"))
    tested = {r["words"]: r["n"] for r in all_windows.groupBy(words.alias("words")).agg(
        F.approx_count_distinct("unit", 0.02).alias("n")).collect()}
    if not tested:
        return {}
    # So many documents a window needs to be taken even if no clean one has it.
    level = FALSE_SHARE / len(tested)
    least = {k: max(1, math.ceil(math.log(n / (level * min(n, MAX_UNITS))) / -math.log(share))) for k, n in tested.items()}
    needed = F.coalesce(*[F.when(words == k, F.lit(v)) for k, v in least.items()])
    bad = stored(all_windows.filter("bad").groupBy("unit").agg(F.count_distinct("doc_id").alias("bad"))
                            .filter(F.col("bad") >= needed), "toxicity-windows")
    hashed = bad.select((F.crc32(F.col("unit").cast("binary")) % BITS).alias("h")).distinct().toPandas()["h"]
    shared = spark.sparkContext.broadcast(packed(hashed.to_numpy(dtype=np.int64)))
    fine = (sentences.filter(~F.col("bad")).select("doc_id", F.explode(windows_of(F.col("sentence"), shared)).alias("unit"))
                     .groupBy("unit").agg(F.count_distinct("doc_id").alias("fine")))
    both, b, f = F.col("bad") + F.col("fine"), F.col("bad"), F.col("fine")
    evidence = b * F.log(b / (both * share)) + F.when(f > 0, f * F.log(f / (both * (1 - share)))).otherwise(0.0)
    counted = bad.join(fine, "unit", "left").fillna(0, ["fine"]).filter(b / both >= max(THRESHOLD, 3 * share / (1 + 2 * share)))
    best = counted.select("unit", "bad", "fine", evidence.alias("evidence")).orderBy(F.desc("evidence"), "unit").limit(MAX_UNITS).collect()
    taken = {}
    for k, n in tested.items():
        ranked = sorted((tail(r["bad"], r["bad"] + r["fine"], share), r["unit"], r["evidence"])
                        for r in best if r["unit"].count(chr(BETWEEN)) - 1 == k)
        last = max((i for i, r in enumerate(ranked, 1) if r[0] <= level * i / n), default=0)
        taken |= {unit: e for _, unit, e in ranked[:last] if len(unit) > 3}
    return dict(sorted(taken.items(), key=lambda x: (-x[1], x[0])))


def tail(k: int, n: int, share: float) -> float:
    """Chance of ``k`` or more of ``n`` at ``share`` each."""
    return min(1.0, sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                                 + i * math.log(share) + (n - i) * math.log1p(-share)) for i in range(k, n + 1)))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAINING_DOCS) -> Model | None:
    """A model from the labelled documents that are not held out; None without both classes.

    At most ``max_docs`` rows are taken, one for each doc_id and distinct text, those with
    the smallest hash of doc_id; rows with null label, id or text do not count.  Sentences have the label of their document,
    and equal ones count once, so copies of a document lend its words no weight.  Toxic
    windows are those of ``toxic_windows``; the others are a hash sample of the windows of
    clean sentences and the worst of them by the last fit.  All lists are bounded.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").alias("label")).dropna().dropDuplicates(["label_id"])
    # The bounded choice runs over ids and hashes of texts; texts are fetched for the chosen rows alone.
    usable = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).filter(F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = (usable.select("doc_id", "h").join(known, F.col("doc_id") == F.col("label_id")).select("label_id", "label", F.col("h").alias("label_h"))
                    .distinct().orderBy(F.xxhash64("label_id"), "label_id", "label_h").limit(max_docs))
    sample = (usable.join(chosen, (F.col("doc_id") == F.col("label_id")) & (F.col("h") == F.col("label_h")))
                    .groupBy("doc_id", "h", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label"))
    sample = stored(sample, "toxicity-sample")
    n_clean, n_toxic = (sample.agg(F.count_if(F.col("label") <= 0), F.count_if(F.col("label") > 0)).first())
    if not n_clean or not n_toxic:
        return None
    # Equal sentences stand for one document of their label.
    sentences = (sample.select((F.col("label") > 0).alias("bad"), "doc_id", F.explode(F.split("text", SENTENCE_END)).alias("sentence"))
                       .filter(F.trim("sentence") != "").groupBy("bad", "sentence").agg(F.min("doc_id").alias("doc_id")))
    sentences = stored(sentences, "toxicity-sentences")
    toxic = toxic_windows(sentences, n_toxic, n_clean)
    if not toxic:
        return None
    unlike = [t[1:-1] for t in toxic]

    def of_clean(rows) -> list[str]:
        return [r for r in rows if len(r) > 2 and not any(chr(BETWEEN) + u + chr(BETWEEN) in r for u in unlike)]

    good = sentences.filter(~F.col("bad")).select("sentence", F.xxhash64("sentence").alias("h")).orderBy("h", "sentence")
    drawn = good.limit(MAX_OTHER_UNITS).select(F.explode(windows_of(F.col("sentence"))).alias("row")).distinct()
    clean = dict.fromkeys(of_clean(r["row"] for r in drawn.orderBy(F.xxhash64("row"), "row").limit(MAX_OTHER_UNITS).collect()), 1.0)
    # A document counts as much against a window as one counts for it.
    evidence = -math.log(n_toxic / (n_toxic + n_clean))
    if not clean:
        return None
    model = fit_words(toxic, clean)
    for _ in range(ROUNDS - 1):
        shared = docs.sparkSession.sparkContext.broadcast(model)
        near = (sentences.filter(~F.col("bad")).select("doc_id", worst_window(F.col("sentence"), shared).alias("w")).groupBy("w.row")
                         .agg(F.max("w.worst").alias("worst"), F.approx_count_distinct("doc_id").alias("n"))
                         .orderBy(F.desc("worst"), "row").limit(MAX_OTHER_UNITS))
        near = {r["row"]: r["n"] * evidence for r in near.collect()}
        clean = {r: near.get(r, clean.get(r, 1.0)) for r in [*of_clean(near), *clean]}
        model = fit_words(toxic, clean)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    seen = sample.select("label", worst_window(F.col("text"), shared)["worst"].alias("worst")).toPandas()
    model.slope, model.shift = fit_scale(seen["worst"].to_numpy(), seen["label"].to_numpy())
    model.shift = max(model.shift, math.log(THRESHOLD / (1 - THRESHOLD)) - model.slope * MARGIN)
    return Model(model.codes, model.weights, model.bias, model.slope, model.shift)


def with_scores(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with a column ``toxicity``: a score from 0 to 1.

    Null and empty texts score as texts without words; without a model every score is 0.
    Repeated rows score alike.  If ``docs`` has a column ``toxicity``, the new one gets
    underscores in front.
    """
    name = fresh(docs, "toxicity")
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    worst = worst_window(F.col(text), shared)["worst"]
    return docs.withColumn(name, F.try_divide(F.lit(1.0), 1 + F.exp(-(F.lit(model.slope) * worst + F.lit(model.shift)))))
