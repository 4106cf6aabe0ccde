"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is a weighted set of five-word shingles.  Hashed darts fall into the region
below the weight of each element; the same dart falls for every set that has the
element, so the earliest dart of a coordinate is a weighted MinHash value, and a set
needs about as many darts as it has coordinates, however heavy it is.

Documents that agree in a band of coordinates are candidates.  Copies of one shingle set
are one node.  A node is first compared with the hub that shares most buckets with others,
then with the hubs of its other buckets while their classes differ.  What is left are
buckets of several classes, which are not paired out: two sets that are alike enough share
one of the rarest elements of either, early enough in the order by rarity for the rest to
reach the threshold.  That bound is exact, and only pairs within it are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import OneByOne, fresh, in_parts, one_at_a_time, stored

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5      # two documents of similarity 0.8 share no band once in 14,000 times
EXTRA_DARTS = 3.0        # a coordinate stays empty, and darts are thrown again, for 5 % of the sets
FINEST = 12              # rank intervals get no shorter than 2 ** -FINEST
KEPT_WORDS = 60_000


# --- shingles and darts (inside tasks) --------------------------------------------

class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct five-word shingle hashes of a text, ascending, and how often each occurs.

    Fewer than five words are one shingle; no words are none.
    """
    if len(_words) > KEPT_WORDS:
        _words.clear()
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    hashes = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(SHINGLE, len(words))
    total = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for i in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + mixed(hashes[i:len(words) - width + 1 + i])
    return np.unique(mixed(total), return_counts=True)


def _poisson(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Poisson numbers of mean 1 at most from uniform numbers."""
    term = np.exp(-mean)
    below, n = term.copy(), np.zeros(len(u), dtype=np.int64)
    for i in range(1, 20):
        over = u > below
        if not over.any():
            break
        n += over
        term = term * mean / i
        below += term
    return n


def darts(elements: np.ndarray, weights: np.ndarray, until: float):
    """(dart, rank) of all darts below ``until`` under the weights of the elements.

    Weight is cut into unit intervals and rank into intervals that double up to 1 and are
    of length 1 from there; each cell of an element has a Poisson number of darts that
    depends on the cell alone.
    """
    edges = [0.0, *(2.0 ** -j for j in range(FINEST, -1, -1))]
    low = np.array([e for e in edges[:-1] if e < until] + list(range(1, int(np.ceil(until)))))
    high = np.array([*edges[1:], *range(2, int(np.ceil(until)) + 1)], dtype=float)[:len(low)]
    layers = np.ceil(weights).astype(np.int64)
    element = np.repeat(np.arange(len(elements)), layers)
    layer = np.arange(len(element)) - np.repeat(np.cumsum(layers) - layers, layers)
    salt = mixed(np.arange(1, len(low) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    base = mixed(elements[element] + layer.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    cell = mixed(base[:, None] ^ salt[None, :]).ravel()
    size = np.tile(high - low, len(element))
    n = _poisson(uniform(cell), size)
    hit = np.flatnonzero(n)
    n = n[hit]
    which = np.repeat(hit, n)
    number = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    dart = mixed(cell[which] + (number + 1).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    rank = low[which % len(low)] + size[which] * uniform(mixed(dart ^ np.uint64(0x8EBC6AF09C88C6E3)))
    owner = which // len(low)
    height = layer[owner] + uniform(mixed(dart ^ np.uint64(0x589965CC75374CC3)))
    under = (rank < until) & (height < weights[element[owner]])
    return dart[under], rank[under]


def signature(elements: np.ndarray, weights: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """The earliest dart of each coordinate."""
    wanted = size * (np.log(size) + EXTRA_DARTS)
    while True:
        dart, rank = darts(elements, weights, wanted / weights.sum())
        order = np.argsort(-rank, kind="stable")
        coordinate = mixed(dart ^ np.uint64(0x1D8E4E27C47D124F)) % np.uint64(size)
        out = np.zeros(size, dtype=np.uint64)
        full = np.zeros(size, dtype=bool)
        out[coordinate[order]] = dart[order]
        full[coordinate] = True
        if full.all():
            return out
        wanted *= 2


def band_values(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return total.view(np.int64)


def set_key(elements: np.ndarray, counts: np.ndarray, weighted: bool) -> bytes:
    """A 16-byte name of a shingle set, or of a counted one."""
    return blake2b(elements.tobytes() + counts.tobytes() * weighted, digest_size=16).digest()


def sketch_udf(weighted: bool):
    """struct(set_key, n, bands) of a text: the name, the size and the band values of its set."""
    kind = StructType([StructField("set_key", BinaryType()), StructField("n", LongType()), StructField("bands", ArrayType(LongType()))])

    def of(text: str | None) -> dict:
        elements, counts = shingles(text)
        weights = counts if weighted else np.ones_like(counts)
        return {"set_key": set_key(elements, counts, weighted), "n": int(weights.sum()),
                "bands": band_values(signature(elements, weights.astype(float))) if len(elements) else []}

    @F.arrow_udf(kind)
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in one_at_a_time(batches):
            yield from in_parts(map(of, OneByOne(texts)), to_arrow_type(kind))

    return sketch


def elements_udf(weighted: bool):
    """struct(set_key, elements) of a text; of a counted set, the k-th occurrence of a shingle is an element of its own."""
    kind = StructType([StructField("set_key", BinaryType()), StructField("elements", ArrayType(LongType()))])

    def of(text: str | None) -> dict:
        found, counts = shingles(text)
        key = set_key(found, counts, weighted)
        if weighted:
            turn = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            found = np.sort(mixed(np.repeat(found, counts) + turn.astype(np.uint64)))
        return {"set_key": key, "elements": found.view(np.int64)}

    @F.arrow_udf(kind)
    def elements(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in one_at_a_time(batches):
            yield from in_parts(map(of, OneByOne(texts)), to_arrow_type(kind))

    return elements


def similarity(a, b, weighted: bool = False) -> float:
    """Jaccard similarity of two ``shingles`` results; of counts if ``weighted``."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not weighted:
        return len(i) / max(len(a[0]) + len(b[0]) - len(i), 1)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / max(a[1].sum() + b[1].sum() - both, 1))


# --- classes (Spark) ---------------------------------------------------------------

def components(links: DataFrame, name: str = "classes") -> DataFrame:
    """(node, label): every node of ``links`` (a, b) with the smallest node it is linked to, directly or not.

    Each round takes the smallest label among neighbours and then the label's own label;
    it ends when nothing changes.  Rounds are written to the shared folder.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), name)
    while True:
        near = (both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("to"))
                    .agg(F.min("label").alias("near")))
        step = (labels.join(near, F.col("node") == F.col("to"))
                      .select("node", "label", F.least("label", "near").alias("next")))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        step = step.join(jump, F.col("next") == F.col("at"), "left").select(
            "node", F.least("next", F.coalesce("further", "next")).alias("label"), (F.col("label") != F.least(
                "next", F.coalesce("further", "next"))).alias("moved"))
        step = stored(step, name)
        labels = step.select("node", "label")
        if step.filter("moved").isEmpty():
            return labels


class _Search:
    """The state of one search: nodes in buckets, their sets, and the classes so far."""

    def __init__(self, buckets: DataFrame, sets: DataFrame, threshold: float):
        sizes = buckets.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size"))
        met = buckets.join(sizes, ["band", "value"]).groupBy("node").agg(F.sum("size").alias("met"))
        self.buckets = stored(buckets.join(met, "node"), "near-buckets")
        self.sets, self.threshold = sets, threshold
        self.links = self.labels = None
        hubs = self.buckets.groupBy("band", "value").agg(
            F.max(F.struct("met", F.col("node").alias("hub"), F.col("n").alias("hub_n"))).alias("h"))
        self.hubs = stored(self.buckets.join(hubs, ["band", "value"]).filter(F.col("node") != F.col("h.hub"))
                               .groupBy("node", "n", "h.hub", "h.hub_n").agg(F.max("h.met").alias("met")), "near-hubs")

    def near_in_size(self, n: str, m: str) -> Column:
        """Sets of these sizes can reach the threshold; 1e-6 allows for rounding."""
        return F.least(n, m) >= self.threshold * F.greatest(n, m) - 1e-6

    def compare_pairs(self, pairs: DataFrame) -> None:
        """Compare the distinct pairs (a, b) of nodes exactly; links among them join the classes."""
        left = self.sets.select(F.col("node").alias("a"), F.col("elements").alias("left"))
        right = self.sets.select(F.col("node").alias("b"), F.col("elements").alias("right"))
        found = pairs.select("a", "b").distinct().join(right, "b").join(left, "a").select(
            "a", "b", (F.size("left") + F.size("right")).alias("both"), F.size(F.array_intersect("left", "right")).alias("common"))
        likeness = F.col("common") / (F.col("both") - F.col("common"))
        new = stored(found.filter(likeness >= self.threshold).select("a", "b"), "near-links")
        self.links = new if self.links is None else self.links.unionByName(new)
        self.labels = components(self.links)

    def labelled(self, rows: DataFrame, node: str, label: str) -> DataFrame:
        """``rows`` with the class of ``node``; a node without links is its own."""
        if self.labels is None:
            return rows.withColumn(label, F.col(node))
        names = self.labels.select(F.col("node").alias("_of"), F.col("label").alias("_label"))
        return (rows.join(names, F.col(node) == F.col("_of"), "left")
                    .withColumn(label, F.coalesce("_label", node)).drop("_of", "_label"))

    def first_hub_pairs(self) -> DataFrame:
        """Each node with the hub, of those near in size, that meets most nodes."""
        near = self.hubs.filter(self.near_in_size("n", "hub_n"))
        best = near.groupBy("node").agg(F.max(F.struct("met", "hub"))["hub"].alias("hub"))
        return best.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))

    def other_hub_pairs(self) -> DataFrame:
        """The nodes with all hubs of their buckets, near in size, where classes differ."""
        near = self.hubs.filter(self.near_in_size("n", "hub_n"))
        apart = self.labelled(self.labelled(near, "node", "label"), "hub", "hub_label").filter("label != hub_label")
        return apart.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))

    def rest_pairs(self) -> DataFrame:
        """Pairs of different classes that can be alike, of all nodes in buckets of several classes.

        Elements are ordered from rare to common.  If two sets first meet at places i and j
        of theirs, they share no more than the shorter of what follows; a pair whose bound is
        below what the threshold asks for is left out, and so is a meeting of a pair that
        could not be its first.  Within an element's largest class no pairs are formed.
        """
        rows = self.labelled(self.buckets, "node", "label")
        split = (rows.groupBy("band", "value").agg(F.min("label").alias("low"), F.max("label").alias("high"))
                     .filter("low < high").select("band", "value"))
        nodes = stored(rows.join(split, ["band", "value"], "left_semi").groupBy("node").agg(F.any_value("label").alias("label")), "near-rest")
        rows = self.sets.join(nodes, "node").select("node", "label", F.size("elements").alias("n"), F.explode("elements").alias("element"))
        rows = stored(rows, "near-elements")
        seen = rows.groupBy("element", "label").agg(F.count(F.lit(1)).alias("seen"))
        seen = seen.groupBy("element").agg(F.sum("seen").alias("seen"), F.max(F.struct("seen", "label"))["label"].alias("most"),
                                           F.count(F.lit(1)).alias("classes")).filter("seen > 1")
        ranked = rows.join(seen, "element", "left").groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct(
            F.coalesce("seen", F.lit(1)).alias("seen"), "element", "most", F.coalesce("classes", F.lit(1)).alias("classes")))).alias("ranked"))
        # A set shares at least t * n of its n elements with any other, so it meets it within the rest of its rarest.
        early = (F.col("n") - F.ceil(F.col("n") * self.threshold - 1e-6) + 1).cast("int")
        found = ranked.select("node", "label", "n", F.posexplode(F.slice("ranked", F.lit(1), early)).alias("rank", "e"))
        found = stored(found.filter("e.classes > 1").select(
            "node", "label", "n", (F.col("n") - F.col("rank")).alias("left"), "e.element",
            (F.col("label") != F.col("e.most")).alias("minor")), "near-rarest")
        x, y = found.alias("x"), found.filter("minor").alias("y")
        share = self.threshold / (1 + self.threshold)
        can_reach = F.least("x.left", "y.left") >= share * (F.col("x.n") + F.col("y.n")) - 1e-6
        once = ~F.col("x.minor") | (F.col("x.node") < F.col("y.node"))      # a pair of two minor rows is met from one side
        return x.join(y, (F.col("x.element") == F.col("y.element")) & (F.col("x.label") != F.col("y.label"))
                      & self.near_in_size("x.n", "y.n") & can_reach & once).select(
            F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def _row_key() -> Column:
    """With doc_id this tells the rows of ``docs`` apart by their text."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def classified(docs: DataFrame, threshold: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """(doc_id, row_key, set_key, class) per row of ``docs``: ``class`` is the smallest set_key of its near-duplicates."""
    text = F.coalesce("text", F.lit(""))
    sketches = stored(docs.select("doc_id", _row_key().alias("row_key"), sketch_udf(weighted)(text).alias("s"))
                          .select("doc_id", "row_key", "s.*"), "near-sketches")
    nodes = sketches.groupBy(F.col("set_key").alias("node")).agg(
        F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), F.min(F.struct("doc_id", "row_key")).alias("row"))
    nodes = stored(nodes, "near-nodes")
    banded = nodes.select("node", "n", F.posexplode("bands").alias("band", "value"))
    shared = banded.groupBy("band", "value").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    buckets = stored(banded.join(shared.select("band", "value"), ["band", "value"], "left_semi"), "near-banded")
    # The sets of the nodes in buckets, each from one of its texts: the texts meet the names of those rows once.
    named = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select(
        F.col("row.doc_id").alias("_id"), F.col("row.row_key").alias("_key"))
    chosen = docs.select("doc_id", text.alias("text")).join(
        named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left_semi")
    sets = chosen.select(elements_udf(weighted)(F.col("text")).alias("s")).select(F.col("s.set_key").alias("node"), F.col("s.elements"))
    sets = stored(sets.dropDuplicates(["node"]), "near-sets")
    search = _Search(buckets, sets, threshold)
    search.compare_pairs(search.first_hub_pairs())
    search.compare_pairs(search.other_hub_pairs())
    search.compare_pairs(search.rest_pairs())
    classes = search.labelled(nodes.select("node"), "node", "class").withColumnRenamed("node", "set_key")
    return sketches.select("doc_id", "row_key", "set_key").join(classes, "set_key")


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """(doc_id, set_key, class_id) per row of ``docs`` (doc_id, text): its class of near-duplicates.

    Two documents are linked if the Jaccard similarity of their five-word shingle sets
    (of the counted shingles if ``weighted``) is at least ``threshold``; classes are the
    connected components and ``class_id`` is their smallest doc_id.  Texts with one
    shingle set are one node, so copies are never paired.  Texts without words, null and
    empty ones too, are copies of each other.  A text of any length is one set of its own size.

    Rows are told apart by doc_id and text, so a repeated doc_id may name several texts.
    Where two classes have one smallest doc_id, one of them has that number, and the others,
    like classes whose rows have no doc_id, have a number below all doc_ids and 0 that is
    made of their sets; doc_ids are taken to be above -2 ** 62.  Other columns are not carried; an empty table gives no rows.
    """
    found = stored(classified(docs, threshold, weighted), "near-classes")
    first = found.groupBy("class").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row_key"))).alias("row"))
    owners = first.filter("row is not null").groupBy("row.doc_id").agg(F.min("class").alias("owner"))
    lowest = F.least(F.lit(0), F.coalesce(found.agg(F.min("doc_id")).scalar(), F.lit(0)))
    made = lowest - 1 - F.pmod(F.xxhash64("class"), F.lit(2 ** 61))
    named = (first.select("class", F.col("row.doc_id").alias("lowest_id"))
                  .join(owners.withColumnRenamed("doc_id", "lowest_id"), "lowest_id", "left")
                  .select("class", F.when(F.col("owner") == F.col("class"), F.col("lowest_id")).otherwise(made).alias("class_id")))
    return found.join(named, "class").select("doc_id", "set_key", "class_id")


def without_near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """One row of ``docs`` for each class of near-duplicates: that of the smallest doc_id, null last.

    Columns and their names stay.  Of rows with equal doc_id and text one stays.
    """
    found = classified(docs, threshold, weighted)
    kept = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("row"))
    kept = kept.select(F.col("row.doc_id").alias("_id"), F.col("row.row_key").alias("_key"))
    key = fresh(docs, "row_key")
    rows = docs.withColumn(key, _row_key())
    same = rows["doc_id"].eqNullSafe(kept["_id"]) & (rows[key] == kept["_key"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", key]).drop(key)
