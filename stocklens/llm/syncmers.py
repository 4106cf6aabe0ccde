"""Document fingerprints from closed syncmers over words.

A run of nine words is an anchor if the smallest of its eight two-word hashes is the
first or the last one.  That depends on the nine words alone, so an unchanged passage
keeps its anchors wherever it stands.  The fingerprint is the list of anchor hashes in
text order; two fingerprints are as alike as the share of distinct anchors they have in
common, wherever and however often these stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import bind, pair_hashes, shifted, sliding_minimum_8, word_hashes
from .common import fresh

RUN = 9          # words of a run
INNER = 2        # words of an inner substring; RUN - INNER + 1 = 8 of them
ROWS_PER_RANGE = 2_048
MAX_RANGES = 10_000
BREAK = r"[\x20\x09-\x0D]+"
# Fixed hashes around a text, so that texts of a few words have anchors, too.
BEFORE = tuple(range(-(RUN - 1), 0))
AFTER = tuple(range(1, RUN))


def anchors(text: Column) -> Column:
    """Array of struct(position, hash): the anchors of a text in order.

    ``position`` is the run's first word, counted from 1 - RUN (the words before the
    text are fixed ones).  Null counts as empty; every text has the anchors that its
    runs give, which can be none for texts of very few words.
    """
    def ends(values) -> Column:
        return F.array(*[F.xxhash64(F.lit(v)) for v in values])

    padded = F.concat(ends(BEFORE), word_hashes(F.split(F.coalesce(text, F.lit("")), BREAK)), ends(AFTER))

    def of_hashes(h: Column) -> Column:
        inner = pair_hashes(h, shifted(h, 1))

        def of_inner(s: Column) -> Column:
            def of_minima(m: Column) -> Column:
                starts = F.filter(F.sequence(F.lit(1), F.size(h) - RUN + 1),
                                  lambda i: F.get(m, i - 1).isin(F.get(s, i - 1), F.get(s, i + RUN - INNER - 1)))
                return F.transform(starts, lambda i: F.struct(
                    (i - RUN).alias("position"), F.xxhash64(F.slice(h, i, F.lit(RUN))).alias("hash")))
            return bind(sliding_minimum_8(s), of_minima)
        return bind(inner, of_inner)

    return bind(padded, of_hashes)


def hashes(found: Column) -> Column:
    """The 32-bit anchor hashes as eight hex digits each."""
    return F.transform(found, lambda a: F.lpad(F.hex(a["hash"].bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))


def fingerprint(marks: Column) -> Column:
    """One string for the hashes of ``hashes``."""
    return F.array_join(marks, "")


def likeness(a: Column, b: Column) -> Column:
    """Shared distinct anchors over all distinct anchors; 1 for equal lists, even empty ones."""
    together = F.size(F.array_union(a, b))
    return F.when(together == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.greatest(together, F.lit(1)))


def with_next_text(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``next_text``: the text of the next row by descending doc_id.

    After the last row comes the first; a lone row follows itself.  Null ids are the
    lowest; rows of one doc_id are ordered by the hash of their text.  Null texts count
    as empty in the new column.

    Quantiles of the ids (from the id column alone) cut the order into ranges, each
    closed by a row that really exists.  That row is dealt to its own range and, as a
    guest at the end, to the range above, so each range knows its successor and the
    texts are shuffled once.  doc_id is taken to be nearly unique: rows of one id
    share a range.
    """
    n = docs.agg(F.count("doc_id")).first()[0]
    ranges = min(MAX_RANGES, max(1, -(-n // rows_per_range)))
    bounds = sorted(set(docs.agg(F.percentile_approx(
        "doc_id", [(i + 1) / ranges for i in range(ranges)], max(10_000, 20 * ranges))).first()[0] or ()))
    if n:
        top = docs.agg(F.max("doc_id")).first()[0]
        bounds = [b for b in bounds if b < top] + [top]
    x, guest = fresh(docs, "range"), fresh(docs, "guest")
    last = len(bounds)
    edges = F.array(*[F.lit(b).cast(docs.schema["doc_id"].dataType) for b in bounds])
    own = F.coalesce(F.size(F.filter(edges, lambda b: b < F.col("doc_id"))), F.lit(0)) if bounds else F.lit(0)
    if bounds:
        placed = F.when(F.array_contains(edges, F.col("doc_id")), F.array(
            F.struct(own.alias("at"), F.lit(0).alias("guest")),
            F.struct(F.pmod(own + 1, F.lit(last)).alias("at"), F.lit(1).alias("guest")))).otherwise(
            F.array(F.struct(own.alias("at"), F.lit(0).alias("guest"))))
    else:
        placed = F.array(F.struct(own.alias("at"), F.lit(0).alias("guest")))
    rows = docs.withColumn(x, F.explode(placed)).withColumn(guest, F.col(f"{x}.guest"))
    order = Window.partitionBy(f"{x}.at").orderBy(
        guest, F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    text = F.coalesce("text", F.lit(""))
    following = F.coalesce(F.lead(text).over(order), F.first(text).over(order))
    return (rows.withColumn(fresh(docs, "next_text"), following)
                .filter(F.col(guest) == 0).drop(x, guest))


def edited_text(text: Column, following: Column) -> Column:
    """The text with its last third replaced by as many leading characters of the next one."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - third),
                    F.substring(following, F.lit(1), third))


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: its fingerprint, its edited text's, and how alike they are.

    Null texts count as empty.  Equal texts have equal fingerprints.  Texts are whole
    at any length; extra columns are not carried.
    """
    rows = with_next_text(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.transform(F.array("text", "edited", "next_text"), lambda t: hashes(anchors(t))).alias("marks"))
    own, edited, following = (F.element_at("marks", i) for i in (1, 2, 3))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(own).alias("fingerprint"),
        fingerprint(edited).alias("edited_fingerprint"), likeness(own, edited).alias("near_edited"),
        likeness(own, following).alias("near_next"))
