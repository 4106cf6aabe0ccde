import hashlib
import random

from stocklens.llm import syncmers
from pyspark.sql import functions as F


def brute_next(rows):
    """Row number of the next row by descending doc_id, nulls last; ids are unique here."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, -(rows[i][0] or 0)))
    return {order[k]: order[(k + 1) % len(order)] for k in range(len(order))}


def test_edited_texts_against_brute_force(spark):
    rng = random.Random(10)
    rows = [(i * 7 % 1009, "".join(rng.choice("ab é日😀\n") for _ in range(rng.randint(0, 200)))) for i in range(1000)]
    rows += [(5000, None), (None, "last one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for per_range in (7, 5000):
        got = {r["doc_id"]: r["next_text"] for r in syncmers.with_next_text(df, per_range).collect()}
        assert got == {rows[i][0]: rows[j][1] or "" for i, j in brute_next(rows).items()}
    out = {r["doc_id"]: r for r in syncmers.fingerprint_pairs(df).collect()}
    for i, j in brute_next(rows).items():
        text, other = rows[i][1] or "", rows[j][1] or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + other[:third]
        r = out[rows[i][0]]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_anchors_are_context_free(spark):
    rng = random.Random(11)
    middle = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
    rows = [(f"{a} {middle} {b}",) for a, b in (("x", "y"), ("p q r s", "t"), ("", "u " * 50))]
    df = spark.createDataFrame(rows, "text string").select(syncmers.hashes(syncmers.anchors(F.col("text"))).alias("m"))
    marks = [set(r["m"]) for r in df.collect()]
    assert len(marks[0] & marks[1] & marks[2]) > 0.8 * len(marks[0]) > 20




def test_selection_rule(spark):
    """A run is taken exactly if the smallest of its inner hashes is its first or last."""
    df = spark.createDataFrame([(" ".join(f"w{i * i % 97}" for i in range(120)),)], "text string")
    words = F.split("text", " ")
    padded = df.select(F.concat(F.array(*[F.xxhash64(F.lit(v)) for v in syncmers.BEFORE]), F.transform(words, lambda w: F.xxhash64(w)),
                                F.array(*[F.xxhash64(F.lit(v)) for v in syncmers.AFTER])).alias("h"), "text")
    row = padded.select("h", F.zip_with("h", F.slice("h", 2, 10**6), lambda a, b: F.xxhash64(a, b)).alias("s"),
                        syncmers.anchors(F.col("text")).alias("a")).first()
    width = syncmers.RUN - syncmers.INNER + 1
    want = [i for i in range(len(row["h"]) - syncmers.RUN + 1)
            if min(row["s"][i:i + width]) in (row["s"][i], row["s"][i + width - 1])]
    assert [a["position"] for a in row["a"]] == [i + 1 - syncmers.RUN for i in want]


def test_edges(spark, edge, empty, clashing):
    out = syncmers.fingerprint_pairs(edge).collect()
    assert len(out) == edge.count()
    text = {r["doc_id"]: r["text"] for r in edge.collect()}
    marks = {}
    for r in out:
        if r["doc_id"] is not None:
            marks.setdefault(text[r["doc_id"]] or "", set()).add(r["fingerprint"])
    assert all(len(m) == 1 for m in marks.values())
    assert syncmers.fingerprint_pairs(empty).count() == 0 and syncmers.fingerprint_pairs(clashing).count() == clashing.count()
    assert syncmers.with_next_text(clashing).columns[:len(clashing.columns)] == clashing.columns
    one = syncmers.fingerprint_pairs(edge.limit(0).unionByName(edge.filter("doc_id = 5"))).first()
    assert one["near_next"] == 1.0
