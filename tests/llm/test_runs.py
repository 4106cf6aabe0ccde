import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stocklens.llm import runs
from stocklens.llm.queries import LLM_QUERIES


def brute(words, min_length=24, min_periods=3):
    """All runs, by trying every period and every stretch that repeats with it."""
    n, out = len(words), []
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_length, min_periods * q):
                stretch = words[i:i + length]
                if not any(all(stretch[x] == stretch[x + p] for x in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def samples(seed, count=60):
    rng = random.Random(seed)
    for _ in range(count):
        words, alphabet = [], "abcdefghij"[:rng.randint(1, 4)]
        for _ in range(rng.randint(0, 5)):
            unit = [rng.choice(alphabet) for _ in range(rng.randint(1, 14))]
            stretch = unit * rng.randint(1, 8)
            words += stretch[:len(stretch) - rng.randint(0, len(unit) - 1)]
            words += [rng.choice(alphabet + "xyz") for _ in range(rng.randint(0, 6))]
        yield words


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("min_length,min_periods", [(24, 3), (6, 2), (1, 3)])
def test_equal_to_brute_force(seed, min_length, min_periods):
    texts = list(samples(seed))
    numbers = {}
    coded = [np.array([numbers.setdefault(w, len(numbers)) for w in t], dtype=np.int64) for t in texts]
    got = runs.find_runs(coded, min_length, min_periods)
    assert got == [brute(t, min_length, min_periods) for t in texts]
    assert any(got)


def test_every_window_width_finds_repeats():
    for width in range(1, 40):
        codes = np.concatenate([np.arange(50), np.arange(100, 100 + width), [7], np.arange(100, 100 + width)])
        text = np.repeat([0, 1], [50, 2 * width + 1])
        assert runs.repeating_texts(codes, text, width).tolist() == [1]
        assert 1 not in runs.repeating_texts(codes, text, 2 * width + 2).tolist()


def reference(doc_id, text):
    words = [w for w in (text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words) if n < 3000 else None
    return words, found


def expected(doc_id, text):
    words, found = reference(doc_id, text)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["a", "b", "ñ", "日本", "x.", " "]) for _ in range(rng.randint(0, 90)))) for i in range(120)]
    rows += [(200 + i, " ".join(w)) for i, w in enumerate(samples(8, 40))]
    rows += [(300, None), (301, ""), (302, " \t\n "), (None, "a " * 40), (None, None), rows[130], rows[130], (303, "\x0bq\x0cq\r" * 30)]
    extra = spark.createDataFrame([r + ("z", "z", 1) for r in rows], "doc_id long, text string, runs string, w string, h int")
    extra.write.parquet(str(tmp_path / "documents.parquet"))
    got = LLM_QUERIES["op12_periodic_runs"](spark, str(tmp_path)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(expected(*r)) for r in rows)
    assert sum(r["n_runs"] for r in got) > 50


def test_long_texts(spark, edge):
    base = " ".join(f"w{i}" for i in range(4000))
    docs = spark.createDataFrame([(1001, " ".join([base] * 5)), (1002, "b " * 60_000)], "doc_id long, text string")
    docs = docs.unionByName(edge.select("doc_id", "text"))
    got = docs.select("doc_id", runs.periodic_runs(F.col("text")).alias("r")).collect()
    found = {r["doc_id"]: [tuple(x) for x in r["r"]["runs"]] for r in got}
    assert found[1001] == [(0, 20_000, 4000)] and found[1002] == [(0, 60_000, 1)]
    assert {r["doc_id"]: r["r"]["collapsed"] for r in got}[1002] == "b" and found[43] == [] and len(got) == edge.count() + 2


def test_empty_table(spark, empty):
    assert empty.select(runs.periodic_runs(F.col("text")).alias("r")).count() == 0


def test_hot_words_are_linear():
    """A text of one word has one run; its classes grow by one position at a time."""
    assert runs.find_runs([np.zeros(200_000, dtype=np.int64)]) == [[(0, 200_000, 1)]]
