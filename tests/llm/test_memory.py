"""What a worker holds while it works on a batch, and after."""

import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stocklens.llm import common, toxicity

ROLLUP = Path("/proc/self/smaps_rollup")


def peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def sentences(n: int) -> list[str]:
    return [" ".join(f"w{chr(97 + i % 26)}{chr(97 + j)}{chr(97 + (i * j) % 26)}" for j in range(20)) for i in range(n)]


@pytest.mark.skipif(not ROLLUP.exists(), reason="needs Linux")
def test_freed_memory_leaves_the_worker_between_batches():
    def anonymous_mb() -> float:
        return int(re.search(r"\nPss_Anon:\s+(\d+)", ROLLUP.read_text())[1]) / 1024

    given = common.one_at_a_time(pa.array([str(i)]) for i in range(3))
    next(given)
    small = [np.ones(4_000) for _ in range(2_000)]        # 64 MB in pieces of 32 kB: from the heap
    pinned = np.ones(4_000)                               # keeps the heap's end where it is
    before = anonymous_mb()
    del small
    next(given)
    assert before - anonymous_mb() > 40 and len(pinned)


def test_scores_hold_the_windows_of_a_few_texts():
    model = toxicity.Model(np.arange(100), np.ones(100, dtype=np.float32), 0.1)
    model.worst(["warm up"])
    assert peak_mb(lambda: model.worst(sentences(3_000))) < 12


def test_windows_are_held_for_a_few_texts_and_are_all_there(spark, monkeypatch):
    texts = [*sentences(3 * common.PART_ROWS + 7), "", None]
    alone = [sorted(set().union(*toxicity.Windows([t or ""]).rows())) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1)
    found = {r["i"]: sorted(r["w"]) for r in df.select("i", toxicity.windows_of(F.col("text")).alias("w")).collect()}
    assert [found[i] for i in range(len(texts))] == alone

    made = []
    monkeypatch.setattr(toxicity.F, "arrow_udf", lambda kind: lambda f: lambda *c: made.append(f))
    toxicity.windows_of(None)
    batch = pa.array(sentences(6_000))

    def run():
        for part in made[0](iter([batch])):
            assert len(part) <= common.PART_ROWS
    assert peak_mb(run) < 12


def test_the_packed_filter_has_what_was_put_in():
    rows = [f"row {i}" for i in range(2_000)]
    bits = toxicity.packed(np.array([toxicity.zlib.crc32(r.encode()) % toxicity.BITS for r in rows[:1_000]]))
    hits = [bool(toxicity.in_filter(bits, r)) for r in rows]
    assert all(hits[:1_000]) and sum(hits[1_000:]) < 10 and len(bits) == toxicity.BITS // 8
