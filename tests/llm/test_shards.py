import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stocklens.llm import shards

SCHEMA = "doc_id long, text_key long, size long, note string"


def check(rows, shards_n, placed_column="placed"):
    by = defaultdict(list)
    for r in rows:
        p = r[placed_column]
        by[p["shard"]].append(r)
        assert 0 <= p["shard"] < shards_n
    for own in by.values():
        assert sorted(r[placed_column]["slot"] for r in own) == list(range(len(own)))
    return {s: sum(r["size"] or 0 for r in own) for s, own in by.items()}, by


def in_order(rows, key):
    """Rows by shard and slot ascend by ``key``."""
    found = [key(r) for r in sorted(rows, key=lambda r: (r["placed"]["shard"], r["placed"]["slot"]))]
    return found == sorted(found)


def test_shards_are_near_equal_and_in_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.getrandbits(62), int(rng.lognormvariate(6, 1.5)) + 1, "n") for i in range(20_000)]
    got = shards.shard(spark.createDataFrame(rows, SCHEMA), ["text_key"], ["doc_id"]).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], r[2]) for r in rows)
    sums, _ = check(got, 16)
    mean = sum(sums.values()) / 16
    assert len(sums) == 16 and max(abs(s / mean - 1) for s in sums.values()) < 0.03
    assert in_order(got, lambda r: (r["text_key"], r["doc_id"]))


def test_hot_group_is_cut_and_small_groups_are_not(spark):
    """One key with a third of all rows spreads over the shards it fills; groups below a range stay whole."""
    rows = [(i, 77, 100, "hot") for i in range(6_000)] + [(10_000 + i, i // 4 * 1_000, 100, "n") for i in range(12_000)]
    got = shards.shard(spark.createDataFrame(rows, SCHEMA), ["text_key"], ["doc_id"]).collect()
    sums, by = check(got, 16)
    mean = sum(sums.values()) / 16
    assert max(abs(s / mean - 1) for s in sums.values()) < 0.03
    at = defaultdict(set)
    for r in got:
        at[r["text_key"]].add(r["placed"]["shard"])
    assert len(at[77]) >= 5 and all(len(s) == 1 for k, s in at.items() if k != 77)
    assert max(Counter(r["placed"]["range"] for r in got).values()) < 200
    assert in_order(got, lambda r: (r["text_key"], r["doc_id"]))


def test_equal_rows_are_parted(spark):
    """Rows alike in every column, null keys and null sizes among them."""
    rows = [(1, 5, 10, None)] * 4_000 + [(None, None, None, None)] * 50 + [(None, None, 10, "x")] * 2_000
    got = shards.shard(spark.createDataFrame(rows, SCHEMA), ["text_key"], ["doc_id"]).collect()
    sums, _ = check(got, 16)
    assert len(got) == len(rows) and len(sums) == 16
    assert max(sums.values()) < 1.05 * 60_000 / 16
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], r[2]) for r in rows)


def test_large_rows_and_few_rows(spark):
    rows = [(1, 1, 10 ** 9, "huge")] + [(i, i, 5, "n") for i in range(2, 200)]
    sums, by = check(shards.shard(spark.createDataFrame(rows, SCHEMA), ["text_key"], ["doc_id"]).collect(), 16)
    assert sum(len(x) for x in by.values()) == 199
    few = shards.shard(spark.createDataFrame(rows[:2], SCHEMA), ["text_key"], ["doc_id"]).collect()
    assert len(few) == 2


def test_text_keys_and_clashing_columns(spark):
    rows = [(i, f"{'é' if i % 2 else 'z'}{i % 50}", 3, "p", "k", "r") for i in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id long, host string, size long, placed string, k string, `range` string")
    out = shards.shard(docs, ["host"], ["doc_id"], shards=5)
    assert out.columns == [*docs.columns, "_placed"]
    sums, _ = check(out.collect(), 5, "_placed")
    assert len(sums) == 5 and max(sums.values()) < 1.3 * 6_000 / 5


def test_empty_table(spark):
    assert shards.shard(spark.createDataFrame([], SCHEMA), ["text_key"], ["doc_id"]).count() == 0


def test_written_shards(spark, tmp_path):
    rows = [(i, i * 7919 % 1009, 10, f"text {i}") for i in range(1_000)]
    placed = shards.shard(spark.createDataFrame(rows, SCHEMA), ["text_key"], ["doc_id"], shards=4)
    shards.write_shards(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 1_000 and back.select("shard").distinct().count() == 4
    kept = {(r["doc_id"], r["shard"], r["slot"]) for r in back.collect()}
    assert kept == {(r["doc_id"], r["placed"]["shard"], r["placed"]["slot"]) for r in placed.collect()}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query(spark, sf):
    from stocklens.llm.queries import LLM_QUERIES

    got = LLM_QUERIES["op13_sampled_splitters"](spark, sf)
    want = spark.read.parquet(f"{sf}/documents.parquet").selectExpr(
        "doc_id", "cast(octet_length(coalesce(text, '')) + 1 as long) as size", "crc32(cast(coalesce(text, '') as binary)) as text_crc32")
    rows = got.collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(map(tuple, want.collect()))
    sums, counts = Counter(), defaultdict(list)
    for r in rows:
        sums[r["shard"]] += r["size"]
        counts[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    largest = want.agg(F.max("size")).first()[0]
    assert set(sums) == set(range(16)) and max(sums.values()) - sum(sums.values()) / 16 <= largest
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}
