import re
from collections import Counter

from stocklens.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_budgets_are_met_to_the_word(spark, edge):
    rows = [(r["doc_id"], r["source"], *r["mix"]) for r in mixing.mix(edge).collect()]
    assert len(rows) == edge.count()
    sizes, taken, target = Counter(), Counter(), {}
    for _, source, size, whole, goal, took, _ in rows:
        sizes[source] += size
        taken[source] += took
        target[source] = goal
        assert 0 <= took <= 3 * size
    assert {s: w for _, s, _, w, *_ in rows} == dict(sizes)
    assert sum(target.values()) == sum(sizes.values()) or abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    for source in sizes:
        assert target[source] <= 3 * sizes[source] + 1e-6
        assert taken[source] == int(target[source])
    again = [(r["doc_id"], r["source"], *r["mix"]) for r in mixing.mix(edge).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, again))


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_targets_against_repeated_resharing(spark):
    sizes = {"a": 1000, "b": 3, "c": 40, "d": 500, None: 7, "e": 0, "Z": 60}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_copies_are_whole_documents(spark, clashing):
    out = mixing.mixed_documents(clashing)
    assert out.columns == clashing.columns
    texts = {r["text"] for r in clashing.collect()}
    assert all(r["text"] in texts for r in out.collect())


def test_a_hot_source_is_spread_over_buckets(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'one two' as text", "'hot' as source")
    assert sum(r["mix"]["taken"] for r in mixing.mix(df).collect()) == 8000


def test_empty_table(spark, empty):
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
