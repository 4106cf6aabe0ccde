import random

from stocklens.llm import quality


def brute_repeats(words, window=8):
    where = {}
    for i in range(len(words) - window + 1):
        where.setdefault(tuple(words[i:i + window]), []).append(i)
    return len({p for at in where.values() if len(at) > 1 for i in at for p in range(i, i + window)})


def test_repeated_words_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        words = [rng.choice("abc") if rng.random() < 0.9 else str(rng.random()) for _ in range(rng.randint(0, 80))]
        assert quality.repeated_words(words) == brute_repeats(words)


def test_counts_of_odd_texts():
    assert quality.text_counts(None) == quality.text_counts("") == (0, 0, 0, 0, 0)
    assert quality.text_counts("a\na\n\n \nb#\na") == (4, 5, 1, 2, 0)
    assert quality.text_counts("日本\x85x \x1cy")[:2] == (2, 6)


def test_edges_keep_their_rows(spark, edge, empty, clashing):
    for df in (edge, clashing):
        scored = quality.with_base_rules(df)
        rules = [c for c in scored.columns if c not in df.columns][0]
        out = quality.with_host_verdicts(scored, rules=rules)
        assert out.count() == df.count() and out.columns[:len(df.columns)] == df.columns
    assert quality.with_host_verdicts(quality.with_base_rules(empty)).count() == 0


def test_bad_hosts_take_their_documents_with_them(spark):
    good = "the quick brown fox " * 3 + " ".join(f"w{i}" for i in range(30))
    rows = [(i, "x", "bad") for i in range(400)] + [(i, good, "bad") for i in range(400, 420)]
    rows += [(i, good, "fine") for i in range(1000, 1400)] + [(2000, "x", "new"), (2001, good, "new")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.with_host_verdicts(quality.with_base_rules(df)).collect()}
    assert not any(kept[i] for i in range(420)) and all(kept[i] for i in range(1000, 1400))
    assert kept[2001] and not kept[2000]   # two documents say little about a host
