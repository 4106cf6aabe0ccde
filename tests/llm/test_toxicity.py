import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from stocklens.llm import toxicity

INSULTS = ["blorgle", "snitwad", "frumpkin"]


def corpus(n=600):
    rng = random.Random(8)
    syllables = ["the", "on", "er", "an", "ti", "re", "sh", "nd"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(30)]
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(INSULTS)
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


def test_held_out_documents_and_disguises(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    scored = toxicity.with_scores(df, model).withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()
    right = [(r["toxicity"] >= toxicity.THRESHOLD) == bool(r["toxic"]) for r in scored if r["out"]]
    assert np.mean(right) > 0.97 and all(0 <= r["toxicity"] <= 1 for r in scored)
    plain, apart, other = model.decisions(["blorgle", "blor-gle", "thereon"])
    assert plain > 0 and apart > 0 > other
    assert model.decisions(["b l o r g l e"])[0] > other


def test_the_table_gives_the_kernel_sum():
    """One weight per subsequence equals the sum over landmarks of kernel values."""
    rows = [toxicity.class_rows(w)[0] for w in ("idiotic", "clown", "scum")]
    tables, codes = toxicity.Tables.of_rows(rows)
    alpha = np.array([0.5, -2.0, 1.5])
    one = toxicity.Tables(codes, (alpha @ tables.values[:, 1:])[None, :])
    words = [toxicity.class_rows(w)[0] for w in ("idiot", "clownish", "sc*um", "zzz")]
    assert np.allclose(tables.sums(words) @ alpha, one.sums(words)[:, 0], atol=1e-5)


def test_edges(spark, edge, empty, clashing):
    df = spark.createDataFrame(corpus(300), "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    for docs in (edge, clashing):
        out = toxicity.with_scores(docs, model)
        new = [c for c in out.columns if c not in docs.columns]
        assert out.count() == docs.count() and len(new) == 1
        assert all(0 <= r[0] <= 1 for r in out.select(new[0]).collect())
    assert toxicity.with_scores(empty, model).count() == 0
    labels = df.select("doc_id", "toxic")
    assert toxicity.train(empty, labels) is None and toxicity.train(df, labels.filter("toxic = 0")) is None
    assert {r["toxicity"] for r in toxicity.with_scores(edge, None).collect()} == {0.0}


def test_units():
    assert toxicity.units(None) == toxicity.units(" ") == set()
    assert "i d i o t" in toxicity.units("you i d i o t, go")
    assert len(toxicity.class_rows("x" * 100)) > 3


def test_windows_of_texts_are_those_of_their_words_alone():
    """Sums over the places of many texts give the decisions of each window by itself."""
    rng = random.Random(3)
    rows = [toxicity.class_rows(w)[0] for w in ("idiot", "drop dead", "clown")]
    tables, codes = toxicity.Tables.of_rows(rows)
    model = toxicity.Model(codes, np.array([1.0, 2.0, -0.5]) @ tables.values[:, 1:], -0.1)
    texts = ["Drop, dead!", "", "--", "an id.iot### by clo wn", "i d i o t", "Ñandú is", None, "x" * 90, "a 1 b"]
    texts += [" ".join(rng.choice(["drop", "dead", "i", "do", "clown,"]) for _ in range(12)) for _ in range(20)]
    together, rows = model.worst(texts)
    assert np.allclose(together, [model.worst([t])[0][0] for t in texts])
    assert together[1] == together[2] == together[6] == toxicity.NO_WORDS
    assert rows[0] == toxicity.class_rows("drop dead")[0] and rows[4] == toxicity.class_rows("i d i o t")[0]
    for text in ("clown", "by clo", "drop dead", "i d i o t", "id.iot"):
        windows = toxicity.Windows([text]).rows()[0]
        assert toxicity.class_rows(text)[0] in windows
        best = max(tables.sums([w])[0] @ np.array([1.0, 2.0, -0.5]) - 0.1 for w in windows)
        assert np.isclose(model.worst([text])[0][0], best, atol=1e-4)


def test_long_texts_are_read_to_the_end():
    model = toxicity.fit_words({toxicity.class_rows("blorgle")[0]: 9.0}, {toxicity.class_rows(w)[0]: 1.0 for w in ("thereon", "andti")})
    far = "thereon andti " * 60_000
    (clean, toxic), _ = model.worst([far, far + "blorgle"])
    assert clean < 0 < toxic


def test_insults_of_ordinary_words_and_words_parted_by_a_space(spark):
    """Each word of the insult stands in clean documents, too; some insults are split."""
    rng, rows = random.Random(11), []
    words = ["the", "oner", "shand", "tire", "drop", "dead", "ndti", "rean"]
    for i in range(900):
        text = ["the"]
        while len(text) < 30:
            if (text[-1], word := rng.choice(words)) != ("drop", "dead"):
                text.append(word)
        if toxic := i % 6 == 0:
            text[5:5] = ["drop", "dead"] if i % 12 else ["frumpkin"]
        rows.append((i, " ".join(text) + ".", int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    out = toxicity.with_scores(df, model).filter(toxicity.held_out(F.col("doc_id"))).collect()
    right = [(r["toxicity"] >= toxicity.THRESHOLD) == bool(r["toxic"]) for r in out]
    caught = [r["toxicity"] >= toxicity.THRESHOLD for r in out if r["toxic"]]
    assert np.mean(right) > 0.97 and np.mean(caught) > 0.9
    whole, parted, apart = model.worst(["frumpkin", "the frum pkin oner", "dead drop"])[0]
    assert whole > 0 and parted > 0 > apart


def test_more_documents_do_not_shorten_the_list_of_insults(spark):
    """One rule at every size: a very common insult does not put out the rarer ones."""
    rng, rows = random.Random(5), []
    for i in range(400):
        text = [rng.choice(["the", "oner", "shand", "tire", "ndti", "rean"]) for _ in range(20)]
        if toxic := i % 4 == 0:
            text[3] = "blorgle" if i % 16 else "snitwad"
        rows.append((i, "".join(f"{w} " for w in text), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert min(model.worst(["blorgle", "snitwad"])[0]) > 0 > model.worst(["the oner"])[0][0]


def test_the_sample_has_one_row_for_each_id_and_text(spark, monkeypatch):
    """One id with most of the rows stays one row, and the bound holds for rows."""
    sizes, real = [], toxicity.stored

    def stored(df, name):
        out = real(df, name)
        if name == "toxicity-sample":
            sizes.append((out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(toxicity, "stored", stored)
    df = spark.createDataFrame(corpus(60) + [(0, "the same text again.", 1)] * 500 + [(0, f"other {i}.", 1) for i in range(50)],
                               "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic").distinct()
    toxicity.train(df.select("doc_id", "text"), labels)
    toxicity.train(df.select("doc_id", "text"), labels, max_docs=20)
    assert not [r for r in df.filter("doc_id = 0").select(toxicity.held_out(F.col("doc_id")).alias("o")).distinct().collect() if r["o"]]
    used = df.filter(~toxicity.held_out(F.col("doc_id"))).distinct().count()
    assert sizes == [(used, used), (20, 20)]


def test_fitting_holds_few_copies_of_the_features():
    """The fit runs in the driver: the features once, two copies of rows within the margin, and the tables."""
    rng = random.Random(6)

    def rows(n, size):
        words = ("".join(rng.choice("etaoinshrdlu") for _ in range(size)) for _ in range(n))
        return {r: 1.0 for w in words for r in toxicity.class_rows(w)}

    toxic, clean = rows(300, 8), rows(300, 6)
    n = 300 + sum(len(toxicity.with_insertions(r)) for r in toxic)
    tracemalloc.start()
    try:
        toxicity.fit_words(toxic, clean, landmarks=150)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 7 * 8 * n * 151
