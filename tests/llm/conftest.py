import random

import pytest

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta,", "eps", "zeta.", "ñandú", "日本", "<|x|>", "don't", "12"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))), "en", f"s{i % 3}", 5) for i in range(40)]
    rows += [(40, None, None, None, None), (None, None, None, None, None), (None, "alpha beta gamma", "en", None, 3),
             (41, "", "en", "s0", 0), (42, "   \n\t ", "en", "s1", 5), (43, LONG, "en", "s2", len(LONG))]
    return rows + [rows[3], rows[3], rows[43]] + [(50 + i, rows[7][1], "en", "s9", 1) for i in range(5)]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    """Extra columns named like those that the operators add."""
    extra = ["mix", "rules", "kept", "toxicity", "ids", "n_tokens", "range", "guest", "x", "copy", "set_key", "next_text"]
    rows = [r + tuple("z" for _ in extra) for r in edge_rows()[:12]]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", {e} string" for e in extra))
