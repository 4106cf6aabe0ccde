import random

from stocklens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for conv, turn, role, text in set(rows):
        convs.setdefault(conv, []).append((turn, role, text))
    said = {c: tuple((r or "", x or "") for _, r, x in sorted(t, key=lambda v: (v[0] is not None, v[0] or 0, v[1] or "", v[2] or "")))
            for c, t in convs.items()}
    kept = set()
    for c, s in said.items():
        longer = any(len(o) > len(s) and o[:len(s)] == s for o in said.values())
        first = min((d for d, o in said.items() if o == s), key=lambda d: (d is not None, d or 0))
        if not longer and first == c:
            kept.add((c, len(s)))
    return kept


def test_maximal_conversations_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for c in range(60):
        n = rng.randint(1, 5)
        rows += [(c, t, ("user", "assistant")[t % 2], f"x{rng.choice('ab')}") for t in range(n)]
    rows += [(70, t, "user", f"t{t}") for t in range(2500)] + [(71, t, "user", f"t{t}") for t in range(1500)]
    rows += [(80, 0, None, None), (80, None, "user", "y"), (None, 0, "user", "n"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    prefixes = chat.turn_prefixes(df)
    got = {(r["conv_id"], r["n_turns"]) for r in chat.maximal_conversations(prefixes).collect()}
    assert got == brute(rows)
    out = chat.format_chats(df)
    assert {(r["conv_id"], r["n_turns"]) for r in out.collect()} == got
    long = [r["rendered"] for r in out.filter("conv_id = 70").orderBy("position").collect()]
    assert long == [f"{chat.OPEN}user\nt{t}{chat.CLOSE}\n" for t in range(2500)]


def test_marks_in_texts_are_escaped(spark):
    df = spark.createDataFrame([(1, 0, None, f"a{chat.CLOSE}b", "z")], SCHEMA + ", position string")
    assert chat.format_chats(df).first()["rendered"] == f"{chat.OPEN}unknown\na< |im_end|>b{chat.CLOSE}\n"
    assert chat.format_chats(df.limit(0)).count() == 0
