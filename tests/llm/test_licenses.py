from stocklens.llm import licenses


def test_notices_are_found_wherever_they_stand(spark):
    filler = " ".join(f"w{i}" for i in range(37))
    rows = [(i, f"{filler} {text} {filler}") for i, text in enumerate(licenses.NOTICES.values())]
    rows += [(100, f"{filler} released UNDER the mit   license!"), (101, filler), (102, None), (103, ""), (None, rows[0][1]),
             (104, " ".join(licenses.NOTICES.values())), (0, rows[0][1]), (105, "Released under the MIT"), (106, filler * 3000 + " " + rows[8][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(df).collect()}
    names = list(licenses.NOTICES)
    assert {(i, n) for i, n in enumerate(names)} <= got
    assert {(104, n) for n in names} <= got and (100, "mit") in got and (None, names[0]) in got and (106, names[8]) in got
    assert not {d for d, _ in got} & {101, 102, 103, 105}


def test_a_changed_notice_counts_from_the_threshold(spark):
    words = licenses.NOTICES["mit-grant"].split()
    near, far = [*words[:-2], "x", "y"], [*words[:10], "x", *words[11:20], "y", *words[21:]]
    df = spark.createDataFrame([(1, " ".join(near)), (2, " ".join(far))], "doc_id long, text string")
    assert [(r["doc_id"], r["license"]) for r in licenses.scan(df).collect()] == [(1, "mit-grant")]


def test_edges(spark, edge, empty, clashing):
    for df in (edge, empty, clashing):
        assert licenses.scan(df).count() == 0


def test_a_long_text_of_notices(spark):
    """A megabyte of notices: work grows with the text, and every notice is found at its first place."""
    notices = list(licenses.NOTICES.items())
    text, rest = [], 1_000_000
    while rest > 0:
        for name, notice in notices:
            text.append(notice)
            rest -= len(notice)
    df = spark.createDataFrame([(1, " ".join(text)), (None, notices[0][1]), (1, None), (2, "")], "doc_id long, text string")
    got = licenses.scan(df).collect()
    assert {r["license"] for r in got if r["doc_id"] == 1} == set(licenses.NOTICES)
    assert {r["license"] for r in got if r["doc_id"] is None} == {notices[0][0]}
    assert all(r["containment"] >= licenses.CONTAINMENT for r in got)
    first = {r["license"]: r["first_shingle"] for r in got if r["doc_id"] == 1}
    assert first[notices[0][0]] == 0 and max(first.values()) < 400
