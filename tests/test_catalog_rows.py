"""Catalog rows whose quoted cells hold line breaks, and the state of quotes over splits."""

import random

import pytest
from pyspark.sql import functions as F

import stocklens as sl
from stocklens.sources import catalog
from stocklens.sources.catalog import _cells, joined_rows, line_ends, numbered_lines, quoted_spans, row_lines

SCHEMA = "file string, split long, line long, value string"


def walk(text, sep=";"):
    """Rows of (first line, cells) by one walk over all characters, and whether the last quote was closed."""
    rows, cells, cell, state, line, first, i = [], [], "", "start", 0, 0, 0
    while i < len(text):
        c = text[i]
        if state == "quoted":
            if c == '"' and text[i + 1:i + 2] == '"':
                cell, i = cell + '""', i + 2
                continue
            if c == '"':
                state = "rest"
            cell += c
        elif c == sep:
            cells, cell, state = cells + [cell], "", "start"
        elif c == "\n":
            rows.append((first, cells + [cell]))
            cells, cell, state, first = [], "", "start", line + 1
        else:
            if c == '"' and state == "start":
                state = "quoted"
            elif not c.isspace():
                state = "rest"
            cell += c
        line += c == "\n"
        i += 1
    if cells or cell:
        rows.append((first, cells + [cell]))
    return rows, state != "quoted"


def clean(cell):
    text = cell.strip()
    if len(text) >= 2 and text[0] == '"' and text[-1] == '"' and '"' not in text[1:-1].replace('""', ""):
        text = text[1:-1].replace('""', '"').strip()
    return text or None


def cut(name, text, at):
    """The lines of ``text`` with the split that each begins in, if the file is cut at the bytes ``at``."""
    out, offset = [], 0
    for i, value in enumerate(text[:-1].split("\n") if text.endswith("\n") else text.split("\n")):
        out.append((name, max(c for c in (0, *at) if c <= offset), i, value))
        offset += len(value) + 1
    return out


def random_text(rng):
    pieces = ['a', ' ', ';', '"', '""', '\n', '"x\ny"', ';"', '";', '";"', 'b"c', '"\n"']
    return "".join(rng.choice(pieces) for _ in range(rng.randint(3, 40)))


def found(spark, files):
    """Rows of many texts at once: name -> [(line, cells)]."""
    lines = spark.createDataFrame([r for f in files for r in f], SCHEMA)
    rows = joined_rows(lines, quoted_spans(lines)).select("file", "line", _cells(F.col("value"), ";").alias("cells"))
    out = {}
    for r in rows.collect():
        out.setdefault(r["file"], []).append((r["line"], r["cells"]))
    return {f: sorted(x, key=lambda p: p[0]) for f, x in out.items()}


def test_a_file_cut_at_every_byte(spark):
    text = 'Concatenar;nota;% Descuento\nk1;"two\nlines; here";1%\n"k\n2";x "y";"""3\n\n"""\nk3;5" pipe;"4"\n\n "k4" ;"a\n";"\n"\n'
    want, closed = walk(text)
    assert closed and len(want) == 6
    files = [cut(f"cut{i}", text, (i,)) for i in range(len(text))]
    files += [cut(f"pair{i}-{j}", text, (i, j)) for i in range(0, len(text), 3) for j in range(i, len(text), 5)]
    files.append(cut("all", text, range(len(text))))
    got = found(spark, files)
    expected = [(n, [clean(c) for c in cells]) for n, cells in want]
    assert len(got) == len(files)
    assert [n for n, rows in got.items() if rows != expected] == []


def test_random_texts_cut_at_random(spark):
    rng = random.Random(4)
    files, want = [], {}
    while len(files) < 400:
        text = random_text(rng) + "\n"
        rows, closed = walk(text)
        if closed:
            name = f"t{len(files)}"
            files.append(cut(name, text, sorted(rng.sample(range(len(text)), min(len(text), rng.randint(0, 6))))))
            want[name] = [(n, [clean(c) for c in cells]) for n, cells in rows]
    got = found(spark, files)
    assert sum(len(r) < len(f) for r, f in zip(want.values(), files)) > 50
    for name, rows in want.items():
        assert got.get(name, []) == rows, (name, [f for f in files if f[0][0] == name])


def test_the_state_of_a_line(spark):
    df = spark.createDataFrame([('a;b',), ('"a";b',), ('"a;b',), ('a";b',), ('a";"b',), ('x"y',), ('',), ('""',), ('"""',)], "value string")
    got = [tuple(map(bool, r)) for r in df.select(*line_ends(df["value"], ";")).collect()]
    assert got == [(False, True), (False, False), (True, False), (False, False), (True, True),
                   (False, False), (False, True), (False, True), (True, False)]


def test_open_quotes_and_endless_rows_fail_by_name(spark, tmp_path, monkeypatch):
    path = tmp_path / "open.csv"
    path.write_text('Concatenar;% Descuento\nk;1\n"x;2\ny;3\n')
    with pytest.raises(Exception, match="a quote is not closed after line 3 of .*open.csv"):
        sl.load_catalog(spark, str(tmp_path)).collect()
    monkeypatch.setattr(catalog, "MAX_ROW_LINES", 5)
    path.write_text('Concatenar;% Descuento\n"a\n\n\n\n\n\nb";1\n')
    with pytest.raises(Exception, match="a row of over 5 lines after line 2 of .*open.csv"):
        sl.load_catalog(spark, str(tmp_path)).collect()


def pairs(df):
    return sorted((str(a), str(b)) for a, b in df.collect())


def test_catalog_with_broken_cells(spark, tmp_path):
    title = '"Promo\n2024\n\n";;\n' * 3
    (tmp_path / "a.csv").write_text(title + 'nota;Concatenar;"% Descuento"\n"x\ny";"k\n1";10%\r\n5" pipe;k2;"20\n%"\n')
    (tmp_path / "b.csv").write_text("Concatenar;% Descuento\nk3;5\n")
    got = sl.load_catalog(spark, str(tmp_path))
    assert pairs(got) == [("k\n1", "10%"), ("k2", "20\n%"), ("k3", "5")]
    # rows are counted, not lines: the header is row 3 of a file and its first line is line 12
    assert pairs(sl.load_catalog(spark, str(tmp_path / "a.csv"), header_row=3)) == [("k\n1", "10%"), ("k2", "20\n%")]
    assert sl.load_catalog(spark, str(tmp_path / "a.csv"), scan_rows=4).count() == 2
    with pytest.raises(Exception, match="no header in the first 3 lines"):
        sl.load_catalog(spark, str(tmp_path / "a.csv"), scan_rows=3).collect()


def test_rows_over_splits_of_real_files(spark, tmp_path):
    """Files read in splits of some hundred bytes: a cell runs over several of them."""
    rng = random.Random(2)
    rows = [(f"k{i}", "\n".join("z;" * rng.randint(0, 30) for _ in range(rng.choice((1, 1, 2, 40)))), f"{i % 90}%") for i in range(400)]
    text = "Concatenar;nota;% Descuento\n" + "".join(f'{k};"{n}";{p}\n' for k, n, p in rows)
    (tmp_path / "long.csv").write_text(text)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        assert pairs(sl.load_catalog(spark, str(tmp_path))) == sorted((k, p) for k, _, p in rows)
        assert numbered_lines(spark, str(tmp_path)).select("split").distinct().count() > 20
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_first_lines_of_rows(spark):
    spans = spark.createDataFrame([("f", 2, 5), ("f", 7, 8), ("f", 20, 30), ("g", 0, 3)], "file string, first long, last long")
    got = {r["file"]: (r["a"], r["b"]) for r in row_lines(spans, {"a": 4, "b": 3}).collect()}
    assert got == {"f": (7, 6), "g": (7, 6)}
