import base64
import gzip
import hashlib
import random

import pytest

from stocklens.llm import warc


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def pages():
    rng = random.Random(6)
    rows = [(i, f"http://e/{i}", "<p>é😀" + "x\r\n\r\nWARC/1.1\r\n" * rng.randint(0, 30)) for i in range(30)]
    rows += [(30, None, None), (31, "http://e\r\nX: y", ""), (32, "u", rows[4][2]), (33, "u", rows[4][2]), (None, "u", "n" * 9)]
    return rows + [(34, "u", "日本語" * 40_000), (35, "u", "日本語" * 40_000), rows[2], (1, "u", rows[4][2])]


def test_archives_round_trip(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_pages(df.repartition(3), path)
    read = warc.read_pages(spark, path)
    got = sorted(map(str, [tuple(r) for r in warc.page_digests(read).collect()]))
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if i is not None:
            first[data] = min(i, first.get(data, i))
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = data in first and first[data] != i
        want.append((i, len(data), digest(data), "revisit" if again else "response", first[data] if again else None))
    assert got == sorted(map(str, want))
    payloads = {r["page_id"]: bytes(r["payload"]) for r in read.collect() if r["record_type"] == "response"}
    assert payloads[34] == ("日本語" * 40_000).encode()


def test_missing_segments_and_wrong_lengths_give_no_payload(spark):
    kind = warc.RECORD
    block = b"HTTP/1.1 200 OK\r\n\r\nabcdef"
    parts = []
    for origin, total, numbers in (("a", len(block), (2, 1)), ("b", len(block), (1,)), ("c", 99, (1, 2))):
        for n in numbers:
            parts.append((f"{origin}{n}", "response", 1, None, "", None, origin, n, total if n == 2 else None,
                          bytearray(block[:20] if n == 1 else block[20:])))
    got = {r["record_id"]: r["payload"] for r in warc.reassembled(spark.createDataFrame(parts, kind)).collect()}
    assert bytes(got["a"]) == b"abcdef" and got["b"] is None and got["c"] is None


def test_records_of_plain_and_gzip_files():
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    for content in (record * 2, gzip.compress(record) + gzip.compress(record)):
        assert [b for _, b in warc.records(content)] == [b"ab\r\nc"] * 2
    with pytest.raises(EOFError):
        list(warc.records(record[:-8]))
    assert warc.http_payload(b"H\r\nTransfer-Encoding: chunked\r\n\r\n3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_pages(df, str(tmp_path / "w"))
    assert warc.page_digests(warc.read_pages(spark, str(tmp_path / "w"))).count() == 0
