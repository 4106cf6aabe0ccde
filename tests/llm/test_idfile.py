import zlib

import numpy as np
import pytest

from conftest import edge_rows
from stocklens.llm import idfile
from stocklens.llm.queries import VOCABULARY
from test_bpe import library

END = 2


def test_planes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 1000):
        for top in (1, 200, 50_257, 2**32 - 1):
            ids = rng.integers(0, top, n, dtype=np.uint32, endpoint=True)
            for bits in (False, True):
                assert (idfile.read_block(idfile.block_frame(ids, bits)) == ids).all()
    frame = bytearray(idfile.block_frame(np.arange(1000, dtype=np.uint32)))
    frame[12] ^= 1
    with pytest.raises(Exception):
        idfile.read_block(bytes(frame))


@pytest.mark.parametrize("bits", [False, True])
def test_documents_across_blocks(bits):
    rng = np.random.default_rng(2)
    docs = [(i if i % 5 else None, rng.integers(0, 50_000, int(n), dtype=np.uint32)) for i, n in
            enumerate([0, 3, 100, 1, 0, 64, 63, 65, 500])]
    builder = idfile.FileBuilder(7, bits, block_ids=64)
    frames = [f for d, ids in docs for f in builder.add(d, ids)]
    content = b"".join(f + b"\n" for f in [*frames, *builder.close()])
    got = list(idfile.read_documents(content))
    start = 0
    for (doc_id, ids), (shard, seen, at, back) in zip(docs, got, strict=True):
        assert (shard, seen, at) == (7, doc_id, start) and (ids == back).all()
        start += len(ids)


def test_positions_against_brute_force(spark, edge, empty):
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"])
                  for r in idfile.write_and_read(edge.repartition(4), VOCABULARY, END).collect()), key=lambda r: r[2])
    assert [r[:2] for r in got] == sorted((d is not None, d or 0) for d, *_ in edge_rows())
    start, want = 0, {}
    for text, doc_id in ((r[1] or "", r[0]) for r in edge_rows()):
        data = np.array([*library(text), END], "<u4").tobytes()
        want.setdefault((doc_id is not None, doc_id or 0), []).append((len(data) // 4, zlib.crc32(data)))
    for has, doc_id, at, n, crc in got:
        assert at == start and (n, crc) in want[has, doc_id]
        start += n
    assert idfile.write_and_read(empty, VOCABULARY, END).count() == 0
