"""Token-id files: bit-plane or byte-plane shuffled blocks with a chunk index.

A file is a run of frames, each ended by a line feed.  Block frames hold a fixed number
of ids, transposed into planes and compressed plane by plane with zstandard; the last
frame is the index: where each block lies and how many ids each document has.  Frames
are written and read by Spark, so any file system that Spark knows will do, and a lost
task leaves no part of a file behind.

    block   b"IDB1", ids u32, planes u8, kind u8 (0 byte planes, 1 bit planes),
            crc32 u32 of the ids, one length u32 per plane, the planes
    index   zstandard of: b"IDX1", shard u32, blocks u32, documents u64,
            (offset u64, length u32, ids u32) per block, doc_ids i64 and id counts u64
            and a byte per document that is 1 where doc_id is null
    end     length of the index u32, b"IDE1"
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .chunks import PieceEncoder
from .common import stored

BLOCK_IDS = 65_536
LEVEL = 3
CHAIN = 64          # pieces encoded one behind the other
BLOCK_HEAD, INDEX_HEAD, END = struct.Struct("<4sIBBI"), struct.Struct("<4sIIQ"), struct.Struct("<I4s")
BLOCK_ENTRY = np.dtype([("offset", "<u8"), ("length", "<u4"), ("ids", "<u4")])


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block, lowest first; as many as its largest id needs."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    if bits:
        return [np.packbits((ids >> p & 1).astype(np.uint8), bitorder="little").tobytes() for p in range(max(top, 1))]
    planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [planes[:, p].tobytes() for p in range(max(-(-top // 8), 1))]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    out = np.zeros(n, dtype="<u4")
    for p, plane in enumerate(planes):
        if bits:
            values = np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=n, bitorder="little")
        else:
            values = np.frombuffer(plane, dtype=np.uint8)
        out |= values.astype("<u4") << (p if bits else 8 * p)
    return out


def block_frame(ids: np.ndarray, bits: bool = False, level: int = LEVEL) -> bytes:
    press = zstandard.ZstdCompressor(level=level)
    planes = [press.compress(p) for p in to_planes(ids, bits)]
    head = BLOCK_HEAD.pack(b"IDB1", len(ids), len(planes), int(bits), zlib.crc32(ids.astype("<u4").tobytes()))
    return b"".join([head, struct.pack(f"<{len(planes)}I", *map(len, planes)), *planes])


def read_block(frame: bytes) -> np.ndarray:
    magic, n, count, bits, crc = BLOCK_HEAD.unpack_from(frame)
    at = BLOCK_HEAD.size + 4 * count
    planes, expand = [], zstandard.ZstdDecompressor()
    for length in struct.unpack_from(f"<{count}I", frame, BLOCK_HEAD.size):
        planes.append(expand.decompress(frame[at:at + length]))
        at += length
    ids = from_planes(planes, n, bool(bits))
    if magic != b"IDB1" or zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("damaged block of token ids")
    return ids


class FileBuilder:
    """Frames of one file from its documents' ids in order."""

    def __init__(self, shard: int, bits: bool = False, block_ids: int = BLOCK_IDS):
        self.shard, self.bits, self.block_ids = shard, bits, block_ids
        self.waiting, self.size, self.offset = [], 0, 0
        self.blocks: list[tuple[int, int, int]] = []
        self.doc_ids: list[int] = []
        self.nulls: list[int] = []
        self.counts: list[int] = []

    def _frame(self, ids: np.ndarray) -> bytes:
        frame = block_frame(ids, self.bits)
        self.blocks.append((self.offset, len(frame), len(ids)))
        self.offset += len(frame) + 1
        return frame

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[bytes]:
        self.doc_ids.append(0 if doc_id is None else doc_id)
        self.nulls.append(int(doc_id is None))
        self.counts.append(len(ids))
        self.waiting.append(ids)
        self.size += len(ids)
        if self.size >= self.block_ids:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // self.block_ids * self.block_ids
            for at in range(0, whole, self.block_ids):
                yield self._frame(ids[at:at + self.block_ids])
            self.waiting, self.size = [ids[whole:]], len(ids) - whole

    def close(self) -> Iterator[bytes]:
        if self.size:
            yield self._frame(np.concatenate(self.waiting))
        parts = [INDEX_HEAD.pack(b"IDX1", self.shard, len(self.blocks), len(self.doc_ids)),
                 np.array(self.blocks, dtype=BLOCK_ENTRY).tobytes(), np.array(self.doc_ids, dtype="<i8").tobytes(),
                 np.array(self.counts, dtype="<u8").tobytes(), np.array(self.nulls, dtype="u1").tobytes()]
        index = zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(parts))
        yield index + END.pack(len(index), b"IDE1")


def read_index(content: bytes):
    """shard, blocks, doc_ids, counts, nulls of a file."""
    length, magic = END.unpack_from(content, len(content) - 1 - END.size)
    if magic != b"IDE1":
        raise ValueError("no token-id file")
    end = len(content) - 1 - END.size
    index = zstandard.ZstdDecompressor().decompress(content[end - length:end])
    _, shard, blocks, docs = INDEX_HEAD.unpack_from(index)
    at = INDEX_HEAD.size
    out = [shard]
    for kind, n in ((BLOCK_ENTRY, blocks), ("<i8", docs), ("<u8", docs), ("u1", docs)):
        out.append(np.frombuffer(index, dtype=kind, count=n, offset=at))
        at += out[-1].nbytes
    return out


def read_documents(content: bytes) -> Iterator[tuple[int, int | None, int, np.ndarray]]:
    """(shard, doc_id, start within the file, ids) of each document of a file."""
    shard, blocks, doc_ids, counts, nulls = read_index(content)
    waiting, start, nxt = np.zeros(0, dtype="<u4"), 0, 0
    for doc_id, n, null in zip(doc_ids.tolist(), counts.tolist(), nulls.tolist(), strict=True):
        parts, have = [waiting], len(waiting)
        while have < n:
            offset, length, _ = blocks[nxt].tolist()
            parts.append(read_block(content[offset:offset + length]))
            have, nxt = have + len(parts[-1]), nxt + 1
        ids = np.concatenate(parts) if len(parts) > 1 else waiting
        yield shard, None if null else doc_id, start, ids[:n]
        waiting, start = ids[n:], start + n


@lru_cache(maxsize=4)
def library_encoder(path: str) -> PieceEncoder:
    """Texts to ids with the tokenizers library, each distinct piece once.

    Pieces that begin with a space and end with no white space are encoded many in one
    call, one behind the other; the bytes of the tokens tell where a piece ends.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = {t.content: len(t.content.encode()) for t in tokenizer.get_added_tokens_decoder().values()}
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    token_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
    for token, i in vocabulary.items():
        token_bytes[i] = special.get(token, len(token))    # one symbol stands for a byte

    def ids_of(texts: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, dtype="<u4") for at in range(0, len(texts), 256)
                for found in tokenizer.encode_batch_fast(texts[at:at + 256], add_special_tokens=False)]

    def encode(texts: list[str]) -> list[bytes]:
        chained = [t for t in texts if t[:1] == " " and len(t) > 1 and not t[-1].isspace()]
        chains = [chained[at:at + CHAIN] for at in range(0, len(chained), CHAIN)]
        out = {}
        joined = ["".join(part) for part in chains]
        for part, text, ids in zip(chains, joined, ids_of(joined), strict=True):
            ends = np.cumsum(token_bytes[ids])
            sizes = map(len, part) if text.isascii() else (len(t.encode()) for t in part)
            want = np.cumsum(np.fromiter(sizes, dtype=np.int64, count=len(part)))
            cuts = np.searchsorted(ends, want, side="left")
            if (ends[np.minimum(cuts, len(ends) - 1)] != want).any():
                continue                                   # not a byte-level vocabulary
            data, stops = ids.tobytes(), (4 * (cuts + 1)).tolist()
            out |= {t: data[a:b] for t, a, b in zip(part, [0, *stops], stops, strict=False)}
        alone = [t for t in texts if t not in out]
        out |= {t: ids.tobytes() for t, ids in zip(alone, ids_of(alone), strict=True)}
        return [out[t] for t in texts]

    return PieceEncoder(encode, special=special)


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int, bits: bool = False,
              shards: int | None = None) -> None:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order (null first) to ``path``.

    Each document's ids end with ``end_id``; null and empty texts have that alone.  Rows
    of one doc_id are ordered by the hash of their text.  Ranges of the order become
    files, as many as the input has splits unless ``shards`` says otherwise, so files
    stay near the split size.
    """
    n = shards or max(1, docs.rdd.getNumPartitions())
    key = F.xxhash64("text")
    ordered = (docs.select("doc_id", "text", key.alias("text_key")).repartitionByRange(n, "doc_id", "text_key")
                   .sortWithinPartitions("doc_id", "text_key").select("doc_id", "text"))

    def frames(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, last = library_encoder(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        builder = None
        for batch in batches:
            if builder is None:
                builder = FileBuilder(TaskContext.get().partitionId(), bits)
            found = []
            ids = [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
            for doc_id, data in zip(ids, encode(batch["text"]), strict=True):
                found += builder.add(doc_id, np.frombuffer(data + last, dtype="<u4"))
                if len(found) >= 16:
                    yield pd.DataFrame({"frame": found})
                    found = []
            yield pd.DataFrame({"frame": found}, dtype=object)
        if builder is not None:
            yield pd.DataFrame({"frame": list(builder.close())})

    (ordered.mapInPandas(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
            .write.option("lineSep", "\n").text(path))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Rows (shard, doc_id, start, ids) of the files: ids as binary, ``start`` within its file."""
    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                out, size = [], 0
                for shard, doc_id, start, ids in read_documents(content) if len(content) else ():
                    out.append((shard, doc_id, start, ids.tobytes()))
                    size += len(ids)
                    if size > 4_000_000:
                        yield _frame(out)
                        out, size = [], 0
                yield _frame(out)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(rows, "shard long, doc_id long, start long, ids binary")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["shard", "doc_id", "start", "ids"])
    return out.astype({"shard": "int64", "doc_id": "Int64", "start": "int64"})


def positions(read: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of ``read_ids``; ``start`` counts all ids before.

    The sum over earlier files runs over one row per file.
    """
    narrow = stored(read.select("shard", "doc_id", "start", F.expr("length(ids) div 4").alias("n_tokens"),
                                F.crc32("ids").alias("ids_crc32")), "id-positions")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = narrow.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    offsets = totals.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return narrow.join(offsets, "shard").select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, vocabulary: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write ``docs`` to id files in the shared folder and return their positions read back."""
    path = path or scratch_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, vocabulary, end_id)
    return positions(read_ids(docs.sparkSession, path))
