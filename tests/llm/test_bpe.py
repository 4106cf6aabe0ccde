import hashlib
import random
import struct

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stocklens.llm import bpe, chunks, idfile
from stocklens.llm.queries import PATTERN, VOCABULARY

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PARTS = list("ab'st 's \n\t\r  　\x1c\x85 éßΩ漢字😀1٢½_-!?") + [
    "<|endoftext|>", " the", "  ", "'ll", " \n", "\0", "ing", "aaaa", "՘", "Ᲊ"]


def texts(n=3000):
    rng = random.Random(2)
    return ["", "a" * 5000, " " * 300] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 16))) for _ in range(n)]


def library(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


def test_both_encoders_equal_the_library():
    for encoder in (bpe._encoder(VOCABULARY, PATTERN), idfile.library_encoder(VOCABULARY)):
        for text, got in zip(texts(), encoder(texts()), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == library(text), repr(text)


def test_kept_pieces_are_bounded():
    encoder = bpe.PieceEncoder(bpe.vocabulary(VOCABULARY, PATTERN).encode_pieces, max_bytes=10)
    for _ in range(2):
        assert [np.frombuffer(d, "<u4").tolist() for d in encoder(texts(200))] == [library(t) for t in texts(200)]


def test_few_kept_pieces_with_cut_ends():
    v = bpe.vocabulary(VOCABULARY, PATTERN)
    some = [" word.", "word,%%%", " it's.", "'s'", " a<|endoftext|>.", "x<|endoftext|>", " é!", " 12)", "Ω.", " ՘.", " ²;", "_.", " $."]
    encoder = bpe.PieceEncoder(v.encode_pieces, max_bytes=2_000, special=v.special)
    for _ in range(2):
        for text, got in zip([*some, *texts(400)], encoder([*some, *texts(400)]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == library(text), repr(text)
    assert encoder.older


def test_pieces_met_again_are_not_encoded_again():
    """Of the kept pieces those in use stay when the memory is full, and an end costs no encoding of its word."""
    v, asked = bpe.vocabulary(VOCABULARY, PATTERN), []

    def encode(pieces):
        asked.extend(pieces)
        return v.encode_pieces(pieces)

    encoder = bpe.PieceEncoder(encode, max_bytes=4_000, special=v.special)
    for i in range(40):
        list(encoder([f"often often, often. now{i} then{i}"]))
    assert sum(p.strip() == "often" for p in asked) == 2 and len(asked) == 2 + 2 + 80


def test_cuts_at_bytes_are_those_of_each_text():
    for some in ([], [""], texts(), ["a b\nc", "", "\n", " é\nΩ ", "a  b c", "x\0y z", "\u3000\x85 a b", "end "]):
        cut, until = chunks.cut_up(some)
        cut, until = cut.to_pylist(), [0, *until.tolist()]
        assert [cut[a:b] for a, b in zip(until, until[1:], strict=False)] == [
            [p for p in chunks.pieces(t) if p] for t in some]


def test_key_table_finds_all_keys_and_no_others():
    keys = np.unique(np.random.default_rng(5).integers(0, 10**9, 5000))
    table = bpe.KeyTable(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    others = np.setdiff1d(np.arange(10**6), keys)
    assert (table.find(others) == -1).all() and table.find(keys[:0]).size == 0


def test_merging_looks_only_new_pairs_up(monkeypatch):
    """Each round asks for the pairs of the tokens just made, not for all that are left."""
    v, asked, find = bpe.vocabulary(VOCABULARY, PATTERN), [], bpe.KeyTable.find
    monkeypatch.setattr(bpe.KeyTable, "find", lambda self, keys: asked.append(len(keys)) or find(self, keys))
    word = "incomprehensibilities" * 20
    token, _ = v.merged([word.encode()])
    assert token.tolist() == library(word) and sum(asked) < 5 * len(word)


def test_verify_encodes_each_text_once(spark):
    df = spark.createDataFrame([("a b",)], "text string")
    ids = bpe.encode(F.col("text"), VOCABULARY, PATTERN)
    out = df.select(ids.alias("ids")).withColumn("back", bpe.decode(F.col("ids"), VOCABULARY, PATTERN))
    assert out._jdf.queryExecution().executedPlan().toString().count("ids(text#") == 1


def test_pair_check_against_merging():
    v, rng = bpe.vocabulary(VOCABULARY, PATTERN), random.Random(3)
    a = np.array([rng.randrange(50_256) for _ in range(3000)])
    b = np.array([rng.randrange(300) if i % 2 else rng.randrange(50_256) for i in range(3000)])
    token, word = v.merged([v.bytes_of[x] + v.bytes_of[y] for x, y in zip(a, b, strict=True)])
    for i, fine in enumerate(v.compatible(a, b)):
        assert fine == (token[word == i].tolist() == [a[i], b[i]])


def test_decoding_equals_the_library():
    v, rng = bpe.vocabulary(VOCABULARY, PATTERN), random.Random(4)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(50_257), 50_256, rng.randrange(256)]) for _ in range(rng.randint(0, 9))]
        assert v.decode(np.array(ids, "<u4").tobytes()) == TOKENIZER.decode(ids, skip_special_tokens=False)


def test_columns_round_trip(spark, edge, empty):
    out = edge.select("text", bpe.encode(F.col("text"), VOCABULARY, PATTERN).alias("ids"))
    out = out.withColumn("back", bpe.decode(F.col("ids"), VOCABULARY, PATTERN)).collect()
    assert all(r["back"] == (r["text"] or "") for r in out)
    assert empty.select(bpe.encode(F.col("text"), VOCABULARY, PATTERN)).count() == 0
    digest = hashlib.sha256(struct.pack("<1I", 64)).hexdigest()
    one = spark.createDataFrame([("a",)], "text string").select(F.sha2(bpe.encode(F.col("text"), VOCABULARY, PATTERN), 256))
    assert one.first()[0] == digest
