"""Registered queries of the operators: thin calls over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..session import scratch_path
from . import bpe, chat, clusters, idfile, licenses, mixing, neardup, quality, runs, shards, syncmers, toxicity, warc
from .common import WORD, stored, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
END_ID = 2
LLM_QUERIES = {}


def query(fn):
    LLM_QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mix_sources(spark, sf):
    mixed = mixing.mix(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


@query
def op2_license_scan(spark, sf):
    return licenses.scan(table(spark, sf, "documents"))


@query
def op3_warc_segments(spark, sf):
    path = scratch_path(spark, "warc")
    warc.write_pages(table(spark, sf, "pages"), path)
    return warc.page_digests(warc.read_pages(spark, path))


@query
def op4_dart_near_duplicates(spark, sf):
    return neardup.near_duplicates(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "class_id")


@query
def op5_chat_format(spark, sf):
    return chat.format_chats(table(spark, sf, "conversations"))


@query
def op6_bpe_verify(spark, sf):
    docs = table(spark, sf, "documents")
    encoded = docs.select("doc_id", bpe.encode(F.col("text"), VOCABULARY, PATTERN).alias("ids"))
    decoded = encoded.withColumn("decoded", bpe.decode(F.col("ids"), VOCABULARY, PATTERN))
    return decoded.select(
        "doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op7_string_kernel_toxicity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = toxicity.with_scores(docs, toxicity.train(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op8_plane_files(spark, sf):
    return idfile.write_and_read(table(spark, sf, "documents").select("doc_id", "text"), VOCABULARY, END_ID)


@query
def op9_quality_rules(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    scored = stored(quality.with_base_rules(docs).drop("text"), "quality")
    kept = quality.with_host_verdicts(scored)
    return kept.select("doc_id", *[f"rules.{c}" for c in quality.COUNTS], "rules.base_failed", "kept")


@query
def op10_syncmer_fingerprints(spark, sf):
    return syncmers.fingerprint_pairs(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op11_ns_bounds_clusters(spark, sf):
    placed, centroids = clusters.cluster(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    return clusters.with_inertia(placed, centroids)


def with_planted_runs(docs):
    """``docs`` (doc_id, text) with a periodic end of the texts whose id's hash is a multiple of ten; a null id has none."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.expr("h div 10")
    rows = docs.select("*", h.alias("h")).withColumn("w", F.when(
        F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    n = F.size("w")
    at = F.when(n > 0, g % n).cast("int")
    step = F.expr("(n - start) div (3 + (h div 10) % 8) + 1").cast("int")
    rows = rows.withColumn("n", n).withColumn("start", at).withColumn("step", step)
    # No lambdas here: Spark cannot evaluate a Python function of an expression that holds one.
    turns = F.array_repeat(F.slice("w", F.col("start") + 1, F.col("step")), F.expr("(n - start) div step + 1").cast("int"))
    end = F.slice(F.flatten(turns), F.lit(1), F.col("n") - F.col("start"))
    text = F.when(n > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("start")), end), " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


@query
def op12_periodic_runs(spark, sf):
    docs = with_planted_runs(table(spark, sf, "documents").select("doc_id", "text"))
    found = docs.select("doc_id", runs.periodic_runs(F.col("text")).alias("r"))
    best = runs.strongest(F.col("r.runs"))
    found = found.select("doc_id", "r", best.alias("b"))
    return found.select(
        "doc_id", F.size("r.runs").cast("long").alias("n_runs"), "b.start", "b.length", "b.period",
        F.expr("1000 * b.length div b.period").alias("exponent_milli"),
        F.sha2(runs.runs_text(F.col("r.runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("r.collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query
def op13_sampled_splitters(spark, sf):
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_key"))
    placed = shards.shard(docs, ["text_key"], ["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "placed.shard", "placed.slot",
                         F.lit(None).cast("int").alias("grown_shard"))
