"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import byte_bpe, chat, collocations, fingerprint, hmm_lm, mixing, near_dedup, quality, ranked_search, token_counts, token_store, vafile, warc
from .common import crc32_mod, new_path, stage, table


def op1_token_store(spark, sf_dir):
    path = new_path(spark, "tokens")
    token_store.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_store.read(spark, path, with_ids=False)


def op2_byte_bpe(spark, sf_dir):
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_exact_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vafile.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op4_chat_format(spark, sf_dir):
    rows = chat.format_conversations(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "n_turns", F.length("rendered").cast("long").alias("n_chars"), F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"))


def op5_near_dedup(spark, sf_dir):
    return near_dedup.dedup(table(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc32_mod(F.col("doc_id"), 3) == 1
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_fingerprints(spark, sf_dir):
    return fingerprint.with_next(table(spark, sf_dir, "documents"))


def op8_hmm_lm(spark, sf_dir):
    return hmm_lm.score(table(spark, sf_dir, "documents"), crc32_mod(F.col("doc_id"), 5) == 1)


def op9_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_warc(spark, sf_dir):
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    rows = warc.captures(stage(warc.read_records(spark, path), "warc-records"))  # each archive is read once
    return rows.select("metadata.page_id", "response.payload_bytes", "response.payload_digest", "response.record_type", "response.refers_to")


def op11_token_counts(spark, sf_dir):
    return token_counts.count(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_ranked_search(spark, sf_dir):
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_store, op2_byte_bpe, op3_exact_top_k, op4_chat_format, op5_near_dedup, op6_quality, op7_fingerprints, op8_hmm_lm, op9_mix_sources, op10_warc, op11_token_counts, op12_ranked_search, op13_collocations)}

ORACLES = {
    "op3_exact_top_k": vafile.SQL,
    "op4_chat_format": chat.SQL,
    "op5_near_dedup": near_dedup.SQL,
    "op10_warc": warc.SQL,
    "op12_ranked_search": ranked_search.SQL,
    "op13_collocations": collocations.SQL,
    "op9_mix_sources": f"SELECT doc_id, size, source_size, target, size * copies AS taken FROM ({mixing.SQL.format(docs='documents')})",
}
