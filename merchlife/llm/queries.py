"""The registered queries of the operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlife.llm import bitplanes, decontam, divergence, langid, mergedfa, neardup, permindex, pieces, records, rollups, secrets, sharding, urlfilter
from merchlife.llm.storage import Workspace


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_permutation_index(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return permindex.search(vectors, vectors.where("vec_id % 100 = 0"))


def op2_token_records(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return records.digests(records.tokenized(_table(spark, folder, "documents"), path, end_id=2))


def op3_label_propagation(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, folder, "documents"), shards=40)


def op4_positional_index(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.drop("key")


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(_table(spark, folder, "documents"))


def op6_dart_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.classes(_table(spark, folder, "documents")).select("doc_id", "class_id", "keep")


def op7_merge_dropout(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.predict_languages(_table(spark, folder, "documents"))


def op9_token_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents are counted and inserted; copies of a text are deleted but for the least id; texts with
    white space to spare are trimmed and their counts revised; what is left and not English, or of no
    language, moves to the tokenizer for many languages, under its version; the deletions are sent twice.
    Returns the totals."""
    docs = _table(spark, folder, "documents")
    space = Workspace(spark, "rollup")
    one, many = (public_tokenizers.path(f"byte_bpe_{x}.tiktoken") for x in ("50k", "multi_50k"))
    counted = lambda rows, path: rollups.count_tokens(rows, path, public_tokenizers.PATTERN)
    rollup = rollups.Rollup(spark, f"{space.path}/totals")
    rollup.commit("load", rollups.events(counted(docs, one), "insert", "byte_bpe_50k"))
    named = docs.select("doc_id", "source", "lang", F.md5("text").alias("copy")).where("copy is not null")
    # Written first, so that the join shuffles for itself and adaptive execution can split a text with many copies.
    least = space.save(named.groupBy("copy").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("copy", "least"), "least")
    copies = space.save(named.join(least, "copy").where("doc_id <> least").select("doc_id", "source", "lang").distinct(), "copies")
    deletes = rollups.events(copies, "delete", "byte_bpe_50k")
    rollup.commit("copies", deletes)
    left = docs.join(copies.select("doc_id"), "doc_id", "left_anti")
    trimmed = left.withColumn("was", F.col("text")).withColumn("text", F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")))
    rollup.commit("trimmed", rollups.events(counted(trimmed.where("text <> was"), one), "revise", "byte_bpe_50k"))
    other = trimmed.where("not lang <=> 'en'")
    moved = rollups.events(other, "delete", "byte_bpe_50k").union(rollups.events(counted(other, many), "insert", "byte_bpe_multi_50k"))
    rollup.commit("languages", moved)
    rollup.commit("copies", deletes)
    return rollup.totals()


def op10_redirect_equivalence(spark: SparkSession, folder: str) -> DataFrame:
    return urlfilter.judge(_table(spark, folder, "pages"))


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(_table(spark, folder, "documents"))


def op12_merge_automaton(spark: SparkSession, folder: str) -> DataFrame:
    return mergedfa.digests(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_bitplane_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    return bitplanes.cluster(_table(spark, folder, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_permutation_index,
        op2_token_records,
        op3_label_propagation,
        op4_positional_index,
        op5_secret_scan,
        op6_dart_minhash,
        op7_merge_dropout,
        op8_language_id,
        op9_token_rollup,
        op10_redirect_equivalence,
        op11_source_divergence,
        op12_merge_automaton,
        op13_bitplane_kmeans,
    )
}
ORACLES = {
    "op4_positional_index": decontam.oracle(),
    "op5_secret_scan": secrets.oracle(),
    "op10_redirect_equivalence": urlfilter.oracle(),
    "op11_source_divergence": divergence.oracle(),
    "op13_bitplane_kmeans": bitplanes.oracle(),
}
