"""Registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobloom.llm import (
    codes, decontaminate, importance, linejoin, lines, lm, mixing, packing, quality, simhash, substrings, tokens, topk)
from jobloom.llm.common import read, staged


def op1_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_texts(read(spark, folder, "documents").select("doc_id", "text"), *tokens.public_ranks())


def op2_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = linejoin.drop_near_lines(read(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "near_lines.n_lines", F.size("near_lines.removed").alias("n_removed"),
        F.array_join("near_lines.removed", ",").alias("removed"))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = staged(read(spark, folder, "documents").select(
        "doc_id", "source", mixing.word_count(F.col("text")).alias("words")))
    mixed = mixing.mix(docs, size=F.col("words"))
    position = F.try_element_at("mix.uses", F.lit(1))["position"]
    return mixed.select(
        "doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", position.alias("position"),
        F.coalesce(position, 1 + F.col("mix.place")).alias("at"),  # those not taken come last
    ).repartitionByRange("at", "doc_id").sortWithinPartitions("at", "doc_id").drop("at")


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.decontaminate(
        read(spark, folder, "documents").select("doc_id", "text"), read(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "contamination.n_words", "contamination.n_hit",
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"),
        (F.col("contamination.n_hit") > 0).alias("contaminated"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, folder, "labels"))
    return quality.classify(docs, model).select(
        "doc_id", (quality.fold(F.col("doc_id")) == 0).alias("held_out"), "quality_model.score", "quality_model.predicted")


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_copies(read(spark, folder, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_substrings(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.drop_repeats(read(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "substrings.n_bytes",
        (F.col("substrings.n_bytes") - F.octet_length("substrings.kept")).alias("n_removed"),
        F.size("substrings.starts").cast("long").alias("n_spans"),
        F.sha2("substrings.kept", 256).alias("kept_sha256"))


def op8_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(read(spark, folder, "documents"), *tokens.public_ranks())


def op9_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.integers(read(spark, folder, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op10_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.drop_repeats(read(spark, folder, "documents").select("doc_id", "text"))
    spans = F.arrays_zip("dedup.removed_starts", "dedup.removed_ends")
    size = F.transform(spans, lambda s: s["removed_ends"] - s["removed_starts"])
    return found.select(
        "doc_id", "dedup.n_units", F.size("dedup.removed_starts").alias("n_removed"),
        F.aggregate(size, F.lit(0), lambda a, b: a + b).alias("removed_chars"),
        F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["removed_starts"], s["removed_ends"])), ","
                     ).alias("removed"),
        F.sha2(F.coalesce("dedup.kept_text", F.lit("")), 256).alias("kept_sha256"))


def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = importance.importance(docs, read(spark, folder, "benchmark"))
    return importance.draw(found.drop("text")).select(
        "doc_id", "importance.n_features", "importance.weight", "importance.score", "importance.rank")


def op12_codes(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    books = codes.train(vectors)
    found = staged(codes.encode(vectors, books).select("vec_id", "label", "code.codes", "code.error"))
    by_label = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digits = F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    return found.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", F.array_join(digits, "").alias("code"), "error", "label_error",
        F.lit(codes.digest(books)).alias("codebooks_sha256"))


def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = packing.pieces(docs, packing.public_vocabulary()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place(staged(found)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm": op1_lm,
    "op2_lines": op2_lines,
    "op3_mixing": op3_mixing,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_substrings": op7_substrings,
    "op8_tokens": op8_tokens,
    "op9_topk": op9_topk,
    "op10_lines": op10_lines,
    "op11_importance": op11_importance,
    "op12_codes": op12_codes,
    "op13_packing": op13_packing,
}
