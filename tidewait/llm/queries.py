"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewait.llm import chat, decontaminate, divergence, jaccard, language, lines, mixing, negatives, oracles, packing, quality, sharding, suffixes, topk

SHARD_BYTES = 1 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_common_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))
    ranges = F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string")))
    return out.select(
        "conv_id", "speaker", "block", "part", "n_turns", "n_own", F.sha2("text", 256).alias("text_sha256"),
        F.sha2(F.array_join(ranges, ","), 256).alias("mask_sha256"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated")
    )


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pareto_mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", "taken"
    )


def op6_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.robust_outliers(_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.drop_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op9_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack_tokens(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return packed.withColumn("ids_sha256", F.sha2("ids", 256)).drop("ids")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs.filter(~language.held_out(F.col("doc_id")))))


def op11_uniform_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_gnat_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, shifted)


def op13_transducer_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_perspective_rotation": op2_perspective_rotation,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_pareto_mix": op5_pareto_mix,
    "op6_mcd_outliers": op6_mcd_outliers,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_extendible_shards": op8_extendible_shards,
    "op9_packed_tokens": op9_packed_tokens,
    "op10_language_id": op10_language_id,
    "op11_uniform_threshold_topk": op11_uniform_threshold_topk,
    "op12_gnat_hard_negatives": op12_gnat_hard_negatives,
    "op13_transducer_divergence": op13_transducer_divergence,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": oracles.LINES,
    "op2_perspective_rotation": oracles.CHAT,
    "op3_jaccard_join": oracles.JACCARD,
    "op4_benchmark_decontamination": oracles.CONTAMINATION,
    "op5_pareto_mix": oracles.MIX,
    "op7_suffix_dedup": oracles.REPEATS,
    "op8_extendible_shards": oracles.shards_sql(SHARD_BYTES),
    "op11_uniform_threshold_topk": oracles.TOP_K,
    "op12_gnat_hard_negatives": oracles.HARD_NEGATIVES,
    "op13_transducer_divergence": oracles.DIVERGENCE,
}
