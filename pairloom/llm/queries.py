"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.llm import (
    centroids, chat, decontaminate, license_scan, lines, link_trust, near, neighbours, pieces, prefix_trie, secrets_scan, sql,
    suffix_groups, toxicity,
)
from pairloom.llm.common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = link_trust.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "lossless")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat.digests(chat.format_conversations(rows.union(own)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    return toxicity.scored(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= toxicity.CUT).cast("int").alias("predicted"),
    )


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select(
        "doc_id",
        "start",
        F.length("value").alias("length"),
        F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"),
        "score",
        (F.col("score") >= 0.5).alias("secret"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.link(table(spark, sf_dir, "documents"), width=3, percent=85)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_groups.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_chat": op3_chat,
    "op4_toxicity": op4_toxicity,
    "op5_ann": op5_ann,
    "op6_line_dedup": op6_line_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_decontamination": op8_decontamination,
    "op9_license_scan": op9_license_scan,
    "op10_near_dedup": op10_near_dedup,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_centroids": op12_centroids,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE = {
    "op1_url_filter": sql.trust(link_trust.STEPS, link_trust.DAMPING, link_trust.THRESHOLD),
    "op3_chat": sql.CHAT,
    "op6_line_dedup": sql.LINES,
    "op8_decontamination": sql.DECONTAMINATION,
    "op10_near_dedup": sql.NEAR,
    "op11_suffix_dedup": sql.REPEATS,
    "op12_centroids": sql.clusters(),
    "op13_prefix_trie": sql.TRIE,
}
