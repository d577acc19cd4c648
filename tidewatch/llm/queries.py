"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import chat, decontaminate, embeddings, fim, htmltext, mixing, negatives, packing, phrases, secrets, simhash, tokens, toxicity
from tidewatch.llm._common import table


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op2_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.digest(phrases.remove_repeats(table(spark, sf_dir, "documents")))


def op4_html_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return htmltext.extract(pages, htmltext.fit(pages))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.training_order(table(spark, sf_dir, "documents"))


def op7_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")


def op9_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs.select("doc_id", "text", "lang"), toxicity.fit(docs, table(spark, sf_dir, "labels")))
    cut_off = F.col("toxic_score") >= toxicity.CUTOFF
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), F.col("toxic_score").alias("score"), cut_off.cast("int").alias("predicted"), F.col("toxic").alias("over_language_threshold"))


def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op11_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_documents(table(spark, sf_dir, "documents")))


def op12_four_russians_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


def op13_learned_rank_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_ownership, op2_bm25_decontamination, op3_phrase_automata, op4_html_tree_model, op5_simhash_near_dedup,
        op6_training_order, op7_inverted_multi_index, op8_entropy_mixing, op9_toxicity_cnn, op10_perspective_rotation, op11_pattern_packing,
        op12_four_russians_negatives, op13_learned_rank_fim,
    )
}

#: The others train a model, follow links of any length, hash texts or find values of no fixed form.
ORACLE_SQL: dict[str, str] = {"op3_phrase_automata": phrases.ORACLE_SQL, "op10_perspective_rotation": chat.ORACLE_SQL, "op12_four_russians_negatives": negatives.ORACLE_SQL, "op13_learned_rank_fim": fim.ORACLE_SQL}
