"""A training corpus from `documents`: each stage calls one operator and reads what its predecessor kept.

Defined cases, of every stage: an empty table stays empty; null ids, null or empty texts, and rows that repeat an id or all
columns are rows like any other, told apart by a hash of all columns; columns other than those of documents are dropped;
texts of any length are read whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, mixing, simhash, tokens, toxicity
from tidewatch.llm._common import cut, table, written

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Without labels of both classes it rejects none; rows without words, and rows of one
    text and language, share their fate."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs.select(DOCUMENT), model).where("not toxic").select(DOCUMENT)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with row, a hash of all columns, which joins back what was found out about a row: ids may be null or repeated.
    It needs no copy of the texts. Rows that are equal in all columns share it; others do by a collision of 64 bits only, of
    which some n^2 / 2^65 are to be expected among n rows."""
    return docs.select(DOCUMENT).withColumn("row", F.xxhash64(*DOCUMENT, *(F.col(c).isNull() for c in DOCUMENT)))


def taken(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """keys: (row, n, times). The rows of docs, the n equal ones of a key together `times` times."""
    keys = cut(keys)

    def repeated(rows: DataFrame) -> DataFrame:
        return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(DOCUMENT)

    out = repeated(docs.join(keys.where("n = 1"), "row"))
    if keys.where("n > 1").isEmpty():
        return out
    return out.unionAll(repeated(docs.join(keys.where("n > 1"), "row").distinct()))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that of the least id (null last), of repeated ids that of the least
    hash of its columns. All texts without words are one group."""
    docs = keyed(docs)
    rows = docs.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    groups = simhash.near_duplicates(docs, id_col="row").groupBy("row").agg(F.min("component_id").alias("component_id"))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "n")).alias("first")
    return taken(docs, groups.join(rows, "row").groupBy("component_id").agg(least).select("first.row", "first.n", F.lit(1).alias("times")))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a test item go; others of the same id stay. An empty benchmark takes none."""
    docs = keyed(docs)
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), id_col="row").select("row").distinct()
    return docs.join(leaks, "row", "left_anti").select(DOCUMENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row is repeated as often as the mix takes it, MOST times at most; rows that repeat an id have copies of their own.
    Texts without words are not taken."""
    docs = keyed(docs)
    copies = mixing.mix_sources(docs, carry=("row",)).groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("times"))
    return taken(docs, copies.where("times > 0"))


def order_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every sequence at its place in the training order; copies of a row have sequences and slots of their own."""
    return tokens.training_order(docs)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix), ("training_order", order_tokens)]

#: A trained model, graph components, WAND and a tokenizer are beyond SQL.
ORACLE_SQL = None


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STAGES[-1][1](spark, mixed(spark, sf_dir), sf_dir)


def write(spark: SparkSession, sf_dir: str, path: str, overwrite: bool = False) -> int:
    """run's sequences as fixed-stride shards under path, for training to read by offset; returns how many this run wrote."""
    return tokens.write_shards(mixed(spark, sf_dir), path, overwrite=overwrite)
