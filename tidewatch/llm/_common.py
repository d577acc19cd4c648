"""What the operators of this subpackage share: cutting lineage, word splitting, graph components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a
    folder of its own; on a cluster it is an error, as executors would each write to their own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that later steps neither recompute it nor depend on one executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As cut, but as a compressed Parquet table: for large rows. Once it is written, the shuffle files that led to it are
    let go, rather than when the driver happens to collect its garbage. The table is deleted when the application ends."""
    spark, let_go = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(let_go)
    spark.conf.set(let_go, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(let_go, before)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attach(rows: DataFrame, facts: DataFrame, key: str | list[str], n_col: str, total: int, how: str = "inner", least: int = 10_000) -> DataFrame:
    """rows joined to facts (one row for each key) by key. n_col of facts is how many rows hold the key, of `total`.

    Keys of over total / 10,000 rows (and over `least`) are fewer than 10,000, so these are broadcast: their rows are joined
    where they lie, and no task gathers a hot key. All others are joined by a shuffle. n_col is dropped."""
    limit = max(least, total // 10_000)
    if total <= limit:  # no key can have more
        return rows.join(facts.drop(n_col), key, how)
    hot = F.col(n_col) > limit
    heavy = facts.where(hot).drop(n_col)
    light = rows.join(F.broadcast(heavy.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(facts.where(~hot).drop(n_col), key, how)
    return rows.join(F.broadcast(heavy), key).unionByName(light)


def running(rows: DataFrame, order: list, sums: list[str], n: int, part_rows: int = 50_000) -> DataFrame:
    """rows with before_<c> for each c of sums: its sum over all rows that come before in the total order `order`.

    The n rows are dealt into ranges of about part_rows, summed within each, and moved by what the ranges before hold;
    one small row for each range is all that meets in one task."""
    ranges = max(1, -(-n // part_rows))
    placed = cut(rows.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    heads = placed.groupBy("__range").agg(*(F.sum(c).alias(c) for c in sums))
    heads = heads.select("__range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in sums))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}).join(F.broadcast(heads), "__range")
    return out.withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"__{c}") for c in sums}).drop("__range", *(f"__{c}" for c in sums))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph given as longs (a, b); returns (node, component), the component being
    its smallest node. Alternating large-star and small-star steps: each keeps the components, and the graph becomes
    one star for each component after O(log^2 n) rounds. The join that hands a node its minimum spreads hubs of
    any degree over tasks. Loops and repeated edges are allowed; no edges give no rows.
    """

    def least(rows: DataFrame, n: int) -> DataFrame:
        """rows (u, v) with the least v of each u as m."""
        return attach(rows, rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "u", "n", n)

    def mark(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())

    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = mark(now)
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = least(both, 2 * before[0]).where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
        small = least(large.select(F.col("a").alias("u"), F.col("b").alias("v")), before[0])
        now = cut(small.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct())
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
