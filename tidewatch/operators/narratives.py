"""Narratives: summaries of clusters, revisions, dominant ones, graph snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exprs import cosine, uuid5
from tidewatch.operators import serving, text


#: Queries of a block that are compared at once.
SLICE = 128


def centroids(members: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """The mean of each group's vectors, of length 1 (0 where it has none): a row for each dimension (group, i, value), so vectors
    of any length do and no group is gathered."""
    each = members.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("m"))
    size = each.groupBy(group).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("__size"))
    return each.join(size, group).select(group, "i", F.when(F.col("__size") > 0, F.col("m") / F.col("__size")).otherwise(0.0).alias("value"))


def similarities(members: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """Adds the similarity of each member to its group's centroid. The centroid is an average for each dimension, taken by
    place, so vectors of any length do and no group is gathered."""
    each = members.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("m"))
    centroid = each.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda c: c["m"]).alias("__centroid"))
    return members.join(centroid, group).withColumn("similarity", cosine(F.col(vector), F.col("__centroid"))).drop("__centroid")


def _unit(cell: pa.Array | pa.Scalar, rows: int) -> np.ndarray:
    """Vectors of one length, each divided by its size; zero vectors stay."""
    x = cell.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _in_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows: g, id, v. Adds the pivot of least angle, and the angle (0 for a zero vector, which is similar to nothing)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _unit(b.column("v"), b.num_rows)
                s = x @ pivots.T
                best = s.argmax(axis=1)
                angle = np.where(np.any(x, axis=1), np.arccos(np.clip(s[np.arange(len(x)), best], -1, 1)), 0.0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best.astype(np.int32)), pa.array(angle)], names=[*b.schema.names, "pivot", "angle"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(place, f"{kinds}, pivot int, angle double")


def _best(ids: np.ndarray, x: np.ndarray, own: np.ndarray, y: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each query (ids, x) its k most similar of a block (own, y). Similarities of a slice of queries are held at a time."""
    for at in range(0, len(ids), SLICE):
        s = x[at : at + SLICE] @ y.T
        np.clip(s, 0, 1, out=s)
        s[ids[at : at + SLICE, None] == own[None]] = -1
        for i, q in enumerate(ids[at : at + SLICE]):
            j = np.lexsort((own, -s[i]))[:k]
            j = j[s[i][j] >= 0]
            yield np.full(len(j), q), own[j], s[i][j]


def _compared(met: DataFrame, k: int) -> DataFrame:
    """met: q_rows, v_rows, blocks of (id, v). Each query's k most similar of a block: query_id, id, similarity."""

    def unpacked(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        rows = cell.values
        return rows.field("id").to_numpy(zero_copy_only=False), _unit(rows.field("v"), len(rows))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                (ids, x), (own, y) = unpacked(b.column(0)[r]), unpacked(b.column(1)[r])
                best = zip(*_best(ids, x, own, y, k), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in best], names=["query_id", "id", "similarity"])

    return met.select("q_rows", "v_rows").mapInArrow(compare, "query_id long, id long, similarity double")


def _searched(queries: DataFrame, vectors: DataFrame, k: int, block: int, vector: str, within: tuple[str, ...], where: Column | None, pivots: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The queries with the cells that each must visit (need), the blocks of the vectors, and the cells' radii."""
    group = F.to_json(F.struct(*within)) if within else F.lit("")
    plain = lambda rows: rows.where(F.col("id").isNotNull() & F.col(vector).isNotNull()).select(group.alias("g"), "id", F.col(vector).cast("array<double>").alias("v"))
    asked, held = plain(queries), plain(vectors if where is None else vectors.where(where))
    # Of bounded size: a few vectors by a hash of the id, the first of each key of the sort.
    chosen = held.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id", "v").limit(pivots).select("v").collect()
    x = np.array([r["v"] for r in chosen], float)
    if not len(x):
        x = np.zeros((1, len((asked.select("v").first() or [[0.0]])[0])))
    size = np.linalg.norm(x, axis=1, keepdims=True)
    units = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    placed = _in_cells(held, units)
    cells = placed.groupBy("g", "pivot").agg(F.max("angle").alias("radius"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    dealt = placed.join(cells.select("g", "pivot", "parts"), ["g", "pivot"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    blocks = dealt.groupBy("g", "pivot", "part").agg(F.collect_list(F.struct("id", "v")).alias("v_rows"))
    # First each query's own cell, one part of it: its k-th similarity there is a bound from below on that of all.
    own = _in_cells(asked, units).join(cells.select("g", "pivot", "parts"), ["g", "pivot"], "left")
    first = own.where("parts is not null").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, -(-asked.count() // block)))))
    met = first.groupBy("g", "pivot", "part", "chunk").agg(F.collect_list(F.struct("id", "v")).alias("q_rows")).join(blocks, ["g", "pivot", "part"])
    bound = _compared(met, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), "least")
    # No row of `cells` of a group is longer than the number of pivots.
    reach = cells.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("pivot", "radius"))).alias("reach"))
    tests = asked.join(bound.dropDuplicates(["id"]), "id", "left").select("g", "id", "v", F.coalesce("least", F.lit(-1.0)).alias("least")).join(reach, "g")

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = _unit(b.column("v"), b.num_rows) @ units.T
                need = []
                for i, (least, cell) in enumerate(zip(b.column("least").to_pylist(), b.column("reach"), strict=True)):
                    p, radius = cell.values.field("pivot").to_numpy(), cell.values.field("radius").to_numpy()
                    # No vector of a cell is nearer than the angle to its pivot less the radius.
                    most = np.cos(np.maximum(0.0, np.arccos(np.clip(s[i][p], -1, 1)) - radius))
                    need.append(p[np.maximum(0.0, most) >= least - 1e-9].tolist())
                yield pa.RecordBatch.from_arrays([b.column("g"), b.column("id"), b.column("v"), pa.array(need, pa.list_(pa.int32()))], names=["g", "id", "v", "need"])

    kind = asked.schema["id"].dataType.simpleString()
    return tests.select("g", "id", "v", "least", "reach").mapInArrow(needed, f"g string, id {kind}, v array<double>, need array<int>"), blocks, cells


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = 2048, vector: str = "vector", within: tuple[str, ...] = (), where: Column | None = None, pivots: int = 64) -> DataFrame:
    """The k nearest vectors of each query by cosine (0 below 0), itself left out: (query_id, id, similarity, place), ties by id.
    Both sides have id (long, each once) and a vector of one length. Payload filters: `where` holds for the vectors that are searched, and a query
    searches those that are equal to it in the columns `within` (null equals null). Rows without an id or a vector take no part; a zero
    vector has similarity 0 with all.

    Exact, by pivots: vectors lie in the cell of the pivot that they have the least angle to, cells in blocks. A query first
    meets one block of its own cell; then, by the triangle inequality of angles, it visits only the cells that can hold
    one at least as near as the k-th found. A task holds a batch of pairs of blocks, which Spark bounds in bytes, and a
    slice of their similarities, and returns k rows for each query; no side is broadcast or collected but the pivots."""
    asked, blocks, _ = _searched(queries, vectors, k, block, vector, within, where, pivots)
    dealt = asked.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, -(-queries.count() // block))))).select("g", "id", "v", "chunk", F.explode("need").alias("pivot"))
    met = dealt.groupBy("g", "pivot", "chunk").agg(F.collect_list(F.struct("id", "v")).alias("q_rows")).join(blocks, ["g", "pivot"])
    return serving.newest(_compared(met, k), ["query_id"], [F.desc("similarity"), F.asc("id")], k)


def visited(queries: DataFrame, vectors: DataFrame, k: int, block: int = 2048, vector: str = "vector", within: tuple[str, ...] = (), where: Column | None = None, pivots: int = 64) -> DataFrame:
    """How much of the search `nearest` saves: per query the cells that it visits of those of its group."""
    asked, _, cells = _searched(queries, vectors, k, block, vector, within, where, pivots)
    return asked.join(cells.groupBy("g").agg(F.count(F.lit(1)).alias("cells")), "g").select("id", F.size("need").alias("visited"), "cells")


def node_similarity(members: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """Per group: the mean similarity of its members to their centroid."""
    return similarities(members, group, vector).groupBy(group).agg(F.avg("similarity").alias("node_similarity"))


def summaries(members: DataFrame, group: list[str], window: str, version: str, parts: int = 3, length: int = 1000) -> DataFrame:
    """members: group columns, post_id, author_id, epoch, text. A row for each cluster of posts, which is part of one asset's
    window: the hash of its members, an id that stays while its first post does, one of this revision, first and
    last time, posts, authors, a summary of the first texts by id, and a label."""
    post = F.col("post_id").cast("string")
    base = members.groupBy(*group).agg(
        F.min_by(post, F.struct("epoch", "post_id")).alias("first_post"),
        F.min("epoch").alias("first_seen"), F.max("epoch").alias("last_seen"), F.count(F.lit(1)).alias("posts"), F.count_distinct("author_id").alias("authors"),
    )
    hashes = serving.digests(members.withColumn("__post", post), group, ["__post"], "__post", sep="|")
    base = base.join(hashes.select(*group, F.col("digest").alias("member_hash")), group)
    stable = uuid5(F.concat_ws(":", F.lit("narrative"), *group, F.col(window).cast("string"), "first_post", F.lit(version)))
    base = base.withColumn("narrative_id", stable).withColumn("revision_id", uuid5(F.concat_ws(":", F.lit("narrative-revision"), "narrative_id", "member_hash")))
    first = serving.newest(members.withColumn("__p", post), group, [F.asc("__p")], parts)
    told = first.groupBy(*group).agg(F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.trim("text").alias("t")))), lambda x: x["t"]), " "), 1, length).alias("summary"))
    key = F.to_json(F.struct(*group))
    names = text.labels(members.withColumn("__g", key), "__g")
    out = base.join(told, group).withColumn("__g", key).join(names, "__g", "left").drop("__g")
    return out.withColumn("label", F.coalesce("label", F.concat(F.col(group[0]), F.lit(" discussion"))))


def revise(current: DataFrame, history: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """current and history as they are after newly found summaries (with revised_at): a narrative's last revision is the
    current one, and every revision stays in the history once."""
    cols = found.columns
    new = found.dropDuplicates(["revision_id"]).join(history.select("revision_id"), "revision_id", "left_anti").select(*cols)
    return serving.latest(current.select(*cols).unionByName(new), ["narrative_id"], ["revised_at", "revision_id"]), history.select(*cols).unionByName(new)


def dominant(posts: DataFrame, campaign: list[str], narrative: str) -> DataFrame:
    """Per campaign: the narrative of most posts, of equal ones the least id."""
    n = posts.groupBy(*campaign, narrative).agg(F.count(F.lit(1)).alias("posts"))
    return n.groupBy(*campaign).agg(F.min_by(F.struct(narrative, "posts"), F.struct((-F.col("posts")).alias("n"), narrative)).alias("d")).select(*campaign, "d.*")


def graph_snapshots(windows: DataFrame, features: DataFrame, projected: DataFrame, key: list[str], failed: Column | None = None) -> DataFrame:
    """A snapshot of the coordination graph for each window revision: its features, nodes and relations where there are any, and
    the state of the parts. A window whose projection failed is DEGRADED and counts none."""
    failed = F.lit(False) if failed is None else failed
    out = windows.join(features, key, "left").join(projected, key, "left").withColumn("__failed", failed)
    count = lambda c: F.when(F.col("__failed"), 0).otherwise(F.coalesce(c, F.lit(0))).cast("long")
    return out.withColumns({
        "nodes": count("nodes"), "relations": count("relations"), "graph_score_status": F.when(F.col("graph_score").isNotNull(), "AVAILABLE").otherwise("MISSING"),
        "projection_status": F.when(F.col("__failed"), "DEGRADED").otherwise("COMPLETE"), "graph_snapshot_id": uuid5(F.concat_ws(":", F.lit("graph"), *(F.col(k).cast("string") for k in key), F.col("revision").cast("string"))),
    }).drop("__failed")
