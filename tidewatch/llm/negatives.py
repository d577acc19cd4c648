"""Hard negatives: exact integer scores of all rows for the anchors, by lookups in tables of subset sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm._common import attach, cut, running, written

#: Row v, column i: bit i of the byte v.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: Components scaled must stay below, and vectors may have at most so many: scores are then below 2^61.
LARGEST, LONGEST = 1 << 24, 8192


def grouped(q: np.ndarray) -> np.ndarray:
    """[row, dimension] with zero dimensions added up to a multiple of eight."""
    out = np.zeros((len(q), -(-q.shape[1] // 8) * 8), np.int64)
    out[:, : q.shape[1]] = q
    return out


def planes(q: np.ndarray) -> np.ndarray:
    """[bit, group, row] bytes of integers [row, dimension]: byte (k, g, r) holds bit k of the eight dimensions of group g. The last
    bit is the sign (two's complement), and there are no more bits than the integers need."""
    own = grouped(q)
    bits = int(max(own.max(initial=0), ~own.min(initial=-1))).bit_length() + 1
    return np.stack([np.packbits(((own >> k) & 1).astype(np.uint8), axis=1, bitorder="little").T for k in range(bits)])


def tables(anchors: np.ndarray) -> np.ndarray:
    """[group, byte, anchor]: the sum of the anchor's components whose bit is set in the byte."""
    own = grouped(anchors)
    return np.stack([BITS @ own[:, g : g + 8].T for g in range(0, own.shape[1], 8)]) if own.shape[1] else np.zeros((0, 256, len(own)), np.int64)


def scores(anchors: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """[row, anchor] inner products: from the sign's plane down, twice what there is and a lookup for each group of dimensions."""
    bits, groups, rows = packed.shape
    bound = int(np.abs(anchors).sum(1).max(initial=0)) << bits
    table = tables(anchors).astype(np.int32 if bound < 1 << 31 else np.int64)
    out = np.zeros((rows, len(anchors)), table.dtype)
    for k in range(bits - 1, -1, -1):
        out += out
        for g in range(groups):
            got = table[g].take(packed[k, g], axis=0)
            if k == bits - 1:
                out -= got
            else:
                out += got
    return out


def best(score: np.ndarray, ids: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """The places of the `most` first by score (down), id and number."""
    if len(score) > most:
        at = np.flatnonzero(score >= np.partition(score, len(score) - most)[len(score) - most])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((n[at], ids[at], -score[at].astype(np.int64)))[:most]]


def block_rows(block: int) -> Column:
    """Rows of a block: fewer where vectors are long, so that none is over some 16 MB."""
    return F.greatest(F.lit(16), F.least(F.lit(block), F.expr(f"cast({1 << 22} div (size + 1) as int)")))


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in range(b.num_rows):
            own = b.column(2)[r].values
            n, ids, code = (own.field(f).to_numpy() for f in ("n", "id", "code"))
            order = np.argsort(n)
            q = matrix(own.field("q"), len(n))[order]
            packed = planes(q)
            out = [pa.array([x.tobytes()], pa.binary()) for x in (n[order], ids[order], code[order], packed)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(r, 1), b.column(1).slice(r, 1), pa.array([int(code.min())]), pa.array([int(code.max())]), pa.array([packed.shape[0]], pa.int32()), *out], names=["size", "block", "low_code", "high_code", "bits", "n", "ids", "codes", "planes"])


def matrix(lists: pa.Array, rows: int) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


PACKED = "size int, block long, low_code long, high_code long, bits int, n binary, ids binary, codes binary, planes binary"


def compared(met: DataFrame, most: int, low: int, high: int, wanted: bool) -> DataFrame:
    """met: a chunk of anchors and a packed block in each row. wanted: the anchors bring bounds, and look for rows of other labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                yield from pair(*(b.column(c)[r] for c in range(b.num_columns)))

    def pair(size: pa.Scalar, bits: pa.Scalar, n: pa.Scalar, ids: pa.Scalar, codes: pa.Scalar, packed: pa.Scalar, anchors: pa.Scalar) -> Iterator[pa.RecordBatch]:
        n, ids, codes = (np.frombuffer(x.as_py(), np.int64) for x in (n, ids, codes))
        packed = np.frombuffer(packed.as_py(), np.uint8).reshape(bits.as_py(), -(-size.as_py() // 8), len(n))
        own = anchors.values
        a_n, a_id, a_code = (own.field(f).to_numpy() for f in ("n", "id", "code"))
        q = matrix(own.field("q"), len(a_n)) if size.as_py() else np.zeros((len(a_n), 0), np.int64)
        positives = own.field("positives").to_pylist() if wanted else None
        # Rows of a block come in the order of their codes: one label is one range.
        starts, ends = np.searchsorted(codes, a_code), np.searchsorted(codes, a_code, "right")
        some = int(min(64, max(1, (1 << 22) // (2048 * max(1, packed.shape[1])))))
        for i in range(0, len(a_n), some):
            found: list[tuple] = []
            got = scores(q[i : i + some], packed)
            for j in range(i, min(len(a_n), i + some)):
                s, a, z = got[:, j - i], starts[j], ends[j]
                if not wanted:
                    at = a + np.flatnonzero(n[a:z] != a_n[j])
                    found += [(a_n[j], a_id[j], None, None, None, n[p], ids[p], s[p]) for p in at[best(s[at], ids[at], n[at], most)]]
                    continue
                for p in positives[j]:
                    least, greatest = -((-low * p["score"]) // 100), high * p["score"] // 100
                    inside = (s >= least) & (s <= greatest)
                    inside[a:z] = False
                    at = np.flatnonzero(inside)
                    found += [(a_n[j], a_id[j], p["n"], p["id"], p["score"], n[x], ids[x], s[x]) for x in at[best(s[at], ids[at], n[at], most)]]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["anchor_n", "anchor_id", "positive_n", "positive_id", "positive_score", "n", "id", "score"])

    return met.mapInArrow(run, "anchor_n long, anchor_id long, positive_n long, positive_id long, positive_score long, n long, id long, score long")


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, anchor_every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = 2048, anchor_block: int = 512) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score: for each anchor (a row whose id
    anchor_every divides) and each of its first `positives` other rows of its label, the first `negatives` rows of other labels
    whose score is between low and high hundredths of the positive's. A score is the exact inner product of the components
    floor(scale * x), as integers; higher ones come first, ties by smaller id.

    Rows are numbered by size, label and id, and packed in blocks as bytes of bit planes; anchors come in chunks, whose tables hold
    the sums of all subsets of each eight components. A chunk is sent to blocks of rows, each pair a row of its own: for the
    positives to the blocks that hold its labels; then, with the bounds that these set, to all that hold another label. A pair
    returns an anchor's best few rows alone, so a label of most rows is many blocks, and no task holds all scores of an anchor.
    Work is anchors times rows (the query set against all rows), memory a block and a chunk.

    Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part. Nor do those with a scaled
    component of 2^24 or over or with more than 8,192 components: scores might leave 64 bits. Vectors meet those of their
    own size only; empty ones score 0. Rows that repeat an id are rows of their own (anchors too) and each other's positives; a
    positive below 0 has no negatives, one of 0 has those of 0. Other columns are ignored; an empty table gives no rows.
    """
    v, scaled = F.col(vector_col).cast("array<double>"), F.expr(f"transform(v, x -> cast(floor(x * {float(scale)}D) as bigint))")
    good = f"id is not null and label is not null and v is not null and size(v) <= {LONGEST} and forall(v, x -> x is not null and not isnan(x) and abs(x) * {float(scale)}D < {float(LARGEST)}D)"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v")).where(good)
    rows = rows.select("id", "label", F.size("v").alias("size"), scaled.alias("q"), F.monotonically_increasing_id().alias("row"), F.lit(1).alias("one"))
    count = rows.count()
    placed = written(running(rows, ["size", "label", "id", "row"], ["one"], count, 20_000).withColumnRenamed("before_one", "n").drop("one", "row"))
    # A label's code is the number of its first row (with vectors of that size).
    codes = placed.groupBy("size", "label").agg(F.min("n").alias("code"), F.max("n").alias("last"), F.count(F.lit(1)).alias("m"))
    placed = attach(placed, codes, ["size", "label"], "m", count).withColumn("per", block_rows(block)).withColumn("block", F.expr("n div per"))
    blocks = written(placed.groupBy("size", "block").agg(F.collect_list(F.struct("n", "id", "code", "q")).alias("rows")).mapInArrow(pack, PACKED))
    # Anchors of a few blocks side by side are a chunk, if there are no more than anchor_block.
    beside = Window.partitionBy("size", "near").orderBy("n")
    anchors = placed.where(F.col("id") % anchor_every == 0).withColumn("near", F.expr("block div 8"))
    anchors = written(anchors.withColumn("part", F.floor((F.row_number().over(beside) - 1) / anchor_block)))

    def chunks(rows: DataFrame, *more: str) -> DataFrame:
        held = [F.min("code").alias("low"), F.max("code").alias("high"), F.min(F.expr("code div per")).alias("from"), F.max(F.expr("last div per")).alias("to")]
        return rows.groupBy("size", "near", "part").agg(F.collect_list(F.struct("n", "id", "code", "q", *more)).alias("anchors"), *held)

    def met(sent: DataFrame) -> DataFrame:
        return sent.withColumn("block", F.explode(F.sequence("from", "to"))).join(blocks, ["size", "block"])

    asked = ["size", "bits", "n", "ids", "codes", "planes", "anchors"]
    same = compared(met(chunks(anchors)).select(asked), positives, low, high, False)
    order = Window.partitionBy("anchor_n").orderBy(F.desc("score"), "id", "n")
    first = same.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    first = cut(first.groupBy(F.col("anchor_n").alias("n")).agg(F.collect_list(F.struct("id", "n", "score")).alias("positives")))
    # At most LONGEST + 1 sizes: small whatever the input.
    ranges = F.broadcast(blocks.groupBy("size").agg(F.min("block").alias("from"), F.max("block").alias("to")))
    wanted = chunks(anchors.join(first, "n"), "positives").drop("from", "to").join(ranges, "size")
    other = met(wanted).where("not (low = high and low_code = high_code and low = low_code)")
    different = compared(other.select(asked), negatives, low, high, True)
    order = Window.partitionBy("anchor_n", "positive_n").orderBy(F.desc("score"), "id", "n")
    ranked = different.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
o AS (SELECT anchor_id, vec_id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM o WHERE place <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id
  WHERE NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
