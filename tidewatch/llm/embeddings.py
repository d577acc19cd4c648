"""Embedding near-duplicates by an inverted multi-index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import attach, components, cut


def codebook(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k centres by Lloyd's algorithm; fewer points than centres are the centres themselves."""
    rng = np.random.default_rng(seed)
    points = np.unique(points, axis=0)
    if len(points) <= k:
        return points
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        near = distances(points, centres).argmin(1)
        total, n = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(total, near, points)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None])


@dataclass
class MultiIndex:
    """A codebook for each half of the unit vectors; the cells are all pairs of their centres. reach: the bound on a
    cell's distance up to which the traversal goes on."""

    books: tuple[np.ndarray, np.ndarray]
    reach: float = 0.0

    def gaps(self, half: int, x: np.ndarray) -> np.ndarray:
        """For each vector and centre, the squared distance from the half vector to that centre's side of the plane
        between it and the nearest one: how far a neighbour must lie to belong to that centre."""
        book = self.books[half]
        d = distances(x, book)
        near = d.argmin(1)
        apart = np.sqrt(distances(book, book))[near]
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = np.where(apart > 0, (d - d[np.arange(len(x)), near][:, None]) / (2 * apart), 0.0)
        return np.maximum(gap, 0) ** 2

    def home(self, x: np.ndarray) -> np.ndarray:
        h = x.shape[1] // 2
        return distances(x[:, :h], self.books[0]).argmin(1) * len(self.books[1]) + distances(x[:, h:], self.books[1]).argmin(1)

    def visits(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each vector the cells up to reach, nearest first: a multi-sequence traversal of both sorted gap lists."""
        h, k = x.shape[1] // 2, len(self.books[1])
        for a, b in zip(self.gaps(0, x[:, :h]), self.gaps(1, x[:, h:]), strict=True):
            i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
            i, j = i[a[i] <= self.reach], j[b[j] <= self.reach]
            total = a[i][:, None] + b[j][None]
            r, c = np.nonzero(total <= self.reach)
            order = np.argsort(total[r, c], kind="stable")
            yield (i[r] * k + j[c])[order]


def fit_index(sample: np.ndarray, cosine: float, k: int, recall: float, seed: int = 5) -> MultiIndex:
    """Codebooks of a sample of unit vectors, and the reach by which that share of neighbours at exactly the threshold
    (the farthest ones: sample vectors turned by its angle in a random direction) lies in a visited cell."""
    h, rng = sample.shape[1] // 2, np.random.default_rng(seed)
    index = MultiIndex((codebook(sample[:, :h], k, seed), codebook(sample[:, h:], k, seed + 1)))
    some = np.repeat(sample[rng.permutation(len(sample))[:1000]], 4, 0)
    away = rng.normal(size=some.shape)
    away -= (away * some).sum(1, keepdims=True) * some
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    other = cosine * some + np.sqrt(1 - cosine**2) * away
    home = index.home(other)
    rows, k1 = np.arange(len(some)), len(index.books[1])
    bound = index.gaps(0, some[:, :h])[rows, home // k1] + index.gaps(1, some[:, h:])[rows, home % k1]
    index.reach = float(np.quantile(bound, recall)) + 1e-12
    return index


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, centres: int | None = None, recall: float = 0.998, sample_rows: int = 4000, block: int = 512) -> DataFrame:
    """One row for each row of vectors: id, n_links (other vectors at that cosine or more and of its label), component_id
    (the least id reachable by links, its own included) and kept (it is that one).

    The codebooks are fitted on at most sample_rows vectors (those with the least hash of their components); every
    vector is indexed in its cell and visits the cells near it. Each has `centres` centres: if not given, as many as put
    about `block` vectors of the largest label in a cell, 16 at least and a sixteenth of the sample at most. Vectors of a
    label that meet in a cell are compared in blocks of `block` by exact cosines in double precision, each pair of
    blocks under a key of its own, so a cell that holds most of the vectors is spread over tasks; a block pair returns counts
    and a spanning forest of its links, never all its pairs. Vectors that are equal in every component are one entry
    of the index with a weight.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label,
    link with nothing; vectors of different lengths don't link; a repeated id counts as a vector for each row and its
    component is the id itself; a null id keeps its row, with component null; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    good = F.expr("label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    # A copy of a vector is known by its components; the entry's id is the least of theirs.
    rows = cut(rows.withColumn("key", F.when(good, F.sha2(F.concat_ws(",", F.length("label").cast("string"), F.col("label"), F.transform("v", lambda x: (x + F.lit(0.0)).cast("string"))), 256))))
    entries = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("v").alias("v"))
    entries = cut(entries.withColumn("n", F.monotonically_increasing_id()).withColumn("size", F.size("v")))
    largest = {r["size"]: r for r in entries.groupBy("size", "label").count().groupBy("size").agg(F.max("count").alias("label"), F.sum("count").alias("total")).collect()}  # lengths are few
    links, forest = None, None
    for size in sorted(largest):
        own, total = entries.where(F.col("size") == size), largest[size]["total"]
        thin = own.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(min(1.0, 1.5 * sample_rows / total) * (1 << 30)) + 1).orderBy(F.xxhash64("key"), "key").limit(sample_rows).select("v").collect()
        sample = unit(np.array([r["v"] for r in thin] or [[1.0] * size]))
        k = centres or min(max(16, sample_rows // 16), max(16, math.ceil(math.sqrt(largest[size]["label"] / block))))
        index = fit_index(sample, cosine, k if size > 1 else 1, recall)
        found = cut(block_links(own, index, size, cosine, block))
        counted = found.select(F.explode("counts").alias("c")).select("c.n", "c.links")
        joined = found.select(F.explode("edges").alias("e")).select(F.col("e.n").alias("a"), F.col("e.links").alias("b"))
        links = counted if links is None else links.unionAll(counted)
        forest = joined if forest is None else forest.unionAll(joined)
    if links is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    sums = links.groupBy("n").agg(F.sum("links").alias("links"))
    group = components(forest)
    placed = entries.select("n", "key", "least", "weight").join(sums, "n", "left").join(group.withColumnRenamed("node", "n"), "n", "left").withColumn("component", F.coalesce("component", "n"))
    placed = cut(placed.withColumn("links", F.coalesce("links", F.lit(0)) + F.col("weight") - 1))
    best = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m"))
    total, m = placed.agg(F.sum("weight"), F.count(F.lit(1))).first()
    each = attach(placed.select("component", "key", "links", "weight"), best, "component", "m", m).drop("component")
    out = attach(rows.where("key is not null").select("id", "key"), each, "key", "weight", total).unionByName(rows.where("key is null").select("id", "key"), allowMissingColumns=True)
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def block_links(entries: DataFrame, index: MultiIndex, size: int, cosine: float, block: int) -> DataFrame:
    """(counts, edges) of each pair of blocks that meet in a cell."""
    spark = entries.sparkSession
    sent = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            x = unit(np.stack([np.array(v) for v in b.column(2).to_pylist()])) if b.num_rows else np.zeros((0, size))
            home, visits = own.home(x) if len(x) else [], list(own.visits(x))
            take, cell, probe = [], [], []
            for r, cells in enumerate(visits):
                own_cell = int(home[r])
                others = [int(c) for c in cells if c != own_cell]
                take += [r] * (2 + len(others))
                cell += [own_cell, own_cell, *others]
                probe += [False, *[True] * (1 + len(others))]
            t = pa.array(take, pa.int64())
            homes = pa.array([int(home[r]) for r in take], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(1).take(t), pa.array(cell, pa.int32()), pa.array(probe, pa.bool_()), homes, b.column(0).take(t), b.column(3).take(t)], names=["label", "cell", "probe", "home", "n", "weight"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(np.stack([np.array(v) for v in b.column(1).to_pylist()])) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([row.tobytes() for row in x], pa.binary())], names=["n", "x"])

    placed = cut(entries.select("n", "label", "v", "weight").mapInArrow(place, "label string, cell int, probe boolean, home int, n long, weight long"))
    unit_vectors = cut(entries.select("n", "v").mapInArrow(pack, "n long, x binary"))
    chunks = lambda probe: F.ceil(F.count(F.when(F.col("probe") == probe, 1)) / block).cast("int")
    cells = cut(placed.groupBy("label", "cell").agg(chunks(False).alias("chunks"), chunks(True).alias("probe_chunks"), F.count(F.lit(1)).alias("m")).where("chunks > 0"))
    # A probe meets every chunk of the cell's own vectors; probes are packed in chunks as well.
    chunked = attach(placed, cells, ["label", "cell"], "m", cells.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0], least=1_000)
    mine = F.pmod(F.xxhash64("n"), F.col("chunks")).cast("int")
    packed = lambda rows, name: rows.join(unit_vectors, "n").groupBy("label", "cell", "chunk").agg(F.collect_list(F.struct("n", "weight", "home", "x")).alias(name))
    there = packed(chunked.where("not probe").withColumn("chunk", mine), "there")
    asked = chunked.where("probe").withColumn("asked_chunk", F.pmod(F.xxhash64("n"), F.col("probe_chunks")).cast("int"))
    asked = asked.join(unit_vectors, "n").groupBy("label", "cell", "chunks", "asked_chunk").agg(F.collect_list(F.struct("n", "weight", "home", "x")).alias("asked"))
    # A chunk of probes is sent to each chunk of the cell, under a key of its own; the streamed side is that of the probes.
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = asked.join(there, ["label", "cell", "chunk"]).select("there", "asked")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        h, k = size // 2, len(own.books[1])
        kind = pa.list_(pa.struct([("n", pa.int64()), ("links", pa.int64())]))
        for b in batches:
            for r in range(b.num_rows):
                (tn, tw, th, tx), (an, aw, ah, ax) = (columns(b.column(c)[r], size) for c in (0, 1))
                i, j = np.nonzero(ax @ tx.T >= cosine - 1e-9)
                # By the vectors themselves, not by the matrix product's rounding; in slices of 8 MB.
                some = max(1, (1 << 20) // size)
                exact = np.concatenate([(ax[i[p : p + some]] * tx[j[p : p + some]]).sum(1) >= cosine for p in range(0, max(1, len(i)), some)])
                i, j = i[exact & (an[i] != tn[j])], j[exact & (an[i] != tn[j])]
                counts: dict[int, int] = {}
                for n, w in zip(an[i].tolist(), tw[j].tolist(), strict=True):
                    counts[n] = counts.get(n, 0) + w
                # The other vector counts the link too, here if its own traversal doesn't come to this one's cell.
                cross = ah[i] != th[j]
                if cross.any():
                    ci, cj = i[cross], j[cross]
                    back = np.zeros(len(ci), bool)
                    for a in range(0, len(cj), 1024):
                        y = tx[cj[a : a + 1024]]
                        rows = np.arange(len(y))
                        home = ah[ci[a : a + 1024]]
                        back[a : a + 1024] = own.gaps(0, y[:, :h])[rows, home // k] + own.gaps(1, y[:, h:])[rows, home % k] <= own.reach
                    for n, w in zip(tn[cj[~back]].tolist(), aw[ci[~back]].tolist(), strict=True):
                        counts[n] = counts.get(n, 0) + w
                edges = spanning(an[i], tn[j])
                yield pa.RecordBatch.from_arrays([pa.array([[{"n": n, "links": c} for n, c in counts.items()]], kind), pa.array([[{"n": n, "links": c} for n, c in edges]], kind)], names=["counts", "edges"])

    return met.mapInArrow(compare, "counts array<struct<n:bigint,links:bigint>>, edges array<struct<n:bigint,links:bigint>>")


def columns(rows: pa.Scalar, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    v = rows.values
    return (*(v.field(f).to_numpy(zero_copy_only=False) for f in ("n", "weight", "home")), np.frombuffer(b"".join(v.field("x").to_pylist()), np.float64).reshape(-1, size))


def spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            out.append((x, y))
    return out
