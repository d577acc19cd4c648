"""Documents packed into sequences by patterns of a few lengths, fitted to the histogram of lengths by non-negative least squares."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm._common import cut, written
from tidewatch.llm.tokens import Encoder

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Bases of lengths are broadcast up to so many rows (some 24 MB), and joined by a shuffle beyond.
SMALL = 1_000_000


def patterns(lengths: np.ndarray, capacity: int, most: int = 400_000) -> np.ndarray:
    """[pattern, 3] indices into lengths (sorted, distinct), -1 where there is none: all sets of two or three lengths that fill a sequence.
    Of triples, only those of every k-th longest length are taken where all would be more than `most`."""
    place = np.full(capacity + 1, -1)
    place[lengths] = np.arange(len(lengths))
    half = lengths[lengths * 2 <= capacity]
    pair = np.stack([place[half], place[capacity - half], np.full(len(half), -1)], 1)
    found = [pair[pair[:, 1] >= 0]]
    # shortest <= middle <= longest: the longest is given by the others.
    step = max(1, -(-len(lengths) ** 2 // (6 * most)))
    for a, x in enumerate(lengths[: np.searchsorted(lengths, capacity // 3, "right")]):
        middle = lengths[a : np.searchsorted(lengths, (capacity - x) // 2, "right")]
        longest = place[capacity - x - middle]
        got = np.stack([np.full(len(middle), a), np.arange(a, a + len(middle)), longest], 1)
        found.append(got[(longest >= 0) & ((longest + a) % step == 0)])
    return np.concatenate(found)


def fitted(sets: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeats x >= 0 of the patterns with A x nearest to the counts, each length's miss weighted by one over the number of
    patterns that use it: accelerated projected gradient, its steps scaled by rows and columns."""
    if not len(sets):
        return np.zeros(0)
    pad = np.where(sets < 0, len(counts), sets)
    used = np.bincount(pad.ravel(), minlength=len(counts) + 1)[: len(counts)]
    row = np.append(np.where(used > 0, 1 / np.maximum(used, 1), 0), 0.0)
    column = 1 / (sets >= 0).sum(1)
    x = ahead = np.zeros(len(sets))
    t = 1.0
    for _ in range(rounds):
        covered = np.bincount(pad.ravel(), np.repeat(ahead, 3), minlength=len(counts) + 1)
        miss = np.append(counts - covered[: len(counts)], 0.0) * row
        new = np.maximum(0, ahead + column * miss[pad].sum(1))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


@dataclass
class Plan:
    """Where the documents of a length go: those whose ranks are from first on, to sequences from `sequence` on at offset; sorted by
    (length, first). It is as large as the patterns in use, whatever the number of documents."""

    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    by_pattern: int

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = keyed(length, rank)
        at = np.searchsorted(self.key, key, "right") - 1
        return self.sequence[at] + key - self.key[at], self.offset[at]


def keyed(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return (np.asarray(length, np.int64) << 42) + rank


def plan(histogram: dict[int, int], capacity: int, most: int = 400_000) -> Plan:
    """Patterns are fitted, their repeats rounded (down, then up by the largest remainders while there are documents left), and the
    residual lengths packed: the longest one left opens a sequence, each next is the longest that fits, and what this makes is repeated as
    often as the counts allow. Pieces that fill a sequence are one each."""
    full = histogram.get(capacity, 0)
    lengths = np.array(sorted(x for x in histogram if x < capacity and histogram[x] > 0), np.int64)
    left = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    sets = patterns(lengths, capacity, most)
    x = fitted(sets, left.astype(float))
    runs, taken, sequences = [(capacity, 0, 0, 0)] if full else [], np.zeros(len(lengths), np.int64), full

    def place(docs: list[int], times: int) -> None:
        """`times` sequences of these documents (indices of lengths)."""
        nonlocal sequences
        offset = 0
        for d in docs:
            runs.append((int(lengths[d]), int(taken[d]), sequences, offset))
            taken[d] += times
            left[d] -= times
            offset += int(lengths[d])
        sequences += times

    whole, part = np.floor(x).astype(np.int64), x - np.floor(x)
    for repeats, order in ((whole, np.argsort(-x, kind="stable")), (None, np.argsort(-part, kind="stable"))):
        for p in order.tolist():
            wanted = 1 if repeats is None else int(repeats[p])
            if wanted == 0 or part[p] < 1e-6 and repeats is None:
                break
            docs = [d for d in sets[p].tolist() if d >= 0]
            times = min(wanted, *(int(left[d]) // docs.count(d) for d in docs))
            if times:
                place(docs, times)
    by_pattern = sequences - full
    open_, lengths_open = [int(i) for i in np.flatnonzero(left)], lengths[np.flatnonzero(left)].tolist()
    while open_:
        docs, room, held = [], capacity, {}
        at = len(open_) - 1
        while at >= 0:
            d = open_[at]
            fit = min(room // lengths_open[at], int(left[d]))
            if fit:
                docs += [d] * fit
                held[d] = fit
                room -= fit * lengths_open[at]
            at = min(at, bisect.bisect_right(lengths_open, room)) - 1
        place(docs, min(int(left[d]) // k for d, k in held.items()))
        for d in [d for d in held if not left[d]]:
            at = bisect.bisect_left(open_, d)
            del open_[at], lengths_open[at]
    made = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return Plan(keyed(made[:, 0], made[:, 1]), made[:, 2], made[:, 3], sequences, by_pattern)


def pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int, end: int) -> DataFrame:
    """(bucket, rank, id, piece, start, length, ids): each document's ids and `end`, whole or cut. rank numbers the pieces of a length
    within a bucket, the task that made them."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    file, last = vocabulary.rsplit("/", 1)[-1], np.array([end], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bucket, ranks = Encoder(SparkFiles.get(file)), TaskContext.get().partitionId(), {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                rows: list[tuple] = []
                for i, text in zip(*(whole.slice(at, 256).column(c).to_pylist() for c in (0, 1)), strict=True):
                    ids = encode(text) + last
                    n = len(ids) // 2
                    start = 0
                    for piece, stop in enumerate(range(n % capacity or min(n, capacity), n + 1, capacity)):
                        rank = ranks.get(stop - start, 0)
                        ranks[stop - start] = rank + 1
                        rows.append((bucket, rank, i, piece, start, stop - start, ids[2 * start : 2 * stop]))
                        start = stop
                kinds = (pa.int32(), pa.int64(), whole.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "rank", "id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"bucket int, rank long, id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids binary")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, vocabulary: str = VOCABULARY, end: int = 0, most: int = 400_000) -> DataFrame:
    """One row for each piece of a document: id, piece, start, length, ids (little-endian 16-bit), sequence_id and offset in it.

    A document is the ids of its text and `end`; only longer ones than capacity are cut, into pieces of capacity (the first one may be
    shorter). The histogram of lengths (capacity rows at most) goes to the driver, which fits how often each pattern of two or three
    lengths is repeated; a plan comes back that says where the r-th piece of a length goes. Pieces are ranked by counts of (task,
    length), summed over tasks: no group of one length meets in a task, and texts are tokenised once, into a written table. The rows
    join their bases where they lie if these are few, by a shuffle on (task, length) otherwise. Sequence ids run from 0 without gaps.

    Defined cases: null and empty texts are one id, `end`; null and repeated ids and rows are documents like any other; an empty
    table gives no rows. Special tokens of the vocabulary are known in texts, as its library does. Other columns are ignored.
    """
    own = written(pieces(docs, id_col, text_col, vocabulary, capacity, end))
    groups = cut(own.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("m")))
    histogram = {r["length"]: (r["m"], r["groups"]) for r in groups.groupBy("length").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("groups")).collect()}
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.select("bucket", "length", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("base"))
    if sum(n for _, n in histogram.values()) <= SMALL:
        bases = F.broadcast(bases)
    sent = docs.sparkSession.sparkContext.broadcast(plan({x: m for x, (m, _) in histogram.items()}, capacity, most))

    @F.pandas_udf("sequence_id long, offset long")
    def found(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = sent.value.find(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = own.join(bases, ["bucket", "length"]).withColumn("at", found("length", F.col("rank") + F.col("base")))
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids", "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, tokens (binary) and starts, the offset of each piece for attention masks."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("tokens"), F.col("p.offset").alias("starts"))


def digest(packed: DataFrame) -> DataFrame:
    @F.pandas_udf("long")
    def crc(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes())).astype("int64")

    return packed.withColumn("ids_crc32", crc("ids")).drop("ids")
