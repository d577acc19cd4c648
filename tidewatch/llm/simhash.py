"""SimHash near-duplicates by a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import attach, components, cut

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
MAX_BITS = 3
#: Fingerprints that differ in at most 3 bits share at least 8 - 3 of their 8 positional bytes.
MIN_SHARED = 8 - MAX_BITS


def quadruples() -> list[tuple[int, ...]]:
    """The 14 sets of 4 byte positions such that any 3 positions lie within exactly one of them: those whose numbers
    cancel out under exclusive or. The complement of such a set is one too, so for any 3 positions that differ, one
    set is left whole: an index on the 14 sets misses no pair of MIN_SHARED shared bytes."""
    return [q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    words = (text or b"").translate(LOWER).split()  # bytes.split knows exactly the six separators
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    if len(words) <= shingle:
        hashes = np.array([h(b" ".join(words), 42)], np.uint64)
    else:
        hashes = np.fromiter((h(b" ".join(p), 42) for p in zip(*(words[i:] for i in range(shingle)), strict=False)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([fingerprint(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int64())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def near(values: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose tally of shared bytes reaches MIN_SHARED and, verified, whose bits differ in at most MAX_BITS places."""
    x = values[:, None] ^ other[None, :]
    shared = np.zeros(x.shape, np.int8)
    for p in range(8):
        shared += (x >> np.uint64(8 * p)) & np.uint64(255) == 0
    i, j = np.nonzero(shared >= MIN_SHARED)
    ok = np.bitwise_count(x[i, j]) <= MAX_BITS
    return i[ok], j[ok]


def forest(values: np.ndarray, block: int = 1024) -> list[tuple[int, int]]:
    """Links within one posting list that join all that its near pairs join: at most one fewer than its values."""
    root = np.arange(len(values))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for a in range(0, len(values), block):
        for b in range(a, len(values), block):
            for i, j in zip(*near(values[a : a + block], values[b : b + block]), strict=True):
                i, j = find(a + int(i)), find(b + int(j))
                if i != j:
                    root[max(i, j)] = min(i, j)
                    out.append((int(values[i].view(np.int64)), int(values[j].view(np.int64))))
    return out


def postings(fps: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """(place, key, fp): for each set of byte positions, the fingerprint's bytes there."""
    masks = [sum(255 << (8 * p) for p in s) for s in sets]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.struct(F.lit(i).alias("place"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)))
    return fps.select(F.explode(keys).alias("k"), "fp").select("k.*", "fp")


def linked(fps: DataFrame, limit: int = 8192) -> DataFrame:
    """Links (a, b) among distinct fingerprints that connect exactly those at MAX_BITS or fewer apart.

    Each fingerprint has a posting under 14 sets of 4 positional bytes. A list of over `limit` values is dealt again
    by one more of its 4 other bytes (of which a near pair shares at least one), and each such list is compared in
    ranges of `limit` values: every pair of ranges is a row of its own, so no list is gathered whole by one task.
    """
    sets = quadruples()
    first = postings(fps, sets)
    large = first.groupBy("place", "key").count().where(F.col("count") > limit).select("place", "key", F.lit(True).alias("large"))
    dealt = first.join(large, ["place", "key"], "left")
    rest = F.array(*(F.array(*(F.lit(p) for p in range(8) if p not in s)) for s in sets))
    again = (
        dealt.where("large").select("place", "key", "fp", F.explode(F.element_at(rest, F.col("place") + 1)).alias("p"))
        .select(F.expr("14 + place * 8 + p").alias("place"), F.expr("key | (fp & shiftleft(255L, 8 * p))").alias("key"), "fp")
    )
    lists = dealt.where("large is null").select("place", "key", "fp").unionAll(again)
    spread = again.groupBy("place", "key").agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("parts")).where("parts > 1")
    cells = lists.join(spread, ["place", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # A value of part i goes to the cells (i, j) and (j, i); for one part that is one cell.
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = cells.withColumn("i", part).withColumn("j", F.explode(F.expr("sequence(0, parts - 1)")))
    cells = cells.select("place", "key", F.least("i", "j").alias("c"), F.greatest("i", "j").alias("d"), "fp")

    many = cells.groupBy("place", "key", "c", "d").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [e for v in b.column(0).to_pylist() for e in forest(np.sort(np.array(v, np.int64).view(np.uint64)))]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], names=["a", "b"])

    return many.select("fps").mapInArrow(rows, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, limit: int = 8192) -> DataFrame:
    """One row for each row of docs: id, fingerprint (16 hex digits) and component_id, the smallest id that is reachable
    by links of fingerprints at 3 or fewer differing bits.

    Texts are lower-cased (A-Z), split into words and cut into word shingles, repeats included. Exact copies of a
    fingerprint are one value in the index, so a group of copies of any size costs one posting.

    Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; repeated rows and
    equal ids give a row each; a null id never names a component unless all ids of the component are null; an empty
    table gives no rows. Other columns of docs are ignored.
    """
    own = cut(fingerprints(docs, id_col, text_col, shingle))
    values = cut(own.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    group = components(cut(linked(values.select("fp"), limit)))
    placed = cut(values.join(group.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    best = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m"))
    n, m = placed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    names = attach(placed.select("component", "fp", "n"), best, "component", "m", m).select("fp", "component_id", "n")
    out = attach(own, names, "fp", "n", n)
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
