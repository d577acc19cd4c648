"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND for every passage."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import cut

TOKEN = re.compile(r"\w+")
K1, B = 1.2, 0.75
SHINGLE = 5
#: Items in a block of a posting list; each block knows its largest weight.
BLOCK = 4
#: Bounds (segments times blocks) that are held at a time: 16 MB.
CELLS = 1 << 21
#: A term in more blocks than this is bounded by its largest weight alone.
LIGHT = 64


def words(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def shingles(ids: list[int]) -> set[tuple[int, ...]]:
    if len(ids) < SHINGLE:
        return {tuple(ids)} if ids else set()
    return set(zip(*(ids[i:] for i in range(SHINGLE)), strict=False))


class Index:
    """An inverted index of some test items. The weight of a term in an item is its BM25 share of what the item scores
    against itself, so the score of a passage is in 0..1 and one threshold serves items of any length."""

    def __init__(self, items: list[tuple[int | None, list[str], int]], idf: dict[str, float], mean: float):
        """items: (id, words, length of the question), by length."""
        self.terms = {t: i for i, t in enumerate(sorted(idf))}
        self.ids = [x[0] for x in items]
        self.longest = max(len(x[1]) for x in items)
        lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.question, self.answer = [], []
        for n, (_, ws, cut_at) in enumerate(items):
            tf: dict[str, int] = defaultdict(int)
            for w in ws:
                tf[w] += 1
            raw = {w: idf[w] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(ws) / mean)) for w, c in tf.items()}
            own = sum(raw.values())
            for w, x in raw.items():
                lists[self.terms[w]].append((n, x / own))
            ids = [self.terms[w] for w in ws]
            self.question.append(shingles(ids[:cut_at]))
            self.answer.append(shingles(ids[cut_at:]))
        self.whole = [shingles([self.terms[w] for w in x[1]]) for x in items]
        self.posts = {t: ([p[0] for p in v], [p[1] for p in v]) for t, v in lists.items()}
        self.most = np.zeros(len(self.terms) + 1)
        for t, (_, v) in self.posts.items():
            self.most[t] = max(v)
        # The block maxima of all terms in one piece: those of term t lie at first[t]:first[t + 1].
        self.n_blocks = -(-len(items) // BLOCK)
        heavy = {t: dict.fromkeys(n // BLOCK for n in at) for t, (at, _) in self.posts.items()}
        top = {t: [max(w for n, w in zip(*self.posts[t], strict=True) if n // BLOCK == b) for b in own] if len(own) <= LIGHT else [] for t, own in heavy.items()}
        sizes = [len(top[t]) for t in range(len(self.terms))]
        self.first = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64), [sum(sizes)]])
        self.block = np.fromiter((b for t in range(len(self.terms)) if top[t] for b in heavy[t]), np.int64, sum(sizes))
        self.top = np.fromiter((x for t in range(len(self.terms)) for x in top[t]), np.float64, sum(sizes))
        self.light = np.array([0.0 if top[t] else self.most[t] for t in range(len(self.terms))] + [0.0])

    def search(self, terms: list[int], live: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items that score the threshold or more against the distinct terms, by block-max WAND. live: the blocks whose
        maxima let them; cursors skip the others."""
        most, posts = self.most, self.posts
        found: list[tuple[int, float]] = []
        cursors: list[list] = []
        left = 0

        def moved(p: int, t: int, goal: int) -> list | None:
            at = posts[t][0]
            p = bisect_left(at, goal, p)
            return [at[p], p, t] if p < len(at) else None

        def next_live(goal: int) -> int | None:
            nonlocal left
            while left < len(live) and (live[left] + 1) * BLOCK <= goal:
                left += 1
            return max(goal, live[left] * BLOCK) if left < len(live) else None

        goal = next_live(0)
        if goal is None:
            return found
        cursors = [c for t in terms if (c := moved(0, t, goal))]
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += most[c[2]]
                if bound >= threshold - 1e-12:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            goal = next_live(item)
            if goal is None:
                break
            if goal == item:
                if cursors[0][0] == item:
                    score = 0.0
                    for d, p, t in cursors:
                        if d != item:
                            break
                        score += posts[t][1][p]
                    if score >= threshold:
                        found.append((item, score))
                    goal = next_live(item + 1)
                    if goal is None:
                        break
            cursors = [c if c[0] >= goal else moved(c[1], c[2], goal) for c in cursors]
            cursors = [c for c in cursors if c]
        return found

    def reachable(self, ids: np.ndarray, segment: np.ndarray, n: int) -> np.ndarray:
        """What each of n segments of words and the next one together may score at most in each block of items: the sum
        of the block maxima of their distinct terms. It holds n times n_blocks numbers."""
        known = ids < len(self.terms)
        width = len(self.terms) + 1
        pairs = np.unique(segment[known] * width + ids[known])
        where, term = pairs // width, pairs % width
        light = np.bincount(where, self.light[term], n)
        count = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        sums = np.bincount(np.repeat(where, count) * self.n_blocks + self.block[at], self.top[at], n * self.n_blocks).reshape(n, self.n_blocks)
        sums[:-1] += sums[1:]
        light[:-1] += light[1:]
        return sums + light[:, None]

    def slices(self, texts: list[np.ndarray]) -> Iterator[tuple[list[tuple[int, int]], np.ndarray]]:
        """The segments of all texts, some at a time, as ([(text, segment in it)], reachable): as many as CELLS bounds
        allow, however many items there are and however long a text is. The last segment of a slice begins the next one
        too where its text goes on, for it stands with its successor."""
        step, most = self.longest, max(2, CELLS // self.n_blocks)
        places, parts = [], []

        def done() -> tuple:
            segment = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            return list(places), self.reachable(np.concatenate(parts), segment, len(parts))

        for d, x in enumerate(texts):
            for k in range(max(1, -(-len(x) // step))):
                places.append((d, k))
                parts.append(x[k * step : (k + 1) * step])
                if len(parts) == most:
                    goes_on = (k + 1) * step < len(x)
                    own, best = done()
                    yield (own[:-1], best[:-1]) if goes_on else (own, best)
                    places, parts = ([places[-1]], [parts[-1]]) if goes_on else ([], [])
        if parts:
            yield done()

    def hits(self, texts: list[str | None], threshold: float, overlap: float) -> list[list[tuple[int, float, float, float, int]]]:
        """For each text the items found in it, as (item, score, question overlap, answer overlap, first word of the
        passage), the best passage of each item. Passages are two segments of the length of the longest item and begin
        at every segment, so any run of words as long as an item lies whole in one."""
        none, step, get = len(self.terms), self.longest, self.terms.get
        each = [np.array([get(w, none) for w in words(t)], np.int64) for t in texts]
        found: list[dict[int, tuple]] = [{} for _ in each]
        for places, best in self.slices(each):
            reach = best >= threshold - 1e-9
            for s in np.flatnonzero(reach.any(1)).tolist():
                d, k = places[s]
                first = k * step
                part = each[d][first : first + 2 * step].tolist()
                terms = set(part)
                terms.discard(none)
                there = None
                for item, score in self.search(sorted(terms), np.flatnonzero(reach[s]).tolist(), threshold):
                    there = shingles(part) if there is None else there
                    share = lambda want, there=there: len(want & there) / len(want) if want else 1.0
                    q, w = share(self.question[item]), share(self.answer[item])
                    if share(self.whole[item]) >= overlap and q >= overlap / 2 and w >= overlap / 2 and (item not in found[d] or score > found[d][item][1]):
                        found[d][item] = (self.ids[item], score, q, w, first)
        return [[x[i] for i in sorted(x)] for x in found]


def index_parts(items: DataFrame, id_col: str, text_col: str, question_col: str | None, answer_col: str | None, part_words: int) -> Iterator[Index]:
    """The items' index in parts of about part_words words each, by length; only one part is on the driver at a time.
    Document frequencies and the mean length are counted over all items."""
    if question_col and answer_col:
        question, answer = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (question_col, answer_col))
    else:
        question, answer = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, a = ([words(t) for t in b.column(i).to_pylist()] for i in (1, 2))
            n_question = [len(x) if y else -(-len(x) // 2) for x, y in zip(q, a, strict=True)]
            ws = [x + y for x, y in zip(q, a, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ws], pa.int32()), pa.array(ws, pa.list_(pa.string())), pa.array(n_question, pa.int32())], names=["id", "n", "ws", "n_question"])

    # Items are split by the function that splits the passages, or their terms would not meet.
    rows = items.select(F.col(id_col).cast("long").alias("id"), question.alias("q"), answer.alias("a")).mapInArrow(split, "id long, n int, ws array<string>, n_question int").where("n > 0").distinct()
    rows = cut(rows)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("words")).first()
    if not total["n"]:
        return
    df = rows.select(F.explode(F.array_distinct("ws")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    parts = -(-total["words"] // part_words)
    edges = [] if parts == 1 else rows.approxQuantile("n", [i / parts for i in range(1, parts)], 0.001)
    part = sum((F.when(F.col("n") > e, 1).otherwise(0) for e in edges), F.lit(0)) if edges else F.lit(0)
    rows = rows.withColumn("part", part)
    for p in range(parts):
        own = rows.where(F.col("part") == p)
        got = sorted(((r["n"], r["id"], r["ws"], r["n_question"]) for r in own.toLocalIterator()), key=lambda x: (x[0], x[1] is None, x[1] or 0, *x[2:]))
        if not got:
            continue
        terms = own.select(F.explode("ws").alias("w")).distinct().join(df, "w")
        n = total["n"]
        idf = {r["w"]: float(np.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5))) for r in terms.toLocalIterator()}
        yield Index([(i, ws, q) for _, i, ws, q in got], idf, total["words"] / n)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", question_col: str | None = None, answer_col: str | None = None, threshold: float = 0.7, overlap: float = 0.8, part_words: int = 1_000_000) -> DataFrame:
    """The test items that occur in each row of docs: (id, item_id, score, question_overlap, answer_overlap, first_word).

    Every passage of every document queries the index; all items that score `threshold` of their own BM25 weight or more
    are retrieved and verified: five-word shingles of the item found in the passage must be `overlap` of all, and half
    of that for the question and for the answer each. Without columns for the two, an item's text is halved. The index
    goes to the executors in parts of bounded size, one search of all documents for each.

    Defined cases: null and empty texts and items match nothing; items of under five words match as a whole; items that
    share an id (or have none) and differ in their words are items of their own, each with its own rows; equal ones count
    once; repeated rows and null ids of docs give rows each; no items or no documents give no rows. Words are runs of \\w, lower-cased, so case and punctuation don't hide a leak. Other columns are ignored.
    """
    spark = docs.sparkSession
    schema = "id long, item_id long, score double, question_overlap double, answer_overlap double, first_word int"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for index in index_parts(items, item_id_col, item_text_col, question_col, answer_col, part_words):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for b in (b.slice(a, 256) for b in batches for a in range(0, b.num_rows, 256)):
                found = [(i, *h) for i, hits in zip(b.column(0).to_pylist(), own.hits(b.column(1).to_pylist(), threshold, overlap), strict=True) for h in hits]
                cols = list(zip(*found, strict=True)) if found else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()), strict=True)], names=["id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.withColumnRenamed("id", id_col)
