"""Convolutional text classifier for toxicity, trained in numpy, with thresholds calibrated by language."""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+")
BUCKETS = 1 << 17
#: Hashed features of a word: itself, and its first 3, 4 and 5 letters.
PARTS = 4
DIM, WIDTHS, FILTERS = 10, (1, 2, 3), 6
CUTOFF = 0.7


def features(word: str) -> tuple[int, ...]:
    """A row of the embedding table for the word and for each of its first letters; each part has rows of its own."""
    h = zlib.crc32
    return (h(word.encode("utf-8", "replace")) % BUCKETS, *(BUCKETS * (i + 1) + h(word[:k].encode("utf-8", "replace")) % BUCKETS for i, k in enumerate((3, 4, 5))))


def words(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


@dataclass
class Model:
    """rows: the sorted feature rows that the training sample holds; embedding has a vector for each, then zeros for all others."""

    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    embedding: np.ndarray = field(default_factory=lambda: np.zeros((1, DIM), np.float32))
    kernels: list[np.ndarray] = field(default_factory=lambda: [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS])
    kernel_bias: list[np.ndarray] = field(default_factory=lambda: [np.zeros(FILTERS, np.float32) for _ in WIDTHS])
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def calibrated(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -30, 30)))

    def places(self, names: list[str]) -> np.ndarray:
        """Where in embedding the features of each word lie."""
        at = np.array([features(w) for w in names], np.int32).reshape(-1, PARTS)
        near = np.minimum(np.searchsorted(self.rows, at), max(len(self.rows) - 1, 0))
        return np.where(self.rows[near] == at, near, len(self.rows)) if len(self.rows) else np.zeros_like(at)


class Scorer:
    """A model with the kernels' share of each known word worked out once: bounded by `most` words."""

    def __init__(self, model: Model, most: int = 200_000):
        self.m, self.most, self.ids = model, most, {}
        self.side = np.concatenate([k.transpose(1, 0, 2).reshape(DIM, -1) for k in model.kernels], 1)
        self.rows = np.zeros((1024, self.side.shape[1]), np.float32)
        self.bias = np.concatenate(model.kernel_bias)

    def _learn(self, new: list[str]) -> None:
        if len(self.ids) + len(new) > self.most:
            self.ids.clear()
        n = len(self.ids)
        while n + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[n : n + len(new)] = self.m.embedding[self.m.places(new)].sum(1) @ self.side
        self.ids.update(zip(new, range(n, n + len(new)), strict=True))

    def logit(self, text: str | None) -> float:
        """Of the whole text; a text without words gives the bias and what empty positions give."""
        return self.logit_of(words(text))

    def logit_of(self, ws: list[str]) -> float:
        if new := [w for w in set(ws) if w not in self.ids]:
            self._learn(sorted(new))
            if len(self.ids) == len(new):  # the table began anew
                self._learn(sorted(set(ws) - self.ids.keys())) if set(ws) - self.ids.keys() else None
        get = self.ids.__getitem__
        best = np.full(len(self.bias), -np.inf, np.float32)
        step = 16384
        for a in range(0, max(1, len(ws)), step):
            part = self.rows[np.fromiter(map(get, ws[a : a + step + 2]), np.int64)]
            if len(part) < 3:
                part = np.concatenate([part, np.zeros((3 - len(part), part.shape[1]), np.float32)])
            c = 0
            for i, w in enumerate(WIDTHS):
                n = len(part) - w + 1
                total = part[0:n, c : c + FILTERS].copy()
                for o in range(1, w):
                    total += part[o : o + n, c + o * FILTERS : c + (o + 1) * FILTERS]
                s = slice(i * FILTERS, (i + 1) * FILTERS)
                np.maximum(best[s], total.max(0), out=best[s])
                c += w * FILTERS
        return float(np.maximum(best + self.bias, 0) @ self.m.out + self.m.bias)


@dataclass
class Sample:
    """Labelled texts as word numbers. Texts are not kept."""

    numbers: dict[str, int] = field(default_factory=dict)
    docs: list[np.ndarray] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    langs: list[str] = field(default_factory=list)

    def add(self, text: str | None, label: int, lang: str | None) -> None:
        number = self.numbers
        self.docs.append(np.array([number.setdefault(w, len(number)) for w in words(text)], np.int32))
        self.labels.append(int(bool(label)))
        self.langs.append(str(lang))


class Net:
    """The network over word numbers: at holds each word's rows of E; every parameter is in params."""

    def __init__(self, at: np.ndarray, params: list[np.ndarray]):
        self.at, self.params = at, params

    def forward(self, doc: np.ndarray) -> tuple:
        n, E, out, bias = len(WIDTHS), self.params[0], self.params[-2], self.params[-1]
        vec = E[self.at[doc]].sum(1) if len(doc) else np.zeros((0, DIM), E.dtype)
        if len(vec) < 3:
            vec = np.concatenate([vec, np.zeros((3 - len(vec), DIM), E.dtype)])
        pooled, where = [], []
        for w, k, b in zip(WIDTHS, self.params[1 : 1 + n], self.params[1 + n : 1 + 2 * n], strict=True):
            size = len(vec) - w + 1
            maps = sum(vec[o : o + size] @ k[o] for o in range(w))
            i = maps.argmax(0)
            where.append(i)
            pooled.append(maps[i, np.arange(FILTERS)] + b)
        raw = np.concatenate(pooled)
        return np.maximum(raw, 0) @ out + bias[0], vec, where, raw

    def gradient(self, batch: list[tuple[np.ndarray, float, float]]) -> list:
        """Of the summed log loss of (document, label, weight); that of E as (rows, their gradients)."""
        n, out = len(WIDTHS), self.params[-2]
        grads = [None, *(np.zeros_like(x) for x in self.params[1:])]
        rows, steps = [], []
        for doc, y, weight in batch:
            logit, vec, where, raw = self.forward(doc)
            g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight
            grads[-2] += g * np.maximum(raw, 0)
            grads[-1] += g
            back = g * out * (raw > 0)
            for i, w in enumerate(WIDTHS):
                gb = back[i * FILTERS : (i + 1) * FILTERS]
                grads[1 + n + i] += gb
                for o in range(w):
                    p = where[i] + o
                    grads[1 + i][o] += (vec[p] * gb[:, None]).T
                    real = p < len(doc)
                    if real.any():
                        rows.append(self.at[doc[p[real]]].reshape(-1))
                        steps.append(np.repeat((self.params[1 + i][o] * gb).T[real], PARTS, 0))
        if rows:
            r, inv = np.unique(np.concatenate(rows), return_inverse=True)
            g = np.zeros((len(r), DIM), self.params[0].dtype)
            np.add.at(g, inv, np.concatenate(steps))
            grads[0] = (r, g)
        return grads


def train(texts: list[str], labels: list[int], langs: list[str], **settings) -> Model:
    sample = Sample()
    for x in zip(texts, labels, langs, strict=True):
        sample.add(*x)
    return fit_sample(sample, **settings)


def fit_sample(sample: Sample, epochs: int = 6, seed: int = 7) -> Model:
    """Fit by minibatch Adam on the first four fifths; calibrate the score and the languages' thresholds on the rest.

    The first dimension of an embedding begins as how much its word marks label 1 in the training texts (a z score of
    document frequencies), the other ones and the filters as small random numbers. The order in which words were
    numbered makes no difference.
    """
    m, rng, docs = Model(), np.random.default_rng(seed), sample.docs
    y = np.array(sample.labels, np.float32)
    share = (y.sum() + 0.5) / (len(y) + 1)
    m.bias = float(np.log(share / (1 - share)))
    if len(set(sample.labels)) < 2:
        return m
    names = list(sample.numbers)
    m.rows = np.unique(np.fromiter((x for w in names for x in features(w)), np.int32, PARTS * len(names)))
    at, size = m.places(names).astype(np.int32), len(m.rows) + 1
    fold = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    learn = np.flatnonzero(~fold)
    if len(set(y[learn])) < 2:
        fold[:] = False
        learn = np.arange(len(y))
    n1, n0 = y[learn].sum(), (1 - y[learn]).sum()
    seen = np.zeros((2, size), np.float32)
    for d in learn:
        seen[int(y[d]), np.unique(at[np.unique(docs[d])])] += 1
    p1, p0, p = (seen[1] + 0.5) / (n1 + 1), (seen[0] + 0.5) / (n0 + 1), (seen.sum(0) + 1) / (n1 + n0 + 2)
    z = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-9)
    E = rng.standard_normal((size, DIM), np.float32)
    E *= np.float32(0.02)
    E[:, 0] = np.clip(z / max(4.0, np.abs(z[:-1]).max(initial=0) / 2), -1, 2)
    E[-1] = 0
    K = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for k in K:
        k[:, 0, :2] += 1
    kb = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
    weight = np.where(y == 1, 0.5 * len(learn) / n1, 0.5 * len(learn) / n0).astype(np.float32)
    net = Net(at, [E, *K, *kb, out, np.array([m.bias], np.float32)])
    mom, var, t, rate = [np.zeros_like(x) for x in net.params], [np.zeros_like(x) for x in net.params], 0, 0.01
    for _ in range(epochs):
        order = rng.permutation(learn)
        for a in range(0, len(order), 32):
            batch = order[a : a + 32]
            t += 1
            for i, g in enumerate(net.gradient([(docs[d], y[d], weight[d] / len(batch)) for d in batch])):
                if g is None:
                    continue
                sel, g = g if i == 0 else (slice(None), g)
                mom[i][sel] = 0.9 * mom[i][sel] + 0.1 * g
                var[i][sel] = 0.99 * var[i][sel] + 0.01 * g * g
                net.params[i][sel] -= rate * (0.3 if i == 0 else 1) * (mom[i][sel] / (1 - 0.9**t)) / (np.sqrt(var[i][sel] / (1 - 0.99**t)) + 1e-6)
    m.embedding, m.kernels, m.kernel_bias, m.out, m.bias = E, K, kb, out, float(net.params[-1][0])
    own = np.flatnonzero(fold) if len(set(y[fold])) == 2 else learn
    scorer = Scorer(m)
    logits = np.array([scorer.logit_of([names[i] for i in docs[d]]) for d in own])
    best, gap = cut_at(logits, y[own])
    # The score is CUTOFF where the fold is split best, and steep enough to leave the middle on both sides of it.
    m.slope = float(min(4.0, max(0.5, 4.0 / max(gap, 1e-3)))) if gap > 0 else 1.0
    m.shift = float(np.log(CUTOFF / (1 - CUTOFF)) - m.slope * best)
    scores = m.calibrated(logits)
    langs = np.array([sample.langs[d] for d in own])
    for lang in sorted(set(langs)):
        mine = langs == lang
        if min(y[own][mine].sum(), (1 - y[own][mine]).sum()) >= 20:
            m.thresholds[lang] = float(np.clip(cut_at(scores[mine], y[own][mine])[0], 0.3, 0.9))
    return m


def cut_at(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The cut with the best F1, in the middle between its neighbours, and their distance."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    last = np.append(s[:-1] != s[1:], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    nxt = s[k + 1] if k + 1 < len(s) else s[k] - 1
    return float((s[k] + nxt) / 2), float(s[k] - nxt)


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 8000, max_chars: int = 20_000) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out: at most max_rows / 2 of each class, those
    with the least hash of their id, among texts of at most max_chars characters. One task gathers and trains on it, so
    at most 2 * max_rows texts of that length reach it, whatever the size of the corpus, a lost executor is made up for
    by another, and the driver gets the fitted model alone.

    Defined cases: rows with a null id, label or text are passed over; an id with several labels has the largest; an id
    with several texts counts with each; no labels, or labels of one class, give a model of one score."""
    own = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang")).where(F.length("text") <= max_chars)
    size = own.groupBy("y").count().collect()  # two rows
    most = max_rows // 2
    rate = {r["y"]: min(1.0, 1.3 * most / r["count"]) for r in size}
    # Thinned by a hash to little more than what is kept: a table of bounded size, so the texts need no shuffle.
    u = F.pmod(F.xxhash64(F.lit(3), F.col("id")), F.lit(1 << 30))
    keep = u < F.when(F.col("y") == 1, F.lit(rate.get(1, 1.0))).otherwise(F.lit(rate.get(0, 1.0))) * F.lit(float(1 << 30))
    thin = own.withColumn("u", u).where(keep).orderBy("u", "id").limit(2 * max_rows)
    rows = texts.join(F.broadcast(thin), "id").select("u", "id", F.xxhash64("text").alias("tie"), "y", "lang", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, counts = Sample(), [0, 0]
        for b in batches:  # in the order of u, id and tie
            for y, lang_, text in zip(*(b.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                counts[bool(y)] += 1
                if counts[bool(y)] <= most:
                    sample.add(text, y, lang_)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_sample(sample))], pa.binary())], names=["model"])

    got = rows.repartition(1).sortWithinPartitions("u", "id", "tie").mapInArrow(learn, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit_sample(Sample())


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of docs: its columns, then toxic_score (0 to 1, from the words alone) and toxic (true where
    the score reaches the threshold of the row's language, or CUTOFF where none was calibrated).

    Whole texts are scored in steps that overlap by the widest filter. Defined cases: null, empty and wordless texts
    get the score of empty positions; repeated rows and null ids give a row each; a model of no labels, or of one
    class, gives one score to all; columns of docs named like the two new ones are replaced.
    """
    kept = docs.drop("toxic_score", "toxic")
    held = F.col(lang_col).cast("string") if lang_col in kept.columns else F.lit(None).cast("string")

    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, model = Scorer(sent.value), sent.value
        for b in batches:
            own = b.schema.get_field_index("__text")
            logits = np.array([scorer.logit(t) for t in b.column(own).to_pylist()], np.float64)
            score = model.calibrated(logits)
            at = [model.thresholds.get(x, CUTOFF) for x in b.column(own + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:own], pa.array(score, pa.float64()), pa.array(score >= np.array(at, np.float64), pa.bool_())], names=[*b.schema.names[:own], "toxic_score", "toxic"])

    schema = kept.withColumns({"toxic_score": F.lit(0.0), "toxic": F.lit(True)}).schema
    return kept.withColumns({"__text": F.col(text_col).cast("string"), "__lang": held}).mapInArrow(run, schema)
