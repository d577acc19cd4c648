import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import packing, tokens


def check_plan(histogram, capacity):
    """Each document has a place, places of a sequence are gapless from 0; returns the number of sequences."""
    p = packing.plan(histogram, capacity)
    rows = sorted((int(s), int(o), length) for length, n in histogram.items() for s, o in zip(*p.find(np.full(n, length), np.arange(n)), strict=True))
    at = {}
    for s, o, length in rows:
        assert o == at.get(s, 0) and o + length <= capacity
        at[s] = o + length
    assert sorted(at) == list(range(p.sequences))
    return p


def best_fit(histogram, capacity):
    rooms, n = [], 0
    for length in sorted((x for x, k in histogram.items() for _ in range(k)), reverse=True):
        fit = min((r for r in enumerate(rooms) if r[1] >= length), key=lambda r: r[1], default=None)
        if fit:
            rooms[fit[0]] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=40))
def test_any_histogram_is_packed(histogram):
    check_plan(histogram, 64)


def test_as_few_sequences_as_best_fit_or_the_bound():
    for seed, mean in ((1, 0.05), (2, 0.2), (3, 0.4)):
        rng = np.random.default_rng(seed)
        for n in (30, 3000):
            lengths = np.clip((rng.exponential(mean, n) * 512).astype(int), 1, 512)
            histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
            got, bound = check_plan(histogram, 512), -(-int(lengths.sum()) // 512)
            assert bound <= got.sequences <= max(best_fit(histogram, 512), bound) * 1.01 + 1
            assert n < 3000 or got.by_pattern > 0


def test_least_squares_fit_the_counts():
    """Counts that patterns can make exactly are met, and repeats are never negative."""
    lengths = np.arange(1, 64)
    sets = packing.patterns(lengths, 64)
    assert ((np.append(lengths, 0)[sets]).sum(1) == 64).all() and len(np.unique(np.sort(sets, 1), axis=0)) == len(sets)
    assert {tuple(sorted(x)) for x in np.append(lengths, 0)[sets].tolist()} == {(a, b, 64 - a - b) for a in range(64) for b in range(a, 64) if 64 - a - b >= b and b > 0}
    made = np.zeros(64)
    for s in sets[:: max(1, len(sets) // 50)]:
        for d in s[s >= 0]:
            made[d] += 20
    x = packing.fitted(sets, made[:63], 2000)
    covered = np.bincount(np.where(sets < 0, 63, sets).ravel(), np.repeat(x, 3), minlength=64)[:63]
    assert (x >= 0).all() and np.abs(covered - made[:63]).max() < 0.1


def test_patterns_stay_bounded():
    assert len(packing.patterns(np.arange(1, 2048), 2048, 10_000)) < 25_000


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.VOCABULARY)


def test_ids_are_those_of_the_library(library):
    encode, r = tokens.Encoder(packing.VOCABULARY), random.Random(5)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "​", "a", "é", "é", "don't", "12", "_", "—", "\U0001f600", "<|endoftext|>", "<|end", "Ż", "中", "नमस्ते"]
    for text in ["".join(r.choice(parts) for _ in range(r.randrange(0, 16))) for _ in range(4000)]:
        assert np.frombuffer(encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_rows_and_sequences(spark, library):
    r = random.Random(2)
    texts = [None, "", " ", "a<|endoftext|>b", "same text"] * 2 + [" ".join(r.choice(["alpha", "be", "gamma42", "é"]) for _ in range(r.choice([3, 20, 150, 400]))) for _ in range(150)] + ["x " * 1000, "\n" * 3000, "word" * 20_000]
    rows = [(None if i == 3 else i // 2 * 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("clash")).withColumn("length", F.lit(1)).repartition(4)
    packed = packing.pack_documents(docs, capacity=256).persist()
    got = [x.asDict() for x in packing.digest(packed).collect()]
    want = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 256 or min(len(ids), 256), len(ids) + 1, 256)] if len(ids) > 256 else [0, len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got), key=str) == sorted(want, key=str)
    at = {}
    for x in sorted(got, key=lambda x: (x["sequence_id"], x["offset"])):
        assert x["offset"] == at.get(x["sequence_id"], 0)
        at[x["sequence_id"]] = x["offset"] + x["length"]
    assert max(at.values()) <= 256 and len(at) <= best_fit(Counter(x["length"] for x in got), 256) + 1
    whole = {x["sequence_id"]: (x["tokens"], x["starts"]) for x in packing.sequences(packed).collect()}
    assert {s: len(t) // 2 for s, (t, _) in whole.items()} == at
    for x in packed.collect():
        tokens_, starts = whole[x["sequence_id"]]
        assert x["offset"] in starts and tokens_[2 * x["offset"] : 2 * (x["offset"] + x["length"])] == bytes(x["ids"])


def test_bases_joined_by_a_shuffle_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 90)) for i in range(300)], "doc_id long, text string").repartition(6)
    one = sorted(map(tuple, packing.digest(packing.pack_documents(docs, capacity=128)).drop("sequence_id", "offset").collect()))
    monkeypatch.setattr(packing, "SMALL", 0)
    packed = packing.digest(packing.pack_documents(docs, capacity=128)).collect()
    assert sorted(tuple(x.asDict()[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for x in packed) == sorted((x[0], x[1], x[2], x[3], x[4]) for x in one)
    assert len({(x["sequence_id"], x["offset"]) for x in packed}) == len(packed)


def test_no_rows(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
