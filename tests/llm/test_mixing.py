import math

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import mixing


def brute_targets(sizes, weights, budget):
    """By rounds: share, cut off at twice the size, share the rest anew."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = budget * sum(sizes.values()), {}, list(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            open_.remove(s)
    return target


def corpus():
    docs, n = [], 0
    for s, count, words in (("a", 40, 9), ("b", 300, 20), ("é", 25, 100), ("Z", 8, 3), (None, 30, 12), ("big", 900, 15)):
        for k in range(count):
            docs.append((n, "w " * (1 + (k * 7) % (2 * words)), s, 0.5))
            n += 1
    return docs + [(n, None, "a", 0.5), (n + 1, " \t ", "b", 0.5)]


def test_targets_takes_and_limits(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, rate double")
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(docs)
    sizes = {}
    for _, t, s, _ in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes, (5, 2, 1), 1.5)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * want[r["source"]]
        assert 0 <= r["copies"] <= 2 and (r["size"] > 0 or r["copies"] == 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
        assert 0 <= r["rate"] <= 2
    largest = max(r["size"] for r in got)
    assert all(abs(taken[s] - want[s]) <= min(largest, 0.02 * want[s] + 3) for s in sizes)
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_groups_of_a_large_source(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, source string, rate double")
    r = mixing.mix_sources(df, group=50).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(x["taken"] - x["target"]) <= 0.03 * x["target"] + 5 for x in r)


def test_no_rows_one_source_and_repeated_rows(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix_sources(spark.createDataFrame([], schema)).count() == 0
    one = mixing.mix_sources(spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (None, "x " * 30_000, "s")], schema)).collect()
    assert len(one) == 3 and one[0]["target"] == 1.5 * 30_006
    none = mixing.mix_sources(spark.createDataFrame([(1, None, "s"), (2, "", None)], schema)).collect()
    assert [(r["size"], r["copies"], r["target"]) for r in none] == [(0, 0, 0.0)] * 2


#: Languages of three classes.
LANGS = ["en", "de", "fr"]


def solve(docs, target, sweeps=200):
    """Rates of [(source, class, size)] by fitting one multiplier after another by bisection until none moves."""
    x, s, c = np.array([d[2] for d in docs], float), np.array([d[0] for d in docs]), np.array([d[1] for d in docs])
    size = {k: x[s == k].sum() for k in set(s)}
    goal_c = {k: sum(x[i] * target[s[i]] / size[s[i]] for i in np.flatnonzero(c == k)) for k in set(c)}
    l, m = dict.fromkeys(size, 0.0), dict.fromkeys(goal_c, 0.0)
    for _ in range(sweeps):
        moved = 0.0
        for own, of, other, at, goal in ((l, s, m, c, target), (m, c, l, s, goal_c)):
            for k in own:
                i = np.flatnonzero(of == k)
                rest, low, high = np.array([other[v] for v in at[i]]), -60.0, 60.0
                for _ in range(80):
                    mid = (low + high) / 2
                    low, high = (mid, high) if (x[i] * 2 / (1 + np.exp(-(mid + rest) * x[i]))).sum() < goal[k] else (low, mid)
                moved, own[k] = max(moved, abs(own[k] - mid)), mid
        if moved < 1e-13:
            break
    return 2 / (1 + np.exp(-np.array([l[a] + m[b] for a, b in zip(s, c)]) * x))


def test_rates_are_the_optimum(spark):
    assert spark.createDataFrame([(x,) for x in LANGS], "x string").select(F.pmod(F.xxhash64("x"), F.lit(mixing.CLASSES))).distinct().count() == 3
    docs, n = [], 0
    for source, count, words in (("a", 60, 30), ("b", 300, 9), ("c", 150, 20), ("d", 40, 25)):
        for k in range(count):
            docs.append((n, "w " * (1 + (k * k + n) % words), source, LANGS[(k * 5 + k // 7) % 3 if source != "c" else k % 2]))
            n += 1
    got = {r["doc_id"]: r for r in mixing.mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")).collect()}
    target = {r["source"]: r["target"] for r in got.values()}
    size = {r["source"]: r["source_size"] for r in got.values()}
    full = {s for s in target if target[s] >= 2 * size[s] * (1 - 1e-12)}
    assert all(got[i]["rate"] == 2 for i, _, s, _ in docs if s in full)
    free = [(i, s, c, len(t.split())) for i, t, s, c in docs if s not in full]
    assert len({s for _, s, _, _ in free}) >= 2
    want = solve([x[1:] for x in free], target)
    assert max(abs(got[i]["rate"] - w) for (i, *_), w in zip(free, want)) < 1e-6
    # Long documents of a source are tilted more than short ones, and the tokens are the targets all the same.
    assert len({got[i]["rate"] for i, *_ in free}) > 20
    for s in {s for _, s, _, _ in free}:
        assert math.isclose(sum(got[i]["rate"] * k for i, o, _, k in free if o == s), target[s], rel_tol=1e-6)
    taken = {c: sum(got[i]["rate"] * k for i, _, o, k in free if o == c) for c in LANGS}
    for c in LANGS:
        assert math.isclose(taken[c], sum(k * target[s] / size[s] for _, s, o, k in free if o == c), rel_tol=1e-6)


def test_targets_in_many_ranges(spark, monkeypatch):
    """The running sums over ranges equal those of one pass."""
    monkeypatch.setattr(mixing.running, "__defaults__", (7,))
    sizes = {f"s{i:03}": 1 + (i * 37) % 101 for i in range(90)} | {None: 50}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = brute_targets(sizes, (5, 2, 1), 1.5)
    got = {r["source"]: r["target"] for r in mixing.source_targets(df, (5, 2, 1), 1.5).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_hot_keys_are_joined_where_they_lie(spark):
    from tidewatch.llm._common import attach

    rows = spark.range(30_000).select(F.when(F.col("id") < 20_000, 1).otherwise(F.col("id")).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    out = attach(rows, facts, "k", "n", 30_000)
    assert out.columns == ["k", "id", "v"] and out.count() == 30_000 and out.where("v <> 2 * k").count() == 0
