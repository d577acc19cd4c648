import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, scale=256, every=50, positives=5, most=3, low=50, high=95):
    good = [(i, tuple(math.floor(scale * x) for x in v), l) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q, label) in enumerate(good):
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p, strict=True)), j, l) for b, (j, p, l) in enumerate(good) if b != a and len(p) == len(q))
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:most]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k, _) in enumerate(fit)]
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 20), st.integers(1, 6), st.integers(0, 9), st.sampled_from([1, 3, 300, 1 << 23]), st.integers(0, 1 << 30))
def test_lookups_are_inner_products(size, anchors, rows, largest, seed):
    rng = np.random.default_rng(seed)
    q, p = (rng.integers(-largest, largest, (n, size)) for n in (anchors, rows))
    assert (negatives.scores(q, negatives.planes(p)) == p @ q.T).all()


def test_no_more_planes_than_needed():
    assert len(negatives.planes(np.array([[0]]))) == 1 and len(negatives.planes(np.array([[-1]]))) == 1
    assert len(negatives.planes(np.array([[1]]))) == 2 and len(negatives.planes(np.array([[-129]]))) == 9


def vectors(n, size, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, size))
    return [(i, (0.2 * (centres[i % labels] + 1.5 * rng.normal(size=size))).tolist(), int(rng.integers(0, labels)) if i % 3 else 0) for i in range(n)]


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash")).withColumn("code", F.lit(1)).repartition(3)
    return sorted(map(tuple, negatives.hard_negatives(df, **options).collect()))


def test_equals_all_pairs(spark):
    rows = vectors(400, 13, 1)
    assert len(run(spark, rows)) > 50
    assert run(spark, rows) == brute(rows)
    # Blocks and chunks smaller than labels, and labels smaller than blocks; every row an anchor.
    many = [(i, v, i % 40) for i, v, _ in vectors(150, 8, 2)]
    assert run(spark, many, block=16, anchor_block=7, anchor_every=1) == brute(many, every=1)


def test_ties_repeats_nulls_and_sizes(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [0.5, 0.25], i % 3) for i in range(0, 120)] + [(i, [0.5, 0.1], (i + 1) % 3) for i in range(120, 240)]
    odd = [(50, None, 1), (None, [0.5, 0.2], 1), (100, [0.1, 0.2], None), (150, [0.1, None], 1), (200, [nan, 0.1], 2), (250, [inf, 0.1], 2), (300, [], 1), (301, [], 1), (302, [], 2), (350, [0.5, 0.2, 0.1], 1), (351, [0.5, 0.2, 0.1], 1), (352, [0.4, 0.1, 0.1], 2), (400, [-0.5, -0.5], 0), (450, [0.0, 0.0], 2)]
    rows = same + odd
    assert run(spark, rows, block=32) == brute(rows)
    twice = vectors(120, 5, 3) + vectors(120, 5, 3)[:60]
    got = run(spark, twice)
    assert got == brute(twice)


def test_components_beyond_the_bound_take_no_part(spark):
    rows = vectors(200, 4, 4)
    assert run(spark, rows + [(500, [1e300, 0.0, 0.0, 0.0], 1), (501, [70000.0, 0.0, 0.0, 0.0], 1)]) == brute(rows)


def test_no_rows(spark):
    assert run(spark, [(1, [0.1], 1)][:0]) == [] and run(spark, [(1, [0.1], 1)]) == [] and run(spark, [(0, [0.1], 1)]) == []
