import hashlib
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import narratives, serving, threat

SCHEMA = "id long, vector array<double>, scope string, kept boolean"


def brute(rows, queries, k):
    """By all pairs: (query, place, id, similarity), with the filters."""
    unit = {r[0]: np.array(r[1]) / (np.linalg.norm(r[1]) or 1.0) for r in rows if r[1] is not None}
    out = set()
    for q in queries:
        if q[1] is None:
            continue
        near = sorted((-round(float(np.clip(unit[q[0]] @ unit[r[0]], 0, 1)), 9), r[0]) for r in rows if r[1] is not None and r[0] != q[0] and r[2] == q[2] and r[3])
        out |= {(q[0], n + 1, i, -s) for n, (s, i) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize("block", [7, 64])
def test_filtered_nearest_equals_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.05 * rng.normal(size=16)).tolist(), [None, "a", "b"][i % 3 if i % 5 else 0], i % 7 != 0) for i in range(400)]
    rows[10], rows[11], rows[30] = (10, [0.0] * 16, "a", True), (11, None, "a", True), (30, (-centres[0]).tolist(), "solo", True)
    df = spark.createDataFrame(rows, SCHEMA)
    asked = [r for r in rows if r[0] % 10 == 0 or r[0] == 11]
    q = spark.createDataFrame(asked, SCHEMA)
    got = {(r["query_id"], r["place"], r["id"], round(r["similarity"], 9)) for r in narratives.nearest(q, df, 4, block=block, within=("scope",), where=F.col("kept"), pivots=10).collect()}
    assert got == brute(rows, asked, 4) and not any(g[0] == 30 for g in got)


def test_cells_are_passed_over_where_vectors_lie_in_clusters(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 32))
    rows = [(i, (centres[i % 20] + 0.02 * rng.normal(size=32)).tolist(), "s", True) for i in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    v = narratives.visited(df.where("id % 20 < 10"), df, 5, block=100, pivots=40).collect()
    assert len(v) == 400 and all(r["cells"] >= 15 for r in v) and sum(r["visited"] for r in v) < 0.3 * sum(r["cells"] for r in v)
    got = {(r["query_id"], r["place"], r["id"], round(r["similarity"], 9)) for r in narratives.nearest(df.where("id < 40"), df, 5, block=100, pivots=40).collect()}
    assert got == brute(rows, rows[:40], 5)


def test_similarities_of_full_blocks_are_held_in_slices():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(2048, 16)), rng.normal(size=(2048, 16))
    x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
    y[5:9] = y[5]  # ties, by id
    ids, own = np.arange(2048), rng.permutation(4096)[:2048]
    tracemalloc.start()
    got = []
    for i, j, s in narratives._best(ids, x, own, y, 5):
        got.append((i, j, s))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6  # all similarities at once are 33 MB, and more with their copies
    s = np.clip(x @ y.T, 0, 1)
    s[ids[:, None] == own[None]] = -1
    for q, (i, j, v) in enumerate(got):
        assert (i == q).all() and j.tolist() == own[np.lexsort((own, -s[q].round(12)))[:5]].tolist() and np.allclose(v, np.sort(s[q])[::-1][:5])


def test_nearest_of_nothing(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, [1.0, 0.0], "s", True)], SCHEMA)
    assert narratives.nearest(none, one, 3).count() == narratives.nearest(one, none, 3).count() == narratives.nearest(one, one, 3).count() == 0


def test_digests_without_lists(spark):
    rows = [("a", 1, 3, "x"), ("a", 1, 1, "y,z"), ("a", None, 2, "é"), (None, 1, 1, "q"), ("b", 2, 1, None), ("a", 1, 1, "a")]
    df = spark.createDataFrame(rows, "k string, n int, t int, v string")
    got = {(r[0], r[1]): (r["digest"], r[3]) for r in serving.digests(df.withColumnRenamed("n", "m"), ["k", "m"], ["t", "v"], "v", sep="|").collect()}
    own = lambda *v: (hashlib.sha256("|".join(v).encode()).hexdigest(), len(v))
    assert got == {("a", 1): own("a", "y,z", "x"), ("a", None): own("é"), (None, 1): own("q")}
    big = spark.range(50_000).select((F.col("id") % 2).alias("g"), "id").repartition(6)
    for r in serving.digests(big, ["g"], ["id"], "id").collect():
        assert r["digest"] == hashlib.sha256(",".join(str(i) for i in range(r["g"], 50_000, 2)).encode()).hexdigest() and r["n"] == 25_000


def test_domains_of_any_script(spark):
    names = ["Bücher.example", "münchen.DE.", "例え.テスト", "faß.de", "plain.example", "a_b.example", "-x.example", "é" * 70 + ".example", "ПРИМЕР.рф", "", "..", "x..y"]

    def standard(v):
        """By the standard library's codec, then the rules for labels."""
        try:
            d = v.rstrip(".").lower().encode("idna").decode("ascii").lower()
        except UnicodeError:
            return None
        labels = d.split(".")
        ok = all(p and len(p) <= 63 and p[0] != "-" and p[-1] != "-" and all(c.isascii() and (c.isalnum() or c == "-") for c in p) for p in labels)
        return d if ok and len(d) <= 253 else None

    got = {r["v"]: r["d"] for r in spark.createDataFrame([(n,) for n in names], "v string").select("v", threat.domain(F.col("v")).alias("d")).collect()}
    assert got == {n: standard(n) for n in names} and got["Bücher.example"] == "xn--bcher-kva.example"
    url = spark.createDataFrame([("HTTPS://u@Bücher.example:443/Ä?q#f",)], "v string").select(threat.url(F.col("v")).alias("u")).first()["u"]
    assert url == "https://xn--bcher-kva.example/Ä?q"
