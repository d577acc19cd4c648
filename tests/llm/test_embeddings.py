import numpy as np

from tidewatch.llm import embeddings as e


def corpus(seed=2, size=16):
    rng = np.random.default_rng(seed)
    rows, n = [], 0

    def put(v, label):
        nonlocal n
        rows.append((n, None if v is None else [float(x) for x in v], label))
        n += 1

    for label in (0, 1, None):
        for _ in range(60):
            base = rng.normal(size=size)
            put(base, label)
            for _ in range(rng.integers(0, 4)):
                put((base + rng.normal(size=size) * 0.03) * rng.uniform(0.1, 9), label)
    hot = rng.normal(size=size)
    for _ in range(300):
        put(hot + rng.normal(size=size) * 0.02, 1)
    for _ in range(5):
        put(hot, 1)
    return rows


def brute(rows):
    good = [r for r in rows if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in good])
    near = (x @ x.T >= 0.98) & (lab[:, None] == lab[None])
    np.fill_diagonal(near, False)
    links = {r[0]: 0 for r in rows} | {r[0]: int(k) for r, k in zip(good, near.sum(1))}
    comp = {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for i, r in enumerate(good):
            least = min([comp[r[0]], *(comp[good[j][0]] for j in np.flatnonzero(near[i]))])
            if least < comp[r[0]]:
                comp[r[0]], changed = least, True
    return links, comp


def test_recall_and_components_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links, comp = brute(rows)
    got = {r["vec_id"]: r for r in e.near_vectors(df, centres=4, block=64).collect()}
    assert len(got) == len(rows)
    found, there = sum(r["n_links"] for r in got.values()), sum(links.values())
    assert 0.97 * there <= found <= there and all(got[i]["n_links"] <= links[i] for i in links)
    assert sum(got[i]["component_id"] == comp[i] for i in comp) >= 0.99 * len(comp)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    # With a reach over all cells nothing is missed.
    exact = {r["vec_id"]: r for r in e.near_vectors(df, centres=1, block=64).collect()}
    assert all(exact[i]["n_links"] == links[i] and exact[i]["component_id"] == comp[i] for i in links)


def test_odd_vectors(spark):
    one, nan, inf = [1.0, 0.0, 1.0, 0.0], float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0] * 4, 1), (4, [1.0, None, 1.0, 0.0], 1), (5, [nan] * 4, 1), (6, [inf, 0.0, 1.0, 0.0], 1), (7, one, None), (8, one, 1), (8, one, 1), (9, [2.0, 0.0, 2.0, 0.0], 1), (10, one, 2), (11, [1.0, 0.0], 1), (None, one, 3), (12, [1e200, 0.0, 1e200, 0.0], 1)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    got = e.near_vectors(df).collect()
    links = {(r["vec_id"], r["n_links"], r["component_id"]) for r in got}
    assert len(got) == len(rows)
    assert links == {(i, 0, i) for i in (1, 2, 3, 4, 5, 6, 7, 10, 11)} | {(8, 3, 8), (9, 3, 8), (12, 3, 8), (None, 0, None)}
    assert e.near_vectors(df.limit(0)).count() == 0


def test_wide_vectors_long_labels_and_labels_like_components(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=768)
    rows = [(i, (base + 0.02 * rng.normal(size=768)).tolist(), "l" * 5000) for i in range(150)]
    rows += [(200, [2.0], "a,1.0"), (201, [1.0, 2.0], "a"), (202, [2.0, 4.0], "a"), (203, [1.0, 2.0], "1:a")]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in e.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), centres=1, block=32).collect()}
    assert all(got[i] == (149, 0, i == 0) for i in range(150))
    assert got[200] == (0, 200, True) and got[203] == (0, 203, True) and got[201] == (1, 201, True) and got[202] == (1, 201, False)
