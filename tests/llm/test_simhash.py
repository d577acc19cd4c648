import random

import numpy as np
import xxhash

from tidewatch.llm import simhash


def plain(text):
    ws = "".join(c.lower() if c.isascii() else c for c in (text or "")).encode().split()
    if not ws:
        return 0
    sh = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [b" ".join(ws)]
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(values):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def test_quadruples_leave_one_set_whole():
    from itertools import combinations

    sets = simhash.quadruples()
    assert len(sets) == 14
    for three in combinations(range(8), 3):
        assert any(not set(three) & set(s) for s in sets)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}É" for i in range(300)]
    texts = [None, "", " \t ", "One", "one", "a b", "A\x0bB c"]
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 200))]
        texts.append(" ".join(base))
        for _ in range(6):
            v = list(base)
            v[rng.randrange(len(v))] = rng.choice(vocab)
            texts.append("  ".join(v))
    texts += texts[10:14]
    want_fp = [plain(t) for t in texts]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, component_id int")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    assert [int(got[i]["fingerprint"], 16) for i in range(len(texts))] == want_fp
    assert [got[i]["component_id"] for i in range(len(texts))] == brute(want_fp)
    # Lists over the limit are dealt again by a further byte and compared in parts: the same result.
    again = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, limit=2).collect()}
    assert again == {i: got[i]["component_id"] for i in got}


def test_long_text_repeated_ids_and_no_rows(spark):
    long = " ".join(f"t{i % 977}" for i in range(200_000))
    df = spark.createDataFrame([(5, long), (5, long), (None, long), (9, "zz")], "doc_id long, text string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == 4 and sorted(r["component_id"] for r in got) == [5, 5, 5, 9]
    assert int(got[0]["fingerprint"], 16) in {plain("zz"), simhash.fingerprint(long.encode())}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_forest_links_all_that_pairs_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(6), base ^ np.uint64(1 << 40)]))
    root = {int(v.view(np.int64)): int(v.view(np.int64)) for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = simhash.forest(values, block=16)
    for a, b in links:
        root[find(a)] = find(b)
    groups = brute([int(v) for v in values])
    mine = [find(int(v.view(np.int64))) for v in values]
    assert len(set(zip(groups, mine))) == len(set(groups)) == len(set(mine)) and len(links) == len(values) - len(set(groups))
