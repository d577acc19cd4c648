import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import campaigns, quality, scans, threat


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small ranges are kept apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_composed_maps_equal_a_walk(spark, monkeypatch):
    """One key of most rows in many ranges, pieces of three rows in three levels."""
    monkeypatch.setattr(scans, "PIECE", 3)
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.8 else r.choice("abc"), i, [r.randrange(4) for _ in range(4)]) for i in range(300)]
    placed = scans.in_ranges(spark.createDataFrame(rows, "k string, i int, m array<int>").repartition(4), ["k"], ["i"])
    assert placed.where("k = 'hot'").select("__range").distinct().count() > 1
    got = {r["i"]: (r["state_before"], r["state"]) for r in scans.states(placed, ["k"], ["i"], F.col("m"), 4, 2).collect()}
    state, want = {}, {}
    for k, i, m in rows:
        before = state.get(k, 2)
        state[k] = m[before]
        want[i] = (before, m[before])
    assert got == want


def test_running_values_over_ranges(spark):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.8 else "b", i, r.choice([None, *range(9)])) for i in range(200)]
    placed = scans.in_ranges(spark.createDataFrame(rows, "k string, i int, x int"), ["k"], ["i"])
    out = scans.prefixed(placed, ["k"], ["i"], sums={"s": F.col("x")}, most={"m": F.col("x")}, most_before={"b": F.col("x")})
    got = {r["i"]: (r["s"], r["m"], r["b"]) for r in out.collect()}
    seen, want = {}, {}
    for k, i, x in rows:
        earlier = [v for v in seen.setdefault(k, []) if v is not None]
        now = earlier + ([x] if x is not None else [])
        want[i] = (sum(now), max(now, default=None), max(earlier, default=None))
        seen[k].append(x)
    assert got == want


def test_stages_of_one_long_campaign(spark, monkeypatch):
    monkeypatch.setattr(scans, "PIECE", 4)
    r = random.Random(3)
    rows, t = [], 0
    for _ in range(250):
        t += r.choice([60, 600, 600, 3000])
        rows.append(("A", t, r.choice(["NORMAL", "WATCH", "HIGH", "CRITICAL"]), r.choice([0.1, 0.3, 0.5]), r.choice([0.3, 0.6]), r.choice([0.3, 0.7]), r.choice([-0.1, -0.03, 0.0]), r.choice([-0.6, -0.3, 0.0])))
    schema = "asset_id string, epoch long, severity string, social double, coordination double, market double, price_return double, pressure double"
    got = {x["epoch"]: (x["session"], x["version"], x["stage"], x["changed"]) for x in campaigns.stages(spark.createDataFrame(rows, schema)).collect()}
    # The table of transitions as it is specified: stage, test, next stage.
    high, calm = ("HIGH", "CRITICAL"), ("NORMAL",)
    table = [
        ("NORMAL", lambda s, so, co, mk, pr, ps: so >= 0.35, "EARLY_SOCIAL_SEEDING"), ("EARLY_SOCIAL_SEEDING", lambda s, so, co, mk, pr, ps: mk >= 0.6 and s in high, "MARKET_PUMP"),
        ("EARLY_SOCIAL_SEEDING", lambda s, so, co, mk, pr, ps: co >= 0.55, "COORDINATED_AMPLIFICATION"), ("EARLY_SOCIAL_SEEDING", lambda s, so, co, mk, pr, ps: s in calm and so < 0.2, "NORMAL"),
        ("COORDINATED_AMPLIFICATION", lambda s, so, co, mk, pr, ps: pr <= -0.08, "DUMP"), ("COORDINATED_AMPLIFICATION", lambda s, so, co, mk, pr, ps: mk >= 0.6 and s in high, "MARKET_PUMP"),
        ("COORDINATED_AMPLIFICATION", lambda s, so, co, mk, pr, ps: s in calm and so < 0.2, "POST_EVENT"), ("MARKET_PUMP", lambda s, so, co, mk, pr, ps: pr <= -0.08, "DUMP"),
        ("MARKET_PUMP", lambda s, so, co, mk, pr, ps: ps <= -0.25 or pr < -0.02, "POSSIBLE_DISTRIBUTION"), ("POSSIBLE_DISTRIBUTION", lambda s, so, co, mk, pr, ps: pr <= -0.08 or ps <= -0.5, "DUMP"),
        ("POSSIBLE_DISTRIBUTION", lambda s, so, co, mk, pr, ps: s in calm, "POST_EVENT"), ("DUMP", lambda s, so, co, mk, pr, ps: s in calm, "POST_EVENT"),
    ]
    want, stage, session, version, last = {}, "NORMAL", 0, 0, None
    for _, t, *x in rows:
        if last is not None and t - last > 1800:
            stage, session, version = "NORMAL", session + 1, 0
        last, version = t, version + 1
        new = next((to for at, test, to in table if at == stage and test(*x)), stage)
        want[t] = (session, version, new, new != stage)
        stage = new
    assert got == want and len({w[2] for w in want.values()}) >= 5


def test_cool_down_of_dense_and_sparse_alerts(spark):
    r = random.Random(4)
    rows = []
    for a, step in (("dense", (1, 5, 20)), ("sparse", (200, 299, 300, 301)), ("tied", (0, 0, 100))):
        t = 0
        for i in range(1, 120):
            t += r.choice(step)
            rows.append((a, "X", t, i, "WATCH", "created" if i == 1 else "severity_changed" if i in (40, 41) else "refreshed"))
    states = spark.createDataFrame(rows, "asset_id string, alert_type string, epoch long, occurrence int, max_severity string, event string")
    got = {(x["asset_id"], x["occurrence"]): (x["suppressed"], x["reason"]) for x in campaigns.notified(states, 300).collect()}
    want, last = {}, {}
    for a, _, t, i, _, event in rows:
        quiet = event == "refreshed" and t - last[a] < 300
        want[a, i] = (quiet, "COOLDOWN" if quiet else None)
        if not quiet:
            last[a] = t
    assert got == want


def test_quality_in_slices_equals_one_scan(spark):
    r = random.Random(5)
    rows = [("s", r.choice("AAAB"), i, float(i), float(i + r.choice([0, 0, 40])), i // 3 + r.choice([0, 0, 0, 5, -2]), r.random() < 0.6) for i in range(300)]
    df = spark.createDataFrame(rows, "source string, asset_id string, arrival int, epoch double, ingested_epoch double, sequence int, is_orderbook boolean")
    one, cut = quality.observe(df, 30), quality.observe_in_slices(df, 30)
    assert sorted(map(str, one.select(sorted(one.columns)).collect())) == sorted(map(str, cut.select(sorted(one.columns)).collect()))
    assert set(one.columns) == set(cut.columns) and one.where("orderbook_state = 'RECOVERED'").count() > 0


def test_coverage_of_any_policies_and_runs(spark):
    """Every asked time against every policy in force and every run, written out."""
    r = random.Random(6)
    policies = [(f"p{i}", r.choice([None, None, "A", "B"]), (f := r.randrange(0, 50)), r.choice([None, f + r.randrange(0, 60)]), r.randrange(0, 30)) for i in range(12)]
    runs = [(f"p{r.randrange(0, 10)}", float(c - r.randrange(0, 20)), float(c), r.choice(["SUCCESS", "SUCCESS", "FAILED"])) for c in (r.randrange(0, 120) for _ in range(90))]
    at = [(a, t) for a in "ABC" for t in range(-2, 125, 3)]
    got = spark.createDataFrame(policies, "policy_id string, policy_asset string, effective_from long, effective_to long, max_staleness long")
    out = quality.coverage(got, spark.createDataFrame(runs, "policy_id string, started double, completed double, status string"), spark.createDataFrame(at + at[:5], "asset_id string, epoch long"))
    want = {}
    for a, t in at:
        own = [p for p in policies if p[1] in (None, a) and p[2] <= t and (p[3] is None or t < p[3])]
        last = [max(((s, c, st) for i, s, c, st in runs if i == p[0] and c <= t), default=None) for p in own]
        if own:
            want[a, t] = (len(own), sum(x is None or x[2] != "SUCCESS" or t - x[1] > p[4] for p, x in zip(own, last, strict=True)))
    assert {(x["asset_id"], x["epoch"]): (x["policies"], x["degraded"]) for x in out.collect()} == want
    assert all(x["complete"] == (x["degraded"] == 0) for x in out.collect())


def test_newest_hits_at_every_cutoff(spark, monkeypatch):
    monkeypatch.setattr(scans, "PIECE", 5)
    r = random.Random(7)
    hits = [(r.choice("AAAB"), i, (t := r.randrange(0, 300)), t + r.choice([0, 5, 200]), r.random()) for i in range(250)]
    at = [(a, c) for a in "ABC" for c in range(0, 520, 20)]
    df = spark.createDataFrame(hits, "asset_id string, match_id int, epoch long, fetched_at long, confidence double")
    got = {(x["asset_id"], x["cutoff"]): (x["n"], x["status"], x["threat_confidence"]) for x in threat.context(spark.createDataFrame(at, "asset_id string, cutoff long"), df, newest=7).collect()}
    for a, c in at:
        known = sorted(((-e, i, conf) for b, i, e, f, conf in hits if b == a and e <= c and f <= c))[:7]
        assert got[a, c] == (len(known), "MATCHED" if known else "NO_MATCH", max((x[2] for x in known), default=0.0))
