import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import evaluation, lifecycle, narratives, quality, serving, text


def test_nearest_in_small_blocks_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    x[7] = x[3] * 2  # a tie of cosines
    x[9] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    got = {}
    for r in narratives.nearest(df.where("id % 4 = 0"), df, 3, block=7).collect():
        got.setdefault(r["query_id"], []).append((r["place"], r["id"], round(r["similarity"], 9)))
    unit = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
    for q in range(0, 60, 4):
        s = np.clip(unit @ unit[q], 0, 1)
        order = sorted((i for i in range(60) if i != q), key=lambda i: (-round(s[i], 12), i))[:3]
        assert [i for _, i, _ in sorted(got[q])] == order


def test_summaries_and_revisions_of_narratives(spark):
    rows = [("A", 0, "p10", "u", 5, " last by time "), ("A", 0, "p2", "u", 1, "first tale"), ("A", 0, "p3", "v", 1, "tale again"), ("B", 0, "q", "w", 1, None)]
    df = spark.createDataFrame(rows, "asset_id string, window long, post_id string, author_id string, epoch long, text string")
    got = {r["asset_id"]: r for r in narratives.summaries(df.withColumnRenamed("window", "w"), ["asset_id", "w"], "w", "v1").collect()}
    a = got["A"]
    assert (a["first_post"], a["first_seen"], a["last_seen"], a["posts"], a["authors"]) == ("p2", 1, 5, 3, 2)
    assert a["summary"] == "last by time first tale tale again" and a["label"].startswith("tale / ") and got["B"]["label"] == "B discussion"
    more = narratives.summaries(df.where("post_id <> 'p10'").withColumnRenamed("window", "w"), ["asset_id", "w"], "w", "v1").where("asset_id = 'A'").first()
    assert more["narrative_id"] == a["narrative_id"] and more["revision_id"] != a["revision_id"]


def test_model_input_refuses_other_features(spark):
    df = spark.createDataFrame([("A", 1.0, 2)], "asset_id string, x double, y int")
    assert lifecycle.model_input(df, ["y", "x"], ["asset_id"], "v1").first()["vector"] == [2.0, 1.0]
    for names in (["x"], ["x", "y", "z"]):
        with pytest.raises(ValueError):
            lifecycle.model_input(df, names, ["asset_id"], "v1")


def test_connector_runs_and_chains(spark):
    rows = [(1, "INGESTED", 10, 50), (1, "UNCHANGED", 20, 50), (2, "INGESTED", 30, 50), (2, "ERROR", 40, 50), (3, "ERROR", 1, 50), (4, "RATE_LIMITED", None, 50)]
    before = spark.createDataFrame([(2, 5), (4, 7)], "run int, watermark long")
    got = {r["run"]: (r["status"], r["watermark"], r["lag_seconds"]) for r in lifecycle.connector_runs(spark.createDataFrame(rows, "run int, outcome string, published long, completed long"), ["run"], before).collect()}
    assert got[1] == ("SUCCESS", 10, 40) and got[2] == ("PARTIAL", 5, 45) and got[3][:2] == ("FAILED", None) and got[4] == ("RATE_LIMITED", 7, 43)
    chain = serving.evidence_chain(spark.createDataFrame([("A", v, f"c{v}") for v in (1, 2, 3)] + [("B", 1, "c1")], "k string, v int, c string"), "k", "v", ["c"])
    links = {(r["k"], r["version"]): r["chain_hash"] for r in chain.collect()}
    assert len(set(links.values())) == 3 and links["A", 1] == links["B", 1]
    stored = chain.where("version <> 2 or k = 'B'").withColumn("chain_hash", F.when((F.col("k") == "A") & (F.col("version") == 3), "x").otherwise(F.col("chain_hash")))
    assert {(r["k"], r["version"]): r["intact"] for r in lifecycle.intact(stored, chain, ["k", "version"]).collect()} == {("A", 1): True, ("A", 2): False, ("A", 3): False, ("B", 1): True}


def test_subscriptions_of_lists_and_of_everything(spark):
    alerts = spark.createDataFrame([(1, "A", "T", "HIGH"), (2, None, "U", "WATCH"), (3, "B", None, "CRITICAL")], "alert_id long, asset_id string, alert_type string, severity string")
    subs = spark.createDataFrame([("all", "WATCH", [], []), ("some", "NORMAL", ["A", "A", "B"], []), ("both", "HIGH", ["A"], ["T"]), ("top", "CRITICAL", [], ["T"])], "channel string, minimum string, assets array<string>, types array<string>")
    out = serving.fan_out(alerts, subs)
    assert sorted((r["channel"], r["alert_id"]) for r in out.collect()) == [("all", 1), ("all", 2), ("all", 3), ("both", 1), ("some", 1), ("some", 3)]
    assert serving.fan_out(alerts, subs, out).count() == 0


def test_policies_of_one_asset_and_of_all(spark):
    policies = spark.createDataFrame([(1, "A", 0, None, 100), (2, None, 0, 50, 100)], "policy_id int, policy_asset string, effective_from long, effective_to long, max_staleness long")
    runs = spark.createDataFrame([(1, 5, 10, "SUCCESS"), (2, 5, 8, "FAILED")], "policy_id int, started long, completed long, status string")
    at = spark.createDataFrame([("A", 20), ("A", 60), ("A", 200), ("B", 20)], "asset_id string, epoch long")
    got = {(r["asset_id"], r["epoch"]): (r["policies"], r["degraded"]) for r in quality.coverage(policies, runs, at).collect()}
    assert got == {("A", 20): (2, 1), ("A", 60): (1, 0), ("A", 200): (1, 1), ("B", 20): (1, 1)}


def test_gates_drift_and_metrics_by_model(spark):
    rng = np.random.default_rng(5)
    rows = [(m, float(np.round(p, 3)), int(rng.random() < p), bool(i % 2)) for m in (1, 2) for i, p in enumerate(rng.random(200))]
    df = spark.createDataFrame(rows, "m int, p double, y int, ref boolean")
    got = {r["m"]: r for r in evaluation.calibration_metrics(df, "p", "y", keys=("m",), slices=7).collect()}
    for m in (1, 2):
        pos, neg = ([p for k, p, y, _ in rows if k == m and y == v] for v in (1, 0))
        assert got[m]["auc"] == pytest.approx(np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg]))
    assert evaluation.drift(df.withColumn("p", F.when(F.col("ref"), F.col("p") / 4).otherwise(F.col("p"))), "m", "p", "ref").where("drift_status = 'DRIFTED'").count() == 2
    c = spark.createDataFrame([(1, 50, 0.1, 0.8, 0.2, 0.21, None, 1), (2, 50, 0.1, 0.8, 0.2, None, "STABLE", 1), (3, 50, 0.1, 0.8, 0.2, 0.1, "STABLE", 1), (4, 50, 0.1, 0.8, 0.2, 0.3, "DRIFTED", 1)], "m int, samples int, ece double, auc double, brier double, champion_brier double, drift_status string, false_positives int")
    status = lambda **k: {r["m"]: r["status"] for r in evaluation.promotion(c, 20, 0.2, 0.7, 2, **k).collect()}
    assert status() == {1: "PROMOTED", 2: "PROMOTED", 3: "PROMOTED", 4: "REJECTED"}
    assert status(champion_required=True) == {1: "PROMOTED", 2: "REJECTED", 3: "REJECTED", 4: "REJECTED"}
    assert status(champion_required=True, tolerance=0.15)[3] == "PROMOTED"


def test_worst_claim_speaks_for_a_narrative(spark):
    rows = [(1, "SUPPORTED_BEFORE", 0.15, 0.9), (1, "UNKNOWN", 0.5, None), (2, "UNSUPPORTED", 0.9, 0.1), (2, "CONFLICTING", 1.0, 0.0)]
    got = {r["n"]: (r["result"], r["claim_risk"], r["legitimate"]) for r in text.narrative_verdicts(spark.createDataFrame(rows, "n int, result string, claim_risk double, legitimate double"), "n").collect()}
    assert got == {1: ("UNKNOWN", 0.5, 0.9), 2: ("CONFLICTING", 1.0, 0.1)}


def test_percentiles_by_slices_equal_sorting(spark):
    rng = np.random.default_rng(6)
    rows = [("a", float(x)) for x in rng.normal(size=301)] + [("b", 5.0)] * 40 + [("c", float(x)) for x in rng.integers(0, 4, 50)] + [("d", 1.5), ("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    for fraction in (0.0, 0.5, 0.95, 1.0):
        want = {}
        for k in "abcd":
            own = sorted(x for q, x in rows if q == k and x is not None)
            want[k] = own[round((len(own) - 1) * fraction)]
        for slices in (1, 7, 4096):
            assert {r["k"]: r["percentile"] for r in evaluation.exact_percentile(df, ["k"], "x", fraction, slices).collect()} == want


def test_alert_claims_are_counted_without_pairs(spark):
    """As counted from the pairs; and a hundred thousand alerts of one asset with as many claims, which would be 5 billion."""
    rng = random.Random(4)
    pick = lambda n: rng.choice([None, *range(n)])
    alerts = [(i // 2 if i % 9 else None, "LIVE" if i % 5 else "OTHER", pick(4), pick(30)) for i in range(80)]
    named = [(i % 11, "LIVE" if i % 4 else "OTHER", pick(5)) for i in range(24)]
    claims = [(i, pick(12), pick(30)) for i in range(150)]
    frames = [spark.createDataFrame(alerts, "alert_id int, scope_id string, asset_id int, last_triggered long"), spark.createDataFrame(named, "narrative_id int, scope_id string, asset_id int"), spark.createDataFrame(claims, "claim_id int, narrative_id int, extracted long")]
    want = lifecycle.alert_claims(*frames).groupBy("alert_id").agg(F.count(F.lit(1)).alias("claims"), F.max("extracted").alias("newest")).collect()
    assert len(want) > 20 and set(lifecycle.alert_claim_counts(*frames).collect()) == set(want)
    n = 100_000
    a = spark.range(n).select(F.col("id").alias("alert_id"), F.lit("LIVE").alias("scope_id"), F.lit(1).alias("asset_id"), F.col("id").alias("last_triggered"))
    c = spark.range(n).select(F.col("id").alias("claim_id"), F.lit(7).alias("narrative_id"), F.col("id").alias("extracted"))
    many = lifecycle.alert_claim_counts(a, spark.createDataFrame([(7, "LIVE", 1)], frames[1].schema), c)
    assert many.where("claims = alert_id + 1 and newest = alert_id").count() == n
