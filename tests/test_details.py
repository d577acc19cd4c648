from pyspark.sql import functions as F

from tidewatch.operators import evaluation, records, serving, threat
from tidewatch.sources import landing

FEED = "provider_id string, type string, indicator string, created long, modified long, pulse_modified long"
KEPT = "indicator_id string, indicator_type string, indicator_value string, first_seen long, last_seen long, fetched_at long, active boolean"
LOG = "provider_id string, indicator_id string, observed_at long, fetched_at long"


def test_a_fetch_taken_in_twice(spark):
    none, log = spark.createDataFrame([], KEPT), spark.createDataFrame([], LOG)
    rows = [("p1", "domain", "A.example.", 10, None, 100), ("p2", "hostname", "a.example", 8, 20, 90), ("p1", "domain", "a.example", 10, 30, 95), ("p3", "domain", "-bad-", 1, 1, 300), ("p4", "other", "x", 1, 1, 1)]
    batch = spark.createDataFrame(rows, FEED)
    kept, seen, mark = threat.ingest(none, log, batch, 1000)
    # Both names are one indicator: last seen by the newest pulse (p1 at 100: created 10), first seen the least.
    assert [(r["indicator_value"], r["first_seen"], r["last_seen"], r["fetched_at"], r["active"]) for r in kept.collect()] == [("a.example", 8, 10, 1000, True)]
    assert sorted((r["provider_id"], r["observed_at"]) for r in seen.collect()) == [("p1", 30), ("p2", 20)] and mark.first()["watermark"] == 300
    again, same, _ = threat.ingest(kept, seen, batch.withColumn("created", F.col("created") - 5), 2000)
    assert [(r["first_seen"], r["last_seen"], r["fetched_at"]) for r in again.collect()] == [(8, 5, 2000)]
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, seen.collect()))
    kept, seen, mark = threat.ingest(again, same, batch.limit(0), 3000)
    assert [r["fetched_at"] for r in kept.collect()] == [2000] and seen.count() == 2 and mark.first()["watermark"] is None


def test_matches_of_assets(spark):
    found = spark.createDataFrame([(1, "DOMAIN", "a.b"), (1, "DOMAIN", "a.b"), (2, "DOMAIN", "a.b"), (3, "DOMAIN", "c.d"), (4, "DOMAIN", "a.b")], "post long, indicator_type string, indicator_value string")
    known = spark.createDataFrame([("DOMAIN", "a.b", "i", 50, None), ("DOMAIN", "c.d", "j", 50, False)], "indicator_type string, indicator_value string, indicator_id string, fetched_at long, active boolean")
    said = spark.createDataFrame([(1, "S", "X", 40), (1, "S", "X", 40), (1, "S", "Y", 40), (2, "S", "X", 60), (3, "S", "X", 60), (4, "S", None, 60)], "post long, scope_id string, asset_id string, event_time long")
    got = threat.asset_matches(found, known, said, "post").collect()
    assert sorted((r["post"], r["asset_id"], r["evidence_cutoff"], r["confidence"]) for r in got) == [(1, "X", 50, 0.7), (1, "Y", 50, 0.7), (2, "X", 60, 0.7)] and len({r["match_id"] for r in got}) == 3


def test_what_a_promotion_is_judged_by(spark):
    c = spark.createDataFrame([("new", "f", 2), ("champ", "f", 1), ("bare", "f", 3), ("solo", "g", 1), ("late", "f", 4)], "artifact_id string, family string, version int")
    k = spark.createDataFrame([("new", "ACTIVE", 1, 9, 0.1, 0.9, 0.3), ("new", "ACTIVE", 2, 50, 0.1, 0.9, 0.2), ("new", "RETIRED", 3, 1, 1.0, 0.0, 1.0), ("champ", "ACTIVE", 1, 50, 0.1, 0.9, 0.19), ("solo", "ACTIVE", 1, 50, 0.1, 0.9, 0.9), ("late", "ACTIVE", 1, 50, 0.1, 0.9, 0.3)], "artifact_id string, status string, created long, samples int, ece double, auc double, brier double")
    a = spark.createDataFrame([("f", "CHAMPION", "champ"), ("g", "CHALLENGER", "solo")], "family string, alias string, artifact_id string")
    d = spark.createDataFrame([("f", 2, 1, "DRIFTED"), ("f", 2, 2, "STABLE"), ("g", 1, 1, "DRIFTED")], "family string, version int, observed long, drift_status string")
    day = 86_400
    r = spark.createDataFrame([("f", 2, 100 * day), ("f", 2, 69 * day)], "family string, version int, created long")
    rows = evaluation.promotion_inputs(c, k, a, d, r, 100 * day)
    own = {x["artifact_id"]: x for x in evaluation.promotion(rows, 20, 0.2, 0.6, 1, 0.02, F.col("champion_required"), F.col("artifact_id") != "new").collect()}
    assert (own["new"]["samples"], own["new"]["champion_brier"], own["new"]["drift_status"], own["new"]["false_positives"]) == (50, 0.19, "STABLE", 1)
    assert {n: x["status"] for n, x in own.items()} == {"new": "APPROVED", "champ": "PROMOTED", "solo": "REJECTED", "late": "REJECTED"} and own["champ"]["champion_brier"] is None


def test_explanations_and_details(spark):
    rows = [("H", "T", "A", 0.9, 0.3, -0.5, ["B", "A", "B"]), ("L", "T", "B", None, None, None, [])]
    df = spark.createDataFrame(rows, "severity string, kind string, asset string, fusion_score double, market_score double, x double, results array<string>")
    got = {r["asset"]: r for r in records.explained(df, ["market_score", "x"], "severity", "results", ["kind", "asset"]).collect()}
    assert [(c["feature"], c["value"]) for c in got["A"]["contributors"]] == [("x", -0.5), ("market_score", 0.3)] and got["B"]["contributors"] == []
    assert [(r["rule"], r["outcome"], r["fusion_score"]) for r in got["A"]["rules"]] == [("ALERT_THRESHOLD", "H", 0.9), ("MARKET_CORROBORATION", "false", None), ("CLAIM_VERIFICATION", "A,B", None)] and len(got["B"]["rules"]) == 2
    assert got["A"]["summary"] == "H T for A; the strongest recorded contributor was x." and got["B"]["summary"].endswith("was available evidence.")
    alerts, actions = spark.createDataFrame([(1,), (2,)], "alert long"), spark.createDataFrame([(1, 5, "b"), (1, 3, "a")], "alert long, at long, action string")
    assert sorted(((r["alert"], r["place"], r["action"], r["actions"]) for r in serving.alert_detail(alerts, actions, "alert", ["at"]).collect()), key=str) == [(1, 1, "a", 2), (1, 2, "b", 2), (2, None, None, 0)]


def test_seen_keys_in_order(spark):
    new = spark.createDataFrame([("c", "n2", 2), ("c", "n1", 1), ("c", "o1", 3)], "company string, accession string, n int")
    old = spark.createDataFrame([("c", "o1", 1), ("c", "o2", 2), ("c", "o3", 3), ("d", "x", 1)], "company string, accession string, place int")
    got = landing.seen_filings(new, old, 4).orderBy("company", "place").collect()
    assert [(r["company"], r["accession"], r["place"]) for r in got] == [("c", "n1", 1), ("c", "n2", 2), ("c", "o1", 3), ("c", "o2", 4), ("d", "x", 1)]
