import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import windows
from tidewatch.streaming import jobs, rescoring

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SCHEMA = "scope_id string, asset_id string, interval_seconds int, window_start long, part string, revision int, snapshot_id string, body string, event_time timestamp"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(PROVIDER, old) if old else spark.conf.unset(PROVIDER)


def parts(spark):
    """Eight windows: two revisions of features, a graph and a verification for some, threats for others; one has no features."""
    key = [("S", f"A{i}", 60, 1704067200 + 60 * i) for i in range(8)]
    features = [(*k, r, r * (5 + i) / 3, 4.0 + i, 12.0 * r) for i, k in enumerate(key) if i != 7 for r in (1, 2)]
    f = spark.createDataFrame(features, "scope_id string, asset_id string, interval_seconds int, window_start long, r int, relative_volume double, trade_count double, mention_count double")
    for n in windows.FEATURES:
        if n not in f.columns:
            f = f.withColumn(n, F.lit(0.3))
    graph = spark.createDataFrame([(*k, r, 0.2 * r + i / 10) for i, k in enumerate(key) if i % 2 for r in (1, 2, 3)], "scope_id string, asset_id string, interval_seconds int, window_start long, r int, graph_score double")
    claims = spark.createDataFrame([(*k, 1.0, 0.0) for i, k in enumerate(key) if i % 3 == 0], "scope_id string, asset_id string, interval_seconds int, window_start long, claim_risk double, legitimate_event_score double")
    threats = spark.createDataFrame([(*k, "STALE" if i == 2 else "MATCHED", None if i == 2 else 0.9, 0.7) for i, k in enumerate(key) if i % 2 == 0], "scope_id string, asset_id string, interval_seconds int, window_start long, threat_status string, threat_score double, threat_confidence double")
    out = rescoring.part(f, "FEATURES", F.col("r"))
    return out.unionAll(rescoring.part(graph, "GRAPH", F.col("r"))).unionAll(rescoring.part(claims, "VERIFICATION")).unionAll(rescoring.part(threats, "THREAT"))


def result(df, version=False):
    cols = ["asset_id", "fusion_score", "confidence", "severity", "enrichment_profile", "fusion_revision", "idempotency_key", "model_score_id"]
    return {r["asset_id"]: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_ends_in_the_batch_scores(rocks, tmp_path, seed):
    spark = rocks
    rows = parts(spark).collect()
    want = result(rescoring.scores(rescoring.latest_inputs(spark.createDataFrame(rows, SCHEMA))))
    assert len(want) == 7 and len({w[4] for w in want.values()}) == 4
    random.Random(seed).shuffle(rows)
    path, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))

    def feed(some):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(path)

    def run():
        stream = jobs.read_signals(spark, path, spark.createDataFrame([], SCHEMA).schema)
        jobs.run_once(rescoring.rescored(stream), out, checkpoint)

    feed(rows[:13])
    run()
    feed(rows[13:25] + rows[:6])  # some come twice
    feed(rows[25:])
    run()  # a restart goes on from the checkpoint
    got = spark.read.parquet(out)
    assert got.count() == got.select("idempotency_key").distinct().count() > 7
    last = got.groupBy("asset_id").agg(F.max_by(F.struct(*got.columns), "version").alias("r")).select("r.*")
    assert result(last) == want


class Held(dict):
    getValue, updateValue, containsKey = dict.__getitem__, dict.__setitem__, dict.__contains__


class Value:
    now = None

    def exists(self):
        return self.now is not None

    def get(self):
        return self.now

    def update(self, x):
        self.now = x

    def clear(self):
        self.now = None


class Handle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, *a):
        return Held()

    def getValueState(self, *a):
        return Value()

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.remove(t)


def test_state_is_given_up_by_its_timer():
    import pandas as pd

    def feed(job, *rows):
        pdf = pd.DataFrame(rows, columns=["part", "revision", "snapshot_id", "body", "event_time"])
        pdf["event_time"] = pd.to_datetime(pdf["event_time"], unit="s", utc=True)
        return [r for out in job.handleInputRows(("S", "A", 60, 0), iter([pdf]), None) for r in out.to_dict("records")]

    job, handle = rescoring.Rescoring(100), Handle()
    job.init(handle)
    assert feed(job, ("GRAPH", 1, "g", "{}", 10)) == [] and handle.timers == {110_000}
    assert feed(job, ("GRAPH", 0, "z", "{}", 20)) == [] and handle.timers == {120_000}
    given_up = [r for out in job.handleExpiredTimer(("S", "A", 60, 0), None, None) for r in out.to_dict("records")]
    assert [(r["outcome"], r["graph_id"]) for r in given_up] == [("GIVEN_UP", "g")] and not job.parts and not job.last.exists()
    first = feed(job, ("FEATURES", 1, "f", "{}", 30), ("THREAT", 1, "t", "{}", 30))
    assert [(r["version"], r["outcome"], r["threat_id"]) for r in first] == [(1, "SCORED", "t")]
    assert feed(job, ("FEATURES", 1, "f", "{}", 30)) == [] and feed(job, ("FEATURES", 2, "a", "{}", 30))[0]["version"] == 2
    assert list(job.handleExpiredTimer(("S", "A", 60, 0), None, None)) == []
