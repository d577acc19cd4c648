import pandas as pd
from pyspark.sql import functions as F

from tests.test_windows import SCHEMA, signal, trade
from tidewatch.streaming import jobs


def written(spark, tmp_path, batches):
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def test_dedupe_and_window_counts_equal_batch(spark, tmp_path):
    a = [trade(i, 10 + i, 2) for i in range(0, 300, 20)]
    path = written(spark, tmp_path, [a, a[:3] + [trade(900, 1, 1)], [trade(5000, 1, 1)]])
    stream = jobs.read_signals(spark, path, spark.createDataFrame([], SCHEMA).schema)
    out = jobs.window_counts(jobs.deduplicated(stream, ["scope_id", "event_id"], keep="20 minutes"), "60 seconds", None)
    jobs.run_once(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["window_start"].minute: (r["trade_count"], r["volume"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[0] == (3, 180.0) and got[4] == (3, 1620.0)


def test_revision_log_of_late_rows(spark, tmp_path):
    first = [trade(0, 1, 100), signal("SOCIAL_POST", 1, author_id="p")]
    later = [trade(400, 1, 5), signal("SOCIAL_POST", 401, author_id="p")]
    path = written(spark, tmp_path, [first, later, [trade(30, 1, 50)]])
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = jobs.revisions(jobs.read_signals(spark, path, spark.createDataFrame([], SCHEMA).schema), 60, 120)
        jobs.run_once(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old) if old else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = spark.read.parquet(str(tmp_path / "out"))
    least = rows.agg(F.min("window_start")).first()[0]
    got = [(r["revision"], r["state"], r["supersedes"], r["volume"]) for r in rows.where(F.col("window_start") == least).orderBy("revision").collect()]
    assert got == [(1, "PROVISIONAL", None, 100.0), (2, "PROVISIONAL", None, 100.0), (3, "FINAL", 2, 100.0), (4, "CORRECTED", 3, 150.0)]


def test_posts_meet_their_mentions(spark, tmp_path):
    p, m = str(tmp_path / "p"), str(tmp_path / "m")
    spark.sql("select 'a' as post_id, timestamp'2024-01-01 12:00:00' as event_time union all select 'b', timestamp'2024-01-01 12:00:10'").write.parquet(p)
    spark.sql("select 'a' as post_id, timestamp'2024-01-01 12:00:03' as event_time, 'X' as asset_id").write.parquet(m)
    read = lambda x: spark.readStream.schema(spark.read.parquet(x).schema).parquet(x)
    jobs.run_once(jobs.paired(read(p), read(m)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [(r["post_id"], r["asset_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", "X")]


class Held(dict):
    """A map state in memory."""

    getValue, updateValue, removeKey, containsKey = dict.__getitem__, dict.__setitem__, dict.__delitem__, dict.__contains__

    def iterator(self):
        return iter(list(self.items()))


def test_every_window_becomes_final_after_a_long_outage():
    job = jobs.Revisions(60, 0)
    job.init(type("Handle", (), {"getMapState": lambda self, *a: Held()})())
    row = lambda t, d: {"event_id": f"{d}{t}", "source_domain": d, "t": float(t), "amount": 1.0}
    feed = lambda rows: next(job.handleInputRows(("s", "a"), iter([pd.DataFrame(rows)]), None)).to_dict("records")
    feed([row(0, "social")] + [row(60 * i, "market") for i in range(100)])
    final = [r["window_start"] for r in feed([row(6000, "social"), row(6060, "market")]) if r["state"] == "FINAL"]
    assert final == [60 * i for i in range(100)]
    late = feed([row(30, "market")])
    assert [(r["window_start"], r["revision"], r["state"], r["supersedes"], r["n"]) for r in late] == [(0, 4, "CORRECTED", 3, 3)]


def log_of(spark, store):
    rows = spark.read.parquet(f"{store}/revisions").orderBy("window_start", "revision").collect()
    start = min(r["window_start"] for r in rows)
    return {(r["window_start"] - start, r["revision"]): r for r in rows}


def test_feature_log_revises_later_windows_and_goes_on_after_a_restart(spark, tmp_path):
    def both(t, price, quantity):
        return [trade(t, price, quantity), signal("SOCIAL_POST", t + 1, author_id="p")]

    path = written(spark, tmp_path, [both(0, 1, 100), both(60, 1, 100) + both(120, 1, 50), both(600, 1, 10)])
    read = lambda: jobs.read_signals(spark, path, spark.createDataFrame([], SCHEMA).schema)
    store, checkpoint = str(tmp_path / "store"), str(tmp_path / "cp")
    jobs.log_features(read(), store, checkpoint, [60])
    got = log_of(spark, store)
    assert {k: got[k]["state"] for k in got} == {(0, 1): "PROVISIONAL", (60, 1): "PROVISIONAL", (120, 1): "PROVISIONAL", (0, 2): "FINAL", (60, 2): "FINAL", (120, 2): "FINAL", (600, 1): "PROVISIONAL"}
    assert got[60, 1]["relative_volume"] == 1.0 and got[120, 1]["relative_volume"] == 0.5
    # A restart goes on from the checkpoint; a late row corrects its window and the baselines of those after it.
    late = spark.createDataFrame([trade(10, 1, 200)], SCHEMA)
    late.coalesce(1).write.mode("append").parquet(path)
    jobs.log_features(read(), store, checkpoint, [60])
    after = log_of(spark, store)
    assert all(after[k]["content_hash"] == got[k]["content_hash"] for k in got)
    new = {k: after[k] for k in after if k not in got}
    assert {k[0] for k in new} == {0, 60, 120, 600}
    assert all(r["state"] == ("CORRECTED" if k[0] < 600 else "PROVISIONAL") and (k[0] == 600 or r["supersedes"] == r["revision"] - 1) for k, r in new.items())
    last = {k[0]: r for k, r in sorted(after.items())}
    assert last[0]["volume"] == 300.0 and abs(last[60]["relative_volume"] - 100 / 300) < 1e-12 and abs(last[120]["relative_volume"] - 50 / 200) < 1e-12
    # It equals the batch computation.
    from tidewatch.operators import windows

    want = {r["window_start"]: r["relative_volume"] for r in windows.features(spark.read.parquet(path), [60]).collect()}
    assert {r["window_start"]: r["relative_volume"] for r in last.values()} == want
    # A batch that is run again writes what it wrote.
    n = spark.read.parquet(f"{store}/revisions").count()
    jobs.feature_log(store, [60])(late, 3)
    assert spark.read.parquet(f"{store}/revisions").count() == n
