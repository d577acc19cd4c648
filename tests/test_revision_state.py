import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_rescoring import rocks  # noqa: F401
from tests.test_windows import NAMES, SCHEMA, signal, trade
from tidewatch.operators import windows
from tidewatch.streaming import jobs, revision_state


def history(seed, n=160):
    """Signals of all kinds in half an hour; numbers that sums keep exact."""
    r, rows = random.Random(seed), []
    for _ in range(n):
        t, asset = r.randrange(0, 1800), r.choice("AAB")
        kind = r.choice(["trade", "trade", "book", "post", "post", "mention", "quality", "candle"])
        if kind == "trade":
            rows.append(trade(t, r.choice([1, 2, 4, 0.5]), r.randrange(1, 9), r.choice(["BUY", "SELL", None]), asset=asset))
        elif kind == "candle":
            rows.append(signal("MARKET_CANDLE", t, asset, close=float(r.randrange(1, 5)), volume=float(r.randrange(9))))
        elif kind == "book":
            rows.append(signal("ORDERBOOK", t, asset, spread=0.25 * r.randrange(4), top_n_depth=2.0, imbalance=r.choice([None, 0.5]), book_valid=r.choice([None, True, False])))
        elif kind == "post":
            rows.append(signal("SOCIAL_POST", t, asset, author_id=r.choice(["p", "q", "s", None]), hashtags=["x"] * r.randrange(3), urls=r.choice([None, ["u"], ["u", "v"]]), repost_of=r.choice([None, "z"])))
        elif kind == "mention":
            rows.append(signal("ASSET_MENTION", t, asset))
        else:
            row = dict(zip(NAMES, signal("DATA_QUALITY", t, asset, source_active=r.choice([True, False]), source_idle=r.choice([True, False]), source_degraded=r.random() < 0.2, source_gap_count=r.randrange(3)), strict=True))
            rows.append(tuple((row | {"source_domain": r.choice(["market", "social"])})[n] for n in NAMES))
    return rows


def key(r):
    return r["asset_id"], r["interval_seconds"], r["window_start"], r["revision"]


def test_equals_the_log_that_reads_all_history_again(rocks, tmp_path):  # noqa: F811
    """Random late rows in seven batches, with repeated deliveries and a restart: the same revisions, states and features."""
    spark = rocks
    rows = history(4)
    r = random.Random(9)
    rows.sort(key=lambda x: x[3] + timedelta(seconds=r.choice([0, 0, 60, 900])))  # a third comes late
    batches = [rows[i : i + 25] for i in range(0, len(rows), 25)]
    batches[3] = batches[3] + batches[0][:5]
    path, out, checkpoint, store = (str(tmp_path / x) for x in ("in", "out", "cp", "store"))
    read = lambda: jobs.read_signals(spark, path, spark.createDataFrame([], SCHEMA).schema)
    for part in (batches[:4], batches[4:]):
        for b in part:
            spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        jobs.run_once(revision_state.feature_revisions(read(), [60, 300]), out, checkpoint)
    jobs.log_features(read(), store, str(tmp_path / "cp2"), [60, 300])
    got, want = ({key(x): x for x in spark.read.parquet(p).collect()} for p in (out, f"{store}/revisions"))
    assert got.keys() == want.keys() and {x["state"] for x in got.values()} == {"PROVISIONAL", "FINAL", "CORRECTED"}
    for k, x in got.items():
        assert (x["state"], x["supersedes"]) == (want[k]["state"], want[k]["supersedes"]), k
        for name in (*windows.FEATURES, "source_event_count", "min_event_time", "max_event_time", "window_end"):
            assert x[name] == pytest.approx(want[k][name], abs=1e-12), (k, name)
    # The last revisions are the batch's features.
    log = spark.read.parquet(out)
    last = {key(x)[:3]: x for x in log.groupBy(*windows.KEY).agg(F.max_by(F.struct(*log.columns), "revision").alias("r")).select("r.*").collect()}
    batch = {(x["asset_id"], x["interval_seconds"], x["window_start"]): x for x in windows.features(windows.first_per_key(spark.createDataFrame(rows, SCHEMA), ["scope_id", "event_id"], "ingested_at"), [60, 300]).collect()}
    assert last.keys() == batch.keys()
    for k, x in batch.items():
        assert [last[k][n] for n in windows.FEATURES] == pytest.approx([x[n] for n in windows.FEATURES], abs=1e-12), k
