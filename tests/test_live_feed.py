import pytest
from pyspark.sql import functions as F

from tests.test_rescoring import rocks  # noqa: F401
from tidewatch.streaming import jobs, live_feed


def sent(rows):
    return sorted(((r["feed"], r["subscriber"], r["kind"], r["event_id"], r["body"]) for r in rows), key=lambda r: r[:4])


def test_resume_reset_and_restart(rocks, tmp_path):  # noqa: F811
    spark = rocks
    path, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))

    def step(events=(), subscribers=()):
        rows = [(f, i, b, None, None) for f, i, b in events] + [(f, None, None, s, c) for f, s, c in subscribers]
        spark.createDataFrame(rows, live_feed.ROWS).coalesce(1).write.mode("append").parquet(path)
        before = sent(spark.read.parquet(out).collect()) if (tmp_path / "out").exists() else []
        jobs.run_once(live_feed.live_feed(spark.readStream.schema(live_feed.ROWS).parquet(path), length=3), out, checkpoint)  # each a restart
        after = sent(spark.read.parquet(out).collect())
        for r in before:
            after.remove(r)
        return after

    assert step([("f", i, f"b{i}") for i in (3, 1, 2, 4)], [("f", "from-0", 0), ("f", "now", None), ("g", "early", None)]) == [("f", "from-0", "event", i, f"b{i}") for i in (2, 3, 4)]
    # 5 comes twice and 4 again; the ring is 3, 4, 5 and a cursor of 1 has fallen out of it.
    got = step([("f", 5, "b5"), ("f", 5, "b5"), ("f", 4, "other")], [("f", "old", 1), ("f", "held", 3)])
    assert set(got) == {("f", "from-0", "event", 5, "b5"), ("f", "now", "event", 5, "b5"), ("f", "old", live_feed.RESET, 3, None), ("f", "held", "event", 4, "b4"), ("f", "held", "event", 5, "b5")}
    assert len(got) == 5
    got = step([("f", 6, None), ("g", 9, "x")])
    assert got == sorted([("f", s, "event", 6, None) for s in ("from-0", "now", "old", "held")] + [("g", "early", "event", 9, "x")])


@pytest.mark.parametrize("parts", [1, 5])
def test_a_table_is_one_batch_in_any_order(rocks, parts):  # noqa: F811
    spark = rocks
    e = live_feed.published(spark.range(1, 101), F.concat(F.lit("f"), F.col("id") % 2), F.col("id"), F.col("id"))
    s = live_feed.subscribed(spark.createDataFrame([("a", 95), ("b", 10), ("c", 0), ("d", None)], "s string, c long"), F.lit("f0"), F.col("s"), F.col("c"))
    got = sent(live_feed.live_feed(e.unionByName(s).repartition(parts), length=10).collect())
    want = [("f0", "a", "event", i, str(i)) for i in (96, 98, 100)] + [("f0", "b", live_feed.RESET, 82, None)] + [("f0", "c", "event", i, str(i)) for i in range(82, 101, 2)]
    assert [g for g in got if g[4]] == [w for w in want if w[4]] and len(got) == len(want) and want[3] in got


def test_of_a_table_only_what_rings_keep_comes_together(rocks, monkeypatch):  # noqa: F811
    """Also with repeats of ids, ids that are not above 0, and feeds without events; and what is sent is as of all rows."""
    spark = rocks
    e = spark.range(-50, 3000).select(F.concat(F.lit("f"), F.col("id") % 2).alias("feed"), F.col("id").alias("event_id"), F.col("id").cast("string").alias("body"))
    again = e.where("event_id % 7 = 0").select("feed", "event_id", F.when(F.col("event_id") % 3 == 0, "A").alias("body"))
    few = spark.createDataFrame([("g", 0, "zero"), ("g", -1, "below"), ("g", 2, None), ("g", None, "none")], "feed string, event_id long, body string")
    events = e.unionByName(again).unionByName(again).unionByName(few)
    events = live_feed.published(events, F.col("feed"), F.col("event_id"), F.col("body"))
    asked = spark.createDataFrame([(f, s, c) for f in ("f0", "f1", "g", "h") for s, c in (("a", 0), ("b", 10), ("c", 2985), ("d", None))], "feed string, s string, c long")
    rows = events.unionByName(live_feed.subscribed(asked, F.col("feed"), F.col("s"), F.col("c")))
    kept = live_feed.newest(rows, 20)
    n = {r["feed"]: r["count"] for r in kept.where("subscriber is null").groupBy("feed").count().collect()}
    assert n == {"f0": 20, "f1": 20, "f-1": 20, "g": 3} and kept.where("subscriber is not null").count() == 16
    got = sent(live_feed.live_feed(rows, length=20).collect())
    monkeypatch.setattr(live_feed, "newest", lambda r, n: r)
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(sent(live_feed.live_feed(rows, length=20).collect()), key=key) and len(got) > 40
