import json
from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.sources import landing


def test_log_validation_and_replay(spark, tmp_path):
    good = {"event_id": "e1", "delivery_event_id": "e1", "schema_version": 1, "source": "s", "source_event_id": "7", "partition_key": "A", "event_time": "2024-01-01T00:00:00Z", "replay": {"is_replay": False}}
    bad = good | {"event_id": "e2", "source": " ", "schema_version": 0, "replay": {"is_replay": True}}
    (tmp_path / "log.json").write_text("\n".join([json.dumps(good), json.dumps(bad), "{broken"]))
    got = {r["event_id"]: r for r in landing.validated(landing.read_log(spark, str(tmp_path / "log.json"))).collect()}
    assert got["e1"]["errors"] == [] and got["e1"]["origin_event_id"] == "s:7"
    assert set(got["e2"]["errors"]) == {"BLANK_SOURCE", "SCHEMA_VERSION", "REPLAY_WITHOUT_SESSION", "DELIVERY_ID"}
    h = spark.createDataFrame([("s", datetime(2024, 1, 2), None), ("s", datetime(2024, 1, 1), None)], "source string, event_time timestamp, source_sequence long")
    r = landing.replayed(h, "session", ["event_time"]).orderBy("event_time").collect()
    assert [x["source_sequence"] for x in r] == [1, 2] and r[0]["ingested_at"] == r[0]["event_time"]


def test_exchange_book_feed_filings_pulses(spark):
    raw = spark.createDataFrame([("A", '[{"id":1,"price":"2.5","qty":"3","time":1704067200123,"isBuyerMaker":true}]')], "asset_id string, body string")
    t = landing.exchange_trades(raw).first()
    assert (t["price"], t["quantity"], t["side"]) == (2.5, 3.0, "SELL")
    b = spark.createDataFrame([([(1.0, 1.0)] * 7, [], 9.0, 4.0, 2.0, 2.5)], "bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>, top_bid_depth double, top_ask_depth double, best_bid double, best_ask double")
    r = landing.book(b).first()
    assert (r["bid_depth"], r["ask_depth"], r["spread"]) == (5.0, 4.0, 0.5)
    xml = "<rss><channel><item><title>T &amp; U</title><description>&lt;p&gt;Body&lt;/p&gt;</description><link>l</link><guid>g</guid><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item></channel></rss>"
    f = landing.feed_items(spark.createDataFrame([("u", xml)], "url string, body string")).first()
    assert f["title"] == "T & U" and f["text"] == "T & U Body l" and f["event_time"] == datetime(2024, 1, 1, 10)
    index = spark.createDataFrame([("c", ["a1", "a2", "a3"], ["8-K"] * 3, ["d"] * 3)], "company string, accession array<string>, form array<string>, filed array<string>")
    got = landing.filings(index, spark.createDataFrame([("c", "a1")], "company string, accession string"), 1).collect()
    assert [x["accession"] for x in got] == ["a2"]
    p = landing.pulses(spark.createDataFrame([('{"id":"1","modified":"2024-01-01T00:00:00","indicators":[{"type":"domain","indicator":"x.y"}]}',), ("nope",)], "body string")).collect()
    assert sorted((x["broken"], x["indicator"]) for x in p) == [(False, "x.y"), (True, None)]


def test_archive_and_upsert(spark, tmp_path):
    rows = spark.createDataFrame([("e1", "market", "s", datetime(2024, 1, 1)), ("e1", "market", "s", datetime(2024, 1, 1)), ("e2", "market", "s", datetime(2024, 1, 2))], "event_id string, stream string, source string, event_time timestamp")
    path = str(tmp_path / "archive")
    landing.archive(rows, path)
    landing.archive(rows, path)
    assert spark.read.parquet(path).count() == 2 and (tmp_path / "archive" / "stream=market" / "date=2024-01-01" / "source=s").is_dir()
    table = str(tmp_path / "t")
    spark.createDataFrame([("k", 2, "old"), ("j", 1, "old")], "k string, revision int, v string").write.parquet(table)
    batch = spark.createDataFrame([("k", 1, "late"), ("j", 2, "new"), ("i", 1, "new")], "k string, revision int, v string")
    assert sorted(map(tuple, landing.keep_latest(batch, table, ["k"], "revision").collect())) == [("i", 1, "new"), ("j", 2, "new"), ("k", 2, "old")]


def test_references_of_all_kinds_are_decoded(spark):
    cases = {"a &amp;amp; b": "a &amp; b", "&#65;&#x42;&#128512;&#0;&#55555;": "AB\U0001f600\ufffd\ufffd", "&copy;&eacute;&nope;&": "©é&nope;&", "<b>x</b>&nbsp;&lt;p&gt;": "x <p>", "&#9999999999;": "&#9999999999;", "no": "no", "": ""}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", landing.plain_text(F.col("t")).alias("out")).collect()
    assert {r["t"]: r["out"] for r in got} == cases


def test_a_broken_indicator_is_isolated(spark):
    bodies = ['{"id": "p1", "modified": "2024-01-01T00:00:00Z", "indicators": [{"type": "domain", "indicator": "a.b"}, {"type": 5}, "what", {"indicator": "no type"}]}', "broken", '{"id": "p2", "indicators": []}']
    got = landing.pulses(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert sorted((str(r["pulse_id"]), r["broken"], str(r["indicator"])) for r in got) == sorted([("p1", False, "a.b"), ("p1", True, "None"), ("p1", True, "None"), ("p1", True, "no type"), ("None", True, "None"), ("p2", False, "None")])


def test_candles_and_what_was_not_seen(spark):
    raw = spark.createDataFrame([("A", '[[1704067200000,"1.5","2","1","1.75","10",0],[1704067260000,"1","1","1","1","0",0]]')], "asset_id string, body string")
    got = landing.candles(raw, closed=False).orderBy("event_time").collect()
    assert [(r["open"], r["close"], r["volume"], r["interval_seconds"]) for r in got] == [(1.5, 1.75, 10.0, 60), (1.0, 1.0, 0.0, 60)]
    bodies = spark.createDataFrame([("A", "[]"), ("B", None), ("C", "broken"), ("D", '[["1","2","3","4","5","6"]]')], "asset_id string, body string")
    assert [r["open"] for r in landing.candles(raw).collect()] == [1.5] and landing.candles(bodies).count() == 0
    rows = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1)], "k string, n long")
    assert sorted(tuple(r) for r in landing.unseen(rows, "k", "n", spark.createDataFrame([("A", 1)], "k string, last long")).collect()) == [("A", 2), ("B", 1)]


def test_feeds_fall_back_entry_by_entry(spark):
    rss = "<rss><channel><item><title>T &amp; U</title><description>&lt;p&gt;D &amp;amp; E&lt;/p&gt;</description><link>http://l</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0200</pubDate></item><item><guid>g</guid><summary>S</summary><pubDate>never</pubDate></item></channel></rss>"
    atom = '<feed><entry><id>i</id><title>A</title><content>C</content><link href="http://h"/><published>2024-02-03T04:05:06Z</published></entry><entry><link href="http://only"/></entry></feed>'
    raw = spark.createDataFrame([(rss,), (atom,)], "body string").withColumn("retrieved_at", F.timestamp_seconds(F.lit(0)))
    got = {r["source_key"]: r for r in landing.feed_documents(raw).withColumn("p", F.unix_timestamp("published_at")).collect()}
    assert {k: (r["title"], r["body"], r["url"], r["p"]) for k, r in got.items()} == {
        "http://l": ("T & U", "D & E", "http://l", 1704096000), "g": ("Untitled official disclosure", "S", None, 0), "i": ("A", "C", "http://h", 1706933106), "http://only": ("Untitled official disclosure", "Untitled official disclosure", "http://only", 0),
    }


def test_the_archive_takes_each_event_once(spark, tmp_path):
    events = spark.createDataFrame([(f"e{i}", "s", "x", i) for i in range(6)], "event_id string, stream string, source string, d int").withColumn("event_time", F.timestamp_seconds(F.col("d") * 86_400)).drop("d")
    path = str(tmp_path / "archive")
    landing.archive(events.limit(4), path)
    landing.archive(events, path)
    assert spark.read.parquet(path).count() == 6 and spark.read.parquet(path).select("event_id").distinct().count() == 6
