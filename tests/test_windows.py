from datetime import datetime, timedelta

import pytest

from tidewatch.operators import scoring, windows

SCHEMA = (
    "event_id string, scope_id string, asset_id string, event_time timestamp, ingested_at timestamp, kind string, source_domain string, price double, quantity double, side string, close double, volume double, "
    "baseline_volume double, spread double, top_n_depth double, imbalance double, book_valid boolean, author_id string, hashtags array<string>, urls array<string>, reply_to string, repost_of string, "
    "source_gap_count int, source_active boolean, source_idle boolean, source_degraded boolean"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
NOON = datetime(2024, 1, 1, 12)
_n = iter(range(10**6))


def signal(kind, seconds, asset="A", **values):
    domain = "social" if kind in ("SOCIAL_POST", "ASSET_MENTION") else values.pop("domain", "market")
    t = NOON + timedelta(seconds=seconds)
    row = {"event_id": f"e{next(_n):06d}", "scope_id": "S", "asset_id": asset, "event_time": t, "ingested_at": t, "kind": kind, "source_domain": domain} | values
    return tuple(row.get(n) for n in NAMES)


def trade(seconds, price, quantity, side="BUY", **k):
    return signal("MARKET_TRADE", seconds, price=float(price), quantity=float(quantity), side=side, **k)


def compute(spark, rows, interval=60):
    return {(r["asset_id"], r["window_start"]): r for r in windows.features(spark.createDataFrame(rows, SCHEMA), [interval]).collect()}


def at(seconds):
    return int((NOON - datetime(1970, 1, 1)).total_seconds()) + seconds


def test_relative_volume_and_a_late_row(spark):
    rows = [trade(0, 1, 100), trade(60, 1, 500)]
    assert compute(spark, rows)[("A", at(60))]["relative_volume"] == 5.0
    assert compute(spark, [*rows, trade(30, 1, 100)])[("A", at(60))]["relative_volume"] == 2.5


def test_prices_order_volatility_and_pressure(spark):
    rows = [trade(10, 12, 1, "SELL"), trade(1, 10, 3), trade(5, 11, 1)]
    w = compute(spark, rows)[("A", at(0))]
    assert abs(w["price_return"] - 0.2) < 1e-12 and w["trade_count"] == 3 and w["buy_sell_pressure"] == 0.6
    assert abs(w["volatility"] - abs(0.1 - 1 / 11) / 2) < 1e-12
    assert compute(spark, list(reversed(rows)))[("A", at(0))]["price_return"] == w["price_return"]


def test_candles_stand_in_for_trades(spark):
    w = compute(spark, [signal("MARKET_CANDLE", 1, close=10.0, volume=7.0), signal("MARKET_CANDLE", 2, close=15.0, volume=8.0)])[("A", at(0))]
    assert w["price_return"] == 0.5 and w["volume"] == 15.0


def test_social_features_need_an_available_source(spark):
    posts = [signal("SOCIAL_POST", s, author_id=a, hashtags=["x"], urls=["u1"] if s < 3 else ["u2"]) for s, a in ((1, "p"), (2, "p"), (3, "q"))]
    w = compute(spark, [*posts, signal("ASSET_MENTION", 4), trade(40, 1, 1)])[("A", at(0))]
    assert (w["mention_count"], w["unique_author_count"], w["social_lead_seconds"]) == (1, 2, 39.0)
    assert abs(w["author_concentration"] - 2 / 3) < 1e-12 and abs(w["url_concentration"] - 2 / 3) < 1e-12 and w["new_author_ratio"] == 1.0
    bad = compute(spark, [*posts, signal("DATA_QUALITY", 5, domain="social", source_active=True, source_idle=False, source_degraded=True, source_gap_count=2)])[("A", at(0))]
    assert bad["mention_count"] is None and bad["social_source_degraded"] == 1 and bad["source_gap_count"] == 2


def test_scopes_and_assets_do_not_mix(spark):
    got = compute(spark, [trade(0, 1, 100), trade(60, 1, 500, asset="B")])
    assert got[("B", at(60))]["relative_volume"] == 1.0 and got[("B", at(60))]["baseline_confidence"] == 0.0


def test_no_rows(spark):
    assert windows.features(spark.createDataFrame([], SCHEMA), [60, 300]).count() == 0


def test_pump_is_scored_high_only_with_market_evidence(spark):
    quiet = [trade(-600 + 60 * i, 100, 1) for i in range(9)]
    pump = [trade(i, 100 + 3 * i, 60) for i in range(1, 30)]
    # Posts before the pump and in it: an active source without posts in a window counts as zero there.
    social = [signal("SOCIAL_POST", t + i, author_id="p", hashtags=["a", "b", "c", "d"], urls=["u"], repost_of="r") for t in (-50, 5) for i in range(12)]
    mentions = [signal("ASSET_MENTION", t + i) for t in (-40, 6) for i in range(12)]
    books = [signal("ORDERBOOK", 10, spread=0.05, top_n_depth=10.0, imbalance=0.9, book_valid=True)]
    got = {r["window_start"]: r for r in scoring.fuse(scoring.detect(windows.features(spark.createDataFrame(quiet + pump + social + mentions + books, SCHEMA), [60]))).collect()}
    assert got[at(-540)]["severity"] == "NORMAL"
    assert got[at(-60)]["social_coordination_severity"] in ("HIGH", "CRITICAL") and got[at(-60)]["severity"] in ("NORMAL", "WATCH")
    assert got[at(0)]["severity"] in ("HIGH", "CRITICAL")
    parts = scoring.trace(scoring.fuse(scoring.detect(windows.features(spark.createDataFrame(quiet + pump, SCHEMA), [60]))), ["window_start"]).groupBy("window_start").sum("contribution").collect()
    assert all(0 <= r[1] <= 1 for r in parts)


@pytest.mark.parametrize(("market", "coordination", "want"), [(0.7, 0.7, "HIGH"), (None, 0.9, "WATCH"), (0.3, 0.9, "WATCH"), (0.1, 0.1, "NORMAL")])
def test_fusion_policies(spark, market, coordination, want):
    row = [(market, None, None, None, coordination, None, None, None, 1.0, 1.0)]
    df = spark.createDataFrame(row, "market_score double, market_missing string, social_score double, social_missing string, coordination_score double, coordination_missing string, temporal_score double, temporal_missing string, baseline_confidence double, data_quality_score double")
    assert scoring.fuse(df).first()["severity"] == want


def test_threat_context_cannot_raise_to_high_alone(spark):
    df = spark.createDataFrame([(0.59, 0.59, "MATCHED", 1.0, 1.0, 1.0, 1.0)], "market_score double, coordination_score double, threat_status string, threat_score double, threat_confidence double, baseline_confidence double, data_quality_score double")
    df = df.selectExpr("*", "cast(null as string) as market_missing", "cast(null as double) as social_score", "cast(null as string) as social_missing", "cast(null as string) as coordination_missing", "cast(null as double) as temporal_score", "cast(null as string) as temporal_missing")
    r = scoring.fuse(df).first()
    assert r["fusion_score"] == 0.59 and abs(r["threat_contribution"] - 0.1) < 1e-12
