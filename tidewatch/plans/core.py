"""Queries from signals to fused scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import scoring, windows
from tidewatch.sources import adapters

INTERVAL = 21_600
PLACES = 9
#: Added before rounding: values of few decimals, which summing may leave on either side of a tie, then round alike.
NUDGE = 1.7e-11


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    return df.select(*((F.round(F.col(n) + NUDGE, places) + F.lit(0.0)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.features(adapters.signals(spark, sf_dir), [INTERVAL])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.fuse(scoring.detect(window_features(spark, sf_dir)))


#: Feature windows in SQL: w has the key (asset_id, ws) and all features.
FEATURES_SQL = f"""{adapters.SIGNALS_SQL},
r AS (SELECT *, epoch_us(event_time) / 1e6 AS t, CAST(floor(epoch_us(event_time) / 1e6 / {INTERVAL}) * {INTERVAL} AS BIGINT) AS ws FROM sig),
steps AS (
  SELECT asset_id, ws, price / nullif(lag(price) OVER (PARTITION BY asset_id, ws ORDER BY t, event_id), 0) - 1 AS step FROM r WHERE kind = 'MARKET_TRADE'),
vol AS (SELECT asset_id, ws, CASE WHEN count(step) > 1 THEN stddev_pop(step) ELSE 0 END AS volatility FROM steps GROUP BY ALL),
base AS (
  SELECT asset_id, ws,
    first(price ORDER BY t, event_id) FILTER (kind = 'MARKET_TRADE') AS p0, last(price ORDER BY t, event_id) FILTER (kind = 'MARKET_TRADE') AS p1,
    count(*) FILTER (kind = 'MARKET_TRADE') AS trade_count, coalesce(sum(quantity * price), 0) AS volume,
    avg(spread) FILTER (book_valid) AS spread, avg(top_n_depth) FILTER (book_valid) AS top_n_depth, avg(imbalance) FILTER (book_valid) AS orderbook_imbalance,
    max(CAST(book_valid AS INTEGER)) AS orderbook_valid,
    coalesce(sum(quantity) FILTER (side = 'BUY'), 0) AS buys, coalesce(sum(quantity) FILTER (side = 'SELL'), 0) AS sells,
    max(t) FILTER (kind IN ('MARKET_TRADE', 'ORDERBOOK')) AS ml, min(t) FILTER (kind IN ('MARKET_TRADE', 'ORDERBOOK')) AS mf,
    max(t) FILTER (kind IN ('SOCIAL_POST', 'ASSET_MENTION')) AS sl, min(t) FILTER (kind IN ('SOCIAL_POST', 'ASSET_MENTION')) AS sf,
    count(*) FILTER (kind = 'ASSET_MENTION') AS mentions, count(*) FILTER (kind = 'SOCIAL_POST') AS posts, count(repost_of) AS reposts,
    coalesce(max(source_gap_count), 0) AS gaps
  FROM r GROUP BY ALL),
seen AS (SELECT *, min(t) OVER (PARTITION BY asset_id, author_id) AS first_seen FROM r WHERE kind = 'SOCIAL_POST'),
a1 AS (SELECT asset_id, ws, author_id, count(*) AS n, min(first_seen) AS fs FROM seen GROUP BY ALL),
a2 AS (SELECT asset_id, ws, count(*) AS authors, max(n) / sum(n) AS author_share, count(*) FILTER (fs >= ws) AS new_authors FROM a1 GROUP BY ALL),
u1 AS (SELECT asset_id, ws, url, count(*) AS n FROM r WHERE url IS NOT NULL GROUP BY ALL),
u2 AS (SELECT asset_id, ws, max(n) / sum(n) AS url_share FROM u1 GROUP BY ALL),
dom AS (SELECT asset_id, ws, d FROM base, (VALUES ('market'), ('social')) AS x(d)),
qa AS (
  SELECT dom.asset_id, dom.ws, d, max((t, event_id)) FILTER (kind = 'DATA_QUALITY') AS q_at, max((t, event_id)) FILTER (kind <> 'DATA_QUALITY') AS o_at,
    arg_max(source_degraded, (t, event_id)) FILTER (kind = 'DATA_QUALITY') AS q_bad
  FROM dom LEFT JOIN r ON r.asset_id = dom.asset_id AND r.source_domain = d AND r.ws <= dom.ws GROUP BY ALL),
qs AS (
  SELECT asset_id, ws, d, CAST(coalesce(q_at IS NOT NULL OR o_at IS NOT NULL, false) AS INTEGER) AS active,
    CASE WHEN q_at IS NULL THEN CAST(o_at IS NULL AS INTEGER) ELSE CAST(q_bad AS INTEGER) END AS degraded FROM qa),
st AS (
  SELECT asset_id, ws, max(active) FILTER (d = 'market') AS ma, max(degraded) FILTER (d = 'market') AS md, max(active) FILTER (d = 'social') AS sa, max(degraded) FILTER (d = 'social') AS sd
  FROM qs GROUP BY ALL),
j AS (
  SELECT base.*, volatility, authors, author_share, new_authors, url_share, ma, md, sa, sd, sa = 1 AND sd = 0 AS ok,
    coalesce(avg(CASE WHEN volume > 0 THEN volume END) OVER (PARTITION BY base.asset_id ORDER BY base.ws ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), volume) AS baseline,
    row_number() OVER (PARTITION BY base.asset_id ORDER BY base.ws) - 1 AS earlier,
    greatest(0, coalesce(base.ws + {INTERVAL} - ml, {INTERVAL})) AS fresh, CASE WHEN sl IS NOT NULL THEN greatest(0, base.ws + {INTERVAL} - sl) END AS sfresh
  FROM base LEFT JOIN vol USING (asset_id, ws) LEFT JOIN a2 USING (asset_id, ws) LEFT JOIN u2 USING (asset_id, ws) JOIN st USING (asset_id, ws)),
w AS (
  SELECT asset_id, ws AS window_start, CASE WHEN trade_count > 1 AND p0 <> 0 THEN p1 / p0 - 1 ELSE 0 END AS price_return, volume,
    CASE WHEN baseline <> 0 THEN volume / baseline ELSE 0 END AS relative_volume, coalesce(volatility, 0) AS volatility, spread, top_n_depth, orderbook_imbalance, orderbook_valid, trade_count,
    CASE WHEN buys + sells <> 0 THEN (buys - sells) / (buys + sells) ELSE 0 END AS buy_sell_pressure, fresh AS market_data_freshness_seconds,
    ma AS market_source_active, 0 AS market_source_idle, md AS market_source_degraded, CASE WHEN ok THEN mentions END AS mention_count, CASE WHEN ok THEN coalesce(authors, 0) END AS unique_author_count,
    CASE WHEN ok THEN coalesce(author_share, 0) END AS author_concentration, CASE WHEN ok THEN CASE WHEN posts > 0 THEN reposts / posts ELSE 0 END END AS repost_reply_ratio,
    CASE WHEN ok THEN posts / greatest(1.0, {INTERVAL} / 60.0) END AS hashtag_velocity, CASE WHEN ok THEN coalesce(url_share, 0) END AS url_concentration,
    CASE WHEN ok THEN coalesce(new_authors / authors, 0) END AS new_author_ratio, sfresh AS social_data_freshness_seconds, sa AS social_source_active, 0 AS social_source_idle, sd AS social_source_degraded,
    mf - sf AS social_lead_seconds, gaps AS source_gap_count,
    greatest(0, 1 - least(1.0, (fresh + coalesce(sfresh, 0)) / 600.0) - 0.25 * (md + sd) - least(0.5, gaps * 0.1)) AS data_quality_score, least(1.0, earlier / 20.0) AS baseline_confidence
  FROM j)"""

CLAMP = "least(1.0, greatest(0.0, {}))".format
DETECT_SQL = f"""{FEATURES_SQL},
d0 AS (
  SELECT *, coalesce(spread, 0) AS sp, coalesce(orderbook_imbalance, 0) AS im, coalesce(top_n_depth, 0) AS dp, abs(price_return) AS ar FROM w),
d1 AS (
  SELECT *,
    0.30 * {CLAMP('ar / 0.10')} + 0.35 * (0.70 * {CLAMP('(relative_volume - 1) / 4')} + 0.30 * {CLAMP('trade_count / 30')}) + 0.20 * {CLAMP('volatility / 0.05')} AS core,
    0.15 * (0.65 * {CLAMP('abs(im)')} + 0.35 * {CLAMP('sp / 0.02')}) AS micro, volume + dp AS lq FROM d0),
d AS (
  SELECT *, CASE WHEN trade_count > 0 OR volume > 0 THEN {CLAMP("CASE WHEN orderbook_valid = 1 THEN core + micro ELSE core / 0.85 END")} END AS market_score,
    CASE WHEN mention_count IS NOT NULL THEN {CLAMP(f"0.40 * {CLAMP('mention_count / 12')} + 0.25 * {CLAMP('unique_author_count / 8')} + 0.20 * {CLAMP('hashtag_velocity / 10')} + 0.15 * new_author_ratio")} END AS social_score,
    CASE WHEN mention_count IS NOT NULL THEN {CLAMP('0.40 * author_concentration + 0.35 * repost_reply_ratio + 0.25 * url_concentration')} END AS coordination_score,
    CASE WHEN social_lead_seconds <= 0 THEN 0 WHEN social_lead_seconds IS NOT NULL THEN {CLAMP('social_lead_seconds / 300')} END AS temporal_score,
    CASE WHEN ar >= 0.20 OR volatility >= 0.10 THEN 'DISLOCATED' WHEN volatility >= 0.04 THEN 'VOLATILE' WHEN ar >= 0.05 THEN 'TRENDING' ELSE 'CALM' END AS market_regime,
    CASE WHEN ar >= 0.20 OR volatility >= 0.10 THEN {CLAMP('greatest(ar / 0.4, volatility / 0.2)')} WHEN volatility >= 0.04 THEN {CLAMP('volatility / 0.10')} WHEN ar >= 0.05 THEN {CLAMP('ar / 0.20')}
      ELSE {CLAMP('1 - greatest(ar / 0.05, volatility / 0.04)')} END AS market_regime_confidence,
    CASE WHEN volume <= 0 AND dp <= 0 THEN 'UNKNOWN' WHEN lq < 10000 THEN 'LOW' WHEN lq < 250000 THEN 'MEDIUM' ELSE 'HIGH' END AS liquidity_class,
    CASE WHEN volume <= 0 AND dp <= 0 THEN 0.0 WHEN lq < 10000 THEN {CLAMP('1 - lq / 10000')} WHEN lq < 250000 THEN {CLAMP('lq / 250000')} ELSE {CLAMP('lq / 1000000')} END AS liquidity_confidence
  FROM d1)"""

FUSE_SQL = f"""{DETECT_SQL},
f0 AS (
  SELECT *, CASE WHEN market_score IS NULL THEN 0 ELSE 0.40 END + CASE WHEN social_score IS NULL THEN 0 ELSE 0.10 END + CASE WHEN coordination_score IS NULL THEN 0 ELSE 0.18 END + CASE WHEN temporal_score IS NULL THEN 0 ELSE 0.10 END AS aw,
    coalesce(market_score * 0.40, 0) + coalesce(social_score * 0.10, 0) + coalesce(coordination_score * 0.18, 0) + coalesce(temporal_score * 0.10, 0) AS ws_,
    3 + CAST(market_score IS NULL AS INTEGER) + CAST(social_score IS NULL AS INTEGER) + CAST(coordination_score IS NULL AS INTEGER) + CAST(temporal_score IS NULL AS INTEGER) AS n_missing FROM d),
f1 AS (
  SELECT *, CASE WHEN aw > 0 THEN ws_ / aw ELSE 0 END AS raw_score, {CLAMP('(1 - n_missing / 7.0) * (0.4 + 0.35 * baseline_confidence + 0.25 * data_quality_score)')} AS confidence FROM f0),
f2 AS (SELECT *, CASE WHEN market_score >= 0.65 AND coordination_score >= 0.65 THEN greatest(raw_score, 0.35) ELSE raw_score END AS floored FROM f1),
f3 AS (SELECT *, CASE WHEN coalesce(market_score, 0) < 0.35 THEN least(floored, 0.59) ELSE floored END AS fusion_score FROM f2),
f4 AS (
  SELECT *, CASE WHEN fusion_score >= 0.8 THEN 'CRITICAL' WHEN fusion_score >= 0.6 THEN 'HIGH' WHEN fusion_score >= 0.35 THEN 'WATCH' ELSE 'NORMAL' END AS l0,
    CASE WHEN social_score IS NOT NULL OR coordination_score IS NOT NULL THEN (coalesce(social_score * 0.30, 0) + coalesce(coordination_score * 0.70, 0)) / (CASE WHEN social_score IS NULL THEN 0 ELSE 0.30 END + CASE WHEN coordination_score IS NULL THEN 0 ELSE 0.70 END) END AS social_coordination_risk FROM f3),
f5 AS (
  SELECT *, CASE WHEN l0 = 'CRITICAL' AND NOT coalesce(market_score >= 0.65 AND greatest(coalesce(social_score, -1), coalesce(coordination_score, -1), coalesce(temporal_score, -1)) >= 0.55 AND confidence >= 0.4, false) THEN 'HIGH' ELSE l0 END AS l1 FROM f4),
f AS (SELECT *, CASE WHEN market_score IS NULL AND l1 IN ('HIGH', 'CRITICAL') THEN 'WATCH' ELSE l1 END AS severity FROM f5)"""

LEVEL = "CASE WHEN {0} >= 0.8 THEN 'CRITICAL' WHEN {0} >= 0.6 THEN 'HIGH' WHEN {0} >= 0.35 THEN 'WATCH' ELSE 'NORMAL' END".format


def _round_sql(names: list[str], kinds: dict[str, str] | None = None) -> str:
    whole = {"orderbook_valid", "trade_count", "mention_count", "unique_author_count", "source_gap_count", *(f"{d}_source_{c}" for d in ("market", "social") for c in ("active", "idle", "degraded"))}
    return ", ".join(n if n in whole else f"round(CAST({n} AS DOUBLE) + {NUDGE}, {PLACES}) + 0.0 AS {n}" for n in names)


QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


F_TEXT = list(windows.FEATURES)


@query(f"WITH {FEATURES_SQL} SELECT asset_id, window_start, {_round_sql(F_TEXT)} FROM w")
def fea_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(window_features(spark, sf_dir).select("asset_id", "window_start", *F_TEXT))


DETECTED = ["market_score", "social_score", "coordination_score", "temporal_score", "market_regime_confidence", "liquidity_confidence"]


@query(f"WITH {DETECT_SQL} SELECT asset_id, window_start, market_regime, liquidity_class, {_round_sql(DETECTED)} FROM d")
def det_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.detect(window_features(spark, sf_dir)).select("asset_id", "window_start", "market_regime", "liquidity_class", *DETECTED))


@query(f"""WITH {FEATURES_SQL},
m AS (SELECT asset_id, window_start, price_return AS x, count(*) OVER p - 1 AS n, sum(price_return) OVER p - price_return AS s, sum(price_return * price_return) OVER p - price_return * price_return AS ss
  FROM w WINDOW p AS (PARTITION BY window_start))
SELECT asset_id, window_start, n AS peers, CASE WHEN n < 3 THEN NULL WHEN ss / n - (s / n) * (s / n) <= 1e-18 THEN 0.0 ELSE round(least(1.0, abs((x - s / n) / sqrt(ss / n - (s / n) * (s / n))) / 4) + 1.7e-11, 9) END AS cross_asset_score FROM m""")
def det_cross_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.cross_asset(window_features(spark, sf_dir)).select("asset_id", "window_start", "peers", "cross_asset_score"))


FUSED = ["fusion_score", "confidence", "social_coordination_risk"]


@query(f"WITH {FUSE_SQL} SELECT asset_id, window_start, severity, n_missing, {_round_sql(FUSED)}, {LEVEL('coalesce(market_score, 0)')} AS market_anomaly_severity, {LEVEL('coalesce(social_coordination_risk, 0)')} AS social_coordination_severity FROM f")
def fus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir).select("asset_id", "window_start", "severity", F.size("missing_outputs").alias("n_missing"), *FUSED, "market_anomaly_severity", "social_coordination_severity"))


@query(f"""WITH {FUSE_SQL}
SELECT asset_id, window_start, component, round(value + 1.7e-11, 9) AS value, round(CASE WHEN value IS NOT NULL AND aw > 0 THEN weight / aw ELSE 0 END + 1.7e-11, 9) AS effective_weight,
  round(coalesce(value * weight / aw, 0) + 1.7e-11, 9) AS contribution
FROM (SELECT asset_id, window_start, aw, unnest(['market_score', 'social_score', 'coordination_score', 'temporal_score', 'claim_risk', 'graph_score']) AS component,
  unnest([market_score, social_score, coordination_score, temporal_score, NULL, NULL]) AS value, unnest([0.40, 0.10, 0.18, 0.10, 0.12, 0.10]) AS weight FROM f)""")
def fus_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.trace(scored(spark, sf_dir), ["asset_id", "window_start"]).drop("weight"))


@query(f"""WITH {FUSE_SQL},
x AS (SELECT *, {LEVEL('coalesce(market_score, 0)')} AS ms, {LEVEL('coalesce(social_coordination_risk, 0)')} AS ss, coalesce(social_coordination_risk, 0) AS so, coalesce(market_score, 0) AS mk FROM f),
y AS (
  SELECT asset_id, window_start, 'SOCIAL_HYPE_SURGE' AS alert_type, ss AS alert_severity FROM x WHERE so >= 0.35
  UNION ALL SELECT asset_id, window_start, 'COORDINATED_PROMOTION', ss FROM x WHERE coordination_score >= 0.55
  UNION ALL SELECT asset_id, window_start, 'MARKET_VOLUME_ANOMALY', ms FROM x WHERE mk >= 0.35 AND relative_volume >= 2.5
  UNION ALL SELECT asset_id, window_start, 'MARKET_PRICE_ANOMALY', ms FROM x WHERE abs(price_return) >= 0.08
  UNION ALL SELECT asset_id, window_start, 'MARKET_MICROSTRUCTURE_ANOMALY', ms FROM x WHERE sp >= 0.02 OR abs(im) >= 0.70
  UNION ALL SELECT asset_id, window_start, 'CROSS_DOMAIN_MANIPULATION_RISK', severity FROM x WHERE fusion_score >= 0.35 AND mk >= 0.35 AND so >= 0.35
  UNION ALL SELECT asset_id, window_start, 'POSSIBLE_DUMP_PHASE', CASE WHEN ms = 'NORMAL' THEN 'WATCH' ELSE ms END FROM x WHERE price_return <= -0.05 OR buy_sell_pressure <= -0.35)
SELECT * FROM y""")
def cmp_alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.alerts(scored(spark, sf_dir), ["asset_id", "window_start"])


@query(f"WITH {FUSE_SQL} SELECT asset_id, window_start, severity, round(fusion_score + 1.7e-11, 9) AS fusion_score, market_regime, liquidity_class FROM f WHERE severity <> 'NORMAL'")
def surveillance_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which assets are at WATCH or above, and when: from events to severities in one plan."""
    return rounded(scored(spark, sf_dir).where("severity <> 'NORMAL'").select("asset_id", "window_start", "severity", "fusion_score", "market_regime", "liquidity_class"))


@query(f"""WITH {adapters.SIGNALS_SQL}, r AS (SELECT *, epoch_us(event_time) / 1e6 AS t FROM sig),
m AS (
  SELECT asset_id, max(t) AS al, max(t) FILTER (source_domain = 'market') AS ml, max(t) FILTER (source_domain = 'social') AS sl,
    coalesce(arg_max(source_degraded, (t, event_id)) FILTER (source_domain = 'market' AND kind = 'DATA_QUALITY'), false) AS md,
    coalesce(arg_max(source_degraded, (t, event_id)) FILTER (source_domain = 'social' AND kind = 'DATA_QUALITY'), false) AS sd FROM r GROUP BY ALL),
n AS (
  SELECT asset_id, CASE WHEN ml IS NULL OR md THEN NULL WHEN al - ml >= 300 THEN al - 120 ELSE ml - 120 END AS market_watermark, CASE WHEN sl IS NULL OR sd THEN NULL WHEN al - sl >= 300 THEN al - 120 ELSE sl - 120 END AS social_watermark FROM m)
SELECT asset_id, round(market_watermark + 1.7e-11, 9) AS market_watermark, round(social_watermark + 1.7e-11, 9) AS social_watermark,
  CASE WHEN market_watermark IS NOT NULL AND social_watermark IS NOT NULL THEN round(least(market_watermark, social_watermark) + 1.7e-11, 9) END AS fusion_watermark FROM n""")
def win_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.watermarks(adapters.signals(spark, sf_dir)).drop("scope_id"))


@query(f"""WITH {adapters.SIGNALS_SQL}, r AS (SELECT *, epoch_us(event_time) / 1e6 AS t, i, CAST(floor(epoch_us(event_time) / 1e6 / i) * i AS BIGINT) AS window_start FROM sig, (VALUES (3600), (21600)) AS x(i))
SELECT asset_id, i AS interval_seconds, window_start, sha256(string_agg(event_id, ',' ORDER BY t, event_id)) AS lineage_hash, count(*) AS n FROM r GROUP BY ALL""")
def win_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.lineage(adapters.signals(spark, sf_dir), [3600, INTERVAL]).select("asset_id", "interval_seconds", "window_start", "lineage_hash", "n")


@query("""WITH r AS (SELECT CAST(l_partkey AS VARCHAR) AS asset_id, CAST(floor(epoch(l_shipdate) / 2592000) * 2592000 AS BIGINT) AS window_start, l_quantity AS q, l_extendedprice / l_quantity AS p, l_returnflag AS f FROM lineitem)
SELECT asset_id, window_start, count(*) AS trade_count, round(sum(q * p), 4) AS volume,
  round(coalesce((sum(q) FILTER (f = 'A') - sum(q) FILTER (f = 'R')) / nullif(sum(q) FILTER (f IN ('A', 'R')), 0), CASE WHEN count(*) FILTER (f = 'A') > 0 THEN 1 WHEN count(*) FILTER (f = 'R') > 0 THEN -1 ELSE 0 END), 6) AS buy_sell_pressure
FROM r GROUP BY ALL""")
def fea_trades_30d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade features of parts in windows of 30 days, over the whole of lineitem."""
    out = windows.features(adapters.trades(spark, sf_dir), [2_592_000])
    return out.select("asset_id", "window_start", "trade_count", F.round("volume", 4).alias("volume"), F.round("buy_sell_pressure", 6).alias("buy_sell_pressure"))
