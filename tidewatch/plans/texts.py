"""Queries on texts, claims, threats, evaluation and calibration, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import evaluation, narratives, scoring, text, threat
from tidewatch.plans.core import DETECT_SQL, LEVEL, scored
from tidewatch.plans.quality import ORACLES as QUALITY_SQL
from tidewatch.plans.records import ORACLES as RECORDS_SQL
from tidewatch.plans.records import ver_candidates_as_of
from tidewatch.sources import adapters
from tidewatch.sources.adapters import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TOKENS = "regexp_extract_all(lower({}), '[a-z0-9][a-z0-9_-]+')".format


@query(r"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
r AS (SELECT doc_id, concat_ws(',', CASE WHEN length(text) > 20000 THEN 'TEXT_TOO_LARGE' END,
  CASE WHEN regexp_matches(text, '(?i)ignore\s+(all\s+)?previous\s+instructions') OR regexp_matches(text, '(?i)reveal\s+(the\s+)?(system|developer)\s+prompt') OR regexp_matches(text, '(?i)<\s*(system|assistant|tool)\s*>') OR regexp_matches(text, '(?i)jailbreak|prompt\s+injection') THEN 'PROMPT_INJECTION_PATTERN' END,
  CASE WHEN regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]') THEN 'CONTROL_CHARACTERS' END,
  CASE WHEN len(w) >= 50 AND len(list_distinct(w)) / len(w) < 0.08 THEN 'REPETITIVE_CONTENT' END) AS reasons FROM w)
SELECT doc_id, reasons, CASE WHEN reasons = '' THEN 0.0 ELSE round(least(1.0, 0.35 * (1 + length(reasons) - length(replace(reasons, ',', '')))), 6) END AS risk FROM r""")
def flt_guard_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text.guard_text(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("reasons", ",").alias("reasons"), F.round("risk", 6).alias("risk"))


def tagged_sql(sign: str, name: str) -> str:
    """A name after a sign that no word character precedes."""
    return rf"regexp_extract_all(text, '(^|[^\p{{L}}\p{{N}}\p{{M}}_]){sign}({name})', 2)"


@query(f"""SELECT doc_id, array_to_string(list_transform({tagged_sql('#', '[A-Za-z][A-Za-z0-9_]{0,31}')}, lambda x: upper(x)), ',') AS hashtags, array_to_string(list_transform({tagged_sql('[$]', '[A-Za-z][A-Za-z0-9]{0,15}')}, lambda x: upper(x)), ',') AS cashtags,
  array_to_string({tagged_sql('@', '[A-Za-z0-9_]{1,32}')}, ',') AS mentions, array_to_string(list_transform(regexp_extract_all(text, '(?i)https?://[^\\s<>()]+'), lambda u: regexp_replace(u, '[.,;:!?]+$', '')), ',') AS urls FROM documents""")
def prj_parse_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text.parse_posts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *(F.array_join(c, ",").alias(c) for c in ("hashtags", "cashtags", "mentions", "urls")))



@query(f"""WITH w AS (SELECT doc_id AS post_id, unnest({TOKENS('text')}) AS alias, generate_subscripts({TOKENS('text')}, 1) - 1 AS position FROM documents),
t AS (SELECT alias, count(*) AS n FROM w WHERE length(alias) >= 6 GROUP BY alias ORDER BY n DESC, alias LIMIT 20),
r AS (SELECT alias, row_number() OVER (ORDER BY n DESC, alias) AS k FROM t)
SELECT post_id, position, w.alias, CASE WHEN k % 5 = 0 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS status, CASE WHEN k % 5 = 0 THEN 0.4 ELSE 0.62 END AS confidence FROM w JOIN r ON w.alias = r.alias""")
def men_bare_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of a registry: the twenty most frequent words of six letters or more."""
    from pyspark.sql import Window

    posts = adapters.posts(spark, sf_dir)
    top = posts.select(F.explode(text.tokens(F.col("text"))).alias("alias")).where("length(alias) >= 6").groupBy("alias").count().orderBy(F.desc("count"), "alias").limit(20)
    registry = top.withColumn("k", F.row_number().over(Window.orderBy(F.desc("count"), "alias"))).select("alias", F.concat(F.lit("A"), F.col("k")).alias("asset_id"), (F.col("k") % 5 == 0).alias("ambiguous"))
    return text.mentions(posts, registry).select("post_id", "position", "alias", "status", "confidence")


@query(f"""WITH t AS (SELECT item_id, unnest({TOKENS('text')}) AS token FROM benchmark), h AS (SELECT item_id, token, sha256(token) AS h FROM t),
c AS (SELECT item_id, CAST('0x' || substring(h, 1, 8) AS BIGINT) % 128 AS index, sum((CASE WHEN CAST('0x' || substring(h, 10, 1) AS INTEGER) % 2 = 1 THEN 1.0 ELSE -1.0 END) * (1 + least(length(token), 12) / 12.0)) AS v FROM h GROUP BY ALL)
SELECT item_id, CAST(index AS INTEGER) AS index, round(value + 1.7e-11, 9) AS value FROM (SELECT item_id, index, v, v / sqrt(sum(v * v) OVER (PARTITION BY item_id)) AS value FROM c) WHERE abs(v) > 1e-12""")
def nar_hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.hash_embedding(table(spark, sf_dir, "benchmark"), "item_id").select("item_id", "index", F.round(F.col("value") + 1.7e-11, 9).alias("value"))


@query(f"""WITH w AS (SELECT source, unnest({TOKENS('text')}) AS w FROM documents),
n AS (SELECT source, w, count(*) AS n FROM w WHERE length(w) >= 4 AND w NOT IN ('about', 'after', 'from', 'have', 'that', 'this', 'with', 'will', 'again', 'asset', 'into', 'just', 'more') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS r FROM n) SELECT source, string_agg(w, ' / ' ORDER BY r) AS label FROM r WHERE r <= 4 GROUP BY source""")
def nar_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.labels(table(spark, sf_dir, "documents"), "source")


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0),
p AS (SELECT q.vec_id AS query_id, e.vec_id, least(1.0, greatest(0.0, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))) AS s FROM q JOIN embeddings e ON q.vec_id <> e.vec_id)
SELECT query_id, vec_id, round(s + 1.7e-11, 9) AS similarity, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r FROM p) WHERE r <= 5""")
def nar_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of a stated query set: every row whose id is divisible by 20, against all rows."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    out = narratives.nearest(e.where("id % 20 = 0"), e, 5)
    return out.select("query_id", F.col("id").alias("vec_id"), F.round(F.col("similarity") + 1.7e-11, 9).alias("similarity"), "place")


@query()
def nar_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy narrative clusters of vectors within windows of 50 ids of a label: order-dependent, tested on given values."""
    v = table(spark, sf_dir, "embeddings").select(F.concat_ws(":", F.col("label").cast("string"), F.expr("vec_id div 50").cast("string")).alias("grp"), F.col("vec_id").alias("post_id"), F.col("vec_id").alias("epoch"), F.col("embedding").cast("array<double>").alias("vector"))
    return text.cluster(v, "grp")


@query(r"""WITH RECURSIVE a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
l AS (SELECT doc_id, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM a WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''),
c AS (SELECT doc_id, i, line, 0 AS chunk, length(line) AS n FROM l WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, l.line, CASE WHEN c.n + 1 + length(l.line) > 1200 THEN c.chunk + 1 ELSE c.chunk END, CASE WHEN c.n + 1 + length(l.line) > 1200 THEN length(l.line) ELSE c.n + 1 + length(l.line) END FROM c JOIN l ON l.doc_id = c.doc_id AND l.i = c.i + 1),
g AS (SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY i) AS text FROM c GROUP BY doc_id, chunk)
SELECT doc_id, chunk, text, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS tokens FROM g""")
def ver_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.chunks(table(spark, sf_dir, "documents"), "doc_id")


@query(rf"""WITH s AS (SELECT item_id, text, list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '(?i);|\s+(?:and|but|while)\s+', chr(1), 'g'), chr(1)), lambda x: trim(x)) AS p FROM benchmark),
f AS (SELECT item_id, text, list_filter(p, lambda x: len({TOKENS('x')}) >= 3) AS p FROM s), k AS (SELECT item_id, (CASE WHEN len(p) > 0 THEN p ELSE [text] END)[1:5] AS p FROM f),
e AS (SELECT item_id, claim_text AS text, min(n) AS n FROM (SELECT item_id, unnest(p) AS claim_text, generate_subscripts(p, 1) - 1 AS n FROM k) GROUP BY ALL), t AS (SELECT *, {TOKENS('text')} AS t FROM e)
SELECT item_id, CAST(n AS INTEGER) AS n, text AS claim_text, CASE WHEN list_has_any(t, ['contract', 'award']) THEN 'CONTRACT_AWARD' WHEN list_has_any(t, ['promoter']) AND list_has_any(t, ['buy', 'bought', 'purchase']) THEN 'INSIDER_PURCHASE'
    WHEN contains(array_to_string(t, ' '), 'earning') OR list_has_any(t, ['results']) THEN 'EARNINGS_FORECAST' WHEN list_has_any(t, ['listing']) THEN 'EXCHANGE_LISTING' WHEN list_has_any(t, ['partnership']) THEN 'PARTNERSHIP' ELSE 'OTHER' END AS claim_type,
  CASE WHEN list_has_any(t, ['no', 'not', 'never', 'denies', 'denied', 'false', 'without']) THEN 'NEGATIVE' ELSE 'POSITIVE' END AS polarity, array_to_string(regexp_extract_all(array_to_string(t, ' '), '\b(\d+(?:\.\d+)?)\b', 1), ',') AS amounts FROM t""")
def ver_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.claims(table(spark, sf_dir, "benchmark"), "item_id").select("item_id", "n", "claim_text", "claim_type", "polarity", F.array_join("amounts", ",").alias("amounts"))


SIMILAR_SQL = """round(0.60 * coalesce(len(list_intersect(b.lexical, d.lexical)) / nullif(len(list_distinct(list_concat(b.lexical, d.lexical))), 0), 0) + 0.20 * CAST(b.claim_type = d.claim_type AS INTEGER) + 0.10 * CAST(b.polarity = d.polarity AS INTEGER) + 0.10 * CASE WHEN len(b.amounts) = 0 THEN 1 ELSE CAST(list_has_any(b.amounts, d.amounts) AS INTEGER) END + 1.7e-11, 9)"""


def canonical_sql(name: str, source: str, key: str) -> str:
    t = TOKENS("text")
    return f"""{name}0 AS (SELECT {key}, {t} AS t FROM {source}),
{name} AS (SELECT {key}, list_distinct(list_filter(t, lambda w: w NOT IN ('about', 'after', 'from', 'have', 'that', 'this', 'with', 'will'))) AS lexical,
  CASE WHEN list_has_any(t, ['contract', 'award']) THEN 'CONTRACT_AWARD' WHEN list_has_any(t, ['promoter']) AND list_has_any(t, ['buy', 'bought', 'purchase']) THEN 'INSIDER_PURCHASE'
    WHEN contains(array_to_string(t, ' '), 'earning') OR list_has_any(t, ['results']) THEN 'EARNINGS_FORECAST' WHEN list_has_any(t, ['listing']) THEN 'EXCHANGE_LISTING' WHEN list_has_any(t, ['partnership']) THEN 'PARTNERSHIP' ELSE 'OTHER' END AS claim_type,
  CASE WHEN list_has_any(t, ['no', 'not', 'never', 'denies', 'denied', 'false', 'without']) THEN 'NEGATIVE' ELSE 'POSITIVE' END AS polarity, regexp_extract_all(array_to_string(t, ' '), '\\b(\\d+(?:\\.\\d+)?)\\b', 1) AS amounts FROM {name}0)"""


@query(f"""WITH {canonical_sql('b', 'benchmark', 'item_id')}, {canonical_sql('d', 'documents', 'doc_id')},
k AS (SELECT DISTINCT b.item_id, d.doc_id FROM (SELECT item_id, unnest(lexical) AS w FROM b) b JOIN (SELECT doc_id, unnest(lexical) AS w FROM d) d ON b.w = d.w WHERE length(b.w) >= 8)
SELECT item_id, doc_id, {SIMILAR_SQL} AS similarity
FROM k JOIN b USING (item_id) JOIN d USING (doc_id)""")
def ver_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims against disclosures that share a word of eight letters or more."""
    b = text.canonical(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("b_text")), "b_text").drop("b_text", "content")
    d = text.canonical(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("d_text")), "d_text").drop("d_text", "content")
    word = lambda rows, k: rows.select(k, F.explode("lexical").alias("w")).where("length(w) >= 8")
    pairs = word(b, "item_id").join(word(d, "doc_id"), "w").select("item_id", "doc_id").distinct()
    named = lambda rows, p, k: rows.select(k, *(F.col(c).alias(p + c) for c in ("lexical", "claim_type", "polarity", "amounts")))
    joined = pairs.join(named(b, "b_", "item_id"), "item_id").join(named(d, "d_", "doc_id"), "doc_id")
    return joined.select("item_id", "doc_id", F.round(text.similarity("b_", "d_") + 1.7e-11, 9).alias("similarity"))


@query(f"""WITH {canonical_sql('b', 'benchmark', 'item_id')}, {canonical_sql('d', 'documents', 'doc_id')},
x AS (SELECT doc_id, doc_id % 40 AS document_key, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS version FROM documents), n AS ({RECORDS_SQL['ver_candidates_as_of']})
SELECT claim_id, x.doc_id, n.before, {SIMILAR_SQL} AS similarity, concat_ws(',', CASE WHEN b.polarity <> d.polarity THEN 'POLARITY_MISMATCH' END, CASE WHEN len(b.amounts) > 0 AND len(d.amounts) > 0 AND NOT list_has_any(b.amounts, d.amounts) THEN 'AMOUNT_MISMATCH' END) AS conflicts
FROM n JOIN x USING (document_key, version) JOIN b ON b.item_id = claim_id JOIN d ON d.doc_id = x.doc_id""")
def ver_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with the documents that may bear them out by time: similarity, and how they contradict."""
    from pyspark.sql import Window

    key = F.col("doc_id") % 40
    x = table(spark, sf_dir, "documents").select("doc_id", key.alias("document_key"), F.row_number().over(Window.partitionBy(key).orderBy("doc_id")).alias("version"))
    pairs = ver_candidates_as_of(spark, sf_dir).join(x, ["document_key", "version"]).select("claim_id", "doc_id", "before")
    claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), "text")
    out = text.compare(pairs, claims, "claim_id", table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return out.select("claim_id", "doc_id", "before", F.round(F.col("similarity") + 1.7e-11, 9).alias("similarity"), F.array_join("conflicts", ",").alias("conflicts"))


@query(f"""WITH m AS ({ORACLES['ver_matches']}), cv AS ({QUALITY_SQL['dq_coverage']}),
s AS (SELECT *, similarity * (0.3 + 0.1 * (doc_id % 7)) AS score, 0.3 + 0.1 * (doc_id % 7) AS reliability, conflicts <> '' AS conflict FROM m),
k AS (SELECT item_id AS claim_id FROM benchmark UNION ALL SELECT item_id + 1000000 FROM benchmark WHERE item_id % 3 = 0),
ok AS (SELECT claim_id, complete FROM k JOIN cv ON cv.asset_id = 'A' || (claim_id % 20) AND cv.epoch = 1704067200 + 86400 * (claim_id % 28)),
g AS (SELECT claim_id, count(doc_id) AS candidates, count(*) FILTER (score >= 0.34 AND before AND conflict) AS c, count(*) FILTER (score >= 0.34 AND before AND NOT conflict) AS s, count(*) FILTER (score >= 0.34 AND NOT before) AS a,
  max(reliability) FILTER (score >= 0.34 AND before AND NOT conflict) AS r FROM k LEFT JOIN s USING (claim_id) GROUP BY ALL),
v AS (SELECT g.*, CASE WHEN c > 0 THEN 'CONFLICTING' WHEN s > 0 THEN 'SUPPORTED_BEFORE' WHEN a > 0 THEN 'SUPPORTED_AFTER' WHEN complete = false THEN 'UNKNOWN' WHEN candidates > 0 THEN 'UNSUPPORTED' ELSE 'UNKNOWN' END AS result FROM g LEFT JOIN ok USING (claim_id))
SELECT claim_id, candidates, result, CAST(CASE result WHEN 'CONFLICTING' THEN 1.0 WHEN 'SUPPORTED_BEFORE' THEN 0.15 WHEN 'SUPPORTED_AFTER' THEN 0.75 WHEN 'UNSUPPORTED' THEN 0.90 ELSE 0.50 END AS DOUBLE) AS claim_risk,
  CAST(CASE WHEN result = 'SUPPORTED_BEFORE' THEN round(r, 6) ELSE 0 END AS DOUBLE) AS legitimate FROM v""")
def ver_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims, some of which have no candidates, judged by the documents that are similar, with the coverage of their asset's sources."""
    from tidewatch.plans.quality import dq_coverage

    reliability = 0.3 + 0.1 * (F.col("doc_id") % 7)
    m = ver_matches(spark, sf_dir).select("claim_id", (F.col("similarity") * reliability).alias("score"), reliability.alias("reliability"), "before", (F.col("conflicts") != "").alias("conflict"))
    item = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"))
    claims = item.unionAll(item.where("claim_id % 3 = 0").select(F.col("claim_id") + 1_000_000))
    asked = claims.select("claim_id", F.concat(F.lit("A"), F.col("claim_id") % 20).alias("asset_id"), (F.lit(1704067200) + 86_400 * (F.col("claim_id") % 28)).alias("epoch"))
    covered = asked.join(dq_coverage(spark, sf_dir), ["asset_id", "epoch"]).select("claim_id", "complete")
    return text.verdicts(claims, m, "claim_id", covered).select("claim_id", "candidates", "result", "claim_risk", F.round("legitimate", 6).alias("legitimate"))


LABEL_SQL = "regexp_full_match({0}, '([a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?[.])*[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?') AND length({0}) <= 253".format


@query(f"""WITH r AS (SELECT DISTINCT doc_id, regexp_replace(unnest(regexp_extract_all(text, '[A-Za-z0-9:@._/%?=&+-]+')), '^[.,;()]+|[.,;()]+$', '', 'g') AS v FROM documents),
c AS (SELECT doc_id, 'DOMAIN' AS indicator_type, lower(v) AS indicator_value FROM r WHERE contains(v, '.') AND {LABEL_SQL('lower(v)')} AND NOT regexp_matches(v, '(?i)^https?://')
  UNION SELECT doc_id, 'IPV4', v FROM r WHERE regexp_full_match(v, '(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){{3}}')
  UNION SELECT doc_id, CASE length(v) WHEN 32 THEN 'MD5' WHEN 40 THEN 'SHA1' ELSE 'SHA256' END, lower(v) FROM r WHERE regexp_full_match(v, '[0-9a-fA-F]+') AND length(v) IN (32, 40, 64))
SELECT DISTINCT doc_id, indicator_type, indicator_value FROM c""")
def thr_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given texts hold no addresses and no IPv6, so the SQL leaves these out; the tests have them."""
    return threat.candidates(table(spark, sf_dir, "documents"), "doc_id")


@query(r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '(?i)^(https?)://', 1)) AS s, lower(regexp_extract(url, '(?i)^https?://([^/?#:@\s]+)', 1)) AS h, regexp_extract(url, '(?i)^https?://[^/?#]+(:[0-9]+)', 1) AS o, regexp_extract(url, '(?i)^https?://[^/?#]+([^?#]*)', 1) AS a, regexp_extract(url, '([?][^#]*)', 1) AS q FROM pages),
u AS (SELECT page_id, s || '://' || h || CASE WHEN o IN (':80', ':443') THEN '' ELSE o END || CASE WHEN a = '' THEN '/' ELSE a END || q AS v FROM p)
SELECT page_id, v AS indicator_value, sha256('URL:' || v) AS identity_hash FROM u""")
def thr_page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses in normal form, with the hash of their identity."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.lit("url").alias("type"), F.col("url").alias("indicator"))
    return threat.normalize(rows).select("page_id", "indicator_value", "identity_hash")


@query(r"""WITH c AS (SELECT DISTINCT doc_id, lower(regexp_replace(unnest(regexp_extract_all(text, '[A-Za-z0-9:@._/%?=&+-]+')), '^[.,;()]+|[.,;()]+$', '', 'g')) AS h FROM documents), m AS (SELECT doc_id, h FROM c WHERE regexp_full_match(h, '[0-9a-f]+') AND length(h) IN (32, 40, 64)),
n AS (SELECT h, count(*) AS docs FROM m GROUP BY h) SELECT doc_id, h AS indicator_value, docs FROM m JOIN n USING (h) WHERE docs >= 2""")
def thr_shared_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes that several texts have: the match of candidates with indicators, the indicators being such hashes."""
    found = threat.candidates(table(spark, sf_dir, "documents"), "doc_id").where("indicator_type in ('MD5', 'SHA1', 'SHA256')")
    return threat.shared(threat.written(found), "doc_id").select("doc_id", "indicator_value", "docs")


@query("""WITH h AS (SELECT 'A' || (user_id % 20) AS asset_id, event_id AS match_id, CAST(epoch(ts) AS BIGINT) AS epoch, CAST(epoch(ts) AS BIGINT) + 3600 AS fetched_at FROM events WHERE event_type = 'error' AND value > 480),
a AS (SELECT DISTINCT 'A' || (user_id % 20) AS asset_id, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS cutoff FROM events),
j AS (SELECT a.asset_id, a.cutoff, least(20, count(match_id)) AS n FROM a LEFT JOIN h ON a.asset_id = h.asset_id AND epoch <= cutoff AND fetched_at <= cutoff GROUP BY ALL)
SELECT asset_id, cutoff, n, CASE WHEN n > 0 THEN 'MATCHED' ELSE 'NO_MATCH' END AS status, round(least(1.0, n / 3), 9) AS threat_score FROM j""")
def thr_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    epoch = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")
    asset = F.concat(F.lit("A"), F.col("user_id") % 20).alias("asset_id")
    # In SQL, a cast to BIGINT rounds.
    rounded = F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")
    hits = e.where("event_type = 'error' and value > 480").select(asset, F.col("event_id").alias("match_id"), rounded.alias("epoch"), (rounded + 3600).alias("fetched_at"))
    at = e.select(asset, (F.floor(epoch / 86_400) * 86_400).cast("long").alias("cutoff")).distinct()
    return threat.context(at, hits).select("asset_id", "cutoff", "n", "status", F.round("threat_score", 9).alias("threat_score"))


@query(f"""WITH c AS ({ORACLES['thr_context']}), h AS (SELECT 'A' || (user_id % 20) AS asset_id, event_id, CAST(epoch(ts) AS BIGINT) AS e, (user_id % 10) / 10.0 AS confidence FROM events WHERE event_type = 'error' AND value > 480),
k AS (SELECT c.asset_id, cutoff, confidence, row_number() OVER (PARTITION BY c.asset_id, cutoff ORDER BY e DESC, event_id) AS place FROM c JOIN h ON h.asset_id = c.asset_id AND e + 3600 <= cutoff),
m AS (SELECT asset_id, cutoff, max(confidence) AS confidence FROM k WHERE place <= 20 GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('fresh', NULL), ('stale', 'STALE'), ('none', 'UNAVAILABLE'), ('off', 'DISABLED')) AS t(feed, bad))
SELECT feed, asset_id, cutoff, coalesce(bad, status) AS status, CASE WHEN bad IS NULL THEN threat_score END AS threat_score, CAST(CASE WHEN bad IS NULL THEN coalesce(confidence, 0) END AS DOUBLE) AS threat_confidence FROM c LEFT JOIN m USING (asset_id, cutoff), f""")
def thr_feed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of every asset and day by the state of the feed: fresh, stale, never succeeded, and switched off."""
    e = table(spark, sf_dir, "events")
    second = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    asset = F.concat(F.lit("A"), F.col("user_id") % 20).alias("asset_id")
    seen = F.round(second).cast("long")
    hits = e.where("event_type = 'error' and value > 480").select(asset, F.col("event_id").alias("match_id"), seen.alias("epoch"), (seen + 3600).alias("fetched_at"), (F.col("user_id") % 10 / 10.0).alias("confidence"))
    at = e.select(asset, (F.floor(second / 86_400) * 86_400).cast("long").alias("cutoff")).distinct()
    feed = lambda last: spark.sql(f"select cast({last} as bigint) as last_success, 100000 as now")
    cases = {"fresh": {"feed": feed(99_000)}, "stale": {"feed": feed(90_000)}, "none": {"feed": feed("null")}, "off": {"enabled": False}}
    out = [threat.context(at, hits, **case).select(F.lit(name).alias("feed"), "asset_id", "cutoff", "status", F.round("threat_score", 9).alias("threat_score"), "threat_confidence") for name, case in cases.items()]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


PROFILE = "CASE WHEN coalesce(market_score, 0) < 0.35 THEN least(0.59, {0}) ELSE {0} END".format


def _profile_sql(names: list[str]) -> str:
    w = " + ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE {scoring.WEIGHTS[k]} END" for k in names)
    s = " + ".join(f"coalesce({k} * {scoring.WEIGHTS[k]}, 0)" for k in names)
    return PROFILE(f"coalesce(({s}) / nullif({w}, 0), 0)")


FOUR = ["market_score", "social_score", "coordination_score", "temporal_score"]


@query(f"""WITH {DETECT_SQL},
p AS ({' UNION ALL '.join(f"SELECT '{k}' AS profile, window_start, {_profile_sql([n for n in v if n in FOUR])} AS score FROM d" for k, v in evaluation.PROFILES.items())}),
l AS (SELECT *, {LEVEL('score')} AS level FROM p)
SELECT profile, count(*) AS observations, count(*) FILTER (level IN ('HIGH', 'CRITICAL')) AS alerts, count(*) FILTER (level <> 'NORMAL') AS watch_or_higher, min(window_start) FILTER (level <> 'NORMAL') AS first_watch,
  round(max(score), 5) AS peak_score, round(coalesce(count(*) FILTER (level IN ('HIGH', 'CRITICAL') AND window_start < 1705276800) / nullif(count(*) FILTER (window_start < 1705276800), 0), 0), 9) AS false_positive_rate
FROM l GROUP BY profile""")
def evl_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.ablation(scored(spark, sf_dir))
    out = evaluation.metrics(rows, 1705276800, ["profile"], "window_start")
    return out.select("profile", "observations", "alerts", "watch_or_higher", "first_watch", F.round("peak_score", 5).alias("peak_score"), F.round("false_positive_rate", 9).alias("false_positive_rate"))


@query("""WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS c FROM events)
SELECT event_type, round(max(value), 6) AS percentile FROM n WHERE k = round_even((c - 1) * 0.95, 0) GROUP BY event_type""")
def evl_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.exact_percentile(table(spark, sf_dir, "events"), ["event_type"], "value", 0.95).select("event_type", F.round("percentile", 6).alias("percentile"))


CALIBRATION_SQL = "x AS (SELECT d.doc_id, greatest(0.01, least(0.99, n_chars / 5000.0)) AS p, quality AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def calibration_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("n_chars") / 5000.0)).alias("p"), F.col("quality").alias("y"))


@query(f"""WITH {CALIBRATION_SQL},
b AS (SELECT count(*) AS n, sum(y) AS positives, avg((p - y) * (p - y)) AS brier, -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS log_loss FROM x),
k AS (SELECT least(9, CAST(floor(p * 10 + 1e-12) AS INTEGER)) AS bin, count(*) AS m, avg(p) AS c, avg(y) AS a FROM x GROUP BY ALL), e AS (SELECT sum(m * abs(c - a)) / sum(m) AS ece FROM k),
u AS (SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*) AS auc FROM x a, x b WHERE a.y = 1 AND b.y = 0)
SELECT n, CAST(positives AS DOUBLE) AS positives, round(brier, 8) AS brier, round(log_loss, 8) AS log_loss, round(ece, 8) AS ece, round(auc, 8) AS auc FROM b, e, u""")
def cal_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluation.calibration_metrics(calibration_rows(spark, sf_dir), "p", "y")
    return m.select("n", "positives", *(F.round(c, 8).alias(c) for c in ("brier", "log_loss", "ece", "auc")))


@query()
def cal_platt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen hundred gradient steps: beyond SQL in one statement; tested against steps written out."""
    rows = calibration_rows(spark, sf_dir)
    a, b = evaluation.fit_platt(rows.where("doc_id % 4 <> 0"), "p", "y")
    return evaluation.calibrated(rows, "p", a, b)


MODELS_SQL = f"""{CALIBRATION_SQL},
m AS (SELECT doc_id % 12 AS model_id, doc_id, p, y FROM x),
b AS (SELECT model_id, count(*) AS n, avg((p - y) * (p - y)) AS brier, count(*) FILTER (p >= 0.6 AND y = 0) AS fp FROM m GROUP BY ALL),
k AS (SELECT model_id, least(9, CAST(floor(p * 10 + 1e-12) AS INTEGER)) AS bin, count(*) AS c, avg(p) AS ap, avg(y) AS ay FROM m GROUP BY ALL), e AS (SELECT model_id, sum(c * abs(ap - ay)) / sum(c) AS ece FROM k GROUP BY ALL),
u AS (SELECT a.model_id, sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*) AS auc FROM m a JOIN m b ON a.model_id = b.model_id WHERE a.y = 1 AND b.y = 0 GROUP BY ALL),
h AS (SELECT model_id, least(9, floor(p * 10)) AS bin, count(*) FILTER ((doc_id // 12) % 2 = 0) AS a, count(*) FILTER ((doc_id // 12) % 2 <> 0) AS b FROM m GROUP BY ALL),
v AS (SELECT *, greatest(1e-6, a / sum(a) OVER (PARTITION BY model_id)) AS pa, greatest(1e-6, b / sum(b) OVER (PARTITION BY model_id)) AS pb FROM h), d AS (SELECT model_id, sum((pb - pa) * ln(pb / pa)) AS psi FROM v GROUP BY ALL)"""


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibration rows as those of twelve models: their metrics, false positives and drift (of every second dozen of ids)."""
    x = calibration_rows(spark, sf_dir).withColumn("model_id", F.col("doc_id") % 12)
    fp = x.groupBy("model_id").agg(F.count_if((F.col("p") >= 0.6) & (F.col("y") == 0)).alias("false_positives"))
    moved = evaluation.drift(x.withColumn("even", F.expr("doc_id div 12 % 2 = 0")), "model_id", "p", "even")
    return evaluation.calibration_metrics(x, "p", "y", keys=("model_id",)).join(fp, "model_id").join(moved, "model_id")


@query(f"""WITH {MODELS_SQL} SELECT model_id, round(psi, 8) AS psi, CASE WHEN psi >= 0.2 THEN 'DRIFTED' ELSE 'STABLE' END AS drift_status FROM d""")
def gov_model_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_metrics(spark, sf_dir).select("model_id", F.round("psi", 8).alias("psi"), "drift_status")


@query(f"""WITH {MODELS_SQL}, g AS (SELECT b.model_id, n >= 30 AS enough_samples, ece <= 0.45 AS calibrated, coalesce(auc, 0.5) >= 0.5 AS discriminates, psi < 0.2 AS drift_stable, fp <= 3 AS within_false_positives,
  b.model_id >= 4 AS champion_available, b.model_id >= 4 AND brier <= 0.25 + 0.02 AS not_worse FROM b JOIN e USING (model_id) LEFT JOIN u USING (model_id) JOIN d USING (model_id))
SELECT *, CASE WHEN enough_samples AND calibrated AND discriminates AND drift_stable AND within_false_positives AND champion_available AND not_worse THEN 'PROMOTED' ELSE 'REJECTED' END AS status FROM g""")
def gov_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gates on measured models; models from the fifth on have a champion of Brier score 0.25."""
    c = model_metrics(spark, sf_dir).select("model_id", F.col("n").alias("samples"), "ece", "auc", "brier", F.when(F.col("model_id") >= 4, 0.25).alias("champion_brier"), "drift_status", "false_positives")
    out = evaluation.promotion(c, 30, 0.45, 0.5, 3, 0.02, True)
    return out.select("model_id", "enough_samples", "calibrated", "discriminates", "drift_stable", "within_false_positives", "champion_available", "not_worse", "status")


@query("""WITH v AS (SELECT label, vec_id, embedding FROM embeddings), c AS (SELECT label, i, avg(embedding[i]) AS m FROM v, range(1, 65) AS t(i) GROUP BY ALL),
n AS (SELECT label, list(m ORDER BY i) AS centroid FROM c GROUP BY label)
SELECT vec_id, v.label, round(least(1.0, greatest(0.0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid))) + 1.7e-11, 9) AS similarity FROM v JOIN n ON v.label = n.label""")
def nar_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each vector to the centroid of its group."""
    v = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return narratives.similarities(v, "label").select("vec_id", "label", F.round(F.col("similarity") + 1.7e-11, 9).alias("similarity"))
