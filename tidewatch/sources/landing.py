"""Readers of landing files: envelopes, exchange and timeline payloads, feeds, filings; and writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.exprs import unescaped, uuid5

ENVELOPE = (
    "event_id string, origin_event_id string, delivery_event_id string, event_type string, schema_version int, source string, source_event_id string, source_sequence long, asset_id string, "
    "event_time timestamp, ingested_at timestamp, processed_at timestamp, partition_key string, replay struct<is_replay:boolean,replay_session_id:string>, trace struct<correlation_id:string,causation_id:string>, payload string"
)


def read_log(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int = 50) -> DataFrame:
    """JSON lines of envelopes, as a table or as a stream of bounded batches; broken lines have only _corrupt_record."""
    schema = f"{ENVELOPE}, _corrupt_record string"
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if stream else spark.read
    return reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_kafka(spark: SparkSession, servers: str, topics: list[str], per_trigger: int = 100_000) -> DataFrame:
    """The event log's topics as a stream of envelopes: from the earliest offset, committed records only."""
    raw = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": "earliest", "kafka.isolation.level": "read_committed", "maxOffsetsPerTrigger": str(per_trigger)}).load()
    return raw.select("topic", "partition", "offset", F.from_json(F.col("value").cast("string"), ENVELOPE).alias("e")).select("topic", "partition", "offset", "e.*")


def validated(events: DataFrame) -> DataFrame:
    """Adds errors, the codes of the rules that an envelope breaks, and the default origin."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    rules = [*((f"BLANK_{c.upper()}", blank(c)) for c in ("partition_key", "source", "source_event_id")), ("SCHEMA_VERSION", F.coalesce(F.col("schema_version"), F.lit(0)) < 1), ("REPLAY_WITHOUT_SESSION", F.coalesce(F.col("replay.is_replay"), F.lit(False)) & F.col("replay.replay_session_id").isNull()), ("DELIVERY_ID", ~F.col("event_id").eqNullSafe(F.col("delivery_event_id")))]
    return events.withColumn("errors", F.array_compact(F.array(*(F.when(test, F.lit(k)) for k, test in rules)))).withColumn("origin_event_id", F.coalesce("origin_event_id", F.concat_ws(":", "source", "source_event_id")))


def replayed(history: DataFrame, session: str, order: list[str], key: str = "source") -> DataFrame:
    """A history as a replay session: its scope, ingestion at event time, and each source's sequence where it has none."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return history.withColumns({"scope_id": F.lit(session), "ingested_at": F.col("event_time"), "source_sequence": F.coalesce(F.col("source_sequence"), place.cast("long"))})


def exchange_trades(raw: DataFrame, body: str = "body") -> DataFrame:
    """Arrays of trades (id, price, qty, time in ms, isBuyerMaker) as rows; a buyer who is the maker was sold to."""
    t = F.explode(F.from_json(F.col(body), "array<struct<id:long,price:string,qty:string,time:long,isBuyerMaker:boolean>>"))
    return raw.select("asset_id", t.alias("t")).select("asset_id", F.col("t.id").alias("trade_id"), F.timestamp_millis("t.time").alias("event_time"), F.col("t.price").cast("double").alias("price"), F.col("t.qty").cast("double").alias("quantity"), F.when(F.col("t.isBuyerMaker"), "SELL").otherwise("BUY").alias("side"))


def book(rows: DataFrame, levels: int = 5) -> DataFrame:
    """Adds depth of the first levels per side (the given depth where that is 0) and spread."""
    side = lambda c: F.aggregate(F.slice(F.coalesce(F.col(c), F.expr("cast(array() as array<struct<price:double,qty:double>>)")), 1, levels), F.lit(0.0), lambda s, x: s + x.qty)
    depth = lambda c, given: F.when(side(c) != 0, side(c)).otherwise(F.col(given))
    return rows.withColumns({"bid_depth": depth("bids", "top_bid_depth"), "ask_depth": depth("asks", "top_ask_depth"), "spread": F.col("best_ask") - F.col("best_bid")})


def plain_text(markup: Column) -> Column:
    """Markup as text: tags to spaces, character references decoded, white space to one space."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(markup, r"(?s)<[^>]*>", " ")), r"(?U)\s+", " "))


def feed_items(raw: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """RSS bodies as rows: id (a hash of url and guid), published, title and text."""
    item = "struct<title:string,description:string,link:string,guid:string,pubDate:string>"
    items = raw.select(url, F.explode(F.from_xml(F.col(body), F.lit(f"channel struct<item:array<{item}>>")).getField("channel").getField("item")).alias("i"))
    guid = F.coalesce("i.guid", "i.link", "i.title")
    when = F.try_to_timestamp(F.regexp_replace("i.pubDate", r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return items.select(F.sha2(F.concat_ws(":", url, guid), 256).alias("source_post_id"), when.alias("event_time"), F.col("i.title").alias("title"), plain_text(F.concat_ws(" ", "i.title", "i.description", "i.link")).alias("text")).dropDuplicates(["source_post_id"])


def candles(raw: DataFrame, body: str = "body", interval: int = 60, closed: bool = True) -> DataFrame:
    """Arrays of candles (arrays of open time in ms, open, high, low, close, volume and more) as rows. The last of an array is still
    open, and left out where only closed ones are wanted."""
    all_ = F.from_json(F.col(body), "array<array<string>>")
    c = F.explode(F.slice(all_, 1, F.greatest(F.size(all_) - 1, F.lit(0))) if closed else all_)
    number = lambda i: F.get("c", F.lit(i)).cast("double")
    return raw.select("asset_id", c.alias("c")).select("asset_id", F.timestamp_millis(F.get("c", F.lit(0)).cast("long")).alias("event_time"), F.lit(interval).alias("interval_seconds"), *(number(i + 1).alias(k) for i, k in enumerate(("open", "high", "low", "close", "volume"))))


def unseen(rows: DataFrame, key: str, number: str, seen: DataFrame) -> DataFrame:
    """Rows whose number is above the last one seen of their key (seen: key, last): what a poll fetched anew."""
    return rows.join(seen.select(key, "last"), key, "left").where(F.col("last").isNull() | (F.col(number) > F.col("last"))).drop("last")


def timeline_posts(raw: DataFrame, body: str = "body", platform: str = "mastodon") -> DataFrame:
    """Public timelines (JSON arrays of statuses) as posts, each id once: text without markup, what a post answers or repeats,
    and its engagement; source_sequence numbers them by id."""
    status = "struct<id:string,created_at:string,content:string,language:string,in_reply_to_id:string,account:struct<id:string>,reblog:struct<id:string>,reblogs_count:long,favourites_count:long,replies_count:long>"
    s = raw.select(F.explode(F.from_json(F.col(body), f"array<{status}>")).alias("s")).select("s.*").where("id is not null")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    posts = s.select(
        F.col("id").alias("source_post_id"), F.lit(platform).alias("platform"), F.col("account.id").alias("raw_author_id"), F.try_to_timestamp("created_at").alias("event_time"), plain_text(F.coalesce("content", F.lit(""))).alias("text"), "language",
        F.col("in_reply_to_id").alias("reply_to"), F.col("reblog.id").alias("repost_of"), F.create_map(F.lit("reblogs"), n("reblogs_count"), F.lit("favourites"), n("favourites_count"), F.lit("replies"), n("replies_count")).alias("engagement"),
    ).dropDuplicates(["source_post_id"])
    return posts.withColumn("source_sequence", F.col("source_post_id").cast("long"))


def _first(*values: Column) -> Column:
    """The first that is there and not empty."""
    return F.coalesce(*(F.when(F.trim(v) != "", F.trim(v)) for v in values))


def _when(*texts: Column) -> Column:
    """The first date there is, as mail or as ISO 8601 writes it."""
    text = _first(*texts)
    mail = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\b(GMT|UTC|Z)$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.when(text.contains(","), mail).otherwise(F.try_to_timestamp(text))


def feed_documents(raw: DataFrame, body: str = "body", retrieved: str = "retrieved_at") -> DataFrame:
    """RSS and Atom bodies as disclosures: source_key, title, body, url, published_at, retrieved_at. The key is the guid, else
    the id, the link, or a hash of the entry; the text is the description, the content, the summary or the title; a
    date that can't be read is when the feed was retrieved."""
    item = "struct<title:string,description:string,content:string,summary:string,link:string,guid:string,id:string,pubDate:string,published:string,updated:string>"
    entry = "struct<title:string,content:string,summary:string,id:string,link:struct<_href:string,_VALUE:string>,published:string,updated:string>"
    own = [c for c in raw.columns if c not in (body,)]
    rss = raw.select(*own, F.explode(F.from_xml(F.col(body), F.lit(f"channel struct<item:array<{item}>>"))["channel"]["item"]).alias("i")).select(*own, "i.*")
    atom = raw.select(*own, F.explode(F.from_xml(F.col(body), F.lit(f"entry array<{entry}>"))["entry"]).alias("i")).select(*own, "i.*")
    atom = atom.select(*own, "title", F.lit(None).cast("string").alias("description"), "content", "summary", F.coalesce("link._href", "link._VALUE").alias("link"), F.lit(None).cast("string").alias("guid"), "id", F.lit(None).cast("string").alias("pubDate"), "published", "updated")
    e = rss.select(*atom.columns).unionByName(atom)
    c = F.col
    title = F.coalesce(_first(c("title")), F.lit("Untitled official disclosure"))
    key = _first(c("guid"), c("id"), c("link"), F.sha2(F.to_json(F.struct("title", "description", "content", "summary", "pubDate", "published", "updated")), 256))
    return e.select(*own, key.alias("source_key"), title.alias("title"), plain_text(_first(c("description"), c("content"), c("summary"), title)).alias("body"), c("link").alias("url"), F.coalesce(_when(c("pubDate"), c("published"), c("updated")), c(retrieved)).alias("published_at"))


def release_documents(raw: DataFrame, body: str = "body", retrieved: str = "retrieved_at") -> DataFrame:
    """JSON arrays of releases as disclosures; those with neither an id nor a tag are left out."""
    r = "struct<id:string,tag_name:string,name:string,body:string,html_url:string,published_at:string,created_at:string>"
    own = [c for c in raw.columns if c != body]
    e = raw.select(*own, F.explode(F.from_json(F.col(body), f"array<{r}>")).alias("r"))
    c = lambda n: F.col(f"r.{n}")
    rows = e.withColumn("source_key", _first(c("id"), c("tag_name"))).where("source_key is not null")
    return rows.select(*own, "source_key", F.coalesce(_first(c("name"), c("tag_name")), F.lit("GitHub release")).alias("title"), F.coalesce(_first(c("body"), c("name"), c("tag_name")), F.lit("")).alias("body"), c("html_url").alias("url"), F.coalesce(_when(c("published_at"), c("created_at")), F.col(retrieved)).alias("published_at"))


def disclosures(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Disclosure events as documents: ids, times and the content hash default to what the envelope has, in this order:
    the payload's own, its links, the event's."""
    fields = "disclosure_id string, document_id string, url string, title string, text string, body string, published_at string, retrieved_at string, available_at string, first_observed_at string, content_hash string, reliability double, logical_source_key string"
    p = events.withColumn("p", F.from_json(F.col(payload), fields))
    c = lambda n: F.col(f"p.{n}")
    time = lambda n: F.try_to_timestamp(c(n))
    document = _first(c("document_id"), c("url"), F.col("source_event_id"), F.col("event_id"))
    text = F.coalesce(_first(c("body"), c("text"), c("title")), F.lit(""))
    retrieved = F.coalesce(time("retrieved_at"), F.col("ingested_at"))
    return p.select(
        F.coalesce(_first(c("disclosure_id")), uuid5(F.concat_ws(":", F.lit("disclosure"), "source", document))).alias("disclosure_id"), "source", document.alias("source_document_id"), "asset_id",
        _first(c("logical_source_key"), F.col("source")).alias("logical_source_key"), F.coalesce(_first(c("title")), F.lit("Untitled disclosure")).alias("title"), text.alias("body"), F.coalesce(time("published_at"), F.col("event_time")).alias("published_at"),
        retrieved.alias("retrieved_at"), F.coalesce(time("first_observed_at"), retrieved).alias("first_observed_at"), F.coalesce(time("available_at"), retrieved).alias("available_at"),
        F.coalesce(_first(c("content_hash")), F.sha2(text, 256)).alias("content_hash"), F.coalesce(c("reliability"), F.lit(0.5)).alias("reliability"),
    )


def child_tables(events: DataFrame, mentions: DataFrame) -> dict[str, DataFrame]:
    """What is kept of social events: the raw log (a row for each delivery), the posts (each once), and a row for each mention of
    a post that was taken, numbered by its place."""
    posts = events.dropDuplicates(["post_id"])
    rows = mentions.join(posts.select("post_id"), "post_id", "left_semi")
    numbered = rows.withColumn("mention_no", F.row_number().over(Window.partitionBy("post_id").orderBy("start", "stop")))
    return {"log": events.select("event_id", "source", "event_time", "ingested_at"), "posts": posts.select("post_id", "author_id", "event_time", "text"), "mentions": numbered}


def book_features(rows: DataFrame, levels: int = 5, broken: str = "gap") -> DataFrame:
    """Order books as feature rows: spread, depth and imbalance of the first levels, all null where the book is broken."""
    b = book(rows, levels)
    ok = ~F.coalesce(F.col(broken), F.lit(False)) & (F.col("spread") >= 0)
    depth = F.col("bid_depth") + F.col("ask_depth")
    value = lambda c: F.when(ok, c)
    return b.select(*(c for c in rows.columns if c not in ("bids", "asks", "spread")), F.coalesce(ok, F.lit(False)).alias("book_valid"), value(F.col("spread")).alias("spread"), value(depth).alias("top_n_depth"), value(F.when(depth > 0, (F.col("bid_depth") - F.col("ask_depth")) / depth).otherwise(0.0)).alias("imbalance"))


def filings(raw: DataFrame, seen: DataFrame, per_run: int = 100) -> DataFrame:
    """Filing indexes of parallel arrays as rows, without those seen, the first per_run of each company."""
    cols = ["accession", "form", "filed"]
    rows = raw.select("company", F.posexplode(F.arrays_zip(*cols)).alias("n", "f")).select("company", "n", "f.*").join(seen.select("company", "accession"), ["company", "accession"], "left_anti")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("company").orderBy("n"))).where(F.col("place") <= min(1000, max(1, per_run))).drop("place")


def seen_filings(new: DataFrame, seen: DataFrame, most: int = 5000) -> DataFrame:
    """The keys that were seen after a run: of each company (accession, place) the newest `most`, those of the run first and in its order
    (n), then the ones seen before in theirs (place); a key that comes again counts as new."""
    both = new.select("company", "accession", F.lit(0).alias("old"), F.col("n").cast("long").alias("at")).unionByName(seen.select("company", "accession", F.lit(1).alias("old"), F.col("place").cast("long").alias("at")))
    once = both.groupBy("company", "accession").agg(F.min(F.struct("old", "at")).alias("o"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("company").orderBy("o", "accession"))).where(F.col("place") <= most).drop("o")


def pulses(raw: DataFrame, body: str = "body") -> DataFrame:
    """Threat pulses as indicator rows. A malformed pulse, and a malformed indicator of a sound one, is a row with broken =
    true of its own; the others of its pulse are not touched."""
    p = F.from_json(F.col(body), "id string, modified string, indicators array<string>")
    rows = raw.withColumn("p", p).withColumn("lost", F.col("p.id").isNull() | F.col("p.indicators").isNull())
    each = rows.select("lost", F.col("p.id").alias("pulse_id"), F.try_to_timestamp("p.modified").alias("modified"), F.explode_outer("p.indicators").alias("j"))
    each = each.withColumn("i", F.from_json("j", "type string, indicator string, description string"))
    return each.select((F.col("lost") | (F.col("j").isNotNull() & (F.col("i.type").isNull() | F.col("i.indicator").isNull()))).alias("broken"), "pulse_id", "modified", "i.*")


def archive(events: DataFrame, path: str) -> None:
    """Append what the archive hasn't yet, as zstd Parquet by stream, date and source. Of the archive only the dates of the
    batch are read, so a batch costs what its own days hold."""
    spark = events.sparkSession
    new = events.dropDuplicates(["event_id"]).withColumn("date", F.to_date("event_time"))
    try:
        days = [r[0] for r in new.select("date").distinct().collect()]  # a batch is of few days
        new = new.join(spark.read.parquet(path).where(F.col("date").isin(days)).select("event_id"), "event_id", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").option("compression", "zstd").partitionBy("stream", "date", "source").parquet(path)


def keep_latest(batch: DataFrame, path: str, keys: list[str], version: str) -> DataFrame:
    """The rows of a stored table and a batch with the highest version of each key (of equal ones the stored)."""
    rest = [c for c in batch.columns if c not in keys]
    try:
        old = batch.sparkSession.read.parquet(path).select(*batch.columns).withColumn("__old", F.lit(1))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = batch.limit(0).withColumn("__old", F.lit(1))
    both = old.unionByName(batch.withColumn("__old", F.lit(0)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "__old")).alias("r")).select(*keys, "r.*")


def publish(events: DataFrame, servers: str, topic: Callable[[DataFrame], Column], checkpoint: str):
    """Write a stream of envelopes to Kafka, keyed by partition_key."""
    out = events.select(topic(events).alias("topic"), F.col("partition_key").alias("key"), F.to_json(F.struct(*events.columns)).alias("value"))
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("checkpointLocation", checkpoint).start()
