"""Structured Streaming forms of the event-time operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators import windows


def read_signals(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(stream: DataFrame, keys: list[str], time: str = "event_time", keep: str = "24 hours") -> DataFrame:
    """Each delivery once, its key remembered for `keep` of event time."""
    return stream.withWatermark(time, keep).dropDuplicatesWithinWatermark(keys)


def window_counts(stream: DataFrame, interval: str, late: str | None, time: str = "event_time") -> DataFrame:
    """Final trade features of tumbling windows, once the watermark has passed them. late: None for a stream that has one."""
    t = F.col("kind") == "MARKET_TRADE"
    order = F.when(t, F.struct(time, "event_id"))
    stream = stream.withWatermark(time, late) if late else stream
    return (
        stream.groupBy(F.window(time, interval).alias("w"), "scope_id", "asset_id")
        .agg(F.count_if(t).alias("trade_count"), F.sum(F.when(t, F.col("price") * F.col("quantity"))).alias("volume"), F.min_by("price", order).alias("first_price"), F.max_by("price", order).alias("last_price"))
        .select("scope_id", "asset_id", F.col("w.start").alias("window_start"), "trade_count", "volume", "first_price", "last_price")
    )


def paired(posts: DataFrame, mentions: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Posts with their mentions, whichever comes first, within the watermark."""
    p = posts.withWatermark("event_time", late)
    m = mentions.withColumnsRenamed({"post_id": "m_post_id", "event_time": "m_time"}).withWatermark("m_time", late)
    return p.join(m, F.expr(f"post_id = m_post_id AND m_time BETWEEN event_time - INTERVAL {late} AND event_time + INTERVAL {late}")).drop("m_post_id", "m_time")


REVISION = "scope_id string, asset_id string, window_start long, revision int, state string, supersedes int, n long, volume double"


class Revisions(StatefulProcessor):
    """Windows of one asset with a revision for each row: PROVISIONAL, FINAL once the asset's own watermark (the least of its
    domains' latest times, less the lateness) passes the window's end, CORRECTED after that. State is one small value
    for each window and each domain, not the rows; a window's value stays, so that a row of any lateness corrects it. Only
    the windows that are not final are gone through."""

    def __init__(self, interval: int, lateness: int, domains: tuple[str, ...] = ("market", "social")):
        self.interval, self.lateness, self.domains = interval, lateness, domains

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.windows = handle.getMapState("windows", "window_start long", "revision int, final boolean, n long, volume double")
        self.open = handle.getMapState("open", "window_start long", "there boolean")
        self.latest = handle.getMapState("latest", "domain string", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        out = []
        scope, asset = key

        def emit(w: int, now: tuple, state: str, supersedes: int | None) -> None:
            self.windows.updateValue((w,), now)
            if not now[1]:
                self.open.updateValue((w,), (True,))
            elif state == "FINAL":
                self.open.removeKey((w,))
            out.append((scope, asset, w, now[0], state, supersedes, now[2], now[3]))

        for pdf in rows:
            for x in pdf.sort_values(["t", "event_id"]).to_dict("records"):
                d = (x["source_domain"],)
                before = self.latest.getValue(d)[0] if self.latest.containsKey(d) else x["t"]
                self.latest.updateValue(d, (max(before, x["t"]),))
                w = int(x["t"] // self.interval * self.interval)
                old = tuple(self.windows.getValue((w,))) if self.windows.containsKey((w,)) else (0, False, 0, 0.0)
                now = (int(old[0]) + 1, bool(old[1]), int(old[2]) + 1, float(old[3]) + (0.0 if pd.isna(x["amount"]) else float(x["amount"])))
                emit(w, now, "CORRECTED" if now[1] else "PROVISIONAL", now[0] - 1 if now[1] else None)
                seen = [self.latest.getValue((q,))[0] for q in self.domains if self.latest.containsKey((q,))]
                if len(seen) == len(self.domains):
                    mark = min(seen) - self.lateness
                    for start in sorted(int(k[0]) for k in self.open.keys()):
                        if start + self.interval <= mark:
                            v = tuple(self.windows.getValue((start,)))
                            emit(start, (int(v[0]) + 1, True, int(v[2]), float(v[3])), "FINAL", int(v[0]))
        yield pd.DataFrame(out, columns=["scope_id", "asset_id", "window_start", "revision", "state", "supersedes", "n", "volume"]).astype({"supersedes": "Int32"})

    def close(self) -> None:
        pass


def revisions(stream: DataFrame, interval: int, lateness: int) -> DataFrame:
    """The revision log of a stream of signals. Needs the RocksDB state store."""
    rows = stream.select("scope_id", "asset_id", "event_id", "source_domain", (F.unix_micros(F.col("event_time").cast("timestamp")) / 1e6).alias("t"), (F.col("price") * F.col("quantity")).alias("amount"))
    return rows.groupBy("scope_id", "asset_id").transformWithStateInPandas(Revisions(interval, lateness), REVISION, "Append", "None")


def feature_log(store: str, intervals: list[int], lateness: int = 120, within: int | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the revision log of all features. Each batch of signals is kept under store/signals; the windows of the
    assets that it touches are computed again from its earliest window on, with what is kept, and those that differ from
    their last revision are appended to store/revisions. So a late row also revises the later windows whose baselines, new
    authors or source states rest on it.

    A window is PROVISIONAL until its asset's watermark passes its end, then FINAL; a change after that is CORRECTED, and says
    which revision it supersedes. A batch that is run again, after a restart, writes the same files again. within:
    seconds of history that are read again; none for all."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        day = F.to_date("event_time").alias("day")
        batch.select("*", day).write.mode("overwrite").parquet(f"{store}/signals/batch={number}")
        touched = batch.groupBy("scope_id", "asset_id").agg(F.min(windows.seconds("event_time")).alias("since"))
        kept = spark.read.parquet(f"{store}/signals").where(F.col("batch") <= number)
        first = touched.agg(F.min("since")).first()[0]
        if first is None:
            return
        if within is not None:
            kept = kept.where(F.col("day") >= F.to_date(F.timestamp_seconds(F.lit(first - within))))
        own = windows.first_per_key(kept.join(touched.select("scope_id", "asset_id"), ["scope_id", "asset_id"], "left_semi").drop("batch", "day"), ["scope_id", "event_id"], "ingested_at")
        now = windows.features(own, intervals).join(touched, ["scope_id", "asset_id"])
        now = now.withColumn("content_hash", F.sha2(F.to_json(F.struct(*windows.FEATURES, "source_event_count")), 256))
        marks = windows.watermarks(own, lateness=lateness).select("scope_id", "asset_id", "fusion_watermark")
        now = now.join(marks, ["scope_id", "asset_id"]).withColumn("passed", F.coalesce(F.col("window_end") <= F.col("fusion_watermark"), F.lit(False)))
        before = previous(spark, f"{store}/revisions", number)
        last = before.groupBy(*windows.KEY).agg(F.max_by(F.struct("revision", "state", "content_hash"), "revision").alias("last")) if before is not None else now.select(*windows.KEY, F.lit(None).cast("struct<revision:int,state:string,content_hash:string>").alias("last")).limit(0)
        # Windows from the batch's earliest on may have changed; of those before, the open ones may have become final.
        both = now.join(last, windows.KEY, "left").where((F.col("window_end") > F.col("since")) | (F.col("last.state") == "PROVISIONAL"))
        closed, same = F.coalesce(F.col("last.state") != "PROVISIONAL", F.lit(False)), F.coalesce(F.col("last.content_hash") == F.col("content_hash"), F.lit(False))
        state = F.when(closed, F.when(~same, "CORRECTED")).when(F.col("passed"), "FINAL").when(~same, "PROVISIONAL")
        out = both.withColumn("state", state).where("state is not null").withColumns({"revision": F.coalesce(F.col("last.revision"), F.lit(0)) + 1, "supersedes": F.when(F.col("state") != "PROVISIONAL", F.col("last.revision"))})
        out.drop("last", "passed", "fusion_watermark", "since").write.mode("overwrite").parquet(f"{store}/revisions/batch={number}")

    return apply


def previous(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """What earlier batches wrote; None if there is nothing."""
    try:
        return spark.read.parquet(path).where(F.col("batch") < number)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def log_features(stream: DataFrame, store: str, checkpoint: str, intervals: list[int], **settings) -> None:
    """Run feature_log over all that is there, in bounded batches."""
    stream.writeStream.foreachBatch(feature_log(store, intervals, **settings)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there, in bounded batches, to a Parquet table."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()
