"""A live feed of events with resume cursors: what is published is kept in a ring of the newest, and each subscriber gets what comes
after its cursor, once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Rows of the stream: an event that is published (event_id, body), or a subscriber that begins or resumes after a cursor (null: now).
ROWS = "feed string, event_id long, body string, subscriber string, cursor long"
OUT = "feed string, subscriber string, event_id long, kind string, body string"
RESET, EVENT = "stream.reset_required", "event"


def published(events: DataFrame, feed: Column, event_id: Column, body: Column) -> DataFrame:
    return events.select(feed.alias("feed"), event_id.cast("long").alias("event_id"), body.cast("string").alias("body"), F.lit(None).cast("string").alias("subscriber"), F.lit(None).cast("long").alias("cursor"))


def subscribed(subscribers: DataFrame, feed: Column, subscriber: Column, cursor: Column) -> DataFrame:
    return subscribers.select(feed.alias("feed"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("body"), subscriber.alias("subscriber"), cursor.cast("long").alias("cursor"))


class LiveFeed(StatefulProcessor):
    """One feed. Its newest `length` events lie in state under their ids, the subscribers' cursors beside them.

    Within a batch the events that are new come first, by id, then the subscriptions: so a result does not depend on the order of rows in
    a batch. An event whose id is not above the newest is a repeat and is passed over. A subscriber that has a cursor is sent what the batch
    brings. One that subscribes gets what is kept after its cursor; if its cursor is not 0 and lies before the oldest kept, a reset row
    with the oldest kept id instead, and then only what comes later. Of two subscriptions of one name in a batch the greater
    cursor counts (null: from now on, the greatest of all)."""

    def __init__(self, length: int):
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getMapState("ring", "place long", "event_id long, body string")
        self.cursors = handle.getMapState("cursors", "subscriber string", "event_id long")
        self.ends = handle.getValueState("ends", "newest long, first long, next long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        newest, first, after = self.ends.get() if self.ends.exists() else (0, 0, 0)
        new, asked = {}, {}
        for pdf in rows:
            for i, body, who, cursor in zip(pdf["event_id"], pdf["body"], pdf["subscriber"], pdf["cursor"], strict=True):
                if isinstance(who, str):
                    asked[who] = max(asked.get(who, -1), 1 << 62 if pd.isna(cursor) else int(cursor))
                elif not pd.isna(i) and int(i) > newest:
                    body = body if isinstance(body, str) else None
                    # Of two events with one id in a batch the least body counts, so that order does not matter.
                    if int(i) not in new or (body is not None and (new[int(i)] is None or body < new[int(i)])):
                        new[int(i)] = body
        fresh = sorted(new.items())
        for item in fresh:
            self.ring.updateValue((after,), item)
            after += 1
            if after - first > self.length:
                self.ring.removeKey((first,))
                first += 1
        newest = fresh[-1][0] if fresh else newest
        self.ends.update((newest, first, after))
        out = []
        if fresh:
            for (who,), (seen,) in list(self.cursors.iterator()):
                if who not in asked:
                    out += [(who, i, EVENT, body) for i, body in fresh if i > seen]
                    self.cursors.updateValue((who,), (max(seen, newest),))
        if asked:
            kept = [tuple(self.ring.getValue((p,))) for p in range(first, after)]
            for who, cursor in sorted(asked.items()):
                if cursor and kept and cursor < kept[0][0]:
                    out.append((who, kept[0][0], RESET, None))
                else:
                    out += [(who, i, EVENT, body) for i, body in kept if i > cursor]
                self.cursors.updateValue((who,), (newest,))
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=["feed", "subscriber", "event_id", "kind", "body"]).astype({"body": object})

    def close(self) -> None:
        pass


#: Parts of a feed that are cut to the newest by themselves.
PARTS = 64


def newest(rows: DataFrame, length: int) -> DataFrame:
    """Rows of one batch on feeds that nothing was sent of yet: of each feed's events the newest `length` ids, each once with its least body, and
    all subscriptions. A ring keeps no others, and no subscriber is there yet whom others would be sent to. A feed is cut in parts first."""
    own = rows.where("subscriber is null and event_id is not null").groupBy("feed", "event_id").agg(F.min("body").alias("body"))
    own = own.withColumn("__part", F.pmod(F.xxhash64("event_id"), F.lit(PARTS)))
    for keys in (["feed", "__part"], ["feed"]):
        own = own.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("event_id")))).where(F.col("__r") <= length)
    none = rows.schema["subscriber"].dataType
    events = own.select("feed", "event_id", "body", F.lit(None).cast(none).alias("subscriber"), F.lit(None).cast("long").alias("cursor"))
    return events.unionByName(rows.where("subscriber is not null").select("feed", "event_id", "body", "subscriber", "cursor"))


def live_feed(rows: DataFrame, length: int = 10_000) -> DataFrame:
    """rows: published and subscribed rows together, as a stream or a table (then they are one batch). What each subscriber is sent: feed,
    subscriber, event_id, kind (event or reset), body. Feeds are spread over tasks by their name; a feed's state is its ring and a
    cursor for each subscriber. A restarted stream goes on from its checkpoint and sends nothing twice. Needs the RocksDB state store.
    A table's older events, which no ring would keep, are left out before a feed's rows come together."""
    if not rows.isStreaming:
        rows = newest(rows, length)
    rows.sparkSession.streams.active  # noqa: B018  a table has no stream that would start what looks after the state stores
    return rows.groupBy("feed").transformWithStateInPandas(LiveFeed(length), OUT, "Append", "None")
