"""Windows scored again whenever one of their inputs arrives: features, graph, verification and threat context.

Each input is a part: a row of a window with a revision and the id of its snapshot. What counts of a part is its greatest
(revision, snapshot_id), so the order of arrival decides which scores are made on the way, and never the last one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions.exprs import canonical_hash, uuid5
from tidewatch.operators import scoring, windows

KEY = windows.KEY
#: The parts and the columns that fusion reads of each.
PARTS = {
    "FEATURES": [*(f"{n} double" for n in windows.FEATURES)],
    "GRAPH": ["graph_score double"],
    "VERIFICATION": ["claim_risk double", "legitimate_event_score double"],
    "THREAT": ["threat_status string", "threat_score double", "threat_confidence double"],
}
NAMES = {p: [c.split()[0] for c in columns] for p, columns in PARTS.items()}
INPUTS = "version int, outcome string, " + ", ".join(f"{p.lower()}_revision int, {p.lower()}_id string, {p.lower()} string" for p in PARTS)


def part(rows: DataFrame, name: str, revision: Column | None = None, snapshot_id: Column | None = None, at: Column | None = None) -> DataFrame:
    """rows: KEY and the part's columns, as its row of the stream; of features, those that are final or corrected. Without an id
    of its own a snapshot is known by its content."""
    if name == "FEATURES" and "revision_state" in rows.columns:
        rows = rows.where(F.col("revision_state").isin("FINAL", "CORRECTED"))
    body = F.to_json(F.struct(*(F.expr(f"cast({c.split()[0]} as {c.split()[1]})").alias(c.split()[0]) for c in PARTS[name])))
    revision = F.lit(1) if revision is None else revision
    return rows.select(*KEY, F.lit(name).alias("part"), revision.cast("int").alias("revision"), (F.sha2(body, 256) if snapshot_id is None else snapshot_id).alias("snapshot_id"), body.alias("body"), (F.timestamp_seconds(F.col("window_start") + F.col("interval_seconds")) if at is None else at).alias("event_time"))


def latest_inputs(parts: DataFrame) -> DataFrame:
    """The inputs of each window that has features, by now: of all that there is, in one aggregation without lists."""
    own = lambda p: F.max(F.when(F.col("part") == p, F.struct("revision", "snapshot_id", "body"))).alias(p)
    rows = parts.groupBy(*KEY).agg(*(own(p) for p in PARTS)).where(F.col("FEATURES").isNotNull())
    each = [c for p in PARTS for c in (F.col(f"{p}.revision").alias(f"{p.lower()}_revision"), F.col(f"{p}.snapshot_id").alias(f"{p.lower()}_id"), F.col(f"{p}.body").alias(p.lower()))]
    return rows.select(*KEY, *each)


def scores(inputs: DataFrame, calibration: tuple[float, float] | None = None, policy: str = "fusion-v1") -> DataFrame:
    """inputs: rows of latest_inputs, or of the stream's processor. Each fused, with the idempotency key of what it was made of (window,
    revision, profile, snapshots, policy) and the score's id."""
    rows = inputs.where(F.col("features").isNotNull())
    for p, columns in PARTS.items():
        rows = rows.withColumn(p.lower(), F.from_json(p.lower(), ", ".join(columns)))
    rows = rows.select("*", *(F.col(f"{p.lower()}.{n}").alias(n) for p in PARTS for n in NAMES[p])).drop(*(p.lower() for p in PARTS))
    fused = scoring.fuse(scoring.detect(rows), calibration)
    fields = {c: F.col(c) for c in (*KEY, "enrichment_profile")} | {f"{p.lower()}_id": F.col(f"{p.lower()}_id") for p in PARTS} | {"feature_revision": F.col("features_revision"), "fusion_policy_version": F.lit(policy)}
    keyed = fused.withColumn("idempotency_key", canonical_hash(fields))
    return keyed.withColumn("model_score_id", uuid5(F.concat(F.lit("model-score:"), F.col("idempotency_key"))))


class Rescoring(StatefulProcessor):
    """One window's parts. Whenever those that count change and there are features, it puts them out once, under the next version.
    State is one row for each part. It is given up `keep` after the latest part's time (by the watermark), with a row that says
    so if no features ever came."""

    def __init__(self, keep_seconds: int):
        self.keep = keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "part string", "revision int, snapshot_id string, body string")
        self.last = handle.getValueState("last", "version int, until long")

    def row(self, key: tuple, version: int, outcome: str) -> pd.DataFrame:
        held = [tuple(self.parts.getValue((p,))) if self.parts.containsKey((p,)) else (None, None, None) for p in PARTS]
        names = [*KEY, *(c.split()[0] for c in INPUTS.split(", "))]
        kinds = {n: "Int32" for n in names if n.endswith("_revision") or n == "version"}
        return pd.DataFrame([(*key, version, outcome, *(x for h in held for x in h))], columns=names).astype(kinds)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        version, until = self.last.get() if self.last.exists() else (0, 0)
        changed, before = False, until
        for pdf in rows:
            for p, revision, snapshot, body, t in zip(pdf["part"], pdf["revision"], pdf["snapshot_id"], pdf["body"], pdf["event_time"], strict=True):
                until = max(until, int(t.timestamp() * 1000) + self.keep)
                held = tuple(self.parts.getValue((p,)))[:2] if self.parts.containsKey((p,)) else None
                if held is None or (int(revision), snapshot) > held:
                    self.parts.updateValue((p,), (int(revision), snapshot, body))
                    changed = True
        if until != before:
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(until)
        scored = changed and self.parts.containsKey(("FEATURES",))
        self.last.update((version + int(scored), until))
        if scored:
            yield self.row(key, version + 1, "SCORED")

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[pd.DataFrame]:
        if not self.parts.containsKey(("FEATURES",)):
            yield self.row(key, 0, "GIVEN_UP")
        self.parts.clear()
        self.last.clear()

    def close(self) -> None:
        pass


def rescored(parts: DataFrame, keep_seconds: int = 86_400, late: str = "1 hour", calibration: tuple[float, float] | None = None) -> DataFrame:
    """parts: the stream of all parts. A score for each change of a window's inputs; that of the greatest version is the one that
    the batch form gives. Needs the RocksDB state store."""
    kinds = ", ".join(f"{k} {t}" for k, t in zip(KEY, ("string", "string", "int", "long"), strict=True))
    stream = parts.withWatermark("event_time", late).groupBy(*KEY)
    return scores(stream.transformWithStateInPandas(Rescoring(keep_seconds), f"{kinds}, {INPUTS}", "Append", "EventTime"), calibration)
