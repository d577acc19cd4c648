"""Campaign sessions, stages, and alerts with cool-down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.exprs import level_of, rank_of
from tidewatch.operators import scans

STAGES = ("NORMAL", "EARLY_SOCIAL_SEEDING", "COORDINATED_AMPLIFICATION", "MARKET_PUMP", "POSSIBLE_DISTRIBUTION", "DUMP", "POST_EVENT")


def sessions(evidence: DataFrame, gap: int = 1800, keys: tuple[str, ...] = ("asset_id",), order: tuple[str, ...] = ("epoch", "evidence_id")) -> DataFrame:
    """Adds session: how many larger gaps than `gap` seconds lie between a key's rows up to this one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    opens = F.col(order[0]) - F.lag(order[0]).over(w) > gap
    return evidence.withColumn("session", F.sum(F.coalesce(opens, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def roll_up(evidence: DataFrame, gap: int = 1800) -> DataFrame:
    """A row for each session: first and last evidence, versions, greatest severity, latest status."""
    return sessions(evidence, gap).groupBy("asset_id", "session").agg(
        F.min("epoch").alias("first_evidence"), F.max("epoch").alias("last_evidence"), F.count(F.lit(1)).alias("versions"),
        level_of(F.max(rank_of(F.col("severity")))).alias("max_severity"), F.max_by("status", F.struct("epoch", "evidence_id")).alias("current_status"),
    )


def stale_evidence(evidence: DataFrame, order: list[str]) -> DataFrame:
    """Marks rows whose order is not above all that arrived before (arrival order: column arrival)."""
    w = Window.partitionBy("asset_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    own = F.struct(*order)
    return evidence.withColumn("stale", F.coalesce(own <= F.max(own).over(w), F.lit(False)))


def stage_rules() -> dict[str, list[tuple[Column, str]]]:
    """What evidence makes of each stage: the first rule that holds; none of them, and the stage stays. Columns: severity, social,
    coordination, market, price_return and pressure."""
    c = F.col
    calm = c("severity") == "NORMAL"
    pump = (c("market") >= 0.60) & c("severity").isin("HIGH", "CRITICAL")
    quiet = calm & (c("social") < 0.20)
    falls = c("price_return") <= -0.08
    return {
        "NORMAL": [(c("social") >= 0.35, "EARLY_SOCIAL_SEEDING")],
        "EARLY_SOCIAL_SEEDING": [(pump, "MARKET_PUMP"), (c("coordination") >= 0.55, "COORDINATED_AMPLIFICATION"), (quiet, "NORMAL")],
        "COORDINATED_AMPLIFICATION": [(falls, "DUMP"), (pump, "MARKET_PUMP"), (quiet, "POST_EVENT")],
        "MARKET_PUMP": [(falls, "DUMP"), ((c("pressure") <= -0.25) | (c("price_return") < -0.02), "POSSIBLE_DISTRIBUTION")],
        "POSSIBLE_DISTRIBUTION": [(falls | (c("pressure") <= -0.50), "DUMP"), (calm, "POST_EVENT")],
        "DUMP": [(calm, "POST_EVENT")],
        "POST_EVENT": [],
    }


def assessed(rows: DataFrame) -> DataFrame:
    """rows: stage and the evidence it was reached by (fusion_score, confidence, social, coordination, market, price_return,
    relative_volume, pressure). Adds stage_confidence and reason_codes."""
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    stage = F.col("stage")
    confidence = (
        F.when(stage == "NORMAL", F.greatest(F.lit(0.0), 1 - z("fusion_score"))).when(stage == "EARLY_SOCIAL_SEEDING", z("social")).when(stage == "COORDINATED_AMPLIFICATION", F.greatest(z("social"), z("coordination")))
        .when(stage.isin("MARKET_PUMP", "POSSIBLE_DISTRIBUTION", "DUMP"), F.greatest(z("market"), z("confidence"))).otherwise(z("confidence"))
    )
    codes = [("ABNORMAL_RETURN", z("price_return") >= 0.08), ("PUBLIC_DATA_PROXY_ONLY", stage == "POSSIBLE_DISTRIBUTION"), ("RELATIVE_VOLUME", z("relative_volume") >= 2.5), ("SELL_PRESSURE_PROXY", z("pressure") <= -0.25), ("SOCIAL_COORDINATION", z("social") >= 0.35)]
    return rows.withColumns({"stage_confidence": confidence, "reason_codes": F.array_compact(F.array(*(F.when(test, F.lit(k)) for k, test in codes)))})


def stage_events(steps: DataFrame) -> DataFrame:
    """steps: asset_id, session, epoch, version, stage, changed. The history rows of campaigns: created with a session's first row,
    stage_changed where the stage changes, and closed at the last row of a session that another one follows."""
    row = Window.partitionBy("asset_id").orderBy("session", "version")
    steps = steps.withColumn("__ends", F.coalesce(F.lead("session").over(row) != F.col("session"), F.lit(False)))
    kinds = F.array_compact(F.array(F.when(F.col("version") == 1, F.lit("created")), F.when(F.col("changed"), F.lit("stage_changed")), F.when(F.col("__ends"), F.lit("closed"))))
    return steps.withColumn("event", F.explode(kinds)).select("asset_id", "session", "epoch", "version", "stage", "event")


def stages(evidence: DataFrame, gap: int = 1800) -> DataFrame:
    """evidence: asset_id, epoch, severity, social, coordination, market, price_return, pressure, of one row for each epoch. The
    stage after each row of a campaign, in order; a new session begins at NORMAL. Each row is a map of stages to stages (that of a
    session's first row leads from all of them to what follows NORMAL), and an asset's rows are composed by many tasks."""
    keys, order = ["asset_id"], ["epoch"]
    cols = ["asset_id", "epoch", "severity", "social", "coordination", "market", "price_return", "pressure"]
    rows = scans.prefixed(scans.in_ranges(evidence.select(cols), keys, order), keys, order, most_before={"previous": F.col("epoch")}, sums={"number": F.lit(1)})
    rows = rows.withColumn("opens", F.coalesce(F.col("epoch") - F.col("previous") > gap, F.lit(False)))
    first = F.col("opens") | (F.col("number") == 1)
    rows = scans.prefixed(rows, keys, order, sums={"session": F.col("opens").cast("int")}, most={"began": F.when(first, F.col("number"))})

    def after(stage: str) -> Column:
        out = F.lit(STAGES.index(stage))
        for test, to in reversed(stage_rules()[stage]):
            out = F.when(test, STAGES.index(to)).otherwise(out)
        return out

    fresh = after("NORMAL")
    maps = F.array(*(F.when(first, fresh).otherwise(after(s)) for s in STAGES))
    out = scans.states(rows, keys, order, maps, len(STAGES))
    name = F.element_at(F.array(*(F.lit(s) for s in STAGES)), F.col("state") + 1)
    changed = F.col("state") != F.when(first, 0).otherwise(F.col("state_before"))
    return out.select("asset_id", F.col("session").cast("long").alias("session"), F.col("epoch").cast("long").alias("epoch"), (F.col("number") - F.col("began") + 1).cast("int").alias("version"), name.alias("stage"), changed.alias("changed"))


def alert_state(alerts: DataFrame) -> DataFrame:
    """alerts: asset_id, alert_type, epoch, alert_severity. Adds occurrence, the running greatest severity, and the event:
    created, severity_changed or refreshed."""
    w = Window.partitionBy("asset_id", "alert_type").orderBy("epoch")
    top = F.max(rank_of(F.col("alert_severity"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = alerts.withColumns({"occurrence": F.row_number().over(w), "top": top})
    df = df.withColumn("before", F.lag("top").over(w))
    event = F.when(F.col("before").isNull(), "created").when(F.col("top") > F.col("before"), "severity_changed").otherwise("refreshed")
    return df.select("asset_id", "alert_type", "epoch", "occurrence", level_of(F.col("top")).alias("max_severity"), event.alias("event"))


def notified(states: DataFrame, cooldown: int = 300) -> DataFrame:
    """states: rows of alert_state. Adds suppressed: a refreshed alert under `cooldown` seconds after the last notified one of its
    kind, and reason, COOLDOWN for those.

    An alert that is not a refresh, or comes `cooldown` or more after the one before it, is notified whatever went before: it
    begins a run. Within a run the next notified one is the first that is far enough from the last, so the notified ones
    are those reached from the run's first along these pointers."""
    keys = ["asset_id", "alert_type"]
    in_order = Window.partitionBy(*keys).orderBy("occurrence")
    begins = (F.col("event") != "refreshed") | F.coalesce(F.col("epoch") - F.lag("epoch").over(in_order) >= cooldown, F.lit(True))
    rows = states.withColumn("begins", begins).withColumn("run", F.sum(F.col("begins").cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    # Gaps within a run are under `cooldown`, so the first row from there on is under twice that away.
    on = Window.partitionBy(*keys, "run").orderBy("epoch").rangeBetween(cooldown, 2 * cooldown)
    rows = rows.withColumn("following", F.min("occurrence").over(on))
    sent = scans.orbit(rows, [*keys, "run"], "occurrence", "following", F.col("begins")).drop("run").withColumn("sent", F.lit(True))
    quiet = F.col("sent").isNull()
    return states.join(sent, [*keys, "occurrence"], "left").withColumns({"suppressed": quiet, "reason": F.when(quiet, "COOLDOWN")}).drop("sent")
