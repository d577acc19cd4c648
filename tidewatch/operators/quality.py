"""Source quality: gaps, staleness, order-book validity, idleness, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import scans

KEY = ["source", "asset_id"]


def observe(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: source, asset_id, arrival (order), epoch, ingested_epoch, sequence, is_orderbook. Adds what is known of the
    source after each row: gap_count, out_of_order_count, gap_detected, age, orderbook_state, book_valid, status.

    The order-book machine in closed form: with k the number of book rows since the last stale or gapped one, 0 is that
    state itself, 1 RESYNCING, 2 RECOVERED, more (or no bad row yet) VALID.
    """
    w = Window.partitionBy(*KEY).orderBy("arrival")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    df = gaps(rows.withColumn("previous", F.max("sequence").over(before)), threshold)
    df = df.withColumns({"gap_count": F.sum("jumped").over(upto), "out_of_order_count": F.sum("back").over(upto), "books": F.sum("book").over(upto)})
    return judged(df.withColumn("bad_books", F.max(F.when(F.col("bad"), F.col("books"))).over(upto)), threshold)


def observe_in_slices(rows: DataFrame, threshold: float) -> DataFrame:
    """The same where a key may hold most rows: its history is cut into ranges that many tasks scan, three times (the greatest
    sequence before, then what is counted, then the books at the last bad one)."""
    placed, order = scans.in_ranges(rows, KEY, ["arrival"]), ["arrival"]
    df = gaps(scans.prefixed(placed, KEY, order, most_before={"previous": F.col("sequence")}), threshold)
    df = scans.prefixed(df, KEY, order, sums={"gap_count": F.col("jumped"), "out_of_order_count": F.col("back"), "books": F.col("book")})
    return judged(scans.prefixed(df, KEY, order, most={"bad_books": F.when(F.col("bad"), F.col("books"))}), threshold).drop("__range")


def gaps(rows: DataFrame, threshold: float) -> DataFrame:
    """What a row says by itself and by the greatest sequence before it."""
    seq, prev = F.col("sequence"), F.col("previous")
    jump, back = F.coalesce(seq > prev + 1, F.lit(False)), F.coalesce(seq <= prev, F.lit(False))
    age = F.greatest(F.lit(0.0), (F.col("ingested_epoch") - F.col("epoch")).cast("double"))
    bad = F.col("is_orderbook") & ((age > threshold) | jump | back)
    return rows.withColumns({"gap_detected": jump | back, "age": age, "jumped": F.when(jump, seq - prev - 1).otherwise(0), "back": back.cast("int"), "book": F.col("is_orderbook").cast("int"), "bad": bad})


def judged(df: DataFrame, threshold: float) -> DataFrame:
    """books: order books up to the row; bad_books: how many there were at the last bad one."""
    stale, k = F.col("age") > threshold, F.col("books") - F.col("bad_books")
    state = F.when(F.col("bad_books").isNull(), "VALID").when(F.col("bad") & stale, "STALE").when(F.col("bad"), "GAP_DETECTED").when(k == 1, "RESYNCING").when(k == 2, "RECOVERED").otherwise("VALID")
    df = df.withColumn("orderbook_state", F.when(F.col("is_orderbook"), state)).withColumn("book_valid", F.col("orderbook_state").isin("VALID", "RECOVERED"))
    degraded = stale | F.col("gap_detected") | F.coalesce(F.col("is_orderbook") & ~F.col("book_valid"), F.lit(False))
    return df.withColumn("status", F.when(degraded, "DEGRADED").otherwise("HEALTHY")).drop("previous", "jumped", "back", "book", "bad", "books", "bad_books")


def idle_domains(signals: DataFrame, idle_after: int) -> DataFrame:
    """Per asset and domain: last time, the asset's last time over all domains, and whether the domain lags by idle_after."""
    t = F.unix_micros(F.col("event_time").cast("timestamp")) / 1e6
    last = signals.groupBy("scope_id", "asset_id", "source_domain").agg(F.max(t).alias("last"))
    every = Window.partitionBy("scope_id", "asset_id")
    return last.withColumn("all_last", F.max("last").over(every)).withColumn("idle", F.col("all_last") - F.col("last") >= idle_after)


def freshness(signals: DataFrame, now: float) -> DataFrame:
    """Last event and age of each domain."""
    t = F.unix_micros(F.col("event_time").cast("timestamp")) / 1e6
    return signals.groupBy("source_domain").agg(F.max(t).alias("last_event"), F.count(F.lit(1)).alias("n")).withColumn("age", F.lit(now) - F.col("last_event"))


def coverage(policies: DataFrame, runs: DataFrame, at: DataFrame) -> DataFrame:
    """policies: policy_id, policy_asset (null: all), effective_from, effective_to, max_staleness; runs: policy_id, started,
    completed, status; at: asset_id, epoch. Per row of at how many policies are in force for the asset, for how many of them the latest
    run that had completed (by start) is missing, failed or stale, and whether none is.

    A policy is in force from one time to another, and each run makes it good or bad until the next one comes or it grows stale. These
    bounds lie on one ordered stream with the times asked, and running sums of what begins and ends are the counts: no row for a
    time and a run, nor for a time and a policy."""
    own = Window.partitionBy("policy_id").orderBy("completed")
    known = runs.groupBy("policy_id", "completed").agg(F.max(F.struct("started", "completed", "status")).alias("run"))
    known = known.select("policy_id", F.col("completed").cast("double").alias("since"), F.max("run").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("last"), F.lead("completed").over(own).cast("double").alias("until"))
    before = known.groupBy("policy_id").agg(F.min("since").alias("until")).select("policy_id", F.lit(float("-inf")).alias("since"), F.lit(None).cast(known.schema["last"].dataType).alias("last"), "until")
    never = policies.select("policy_id").join(known, "policy_id", "left_anti").select("policy_id", F.lit(float("-inf")).alias("since"), F.lit(None).cast(known.schema["last"].dataType).alias("last"), F.lit(None).cast("double").alias("until"))
    force = policies.select("policy_id", F.coalesce("policy_asset", F.lit("")).alias("asset"), F.col("policy_asset").isNull().alias("general"), F.col("effective_from").cast("double").alias("from"), F.coalesce(F.col("effective_to").cast("double"), F.lit(float("inf"))).alias("to"), "max_staleness")
    spans = known.unionByName(before).unionByName(never).join(force, "policy_id")
    # A place on the stream: what begins or ends at a time counts there (0), what only holds after it does not (2); 1 is the asked time.
    place = lambda t, rank: F.struct(t.cast("double").alias("t"), F.lit(rank).alias("rank"))
    stale = F.col("last.completed") + F.col("max_staleness")
    bad = F.when(F.coalesce(F.col("last.status") != "SUCCESS", F.lit(True)) | (stale < F.col("since")), place(F.col("since"), 0)).otherwise(place(stale, 2))
    spans = spans.select("general", "asset", F.greatest(bad, place(F.col("from"), 0)).alias("a"), F.least(place(F.coalesce("until", F.lit(float("inf"))), 0), place(F.col("to"), 0)).alias("b")).where("a < b")
    end = lambda e, policy, degraded: F.struct(F.col(f"{e}.t").alias("t"), F.col(f"{e}.rank").alias("rank"), F.lit(policy).alias("policies"), F.lit(degraded).alias("degraded"))
    ends = lambda rows, policy, degraded: rows.select("general", "asset", F.inline(F.array(end("a", policy, degraded), end("b", -policy, -degraded))))
    in_force = force.select("general", "asset", place(F.col("from"), 0).alias("a"), place(F.col("to"), 0).alias("b")).where("a < b")
    asked = at.select("asset_id", "epoch").distinct()
    ask = lambda rows, general, asset: rows.select(F.lit(general).alias("general"), asset.alias("asset"), F.col("epoch").cast("double").alias("t"), F.lit(1).alias("rank"), F.lit(0).alias("policies"), F.lit(0).alias("degraded"))
    stream = ends(spans, 0, 1).unionAll(ends(in_force, 1, 0)).unionAll(ask(asked.select("epoch").distinct(), True, F.lit(""))).unionAll(ask(asked, False, F.col("asset_id")))
    keys, order = ["general", "asset"], ["t", "rank"]
    summed = scans.prefixed(scans.in_ranges(stream, keys, order), keys, order, sums={"policies": F.col("policies"), "degraded": F.col("degraded")}).where("rank = 1")
    every = summed.where("general").select(F.col("t").alias("__t"), F.col("policies").alias("p"), F.col("degraded").alias("d"))
    mine = summed.where("not general").select(F.col("asset").alias("asset_id"), F.col("t").alias("__t"), "policies", "degraded")
    out = asked.withColumn("__t", F.col("epoch").cast("double")).join(mine, ["asset_id", "__t"]).join(every, "__t").where("policies + p > 0")
    return out.select("asset_id", "epoch", (F.col("policies") + F.col("p")).alias("policies"), (F.col("degraded") + F.col("d")).alias("degraded")).withColumn("complete", F.col("degraded") == 0)
