"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import WORD_SQL, attach, cut, running

#: No document is taken more often.
MOST = 2
#: Values of the second margin (languages) fall into this many classes, so the coupled part of the Newton system is bounded.
CLASSES = 64


def source_key(source: Column) -> Column:
    """A string of bounded length for each source, null too."""
    return F.when(source.isNull(), "").when(F.length(source) <= 64, F.concat(F.lit("="), source)).otherwise(F.concat(F.lit("#"), F.sha2(source, 256)))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget: float) -> DataFrame:
    """sizes: (source, source_size) and more. Adds target: budget times all sizes shared by the weights, which repeat
    over the sources by code point (null last); what a source can't take (MOST times its size) is shared anew by weight.

    The limit of a source binds where its size per weight is least. With the sources by that ratio, source i is full when
    what is left, shared by the weights left, reaches its limit; then all before it are full too.
    """
    n, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    ranked = running(sizes.withColumn("one", F.lit(1).cast("long")), [F.col("source").isNull(), F.col("source").cast("binary")], ["one"], n)
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod("before_one", F.lit(len(weights))) + 1).cast("int"))
    rows = ranked.withColumns({"weight": weight, "most": (F.col("source_size") * MOST).cast("double")}).drop("one", "before_one")
    rows = cut(rows)
    all_weight = rows.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    rows = running(rows, [F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary")], ["most", "weight"], n)
    left = F.greatest(F.lit(0.0), F.lit(float(total) * budget) - F.col("before_most"))
    rows = cut(rows.withColumn("full", left * F.col("weight") / (F.lit(all_weight) - F.col("before_weight")) >= F.col("most")))
    taken, free = rows.agg(F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))), F.lit(0.0)), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
    share = F.least("most", F.lit(max(0.0, float(total) * budget - taken)) * F.col("weight") / F.lit(free or 1.0))
    return rows.select(*sizes.columns, F.when(F.col("full"), F.col("most")).otherwise(share).alias("target"))


def balance(docs: DataFrame, targets: DataFrame, rounds: int = 60, tolerance: float = 1e-10) -> tuple[DataFrame, dict[int, float], float]:
    """The multipliers of entropy balancing, and their unit of size.

    docs: (key, cls, size); targets: (key, source_size, target). Wanted are document rates r in 0..MOST of least relative
    entropy to one copy each, sum r log r + (MOST - r) log(MOST - r), under token constraints: sum(size * r) is the
    target in each source, and in each class of `cls` over all sources it is what the sources' targets take in proportion.
    The optimum tilts exponentially in a document's own tokens, r = MOST / (1 + e^-((l + m) * size)), with a multiplier l
    for its source and m for its class. The dual, a sum of softplus over documents less the multipliers times the
    targets, is convex. Each Newton step aggregates gradient and Hessian of all documents in Spark: the block of the sources is
    diagonal, that of the classes is coupled to it and solved by its Schur complement, of CLASSES rows at most; steps
    are halved until the dual falls, by one more aggregation over the step lengths. Sources that are to be taken
    MOST times, or not at all, have no multiplier; their rates are at the bound.

    Returns (key, l), {class: m} and the unit; l and m are for sizes divided by the unit."""
    free = targets.where(F.col("target") > 0).where(F.col("target") < MOST * F.col("source_size") * (1 - 1e-12)).select("key", "source_size", "target")
    mass = docs.where("size > 0").groupBy("key", "cls", "size").agg(F.count(F.lit(1)).cast("double").alias("n"))
    mass = cut(mass.join(free.select("key"), "key"))
    n, unit = mass.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.sum(F.col("n") * F.col("size")) / F.sum("n")).first()
    state = cut(free.select("key", (F.col("target") / F.lit(unit or 1.0)).alias("goal"), (F.col("target") / F.col("source_size")).alias("share"), F.lit(0.0).alias("l")))
    if not n:
        return state.select("key", "l"), {}, 1.0
    mass = cut(mass.select("key", "cls", "n", (F.col("size") / F.lit(unit)).alias("x")))
    goal = {r["cls"]: r["goal"] for r in mass.join(state, "key").groupBy("cls").agg(F.sum(F.col("n") * F.col("x") * F.col("share")).alias("goal")).collect()}
    classes = sorted(goal)
    m = dict.fromkeys(classes, 0.0)

    def by_class(values: dict[int, float]) -> Column:
        return F.element_at(F.create_map(*(x for c in classes for x in (F.lit(c), F.lit(float(values[c]))))), F.col("cls"))

    for _ in range(rounds):
        tilt = 1 / (1 + F.exp(-(F.col("l") + by_class(m)) * F.col("x")))
        now, slope = F.col("n") * F.col("x") * MOST * tilt, F.col("n") * F.col("x") * F.col("x") * MOST * tilt * (1 - tilt)
        cells = mass.join(state.select("key", "l"), "key").groupBy("key", "cls").agg(F.sum(now).alias("now"), F.sum(slope).alias("slope"))
        sources = cells.groupBy("key").agg(F.sum("now").alias("now"), F.greatest(F.sum("slope"), F.lit(1e-200)).alias("slope"), F.collect_list(F.struct("cls", "now", "slope")).alias("cells"))
        sources = cut(sources.join(state, "key").withColumn("gap", F.col("goal") - F.col("now")))
        # All sums over sources at once, by pairs of classes; those of one class are with its pair of itself.
        pairs = sources.select("slope", "gap", "goal", F.explode("cells").alias("a"), "cells").select("slope", "gap", "goal", "a", F.explode("cells").alias("b"))
        sums = {
            (r["i"], r["j"]): r
            for r in pairs.groupBy(F.col("a.cls").alias("i"), F.col("b.cls").alias("j"))
            .agg(F.sum(F.col("a.slope") * F.col("b.slope") / F.col("slope")).alias("both"), F.sum("a.now").alias("now"), F.sum("a.slope").alias("slope"), F.sum(F.col("a.slope") * F.col("gap") / F.col("slope")).alias("carried"), F.max(F.abs("gap") / F.col("goal")).alias("miss"))
            .collect()
        }
        own = [sums[c, c] for c in classes]
        gaps = np.array([goal[c] - r["now"] for c, r in zip(classes, own, strict=True)])
        if max(*(r["miss"] for r in own), *(abs(g) / goal[c] for g, c in zip(gaps, classes, strict=True))) <= tolerance:
            break
        schur = np.diag([r["slope"] for r in own]) - np.array([[sums[i, j]["both"] if (i, j) in sums else 0.0 for j in classes] for i in classes])
        # One direction is free (all l up, all m down): the least of the solutions.
        step = dict(zip(classes, np.linalg.lstsq(schur, gaps - np.array([r["carried"] for r in own]), rcond=1e-10)[0].tolist(), strict=True))
        move = F.create_map(*(x for c in classes for x in (F.lit(c), F.lit(step[c]))))
        pull = F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["slope"] * F.element_at(move, c["cls"]))
        moved = sources.select("key", "goal", "share", "l", "gap", ((F.col("gap") - pull) / F.col("slope")).alias("dl"))
        lengths = [2.0**-k for k in range(12)]
        softplus = lambda z: F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        at = lambda t: F.sum(F.col("n") * MOST * softplus((F.col("l") + by_class(m) + t * (F.col("dl") + by_class(step))) * F.col("x")))
        curve = mass.join(moved, "key").groupBy("key").agg(*(at(t).alias(f"at{i}") for i, t in enumerate([0.0, *lengths])), *(F.first(F.col(a) * F.col(b)).alias(a + b) for a, b in (("l", "goal"), ("dl", "goal"), ("dl", "gap"))))
        *values, base, pace, fall = curve.agg(*(F.sum(c) for c in curve.columns[1:])).first()
        base, pace = base + sum(m[c] * goal[c] for c in classes), pace + sum(step[c] * goal[c] for c in classes)
        fall += sum(step[c] * g for c, g in zip(classes, gaps, strict=True))
        small = 1e-13 * (abs(values[0]) + abs(base))  # what sums of doubles can't tell apart
        t = next((t for v, t in zip(values[1:], lengths, strict=True) if v - t * pace <= values[0] - 1e-4 * t * fall + small), lengths[-1])
        m = {c: m[c] + t * step[c] for c in classes}
        state = moved.select("key", "goal", "share", (F.col("l") + t * F.col("dl")).alias("l"))
    # Sums of doubles depend on their order in the last places; rounded, reruns agree.
    return state.select("key", F.round("l", 9).alias("l")), {c: round(v, 9) for c, v in m.items()}, float(unit)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", class_col: str = "lang", weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, group: int = 2_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: id, source, size (words), source_size, target, rate and copies (0 to MOST), then the
    columns named in carry (longs without nulls, such as a key of the row), which also order rows of one id and text.

    Rates come from balance: the tokens of each source meet its target, and those of each language (class_col, where docs
    has it; CLASSES classes by hash) keep the share that the targets give them. Copies are the rates rounded: within
    groups of a source (by a hash of the row, about `group` rows each) the documents come by size from the largest, and
    each rounding error is carried to the next, smaller one; so a group ends within half of its smallest documents'
    sizes of what its rates take.

    Defined cases: a null text has size 0 and copies 0; null is a source of its own, the last, and a language of its own;
    repeated rows and null ids are rows like any other; weights must be positive; an empty table gives no rows. Columns
    other than those named and carried are ignored. Reruns give the same rows.
    """
    text = F.col(text_col).cast("string")
    cls = F.pmod(F.xxhash64(F.col(class_col).cast("string")), F.lit(CLASSES)).cast("int") if class_col in docs.columns else F.lit(0)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), cls.alias("cls"),
        F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col(id_col), text).alias("tie"), *(F.col(c).cast("long").alias(c) for c in carry),
    )
    rows = cut(rows.withColumn("key", source_key(F.col("source"))))
    sizes = cut(rows.groupBy("key").agg(F.first("source", ignorenulls=False).alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    targets = source_targets(sizes, weights, budget)
    tilts, by_class, unit = balance(rows, targets)
    facts = cut(targets.join(tilts, "key", "left").select("key", "n", F.col("n").alias("rows"), "source_size", "target", "l"))
    total = facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = attach(rows, facts, "key", "n", total)
    m = F.element_at(F.create_map(*(x for c, v in by_class.items() for x in (F.lit(c), F.lit(v)))), F.col("cls")) if by_class else F.lit(0.0)
    tilted = MOST / (1 + F.exp(-(F.col("l") + F.coalesce(m, F.lit(0.0))) * F.col("size") / F.lit(unit)))
    rate = F.when(F.col("l").isNotNull(), F.round(tilted, 9)).when(F.col("target") > 0, F.lit(float(MOST))).otherwise(0.0)
    part = F.pmod(F.xxhash64("tie", "id", *carry), F.ceil(F.col("rows") / group)).cast("int")
    placed = placed.withColumns({"rate": rate, "part": part})

    def rounding(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "tie", "id", *carry], ascending=[False, True, True, *(True for _ in carry)], kind="stable")
        size, rate = pdf["size"].to_numpy(np.int64).tolist(), pdf["rate"].to_numpy(np.float64).tolist()
        carried, out = 0.0, []
        for s, r in zip(size, rate, strict=True):
            if not s:
                out.append(0)
                continue
            want = r + carried / s
            c = min(MOST, max(0, int(np.floor(want + 0.5))))
            carried += (r - c) * s
            out.append(c)
        return pdf.assign(copies=np.array(out, np.int64))[["id", "source", "size", "source_size", "target", "rate", "copies", *carry]]

    out = placed.drop("key", "cls", "l", "rows", "n").groupBy("source", "part").applyInPandas(rounding, ", ".join(["id long, source string, size long, source_size long, target double, rate double, copies long", *(f"{c} long" for c in carry)]))
    return out.withColumnRenamed("id", id_col)
