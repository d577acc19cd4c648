"""Chat formatting by multi-party perspective rotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm._common import attach, running

END = "<|end|>\n"


def _in_pieces(rows: DataFrame, block_turns: int) -> DataFrame:
    """rows with the piece of its part that each is in: parts of at most block_turns turns are one piece; others, whose turn numbers are
    equal or null, are numbered by ranges, so that no task holds a part, and cut every block_turns turns."""
    group = ["conv", "part"]
    crowded = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > block_turns)
    total = crowded.agg(F.sum("__n")).first()[0]
    if not total:
        return rows.withColumn("piece", F.lit(0).cast("long"))
    key = lambda df: df.withColumn("__key", F.struct("conv", "part"))
    marks = key(crowded).select("__key")
    rest = key(rows).join(marks, "__key", "left_anti").drop("__key").withColumn("piece", F.lit(0).cast("long"))
    full = key(rows).join(marks, "__key", "left_semi").drop("__key").withColumn("one", F.lit(1).cast("long"))
    placed = running(full, [*group, "turn", "role", "text"], ["one"], total)
    starts = placed.groupBy(*group).agg(F.min("before_one").alias("__start"), F.count(F.lit(1)).alias("__n")).select(F.struct("conv", "part").alias("__key"), "__start", "__n")
    numbered = attach(key(placed), starts, "__key", "__n", total).withColumn("piece", F.floor((F.col("before_one") - F.col("__start")) / block_turns).cast("long"))
    return rest.unionByName(numbered.select(*rest.columns))


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system_role: str = "system", block_turns: int = 512) -> DataFrame:
    """Every dialogue once for each of its participants: conv, participant, part, piece, n_turns, n_trained, rendered, mask.

    The participant's turns are headed <|assistant|>, those of the others <|user name=NAME|>, system turns <|system|>;
    every turn ends with END. mask lists the character ranges to train on as "start:stop", comma-joined (code points,
    stop exclusive): the text and end mark of the participant's turns. Participants are the distinct roles without the
    system's. Turns come by turn number, role and text; a dialogue is rendered in parts of block_turns turn numbers, and a
    part that holds more turns than that (equal or null numbers) in pieces of block_turns turns, so no row grows with a dialogue's
    length, and a long dialogue is spread over tasks.

    Defined cases: a null text is an empty turn; a null role is the participant "unknown"; a null turn number sorts
    first, in part 0; a null conversation id is one conversation; repeated rows are repeated turns; a dialogue of system
    turns only, like an empty table, gives no rows. Other columns are ignored.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("part", F.coalesce(F.expr(f"turn div {block_turns}"), F.lit(0)))
    rows = _in_pieces(rows, block_turns)
    people = rows.where(F.col("role") != system_role).select(F.col("conv").alias("__conv"), F.col("role").alias("participant")).distinct()
    seen = rows.join(people, F.col("conv").eqNullSafe(F.col("__conv"))).drop("__conv")
    mine = F.col("role") == F.col("participant")
    head = F.when(F.col("role") == system_role, F.lit("<|system|>\n")).when(mine, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), "role", F.lit("|>\n")))
    seen = seen.withColumns({"mine": mine, "head": F.length(head), "segment": F.concat(head, "text", F.lit(END))})
    group = ["conv", "participant", "part", "piece"]
    order = Window.partitionBy(*group).orderBy("turn", "role", "text")
    seen = seen.withColumn("n", F.row_number().over(order)).withColumn("stop", F.sum(F.length("segment")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("stop") - F.length("segment") + F.col("head")
    span = F.when(F.col("mine"), F.concat_ws(":", start.cast("string"), F.col("stop").cast("string")))
    out = seen.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("n", "segment", span.alias("span")))).alias("all"), F.count(F.lit(1)).alias("n_turns"), F.count_if("mine").alias("n_trained"))
    return out.select(F.col("conv").alias(conv_col), "participant", "part", "piece", "n_turns", "n_trained", F.array_join("all.segment", "").alias("rendered"), F.array_join("all.span", ",").alias("mask"))


#: The same for `conversations`, in DuckDB's SQL.
ORACLE_SQL = """
WITH r AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, coalesce(turn // 512, 0) AS part,
    (row_number() OVER (PARTITION BY conv_id, coalesce(turn // 512, 0) ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1) // 512 AS piece FROM conversations),
p AS (SELECT DISTINCT conv_id AS c, role AS participant FROM r WHERE role <> 'system'),
s AS (
  SELECT r.*, participant, role = participant AS mine,
    CASE WHEN role = 'system' THEN '<|system|>' || chr(10) WHEN role = participant THEN '<|assistant|>' || chr(10)
         ELSE '<|user name=' || role || '|>' || chr(10) END AS head
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.c),
g AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM s),
n AS (
  SELECT *, row_number() OVER w AS n, sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop
  FROM g WINDOW w AS (PARTITION BY conv_id, participant, part, piece ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, participant, part, piece, count(*) AS n_turns, count(*) FILTER (mine) AS n_trained,
  string_agg(segment, '' ORDER BY n) AS rendered,
  coalesce(string_agg(CAST(stop - length(segment) + length(head) AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY n) FILTER (mine), '') AS mask
FROM n GROUP BY conv_id, participant, part, piece
"""
