"""What a row knows of all earlier rows of its key, worked out by many tasks for one key: rows lie in ranges of (key, order), each range
is summed up (or composed) by itself, and the small sums of a key's ranges are put in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.sources.tables import shared_folder

#: Rows that are composed as one, and then as many of these as one, and so on.
PIECE = 256
#: Rows that one task may hold sorted.
FEW = 10_000


def in_ranges(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with __range, its number in the order of (keys, order): a key of most rows lies in many ranges. Written to the shared
    folder, so that the numbers stay."""
    shared_folder(rows.sparkSession)
    return rows.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()).checkpoint()


def prefixed(placed: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, most: dict[str, Column] | None = None, most_before: dict[str, Column] | None = None) -> DataFrame:
    """placed (of in_ranges) with running sums and greatest values up to each row of its key, its own included (but for most_before).
    `order` must tell a key's rows apart."""
    inside = Window.partitionBy("__range", *keys).orderBy(*order)
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    asked = [(n, c, F.sum, upto) for n, c in (sums or {}).items()] + [(n, c, F.max, upto) for n, c in (most or {}).items()] + [(n, c, F.max, before) for n, c in (most_before or {}).items()]
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    heads = placed.groupBy("__range", *keys).agg(*(f(c).alias(n) for n, c, f, _ in asked)).select("__range", *keys, *(f(n).over(earlier).alias(f"__{n}") for n, _, f, _ in asked))
    out = placed.withColumns({n: f(c).over(w) for n, c, f, w in asked}).join(heads, ["__range", *keys])
    joined = {n: (F.coalesce(n, F.lit(0)) + F.coalesce(f"__{n}", F.lit(0))) if f is F.sum else F.greatest(n, f"__{n}") for n, _, f, _ in asked}
    return out.withColumns(joined).drop(*(f"__{n}" for n, *_ in asked))


def first_rows(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows by `order`, which must tell rows apart. A few are a sorted list; more are counted in ranges, so that no task holds them."""
    if n <= FEW:
        return rows.orderBy(*order).limit(n)
    shared_folder(rows.sparkSession)
    placed = rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).checkpoint()
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    heads = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))  # a row for each range
    own = placed.withColumn("__i", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return own.join(heads, "__range").where(F.col("__i") + F.col("__before") <= n).drop("__range", "__i", "__before")


def folded(placed: DataFrame, keys: list[str], order: list[str], element: Column, join: Callable[[Column, Column], Column], empty: Column, kind: str) -> DataFrame:
    """placed (of in_ranges) with __element, and `before`: what the elements of all earlier rows of the key make, put together in order by
    `join`, which must be associative and keep elements small, with `empty` for none. kind: their type.

    PIECE rows are put together into one element, and PIECE pieces again, until a key has no more than PIECE; then each level is walked from
    what the level above gives. A task holds PIECE rows of one key at a time."""
    inside = Window.partitionBy("__range", *keys).orderBy(*order)
    rest = [c for c in placed.columns if c not in ("__range", *keys)]
    rows = placed.withColumns({"__element": element, "__n": F.row_number().over(inside)}).withColumn("__piece", F.floor((F.col("__n") - 1) / PIECE))
    items = F.array_sort(F.collect_list(F.struct("__n", "__element", F.struct(*rest).alias("row"))))
    pieces = rows.groupBy("__range", *keys, "__piece").agg(items.alias("__items"))
    bound = placed.count() // PIECE + placed.rdd.getNumPartitions() + 1
    whole = pieces.select(*keys, "__range", "__piece", together(F.col("__items.__element"), join, empty).alias("__element"))
    out = pieces.join(begun(whole, keys, ["__range", "__piece"], join, empty, kind, bound), [*keys, "__range", "__piece"])
    each = F.arrays_zip(F.col("__items.row").alias("row"), F.col("__items.__element").alias("own"), walked(F.col("begin"), F.col("__items"), join, kind).alias("before"))
    return out.select("__range", *keys, F.inline(each)).select("__range", *keys, "row.*", F.col("own").alias("__element"), "before")


def together(elements: Column, join: Callable[[Column, Column], Column], empty: Column) -> Column:
    return F.aggregate(elements, empty, join)


def walked(begin: Column, items: Column, join: Callable[[Column, Column], Column], kind: str) -> Column:
    """What comes before each item: at most PIECE of them, from `begin` on."""
    start = F.struct(begin.alias("s"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))
    step = lambda done, item: F.struct(join(done["s"], item["__element"]).alias("s"), F.concat(done["out"], F.array(done["s"])).alias("out"))
    return F.aggregate(items, start, step, lambda done: done["out"])


def begun(pieces: DataFrame, keys: list[str], order: list[str], join: Callable[[Column, Column], Column], empty: Column, kind: str, bound: int) -> DataFrame:
    """(keys, order, begin): what comes before each piece. bound: pieces of a key at most."""
    group = f"__group{bound}"  # each level has its own
    own = pieces.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).withColumn(group, F.floor(F.col("__i") / PIECE))
    groups = own.groupBy(*keys, group).agg(F.array_sort(F.collect_list(F.struct("__i", "__element", F.struct(*order).alias("place")))).alias("__items"))
    if bound > PIECE:
        whole = groups.select(*keys, group, together(F.col("__items.__element"), join, empty).alias("__element"))
        groups = groups.join(begun(whole, keys, [group], join, empty, kind, -(-bound // PIECE)), [*keys, group])
    else:
        groups = groups.withColumn("begin", empty)
    each = F.arrays_zip(F.col("__items.place").alias("place"), walked(F.col("begin"), F.col("__items"), join, kind).alias("begin"))
    return groups.select(*keys, F.inline(each)).select(*keys, "place.*", "begin")


def states(placed: DataFrame, keys: list[str], order: list[str], maps: Column, count: int, start: int = 0) -> DataFrame:
    """placed (of in_ranges) with the state of its key's machine before and after each row. maps: what the row makes of each of the
    `count` states, an array of next ones; two maps make one."""
    same = F.array(*(F.lit(s) for s in range(count)))
    out = folded(placed, keys, order, maps, lambda a, b: F.transform(a, lambda s: F.element_at(b, s + 1)), same, "array<int>")
    out = out.withColumn("state_before", F.element_at("before", start + 1))
    return out.withColumn("state", F.element_at("__element", F.col("state_before") + 1)).drop("__element", "before")


def orbit(rows: DataFrame, keys: list[str], node: str, following: str, head: Column) -> DataFrame:
    """(keys, node) of all that is reached from the rows where head holds, going from node to following (null: the end). Pointer
    doubling: a chain of n steps takes log2(n) rounds of joins."""
    shared_folder(rows.sparkSession)
    reached = rows.where(head).select(*keys, node)
    jump = rows.where(F.col(following).isNotNull()).select(*keys, node, following).checkpoint()
    while not jump.isEmpty():
        more = reached.join(jump, [*keys, node]).select(*keys, F.col(following).alias(node))
        reached = reached.unionAll(more).distinct().checkpoint()
        onward = jump.select(*keys, F.col(node).alias(following), F.col(following).alias("__next"))
        jump = jump.join(onward, [*keys, following]).select(*keys, node, F.col("__next").alias(following)).checkpoint()
    return reached
