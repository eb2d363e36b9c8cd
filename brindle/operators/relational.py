"""Relational operators as thin DataFrame builders.

They only declare a plan; pushdown, pruning, join strategy, partial
aggregation and spilling are Catalyst's and AQE's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources import shared

AGGREGATES = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg, "count_distinct": F.count_distinct, "approx_distinct": F.approx_count_distinct}
COMPARISONS = {
    ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b,
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<>": lambda a, b: a != b,
}
#: Left rows from which a key is dealt over salts, and how many keys are at most.
HOT_ROWS, HOT_KEYS = 10_000, 1024
#: Rows of each side of a range join that meet in a square, and pairs and rows of a task.
CELL_ROWS, TASK_PAIRS, TASK_ROWS = 4096, 1 << 25, 1 << 20


def compare(column: str, op: str, value) -> Column:
    """A typed comparison under SQL's three-valued logic."""
    return COMPARISONS[op](F.col(column), F.lit(value))


def aggregate(df: DataFrame, aggs: dict[str, tuple[str, str]], by: list[str] | None = None, having: Column | str | None = None) -> DataFrame:
    """``aggs`` maps output names to (function, column); ``*`` counts rows.
    Without ``by`` the whole table is one group."""
    columns = [AGGREGATES[fn](F.col(c) if c != "*" else F.lit(1)).alias(name) for name, (fn, c) in aggs.items()]
    out = df.groupBy(*by).agg(*columns) if by else df.agg(*columns)
    return out.filter(having) if having is not None else out


def grouping_sets(df: DataFrame, sets: list[list[str]], aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """One aggregate for each set of keys; keys that a set lacks are null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    columns = [AGGREGATES[fn](F.col(c) if c != "*" else F.lit(1)).alias(name) for name, (fn, c) in aggs.items()]
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *map(F.col, keys)).agg(*columns)


def conditional_sum(condition: Column, value: Column | None = None) -> Column:
    return F.sum(F.when(condition, value if value is not None else F.lit(1)).otherwise(F.lit(0)))


def equi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Left columns, then right ones.  ``null_safe`` lets null keys meet."""
    a, b = left[left_key], right[right_key]
    return left.join(right, a.eqNullSafe(b) if null_safe else a == b, how)


def salted_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, salts: int = 32, how: str = "inner") -> DataFrame:
    """For keys that AQE cannot split, such as joins that feed a grouped operator:
    left rows of hot keys are dealt over salts by a hash of the row, right rows of
    these keys copied to each.

    A key is hot from ``HOT_ROWS`` left rows on; the ``HOT_KEYS`` with most rows are
    taken.  The planner takes a table with its copies for as small as without, so
    the right side is never broadcast."""
    counts = left.groupBy(F.col(left_key).alias("k")).count().filter((F.col("count") >= HOT_ROWS) & F.col("k").isNotNull())
    hot = [r["k"] for r in counts.orderBy(F.desc("count"), "k").limit(HOT_KEYS).collect()]
    dealt = left.withColumn("__salt", F.when(F.col(left_key).isNull() | F.col(left_key).isin(hot), F.pmod(F.xxhash64(*left.columns), F.lit(salts))).otherwise(F.lit(0)))
    copies = F.when(F.col(right_key).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = right.withColumn("__copy", F.explode(copies))
    on = (F.col(left_key) == F.col(right_key)) & (F.col("__salt") == F.col("__copy"))
    return dealt.join(copied.hint("merge"), on, how).drop("__salt", "__copy")


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """A join on any boolean expression over the columns of both sides.

    Catalyst takes what equality the condition holds for a hash or merge join;
    without any, each left row meets each right row, so one side must be small.
    For a value between two bounds see :func:`range_join`."""
    return left.join(right, condition, how)


def cross_join(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Left rows with each right row whose ``low`` .. ``high`` (both included) holds their ``point``.

    Both sides meet by equality of a cell of ``width``: a point has one, an
    interval one row for each that it touches, so neither side is compared with
    all of the other.  A good width is about that of an interval.

    The rows of a full cell are dealt over a grid: ``CELL_ROWS`` of each side meet
    in a square, and tasks are as many as the pairs to be compared call for.  So a
    task's work is bounded, while the pairs are as many as the result makes them."""
    cell = lambda c: F.floor(c.cast("double") / width)
    at = left.withColumn("__cell", cell(left[point]))
    touched = right.filter(right[low] <= right[high]).withColumn("__touched", F.explode(F.sequence(cell(right[low]), cell(right[high]))))
    counts = at.groupBy("__cell").agg(F.count("*").alias("__m")).join(touched.groupBy(F.col("__touched").alias("__cell")).agg(F.count("*").alias("__n")), "__cell")
    size = lambda n: F.ceil(F.col(n) / CELL_ROWS).cast("int")
    counts = shared.materialize(counts.select("__cell", size("__m").alias("__rows"), size("__n").alias("__columns"), (F.col("__m").cast("double") * F.col("__n")).alias("__pairs"), (F.col("__m") + F.col("__n")).alias("__both")), "cells")
    tasks = counts.agg(F.ceil(F.sum("__pairs") / TASK_PAIRS + F.sum("__both") / TASK_ROWS)).first()[0] or 1
    # Full cells are fewer than a row in CELL_ROWS.
    full = F.broadcast(counts.filter("__rows > 1 or __columns > 1").select("__cell", "__rows", "__columns"))
    some = lambda n: F.coalesce(F.col(n), F.lit(1))
    part = lambda df, n: F.pmod(F.xxhash64(*df.columns), some(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), some(n) - 1))
    at = at.join(full, "__cell", "left").withColumn("__i", part(left, "__rows")).withColumn("__j", copies("__columns")).drop("__rows", "__columns")
    full = full.withColumnRenamed("__cell", "__touched")
    touched = touched.join(full, "__touched", "left").withColumn("__l", part(right, "__columns")).withColumn("__k", copies("__rows")).drop("__rows", "__columns")
    at, touched = at.repartition(tasks, "__cell", "__i", "__j"), touched.repartition(tasks, "__touched", "__k", "__l")
    met = (F.col("__cell") == F.col("__touched")) & (F.col("__i") == F.col("__k")) & (F.col("__j") == F.col("__l")) & F.col(point).between(F.col(low), F.col(high))
    return at.hint("merge").join(touched, met).drop("__cell", "__touched", "__i", "__j", "__k", "__l")


def overlap_join(left: DataFrame, right: DataFrame, by: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs of rows (l, r: structs) of one ``by`` whose intervals ``start`` .. ``end`` share
    a moment.  Intervals meet by cells; a pair counts in the cell where its common part begins."""
    cell = lambda c: F.floor(c.cast("double") / width)
    spread = lambda df, name: df.select(
        F.struct(*(df[c] for c in df.columns)).alias(name), df[by].alias("by"), df[start].alias(f"{name}_start"), df[end].alias(f"{name}_end"),
        F.explode(F.sequence(cell(df[start]), F.greatest(cell(df[start]), cell(df[end])))).alias("cell"))
    met = spread(left, "l").join(spread(right, "r"), ["by", "cell"])
    first = F.greatest("l_start", "r_start")
    return met.filter((first <= F.least("l_end", "r_end")) & (cell(first) == F.col("cell"))).select("l", "r")


def sort(df: DataFrame, *keys: tuple[str, bool]) -> DataFrame:
    """Keys are (column, ascending); nulls come first ascending and last descending."""
    return df.orderBy(*(F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in keys))


def top(df: DataFrame, n: int, *keys: tuple[str, bool]) -> DataFrame:
    """Sort and limit, which Spark fuses: each task keeps n rows."""
    return sort(df, *keys).limit(n)


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """Each left row with the last ``value`` of ``right`` at or before its time."""
    a = left.select("*", F.col(left_time).alias("__t"), F.lit(1).alias("__left"), F.lit(None).alias("__v"))
    b = right.select(F.col(by), F.col(right_time).alias("__t"), F.lit(0).alias("__left"), F.col(value).alias("__v"))
    w = Window.partitionBy(by).orderBy("__t", "__left").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(f"asof_{value}", F.last("__v", ignorenulls=True).over(w))
    return both.filter("__left = 1").drop("__t", "__left", "__v")
