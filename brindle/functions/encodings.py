"""Column encodings as DataFrame transforms, and their inverses.

Encoders take (df, order, value): the column that gives rows their order and
the one to encode.  ``group`` splits independent runs so that no window needs
all rows in one task; without it a whole column is one run by definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources import shared


def _by(group: str | None, *order: str):
    return Window.partitionBy(*([group] if group else [])).orderBy(*order)


def _keys(group: str | None) -> list[str]:
    return [group] if group else []


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with its rows' numbers from 0 by ``order``, a column of distinct values.

    Rows are dealt by ranges of it; a row's number is its place in its range
    and the sizes of the ranges before, so only those sizes meet in one task."""
    dealt = shared.materialize(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__start"))
    inside = dealt.withColumn("__place", F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1)
    return inside.join(F.broadcast(starts), "__part").withColumn(name, (F.col("__start") + F.col("__place")).cast("int")).drop("__part", "__start", "__place")  # a row per range


def dictionary(df: DataFrame, order: str, value: str) -> DataFrame:
    """(code, value): distinct values in the order of their first occurrence."""
    first = df.groupBy(value).agg(F.min(order).alias("__first"))
    return numbered(first, "__first", "code").select("code", value)


def dictionary_encode(df: DataFrame, order: str, value: str) -> DataFrame:
    codes = dictionary(df, order, value)
    return df.select(order, value).join(codes.withColumnRenamed(value, "__value"), F.col(value).eqNullSafe(F.col("__value"))).select(order, "code")


def dictionary_decode(encoded: DataFrame, codes: DataFrame, order: str, value: str) -> DataFrame:
    return encoded.join(codes, "code").select(order, value)


def rle_encode(df: DataFrame, order: str, value: str, group: str | None = None) -> DataFrame:
    """(run, value, length): runs of equal neighbours, numbered from 0."""
    w = _by(group, order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    marked = df.select(*_keys(group), order, value, changed.alias("__new"))
    runs = marked.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return runs.groupBy(*_keys(group), "run", value).agg(F.count("*").alias("length"))


def rle_decode(runs: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """(position, value) from runs."""
    before = F.coalesce(F.sum("length").over(_by(group, "run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = runs.withColumn("__at", before)
    return placed.select(*_keys(group), F.posexplode(F.array_repeat(value, F.col("length").cast("int"))).alias("__i", value), "__at").select(*_keys(group), (F.col("__at") + F.col("__i")).alias("position"), value)


def delta_encode(df: DataFrame, order: str, value: str, group: str | None = None) -> DataFrame:
    """(order, delta): differences to the value before; the first keeps its value."""
    before = F.lag(value).over(_by(group, order))
    return df.select(*_keys(group), order, (F.col(value) - F.coalesce(before, F.lit(0))).alias("delta"))


def delta_decode(deltas: DataFrame, order: str, value: str, group: str | None = None) -> DataFrame:
    return deltas.select(*_keys(group), order, F.sum("delta").over(_by(group, order).rowsBetween(Window.unboundedPreceding, 0)).alias(value))
