"""User-defined functions: registration for SQL, and a few that show each kind.

Scalars and aggregates get Arrow batches, table functions a row at a time.
Built-in functions come first; these are for what they cannot express.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register_scalar(spark: SparkSession, name: str, f: Callable[[pd.Series], pd.Series], returns: str) -> None:
    """``f`` over whole columns of a batch."""
    spark.udf.register(name, F.pandas_udf(f, returns))


def register_aggregate(spark: SparkSession, name: str, f: Callable, returns: str) -> None:
    """``f`` over whole columns of a group.  A group meets in one task, so where groups
    can be hot, aggregate with built-in functions first."""
    spark.udf.register(name, F.pandas_udf(f, returns))


def register_table(spark: SparkSession, name: str, handler: type, returns: str) -> None:
    """A class whose ``eval`` yields rows."""
    spark.udtf.register(name, F.udtf(handler, returnType=returns))


def soundex_like(names: pd.Series) -> pd.Series:
    """First letter and the consonants after it, upper case."""
    return names.str.upper().str.replace(r"(?<!^)[^BCDFGHJKLMNPQRSTVWXZ]", "", regex=True)


def range_of(values: pd.Series) -> float:
    return float(values.max() - values.min())


class Digits:
    """Each decimal digit of a number, and its place."""

    def eval(self, number: int):
        for place, digit in enumerate(str(abs(number)) if number is not None else ""):
            yield place, int(digit)


def register_all(spark: SparkSession) -> None:
    register_scalar(spark, "consonants", soundex_like, "string")
    register_aggregate(spark, "value_range", range_of, "double")
    register_table(spark, "digits", Digits, "place int, digit int")
