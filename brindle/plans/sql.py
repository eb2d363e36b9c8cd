"""SQL text to DataFrame: Spark SQL over registered tables, and the small
filter-group-aggregate form that a distributed coordinator accepts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from brindle.operators.relational import AGGREGATES, aggregate, compare
from brindle.sources import tables

_FORM = re.compile(
    r"\s*select\s+(?:(?P<shown>\w+)\s*,\s*)?(?P<fn>\w+)\s*\(\s*(?P<arg>\w+|\*)?\s*\)\s+from\s+(?P<table>\w+)"
    r"(?:\s+where\s+(?P<col>\w+)\s*(?P<op><>|!=|>=|<=|=|>|<)\s*(?P<val>-?\d+(?:\.\d+)?|'(?:[^']|'')*'))?\s+group\s+by\s+(?P<by>\w+)\s*;?\s*",
    re.IGNORECASE,
)
#: Quoted text, which is left as it is, or a count of nothing.
_COUNT = re.compile(r"('(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*)|\bcount\s*\(\s*\)", re.IGNORECASE)


def run_sql(spark: SparkSession, base: str, text: str) -> DataFrame:
    """Any Spark SQL over the tables in ``base``; ``count()`` counts rows.
    Only tables that the text names are opened, and temporary views of the
    session that have their names are there again afterwards."""
    named = {w.lower() for w in re.findall(r"\w+", text)}
    names = [t for t in tables.TABLES if t in named]
    temporary = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    kept = {t: spark.table(t) for t in names if t in temporary}
    tables.register(spark, base, tuple(names))
    try:
        return spark.sql(_COUNT.sub(lambda m: m[1] or "count(*)", text.strip().rstrip(";")))
    finally:
        # The plan has its tables by now.
        for t in names:
            if t in kept:
                kept[t].createOrReplaceTempView(t)
            else:
                spark.catalog.dropTempView(t)


@dataclass(frozen=True)
class GroupQuery:
    """``select [by,] fn(arg) from table [where col op val] group by by``; ``val`` is a
    number or a quoted string."""

    table: str
    function: str
    argument: str
    by: str
    where: tuple[str, str, float | str] | None = None

    @staticmethod
    def parse(text: str) -> GroupQuery:
        m = _FORM.fullmatch(text)
        if not m:
            raise ValueError(f"not a filter-group-aggregate query: {text!r}")
        if m["shown"] and m["shown"].lower() != m["by"].lower():
            raise ValueError(f"{m['shown']} is neither grouped by nor aggregated")
        if m["fn"].lower() not in AGGREGATES:
            raise ValueError(f"unknown aggregate {m['fn']}")
        value = lambda v: v[1:-1].replace("''", "'") if v[0] == "'" else float(v) if "." in v else int(v)
        where = (m["col"], m["op"], value(m["val"])) if m["col"] else None
        return GroupQuery(m["table"], m["fn"].lower(), m["arg"] or "*", m["by"], where)

    def plan(self, df: DataFrame) -> DataFrame:
        """Partial sums in the tasks, one shuffle of groups, final sums."""
        if self.where:
            df = df.filter(compare(*self.where))
        return aggregate(df, {"value": (self.function, self.argument)}, [self.by])


def run_group_query(spark: SparkSession, base: str, text: str) -> DataFrame:
    query = GroupQuery.parse(text)
    return query.plan(tables.scan(spark, base, query.table))
