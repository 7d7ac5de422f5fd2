"""Interval unions over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_length(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key, covered, n_islands: the length of the union of a key's spans; touching spans merge.

    Gaps and islands with one sort: a span adds what reaches beyond the furthest end before it.
    """
    before = F.max(end).over(Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.select(key, F.col(start).alias("s"), F.col(end).alias("e"), before.alias("before"))
    added = F.greatest(F.col("e") - F.greatest(F.col("s"), F.coalesce("before", F.col("s"))), F.lit(0))
    return rows.groupBy(key).agg(F.sum(added).alias("covered"), F.count_if(F.col("before").isNull() | (F.col("s") > F.col("before"))).alias("n_islands"))
