"""Running sums and exact quantiles over the values of a whole column, without ordering them in one task.

Values are counted first, so equal ones are one row. Cut points from a mergeable quantile sketch deal the distinct values
to ``buckets`` ranges; sums run within a range, and start from the totals of the ranges below it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def prefix_sums(counted: DataFrame, value: str, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``counted`` (a row for each distinct value) with <column>_before, the sum over smaller values, and <column>_all.

    Null values are dropped; sums of an empty table are empty.
    """
    counted = counted.filter(F.col(value).isNotNull())
    cuts = counted.agg(F.array_distinct(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 5000)).alias("_cuts"))
    dealt = counted.crossJoin(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")  # one row
    ahead = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows as there are buckets
    base = dealt.groupBy("_b").agg(*[F.sum(c).alias(c) for c in columns])
    base = base.select("_b", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_{c}_base") for c in columns], *[F.sum(c).over(Window.partitionBy()).alias(f"{c}_all") for c in columns])
    within = Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(base), "_b")
    out = out.withColumns({f"{c}_before": F.col(f"_{c}_base") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in columns})
    return out.drop("_b", *[f"_{c}_base" for c in columns])


def picked(rank: Column, before: str = "n_before", n: str = "n", value: str = "v") -> Column:
    """The value at a rank (from 0) of the ordered rows, as an aggregate over counted values."""
    return F.min(F.when(F.col(before) + F.col(n) > rank, F.col(value)))


def linear(p: float, low: str, high: str, size: str) -> Column:
    """Between the values at the ranks around (size - 1) p."""
    place = F.lit(p) * (F.col(size) - 1)
    part = place - F.floor(place)
    # as weights, so that equal neighbours stay exact
    return F.when(part == 0, F.col(low)).otherwise(F.col(low) * (1 - part) + F.col(high) * part)


def quantiles(df: DataFrame, value: str, at: Iterable[float], by: list[str] | None = None, name: str = "q") -> DataFrame:
    """``name``: array of the exact linear quantiles of the non-null values; of each group, or one row for all (null for no values).

    A group's distinct values are ordered by an external sort that may spill, never gathered in a buffer.
    """
    at, by = list(at), by or []
    n = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    if by:
        w = Window.partitionBy(*by)
        n = n.withColumn("n_before", F.sum("n").over(w.orderBy("v")) - F.col("n")).withColumn("n_all", F.sum("n").over(w))
    else:
        n = prefix_sums(n, "v", ["n"])
    place = [F.lit(p) * (F.col("n_all") - 1) for p in at]
    picks = [x for i, h in enumerate(place) for x in (picked(F.floor(h)).alias(f"_l{i}"), picked(F.ceil(h)).alias(f"_h{i}"))]
    out = n.groupBy(*by).agg(F.max("n_all").alias("_n"), *picks)
    return out.select(*by, F.when(F.col("_n").isNotNull(), F.array(*[linear(p, f"_l{i}", f"_h{i}", "_n") for i, p in enumerate(at)])).alias(name))
