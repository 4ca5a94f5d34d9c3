"""Strictly causal history features: a value of day t uses days before t only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.functions import predicates as P

KEYS = ["DomainName", "UserName", "day"]
ACCOUNT = ["DomainName", "UserName"]


def presence(events: DataFrame) -> DataFrame:
    """keys, kind (Source or LogHost), entity: distinct usable values of each account-day. ``Unknown`` counts as a value."""
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), F.when(P.present(F.col(c)), P.stripped(F.col(c))).alias("entity")) for c in ("Source", "LogHost")])
    return events.select(*KEYS, F.explode(kinds).alias("p")).select(*KEYS, "p.*").filter("entity is not null").distinct()


def new_entities(events: DataFrame, window: int = 7) -> DataFrame:
    """Entities not seen in the ``window`` days before, per kind; the first sight of all counts as new."""
    w = Window.partitionBy(*ACCOUNT, "kind", "entity").orderBy("day")
    seen = presence(events).withColumn("prev", F.lag("day").over(w))
    new = F.col("prev").isNull() | (F.col("prev") < F.col("day") - window)
    return seen.groupBy(*KEYS).agg(
        F.count_if(new & (F.col("kind") == "Source")).cast("int").alias("new_source_count_7d"),
        F.count_if(new & (F.col("kind") == "LogHost")).cast("int").alias("new_host_count_7d"),
        F.count_if(F.col("prev").isNull() & (F.col("kind") == "Source")).cast("int").alias("new_source_count"),
        F.min(F.when(F.col("kind") == "Source", F.col("day") - F.col("prev"))).alias("source_recency"),
    )


def days_since(matrix: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Days since the account's last active day; ``prior`` holds earlier activity (keys only), which must lie before the matrix."""
    rows = matrix.select(*KEYS, F.lit(True).alias("own"))
    if prior is not None:
        if prior.join(matrix.agg(F.min("day").alias("first")), F.col("day") >= F.col("first")).limit(1).count():
            raise ValueError("prior activity must lie before the matrix")
        rows = rows.unionByName(prior.select(*KEYS, F.lit(False).alias("own")).join(matrix.select(*ACCOUNT).distinct(), ACCOUNT, "left_semi"))
    gap = F.col("day") - F.lag("day").over(Window.partitionBy(*ACCOUNT).orderBy("day"))
    return rows.withColumn("days_since_last_activity", gap.cast("int")).filter("own").drop("own")


def at(values: Column, p: float, n: int) -> Column:
    """Linear quantile of a sorted array of n values."""
    place = p * (n - 1)
    low = int(place)
    return values[low] + (values[min(low + 1, n - 1)] - values[low]) * (place - low)


def robust_z(value: Column, middle: Column, q1: Column, q3: Column, mean_std: Column, tolerance: float = 1e-9) -> Column:
    """Deviation over IQR / 1.349, over the standard deviation where that vanishes, 0 where both do; clipped to 10."""
    iqr = (q3 - q1) / 1.349
    scale = F.when(iqr > tolerance, iqr).when(mean_std > tolerance, mean_std)
    return P.clipped(F.when(scale.isNull(), F.lit(0.0)).otherwise((value - middle) / scale))


def volume_z(matrix: DataFrame, window: int = 7, volume: str = "total_logons") -> DataFrame:
    """Robust z of log volume against the ``window`` calendar days before, inactive days counting as 0; null in the first ``window`` days.

    The past is a bounded array: the window's active days, padded with zeros, so no dense calendar is built.
    """
    v = matrix.select(*KEYS, F.log1p(volume).alias("v"))
    first = matrix.agg(F.min("day").alias("first"))
    past = Window.partitionBy(*ACCOUNT).orderBy("day").rangeBetween(-window, -1)
    v = v.withColumn("past", F.collect_list("v").over(past)).crossJoin(F.broadcast(first))  # one row
    v = v.withColumn("past", F.sort_array(F.concat("past", F.array_repeat(F.lit(0.0), F.lit(window) - F.size("past")))))
    p = F.col("past")
    mean = F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / window
    std = F.sqrt(F.aggregate(p, F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / (window - 1))
    v = v.withColumn("mean", mean).withColumn("std", std)
    z = robust_z(F.col("v"), at(p, 0.5, window), at(p, 0.25, window), at(p, 0.75, window), F.col("std"))
    return v.select(*KEYS, F.when(F.col("day") - window >= F.col("first"), z).alias("volume_robust_z_7d"))


def add_history(matrix: DataFrame, events: DataFrame, window: int = 7) -> DataFrame:
    out = matrix.join(new_entities(events, window).select(*KEYS, "new_source_count_7d", "new_host_count_7d"), KEYS, "left").na.fill(0, ["new_source_count_7d", "new_host_count_7d"])
    return out.join(days_since(matrix), KEYS, "left").join(volume_z(matrix, window), KEYS, "left")
