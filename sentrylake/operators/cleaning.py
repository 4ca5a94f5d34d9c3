"""Cleaning and quality checks of event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.functions import predicates as P


def clean(events: DataFrame, shift_dst: bool = False, dst_start_day: int = 42, dst_seconds: int = 3600, dedupe: bool = True) -> DataFrame:
    """Drops rows without a usable account, normalises, fills, optionally shifts times, and drops equal rows."""
    out = events.filter(P.valid_user(F.col("UserName"))).withColumn("DomainName", P.normal_domain(F.col("DomainName")))
    for c in ("LogonID", "Source"):
        if c in out.columns:
            out = out.withColumn(c, P.or_unknown(F.col(c)))
    if "LogonTypeDescription" in out.columns:
        out = out.withColumn("LogonTypeDescription", P.logon_description(F.col("LogonTypeDescription"), F.col("LogonType")))
    if shift_dst:
        out = out.withColumn("Time", P.shifted_time(F.col("Time"), F.col("day"), dst_start_day, dst_seconds))
    return out.dropDuplicates() if dedupe else out


def cleaning_totals(before: DataFrame, after: DataFrame) -> DataFrame:
    a = before.groupBy("day").agg(F.count("*").alias("rows_in"))
    return a.join(after.groupBy("day").agg(F.count("*").alias("rows_out")), "day", "left").select("day", "rows_in", F.coalesce("rows_out", F.lit(0)).alias("rows_out"))


def duplicates(events: DataFrame, columns: list[str]) -> DataFrame:
    """n_rows, n_in_duplicates (all members), n_excess (members but one)."""
    n = events.groupBy(*columns).agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_in_duplicates"), F.sum(F.col("n") - 1).alias("n_excess"))


def bursty(events: DataFrame, seconds: int = 2, keys: tuple[str, ...] = ("day", "UserName", "LogHost", "LogonType")) -> DataFrame:
    """Successes at most ``seconds`` after the one before of the same key, by day."""
    w = Window.partitionBy(*keys).orderBy("Time")
    gap = events.filter("EventID = 4624").withColumn("gap", F.col("Time") - F.lag("Time").over(w))
    return gap.groupBy("day").agg(F.count("*").alias("n_success"), F.count_if(F.col("gap") <= seconds).alias("n_bursty"))


def survey(events: DataFrame) -> DataFrame:
    """One row a day: volume, failures, distinct accounts and hosts (null is a value), machine and off-hours shares, weekend guess."""
    with_null = lambda c: F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))
    day = events.groupBy("day").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("EventID") == 4625).alias("failures"),
        with_null("UserName").alias("users"),
        with_null("LogHost").alias("hosts"),
        F.count_if(F.col("UserName").endswith("$")).alias("machine"),
        F.count_if(P.off_hours(F.col("Time"), last=6)).alias("off_hours"),
    )
    middle = day.agg(F.median("total").alias("m"))
    day = day.crossJoin(F.broadcast(middle))  # one row
    return day.select(
        "day",
        "total",
        "failures",
        "users",
        "hosts",
        (100 * F.col("failures") / F.col("total")).alias("failure_pct"),
        (100 * F.col("machine") / F.col("total")).alias("machine_pct"),
        (100 * F.col("off_hours") / F.col("total")).alias("off_hours_pct"),
        (F.col("total") < 0.75 * F.col("m")).alias("weekend_like"),
    )


def column_quality(events: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls, distinct values, least and greatest of every column, in one aggregation."""
    one = events.agg(F.count("*").alias("n"), *[x for c in columns for x in (F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"), F.count_distinct(c).alias(f"{c}__distinct"), F.min(F.col(c).cast("string")).alias(f"{c}__min"), F.max(F.col(c).cast("string")).alias(f"{c}__max"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__nulls").alias("nulls"), F.col(f"{c}__distinct").alias("n_distinct"), F.col(f"{c}__min").alias("least"), F.col(f"{c}__max").alias("greatest")) for c in columns])
    return one.select("n", F.explode(rows).alias("r")).select("r.*", (100 * F.col("r.nulls") / F.nullif(F.col("n"), F.lit(0))).alias("null_pct"))


def sanity(events: DataFrame) -> DataFrame:
    """Counts of rows that break a rule."""
    return events.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("EventID").isNull() | ~F.col("EventID").isin(4624, 4625)).alias("bad_event_id"),
        F.count_if(F.col("Time") < 0).alias("negative_time"),
        F.count_if((F.col("EventID") == 4624) & ~P.blank(F.col("FailureReason"))).alias("success_with_reason"),
        F.count_if((F.col("EventID") == 4625) & P.blank(F.col("FailureReason"))).alias("failure_without_reason"),
        F.count_if(F.floor(F.col("Time") / P.DAY) + 1 != F.col("day")).alias("outside_day"),
    )


def reconcile(raw: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("day", "EventID")) -> DataFrame:
    a, b = raw.groupBy(*keys).agg(F.count("*").alias("raw_rows")), stored.groupBy(*keys).agg(F.count("*").alias("stored_rows"))
    both = a.join(b, list(keys), "full").na.fill(0, ["raw_rows", "stored_rows"])
    return both.withColumn("difference", F.col("stored_rows") - F.col("raw_rows")).withColumn("ok", F.col("difference") == 0)


def hourly(events: DataFrame) -> DataFrame:
    """Events by hour of day on the whole spine 0 to 23."""
    spine = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    n = events.withColumn("hour", P.hour(F.col("Time"))).groupBy("hour").agg(F.count("*").alias("n"), F.count_if(F.col("EventID") == 4625).alias("failures"))
    return spine.join(n, "hour", "left").na.fill(0)


def missing_by(events: DataFrame, column: str, group: str) -> DataFrame:
    n = events.groupBy(group).agg(F.count("*").alias("n"), F.count_if(P.blank(F.col(column)) | (F.col(column) == "Unknown")).alias("missing"))
    return n.withColumn("missing_pct", 100 * F.col("missing") / F.col("n"))


def cramers_v(events: DataFrame, a: str, b: str) -> DataFrame:
    """Association of two columns; pairs with a null are left out."""
    cells = events.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("o"))
    # chi2 / n = sum(o^2 / (row * column)) - 1, so empty cells need not be made
    row, column = Window.partitionBy(a), Window.partitionBy(b)
    each = cells.withColumn("q", F.col("o").cast("double") * F.col("o") / (F.sum("o").over(row).cast("double") * F.sum("o").over(column)))
    total = each.agg(F.sum("q").alias("q"), F.sum("o").alias("n"), F.least(F.count_distinct(a), F.count_distinct(b)).alias("k"))
    return total.select("n", F.sqrt(F.greatest(F.col("q") - 1, F.lit(0.0)) / F.nullif(F.col("k") - 1, F.lit(0))).alias("cramers_v"))
