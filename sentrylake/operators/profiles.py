"""Train-only behaviour profiles, lockout episodes and inactivity gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.functions import predicates as P

ACCOUNT = ["DomainName", "UserName"]


def train_only(events: DataFrame, first: int, last: int) -> DataFrame:
    """Days of the block; every day of it must be there."""
    rows = events.filter(F.col("day").between(first, last))
    have = rows.agg(F.count_distinct("day")).first()[0]
    if have != last - first + 1:
        raise ValueError(f"{have} of {last - first + 1} days are there")
    return rows


def accounts(events: DataFrame) -> DataFrame:
    per_day = events.groupBy(*ACCOUNT, "day").agg(F.count("*").alias("n"))
    active = per_day.groupBy(*ACCOUNT).agg(F.count("*").alias("active_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.median("n").alias("median_daily_events"))
    pooled = events.groupBy(*ACCOUNT).agg(
        F.count("*").alias("n_events"),
        F.count_if(F.col("EventID") == 4624).alias("n_success"),
        F.count_if(F.col("EventID") == 4625).alias("n_fail"),
        F.count_distinct(F.when(P.profile_source(F.col("Source")), F.col("Source"))).alias("n_sources"),
        F.count_distinct(F.when(P.present(F.col("LogHost")), F.col("LogHost"))).alias("n_hosts"),
        (F.count_if(P.off_hours(F.col("Time"))) / F.count("*")).alias("off_hours_ratio"),
        F.max(P.entity_type(F.col("UserName"))).alias("entity_type"),
    )
    return pooled.join(active, ACCOUNT)


def account_values(events: DataFrame, column: str) -> DataFrame:
    """Known sources or hosts of an account: events, successes, days."""
    usable = P.profile_source(F.col(column)) if column == "Source" else P.present(F.col(column))
    return events.filter(usable).groupBy(*ACCOUNT, column).agg(F.count("*").alias("n_events"), F.count_if(F.col("EventID") == 4624).alias("n_success"), F.count_distinct("day").alias("n_days"))


def logon_type_shares(events: DataFrame) -> DataFrame:
    n = events.filter("LogonType is not null").groupBy(*ACCOUNT, "LogonType").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*ACCOUNT)))


def gaps(events: DataFrame) -> DataFrame:
    """Leading, internal and trailing runs of inactive days, on the calendar of days that were read."""
    calendar = events.select("day").distinct()
    ranked = calendar.withColumn("r", F.row_number().over(Window.orderBy("day")))  # one row a day
    n = ranked.agg(F.max("r").alias("n"))
    active = events.select(*ACCOUNT, "day").distinct().join(F.broadcast(ranked), "day").crossJoin(F.broadcast(n))
    w = Window.partitionBy(*ACCOUNT).orderBy("r")
    active = active.withColumn("prev", F.lag("r").over(w)).withColumn("next", F.lead("r").over(w))
    kinds = F.array(
        F.when(F.col("prev").isNull() & (F.col("r") > 1), F.struct(F.lit("leading").alias("kind"), (F.col("r") - 1).alias("length"), F.lit(1).alias("from"))),
        F.when(F.col("r") - F.col("prev") > 1, F.struct(F.lit("internal").alias("kind"), (F.col("r") - F.col("prev") - 1).alias("length"), (F.col("prev") + 1).alias("from"))),
        F.when(F.col("next").isNull() & (F.col("r") < F.col("n")), F.struct(F.lit("trailing").alias("kind"), (F.col("n") - F.col("r")).alias("length"), (F.col("r") + 1).alias("from"))),
    )
    return active.select(*ACCOUNT, F.explode(F.array_compact(kinds)).alias("g")).select(*ACCOUNT, "g.kind", "g.length", F.col("g.from").alias("from_rank"))


def hosts(events: DataFrame) -> DataFrame:
    """Roles of each machine: seen as host, as source, by how many accounts, on how many days."""
    roles = F.array(F.struct(F.lit("loghost").alias("role"), F.when(P.present(F.col("LogHost")), F.col("LogHost")).alias("host")), F.struct(F.lit("source").alias("role"), F.when(P.profile_source(F.col("Source")), F.col("Source")).alias("host")))
    rows = events.select(*ACCOUNT, "day", F.explode(roles).alias("x")).select(*ACCOUNT, "day", "x.*").filter("host is not null")
    who = F.struct(*ACCOUNT)
    return rows.groupBy("host").agg(
        F.count("*").alias("n_events"),
        F.count_distinct("day").alias("n_days"),
        F.count_distinct(who).alias("n_accounts"),
        F.count_distinct(F.when(F.col("role") == "loghost", who)).alias("n_accounts_loghost"),
        F.count_distinct(F.when(F.col("role") == "source", who)).alias("n_accounts_source"),
        F.count_distinct(F.when(F.col("UserName").startswith("User"), who)).alias("n_accounts_user"),
    )


def lockouts(events: DataFrame, gap: int = 1800) -> DataFrame:
    """Episodes: a lock with none in the ``gap`` seconds before. ``streak`` counts the wrong passwords that lead up to it
    with gaps of at most ``gap``, other failures breaking it and successes not; ``in_window`` those of the last ``gap`` seconds."""
    order = Window.partitionBy(*ACCOUNT).orderBy("Time", "event_id")
    f = events.filter("EventID = 4625").withColumn("kind", P.failure_kind(F.col("EventID"), F.col("FailureReason")))
    f = f.withColumn("link", F.coalesce((F.lag("kind").over(order) == "bad_pw") & (F.col("Time") - F.lag("Time").over(order) <= gap), F.lit(False))).withColumn("rn", F.row_number().over(order))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("streak", F.col("rn") - F.last(F.when(~F.col("link"), F.col("rn")), ignorenulls=True).over(so_far))
    before = F.coalesce(F.count_if(F.col("kind") == "bad_pw").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    past = Window.partitionBy(*ACCOUNT).orderBy("Time").rangeBetween(Window.unboundedPreceding, -gap - 1)
    f = f.withColumn("in_window", before - F.coalesce(F.count_if(F.col("kind") == "bad_pw").over(past), F.lit(0)))
    locked = f.filter("kind = 'locked'").withColumn("prev", F.lag("Time").over(order))
    return locked.filter(F.col("prev").isNull() | (F.col("Time") - F.col("prev") > gap)).select(*ACCOUNT, "day", "Time", "event_id", "streak", "in_window")


def lockout_threshold(episodes: DataFrame) -> DataFrame:
    """The most frequent streak of at least 1 (ties: the least), its support and the median."""
    some = episodes.filter("streak >= 1")
    n = some.groupBy("streak").agg(F.count("*").alias("n"))
    best = n.agg(F.max_by("streak", F.struct("n", -F.col("streak"))).alias("threshold"), F.max("n").alias("support"), F.sum("n").alias("episodes"))
    return best.crossJoin(some.agg(F.median("streak").alias("median_streak")))


def failures_before_lock(events: DataFrame) -> DataFrame:
    """The other estimator: failures before the first lock of an account-day; its rounded-up median and quartiles."""
    keys = [*ACCOUNT, "day"]
    f = events.filter("EventID = 4625").withColumn("kind", P.failure_kind(F.col("EventID"), F.col("FailureReason")))
    first = Window.partitionBy(*keys)
    f = f.withColumn("lock", F.min(F.when(F.col("kind") == "locked", F.col("Time"))).over(first))
    n = f.filter("lock is not null").groupBy(*keys).agg(F.count_if((F.col("kind") != "locked") & (F.col("Time") < F.col("lock"))).alias("n")).filter("n > 0")
    return n.agg(F.count("*").alias("n_days"), F.ceil(F.percentile("n", 0.5)).alias("threshold"), F.percentile("n", 0.25).alias("p25"), F.percentile("n", 0.75).alias("p75"))


def rule_statistics(events: DataFrame) -> DataFrame:
    """R2 (accounts failing from one of the day's own sources), R4 (sources never seen before), R6 (events of a logon type never seen before)."""
    keys = [*ACCOUNT, "day"]
    days = events.select(*keys).distinct().withColumn("first", F.min("day").over(Window.partitionBy(*ACCOUNT)))
    fails = events.filter((F.col("EventID") == 4625) & P.profile_source(F.col("Source"))).select(*keys, "Source").distinct()
    # accounts of a source are counted before they meet the accounts again: a source that all use is one row
    spray = fails.join(fails.groupBy("day", "Source").agg(F.count("*").alias("m")), ["day", "Source"]).groupBy(*keys).agg(F.max("m").alias("r2"))

    def unseen(value: str, usable, count) -> DataFrame:
        rows = events.filter(usable).groupBy(*keys, value).agg(F.count("*").alias("n"))
        return rows.withColumn("seen", F.min("day").over(Window.partitionBy(*ACCOUNT, value))).filter("seen = day").groupBy(*keys).agg(count.alias(value))

    sources = unseen("Source", P.profile_source(F.col("Source")), F.count("*"))
    types = unseen("LogonType", F.col("LogonType").isNotNull(), F.sum("n"))
    out = days.join(spray, keys, "left").join(sources, keys, "left").join(types, keys, "left")
    later = lambda c: F.when(F.col("day") > F.col("first"), F.coalesce(c, F.lit(0)))
    return out.select(*keys, F.coalesce("r2", F.lit(0)).alias("r2_spray_accounts"), later("Source").alias("r4_new_sources"), later("LogonType").alias("r6_new_logontype_events"))


def known_values(events: DataFrame, column: str) -> DataFrame:
    """DomainName, UserName, known (sorted array): every usable value that an account has; values of an account are few."""
    usable = events.filter(P.profile_source(F.col(column))).select(*ACCOUNT, F.col(column).alias("v")).distinct()
    return usable.groupBy(*ACCOUNT).agg(F.array_sort(F.collect_list("v")).alias("known"))


def save_profiles(tables: dict[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_profiles(spark, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The named tables; one that is absent is an error when it is read here, not later."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def account(tables: dict[str, DataFrame], domain: str, user: str) -> dict[str, DataFrame]:
    """Every table's rows of one account."""
    return {name: t.filter((F.col("DomainName") == domain) & (F.col("UserName") == user)) for name, t in tables.items()}
