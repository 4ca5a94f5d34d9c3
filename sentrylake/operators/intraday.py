"""Account-by-day features of one day's events, from two aggregations: events by second, and events by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.functions import predicates as P

KEYS = ["DomainName", "UserName", "day"]


def evenness(h: Column, states: Column) -> Column:
    """Entropy over the log of the number of states; 0 for one state or none."""
    return F.when(states > 1, h / F.ln(states.cast("double"))).otherwise(F.lit(0.0))


def seconds(events: DataFrame) -> DataFrame:
    """One row per (account-day, second) with its counts: at most 86,400 a day, however busy the account is."""
    failed = F.col("EventID") == 4625
    process = F.lower("ProcessName").startswith("proc") if "ProcessName" in events.columns else F.lit(False)
    source = F.col("Source")
    return events.groupBy(*KEYS, "Time").agg(
        F.count("*").alias("n"),
        F.count_if(failed).alias("_fail"),
        F.count_if(failed & F.lower("FailureReason").contains("account locked out")).alias("_locked"),
        F.count_if(F.col("LogonType") == 2).alias("_interactive"),
        F.count_if(~F.col("LogonType").isin(2, 3)).alias("rare_logon_type_count"),
        F.count_if(F.lower("AuthenticationPackage").contains("ntlm")).alias("_ntlm"),
        F.count_if(P.blank(source) | (source == "Unknown")).alias("_missing"),
        F.count_if(source.isNotNull() & (P.stripped(source) != "Unknown") & (source != F.col("LogHost"))).alias("_remote"),
        F.count_if(process).alias("_custom"),
    )


def hosts_and_sources(events: DataFrame) -> DataFrame:
    """Per account-day: distinct hosts (null is one) and sources, and the evenness of the usable hosts."""
    host, source = F.col("LogHost"), F.col("Source")
    kinds = F.array(
        F.struct(F.lit("host").alias("kind"), host.alias("v")),
        F.struct(F.lit("usable").alias("kind"), F.when(P.present(host), P.stripped(host)).alias("v")),
        F.struct(F.lit("source").alias("kind"), F.when(source != "Unknown", source).alias("v")),
    )
    n = events.select(*KEYS, F.explode(kinds).alias("x")).filter("x.v is not null or x.kind = 'host'").groupBy(*KEYS, "x.kind", "x.v").agg(F.count("*").alias("n"))
    usable = F.col("kind") == "usable"
    agg = n.groupBy(*KEYS).agg(
        F.count_if(F.col("kind") == "host").alias("distinct_hosts"),
        F.count_if(F.col("kind") == "source").alias("distinct_sources_count"),
        F.count_if(usable).alias("k"),
        F.sum(F.when(usable, F.col("n"))).alias("t"),
        F.sum(F.when(usable, F.col("n") * F.ln(F.col("n").cast("double")))).alias("s"),
    )
    # H = ln N - sum(n ln n) / N, so no second look at the total is needed
    h = F.ln(F.col("t").cast("double")) - F.col("s") / F.col("t")
    return agg.select(*KEYS, "distinct_hosts", "distinct_sources_count", F.coalesce(evenness(h, F.col("k")), F.lit(0.0)).alias("dst_host_entropy"))


def account_days(events: DataFrame) -> DataFrame:
    """One row per (DomainName, UserName, day): volume, ratios, gaps, peak hour, evenness, distinct hosts and sources, entity type."""
    by = Window.partitionBy(*KEYS).orderBy("Time")
    # gaps within a second are 0: each second brings n - 1 of them and one to the second before
    rows = seconds(events).withColumn("gap", (F.col("Time") - F.lag("Time").over(by)).cast("double")).withColumn("hour", P.hour(F.col("Time")))
    total = lambda c: F.sum(c).alias(c)
    agg = rows.groupBy(*KEYS).agg(
        F.sum("n").alias("total_logons"),
        *[total(c) for c in ("_fail", "_locked", "_interactive", "rare_logon_type_count", "_ntlm", "_missing", "_remote", "_custom")],
        F.sum(F.when(P.off_hours(F.col("Time")), F.col("n")).otherwise(0)).alias("_off"),
        (F.sum("n") - F.count("*")).alias("_same"),
        (F.max("Time") - F.min("Time")).cast("double").alias("_length"),
        F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0.0)).alias("_squares"),
        F.array(*[F.sum(F.when(F.col("hour") == h, F.col("n")).otherwise(0)) for h in range(24)]).alias("_hours"),
    )
    share = lambda c: (F.col(c) / F.col("total_logons"))
    gaps = F.col("total_logons") - 1
    mean = F.when(gaps > 0, F.col("_length") / gaps)
    spread = F.sqrt(F.greatest((F.col("_squares") - F.col("_length") * F.col("_length") / gaps) / (gaps - 1), F.lit(0.0)))
    agg = agg.withColumn("interarrival_dt_mean", mean).withColumn("_gap_std", F.when(gaps > 1, spread))
    used = F.filter("_hours", lambda n: n > 0)
    agg = agg.withColumn("_sum", F.aggregate(used, F.lit(0.0), lambda a, n: a + n * F.ln(n.cast("double")))).withColumn("_k", F.size(used))
    peak = F.array_position("_hours", F.array_max("_hours")) - 1
    turn = 2 * 3.141592653589793 / 24
    out = agg.select(
        *KEYS,
        P.entity_type(F.col("UserName")).alias("entity_type"),
        "total_logons",
        share("_fail").alias("failure_ratio"),
        F.when(F.col("_fail") > 0, F.col("_locked") / F.col("_fail")).alias("failure_locked_out_share"),
        share("_off").alias("off_hours_ratio"),
        "interarrival_dt_mean",
        F.when(F.col("interarrival_dt_mean") > 0, F.col("_gap_std") / F.col("interarrival_dt_mean")).alias("delta_t_cv"),
        share("_same").alias("same_second_share"),
        (F.col("total_logons") == 1).cast("int").alias("is_single_event"),
        share("_interactive").alias("interactive_ratio"),
        "rare_logon_type_count",
        share("_ntlm").alias("ntlm_ratio"),
        share("_missing").alias("missing_source_ratio"),
        share("_remote").alias("remote_logon_ratio"),
        share("_custom").alias("custom_proc_share"),
        evenness(F.ln(F.col("total_logons").cast("double")) - F.col("_sum") / F.col("total_logons"), F.col("_k")).alias("hour_entropy"),
        F.sin(peak * turn).alias("activity_peak_hour_sin"),
        F.cos(peak * turn).alias("activity_peak_hour_cos"),
    )
    return out.join(hosts_and_sources(events), KEYS)


def processed(matrix: DataFrame) -> DataFrame:
    """The processed tier: log columns, and zeros for the three ratios that may be undefined."""
    out = matrix.withColumn("log_total_logons", F.log1p("total_logons")).withColumn("log_distinct_hosts", F.log1p("distinct_hosts")).withColumn("rare_logon_type_count_log", F.log1p("rare_logon_type_count"))
    return out.na.fill(0.0, ["failure_locked_out_share", "interarrival_dt_mean", "delta_t_cv"])


def failure_streaks(events: DataFrame) -> DataFrame:
    """Optional: longest run of failures, and the share of successes right after a failure."""
    w = Window.partitionBy(*KEYS).orderBy("Time", "event_id")
    flagged = events.withColumn("f", (F.col("EventID") == 4625).cast("int")).withColumn("g", F.sum(1 - F.col("f")).over(w)).withColumn("p", F.lag("f").over(w))
    run = flagged.groupBy(*KEYS, "g").agg(F.sum("f").alias("run")).groupBy(*KEYS).agg(F.max("run").alias("max_failure_streak"))
    after = flagged.groupBy(*KEYS).agg(F.count_if((F.col("f") == 0) & (F.col("p") == 1)).alias("a"), F.count_if(F.col("f") == 0).alias("s"))
    return run.join(after.select(*KEYS, F.coalesce(P.ratio(F.col("a"), F.col("s")), F.lit(0.0)).alias("success_after_failure_ratio")), KEYS)


def validate(matrix: DataFrame, ratios: list[str], keys: list[str] = KEYS, slack: float = 1e-6) -> DataFrame:
    """One aggregate job: rows, distinct keys, null keys, and per ratio the rows outside [0, 1]."""
    bad = [F.count_if((F.col(r) < -slack) | (F.col(r) > 1 + slack)).alias(f"out_of_range_{r}") for r in ratios]
    nulls = F.count_if(F.greatest(*[F.col(k).isNull().cast("int") for k in keys]) == 1).alias("null_keys")
    return matrix.agg(F.count("*").alias("rows"), F.count_distinct(F.struct(*keys)).alias("distinct_keys"), nulls, *bad)
