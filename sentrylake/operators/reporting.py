"""Tables for reports: curves, reviews, reasons, quantiles, rolling series, attributions, and how they are written out."""

from __future__ import annotations

import html
import itertools
import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.operators.baselines import ecdf_table, one_row, with_shares
from sentrylake.operators.evaluation import ranked
from sentrylake.operators.ordered import prefix_sums
from sentrylake.operators.ordered import quantiles as exact_quantiles

# ---------------------------------------------------------------- joins and windows of general use


def last_before(rows: DataFrame, events: DataFrame, keys: list[str], at: str, value: str, name: str) -> DataFrame:
    """As-of: the greatest ``value`` of the same key below the row's ``at``. One union and one window, no range join."""
    r = rows.withColumn("_own", F.lit(1)).withColumn("_t", F.col(at))
    e = events.select(*keys, F.col(value).alias("_t")).withColumn("_own", F.lit(0))
    both = r.unionByName(e, allowMissingColumns=True)
    # of equal times the row comes first, so that "before" is strict
    w = Window.partitionBy(*keys).orderBy("_t", F.desc("_own")).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(name, F.max(F.when(F.col("_own") == 0, F.col("_t"))).over(w)).filter("_own = 1").drop("_own", "_t")


def ranks(df: DataFrame, value: str, by: list[str], ties: list[str]) -> DataFrame:
    """Ordinal, least, greatest and average rank by rising value within ``by``."""
    w, same = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
    low, n = F.rank().over(w), F.count("*").over(same)
    return df.withColumns({"rank_ordinal": F.row_number().over(w.orderBy(value, *ties)), "rank_min": low, "rank_max": low + n - 1, "rank_average": low + (n - 1) / 2})


def rolling_mean(daily: DataFrame, value: str, days: int = 7, least: int = 1) -> DataFrame:
    """Over the row's day and the days before it; null with fewer than ``least`` of them."""
    w = Window.orderBy("day").rangeBetween(-(days - 1), 0)  # a daily series
    return daily.withColumn(f"{value}_rolling", F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))


def weighted_mean(df: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    seen = F.col(value).isNotNull()
    return df.groupBy(*by).agg((F.sum(F.when(seen, F.col(value) * F.col(weight))) / F.nullif(F.sum(F.when(seen, F.col(weight))), F.lit(0))).alias("weighted_mean"))


def top_values(events: DataFrame, by: list[str], value: str, k: int = 6) -> DataFrame:
    """The k most frequent values of each key; ties by value."""
    n = events.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), value))).filter(F.col("place") <= k)


def mode(events: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value; of a tie the least."""
    return top_values(events, by, value, 1).drop("place")


def gap_histogram(events: DataFrame, most: int = 30, keys: tuple[str, ...] = ("DomainName", "UserName", "day")) -> DataFrame:
    gap = events.withColumn("gap", F.col("Time") - F.lag("Time").over(Window.partitionBy(*keys).orderBy("Time")))
    return gap.filter(F.col("gap") <= most).groupBy("gap").agg(F.count("*").alias("n"))


def quantiles(df: DataFrame, value: str, by: list[str], at: Iterable[float], method: str = "nearest") -> DataFrame:
    """Exact quantiles of each group: linear, nearest or higher. Distinct values are counted first, so a group is not gathered."""
    at = list(at)
    if method == "linear":
        return exact_quantiles(df, value, at, by).select(*by, *[F.col("q")[i].alias(f"q{round(100 * p)}") for i, p in enumerate(at)])
    n = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    n = n.withColumn("upto", F.sum("n").over(w.orderBy("v"))).withColumn("all", F.sum("n").over(w))
    place = F.bround if method == "nearest" else F.ceil
    return n.groupBy(*by).agg(*[F.min(F.when(F.col("upto") > place(F.lit(p) * (F.col("all") - 1)), F.col("v"))).alias(f"q{round(100 * p)}") for p in at])


# ---------------------------------------------------------------- detection reports


def scenario_detection(scores: DataFrame, score: str, label: str, scenario: str, keys: list[str], threshold: float, per_day: int) -> DataFrame:
    """Per scenario: rows, recall at the threshold and in the daily top, and the median rank share (rank 1 is the highest)."""
    day = ranked(scores, score, keys, ["day"]).withColumnRenamed("rank", "_day")
    d = scores.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"))
    place = prefix_sums(d, "s", ["n"]).select("s", (100 * (F.col("n_all") - F.col("n_before")) / F.col("n_all")).alias("_pct"))
    hit = day.join(place, F.col(score) == F.col("s")).filter((F.col(label) == 1) & F.col(scenario).isNotNull())
    return hit.groupBy(scenario).agg(F.count("*").alias("n"), F.avg((F.col(score) >= threshold).cast("double")).alias("recall_threshold"), F.avg((F.col("_day") <= per_day).cast("double")).alias("recall_daily"), F.avg((F.col("_pct") <= 1).cast("double")).alias("recall_top1pct"), F.median("_pct").alias("median_rank_pct"))


def budget_curve(scores: DataFrame, score: str, label: str, keys: list[str], budgets: list[int]) -> DataFrame:
    """Recall by daily budget."""
    r = ranked(scores, score, keys, ["day"]).filter(F.col(label) == 1)
    return r.agg(F.count("*").alias("n"), *[F.count_if(F.col("rank") <= b).alias(f"b{b}") for b in budgets]).select("n", F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), (F.col(f"b{b}") / F.nullif("n", F.lit(0))).alias("recall")) for b in budgets])).alias("x")).select("x.*")


def top_fraction(scores: DataFrame, score: str, keys: list[str], fraction: float, how: str = "ceil") -> DataFrame:
    """The highest share of all rows: rounded up, or to the nearest (half to even, at least one). A report of that many rows."""
    n = scores.count()
    size = math.ceil(fraction * n) if how == "ceil" else min(max(1, round(fraction * n)), n)
    return scores.orderBy(F.desc(score), *keys).limit(size)


def budget_needed(scores: DataFrame, score: str, label: str, scenario: str, keys: list[str]) -> DataFrame:
    """Daily budgets at which half and four fifths of a scenario's rows are caught."""
    r = ranked(scores, score, keys, ["day"]).filter((F.col(label) == 1) & F.col(scenario).isNotNull())
    return quantiles(r, "rank", [scenario], [0.5, 0.8], "higher").withColumnsRenamed({"q50": "k50", "q80": "k80"})


def complementarity(alerts: DataFrame, label: str, models: list[str]) -> DataFrame:
    """Positives caught by each set of models (boolean columns), the empty set being the missed ones."""
    caught = F.concat_ws("+", *[F.when(F.col(m), F.lit(m)) for m in models])
    return alerts.filter(F.col(label) == 1).groupBy(caught.alias("models")).agg(F.count("*").alias("n"))


def daily_scoring(scored: DataFrame, train, features: list[str], score: str, keys: list[str], threshold: float, reasons: int = 3) -> DataFrame:
    """Rank, alert flag, and the features that lie farthest out in the training distribution, with the share beyond."""
    out = with_shares(scored, {c: ecdf_table(scored, train, c, f"_m_{c}", "mid") for c in features})
    tail = lambda c: F.least(F.col(f"_m_{c}"), 1 - F.col(f"_m_{c}"))
    why = F.slice(F.array_sort(F.array(*[F.struct(F.coalesce(tail(c), F.lit(0.5)).alias("beyond"), F.lit(c).alias("feature")) for c in features])), 1, reasons)
    out = ranked(out, score, keys, ["day"]).withColumn("alert", F.col(score) >= threshold)
    return out.select(*keys, score, "rank", "alert", F.transform(why, lambda x: x["feature"]).alias("reasons"))


def review_set(scored: DataFrame, train, models: list[str], features: list[str], keys: list[str], n: int) -> DataFrame:
    """The top n of each model, with each feature's deviation in training IQRs (long form)."""
    parts = None
    for m in models:
        top = scored.orderBy(F.desc(m), *keys).limit(n).withColumn("model", F.lit(m))  # a top-n report
        parts = top if parts is None else parts.unionByName(top)
    wide = one_row(parts, [exact_quantiles(scored.filter(train), c, [0.25, 0.5, 0.75, 0.99], name=f"_q_{c}") for c in features])

    def one(c: str):
        p = F.col(f"_q_{c}")
        return F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), ((F.col(c) - p[1]) / F.nullif(p[2] - p[0], F.lit(0.0))).alias("deviation"), (F.col(c) > p[3]).alias("beyond_p99"))

    return wide.select("model", *keys, F.explode(F.array(*[one(c) for c in features])).alias("f")).select("model", *keys, "f.*")


def score_summary(scores: DataFrame, score: str, model: str) -> DataFrame:
    """One experiment-log row: count, mean, deviation and seven quantiles."""
    at = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    one = scores.agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.min(score).alias("min"), F.max(score).alias("max")).crossJoin(F.broadcast(exact_quantiles(scores, score, at)))  # one row each
    return one.select(F.lit(model).alias("model"), "n", "mean", "std", "min", "max", *[F.col("q")[i].alias(f"p{round(100 * p)}") for i, p in enumerate(at)])


def candidate_counts(events: DataFrame, day: int, gaps: list[int], type_shares: list[float]) -> DataFrame:
    """How many accounts qualify as dormant or as having a dominant logon type, by threshold."""
    last = events.groupBy("DomainName", "UserName").agg(F.max(F.when(F.col("day") < day, F.col("day"))).alias("last"), F.bool_or(F.col("day") == day).alias("there"))
    n = events.groupBy("DomainName", "UserName", "LogonType").agg(F.count("*").alias("n")).groupBy("DomainName", "UserName").agg((F.max("n") / F.sum("n")).alias("share"))
    idle = last.agg(*[F.count_if(~F.col("there") & (F.lit(day) - F.col("last") >= g)).alias(f"g{g}") for g in gaps])
    main = n.agg(*[F.count_if(F.col("share") >= s).alias(f"s{round(100 * s)}") for s in type_shares])
    rows = [F.struct(F.lit("gap").alias("kind"), F.lit(float(g)).alias("threshold"), F.col(f"g{g}").alias("accounts")) for g in gaps]
    rows += [F.struct(F.lit("share").alias("kind"), F.lit(s).alias("threshold"), F.col(f"s{round(100 * s)}").alias("accounts")) for s in type_shares]
    return idle.crossJoin(main).select(F.explode(F.array(*rows)).alias("r")).select("r.*")  # one row each


# ---------------------------------------------------------------- attribution


def shapley(score, background: np.ndarray, rows: np.ndarray, permutations: int = 32, seed: int = 42) -> np.ndarray:
    """Sampled Shapley values of a score function on a bounded set of rows: each row's features enter in random orders."""
    rng = np.random.default_rng(seed)
    out = np.zeros(rows.shape)
    for _ in range(permutations):
        order, base = rng.permutation(rows.shape[1]), background[rng.integers(0, len(background), len(rows))].copy()
        before = score(base)
        for f in order:
            base[:, f] = rows[:, f]
            after = score(base)
            out[:, f] += after - before
            before = after
    return out / permutations


def local_linear(score, row: np.ndarray, scale: np.ndarray, draws: int = 500, seed: int = 42) -> np.ndarray:
    """Weights of a locally fitted linear model around one row."""
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(draws, len(row)))
    near = np.exp(-(z**2).sum(1) / (2 * len(row)))
    design = np.column_stack([np.ones(draws), z]) * np.sqrt(near)[:, None]
    return np.linalg.lstsq(design, score(row + z * scale) * np.sqrt(near), rcond=None)[0][1:]


# ---------------------------------------------------------------- configurations and grids


def resolved(defaults: dict, block: dict | None = None, explicit: dict | None = None, allowed: Iterable[str] | None = None) -> dict:
    """Explicit values over a model's block over defaults; unknown names are an error."""
    names = set(allowed if allowed is not None else defaults)
    for part in (block or {}, explicit or {}):
        if set(part) - names:
            raise ValueError(f"unknown parameters: {sorted(set(part) - names)}")
    return {**defaults, **(block or {}), **(explicit or {})}


def grid(parameters: dict[str, list]) -> list[dict]:
    return [dict(zip(parameters, values)) for values in itertools.product(*parameters.values())]


# ---------------------------------------------------------------- writing


def markdown(df: DataFrame, title: str) -> str:
    """A report table (results are a few rows; never raw data)."""
    rows = [["" if v is None else str(v) for v in r] for r in df.collect()]
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in rows]) + "\n"


def page(title: str, tables: dict[str, DataFrame]) -> str:
    parts = [f"<h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in df.collect())
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "<!doctype html><meta charset=utf-8>" + "".join(parts)


def write_csv(df: DataFrame, path: str) -> None:
    """A report table as one CSV file."""
    df.toPandas().to_csv(path, index=False, encoding="utf-8")

