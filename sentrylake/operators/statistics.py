"""Diagnostics: moments, correlation and collinearity, rank tests, drift, agreement."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.operators.ordered import prefix_sums, quantiles


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """n, mean, sd, bias-corrected skewness and kurtosis, zero share, quartiles of every column, in one aggregation."""
    aggs = [F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.skewness(c).alias("g1"), F.kurtosis(c).alias("g2"), F.avg((F.col(c) == 0).cast("double")).alias("zero_share"), F.percentile(c, [0.25, 0.5, 0.75]).alias("q")).alias(c) for c in columns]
    r = df.agg(*aggs).select(F.explode(F.array(*columns)).alias("r")).select("r.*")
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1"))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return r.select("feature", "n", "mean", "sd", skew.alias("skewness"), kurt.alias("kurtosis"), "zero_share", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")).alias(f"{a}__{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[f"`{a}__{b}`" for a, b in pairs])).alias("p")).select("p.*")


def vif(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Diagonal of the inverse correlation matrix (as many rows as pairs of columns reach the driver), and its condition number."""
    r = np.eye(len(columns))
    for x in correlations(df, columns).collect():
        i, j = columns.index(x["a"]), columns.index(x["b"])
        r[i, j] = r[j, i] = 0.0 if x["r"] is None else x["r"]
    out = dict(zip(columns, np.diag(np.linalg.pinv(r)).tolist()))
    return out | {"condition_number": float(np.linalg.cond(r))}


def rank_sum(df: DataFrame, value: str, group: str) -> DataFrame:
    """Mann-Whitney U of group 1 against group 0 with average ranks: AUC, Cliff's delta, and the normal approximation's z."""
    d = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(group) == 1).alias("a"), F.count_if(F.col(group) == 0).alias("b"))
    u = prefix_sums(d, "v", ["b"]).withColumn("u", F.col("a").cast("double") * (F.col("b_before") + F.col("b") / 2)).agg(F.sum("u").alias("u"), F.sum("a").alias("n1"), F.sum("b").alias("n0"))
    nm = F.nullif(F.col("n1") * F.col("n0"), F.lit(0)).cast("double")
    return u.select("n1", "n0", (F.col("u") / nm).alias("auc"), (2 * F.col("u") / nm - 1).alias("cliffs_delta"), ((F.col("u") - nm / 2) / F.sqrt(nm * (F.col("n1") + F.col("n0") + 1) / 12)).alias("z"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa and agreement of two columns of labels."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    rows, columns = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("rb"))
    chance = rows.join(columns, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("ra").cast("double") * F.col("rb")), F.lit(0.0)).alias("c"))
    x = total.crossJoin(chance)
    po, pe = F.col("same") / F.col("t"), F.col("c") / (F.col("t").cast("double") * F.col("t"))
    return x.select(F.col("t").alias("n"), po.alias("agreement"), ((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def autocorrelation(daily: DataFrame, value: str, lags: int = 14) -> DataFrame:
    """Of a daily series (one row a day)."""
    mean = daily.agg(F.avg(value).alias("m"), F.var_pop(value).alias("s2"), F.count("*").alias("days"))
    d = daily.crossJoin(mean).withColumn("x", F.col(value) - F.col("m"))
    later = d.select(F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"), "day", "x").select("lag", (F.col("day") - F.col("lag")).alias("day"), F.col("x").alias("y"))
    return d.join(later, "day").groupBy("lag").agg((F.sum(F.col("x") * F.col("y")) / F.nullif(F.max("days") * F.max("s2"), F.lit(0.0))).alias("acf"))


def trend(daily: DataFrame, value: str) -> DataFrame:
    """Theil-Sen slope: the median slope over pairs of days (a daily series, so pairs are few)."""
    a, b = daily.select("day", F.col(value).alias("y")), daily.select(F.col("day").alias("day2"), F.col(value).alias("y2"))
    return a.join(b, F.col("day2") > F.col("day")).agg(F.median((F.col("y2") - F.col("y")) / (F.col("day2") - F.col("day"))).alias("slope"))


def phase_profile(daily: DataFrame, value: str, period: int = 7) -> DataFrame:
    """Mean by phase of the week, and the share of variance that the phase explains."""
    p = daily.withColumn("phase", F.pmod("day", F.lit(period)))
    whole = p.agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"), F.count("*").alias("n"))
    by = p.groupBy("phase").agg(F.avg(value).alias("mean"), F.count("*").alias("days")).crossJoin(whole)
    return by.withColumn("r2", F.sum(F.col("days") * F.pow(F.col("mean") - F.col("m"), 2)).over(Window.partitionBy()) / F.nullif(F.col("n") * F.col("v"), F.lit(0.0))).select("phase", "days", "mean", "r2")


def information(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null share and modal share (values to nine decimals) of every column."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.col(c).cast("double"), 9).alias("v")) for c in columns])).alias("x")).select("x.*")
    n = long.groupBy("feature", "v").agg(F.count("*").alias("n"))
    return n.groupBy("feature").agg((F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("null_share"), F.coalesce(F.max(F.when(F.col("v").isNotNull(), F.col("n"))) / F.nullif(F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)), F.lit(0)), F.lit(1.0)).alias("modal_share"))


def select_features(df: DataFrame, core: list[str], candidates: list[str], most_r: float = 0.85, most_vif: float = 10.0, limit: int = 15) -> list[str]:
    """Greedy, in the order given: not correlated beyond ``most_r`` with what is in, and no variance inflation beyond ``most_vif``."""
    columns = core + candidates
    filled = df.na.fill(0.0, columns)
    r = {(x["a"], x["b"]): abs(x["r"] or 0.0) for x in correlations(filled, columns).collect()}
    r |= {(b, a): v for (a, b), v in r.items()}
    chosen: list[str] = []
    for c in candidates:
        inside = core + chosen
        if len(chosen) >= limit or any(r[c, x] >= most_r for x in inside):
            continue
        m = np.array([[1.0 if a == b else r[a, b] for b in [*inside, c]] for a in [*inside, c]])
        if np.diag(np.linalg.pinv(m)).max() <= most_vif:
            chosen.append(c)
    return chosen


def unchanged_without(last: DataFrame, shorter: DataFrame, keys: list[str], columns: list[str], eps: float = 1e-9) -> DataFrame:
    """Leakage test: features of earlier days must not move when later days are cut off. Rows that differ, by column."""
    j = last.join(shorter.select(*keys, *[F.col(c).alias(f"{c}__cut") for c in columns]), keys)
    differs = lambda c: (F.col(c).isNull() != F.col(f"{c}__cut").isNull()) | F.coalesce(F.abs(F.col(c) - F.col(f"{c}__cut")) > eps, F.lit(False))
    return j.agg(*[F.count_if(differs(c)).alias(c) for c in columns])


def scenario_auc(rows: DataFrame, directions: dict[str, str], scenario: str, least: float = 0.7) -> DataFrame:
    """feature, scenario, auc, passes: how well a feature ranks a scenario's rows above the unmarked ones.

    A null feature counts as the unmarked rows' median. ``down`` turns the AUC round; ``both`` takes the better side.
    """
    normal, out = rows.filter(F.col(scenario).isNull()), None
    names = [r[0] for r in rows.filter(F.col(scenario).isNotNull()).select(scenario).distinct().orderBy(scenario).collect()]  # scenarios are few
    for feature, direction in directions.items():
        filled = rows.crossJoin(F.broadcast(quantiles(normal, feature, [0.5], name="_m"))).withColumn("_x", F.coalesce(F.col(feature).cast("double"), F.col("_m")[0]))
        d = filled.groupBy(F.col("_x").alias("v")).agg(F.count_if(F.col(scenario).isNull()).alias("b"), *[F.count_if(F.col(scenario) == n).alias(f"a{i}") for i, n in enumerate(names)])
        d = prefix_sums(d, "v", ["b"])  # unmarked rows are cumulated once for all scenarios
        u = d.agg(F.max("b_all").alias("unmarked"), *[x for i in range(len(names)) for x in (F.sum(F.col(f"a{i}") * (F.col("b_before") + F.col("b") / 2)).alias(f"u{i}"), F.sum(f"a{i}").alias(f"n{i}"))])
        auc = lambda i: F.col(f"u{i}") / F.nullif(F.col(f"n{i}") * F.col("unmarked"), F.lit(0))
        turned = {"up": auc, "down": lambda i: 1 - auc(i), "both": lambda i: F.greatest(auc(i), 1 - auc(i))}[direction]  # noqa: B023
        one = u.select(F.explode(F.array(*[F.struct(F.lit(feature).alias("feature"), F.lit(n).alias("scenario"), turned(i).alias("auc")) for i, n in enumerate(names)])).alias("x")).select("x.*")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("passes", F.coalesce(F.col("auc") >= least, F.lit(False)))


def by_kind(matrix: DataFrame, kind: str, one: str, other: str, expected: dict[str, str]) -> DataFrame:
    """feature, medians, means and IQRs of two kinds of rows, and whether the expectation holds of the first against the second.

    ``higher`` and ``lower`` compare medians, and means where those are equal; ``wider`` compares IQRs.
    """
    out = None
    for feature, hope in expected.items():
        q = quantiles(matrix, feature, [0.25, 0.5, 0.75], [kind]).join(matrix.groupBy(kind).agg(F.avg(feature).alias("mean")), kind)
        at = lambda c, k: F.max(F.when(F.col(kind) == k, c))
        row = q.agg(*[x for name, k in (("one", one), ("other", other)) for x in (at(F.col("q")[1], k).alias(f"median_{name}"), at(F.col("mean"), k).alias(f"mean_{name}"), at(F.col("q")[2] - F.col("q")[0], k).alias(f"iqr_{name}"))])
        more = F.when(F.col("median_one") != F.col("median_other"), F.col("median_one") > F.col("median_other")).otherwise(F.col("mean_one") > F.col("mean_other"))
        less = F.when(F.col("median_one") != F.col("median_other"), F.col("median_one") < F.col("median_other")).otherwise(F.col("mean_one") < F.col("mean_other"))
        holds = {"higher": more, "lower": less, "wider": F.col("iqr_one") > F.col("iqr_other")}[hope]
        row = row.select(F.lit(feature).alias("feature"), F.lit(hope).alias("expected"), "*", holds.alias("holds"))
        out = row if out is None else out.unionByName(row)
    return out
