"""Statistical and rule baselines, fitted on training rows only. A high score is anomalous."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.functions import predicates as P
from sentrylake.operators.ordered import picked, prefix_sums, quantiles

#: feature, operator, threshold; fixed values of the rule baseline's form, any list may be given
RULES = [("failure_ratio", ">=", 0.5), ("off_hours_ratio", ">=", 0.8), ("distinct_sources_count", ">=", 5), ("distinct_hosts", ">=", 10), ("ntlm_ratio", ">=", 0.9), ("rare_logon_type_count", ">=", 5)]


def one_row(df: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """``df`` with the columns of tables of one row each."""
    for part in parts:
        df = df.crossJoin(F.broadcast(part))
    return df


def imputed(matrix: DataFrame, train: Column, features: list[str], how: str = "median") -> DataFrame:
    """Nulls by the training median, mean or zero; a feature without training values gets 0."""
    fit = matrix.filter(train)
    if how == "median":
        parts = [quantiles(fit, c, [0.5]).select(F.coalesce(F.col("q")[0], F.lit(0.0)).alias(f"_fill_{c}")) for c in features]
    else:
        parts = [fit.agg(*[F.coalesce(F.avg(c) if how == "mean" else F.lit(0.0), F.lit(0.0)).alias(f"_fill_{c}") for c in features])]
    return one_row(matrix, parts).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_fill_{c}")) for c in features}).drop(*[f"_fill_{c}" for c in features])


def scaled(matrix: DataFrame, train: Column, features: list[str], how: str = "robust") -> DataFrame:
    """Median and IQR, or mean and standard deviation, of the training rows; a spread of 0 counts as 1."""
    fit = matrix.filter(train)
    if how == "robust":
        parts = [quantiles(fit, c, [0.25, 0.5, 0.75], name=f"_q_{c}") for c in features]
    else:
        parts = [fit.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"_q_{c}") for c in features])]

    def one(c: str) -> Column:
        q = F.col(f"_q_{c}")
        middle, spread = (q[1], q[2] - q[0]) if how == "robust" else (q["m"], q["s"])
        return (F.col(c) - middle) / F.when(spread > 0, spread).otherwise(1.0)

    return one_row(matrix, parts).withColumns({c: one(c) for c in features}).drop(*[f"_q_{c}" for c in features])


def quantile_normal(matrix: DataFrame, train: Column, feature: str, name: str) -> DataFrame:
    """Normal scores of the training ranks (rational approximation of the inverse normal)."""
    p = ecdf(matrix, train, feature, "_p", "mid").withColumn("_p", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("_p"))))
    tail = F.least(F.col("_p"), 1 - F.col("_p"))
    t = F.sqrt(-2 * F.ln(tail))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return p.withColumn(name, F.when(F.col("_p") < 0.5, -z).otherwise(z)).drop("_p")


def mad_scales(train: DataFrame, features: list[str], by: list[str] | None = None, floor_q: float = 0.25, tolerance: float = 1e-9) -> DataFrame:
    """Per group and feature: median, and 1.4826 MAD with a floor at a quantile of the non-zero deviations; null scale for a constant.

    All features' values are counted in one table; equal values of a group are one row from then on.
    """
    by = by or []
    long = train.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("v")) for c in features])).alias("x")).select(*by, "x.*").filter("v is not null")
    counted = long.groupBy(*by, "f", "v").agg(F.count("*").alias("n"))
    place = Window.partitionBy(*by, "f")

    def at(value: str, p: float, least: Column | None = None) -> Column:
        """An exact linear quantile over counted rows that are ordered by ``value``, as an aggregate."""
        size, before = (F.col("_all"), F.col("_upto") - F.col("n"))
        h = F.lit(p) * (size - 1)
        low, high = (F.min(F.when(before + F.col("n") > r(h), F.col(value))) for r in (F.floor, F.ceil))
        part = F.max(h - F.floor(h))
        return F.when(part == 0, low).otherwise(low * (1 - part) + high * part)

    ordered = lambda df, value: df.withColumn("_upto", F.sum("n").over(place.orderBy(value))).withColumn("_all", F.sum("n").over(place))
    middle = ordered(counted, "v").groupBy(*by, "f").agg(at("v", 0.5).alias("m"), F.max("_all").alias("rows"))
    apart = counted.join(middle, [*by, "f"]).withColumn("d", F.abs(F.col("v") - F.col("m")))
    mad = ordered(apart, "d").groupBy(*by, "f").agg(F.first("m").alias("m"), F.first("rows").alias("rows"), at("d", 0.5).alias("mad"))
    floor = ordered(apart.filter(F.col("d") > tolerance), "d").groupBy(*by, "f").agg(at("d", floor_q).alias("floor"))
    scale = 1.4826 * F.when(F.col("mad") > tolerance, F.col("mad")).otherwise(F.col("floor"))
    return mad.join(floor, [*by, "f"], "left").select(*by, "f", "m", F.col("rows").alias("n"), scale.alias("scale"))


def z_scores(matrix: DataFrame, train: Column, features: list[str], keys: list[str], how: str = "max", account: list[str] | None = None, least_days: int = 5) -> DataFrame:
    """keys and zscore: max, mean or 95th percentile of the absolute robust z over the features.

    With ``account`` the scale is the account's own if it has ``least_days`` training rows, else the global one.
    """
    long = matrix.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("v")) for c in features])).alias("x")).select(*keys, "x.*")
    every = mad_scales(matrix.filter(train), features)
    rows = long.join(F.broadcast(every.select("f", F.col("m").alias("gm"), F.col("scale").alias("gs"))), "f")  # one row per feature
    middle, scale = F.col("gm"), F.col("gs")
    if account:
        own = mad_scales(matrix.filter(train), features, account).filter(F.col("n") >= least_days)
        rows = rows.join(own.select(*account, "f", F.col("m").alias("am"), F.col("scale").alias("as_")), [*account, "f"], "left")
        middle, scale = F.coalesce("am", "gm"), F.coalesce("as_", "gs")
    z = F.when(scale > 0, F.abs(F.col("v") - middle) / scale).otherwise(0.0)
    fold = {"max": F.max("z"), "mean": F.avg("z"), "p95": F.percentile("z", 0.95)}[how]
    return rows.withColumn("z", F.coalesce(z, F.lit(0.0))).groupBy(*keys).agg(fold.alias("zscore"))


def rule_fraction(matrix: DataFrame, rules=RULES) -> DataFrame:
    """Share of the rules that a row breaks; null values break none."""
    hits = [F.coalesce(P.rule(F.col(c), op, t), F.lit(False)).cast("int") for c, op, t in rules]
    return matrix.withColumn("rule_score", reduce(lambda a, b: a + b, hits) / float(len(rules)))


def failure_count(matrix: DataFrame, least: int = 5) -> DataFrame:
    """Failures recovered from ratio and log volume, and the alert at ``least``."""
    n = F.round(F.col("failure_ratio") * F.expm1(F.log1p("total_logons")))
    return matrix.withColumn("failure_count", n.cast("long")).withColumn("failure_alert", n >= least)


def random_score(matrix: DataFrame, keys: list[str], seed: int = 42, stream: int = 0) -> DataFrame:
    """The same row gets the same score in any partitioning."""
    return matrix.withColumn("random_score", P.hash_uniform(*[F.col(k) for k in keys], F.lit(seed), F.lit(stream)))


def content_random(matrix: DataFrame, features: list[str]) -> DataFrame:
    """Rows with equal features (to six decimals) get equal scores."""
    return matrix.withColumn("random_score", P.hash_uniform(*[F.floor(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * 1e6) for c in features]))


def ecdf_table(matrix: DataFrame, train: Column, feature: str, name: str, side: str = "left") -> DataFrame:
    """_v and the share of training values below it (left), up to it (right), or midway, by running sums over counted values."""
    values = matrix.filter(F.col(feature).isNotNull()).groupBy(F.col(feature).cast("double").alias("_v")).agg(F.count_if(train).alias("_t"))
    part = {"left": F.lit(0), "right": F.col("_t"), "mid": F.col("_t") / 2}[side]
    return prefix_sums(values, "_v", ["_t"]).select("_v", ((F.col("_t_before") + part) / F.nullif("_t_all", F.lit(0))).alias(name))


def ecdf(matrix: DataFrame, train: Column, feature: str, name: str, side: str = "left") -> DataFrame:
    """``matrix`` with the share as a column; null stays null."""
    return with_shares(matrix, {feature: ecdf_table(matrix, train, feature, name, side)})


def with_shares(matrix: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Joins each feature's table to the matrix. The tables come from the matrix itself, not from one another's results."""
    out = matrix
    for feature, table in tables.items():
        out = out.join(table, F.col(feature).cast("double") == F.col("_v"), "left").drop("_v")
    return out


def ecdf_rules(matrix: DataFrame, train: Column, features: list[str], external: dict[str, float] | None = None) -> DataFrame:
    """The greatest left ECDF over the features; null counts as 0. A feature with an ``external`` threshold is 1 from there on, else 0."""
    external = external or {}
    if set(external) - set(features):
        raise ValueError(f"external thresholds of other columns: {sorted(set(external) - set(features))}")
    own = [c for c in features if c not in external]
    out = with_shares(matrix, {c: ecdf_table(matrix, train, c, f"_e{i}") for i, c in enumerate(own)})
    parts = [F.coalesce(F.col(f"_e{i}"), F.lit(0.0)) for i in range(len(own))]
    parts += [F.coalesce((F.col(c) >= limit).cast("double"), F.lit(0.0)) for c, limit in external.items()]
    return out.withColumn("ecdf_score", F.greatest(*parts, F.lit(0.0))).drop(*[f"_e{i}" for i in range(len(own))])


def registry_z(matrix: DataFrame, train: Column, features: list[str], how: str = "robust") -> DataFrame:
    """The greatest absolute z over the features, null as its middle: classic (mean, deviation) or robust (median; MAD, else
    IQR / 1.349, else the deviation, else 1). Adds ``z_score``."""
    if how not in ("classic", "robust"):
        raise ValueError(how)
    fit, parts = matrix.filter(train), []
    for c in features:
        moments = fit.agg(F.avg(c).alias(f"_a_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))
        if how == "robust":
            moments = moments.crossJoin(quantiles(fit, c, [0.25, 0.5, 0.75], name=f"_q_{c}"))
            apart = fit.crossJoin(F.broadcast(quantiles(fit, c, [0.5], name="_m"))).select(F.abs(F.col(c) - F.col("_m")[0]).alias("d"))
            moments = moments.crossJoin(quantiles(apart, "d", [0.5], name=f"_d_{c}"))
        parts.append(moments)  # one row each

    def z(c: str) -> Column:
        if how == "classic":
            middle, scale = F.col(f"_a_{c}"), F.col(f"_s_{c}")
        else:
            q, mad = F.col(f"_q_{c}"), 1.4826 * F.col(f"_d_{c}")[0]
            iqr = (q[2] - q[0]) / 1.349
            middle, scale = q[1], F.when(mad > 0, mad).when(iqr > 0, iqr).otherwise(F.col(f"_s_{c}"))
        return F.coalesce(F.abs(F.col(c) - middle) / F.when(scale > 0, scale).otherwise(1.0), F.lit(0.0))

    wide = one_row(matrix, parts)
    return wide.withColumn("z_score", F.greatest(*[z(c) for c in features], F.lit(0.0))).select(*matrix.columns, "z_score")


def budget_threshold(scores: DataFrame, score: str, rate: float, method: str = "linear") -> DataFrame:
    """The training quantile at 1 - rate: linear (alerts at or above), or higher (alerts above)."""
    if method == "linear":
        return quantiles(scores, score, [1 - rate]).select(F.col("q")[0].alias("threshold"))
    # index ceil((n - 1) p) of the ordered scores
    n = prefix_sums(scores.groupBy(F.col(score).alias("v")).agg(F.count("*").alias("n")), "v", ["n"])
    return n.agg(picked(F.ceil((F.col("n_all") - 1) * (1 - rate))).alias("threshold"))


def duplicate_groups(matrix: DataFrame, features: list[str]) -> DataFrame:
    n = matrix.groupBy(*features).agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_rows"), F.max("n").alias("largest_group"), F.count_if(F.col("n") > 1).alias("groups"))
