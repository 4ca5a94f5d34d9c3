"""Time splits, thresholds, ranking and budget metrics, all as aggregations. Ties are broken by explicit keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.operators.ordered import prefix_sums


def split_day(matrix: DataFrame, ratio: float = 0.7) -> DataFrame:
    """The last training day whose share of rows is nearest to ``ratio``; the earlier one of a tie."""
    n = matrix.groupBy("day").agg(F.count("*").alias("n"))
    w = n.withColumn("share", F.sum("n").over(Window.orderBy("day")) / F.sum("n").over(Window.partitionBy()))  # one row a day
    return w.agg(F.min_by("day", F.struct(F.round(F.abs(F.col("share") - ratio), 12), F.col("day"))).alias("split_day"))


def with_labels(matrix: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """is_anomaly and eval_exclude, 0 and false where there is no label; repeated label keys are an error."""
    if labels.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError("labels repeat a key")
    joined = matrix.join(labels, keys, "left")
    return joined.withColumn("is_anomaly", F.coalesce("is_anomaly", F.lit(0))).withColumn("eval_exclude", F.coalesce("eval_exclude", F.lit(False)))


def by_score(scores: DataFrame, score: str, label: str) -> DataFrame:
    """Distinct scores with their positives and rows, both cumulated from the top, and both of all."""
    d = scores.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    d = prefix_sums(d, "s", ["p", "n"])
    return d.select("s", "p", "n", (F.col("p_all") - F.col("p_before")).alias("tp"), (F.col("n_all") - F.col("n_before")).alias("k"), F.col("p_all").alias("pos"), F.col("n_all").alias("all"))


def ranking(scores: DataFrame, score: str, label: str) -> DataFrame:
    """positives, rows, average precision by the step rule, ROC AUC with ties halved; null without both classes."""
    d = by_score(scores, score, label)
    ap = F.sum(F.col("p") / F.nullif("pos", F.lit(0)) * F.col("tp") / F.col("k"))
    below = (F.col("all") - F.col("pos")) - (F.col("k") - F.col("tp"))  # negatives with a smaller score
    auc = F.sum(F.col("p").cast("double") * (below + (F.col("n") - F.col("p")) / 2))
    return d.groupBy("pos", "all").agg(ap.alias("ap"), auc.alias("u")).select(F.col("pos").alias("positives"), F.col("all").alias("rows"), F.col("ap").alias("pr_auc"), (F.col("u") / F.nullif(F.col("pos") * (F.col("all") - F.col("pos")), F.lit(0))).alias("roc_auc"))


def pr_curve(scores: DataFrame, score: str, label: str) -> DataFrame:
    d = by_score(scores, score, label)
    return d.select("s", (F.col("tp") / F.col("k")).alias("precision"), (F.col("tp") / F.nullif("pos", F.lit(0))).alias("recall"))


def mean_pr(curves: DataFrame, run: str, steps: int = 100) -> DataFrame:
    """Vertical mean over runs on a recall grid: at each recall the best precision at that recall or beyond."""
    grid = curves.sparkSession.range(steps + 1).select((F.col("id") / steps).alias("at"))
    # the grid has a fixed number of points
    best = curves.join(F.broadcast(grid), F.col("recall") >= F.col("at") - 1e-12).groupBy(run, "at").agg(F.max("precision").alias("precision"))
    return best.groupBy("at").agg(F.avg("precision").alias("precision"), F.count("*").alias("runs"))


def ranked(scores: DataFrame, score: str, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """``rank`` from 1 by falling score, ties by the keys; within ``by`` or over all rows."""
    w = Window.partitionBy(*(by or [])).orderBy(F.desc(score), *keys)
    return scores.withColumn("rank", F.row_number().over(w))


def precision_at(scores: DataFrame, score: str, label: str, keys: list[str], ks: list[int]) -> DataFrame:
    top = scores.orderBy(F.desc(score), *keys).limit(max(ks))  # a top-k report
    r = ranked(top, score, keys)
    total = scores.agg(F.sum(F.col(label).cast("long")).alias("P"))
    rows = r.select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "rank", F.col(label).cast("long").alias("y")).filter("rank <= k")
    return rows.groupBy("k").agg(F.sum("y").alias("tp"), F.count("*").alias("n")).crossJoin(total).select("k", (F.col("tp") / F.col("n")).alias("precision"), (F.col("tp") / F.nullif("P", F.lit(0))).alias("recall"))


def daily_budget(scores: DataFrame, score: str, label: str, keys: list[str], n: int) -> DataFrame:
    """Alerts of the ``n`` highest scores of each day: rows, alerts, hits, positives by day."""
    y = F.col(label).cast("long")
    # tasks keep their own n highest of a day before any are moved
    top = ranked(scores, score, keys, ["day"]).filter(F.col("rank") <= n).groupBy("day").agg(F.count("*").alias("alerts"), F.sum(y).alias("hits"))
    return scores.groupBy("day").agg(F.count("*").alias("rows"), F.sum(y).alias("positives")).join(top, "day").select("day", "rows", "alerts", "hits", "positives")


def daily_summary(daily: DataFrame) -> DataFrame:
    """Recall over all days, and the mean of the days' precisions over what was flagged."""
    return daily.agg((F.sum("hits") / F.nullif(F.sum("positives"), F.lit(0))).alias("recall"), F.avg(F.col("hits") / F.nullif("alerts", F.lit(0))).alias("mean_precision"), F.avg("alerts").alias("alerts_per_day"))


def budget_size(n: int, rate: float) -> int:
    """Half to even, at least 1."""
    return max(1, round(n * rate))


def operating_point(scores: DataFrame, score: str, label: str, threshold: float, strict: bool = False) -> DataFrame:
    hit = F.col(score) > threshold if strict else F.col(score) >= threshold
    y = F.col(label) == 1
    a = scores.agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    return a.withColumn("precision", F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).withColumn("recall", F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).withColumn("alert_rate", (F.col("tp") + F.col("fp")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def campaign_recall(scores: DataFrame, score: str, campaign: str, threshold: float) -> DataFrame:
    c = scores.filter(F.col(campaign).isNotNull()).groupBy(campaign).agg(F.bool_or(F.col(score) >= threshold).alias("caught"))
    return c.agg(F.count("*").alias("campaigns"), F.count_if("caught").alias("caught"))


def by_subset(scores: DataFrame, score: str, label: str, subset: str) -> DataFrame:
    """Ranking metrics of each subset's positives against all negatives, which are cumulated once and looked up."""
    neg = prefix_sums(scores.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 0).alias("q")), "s", ["q"])
    pos = scores.filter((F.col(label) == 1) & F.col(subset).isNotNull()).groupBy(subset, F.col(score).alias("s")).agg(F.count("*").alias("p"))
    d = pos.join(neg, "s")
    whole = Window.partitionBy(subset)
    d = d.withColumn("tp", F.sum("p").over(whole.orderBy(F.desc("s")))).withColumn("pos", F.sum("p").over(whole)).withColumn("fp", F.col("q_all") - F.col("q_before"))
    ap = F.sum(F.col("p") / F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    auc = F.sum(F.col("p") / F.col("pos") * (F.col("q_before") + F.col("q") / 2) / F.nullif("q_all", F.lit(0)))
    return d.groupBy(subset).agg(F.max("pos").alias("positives"), ap.alias("pr_auc"), auc.alias("roc_auc"), F.max(F.col("pos") / (F.col("pos") + F.col("q_all"))).alias("floor"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks; 1 if either column is constant. Ranks come from counts of distinct values."""

    def average_ranks(c: str) -> DataFrame:
        d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
        return prefix_sums(d, c, ["n"]).select(c, (F.col("n_before") + (F.col("n") + 1) / 2).alias(f"_r{c}"))

    r = df.join(average_ranks(a), a).join(average_ranks(b), b)
    constant = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    return r.agg(F.count("*").alias("n"), F.when(constant, F.lit(1.0)).otherwise(F.corr(f"_r{a}", f"_r{b}")).alias("spearman"))


def overlap(a: DataFrame, b: DataFrame, keys: list[str], k: int) -> DataFrame:
    return a.join(b, keys, "left_semi").agg((F.count("*") / F.lit(k)).alias("overlap"))


def paired_deltas(results: DataFrame, reference: str, config: str, pair: list[str], metric: str) -> DataFrame:
    """Mean, deviation and clarity (|mean| > deviation) of each configuration's difference to the reference in the same run."""
    base = results.filter(F.col(config) == reference).select(*pair, F.col(metric).alias("_base"))
    d = results.filter(F.col(config) != reference).join(base, pair).withColumn("delta", F.col(metric) - F.col("_base"))
    return d.groupBy(config).agg(F.avg("delta").alias("mean_delta"), F.stddev_samp("delta").alias("sd"), F.count("*").alias("n")).withColumn("clear", F.abs("mean_delta") > F.coalesce("sd", F.lit(0.0)))


def over_seeds(results: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(*[x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), F.count(m).alias(f"{m}_n"))])


def compare(have: DataFrame, want: DataFrame, keys: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    j = have.select(*keys, F.col(value).alias("a")).join(want.select(*keys, F.col(value).alias("b")), keys, "full")
    apart = F.abs(F.col("a") - F.col("b")) / F.greatest(F.abs("b"), F.lit(1e-12))
    return j.withColumn("relative", apart).withColumn("ok", F.coalesce(apart <= tolerance, F.col("a").isNull() & F.col("b").isNull()))
