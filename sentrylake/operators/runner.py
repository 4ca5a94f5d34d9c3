"""Methods run together: fitted per segment, scored, cut at a training quantile, measured against labels, compared in grids.

Scores, thresholds and labels are tables. The driver loops over methods, segments, configurations and seeds, never over
rows, and holds a number for each. Higher scores are anomalous; ties are broken by the keys.
"""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.operators import baselines, detectors, evaluation
from sentrylake.operators.ordered import prefix_sums, quantiles
from sentrylake.storage import Scratch

Method = Callable[[DataFrame, Column, list[str], list[str]], DataFrame]

# ---------------------------------------------------------------- splits


def restrict_days(matrix: DataFrame, split_day: int, days: Sequence[int]) -> DataFrame:
    """The evaluation rows of ``days``, which must all lie after the split and have rows."""
    wanted = sorted(set(map(int, days)))
    if not wanted or wanted[0] <= split_day:
        raise ValueError(f"evaluation days must lie after day {split_day}: {wanted}")
    rows = matrix.filter(F.col("day").isin(*wanted))
    lacking = set(wanted) - {r["day"] for r in rows.select("day").distinct().collect()}  # one row a day
    if lacking:
        raise ValueError(f"no rows for evaluation days {sorted(lacking)}")
    return rows


def split_record(matrix: DataFrame, split_day: int) -> DataFrame:
    """One row: the days and rows on both sides of the split, and the evaluation share."""
    late = F.col("day") > split_day
    one = matrix.agg(
        F.lit(split_day).alias("split_day"),
        F.min("day").alias("min_day"),
        F.max("day").alias("max_day"),
        F.count_if(~late).alias("n_train"),
        F.count_if(late).alias("n_eval"),
        F.count_distinct(F.when(~late, F.col("day"))).alias("n_train_days"),
        F.count_distinct(F.when(late, F.col("day"))).alias("n_eval_days"),
    )
    return one.withColumn("eval_ratio", F.col("n_eval") / F.nullif(F.col("n_train") + F.col("n_eval"), F.lit(0)))


# ---------------------------------------------------------------- scores and thresholds


def check_scores(scores: DataFrame, score: str, label: str | None = None) -> None:
    """Raises for an empty table, a score that is no finite number, a label besides 0 and 1, or labels without a 1."""
    x = F.col(score).cast("double")
    odd = F.count_if(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    more = [F.count_if(F.col(label).isNull() | ~F.col(label).isin(0, 1)).alias("labels"), F.count_if(F.col(label) == 1).alias("positives")] if label else []
    found = scores.agg(F.count("*").alias("n"), odd.alias("odd"), *more).first()
    if not found["n"]:
        raise ValueError("no scores")
    if found["odd"]:
        raise ValueError(f"{found['odd']} scores are not finite")
    if label and found["labels"]:
        raise ValueError(f"{found['labels']} labels are neither 0 nor 1")
    if label and not found["positives"]:
        raise ValueError("no positive label")


def percentile_among(scores: DataFrame, score: str, reference: DataFrame, reference_score: str, name: str) -> DataFrame:
    """``scores`` with the rank share among the reference scores: (how many are not greater - 1) / (n - 1), within [0, 1]; 1 for a single one."""
    own = scores.select(F.col(score).cast("double").alias("_v"), F.lit(0).alias("_r"))
    both = own.unionByName(reference.select(F.col(reference_score).cast("double").alias("_v"), F.lit(1).alias("_r"))).groupBy("_v").agg(F.sum("_r").alias("r"))
    share = (F.col("r_before") + F.col("r") - 1) / F.nullif(F.col("r_all") - 1, F.lit(0))
    table = prefix_sums(both, "_v", ["r"]).select("_v", F.when(F.col("r_all") == 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).alias(name))
    return scores.join(table, F.col(score).cast("double") == F.col("_v"), "left").drop("_v")


def fitted_threshold(training: DataFrame, score: str, rate: float) -> float:
    """The linear quantile of the training scores at 1 - rate: about ``rate`` of them lie at or above it."""
    return quantiles(training, score, [1 - rate]).first()["q"][0]


def predicted(scores: DataFrame, score: str, threshold: float) -> DataFrame:
    return scores.withColumn("alert", F.col(score) >= threshold)


def ks_report(fit: DataFrame, later: DataFrame, score: str) -> DataFrame:
    """One row: the Kolmogorov-Smirnov distance of fit and later scores, and the later ones' ties and mode (least of a tie)."""
    side = lambda df, a, b: df.select(F.col(score).cast("double").alias("v"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    d = prefix_sums(side(fit, 1, 0).unionByName(side(later, 0, 1)).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "v", ["a", "b"])
    upto = lambda c: (F.col(f"{c}_before") + F.col(c)) / F.col(f"{c}_all")
    most = F.max_by(F.col("v"), F.struct("b", -F.col("v")))
    one = d.agg(F.max(F.abs(upto("a") - upto("b"))).alias("ks"), F.max("a_all").alias("n_fit"), F.max("b_all").alias("n_eval"), F.count_if(F.col("b") > 0).alias("distinct"), most.alias("mode"), F.max("b").alias("top"))
    return one.select("n_fit", "n_eval", "ks", (1 - F.col("distinct") / F.col("n_eval")).alias("ties_share"), "mode", (F.col("top") / F.col("n_eval")).alias("mode_share"))


# ---------------------------------------------------------------- labelled metrics


def daily_top(scores: DataFrame, score: str, label: str, keys: list[str], sizes: Sequence[int]) -> DataFrame:
    """One row: recall over all days and mean precision of the days, for each number of alerts a day."""
    y = F.col(label).cast("long")
    top = evaluation.ranked(scores, score, keys, ["day"]).filter(F.col("rank") <= max(sizes))  # group limits before the shuffle
    inside = lambda n: F.col("rank") <= n
    per = top.groupBy("day").agg(*[x for n in sizes for x in (F.count_if(inside(n)).alias(f"a{n}"), F.sum(F.when(inside(n), y).otherwise(0)).alias(f"h{n}"))])
    total = scores.agg(F.sum(y).alias("_p"))
    folded = per.agg(*[x for n in sizes for x in (F.sum(f"h{n}").alias(f"h{n}"), F.avg(F.col(f"h{n}") / F.col(f"a{n}")).alias(f"precision_at_{n}_per_day"))])
    recall = [(F.col(f"h{n}") / F.nullif("_p", F.lit(0))).alias(f"recall_at_{n}_per_day") for n in sizes]
    any_ = F.col("_p") > 0
    return folded.crossJoin(total).select(*recall, *[F.when(any_, F.col(f"precision_at_{n}_per_day")).alias(f"precision_at_{n}_per_day") for n in sizes])  # one row each


def recall_at_budget(scores: DataFrame, score: str, label: str, keys: list[str], ratio: float) -> float | None:
    """The share of positives among the round(ratio * n) highest rows (half to even, at least one)."""
    curve = evaluation.by_score(scores, score, label)
    total = curve.agg(F.max("pos").alias("pos"), F.max("all").alias("all")).first()
    if not total["pos"]:
        return None
    size = min(evaluation.budget_size(total["all"], ratio), total["all"])
    cut = curve.filter(F.col("k") >= size).agg(F.max_by(F.struct("s", "p", "n", "tp", "k"), "s").alias("x")).first()["x"]
    hits, left = cut["tp"] - cut["p"], size - (cut["k"] - cut["n"])
    # of the rows tied at the cut, those that come first by the keys
    tied = scores.filter(F.col(score) == cut["s"]).orderBy(*keys).limit(left).agg(F.sum(F.col(label).cast("long")).alias("h")).first()["h"]
    return (hits + (tied or 0)) / total["pos"]


def labelled_metrics(scores: DataFrame, score: str, label: str, keys: list[str], ks: Sequence[int] = (10, 50, 100), ratio: float = 0.05, budgets: Sequence[int] = (10, 50, 100), daily: bool = True) -> DataFrame:
    """One row of all metrics of one method. Null where a metric has no meaning: all of them without a positive, ROC
    without a negative, precision at more rows than there are, daily ones without days."""
    y = F.col(label).cast("long")
    n, pos = scores.agg(F.count("*"), F.coalesce(F.sum(y), F.lit(0))).first()
    known = lambda c: F.when(F.lit(pos > 0), c)
    base = scores.sparkSession.range(1).select(F.lit(pos).cast("long").alias("n_positive"), (F.lit(100.0 * pos / n if n else None).cast("double")).alias("positive_rate_pct"))
    rank = evaluation.ranking(scores, score, label).select("pr_auc", "roc_auc") if pos else base.select(F.lit(None).cast("double").alias("pr_auc"), F.lit(None).cast("double").alias("roc_auc"))
    top = scores.orderBy(F.desc(score), *keys).limit(max(ks))  # a top-k report
    top = evaluation.ranked(top, score, keys).agg(*[known(F.sum(F.when(F.col("rank") <= k, y).otherwise(0)) / k if k <= n else F.lit(None).cast("double")).alias(f"precision_at_{k}") for k in ks])
    found = recall_at_budget(scores, score, label, keys, ratio) if pos else None
    out = base.crossJoin(rank).crossJoin(top).withColumn("recall_at_budget", F.lit(found).cast("double"))
    if daily:
        days = daily_top(scores, score, label, keys, sorted({*ks, *budgets}))
        out = out.crossJoin(days.select(*[f"recall_at_{n}_per_day" for n in budgets], *[f"precision_at_{k}_per_day" for k in ks]))
    else:
        out = out.withColumns({**{f"recall_at_{n}_per_day": F.lit(None).cast("double") for n in budgets}, **{f"precision_at_{k}_per_day": F.lit(None).cast("double") for k in ks}})
    return out


def evaluate(aligned: DataFrame, score: str, threshold: float, keys: list[str], budgets: Sequence[int] = (10, 50, 100)) -> DataFrame:
    """One row of a method on labelled rows (is_anomaly, eval_exclude, campaign_id, day), excluded rows left out first; alerts lie above the threshold."""
    kept = aligned.filter(~F.col("eval_exclude"))
    rows = aligned.agg(F.count("*").alias("n_rows"), F.count_if("eval_exclude").alias("n_excluded")).withColumn("n_eval", F.col("n_rows") - F.col("n_excluded"))
    point = evaluation.operating_point(kept, score, "is_anomaly", threshold, strict=True)
    per_day = kept.groupBy("day").agg(F.count_if(F.col(score) > threshold).alias("a"))
    alerts = per_day.agg(F.count("*").alias("n_days"), F.avg("a").alias("alerts_per_day_mean"), F.median("a").alias("alerts_per_day_median"), F.min("a").alias("alerts_per_day_min"), F.max("a").alias("alerts_per_day_max"))  # one row a day
    campaign = kept.filter("is_anomaly = 1 and campaign_id is not null").groupBy("campaign_id").agg(F.bool_or(F.col(score) > threshold).alias("c"))
    campaign = campaign.agg(F.count("*").alias("campaigns"), F.count_if("c").alias("campaigns_caught"))
    daily = daily_top(kept, score, "is_anomaly", keys, budgets).select(*[f"recall_at_{n}_per_day" for n in budgets])
    whole = evaluation.ranking(kept, score, "is_anomaly").select("pr_auc", (F.col("positives") / F.col("rows")).alias("random_pr_auc"))
    return rows.crossJoin(point).crossJoin(alerts).crossJoin(campaign).crossJoin(daily).join(F.broadcast(whole), F.lit(True), "left")  # one row each


# ---------------------------------------------------------------- methods by segment


def _detector(name: str, **parameters) -> Method:
    return lambda m, train, x, keys: detectors.fit_and_score(m, train, x, name, **parameters).select(*keys, F.col(f"{detectors.ALIASES.get(name, name)}_score").alias("score"))


METHODS: dict[str, Method] = {
    "zscore_global": lambda m, train, x, keys: baselines.z_scores(m, train, x, keys).withColumnRenamed("zscore", "score"),
    "zscore_account": lambda m, train, x, keys: baselines.z_scores(m, train, x, keys, account=[k for k in keys if k in ("DomainName", "UserName")] or keys[:1]).withColumnRenamed("zscore", "score"),
    "rule_ecdf": lambda m, train, x, keys: baselines.ecdf_rules(m, train, x).select(*keys, F.col("ecdf_score").alias("score")),
    "random": lambda m, train, x, keys: baselines.random_score(m, keys).select(*keys, F.col("random_score").alias("score")),
    **{name: _detector(name) for name in detectors.DETECTORS},
}


def run_segments(matrix: DataFrame, train: Column, features: list[str], keys: list[str], methods: Sequence[str], segment: str, segments: Sequence, rate: float = 0.05, known: dict[str, Method] | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores, thresholds): every method fitted on each segment's training rows and scored on all its rows.

    Scores are long: segment, method, keys, is_train, score. Thresholds: segment, method, threshold, n_train. Rows of a
    segment that is not named are left out, with a warning that counts them.
    """
    spark, known = matrix.sparkSession, {**METHODS, **(known or {})}
    absent = [m for m in methods if m not in known]
    if absent:
        raise ValueError(f"unknown methods: {absent}")
    others = {r[0]: r[1] for r in matrix.filter(F.col(segment).isNull() | ~F.col(segment).isin(*segments)).groupBy(segment).count().collect()}  # one row a segment
    if others:
        warnings.warn(f"rows of other segments are not scored: {others}", stacklevel=2)
    scratch, out, cuts = Scratch(spark, "runner"), None, []
    for s, name in itertools.product(segments, methods):
        part = matrix.filter(F.col(segment) == s)
        scored = known[name](part, train, features, keys).join(part.select(*keys, F.coalesce(train, F.lit(False)).alias("is_train")), keys)
        scored = scratch.write(scored.select(F.lit(s).alias("segment"), F.lit(name).alias("method"), *keys, "is_train", F.col("score").cast("double").alias("score")), name)
        fit = scored.filter("is_train")
        cuts.append((s, name, fitted_threshold(fit, "score", rate), fit.count()))
        out = scored if out is None else out.unionByName(scored)
    kind = dict(matrix.dtypes)[segment]
    return out, spark.createDataFrame(cuts, f"segment {kind}, method string, threshold double, n_train long")


def evaluate_segments(scores: DataFrame, thresholds: DataFrame, labels: DataFrame, keys: list[str], budgets: Sequence[int] = (10, 50, 100)) -> DataFrame:
    """``evaluate`` of every segment and method on the evaluation rows: a row each. Thresholds are fixed before labels are seen."""
    aligned = evaluation.with_labels(scores.filter("not is_train"), labels, keys)
    out = None
    for r in thresholds.collect():  # a row for each segment and method
        own = aligned.filter((F.col("segment") == r["segment"]) & (F.col("method") == r["method"]))
        one = evaluate(own, "score", r["threshold"], keys, budgets).select(F.lit(r["segment"]).alias("segment"), F.lit(r["method"]).alias("method"), F.lit(r["threshold"]).alias("threshold"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def random_reference(matrix: DataFrame, label: str, keys: list[str], seeds: Sequence[int]) -> DataFrame:
    """One row: mean and deviation of the PR-AUC of random scores over seeds, and what is expected, the positive rate."""
    runs = None
    for seed in seeds:
        one = evaluation.ranking(baselines.random_score(matrix, keys, seed), "random_score", label).select("pr_auc", (F.col("positives") / F.col("rows")).alias("expected"))
        runs = one if runs is None else runs.unionByName(one)
    return runs.agg(F.count("*").alias("n_seeds"), F.avg("pr_auc").alias("pr_auc_mean"), F.stddev_samp("pr_auc").alias("pr_auc_std"), F.max("expected").alias("expected"))


# ---------------------------------------------------------------- grids


def run_grid(matrix: DataFrame, train: Column, features: list[str], keys: list[str], label: str, configurations: Sequence[dict], seeds: Sequence[int], rate: float = 0.05) -> DataFrame:
    """A row for each configuration ({"id", "model", parameters}) and seed: threshold, ranking and operating point on the rows that aren't for training."""
    names = [c["id"] for c in configurations]
    if not names or not seeds:
        raise ValueError("a grid needs configurations and seeds")
    if len(set(names)) != len(names):
        raise ValueError(f"configuration ids repeat: {sorted({n for n in names if names.count(n) > 1})}")
    scratch, rows = Scratch(matrix.sparkSession, "grid"), []
    for c, seed in itertools.product(configurations, seeds):
        model = detectors.ALIASES.get(c["model"], c["model"])
        parameters = {k: v for k, v in c.items() if k not in ("id", "model")}
        scored = detectors.fit_and_score(matrix, train, features, model, seed=seed, **parameters)
        scored = scratch.write(scored.select(*keys, F.coalesce(train, F.lit(False)).alias("is_train"), F.col(label).alias("y"), F.col(f"{model}_score").alias("score")), c["id"])
        rows.append((model, c["id"], seed, *_point(scored, rate)))
    return matrix.sparkSession.createDataFrame(rows, "model string, config_id string, seed int, threshold double, pr_auc double, roc_auc double, precision double, recall double, alert_rate double")


def _point(scored: DataFrame, rate: float) -> tuple:
    cut = fitted_threshold(scored.filter("is_train"), "score", rate)
    later = scored.filter("not is_train")
    rank = evaluation.ranking(later, "score", "y").first()
    point = evaluation.operating_point(later, "score", "y", cut).first()
    return (cut, rank["pr_auc"] if rank else None, rank["roc_auc"] if rank else None, point["precision"], point["recall"], point["alert_rate"])


def summarised(runs: DataFrame, metrics: Sequence[str] = ("pr_auc", "roc_auc", "precision", "recall", "alert_rate"), by: Sequence[str] = ("model", "config_id")) -> DataFrame:
    """Mean, sample deviation and number of valid seeds of each metric and configuration."""
    return evaluation.over_seeds(runs, list(by), list(metrics))


def best_of(summary: DataFrame, metric: str = "pr_auc_mean") -> DataFrame:
    """model, config_id: the configuration with the highest mean of each model; of a tie the one that comes first by id."""
    return summary.groupBy("model").agg(F.min_by("config_id", F.struct(-F.coalesce(F.col(metric), F.lit(float("-inf"))), F.col("config_id"))).alias("config_id"), F.max(metric).alias(metric))


def contamination_sweep(scored: DataFrame, rates: Sequence[float]) -> DataFrame:
    """A row for each rate: what its threshold on the training scores (is_train, y, score) means for the others; scores are fitted once."""
    rows = [(float(r), *_point(scored, r)) for r in rates]
    return scored.sparkSession.createDataFrame(rows, "contamination double, threshold double, pr_auc double, roc_auc double, precision double, recall double, alert_rate double")


def stability(runs: Sequence[DataFrame], keys: list[str], score: str, k: int) -> DataFrame:
    """One row: mean and least rank correlation and top-k overlap over all pairs of runs of one method."""
    if len(runs) < 2:
        raise ValueError("stability needs two runs or more")
    out = None
    for a, b in itertools.combinations(runs, 2):  # a pair of seeds
        both = a.select(*keys, F.col(score).alias("a")).join(b.select(*keys, F.col(score).alias("b")), keys)
        top = lambda c: both.orderBy(F.desc(c), *keys).limit(k)  # noqa: B023, E731  a top-k report
        one = evaluation.spearman(both, "a", "b").select("spearman").crossJoin(evaluation.overlap(top("a"), top("b"), keys, k))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.lit(len(runs)).alias("n_runs"), F.avg("spearman").alias("spearman_mean"), F.min("spearman").alias("spearman_min"), F.avg("overlap").alias("topk_overlap_mean"), F.min("overlap").alias("topk_overlap_min"))
