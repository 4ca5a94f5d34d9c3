"""Hand-computed cases of the analytics engine."""

import math

import pytest
from pyspark.sql import functions as F

from sentrylake.operators import baselines, cleaning, detectors, evaluation, history, injection, intraday, profiles, statistics
from sentrylake.plans import features, grammar
from sentrylake.sources import authlog


def log(spark, rows):
    """(user, day, second, event id, source, host, logon type)"""
    data = [(i, "dom1", u, d, (d - 1) * 86400 + s, e, src, h, t, "Kerberos", "bad password" if e == 4625 else None, "p") for i, (u, d, s, e, src, h, t) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id long, DomainName string, UserName string, day int, Time long, EventID int, Source string, LogHost string, LogonType int, AuthenticationPackage string, FailureReason string, ProcessName string")


def by_user(df, day=None):
    return {r["UserName"]: r for r in (df if day is None else df.filter(F.col("day") == day)).collect()}


def pielou(counts):
    n = sum(counts)
    return -sum(c / n * math.log(c / n) for c in counts) / math.log(len(counts)) if len(counts) > 1 else 0.0


def test_account_days_against_their_definitions(spark):
    """Two hours of different weight, gaps of 0, 60 and many seconds, a missing source, and an account with one event."""
    at = [(5, 0, "gate"), (5, 0, "gate"), (5, 60, "desk"), (13, 0, "desk"), (13, 7, "gate"), (13, 7, None), (13, 500, "gate")]
    rows = [("UserK", 2, 3600 * h + s, 4625 if i % 3 == 0 else 4624, "w1" if i % 2 else None, host, 3) for i, (h, s, host) in enumerate(at)]
    rows += [("C7$", 2, 80_000, 4624, "w2", "desk", 2)]
    got = by_user(intraday.account_days(log(spark, rows)))
    k, machine = got["UserK"], got["C7$"]
    gaps = [b - a for a, b in zip(*(sorted(3600 * h + s for h, s, _ in at)[i:] for i in (0, 1)))]
    mean = sum(gaps) / len(gaps)
    spread = math.sqrt(sum((g - mean) ** 2 for g in gaps) / (len(gaps) - 1))
    assert k["interarrival_dt_mean"] == pytest.approx(mean) and k["delta_t_cv"] == pytest.approx(spread / mean)
    assert k["same_second_share"] == pytest.approx(2 / 7) and k["failure_ratio"] == pytest.approx(3 / 7) and k["missing_source_ratio"] == pytest.approx(4 / 7)
    assert k["hour_entropy"] == pytest.approx(pielou([3, 4])) and k["dst_host_entropy"] == pytest.approx(pielou([4, 2]))
    assert (k["distinct_hosts"], k["distinct_sources_count"], k["off_hours_ratio"]) == (3, 1, pytest.approx(3 / 7))
    assert k["activity_peak_hour_cos"] == pytest.approx(math.cos(2 * math.pi * 13 / 24)) and k["activity_peak_hour_sin"] == pytest.approx(math.sin(2 * math.pi * 13 / 24))
    assert (machine["entity_type"], machine["is_single_event"], machine["interarrival_dt_mean"], machine["delta_t_cv"], machine["hour_entropy"]) == ("Machine", 1, None, None, 0.0)
    assert intraday.account_days(log(spark, [])).count() == 0


def test_peak_hour_of_a_tie_is_the_earlier(spark):
    got = by_user(intraday.account_days(log(spark, [("UserT", 1, 3600 * h, 4624, "s", "h", 3) for h in (22, 4, 9)])))
    assert got["UserT"]["activity_peak_hour_sin"] == pytest.approx(math.sin(2 * math.pi * 4 / 24)) and got["UserT"]["hour_entropy"] == pytest.approx(1.0)


def test_new_entities_and_idle_days_by_brute_force(spark):
    import random

    r = random.Random(11)
    seen = {(u, d, r.choice("pqr"), r.choice("xyz")) for u in ("UserM", "UserN") for d in range(1, 30) for _ in range(r.choice((0, 0, 1, 2)))}
    events = log(spark, [(u, d, 50, 4624, s, h, 3) for u, d, s, h in seen])
    got = {(x["UserName"], x["day"]): x for x in history.new_entities(events).collect()}
    idle = {(x["UserName"], x["day"]): x["days_since_last_activity"] for x in history.days_since(events.select("DomainName", "UserName", "day").distinct()).collect()}
    for u, d in {x[:2] for x in seen}:
        recent = lambda i: {x[i] for x in seen if x[0] == u and d - 7 <= x[1] < d}  # noqa: B023, E731
        today = lambda i: {x[i] for x in seen if x[:2] == (u, d)}  # noqa: B023, E731
        assert (got[u, d]["new_source_count_7d"], got[u, d]["new_host_count_7d"]) == (len(today(2) - recent(2)), len(today(3) - recent(3)))
        before = [x[1] for x in seen if x[0] == u and x[1] < d]
        assert idle[u, d] == (d - max(before) if before else None)
    with pytest.raises(ValueError):
        history.days_since(events.select("DomainName", "UserName", "day"), events.select("DomainName", "UserName", "day"))


def test_volume_z_counts_idle_days_and_is_clipped(spark):
    volumes = {1: 6, 3: 9, 4: 30, 6: 2, 7: 11, 8: 14, 9: 10**9}
    m = spark.createDataFrame([("d", "U", d, v) for d, v in volumes.items()], "DomainName string, UserName string, day int, total_logons long")
    got = {r["day"]: r["volume_robust_z_7d"] for r in history.volume_z(m).collect()}
    past = sorted(math.log1p(volumes.get(d, 0)) for d in range(1, 8))
    quarter = lambda p: past[int(6 * p)] + (past[min(6, int(6 * p) + 1)] - past[int(6 * p)]) * (6 * p % 1)
    assert got[8] == pytest.approx((math.log1p(14) - quarter(0.5)) / ((quarter(0.75) - quarter(0.25)) / 1.349))
    assert [got[d] for d in (1, 3, 4, 6, 7)] == [None] * 5 and 5 < got[9] <= 10.0


def test_template_features(spark):
    rows = [("UserA", 1, 36000, 4624, "s1", "h1", 3), ("UserA", 1, 36100, 4624, "s2", "h1", 3), ("UserA", 2, 36000, 4624, "s1", "h1", 3), ("UserA", 3, 36000, 4624, "s1", "h1", 3)]
    rows += [("UserA", 3, 36010, 4624, "s3", "h2", 3), ("UserA", 3, 36020, 4624, "s3", "h2", 3), ("UserB", 3, 40000, 4625, "s9", "h1", 3), ("UserB", 3, 40100, 4625, "s9", "h1", 3), ("UserA", 3, 40200, 4625, "s9", "h1", 3)]
    names = ["novelty_success_source_7d", "novelty_share_success_source_7d", "jaccard_source_7d", "dist_shift_source_7d", "fanout_fail_source", "count_fail_15m", "active_days_7d", "delta_mean_distinct_source_7d"]
    got = by_user(features.build(log(spark, rows), names), 3)
    a, b = got["UserA"], got["UserB"]
    assert a["novelty_success_source_7d"] == pytest.approx(math.log(2))
    assert a["novelty_share_success_source_7d"] == pytest.approx(2 / 3)
    assert a["jaccard_source_7d"] == pytest.approx(0.25) and a["dist_shift_source_7d"] == pytest.approx(0.75)
    assert a["fanout_fail_source"] == pytest.approx(math.log1p(2)) and b["count_fail_15m"] == pytest.approx(math.log1p(2))
    assert b["jaccard_source_7d"] is None and a["active_days_7d"] is None and a["delta_mean_distinct_source_7d"] is None


def test_catalog_counts():
    from collections import Counter

    assert Counter(f.status() for f in grammar.space()) == {"grammar_invalid": 2665, "dropped_r1": 20, "dropped_r2": 209, "dropped_r3": 56, "dropped_r4": 108, "round2": 78}
    assert all(grammar.by_name(n).name == n for n in grammar.SHIPPED)


def test_cleaner(spark):
    df = spark.createDataFrame(
        [(100, 1, 4624, 2, None, "User1", None, None, ""), (200, 1, 4625, 5, "", "User2", "", "0x123", None), (300, 1, 4624, 3, None, " null ", "D", None, None)],
        "Time long, day int, EventID int, LogonType int, LogonTypeDescription string, UserName string, DomainName string, LogonID string, Source string",
    )
    got = by_user(cleaning.clean(df))
    assert set(got) == {"User1", "User2"}
    assert [got["User1"][c] for c in ("DomainName", "Source", "LogonID", "LogonTypeDescription")] == ["Unknown", "Unknown", "Unknown", "Interactive"]
    assert [got["User2"][c] for c in ("LogonID", "LogonTypeDescription")] == ["0x123", "Service"]


def test_json_lines_round_trip(spark, tmp_path):
    import bz2

    lines = ['{"Time": 5, "EventID": 4624, "UserName": "U", "LogonType": "x"}', '{"EventID": 4624, broken', '{"Time": 6, "EventID": 4700}', '{"Time": 7, "EventID": 4625, "UserName": ""}']
    (tmp_path / "wls_day-02.bz2").write_bytes(bz2.compress("\n".join(lines).encode()))
    got = authlog.read_json_lines(spark, str(tmp_path / "wls_day-02.bz2")).orderBy("Time").collect()
    assert [(r["Time"], r["EventID"], r["LogonType"], r["UserName"], r["day"]) for r in got] == [(5, 4624, None, "U", 2), (7, 4625, None, None, 2)]
    events = authlog.read_json_lines(spark, str(tmp_path / "wls_day-02.bz2"))
    authlog.write_events(events, str(tmp_path / "out"))
    back = authlog.read_events(spark, str(tmp_path / "out"), ["Time", "UserName", "Absent"], [2])
    assert back.count() == 2 and back.columns == ["Time", "UserName", "Absent"]
    assert authlog.conform(events.drop("day")).schema == authlog.EVENT_SCHEMA
    with pytest.raises(ValueError):
        authlog.conform(events.drop("Time"))


def test_append_log_and_manifest(spark):
    old = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    out = authlog.append_log(old, spark.createDataFrame([("b", 3, 1.0), ("c", 2, 2.0), ("c", 5, 2.0)], "k string, v int, extra double"), ["k"])
    assert sorted(r["k"] for r in out.collect()) == ["a", "b", "c"]
    have, want = (spark.createDataFrame(x, "path string, sha256 string") for x in ([("a", "1"), ("b", "2")], [("a", "1"), ("b", "3"), ("c", "4")]))
    assert sorted(tuple(r) for r in authlog.verify_manifest(have, want).collect()) == [("b", "differs"), ("c", "missing")]


def test_lockout_episode(spark):
    rows = [("UserA", 1, t, 4625, "s", "h", 3) for t in (100, 200, 300)] + [("UserA", 1, 250, 4624, "s", "h", 3)]
    e = log(spark, rows)
    lock = e.limit(1).withColumn("event_id", F.lit(99).cast("long")).withColumn("Time", F.lit(400).cast("long")).withColumn("FailureReason", F.lit("Account locked out."))
    got = profiles.lockouts(e.unionByName(lock)).collect()
    assert [(r["Time"], r["streak"], r["in_window"]) for r in got] == [(400, 3, 3)]


def test_thresholds_and_ranking(spark):
    s = spark.createDataFrame([(i, float(i), int(i in (9, 7))) for i in range(10)], "id int, s double, y int")
    assert baselines.budget_threshold(s, "s", 0.15, "higher").first()[0] == 8.0
    assert baselines.budget_threshold(s, "s", 0.15).first()[0] == pytest.approx(7.65)
    r = evaluation.ranking(s, "s", "y").first()
    assert r["pr_auc"] == pytest.approx((1 + 2 / 3) / 2) and r["roc_auc"] == pytest.approx(15 / 16)
    assert evaluation.ranking(s.limit(0), "s", "y").count() == 0
    assert evaluation.budget_size(5, 0.5) == 2 and evaluation.budget_size(1, 0.01) == 1


def test_labels_default_and_repeat(spark):
    m = spark.createDataFrame([("d", "a", 1), ("d", "b", 1)], "DomainName string, UserName string, day int")
    lab = spark.createDataFrame([("d", "a", 1, 1, False)], "DomainName string, UserName string, day int, is_anomaly int, eval_exclude boolean")
    keys = ["DomainName", "UserName", "day"]
    assert sorted((r["UserName"], r["is_anomaly"]) for r in evaluation.with_labels(m, lab, keys).collect()) == [("a", 1), ("b", 0)]
    with pytest.raises(ValueError):
        evaluation.with_labels(m, lab.unionByName(lab), keys)


def test_detectors_rank_an_outlier_first(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(300, 3))
    rows = [(i, *map(float, v), True) for i, v in enumerate(x)] + [(999, 9.0, 9.0, 9.0, False)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, train boolean")
    for name in detectors.DETECTORS:
        got = detectors.fit_and_score(df, F.col("train"), ["a", "b", "c"], name, sample_rows=500)
        assert got.orderBy(F.desc(f"{name}_score")).first()["id"] == 999, name


def test_detectors_fit_on_all_rows(spark):
    import numpy as np

    # more rows than the former sample of 20,000, a fifth of them copies of one
    x = np.concatenate([np.random.default_rng(2).normal(size=(20_400, 2)), np.full((5_100, 2), 0.25)])
    df = spark.createDataFrame([(i, *map(float, v), True) for i, v in enumerate(x)], "id int, a double, b double, train boolean")
    rows = detectors.distinct_rows(df, F.col("train"), ["a", "b"])
    assert rows.agg(F.sum("copies"), F.count("*")).first()[:] == (25_500, 20_401)
    draws, size = detectors.drawn(rows, 40, 256, 1)
    got = [detectors.in_order(t, size, 2) for t in (draws.filter(F.col("draw") == d).toArrow() for d in (0, 7, 39))]
    again = detectors.drawn(rows.repartition(7), 40, 256, 1)[0].filter("draw = 7").toArrow()
    assert np.array_equal(got[1], detectors.in_order(again, size, 2)) and all(len(g) == 256 for g in got)
    assert all(25 < (g == 0.25).all(1).sum() < 80 for g in got)  # 51 expected
    # every row's neighbours, by brute force over all distinct rows
    base = np.unique(x, axis=0)
    gap = lambda p: np.sqrt(((base - p) ** 2).sum(1))
    near = lambda p: np.argsort(gap(p), kind="stable")
    others = lambda i: near(base[i])[1:21]
    reach = lambda i: np.sort(gap(base[i]))[20]
    density = lambda i: 1 / (np.mean([max(gap(base[i])[j], reach(j)) for j in others(i)]) + 1e-10)
    lof = {r["id"]: r["lof_score"] for r in detectors.fit_and_score(df, F.col("train"), ["a", "b"], "lof").collect()}
    assert len(lof) == 25_500 and len({lof[i] for i in range(20_400, 25_500)}) == 1
    for i in (3, 11_111, 25_000):
        mine = near(x[i])[:20]
        own = 1 / (np.mean([max(gap(x[i])[j], reach(j)) for j in mine]) + 1e-10)
        assert abs(lof[i] - np.mean([density(j) for j in mine]) / own) < 1e-9
    # about nu of all training rows are outside
    svm = detectors.fit_and_score(df, F.col("train"), ["a", "b"], "ocsvm", components=30)
    assert abs(svm.filter("ocsvm_score > 0").count() / 25_500 - 0.05) < 0.01


def test_detector_queries_see_every_dimension(spark, tmp_path):
    import numpy as np

    from sentrylake.plans import catalog

    x = np.random.default_rng(4).normal(size=(120, 12))
    x[4, :8] = x[0, :8]  # alike in the first 8 dimensions alone
    spark.createDataFrame([(i, i % 2, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name, score in (("b_isolation_forest", "iforest_score"), ("b_lof", "lof_score")):
        got = {r["vec_id"]: r[score] for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
        assert len(got) == 120 and got[0] != got[4], name


def test_quotas():
    assert injection.quota(99, 0.01) == 1
    assert injection.shares(10, {"a": 1, "b": 1, "c": 1}) == {"a": 4, "b": 3, "c": 3}
    assert injection.shares(10, {"a": 1, "b": 1}, {"a": 2, "b": 20}) == {"a": 2, "b": 8}


def test_injection_is_deterministic(spark):
    a = log(spark, [("UserA", 1, 100, 4624, "s1", "h1", 3), ("UserB", 1, 200, 4624, "s2", "h2", 3)])
    plan = injection.victims(a, [1]).select("DomainName", "UserName", F.lit(86390).cast("long").alias("start"))
    one, two = (sorted(map(tuple, injection.brute_force(x, plan, failures=5).select("UserName", "Time", "EventID", "day").collect())) for x in (a, a.repartition(7)))
    assert one == two and len(one) == 10 and {r[3] for r in one} == {1} and max(r[1] for r in one) <= 86399
    moved = injection.retarget(a.withColumn("SubjectUserName", F.when(F.col("UserName") == "UserA", F.col("UserName")).otherwise("C5$")), F.lit("x"), F.lit("Z"))
    assert sorted(r["SubjectUserName"] for r in moved.collect()) == ["C5$", "Z"]


def test_selection_drops_a_copy(spark):
    df = spark.range(200).select((F.col("id") % 17).cast("double").alias("a"), ((F.col("id") * 7) % 13).cast("double").alias("b")).withColumn("c", F.col("a") * 2 + 1)
    assert statistics.select_features(df, ["a"], ["c", "b"]) == ["b"]
    assert statistics.vif(df, ["a", "b"])["a"] == pytest.approx(1, abs=0.1)


def test_streaming_buckets(spark, tmp_path):
    from sentrylake.streaming import live

    e = log(spark, [("UserA", 1, 100, 4625, "s1", "h1", 3), ("UserA", 1, 200, 4624, "s2", "h1", 3), ("UserA", 1, 4000, 4624, "s1", "h1", 3)])
    live.with_event_time(e).write.parquet(str(tmp_path / "in"))
    stream = live.bucket_counts(spark.readStream.schema(live.with_event_time(e).schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("buckets").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["n"], r["failures"]) for r in spark.sql("select * from buckets").collect()) == [(1, 0), (2, 1)]
    seen = live.new_sources(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = seen.writeStream.outputMode("append").format("memory").queryName("fresh").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["Source"] for r in spark.sql("select * from fresh").collect()) == ["s1", "s2"]


def test_prefix_sums_and_quantiles_against_numpy(spark):
    import numpy as np

    from sentrylake.operators import ordered

    r = np.random.default_rng(6)
    for values in (r.lognormal(0, 4, 3000), np.repeat([1.5, -2.0], 50), np.array([3.0]), r.integers(0, 9, 500).astype(float)):
        df = spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(values)] + [(None, 0)], "v double, g int")
        got = ordered.quantiles(df, "v", [0, 0.013, 0.25, 0.5, 0.99, 1]).first()["q"]
        assert got == pytest.approx(np.quantile(values, [0, 0.013, 0.25, 0.5, 0.99, 1]).tolist())
        each = {x["g"]: x["q"] for x in ordered.quantiles(df, "v", [0.4], ["g"]).collect()}
        assert all(each[g] == pytest.approx([np.quantile(values[g::3], 0.4)]) for g in each)
        below = ordered.prefix_sums(df.groupBy("v").agg(F.count("*").alias("n")), "v", ["n"], 7).collect()
        assert all(x["n_before"] == (values < x["v"]).sum() and x["n_all"] == len(values) for x in below) and len(below) == len(set(values))
    assert ordered.quantiles(df.limit(0), "v", [0.5]).first()["q"] is None


def test_unseen_sources_finds_the_last_one(spark):
    """An account that used all sources but one gets that one; one that used all gets none."""
    rows = [("UserA", 1, i, 4624, f"s{i:02d}", "h", 3) for i in range(40) if i != 17] + [("UserB", 1, i, 4624, f"s{i:02d}", "h", 3) for i in range(40)]
    got = {r["UserName"]: r["Source"] for r in injection.unseen_sources(log(spark, rows + [("UserC", 1, 5, 4624, None, "h", 3)]), 0.0, 1.0).collect()}
    assert got["UserA"] == "s17" and "UserB" not in got and got["UserC"].startswith("s")


def labelled(spark, n=180, seed=3):
    import numpy as np

    r = np.random.default_rng(seed)
    rows = [(i, int(r.integers(1, 6)), float(r.integers(0, 40)), int(r.random() < 0.15)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, day int, s double, y int")


def test_labelled_metrics_by_brute_force(spark):
    from sentrylake.operators import runner

    rows, df = labelled(spark)
    got = runner.labelled_metrics(df, "s", "y", ["id"], (5, 50, 500), 0.1, (2, 9)).first()
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    positives = sum(r[3] for r in rows)
    assert got["n_positive"] == positives and got["positive_rate_pct"] == pytest.approx(100 * positives / 180)
    assert got["precision_at_5"] == pytest.approx(sum(r[3] for r in order[:5]) / 5) and got["precision_at_500"] is None
    assert got["recall_at_budget"] == pytest.approx(sum(r[3] for r in order[:18]) / positives)
    days = {d: [r for r in order if r[1] == d] for d in range(1, 6)}
    for n in (2, 9):
        assert got[f"recall_at_{n}_per_day"] == pytest.approx(sum(r[3] for v in days.values() for r in v[:n]) / positives)
    assert got["precision_at_5_per_day"] == pytest.approx(sum(sum(r[3] for r in v[:5]) / 5 for v in days.values()) / 5)
    better = sum((a[2] > b[2]) + (a[2] == b[2]) / 2 for a in rows for b in rows if a[3] and not b[3])
    assert got["roc_auc"] == pytest.approx(better / positives / (180 - positives))
    none = runner.labelled_metrics(df.withColumn("y", F.lit(0)), "s", "y", ["id"], (5,), 0.1, (2,)).first()
    assert none["n_positive"] == 0 and all(none[c] is None for c in none.asDict() if c not in ("n_positive", "positive_rate_pct"))
    undated = runner.labelled_metrics(df, "s", "y", ["id"], (5,), 0.1, (2,), daily=False).first()
    assert undated["recall_at_2_per_day"] is None and undated["pr_auc"] == pytest.approx(got["pr_auc"])


def test_evaluate_leaves_out_excluded_rows_first(spark):
    from sentrylake.operators import runner

    rows, df = labelled(spark)
    aligned = df.select("id", "day", F.col("s").alias("score"), F.col("y").alias("is_anomaly"), (F.col("id") % 4 == 0).alias("eval_exclude"), F.when(F.col("y") == 1, (F.col("id") % 7).cast("string")).alias("campaign_id"))
    got = runner.evaluate(aligned, "score", 30.0, ["id"], [3]).first()
    kept = [r for r in rows if r[0] % 4]
    hits = [r for r in kept if r[2] > 30]
    assert (got["n_rows"], got["n_excluded"], got["n_eval"]) == (180, 45, 135)
    assert (got["tp"], got["fp"]) == (sum(r[3] for r in hits), sum(1 - r[3] for r in hits))
    assert got["campaigns"] == len({r[0] % 7 for r in kept if r[3]}) and got["campaigns_caught"] == len({r[0] % 7 for r in hits if r[3]})
    assert got["alerts_per_day_max"] == max(sum(r[1] == d for r in hits) for d in range(1, 6))
    assert got["random_pr_auc"] == pytest.approx(sum(r[3] for r in kept) / 135)


def test_guards_and_days(spark):
    from sentrylake.operators import runner

    _, df = labelled(spark)
    runner.check_scores(df, "s", "y")
    for bad in (df.limit(0), df.withColumn("s", F.lit(float("nan"))), df.withColumn("y", F.lit(2)), df.withColumn("y", F.lit(0))):
        with pytest.raises(ValueError):
            runner.check_scores(bad, "s", "y")
    assert runner.restrict_days(df, 1, [3, 2]).select("day").distinct().count() == 2
    for days in ([], [1, 2], [2, 77]):
        with pytest.raises(ValueError):
            runner.restrict_days(df, 1, days)


def test_percentile_and_threshold_against_numpy(spark):
    import numpy as np

    from sentrylake.operators import runner

    rows, df = labelled(spark)
    reference = np.sort([r[2] for r in rows if r[3]])
    got = {r["id"]: r["p"] for r in runner.percentile_among(df, "s", df.filter("y = 1"), "s", "p").collect()}
    for i, _, s, _ in rows:
        assert got[i] == pytest.approx(np.clip((np.searchsorted(reference, s, "right") - 1) / (len(reference) - 1), 0, 1))
    single = runner.percentile_among(df, "s", df.limit(1), "s", "p")
    assert single.select("p").distinct().collect()[0][0] == 1.0
    cut = runner.fitted_threshold(df, "s", 0.1)
    assert cut == pytest.approx(np.quantile([r[2] for r in rows], 0.9)) and runner.predicted(df, "s", cut).filter("alert").count() == sum(r[2] >= cut for r in rows)


def test_segments_and_grid_end_to_end(spark):
    import numpy as np

    from sentrylake.operators import runner

    r = np.random.default_rng(9)
    rows = [("d", f"User{i % 30}", 1 + i // 30, "A" if i % 3 else "B", *map(float, r.normal(size=2) + (8 if i in (200, 231) else 0)), int(i in (200, 231))) for i in range(240)]
    df = spark.createDataFrame([*rows, ("d", "x", 9, "C", 0.0, 0.0, 0)], "DomainName string, UserName string, day int, kind string, a double, b double, y int")
    keys, train = ["DomainName", "UserName", "day"], F.col("day") <= 5
    with pytest.warns(UserWarning, match="C"):
        scores, cuts = runner.run_segments(df, train, ["a", "b"], keys, ["zscore_global", "zscore_account", "rule_ecdf", "random", "iforest"], "kind", ["A", "B"])
    assert scores.count() == 5 * 240 and cuts.count() == 10 and {r_["n_train"] for r_ in cuts.collect()} == {100, 50}
    labels = df.filter("y = 1").select(*keys, F.lit(1).alias("is_anomaly"), F.lit(False).alias("eval_exclude"), F.lit("c").alias("campaign_id"))
    table = {(x["segment"], x["method"]): x for x in runner.evaluate_segments(scores, cuts, labels, keys, [3]).collect()}
    for s, m in table:
        x = table[s, m]
        assert x["n_eval"] == (60 if s == "A" else 30)
    found = {s for s in "AB" if any(rows[i][3] == s for i in (200, 231))}
    assert all(table[s, m]["pr_auc"] == pytest.approx(1.0) for s in found for m in ("zscore_global", "iforest"))
    with pytest.raises(ValueError):
        runner.run_segments(df, train, ["a"], keys, ["nothing"], "kind", ["A"])
    grid = [{"id": "few", "model": "isolation_forest", "trees": 5}, {"id": "many", "model": "isolation_forest", "trees": 40}]
    runs = runner.run_grid(df.filter("kind <> 'C'"), train, ["a", "b"], keys, "y", grid, [1, 2])
    summary = {x["config_id"]: x for x in runner.summarised(runs).collect()}
    assert runs.count() == 4 and summary["many"]["pr_auc_n"] == 2 and summary["many"]["pr_auc_mean"] > 0.9
    assert runner.best_of(runner.summarised(runs)).first()["config_id"] in ("few", "many")
    with pytest.raises(ValueError):
        runner.run_grid(df, train, ["a"], keys, "y", grid + grid[:1], [1])


def test_best_of_a_tie_is_the_first_id(spark):
    from sentrylake.operators import runner

    summary = spark.createDataFrame([("m", "b", 0.5), ("m", "a", 0.5), ("m", "c", None), ("n", "z", None)], "model string, config_id string, pr_auc_mean double")
    assert {r["model"]: r["config_id"] for r in runner.best_of(summary).collect()} == {"m": "a", "n": "z"}


def test_blocks_presence_and_exclusions(spark):
    conf = {"common": {"split_day": 5, "template": {"n": 3, "m": 1}}, "blocks": {"dev": {"days": [7, 6], "seed": 4, "common": {"template": {"n": 9}}, "scenarios": {"x": {}, "y": {"enabled": False}}}, "late": {"days": [4], "seed": 1, "scenarios": {}}}}
    got = injection.resolve_block(conf, "dev", 1)
    assert (got["days"], got["seed"], got["run_id"], got["split_day"], list(got["scenarios"]), got["common"]["template"]) == ([6, 7], 4, "dev_seed4", 5, ["x"], {"n": 9, "m": 1})
    assert injection.resolve_block(conf, "dev", 1, seed=8)["run_id"] == "dev_seed8"
    with pytest.raises(ValueError):
        injection.resolve_block(conf, "late", 1)
    with pytest.raises(KeyError):
        injection.resolve_block(conf, "none", 1)
    events = log(spark, [("UserA", 6, 5, 4624, "s", "h", 3), ("UserA", 7, 5, 4624, "s", "h", 3), ("null", 6, 5, 4624, "s", "h", 3), ("UserB", 6, 9, 4624, "s", "h", 3)])
    assert {(r["UserName"], r["day"]) for r in injection.presence(events, [6, 7]).collect()} == {("UserA", 6), ("UserA", 7), ("UserB", 6)}
    with pytest.raises(ValueError):
        injection.presence(events, [6, 8])
    scores = spark.createDataFrame([("A", "m", "dom1", "UserA", 6, False, 2.0), ("A", "m", "dom1", "UserB", 6, False, 0.5), ("A", "m", "dom1", "UserA", 5, True, 9.0)], "segment string, method string, DomainName string, UserName string, day int, is_train boolean, score double")
    out = injection.flagged(scores, spark.createDataFrame([("A", "m", 1.0)], "segment string, method string, threshold double"), "A", "m")
    assert [tuple(r) for r in out.collect()] == [("dom1", "UserA", 6)]
    assert {(r["UserName"], r["day"]) for r in injection.eligible(events, [6, 7], out).collect()} == {("UserA", 7), ("UserB", 6)}


def test_replay_keeps_gaps_and_the_day(spark):
    e = log(spark, [("UserA", 1, t, 4624, "s", "h", 3) for t in (100, 700, 80_000)])
    got = [sorted(r["Time"] for r in injection.replayed(e, F.lit(s), c).collect()) for s, c in ((50, 1.0), (50, 0.5), (10_000, 1.0))]
    assert got == [[150, 750, 80_050], [150, 450, 40_100], [10_100, 10_700, 86_399]]


def test_footers_conversion_and_splitting(spark, tmp_path):
    import bz2

    raw = tmp_path / "raw"
    raw.mkdir()
    for day in (1, 2):
        (raw / f"wls_day-0{day}.bz2").write_bytes(bz2.compress(b'{"Time": 5, "EventID": 4624, "UserName": "U"}\n{"Time": 6, "EventID": 4625, "UserName": "U"}\n'))
    paths = [str(raw / f"wls_day-0{d}.bz2") for d in (1, 2)] + [str(raw / "wls_day-09.bz2")]
    got = {r["file"][-6:-4]: (r["rows"], r["error"] is None) for r in authlog.convert_files(spark, paths, str(tmp_path / "typed")).collect()}
    assert got == {"01": (2, True), "02": (2, True), "09": (None, False)}
    assert authlog.convert_files(spark, paths, str(tmp_path / "one"), max_files=1).count() == 1
    (tmp_path / "typed" / "broken.parquet").write_bytes(b"no parquet")
    facts = authlog.footer_facts(spark, str(tmp_path / "typed")).collect()
    assert sum(r["rows"] or 0 for r in facts) == 4 and sum(r["error"] is not None for r in facts) == 1 and all(r["row_groups"] == 1 for r in facts if r["rows"])
    mixed = spark.createDataFrame([("4624", 1, 5), ("4625", 1, 6), ("x", 1, 7)], "EventID string, day int, Time long")
    mixed.write.parquet(str(tmp_path / "a"))
    mixed.withColumn("EventID", F.expr("try_cast(EventID AS INT)")).withColumn("day", F.lit(2)).write.parquet(str(tmp_path / "b"))
    mixed.withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "c"))
    authlog.split_by_event(spark, [str(tmp_path / "a"), str(tmp_path / "b")], str(tmp_path / "split"))
    back = spark.read.parquet(str(tmp_path / "split"))
    assert sorted((r["EventID"], r["day"]) for r in back.collect()) == [(4624, 1), (4624, 2), (4625, 1), (4625, 2)]
    with pytest.raises(ValueError):
        authlog.split_by_event(spark, [str(tmp_path / "a"), str(tmp_path / "c")], str(tmp_path / "none"))
    assert authlog.resolved_day(back, back.filter("day = 2"), 2).count() == 2 and authlog.resolved_day(back, None, 1).count() == 2
    with pytest.raises(ValueError):
        authlog.resolved_day(back, back.filter("day = 2 and EventID = 4624"), 2)


def test_profiles_are_saved_and_looked_up(spark, tmp_path):
    e = log(spark, [("UserA", 1, 1, 4624, "s2", "h", 3), ("UserA", 2, 1, 4624, "s1", "h", 3), ("UserB", 1, 1, 4624, "Unknown", "h", 3)])
    profiles.save_profiles({"sources": profiles.known_values(e, "Source"), "types": profiles.logon_type_shares(e)}, str(tmp_path / "p"))
    tables = profiles.load_profiles(spark, str(tmp_path / "p"), ["sources", "types"])
    mine = profiles.account(tables, "dom1", "UserA")
    assert mine["sources"].first()["known"] == ["s1", "s2"] and mine["types"].first()["n"] == 2
    assert profiles.account(tables, "dom1", "UserB")["sources"].count() == 0
    with pytest.raises(Exception):
        profiles.load_profiles(spark, str(tmp_path / "p"), ["absent"])


def test_streaming_sessions_and_batches(spark, tmp_path):
    from sentrylake.streaming import live

    e = live.with_event_time(log(spark, [("UserA", 1, t, 4625, "s", "h", 3) for t in (0, 600, 9000)] + [("UserA", 1, 300, 4624, "s", "h", 3)]))
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = live.failure_sessions(stream).writeStream.outputMode("complete").format("memory").queryName("runs").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["failures"] for r in spark.sql("select * from runs").collect()) == [1, 2]
    q = live.score_by_batch(stream, lambda batch: batch.groupBy("UserName").count(), str(tmp_path / "out"), str(tmp_path / "check")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).first()["count"] == 4
