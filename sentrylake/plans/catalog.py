"""Every registered query of the analytics engine, with its SQL for the other engine where SQL can say it.

Doubles are rounded to six decimals on both sides, as summation order differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions import predicates as P
from sentrylake.operators import baselines, cleaning, detectors, evaluation, history, injection, intraday, profiles, reporting, runner, statistics
from sentrylake.plans import features, grammar
from sentrylake.sources import authlog
from sentrylake.sources.authlog import AUTH_SQL
from sentrylake.storage import Scratch

FLAGSHIP = "f_account_day"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
K = "DomainName, UserName, day"
KEYS = ["DomainName", "UserName", "day"]
SPLIT = 21


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def auth(spark: SparkSession, d: str) -> DataFrame:
    return authlog.auth_from_events(events(spark, d))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits``; -0.0 becomes 0.0."""
    return df.select(*[(F.round(F.col(f"`{n}`"), digits) + 0.0).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def as_bigint(sql: str) -> str:
    """Every count_if( ) as BIGINT: the SQL engine counts in 128 bits otherwise."""
    out, at = "", 0
    while (found := sql.find("count_if(", at)) >= 0:
        stop, depth = found + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[stop], 0)
            stop += 1
        out += sql[at:found] + f"CAST({sql[found:stop]} AS BIGINT)"
        at = stop
    return out + sql[at:]


def query(name: str, sql: str | None = None, with_auth: bool = True):
    def keep(f):
        _QUERIES[name] = lambda spark, d: rounded(f(spark, d))
        if sql:
            sql_ = as_bigint(sql)
            _SQL[name] = (f"WITH {AUTH_SQL}, " if with_auth and sql.lstrip().startswith(",") else f"WITH {AUTH_SQL} " if with_auth else "") + sql_.lstrip().lstrip(",")
        return f

    return keep


OFF = """(("Time" % 86400) // 3600 >= 18 OR ("Time" % 86400) // 3600 <= 7)"""
OFF_SURVEY = """(("Time" % 86400) // 3600 >= 18 OR ("Time" % 86400) // 3600 <= 6)"""
ETYPE = "CASE WHEN UserName LIKE '%$' THEN 'Machine' WHEN UserName LIKE 'User%' THEN 'User' ELSE 'Other' END"

# ---------------------------------------------------------------- account-day features


@query(
    "f_account_day",
    f"""
, g AS (SELECT *, "Time" - lag("Time") OVER (PARTITION BY {K} ORDER BY "Time") AS gap FROM auth),
h AS (SELECT {K}, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h, count(*) AS k FROM (SELECT {K}, ("Time" % 86400) // 3600 AS v, count(*) AS n FROM auth GROUP BY ALL) GROUP BY {K}),
p AS (SELECT {K}, v FROM (SELECT {K}, v, row_number() OVER (PARTITION BY {K} ORDER BY n DESC, v) AS r FROM (SELECT {K}, ("Time" % 86400) // 3600 AS v, count(*) AS n FROM auth GROUP BY ALL)) WHERE r = 1),
l AS (SELECT {K}, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h, count(*) AS k FROM (SELECT {K}, LogHost AS v, count(*) AS n FROM auth GROUP BY ALL) GROUP BY {K}),
a AS (SELECT {K}, {ETYPE} AS entity_type, count(*) AS n, count_if(EventID = 4625) AS f, count_if(coalesce(EventID = 4625 AND lower(FailureReason) LIKE '%account locked out%', FALSE)) AS locked,
  count_if({OFF}) AS o, avg(gap) AS m, stddev_samp(gap) AS sd, count_if(coalesce(gap = 0, FALSE)) AS same, count_if(LogonType = 2) AS i, count_if(LogonType NOT IN (2, 3)) AS rare,
  count_if(lower(AuthenticationPackage) LIKE '%ntlm%') AS ntlm, count(DISTINCT LogHost) AS hosts, count(DISTINCT Source) AS sources, count_if(Source IS NULL) AS miss,
  count_if(coalesce(Source <> LogHost, FALSE)) AS remote, count_if(lower(ProcessName) LIKE 'proc%') AS custom
  FROM g GROUP BY {K}, entity_type)
SELECT {K}, entity_type, n AS total_logons, round(f / n, 6) AS failure_ratio, CASE WHEN f > 0 THEN round(locked / f, 6) END AS failure_locked_out_share,
  round(o / n, 6) AS off_hours_ratio, round(m, 6) AS interarrival_dt_mean, CASE WHEN m > 0 THEN round(sd / m, 6) END AS delta_t_cv, round(same / n, 6) AS same_second_share,
  CAST(n = 1 AS INT) AS is_single_event, round(i / n, 6) AS interactive_ratio, rare AS rare_logon_type_count, round(ntlm / n, 6) AS ntlm_ratio, hosts AS distinct_hosts,
  sources AS distinct_sources_count, round(miss / n, 6) AS missing_source_ratio, round(remote / n, 6) AS remote_logon_ratio, round(custom / n, 6) AS custom_proc_share,
  round(CASE WHEN h.k > 1 THEN h.h / ln(h.k) ELSE 0.0 END, 6) + 0.0 AS hour_entropy, round(CASE WHEN l.k > 1 THEN l.h / ln(l.k) ELSE 0.0 END, 6) + 0.0 AS dst_host_entropy,
  round(sin(p.v * 2 * pi() / 24), 6) + 0.0 AS activity_peak_hour_sin, round(cos(p.v * 2 * pi() / 24), 6) + 0.0 AS activity_peak_hour_cos
FROM a JOIN h USING ({K}) JOIN p USING ({K}) LEFT JOIN l USING ({K})""",
)
def f_account_day(spark, d):
    return intraday.account_days(auth(spark, d))


@query(
    "f_processed",
    f"""SELECT {K}, round(ln(1 + count(*)), 6) AS log_total_logons, round(ln(1 + count(DISTINCT LogHost)), 6) AS log_distinct_hosts,
  round(ln(1 + count_if(LogonType NOT IN (2, 3))), 6) + 0.0 AS rare_logon_type_count_log,
  round(coalesce(count_if(EventID = 4625 AND FailureReason LIKE 'Account locked%') / nullif(count_if(EventID = 4625), 0), 0), 6) AS failure_locked_out_share FROM auth GROUP BY {K}""",
)
def f_processed(spark, d):
    return intraday.processed(intraday.account_days(auth(spark, d))).select(*KEYS, "log_total_logons", "log_distinct_hosts", "rare_logon_type_count_log", "failure_locked_out_share")


@query(
    "f_failure_streaks",
    f"""
, r AS (SELECT *, CAST(EventID = 4625 AS INT) AS f, lag(CAST(EventID = 4625 AS INT)) OVER w AS p, sum(CAST(EventID <> 4625 AS INT)) OVER w AS g FROM auth WINDOW w AS (PARTITION BY {K} ORDER BY "Time", event_id)),
s AS (SELECT {K}, max(n) AS max_failure_streak FROM (SELECT {K}, g, sum(f) AS n FROM r GROUP BY {K}, g) GROUP BY {K})
SELECT {K}, CAST(max_failure_streak AS BIGINT) AS max_failure_streak, round(coalesce(count_if(f = 0 AND p = 1) / nullif(count_if(f = 0), 0), 0), 6) AS success_after_failure_ratio
FROM r JOIN s USING ({K}) GROUP BY {K}, max_failure_streak""",
)
def f_failure_streaks(spark, d):
    return intraday.failure_streaks(auth(spark, d))


@query(
    "f_contract",
    f"""SELECT count(*) AS rows, count(DISTINCT (DomainName, UserName, day)) AS distinct_keys, count_if(DomainName IS NULL OR UserName IS NULL OR day IS NULL) AS null_keys, count_if(f < 0 OR f > 1) AS out_of_range_failure_ratio, count_if(t < 0 OR t > 1) AS out_of_range_ntlm_ratio
FROM (SELECT {K}, count_if(EventID = 4625) / count(*) AS f, count_if(lower(AuthenticationPackage) LIKE '%ntlm%') / count(*) AS t FROM auth GROUP BY {K})""",
)
def f_contract(spark, d):
    return intraday.validate(intraday.account_days(auth(spark, d)), ["failure_ratio", "ntlm_ratio"])


PRESENCE = f"""pr AS (SELECT DISTINCT {K}, 'Source' AS kind, Source AS v FROM auth WHERE Source IS NOT NULL UNION ALL SELECT DISTINCT {K}, 'LogHost', LogHost FROM auth WHERE LogHost IS NOT NULL),
pl AS (SELECT *, lag(day) OVER (PARTITION BY DomainName, UserName, kind, v ORDER BY day) AS prev FROM pr)"""


@query(
    "h_new_entities",
    f"""
, {PRESENCE}
SELECT {K}, CAST(count_if(kind = 'Source' AND (prev IS NULL OR prev < day - 7)) AS INT) AS new_source_count_7d, CAST(count_if(kind = 'LogHost' AND (prev IS NULL OR prev < day - 7)) AS INT) AS new_host_count_7d,
  count_if(kind = 'Source' AND prev IS NULL) AS new_source_count, min(CASE WHEN kind = 'Source' THEN day - prev END) AS source_recency FROM pl GROUP BY {K}""",
)
def h_new_entities(spark, d):
    return history.new_entities(auth(spark, d))


@query("h_days_since", f"SELECT {K}, CAST(day - lag(day) OVER (PARTITION BY DomainName, UserName ORDER BY day) AS INT) AS days_since_last_activity FROM (SELECT DISTINCT {K} FROM auth)")
def h_days_since(spark, d):
    return history.days_since(auth(spark, d).select(*KEYS).distinct())


@query(
    "h_volume_z",
    f"""
, a AS (SELECT {K}, ln(1 + count(*)) AS v FROM auth GROUP BY {K}), f AS (SELECT min(day) AS d0 FROM a),
grid AS (SELECT a.DomainName, a.UserName, a.day, a.v, coalesce(b.v, 0) AS pv FROM a CROSS JOIN range(1, 8) AS o(k) LEFT JOIN a b ON b.DomainName = a.DomainName AND b.UserName = a.UserName AND b.day = a.day - o.k),
s AS (SELECT {K}, v, quantile_cont(pv, 0.5) AS m, (quantile_cont(pv, 0.75) - quantile_cont(pv, 0.25)) / 1.349 AS iqr, stddev_samp(pv) AS sd FROM grid GROUP BY {K}, v)
SELECT {K}, CASE WHEN day - 7 >= d0 THEN round(CASE WHEN iqr > 1e-9 THEN greatest(-10.0, least(10.0, (v - m) / iqr)) WHEN sd > 1e-9 THEN greatest(-10.0, least(10.0, (v - m) / sd)) ELSE 0.0 END, 6) + 0.0 END AS volume_robust_z_7d FROM s, f""",
)
def h_volume_z(spark, d):
    return history.volume_z(auth(spark, d).groupBy(*KEYS).agg(F.count("*").alias("total_logons")))


# ---------------------------------------------------------------- grammar and its features


def text_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: the grammar's rules over its fixed values: what fits, names, costs, targets, and why a combination is left out
GRAMMAR_SQL = f"""m AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {text_list(v.entities)}, {text_list(v.windows)}, {v.weight}, '{v.direction}', {text_list(v.objects)})" for k, v in grammar.MEASURES.items())}) AS t(measure, entities, windows, weight, direction, objects)),
e AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in grammar.SPOKEN.items())}) AS t(entity, spoken)),
known AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{o}', '{e}', '{w}')" for k, v in grammar.KNOWN.items() for o, e, w in v)}) AS t(measure, obj, entity, "window")),
x AS (SELECT measure, obj, entity, "window", direction, weight, spoken, windows, measure IN ('deviation', 'delta_mean', 'peer_z') AS on_base, measure IN ('novelty', 'novelty_share', 'jaccard', 'dist_shift', 'deviation', 'delta_mean') AS past,
    CASE WHEN entity <> 'event' THEN 'distinct' WHEN obj = 'all' THEN 'count' ELSE 'share' END AS base, entity IN ('Source', 'LogHost', 'pair') AS place,
    list_contains(objects, obj) AND list_contains(entities, entity) AND list_contains(windows, "window") AND NOT (entity = 'fail_reason' AND obj <> 'fail') AND NOT (entity = 'hour' AND (obj = 'night' OR "window" IN ('5m', '15m', '60m'))) AS fits
  FROM m CROSS JOIN (SELECT unnest({text_list(grammar.OBJECTS)}) AS obj) CROSS JOIN e CROSS JOIN (SELECT unnest({text_list(grammar.WINDOWS)}) AS "window")),
y AS (SELECT *, concat_ws('_', measure, CASE WHEN on_base THEN base END, nullif(obj, 'all'), nullif(spoken, ''), nullif("window", '1d')) AS name,
    weight + CAST(obj <> 'all' AS INT) + CAST(entity IN ('pair', 'auth', 'fail_reason') AS INT) + CAST("window" IN ('14d', 'hist') AS INT) AS cost,
    CASE WHEN obj = 'fail' THEN CASE WHEN place OR entity = 'event' THEN 'brute_force,password_spraying' WHEN entity = 'fail_reason' THEN 'brute_force' ELSE '' END
      WHEN obj = 'night' THEN CASE WHEN entity = 'event' THEN 'off_hours' ELSE '' END
      WHEN entity IN ('hour', 'logon_type') THEN CASE WHEN NOT past THEN '' WHEN entity = 'hour' THEN 'off_hours' ELSE 'logon_type_switch' END
      WHEN place THEN CASE WHEN measure IN ('evenness', 'fanout') THEN '' WHEN entity = 'Source' THEN 'new_workstation_burst' WHEN entity = 'LogHost' THEN 'lateral_fanout' ELSE 'lateral_fanout,new_workstation_burst' END
      WHEN entity = 'event' AND measure IN ('delta_mean', 'deviation', 'active_days', 'recency') THEN 'dormant_wakeup' ELSE '' END AS scenarios,
    ("window" = '14d' AND list_contains(windows, '7d')) OR "window" IN ('5m', '60m') OR measure = 'deviation' OR (obj = 'success' AND measure NOT IN ('novelty', 'novelty_share')) AS redundant FROM x),
g AS (SELECT measure, obj, entity, "window", name, cost, direction, CASE WHEN NOT fits THEN 'grammar_invalid' WHEN (measure, obj, entity, "window") IN (SELECT (measure, obj, entity, "window") FROM known) THEN 'dropped_r1' WHEN scenarios = '' THEN 'dropped_r2' WHEN cost > 3 THEN 'dropped_r3' WHEN redundant THEN 'dropped_r4' ELSE 'round2' END AS status, scenarios FROM y)"""


@query("g_catalog", f"WITH {GRAMMAR_SQL} SELECT * FROM g", with_auth=False)
def g_catalog(spark, d):
    return grammar.catalog(spark)


@query("g_funnel", f"WITH {GRAMMAR_SQL} SELECT status, CAST(count(*) AS INT) AS n FROM g GROUP BY status", with_auth=False)
def g_funnel(spark, d):
    return grammar.catalog(spark).groupBy("status").agg(F.count("*").cast("int").alias("n"))


def feature(name: str, sql: str | None):
    @query(f"e_{name}", sql)
    def _one(spark, d):
        return features.build(auth(spark, d), [name])


A = f"a AS (SELECT {K}, count(*) AS n, count_if(EventID = 4625) AS f, count_if({OFF}) AS o FROM auth GROUP BY {K}), d0 AS (SELECT min(day) AS d0 FROM a)"


def values_sql(expr: str, where: str) -> str:
    return f"x AS (SELECT {K}, {expr} AS v, count(*) AS n FROM auth WHERE ({where}) AND {expr} IS NOT NULL GROUP BY ALL)"


HOUR = """CAST(("Time" % 86400) // 3600 AS VARCHAR)"""
PAIR = "CASE WHEN Source IS NOT NULL AND LogHost IS NOT NULL THEN Source || '/' || LogHost END"
FAIL = "EventID = 4625"


def novelty_sql(name: str, expr: str, where: str) -> str:
    return f""", {A}, {values_sql(expr, where)}, y AS (SELECT *, lag(day) OVER (PARTITION BY DomainName, UserName, v ORDER BY day) AS p FROM x)
SELECT {K}, round(ln(1 + coalesce(count_if(y.v IS NOT NULL AND (p IS NULL OR p < day - 7)), 0)), 6) + 0.0 AS {name} FROM a LEFT JOIN y USING ({K}) GROUP BY {K}"""


def both_sql(expr: str, where: str) -> str:
    return f""", {A}, {values_sql(expr, where)}, hist AS (SELECT a.DomainName, a.UserName, a.day, x.v, sum(x.n) AS past FROM a JOIN x ON x.DomainName = a.DomainName AND x.UserName = a.UserName AND x.day BETWEEN a.day - 7 AND a.day - 1 GROUP BY ALL),
j AS (SELECT {K}, v, coalesce(x.n, 0) AS now, coalesce(past, 0) AS past FROM x FULL JOIN hist USING ({K}, v))"""


def jaccard_sql(name: str, expr: str, where: str) -> str:
    return both_sql(expr, where) + f" SELECT {K}, round(CASE WHEN count_if(past > 0) > 0 THEN count_if(now > 0 AND past > 0) / count(*) END, 6) AS {name} FROM a LEFT JOIN j USING ({K}) GROUP BY {K}"


def shift_sql(name: str, expr: str, where: str) -> str:
    return (
        both_sql(expr, where)
        + f""", t AS (SELECT *, sum(now) OVER (PARTITION BY {K}) AS tn, sum(past) OVER (PARTITION BY {K}) AS tp FROM j)
SELECT {K}, round(CASE WHEN max(tp) > 0 AND max(tn) > 0 THEN sum(abs(now / nullif(tn, 0) - past / nullif(tp, 0))) / 2 END, 6) + 0.0 AS {name} FROM a LEFT JOIN t USING ({K}) GROUP BY {K}"""
    )


def delta_sql(name: str, base: str, share: bool = False, expr: str | None = None, where: str = "TRUE") -> str:
    more = f", {values_sql(expr, where)}, c AS (SELECT {K}, count(*) AS k FROM x GROUP BY {K})" if expr else ""
    source = f"a LEFT JOIN c USING ({K})" if expr else "a"
    mean = "avg(b) OVER w" if share else "coalesce(sum(b) OVER w, 0) / 7"
    return f""", {A}{more}, b AS (SELECT {K}, {base} AS b FROM {source})
SELECT {K}, CASE WHEN day - 7 >= d0 THEN round(b - {mean}, 6) + 0.0 END AS {name} FROM b, d0 WINDOW w AS (PARTITION BY DomainName, UserName ORDER BY day RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)"""


def peer_sql(name: str, base: str, expr: str | None = None, where: str = "TRUE") -> str:
    more = f", {values_sql(expr, where)}, c AS (SELECT {K}, count(*) AS k FROM x GROUP BY {K})" if expr else ""
    source = f"a LEFT JOIN c USING ({K})" if expr else "a"
    return f""", {A}{more}, b AS (SELECT {K}, {ETYPE} AS e, {base} AS b FROM {source}),
q AS (SELECT day, e, quantile_cont(b, 0.5) AS m, (quantile_cont(b, 0.75) - quantile_cont(b, 0.25)) / 1.349 AS iqr, coalesce(stddev_samp(b), 0) AS sd FROM b GROUP BY day, e)
SELECT {K}, round(CASE WHEN iqr > 1e-9 THEN greatest(-10.0, least(10.0, (b - m) / iqr)) WHEN sd > 1e-9 THEN greatest(-10.0, least(10.0, (b - m) / sd)) ELSE 0.0 END, 6) + 0.0 AS {name} FROM b JOIN q USING (day, e)"""


DISTINCT = "ln(1 + coalesce(k, 0))"
for _name, _sql in {
    "delta_mean_share_fail_7d": delta_sql("delta_mean_share_fail_7d", "f / n", True),
    "delta_mean_share_night_7d": delta_sql("delta_mean_share_night_7d", "o / n", True),
    "delta_mean_count_7d": delta_sql("delta_mean_count_7d", "ln(1 + n)"),
    "delta_mean_distinct_source_7d": delta_sql("delta_mean_distinct_source_7d", DISTINCT, expr="Source"),
    "delta_mean_distinct_pair_7d": delta_sql("delta_mean_distinct_pair_7d", DISTINCT, expr=PAIR),
    "delta_mean_distinct_fail_host_7d": delta_sql("delta_mean_distinct_fail_host_7d", DISTINCT, expr="LogHost", where=FAIL),
    "novelty_fail_host_7d": novelty_sql("novelty_fail_host_7d", "LogHost", FAIL),
    "novelty_fail_failreason_7d": novelty_sql("novelty_fail_failreason_7d", "FailureReason", FAIL),
    "novelty_logontype_7d": novelty_sql("novelty_logontype_7d", "LogonType", "TRUE"),
    "jaccard_source_7d": jaccard_sql("jaccard_source_7d", "Source", "TRUE"),
    "jaccard_hour_7d": jaccard_sql("jaccard_hour_7d", HOUR, "TRUE"),
    "jaccard_logontype_7d": jaccard_sql("jaccard_logontype_7d", "LogonType", "TRUE"),
    "dist_shift_hour_7d": shift_sql("dist_shift_hour_7d", HOUR, "TRUE"),
    "dist_shift_logontype_7d": shift_sql("dist_shift_logontype_7d", "LogonType", "TRUE"),
    "peer_z_distinct_source": peer_sql("peer_z_distinct_source", DISTINCT, "Source"),
    "peer_z_share_night": peer_sql("peer_z_share_night", "o / n"),
    "novelty_share_pair_7d": f""", {A}, {values_sql(PAIR, "TRUE")}, y AS (SELECT *, lag(day) OVER (PARTITION BY DomainName, UserName, v ORDER BY day) AS p FROM x)
SELECT {K}, round(sum(CASE WHEN p IS NULL OR p < day - 7 THEN y.n ELSE 0 END) / sum(y.n), 6) AS novelty_share_pair_7d FROM a LEFT JOIN y USING ({K}) GROUP BY {K}""",
    "count_15m": f""", m AS (SELECT {K}, max(n) AS m FROM (SELECT {K}, "Time" // 900 AS b, count(*) AS n FROM auth GROUP BY ALL) GROUP BY {K}) SELECT {K}, round(ln(1 + m), 6) AS count_15m FROM m""",
    "distinct_fail_source_60m": f""", {A}, m AS (SELECT {K}, max(n) AS m FROM (SELECT {K}, "Time" // 3600 AS b, count(DISTINCT Source) AS n FROM auth WHERE {FAIL} AND Source IS NOT NULL GROUP BY ALL) GROUP BY {K}) SELECT {K}, round(ln(1 + coalesce(m, 0)), 6) + 0.0 AS distinct_fail_source_60m FROM a LEFT JOIN m USING ({K})""",
    "share_fail": f", {A} SELECT {K}, round(f / n, 6) AS share_fail FROM a",
    "fanout_fail_source": f""", {A}, {values_sql("Source", FAIL)}, y AS (SELECT *, count(*) OVER (PARTITION BY day, v) AS m FROM x) SELECT {K}, round(ln(1 + coalesce(max(m), 0)), 6) + 0.0 AS fanout_fail_source FROM a LEFT JOIN y USING ({K}) GROUP BY {K}""",
    "evenness_source": f""", {A}, {values_sql("Source", "TRUE")} SELECT {K}, CASE WHEN count(x.v) > 0 THEN round(CASE WHEN count(x.v) > 1 THEN (ln(sum(x.n)) - sum(x.n * ln(x.n)) / sum(x.n)) / ln(count(x.v)) ELSE 0.0 END, 6) + 0.0 END AS evenness_source FROM a LEFT JOIN x USING ({K}) GROUP BY {K}""",
    "recency_source_hist": f""", {A}, {values_sql("Source", "TRUE")}, y AS (SELECT *, lag(day) OVER (PARTITION BY DomainName, UserName, v ORDER BY day) AS p FROM x) SELECT {K}, CAST(min(day - p) AS DOUBLE) AS recency_source_hist FROM a LEFT JOIN y USING ({K}) GROUP BY {K}""",
    "active_days_7d": f""", {A} SELECT {K}, CASE WHEN day - 7 >= d0 THEN CAST(count(*) OVER (PARTITION BY DomainName, UserName ORDER BY day RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS DOUBLE) END AS active_days_7d FROM a, d0""",
    "deviation_count_7d": _SQL["h_volume_z"].replace("volume_robust_z_7d", "deviation_count_7d").split(f"{AUTH_SQL}", 1)[1],
}.items():
    feature(_name, _sql)


def joined_sql(names: list[str], columns: str = "*") -> str:
    """The account-days of several queries' SQL, side by side."""
    first, *rest = (f"({_SQL[n]}) AS _{i}" for i, n in enumerate(names))
    return f"SELECT {columns} FROM {first} " + " ".join(f"JOIN {x} USING ({K})" for x in rest)


def fourteen(name: str) -> str:
    """The SQL of a feature against 14 days instead of 7, its column marked so."""
    return _SQL[f"e_{name}"].replace("day - 7", "day - 14").replace("RANGE BETWEEN 7 PRECEDING", "RANGE BETWEEN 14 PRECEDING").replace("0) / 7", "0) / 14").replace(f"AS {name}", f"AS {name}_14")


@query(
    "e_multiwindow",
    joined_sql(["e_novelty_logontype_7d", "e_delta_mean_count_7d"]) + f" JOIN ({fourteen('novelty_logontype_7d')}) AS _8 USING ({K}) JOIN ({fourteen('delta_mean_count_7d')}) AS _9 USING ({K})",
    with_auth=False,
)
def e_multiwindow(spark, d):
    a = auth(spark, d)
    names = ["novelty_logontype_7d", "delta_mean_count_7d"]
    return features.build(a, names, 14, "_14").join(features.build(a, names), KEYS)


@query(
    "f_matrix",
    joined_sql(["f_account_day", "h_new_entities", "h_days_since", "h_volume_z", *[f"e_{n}" for n in grammar.SHIPPED]], "* EXCLUDE (new_source_count, source_recency)"),
    with_auth=False,
)
def f_matrix(spark, d):
    """The whole matrix: intraday, history and the shipped grammar features."""
    a = auth(spark, d)
    m = history.add_history(intraday.account_days(a), a)
    return m.join(features.build(a, grammar.SHIPPED), KEYS)


LEAKS = ["novelty_logontype_7d", "jaccard_source_7d", "delta_mean_count_7d"]


def cut_sql(name: str) -> str:
    """A feature's SQL over the first twenty days alone."""
    return _SQL[f"e_{name}"].replace("FROM events)", "FROM events WHERE ts < TIMESTAMP '2024-01-21')").replace(f"AS {name}", f"AS {name}__cut")


@query(
    "n_leakage",
    f"SELECT {', '.join(f'count_if(({c} IS NULL) <> ({c}__cut IS NULL) OR coalesce(abs({c} - {c}__cut) > 1e-9, FALSE)) AS {c}' for c in LEAKS)} FROM ({joined_sql([f'e_{c}' for c in LEAKS])}) AS a "
    + " ".join(f"JOIN ({cut_sql(c)}) AS c{i} USING ({K})" for i, c in enumerate(LEAKS)),
    with_auth=False,
)
def n_leakage(spark, d):
    """Cutting off the last ten days moves no feature of the days before."""
    a = auth(spark, d)
    return statistics.unchanged_without(features.build(a, LEAKS), features.build(a.filter("day <= 20"), LEAKS), KEYS, LEAKS)


# ---------------------------------------------------------------- cleaning and quality


@query("c_clean", f"""SELECT DISTINCT event_id, "Time" - CASE WHEN day >= 20 THEN 3600 ELSE 0 END AS "Time", day, EventID, UserName, lower(DomainName) AS DomainName, coalesce(Source, 'Unknown') AS Source, LogHost, LogonType FROM auth""")
def c_clean(spark, d):
    return cleaning.clean(auth(spark, d), shift_dst=True, dst_start_day=20).select("event_id", "Time", "day", "EventID", "UserName", "DomainName", "Source", "LogHost", "LogonType")


@query(
    "d_survey",
    f"""
, s AS (SELECT day, count(*) AS total, count_if(EventID = 4625) AS failures, count(DISTINCT UserName) AS users, count(DISTINCT LogHost) AS hosts, count_if(UserName LIKE '%$') AS m, count_if({OFF_SURVEY}) AS o FROM auth GROUP BY day)
SELECT day, total, failures, users, hosts, round(100 * failures / total, 6) AS failure_pct, round(100 * m / total, 6) AS machine_pct, round(100 * o / total, 6) AS off_hours_pct, total < 0.75 * (SELECT median(total) FROM s) AS weekend_like FROM s""",
)
def d_survey(spark, d):
    return cleaning.survey(auth(spark, d))


@query("d_bursty", """, g AS (SELECT day, "Time" - lag("Time") OVER (PARTITION BY day, UserName, LogHost, LogonType ORDER BY "Time") AS gap FROM auth WHERE EventID = 4624) SELECT day, count(*) AS n_success, count_if(coalesce(gap <= 2, FALSE)) AS n_bursty FROM g GROUP BY day""")
def d_bursty(spark, d):
    return cleaning.bursty(auth(spark, d))


@query("a_duplicates", """, g AS (SELECT count(*) AS n FROM auth GROUP BY UserName, LogHost, day) SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS n_in_duplicates, CAST(sum(n - 1) AS BIGINT) AS n_excess FROM g""")
def a_duplicates(spark, d):
    return cleaning.duplicates(auth(spark, d), ["UserName", "LogHost", "day"])


@query(
    "a_column_quality",
    """SELECT 'Source' AS "column", count_if(Source IS NULL) AS nulls, count(DISTINCT Source) AS n_distinct, min(Source) AS least, max(Source) AS greatest, round(100 * count_if(Source IS NULL) / count(*), 6) AS null_pct FROM auth
UNION ALL SELECT 'FailureReason', count_if(FailureReason IS NULL), count(DISTINCT FailureReason), min(FailureReason), max(FailureReason), round(100 * count_if(FailureReason IS NULL) / count(*), 6) FROM auth""",
)
def a_column_quality(spark, d):
    return cleaning.column_quality(auth(spark, d), ["Source", "FailureReason"])


@query("d_sanity", """SELECT count(*) AS n, count_if(EventID IS NULL OR EventID NOT IN (4624, 4625)) AS bad_event_id, count_if("Time" < 0) AS negative_time, count_if(EventID = 4624 AND trim(coalesce(FailureReason, '')) <> '') AS success_with_reason, count_if(EventID = 4625 AND trim(coalesce(FailureReason, '')) = '') AS failure_without_reason, count_if("Time" // 86400 + 1 <> day) AS outside_day FROM auth""")
def d_sanity(spark, d):
    return cleaning.sanity(auth(spark, d))


@query("d_reconcile", "SELECT day, EventID, count(*) AS raw_rows, count_if(event_id % 7 <> 0) AS stored_rows, count_if(event_id % 7 <> 0) - count(*) AS difference, count_if(event_id % 7 <> 0) = count(*) AS ok FROM auth GROUP BY day, EventID")
def d_reconcile(spark, d):
    """A stored copy that lacks rows is found by day and event id."""
    a = auth(spark, d)
    return cleaning.reconcile(a, a.withColumn("kept", F.col("event_id") % 7 != 0).filter("kept"))


@query("d_hourly", """SELECT CAST(h AS INT) AS hour, count(EventID) AS n, count_if(EventID = 4625) AS failures FROM range(24) AS r(h) LEFT JOIN auth ON ("Time" % 86400) // 3600 = h GROUP BY h""")
def d_hourly(spark, d):
    return cleaning.hourly(auth(spark, d))


@query("d_missing_source", "SELECT LogonType, count(*) AS n, count_if(Source IS NULL) AS missing, round(100 * count_if(Source IS NULL) / count(*), 6) AS missing_pct FROM auth GROUP BY LogonType")
def d_missing_source(spark, d):
    return cleaning.missing_by(auth(spark, d), "Source", "LogonType")


@query(
    "a_cramers_v",
    """, c AS (SELECT LogonType AS a, AuthenticationPackage AS b, count(*) AS o FROM auth GROUP BY 1, 2), r AS (SELECT a, sum(o) AS r FROM c GROUP BY a), s AS (SELECT b, sum(o) AS s FROM c GROUP BY b), t AS (SELECT sum(o) AS t FROM c)
SELECT CAST(t AS BIGINT) AS n, round(sqrt(chi / t / (least((SELECT count(*) FROM r), (SELECT count(*) FROM s)) - 1)), 6) AS cramers_v FROM t, (SELECT sum(pow(coalesce(o, 0) - r * s / t, 2) / (r * s / t)) AS chi FROM r CROSS JOIN s CROSS JOIN t LEFT JOIN c USING (a, b))""",
)
def a_cramers_v(spark, d):
    return cleaning.cramers_v(auth(spark, d), "LogonType", "AuthenticationPackage")


@query("a_pivot", """SELECT FailureReason, count_if(LogonType = 3) AS t3, count_if(LogonType = 2) AS t2 FROM auth WHERE EventID = 4625 GROUP BY FailureReason""")
def a_pivot(spark, d):
    return auth(spark, d).filter("EventID = 4625").groupBy("FailureReason").pivot("LogonType", [3, 2]).count().na.fill(0).withColumnsRenamed({"3": "t3", "2": "t2"})


@query("a_first_seen", """SELECT day, count(*) AS new_accounts FROM (SELECT DomainName, UserName, min(day) AS day FROM auth GROUP BY ALL) GROUP BY day""")
def a_first_seen(spark, d):
    return auth(spark, d).groupBy("DomainName", "UserName").agg(F.min("day").alias("day")).groupBy("day").agg(F.count("*").alias("new_accounts"))


@query("s_days", "SELECT day FROM auth GROUP BY day HAVING count(DISTINCT EventID) = 2")
def s_days(spark, d):
    return authlog.available_days(auth(spark, d))


@query("s_overlay", "SELECT day, count(*) AS n FROM (SELECT day FROM auth WHERE day NOT IN (3, 4) UNION ALL SELECT day FROM auth WHERE day IN (3, 4) AND EventID = 4625) GROUP BY day")
def s_overlay(spark, d):
    a = auth(spark, d)
    return authlog.overlay(a, a.filter("day in (3, 4) and EventID = 4625")).groupBy("day").agg(F.count("*").alias("n"))


@query("s_shift_day", """SELECT event_id, "Time" + 5 * 86400 AS "Time", 7 AS day FROM auth WHERE day = 2""")
def s_shift_day(spark, d):
    return authlog.shift_day(auth(spark, d), 2, 7).select("event_id", "Time", "day")


@query("p_predicates", f"""SELECT {ETYPE} AS entity_type, CASE WHEN EventID = 4625 THEN CASE WHEN FailureReason LIKE 'Account locked%' THEN 'locked' ELSE 'bad_pw' END END AS kind, {OFF} AS off, count(*) AS n FROM auth GROUP BY ALL""")
def p_predicates(spark, d):
    a = auth(spark, d)
    return a.groupBy(P.entity_type(F.col("UserName")).alias("entity_type"), P.failure_kind(F.col("EventID"), F.col("FailureReason")).alias("kind"), P.off_hours(F.col("Time")).alias("off")).agg(F.count("*").alias("n"))


@query("p_host_band", """SELECT CASE WHEN h = 1 THEN '1' WHEN h = 2 THEN '2' WHEN h <= 5 THEN '3-5' WHEN h <= 10 THEN '6-10' ELSE '>10' END AS band, count(*) AS n FROM (SELECT count(DISTINCT LogHost) AS h FROM auth GROUP BY DomainName, UserName) GROUP BY band""")
def p_host_band(spark, d):
    n = auth(spark, d).groupBy("DomainName", "UserName").agg(F.count_distinct("LogHost").alias("h"))
    return n.groupBy(P.host_band(F.col("h")).alias("band")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- profiles


@query(
    "m_accounts",
    f"""
, pd AS (SELECT {K}, count(*) AS n FROM auth WHERE day <= 21 GROUP BY {K}), x AS (SELECT DomainName, UserName, count(*) AS active_days, min(day) AS first_day, max(day) AS last_day, median(n) AS median_daily_events FROM pd GROUP BY ALL)
SELECT DomainName, UserName, count(*) AS n_events, count_if(EventID = 4624) AS n_success, count_if(EventID = 4625) AS n_fail, count(DISTINCT Source) AS n_sources, count(DISTINCT LogHost) AS n_hosts, round(count_if({OFF}) / count(*), 6) AS off_hours_ratio,
  max({ETYPE}) AS entity_type, any_value(active_days) AS active_days, any_value(first_day) AS first_day, any_value(last_day) AS last_day, any_value(median_daily_events) AS median_daily_events FROM auth JOIN x USING (DomainName, UserName) WHERE day <= 21 GROUP BY DomainName, UserName""",
)
def m_accounts(spark, d):
    return profiles.accounts(profiles.train_only(auth(spark, d), 1, SPLIT))


@query("m_account_sources", "SELECT DomainName, UserName, Source, count(*) AS n_events, count_if(EventID = 4624) AS n_success, count(DISTINCT day) AS n_days FROM auth WHERE Source IS NOT NULL GROUP BY ALL")
def m_account_sources(spark, d):
    return profiles.account_values(auth(spark, d), "Source")


@query("m_logon_types", "SELECT DomainName, UserName, LogonType, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY DomainName, UserName), 6) AS share FROM auth GROUP BY DomainName, UserName, LogonType")
def m_logon_types(spark, d):
    return profiles.logon_type_shares(auth(spark, d))


@query(
    "m_gaps",
    f"""
, c AS (SELECT day, row_number() OVER (ORDER BY day) AS r FROM (SELECT DISTINCT day FROM auth)), n AS (SELECT max(r) AS n FROM c),
a AS (SELECT DomainName, UserName, r, lag(r) OVER w AS p, lead(r) OVER w AS q FROM (SELECT DISTINCT DomainName, UserName, day FROM auth) JOIN c USING (day) WINDOW w AS (PARTITION BY DomainName, UserName ORDER BY r))
SELECT DomainName, UserName, 'leading' AS kind, CAST(r - 1 AS INT) AS length, 1 AS from_rank FROM a WHERE p IS NULL AND r > 1
UNION ALL SELECT DomainName, UserName, 'internal', CAST(r - p - 1 AS INT), CAST(p + 1 AS INT) FROM a WHERE r - p > 1
UNION ALL SELECT DomainName, UserName, 'trailing', CAST(n - r AS INT), CAST(r + 1 AS INT) FROM a, n WHERE q IS NULL AND r < n""",
)
def m_gaps(spark, d):
    return profiles.gaps(auth(spark, d))


@query(
    "m_hosts",
    """
, r AS (SELECT DomainName, UserName, day, 'loghost' AS role, LogHost AS host FROM auth UNION ALL SELECT DomainName, UserName, day, 'source', Source FROM auth WHERE Source IS NOT NULL)
SELECT host, count(*) AS n_events, count(DISTINCT day) AS n_days, count(DISTINCT DomainName || '/' || UserName) AS n_accounts, count(DISTINCT CASE WHEN role = 'loghost' THEN DomainName || '/' || UserName END) AS n_accounts_loghost,
  count(DISTINCT CASE WHEN role = 'source' THEN DomainName || '/' || UserName END) AS n_accounts_source, count(DISTINCT CASE WHEN UserName LIKE 'User%' THEN DomainName || '/' || UserName END) AS n_accounts_user FROM r GROUP BY host""",
)
def m_hosts(spark, d):
    return profiles.hosts(auth(spark, d))


GAP = 172_800
LOCK = f"""f AS (SELECT *, CASE WHEN FailureReason LIKE 'Account locked%' THEN 'locked' ELSE 'bad_pw' END AS kind, row_number() OVER (PARTITION BY DomainName, UserName ORDER BY "Time", event_id) AS rn FROM auth WHERE EventID = 4625),
lk AS (SELECT f.*, lag("Time") OVER (PARTITION BY DomainName, UserName ORDER BY "Time", event_id) AS pl FROM f WHERE kind = 'locked'),
ons AS (SELECT * FROM lk WHERE pl IS NULL OR "Time" - pl > {GAP})"""


@query(
    "m_lockouts",
    f"""
, {LOCK}, br AS (SELECT f.*, coalesce(lag(kind) OVER w = 'bad_pw' AND "Time" - lag("Time") OVER w <= {GAP}, FALSE) AS link FROM f WINDOW w AS (PARTITION BY DomainName, UserName ORDER BY rn)),
st AS (SELECT o.event_id, max(b.rn) AS b0 FROM ons o JOIN br b ON b.DomainName = o.DomainName AND b.UserName = o.UserName AND b.rn <= o.rn AND NOT b.link GROUP BY o.event_id),
wn AS (SELECT o.event_id, count(f.event_id) AS c FROM ons o LEFT JOIN f ON f.DomainName = o.DomainName AND f.UserName = o.UserName AND f.rn < o.rn AND f."Time" >= o."Time" - {GAP} AND f.kind = 'bad_pw' GROUP BY o.event_id)
SELECT DomainName, UserName, day, "Time", event_id, CAST(rn - b0 AS INT) AS streak, c AS in_window FROM ons JOIN st USING (event_id) JOIN wn USING (event_id)""",
)
def m_lockouts(spark, d):
    """Two days as the gap: the adapter's accounts log on a few times a day."""
    return profiles.lockouts(auth(spark, d), GAP)


@query(
    "m_lockout_threshold",
    f"""WITH s AS (SELECT streak FROM ({_SQL["m_lockouts"]}) WHERE streak >= 1), n AS (SELECT streak, count(*) AS n FROM s GROUP BY streak)
SELECT (SELECT streak FROM n ORDER BY n DESC, streak LIMIT 1) AS threshold, max(n) AS support, CAST(sum(n) AS BIGINT) AS episodes, (SELECT median(streak) FROM s) AS median_streak FROM n""",
    with_auth=False,
)
def m_lockout_threshold(spark, d):
    return profiles.lockout_threshold(profiles.lockouts(auth(spark, d), GAP))


@query(
    "m_failures_before_lock",
    f"""
, k AS (SELECT {K}, min(CASE WHEN FailureReason LIKE 'Account locked%' THEN "Time" END) AS t FROM auth WHERE EventID = 4625 GROUP BY {K}),
n AS (SELECT count(*) AS n FROM auth JOIN k USING ({K}) WHERE EventID = 4625 AND FailureReason NOT LIKE 'Account locked%' AND "Time" < t GROUP BY {K})
SELECT count(*) AS n_days, CAST(ceil(quantile_cont(n, 0.5)) AS BIGINT) AS threshold, round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.75), 6) AS p75 FROM n""",
)
def m_failures_before_lock(spark, d):
    return profiles.failures_before_lock(auth(spark, d))


@query(
    "b_rule_statistics",
    f"""
, days AS (SELECT {K}, min(day) OVER (PARTITION BY DomainName, UserName) AS d0 FROM (SELECT DISTINCT {K} FROM auth)),
fs AS (SELECT DISTINCT {K}, Source FROM auth WHERE EventID = 4625 AND Source IS NOT NULL), r2 AS (SELECT {K}, max(m) AS r2 FROM (SELECT *, count(*) OVER (PARTITION BY day, Source) AS m FROM fs) GROUP BY {K}),
s AS (SELECT DomainName, UserName, Source, min(day) AS day FROM auth WHERE Source IS NOT NULL GROUP BY ALL), r4 AS (SELECT {K}, count(*) AS r4 FROM s GROUP BY {K}),
t AS (SELECT DomainName, UserName, LogonType, min(day) AS day FROM auth GROUP BY ALL), r6 AS (SELECT {K}, count(*) AS r6 FROM auth JOIN t USING (DomainName, UserName, LogonType, day) GROUP BY {K})
SELECT {K}, coalesce(r2, 0) AS r2_spray_accounts, CASE WHEN day > d0 THEN coalesce(r4, 0) END AS r4_new_sources, CASE WHEN day > d0 THEN coalesce(r6, 0) END AS r6_new_logontype_events FROM days LEFT JOIN r2 USING ({K}) LEFT JOIN r4 USING ({K}) LEFT JOIN r6 USING ({K})""",
)
def b_rule_statistics(spark, d):
    return profiles.rule_statistics(auth(spark, d))


# ---------------------------------------------------------------- baselines over a numeric matrix (orders)


def orders(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("price"), (F.col("o_orderkey") % 5 != 0).alias("train"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey").cast("double")).alias("cust"), (F.col("o_orderkey") % 30 + 1).cast("int").alias("day"))


O_SQL = "o AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE) AS price, o_orderkey % 5 <> 0 AS train, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS cust, CAST(o_orderkey % 30 + 1 AS INT) AS day FROM orders)"


@query("b_impute", f"WITH {O_SQL} SELECT o_orderkey, round(coalesce(cust, (SELECT median(cust) FROM o WHERE train)), 6) AS cust FROM o", with_auth=False)
def b_impute(spark, d):
    return baselines.imputed(orders(spark, d), F.col("train"), ["cust"]).select("o_orderkey", "cust")


@query("b_scale", f"WITH {O_SQL}, q AS (SELECT quantile_cont(price, 0.5) AS m, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS s FROM o WHERE train) SELECT o_orderkey, round((price - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) + 0.0 AS price FROM o, q", with_auth=False)
def b_scale(spark, d):
    return baselines.scaled(orders(spark, d), F.col("train"), ["price"]).select("o_orderkey", "price")


@query(
    "b_quantile_normal",
    f"""WITH {O_SQL}, c AS (SELECT price, count_if(train) AS t, sum(count_if(train)) OVER (ORDER BY price) AS upto, sum(count_if(train)) OVER () AS n FROM o GROUP BY price),
p AS (SELECT price, greatest(1e-6, least(1 - 1e-6, (upto - t + t / 2) / n)) AS p FROM c), q AS (SELECT price, p, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM p),
z AS (SELECT price, p, t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t) AS z FROM q)
SELECT o_orderkey, round(CASE WHEN p < 0.5 THEN -z ELSE z END, 6) + 0.0 AS z FROM o JOIN z USING (price)""".replace("count_if(train) AS t,", "CAST(sum(CAST(train AS INT)) AS DOUBLE) AS t,"),
    with_auth=False,
)
def b_quantile_normal(spark, d):
    return baselines.quantile_normal(orders(spark, d), F.col("train"), "price", "z").select("o_orderkey", "z")


@query(
    "b_zscore",
    f"""WITH {O_SQL}, l AS (SELECT o_orderkey, train, 'price' AS f, price AS v FROM o UNION ALL SELECT o_orderkey, train, 'cust', cust FROM o), m AS (SELECT f, median(v) AS m FROM l WHERE train AND v IS NOT NULL GROUP BY f),
s AS (SELECT f, any_value(m) AS m, 1.4826 * median(abs(v - m)) AS s FROM l JOIN m USING (f) WHERE train AND v IS NOT NULL GROUP BY f) SELECT o_orderkey, round(max(coalesce(abs(v - m) / s, 0)), 6) AS zscore FROM l JOIN s USING (f) GROUP BY o_orderkey""",
    with_auth=False,
)
def b_zscore(spark, d):
    return baselines.z_scores(orders(spark, d), F.col("train"), ["price", "cust"], ["o_orderkey"])


@query(
    "b_zscore_account",
    f"""WITH {O_SQL}, l AS (SELECT o_orderkey, o_custkey, train, price AS v FROM o), g AS (SELECT median(v) AS m FROM l WHERE train), gs AS (SELECT any_value(m) AS m, 1.4826 * median(abs(v - m)) AS s FROM l, g WHERE train),
a AS (SELECT o_custkey, median(v) AS am, count(*) AS n FROM l WHERE train GROUP BY o_custkey HAVING count(*) >= 5), d AS (SELECT o_custkey, am, abs(v - am) AS d FROM l JOIN a USING (o_custkey) WHERE train),
s AS (SELECT o_custkey, any_value(am) AS am, 1.4826 * CASE WHEN median(d) > 1e-9 THEN median(d) ELSE quantile_cont(d, 0.25) FILTER (d > 1e-9) END AS as_ FROM d GROUP BY o_custkey)
SELECT o_orderkey, o_custkey, round(CASE WHEN coalesce(as_, gs.s) > 0 THEN abs(v - coalesce(am, gs.m)) / coalesce(as_, gs.s) ELSE 0 END, 6) AS zscore FROM l LEFT JOIN s USING (o_custkey), gs""",
    with_auth=False,
)
def b_zscore_account(spark, d):
    """An account's own scale where it has five training rows, else the global one."""
    return baselines.z_scores(orders(spark, d), F.col("train"), ["price"], ["o_orderkey", "o_custkey"], account=["o_custkey"])


@query("b_rule_fraction", f""", a AS (SELECT {K}, count(*) AS n, count_if(EventID = 4625) AS f, count_if({OFF}) AS o FROM auth GROUP BY {K}) SELECT {K}, round((CAST(f / n >= 0.5 AS INT) + CAST(o / n > 0.8 AS INT) + CAST(n = 3 AS INT)) / 3, 6) AS rule_score FROM a""")
def b_rule_fraction(spark, d):
    m = intraday.account_days(auth(spark, d)).select(*KEYS, "failure_ratio", "off_hours_ratio", "total_logons")
    return baselines.rule_fraction(m, [("failure_ratio", ">=", 0.5), ("off_hours_ratio", ">", 0.8), ("total_logons", "==", 3)]).select(*KEYS, "rule_score")


@query("b_failure_count", f"SELECT {K}, count_if(EventID = 4625) AS failure_count, count_if(EventID = 4625) >= 2 AS failure_alert FROM auth GROUP BY {K}")
def b_failure_count(spark, d):
    m = intraday.account_days(auth(spark, d)).select(*KEYS, "failure_ratio", "total_logons")
    return baselines.failure_count(m, 2).select(*KEYS, "failure_count", "failure_alert")


def uniform_sql(*keys: str) -> str:
    """The same draw as ``hash_uniform``."""
    texts = ", ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys)
    return f"(CAST('0x' || substr(md5(concat_ws('|', {texts})), 1, 13) AS BIGINT) / 4503599627370496.0)"


@query("b_random", f"SELECT o_orderkey, round({uniform_sql('o_orderkey', '42', '0')}, 6) AS random_score FROM orders", with_auth=False)
def b_random(spark, d):
    return baselines.random_score(orders(spark, d).select("o_orderkey"), ["o_orderkey"])


@query("b_content_random", f"WITH {O_SQL} SELECT o_orderkey, round(price, 6) AS price, round({uniform_sql('CAST(floor(price * 1e6) AS BIGINT)')}, 6) AS random_score FROM o", with_auth=False)
def b_content_random(spark, d):
    return baselines.content_random(orders(spark, d).select("o_orderkey", "price"), ["price"])


@query("b_ecdf", f"WITH {O_SQL}, t AS (SELECT count(*) AS t FROM o WHERE train AND price IS NOT NULL), c AS (SELECT price, sum(count_if(train)) OVER (ORDER BY price) - count_if(train) AS below FROM o GROUP BY price) SELECT o_orderkey, round(below / t, 6) AS ecdf FROM o JOIN c USING (price), t", with_auth=False)
def b_ecdf(spark, d):
    return baselines.ecdf(orders(spark, d), F.col("train"), "price", "ecdf").select("o_orderkey", "ecdf")


@query("b_ecdf_rules", f"WITH {O_SQL}, p AS (SELECT price, (sum(count_if(train)) OVER (ORDER BY price) - count_if(train)) / sum(count_if(train)) OVER () AS e FROM o GROUP BY price), c AS (SELECT cust, (sum(count_if(train)) OVER (ORDER BY cust) - count_if(train)) / sum(count_if(train)) OVER () AS e FROM o WHERE cust IS NOT NULL GROUP BY cust) SELECT o_orderkey, round(greatest(coalesce(p.e, 0), coalesce(c.e, 0)), 6) AS ecdf_score FROM o LEFT JOIN p USING (price) LEFT JOIN c USING (cust)", with_auth=False)
def b_ecdf_rules(spark, d):
    return baselines.ecdf_rules(orders(spark, d), F.col("train"), ["price", "cust"]).select("o_orderkey", "ecdf_score")


@query("b_threshold", f"WITH {O_SQL}, s AS (SELECT price, row_number() OVER (ORDER BY price) - 1 AS i, count(*) OVER () AS n FROM o WHERE train) SELECT round((SELECT price FROM s WHERE i = ceil((n - 1) * (1 - 0.05))), 6) AS higher, round((SELECT quantile_cont(price, 0.95) FROM o WHERE train), 6) AS linear", with_auth=False)
def b_threshold(spark, d):
    t = orders(spark, d).filter("train")
    return baselines.budget_threshold(t, "price", 0.05, "higher").withColumnRenamed("threshold", "higher").crossJoin(baselines.budget_threshold(t, "price", 0.05).withColumnRenamed("threshold", "linear"))


@query("b_duplicate_groups", "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, max(n) AS largest_group, count_if(n > 1) AS groups FROM (SELECT count(*) AS n FROM auth GROUP BY UserName, LogonType)")
def b_duplicate_groups(spark, d):
    return baselines.duplicate_groups(auth(spark, d), ["UserName", "LogonType"])


# ---------------------------------------------------------------- detectors (embeddings)


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """The embeddings with a column for each dimension, and these columns."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    x = [f"x{i}" for i in range(e.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    parts = [F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(x)]
    return e.select("vec_id", (F.col("vec_id") % 4 != 0).alias("train"), (F.col("label") % 2).alias("segment"), *parts), x


@query("b_isolation_forest")
def b_isolation_forest(spark, d):
    v, x = vectors(spark, d)
    return detectors.fit_and_score(v, F.col("train"), x, "iforest", trees=50).select("vec_id", "iforest_score")


@query("b_lof")
def b_lof(spark, d):
    v, x = vectors(spark, d)
    return detectors.fit_and_score(v, F.col("train"), x, "lof").select("vec_id", "lof_score")


@query("b_ocsvm")
def b_ocsvm(spark, d):
    v, x = vectors(spark, d)
    return detectors.fit_and_score(v, F.col("train"), x, "ocsvm").select("vec_id", "ocsvm_score")


@query("b_segments")
def b_segments(spark, d):
    v, x = vectors(spark, d)
    return detectors.by_segment(v, F.col("train"), x, "iforest", "segment", [0, 1], trees=20).select("vec_id", "segment", "iforest_score")


# ---------------------------------------------------------------- evaluation (labels of documents, scored by length)


def scores(spark: SparkSession, d: str) -> DataFrame:
    x = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    return x.select("doc_id", F.col("n_chars").cast("double").alias("score"), F.col("toxic").cast("int").alias("y"), (F.col("doc_id") % 20 + 1).cast("int").alias("day"), "source", "quality")


S_SQL = "s AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS score, CAST(toxic AS INT) AS y, CAST(doc_id % 20 + 1 AS INT) AS day, source, quality FROM documents JOIN labels USING (doc_id))"
CUM = "c AS (SELECT score, sum(y) AS p, count(*) AS n, sum(sum(y)) OVER (ORDER BY score DESC) AS tp, sum(count(*)) OVER (ORDER BY score DESC) AS k FROM s GROUP BY score), t AS (SELECT sum(y) AS P, count(*) AS N FROM s)"


@query("v_ranking", f"WITH {S_SQL}, {CUM} SELECT CAST(any_value(t.P) AS BIGINT) AS positives, any_value(t.N) AS rows, round(sum(c.p / t.P * tp / k), 6) AS pr_auc, round(sum(c.p * (t.N - t.P - (k - tp) + (c.n - c.p) / 2)) / any_value(t.P * (t.N - t.P)), 6) AS roc_auc FROM c, t", with_auth=False)
def v_ranking(spark, d):
    return evaluation.ranking(scores(spark, d), "score", "y")


@query("v_pr_curve", f"WITH {S_SQL}, {CUM} SELECT score AS s, round(tp / k, 6) AS precision, round(tp / t.P, 6) AS recall FROM c, t", with_auth=False)
def v_pr_curve(spark, d):
    return evaluation.pr_curve(scores(spark, d), "score", "y")


@query(
    "v_mean_pr",
    f"""WITH {S_SQL}, d AS (SELECT doc_id % 2 AS run, score, sum(y) AS p, count(*) AS n FROM s GROUP BY ALL), c AS (SELECT run, sum(p) OVER w AS tp, sum(n) OVER w AS k, sum(p) OVER (PARTITION BY run) AS pos FROM d WINDOW w AS (PARTITION BY run ORDER BY score DESC)),
g AS (SELECT run, i / 20 AS "at", max(tp / k) AS precision FROM c JOIN (SELECT unnest(range(21)) AS i) ON tp / pos >= i / 20 - 1e-12 GROUP BY run, i)
SELECT round(g."at", 6) AS "at", round(avg(precision), 6) AS precision, count(*) AS runs FROM g GROUP BY g."at"
""",
    with_auth=False,
)
def v_mean_pr(spark, d):
    s = scores(spark, d)
    curves = None
    for k in (0, 1):
        c = evaluation.pr_curve(s.filter(F.col("doc_id") % 2 == k), "score", "y").withColumn("run", F.lit(k))
        curves = c if curves is None else curves.unionByName(c)
    return evaluation.mean_pr(curves, "run", 20)


@query("v_precision_at", f"WITH {S_SQL}, r AS (SELECT y, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM s) SELECT k, round(sum(y) / count(*), 6) AS precision, round(sum(y) / (SELECT sum(y) FROM s), 6) AS recall FROM r JOIN (VALUES (10), (100)) AS ks(k) ON r <= k GROUP BY k", with_auth=False)
def v_precision_at(spark, d):
    return evaluation.precision_at(scores(spark, d), "score", "y", ["doc_id"], [10, 100])


@query("v_daily_budget", f"WITH {S_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, doc_id) AS r FROM s) SELECT day, count(*) AS rows, count_if(r <= 3) AS alerts, CAST(sum(CASE WHEN r <= 3 THEN y ELSE 0 END) AS BIGINT) AS hits, CAST(sum(y) AS BIGINT) AS positives FROM r GROUP BY day", with_auth=False)
def v_daily_budget(spark, d):
    return evaluation.daily_budget(scores(spark, d), "score", "y", ["doc_id"], 3)


@query("v_daily_summary", f"WITH {S_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, doc_id) AS r FROM s), b AS (SELECT day, count_if(r <= 3) AS a, sum(CASE WHEN r <= 3 THEN y ELSE 0 END) AS h, sum(y) AS p FROM r GROUP BY day) SELECT round(sum(h) / sum(p), 6) AS recall, round(avg(h / a), 6) AS mean_precision, round(avg(a), 6) AS alerts_per_day FROM b", with_auth=False)
def v_daily_summary(spark, d):
    return evaluation.daily_summary(evaluation.daily_budget(scores(spark, d), "score", "y", ["doc_id"], 3))


@query("v_operating_point", f"WITH {S_SQL}, x AS (SELECT count_if(score >= 5000 AND y = 1) AS tp, count_if(score >= 5000 AND y <> 1) AS fp, count_if(score < 5000 AND y = 1) AS fn, count_if(score < 5000 AND y <> 1) AS tn FROM s) SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round((tp + fp) / (tp + fp + fn + tn), 6) AS alert_rate FROM x", with_auth=False)
def v_operating_point(spark, d):
    return evaluation.operating_point(scores(spark, d), "score", "y", 5000)


@query("v_campaigns", f"WITH {S_SQL}, c AS (SELECT source, bool_or(score >= 5000) AS c FROM s WHERE y = 1 GROUP BY source) SELECT count(*) AS campaigns, count_if(c) AS caught FROM c", with_auth=False)
def v_campaigns(spark, d):
    return evaluation.campaign_recall(scores(spark, d).filter("y = 1"), "score", "source", 5000)


@query(
    "v_by_subset",
    f"""WITH {S_SQL}, pos AS (SELECT source, doc_id, score FROM s WHERE y = 1), neg AS (SELECT score FROM s WHERE y = 0),
u AS (SELECT source, score, 1 AS p FROM pos UNION ALL SELECT n.source, neg.score, 0 FROM neg CROSS JOIN (SELECT DISTINCT source FROM pos) n),
g AS (SELECT source, score, sum(p) AS p, count(*) - sum(p) AS q FROM u GROUP BY source, score), w AS (SELECT *, sum(p) OVER v AS tp, sum(q) OVER v AS fp, sum(p) OVER (PARTITION BY source) AS bp, sum(q) OVER (PARTITION BY source) AS bq FROM g WINDOW v AS (PARTITION BY source ORDER BY score DESC))
SELECT source, CAST(max(bp) AS BIGINT) AS positives, round(sum(p / bp * tp / (tp + fp)), 6) AS pr_auc, round(sum(p / bp * (bq - fp + q / 2) / bq), 6) AS roc_auc, round(max(bp / (bp + bq)), 6) AS floor FROM w GROUP BY source""",
    with_auth=False,
)
def v_by_subset(spark, d):
    return evaluation.by_subset(scores(spark, d), "score", "y", "source")


@query("v_spearman", f"WITH {S_SQL}, r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS a, rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2 AS b FROM s) SELECT count(*) AS n, round(corr(a, b), 6) AS spearman FROM r", with_auth=False)
def v_spearman(spark, d):
    return evaluation.spearman(scores(spark, d), "score", "quality")


@query("v_split_day", f", n AS (SELECT day, sum(count(*)) OVER (ORDER BY day) / sum(count(*)) OVER () AS s FROM auth GROUP BY day) SELECT day AS split_day FROM n ORDER BY round(abs(s - 0.7), 12), day LIMIT 1")
def v_split_day(spark, d):
    return evaluation.split_day(auth(spark, d))


@query("v_overlap", f"WITH {S_SQL}, a AS (SELECT doc_id FROM s ORDER BY score DESC, doc_id LIMIT 50), b AS (SELECT doc_id FROM s ORDER BY quality DESC, doc_id LIMIT 50) SELECT round(count(*) / 50, 6) AS overlap FROM a JOIN b USING (doc_id)", with_auth=False)
def v_overlap(spark, d):
    s = scores(spark, d)  # two top-50 reports
    return evaluation.overlap(s.orderBy(F.desc("score"), "doc_id").limit(50), s.orderBy(F.desc("quality"), "doc_id").limit(50), ["doc_id"], 50)


@query("v_paired", f"WITH {O_SQL}, m AS (SELECT day, o_orderkey % 3 AS config, avg(price) AS v FROM o GROUP BY ALL), b AS (SELECT day, v AS b FROM m WHERE config = 0), x AS (SELECT config, v - b AS d FROM m JOIN b USING (day) WHERE config <> 0) SELECT config, round(avg(d), 4) AS mean_delta, round(stddev_samp(d), 4) AS sd, count(*) AS n, abs(avg(d)) > stddev_samp(d) AS clear FROM x GROUP BY config", with_auth=False)
def v_paired(spark, d):
    m = orders(spark, d).groupBy("day", (F.col("o_orderkey") % 3).alias("config")).agg(F.avg("price").alias("v"))
    return rounded(evaluation.paired_deltas(m, "0", "config", ["day"], "v"), 4)


@query("v_seeds", f"WITH {O_SQL} SELECT day, round(avg(price), 4) AS price_mean, round(stddev_samp(price), 4) AS price_std, count(price) AS price_n FROM o GROUP BY day", with_auth=False)
def v_seeds(spark, d):
    return rounded(evaluation.over_seeds(orders(spark, d), ["day"], ["price"]), 4)


# ---------------------------------------------------------------- statistics


@query(
    "t_distribution",
    f"WITH {O_SQL} SELECT 'price' AS feature, count(price) AS n, round(avg(price), 3) AS mean, round(stddev_samp(price), 3) AS sd, round(skewness(price), 3) AS skewness, round(kurtosis(price), 3) AS kurtosis, round(avg(CAST(price = 0 AS INT)), 3) AS zero_share, round(quantile_cont(price, 0.25), 3) AS q1, round(median(price), 3) AS median, round(quantile_cont(price, 0.75), 3) AS q3 FROM o",
    with_auth=False,
)
def t_distribution(spark, d):
    return rounded(statistics.distribution(orders(spark, d), ["price"]), 3)


@query("t_correlations", f"WITH {O_SQL} SELECT 'price' AS a, 'cust' AS b, round(corr(price, cust), 6) AS r FROM o", with_auth=False)
def t_correlations(spark, d):
    return statistics.correlations(orders(spark, d), ["price", "cust"])


@query("t_rank_sum", f"WITH {S_SQL}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM s), u AS (SELECT sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS r1, CAST(sum(y) AS BIGINT) AS n1, CAST(count(*) - sum(y) AS BIGINT) AS n0 FROM r) SELECT n1, n0, round((r1 - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc, round(2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n0) - 1, 6) AS cliffs_delta, round((r1 - n1 * (n1 + 1) / 2 - n1 * n0 / 2) / sqrt(CAST(n1 * n0 AS DOUBLE) * (n1 + n0 + 1) / 12), 6) AS z FROM u", with_auth=False)
def t_rank_sum(spark, d):
    return statistics.rank_sum(scores(spark, d), "score", "y")


@query("t_kappa", f"WITH {S_SQL}, x AS (SELECT count(*) AS n, avg(CAST(y = quality AS INT)) AS po, avg(y) AS a, avg(quality) AS b FROM s) SELECT n, round(po, 6) AS agreement, round((po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) AS kappa FROM x", with_auth=False)
def t_kappa(spark, d):
    return statistics.kappa(scores(spark, d), "y", "quality")


DAILY = ", dd AS (SELECT day, CAST(count(*) AS DOUBLE) AS v FROM auth GROUP BY day)"


def daily(spark, d):
    return auth(spark, d).groupBy("day").agg(F.count("*").cast("double").alias("v"))


@query("t_autocorrelation", DAILY + ", m AS (SELECT avg(v) AS m, var_pop(v) AS s, count(*) AS n FROM dd) SELECT CAST(b.day - a.day AS INT) AS lag, round(sum((a.v - m) * (b.v - m)) / any_value(n * s), 6) AS acf FROM dd a JOIN dd b ON b.day - a.day BETWEEN 1 AND 7, m GROUP BY 1")
def t_autocorrelation(spark, d):
    return statistics.autocorrelation(daily(spark, d), "v", 7)


@query("t_trend", DAILY + " SELECT round(median((b.v - a.v) / (b.day - a.day)), 6) AS slope FROM dd a JOIN dd b ON b.day > a.day")
def t_trend(spark, d):
    return statistics.trend(daily(spark, d), "v")


@query("t_phase", DAILY + ", p AS (SELECT day % 7 AS phase, avg(v) AS mean, count(*) AS days FROM dd GROUP BY 1), w AS (SELECT avg(v) AS m, var_pop(v) AS s, count(*) AS n FROM dd) SELECT CAST(phase AS INT) AS phase, days, round(mean, 6) AS mean, round(sum(days * pow(mean - m, 2)) OVER () / (n * s), 6) AS r2 FROM p, w")
def t_phase(spark, d):
    return statistics.phase_profile(daily(spark, d), "v")


@query("t_information", f"WITH {O_SQL} SELECT 'cust' AS feature, round(avg(CAST(cust IS NULL AS INT)), 6) AS null_share, round((SELECT max(n) FROM (SELECT count(*) AS n FROM o WHERE cust IS NOT NULL GROUP BY cust)) / count(cust), 6) AS modal_share FROM o", with_auth=False)
def t_information(spark, d):
    return statistics.information(orders(spark, d), ["cust"])


# ---------------------------------------------------------------- injection


@query("i_dormant", f", l AS (SELECT DomainName, UserName, max(CASE WHEN day < 25 THEN day END) AS last_day, bool_or(day = 25) AS there FROM auth GROUP BY ALL) SELECT DomainName, UserName, last_day, 25 - last_day AS gap FROM l WHERE NOT there AND 25 - last_day >= 3")
def i_dormant(spark, d):
    return injection.dormant(auth(spark, d), 25, 3)


@query("i_dominant_type", ", n AS (SELECT DomainName, UserName, LogonType, count(*) AS n FROM auth GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY DomainName, UserName) AS share, row_number() OVER (PARTITION BY DomainName, UserName ORDER BY n DESC, LogonType) AS r FROM n) SELECT DomainName, UserName, LogonType, round(share, 6) AS share FROM s WHERE r = 1 AND share >= 0.7")
def i_dominant_type(spark, d):
    return injection.dominant_type(auth(spark, d), 0.7)


@query("i_low_off_hours", f"SELECT DomainName, UserName, round(count_if({OFF}) / count(*), 6) AS off_hours_ratio FROM auth GROUP BY ALL HAVING count_if({OFF}) / count(*) <= 0.6")
def i_low_off_hours(spark, d):
    return injection.low_off_hours(auth(spark, d), 0.6)


@query("i_victims", f"SELECT DomainName, UserName, min(day) AS day, count(*) AS n FROM auth WHERE day IN (22, 23) AND UserName LIKE 'User%' GROUP BY DomainName, UserName")
def i_victims(spark, d):
    return injection.victims(auth(spark, d), [22, 23])


@query("i_night", """SELECT event_id, ("Time" // 86400) * 86400 + 3600 + (("Time" % 86400) * 5) // 24 AS "Time", day FROM auth""")
def i_night(spark, d):
    return injection.off_hours_shift(auth(spark, d)).select("event_id", "Time", "day")


@query("i_dormant_wakeup", f", w AS (SELECT DISTINCT DomainName, UserName FROM auth WHERE day = 25 AND EventID = 4625) SELECT a.event_id, a.day FROM auth a LEFT JOIN w USING (DomainName, UserName) WHERE NOT (w.UserName IS NOT NULL AND a.day >= 18 AND a.day < 25)")
def i_dormant_wakeup(spark, d):
    a = auth(spark, d)
    return injection.dormant_wakeup(a, a.filter("day = 25 and EventID = 4625"), 18, 25).select("event_id", "day")


@query("i_retype", "SELECT event_id, 5 AS LogonType FROM auth WHERE day = 22")
def i_retype(spark, d):
    return injection.logon_type_switch(auth(spark, d).filter("day = 22")).select("event_id", "LogonType")


def _plan(a: DataFrame) -> DataFrame:
    return injection.victims(a, [22, 23]).select("DomainName", "UserName", (F.lit(22) * P.DAY + 36_000).cast("long").alias("start"))


def burst_sql(start: str, seconds: int, *keys: str) -> str:
    return f"""least({start} + CAST(floor({uniform_sql(*keys)} * {seconds}) AS BIGINT), ({start} // 86400 + 1) * 86400 - 1)"""


PLAN_SQL = f"""one AS (SELECT DomainName, UserName, min(event_id) AS event_id FROM auth WHERE day <= {SPLIT} GROUP BY ALL),
plan AS (SELECT DomainName, UserName, CAST(22 * 86400 + 36000 AS BIGINT) AS start FROM auth WHERE day IN (22, 23) AND UserName LIKE 'User%' GROUP BY ALL)"""


@query(
    "i_brute_force",
    f""", {PLAN_SQL}, b AS (SELECT *, {burst_sql("start", 600, "event_id", "copy", "42")} AS t FROM plan JOIN one USING (DomainName, UserName), (SELECT unnest(range(1, 31)) AS copy))
SELECT DomainName, UserName, event_id, t AS "Time", CAST(t // 86400 + 1 AS INT) AS day, 4625 AS EventID, '{injection.WRONG_PASSWORD}' AS FailureReason FROM b""",
)
def i_brute_force(spark, d):
    a = auth(spark, d)
    return injection.brute_force(a.filter(F.col("day") <= SPLIT), _plan(a)).select("DomainName", "UserName", "event_id", "Time", "day", "EventID", "FailureReason")


@query(
    "i_spraying",
    f""", {PLAN_SQL}, b AS (SELECT *, {burst_sql("start", 1800, "event_id", "1", "42")} AS t FROM plan JOIN one USING (DomainName, UserName))
SELECT DomainName, UserName, t AS "Time", CAST(t // 86400 + 1 AS INT) AS day, 4625 AS EventID, 'S99' AS Source FROM b""",
)
def i_spraying(spark, d):
    a = auth(spark, d)
    return injection.password_spraying(a.filter(F.col("day") <= SPLIT), _plan(a), "S99").select("DomainName", "UserName", "Time", "day", "EventID", "Source")


UNSEEN_SQL = f"""used AS (SELECT DISTINCT DomainName, UserName, Source FROM auth WHERE Source IS NOT NULL), band AS (SELECT Source, row_number() OVER (ORDER BY Source) - 1 AS i, count(*) OVER () AS size FROM (SELECT DISTINCT Source FROM used)),
who AS (SELECT DomainName, UserName, size, CAST(floor({uniform_sql("DomainName", "UserName", "42")} * size) AS BIGINT) AS start FROM (SELECT DISTINCT DomainName, UserName FROM auth), (SELECT max(size) AS size FROM band)),
steps AS (SELECT w.DomainName, w.UserName, min((b.i - start + w.size) % w.size) AS step FROM who w CROSS JOIN band b WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.DomainName = w.DomainName AND u.UserName = w.UserName AND u.Source = b.Source) GROUP BY ALL),
fresh AS (SELECT DomainName, UserName, Source AS fresh FROM who JOIN steps USING (DomainName, UserName) JOIN band ON i = (start + step) % who.size)"""


@query("i_unseen_sources", f", {UNSEEN_SQL} SELECT DomainName, UserName, fresh AS Source FROM fresh")
def i_unseen_sources(spark, d):
    return injection.unseen_sources(auth(spark, d), 0.0, 1.0)


@query(
    "i_workstation_burst",
    f""", {UNSEEN_SQL} SELECT DomainName, UserName, event_id, {burst_sql('"Time"', 300, "event_id", "copy", "42")} AS "Time", fresh AS Source FROM auth JOIN fresh USING (DomainName, UserName), (SELECT unnest(range(1, 6)) AS copy) WHERE day = 22""",
)
def i_workstation_burst(spark, d):
    a = auth(spark, d)
    return injection.workstation_burst(a.filter("day = 22"), injection.unseen_sources(a, 0.0, 1.0)).select("DomainName", "UserName", "event_id", "Time", "Source")


@query(
    "i_lateral_fanout",
    f""", h AS (SELECT host, row_number() OVER (ORDER BY {uniform_sql("host", "42")}, host) - 1 AS i, count(*) OVER () AS size FROM (SELECT DISTINCT LogHost AS host FROM auth)),
one AS (SELECT DomainName, UserName, min_by("Time", event_id) AS t FROM auth WHERE day = 22 GROUP BY ALL), c AS (SELECT *, (CAST(floor({uniform_sql("DomainName", "UserName", "42")} * size) AS BIGINT) + copy) % size AS i FROM one, (SELECT max(size) AS size FROM h), (SELECT unnest(range(5)) AS copy))
SELECT DomainName, UserName, {burst_sql("t", 3600, "copy", "42")} AS "Time", host AS LogHost FROM c JOIN h USING (i)""",
)
def i_lateral_fanout(spark, d):
    a = auth(spark, d)
    return injection.lateral_fanout(a.filter("day = 22"), a.select(F.col("LogHost").alias("host")).distinct(), 5).select("DomainName", "UserName", "Time", "LogHost")


@query("i_labels", f"SELECT lower(DomainName) AS DomainName, UserName, CAST(x AS INT) AS day, 1 AS is_anomaly, FALSE AS eval_exclude, 'brute_force' AS scenario, 'c1' AS campaign_id FROM (SELECT DISTINCT DomainName, UserName FROM auth WHERE day = 22), (VALUES (22), (23)) AS v(x)")
def i_labels(spark, d):
    m = auth(spark, d).filter("day = 22").select("DomainName", "UserName").distinct()
    return injection.labels_from_manifest(m.select("DomainName", "UserName", F.lit("brute_force").alias("scenario"), F.lit("c1").alias("campaign_id"), F.lit("22; 23").alias("days")))


# ---------------------------------------------------------------- reports


@query("j_last_before", ", r AS (SELECT event_id, DomainName, UserName, day FROM auth WHERE EventID = 4625) SELECT r.event_id, max(a.day) AS last_day FROM r LEFT JOIN auth a ON a.DomainName = r.DomainName AND a.UserName = r.UserName AND a.day < r.day GROUP BY r.event_id")
def j_last_before(spark, d):
    a = auth(spark, d)
    rows = a.filter("EventID = 4625").select("event_id", "DomainName", "UserName", "day")
    return reporting.last_before(rows, a, ["DomainName", "UserName"], "day", "day", "last_day").select("event_id", "last_day")


@query("w_ranks", f"WITH {S_SQL} SELECT doc_id, row_number() OVER (PARTITION BY day ORDER BY score, doc_id) AS rank_ordinal, rank() OVER w AS rank_min, rank() OVER w + count(*) OVER (PARTITION BY day, score) - 1 AS rank_max, rank() OVER w + (count(*) OVER (PARTITION BY day, score) - 1) / 2 AS rank_average FROM s WINDOW w AS (PARTITION BY day ORDER BY score)", with_auth=False)
def w_ranks(spark, d):
    return reporting.ranks(scores(spark, d), "score", ["day"], ["doc_id"]).select("doc_id", "rank_ordinal", "rank_min", "rank_max", "rank_average")


@query("w_rolling_mean", DAILY + " SELECT day, CASE WHEN count(v) OVER w >= 7 THEN round(avg(v) OVER w, 6) END AS v_rolling FROM dd WINDOW w AS (ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)")
def w_rolling_mean(spark, d):
    return reporting.rolling_mean(daily(spark, d), "v", 7, 7).select("day", "v_rolling")


@query("a_weighted_mean", f"WITH {O_SQL} SELECT day, round(sum(cust * price) FILTER (cust IS NOT NULL) / sum(price) FILTER (cust IS NOT NULL), 4) AS weighted_mean FROM o GROUP BY day", with_auth=False)
def a_weighted_mean(spark, d):
    return rounded(reporting.weighted_mean(orders(spark, d), "cust", "price", ["day"]), 4)


@query("a_top_values", ", n AS (SELECT day, LogHost, count(*) AS n FROM auth GROUP BY ALL) SELECT day, LogHost, n, CAST(r AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, LogHost) AS r FROM n) WHERE r <= 3")
def a_top_values(spark, d):
    return reporting.top_values(auth(spark, d), ["day"], "LogHost", 3)


@query("a_mode", ", n AS (SELECT UserName, Source, count(*) AS n FROM auth WHERE Source IS NOT NULL GROUP BY ALL) SELECT UserName, Source, n FROM (SELECT *, row_number() OVER (PARTITION BY UserName ORDER BY n DESC, Source) AS r FROM n) WHERE r = 1")
def a_mode(spark, d):
    return reporting.mode(auth(spark, d), ["UserName"], "Source")


@query("a_gap_histogram", f""", g AS (SELECT "Time" - lag("Time") OVER (PARTITION BY {K} ORDER BY "Time") AS gap FROM auth) SELECT gap, count(*) AS n FROM g WHERE gap <= 3000 GROUP BY gap""")
def a_gap_histogram(spark, d):
    return reporting.gap_histogram(auth(spark, d), 3000)


@query("m_quantiles", f"WITH {O_SQL}, r AS (SELECT day, price, row_number() OVER (PARTITION BY day ORDER BY price) - 1 AS i, count(*) OVER (PARTITION BY day) AS n FROM o) SELECT day, round(min(price) FILTER (i = round_even(0.25 * (n - 1), 0)), 6) AS q25, round(min(price) FILTER (i = round_even(0.9 * (n - 1), 0)), 6) AS q90 FROM r GROUP BY day", with_auth=False)
def m_quantiles(spark, d):
    return reporting.quantiles(orders(spark, d), "price", ["day"], [0.25, 0.9])


@query("v_scenarios", f"WITH {S_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, doc_id) AS dr, 100 * count(*) OVER (ORDER BY score DESC) / count(*) OVER () AS pct FROM s) SELECT source, count(*) AS n, round(avg(CAST(score >= 5000 AS INT)), 6) AS recall_threshold, round(avg(CAST(dr <= 3 AS INT)), 6) AS recall_daily, round(avg(CAST(pct <= 1 AS INT)), 6) AS recall_top1pct, round(median(pct), 6) AS median_rank_pct FROM r WHERE y = 1 GROUP BY source", with_auth=False)
def v_scenarios(spark, d):
    return reporting.scenario_detection(scores(spark, d), "score", "y", "source", ["doc_id"], 5000, 3)


@query("v_budget_curve", f"WITH {S_SQL}, r AS (SELECT y, row_number() OVER (PARTITION BY day ORDER BY score DESC, doc_id) AS r FROM s) SELECT CAST(b AS INT) AS budget, round(count_if(r <= b) / count(*), 6) AS recall FROM r, (VALUES (1), (3), (10)) AS v(b) WHERE y = 1 GROUP BY b", with_auth=False)
def v_budget_curve(spark, d):
    return reporting.budget_curve(scores(spark, d), "score", "y", ["doc_id"], [1, 3, 10])


@query("v_budget_needed", f"WITH {S_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, doc_id) AS r FROM s), p AS (SELECT source, r, row_number() OVER (PARTITION BY source ORDER BY r) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM r WHERE y = 1) SELECT source, CAST(min(r) FILTER (i = ceil(0.5 * (n - 1))) AS INT) AS k50, CAST(min(r) FILTER (i = ceil(0.8 * (n - 1))) AS INT) AS k80 FROM p GROUP BY source", with_auth=False)
def v_budget_needed(spark, d):
    return reporting.budget_needed(scores(spark, d), "score", "y", "source", ["doc_id"])


@query("v_complementarity", f"WITH {S_SQL} SELECT concat_ws('+', CASE WHEN score >= 3000 THEN 'long' END, CASE WHEN quality = 0 THEN 'poor' END) AS models, count(*) AS n FROM s WHERE y = 1 GROUP BY models", with_auth=False)
def v_complementarity(spark, d):
    return reporting.complementarity(scores(spark, d).withColumn("long", F.col("score") >= 3000).withColumn("poor", F.col("quality") == 0), "y", ["long", "poor"])


WHY = ["failure_ratio", "off_hours_ratio", "total_logons", "distinct_hosts"]


def tail_sql(c: str) -> str:
    """Each value's share of training rows that lie farther out, ties halved."""
    counts = f"SELECT {c}, CAST(sum(CAST(day <= {SPLIT} AS INT)) AS DOUBLE) AS t FROM b GROUP BY {c}"
    return f"t_{c} AS (SELECT {c}, least(m, 1 - m) AS beyond_{c} FROM (SELECT {c}, (sum(t) OVER (ORDER BY {c}) - t + t / 2) / sum(t) OVER () AS m FROM ({counts})))"


@query(
    "v_daily_scoring",
    f""", b AS (SELECT {K}, count(*) AS total_logons, count_if(EventID = 4625) / count(*) AS failure_ratio, count_if({OFF}) / count(*) AS off_hours_ratio, count(DISTINCT LogHost) AS distinct_hosts FROM auth GROUP BY {K}), {", ".join(map(tail_sql, WHY))},
j AS (SELECT *, failure_ratio + off_hours_ratio AS score FROM b {" ".join(f"JOIN t_{c} USING ({c})" for c in WHY)}),
r AS (SELECT {K}, f, row_number() OVER (PARTITION BY {K} ORDER BY beyond, f) AS i FROM ({" UNION ALL ".join(f"SELECT {K}, '{c}' AS f, coalesce(beyond_{c}, 0.5) AS beyond FROM j" for c in WHY)})),
w AS (SELECT {K}, string_agg(f, ',' ORDER BY i) AS reasons FROM r WHERE i <= 3 GROUP BY {K})
SELECT {K}, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY day ORDER BY score DESC, {K}) AS INT) AS rank, score >= 1.2 AS alert, reasons FROM j JOIN w USING ({K})""",
)
def v_daily_scoring(spark, d):
    m = intraday.account_days(auth(spark, d)).select(*KEYS, *WHY).withColumn("score", F.col("failure_ratio") + F.col("off_hours_ratio"))
    m = Scratch(spark, "scoring").write(m, "scored")  # read once per feature
    return reporting.daily_scoring(m, F.col("day") <= SPLIT, WHY, "score", KEYS, 1.2).withColumn("reasons", F.array_join("reasons", ","))


@query("v_review_set", f"WITH {O_SQL}, q AS (SELECT quantile_cont(price, [0.25, 0.5, 0.75, 0.99]) AS q FROM o WHERE train), t AS (SELECT * FROM o ORDER BY price DESC, o_orderkey LIMIT 20) SELECT 'price' AS model, o_orderkey, 'price' AS feature, round(price, 6) AS value, round((price - q[2]) / (q[3] - q[1]), 6) AS deviation, price > q[4] AS beyond_p99 FROM t, q", with_auth=False)
def v_review_set(spark, d):
    return reporting.review_set(orders(spark, d), F.col("train"), ["price"], ["price"], ["o_orderkey"], 20)


@query("v_score_summary", f"WITH {O_SQL} SELECT 'price' AS model, count(price) AS n, round(avg(price), 4) AS mean, round(stddev_samp(price), 4) AS std, round(min(price), 4) AS min, round(max(price), 4) AS max, round(quantile_cont(price, 0.01), 4) AS p1, round(quantile_cont(price, 0.05), 4) AS p5, round(quantile_cont(price, 0.25), 4) AS p25, round(quantile_cont(price, 0.5), 4) AS p50, round(quantile_cont(price, 0.75), 4) AS p75, round(quantile_cont(price, 0.95), 4) AS p95, round(quantile_cont(price, 0.99), 4) AS p99 FROM o", with_auth=False)
def v_score_summary(spark, d):
    return rounded(reporting.score_summary(orders(spark, d), "price", "price"), 4)


@query("d_candidates", ", l AS (SELECT max(day) FILTER (day < 25) AS last, bool_or(day = 25) AS there FROM auth GROUP BY DomainName, UserName), n AS (SELECT max(n) / sum(n) AS share FROM (SELECT DomainName, UserName, LogonType, count(*) AS n FROM auth GROUP BY ALL) GROUP BY DomainName, UserName) SELECT 'gap' AS kind, CAST(g AS DOUBLE) AS threshold, count_if(NOT there AND 25 - last >= g) AS accounts FROM l, (VALUES (2), (5)) AS v(g) GROUP BY g UNION ALL SELECT 'share', CAST(s AS DOUBLE), count_if(share >= s) FROM n, (VALUES (0.6), (0.8)) AS v(s) GROUP BY s")
def d_candidates(spark, d):
    return reporting.candidate_counts(auth(spark, d), 25, [2, 5], [0.6, 0.8])


# ---------------------------------------------------------------- methods run together

RANKED = f"rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r, row_number() OVER (PARTITION BY day ORDER BY score DESC, doc_id) AS dr FROM s)"
SIZES = (10, 50, 100)


def daily_sql(source: str) -> str:
    per = ", ".join(f"count_if(dr <= {n}) AS a{n}, sum(CASE WHEN dr <= {n} THEN y ELSE 0 END) AS h{n}" for n in SIZES)
    return f"dd AS (SELECT day, {per}, sum(y) AS p FROM {source} GROUP BY day)"


@query("r_split_record", ", x AS (SELECT min(day) AS min_day, max(day) AS max_day, count_if(day <= 21) AS n_train, count_if(day > 21) AS n_eval, count(DISTINCT CASE WHEN day <= 21 THEN day END) AS n_train_days, count(DISTINCT CASE WHEN day > 21 THEN day END) AS n_eval_days FROM auth) SELECT 21 AS split_day, *, round(n_eval / (n_train + n_eval), 6) AS eval_ratio FROM x")
def r_split_record(spark, d):
    return runner.split_record(auth(spark, d), SPLIT)


@query("r_eval_days", "SELECT day, count(*) AS n FROM auth WHERE day IN (23, 25) GROUP BY day")
def r_eval_days(spark, d):
    return runner.restrict_days(auth(spark, d), SPLIT, [25, 23]).groupBy("day").agg(F.count("*").alias("n"))


@query("r_percentile", f"WITH {S_SQL}, n AS (SELECT count(*) AS n FROM s WHERE y = 0) SELECT doc_id, round(greatest(0.0, least(1.0, ((SELECT count(*) FROM s AS r WHERE r.y = 0 AND r.score <= s.score) - 1) / (n - 1))), 6) + 0.0 AS pct FROM s, n", with_auth=False)
def r_percentile(spark, d):
    s = scores(spark, d)
    return runner.percentile_among(s, "score", s.filter("y = 0"), "score", "pct").select("doc_id", "pct")


@query(
    "r_ks",
    f"""WITH {S_SQL}, g AS (SELECT score AS v, count_if(day <= 10) AS a, count_if(day > 10) AS b FROM s GROUP BY score), n AS (SELECT sum(a) AS na, sum(b) AS nb FROM g),
k AS (SELECT max(abs(fa - fb)) AS ks FROM (SELECT sum(a) OVER (ORDER BY v) / na AS fa, sum(b) OVER (ORDER BY v) / nb AS fb FROM g, n))
SELECT CAST(na AS BIGINT) AS n_fit, CAST(nb AS BIGINT) AS n_eval, round(ks, 6) AS ks, round(1 - (SELECT count(*) FROM g WHERE b > 0) / nb, 6) AS ties_share, (SELECT v FROM g ORDER BY b DESC, v LIMIT 1) AS mode, round((SELECT max(b) FROM g) / nb, 6) AS mode_share FROM n, k""",
    with_auth=False,
)
def r_ks(spark, d):
    s = scores(spark, d)
    return runner.ks_report(s.filter("day <= 10"), s.filter("day > 10"), "score")


@query(
    "r_labelled_metrics",
    f"""WITH {S_SQL}, {CUM}, {RANKED}, {daily_sql("rk")}, u AS (SELECT sum(c.p / t.P * tp / k) AS ap, sum(c.p * (t.N - t.P - (k - tp) + (c.n - c.p) / 2)) / any_value(t.P * (t.N - t.P)) AS roc FROM c, t)
SELECT CAST(t.P AS BIGINT) AS n_positive, round(100 * t.P / t.N, 6) AS positive_rate_pct, round(ap, 6) AS pr_auc, round(roc, 6) AS roc_auc, {", ".join(f"round(CASE WHEN t.N >= {k} THEN (SELECT sum(y) FROM rk WHERE r <= {k}) / {k} END, 6) AS precision_at_{k}" for k in SIZES)},
round((SELECT sum(y) FROM rk WHERE r <= greatest(1, round_even(0.05 * t.N, 0))) / t.P, 6) AS recall_at_budget, {", ".join(f"round((SELECT sum(h{n}) FROM dd) / t.P, 6) AS recall_at_{n}_per_day, round((SELECT avg(h{n} / a{n}) FROM dd), 6) AS precision_at_{n}_per_day" for n in SIZES)} FROM t, u""",
    with_auth=False,
)
def r_labelled_metrics(spark, d):
    return runner.labelled_metrics(scores(spark, d), "score", "y", ["doc_id"], SIZES, 0.05, SIZES)


@query(
    "r_evaluate",
    f"""WITH {S_SQL}, a AS (SELECT *, doc_id % 13 = 0 AS gone FROM s), e AS (SELECT * FROM a WHERE NOT gone), rk AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, doc_id) AS dr FROM e), {daily_sql("rk")},
x AS (SELECT count_if(score > 5000 AND y = 1) AS tp, count_if(score > 5000 AND y <> 1) AS fp, count_if(score <= 5000 AND y = 1) AS fn, count_if(score <= 5000 AND y <> 1) AS tn FROM e),
al AS (SELECT count(*) AS n_days, avg(n) AS m, median(n) AS md, min(n) AS lo, max(n) AS hi FROM (SELECT day, count_if(score > 5000) AS n FROM e GROUP BY day)), cp AS (SELECT count(*) AS campaigns, count_if(c) AS campaigns_caught FROM (SELECT source, bool_or(score > 5000) AS c FROM e WHERE y = 1 GROUP BY source)),
c AS (SELECT score, sum(y) AS p, sum(sum(y)) OVER (ORDER BY score DESC) AS tp, sum(count(*)) OVER (ORDER BY score DESC) AS k FROM e GROUP BY score), t AS (SELECT sum(y) AS P, count(*) AS N FROM e)
SELECT (SELECT count(*) FROM a) AS n_rows, (SELECT count_if(gone) FROM a) AS n_excluded, t.N AS n_eval, x.tp, fp, fn, tn, round(x.tp / nullif(x.tp + fp, 0), 6) AS precision, round(x.tp / nullif(x.tp + fn, 0), 6) AS recall, round((x.tp + fp) / t.N, 6) AS alert_rate, n_days, round(m, 6) AS alerts_per_day_mean, round(md, 6) AS alerts_per_day_median, lo AS alerts_per_day_min, hi AS alerts_per_day_max,
  campaigns, campaigns_caught, {", ".join(f"round((SELECT sum(h{n}) FROM dd) / t.P, 6) AS recall_at_{n}_per_day" for n in SIZES)}, (SELECT round(sum(c.p / t.P * c.tp / c.k), 6) FROM c) AS pr_auc, round(t.P / t.N, 6) AS random_pr_auc FROM t, x, al, cp""",
    with_auth=False,
)
def r_evaluate(spark, d):
    s = scores(spark, d)
    aligned = s.select("doc_id", "day", "score", F.col("y").alias("is_anomaly"), (F.col("doc_id") % 13 == 0).alias("eval_exclude"), F.col("source").alias("campaign_id"))
    return runner.evaluate(aligned, "score", 5000, ["doc_id"], SIZES)


GROUPED = ["zscore_global", "rule_ecdf", "random"]


def _segments(spark, d):
    o = orders(spark, d).withColumn("half", (F.col("o_orderkey") % 2).cast("int"))
    return runner.run_segments(o, F.col("train"), ["price", "cust"], ["o_orderkey"], GROUPED, "half", [0, 1])


def ecdf_part(c: str) -> str:
    return f"SELECT half, {c}, (sum(count_if(train)) OVER w - count_if(train)) / sum(count_if(train)) OVER (PARTITION BY half) AS e FROM h WHERE {c} IS NOT NULL GROUP BY half, {c} WINDOW w AS (PARTITION BY half ORDER BY {c})"


SEGMENT_SQL = f"""{O_SQL}, h AS (SELECT *, CAST(o_orderkey % 2 AS INT) AS half FROM o), l AS (SELECT o_orderkey, half, train, 'price' AS f, price AS v FROM h UNION ALL SELECT o_orderkey, half, train, 'cust', cust FROM h),
m AS (SELECT half, f, median(v) AS m FROM l WHERE train AND v IS NOT NULL GROUP BY half, f), sc AS (SELECT half, f, any_value(m) AS m, 1.4826 * median(abs(v - m)) AS s FROM l JOIN m USING (half, f) WHERE train AND v IS NOT NULL GROUP BY half, f),
z AS (SELECT half, 'zscore_global' AS method, o_orderkey, train, max(coalesce(abs(v - m) / s, 0)) AS score FROM l JOIN sc USING (half, f) GROUP BY half, o_orderkey, train),
pe AS ({ecdf_part("price")}), ce AS ({ecdf_part("cust")}),
e AS (SELECT h.half, 'rule_ecdf' AS method, o_orderkey, train, greatest(coalesce(pe.e, 0), coalesce(ce.e, 0)) AS score FROM h LEFT JOIN pe ON pe.half = h.half AND pe.price = h.price LEFT JOIN ce ON ce.half = h.half AND ce.cust = h.cust),
r AS (SELECT half, 'random' AS method, o_orderkey, train, {uniform_sql("o_orderkey", "42", "0")} AS score FROM h), a AS (SELECT * FROM z UNION ALL SELECT * FROM e UNION ALL SELECT * FROM r),
t AS (SELECT half AS segment, method, quantile_cont(score, 0.95) AS threshold, count(*) AS n_train FROM a WHERE train GROUP BY half, method)"""


@query("r_thresholds", f"WITH {SEGMENT_SQL} SELECT segment, method, round(threshold, 6) AS threshold, n_train FROM t", with_auth=False)
def r_thresholds(spark, d):
    return _segments(spark, d)[1]


@query("r_segment_scores", f"WITH {SEGMENT_SQL} SELECT half AS segment, method, o_orderkey, train AS is_train, round(score, 6) AS score FROM a", with_auth=False)
def r_segment_scores(spark, d):
    return _segments(spark, d)[0]


@query("r_contamination", f"WITH {S_SQL}, q AS (SELECT 0.05 AS c, quantile_cont(score, 0.95) AS threshold FROM s WHERE day <= 10 UNION ALL SELECT 0.2, quantile_cont(score, 0.8) FROM s WHERE day <= 10), l AS (SELECT * FROM s WHERE day > 10), {CUM.replace('FROM s ', 'FROM l ').replace('FROM s)', 'FROM l)')}, u AS (SELECT sum(c.p / t.P * tp / k) AS ap, sum(c.p * (t.N - t.P - (k - tp) + (c.n - c.p) / 2)) / any_value(t.P * (t.N - t.P)) AS roc FROM c, t), x AS (SELECT c, any_value(threshold) AS threshold, count_if(score >= threshold AND y = 1) AS tp, count_if(score >= threshold) AS al, sum(y) AS p, count(*) AS n FROM l, q GROUP BY c) SELECT CAST(c AS DOUBLE) AS contamination, round(threshold, 6) AS threshold, round(ap, 6) AS pr_auc, round(roc, 6) AS roc_auc, round(tp / nullif(al, 0), 6) AS precision, round(tp / nullif(p, 0), 6) AS recall, round(al / n, 6) AS alert_rate FROM x, u", with_auth=False)
def r_contamination(spark, d):
    return runner.contamination_sweep(scores(spark, d).select("y", "score", (F.col("day") <= 10).alias("is_train")), [0.05, 0.2])


RUNS_SQL = f"runs AS (SELECT doc_id % 3 AS config_id, day % 2 AS seed, avg(score) AS pr_auc FROM s GROUP BY ALL)"


@query("r_best", f"WITH {S_SQL}, {RUNS_SQL}, m AS (SELECT CAST(config_id AS VARCHAR) AS config_id, avg(pr_auc) AS v FROM runs GROUP BY config_id) SELECT 'long' AS model, config_id, round(v, 4) AS pr_auc_mean FROM m ORDER BY v DESC, config_id LIMIT 1", with_auth=False)
def r_best(spark, d):
    s = scores(spark, d).groupBy((F.col("doc_id") % 3).cast("string").alias("config_id"), (F.col("day") % 2).alias("seed")).agg(F.avg("score").alias("pr_auc")).withColumn("model", F.lit("long"))
    return rounded(runner.best_of(runner.summarised(s, ["pr_auc"])), 4)


@query(
    "r_stability",
    f"""WITH {S_SQL}, k AS (SELECT doc_id, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS a, rank() OVER (ORDER BY score % 100) + (count(*) OVER (PARTITION BY score % 100) - 1) / 2 AS b, rank() OVER (ORDER BY -score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS c,
row_number() OVER (ORDER BY score DESC, doc_id) AS ra, row_number() OVER (ORDER BY score % 100 DESC, doc_id) AS rb, row_number() OVER (ORDER BY -score DESC, doc_id) AS rc FROM s),
p AS (SELECT corr(a, b) AS s, count_if(ra <= 20 AND rb <= 20) / 20 AS o FROM k UNION ALL SELECT corr(a, c), count_if(ra <= 20 AND rc <= 20) / 20 FROM k UNION ALL SELECT corr(b, c), count_if(rb <= 20 AND rc <= 20) / 20 FROM k)
SELECT 3 AS n_runs, round(avg(s), 6) AS spearman_mean, round(min(s), 6) AS spearman_min, round(avg(o), 6) AS topk_overlap_mean, round(min(o), 6) AS topk_overlap_min FROM p""",
    with_auth=False,
)
def r_stability(spark, d):
    s = scores(spark, d).select("doc_id", "score")
    return runner.stability([s, s.withColumn("score", F.col("score") % 100), s.withColumn("score", -F.col("score"))], ["doc_id"], "score", 20)


@query("r_random_reference", f"WITH {S_SQL}, x AS (SELECT seed, y, {uniform_sql('doc_id', 'seed', '0')} AS u FROM s, (VALUES (1), (2), (3)) AS v(seed)), c AS (SELECT seed, y, sum(y) OVER w AS tp, count(*) OVER w AS k, sum(y) OVER (PARTITION BY seed) AS p, count(*) OVER (PARTITION BY seed) AS n FROM x WINDOW w AS (PARTITION BY seed ORDER BY u DESC)), a AS (SELECT seed, sum(y / p * tp / k) AS ap, any_value(p / n) AS e FROM c GROUP BY seed) SELECT count(*) AS n_seeds, round(avg(ap), 6) AS pr_auc_mean, round(stddev_samp(ap), 6) AS pr_auc_std, round(max(e), 6) AS expected FROM a", with_auth=False)
def r_random_reference(spark, d):
    return runner.random_reference(scores(spark, d), "y", ["doc_id"], [1, 2, 3])


@query("r_grid")
def r_grid(spark, d):
    """Two forests over two seeds on the embeddings, odd labels being the positives."""
    v, x = vectors(spark, d)
    v = v.withColumn("y", F.col("segment").cast("int"))
    runs = runner.run_grid(v, F.col("train"), x, ["vec_id"], "y", [{"id": "small", "model": "iforest", "trees": 10}, {"id": "large", "model": "iforest", "trees": 30}], [1, 2])
    return runner.summarised(runs)


@query("v_top_fraction", f"WITH {S_SQL} SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM s) WHERE r <= ceil(0.03 * n)", with_auth=False)
def v_top_fraction(spark, d):
    return reporting.top_fraction(scores(spark, d), "score", ["doc_id"], 0.03).select("doc_id")


@query("b_registry_z", f"WITH {O_SQL}, t AS (SELECT * FROM o WHERE train), m AS (SELECT median(price) AS pm, median(cust) AS cm FROM t), d AS (SELECT 1.4826 * median(abs(price - pm)) AS ps, 1.4826 * median(abs(cust - cm)) AS cs FROM t, m) SELECT o_orderkey, round(greatest(abs(price - pm) / ps, coalesce(abs(cust - cm) / cs, 0)), 6) AS z_score FROM o, m, d", with_auth=False)
def b_registry_z(spark, d):
    return baselines.registry_z(orders(spark, d), F.col("train"), ["price", "cust"]).select("o_orderkey", "z_score")


@query("b_external_rules", f"WITH {O_SQL}, p AS (SELECT price, (sum(count_if(train)) OVER (ORDER BY price) - count_if(train)) / sum(count_if(train)) OVER () AS e FROM o GROUP BY price) SELECT o_orderkey, round(greatest(p.e, CAST(coalesce(cust >= 900, FALSE) AS INT)), 6) AS ecdf_score FROM o JOIN p USING (price)", with_auth=False)
def b_external_rules(spark, d):
    return baselines.ecdf_rules(orders(spark, d), F.col("train"), ["price", "cust"], {"cust": 900}).select("o_orderkey", "ecdf_score")


@query(
    "n_scenario_auc",
    f"""WITH {S_SQL}, r AS (SELECT score AS x, CASE WHEN y = 1 THEN source END AS sc FROM s), pairs AS (SELECT a.sc, avg(CASE WHEN a.x > b.x THEN 1.0 WHEN a.x = b.x THEN 0.5 ELSE 0.0 END) AS auc FROM r a, r b WHERE a.sc IS NOT NULL AND b.sc IS NULL GROUP BY a.sc)
SELECT 'up' AS direction, sc AS scenario, round(auc, 6) AS auc, auc >= 0.7 AS passes FROM pairs UNION ALL SELECT 'down', sc, round(1 - auc, 6), 1 - auc >= 0.7 FROM pairs UNION ALL SELECT 'both', sc, round(greatest(auc, 1 - auc), 6), greatest(auc, 1 - auc) >= 0.7 FROM pairs""",
    with_auth=False,
)
def n_scenario_auc(spark, d):
    rows = scores(spark, d).withColumn("scenario", F.when(F.col("y") == 1, F.col("source")))
    return statistics.scenario_auc(rows.select("scenario", *[F.col("score").alias(x) for x in ("up", "down", "both")]), {"up": "up", "down": "down", "both": "both"}, "scenario").withColumnRenamed("feature", "direction")


@query(
    "d_human_machine",
    f""", a AS (SELECT {K}, {ETYPE} AS e, CAST(count(*) AS DOUBLE) AS total_logons, count_if({OFF}) / count(*) AS off_hours_ratio FROM auth GROUP BY {K}, e), l AS (SELECT 'total_logons' AS feature, 'wider' AS expected, e, total_logons AS v FROM a UNION ALL SELECT 'off_hours_ratio', 'higher', e, off_hours_ratio FROM a),
q AS (SELECT feature, expected, median(v) FILTER (e = 'Machine') AS m1, avg(v) FILTER (e = 'Machine') AS a1, quantile_cont(v, 0.75) FILTER (e = 'Machine') - quantile_cont(v, 0.25) FILTER (e = 'Machine') AS i1, median(v) FILTER (e = 'User') AS m2, avg(v) FILTER (e = 'User') AS a2, quantile_cont(v, 0.75) FILTER (e = 'User') - quantile_cont(v, 0.25) FILTER (e = 'User') AS i2 FROM l GROUP BY feature, expected)
SELECT feature, expected, round(m1, 6) AS median_one, round(a1, 6) AS mean_one, round(i1, 6) AS iqr_one, round(m2, 6) AS median_other, round(a2, 6) AS mean_other, round(i2, 6) AS iqr_other, CASE WHEN expected = 'wider' THEN i1 > i2 WHEN m1 <> m2 THEN m1 > m2 ELSE a1 > a2 END AS holds FROM q""",
)
def d_human_machine(spark, d):
    m = intraday.account_days(auth(spark, d)).select("entity_type", F.col("total_logons").cast("double").alias("total_logons"), "off_hours_ratio")
    return statistics.by_kind(m, "entity_type", "Machine", "User", {"total_logons": "wider", "off_hours_ratio": "higher"})


@query("i_presence", "SELECT DISTINCT lower(DomainName) AS DomainName, UserName, day FROM auth WHERE day IN (22, 24)")
def i_presence(spark, d):
    return injection.presence(auth(spark, d), [22, 24])


@query("i_replayed", """, f AS (SELECT DomainName, UserName, min("Time") AS t0 FROM auth WHERE day = 22 GROUP BY ALL), r AS (SELECT event_id, t0 + 7200 AS s, "Time" - t0 AS gap FROM auth JOIN f USING (DomainName, UserName) WHERE day = 22) SELECT event_id, least(s + CAST(floor(gap * 0.5) AS BIGINT), (s // 86400 + 1) * 86400 - 1) AS "Time" FROM r""")
def i_replayed(spark, d):
    return injection.replayed(auth(spark, d).filter("day = 22"), F.lit(7200), 0.5).select("event_id", "Time")


@query("p_population", "SELECT count(*) AS n FROM auth WHERE UserName NOT LIKE '%$'")
def p_population(spark, d):
    return auth(spark, d).filter(P.population(F.col("UserName"), drop_machine=True, drop_system=True)).agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
