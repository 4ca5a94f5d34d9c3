"""Authentication logs: schemas, raw ingest, typed tables, overlays, footers, manifests, and the adapter from ``events``."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrylake.functions import predicates as P

INTS = ("EventID", "LogonType")
STRINGS = (
    "LogHost LogonTypeDescription UserName DomainName LogonID SubjectUserName SubjectDomainName SubjectLogonID Status Source "
    "ServiceName Destination AuthenticationPackage FailureReason ProcessName ProcessID ParentProcessName ParentProcessID"
).split()
ORDER = ["Time", "EventID", "LogHost", "LogonType", *STRINGS[1:]]
EVENT_SCHEMA = T.StructType([T.StructField(c, T.LongType() if c == "Time" else T.IntegerType() if c in INTS else T.StringType()) for c in ORDER])
DAY_TAG = r"day[-_]?(\d+)"


def day_of_file(path: Column) -> Column:
    """The day's number in a file's name; null if it has none."""
    return F.try_to_number(F.nullif(F.regexp_extract(F.element_at(F.split(path, "/"), -1), DAY_TAG, 1), F.lit("")), F.lit("999999999")).cast("int")


def coerced(raw: DataFrame) -> DataFrame:
    """Every field of the schema from a table of strings: missing or empty is null, a bad integer is null."""
    have = set(raw.columns)
    value = lambda c: F.nullif(F.col(c), F.lit("")) if c in have else F.lit(None).cast("string")
    kinds = {"Time": "bigint", "EventID": "int", "LogonType": "int"}
    columns = [F.expr(f"try_cast(nullif(`{c}`, '') AS {kinds[c]})").alias(c) if c in kinds and c in have else value(c).cast(kinds.get(c, "string")).alias(c) for c in ORDER]
    return raw.select(*columns, *[c for c in raw.columns if c not in ORDER])


def read_json_lines(spark: SparkSession, path: str, event_ids: Iterable[int] = (4624, 4625)) -> DataFrame:
    """Raw JSON lines (bz2 is split by the reader): lines without a wanted id are dropped before parsing, malformed ones after."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"))
    marks = [F.col("value").contains(f'"EventID": {i}') | F.col("value").contains(f'"EventID":{i}') for i in event_ids]
    wanted = marks[0]
    for m in marks[1:]:
        wanted = wanted | m
    text = T.StructType([T.StructField(c, T.StringType()) for c in ORDER] + [T.StructField("_corrupt", T.StringType())])
    parsed = lines.filter(wanted).select(F.from_json("value", text, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"), day_of_file(F.col("path")).alias("day"))
    return coerced(parsed.filter(F.col("e._corrupt").isNull()).select("e.*", "day").drop("_corrupt")).filter(F.col("EventID").isin(*event_ids))


def write_events(events: DataFrame, path: str, by: tuple[str, ...] = ("EventID", "day"), mode: str = "overwrite") -> None:
    """Typed snappy files in one folder per key; Spark commits a job's files together."""
    events.write.mode(mode).partitionBy(*by).option("compression", "snappy").parquet(path)


def read_events(spark: SparkSession, path: str, columns: Iterable[str] | None = None, days: Iterable[int] | None = None) -> DataFrame:
    """Pruned by day and columns; a column that the files lack is null."""
    df = spark.read.parquet(path)
    if days is not None:
        df = df.filter(F.col("day").isin(*days))
    if columns is None:
        return df
    kinds = {f.name: f.dataType for f in EVENT_SCHEMA}
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kinds.get(c, T.StringType())).alias(c) for c in columns])


def conform(events: DataFrame) -> DataFrame:
    """The 21 columns in order and type; a missing column is an error."""
    missing = [c for c in ORDER if c not in events.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return events.select(*ORDER).to(EVENT_SCHEMA)


def backfill(events: DataFrame) -> DataFrame:
    """Missing columns as nulls, by name."""
    empty = events.sparkSession.createDataFrame([], EVENT_SCHEMA)
    return empty.unionByName(events, allowMissingColumns=True)


def overlay(base: DataFrame, days: DataFrame) -> DataFrame:
    """Days that the overlay has replace the base's days."""
    return base.join(days.select("day").distinct(), "day", "left_anti").unionByName(days, allowMissingColumns=True)


def available_days(events: DataFrame, need: Iterable[int] = (4624, 4625)) -> DataFrame:
    """Days that have every needed event id."""
    need = list(need)
    return events.filter(F.col("EventID").isin(*need)).groupBy("day").agg(F.count_distinct("EventID").alias("n")).filter(F.col("n") == len(need)).select("day")


def load_days(cleaned: DataFrame | None, interim: DataFrame) -> DataFrame:
    """Cleaned days where there are any, else interim days that have both event ids, basically cleaned."""
    ready = interim.join(available_days(interim), "day", "left_semi").filter(P.valid_user(F.col("UserName"))).withColumn("DomainName", P.normal_domain(F.col("DomainName")))
    return ready if cleaned is None else overlay(ready, cleaned)


def shift_day(events: DataFrame, source_day: int, target_day: int) -> DataFrame:
    return events.filter(F.col("day") == source_day).withColumn("Time", F.col("Time") + (target_day - source_day) * P.DAY).withColumn("day", F.lit(target_day))


def footers(spark: SparkSession, path: str) -> DataFrame:
    """rows and bytes by file, from the files' own metadata columns."""
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))


def footer_facts(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """file, rows, row_groups, columns, schema_ok of every parquet file below ``path``, from its footer alone; an unreadable one has ``error``.

    Files are listed by Spark and their footers read by the tasks, a few kilobytes from the end of each.
    """
    wanted = [f.name for f in schema] if schema else None

    def facts(batches):
        import pyarrow as pa
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        for batch in batches:
            out = []
            for file in batch.column("path").to_pylist():
                try:
                    system, place = fs.FileSystem.from_uri(file.replace("file:/", "file:///", 1) if re.match("file:/[^/]", file) else file)
                    with system.open_input_file(place) as f:
                        m = pq.ParquetFile(f)
                        out.append((file, m.metadata.num_rows, m.metadata.num_row_groups, m.metadata.num_columns, None if wanted is None else m.schema_arrow.names == wanted, None))
                except Exception as e:  # one broken file must not hide the others
                    out.append((file, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["file", "rows", "row_groups", "columns", "schema_ok", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path")
    return files.mapInArrow(facts, "file string, rows long, row_groups long, columns long, schema_ok boolean, error string")


def convert_files(spark: SparkSession, paths: list[str], target: str, max_files: int | None = None) -> DataFrame:
    """Raw files to typed ones, each committed by itself: file, rows, error. A file that fails is reported and the others go on."""
    done = []
    for path in sorted(paths)[:max_files]:  # max_files is the caller's wish, for a trial
        try:
            write_events(read_json_lines(spark, path).withColumn("file", F.lit(path.rsplit("/", 1)[-1])), target, ("EventID", "day", "file"), "append")
            done.append((path, read_json_lines(spark, path).count(), None))
        except Exception as e:
            done.append((path, None, f"{type(e).__name__}: {e}"[:500]))
    return spark.createDataFrame(done, "file string, rows long, error string")


def split_by_event(spark: SparkSession, paths: list[str], target: str) -> None:
    """Mixed files to one folder per event id and day. EventID may be text or a number; all files must have one schema otherwise."""
    first = None
    for path in paths:
        fields = [(f.name, f.dataType.simpleString()) for f in spark.read.parquet(path).schema if f.name != "EventID"]
        if first is None:
            first = fields
        if fields != first:
            raise ValueError(f"{path} has another schema: {sorted(set(fields) ^ set(first))}")
    for path in paths:
        mixed = spark.read.parquet(path).withColumn("EventID", F.expr("try_cast(EventID AS INT)"))
        write_events(mixed.filter(F.col("EventID").isin(4624, 4625)), target, mode="append")


def resolved_day(base: DataFrame, overlaid: DataFrame | None, day: int) -> DataFrame:
    """One day's events from the overlay if it has that day, else from the base; an error if either event id lacks rows there."""
    own = None if overlaid is None else overlaid.filter(F.col("day") == day)
    rows = own if own is not None and own.limit(1).count() else base.filter(F.col("day") == day)
    there = {r[0] for r in rows.select("EventID").distinct().collect()}  # two event ids
    if there != {4624, 4625}:
        raise ValueError(f"day {day} has event ids {sorted(there)}, both are needed")
    return rows


def digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def verify_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, state: missing, extra, differs; no rows when the sets and the hashes agree."""
    a, b = found.select("path", F.col("sha256").alias("have")), manifest.select("path", F.col("sha256").alias("want"))
    state = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("have") != F.col("want"), "differs")
    return a.join(b, "path", "full").select("path", state.alias("state")).filter("state is not null")


def append_log(log: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the log lacks are appended; unknown columns are kept as nulls on the other side."""
    known = log.select(*[F.col(c).alias(f"k_{c}") for c in key]).distinct()
    same = None
    for c in key:
        one = F.col(c).eqNullSafe(F.col(f"k_{c}"))
        same = one if same is None else same & one
    return log.unionByName(rows.dropDuplicates(key).join(known, same, "left_anti"), allowMissingColumns=True)


def save_parameters(path: str, kind: str, values: dict) -> str:
    """Fitted parameters as JSON with a format tag; returns its digest."""
    text = json.dumps({"format": f"sentrylake/{kind}/1", "values": values}, sort_keys=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return hashlib.sha256(text.encode()).hexdigest()


def load_parameters(path: str, kind: str) -> dict:
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if found.get("format") != f"sentrylake/{kind}/1":
        raise ValueError(f"not a {kind} file: {found.get('format')}")
    return found["values"]


def auth_from_events(events: DataFrame) -> DataFrame:
    """A deterministic authentication log out of the ``events`` table."""
    time = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    k = F.get_json_object("props", "$.k").cast("int")
    base = events.select("event_id", "user_id", "event_type", "value", time.alias("Time"), k.alias("k"))
    failed = F.col("event_type") == "error"
    return base.select(
        "event_id",
        "Time",
        (F.floor(F.col("Time") / P.DAY) + 1).cast("int").alias("day"),
        F.when(failed, 4625).otherwise(4624).alias("EventID"),
        F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("C"), F.col("user_id").cast("string"), F.lit("$"))).otherwise(F.concat(F.lit("User"), F.col("user_id").cast("string"))).alias("UserName"),
        F.concat(F.lit("Dom"), (F.col("user_id") % 3).cast("string")).alias("DomainName"),
        F.when(F.col("k") % 17 != 0, F.concat(F.lit("S"), (F.col("k") % 20).cast("string"))).alias("Source"),
        F.concat(F.lit("H"), (F.col("event_id") % 13).cast("string")).alias("LogHost"),
        F.when(F.col("event_type").isin("click", "view", "error"), 3).when(F.col("event_type") == "purchase", 2).otherwise(10).alias("LogonType"),
        F.when(F.col("value") > 100, "NTLM").otherwise("Kerberos").alias("AuthenticationPackage"),
        F.when(failed, F.when(F.col("k") % 4 == 0, "Account locked out.").otherwise("Unknown user name or bad password.")).alias("FailureReason"),
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("Proc"), F.col("k").cast("string"))).otherwise("svchost").alias("ProcessName"),
    )


#: the same view for the SQL side
AUTH_SQL = """auth AS (
  SELECT event_id, t AS "Time", CAST(t // 86400 + 1 AS INT) AS day,
    CASE WHEN event_type = 'error' THEN 4625 ELSE 4624 END AS EventID,
    CASE WHEN user_id % 5 = 0 THEN 'C' || user_id || '$' ELSE 'User' || user_id END AS UserName,
    'Dom' || (user_id % 3) AS DomainName,
    CASE WHEN k % 17 <> 0 THEN 'S' || (k % 20) END AS Source,
    'H' || (event_id % 13) AS LogHost,
    CASE WHEN event_type IN ('click', 'view', 'error') THEN 3 WHEN event_type = 'purchase' THEN 2 ELSE 10 END AS LogonType,
    CASE WHEN value > 100 THEN 'NTLM' ELSE 'Kerberos' END AS AuthenticationPackage,
    CASE WHEN event_type = 'error' THEN CASE WHEN k % 4 = 0 THEN 'Account locked out.' ELSE 'Unknown user name or bad password.' END END AS FailureReason,
    CASE WHEN k % 3 = 0 THEN 'Proc' || k ELSE 'svchost' END AS ProcessName
  FROM (SELECT *, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS t, CAST(props->>'$.k' AS INT) AS k FROM events)
)"""
