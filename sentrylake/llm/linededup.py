r"""Line deduplication against levelled sorted runs of line hashes.

Batches of documents come in ascending doc_id. A batch's distinct line keys, each with its smallest doc_id, are
anti-joined by sort-merge with every run there is; what is new is written as a run of level 0: bucketed by hash and
sorted, so that neither later joins nor compaction shuffle it again. ``fanout`` runs of a level are merged into one of
the next. As batches ascend, the runs hold every key once, with the smallest doc_id of all; a line is dropped if its
key's document is a smaller one. A frequent line is one row per task after the map side, and the one join of all lines
with the runs is shuffled on both sides, so AQE splits a hot key.

Keys are 120 bits of SHA-256 in two numbers, so that no made-up line passes for another. Runs have a bucket for every
``bucket_rows`` lines of the input.

Defined results: null or empty text is one empty line; keys shorter than ``least`` code points are kept always; a
line repeated in one document only is kept there; rows of one doc_id are one document; rows with null doc_id are kept
whole and teach nothing; columns beside doc_id and text pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, ascii_lower, fixed

WHITE = " \t\n\x0b\f\r"
KEY = ["h", "g"]


class LevelledRuns:
    """Sorted runs (h, g, first) by level, in the shared folder, named in the session's catalog."""

    def __init__(self, spark: SparkSession, fanout: int = 2, rows: int = 0, bucket_rows: int = 4_000_000):
        self.spark, self.fanout, self.scratch = spark, fanout, Scratch(spark, "lineruns")
        self.levels: list[list[str]] = [[]]
        self.buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // bucket_rows))

    def _save(self, df: DataFrame) -> str:
        name = f"linerun_{uuid.uuid4().hex}"
        (
            df.select(*KEY, "first")
            .repartition(self.buckets, *KEY)
            .write.bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .option("path", self.scratch.path(name))
            .option("compression", "snappy")
            .saveAsTable(name)
        )
        return name

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Takes the lines (doc_id, h, g) of one batch, whose doc_ids exceed all before."""
        new = lines.groupBy(*KEY).agg(F.min("doc_id").alias("first"))
        for name in self.runs():
            new = new.join(self.spark.table(name).hint("merge"), KEY, "left_anti")
        self.levels[0].append(self._save(new))
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self._compact(level)

    def _compact(self, level: int) -> None:
        names, self.levels[level] = self.levels[level], []
        if level + 1 == len(self.levels):
            self.levels.append([])
        merged = self.all_of(names)
        self.levels[level + 1].append(self._save(merged))
        for name in names:
            self.scratch.drop(self.spark.table(name))
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        if len(self.levels[level + 1]) >= self.fanout:
            self._compact(level + 1)

    def all_of(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for name in names[1:]:
            out = out.unionByName(self.spark.table(name))
        return out

    def seen(self) -> DataFrame:
        """Every key with its first document, read without buckets: a join then shuffles both sides, and AQE splits a hot key."""
        files = [f for name in self.runs() for f in self.spark.table(name).inputFiles()]
        folders = sorted({f.rsplit("/", 1)[0] for f in files})
        return self.spark.read.schema("h long, g long, first long").parquet(*folders) if folders else self.all_of(self.runs())


    def forget(self) -> None:
        """Takes the runs' names out of the catalog; the files stay with the run's other tables."""
        for name in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = [[]]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def keyed_lines(documents: DataFrame, least: int) -> DataFrame:
    """doc_id, t (hash of the text), pos, h, g of the lines that count."""
    lines = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    keyed = fixed(lines, "key", line_key(F.col("line"))).filter(F.length("key") >= least)
    keyed = fixed(keyed, "digest", F.sha2(F.col("key").cast("binary"), 256))
    part = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    return keyed.select("doc_id", "t", "pos", part(1).alias("h"), part(16).alias("g"))


def dedup_lines(documents: DataFrame, least: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``documents`` with text replaced by its kept lines (null if it was null) and n_lines, n_dropped long."""
    spark = documents.sparkSession
    rest = documents.drop("n_lines", "n_dropped")
    scratch = Scratch(spark, "linededup")
    lines = scratch.write(keyed_lines(documents, least), "lines")
    cuts = lines.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("q")).first()["q"] or []
    bounds = [None, *sorted(set(cuts)), None]
    runs = LevelledRuns(spark, fanout, lines.count())
    for low, high in zip(bounds, bounds[1:]):
        batch = lines
        if low is not None:
            batch = batch.filter(F.col("doc_id") > low)
        if high is not None:
            batch = batch.filter(F.col("doc_id") <= high)
        runs.add(batch)
    seen = runs.seen()
    runs.forget()
    late = lines.join(seen.hint("merge"), KEY).filter(F.col("doc_id") > F.col("first"))
    drops = late.groupBy("doc_id", "t").agg(F.collect_set("pos").alias("_drop"))
    joined = rest.withColumn("_t", F.xxhash64("text")).join(drops.withColumnsRenamed({"doc_id": "_id", "t": "_u"}), (F.col("doc_id") == F.col("_id")) & (F.col("_t") == F.col("_u")), "left")
    joined = fixed(joined, "_lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_drop"), lambda i: F.get(F.col("_lines"), i))
    kept = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.select(
        *[kept.alias(c) if c == "text" else F.col(c) for c in rest.columns],
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
