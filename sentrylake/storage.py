"""Written tables of a run: they cut lineage, are computed once, and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Only a local master, whose executors see its disk, gets a folder of its own."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(context, "_sentrylake_work", None):
        context._sentrylake_work = tempfile.mkdtemp(prefix="sentrylake-")
        atexit.register(shutil.rmtree, context._sentrylake_work, ignore_errors=True)
        context.setCheckpointDir(context._sentrylake_work)
    return f"file://{context._sentrylake_work}"


class Scratch:
    """Tables of one run under the shared folder; they stay until that folder is cleared."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.made = spark, f"{work_dir(spark)}/sentrylake/{label}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "snappy").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Remove the files behind a table that ``write`` returned."""
        jvm = self.spark.sparkContext._jvm
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
