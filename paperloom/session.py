"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "paperloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; partition counts are left to the cluster unless given."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        b = b.config(key, value)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names; a temporary one only on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and go on from the written table.

    Survives the loss of executors, and a loop that calls it keeps a plan of constant size.
    """
    path = new_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Steps:
    """The intermediate tables of one loop.  ``keep`` writes the loop's result, and then all tables before it are deleted."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def cut(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, "step")
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        out = cut_lineage(df)
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []
        return out


def one_row(*frames: DataFrame) -> DataFrame:
    """Single-row results side by side, by a union and one aggregate instead of a join without keys."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def prepare(spark: SparkSession) -> None:
    """Make any session ready for this package: ship the code, keep generated methods small enough to be compiled.

    HotSpot never compiles methods above 8,000 bytes of bytecode; wide projections of regular expressions exceed that
    as one fused method and run several times faster when Spark splits them.
    """
    ship(spark)
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python tasks can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_paperloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "paperloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)
    context._paperloom_shipped = True
