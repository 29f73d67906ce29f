"""Session helpers: a local session, the shared folder, and written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([REPO, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    builder = SparkSession.builder.master(f"local[{cpus}]").config(
        map={
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.sql.session.timeZone": "UTC",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.driver.host": "127.0.0.1",
            "spark.sql.adaptive.enabled": "true",
        }
        | conf
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, whatever folder the driver was started in."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where it is unset and all runs on one machine, as in tests, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(spark.sparkContext, "_cairn_shared", None)
        if base is None:
            base = spark.sparkContext._cairn_shared = "file://" + tempfile.mkdtemp(prefix="cairn-")
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cairn-{name}-{uuid.uuid4().hex}"


def reread(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """An intermediate table; ``drop_written`` finds its folder."""
    out = spark.read.schema(schema).parquet(path)
    out._cairn_path = path
    return out


def written(df: DataFrame, name: str, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return reread(spark, df.schema, path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete files or folders through Hadoop's file system, so any store works."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_written(*frames: DataFrame) -> None:
    """Delete the tables that ``written`` or ``reread`` returned, once nothing reads them any more."""
    for df in frames:
        drop(df.sparkSession, df._cairn_path)
