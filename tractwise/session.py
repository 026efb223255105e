"""Session settings for local runs, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "tractwise", memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return _own_dir(context.applicationId)


@cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"tractwise-{application}-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, not yet existing path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write a frame that several later branches read to the shared folder, and read it back.

    The next plan starts from files of known size, so it stays small however many rounds came
    before it, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "settled")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def release(*settled: DataFrame) -> None:
    """Delete settled frames that no later plan reads, and let Spark drop the shuffles behind them.

    Shuffle files stay until the driver's garbage collector finds their plans gone, which can take
    long on a driver with little garbage, so it is asked to run.
    """
    for df in settled:
        path = df.__dict__.pop("_settled_path", None)
        if path:
            jvm, spark = df.sparkSession._jvm, df.sparkSession
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if settled:
        settled[0].sparkSession._jvm.System.gc()
