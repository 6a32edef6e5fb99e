"""Session defaults and reliable materialisation."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def session(app: str = "flowtide", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the plans are written for; `conf` overrides."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k: str(v) for k, v in conf.items()},
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the one the cluster names in `spark.checkpoint.dir`.
    Only a local session without one gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="flowtide-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` once to shared storage and read it back.

    Several branches then read one computed copy, each only the columns it needs; the
    planner sees the table's real size; and a lost executor costs a re-read, not a re-run.
    Tables live under `<shared folder>/flowtide-<application id>` until that is removed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/flowtide-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df` to be joined by sort and merge. Columns of few or repeated values take almost no room in a file, so the
    planner, which judges by file sizes, would send millions of rows through the driver as a broadcast."""
    return df.hint("merge")


def apart(c: Column) -> Column:
    """`c` itself, by way of a function on arrays, which keeps the projection it stands in out of the one method that Spark
    otherwise makes of a whole stage. With thirty computed columns that method is over the 8,000 bytes up to which the JVM
    compiles at all, and every row of the stage goes through its interpreter."""
    return F.get(F.transform(F.array(c), lambda x: x), F.lit(0))


ROWS_A_TASK = 500_000


def deal(df: DataFrame, *by: str, rows: int = 0) -> DataFrame:
    """`df` dealt by columns to as many tasks as the session has shuffle partitions, and to more where a task would get
    over `ROWS_A_TASK` of its `rows`. Adaptive execution would merge them by their compressed bytes, and of rows that are
    mostly zeros one task would then get tens of millions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // ROWS_A_TASK)), *by)
