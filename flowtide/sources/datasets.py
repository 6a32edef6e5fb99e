"""Datasets of many captures: build, store, load; schedules and decision logs."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from flowtide.cluster import materialise
from flowtide.operators.windows import HostFeatures, WindowSpec
from flowtide.sources.flows import Files, load_flows

KEYS = ("dataset", "capture")


def build_dataset(flows: DataFrame, name: str, spec: WindowSpec = WindowSpec()) -> HostFeatures:
    """Window every capture of a dataset on its own, in one job.

    `flows` carries `capture`; it becomes part of every grouping key, so a capture is not
    a loop iteration and one large capture still spreads over the cluster.
    """
    tagged = flows.withColumn("dataset", F.lit(name))
    return HostFeatures.from_flows(tagged, spec.but(keys=KEYS), name)


def write_dataset(features: HostFeatures, root: str, mode: str = "overwrite") -> None:
    """Windows and edges as Parquet, partitioned by dataset and capture."""
    for part, df in (("windows", features.frame), ("edges", features.edges)):
        df.write.mode(mode).partitionBy(*KEYS).parquet(f"{root}/{part}")


def load_windows(spark: SparkSession, root: str, datasets: Sequence[str] | None = None,
                 part: str = "windows") -> DataFrame:
    """Stored windows (or edges) of the named datasets; only their folders are read."""
    df = spark.read.parquet(f"{root}/{part}")
    return df.filter(F.col("dataset").isin(*datasets)) if datasets else df


# ------------------------------------------------------------------ builds that read only what changed
_LEDGER = "capture string, file string, bytes long, modified timestamp, digest string, version int"


def _named(root: str, part: str, name: str) -> str:
    return f"{root}/{part}/dataset={name}"


def _ledger(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The files of the last finished build, a row each; no rows before the first."""
    try:
        every = spark.read.schema(f"{_LEDGER}, build int").parquet(_named(root, "ledger", name))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{_LEDGER}, build int")
    return every.filter(F.col("build") == every.agg(F.max("build")).scalar())


def _digests(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """file, digest: a file's lines by number and by two sums of their hashes. The order of lines does not matter to
    any result, and a file of any size is read in splits."""
    def total(*salt: Column) -> Column:
        return F.sum(F.xxhash64(*salt, "value").cast("decimal(38,0)")).cast("string")

    return (spark.read.text(list(files)).groupBy(F.col("_metadata.file_path").alias("file"))
            .agg(F.concat_ws(":", F.count("*"), total(), total(F.lit(1))).alias("digest")))


def build_changed(spark: SparkSession, path: str, root: str, name: str, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """Bring the stored windows and edges of a dataset up to the files under `path`; a capture is a file.

    A ledger names the files of the last build. A file of the same size and time is not opened; one that was only
    touched is hashed, not windowed; new and changed ones are windowed alone. Their rows go to folders of a new version,
    and the ledger, written last, says which version of each capture counts: a build that fails leaves what was there,
    and its version is written anew by the next. A file that is gone leaves the ledger, and so does its capture.
    Returns capture, file and status: same, touched, changed, new or gone. The driver learns names of files, no rows.

    Defined results: a capture's name follows from all files under `path`, so one that is renamed by a new neighbour is
    built anew; an empty file has a row in the ledger and no windows.
    """
    listed = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_modification_time").alias("modified"))
    captures = Files([], spark.read.text(path).inputFiles()).capture("file")
    old = materialise(_ledger(spark, root, name))
    was = old.select("capture", "file", *[F.col(c).alias(f"_{c}") for c in ("bytes", "modified", "digest", "version")])
    beside = materialise(listed.withColumn("capture", captures).join(was, ["capture", "file"], "full_outer"))
    opened = beside.filter(F.col("bytes").isNotNull() & ~(
        F.col("bytes").eqNullSafe(F.col("_bytes")) & F.col("modified").eqNullSafe(F.col("_modified"))))
    names = [r["file"] for r in opened.select("file").collect()]
    digests = _digests(spark, names) if names else spark.createDataFrame([], "file string, digest string")
    status = (F.when(F.col("bytes").isNull(), "gone").when(F.col("_version").isNull(), "new")
              .when(F.col("_opened").isNull(), "same")
              .when(F.coalesce("digest", F.lit("")) == F.col("_digest"), "touched").otherwise("changed"))
    beside = materialise(
        beside.join(opened.select("capture", "file", F.lit(True).alias("_opened")), ["capture", "file"], "left")
        .join(digests, "file", "left").withColumn("status", status))
    build = (old.agg(F.max("build")).first()[0] or 0) + 1
    todo = [r["file"] for r in beside.filter(F.col("status").isin("new", "changed") & (F.col("bytes") > 0)).select("file").collect()]
    if todo:
        flows = load_flows(spark, path, todo)[0]
        features = build_dataset(flows, name, spec)
        for part, df in (("windows", features.frame), ("edges", features.edges)):
            (df.drop("dataset").withColumn("version", F.lit(build)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("version", "capture").parquet(_named(root, part, name)))
    fresh = F.col("status").isin("new", "changed")
    kept = beside.filter("status <> 'gone'").select(
        "capture", "file", "bytes", "modified",
        F.when(F.col("_opened").isNull(), F.col("_digest")).otherwise(F.coalesce("digest", F.lit(""))).alias("digest"),
        F.when(fresh, build).otherwise(F.col("_version")).alias("version"))
    if not beside.filter("status <> 'same'").isEmpty():
        kept.write.mode("overwrite").parquet(f"{_named(root, 'ledger', name)}/build={build}")
    return beside.select("capture", "file", "status")


def load_built(spark: SparkSession, root: str, name: str, part: str = "windows") -> DataFrame:
    """The windows (or edges) that the ledger of `build_changed` names; folders of other versions are pruned."""
    stored = _named(root, part, name)
    seen = spark.read.parquet(stored).schema
    text = ", ".join(f"`{f.name}` {'string' if f.name == 'capture' else f.dataType.simpleString()}" for f in seen)
    live = _ledger(spark, root, name).select("capture", "version")      # a row a capture
    rows = spark.read.schema(text).parquet(stored).join(live, ["capture", "version"], "left_semi")
    return rows.select(F.lit(name).alias("dataset"), *[c for c in rows.columns if c != "version"])


def load_schedule(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines label schedule with the entry's position (a schedule file is short and
    written in time order; the position is its rank by line order)."""
    raw = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    doc = F.from_json("value", "label string, attacker string, targets array<string>, start double, end double")
    rows = raw.filter(F.trim("value") != "").select("_at", doc.alias("d")).select("_at", "d.*")
    return rows.withColumn("entry_no", F.row_number().over(Window.orderBy("_at"))).drop("_at")


def write_audit(decisions: DataFrame, path: str) -> None:
    """Decision log as CSV: host, choice, action, kind, applied, message, at."""
    decisions.select("host", "choice", F.col("action_label").alias("action"), "kind", "applied", "message",
                     "at").write.mode("overwrite").option("header", True).csv(path)
