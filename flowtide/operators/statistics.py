"""Dataset statistics and typical feature values."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from flowtide import schema as S
from flowtide.functions.stages import label_to_stage, stage_name
from flowtide.operators.ranking import quantiles


def capture_summary(flows: DataFrame, frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per capture: flows, attack flows, hosts, windows and attack windows.

    Hosts are counted from (capture, host) cells, so one big capture is not one task.
    """
    keys = list(keys)
    per_label = flows.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    attack = F.when(label_to_stage(F.col("label")) > 0, F.col("n")).otherwise(0)
    f = per_label.groupBy(*keys).agg(F.sum("n").alias("flows"), F.sum(attack).alias("attack_flows"))
    cells = frame.groupBy(*keys, "host").agg(
        F.count("*").alias("n"), F.count_if(F.col("stage") > 0).alias("a"))
    w = cells.groupBy(*keys).agg(F.count("*").alias("hosts"), F.sum("n").alias("windows"),
                                 F.sum("a").alias("attack_windows"))
    return f.join(w, keys, "left")


def top_labels(flows: DataFrame, keys: Sequence[str], n: int = 12) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("flows"), "label"))
    return (flows.groupBy(*keys, "label").agg(F.count("*").alias("flows"))
            .withColumn("rank", rank).filter(F.col("rank") <= n))


def stage_windows(frame: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    return (frame.groupBy(*keys, "stage").agg(F.count("*").alias("windows"))
            .withColumn("stage_name", stage_name(F.col("stage"))))


def typical(frame: DataFrame) -> DataFrame:
    """Exact median of every feature over rows with traffic: feature, typical."""
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"))
                               for f in S.FEATURES]))
    act = (frame.filter((F.col("out_flows") + F.col("in_flows")) > 0)
           .select(long.alias("x")).select("x.*"))
    return quantiles(act, "value", [0.5], ["feature"]).select(
        "feature", F.round("quantile", 4).alias("typical"))
