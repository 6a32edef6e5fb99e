"""Packet rows: already decoded packets in tables, CSV exports or streams."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowtide.schema import PACKET_SCHEMA


def conform(df: DataFrame) -> DataFrame:
    """Cast to the packet schema; absent columns become NULL."""
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType))
                       .alias(f.name) for f in PACKET_SCHEMA])


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return conform(spark.read.options(**options).format(fmt).load(path))


def stream_packets(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.schema(PACKET_SCHEMA).options(**options).format(fmt).load(path)
