"""Contiguous shards of equal bytes from global prefix sums.

Rows are range-partitioned by id with nothing but their sizes; each partition writes its own running sums, and
partition totals (a row for each partition) give every partition its base. A row goes to the shard in which the middle
of its bytes falls, so shards are contiguous in id order and differ from the equal share by at most one row at each end.

Defined results: a null text has no bytes and counts 1; a null id sorts first; rows with equal ids are ordered by
size and checksum, and rows that agree in all three are interchangeable; an empty table gives no rows; a table with
fewer rows than shards leaves shards empty. Other columns are not carried.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from flowtide.cluster import materialise


def sized(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, size (UTF-8 bytes plus 1) and CRC-32 of every text."""
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(id_col), (F.octet_length(content) + F.lit(1)).cast("long").alias("size"),
                       F.crc32(content).alias("text_crc32"))


def prefix_sums(rows: DataFrame, order: list[str], amount: str) -> DataFrame:
    """Add `before_rows` and `before`, the count and the sum of `amount` over all rows that sort earlier.

    The ordered copy is stored once, as its partition numbers must not change between its two readers.
    """
    placed = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("_p_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_p_part", F.shiftright("_p_at", 33))
    totals = placed.groupBy("_p_part").agg(F.count("*").alias("_p_n"), F.sum(amount).alias("_p_sum"))
    earlier = Window.orderBy("_p_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_p_part", F.coalesce(F.sum("_p_n").over(earlier), F.lit(0)).alias("_p_n"),
                          F.coalesce(F.sum("_p_sum").over(earlier), F.lit(0)).alias("_p_sum"))
    inside = Window.partitionBy("_p_part").orderBy("_p_at").rowsBetween(Window.unboundedPreceding, -1)
    return (placed.withColumn("before_rows", F.row_number().over(Window.partitionBy("_p_part").orderBy("_p_at")) - 1)
            .withColumn("before", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
            .join(F.broadcast(bases), "_p_part")        # one row a partition of the sort
            .withColumn("before_rows", F.col("before_rows") + F.col("_p_n"))
            .withColumn("before", F.col("before") + F.col("_p_sum"))
            .drop("_p_at", "_p_part", "_p_n", "_p_sum"))


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, size, text_crc32, shard (0 to shards - 1) and slot (0, 1, ... within the shard)."""
    placed = prefix_sums(sized(docs, id_col, text), [id_col, "size", "text_crc32"], "size")
    end = placed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_p_total"))
    cut = (placed.crossJoin(F.broadcast(end))           # one row
           .withColumn("shard", F.expr(f"least({shards - 1}L, ((2 * before + size) * {shards}L) div (2 * _p_total))")
                       .cast("int"))
           .drop("_p_total"))
    first = cut.groupBy("shard").agg(F.min("before_rows").alias("_p_first"))
    return (cut.join(F.broadcast(first), "shard")       # one row a shard
            .withColumn("slot", (F.col("before_rows") - F.col("_p_first")).cast("long"))
            .select(id_col, "size", "text_crc32", "shard", "slot"))

