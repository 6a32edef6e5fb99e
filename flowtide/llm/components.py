"""Connected components by alternating large-star and small-star steps on a stored edge table."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowtide.cluster import materialise

_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as (node, least node of its tree); a million edges at a time."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while (up := root.get(x, x)) != top:
            root[x] = top
            x = up
        return top

    def out():
        pairs = np.array([(x, find(x)) for x in root], np.int64).reshape(-1, 2)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_PAIR)

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = find(a), find(b)
            root.setdefault(a, a)
            root.setdefault(b, b)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > 1_000_000:
            yield out()
    if root:
        yield out()


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link the neighbours of each node (the greater ones, or the node and its smaller ones) to the least of them.

    The least neighbours are stored before they are joined, so that the other side, where a hub has as many rows as
    neighbours, can be split.
    """
    if small:
        rows = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:
        rows = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(rows.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
    met = rows.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u"))
    if small:
        out = met.select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        out = out.select("e.a", F.col("e.m").alias("b"))
    else:
        out = met.filter(F.col("b") > F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.filter(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of `edges` (bigint columns), component being the least node it reaches.

    Edges are first reduced to a forest within each partition. Every step is stored, so a lost executor repeats one
    step; the loop ends when a step changes nothing.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter(F.col("a") != F.col("b"))
    now = materialise(pairs.mapInArrow(_forest, "a bigint, b bigint").distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            break
        mark = seen
        now = materialise(_star(materialise(_star(now, small=False)), small=True))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
