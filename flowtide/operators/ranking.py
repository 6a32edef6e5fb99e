"""Exact order statistics without a single-task sort.

`running_sums` sorts by range partitions, sums inside each partition and adds the
totals of the partitions before it. One hot group or one hot value spreads over as
many partitions as its rows need, and nothing but one row per partition and group
meets in one place.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide.cluster import materialise


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column],
                 group: Sequence[str] = ()) -> DataFrame:
    """Add inclusive running totals `sums` in `order` within `group`.

    `order` must be total up to rows that may swap freely.
    """
    group = list(group)
    names = list(sums)
    df = df.withColumns({f"_v_{n}": c for n, c in sums.items()})
    # the sorted copy is written once: its partition numbers must not change between uses
    placed = materialise(
        df.repartitionByRange(*[F.col(g) for g in group], *order)
          .sortWithinPartitions(*[F.col(g) for g in group], *order)
          .withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    totals = placed.groupBy(*group, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_b_{n}") for n in names])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_part", *[
        F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in names])
    inside = (Window.partitionBy(*group, "_part").orderBy("_at")
              .rowsBetween(Window.unboundedPreceding, 0))
    local = placed.withColumns({f"_v_{n}": F.sum(f"_v_{n}").over(inside) for n in names})
    joined = local.join(offsets, [*group, "_part"])
    return joined.withColumns({n: F.col(f"_v_{n}") + F.col(f"_b_{n}") for n in names}).drop(
        "_at", "_part", *[f"_v_{n}" for n in names], *[f"_b_{n}" for n in names])


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank",
                group: Sequence[str] = ()) -> DataFrame:
    """1-based position of every row in `order`."""
    return running_sums(df, order, {name: F.lit(1).cast("long")}, group)


def quantiles(df: DataFrame, value: str, probs: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles per group: group columns, `prob`, `quantile`.

    Equal values are counted before the sort, so the sort sees distinct values only.
    """
    group = list(group)
    counted = (df.filter(F.col(value).isNotNull()).groupBy(*group, value)
               .agg(F.count("*").alias("_n")))
    cum = running_sums(counted, [F.col(value)], {"_c": F.col("_n")}, group)
    size = cum.groupBy(*group).agg(F.max("_c").alias("_size"))
    spots = (size.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
             .withColumn("_h", (F.col("_size") - 1) * F.col("prob"))
             .withColumns({"_lo": F.floor("_h"), "_hi": F.ceil("_h")}))
    # which value holds 0-based position i: the one with _c - _n <= i < _c
    want = spots.groupBy(*group).agg(F.collect_set("_lo").alias("_l"), F.collect_set("_hi").alias("_u"))
    want = want.select(*group, F.array_union("_l", "_u").alias("_want"))
    holds = F.filter("_want", lambda i: (i >= F.col("_c") - F.col("_n")) & (i < F.col("_c")))
    at = (_attach(cum, want, group)
          .select(*group, value, F.explode(holds).alias("_i")))
    lo = at.select(*group, F.col("_i").alias("_lo"), F.col(value).alias("_vlo"))
    hi = at.select(*group, F.col("_i").alias("_hi"), F.col(value).alias("_vhi"))
    out = spots.join(lo, [*group, "_lo"]).join(hi, [*group, "_hi"])
    step = (F.col("_vhi") - F.col("_vlo")) * (F.col("_h") - F.col("_lo"))
    return out.select(*group, "prob", (F.col("_vlo") + step).cast("double").alias("quantile"))


BINS = 512


def column_quantiles(df: DataFrame, columns: dict[str, Column], probs: Sequence[float],
                     group: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """Exact linear-interpolation quantiles of many double columns at once: group columns, `feature`, `prob`,
    `quantile`. Nulls are left out; a column without values in a group has no rows.

    No value is sorted or shuffled. A bracket is a range of values that holds wanted positions, first the whole range of
    a column. Each pass over `df` counts the values of every bracket in `bins` equal parts, with the least and greatest
    value of each part; the counts are combined before they are shuffled, so a group of any size sends `bins` rows a
    bracket and task. Parts that hold wanted positions are the next brackets, and one whose least value is its greatest
    is settled. The least and the greatest value of a bracket have parts of their own, so every pass narrows it, infinite
    ends included. The driver learns one thing a pass: whether brackets are left.
    """
    group = list(group)
    df = materialise(df.select(*group, *[c.cast("double").alias(f"_q{i}") for i, c in enumerate(columns.values())]))
    names = {f"_q{i}": n for i, n in enumerate(columns)}
    ends = df.groupBy(*group).agg(F.array(*[F.struct(
        F.lit(n).alias("feature"), F.min(c).alias("low"), F.max(c).alias("high"), F.count(c).alias("n"))
        for c, n in names.items()]).alias("e")).select(*group, F.explode("e").alias("e")).select(*group, "e.*").filter("n > 0")
    spots = F.array_distinct(F.flatten(F.array(*[F.array(
        F.floor((F.col("n") - 1) * float(p)), F.ceil((F.col("n") - 1) * float(p))) for p in probs])))
    ends = materialise(ends.withColumns({"before": F.lit(0).cast("long"), "wanted": spots}))
    todo, settled = ends, []
    while True:
        done = todo.filter("low = high").select(*group, "feature", F.explode("wanted").alias("at"), F.col("low").alias("value"))
        settled.append(done)
        todo = todo.filter("low < high")
        if todo.isEmpty():
            break
        todo = _narrowed(df, names, todo, group, bins)
    found = reduce(DataFrame.unionByName, settled).groupBy(*group, "feature").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("_v"))
    h = (F.col("n") - 1) * F.col("prob")
    low, high = F.col("_v")[F.floor(h)], F.col("_v")[F.ceil(h)]
    return (ends.select(*group, "feature", "n").join(found, [*group, "feature"])
            .withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
            .select(*group, "feature", "prob", (low + (high - low) * (h - F.floor(h))).alias("quantile")))


def _narrowed(df: DataFrame, names: dict[str, str], brackets: DataFrame, group: list[str], bins: int) -> DataFrame:
    """The parts of `brackets` that hold wanted positions, as brackets of their own."""
    by_feature = brackets.groupBy(*group, "feature").agg(F.collect_list(F.struct("low", "high")).alias("_b"))
    packed = by_feature.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("feature", "_b"))).alias("_m"))
    rows = df.join(F.broadcast(packed), group) if group else df.withColumn("_m", packed.scalar())

    def placed(c: str, n: str) -> Column:       # the brackets of a column are disjoint
        v = F.col(c)
        b = F.get(F.filter(F.element_at("_m", n), lambda b: (b["low"] <= v) & (v <= b["high"])), F.lit(0))
        return F.struct(F.lit(n).alias("feature"), v.alias("v"), b.alias("b"))

    one = F.filter(F.array(*[placed(c, n) for c, n in names.items()]), lambda x: x["b"].isNotNull())
    share = F.nanvl((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")), F.lit(0.0))
    part = (F.when(F.col("v") == F.col("low"), 0).when(F.col("v") == F.col("high"), bins - 1)
            .otherwise(F.greatest(F.lit(1), F.least(F.floor(share * bins), F.lit(bins - 2)))))
    counted = (rows.select(*group, F.explode(one).alias("x"))
               .select(*group, "x.feature", "x.v", "x.b.low", "x.b.high")
               .groupBy(*group, "feature", "low", part.alias("_part"))
               .agg(F.count("*").alias("n"), F.min("v").alias("_least"), F.max("v").alias("_most")))
    up_to = Window.partitionBy(*group, "feature", "low").orderBy("_part")
    counted = counted.withColumn("_to", F.sum("n").over(up_to)).join(
        brackets.select(*group, "feature", "low", "before", "wanted"), [*group, "feature", "low"])
    # in names of their own: a lambda would read an alias of the same select before the column it shadows
    counted = counted.withColumn("_from", F.col("before") + F.col("_to") - F.col("n"))
    counted = counted.withColumn("_held", F.filter("wanted", lambda i: (i >= F.col("_from")) & (i < F.col("_from") + F.col("n"))))
    return materialise(counted.filter(F.size("_held") > 0).select(
        *group, "feature", F.col("_least").alias("low"), F.col("_most").alias("high"), "n",
        F.col("_from").alias("before"), F.col("_held").alias("wanted")))


def _attach(df: DataFrame, one_per_group: DataFrame, group: list[str]) -> DataFrame:
    """Join one row per group; without groups it is a single row, read as a scalar."""
    if group:
        return df.join(one_per_group, group)
    (name,) = one_per_group.columns
    return df.withColumn(name, one_per_group.scalar())
