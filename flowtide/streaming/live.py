"""Live operation: flow buffer, ticks, containment and replay of recorded flows."""
from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from flowtide import schema as S
from flowtide.operators.counterfactual import BLOCKING, FULL, THROTTLES, affected
from flowtide.operators.ranking import global_rank
from flowtide.operators.windows import LIVE, HostFeatures


def with_event_time(flows: DataFrame, window_s: float = S.WINDOW_S, history: int = S.HISTORY_L) -> DataFrame:
    """Event time of a flow stream; flows later than the buffer span are dropped by the
    stateful operators behind it."""
    span = int((history + 2) * window_s)
    return (flows.withColumn("event_time", F.timestamp_micros((F.col("ts_end") * 1e6).cast("long")))
            .withWatermark("event_time", f"{span} seconds"))


def buffer(flows: DataFrame, now: float, window_s: float = S.WINDOW_S, history: int = S.HISTORY_L) -> DataFrame:
    """The flows a live view keeps at `now`."""
    return flows.filter(F.col("ts_end") >= now - (history + 2) * window_s)


def tick(flows: DataFrame, now: float, window_s: float = S.WINDOW_S, history: int = S.HISTORY_L) -> HostFeatures:
    """Host features of the buffer, with windows anchored so that the last ends at `now`."""
    t0 = now - (history + 1) * window_s
    seen = buffer(flows, now, window_s, history).filter(F.col("ts_end") >= t0)
    return HostFeatures.from_flows(seen, LIVE.but(window_s=window_s, t0=t0), "live")


def sliding_features(flows: DataFrame, window_s: int = 60, stride_s: int = 15) -> DataFrame:
    """Streaming host features in sliding event-time windows.

    One stateful aggregation over both directions. Distinct counts are HyperLogLog
    estimates; `run_ticks` is the exact path.
    """
    ends = F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("src_ip").alias("host"), F.col("dst_ip").alias("peer")),
        F.struct(F.lit(1).alias("side"), F.col("dst_ip").alias("host"), F.col("src_ip").alias("peer"))))
    f = flows.withColumns({
        "pkts": F.col("fwd_pkts") + F.col("bwd_pkts"), "bytes": F.col("fwd_bytes") + F.col("bwd_bytes"),
        "failed": ((F.col("bwd_pkts") <= 0) | (F.col("rst") > 0)).cast("double"), "_e": ends})
    f = f.withColumn("small", (F.col("pkts") <= 3).cast("double"))
    span = F.window("event_time", f"{window_s} seconds", f"{stride_s} seconds" if stride_s != window_s else None)

    def on(side: int, c: str) -> Column:
        return F.when(F.col("_e.side") == side, F.col(c))

    aggs = []
    for side, p, peers in ((0, "out", "out_distinct_dst"), (1, "in", "in_distinct_src")):
        aggs += [F.count_if(F.col("_e.side") == side).alias(f"{p}_flows"),
                 F.coalesce(F.sum(on(side, "pkts")), F.lit(0.0)).alias(f"{p}_pkts"),
                 F.coalesce(F.sum(on(side, "bytes")), F.lit(0.0)).alias(f"{p}_bytes"),
                 F.approx_count_distinct(on(side, "_e.peer")).alias(peers),
                 F.approx_count_distinct(on(side, "dport")).alias(f"{p}_distinct_dport"),
                 F.coalesce(F.avg(on(side, "failed")), F.lit(0.0)).alias(f"{p}_failed_ratio"),
                 F.coalesce(F.avg(on(side, "small")), F.lit(0.0)).alias(f"{p}_small_flow_ratio")]
    return (f.groupBy(span.alias("w"), F.col("_e.host").alias("host")).agg(*aggs)
            .select("host", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *[c for c in ("out_flows", "out_pkts", "out_bytes", "out_distinct_dst", "out_distinct_dport",
                                  "out_failed_ratio", "out_small_flow_ratio", "in_flows", "in_pkts", "in_bytes",
                                  "in_distinct_src", "in_distinct_dport", "in_failed_ratio",
                                  "in_small_flow_ratio")]))


def edge_counts(flows: DataFrame) -> DataFrame:
    """Running (src, dst) flow counts; write with update or complete output. Every pair stays in the state: for streams
    of few hosts. `run_edges` forgets closed windows."""
    return flows.groupBy("src_ip", "dst_ip").agg(F.count("*").alias("flows"))


def run_edges(stream: DataFrame, store: str, checkpoint: str, window_s: int = 3600, late_s: int = 600, **trigger):
    """Directed flow counts of a stream with bounded state: counts of one window are held until the watermark has passed
    its end, then appended to `store` and forgotten. A replayed batch overwrites its own folder."""
    timed = stream.withColumn("event_time", F.timestamp_micros((F.col("ts_end") * 1e6).cast("long")))
    counts = (timed.withWatermark("event_time", f"{late_s} seconds")
              .groupBy(F.window("event_time", f"{window_s} seconds").alias("w"), "src_ip", "dst_ip")
              .agg(F.count("*").alias("flows"))
              .select("src_ip", "dst_ip", F.col("w.start").alias("window_start"), "flows"))

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{store}/epoch={epoch}")

    return (counts.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "15 seconds"})).start())


def stored_edges(spark: SparkSession, store: str, since: float | None = None) -> DataFrame:
    """(src, dst) flow counts over the closed windows in a store of `run_edges`, from the window at `since` on."""
    rows = spark.read.schema("src_ip string, dst_ip string, window_start timestamp, flows long, epoch long").parquet(store)
    if since is not None:
        rows = rows.filter(F.col("window_start") >= F.timestamp_seconds(F.lit(float(since))))
    return rows.groupBy("src_ip", "dst_ip").agg(F.sum("flows").alias("flows"))


def _hours(spark: SparkSession, store: str, first: int, last: int) -> DataFrame:
    """The rows of a flow store in some hours; no other folder is listed."""
    return (spark.read.schema(S.FLOW_SCHEMA).option("basePath", store)
            .parquet(f"{store}/hour={{{','.join(map(str, range(first, last + 1)))}}}").select(*S.FLOW_SCHEMA.names))


def retire(spark: SparkSession, store: str, before: float) -> list[int]:
    """Delete the hours of a flow store that end by `before` (seconds); the deleted hours."""
    root = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [str(f.getPath().getName()) for f in fs.listStatus(root)] if fs.exists(root) else []
    hours = sorted(int(n[5:]) for n in names if re.fullmatch(r"hour=-?[0-9]+", n))
    old = [h for h in hours if (h + 1) * 3600 <= before]
    for h in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/hour={h}"), True)
    return old


def run_ticks(stream: DataFrame, store: str, on_tick: Callable[[HostFeatures, int], None], checkpoint: str,
              window_s: float = S.WINDOW_S, history: int = S.HISTORY_L, keep_s: float | None = None, **trigger):
    """Exact live loop: append every micro-batch to a flow store and analyse its tail.

    The store is partitioned by hour, then by batch, so a tick lists and reads only the hours of its buffer, however
    long the loop has run. A replayed batch overwrites its own folders, so a restart neither loses nor doubles flows.
    With `keep_s`, hours older than that, and than the buffer, are deleted after the tick. `on_tick` sees a batch again
    when the batch is replayed: it should write by the batch's number. A batch without times makes no tick.
    """
    span = (history + 2) * window_s

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        df = df.select(*S.FLOW_SCHEMA.names).persist()
        try:
            now = df.agg(F.max("ts_end")).first()[0]
            if now is None:
                return
            (df.withColumns({"hour": F.floor(F.col("ts_end") / 3600), "batch": F.lit(epoch)}).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("hour", "batch").parquet(store))
        finally:
            df.unpersist()
        recent = _hours(spark, store, int((now - span) // 3600), int(now // 3600))
        on_tick(tick(recent, now, window_s, history), epoch)
        if keep_s is not None:
            retire(spark, store, now - max(keep_s, span))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"processingTime": "15 seconds"})).start()


def risk_history(points: DataFrame, keep: int = 240) -> DataFrame:
    """The latest `keep` risk points of every host."""
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("t")))
    return points.withColumn("_r", rank).filter(F.col("_r") <= keep).drop("_r")


def top_live_hosts(points: DataFrame, peaks: DataFrame, threshold: float, window_s: float = S.WINDOW_S,
                   n: int = 12) -> DataFrame:
    """The hosts with the highest peaks, their last risk before and after mitigation, lead time."""
    from flowtide.operators.alerts import live_lead

    top = peaks.orderBy(F.desc("peak"), "host").limit(n)
    last = points.join(F.broadcast(top.select("host")), "host", "left_semi").groupBy("host").agg(
        F.max_by(F.struct("risk_before", "risk_after", "future"), "t").alias("p"))
    return top.join(last, "host", "left").select(
        "host", "peak", F.col("p.risk_before").alias("risk_before"), F.col("p.risk_after").alias("risk_after"),
        live_lead(F.col("p.future"), threshold, window_s).alias("lead_time_s"))


# ------------------------------------------------------------------ containment
def _in_force(now: float) -> Column:
    """Applied and not expired; a rehearsal decision expires `ttl_s` after it was made."""
    expires = F.when(F.col("mode") == "safe_rehearsal", F.col("at") + F.coalesce("ttl_s", F.lit(300))).otherwise(
        F.col("expires_at"))
    return F.col("applied") & (expires.isNull() | (F.lit(float(now)) < expires))


def contained_sources(actions: DataFrame, now: float) -> DataFrame:
    """Targets under an applied full block. Rows: kind, target, ttl_s, at, applied, expires_at, mode."""
    return (actions.filter(_in_force(now) & F.col("kind").isin(*FULL) & F.col("target").isNotNull())
            .select(F.col("target").alias("host")).distinct())


def containment_spread(flows: DataFrame, actions: DataFrame, now: float) -> DataFrame:
    """host, neutralised: every host an action in force touches, and hosts that receive more
    than half of their flows from a contained source."""
    live = actions.filter(_in_force(now))
    hits = live.select("target", "kind").filter("target IS NOT NULL")
    blocking = F.col("kind").isin(*BLOCKING)
    named = live.select(F.explode(F.array_compact(F.concat(
        F.array("target", "peer"), F.coalesce("peers", F.array().cast("array<string>"))))).alias("host"),
        blocking.alias("b"))
    pairs = flows.groupBy("src_ip", "dst_ip").agg(F.count("*").alias("n"))
    by_src = pairs.join(hits, pairs["src_ip"] == hits["target"]).select(F.col("dst_ip").alias("host"), blocking.alias("b"))
    by_dst = pairs.join(hits, pairs["dst_ip"] == hits["target"]).select(F.col("src_ip").alias("host"), blocking.alias("b"))
    src = contained_sources(actions, now).select(F.col("host").alias("src_ip"), F.lit(True).alias("_c"))
    # the half rule holds per contained source
    inbound = F.sum("n").over(Window.partitionBy("dst_ip"))
    flooded = (pairs.withColumn("_in", inbound).join(src, "src_ip")
               .filter(F.col("n") / F.col("_in") > 0.5).select(F.col("dst_ip").alias("host"), F.lit(True).alias("b")))
    return (named.unionByName(by_src).unionByName(by_dst).unionByName(flooded)
            .groupBy("host").agg(F.bool_or("b").alias("neutralised")))


def filter_batch(flows: DataFrame, actions: Sequence[dict], exact_throttle: bool = True) -> DataFrame:
    """Drop the rows of one micro-batch that approved actions stop.

    `actions` are dicts with an `at` time. Throttles keep one row in ten: by position in
    the batch, or by hash of the flow (no sort, usable on the stream itself).
    """
    for a in actions:
        if a["kind"] == "monitor":
            continue
        hit = affected(a) & (F.col("ts_end") >= a["at"])
        if a["kind"] not in THROTTLES:
            flows = flows.filter(~hit)
        elif exact_throttle:
            kept = global_rank(flows.filter(hit), [F.col("ts_end"), F.col("flow_id")], "_rank")
            flows = flows.filter(~hit).unionByName(
                kept.filter((F.col("_rank") - 1) % S.THROTTLE_KEEP_EVERY == 0).drop("_rank"))
        else:
            flows = flows.filter(~hit | (F.pmod(F.xxhash64("flow_id"), F.lit(S.THROTTLE_KEEP_EVERY)) == 0))
    return flows


# ------------------------------------------------------------------ replay
def shifted(flows: DataFrame, start: float) -> DataFrame:
    """A recorded flow table moved so that its first flow starts at `start`."""
    first = flows.agg(F.min("ts_start")).scalar()
    return flows.withColumns({c: F.col(c) - first + float(start) for c in ("ts_start", "ts_end")})


def replay_stream(spark, path: str, start: float, recorded_start: float, files_per_batch: int = 1) -> DataFrame:
    """Recorded Parquet flows as a stream, shifted to `start`."""
    s = spark.readStream.schema(S.FLOW_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    move = float(start) - float(recorded_start)
    return s.withColumns({c: F.col(c) + move for c in ("ts_start", "ts_end")})
