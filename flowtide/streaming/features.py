"""All 31 features of host windows from a flow stream, appended when a window closes.

Two stateful steps. Flows are first summed per (window, source, destination, port) by Spark's own windowed aggregation,
which keeps a cell until the watermark has passed its window and then appends it and forgets it; a busy host is spread
over its peers and ports, and what follows sees cells instead of flows. Behind it a keyed state per host remembers when
each peer was first contacted (a map with a time to live in event time) and turns the host's cells into one row per window. All cells
of a window close in one micro-batch, so no window is held open there, and a restart goes on from the checkpoint.

A finite stream ends with windows that no watermark has passed. `closed` adds them from the recorded flows, by the
watermark the stream reached, so that every window is there once.

A peer is new in a window that holds its first contact. The last 12 windows' worth of lateness is waited for; flows that
are later than that are dropped by Spark. The time to live bounds the state: a peer not contacted for `ttl_s` counts as
new again, which a recording shorter than that never shows.
"""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowtide import schema as S
from flowtide.operators.windows import _BOTH_SUMS, _FEATURE_SQL, _PAIR_SUMS

TTL_S = 30 * 86400
ROWS = f"host string, window_start double, {', '.join(f'{f} double' for f in S.FEATURES)}"


def cells(flows: DataFrame, window_s: int, stride_s: int | None = None) -> DataFrame:
    """Sums per (window, source, destination, port), with both ends of each as `host`, `side` and `peer`."""
    pkts = F.col("fwd_pkts") + F.col("bwd_pkts")
    f = flows.withColumns({"pkts": pkts, "bytes": F.col("fwd_bytes") + F.col("bwd_bytes"),
                           "dur": F.col("ts_end") - F.col("ts_start"),
                           "failed": ((F.col("bwd_pkts") <= 0) | (F.col("rst") > 0)).cast("int"),
                           "small": (pkts <= 3).cast("int")})
    span = F.window("event_time", f"{window_s} seconds", f"{stride_s} seconds" if stride_s and stride_s != window_s else None)
    sums = f.groupBy(span.alias("w"), "src_ip", "dst_ip", "dport").agg(
        *[F.expr(f"CAST({e} AS DOUBLE) AS {n}") for n, e in _PAIR_SUMS.items()], F.min("ts_end").alias("first"))
    ends = F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("src_ip").alias("host"), F.col("dst_ip").alias("peer")),
        F.struct(F.lit(1).alias("side"), F.col("dst_ip").alias("host"), F.col("src_ip").alias("peer"))))
    return sums.withColumn("e", ends).select(
        "e.host", "e.side", "e.peer", "dport", F.unix_micros("w.start").alias("start"), "first", *_PAIR_SUMS,
        F.window_time("w").alias("closes"))


def feature_rows(host: str, c: pd.DataFrame, contact: pd.Series) -> pd.DataFrame:
    """One row per window from the cells of a host; `contact` is each cell's first contact with its peer. Sums by place in
    plain arrays: there is one call a host and micro-batch, and tables grouped by name would take most of the time."""
    windows, at = np.unique(c["start"].to_numpy(), return_inverse=True)
    n, sent = len(windows), c["side"].to_numpy() == 0
    values = {k: np.nan_to_num(c[k].to_numpy(dtype=float)) for k in _PAIR_SUMS}
    o, i = ({k: np.bincount(at[m], v[m], n) for k, v in values.items()} for m in (sent, ~sent))
    both = {k: o[k] + i[k] for k in _PAIR_SUMS}
    code = {k: pd.factorize(c[k])[0].astype(np.int64) for k in ("peer", "dport")}      # -1: missing, not counted

    def pairs(of: str, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (window, value) pairs of the rows in `m`: the rows, the place of each row's pair, the pair's window."""
        rows = np.flatnonzero(m & (code[of] >= 0))
        width = code[of].max(initial=0) + 1
        seen, place = np.unique(at[rows] * width + code[of][rows], return_inverse=True)
        return rows, place, seen // width

    def per(of: str, m: np.ndarray) -> np.ndarray:
        return np.bincount(pairs(of, m)[2], minlength=n)

    def share(num: np.ndarray, den: np.ndarray) -> np.ndarray:
        return np.where(den > 0, num / np.where(den > 0, den, 1.0), 0.0)

    rows, place, window = pairs("dport", sent)
    ports = np.bincount(place, values["flows"][rows], len(window))
    nlogn = np.bincount(window, ports * np.log2(ports), n)
    flows = np.where(o["flows"] > 0, o["flows"], 1.0)
    new = sent & (contact.fillna(-np.inf).to_numpy(dtype=float) * 1e6 >= c["start"].to_numpy())
    out = {
        "out_flows": o["flows"], "out_pkts": o["pkts"], "out_bytes": o["bytes"], "out_distinct_dst": per("peer", sent),
        "out_distinct_dport": per("dport", sent), "out_dport_entropy": np.maximum(np.log2(flows) - nlogn / flows, 0.0),
        "out_new_peers": per("peer", new), "out_failed_ratio": share(o["failed"], o["flows"]),
        "out_small_flow_ratio": share(o["small"], o["flows"]), "out_syn_ratio": share(o["syn"], o["flows"]),
        "out_mean_dur": share(o["dur"], o["flows"]), "out_mean_pkt_size": o["bytes"] / np.maximum(o["pkts"], 1.0),
        "out_bwd_fwd_ratio": o["bwd_bytes"] / (o["fwd_bytes"] + 1), "out_tcp_frac": share(o["tcp"], o["flows"]),
        "out_udp_frac": share(o["udp"], o["flows"]), "out_icmp_frac": share(o["icmp"], o["flows"]),
        "out_wellknown_port_frac": share(o["wellknown"], o["flows"]),
        "in_flows": i["flows"], "in_pkts": i["pkts"], "in_bytes": i["bytes"], "in_distinct_src": per("peer", ~sent),
        "in_distinct_dport": per("dport", ~sent), "in_failed_ratio": share(i["failed"], i["flows"]),
        "in_small_flow_ratio": share(i["small"], i["flows"]), "in_syn_ratio": share(i["syn"], i["flows"]),
        "ttl_mean": share(both["ttl_sum"], both["ttl_n"]), "tcp_win_mean": share(both["win_sum"], both["win_n"]),
        "retrans_rate": both["rt_sum"] / np.maximum(both["rt_pkts"], 1.0),
        "ttl_mean_mask": both["ttl_n"] > 0, "tcp_win_mean_mask": both["win_n"] > 0, "retrans_rate_mask": both["rt_n"] > 0,
    }
    return pd.DataFrame({"host": host, "window_start": windows / 1e6, **{k: out[k].astype(float) for k in S.FEATURES}})


class KnownPeers(StatefulProcessor):
    """Per host: when each peer was first and last contacted. A peer that the watermark has left `ttl_s` behind is
    forgotten, by a timer of the host; a host without peers holds no state."""

    def __init__(self, ttl_s: float = TTL_S):
        self.ttl_s = ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "peer string", "first double, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        c = pd.concat(rows, ignore_index=True)
        sent = c[c["side"] == 0].groupby("peer")["first"].agg(["min", "max"])
        first, some = {}, self.known.exists()         # a host seen for the first time has no peer to ask for
        for peer, lo, hi in sent.itertuples():
            old = self.known.getValue((peer,)) if some and self.known.containsKey((peer,)) else (lo, hi)
            first[peer] = min(lo, old[0])
            self.known.updateValue((peer,), (float(first[peer]), float(max(hi, old[1]))))
        if first and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(int((sent["max"].max() + self.ttl_s) * 1000))
        yield feature_rows(key[0], c, c["peer"].map(first))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs() / 1000 - self.ttl_s
        last = [(k[0], v[1]) for k, v in self.known.iterator()]
        for peer, t in last:
            if t <= past:
                self.known.removeKey((peer,))
        left = [t for _, t in last if t > past]
        if left:
            self.handle.registerTimer(int((min(left) + self.ttl_s) * 1000) + 1)
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def stream_features(flows: DataFrame, window_s: int, stride_s: int | None = None, ttl_s: float = TTL_S) -> DataFrame:
    """Rows of host, window_start (epoch seconds) and 31 features of a flow stream that carries `event_time` and a
    watermark; for append output. To be started inside `rocksdb_state`."""
    return cells(flows, window_s, stride_s).groupBy("host").transformWithStateInPandas(
        KnownPeers(ttl_s), ROWS, "Append", "EventTime")


@contextmanager
def rocksdb_state(spark):
    """Streams started inside keep their state in RocksDB, which keyed map states need: on disk, and with only the
    changes in a checkpoint."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def batch_features(flows: DataFrame, window_s: int, stride_s: int | None = None, after: float | None = None) -> DataFrame:
    """The same rows from recorded flows, of the windows that end after `after` only. First contacts are those of the
    whole recording; everything else is read from the last windows."""
    first = flows.groupBy(F.col("src_ip").alias("host"), F.col("dst_ip").alias("peer")).agg(F.min("ts_end").alias("contact"))
    recent = flows if after is None else flows.filter(F.col("ts_end") >= after - window_s)
    timed = recent.withColumn("event_time", F.timestamp_micros((F.col("ts_end") * 1e6).cast("long")))
    c = cells(timed, window_s, stride_s)
    if after is not None:
        c = c.filter(F.col("start") / 1e6 + window_s > after)
    c = c.join(first, ["host", "peer"], "left")
    there = {k: F.col(k).isNotNull().cast("int") for k in ("peer", "dport")}
    pairs = c.groupBy("host", "start", "side", "peer").agg(*[F.sum(k).alias(k) for k in _PAIR_SUMS], F.max("contact").alias("contact"))
    pairs = pairs.select("host", "start", "side", *_PAIR_SUMS, there["peer"].alias("peers"),
                         F.when(F.col("contact") * 1e6 >= F.col("start"), there["peer"]).alias("new"))
    ports = c.groupBy("host", "start", "side", "dport").agg(F.sum("flows").alias("n")).select(
        "host", "start", "side", there["dport"].alias("ports"), (there["dport"] * F.col("n") * F.log2("n")).alias("port_nlogn"))
    sums = {f"{s}_{k}": f"sum(IF(side = {at}, {k}, NULL))" for at, s in enumerate("oi") for k in (*_PAIR_SUMS, "peers", "ports")}
    sums |= {f"p_{k}": f"sum({k})" for k in _BOTH_SUMS}
    sums |= {"o_new": "sum(IF(side = 0, new, NULL))", "o_port_n": "sum(IF(side = 0, flows, NULL))",
             "o_port_nlogn": "sum(IF(side = 0, port_nlogn, NULL))"}
    return (pairs.unionByName(ports, allowMissingColumns=True).groupBy("host", "start")
            .agg(*[F.expr(f"CAST(coalesce({e}, 0) AS DOUBLE) AS {k}") for k, e in sums.items()])
            .selectExpr("host", "start / 1e6D AS window_start", *[f"{_FEATURE_SQL[f]} AS {f}" for f in S.FEATURES]))


def watermark_of(query) -> float | None:
    """The watermark that a stream has reached, in epoch seconds; None if it read nothing."""
    for p in reversed(query.recentProgress):
        mark = dict(p.eventTime or {}).get("watermark")
        if mark:
            return pd.Timestamp(mark).timestamp()
    return None


def closed(appended: DataFrame, flows: DataFrame, watermark: float | None, window_s: int,
           stride_s: int | None = None) -> DataFrame:
    """The appended windows and, from the recorded flows, those that the watermark has not passed. A window that ends
    at or before the watermark has been appended, a later one has not, so none is lost or doubled."""
    if watermark is None:
        return batch_features(flows, window_s, stride_s)
    seen = appended.filter(F.col("window_start") + window_s <= watermark)
    return seen.unionByName(batch_features(flows, window_s, stride_s, watermark))
