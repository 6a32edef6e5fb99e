"""Packets -> bidirectional flows with idle and active timeouts, in batch and as a stream.

A flow ends after `idle` seconds of silence and is cut when a packet comes more than
`active` seconds after its first. The active cut depends on where the current flow began,
so it is a chain along time. In batch the chain is resolved without ever holding a whole
conversation in one task:

1. packets are grouped by conversation and time chunk; gaps to the packet before (in the
   chunk or at the end of the previous one) give the idle sessions;
2. sessions no longer than `active` are flows. For the longer ones every chunk reports, as
   a step function, with which flow start it would leave for any flow start it enters with;
3. these small step functions are chained per session, which tells every chunk the flow
   start it enters with, and from there its own cuts.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowtide import schema as S
from flowtide.cluster import materialise
from flowtide.sources.flows import finalise

CHUNK_S = 600


def _keyed(packets: DataFrame, tick_s: float | None = None) -> DataFrame:
    """Direction-free conversation key, microsecond time and a stable tie-break."""
    a = F.struct(F.col("src").alias("ip"), F.col("sport").alias("port"))
    b = F.struct(F.col("dst").alias("ip"), F.col("dport").alias("port"))
    lo, hi = F.least(a, b), F.greatest(a, b)
    us = F.round(F.col("ts") * 1e6).cast("long")
    parts = [lo["ip"], lo["port"], hi["ip"], hi["port"], F.col("proto")]
    if tick_s:      # a flush of all active flows at every tick makes the tick part of the key
        parts.append(F.floor(us / int(tick_s * 1e6)))
    tie = F.col("packet_id") if "packet_id" in packets.columns else F.xxhash64(*packets.columns)
    return packets.withColumns({
        "key": F.concat_ws("|", *[p.cast("string") for p in parts]), "us": us, "_tie": tie, "from_lo": a == lo,
        "lo_ip": lo["ip"], "lo_port": lo["port"], "hi_ip": hi["ip"], "hi_port": hi["port"]})


def _sessions(p: DataFrame, idle_us: int) -> DataFrame:
    """Add `session`: time of the first packet since the last idle gap."""
    inside = Window.partitionBy("key", "chunk").orderBy("us", "_tie")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("key").orderBy("chunk")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    ends = p.groupBy("key", "chunk").agg(F.max("us").alias("_end"))
    ends = ends.select("key", "chunk", F.lag("_end").over(across).alias("_before"))
    q = p.withColumn("_prev", F.lag("us").over(inside)).join(ends, ["key", "chunk"])
    prev = F.coalesce("_prev", "_before")
    q = q.withColumn("_open", F.when(prev.isNull() | (F.col("us") - prev > idle_us), F.col("us")))
    carry = (q.groupBy("key", "chunk").agg(F.max("_open").alias("_last"))
             .select("key", "chunk", F.last("_last", True).over(before).alias("_carry")))
    q = q.withColumn("_here", F.last("_open", True).over(upto)).join(carry, ["key", "chunk"])
    return q.withColumn("session", F.coalesce("_here", "_carry")).drop("_prev", "_before", "_open", "_here", "_carry")


def _chain(t: np.ndarray, first: int, active_us: int) -> list[int]:
    """Flow starts from index `first` on: each the first packet later than the last by more
    than `active`."""
    out, i = [], first
    while i < len(t):
        out.append(int(t[i]))
        i = int(np.searchsorted(t, t[i] + active_us, side="right"))
    return out


def _steps(pdf: pd.DataFrame, active_us: int, session_start: int) -> pd.DataFrame:
    """Step function of a chunk: entering with a flow start below `upto_us` leaves with `exit_us`."""
    t = np.sort(pdf["us"].to_numpy())
    nxt = np.searchsorted(t, t + active_us, side="right")
    leave = np.where(nxt < len(t), nxt, np.arange(len(t)))
    while True:                                  # pointer doubling to the last start in the chunk
        jumped = leave[leave]
        if (jumped == leave).all():
            break
        leave = jumped
    if t[0] == session_start:
        rows = [(np.iinfo(np.int64).max, int(t[leave[0]]))]
    else:
        n = int(np.searchsorted(t, pdf["edge"].iloc[0] + active_us, side="right"))
        rows = []
        for e in range(min(n + 1, len(t))):
            bound, out = int(t[e]) - active_us, int(t[leave[e]])
            if rows and rows[-1][1] == out:
                rows[-1] = (bound, out)
            else:
                rows.append((bound, out))
    head = pdf.iloc[0]
    return pd.DataFrame([(head["key"], head["session"], head["chunk"], *r) for r in rows],
                        columns=["key", "session", "chunk", "upto_us", "exit_us"])


def _enter(pdf: pd.DataFrame) -> pd.DataFrame:
    """Chain the chunks of one session: the flow start each chunk is entered with."""
    out, cur = [], -1
    for chunk, steps in pdf.sort_values(["chunk", "upto_us"]).groupby("chunk"):
        out.append((pdf["key"].iloc[0], pdf["session"].iloc[0], chunk, cur))
        hit = steps[steps["upto_us"] > cur]
        if len(hit):
            cur = int(hit["exit_us"].iloc[0])
    return pd.DataFrame(out, columns=["key", "session", "chunk", "enter_us"])


def _long_starts(long: DataFrame, active_us: int, chunk_us: int) -> DataFrame:
    """Flow starts per (key, session, chunk) of sessions longer than the active timeout."""
    times = materialise(long.select("key", "session", "chunk", "us").distinct())

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        return _steps(pdf.assign(edge=pdf["chunk"] * chunk_us), active_us, int(pdf["session"].iloc[0]))

    fns = times.groupBy("key", "session", "chunk").applyInPandas(
        steps, "key string, session long, chunk long, upto_us long, exit_us long")
    entered = fns.groupBy("key", "session").applyInPandas(
        _enter, "key string, session long, chunk long, enter_us long")

    def cuts(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["us"].to_numpy())
        head = pdf.iloc[0]
        enter = int(head["enter_us"])
        first = 0 if enter < 0 else int(np.searchsorted(t, enter + active_us, side="right"))
        starts = ([] if enter < 0 else [enter]) + _chain(t, first, active_us)
        return pd.DataFrame([(head["key"], head["session"], head["chunk"], starts)],
                            columns=["key", "session", "chunk", "starts"])

    return (times.join(entered, ["key", "session", "chunk"]).groupBy("key", "session", "chunk")
            .applyInPandas(cuts, "key string, session long, chunk long, starts array<long>"))


def assign_flows(packets: DataFrame, idle_s: float = S.FLOW_IDLE_S, active_s: float = S.FLOW_ACTIVE_S,
                 tick_s: float | None = None, chunk_s: int = CHUNK_S) -> DataFrame:
    """Add `key` and `flow_start` (microseconds) to every packet."""
    chunk_us, idle_us, active_us = int(chunk_s * 1e6), int(idle_s * 1e6), int(active_s * 1e6)
    p = _keyed(packets, tick_s).withColumn("chunk", F.floor(F.col("us") / chunk_us))
    p = _sessions(p, idle_us)
    session = Window.partitionBy("key", "session")
    cells = (p.groupBy("key", "session", "chunk").agg(F.min("us").alias("_lo"), F.max("us").alias("_hi"))
             .select("key", "session", "chunk",
                     (F.max("_hi").over(session) - F.min("_lo").over(session) > active_us).alias("long")))
    p = p.join(cells, ["key", "session", "chunk"])
    starts = _long_starts(p.filter("long"), active_us, chunk_us)
    p = p.join(starts, ["key", "session", "chunk"], "left")
    cut = F.array_max(F.filter("starts", lambda s: s <= F.col("us")))
    return p.withColumn("flow_start", F.when(F.col("long"), cut).otherwise(F.col("session"))).drop(
        "starts", "long", "session", "chunk")


def _flow_row(fwd_lo: Column) -> dict[str, Column]:
    """Flow columns from sums kept per endpoint, oriented by the first packet."""
    def ab(name: str) -> tuple[Column, Column]:
        lo, hi = F.col(f"lo_{name}"), F.col(f"hi_{name}")
        return F.when(fwd_lo, lo).otherwise(hi), F.when(fwd_lo, hi).otherwise(lo)

    (src, dst), (sport, dport) = ab("ip"), ab("port")
    (fp, bp), (fb, bb) = ab("pkts"), ab("bytes")
    ttl, ttl_n, win, win_n = (ab(n)[0] for n in ("ttl", "ttl_n", "win", "win_n"))
    tcp = F.col("proto") == "tcp"
    return {"src_ip": src, "dst_ip": dst, "sport": sport, "dport": dport, "proto": F.col("proto"),
            "fwd_pkts": fp, "bwd_pkts": bp, "fwd_bytes": fb, "bwd_bytes": bb,
            "syn": F.col("syn"), "rst": F.col("rst"), "fin": F.col("fin"),
            "ttl": F.when(ttl_n > 0, ttl / ttl_n), "tcp_win": F.when(win_n > 0, win / win_n),
            "retrans": F.when(tcp, F.col("repeats").cast("double")), "label": F.lit("")}


def packets_to_flows(packets: DataFrame, idle_s: float = S.FLOW_IDLE_S, active_s: float = S.FLOW_ACTIVE_S,
                     tick_s: float | None = None, chunk_s: int = CHUNK_S) -> DataFrame:
    """Canonical flows of a packet table."""
    p = assign_flows(packets, idle_s, active_s, tick_s, chunk_s)
    tcp = F.col("proto") == "tcp"
    side = {"lo": F.col("from_lo"), "hi": ~F.col("from_lo")}
    per_side = [e.alias(f"{s}_{n}") for s, on in side.items() for n, e in {
        "pkts": F.count_if(on), "bytes": F.coalesce(F.sum(F.when(on, F.col("size"))), F.lit(0)),
        "ttl": F.sum(F.when(on, F.col("ttl"))), "ttl_n": F.count(F.when(on, F.col("ttl"))),
        "win": F.sum(F.when(on, F.col("win"))), "win_n": F.count(F.when(on, F.col("win")))}.items()]
    flag = lambda f: F.max((tcp & F.coalesce(F.col("flags").contains(f), F.lit(False))).cast("int"))
    data = tcp & (F.col("plen") > 0) & F.col("seq").isNotNull()
    g = p.groupBy("key", "flow_start", "proto", "lo_ip", "lo_port", "hi_ip", "hi_port").agg(
        F.min(F.struct("us", "_tie", "from_lo"))["from_lo"].alias("fwd_lo"), F.max("us").alias("_last"),
        *per_side, flag("S").alias("syn"), flag("R").alias("rst"), flag("F").alias("fin"),
        (F.count_if(data) - F.count_distinct(F.when(data, F.struct("from_lo", "seq")))).alias("repeats"))
    rows = g.select((F.col("flow_start") / 1e6).alias("ts_start"), (F.col("_last") / 1e6).alias("ts_end"),
                    *[c.alias(n) for n, c in _flow_row(F.col("fwd_lo")).items()])
    return finalise(rows)


# ------------------------------------------------------------------ streaming
_STATE = ("first long, last long, src string, dst string, sport long, dport long, proto string, fp long, bp long, "
          "fb long, bb long, syn int, rst int, fin int, ttl double, ttl_n long, win double, win_n long, rt long, "
          "seen array<string>")
_OUT = ("ts_start double, ts_end double, src_ip string, dst_ip string, sport long, dport long, proto string, "
        "fwd_pkts double, bwd_pkts double, fwd_bytes double, bwd_bytes double, syn int, rst int, fin int, "
        "ttl double, tcp_win double, retrans double, label string")
_OUT_NAMES = [f.strip().split()[0] for f in _OUT.split(",")]


_SUMS = ["fp", "bp", "fb", "bb", "ttl", "ttl_n", "win", "win_n", "rt"]


def _cut(t: np.ndarray, idle_us: int, active_us: int, first: int | None, last: int | None) -> np.ndarray:
    """Number of the flow of each ordered time; flow 0 goes on from the open one, if there is one."""
    pauses = np.flatnonzero(np.diff(t) > idle_us) + 1
    out, number, at = np.zeros(len(t), np.int64), 0, 0
    begin = t[0] if first is None else first
    if first is not None and (t[0] - last > idle_us or t[0] - first > active_us):
        number, begin = 1, t[0]
    while at < len(t):
        pause = np.searchsorted(pauses, at, side="right")
        silent = pauses[pause] if pause < len(pauses) else len(t)
        stop = min(int(silent), int(np.searchsorted(t, begin + active_us, side="right")))
        out[at:stop] = number
        at, number = stop, number + 1
        begin = t[at] if at < len(t) else begin
    return out


def _partial(rows: pd.DataFrame, number: np.ndarray, held: pd.Series | None) -> pd.DataFrame:
    """State columns of each numbered flow: sums over its packets, and over what the open flow had before."""
    g = rows.reset_index(drop=True).assign(n=number)
    head = g.groupby("n")[["us", "src", "dst", "sport", "dport", "proto"]].first().rename(columns={"us": "first"})
    if held is not None:
        kept = held[["first", "src", "dst", "sport", "dport", "proto"]]
        head = pd.concat([pd.DataFrame([kept.tolist()], columns=kept.index, index=[0]), head[head.index > 0]])
    lead = head.reindex(g["n"])
    fwd = (g["src"].to_numpy() == lead["src"].to_numpy()) & (g["sport"].to_numpy() == lead["sport"].to_numpy())
    tcp = (g["proto"] == "tcp").to_numpy()
    flags = g["flags"].fillna("")
    ttl, win = g["ttl"].where(fwd), g["win"].where(fwd)
    each = pd.DataFrame({
        "n": number, "last": g["us"], "fp": fwd * 1, "bp": ~fwd * 1, "fb": g["size"] * fwd, "bb": g["size"] * ~fwd,
        **{name: (tcp & flags.str.contains(mark)).astype(int) for name, mark in (("syn", "S"), ("rst", "R"), ("fin", "F"))},
        "ttl": ttl.fillna(0.0), "ttl_n": ttl.notna() * 1, "win": win.fillna(0.0), "win_n": win.notna() * 1})
    data = tcp & (g["plen"] > 0).to_numpy() & (g["seq"] >= 0).to_numpy()
    token = pd.DataFrame({"n": number, "token": np.where(fwd, "1:", "0:") + g["seq"].astype(str)})[data]
    before = pd.DataFrame({"n": 0, "token": list(held["seen"]) if held is not None else []})
    tokens = pd.concat([before, token])
    again = tokens.duplicated().to_numpy()
    each["rt"] = 0
    each.loc[token.index, "rt"] = again[len(before):] * 1
    sums = each.groupby("n").agg({"last": "max", "syn": "max", "rst": "max", "fin": "max"} | {c: "sum" for c in _SUMS})
    if held is not None:
        was = pd.DataFrame([held[sums.columns.tolist()].tolist()], columns=sums.columns, index=[0])
        both = pd.concat([was, sums])
        sums = both.groupby(level=0).agg({"last": "max", "syn": "max", "rst": "max", "fin": "max"} | {c: "sum" for c in _SUMS})
    seen = tokens[~again].groupby("n")["token"].agg(list).reindex(sums.index)
    return head.join(sums).assign(seen=[v if isinstance(v, list) else [] for v in seen])


def _flow_rows(f: pd.DataFrame) -> pd.DataFrame:
    """Finished flows of state columns, in the columns of the output."""
    mean = lambda total, n: (f[total] / f[n].where(f[n] > 0)).astype(float)
    return pd.DataFrame({
        "ts_start": f["first"] / 1e6, "ts_end": f["last"] / 1e6, "src_ip": f["src"], "dst_ip": f["dst"], "sport": f["sport"],
        "dport": f["dport"], "proto": f["proto"], "fwd_pkts": f["fp"].astype(float), "bwd_pkts": f["bp"].astype(float),
        "fwd_bytes": f["fb"].astype(float), "bwd_bytes": f["bb"].astype(float), "syn": f["syn"], "rst": f["rst"], "fin": f["fin"],
        "ttl": mean("ttl", "ttl_n"), "tcp_win": mean("win", "win_n"),
        "retrans": f["rt"].astype(float).where(f["proto"] == "tcp"), "label": ""})[_OUT_NAMES]


def stream_flows(packets: DataFrame, idle_s: float = S.FLOW_IDLE_S, active_s: float = S.FLOW_ACTIVE_S,
                 delay: str = "10 seconds", flush_active: bool = False) -> DataFrame:
    """Flows of a packet stream, emitted when they end.

    State is one open flow per conversation; its repeated-segment memory is bounded by the
    active timeout. An event-time timer closes a flow no later packet can extend.
    `flush_active` emits whatever is open at the end of every micro-batch.
    """
    idle_us, active_us = int(idle_s * 1e6), int(active_s * 1e6)
    names = [c.strip().split()[0] for c in _STATE.split(", ")]
    p = _keyed(packets).select(
        "key", "us", "_tie", "src", "dst", "sport", "dport", "proto", "size", "ttl", "flags", "win",
        F.coalesce("seq", F.lit(-1)).alias("seq"), F.coalesce("plen", F.lit(0)).alias("plen"),
        F.timestamp_micros("us").alias("event_time")).withWatermark("event_time", delay)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.Series(list(state.get), index=names, dtype=object) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield _flow_rows(held.to_frame().T.astype({c: float for c in _SUMS}))
            return
        rows = pd.concat(list(batches)).sort_values(["us", "_tie"])
        ends = (None, None) if held is None else (held["first"], held["last"])
        number = _cut(rows["us"].to_numpy(), idle_us, active_us, *ends)
        found = _partial(rows, number, held).sort_index()
        done, open_ = (found, None) if flush_active else (found.iloc[:-1], found.iloc[-1])
        if open_ is not None:
            state.update(tuple(v.item() if hasattr(v, "item") else v for v in open_[names]))
            due = min(open_["last"] + idle_us, open_["first"] + active_us) // 1000 + 1
            state.setTimeoutTimestamp(int(max(due, state.getCurrentWatermarkMs() + 1)))
        elif state.exists:
            state.remove()
        yield _flow_rows(done)

    return p.groupBy("key").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
