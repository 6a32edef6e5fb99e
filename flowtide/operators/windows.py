"""Canonical flows -> one row of 31 features per host and time window.

Plan shape. Every feature is a sum over one of three pre-aggregated tables, so the
raw flows are never grouped by host alone and a hub host cannot pile up in a task:

* pair cells   (src, dst, window)        additive measures of both directions
* port cells   (host, window, side, dport) flow counts
* first contacts (src, dst)              earliest window

Each is combined map-side before its shuffle. Their rows are stacked and reduced by one
`groupBy(host, window)`; there are no joins between feature groups. Idle windows are
filled from the gap to the next active row of the same host, without a grid join.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide import schema as S
from flowtide.cluster import deal, materialise
from flowtide.functions.stages import is_benign, label_to_stage


@dataclass(frozen=True)
class WindowSpec:
    """How to cut flows into host windows.

    `keys` are capture columns that separate independent recordings; `hosts` is an
    explicit selection (a list, or a DataFrame with `keys` + `host`); `t0` fixes the
    origin (a number or a scalar column), otherwise each capture starts at its first
    whole window. `flows_n`, the number of flows where it is known, keeps the rows of a task
    few in large tables.
    """
    window_s: float = S.WINDOW_S
    min_flows: int = 20
    max_hosts: int | None = None
    hosts: Sequence[str] | DataFrame | None = field(default=None, compare=False)
    t0: float | Column | None = None
    densify: bool = True
    gap: int = S.SEGMENT_GAP
    targeted: Sequence[int] = S.TARGETED_STAGES
    keys: tuple[str, ...] = ()
    flows_n: int = 0

    def but(self, **kw) -> "WindowSpec":
        return replace(self, **kw)


LIVE = WindowSpec(min_flows=3)


@dataclass(frozen=True)
class _Settled:
    """A host selection that is already computed."""
    side: DataFrame


# ------------------------------------------------------------------ preparation
def origin(flows: DataFrame, window_s: float) -> Column:
    """Start of the first window, as a scalar subquery usable in any expression."""
    return flows.agg((F.floor(F.min("ts_end") / window_s) * window_s).cast("double")).scalar()


def _anchor(spec: WindowSpec) -> Column:
    if spec.t0 is None:
        return F.lit(0.0)
    return spec.t0 if isinstance(spec.t0, Column) else F.lit(float(spec.t0))


def with_measures(flows: DataFrame, spec: WindowSpec) -> DataFrame:
    """Add the derived per-flow columns; `window` counts from the anchor."""
    pkts = F.col("fwd_pkts") + F.col("bwd_pkts")
    return flows.withColumns({
        "window": F.floor((F.col("ts_end") - _anchor(spec)) / float(spec.window_s)),
        "pkts": pkts,
        "bytes": F.col("fwd_bytes") + F.col("bwd_bytes"),
        "dur": F.col("ts_end") - F.col("ts_start"),
        "failed": ((F.col("bwd_pkts") <= 0) | (F.col("rst") > 0)).cast("int"),
        "small": (pkts <= 3).cast("int"),
    })


def appearances(flows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return (flows.select(*keys, F.explode(F.array("src_ip", "dst_ip")).alias("host"))
            .groupBy(*keys, "host").agg(F.count("*").alias("appearances")))


def select_hosts(flows: DataFrame, min_flows: int = 20, max_hosts: int | None = None,
                 keys: Sequence[str] = ()) -> DataFrame:
    """Hosts by appearances as source or destination; with `max_hosts` the busiest, ties falling to the lower name."""
    busy = appearances(flows, keys).filter(F.col("appearances") >= min_flows)
    if max_hosts is None:
        return busy
    order = [F.col("appearances").desc(), F.col("host")]
    if not keys:
        return busy.orderBy(*order).limit(max_hosts)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return busy.withColumn("_r", rank).filter(F.col("_r") <= max_hosts).drop("_r")


def _chosen_hosts(flows: DataFrame, spec: WindowSpec) -> DataFrame:
    """The selection, computed once: every branch of the plan joins it twice."""
    if isinstance(spec.hosts, _Settled):
        return spec.hosts.side
    if isinstance(spec.hosts, DataFrame):
        return materialise(spec.hosts.select(*spec.keys, "host"))
    chosen = select_hosts(flows, spec.min_flows, spec.max_hosts, spec.keys)
    return materialise(chosen.select(*spec.keys, "host"))


def _mark_selected(w: DataFrame, spec: WindowSpec) -> tuple[DataFrame, bool]:
    """Flag flow ends that belong to a selected host.

    Returns the flagged flows and whether selection is still to be done after the
    aggregation (no host limit means the selection is not small enough to broadcast).
    """
    if spec.hosts is None and spec.max_hosts is None:
        return w.withColumns({"out_sel": F.lit(True), "in_sel": F.lit(True)}), True
    keys = list(spec.keys)
    if spec.hosts is not None and not isinstance(spec.hosts, (DataFrame, _Settled)):
        listed = list(dict.fromkeys(spec.hosts))
        return w.withColumns({"out_sel": F.col("src_ip").isin(listed),
                              "in_sel": F.col("dst_ip").isin(listed)}), False
    side = _chosen_hosts(w, spec)
    for end, flag in (("src_ip", "out_sel"), ("dst_ip", "in_sel")):
        mark = side.select(*keys, F.col("host").alias(end), F.lit(True).alias(flag))
        w = w.join(mark, [*keys, end], "left")
    return (w.withColumns({f: F.coalesce(f, F.lit(False)) for f in ("out_sel", "in_sel")})
            .filter("out_sel OR in_sel"), False)


# ------------------------------------------------------------------ partial tables
# additive measures of a (src, dst, window) cell; as SQL text they reach the JVM in one call
_PAIR_SUMS = {
    "flows": "count(*)", "pkts": "sum(pkts)", "bytes": "sum(bytes)",
    "fwd_bytes": "sum(fwd_bytes)", "bwd_bytes": "sum(bwd_bytes)",
    "failed": "sum(failed)", "small": "sum(small)", "syn": "sum(syn)", "dur": "sum(dur)",
    "tcp": "count_if(proto = 'tcp')", "udp": "count_if(proto = 'udp')",
    "icmp": "count_if(proto = 'icmp')", "wellknown": "count_if(dport < 1024)",
    "ttl_sum": "sum(ttl)", "ttl_n": "count(ttl)",
    "win_sum": "sum(tcp_win)", "win_n": "count(tcp_win)",
    "rt_sum": "sum(retrans)", "rt_n": "count(retrans)",
    "rt_pkts": "sum(CASE WHEN retrans IS NOT NULL THEN fwd_pkts END)",
}


def pair_cells(w: DataFrame, spec: WindowSpec) -> DataFrame:
    return w.groupBy(*spec.keys, "src_ip", "dst_ip", "window", "out_sel", "in_sel").agg(
        *[F.expr(f"{e} AS {n}") for n, e in _PAIR_SUMS.items()])


def _sides(df: DataFrame, spec: WindowSpec, *cols) -> DataFrame:
    """One row per selected end of a flow (or pair): side 0 = source, 1 = destination."""
    ends = F.array(
        F.struct(F.lit(0).alias("side"), F.col("src_ip").alias("host"), F.col("out_sel").alias("on")),
        F.struct(F.lit(1).alias("side"), F.col("dst_ip").alias("host"), F.col("in_sel").alias("on")))
    return (df.select(*spec.keys, "window", *cols, F.explode(ends).alias("_e")).filter("_e.on")
            .select(*spec.keys, "_e.host", "window", "_e.side", *cols))


def port_cells(w: DataFrame, spec: WindowSpec) -> DataFrame:
    return (_sides(w, spec, "dport").groupBy(*spec.keys, "host", "window", "side", "dport")
            .agg(F.count("*").alias("n")))


def first_contacts(w: DataFrame, spec: WindowSpec) -> DataFrame:
    return (w.filter("out_sel").groupBy(*spec.keys, "src_ip", "dst_ip")
            .agg(F.min("window").alias("window")))


def label_cells(w: DataFrame, spec: WindowSpec) -> DataFrame:
    """Attack flows per (host, window, side, stage, label).

    Benign rows leave on one string test; the ordered label rules then run once per
    counted label instead of once per flow.
    """
    cells = (_sides(w.filter(~is_benign(F.col("label"))), spec, "label")
             .groupBy(*spec.keys, "host", "window", "side", "label").agg(F.count("*").alias("n"))
             .withColumn("stage", label_to_stage(F.col("label"))))
    return cells.filter((F.col("side") == 0) | F.col("stage").isin(*spec.targeted))


def _label_totals(w: DataFrame, spec: WindowSpec) -> DataFrame:
    return label_cells(w, spec).groupBy(*spec.keys, "host", "window", "stage", "label").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("side") == 0, F.col("n"))), F.lit(0)).alias("n_out"))


def dominant_labels(w: DataFrame, spec: WindowSpec) -> DataFrame:
    """Most frequent attack label per host window: count desc, stage asc, label asc."""
    return (_label_totals(w, spec).groupBy(*spec.keys, "host", "window")
            .agg(F.min(F.struct((-F.col("n")).alias("neg"), "stage", "label")).alias("_l"))
            .select(*spec.keys, "host", "window", F.col("_l.stage").alias("stage"),
                    F.col("_l.label").alias("label")))


# ------------------------------------------------------------------ feature frame
_PORT_FEATURES = {"out_distinct_dport", "out_dport_entropy", "in_distinct_dport"}
_SCRATCH = {"ports": "int", "port_n": "double", "port_nlogn": "double", "new_peer": "int"}


def _stack(w: DataFrame, spec: WindowSpec, features: Sequence[str]) -> DataFrame:
    """The partial tables that `features` need, under one another."""
    keys = list(spec.keys)
    pairs = _sides(pair_cells(w, spec), spec, *_PAIR_SUMS)
    n = F.col("n").cast("double")
    ports = port_cells(w, spec).select(
        *keys, "host", "window", "side", F.lit(1).alias("ports"), n.alias("port_n"),
        (n * F.log2(n)).alias("port_nlogn"))
    peers = first_contacts(w, spec).select(
        *keys, F.col("src_ip").alias("host"), "window", F.lit(1).alias("new_peer"))
    labels = _label_totals(w, spec).select(
        *keys, "host", "window", F.col("n_out").alias("atk_out"), (F.col("n") - F.col("n_out")).alias("atk_in"),
        F.struct((-F.col("n")).alias("neg"), "stage", "label").alias("lab"))
    stacked = pairs.unionByName(labels, allowMissingColumns=True)
    if _PORT_FEATURES & set(features):
        stacked = stacked.unionByName(ports, allowMissingColumns=True)
    if "out_new_peers" in features:
        stacked = stacked.unionByName(peers, allowMissingColumns=True)
    return stacked.withColumns({c: F.lit(None).cast(t) for c, t in _SCRATCH.items() if c not in stacked.columns})


_OUT_SUMS = ["flows", "pkts", "bytes", "failed", "small", "syn", "dur", "fwd_bytes", "bwd_bytes",
             "tcp", "udp", "icmp", "wellknown", "ports", "port_n", "port_nlogn"]
_IN_SUMS = ["flows", "pkts", "bytes", "failed", "small", "syn", "ports"]
_BOTH_SUMS = ["ttl_sum", "ttl_n", "win_sum", "win_n", "rt_sum", "rt_n", "rt_pkts"]


def _share(num: str, den: str) -> str:
    return f"IF({den} > 0, {num} / {den}, 0.0D)"


# features from the reduced sums; o_ = as source, i_ = as destination, p_ = either
_FEATURE_SQL = {
    "out_flows": "o_flows", "out_pkts": "o_pkts", "out_bytes": "o_bytes",
    "out_distinct_dst": "o_peers", "out_distinct_dport": "o_ports",
    "out_dport_entropy": "IF(o_port_n > 0, greatest(log2(o_port_n) - o_port_nlogn / o_port_n, 0.0D), 0.0D)",
    "out_new_peers": "o_new",
    "out_failed_ratio": _share("o_failed", "o_flows"),
    "out_small_flow_ratio": _share("o_small", "o_flows"),
    "out_syn_ratio": _share("o_syn", "o_flows"),
    "out_mean_dur": _share("o_dur", "o_flows"),
    "out_mean_pkt_size": "o_bytes / greatest(o_pkts, 1.0D)",
    "out_bwd_fwd_ratio": "o_bwd_bytes / (o_fwd_bytes + 1)",
    "out_tcp_frac": _share("o_tcp", "o_flows"), "out_udp_frac": _share("o_udp", "o_flows"),
    "out_icmp_frac": _share("o_icmp", "o_flows"),
    "out_wellknown_port_frac": _share("o_wellknown", "o_flows"),
    "in_flows": "i_flows", "in_pkts": "i_pkts", "in_bytes": "i_bytes",
    "in_distinct_src": "i_peers", "in_distinct_dport": "i_ports",
    "in_failed_ratio": _share("i_failed", "i_flows"),
    "in_small_flow_ratio": _share("i_small", "i_flows"),
    "in_syn_ratio": _share("i_syn", "i_flows"),
    "ttl_mean": _share("p_ttl_sum", "p_ttl_n"),
    "tcp_win_mean": _share("p_win_sum", "p_win_n"),
    "retrans_rate": "p_rt_sum / greatest(p_rt_pkts, 1.0D)",
    "ttl_mean_mask": "IF(p_ttl_n > 0, 1.0D, 0.0D)",
    "tcp_win_mean_mask": "IF(p_win_n > 0, 1.0D, 0.0D)",
    "retrans_rate_mask": "IF(p_rt_n > 0, 1.0D, 0.0D)",
}


def active_features(w: DataFrame, spec: WindowSpec, features: Sequence[str] = S.FEATURES) -> DataFrame:
    """Feature rows of the windows in which a host was seen; only the partial tables of `features` are computed."""
    keys = list(spec.keys)
    sums = {f"o_{c}": f"sum(IF(side = 0, {c}, NULL))" for c in _OUT_SUMS}
    sums |= {f"i_{c}": f"sum(IF(side = 1, {c}, NULL))" for c in _IN_SUMS}
    sums |= {f"p_{c}": f"sum({c})" for c in _BOTH_SUMS}
    sums |= {"o_peers": "count_if(side = 0 AND flows IS NOT NULL)",
             "i_peers": "count_if(side = 1 AND flows IS NOT NULL)",
             "o_new": "sum(new_peer)", "atk_out": "sum(atk_out)", "atk_in": "sum(atk_in)"}
    g = _stack(w, spec, features).groupBy(*keys, "host", "window").agg(
        *[F.expr(f"CAST(coalesce({e}, 0) AS DOUBLE) AS {n}") for n, e in sums.items()],
        F.expr("min(lab) AS lab"))
    return g.selectExpr(
        *keys, "host", "window", "o_flows + i_flows AS _seen", *[f"{_FEATURE_SQL[n]} AS {n}" for n in features],
        "coalesce(lab.label, 'BENIGN') AS label", "coalesce(lab.stage, 0) AS stage",
        "CAST(coalesce(lab.stage, 0) > 0 AND atk_out >= atk_in AND atk_out > 0 AS INT) AS attack_out")


def segments(w: DataFrame, spec: WindowSpec) -> DataFrame:
    """Active windows of all flows with their capture period.

    Rows: one per active window (bounded by time span / window length, not by flows).
    A step of more than `gap` windows opens a new segment.
    """
    keys = list(spec.keys)
    order = Window.partitionBy(*keys).orderBy("window")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    # a descending running frame: the ascending "to the end" frame is quadratic
    onward = (Window.partitionBy(*keys).orderBy(F.desc("window"))
              .rowsBetween(Window.unboundedPreceding, 0))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    opens = F.coalesce(F.col("window") - F.lag("window").over(order) > spec.gap, F.lit(True))
    closes = F.coalesce(F.lead("window").over(order) - F.col("window") > spec.gap, F.lit(True))
    return (w.select(*keys, "window").distinct()
            .withColumns({"_o": opens, "_c": closes})
            .select(*keys, "window",
                    (F.sum(F.col("_o").cast("int")).over(upto) - 1).cast("int").alias("segment"),
                    F.last(F.when(F.col("_o"), F.col("window")), True).over(upto).alias("seg_start"),
                    F.last(F.when(F.col("_c"), F.col("window")), True).over(onward).alias("seg_end"),
                    F.first("window").over(whole).alias("base")))


def fill_gaps(df: DataFrame, part: Sequence[str], start: str, end: str,
              idle: dict[str, str]) -> DataFrame:
    """One row per window from `start` to `end` in each group of `part`.

    Every active row yields itself and the idle windows up to its successor; the first
    also yields the windows before it. One sort per group replaces a grid join. `idle`
    maps columns to the SQL text of their value in an idle window.
    """
    order = f"OVER (PARTITION BY {', '.join(part)} ORDER BY window)"
    wide = df.selectExpr(
        "*", f"IF(lag(window) {order} IS NULL, {start}, window) AS _lo",
        f"coalesce(lead(window) {order} - 1, {end}) AS _hi").selectExpr(
        "*", "explode(sequence(_lo, _hi)) AS _w")
    return wide.selectExpr(*[
        "_w AS window" if c == "window" else f"IF(_w = window, {c}, {idle[c]}) AS {c}" if c in idle else c
        for c in df.columns])


ROWS_A_FLOW = 20      # of a dense frame, when hosts are seen in one of ten windows
IDLE_ROW = {**{f: "0.0D" for f in S.FEATURES}, "label": "'BENIGN'", "stage": "0", "attack_out": "0"}


def host_windows(flows: DataFrame, spec: WindowSpec = WindowSpec(), features: Sequence[str] = S.FEATURES) -> DataFrame:
    """The feature frame: keys, host, segment, window, t, features (all 31 unless named), labels."""
    keys = list(spec.keys)
    w = with_measures(flows, spec)
    marked, late = _mark_selected(w, spec)
    frame = active_features(marked, spec, features).join(F.broadcast(segments(w, spec)), [*keys, "window"])
    frame = deal(frame, *keys, "host", rows=spec.flows_n * ROWS_A_FLOW if spec.densify else 2 * spec.flows_n)
    if late:
        seen = F.sum("_seen").over(Window.partitionBy(*keys, "host"))
        frame = frame.withColumn("_seen", seen).filter(F.col("_seen") >= spec.min_flows)
    frame = frame.drop("_seen")
    if spec.densify:
        idle = {c: v for c, v in IDLE_ROW.items() if c in frame.columns}
        frame = fill_gaps(frame, [*keys, "host", "segment"], "seg_start", "seg_end", idle)
    t = F.col("window").cast("double") * float(spec.window_s) + _anchor(spec)
    window = F.col("window") - F.col("base") if spec.t0 is None else F.col("window")
    return frame.select(*keys, "host", "segment", window.cast("long").alias("window"), t.alias("t"),
                        *features, *S.LABELS)


def host_edges(flows: DataFrame, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """Directed flow counts between selected hosts per window, without self loops."""
    keys = list(spec.keys)
    w = with_measures(flows, spec)
    marked, late = _mark_selected(w, spec)
    pairs = (marked.filter((F.col("src_ip") != F.col("dst_ip")) & F.col("out_sel") & F.col("in_sel"))
             .groupBy(*keys, F.col("src_ip").alias("a"), F.col("dst_ip").alias("b"), "window")
             .agg(F.count("*").alias("flows")))
    if late:
        chosen = select_hosts(flows, spec.min_flows, None, keys).select(*keys, "host")
        for end in ("a", "b"):
            pairs = pairs.join(chosen.withColumnRenamed("host", end), [*keys, end], "left_semi")
    if spec.t0 is None:
        if keys:
            base = w.groupBy(*keys).agg(F.min("window").alias("_base"))
            pairs = pairs.join(F.broadcast(base), keys).withColumn("window", F.col("window") - F.col("_base"))
        else:
            pairs = pairs.withColumn("window", F.col("window") - w.agg(F.min("window")).scalar())
    return pairs.select(*keys, "a", "b", F.col("window").cast("long").alias("window"), "flows")


@dataclass
class HostFeatures:
    """Lazy tables of one analysis: the feature frame, its host graph and its flows."""
    frame: DataFrame
    edges: DataFrame
    flows: DataFrame
    spec: WindowSpec
    source: str = "flows"

    @classmethod
    def from_flows(cls, flows: DataFrame, spec: WindowSpec = WindowSpec(),
                   source: str = "flows", features: Sequence[str] = S.FEATURES) -> "HostFeatures":
        if spec.max_hosts is not None and (spec.hosts is None or isinstance(spec.hosts, DataFrame)):
            fixed = spec.but(hosts=_Settled(_chosen_hosts(flows, spec)))
        else:
            fixed = spec
        return cls(host_windows(flows, fixed, features), host_edges(flows, fixed), flows, spec, source)

    @property
    def keys(self) -> tuple[str, ...]:
        return self.spec.keys
