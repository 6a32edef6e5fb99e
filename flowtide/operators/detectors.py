"""Threshold detectors that work on flows alone, without a model."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Authentication ports in the order they are tried, with service names.
AUTH_PORTS = [(22, "SSH"), (21, "FTP"), (3389, "RDP"), (23, "Telnet")]


def _windowed(flows: DataFrame, window_s: float, t0: Column | None) -> DataFrame:
    first = flows.agg(F.min("ts_start")).scalar() if t0 is None else t0
    return flows.withColumn("window", F.floor((F.col("ts_start") - first) / window_s))


def detect_scans(flows: DataFrame, window_s: float = 60, min_dst: int = 15, min_ports: int = 15,
                 burst: int = 8, t0: Column | None = None) -> DataFrame:
    """Sources with wide fan-out over hosts and ports; onset at the first burst window.

    Distinct counts come from de-duplicated (src, window, dst) and (src, dport) cells,
    which spread a busy source over many tasks before anything is counted per source.
    """
    w = _windowed(flows, window_s, t0)
    cells = w.groupBy("src_ip", "window", "dst_ip").agg(F.count("*").alias("n"))
    per_window = cells.groupBy("src_ip", "window").agg(F.count("*").alias("dsts"))
    when = per_window.groupBy("src_ip").agg(
        F.min(F.when(F.col("dsts") >= burst, F.col("window"))).alias("burst_window"))
    dsts = cells.groupBy("src_ip", "dst_ip").agg(F.sum("n").alias("n"))
    wide = dsts.groupBy("src_ip").agg(F.count("*").alias("distinct_dst"), F.min(
        F.struct((-F.col("n")).alias("neg"), "dst_ip"))["dst_ip"].alias("top_dst"))
    ports = (w.groupBy("src_ip", "dport").agg(F.min(F.struct("ts_start", "flow_id", "window")).alias("f"))
             .groupBy("src_ip").agg(F.count("*").alias("distinct_dport"),
                                    F.min("f")["window"].alias("first_window")))
    return (wide.filter(F.col("distinct_dst") >= min_dst)
            .join(ports.filter(F.col("distinct_dport") >= min_ports), "src_ip")
            .join(when, "src_ip")
            .select(F.col("src_ip").alias("src"), F.concat(
                F.substring_index("top_dst", ".", 3), F.lit(".0/24")).alias("dst"),
                "distinct_dst", "distinct_dport",
                F.coalesce("burst_window", "first_window").alias("onset_window")))


def detect_brute_force(flows: DataFrame, window_s: float = 60, min_flows: int = 40,
                       min_share: float = 0.35, burst: int = 15, t0: Column | None = None) -> DataFrame:
    """Pairs whose traffic concentrates on one authentication port; first matching port only."""
    w = _windowed(flows, window_s, t0)
    auth = F.col("dport").isin([p for p, _ in AUTH_PORTS])
    cells = (w.groupBy("src_ip", "dst_ip", F.when(auth, F.col("dport")).alias("port"), "window")
             .agg(F.count("*").alias("n"), F.min(F.struct("ts_start", "flow_id", "window")).alias("f")))
    per_port = cells.groupBy("src_ip", "dst_ip", "port").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("n") >= burst, F.col("window"))).alias("burst_window"),
        F.min("f")["window"].alias("first_window"))
    total = F.sum("n").over(Window.partitionBy("src_ip", "dst_ip"))
    order = F.element_at(F.create_map(*[F.lit(x) for i, (p, _) in enumerate(AUTH_PORTS) for x in (p, i)]),
                         F.col("port").cast("int"))
    service = F.element_at(F.create_map(*[F.lit(x) for p, s in AUTH_PORTS for x in (p, s)]),
                           F.col("port").cast("int"))
    first = F.row_number().over(Window.partitionBy("src_ip", "dst_ip").orderBy("_o"))
    return (per_port.withColumn("total", total).filter(F.col("port").isNotNull())
            .filter((F.col("n") >= min_flows) & (F.col("n") >= F.col("total") * min_share))
            .withColumn("_o", order).withColumn("_r", first).filter("_r = 1")
            .select(F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), "port",
                    service.alias("service"), F.col("n").alias("auth_flows"), "total",
                    F.coalesce("burst_window", "first_window").alias("onset_window")))


def campaigns(scans: DataFrame, brutes: DataFrame, window_s: float = 60, n: int = 4) -> DataFrame:
    """The earliest detected campaigns with alert step, onset and lead time."""
    rows = (scans.select(F.lit("Network service scan").alias("name"), F.lit(1).alias("stage"),
                         "src", "dst", "onset_window")
            .unionByName(brutes.select(F.concat("service", F.lit(" brute force")).alias("name"),
                                       F.lit(2).alias("stage"), "src", "dst", "onset_window")))
    onset = F.greatest(F.lit(2), F.col("onset_window"))
    alert = F.greatest(F.lit(1), onset - 2)
    onset = F.greatest(alert + 1, onset)
    return (rows.select("name", "stage", "src", "dst", alert.alias("alert_step"), onset.alias("onset_step"),
                        ((onset - alert) * window_s).cast("long").alias("lead_s"))
            .orderBy("alert_step", "src", "stage", "dst").limit(n))


def window_count(flows: DataFrame, window_s: float = 60, lo: int = 12, hi: int = 40) -> DataFrame:
    """Number of windows a console shows: last window + 2, clamped."""
    span = F.floor((F.max("ts_start") - F.min("ts_start")) / window_s)
    return flows.agg(F.greatest(F.lit(lo), F.least(F.lit(hi), span + 2)).cast("int").alias("n_windows"))
