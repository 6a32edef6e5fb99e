"""Column contracts: the flow table, the host-window table and their constants."""
from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: windowing and evaluation constants of the data model -------
WINDOW_S = 60
HISTORY_L = 10
HORIZON_K = 5
SEGMENT_GAP = 10
TARGETED_STAGES = (1, 2, 3, 4, 5, 6)
ROLE_LOOKBACK = 3
THROTTLE_KEEP_EVERY = 10
FLOW_IDLE_S = 60.0
FLOW_ACTIVE_S = 60.0
LABEL_GRACE_S = 30.0
BLOCK_WINDOWS = 60
SPLIT_CYCLE = ("train", "train", "val", "train", "test")
EPISODE_GAP = 5
ALERT_RUN = 2
N_STAGES = 7

# --- fixed values: feature columns in model order -----------------------------
OUT_FEATURES = [
    "out_flows", "out_pkts", "out_bytes", "out_distinct_dst", "out_distinct_dport",
    "out_dport_entropy", "out_new_peers", "out_failed_ratio", "out_small_flow_ratio",
    "out_syn_ratio", "out_mean_dur", "out_mean_pkt_size", "out_bwd_fwd_ratio",
    "out_tcp_frac", "out_udp_frac", "out_icmp_frac", "out_wellknown_port_frac",
]
IN_FEATURES = [
    "in_flows", "in_pkts", "in_bytes", "in_distinct_src", "in_distinct_dport",
    "in_failed_ratio", "in_small_flow_ratio", "in_syn_ratio",
]
PACKET_FEATURES = ["ttl_mean", "tcp_win_mean", "retrans_rate"]
MASK_FEATURES = ["ttl_mean_mask", "tcp_win_mean_mask", "retrans_rate_mask"]
FEATURES = OUT_FEATURES + IN_FEATURES + PACKET_FEATURES + MASK_FEATURES

# --- fixed values: heavy-tailed features that take log1p before scaling -------
LOG_FEATURES = [
    "out_flows", "out_pkts", "out_bytes", "out_distinct_dst", "out_distinct_dport",
    "out_new_peers", "out_mean_dur", "out_mean_pkt_size", "out_bwd_fwd_ratio",
    "in_flows", "in_pkts", "in_bytes", "in_distinct_src", "in_distinct_dport",
    "ttl_mean", "tcp_win_mean",
]

# --- fixed values: display names of the features ------------------------------
FEATURE_LABELS = {
    "out_flows": "outbound connections",
    "out_pkts": "outbound packets",
    "out_bytes": "outbound bytes",
    "out_distinct_dst": "distinct destinations contacted (fan-out)",
    "out_distinct_dport": "distinct destination ports probed",
    "out_dport_entropy": "destination-port entropy",
    "out_new_peers": "never-before-seen peers",
    "out_failed_ratio": "share of failed/unanswered outbound connections",
    "out_small_flow_ratio": "share of tiny (<=3 packet) outbound flows",
    "out_syn_ratio": "share of outbound flows with SYN",
    "out_mean_dur": "mean outbound flow duration",
    "out_mean_pkt_size": "mean outbound packet size",
    "out_bwd_fwd_ratio": "response/request byte ratio",
    "out_tcp_frac": "TCP share of outbound flows",
    "out_udp_frac": "UDP share of outbound flows",
    "out_icmp_frac": "ICMP share of outbound flows",
    "out_wellknown_port_frac": "share of flows to well-known service ports",
    "in_flows": "inbound connections",
    "in_pkts": "inbound packets",
    "in_bytes": "inbound bytes",
    "in_distinct_src": "distinct inbound sources",
    "in_distinct_dport": "distinct local ports targeted",
    "in_failed_ratio": "share of failed inbound connections",
    "in_small_flow_ratio": "share of tiny inbound flows",
    "in_syn_ratio": "share of inbound flows with SYN",
    "ttl_mean": "mean packet TTL",
    "tcp_win_mean": "mean TCP window size",
    "retrans_rate": "retransmission rate",
    "ttl_mean_mask": "TTL observed",
    "tcp_win_mean_mask": "TCP window observed",
    "retrans_rate_mask": "retransmissions observed",
}

INDEX = ["host", "segment", "window", "t"]
LABELS = ["label", "stage", "attack_out"]

FLOW_SCHEMA = T.StructType([
    T.StructField("flow_id", T.LongType()),
    T.StructField("ts_start", T.DoubleType()),
    T.StructField("ts_end", T.DoubleType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("sport", T.LongType()),
    T.StructField("dport", T.LongType()),
    T.StructField("proto", T.StringType()),
    T.StructField("fwd_pkts", T.DoubleType()),
    T.StructField("bwd_pkts", T.DoubleType()),
    T.StructField("fwd_bytes", T.DoubleType()),
    T.StructField("bwd_bytes", T.DoubleType()),
    T.StructField("syn", T.ByteType()),
    T.StructField("rst", T.ByteType()),
    T.StructField("fin", T.ByteType()),
    T.StructField("ttl", T.DoubleType()),
    T.StructField("tcp_win", T.DoubleType()),
    T.StructField("retrans", T.DoubleType()),
    T.StructField("label", T.StringType()),
])
FLOW_COLUMNS = [f.name for f in FLOW_SCHEMA if f.name != "flow_id"]

PACKET_SCHEMA = T.StructType([
    T.StructField("ts", T.DoubleType()),
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
    T.StructField("sport", T.LongType()),
    T.StructField("dport", T.LongType()),
    T.StructField("proto", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("ttl", T.DoubleType()),
    T.StructField("flags", T.StringType()),
    T.StructField("win", T.DoubleType()),
    T.StructField("seq", T.LongType()),
    T.StructField("plen", T.LongType()),
    T.StructField("frag", T.BooleanType()),
])
