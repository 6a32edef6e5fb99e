"""Adapters from other event tables to the canonical flow table."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowtide.functions.parsing import ntz_micros
from flowtide.schema import FLOW_SCHEMA


def flows_from_events(events: DataFrame) -> DataFrame:
    """Deterministic flow rows from an `events` table, one flow per event."""
    k = F.get_json_object("props", "$.k").cast("int")
    t = ntz_micros(F.col("ts").cast("timestamp_ntz")) / F.lit(1e6)
    tcp = ~F.col("event_type").isin("purchase", "signup")
    error = F.col("event_type") == "error"
    cols = {
        "flow_id": F.col("event_id"),
        "ts_start": t,
        "ts_end": t + F.col("value"),
        "src_ip": F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 256), F.lit("."),
                           F.col("user_id") % 256),
        "dst_ip": F.concat(F.lit("10.0.0."), (F.col("user_id") * 7 + k) % 150),
        "sport": 1024 + F.col("event_id") % 50000,
        "dport": k * 41,
        "proto": F.when(F.col("event_type") == "purchase", "udp")
                  .when(F.col("event_type") == "signup", "icmp").otherwise("tcp"),
        "fwd_pkts": 1 + k % 7,
        "bwd_pkts": F.when(error, 0).otherwise(k % 5),
        "fwd_bytes": F.floor(F.col("value") * 100),
        "bwd_bytes": k * 10,
        "syn": (tcp & (k % 2 == 0)).cast("int"),
        "rst": (k % 11 == 0).cast("int"),
        "fin": (k % 3 == 0).cast("int"),
        "ttl": F.when(k % 3 == 0, 32 + k),
        "tcp_win": F.when(k % 4 == 0, 1024 * (k + 1)),
        "retrans": F.when(k % 5 == 0, k % 2),
        "label": F.when(~error | (k >= 80), "BENIGN").when(k < 20, "PortScan")
                  .when(k < 40, "SSH-Patator").when(k < 50, "Infiltration")
                  .when(k < 60, "Bot").when(k < 70, "Exfiltration").otherwise("DoS slowloris"),
    }
    return events.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in FLOW_SCHEMA])
