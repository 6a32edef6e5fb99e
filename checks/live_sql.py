"""DuckDB SQL for the live views: the buffer's host windows at one moment, risk histories and the board."""
from __future__ import annotations

from checks.sqlparts import THR, part, r, stage_case
from flowtide import schema as S

part("q_lnow", "SELECT max(ts_end) - 3 * 86400.0 AS now, max(ts_end) - 3 * 86400.0 - 11 * 3600.0 AS t0 FROM q_flows WHERE label <> 'BENIGN'")
part("q_lcut", f"""
SELECT f.*, CAST(floor((ts_end - t0) / 3600.0) AS BIGINT) AS w, fwd_pkts + bwd_pkts AS pkts, fwd_bytes + bwd_bytes AS bytes, ts_end - ts_start AS dur,
  CASE WHEN bwd_pkts <= 0 OR rst > 0 THEN 1 ELSE 0 END AS failed, CASE WHEN fwd_pkts + bwd_pkts <= 3 THEN 1 ELSE 0 END AS small, {stage_case('label')} AS stage
FROM q_flows f, q_lnow WHERE ts_end BETWEEN t0 AND now""")
part("q_lends", """
SELECT * FROM (SELECT src_ip AS host, dst_ip AS peer, 0 AS side, * FROM q_lcut UNION ALL SELECT dst_ip, src_ip, 1, * FROM q_lcut)
WHERE host IN (SELECT host FROM (SELECT src_ip AS host FROM q_lcut UNION ALL SELECT dst_ip FROM q_lcut) GROUP BY host HAVING count(*) >= 3)""")
part("q_lout", """
SELECT host, w, count(*) AS out_flows, sum(pkts) AS out_pkts, sum(bytes) AS out_bytes, count(DISTINCT peer) AS out_distinct_dst,
  count(DISTINCT dport) AS out_distinct_dport, avg(failed) AS out_failed_ratio, avg(small) AS out_small_flow_ratio, avg(syn) AS out_syn_ratio,
  avg(dur) AS out_mean_dur, sum(bytes) / greatest(sum(pkts), 1) AS out_mean_pkt_size, sum(bwd_bytes) / (sum(fwd_bytes) + 1) AS out_bwd_fwd_ratio,
  avg(CASE WHEN proto = 'tcp' THEN 1 ELSE 0 END) AS out_tcp_frac, avg(CASE WHEN proto = 'udp' THEN 1 ELSE 0 END) AS out_udp_frac,
  avg(CASE WHEN proto = 'icmp' THEN 1 ELSE 0 END) AS out_icmp_frac, avg(CASE WHEN dport < 1024 THEN 1 ELSE 0 END) AS out_wellknown_port_frac
FROM q_lends WHERE side = 0 GROUP BY host, w""")
part("q_lentropy", """
SELECT host, w, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS out_dport_entropy FROM
  (SELECT host, w, dport, count(*) AS n FROM q_lends WHERE side = 0 GROUP BY ALL) GROUP BY host, w""")
part("q_lpeers", """
SELECT host, w, count(*) AS out_new_peers FROM (SELECT host, peer, min(w) AS w FROM q_lends WHERE side = 0 GROUP BY host, peer) GROUP BY host, w""")
part("q_lin", """
SELECT host, w, count(*) AS in_flows, sum(pkts) AS in_pkts, sum(bytes) AS in_bytes, count(DISTINCT peer) AS in_distinct_src,
  count(DISTINCT dport) AS in_distinct_dport, avg(failed) AS in_failed_ratio, avg(small) AS in_small_flow_ratio, avg(syn) AS in_syn_ratio
FROM q_lends WHERE side = 1 GROUP BY host, w""")
part("q_lboth", """
SELECT host, w, avg(ttl) AS ttl_mean, avg(tcp_win) AS tcp_win_mean,
  coalesce(sum(retrans), 0) / greatest(coalesce(sum(fwd_pkts) FILTER (retrans IS NOT NULL), 0), 1) AS retrans_rate, count(ttl) > 0 AS has_ttl,
  count(tcp_win) > 0 AS has_win, count(retrans) > 0 AS has_rt FROM q_lends GROUP BY host, w""")
part("q_llabel", """
SELECT host, w, stage FROM (SELECT host, w, stage, label, row_number() OVER (PARTITION BY host, w ORDER BY count(*) DESC, stage, label) AS rn
  FROM q_lends WHERE stage > 0 GROUP BY host, w, stage, label) WHERE rn = 1""")
part("q_lsegs", """
SELECT w, CAST(segment AS INTEGER) AS segment, min(w) OVER (PARTITION BY segment) AS lo, max(w) OVER (PARTITION BY segment) AS hi FROM
  (SELECT w, sum(CASE WHEN w - p <= 10 THEN 0 ELSE 1 END) OVER (ORDER BY w) - 1 AS segment FROM
    (SELECT w, lag(w) OVER (ORDER BY w) AS p FROM (SELECT DISTINCT w FROM q_lcut)))""")
part("q_lgrid", """
SELECT host, segment, unnest(range(lo, hi + 1)) AS w FROM (SELECT DISTINCT e.host, s.segment, s.lo, s.hi FROM q_lends e JOIN q_lsegs s ON s.w = e.w)""")

_PLAIN = [f for f in S.FEATURES if f not in S.MASK_FEATURES]
LIVE = {
    "live_tick": f"""
SELECT host, segment, w AS "window", {", ".join(r(f'coalesce({f}, 0)') + f" AS {f}" for f in _PLAIN)},
  CAST(coalesce(has_ttl, false) AS INTEGER)::DOUBLE AS ttl_mean_mask, CAST(coalesce(has_win, false) AS INTEGER)::DOUBLE AS tcp_win_mean_mask,
  CAST(coalesce(has_rt, false) AS INTEGER)::DOUBLE AS retrans_rate_mask, CAST(coalesce(stage, 0) AS INTEGER) AS stage
FROM q_lgrid LEFT JOIN q_lout USING (host, w) LEFT JOIN q_lentropy USING (host, w) LEFT JOIN q_lpeers USING (host, w) LEFT JOIN q_lin USING (host, w)
LEFT JOIN q_lboth USING (host, w) LEFT JOIN q_llabel USING (host, w)""",
    "risk_history": f"""
SELECT host, CAST("window" AS DOUBLE) AS t, {r('risk')} AS risk_before, {r('risk * 0.08')} AS risk_after FROM
  (SELECT *, row_number() OVER (PARTITION BY host ORDER BY "window" DESC) AS rn FROM q_fc) WHERE rn <= 240""",
    "live_board": f"""
SELECT t.host, {r('peak')} AS peak, {r('risk')} AS risk_before, {r('risk * 0.08')} AS risk_after,
  CAST(coalesce(3600 * list_position(list_transform(future, lambda x: x >= {THR}), true), -1) AS INTEGER) AS lead_time_s
FROM (SELECT host, max(risk) AS peak, max("window") AS last FROM q_fc GROUP BY host ORDER BY peak DESC, host LIMIT 12) t
JOIN q_fc f ON f.host = t.host AND f."window" = t.last""",
}
