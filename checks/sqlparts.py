"""Named CTEs for the DuckDB oracles. `query(final)` pulls in what the text mentions."""
from __future__ import annotations

import re

from flowtide import schema as S

W = 3600
#: The label rules in their order, stated here again so that the oracle does not share them.
BENIGN = ["benign", "normal", "background", "0", ""]
RULES = {1: ["portscan", "reconnaissance", "analysis", "recon-", "vulnerabilityscan", "scan"], 5: ["heartbleed", "exfil"],
         3: ["infilt", "worm"], 4: ["botnet", "bot", "backdoor", "mirai"], 6: ["ddos", "dos"],
         2: ["patator", "brute", "web attack", "sql", "xss", "injection", "exploit", "shellcode", "fuzzer", "generic", "spoof",
             "mitm", "hijack", "upload"]}
OTHER = 2
PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql.strip()


def query(final: str) -> str:
    """Prefix `final` with the CTEs it needs, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\bq_\w+", text)):
            if word in PARTS and word not in order:
                visit(PARTS[word])
                if word not in order:
                    order.append(word)

    visit(final)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in order)
    return (f"WITH {ctes}\n" if order else "") + final.strip()


def r(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def rcols(cols, digits: int = 6, prefix: str = "") -> str:
    return ", ".join(f"{r(prefix + c, digits)} AS {c}" for c in cols)


def stage_case(col: str) -> str:
    s = f"lower(trim(coalesce({col}, '')))"
    benign = ", ".join(f"'{b}'" for b in BENIGN)
    rules = " ".join(f"WHEN contains({s}, '{m}') THEN {k}" for k, marks in RULES.items() for m in marks)
    return (f"CASE WHEN (CASE WHEN starts_with({s}, 'flow=') THEN NOT contains({s}, 'botnet') "
            f"ELSE {s} IN ({benign}) END) THEN 0 {rules} ELSE {OTHER} END")


part("q_flows", f"""
SELECT event_id AS flow_id, t AS ts_start, t + value AS ts_end,
  '10.0.' || CAST(CAST(floor(user_id / 256) AS BIGINT) AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS src_ip,
  '10.0.0.' || CAST((user_id * 7 + k) % 150 AS VARCHAR) AS dst_ip,
  CAST(1024 + event_id % 50000 AS BIGINT) AS sport, CAST(k * 41 AS BIGINT) AS dport,
  CASE event_type WHEN 'purchase' THEN 'udp' WHEN 'signup' THEN 'icmp' ELSE 'tcp' END AS proto,
  CAST(1 + k % 7 AS DOUBLE) AS fwd_pkts,
  CAST(CASE WHEN event_type = 'error' THEN 0 ELSE k % 5 END AS DOUBLE) AS bwd_pkts,
  CAST(floor(value * 100) AS DOUBLE) AS fwd_bytes, CAST(k * 10 AS DOUBLE) AS bwd_bytes,
  CASE WHEN event_type NOT IN ('purchase', 'signup') AND k % 2 = 0 THEN 1 ELSE 0 END AS syn,
  CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS rst, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS fin,
  CAST(CASE WHEN k % 3 = 0 THEN 32 + k END AS DOUBLE) AS ttl,
  CAST(CASE WHEN k % 4 = 0 THEN 1024 * (k + 1) END AS DOUBLE) AS tcp_win,
  CAST(CASE WHEN k % 5 = 0 THEN k % 2 END AS DOUBLE) AS retrans,
  CASE WHEN event_type <> 'error' OR k >= 80 THEN 'BENIGN' WHEN k < 20 THEN 'PortScan'
       WHEN k < 40 THEN 'SSH-Patator' WHEN k < 50 THEN 'Infiltration' WHEN k < 60 THEN 'Bot'
       WHEN k < 70 THEN 'Exfiltration' ELSE 'DoS slowloris' END AS label
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, epoch_us(ts) / 1e6 AS t FROM events)
""")

part("q_cut", f"""
SELECT *, CAST(floor((ts_end - (SELECT floor(min(ts_end) / {W}) * {W} FROM q_flows)) / {W}) AS BIGINT) AS w,
  fwd_pkts + bwd_pkts AS pkts, fwd_bytes + bwd_bytes AS bytes, ts_end - ts_start AS dur,
  CASE WHEN bwd_pkts <= 0 OR rst > 0 THEN 1 ELSE 0 END AS failed,
  CASE WHEN fwd_pkts + bwd_pkts <= 3 THEN 1 ELSE 0 END AS small,
  {stage_case('label')} AS stage
FROM q_flows
""")

part("q_hosts", """
SELECT host, count(*) AS appearances FROM
  (SELECT src_ip AS host FROM q_flows UNION ALL SELECT dst_ip FROM q_flows)
GROUP BY host HAVING count(*) >= 20
""")
part("q_out", "SELECT src_ip AS host, * EXCLUDE (src_ip) FROM q_cut WHERE src_ip IN (SELECT host FROM q_hosts)")
part("q_in", "SELECT dst_ip AS host, * EXCLUDE (dst_ip) FROM q_cut WHERE dst_ip IN (SELECT host FROM q_hosts)")

part("q_entropy", """
SELECT host, w, sum(-p * log2(p)) AS out_dport_entropy FROM
  (SELECT host, w, n / sum(n) OVER (PARTITION BY host, w) AS p FROM
    (SELECT host, w, dport, count(*) AS n FROM q_out GROUP BY host, w, dport))
GROUP BY host, w
""")
part("q_peers", """
SELECT host, w, count(*) AS out_new_peers FROM
  (SELECT host, dst_ip, min(w) AS w FROM q_out GROUP BY host, dst_ip) GROUP BY host, w
""")
part("q_outagg", """
SELECT host, w, count(*) AS out_flows, sum(pkts) AS out_pkts, sum(bytes) AS out_bytes,
  count(DISTINCT dst_ip) AS out_distinct_dst, count(DISTINCT dport) AS out_distinct_dport,
  avg(failed) AS out_failed_ratio, avg(small) AS out_small_flow_ratio, avg(syn) AS out_syn_ratio,
  avg(dur) AS out_mean_dur, sum(bytes) / greatest(sum(pkts), 1) AS out_mean_pkt_size,
  sum(bwd_bytes) / (sum(fwd_bytes) + 1) AS out_bwd_fwd_ratio,
  avg(CASE WHEN proto = 'tcp' THEN 1 ELSE 0 END) AS out_tcp_frac,
  avg(CASE WHEN proto = 'udp' THEN 1 ELSE 0 END) AS out_udp_frac,
  avg(CASE WHEN proto = 'icmp' THEN 1 ELSE 0 END) AS out_icmp_frac,
  avg(CASE WHEN dport < 1024 THEN 1 ELSE 0 END) AS out_wellknown_port_frac,
  count(*) FILTER (stage > 0) AS atk_out
FROM q_out GROUP BY host, w
""")
part("q_inagg", """
SELECT host, w, count(*) AS in_flows, sum(pkts) AS in_pkts, sum(bytes) AS in_bytes,
  count(DISTINCT src_ip) AS in_distinct_src, count(DISTINCT dport) AS in_distinct_dport,
  avg(failed) AS in_failed_ratio, avg(small) AS in_small_flow_ratio, avg(syn) AS in_syn_ratio,
  count(*) FILTER (stage BETWEEN 1 AND 6) AS atk_in
FROM q_in GROUP BY host, w
""")
part("q_packet", """
SELECT host, w, avg(ttl) AS ttl_mean, avg(tcp_win) AS tcp_win_mean,
  coalesce(sum(retrans), 0) / greatest(coalesce(sum(fwd_pkts) FILTER (retrans IS NOT NULL), 0), 1) AS retrans_rate,
  bool_or(retrans IS NOT NULL) AS has_retrans
FROM (SELECT host, w, ttl, tcp_win, retrans, fwd_pkts FROM q_out
      UNION ALL SELECT host, w, ttl, tcp_win, retrans, fwd_pkts FROM q_in) GROUP BY host, w
""")
part("q_label", """
SELECT host, w, stage, label FROM
  (SELECT *, row_number() OVER (PARTITION BY host, w ORDER BY n DESC, stage, label) AS rn FROM
    (SELECT host, w, stage, label, count(*) AS n FROM
      (SELECT host, w, stage, label FROM q_out WHERE stage > 0
       UNION ALL SELECT host, w, stage, label FROM q_in WHERE stage BETWEEN 1 AND 6)
     GROUP BY host, w, stage, label)) WHERE rn = 1
""")
part("q_segments", """
SELECT w, segment, min(w) OVER (PARTITION BY segment) AS seg_start, max(w) OVER (PARTITION BY segment) AS seg_end
FROM (SELECT w, CAST(sum(CASE WHEN w - prev <= 10 THEN 0 ELSE 1 END) OVER (ORDER BY w) - 1 AS INTEGER) AS segment
      FROM (SELECT w, lag(w) OVER (ORDER BY w) AS prev FROM (SELECT DISTINCT w FROM q_cut)))
""")
part("q_active", """
SELECT k.host, k.w, s.segment, o.* EXCLUDE (host, w), e.out_dport_entropy, p.out_new_peers,
  i.* EXCLUDE (host, w), x.* EXCLUDE (host, w), l.stage, l.label
FROM (SELECT host, w FROM q_outagg UNION SELECT host, w FROM q_inagg) k
LEFT JOIN q_outagg o USING (host, w) LEFT JOIN q_entropy e USING (host, w) LEFT JOIN q_peers p USING (host, w)
LEFT JOIN q_inagg i USING (host, w) LEFT JOIN q_packet x USING (host, w) LEFT JOIN q_label l USING (host, w)
JOIN q_segments s ON s.w = k.w
""")
part("q_grid", """
SELECT host, segment, unnest(range(lo, hi + 1)) AS w FROM
  (SELECT DISTINCT a.host, a.segment, s.seg_start AS lo, s.seg_end AS hi FROM q_active a JOIN q_segments s ON s.w = a.w)
""")

_PLAIN = [f for f in S.FEATURES if not f.endswith("_mask")]
part("q_frame", f"""
SELECT g.host, CAST(g.segment AS INTEGER) AS segment, CAST(g.w AS BIGINT) AS "window",
  (SELECT floor(min(ts_end) / {W}) * {W} FROM q_flows) + g.w * {W}.0 AS t,
  {", ".join(f"CAST(coalesce(a.{f}, 0) AS DOUBLE) AS {f}" for f in _PLAIN)},
  CASE WHEN a.ttl_mean IS NOT NULL THEN 1.0 ELSE 0.0 END AS ttl_mean_mask,
  CASE WHEN a.tcp_win_mean IS NOT NULL THEN 1.0 ELSE 0.0 END AS tcp_win_mean_mask,
  CASE WHEN a.has_retrans THEN 1.0 ELSE 0.0 END AS retrans_rate_mask,
  coalesce(a.label, 'BENIGN') AS label, CAST(coalesce(a.stage, 0) AS INTEGER) AS stage,
  CAST(CASE WHEN coalesce(a.stage, 0) > 0 AND coalesce(a.atk_out, 0) >= coalesce(a.atk_in, 0)
            AND coalesce(a.atk_out, 0) > 0 THEN 1 ELSE 0 END AS INTEGER) AS attack_out
FROM q_grid g LEFT JOIN q_active a ON a.host = g.host AND a.w = g.w
""")
part("q_edges", """
SELECT src_ip AS a, dst_ip AS b, w AS "window", count(*) AS flows FROM q_cut
WHERE src_ip <> dst_ip AND src_ip IN (SELECT host FROM q_hosts) AND dst_ip IN (SELECT host FROM q_hosts)
GROUP BY src_ip, dst_ip, w
""")

# ------------------------------------------------------------------ forecasts
part("q_trans", """
SELECT a.i AS from_stage, b.i AS to_stage, coalesce(n, 0) AS n,
  (coalesce(n, 0) + 1.0) / (sum(coalesce(n, 0)) OVER (PARTITION BY a.i) + 7.0) AS p
FROM (SELECT CAST(unnest(range(7)) AS INTEGER) AS i) a CROSS JOIN (SELECT CAST(unnest(range(7)) AS INTEGER) AS i) b
LEFT JOIN (SELECT stage, nxt, count(*) AS n FROM
  (SELECT stage, lead(stage) OVER (PARTITION BY host, segment ORDER BY "window") AS nxt FROM q_frame)
  WHERE nxt IS NOT NULL GROUP BY stage, nxt) c ON c.stage = a.i AND c.nxt = b.i
""")
part("q_roll1", "SELECT from_stage AS s, to_stage AS z, p FROM q_trans")
for _k in range(2, 6):
    part(f"q_roll{_k}", f"""
SELECT d.s, t.to_stage AS z, sum(d.p * t.p) AS p FROM q_roll{_k - 1} d JOIN q_trans t ON t.from_stage = d.z
GROUP BY d.s, t.to_stage""")
part("q_rolled", " UNION ALL ".join(f"SELECT s, {k} AS k, z, p FROM q_roll{k}" for k in range(1, 6)))
part("q_bystage", """
SELECT s, list(r ORDER BY k) AS future, list(m ORDER BY k) AS probs FROM (
  SELECT s, k, sum(q) FILTER (z > 0) AS r, list(q ORDER BY z) AS m FROM
    (SELECT s, k, z, (p + CASE WHEN z = s THEN 1.0 ELSE 0.0 END) / 2 AS q FROM q_rolled) GROUP BY s, k)
GROUP BY s
""")
part("q_mean", """
SELECT s, list(q ORDER BY z) AS m FROM
  (SELECT s, z, avg((p + CASE WHEN z = s THEN 1.0 ELSE 0.0 END) / 2) AS q FROM q_rolled GROUP BY s, z) GROUP BY s
""")
THR = 0.3
part("q_fc", f"""
SELECT f.host, f."window", f."window" - (SELECT min("window") FROM q_frame) AS step, f.stage, f.out_flows, f.in_flows,
  b.future, list_max(b.future) AS risk, m.m AS probs, b.probs AS kprobs,
  CAST(CASE WHEN list_max(b.future) < {THR} * 0.5 THEN 0
            ELSE list_position(m.m[2:7], list_max(m.m[2:7])) END AS INTEGER) AS mapped
FROM q_frame f JOIN q_bystage b ON b.s = f.stage JOIN q_mean m ON m.s = f.stage
""")
part("q_alert", f"""
SELECT host, min(step) AS first_alert_step FROM
  (SELECT host, step, risk, lag(risk) OVER w AS pr, lag(step) OVER w AS ps FROM q_fc
   WINDOW w AS (PARTITION BY host ORDER BY step))
WHERE risk >= {THR} AND pr >= {THR} AND step - ps = 1 GROUP BY host
""")

# ------------------------------------------------------------------ roles
part("q_recent", """
SELECT w AS "window", a, b, CAST(sum(flows) AS BIGINT) AS flows FROM
  (SELECT a, b, flows, unnest(range("window", "window" + 3)) AS w FROM q_edges) GROUP BY w, a, b
""")
part("q_dir", """
SELECT "window", host, sum(o) AS o, sum(i) AS i FROM
  (SELECT "window", a AS host, flows AS o, 0 AS i FROM q_recent UNION ALL SELECT "window", b, 0, flows FROM q_recent)
GROUP BY "window", host
""")
part("q_alerting", f"""
SELECT f."window", f.host, row_number() OVER (PARTITION BY f."window" ORDER BY f.risk DESC, f.host) AS pos,
  coalesce(d.o, 0) >= coalesce(d.i, 0) AS attacks
FROM q_fc f LEFT JOIN q_dir d ON d."window" = f."window" AND d.host = f.host WHERE f.risk >= {THR}
""")
part("q_heavy_src", """
SELECT "window", b AS host, a AS peer FROM
  (SELECT *, row_number() OVER (PARTITION BY "window", b ORDER BY flows DESC, a) AS rn FROM q_recent) WHERE rn = 1
""")
part("q_heavy_dst", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "window", a ORDER BY flows DESC, b) AS rn FROM q_recent)
WHERE rn <= 3
""")
part("q_vict", """
SELECT v."window", v.host AS victim, v.pos, s.peer AS attacker FROM q_alerting v
JOIN q_heavy_src s ON s."window" = v."window" AND s.host = v.host WHERE NOT v.attacks
""")
part("q_targets", """
SELECT h."window", h.a AS attacker, h.b AS victim, h.rn, x.pos FROM q_heavy_dst h
JOIN q_alerting x ON x."window" = h."window" AND x.host = h.a WHERE x.attacks
""")
part("q_links", """
SELECT "window", attacker, victim, 0 AS grp, pos, rn FROM q_targets
UNION ALL
SELECT v."window", v.attacker, v.victim, 1, v.pos, 0 FROM q_vict v
LEFT JOIN q_alerting x ON x."window" = v."window" AND x.host = v.attacker AND x.attacks
WHERE (x.pos IS NULL OR v.pos > x.pos) AND NOT EXISTS
  (SELECT 1 FROM q_targets t WHERE t."window" = v."window" AND t.attacker = v.attacker AND t.victim = v.victim)
""")
part("q_entered", """
SELECT "window", attacker, min(pos) AS entry FROM
  (SELECT "window", host AS attacker, pos FROM q_alerting WHERE attacks
   UNION ALL SELECT "window", attacker, pos FROM q_vict) GROUP BY "window", attacker
""")
part("q_roles", """
SELECT "window", attacker AS host, 'attacker' AS role, CAST(NULL AS VARCHAR) AS attacker FROM q_entered
UNION ALL
SELECT "window", host, 'victim', coalesce(named, listed_by) FROM
  (SELECT coalesce(l."window", v."window") AS "window", coalesce(l.host, v.victim) AS host, v.attacker AS named, l.listed_by
   FROM (SELECT k."window", k.victim AS host, arg_max(k.attacker, e.entry) AS listed_by FROM q_links k
         JOIN q_entered e ON e."window" = k."window" AND e.attacker = k.attacker GROUP BY k."window", k.victim) l
   FULL JOIN q_vict v ON v."window" = l."window" AND v.victim = l.host)
WHERE NOT EXISTS (SELECT 1 FROM q_entered e WHERE e."window" = "window" AND FALSE)
""")
PARTS["q_roles"] = PARTS["q_roles"].replace(
    'WHERE NOT EXISTS (SELECT 1 FROM q_entered e WHERE e."window" = "window" AND FALSE)',
    'AS r WHERE NOT EXISTS (SELECT 1 FROM q_entered e WHERE e."window" = r."window" AND e.attacker = r.host)')

# ------------------------------------------------------------------ captures and sequences
part("q_kflows", f"""
SELECT *, 'd' || CAST(flow_id % 2 AS VARCHAR) AS dataset,
  'c' || CAST(CAST(floor(flow_id % 4 / 2.0) AS BIGINT) AS VARCHAR) AS capture, {stage_case('label')} AS stage,
  CAST(floor(ts_end / {W}) AS BIGINT) AS aw, CASE WHEN bwd_pkts <= 0 OR rst > 0 THEN 1 ELSE 0 END AS failed
FROM q_flows
""")
part("q_kcut", """
SELECT *, aw - min(aw) OVER (PARTITION BY dataset, capture) AS w, fwd_pkts + bwd_pkts AS pkts, fwd_bytes + bwd_bytes AS bytes,
  ts_end - ts_start AS dur, CASE WHEN fwd_pkts + bwd_pkts <= 3 THEN 1 ELSE 0 END AS small FROM q_kflows
""")
part("q_khosts", """
SELECT dataset, capture, host FROM
  (SELECT dataset, capture, src_ip AS host FROM q_kflows UNION ALL SELECT dataset, capture, dst_ip FROM q_kflows)
GROUP BY dataset, capture, host HAVING count(*) >= 5
""")
part("q_kout", "SELECT c.*, h.host FROM q_kcut c JOIN q_khosts h ON h.dataset = c.dataset AND h.capture = c.capture AND h.host = c.src_ip")
part("q_kin", "SELECT c.*, h.host FROM q_kcut c JOIN q_khosts h ON h.dataset = c.dataset AND h.capture = c.capture AND h.host = c.dst_ip")
part("q_ksegs", """
SELECT dataset, capture, w, segment, min(w) OVER (PARTITION BY dataset, capture, segment) AS lo,
  max(w) OVER (PARTITION BY dataset, capture, segment) AS hi, aw FROM
  (SELECT *, CAST(sum(CASE WHEN w - prev <= 10 THEN 0 ELSE 1 END) OVER (PARTITION BY dataset, capture ORDER BY w) - 1 AS INTEGER) AS segment
   FROM (SELECT *, lag(w) OVER (PARTITION BY dataset, capture ORDER BY w) AS prev FROM
     (SELECT DISTINCT dataset, capture, w, aw FROM q_kcut)))
""")
part("q_kactive", """
SELECT dataset, capture, host, w, sum(o) AS out_flows, sum(i) AS in_flows, sum(f) AS failed,
  count(DISTINCT src) AS in_distinct_src, sum(ao) AS atk_out, sum(ai) AS atk_in FROM
  (SELECT dataset, capture, host, w, 1 AS o, 0 AS i, failed AS f, NULL AS src, CASE WHEN stage > 0 THEN 1 ELSE 0 END AS ao, 0 AS ai FROM q_kout
   UNION ALL SELECT dataset, capture, host, w, 0, 1, 0, src_ip, 0, CASE WHEN stage > 0 THEN 1 ELSE 0 END FROM q_kin)
GROUP BY dataset, capture, host, w
""")
part("q_klabel", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, capture, host, w ORDER BY n DESC, stage, label) AS rn FROM
  (SELECT dataset, capture, host, w, stage, label, count(*) AS n FROM
    (SELECT dataset, capture, host, w, stage, label FROM q_kout WHERE stage > 0
     UNION ALL SELECT dataset, capture, host, w, stage, label FROM q_kin WHERE stage > 0)
   GROUP BY dataset, capture, host, w, stage, label)) WHERE rn = 1
""")
part("q_kgrid", """
SELECT dataset, capture, host, segment, unnest(range(lo, hi + 1)) AS w FROM
  (SELECT DISTINCT a.dataset, a.capture, a.host, s.segment, s.lo, s.hi FROM q_kactive a
   JOIN q_ksegs s ON s.dataset = a.dataset AND s.capture = a.capture AND s.w = a.w)
""")
part("q_kframe", f"""
SELECT g.dataset, g.capture, g.host, g.segment, g.w AS "window",
  ((SELECT min(k.aw) FROM q_kflows k WHERE k.dataset = g.dataset AND k.capture = g.capture) + g.w) * {W}.0 AS t,
  CAST(coalesce(a.out_flows, 0) AS DOUBLE) AS out_flows, CAST(coalesce(a.in_flows, 0) AS DOUBLE) AS in_flows,
  coalesce(a.failed / nullif(a.out_flows, 0), 0.0) AS out_failed_ratio,
  CAST(coalesce(a.in_distinct_src, 0) AS DOUBLE) AS in_distinct_src,
  coalesce(l.stage, 0) AS stage, coalesce(l.label, 'BENIGN') AS label,
  CASE WHEN coalesce(l.stage, 0) > 0 AND a.atk_out >= a.atk_in AND a.atk_out > 0 THEN 1 ELSE 0 END AS attack_out
FROM q_kgrid g
LEFT JOIN q_kactive a ON a.dataset = g.dataset AND a.capture = g.capture AND a.host = g.host AND a.w = g.w
LEFT JOIN q_klabel l ON l.dataset = g.dataset AND l.capture = g.capture AND l.host = g.host AND l.w = g.w
""")
part("q_kentropy", """
SELECT dataset, capture, host, w, sum(-p * log2(p)) AS out_dport_entropy FROM
  (SELECT dataset, capture, host, w, n / sum(n) OVER (PARTITION BY dataset, capture, host, w) AS p FROM
    (SELECT dataset, capture, host, w, dport, count(*) AS n FROM q_kout GROUP BY ALL))
GROUP BY ALL
""")
part("q_kpeers", """
SELECT dataset, capture, host, w, count(*) AS out_new_peers FROM
  (SELECT dataset, capture, host, dst_ip, min(w) AS w FROM q_kout GROUP BY ALL) GROUP BY ALL
""")
part("q_koutagg", """
SELECT dataset, capture, host, w, count(*) AS out_flows, sum(pkts) AS out_pkts, sum(bytes) AS out_bytes,
  count(DISTINCT dst_ip) AS out_distinct_dst, count(DISTINCT dport) AS out_distinct_dport,
  avg(failed) AS out_failed_ratio, avg(small) AS out_small_flow_ratio, avg(syn) AS out_syn_ratio,
  avg(dur) AS out_mean_dur, sum(bytes) / greatest(sum(pkts), 1) AS out_mean_pkt_size,
  sum(bwd_bytes) / (sum(fwd_bytes) + 1) AS out_bwd_fwd_ratio,
  avg(CASE WHEN proto = 'tcp' THEN 1 ELSE 0 END) AS out_tcp_frac,
  avg(CASE WHEN proto = 'udp' THEN 1 ELSE 0 END) AS out_udp_frac,
  avg(CASE WHEN proto = 'icmp' THEN 1 ELSE 0 END) AS out_icmp_frac,
  avg(CASE WHEN dport < 1024 THEN 1 ELSE 0 END) AS out_wellknown_port_frac
FROM q_kout GROUP BY ALL
""")
part("q_kinagg", """
SELECT dataset, capture, host, w, count(*) AS in_flows, sum(pkts) AS in_pkts, sum(bytes) AS in_bytes,
  count(DISTINCT src_ip) AS in_distinct_src, count(DISTINCT dport) AS in_distinct_dport,
  avg(failed) AS in_failed_ratio, avg(small) AS in_small_flow_ratio, avg(syn) AS in_syn_ratio
FROM q_kin GROUP BY ALL
""")
part("q_kpacket", """
SELECT dataset, capture, host, w, avg(ttl) AS ttl_mean, avg(tcp_win) AS tcp_win_mean,
  coalesce(sum(retrans), 0) / greatest(coalesce(sum(fwd_pkts) FILTER (retrans IS NOT NULL), 0), 1) AS retrans_rate,
  bool_or(retrans IS NOT NULL) AS has_retrans
FROM (SELECT dataset, capture, host, w, ttl, tcp_win, retrans, fwd_pkts FROM q_kout
      UNION ALL SELECT dataset, capture, host, w, ttl, tcp_win, retrans, fwd_pkts FROM q_kin) GROUP BY ALL
""")
_AT = "dataset, capture, host, w"
part("q_kfull", f"""
SELECT g.dataset, g.capture, g.host, g.segment, g.w AS "window", g.t, g.stage, g.label, g.attack_out,
  {", ".join(f"CAST(coalesce({f}, 0) AS DOUBLE) AS {f}" for f in S.FEATURES if not f.endswith("_mask"))},
  CASE WHEN ttl_mean IS NOT NULL THEN 1.0 ELSE 0.0 END AS ttl_mean_mask,
  CASE WHEN tcp_win_mean IS NOT NULL THEN 1.0 ELSE 0.0 END AS tcp_win_mean_mask,
  CASE WHEN has_retrans THEN 1.0 ELSE 0.0 END AS retrans_rate_mask
FROM (SELECT dataset, capture, host, segment, "window" AS w, t, stage, label, attack_out FROM q_kframe) g
LEFT JOIN q_koutagg USING ({_AT}) LEFT JOIN q_kinagg USING ({_AT}) LEFT JOIN q_kentropy USING ({_AT})
LEFT JOIN q_kpeers USING ({_AT}) LEFT JOIN q_kpacket USING ({_AT})
""")
part("q_kepi", """
SELECT * EXCLUDE (n, pn, ps, qn), CASE WHEN stage = 0 AND qn - pn <= 6 THEN ps ELSE stage END AS episode_stage FROM
  (SELECT *, max(CASE WHEN stage > 0 THEN n END) OVER (g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pn,
     last_value(CASE WHEN stage > 0 THEN stage END IGNORE NULLS) OVER (g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ps,
     min(CASE WHEN stage > 0 THEN n END) OVER (g ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qn
   FROM (SELECT *, row_number() OVER (PARTITION BY dataset, capture, host, segment ORDER BY "window") AS n FROM q_kframe)
   WINDOW g AS (PARTITION BY dataset, capture, host, segment ORDER BY "window"))
""")
part("q_kblock", """
SELECT f.*, CAST(floor((f."window" - c.w0) / 60.0) AS BIGINT) AS block, c.no,
  CASE WHEN f.dataset = 'lab' THEN 'train' ELSE
    (['train', 'train', 'val', 'train', 'test'])[CAST((floor((f."window" - c.w0) / 60.0) + c.no) % 5 AS BIGINT) + 1] END AS split
FROM q_kepi f JOIN (SELECT dataset, capture, min("window") AS w0,
  row_number() OVER (ORDER BY dataset, capture) - 1 AS no FROM q_kepi GROUP BY dataset, capture) c
ON c.dataset = f.dataset AND c.capture = f.capture
""")
part("q_kstarts", """
SELECT * FROM (SELECT *, lead(block, 14) OVER (PARTITION BY dataset, capture, host, segment ORDER BY "window") AS lastb,
  lead(out_failed_ratio, 9) OVER (PARTITION BY dataset, capture, host, segment ORDER BY "window") AS s_ratio,
  lead(in_flows, 9) OVER (PARTITION BY dataset, capture, host, segment ORDER BY "window") AS s_busy FROM q_kblock)
WHERE lastb = block
""")
part("q_kseq", """
SELECT s.dataset, s.capture, s.host, s.segment, s."window", s.split,
  round(any_value(s.s_ratio) + 0.1 * any_value(s.s_busy), 6) AS score,
  max(CASE WHEN r.d >= 10 THEN r.risk END) AS y_future, max(CASE WHEN r.d = 9 THEN r.risk END) AS y_now,
  max(CASE WHEN r.d < 10 THEN r.risk END) AS hist_attack,
  coalesce(min(CASE WHEN r.d >= 10 AND r.risk > 0 THEN r.d - 9 END), 0) AS lead, max(r.risk) AS touches,
  max(CASE WHEN r.d >= 10 THEN CASE WHEN r.stage = 1 THEN 1 ELSE 0 END END) AS recon, CAST(sum(r.risk) AS INTEGER) AS attack_rows
FROM q_kstarts s JOIN
  (SELECT e.*, CASE WHEN episode_stage BETWEEN 1 AND 6 THEN 1 ELSE 0 END AS risk, o.d, e."window" - o.d AS start_w
   FROM q_kepi e CROSS JOIN (SELECT CAST(unnest(range(15)) AS INTEGER) AS d) o) r
ON r.dataset = s.dataset AND r.capture = s.capture AND r.host = s.host AND r.segment = s.segment AND r.start_w = s."window"
GROUP BY s.dataset, s.capture, s.host, s.segment, s."window", s.split
""")
