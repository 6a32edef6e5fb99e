"""Oracle SQL per registered query, written the plain relational way for DuckDB."""
from __future__ import annotations

from checks.sqlparts import W, query, r, rcols
from flowtide import schema as S

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = query(sql)


oracle("clean_flows", f"""
SELECT flow_id, {r('ts_start')} AS ts_start, {r('ts_end')} AS ts_end, src_ip, dst_ip, sport, dport, proto, fwd_pkts, bwd_pkts, fwd_bytes, bwd_bytes,
  syn, rst, fin, coalesce(ttl, -1) AS ttl, coalesce(tcp_win, -1) AS tcp_win, coalesce(retrans, -1) AS retrans, label FROM q_flows
""")
oracle("select_hosts", "SELECT * FROM q_hosts ORDER BY appearances DESC, host LIMIT 200")
oracle("out_features", f"""
SELECT host, w AS "window", {rcols(S.OUT_FEATURES)} FROM q_outagg
LEFT JOIN q_entropy USING (host, w) LEFT JOIN q_peers USING (host, w)
""".replace("CAST(out_new_peers AS", "CAST(coalesce(out_new_peers, 0) AS"))
oracle("in_features", f'SELECT host, w AS "window", {rcols(S.IN_FEATURES)} FROM q_inagg')
oracle("packet_features", f"""
SELECT host, w AS "window", {r('coalesce(ttl_mean, 0)')} AS ttl_mean, {r('coalesce(tcp_win_mean, 0)')} AS tcp_win_mean,
  {r('retrans_rate')} AS retrans_rate, CASE WHEN ttl_mean IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS ttl_mean_mask,
  CASE WHEN tcp_win_mean IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS tcp_win_mean_mask,
  CASE WHEN has_retrans THEN 1.0 ELSE 0.0 END::DOUBLE AS retrans_rate_mask FROM q_packet
""")
oracle("dominant_label", 'SELECT host, w AS "window", stage, label FROM q_label')
oracle("segments", """
WITH c AS (SELECT DISTINCT CAST(floor((ts_end - (SELECT floor(min(ts_end) / 60) * 60 FROM q_flows)) / 60) AS BIGINT) AS w FROM q_flows),
g AS (SELECT w, CAST(sum(CASE WHEN w - prev <= 10 THEN 0 ELSE 1 END) OVER (ORDER BY w) - 1 AS INTEGER) AS segment
      FROM (SELECT w, lag(w) OVER (ORDER BY w) AS prev FROM c))
SELECT w AS "window", segment, min(w) OVER (PARTITION BY segment) AS seg_start, max(w) OVER (PARTITION BY segment) AS seg_end FROM g
""".replace("WITH c AS", "SELECT * FROM (WITH c AS") + ")")
oracle("host_windows", f"""
SELECT host, segment, "window", t, {rcols(S.FEATURES)}, label, stage, attack_out FROM q_frame
""")
oracle("host_edges", "SELECT * FROM q_edges")

from checks.sqlparts import THR, stage_case  # noqa: E402

oracle("host_graph", "SELECT src_ip, dst_ip, count(*) AS flows, sum(fwd_bytes) AS bytes FROM q_flows GROUP BY src_ip, dst_ip")
oracle("top_pairs", "SELECT src_ip, dst_ip, count(*) AS flows FROM q_flows GROUP BY src_ip, dst_ip ORDER BY flows DESC, src_ip, dst_ip LIMIT 70")
oracle("top_hosts", """
SELECT host, count(*) AS flows, regexp_extract(host, '^(\\d+\\.\\d+\\.\\d+)\\.', 1) || '.0/24' AS subnet
FROM (SELECT src_ip AS host FROM q_flows UNION ALL SELECT dst_ip FROM q_flows)
GROUP BY host ORDER BY flows DESC, host LIMIT 26""")

oracle("neighbor_agg", f"""
SELECT f.host, f."window", {rcols(S.FEATURES, prefix='f.')},
  {", ".join(f"{r(f'coalesce(n.nb_mean_{c}, 0)')} AS nb_mean_{c}, {r(f'coalesce(n.nb_max_{c}, 0)')} AS nb_max_{c}" for c in S.FEATURES)},
  {r('coalesce(n.deg, 0)')} AS nb_log_degree
FROM q_frame f LEFT JOIN (
  SELECT u.host, u."window", {", ".join(f"avg(p.{c}) AS nb_mean_{c}, max(p.{c}) AS nb_max_{c}" for c in S.FEATURES)}, ln(1 + count(*)) AS deg
  FROM (SELECT a AS host, b AS peer, "window" FROM q_edges UNION SELECT b, a, "window" FROM q_edges) u
  JOIN q_frame p ON p.host = u.peer AND p."window" = u."window" GROUP BY u.host, u."window") n
ON n.host = f.host AND n."window" = f."window"
""")
oracle("roles", "SELECT \"window\", host, role, coalesce(attacker, '') AS attacker FROM q_roles")
oracle("role_victims", 'SELECT "window", attacker, victim, grp FROM q_links')

_NODES = f"""
SELECT n.host, round(coalesce(f.risk, 0), 4) AS risk, coalesce(f.mapped, 0) AS stage, coalesce(n.role, 'normal') AS role,
  coalesce(f.risk, 0) >= {THR} AS alerting, CAST(coalesce(n.now, 0) AS BIGINT) AS flows_now, CAST(coalesce(n.total, 0) AS BIGINT) AS flows_total
FROM (SELECT *, row_number() OVER (PARTITION BY role IS NULL ORDER BY total DESC, host) AS rn FROM
  (SELECT coalesce(v.host, x.host) AS host, v.total, v.now, x.role FROM
    (SELECT host, sum(out_flows + in_flows) AS total, sum(out_flows + in_flows) FILTER ("window" = 400) AS now
     FROM q_frame WHERE "window" <= 400 GROUP BY host) v
    FULL JOIN (SELECT * FROM q_roles WHERE "window" = 400) x ON x.host = v.host) WHERE total > 0 OR role IS NOT NULL) n
LEFT JOIN q_fc f ON f.host = n.host AND f."window" = 400
WHERE n.role IS NOT NULL OR n.rn <= 60 - (SELECT count(*) FROM q_roles WHERE "window" = 400)
"""
oracle("topology_nodes", _NODES)
oracle("topology_edges", f"""
SELECT u.a, u.b, u.flows, u.active, u.active > 0 AND p.a IS NOT NULL AS hot FROM
  (SELECT least(a, b) AS a, greatest(a, b) AS b, CAST(sum(flows) AS BIGINT) AS flows,
     CAST(coalesce(sum(flows) FILTER ("window" > 397), 0) AS BIGINT) AS active
   FROM q_edges WHERE "window" <= 400 GROUP BY 1, 2) AS u(a, b, flows, active)
LEFT JOIN (SELECT DISTINCT least(attacker, victim) AS a, greatest(attacker, victim) AS b FROM q_links WHERE "window" = 400) p
  ON p.a = u.a AND p.b = u.b
WHERE u.a IN (SELECT host FROM ({_NODES})) AND u.b IN (SELECT host FROM ({_NODES}))
""")

DAY = 86400
_SCAN = f"""
SELECT s.src_ip AS src, regexp_extract(t.dst_ip, '^(\\d+\\.\\d+\\.\\d+)\\.', 1) || '.0/24' AS dst, s.distinct_dst, s.distinct_dport,
  coalesce(b.w, s.first_w) AS onset_window
FROM (SELECT src_ip, count(DISTINCT dst_ip) AS distinct_dst, count(DISTINCT dport) AS distinct_dport,
        arg_min(w, (ts_start, flow_id)) AS first_w FROM q_day GROUP BY src_ip) s
LEFT JOIN (SELECT src_ip, min(w) AS w FROM (SELECT src_ip, w FROM q_day GROUP BY src_ip, w HAVING count(DISTINCT dst_ip) >= 8)
           GROUP BY src_ip) b ON b.src_ip = s.src_ip
JOIN (SELECT src_ip, dst_ip FROM (SELECT src_ip, dst_ip, row_number() OVER (PARTITION BY src_ip ORDER BY count(*) DESC, dst_ip) AS rn
      FROM q_day GROUP BY src_ip, dst_ip) WHERE rn = 1) t ON t.src_ip = s.src_ip
WHERE s.distinct_dst >= 15 AND s.distinct_dport >= 15
"""
from checks.sqlparts import part  # noqa: E402

part("q_day", f"SELECT *, CAST(floor((ts_start - (SELECT min(ts_start) FROM q_flows)) / {DAY}) AS BIGINT) AS w FROM q_flows")
part("q_auth", f"""
SELECT '10.9.0.' || CAST(flow_id % 3 AS VARCHAR) AS src_ip, '10.8.0.' || CAST(flow_id % 2 AS VARCHAR) AS dst_ip, ts_start, flow_id, w,
  ([22, 22, 21, 80, 443])[dport // 41 % 5 + 1] AS dport FROM q_day""")
_BRUTE = """
SELECT src_ip AS src, dst_ip AS dst, CAST(port AS BIGINT) AS port, service, n AS auth_flows, total, onset_window FROM (
  SELECT g.src_ip, g.dst_ip, p.port, p.service, g.n, t.total, coalesce(b.w, g.first_w) AS onset_window,
    row_number() OVER (PARTITION BY g.src_ip, g.dst_ip ORDER BY p.ord) AS rn
  FROM (SELECT src_ip, dst_ip, dport, count(*) AS n, arg_min(w, (ts_start, flow_id)) AS first_w FROM q_auth GROUP BY ALL) g
  JOIN (VALUES (22, 'SSH', 0), (21, 'FTP', 1), (3389, 'RDP', 2), (23, 'Telnet', 3)) p(port, service, ord) ON p.port = g.dport
  JOIN (SELECT src_ip, dst_ip, count(*) AS total FROM q_auth GROUP BY ALL) t ON t.src_ip = g.src_ip AND t.dst_ip = g.dst_ip
  LEFT JOIN (SELECT src_ip, dst_ip, dport, min(w) AS w FROM (SELECT src_ip, dst_ip, dport, w FROM q_auth GROUP BY ALL HAVING count(*) >= 15)
             GROUP BY ALL) b ON b.src_ip = g.src_ip AND b.dst_ip = g.dst_ip AND b.dport = g.dport
  WHERE g.n >= 40 AND g.n >= 0.35 * t.total) WHERE rn = 1
"""
oracle("scan_detect", _SCAN)
oracle("brute_detect", _BRUTE)
oracle("campaign_rows", f"""
SELECT name, stage, src, dst, greatest(1, greatest(2, onset_window) - 2) AS alert_step,
  greatest(greatest(1, greatest(2, onset_window) - 2) + 1, greatest(2, onset_window)) AS onset_step,
  (greatest(greatest(1, greatest(2, onset_window) - 2) + 1, greatest(2, onset_window)) - greatest(1, greatest(2, onset_window) - 2)) * {DAY} AS lead_s
FROM (SELECT 'Network service scan' AS name, 1 AS stage, src, dst, onset_window FROM ({_SCAN})
      UNION ALL SELECT service || ' brute force', 2, src, dst, onset_window FROM ({_BRUTE}))
ORDER BY alert_step, src, stage, dst LIMIT 4
""")
oracle("window_count", f"SELECT CAST(greatest(12, least(40, floor((max(ts_start) - min(ts_start)) / {DAY}) + 2)) AS INTEGER) AS n_windows FROM q_flows")

part("q_sched", """
SELECT *, row_number() OVER (PARTITION BY attacker ORDER BY day, label) AS no FROM
  (SELECT src_ip AS attacker, floor(ts_end / 86400) AS day, label, min(ts_end) AS lo, max(ts_end) + 30 AS hi, max(dst_ip) AS tgt
   FROM q_flows WHERE label <> 'BENIGN' GROUP BY ALL)""")
oracle("label_schedule", """
SELECT f.flow_id, coalesce(arg_max(s.label, s.no), 'BENIGN') AS label FROM q_flows f
LEFT JOIN q_sched s ON s.attacker = f.src_ip AND f.ts_end BETWEEN s.lo AND s.hi AND (CAST(s.day AS BIGINT) % 2 = 0 OR f.dst_ip = s.tgt)
GROUP BY f.flow_id
""")
K = "dataset, capture"
oracle("keyed_windows", f'SELECT {K}, host, segment, "window", t, {rcols(S.FEATURES)}, stage, label, attack_out FROM q_kfull')
oracle("episode_fill", f'SELECT {K}, host, segment, "window", stage, episode_stage FROM q_kepi')
oracle("sequence_starts", f'SELECT {K}, host, segment, "window", block, split FROM q_kstarts')
oracle("future_target", f'SELECT {K}, host, segment, "window", split, y_future, y_now, hist_attack, lead, touches, recon, attack_rows FROM q_kseq')
oracle("balance_sample", f"""
SELECT {K}, host, "window", touches FROM q_kseq WHERE split = 'train' AND (touches > 0 OR
  CAST('0x' || substr(md5('7|keep|' || dataset || '|' || capture || '|' || host || '|' || CAST("window" AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.15)
""")
oracle("sequence_weights", f"""
SELECT {K}, host, "window", {r('1.0 / count(*) OVER (PARTITION BY dataset, touches) / (SELECT count(DISTINCT (dataset, touches)) FROM q_kseq WHERE split = $$train$$)', 9)} AS weight,
  {r('1 + 4 * CASE WHEN hist_attack = 0 AND y_future > 0 THEN 1 ELSE 0 END + 10 * recon', 9)} AS emphasis
FROM q_kseq WHERE split = 'train'
""")
oracle("positive_weight", f"""
SELECT {r('p')} AS positive_share, {r('least(20.0, (1 - p) / greatest(p, 1e-6))')} AS pos_weight
FROM (SELECT sum(attack_rows / 15.0) / count(*) AS p FROM q_kseq WHERE split = 'train')
""")
oracle("history_pad", "SELECT host, segment, \"window\", " + ", ".join(
    f"list_value({', '.join(r(f'coalesce(lag({c}, {9 - i}) OVER g, {-1.0 - k})') for k, c in enumerate(S.FEATURES))}) AS h{i}" for i in range(10))
    + ' FROM q_frame WINDOW g AS (PARTITION BY host, segment ORDER BY "window")')

oracle("scaler_stats", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, " + ("max(0.0)::DOUBLE AS mean, max(1.0)::DOUBLE AS std" if f in S.MASK_FEATURES else
    f"{r(f'avg({x})')} AS mean, {r(f'stddev_pop({x}) + 1e-6')} AS std") + " FROM q_frame"
    for f in S.FEATURES for x in [f"ln(1 + greatest({f}, 0))" if f in S.LOG_FEATURES else f]))
part("q_scale", "SELECT " + ", ".join(
    f"avg({x}) AS m_{f}, stddev_pop({x}) + 1e-6 AS s_{f}" for f in S.FEATURES if f not in S.MASK_FEATURES
    for x in [f"ln(1 + greatest({f}, 0))" if f in S.LOG_FEATURES else f]) + " FROM q_frame")
oracle("scaled_features", 'SELECT host, "window", ' + ", ".join(
    f"{r(f, 5)} AS {f}" if f in S.MASK_FEATURES else
    f"{r(f'greatest(-10.0, least(10.0, ({x} - m_{f}) / s_{f}))', 5)} AS {f}"
    for f in S.FEATURES for x in [f"ln(1 + greatest({f}, 0))" if f in S.LOG_FEATURES else f])
    + " FROM q_frame CROSS JOIN q_scale")
_VALUES = [f for f in S.FEATURES if f not in S.MASK_FEATURES]
part("q_klog", f'SELECT {K}, host, "window", out_flows + in_flows > 0 AS act, ' + ", ".join(
    f"{'ln(1 + ' + f + ')' if f in S.LOG_FEATURES else f} AS {f}" for f in S.FEATURES) + " FROM q_kfull")
part("q_kquart", f"SELECT {K}, " + ", ".join(f"quantile_cont({f}, [0.25, 0.5, 0.75]) AS {f}" for f in _VALUES)
     + f" FROM (SELECT *, count(*) FILTER (act) OVER (PARTITION BY {K}) AS na FROM q_klog) WHERE act OR na < 5 GROUP BY {K}")
oracle("capture_norm", f'SELECT l.dataset, l.capture, l.host, l."window", ' + ", ".join(
    r(f"l.{f}" if f in S.MASK_FEATURES else f"(l.{f} - q.{f}[2]) / greatest(q.{f}[3] - q.{f}[1], 0.25)", 5) + f" AS {f}" for f in S.FEATURES)
    + " FROM q_klog l JOIN q_kquart q ON q.dataset = l.dataset AND q.capture = l.capture")
oracle("dataset_stats", f"""
SELECT f.*, w.hosts, w.windows, w.attack_windows FROM
  (SELECT {K}, count(*) AS flows, count(*) FILTER (stage > 0) AS attack_flows FROM q_kflows GROUP BY {K}) f
JOIN (SELECT {K}, count(DISTINCT host) AS hosts, count(*) AS windows, count(*) FILTER (stage > 0) AS attack_windows FROM q_kframe GROUP BY {K}) w
ON w.dataset = f.dataset AND w.capture = f.capture
""")
oracle("top_labels", f"""
SELECT * FROM (SELECT {K}, label, count(*) AS flows, CAST(row_number() OVER (PARTITION BY {K} ORDER BY count(*) DESC, label) AS INTEGER) AS rank
FROM q_kflows GROUP BY {K}, label) WHERE rank <= 12""")
oracle("stage_windows", """
SELECT dataset, stage, count(*) AS windows, (['BENIGN', 'RECONNAISSANCE', 'INITIAL_ACCESS', 'LATERAL_MOVEMENT',
  'COMMAND_AND_CONTROL', 'EXFILTRATION', 'IMPACT'])[stage + 1] AS stage_name FROM q_kframe GROUP BY dataset, stage""")
oracle("typical", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(quantile_cont({f}, 0.5), 4) AS typical FROM q_frame WHERE out_flows + in_flows > 0" for f in S.FEATURES))

# ------------------------------------------------------------------ evaluation
def _pr(y: str, score: str, by: str) -> str:
    g = f"PARTITION BY {by} " if by else ""
    return f"""SELECT *, sum(pos) OVER ({g}ORDER BY score DESC) AS cp, sum(n) OVER ({g}ORDER BY score DESC) AS cn,
      sum(pos) OVER ({g.strip()}) AS tot FROM (SELECT {by + ',' if by else ''} {score} AS score, count(*) AS n, sum({y}) AS pos
      FROM q_kseq GROUP BY {by + ',' if by else ''} {score})"""


oracle("persistence_metrics", f"""
SELECT m.*, round(a.pr_auc, 4) AS pr_auc FROM (
  SELECT dataset, tp, fp, fn, tn, positives, n, round(tp / greatest(tp + fp, 1), 4) AS precision, round(tp / greatest(tp + fn, 1), 4) AS recall,
    round(2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-12), 4) AS f1,
    round(fp / greatest(fp + tn, 1), 5) AS fpr, CAST(0.5 AS DOUBLE) AS threshold
  FROM (SELECT dataset, count(*) FILTER (y_now >= 0.5 AND y_future > 0) AS tp, count(*) FILTER (y_now >= 0.5 AND y_future = 0) AS fp,
    count(*) FILTER (y_now < 0.5 AND y_future > 0) AS fn, count(*) FILTER (y_now < 0.5 AND y_future = 0) AS tn,
    count(*) FILTER (y_future > 0) AS positives, count(*) AS n FROM q_kseq GROUP BY dataset)) m
JOIN (SELECT dataset, sum(pos / tot * (cp / cn)) AS pr_auc FROM ({_pr('y_future', 'y_now', 'dataset')}) GROUP BY dataset) a USING (dataset)
""")
oracle("average_precision", f"SELECT dataset, {r('sum(pos / tot * (cp / cn))')} AS pr_auc FROM ({_pr('y_future', 'score', 'dataset')}) GROUP BY dataset")
oracle("macro_ap", f"SELECT {r('avg(a)')} AS macro_pr_auc FROM (SELECT sum(pos / tot * (cp / cn)) AS a FROM ({_pr('y_future', 'score', 'dataset')}) GROUP BY dataset)")
oracle("pick_threshold", f"""
SELECT {r('score')} AS threshold, {r('f1')} AS f1 FROM (SELECT score, 2 * (cp / cn) * (cp / tot) / greatest(cp / cn + cp / tot, 1e-12) AS f1
FROM ({_pr('y_future', 'score', '')})) ORDER BY f1 DESC, score LIMIT 1""")
oracle("pick_threshold_macro", f"""
SELECT {r('cand')} AS threshold, {r('round(m, 12)')} AS mean_f1 FROM (
  SELECT cand, avg(f) AS m FROM (
    SELECT c.cand, s.dataset, 2.0 * count(*) FILTER (score >= cand AND y_future > 0) / greatest(2 * count(*) FILTER (score >= cand AND y_future > 0)
      + count(*) FILTER (score >= cand AND y_future = 0) + count(*) FILTER (score < cand AND y_future > 0), 1) AS f
    FROM q_kseq s CROSS JOIN (SELECT DISTINCT unnest(quantile_cont(score, {[i / 100 for i in range(101)]})) AS cand FROM q_kseq WHERE y_future > 0) c
    GROUP BY c.cand, s.dataset HAVING count(*) FILTER (y_future > 0) > 0) GROUP BY cand)
ORDER BY round(m, 12) DESC, cand LIMIT 1""")
oracle("onset_metrics", """
SELECT count(*) FILTER (o) AS onsets, round(count(*) FILTER (o AND score >= 0.2) / count(*) FILTER (o), 4) AS early_warning_recall,
  round(count(*) FILTER (q AND score >= 0.2) / count(*) FILTER (q), 5) AS quiet_false_alarm_rate,
  quantile_cont(CASE WHEN o AND score >= 0.2 THEN lead * 3600.0 END, 0.5)::DOUBLE AS median_lead_s,
  round(avg(CASE WHEN o AND score >= 0.2 THEN lead * 3600.0 END), 1) AS mean_lead_s
FROM (SELECT *, y_future > 0 AND hist_attack = 0 AS o, y_future = 0 AND hist_attack = 0 AS q FROM q_kseq)
""")
oracle("transition_table", f"SELECT from_stage, to_stage, n, {r('p', 9)} AS p FROM q_trans")
oracle("markov_rollout", f"SELECT s AS start_stage, CAST(k AS INTEGER) AS step, z AS stage, {r('p', 9)} AS p FROM q_rolled")
oracle("calibrate", f"""
SELECT host, "window", {r('1 / (1 + exp(-(1.7 * ln(q / (1 - q)) - 0.4)))')} AS p
FROM (SELECT host, "window", least(greatest(out_failed_ratio, 1e-6), 1 - 1e-6) AS q FROM q_frame)""")

# ------------------------------------------------------------------ alerts
part("q_host", f"""
SELECT f.host, a.first_alert_step, min(step) FILTER (stage = 1) AS recon, min(step) FILTER (stage >= 2) AS comp,
  min(step) FILTER (stage > 0) AS atk, max(risk) AS peak, CAST(sum(out_flows + in_flows) AS BIGINT) AS flows,
  count(*) FILTER (stage > 0) AS truth, arg_min(mapped, (-risk, step)) AS st,
  min(step) FILTER (stage = 2) AS brute, min(step) FILTER (risk >= {THR}) AS single
FROM q_fc f LEFT JOIN q_alert a ON a.host = f.host GROUP BY f.host, a.first_alert_step""")
part("q_hit", f"""
SELECT h.host, min(f.step) AS hit FROM q_host h JOIN q_fc f ON f.host = h.host AND f.step BETWEEN coalesce(h.comp, h.atk) - 5 AND coalesce(h.comp, h.atk) - 1
WHERE f.future[coalesce(h.comp, h.atk) - f.step] >= {THR} GROUP BY h.host""")
oracle("first_alert", "SELECT host, CAST(coalesce(first_alert_step, -1) AS INTEGER) AS first_alert_step FROM q_host")
oracle("overview", """
SELECT h.host, round(peak, 4) AS peak, CAST(coalesce(first_alert_step, -1) AS INTEGER) AS first_alert_step, st AS stage, (['BENIGN', 'RECONNAISSANCE', 'INITIAL_ACCESS',
  'LATERAL_MOVEMENT', 'COMMAND_AND_CONTROL', 'EXFILTRATION', 'IMPACT'])[st + 1] AS stage_name, flows, truth AS truth_attack_steps,
  CAST(coalesce(comp, -1) AS INTEGER) AS first_compromise_step, CAST(coalesce((comp - first_alert_step) * 3600, -1) AS INTEGER) AS compromise_lead_s,
  CAST(coalesce((coalesce(comp, atk) - hit) * 3600, -1) AS INTEGER) AS forecast_lead_s FROM q_host h LEFT JOIN q_hit USING (host)""")
oracle("lead_times", f"""
SELECT h.host, CAST(coalesce(first_alert_step, -1) AS INTEGER) AS first_alert_step,
  CAST(coalesce(3600 * CASE WHEN list_max(f.future) >= 0.5 THEN list_position(list_transform(f.future, lambda x: x >= 0.5), true)
    ELSE list_position(f.future, list_max(f.future)) END, -1) AS INTEGER) AS predicted_compromise_s_after_alert,
  CAST(coalesce(recon, -1) AS INTEGER) AS first_recon_step, CAST(coalesce(comp, -1) AS INTEGER) AS first_compromise_step, CAST(coalesce(coalesce(comp, recon), -1) AS INTEGER) AS actual_first_attack_step,
  CAST(coalesce(hit, -1) AS INTEGER) AS forecast_hit_step, CAST(coalesce((coalesce(comp, recon) - first_alert_step) * 3600, -1) AS INTEGER) AS lead_time_s,
  CAST(coalesce((comp - first_alert_step) * 3600, -1) AS INTEGER) AS compromise_lead_s, CAST(coalesce((coalesce(comp, recon) - hit) * 3600, -1) AS INTEGER) AS forecast_lead_s,
  coalesce(recon < comp, false) AS recon_before_compromise
FROM q_host h LEFT JOIN q_hit USING (host) LEFT JOIN q_fc f ON f.host = h.host AND f.step = h.first_alert_step""")
oracle("lead_time_check", """
SELECT h.host, CAST(coalesce(single, -1) AS INTEGER) AS first_alert_step, CAST(coalesce(brute, -1) AS INTEGER) AS first_brute_step,
  CAST(coalesce((brute - single) * 3600, -1) AS INTEGER) AS lead_s, coalesce(f.stage = 1, false) AS recon_at_alert
FROM q_host h LEFT JOIN q_fc f ON f.host = h.host AND f.step = h.single""")

# ------------------------------------------------------------------ counterfactuals
_MID = "(SELECT floor((min(ts_end) + max(ts_end)) / 2) FROM q_flows)"
oracle("counterfactual_block", f"""
SELECT flow_id, src_ip, dst_ip FROM q_flows WHERE NOT ((src_ip = '10.0.0.5' OR dst_ip = '10.0.0.5') AND ts_end >= {_MID})""")
oracle("counterfactual_throttle", f"""
SELECT flow_id, src_ip, dst_ip FROM (SELECT *, (src_ip = '10.0.0.5' OR dst_ip = '10.0.0.5') AND ts_end >= {_MID} AS hit FROM q_flows)
WHERE NOT hit UNION ALL
SELECT flow_id, src_ip, dst_ip FROM (SELECT *, row_number() OVER (ORDER BY ts_end, flow_id) AS rn FROM q_flows
WHERE (src_ip = '10.0.0.5' OR dst_ip = '10.0.0.5') AND ts_end >= {_MID}) WHERE (rn - 1) % 10 = 0""")

# ------------------------------------------------------------------ boards
part("q_dec", """
SELECT host, kind, CASE WHEN kind = 'monitor' THEN 'reject' ELSE 'accept' END AS choice, made, kind <> 'monitor' AND n % 3 > 0 AS applied,
  kind || ' ' || host AS action_label, peer, host AS target FROM
  (SELECT src_ip AS host, count(*) AS n, max(ts_end) AS made, max(dst_ip) AS peer,
     (['block_source', 'isolate_host', 'rate_limit', 'block_pair', 'monitor'])[count(*) % 5 + 1] AS kind
   FROM q_flows WHERE label <> 'BENIGN' GROUP BY src_ip)""")
part("q_over", """
SELECT h.host, round(peak, 4) AS peak, first_alert_step, st, (['BENIGN', 'RECONNAISSANCE', 'INITIAL_ACCESS',
  'LATERAL_MOVEMENT', 'COMMAND_AND_CONTROL', 'EXFILTRATION', 'IMPACT'])[st + 1] AS stage_name,
  (comp - first_alert_step) * 3600 AS clead, recon, comp, coalesce(comp, recon) AS a0 FROM q_host h""")
oracle("event_feed", """
SELECT made AS "at", kind, text FROM (
  SELECT first_alert_step * 3600.0 AS made, 'alert' AS kind, 'forecast alert on ' || host || ' - ' || stage_name || ' (' ||
    CAST(CAST(round_even(peak * 100, 0) AS INTEGER) AS VARCHAR) || '%)' AS text FROM q_over WHERE first_alert_step IS NOT NULL
  UNION ALL SELECT made, 'decision', upper(choice) || ' on ' || host || ' - ' || action_label || ' (' ||
    CASE WHEN applied THEN 'applied' WHEN choice = 'reject' THEN 'rejected' ELSE 'not enforced' END || ')' FROM q_dec)
ORDER BY made DESC, kind, text LIMIT 400""")
oracle("campaign_board", f"""
SELECT host, stage_name, peak, CAST(coalesce(first_alert_step, -1) AS INTEGER) AS first_alert_step,
  CAST(coalesce(CASE WHEN clead > 0 THEN clead END, -1) AS INTEGER) AS lead_s,
  CASE WHEN host IN (SELECT host FROM q_dec WHERE applied AND kind IN ('block_source', 'isolate_host')) THEN 'contained' ELSE 'alerting' END AS status
FROM q_over WHERE first_alert_step IS NOT NULL OR peak >= {THR} ORDER BY peak DESC, host LIMIT 10""")
oracle("causal_status", """
SELECT count(*) AS alerting_hosts, CAST(coalesce(min(first_alert_step), -1) AS INTEGER) AS first_alert_step,
  CAST(coalesce((SELECT clead FROM q_over WHERE first_alert_step <= 300 ORDER BY first_alert_step, peak DESC, host LIMIT 1), -1) AS INTEGER) AS first_lead_s,
  CAST(coalesce(max(clead) FILTER (clead <> 0), -1) AS INTEGER) AS best_lead_s FROM q_over WHERE first_alert_step <= 300""")
oracle("incident_rows", f"""
SELECT host, stage_name, peak, peak >= {THR} AS above, 't+' || CAST(CAST(first_alert_step * 60 AS BIGINT) AS VARCHAR) || ' min' AS first_alert,
  CASE WHEN recon < comp AND clead > 0 THEN '+' || CAST(clead AS VARCHAR) || 's (' || CAST(clead // 60 AS VARCHAR) || ' min) during recon'
       WHEN a0 IS NOT NULL THEN 'at onset' ELSE '-' END AS early_warning
FROM q_over WHERE first_alert_step IS NOT NULL ORDER BY first_alert_step, peak DESC, host LIMIT 12""")
oracle("eligibility", """
SELECT host, kind, CASE WHEN kind = 'monitor' THEN false WHEN kind IN ('block_source', 'isolate_host', 'block_pair', 'rate_limit')
    AND (host IN ('10.0.0.5', '10.0.0.7') OR peer IN ('10.0.0.5', '10.0.0.7')) THEN false ELSE true END AS applied,
  CASE WHEN kind = 'monitor' THEN 'Monitor only - nothing applied.'
    WHEN host IN ('10.0.0.5', '10.0.0.7') AND peer IN ('10.0.0.5', '10.0.0.7') THEN 'Refused: [''' || host || ''', ''' || peer || '''] is a protected management address.'
    WHEN host IN ('10.0.0.5', '10.0.0.7') THEN 'Refused: [''' || host || '''] is a protected management address.'
    WHEN peer IN ('10.0.0.5', '10.0.0.7') THEN 'Refused: [''' || peer || '''] is a protected management address.'
    ELSE 'Rule applied on the sensor.' END AS message,
  CASE WHEN kind = 'monitor' OR host IN ('10.0.0.5', '10.0.0.7') OR peer IN ('10.0.0.5', '10.0.0.7') THEN -1 ELSE made + 300 END::DOUBLE AS expires_at
FROM q_dec""")
part("q_force", "SELECT * FROM q_dec WHERE applied AND (SELECT max(made) - 150 FROM q_dec) < made + 172800")
oracle("containment", """
SELECT host, bool_or(b) AS neutralised FROM (
  SELECT unnest([target, peer]) AS host, kind <> 'rate_limit' AS b FROM q_force
  UNION ALL SELECT f.dst_ip, a.kind <> 'rate_limit' FROM q_flows f JOIN q_force a ON a.target = f.src_ip
  UNION ALL SELECT f.src_ip, a.kind <> 'rate_limit' FROM q_flows f JOIN q_force a ON a.target = f.dst_ip
  UNION ALL SELECT dst_ip, true FROM (SELECT src_ip, dst_ip, count(*) AS n, sum(count(*)) OVER (PARTITION BY dst_ip) AS t FROM q_flows GROUP BY src_ip, dst_ip)
    WHERE n / t > 0.5 AND src_ip IN (SELECT target FROM q_force WHERE kind IN ('block_source', 'isolate_host')))
GROUP BY host""")
part("q_epi", """
SELECT * FROM (SELECT arg_min(src_ip, (-n, src_ip)) AS s FROM (SELECT src_ip, count(*) AS n FROM q_flows WHERE label = 'PortScan' GROUP BY src_ip))
CROSS JOIN (SELECT min(ts_start) AS t FROM q_flows WHERE label = 'PortScan')""")
part("q_epd", """
SELECT e.s, e.t, (SELECT dst_ip FROM q_flows WHERE label = 'PortScan' AND src_ip = e.s GROUP BY dst_ip ORDER BY count(*) DESC, dst_ip LIMIT 1) AS d FROM q_epi e""")
_REN = ", ".join(f"CASE {c} WHEN e.s THEN CASE i WHEN 0 THEN '10.13.37.5' ELSE '10.13.' || CAST(37 + i AS VARCHAR) || '.5' END "
                 f"WHEN e.d THEN '10.20.' || CAST(i AS VARCHAR) || '.11' ELSE {c} END AS {c}" for c in ("src_ip", "dst_ip"))
oracle("remap_compose", f"""
SELECT flow_id, {r('ts_start - e.t + 600 + i * 1920.0', 4)} AS ts_start, {r('ts_end - e.t + 600 + i * 1920.0', 4)} AS ts_end, {_REN},
  CASE WHEN {stage_case('label')} >= 2 THEN 'Exfiltration' ELSE label END AS label
FROM q_flows CROSS JOIN q_epd e CROSS JOIN (VALUES (0), (1), (2)) AS rep(i)
WHERE (src_ip IN (e.s, e.d) OR dst_ip IN (e.s, e.d)) AND ts_start BETWEEN e.t - 86400 AND e.t + 432000""")
part("q_top1", "SELECT src_ip AS s, dst_ip AS d FROM q_flows WHERE src_ip <> dst_ip GROUP BY src_ip, dst_ip ORDER BY count(*) DESC, src_ip, dst_ip LIMIT 1")
oracle("scenario_compose", f"""
SELECT flow_id, {r('ts_start - min(ts_start) OVER ()', 4)} AS ts_start, {r('ts_end - min(ts_start) OVER ()', 4)} AS ts_end,
  CASE src_ip WHEN s THEN '10.50.0.11' ELSE '10.60.0.11' END AS src_ip, CASE dst_ip WHEN s THEN '10.50.0.11' ELSE '10.60.0.11' END AS dst_ip,
  CASE WHEN label <> 'BENIGN' AND label <> 'PortScan' THEN 'Botnet beacon' ELSE label END AS label
FROM q_flows, q_top1 WHERE src_ip IN (s, d) AND dst_ip IN (s, d)""")
oracle("clock_slice", "SELECT flow_id FROM q_flows WHERE ts_start - floor(ts_start / 86400) * 86400 BETWEEN 33900 AND 37500")

oracle("offset_slice", """
SELECT flow_id FROM q_flows WHERE ts_start - (SELECT min(ts_start) FROM q_flows) BETWEEN 86400 AND 172800""")
oracle("campaign_compose", f"""
SELECT flow_id, {r('ts_start - min(ts_start) OVER ()', 4)} AS ts_start, {r('ts_end - min(ts_start) OVER ()', 4)} AS ts_end,
  replace(src_ip, '10.0.', '10.99.') AS src_ip, replace(dst_ip, '10.0.', '10.99.') AS dst_ip, label
FROM q_flows WHERE regexp_matches(src_ip, '^10[.]0[.]0[.]([1-3]?[0-9])$') AND regexp_matches(dst_ip, '^10[.]0[.]0[.]([1-3]?[0-9])$')""")
part("q_chain3", " UNION ALL ".join(f"""
SELECT {i} AS i, '{label}' AS lab, p.s, p.t, (SELECT dst_ip FROM q_flows WHERE label = '{label}' AND src_ip = p.s
  GROUP BY dst_ip ORDER BY count(*) DESC, dst_ip LIMIT 1) AS d
FROM (SELECT (SELECT src_ip FROM q_flows WHERE label = '{label}' GROUP BY src_ip ORDER BY count(*) DESC, src_ip LIMIT 1) AS s,
  (SELECT min(ts_start) FROM q_flows WHERE label = '{label}') AS t) p""" for i, label in enumerate(("PortScan", "SSH-Patator", "Exfiltration"))))
oracle("episode_chain", f"""
SELECT flow_id, {r('ts_start - e.t + 600 + i * 86400.0', 4)} AS ts_start, {r('ts_end - e.t + 600 + i * 86400.0', 4)} AS ts_end,
  CASE src_ip WHEN e.s THEN '10.13.37.5' WHEN e.d THEN '10.20.0.11' ELSE src_ip END AS src_ip,
  CASE dst_ip WHEN e.s THEN '10.13.37.5' WHEN e.d THEN '10.20.0.11' ELSE dst_ip END AS dst_ip, label
FROM q_flows JOIN q_chain3 e ON src_ip IN (e.s, e.d) OR dst_ip IN (e.s, e.d)
WHERE ts_start BETWEEN e.t - 30 AND e.t + 432000""")
oracle("display_risk", f"""
SELECT "window", host, {r('risk')} AS risk, {r("risk * CASE WHEN host IN ('10.0.0.5', '10.0.0.7') THEN 0.08 ELSE 1 END")} AS risk_display FROM q_fc""")
oracle("campaign_check", """
SELECT *, positive_leads >= 7 AND out_of_range = 0 AND alert_steps >= 2 AS valid FROM (
  SELECT count(*) FILTER (lead > 0) AS positive_leads, count(*) FILTER (lead > 0 AND lead NOT BETWEEN 3600 AND 1080000) AS out_of_range,
    count(DISTINCT CASE WHEN lead > 0 THEN first_alert_step END) AS alert_steps
  FROM (SELECT *, (comp - first_alert_step) * 3600 AS lead FROM q_host))""")
oracle("packet_dropout", f"""
SELECT {K}, host, "window", CASE WHEN CAST('0x' || substr(md5('7|dropout|' || dataset || '|' || capture || '|' || host || '|' || CAST("window" AS VARCHAR)), 1, 8) AS BIGINT)
    / 4294967296.0 < 0.5 THEN list_value({", ".join('0.0' if f in S.PACKET_FEATURES + S.MASK_FEATURES else r(f) for f in S.FEATURES)})
  ELSE list_value({", ".join(r(f) for f in S.FEATURES)}) END AS v FROM q_kfull""")
_ENDS = "src_ip, dst_ip, sport, dport, proto"
oracle("load_cic_files", f"""
SELECT s AS ts_start, {r('s + round((ts_end - ts_start) * 1e6) / 1e6')} AS ts_end, {_ENDS}, fwd_pkts, bwd_pkts, fwd_bytes, bwd_bytes, syn, rst, fin,
  -1.0::DOUBLE AS ttl, coalesce(tcp_win, -1) AS tcp_win, -1.0::DOUBLE AS retrans, label FROM (SELECT *, floor(ts_start) AS s FROM q_flows)""")
oracle("load_argus_files", f"""
SELECT {r('floor(ts_start * 1e6) / 1e6')} AS ts_start, {r('floor(ts_start * 1e6) / 1e6 + round(ts_end - ts_start, 6)')} AS ts_end, {_ENDS},
  CAST(greatest(1, round_even(n * share, 0)) AS DOUBLE) AS fwd_pkts, CAST(round_even(n * (1 - share), 0) AS DOUBLE) AS bwd_pkts, fwd_bytes, bwd_bytes,
  CASE WHEN proto = 'tcp' THEN syn ELSE 0 END AS syn, CASE WHEN proto = 'tcp' THEN rst ELSE 0 END AS rst, CASE WHEN proto = 'tcp' THEN fin ELSE 0 END AS fin,
  -1.0::DOUBLE AS ttl, -1.0::DOUBLE AS tcp_win, -1.0::DOUBLE AS retrans, 'flow=From-' || label AS label
FROM (SELECT *, fwd_pkts + bwd_pkts AS n, CASE WHEN fwd_bytes + bwd_bytes > 0 THEN fwd_bytes / (fwd_bytes + bwd_bytes) ELSE 1.0 END AS share FROM q_flows)""")
oracle("load_unsw_files", f"""
SELECT floor(ts_start) AS ts_start, floor(ts_end) AS ts_end, {_ENDS}, fwd_pkts, bwd_pkts, fwd_bytes, bwd_bytes,
  CASE WHEN proto = 'tcp' AND (rst > 0 OR fin > 0) THEN 1 ELSE 0 END AS syn, CASE WHEN rst > 0 THEN 1 ELSE 0 END AS rst,
  CASE WHEN fin > 0 AND rst = 0 THEN 1 ELSE 0 END AS fin, coalesce(ttl, -1) AS ttl, CASE WHEN proto = 'tcp' THEN coalesce(tcp_win, -1) ELSE -1.0 END AS tcp_win,
  CASE WHEN proto = 'tcp' THEN coalesce(retrans, -1) ELSE -1.0 END AS retrans, label FROM q_flows""")
oracle("load_canonical_files", f"""
SELECT {r('ts_start')} AS ts_start, {r('ts_end')} AS ts_end, {_ENDS}, fwd_pkts, bwd_pkts, fwd_bytes, bwd_bytes, syn, rst, fin, coalesce(ttl, -1) AS ttl,
  coalesce(tcp_win, -1) AS tcp_win, coalesce(retrans, -1) AS retrans, label FROM q_flows""")

# ------------------------------------------------------------------ replay: the same parts on the filtered flows
import re as _re  # noqa: E402

from checks.sqlparts import PARTS  # noqa: E402

_CHAIN = ["q_cut", "q_out", "q_in", "q_outagg", "q_inagg", "q_entropy", "q_peers", "q_packet", "q_label", "q_segments",
          "q_active", "q_grid", "q_frame"]
_REPLAY_T = "(SELECT min(t) + 300 * 3600 FROM q_frame)"
part("qb_flows", f"SELECT * FROM q_flows WHERE NOT ((src_ip = '10.0.0.5' OR dst_ip = '10.0.0.5') AND ts_end >= {_REPLAY_T})")


def _branch(sql: str) -> str:
    keep = _re.sub(r"\(SELECT floor\(min\(ts_end\) / 3600\) \* 3600 FROM q_flows\)", "(SELECT floor(min(ts_end) / 3600) * 3600 FROM q_ORIG)", sql)
    for n in ["q_flows", *_CHAIN]:
        keep = _re.sub(rf"\b{n}\b", "q_b" + n[2:], keep)
    return keep.replace("q_ORIG", "q_flows")


PARTS["q_bflows"] = PARTS.pop("qb_flows")
for _n in _CHAIN:
    PARTS["q_b" + _n[2:]] = _branch(PARTS[_n])
part("q_both", """
SELECT 'without_action' AS branch, f.host, f."window" AS w, list_max(b.future) AS risk FROM q_frame f JOIN q_bystage b ON b.s = f.stage
UNION ALL SELECT 'with_action', f.host, f."window", list_max(b.future) FROM q_bframe f JOIN q_bystage b ON b.s = f.stage""")
oracle("branch_timeline", f"""
SELECT f.host, CAST(f."window" - (SELECT min("window") FROM q_frame) AS INTEGER) AS step, {r('list_max(b.future)')} AS risk,
  CAST(CASE WHEN list_max(b.future) < {THR} * 0.5 THEN 0 ELSE list_position(m.m[2:7], list_max(m.m[2:7])) END AS INTEGER) AS raw_stage,
  CAST(CASE WHEN f.stage = 0 THEN 0 ELSE list_position(b.probs[1][2:7], list_max(b.probs[1][2:7])) END AS INTEGER) AS stage_now
FROM q_bframe f JOIN q_bystage b ON b.s = f.stage JOIN q_mean m ON m.s = f.stage
WHERE f."window" - (SELECT min("window") FROM q_frame) >= 300""")
part("q_axis", """
SELECT branch, w, coalesce(x.risk, 0.0) AS risk FROM (SELECT unnest(['without_action', 'with_action']) AS branch)
CROSS JOIN (SELECT unnest(range((SELECT min("window") + 300 FROM q_frame), (SELECT max("window") + 1 FROM q_frame))) AS w) g
LEFT JOIN (SELECT branch, w, risk FROM q_both WHERE host = '10.0.0.5') x USING (branch, w)""")
part("q_after", f"""
SELECT 'without_action' AS branch, * FROM q_flows WHERE ts_end >= {_REPLAY_T}
UNION ALL SELECT 'with_action', * FROM q_bflows WHERE ts_end >= {_REPLAY_T}""")
oracle("outcome", f"""
SELECT a.branch, round(max(risk), 4) AS peak_risk, round(avg(risk), 4) AS mean_risk,
  CAST(count(*) FILTER (risk >= {THR}) * 60 AS BIGINT) AS minutes_above_threshold,
  CAST(coalesce((min(w) FILTER (risk < {THR}) - min(w)) * 3600, -1) AS BIGINT) AS risk_below_threshold_after_s,
  any_value(f.av) AS attacker_victim_flows, any_value(f.lab) AS labelled_attack_flows,
  'Block all traffic from 10.0.0.5' AS action_label, true AS applied
FROM q_axis a JOIN (SELECT branch, count(*) FILTER ((src_ip = '10.0.0.5' AND dst_ip IN ('10.0.0.35', '10.0.0.36'))
    OR (dst_ip = '10.0.0.5' AND src_ip IN ('10.0.0.35', '10.0.0.36'))) AS av, count(*) FILTER ({stage_case('label')} > 0) AS lab
  FROM q_after GROUP BY branch) f ON f.branch = a.branch GROUP BY a.branch""")

# ------------------------------------------------------------------ packets: the flow chain as a recursion
part("q_pk", """
SELECT flow_id, CAST(floor(ts_start / 240 * 1e6) AS BIGINT) AS us, k % 3 > 0 AS o, '10.1.0.' || CAST(flow_id % 4 AS VARCHAR) AS lo,
  '10.2.0.' || CAST(flow_id // 4 % 3 AS VARCHAR) AS hi, proto, 40 + k * 10 AS size, 30 + k % 30 AS ttl, k % 2 AS plen,
  CASE WHEN proto = 'tcp' AND k % 4 = 0 THEN 1024 + k END AS win, CASE WHEN proto = 'tcp' THEN k % 6 END AS seq,
  CASE WHEN proto <> 'tcp' THEN '' WHEN k % 5 = 0 THEN 'S' WHEN k % 7 = 0 THEN 'FA' WHEN k % 11 = 0 THEN 'R' ELSE 'A' END AS flags
FROM (SELECT *, dport // 41 AS k FROM q_flows)""")


def _packet_flows(tick: str) -> str:
    before = query("SELECT * FROM q_pk")
    ctes = before[len("WITH "):before.rindex("\nSELECT")]
    return f"""WITH RECURSIVE {ctes},
pko AS MATERIALIZED (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY lo, hi, proto, tick ORDER BY us, flow_id) > 60000000, true) AS opens
  FROM (SELECT *, {tick} AS tick FROM q_pk)),
chain AS (
  SELECT lo, hi, proto, tick, min(us) AS us FROM pko GROUP BY ALL
  UNION ALL
  SELECT c.lo, c.hi, c.proto, c.tick, min(p.us) FROM chain c JOIN pko p ON p.lo = c.lo AND p.hi = c.hi AND p.proto = c.proto AND p.tick = c.tick
    AND p.us > c.us AND (p.us - c.us > 60000000 OR p.opens) GROUP BY ALL)
SELECT {r('fs / 1e6')} AS ts_start, {r('ls / 1e6')} AS ts_end, CASE WHEN fo THEN lo ELSE hi END AS src_ip, CASE WHEN fo THEN hi ELSE lo END AS dst_ip,
  CAST(CASE WHEN proto = 'icmp' THEN 0 WHEN fo THEN 5000 ELSE 80 END AS BIGINT) AS sport,
  CAST(CASE WHEN proto = 'icmp' THEN 0 WHEN fo THEN 80 ELSE 5000 END AS BIGINT) AS dport, proto,
  CAST(fp AS DOUBLE) AS fwd_pkts, CAST(bp AS DOUBLE) AS bwd_pkts, CAST(fb AS DOUBLE) AS fwd_bytes, CAST(bb AS DOUBLE) AS bwd_bytes,
  syn, rst, fin, {r('ttl')} AS ttl, {r('coalesce(win, -1)')} AS tcp_win, CASE WHEN proto = 'tcp' THEN CAST(dat - uni AS DOUBLE) ELSE -1 END AS retrans FROM (
  SELECT lo, hi, proto, fs, max(us) AS ls, any_value(fo) AS fo, count(*) FILTER (o = fo) AS fp, count(*) FILTER (o <> fo) AS bp,
    coalesce(sum(size) FILTER (o = fo), 0) AS fb, coalesce(sum(size) FILTER (o <> fo), 0) AS bb, avg(ttl) FILTER (o = fo) AS ttl,
    avg(win) FILTER (o = fo) AS win, max(CASE WHEN contains(flags, 'S') THEN 1 ELSE 0 END) AS syn, max(CASE WHEN contains(flags, 'R') THEN 1 ELSE 0 END) AS rst,
    max(CASE WHEN contains(flags, 'F') THEN 1 ELSE 0 END) AS fin, count(*) FILTER (plen > 0) AS dat, count(DISTINCT (o, seq)) FILTER (plen > 0) AS uni
  FROM (SELECT p.*, s.us AS fs, first_value(p.o) OVER (PARTITION BY p.lo, p.hi, p.proto, p.tick, s.us ORDER BY p.us, p.flow_id) AS fo
        FROM pko p ASOF JOIN chain s ON s.lo = p.lo AND s.hi = p.hi AND s.proto = p.proto AND s.tick = p.tick AND p.us >= s.us)
  GROUP BY lo, hi, proto, tick, fs)"""


ORACLES["flow_assembly"] = _packet_flows("0")
ORACLES["flow_ticks"] = _packet_flows("us // 150000000")

# ------------------------------------------------------------------ aligned series
part("q_f600", """
SELECT * FROM (SELECT host, w AS "window", count(*) FILTER (d = 0) AS out_flows FROM (
  SELECT src_ip AS host, w, 0 AS d FROM q_c600 UNION ALL SELECT dst_ip, w, 1 FROM q_c600)
  WHERE host IN (SELECT host FROM q_hosts) GROUP BY host, w)""")
part("q_c600", f"""
SELECT *, CAST(floor((ts_end - (SELECT floor(min(ts_end) / 600) * 600 FROM q_flows)) / 600) AS BIGINT) AS w, {stage_case('label')} AS stage FROM q_flows""")
part("q_l600", """
SELECT host, w, stage FROM (SELECT host, w, stage, row_number() OVER (PARTITION BY host, w ORDER BY count(*) DESC, stage, label) AS rn FROM (
  SELECT src_ip AS host, w, stage, label FROM q_c600 WHERE stage > 0 UNION ALL SELECT dst_ip, w, stage, label FROM q_c600 WHERE stage > 0)
  GROUP BY host, w, stage, label) WHERE rn = 1""")
part("q_s600", """
SELECT w, seg, min(w) OVER (PARTITION BY seg) AS lo, max(w) OVER (PARTITION BY seg) AS hi FROM
  (SELECT w, sum(CASE WHEN w - p <= 10 THEN 0 ELSE 1 END) OVER (ORDER BY w) AS seg FROM
    (SELECT w, lag(w) OVER (ORDER BY w) AS p FROM (SELECT DISTINCT w FROM q_c600)))""")
part("q_g600", """
SELECT host, unnest(range(lo, hi + 1)) AS w FROM (SELECT DISTINCT f.host, s.lo, s.hi FROM q_f600 f JOIN q_s600 s ON s.w = f."window")""")
oracle("host_series", """
SELECT h.host, CAST(a.w - m.lo AS INTEGER) AS step, CAST(coalesce(f.out_flows, 0) AS DOUBLE) AS out_flows, coalesce(l.stage, 0) AS stage, g.w IS NOT NULL AS present
FROM (SELECT DISTINCT host FROM q_f600) h CROSS JOIN (SELECT min(w) AS lo, max(w) AS hi FROM q_g600) m
CROSS JOIN LATERAL (SELECT unnest(range(m.lo, m.hi + 1)) AS w) a
LEFT JOIN q_g600 g ON g.host = h.host AND g.w = a.w LEFT JOIN q_f600 f ON f.host = h.host AND f."window" = a.w
LEFT JOIN q_l600 l ON l.host = h.host AND l.w = a.w""")

oracle("stream_features", f"""
SELECT host, (SELECT floor(min(ts_end) / {W}) * {W} FROM q_flows) + w * {W}.0 AS window_start,
  {", ".join(r(f'coalesce({f}, 0)') + f" AS {f}" for f in S.FEATURES if f not in S.MASK_FEATURES)},
  CASE WHEN ttl_mean IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS ttl_mean_mask,
  CASE WHEN tcp_win_mean IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS tcp_win_mean_mask,
  CASE WHEN has_retrans THEN 1.0 ELSE 0.0 END::DOUBLE AS retrans_rate_mask FROM q_active""")

# windows of an hour that begin every half hour, all of them
part("q_slide", """
SELECT *, unnest([floor(ts_end / 1800) * 1800, floor(ts_end / 1800) * 1800 - 1800]) AS s FROM
  (SELECT c.*, min(ts_end) OVER (PARTITION BY src_ip, dst_ip) AS contact FROM q_cut c)""")
part("q_sports", """
SELECT host, s, greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0) AS out_dport_entropy FROM
  (SELECT src_ip AS host, s, dport, count(*) AS n FROM q_slide GROUP BY ALL) GROUP BY host, s""")
part("q_sout", """
SELECT src_ip AS host, s, count(*) AS out_flows, sum(pkts) AS out_pkts, sum(bytes) AS out_bytes, count(DISTINCT dst_ip) AS out_distinct_dst,
  count(DISTINCT dport) AS out_distinct_dport, count(DISTINCT dst_ip) FILTER (contact >= s) AS out_new_peers, avg(failed) AS out_failed_ratio,
  avg(small) AS out_small_flow_ratio, avg(syn) AS out_syn_ratio, avg(dur) AS out_mean_dur, sum(bytes) / greatest(sum(pkts), 1) AS out_mean_pkt_size,
  sum(bwd_bytes) / (sum(fwd_bytes) + 1) AS out_bwd_fwd_ratio, avg(CASE WHEN proto = 'tcp' THEN 1 ELSE 0 END) AS out_tcp_frac,
  avg(CASE WHEN proto = 'udp' THEN 1 ELSE 0 END) AS out_udp_frac, avg(CASE WHEN proto = 'icmp' THEN 1 ELSE 0 END) AS out_icmp_frac,
  avg(CASE WHEN dport < 1024 THEN 1 ELSE 0 END) AS out_wellknown_port_frac FROM q_slide GROUP BY ALL""")
part("q_sin", """
SELECT dst_ip AS host, s, count(*) AS in_flows, sum(pkts) AS in_pkts, sum(bytes) AS in_bytes, count(DISTINCT src_ip) AS in_distinct_src,
  count(DISTINCT dport) AS in_distinct_dport, avg(failed) AS in_failed_ratio, avg(small) AS in_small_flow_ratio, avg(syn) AS in_syn_ratio
FROM q_slide GROUP BY ALL""")
part("q_sboth", """
SELECT host, s, avg(ttl) AS ttl_mean, avg(tcp_win) AS tcp_win_mean,
  coalesce(sum(retrans), 0) / greatest(coalesce(sum(fwd_pkts) FILTER (retrans IS NOT NULL), 0), 1) AS retrans_rate, count(ttl) > 0 AS has_ttl,
  count(tcp_win) > 0 AS has_win, count(retrans) > 0 AS has_rt
FROM (SELECT src_ip AS host, s, ttl, tcp_win, retrans, fwd_pkts FROM q_slide UNION ALL SELECT dst_ip, s, ttl, tcp_win, retrans, fwd_pkts FROM q_slide)
GROUP BY ALL""")
oracle("stream_windows", f"""
SELECT host, CAST(s AS DOUBLE) AS window_start, {", ".join(r(f'coalesce({f}, 0)') + f" AS {f}" for f in S.FEATURES if f not in S.MASK_FEATURES)},
  CAST(has_ttl AS INTEGER)::DOUBLE AS ttl_mean_mask, CAST(has_win AS INTEGER)::DOUBLE AS tcp_win_mean_mask,
  CAST(has_rt AS INTEGER)::DOUBLE AS retrans_rate_mask
FROM q_sboth LEFT JOIN q_sout USING (host, s) LEFT JOIN q_sports USING (host, s) LEFT JOIN q_sin USING (host, s)
""")

# the readings of each host folded in order; an element carries what is held, what waits for a second reading, and the steps so far
part("q_held", f"""
SELECT host, unnest(out) AS x FROM (
  SELECT host, list_reduce(list({{'held': mapped, 'waits': -1, 'step': CAST(step AS BIGINT), 'out': CAST([] AS STRUCT(step BIGINT, held INTEGER)[])}} ORDER BY step),
    lambda a, r: CASE
      WHEN r.held = a.held THEN {{'held': a.held, 'waits': -1, 'step': r.step, 'out': list_append(a.out, {{'step': r.step, 'held': a.held}})}}
      WHEN r.held = 0 OR a.held = 0 THEN {{'held': r.held, 'waits': a.waits, 'step': r.step, 'out': list_append(a.out, {{'step': r.step, 'held': r.held}})}}
      WHEN r.held = a.waits THEN {{'held': r.held, 'waits': -1, 'step': r.step, 'out': list_append(a.out, {{'step': r.step, 'held': r.held}})}}
      ELSE {{'held': a.held, 'waits': r.held, 'step': r.step, 'out': list_append(a.out, {{'step': r.step, 'held': a.held}})}} END,
    {{'held': 0, 'waits': -1, 'step': CAST(-1 AS BIGINT), 'out': CAST([] AS STRUCT(step BIGINT, held INTEGER)[])}}).out AS out
  FROM q_fc GROUP BY host)
""")
_BEST = "list_position(f.kprobs[{k}][2:7], list_max(f.kprobs[{k}][2:7]))"
oracle("stage_hysteresis", f"""
SELECT f.host, CAST(f.step AS INTEGER) AS step, f.mapped AS raw_stage, h.x.held AS held_stage,
  CAST(CASE WHEN f.stage = 0 THEN 0 ELSE {_BEST.format(k=1)} END AS INTEGER) AS stage_now
FROM q_fc f JOIN q_held h ON h.host = f.host AND h.x.step = f.step""")
_AHEAD = ", ".join(f"CASE WHEN f.future[{k}] < {THR} * 0.5 THEN 0 ELSE {_BEST.format(k=k)} END" for k in range(1, 6))
oracle("kill_chain_progress", f"""
SELECT host, reached, CAST(CASE WHEN ahead > reached THEN ahead ELSE -1 END AS INTEGER) AS forecast FROM (
  SELECT f.host, max(greatest(f.stage, h.x.held)) AS reached, max(greatest({_AHEAD})) AS ahead
  FROM q_fc f JOIN q_held h ON h.host = f.host AND h.x.step = f.step GROUP BY f.host)""")

from checks.decision_sql import DECISIONS  # noqa: E402
from checks.live_sql import LIVE  # noqa: E402

for _name, _sql in {**DECISIONS, **LIVE}.items():
    oracle(_name, _sql)
