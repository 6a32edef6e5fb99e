"""DuckDB SQL for decision contexts, recommendations and what follows from them."""
from __future__ import annotations

from checks.sqlparts import THR, part

# ------------------------------------------------------------------ context of asked (host, step) rows
def context(p: str, ask: str) -> None:
    """Parts named by `p` for the (host, step) rows of `ask`, up to q_{p}ctx."""
    part(f"q_{p}ask", f"""
SELECT q.host, q.step, CAST(q.step + (SELECT min("window") FROM q_frame) AS BIGINT) AS "window", coalesce(f.risk, 0) AS risk, coalesce(f.mapped, 0) AS mapped
FROM ({ask}) q LEFT JOIN q_fc f ON f.host = q.host AND f.step = q.step""")
    part(f"q_{p}mark", f"""
    SELECT a.*, a.risk >= {THR} AS hot, coalesce(d.o >= d.i, true) AS attacks, r.role AS named, r.attacker AS blamed, s.peer
    FROM q_{p}ask a LEFT JOIN q_roles r ON r."window" = a."window" AND r.host = a.host
    LEFT JOIN q_dir d ON d."window" = a."window" AND d.host = a.host LEFT JOIN q_heavy_src s ON s."window" = a."window" AND s.host = a.host""")
    part(f"q_{p}who", f"""
    SELECT *, CASE WHEN role = 'attacker' THEN host WHEN hot THEN blamed ELSE coalesce(peer, host) END AS attacker FROM
      (SELECT *, CASE WHEN hot THEN coalesce(named, 'attacker') WHEN attacks OR coalesce(named, '') = 'attacker' THEN 'attacker' ELSE 'victim' END AS role FROM q_{p}mark)""")
    part(f"q_{p}victims", f"""
    SELECT "window", host, attacker, victim, min((grp, pos, rn)) AS place FROM (
      SELECT w."window", w.host, w.attacker, l.victim, l.grp, l.pos, l.rn FROM q_{p}who w JOIN q_links l ON l."window" = w."window" AND l.attacker = w.attacker
      WHERE w.hot OR NOT w.attacks
      UNION ALL SELECT w."window", w.host, w.host, h.b, 0, 0, h.rn FROM q_{p}who w JOIN q_heavy_dst h ON h."window" = w."window" AND h.a = w.host
      WHERE NOT w.hot AND w.attacks
      UNION ALL SELECT "window", host, attacker, host, 2, 0, 0 FROM q_{p}who WHERE NOT hot AND role = 'victim') GROUP BY ALL""")
    part(f"q_{p}near", f"""
    SELECT x AS "window", src_ip, dst_ip, dport, count(*) AS n FROM (SELECT *, unnest(range(w, w + 3)) AS x FROM q_cut)
    WHERE x IN (SELECT "window" FROM q_{p}ask) GROUP BY ALL""")
    part(f"q_{p}port", f"""
    SELECT "window", host, arg_min(dport, (-n, dport)) AS top_port FROM (
      SELECT a."window", a.host, c.dport, sum(c.n) AS n FROM (
        SELECT "window", host, attacker, victim FROM q_{p}victims UNION ALL
        SELECT "window", host, attacker, host FROM q_{p}who w WHERE NOT EXISTS (SELECT 1 FROM q_{p}victims v WHERE v."window" = w."window" AND v.host = w.host)) a
      JOIN q_{p}near c ON c."window" = a."window" AND c.src_ip = a.attacker AND c.dst_ip = a.victim GROUP BY ALL) GROUP BY ALL""")
    part(f"q_{p}heard", f"""
    SELECT "window", host, list(dst_ip ORDER BY n DESC, dst_ip)[1:5] AS peers FROM (
      SELECT "window", src_ip AS host, dst_ip, sum(n) AS n FROM q_{p}near GROUP BY ALL) GROUP BY ALL""")
    part(f"q_{p}ctx", f"""
    SELECT w.host, w.step, w."window", round(w.risk, 4) AS risk, w.mapped AS stage, w.role, w.attacker, v.victim_1, coalesce(v.n, 0) AS victims_n, p.top_port,
      coalesce(h.peers, []) AS c2
    FROM q_{p}who w LEFT JOIN (SELECT "window", host, arg_min(victim, (place, victim)) FILTER (victim <> attacker) AS victim_1, count(*) AS n
      FROM q_{p}victims GROUP BY "window", host) v ON v."window" = w."window" AND v.host = w.host
    LEFT JOIN q_{p}port p ON p."window" = w."window" AND p.host = w.host LEFT JOIN q_{p}heard h ON h."window" = w."window" AND h.host = w.host""")


context("", "SELECT host, first_alert_step AS step FROM q_alert UNION SELECT DISTINCT host, 400 FROM q_fc")
part("q_case", "SELECT * FROM q_ctx")
part("q_top12", "SELECT * FROM q_over WHERE first_alert_step IS NOT NULL ORDER BY first_alert_step, peak DESC, host LIMIT 12")
part("q_seen", """
SELECT host, stage, arg_min(step, (src, step, risk)) AS step, round(arg_min(risk, (src, step, risk)), 4) AS step_risk FROM (
  SELECT host, step, risk, stage, 0 AS src FROM q_fc UNION ALL
  SELECT f.host, f.step, f.risk, h.x.held, 1 FROM q_fc f JOIN q_held h ON h.host = f.host AND h.x.step = f.step)
WHERE stage > 0 AND host IN (SELECT host FROM q_top12) GROUP BY host, stage""")
context("t", "SELECT DISTINCT host, step FROM q_seen")
part("q_tcase", "SELECT c.* EXCLUDE (stage, risk), s.stage, s.step_risk AS risk FROM q_tctx c JOIN q_seen s ON s.host = c.host AND s.step = c.step")

# ------------------------------------------------------------------ the rules, one row an offered action
#: Stage, place, kind, target (a attacker, v victim, h host, p the role's attacker), whether the victim is the
#: peer, whether the port is named, which peers are named, whether it needs a victim.
RULES = [
    (1, 0, "block_source", "a", 0, 0, "", 0), (1, 1, "rate_limit", "a", 0, 0, "", 0), (1, 2, "block_pair", "a", 1, 0, "", 1),
    (2, 0, "block_pair", "a", 1, 1, "", 0), (2, 1, "block_source", "a", 0, 0, "", 0), (2, 2, "rate_limit", "a", 0, 0, "", 0),
    (2, 3, "isolate_host", "v", 0, 0, "", 1),
    (3, 0, "isolate_host", "p", 0, 0, "", 0), (3, 1, "block_pair", "p", 1, 0, "", 1), (3, 2, "block_source", "p", 0, 0, "", 0),
    (4, 0, "block_egress", "h", 0, 0, "or attacker", 0), (4, 1, "isolate_host", "h", 0, 0, "", 0), (4, 2, "throttle_egress", "h", 0, 0, "", 0),
    (5, 0, "throttle_egress", "h", 0, 0, "", 0), (5, 1, "block_egress", "h", 0, 0, "peers", 0), (5, 2, "isolate_host", "h", 0, 0, "", 0),
    (6, 0, "rate_limit", "a", 0, 0, "", 0), (6, 1, "block_source", "a", 0, 0, "", 0), (6, 2, "block_pair", "a", 1, 1, "", 1),
    *[(s, 9, "monitor", "-", 0, 0, "", 0) for s in range(7)],
]
_ROWS = ", ".join(str(r) for r in RULES)
def offers(p: str) -> None:
    """Offered actions of q_{p}case, and the recommended ones."""
    part(f"q_{p}offer", f"""
SELECT *, CAST(row_number() OVER (PARTITION BY host, step, stage ORDER BY place) - 1 AS INTEGER) AS position,
  concat_ws('-', kind, coalesce(target, 'None'), nullif(peer, ''), CASE WHEN port <> 0 THEN CAST(port AS VARCHAR) END) AS id,
  CASE kind WHEN 'block_source' THEN 'Block all traffic from ' || t WHEN 'isolate_host' THEN 'Isolate host ' || t
    WHEN 'rate_limit' THEN 'Rate-limit ' || t || ' to 10% of its flows' WHEN 'throttle_egress' THEN 'Throttle outbound traffic of ' || t || ' to 10%'
    WHEN 'block_egress' THEN 'Block egress from ' || t || ' to ' || other WHEN 'monitor' THEN 'Monitor only (no containment)'
    ELSE 'Block ' || t || ' -> ' || other || CASE WHEN port <> 0 THEN ':' || CAST(port AS VARCHAR) ELSE '' END END AS label
FROM (SELECT *, coalesce(target, 'None') AS t, coalesce(peer, nullif(array_to_string(named, ', '), ''), 'peers') AS other FROM (
  SELECT c.host, c.step, c.risk, c.stage, r.place, r.kind, coalesce(CASE WHEN r.port = 1 THEN c.top_port END, 0) AS port,
    CASE r.who WHEN 'a' THEN c.att WHEN 'v' THEN c.vic WHEN 'h' THEN c.host WHEN 'p' THEN CASE WHEN c.role = 'attacker' THEN c.host ELSE c.att END END AS target,
    CASE WHEN r.pair = 1 THEN c.vic END AS peer,
    CASE WHEN r.peers = '' THEN [] WHEN len(c.own) > 0 THEN c.own WHEN r.peers = 'or attacker' AND c.att <> c.host THEN [c.att] ELSE [] END AS named
  FROM (SELECT *, coalesce(attacker, host) AS att, coalesce(victim_1, CASE WHEN host <> coalesce(attacker, host) THEN host END) AS vic,
      list_filter(c2, lambda p: p <> host)[1:5] AS own FROM q_{p}case) c
  JOIN (VALUES {_ROWS}) AS r(stage, place, kind, who, pair, port, peers, needs) ON r.stage = c.stage AND (r.needs = 0 OR c.vic IS NOT NULL)))""")
    part(f"q_{p}rec", f"""
SELECT o.*, n.n FROM q_{p}offer o JOIN (SELECT host, step, stage, CASE WHEN any_value(stage) = 0 THEN 0 ELSE count(*) - 1 END AS n FROM q_{p}offer GROUP BY host, step, stage) n
  ON n.host = o.host AND n.step = o.step AND n.stage = o.stage WHERE position = 0""")


offers("")
offers("t")
_STEP = "CAST(step AS INTEGER) AS step"

DECISIONS = {
    "decision_context": f"""
SELECT host, {_STEP}, "window", risk, stage AS decision_stage, role, coalesce(attacker, '') AS attacker, coalesce(victim_1, '') AS victim_1, victims_n,
  coalesce(top_port, -1) AS top_port, array_to_string(c2, ',') AS c2_peers FROM q_ctx""",
    "recommend": f"SELECT host, {_STEP}, stage AS decision_stage, id, kind, label, CAST(n AS INTEGER) AS n_alternatives FROM q_rec",
    "whatif_menu": f"""
SELECT host, {_STEP}, position, kind, label, CASE kind WHEN 'block_source' THEN 'drops all traffic from the source'
    WHEN 'isolate_host' THEN 'quarantines the host completely' WHEN 'block_pair' THEN 'cuts only this attacker->victim path'
    WHEN 'rate_limit' THEN 'throttles to ~10% (partial)' WHEN 'block_egress' THEN 'blocks the outbound channel'
    WHEN 'throttle_egress' THEN 'throttles the outbound channel' ELSE 'watch only, no containment' END AS scope,
  CASE WHEN kind IN ('block_source', 'isolate_host') THEN 'full contain' WHEN kind = 'monitor' THEN 'monitor' ELSE 'partial' END AS containment FROM q_offer""",
    "auto_contain": f"""
SELECT host, 'accept' AS choice, {_STEP}, kind, label FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY step) AS rn FROM q_rec
  WHERE risk >= {THR} AND kind IN ('block_source', 'isolate_host')) WHERE rn = 1""",
    "decide": f"""
SELECT r.host, {_STEP.replace('step AS', 'r.step AS')}, choice, coalesce(pick, '') AS option_id, choice <> 'modify' OR o.id IS NOT NULL AS valid,
  coalesce(CASE choice WHEN 'accept' THEN r.kind WHEN 'modify' THEN o.kind END, '') AS kind, CASE WHEN choice = 'reject' THEN r.kind ELSE '' END AS turned_down
FROM (SELECT *, CASE WHEN d < 3 THEN 'accept' WHEN d < 6 THEN 'reject' ELSE 'modify' END AS choice, CASE WHEN d = 8 THEN 'no-such-option' WHEN d > 5 AND n > 0 THEN last END AS pick
  FROM (SELECT r.*, CAST('0x' || substr(md5(r.host), 1, 6) AS BIGINT) % 9 AS d, (SELECT arg_max(id, position) FROM q_offer o WHERE o.host = r.host AND o.step = r.step) AS last
    FROM q_rec r)) r
LEFT JOIN (SELECT host, step, id, any_value(kind) AS kind FROM q_offer GROUP BY ALL) o ON o.host = r.host AND o.step = r.step AND o.id = r.pick""",
    "narration": f"""
SELECT c.host, CAST(c.step AS INTEGER) AS step, 'Host ' || c.host || ' is forecast at ' || CAST(CAST(round_even(c.risk * 100, 0) AS INTEGER) AS VARCHAR)
  || '% risk of attack activity within the next 5 minutes, consistent with ' || (['No adversary activity', 'Reconnaissance (TA0043)', 'Initial Access (TA0001)',
  'Lateral Movement (TA0008)', 'Command and Control (TA0011)', 'Exfiltration (TA0010)', 'Impact (TA0040)'])[c.stage + 1]
  || '. The model''s evidence is driven mainly by its recent traffic pattern. The traffic points to ' || c.attacker || ' as the initiating host and '
  || coalesce(victim_1, 'no specific internal target') || ' as affected. The rule engine recommends: ' || label || '.' AS text
FROM q_ctx c JOIN q_rec r ON r.host = c.host AND r.step = c.step""",
    "campaign_actions": f"""
SELECT host, stage AS stage_seen, {_STEP}, risk AS step_risk, id, kind, label FROM q_trec""",
    "action_queue": f"""
SELECT q.host, q.stage, CAST(q.step AS INTEGER) AS step, q.risk, q.label, CAST(coalesce(clead, -1) AS INTEGER) AS compromise_lead_s FROM (
  SELECT host, stage, step, risk, label FROM q_trec UNION ALL
  SELECT r.host, r.stage, r.step, r.risk, r.label FROM q_rec r JOIN q_top12 t ON t.host = r.host AND t.first_alert_step = r.step
  WHERE r.host NOT IN (SELECT host FROM q_trec)) q JOIN q_top12 t ON t.host = q.host""",
}
