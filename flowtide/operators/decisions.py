"""Decision context, the containment rule table and the boards built from decisions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide import schema as S
from flowtide.cluster import materialise, spread
from flowtide.functions.parsing import is_ip
from flowtide.functions.stages import map_stage, stage_name, tactic
from flowtide.operators import graph as G
from flowtide.operators.alerts import with_steps
from flowtide.operators.counterfactual import FULL

# Label text per action kind.
ACTION_LABELS = {
    "block_source": "Block all traffic from {target}",
    "block_pair": "Block {target} -> {peer}{port}",
    "isolate_host": "Isolate host {target}",
    "rate_limit": "Rate-limit {target} to 10% of its flows",
    "block_egress": "Block egress from {target} to {peer}",
    "throttle_egress": "Throttle outbound traffic of {target} to 10%",
    "monitor": "Monitor only (no containment)",
}

# Scope text per action kind.
ACTION_SCOPES = {
    "block_source": "drops all traffic from the source",
    "isolate_host": "quarantines the host completely",
    "block_pair": "cuts only this attacker->victim path",
    "rate_limit": "throttles to ~10% (partial)",
    "block_egress": "blocks the outbound channel",
    "throttle_egress": "throttles the outbound channel",
    "monitor": "watch only, no containment",
}

# Features that mark a port scan among the driving features.
SCAN_DRIVERS = ("out_distinct_dport", "out_dport_entropy", "out_failed_ratio",
                "in_distinct_dport", "out_small_flow_ratio")

# Remedy text per stage of the kill chain.
STAGE_REMEDIES = {
    1: "block the scanner before it picks a target",
    2: "cut the brute-forced service path",
    3: "isolate the pivot host",
    4: "block the beacon egress",
    5: "throttle / block the outbound transfer",
    6: "rate-limit the flood, keep the service up",
}

TTL_S = 300
ACTION_TYPE = ("struct<id:string,kind:string,target:string,peer:string,peers:array<string>,"
               "port:bigint,ttl_s:int,label:string,rationale:string>")


# ------------------------------------------------------------------ context (D8)
def stored_steps(frame: DataFrame) -> DataFrame:
    """Host, window, step, risk and probs of a forecast frame, computed once."""
    return materialise(with_steps(frame).select("host", "window", "step", "risk", "probs"))


def decision_context(frame: DataFrame, edges: DataFrame, flows: DataFrame, requests: DataFrame,
                     threshold: float, t0: Column, window_s: float = S.WINDOW_S) -> DataFrame:
    """Context of every (host, step) in `requests`; `frame` holds forecasts, or what `stored_steps` made of them.

    Columns: host, step, window, risk, decision_stage, role, attacker, victim_1 (first victim other
    than the attacker), victims_n, top_port, c2_peers (five heaviest egress peers).

    Roles are computed once per window for all its alerting hosts. A requested host that
    is not alerting joins last, after every alerting one, so only its own links are added.
    """
    # stored: each branch below would else plan and compute the forecast's arrays anew
    f = frame if {"step", "risk", "probs"} <= set(frame.columns) else stored_steps(frame)
    first = f.agg(F.min("window")).scalar()
    f = spread(f.select("host", "window", "step", "risk", "probs"))
    req = (requests.select("host", "step").distinct()
           .withColumn("window", (F.col("step") + first).cast("long"))
           .join(f.select("host", "step", "risk", "probs"), ["host", "step"], "left")
           .withColumn("risk", F.coalesce("risk", F.lit(0.0))))
    req = spread(materialise(req))
    windows = F.broadcast(req.select("window").distinct())       # as many as the recording is long, at most
    risk = f.join(windows, "window", "left_semi").select("window", "host", "risk")
    # small per-window tables that several branches below read: computed once
    recent = spread(materialise(G.recent_edges(edges, windows)))
    base = G.role_links(edges, risk, threshold, recent)
    base = {**base, "links": spread(materialise(base["links"])), "roles": spread(materialise(base["roles"]))}

    # links a non-alerting focus host adds by itself
    calm = req.filter(F.col("risk") < threshold).select("window", "host")
    sided = spread(calm.join(G.direction(recent), ["window", "host"], "left").withColumn(
        "attacks", F.coalesce(F.col("out_recent") >= F.col("in_recent"), F.lit(True))))
    own = (G.heaviest_targets(recent).withColumnRenamed("a", "host")
           .join(sided.filter("attacks").select("window", "host"), ["window", "host"], "left_semi")
           .select("window", "host", F.col("host").alias("attacker"), F.col("b").alias("victim"),
                   F.struct(F.lit(0).alias("grp"), F.lit(0.0).alias("neg"), F.lit("").alias("name"),
                            "ord").alias("at")))
    named = spread(sided.filter("NOT attacks").select("window", "host")
                   .join(G.heaviest_source(recent), ["window", "host"], "left")
                   .join(base["roles"].filter("role = 'attacker'").select("window", "host", F.lit(True).alias("_known")),
                         ["window", "host"], "left"))

    # role and attacker of every request
    alerting_roles = base["roles"].select("window", "host", F.col("role").alias("_role"),
                                          F.col("attacker").alias("_attacker"))
    marks = (req.join(alerting_roles, ["window", "host"], "left")
             .join(sided.select("window", "host", F.col("attacks").alias("_attacks")), ["window", "host"], "left")
             .join(named.select("window", "host", F.col("peer").alias("_peer"), "_known"), ["window", "host"], "left"))
    calm_role = F.when(F.col("_attacks") | F.coalesce("_known", F.lit(False)), "attacker").otherwise("victim")
    role = F.when(F.col("_attacks").isNull(), F.coalesce("_role", F.lit("attacker"))).otherwise(calm_role)
    marks = marks.withColumn("role", role).withColumn(
        "attacker", F.when(F.col("role") == "attacker", F.col("host")).when(
            F.col("_attacks").isNull(), F.col("_attacker")).otherwise(F.coalesce("_peer", "host")))

    # ordered victims of each request's attacker
    shared = base["links"].select("window", "attacker", "victim", F.struct(
        "grp", F.col("pos.neg").alias("neg"), F.col("pos.name").alias("name"), "ord").alias("at"))
    marks = spread(materialise(marks))
    who = marks.select("window", "host", "attacker", "role", "_attacks")
    # a calm focus that attacks replaces its list; otherwise the shared list applies
    lists = (who.filter(~F.coalesce("_attacks", F.lit(False)))
             .join(shared, ["window", "attacker"]).select("window", "host", "attacker", "victim", "at")
             .unionByName(own))
    tail = F.struct(F.lit(2).alias("grp"), F.lit(0.0).alias("neg"), F.lit("").alias("name"), F.lit(0).alias("ord"))
    itself = (who.filter((F.col("role") == "victim") & F.col("_attacks").isNotNull())
              .select("window", "host", "attacker", F.col("host").alias("victim"), tail.alias("at")))
    victims = (lists.unionByName(itself).groupBy("window", "host", "attacker", "victim")
               .agg(F.min("at").alias("at")))
    victims = spread(materialise(victims))
    first_victim = (victims.filter("victim <> attacker").groupBy("window", "host")
                    .agg(F.min(F.struct("at", "victim"))["victim"].alias("victim_1")))
    count = victims.groupBy("window", "host").agg(F.count("*").alias("victims_n"))

    # raw flows of the last three windows: service port and egress peers
    span = F.floor((F.col("ts_end") - t0) / float(window_s)).cast("long")
    near = flows.select("src_ip", "dst_ip", "dport", F.explode(F.sequence(
        span, span + (S.ROLE_LOOKBACK - 1))).alias("window"))
    cells = spread(materialise(near.join(windows, "window", "left_semi")
                               .groupBy("window", "src_ip", "dst_ip", "dport").agg(F.count("*").alias("n"))))
    aimed = victims.select("window", "host", "attacker", "victim").unionByName(
        marks.select("window", "host", "attacker").join(count, ["window", "host"], "left_anti")
        .withColumn("victim", F.col("host")))
    ports = (aimed.join(cells, (aimed["window"] == cells["window"]) & (aimed["attacker"] == cells["src_ip"])
                        & (aimed["victim"] == cells["dst_ip"]))
             .groupBy(aimed["window"], aimed["host"], "dport").agg(F.sum("n").alias("n"))
             .groupBy("window", "host").agg(F.min(F.struct((-F.col("n")).alias("neg"), "dport"))["dport"]
                                            .alias("top_port")))
    rank = F.row_number().over(Window.partitionBy("window", "src_ip").orderBy(F.desc("n"), "dst_ip"))
    peers = (cells.join(marks.select("window", F.col("host").alias("src_ip")), ["window", "src_ip"], "left_semi")
             .groupBy("window", "src_ip", "dst_ip").agg(F.sum("n").alias("n"))
             .withColumn("_r", rank).filter("_r <= 5").groupBy("window", F.col("src_ip").alias("host"))
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "dst_ip"))), lambda p: p["dst_ip"])
                  .alias("c2_peers")))
    out = marks
    for side in (first_victim, count, ports, peers):
        out = out.join(spread(side), ["window", "host"], "left")
    stage = F.when(F.col("probs").isNotNull(), map_stage(F.col("risk"), F.col("probs"), threshold)).otherwise(0)
    return out.select("host", "step", "window", F.round("risk", 4).alias("risk"),
                      stage.cast("int").alias("decision_stage"), "role", "attacker", "victim_1",
                      F.coalesce("victims_n", F.lit(0)).alias("victims_n"), "top_port",
                      F.coalesce("c2_peers", F.array().cast("array<string>")).alias("c2_peers"))


# ------------------------------------------------------------------ rule table (D9)
def _text(template: str, **values: Column) -> Column:
    """Fill `{name}` marks with columns; NULL when a mark's value is NULL."""
    import re

    parts = [values[p[1:-1]] if p.startswith("{") else F.lit(p)
             for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*parts)


def action(kind: str, target: Column | None = None, peer: Column | None = None,
           peers: Column | None = None, port: Column | None = None, rationale: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    target = none if target is None else target
    peer = none if peer is None else peer
    peers = F.array().cast("array<string>") if peers is None else peers
    port = F.lit(None).cast("long") if port is None else port.cast("long")
    has_port = F.coalesce(port, F.lit(0)) != 0
    joined = F.nullif(F.array_join(peers, ", "), F.lit(""))
    label = _text(ACTION_LABELS[kind], target=F.coalesce(target, F.lit("None")),
                  peer=F.coalesce(peer, joined, F.lit("peers")),
                  port=F.when(has_port, F.concat(F.lit(":"), port.cast("string"))).otherwise(""))
    ident = F.concat_ws("-", F.lit(kind), F.coalesce(target, F.lit("None")), F.nullif(peer, F.lit("")),
                        F.when(has_port, port.cast("string")))
    return F.struct(ident.alias("id"), F.lit(kind).alias("kind"), target.alias("target"), peer.alias("peer"),
                    peers.alias("peers"), port.alias("port"), F.lit(TTL_S).alias("ttl_s"),
                    label.alias("label"), (none if rationale is None else rationale).alias("rationale")).cast(
                        ACTION_TYPE)


def has_driver(drivers: Column, names: Sequence[str] = SCAN_DRIVERS) -> Column:
    """Any of `names` among the five leading drivers with a positive attribution."""
    return F.coalesce(F.exists(F.slice(drivers, 1, 5), lambda d: d["feature"].isin(*names)
                               & (d["attribution"] > 0)), F.lit(False))


def recommend(ctx: DataFrame, stage: Column | None = None, drivers: Column | None = None) -> DataFrame:
    """Add `recommended` (an action struct) and `alternatives` (its fallbacks, monitor last)."""
    stage = F.col("decision_stage") if stage is None else stage
    host, attacker = F.col("host"), F.coalesce("attacker", "host")
    victim = F.coalesce(F.col("victim_1"), F.when(host != attacker, host))
    port = F.col("top_port")
    peers = F.slice(F.filter("c2_peers", lambda p: p != host), 1, 5)
    fallback = F.when(attacker != host, F.array(attacker)).otherwise(F.array().cast("array<string>"))
    name = tactic(stage)
    scan = has_driver(drivers) if drivers is not None else F.lit(False)
    why = F.when(scan, "port-scan signature (many ports/destinations, mostly unanswered)").otherwise(
        "probing behaviour ahead of an intrusion")
    port_text = F.when(F.coalesce(port, F.lit(0)) != 0, F.concat(F.lit(":"), port.cast("string"))).otherwise("")
    v_text = F.coalesce(victim, F.lit("None"))
    pivot = F.when(F.col("role") == "attacker", host).otherwise(attacker)
    fill = dict(name=name, attacker=attacker, victim=v_text, port=port_text, host=host, pivot=pivot, why=why,
                service=F.coalesce(victim, F.lit("a service")))

    def say(text: str) -> Column:
        return _text(text, **fill)

    monitor = action("monitor", rationale=F.lit("Keep watching; risk is forecast but no containment is applied."))

    def if_victim(a: Column) -> Column:
        return F.when(victim.isNotNull(), a)

    # Per stage the recommended action, then its alternatives, with rationale texts.
    table = {
        1: [action("block_source", attacker, rationale=say(
                "{name}: {attacker} shows a {why}; blocking it before it picks a target stops the kill chain "
                "at step one.")),
            action("rate_limit", attacker, rationale=F.lit("Slows the scan while keeping the host reachable.")),
            if_victim(action("block_pair", attacker, victim, rationale=F.lit(
                "Shields only the host being probed.")))],
        2: [action("block_pair", attacker, victim, port=port, rationale=say(
                "{name}: repeated short connections from {attacker} to {victim}{port} match credential "
                "brute-force/exploit attempts; cutting that service path prevents the foothold.")),
            action("block_source", attacker, rationale=F.lit("Blocks the attacker on every service.")),
            action("rate_limit", attacker, rationale=F.lit("Makes guessing impractically slow.")),
            if_victim(action("isolate_host", victim, rationale=F.lit(
                "Protects the target if it may already be hit.")))],
        3: [action("isolate_host", pivot, rationale=say(
                "{name}: {pivot} is reaching new internal peers; isolating the pivot stops the spread to "
                "further hosts.")),
            if_victim(action("block_pair", pivot, victim, rationale=F.lit("Cuts only the current hop."))),
            action("block_source", pivot, rationale=F.lit("Drops everything the pivot sends and receives."))],
        4: [action("block_egress", host, peers=F.when(F.size(peers) > 0, peers).otherwise(fallback), rationale=say(
                "{name}: {host} keeps a beacon-like channel to external peers; blocking that egress severs the "
                "operator's control.")),
            action("isolate_host", host, rationale=F.lit("Quarantines the infected host completely.")),
            action("throttle_egress", host, rationale=F.lit("Degrades the channel while you investigate."))],
        5: [action("throttle_egress", host, rationale=say(
                "{name}: outbound volume from {host} is abnormal; throttling caps how much data can leave.")),
            action("block_egress", host, peers=peers, rationale=F.lit("Stops the transfer to the receiving peers.")),
            action("isolate_host", host, rationale=F.lit("Full containment of the leaking host."))],
        6: [action("rate_limit", attacker, rationale=say(
                "{name}: {attacker} is flooding {service}; rate-limiting keeps the service available.")),
            action("block_source", attacker, rationale=F.lit("Drops the flood source entirely.")),
            if_victim(action("block_pair", attacker, victim, port=port, rationale=F.lit(
                "Protects only the targeted service.")))],
    }
    best, rest = monitor, F.array().cast(f"array<{ACTION_TYPE}>")
    for s, (first, *others) in table.items():
        best = F.when(stage == s, first).otherwise(best)
        rest = F.when(stage == s, F.filter(F.array(*others, monitor), lambda a: a.isNotNull())).otherwise(rest)
    return ctx.withColumns({"recommended": best, "alternatives": rest})


def narration(ctx: DataFrame, driver_labels: Column | None = None, victims_text: Column | None = None) -> Column:
    """Deterministic incident sentence from decision columns."""
    drivers = F.coalesce(F.nullif(F.array_join(F.slice(driver_labels, 1, 3), ", "), F.lit("")),
                         F.lit("its recent traffic pattern")) if driver_labels is not None else F.lit(
        "its recent traffic pattern")
    victims = F.coalesce(victims_text if victims_text is not None else F.col("victim_1"),
                         F.lit("no specific internal target"))
    from flowtide.functions.stages import tactic_id

    tid = tactic_id(F.col("decision_stage"))
    return F.concat(
        F.lit("Host "), F.col("host"), F.lit(" is forecast at "),
        F.format_string("%.0f%%", F.bround(F.col("risk") * 100, 0)),
        F.lit(" risk of attack activity within the next 5 minutes, consistent with "), tactic(F.col("decision_stage")),
        F.coalesce(F.concat(F.lit(" ("), tid, F.lit(")")), F.lit("")),
        F.lit(". The model's evidence is driven mainly by "), drivers,
        F.lit(". The traffic points to "), F.col("attacker"), F.lit(" as the initiating host and "), victims,
        F.lit(" as affected. The rule engine recommends: "), F.col("recommended.label"), F.lit("."))


# ------------------------------------------------------------------ campaigns and boards
def stage_steps(timeline: DataFrame, alerting: DataFrame) -> DataFrame:
    """First step of every attack stage an alerting host reaches, truth before forecast."""
    t = timeline.join(alerting.select("host"), "host", "left_semi")
    seen = F.explode(F.array(
        F.struct(F.col("truth_stage").alias("s"), F.lit(0).alias("src")),
        F.struct(F.col("held_stage").alias("s"), F.lit(1).alias("src"))))
    return (t.select("host", "step", "risk", seen.alias("x")).filter("x.s > 0")
            .groupBy("host", F.col("x.s").alias("stage_seen"))
            .agg(F.min(F.struct(F.col("x.src").alias("src"), "step", "risk")).alias("m"))
            .select("host", "stage_seen", F.col("m.step").alias("step"), F.round("m.risk", 4).alias("step_risk")))


def whatif_menu(options: DataFrame) -> DataFrame:
    """Scope and containment class of every offered action (`option` struct)."""
    kind = F.col("option.kind")
    scopes = F.create_map(*[F.lit(x) for kv in ACTION_SCOPES.items() for x in kv])
    cls = F.when(kind.isin(*FULL), "full contain").when(kind == "monitor", "monitor").otherwise("partial")
    return options.withColumns({"scope": F.element_at(scopes, kind), "containment": cls})


def all_options(ctx: DataFrame) -> DataFrame:
    """One row per offered action: position 0 is the recommendation."""
    return ctx.select("host", "step", F.posexplode(
        F.concat(F.array("recommended"), "alternatives")).alias("position", "option"))


def causal_status(hosts: DataFrame, cursor: int) -> DataFrame:
    """Counters that reveal only alerts at or before the replay cursor."""
    seen = F.col("first_alert_step") <= cursor
    first = F.min(F.when(seen, F.struct(F.col("first_alert_step").alias("s"), F.lit(-1.0) * F.col("peak"), "host",
                                        "compromise_lead_s")))
    return hosts.agg(
        F.count_if(seen).alias("alerting_hosts"), first.alias("f"),
        F.max(F.when(seen & (F.coalesce("compromise_lead_s", F.lit(0)) != 0), F.col("compromise_lead_s")))
        .alias("best_lead_s")).select(
        "alerting_hosts", F.col("f.s").alias("first_alert_step"),
        F.col("f.compromise_lead_s").alias("first_lead_s"), "best_lead_s")


def event_feed(hosts: DataFrame, decisions: DataFrame, window_s: float = S.WINDOW_S, n: int = 12) -> DataFrame:
    """Detections and decisions, newest first."""
    pct = F.format_string("%.0f%%", F.bround(F.col("peak") * 100, 0))
    alerts = hosts.filter("first_alert_step IS NOT NULL").select(
        (F.col("first_alert_step") * float(window_s)).alias("at"), F.lit("alert").alias("kind"),
        F.concat(F.lit("forecast alert on "), "host", F.lit(" - "), "stage_name", F.lit(" ("), pct, F.lit(")"))
        .alias("text"))
    state = F.when(F.col("applied"), "applied").when(F.col("choice") == "reject", "rejected").otherwise(
        "not enforced")
    made = decisions.select(
        F.col("at").cast("double").alias("at"), F.lit("decision").alias("kind"),
        F.concat(F.upper("choice"), F.lit(" on "), "host", F.lit(" - "), "action_label", F.lit(" ("), state,
                 F.lit(")")).alias("text"))
    return alerts.unionByName(made).orderBy(F.desc("at"), "kind", "text").limit(n)


def campaign_board(hosts: DataFrame, threshold: float, contained: DataFrame, n: int = 10) -> DataFrame:
    """The alerting hosts with the highest peaks and whether they are contained."""
    top = (hosts.filter(F.col("first_alert_step").isNotNull() | (F.col("peak") >= threshold))
           .orderBy(F.desc("peak"), "host").limit(n))
    flag = contained.select("host", F.lit(True).alias("_c")).distinct()
    lead = F.when(F.col("compromise_lead_s") > 0, F.col("compromise_lead_s"))
    return F.broadcast(top).join(flag, "host", "left").select(
        "host", "stage_name", "peak", "first_alert_step", lead.alias("lead_s"),
        F.when(F.col("_c"), "contained").otherwise("alerting").alias("status"))


def kill_chain(spark, reached: int, forecast: int | None = None) -> DataFrame:
    """The six attack stages with what was reached and what is forecast next."""
    from flowtide.functions.stages import stage_dimension

    remedy = F.create_map(*[F.lit(x) for kv in STAGE_REMEDIES.items() for x in kv])
    mark = F.when(F.col("stage") <= reached, "reached")
    if forecast is not None:
        mark = mark.when(F.col("stage") == forecast, "forecast")
    return (stage_dimension(spark).filter("stage > 0")
            .select("stage", "tactic", "tactic_id", mark.alias("mark"),
                    F.element_at(remedy, F.col("stage")).alias("remedy")))


def kill_chain_progress(timeline: DataFrame) -> DataFrame:
    """Per host: highest stage reached and the highest forecast one beyond it."""
    ahead = F.max(F.array_max("future_stage"))
    g = timeline.groupBy("host").agg(
        F.max(F.greatest("truth_stage", "held_stage")).alias("reached"), ahead.alias("_f"))
    return g.select("host", "reached", F.when(F.col("_f") > F.col("reached"), F.col("_f")).alias("forecast"))


def eligibility(actions: DataFrame, protected: Sequence[str] = (), live: bool = False,
                rehearsal: bool = False, enforce: bool = False) -> DataFrame:
    """Whether an action row would be applied, its mode and the message; runs nothing.

    Rows carry kind, target, peer, peers, ttl_s and at.
    """
    ips = F.filter(F.concat(F.array("target", "peer"), F.coalesce("peers", F.array().cast("array<string>"))),
                   lambda i: i.isNotNull() & (i != ""))
    bad = F.filter(ips, lambda i: ~is_ip(i))
    shielded = F.filter(ips, lambda i: i.isin(*protected)) if protected else F.array().cast("array<string>")
    guarded = F.col("kind").isin("block_source", "isolate_host", "block_pair", "rate_limit")

    def verdict(applied: bool, dry: bool, mode: str, text, expires: bool = False) -> Column:
        return F.struct(F.lit(applied).alias("applied"), F.lit(dry).alias("dry_run"), F.lit(mode).alias("mode"),
                        (text if isinstance(text, Column) else F.lit(text)).alias("message"),
                        (F.col("at") + F.col("ttl_s") if expires else F.lit(None).cast("double")).alias("expires_at"))

    listed = lambda a: F.concat(F.lit("['"), F.array_join(a, "', '"), F.lit("']"))
    monitor = verdict(False, True, "none", "Monitor only - nothing applied.")
    if not live:
        rest = verdict(True, True, "upload_counterfactual", "Simulated: traffic replayed with the action applied.")
    elif rehearsal:
        rest = verdict(True, True, "safe_rehearsal",
                       "Applied to the safe rehearsal stream; no host firewall changed.", True)
    else:
        rest = F.when(F.size(bad) > 0, verdict(False, True, "none", F.concat(
            F.lit("Refused: invalid IP "), listed(bad), F.lit(".")))).when(
            (F.size(shielded) > 0) & guarded, verdict(False, True, "none", F.concat(
                F.lit("Refused: "), listed(shielded), F.lit(" is a protected management address.")))).otherwise(
            verdict(True, False, "none", "Rule applied on the sensor.", True) if enforce else
            verdict(False, True, "none", "Dry-run: rule shown, not applied."))
    return actions.withColumn("enforcement", F.when(F.col("kind") == "monitor", monitor).otherwise(rest))


def auto_contain(recommended: DataFrame, threshold: float, done: DataFrame | None = None) -> DataFrame:
    """Decision rows that accept a full block once per host whose peak reaches the threshold."""
    rows = recommended.filter((F.col("risk") >= threshold) & F.col("recommended.kind").isin(*FULL))
    if done is not None:
        rows = rows.join(done.select("host"), "host", "left_anti")
    return (rows.groupBy("host").agg(F.min(F.struct("step", "recommended")).alias("m"))
            .select("host", F.lit("accept").alias("choice"), F.col("m.step").alias("step"),
                    F.col("m.recommended").alias("action")))


def incident_rows(hosts: DataFrame, summary: DataFrame, threshold: float,
                  window_s: float = S.WINDOW_S, n: int = 12) -> DataFrame:
    """Attack table of an incident report with its wording of the early-warning lead."""
    top = hosts.filter("first_alert_step IS NOT NULL").orderBy(*[
        F.col("first_alert_step"), F.desc("peak"), F.col("host")]).limit(n)
    s = summary.select("host", "compromise_lead_s", "lead_time_s", "recon_before_compromise").withColumnsRenamed(
        {"compromise_lead_s": "_cl"})
    early = F.col("recon_before_compromise") & (F.col("_cl") > 0)
    text = F.when(early, F.concat(F.lit("+"), F.col("_cl").cast("string"), F.lit("s ("),
                                  F.floor(F.col("_cl") / 60).cast("string"), F.lit(" min) during recon"))).when(
        F.col("lead_time_s").isNotNull(), "at onset").otherwise("-")
    return top.join(s, "host", "left").select(
        "host", "stage_name", "peak", (F.col("peak") >= threshold).alias("above"),
        F.concat(F.lit("t+"), F.floor(F.col("first_alert_step") * int(window_s) / 60).cast("string"),
                 F.lit(" min")).alias("first_alert"), text.alias("early_warning"))


def report_summary(hosts: DataFrame, n_flows: Column, n_steps: Column, threshold: float, source: str,
                   horizon_s: int, window_s: float = S.WINDOW_S) -> DataFrame:
    """Headline facts of an incident report."""
    return hosts.agg(F.count("*").alias("n_hosts"),
                     F.count_if(F.col("first_alert_step").isNotNull()).alias("alerting_hosts")).select(
        F.lit(source).alias("source"), "n_hosts", n_flows.alias("n_flows"),
        F.floor(n_steps * int(window_s) / 60).cast("long").alias("duration_min"),
        F.lit(int(window_s)).alias("window_s"), F.lit(horizon_s).alias("horizon_s"),
        F.lit(threshold).alias("threshold"), "alerting_hosts")


def decision_rows(decisions: DataFrame, n: int = 8) -> DataFrame:
    """The latest decisions with their enforcement state."""
    state = F.when(F.col("applied"), "APPLIED").when(F.col("choice") == "reject", "rejected").otherwise(
        "not enforced")
    return decisions.orderBy(F.desc("at"), "host").limit(n).select(
        F.upper("choice").alias("choice"), "host", "action_label", state.alias("state"), "message")


def decide(recommended: DataFrame, choices: DataFrame) -> DataFrame:
    """Decision records of `choices` (host, step, choice, option_id) on recommendations.

    accept takes the recommended action; modify takes the offered option named by option_id, and is refused when no
    such option was offered; reject takes none, and keeps the recommended action as `counterfactual`, whose replay
    shows what it would have changed. A choice without a recommendation, or of another word, is refused.
    """
    offered = F.concat(F.array("recommended"), "alternatives")
    met = choices.join(recommended.select("host", "step", "recommended", offered.alias("_offered")), ["host", "step"], "left")
    named = F.get(F.filter("_offered", lambda o: o["id"] == F.col("option_id")), F.lit(0))
    known = F.col("recommended").isNotNull()
    valid = (F.when(F.col("choice") == "accept", known).when(F.col("choice") == "modify", named.isNotNull())
             .when(F.col("choice") == "reject", known).otherwise(False))
    taken = F.when(F.col("choice") == "accept", F.col("recommended")).when(F.col("choice") == "modify", named)
    return met.select(
        "host", "step", "choice", "option_id", F.coalesce(valid, F.lit(False)).alias("valid"), taken.alias("action"),
        F.when((F.col("choice") == "reject") & known, F.col("recommended")).alias("counterfactual"))
