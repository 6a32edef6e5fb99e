"""The host graph: edges, neighbourhood features, attacker/victim roles, snapshots."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide import schema as S
from flowtide.cluster import materialise, spread
from flowtide.functions.parsing import subnet24
from flowtide.functions.stages import map_stage


def build_graph(flows: DataFrame, hosts: DataFrame | None = None,
                keys: Sequence[str] = ()) -> DataFrame:
    """Directed edges with flow count and forward bytes; both ends in `hosts` when given."""
    g = flows.groupBy(*keys, "src_ip", "dst_ip").agg(
        F.count("*").alias("flows"), F.sum("fwd_bytes").alias("bytes"))
    if hosts is not None:
        for end in ("src_ip", "dst_ip"):
            g = g.join(hosts.select(*keys, F.col("host").alias(end)), [*keys, end], "left_semi")
    return g


def top_hosts(flows: DataFrame, n: int = 26) -> DataFrame:
    return (flows.select(F.explode(F.array("src_ip", "dst_ip")).alias("host"))
            .groupBy("host").agg(F.count("*").alias("flows"))
            .orderBy(F.desc("flows"), "host").limit(n)
            .withColumn("subnet", subnet24(F.col("host"))))


def top_pairs(flows: DataFrame, n: int = 70) -> DataFrame:
    return (flows.groupBy("src_ip", "dst_ip").agg(F.count("*").alias("flows"))
            .orderBy(F.desc("flows"), "src_ip", "dst_ip").limit(n))


def neighbor_aggregate(frame: DataFrame, edges: DataFrame, features: Sequence[str],
                       keys: Sequence[str] = ()) -> DataFrame:
    """Mean and max of the neighbours' features and log1p(degree) for every frame row.

    The undirected edge set is joined to the neighbour's row on (host, window) and
    reduced map-side per receiving row; a hub's edges spread over its windows. An edge means that both ends were
    seen, so only rows with flows are joined; idle rows (most of a dense frame) take zeros where they are.
    """
    keys = list(keys)
    seen = F.lit(True)
    if {"out_flows", "in_flows"} <= set(frame.columns):
        seen = F.col("out_flows") + F.col("in_flows") > 0
    both = F.explode(F.array(F.struct(F.col("a").alias("host"), F.col("b").alias("peer")),
                             F.struct(F.col("b").alias("host"), F.col("a").alias("peer"))))
    und = (edges.select(*keys, "window", both.alias("e"))
           .select(*keys, "window", "e.host", "e.peer").distinct())
    theirs = frame.filter(seen).select(*keys, "window", F.col("host").alias("peer"), *features)
    stats = (und.join(theirs, [*keys, "window", "peer"])
             .groupBy(*keys, "host", "window")
             .agg(*[F.avg(f).alias(f"nb_mean_{f}") for f in features],
                  *[F.max(f).alias(f"nb_max_{f}") for f in features],
                  F.log1p(F.count("*").cast("double")).alias("nb_log_degree")))
    new = [c for c in stats.columns if c.startswith("nb_")]
    out = frame.filter(seen).join(stats, [*keys, "host", "window"], "left").withColumns({
        c: F.coalesce(c, F.lit(0.0)) for c in new})
    return out.unionByName(frame.filter(~seen).withColumns({c: F.lit(0.0) for c in new}))


# ------------------------------------------------------------------ roles
def recent_edges(edges: DataFrame, windows: DataFrame | None = None,
                 lookback: int = S.ROLE_LOOKBACK) -> DataFrame:
    """Edge totals of the last `lookback` windows, for every (or each requested) window."""
    ahead = F.explode(F.sequence(F.col("window"), F.col("window") + (lookback - 1)))
    e = edges.select("a", "b", "flows", ahead.alias("window"))
    if windows is not None:
        e = e.join(F.broadcast(windows.select("window").distinct()), "window", "left_semi")
    return e.groupBy("window", "a", "b").agg(F.sum("flows").alias("flows"))


def direction(recent: DataFrame) -> DataFrame:
    """Outgoing and incoming recent flows per (window, host)."""
    ends = F.explode(F.array(
        F.struct(F.col("a").alias("host"), F.col("flows").alias("o"), F.lit(0).cast("long").alias("i")),
        F.struct(F.col("b").alias("host"), F.lit(0).cast("long").alias("o"), F.col("flows").alias("i"))))
    return (recent.select("window", ends.alias("x"))
            .groupBy("window", F.col("x.host").alias("host"))
            .agg(F.sum("x.o").alias("out_recent"), F.sum("x.i").alias("in_recent")))


def heaviest_targets(recent: DataFrame, n: int = 3) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("window", "a").orderBy(F.desc("flows"), "b"))
    return recent.withColumn("ord", rank).filter(F.col("ord") <= n)


def heaviest_source(recent: DataFrame) -> DataFrame:
    """Per (window, receiving host): the source with most flows, ties to the lower name."""
    return (recent.groupBy("window", F.col("b").alias("host"))
            .agg(F.min(F.struct((-F.col("flows")).alias("neg"), "a"))["a"].alias("peer")))


def role_links(edges: DataFrame, risk: DataFrame, threshold: float,
               recent: DataFrame | None = None) -> dict[str, DataFrame]:
    """Attacker/victim links for every window that has alerting hosts.

    `risk` holds (window, host, risk). Alerting hosts are visited by falling risk, then
    name; that visiting order is the comparable struct `pos`, so no per-window sort is
    needed. Returns
    * `links`:   window, attacker, victim, grp, pos, ord - the ordered victim list
    * `roles`:   window, host, role, attacker
    """
    alerting = spread(risk.filter(F.col("risk") >= threshold).select(
        "window", "host", F.struct((-F.col("risk")).alias("neg"), F.col("host").alias("name")).alias("pos")))
    if recent is None:
        recent = spread(materialise(recent_edges(edges, alerting)))
    sided = (alerting.join(direction(recent), ["window", "host"], "left")
             .withColumn("attacks", F.coalesce(F.col("out_recent") >= F.col("in_recent"), F.lit(True))))
    sided = spread(materialise(sided))
    attackers = sided.filter("attacks").select("window", F.col("host").alias("attacker"),
                                               F.col("pos").alias("own_pos"))
    victims = (sided.filter("NOT attacks").join(heaviest_source(recent), ["window", "host"])
               .select("window", F.col("host").alias("victim"), "pos", F.col("peer").alias("attacker")))
    targets = (heaviest_targets(recent)
               .select("window", F.col("a").alias("attacker"), F.col("b").alias("victim"), "ord")
               .join(attackers, ["window", "attacker"])
               .select("window", "attacker", "victim", F.lit(0).alias("grp"),
                       F.col("own_pos").alias("pos"), "ord"))
    # an alerting attacker's list restarts with its targets when it is visited, so only
    # victims visited later are appended to it
    appended = (victims.join(attackers, ["window", "attacker"], "left")
                .filter(F.col("own_pos").isNull() | (F.col("pos") > F.col("own_pos")))
                .join(spread(targets.select("window", "attacker", "victim")), ["window", "attacker", "victim"], "left_anti")
                .select("window", "attacker", "victim", F.lit(1).alias("grp"), "pos", F.lit(0).alias("ord")))
    links = targets.unionByName(appended)
    # order in which attackers entered the table: own visit or first victim naming them
    entered = (attackers.select("window", "attacker", F.col("own_pos").alias("pos"))
               .unionByName(victims.select("window", "attacker", "pos"))
               .groupBy("window", "attacker").agg(F.min("pos").alias("entry")))
    listed = (links.join(spread(entered), ["window", "attacker"])
              .groupBy("window", F.col("victim").alias("host"))
              .agg(F.max(F.struct("entry", "attacker"))["attacker"].alias("listed_by")))
    own = victims.select("window", F.col("victim").alias("host"), F.col("attacker").alias("named"))
    passive = (listed.join(own, ["window", "host"], "full")
               .join(spread(entered.select("window", F.col("attacker").alias("host"))), ["window", "host"], "left_anti")
               .select("window", "host", F.lit("victim").alias("role"),
                       F.coalesce("named", "listed_by").alias("attacker")))
    roles = entered.select("window", F.col("attacker").alias("host"), F.lit("attacker").alias("role"),
                           F.lit(None).cast("string").alias("attacker")).unionByName(passive)
    return {"links": links, "roles": roles, "recent": recent, "sided": sided}


def roles_at(edges: DataFrame, window: int, risk: DataFrame, threshold: float,
             focus: str | None = None) -> DataFrame:
    """Roles in one window; a `focus` host counts as alerting whatever its risk."""
    now = risk.filter(F.col("window") == window)
    if focus is not None:
        ask = now.sparkSession.createDataFrame([(window, focus)], "window long, host string")
        now = (now.join(ask.withColumn("_f", F.lit(True)), ["window", "host"], "full")
               .withColumn("risk", F.coalesce("risk", F.lit(0.0)))
               .withColumn("_f", F.coalesce("_f", F.lit(False))))
        # the real risk orders the visit; the flag admits the focus host
        now = now.filter(F.col("_f") | (F.col("risk") >= threshold)).drop("_f")
        return role_links(edges, now, float("-inf"))["roles"]
    return role_links(edges, now, threshold)["roles"]


# ------------------------------------------------------------------ snapshots
def topology_nodes(frame: DataFrame, roles: DataFrame, risk: DataFrame, window: int,
                   threshold: float, mitigated: Sequence[str] = (), max_nodes: int = 60) -> DataFrame:
    """Nodes of the graph picture at one window: role hosts, then the busiest others.

    `risk` holds (window, host, risk, stage_probs).
    """
    vol = (frame.filter(F.col("window") <= window).groupBy("host")
           .agg(F.sum(F.col("out_flows") + F.col("in_flows")).alias("flows_total"),
                F.sum(F.when(F.col("window") == window, F.col("out_flows") + F.col("in_flows")))
                .alias("flows_now")))
    now = risk.filter(F.col("window") == window).select("host", "risk", "stage_probs")
    acting = roles.filter(F.col("window") == window).select("host", F.col("role").alias("_role"))
    ranked = (vol.join(acting, "host", "full")
              .filter((F.col("flows_total") > 0) | F.col("_role").isNotNull()))
    # role hosts always stay; they also use up places
    n_roles = acting.agg(F.count("*")).scalar()
    # at most max_nodes others are ever shown: those few are numbered, not all hosts
    few = ranked.filter(F.col("_role").isNull()).orderBy(F.desc("flows_total"), "host").limit(max_nodes)
    rank = F.row_number().over(Window.orderBy(F.desc("flows_total"), "host"))
    kept = ranked.filter(F.col("_role").isNotNull()).unionByName(
        few.withColumn("_r", rank).filter(F.col("_r") <= F.lit(max_nodes) - n_roles).drop("_r"))
    r = F.coalesce("risk", F.lit(0.0))
    stage = F.when(F.col("stage_probs").isNotNull(), map_stage(r, F.col("stage_probs"), threshold)).otherwise(0)
    role = F.when(F.col("host").isin(list(mitigated)), "mitigated") if mitigated else F.lit(None).cast("string")
    return kept.join(now, "host", "left").select(
        "host", F.round(r, 4).alias("risk"), stage.cast("int").alias("stage"),
        F.coalesce(role, F.col("_role"), F.lit("normal")).alias("role"), (r >= threshold).alias("alerting"),
        F.coalesce("flows_now", F.lit(0.0)).cast("long").alias("flows_now"),
        F.coalesce("flows_total", F.lit(0.0)).cast("long").alias("flows_total"))


def topology_edges(edges: DataFrame, nodes: DataFrame, links: DataFrame, window: int,
                   mitigated: Sequence[str] = (), lookback: int = S.ROLE_LOOKBACK) -> DataFrame:
    """Undirected edges among the kept nodes, with recent activity and attack heat."""
    und = edges.filter(F.col("window") <= window).groupBy(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.sum("flows").alias("flows"),
        F.coalesce(F.sum(F.when(F.col("window") > window - lookback, F.col("flows"))), F.lit(0)).alias("active"))
    keep = nodes.select("host")
    for end in ("a", "b"):
        und = und.join(keep.withColumnRenamed("host", end), end, "left_semi")
    pairs = (links.filter(F.col("window") == window)
             .select(F.least("attacker", "victim").alias("a"), F.greatest("attacker", "victim").alias("b"),
                     F.lit(True).alias("_pair")).distinct())
    cut = (F.col("a").isin(list(mitigated)) | F.col("b").isin(list(mitigated))) if mitigated else F.lit(False)
    hot = (F.col("active") > 0) & F.coalesce("_pair", F.lit(False)) & ~cut
    return und.join(pairs, ["a", "b"], "left").select("a", "b", "flows", "active", hot.alias("hot"))
