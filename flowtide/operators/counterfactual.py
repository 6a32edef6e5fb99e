"""Containment actions as predicates over flows, and traffic replays without those flows."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowtide import schema as S
from flowtide.functions.stages import label_to_stage
from flowtide.operators.ranking import global_rank

# Action kinds by strength, and the display damping factors.
BLOCKING = ("block_source", "block_pair", "isolate_host", "block_egress")
FULL = ("block_source", "isolate_host")
THROTTLES = ("rate_limit", "throttle_egress")
DAMP_BLOCK, DAMP_THROTTLE = 0.08, 0.28
LIVE_DAMP_BLOCK, LIVE_DAMP_THROTTLE = 0.0, 0.2


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def _touches(a: dict[str, Column]) -> Column:
    return _same(F.col("src_ip"), a["target"]) | _same(F.col("dst_ip"), a["target"])


def _pair(a: dict[str, Column]) -> Column:
    src, dst = F.col("src_ip"), F.col("dst_ip")
    hit = ((_same(src, a["target"]) & _same(dst, a["peer"]))
           | (_same(src, a["peer"]) & _same(dst, a["target"])))
    on_port = (F.coalesce(a["port"], F.lit(0)) == 0) | _same(F.col("dport"), a["port"]) | _same(
        F.col("sport"), a["port"])
    return hit & on_port


def _egress(a: dict[str, Column]) -> Column:
    peers = F.when(F.coalesce(F.size(a["peers"]), F.lit(0)) > 0, a["peers"]).otherwise(F.array(a["peer"]))
    return _same(F.col("src_ip"), a["target"]) & F.coalesce(F.array_contains(peers, F.col("dst_ip")), F.lit(False))


_PREDICATES: dict[str, Callable[[dict[str, Column]], Column]] = {
    "block_source": _touches, "isolate_host": _touches, "rate_limit": _touches,
    "block_pair": _pair, "block_egress": _egress,
    "throttle_egress": lambda a: _same(F.col("src_ip"), a["target"]),
}


def register_action(kind: str, predicate: Callable[[dict[str, Column]], Column]) -> None:
    """Add an action kind; `predicate` gets the action's fields as columns."""
    _PREDICATES[kind] = predicate


def action_fields(action: dict) -> dict[str, Column]:
    """A literal action as columns."""
    peers = [p for p in action.get("peers") or []]
    arr = F.array(*[F.lit(p) for p in peers]) if peers else F.array().cast("array<string>")
    return {"target": F.lit(action.get("target")).cast("string"), "peer": F.lit(action.get("peer")).cast("string"),
            "peers": arr, "port": F.lit(action.get("port")).cast("long")}


def affected(action: dict) -> Column:
    """Rows a literal action touches, before any throttling."""
    kind = action["kind"]
    return _PREDICATES[kind](action_fields(action)) if kind in _PREDICATES else F.lit(False)


def affected_by_row(kind: Column, fields: dict[str, Column]) -> Column:
    """The same for an action held in columns (joined decisions)."""
    out = F.lit(False)
    for name, predicate in _PREDICATES.items():
        out = F.when(kind == name, predicate(fields)).otherwise(out)
    return out


def apply_to_flows(flows: DataFrame, action: dict, t_from: float) -> DataFrame:
    """The flow table as it would be with the action in force from `t_from`.

    Throttles let the 1st, 11th, 21st ... affected flow through, by (ts_end, flow_id).
    The positions come from a range-partitioned rank over the affected rows only.
    """
    if action["kind"] == "monitor":
        return flows
    hit = affected(action) & (F.col("ts_end") >= t_from)
    kept = flows.filter(~hit)
    if action["kind"] not in THROTTLES:
        return kept
    ranked = global_rank(flows.filter(hit), [F.col("ts_end"), F.col("flow_id")], "_rank")
    survivors = ranked.filter((F.col("_rank") - 1) % S.THROTTLE_KEEP_EVERY == 0).drop("_rank")
    return kept.unionByName(survivors)


def damped(frame: DataFrame, action: dict, hosts: Sequence[str], live: bool = False) -> DataFrame:
    """Display-only risk: the forecast times a constant for affected hosts.

    This is a presentation rule, not a modelled effect; it goes to its own column.
    """
    block, throttle = ((LIVE_DAMP_BLOCK, LIVE_DAMP_THROTTLE) if live else (DAMP_BLOCK, DAMP_THROTTLE))
    factor = block if action["kind"] in BLOCKING else throttle
    return frame.withColumn("risk_display", F.when(
        F.col("host").isin(list(hosts)), F.col("risk") * factor).otherwise(F.col("risk")))


def outcome(steps: DataFrame, flows: DataFrame, host: str, step: int, threshold: float, attacker: str,
            victims: Sequence[str], t_from: float, window_s: float = S.WINDOW_S,
            last_step: Column | int | None = None) -> DataFrame:
    """One branch from the decision step on: peak and mean risk, time above the threshold,
    attacker-victim flows and labelled attack flows.

    `steps` holds (host, step, risk) of present windows; absent steps up to `last_step`
    count as risk 0.
    """
    end = steps.agg(F.max("step")).scalar() if last_step is None else (
        last_step if isinstance(last_step, Column) else F.lit(last_step))
    s = steps.filter((F.col("host") == host) & (F.col("step") >= step))
    above = F.col("risk") >= threshold
    # the first quiet step: the smallest step >= `step` that is absent or below
    order = F.sort_array(F.collect_list(F.when(above, F.col("step"))))
    a = s.agg(F.max("risk").alias("mx"), F.sum("risk").alias("sm"), F.count_if(above).alias("above"),
              order.alias("hot")).withColumn("_end", end)
    n = F.greatest(F.col("_end") - step + 1, F.lit(0))
    quiet = F.array_position(F.transform("hot", lambda v, i: v != i + step), F.lit(True)).cast("int")
    run = F.when(quiet > 0, quiet - 1).otherwise(F.size("hot"))
    peak = F.coalesce("mx", F.lit(0.0))
    part = F.col("src_ip"), F.col("dst_ip")
    vs = list(victims)
    between = ((part[0] == attacker) & part[1].isin(vs)) | ((part[1] == attacker) & part[0].isin(vs))
    f = flows.filter(F.col("ts_end") >= t_from).agg(
        F.count_if(between).alias("attacker_victim_flows"),
        F.count_if(label_to_stage(F.col("label")) > 0).alias("labelled_attack_flows"))
    return a.select(
        F.round(peak, 4).alias("peak_risk"),
        F.when(n > 0, F.round(F.coalesce("sm", F.lit(0.0)) / n, 4)).otherwise(0.0).alias("mean_risk"),
        F.floor(F.col("above") * int(window_s) / 60).cast("long").alias("minutes_above_threshold"),
        F.when(run < n, run * int(window_s)).cast("long").alias("risk_below_threshold_after_s"),
        f.select("attacker_victim_flows").scalar().alias("attacker_victim_flows"),
        f.select("labelled_attack_flows").scalar().alias("labelled_attack_flows"))
