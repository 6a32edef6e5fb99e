"""Alerts, lead times and per-host overviews on top of forecast rows.

Input rows: host, window, the forecast columns and (when labelled) `stage`. Steps count
from the first window of the whole frame. A missing window counts as risk 0.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide import schema as S
from flowtide.cluster import deal
from flowtide.functions.risk import first_at_least
from flowtide.functions.stages import map_stage, stage_name
from flowtide.operators.sequences import align_steps


def mean_probs(probs: Column) -> Column:
    """Stage distribution averaged over the horizon."""
    zero = F.array_repeat(F.lit(0.0), S.N_STAGES)
    total = F.aggregate(probs, zero, lambda acc, p: F.zip_with(acc, p, lambda a, b: a + b))
    return F.transform(total, lambda v: v / F.size(probs))


def with_steps(frame: DataFrame, first: Column | None = None) -> DataFrame:
    """Add `step`, the peak risk of the horizon and its mean stage distribution."""
    start = frame.agg(F.min("window")).scalar() if first is None else first
    return frame.withColumns({
        "step": (F.col("window") - start).cast("int"),
        "risk": F.array_max("future"),
        "probs": mean_probs(F.col("stage_future_probs"))})


def alert_rows(frame: DataFrame, threshold: float, n: int = S.ALERT_RUN) -> Column:
    """True where the last `n` consecutive windows of the host all reach the threshold."""
    order = Window.partitionBy("host").orderBy("window")
    run = order.rowsBetween(-(n - 1), 0)
    unbroken = F.col("window") - F.first("window").over(run) == n - 1
    return unbroken & (F.min("risk").over(run) >= threshold)


def first_alerts(frame: DataFrame, threshold: float, n: int = S.ALERT_RUN) -> DataFrame:
    """Host -> step that completes its first run of `n` alerting windows (NULL if none)."""
    f = frame if "risk" in frame.columns else with_steps(frame)
    return (f.withColumn("_a", alert_rows(f, threshold, n)).groupBy("host")
            .agg(F.min(F.when(F.col("_a"), F.col("step"))).alias("first_alert_step")))


def lead_hit(a0: Column, threshold: float, horizon: int) -> Column:
    """True where this row's forecast already put the attack step `a0` above the threshold."""
    ahead = a0 - F.col("step")
    return ahead.between(1, horizon) & (F.get(F.col("future"), (ahead - 1).cast("int")) >= threshold)


def overview(frame: DataFrame, threshold: float, n: int = S.ALERT_RUN, horizon: int = S.HORIZON_K,
             window_s: float = S.WINDOW_S) -> DataFrame:
    """One row per host: peak, first alert, stage at peak, flows, truth and lead times."""
    f = with_steps(frame)
    host = Window.partitionBy("host")
    f = f.withColumns({
        "_alert": alert_rows(f, threshold, n),
        "_comp": F.min(F.when(F.col("stage") >= 2, F.col("step"))).over(host),
        "_atk": F.min(F.when(F.col("stage") > 0, F.col("step"))).over(host)})
    f = f.withColumn("_a0", F.coalesce("_comp", "_atk"))
    at_peak = F.max(F.struct("risk", (-F.col("step")).alias("neg"), "probs"))
    g = f.groupBy("host").agg(
        at_peak.alias("pk"), F.min(F.when(F.col("_alert"), F.col("step"))).alias("first_alert_step"),
        F.sum(F.col("out_flows") + F.col("in_flows")).cast("long").alias("flows"),
        F.count_if(F.col("stage") > 0).alias("truth_attack_steps"),
        F.min("_comp").alias("first_compromise_step"), F.min("_a0").alias("_a0"),
        F.min(F.when(lead_hit(F.col("_a0"), threshold, horizon), F.col("step"))).alias("_hit"))
    stage = map_stage(F.col("pk.risk"), F.col("pk.probs"), threshold)
    ws = F.lit(int(window_s))
    return g.select(
        "host", F.round("pk.risk", 4).alias("peak"), "first_alert_step", stage.alias("stage"),
        stage_name(stage).alias("stage_name"), "flows", "truth_attack_steps", "first_compromise_step",
        ((F.col("first_compromise_step") - F.col("first_alert_step")) * ws).alias("compromise_lead_s"),
        ((F.col("_a0") - F.col("_hit")) * ws).alias("forecast_lead_s"))


def overview_order() -> list[Column]:
    """Alerting hosts first, then by alert step, then by falling peak, then name."""
    return [F.col("first_alert_step").asc_nulls_last(), F.desc("peak"), F.col("host")]


def focus_host(hosts: DataFrame) -> DataFrame:
    return hosts.orderBy(*overview_order()).limit(1).select("host", "first_alert_step")


TRAFFIC = ("out_flows", "in_flows", "out_distinct_dst", "out_distinct_dport", "in_distinct_src")
TIMELINE = ("host", "window", "truth_stage", "future", "lo", "hi", "now", *TRAFFIC, "present", "step", "risk", "raw_stage",
            "stage_now", "future_stage", "held_stage")


def timeline(frame: DataFrame, threshold: float, horizon: int = S.HORIZON_K, hosts: DataFrame | None = None,
             columns: Sequence[str] = TIMELINE) -> DataFrame:
    """Every step of every (chosen) host: risk, forecast, stages with hysteresis, truth.

    `columns`: those the caller reads. The planner cannot drop the others by itself, since all go through the pass that holds
    stages; `frame` need not have traffic features that are not among them. Stages are told before rows are dealt and idle
    steps filled, so that the distributions they come from stay where they are.
    """
    n = frame.count()
    if hosts is not None:
        frame = frame.join(hosts.select("host"), "host", "left_semi")
    zeros = f"array_repeat(0.0D, {horizon})"
    quiet = "0" if 0.0 < threshold * 0.5 else "1"       # what `map_stage` makes of no risk
    idle = {"truth_stage": "0", "future": zeros, "lo": zeros, "hi": zeros, "now": "0.0D", **{c: "0.0D" for c in TRAFFIC},
            "risk": "0.0D", "raw_stage": quiet, "stage_now": quiet, "future_stage": f"array_repeat({quiet}, {horizon})"}
    told = {c: F.col(c) for c in ("host", "window", "future", "lo", "hi", "now", *TRAFFIC)} | {
        "truth_stage": F.col("stage"), "risk": F.array_max("future"),
        "raw_stage": map_stage(F.array_max("future"), mean_probs(F.col("stage_future_probs")), threshold),
        "stage_now": map_stage(F.col("now"), F.col("stage_future_probs")[0], threshold),
        "future_stage": F.zip_with("future", "stage_future_probs", lambda r, p: map_stage(r, p, threshold))}
    read = [c for c in TIMELINE if c in told and c in {*columns, "host", "window", "raw_stage"}]
    f = align_steps(frame.select(*[told[c].alias(c) for c in read]), {c: v for c, v in idle.items() if c in read}, rows=n)
    f = f.select(*[c for c in TIMELINE if c in f.columns and c in {*columns, "host", "step", "raw_stage"}])
    return hold_stages(f, dealt=True, ordered=True).select(*[c for c in TIMELINE if c in columns])


def hold_stages(steps: DataFrame, keys: Sequence[str] = ("host",), hold: int = 2, dealt: bool = False,
                ordered: bool = False) -> DataFrame:
    """Add `held_stage`: `raw_stage` after hysteresis.

    Entering or leaving an attack is immediate; a change between two attack stages needs `hold` equal readings, which
    one benign reading in between does not undo. One pass over each host's ordered rows, a run of equal readings at a
    time; what is carried from batch to batch is four numbers. `dealt`: the rows of a host already lie in one task, as
    `align_steps` leaves them; other steps are counted first. `ordered`: they lie there by host and step, as it leaves
    them too: what it makes comes from rows sorted by a window, and nothing moves them after that.
    """
    keys = list(keys)
    rows = steps.withColumn("held_stage", F.lit(None).cast("int"))
    rows = rows if dealt else deal(rows, *keys, rows=steps.count())
    rows = rows if ordered else rows.sortWithinPartitions(*keys, "step")
    return rows.mapInArrow(_holding(keys, hold), rows.schema)


def _differs(values: pa.Array) -> np.ndarray:
    """Whether each value but the first is another than the one before; missing values are alike."""
    here, before = values[1:], values[:-1]
    other = pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
    return other | (pc.is_null(here).to_numpy(zero_copy_only=False) != pc.is_null(before).to_numpy(zero_copy_only=False))


def _holding(keys: list[str], hold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, held, waiting, count = None, 0, None, 0
        for batch in batches:
            raw = batch.column("raw_stage").to_numpy(zero_copy_only=False)
            fresh = np.zeros(len(raw), bool)
            for k in keys:
                fresh[1:] |= _differs(batch.column(k))
            if len(raw):
                fresh[0] = owner != tuple(batch.column(k)[0].as_py() for k in keys)
            starts = np.flatnonzero(fresh | (np.diff(raw, prepend=raw[:1]) != 0) | (np.arange(len(raw)) == 0))
            out = np.empty(len(raw), np.int32)
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(raw)]):
                value, n = int(raw[lo]), hi - lo
                if fresh[lo]:
                    held, waiting, count = 0, None, 0
                if value == held or value == 0 or held == 0:        # agrees, or enters or leaves at once
                    if value == held or n > 1:
                        waiting, count = None, 0
                    out[lo:hi] = held = value
                    continue
                needed = hold - (count if waiting == value else 0)
                out[lo:hi] = held
                if n >= needed:
                    out[lo + needed - 1:hi] = held = value
                    waiting, count = None, 0
                else:
                    waiting, count = value, hold - needed + n
            owner = tuple(batch.column(k)[-1].as_py() for k in keys) if len(raw) else owner
            columns = [pa.array(out, f.type) if f.name == "held_stage" else batch.column(f.name) for f in batch.schema]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
    return run


def timeline_summary(frame: DataFrame, threshold: float, n: int = S.ALERT_RUN,
                     horizon: int = S.HORIZON_K, window_s: float = S.WINDOW_S) -> DataFrame:
    """Per host: first reconnaissance, compromise, alert, predicted compromise and leads."""
    f = with_steps(frame)
    host = Window.partitionBy("host")
    f = f.withColumns({
        "_alert": alert_rows(f, threshold, n),
        "_rec": F.min(F.when(F.col("stage") == 1, F.col("step"))).over(host),
        "_comp": F.min(F.when(F.col("stage") >= 2, F.col("step"))).over(host)})
    f = f.withColumn("_a0", F.coalesce("_comp", "_rec"))
    high = first_at_least(F.col("future"), max(threshold, 0.5))
    k_hit = F.when(high > 0, high).otherwise(F.array_position("future", F.array_max("future")).cast("int"))
    g = f.groupBy("host").agg(
        F.min(F.when(F.col("_alert"), F.struct(F.col("step"), k_hit.alias("k")))).alias("al"),
        F.min("_rec").alias("first_recon_step"), F.min("_comp").alias("first_compromise_step"),
        F.min("_a0").alias("actual_first_attack_step"),
        F.min(F.when(lead_hit(F.col("_a0"), threshold, horizon), F.col("step"))).alias("forecast_hit_step"))
    ws = F.lit(int(window_s))
    al = F.col("al.step")
    return g.select(
        "host", al.alias("first_alert_step"),
        (F.col("al.k") * ws).alias("predicted_compromise_s_after_alert"),
        "first_recon_step", "first_compromise_step", "actual_first_attack_step", "forecast_hit_step",
        ((F.col("actual_first_attack_step") - al) * ws).alias("lead_time_s"),
        ((F.col("first_compromise_step") - al) * ws).alias("compromise_lead_s"),
        ((F.col("actual_first_attack_step") - F.col("forecast_hit_step")) * ws).alias("forecast_lead_s"),
        F.coalesce(F.col("first_recon_step") < F.col("first_compromise_step"), F.lit(False))
        .alias("recon_before_compromise"))


def lead_time_check(frame: DataFrame, threshold: float, window_s: float = S.WINDOW_S) -> DataFrame:
    """Per host: first single-window alert against the first stage-2 window."""
    f = with_steps(frame)
    g = f.groupBy("host").agg(
        F.min(F.when(F.col("risk") >= threshold, F.struct("step", "stage"))).alias("al"),
        F.min(F.when(F.col("stage") == 2, F.col("step"))).alias("first_brute_step"))
    return g.select("host", F.col("al.step").alias("first_alert_step"), "first_brute_step",
                    ((F.col("first_brute_step") - F.col("al.step")) * F.lit(int(window_s))).alias("lead_s"),
                    F.coalesce(F.col("al.stage") == 1, F.lit(False)).alias("recon_at_alert"))


def live_lead(future: Column, threshold: float, window_s: float = S.WINDOW_S) -> Column:
    """Seconds to the first forecast step at or above the threshold (NULL if none)."""
    k = first_at_least(future, threshold)
    return F.when(k > 0, k * int(window_s))
