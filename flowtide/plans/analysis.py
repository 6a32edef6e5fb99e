"""From flows to forecasts, overviews and what-if replays: the end-to-end plans."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from flowtide import schema as S
from flowtide.cluster import materialise
from flowtide.operators import alerts as A, counterfactual as CF, decisions as D
from flowtide.operators.windows import HostFeatures, WindowSpec, origin

Forecaster = Callable[[DataFrame], DataFrame]


@dataclass
class Analysis:
    """One analysed traffic table. `forecast` is the feature frame with forecast columns, which every view below reads:
    stored once, or (`cheap`) column expressions on the stored frame."""
    features: HostFeatures
    forecast: DataFrame
    edges: DataFrame
    forecaster: Forecaster
    threshold: float
    window_s: float
    horizon: int = S.HORIZON_K
    columns: Sequence[str] = tuple(S.FEATURES)     # features that the frame holds
    cheap: bool = False

    @cached_property
    def steps(self) -> DataFrame:
        """Host, window, step, risk and stages of the forecast, stored at first use."""
        return D.stored_steps(self.forecast)

    @property
    def t0(self) -> Column:
        t0 = self.features.spec.t0
        if t0 is None:
            return origin(self.features.flows, self.window_s)
        return t0 if isinstance(t0, Column) else F.lit(float(t0))

    def overview(self) -> DataFrame:
        return A.overview(self.forecast, self.threshold, horizon=self.horizon, window_s=self.window_s)

    def summary(self) -> DataFrame:
        return A.timeline_summary(self.forecast, self.threshold, horizon=self.horizon, window_s=self.window_s)

    def timeline(self, hosts: DataFrame | None = None, columns: Sequence[str] = A.TIMELINE) -> DataFrame:
        return A.timeline(self.forecast, self.threshold, self.horizon, hosts, columns)

    def context(self, requests: DataFrame) -> DataFrame:
        """Decision context of (host, step) rows."""
        return D.decision_context(self.steps, self.edges, self.features.flows, requests, self.threshold,
                                  self.t0, self.window_s)

    def recommendations(self) -> DataFrame:
        """One recommended action for every alerting host at its first alert."""
        asks = (A.first_alerts(self.steps, self.threshold).filter("first_alert_step IS NOT NULL")
                .select("host", F.col("first_alert_step").alias("step")))
        return D.recommend(self.context(materialise(asks)))

    def decide(self, choices: DataFrame) -> DataFrame:
        """Records of (host, step, choice, option_id) rows on what is recommended there."""
        asks = materialise(choices.select("host", "step").distinct())
        return D.decide(D.recommend(self.context(asks)), choices)

    def first_hosts(self, limit: int) -> DataFrame:
        """Overview of the first `limit` alerting hosts, stored."""
        return materialise(self.overview().filter("first_alert_step IS NOT NULL").orderBy(*A.overview_order()).limit(limit))

    def campaigns(self, limit: int = 12, top: DataFrame | None = None) -> DataFrame:
        """One action per (alerting host, stage it reaches) for the first `limit` hosts (`top`, where they are known)."""
        top = self.first_hosts(limit) if top is None else top
        steps = materialise(D.stage_steps(self.timeline(top, ("host", "step", "risk", "truth_stage", "held_stage")), top))
        ctx = self.context(steps).join(steps, ["host", "step"])
        return D.recommend(ctx, F.col("stage_seen"))

    def action_queue(self, limit: int = 12) -> DataFrame:
        """Campaign actions with their host's lead; hosts without a staged action show their
        single recommendation."""
        top = self.first_hosts(limit)
        staged = self.campaigns(limit, top).select("host", F.col("stage_seen").alias("stage"), "step",
                                              F.col("step_risk").alias("risk"), "recommended")
        staged = materialise(staged)
        single = (self.recommendations().join(top.select("host"), "host", "left_semi")
                  .join(staged.select("host"), "host", "left_anti")
                  .select("host", F.col("decision_stage").alias("stage"), "step", "risk", "recommended"))
        return staged.unionByName(single).join(top.select("host", "compromise_lead_s"), "host", "left")


def analyze(flows: DataFrame, forecaster: Forecaster, threshold: float, spec: WindowSpec = WindowSpec(),
            source: str = "flows", horizon: int = S.HORIZON_K, columns: Sequence[str] = S.FEATURES,
            frame: DataFrame | None = None, cheap: bool = False) -> Analysis:
    """Window the flows and forecast every host window. `columns`: the features that the forecaster reads, with those of
    `A.TRAFFIC` where overviews or timelines are wanted. `frame`: the stored feature frame of these flows and this `spec`,
    where a forecaster was fitted on it. `cheap`: the forecaster is a few column expressions, so the frame is stored rather
    than the arrays that it makes, which take longer to write and to read than to make."""
    feats = HostFeatures.from_flows(flows, spec, source, columns)
    if frame is not None or cheap:
        feats = replace(feats, frame=materialise(feats.frame) if frame is None else frame)
    forecast = forecaster(feats.frame)
    return Analysis(feats, forecast if cheap else materialise(forecast), materialise(feats.edges), forecaster, threshold,
                    spec.window_s, horizon, columns, cheap)


def replay(base: Analysis, action: dict, step: int, t_from: float | None = None) -> Analysis:
    """The same analysis on the traffic an action would leave from `step` on, with the same
    hosts, the same origin and the same fitted forecaster."""
    first = base.forecast.agg(F.min("window"), F.min("t")).first()
    t_from = first[1] + step * base.window_s if t_from is None else t_from
    flows = CF.apply_to_flows(base.features.flows, action, t_from)
    hosts = base.forecast.select("host").distinct()
    t0 = first[1] - first[0] * base.window_s
    return analyze(flows, base.forecaster, base.threshold, base.features.spec.but(hosts=hosts, t0=t0),
                   f"{base.features.source}+{action['kind']}", base.horizon, base.columns,
                   cheap=base.cheap)


def compare(base: Analysis, branch: Analysis, step: int) -> DataFrame:
    """Risk with and without the action per host and step, from the decision step on."""
    first = base.forecast.agg(F.min("window")).scalar()

    def curve(a: Analysis, name: str) -> DataFrame:
        return A.with_steps(a.forecast, first).select("host", "step", F.col("risk").alias(name))

    both = curve(base, "risk_without").join(curve(branch, "risk_with"), ["host", "step"], "left")
    return both.filter(F.col("step") >= step).withColumn("risk_with", F.coalesce("risk_with", F.lit(0.0)))


def branch_timeline(base: Analysis, branch: Analysis, step: int, hosts: DataFrame | None = None,
                    columns: Sequence[str] = A.TIMELINE) -> DataFrame:
    """Timeline of the replayed traffic, valid from the decision step on."""
    shift = (branch.forecast.agg(F.min("window")).scalar() - base.forecast.agg(F.min("window")).scalar())
    t = branch.timeline(hosts, columns)
    return t.withColumn("step", (F.col("step") + shift).cast("int")).filter(F.col("step") >= step)


def outcomes(base: Analysis, branch: Analysis, host: str, step: int, attacker: str, victims: list[str],
             action_label: str = "", applied: bool = True) -> DataFrame:
    """Two rows: what follows without and with the action."""
    first = base.forecast.agg(F.min("window"), F.min("t"), F.max("window")).first()
    t_from = first[1] + step * base.window_s
    rows = []
    for name, a in (("without_action", base), ("with_action", branch)):
        steps = A.with_steps(a.forecast, F.lit(first[0])).select("host", "step", "risk")
        rows.append(CF.outcome(steps, a.features.flows, host, step, base.threshold, attacker, victims, t_from,
                               base.window_s, int(first[2] - first[0])).select(F.lit(name).alias("branch"), "*"))
    return rows[0].unionByName(rows[1]).withColumns({
        "action_label": F.lit(action_label), "applied": F.lit(applied)})


def without_decision(base: Analysis, record: dict) -> DataFrame | None:
    """For a rejected recommendation, the risk with and without the action that was turned down; else None."""
    turned_down = record.get("counterfactual")
    if record["choice"] != "reject" or turned_down is None:
        return None
    return compare(base, replay(base, turned_down, record["step"]), record["step"])
