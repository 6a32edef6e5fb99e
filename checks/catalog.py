"""Registered queries: each runs one operator over the whole given tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowtide import schema as S
from flowtide.cluster import apart
from flowtide.operators import windows as W
from flowtide.sources.adapters import flows_from_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SPEC = dict(window_s=3600)
WIDE = 8


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def spec(**kw) -> W.WindowSpec:
    return W.WindowSpec(**{**SPEC, **kw})


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; adding zero folds -0.0 into 0.0."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    short_of = {c: short(F.col(c), digits) for c in doubles}
    if len(doubles) > WIDE:
        short_of[doubles[0]] = apart(short_of[doubles[0]])
    return df.select(*[short_of[c].alias(c) if c in short_of else F.col(c) for c in df.columns])


def short(c: Column, digits: int) -> Column:
    """`F.round(c, digits)`, without its way by decimals where the nearest multiple is beyond doubt: a whole number below
    a billion, divided by an exact power of ten, is the double that the decimal becomes."""
    t = c * F.lit(10.0 ** digits)
    plain = (F.abs(t) < 1e9) & (F.abs(t - F.rint(t)) < 0.499999)
    return F.when(plain, F.rint(t) / F.lit(10.0 ** digits)).otherwise(F.round(c, digits)) + 0.0


def no_nulls(df: DataFrame) -> DataFrame:
    """-1 for missing numbers and '' for missing text, so that types survive the comparison."""
    return df.select(*[F.coalesce(F.col(c), F.lit("") if t == "string" else F.lit(-1).cast(t)).alias(c)
                       if t in ("string", "int", "bigint", "double") else F.col(c) for c, t in df.dtypes])


def frame(spark: SparkSession, sf_dir: str, features=S.FEATURES, **kw) -> DataFrame:
    f = flows(spark, sf_dir)
    return W.host_windows(f, spec(flows_n=f.count(), **kw), features)


# ------------------------------------------------------------------ windowing
@register
def clean_flows(spark, sf):
    """The flow table written as text cells and coerced back."""
    from flowtide.sources.flows import finalise

    raw = flows(spark, sf)
    text = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
    return no_nulls(rounded(finalise(text)).withColumns({c: F.col(c).cast("int") for c in ("syn", "rst", "fin")}))


@register
def select_hosts(spark, sf):
    return W.select_hosts(flows(spark, sf), max_hosts=200)


def _of_hosts(fl, sp, df) -> DataFrame:
    return df.join(W.select_hosts(fl, sp.min_flows).select("host"), "host", "left_semi")


def _active(spark, sf) -> DataFrame:
    fl, sp = flows(spark, sf), spec()
    marked, _ = W._mark_selected(W.with_measures(fl, sp), sp)
    base = F.floor(W.origin(fl, sp.window_s) / sp.window_s)
    return _of_hosts(fl, sp, W.active_features(marked, sp).withColumn("window", F.col("window") - base))


@register
def out_features(spark, sf):
    return rounded(_active(spark, sf).filter("out_flows > 0").select("host", "window", *S.OUT_FEATURES))


@register
def in_features(spark, sf):
    return rounded(_active(spark, sf).filter("in_flows > 0").select("host", "window", *S.IN_FEATURES))


@register
def packet_features(spark, sf):
    return rounded(_active(spark, sf).select("host", "window", *S.PACKET_FEATURES, *S.MASK_FEATURES))


@register
def dominant_label(spark, sf):
    fl, sp = flows(spark, sf), spec()
    marked, _ = W._mark_selected(W.with_measures(fl, sp), sp)
    base = F.floor(W.origin(fl, sp.window_s) / sp.window_s)
    return _of_hosts(fl, sp, W.dominant_labels(marked, sp).withColumn("window", F.col("window") - base))


@register
def segments(spark, sf):
    sp = spec(window_s=60)
    return W.segments(W.with_measures(flows(spark, sf), sp), sp).select(
        (F.col("window") - F.col("base")).alias("window"), "segment",
        (F.col("seg_start") - F.col("base")).alias("seg_start"),
        (F.col("seg_end") - F.col("base")).alias("seg_end"))


@register
def host_windows(spark, sf):
    return rounded(frame(spark, sf))


@register
def host_edges(spark, sf):
    return W.host_edges(flows(spark, sf), spec())


# ------------------------------------------------------------------ graph
from flowtide.cluster import materialise  # noqa: E402
from flowtide.operators import (alerts as A, composition as C, counterfactual as CF,  # noqa: E402
                                decisions as D, detectors as H, evaluation as E, forecast as M,
                                graph as G, labelling as LB, scaling as SC, sequences as SQ,
                                statistics as ST)

THRESHOLD = 0.3


@register
def host_graph(spark, sf):
    return G.build_graph(flows(spark, sf))


@register
def top_pairs(spark, sf):
    return G.top_pairs(flows(spark, sf))


@register
def top_hosts(spark, sf):
    return G.top_hosts(flows(spark, sf))


@register
def neighbor_agg(spark, sf):
    f = materialise(frame(spark, sf).select("host", "window", *S.FEATURES))
    return rounded(G.neighbor_aggregate(f, W.host_edges(flows(spark, sf), spec()), S.FEATURES))


def forecast_frame(spark, sf, features=S.FEATURES) -> DataFrame:
    """Host windows with the mean of the persistence and stage-transition forecasts."""
    f = frame(spark, sf, features)
    f = materialise(f if features == S.FEATURES else f.select("host", "segment", "window", "stage", *features))
    t = M.TransitionModel.fit(f).forecast(f).withColumnsRenamed(
        {"future": "_tf", "stage_future_probs": "_tp"})
    half = lambda a, b: (a + b) / 2
    both = M.persistence(t).withColumns({
        "future": F.zip_with("future", "_tf", half),
        "stage_future_probs": F.zip_with("stage_future_probs", "_tp", lambda p, q: F.zip_with(p, q, half))})
    return both.withColumns({"lo": F.col("future"), "hi": F.col("future")}).drop("_tf", "_tp")


def peak_risk(spark, sf) -> DataFrame:
    return forecast_frame(spark, sf).select("window", "host", F.array_max("future").alias("risk"))


@register
def roles(spark, sf):
    """Attacker and victim roles in every window that has alerting hosts."""
    e = W.host_edges(flows(spark, sf), spec())
    return no_nulls(G.role_links(e, peak_risk(spark, sf), THRESHOLD)["roles"])


@register
def role_victims(spark, sf):
    e = W.host_edges(flows(spark, sf), spec())
    return G.role_links(e, peak_risk(spark, sf), THRESHOLD)["links"].select("window", "attacker", "victim", "grp")


SNAP = 400


def _snapshot(spark, sf):
    fc = forecast_frame(spark, sf)
    e = materialise(W.host_edges(flows(spark, sf), spec()))
    risk = fc.select("window", "host", F.array_max("future").alias("risk"),
                     A.mean_probs(F.col("stage_future_probs")).alias("stage_probs"))
    now = risk.filter(F.col("window") == SNAP)
    links = G.role_links(e, now, THRESHOLD)
    nodes = G.topology_nodes(fc, links["roles"], risk, SNAP, THRESHOLD, max_nodes=60)
    return nodes, e, links


@register
def topology_nodes(spark, sf):
    return _snapshot(spark, sf)[0]


@register
def topology_edges(spark, sf):
    nodes, e, links = _snapshot(spark, sf)
    return G.topology_edges(e, nodes, links["links"], SNAP)


# ------------------------------------------------------------------ detectors
@register
def scan_detect(spark, sf):
    return H.detect_scans(flows(spark, sf), 3600 * 24)


def _on_auth_ports(spark, sf) -> DataFrame:
    """Ports and hosts folded onto small sets, so that auth ports occur in the given data and meet the detector's own limits."""
    port = F.element_at(F.array(*[F.lit(p) for p in (22, 22, 21, 80, 443)]),
                        (F.col("dport") / 41 % 5 + 1).cast("int"))
    few = {"src_ip": ("10.9.0.", 3), "dst_ip": ("10.8.0.", 2)}
    return flows(spark, sf).withColumns({"dport": port.cast("long"), **{
        c: F.concat(F.lit(net), (F.col("flow_id") % n).cast("string")) for c, (net, n) in few.items()}})


@register
def brute_detect(spark, sf):
    return H.detect_brute_force(_on_auth_ports(spark, sf), 3600 * 24)


@register
def campaign_rows(spark, sf):
    f = _on_auth_ports(spark, sf)
    return H.campaigns(H.detect_scans(flows(spark, sf), 3600 * 24),
                       H.detect_brute_force(f, 3600 * 24), 3600 * 24)


@register
def window_count(spark, sf):
    return H.window_count(flows(spark, sf), 3600 * 24)


# ------------------------------------------------------------------ labels and sequences
def _schedule(spark, sf) -> DataFrame:
    """Attack stages per source and day, as a schedule; odd days name their targets."""
    day = F.floor(F.col("ts_end") / 86400)
    s = (flows(spark, sf).filter("label <> 'BENIGN'").groupBy(F.col("src_ip").alias("attacker"), day.alias("day"), "label")
         .agg(F.min("ts_end").alias("start"), F.max("ts_end").alias("end"), F.max("dst_ip").alias("tgt")))
    no = F.row_number().over(W.Window.partitionBy("attacker").orderBy("day", "label"))
    tgt = F.when(F.col("day") % 2 == 1, F.array("tgt")).otherwise(F.array().cast("array<string>"))
    return s.select("label", "attacker", tgt.alias("targets"), "start", "end", no.alias("entry_no"))


@register
def label_schedule(spark, sf):
    return LB.label_flows(flows(spark, sf), _schedule(spark, sf)).select("flow_id", "label")


KEYED = ["dataset", "capture"]


def captures(spark, sf) -> DataFrame:
    """The flows dealt to two datasets of two captures each."""
    return flows(spark, sf).withColumns({
        "dataset": F.concat(F.lit("d"), (F.col("flow_id") % 2).cast("string")),
        "capture": F.concat(F.lit("c"), F.floor(F.col("flow_id") % 4 / 2).cast("string"))})


def keyed_frame(spark, sf, features=S.FEATURES) -> DataFrame:
    c = captures(spark, sf)
    f = W.host_windows(c, spec(keys=tuple(KEYED), min_flows=5, flows_n=c.count()), features)
    return f.select(*KEYED, "host", "segment", "window", "t", *features, "stage", "label", "attack_out")


def keyed_stages(spark, sf, features=()) -> DataFrame:
    """The keyed frame with nothing but stages and the features a query reads."""
    return keyed_frame(spark, sf, features).drop("t", "label", "attack_out")


@register
def keyed_windows(spark, sf):
    return rounded(keyed_frame(spark, sf))


@register
def episode_fill(spark, sf):
    f = keyed_stages(spark, sf)
    return LB.fill_episode_gaps(f, 5, KEYED).select(*KEYED, "host", "segment", "window", "stage", "episode_stage")


@register
def sequence_starts(spark, sf):
    f = keyed_stages(spark, sf)
    numbers = materialise(SQ.capture_numbers(f, KEYED))
    return SQ.sequence_starts(f, 15, dealt=True, numbers=numbers).select(*KEYED, "host", "segment", "window", "block", "split")


def _sequences(spark, sf) -> DataFrame:
    f = keyed_stages(spark, sf)
    numbers = materialise(SQ.capture_numbers(f, KEYED))
    t = SQ.with_targets(LB.fill_episode_gaps(f, 5, KEYED), SQ.compromise(), dealt=True)
    return SQ.sequence_starts(t, 15, dealt=True, numbers=numbers)


@register
def future_target(spark, sf):
    return _sequences(spark, sf).select(*KEYED, "host", "segment", "window", "split", "y_future", "y_now",
                                        "hist_attack", "lead", "touches", "recon", "attack_rows")


@register
def balance_sample(spark, sf):
    s = _sequences(spark, sf).filter("split = 'train'")
    return SQ.balance_train(s).select(*KEYED, "host", "window", "touches")


@register
def sequence_weights(spark, sf):
    s = _sequences(spark, sf).filter("split = 'train'")
    return rounded(SQ.group_weights(s).withColumn("emphasis", SQ.emphasis()).select(
        *KEYED, "host", "window", "weight", "emphasis"), 9)


@register
def positive_weight(spark, sf):
    return rounded(SQ.positive_weight(_sequences(spark, sf).filter("split = 'train'")))


@register
def history_pad(spark, sf):
    f = rounded(frame(spark, sf).select("host", "segment", "window", *S.FEATURES))
    h = SQ.histories(f, [-1.0 - k for k in range(len(S.FEATURES))], 10, dealt=True)
    return h.select("host", "segment", "window", *[F.col("history")[i].alias(f"h{i}") for i in range(10)])


@register
def host_series(spark, sf):
    f = materialise(frame(spark, sf, window_s=600).select("host", "window", "out_flows", "stage"))
    return SQ.align_steps(f, {"out_flows": "0.0D", "stage": "0"}).select(
        "host", "step", "out_flows", "stage", "present")


# ------------------------------------------------------------------ scaling, statistics
@register
def scaler_stats(spark, sf):
    s = SC.FeatureScaler.statistics(frame(spark, sf))
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"mean_{f}").alias("mean"),
                               F.col(f"std_{f}").alias("std")) for f in S.FEATURES])
    return rounded(s.select(F.explode(pairs).alias("x")).select("x.*"))


@register
def scaled_features(spark, sf):
    f = materialise(frame(spark, sf))
    return rounded(SC.FeatureScaler.fit(f).transform(f).select("host", "window", *S.FEATURES), 5)


@register
def capture_norm(spark, sf):
    f = materialise(keyed_frame(spark, sf))
    st = SC.capture_stats(f, KEYED)
    return rounded(SC.capture_normalised(f, st, KEYED).select(*KEYED, "host", "window", *S.FEATURES), 5)


@register
def dataset_stats(spark, sf):
    return ST.capture_summary(captures(spark, sf), keyed_stages(spark, sf), KEYED)


@register
def top_labels(spark, sf):
    return ST.top_labels(captures(spark, sf), KEYED)


@register
def stage_windows(spark, sf):
    return ST.stage_windows(keyed_stages(spark, sf))


@register
def typical(spark, sf):
    return ST.typical(frame(spark, sf))


# ------------------------------------------------------------------ evaluation
def _scored(spark, sf) -> DataFrame:
    """Sequences scored by the failed-connection share of their last history row."""
    f = keyed_stages(spark, sf, ("out_failed_ratio", "in_flows"))
    numbers = materialise(SQ.capture_numbers(f, KEYED))
    f = LB.fill_episode_gaps(f, 5, KEYED)
    last = F.lead("out_failed_ratio", 9).over(SQ._order(KEYED))
    busy = F.lead("in_flows", 9).over(SQ._order(KEYED))
    t = SQ.with_targets(f, SQ.compromise(), dealt=True).withColumn("score", short(last + 0.1 * busy, 6))
    return SQ.sequence_starts(t, 15, dealt=True, numbers=numbers)


@register
def persistence_metrics(spark, sf):
    return E.metrics(_sequences(spark, sf), 0.5, "y_future", "y_now", ["dataset"])


@register
def average_precision(spark, sf):
    return rounded(E.average_precision(_scored(spark, sf), "y_future", "score", ["dataset"]))


@register
def pick_threshold(spark, sf):
    return rounded(E.pick_threshold(_scored(spark, sf), "y_future", "score"))


@register
def pick_threshold_macro(spark, sf):
    return rounded(E.pick_threshold_macro(materialise(_scored(spark, sf)), "dataset", "y_future"))


@register
def onset_metrics(spark, sf):
    return E.onset_metrics(_scored(spark, sf), 0.2, "score", 3600)


@register
def macro_ap(spark, sf):
    return rounded(E.macro_average_precision(_scored(spark, sf), "dataset", "y_future"))


# ------------------------------------------------------------------ transition forecast
@register
def transition_table(spark, sf):
    return rounded(M.transition_table(frame(spark, sf)), 9)


@register
def markov_rollout(spark, sf):
    return rounded(M.rollout_table(materialise(M.transition_table(frame(spark, sf)))), 9)


@register
def calibrate(spark, sf):
    from flowtide.functions.risk import calibrate as cal

    return rounded(frame(spark, sf).select("host", "window", cal(F.col("out_failed_ratio"), 1.7, -0.4).alias("p")))


# ------------------------------------------------------------------ alerts
@register
def first_alert(spark, sf):
    return no_nulls(A.first_alerts(forecast_frame(spark, sf), THRESHOLD))


@register
def overview(spark, sf):
    return no_nulls(A.overview(forecast_frame(spark, sf), THRESHOLD, window_s=3600))


@register
def lead_times(spark, sf):
    return no_nulls(A.timeline_summary(forecast_frame(spark, sf), THRESHOLD, window_s=3600))


@register
def lead_time_check(spark, sf):
    return no_nulls(A.lead_time_check(forecast_frame(spark, sf), THRESHOLD, 3600))


@register
def stage_hysteresis(spark, sf):
    return A.timeline(forecast_frame(spark, sf, ()), THRESHOLD, columns=("host", "step", "raw_stage", "held_stage", "stage_now")).select(
        "host", "step", "raw_stage", "held_stage", "stage_now")


# ------------------------------------------------------------------ decisions
def _requests(hosts: DataFrame) -> DataFrame:
    return hosts.filter("first_alert_step IS NOT NULL").select("host", F.col("first_alert_step").alias("step"))


def _context(spark, sf) -> DataFrame:
    fc, fl = D.stored_steps(forecast_frame(spark, sf)), flows(spark, sf)
    e = materialise(W.host_edges(fl, spec()))
    asks = _requests(A.first_alerts(fc, THRESHOLD)).unionByName(
        fc.select("host").distinct().withColumn("step", F.lit(SNAP)))
    return D.decision_context(fc, e, fl, materialise(asks), THRESHOLD, W.origin(fl, 3600), 3600)


@register
def decision_context(spark, sf):
    c = _context(spark, sf)
    return no_nulls(c.withColumn("c2_peers", F.array_join("c2_peers", ",")))


@register
def recommend(spark, sf):
    c = D.recommend(_context(spark, sf))
    return c.select("host", "step", "decision_stage", "recommended.id", "recommended.kind", "recommended.label",
                    F.size("alternatives").alias("n_alternatives"))


ACTION_BLOCK = {"kind": "block_source", "target": "10.0.0.5"}
ACTION_RATE = {"kind": "rate_limit", "target": "10.0.0.5"}


def _midpoint(spark, sf) -> float:
    r = flows(spark, sf).agg(F.min("ts_end"), F.max("ts_end")).first()
    return float(int((r[0] + r[1]) / 2))


@register
def counterfactual_block(spark, sf):
    return CF.apply_to_flows(flows(spark, sf), ACTION_BLOCK, _midpoint(spark, sf)).select("flow_id", "src_ip", "dst_ip")


@register
def counterfactual_throttle(spark, sf):
    return CF.apply_to_flows(flows(spark, sf), ACTION_RATE, _midpoint(spark, sf)).select("flow_id", "src_ip", "dst_ip")


@register
def display_risk(spark, sf):
    """Risk as a board shows it for two hosts under a block."""
    return rounded(CF.damped(peak_risk(spark, sf), ACTION_BLOCK, ["10.0.0.5", "10.0.0.7"]))


# ------------------------------------------------------------------ boards and reports
from flowtide.operators import attribution as AT  # noqa: E402
from flowtide.plans import analysis as AN, training as TR  # noqa: E402
from flowtide.streaming import assembly as PA, live as LV  # noqa: E402


def _decisions(spark, sf) -> DataFrame:
    """One decision per attacking source: its kind, target, time and enforcement."""
    s = (flows(spark, sf).filter("label <> 'BENIGN'").groupBy(F.col("src_ip").alias("host"))
         .agg(F.count("*").alias("n"), F.max("ts_end").alias("at"), F.max("dst_ip").alias("peer")))
    kinds = F.array(*[F.lit(k) for k in ("block_source", "isolate_host", "rate_limit", "block_pair", "monitor")])
    kind = F.element_at(kinds, (F.col("n") % 5 + 1).cast("int"))
    applied = (F.col("n") % 3 > 0) & (kind != "monitor")
    return s.select("host", kind.alias("kind"), F.col("host").alias("target"), "peer",
                    F.array().cast("array<string>").alias("peers"), F.lit(300).alias("ttl_s"), "at",
                    F.when(kind == "monitor", "reject").otherwise("accept").alias("choice"), applied.alias("applied"),
                    F.when(applied, F.col("at") + 300).alias("expires_at"), F.lit("none").alias("mode"),
                    F.concat(kind, F.lit(" "), "host").alias("action_label"), F.lit("").alias("message"))


@register
def event_feed(spark, sf):
    h = A.overview(forecast_frame(spark, sf), THRESHOLD, window_s=3600)
    return D.event_feed(h, _decisions(spark, sf), 3600, 400)


@register
def campaign_board(spark, sf):
    h = A.overview(forecast_frame(spark, sf), THRESHOLD, window_s=3600)
    hit = _decisions(spark, sf).filter("applied AND kind IN ('block_source', 'isolate_host')").select("host")
    return no_nulls(D.campaign_board(h, THRESHOLD, hit))


@register
def causal_status(spark, sf):
    h = A.overview(forecast_frame(spark, sf), THRESHOLD, window_s=3600)
    return no_nulls(D.causal_status(h, 300))


@register
def kill_chain_progress(spark, sf):
    return no_nulls(D.kill_chain_progress(A.timeline(forecast_frame(spark, sf, ()), THRESHOLD, columns=(
        "host", "truth_stage", "held_stage", "future_stage"))))


@register
def eligibility(spark, sf):
    e = D.eligibility(_decisions(spark, sf), protected=["10.0.0.5", "10.0.0.7"], live=True, enforce=True)
    return no_nulls(e.select("host", "kind", "enforcement.applied", "enforcement.message",
                             F.col("enforcement.expires_at").cast("double").alias("expires_at")))


@register
def whatif_menu(spark, sf):
    opts = D.all_options(D.recommend(_context(spark, sf)))
    return D.whatif_menu(opts).select("host", "step", "position", "option.kind", "option.label", "scope", "containment")


@register
def auto_contain(spark, sf):
    return D.auto_contain(D.recommend(_context(spark, sf)), THRESHOLD).select(
        "host", "choice", "step", "action.kind", "action.label")


@register
def decide(spark, sf):
    """Every third recommendation accepted, rejected, or changed to its last alternative; every ninth to one not offered."""
    r = materialise(D.recommend(_context(spark, sf)))
    n = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long") % 9
    choice = F.when(n < 3, "accept").when(n < 6, "reject").otherwise("modify")
    last = F.try_element_at("alternatives", F.lit(-1))["id"]
    picks = r.select("host", "step", choice.alias("choice"), F.when(n == 8, "no-such-option").when(n > 5, last).alias("option_id"))
    d = D.decide(r, picks)
    return no_nulls(d.select("host", "step", "choice", "option_id", "valid", F.col("action.kind").alias("kind"),
                             F.col("counterfactual.kind").alias("turned_down")))


@register
def narration(spark, sf):
    c = D.recommend(_context(spark, sf))
    return c.select("host", "step", D.narration(c).alias("text"))


@register
def incident_rows(spark, sf):
    fc = forecast_frame(spark, sf)
    return no_nulls(D.incident_rows(A.overview(fc, THRESHOLD, window_s=3600),
                                    A.timeline_summary(fc, THRESHOLD, window_s=3600), THRESHOLD, 3600))


@register
def containment(spark, sf):
    d = _decisions(spark, sf)
    now = d.agg(F.max("at") - 150).first()[0]
    fresh = d.withColumn("expires_at", F.col("at") + 86400 * 2)
    return LV.containment_spread(flows(spark, sf), fresh, float(now))


@register
def remap_compose(spark, sf):
    """An attack episode cut around its dominant pair, renamed, retagged and copied thrice."""
    scan = F.col("label") == "PortScan"
    ep = C.cut_episode(flows(spark, sf), scan, "10.13.37.5", "10.20.0.11", 10, 60 * 24, 60 * 24 * 5)
    three = C.replicas(C.retag_compromise(ep, "Exfiltration"), 3, 1920.0, lambda i: {
        "10.13.37.5": f"10.13.{37 + i}.5", "10.20.0.11": f"10.20.{i}.11"})
    return rounded(three.select("flow_id", "ts_start", "ts_end", "src_ip", "dst_ip", "label"), 4)


@register
def scenario_compose(spark, sf):
    """Traffic among a pair of hosts from time zero, renamed and relabelled."""
    top = G.top_pairs(flows(spark, sf).filter("src_ip <> dst_ip"), 1).first()
    s = C.scenario(flows(spark, sf), [top["src_ip"], top["dst_ip"]], ["10.50.0.11", "10.60.0.11"], "Botnet beacon")
    return rounded(s.select("flow_id", "ts_start", "ts_end", "src_ip", "dst_ip", "label"), 4)


@register
def clock_slice(spark, sf):
    return C.clock_slice(flows(spark, sf), "09:25", "10:25").select("flow_id")


@register
def offset_slice(spark, sf):
    """The second day of the recording."""
    return C.offset_slice(flows(spark, sf), 60 * 24, 60 * 48).select("flow_id")


@register
def episode_chain(spark, sf):
    """Scan, brute force and exfiltration on one pair, a day apart."""
    fl = flows(spark, sf)
    parts = [(fl, F.col("label") == label, 10 + 60 * 24 * i, 60 * 24 * 5)
             for i, label in enumerate(("PortScan", "SSH-Patator", "Exfiltration"))]
    chain = C.episode_chain(parts, "10.13.37.5", "10.20.0.11")
    return rounded(chain.select("flow_id", "ts_start", "ts_end", "src_ip", "dst_ip", "label"), 4)


@register
def campaign_compose(spark, sf):
    """The traffic among three servers from time zero, renamed."""
    c = C.campaign(flows(spark, sf), {f"10.0.0.{i}": f"10.99.0.{i}" for i in range(40)})
    return rounded(c.select("flow_id", "ts_start", "ts_end", "src_ip", "dst_ip", "label"), 4)


@register
def campaign_check(spark, sf):
    """Whether the leads of the overview are those of a proper campaign."""
    return C.validate_campaign(A.timeline_summary(forecast_frame(spark, sf), THRESHOLD, window_s=3600), 7, 3600, 3600 * 300)


@register
def packet_dropout(spark, sf):
    """Vectors of training sequences, half of them without packet features."""
    f = rounded(keyed_frame(spark, sf).select(*KEYED, "host", "window", *S.FEATURES))
    v = SQ.drop_packet_features(f.withColumn("v", F.array(SQ.vector())), "v")
    return v.select(*KEYED, "host", "window", F.col("v")[0].alias("v"))


def _read_back(spark, table: DataFrame, header: bool) -> DataFrame:
    """A table written as text files of a flow format into the shared folder and loaded by what the files look like."""
    import uuid

    from flowtide.cluster import shared_dir
    from flowtide.sources.flows import load_flows

    path = f"{shared_dir(spark)}/flowtide-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    table.write.option("header", header).csv(path)
    loaded = load_flows(spark, path)[0].drop("capture", "flow_id")
    return no_nulls(rounded(loaded.withColumns({c: F.col(c).cast("int") for c in ("syn", "rst", "fin")})))


@register
def load_cic_files(spark, sf):
    """Flows as CIC-style files: day-first seconds, microseconds, protocol numbers."""
    f = flows(spark, sf)
    when = F.date_format(F.timestamp_seconds("ts_start"), "d/M/yyyy H:mm:ss")
    number = F.when(F.col("proto") == "tcp", "6").when(F.col("proto") == "udp", "17").otherwise("1")
    cells = {" Source IP": F.col("src_ip"), " Source Port": F.col("sport"), " Destination IP": F.col("dst_ip"),
             " Destination Port": F.col("dport"), " Protocol": number, " Timestamp": when,
             " Flow Duration": F.round((F.col("ts_end") - F.col("ts_start")) * 1e6).cast("long"),
             " Total Fwd Packets": F.col("fwd_pkts").cast("long"), " Total Backward Packets": F.col("bwd_pkts").cast("long"),
             "Total Length of Fwd Packets": F.col("fwd_bytes").cast("long"),
             " Total Length of Bwd Packets": F.col("bwd_bytes").cast("long"), "FIN Flag Count": F.col("fin"),
             " SYN Flag Count": F.col("syn"), " RST Flag Count": F.col("rst"),
             "Init_Win_bytes_forward": F.coalesce(F.col("tcp_win").cast("long"), F.lit(-1)), " Label": F.col("label")}
    return _read_back(spark, f.select(*[c.alias(n) for n, c in cells.items()]), True)


@register
def load_argus_files(spark, sf):
    """Flows as Argus files: packets and bytes of both directions together, hexadecimal ports, states."""
    f = flows(spark, sf)
    total = F.col("fwd_bytes") + F.col("bwd_bytes")
    flags = F.concat(F.when(F.col("syn") > 0, "S").otherwise(""), F.when(F.col("fin") > 0, "F").otherwise(""),
                     F.when(F.col("rst") > 0, "R").otherwise(""), F.lit("_"))
    cells = {"StartTime": F.date_format(F.timestamp_micros(F.floor(F.col("ts_start") * 1e6)), "yyyy/MM/dd HH:mm:ss.SSSSSS"),
             "Dur": F.round(F.col("ts_end") - F.col("ts_start"), 6), "Proto": F.col("proto"), "SrcAddr": F.col("src_ip"),
             "Sport": F.concat(F.lit("0x"), F.lower(F.hex("sport"))), "Dir": F.lit("->"), "DstAddr": F.col("dst_ip"),
             "Dport": F.col("dport"), "State": flags, "sTos": F.lit(0), "dTos": F.lit(0),
             "TotPkts": (F.col("fwd_pkts") + F.col("bwd_pkts")).cast("long"), "TotBytes": total.cast("long"),
             "SrcBytes": F.col("fwd_bytes").cast("long"), "Label": F.concat(F.lit("flow=From-"), "label")}
    return _read_back(spark, f.select(*[c.alias(n) for n, c in cells.items()]), True)


@register
def load_unsw_files(spark, sf):
    """Flows as headerless UNSW-NB15 files."""
    from flowtide.sources.flows import UNSW_COLUMNS

    f = flows(spark, sf)
    benign = F.col("label") == "BENIGN"
    cells = {"srcip": F.col("src_ip"), "sport": F.col("sport"), "dstip": F.col("dst_ip"), "dsport": F.col("dport"),
             "proto": F.col("proto"), "state": F.when(F.col("rst") > 0, "RST").when(F.col("fin") > 0, "FIN").otherwise("ECO"),
             "sbytes": F.col("fwd_bytes").cast("long"), "dbytes": F.col("bwd_bytes").cast("long"), "sttl": F.col("ttl").cast("long"),
             "sloss": F.col("retrans").cast("long"), "Spkts": F.col("fwd_pkts").cast("long"), "Dpkts": F.col("bwd_pkts").cast("long"),
             "swin": F.col("tcp_win").cast("long"), "Stime": F.floor("ts_start"), "Ltime": F.floor("ts_end"),
             "attack_cat": F.when(benign, "").otherwise(F.col("label")), "Label": F.when(benign, 0).otherwise(1)}
    return _read_back(spark, f.select(*[cells.get(c, F.lit(0)).cast("string").alias(c) for c in UNSW_COLUMNS]), False)


@register
def load_canonical_files(spark, sf):
    """The flow table as it is, in text."""
    return _read_back(spark, flows(spark, sf).drop("flow_id"), True)


@register
def branch_timeline(spark, sf):
    """The timeline of what is left of the traffic when one source is blocked from step 300 on."""
    base, branch = _branches(spark, sf)
    t = AN.branch_timeline(base, branch, 300, columns=("host", "step", "risk", "raw_stage", "stage_now"))
    return rounded(t.select("host", "step", "risk", "raw_stage", "stage_now"))


@register
def campaign_actions(spark, sf):
    """One action for every stage that the first twelve alerting hosts reach."""
    c = _analysed(spark, sf).campaigns()
    return c.select("host", "stage_seen", "step", "step_risk", "recommended.id", "recommended.kind", "recommended.label")


@register
def action_queue(spark, sf):
    """Those actions with the lead of their host."""
    q = _analysed(spark, sf).action_queue()
    return no_nulls(q.select("host", "stage", "step", "risk", "recommended.label", "compromise_lead_s"))


def _branches(spark, sf):
    base = _analysed(spark, sf)
    return base, AN.replay(base, ACTION_BLOCK, 300)


def _analysed(spark, sf) -> AN.Analysis:
    """The whole analysis with the forecast that the other queries use."""
    fl = flows(spark, sf)
    sp = spec(flows_n=fl.count())
    f = materialise(W.host_windows(fl, sp, A.TRAFFIC))
    model = M.TransitionModel.fit(f)

    def both(d: DataFrame) -> DataFrame:
        t = model.forecast(d).withColumnsRenamed({"future": "_tf", "stage_future_probs": "_tp"})
        half = lambda a, b: (a + b) / 2
        return M.persistence(t).withColumns({
            "future": F.zip_with("future", "_tf", half),
            "stage_future_probs": F.zip_with("stage_future_probs", "_tp", lambda p, q: F.zip_with(p, q, half))
        }).drop("_tf", "_tp")

    return AN.analyze(fl, both, THRESHOLD, sp, columns=A.TRAFFIC, frame=f, cheap=True)


@register
def outcome(spark, sf):
    """Counterfactual replay of blocking one source from the middle of the recording."""
    base, branch = _branches(spark, sf)
    return no_nulls(AN.outcomes(base, branch, "10.0.0.5", 300, "10.0.0.5", ["10.0.0.35", "10.0.0.36"],
                                "Block all traffic from 10.0.0.5"))


# ------------------------------------------------------------------ packets
def packets(spark, sf) -> DataFrame:
    """Events as packets of twelve host pairs and three protocols: time runs 240 times faster, so that conversations last."""
    fl = flows(spark, sf)
    k = (F.col("dport") / 41).cast("long")
    lo = F.concat(F.lit("10.1.0."), (F.col("flow_id") % 4).cast("string"))
    hi = F.concat(F.lit("10.2.0."), (F.floor(F.col("flow_id") / 4) % 3).cast("string"))
    out, tcp, icmp = k % 3 > 0, F.col("proto") == "tcp", F.col("proto") == "icmp"

    def port(there: int, back: int) -> Column:
        return F.when(icmp, 0).when(out, there).otherwise(back).cast("long")

    return fl.select(
        (F.floor(F.col("ts_start") / 240 * 1e6) / 1e6).alias("ts"), F.when(out, lo).otherwise(hi).alias("src"),
        F.when(out, hi).otherwise(lo).alias("dst"), port(5000, 80).alias("sport"), port(80, 5000).alias("dport"), "proto",
        (40 + k * 10).alias("size"), (30 + k % 30).cast("double").alias("ttl"),
        F.when(~tcp, "").when(k % 5 == 0, "S").when(k % 7 == 0, "FA").when(k % 11 == 0, "R").otherwise("A").alias("flags"),
        F.when(tcp & (k % 4 == 0), 1024.0 + k).alias("win"), F.when(tcp, k % 6).alias("seq"), (k % 2).alias("plen"),
        F.lit(False).alias("frag"), F.col("flow_id").alias("packet_id"))


def _assembled(spark, sf, **kw) -> DataFrame:
    f = PA.packets_to_flows(packets(spark, sf), **kw)
    return no_nulls(rounded(f.select("ts_start", "ts_end", "src_ip", "dst_ip", "sport", "dport", "proto", "fwd_pkts", "bwd_pkts",
                                     "fwd_bytes", "bwd_bytes", "syn", "rst", "fin", "ttl", "tcp_win", "retrans")))


@register
def flow_assembly(spark, sf):
    return _assembled(spark, sf)


@register
def flow_ticks(spark, sf):
    """Assembly that hands over all open flows at every tick of 150 seconds, from chunks of 40 seconds."""
    return _assembled(spark, sf, tick_s=150.0, chunk_s=40)


@register
def live_tick(spark, sf):
    """Host features of the live buffer at a moment inside the recording, from what was seen until then."""
    fl = flows(spark, sf)
    now = float(fl.filter("label <> 'BENIGN'").agg(F.max("ts_end") - 3 * 86400.0).first()[0])
    t = LV.tick(fl.filter(F.col("ts_end") <= now), now, 3600.0)
    return rounded(t.frame.select("host", "segment", "window", *S.FEATURES, "stage"))


def _points(spark, sf) -> DataFrame:
    """Every host's risk at every step as live points, before and after a block."""
    fc = forecast_frame(spark, sf)
    return fc.select("host", F.col("window").cast("double").alias("t"), F.array_max("future").alias("risk_before"),
                     (F.array_max("future") * 0.08).alias("risk_after"), "future")


@register
def risk_history(spark, sf):
    return rounded(LV.risk_history(_points(spark, sf)).select("host", "t", "risk_before", "risk_after"))


@register
def live_board(spark, sf):
    p = materialise(_points(spark, sf))
    return no_nulls(rounded(LV.top_live_hosts(p, p.groupBy("host").agg(F.max("risk_before").alias("peak")), THRESHOLD, 3600.0)))


def _streamed(spark, sf, window_s: int, stride_s: int) -> DataFrame:
    """The events table read as a stream into host windows with all features. Windows are appended when the watermark
    has passed their end; those after the last watermark are added from the table."""
    import uuid

    from flowtide.cluster import shared_dir
    from flowtide.streaming import features as SF

    table = spark.read.parquet(f"{sf}/events.parquet")
    src = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    folder = f"{shared_dir(spark)}/flowtide-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    with SF.rocksdb_state(spark):
        q = (SF.stream_features(LV.with_event_time(flows_from_events(src), window_s), window_s, stride_s)
             .writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append")
             .trigger(availableNow=True).start(f"{folder}/windows"))
        q.awaitTermination()
    appended = spark.read.schema(SF.ROWS).parquet(f"{folder}/windows")
    return SF.closed(appended, flows_from_events(table), SF.watermark_of(q), window_s, stride_s)


@register
def stream_features(spark, sf):
    """All features of hourly host windows."""
    return rounded(_of_hosts(flows(spark, sf), spec(), _streamed(spark, sf, 3600, 3600)))


@register
def stream_windows(spark, sf):
    """All features of host windows of an hour that begin every half hour."""
    return rounded(_streamed(spark, sf, 3600, 1800))


# ------------------------------------------------------------------ fitted models
def _training_set(spark, sf) -> TR.SequenceSet:
    return TR.build_sequences(keyed_stages(spark, sf, S.FEATURES), dealt=True)


@register
def logreg_forecast(spark, sf):
    """Logistic forecast trained, thresholded and evaluated per dataset beside persistence."""
    data = _training_set(spark, sf)
    base = TR.train_baseline(data)
    return TR.evaluate_baseline(base, data.split("test"), 3600, ["dataset"])


@register
def shap_top(spark, sf):
    data = _training_set(spark, sf)
    base = TR.train_baseline(data)
    return TR.important_features(base, data.split("train"), data.split("test"))


@register
def multi_horizon(spark, sf):
    """Risk of each of the next five windows from the scaled history of ten, with a band of ten resampled copies."""
    from flowtide.operators.heads import HeadBank

    f = materialise(frame(spark, sf))
    scaler = SC.FeatureScaler.fit(f)
    rows = SQ.histories(scaler.transform(f).select("host", "segment", "window", "stage", *S.FEATURES), scaler.idle())
    ahead = W.Window.partitionBy("host", "segment").orderBy("window")
    rows = materialise(rows.select("host", "segment", "window", F.transform(F.flatten("history"), lambda v: v.cast("float")).alias("x"), *[
        (F.lead("stage", k).over(ahead) > 0).cast("int").alias(f"y{k}") for k in range(1, S.HORIZON_K + 1)]))
    known = rows.filter(F.col(f"y{S.HORIZON_K}").isNotNull())
    bank = HeadBank.fit(known, [f"y{k}" for k in range(1, S.HORIZON_K + 1)])
    return bank.forecast(rows.select("host", "window", "x")).drop("x")
