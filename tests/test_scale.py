"""Plans that send no per-window rows through the driver and gather none in a few tasks, whatever the files' sizes say."""
from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from checks import catalog as Q
from flowtide.cluster import ROWS_A_TASK, deal, materialise
from flowtide.operators import alerts as A, decisions as D, graph as G, scaling as SC, sequences as SQ, windows as W


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events of thirty users over two days."""
    at = str(tmp_path_factory.mktemp("events"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("error", "view", "purchase", "signup")]), (F.col("id") % 4 + 1).cast("int"))
    (spark.range(2000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 86).cast("timestamp_ntz").alias("ts"),
        (F.col("id") * 7 % 30).alias("user_id"), kind.alias("event_type"), (F.col("id") % 50 / 10.0).alias("value"),
        F.concat(F.lit('{"k": '), F.col("id") % 100, F.lit("}")).alias("props")).write.parquet(f"{at}/events.parquet"))
    return at


@pytest.fixture
def no_sizes(spark):
    """A planner that broadcasts what it is told to and nothing else, as it does when no side looks small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_decisions_broadcast_no_rows_of_windows(spark, folder, monkeypatch):
    plans, real = [], D.materialise
    for module in (D, G):
        monkeypatch.setattr(module, "materialise", lambda df: plans.append(plan(df)) or real(df))
    plans.append(plan(Q.decision_context(spark, folder)))
    assert len(plans) > 8
    for p in plans:
        assert not re.search(r"Broadcast\w*Join \[\w+#\d+L?, ", p)       # joins on more than the window alone
    assert any("SortMergeJoin" in p for p in plans)


def test_decisions_compute_forecasts_once(spark, folder, monkeypatch):
    """The arrays of the forecast stand in one plan; what follows reads the risk and stages stored by it."""
    plans, real = [], D.materialise
    for module in (D, G):
        monkeypatch.setattr(module, "materialise", lambda df: plans.append(plan(df)) or real(df))
    plans.append(plan(Q.decision_context(spark, folder)))
    assert sum("lambdafunction" in p and "zip_with" in p for p in plans) == 1


def frame(spark):
    f = {n: (F.col("id") % 9).cast("double") for n in Q.S.FEATURES}
    return spark.range(400).select(
        F.concat(F.lit("d"), F.col("id") % 1).alias("dataset"), F.concat(F.lit("c"), F.col("id") % 2).alias("capture"), F.concat(F.lit("h"), F.col("id") % 8).alias("host"),
        (F.col("id") % 1).cast("int").alias("segment"), F.floor(F.col("id") / 8).alias("window"), (F.col("id") % 5).cast("int").alias("stage"),
        (F.col("id") % 2).alias("touches"), *[c.alias(n) for n, c in f.items()])


def test_small_sides_are_broadcast(spark, folder, no_sizes):
    f, keys = frame(spark), ["dataset", "capture"]
    for df in (SQ.with_blocks(f), SQ.group_weights(f), SC.capture_normalised(f, materialise(SC.capture_stats(f, keys)), keys),
               Q.keyed_frame(spark, folder), W.host_edges(Q.captures(spark, folder), Q.spec(keys=("dataset", "capture"), hosts=["10.0.0.1"]))):
        assert "SortMergeJoin" not in plan(df)


def test_dense_rows_keep_their_tasks(spark, folder):
    f = frame(spark)
    steps = f.select("host", F.col("window").alias("step"), F.col("stage").alias("raw_stage"))
    for df in (SQ.with_targets(f, SQ.compromise(column="stage")), SQ.sequence_starts(f), A.hold_stages(steps),
               SQ.histories(f, [0.0] * len(Q.S.FEATURES)), Q.frame(spark, folder)):
        assert df.rdd.getNumPartitions() == 4                # of the test session; they are too small to be kept apart by bytes


def test_tasks_grow_with_rows(spark, folder):
    """More rows than a task is meant to get are dealt to more tasks than the session's setting says."""
    f, many = frame(spark), 10 * ROWS_A_TASK
    assert deal(f, "host", rows=many).rdd.getNumPartitions() == 10 and deal(f, "host", rows=5).rdd.getNumPartitions() == 4
    assert W.host_windows(Q.flows(spark, folder), Q.spec(flows_n=many)).rdd.getNumPartitions() == 10 * W.ROWS_A_FLOW
    steps = f.select("host", "window", "stage")
    assert SQ.align_steps(steps, {"stage": "0"}, rows=many).rdd.getNumPartitions() == 10


def test_sequences_keep_the_deal_of_windows(spark, folder):
    """Targets, blocks, histories and hysteresis go on in the tasks that the windows were dealt to."""
    for query in (Q._sequences, Q._scored, Q.sequence_starts, Q.history_pad, Q.stage_hysteresis):
        assert plan(query(spark, folder)).count("REPARTITION_BY_NUM") <= 1


def test_wide_projections_are_compiled(spark, folder):
    """The JVM compiles no method of more than 8,000 bytes."""
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        for query in (Q.scaled_features, Q.capture_norm, Q.packet_dropout, Q.history_pad, Q.keyed_windows):
            told = query(spark, folder)._jdf.queryExecution().explainString(
                spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
            assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", told))) < 8000, query.__name__
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_short_is_round(spark):
    """Ties, halves beside them, whole, huge, tiny and missing numbers."""
    rnd = random.Random(3)
    values = [0.0, -0.0, 1.0, 0.5, 2.5, 1e-7, 5e-6, 1.000005, 1.0000049999999999, 2.675, 1.005, 0.285, 1e9, 123456789.1234565, 1e17,
              1e300, float("nan"), float("inf"), -float("inf"), None]
    values += [rnd.uniform(-10, 10) for _ in range(2000)] + [rnd.randint(-10 ** 7, 10 ** 7) / 2e6 for _ in range(2000)]
    values += [-v for v in values if v is not None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (4, 5, 6, 9):
        a, b = Q.short(F.col("v"), digits), F.round("v", digits) + 0.0
        assert df.filter(~a.eqNullSafe(b)).collect() == []


def test_histories_by_hand(spark):
    rows = [("a", 0, w, float(w)) for w in range(4)] + [("a", 1, 9, 9.0), ("b", 0, 2, 7.0)]
    df = spark.createDataFrame(rows, "host string, segment int, window long, x double")
    got = {(r["host"], r["segment"], r["window"]): [v[0] for v in r["history"]]
           for r in SQ.histories(df, [-1.0], 3, features=["x"]).collect()}
    assert got == {("a", 0, 0): [-1, -1, 0], ("a", 0, 1): [-1, 0, 1], ("a", 0, 2): [0, 1, 2], ("a", 0, 3): [1, 2, 3],
                   ("a", 1, 9): [-1, -1, 9], ("b", 0, 2): [-1, -1, 7]}


def _forecasts(spark):
    """Two hosts with a pause, and what two windows ahead are forecast to hold."""
    rows = [("a", 0, 0, 0.0), ("a", 1, 2, 0.9), ("a", 5, 3, 0.6), ("a", 6, 3, 0.6), ("b", 2, 1, 0.2), (None, 4, 2, 0.7), (None, 6, 0, 0.1)]
    probs = F.array(*[F.array(1 - F.col("r"), *[F.when(F.col("stage") == s, F.col("r")).otherwise(0.0) for s in range(1, 7)]) for _ in range(2)])
    flat = F.array(F.col("r") / 2, F.col("r"))
    return spark.createDataFrame(rows, "host string, window long, stage int, r double").select(
        "host", "window", "stage", flat.alias("future"), flat.alias("lo"), flat.alias("hi"), F.col("r").alias("now"),
        probs.alias("stage_future_probs"), *[F.lit(1.0).alias(c) for c in A.TRAFFIC])


def test_timeline_of_some_columns_is_the_timeline(spark):
    f = _forecasts(spark)
    for threshold, quiet in ((0.3, 0), (0.0, 1)):
        whole = A.timeline(f, threshold, 2)
        assert tuple(whole.columns) == A.TIMELINE and whole.count() == 21
        rest = whole.filter("NOT present").select("risk", "raw_stage", "stage_now", "future_stage", "truth_stage", "future").distinct().collect()
        assert [tuple(r) for r in rest] == [(0.0, quiet, quiet, [quiet, quiet], 0, [0.0, 0.0])]
        for some in (("host", "step", "held_stage"), ("host", "step", "risk", "truth_stage", "future_stage")):
            part = A.timeline(f.drop(*A.TRAFFIC), threshold, 2, columns=some)
            assert set(part.columns) == set(some)
            assert sorted(map(str, part.select(*some).collect())) == sorted(map(str, whole.select(*some).collect()))
    got = {(r["host"], r["step"]): (r["raw_stage"], r["held_stage"], r["stage_now"]) for r in A.timeline(f, 0.3, 2).collect()}
    assert [got["a", s] for s in range(7)] == [(0, 0, 0), (2, 2, 2), (0, 0, 0), (0, 0, 0), (0, 0, 0), (3, 3, 3), (3, 3, 3)]
    assert got["b", 2] == (1, 1, 1) and got[None, 4] == (2, 2, 2) and got[None, 6] == (0, 0, 0)


def test_missing_hosts_are_one_host(spark):
    import pyarrow as pa

    assert A._differs(pa.array(["a", "a", None, None, "b", "a"])).tolist() == [False, True, False, True, True]


def test_hysteresis_passes_what_is_read(spark, folder):
    """No forecast arrays are dealt or sent through the pass that holds stages."""
    for query, most in ((Q.stage_hysteresis, 5), (Q.branch_timeline, 6)):
        p = plan(query(spark, folder))
        (passed,) = re.findall(r"MapInArrow run\([^)]*\)[^,]*, \[([^\]]*)\]", p)
        assert "future" not in passed and len(passed.split(", ")) <= most
        assert not [x for x in p.splitlines() if "Exchange" in x and "future" in x]


def test_queue_computes_its_parts_once(spark, folder, monkeypatch):
    calls = []
    for name, module in (("overview", A), ("stored_steps", D), ("host_windows", W)):
        monkeypatch.setattr(module, name, lambda *a, n=name, f=getattr(module, name), **b: calls.append(n) or f(*a, **b))
    plans, real = [], Q.materialise
    for module in (Q, Q.AN):
        monkeypatch.setattr(module, "materialise", lambda df: plans.append(set(df.columns)) or real(df))
    Q.action_queue(spark, folder)
    assert calls.count("overview") == 1 and calls.count("stored_steps") == 1
    assert not any("stage_future_probs" in c for c in plans) and sum("out_flows" in c for c in plans) == 1
