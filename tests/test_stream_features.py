"""All features from a stream: equal to batch, through a restart, with state that is forgotten."""
import math
import random
import timeit

import pandas as pd

from flowtide import schema as S
from flowtide.operators import windows as W
from flowtide.schema import FLOW_SCHEMA
from flowtide.streaming import features as SF, live as LV
from tests.helpers import flow


def recorded(n=240, seed=4, start=6000.0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        t = start + i * 7 + rnd.random() * 30
        a, b = rnd.sample("ABCDEF", 2)
        rows.append(flow(i, t, a, b, dport=rnd.choice([22, 80, 443, 5000]), end=t + rnd.random() * 3, fwd=rnd.randint(0, 9),
                         bwd=rnd.randint(0, 3), proto=rnd.choice(["tcp", "udp", "icmp"]), syn=rnd.randint(0, 1), rst=rnd.randint(0, 1),
                         ttl=rnd.choice([None, 64.0, 128.0]), win=rnd.choice([None, 1024.0]), rt=rnd.choice([None, 0.0, 1.0])))
    return rows


def run(spark, folder, out, files, **kw):
    src = spark.readStream.schema(FLOW_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    with SF.rocksdb_state(spark):
        q = (SF.stream_features(LV.with_event_time(src, 60, 0), 60, **kw).writeStream.format("parquet")
             .option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start(f"{out}/rows"))
        q.awaitTermination()
    return spark.read.schema(SF.ROWS).parquet(f"{out}/rows"), SF.watermark_of(q)


def by_key(rows):
    got = {(r["host"], r["window_start"]): [round(r[f], 6) for f in S.FEATURES] for r in rows}
    assert len(got) == len(rows)            # no window twice
    return got


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    rows, folder = recorded(), tmp_path / "in"
    parts = [rows[:100], rows[100:180], rows[180:]]
    for part in parts[:2]:
        spark.createDataFrame(part, FLOW_SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    first, mark = run(spark, str(folder), tmp_path, 2)
    early = first.count()
    assert 0 < early and mark is not None
    spark.createDataFrame(parts[2], FLOW_SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    later, mark2 = run(spark, str(folder), tmp_path, 3)
    assert later.count() > early and mark2 > mark
    flows = spark.createDataFrame(rows, FLOW_SCHEMA)
    got = by_key(SF.closed(later, flows, mark2, 60).collect())
    spec = W.WindowSpec(window_s=60, t0=0.0)
    marked, _ = W._mark_selected(W.with_measures(flows, spec), spec)
    want = W.active_features(marked, spec).collect()
    assert got == {(r["host"], r["window"] * 60.0): [round(r[f], 6) for f in S.FEATURES] for r in want}
    assert got == by_key(SF.batch_features(flows, 60).collect())


def test_peers_are_forgotten(spark, tmp_path):
    """A contact that the watermark has left behind by the time to live is new again; within it, it is not."""
    folder = str(tmp_path / "in")
    for i, t in enumerate([1000.0, 1200.0, 9000.0, 9300.0, 20000.0]):
        peer = "far" if t > 15000 else "B"
        spark.createDataFrame([flow(i, t, "A", peer, end=t)], FLOW_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    for ttl, want in ((3600.0, [1.0, 0.0, 1.0, 0.0]), (86400.0, [1.0, 0.0, 0.0, 0.0])):
        out, mark = run(spark, folder, tmp_path / str(int(ttl)), 5, ttl_s=ttl)
        rows = sorted((r["window_start"], r["out_new_peers"]) for r in out.filter("host = 'A'").collect())
        assert [n for _, n in rows] == want and mark > 9360


def test_an_empty_stream_is_closed_by_the_recording(spark):
    flows = spark.createDataFrame(recorded(20), FLOW_SCHEMA)
    none = spark.createDataFrame([], SF.ROWS)
    assert SF.closed(none, flows, None, 60).count() == SF.batch_features(flows, 60).count() > 0
    assert SF.batch_features(flows.limit(0), 60).collect() == []


def odd_cells():
    """Cells of one host over two windows, with a missing peer, a missing port and no hop counts."""
    sums = {k: 0.0 for k in SF._PAIR_SUMS}
    rows = [(0, "B", 80.0, 0, 2.0, 0.0), (0, "B", 22.0, 0, 2.0, 0.0), (0, "C", 80.0, 0, 4.0, None), (0, None, None, 0, 1.0, None),
            (1, "B", 80.0, 0, 3.0, None), (0, "B", 80.0, 3_600_000_000, 5.0, None)]
    return pd.DataFrame([{**sums, "side": s, "peer": p, "dport": d, "start": w, "flows": n, "ttl_sum": float("nan"), "ttl_n": 0.0,
                          "contact": c} for s, p, d, w, n, c in rows])


def test_feature_rows_of_odd_cells():
    c = odd_cells()
    r = SF.feature_rows("A", c, c["contact"])
    assert r["window_start"].tolist() == [0.0, 3600.0]
    assert r["out_flows"].tolist() == [9.0, 5.0] and r["in_flows"].tolist() == [3.0, 0.0]
    assert r["out_distinct_dst"].tolist() == [2.0, 1.0] and r["out_distinct_dport"].tolist() == [2.0, 1.0]
    assert r["out_new_peers"].tolist() == [1.0, 0.0] and r["in_distinct_src"].tolist() == [1.0, 0.0]
    want = math.log2(9) - (6 * math.log2(6) + 2 * math.log2(2)) / 9
    assert abs(r["out_dport_entropy"][0] - want) < 1e-12 and r["ttl_mean"].tolist() == [0.0, 0.0]


def test_feature_rows_cost_little_a_host():
    """A stream calls this once a host and micro-batch; with tables grouped by name a call took 40 ms."""
    c = odd_cells()
    SF.feature_rows("A", c, c["contact"])
    best = min(timeit.repeat(lambda: SF.feature_rows("A", c, c["contact"]), number=5, repeat=5)) / 5
    assert best < 0.015


def test_closing_windows_stays_in_the_jvm(spark):
    """The windows after the watermark are aggregated, not handed to Python one (host, window) at a time."""
    flows = spark.createDataFrame(recorded(20), FLOW_SCHEMA)
    plan = SF.batch_features(flows, 60, after=6000.0)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan
