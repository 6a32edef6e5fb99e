import random
from collections import defaultdict

from pyspark.sql import functions as F

from flowtide import schema as S
from flowtide.operators.windows import HostFeatures, WindowSpec, host_edges, host_windows
from tests.helpers import flow, flows


def test_idle_windows_are_filled(spark):
    f = flows(spark, [flow(1, 1_000_000, "10.0.0.1", "10.0.0.2"), flow(2, 1_000_300, "10.0.0.1", "10.0.0.2")])
    rows = host_windows(f, WindowSpec(min_flows=1)).filter("host = '10.0.0.1'").collect()
    assert len(rows) == 6
    assert sum(r["out_flows"] for r in rows) == 2
    assert sorted(r["window"] for r in rows) == list(range(6))


def test_a_long_silence_opens_a_segment(spark):
    f = flows(spark, [flow(1, 0, "a", "b"), flow(2, 660, "a", "b"), flow(3, 1380, "a", "b")])
    rows = host_windows(f, WindowSpec(min_flows=1)).filter("host = 'a'").collect()
    # steps of 11 and 12 windows, both more than 10
    assert {r["segment"] for r in rows} == {0, 1, 2} and len(rows) == 3
    near = flows(spark, [flow(1, 0, "a", "b"), flow(2, 600, "a", "b")])
    assert {r["segment"] for r in host_windows(near, WindowSpec(min_flows=1)).collect()} == {0}


def test_host_limit_and_late_selection_agree(spark):
    random.seed(1)
    rows = [flow(i, random.random() * 4000, f"h{random.randint(0, 9)}", f"h{random.randint(0, 9)}",
                 random.randint(1, 3000)) for i in range(600)]
    f = flows(spark, rows)
    early = host_windows(f, WindowSpec(min_flows=20, max_hosts=1000))
    late = host_windows(f, WindowSpec(min_flows=20, max_hosts=None))
    assert early.exceptAll(late).count() == 0 and late.exceptAll(early).count() == 0
    e1, e2 = host_edges(f, WindowSpec(max_hosts=1000)), host_edges(f, WindowSpec(max_hosts=None))
    assert e1.exceptAll(e2).count() == 0 and e2.exceptAll(e1).count() == 0


def test_features_against_plain_python_with_a_hub(spark):
    """A third of all flows come from one host and hit one port."""
    random.seed(2)
    rows = []
    for i in range(900):
        hub = i % 3 == 0
        rows.append(flow(i, random.random() * 1800, "hub" if hub else f"h{random.randint(0, 5)}",
                         f"h{random.randint(0, 5)}", 53 if hub else random.choice([22, 80, 2000, 5000]),
                         fwd=random.randint(1, 5), bwd=random.randint(0, 3), rst=int(random.random() < .1),
                         ttl=random.choice([None, 64.0]), rt=random.choice([None, 1.0]),
                         label=random.choice(["", "BENIGN", "PortScan", "Bot"])))
    got = {(r["host"], r["window"]): r for r in host_windows(flows(spark, rows), WindowSpec(min_flows=1)).collect()}
    t0 = min(r[2] for r in rows) // 60 * 60
    out, inn = defaultdict(list), defaultdict(list)
    for r in rows:
        w = int((r[2] - t0) // 60)
        out[r[3], w].append(r)
        inn[r[4], w].append(r)
    seen = set()
    for (h, w) in sorted(out, key=lambda k: k[1]):
        dst = {r[4] for r in out[h, w]}
        new = {d for d in dst if (h, d) not in seen}
        seen |= {(h, d) for d in dst}
        g = got[h, w]
        assert g["out_flows"] == len(out[h, w]) and g["out_distinct_dst"] == len(dst)
        assert g["out_new_peers"] == len(new)
        assert g["out_distinct_dport"] == len({r[6] for r in out[h, w]})
        assert abs(g["out_failed_ratio"] - sum(r[9] <= 0 or r[13] > 0 for r in out[h, w]) / len(out[h, w])) < 1e-9
    for (h, w), rs in inn.items():
        assert got[h, w]["in_flows"] == len(rs) and got[h, w]["in_distinct_src"] == len({r[3] for r in rs})
    assert all(0 <= g[c] <= 1 for g in got.values() for c in S.FEATURES if c.endswith(("_ratio", "_frac")) and c != "out_bwd_fwd_ratio")
    assert all(g["out_dport_entropy"] >= 0 for g in got.values())


def test_captures_are_windowed_independently(spark):
    rows = [flow(1, 0, "a", "b"), flow(2, 120, "a", "b"), flow(3, 6000, "a", "c"), flow(4, 6060, "a", "c")]
    f = flows(spark, rows).withColumn("capture", F.when(F.col("ts_start") < 1000, "x").otherwise("y"))
    both = host_windows(f, WindowSpec(min_flows=1, keys=("capture",)))
    for cap in ("x", "y"):
        alone = host_windows(f.filter(F.col("capture") == cap).drop("capture"), WindowSpec(min_flows=1))
        part = both.filter(F.col("capture") == cap).drop("capture")
        assert part.exceptAll(alone).count() == 0 and alone.exceptAll(part).count() == 0


def test_host_features_bundle(spark):
    f = flows(spark, [flow(1, 0, "a", "b"), flow(2, 10, "b", "a"), flow(3, 20, "a", "a")])
    h = HostFeatures.from_flows(f, WindowSpec(min_flows=1))
    assert {(r["a"], r["b"], r["flows"]) for r in h.edges.collect()} == {("a", "b", 1), ("b", "a", 1)}


def test_plan_prunes_columns_and_has_no_cartesian_product(spark, tmp_path):
    flows(spark, [flow(1, 0, "a", "b")]).write.parquet(str(tmp_path / "f"))
    f = spark.read.parquet(str(tmp_path / "f"))
    plan = host_windows(f)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    contacts = host_edges(f)._jdf.queryExecution().executedPlan().toString()
    assert "fwd_bytes" not in contacts and "tcp_win" not in contacts
