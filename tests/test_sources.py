import re

import pytest

from flowtide.functions import parsing as P
from flowtide.operators.windows import WindowSpec, host_windows
from flowtide.sources import datasets
from flowtide.sources.flows import (Files, UnsupportedFormat, load_report, detect_format, finalise, load_flows, register_format, resolve)
from pyspark.sql import functions as F

HEAD = (" Source IP, Source Port, Destination IP, Destination Port, Protocol, Timestamp, Flow Duration, Total Fwd Packets,"
        " Total Backward Packets,Total Length of Fwd Packets, Total Length of Bwd Packets, FIN Flag Count,"
        " SYN Flag Count, RST Flag Count,Init_Win_bytes_forward, Label")


def cic(tmp_path, day="5/7/2017", hour=9):
    rows = [f"192.168.10.5,{40000 + i},192.168.10.50,{20 + i % 7},6,{day} {hour}:{30 + i // 10},{1000 * (i + 1)},3,2,"
            f"120,80,0,1,0,8192,{'PortScan' if i > 40 else 'BENIGN'}" for i in range(60)]
    p = tmp_path / "cic.csv"
    p.write_text(HEAD + "\n" + "\n".join(rows) + "\n")
    return str(p)


def test_cic_csv(spark, tmp_path):
    f, name = load_flows(spark, cic(tmp_path))
    assert name == "cic" and f.count() == 60
    r = f.orderBy("sport").first()
    assert (r["proto"], r["dport"], r["tcp_win"], r["ttl"], r["syn"]) == ("tcp", 20, 8192.0, None, 1)
    assert r["ts_start"] == 1499247000.0 and abs(r["ts_end"] - r["ts_start"] - 0.001) < 1e-6
    w = host_windows(f, WindowSpec(min_flows=1)).collect()
    assert {x["stage"] for x in w} <= {0, 1} and max(x["stage"] for x in w if x["host"] == "192.168.10.5") == 1
    assert all(x["ttl_mean_mask"] == 0 for x in w)


def test_cic_clock(spark, tmp_path):
    f, _ = load_flows(spark, cic(tmp_path, hour=3))
    assert f.agg(F.min("ts_start")).first()[0] % 86400 == 15 * 3600 + 30 * 60


def test_argus(spark, tmp_path):
    p = tmp_path / "x.binetflow"
    p.write_text("StartTime,Dur,Proto,SrcAddr,Sport,Dir,DstAddr,Dport,State,sTos,dTos,TotPkts,TotBytes,SrcBytes,Label\n"
                 "2011/08/18 09:56:29.146156,1.5,tcp,1.1.1.1,0x0303,->,2.2.2.2,80,FSPA_SRA,0,0,10,1000,250,flow=From-Botnet-V1\n"
                 "2011/08/18 09:56:30.000000,0,udp,1.1.1.1,53,<->,2.2.2.3,53,CON,0,0,2,0,0,flow=Background\n")
    f, name = load_flows(spark, str(p))
    a, b = f.orderBy("ts_start").collect()
    assert name == "argus" and (a["sport"], a["fwd_pkts"], a["bwd_pkts"], a["bwd_bytes"]) == (771, 2.0, 8.0, 750.0)
    assert (a["syn"], a["rst"], a["fin"]) == (1, 1, 1) and (b["syn"], b["fwd_pkts"]) == (0, 2.0)
    assert abs(a["ts_start"] - 1313661389.146156) < 1e-5 and a["ts_end"] - a["ts_start"] == pytest.approx(1.5)


def test_unsw(spark, tmp_path):
    cells = ["0"] * 49
    cells[:6] = ["﻿59.166.0.1", "0x20", "149.171.126.9", "53", "tcp", "FIN"]
    cells[7:10], cells[11], cells[16:19], cells[28:30] = ["100", "200", "31"], "2", ["4", "5", "255"], ["1421927414", "1421927415"]
    cells[47:] = ["", "1"]
    p = tmp_path / "u.csv"
    p.write_text(",".join(cells) + "\n")
    f, name = load_flows(spark, str(p))
    r = f.first()
    assert name == "unsw" and r["src_ip"] == "59.166.0.1" and r["label"] == "attack" and r["sport"] == 32
    assert (r["ttl"], r["tcp_win"], r["retrans"], r["syn"], r["fin"], r["rst"]) == (31.0, 255.0, 2.0, 1, 1, 0)


def test_canonical_round_trip_and_unknown(spark, tmp_path):
    f, _ = load_flows(spark, cic(tmp_path))
    f.coalesce(1).write.option("header", True).csv(str(tmp_path / "c"))
    g, name = load_flows(spark, str(tmp_path / "c"))
    assert name == "canonical" and g.count() == 60 and g.select("src_ip").distinct().count() == 1
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n")
    with pytest.raises(UnsupportedFormat):
        detect_format(spark, str(bad))
    register_format("ab", lambda p, c: c == ["a", "b"], lambda s, p: None)
    assert detect_format(spark, str(bad)) == "ab"


def test_finalise_coerces_and_drops(spark):
    df = spark.createDataFrame([("1", "0.5", "a", "b", "x", "-3"), ("2", "9", "", "b", "1", "1"), ("q", "1", "a", "b", "1", "1")],
                               "ts_start string, ts_end string, src_ip string, dst_ip string, sport string, fwd_pkts string")
    (r,) = finalise(df).collect()
    assert (r["ts_end"], r["sport"], r["fwd_pkts"], r["label"], r["ttl"]) == (1.0, 0, 0.0, "", None)
    assert resolve([" Src IP ", "X"], {"s": ["Source IP", "src ip"]}) == {"s": " Src IP "}


def test_scalar_functions(spark):
    d = spark.createDataFrame([("6",), ("TCP ",), ("17",), ("58",), ("gre",), (None,), ("6.0",)], "v string")
    assert [r[0] for r in d.select(P.proto_name(F.col("v"))).collect()] == ["tcp", "tcp", "udp", "icmp", "other", "other", "tcp"]
    d = spark.createDataFrame([("0x0303",), ("80",), ("80.0",), ("",), ("zz",)], "v string")
    assert [r[0] for r in d.select(P.port(F.col("v"))).collect()] == [771, 80, 80, 0, 0]
    d = spark.createDataFrame([("10.1.2.3",), ("256.1.1.1",), ("::1",), ("fe80::1:2",), ("a",), ("1.2.3",)], "v string")
    assert [r[0] for r in d.select(P.is_ip(F.col("v"))).collect()] == [True, False, True, True, False, False]
    d = spark.createDataFrame([("01/02/2018 08:33:09",), ("1/2/2018 8:33",), ("41/02/2018 08:33:09",)], "v string")
    assert [r[0] for r in d.select(P.clock24_epoch(F.col("v"))).collect()] == [1517473989.0, None, None]
    assert d.select(P.epoch_to_iso(F.lit(1517473989.9))).first()[0] == "2018-02-01 08:33:09"
    assert d.select(P.subnet24(F.lit("10.1.2.3"))).first()[0] == "10.1.2.0/24"


def test_dataset_store_and_schedule(spark, tmp_path):
    f, _ = load_flows(spark, cic(tmp_path))
    h = datasets.build_dataset(f, "demo", WindowSpec(min_flows=1))
    datasets.write_dataset(h, str(tmp_path / "store"))
    back = datasets.load_windows(spark, str(tmp_path / "store"), ["demo"])
    assert back.count() == h.frame.count() and datasets.load_windows(spark, str(tmp_path / "store"), ["other"]).count() == 0
    assert "PartitionFilters: [isnotnull(dataset" in back._jdf.queryExecution().executedPlan().toString()
    p = tmp_path / "s.jsonl"
    p.write_text('{"label":"A","attacker":"x","targets":[],"start":1,"end":2}\n\n{"label":"B","attacker":"x","targets":["y"],"start":1,"end":2}\n')
    assert [(r["entry_no"], r["label"]) for r in datasets.load_schedule(spark, str(p)).orderBy("entry_no").collect()] == [(1, "A"), (2, "B")]


def test_calendar_forms(spark):
    base = 1499247000.0                                  # 2017-07-05 09:30:00 UTC
    want = {"2017-07-05 09:30:00": base, "7/5/2017 9:30:00 AM": base, "7/5/2017 9:30 PM": base + 12 * 3600, "7/5/2017 9:30": base,
            "2017-07-05 09:30:00 AM": base, "2017/07/05 09:30:00.250000": base + 0.25, "Jul 5, 2017 09:30": base,
            "July 5 2017 9:30:05 pm": base + 12 * 3600 + 5, "5 Jul 2017 09:30:00": base, "05-Jul-2017 09:30": base,
            "2017-07-05T09:30:00Z": base, "2017-07-05 11:30:00+02:00": base, "7/5/2017 12:00 AM": base - 9.5 * 3600,
            "25/7/2017 09:30": base + 20 * 86400, "Xyz 5, 2017 09:30": None, "13/13/2017 9:30": None, "": None, "7/5/2017 25:00": None}
    df = spark.createDataFrame(list(want.items()), "t string, want double")
    for r in df.withColumn("got", P.calendar_epoch(F.col("t"))).collect():
        assert r["got"] == pytest.approx(r["want"]) if r["want"] is not None else r["got"] is None, r["t"]


def test_folder_of_several_formats(spark, tmp_path):
    cic(tmp_path)
    head = HEAD.split(",")
    (tmp_path / "other.csv").write_text(",".join(head[::-1]) + "\nBENIGN,8192,0,1,0,80,120,2,3,1000,5/7/2017 9:30,6,80,10.0.0.2,7,10.0.0.1\n")
    (tmp_path / "x.binetflow").write_text(
        "StartTime,Dur,Proto,SrcAddr,Sport,Dir,DstAddr,Dport,State,sTos,dTos,TotPkts,TotBytes,SrcBytes,Label\n"
        "2011/08/18 09:56:29.146156,1.5,tcp,1.1.1.1,0x0303,->,2.2.2.2,80,FSPA_SRA,0,0,10,1000,250,flow=From-Botnet-V1\n")
    f, name = load_flows(spark, str(tmp_path))
    assert name == "mixed" and f.count() == 62
    assert {(r["capture"], r["n"]) for r in f.groupBy("capture").agg(F.count("*").alias("n")).collect()} == {
        ("cic", 60), ("other", 1), ("x", 1)}
    one = f.filter("capture = 'other'").first()
    assert (one["src_ip"], one["dst_ip"], one["dport"], one["fwd_bytes"]) == ("10.0.0.1", "10.0.0.2", 80, 120.0)


def test_files_of_one_name_are_judged_apart(spark, tmp_path):
    """A 2017 file on the 12-hour clock beside a 2018 one of the same name, and a third with numeric times."""
    for folder, day, hour in (("a", "5/7/2017", 3), ("b", "5/7/2018", 3)):
        (tmp_path / folder).mkdir()
        path = cic(tmp_path / folder, day, hour)
        if folder == "b":       # the 24-hour clock shows seconds
            with open(path) as f:
                timed = f.read()
            with open(path, "w") as f:
                f.write(re.sub(r"(2018 \d+:\d\d)", r"\1:00", timed))
    (tmp_path / "c" / "deep").mkdir(parents=True)
    rows = "\n".join(f"10.0.0.{i},1,10.0.1.1,2,6,{1_500_000_000 + i},1000,1,1,1,1,0,1,0,1,BENIGN" for i in range(5))
    (tmp_path / "c" / "deep" / "cic.csv").write_text(HEAD + "\n" + rows + "\n")
    alone = {f: load_flows(spark, str(tmp_path / f / "cic.csv"))[0].agg(F.count("*"), F.min("ts_start")).first() for f in ("a", "b")}
    whole, name = load_flows(spark, [str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "c" / "deep")])
    got = {r["capture"]: (r["n"], r["t"]) for r in whole.groupBy("capture").agg(F.count("*").alias("n"), F.min("ts_start").alias("t")).collect()}
    assert name == "cic" and got == {"a/cic": tuple(alone["a"]), "b/cic": tuple(alone["b"]), "c/deep/cic": (5, 1_500_000_000.0)}
    assert got["a/cic"][1] % 86400 == 15.5 * 3600 and got["b/cic"][1] % 86400 == 3.5 * 3600


def test_capture_names():
    assert Files(["file:/x/a.csv", "file:/x/b.csv"]).endings is False
    both = Files(["file:/x/a.csv", "file:/x/a.txt"])
    assert both.endings and both.depth == 2 == Files(["file:///x/a.csv"]).depth and Files(["file:/x/a/m.csv"], ["file:/x/a/m.csv", "file:/x/b/m.csv"]).depth == 2


def test_load_report_counts_dropped_rows(spark, tmp_path):
    cic(tmp_path)
    with open(tmp_path / "cic.csv", "a") as f:
        f.write("192.168.10.5,1,192.168.10.6,2,6,not a time,1,1,1,1,1,0,0,0,1,BENIGN\n,1,192.168.10.6,2,6,5/7/2017 9:30,1,1,1,1,1,0,0,0,1,x\n")
    (r,) = load_report(spark, str(tmp_path / "cic.csv")).collect()
    assert (r["capture"], r["format"], r["rows"], r["dropped"], r["first"]) == ("cic", "cic", 62, 2, 1499247000.0)
    assert load_flows(spark, str(tmp_path / "cic.csv"))[0].count() == 60


def test_a_second_build_reads_only_what_changed(spark, tmp_path):
    import os
    import random

    from flowtide.schema import FLOW_SCHEMA
    from tests.helpers import flow

    def write(name, n, seed):
        random.seed(seed)
        rows = [flow(i, 1000 + random.random() * 900, f"h{random.randint(0, 3)}", f"h{random.randint(4, 6)}") for i in range(n)]
        os.makedirs(os.path.dirname(tmp_path / "in" / name), exist_ok=True)
        spark.createDataFrame(rows, FLOW_SCHEMA).drop("flow_id").toPandas().to_csv(tmp_path / "in" / name, index=False)

    def build():
        got = datasets.build_changed(spark, path, root, "net", spec)
        return {r["capture"]: r["status"] for r in got.collect()}

    def check():
        full = datasets.build_dataset(load_flows(spark, path)[0], "net", spec)
        for part, want in (("windows", full.frame), ("edges", full.edges)):
            back = datasets.load_built(spark, root, "net", part).select(*want.columns)
            assert back.exceptAll(want).isEmpty() and want.exceptAll(back).isEmpty() and not back.isEmpty()

    path, root, spec = str(tmp_path / "in"), str(tmp_path / "store"), WindowSpec(min_flows=1)
    for i, name in enumerate(("001.csv", "002.csv", "mon.csv")):
        write(name, 60, i)
    assert build() == {"001": "new", "002": "new", "mon": "new"}
    check()
    assert set(build().values()) == {"same"}
    write("002.csv", 80, 9)                                     # other content
    os.utime(tmp_path / "in" / "mon.csv", (1, 1))               # another time, the same content
    read = []
    loader = datasets.load_flows
    datasets.load_flows = lambda s, p, only: read.append(only) or loader(s, p, only)
    try:
        assert build() == {"001": "same", "002": "changed", "mon": "touched"}
    finally:
        datasets.load_flows = loader
    assert [[os.path.basename(f) for f in only] for only in read] == [["002.csv"]]
    assert {os.path.basename(f) for f in loader(spark, path, read[0])[0].inputFiles()} == {"002.csv"}
    check()
    os.remove(tmp_path / "in" / "001.csv")
    write("new.csv", 30, 4)
    assert build() == {"001": "gone", "002": "same", "mon": "same", "new": "new"}
    check()
