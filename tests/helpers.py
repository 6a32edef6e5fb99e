"""Literal rows shared by the tests."""
from flowtide.schema import FLOW_SCHEMA


def flow(i, ts, src, dst, dport=80, end=None, label="", fwd=3.0, bwd=2.0, fb=100.0, bb=50.0, proto="tcp",
         syn=1, rst=0, ttl=None, win=None, rt=None, sport=1):
    return (i, float(ts), float(ts + 1 if end is None else end), src, dst, sport, dport, proto, float(fwd), float(bwd),
            float(fb), float(bb), syn, rst, 1, ttl, win, rt, label)


def flows(spark, rows):
    return spark.createDataFrame(rows, FLOW_SCHEMA)
