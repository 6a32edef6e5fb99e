"""Flow files of several formats -> the canonical flow table.

Every reader takes all columns as text and coerces them, so malformed cells become NULL
(or the column's default) rather than failing the job. A path may name one file, a
folder or a pattern; decisions that depend on a file's content (which clock a CIC file
uses, whether times are numeric) are taken per file over all its rows.
"""
from __future__ import annotations

import os
import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowtide import schema as S
from flowtide.functions import parsing as P


class UnsupportedFormat(ValueError):
    """The file is not one of the registered flow formats."""


# Header names per field of CIC-style flow files, tried in order.
CIC_ALIASES = {
    "src_ip": ["Source IP", "Src IP", "src_ip"],
    "dst_ip": ["Destination IP", "Dst IP", "dst_ip"],
    "sport": ["Source Port", "Src Port", "src_port"],
    "dport": ["Destination Port", "Dst Port", "dst_port"],
    "proto": ["Protocol", "protocol"],
    "ts": ["Timestamp", "timestamp"],
    "dur": ["Flow Duration", "flow_duration"],
    "fwd_pkts": ["Total Fwd Packets", "Tot Fwd Pkts", "tot_fwd_pkts"],
    "bwd_pkts": ["Total Backward Packets", "Tot Bwd Pkts", "tot_bwd_pkts"],
    "fwd_bytes": ["Total Length of Fwd Packets", "TotLen Fwd Pkts", "totlen_fwd_pkts"],
    "bwd_bytes": ["Total Length of Bwd Packets", "TotLen Bwd Pkts", "totlen_bwd_pkts"],
    "syn": ["SYN Flag Count", "SYN Flag Cnt", "syn_flag_cnt"],
    "rst": ["RST Flag Count", "RST Flag Cnt", "rst_flag_cnt"],
    "fin": ["FIN Flag Count", "FIN Flag Cnt", "fin_flag_cnt"],
    "tcp_win": ["Init_Win_bytes_forward", "Init Fwd Win Byts", "init_fwd_win_byts"],
    "label": ["Label", "label"],
}

# Column order of headerless UNSW-NB15 files.
UNSW_COLUMNS = [
    "srcip", "sport", "dstip", "dsport", "proto", "state", "dur", "sbytes", "dbytes", "sttl",
    "dttl", "sloss", "dloss", "service", "Sload", "Dload", "Spkts", "Dpkts", "swin", "dwin",
    "stcpb", "dtcpb", "smeansz", "dmeansz", "trans_depth", "res_bdy_len", "Sjit", "Djit",
    "Stime", "Ltime", "Sintpkt", "Dintpkt", "tcprtt", "synack", "ackdat", "is_sm_ips_ports",
    "ct_state_ttl", "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd", "ct_srv_src",
    "ct_srv_dst", "ct_dst_ltm", "ct_src_ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm",
    "ct_dst_src_ltm", "attack_cat", "Label",
]

# Connection states of UNSW-NB15 that imply a SYN.
UNSW_SYN_STATES = ["REQ", "CON", "FIN", "INT", "RST", "ACC", "CLO"]


def _finite(c: Column) -> Column:
    return c.isNotNull() & (F.abs(c) < float("inf"))


def finalise(df: DataFrame, extra: Sequence[str] = (), drop: bool = True) -> DataFrame:
    """Coerce to the flow schema, add missing columns, drop rows without hosts or times; with `drop` off these stay and
    a column `usable` tells them.

    `flow_id` defaults to a hash of the row, so that equal inputs number equally however
    they are partitioned; identical rows may share it because they are interchangeable.
    """
    have = {c: F.col(c) for c in df.columns}
    out = {}
    for f in S.FLOW_SCHEMA:
        kind, raw = f.dataType.simpleString(), have.get(f.name)
        if f.name == "flow_id":
            continue
        if kind == "string":
            out[f.name] = F.coalesce(raw.cast("string"), F.lit("")) if raw is not None else F.lit("")
        elif kind == "double":
            out[f.name] = P.number(raw) if raw is not None else F.lit(None).cast("double")
        else:
            v = P.number(raw).try_cast(kind) if raw is not None else F.lit(0).cast(kind)
            out[f.name] = F.coalesce(v, F.lit(0).cast(kind))
    typed = df.select(*extra, *([F.col("flow_id").cast("long")] if "flow_id" in have else []),
                      *[c.alias(n) for n, c in out.items()])
    counts = {c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
              for c in ("fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes")}
    usable = ((F.length("src_ip") > 0) & (F.length("dst_ip") > 0)
              & _finite(F.col("ts_start")) & _finite(F.col("ts_end")))
    typed = typed.filter(usable) if drop else typed.withColumn("usable", F.coalesce(usable, F.lit(False)))
    typed = typed.withColumns({**counts, "ts_end": F.greatest("ts_end", "ts_start")})
    if "flow_id" not in have:
        typed = typed.withColumn("flow_id", F.xxhash64(*S.FLOW_COLUMNS))
    return typed.select(*extra, *[f.name for f in S.FLOW_SCHEMA], *([] if drop else ["usable"]))


def resolve(columns: Sequence[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """Field -> actual column, matching names trimmed and case-insensitively."""
    actual = {c.replace("﻿", "").strip().lower(): c for c in columns}
    return {field: actual[hit] for field, names in aliases.items()
            for hit in [next((n.lower() for n in names if n.lower() in actual), None)] if hit}


class Files(list):
    """Files that are read together. A capture is named by its file's path below `depth` folders, without the ending
    unless two files differ by nothing else; so two files never share a name."""

    _SCHEME = r"^[A-Za-z0-9+.-]+:/+"       # listings write file:///x where rows write file:/x

    def __init__(self, paths: Sequence[str], every: Sequence[str] | None = None):
        super().__init__(sorted(paths))
        folders = [re.sub(self._SCHEME, "/", p).split("/")[:-1] for p in every or paths]
        self.depth = len(os.path.commonprefix(folders))
        stems = {re.sub(r"\.[^./]*$", "", p) for p in every or paths}
        self.endings = len(stems) < len(set(every or paths))

    def capture(self, file: str = "_metadata.file_path") -> Column:
        path = F.regexp_replace(F.col(file), self._SCHEME, "/")
        below = F.array_join(F.slice(F.split(path, "/"), self.depth + 1, 1 << 20), "/")
        return below if self.endings else F.regexp_replace(below, r"\.[^./]*$", "")


def _read_csv(spark: SparkSession, path, header: bool, columns: Sequence[str] | None = None) -> DataFrame:
    """Text cells with the capture's name and `_file`, the whole path that facts of a file are joined on."""
    reader = spark.read.option("mode", "PERMISSIVE").option("header", header)
    if columns:
        reader = reader.schema(", ".join(f"`{c}` STRING" for c in columns))
    raw = reader.csv(list(path) if isinstance(path, Files) else path)
    files = path if isinstance(path, Files) else Files(raw.inputFiles())
    return raw.withColumns({"capture": files.capture(), "_file": F.col("_metadata.file_path")})


def _per_file(df: DataFrame, facts: dict[str, Column]) -> DataFrame:
    """Attach aggregates of each row's file."""
    per = df.groupBy("_file").agg(*[c.alias(n) for n, c in facts.items()])
    return df.join(per, "_file")


def _epoch_by_file(df: DataFrame, raw: str, calendar: Callable[[Column], Column] = P.calendar_epoch) -> DataFrame:
    """Add `_epoch`: numeric times are seconds, or milliseconds when most exceed 1e11."""
    n = P.number(F.col(raw))
    d = _per_file(df, {"_num": F.avg(n.isNotNull().cast("int")),
                       "_ms": F.avg((n > 1e11).cast("int"))})
    numeric = n / F.when(F.col("_ms") >= 0.5, 1000.0).otherwise(1.0)
    return d.withColumn("_epoch", F.when(F.col("_num") > 0.9, numeric).otherwise(calendar(F.col(raw)))).drop(
        "_num", "_ms")


def load_cic(spark: SparkSession, path, drop: bool = True) -> DataFrame:
    """CIC-style flow CSV. Day-first times are read on a 24-hour clock when the file shows
    an hour above 12 or the year 2018, else on a 12-hour clock without AM/PM."""
    raw = _read_csv(spark, path, True)
    cols = resolve(raw.columns, CIC_ALIASES)
    missing = {"src_ip", "dst_ip", "ts", "dur", "fwd_pkts", "bwd_pkts"} - cols.keys()
    if missing:
        raise UnsupportedFormat(f"{path}: flow CSV without {sorted(missing)}; per-host forecasting needs "
                                "source/destination IPs and timestamps")
    df = raw.select("capture", "_file", *[F.col(f"`{c}`").alias(f) for f, c in cols.items()])
    for name, default in (("sport", "0"), ("dport", "0"), ("proto", "other"), ("label", ""), ("tcp_win", None),
                          *((c, "0") for c in ("fwd_bytes", "bwd_bytes", "syn", "rst", "fin"))):
        if name not in cols:
            df = df.withColumn(name, F.lit(default).cast("string"))
    ts = P.text(F.col("ts"))
    shaped = F.coalesce(F.col("ts").rlike(P.DMY), F.lit(False))
    hour = F.regexp_extract(F.col("ts"), r" (\d{1,2}):", 1).try_cast("int")
    df = _per_file(df, {"_dmy": F.avg(F.when(F.col("ts").isNotNull(), shaped.cast("int"))),
                        "_late": F.max(F.when(shaped, (hour > 12) | F.col("ts").contains("2018")))})
    df = _epoch_by_file(df.withColumn("ts", ts), "ts")
    start = F.when(F.col("_dmy") > 0.9, F.when(F.col("_late"), P.clock24_epoch(ts)).otherwise(
        P.clock12_epoch(ts))).otherwise(F.col("_epoch"))
    dur = F.greatest(F.coalesce(P.number(F.col("dur")), F.lit(0.0)), F.lit(0.0)) / 1e6
    win = P.number(F.col("tcp_win"))
    flags = {c: (F.coalesce(P.number(F.col(c)), F.lit(0.0)) > 0).cast("int") for c in ("syn", "rst", "fin")}
    return finalise(df.select(
        "capture", start.alias("ts_start"), (start + dur).alias("ts_end"), P.text(F.col("src_ip")).alias("src_ip"),
        P.text(F.col("dst_ip")).alias("dst_ip"), P.port(F.col("sport")).alias("sport"),
        P.port(F.col("dport")).alias("dport"), P.proto_name(F.col("proto")).alias("proto"),
        "fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes", *[c.alias(n) for n, c in flags.items()],
        F.when(win > 0, win).alias("tcp_win"), P.text(F.col("label")).alias("label")), ["capture"], drop)


def load_argus(spark: SparkSession, path, drop: bool = True) -> DataFrame:
    """Argus bidirectional flows (.binetflow): packets are split by the source byte share."""
    raw = _read_csv(spark, path, True)
    raw = raw.select(*[F.col(f"`{c}`").alias(c.strip()) for c in raw.columns])

    def amount(c: str) -> Column:
        return F.coalesce(P.number(F.col(c)), F.lit(0.0))

    df = _epoch_by_file(raw, "StartTime")
    tot, byt, src = amount("TotPkts"), amount("TotBytes"), amount("SrcBytes")
    share = F.when(byt != 0, F.least(F.greatest(src / byt, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(1.0))
    proto, state = P.proto_name(F.col("Proto")), F.coalesce("State", F.lit(""))
    start = F.col("_epoch")

    def flag(letter: str) -> Column:
        return ((proto == "tcp") & state.contains(letter)).cast("int")

    return finalise(df.select(
        "capture", start.alias("ts_start"), (start + F.greatest(amount("Dur"), F.lit(0.0))).alias("ts_end"),
        P.text(F.col("SrcAddr")).alias("src_ip"), P.text(F.col("DstAddr")).alias("dst_ip"),
        P.port(F.col("Sport")).alias("sport"), P.port(F.col("Dport")).alias("dport"), proto.alias("proto"),
        F.greatest(F.lit(1.0), F.bround(tot * share, 0)).alias("fwd_pkts"),
        F.bround(tot * (1 - share), 0).alias("bwd_pkts"), src.alias("fwd_bytes"),
        F.greatest(byt - src, F.lit(0.0)).alias("bwd_bytes"), flag("S").alias("syn"), flag("R").alias("rst"),
        flag("F").alias("fin"), P.text(F.col("Label")).alias("label")), ["capture"], drop)


def load_unsw(spark: SparkSession, path, drop: bool = True) -> DataFrame:
    """Headerless UNSW-NB15 flow CSV."""
    raw = _read_csv(spark, path, False, UNSW_COLUMNS)
    state, proto = F.upper(F.coalesce("state", F.lit(""))), P.proto_name(F.col("proto"))
    tcp = proto == "tcp"
    cat = P.text(F.col("attack_cat"))
    label = F.when(F.coalesce(P.number(F.col("Label")), F.lit(0.0)) > 0,
                   F.when(cat == "", "attack").otherwise(cat)).otherwise("BENIGN")
    return finalise(raw.select(
        "capture", F.col("Stime").alias("ts_start"), F.col("Ltime").alias("ts_end"),
        F.trim(F.regexp_replace(F.coalesce("srcip", F.lit("")), "﻿", "")).alias("src_ip"),
        P.text(F.col("dstip")).alias("dst_ip"), P.port(F.col("sport")).alias("sport"),
        P.port(F.col("dsport")).alias("dport"), proto.alias("proto"), F.col("Spkts").alias("fwd_pkts"),
        F.col("Dpkts").alias("bwd_pkts"), F.col("sbytes").alias("fwd_bytes"), F.col("dbytes").alias("bwd_bytes"),
        (tcp & state.isin(*UNSW_SYN_STATES)).cast("int").alias("syn"), (state == "RST").cast("int").alias("rst"),
        state.isin("FIN", "CLO").cast("int").alias("fin"), F.col("sttl").alias("ttl"),
        F.when(tcp, P.number(F.col("swin"))).alias("tcp_win"), F.when(tcp, P.number(F.col("sloss"))).alias("retrans"),
        label.alias("label")), ["capture"], drop)


def load_canonical(spark: SparkSession, path, drop: bool = True) -> DataFrame:
    raw = _read_csv(spark, path, True)
    return finalise(raw.select(*[F.col(f"`{c}`").alias(c.strip()) for c in raw.columns]), ["capture"], drop)


# ------------------------------------------------------------------ dispatch
_FORMATS: list[tuple[str, Callable[[str, list[str]], bool], Callable[[SparkSession, str], DataFrame]]] = []


def register_format(name: str, detect: Callable[[str, list[str]], bool],
                    to_flows: Callable[[SparkSession, str], DataFrame], first: bool = False) -> None:
    """Add a flow format; `detect` sees the path and the lower-cased cells of the first line."""
    _FORMATS.insert(0 if first else len(_FORMATS), (name, detect, to_flows))


#: Column names that tell the format.
_CIC_MARKS = {"source ip", "src ip", "src_ip", "flow duration", "flow_duration", "dst port", "destination port"}

register_format("argus", lambda p, c: str(p).endswith(".binetflow") or {"starttime", "srcaddr", "dstaddr"} <= set(c),
                load_argus)
register_format("canonical", lambda p, c: set(S.FLOW_COLUMNS) <= set(c), load_canonical)
register_format("unsw", lambda p, c: len(c) == len(UNSW_COLUMNS) and not {"srcip", "label"} & set(c)
                and c[0].count(".") == 3, load_unsw)
register_format("cic", lambda p, c: bool(_CIC_MARKS & set(c)), load_cic)


def _format_of(path, line: str) -> str:
    line = line.replace("\ufeff", "")
    cells = [c.strip().lower() for c in line.split(",")]
    for name, detect, _ in _FORMATS:
        if detect(path, cells):
            return name
    raise UnsupportedFormat(f"{path}: no registered format has the first line {line[:120]!r}")


def detect_format(spark: SparkSession, path) -> str:
    """Name of the first registered format that accepts the path and its first line."""
    head = spark.read.text(path).limit(1).collect()
    return _format_of(path, head[0][0] if head else "")


def _grouped(spark: SparkSession, path, only: Sequence[str] | None = None) -> list[tuple[str, "Files"]]:
    """The files of a path, or `only` some of them, by format and header, each judged by its own first line (a row a file
    reaches the driver)."""
    files = spark.read.text(path).inputFiles()
    if len(files) < 2:
        return [(detect_format(spark, path), Files(files))]
    lines = spark.read.text(path if only is None else list(only)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                                         F.monotonically_increasing_id().alias("n"), "value").filter("at = 0")
    heads = lines.groupBy("file").agg(F.min_by("value", "n").alias("head")).collect()
    groups: dict[tuple[str, str], list[str]] = {}
    for r in heads:
        name = _format_of(r["file"], r["head"])
        groups.setdefault((name, r["head"] if name != "unsw" else ""), []).append(r["file"])
    return [(name, Files(paths, files)) for (name, _), paths in sorted(groups.items())]


def load_flows(spark: SparkSession, path, only: Sequence[str] | None = None) -> tuple[DataFrame, str]:
    """Flows of a path in any registered formats, and the format's name ("mixed" for several). With `only`, no other
    files are read, and captures have the names that they have beside the others."""
    groups = _grouped(spark, path, only)
    parts = [_loader(name)(spark, files) for name, files in groups]
    names = {name for name, _ in groups}
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), names.pop() if len(names) == 1 else "mixed"


def load_report(spark: SparkSession, path) -> DataFrame:
    """Per capture: its format, rows read, rows dropped because they have no hosts or no readable time, and the first and
    last time. A format registered by the user reports the rows it returns."""
    parts = []
    for name, files in _grouped(spark, path):
        load = _loader(name)
        flows = load(spark, files, drop=False) if load in _OWN else load(spark, files).withColumn("usable", F.lit(True))
        parts.append(flows.select("capture", F.lit(name).alias("format"), "usable", "ts_start", "ts_end"))
    return reduce(DataFrame.unionByName, parts).groupBy("capture", "format").agg(
        F.count("*").alias("rows"), F.count_if(~F.col("usable")).alias("dropped"),
        F.min(F.when(F.col("usable"), F.col("ts_start"))).alias("first"), F.max(F.when(F.col("usable"), F.col("ts_end"))).alias("last"))


_OWN = (load_cic, load_argus, load_unsw, load_canonical)


def _loader(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return next(load for n, _, load in _FORMATS if n == name)
