"""Leak-free training sequences over the host-window frame.

A sequence is L history plus K future rows of one (capture, host, segment). Its row in
these tables is its first window. All frames are bounded row frames over one shared
partitioning, so a whole sequence table costs one shuffle and one sort.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide import schema as S
from flowtide.cluster import deal
from flowtide.operators.windows import fill_gaps

KEYS = ("dataset", "capture")


def _order(keys: Sequence[str]):
    return Window.partitionBy(*keys, "host", "segment").orderBy("window")


def capture_numbers(frame: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per capture: first window and 0-based number in name order."""
    caps = frame.groupBy(*keys).agg(F.min("window").alias("first_window"))
    return caps.withColumn("capture_no", F.row_number().over(Window.orderBy(*keys)) - 1)


def with_blocks(frame: DataFrame, keys: Sequence[str] = KEYS,
                block: int = S.BLOCK_WINDOWS, numbers: DataFrame | None = None) -> DataFrame:
    """Add the time block of each row and the split that block belongs to. `numbers` are the frame's `capture_numbers`
    where they are known; else the frame is read once more for them."""
    # one row a capture: joined by its few values, all rows would meet in as many tasks
    f = frame.join(F.broadcast(capture_numbers(frame, keys) if numbers is None else numbers), list(keys))
    number = F.floor((F.col("window") - F.col("first_window")) / block)
    cycle = F.array(*[F.lit(s) for s in S.SPLIT_CYCLE])
    turn = F.element_at(cycle, ((number + F.col("capture_no")) % len(S.SPLIT_CYCLE) + 1).cast("int"))
    lab = F.col("dataset") == "lab" if "dataset" in keys else F.lit(False)
    return f.withColumns({"block": number, "split": F.when(lab, F.lit("train")).otherwise(turn)}).drop(
        "first_window", "capture_no")


def sequence_starts(frame: DataFrame, length: int = S.HISTORY_L + S.HORIZON_K,
                    keys: Sequence[str] = KEYS, dealt: bool = False, numbers: DataFrame | None = None) -> DataFrame:
    """Rows whose `length` rows stay in one host segment and one block, with their split. `dealt`: the rows of a segment
    already lie in one task, as `with_targets` and `host_windows` leave them; other frames are counted first."""
    f = with_blocks(frame, keys, numbers=numbers)
    f = f if dealt else deal(f, *keys, "host", "segment", rows=frame.count())
    last = F.lead("block", length - 1).over(_order(keys))
    return f.withColumn("_last", last).filter(F.col("_last") == F.col("block")).drop("_last")


def with_targets(frame: DataFrame, risk: Column, history: int = S.HISTORY_L,
                 horizon: int = S.HORIZON_K, keys: Sequence[str] = KEYS, dealt: bool = False) -> DataFrame:
    """Forecast targets of the sequence starting at each row.

    y_future: attack in the horizon; y_now: attack in the last history row;
    hist_attack: attack anywhere in the history; lead: first attack step in the horizon
    (1-based, 0 none); touches: attack anywhere; recon: stage 1 in the horizon.
    Rows without a full sequence get NULL targets. `dealt` as in `sequence_starts`.
    """
    w = _order(keys)
    total = history + horizon
    past, ahead = w.rowsBetween(0, history - 1), w.rowsBetween(history, total - 1)
    f = frame if dealt else deal(frame, *keys, "host", "segment", rows=frame.count())
    f = f.withColumns({"_r": risk.cast("int"), "_n": F.row_number().over(w)})
    f = f.withColumns({
        "y_future": F.max("_r").over(ahead),
        "y_now": F.lead("_r", history - 1).over(w),
        "hist_attack": F.max("_r").over(past),
        "_hit": F.min(F.when(F.col("_r") > 0, F.col("_n"))).over(ahead),
        "attack_rows": F.sum("_r").over(w.rowsBetween(0, total - 1)),
        "recon": F.max((F.col("stage") == 1).cast("int")).over(ahead),
        "_full": F.lead("_r", total - 1).over(w).isNotNull()})
    lead = F.coalesce(F.col("_hit") - F.col("_n") - history + 1, F.lit(0))
    cols = {"lead": lead, "touches": F.greatest("hist_attack", "y_future")}
    f = f.withColumns(cols)
    for c in ("y_future", "y_now", "hist_attack", "lead", "touches", "recon", "attack_rows"):
        f = f.withColumn(c, F.when(F.col("_full"), F.col(c)).cast("int"))
    return f.drop("_r", "_n", "_hit", "_full")


def compromise(stages: Sequence[int] = (1, 2, 3, 4, 5, 6), column: str = "episode_stage") -> Column:
    return F.col(column).isin(*stages)


def draw(seed: int, salt: str, *cols: str) -> Column:
    """Uniform [0, 1) number that depends on the row's identity only."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def balance_train(seqs: DataFrame, keep: float = 0.15, seed: int = 7,
                  keys: Sequence[str] = KEYS) -> DataFrame:
    """All sequences that touch an attack and a fixed share of the quiet ones."""
    return seqs.filter((F.col("touches") > 0) | (draw(seed, "keep", *keys, "host", "window") < keep))


def group_weights(seqs: DataFrame, by: Sequence[str] = ("dataset", "touches")) -> DataFrame:
    """Weight 1/size of the (dataset, attack) group, normalised to sum to one."""
    sizes = seqs.groupBy(*by).agg(F.count("*").alias("_n"))
    groups = sizes.agg(F.count("*")).scalar()
    return (seqs.join(F.broadcast(sizes), list(by))
            .withColumn("weight", 1 / F.col("_n") / groups).drop("_n"))


def emphasis(onset_boost: float = 4.0, recon_boost: float = 10.0) -> Column:
    """Extra weight on attacks that start inside the horizon and on coming reconnaissance."""
    onset = ((F.col("hist_attack") == 0) & (F.col("y_future") > 0)).cast("double")
    return 1 + onset_boost * onset + recon_boost * F.col("recon")


def positive_weight(seqs: DataFrame, length: int = S.HISTORY_L + S.HORIZON_K, cap: float = 20.0,
                    weight: Column | None = None) -> DataFrame:
    """min(cap, negatives / positives) over all rows of all sequences."""
    w = F.lit(1.0) if weight is None else weight
    pos = F.sum(F.col("attack_rows") / length * w) / F.sum(w)
    return seqs.agg(pos.alias("positive_share")).withColumn(
        "pos_weight", F.least(F.lit(cap), (1 - F.col("positive_share"))
                              / F.greatest(F.col("positive_share"), F.lit(1e-6))))


def drop_packet_features(seqs: DataFrame, vectors: str, share: float = 0.5, seed: int = 7,
                         keys: Sequence[str] = KEYS) -> DataFrame:
    """Zero the packet features and masks of a random share of sequences."""
    hidden = [i for i, f in enumerate(S.FEATURES) if f in S.PACKET_FEATURES + S.MASK_FEATURES]
    blank = F.transform(F.col(vectors), lambda v: F.transform(
        v, lambda x, i: F.when(i.isin(*hidden), F.lit(0.0)).otherwise(x)))
    hit = draw(seed, "dropout", *keys, "host", "window") < share
    return seqs.withColumn(vectors, F.when(hit, blank).otherwise(F.col(vectors)))


def vector(features: Sequence[str] = S.FEATURES) -> Column:
    return F.array(*[F.col(f) for f in features])


def histories(frame: DataFrame, idle: Sequence[float], length: int = S.HISTORY_L,
              keys: Sequence[str] = (), features: Sequence[str] = S.FEATURES, dealt: bool = False) -> DataFrame:
    """Last `length` feature vectors per row, padded in front with the idle vector. `dealt` as in `sequence_starts`."""
    f = frame if dealt else deal(frame, *keys, "host", "segment", rows=frame.count())
    # each earlier vector is one offset; a sliding list would be gathered anew in every row
    pad = F.array(*[F.lit(float(x)) for x in idle])
    back = {f"_h{k}": F.lag("_v", k).over(_order(keys)) for k in range(length - 1, 0, -1)}
    return (f.withColumn("_v", vector(features)).withColumns(back)
            .withColumn("history", F.array(*[F.coalesce(c, pad) for c in back], F.col("_v"))).drop("_v", *back))


def sequence_vectors(frame: DataFrame, length: int = S.HISTORY_L, keys: Sequence[str] = KEYS,
                     features: Sequence[str] = S.FEATURES) -> DataFrame:
    """The `length` vectors starting at each row (the history part of its sequence)."""
    # each later vector is one offset; a sliding list would be gathered anew in every row
    ahead = {f"_h{k}": F.lead("_v", k).over(_order(keys)) for k in range(1, length)}
    return (frame.withColumn("_v", vector(features)).withColumns(ahead)
            .withColumn("history", F.array_compact(F.array("_v", *ahead))).drop("_v", *ahead))


def align_steps(frame: DataFrame, idle: dict[str, str], keys: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Every host on the whole step axis of its capture; missing steps take `idle` values. The rows of a host then lie in
    one task. `rows`: the frame's number of rows where it is known; else they are counted."""
    keys = list(keys)
    span = frame.groupBy(*keys).agg(F.min("window").alias("_lo"), F.max("window").alias("_hi"))
    if keys:
        f = frame.join(F.broadcast(span), keys)
    else:
        f = frame.withColumns({"_lo": span.select("_lo").scalar(), "_hi": span.select("_hi").scalar()})
    f = f.withColumns({"_first": F.col("_lo"), "present": F.lit(True)})
    rows = frame.count() if rows is None else rows
    wide = fill_gaps(deal(f, *keys, "host", rows=rows).withColumnsRenamed({"_lo": "_s", "_hi": "_e"}), [*keys, "host"], "_s", "_e",
                     {**idle, "present": "false"})
    return wide.withColumn("step", (F.col("window") - F.col("_first")).cast("int")).drop("_s", "_e", "_first")
