"""Removal of long word sequences that occur more than once, by level-wise doubling of repeated windows.

A window is `target` (35) consecutive words of one document. Only a window whose parts are repeated can be repeated, so
short windows are counted first and only repeated ones are extended to twice their length, up to the target:

* Level 1 (9 words): of the short windows inside a target window, the one of least hash (the leftmost of equals) stands
  for it. Equal target windows choose the same one, and neighbours mostly share it, so some 7 % of the positions are
  hashed, shuffled and counted.
* Level 2 (18 words): where that short window is repeated, it is extended to twice its length inside the target window.
* Level 3 (35 words): where that one is repeated too, the target window itself is counted. What is repeated here is
  removed: its words are covered.

Where nothing is left after a level, the later ones read nothing.

Texts are packed once into blocks of a few MB, a table that is bucketed by block, so that the levels join it without
moving texts again. At each level a block sends its distinct hashes, split by hash range, with a mark where it holds one
more than once; a range finds the hashes that several blocks hold or one marks, and answers each block with one bit for
each of its hashes. The next reader of the block computes the same hashes again. A passage that stands in a third of all
documents is thus one entry a block, in every range, and no group of places is ever gathered or paired. Hash ranges hold
at most `RANGE_HASHES` entries on average, however many documents there are.

The first levels compare 64 bits and only filter; the last compares 80 bits of two independent hashes: among 10^13
windows some ten are expected to agree with a different one.

Defined results: a null text has no words; a text of fewer words than the target loses nothing; repeated rows, and rows
that share an id or have none, are places of their own; an empty table gives no rows; other columns are not carried. A
task holds a block, or one text that is larger than a block.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
import pyspark
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from flowtide.cluster import materialise, shared_dir
from flowtide.llm.text import _grown, _mix, _powers

TARGET, FIRST = 35, 9
BLOCK_BYTES, RANGE_HASHES = 2 << 20, 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_SLICE = 1 << 20


def lengths(first: int = FIRST, target: int = TARGET) -> list[int]:
    """Window lengths of the levels: each twice the one before, the last the target."""
    out = [min(first, target)]
    while out[-1] < target:
        out.append(min(2 * out[-1], target))
    return out


# --- words and windows ------------------------------------------------------------------------------------------------

def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a stretch that ends with a word's end."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[data], [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    up, down = _grown(len(data) + 1)
    np.cumsum(_BYTE[data] * up[:len(data)], out=total[1:])
    return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_BASES[1])), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words, text after text, and each text's number of words."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        stop = min(at + _SLICE, len(data))
        while stop < len(data) and not _SPACE[data[stop]]:
            stop += 1
        h, s = _hashed(data[at:stop])
        hashes.append(h)
        starts.append(s + at)
        at = stop
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), begins))


def windows(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """A hash of each run of `size` words (none where there are fewer), by doubling."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power = _powers(base, size + 1)
    out, have = None, 0
    part, width, left = words, 1, size
    while left:
        if left & 1:            # put this power of two behind what is there
            out = part[:n].copy() if out is None else out * power[width] + part[have:have + n]
            have += width
        left >>= 1
        if left:
            part, width = part[:-width] * power[width] + part[width:], 2 * width
    return _mix(out)


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Position of the least value of each run of `span` values, the leftmost of equals."""
    at = np.arange(len(values))
    width = 1
    while width < span:
        step = min(width, span - width)
        a, b = at[:-step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        width += step
    return at


class Block:
    """The target windows of some texts, none across two of them."""

    def __init__(self, texts: list[bytes], target: int):
        self.target = target
        self.words, self.counts = word_hashes(texts)
        ends = np.cumsum(self.counts)
        first = np.repeat(ends - self.counts, np.maximum(self.counts - target + 1, 0))
        run = np.maximum(self.counts - target + 1, 0)
        self.starts = first + (np.arange(len(first)) - np.repeat(np.cumsum(run) - run, run))

    def short(self, level: int, levels: list[int], of: np.ndarray) -> np.ndarray:
        """Where the windows of a level begin that stand for the target windows `of`."""
        if level == len(levels) - 1 or not len(of):
            return of
        values = windows(self.words, levels[0], _BASES[0])
        at = _least(values, self.target - levels[0] + 1)[of]
        for had, size in zip(levels, levels[1:level + 1]):
            to_the_left = np.maximum(at + had - size, of)
            at = np.where(at + size <= of + self.target, at, to_the_left)
        return at

    def hashes(self, size: int, at: np.ndarray, base: int = 0) -> np.ndarray:
        return windows(self.words, size, _BASES[base])[at] if len(at) else np.empty(0, np.uint64)


def _distinct(keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, mark) in order, how often each occurs, and which of them each given one is."""
    order = np.lexsort((marks, keys)) if marks.any() else np.argsort(keys, kind="stable")
    keys, marks = keys[order], marks[order]
    opens = np.concatenate(([True], (keys[1:] != keys[:-1]) | (marks[1:] != marks[:-1])))[:len(keys)]
    new, which = np.flatnonzero(opens), np.empty(len(keys), np.int64)
    which[order] = np.cumsum(opens) - 1
    return keys[new], marks[new], np.diff(np.append(new, len(keys))), which


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, all first bytes, then all second ones, ...; the high ones are mostly 0."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


# --- blocks of texts --------------------------------------------------------------------------------------------------

def _packed(id_type: pa.DataType, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pyspark.TaskContext.get().partitionId() << 32
        names = ["block", "ids", "sizes", "texts", "most_words"]
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            ids, texts, held = [], [], 0
            for k, (i, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())):
                ids.append(i)
                texts.append(t or b"")
                held += len(texts[-1])
                if held >= size or k == batch.num_rows - 1:
                    block += 1
                    yield pa.RecordBatch.from_arrays([
                        pa.array([block], pa.int64()), pa.array([ids], pa.list_(id_type)),
                        pa.array([np.array([len(x) for x in texts], "<i8").tobytes()], pa.binary()),
                        pa.array([squeeze(b"".join(texts))], pa.binary()),
                        pa.array([sum(len(x) // 2 + 1 for x in texts)], pa.int64())], names=names)
                    ids, texts, held = [], [], 0
    return run


def _texts(sizes: bytes, packed: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, "<i8")).tolist()
    whole = zstandard.ZstdDecompressor().decompress(packed)
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


def _blocks(docs: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)),
                           T.StructField("sizes", T.BinaryType()), T.StructField("texts", T.BinaryType()),
                           T.StructField("most_words", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_type

    return bucketed(rows.mapInArrow(_packed(to_arrow_type(rows.schema["id"].dataType), size), schema), "block")


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Write `df` once to the shared folder in buckets of `key`; joins on it then move the other side only."""
    spark, name = df.sparkSession, f"flowtide_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/flowtide-{spark.sparkContext.applicationId}/{name}"
    df.repartition(n, key).write.format("parquet").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


# --- a level: distinct hashes of blocks to ranges, a bit for each back to its block ------------------------------------

_SENT = "range long, block long, keys binary, marks binary, twice binary"
_BACK = "block long, level int, range long, bits binary"


def _keys(block: Block, level: int, levels: list[int], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = block.short(level, levels, of)
    keys = block.hashes(levels[level], at)
    if level < len(levels) - 1:
        return keys, np.zeros(len(keys), np.uint16)
    return keys, (block.hashes(levels[level], at, 1) >> np.uint64(48)).astype(np.uint16)


def _edges(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where the hash ranges begin and end among sorted keys."""
    width = (1 << 64) // ranges + 1
    return np.concatenate(([0], np.searchsorted(keys, np.array([k * width for k in range(1, ranges)], np.uint64)), [len(keys)]))


def _alive(block: Block, levels: list[int], ranges: list[int], back: list[dict] | None) -> np.ndarray:
    """The target windows that all levels so far have found repeated, by the bits that came back."""
    of = block.starts
    for level, n in enumerate(ranges):
        keys, _, _, which = _distinct(*_keys(block, level, levels, of))
        edges, hit = _edges(keys, n), np.zeros(len(keys), bool)
        for b in back or ():
            if b["level"] == level:
                lo, hi = edges[b["range"]:b["range"] + 2]
                hit[lo:hi] = np.unpackbits(np.frombuffer(b["bits"], np.uint8), count=hi - lo).view(bool)
        of = of[hit[which]]
    return of


def _sending(levels: list[int], ranges: list[int]):
    """What blocks send at the level that the last of `ranges` is for."""
    level = len(ranges) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                block = Block(_texts(row["sizes"], row["texts"]), levels[-1])
                alive = _alive(block, levels, ranges[:-1], row.get("back"))
                keys, marks, n, _ = _distinct(*_keys(block, level, levels, alive))
                edges = _edges(keys, ranges[-1]).tolist()
                out = [(k, row["block"], _packed_keys(keys[a:b]), marks[a:b].tobytes() if level == len(levels) - 1 else b"",
                        np.packbits(n[a:b] > 1).tobytes()) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                        pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                        names=["range", "block", "keys", "marks", "twice"])
    return run


def _repeated(level: int):
    def run(table: pa.Table) -> pa.Table:
        """Of a hash range: which keys two blocks hold or one holds twice, to each block a bit for each of its own."""
        sent = [_unpacked_keys(k) for k in table.column("keys").to_pylist()]
        size = [len(k) for k in sent]
        keys = np.concatenate(sent)
        marks = np.concatenate([np.frombuffer(m, "<u2") if m else np.zeros(n, np.uint16)
                                for m, n in zip(table.column("marks").to_pylist(), size)])
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n).view(bool)
                                for t, n in zip(table.column("twice").to_pylist(), size)])
        _, _, n, which = _distinct(keys, marks)
        hit = twice | (n > 1)[which]
        out, at = [], 0
        for b, k in zip(table.column("block").to_pylist(), size):
            own = hit[at:at + k]
            if own.any():
                out.append((b, np.packbits(own).tobytes()))
            at += k
        number = table.column("range")[0].as_py()
        return pa.table({"block": pa.array([b for b, _ in out], pa.int64()), "level": pa.array([level] * len(out), pa.int32()),
                         "range": pa.array([number] * len(out), pa.int64()), "bits": pa.array([x for _, x in out], pa.binary())})
    return run


def _with_back(blocks: DataFrame, back: list[DataFrame], how: str) -> DataFrame:
    """Blocks with the bits of all levels; with "inner" those that the last level left something of."""
    mine = reduce(DataFrame.unionAll, back).groupBy("block").agg(
        F.collect_list(F.struct("level", "range", "bits")).alias("back"), F.max("level").alias("last"))
    if how == "inner":
        mine = mine.filter(F.col("last") == len(back) - 1)
    return blocks.join(mine.drop("last"), "block", how)


# --- the operator -----------------------------------------------------------------------------------------------------

def _kept(id_type: pa.DataType, levels: list[int], ranges: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                texts = [t.split() for t in _texts(row["sizes"], row["texts"])]
                counts = np.array([len(t) for t in texts], np.int64)
                gone = np.zeros(int(counts.sum()) + 1, np.int64)
                if row["back"]:
                    block = Block([b" ".join(t) for t in texts], levels[-1])
                    starts = _alive(block, levels, ranges, row["back"])
                    gone[starts] += 1
                    np.subtract.at(gone, starts + levels[-1], 1)
                stays = np.cumsum(gone)[:-1] == 0
                ends = np.cumsum(counts)
                kept = [b" ".join(t if s.all() else compress(t, s))
                        for t, s in zip(texts, np.split(stays, ends[:-1]))]
                lost = counts - np.diff(np.concatenate(([0], np.cumsum(stays)))[np.concatenate(([0], ends))])
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["ids"], id_type), pa.array(counts, pa.int64()), pa.array(lost, pa.int64()),
                    pa.array([k.decode() for k in kept], pa.string())], names=["id", "n_words", "n_removed", "kept"])
    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", target: int = TARGET, first: int = FIRST,
                    block_bytes: int = BLOCK_BYTES, range_hashes: int = RANGE_HASHES) -> DataFrame:
    """Id, n_words, n_removed and `kept` (the words that stay, joined by one space) of every document."""
    from pyspark.sql.pandas.types import to_arrow_type

    levels = lengths(first, target)
    blocks = _blocks(docs, id_col, text, block_bytes)
    most = blocks.agg(F.coalesce(F.sum("most_words"), F.lit(0))).first()[0]
    back: list[DataFrame] = []
    ranges: list[int] = []
    for level, size in enumerate(levels):
        # distinct windows of a level to a word: the least ones of `target`, those at both of their sides, all
        share = 2 / (target - size + 2) if level == 0 else 4 / (target - first + 2) if size < target else 1
        ranges.append(max(1, int(most * min(share, 1)) // range_hashes))
        rows = (_with_back(blocks, back, "inner") if back else blocks).drop("ids", "most_words")
        back.append(materialise(rows.mapInArrow(_sending(levels, list(ranges)), _SENT)
                                .groupBy("range").applyInArrow(_repeated(level), _BACK)))
    id_type = blocks.schema["ids"].dataType.elementType
    out = _with_back(blocks, back, "left").drop("most_words").mapInArrow(
        _kept(to_arrow_type(id_type), levels, ranges),
        T.StructType([T.StructField("id", id_type), T.StructField("n_words", T.LongType()),
                      T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]))
    return out.withColumnRenamed("id", id_col)
