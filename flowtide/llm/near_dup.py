"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures, confirmed on full shingle sets.

A signature has 64 symbols of 16 bits, each the low bits of the least value of one hash function over the shingles of
a document. Two documents of similarity t differ in a symbol with chance 1 - t, so pairs at t or more have at most
`reach` differing symbols but for a chance below `miss`. The symbols are split into chunks, as few as leave some chunk
with at most one differing symbol (pigeonhole); each chunk gives one key for every symbol left out, so every pair
within `reach` shares a key. No pair within `reach` is lost.

1. Equal shingle sets are one class; a class is searched once, under a key of its own, and its least document (by id,
   then by digest of the text) stands for it. The keys have the order of these documents.
2. Classes that share a key meet in a task, which links those within `reach` by a search that compares a class with
   the ones not yet reached only, and returns a tree and not all pairs. A key with many classes is dealt in blocks,
   and each pair of blocks is a task.
3. The linked classes form groups outside of which no pair can be similar. Each group's full shingle sets meet once, in
   tasks of bounded size (pairs of blocks again), and the same search confirms links on the sets.
4. Components of the confirmed links, and of equal sets, give each document its group.

Defined results: a null text is an empty text; a document without words has no shingles and is linked with nothing;
with fewer words than a shingle, the whole sequence is the one shingle; a document is an id and a text, so rows that
share an id, or have none, are told apart by their texts, and only rows equal in both are one document; a null id counts
as the greatest one; an empty table gives no rows; other columns are not carried.
"""
from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowtide.cluster import materialise
from flowtide.llm.components import connected_components
from flowtide.llm.text import _mix, shingles

SYMBOLS = 64
BLOCK, SET_BLOCK, BLOCK_SHINGLES = 1000, 250, 500_000
_A = _mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) | np.uint64(1)
_B = _mix(np.arange(1001, SYMBOLS + 1001, dtype=np.uint64))


def reach(percent: int, miss: float = 1e-6, symbols: int = SYMBOLS) -> int:
    """The least number of differing symbols that a pair at `percent` exceeds with a chance below `miss`."""
    p, tail = 1 - percent / 100, 0.0
    for d in range(symbols, 0, -1):
        tail += comb(symbols, d) * p ** d * (1 - p) ** (symbols - d)
        if tail >= miss:
            return d
    return 0


def patterns(limit: int, symbols: int = SYMBOLS) -> list[list[int]]:
    """Symbol positions of each key: the chunks, each with one symbol left out. One of two signatures that differ in at
    most `limit` symbols has a chunk with at most one of them, as 2 * chunks > limit."""
    cuts = np.linspace(0, symbols, limit // 2 + 2).astype(int)
    return [[p for p in range(lo, hi) if p != out] for lo, hi in zip(cuts, cuts[1:]) for out in range(lo, hi)]


def signature(sets: np.ndarray) -> np.ndarray:
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 2048):
        part = sets[None, at:at + 2048] * _A[:, None] + _B[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (_mix(least) & np.uint64(0xFFFF)).astype("<u2")


def _digest(sets: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(sets.tobytes())


_SIGNED = pa.schema([("id", pa.int64()), ("mark", pa.binary()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        n, digest, sig = [], [], []
        for value in texts:
            s = shingles(value.as_py() or b"")
            n.append(len(s))
            digest.append(_digest(s) if len(s) else None)
            sig.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark").cast(pa.binary()), pa.array(n, pa.int64()),
                                          pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], schema=_SIGNED)


def _keys(limit: int):
    use = patterns(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u2").reshape(-1, SYMBOLS).astype(np.uint64)
                out = np.empty((len(sig), len(use)), np.uint64)
                for k, places in enumerate(use):
                    key = np.full(len(sig), k + 1, np.uint64)
                    for p in places:
                        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, p])
                    out[:, k] = key & ~np.uint64(SYMBOLS - 1) | np.uint64(k)       # the low bits name the key's pattern
                reps = np.repeat(np.asarray(part.column("rep"), np.int64), len(use))
                yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1).view(np.int64)), pa.array(reps)],
                                                 names=["key", "rep"])
    return run


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal `by`, of a partition sorted by them."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = np.stack([np.asarray(table.column(c), np.int64) for c in by], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        bounds = [0, *cuts.tolist(), len(keys)]
        for lo, hi in zip(bounds, bounds[1:]):
            key = tuple(keys[lo])
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.concat_tables(held)


def _search(sig: np.ndarray, limit: int, confirm=None) -> tuple[list[int], list[int]]:
    """A spanning forest of the rows within `limit` (and confirmed): each row is compared with those not yet reached."""
    left, a, b, queue = np.arange(len(sig)), [], [], []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        at = queue.pop()
        near = (sig[left] != sig[at]).sum(axis=1) <= limit
        if confirm is not None and near.any():
            near[near] = confirm(at, left[near])
        if near.any():
            got = left[near].tolist()
            left = left[~near]
            a += [at] * len(got)
            b += got
            queue += got
    return a, b


def _first_key(limit: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The first pattern by which two signatures (rows of `one` and `two`) share a key.

    Patterns are numbered by the symbol they leave out; a chunk with one differing symbol has the pattern of that
    symbol, and one without has all of its patterns.
    """
    off = one != two
    cuts = np.linspace(0, SYMBOLS, limit // 2 + 2).astype(int)[:-1]
    wrong = np.add.reduceat(off, cuts, axis=1, dtype=np.int64)
    chunk = (wrong <= 1).argmax(axis=1)
    begin = cuts[chunk]
    places = np.arange(SYMBOLS)
    inside = off & (places >= begin[:, None]) & (places < np.append(cuts, SYMBOLS)[chunk + 1][:, None])
    return np.where(inside.any(axis=1), inside.argmax(axis=1), begin)


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _meet(limit: int):
    """Links within each task's classes by signature. A link is left to the task of the first key that its two ends
    share, where they are linked too, so a large group does not return a tree for each of its keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for group in _groups(batches, ["key", "i", "j"]):
            if group.num_rows < 2:
                continue
            reps = np.asarray(group.column("rep"), np.int64)
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u2").reshape(-1, SYMBOLS)
            x, y = _search(sig, limit)
            own = _first_key(limit, sig[x], sig[y]) == group.column("key")[0].as_py() % SYMBOLS if x else []
            a += reps[x][own].tolist()
            b += reps[y][own].tolist()
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGE)
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGE)
    return run


_SETS = "comp bigint, rep bigint, nb int, block int, sig binary, grams binary"
_SETS_ARROW = pa.schema([("comp", pa.int64()), ("rep", pa.int64()), ("nb", pa.int32()), ("block", pa.int32()),
                         ("sig", pa.binary()), ("grams", pa.binary())])


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of the classes' documents; rows that repeat a document go."""
    done: set[int] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            keep = []
            for rep in part.column("rep").to_pylist():
                keep.append(rep not in done)
                done.add(rep)
            table = part.filter(pa.array(keep, pa.bool_()))
            sets = [shingles(t.as_py() or b"") for t in table.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([
                *[table.column(c).cast(_SETS_ARROW.field(c).type) for c in ("comp", "rep", "nb", "block", "sig")],
                pa.array([s.tobytes() for s in sets], pa.binary())], schema=_SETS_ARROW)


def _confirm(limit: int, percent: int):
    """Links within each task's classes by their full sets: 100 * intersection >= percent * union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["comp", "i", "j"]):
            once = np.unique(np.asarray(group.column("rep"), np.int64), return_index=True)[1]
            if len(once) < group.num_rows:      # a document's rows, read in several tasks
                group = group.take(pa.array(once))
            if group.num_rows < 2:
                continue
            reps = np.asarray(group.column("rep"), np.int64)
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u2").reshape(-1, SYMBOLS)
            sets = [np.frombuffer(x, np.uint64) for x in group.column("grams").to_pylist()]
            size = np.array([len(s) for s in sets])

            def similar(at: int, others: np.ndarray, sets=sets, size=size) -> np.ndarray:
                own, n = sets[at], size[at]
                fits = 100 * np.minimum(size[others], n) >= percent * np.maximum(size[others], n)
                out = np.zeros(len(others), bool)
                if fits.any():
                    some = others[fits]
                    flat = np.concatenate([sets[o] for o in some])
                    spot = np.searchsorted(own, flat)
                    hit = own[np.minimum(spot, n - 1)] == flat
                    common = np.add.reduceat(hit, np.concatenate(([0], np.cumsum(size[some])[:-1])), dtype=np.int64)
                    out[fits] = 100 * common >= percent * (n + size[some] - common)
                return out

            x, y = _search(sig, limit, similar)
            yield pa.RecordBatch.from_arrays([pa.array(reps[x]), pa.array(reps[y])], schema=_EDGE)
    return run


def _tasks(df: DataFrame) -> DataFrame:
    """A row for each pair of blocks (i <= j) that has the row's `block` of the `nb` of its group."""
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(
        F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j")))
    return df.withColumn("_pair", F.explode(pairs)).select(
        *[c for c in df.columns if c not in ("nb", "block")], "_pair.i", "_pair.j")


def mark(text: Column) -> Column:
    """What tells documents of one id, or of none, apart."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def groups_of(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, mark, n (shingles), component_id and kept of every row; rows equal in id and mark are one document."""
    limit = reach(percent)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", mark(F.col("text")))
    signed = materialise(rows.mapInArrow(_sign, "id bigint, mark binary, n bigint, digest binary, sig binary"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("lead")
    classes = signed.filter("n > 0").groupBy("digest").agg(least, F.first("sig").alias("sig"), F.first("n").alias("n"))
    classes = materialise(classes.orderBy("lead").select(
        "digest", "lead.id", "lead.mark", "sig", "n", F.monotonically_increasing_id().alias("rep")))

    keys = classes.select("rep", "sig").mapInArrow(_keys(limit), "key bigint, rep bigint")
    shared = materialise(keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
                         .select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("nb")))
    meeting = keys.join(shared, "key").withColumn("block", F.pmod(F.xxhash64("rep", "key"), "nb").cast("int"))
    meeting = _tasks(meeting).join(classes.select("rep", "sig"), "rep")
    linked = (meeting.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
              .select("key", "i", "j", "rep", "sig").mapInArrow(_meet(limit), "a bigint, b bigint"))
    groups = materialise(connected_components(linked).select(F.col("node").alias("rep"), F.col("component").alias("comp")))

    members = materialise(classes.join(groups, "rep").select("comp", "rep", "id", "mark", "sig", "n"))
    sizes = materialise(members.groupBy("comp").agg(F.greatest(
        F.ceil(F.count("*") / SET_BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("nb")))
    dealt = members.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("rep"), "nb").cast("int"))
    dealt = dealt.select("comp", "rep", "nb", "block", "sig", F.col("id").alias("_id"), F.col("mark").alias("_mark"))
    sets = rows.join(dealt, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).select(
        "comp", "rep", "nb", "block", "sig", "text").mapInArrow(_with_sets, _SETS)
    links = (_tasks(sets).repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
             .select("comp", "i", "j", "rep", "sig", "grams").mapInArrow(_confirm(limit, percent), "a bigint, b bigint"))
    found = connected_components(links).filter("node != component")

    heads = classes.select(F.col("rep").alias("component"), F.col("id").alias("_head"))
    linked = materialise(found.join(heads, "component").select(F.col("node").alias("rep"), "_head", F.lit(True).alias("_in")))
    named = materialise(classes.join(linked, "rep", "left").select(
        "digest", F.when(F.col("_in"), F.col("_head")).otherwise(F.col("id")).alias("_component"),
        F.col("_in").isNull().alias("_first"), F.col("id").alias("_id"), F.col("mark").alias("_mark")))
    own = F.col("digest").isNull()              # without words: linked with nothing
    return signed.select("id", "mark", "n", "digest").join(named, "digest", "left").select(
        "id", "mark", "n", F.when(own, F.col("id")).otherwise(F.col("_component")).alias("component_id"),
        (own | (F.col("_first") & F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable over links of `percent` or more) and kept."""
    return groups_of(docs, percent, id_col, text).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")
