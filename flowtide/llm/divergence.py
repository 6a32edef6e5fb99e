"""Source divergence audit: how far the word use of the sources of a language lies apart, by count-level bitmaps.

A group is a (language, source). For every group and every count c > 0 there is a bitset of the terms that occur exactly
c times in it. Terms of equal count have equal weight p, so the divergence of two groups needs no walk over terms: the
bitsets of two levels are ANDed, their popcount is the number of terms of that joint cell (c, d), and it is multiplied by
the cell's f = floor((p - q)^2 / (p + q)). Terms that one or both groups lack follow by complement: the size of a level
without its joint cells, and the number of terms without all of these.

Terms are counted inside the tasks before anything is shuffled, numbered in (language, term) order, and cut into chunks
of 32,768 ids; a task holds one chunk of at most `SOURCES` x 2 sources, so neither the vocabulary nor the number of
sources bounds it. A level of few terms in a chunk is kept as its ids (the set bits alone), and is ANDed at those ids
only.

Defined results: null texts, languages and sources are read as ''; a group without terms takes part with all counts 0; a
language without kept terms has value 0 for all its pairs; a language with one source has no pairs; repeated rows count
each; no documents give no rows; other columns are not carried. All arithmetic is in whole numbers.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from flowtide.cluster import materialise
from flowtide.llm.sharding import prefix_sums

LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
CHUNK_BITS, FEW, SOURCES = 15, 32, 64
_HELD, _SLICE = 400_000, 1 << 20

#: All but letters and characters beyond ASCII become spaces, A-Z become a-z, byte by byte.
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


# --- counts -----------------------------------------------------------------------------------------------------------

def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a slice at a time, each cut between terms."""
    at = 0
    while at < len(text):
        stop = min(at + _SLICE, len(text))
        while stop < len(text) and _FOLD[text[stop]] != 32:
            stop += 1
        yield text[at:stop].translate(_FOLD).split()
        at = stop


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by (lang, source, term) of a task's rows, in portions; a row of the term '' tells that
    the group occurs."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def portion() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * (len(terms) + 1)), pa.array([source] * (len(terms) + 1)),
                pa.array([*terms, b""], pa.binary()).cast(pa.string()), pa.array([*n.values(), 0], pa.int64()),
                pa.array([*map(docs.__getitem__, terms), 0], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.binary())):
            n, docs = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
            own: set[bytes] = set()
            for terms in _word_lists(text.as_py() or b""):
                n.update(terms)
                own.update(terms)
            docs.update(own)
        if sum(len(n) for n, _ in held.values()) > _HELD:
            yield from portion()
    yield from portion()


def counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Lang, source, term, n (occurrences) and docs; the term '' stands for the group itself."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"),
                       F.col(text).alias("text"))
    return (rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


# --- bitmaps ----------------------------------------------------------------------------------------------------------

_LEVELS = "array<struct<count: bigint, terms: int, few: boolean, bits: binary>>"


def _levelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The (count, id) pairs of a group in a chunk as levels: a bitset, or the ids where they are few, for each count."""
    levels = pa.list_(pa.struct([("count", pa.int64()), ("terms", pa.int32()), ("few", pa.bool_()), ("bits", pa.binary())]))
    for batch in batches:
        out = []
        for cells in batch.column(3):
            n, low = (cells.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            order = np.lexsort((low, n))
            n, low = n[order], low[order]
            cut = np.flatnonzero(np.diff(n)) + 1
            out.append([{"count": int(n[a]), "terms": b - a, "few": b - a <= FEW, "bits": _bits(low[a:b])}
                        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(n)])])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, levels)], names=["lang", "chunk", "source", "levels"])


def _bits(ids: np.ndarray) -> bytes:
    if len(ids) <= FEW:
        return ids.astype("<u2").tobytes()
    bits = np.zeros(1 << CHUNK_BITS, np.uint8)
    bits[ids] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def bitmaps(cells: DataFrame) -> DataFrame:
    """Lang, chunk, source and levels from lang, source, id and n > 0."""
    low = F.col("id").bitwiseAND((1 << CHUNK_BITS) - 1).cast("int")
    return (cells.groupBy("lang", F.shiftright("id", CHUNK_BITS).alias("chunk"), "source")
            .agg(F.collect_list(F.struct(F.col("n").alias("n"), low.alias("low"))).alias("cells"))     # 2^15 at most
            .mapInArrow(_levelled, f"lang string, chunk long, source string, levels {_LEVELS}"))


class Levels:
    """The levels of a group in a chunk with their weights."""

    def __init__(self, levels: list[dict], total: int, vocabulary: int):
        below = total + 2 * vocabulary
        weight = np.array([1 + SCALE * (x["count"] + 2) // below for x in levels], np.int64)
        self.zero = np.int64(1 + SCALE * 2 // below)
        many = np.array([not x["few"] for x in levels], bool)
        self.weight = np.concatenate((weight[many], weight[~many]))       # levels with a bitset first
        self.size = np.array([x["terms"] for f in (True, False) for x, m in zip(levels, many) if m == f], np.int64)
        words = (1 << CHUNK_BITS) // 64
        self.bits = np.array([np.frombuffer(x["bits"], "<u8") for x, m in zip(levels, many) if m],
                             np.uint64).reshape(-1, words)
        few = [np.frombuffer(x["bits"], "<u2").astype(np.int64) for x, m in zip(levels, many) if not m]
        self.ids = np.concatenate([np.empty(0, np.int64), *few])
        self.of = np.repeat(np.arange(len(self.bits), len(self.weight)), [len(x) for x in few])
        order = np.argsort(self.ids)
        self.ids, self.of = self.ids[order], self.of[order]

    def terms(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk that the group has, and their levels."""
        at = [np.flatnonzero(np.unpackbits(b.view(np.uint8), bitorder="little")) for b in self.bits]
        ids = np.concatenate([*at, self.ids])
        of = np.concatenate([np.repeat(np.arange(len(at)), [len(a) for a in at]), self.of]).astype(np.int64)
        order = np.argsort(ids)
        return ids[order], of[order]


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _at(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """AND of each bitset with the single bits `ids`."""
    return (bits[:, ids >> 6] >> (ids & 63).astype(np.uint64)) & np.uint64(1)


def joint(a: Levels, b: Levels) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The joint cells of two groups that hold terms: level of a, level of b, terms."""
    cells = []
    for k, row in enumerate(a.bits):
        n = np.bitwise_count(b.bits & row).sum(1, dtype=np.int64)
        hit = np.flatnonzero(n)
        cells.append((np.full(len(hit), k), hit, n[hit]))
    for x, y, swap in ((a, b, False), (b, a, True)):       # single bits of one against bitsets of the other
        level, term = np.nonzero(_at(y.bits, x.ids))
        one = (x.of[term], level, np.ones(len(term), np.int64))
        cells.append((one[1], one[0], one[2]) if swap else one)
    _, i, j = np.intersect1d(a.ids, b.ids, assume_unique=True, return_indices=True)
    cells.append((a.of[i], b.of[j], np.ones(len(i), np.int64)))
    return tuple(np.concatenate(c) for c in zip(*cells))


def divergence(a: Levels, b: Levels, terms: int) -> int:
    """Sum of f over the `terms` kept terms of a chunk, by joint cells and complements."""
    i, j, n = joint(a, b)
    alone_a, alone_b = a.size.copy(), b.size.copy()
    np.subtract.at(alone_a, i, n)
    np.subtract.at(alone_b, j, n)
    neither = terms - int(n.sum()) - int(alone_a.sum()) - int(alone_b.sum())
    return int((n * distance(a.weight[i], b.weight[j])).sum() + (alone_a * distance(a.weight, b.zero)).sum()
               + (alone_b * distance(b.weight, a.zero)).sum() + neither * distance(a.zero, b.zero))


# --- the audit --------------------------------------------------------------------------------------------------------

_FOUND = "lang string, part string, source string, other string, id long, value long"


def _audited(table: pa.Table) -> pa.Table:
    """One chunk of a language, two blocks of its sources: the pairs' values here and each source's first terms."""
    rows = table.to_pylist()
    lang, chunk, i, j = (rows[0][k] for k in ("lang", "chunk", "i", "j"))
    held = {(r["block"], r["source"]): Levels(r["levels"] or [], r["total"], r["vocabulary"]) for r in rows}
    terms = rows[0]["terms"]
    first = sorted(s for b, s in held if b == i)
    out = []
    for a in first:
        for b in sorted(s for k, s in held if k == j):
            if i != j or a < b:
                value = divergence(held[i, a], held[j, b], terms)
                out += [("pair", a, b, None, value), ("pair", b, a, None, value)]
    if i == j:
        whole = held[-1, None]
        ids, of = whole.terms()
        q = np.zeros(1 << CHUNK_BITS, np.int64)
        q[ids] = whole.weight[of]
        for a in first:
            ids, of = held[i, a].terms()
            p = held[i, a].weight[of]
            ids, p = ids[p > q[ids]], p[p > q[ids]]
            value = distance(p, q[ids])
            best = np.lexsort((ids, -value))[:TOP]
            out += [("term", a, None, (chunk << CHUNK_BITS) + int(ids[k]), int(value[k])) for k in best]
    types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    columns = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, types)]
    return pa.table([pa.array([lang] * len(out), pa.string()), *columns],
                    names=["lang", "part", "source", "other", "id", "value"])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, sources: int = SOURCES, **columns) -> DataFrame:
    """Lang, source, part, item, value and rank: of every group all other sources of its language (`pair`) by
    divergence, and its first `TOP` terms that it uses more than the language does (`term`)."""
    cells = materialise(counts(docs, **columns))
    kept = (cells.filter("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
            .filter(F.col("docs") >= least_docs).select("lang", "term", "n"))
    numbered = materialise(prefix_sums(kept, ["lang", "term"], "n").select(
        "lang", "term", F.col("n").alias("whole"), F.col("before_rows").cast("long").alias("id")))
    own = cells.filter("term <> ''").join(numbered.select("lang", "term", "id"), ["lang", "term"]).select(
        "lang", "source", "id", "n")
    maps = materialise(bitmaps(own.unionByName(numbered.select(
        "lang", F.lit(None).cast("string").alias("source"), "id", F.col("whole").alias("n")))))

    # one row a group, a chunk and a language; each is joined with rows of its own size, not with documents
    groups = cells.select("lang", "source").distinct()
    total = maps.select("lang", "source", F.expr("aggregate(levels, 0L, (t, x) -> t + x.count * x.terms)").alias("n")).groupBy(
        "lang", "source").agg(F.sum("n").alias("total"))
    chunks = numbered.groupBy("lang", F.shiftright("id", CHUNK_BITS).alias("chunk")).agg(F.count("*").alias("terms"))
    languages = numbered.groupBy("lang").agg(F.count("*").alias("vocabulary"))
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    every = (groups.select("lang", "source", F.floor(place / sources).cast("int").alias("block"))
             .unionByName(numbered.select("lang").distinct().select(
                 "lang", F.lit(None).cast("string").alias("source"), F.lit(-1).alias("block"))))
    same = [F.col("e.lang") == F.col("t.lang"), F.col("e.source").eqNullSafe(F.col("t.source"))]
    every = every.alias("e").join(total.alias("t"), same, "left").select(
        "e.lang", "e.source", "e.block", F.coalesce("total", F.lit(0)).alias("total"))
    blocks = every.groupBy("lang").agg(F.max("block").alias("last"))
    frame = (every.join(chunks, "lang").join(languages, "lang").join(blocks, "lang"))
    mine = [F.col("f.lang") == F.col("m.lang"), F.col("f.chunk") == F.col("m.chunk"),
            F.col("f.source").eqNullSafe(F.col("m.source"))]
    frame = frame.alias("f").join(maps.alias("m"), mine, "left").select("f.*", "levels")
    # a block meets itself and every later one; the language's row (block -1) meets each block by itself
    tasks = F.when(F.col("block") < 0, F.expr("transform(sequence(0, last), k -> struct(k AS i, k AS j))")).otherwise(
        F.expr("transform(sequence(0, last), k -> struct(least(k, block) AS i, greatest(k, block) AS j))"))
    found = materialise(frame.withColumn("task", F.explode(tasks)).select(
        "lang", "chunk", "task.i", "task.j", "source", "block", "total", "vocabulary", "terms", "levels")
        .groupBy("lang", "chunk", "i", "j").applyInArrow(_audited, _FOUND))

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    values = found.filter("part = 'pair'").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    pairs = (groups.join(groups.select("lang", F.col("source").alias("other")), "lang")
             .filter("source <> other").join(values, ["lang", "source", "other"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"),
                     F.coalesce("value", F.lit(0)).cast("long").alias("value")))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "id")
    top = found.filter("part = 'term'").withColumn("at", F.row_number().over(best)).filter(F.col("at") <= TOP)
    terms = top.select("lang", "source", "id", "value").join(numbered.select("id", "term"), "id").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    ranked = [x.withColumn("rank", F.row_number().over(order).cast("int")) for x in (pairs, terms)]
    return ranked[0].unionByName(ranked[1])
