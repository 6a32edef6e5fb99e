"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton accepts every run of words of every item. The words of a document are streamed through it; after each
word it knows the longest run that ends there and stands in an item. Where that run has a whole window (10 words; a
shorter item is one window as a whole), the window's words are hit. Words that no item has reset the stream, so only
stretches of item words are walked.

Words are runs of letters, digits and characters beyond ASCII, with A-Z as a-z. The items are a broadcast: their words
are counted first, and items beyond `ITEM_WORDS` words are split into parts that pass over the documents one after
the other, so a task's automaton has a bounded size however many items there are.

Defined results: a null text has no words and no hits; an item without words or text has no window; repeated items are
all reported; items of a null id take part in hits but are not listed; no items or no documents give zero hits or no
rows; other columns are kept by `clean` and not carried by `contamination`.
"""
from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowtide.cluster import materialise

WINDOW = 10
ITEM_WORDS = 2_000_000

#: Separators become spaces and A-Z become a-z, byte by byte; bytes of characters beyond ASCII stay.
_FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32
              for b in range(256))


_WORD = re.compile(rb"[^ ]+")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences, with the windows it has to report."""

    def __init__(self, items: Sequence[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = [(key, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for key, ws in items if ws]
        for _, ids in coded:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self.least = min((min(len(ids), window) for _, ids in coded), default=window)
        self._mark(coded)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        known = nxt[last].get(w)
        if known is not None:                       # an earlier item has this run
            return known if length[known] == length[last] + 1 else self._split(last, w, known)
        new = self._state({}, length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _state(self, edges: dict[int, int], length: int) -> int:
        self.next.append(edges)
        self.len.append(length)
        self.link.append(0)
        return len(self.len) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        part = self._state(dict(self.next[q]), self.len[p] + 1)
        self.link[part], self.link[q] = self.link[q], part
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = part
            p = self.link[p]
        return part

    def _mark(self, coded: list[tuple[object, list[int]]]) -> None:
        """Where windows end: `full` gives the state of the last `window` words by state; `short` lists by state the
        short items, as (words, state), that end in it or in its suffixes."""
        order = sorted(range(len(self.len)), key=self.len.__getitem__)
        self.full = [-1] * len(self.len)
        for s in order[1:]:
            if self.len[s] >= self.window:
                up = self.link[s]
                self.full[s] = s if self.len[up] < self.window else self.full[up]
        self.items: dict[tuple[int, int], set] = {}
        own: dict[int, set[int]] = {}
        for key, ids in coded:
            state = 0
            for at, w in enumerate(ids):
                state = self.next[state][w]
                if at + 1 >= self.window:
                    self.items.setdefault((self.full[state], self.window), set()).add(key)
            if len(ids) < self.window:
                self.items.setdefault((state, len(ids)), set()).add(key)
                own.setdefault(state, set()).add(len(ids))
        self.short: list[tuple] = [()] * len(self.len)
        if own:
            for s in order[1:]:
                self.short[s] = self.short[self.link[s]] + tuple((n, s) for n in sorted(own.get(s, ())))

    def match(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, the hit stretches as (first, last + 1) in order and merged, and the items found."""
        ids = np.fromiter(map(self.vocabulary.get, found := words(text), _ABSENT), np.int64, len(found)) \
            if text else np.empty(0, np.int64)
        spans: list[list[int]] = []
        seen: set[tuple[int, int]] = set()
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        for lo, hi in zip(known[::2].tolist(), known[1::2].tolist()):
            if hi - lo >= self.least:
                self._walk(ids[lo:hi].tolist(), lo, spans, seen)
        return len(ids), [tuple(x) for x in spans], {i for w in seen for i in self.items[w] if i is not None}

    def _walk(self, ids: list[int], lo: int, spans: list[list[int]], seen: set) -> None:
        nxt, link, length, window = self.next, self.link, self.len, self.window
        state = run = 0
        for at, w in enumerate(ids, lo + 1):
            while state and w not in nxt[state]:
                state = link[state]
                run = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                run += 1
            else:
                run = 0
            if run >= window:
                seen.add((self.full[state], window))
                self._hit(spans, at - window, at)
            if self.short[state]:
                for n, s in self.short[state]:
                    if n <= run:
                        seen.add((s, n))
                        self._hit(spans, at - n, at)

    @staticmethod
    def _hit(spans: list[list[int]], a: int, b: int) -> None:
        while spans and a <= spans[-1][1]:
            a = min(a, spans.pop()[0])
        spans.append([a, b])


class _Always:
    """An endless supply of one value, for map."""

    def __iter__(self):
        return self

    def __next__(self):
        return -1


_ABSENT = _Always()


def parts_of(items: DataFrame, id_col: str = "item_id", text: str = "text", most: int = ITEM_WORDS) -> Iterator[list]:
    """The items as lists of (id, text), each with at most `most` words (or one item), read one list at a time."""
    rows = items.filter(F.col(text).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
    part, held = [], 0
    for r in rows.toLocalIterator():
        n = len(words(r["text"].encode()))
        if part and held + n > most:
            yield part
            part, held = [], 0
        part.append((r["id"], r["text"]))
        held += n
    yield part


_AUTOMATA: dict = {}


def _automaton(key: str, shared, window: int) -> Automaton:
    """The worker's automaton of a part; it holds one part at a time."""
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = Automaton([(i, words(t.encode())) for i, t in shared.value], window)
    return _AUTOMATA[key]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _passes(rows: DataFrame, items: DataFrame, item_id: str, item_text: str, window: int, most: int, of) -> DataFrame:
    """`rows` through `of(key, broadcast, window)`, a function over Arrow batches that keeps the columns; one pass for
    each part of the items, stored between passes so that a task never holds two automata."""
    sc = rows.sparkSession.sparkContext
    parts = parts_of(items, item_id, item_text, most)
    now, part = rows, next(parts)
    while part is not None:
        later = next(parts, None)
        now = now.mapInArrow(of(uuid.uuid4().hex, sc.broadcast(part), window), now.schema)
        if later is not None:
            now = materialise(now)
        part = later
    return now


def _find(key: str, shared, window: int):
    """Add what a part's automaton finds to _d_words, _d_hits (first, last + 1, first, ...) and _d_items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, shared, window)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                counts, hits, seen = [], [], []
                for text, before, known in zip(part.column("_d_text").cast(pa.binary()), part.column("_d_hits").to_pylist(),
                                               part.column("_d_items").to_pylist()):
                    n, spans, found = automaton.match(text.as_py())
                    if before:
                        spans = merged(spans + list(zip(before[::2], before[1::2])))
                    counts.append(n)
                    hits.append([x for s in spans for x in s])
                    seen.append(sorted(found.union(known or ())))
                new = {"_d_words": pa.array(counts, pa.int64()), "_d_hits": pa.array(hits, pa.list_(pa.int64())),
                       "_d_items": pa.array(seen, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([new.get(n, part.column(n)) for n in part.schema.names],
                                                 names=part.schema.names)
    return run


def matches(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
            window: int = WINDOW, most: int = ITEM_WORDS) -> DataFrame:
    """`docs` with _d_text, _d_words (count), _d_hits (hit stretches of words, flattened) and _d_items."""
    rows = docs.withColumns({"_d_text": F.col(text), "_d_words": F.lit(None).cast("bigint"),
                             "_d_hits": F.lit(None).cast("array<bigint>"), "_d_items": F.lit(None).cast("array<string>")})
    return _passes(rows, items, item_id, item_text, window, most, _find)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """Id, n_words, n_hit, n_items, items_sha256 and contaminated of every document, without a shuffle."""
    found = matches(docs.select(id_col, text), items, text, **kw).drop("_d_text", text)
    hit = F.aggregate(F.transform(F.col("_d_hits"), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)),
                      F.lit(0).cast("bigint"), lambda t, x: t + x)
    return found.select(
        id_col, F.col("_d_words").alias("n_words"), hit.alias("n_hit"), F.size("_d_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("_d_items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of these stretches."""
    places = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def _strip(columns_chars: str | None, text_col: str, least: int, share: float):
    def of(key: str, shared, window: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(key, shared, window)
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    texts, keep, changed = [], [], False
                    for value in part.column(text_col).cast(pa.binary()).to_pylist():
                        gone, whole = 0, 0
                        while value:
                            n, spans, _ = automaton.match(value)
                            whole = whole or n
                            spans = [s for s in spans if s[1] - s[0] >= least]
                            if not spans:
                                break
                            gone += sum(b - a for a, b in spans)
                            value, changed = without(value, spans), True
                        texts.append(value)
                        keep.append(gone <= share * whole)
                    new = {}
                    if changed:
                        strings = [None if t is None else t.decode() for t in texts]
                        new[text_col] = pa.array(strings, part.schema.field(text_col).type)
                        if columns_chars:
                            new[columns_chars] = pa.array([None if t is None else len(t) for t in strings],
                                                          part.schema.field(columns_chars).type)
                    table = pa.RecordBatch.from_arrays([new.get(n, part.column(n)) for n in part.schema.names],
                                                       schema=part.schema)
                    yield table.filter(pa.array(keep, pa.bool_()))
        return run
    return of


def _cut(text_col: str, chars: str | None, least: int, share: float):
    """Without the hit stretches that all parts found, with _c_whole (the words at first), _c_gone (those removed) and
    _c_open (whether the text is to be read again); texts that lost too much go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts, whole, gone, again = [], [], [], []
                for value, n, hits, first, lost in zip(*[part.column(c).to_pylist() for c in (
                        text_col, "_d_words", "_d_hits", "_c_whole", "_c_gone")]):
                    spans = [s for s in zip(hits[::2], hits[1::2]) if s[1] - s[0] >= least]
                    texts.append(without(value.encode(), spans).decode() if spans else value)
                    whole.append(n if first is None else first)
                    gone.append(lost + sum(b - a for a, b in spans))
                    again.append(bool(spans))
                new = {text_col: pa.array(texts, part.schema.field(text_col).type), "_c_whole": pa.array(whole, pa.int64()),
                       "_c_gone": pa.array(gone, pa.int64()), "_c_open": pa.array(again)}
                if chars:
                    new[chars] = pa.array([len(t) if cut else c for t, cut, c in zip(
                        texts, again, part.column(chars).to_pylist())], part.schema.field(chars).type)
                table = pa.RecordBatch.from_arrays([new.get(n, part.column(n)) for n in part.schema.names], schema=part.schema)
                yield table.filter(pa.array([g <= share * w for g, w in zip(gone, whole)], pa.bool_()))
    return run


def _clean_in_parts(docs: DataFrame, parts: dict, text: str, chars: str | None, least: int, share: float) -> DataFrame:
    """Rounds of finding by every part, then removing; texts that lost something are read again by every part."""
    now, done = docs.withColumns({"_c_whole": F.lit(None).cast("bigint"), "_c_gone": F.lit(0).cast("bigint"),
                                  "_c_open": F.lit(None).cast("boolean")}), None
    while True:
        found = matches(now, text=text, **parts)
        now = materialise(found.mapInArrow(_cut(text, chars, least, share), found.schema).drop(
            "_d_text", "_d_words", "_d_hits", "_d_items"))
        still = now.filter(~F.col("_c_open"))
        done = still if done is None else done.unionAll(still)
        now = now.filter("_c_open")
        if now.isEmpty():
            return done.select(*docs.columns)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", chars: str | None = "n_chars", item_id: str = "item_id",
          item_text: str = "text", window: int = WINDOW, least: int = 1, share: float = 0.5,
          most: int = ITEM_WORDS) -> DataFrame:
    """`docs` without their hit stretches of `least` words or more, and without the documents that would lose more than
    `share` of their words. A text is read again after a removal, as what closes up may hold a window. `chars`, if it
    is a column, gets the new length. The result does not depend on the number of parts that the items make."""
    chars = chars if chars in docs.columns else None
    parts = parts_of(items, item_id, item_text, most)
    next(parts)
    if next(parts, None) is not None:
        return _clean_in_parts(docs, {"items": items, "item_id": item_id, "item_text": item_text, "window": window,
                                      "most": most}, text, chars, least, share)
    return _passes(docs, items, item_id, item_text, window, most, _strip(chars, text, least, share))
