"""Fill-in-middle transformation: texts cut into prefix, middle and suffix and put together in another order.

Where a text is cut, and its form, follow from the SHA-256 of its id. The units are lines; a form is plain (the text as
it is), psm (`<P>`prefix`<S>`suffix`<M>`middle) or spm (`<S>`suffix`<P>`prefix`<M>`middle). A text that contains a marker
stays plain, so the first three markers of an output that is not plain tell its parts.

The output is put together by a secondary sort. A text is emitted as pieces, chunks of whole units (a unit longer than a
chunk in several), each keyed by its document and the place it has in the output. The pieces are repartitioned by
document and sorted by place inside the partitions (Spark's sort spills), and each partition is streamed: a digest takes
the pieces of a document one after the other, and no text is ever held whole after the cut. To restore the texts, the
stream reads where the markers stand in the output itself, gives each piece the place it has in the text, and the
partition is sorted again by that place and streamed into a second digest; a document's pieces are already in one
partition, so this moves nothing between machines.

Defined results: a null text is empty; an empty text has no units and is plain; a null id has no digits, so all rows
without an id are cut by the same numbers; rows that share an id are documents of their own; an empty table gives no
rows; other columns are not carried. A map task holds one text while it cuts it.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARKERS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle"), "plain": ("plain",)}
SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50
CHUNK = 1 << 16


def numbers(doc_id: object, seed: int = SEED) -> list[int]:
    """The four numbers that an id gives."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]


def unit_ends(text: bytes) -> np.ndarray:
    """Where the lines of a text end; the last needs no line feed."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if not text or text.endswith(b"\n") else np.append(ends, len(text))


def plan(text: bytes, ends: np.ndarray, doc_id: object, seed: int = SEED, fim: int = FIM_PERCENT,
         spm: int = SPM_PERCENT) -> tuple[str, int, int]:
    """Form of a text and the number of units before its middle and before its suffix."""
    h1, h2, h3, h4 = numbers(doc_id, seed)
    if not text or h3 % 100 >= fim or any(m in text for m in MARKERS.values()):
        return "plain", 0, 0
    cut = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    return "spm" if h4 % 100 < spm else "psm", *cut


def chunks(text: bytes, ends: np.ndarray, first: int, last: int, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Byte ranges of at most `size`, of whole units where they fit, that cover units first to last - 1. A longer unit
    is cut between code points."""
    at = int(ends[first - 1]) if first else 0
    stop = int(ends[last - 1]) if last else 0
    while at < stop:
        to = min(at + size, stop)
        k = int(np.searchsorted(ends, to, side="right")) - 1
        if k >= 0 and ends[k] > at:
            to = int(ends[k])
        else:
            while to < stop and text[to] & 0xC0 == 0x80:
                to += 1
        yield at, to
        at = to


_PIECES = "doc long, place long, id string, n long, form string, part string, chars long, piece binary"


def _cut(seed: int, fim: int, spm: int, size: int):
    """Pieces of every text. The marker of a part goes with its first piece, so an empty part still has one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = [c.split()[0] for c in _PIECES.split(", ")]

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            out, held = [], 0
            for doc, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                         batch.column(2).cast(pa.binary())):
                text = text.as_py() or b""
                ends = unit_ends(text)
                form, a, b = plan(text, ends, doc_id, seed, fim, spm)
                n, place = len(ends), 0
                units = {"plain": (0, n), "prefix": (0, a), "middle": (a, b), "suffix": (b, n)}
                for part in ORDERS[form]:
                    lead = MARKERS.get(part, b"")
                    for lo, hi in list(chunks(text, ends, *units[part], size)) or [(0, 0)]:
                        piece = lead + text[lo:hi]
                        out.append((doc, place, doc_id, n, form, part, _length(text[lo:hi]), piece))
                        lead, place, held = b"", place + 1, held + len(piece)
                        if held > 1 << 24:
                            yield batch_of(out)
                            out, held = [], 0
            if out:
                yield batch_of(out)
    return run


def _length(text: bytes) -> int:
    """Code points of UTF-8: the bytes that begin one."""
    if text.isascii():
        return len(text)
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


_RETOLD = "doc long, turn int, place long, id string, n long, form string, output_sha256 string, prefix long, middle long, piece binary"


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in output order into digests of the outputs. What goes on are the pieces of the text, without markers and
    with the place they have in it, told from the output's own markers; a document's last row carries its facts."""
    types = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    names = [c.split()[0] for c in _RETOLD.split(", ")]
    turns = {b"<P>": 0, b"<M>": 1, b"<S>": 2}
    now = None                      # of the document that is being read: doc, id, n, form, digest, turn, characters
    out: list = []

    def close() -> None:
        if now is not None:
            doc, doc_id, n, form, digest, _, chars = now
            whole = form == "plain"
            out.append((doc, 3, 0, doc_id, n, form, digest.hexdigest(), None if whole else chars[0],
                        None if whole else chars[1], None))

    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 6)]
        for doc, place, doc_id, n, form, chars, piece in zip(*cols, batch.column(7)):
            piece = piece.as_py()
            if now is None or now[0] != doc:
                close()
                now = [doc, doc_id, n, form, hashlib.sha256(), 0, [0, 0, 0]]
            now[4].update(piece)
            if form != "plain" and piece[:3] in turns:
                now[5] = turns[piece[:3]]
                piece = piece[3:]
            now[6][now[5]] += chars
            out.append((doc, now[5], place, None, None, None, None, None, None, piece))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out = []
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


_RESULT = "id string, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of the text into digests of the texts; one row a document."""
    digest = hashlib.sha256()
    for batch in batches:
        out = []
        turn, pieces = batch.column(1).to_pylist(), batch.column(9)
        facts = {k: batch.column(k) for k in (3, 4, 5, 6, 7, 8)}
        for k, t in enumerate(turn):
            if t < 3:
                digest.update(pieces[k].as_py())
            else:
                i, n, form, output, prefix, middle = (facts[c][k].as_py() for c in (3, 4, 5, 6, 7, 8))
                out.append((i, n, form, prefix, middle, output, digest.hexdigest()))
                digest = hashlib.sha256()
        if out:
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                             names=[c.split()[0] for c in _RESULT.split(", ")])


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = SEED, fim: int = FIM_PERCENT,
           spm: int = SPM_PERCENT, chunk: int = CHUNK) -> DataFrame:
    """The outputs as pieces: doc (one number a row of `docs`), place in the output, id, n, form, part, chars (of the
    text in the piece) and piece, all pieces of a document in one partition and in order."""
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).cast("string").alias("id"),
                       F.col(text).alias("text"))
    return (rows.mapInArrow(_cut(seed, fim, spm, chunk), _PIECES)
            .repartition("doc").sortWithinPartitions("doc", "place"))


def transform(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """Id, n (units), form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every document."""
    told = pieces(docs, id_col, text, **kw).mapInArrow(_assembled, _RETOLD)
    back = told.sortWithinPartitions("doc", "turn", "place").mapInArrow(_restored, _RESULT)
    return back.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n", "form", "prefix_chars",
                       "middle_chars", "output_sha256", "restored_sha256")


def outputs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """Id, form and output text of every document, for texts that fit into a row."""
    told = pieces(docs, id_col, text, **kw)
    whole = told.groupBy("doc").agg(F.first("id").alias("id"), F.first("form").alias("form"), F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("place", "piece"))), lambda p: F.decode(p["piece"], "UTF-8")), "").alias("output"))
    return whole.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "form", "output")
