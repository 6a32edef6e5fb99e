"""Token ids of documents in fixed-width bit-packed segments.

Format of a segment (little-endian): magic b"TIDP", version u32, bits u32, block size u32, number of ids u64, number
of blocks u64, then (blocks + 1) byte offsets u64 from the start of the payload, then the payload. A block packs up to
`block` ids of `bits` bits each, first id in the lowest bits, and is padded to a whole byte. `bits` is the least
number that holds the largest id of the vocabulary. Since every block starts at a byte and its offset is stored, any
range of ids is unpacked from the blocks it touches, with numpy.

A store is a folder of Parquet files whose rows are segments in ascending id order: shard, segment, first and last id
of the documents, n_ids, doc_ids, lengths, data. Spark's committer makes a write whole or absent when executors are
lost. The global position of an id is its shard's base (a running sum with one row a shard), the segments before it in
the shard, and its place in the segment.

Defined results: a null text is an empty text and yields the end id alone; a null document id sorts first; rows with
equal ids are ordered by the hash of their texts; an empty table makes an empty store. A document lies in one segment;
a segment ends after `segment` ids, so memory is bounded by the longest document plus that.
"""
from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

MAGIC, VERSION, BLOCK, SEGMENT = b"TIDP", 1, 4096, 1 << 18
_HEAD = struct.Struct("<4sIIIQQ")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """A segment of `ids`."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    n, blocks = len(ids), -(-len(ids) // block)
    if n and int(ids.max()) >> bits:
        raise ValueError("an id does not fit the width")
    whole = (block * bits + 7) // 8
    tail = ((n - (blocks - 1) * block) * bits + 7) // 8 if n else 0
    offsets = np.arange(blocks + 1, dtype="<u8") * whole
    if n:
        offsets[-1] = offsets[-2] + tail
    if bits in (8, 16, 32):
        payload = ids.astype(f"<u{bits // 8}").tobytes()
    else:
        parts = []
        for b in range(blocks):
            part = ids[b * block:(b + 1) * block]
            grid = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=32)[:, :bits]
            parts.append(np.packbits(grid.reshape(-1), bitorder="little").tobytes())
        payload = b"".join(parts)
    return _HEAD.pack(MAGIC, VERSION, bits, block, n, blocks) + offsets.tobytes() + payload


def unpack(segment: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids at positions start to stop of a segment, read from the blocks that hold them."""
    magic, version, bits, block, n, blocks = _HEAD.unpack_from(segment)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a segment of this format")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.empty(0, "<u4")
    offsets = np.frombuffer(segment, "<u8", blocks + 1, _HEAD.size)
    base, first, last = _HEAD.size + 8 * (blocks + 1), start // block, (stop - 1) // block
    if bits in (8, 16, 32):
        at = base + int(offsets[first])
        got = np.frombuffer(segment, f"<u{bits // 8}", min(n, (last + 1) * block) - first * block, at).astype("<u4")
    else:
        got = np.concatenate([_block(segment, base + int(offsets[b]), bits, min(block, n - b * block))
                              for b in range(first, last + 1)])
    return got[start - first * block:stop - first * block]


def _block(segment: bytes, at: int, bits: int, count: int) -> np.ndarray:
    raw = np.frombuffer(segment, np.uint8, (count * bits + 7) // 8, at)
    grid = np.unpackbits(raw, bitorder="little", count=count * bits).reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = grid
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


# --- encoding ---------------------------------------------------------------------------------------------------------

_ENCODERS: dict = {}
#: Characters whose normal form, lower case and class need no tables: ASCII without control characters, and the Latin
#: letters up to U+024F but for U+0130, whose lower case has two characters.
_PLAIN = re.compile("[\t-\r -~\u00c0-\u012f\u0131-\u024f]*")
#: The pre-token pattern of the tokenizer file, for plain characters in lower case.
_PRE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u024f]+|[0-9]|[^\t-\r a-z0-9\u00df-\u00f6\u00f8-\u024f]+")
_SPACES = re.compile("[^\t-\r ]+")


class Encoder:
    """Ids of texts by a file of the tokenizers library, with a memory of what recurs.

    Texts are cut at ASCII white space, which no pre-token holds, and the ids of a word are remembered. A new word of
    plain characters is cut into pre-tokens, which are remembered too, so that the library encodes each once; a word
    with any other character, or with the opening of a special token, goes to the whole tokenizer as it stands.
    """

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer, pre_tokenizers

        from flowtide.llm.memo import Memo

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.pieces = Tokenizer(self.whole.model)
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.array([(self.whole.id_to_token(i) or "").endswith("</w>")
                              for i in range(self.whole.get_vocab_size())])
        self.memo = Memo(self._new, limit)

    def _new(self, words: list[str]) -> list[bytes]:
        """Ids of words and pre-tokens; a word of letters is a pre-token itself."""
        cut = [None if w.isalpha() or w[0] == "\0" else _PRE.findall(w) for w in words]
        parts = set().union(*filter(None, cut)).difference(self.memo)
        single = list(parts.union([w for w, c in zip(words, cut) if c is None and w[0] != "\0"]))
        ids = dict(zip(single, self._pre(single)))
        self.memo.update((p, ids[p]) for p in parts)
        other = iter(self._other([w[1:] for w in words if w[0] == "\0"]))
        get = self.memo.__getitem__
        return [ids[w] if c is None and w[0] != "\0" else next(other) if c is None else b"".join(map(get, c))
                for w, c in zip(words, cut)]

    def _pre(self, tokens: list[str]) -> Iterator[bytes]:
        for at in range(0, len(tokens), 500):
            part = tokens[at:at + 500]
            ids = np.array(self.pieces.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(part):
                data = ids.tobytes()
                yield from (data[i:j] for i, j in zip([0, *stops], stops))
            else:
                yield from self._other(part)

    def _other(self, words: list[str]) -> Iterator[bytes]:
        for at in range(0, len(words), 500):
            for e in self.whole.encode_batch(words[at:at + 500], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [t.lower().split() if "<|" not in t and _PLAIN.fullmatch(t) else
               [w.lower() if "<|" not in w and _PLAIN.fullmatch(w) else "\0" + w for w in _SPACES.findall(t)]
               for t in texts]
        return [b"".join(g) for g in self.memo.gather(cut)]


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


STORE = ("shard int, segment int, first_id bigint, last_id bigint, n_ids bigint, doc_ids array<bigint>, "
         "lengths array<bigint>, data binary")
_STORE_ARROW = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()),
                          ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                          ("data", pa.binary())])


def _portions(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of rows that hold about `most` characters together, or of one longer row."""
    docs, texts, held = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id"), batch.column("text")):
            docs.append(doc.as_py())
            texts.append(text.as_py())
            held += len(texts[-1])
            if held >= most:
                yield docs, texts
                docs, texts, held = [], [], 0
    if docs:
        yield docs, texts


def _segments(tokenizer: str, end_id: int, bits: int, block: int, segment: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard, number = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, lengths, parts, held = [], [], [], 0

        def flush():
            nonlocal number, held
            flat = np.frombuffer(b"".join(parts), "<u4")
            known = [i for i in ids if i is not None]
            row = [[shard], [number], [known[0] if known else None], [known[-1] if known else None], [len(flat)],
                   [list(ids)], [list(lengths)], [pack(flat, bits, block)]]
            number, held = number + 1, 0
            for x in (ids, lengths, parts):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _STORE_ARROW)], schema=_STORE_ARROW)

        for docs, texts in _portions(batches):
            for doc, packed in zip(docs, encoder.encode(texts)):
                ids.append(doc)
                lengths.append(len(packed) // 4 + 1)
                parts.append(packed + end)
                held += lengths[-1]
                if held >= segment:
                    yield flush()
        if ids:
            yield flush()

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int, id_col: str = "doc_id",
                text: str = "text", block: int = BLOCK, segment: int = SEGMENT) -> None:
    """Encode every text, append `end_id`, and write the ids to `path` in ascending id order."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.mapInArrow(_segments(tokenizer, end_id, bits_for(vocabulary), block, segment), STORE).write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Segments with `base`, the number of ids in the store before each."""
    rows = spark.read.schema(STORE).parquet(path)
    sizes = rows.select("shard", "segment", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("_t_n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("_t_n").over(earlier), F.lit(0)).alias("_t_base"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    at = (sizes.withColumn("_t_in", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
          .join(F.broadcast(bases), "shard")            # one row a file shard
          .select("shard", "segment", (F.col("_t_in") + F.col("_t_base")).alias("base")))
    return rows.join(at, ["shard", "segment"])


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> np.ndarray:
    """The ids at global positions start to stop; only the segments that hold them are read to the caller."""
    hit = read_store(spark, path).filter((F.col("base") < stop) & (F.col("base") + F.col("n_ids") > start))
    parts = [unpack(bytes(r["data"]), max(0, start - r["base"]), stop - r["base"])
             for r in hit.select("base", "data").orderBy("base").toLocalIterator()]
    return np.concatenate(parts) if parts else np.empty(0, "<u4")


_DOCS_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            doc, length, data, base = (batch.column(c)[row].as_py() for c in ("doc_ids", "lengths", "data", "base"))
            ids = unpack(data)
            ends = np.cumsum(length)
            crc = [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends.tolist(), length)]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(base + ends - length, pa.int64()),
                                              pa.array(length, pa.int64()), pa.array(crc, pa.int64())], schema=_DOCS_ARROW)


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, from the stored ids."""
    return (read_store(spark, path).select("doc_ids", "lengths", "data", "base")
            .mapInArrow(_digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))
