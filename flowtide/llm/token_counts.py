"""Number of tokens of a unigram tokenizer, without building the tokens.

An Aho-Corasick automaton over the vocabulary lists all pieces that end at each character; dynamic programming keeps,
for each character, the best sum of scores and the number of pieces on that path, and nothing else. The rules that
settle equal and missing cases are those of the tokenizers library's Unigram model:

* of equal sums, the one whose last piece begins earliest stays;
* a character that is no piece by itself may stand as an unknown piece with the least score of the vocabulary less 10,
  and loses against a vocabulary piece of an equal sum;
* neighbouring unknown pieces count as one.

The text is cut at spaces first (each word after the first gets the mark that stands for a space, and so does the
first word), as the Metaspace pre-tokenizer does; words are independent, so a worker remembers counts by word.

Defined results: a null text is an empty text, with no words and no tokens; other columns are not carried.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def read_pieces(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece file with their scores; control, unknown and byte pieces are left out."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())
            if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]


class Counter:
    """Piece counts of words for a vocabulary of (piece, score)."""

    def __init__(self, pieces: Sequence[tuple[str, float]]):
        import ahocorasick

        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def best(self, word: str) -> tuple[float, int]:
        """Best sum of scores of `word` and the number of pieces on that path."""
        n = len(word)
        ends: list[list] = [[] for _ in range(n)]
        if not self.empty:
            for end, piece in self.automaton.iter(word):
                ends[end].append(piece)
        score, count, open_unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(n):
            top = None
            single = False
            for size, value in sorted(ends[end], reverse=True):      # the earliest beginning first
                single |= size == 1
                total = value + score[end + 1 - size]
                if top is None or total > top:
                    top, begin = total, end + 1 - size
            known = top is not None
            if not single and (not known or self.unknown + score[end] > top):
                top, begin, known = self.unknown + score[end], end, False
            score[end + 1] = top
            count[end + 1] = count[begin] + (known or not open_unknown[begin])
            open_unknown[end + 1] = not known
        return score[n], count[n]

    def count(self, word: str) -> int:
        return self.best(word)[1]


def cut(text: bytes) -> list[bytes]:
    """Words of a text: each space, or mark in the text, opens one, and so does the beginning if neither stands there."""
    if not text:
        return []
    words = text.replace(MARK.encode(), b" ").split(b" ")
    return words if words[0] else words[1:]


_COUNTERS: dict = {}


def _memo(path: str):
    if path not in _COUNTERS:
        from flowtide.llm.memo import Memo

        counter = Counter(read_pieces(path))
        _COUNTERS[path] = Memo(lambda words: [counter.count(MARK + w.decode("utf-8", "replace")) for w in words])
    return _COUNTERS[path]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])


def _counting(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(path)
        for batch in batches:
            column = batch.column("text").cast(pa.binary())
            for at in range(0, batch.num_rows, 256):
                words = [cut(t) for t in column.slice(at, 256).to_pylist()]
                n = [sum(g) for g in memo.gather(words)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, 256).cast(pa.int64()), pa.array(map(len, words), pa.int64()),
                    pa.array(n, pa.int64())], schema=_OUT)
    return run


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words and n_tokens of every text, in one pass over the table and without a shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(_counting(vocabulary), "doc_id bigint, n_words bigint, n_tokens bigint")
