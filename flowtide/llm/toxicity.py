"""Toxicity scores by weak supervision.

Voters look at a text and vote toxic, clean or not at all: word lists (a general one, and stems found in labelled
rows, dealt to several voters), and patterns of shouting and of repeated marks. The label of
a training row is one more voter, of the same weight as the others. A generative label model estimates by
expectation-maximisation how common toxic texts are and how each voter votes on toxic and on clean ones, from labelled
and unlabelled rows alike; voters that are copies of each other are folded into one, and those whose votes agree beyond
what the class explains count less, by the sum of those correlations. A linear classifier is trained on the posterior
labels and alone makes the scores, from the text alone.

The model is fitted on at most `PER_CLASS` labelled rows of either label and as many unlabelled rows, the ones with the
least hash of their id; labels of rows with crc32(doc_id as text) mod 3 = 1 are held out and never read for it (such
rows may be among the unlabelled ones, by their texts). Counts, votes and features are taken from whole texts, and every
text is scored.

Defined results: a null text is an empty text and gets the score of a text without any feature; a label without a
document and a document without an id are left out of the fit; of several labels of an id the greatest holds;
without labels the general word list alone decides; an empty table gives no rows; a column with the score's name is
replaced, all others stay.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowtide.llm.decontaminate import _FOLD

PER_CLASS, STEMS, LEXICON_VOTERS, CUT = 3000, 400, 10, 0.7
PREFIXES = (4, 5, 6, 8)
#: Likelihood ratio that a stem must exceed: a chance of 1e-6 for one stem, as a great many are looked at.
EVIDENCE = 24.0

#: General English insults.
GENERAL = ("bastard clown crap creep disgusting dumb fool freak garbage hate hateful idiot idiotic imbecile jerk kill liar "
           "loser lunatic moron moronic nasty pathetic pig scum shit shut sick stupid suck trash ugly vermin vile "
           "worthless").encode().split()


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_FOLD).split() if text else []


def stems_of(words: set[bytes]) -> set[bytes]:
    """Whole words, up to 24 bytes, and the beginnings of longer ones; a stem of under 4 bytes is a whole word."""
    out = {w[:24] for w in words}
    for n in PREFIXES:
        out.update([w[:n] for w in words if len(w) > n])
    return out


@dataclass
class Model:
    """Stems with their weights, weights of the counted features, and the intercept."""
    stems: list[bytes] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    extra: np.ndarray = field(default_factory=lambda: np.zeros(EXTRA))
    intercept: float = 0.0
    prepared: tuple | None = None

    def find(self, text: str | None) -> tuple[list[int], list[float], list[float]]:
        """Indexes of the stems in a text, the logarithms of their counts, and the counted features."""
        if self.prepared is None:
            place = {s: i for i, s in enumerate(self.stems)}
            self.prepared = place, {s[:4] for s in self.stems}, sorted({len(s) for s in self.stems}, reverse=True)
        place, heads, sizes = self.prepared
        words, found, general = words_of(text), Counter(), 0
        hits = [w for w in words if w[:4] in heads]
        told = 0
        for w in hits:
            own = {place[w[:n]] for n in sizes if (4 <= n <= len(w) or n == len(w)) and w[:n] in place}
            found.update(own)
            told += bool(own)
            general += w in _GENERAL
        at = sorted(found)
        return at, [float(np.log1p(found[i])) for i in at], [
            float(np.log1p(told)), float(told > 1), float(general > 0), 100.0 * told / (len(words) + 20), *patterns(text)]

    def score(self, text: str | None) -> float:
        at, counts, extra = self.find(text)
        z = self.intercept + float(self.weights[at] @ counts if at else 0.0) + float(self.extra @ extra)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


EXTRA = 6
_GENERAL = frozenset(GENERAL)


#: Vowels stand for all letters in telling capitals from small ones.
_CAPITALS, _SMALL = [bytes([b]) for b in b"AEIOU"], [bytes([b]) for b in b"aeiou"]


def patterns(text: str | None) -> tuple[float, float]:
    """Whether a text shouts (most letters are capitals), and whether marks stand in runs."""
    if not text:
        return 0.0, 0.0
    raw = text.encode()
    capitals = sum(map(raw.count, _CAPITALS))
    small = sum(map(raw.count, _SMALL))
    return float(capitals > small), float(any(m in text for m in ("!!!", "***", "???", "###")))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text: str = "text",
           label: str = "toxic") -> DataFrame:
    """(_y, _t) of the rows that the model is fitted on; _y is the label, or -1 where none may be read."""
    known = (labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
             .groupBy(id_col).agg((F.max(label) > 0).cast("int").alias("_y")))
    first = [F.xxhash64(id_col), F.col(id_col)]
    ids = docs.select(id_col).filter(F.col(id_col).isNotNull()).distinct()
    unlabelled = ids.join(known, id_col, "left_anti").withColumn("_y", F.lit(-1))
    picked = reduce(DataFrame.unionAll, [part.orderBy(*first).limit(per_class) for part in (
        known.filter("_y = 0"), known.filter("_y = 1"), unlabelled)])
    return (docs.select(id_col, text).join(F.broadcast(picked), id_col)         # at most 3 * per_class rows
            .select("_y", F.coalesce(F.col(text), F.lit("")).alias("_t")))


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for y, t in zip(batch.column("_y").to_pylist(), batch.column("_t").to_pylist()):
            if y in counts:
                counts[y].update(stems_of(set(words_of(t))))
    for y, c in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array([y] * len(c), pa.int32()),
                                          pa.array(list(c.values()), pa.int64())], names=["stem", "_y", "n"])


def mine_stems(rows: DataFrame, sizes: dict[int, int], most: int = STEMS) -> list[bytes]:
    """Stems that mark the toxic rows: by documents with them times the log of how much likelier they are there."""
    t, c = sizes.get(1, 0), sizes.get(0, 0)
    if not t or not c:
        return []
    ratio = F.log(((F.col("t") + 0.5) / (t + 1)) / ((F.col("c") + 0.5) / (c + 1)))

    def part(seen: Column, n: int) -> Column:       # of the likelihood ratio statistic, with and without the stem
        both = F.col("t") + F.col("c")
        share = both / float(t + c)
        return sum((F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0) for x, p in ((seen, share), (n - seen, 1 - share))),
                   F.lit(0.0))

    evidence = 2 * (part(F.col("t"), t) + part(F.col("c"), c))
    got = (rows.mapInArrow(_count_stems, "stem binary, _y int, n bigint").groupBy("stem")
           .agg(F.sum(F.when(F.col("_y") == 1, F.col("n")).otherwise(0)).alias("t"),
                F.sum(F.when(F.col("_y") == 0, F.col("n")).otherwise(0)).alias("c"))
           .filter((F.col("t") >= 3) & (ratio > 2.0) & (evidence > EVIDENCE)).withColumn("gain", ratio * F.col("t"))
           .orderBy(F.col("gain").desc(), "stem").limit(4 * most).collect())
    support = {bytes(r["stem"]): r["t"] for r in got}
    # of stems with the same documents the longest stays
    covered = {s[:n] for s, k in support.items() for n in range(4, len(s)) if support.get(s[:n]) == k}
    return [s for s in support if s not in covered][:most]


def votes_of(found: list[list[int]], extra: np.ndarray, labels: np.ndarray, stems: int) -> np.ndarray:
    """Votes (1 toxic, 0 clean, -1 none) of every voter on every row; the last voter is the label. Stems stand in the
    order of their evidence, and neighbours share a voter, so that weak ones do not speak with the voice of strong ones."""
    out = -np.ones((len(found), LEXICON_VOTERS + 6), np.int8)
    for row, own in enumerate(found):
        for i in own:
            out[row, i * LEXICON_VOTERS // stems] = 1
    at = LEXICON_VOTERS
    out[extra[:, 1] > 0, at] = 1
    out[extra[:, 2] > 0, at + 1] = 1
    out[extra[:, 3] > 1, at + 2] = 1
    out[:, at + 3] = extra[:, 4] > 0
    out[:, at + 4] = extra[:, 5] > 0
    out[:, at + 5] = labels
    return out


def copies_of(votes: np.ndarray, least: int = 20, agree: float = 0.99) -> np.ndarray:
    """For each voter the first voter that it is a copy of, or itself. Copies vote the same wherever both vote, on
    `least` rows of either kind; voters of one kind of vote must be silent together as well."""
    n, m = votes.shape
    out = np.arange(m)
    for j in range(m):
        for i in range(j):
            if out[i] != i:
                continue
            both = (votes[:, i] >= 0) & (votes[:, j] >= 0)
            same = votes[both, i] == votes[both, j]
            kinds = [((votes[both, i] == v) | (votes[both, j] == v)).sum() for v in (0, 1)]
            if min(kinds) >= least and same.mean() >= agree or (
                    max(kinds) >= least and (votes[:, i] == votes[:, j]).mean() >= 0.9999):
                out[j] = i
                break
    return out


def label_model(votes: np.ndarray, start: np.ndarray | None = None, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior chance of toxic for each row; for each voter the chances of its three votes by class; its weight.

    `start` are first guesses of the posterior, NaN where there is none: the first chances of votes are those over the
    guessed rows. Without them every voter is thought right until seen otherwise.
    """
    first = copies_of(votes)
    kept = np.unique(first)
    folded = votes[:, kept].copy()
    for j, i in enumerate(first):       # a copy speaks where the voter it copies is silent
        if i != j:
            at = np.searchsorted(kept, i)
            folded[:, at] = np.where(folded[:, at] < 0, votes[:, j], folded[:, at])
    post, theta, weight = _independent(folded, start, rounds)
    at = np.searchsorted(kept, first)
    return post, theta[:, at], weight[at] / np.bincount(at)[at]


def _independent(votes: np.ndarray, start: np.ndarray | None, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shown = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    n, m, _ = shown.shape
    weight = np.ones(m)
    theta = np.empty((2, m, 3))
    theta[0], theta[1], prior = (0.5, 0.4, 0.1), (0.5, 0.1, 0.4), 0.5
    post = np.full(n, prior)
    if start is not None and (known := ~np.isnan(start)).any():
        prior = float(np.clip(start[known].mean(), 0.01, 0.99))
        for k, p in enumerate((1 - start[known], start[known])):
            theta[k] = (np.einsum("n,nmv->mv", p, shown[known]) + 0.5) / (p.sum() + 1.5)
    for again in range(2):
        for _ in range(rounds):
            score = np.einsum("nmv,kmv,m->nk", shown, np.log(theta), weight)
            z = score[:, 1] - score[:, 0] + np.log(prior / (1 - prior))
            new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            moved, post = np.abs(new - post).max(), new
            prior = float(np.clip(post.mean(), 0.01, 0.99))
            for k, p in enumerate((1 - post, post)):
                theta[k] = (np.einsum("n,nmv->mv", p, shown) + 0.5) / (p.sum() + 1.5)
            if moved < 1e-6:
                break
        if not again:
            fired = shown[:, :, 2] - np.outer(1 - post, theta[0, :, 2]) - np.outer(post, theta[1, :, 2])
            spread = np.sqrt((fired ** 2).sum(axis=0)) + 1e-9
            together = np.clip((fired.T @ fired) / np.outer(spread, spread), 0, 1)
            np.fill_diagonal(together, 0)
            weight = 1 / (1 + np.where(together > 0.1, together, 0).sum(axis=1))
    return post, theta, weight


def train_linear(x: np.ndarray, p: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps."""
    design = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(design.shape[1])
    cost = np.full(len(w), ridge)
    cost[-1] = 1e-6
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design.T * (q * (1 - q) + 1e-6)) @ design + np.diag(cost), design.T @ (p - q) - cost * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text: str = "text",
        label: str = "toxic") -> Model:
    """The model of a table and its labels; what comes to the driver is bounded by `per_class` and `STEMS`."""
    rows = sample(docs, labels, per_class, id_col, text, label)
    sizes = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    mined = mine_stems(rows, sizes)
    model = Model(mined + [g for g in GENERAL if g not in set(mined)])
    if not mined:
        model.weights = np.full(len(model.stems), 3.0)
        model.intercept = -4.0
        return model
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            at, counts, extra = zip(*[shared.value.find(t) for t in batch.column("_t").to_pylist()])
            yield pa.RecordBatch.from_arrays([
                batch.column("_y"), pa.array(at, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float64())),
                pa.array(extra, pa.list_(pa.float64()))], names=["y", "at", "counts", "extra"])

    got = rows.mapInArrow(features, "y int, at array<int>, counts array<double>, extra array<double>").collect()
    got.sort(key=lambda r: (r["y"], r["at"], r["counts"], r["extra"]))          # 3 * per_class rows
    extra = np.array([r["extra"] for r in got])
    labels = np.array([r["y"] for r in got])
    posterior, _, _ = label_model(votes_of([r["at"] for r in got], extra, labels, len(model.stems)),
                                  np.where(labels < 0, np.nan, labels))
    x = np.zeros((len(got), len(model.stems)))
    for row, r in enumerate(got):
        x[row, r["at"]] = r["counts"]
    weights, model.intercept = train_linear(np.hstack([x, extra]), posterior)
    model.weights, model.extra = weights[:len(model.stems)], weights[len(model.stems):]
    return model


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with the score of every text as `name`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                got = pa.array([shared.value.score(t.as_py()) for t in part.column(text)], pa.float64())
                yield pa.RecordBatch.from_arrays([got if n == name else part.column(n) for n in part.schema.names],
                                                 names=part.schema.names)

    rows = docs.withColumn(name, F.lit(None).cast("double"))
    return rows.mapInArrow(run, rows.schema)
