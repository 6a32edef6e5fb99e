"""One-permutation MinHash fingerprints of word shingles, in DataFrame expressions only.

Each shingle (five words in lower case; the whole sequence where there are fewer; one fixed shingle for a text without
words) is hashed once. The high bits of the hash choose one of 128 bins, and a bin keeps the least hash it gets. An
empty bin takes the value of the first filled bin in a random order of its own, which is the optimal densification:
the order is the same for all texts, every filled bin is equally likely, and the donors of two empty bins are
independent. The low 8 bits of each bin are packed into 16 longs, written as 256 hexadecimal digits.

Likeness is the share of equal bins, corrected for bins that agree by chance: (share - c) / (1 - c), c = 2^-8, not
below 0.

Defined results: a null text is an empty text; equal texts have equal fingerprints; two texts without words are alike
(1.0); an empty table gives no rows; other columns are not carried.
"""
from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window, functions as F

BINS, BITS, WIDTH = 128, 8, 5
_BIN_BITS = BINS.bit_length() - 1
_TRIES = 12


def _orders(bins: int = BINS) -> list[list[int]]:
    """For each bin a random order of all bins, by rule from a fixed seed."""
    rnd = random.Random(20170701)
    out = []
    for _ in range(bins):
        order = list(range(bins))
        rnd.shuffle(order)
        out.append(order)
    return out


ORDERS = _orders()


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _longs(values: list[list[int]]) -> str:
    return "array(" + ",".join("array(" + ",".join(map(str, v)) + ")" for v in values) + ")"


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add `name`: the packed fingerprint of column `text` as 16 longs. Each step is a column of its own, so that no
    lambda repeats the work of another."""
    w, s, m, b, d = (f"_f_{name}_{k}" for k in "wsmbd")
    df = df.withColumn(w, F.transform(words_of(F.col(text)), lambda x: F.xxhash64(x)))
    n = F.size(w)
    shingle = F.transform(
        F.sequence(F.lit(0), F.greatest(n - WIDTH, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(WIDTH)]))
    df = df.withColumn(s, F.sort_array(shingle)).drop(w)
    # the first hash of a bin in ascending order is its least one
    part = lambda x: F.shiftright(x, 64 - _BIN_BITS)
    least = F.filter(F.col(s), lambda x, i: (i == 0) | (part(x) != part(F.get(F.col(s), i - 1))))
    df = df.withColumn(m, least).drop(s)
    bins = F.map_from_arrays(F.transform(m, lambda x: (part(x) + BINS // 2).cast("int")), F.col(m))
    df = df.withColumn(m, bins)
    df = df.withColumn(b, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.col(m)[i]))
    donors = F.expr(_longs([o[:_TRIES] for o in ORDERS]))
    ranks = F.expr(_longs([[o.index(f) for f in range(BINS)] for o in ORDERS]))

    def filled(x: Column, i: Column) -> Column:
        near = [F.get(F.col(b), F.get(F.get(donors, i), F.lit(t))) for t in range(_TRIES)]
        far = F.array_min(F.transform(F.map_entries(m), lambda e: F.struct(
            F.get(F.get(ranks, i), e["key"]).alias("rank"), e["value"].alias("value"))))["value"]
        return F.coalesce(x, *near, far)

    df = df.withColumn(d, F.transform(b, filled)).drop(b, m)
    per = 64 // BITS

    def packed(i: Column) -> Column:
        out = F.lit(0).cast("long")
        for k in range(per):
            out = out.bitwiseOR(F.shiftleft(F.get(F.col(d), i * per + k).bitwiseAND(2 ** BITS - 1), BITS * k))
        return out

    return df.withColumn(name, F.transform(F.sequence(F.lit(0), F.lit(BINS // per - 1)), packed)).drop(d)


def written(fingerprint: Column) -> Column:
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles of two packed fingerprints."""
    def differing(x: Column) -> Column:       # bytes of x that are not zero
        for by, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by)).bitwiseAND(F.lit(mask))
        return F.bit_count(x)

    off = F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    chance = 2.0 ** -BITS
    return F.greatest(F.lit(0.0), ((1 - off / BINS) - chance) / (1 - chance))


# --- a text beside the one of the next document -----------------------------------------------------------------------

BUCKET_ROWS, MOST_CELLS = 500, 100_000


def _neighbours(rows: DataFrame) -> DataFrame:
    """Add `_b`, a bucket of neighbours in descending `_k` and, of rows with one `_k`, ascending `_h`; and `_guest`, true
    for a copy of a bucket's first row that stands at the end of the bucket above (of the very first, of the lowest).

    Ids fall into at most MOST_CELLS cells of equal width; a cell with too many ids is cut at its quantiles, and an id
    with too many rows has buckets of its own, cut by the hash. The cells, their frequent ids and the buckets that are
    broadcast are bounded by that number, and no text moves here.
    """
    ids = rows.select("_k", "_h")
    n, low, high = ids.agg(F.count("*"), F.min("_k"), F.max("_k")).first()
    each = max(BUCKET_ROWS, -(-n // MOST_CELLS))
    width = max(1, ((high or 0) - (low or 0)) * each // max(n, 1))
    cell = F.expr(f"(_k - ({low or 0}L)) div {width}L")
    parts = 64
    often = (ids.groupBy("_k").agg(F.count("*").alias("_n")).filter(F.col("_n") > 2 * each).groupBy(cell.alias("_c"))
             .agg(F.sort_array(F.collect_list(F.struct(F.col("_k").alias("k"), F.ceil(F.col("_n") / each).alias("cuts"))))
                  .alias("_often")))            # at most n / (2 * each) in all
    cells = (ids.groupBy(cell.alias("_c")).agg(F.count("*").alias("_n"), F.percentile_approx(
        "_k", [i / parts for i in range(1, parts)], 1000).alias("_q"))
        .select("_c", F.when(F.col("_n") > 2 * each, F.array_distinct("_q")).otherwise(
            F.array().cast("array<bigint>")).alias("_q")).join(often, "_c", "left"))

    def placed(df: DataFrame) -> DataFrame:
        cut = F.size(F.filter("_q", lambda q: q <= F.col("_k")))
        below = F.size(F.filter("_often", lambda o: o["k"] < F.col("_k")))
        own = F.get(F.filter("_often", lambda o: o["k"] == F.col("_k")), F.lit(0))["cuts"]
        share = F.col("_h") / 2.0 ** 64 + 0.5   # of the hashes below; a higher bucket comes first
        bucket = F.struct((F.col("_c") * (parts + 1) + cut).alias("at"),
                          F.when(F.col("_often").isNull(), 0).otherwise(2 * below + F.when(own.isNull(), 0).otherwise(1)).alias("id"),
                          F.coalesce(-F.least(F.floor(share * own), own - 1), F.lit(0).cast("long")).alias("hash"))
        return df.withColumn("_c", cell).join(F.broadcast(cells), "_c").withColumn("_b", bucket).drop("_c", "_q", "_often")

    def order(k: str, h: str) -> Column:        # the first row has the greatest
        return F.struct(F.col(k).alias("k"), F.bitwise_not(F.col(h)).alias("h"))

    ring = Window.orderBy("_b")
    around = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = placed(ids).groupBy("_b").agg(F.max(order("_k", "_h")).alias("_top")).select(
        "_b", "_top", F.coalesce(F.lead("_b").over(ring), F.min("_b").over(around)).alias("_above"))
    host, guest = (F.struct(F.col(b).alias("b"), F.lit(g).alias("guest")) for b, g in (("_b", False), ("_above", True)))
    return (placed(rows).join(F.broadcast(tops), "_b")
            .withColumn("_to", F.explode(F.when(order("_k", "_h") == F.col("_top"), F.array(host, guest)).otherwise(F.array(host))))
            .select(*rows.columns, F.col("_to.b").alias("_b"), F.col("_to.guest").alias("_guest")))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's id, n_chars, edited text's SHA-256, and the packed fingerprints `own`, `edited` and `next`.

    The edited text has the last floor(n / 2) code points replaced by the first as many, or all, of the next document
    in descending id order; after the last comes the first. A null id is the lowest; rows of equal ids are ordered by
    the hash of their texts, and rows of one id and one text, which may stand in any order, share a bucket. Each text
    moves once, to the bucket of its id.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    least = docs.agg(F.min(id_col)).first()[0]
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col), F.lit((least or 0) - 1)).cast("long").alias("_k"),
                       content.alias("_text"), F.xxhash64(content).alias("_h"))
    beside = Window.partitionBy("_b").orderBy("_guest", F.col("_k").desc(), "_h")
    half = F.expr("length(_text) div 2")
    both = (_neighbours(rows).withColumn("_next", F.coalesce(F.lead("_text").over(beside), F.lit("")))
            .withColumn("_edited", F.concat(F.substring(F.col("_text"), F.lit(1), F.length("_text") - half),
                                            F.substring(F.col("_next"), F.lit(1), half)))
            .withColumn("n_chars", F.length("_text").cast("long"))
            .withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256)).drop("_next"))
    both = with_fingerprint(with_fingerprint(both, "_text", "own").drop("_text"), "_edited", "edited").drop("_edited")
    return (both.withColumn("next", F.lead("own").over(beside)).filter(~F.col("_guest"))
            .select(F.col("_id").alias(id_col), "n_chars", "edited_sha256", "own", "edited", "next"))
