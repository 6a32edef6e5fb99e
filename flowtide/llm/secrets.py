"""Secret scan through an incremental ledger of content-addressed blobs.

Every version of a file is a row (path, text). Its blob is the SHA-256 of the text. The ledger records which
(blob, rule version) pairs have been scanned and what was found, so a run reads only the pairs that are new: a text
that stands at a thousand paths or returns in a later snapshot is scanned once, and a changed rule scans the old
blobs for that rule alone. Findings are then joined back to all paths.

Defined results: a null text is an empty text; repeated rows and equal texts share one blob and each row gets the
blob's findings; an empty table gives no rows; other columns of the versions are kept, but for those named blob or
findings, which the results replace.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost non-overlapping matches of `pattern` whose `group` has `least` characters."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: str = "1"

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Patterns and lengths of the three base kinds. A run of at least n characters of one class is matched
#: with {n,}, which drops the same runs as a length test would.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Published formats of further credentials.
FURTHER = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

LEDGER = ("blob string, versions array<string>, "
          "findings array<struct<kind:string, version:string, start:bigint, end:bigint>>")


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _pieces(text: Column, rule: Rule, wanted: Column) -> Column:
    """For each match: the length of the text before it since the last match, its own, and whether it counts."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("hit"), group.alias("part"))
    found = F.transform(zipped, lambda x: F.struct(
        F.lit(rule.kind).alias("kind"), F.lit(rule.key).alias("version"), F.length(x["gap"]).cast("long").alias("gap"),
        F.length(x["hit"]).cast("long").alias("size"),
        (F.length(x["part"]) >= rule.least).alias("counts")))
    found = F.filter(found, lambda x: x["size"].isNotNull())      # the text after the last match has none
    return F.when(wanted & text.rlike(rule.pattern), found)


def read_ledger(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The ledger's batches, or None where there are none yet."""
    if path is None:
        return None
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return None
        raise


def unseen(versions: DataFrame, rules: Sequence[Rule], ledger: DataFrame | None, text: str = "text") -> DataFrame:
    """One row for each blob that has rule versions yet to be scanned: blob, _s_text, missing."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    content = F.coalesce(F.col(text), F.lit(""))
    blobs = (versions.select(blob_id(F.col(text)).alias("blob"), content.alias("_s_text"))
             .groupBy("blob").agg(F.first("_s_text").alias("_s_text")))
    if ledger is None:
        return blobs.withColumn("missing", keys)
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("versions")).alias("_s_seen"))
    return (blobs.join(seen, "blob", "left")
            .withColumn("missing", F.array_except(keys, F.coalesce("_s_seen", F.array().cast("array<string>"))))
            .drop("_s_seen").filter(F.size("missing") > 0))


def scan(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Ledger rows of blobs with their text in `_s_text` and their open rule versions in `missing`.

    Positions count code points. They come from one running sum over the matches of a blob, in the partition the
    blobs already have, so a text of a million matches costs a sort and no more.
    """
    text = F.col("_s_text")
    found = F.concat(*[F.coalesce(_pieces(text, r, F.array_contains("missing", r.key)), F.array().cast(
        "array<struct<kind:string,version:string,gap:bigint,size:bigint,counts:boolean>>")) for r in rules])
    hits = blobs.select("blob", "missing", F.posexplode_outer(found).alias("_s_at", "_s_hit"))
    past = Window.partitionBy("blob", "_s_hit.version").orderBy("_s_at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("_s_hit.gap") + F.col("_s_hit.size")).over(past)
    placed = hits.withColumn("_s_end", end)
    spot = F.struct(F.col("_s_hit.kind").alias("kind"), F.col("_s_hit.version").alias("version"),
                    (F.col("_s_end") - F.col("_s_hit.size")).alias("start"), F.col("_s_end").alias("end"))
    return placed.groupBy("blob").agg(
        F.first("missing").alias("versions"),
        F.collect_list(F.when(F.col("_s_hit.counts"), spot)).alias("findings"))


def scan_versions(versions: DataFrame, ledger_path: str, rules: Sequence[Rule] = BASE + FURTHER,
                  text: str = "text") -> DataFrame:
    """Scan what the ledger lacks, append it there, and return `versions` without the text, with `blob` and `findings`
    (sorted by start, then by the rules' order) at every path.

    The append is one Parquet write, which shows all its rows or none; a run that is lost before it is repeated.
    """
    spark = versions.sparkSession
    scan(unseen(versions, rules, read_ledger(spark, ledger_path), text), rules).write.mode("append").parquet(ledger_path)
    rank = {r.kind: i for i, r in enumerate(rules)}
    now = [r.key for r in rules]
    one = (read_ledger(spark, ledger_path).select("blob", F.explode("findings").alias("f"))
           .filter(F.col("f.version").isin(now))
           .select("blob", F.struct(F.col("f.start").alias("start"), _rank(F.col("f.kind"), rank).alias("rank"),
                                    F.col("f.kind").alias("kind"), F.col("f.end").alias("end")).alias("f"))
           .groupBy("blob").agg(F.array_sort(F.collect_list("f")).alias("findings")))
    return (versions.drop("blob", "findings").withColumn("blob", blob_id(F.col(text))).drop(text).join(one, "blob", "left")
            .withColumn("findings", F.coalesce("findings", F.array().cast(one.schema["findings"].dataType))))


def _rank(kind: Column, rank: dict[str, int]) -> Column:
    out = F.lit(len(rank))
    for k, i in rank.items():
        out = F.when(kind == k, i).otherwise(out)
    return out


def written(findings: Column) -> Column:
    """kind:start:end of all findings, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
