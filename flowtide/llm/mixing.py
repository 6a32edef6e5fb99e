"""Mixing documents to target weights by iterative proportional fitting.

Tokens are summed by (source, language, topic) cell; only that table is raked: each sweep scales the cells so that
the sums over each attribute meet its targets, until all targets hold. Targets that the occurring cells cannot meet
together (a source that is all of a language has that language's share) are met as nearly as a fixed pull allows
against the table of flattened shares: a convex problem with one solution, in which no cell's weight is zero.

A document is kept with the chance that its cell's weight has against its tokens. The chances are scaled to the token
budget: what the targets allow without repeating a document, and `KEEP` of all tokens at least. Where a rare cell would
allow less, its chance is held at 1 and what it lacks is drawn from the other cells by their weights, so the rarest
value does not decide how much of the corpus is kept. Without such cells the expected tokens meet the targets.

The chance is compared with a hash of the document's id, so a draw does not depend on partitioning and can be
repeated.

Defined results: a null attribute is the value "unknown"; a null text has no tokens; every document counts at least
one token, so that empty ones can be drawn too; rows that repeat an id are drawn alike; targets of values that do not
occur are left out and the rest are scaled to one; an empty table gives no rows; a table that does not settle raises.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide.cluster import materialise

MARGINS = ("source", "lang", "topic")
SWEEPS, TOLERANCE = 30, 1e-9

#: The least share of the tokens to keep; the weight of targets that cannot hold together, the sweeps
#: between two looks at them, the change of a weight at which they rest, and the sweeps after which that is an error.
KEEP = 0.4
PULL, ROUND, REST, MOST_SWEEPS = 9.0, 5, 1e-7, 1000

#: Words of a text that tell its topic, the first that fits.
TOPICS = (
    ("legal", r"(?i)licen[sc]ed? under|all rights reserved|released under the"),
    ("credentials", r"(?i)(?:password|token|secret|api_?key)\s*[:=]|AKIA[A-Z0-9]{16}"),
    ("contact", r"[A-Za-z0-9._]+@[A-Za-z0-9-]+\.[a-z]{2,}"),
)


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    """White-space separated words, and one more."""
    return (F.regexp_count(text, F.lit(r"\S+")) + 1).cast("long")


def flattened(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Targets that draw the shares of a margin together: each share to `power`, scaled to one."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("_t"))
    every = Window.partitionBy(F.lit(0))
    raised = F.pow(F.col("_t").cast("double"), F.lit(power))
    return sums.select(margin, (raised / F.sum(raised).over(every)).alias("target"))


def _sums(margin: str) -> Column:
    return F.sum("weight").over(Window.partitionBy(margin))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """`cells` (one row a cell, with tokens) with `weight`, whose shares by each margin are the targets.

    Each sweep is stored and starts from the last; the loop ends when no margin is off by more than `tolerance`. If
    that is not within `sweeps`, the targets are taken not to hold together and `_compromise` gives the weights.
    """
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    now = cells.withColumn("weight", F.col("tokens") / total)
    for m, t in targets.items():
        now = now.join(t.withColumnRenamed("target", f"_to_{m}"), m)
    begin = now = materialise(now)
    to = [f"_to_{m}" for m in targets]
    for _ in range(sweeps):
        step = now
        for m in targets:
            step = step.withColumn("weight", F.col("weight") * F.col(f"_to_{m}") / _sums(m))
        for m in targets:                       # what the later margins did to the earlier ones
            step = step.withColumn(f"_off_{m}", F.abs(F.col(f"_to_{m}") / _sums(m) - 1))
        off = F.greatest(*[F.col(f"_off_{m}") for m in targets], F.lit(0.0))
        step = materialise(step.withColumn("_off", off).drop(*[f"_off_{m}" for m in targets]))
        worst = step.agg(F.max("_off")).first()[0]
        now = step.drop("_off")
        if worst is None or worst <= tolerance:
            return now.drop(*to)
    return _compromise(begin, list(targets)).drop(*to)


def _compromise(cells: DataFrame, margins: list[str]) -> DataFrame:
    """The weights of least relative entropy to the flattened table plus PULL times that of each margin to its target.

    The flattened table has each cell's tokens times target / share of its values. Each margin's factor is raised to
    PULL / (PULL + 1) (scaling with soft margins), which comes to rest whatever the targets are.
    """
    power = PULL / (PULL + 1)
    first = F.col("weight")
    for m in margins:
        first = first * F.col(f"_to_{m}") / F.col(f"_own_{m}")
    now = cells
    for m in margins:
        now = now.withColumn(f"_own_{m}", _sums(m))
    now = now.withColumn("weight", first).drop(*[f"_own_{m}" for m in margins])
    now = materialise(now.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(0))))
                      .withColumns({f"_f_{m}": F.lit(0.0) for m in margins}))
    for _ in range(0, MOST_SWEEPS, ROUND):
        step = now
        for k in range(ROUND):
            if k == ROUND - 1:
                step = step.withColumn("_last", F.col("weight"))
            for m in margins:                   # _f_: the logarithm of the margin's factor so far
                step = step.withColumn("_new", power * (F.log(F.col(f"_to_{m}") / _sums(m)) + F.col(f"_f_{m}")))
                step = step.withColumn("weight", F.col("weight") * F.exp(F.col("_new") - F.col(f"_f_{m}")))
                step = step.withColumn(f"_f_{m}", F.col("_new"))
        step = materialise(step.withColumn("_off", F.abs(F.col("weight") / F.col("_last") - 1)).drop("_new", "_last"))
        worst = step.agg(F.max("_off")).first()[0]
        now = step.drop("_off")
        if worst <= REST:
            return now.drop(*[f"_f_{m}" for m in margins])
    raise RuntimeError(f"the cells' weights still change by {worst} after {MOST_SWEEPS} sweeps")


def chances(raked: DataFrame, keep: float = KEEP) -> DataFrame:
    """`raked` with `probability`: the weight against the tokens, scaled so that the greatest is 1 or, if less than
    `keep` of the tokens would be expected then, so that those are, no chance being over 1."""
    if not 0 <= keep < 1:
        raise ValueError("keep is a share of the tokens below 1")
    rate = F.col("weight") / F.col("tokens")
    t, w, top = raked.agg(F.sum("tokens"), F.sum("weight"), F.max(rate)).first()
    scale = 1 / top if top else 0.0
    if t and w * scale < keep * t:
        scale, held = keep * t / w, -1
        while True:                             # the cells at 1 only become more
            n, full, rest = raked.agg(F.count_if(rate * scale >= 1), F.sum(F.when(rate * scale >= 1, F.col("tokens"))),
                                      F.sum(F.when(rate * scale < 1, F.col("weight")))).first()
            if n == held or not rest:
                break
            held, scale = n, (keep * t - (full or 0)) / rest
    return raked.withColumn("probability", F.round(F.least(rate * scale, F.lit(1.0)), 9))


def chance(id_col: Column, seed: str, text: Column | None = None) -> Column:
    """A number in [0, 1) by the id: the first 8 hexadecimal digits of a digest. Rows without an id go by their text."""
    name = id_col.cast("string")
    name = name if text is None else F.coalesce(name, F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), name).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(2.0 ** 32)


def _attributes(docs: DataFrame, text: str, topic: Column | None) -> dict[str, Column]:
    content = F.coalesce(F.col(text), F.lit(""))
    return {"source": F.coalesce("source", F.lit("unknown")), "lang": F.coalesce("lang", F.lit("unknown")),
            "topic": topic_of(content) if topic is None else F.coalesce(topic, F.lit("unknown")),
            "n_tokens": tokens_of(content)}


def _rates(rows: DataFrame, power: dict[str, float], keep: float) -> DataFrame:
    """source, lang, topic and probability of every cell."""
    cells = materialise(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    raked = rake(cells, {m: flattened(cells, m, p) for m, p in power.items()})
    return materialise(chances(raked, keep).select(*MARGINS, "probability"))


def calibrate(docs: DataFrame, power: dict[str, float], id_col: str = "doc_id", text: str = "text",
              topic: Column | None = None, seed: str = "mix", keep: float = KEEP) -> DataFrame:
    """Id, source, lang, topic, n_tokens, probability and kept of every document."""
    rows = materialise(docs.select(F.col(id_col), *[c.alias(n) for n, c in _attributes(docs, text, topic).items()],
                                   chance(F.col(id_col), seed, F.col(text)).alias("_chance")))
    return (rows.join(_rates(rows, power, keep), list(MARGINS)).withColumn("kept", F.col("_chance") < F.col("probability"))
            .select(id_col, *MARGINS, "n_tokens", "probability", "kept"))


def draw(docs: DataFrame, power: dict[str, float], id_col: str = "doc_id", text: str = "text",
         topic: Column | None = None, seed: str = "mix", keep: float = KEEP) -> DataFrame:
    """The rows of `docs` that `calibrate` keeps, each judged by itself."""
    own = _attributes(docs, text, topic)
    rates = _rates(docs.select(*[c.alias(n) for n, c in own.items()]), power, keep)
    rates = rates.select(*[F.col(c).alias(f"_mix_{c}") for c in rates.columns])
    rows = docs.withColumns({f"_own_{m}": own[m] for m in MARGINS})
    on = [F.col(f"_own_{m}") == F.col(f"_mix_{m}") for m in MARGINS]
    return (rows.join(rates, on).filter(chance(F.col(id_col), seed, F.col(text)) < F.col("_mix_probability"))
            .select(*docs.columns))


#: Production parameters: the shares of sources, languages and topics are drawn together by these powers.
POWER = {"source": 0.7, "lang": 0.8, "topic": 0.9}
