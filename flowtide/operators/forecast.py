"""Forecasts of attack risk and stage for the next K windows.

Every forecaster returns the same columns: `future` (K risks), `lo`, `hi`, `now`,
`stage_future_probs` (K distributions over seven stages) and `stage_now`.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide import schema as S
from flowtide.cluster import materialise
from flowtide.functions.risk import logit
from flowtide.operators.sequences import draw

OUTPUT = "future array<double>, lo array<double>, hi array<double>, now double, " \
         "stage_future_probs array<array<double>>, stage_now int"


def persistence(frame: DataFrame, horizon: int = S.HORIZON_K, stage: str = "stage") -> DataFrame:
    """The attack state of now continues through the horizon."""
    now = (F.col(stage) > 0).cast("double")
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(S.N_STAGES - 1)),
                          lambda s: (s == F.col(stage)).cast("double"))
    flat = F.array_repeat(now, horizon)
    return frame.withColumns({"future": flat, "lo": flat, "hi": flat, "now": now,
                              "stage_future_probs": F.array_repeat(one_hot, horizon),
                              "stage_now": F.col(stage).cast("int")})


# ------------------------------------------------------------------ stage transitions
def transition_table(frame: DataFrame, alpha: float = 1.0, stage: str = "stage",
                     keys: Sequence[str] = ()) -> DataFrame:
    """First-order stage transitions with Laplace smoothing: 49 rows."""
    nxt = F.lead(stage).over(Window.partitionBy(*keys, "host", "segment").orderBy("window"))
    seen = (frame.select(F.col(stage).cast("int").alias("from_stage"), nxt.cast("int").alias("to_stage"))
            .filter("to_stage IS NOT NULL").groupBy("from_stage", "to_stage").agg(F.count("*").alias("n")))
    grid = frame.sparkSession.range(S.N_STAGES ** 2).select(
        F.floor(F.col("id") / S.N_STAGES).cast("int").alias("from_stage"),
        (F.col("id") % S.N_STAGES).cast("int").alias("to_stage"))
    full = grid.join(seen, ["from_stage", "to_stage"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("from_stage"))
    return full.withColumn("p", (F.col("n") + alpha) / (total + alpha * S.N_STAGES))


@dataclass(frozen=True)
class TransitionModel:
    """P(next stage | stage), rolled forward without looking at observations."""
    matrix: tuple[tuple[float, ...], ...]

    @classmethod
    def fit(cls, frame: DataFrame, alpha: float = 1.0, stage: str = "stage",
            keys: Sequence[str] = ()) -> "TransitionModel":
        cell = {(r["from_stage"], r["to_stage"]): r["p"]
                for r in transition_table(frame, alpha, stage, keys).collect()}  # always 49 rows
        n = range(S.N_STAGES)
        return cls(tuple(tuple(cell[i, j] for j in n) for i in n))

    def rollout(self, horizon: int = S.HORIZON_K) -> list[list[list[float]]]:
        """[start stage][step][stage] probabilities."""
        import numpy as np

        step = np.array(self.matrix)
        powers, cur = [], np.eye(S.N_STAGES)
        for _ in range(horizon):
            cur = cur @ step
            powers.append(cur)
        return [[p[s].tolist() for p in powers] for s in range(S.N_STAGES)]

    def forecast(self, frame: DataFrame, horizon: int = S.HORIZON_K, stage: str = "stage") -> DataFrame:
        rolled = self.rollout(horizon)
        table = F.array(*[F.array(*[F.array(*[F.lit(p) for p in dist]) for dist in start]) for start in rolled])
        risks = F.array(*[F.array(*[F.lit(sum(dist[1:])) for dist in start]) for start in rolled])
        at = F.col(stage).cast("int") + 1
        future = F.element_at(risks, at)
        return frame.withColumns({"future": future, "lo": future, "hi": future,
                                  "now": (F.col(stage) > 0).cast("double"),
                                  "stage_future_probs": F.element_at(table, at),
                                  "stage_now": F.col(stage).cast("int")})


def rollout_table(table: DataFrame, horizon: int = S.HORIZON_K) -> DataFrame:
    """The same rollout as joins of the 49-row table: start, step, stage, p."""
    step = table.select("from_stage", "to_stage", F.col("p").alias("q"))
    dist = table.select(F.col("from_stage").alias("start_stage"), F.col("to_stage").alias("at"), "p")
    rolled = dist.withColumn("step", F.lit(1))
    for k in range(2, horizon + 1):
        dist = (dist.join(F.broadcast(step), dist["at"] == step["from_stage"])
                .groupBy("start_stage", F.col("to_stage").alias("at"))
                .agg(F.sum(F.col("p") * F.col("q")).alias("p")))
        rolled = rolled.unionByName(dist.withColumn("step", F.lit(k)))
    return rolled.select("start_stage", "step", F.col("at").alias("stage"), "p")


# ------------------------------------------------------------------ logistic models
def flat_vector(history: str = "history") -> Column:
    return array_to_vector(F.flatten(history))


def balanced(df: DataFrame, label: str, weight: Column | None = None) -> tuple[DataFrame, float]:
    """Class weights n / (2 * n_class), times an optional row weight; returns their sum too."""
    df = df.withColumn("_w", F.lit(1.0) if weight is None else weight)
    r = df.agg(F.sum("_w").alias("n"), F.sum(F.when(F.col(label) > 0, F.col("_w"))).alias("p")).first()
    n, p = float(r["n"] or 0.0), float(r["p"] or 0.0)
    pos, neg = n / (2 * max(p, 1e-9)), n / (2 * max(n - p, 1e-9))
    return df.withColumn("_w", F.col("_w") * F.when(F.col(label) > 0, pos).otherwise(neg)), n


def fit_logistic(df: DataFrame, label: str, features: str = "x", c: float = 0.5, max_iter: int = 400,
                 weight: Column | None = None, balance: bool = True) -> LogisticRegressionModel:
    """L2 logistic regression with inverse strength `c` on the summed loss."""
    if balance:
        df, total = balanced(df, label, weight)
    else:
        df = df.withColumn("_w", F.lit(1.0) if weight is None else weight)
        total = float(df.agg(F.sum("_w")).first()[0])
    lr = LogisticRegression(featuresCol=features, labelCol="_y", weightCol="_w", maxIter=max_iter,
                            regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False)
    return lr.fit(df.withColumn("_y", F.col(label).cast("double")).select(features, "_y", "_w"))


def shifted(df: DataFrame, by: Sequence[float], history: str = "history", out: str = "x") -> DataFrame:
    """`df` with the flat vector less `by`. A model fitted on it has the same weights, and an intercept that is greater by
    their product with `by`. Where most rows of a history are `by`, the learner holds its vectors as sparse ones."""
    return df.withColumn(out, array_to_vector(F.zip_with(F.flatten(history), F.array(*[F.lit(float(v)) for v in by]), lambda v, c: v - c)))


def predict_logistic(model: LogisticRegressionModel, df: DataFrame, features: str = "x",
                     out: str = "score", shift: Sequence[float] | None = None) -> DataFrame:
    """Chance of the positive class. `shift`: what the vectors were `shifted` by when the model was fitted."""
    scored = model.setFeaturesCol(features).transform(df)
    chance = vector_to_array("probability")[1]
    if shift is not None:
        over = float(sum(w * v for w, v in zip(model.coefficients, shift)))
        chance = 1 / (1 + F.exp(-(vector_to_array("rawPrediction")[1] - F.lit(over))))
    return (scored.withColumn(out, chance)
            .drop("rawPrediction", "probability", "prediction"))


@dataclass
class HorizonModel:
    """One binary model per step ahead, one for now, one over attack stages, and a bag of
    resampled per-step models for the 10-90 % band."""
    now: LogisticRegressionModel
    steps: list[LogisticRegressionModel]
    stages: LogisticRegressionModel | None
    bags: list[list[LogisticRegressionModel]] = field(default_factory=list)

    @classmethod
    def fit(cls, rows: DataFrame, horizon: int = S.HORIZON_K, bags: int = 0, max_iter: int = 50,
            seed: int = 7, stage: str = "stage", identity: Sequence[str] = ("host", "window"),
            keys: Sequence[str] = ()) -> "HorizonModel":
        """`rows` carry vector `x` and the stage; targets are the stages of later rows."""
        order = Window.partitionBy(*keys, "host", "segment").orderBy("window")
        ahead = {f"_s{k}": F.lead(stage, k).over(order) for k in range(1, horizon + 1)}
        data = rows.withColumns(ahead).filter(F.col(f"_s{horizon}").isNotNull())
        data = data.withColumns({f"_y{k}": (F.col(f"_s{k}") > 0).cast("int") for k in range(1, horizon + 1)})
        coming = F.array(*[F.col(f"_s{k}") for k in range(1, horizon + 1)], F.col(stage))
        nearest = F.coalesce(F.get(F.filter(coming, lambda s: s > 0), F.lit(0)), F.lit(0)).cast("int")
        data = materialise(data.withColumns({"_y0": (F.col(stage) > 0).cast("int"), "_stage": nearest})
                           .select("x", "_stage", *[f"_y{k}" for k in range(horizon + 1)], *identity))
        models = [fit_logistic(data, f"_y{k}", max_iter=max_iter) for k in range(horizon + 1)]
        attacks = data.filter(F.col("_stage") > 0).withColumn("_c", (F.col("_stage") - 1).cast("double"))
        stages = None
        if attacks.select("_c").distinct().limit(2).count() == 2:
            stages = LogisticRegression(featuresCol="x", labelCol="_c", family="multinomial",
                                        maxIter=max_iter, regParam=1e-3).fit(attacks.select("x", "_c"))
        bagged = []
        for b in range(bags):
            times = F.floor(draw(seed + b, "bag", *identity) * 3).cast("double")   # 0, 1 or 2 copies
            sample = data.withColumn("_times", times).filter("_times > 0")
            bagged.append([fit_logistic(sample, f"_y{k}", max_iter=max_iter, weight=F.col("_times"))
                           for k in range(1, horizon + 1)])
        return cls(models[0], models[1:], stages, bagged)

    def forecast(self, df: DataFrame) -> DataFrame:
        """Add the forecast columns to rows that carry `x`."""
        k = len(self.steps)
        df = predict_logistic(self.now, df, out="now")
        for i, m in enumerate(self.steps):
            df = predict_logistic(m, df, out=f"_f{i}")
        future = F.array(*[F.col(f"_f{i}") for i in range(k)])
        for b, group in enumerate(self.bags):
            for i, m in enumerate(group):
                df = predict_logistic(m, df, out=f"_b{b}_{i}")

        def band(i: int, p: float) -> Column:
            vals = F.array_sort(F.array(F.col(f"_f{i}"), *[F.col(f"_b{b}_{i}") for b in range(len(self.bags))]))
            at = p * len(self.bags)
            lo = int(at)
            hi = min(lo + 1, len(self.bags))
            return F.get(vals, F.lit(lo)) + (F.get(vals, F.lit(hi)) - F.get(vals, F.lit(lo))) * (at - lo)

        if self.stages is not None:
            df = self.stages.transform(df).withColumn("_p", vector_to_array("probability")).drop(
                "rawPrediction", "probability", "prediction")
            short = S.N_STAGES - 1 - self.stages.numClasses
            share = F.concat("_p", F.array_repeat(F.lit(0.0), short)) if short > 0 else F.col("_p")
        else:
            share = F.array_repeat(F.lit(1.0 / (S.N_STAGES - 1)), S.N_STAGES - 1)
        probs = F.transform(F.col("future"), lambda r: F.concat(
            F.array(1 - r), F.transform(F.col("_share"), lambda q: q * r)))
        best = F.array_position("_share", F.array_max("_share")).cast("int")
        out = df.withColumns({"future": future, "_share": share,
                              "lo": F.array(*[band(i, 0.1) for i in range(k)]),
                              "hi": F.array(*[band(i, 0.9) for i in range(k)])})
        out = out.withColumns({"stage_future_probs": probs,
                               "stage_now": F.when(F.col("now") >= 0.5, best).otherwise(F.lit(0))})
        return out.drop("_share", "_p", *[f"_f{i}" for i in range(k)],
                        *[f"_b{b}_{i}" for b in range(len(self.bags)) for i in range(k)])


# ------------------------------------------------------------------ user models
def score_histories(df: DataFrame, predict: Callable, history: str = "history",
                    output: str = OUTPUT) -> DataFrame:
    """Run a user's batch model over histories.

    `predict` receives one float array [n, L, F] per Arrow batch and returns a dict with
    one entry of length n per output column.
    """
    names = [p.strip().split()[0] for p in _split_fields(output)]

    def run(batches):
        import numpy as np

        for pdf in batches:
            x = np.array([[list(v) for v in h] for h in pdf[history]], dtype="float64")
            got = predict(x) if len(pdf) else {n: [] for n in names}
            yield pdf.assign(**{n: list(got[n]) for n in names})

    from pyspark.sql.types import StructType, _parse_datatype_string

    fields = StructType(list(df.schema.fields) + list(_parse_datatype_string(output).fields))
    return df.mapInPandas(run, fields)


def _split_fields(ddl: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return out + [cur]


def fit_calibration(df: DataFrame, y: str, score: str, c: float = 1e3) -> tuple[float, float]:
    """Platt parameters (a, b) from validation rows: logistic regression on logit(score)."""
    data = df.select(F.col(y).alias("_t"), array_to_vector(F.array(logit(F.col(score)))).alias("x"))
    m = fit_logistic(data, "_t", c=c, max_iter=1000, balance=False)
    return float(m.coefficients[0]), float(m.intercept)
