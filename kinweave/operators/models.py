"""Scoring models on features, out-of-fold scores, stacking, and isotonic calibration, with Spark's own learners."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.config import DEFAULTS
from kinweave.operators import pairs as pairing
from kinweave.operators.features import NAMES


#: Rows of a partition that models are fitted on, where there are more of them than cores.
ROWS = 200_000


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and NaN become 0, infinities 1 and 0."""
    inf = float("inf")
    return df.withColumns({c: F.when(F.col(c) == inf, 1.0).when(F.col(c) == -inf, 0.0).otherwise(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))) for c in columns})


def learner(kind: str, seed: int = DEFAULTS.seed, rounds: int = 20):
    if kind == "gbt":
        return GBTClassifier(maxIter=rounds, stepSize=0.1, maxDepth=5, seed=seed, featuresCol="x", labelCol="label")
    if kind == "forest":
        return RandomForestClassifier(numTrees=2 * rounds, maxDepth=8, seed=seed, featuresCol="x", labelCol="label")
    if kind == "logistic":
        return LogisticRegression(maxIter=50, regParam=1e-3, featuresCol="x", labelCol="label")
    raise ValueError(f"unknown learner {kind}")


def assembler(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol="raw")


def steps(kind: str, rounds: int) -> list:
    return [StandardScaler(inputCol="raw", outputCol="x", withMean=True), learner(kind, rounds=rounds)]


def fit(df: DataFrame, columns: list[str] = NAMES, kind: str = "gbt", rounds: int = 20) -> PipelineModel:
    return Pipeline(stages=[assembler(columns), *steps(kind, rounds)]).fit(finite(df, columns))


def score(model: PipelineModel, df: DataFrame, columns: list[str] = NAMES, out: str = "prob") -> DataFrame:
    """df with the model's probability of a match."""
    scored = model.transform(finite(df, columns)).withColumn("__p", vector_to_array("probability")[1])
    return scored.select(*[c for c in df.columns if c != out], F.col("__p").alias(out))


def out_of_fold(df: DataFrame, columns: list[str] = NAMES, kind: str = "gbt", n: int = DEFAULTS.folds, rounds: int = 20, out: str = "oof_prob") -> tuple[DataFrame, list[PipelineModel]]:
    """Each row scored by the model of the other folds; all pairs of a reference are in one fold.

    A row's features become a vector once, which stays held for the folds and the scores. A fit runs a hundred small jobs,
    so the folds' fits run side by side, over no more partitions than cores or ROWS ask for.
    """
    others = [c for c in df.columns if c not in columns and c != out]
    vectors = assembler(columns)
    held = vectors.transform(finite(pairing.folds(df, n), columns)).select(*others, "fold", "raw").persist()
    rows = held.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-held.count() // ROWS))).select("label", "fold", "raw")
    with ThreadPool(n) as pool:
        fits = [inheritable_thread_target(df.sparkSession)(partial(Pipeline(stages=steps(kind, rounds)).fit, rows.where(F.col("fold") != k).drop("fold"))) for k in range(n)]
        fitted = pool.map(lambda f: f(), fits, 1)
    values, parts = vector_to_array("raw"), []
    names = [c for c in df.columns if c != out]
    for k, model in enumerate(fitted):
        scored = model.transform(held.where(F.col("fold") == k)).withColumn("__p", vector_to_array("probability")[1])
        parts.append(scored.select(*[values[columns.index(c)].alias(c) if c in columns else F.col(c) for c in names], F.col("__p").alias(out)))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    return scored, [PipelineModel([vectors, *model.stages]) for model in fitted]


def importances(models: list[PipelineModel], columns: list[str] = NAMES, n: int | None = None) -> list[tuple[str, float]]:
    """Mean importances over the folds' models, largest first."""
    total = [sum(float(m.stages[-1].featureImportances[i]) for m in models) / len(models) for i in range(len(columns))]
    return sorted(zip(columns, total, strict=True), key=lambda x: (-x[1], x[0]))[:n]


@dataclass
class Stack:
    """Base models of each fold, averaged, under a logistic model of their standardised scores."""

    bases: dict[str, list[PipelineModel]]
    meta: PipelineModel
    columns: list[str]

    def score(self, df: DataFrame, out: str = "prob") -> DataFrame:
        names = []
        for kind, models in self.bases.items():
            for i, m in enumerate(models):
                df = score(m, df, self.columns, f"__{kind}_{i}")
            parts = [F.col(f"__{kind}_{i}") for i in range(len(models))]
            df = df.withColumn(f"base_{kind}", sum(parts[1:], parts[0]) / len(parts)).drop(*[f"__{kind}_{i}" for i in range(len(models))])
            names.append(f"base_{kind}")
        return score(self.meta, df, names, out).drop(*names)


def fit_stack(df: DataFrame, columns: list[str] = NAMES, kinds=("gbt", "forest", "logistic"), n: int = DEFAULTS.folds, rounds: int = 20) -> tuple[Stack, DataFrame]:
    """A stack and the rows with their out-of-fold probabilities; the meta model's are out of fold as well."""
    bases, names = {}, []
    for kind in kinds:
        df, bases[kind] = out_of_fold(df, columns, kind, n, rounds, f"base_{kind}")
        names.append(f"base_{kind}")
    meta = fit(df, names, "logistic")
    scored, _ = out_of_fold(df, names, "logistic", n)
    return Stack(bases, meta, columns), scored.drop(*names)


def by_score(df: DataFrame, prob: str = "prob") -> DataFrame:
    """A row for each distinct score: its mean label, and as weight how many rows have it."""
    return df.groupBy(F.col(prob).cast("double").alias(prob)).agg(F.avg(F.col("label").cast("double")).alias("label"), F.count("*").cast("double").alias("weight"))


def fit_isotonic(df: DataFrame, prob: str = "prob", counted: bool = False) -> IsotonicRegressionModel:
    """The fit of df or, counted, of its by_score, which is the same: rows of one score share their fitted value. Only distinct scores are sorted."""
    rows = df if counted else by_score(df, prob)
    return IsotonicRegression(featuresCol=prob, labelCol="label", weightCol="weight").fit(rows.select(prob, "label", "weight"))


def knots(model: IsotonicRegressionModel) -> list[tuple[float, float]]:
    return list(zip(map(float, model.boundaries), map(float, model.predictions), strict=True))


def apply_knots(p: Column, points: list[tuple[float, float]]) -> Column:
    """Linear interpolation between knots, constant beyond the first and the last."""
    if not points:
        return p
    out = F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        line = F.lit(y0) if x1 == x0 else F.lit(y0) + (p - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0))
        out = F.when(p < x1, line).otherwise(out)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(p <= points[0][0], points[0][1]).otherwise(out)))


def apply_knots_joined(p: Column, points: list[tuple[float, float]]) -> Column:
    """apply_knots for many knots: two array literals and a search, in place of a nested case for each."""
    xs, ys = (F.array(*[F.lit(float(v)) for v in z]) for z in zip(*points, strict=True))
    at = F.size(F.filter(xs, lambda x: x <= p))  # knots at or below
    x0, y0, x1, y1 = F.get(xs, at - 1), F.get(ys, at - 1), F.get(xs, at), F.get(ys, at)
    line = F.when((at == F.size(xs)) | (x1 == x0), y0).otherwise(y0 + (p - x0) * (y1 - y0) / (x1 - x0))
    return F.when(at == 0, F.get(ys, F.lit(0))).otherwise(line)


def calibrate_out_of_fold(df: DataFrame, prob: str = "oof_prob", n: int = DEFAULTS.folds) -> DataFrame:
    """df with calibrated_prob: each fold by the isotonic fit of the others."""
    folded, parts = pairing.folds(df, n), []
    for k in range(n):
        points = knots(fit_isotonic(folded.where(F.col("fold") != k), prob))
        parts.append(folded.where(F.col("fold") == k).withColumn("calibrated_prob", apply_knots(F.col(prob), points)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("fold")


def adopt_calibration(ece_raw: float, ece_new: float, f_raw: float, f_new: float, least_gain: float = 0.005, slack: float = 1e-6) -> bool:
    """Whether calibration pays: the error falls by least_gain, and macro F0.5 doesn't fall."""
    return ece_raw - ece_new >= least_gain and f_new >= f_raw - slack


def calibration_sizes(df: DataFrame, least: int = 20) -> list[str]:
    """The buckets with enough rows for a calibration of their own."""
    return [r["bucket"] for r in df.groupBy("bucket").count().where(F.col("count") >= least).orderBy("bucket").collect()]


def choose_calibration(options: dict[str, tuple[float, float]], least_gain: float = 0.005, slack: float = 1e-6) -> str:
    """Of (ece, macro F0.5) of `none` and others, the one with the least error among those that pay, else `none`."""
    ece, f = options["none"]
    good = [k for k, (e, x) in options.items() if k != "none" and adopt_calibration(ece, e, f, x, least_gain, slack)]
    return min(good, key=lambda k: (options[k][0], k), default="none")


def calibrate_by_bucket(df: DataFrame, points: dict[str, list[tuple[float, float]]], prob: str = "prob") -> DataFrame:
    """Each bucket by its own knots; raw scores where a bucket has none."""
    out = F.col(prob)
    for name, ps in points.items():
        out = F.when(F.col("bucket") == name, apply_knots(F.col(prob), ps)).otherwise(out)
    return df.withColumn("calibrated_prob", out)
