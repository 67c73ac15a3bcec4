"""Distributed models: ridge and tree baselines, embeddings, drivers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceframe import fixed
from paceframe.functions.numbers import fixed_text, texts
from paceframe.functions.vectors import dot
from paceframe.keys import ATHLETE, DATE, by_days, per_athlete, top_per, with_day


def _assembled(df: DataFrame, vector: str = "vector") -> DataFrame:
    return df.withColumn("_features", array_to_vector(F.col(vector)))


def gram_matrix(rows: DataFrame, vector: str = "vector", target: str = "target") -> np.ndarray:
    """Sum over the rows of the outer product of (vector, 1, target) with itself.

    Every task sums its own rows; the partial matrices are merged row by row, so
    only one matrix of the vector's size squared reaches the driver. Rows without
    a vector or target are left out; without any the matrix is empty.
    """

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(0).to_numpy(zero_copy_only=False))
                block = np.column_stack([x, np.ones(len(x)), batch.column(1).to_numpy()])
                total = block.T @ block + (0 if total is None else total)
        if total is not None:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "sums"])

    def merged(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(r.as_py()) for r in table.column("sums")], axis=0)
        return pa.table({"i": table.column("i")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    known = rows.select(F.col(vector).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    sums = known.mapInArrow(partial, "i int, sums binary").groupBy("i").applyInArrow(merged, "i int, sums binary").orderBy("i").collect()
    return np.array([np.frombuffer(r["sums"]) for r in sums])


def ridge_weights(train: DataFrame, alpha: float = fixed.RIDGE_ALPHA) -> tuple[list[float], float]:
    """Weights and intercept (which bears no penalty), from the centred Gram matrix by Cholesky's factors."""
    gram = gram_matrix(train)
    if not len(gram):
        raise ValueError("no training rows")
    n, sums = gram[-2, -2], gram[-2]
    centred = gram - np.outer(sums, sums) / n
    size = len(gram) - 2
    factor = np.linalg.cholesky(centred[:size, :size] + alpha * np.eye(size))
    weights = np.linalg.solve(factor.T, np.linalg.solve(factor, centred[:size, -1]))
    return weights.tolist(), float((sums[-1] - weights @ sums[:size]) / n)


def ridge_predictions(windows: DataFrame, alpha: float = fixed.RIDGE_ALPHA, out: str = "ridge") -> DataFrame:
    """Ridge regression fitted on the train split, applied to all splits."""
    weights, intercept = ridge_weights(windows.filter(F.col("split") == "train"), alpha)
    return windows.withColumn(out, F.lit(intercept) + dot("vector", F.array(*map(F.lit, weights))))


def normal_equations(windows: DataFrame, alpha: float = fixed.RIDGE_ALPHA) -> DataFrame:
    """``feature`` (from 0) and ``left_side`` of the normal equations that the ridge weights solve.

    The sum over train rows of the centred feature times the prediction, and alpha
    times the weight; it equals the same sum with the target in place of the
    prediction, and no penalty.
    """
    train = windows.filter(F.col("split") == "train")
    weights, intercept = ridge_weights(train, alpha)
    predicted = train.select("vector", (F.lit(intercept) + dot("vector", F.array(*map(F.lit, weights)))).alias("p"))
    long = predicted.select("p", F.posexplode("vector").alias("feature", "x"))
    sums = long.groupBy("feature").agg(F.sum(F.col("x") * F.col("p")).alias("xp"), F.sum("x").alias("sx"), F.avg("p").alias("mp"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("feature") + 1)
    return sums.select(F.col("feature").cast("bigint").alias("feature"), (F.col("xp") - F.col("sx") * F.col("mp") + alpha * weight).alias("left_side"))


def tree_predictions(windows: DataFrame, out: str = "trees", rounds: int = 10, seed: int = 42) -> DataFrame:
    """Boosted trees as the non-linear tabular baseline."""
    frame = _assembled(windows)
    model = GBTRegressor(featuresCol="_features", labelCol="target", predictionCol=out, maxIter=rounds, maxDepth=4, seed=seed)
    return model.fit(frame.filter(F.col("split") == "train")).transform(frame).drop("_features")


def prediction_table(windows: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per target day with the actual and every model's value."""
    return windows.select("split", ATHLETE, DATE, F.col("target").alias("actual"), *models)


def state_embeddings(windows: DataFrame, dim: int = fixed.EMBEDDING_DIM) -> DataFrame:
    """Per-day state vector: principal components of the flat window.

    Fitted on train days, applied to every day with a full look-back.
    """
    frame = windows.withColumn("vector", F.flatten("window")).drop("window", "observed_window")
    frame = _assembled(frame)
    model = PCA(k=dim, inputCol="_features", outputCol="_z").fit(frame.filter(F.col("split") == "train"))
    return model.transform(frame).select(ATHLETE, DATE, "split", vector_to_array("_z").alias("z"))


def plane_coordinates(embeddings: DataFrame, dim: int, vector: str = "z") -> DataFrame:
    """Coordinates of each centred vector on the first two components."""
    z = F.col(vector)
    means = embeddings.agg(F.array(*[F.avg(F.get(z, F.lit(i))) for i in range(dim)]).alias("_m")).first()["_m"]
    centred = F.zip_with(z, F.array(*[F.lit(m) for m in means]), lambda x, m: x - m)
    frame = embeddings.withColumn("_centred", array_to_vector(centred))
    model = PCA(k=2, inputCol="_centred", outputCol="_pc").fit(frame)
    pc = vector_to_array("_pc")
    return model.transform(frame).select(ATHLETE, DATE, F.get(pc, F.lit(0)).alias("pc1"), F.get(pc, F.lit(1)).alias("pc2"))


def component_moments(embeddings: DataFrame, dim: int, vector: str = "z") -> DataFrame:
    """``moment`` (1 to ``dim``) and ``value``: the sum of that power of the variances of all principal components.

    Signs and order of components do not matter to it, and the moments settle the
    variances; each equals the trace of that power of the covariance matrix.
    """
    frame = embeddings.filter(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(F.col(vector)))
    model = PCA(k=dim, inputCol="_v", outputCol="_pc").fit(frame)
    placed = model.transform(frame).select(vector_to_array("_pc").alias("_pc"))
    spread = placed.agg(F.array(*[F.var_samp(F.get("_pc", F.lit(i))) for i in range(dim)]).alias("v"))
    total = lambda k: F.aggregate(F.transform("v", lambda x: F.pow(x, F.lit(float(k)))), F.lit(0.0), lambda s, x: s + x)
    powers = F.array(*map(total, range(1, dim + 1)))
    return spread.select(F.posexplode(powers).alias("_k", "value")).select((F.col("_k") + 1).cast("bigint").alias("moment"), "value")


def feature_label(name: str) -> str:
    return fixed.FEATURE_LABELS.get(name, name.replace("_", " "))


def flagged_day() -> Column:
    """Days worth explaining: raised tiers, notable agreement, frontier alone."""
    tier = F.col("operational_alert_tier").isin("investigate_state", "adjust_training")
    notable = F.col("monitoring_signal_agreement").isin(
        "literature_personalized_agree_frontier_differs", "mixed_signals", "all_agree"
    )
    alone = (F.col("accumulated_frontier_level") == "high") & (F.col("literature_bone_stress_level") != "high")
    return F.coalesce(tier, F.lit(False)) | F.coalesce(notable, F.lit(False)) | F.coalesce(alone, F.lit(False))


def flagged_days(scores: DataFrame, recent_days: int = 90) -> DataFrame:
    """Flagged days of each athlete's most recent stretch."""
    recent = scores.withColumn("_last", F.max(DATE).over(per_athlete())).filter(F.col(DATE) >= F.date_add("_last", -recent_days))
    return recent.filter(flagged_day()).drop("_last")


def state_drivers(daily: DataFrame, flagged: DataFrame, features: Sequence[str], days: int = 28, n: int = 5) -> DataFrame:
    """Features that stand out most from the trailing days, per flagged day."""
    frame = with_day(daily)
    earlier = by_days(-days, -1)
    stats = {f"_m_{f}": F.avg(f).over(earlier) for f in features} | {f"_s_{f}": F.stddev_pop(f).over(earlier) for f in features}
    frame = frame.withColumns(stats).join(flagged.select(ATHLETE, DATE), [ATHLETE, DATE], "left_semi")

    def entry(f: str) -> Column:
        away = F.abs(F.col(f) - F.col(f"_m_{f}")) / F.col(f"_s_{f}")
        return F.struct(
            F.when(F.col(f"_s_{f}") > 1e-12, F.round(away, 9)).alias("weight"), F.lit(feature_label(f)).alias("driver")
        )

    long = frame.select(ATHLETE, DATE, F.inline(F.array(*[entry(f) for f in features]))).filter("weight is not null")
    top = top_per(long, [ATHLETE, DATE], [F.col("weight").desc(), F.col("driver")], n, rank="place")
    listed = F.array_sort(F.collect_list(F.struct("place", "driver", "weight")))
    found = top.groupBy(ATHLETE, DATE).agg(listed.alias("_d"))
    return found.select(
        ATHLETE, DATE,
        texts("Top latent-state drivers: ", F.array_join(F.transform("_d", lambda e: e["driver"]), ", "), ".").alias(
            "frontier_attribution_summary"
        ),
        F.array_join(
            F.transform("_d", lambda e: texts(e["driver"], " (", fixed_text(e["weight"], 3), ")")), "; "
        ).alias("frontier_attribution_drivers"),
    )
