"""Learned-state track: novelty, forecast surprise, similarity, carried state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceframe import fixed
from paceframe.functions import risk
from paceframe.functions.numbers import clamp, total
from paceframe.keys import ATHLETE, DATE, top_per, with_day
from paceframe.operators.daily import one_per_day
from paceframe.operators.embeddings import normalised, reference_similarity, reference_windows, window_centroids
from paceframe.operators.state import asymmetric_state

# --- fixed values: reference window ---
REFERENCE_AFTER_DAYS = 28


def novelty(df: DataFrame) -> DataFrame:
    """Base and contrastive novelty, blended where both exist."""
    frame = df.withColumns(
        {
            "_base": F.when(F.col("anomaly_zscore").isNotNull(), normalised(F.col("anomaly_zscore"))),
            "contrastive_novelty_score": F.when(
                F.col("contrastive_anomaly_zscore").isNotNull(), normalised(F.col("contrastive_anomaly_zscore"))
            ),
        }
    )
    base, contrast = F.col("_base"), F.col("contrastive_novelty_score")
    both = fixed.NOVELTY_BASE_WEIGHT * base + fixed.NOVELTY_CONTRAST_WEIGHT * contrast
    return frame.withColumn("embedding_novelty_score", F.coalesce(both, contrast, base)).drop("_base")


def forecast_surprise(df: DataFrame) -> DataFrame:
    """Forecast error and its unfavourable part, both on a 0..100 scale."""
    error = F.abs(F.col("actual") - F.col("prediction"))
    shortfall = F.greatest(F.col("prediction") - F.col("actual"), F.lit(0.0))
    known = F.col("readiness_forecast_error").isNotNull()
    frame = df.withColumns(
        {
            "readiness_forecast_error": error,
            "_shortfall": F.when(F.col("actual").isNotNull() & F.col("prediction").isNotNull(), shortfall),
        }
    )
    frame = frame.withColumns(
        {
            "readiness_absolute_forecast_error_score": F.when(known, normalised(F.col("readiness_forecast_error"))),
            "readiness_forecast_error_score": F.when(known, normalised(F.col("_shortfall"))),
        }
    )
    return frame.withColumn("readiness_model_pessimism_score", F.col("readiness_forecast_error_score")).drop("_shortfall")


def weighted_strain(novelty_: Column, forecast: Column, similarity: Column) -> Column:
    """Weighted mean over the parts that are present."""
    parts = list(zip(fixed.FRONTIER_WEIGHTS, (novelty_, forecast, similarity)))
    amount = total([F.when(x.isNotNull(), w * x).otherwise(0.0) for w, x in parts])
    weight = total([F.when(x.isNotNull(), F.lit(w)).otherwise(0.0) for w, x in parts])
    return F.when(weight > 0, clamp(amount / weight))


def chosen_events(events: DataFrame, event_id: str | None = None) -> DataFrame:
    """One event per athlete: the named one, or the first by onset and id."""
    named = events.filter(F.col("event_id") == event_id) if event_id is not None else events
    order = [F.col("onset_date").asc_nulls_last(), F.col("event_id").asc(), F.col("symptom_window_start").asc()]
    return top_per(named, [ATHLETE], order, 1)


def enrich_frontier(
    scores: DataFrame,
    embeddings: DataFrame,
    predictions: DataFrame | None = None,
    contrastive: DataFrame | None = None,
    reference_events: DataFrame | None = None,
    dim: int = fixed.EMBEDDING_DIM,
    event_id: str | None = None,
) -> DataFrame:
    """Add learned-state columns where vectors and forecasts exist.

    One of an athlete's ``reference_events`` shapes the score: the one called
    ``event_id``, or else the first by onset and id. Leave the events out to
    keep them from influencing the score at all.
    """
    frame = scores.join(
        embeddings.select(ATHLETE, DATE, "anomaly_zscore", "embedding_distance", "z"), [ATHLETE, DATE], "left"
    )
    if contrastive is not None:
        frame = frame.join(contrastive.select(ATHLETE, DATE, "contrastive_anomaly_zscore"), [ATHLETE, DATE], "left")
    else:
        frame = frame.withColumn("contrastive_anomaly_zscore", F.lit(None).cast("double"))
    if predictions is not None:
        # Later splits of the same day win, as the last row does in a sorted file.
        newest = one_per_day(predictions, [F.col("split").desc_nulls_last()] if "split" in predictions.columns else [F.col("prediction").desc()])
        frame = frame.join(newest.select(ATHLETE, DATE, "actual", "prediction"), [ATHLETE, DATE], "left")
    else:
        frame = frame.withColumns({"actual": F.lit(None).cast("double"), "prediction": F.lit(None).cast("double")})
    frame = forecast_surprise(novelty(with_day(frame)))
    if reference_events is not None:
        windows = reference_windows(chosen_events(reference_events, event_id), REFERENCE_AFTER_DAYS)
        frame = reference_similarity(frame, window_centroids(embeddings, windows, ["event_id"], dim))
    else:
        frame = frame.withColumns(
            {
                "reference_block_embedding_similarity": F.lit(None).cast("double"),
                "reference_block_similarity_score": F.lit(None).cast("double"),
            }
        )
    strain = weighted_strain(
        F.col("embedding_novelty_score"),
        F.col("readiness_forecast_error_score"),
        F.col("reference_block_similarity_score"),
    )
    frame = asymmetric_state(frame.drop("z").withColumn("frontier_strain_score", strain))
    state, bone = F.col("accumulated_frontier_state"), F.col("bone_stress_risk_score")
    frame = frame.withColumns(
        {
            "accumulated_frontier_level": risk.known_level("accumulated_frontier_state"),
            "frontier_strain_level": risk.known_level("frontier_strain_score"),
            "integrated_bone_stress_score": F.coalesce(clamp(0.65 * bone + 0.35 * state), bone),
        }
    )
    return frame.withColumn(
        "monitoring_signal_agreement",
        risk.agreement("literature_bone_stress_level", "personalized_bone_stress_level", "accumulated_frontier_level"),
    )
