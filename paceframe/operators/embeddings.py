"""Per-day state vectors: novelty, drift, centroids, archetypes, neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceframe import fixed
from paceframe.functions.numbers import clamp, settle, texts
from paceframe.functions.vectors import cosine, distance, mean_vector, norm, pack
from paceframe.keys import ATHLETE, DATE, DAY, by_rows, history_order, per_athlete, top_per, with_day


def pack_vectors(df: DataFrame, prefix: str = "z_", out: str = "z") -> DataFrame:
    """Columns ``z_0 .. z_n`` to one array column, in numeric order."""
    names = sorted((c for c in df.columns if c.startswith(prefix)), key=lambda c: int(c.removeprefix(prefix)))
    return df.withColumn(out, pack(names)).drop(*names)


def rolling_anomaly(df: DataFrame, dim: int, vector: str = "z", rows: int = fixed.ANOMALY_ROWS) -> DataFrame:
    """Distance to the mean of the previous rows, and its z-score among theirs."""
    frame = with_day(df)
    earlier = by_rows(-rows, -1)
    z = F.col(vector)
    means = F.array(*[F.avg(F.get(z, F.lit(i))).over(earlier) for i in range(dim)])
    frame = frame.withColumns({"_mean": means, "_n": F.count(F.lit(1)).over(earlier)})
    frame = frame.withColumn(
        "embedding_distance", settle(F.when(F.col("_n") > 0, distance(vector, "_mean")).otherwise(0.0), 9)
    )
    frame = frame.withColumns(
        {
            "_d_mean": F.avg("embedding_distance").over(earlier),
            "_d_std": F.stddev_pop("embedding_distance").over(earlier),
            "embedding_norm": norm(vector),
            "embedding_drift": F.coalesce(distance(vector, F.lag(vector).over(history_order())), F.lit(0.0)),
        }
    )
    score = (F.col("embedding_distance") - F.col("_d_mean")) / F.col("_d_std")
    return frame.withColumn("anomaly_zscore", F.when(F.col("_d_std") > 0, score).otherwise(0.0)).drop(
        "_mean", "_n", "_d_mean", "_d_std"
    )


def normalised(value: Column, quantile: float = fixed.NORMALISE_QUANTILE) -> Column:
    """Non-negative value on a 0..100 scale set by the athlete's upper quantile.

    Missing days count as zero when the quantile is taken.
    """
    x = F.coalesce(F.greatest(value, F.lit(0.0)), F.lit(0.0))
    scale = F.percentile(x, F.lit(quantile)).over(per_athlete())
    return F.when(scale > 0, F.least(x / scale, F.lit(1.0)) * 100.0).otherwise(0.0)


def window_centroids(embeddings: DataFrame, windows: DataFrame, keys: list[str], dim: int, vector: str = "z") -> DataFrame:
    """Mean vector of each window's days.

    ``windows`` has ``start_date`` and ``end_date``; they are laid out as days,
    so the join is on equality, and the means combine on the map side.
    """
    days = windows.select(ATHLETE, *keys, F.explode(F.sequence("start_date", "end_date")).alias(DATE))
    joined = days.join(embeddings.select(ATHLETE, DATE, vector), [ATHLETE, DATE])
    return joined.groupBy(ATHLETE, *keys).agg(mean_vector(vector, dim).alias("centroid")).filter("centroid is not null")


def reference_windows(events: DataFrame, after_days: int) -> DataFrame:
    """From the start of symptoms to some days after onset."""
    return events.select(
        ATHLETE,
        "event_id",
        "label",
        F.coalesce("symptom_window_start", "onset_date").alias("start_date"),
        F.date_add("onset_date", after_days).alias("end_date"),
    )


def reference_similarity(df: DataFrame, centroids: DataFrame, vector: str = "z") -> DataFrame:
    """Cosine of each day with the athlete's reference vector, and 0..100 score."""
    joined = df.join(centroids.select(ATHLETE, F.col("centroid").alias("_reference")), ATHLETE, "left")
    joined = joined.withColumn("reference_block_embedding_similarity", cosine(vector, "_reference")).drop("_reference")
    score = clamp(F.greatest(F.col("reference_block_embedding_similarity"), F.lit(0.0)) * 100.0)
    known = F.col("reference_block_embedding_similarity").isNotNull()
    return joined.withColumn("reference_block_similarity_score", F.when(known, score))


# --- fixed values: archetype ids, labels and sizes ---
_STABLE_ID = "stable_high_volume"
_STABLE_LABEL = "Stable high-volume running"
_STABLE_MIN_METERS = 20000
_STABLE_MIN_DAYS = 14
_STABLE_TOP_DAYS = 28
_PERIOD_TOP = 2
_EVENT_AFTER_DAYS = 14


def stable_days(scores: DataFrame) -> DataFrame:
    """Low-alert days inside weeks with substantial running."""
    volume = F.coalesce("running_7d_sum_m", F.lit(0.0))
    return scores.filter((F.col("bone_stress_risk_level") == "low") & (volume > _STABLE_MIN_METERS))


def build_archetypes(
    embeddings: DataFrame,
    scores: DataFrame,
    events: DataFrame,
    reference_periods: DataFrame | None,
    periods: DataFrame | None,
    dim: int,
) -> DataFrame:
    """Named reference vectors per athlete, in the order ties are settled.

    Events come first, then configured reference periods, the two highest
    load periods, and the stable high-volume days.
    """
    windows = reference_windows(events, _EVENT_AFTER_DAYS).select(
        ATHLETE, "start_date", "end_date", F.lit(1).alias("kind"), F.concat(F.lit("event_"), "event_id").alias("archetype_id"),
        F.col("label").alias("archetype_label"), F.col("event_id").alias("place"),
    )
    if reference_periods is not None:
        windows = windows.unionByName(
            reference_periods.select(
                ATHLETE, "start_date", "end_date", F.lit(2).alias("kind"), F.col("event_id").alias("archetype_id"),
                F.col("label").alias("archetype_label"), F.col("event_id").alias("place"),
            )
        )
    if periods is not None:
        order = [F.col("peak_accumulated_bone_stress_state").desc(), F.col("period_id")]
        top = top_per(periods, [ATHLETE], order, _PERIOD_TOP, rank="_place")
        windows = windows.unionByName(
            top.select(
                ATHLETE, "start_date", "end_date", F.lit(3).alias("kind"),
                F.concat(F.lit("period_"), "period_id").alias("archetype_id"),
                F.concat(F.lit("High load block "), F.col("start_date").cast("string")).alias("archetype_label"),
                F.col("_place").cast("string").alias("place"),
            )
        )
    keys = ["kind", "place", "archetype_id", "archetype_label"]
    built = window_centroids(embeddings, windows, keys, dim)

    calm = with_day(stable_days(scores)).select(ATHLETE, DATE, DAY, "running_7d_sum_m")
    calm = calm.withColumn("_days", F.count(F.lit(1)).over(per_athlete())).filter(F.col("_days") >= _STABLE_MIN_DAYS)
    busiest = top_per(calm, [ATHLETE], [F.col("running_7d_sum_m").desc(), F.col(DAY)], _STABLE_TOP_DAYS)
    stable = (
        busiest.select(ATHLETE, DATE)
        .join(embeddings.select(ATHLETE, DATE, "z"), [ATHLETE, DATE])
        .groupBy(ATHLETE)
        .agg(mean_vector("z", dim).alias("centroid"))
        .filter("centroid is not null")
        .select(
            ATHLETE, F.lit(4).alias("kind"), F.lit("").alias("place"), F.lit(_STABLE_ID).alias("archetype_id"),
            F.lit(_STABLE_LABEL).alias("archetype_label"), "centroid",
        )
    )
    return built.unionByName(stable)


def match_archetypes(days: DataFrame, archetypes: DataFrame, vector: str = "z") -> DataFrame:
    """Best archetype of each day by cosine, floored at zero; first wins ties.

    The similarity is taken where athlete and archetypes meet, and the best
    is kept by a map-side ``max_by``; no vector travels further.
    """
    pairs = days.select(ATHLETE, DATE, vector).join(
        archetypes.select(ATHLETE, "kind", "place", "archetype_id", "archetype_label", "centroid"), ATHLETE
    )
    scored = pairs.withColumn("_score", settle(F.greatest(cosine(vector, "centroid"), F.lit(0.0)), 9))
    best = top_per(
        scored.drop(vector, "centroid"), [ATHLETE, DATE], [F.col("_score").desc(), F.col("kind"), F.col("place")], 1
    )
    return best.select(
        ATHLETE, DATE, F.col("archetype_id").alias("reference_archetype_id"),
        F.col("archetype_label").alias("reference_archetype_label"),
        (F.col("_score") * 100.0).alias("reference_archetype_score"),
    )


_BLOCK_DAYS = 256


def nearest_earlier(
    df: DataFrame,
    k: int = 3,
    exclude_days: int = 7,
    candidate: Column | None = None,
    query: Column | None = None,
    vector: str = "z",
) -> DataFrame:
    """The ``k`` nearest earlier days of each day, exactly.

    An athlete's days are cut into calendar blocks. A unit of work is one block
    of query days with all blocks up to it: units are dealt by athlete and block,
    so a long history is spread over many tasks, and each candidate block travels
    once to each of them. Distances are formed block against block and only the
    best ``k`` per day are kept from one block to the next.
    """
    frame = with_day(df).filter(F.col(vector).isNotNull())
    frame = frame.withColumns({"_block": F.floor(F.col(DAY) / _BLOCK_DAYS), "_is_query": query if query is not None else F.lit(True)})
    columns = [ATHLETE, "_block", DAY, F.col(vector).cast("array<double>").alias("v")]
    queries = frame.filter("_is_query").select(*columns)
    targets = queries.select(ATHLETE, F.col("_block").alias("_target")).distinct()
    candidates = (frame.filter(candidate) if candidate is not None else frame).select(*columns)
    # Packed, so that days are not rows where blocks meet.
    blocks = candidates.groupBy(ATHLETE, "_block").agg(F.collect_list(F.struct(DAY, "v")).alias("days"))
    sent = blocks.join(targets, ATHLETE).filter(F.col("_block") <= F.col("_target"))
    sent = sent.select(F.col(ATHLETE).alias("_to"), F.col("_target").alias("_to_block"), "days")
    id_type = df.schema[ATHLETE].dataType

    def vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)

    def best_of_block(q: pa.Table, c: pa.Table) -> pa.Table:
        q_day = q.column(DAY).to_numpy()
        q_v = vectors(q.column("v")) if len(q_day) else np.zeros((0, 0))
        best = (np.full((len(q_day), 0), np.inf), np.zeros((len(q_day), 0), np.int32))
        for days in c.column("days") if len(q_day) else ():
            entries = days.values
            day = entries.field(DAY).to_numpy(zero_copy_only=False)
            order = np.argsort(day)
            day, v = day[order], vectors(entries.field("v"))[order]
            gaps = np.sqrt(((v[None, :, :] - q_v[:, None, :]) ** 2).sum(axis=2))
            gaps = np.where(day[None, :] < q_day[:, None] - exclude_days, gaps, np.inf)
            gaps, day = np.hstack([best[0], gaps]), np.hstack([best[1], np.broadcast_to(day, gaps.shape)])
            # Nearest first, and of equally near days the earliest.
            first = np.lexsort((day, gaps), axis=1)[:, :k]
            best = np.take_along_axis(gaps, first, axis=1), np.take_along_axis(day, first, axis=1)
        row, place = np.nonzero(np.isfinite(best[0]))
        return pa.table({
            ATHLETE: q.column(ATHLETE).take(pa.array(row)), DAY: pa.array(q_day[row], pa.int32()), "neighbor_rank": pa.array(place + 1, pa.int32()),
            "neighbor_day": pa.array(best[1][row, place], pa.int32()), "neighbor_distance": pa.array(best[0][row, place], pa.float64()),
        })

    shape = f"{ATHLETE} {id_type.simpleString()}, {DAY} int, neighbor_rank int, neighbor_day int, neighbor_distance double"
    best = queries.groupBy(ATHLETE, "_block").cogroup(sent.groupBy("_to", "_to_block")).applyInArrow(best_of_block, shape)
    return best.select(
        ATHLETE,
        F.date_from_unix_date(DAY).alias(DATE),
        "neighbor_rank",
        F.date_from_unix_date("neighbor_day").alias("neighbor_date"),
        "neighbor_distance",
    )


def neighbor_text(neighbors: DataFrame) -> DataFrame:
    """One sentence per day that names its nearest earlier days."""
    listed = F.array_sort(F.collect_list(F.struct("neighbor_rank", F.col("neighbor_date").cast("string").alias("d"))))
    names = F.array_join(F.transform(listed, lambda e: e["d"]), ", ")
    return neighbors.groupBy(ATHLETE, DATE).agg(
        texts("Latent state resembles ", names, ".").alias("embedding_neighbor_summary")
    )


def explain_days(scores: DataFrame, embeddings: DataFrame, archetypes: DataFrame) -> DataFrame:
    """Best archetype and nearest earlier days of each scored embedding day."""
    scored = embeddings.join(
        scores.filter("anomaly_zscore is not null").select(ATHLETE, DATE), [ATHLETE, DATE], "left_semi"
    )
    matched = match_archetypes(scored, archetypes)
    sentences = neighbor_text(nearest_earlier(embeddings)).join(scored.select(ATHLETE, DATE), [ATHLETE, DATE], "left_semi")
    return scores.join(matched, [ATHLETE, DATE], "left").join(sentences, [ATHLETE, DATE], "left")


def norm_agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """Correlation of the vector norms of two embedding tables, per athlete."""
    a = left.select(ATHLETE, DATE, "split", norm("z").alias("_a"))
    b = right.select(ATHLETE, DATE, "split", norm("z").alias("_b"))
    return (
        a.join(b, [ATHLETE, DATE, "split"])
        .groupBy(ATHLETE)
        .agg(F.count(F.lit(1)).alias("aligned_rows"), F.corr("_a", "_b").alias("norm_correlation"))
    )
