"""Model tables: targets, chronological split, preprocessing, windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceframe import fixed
from paceframe.functions.numbers import to_number
from paceframe.keys import ATHLETE, DATE, DAY, by_rows, per_athlete, top_per, with_day
from paceframe.operators.daily import dense_calendar


def available_features(columns: Sequence[str], requested: Sequence[str], target: str) -> list[str]:
    """Requested columns that exist, with the target added at the end."""
    found = [c for c in requested if c in columns]
    return found + ([target] if target in columns and target not in found else [])


def indexed_calendar(daily: DataFrame) -> DataFrame:
    """Dense calendar with each row's position from the athlete's first day."""
    frame = with_day(dense_calendar(daily))
    return frame.withColumn("row_index", F.col(DAY) - F.min(DAY).over(per_athlete()))


def chronological_split(
    indexed: DataFrame,
    target: str,
    window: int = fixed.WINDOW_ROWS,
    train: float = fixed.TRAIN_FRACTION,
    validation: float = fixed.VALIDATION_FRACTION,
) -> DataFrame:
    """Label target days train, validation or test by their order.

    Days with a full look-back but no target are historical; earlier days get
    no label.
    """
    valid = (F.col("row_index") >= window) & F.col(target).isNotNull()
    frame = indexed.withColumns(
        {
            "_position": F.count(F.when(valid, True)).over(by_rows(-(2**31) + 1, 0)),
            "_targets": F.count(F.when(valid, True)).over(per_athlete()),
        }
    )
    n = F.col("_targets")
    train_end = F.greatest(F.floor(n * train), F.lit(1))
    val_end = train_end + F.floor(n * validation)
    val_end = F.when(n > train_end, F.greatest(val_end, train_end + 1)).otherwise(val_end)
    frame = frame.withColumns({"_train_end": train_end, "_val_end": val_end})
    place = F.col("_position") - 1
    split = (
        F.when(F.col("row_index") < window, F.lit(None).cast("string"))
        .when(~valid, "historical")
        .when(place < F.col("_train_end"), "train")
        .when(place < F.col("_val_end"), "validation")
        .otherwise("test")
    )
    return frame.withColumn("split", split).drop("_position", "_targets", "_train_end", "_val_end")


def fit_preprocessor(split: DataFrame, features: Sequence[str]) -> DataFrame:
    """Median, mean and spread per athlete and feature before the last train day.

    Mean and spread are those of the series with gaps filled by the median.
    They follow from the moments of the present values, so one aggregation is
    enough.
    """
    last_train = F.max(F.when(F.col("split") == "train", F.col("row_index"))).over(per_athlete())
    rows = split.withColumn("_end", last_train).filter(F.col("row_index") < F.col("_end"))
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), to_number(f).alias("value")) for f in features])
    long = rows.select(ATHLETE, F.inline(entries))
    stats = long.groupBy(ATHLETE, "feature").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count("value").alias("_k"),
        F.avg("value").alias("_mean"),
        F.var_pop("value").alias("_var"),
        F.coalesce(F.percentile("value", F.lit(0.5)), F.lit(0.0)).alias("impute_value"),
    )
    n, k = F.col("_n"), F.col("_k")
    gaps = n - k
    shown_mean, shown_var = F.coalesce("_mean", F.lit(0.0)), F.coalesce("_var", F.lit(0.0))
    stats = stats.withColumn("feature_mean", (k * shown_mean + gaps * F.col("impute_value")) / n)
    mean = F.col("feature_mean")
    spread = (k * (shown_var + F.pow(shown_mean - mean, 2)) + gaps * F.pow(F.col("impute_value") - mean, 2)) / n
    std = F.sqrt(spread)
    return stats.select(
        ATHLETE, "feature", "impute_value", "feature_mean", F.when(std > 1e-12, std).otherwise(1.0).alias("feature_std")
    )


def transform_features(split: DataFrame, fitted: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scaled feature vector and observed mask per day."""
    wide = fitted.groupBy(ATHLETE).agg(
        F.map_from_entries(
            F.collect_list(F.struct("feature", F.struct("impute_value", "feature_mean", "feature_std")))
        ).alias("_fit")
    )
    joined = split.join(wide, ATHLETE)

    def scaled(name: str) -> Column:
        fit = F.col("_fit")[name]
        return (F.coalesce(to_number(name), fit["impute_value"]) - fit["feature_mean"]) / fit["feature_std"]

    return joined.withColumns(
        {
            "features": F.array(*[scaled(f) for f in features]),
            "observed": F.array(*[F.col(f).isNotNull() for f in features]),
        }
    ).drop("_fit")


def window_vectors(transformed: DataFrame, target: str, window: int = fixed.WINDOW_ROWS) -> DataFrame:
    """The previous rows' vectors and masks, target and last known target.

    Kept for every day with a full look-back; the split tells target days.
    """
    earlier = by_rows(-window, -1)
    frame = with_day(transformed).withColumns(
        {
            "window": F.collect_list("features").over(earlier),
            "observed_window": F.collect_list("observed").over(earlier),
            "persistence": F.last(target, ignorenulls=True).over(earlier),
        }
    )
    return frame.filter(F.col("row_index") >= window).select(
        ATHLETE, DATE, DAY, "split", F.col(target).alias("target"), "persistence", "window", "observed_window"
    )


def supervised_windows(windows: DataFrame) -> DataFrame:
    """Target days with one flat vector per window."""
    rows = windows.filter(F.col("target").isNotNull())
    return rows.withColumn("vector", F.flatten("window")).drop("window", "observed_window")


def split_summary(split: DataFrame) -> DataFrame:
    """Days and date range per athlete and split."""
    rows = split.filter(F.col("split").isNotNull())
    return rows.groupBy(ATHLETE, "split").agg(
        F.count(F.lit(1)).alias("windows"), F.min(DATE).alias("date_min"), F.max(DATE).alias("date_max")
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str, *keys: str) -> DataFrame:
    """Mean absolute and root mean squared error over complete pairs."""
    error = F.col(predicted) - F.col(actual)
    return df.filter(error.isNotNull()).groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.count(F.lit(1)).alias("n")
    )


def positive_days(events: DataFrame, reference_periods: DataFrame) -> DataFrame:
    """Days of events, from the start of symptoms to onset, and of reference periods; a day of both has a row for each."""
    spans = events.select(ATHLETE, F.col("event_id").alias("label"), F.coalesce("symptom_window_start", "onset_date").alias("a"), F.col("onset_date").alias("b"))
    spans = spans.unionByName(reference_periods.select(ATHLETE, F.col("event_id").alias("label"), F.col("start_date").alias("a"), F.col("end_date").alias("b")))
    return spans.filter("a <= b").select(ATHLETE, "label", F.explode(F.sequence("a", "b")).alias(DATE))


def contrast_pairs(
    windows: DataFrame, positives: DataFrame, stable: DataFrame, limit: int = 256
) -> DataFrame:
    """Equal numbers of event or reference days and stable days, paired per athlete.

    ``positives`` (``positive_days``) and ``stable`` list days; a hash of athlete
    and day stands for the random draw, so the sample is the same on every run.
    ``limit`` bounds the rows that a model is fitted on, as in the reference.
    """
    days = windows.select(ATHLETE, DATE)
    draw = F.md5(F.concat_ws(":", F.col(ATHLETE).cast("string"), F.col(DATE).cast("string")))

    def drawn(rows: DataFrame, side: str, *more: str) -> DataFrame:
        picked = top_per(rows, [ATHLETE], [draw, F.col(DATE), *map(F.col, more)], limit, rank="pair")
        return picked.select(ATHLETE, F.col(DATE).alias(f"{side}_date"), "pair", *more)

    yes = drawn(days.join(positives.select(ATHLETE, DATE, "label"), [ATHLETE, DATE]), "positive", "label")
    no = drawn(days.join(stable.select(ATHLETE, DATE), [ATHLETE, DATE], "left_semi"), "negative")
    return yes.join(no, [ATHLETE, "pair"])


def persistence_baseline(windows: DataFrame) -> DataFrame:
    """Error of repeating the last known target, per split."""
    return regression_metrics(windows.filter(F.col("target").isNotNull()), "target", "persistence", "split")


