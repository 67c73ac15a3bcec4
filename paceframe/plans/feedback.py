"""Explanations of anomaly days, risk days and periods as text columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceframe import fixed
from paceframe.functions.numbers import direction_phrase, number_or_unknown, or_zero, pct_delta, texts
from paceframe.keys import ATHLETE, DATE, col_or_null, has, top_per, with_day
from paceframe.operators.daily import previous_day
from paceframe.operators.embeddings import nearest_earlier
from paceframe.operators.trailing import trailing_medians, trailing_share
from paceframe.plans import texts as words

NEIGHBOR_SCHEMA = T.ArrayType(
    T.StructType(
        [
            T.StructField("date", T.StringType()),
            T.StructField("distance", T.DoubleType()),
            T.StructField("readiness", T.DoubleType()),
            T.StructField("load", T.DoubleType()),
            T.StructField("anomaly_zscore", T.DoubleType()),
        ]
    )
)


def parse_neighbors(value: Column) -> Column:
    """JSON list of neighbours; anything unreadable is an empty list."""
    return F.coalesce(F.from_json(value, NEIGHBOR_SCHEMA), F.array().cast(NEIGHBOR_SCHEMA))


def lookup(value: Column, table: Mapping[str, str], other: Column | str | None = None) -> Column:
    chain = None
    for key, text in table.items():
        chain = F.when(value == key, text) if chain is None else chain.when(value == key, text)
    return chain.otherwise(F.lit(other) if isinstance(other, str) or other is None else other)


def tags_of(*tags: Column, empty: str) -> Column:
    """The tags that apply, or one for none."""
    found = F.array_compact(F.array(*tags))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(empty)))


def has_tag(tags: str, *names: str) -> Column:
    return F.arrays_overlap(F.col(tags), F.array(*[F.lit(n) for n in names]))


# --- anomaly days ----------------------------------------------------------------


def normal_neighbors(frame: DataFrame, normal_z_max: float = 1.0, k: int = 3, query: Column | None = None) -> DataFrame:
    """Nearest earlier days that were not unusual, as a JSON list per day."""
    normal = F.coalesce(F.col("anomaly_zscore") <= normal_z_max, F.lit(False))
    near = nearest_earlier(frame, k=k, exclude_days=0, candidate=normal, query=query)
    context = frame.select(
        ATHLETE, F.col(DATE).alias("neighbor_date"), col_or_null(frame, "readiness").alias("readiness"),
        col_or_null(frame, "load").alias("load"), "anomaly_zscore",
    )
    entry = F.struct(
        "neighbor_rank", F.col("neighbor_date").cast("string").alias("date"),
        F.col("neighbor_distance").alias("distance"), "readiness", "load", "anomaly_zscore",
    )
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.dropFields("neighbor_rank"))
    return (
        near.join(context, [ATHLETE, "neighbor_date"])
        .groupBy(ATHLETE, DATE)
        .agg(F.to_json(listed).alias("nearest_previous_normal_days"))
    )


# --- fixed values: columns of the anomaly report ---
REPORT_CONTEXT = ["load", "activity_duration_seconds", "activity_distance_m", "activity_count"]
REPORT_COLUMNS = ["readiness", "load", "hrv", "resting_hr", "activity_count", "activity_duration_seconds", "activity_distance_m", "activity_calories", "activity_avg_hr", "activity_max_hr", "activity_training_load", "activity_steps"]


def anomaly_report(frame: DataFrame, n: int = 20, neighbors: int = 3, normal_z_max: float = 1.0) -> DataFrame:
    """Each athlete's most unusual days with load context and normal neighbours."""
    context = [c for c in REPORT_CONTEXT if has(frame, c)]
    rows = previous_day(with_day(frame), context)
    rows = trailing_share(rows, "load", "previous_day_load", "previous_day_load_percentile_28d")
    order = [F.col("anomaly_zscore").desc(), F.col("embedding_distance").desc(), F.col(DATE)]
    top = top_per(rows, [ATHLETE], order, n, rank="place")
    kept = [c for c in ("split", "anomaly_zscore", "embedding_distance", "embedding_norm", "embedding_drift") if has(frame, c)]
    kept += [c for c in REPORT_COLUMNS if has(frame, c)] + [f"previous_day_{c}" for c in context]
    top = top.select(ATHLETE, DATE, "place", *kept, "previous_day_load_percentile_28d")
    flagged = frame.join(top.select(ATHLETE, DATE, F.lit(True).alias("_is_top")), [ATHLETE, DATE], "left")
    near = normal_neighbors(flagged, normal_z_max, neighbors, query=F.coalesce("_is_top", F.lit(False)))
    joined = top.join(near, [ATHLETE, DATE], "left")
    return joined.withColumn("nearest_previous_normal_days", F.coalesce("nearest_previous_normal_days", F.lit("[]")))


def report_summary(report: DataFrame, frame: DataFrame) -> DataFrame:
    """Rows, dates and the largest and mean novelty per athlete."""
    top = report.groupBy(ATHLETE).agg(
        F.count(F.lit(1)).alias("top_anomaly_count"), F.max("anomaly_zscore").alias("max_anomaly_zscore")
    )
    rows = frame.groupBy(ATHLETE).agg(
        F.count(F.lit(1)).alias("rows_analyzed"),
        F.min(DATE).alias("start_date"),
        F.max(DATE).alias("end_date"),
        F.avg("anomaly_zscore").alias("mean_anomaly_zscore"),
    )
    return rows.join(top, ATHLETE, "left")


def _median(column: str) -> Column:
    return F.col(f"median_{column}")


def _over(column: str, limit: float, source: str | None = None) -> Column:
    return F.coalesce(pct_delta(source or column, _median(column)) > limit, F.lit(False))


def state_tags() -> Column:
    """What a day's values say against the trailing medians."""
    readiness = F.col("readiness")
    prior = (
        _over("load", 25, "previous_day_load")
        | _over("activity_duration_seconds", 40, "previous_day_activity_duration_seconds")
        | _over("activity_distance_m", 40, "previous_day_activity_distance_m")
    )
    low_load = F.coalesce(pct_delta("load", _median("load")) < -25, F.lit(False))
    return tags_of(
        F.when(readiness < 30, "very low readiness").when(readiness < 50, "suppressed readiness"),
        F.when(_over("load", 25), "elevated training load").when(low_load, "low training load"),
        F.when(_over("resting_hr", 5), "elevated resting HR"),
        F.when(_over("activity_duration_seconds", 40), "long activity day"),
        F.when(_over("activity_distance_m", 40), "high-distance day"),
        F.when(_over("activity_avg_hr", 8), "higher activity HR"),
        F.when(prior, "possible prior-day workload response"),
        empty="unusual latent state without one obvious driver",
    )


# --- fixed values: evidence checks (label, column, higher word, lower word) ---
EVIDENCE = [
    ("Readiness", "readiness", "higher", "lower"),
    ("Training load", "load", "higher", "lower"),
    ("Resting HR", "resting_hr", "higher", "lower"),
    ("Activity duration", "activity_duration_seconds", "longer", "shorter"),
    ("Activity distance", "activity_distance_m", "higher", "lower"),
    ("Average activity HR", "activity_avg_hr", "higher", "lower"),
]
PRIOR_EVIDENCE = [
    ("prior-day load", "load"),
    ("prior-day duration", "activity_duration_seconds"),
    ("prior-day distance", "activity_distance_m"),
]
NO_EVIDENCE = "No single raw metric strongly deviated from the recent baseline, so the anomaly may reflect the combination of features."


def _phrase(label: str, sep: str, source: str, column: str, higher: str, lower: str) -> Column:
    phrase = direction_phrase(pct_delta(source, _median(column)), higher, lower)
    text = texts(
        label, sep, number_or_unknown(source), " vs recent median ", number_or_unknown(_median(column)), " (", phrase, ")"
    )
    return F.when(phrase.isNotNull(), text)


def evidence_text() -> Column:
    """Metrics beyond ten percent of their trailing median, as sentences."""
    now = [F.concat(_phrase(label, ": ", c, c, hi, lo), F.lit(".")) for label, c, hi, lo in EVIDENCE]
    prior = [_phrase(label, " was ", f"previous_day_{c}", c, "higher", "lower") for label, c in PRIOR_EVIDENCE]
    current = F.concat_ws(" ", *now)
    before = F.concat_ws("; ", *prior)
    return F.concat_ws(
        " ",
        F.when(current != "", current).otherwise(NO_EVIDENCE),
        F.when(before != "", texts("Previous-day context: ", before, ".")),
    )


def anomaly_action() -> Column:
    loaded = has_tag("tag_list", "elevated training load", "long activity day", "high-distance day")
    low = has_tag("tag_list", "very low readiness", "suppressed readiness")
    return (
        F.when(has_tag("tag_list", "very low readiness") & loaded, words.ANOMALY_ACTION["low readiness under load"])
        .when(has_tag("tag_list", "possible prior-day workload response") & low, words.ANOMALY_ACTION["delayed response"])
        .when(low, words.ANOMALY_ACTION["low readiness"])
        .when(loaded, words.ANOMALY_ACTION["load"])
        .when(has_tag("tag_list", "elevated resting HR"), words.ANOMALY_ACTION["resting hr"])
        .otherwise(words.ANOMALY_ACTION["other"])
    )


def anomaly_feedback(report: DataFrame, frame: DataFrame, days: int = fixed.BASELINE_DAYS) -> DataFrame:
    """Tags, explanation, evidence and advice for each reported day."""
    columns = [c for c in fixed.CONTEXT_COLUMNS if has(frame, c)]
    medians = trailing_medians(frame, columns, days).select(ATHLETE, DATE, *[f"median_{c}" for c in columns])
    rows = report.join(medians, [ATHLETE, DATE], "left")
    missing = {n: F.lit(None).cast("double") for c in fixed.CONTEXT_COLUMNS if not has(frame, c) for n in (c, f"median_{c}")}
    rows = rows.withColumns({n: c for n, c in missing.items() if n not in rows.columns}) if missing else rows
    rows = rows.withColumns({"tag_list": state_tags(), "_near": parse_neighbors(F.col("nearest_previous_normal_days"))})
    listed = F.transform(
        F.slice("_near", 1, 3),
        lambda e: texts(e["date"], " (readiness ", number_or_unknown(e["readiness"]), ", load ", number_or_unknown(e["load"]), ")"),
    )
    tags = F.array_join("tag_list", ", ")
    explanation = texts(
        F.col(DATE), " is flagged because its learned athlete-state embedding was far from the recent rolling baseline "
        "(anomaly z-score ", number_or_unknown("anomaly_zscore", 2), "). The main interpretation is: ", tags, ".",
    )
    near = F.array_join(listed, "; ")
    return rows.select(
        ATHLETE, DATE, "anomaly_zscore", *columns, *[c for c in rows.columns if c.startswith("previous_day_")],
        tags.alias("tags"), explanation.alias("explanation"), evidence_text().alias("evidence"),
        F.when(near != "", near).otherwise("No previous normal neighbor found.").alias("nearest_normal_context"),
        anomaly_action().alias("suggested_action"),
    )


# --- risk days ---------------------------------------------------------------------


def risk_day_tags() -> Column:
    marks = [
        ("recovery_strain_score", "autonomic recovery strain"),
        ("metabolic_fatigue_score", "metabolic fatigue"),
        ("tissue_load_score", "tissue-load stress"),
        ("insufficient_rest_score", "insufficient rest / monotony"),
        ("preparedness_mismatch_score", "preparedness mismatch"),
    ]
    tags = [F.when(or_zero(c) >= 55, tag) for c, tag in marks]
    under = F.when(F.col("risk_reason") == "running while under-recovered", "running under-recovered")
    return tags_of(*tags, under, empty="mixed monitoring signal")


def references_text(tags: str, reason: str) -> Column:
    """Literature that backs the tags and the reason, each named once."""
    why = F.coalesce(F.col(reason), F.lit(""))
    ref = words.REFERENCES
    load = has_tag(tags, "tissue-load stress", "running under-recovered") | (why == "tissue-load recovery mismatch")
    rest = has_tag(tags, "insufficient rest / monotony")
    parts = [
        F.when(
            has_tag(tags, "autonomic recovery strain", "preparedness mismatch")
            | why.isin("post-load recovery response", "poor recovery markers", "running while under-recovered"),
            ref["hrv"],
        ),
        F.when(has_tag(tags, "metabolic fatigue", "preparedness mismatch", "insufficient rest / monotony"), ref["acwr"]),
        F.when(rest | (why == "accumulated insufficient rest"), ref["monotony"]),
        F.when(load, ref["running_load"]),
        F.when(load, ref["sport_specific"]),
        F.when(
            has_tag(tags, "preparedness mismatch")
            | why.isin(
                "post-load recovery response", "tissue-load recovery mismatch", "running while under-recovered",
                "accumulated insufficient rest",
            ),
            ref["preparedness"],
        ),
    ]
    return F.concat_ws(" · ", *parts)


def capitalized(text: Column) -> Column:
    """First letter upper case, all others lower case."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.right(text, F.length(text) - 1)))


def sport_story(df: DataFrame) -> Column:
    """Which sport loaded the day or the day before."""

    def part(column: str, before: str, after: str) -> Column:
        x = col_or_null(df, column)
        return F.when(x > 0, texts(before, number_or_unknown(x, 0), after))

    found = F.concat_ws(
        "; ",
        part("running_distance", "running ", " m today"),
        part("cycling_distance", "cycling ", " m today"),
        part("previous_day_running_distance", "after ", " m running yesterday"),
        part("previous_day_cycling_distance", "after ", " m cycling yesterday"),
    )
    whole = part("previous_day_distance", "after a large prior-day workload (", " m total)")
    none = F.lit("without a clearly dominant sport-specific load signal")
    return F.when(found != "", found).otherwise(F.coalesce(whole, none))


def recovery_story() -> Column:
    readiness = F.col("readiness")
    found = F.concat_ws(
        ", ",
        F.when(readiness < 35, texts("readiness was very suppressed (", number_or_unknown(readiness), ")")).when(
            readiness < 50, texts("readiness was below typical (", number_or_unknown(readiness), ")")
        ),
        F.when(F.col("hrv").isNotNull(), texts("HRV context ", number_or_unknown("hrv"))),
        F.when(F.col("resting_hr").isNotNull(), texts("resting HR ", number_or_unknown("resting_hr"))),
    )
    return F.when(found != "", found).otherwise("recovery markers were mixed or incomplete")


def risk_day_story() -> Column:
    """What is happening on a risk day, by its reason."""
    load, recovery, still = F.col("_load_story"), F.col("_recovery_story"), F.col("_still")
    big_load, big_recovery = capitalized(load), capitalized(recovery)
    reason = F.col("risk_reason")
    return (
        F.when(
            reason == "post-load recovery response",
            texts(
                "This day looks like a delayed recovery response: ", recovery, ", ", load,
                ". The system is interpreting this as workload absorbed recently outpacing current recovery capacity.", still,
            ),
        )
        .when(
            reason == "accumulated insufficient rest",
            texts(
                "This day sits inside a broader under-recovery pattern: ", recovery,
                ", with repeated recent load and limited restoration. ", big_load, ".", still,
            ),
        )
        .when(
            reason == "tissue-load recovery mismatch",
            texts(
                "This day shows a tissue-load mismatch: impact-weighted or running-heavy stress was high while ", recovery,
                ". Weight-bearing load likely exceeded what recovery markers suggested you were prepared to absorb. ", big_load, ".", still,
            ),
        )
        .when(
            reason == "running while under-recovered",
            texts(
                "Running load occurred while recovery markers were already suppressed (", recovery,
                "). This is more concerning than equivalent cycling because running adds repetitive tissue stress on top of autonomic fatigue. ",
                big_load, ".", still,
            ),
        )
        .when(
            reason == "poor recovery markers",
            texts("Recovery markers alone drove the alert: ", recovery, ". Workload context was secondary on this day.", still),
        )
        .otherwise(
            texts(
                "Risk was elevated because ", F.array_join("tag_list", ", "), " combined on this day. ", big_recovery, "; ", load, ".", still,
            )
        )
    )


def risk_day_rationale() -> Column:
    r = words.DAY_RATIONALE
    rest = has_tag("tag_list", "insufficient rest / monotony") | (F.col("risk_reason") == "accumulated insufficient rest")
    parts = F.concat_ws(
        " ",
        F.when(has_tag("tag_list", "autonomic recovery strain"), r["autonomic recovery strain"]),
        F.when(has_tag("tag_list", "metabolic fatigue"), r["metabolic fatigue"]),
        F.when(has_tag("tag_list", "tissue-load stress", "running under-recovered"), r["tissue-load stress"]),
        F.when(rest, r["insufficient rest / monotony"]),
        F.when(has_tag("tag_list", "preparedness mismatch"), r["preparedness mismatch"]),
    )
    return F.when(parts != "", parts).otherwise(_NO_MECHANISM)


# --- fixed values: rationale without a mechanism ---
_NO_MECHANISM = "This alert is based on a multivariate monitoring model, not a single Garmin score. It should support training decisions, not replace them."


def _listed(pairs: Sequence[tuple[str, str, int]], end: str = ".") -> Column:
    """``label value; label value`` with the given decimals."""
    return F.concat(F.concat_ws("; ", *[texts(label, " ", number_or_unknown(c, d)) for label, c, d in pairs]), F.lit(end))


def risk_day_feedback(days: DataFrame) -> DataFrame:
    """Explanation columns of recovery-risk days."""
    state = F.col("accumulated_risk_state")
    still = F.when(
        state >= 45,
        texts(" Accumulated risk state was ", number_or_unknown(state), ", meaning recent load and recovery context had not fully cleared."),
    )
    rows = days.withColumns(
        {"tag_list": risk_day_tags(), "_load_story": sport_story(days), "_recovery_story": recovery_story(), "_still": F.coalesce(still, F.lit(""))}
    )
    n = number_or_unknown
    evidence = texts(
        "Risk score ", n("risk_score"), " (", F.col("risk_level"), "); recovery strain ", n("recovery_strain_score"),
        ", prior workload ", n("prior_workload_score"), ", tissue load ", n("tissue_load_score"), ", metabolic fatigue ",
        n("metabolic_fatigue_score"), ", preparedness mismatch ", n("preparedness_mismatch_score"), ", accumulated state ",
        n("accumulated_risk_state"), ", insufficient-rest signal ", n("insufficient_rest_score"), ".",
    )
    context = texts(
        "Readiness ", n("readiness"), ", load ", n("load"), ", previous-day load ", n("previous_day_load"),
        ", previous-day distance ", n("previous_day_distance"), " m, running distance ", n("running_distance"),
        " m, cycling distance ", n("cycling_distance"), " m.",
    )
    action = lookup(F.col("risk_reason"), words.RISK_ACTION, lookup(F.col("risk_level"), words.RISK_ACTION_LEVEL, words.RISK_ACTION_OTHER))
    return rows.select(
        ATHLETE, DATE, "risk_score", "risk_level", "risk_reason", F.array_join("tag_list", ", ").alias("mechanisms"),
        lookup(F.col("risk_reason"), words.RISK_SUMMARY, words.RISK_SUMMARY_OTHER).alias("summary"),
        risk_day_story().alias("what_is_happening"), risk_day_rationale().alias("science_rationale"),
        references_text("tag_list", "risk_reason").alias("science_references"),
        evidence.alias("evidence"), context.alias("context"), action.alias("suggested_action"),
    )


# --- risk periods --------------------------------------------------------------------


def _chronic(high_days: str, peak: str) -> Column:
    """No high day and a known, non-zero peak."""
    return (or_zero(high_days) == 0) & (or_zero(peak) != 0)


def risk_period_tags() -> Column:
    return tags_of(
        F.when(or_zero("mean_metabolic_fatigue") >= 80, "sustained metabolic load"),
        F.when(or_zero("mean_tissue_load") >= 55, "sustained tissue-load exposure"),
        F.when(or_zero("mean_recovery_strain") >= 45, "suppressed recovery markers"),
        F.when(_chronic("high_risk_days", "peak_accumulated_risk_state"), "chronic load without daily spikes"),
        F.when(F.col("dominant_risk_reason") == "accumulated insufficient rest", "insufficient rest / monotony"),
        empty="sustained accumulated risk",
    )


def risk_period_story() -> Column:
    n = number_or_unknown
    span = texts("From ", F.col("start_date"), " to ", F.col("end_date"), " (", F.col("calendar_days"), " days), ")
    peak, mean, high = n("peak_accumulated_risk_state"), n("mean_accumulated_risk_state"), F.col("high_risk_days").cast("int")
    low = F.when(
        F.col("min_readiness").isNotNull(), texts(" Readiness dropped as low as ", n("min_readiness"), " during the block.")
    )
    both = has_tag("tag_list", "sustained tissue-load exposure") & has_tag("tag_list", "suppressed recovery markers")
    return (
        F.when(
            has_tag("tag_list", "chronic load without daily spikes"),
            texts(
                span, "accumulated risk stayed elevated (peak ", peak, ", mean ", mean, ") even though only ", high,
                " day(s) crossed the high daily-risk threshold. This pattern fits a chronic load block: metabolic fatigue accumulated faster than recovery cleared it.",
                low,
            ),
        )
        .when(
            has_tag("tag_list", "insufficient rest / monotony"),
            texts(
                span, "the athlete likely did not get enough restoration relative to repeated workload. Accumulated state peaked at ",
                peak, " with ", high, " high-risk day(s).", low, " This is closer to a training-strain block than a single bad day.",
            ),
        )
        .when(
            both,
            texts(
                span, "tissue-load and recovery markers diverged: impact-weighted stress stayed high while recovery remained suppressed. Peak accumulated state ",
                peak, ".", low,
            ),
        )
        .otherwise(
            texts(
                span, "accumulated risk state remained elevated (peak ", peak, ", mean ", mean, "). Dominant mechanisms: ",
                F.array_join("tag_list", ", "), ".", low,
            )
        )
    )


def risk_period_feedback(periods: DataFrame) -> DataFrame:
    """Explanation columns of recovery-risk periods."""
    rows = periods.withColumn("tag_list", risk_period_tags())
    r = words.PERIOD_RATIONALE
    rationale = F.concat_ws(
        " ",
        F.when(has_tag("tag_list", "sustained metabolic load", "chronic load without daily spikes"), r["sustained metabolic load"]),
        *[F.when(has_tag("tag_list", t), r[t]) for t in ("insufficient rest / monotony", "suppressed recovery markers", "sustained tissue-load exposure")],
        F.lit(words.PERIOD_RATIONALE_END),
    )
    evidence = _listed(
        [
            ("Peak accumulated state", "peak_accumulated_risk_state", 1), ("mean accumulated state", "mean_accumulated_risk_state", 1),
            ("elevated days", "elevated_days", 0), ("high-risk days", "high_risk_days", 0),
            ("mean recovery strain", "mean_recovery_strain", 1), ("mean metabolic fatigue", "mean_metabolic_fatigue", 1),
            ("mean tissue load", "mean_tissue_load", 1), ("min readiness", "min_readiness", 1),
        ]
    )
    action = lookup(
        F.col("dominant_risk_reason"), words.RISK_PERIOD_ACTION,
        lookup(F.col("period_level"), words.RISK_PERIOD_ACTION_LEVEL, words.RISK_PERIOD_ACTION_OTHER),
    )
    return rows.select(
        ATHLETE, "period_id", "start_date", "end_date", "calendar_days", "period_level", "dominant_risk_reason",
        F.array_join("tag_list", ", ").alias("mechanisms"), F.col("period_summary").alias("summary"),
        risk_period_story().alias("what_is_happening"), rationale.alias("science_rationale"),
        references_text("tag_list", "dominant_risk_reason").alias("science_references"), evidence.alias("evidence"),
        action.alias("suggested_action"),
    )


# --- bone-stress days and periods --------------------------------------------------------


def bone_day_story(df: DataFrame) -> Column:
    """Running totals, speed and effort of a day, then the carried state."""
    n = number_or_unknown
    speed, top = F.col("_speed"), F.col("running_max_speed")
    run7, run28 = F.col("running_7d_sum_m"), F.col("running_28d_sum_m")
    sport = F.col("_load_story")
    parts = F.concat_ws(
        ". ",
        F.when(run7 != 0, texts("7-day running total ", n(run7 / 1000), " km")),
        F.when(run28 != 0, texts("28-day running total ", n(run28 / 1000), " km")),
        F.when(speed != 0, texts("avg speed ", n(speed, 2), " m/s")),
        F.when((top != 0) & (top > F.coalesce(speed, F.lit(0.0))), texts("max speed ", n(top, 2), " m/s")),
        F.when(F.col("running_aerobic_te") > 0, texts("aerobic training effect ", n("running_aerobic_te"))),
        F.when(F.col("running_anaerobic_te") > 0, texts("anaerobic training effect ", n("running_anaerobic_te"))),
        F.when(sport != "without a clearly dominant sport-specific load signal", sport),
    )
    carried = F.col("bone_stress_carryover_score")
    return texts(
        F.when(parts != "", parts).otherwise("Running load signals were limited on this day."),
        F.when(
            F.col("accumulated_bone_stress_state").isNotNull(),
            texts(" Accumulated bone-stress state was ", n("accumulated_bone_stress_state"), "."),
        ),
        F.when(
            carried >= 45,
            texts(" Carryover from recent running blocks remains elevated (", n(carried), " over the last 21 days)."),
        ),
    )


def bone_day_feedback(days: DataFrame) -> DataFrame:
    """Explanation columns of bone-stress days."""
    distance, duration, speed = F.col("running_distance"), col_or_null(days, "running_duration"), F.col("running_avg_speed")
    implied = distance / duration
    use_implied = (distance != 0) & (duration > 0) & (speed.isNull() | (speed < 1.5))
    rows = days.withColumns(
        {"_speed": F.when(use_implied, implied).otherwise(speed), "_load_story": sport_story(days)}
    )
    reason, level = F.col("bone_stress_risk_reason"), F.col("bone_stress_risk_level")
    ref = words.REFERENCES
    rationale = F.concat_ws(
        " ", F.lit(words.BONE_RATIONALE_START), lookup(reason, words.BONE_RATIONALE), F.lit(words.BONE_RATIONALE_END)
    )
    by_level = lookup(level, words.BONE_ACTION_LEVEL, words.BONE_ACTION_OTHER)
    action = F.when(level == "high", lookup(reason, words.BONE_ACTION_HIGH, by_level)).otherwise(by_level)
    n = number_or_unknown
    evidence = texts(
        "Bone-stress score ", n("bone_stress_risk_score"), " (", level, "); ",
        _listed(
            [
                ("7-day load score", "running_7d_load_score", 1), ("28-day load score", "running_28d_load_score", 1),
                ("progression score", "running_progression_score", 1), ("intensity score", "running_intensity_score", 1),
                ("workout score", "running_workout_score", 1), ("running monotony", "running_monotony_score", 1),
                ("accumulated bone-stress state", "accumulated_bone_stress_state", 1),
                ("21-day carryover", "bone_stress_carryover_score", 1),
            ]
        ),
    )
    references = " · ".join(ref[k] for k in ("acwr", "monotony", "running_load", "speed_volume"))
    return rows.select(
        ATHLETE, DATE, "bone_stress_risk_score", "bone_stress_risk_level", "bone_stress_risk_reason",
        lookup(reason, words.BONE_SUMMARY, words.BONE_SUMMARY_OTHER).alias("summary"),
        bone_day_story(rows).alias("what_is_happening"), rationale.alias("science_rationale"),
        F.lit(references).alias("science_references"), evidence.alias("evidence"), action.alias("suggested_action"),
    )


def bone_period_tags() -> Column:
    reason = F.col("dominant_bone_stress_reason")
    return tags_of(
        F.when(or_zero("peak_running_7d_km") >= 120, "sustained high running volume"),
        F.when(or_zero("mean_running_progression_score") >= 65, "running volume progression"),
        F.when(or_zero("mean_running_intensity_score") >= 70, "elevated running intensity block"),
        F.when(or_zero("mean_running_7d_load_score") >= 80, "sustained composite running load"),
        F.when(
            _chronic("high_bone_stress_days", "peak_accumulated_bone_stress_state"),
            "chronic bone-stress accumulation without daily spikes",
        ),
        F.when(reason == "running monotony block", "running monotony"),
        F.when(reason == "running volume progression", "running volume progression"),
        empty="sustained running bone-stress load",
    )


def bone_period_feedback(periods: DataFrame) -> DataFrame:
    """Explanation columns of running-load blocks."""
    rows = periods.withColumn("tag_list", bone_period_tags())
    n = number_or_unknown
    r = words.BONE_PERIOD_RATIONALE
    rationale = F.concat_ws(
        " ",
        F.lit(words.BONE_PERIOD_RATIONALE_START),
        F.when(has_tag("tag_list", "running volume progression"), r["running volume progression"]),
        F.when(has_tag("tag_list", "sustained high running volume", "sustained composite running load"), r["sustained volume"]),
        *[
            F.when(has_tag("tag_list", t), r[t])
            for t in ("elevated running intensity block", "running monotony", "chronic bone-stress accumulation without daily spikes")
        ],
        F.lit(words.BONE_PERIOD_RATIONALE_END),
    )
    peak_run = F.when(
        F.col("peak_running_7d_km") != 0, texts(" Peak 7-day running total reached ", n("peak_running_7d_km", 0), " km.")
    )
    story = texts(
        "From ", F.col("start_date"), " to ", F.col("end_date"), " (", F.col("calendar_days"),
        " days), accumulated bone-stress load stayed elevated (peak state ", n("peak_accumulated_bone_stress_state"), ", mean ",
        n("mean_accumulated_bone_stress_state"), ") with ", F.col("high_bone_stress_days").cast("int"), " high day(s). Mechanisms: ",
        F.array_join("tag_list", ", "), ".", peak_run,
    )
    evidence = F.concat(
        _listed(
            [
                ("Peak accumulated state", "peak_accumulated_bone_stress_state", 1),
                ("mean accumulated state", "mean_accumulated_bone_stress_state", 1),
                ("elevated days", "elevated_days", 0), ("high bone-stress days", "high_bone_stress_days", 0),
            ],
            end="; ",
        ),
        texts("peak 7-day running ", n("peak_running_7d_km", 0), " km; mean 7-day running ", n("mean_running_7d_km", 0), " km."),
    )
    action = lookup(
        F.col("dominant_bone_stress_reason"), words.BONE_PERIOD_ACTION,
        lookup(F.col("period_level"), words.BONE_PERIOD_ACTION_LEVEL, words.BONE_PERIOD_ACTION_OTHER),
    )
    return rows.select(
        ATHLETE, "period_id", "start_date", "end_date", "calendar_days", "period_level", "dominant_bone_stress_reason",
        F.array_join("tag_list", ", ").alias("mechanisms"), F.col("period_summary").alias("summary"),
        story.alias("what_is_happening"), rationale.alias("science_rationale"),
        F.lit(words.BONE_PERIOD_REFERENCES).alias("science_references"), evidence.alias("evidence"),
        action.alias("suggested_action"),
    )
