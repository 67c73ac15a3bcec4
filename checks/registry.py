"""Registered queries: name, covered operators, Spark side, SQL side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.sqlparts import NUDGE, build, column_digits, rounded
from paceframe.operators import activities, daily, embeddings, periods, running, trailing
from paceframe.plans import alerts, bone_stress, frontier, recovery
from paceframe.sources.tables import staged


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    spark: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def add(name: str, covers: str, spark: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = Query(name, covers, spark, sql)


# --- tables shared by many queries ---------------------------------------------------------
#
# The scored tables are computed once per session and data directory and kept,
# as a user who asks several questions would do.  ``forget`` drops them.

_KEPT: dict[tuple[str, str, str], DataFrame] = {}
#: Bytes of the source table up to which derived tables are persisted. They have some fifty times as many bytes with all
#: their columns, and what memory cannot hold would go to disk; of larger ones each query computes the columns it reads.
KEEP_BYTES = 64 << 20
#: Scores that most queries read several times: of larger sources they are stored once, compressed, and read by column.
_STORED = ("bone", "recovery")


def _table_bytes(spark: SparkSession, sf: str, name: str) -> int:
    return int(str(fx.table(spark, sf, name)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def kept(spark: SparkSession, sf: str, name: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _KEPT:
        built = _BUILDERS[name](spark, sf)
        if _table_bytes(spark, sf, "embeddings" if name == "vectors" else "lineitem") <= KEEP_BYTES:
            built = built.persist()
        elif name in _STORED:
            built = staged(built)
        _KEPT[key] = built
    return _KEPT[key]


def forget() -> None:
    for df in _KEPT.values():
        try:
            df.unpersist()
        except Exception:  # the session is gone
            pass
    _KEPT.clear()


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["athlete_id", "date", "day", *bone_stress.INPUT_COLUMNS]
    return running.enrich_running(fx.daily(spark, sf)).select(*columns, "running_elevation_gain", "load", "duration")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    front = frontier.enrich_frontier(
        kept(spark, sf, "bone"), kept(spark, sf, "embeddings"), fx.predictions(spark, sf), fx.contrastive(spark, sf),
        fx.events(spark, sf), fx.STATE_DIM,
    )
    return alerts.add_alerts(front)


_BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "daily": fx.daily,
    "enriched": _enriched,
    "bone": lambda s, d: bone_stress.bone_stress_history(kept(s, d, "enriched")),
    "embeddings": fx.embeddings,
    "scored": _scored,
    "recovery": lambda s, d: recovery.recovery_history(recovery.recovery_inputs(kept(s, d, "embeddings"), kept(s, d, "daily"))),
    "bone_periods": lambda s, d: periods.bone_periods(kept(s, d, "bone")),
    "risk_periods": lambda s, d: periods.risk_periods(kept(s, d, "recovery")),
    "vectors": lambda s, d: embeddings.rolling_anomaly(fx.vectors(s, d), fx.VECTOR_DIM),
}


def show(df: DataFrame, keys: list[str], doubles: list[str], others: list[str] | tuple[str, ...] = (), digits: int = 4) -> DataFrame:
    """Keys, rounded doubles, other columns; counts as bigint."""
    types = dict(df.dtypes)

    def plain(c: str):
        return F.col(c).cast("bigint").alias(c) if types[c] in ("int", "smallint") else F.col(c)

    return df.select(*[plain(c) for c in keys], *[F.round(F.col(c) + NUDGE, n).alias(c) for c, n in column_digits(doubles, digits)], *[plain(c) for c in others])


def table_query(
    name: str, covers: str, spark: Callable[[SparkSession, str], DataFrame], source: str, doubles: list[str],
    others: list[str] | tuple[str, ...] = (), keys: tuple[str, ...] = ("athlete_id", "date"), digits: int = 4, where: str = "",
) -> None:
    """A query whose two sides are the same columns of two tables."""
    sql = build(rounded(source, list(keys), doubles, list(others), digits) + where, source)
    add(name, covers, lambda s, d: show(spark(s, d), list(keys), doubles, others, digits), sql)


# --- ingestion and roll-up -----------------------------------------------------------------

_ACT = ["activity_distance_m", "activity_duration_seconds", "activity_avg_hr", "activity_max_hr", "activity_training_load"]
_ACT_KEYS = ("athlete_id", "date", "source_file", "record_ordinal")
table_query(
    "activity_dedup_by_id", "U02", lambda s, d: activities.dedup_by_id(fx.activities(s, d)), "dedup1", _ACT,
    ["activity_id", "activity_type"], _ACT_KEYS,
)
table_query(
    "activity_dedup_signature", "U02", lambda s, d: activities.deduplicate(fx.activities(s, d)), "dedup2", _ACT,
    ["activity_id", "activity_type"], _ACT_KEYS,
)
add(
    "activity_first_per_id", "U03",
    lambda s, d: show(activities.first_per_id(fx.activities(s, d)), list(_ACT_KEYS), [], ["activity_id"]),
    build(
        "select athlete_id, date, source_file, record_ordinal, activity_id from (select *, row_number() over (partition by athlete_id, activity_id "
        "order by source_file, record_ordinal) as rn from acts) where rn = 1", "acts",
    ),
)
table_query(
    "sport_family_speed_cap", "F05,P04",
    lambda s, d: activities.cap_run_distance(activities.with_sport_family(activities.deduplicate(fx.activities(s, d)))),
    "capped", ["activity_distance_m"], ["sport_family"], _ACT_KEYS,
)
_FAMILY_COLS = [
    f"{f}_{m}"
    for f in ("running", "cycling", "hiking", "swimming", "other")
    for m in ("duration_seconds", "distance_m", "training_load", "elevation_gain", "avg_hr", "max_hr", "aerobic_training_effect", "anaerobic_training_effect")
]
_DAY_COLS = [
    "activity_duration_seconds", "activity_distance_m", "activity_avg_hr", "activity_max_hr", "activity_elevation_gain",
    "activity_aerobic_training_effect", "activity_anaerobic_training_effect", "activity_training_load",
]
_COUNTS = ["activity_count", "activity_type_count", *[f"{f}_activity_count" for f in ("running", "cycling", "hiking", "swimming", "other")]]
table_query(
    "sport_family_daily_rollup", "A01,A02", lambda s, d: activities.activities_to_daily(fx.activities(s, d)), "roll",
    _DAY_COLS + _FAMILY_COLS, _COUNTS,
)
_WEIGHTED = ["impact_weighted_duration_seconds", "impact_weighted_distance_m", "fatigue_weighted_duration_seconds"]
table_query("weighted_load_daily", "A03", lambda s, d: activities.activities_to_daily(fx.activities(s, d)), "roll", _WEIGHTED)
_WELL = ["readiness_score", "readiness_hrvWeeklyAverage", "wellness_restingHeartRate", "sleep_total_seconds"]
table_query(
    "daily_feature_table", "S13,J02,O01", lambda s, d: kept(s, d, "daily"), "daily",
    [*_DAY_COLS, *_WELL, "running_distance_m", *_WEIGHTED], ["activity_count"],
)
_PLAUSIBLE = """select athlete_id, date, source_file, record_ordinal, activity_distance_m from (
  select *, coalesce(activity_distance_m, 0) as dist, coalesce(activity_duration_seconds, 0) as dur, activity_aerobic_training_effect as te,
    case when coalesce(activity_duration_seconds, 0) <> 0 then coalesce(activity_distance_m, 0) / activity_duration_seconds end as sp from acts)
where (dist <= 0 or dur > 0) and (dist <= 0 or coalesce(sp <= 6.5e0, false)) and (dist <= 2000 or coalesce(sp between 1.8e0 and 6.5e0, false))
  and not (dist > 10000 and dur < 600) and not coalesce(dist > 15000 and te < 1.5e0, false) and not coalesce(dist > 25000 and te < 2.0e0, false)"""
add(
    "plausible_activities", "P03",
    lambda s, d: show(activities.plausible_runs(fx.activities(s, d)), list(_ACT_KEYS), ["activity_distance_m"]),
    build(_PLAUSIBLE, "acts"),
)
_TOTALS = """select athlete_id, date, sum(activity_distance_m) as running_distance_json_m, sum(activity_duration_seconds) as running_duration_json_s from (
  select *, activity_distance_m / activity_duration_seconds as sp, activity_aerobic_training_effect as te from (
    select *, row_number() over (partition by athlete_id, activity_id order by source_file, record_ordinal) as rn from acts where source_file like 'summarized%')
  where rn = 1 and activity_type like '%run%')
where sp <= 6.5e0 and (activity_distance_m <= 2000 or sp >= 1.8e0) and not (activity_distance_m > 10000 and activity_duration_seconds < 600)
  and not (activity_distance_m > 15000 and te < 1.5e0) and not (activity_distance_m > 25000 and te < 2e0) group by all"""


def _summary_totals(s: SparkSession, d: str) -> DataFrame:
    return activities.summary_running_totals(fx.activities(s, d).filter(F.col("source_file").contains("summarizedActivities")))


add(
    "summary_running_totals", "A05,U03,P03",
    lambda s, d: show(_summary_totals(s, d), ["athlete_id", "date"], ["running_distance_json_m", "running_duration_json_s"]),
    build(_TOTALS, "acts"),
)


def _overridden(s: SparkSession, d: str) -> DataFrame:
    base = running.with_sane_distance(daily.canonical(kept(s, d, "daily"), bone_stress.fixed.CANONICAL, bone_stress.fixed.CANONICAL_RUNNING))
    return daily.override_running(base, _summary_totals(s, d))


add(
    "summary_override_running", "J16,J01",
    lambda s, d: show(_overridden(s, d), ["athlete_id", "date"], ["running_distance", "running_duration", "running_avg_speed"]),
    build(
        f"""select athlete_id, date, round(dist, 4) as running_distance, round(dur, 4) as running_duration,
  round(case when dur > 0 then coalesce(dist, 0) / dur end, 4) as running_avg_speed
from (select c.athlete_id, c.date, coalesce(t.running_distance_json_m, c.running_distance) as dist, coalesce(t.running_duration_json_s, c.running_duration) as dur
  from canon c left join ({_TOTALS}) t using (athlete_id, date))""",
        "canon", "acts",
    ),
)
table_query(
    "canonical_running", "P02,F23,F28", lambda s, d: kept(s, d, "enriched"), "canon",
    ["readiness", "hrv", "resting_hr", "sleep", "body_battery_charged", "body_battery_drained", "running_distance", "running_duration", "running_avg_hr", "running_max_hr", "running_aerobic_te", "running_anaerobic_te"],
)
_DAY = ["athlete_id", "date"]
add(
    "distinct_days", "U05", lambda s, d: daily.distinct_days(fx.activities(s, d)),
    build("select distinct athlete_id, date from acts", "acts"),
)
add(
    "one_row_per_day", "U04",
    lambda s, d: show(
        daily.one_per_day(fx.activities(s, d), [F.col("source_file").desc(), F.col("record_ordinal").desc()]),
        ["athlete_id", "date"], ["activity_distance_m"], ["record_ordinal"],
    ),
    build(
        "select athlete_id, date, activity_distance_m, record_ordinal from (select *, row_number() over (partition by athlete_id, date order by source_file desc, record_ordinal desc) as rn from acts) where rn = 1",
        "acts",
    ),
)


def _generic(s: SparkSession, d: str) -> DataFrame:
    raw = fx.activities(s, d).select(
        "athlete_id", "date", "source_file", "record_ordinal", F.col("activity_avg_hr").cast("string").alias("rate"),
        F.when(F.col("record_ordinal") % 3 != 0, F.col("activity_type")).alias("kind"),
    )
    return daily.daily_means(raw, "markers")


add(
    "generic_daily_means", "A04,P01,S07",
    lambda s, d: show(_generic(s, d), ["athlete_id", "date"], ["rate"], ["kind", "markers_record_count"]),
    build(
        """select athlete_id, date, round(avg(activity_avg_hr), 4) as rate, arg_max(activity_type, (source_file, record_ordinal)) filter (where record_ordinal % 3 <> 0) as kind,
  count(*) as markers_record_count from acts group by all""",
        "acts",
    ),
)
add(
    "category_counts", "A06",
    lambda s, d: daily.category_counts({"activities": fx.activities(s, d), "wellness": fx.wellness(s, d), "daily_rows": kept(s, d, "daily")}),
    build(
        "select 'activities' as category, count(*) as records from acts union all select 'wellness', count(*) from well union all select 'daily_rows', count(*) from daily",
        "acts", "well", "daily",
    ),
)
add(
    "stacked_sources", "U01,S12",
    lambda s, d: daily.stack(
        [
            fx.activities(s, d).filter(F.col("source_file").endswith(k)).select("athlete_id", "date", F.lit(k).alias("kind"), *extra)
            for k, extra in ((".json", ["activity_id"]), (".tcx", ["activity_avg_hr"]), (".fit", ["activity_training_load"]))
        ]
    ).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("activity_id").alias("ids"), F.count("activity_avg_hr").alias("rates"), F.count("activity_training_load").alias("loads")),
    build(
        """select kind, count(*) as n, count(*) filter (where kind = '.json' and activity_id is not null) as ids, count(*) filter (where kind = '.tcx' and activity_avg_hr is not null) as rates,
  count(*) filter (where kind = '.fit' and activity_training_load is not null) as loads from (select *, regexp_extract(source_file, '\\.[a-z]+$') as kind from acts) group by kind""",
        "acts",
    ),
)

# --- trailing windows ----------------------------------------------------------------------

table_query(
    "running_load_7d_28d_acwr", "C01,C02,W05,W06", lambda s, d: kept(s, d, "enriched"), "enr",
    ["running_bone_stress_load:1", "running_7d_load_sum:1", "running_28d_load_sum:1", "running_7d_sum_m", "running_28d_sum_m", "running_7d_acwr", "running_avg_speed"],
)
add(
    "foster_monotony_strain", "W07,F19,F20",
    lambda s, d: show(
        trailing.monotony(kept(s, d, "enriched")).withColumns(
            {
                "monotony_risk": bone_stress.risk.monotony_risk("foster_monotony"),
                "strain_risk": bone_stress.risk.strain_risk("foster_strain"),
            }
        ),
        ["athlete_id", "date"], ["foster_monotony", "foster_strain", "monotony_risk", "strain_risk"], digits=1,
    ),
    build(
        """select athlete_id, date, round(foster_monotony, 1) as foster_monotony, round(foster_strain, 1) as foster_strain,
  round(case when foster_monotony <= 0 then 0e0 when foster_monotony < 1.5e0 then 20e0 when foster_monotony < 2 then 40e0 when foster_monotony < 2.5e0 then 65e0 else 85e0 end, 1) as monotony_risk,
  round(case when foster_strain <= 0 then 0e0 else 100e0 * (1e0 - exp(-foster_strain / 250000e0)) end, 1) as strain_risk from fost""",
        "fost",
    ),
)
table_query(
    "literature_score_daily", "C04,F14,F15,F16,F17,F18,F21,F22", lambda s, d: bone_stress.literature_track(kept(s, d, "enriched")), "lit",
    ["literature_bone_stress_score", "run7_km"], ["literature_bone_stress_level"],
)


def _trailing_percentile(s: SparkSession, d: str) -> DataFrame:
    ranks = [trailing.Rank("load_rank", "running_bone_stress_load"), trailing.Rank("hrv_rank", "hrv", high=False)]
    return trailing.trailing_rows(trailing.add_ranks(kept(s, d, "enriched"), ranks), 28)


add(
    "trailing_percentile_28d", "W01,W02,J07",
    lambda s, d: show(_trailing_percentile(s, d), ["athlete_id", "date"], ["load_rank", "hrv_rank"], ["history_rows"]),
    build(
        """select a.athlete_id, a.date, count(b.day) as history_rows,
  round(case when count(b.day) < 7 then 0 else count(*) filter (where b.running_bone_stress_load <= a.running_bone_stress_load)::double / count(b.day) * 100 end, 4) as load_rank,
  round(case when a.hrv is null or count(b.hrv) < 7 then 0 else 100 - count(*) filter (where b.hrv <= a.hrv)::double / count(b.hrv) * 100 end, 4) as hrv_rank
from enr a left join enr b on a.athlete_id = b.athlete_id and b.day between a.day - 28 and a.day - 1
group by a.athlete_id, a.date, a.running_bone_stress_load, a.hrv""",
        "enr",
    ),
)


def _rolling(s: SparkSession, d: str) -> DataFrame:
    ranks = [
        trailing.RollingRank("load_rank", "running_bone_stress_load", 7, 28),
        trailing.RollingRank("long_rank", "running_distance", 28, 56),
        trailing.RollingRank("speed_rank", "running_avg_speed", 7, 28, mean=True),
    ]
    return trailing.add_ranks(kept(s, d, "enriched"), [], ranks)


def _naive_roll(column: str, d: int, b: int, agg: str, out: str) -> str:
    """Window sums inside each day's own slice, by joining the slice to itself."""
    current = f"round({agg}(x), 6)" if agg == "avg" else f"round(coalesce({agg}(x), 0), 6)"
    return f"""
  select t.athlete_id, t.day, round(case when n.slice_rows < {2 * d} or v.k < 7 or n.cur is null then 0 else v.hits::double / v.k * 100 end, 4) as {out}
  from src t
  join (select a.athlete_id, a.day, count(b.day) as slice_rows, (select {current} from (select c.{column} as x from src c where c.athlete_id = a.athlete_id and c.day between a.day - {d} and a.day - 1)) as cur
    from src a left join src b on a.athlete_id = b.athlete_id and b.day between a.day - {b + d} and a.day - 1 group by a.athlete_id, a.day) n using (athlete_id, day)
  left join (select w.athlete_id, w.day, count(*) as k, count(*) filter (where w.val <= c.cur) as hits
    from (select a.athlete_id, a.day, e.day as eday, round({agg}(f.{column}), 6) as val
      from src a join src e on e.athlete_id = a.athlete_id and e.day between a.day - {b + d} and a.day - {d + 1}
        join src f on f.athlete_id = a.athlete_id and f.day > e.day - {d} and f.day <= e.day and f.day >= a.day - {b + d}
      group by a.athlete_id, a.day, e.day having count(f.{column}) > 0) w
    join (select a.athlete_id, a.day, (select {current} from (select c.{column} as x from src c where c.athlete_id = a.athlete_id and c.day between a.day - {d} and a.day - 1)) as cur from src a) c using (athlete_id, day)
    group by w.athlete_id, w.day) v using (athlete_id, day)"""


add(
    "rolling_sum_percentile", "W03,W04",
    lambda s, d: show(_rolling(s, d), ["athlete_id", "date"], ["load_rank", "long_rank", "speed_rank"]),
    build(
        f"""select s.athlete_id, s.date, load_rank, long_rank, speed_rank from enr s
join ({_naive_roll('running_bone_stress_load', 7, 28, 'sum', 'load_rank').replace('src', 'enr')}) a using (athlete_id, day)
join ({_naive_roll('running_distance', 28, 56, 'sum', 'long_rank').replace('src', 'enr')}) b using (athlete_id, day)
join ({_naive_roll('running_avg_speed', 7, 28, 'avg', 'speed_rank').replace('src', 'enr')}) c using (athlete_id, day)""",
        "enr",
    ),
)
table_query(
    "recovery_strain_daily", "C03,F07", lambda s, d: bone_stress.score_recovery_strain(kept(s, d, "enriched")), "strain",
    ["readiness_risk", "hrv_risk", "resting_hr_risk", "sleep_risk", "body_battery_risk", "recovery_strain_score"],
)
add(
    "insufficient_rest_7d", "W09",
    lambda s, d: show(kept(s, d, "recovery"), ["athlete_id", "date"], ["insufficient_rest_score"]),
    build("select athlete_id, date, round(insufficient_rest_score, 4) as insufficient_rest_score from rec3", "rec3"),
)
add(
    "trailing_medians_28d", "W10",
    lambda s, d: show(
        trailing.trailing_medians(kept(s, d, "enriched"), ["readiness", "load", "hrv", "duration"]), ["athlete_id", "date"],
        ["median_readiness", "median_load", "median_hrv", "median_duration"],
    ),
    build(
        "select athlete_id, date, " + ", ".join(
            f"round(quantile_cont({c}, 0.5) over (partition by athlete_id order by day range between 28 preceding and 1 preceding), 4) as median_{c}"
            for c in ("readiness", "load", "hrv", "duration")
        ) + " from canon", "canon",
    ),
)
add(
    "trailing_share_28d", "W11",
    lambda s, d: show(
        trailing.trailing_share(kept(s, d, "enriched"), "load", "load", "load_share"), ["athlete_id", "date"], ["load_share"]
    ),
    build(
        """select athlete_id, date, round(case when load is not null and len(h) > 0 then len(list_filter(h, lambda u: u <= load))::double / len(h) * 100 end, 4) as load_share
from (select *, list(load) filter (where load is not null) over (partition by athlete_id order by day range between 28 preceding and 1 preceding) as h from canon)""",
        "canon",
    ),
)
add(
    "previous_row_values", "J06",
    lambda s, d: show(
        trailing.previous_rows(kept(s, d, "enriched"), ["running_distance", "load"]), ["athlete_id", "date"],
        ["prev_running_distance", "prev_load"],
    ),
    build(
        "select athlete_id, date, round(lag(running_distance) over w, 4) as prev_running_distance, round(lag(load) over w, 4) as prev_load from canon window w as (partition by athlete_id order by day)",
        "canon",
    ),
)
add(
    "previous_calendar_day", "J05",
    lambda s, d: show(
        daily.previous_day(kept(s, d, "enriched").select("athlete_id", "date", "load", "duration"), ["load", "duration"]),
        ["athlete_id", "date"], ["previous_day_load", "previous_day_duration"],
    ),
    build(
        "select athlete_id, date, case when lag(date) over w = date - 1 then round(lag(load) over w, 4) end as previous_day_load, case when lag(date) over w = date - 1 then round(lag(duration) over w, 4) end as previous_day_duration from canon window w as (partition by athlete_id order by date)",
        "canon",
    ),
)

# --- scores ------------------------------------------------------------------------------------

_BONE_D = [c for c in bone_stress.OUTPUT_COLUMNS if not c.endswith(("_level", "_zone", "_band", "_reason"))]
_BONE_T = [c for c in bone_stress.OUTPUT_COLUMNS if c not in _BONE_D]
table_query(
    "bone_stress_scores", "C05,C06,F06,F08,F09,F10,F11,F12,F13,L01", lambda s, d: kept(s, d, "bone"), "bone",
    [f"{c}:1" if c in ("foster_strain", "running_7d_load_sum", "running_28d_load_sum") else c for c in _BONE_D], _BONE_T
)
table_query(
    "accumulated_bone_state", "T1,T3,W08,F22", lambda s, d: kept(s, d, "bone"), "bh",
    ["daily_bone_stress_contribution", "accumulated_bone_stress_state", "bone_stress_carryover_score"], ["accumulated_bone_stress_level"],
)
table_query(
    "recovery_risk_scores", "C07,C08,L02,P12,J01", lambda s, d: kept(s, d, "recovery"), "rh",
    ["risk_score", "state_novelty_score", "recovery_strain_score", "prior_workload_score", "tissue_load_score", "metabolic_fatigue_score", "preparedness_mismatch_score", "run_under_recovered_score", "rest_context_score", "insufficient_rest_score", "readiness_risk", "hrv_risk", "resting_hr_risk", "sleep_risk", "body_battery_risk", "load", "duration", "impact_duration"],
    ["risk_level", "risk_reason"],
)
table_query(
    "accumulated_recovery_state", "T1,T4", lambda s, d: kept(s, d, "recovery"), "rh",
    ["daily_strain_contribution", "accumulated_risk_state"], ["accumulated_risk_level"],
)
_FRONT = [
    "embedding_novelty_score", "contrastive_novelty_score", "readiness_forecast_error", "readiness_absolute_forecast_error_score",
    "readiness_forecast_error_score", "reference_block_embedding_similarity", "reference_block_similarity_score", "frontier_strain_score",
]
table_query("frontier_strain", "C08,C09,C10,C11,E02,E04,J01,P11", lambda s, d: kept(s, d, "scored"), "fr", _FRONT, ["frontier_strain_level"])
table_query(
    "accumulated_frontier_state", "T2", lambda s, d: kept(s, d, "scored"), "fr", ["accumulated_frontier_state"],
    ["accumulated_frontier_level"],
)
table_query(
    "integrated_score", "C12,C13,L03", lambda s, d: kept(s, d, "scored"), "fr", ["integrated_bone_stress_score"],
    ["monitoring_signal_agreement"],
)
table_query(
    "alert_tiers", "L04,L05,L06", lambda s, d: kept(s, d, "scored"), "al", [],
    ["operational_alert_tier", "operational_alert_label", "counterfactual_hint", "operational_recommendation"],
)

# --- periods -------------------------------------------------------------------------------------

_RP = ["peak_accumulated_risk_state", "mean_accumulated_risk_state", "mean_recovery_strain", "mean_metabolic_fatigue", "mean_tissue_load", "min_readiness"]
table_query(
    "risk_periods", "G01,G03,G04", lambda s, d: kept(s, d, "risk_periods"), "rp", _RP,
    ["start_date", "end_date", "calendar_days", "elevated_days", "high_risk_days", "dominant_risk_reason", "period_level", "period_summary"],
    ("athlete_id", "period_id"),
)
_BP = [
    "peak_accumulated_bone_stress_state", "mean_accumulated_bone_stress_state", "peak_running_7d_km", "mean_running_7d_km",
    "mean_running_7d_load_score", "mean_running_progression_score", "mean_running_intensity_score",
]
add(
    "high_day_blocks", "G02",
    lambda s, d: periods.high_day_blocks(kept(s, d, "bone")),
    build(
        "select athlete_id, period_id::bigint as period_id, date '1970-01-01' + a::integer as start_date, date '1970-01-01' + b::integer as end_date, elevated_days from blocks",
        "blocks",
    ),
)
table_query(
    "bone_periods", "G02,G03,G04", lambda s, d: kept(s, d, "bone_periods"), "bp", _BP,
    ["start_date", "end_date", "calendar_days", "elevated_days", "high_bone_stress_days", "dominant_bone_stress_reason", "period_level", "period_summary"],
    ("athlete_id", "period_id"),
)
