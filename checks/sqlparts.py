"""Building blocks of the SQL twins: common table expressions by name.

Written for DuckDB, independently of the Spark side: windows become list
aggregates, carries become closed forms or recursion, and joins stay joins.
"""

from __future__ import annotations

HISTORY = "partition by athlete_id order by day"


def clamp(x: str) -> str:
    return f"(case when ({x}) is not null then least(greatest(({x}), 0e0), 100e0) end)"


def z(x: str) -> str:
    return f"coalesce({x}, 0e0)"


def acwr_risk(r: str) -> str:
    return (
        f"(case when {r} is null then 0e0 when {r} < 0.8e0 then 25e0 when {r} <= 1e0 then 20e0 when {r} <= 1.3e0 then 35e0 "
        f"when {r} <= 1.5e0 then 65e0 when {r} <= 1.8e0 then 85e0 else 100e0 end)"
    )


def acwr_zone(r: str) -> str:
    return (
        f"(case when {r} is null then 'unknown' when {r} < 0.8e0 then 'undertraining' when {r} <= 1.3e0 then 'sweet_spot' "
        f"when {r} <= 1.5e0 then 'elevated_progression' else 'danger_zone' end)"
    )


def speed_risk(s: str) -> str:
    return f"(case when {s} is null then 0e0 when {s} <= 2.5e0 then 15e0 when {s} <= 3.5e0 then 40e0 when {s} <= 4.5e0 then 75e0 else 95e0 end)"


def speed_band(s: str) -> str:
    return (
        f"(case when {s} is null or {s} <= 0 then 'none' when {s} <= 2.5e0 then 'low_magnitude' when {s} <= 3.5e0 then 'moderate' "
        f"when {s} <= 4.5e0 then 'elevated' else 'high_magnitude' end)"
    )


def volume_risk(k: str) -> str:
    return (
        f"(case when {k} is null then 0e0 when {k} <= 15 then 10e0 when {k} <= 30 then 25e0 when {k} <= 50 then 40e0 "
        f"when {k} <= 70 then 55e0 when {k} <= 90 then 70e0 when {k} <= 110 then 82e0 when {k} <= 130 then 92e0 else 100e0 end)"
    )


def monotony_risk(m: str) -> str:
    return f"(case when {m} <= 0 then 0e0 when {m} < 1.5e0 then 20e0 when {m} < 2 then 40e0 when {m} < 2.5e0 then 65e0 else 85e0 end)"


def strain_risk(s: str) -> str:
    return f"(case when {s} <= 0 then 0e0 else least(100e0 * (1e0 - exp(-({s}) / 250000e0)), 100e0) end)"


def readiness_risk(v: str) -> str:
    return f"(case when {v} is null then 0e0 when {v} <= 20 then 100e0 when {v} <= 35 then 80e0 when {v} <= 50 then 55e0 else 0e0 end)"


def level(x: str) -> str:
    return f"(case when {x} >= 70 then 'high' when {x} >= 45 then 'moderate' else 'low' end)"


def state_level(x: str) -> str:
    return f"(case when {x} >= 65 then 'high' when {x} >= 45 then 'moderate' else 'low' end)"


def hard(speed: str, km: str) -> str:
    return f"coalesce({speed} >= 3.5e0 and {km} >= 5, false)"


def workout_risk(a: str, n: str) -> str:
    steady = f"least(greatest(({z(a)} - 1.75e0) / 2e0 * 100e0, 0e0), 100e0)"
    sharp = f"least(greatest({z(n)} / 1.5e0 * 100e0, 0e0), 100e0)"
    return f"least(greatest({steady}, {sharp} * 1.05e0), 100e0)"


def blend(rel: str, ab: str, w: str = "0.45e0", v: str = "(1e0 - 0.45e0)") -> str:
    return f"least(greatest({w} * {rel} + {v} * {ab}, 0e0), 100e0)"


def literature(ratio: str, speed: str, km: str, mono: str, strain: str) -> str:
    vol = volume_risk(km)
    prog = f"least(0.65e0 * {acwr_risk(ratio)} + 0.35e0 * {vol}, 100e0)"
    mag = speed_risk(speed)
    ctx = f"(0.35e0 + 0.65e0 * {vol} / 100e0)"
    mon = f"({monotony_risk(mono)} * {ctx})"
    stn = f"({strain_risk(strain)} * {ctx})"
    blended = f"least(0.28e0 * {vol} + 0.27e0 * {prog} + 0.20e0 * {mag} + 0.15e0 * {mon} + 0.10e0 * {stn}, 100e0)"
    spikes = [
        f"case when {acwr_zone(ratio)} in ('elevated_progression', 'danger_zone') then {prog} * 0.92e0 else 0e0 end",
        f"case when {mono} >= 2 then {mon} * 0.85e0 else 0e0 end",
        f"case when {hard(speed, f'({km} / 7e0)')} then {mag} * 0.80e0 else 0e0 end",
    ]
    return f"least(greatest({blended}, {', '.join(spikes)}), 100e0)"


def pct(hist: str, value: str, high: bool = True) -> str:
    share = f"len(list_filter({hist}, lambda u: u <= {value}))::double / len({hist}) * 100"
    shown = share if high else f"100e0 - {share}"
    return f"(case when {value} is null or coalesce(len({hist}), 0) < 7 then 0e0 else {shown} end)"


def num(x: str, d: int = 1) -> str:
    """Number as text with separators, or unknown."""
    return f"coalesce(format('{{:,.{d}f}}', {x}), 'unknown')"


def fx(x: str, d: int = 0) -> str:
    return f"format('{{:.{d}f}}', {x})"


def exact(x: str, d: int) -> str:
    """Half-even rounding of the exact binary value."""
    return f"cast(format('{{:.{d}f}}', {x}) as double)"


FAMILIES = {
    "running": "activity_type like '%run%'",
    "cycling": "(activity_type like '%cycl%' or activity_type like '%bik%')",
    "hiking": "(activity_type like '%hik%' or activity_type like '%walk%')",
    "swimming": "activity_type like '%swim%'",
}

C: dict[str, tuple[list[str], str]] = {}

C["acts"] = (
    [],
    """
  select l_suppkey as athlete_id,
    case when l_partkey % 10 <> 0 then l_orderkey * 10 + l_linenumber end as activity_id,
    date '2020-01-01' + cast(datediff('day', date '1970-01-01', cast(l_shipdate as date)) % 700 as integer) as date,
    case when l_linestatus = 'O' then 'summarizedActivities_' || l_suppkey || '.json'
         when l_returnflag = 'R' then 'a_' || l_suppkey || '.tcx' else 'a_' || l_suppkey || '.fit' end as source_file,
    l_partkey * 100000000 + cast(round(l_extendedprice * 100) as bigint) as record_ordinal,
    case l_linenumber when 1 then 'running' when 2 then 'trail_running' when 3 then 'track_running' when 4 then 'road_biking'
      when 5 then 'hiking' when 6 then 'lap_swimming' else 'strength_training' end as activity_type,
    l_quantity * 500 as activity_distance_m,
    l_quantity * 0.5e0 * (case when l_partkey % 97 = 0 then 100 else 200 + l_partkey % 350 end) as activity_duration_seconds,
    case when l_orderkey % 11 <> 0 then cast(110 + l_partkey % 70 as double) end as activity_avg_hr,
    cast(115 + l_partkey % 70 + l_orderkey % 20 as double) as activity_max_hr,
    cast(l_orderkey % 300 as double) as activity_elevation_gain,
    cast(l_orderkey % 50 as double) / 10e0 as activity_aerobic_training_effect,
    cast(l_partkey % 30 as double) / 10e0 as activity_anaerobic_training_effect,
    l_quantity * 4 as activity_training_load,
    case when l_linestatus = 'O' then 3 when l_returnflag = 'R' then 2 else 1 end as prio,
    9 + (case when l_partkey % 10 <> 0 then 1 else 0 end) - (case when l_orderkey % 11 = 0 then 1 else 0 end) as filled
  from lineitem""",
)
C["dedup1"] = (
    ["acts"],
    """
  select * exclude (rn) from (
    select *, row_number() over (partition by athlete_id, activity_id order by prio desc, filled desc, source_file, record_ordinal) as rn
    from acts)
  where activity_id is null or rn = 1""",
)
C["dedup2"] = (
    ["dedup1"],
    """
  select * exclude (rn) from (
    select *, row_number() over (
      partition by athlete_id, date, activity_type, round_even(activity_duration_seconds, 0), round_even(activity_distance_m, 0),
        round_even(activity_avg_hr, 0), round_even(activity_max_hr, 0)
      order by (activity_id is not null) desc, prio desc, filled desc, source_file, record_ordinal) as rn
    from dedup1)
  where rn = 1""",
)
_family_case = "case " + " ".join(f"when {cond} then '{f}'" for f, cond in FAMILIES.items()) + " else 'other' end"
C["capped"] = (
    ["dedup2"],
    f"""
  select * replace (case when sport_family = 'running' and activity_duration_seconds > 0
      and activity_distance_m > activity_duration_seconds * 6.5e0 then activity_duration_seconds * 6.5e0 else activity_distance_m end
      as activity_distance_m)
  from (select *, {_family_case} as sport_family from dedup2)""",
)


def _family_sql() -> str:
    out = []
    for f in [*FAMILIES, "other"]:
        mine = f"filter (where sport_family = '{f}')"
        out.append(f"count(*) {mine} as {f}_activity_count")
        for c in ("duration_seconds", "distance_m", "training_load", "elevation_gain"):
            out.append(f"sum(activity_{c}) {mine} as {f}_{c}")
        for c in ("avg_hr", "max_hr", "aerobic_training_effect", "anaerobic_training_effect"):
            out.append(f"avg(activity_{c}) {mine} as {f}_{c}")
    return ",\n    ".join(out)


C["roll"] = (
    ["capped"],
    f"""
  select *,
    {z('running_duration_seconds')} * 1e0 + {z('hiking_duration_seconds')} * 0.65e0 + {z('cycling_duration_seconds')} * 0.15e0 as impact_weighted_duration_seconds,
    {z('running_distance_m')} * 1e0 + {z('hiking_distance_m')} * 0.6e0 + {z('cycling_distance_m')} * 0.05e0 as impact_weighted_distance_m,
    {z('running_duration_seconds')} * 1e0 + {z('hiking_duration_seconds')} * 0.85e0 + {z('cycling_duration_seconds')} * 0.8e0 as fatigue_weighted_duration_seconds
  from (select athlete_id, date, count(*) as activity_count, count(distinct activity_type) as activity_type_count,
    sum(activity_duration_seconds) as activity_duration_seconds, sum(activity_distance_m) as activity_distance_m,
    avg(activity_avg_hr) as activity_avg_hr, max(activity_max_hr) as activity_max_hr, avg(activity_elevation_gain) as activity_elevation_gain,
    avg(activity_aerobic_training_effect) as activity_aerobic_training_effect,
    avg(activity_anaerobic_training_effect) as activity_anaerobic_training_effect,
    sum(activity_training_load) as activity_training_load,
    {_family_sql()}
  from capped group by athlete_id, date)""",
)
C["sums"] = (
    [],
    """
  select l_suppkey as athlete_id,
    date '2020-01-01' + cast(datediff('day', date '1970-01-01', cast(l_shipdate as date)) % 700 as integer) as date,
    cast(sum(l_orderkey) as bigint) as so, cast(sum(l_partkey) as bigint) as sp
  from lineitem group by all""",
)
C["well"] = (
    ["sums"],
    """
  select athlete_id, date, case when so % 5 <> 0 then (20 + sp % 75)::double end as readiness_score,
    (40 + sp % 41)::double as readiness_hrvWeeklyAverage, (42 + so % 14)::double as wellness_restingHeartRate,
    (18000 + (sp * 7) % 14400)::double as sleep_total_seconds, ((so * 3) % 80)::double as wellness_bodyBattery_chargedValue,
    ((so * 5) % 80)::double as wellness_bodyBattery_drainedValue
  from sums""",
)
C["daily"] = (["roll", "well"], "\n  select * from roll full join well using (athlete_id, date)")
C["canon"] = (
    ["daily"],
    """
  select athlete_id, date, datediff('day', date '1970-01-01', date) as day,
    readiness_score as readiness, readiness_hrvWeeklyAverage as hrv, wellness_restingHeartRate as resting_hr,
    sleep_total_seconds as sleep, wellness_bodyBattery_chargedValue as body_battery_charged,
    wellness_bodyBattery_drainedValue as body_battery_drained, activity_training_load as load,
    activity_duration_seconds as duration, activity_distance_m as distance, cycling_duration_seconds as cycling_duration,
    cycling_distance_m as cycling_distance, round(impact_weighted_duration_seconds, 6) as impact_duration,
    round(impact_weighted_distance_m, 6) as impact_distance, round(fatigue_weighted_duration_seconds, 6) as fatigue_duration,
    running_duration_seconds as running_duration,
    case when coalesce(running_distance_m, 0) <= 0 then 0e0 when coalesce(running_duration_seconds, 0) <= 0 then running_distance_m
      else least(running_distance_m, running_duration_seconds * 6.5e0) end as running_distance,
    round(running_avg_hr, 6) as running_avg_hr, round(running_max_hr, 6) as running_max_hr, running_elevation_gain,
    round(running_aerobic_training_effect, 6) as running_aerobic_te, round(running_anaerobic_training_effect, 6) as running_anaerobic_te
  from daily""",
)


def enrich(source: str) -> str:
    """Running load, sums and ratio on a canonical table."""
    return f"""
  select *, case when running_28d_load_sum > 0 then round(4e0 * running_7d_load_sum / running_28d_load_sum, 6) end as running_7d_acwr
  from (select *,
      round(sum(running_bone_stress_load) over w7, 6) as running_7d_load_sum,
      round(sum(running_bone_stress_load) over w28, 6) as running_28d_load_sum,
      sum(running_distance) over w7 as running_7d_sum_m, sum(running_distance) over w28 as running_28d_sum_m
    from (select *, round(running_distance + {z('running_duration')} * {z('running_avg_speed')} * 0.45e0 + {z('running_elevation_gain')}
        + {z('running_aerobic_te')} * 2500e0 + {z('running_anaerobic_te')} * 5000e0
        + {z('running_avg_hr')} * {z('running_duration')} / 3600e0 * 30e0, 6) as running_bone_stress_load
      from (select *, case when running_duration > 0 then round(running_distance / running_duration, 6) end as running_avg_speed
        from {source}))
    window w7 as ({HISTORY} range between 6 preceding and current row),
      w28 as ({HISTORY} range between 27 preceding and current row))"""


C["enr"] = (["canon"], enrich("canon"))


def foster(source: str, column: str, keep: str = "*") -> str:
    return f"""
  select * exclude (ws, wm, wd), case when ws > 0 then (case when wd > 0 then least(round(wm / wd, 9), 10e0) else 10e0 end) else 0e0 end as foster_monotony,
    greatest(ws, 0e0) * (case when ws > 0 then (case when wd > 0 then least(round(wm / wd, 9), 10e0) else 10e0 end) else 0e0 end) as foster_strain
  from (select {keep}, sum(coalesce({column}, 0)) over w as ws, avg(coalesce({column}, 0)) over w as wm, stddev_pop(coalesce({column}, 0)) over w as wd
    from {source} window w as ({HISTORY} range between 6 preceding and current row))"""


C["fost"] = (["enr"], foster("enr", "running_bone_stress_load"))
C["lit"] = (
    ["fost"],
    f"""
  select *, {level('literature_bone_stress_score')} as literature_bone_stress_level
  from (select *, {literature('running_7d_acwr', 'running_avg_speed', 'run7_km', 'foster_monotony', 'foster_strain')} as literature_bone_stress_score
    from (select *, coalesce(running_7d_sum_m, 0e0) / 1000e0 as run7_km from fost))""",
)

# --- recovery markers ------------------------------------------------------------------

_MARKERS = ["readiness", "hrv", "resting_hr", "sleep", "body_battery_charged", "body_battery_drained"]


def hist_columns(columns: list[str]) -> str:
    return ",\n      ".join(f"list({c}) filter (where {c} is not null) over h28 as h_{c}" for c in columns)


H28 = f"window h28 as ({HISTORY} range between 28 preceding and 1 preceding)"


def marker_risks() -> str:
    return f"""greatest({readiness_risk('readiness')}, {pct('h_readiness', 'readiness', False)}) as readiness_risk,
      {pct('h_hrv', 'hrv', False)} as hrv_risk, {pct('h_resting_hr', 'resting_hr')} as resting_hr_risk, {pct('h_sleep', 'sleep', False)} as sleep_risk,
      greatest({pct('h_body_battery_charged', 'body_battery_charged', False)}, {pct('h_body_battery_drained', 'body_battery_drained')}) as body_battery_risk"""


STRAIN = "least(0.45e0 * readiness_risk + 0.2e0 * hrv_risk + 0.15e0 * resting_hr_risk + 0.1e0 * sleep_risk + 0.1e0 * body_battery_risk, 100e0)"

C["strain"] = (
    ["canon"],
    f"""
  select *, {STRAIN} as recovery_strain_score from (select athlete_id, date, day, {marker_risks()}
    from (select *, {hist_columns(_MARKERS)} from canon {H28}))""",
)

# --- rolling ranks -----------------------------------------------------------------------


def roll_layer(column: str, d: int, b: int, mean: bool = False) -> str:
    agg, n = ("avg" if mean else "sum"), f"{'mean' if mean else 'sum'}{d}_{column}"
    now = f"round({agg}({column}) over (range_{d}), 6)"
    frame = f"({HISTORY} range between {d} preceding and 1 preceding)"
    now = f"round({agg}({column}) over {frame}, 6)"
    return (
        f"round({agg}({column}) over ({HISTORY} range between {d - 1} preceding and current row), 6) as r_{n}, "
        f"{now if mean else f'coalesce({now}, 0e0)'} as now_{n}, "
        f"count(*) over ({HISTORY} range between {b + d} preceding and 1 preceding) as rows_{n}"
    )


def roll_lists(column: str, d: int, b: int, mean: bool = False) -> str:
    n = f"{'mean' if mean else 'sum'}{d}_{column}"
    return (
        f"list(r_{n}) filter (where r_{n} is not null) over ({HISTORY} range between {b + 1} preceding and {d + 1} preceding) as whole_{n}, "
        f"list({column}) over ({HISTORY} range between {b + d} preceding and {b + 2} preceding) as cut_{n}"
    )


def roll_values(column: str, d: int, b: int, mean: bool = False) -> str:
    n = f"{'mean' if mean else 'sum'}{d}_{column}"
    agg = "list_avg" if mean else "list_sum"
    early = f"list_transform(range(1, coalesce(len(cut_{n}), 0) + 1), lambda i: round({agg}(list_slice(cut_{n}, 1, i)), 6))"
    return f"list_filter(list_concat(coalesce(whole_{n}, []), {early}), lambda u: u is not null) as vals_{n}"


def roll_score(column: str, d: int, mean: bool = False) -> str:
    n = f"{'mean' if mean else 'sum'}{d}_{column}"
    return f"(case when rows_{n} < {2 * d} then 0e0 else {pct(f'vals_{n}', f'now_{n}')} end)"


ROLLS = [
    ("running_bone_stress_load", 7, 28, False),
    ("running_bone_stress_load", 28, 56, False),
    ("running_distance", 7, 28, False),
    ("running_distance", 28, 56, False),
    ("running_avg_speed", 7, 28, True),
]
_RANKED = [
    "running_bone_stress_load", "running_duration", "running_distance", "running_7d_acwr", "running_aerobic_te",
    "running_anaerobic_te", "running_avg_speed", "running_avg_hr", "running_max_hr", *_MARKERS,
]

C["ranked1"] = (
    ["lit"],
    f"""
  select *, lag(running_bone_stress_load) over o as p_load, lag(running_duration) over o as p_duration, lag(running_distance) over o as p_distance,
    {', '.join(roll_layer(*r) for r in ROLLS)}
  from lit window o as ({HISTORY})""",
)
C["ranked2"] = (
    ["ranked1"],
    f"""
  select *, {', '.join(roll_values(*r) for r in ROLLS)}
  from (select *, {hist_columns(_RANKED)}, {', '.join(roll_lists(*r) for r in ROLLS)} from ranked1 {H28})""",
)
C["ranked3"] = (
    ["ranked2"],
    f"""
  select athlete_id, date, day, readiness, run7_km, running_duration, running_distance, running_avg_speed, running_aerobic_te, running_anaerobic_te,
    running_7d_acwr, running_7d_sum_m, running_28d_sum_m, running_7d_load_sum, running_28d_load_sum, running_7d_sum_m as s7, p_distance,
    foster_monotony, foster_strain, literature_bone_stress_score, literature_bone_stress_level,
    {marker_risks()},
    greatest({pct('h_running_bone_stress_load', 'p_load')}, {pct('h_running_duration', 'p_duration')}, {pct('h_running_distance', 'p_distance')}) as prior_run,
    greatest({pct('h_running_bone_stress_load', 'running_bone_stress_load')}, {pct('h_running_duration', 'running_duration')}, {pct('h_running_distance', 'running_distance')}) as same_day,
    {pct('h_running_7d_acwr', 'running_7d_acwr')} as acwr_rank,
    least(greatest({pct('h_running_aerobic_te', 'running_aerobic_te')}, {pct('h_running_anaerobic_te', 'running_anaerobic_te')} * 1.1e0), 100e0) as workout_rank,
    greatest({pct('h_running_avg_speed', 'running_avg_speed')}, {roll_score('running_avg_speed', 7, True)}) as speed_rank,
    greatest({pct('h_running_avg_hr', 'running_avg_hr')}, {pct('h_running_max_hr', 'running_max_hr')}) as hr_rank,
    {roll_score('running_bone_stress_load', 7)} as load7_rank, {roll_score('running_bone_stress_load', 28)} as load28_rank,
    {roll_score('running_distance', 7)} as volume7_rank, {roll_score('running_distance', 28)} as volume28_rank
  from ranked2""",
)
C["comp1"] = (
    ["ranked3"],
    f"""
  select *, {STRAIN} as recovery_strain_score, coalesce(running_28d_sum_m, 0e0) / 1000e0 as run28_km, coalesce(running_distance, 0e0) / 1000e0 as day_km,
    {workout_risk('running_aerobic_te', 'running_anaerobic_te')} as abs_workout, {volume_risk('run7_km')} as abs_volume, {acwr_risk('running_7d_acwr')} as abs_acwr,
    least(greatest({speed_risk(z('running_avg_speed'))}, {workout_risk('running_aerobic_te', 'running_anaerobic_te')} * 0.35e0), 100e0) as abs_intensity,
    least(greatest(speed_rank, hr_rank * 0.85e0, workout_rank * 0.85e0), 100e0) as intensity_rank, {monotony_risk('foster_monotony')} as running_monotony_score
  from ranked3""",
)
C["comp2"] = (
    ["comp1"],
    f"""
  select *, {hard('running_avg_speed', 'day_km')} as is_hard, least(0.40e0 + 0.60e0 * abs_volume / 100e0, 100e0) as factor,
    {blend('load7_rank', 'abs_volume')} as running_7d_load_score, {blend('load28_rank', volume_risk('run28_km'))} as running_28d_load_score,
    volume7_rank as running_7d_volume_score, volume28_rank as running_28d_volume_score, {blend('acwr_rank', 'abs_acwr')} as running_acwr_score,
    least(0.5e0 * least(0.55e0 * volume7_rank + 0.45e0 * load7_rank, 100e0) + 0.5e0 * least(0.65e0 * abs_acwr + 0.35e0 * abs_volume, 100e0), 100e0) as running_progression_score,
    least(same_day * recovery_strain_score / 100e0, 100e0) as run_under_recovered_score,
    {blend('workout_rank', 'abs_workout')} as running_workout_score, {blend('intensity_rank', 'abs_intensity')} as running_intensity_score
  from comp1""",
)
C["comp3"] = (
    ["comp2"],
    """
  select *, case when monotony_now >= 35 then least(greatest(chronic0, (running_7d_load_score + running_28d_load_score) / 2e0), 100e0) else chronic0 end as chronic,
    least(0.25e0 * running_7d_load_score + 0.18e0 * running_28d_load_score + 0.15e0 * running_progression_score + 0.12e0 * running_intensity_score
      + 0.12e0 * running_workout_score + 0.10e0 * running_acwr_score + 0.08e0 * monotony_now, 100e0) as personalized_bone_stress_score,
    least(0.55e0 * running_acwr_score + 0.45e0 * running_7d_load_score, 100e0) as acwr_spike
  from (select *, least(running_monotony_score * factor, 100e0) as monotony_now,
      least(greatest(running_7d_load_score, running_28d_load_score * 0.9e0, prior_run, running_7d_volume_score * 0.85e0), 100e0) as chronic0 from comp2)""",
)
C["comp4"] = (
    ["comp3"],
    """
  select *, chronic * (0.3e0 + 0.7e0 * recovery_strain_score / 100e0) as suppressed,
    case when monotony_now >= 45 then chronic * 0.65e0 else monotony_now * 0.45e0 end as monotony_block,
    least(0.55e0 * running_intensity_score + 0.45e0 * running_workout_score, 100e0) * (0.35e0 + 0.65e0 * chronic / 100e0) * factor as intensity_block,
    (abs_intensity >= 50 and is_hard) as hard_block
  from comp3""",
)
C["comp5"] = (
    ["comp4"],
    """
  select *, least(greatest(least(0.5e0 * literature_bone_stress_score + 0.5e0 * personalized_bone_stress_score, 100e0), personalized_bone_stress_score,
      suppressed * 0.9e0, run_under_recovered_score, running_progression_score * 0.92e0, case when monotony_now >= 50 then monotony_block * 0.85e0 else 0e0 end,
      acwr_spike * 0.85e0, case when hard_block then intensity_block * 0.8e0 else 0e0 end, same_day * recovery_strain_score / 120e0), 100e0) as raw_risk
  from comp4""",
)
C["comp6"] = (
    ["comp5"],
    f"""
  select *, {level('bone_stress_risk_score')} as bone_stress_risk_level, {level('personalized_bone_stress_score')} as personalized_bone_stress_level,
    {acwr_zone('running_7d_acwr')} as running_acwr_zone, {speed_band('running_avg_speed')} as running_edwards_speed_band,
    least(0.45e0 * running_7d_load_score + 0.25e0 * running_28d_load_score + 0.15e0 * (case when is_hard then running_workout_score else running_workout_score * 0.35e0 end)
      + 0.15e0 * raw_risk, 100e0) as bone_stress_severity_score,
    least(greatest(suppressed, chronic * 0.85e0, personalized_bone_stress_score), 100e0) as volume_block
  from (select *, case when coalesce(running_7d_sum_m < 1000, true) then least(raw_risk, 15e0)
      when running_7d_load_score < 25 and running_28d_load_score < 25 and same_day < 25 and running_intensity_score < 25 then least(raw_risk, 20e0)
      else raw_risk end as bone_stress_risk_score from comp5)""",
)
C["bone"] = (
    ["comp6"],
    """
  select * exclude (cand, top), case when bone_stress_risk_level = 'low' then 'low running bone-stress context'
      when abs_workout < 50 and abs_volume < 70 then coalesce(list_filter(cand, lambda e: e.name in ('running volume progression', 'running monotony block',
        'sustained high running volume', 'elevated running workload ratio') and e.score >= top.score * 0.85e0)[1].name, top.name)
      when run7_km >= 85 and day_km < run7_km / 5e0 then coalesce(list_filter(cand, lambda e: e.name in ('sustained high running volume',
        'running volume progression', 'running monotony block') and e.score >= top.score * 0.80e0)[1].name, top.name)
      else top.name end as bone_stress_risk_reason, p_distance as previous_day_running_distance, cast(null as double) as running_max_speed
  from (select *, cand[1] as top from (select *, list_sort([
      {'score': run_under_recovered_score, 'ord': -1, 'name': 'running while under-recovered'},
      {'score': case when abs_volume >= 55 then volume_block else volume_block * 0.65e0 end, 'ord': -2, 'name': 'sustained high running volume'},
      {'score': case when abs_workout < 50 and abs_acwr >= 35 then least(greatest(running_progression_score, running_progression_score * 1.08e0), 100e0) else running_progression_score end, 'ord': -3, 'name': 'running volume progression'},
      {'score': monotony_block, 'ord': -4, 'name': 'running monotony block'},
      {'score': greatest(same_day * recovery_strain_score / 100e0, prior_run * 0.9e0), 'ord': -5, 'name': 'running load spike'},
      {'score': acwr_spike, 'ord': -6, 'name': 'elevated running workload ratio'},
      {'score': case when is_hard then least(0.6e0 * running_workout_score + 0.4e0 * running_intensity_score, 100e0) else 0e0 end, 'ord': -7, 'name': 'hard running session'},
      {'score': case when hard_block then intensity_block else 0e0 end, 'ord': -8, 'name': 'elevated running intensity block'}], 'DESC') as cand from comp6))""",
)


def carry(column: str, d: str) -> str:
    """Closed form of the linear carry; ``rn`` is the row number."""
    return f"(1e0 - {d}) * pow({d}, rn) * sum({column} * pow({d}, -rn)) over ({HISTORY} rows between unbounded preceding and current row)"


C["bh"] = (
    ["bone"],
    f"""
  select *, {state_level('accumulated_bone_stress_state')} as accumulated_bone_stress_level,
    round_even(max(accumulated_bone_stress_state) over ({HISTORY} rows between 20 preceding and current row), 2) as bone_stress_carryover_score
  from (select *, {carry('daily_bone_stress_contribution', '0.91e0')} as accumulated_bone_stress_state
    from (select *, least(0.22e0 * running_7d_load_score + 0.22e0 * running_28d_load_score + 0.15e0 * running_progression_score + 0.16e0 * running_intensity_score
        + 0.12e0 * running_workout_score + 0.13e0 * running_monotony_score, 100e0) as daily_bone_stress_contribution,
        row_number() over ({HISTORY}) as rn from bone))""",
)

# --- embeddings of the daily table -------------------------------------------------------


def anomaly(source: str, dim: int) -> str:
    before = f"({HISTORY} rows between 28 preceding and 1 preceding)"
    means = ", ".join(f"avg(z[{i}]) over {before} as m{i}" for i in range(1, dim + 1))
    dist = " + ".join(f"(z[{i}] - m{i}) * (z[{i}] - m{i})" for i in range(1, dim + 1))
    length = " + ".join(f"z[{i}] * z[{i}]" for i in range(1, dim + 1))
    drift = " + ".join(f"(z[{i}] - pz[{i}]) * (z[{i}] - pz[{i}])" for i in range(1, dim + 1))
    return f"""
  select athlete_id, date, day, z, embedding_distance, embedding_norm, embedding_drift,
    case when ds > 0 then (embedding_distance - dm) / ds else 0e0 end as anomaly_zscore
  from (select *, avg(embedding_distance) over {before} as dm, stddev_pop(embedding_distance) over {before} as ds
    from (select *, case when m1 is not null then round(sqrt({dist}), 9) else 0e0 end as embedding_distance, sqrt({length}) as embedding_norm,
        coalesce(sqrt({drift}), 0e0) as embedding_drift
      from (select *, lag(z) over ({HISTORY}) as pz, {means} from (select *, datediff('day', date '1970-01-01', date) as day from {source}))))"""


C["zv"] = (
    ["sums"],
    "\n  select athlete_id, date, [(sp % 17) / 8e0, (so % 13) / 8e0, ((sp * 3) % 11) / 8e0, ((so * 7) % 19) / 8e0] as z from sums where so % 6 <> 0",
)
C["czv"] = (["sums"], "\n  select athlete_id, date, [(so % 7) / 4e0, (sp % 9) / 4e0] as z from sums where so % 4 <> 0")
C["emb"] = (["zv"], anomaly("zv", 4))
C["cemb"] = (["czv"], anomaly("czv", 2))
C["ev"] = (
    [],
    "\n  select s_suppkey as athlete_id, 'spring_block' as event_id, 'Bone stress injury' as label, date '2021-04-01' as onset_date, "
    "date '2021-03-01' as symptom_window_start from supplier",
)
C["refp"] = (
    [],
    "\n  select s_suppkey as athlete_id, 'summer_block' as event_id, 'Summer load block' as label, date '2020-07-01' as start_date, "
    "date '2020-08-15' as end_date from supplier",
)
C["refc"] = (
    ["emb", "ev"],
    "\n  select athlete_id, avg(z[1]) as c1, avg(z[2]) as c2, avg(z[3]) as c3, avg(z[4]) as c4 from emb join ev using (athlete_id) "
    "where date between symptom_window_start and onset_date + 28 group by athlete_id",
)


def normal(x: str) -> str:
    q = f"quantile_cont(coalesce(greatest({x}, 0e0), 0e0), 0.95) over (partition by athlete_id)"
    return f"(case when {q} > 0 then least(coalesce(greatest({x}, 0e0), 0e0) / {q}, 1e0) * 100e0 else 0e0 end)"


C["fr1"] = (
    ["bh", "emb", "cemb", "sums", "refc"],
    """
  select bh.*, e.anomaly_zscore, e.embedding_distance, e.z, c.anomaly_zscore as contrastive_anomaly_zscore,
    case when s.so % 5 <> 0 then (20 + s.sp % 75)::double end as actual, (20 + (s.sp * 3) % 75)::double as prediction,
    case when e.z is not null and r.c1 is not null then (case when sqrt(z[1]*z[1]+z[2]*z[2]+z[3]*z[3]+z[4]*z[4]) > 0 and sqrt(c1*c1+c2*c2+c3*c3+c4*c4) > 0
      then (z[1]*c1+z[2]*c2+z[3]*c3+z[4]*c4) / (sqrt(z[1]*z[1]+z[2]*z[2]+z[3]*z[3]+z[4]*z[4]) * sqrt(c1*c1+c2*c2+c3*c3+c4*c4)) else 0e0 end) end as reference_block_embedding_similarity
  from bh left join emb e using (athlete_id, date) left join (select athlete_id, date, anomaly_zscore from cemb) c using (athlete_id, date) left join sums s using (athlete_id, date)
    left join refc r using (athlete_id)""",
)
C["fr2"] = (
    ["fr1"],
    f"""
  select *, abs(actual - prediction) as readiness_forecast_error,
    case when anomaly_zscore is not null then {normal('anomaly_zscore')} end as base_novelty,
    case when contrastive_anomaly_zscore is not null then {normal('contrastive_anomaly_zscore')} end as contrastive_novelty_score,
    case when actual is not null then {normal('abs(actual - prediction)')} end as readiness_absolute_forecast_error_score,
    case when actual is not null then {normal('(case when actual is not null then greatest(prediction - actual, 0e0) end)')} end as readiness_forecast_error_score,
    case when reference_block_embedding_similarity is not null then least(greatest(reference_block_embedding_similarity, 0e0) * 100e0, 100e0) end as reference_block_similarity_score
  from fr1""",
)
C["fr3"] = (
    ["fr2"],
    """
  select *, case when w > 0 then least(greatest(v / w, 0e0), 100e0) end as frontier_strain_score from (
    select *, (case when n is not null then 0.40e0 else 0e0 end) + (case when f is not null then 0.35e0 else 0e0 end) + (case when r is not null then 0.25e0 else 0e0 end) as w,
      coalesce(0.40e0 * n, 0e0) + coalesce(0.35e0 * f, 0e0) + coalesce(0.25e0 * r, 0e0) as v
    from (select *, embedding_novelty_score as n, readiness_forecast_error_score as f, reference_block_similarity_score as r from (
      select *, coalesce(0.55e0 * base_novelty + 0.45e0 * contrastive_novelty_score, contrastive_novelty_score, base_novelty) as embedding_novelty_score from fr2)))""",
)
C["t2"] = (
    ["fr3"],
    """
  select athlete_id, rn, x, 0e0 as st, cast(null as double) as out from (select athlete_id, 0 as rn, cast(null as double) as x from fr3 group by athlete_id)
  union all
  select s.athlete_id, s.rn, s.frontier_strain_score,
    case when s.frontier_strain_score is null then t.st
      when s.frontier_strain_score > t.st then least(t.st + 0.70e0 * (s.frontier_strain_score - t.st), 100e0)
      else greatest(s.frontier_strain_score, t.st * (case
        when s.running_7d_sum_m / 1000e0 >= 80 or s.recovery_strain_score >= 55 or s.accumulated_bone_stress_state >= 70 then 0.97e0
        when s.running_7d_sum_m / 1000e0 <= 35 and s.recovery_strain_score <= 35 and s.accumulated_bone_stress_state <= 45 then 0.88e0
        when s.running_7d_sum_m / 1000e0 <= 50 and s.recovery_strain_score <= 45 and s.accumulated_bone_stress_state <= 55 then 0.91e0 else 0.94e0 end)) end,
    null
  from t2 t join fr3 s on s.athlete_id = t.athlete_id and s.rn = t.rn + 1""",
)
C["fr"] = (
    ["fr3", "t2"],
    f"""
  select *, case when lf is null then (case when ll = pl then 'literature_personalized_agree' else 'mixed_signals' end)
      when ll = pl and ll = lf then 'all_agree' when ll = pl then 'literature_personalized_agree_frontier_differs'
      when lf = ll then 'literature_frontier_agree' when lf = pl then 'personalized_frontier_agree' else 'mixed_signals' end as monitoring_signal_agreement
  from (select *, literature_bone_stress_level as ll, personalized_bone_stress_level as pl, accumulated_frontier_level as lf from (
    select *, case when accumulated_frontier_state is not null then {level('accumulated_frontier_state')} end as accumulated_frontier_level,
      case when frontier_strain_score is not null then {level('frontier_strain_score')} end as frontier_strain_level,
      coalesce(least(0.65e0 * bone_stress_risk_score + 0.35e0 * accumulated_frontier_state, 100e0 + 0e0 * accumulated_frontier_state), bone_stress_risk_score) as integrated_bone_stress_score
    from (select fr3.* exclude (w, v, n, f, r), case when frontier_strain_score is not null then t2.st end as accumulated_frontier_state
      from fr3 join t2 on t2.athlete_id = fr3.athlete_id and t2.rn = fr3.rn)))""",
)
_HINT_KM = "(coalesce(running_7d_sum_m, 0e0) / 1000e0)"
C["al"] = (
    ["fr"],
    f"""
  select *, case operational_alert_tier when 'adjust_training' then 'Adjust training' when 'investigate_state' then 'Investigate state'
      when 'watch' then 'Watch' else 'Clear' end as operational_alert_label,
    case operational_alert_tier when 'adjust_training' then 'Reduce running volume or intensity this week. Dominant pattern: ' || replace(bone_stress_risk_reason, '_', ' ') || '. ' || counterfactual_hint
      when 'investigate_state' then 'Multivariate strain is elevated while objective load rules are modest. Check readiness, sleep, and mixed-sport fatigue before progressing. ' || counterfactual_hint
      when 'watch' then 'Monitor closely — ' || replace(bone_stress_risk_reason, '_', ' ') || '. ' || counterfactual_hint
      else 'No elevated running-load action needed today.' end as operational_recommendation
  from (select *, case when monitoring_signal_agreement = 'all_agree' and 'high' in (ll, pl, coalesce(lf, '')) then 'adjust_training'
      when ll = 'high' and pl = 'high' then 'adjust_training'
      when monitoring_signal_agreement = 'mixed_signals' and (pl = 'high' or coalesce(lf, '') = 'high') then 'adjust_training'
      when coalesce(lf, '') = 'high' and ll <> 'high' then 'investigate_state'
      when 'high' in (ll, pl, coalesce(lf, '')) or 'moderate' in (ll, pl, coalesce(lf, '')) then 'watch' else 'clear' end as operational_alert_tier,
    case when bone_stress_risk_reason like '%progression%' then 'A ~15% reduction in 7-day running volume (from ' || {fx(_HINT_KM)} || ' km toward ' || {fx(f'greatest({_HINT_KM} * 0.85e0, 0e0)')} || ' km) would likely lower progression pressure.'
      when bone_stress_risk_reason like '%volume%' or bone_stress_risk_reason like '%sustained%' then 'Sustained volume is the driver (~' || {fx(_HINT_KM)} || ' km/week). A recovery week at 50–60% of recent weekly km would reduce accumulated load.'
      when bone_stress_risk_reason like '%hard running session%' then 'Replace the next hard run with easy volume or cross-training; intensity is contributing more than distance.'
      when coalesce(lf, '') = 'high' and ll <> 'high' then 'Learned state is elevated without extreme load — prioritize sleep, HRV, and readiness before adding intensity.'
      when {_HINT_KM} > 0 then 'Moderate 7-day running (' || {fx(_HINT_KM)} || ' km); avoid stacking hard sessions this week.'
      else 'Keep progression gradual over the next 7 days.' end as counterfactual_hint
  from fr)""",
)

# --- recovery-risk track --------------------------------------------------------------------

C["recin"] = (
    ["canon", "emb"],
    f"""
  select *, {normal('anomaly_zscore')} as state_novelty_score from ({enrich('(select canon.*, anomaly_zscore from emb join canon using (athlete_id, date))')})""",
)
_PREV = ["load", "duration", "distance", "impact_duration", "impact_distance", "fatigue_duration", "running_duration", "running_distance", "cycling_distance"]
_RECROLL = ("load", 7, 28, False)
C["rec1"] = (
    ["recin"],
    f"""
  select *, {', '.join(f'lag({c}) over o as p_{c}' for c in _PREV)}, {roll_layer(*_RECROLL)},
    count(*) over h7 as n7, list(load) filter (where load is not null) over h7 as l7, list({{'l': load, 'd': duration}}) over h7 as d7,
    count(*) filter (where readiness < 50) over h7 as low7, quantile_cont(load, 0.5) over h7 as ml, quantile_cont(duration, 0.5) over h7 as md
  from recin window o as ({HISTORY}), h7 as ({HISTORY} range between 7 preceding and 1 preceding)""",
)
C["rec2"] = (
    ["rec1"],
    f"""
  select *, {roll_values(*_RECROLL)} from (select *, {hist_columns([c for c in _PREV if c != 'cycling_distance'] + _MARKERS)}, {roll_lists(*_RECROLL)} from rec1 {H28})""",
)
C["rec3"] = (
    ["rec2"],
    f"""
  select athlete_id, date, day, readiness, hrv, resting_hr, load, duration, distance, running_duration, running_distance, cycling_duration, cycling_distance,
    impact_duration, fatigue_duration, anomaly_zscore, state_novelty_score, p_load, p_duration, p_distance, p_impact_duration, p_running_distance, p_cycling_distance,
    {marker_risks()},
    {', '.join(f"{pct(f'h_{c}', f'p_{c}')} as pr_{c}" for c in _PREV if c != 'cycling_distance')},
    {', '.join(f"{pct(f'h_{c}', c, False)} as lo_{c}" for c in ('duration', 'distance', 'load'))},
    greatest({pct('h_running_duration', 'running_duration')}, {pct('h_running_distance', 'running_distance')}) as now_run,
    {roll_score('load', 7)} as recent_load,
    case when n7 = 0 then 0e0 else least(cast(
      14 * len(list_filter(coalesce(l7, []), lambda v: (len(list_filter(l7, lambda u: u < v)) + (len(list_filter(l7, lambda u: u = v)) + 1) / 2e0) / len(l7) > 0.75e0))
      + 12 * low7 + 12 * greatest(0, 2 - len(list_filter(d7, lambda e: coalesce(e.d <= md and e.l <= ml, false)))) as double), 100e0) end as insufficient_rest_score
  from rec2""",
)
C["rec4"] = (
    ["rec3"],
    f"""
  select *, {STRAIN} as recovery_strain_score,
    greatest(pr_load, pr_duration, pr_distance, pr_fatigue_duration, recent_load) as prior_workload_score,
    greatest(pr_impact_duration, pr_impact_distance, pr_running_duration, pr_running_distance) as tissue_load_score,
    greatest(pr_load, pr_fatigue_duration, recent_load) as metabolic_fatigue_score,
    least(0.4e0 * lo_duration + 0.4e0 * lo_distance + 0.2e0 * lo_load, 100e0) as rest_context_score
  from rec3""",
)
C["rec5"] = (
    ["rec4"],
    """
  select *, least(greatest(delayed, tissue, under), 100e0) as preparedness_mismatch_score, least(under, 100e0) as run_under_recovered_score from (
    select *, prior_workload_score * recovery_strain_score / 100e0 as delayed, tissue_load_score * recovery_strain_score / 100e0 as tissue,
      now_run * recovery_strain_score / 100e0 as under, recovery_strain_score * 0.75e0 as alone, insufficient_rest_score * 0.65e0 as pile,
      case when recovery_strain_score >= 40 then state_novelty_score * 0.15e0 else 0e0 end as nov from rec4)""",
)
C["rec"] = (
    ["rec5"],
    f"""
  select *, case when risk_level = 'low' and rest_context_score >= 70 and recovery_strain_score < 35 then 'low-risk rest/easy day'
      when risk_level = 'low' and state_novelty_score >= 70 and recovery_strain_score < 35 then 'novel but not clearly risky'
      when risk_level = 'low' then 'low risk'
      when under >= greatest(delayed, tissue, alone, pile) and under >= 35 then 'running while under-recovered'
      when tissue >= greatest(delayed, alone, pile) and tissue >= 35 then 'tissue-load recovery mismatch'
      when delayed >= greatest(alone, pile) and delayed >= 35 then 'post-load recovery response'
      when pile >= greatest(delayed, alone) and pile >= 35 then 'accumulated insufficient rest'
      when alone >= 35 then 'poor recovery markers' else 'low risk' end as risk_reason
  from (select *, {level('risk_score')} as risk_level from (
    select *, least((greatest(preparedness_mismatch_score, alone, pile) + nov) * (case when rest_context_score >= 70 and recovery_strain_score < 35 and prior_workload_score < 60 then 0.35e0 else 1e0 end), 100e0) as risk_score from rec5))""",
)
C["rh"] = (
    ["rec"],
    f"""
  select *, {state_level('accumulated_risk_state')} as accumulated_risk_level from (
    select *, {carry('daily_strain_contribution', '0.86e0')} as accumulated_risk_state from (
      select *, least(0.35e0 * recovery_strain_score + 0.25e0 * metabolic_fatigue_score + 0.20e0 * tissue_load_score + 0.20e0 * insufficient_rest_score, 100e0) as daily_strain_contribution,
        row_number() over ({HISTORY}) as rn from rec))""",
)
C["rp"] = (
    ["rh"],
    f"""
  select *, 'Sustained elevated risk from ' || start_date || ' to ' || end_date || ' (' || calendar_days || ' calendar days). Accumulated state peaked at '
      || {fx('peak_accumulated_risk_state')} || ' with ' || high_risk_days || ' high-risk day(s). Dominant pattern: ' || dominant_risk_reason || '.'
      || coalesce(' Lowest readiness ' || {fx('min_readiness')} || '.', '') as period_summary
  from (select *, case when peak_accumulated_risk_state >= 65 then 'high' else 'moderate' end as period_level, (datediff('day', start_date, end_date) + 1)::bigint as calendar_days
  from (select r.athlete_id, g.grp as period_id, min(r.date) as start_date, max(r.date) as end_date, count(*) filter (where r.accumulated_risk_state >= 50) as elevated_days,
      count(*) filter (where r.risk_level = 'high') as high_risk_days, max(r.accumulated_risk_state) as peak_accumulated_risk_state,
      round(avg(r.accumulated_risk_state), 9) as mean_accumulated_risk_state, round(avg(r.recovery_strain_score), 9) as mean_recovery_strain,
      round(avg(r.metabolic_fatigue_score), 9) as mean_metabolic_fatigue, round(avg(r.tissue_load_score), 9) as mean_tissue_load, min(r.readiness) as min_readiness
    from (select athlete_id, grp, min(day) as a, max(day) as b, count(*) as n from (
        select athlete_id, day, sum(case when gap <= 2 then 0 else 1 end) over ({HISTORY})::bigint as grp from (
          select athlete_id, day, coalesce(day - lag(day) over ({HISTORY}), 99) as gap from rh where accumulated_risk_state >= 50))
      group by all) g join rh r on r.athlete_id = g.athlete_id and r.day between g.a and g.b where g.n >= 3 group by all)
  join (select athlete_id, period_id, reason as dominant_risk_reason from (
      select *, row_number() over (partition by athlete_id, period_id order by k desc, reason) as pos from (
        select r.athlete_id, g.grp as period_id, r.risk_reason as reason, count(*) as k
        from (select athlete_id, grp, min(day) as a, max(day) as b from (
            select athlete_id, day, sum(case when gap <= 2 then 0 else 1 end) over ({HISTORY})::bigint as grp from (
              select athlete_id, day, coalesce(day - lag(day) over ({HISTORY}), 99) as gap from rh where accumulated_risk_state >= 50))
          group by all) g join rh r on r.athlete_id = g.athlete_id and r.day between g.a and g.b group by all)) where pos = 1) using (athlete_id, period_id))""",
)

# --- bone-stress periods ------------------------------------------------------------------

C["clus"] = (
    ["bh"],
    f"""
  select athlete_id, list(day order by day) as days from (
    select athlete_id, day, sum(case when gap <= 4 then 0 else 1 end) over ({HISTORY}) as grp from (
      select athlete_id, day, coalesce(day - lag(day) over ({HISTORY}), 99) as gap from bh where bone_stress_risk_level = 'high'))
  group by athlete_id, grp having count(*) >= 5""",
)
C["parts"] = (
    ["clus"],
    """
  select athlete_id, days, (days[-1] - days[1] + 1 <= 49) as done from clus
  union all
  select athlete_id, p.d, p.done from (
    select athlete_id, unnest(case when len(ok) > 0 then list_transform(ok, lambda h: {'d': h, 'done': h[-1] - h[1] + 1 <= 49}) else [{'d': days, 'done': true}] end) as p
    from (select athlete_id, days, list_filter([list_slice(days, 1, cut), list_slice(days, cut + 1, len(days))], lambda h: len(h) >= 5) as ok
      from (select athlete_id, days, len(gaps) + 1 - list_position(list_reverse(gaps), list_max(gaps)) as cut
        from (select athlete_id, days, list_transform(range(1, len(days)), lambda i: days[i + 1] - days[i]) as gaps from parts where not done))))""",
)
C["blocks"] = (
    ["parts"],
    """
  select athlete_id, row_number() over (partition by athlete_id order by days[1]) as period_id, days[1] as a, days[-1] as b, len(days)::bigint as elevated_days
  from parts where done""",
)
C["bp"] = (
    ["blocks", "bh"],
    f"""
  select *, 'Sustained elevated bone-stress load from ' || start_date || ' to ' || end_date || ' (' || calendar_days || ' calendar days). Accumulated bone-stress state peaked at '
      || {fx('peak_accumulated_bone_stress_state')} || ' with ' || high_bone_stress_days || ' high day(s). Dominant pattern: ' || dominant_bone_stress_reason || '.'
      || coalesce(' Peak 7-day running total ' || {fx('peak_running_7d_km')} || ' km.', '') as period_summary
  from (select *, elevated_days as high_bone_stress_days, case when peak_accumulated_bone_stress_state >= 65 then 'high' else 'moderate' end as period_level,
    (datediff('day', start_date, end_date) + 1)::bigint as calendar_days from (
    select k.athlete_id, k.period_id, date '1970-01-01' + k.a::integer as start_date, date '1970-01-01' + k.b::integer as end_date, k.elevated_days,
      max(h.accumulated_bone_stress_state) as peak_accumulated_bone_stress_state, round(avg(h.accumulated_bone_stress_state), 9) as mean_accumulated_bone_stress_state,
      max(h.running_7d_sum_m) / 1000e0 as peak_running_7d_km, round(avg(h.running_7d_sum_m) / 1000e0, 9) as mean_running_7d_km, round(avg(h.running_7d_load_score), 9) as mean_running_7d_load_score,
      round(avg(h.running_progression_score), 9) as mean_running_progression_score, round(avg(h.running_intensity_score), 9) as mean_running_intensity_score
    from blocks k join bh h on h.athlete_id = k.athlete_id and h.day between k.a and k.b group by k.athlete_id, k.period_id, k.a, k.b, k.elevated_days)
    where peak_accumulated_bone_stress_state >= 60)
  join (select athlete_id, period_id, reason as dominant_bone_stress_reason from (
      select *, row_number() over (partition by athlete_id, period_id order by k desc, reason) as pos from (
        select k.athlete_id, k.period_id, h.bone_stress_risk_reason as reason, count(*) as k
        from blocks k join bh h on h.athlete_id = k.athlete_id and h.day between k.a and k.b group by k.athlete_id, k.period_id, h.bone_stress_risk_reason)) where pos = 1)
    using (athlete_id, period_id)""",
)

RECURSIVE = {"t2", "parts"}


def build(select: str, *needs: str) -> str:
    """``select`` with everything it needs in front, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in C[name][0]:
            visit(dep)
        order.append(name)

    for n in needs:
        visit(n)
    parts = []
    for n in order:
        columns = {"t2": " (athlete_id, rn, x, st, out)", "parts": " (athlete_id, days, done)"}.get(n, "")
        parts.append(f"{n}{columns} as ({C[n][1]}\n)")
    head = "with recursive " if any(n in RECURSIVE for n in order) else "with "
    return (head + ",\n".join(parts) + "\n" + select) if parts else select


# Values that fall exactly between two rounded ones would be decided by the last
# bit of a sum; both engines add this before rounding.
NUDGE = 1e-8


def column_digits(doubles: list[str], digits: int) -> list[tuple[str, int]]:
    """Column names, each with its own digits when written ``name:digits``."""
    return [(c.split(":")[0], int(c.split(":")[1])) if ":" in c else (c, digits) for c in doubles]


def rounded(source: str, keys: list[str], doubles: list[str], others: list[str] = (), digits: int = 4) -> str:
    cols = [*keys, *[f"round({c} + {NUDGE}, {n}) as {c}" for c, n in column_digits(doubles, digits)], *others]
    return f"select {', '.join(cols)} from {source}"
