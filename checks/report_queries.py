"""Queries on scenarios, evaluation, questions, profiles and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.registry import add, kept, show, table_query
from checks.sqlparts import HISTORY, NUDGE, C, build, exact, fx as fixed, literature, num
from paceframe.operators import periods
from paceframe.plans import compare, evaluation, feedback, profile, questions, scenarios

KEY = ["athlete_id", "date"]
DAY_A, DAY_B = "2021-03-15", "2021-02-10"


def joined(column: str, *fields: str) -> Column:
    """An array of structs as one text, for comparison."""
    return F.array_join(F.transform(column, lambda e: F.concat_ws("=", *[F.coalesce(e[f].cast("string"), F.lit("-")) for f in fields])), ";")


def _scored(s: SparkSession, d: str) -> DataFrame:
    return kept(s, d, "scored")


def r(expr: str, name: str, digits: int = 4) -> str:
    return f"round({expr} + {NUDGE}, {digits}) as {name}"


# --- scenarios -------------------------------------------------------------------------------

C["week"] = (
    ["al"],
    f"""
  select * exclude (ws, wm, wd), case when ws > 0 then (case when wd > 0 then least(round(wm / wd, 9), 10e0) else 10e0 end) else 0e0 end as wmono,
    greatest(ws, 0e0) * (case when ws > 0 then (case when wd > 0 then least(round(wm / wd, 9), 10e0) else 10e0 end) else 0e0 end) as wstrain
  from (select *, sum(running_7d_load_sum) over w as ws, avg(running_7d_load_sum) over w as wm, stddev_pop(running_7d_load_sum) over w as wd
    from al window w as ({HISTORY} range between 6 preceding and current row))""",
)
_NONE = "cast(null as double)"


def scenario_cte(factors: list[float], where: str = "true") -> str:
    listed = ", ".join(f"{f}::double" for f in factors)
    return f"""select *, scenario_literature_score - baseline_literature_score as delta_literature_score from (
  select *, {literature(_NONE, 'running_avg_speed', 'baseline_run7_km', 'wmono', 'wstrain')} as baseline_literature_score,
    {literature(_NONE, 'running_avg_speed', 'scenario_run7_km', 'wmono', '(wstrain * vf)')} as scenario_literature_score
  from (select *, coalesce(running_7d_sum_m, 0e0) / 1000e0 as baseline_run7_km, coalesce(running_7d_sum_m, 0e0) * vf / 1000e0 as scenario_run7_km
    from (select *, unnest([{listed}]) as vf from week where {where})))"""


_SENTENCE = (
    "'If 7-day running volume were ~' || round((1 - vf) * 100)::integer || '% lower (' || "
    + fixed("scenario_run7_km") + " || ' vs ' || " + fixed("baseline_run7_km") + " || ' km/week), literature score would move ' || "
    + fixed("baseline_literature_score") + " || ' → ' || " + fixed("scenario_literature_score")
    + " || ' (' || format('{:+.0f}', delta_literature_score) || ').'"
)
add(
    "volume_scenarios", "X01,J15",
    lambda s, d: show(
        scenarios.volume_scenarios(_scored(s, d), [0.85, 0.55]), [*KEY, "factor"],
        ["baseline_literature_score", "scenario_literature_score", "scenario_run7_km"], ["summary"],
    ),
    build(
        f"select athlete_id, date, vf as factor, {r('baseline_literature_score', 'baseline_literature_score')}, {r('scenario_literature_score', 'scenario_literature_score')}, {r('scenario_run7_km', 'scenario_run7_km')}, {_SENTENCE} as summary from ({scenario_cte([0.85, 0.55])})",
        "week",
    ),
)
_LAST = "date = (select max(x.date) from week x where x.athlete_id = week.athlete_id)"
add(
    "latest_day_scenarios", "X02,O09",
    lambda s, d: scenarios.latest_scenarios(_scored(s, d)),
    build(
        f"""select athlete_id, date, max(summary) filter (where vf = 0.85) as whatif_volume_15_summary, max(summary) filter (where vf = 0.55) as whatif_volume_45_summary,
  arg_min(summary, (scenario_literature_score, -vf)) as whatif_best_scenario_summary from (select *, {_SENTENCE} as summary from ({scenario_cte([0.85, 0.55], _LAST)})) group by all""",
        "week",
    ),
)
add(
    "single_day_cut", "X03",
    lambda s, d: scenarios.volume_cut(_scored(s, d), DAY_A),
    build(
        f"""select athlete_id, date, 'Volume cut to 85%' as scenario, {exact('integrated_bone_stress_score', 2)} as current_score, {exact('literature_bone_stress_score', 2)} as actual_literature_score,
  {exact('scenario_literature_score', 2)} as scenario_literature_score, {exact('delta_literature_score', 2)} as literature_score_change, {exact('baseline_run7_km', 1)} as actual_run7_km, {exact('scenario_run7_km', 1)} as scenario_run7_km
from ({scenario_cte([0.85], f"date = date '{DAY_A}'")})""",
        "week",
    ),
)
_GRID = [x / 100 for x in range(95, 49, -5)]
add(
    "adjustment_plan", "X04,J15",
    lambda s, d: show(
        scenarios.adjustment_plan(_scored(s, d)).select(
            *KEY, "factors_meeting_target", F.col("smallest_reduction_meeting_target.volume_factor").alias("volume_factor"),
            F.col("smallest_reduction_meeting_target.scenario_literature_score").alias("score_at_cut"), F.size("scenario_grid").alias("grid_size"),
        ),
        KEY, ["volume_factor", "score_at_cut"], ["factors_meeting_target", "grid_size"],
    ),
    build(
        f"""select athlete_id, date, {r('max(vf) filter (where s < 70)', 'volume_factor')}, {r('arg_max(s, vf) filter (where s < 70)', 'score_at_cut')}, count(*) filter (where s < 70) as factors_meeting_target, count(*) as grid_size
from (select *, {exact('scenario_literature_score', 2)} as s from ({scenario_cte(_GRID)})) group by athlete_id, date""",
        "week",
    ),
)
_WEEK_COLS = ["actual_integrated_min", "actual_integrated_max", "actual_literature_min", "actual_literature_max", "scenario_literature_min", "scenario_literature_max", "largest_literature_drop", "mean_literature_delta"]


def _down_week_sql(start: str) -> str:
    return f"""select athlete_id, min(i) as actual_integrated_min, max(i) as actual_integrated_max, min(l) as actual_literature_min, max(l) as actual_literature_max, min(s) as scenario_literature_min,
  max(s) as scenario_literature_max, min(d) as largest_literature_drop, {exact('round(avg(d), 9)', 2)} as mean_literature_delta, count(*) as days
from (select athlete_id, {exact('integrated_bone_stress_score', 2)} as i, {exact('literature_bone_stress_score', 2)} as l, {exact('scenario_literature_score', 2)} as s, {exact('delta_literature_score', 2)} as d
  from ({scenario_cte([0.8], f"date between date '{start}' and date '{start}' + 6")})) group by athlete_id"""


add(
    "down_week_impact", "X05,Q17",
    lambda s, d: scenarios.down_week(_scored(s, d), "2021-02-05").select("athlete_id", *_WEEK_COLS, "days"),
    build(_down_week_sql("2021-02-05"), "week"),
)

# --- evaluation -------------------------------------------------------------------------------

_LB = "date between date '2021-04-01' - 56 and date '2021-04-01' - 1"


def _targets(s: SparkSession, d: str) -> DataFrame:
    return evaluation.evaluation_targets(fx.events(s, d), fx.reference_periods(s, d))


C["targets"] = (
    ["ev", "refp"],
    "\n  select athlete_id, event_id, label, onset_date as evaluation_end, symptom_window_start as window_start from ev union all select athlete_id, event_id, label, end_date, start_date from refp",
)
add(
    "evaluation_targets", "S16,U08", _targets,
    build("select * from targets", "targets"),
)
add(
    "window_peaks", "V01",
    lambda s, d: show(
        evaluation.window_peaks(_targets(s, d), _scored(s, d)), ["athlete_id", "event_id"],
        ["peak_accumulated_bone_stress_state", "peak_bone_stress_risk_score", "peak_running_7d_km"], ["peak_accumulated_state_date", "high_bone_stress_days_in_window"],
    ),
    build(
        f"""select athlete_id, event_id, {r('p.state', 'peak_accumulated_bone_stress_state')}, {r('p.risk', 'peak_bone_stress_risk_score')}, {r('p.m / 1000e0', 'peak_running_7d_km')}, p.d as peak_accumulated_state_date, high_bone_stress_days_in_window from (
  select t.athlete_id, t.event_id, arg_max({{'state': accumulated_bone_stress_state, 'risk': bone_stress_risk_score, 'm': running_7d_sum_m, 'd': b.date}}, (accumulated_bone_stress_state, -b.day)) as p,
    count(*) filter (where bone_stress_risk_level = 'high') as high_bone_stress_days_in_window
  from targets t join bh b on b.athlete_id = t.athlete_id and b.date between t.evaluation_end - 56 and t.evaluation_end - 1 group by all)""",
        "targets", "bh",
    ),
)
add(
    "threshold_crossings", "V02",
    lambda s, d: show(
        evaluation.first_crossings(_targets(s, d), _scored(s, d), "accumulated_bone_stress_state", [45.0, 65.0], 56), ["athlete_id", "event_id"],
        ["first_45_value", "first_65_value"], ["first_45_date", "first_45_lead_days", "first_65_date", "first_65_lead_days"],
    ),
    build(
        "select t.athlete_id, t.event_id, " + ", ".join(
            f"{r(f'arg_min(x, b.date) filter (where x >= {v})', f'first_{v}_value')}, min(b.date) filter (where x >= {v}) as first_{v}_date, datediff('day', min(b.date) filter (where x >= {v}), max(t.evaluation_end)) as first_{v}_lead_days"
            for v in (45, 65)
        ) + " from targets t join (select *, accumulated_bone_stress_state as x from bh) b on b.athlete_id = t.athlete_id and b.date between t.evaluation_end - 56 and t.evaluation_end - 1 group by all",
        "targets", "bh",
    ),
)
# Written out, so that a wrong value in the library shows.
_SIG = {
    "literature_high": ("literature_bone_stress_level", "high"),
    "personalized_high": ("personalized_bone_stress_level", "high"),
    "frontier_high": ("accumulated_frontier_level", "high"),
    "all_agree": ("monitoring_signal_agreement", "all_agree"),
    "mixed_signals": ("monitoring_signal_agreement", "mixed_signals"),
}
add(
    "first_signal_days", "V03",
    lambda s, d: evaluation.first_signals(_targets(s, d), _scored(s, d), evaluation.TRACK_SIGNALS, 56),
    build(
        "select t.athlete_id, t.event_id, " + ", ".join(
            f"min(b.date) filter (where {c} = '{v}') as {n}_date, datediff('day', min(b.date) filter (where {c} = '{v}'), max(t.evaluation_end)) as {n}_lead_days" for n, (c, v) in _SIG.items()
        ) + " from targets t join al b on b.athlete_id = t.athlete_id and b.date between t.evaluation_end - 56 and t.evaluation_end - 1 group by all",
        "targets", "al",
    ),
)
_STATE_NOTE = "Scoring does not use labeled events — this check asks whether the same rules would have surfaced load beforehand. That supports validation, not prediction or diagnosis."
add(
    "event_evaluation", "V04,V06,J10",
    lambda s, d: show(
        evaluation.evaluate_events(fx.events(s, d), _scored(s, d), kept(s, d, "bone_periods")), ["athlete_id", "event_id"],
        ["peak_accumulated_bone_stress_state"], ["first_65_date", "overlapping_periods", "detected_warning_period", "interpretation"],
    ),
    build(
        f"""select athlete_id, event_id, {r('peak', 'peak_accumulated_bone_stress_state')}, first_65_date, overlapping_periods, overlapping_periods > 0 as detected_warning_period,
  concat_ws(' ', case when first_65_date is not null then 'Before ' || label || ', accumulated bone-stress state crossed the high threshold (' || datediff('day', first_65_date, onset_date) || ' days before configured onset).'
    when peak > 0 then 'Before ' || label || ', accumulated bone-stress state peaked at ' || {fixed('peak')} || ' within the lookback window.' end,
    case when overlapping_periods > 0 then 'A detected bone-stress period overlapped the pre-onset symptom window.' end, '{_STATE_NOTE}') as interpretation
from (select e.athlete_id, e.event_id, e.label, e.onset_date, b.peak, b.first_65_date,
    least((select count(*) from bp p where p.athlete_id = e.athlete_id and p.start_date <= e.onset_date and p.end_date >= e.symptom_window_start), 5) as overlapping_periods
  from ev e left join (select athlete_id, max(accumulated_bone_stress_state) as peak, min(date) filter (where accumulated_bone_stress_state >= 65) as first_65_date from bh where {_LB} group by athlete_id) b using (athlete_id))""",
        "ev", "bh", "bp",
    ),
)
_TRACK_COUNTS = ["literature_high_days", "personalized_high_days", "frontier_high_days", "all_agree_days", "mixed_signals_days", "frontier_high_literature_not_days", "pre_symptom_high_days", "days_in_window"]
_INSIDE = "b.date >= t.evaluation_end - 56"
add(
    "track_evaluation", "V05,V06,Q16",
    lambda s, d: show(
        evaluation.evaluate_tracks(_targets(s, d), _scored(s, d)), ["athlete_id", "event_id"],
        ["peak_accumulated_frontier_state", "peak_literature_bone_stress_score", "frontier_state_70_value"],
        [*_TRACK_COUNTS, "frontier_state_70_date", "integrated_score_70_lead_days", "interpretation"],
    ),
    build(
        f"""select athlete_id, event_id, {r('pf', 'peak_accumulated_frontier_state')}, {r('pl', 'peak_literature_bone_stress_score')}, {r('fv', 'frontier_state_70_value')}, {', '.join(_TRACK_COUNTS)},
  frontier_state_70_date, integrated_score_70_lead_days,
  concat_ws(' ', case when fd is not null and ld is not null then 'Before ' || label || ', frontier high preceded literature high by ' || (ld - fd) || ' days (frontier ' || fd || 'd, literature ' || ld || 'd lead).'
      when fd is not null then 'Before ' || label || ', frontier flagged high with ' || fd || ' days lead.' when ld is not null then 'Before ' || label || ', literature flagged high with ' || ld || ' days lead.' end,
    case when ad is not null then 'All three tracks agreed on ' || ad || ' (' || datediff('day', ad, evaluation_end) || ' days before).' end,
    'Events and reference periods are for validation only — scoring never uses these dates.') as interpretation
from (select t.athlete_id, t.event_id, t.label, t.evaluation_end, count(*) filter (where {_INSIDE}) as days_in_window,
    {', '.join(f"count(*) filter (where {_INSIDE} and {c} = '{v}') as {n}_days" for n, (c, v) in _SIG.items())},
    count(*) filter (where {_INSIDE} and accumulated_frontier_level = 'high' and literature_bone_stress_level <> 'high') as frontier_high_literature_not_days,
    count(*) filter (where b.date >= t.window_start and bone_stress_risk_level = 'high') as pre_symptom_high_days,
    max(accumulated_frontier_state) filter (where {_INSIDE}) as pf, max(literature_bone_stress_score) filter (where {_INSIDE}) as pl,
    min(b.date) filter (where {_INSIDE} and accumulated_frontier_state >= 70) as frontier_state_70_date, arg_min(accumulated_frontier_state, b.date) filter (where {_INSIDE} and accumulated_frontier_state >= 70) as fv,
    datediff('day', min(b.date) filter (where {_INSIDE} and integrated_bone_stress_score >= 70), max(t.evaluation_end)) as integrated_score_70_lead_days,
    datediff('day', min(b.date) filter (where {_INSIDE} and accumulated_frontier_level = 'high'), max(t.evaluation_end)) as fd,
    datediff('day', min(b.date) filter (where {_INSIDE} and literature_bone_stress_level = 'high'), max(t.evaluation_end)) as ld,
    min(b.date) filter (where {_INSIDE} and monitoring_signal_agreement = 'all_agree') as ad
  from targets t join al b on b.athlete_id = t.athlete_id and b.date >= least(t.evaluation_end - 56, t.window_start) and b.date < t.evaluation_end group by all)""",
        "targets", "al",
    ),
)

# --- comparison of tracks ---------------------------------------------------------------------

C["deltas"] = (
    ["al"],
    "\n  select *, literature_bone_stress_score - personalized_bone_stress_score as literature_vs_personalized_delta, integrated_bone_stress_score - literature_bone_stress_score as integrated_vs_literature_delta from al",
)
table_query(
    "track_deltas", "C14", lambda s, d: compare.comparison(_scored(s, d)), "deltas", ["literature_vs_personalized_delta", "integrated_vs_literature_delta"]
)
_HIGH = {
    "literature_high_days": "ll = 'high'", "personalized_high_days": "pl = 'high'", "combined_high_days": "bone_stress_risk_level = 'high'",
    "frontier_coverage_days": "accumulated_frontier_state is not null", "frontier_high_days": "lf = 'high'",
    "literature_high_personalized_not": "ll = 'high' and pl <> 'high'", "personalized_high_literature_not": "pl = 'high' and ll <> 'high'",
    "frontier_high_literature_not": "lf = 'high' and ll <> 'high'",
}
add(
    "disagreement_summary", "A14", lambda s, d: compare.disagreement_summary(_scored(s, d)),
    build("select athlete_id, count(*) as days_scored, " + ", ".join(f"count(*) filter (where {c}) as {n}" for n, c in _HIGH.items()) + " from al group by athlete_id", "al"),
)
add(
    "agreement_counts", "A13,L03", lambda s, d: compare.value_counts(_scored(s, d), "monitoring_signal_agreement"),
    build("select monitoring_signal_agreement, count(*) as days from al group by all", "al"),
)
add(
    "largest_disagreements", "O05",
    lambda s, d: show(compare.largest_disagreements(_scored(s, d)), KEY, ["abs_delta"]),
    build(f"select athlete_id, date, {r('abs(literature_vs_personalized_delta)', 'abs_delta')} from (select * from deltas where ll <> pl order by abs(literature_vs_personalized_delta) desc, bone_stress_risk_score desc, athlete_id, date limit 30)", "deltas"),
)
add(
    "top_bone_days", "O02",
    lambda s, d: show(compare.top_bone_days(_scored(s, d)), KEY, ["bone_stress_severity_score"]),
    build(f"select athlete_id, date, {r('bone_stress_severity_score', 'bone_stress_severity_score')} from (select * from bh order by bone_stress_severity_score desc, running_7d_load_score desc, bone_stress_risk_score desc, athlete_id, date limit 20)", "bh"),
)
add(
    "top_risk_days", "O02",
    lambda s, d: show(compare.top_risk_days(kept(s, d, "recovery")), KEY, ["risk_score"]),
    build(f"select athlete_id, date, {r('risk_score', 'risk_score')} from (select * from rh order by risk_score desc, recovery_strain_score desc, athlete_id, date limit 20)", "rh"),
)
add(
    "top_risk_periods", "O03",
    lambda s, d: show(periods.top_periods(kept(s, d, "risk_periods"), "peak_accumulated_risk_state", 20), ["athlete_id", "period_id"], ["peak_accumulated_risk_state"]),
    build(f"select athlete_id, period_id, {r('peak_accumulated_risk_state', 'peak_accumulated_risk_state')} from (select * from rp order by peak_accumulated_risk_state desc, calendar_days desc, athlete_id, period_id limit 20)", "rp"),
)
add(
    "risk_summary", "A15", lambda s, d: compare.risk_summary(kept(s, d, "recovery"), kept(s, d, "risk_periods")),
    build(
        """select a.*, coalesce(p.k, 0) as risk_period_count, p.top as top_risk_period from (select athlete_id, count(*) as rows_scored, min(date) as start_date, max(date) as end_date,
    count(*) filter (where risk_level = 'high') as high_risk_days, count(*) filter (where risk_level = 'moderate') as moderate_risk_days, count(*) filter (where accumulated_risk_level = 'high') as high_accumulated_state_days,
    count(*) filter (where accumulated_risk_level = 'moderate') as moderate_accumulated_state_days, arg_max(date, (risk_score, -day)) as top_risk_day, arg_max(date, (accumulated_risk_state, -day)) as top_accumulated_state_day from rh group by athlete_id) a
left join (select athlete_id, count(*) as k, arg_max(period_id, (peak_accumulated_risk_state, -period_id)) as top from rp group by athlete_id) p using (athlete_id)""",
        "rh", "rp",
    ),
)
add(
    "bone_summary", "A15", lambda s, d: compare.bone_summary(_scored(s, d), kept(s, d, "bone_periods")),
    build(
        """select a.*, coalesce(p.k, 0) as bone_stress_period_count, p.top::bigint as top_bone_stress_period from (select athlete_id, count(*) filter (where bone_stress_risk_level = 'high') as high_bone_stress_days,
    arg_max(date, (bone_stress_risk_score, -day)) as top_bone_stress_day from bh group by athlete_id) a left join (select athlete_id, count(*) as k, arg_max(period_id, (peak_accumulated_bone_stress_state, -period_id)) as top from bp group by athlete_id) p using (athlete_id)""",
        "bh", "bp",
    ),
)
add(
    "big_week_high_rate", "A20",
    lambda s, d: show(compare.summary_running_context(_scored(s, d)), ["athlete_id"], ["big_week_high_rate"], ["big_week_days"]),
    build(f"select athlete_id, {r('coalesce(avg((bone_stress_risk_level = $$high$$)::integer::double) filter (where running_7d_sum_m >= 100000), 0)', 'big_week_high_rate').replace('$$high$$', chr(39) + 'high' + chr(39))}, count(*) filter (where running_7d_sum_m >= 100000) as big_week_days from bh group by athlete_id", "bh"),
)

# --- questions -----------------------------------------------------------------------------------

_R2 = {
    "literature_score": "literature_bone_stress_score", "personalized_score": "personalized_bone_stress_score", "frontier_score": "accumulated_frontier_state",
    "embedding_novelty_score": "embedding_novelty_score", "contrastive_novelty_score": "contrastive_novelty_score", "readiness_forecast_error_score": "readiness_forecast_error_score",
    "reference_similarity_score": "reference_block_similarity_score", "acwr": "running_acwr_score", "recovery_strain": "recovery_strain_score", "accumulated_state": "accumulated_bone_stress_state",
    "combined_score": "integrated_bone_stress_score",
}
_DAY_TEXT = {
    "alert_tier": "operational_alert_tier", "alert_label": "operational_alert_label", "combined_level": "bone_stress_risk_level", "reason": "bone_stress_risk_reason",
    "acwr_zone": "running_acwr_zone", "accumulated_level": "accumulated_bone_stress_level", "agreement": "monitoring_signal_agreement", "recommendation": "operational_recommendation",
}
_DAY_KM = {"run_7d_km": "running_7d_sum_m", "run_28d_km": "running_28d_sum_m", "run_today_km": "running_distance"}
_DAY_SQL = (
    "select athlete_id, date, day, "
    + ", ".join(f"{exact(c, 2)} as {n}" for n, c in _R2.items())
    + ", " + ", ".join(f"{exact(f'coalesce({c}, 0e0) / 1000e0', 1)} as {n}" for n, c in _DAY_KM.items())
    + ", " + ", ".join(f"{c} as {n}" for n, c in _DAY_TEXT.items()) + " from al"
)
C["dv"] = (["al"], "\n  " + _DAY_SQL)
_DV = [*_R2, *_DAY_KM]


def _dv(df: DataFrame) -> DataFrame:
    return show(df, KEY, _DV, list(_DAY_TEXT))


def _dv_sql(where: str) -> str:
    return build("select athlete_id, date, " + ", ".join(r(c, c) for c in _DV) + ", " + ", ".join(_DAY_TEXT) + f" from dv where {where}", "dv")


add("question_day", "Q01,P06", lambda s, d: _dv(questions.get_day(_scored(s, d), DAY_A)), _dv_sql(f"date = date '{DAY_A}'"))
add(
    "question_timeline", "Q17", lambda s, d: _dv(questions.days_timeline(_scored(s, d), [DAY_A, DAY_B, "2021-03-01"])),
    _dv_sql(f"date in (date '{DAY_A}', date '{DAY_B}', date '2021-03-01')"),
)
add(
    "question_latest_day", "Q17,O09", lambda s, d: _dv(questions.latest_day(_scored(s, d))),
    _dv_sql("date = (select max(x.date) from dv x where x.athlete_id = dv.athlete_id)"),
)
add(
    "question_compare_days", "Q02",
    lambda s, d: questions.compare_days(_scored(s, d), DAY_A, DAY_B).withColumn("key_differences", F.array_join("key_differences", " | ")),
    build(
        f"""select a.athlete_id, {exact('a.combined_score - b.combined_score', 2)} as score_change, {exact('a.run_7d_km - b.run_7d_km', 1)} as run_7d_change_km, {exact('a.run_28d_km - b.run_28d_km', 1)} as run_28d_change_km,
  b.alert_label || ' → ' || a.alert_label as alert_change, coalesce(nullif(concat_ws(' | ', case when a.alert_tier <> b.alert_tier then 'Alert tier: ' || b.alert_tier || ' → ' || a.alert_tier end,
    case when abs(a.combined_score - b.combined_score) > 10 then 'Score difference: ' || {fixed('abs(a.combined_score - b.combined_score)', 1)} || ' pts' end,
    case when abs(a.run_7d_km - b.run_7d_km) > 5 then '7-day volume: ' || b.run_7d_km || ' km → ' || a.run_7d_km || ' km' end,
    case when a.acwr_zone <> b.acwr_zone then 'ACWR zone: ' || b.acwr_zone || ' → ' || a.acwr_zone end), ''), 'No major differences') as key_differences
from dv a join dv b using (athlete_id) where a.date = date '{DAY_A}' and b.date = date '{DAY_B}'""",
        "dv",
    ),
)


def _around(s: SparkSession, d: str) -> DataFrame:
    out = questions.periods_around(_scored(s, d), DAY_A)
    return out.withColumns({"alerts": F.size("alerts_in_period").cast("bigint"), "top_days": joined("top_3_scores", "date", "score", "run_7d_km")}).drop("alerts_in_period", "top_3_scores")


add(
    "question_periods_around", "Q03,P06", _around,
    build(
        f"""select athlete_id, count(*) as alerts, {exact('min(integrated_bone_stress_score)', 2)} as min_score, {exact('max(integrated_bone_stress_score)', 2)} as max_score, {exact('avg(running_7d_sum_m) / 1000e0', 1)} as avg_run_7d,
  string_agg(date || '=' || {exact('integrated_bone_stress_score', 2)} || '=' || {exact('running_7d_sum_m / 1000e0', 1)}, ';' order by integrated_bone_stress_score desc, date) filter (where pos <= 3) as top_days
from (select *, row_number() over (partition by athlete_id order by integrated_bone_stress_score desc, date) as pos from al where date between date '{DAY_A}' - 7 and date '{DAY_A}' + 7) group by athlete_id""",
        "al",
    ),
)
add(
    "question_riskiest_period", "Q04", lambda s, d: questions.riskiest_period(kept(s, d, "bone_periods")).drop("metric", "summary"),
    build(
        f"""select athlete_id, start_date, end_date, calendar_days, elevated_days, {exact('peak_accumulated_bone_stress_state', 2)} as peak_state, {exact('mean_accumulated_bone_stress_state', 2)} as mean_state,
  {exact('peak_running_7d_km', 1)} as peak_7d_km, {exact('mean_running_7d_km', 1)} as mean_7d_km, dominant_bone_stress_reason as dominant_reason, period_level
from (select *, row_number() over (partition by athlete_id order by peak_accumulated_bone_stress_state desc, period_id) as pos from bp) where pos = 1""",
        "bp",
    ),
)
_TRACKS = {"literature": ("literature_bone_stress_score", "ll"), "personalized": ("personalized_bone_stress_score", "pl"), "frontier": ("accumulated_frontier_state", "lf")}
add(
    "question_highlighted_days", "Q05,O06",
    lambda s, d: show(questions.highlighted_days(_scored(s, d), "2021-02-01", "2021-04-01"), ["athlete_id", "track", "place"], ["score", "integrated_score", "run_7d_km"], ["date", "level", "reason"]),
    build(
        "select athlete_id, track, place, " + ", ".join((r(exact("score", 2), "score"), r(exact("integrated_bone_stress_score", 2), "integrated_score"), r(exact("running_7d_sum_m / 1000e0", 1), "run_7d_km")))
        + ", date, level, bone_stress_risk_reason as reason from (select *, row_number() over (partition by athlete_id, track order by score desc, date) as place from ("
        + "select *, max((level = 'high')::integer) over (partition by athlete_id, track) as any_high from ("
        + " union all ".join(f"select athlete_id, date, '{t}' as track, {c} as score, {v} as level, integrated_bone_stress_score, running_7d_sum_m, bone_stress_risk_reason from al where date between date '2021-02-01' and date '2021-04-01' and {c} is not null" for t, (c, v) in _TRACKS.items())
        + ")) where any_high = 0 or level = 'high') where place <= 8",
        "al",
    ),
)
add(
    "question_explain_day", "Q06",
    lambda s, d: questions.explain_day(_scored(s, d), DAY_A).select(
        *KEY, F.col("literature.score").alias("literature"), F.col("literature.acwr_zone").alias("zone"), F.col("personalized.accumulated_state").alias("state"),
        F.col("frontier.embedding_novelty_score").alias("novelty"), F.col("alert.agreement").alias("agreement"),
    ),
    build(f"select athlete_id, date, literature_score as literature, acwr_zone as zone, accumulated_state as state, embedding_novelty_score as novelty, agreement from dv where date = date '{DAY_A}'", "dv"),
)
_STEPS = ["from_7d_km", "to_7d_km", "actual_change_km", "actual_change_pct", "reference_target_km", "reference_change_km", "excess_vs_reference_km"]
C["weeks"] = (
    ["al"],
    f"""
  select athlete_id, grid, date, {exact('coalesce(running_7d_sum_m, 0e0) / 1000e0', 1)} as km from (
    select a.athlete_id, g.grid::date as grid, a.date, running_7d_sum_m, row_number() over (partition by a.athlete_id, g.grid order by abs(datediff('day', a.date, g.grid::date)), a.date) as pos
    from al a, (select unnest(generate_series(date '{DAY_A}' - 36, date '{DAY_A}', interval 7 days)) as grid) g where a.date between date '{DAY_A}' - 42 and date '{DAY_A}') where pos = 1""",
)
add(
    "question_progression_steps", "Q07,J12",
    lambda s, d: show(questions.progression_steps(_scored(s, d), DAY_A), ["athlete_id", "grid_date"], _STEPS, ["from_date", "to_date"]),
    build(
        "select athlete_id, grid as grid_date, " + ", ".join(
            r(e, n) for n, e in {
                "from_7d_km": "p", "to_7d_km": "km", "actual_change_km": exact("km - p", 1), "actual_change_pct": exact("case when p > 0 then (km - p) / p * 100e0 end", 1),
                "reference_target_km": exact("p + p * (10e0 / 100e0)", 1), "reference_change_km": exact("p * (10e0 / 100e0)", 1), "excess_vs_reference_km": exact("km - (p + p * (10e0 / 100e0))", 1),
            }.items()
        ) + ", pd as from_date, date as to_date from (select *, lag(km) over w as p, lag(date) over w as pd from weeks window w as (partition by athlete_id order by grid)) where p is not null",
        "weeks",
    ),
)
add(
    "question_progression", "Q07",
    lambda s, d: questions.progression(_scored(s, d), DAY_A).select(
        "athlete_id", F.size("week_to_week_steps").cast("bigint").alias("steps"), F.col("largest_excess_step.to_date").alias("largest_to"), "total_7d_volume_change_km", "total_7d_volume_change_pct"
    ),
    build(
        f"""select athlete_id, count(*) as steps, arg_max(date, (e, -datediff('day', date '1970-01-01', grid))) as largest_to, {exact('arg_max(km, grid) - arg_min(p, grid)', 1)} as total_7d_volume_change_km,
  {exact('case when arg_min(p, grid) > 0 then (arg_max(km, grid) - arg_min(p, grid)) / arg_min(p, grid) * 100e0 end', 1)} as total_7d_volume_change_pct
from (select *, {exact('km - (p + p * (10e0 / 100e0))', 1)} as e from (select *, lag(km) over (partition by athlete_id order by grid) as p from weeks) where p is not null) group by athlete_id""",
        "weeks",
    ),
)
_RANGES = {"a": ("2021-01-01", "2021-02-28"), "b": ("2021-02-15", "2021-04-15")}
_RCOLS = ["peak_integrated_score", "mean_integrated_score", "peak_frontier_score", "peak_literature_score", "peak_personalized_score", "peak_7d_km", "mean_7d_km", "peak_accumulated_state"]


def _compare_ranges(s: SparkSession, d: str) -> DataFrame:
    out = questions.compare_ranges(_scored(s, d), _RANGES)
    return out.select("athlete_id", "range", *_RCOLS, "days", "high_integrated_days", joined("agreement_counts", "label", "n").alias("agreement_counts"), joined("top_days", "date", "score").alias("top_days"))


C["rng"] = (
    ["al"],
    "\n  select *, row_number() over (partition by athlete_id, \"range\" order by integrated_bone_stress_score desc, date) as pos from ("
    + " union all ".join(f"select *, '{n}' as \"range\" from al where date between date '{a}' and date '{b}'" for n, (a, b) in _RANGES.items()) + ")",
)
_RANGE_SQL = ", ".join(
    f"{exact(e, k)} as {n}"
    for n, e, k in (
        ("peak_integrated_score", "max(integrated_bone_stress_score)", 2), ("mean_integrated_score", "round(avg(integrated_bone_stress_score), 9)", 2),
        ("peak_frontier_score", "max(accumulated_frontier_state)", 2), ("peak_literature_score", "max(literature_bone_stress_score)", 2),
        ("peak_personalized_score", "max(personalized_bone_stress_score)", 2), ("peak_7d_km", "max(running_7d_sum_m) / 1000e0", 1),
        ("mean_7d_km", "avg(running_7d_sum_m) / 1000e0", 1), ("peak_accumulated_state", "max(accumulated_bone_stress_state)", 2),
    )
)
add(
    "question_compare_ranges", "Q09,A13", _compare_ranges,
    build(
        f"""select m.*, c.agreement_counts from (select athlete_id, "range", {_RANGE_SQL}, count(*) as days, count(*) filter (where integrated_bone_stress_score >= 70) as high_integrated_days,
    string_agg(date || '=' || {exact('integrated_bone_stress_score', 2)}, ';' order by integrated_bone_stress_score desc, date) filter (where pos <= 3) as top_days
  from rng group by athlete_id, "range") m join (select athlete_id, "range", string_agg(label || '=' || n, ';' order by n desc, label) as agreement_counts from (
    select athlete_id, "range", monitoring_signal_agreement as label, count(*) as n from rng group by all) group by athlete_id, "range") c using (athlete_id, "range")""",
        "rng",
    ),
)


def _trend(s: SparkSession, d: str) -> DataFrame:
    out = questions.recent_trend(_scored(s, d))
    return out.withColumns({"alert_counts": joined("alert_counts", "label", "n"), "top_recent_days": joined("top_recent_days", "date", "score", "run_7d_km")})


_ALERTS = " || ';' || ".join(f"'{t}=' || count(*) filter (where operational_alert_label = '{t}')" for t in ("Adjust training", "Investigate state", "Watch", "Clear"))
add(
    "question_recent_trend", "Q10,W15,A13", _trend,
    build(
        f"""select athlete_id, last as end_date, last - 29 as start_date, count(*) as days, {exact('arg_max(integrated_bone_stress_score, date) - arg_min(integrated_bone_stress_score, date)', 2)} as integrated_change,
  {exact('(arg_max(running_7d_sum_m, date) - arg_min(running_7d_sum_m, date)) / 1000e0', 1)} as run_7d_change_km, {exact('arg_max(accumulated_bone_stress_state, date) - arg_min(accumulated_bone_stress_state, date)', 2)} as accumulated_state_change,
  {exact('max(integrated_bone_stress_score)', 2)} as peak_integrated_score, {exact('max(running_7d_sum_m) / 1000e0', 1)} as peak_7d_km, {_ALERTS} as alert_counts,
  string_agg(date || '=' || {exact('integrated_bone_stress_score', 2)} || '=' || {exact('running_7d_sum_m / 1000e0', 1)}, ';' order by integrated_bone_stress_score desc, date) filter (where pos <= 5) as top_recent_days
from (select *, row_number() over (partition by athlete_id order by integrated_bone_stress_score desc, date) as pos from (select *, max(date) over (partition by athlete_id) as last from al) where date >= last - 29) group by athlete_id, last""",
        "al",
    ),
)
add(
    "question_workout", "Q11,W16",
    lambda s, d: show(questions.workout_context(_scored(s, d), DAY_A), KEY, ["run_distance_km", "avg_speed", "aerobic_training_effect", "distance_percentile_vs_run_days"]),
    build(
        f"""select a.athlete_id, a.date, {r('km', 'run_distance_km')}, {r('running_avg_speed', 'avg_speed')}, {r('running_aerobic_te', 'aerobic_training_effect')},
  {r(exact('(select avg((b.running_distance / 1000 <= km)::integer::double) from bh b where b.athlete_id = a.athlete_id and b.running_distance > 0) * 100', 1), 'distance_percentile_vs_run_days')}
from (select *, {exact('coalesce(running_distance, 0e0) / 1000e0', 1)} as km from bh where date = date '{DAY_A}') a""",
        "bh",
    ),
)
add(
    "question_recovery_context", "Q12",
    lambda s, d: questions.recovery_context(_scored(s, d), DAY_A),
    build(
        "select athlete_id, date, " + ", ".join(f"{exact(c, 2)} as {c}" for c in ("actual", "prediction", "readiness_forecast_error", "readiness_forecast_error_score", "recovery_strain_score"))
        + f", {exact('readiness_forecast_error_score', 2)} as readiness_model_pessimism_score, {exact('running_7d_sum_m / 1000e0', 1)} as run_7d_km, {exact('running_28d_sum_m / 1000e0', 1)} as run_28d_km, {exact('accumulated_bone_stress_state', 2)} as accumulated_state, {exact('accumulated_frontier_state', 2)} as frontier_score from al where date = date '{DAY_A}'",
        "al",
    ),
)
add(
    "question_track_spread", "Q13", lambda s, d: questions.track_spread(_scored(s, d), DAY_A),
    build(
        f"select athlete_id, date, literature_score, personalized_score, frontier_score, combined_score as integrated_score, {exact('greatest(literature_score, personalized_score, frontier_score, combined_score) - least(literature_score, personalized_score, frontier_score, combined_score)', 2)} as score_spread, agreement from dv where date = date '{DAY_A}'",
        "dv",
    ),
)
add(
    "question_adjustment_options", "Q14",
    lambda s, d: questions.adjustment_options(_scored(s, d), DAY_A).select(
        *KEY, F.col("current_state.alert_label").alias("alert_label"), F.col("recent_trend.days").alias("trend_days"), F.col("recent_trend.integrated_change").alias("integrated_change")
    ),
    build(
        f"""select v.athlete_id, v.date, v.alert_label, t.trend_days, t.integrated_change from dv v join (select athlete_id, count(*) as trend_days, {exact('arg_max(integrated_bone_stress_score, date) - arg_min(integrated_bone_stress_score, date)', 2)} as integrated_change
  from (select *, max(date) over (partition by athlete_id) as last from al) where date >= last - 29 group by athlete_id) t using (athlete_id) where v.date = date '{DAY_A}'""",
        "dv", "al",
    ),
)
add(
    "question_case_file", "Q15",
    lambda s, d: questions.case_file(_scored(s, d), DAY_A).select(
        *KEY, F.col("summary_state.combined_score").alias("combined_score"), F.col("model_disagreement.agreement").alias("agreement"),
        F.size("progression.week_to_week_steps").cast("bigint").alias("steps"), F.col("recovery_context.recovery_strain_score").alias("recovery_strain"),
        F.col("recent_trend.days").alias("trend_days"), F.col("period_context.max_score").alias("max_score"), F.size("adjustment_plan.scenario_grid").cast("bigint").alias("grid"),
    ),
    build(
        f"""select v.athlete_id, v.date, v.combined_score, v.agreement, s.steps, v.recovery_strain, t.trend_days, p.max_score, 10::bigint as grid from dv v
left join (select athlete_id, count(*) - 1 as steps from weeks group by athlete_id having count(*) > 1) s using (athlete_id)
left join (select athlete_id, count(*) as trend_days from (select *, max(date) over (partition by athlete_id) as last from al) where date >= last - 29 group by athlete_id) t using (athlete_id)
left join (select athlete_id, {exact('max(integrated_bone_stress_score)', 2)} as max_score from al where date between date '{DAY_A}' - 14 and date '{DAY_A}' group by athlete_id) p using (athlete_id)
where v.date = date '{DAY_A}'""",
        "dv", "weeks", "al",
    ),
)

# --- periods looked up from days ---------------------------------------------------------------------


def _lookup(s: SparkSession, d: str) -> DataFrame:
    return periods.first_period_of_day(_scored(s, d).select(*KEY), kept(s, d, "bone_periods"), "dominant_bone_stress_reason")


add(
    "period_lookup", "J08,J11",
    lambda s, d: show(_lookup(s, d), KEY, [], ["period_id", "dominant_bone_stress_reason"]),
    build("select b.athlete_id, b.date, p.period_id::bigint as period_id, p.dominant_bone_stress_reason from bh b left join bp p on p.athlete_id = b.athlete_id and b.date between p.start_date and p.end_date", "bh", "bp"),
)
add(
    "active_period_lookup", "J09",
    lambda s, d: show(periods.active_period(_scored(s, d).select(*KEY), kept(s, d, "bone_periods")), KEY, [], ["period_id"]),
    build(
        """select athlete_id, date, period_id::bigint as period_id from (select b.athlete_id, b.date, p.period_id, row_number() over (partition by b.athlete_id, b.date order by p.peak_accumulated_bone_stress_state desc, p.period_id) as pos
  from bh b left join bp p on p.athlete_id = b.athlete_id and b.date between p.start_date and p.end_date + 7) where pos = 1""",
        "bh", "bp",
    ),
)
add(
    "period_overlap", "J10",
    lambda s, d: periods.overlapping(_targets(s, d), kept(s, d, "bone_periods"), ["event_id"], "window_start", "evaluation_end").select("athlete_id", "event_id", "period_id", F.col("overlap_rank").cast("bigint").alias("overlap_rank")),
    build(
        """select athlete_id, event_id, period_id::bigint as period_id, overlap_rank from (select t.athlete_id, t.event_id, p.period_id, row_number() over (partition by t.athlete_id, t.event_id order by p.peak_accumulated_bone_stress_state desc, p.period_id) as overlap_rank
  from targets t join bp p on p.athlete_id = t.athlete_id and p.start_date <= t.evaluation_end and p.end_date >= t.window_start) where overlap_rank <= 5""",
        "targets", "bp",
    ),
)
add(
    "period_payload", "G05,J11",
    lambda s, d: show(
        periods.period_payload(kept(s, d, "bone_periods"), _scored(s, d)), ["athlete_id", "period_id"], ["peak_state", "peak_km"],
        ["period_rank", "all_agree_days", "frontier_high_days", "literature_high_days", "active"],
    ),
    build(
        f"""select athlete_id, period_id::bigint as period_id, {r(exact('peak_accumulated_bone_stress_state', 1), 'peak_state')}, {r(exact('peak_running_7d_km', 1), 'peak_km')}, period_rank, all_agree_days, frontier_high_days, literature_high_days,
  covers and period_rank = min(period_rank) filter (where covers) over (partition by athlete_id) as active
from (select p.*, row_number() over (partition by p.athlete_id order by p.peak_accumulated_bone_stress_state desc, p.period_id) as period_rank, l.last between p.start_date and p.end_date + 7 as covers, c.all_agree_days, c.frontier_high_days, c.literature_high_days
  from bp p join (select athlete_id, max(date) as last from al group by athlete_id) l using (athlete_id)
  join (select p.athlete_id, p.period_id, count(*) filter (where monitoring_signal_agreement = 'all_agree') as all_agree_days, count(*) filter (where lf = 'high') as frontier_high_days, count(*) filter (where ll = 'high') as literature_high_days
    from bp p join al a on a.athlete_id = p.athlete_id and a.date between p.start_date and p.end_date group by all) c using (athlete_id, period_id)) where period_rank <= 24""",
        "bp", "al",
    ),
)

# --- profile, briefing, explorer -----------------------------------------------------------------------

_SNAP = {
    "total_days": "count(*)", "bone_high_days": "count(*) filter (where bone_stress_risk_level = 'high')",
    "personalized_not_literature": "count(*) filter (where pl = 'high' and ll <> 'high')", "literature_not_personalized": "count(*) filter (where ll = 'high' and pl <> 'high')",
    "dual_stress_days": "count(*) filter (where bone_stress_risk_level = 'high' and r_level = 'high' and coalesce(r_strain, 0) >= 55)",
    "low_run_elevated_days": "count(*) filter (where running_7d_sum_m / 1000 < 40 and bone_stress_risk_level in ('moderate', 'high'))", "big_week_days": "count(*) filter (where running_7d_sum_m / 1000 >= 100)",
    "frontier_without_load_days": "count(*) filter (where lf = 'high' and ll <> 'high')", "all_agree_days": "count(*) filter (where monitoring_signal_agreement = 'all_agree')",
    "literature_high_days": "count(*) filter (where ll = 'high')", "personalized_high_days": "count(*) filter (where pl = 'high')", "frontier_scored_days": "count(accumulated_frontier_state)",
    "frontier_high_days": "count(*) filter (where lf = 'high')", "high_magnitude_days": "count(*) filter (where running_edwards_speed_band = 'high_magnitude')",
}
_SNAP2 = ["run_days", "cycle_days", "recovery_high_days", "bone_periods", "recovery_periods"]


def _snapshot(s: SparkSession, d: str) -> DataFrame:
    return profile.profile_snapshot(_scored(s, d), kept(s, d, "recovery"), kept(s, d, "bone_periods"), kept(s, d, "risk_periods"), kept(s, d, "daily"))


add(
    "profile_snapshot", "R01,A19,A20",
    lambda s, d: show(_snapshot(s, d), ["athlete_id"], ["median_run_km", "median_monotony_high_days:2"], [*_SNAP, *_SNAP2]),
    build(
        f"""select a.athlete_id, round(w.median_run_km + {NUDGE}, 4) as median_run_km, round(a.mm + {NUDGE}, 2) as median_monotony_high_days, {', '.join(f'a.{n}' for n in _SNAP)}, w.run_days, w.cycle_days, coalesce(q.k, 0) as recovery_high_days, coalesce(b.k, 0) as bone_periods, coalesce(p.k, 0) as recovery_periods
from (select athlete_id, median(foster_monotony) filter (where bone_stress_risk_level = 'high') as mm, {', '.join(f'{e} as {n}' for n, e in _SNAP.items())} from (select al.*, rh.risk_level as r_level, rh.recovery_strain_score as r_strain from al left join rh using (athlete_id, date)) group by athlete_id) a
left join (select athlete_id, count(*) filter (where running_distance_m > 0) as run_days, count(*) filter (where cycling_distance_m > 0) as cycle_days, {exact('median(running_distance_m) filter (where running_distance_m > 0) / 1000e0', 1)} as median_run_km from daily group by athlete_id) w using (athlete_id)
left join (select athlete_id, count(*) filter (where risk_level = 'high') as k from rh group by athlete_id) q using (athlete_id)
left join (select athlete_id, count(*) as k from bp group by athlete_id) b using (athlete_id) left join (select athlete_id, count(*) as k from rp group by athlete_id) p using (athlete_id)""",
        "al", "rh", "bp", "rp", "daily",
    ),
)
add(
    "high_days_by_year", "A12", lambda s, d: show(profile.high_days_by_year(_scored(s, d)), ["athlete_id", "year"], [], ["high_days"]),
    build("select athlete_id, year(date) as year, count(*) filter (where bone_stress_risk_level = 'high') as high_days from bh group by all", "bh"),
)
add(
    "top_reasons", "A13", lambda s, d: show(profile.top_reasons(_scored(s, d)), ["athlete_id", "place"], [], ["days", "reason_label"]),
    build(
        "select athlete_id, place, days, replace(reason, '_', ' ') as reason_label from (select *, row_number() over (partition by athlete_id order by days desc, reason) as place from (select athlete_id, bone_stress_risk_reason as reason, count(*) as days from bh where bone_stress_risk_level = 'high' group by all)) where place <= 5",
        "bh",
    ),
)
_PEAK_KM = "coalesce(" + fixed("case when peak_running_7d_km > 500 then peak_running_7d_km / 1000e0 else peak_running_7d_km end") + " || ' km', '—')"
_PLAIN = (
    f"case when dominant_bone_stress_reason like '%progression%' then 'Running ramped quickly (' || {_PEAK_KM} || ' peak week) from ' || start_date || ' to ' || end_date || '.' "
    f"when dominant_bone_stress_reason like '%volume%' then 'Sustained high weekly running (' || {_PEAK_KM} || ' peak) over ' || calendar_days || ' days.' "
    f"when dominant_bone_stress_reason like '%hard running session%' then 'Hard sessions stacked during a ' || {_PEAK_KM} || ' running week.' else 'Elevated running-load block peaking at ' || {_PEAK_KM} || ' weekly volume.' end"
)
add(
    "profile_risk_windows", "O03,G04,F25",
    lambda s, d: show(profile.risk_windows(kept(s, d, "bone_periods")), ["athlete_id", "place"], [], ["start_date", "end_date", "peak_km", "summary"]),
    build(f"select athlete_id, place, start_date, end_date, {_PEAK_KM} as peak_km, {_PLAIN} as summary from (select *, row_number() over (partition by athlete_id order by peak_accumulated_bone_stress_state desc, period_id) as place from bp) where place <= 6", "bp"),
)
add(
    "athlete_profile", "R01,Q08,J09",
    lambda s, d: profile.profile(_scored(s, d), kept(s, d, "recovery"), kept(s, d, "bone_periods"), kept(s, d, "risk_periods"), kept(s, d, "daily")).select(
        "athlete_id", "total_days", joined("high_days_by_year", "year", "high_days").alias("years"), F.col("active_period.summary").alias("active_summary")
    ),
    build(
        f"""select a.athlete_id, a.total_days, a.years, p.summary as active_summary from (select athlete_id, sum(n)::bigint as total_days, string_agg(y || '=' || h, ';' order by y) as years, max(last) as last from (
    select athlete_id, year(date) as y, count(*) as n, count(*) filter (where bone_stress_risk_level = 'high') as h, max(date) as last from bh group by all) group by athlete_id) a
left join (select athlete_id, summary from (select p.athlete_id, {_PLAIN} as summary, row_number() over (partition by p.athlete_id order by p.peak_accumulated_bone_stress_state desc, p.period_id) as pos
    from bp p join (select athlete_id, max(date) as last from bh group by athlete_id) l on l.athlete_id = p.athlete_id and l.last between p.start_date and p.end_date + 7) where pos = 1) p using (athlete_id)""",
        "bh", "bp",
    ),
)
add(
    "daily_briefing", "R02,O09",
    lambda s, d: profile.briefing(_scored(s, d), kept(s, d, "recovery")).select(
        "athlete_id", "date", "operational_alert_tier", "recommendation", "run7_km", "accumulated_state", "contrastive_novelty", "recovery_risk_level", "recovery_reason",
        joined("track_rows", "track", "score", "level").alias("tracks"), joined("week_trend", "date").alias("week"),
    ),
    build(
        f"""select a.athlete_id, a.date, operational_alert_tier, operational_recommendation as recommendation, {exact('coalesce(running_7d_sum_m, 0e0) / 1000e0', 1)} as run7_km, {exact('accumulated_bone_stress_state', 1)} as accumulated_state,
  coalesce({fixed('contrastive_novelty_score')}, '—') as contrastive_novelty, r.risk_level as recovery_risk_level, r.risk_reason as recovery_reason,
  'Literature=' || {fixed('literature_bone_stress_score')} || '=' || ll || ';Personalized=' || {fixed('personalized_bone_stress_score')} || '=' || pl || ';Frontier=' || coalesce({fixed('accumulated_frontier_state')}, '—') || '=' || coalesce(lf, '—') || ';Combined=' || {fixed('bone_stress_risk_score')} || '=' || bone_stress_risk_level as tracks, w.week
from (select *, row_number() over (partition by athlete_id order by date desc) as age from al) a
join (select athlete_id, string_agg(date::varchar, ';' order by date) as week from (select *, row_number() over (partition by athlete_id order by date desc) as age from al) where age <= 7 group by athlete_id) w using (athlete_id)
left join (select athlete_id, arg_max(risk_level, date) as risk_level, arg_max(risk_reason, date) as risk_reason from rh group by athlete_id) r using (athlete_id) where a.age = 1""",
        "al", "rh",
    ),
)
_SHORT = "case when abs({x}) >= 100 then " + exact("{x}", 1).replace("{:.1f}", "{{:.1f}}") + " else " + exact("{x}", 2).replace("{:.2f}", "{{:.2f}}") + " end"


def short(x: str) -> str:
    return _SHORT.format(x=x)


def km_short(x: str) -> str:
    return exact(f"({short(x)}) / 1000e0", 1)


C["expl"] = (
    ["al", "bp", "rh"],
    f"""
  select a.*, {km_short('a.running_7d_sum_m')} as run7, {km_short('a.running_28d_sum_m')} as run28, {km_short('a.running_distance')} as runkm, h.risk_level, h.risk_reason, h.risk_score,
    p.start_date || ' → ' || p.end_date || ' (' || p.dominant_bone_stress_reason || ')' as period_label
  from al a left join bp p on p.athlete_id = a.athlete_id and a.date between p.start_date and p.end_date left join rh h on h.athlete_id = a.athlete_id and h.date = a.date""",
)
_INSIGHTS = f"""list_filter([
    case when accumulated_bone_stress_state >= 65 and run7 < 95 then 'Accumulated load state is elevated (' || {fixed('accumulated_bone_stress_state')} || ') while this 7-day window is only ' || {fixed('run7')} || ' km — strain is mostly carryover from earlier weeks, not this week''s absolute volume.' end,
    case when monitoring_signal_agreement = 'literature_personalized_agree_frontier_differs' then 'Literature and personalized tracks agree, but frontier differs — multivariate latent state is not matching the rule-based load picture.' end,
    case when operational_alert_tier = 'investigate_state' then 'Investigate-state tier: frontier is elevated while objective load rules are modest. Check recovery markers and mixed-sport fatigue before adding intensity.' end,
    case when lf = 'high' and ll <> 'high' then 'Frontier high with literature not high — learned-state strain without extreme km thresholds.' end,
    case when run28 >= 340 and run7 < run28 / 4.5e0 then '28-day running is high (' || {fixed('run28')} || ' km) but the latest 7-day window has eased (' || {fixed('run7')} || ' km).' end,
    case when period_label is not null then 'Falls inside detected load block: ' || period_label || '.' end], lambda t: t is not null)"""
add(
    "date_explorer_days", "R03,L11,J08,F25",
    lambda s, d: show(
        profile.explorer_days(_scored(s, d), kept(s, d, "recovery"), kept(s, d, "bone_periods")).withColumn("insights", F.array_join("insights", " | ")),
        KEY, ["run7Km", "run28Km", "runKm", "combinedScore", "literatureScore", "integratedScore", "recoveryRiskScore"], ["tier", "recoveryReason", "period_label", "insights"],
    ),
    build(
        f"""select athlete_id, date, {r('run7', 'run7Km')}, {r('run28', 'run28Km')}, {r('runkm', 'runKm')}, {r(short('bone_stress_risk_score'), 'combinedScore')}, {r(short('literature_bone_stress_score'), 'literatureScore')},
  {r(short('integrated_bone_stress_score'), 'integratedScore')}, {r(short('risk_score'), 'recoveryRiskScore')}, operational_alert_tier as tier, risk_reason as recoveryReason, period_label,
  case when len(t) > 0 then array_to_string(list_slice(t, 1, 5), ' | ') else 'No strong disagreement signals — dominant pattern: ' || replace(bone_stress_risk_reason, '_', ' ') || '.' end as insights
from (select *, {_INSIGHTS} as t from expl)""",
        "expl",
    ),
)
add(
    "date_explorer_anchors", "R03", lambda s, d: profile.explorer_anchors(_scored(s, d), 90000.0),
    build("select athlete_id, min(date) as date_start, max(date) as date_end, count(*) as day_count, min(date) filter (where running_7d_sum_m >= 90000) as big_week_date from bh group by athlete_id", "bh"),
)
add(
    "context_packs", "R06,P09,J09",
    lambda s, d: show(profile.context_packs(_scored(s, d), kept(s, d, "bone_periods")), [*KEY, "place"], ["literature_score", "run7_km", "accumulated_state"], ["operational_alert_tier", "period_context"]),
    build(
        f"""select f.athlete_id, f.date, f.place, {r('literature_bone_stress_score', 'literature_score')}, {r(exact('coalesce(running_7d_sum_m, 0e0) / 1000e0', 1), 'run7_km')}, {r('accumulated_bone_stress_state', 'accumulated_state')}, operational_alert_tier,
  (select arg_max(p.period_summary, (p.peak_accumulated_bone_stress_state, -p.period_id)) from bp p where p.athlete_id = f.athlete_id and f.date between p.start_date and p.end_date + 7) as period_context
from (select *, row_number() over (partition by athlete_id order by date desc) as place from (select *, max(date) over (partition by athlete_id) as last from al) where date >= last - 14 and operational_alert_tier <> 'clear') f where place <= 5""",
        "al", "bp",
    ),
)
