"""Hand-made edge cases with exact expectations."""

from __future__ import annotations

import datetime as dt
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paceframe.functions import convert, risk
from paceframe.functions.numbers import clamp, exact_round, fixed_text, km_text, pct_delta, share_text
from paceframe.functions.vectors import cosine, distance, dot, norm
from paceframe.operators import activities, daily, embeddings, periods, state, trailing
from paceframe.operators.order_statistics import SortedSeries, in_days
from paceframe.plans import bone_stress
from paceframe.sources import exports, tables


def day(n: int) -> dt.date:
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def values(spark, column, rows, kind="double"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def series(spark, rows, schema):
    """Rows of one athlete from (day number, ...) tuples."""
    return spark.createDataFrame([(1, day(r[0]), *r[1:]) for r in rows], f"athlete_id bigint, date date, {schema}")


def by_day(df, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.orderBy("date").select(*columns).collect()]


def test_thresholds_sit_on_the_documented_side(spark):
    assert values(spark, risk.acwr_risk("x"), [0.79, 0.8, 1.0, 1.3, 1.5, 1.8, 1.9, None]) == [25, 20, 20, 35, 65, 85, 100, 0]
    zones = ["undertraining", "sweet_spot", "sweet_spot", "elevated_progression", "danger_zone", "unknown"]
    assert values(spark, risk.acwr_zone("x"), [0.79, 0.8, 1.3, 1.5, 1.51, None]) == zones
    assert values(spark, risk.speed_risk("x"), [2.5, 3.5, 4.5, 4.6, None]) == [15, 40, 75, 95, 0]
    assert values(spark, risk.speed_band("x"), [0.0, 2.5, 3.5, 4.5, 5.0]) == ["none", "low_magnitude", "moderate", "elevated", "high_magnitude"]
    assert values(spark, risk.volume_risk("x"), [15.0, 30.0, 50.0, 70.0, 90.0, 110.0, 130.0, 131.0]) == [10, 25, 40, 55, 70, 82, 92, 100]
    assert values(spark, risk.monotony_risk("x"), [0.0, 1.49, 1.5, 2.0, 2.5]) == [0, 20, 40, 65, 85]
    assert values(spark, risk.readiness_risk("x"), [20.0, 35.0, 50.0, 51.0, None]) == [100, 80, 55, 0, 0]
    assert values(spark, risk.level("x"), [44.9, 45.0, 70.0, None]) == ["low", "moderate", "high", "low"]
    assert values(spark, risk.state_level("x"), [64.9, 65.0]) == ["moderate", "high"]


def test_units_and_dates(spark):
    assert values(spark, convert.to_seconds("x"), [86400.0, 86401.0, None]) == [86400.0, 86.401, None]
    assert values(spark, convert.to_meters("x"), [100000.0, 100001.0]) == [100000.0, 1000.01]
    texts = ["1704153600", "1704153600000", "2024-01-02T23:30:00+09:00", "2024-01-02", "oops", "2024-13-45", "", None]
    d = dt.date(2024, 1, 2)
    assert values(spark, convert.normalize_date("x"), texts, "string") == [d, d, d, d, None, None, None, None]
    kinds = ["trail_running", "Mountain_Biking", "walking", "open_water_swimming", "yoga", None]
    assert values(spark, convert.sport_family("x"), kinds, "string") == ["running", "cycling", "hiking", "swimming", "other", "other"]
    names = ["x_summarizedActivities.json", "UDSFile_1.json", "a_UDSFile.json", "u_healthStatusData.json"]
    assert values(spark, convert.json_family("x"), names, "string") == ["activity_summary", "wellness", "generic_json", "health_status"]


def test_exact_rounding_and_text(spark):
    assert values(spark, exact_round("x", 1), [45.15, 0.25, 0.35, -0.25]) == [round(v, 1) for v in (45.15, 0.25, 0.35, -0.25)]
    assert values(spark, exact_round("x", 2), [2.675, 1.005, 0.125]) == [round(v, 2) for v in (2.675, 1.005, 0.125)]
    assert values(spark, fixed_text("x", 0, sign=True), [2.5, -0.4, None]) == [f"{2.5:+.0f}", f"{-0.4:+.0f}", None]
    assert values(spark, clamp("x"), [-1.0, 101.0, None]) == [0.0, 100.0, None]
    assert values(spark, km_text("x"), [120.0, 12000.0, None]) == ["120 km", "12 km", "—"]
    assert values(spark, pct_delta("x", F.lit(0.0)), [1.0]) == [None]
    assert values(spark, share_text("x", F.lit(0)), [1.0]) == ["0%"]


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    row = spark.range(1).select(norm(a), dot(a, a), distance(a, b), cosine(a, b), cosine(a, a), cosine(a, F.lit(None).cast("array<double>"))).first()
    assert tuple(row) == (5.0, 25.0, 5.0, 0.0, 1.0, None)


def test_percentile_needs_seven_values(spark):
    frame = series(spark, [(i, float(i)) for i in range(9)], "v double")
    ranked = trailing.add_ranks(frame, [trailing.Rank("r", "v"), trailing.Rank("low", "v", high=False)])
    assert by_day(ranked, "r")[6:] == [0.0, 100.0, 100.0]
    assert by_day(ranked, "low")[6:] == [0.0, 0.0, 0.0]


def test_ranks_in_stretches_are_plain_counts():
    r = random.Random(6)
    for n in (1, 2, 7, 60, 300):
        values = [r.choice([None, float("nan"), r.randrange(8) / 2, r.random()]) for _ in range(n)]
        days = np.cumsum([r.randrange(3) for _ in range(n)])
        made = SortedSeries(pa.chunked_array([pa.array(values, pa.float64())]))
        limits = np.array([r.choice([r.randrange(8) / 2, float("nan"), -1.0, 9.0]) for _ in range(n)])
        for first, last in ((-28, -1), (-5, -3), (0, 0), (-1, -9)):
            lo, hi = in_days(days, first, last)
            got = made.not_above(lo, hi, limits)
            within = lambda v, x: x != x or v == v and v <= x  # noqa: E731  as in Spark, NaN is the greatest value
            for i in range(n):
                mine = [v for v, d in zip(values, days) if v is not None and first <= d - days[i] <= last]
                assert (made.sizes(lo, hi)[i], got[i]) == (len(mine), sum(within(v, limits[i]) for v in mine))


def test_ranks_need_no_list_per_window(spark, sf):
    from checks.registry import kept

    plan = bone_stress.bone_stress_history(kept(spark, sf, "enriched"))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "_h28_" not in plan and "_whole" not in plan


def test_monotony_of_zero_and_constant_weeks(spark):
    frame = series(spark, [(i, 0.0) for i in range(7)] + [(i, 5.0) for i in range(20, 27)], "v double")
    out = by_day(trailing.monotony(frame, "v"), "foster_monotony", "foster_strain")
    assert out[6] == (0.0, 0.0)
    assert out[-1] == (10.0, 350.0)


def test_linear_carry_matches_the_recursion(spark):
    xs = [float((i * 37) % 100) for i in range(60)]
    got = by_day(state.linear_carry(series(spark, list(enumerate(xs)), "v double"), "v", "s", 0.91), "s")
    carry = 0.0
    for x, g in zip(xs, got):
        carry = 0.91 * carry + 0.09 * x
        assert g == pytest.approx(carry, abs=1e-12)


def test_asymmetric_state_keeps_state_over_a_gap(spark):
    rows = [(0, 50.0, 10000.0, 0.0, 0.0), (1, None, 10000.0, 0.0, 0.0), (2, 10.0, 10000.0, 0.0, 0.0), (3, 10.0, 90000.0, 0.0, 0.0)]
    frame = series(spark, rows, "frontier_strain_score double, running_7d_sum_m double, recovery_strain_score double, accumulated_bone_stress_state double")
    got = by_day(state.asymmetric_state(frame), "accumulated_frontier_state")
    assert got == [35.0, None, pytest.approx(35.0 * 0.88), pytest.approx(35.0 * 0.88 * 0.97)]


def test_maps_of_stretches_compose_to_the_fold():
    r = random.Random(4)
    for n in [*range(6), 40, 200]:
        for _ in range(20):
            rows = [(None if r.random() < 0.1 else r.choice([r.uniform(0, 100), r.uniform(0, 20), 0.0, 100.0, 130.0, -5.0]), r.choice([0.88, 0.91, 0.94, 0.97])) for _ in range(n)]
            knots = state.composed(rows)
            assert [x for x, _ in knots] == sorted(x for x, _ in knots) and [y for _, y in knots] == sorted(y for _, y in knots)
            for entry in (0.0, 100.0, r.uniform(0, 100)):
                want = ([entry] + [s for s in state.replayed(entry, rows) if s is not None])[-1]
                i = max(1, min(sum(x <= entry for x, _ in knots), len(knots) - 1))
                (x0, y0), (x1, y1) = knots[i - 1], knots[i]
                assert y0 + (entry - x0) * (y1 - y0) / (x1 - x0) == pytest.approx(want, abs=1e-9)


def test_states_over_blocks_are_those_of_the_fold(spark, monkeypatch):
    monkeypatch.setattr(state, "BLOCK_DAYS", 8)
    r = random.Random(5)
    kinds = "frontier_strain_score double, running_7d_sum_m double, recovery_strain_score double, accumulated_bone_stress_state double"
    rows, want = [], []
    carried = 0.0
    for i in range(150):
        if r.random() < 0.2:
            continue
        value = None if r.random() < 0.15 else r.uniform(0, 100) if r.random() < 0.3 else r.uniform(0, 15)
        km, recovery, load = r.uniform(0, 100), r.uniform(0, 70), r.uniform(0, 80)
        rate = 0.97 if km >= 80 or recovery >= 55 or load >= 70 else 0.88 if km <= 35 and recovery <= 35 and load <= 45 else 0.91 if km <= 50 and recovery <= 45 and load <= 55 else 0.94
        if value is not None:
            carried = carried + 0.7 * (value - carried) if value > carried else max(value, carried * rate)
        rows.append((i, value, km * 1000, recovery, load))
        want.append(None if value is None else pytest.approx(carried, abs=1e-9))
    one = series(spark, rows, kinds)
    both = one.unionByName(one.withColumn("athlete_id", F.lit(2).cast("bigint")).limit(1))
    out = state.asymmetric_state(both.withColumn("other", F.lit("x")))
    assert by_day(out.filter("athlete_id = 1"), "accumulated_frontier_state") == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("other" not in line for line in plan.splitlines() if "MapInArrow" in line)


def test_risk_period_gap_of_two_joins_and_three_splits(spark):
    def scored(gap):
        days = [0, 1, 2, 2 + gap, 3 + gap, 4 + gap]
        rows = [(d, 60.0, "low", 50.0, 50.0, 50.0, 50.0, "low risk") for d in days]
        return series(spark, rows, "accumulated_risk_state double, risk_level string, recovery_strain_score double, metabolic_fatigue_score double, tissue_load_score double, readiness double, risk_reason string")

    assert periods.risk_periods(scored(2)).count() == 1
    assert periods.risk_periods(scored(3)).count() == 2


def test_long_cluster_is_cut_at_the_latest_largest_gap():
    days = [0, 1, 2, 3, 4, 8, 9, 10, 11, 12] + list(range(16, 60, 4))
    parts = periods.split_long_cluster(days, 49, 5)
    assert all(p[-1] - p[0] + 1 <= 49 for p in parts)
    lone = [0, 3, 6, 9, 60, 63, 66, 69]
    assert periods.split_long_cluster(lone, 49, 5) == [lone]
    equal = [0, 1, 2, 3, 4, 30, 31, 32, 33, 34, 60, 61, 62, 63, 64]
    assert periods.split_long_cluster(equal, 49, 5) == [equal[:10], equal[10:]]


def test_neighbour_seven_days_before_is_excluded(spark):
    frame = series(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (8, [1.0, 0.0])], "z array<double>")
    near = embeddings.nearest_earlier(frame)
    assert [r["neighbor_date"] for r in near.collect()] == [day(0)]


def test_neighbours_across_blocks_match_brute_force(spark):
    rows = [(i, [float((i * 17) % 23), float((i * 31) % 19)]) for i in range(0, 700, 3)]
    got = {(r["date"], r["neighbor_rank"]): r["neighbor_date"] for r in embeddings.nearest_earlier(series(spark, rows, "z array<double>")).collect()}
    for i, v in rows[::20]:
        order = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in rows if j < i - 7)
        for rank, (_, j) in enumerate(order[:3], 1):
            assert got[(day(i), rank)] == day(j)


def test_plans_limit_hot_keys_before_the_exchange(spark, sf):
    from checks import fixtures as fx

    plan = activities.dedup_by_id(fx.activities(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    rollup = activities.daily_rollup(activities.with_sport_family(fx.activities(spark, sf)))
    assert "partial_sum" in rollup._jdf.queryExecution().executedPlan().toString()


def test_key_isolation(spark):
    rows = [(i, float((i * 13) % 50)) for i in range(40)]
    one = series(spark, rows, "v double")
    both = one.unionByName(one.withColumn("athlete_id", F.lit(2).cast("bigint")))
    ranked = trailing.add_ranks(both, [trailing.Rank("r", "v")], [trailing.RollingRank("q", "v", 7, 28)])
    a = by_day(ranked.filter("athlete_id = 1"), "r", "q")
    assert a == by_day(ranked.filter("athlete_id = 2"), "r", "q")


def test_refresh_replaces_columns(spark):
    old = series(spark, [(0, 1.0, 2.0)], "a double, b double")
    new = series(spark, [(0, 9.0)], "b double")
    assert by_day(daily.refresh_columns(old, new, ["b"]), "a", "b") == [(1.0, 9.0)]


def test_export_files(spark, tmp_path):
    home = tmp_path / "athlete_id=7" / "sub"
    home.mkdir(parents=True)
    act = {"activityId": 1, "activityType": "running", "startTimeLocal": "2024-01-02T08:00:00", "duration": 3600000, "distance": 1000000}
    (home / "a_summarizedActivities.json").write_text(json.dumps([{"summarizedActivitiesExport": [act, {"activityId": 2}]}]))
    (home / "b_summarizedActivities.json").write_text("[{oops")
    sleep = {"calendarDate": "2024-01-02", "deepSleepSeconds": 100, "remSleepSeconds": 50, "awakeSleepSeconds": 10, "napList": [{"napTimeSec": 5}, {}]}
    (home / "x_sleepData.json").write_text(json.dumps([sleep]))
    wellness = {"calendarDate": "2024-01-02", "restingHeartRate": 50, "bodyBattery": {"chargedValue": 60}, "list": [1]}
    (home / "UDSFile_1.json").write_text(json.dumps(wellness))
    lap = "<Lap><TotalTimeSeconds>600</TotalTimeSeconds><DistanceMeters>2000</DistanceMeters>{}</Lap>"
    beats = "<Track><Trackpoint><HeartRateBpm><Value>150</Value></HeartRateBpm></Trackpoint><Trackpoint><HeartRateBpm><Value>152</Value></HeartRateBpm></Trackpoint></Track>"
    (home / "w.tcx").write_text(f'<T xmlns="u"><Activities><Activity Sport="Running"><Id>2024-01-03T06:00:00Z</Id>{lap.format(beats)}{lap.format("")}</Activity></Activities></T>')
    (home / "g.xml").write_text("<r><date>2024-01-04</date><a>1</a><a>2.5</a><b>text</b></r>")
    (home / "nodate.csv").write_text("a,b\n1,2\n")
    root = str(tmp_path)

    runs = exports.read_activity_summaries(spark, root).collect()
    assert [(r["athlete_id"], r["activity_id"], r["date"], r["activity_duration_seconds"], r["activity_distance_m"]) for r in runs] == [(7, 1, day(1), 3600.0, 10000.0)]
    assert exports.unreadable_json(spark, root).count() == 1
    slept = exports.read_sleep(spark, root).first()
    assert (slept["sleep_total_seconds"], slept["sleep_total_in_bed_seconds"], slept["sleep_nap_seconds"], slept["sleep_light_seconds"]) == (150.0, 160.0, 5.0, None)
    fields = exports.read_daily_family(spark, root, "wellness", ["restingHeartRate", "bodyBattery_chargedValue", "list"]).first()
    assert (fields["wellness_restingHeartRate"], fields["wellness_bodyBattery_chargedValue"], fields["wellness_list"]) == ("50", "60", None)
    tcx = exports.read_tcx(spark, root).first()
    assert (tcx["activity_duration_seconds"], tcx["activity_distance_m"], tcx["activity_avg_hr"], tcx["activity_max_hr"], tcx["activity_calories"]) == (1200.0, 4000.0, 151.0, 152.0, None)
    xml = exports.read_xml(spark, root, ["a", "b"]).first()
    assert (xml["date"], xml["xml_a"], xml["xml_b"]) == (day(3), 2.5, None)
    assert exports.read_csv(spark, root) is None
    built = exports.build_daily_features(exports.read_categories(spark, root, {"wellness": ["restingHeartRate"]}))
    assert [r["date"] for r in built.orderBy("date").collect()] == [day(1), day(2)]


def test_event_config(spark, tmp_path):
    path = tmp_path / "events.json"
    path.write_text(json.dumps({"events": [{"athlete_id": 1, "id": "e", "onset_date": "2024-04-01"}], "reference_periods": [{"athlete_id": 1, "id": "p", "start_date": "2024-01-01", "end_date": "2024-01-05"}]}))
    events, spans = tables.read_event_config(spark, str(path))
    row = events.first()
    assert (row["label"], row["symptom_window_start"]) == ("e", dt.date(2024, 4, 1))
    assert spans.first()["end_date"] == dt.date(2024, 1, 5)


def test_ridge_matches_the_closed_form(spark):
    import numpy as np

    from paceframe.operators import learners

    rng = np.random.default_rng(7)
    x, noise = rng.normal(size=(60, 3)), rng.normal(size=60)
    y = x @ np.array([2.0, -1.0, 0.5]) + 40 + noise
    rows = [(1, day(i), "train" if i < 45 else "test", float(y[i]), [float(v) for v in x[i]]) for i in range(60)]
    frame = spark.createDataFrame(rows, "athlete_id bigint, date date, split string, target double, vector array<double>")
    got = [r["ridge"] for r in learners.ridge_predictions(frame).orderBy("date").collect()]
    tx, ty = x[:45], y[:45]
    centred = tx - tx.mean(axis=0)
    weights = np.linalg.solve(centred.T @ centred + 10.0 * np.eye(3), centred.T @ (ty - ty.mean()))
    expected = (x - tx.mean(axis=0)) @ weights + ty.mean()
    assert np.allclose(got, expected, atol=1e-8)


def test_gram_matrix_is_the_sum_of_outer_products(spark):
    from paceframe.operators import learners

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(50, 4)), rng.normal(size=50)
    rows = [(x[i].tolist(), float(y[i])) for i in range(50)] + [(None, 1.0), ([1.0] * 4, None)]
    made = learners.gram_matrix(spark.createDataFrame(rows, "vector array<double>, target double").repartition(5))
    whole = np.column_stack([x, np.ones(50), y])
    assert np.allclose(made, whole.T @ whole)
    assert not len(learners.gram_matrix(spark.createDataFrame([], "vector array<double>, target double")))


def test_trees_find_a_split_known_by_hand(spark):
    from paceframe.operators import learners

    rows = [(1, day(i), "train" if i < 80 else "test", 10.0 if i % 10 < 4 else 50.0, [float(i % 10), float(i % 3)]) for i in range(100)]
    frame = spark.createDataFrame(rows, "athlete_id bigint, date date, split string, target double, vector array<double>")
    found = learners.tree_predictions(frame).collect()
    assert all(abs(r["trees"] - r["target"]) < 1e-6 for r in found)
