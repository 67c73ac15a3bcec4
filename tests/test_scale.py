"""What the queries cost: exchanges, bytes read and what is kept, on small rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

import __spark_entry__ as contract
from checks import registry
from paceframe.llm import common, simhash
from paceframe.operators import activities, quality
from paceframe.sources import exports

ACTIVITY = (
    "athlete_id bigint, activity_id bigint, date date, source_file string, record_ordinal bigint, activity_type string, "
    "activity_distance_m double, activity_duration_seconds double, activity_avg_hr double, activity_max_hr double"
)


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line and "Reused" not in line for line in plan.splitlines())


def test_records_are_dealt_out_once_for_the_daily_table(spark):
    rows = [(a, n, None, "a.fit", n, "running", 1000.0 * n, 300.0 * n, 120.0, 150.0) for a in (1, 2, None) for n in (1, 2, 2)]
    daily = activities.activities_to_daily(spark.createDataFrame(rows, ACTIVITY).withColumn("date", F.lit("2024-01-02").cast("date")))
    assert exchanges(daily) == 1
    assert sorted((r["athlete_id"] or 0, r["activity_count"]) for r in daily.collect()) == [(0, 2), (1, 2), (2, 2)]


def test_joins_by_day_take_rows_that_lie_by_athlete(spark, sf):
    text = next(name for name in contract.queries() if name.startswith("op5_"))
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    found = spark.conf.get(key)
    try:
        contract.queries()["track_deltas"](spark, sf)
        assert spark.conf.get(key) == "false"
        contract.queries()[text](spark, sf)
        assert spark.conf.get(key) == found
    finally:
        spark.conf.set(key, found)


def test_tables_of_large_sources_are_not_persisted(spark, sf, monkeypatch):
    registry.forget()
    before = registry.kept(spark, sf, "bone")
    want = sorted(map(str, before.collect()))
    assert before.storageLevel.useMemory
    registry.forget()
    monkeypatch.setattr(registry, "KEEP_BYTES", 0)
    try:
        assert not registry.kept(spark, sf, "daily").storageLevel.useMemory
        bone = registry.kept(spark, sf, "bone")
        assert not bone.storageLevel.useMemory and "parquet" in bone.inputFiles()[0]
        assert sorted(map(str, bone.collect())) == want
    finally:
        registry.forget()


def test_a_number_in_a_text_field_does_not_open_the_file_again(spark, tmp_path):
    rows = [{"calendarDate": "2024-01-02", "valueInML": n, "estimatedSweatLossInML": n + 0.5, "duration": n} for n in range(2000)]
    folder = tmp_path / "athlete_id=7"
    folder.mkdir()
    file = folder / "HydrationLogFile_1.json"
    file.write_text(json.dumps(rows))
    read = lambda: spark._jvm.org.apache.hadoop.fs.FileSystem.getGlobalStorageStatistics().get("file").getLong("bytesRead")
    before = read()
    got = exports.read_hydration(spark, str(tmp_path)).agg(F.count("date"), F.sum("hydration_value_ml"), F.max("athlete_id")).first()
    assert tuple(got) == (2000, float(sum(range(2000))), 7)
    assert read() - before < 4 * file.stat().st_size


def test_op12_does_not_broadcast_what_an_explode_has_multiplied(spark, monkeypatch):
    nodes = common.staged(spark.createDataFrame([(k << 40,) for k in range(1, 40)] + [((k << 40) + 1,) for k in range(1, 40)], "fp long"))
    plans = []

    def staged(df, keep=common.staged):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(simhash.common, "staged", staged)
    assert simhash.linked_roots(nodes).count() == 77  # the root itself is left out
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]


def test_describe_keeps_a_row_per_day(spark):
    rows = spark.createDataFrame([(1, 1.0, None), (1, 3.0, None), (2, None, 5.0)], "athlete_id bigint, a double, b double")
    got = quality.describe(rows, ["a", "b"])
    assert "Generate inline" not in got._jdf.queryExecution().optimizedPlan().toString().partition("Aggregate")[2]
    found = {(r["athlete_id"], r["column"]): (r["count"], r["mean"], r["p50"], r["missing_pct"]) for r in got.collect()}
    assert found == {(1, "a"): (2, 2.0, 2.0, 0.0), (1, "b"): (0, None, None, 100.0), (2, "a"): (0, None, None, 100.0), (2, "b"): (1, 5.0, 5.0, 0.0)}
