"""Queries on state vectors, model tables and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.registry import add, kept, show, table_query
from checks.sqlparts import HISTORY, NUDGE, C, build
from paceframe.functions.vectors import norm
from paceframe.operators import daily, datasets, embeddings, learners, quality
from paceframe.plans import feedback

KEY = ["athlete_id", "date"]

C["vec"] = (
    [],
    "\n  select label::bigint + 10 * (vec_id // 1000) as athlete_id, date '2024-01-01' + (vec_id % 1000)::integer as date, embedding::double[] as z from embeddings",
)
C["vlong"] = (
    ["vec"],
    f"""
  select athlete_id, date, day, i, x, avg(x) over (partition by athlete_id, i order by day rows between 28 preceding and 1 preceding) as m,
    lag(x) over (partition by athlete_id, i order by day) as px
  from (select athlete_id, date, datediff('day', date '1970-01-01', date) as day, i, z[i] as x from vec, range(1, 65) t(i))""",
)
C["vanom"] = (
    ["vlong"],
    f"""
  select *, case when ds > 0 then (embedding_distance - dm) / ds else 0e0 end as anomaly_zscore from (
    select *, avg(embedding_distance) over w as dm, stddev_pop(embedding_distance) over w as ds from (
      select athlete_id, date, day, coalesce(round(sqrt(sum((x - m) * (x - m))), 9), 0e0) as embedding_distance, sqrt(sum(x * x)) as embedding_norm,
        coalesce(sqrt(sum((x - px) * (x - px))), 0e0) as embedding_drift from vlong group by all)
    window w as ({HISTORY} rows between 28 preceding and 1 preceding))""",
)
table_query(
    "embedding_anomaly", "W12,W13,E01", lambda s, d: kept(s, d, "vectors"), "vanom",
    ["embedding_distance", "embedding_norm", "embedding_drift", "anomaly_zscore"],
)


def _knn_sql(distance: str, source: str, gap: int, k: int, where: str = "true") -> str:
    return f"""select athlete_id, date, neighbor_rank, neighbor_date, neighbor_distance from (
  select a.athlete_id, a.date, b.date as neighbor_date, {distance} as neighbor_distance,
    row_number() over (partition by a.athlete_id, a.date order by {distance}, b.date) as neighbor_rank
  from {source} a join {source} b on a.athlete_id = b.athlete_id and b.date < a.date - {gap} and {where}) where neighbor_rank <= {k}"""


_D64 = "list_distance(a.z, b.z)"
_D4 = "sqrt(" + " + ".join(f"(a.z[{i}] - b.z[{i}]) * (a.z[{i}] - b.z[{i}])" for i in range(1, 5)) + ")"
_NEAR = ["athlete_id", "date", "neighbor_rank"]
add(
    "embedding_knn", "E06,O07,J13",
    lambda s, d: show(embeddings.nearest_earlier(fx.vectors(s, d)), _NEAR, ["neighbor_distance"], ["neighbor_date"]),
    build(f"select athlete_id, date, neighbor_rank, neighbor_date, round(neighbor_distance + {NUDGE}, 4) as neighbor_distance from ({_knn_sql(_D64, 'vec', 7, 3)})", "vec"),
)
add(
    "embedding_neighbor_sentences", "E08,U06",
    lambda s, d: embeddings.neighbor_text(embeddings.nearest_earlier(fx.vectors(s, d))),
    build(
        f"select athlete_id, date, 'Latent state resembles ' || string_agg(neighbor_date::varchar, ', ' order by neighbor_rank) || '.' as embedding_neighbor_summary from ({_knn_sql(_D64, 'vec', 7, 3)}) group by all",
        "vec",
    ),
)


def _normal(s: SparkSession, d: str) -> DataFrame:
    listed = feedback.normal_neighbors(kept(s, d, "vectors"))
    parsed = listed.select(*KEY, F.posexplode(feedback.parse_neighbors(F.col("nearest_previous_normal_days"))).alias("place", "n"))
    return parsed.select(*KEY, (F.col("place") + 1).alias("place"), F.col("n.date").cast("date").alias("neighbor_date"), F.col("n.distance").alias("distance"), F.col("n.anomaly_zscore").alias("anomaly_zscore"))


add(
    "embedding_normal_neighbors", "E07,F27,J13",
    lambda s, d: show(_normal(s, d), [*KEY, "place"], ["distance", "anomaly_zscore"], ["neighbor_date"]),
    build(
        f"""select athlete_id, date, place, neighbor_date, round(dist + {NUDGE}, 4) as distance, round(az + {NUDGE}, 4) as anomaly_zscore from (
  select a.athlete_id, a.date, b.date as neighbor_date, list_distance(a.z, b.z) as dist, n.anomaly_zscore as az,
    row_number() over (partition by a.athlete_id, a.date order by list_distance(a.z, b.z), b.date) as place
  from vec a join vec b on a.athlete_id = b.athlete_id and b.date < a.date join vanom n on n.athlete_id = b.athlete_id and n.date = b.date and n.anomaly_zscore <= 1)
where place <= 3""",
        "vec", "vanom",
    ),
)


def _centroids(s: SparkSession, d: str) -> DataFrame:
    windows = embeddings.reference_windows(fx.vector_events(s, d), 28)
    made = embeddings.window_centroids(fx.vectors(s, d), windows, ["event_id"], fx.VECTOR_DIM)
    return made.select("athlete_id", "event_id", norm("centroid").alias("length"), F.get("centroid", F.lit(0)).alias("first_value"))


add(
    "event_centroids", "E02",
    lambda s, d: show(_centroids(s, d), ["athlete_id", "event_id"], ["length", "first_value"]),
    build(
        f"""select athlete_id, 'spring_block' as event_id, round(sqrt(sum(m * m)) + {NUDGE}, 4) as length, round(max(m) filter (where i = 1) + {NUDGE}, 4) as first_value
from (select athlete_id, i, avg(x) as m from vlong where date between date '2024-01-25' and date '2024-02-10' + 28 group by all) group by athlete_id""",
        "vlong",
    ),
)


def _archetypes(s: SparkSession, d: str) -> DataFrame:
    return embeddings.build_archetypes(
        kept(s, d, "embeddings"), kept(s, d, "scored"), fx.events(s, d), fx.reference_periods(s, d), kept(s, d, "bone_periods"), fx.STATE_DIM
    )


_MEANS = ", ".join(f"avg(z[{i}]) as c{i}" for i in range(1, 5))
C["arch"] = (
    ["emb", "ev", "refp", "bp", "bh"],
    f"""
  select athlete_id, 1 as kind, '1' as place, 'event_spring_block' as archetype_id, 'Bone stress injury' as archetype_label, {_MEANS}
    from emb join ev using (athlete_id) where date between symptom_window_start and onset_date + 14 group by athlete_id
  union all
  select athlete_id, 2, '1', 'summer_block', 'Summer load block', {_MEANS} from emb join refp using (athlete_id) where date between start_date and end_date group by athlete_id
  union all
  select athlete_id, 3, pos::varchar, 'period_' || period_id, 'High load block ' || start_date, {_MEANS} from emb join (
      select *, row_number() over (partition by athlete_id order by peak_accumulated_bone_stress_state desc, period_id) as pos from bp) using (athlete_id)
    where pos <= 2 and date between start_date and end_date group by athlete_id, pos, period_id, start_date
  union all
  select athlete_id, 4, '', 'stable_high_volume', 'Stable high-volume running', {_MEANS} from emb join (
      select athlete_id, date from (select athlete_id, date, count(*) over (partition by athlete_id) as k,
          row_number() over (partition by athlete_id order by running_7d_sum_m desc, day) as pos from bh where bone_stress_risk_level = 'low' and running_7d_sum_m > 20000)
      where k >= 14 and pos <= 28) using (athlete_id, date) group by athlete_id""",
)
add(
    "archetypes", "E03,P07",
    lambda s, d: show(
        _archetypes(s, d).withColumns({f"c{i}": F.get("centroid", F.lit(i - 1)) for i in range(1, 5)}),
        ["athlete_id", "archetype_id"], ["c1", "c2", "c3", "c4"], ["kind", "archetype_label"],
    ),
    build("select athlete_id, archetype_id, " + ", ".join(f"round(c{i} + {NUDGE}, 4) as c{i}" for i in range(1, 5)) + ", kind, archetype_label from arch", "arch"),
)
_ZL, _CL = "sqrt(z[1]*z[1]+z[2]*z[2]+z[3]*z[3]+z[4]*z[4])", "sqrt(c1*c1+c2*c2+c3*c3+c4*c4)"
C["amatch"] = (
    ["arch", "emb"],
    f"""
  select athlete_id, date, archetype_id as reference_archetype_id, archetype_label as reference_archetype_label, s * 100 as reference_archetype_score from (
    select *, row_number() over (partition by athlete_id, date order by s desc, kind, place) as pos from (
      select e.athlete_id, e.date, a.archetype_id, a.archetype_label, a.kind, a.place,
        round(greatest(case when {_ZL} > 0 and {_CL} > 0 then (z[1]*c1+z[2]*c2+z[3]*c3+z[4]*c4) / ({_ZL} * {_CL}) else 0 end, 0), 9) as s
      from emb e join arch a using (athlete_id))) where pos = 1""",
)
table_query(
    "archetype_match", "E05,J14", lambda s, d: embeddings.match_archetypes(kept(s, d, "embeddings"), _archetypes(s, d)), "amatch",
    ["reference_archetype_score"], ["reference_archetype_id", "reference_archetype_label"],
)
C["near4"] = (
    ["emb"],
    f"\n  select athlete_id, date, 'Latent state resembles ' || string_agg(neighbor_date::varchar, ', ' order by neighbor_rank) || '.' as embedding_neighbor_summary from ({_knn_sql(_D4, 'emb', 7, 3)}) group by all",
)
add(
    "explained_days", "E09",
    lambda s, d: show(
        embeddings.explain_days(kept(s, d, "scored"), kept(s, d, "embeddings"), _archetypes(s, d)), KEY, ["reference_archetype_score"],
        ["reference_archetype_id", "embedding_neighbor_summary"],
    ),
    build(
        f"""select b.athlete_id, b.date, round(m.reference_archetype_score + {NUDGE}, 4) as reference_archetype_score, m.reference_archetype_id, n.embedding_neighbor_summary
from bh b left join amatch m using (athlete_id, date) left join near4 n using (athlete_id, date)""",
        "bh", "amatch", "near4",
    ),
)


def _context(s: SparkSession, d: str) -> DataFrame:
    from paceframe import fixed

    return daily.context_frame(kept(s, d, "embeddings"), kept(s, d, "daily"), fixed.CANONICAL_CONTEXT)


C["ctx"] = (
    ["emb", "daily"],
    "\n  select e.*, d.* exclude (athlete_id, date), readiness_score as readiness, activity_training_load as load, readiness_hrvWeeklyAverage as hrv, "
    "wellness_restingHeartRate as resting_hr from emb e left join daily d using (athlete_id, date)",
)
C["report"] = (
    ["ctx"],
    f"""
  select *, (select least(count(*), 3) from ctx c where c.athlete_id = r.athlete_id and c.date < r.date and c.anomaly_zscore <= 1) as neighbors from (
    select *, case when previous_day_load is not null and len(h) > 0 then len(list_filter(h, lambda u: u <= previous_day_load))::double / len(h) * 100 end as previous_day_load_percentile_28d,
      row_number() over (partition by athlete_id order by anomaly_zscore desc, embedding_distance desc, date) as place
    from (select a.*, p.load as previous_day_load, p.activity_duration_seconds as previous_day_activity_duration_seconds, p.activity_distance_m as previous_day_activity_distance_m,
        p.athlete_id is not null as has_previous from (
        select *, list(load) filter (where load is not null) over ({HISTORY} range between 28 preceding and 1 preceding) as h from ctx) a
      left join ctx p on p.athlete_id = a.athlete_id and p.date = a.date - 1)) r
  where place <= 20""",
)
add(
    "anomaly_report", "E10,O04,P12,J05,W11",
    lambda s, d: show(
        feedback.anomaly_report(_context(s, d)).withColumn("neighbors", F.size(feedback.parse_neighbors(F.col("nearest_previous_normal_days")))),
        KEY, ["anomaly_zscore", "embedding_distance", "load", "previous_day_load", "previous_day_load_percentile_28d"], ["place", "neighbors"],
    ),
    build(
        "select athlete_id, date, " + ", ".join(f"round({c} + {NUDGE}, 4) as {c}" for c in ("anomaly_zscore", "embedding_distance", "load", "previous_day_load", "previous_day_load_percentile_28d"))
        + ", place, neighbors from report", "report",
    ),
)
add(
    "anomaly_report_summary", "A18",
    lambda s, d: show(
        feedback.report_summary(feedback.anomaly_report(_context(s, d)), _context(s, d)), ["athlete_id"], ["max_anomaly_zscore", "mean_anomaly_zscore"],
        ["rows_analyzed", "start_date", "end_date", "top_anomaly_count"],
    ),
    build(
        f"""select athlete_id, round(max(anomaly_zscore) + {NUDGE}, 4) as max_anomaly_zscore, round(avg(anomaly_zscore) + {NUDGE}, 4) as mean_anomaly_zscore, count(*) as rows_analyzed,
  min(date) as start_date, max(date) as end_date, least(count(*), 20) as top_anomaly_count from emb group by athlete_id""",
        "emb",
    ),
)
add(
    "embedding_plane", "E11",
    lambda s, d: learners.plane_coordinates(fx.vectors(s, d), fx.VECTOR_DIM).select(*KEY, F.abs(F.round("pc1", 4)).alias("pc1"), F.abs(F.round("pc2", 4)).alias("pc2")),
)
add(
    "embedding_component_moments", "E11",
    lambda s, d: show(learners.component_moments(fx.state_vectors(s, d), fx.STATE_DIM), ["moment"], ["value"], digits=3),
    build(
        f"""select unnest([1, 2, 3, 4])::bigint as moment, round(unnest([
    (select sum(v) from c where i = j), (select sum(a.v * b.v) from c a join c b on a.j = b.i and b.j = a.i),
    (select sum(a.v * b.v * e.v) from c a join c b on a.j = b.i join c e on b.j = e.i and e.j = a.i),
    (select sum(a.v * b.v * e.v * f.v) from c a join c b on a.j = b.i join c e on b.j = e.i join c f on e.j = f.i and f.j = a.i)]) + {NUDGE}, 3) as value
  from (select 1) with_one""".replace("from c", "from (select i, j, covar_samp(z[i], z[j]) as v from zv, range(1, 5) a(i), range(1, 5) b(j) group by i, j)").replace("join c ", "join (select i, j, covar_samp(z[i], z[j]) as v from zv, range(1, 5) a(i), range(1, 5) b(j) group by i, j) "),
        "zv",
    ),
)
add(
    "embedding_norm_agreement", "E12,A16,J03",
    lambda s, d: show(
        embeddings.norm_agreement(
            fx.state_vectors(s, d).withColumn("split", F.lit("all")), fx.contrast_vectors(s, d).withColumn("split", F.lit("all"))
        ),
        ["athlete_id"], ["norm_correlation"], ["aligned_rows"],
    ),
    build(
        f"select athlete_id, round(corr(a.embedding_norm, b.embedding_norm) + {NUDGE}, 4) as norm_correlation, count(*) as aligned_rows from emb a join cemb b using (athlete_id, date) group by athlete_id",
        "emb", "cemb",
    ),
)

# --- model tables ---------------------------------------------------------------------------

TARGET = "readiness_score"
REQUESTED = ["activity_count", "activity_duration_seconds", "running_distance_m", "hill_overallScore", "readiness_hrvWeeklyAverage", "sleep_total_seconds"]


def _features(s: SparkSession, d: str) -> list[str]:
    return datasets.available_features(kept(s, d, "daily").columns, REQUESTED, TARGET)


FEATURES = [f for f in REQUESTED if f != "hill_overallScore"] + [TARGET]


def _split(s: SparkSession, d: str) -> DataFrame:
    return datasets.chronological_split(datasets.indexed_calendar(kept(s, d, "daily").select(*KEY, *_features(s, d))), TARGET)


def _transformed(s: SparkSession, d: str) -> DataFrame:
    split = _split(s, d)
    return datasets.transform_features(split, datasets.fit_preprocessor(split, _features(s, d)), _features(s, d))


def _windows(s: SparkSession, d: str) -> DataFrame:
    return datasets.window_vectors(_transformed(s, d), TARGET)


C["cal"] = (
    ["daily"],
    f"""
  select c.athlete_id, c.date, c.row_index, {', '.join(f'd.{f}' for f in FEATURES)} from (
    select athlete_id, (a + i)::date as date, i as row_index from (
      select athlete_id, a, unnest(range(0, n + 1))::integer as i from (select athlete_id, min(date) as a, datediff('day', min(date), max(date)) as n from daily group by athlete_id))) c
  left join daily d using (athlete_id, date)""",
)
C["splits"] = (
    ["cal"],
    f"""
  select *, case when row_index < 28 then null when {TARGET} is null then 'historical' when pos - 1 < te then 'train'
      when pos - 1 < (case when n > te then greatest(te + floor(n * 0.15e0), te + 1) else te + floor(n * 0.15e0) end) then 'validation' else 'test' end as split
  from (select *, greatest(floor(n * 0.7e0), 1) as te from (
    select *, count(*) filter (where row_index >= 28 and {TARGET} is not null) over (partition by athlete_id) as n,
      count(*) filter (where row_index >= 28 and {TARGET} is not null) over (partition by athlete_id order by date) as pos from cal))""",
)
C["trainrows"] = (
    ["splits"],
    "\n  select * from (select *, max(row_index) filter (where split = 'train') over (partition by athlete_id) as last_train from splits) where row_index < last_train",
)
_FIT = " union all ".join(
    f"""select athlete_id, '{f}' as feature, m as impute_value, avg(coalesce(x, m)) as feature_mean, case when stddev_pop(coalesce(x, m)) > 1e-12 then stddev_pop(coalesce(x, m)) else 1 end as feature_std
  from (select athlete_id, {f}::double as x, coalesce(median({f}::double) over (partition by athlete_id), 0) as m from trainrows) group by athlete_id, m"""
    for f in FEATURES
)
C["fit"] = (["trainrows"], "\n  " + _FIT)
C["scaled"] = (
    ["splits", "fit"],
    "\n  select s.athlete_id, s.date, s.row_index, s.split, s.readiness_score as target, ["
    + ", ".join(f"(coalesce(s.{f}, f{i}.impute_value) - f{i}.feature_mean) / f{i}.feature_std" for i, f in enumerate(FEATURES))
    + "] as v, len(list_filter([" + ", ".join(f"s.{f}::double" for f in FEATURES) + "], lambda q: q is not null)) as seen from splits s "
    + " ".join(f"join fit f{i} on f{i}.athlete_id = s.athlete_id and f{i}.feature = '{f}'" for i, f in enumerate(FEATURES)),
)
C["wins"] = (
    ["scaled"],
    """
  select * from (select athlete_id, date, row_index, split, target, last_value(target ignore nulls) over w as persistence, flatten(list(v) over w) as vector, sum(seen) over w as observed
    from scaled window w as (partition by athlete_id order by date rows between 28 preceding and 1 preceding)) where row_index >= 28""",
)
add(
    "dense_calendar", "M01,J04",
    lambda s, d: show(daily.dense_calendar(kept(s, d, "daily").select(*KEY, TARGET)), KEY, [TARGET]),
    build(f"select athlete_id, date, round({TARGET} + {NUDGE}, 4) as {TARGET} from cal", "cal"),
)
add(
    "chronological_split", "M02,M03,P05",
    lambda s, d: show(_split(s, d), KEY, [], ["row_index", "split"]),
    build("select athlete_id, date, row_index::bigint as row_index, split from splits", "splits"),
)
add(
    "preprocessor_fit", "M04,P10",
    lambda s, d: show(datasets.fit_preprocessor(_split(s, d), _features(s, d)), ["athlete_id", "feature"], ["impute_value", "feature_mean", "feature_std"]),
    build(f"select athlete_id, feature, round(impute_value + {NUDGE}, 4) as impute_value, round(feature_mean + {NUDGE}, 4) as feature_mean, round(feature_std + {NUDGE}, 4) as feature_std from fit", "fit"),
)


def _window_facts(s: SparkSession, d: str) -> DataFrame:
    flat = F.flatten("window")
    rows = _windows(s, d)
    return rows.select(
        *KEY, "split", "persistence", F.size(flat).alias("width"), F.element_at(flat, 1).alias("first_value"), F.element_at(flat, -1).alias("last_value"),
        F.aggregate(flat, F.lit(0.0), lambda a, v: a + v).alias("total"),
        F.size(F.filter(F.flatten("observed_window"), lambda b: b)).cast("bigint").alias("observed"),
    )


add(
    "window_vectors", "M05,M06,M07,W14",
    lambda s, d: show(_window_facts(s, d), KEY, ["persistence", "first_value", "last_value", "total"], ["split", "width", "observed"]),
    build(
        f"select athlete_id, date, round(persistence + {NUDGE}, 4) as persistence, round(vector[1] + {NUDGE}, 4) as first_value, round(vector[-1] + {NUDGE}, 4) as last_value, round(list_sum(vector) + {NUDGE}, 4) as total, split, len(vector)::bigint as width, observed::bigint as observed from wins",
        "wins",
    ),
)
add(
    "split_summary", "M08",
    lambda s, d: datasets.split_summary(_split(s, d)),
    build("select athlete_id, split, count(*) as windows, min(date) as date_min, max(date) as date_max from splits where split is not null group by all", "splits"),
)
add(
    "persistence_baseline", "M09,A17,W14",
    lambda s, d: show(datasets.persistence_baseline(_windows(s, d)), ["split"], ["mae", "rmse"], ["n"]),
    build(
        f"select split, round(avg(abs(persistence - target)) + {NUDGE}, 4) as mae, round(sqrt(avg((persistence - target) * (persistence - target))) + {NUDGE}, 4) as rmse, count(*) as n from wins where target is not null and persistence is not null group by split",
        "wins",
    ),
)


def _supervised(s: SparkSession, d: str) -> DataFrame:
    return datasets.supervised_windows(_windows(s, d))


add(
    "ridge_baseline", "M10,M14",
    lambda s, d: show(
        datasets.regression_metrics(learners.prediction_table(learners.ridge_predictions(_supervised(s, d)), ["ridge"]), "actual", "ridge", "split"),
        ["split"], ["mae", "rmse"], ["n"],
    ),
)
# The twin has the targets where the engine has its predictions: only weights that solve the equations make them equal.
add(
    "ridge_normal_equations", "M10,M14",
    lambda s, d: show(learners.normal_equations(_supervised(s, d)), ["feature"], ["left_side"], digits=2),
    build(
        f"""select feature, round(sum(x * target) - sum(x) * avg(target) + {NUDGE}, 2) as left_side from (
  select target, unnest(vector) as x, unnest(range(0, len(vector))) as feature from wins where split = 'train' and target is not null) group by feature""",
        "wins",
    ),
)
add(
    "tree_baseline", "M11,M14",
    lambda s, d: show(
        datasets.regression_metrics(learners.tree_predictions(_supervised(s, d)), "target", "trees", "split"), ["split"], ["mae", "rmse"], ["n"]
    ),
)
add(
    "window_state_embeddings", "M12",
    lambda s, d: learners.state_embeddings(_windows(s, d)).select(*KEY, "split", F.round(norm("z"), 4).alias("length")),
)
DRIVERS = ["running_distance_m", "running_duration_seconds", "readiness_score", "readiness_hrvWeeklyAverage", "wellness_restingHeartRate", "sleep_total_seconds", "activity_training_load"]
_DRIVER_LABELS = {
    "running_distance_m": "Running distance", "running_duration_seconds": "Running duration", "readiness_score": "Readiness", "readiness_hrvWeeklyAverage": "HRV",
    "wellness_restingHeartRate": "Resting HR", "sleep_total_seconds": "Sleep duration", "activity_training_load": "Activity training load",
}
add(
    "state_drivers", "M13,P08",
    lambda s, d: learners.state_drivers(kept(s, d, "daily"), learners.flagged_days(kept(s, d, "scored")), DRIVERS),
    build(
        f"""select athlete_id, date, 'Top latent-state drivers: ' || string_agg(driver, ', ' order by place) || '.' as frontier_attribution_summary,
  string_agg(driver || ' (' || format('{{:.3f}}', w) || ')', '; ' order by place) as frontier_attribution_drivers
from (select *, row_number() over (partition by athlete_id, date order by w desc, driver) as place from (
  select d.athlete_id, d.date, unnest([{', '.join(f"{{'driver': '{_DRIVER_LABELS[f]}', 'w': case when s_{f} > 1e-12 then round(abs({f} - m_{f}) / s_{f}, 9) end}}" for f in DRIVERS)}], recursive := true)
  from (select athlete_id, date, datediff('day', date '1970-01-01', date) as day, {', '.join(DRIVERS)}, {', '.join(f"avg({f}) over w as m_{f}, stddev_pop({f}) over w as s_{f}" for f in DRIVERS)}
    from daily window w as (partition by athlete_id order by datediff('day', date '1970-01-01', date) range between 28 preceding and 1 preceding)) d
  semi join (select athlete_id, date from (select *, max(date) over (partition by athlete_id) as last from al) where date >= last - 90 and (operational_alert_tier in ('investigate_state', 'adjust_training')
    or monitoring_signal_agreement in ('literature_personalized_agree_frontier_differs', 'mixed_signals', 'all_agree') or coalesce(lf, '') = 'high' and ll <> 'high')) f using (athlete_id, date))
  where w is not null) where place <= 5 group by athlete_id, date""",
        "daily", "al",
    ),
)


def _pairs(s: SparkSession, d: str) -> DataFrame:
    positives = datasets.positive_days(fx.events(s, d), fx.reference_periods(s, d))
    return datasets.contrast_pairs(_windows(s, d), positives, embeddings.stable_days(kept(s, d, "scored")).select(*KEY))


_DRAW = "md5(athlete_id::varchar || ':' || date::varchar), date"
add(
    "contrast_pairs", "M15,U07,P07",
    lambda s, d: show(_pairs(s, d), ["athlete_id", "pair"], [], ["positive_date", "label", "negative_date"]),
    build(
        f"""select athlete_id, pair, p.date as positive_date, label, n.date as negative_date from (
  select athlete_id, date, label, row_number() over (partition by athlete_id order by {_DRAW}, label) as pair from (
    select athlete_id, date, 'spring_block' as label from wins where date between date '2021-03-01' and date '2021-04-01' union all
    select athlete_id, date, 'summer_block' as label from wins where date between date '2020-07-01' and date '2020-08-15')) p
  join (select athlete_id, date, row_number() over (partition by athlete_id order by {_DRAW}) as pair from wins semi join (
    select athlete_id, date from bh where bone_stress_risk_level = 'low' and coalesce(running_7d_sum_m, 0) > 20000) using (athlete_id, date)) n using (athlete_id, pair)
  where pair <= 256""",
        "wins", "bh",
    ),
)

# --- data quality ------------------------------------------------------------------------------

# Every column of the daily table: totals, then five measures by sport, then the other sources.
_WHOLE = ["activity_count", "activity_type_count", *[f"{f}_activity_count" for f in ("running", "cycling", "hiking", "swimming", "other")]]
_MEASURES = ["duration_seconds", "distance_m", "training_load", "elevation_gain", "avg_hr", "max_hr", "aerobic_training_effect", "anaerobic_training_effect"]
_CHECKED = [
    *_WHOLE, *[f"{f}_{m}" for f in ("activity", "running", "cycling", "hiking", "swimming", "other") for m in _MEASURES], "impact_weighted_duration_seconds", "impact_weighted_distance_m",
    "fatigue_weighted_duration_seconds", "readiness_score", "readiness_hrvWeeklyAverage", "wellness_restingHeartRate", "sleep_total_seconds", "wellness_bodyBattery_chargedValue",
    "wellness_bodyBattery_drainedValue",
]
_MISSING = " union all ".join(
    f"select '{c}' as \"column\", count(*) - count({c}) as missing_count, round((count(*) - count({c}))::double / count(*) * 100, 2) as missing_pct, count({c}) as non_null_count, '{'bigint' if c in _WHOLE else 'double'}' as dtype from daily"
    for c in _CHECKED
)
add("missingness", "A07", lambda s, d: quality.missingness(kept(s, d, "daily"), _CHECKED), build(_MISSING, "daily"))
add(
    "most_missing_columns", "O08", lambda s, d: quality.most_missing(kept(s, d, "daily"), _CHECKED),
    build(f'select * from ({_MISSING}) order by missing_pct desc, "column" limit 40', "daily"),
)
_STATS = ["count", "mean", "std", "min", "p05", "p25", "p50", "p75", "p95", "max", "missing_pct"]
_DESC = " union all ".join(
    f"""select athlete_id, '{c}' as "column", count({c}) as count, round(avg({c}) + {NUDGE}, 4) as mean, round(stddev_samp({c}) + {NUDGE}, 4) as std, round(min({c})::double + {NUDGE}, 4) as min,
  {', '.join(f"round(quantile_cont({c}::double, {q}) + {NUDGE}, 4) as {n}" for n, q in (('p05', 0.05), ('p25', 0.25), ('p50', 0.5), ('p75', 0.75), ('p95', 0.95)))},
  round(max({c})::double + {NUDGE}, 4) as max, round((count(*) - count({c}))::double / count(*) * 100 + {NUDGE}, 4) as missing_pct from daily group by athlete_id"""
    for c in _CHECKED
)
add(
    "describe", "A08",
    lambda s, d: show(quality.describe(kept(s, d, "daily"), _CHECKED), ["athlete_id", "column"], [c for c in _STATS if c != "count"], ["count"]),
    build(_DESC, "daily"),
)
add(
    "overview", "A09",
    lambda s, d: quality.overview(kept(s, d, "daily"), REQUESTED, TARGET),
    build(
        f"select count(*) as rows, {len(_CHECKED) + 2}::bigint as columns, min(date) as date_min, max(date) as date_max, {len(REQUESTED)}::bigint as configured_features, {len(REQUESTED) - 1}::bigint as available_configured_features, count({TARGET}) as target_non_null_rows from daily",
        "daily",
    ),
)
add(
    "monthly_means", "A10",
    lambda s, d: show(quality.monthly_means(kept(s, d, "daily"), ["readiness_score", "running_distance_m"]), ["athlete_id", "month"], ["readiness_score", "running_distance_m"]),
    build(f"select athlete_id, date_trunc('month', date)::date as month, round(avg(readiness_score) + {NUDGE}, 4) as readiness_score, round(avg(running_distance_m) + {NUDGE}, 4) as running_distance_m from daily group by all", "daily"),
)


# Every family of the daily table, and a column that it has on all its days.
_FAMILIES = {
    "activity": "activity_count", "running": "running_activity_count", "cycling": "cycling_activity_count", "hiking": "hiking_activity_count", "swimming": "swimming_activity_count",
    "other": "other_activity_count", "impact": "impact_weighted_duration_seconds", "fatigue": "fatigue_weighted_duration_seconds", "readiness": "readiness_hrvWeeklyAverage",
    "sleep": "sleep_total_seconds", "wellness": "wellness_restingHeartRate",
}


def _coverage(s: SparkSession, d: str) -> DataFrame:
    frame = kept(s, d, "daily")
    return quality.group_coverage(frame, quality.column_groups(frame.columns, list(_FAMILIES)))


add(
    "feature_group_coverage", "A11",
    lambda s, d: show(_coverage(s, d), ["feature_group"], ["coverage_pct"], ["days"]),
    build(
        " union all ".join(
            f"select '{g}' as feature_group, count(*) filter (where {cond}) as days, round(count(*) filter (where {cond})::double / count(*) * 100 + {NUDGE}, 4) as coverage_pct from daily"
            for g, cond in ((g, f"{c} is not null") for g, c in _FAMILIES.items())
        ),
        "daily",
    ),
)
