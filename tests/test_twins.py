"""Registered queries give the same rows as their SQL twins."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from checks.catalog import QUERIES
from checks.compare import connect, difference

# A cross-section of all operator groups; ``checks/compare.py`` runs all.
CHOSEN = [
    "activity_dedup_signature", "sport_family_daily_rollup", "running_load_7d_28d_acwr", "literature_score_daily",
    "trailing_percentile_28d", "rolling_sum_percentile", "insufficient_rest_7d", "bone_stress_scores",
    "accumulated_bone_state", "recovery_risk_scores", "accumulated_frontier_state", "alert_tiers", "risk_periods",
    "high_day_blocks", "embedding_anomaly", "embedding_knn", "archetype_match", "chronological_split",
    "preprocessor_fit", "window_vectors", "volume_scenarios", "adjustment_plan", "track_evaluation",
    "question_highlighted_days", "question_progression_steps", "date_explorer_days", "ingest_daily_family", "ingest_tcx",
    "ingest_xml", "refreshed_columns", "vector_maths", "previous_calendar_day", "embedding_neighbor_sentences",
]


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows(spark, sf, name):
    query = QUERIES[name]
    left = query.spark(spark, sf).toPandas()
    assert len(left) > 0
    assert difference(left, connect(sf).execute(query.sql).df()) is None


def test_contract_is_complete(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).limit(1).count() == 1


def test_every_inventory_id_is_registered():
    covered = {i for q in QUERIES.values() for i in q.covers.split(",")}
    sizes = {"S": 17, "F": 28, "P": 12, "U": 8, "J": 17, "A": 20, "W": 16, "T": 4, "C": 14, "L": 12, "G": 5, "O": 9, "E": 12, "M": 15, "X": 5, "V": 6, "Q": 17, "R": 6}
    width = {"S": 2, "F": 2, "P": 2, "U": 2, "J": 2, "A": 2, "W": 2, "C": 2, "L": 2, "G": 2, "O": 2, "E": 2, "M": 2, "V": 2, "Q": 2, "R": 2, "X": 2, "T": 1}
    wanted = {f"{k}{i:0{width[k]}d}" for k, n in sizes.items() for i in range(1, n + 1)}
    assert wanted <= covered, sorted(wanted - covered)
