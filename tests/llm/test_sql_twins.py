"""Registered text queries give the rows of their SQL twins."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from checks.compare import difference
from paceframe.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view documents as from '{sf}/documents.parquet'")
    assert difference(QUERIES[name](spark, sf).toPandas(), con.execute(SQL[name]).df()) is None


def test_all_operators_are_registered():
    names = contract.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
