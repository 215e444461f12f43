"""Joins of tables that grow with the input aren't planned as broadcasts, however small their files look."""

from __future__ import annotations

from pathlib import Path

import pytest

from thresher.operators import access, discovery
from thresher.plans import extraction
from thresher.plans.registry import QUERIES
from thresher.sources.elements import elements

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def plans(monkeypatch):
    """The physical plans of all that is staged."""
    seen = []
    for module in (discovery, extraction):
        def noted(df, *args, real=module.stage):
            seen.append(df._jdf.queryExecution().executedPlan().toString())
            return real(df, *args)

        monkeypatch.setattr(module, "stage", noted)
    return seen


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")
@pytest.mark.parametrize("name", ["X17_pairs", "X31_strongest_properties", "X21_named_elements", "X16_data_attributes"])
def test_discovery_without_broadcasts(spark, plans, name):
    found = QUERIES[name](spark, DATA)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 3
    assert not any("Broadcast" in p for p in plans)
    assert sum("MapInArrow" in p for p in plans) == 1  # pages are parsed once


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")
def test_named_elements_run_without_broadcasts(spark):
    """Adaptive execution joins anew by what it has measured; the plans that ran broadcast nothing either."""
    runs = spark._jsparkSession.sharedState().statusStore()
    before = runs.executionsList().size()
    assert len(QUERIES["X21_named_elements"](spark, DATA).collect()) == 9 * 200
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = [runs.executionsList().apply(i).physicalPlanDescription() for i in range(before, runs.executionsList().size())]
    assert len(ran) == 3 and all("isFinalPlan=true" in p for p in ran)
    assert not any("Broadcast" in p for p in ran)
    assert sum("MapInArrow" in p for p in ran) == 1  # pages are parsed once


def test_chains_of_ancestors_are_not_exchanged(spark, monkeypatch):
    """Paths are made of them where pages are parsed; neither they nor the counts of classes are exchanged or staged."""
    staged = []
    monkeypatch.setattr(discovery, "stage", lambda df, *args, real=discovery.stage: staged.append(df) or real(df, *args))
    pages = spark.createDataFrame([(1, '<body><p data-lot="a">b</p></body>')], "page_id long, html string")
    found = discovery.dom(elements(pages))[0]
    assert [r["path"] for r in found.collect()] == ["body > p"]
    plan = staged[0]._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")].rsplit("Project", 1)[0]  # what stands over the projection on parsed rows
    assert "Window" in above and "chain" not in above and "class_counts" not in above
    assert not {"chain", "class_counts"} & {c for df in staged for c in df.columns}


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")
@pytest.mark.parametrize("name", ["J1_field_match", "J2_missing_fields", "G2_extraction_status", "G5_validation_status", "validated_records", "G3_resolve", "G7_validation_issues"])
def test_matching_without_broadcasts(spark, plans, name):
    plans.append(QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString())
    assert not any("Broadcast" in p for p in plans)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")
@pytest.mark.parametrize("name", ["X9_microdata", "X12_microdata_values"])
def test_microdata_without_broadcasts(spark, plans, name):
    plans.append(QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString())
    assert not any("Broadcast" in p for p in plans)
    assert sum(p.count("MapInArrow") for p in plans) == 1  # pages are parsed once


def test_bodies_are_prepared_once(spark):
    """Not for each marker, nor again for a filter that the optimizer derives from an explosion."""
    rows = spark.sql("select id as job_id, cast(cast(id as string) as binary) as raw_body, map('content-type', array('text/html')) as headers from range(3)")
    plan = access.challenge_signals(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring(") + plan.count("substr(") == 1


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")
def test_responses_are_read_once(spark):
    """The warnings of N6 read what is staged, not the events and their budgets over and over."""
    assert "events.parquet" not in QUERIES["N6_walk_warnings"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
