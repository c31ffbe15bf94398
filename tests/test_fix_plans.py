"""Joins of lookups follow their keys down through the plan: identities are a written table by then, without pages."""

import pytest

from quirework import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture
def planned(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    yield lambda name: plans.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_fixes_are_planned_over_written_identities(planned):
    assert "first_page" not in planned("deterministic_fix")


def test_a_pipeline_is_planned_over_written_identities(planned):
    assert "first_page" not in planned("per_book_pipeline")


def test_counters_are_planned_over_written_identities(planned):
    assert "first_page" not in planned("fix_source_counts")
