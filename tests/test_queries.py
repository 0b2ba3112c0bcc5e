"""Every registered query against its independent SQL, on the smallest data."""

import pytest
from compare import difference

from tallyloom.plans import load
from tallyloom.plans.catalog import ORACLES, QUERIES

load()


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_same_rows_as_sql(spark, folder, connection, key):
    df = QUERIES[key](spark, folder)
    said = difference(df, connection, ORACLES[key])
    assert said is None, said
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "Python" not in plan


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, folder, key):
    assert QUERIES[key](spark, folder).columns


@pytest.mark.parametrize("key", ["f01_keep_first", "f02_merge_stripped", "f03_fingerprint", "f04_pair_key", "f05_source_text", "f06_harvest", "f18_base_wins", "f18_new_wins"])
def test_no_text_travels_where_ids_are_asked_for(spark, folder, key):
    plan = QUERIES[key](spark, folder)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "SortAggregate" in line or "Exchange" in line or "HashAggregate" in line]
    assert moved and not any(text in line for line in moved for text in ("uml_code#", "plantuml_code#", "technical_spec#"))
