"""The registered queries: shape of the registry and a sample against DuckDB."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from foresail.plans import catalog

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "st3_stage_test",
    "st8_store_event_flags_by_place",
    "fe_company_features",
    "de3_eligibility_summary",
    "bt13_score_baselines",
    "bt18_metrics_by_segment",
    "hi9_mint",
    "fp24_publication_audit",
    "lc6_leaderboard",
    "mo10_run_cost",
    "rm7_experiment_summary",
    "ss1_stream_insert_once",
    "ca3_calibrate_by_horizon",
    "hi7_top_down",
    "fp11_approve",
    "fp23_override_audit",
    "rm8_paired_bootstrap",
    "lc7_champions",
    "io1_load_folder",
    "io9_insert_once_by_partition",
    "io12_export_csv",
    "st13_approvals",
    "bt20_linear_walk_forward",
    "ml11_series_status",
    "ml12_series_status",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_registry_is_consistent():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    own = set(catalog.queries())
    without = {n.split("_")[0] for n in own - set(oracles)}
    assert without <= {"ml1", "ml2", "ml3", "ml4", "ml6", "ml10", "ml11", "ml12", "ml13", "bt14", "bt20"}


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    at = [df.columns.index(c) for c in cols]
    got = Counter(tuple(r[i] for i in at) for r in df.collect())
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in cols]
    assert sorted(names) == cols
    assert got == Counter(tuple(r[i] for i in order) for r in result.fetchall())
    assert got


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_relations_that_several_rules_read_are_made_once(spark):
    from foresail.plans.monitoring_queries import unaltered
    from foresail.plans.registry import Source

    plan = unaltered(Source(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    # 105 reads of the fact table before, one or more for every rule and its count
    assert plan.count("Relation [l_orderkey") <= 20


def test_calibration_scores_the_backtest_once(spark):
    from foresail.plans.backtest_queries import horizon_calibrated
    from foresail.plans.registry import Source

    plan = horizon_calibrated(Source(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan  # points were scored again beside the residuals and their check
