"""All registered queries in one place."""

from __future__ import annotations

from importlib import import_module

from foresail.plans.registry import QUERIES, Source, oracle, present

MODULES = (
    "staging_queries",
    "feature_queries",
    "backtest_queries",
    "hierarchy_queries",
    "ledger_queries",
    "monitoring_queries",
    "model_queries",
)

for _module in MODULES:
    import_module(f"foresail.plans.{_module}")


def _runner(q):
    def run(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return present(q.run(Source(spark, sf_dir)), q.columns)

    run.__name__ = q.name
    return run


def queries():
    return {name: _runner(q) for name, q in QUERIES.items()}


def oracle_sql():
    return {name: oracle(q) for name, q in QUERIES.items() if q.sql is not None}
