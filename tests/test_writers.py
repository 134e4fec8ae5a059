"""Writers: rejected batches, touched partitions only, one job a write."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foresail.operators import ledger as le
from foresail.sources import tables, writers


def ledger(spark, months=6, rows=40):
    df = spark.range(months * rows).selectExpr("concat('id', id) as id", f"cast(id % {months} as int) as month", "cast(id as double) as v")
    return df


@pytest.mark.parametrize("bad,why", [([(None, 0, 1.0)], "null"), ([("id1", 1, 1.0)], "one row per")])
def test_a_bad_batch_leaves_nothing_behind(spark, tmp_path, bad, why):
    path = str(tmp_path / "ledger")
    batch = ledger(spark).union(spark.createDataFrame(bad, "id string, month int, v double"))
    for store in (
        lambda: writers.insert_once(batch, path, "id", "month"),
        lambda: writers.upsert(batch, path, "id", partition="month"),
        lambda: writers.merge_replace(batch, path, ["id"], "month"),
    ):
        with pytest.raises(ValueError, match=why):
            store()
        assert writers.read_if_exists(spark, path) is None
    assert writers.insert_once(ledger(spark), path, "id", "month") == 240
    with pytest.raises(ValueError, match=why):
        writers.insert_once(batch, path, "id", "month")
    with pytest.raises(ValueError, match=why):
        writers.merge_replace(batch, path, ["id"], "month")
    assert spark.read.parquet(path).count() == 240


def files_read(spark, df) -> int:
    """Files that the scan of the stored ledger opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(node):
        metrics = node.metrics()
        if node.nodeName().startswith("Scan parquet") and metrics.contains("numFiles"):
            found.append(metrics.apply("numFiles").value())
        for name in ("finalPhysicalPlan", "plan"):
            if name == "finalPhysicalPlan" and node.nodeName() == "AdaptiveSparkPlan":
                walk(node.finalPhysicalPlan())
            if name == "plan" and "QueryStage" in node.nodeName():
                walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return max(found)


def test_only_touched_partitions_are_read(spark, tmp_path):
    path = str(tmp_path / "ledger")
    writers.insert_once(ledger(spark).repartition(1), path, "id", "month")
    stored = spark.read.parquet(path)
    assert len(stored.inputFiles()) == 6
    batch = spark.createDataFrame([("id3", 3, 0.0), ("new", 3, 0.0), ("more", 4, 0.0)], "id string, month int, v double")
    fresh = writers.not_yet_stored(batch, stored, "id", "month")
    assert "dynamicpruning" in fresh._jdf.queryExecution().executedPlan().toString()
    assert files_read(spark, fresh) == 2
    assert {r.id for r in fresh.collect()} == {"new", "more"}
    assert writers.insert_once(batch, path, "id", "month") == 2
    assert writers.insert_once(batch, path, "id", "month") == 0


def jobs(spark, run) -> int:
    """Spark SQL executions that wrote or collected while ``run`` ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    return store.executionsCount() - before


def test_an_append_is_one_execution(spark, tmp_path):
    path = str(tmp_path / "ledger")
    writers.insert_once(ledger(spark), path, "id", "month")
    batch = ledger(spark, 7, 40).filter("month >= 5")
    assert jobs(spark, lambda: writers.insert_once(batch, path, "id", "month")) == 1


def test_merge_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "ledger")
    writers.overwrite_partitions(ledger(spark), path, "month")
    untouched = sorted(f for f in spark.read.parquet(path).inputFiles() if "month=3" not in f)
    change = spark.createDataFrame([("id3", 3, -1.0)], "id string, month int, v double")
    writers.merge_replace(change, path, ["id"], "month")
    stored = spark.read.parquet(path)
    assert sorted(f for f in stored.inputFiles() if "month=3" not in f) == untouched
    assert stored.count() == 240 and stored.filter("id = 'id3'").first().v == -1.0
    writers.upsert(spark.createDataFrame([("id9", 3, None), ("x", 4, 7.0)], change.schema), path, "id", partition="month")
    stored = spark.read.parquet(path)
    assert stored.count() == 241 and stored.filter("id = 'id9'").first().v == 9.0


AWKWARD = [
    ("plain", "a,b", 1.5), ("quoted \"word\"", "two\nlines", 2.0), ("x", "three\n\nlines, \"with\" quotes\n", float("nan")),
    (None, "it's", None), ("crlf", "inside\r\nkept", 3.0), ("", '"', 4.0),
]


def csv_file(path, rows, line_end="\n"):
    def cell(v):
        if v is None:
            return ""
        if isinstance(v, float):
            return "NaN" if v != v else str(v)
        return '"' + v.replace('"', '""') + '"'

    text = line_end.join(["k,t,v", *[",".join(map(cell, r)) for r in rows]]) + line_end
    path.write_bytes(text.encode())


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", ["64b", "1m"])
def test_quoted_line_ends_in_a_file_read_by_several_tasks(spark, tmp_path, line_end, size):
    rows = [(k if k else k, t, v) for i in range(60) for k, t, v in [AWKWARD[i % len(AWKWARD)]]]
    csv_file(tmp_path / "a.csv", rows, line_end)
    csv_file(tmp_path / "b.csv", rows[:7], line_end)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        df = tables.read_csv(spark, str(tmp_path / "*.csv"), "k string, t string, v double")
        tasks = spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions()
        got = sorted((str(r.k or ""), r.t, str(r.v)) for r in df.collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert tasks > 8 if size == "64b" else tasks >= 1
    clean = lambda v: "None" if v is None or v != v else str(v)
    assert got == sorted((k or "", t, clean(v)) for k, t, v in rows + rows[:7])


def test_a_quote_left_open_is_an_error(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('k,t\n1,"open\n2,x\n')
    with pytest.raises(ValueError, match="quote"):
        tables.read_csv(spark, str(tmp_path / "bad.csv"), "k long, t string")
    (tmp_path / "none.csv").write_text("")
    assert tables.read_csv(spark, str(tmp_path / "none.csv"), "k long, t string").collect() == []


def test_declared_ledgers_refuse_bad_values(spark, tmp_path):
    row = {"override_id": "o1", "idempotency_key": "k", "forecast_output_id": "f", "forecast_run_id": "r",
           "override_value": "1.5", "reason_code": None, "comment": "c", "overridden_at": "2024-01-01 08:00:00",
           "overridden_by": "p", "extra": "e"}

    def read(extras="drop", **changes):
        df = spark.createDataFrame([tuple((row | changes).values())], ", ".join(f"{c} string" for c in row))
        df.write.mode("overwrite").parquet(str(tmp_path / "overrides"))
        return le.ledger(spark, str(tmp_path), "overrides", extras=extras)

    good = read()
    assert good.schema["override_value"].dataType.simpleString() == "double" and "extra" not in good.columns
    assert good.first().override_value == 1.5
    assert read("keep").columns[-1] == "extra"
    with pytest.raises(ValueError, match="undeclared"):
        read("refuse")
    for bad, why in (({"override_value": "many"}, "override_value is not double"), ({"overridden_at": "late"}, "timestamp"),
                     ({"override_id": None}, "override_id is null")):
        with pytest.raises(Exception, match=why):
            read(**bad).collect()
