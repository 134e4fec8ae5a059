"""Read models: the queries behind the operations, explorer and experiment views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresail.functions.expr import all_of, safe_divide
from foresail.operators.ledger import STATUS_TRANSITIONS, latest_by

COMPLETED = ("completed", "succeeded", "success")


def exception_state() -> Column:
    flag = F.col("confidence_flag")
    return F.when(flag == "low", "blocked").when(flag == "medium", "watch").otherwise("clear")


def operations_snapshot(
    runs: DataFrame,
    outputs: DataFrame,
    overrides: DataFrame,
    approvals: DataFrame,
    pubs: DataFrame,
    delivery: DataFrame,
    fva: DataFrame,
    destination: str = "warehouse",
    newest: int | None = None,
) -> DataFrame:
    """Runs that have outputs, with counts from every ledger; all of them, or the
    ``newest`` ones, which are then picked before the ledgers are aggregated.
    """
    run = "forecast_run_id"
    with_outputs = runs.join(outputs.select(run), run, "left_semi")
    chosen = with_outputs
    if newest is not None:
        chosen = chosen.orderBy(F.desc("forecast_origin"), F.desc(run)).limit(newest)
    ids = chosen.select(run)
    per = lambda df: df.join(ids, run, "left_semi").groupBy(run)
    o = per(outputs).agg(
        F.count(F.lit(1)).alias("_outputs"),
        F.count_if(F.col("confidence_flag").isin("medium", "low")).alias("_exceptions"),
        F.max("config_name").alias("_model"),
    )
    v = per(overrides).agg(F.count_distinct("override_id").alias("_overrides"))
    a = per(approvals.filter("decision = 'approved'")).agg(F.count_distinct("approval_id").alias("_approvals"))
    p = per(pubs.filter(F.col("destination") == destination)).agg(
        F.max("publication_version").alias("publication_version"), F.max("published_at").alias("_published_at")
    )
    d = latest_by(
        delivery.filter(F.col("destination") == destination).join(ids, run, "left_semi"),
        [run],
        [F.desc("publication_version"), F.desc("delivery_status_at")],
    ).select(run, "publication_version", "delivery_status", "delivery_status_at")
    f = per(fva).agg(
        F.max_by(
            F.struct("comparison_status", "planner_wape_fva_points", "total_wape_fva_points"),
            F.struct("publication_version", "horizon", "planner", "reason_code"),
        ).alias("_fva")
    )
    joined = chosen
    for part in (o, v, a, p):
        joined = joined.join(part, run, "left")
    joined = joined.join(d, [run, "publication_version"], "left").join(f, run, "left")
    statuses = [s for s in STATUS_TRANSITIONS if s]
    return joined.select(
        run,
        F.to_date("forecast_origin").alias("origin"),
        F.when(F.col("run_status").isin(*statuses), F.col("run_status"))
        .when(F.col("error_message").isNotNull(), "failed")
        .otherwise("draft")
        .alias("status"),
        F.coalesce("_model", "config_name", "model_id", F.lit("unknown")).alias("model_name"),
        F.coalesce("_outputs", "row_count", F.lit(0)).alias("output_count"),
        F.coalesce("exception_count", "_exceptions", F.lit(0)).alias("exception_count"),
        F.coalesce("_overrides", F.lit(0)).alias("override_count"),
        F.coalesce("_approvals", F.lit(0)).alias("approval_count"),
        "publication_version",
        F.coalesce("delivery_status", F.lit("not_published")).alias("delivery_status"),
        F.coalesce("_fva.comparison_status", F.lit("awaiting_actuals")).alias("fva_status"),
        F.col("_fva.planner_wape_fva_points").alias("planner_wape_fva_points"),
        F.col("_fva.total_wape_fva_points").alias("total_wape_fva_points"),
        F.coalesce("delivery_status_at", "_published_at", "finished_at", "started_at").alias("updated_at"),
    )


def worst_outputs(outputs: DataFrame, runs: DataFrame, n: int | None = None) -> DataFrame:
    """Outputs ranked per run by how much they need attention; the first ``n`` if given."""
    state = exception_state()
    order = F.when(state == "blocked", 1).when(state == "watch", 2).otherwise(3)
    rank = Window.partitionBy("forecast_run_id").orderBy(order, "target_date", "forecast_output_id")
    return (
        outputs.join(runs.select("forecast_run_id"), "forecast_run_id", "left_semi")
        .select(
            "forecast_run_id",
            "forecast_output_id",
            "entity_key_json",
            "target_date",
            "confidence_flag",
            F.coalesce("planner_override", "prediction_p50").alias("current_value"),
            state.alias("exception_state"),
        )
        .withColumn("position", F.row_number().over(rank))
        .filter(F.lit(True) if n is None else F.col("position") <= n)
        .drop("confidence_flag")
    )


def after_cursor(keys: Sequence[str], values: Sequence) -> Column:
    """Keyset predicate ``(k1, k2, ...) > (v1, v2, ...)`` as plain comparisons."""
    clauses = []
    for i, (key, value) in enumerate(zip(keys, values)):
        same = [F.col(k) == F.lit(v) for k, v in list(zip(keys, values))[:i]]
        clauses.append(all_of([*same, F.col(key) > F.lit(value)]))
    out = clauses[0]
    for clause in clauses[1:]:
        out = out | clause
    return out


def _page(df: DataFrame, keys: Sequence[str], after: Sequence | None, limit: int) -> DataFrame:
    rows = df if after is None else df.filter(after_cursor(keys, after))
    return rows.orderBy(*keys).limit(limit)


def forecast_series(
    pbr: DataFrame,
    demand: DataFrame,
    filters: Mapping[str, object],
    limit: int,
    after: Sequence | None = None,
    target_range: tuple = (None, None),
    state: str | None = None,
    entity_key: str = "store_nbr",
) -> DataFrame:
    """One page of an entity's published forecasts with actuals."""
    rows = pbr.withColumn("exception_state", exception_state())
    for column, value in filters.items():
        rows = rows.filter(F.col(column) == F.lit(value))
    lo, hi = target_range
    if lo is not None:
        rows = rows.filter(F.col("target_date") >= F.lit(lo))
    if hi is not None:
        rows = rows.filter(F.col("target_date") <= F.lit(hi))
    if state is not None:
        rows = rows.filter(F.col("exception_state") == state)
    page = _page(rows, ["target_date", "horizon", "publication_id"], after, limit)
    store = F.expr(f"try_cast(get_json_object(entity_key_json, '$.{entity_key}') as long)")
    actuals = demand.select(
        F.col("date").alias("target_date"), F.col("store_nbr").alias("_store"),
        F.col("observed_sales_units").alias("actual"),
    )
    return page.withColumn("_store", store).join(actuals, ["target_date", "_store"], "left").drop("_store")


def scope(
    dc: DataFrame, contract: str | None = None, destination: str | None = None, run_id: str | None = None,
    version: int | None = None,
) -> DataFrame:
    """The current delivered version of a contract, or one explicit version."""
    if run_id is not None:
        return dc.filter(
            (F.col("forecast_run_id") == run_id)
            & (F.col("publication_version") == version)
            & (F.col("destination") == destination)
        ).limit(1)
    rows = dc.filter((F.col("delivery_status") == "delivered") & (F.col("destination") == destination))
    if contract is not None:
        rows = rows.filter(F.col("forecast_contract_name") == contract)
    newest = F.max_by(
        F.struct("*"), F.struct("published_at", "publication_version", "forecast_run_id")
    )
    return rows.groupBy(F.col("forecast_contract_name").alias("_c")).agg(newest.alias("_s")).select("_s.*")


def published_page(
    pbr: DataFrame,
    scope_row: Mapping[str, object] | None,
    filters: Mapping[str, object],
    limit: int,
    after: Sequence | None = None,
) -> DataFrame:
    """One page of a version's rows; an incomplete version is an error. Without a version,
    as when none was delivered yet, the page is empty."""
    if scope_row is None:
        return pbr.limit(0)
    version = all_of(
        [F.col(k) == F.lit(scope_row[k]) for k in ("forecast_run_id", "publication_version", "destination")]
    )
    rows = pbr.filter(version)
    found = rows.count()
    if found != scope_row["publication_row_count"]:
        raise RuntimeError(
            f"publication version is incomplete: expected {scope_row['publication_row_count']}, found {found}"
        )
    for column, value in filters.items():
        values = value if isinstance(value, (list, tuple, set)) else [value]
        rows = rows.filter(F.col(column).isin(list(values)))
    return _page(rows, ["entity_key_json", "target_date", "horizon", "publication_id"], after, limit)


def explorer_options(pbr: DataFrame, dc: DataFrame, run_id: str | None = None) -> DataFrame:
    """Distinct runs, entities, models and horizons of delivered forecasts.

    One pass: each forecast row yields its four options, which are made distinct
    by a map-side combined aggregate.
    """
    delivered = dc.filter("delivery_status = 'delivered'").select(
        "forecast_run_id", "publication_version", "destination"
    )
    rows = pbr.join(delivered, ["forecast_run_id", "publication_version", "destination"], "left_semi")
    selected = F.lit(True) if run_id is None else F.col("forecast_run_id") == run_id
    label = F.coalesce("config_name", "model_family", "model_id")

    def option(kind: str, value: Column, text: Column, order: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("id"), text.alias("label"), order.alias("_o"))

    version = F.col("publication_version").cast("int")
    none = F.lit(None).cast("int")
    options = F.array(
        option("run", F.col("forecast_run_id"), F.to_date("forecast_origin").cast("string"), version),
        option("horizon", F.col("horizon").cast("string"), F.col("horizon").cast("string"), none),
        F.when(selected, option("entity", F.col("entity_key_json"), F.col("grain"), none)),
        F.when(selected, option("model", F.col("model_id"), label, none)),
    )
    return (
        rows.select(F.explode(options).alias("_x"))
        .filter("_x is not null")
        .groupBy("_x.kind", "_x.id")
        .agg(F.max("_x.label").alias("label"), F.max("_x._o").alias("latest_version"))
    )


def experiments(
    runs: DataFrame, metrics: DataFrame, predictions: DataFrame, filters: Mapping[str, object] | None = None
) -> DataFrame:
    """Metrics by run and model; feature version from predictions or contract."""
    keys = ["backtest_run_id", "backtest_contract_name", "backtest_contract_hash"]
    versions = predictions.groupBy("backtest_run_id", "baseline_name").agg(
        F.min("feature_availability_hash").alias("_hash")
    )
    r = runs.filter(F.col("target").isNotNull() & F.col("metric_policy_json").isNotNull()).select(
        *keys,
        "model_config_name",
        "model_family",
        "model_type",
        "target",
        "grain",
        F.col("status").alias("run_status"),
        "origin_end",
        F.col("created_at").alias("run_created_at"),
    )
    m = metrics.select(
        *keys,
        "baseline_name",
        "forecast_origin",
        "horizon",
        "segment_key_json",
        "eligible_count",
        "wape",
        "bias",
        "interval_coverage",
        F.col("created_at").alias("metric_created_at"),
    )
    own = F.col("baseline_name") == F.col("model_config_name")
    contract = F.concat(F.lit("contract:"), F.substring("backtest_contract_hash", 1, 12))
    rows = r.join(m, keys).join(versions, ["backtest_run_id", "baseline_name"], "left").withColumns(
        {
            "experiment_run_id": F.concat_ws(":", "backtest_run_id", "baseline_name"),
            "display_model_family": F.when(own, F.col("model_family")).otherwise("baseline"),
            "display_model_type": F.when(own, F.col("model_type")).otherwise("baseline"),
            "feature_version": F.coalesce("_hash", contract),
            "status": F.when(F.lower("run_status").isin(*COMPLETED), "completed").otherwise("failed"),
        }
    ).drop("_hash")
    for column, value in (filters or {}).items():
        values = value if isinstance(value, (list, tuple, set)) else [value]
        rows = rows.filter(F.col(column).isin(list(values)))
    return rows


def experiment_summary(rows: DataFrame) -> DataFrame:
    """Eligible-weighted WAPE (percent), bias and coverage of each experiment:
    overall, by horizon, by segment and by origin, as four grouping sets."""
    weight = F.when(F.col("eligible_count") > 0, F.col("eligible_count").cast("double"))

    def mean(metric: str) -> Column:
        value = F.col(metric).cast("double")
        return safe_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))

    dims = ["horizon", "segment_key_json", "forecast_origin"]
    run = F.col("experiment_run_id")
    cols = {d: F.col(d) for d in dims}
    grouped = rows.groupingSets(
        [[run], *[[run, cols[d]] for d in dims]], run, *cols.values()
    ).agg(
        F.grouping_id().alias("_g"),
        (mean("wape") * 100).alias("wape"),
        mean("bias").alias("bias"),
        mean("interval_coverage").alias("coverage"),
    )
    # grouping_id has one bit per grouping column, the run's always zero
    bits = {"horizon": 0b011, "segment": 0b101, "origin": 0b110}
    kind = F.lit("overall")
    for name, value in bits.items():
        kind = F.when(F.col("_g") == value, name).otherwise(kind)
    return grouped.filter(F.col("wape").isNotNull() & F.col("bias").isNotNull()).select(
        "experiment_run_id", kind.alias("breakdown"), *dims, "wape", "bias", "coverage"
    )


def paired_bootstrap(rows: DataFrame, n: int = 2000, seed: int = 17) -> DataFrame:
    """Bootstrap of per-origin WAPE differences against the oldest run.

    ``rows`` holds one WAPE per run and origin with the run's creation time. A
    pick is the first word of the MD5 of "seed|run|reference|replicate|draw", reduced
    to the number of origins, so any engine draws the same samples and results do
    not depend on partitioning.
    """
    reference = rows.select(
        F.min_by("experiment_run_id", F.struct("run_created_at", "experiment_run_id")).alias("reference_run_id")
    )
    tagged = rows.join(F.broadcast(reference), F.lit(True))
    base = tagged.filter(F.col("experiment_run_id") == F.col("reference_run_id")).select(
        "forecast_origin", F.col("wape").alias("_base")
    )
    pairs = (
        tagged.filter(F.col("experiment_run_id") != F.col("reference_run_id"))
        .join(base, "forecast_origin")
        .groupBy("experiment_run_id", "reference_run_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("forecast_origin", (F.col("wape") - F.col("_base")).alias("d")))).alias("_d")
        )
        .filter(F.size("_d") >= 2)
    )
    size = F.size("_d")

    def draw(i: Column) -> Column:
        text = F.concat_ws("|", F.lit(str(seed)), "experiment_run_id", "reference_run_id", "replicate", i.cast("string"))
        word = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
        return F.element_at(F.col("_d"), (word % size + 1).cast("int"))["d"]

    samples = pairs.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n)))).select(
        "experiment_run_id",
        "replicate",
        (F.aggregate(F.transform(F.sequence(F.lit(1), size), draw), F.lit(0.0), lambda a, v: a + v) / size).alias("mean"),
    )
    order = Window.partitionBy("experiment_run_id").orderBy("mean", "replicate")
    lower, upper = int(0.025 * (n - 1)) + 1, -int(-0.975 * (n - 1) // 1) + 1
    ranked = samples.withColumn("_k", F.row_number().over(order))
    observed = pairs.select(
        "experiment_run_id",
        "reference_run_id",
        (F.aggregate("_d", F.lit(0.0), lambda a, v: a + v["d"]) / size).alias("delta"),
    )
    intervals = ranked.groupBy("experiment_run_id").agg(
        F.max(F.when(F.col("_k") == lower, F.col("mean"))).alias("ci_lower"),
        F.max(F.when(F.col("_k") == upper, F.col("mean"))).alias("ci_upper"),
        F.count_if(F.col("mean") >= 0).alias("_up"),
        F.count_if(F.col("mean") <= 0).alias("_down"),
    )
    opposing = F.when(F.col("delta") < 0, F.col("_up")).otherwise(F.col("_down"))
    return observed.join(intervals, "experiment_run_id").select(
        "experiment_run_id",
        "reference_run_id",
        F.round("delta", 3).alias("delta_wape_pp"),
        F.lit(0.95).alias("confidence_level"),
        F.round("ci_lower", 3).alias("ci_lower"),
        F.round("ci_upper", 3).alias("ci_upper"),
        F.round(F.least(F.lit(1.0), 2 * opposing / n), 4).alias("p_value"),
        F.when(F.col("ci_upper") < 0, "meaningful")
        .when(F.col("ci_lower") > 0, "worse")
        .otherwise("inconclusive")
        .alias("conclusion"),
    )


def pipeline_runs(health: DataFrame, stages: DataFrame, checks: DataFrame, newest: int | None = None) -> DataFrame:
    """Health rows with their ordered stages and checks; the ``newest`` ones if given.

    A run has a handful of stages and checks, so the lists are short; only the
    chosen runs' rows are read into them.
    """
    run = "forecast_run_id"
    chosen = health
    if newest is not None:
        chosen = chosen.orderBy(F.desc("started_at"), F.desc(run)).limit(newest)
    ids = chosen.select(run)
    s = stages.join(ids, run, "left_semi").groupBy(run).agg(
        F.array_sort(F.collect_list(F.struct("stage_position", "stage_name", "stage_status"))).alias("stages")
    )
    c = checks.join(ids, run, "left_semi").groupBy(run).agg(
        F.array_sort(F.collect_list(F.struct("checked_at", "check_name", "severity", "passed"))).alias("checks")
    )
    return chosen.join(s, run, "left").join(c, run, "left")
