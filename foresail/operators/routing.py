"""Series classification and the choice of a forecast strategy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresail.contracts import RoutingPolicy, StrategyAvailability
from foresail.functions.expr import canonical_json, require, require_columns, safe_divide, stable_id

CONFIDENCE = {"entity_model": "high", "global_model": "medium", "aggregate_allocation": "medium"}
REGULAR_ORDER = ("entity_model", "global_model", "seasonal_baseline", "business_default")


def _profile(demand: Column) -> list[Column]:
    positive = F.when(demand > 0, demand)
    return [
        F.count(demand).alias("history_length"),
        F.count(positive).alias("nonzero_observation_count"),
        F.avg(positive).alias("_mean"),
        F.var_pop(positive).alias("_var"),
    ]


def _flags(df: DataFrame, policy: RoutingPolicy) -> DataFrame:
    n, nonzero = F.col("history_length"), F.col("nonzero_observation_count")
    adi = safe_divide(n, nonzero)
    cold = (n < policy.minimum_history) | (nonzero < policy.minimum_nonzero_observations)
    sparse = (nonzero == 0) | (adi >= policy.intermittent_adi_threshold)
    return df.withColumns(
        {
            "average_demand_interval": adi,
            "is_cold_start": cold,
            "is_intermittent": sparse,
        }
    )


def classify_series(
    df: DataFrame, keys: Sequence[str], demand: str, policy: RoutingPolicy = RoutingPolicy()
) -> DataFrame:
    """History length, demand interval, variability and class per entity.

    One aggregation by entity; a missing demand counts as zero.
    """
    require_columns(df, [*keys, demand], "observations")
    value = F.coalesce(F.expr(f"try_cast({demand} as double)"), F.lit(0.0))
    profile = _flags(df.groupBy(*keys).agg(*_profile(value)), policy)
    spread = F.coalesce(safe_divide("_var", F.pow("_mean", F.lit(2))), F.lit(0.0))
    strategy = (
        F.when(F.col("is_cold_start"), "global_model")
        .when(F.col("is_intermittent"), "intermittent_rate_baseline")
        .otherwise("entity_model")
    )
    facts = [
        "history_length",
        "nonzero_observation_count",
        "average_demand_interval",
        "coefficient_of_variation_squared",
        "is_intermittent",
        "is_cold_start",
        "recommended_strategy",
    ]
    return (
        profile.withColumns(
            {
                "entity_key_json": canonical_json(list(keys)),
                "coefficient_of_variation_squared": spread,
                "recommended_strategy": strategy,
            }
        )
        .select("entity_key_json", *keys, *facts)
        .withColumn(
            "classification_run_id",
            stable_id(
                {"entity_key_json": F.col("entity_key_json"), "policy": F.lit(policy.hash)}
                | {f: F.col(f).cast("string") for f in facts}
            ),
        )
    )


def choose_strategy(df: DataFrame, available: StrategyAvailability = StrategyAvailability()) -> DataFrame:
    """First available strategy in the fixed order, with reason and confidence."""
    cold, sparse = F.col("is_cold_start"), F.col("is_intermittent")
    reason = F.when(cold, "cold_start").when(sparse, "intermittent_demand")
    if available.global_model:
        rest = ("global_model", "entity_model_unavailable", "medium")
    elif available.aggregate_allocation:
        rest = ("aggregate_allocation", "model_unavailable", "medium")
    elif available.seasonal_or_rate_baseline:
        rest = ("", "model_unavailable", "low")
    elif available.business_default:
        rest = ("business_default", "no_forecast_method_available", "low")
    elif available.entity_model:
        rest = (None, None, None)
    else:
        raise ValueError("routing policy has no available forecast strategy")
    name, default_reason, confidence = rest
    own = (~cold & ~sparse) if available.entity_model else F.lit(False)
    if name is None:
        require(df, {"no strategy available": ~own}, "routing")
    fallback = (
        F.when(sparse, "intermittent_rate_baseline").otherwise("seasonal_baseline")
        if name == ""
        else F.lit(name)
    )
    return df.withColumns(
        {
            "forecast_strategy": F.when(own, "entity_model").otherwise(fallback),
            "fallback_reason": F.when(~own, F.coalesce(reason, F.lit(default_reason))),
            "confidence_flag": F.when(own, "high").otherwise(F.lit(confidence)),
        }
    )


def order_table(
    fallback_order: Mapping[str, Sequence[str]],
    allowed: Sequence[str],
    available: Sequence[str],
    business_default: object = None,
) -> dict[str, list[str]]:
    """Usable strategies per series class in declared order."""
    orders = {
        "cold_start": list(fallback_order["cold_start"]),
        "intermittent": list(fallback_order["intermittent"]),
        "regular": list(REGULAR_ORDER),
    }

    def usable(strategy: str) -> bool:
        backed = strategy in available or (strategy == "business_default" and business_default is not None)
        return strategy in allowed and backed

    return {cls: [s for s in order if usable(s)] for cls, order in orders.items()}


def route(df: DataFrame, orders: Mapping[str, Sequence[str]], check: bool = True) -> DataFrame:
    """Contract-declared routing: the first usable strategy of the row's class.

    The order table is three literals, so it becomes a CASE, not a join.
    """
    series_class = (
        F.when(F.col("is_cold_start"), "cold_start")
        .when(F.col("is_intermittent"), "intermittent")
        .otherwise("regular")
    )
    first = F.lit(None).cast("string")
    for cls, order in orders.items():
        if order:
            first = F.when(series_class == cls, F.lit(order[0])).otherwise(first)
    reason = (
        F.when(F.col("is_cold_start"), "cold_start")
        .when(F.col("is_intermittent"), "intermittent_demand")
        .otherwise("entity_model_unavailable")
    )
    confidence = F.lit("low")
    for strategy, level in CONFIDENCE.items():
        confidence = F.when(F.col("forecast_strategy") == strategy, level).otherwise(confidence)
    routed = df.withColumn("forecast_strategy", first)
    if check:
        require(
            routed,
            {"declared fallbacks are exhausted": F.col("forecast_strategy").isNull()},
            "routing",
        )
    return routed.withColumns(
        {
            "fallback_reason": F.when(F.col("forecast_strategy") != "entity_model", reason),
            "confidence_flag": confidence,
        }
    )


def classification_rows(
    profiles: DataFrame,
    contract_name: str,
    contract_hash: str,
    origin: Column,
    classified_at: Column,
    policy: RoutingPolicy = RoutingPolicy(),
) -> DataFrame:
    """Ledger rows with an identity that a retry reproduces."""
    return profiles.withColumns(
        {
            "forecast_contract_name": F.lit(contract_name),
            "forecast_contract_hash": F.lit(contract_hash),
            "forecast_origin": origin,
            "routing_policy_hash": F.lit(policy.hash),
            "classified_at": classified_at,
            "classification_id": stable_id(
                {
                    "forecast_contract_hash": F.lit(contract_hash),
                    "forecast_origin": origin.cast("string"),
                    "entity_key_json": F.col("entity_key_json"),
                    "routing_policy_hash": F.lit(policy.hash),
                }
            ),
        }
    )


def route_batch(pred: DataFrame, history: DataFrame, policy: RoutingPolicy = RoutingPolicy()) -> DataFrame:
    """Route a scored batch to the global model; confidence from its history.

    Missing actuals are dropped here, unlike in the classification.
    """
    require_columns(history, ["entity_key_json", "actual"], "routing history")
    profiled = history.groupBy("entity_key_json").agg(*_profile(F.col("actual").cast("double")))
    profile = _flags(profiled, policy).select(
        "entity_key_json",
        F.when(F.col("is_cold_start"), "cold_start")
        .when(F.col("is_intermittent"), "intermittent_demand")
        .alias("_reason"),
        F.lit(True).alias("_known"),
    )
    reason = F.when(F.col("_known"), F.col("_reason")).otherwise("no_routing_history")
    return (
        pred.join(profile, "entity_key_json", "left")
        .withColumns(
            {
                "forecast_strategy": F.lit("global_model"),
                "fallback_reason": reason,
                "confidence_flag": F.when(reason.isNull(), "high").otherwise("medium"),
            }
        )
        .drop("_reason", "_known")
    )


def with_strategy(df: DataFrame, strategy: str, reason: str | None, confidence: str) -> DataFrame:
    """Attach one routing decision to every row."""
    return df.withColumns(
        {
            "forecast_strategy": F.lit(strategy),
            "fallback_reason": F.lit(reason).cast("string"),
            "confidence_flag": F.lit(confidence),
        }
    )
