"""Declared parameters of forecasts, backtests and policies."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from dataclasses import asdict, dataclass, field


def _hash(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


BASELINES = (
    "zero_demand",
    "last_observation",
    "seasonal_naive_7d",
    "same_period_last_year",
    "moving_average",
    "croston_sba",
    "tsb",
    "croston_sba_tsb",
)


@dataclass(frozen=True)
class BacktestContract:
    name: str
    origins: tuple[dt.date, ...]
    horizons: tuple[int, ...]
    entity_columns: tuple[str, ...]
    actual_column: str
    segment_columns: tuple[str, ...] = ()
    date_column: str = "date"
    train_window_days: int = 90
    moving_average_window: int = 7
    baselines: tuple[str, ...] = BASELINES
    target: str = "demand_units"
    grain: str = "store-day"
    primary_metric: str = "wape"
    model_config_name: str | None = None
    model_family: str | None = None
    model_type: str | None = None

    def __post_init__(self) -> None:
        if not self.origins or not self.horizons:
            raise ValueError("a backtest needs at least one origin and one horizon")
        if min(self.horizons) < 1 or self.train_window_days < 1 or self.moving_average_window < 1:
            raise ValueError("horizons and windows must be positive")
        unknown = sorted(set(self.baselines) - set(BASELINES))
        if unknown:
            raise ValueError(f"baselines without a scorer: {unknown}")

    @property
    def needs_last_year(self) -> bool:
        return "same_period_last_year" in self.baselines

    @property
    def hash(self) -> str:
        return _hash(asdict(self))


@dataclass(frozen=True)
class ForecastContract:
    name: str
    dimensions: tuple[str, ...]
    horizons: tuple[int, ...]
    target: str = "demand_units"
    target_unit: str = "units"
    quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)
    reconciliation_policy: str = "none"

    @property
    def hash(self) -> str:
        return _hash(asdict(self))


@dataclass(frozen=True)
class RoutingPolicy:
    minimum_history: int = 28
    minimum_nonzero_observations: int = 3
    intermittent_adi_threshold: float = 1.32

    @property
    def hash(self) -> str:
        return _hash(asdict(self))


@dataclass(frozen=True)
class StrategyAvailability:
    entity_model: bool = True
    global_model: bool = True
    aggregate_allocation: bool = True
    seasonal_or_rate_baseline: bool = True
    business_default: bool = True


@dataclass(frozen=True)
class RunPins:
    """Material inputs that identify one logical forecast run."""

    champion_candidate_id: str
    model_run_id: str
    feature_version: str
    feature_availability_hash: str
    data_cutoff: dt.date
    code_sha: str
    source_cutoff_json: str = "{}"
    eligibility_snapshot_id: str | None = None


@dataclass(frozen=True)
class PromotionGates:
    min_baseline_improvement_pct: float = 0.0
    max_bias_abs_pct: float = 1.0
    min_prediction_completeness: float = 0.0
    require_reproducible_artifact: bool = False


@dataclass(frozen=True)
class HierarchySpec:
    name: str
    version: str
    levels: tuple[str, ...]
    method: str = "bottom_up"
    middle_level: str | None = None
    tolerance_abs: float = 0.01

    @property
    def hash(self) -> str:
        return _hash(asdict(self))


@dataclass(frozen=True)
class FeatureRule:
    """One registry entry: a feature's name and when it is known."""

    availability: str
    name: str
    metadata_columns: tuple[str, ...] = field(default=())
