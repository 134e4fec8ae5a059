"""Intermittent-demand rates as folds over an ordered array of demand.

Both methods start at the first positive demand and then update once per
period; every step is a built-in expression, so rows never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(demand: Column, start, step, finish) -> Column:
    first = F.array_position(F.transform(demand, lambda v: v > 0), F.lit(True))
    rest = F.slice(demand, first.cast("int") + 1, F.size(demand))
    folded = F.aggregate(rest, start(F.element_at(demand, first.cast("int")), first), step, finish)
    return F.when(first == 0, 0.0).otherwise(
        F.when(first > 0, folded)
    )


def _state(**fields: Column) -> Column:
    return F.struct(*[value.cast("double").alias(name) for name, value in fields.items()])


def croston_sba(demand: Column, alpha: float = 0.1) -> Column:
    """Croston size over interval with the Syntetos-Boylan bias factor."""

    def step(acc, v):
        hit = v > 0
        return _state(
            size=F.when(hit, acc["size"] + alpha * (v - acc["size"])).otherwise(acc["size"]),
            interval=F.when(hit, acc["interval"] + alpha * (acc["elapsed"] - acc["interval"])).otherwise(
                acc["interval"]
            ),
            elapsed=F.when(hit, F.lit(1.0)).otherwise(acc["elapsed"] + 1),
        )

    return _fold(
        _nonempty(demand),
        lambda size, first: _state(size=size, interval=first, elapsed=F.lit(1)),
        step,
        lambda acc: (1 - alpha / 2) * acc["size"] / acc["interval"],
    )


def tsb(demand: Column, alpha: float = 0.1, beta: float = 0.1) -> Column:
    """Teunter-Syntetos-Babai: demand probability times demand size."""

    def step(acc, v):
        hit = v > 0
        return _state(
            size=F.when(hit, acc["size"] + alpha * (v - acc["size"])).otherwise(acc["size"]),
            probability=acc["probability"]
            + beta * (F.when(hit, 1.0).otherwise(0.0) - acc["probability"]),
        )

    return _fold(
        _nonempty(demand),
        lambda size, first: _state(size=size, probability=1.0 / F.nullif(first.cast("double"), F.lit(0.0))),
        step,
        lambda acc: acc["probability"] * acc["size"],
    )


def _nonempty(demand: Column) -> Column:
    return F.when(F.size(demand) > 0, demand)
