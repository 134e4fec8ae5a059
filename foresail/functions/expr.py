"""Column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def safe_divide(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """Floating division that yields NULL for a zero or NULL denominator."""
    return F.try_divide(
        as_column(numerator).cast("double"), as_column(denominator).cast("double")
    )


def canonical_json(values: Mapping[str, ColumnLike] | Sequence[str]) -> Column:
    """Compact JSON object with keys in name order and NULL fields kept."""
    named = values if isinstance(values, Mapping) else {name: name for name in values}
    fields = [as_column(named[key]).alias(key) for key in sorted(named)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def stable_id(values: Mapping[str, ColumnLike] | Sequence[str]) -> Column:
    """Deterministic sha256 identity of the named values."""
    return F.sha2(canonical_json(values), 256)


def entity_key(keys: Sequence[str]) -> Column:
    return canonical_json(list(keys))


def surrogate_key(columns: Sequence[ColumnLike]) -> Column:
    """md5 over the '-'-joined text of the columns; NULL has its own marker."""
    marker = F.lit("_surrogate_key_null_")
    texts = [F.coalesce(as_column(c).cast("string"), marker) for c in columns]
    return F.md5(F.concat_ws("-", *texts))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def blank(value: ColumnLike) -> Column:
    """True where a text is NULL or only whitespace."""
    column = as_column(value)
    return column.isNull() | (F.trim(column) == "")


def require_columns(df: DataFrame, columns: Sequence[str], what: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")


def require(df: DataFrame, rules: Mapping[str, Column], what: str) -> dict[str, int]:
    """Fail when any row breaks a rule; all rules run in one aggregate action.

    ``rules`` maps a message to the condition that marks an offending row. Runs
    eagerly, so a caller that writes afterwards never writes a rejected batch.
    """
    names = list(rules)
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.coalesce(rules[n], F.lit(False))).alias(f"_r{i}") for i, n in enumerate(names)],
    ).first()
    broken = {n: counts[f"_r{i}"] for i, n in enumerate(names) if counts[f"_r{i}"]}
    if broken:
        raise ValueError(f"{what}: " + "; ".join(f"{n} ({c} rows)" for n, c in broken.items()))
    return {"rows": counts["_rows"]}


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    """Fail when a key occurs twice; pre-aggregates before the shuffle."""
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"{what} must have one row per {', '.join(keys)}")


def fingerprint(row_text: ColumnLike) -> Column:
    """Order-independent digest of a set of rows, as an aggregate.

    Four 60-bit words of each row's sha256 are summed, so partial sums combine
    on the map side and no group is ever collected.
    """
    digest = F.sha2(as_column(row_text), 256)
    words = [
        F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast(
            "string"
        )
        for i in range(4)
    ]
    return F.sha2(F.concat_ws("-", F.count(F.lit(1)).cast("string"), *words), 256)
