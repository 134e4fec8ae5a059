"""Rolling-window sales features at company, store, product and family grain.

A series has one row per day, so every window partition is bounded by the
length of the calendar, whatever share of the raw rows its key holds: the raw
skew is gone after the (map-side combined) daily aggregate. The operators on
their own are Windows that order by the day number and share one exchange and
one sort; a whole feature table works out its frames in one pass over the sorted
series (``rolling``), the weekday averages in another behind the same exchange.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresail.contracts import FeatureRule
from foresail.functions.calendar import CALENDAR_NUMBERS, calendar_columns, calendar_parts, day_number
from foresail.functions.expr import safe_divide
from foresail.operators.rolling import BASE_BLOCKS, BLOCK_STEPS, Roll, blocks_for, rolled

# Window lengths in rows.
SUM_DAYS = (3, 7, 14, 28, 30, 60, 90)
AVG_DAYS = (3, 7, 14, 28, 30, 60, 90, 180, 270, 360)
DOW_ROWS = (14, 28, 60, 90, 180, 270, 360)
SHORT_LONG = (
    ("l1d", (3, 7, 14, 28)),
    ("l3d", (7, 14, 28)),
    ("l7d", (14, 28, 30, 60, 90, 180, 360)),
)
DOW_PAIRS = ((14, 28), (14, 60), (14, 90), (28, 60), (28, 90), (60, 90))


@dataclass(frozen=True)
class FeatureSpec:
    """What one grain's feature table contains."""

    metric: str
    keys: tuple[str, ...] = ()
    shares: tuple[tuple[str, str], ...] = ()  # (numerator, denominator)
    rolled_shares: tuple[str, ...] = ()
    exact_leads: tuple[int, ...] = ()
    exact_lead_sum: int | None = None
    lead_rows: tuple[int, ...] = (1, 7, 14, 28, 30, 60, 90)
    same_weekday_lead: str | None = "rows"  # rows | range | None
    weekday_averages: bool = True


SPECS = {
    "company": FeatureSpec("sales_company", same_weekday_lead="range", weekday_averages=False),
    "store": FeatureSpec(
        "sales_store",
        ("store_nbr",),
        shares=(
            ("sales_store_on_promotion", "sales_store"),
            ("products_store_on_promotion", "products_store"),
            ("product_families_store_on_promotion", "product_families_store"),
        ),
        rolled_shares=("pct_sales_store_on_promotion", "pct_products_store_on_promotion"),
        exact_leads=(1, 2, 3, 4, 5, 6, 7),
        exact_lead_sum=7,
        lead_rows=(14, 28, 30, 60, 90),
        same_weekday_lead=None,
    ),
    "store_product": FeatureSpec(
        "sales_store_product",
        ("store_nbr", "product_id"),
        shares=(("sales_store_product_on_promotion", "sales_store_product"),),
        rolled_shares=("pct_sales_store_product_on_promotion",),
    ),
    "store_family": FeatureSpec(
        "sales_store_family",
        ("store_nbr", "product_family"),
        shares=(
            ("sales_store_family_on_promotion", "sales_store_family"),
            ("products_store_family_on_promotion", "products_store_family"),
        ),
        rolled_shares=("pct_sales_store_family_on_promotion", "pct_products_store_family_on_promotion"),
    ),
}


def _product_day(fact: DataFrame) -> DataFrame:
    """One row per (date, store, product): the finest grain, combined map-side."""
    promoted = F.col("on_promotion") == 1
    return fact.groupBy("date", "store_nbr", "product_id", "product_family").agg(
        F.max("data_split_source").alias("data_split_source"),
        F.sum("sales").alias("sales"),
        F.sum(F.when(promoted, F.col("sales")).otherwise(0.0)).alias("promo_sales"),
        F.max(promoted.cast("int")).alias("promoted"),
    )


def daily_agg(fact: DataFrame, grain: str) -> DataFrame:
    """Daily sales, breadth and promotion measures of one grain.

    Distinct products and families are counted by grouping twice (first to one
    row per product and day, then to the grain) rather than by expanding every
    fact row once per distinct column. A product belongs to one family: the
    item dimension's key sees to that.
    """
    if grain == "company":
        return fact.groupBy("date").agg(
            F.max("data_split_source").alias("data_split_source"),
            F.sum("sales").alias("sales_company"),
        )
    if grain == "store_product":
        promoted = F.col("on_promotion") == 1
        return fact.groupBy("date", "store_nbr", "product_id").agg(
            F.max("data_split_source").alias("data_split_source"),
            F.sum("sales").alias("sales_store_product"),
            F.sum(F.when(promoted, F.col("sales")).otherwise(0.0)).alias(
                "sales_store_product_on_promotion"
            ),
        )
    family_day = (
        _product_day(fact)
        .groupBy("date", "store_nbr", "product_family")
        .agg(
            F.max("data_split_source").alias("data_split_source"),
            F.sum("sales").alias("sales_store_family"),
            F.count("product_id").alias("products_store_family"),
            F.sum("promo_sales").alias("sales_store_family_on_promotion"),
            F.sum(F.when(F.col("product_id").isNotNull(), F.coalesce("promoted", F.lit(0))).otherwise(0)).alias(
                "products_store_family_on_promotion"
            ),
            F.max(F.coalesce("promoted", F.lit(0))).alias("_promoted"),
        )
    )
    if grain == "store_family":
        return family_day.drop("_promoted")
    if grain != "store":
        raise ValueError(f"grain must be one of {sorted(SPECS)}")
    return family_day.groupBy("date", "store_nbr").agg(
        F.max("data_split_source").alias("data_split_source"),
        F.sum("sales_store_family").alias("sales_store"),
        F.sum("products_store_family").alias("products_store"),
        F.count("product_family").alias("product_families_store"),
        F.sum("sales_store_family_on_promotion").alias("sales_store_on_promotion"),
        F.sum("products_store_family_on_promotion").alias("products_store_on_promotion"),
        F.sum(F.when(F.col("product_family").isNotNull(), F.col("_promoted")).otherwise(0)).alias(
            "product_families_store_on_promotion"
        ),
    )


DAY = "_day_number"


def dated(df: DataFrame, date: str) -> DataFrame:
    """Add the day number all frames order by.

    It is a column of its own: ordering by the expression would give every
    Window node a new attribute, and Spark would sort again for each.
    """
    return df if DAY in df.columns else df.withColumn(DAY, day_number(F.col(date)))


class Frames:
    """Row and calendar frames of one series, all in day-number order."""

    def __init__(self, keys: Sequence[str]):
        self.ordered = Window.partitionBy(*keys).orderBy(DAY)

    def rows(self, start: int, end: int):
        return self.ordered.rowsBetween(start, end)

    def last(self, n: int):
        return self.rows(-(n - 1), 0)

    def days(self, start: int, end: int):
        return self.ordered.rangeBetween(start, end)


def exact_lead_columns(f: Frames, m: str, days: Sequence[int]) -> dict[str, Column]:
    return {f"{m}_n{d}d": F.sum(m).over(f.days(d, d)) for d in days}


def lead_exact(df: DataFrame, keys, date: str, m: str, days: Sequence[int]) -> DataFrame:
    """Value exactly ``d`` calendar days ahead, NULL at a gap."""
    return _tidy(dated(df, date).withColumns(exact_lead_columns(Frames(keys), m, days)), df)


# A sliding frame is re-aggregated for every row, which for 360-row frames costs
# hundreds of updates per row and column. Instead, short frames (2, 3 and 7 rows)
# are aggregated once and longer ones are put together from shifted copies of
# them. Blocks are only ever added, never subtracted, so a run of zeros stays
# exactly zero, and deviations merge by count, mean and squared deviation.


def _merged(parts: Sequence[Column], spread: bool) -> Column:
    """One (count, sum, squared deviation) state from adjacent blocks' states."""
    n = sum((p["n"] for p in parts[1:]), parts[0]["n"])
    total = sum((p["s"] for p in parts[1:]), parts[0]["s"])
    fields = [n.alias("n"), total.alias("s")]
    if spread:
        mean = F.try_divide(total, n)
        between = [
            F.coalesce(p["n"] * F.pow(F.try_divide(p["s"], p["n"]) - mean, 2), F.lit(0.0)) for p in parts
        ]
        fields.append(sum([p["m2"] for p in parts[1:]] + between, parts[0]["m2"]).alias("m2"))
    return F.struct(*fields)


def window_states(
    df: DataFrame,
    f: Frames,
    columns: Sequence[str],
    ns: Sequence[int],
    spread: bool = False,
    forward: bool = False,
) -> DataFrame:
    """Add a state column per (column, n): the last ``n`` rows including the
    current one, or with ``forward`` the next ``n`` rows after it."""
    shift, tag = ("lead", "next") if forward else ("lag", "last")
    empty = "named_struct('n', 0D, 's', 0D" + (", 'm2', 0D)" if spread else ")")
    wanted = blocks_for(ns)

    def name(c: str, n: int) -> str:
        return f"_{tag}_{c}_{n}"

    def state(c: str, n: int) -> Column:
        w = f.rows(1, n) if forward else f.last(n)
        count = F.count(c).over(w).cast("double")
        fields = [count.alias("n"), F.coalesce(F.sum(c).over(w).cast("double"), F.lit(0.0)).alias("s")]
        if spread:
            fields.append((F.coalesce(F.var_pop(c).over(w), F.lit(0.0)) * count).alias("m2"))
        return F.struct(*fields)

    def shifted(c: str, n: int, rows: int) -> Column:
        return F.expr(f"{shift}({name(c, n)}, {rows}, {empty})").over(f.ordered)

    out = df.withColumns({name(c, n): state(c, n) for c in columns for n in BASE_BLOCKS if n in wanted})
    for step in BLOCK_STEPS:
        made = {n: plan for n, plan in step.items() if n in wanted}
        moves: dict[str, Column] = {}
        merged: dict[str, Column] = {}
        for c in columns:
            for n, (block, count, tail) in made.items():
                parts = [name(c, block)]
                for k in range(1, count):
                    parts.append(f"_{c}_{block}_at{k * block}")
                    moves[parts[-1]] = shifted(c, block, k * block)
                if tail:
                    parts.append(f"_{c}_{tail}_at{count * block}")
                    moves[parts[-1]] = shifted(c, tail, count * block)
                merged[name(c, n)] = _merged([F.col(x) for x in parts], spread)
        if made:
            out = out.withColumns(moves).withColumns(merged).drop(*moves)
    return out


def _without_states(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(("_last_", "_next_"))])


def _tidy(out: DataFrame, source: DataFrame) -> DataFrame:
    """Drop the working columns an operator added to its source."""
    clean = _without_states(out)
    return clean if DAY in source.columns else clean.drop(DAY)


def _sum_of(state: str) -> Column:
    return F.when(F.col(state)["n"] > 0, F.col(state)["s"])


def _avg_of(state: str) -> Column:
    return F.try_divide(F.col(state)["s"], F.col(state)["n"])


def _stddev_of(state: str) -> Column:
    n = F.col(state)["n"]
    return F.when(n > 1, F.sqrt(F.try_divide(F.col(state)["m2"], n - 1)))


def lead_row_columns(m: str, ns: Sequence[int]) -> dict[str, Column]:
    return {f"{m}_n{n}d": _sum_of(f"_next_{m}_{n}") for n in ns}


def lead_rows(df: DataFrame, keys, date: str, m: str, ns: Sequence[int]) -> DataFrame:
    """Sum over the next ``n`` rows of the series."""
    states = window_states(dated(df, date), Frames(keys), [m], ns, forward=True)
    return _tidy(states.withColumns(lead_row_columns(m, ns)), df)


def last_sum_columns(m: str, ns: Sequence[int]) -> dict[str, Column]:
    return {f"{m}_l1d": F.col(m)} | {f"{m}_l{n}d": _sum_of(f"_last_{m}_{n}") for n in ns}


def last_sum(df: DataFrame, keys, date: str, m: str, ns: Sequence[int] = SUM_DAYS) -> DataFrame:
    states = window_states(dated(df, date), Frames(keys), [m], ns)
    return _tidy(states.withColumns(last_sum_columns(m, ns)), df)


def last_avg_columns(m: str, ns: Sequence[int]) -> dict[str, Column]:
    return {f"avg_{m}_l{n}d": _avg_of(f"_last_{m}_{n}") for n in ns}


def last_avg(df: DataFrame, keys, date: str, m: str, ns: Sequence[int] = AVG_DAYS) -> DataFrame:
    states = window_states(dated(df, date), Frames(keys), [m], ns)
    return _tidy(states.withColumns(last_avg_columns(m, ns)), df)


def last_stddev_columns(m: str, ns: Sequence[int]) -> dict[str, Column]:
    return {f"stddev_{m}_l{n}d": _stddev_of(f"_last_{m}_{n}") for n in ns}


def last_stddev(df: DataFrame, keys, date: str, m: str, ns: Sequence[int] = AVG_DAYS) -> DataFrame:
    """Sample standard deviation; NULL for a single value."""
    states = window_states(dated(df, date), Frames(keys), [m], ns, spread=True)
    return _tidy(states.withColumns(last_stddev_columns(m, ns)), df)


def prior_sum_columns(f: Frames, m: str, ns: Sequence[int]) -> dict[str, Column]:
    """The block before the last ``n`` rows is the last-``n`` sum ``n`` rows ago."""
    return {f"{m}_p1d": F.lag(m, 1).over(f.ordered).cast("double")} | {
        f"{m}_p{n}d": F.lag(f"{m}_l{n}d", n).over(f.ordered) for n in ns
    }


def prior_sum(df: DataFrame, keys, date: str, m: str, ns: Sequence[int] = SUM_DAYS) -> DataFrame:
    """Sum over the block of ``n`` rows just before the last ``n``."""
    made = [f"{m}_l{n}d" for n in (1, *ns) if f"{m}_l{n}d" not in df.columns]
    base = dated(df, date)
    sums = last_sum(base, keys, date, m, ns) if made else base
    return _tidy(sums.withColumns(prior_sum_columns(Frames(keys), m, ns)).drop(*made), df)


def promo_share(df: DataFrame, num: str, den: str) -> DataFrame:
    return df.withColumn(f"pct_{num}", safe_divide(num, den))


def rolling_share(df: DataFrame, keys, date: str, cols: Sequence[str], ns=AVG_DAYS) -> DataFrame:
    """Rolling mean and deviation of promotion shares."""
    states = window_states(dated(df, date), Frames(keys), cols, ns, spread=True)
    columns: dict[str, Column] = {}
    for c in cols:
        columns |= last_avg_columns(c, ns) | last_stddev_columns(c, ns)
    return _tidy(states.withColumns(columns), df)


def dow_avg(df: DataFrame, keys, date: str, m: str, ns: Sequence[int] = DOW_ROWS) -> DataFrame:
    """Mean of the last ``n`` rows with the same weekday (weeks, not days)."""
    states = window_states(dated(df, date), Frames([*keys, "day_of_week"]), [m], ns)
    return _tidy(states.withColumns({f"avg_{m}_dow_l{n}d": _avg_of(f"_last_{m}_{n}") for n in ns}), df)


def short_long(df: DataFrame, m: str, pairs=SHORT_LONG) -> DataFrame:
    """Short-window level over long-window mean, as a difference from one."""
    columns = {}
    for short, longs in pairs:
        numerator = f"{m}_{short}" if short == "l1d" else f"avg_{m}_{short}"
        for n in longs:
            columns[f"avg_{m}_{short}_l{n}d_pct_diff"] = (
                safe_divide(numerator, f"avg_{m}_l{n}d") - 1
            )
    return df.withColumns(columns)


def period_over_period(df: DataFrame, m: str, ns: Sequence[int] = (1, *SUM_DAYS)) -> DataFrame:
    return df.withColumns(
        {f"{m}_l{n}d_p{n}d_pct_diff": safe_divide(f"{m}_l{n}d", f"{m}_p{n}d") - 1 for n in ns}
    )


def dow_ratios(df: DataFrame, m: str, pairs=DOW_PAIRS) -> DataFrame:
    """Weekday mean over all-days mean, and between weekday windows."""
    dow = f"avg_{m}_dow_l"
    columns = {
        f"{dow}{n}d_pct_diff": safe_divide(f"{dow}{n}d", f"avg_{m}_l{n}d") for n in (14, 28, 60, 90)
    }
    columns |= {
        f"{dow}{a}d_l{b}d_diff": safe_divide(f"{dow}{a}d", f"{dow}{b}d") for a, b in pairs
    }
    return df.withColumns(columns)


def rolling_features(df: DataFrame, spec: FeatureSpec, date: str = "date") -> DataFrame:
    """The whole feature table of one grain from its daily aggregate."""
    m, keys = spec.metric, list(spec.keys)
    out = dated(df, date)
    for num, den in spec.shares:
        out = promo_share(out, num, den)
    if spec.weekday_averages:
        out = out.withColumn("day_of_week", calendar_columns(F.col(date))["day_of_week"]).repartition(*keys)
        weekly = [Roll(f"avg_{m}_dow_l{n}d", "avg", m, n) for n in DOW_ROWS]
        out = rolled(out, [*keys, "day_of_week"], DAY, weekly, by=keys).drop("day_of_week")
    rolls = [Roll(f"{m}_n{d}d", "day", m, d) for d in spec.exact_leads]
    if spec.exact_lead_sum:
        n = spec.exact_lead_sum
        rolls.append(Roll(f"{m}_n{n}d_cum", "days", m, n))
    if spec.same_weekday_lead:
        rolls.append(Roll(f"{m}_n7d_same_dow", "day" if spec.same_weekday_lead == "range" else "row", m, 7))
    rolls += [Roll(f"{m}_n{n}d", "next", m, n) for n in spec.lead_rows]
    rolls += [Roll(f"{m}_l{n}d", "sum", m, n) for n in SUM_DAYS]
    for c in (m, *spec.rolled_shares):
        rolls += [Roll(f"{kind}_{c}_l{n}d", kind, c, n) for kind in ("avg", "stddev") for n in AVG_DAYS]
    rolls += [Roll(f"{m}_p{n}d", "prior", m, n) for n in (1, *SUM_DAYS)]
    out = rolled(out, keys, DAY, rolls, by=keys if spec.weekday_averages else ()).drop(DAY)
    out = calendar_parts(out, date).withColumn(f"{m}_l1d", F.col(m))
    out = period_over_period(short_long(out, m), m)
    return dow_ratios(out, m) if spec.weekday_averages else out


def feature_table(fact: DataFrame, grain: str) -> DataFrame:
    return rolling_features(daily_agg(fact, grain), SPECS[grain])


# --- when a feature is known ---------------------------------------------------------
def _lagged_names(spec: FeatureSpec) -> list[str]:
    """What ``rolling_features`` adds from the row's own day and days before it."""
    m = spec.metric
    names = [f"pct_{num}" for num, _ in spec.shares] + [f"{m}_l{n}d" for n in (1, *SUM_DAYS)]
    for c in (m, *spec.rolled_shares):
        names += [f"{stat}_{c}_l{n}d" for stat in ("avg", "stddev") for n in AVG_DAYS]
    names += [f"{m}_p{n}d" for n in (1, *SUM_DAYS)]
    names += [f"avg_{m}_{short}_l{n}d_pct_diff" for short, longs in SHORT_LONG for n in longs]
    names += [f"{m}_l{n}d_p{n}d_pct_diff" for n in (1, *SUM_DAYS)]
    if spec.weekday_averages:
        names += [f"avg_{m}_dow_l{n}d" for n in DOW_ROWS]
        names += [f"avg_{m}_dow_l{n}d_pct_diff" for n in (14, 28, 60, 90)]
        names += [f"avg_{m}_dow_l{a}d_l{b}d_diff" for a, b in DOW_PAIRS]
    return names


def _lead_names(spec: FeatureSpec) -> list[str]:
    """Labels: what ``rolling_features`` adds from days after the row's own."""
    m = spec.metric
    names = [f"{m}_n{n}d" for n in (*spec.exact_leads, *spec.lead_rows)]
    names += [f"{m}_n{spec.exact_lead_sum}d_cum"] if spec.exact_lead_sum else []
    return names + ([f"{m}_n7d_same_dow"] if spec.same_weekday_lead else [])


def declared_features() -> dict[str, FeatureRule]:
    """Every feature of the tables built here, by name, with when it is known.

    The day's own measures and everything behind it count as observed before the
    forecast starts, the calendar as known for ever, the plans for promotions and
    holidays as known from the moment their metadata column gives.
    """
    measures = {
        "company": [],
        "store": ["products_store", "product_families_store"],
        "store_product": [],
        "store_family": ["products_store_family"],
    }
    known = {
        "promotion": FeatureRule("known_future", "promotion", ("promotion_plan_updated_at",)),
        "holiday": FeatureRule("known_future", "holiday", ("calendar_version_loaded_at",)),
    }

    def add(availability: str, names: Sequence[str]) -> None:
        known.update({n: FeatureRule(availability, n) for n in names})

    add("observed_after_period", ["sales", "transactions"])
    add("static_master_data", CALENDAR_NUMBERS)
    for grain, spec in SPECS.items():
        own = [spec.metric, *measures[grain], *[num for num, _ in spec.shares]]
        add("observed_lagged", own + _lagged_names(spec))
        add("observed_after_period", _lead_names(spec))
    return known
