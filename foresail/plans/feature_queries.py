"""Queries over feature engineering (FE)."""

from __future__ import annotations

from foresail.operators import features as fe
from foresail.plans.registry import Source, query
from foresail.plans.relations import CALENDAR_SPEC, MIRRORS, calendar_sql

BASES = {
    "company": "data_split_source sales_company:f",
    "store": "data_split_source sales_store:f products_store:i product_families_store:i "
    "sales_store_on_promotion:f products_store_on_promotion:i product_families_store_on_promotion:i",
    "store_product": "data_split_source sales_store_product:f sales_store_product_on_promotion:f",
    "store_family": "data_split_source sales_store_family:f products_store_family:i "
    "sales_store_family_on_promotion:f products_store_family_on_promotion:i",
}
KEY_SPECS = {
    "company": "",
    "store": "store_nbr:i",
    "store_product": "store_nbr:i product_id:i",
    "store_family": "store_nbr:i product_family",
}


class FeatureSql:
    """The checking engine's text of one grain's feature table, by block."""

    def __init__(self, grain: str):
        self.grain, self.spec = grain, fe.SPECS[grain]
        self.m = self.spec.metric
        self.keys = list(self.spec.keys)
        self.columns: list[tuple[str, str]] = []

    def over(self, frame: str, extra: tuple[str, ...] = (), order: str = "date") -> str:
        part = ", ".join([*self.keys, *extra])
        partition = f"partition by {part} " if part else ""
        return f"over ({partition}order by {order} {frame})"

    def add(self, name: str, text: str, kind: str = "f") -> str:
        self.columns.append((name, kind))
        return f"{text} as {name}"

    def rows(self, a: str, b: str) -> str:
        return self.over(f"rows between {a} and {b}")

    def last(self, n: int) -> str:
        return self.rows(f"{n - 1} preceding", "current row")

    def days(self, a: int, b: int) -> str:
        return self.over(
            f"range between {a} following and {b} following", order="date - date '1970-01-01'"
        )

    def shares(self):
        return [self.add(f"pct_{n}", f"{n} / nullif({d}, 0)") for n, d in self.spec.shares]

    def leads(self):
        s, m = self.spec, self.m
        out = [self.add(f"{m}_n{d}d", f"sum({m}) {self.days(d, d)}") for d in s.exact_leads]
        if s.exact_lead_sum:
            out.append(self.add(f"{m}_n{s.exact_lead_sum}d_cum", f"sum({m}) {self.days(1, s.exact_lead_sum)}"))
        if s.same_weekday_lead:
            w = self.days(7, 7) if s.same_weekday_lead == "range" else self.rows("7 following", "7 following")
            out.append(self.add(f"{m}_n7d_same_dow", f"sum({m}) {w}"))
        return out + [
            self.add(f"{m}_n{n}d", f"sum({m}) {self.rows('1 following', f'{n} following')}") for n in s.lead_rows
        ]

    def sums(self):
        m = self.m
        out = [self.add(f"{m}_l1d", m)]
        return out + [self.add(f"{m}_l{n}d", f"sum({m}) {self.last(n)}") for n in fe.SUM_DAYS]

    def averages(self, c: str):
        kind = "f9" if c.startswith("pct_") else "f"
        return [self.add(f"avg_{c}_l{n}d", f"avg({c}) {self.last(n)}", kind) for n in fe.AVG_DAYS]

    def deviations(self, c: str):
        return [self.add(f"stddev_{c}_l{n}d", f"stddev_samp({c}) {self.last(n)}", "f4") for n in fe.AVG_DAYS]

    def priors(self):
        m = self.m
        out = [self.add(f"{m}_p1d", f"sum({m}) {self.rows('1 preceding', '1 preceding')}")]
        return out + [
            self.add(f"{m}_p{n}d", f"sum({m}) {self.rows(f'{2 * n - 1} preceding', f'{n} preceding')}")
            for n in fe.SUM_DAYS
        ]

    def weekday(self):
        m = self.m
        return [
            self.add(
                f"avg_{m}_dow_l{n}d",
                f"avg({m}) " + self.over(f"rows between {n - 1} preceding and current row", ("day_of_week",)),
            )
            for n in fe.DOW_ROWS
        ]

    def comparisons(self):
        m, out = self.m, []
        for short, longs in fe.SHORT_LONG:
            top = f"{m}_{short}" if short == "l1d" else f"avg_{m}_{short}"
            for n in longs:
                out.append(
                    self.add(f"avg_{m}_{short}_l{n}d_pct_diff", f"{top} / nullif(avg_{m}_l{n}d, 0) - 1", "f9")
                )
        return out

    def periods(self):
        m = self.m
        return [
            self.add(f"{m}_l{n}d_p{n}d_pct_diff", f"{m}_l{n}d / nullif({m}_p{n}d, 0) - 1", "f9")
            for n in (1, *fe.SUM_DAYS)
        ]

    def weekday_ratios(self):
        d = f"avg_{self.m}_dow_l"
        out = [
            self.add(f"{d}{n}d_pct_diff", f"{d}{n}d / nullif(avg_{self.m}_l{n}d, 0)", "f9")
            for n in (14, 28, 60, 90)
        ]
        return out + [
            self.add(f"{d}{a}d_l{b}d_diff", f"{d}{a}d / nullif({d}{b}d, 0)", "f9") for a, b in fe.DOW_PAIRS
        ]


def _table_sql(grain: str) -> tuple[str, str]:
    """Column spec and text of the whole feature table of a grain."""
    b = FeatureSql(grain)
    first = ", ".join([f"*, {calendar_sql()}", *b.shares()])
    windows = [*b.leads(), *b.sums(), *b.averages(b.m), *b.deviations(b.m), *b.priors()]
    for share in b.spec.rolled_shares:
        windows += b.averages(share) + b.deviations(share)
    if b.spec.weekday_averages:
        windows += b.weekday()
    last = [*b.comparisons(), *b.periods()]
    if b.spec.weekday_averages:
        last += b.weekday_ratios()
    spec = " ".join(
        ["date:d", KEY_SPECS[grain], BASES[grain], CALENDAR_SPEC, *[f"{n}:{k}" for n, k in b.columns]]
    )
    text = f"""select *, {", ".join(last)} from (
      select *, {", ".join(windows)} from (select {first} from agg_{grain}))"""
    return spec, text


def _register_table(grain: str) -> None:
    spec, text = _table_sql(grain)
    MIRRORS[f"feature_{grain}"] = text

    @query(f"fe_{grain}_features", spec, f"select * from feature_{grain}")
    def table(s: Source):
        return fe.feature_table(s.fact, grain)


def _register_daily(grain: str) -> None:
    @query(f"fe1_daily_{grain}", f"date:d {KEY_SPECS[grain]} {BASES[grain]}", f"select * from agg_{grain}")
    def daily(s: Source):
        return fe.daily_agg(s.fact, grain)


for _grain in fe.SPECS:
    _register_daily(_grain)
    _register_table(_grain)


@query("fe2_calendar_parts", f"date:d {CALENDAR_SPEC}", f"select date, {calendar_sql()} from spine")
def calendar(s: Source):
    from foresail.functions.calendar import calendar_parts

    return calendar_parts(s.spine)


def _register_block(name: str, grain: str, sql_block, run) -> None:
    """One feature operator on its own, over the daily aggregate of a grain."""
    b = FeatureSql(grain)
    first = ", ".join([f"*, {calendar_sql()}", *b.shares()])
    b.columns.clear()
    columns = sql_block(b)
    text = f"select *, {', '.join(columns)} from (select {first} from agg_{grain})"
    kept = " ".join(f"{n}:{k}" for n, k in b.columns)

    @query(name, f"date:d {KEY_SPECS[grain]} {kept}", text)
    def block(s: Source):
        from foresail.functions.calendar import calendar_parts

        daily = calendar_parts(fe.daily_agg(s.fact, grain))
        for num, den in fe.SPECS[grain].shares:
            daily = fe.promo_share(daily, num, den)
        return run(daily, fe.SPECS[grain].metric, list(fe.SPECS[grain].keys))


def _leads_only(exact: bool):
    def block(b: FeatureSql):
        columns = b.leads()
        n = len(b.spec.exact_leads)
        keep = slice(0, n) if exact else slice(n + bool(b.spec.exact_lead_sum) + bool(b.spec.same_weekday_lead), None)
        b.columns[:] = b.columns[keep]
        return columns[keep]

    return block


_register_block(
    "fe3_exact_day_leads", "store", _leads_only(True),
    lambda df, m, k: fe.lead_exact(df, k, "date", m, (1, 2, 3, 4, 5, 6, 7)),
)
_register_block(
    "fe4_next_row_sums", "store_family", _leads_only(False),
    lambda df, m, k: fe.lead_rows(df, k, "date", m, fe.SPECS["store_family"].lead_rows),
)
_register_block("fe5_last_sums", "store", lambda b: b.sums(), lambda df, m, k: fe.last_sum(df, k, "date", m))
_register_block(
    "fe6_last_averages", "store", lambda b: b.averages(b.m), lambda df, m, k: fe.last_avg(df, k, "date", m)
)
_register_block(
    "fe7_last_deviations", "store", lambda b: b.deviations(b.m), lambda df, m, k: fe.last_stddev(df, k, "date", m)
)
_register_block("fe8_prior_sums", "store", lambda b: b.priors(), lambda df, m, k: fe.prior_sum(df, k, "date", m))
_register_block("fe9_promotion_shares", "store", lambda b: b.shares(), lambda df, m, k: df)
_register_block(
    "fe10_rolling_shares", "store_product",
    lambda b: b.averages(b.spec.rolled_shares[0]) + b.deviations(b.spec.rolled_shares[0]),
    lambda df, m, k: fe.rolling_share(df, k, "date", fe.SPECS["store_product"].rolled_shares),
)
_register_block("fe11_weekday_averages", "store", lambda b: b.weekday(), lambda df, m, k: fe.dow_avg(df, k, "date", m))


def _register_ratio(name: str, grain: str, sql_block, run) -> None:
    """A ratio block, which reads the window columns of the feature table."""
    b = FeatureSql(grain)
    sql_block(b)
    kept = " ".join(f"{n}:{k}" for n, k in b.columns)

    @query(name, f"date:d {KEY_SPECS[grain]} {kept}", f"select * from feature_{grain}")
    def block(s: Source):
        from foresail.functions.calendar import calendar_parts

        m, keys = fe.SPECS[grain].metric, list(fe.SPECS[grain].keys)
        df = calendar_parts(fe.daily_agg(s.fact, grain))
        df = fe.last_avg(fe.last_sum(df, keys, "date", m), keys, "date", m)
        df = fe.prior_sum(df, keys, "date", m)
        return run(df, m, keys)


_register_ratio(
    "fe12_short_long_ratios", "store_family", lambda b: b.comparisons(), lambda df, m, k: fe.short_long(df, m)
)
_register_ratio(
    "fe13_period_over_period", "store_family", lambda b: b.periods(), lambda df, m, k: fe.period_over_period(df, m)
)
_register_ratio(
    "fe14_weekday_ratios", "store_family", lambda b: b.weekday_ratios(),
    lambda df, m, k: fe.dow_ratios(fe.dow_avg(df, k, "date", m), m),
)
