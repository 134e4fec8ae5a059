"""Registered queries: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foresail.plans.relations import MIRRORS, SHARED
from foresail.sources.tables import table

BASE_TABLES = ("lineitem", "orders", "part", "supplier", "nation", "region", "customer", "events")


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Source], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None


QUERIES: dict[str, Query] = {}


def columns_of(spec: str) -> tuple[tuple[str, str], ...]:
    """``"date:d store_nbr:i"`` to name and kind. Kinds: s text, i integer,
    b boolean, d date, t instant, f double at 6 places, f4 / f3 / f9 likewise."""
    pairs = []
    for part in spec.split():
        name, _, kind = part.partition(":")
        pairs.append((name, kind or "s"))
    return tuple(pairs)


def query(name: str, columns: str, sql: str | None = None):
    def register(run):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, run, columns_of(columns), sql)
        return run

    return register


def _places(kind: str) -> int:
    return int(kind[1:] or 6)


def rounded(c: Column, places: int) -> Column:
    """``F.round`` of a double, which goes by way of decimal text, with the same result.

    Away from a tie and below 2**40 the scaled value's nearest whole number is the rounded
    one, since scaling errs by less than 2**-13; whole numbers and powers of ten are exact,
    so their quotient is the double nearest to the decimal. All else goes the long way.
    """
    scaled = c * F.lit(10.0**places)
    whole = F.rint(scaled)
    plain = (F.abs(scaled) < F.lit(2.0**40)) & (F.abs(F.abs(scaled - whole) - F.lit(0.5)) > F.lit(0.001))
    return F.when(plain, whole / F.lit(10.0**places)).otherwise(F.round(c, places))


def present(df: DataFrame, columns) -> DataFrame:
    """Project to the declared columns in types both engines print alike."""
    out = []
    for name, kind in columns:
        c = F.col(f"`{name}`")
        if kind == "s":
            c = c.cast("string")
        elif kind == "i":
            c = c.cast("long")
        elif kind == "b":
            c = c.cast("boolean")
        elif kind == "d":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        else:
            c = rounded(c.cast("double"), _places(kind)) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def _present_sql(columns) -> str:
    out = []
    for name, kind in columns:
        q = f'"{name}"'
        text = {
            "s": f"cast({q} as varchar)",
            "i": f"cast({q} as bigint)",
            "b": f"cast({q} as boolean)",
            "d": f"strftime(cast({q} as date), '%Y-%m-%d')",
            "t": f"strftime(cast({q} as timestamp), '%Y-%m-%d %H:%M:%S')",
        }.get(kind) or f"round(cast({q} as double), {_places(kind)}) + 0.0"
        out.append(f"{text} as {q}")
    return ", ".join(out)


def _needed(sql: str, known: dict[str, str]) -> list[str]:
    """Names of the relations a statement uses, dependencies first."""
    order: list[str] = []
    entered: set[str] = set()

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_][a-z0-9_]*", text)):
            if word in known and word not in entered:
                entered.add(word)
                visit(known[word])
                order.append(word)

    visit(sql)
    return order


def with_relations(sql: str, known: dict[str, str], once: bool = False) -> str:
    """``sql`` with the relations it uses; with ``once`` the checking engine evaluates those
    that are mentioned several times a single time, not for every mention."""
    names = _needed(sql, known)
    if not names:
        return sql
    words = Counter(re.findall(r"[a-z_][a-z0-9_]*", " ".join([sql, *[known[n] for n in names]])))
    kept = {n for n in names if once and words[n] > 1 and not re.search(rf"\b{n}\b", known[n])}
    ctes = ",\n".join(f"{n} as {'materialized ' * (n in kept)}({known[n]})" for n in names)
    return f"with recursive {ctes}\n{sql}"


def oracle(q: Query) -> str | None:
    if q.sql is None:
        return None
    body = f"select {_present_sql(q.columns)} from ({q.sql}) as result"
    return with_relations(body, SHARED | MIRRORS, once=True)


def spread(spark: SparkSession) -> int:
    """Parts for a small relation whose rows are multiplied."""
    return 4 * spark.sparkContext.defaultParallelism


class Source:
    """The given tables of one folder and the relations derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._relations: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return table(self.spark, name, self.sf_dir)

    def rel(self, name: str) -> DataFrame:
        """A derived relation, planned from its shared SQL definition."""
        if name not in self._relations:
            known = dict(SHARED)
            for base in BASE_TABLES:
                known[base] = f"select * from parquet.`{self.sf_dir}/{base}.parquet`"
            if any("explode(" in SHARED.get(n, "") for n in [name, *_needed(f"select * from {name}", SHARED)]):
                # one row a store becomes one a store and day: a single small file would do that in one task
                known["supplier"] = known["supplier"].replace("select", f"select /*+ REPARTITION({spread(self.spark)}) */", 1)
            text = with_relations(f"select * from {name}", known)
            self._relations[name] = self.spark.sql(text.replace("with recursive", "with", 1))
        return self._relations[name]

    @cached_property
    def spine(self) -> DataFrame:
        from foresail.operators import staging

        lo, hi = staging.spine_bounds(self.rel("raw_train"), self.rel("raw_test"))
        return staging.date_spine(self.spark, lo, hi)

    @cached_property
    def train(self) -> DataFrame:
        from foresail.operators import staging

        return staging.stage_train(self.rel("raw_train"), self.rel("raw_items"))

    @cached_property
    def test(self) -> DataFrame:
        from foresail.operators import staging

        return staging.stage_test(self.rel("raw_test"), self.rel("raw_items"), self.spine)

    @cached_property
    def fact(self) -> DataFrame:
        from foresail.operators import staging

        return staging.sales_fact(self.train, self.test)

    @cached_property
    def train_end(self):
        return self.rel("cutoff").first()["train_end"]

    @cached_property
    def panel(self) -> DataFrame:
        """Dense store panel: zero where nothing sold, NULL once withheld."""
        lo, hi = self.rel("store_day").agg(F.min("date"), F.max("date")).first()
        days = F.sequence(F.lit(lo), F.lit(hi), F.expr("interval 1 day"))
        grid = self.rel("raw_stores").repartition(spread(self.spark)).select(
            "store_nbr", F.col("state").alias("region"), F.explode(days).alias("date")
        )
        sold = self.rel("store_day").select("date", "store_nbr", "sales")
        known = F.when(F.col("date") <= F.lit(self.train_end), F.coalesce("sales", F.lit(0.0)))
        return grid.join(sold, ["date", "store_nbr"], "left").withColumn("sales", known)
