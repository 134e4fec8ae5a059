"""Queries over sources (IO) and staging (ST)."""

from __future__ import annotations


from pyspark.sql import functions as F

from foresail.operators import staging as st
from foresail.plans.registry import Source, query
from foresail.plans.relations import CALENDAR_SPEC, calendar_sql
from foresail.sources import history

FACT = "id date:d store_nbr:i product_id:i product_family sales:f on_promotion:i data_split_source"


@query(
    "io2_read_relation",
    "n_rows:i units:f first_date:d last_date:d",
    """select count(*) as n_rows, sum(unit_sales) as units, min(date) as first_date, max(date) as last_date
       from sales_raw""",
)
def read_relation(s: Source):
    return s.table("lineitem").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("l_quantity").alias("units"),
        F.to_date(F.min("l_shipdate")).alias("first_date"),
        F.to_date(F.max("l_shipdate")).alias("last_date"),
    )


@query("st1_date_spine", "date:d", "select date from spine")
def date_spine(s: Source):
    return s.spine


@query(
    "st2_stage_train",
    "id date:d store_nbr:i product_id:i product_family sales:f on_promotion:i",
    "select * from stage_train",
)
def stage_train(s: Source):
    return s.train


@query(
    "st3_stage_test",
    "id date:d store_nbr:i product_id:i product_family on_promotion:i",
    "select * from stage_test",
)
def stage_test(s: Source):
    return s.test


@query("st4_sales_fact", FACT, "select * from sales_fact")
def sales_fact(s: Source):
    return s.fact


@query(
    "st5_align_to_spine",
    "date:d dcoilwtico:f",
    "select d.date, o.dcoilwtico from spine d left join raw_oil o on d.date = o.date",
)
def align(s: Source):
    return st.align_to_spine(s.rel("raw_oil"), s.spine)


@query(
    "st6_dense_transactions",
    "id date:d store_nbr:i store_transactions:i",
    """select md5(cast(d.date as varchar) || '-' || s.store_nbr) as id, d.date, s.store_nbr,
              t.transactions as store_transactions
       from spine d cross join raw_stores s
       left join raw_transactions t on d.date = t.date and s.store_nbr = t.store_nbr""",
)
def dense_transactions(s: Source):
    return st.densify(s.spine, st.stores(s.rel("raw_stores")), s.rel("raw_transactions"))


@query(
    "st7_stage_events",
    f"id date:d locale_name description transferred:b event_locale event_type {CALENDAR_SPEC}",
    f"""select md5(cast(date as varchar) || '-' || locale || '-' || type || '-' || description || '-' ||
                   cast(transferred as varchar)) as id,
              date, locale_name, description, transferred, locale as event_locale, type as event_type,
              {calendar_sql()} from raw_holidays""",
)
def stage_events(s: Source):
    return st.stage_events(s.rel("raw_holidays"))


def _flags_sql(match: str) -> str:
    flags = []
    for flag, (locale, kind) in st.EVENT_FLAGS.items():
        place = "" if locale == "National" else f" and (s.city = h.{match} or s.state = h.{match})"
        flags.append(f"max(h.locale = '{locale}' and h.type = '{kind}'{place}) as {flag}")
    return f"""select s.store_nbr, h.date, {", ".join(flags)}, {calendar_sql("h.date")}
               from raw_stores s cross join raw_holidays h group by s.store_nbr, h.date"""


FLAG_SPEC = "store_nbr:i date:d " + " ".join(f"{f}:b" for f in st.EVENT_FLAGS) + " " + CALENDAR_SPEC


@query("st8_store_event_flags", FLAG_SPEC, _flags_sql("locale"))
def event_flags(s: Source):
    return st.store_event_flags(s.rel("raw_stores"), st.stage_events(s.rel("raw_holidays")))


@query("st8_store_event_flags_by_place", FLAG_SPEC, _flags_sql("locale_name"))
def event_flags_by_place(s: Source):
    events = st.stage_events(s.rel("raw_holidays"))
    return st.store_event_flags(s.rel("raw_stores"), events, match_col="locale_name")


@query("st9_stores", "store_nbr:i city state type cluster:i", "select * from raw_stores")
def stores(s: Source):
    return st.stores(s.rel("raw_stores"))


@query(
    "io6_incremental_filter",
    "date:d store_nbr:i item_nbr:i unit_sales:f",
    """select date, store_nbr, item_nbr, unit_sales from sales_raw
       where date > coalesce((select max(date) from raw_train), date '1900-01-01')""",
)
def incremental(s: Source):
    return history.incremental_filter(s.rel("sales_raw"), s.rel("raw_train"))


@query(
    "io5_train_and_predict_slices",
    "part date:d store_nbr:i sales:f",
    """select 'train' as part, date, store_nbr, sales from store_day, cutoff
         where date > train_end - 90 and date <= train_end - 1
       union all
       select 'predict', date, store_nbr, sales from store_day, cutoff where date = train_end""",
)
def slices(s: Source):
    as_of = s.rel("cutoff").first()["train_end"]
    panel = s.rel("store_day").select("date", "store_nbr", "sales")
    train = history.train_slice(panel, as_of, 90).withColumn("part", F.lit("train"))
    return train.unionByName(history.predict_slice(panel, as_of).withColumn("part", F.lit("predict")))
