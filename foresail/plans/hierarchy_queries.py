"""Queries over hierarchies and reconciliation (HI)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foresail.contracts import HierarchySpec
from foresail.operators import hierarchy as hi
from foresail.operators import metrics as me
from foresail.plans.registry import Source, query
from foresail.plans.relations import MIRRORS, SHARED
from foresail.session import stored

LEVELS = (("company", ()), ("region", ("region",)), ("store", ("store_nbr",)))
GROUPS = ["forecast_origin", "target_date", "horizon"]
VALUES = ["prediction_p10", "prediction_p50", "prediction_p90"]

SHARED["entities"] = "select store_nbr, state as region from raw_stores"
# base forecasts of every node per day: leaves from the previous sale, ancestors a
# little off the sum of their leaves, so that methods differ
LEAF_FC = """
select store_nbr, region, date as target_date, 1 as horizon, cast(date - interval 1 day as timestamp) as forecast_origin,
       10.0 + cast(store_nbr % 7 as double) + cast(extract(day from date) as double) as prediction_p50
from (select store_nbr, state as region, {each} as date from raw_stores) as leaf_day"""
# every store gets the bounded list of days with sales; the engines name that differently
SHARED["leaf_fc"] = LEAF_FC.format(each="explode((select collect_set(date) from store_day))")
MIRRORS["leaf_fc"] = LEAF_FC.format(each="unnest((select list(distinct date) from store_day))")
SHARED["node_fc"] = """
select 'store:' || cast(store_nbr as string) as node_id, 'store' as level_name, forecast_origin, target_date, horizon,
       prediction_p50 * 0.5 as prediction_p10, prediction_p50, prediction_p50 * 1.5 as prediction_p90
from leaf_fc
union all
select 'region:' || region, 'region', forecast_origin, target_date, horizon,
       sum(prediction_p50) * 0.625, sum(prediction_p50) * 1.25, sum(prediction_p50) * 1.75
from leaf_fc group by region, forecast_origin, target_date, horizon
union all
select 'company:all', 'company', forecast_origin, target_date, horizon,
       sum(prediction_p50) * 0.75, sum(prediction_p50) * 1.5, sum(prediction_p50) * 2.0
from leaf_fc group by forecast_origin, target_date, horizon"""
SHARED["node_variance"] = """
select 'store:' || cast(store_nbr as string) as node_id, 1.0 + cast(store_nbr % 3 as double) as variance from entities
union all select 'region:' || region, 8.0 from entities group by region
union all select 'company:all', 64.0 from entities group by 1"""

MIRRORS["h_nodes"] = """
select 'demand' as hierarchy_name, 'v1' as hierarchy_version, 'company:all' as node_id, 'company' as level_name,
       0 as level_position, '{}' as node_key_json
union all select distinct 'demand', 'v1', 'region:' || region, 'region', 1, to_json({'region': region})::varchar
from entities
union all select distinct 'demand', 'v1', 'store:' || store_nbr, 'store', 2, to_json({'store_nbr': store_nbr})::varchar
from entities"""
MIRRORS["h_edges"] = """
select distinct 'demand' as hierarchy_name, 'v1' as hierarchy_version, 'company:all' as parent_node_id,
       'region:' || region as child_node_id from entities
union all select distinct 'demand', 'v1', 'region:' || region, 'store:' || store_nbr from entities"""
MIRRORS["h_paths"] = """
select node_id as ancestor, node_id, 0 as distance from h_nodes
union all
select e.parent_node_id, p.node_id, p.distance + 1 from h_paths p join h_edges e on e.child_node_id = p.ancestor"""
MIRRORS["h_leafpaths"] = "select ancestor, node_id as leaf from h_paths where node_id like 'store:%'"
MIRRORS["h_children"] = "select parent_node_id, count(*) as n from h_edges group by 1"
MIRRORS["h_bottom"] = f"""
select p.ancestor as node_id, forecast_origin, target_date, horizon, {", ".join(f"sum({v}) as {v}" for v in VALUES)}
from node_fc f join h_leafpaths p on p.leaf = f.node_id group by 1, 2, 3, 4"""
MIRRORS["h_share"] = """
select n.node_id, case n.level_name when 'company' then 1.0 when 'region' then 1.0 / c.n
       else 1.0 / c.n / r.n end as w
from h_nodes n left join h_edges e on e.child_node_id = n.node_id
left join h_children r on r.parent_node_id = e.parent_node_id and n.level_name = 'store'
left join h_children c on c.parent_node_id = 'company:all'"""


def graph(s: Source):
    return hi.build_hierarchy(s.rel("entities"), LEVELS, "demand", "v1")


NODE_SPEC = "hierarchy_name hierarchy_version node_id level_name level_position:i node_key_json"
FC_SPEC = "node_id target_date:d horizon:i prediction_p10:f prediction_p50:f prediction_p90:f"


@query("hi1_hierarchy_nodes", NODE_SPEC, "select * from h_nodes")
def nodes(s: Source):
    return graph(s)[0]


@query(
    "hi1_hierarchy_edges",
    "hierarchy_name hierarchy_version parent_node_id child_node_id",
    "select * from h_edges",
)
def edges(s: Source):
    return graph(s)[1]


@query(
    "hi2_graph_violations",
    "rule node_id",
    """select 'every child must have exactly one parent' as rule, child as node_id from
         (select 'region:' || state as parent, 'city:' || city as child from raw_stores group by 1, 2
          union select 'type:' || type, 'city:' || city from raw_stores group by 1, 2)
       group by child having count(*) > 1""",
)
def violations(s: Source):
    # two groupings of the same cities: a city under a region and a type has two parents
    st = s.rel("raw_stores")
    root = F.lit("company:all")
    pairs = st.select(F.concat(F.lit("region:"), "state").alias("p"), F.concat(F.lit("city:"), "city").alias("c"))
    pairs = pairs.unionByName(
        st.select(F.concat(F.lit("type:"), "type").alias("p"), F.concat(F.lit("city:"), "city").alias("c"))
    ).distinct()
    top = pairs.select(root.alias("parent_node_id"), F.col("p").alias("child_node_id")).distinct()
    links = top.unionByName(pairs.select(F.col("p").alias("parent_node_id"), F.col("c").alias("child_node_id")))
    ids = links.select(F.explode(F.array("parent_node_id", "child_node_id")).alias("node_id")).distinct()
    level = F.substring_index("node_id", ":", 1)
    return hi.graph_violations(ids.withColumn("level_name", level), links)


@query(
    "hi3_leaf_closure",
    "node_id leaf_id path_weight:f",
    """select ancestor as node_id, leaf as leaf_id, l.w / a.w as path_weight
       from h_leafpaths p join h_share a on a.node_id = p.ancestor join h_share l on l.node_id = p.leaf""",
)
def closure(s: Source):
    return hi.leaf_closure(*graph(s))


@query(
    "hi4_expand_leaves",
    "node_id target_date:d horizon:i prediction:f",
    "select node_id, target_date, horizon, prediction_p50 as prediction from h_bottom",
)
def expand(s: Source):
    leaf = s.rel("leaf_fc").withColumns(
        {
            "prediction": F.col("prediction_p50"),
            "prediction_id": F.concat_ws("-", F.col("store_nbr").cast("string"), F.col("target_date").cast("string")),
        }
    )
    return hi.expand_leaves(leaf, *graph(s), ["store_nbr"], GROUPS)


WEIGHTS_SQL = """
select parent_node_id, child_node_id, case when t = 0 then 1.0 / n else w / t end as weight
from (select *, sum(w) over (partition by parent_node_id) as t, count(*) over (partition by parent_node_id) as n
      from (select 'region:' || state as parent_node_id, 'store:' || store_nbr as child_node_id,
                   greatest(case when store_nbr % 9 = 0 then 1.0 else sales - 30.0 end, 0) as w
            from raw_stores join (select store_nbr, cast(max(sales) as double) as sales from store_day
                                  group by store_nbr) using (store_nbr)))"""


@query("hi5_child_weights", "parent_node_id child_node_id weight:f", WEIGHTS_SQL)
def weights(s: Source):
    top = s.rel("store_day").groupBy("store_nbr").agg(F.max("sales").alias("sales"))
    weight = F.when(F.col("store_nbr") % 9 == 0, F.lit(None)).otherwise(F.col("sales") - 30.0)
    links = s.rel("raw_stores").join(top, "store_nbr").select(
        F.concat(F.lit("region:"), "state").alias("parent_node_id"),
        F.concat(F.lit("store:"), F.col("store_nbr").cast("string")).alias("child_node_id"),
        weight.alias("allocation_weight"),
    )
    return hi.child_weights(links)


def reconciled(s: Source, method: str, **kw):
    # the stand-in for a stored table of base forecasts, read by checks and methods
    return hi.reconcile(stored(s.rel("node_fc")), *graph(s), method, GROUPS, VALUES, **kw)


@query("hi6_bottom_up", FC_SPEC, "select * from h_bottom")
def bottom_up(s: Source):
    return reconciled(s, "bottom_up")


@query(
    "hi7_top_down",
    FC_SPEC,
    f"""select w.node_id, f.target_date, f.horizon, {", ".join(f"f.{v} * w.w as {v}" for v in VALUES)}
        from node_fc f cross join h_share w where f.node_id = 'company:all'""",
)
def top_down(s: Source):
    return reconciled(s, "top_down")


MIRRORS["h_middle"] = f"""
select e.child_node_id as node_id, f.forecast_origin, f.target_date, f.horizon,
       {", ".join(f"f.{v} / c.n as {v}" for v in VALUES)}
from node_fc f join h_children c on c.parent_node_id = f.node_id
join h_edges e on e.parent_node_id = f.node_id where f.level_name = 'region'"""


@query(
    "hi8_middle_out",
    FC_SPEC,
    f"""select p.ancestor as node_id, target_date, horizon, {", ".join(f"sum({v}) as {v}" for v in VALUES)}
        from h_middle m join h_leafpaths p on p.leaf = m.node_id group by 1, 2, 3""",
)
def middle_out(s: Source):
    return reconciled(s, "middle_out", middle_level="region")


def _mint_sql() -> str:
    """Two passes over the three levels, written out."""
    sums = ", ".join(f"sum(f.{v}) as c_{v}" for v in VALUES)
    up = ", ".join(f"c_{v} + cv / (v.variance + cv) * (f.{v} - c_{v}) as {v}" for v in VALUES)
    keys = "f.target_date, f.horizon"
    region = f"""select f.node_id, {keys}, {up}, v.variance * cv / (v.variance + cv) as uv, cv, {", ".join(f"c_{v}" for v in VALUES)}
      from node_fc f join node_variance v using (node_id)
      join (select e.parent_node_id, {keys}, sum(v.variance) as cv, {sums} from node_fc f
            join node_variance v using (node_id) join h_edges e on e.child_node_id = f.node_id
            where f.level_name = 'store' group by 1, 2, 3) c
        on c.parent_node_id = f.node_id and c.target_date = f.target_date and c.horizon = f.horizon"""
    MIRRORS["h_region_up"] = region
    root = f"""select f.node_id, {keys}, {up}, cv, {", ".join(f"c_{v}" for v in VALUES)}
      from node_fc f join node_variance v using (node_id)
      join (select {keys}, sum(uv) as cv, {sums} from h_region_up f group by 1, 2) c
        on c.target_date = f.target_date and c.horizon = f.horizon
      where f.node_id = 'company:all'"""
    MIRRORS["h_root"] = root
    down = ", ".join(f"g.{v} + g.uv / r.cv * (r.{v} - r.c_{v}) as {v}" for v in VALUES)
    MIRRORS["h_region_new"] = f"""select g.node_id, g.target_date, g.horizon, g.cv, {down},
      {", ".join(f"g.c_{v}" for v in VALUES)}
      from h_region_up g join h_root r on r.target_date = g.target_date and r.horizon = g.horizon"""
    leaf = ", ".join(f"f.{v} + v.variance / g.cv * (g.{v} - g.c_{v}) as {v}" for v in VALUES)
    return f"""select node_id, target_date, horizon, {", ".join(VALUES)} from h_root
      union all select node_id, target_date, horizon, {", ".join(VALUES)} from h_region_new
      union all select f.node_id, f.target_date, f.horizon, {leaf}
      from node_fc f join node_variance v using (node_id) join h_edges e on e.child_node_id = f.node_id
      join h_region_new g on g.node_id = e.parent_node_id and g.target_date = f.target_date and g.horizon = f.horizon
      where f.level_name = 'store'"""


@query("hi9_mint", FC_SPEC, _mint_sql())
def mint(s: Source):
    return reconciled(s, "mint", variances=s.rel("node_variance"))


@query(
    "hi10_reconcile_with_base",
    f"{FC_SPEC} base_prediction_p50:f reconciliation_method",
    """select b.*, f.prediction_p50 as base_prediction_p50, 'bottom_up' as reconciliation_method
       from h_bottom b join node_fc f on f.node_id = b.node_id and f.target_date = b.target_date""",
)
def with_base(s: Source):
    return reconciled(s, "bottom_up")


COHERENCE_SQL = """select e.parent_node_id, f.target_date, max(p.prediction_p50) - sum(f.prediction_p50) as difference
  from node_fc f join h_edges e on e.child_node_id = f.node_id
  join node_fc p on p.node_id = e.parent_node_id and p.target_date = f.target_date
  group by 1, 2 having abs(max(p.prediction_p50) - sum(f.prediction_p50)) > 0.01"""


@query("hi11_coherence_violations", "parent_node_id target_date:d difference:f", COHERENCE_SQL)
def coherence(s: Source):
    return hi.coherence_violations(s.rel("node_fc"), graph(s)[1], GROUPS)


SPEC = HierarchySpec("demand", "v1", ("company", "region", "store"))


@query(
    "hi12_reconciliation_records",
    "node_id level_name target_date:d horizon:i base_prediction_p50:f prediction_p50:f hierarchy_name "
    "hierarchy_version reconciliation_method",
    """select b.*, f.level_name, f.prediction_p50 as base_prediction_p50, 'demand' as hierarchy_name,
              'v1' as hierarchy_version, 'bottom_up' as reconciliation_method
       from h_bottom b join node_fc f on f.node_id = b.node_id and f.target_date = b.target_date""",
)
def records(s: Source):
    at = F.lit(s.train_end).cast("timestamp")
    return hi.reconciliation_records(reconciled(s, "bottom_up"), SPEC, "run", at)[1]


@query(
    "hi13_hierarchy_report",
    "gate passed:b violation_count:i",
    f"""select 'Exactly one parent' as gate, true as passed, 0 as violation_count
        union all select 'Acyclic hierarchy', true, 0
        union all select 'Coherent child totals', count(*) = 0, count(*) from ({COHERENCE_SQL})
        union all select 'All quantiles reconciled', true, 0
        union all select 'Ordered quantiles', true, 0""",
)
def report(s: Source):
    return hi.hierarchy_report(*graph(s), s.rel("node_fc"))


@query(
    "hi13_hierarchy_node_values",
    "node_id level_name level_position:i parent_id base_p50:f reconciled_p50:f delta:f",
    """select n.node_id, n.level_name, n.level_position, e.parent_node_id as parent_id, v.base_p50, v.reconciled_p50,
              v.reconciled_p50 - v.base_p50 as delta
       from h_nodes n left join h_edges e on e.child_node_id = n.node_id
       left join (select b.node_id, avg(f.prediction_p50) as base_p50, avg(b.prediction_p50) as reconciled_p50
                  from h_bottom b join node_fc f on f.node_id = b.node_id and f.target_date = b.target_date
                  group by 1) v on v.node_id = n.node_id""",
)
def node_values(s: Source):
    return hi.hierarchy_nodes_report(*graph(s), reconciled(s, "bottom_up"))


MIRRORS["h_actual"] = """
select 'store:' || store_nbr as node_id, date as target_date, sales as actual from store_day
union all select 'region:' || region, date, sum(sales) from store_day group by region, date
union all select 'company:all', date, sum(sales) from store_day group by date"""


@query(
    "bt22_level_metrics",
    "level_name horizon:i metric_name base_metric_value:f reconciled_metric_value:f metric_delta:f observation_count:i",
    """select level_name, horizon, m.metric_name,
         case m.metric_name when 'mae' then avg(abs(actual - base)) else sum(abs(actual - base)) / sum(abs(actual)) end
           as base_metric_value,
         case m.metric_name when 'mae' then avg(abs(actual - new)) else sum(abs(actual - new)) / sum(abs(actual)) end
           as reconciled_metric_value,
         case m.metric_name when 'mae' then avg(abs(actual - new)) - avg(abs(actual - base))
           else sum(abs(actual - new)) / sum(abs(actual)) - sum(abs(actual - base)) / sum(abs(actual)) end
           as metric_delta, count(*) as observation_count
       from (select f.level_name, f.horizon, a.actual, f.prediction_p50 as base, b.prediction_p50 as new
             from node_fc f join h_bottom b on b.node_id = f.node_id and b.target_date = f.target_date
             join h_actual a on a.node_id = f.node_id and a.target_date = f.target_date)
       cross join (select unnest(['mae', 'wape']) as metric_name) m group by 1, 2, 3""",
)
def level_metrics(s: Source):
    day = s.rel("store_day")
    per = [
        day.select(F.concat(F.lit("store:"), F.col("store_nbr").cast("string")).alias("node_id"), "date", "sales"),
        day.select(F.concat(F.lit("region:"), "region").alias("node_id"), "date", "sales"),
        day.select(F.lit("company:all").alias("node_id"), "date", "sales"),
    ]
    actual = per[0].unionByName(per[1]).unionByName(per[2]).groupBy(
        "node_id", F.col("date").alias("target_date")
    ).agg(F.sum("sales").alias("actual"))
    return me.level_metrics(reconciled(s, "bottom_up").join(actual, ["node_id", "target_date"]))
