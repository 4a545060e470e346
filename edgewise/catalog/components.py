"""Queries: loading edges and connected components."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgewise.catalog import graphs as G
from edgewise.catalog.registry import Tables, query
from edgewise.operators import components as C, edges as E
from edgewise.operators.property_graph import PropertyGraph
from edgewise.plans.scratch import Scratch
from edgewise.sources import edge_files as L


def labels_sql(edges: str, extra: str = "", type_: str = "bigint") -> str:
    """Smallest node per component, by propagation over `edges(src, dst)`."""
    return f"""
with recursive e as materialized (select distinct src, dst from ({edges})),
s as materialized (select src, dst from e union select dst, src from e),
cc(node, component) using key (node) as (
  select src, src from s group by src
  union
  select s.dst, min(c.component)
  from cc c join s on s.src = c.node join recurring.cc r on r.node = s.dst
  where c.component < r.component group by s.dst)
select * from (select node, component from cc {extra})"""


def scalar_sql(edges: str, select: str) -> str:
    return f"select {select} from ({labels_sql(edges)})"


@query("edges_load", "select l_orderkey as src, l_suppkey as dst from lineitem")
def edges_load(t: Tables):
    path = Scratch(t.spark, "edges").path()
    t.lineitem.selectExpr("l_orderkey as source", "l_suppkey as target").write.csv(
        path, header=True
    )
    return L.read_csv(t.spark, path)


@query(
    "edges_clean",
    "select l_orderkey as src, l_suppkey as dst from lineitem where l_linestatus = 'O'",
)
def edges_clean(t: Tables):
    path = Scratch(t.spark, "edges").path()
    # finished lines get a supplier id that is no number, and must drop out
    t.lineitem.selectExpr(
        "l_orderkey as a", "if(l_linestatus = 'O', '', 'x') || l_suppkey as b"
    ).write.csv(path, header=True)
    return L.read_tolerant(t.spark, path)


@query("edges_text", "select l_orderkey as src, l_suppkey as dst from lineitem")
def edges_text(t: Tables):
    path = Scratch(t.spark, "edges").path()
    t.lineitem.selectExpr("l_orderkey as source", "l_suppkey as target").write.csv(
        path, header=True
    )
    return L.read_lines(t.spark, path)


@query("edges_delim", "select c_name as src, n_name as dst from customer join nation on c_nationkey = n_nationkey")
def edges_delim(t: Tables):
    path = Scratch(t.spark, "edges").path()
    G.names(t).write.csv(path, sep=" ")
    return L.read_strings(t.spark, path)


@query(
    "edges_whitespace",
    """select least(o_orderkey, o_custkey) as src, greatest(o_orderkey, o_custkey) as dst
       from orders where o_orderstatus <> 'P'""",
)
def edges_whitespace(t: Tables):
    path = Scratch(t.spark, "edges").path()
    # orders in progress are written as comment lines
    t.orders.selectExpr(
        "if(o_orderstatus = 'P', '# ', '') || o_orderkey || '\\t ' || o_custkey as value"
    ).write.text(path)
    return L.read_whitespace(t.spark, path, canonical=True)


@query(
    "edges_canonical",
    f"select distinct least(src, dst) as src, greatest(src, dst) as dst from ({G.ORDER_SUPPLIER_SQL})",
)
def edges_canonical(t: Tables):
    return E.canonical(E.symmetric(G.order_supplier(t)))


@query(
    "edges_symmetric",
    f"select src, dst from ({G.ORDER_SUPPLIER_SQL}) union all select dst, src from ({G.ORDER_SUPPLIER_SQL})",
)
def edges_symmetric(t: Tables):
    return E.symmetric(G.order_supplier(t))


@query(
    "vertices",
    f"select src as node from ({G.ORDER_SUPPLIER_SQL}) union select dst from ({G.ORDER_SUPPLIER_SQL})",
)
def vertices(t: Tables):
    return E.vertices(G.order_supplier(t))


@query(
    "adjacency",
    f"""select node, string_agg(cast(other as varchar), ',' order by other) as neighbours from (
          select src as node, dst as other from ({G.ORDER_SUPPLIER_SQL})
          union select dst, src from ({G.ORDER_SUPPLIER_SQL})) group by node""",
)
def adjacency(t: Tables):
    return E.adjacency(G.order_supplier(t)).select(
        "node", F.array_join("neighbours", ",").alias("neighbours")
    )


@query(
    "graph_stats",
    f"""select (select count(*) from (select src from ({G.ORDER_SUPPLIER_SQL}) union select dst from ({G.ORDER_SUPPLIER_SQL}))) as n_nodes,
          count(*) as n_rows, count(*) as n_edges, count(distinct (src, dst)) as n_distinct_edges
        from ({G.ORDER_SUPPLIER_SQL})""",
)
def graph_stats(t: Tables):
    return E.stats(G.order_supplier(t))


@query("cc_star", labels_sql(G.ORDER_SUPPLIER_SQL))
def cc_star(t: Tables):
    return C.connected_components(G.order_supplier(t), "star").labels


@query("cc_rewrite", labels_sql(G.PLACES_SQL))
def cc_rewrite(t: Tables):
    return C.connected_components(G.places(t), "rewrite").labels


@query("cc_hooking", labels_sql(G.CUSTOMER_NATION_SQL))
def cc_hooking(t: Tables):
    return C.connected_components(G.customer_nation(t), "hooking").labels


@query("cc_minlabel", labels_sql(G.PLACES_SQL))
def cc_minlabel(t: Tables):
    return C.connected_components(G.places(t), "minlabel").labels


@query("cc_grid", labels_sql(G.PLACES_SQL))
def cc_grid(t: Tables):
    return C.connected_components(G.places(t), "minlabel", layout="2d").labels


@query("cc_selfmsg", labels_sql(G.ORDER_SUPPLIER_SQL))
def cc_selfmsg(t: Tables):
    return C.connected_components(G.order_supplier(t), "selfmsg").labels


@query("cc_checkpointed", labels_sql(G.COPIES_SQL))
def cc_checkpointed(t: Tables):
    return C.connected_components(G.copies(t), "selfmsg").labels


@query(
    "cc_graph_api",
    f"""select node, component from ({labels_sql(G.CUSTOMER_NATION_SQL)})
        union all select cast(2*n_nationkey+1 as bigint), cast(2*n_nationkey+1 as bigint) from nation
        where n_nationkey not in (select c_nationkey from customer)""",
)
def cc_graph_api(t: Tables):
    nodes = t.customer.selectExpr("2*c_custkey as id").unionByName(
        t.nation.selectExpr("bigint(2*n_nationkey+1) as id")
    )
    return PropertyGraph(nodes, G.customer_nation(t)).connected_components().labels


@query("cc_string_ids", labels_sql(G.NAMES_SQL))
def cc_string_ids(t: Tables):
    return C.connected_components(G.names(t), "minlabel").labels


_SEGMENT_LABELS = """
  with e as (select c_mktsegment as graph, 2*c_custkey as c, cast(2*c_nationkey+1 as bigint) as n from customer),
  low as (select graph, n, least(min(c), n) as component from e group by graph, n)
  select graph, c as node, component from e join low using (graph, n)
  union select graph, n, component from low"""


def _segments(t: Tables):
    return t.customer.selectExpr(
        "c_mktsegment as graph", "2*c_custkey as src", "bigint(2*c_nationkey+1) as dst"
    )


@query("cc_multi_graph", _SEGMENT_LABELS)
def cc_multi_graph(t: Tables):
    return C.connected_components(_segments(t), "star", by=["graph"]).labels


@query(
    "cc_summary",
    f"""select graph, n_nodes, n_edges, n_components, true as ran, true as converged from
        (select graph, count(*) as n_nodes, count(*) filter (where node = component) as n_components
         from ({_SEGMENT_LABELS}) group by graph)
        join (select c_mktsegment as graph, count(*) as n_edges from customer group by 1) using (graph)""",
)
def cc_summary(t: Tables):
    # the rounds depend on the algorithm; that there were some does not
    return C.summary(_segments(t), by=["graph"]).select(
        "graph", "n_nodes", "n_edges", "n_components", F.expr("iterations > 0").alias("ran"), "converged"
    )


@query("cc_listing", labels_sql(G.CUSTOMER_NATION_SQL))
def cc_listing(t: Tables):
    return C.listing(C.connected_components(G.customer_nation(t)).labels)


@query(
    "label_changes",
    f"""select count(*) as n_changed from (
          select node, min(other) as low from (
            select src as node, dst as other from ({G.ORDER_SUPPLIER_SQL})
            union all select dst, src from ({G.ORDER_SUPPLIER_SQL})) group by node) where low < node""",
)
def label_changes(t: Tables):
    edges = G.order_supplier(t)
    start = E.vertices(edges).selectExpr("node", "node as component")
    once = C.connected_components(edges, "minlabel", max_iters=1).labels
    return C.label_changes(start, once)


@query(
    "cc_named",
    f"""select c_name as name, component from customer
        join ({labels_sql(G.PLACES_SQL)}) on node = 4*c_custkey+1""",
)
def cc_named(t: Tables):
    names = t.customer.selectExpr("4*c_custkey+1 as node", "c_name as name")
    labels = C.connected_components(G.places(t)).labels
    return C.named(labels, names).select("name", "component")


@query("cc_count", scalar_sql(G.COPIES_SQL, "count(distinct component) as n_components"))
def cc_count(t: Tables):
    return C.component_count(C.connected_components(G.copies(t)).labels)
