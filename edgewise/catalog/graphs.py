"""Edge tables derived from the driver tables, as DataFrames and as SQL.

Ids of several entity types share one graph, so each type takes one residue:
`k * id + r` stays unique at any scale, which an added offset would not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.catalog.registry import Tables
from edgewise.plans.skew import distinct_with_low

ORDER_SUPPLIER_SQL = "select 2*l_orderkey as src, 2*l_suppkey+1 as dst from lineitem"
CUSTOMER_NATION_SQL = "select 2*c_custkey as src, 2*c_nationkey+1 as dst from customer"
PLACES_SQL = """
  select 4*o_orderkey as src, 4*o_custkey+1 as dst from orders
  union all select 4*c_custkey+1, 4*c_nationkey+2 from customer"""
HIERARCHY_SQL = PLACES_SQL + """
  union all select cast(4*n_nationkey+2 as bigint), cast(4*n_regionkey+3 as bigint) from nation"""
NAMES_SQL = "select c_name as src, n_name as dst from customer join nation on c_nationkey = n_nationkey"
COPIES_SQL = """
  select doc_id as src, min(doc_id) over (partition by text) as dst from documents"""
FLOW_SQL = """
  select case when l_linestatus = 'O' then 2*l_partkey else 2*l_suppkey+1 end as src,
         case when l_linestatus = 'O' then 2*l_suppkey+1 else 2*l_partkey end as dst,
         l_quantity as weight
  from lineitem"""
TRADE_SQL = """
  select distinct src, dst from (
    select 3*o_custkey as src, 3*l_partkey+1 as dst from lineitem join orders on l_orderkey = o_orderkey
    union all select 3*l_partkey+1, 3*l_suppkey+2 from lineitem
    union all select 3*l_suppkey+2, 3*o_custkey from lineitem join orders on l_orderkey = o_orderkey)"""
PURCHASES_SQL = """
  select o_custkey as customer, l_suppkey as supplier
  from lineitem join orders on l_orderkey = o_orderkey group by o_custkey, l_suppkey"""


def order_supplier(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr("2*l_orderkey as src", "2*l_suppkey+1 as dst")


def customer_nation(t: Tables) -> DataFrame:
    return t.customer.selectExpr("2*c_custkey as src", "bigint(2*c_nationkey+1) as dst")


def places(t: Tables) -> DataFrame:
    """Order to customer to nation."""
    return t.orders.selectExpr("4*o_orderkey as src", "4*o_custkey+1 as dst").unionByName(
        t.customer.selectExpr("4*c_custkey+1 as src", "bigint(4*c_nationkey+2) as dst")
    )


def hierarchy(t: Tables) -> DataFrame:
    """`places`, and nation to region."""
    return places(t).unionByName(
        t.nation.selectExpr("bigint(4*n_nationkey+2) as src", "bigint(4*n_regionkey+3) as dst")
    )


def names(t: Tables) -> DataFrame:
    """Customer name to nation name, string ids."""
    return t.customer.join(t.nation, F.expr("c_nationkey = n_nationkey")).selectExpr(
        "c_name as src", "n_name as dst"
    )


def copies(t: Tables) -> DataFrame:
    """Each document to the smallest id with the same text: a star, not all pairs.

    Texts are compared by a 256-bit digest, so the shuffle moves 32 bytes and not
    the text.
    """
    rows = t.documents.selectExpr("unhex(sha2(text, 256)) as digest", "doc_id")
    return distinct_with_low(rows, ["digest"], "doc_id", t.documents.count()).selectExpr(
        "doc_id as src", "low as dst"
    )


def flow(t: Tables) -> DataFrame:
    """Open lines point from part to supplier, finished lines back; weight is the quantity."""
    return t.lineitem.selectExpr(
        "if(l_linestatus = 'O', 2*l_partkey, 2*l_suppkey+1) as src",
        "if(l_linestatus = 'O', 2*l_suppkey+1, 2*l_partkey) as dst",
        "l_quantity as weight",
    )


def trade(t: Tables) -> DataFrame:
    """Customer to part to supplier to customer, one edge each per distinct pair."""
    lines = t.lineitem.join(t.orders, F.expr("l_orderkey = o_orderkey")).select(
        F.explode(
            F.expr(
                """array(struct(3*o_custkey as src, 3*l_partkey+1 as dst),
                         struct(3*l_partkey+1 as src, 3*l_suppkey+2 as dst),
                         struct(3*l_suppkey+2 as src, 3*o_custkey as dst))"""
            )
        ).alias("e")
    )
    return lines.select("e.*").distinct()


def purchases(t: Tables) -> DataFrame:
    return (
        t.lineitem.join(t.orders, F.expr("l_orderkey = o_orderkey"))
        .selectExpr("o_custkey as customer", "l_suppkey as supplier")
        .distinct()
    )
