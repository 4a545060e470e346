"""Queries: PageRank, paths, triangles and property-graph jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgewise.catalog import graphs as G
from edgewise.catalog.registry import Tables, query
from edgewise.operators import components as C, edges as E, paths, rank, triangles
from edgewise.operators.property_graph import PropertyGraph

ROUNDS = 5


def pagerank_sql(edges: str, rounds: int, keep_all: bool) -> str:
    """Fixed rounds, one common table expression per round."""
    first = (
        "select src as node from e union select dst from e" if keep_all else "select distinct src as node from e"
    )
    parts = [
        f"e as materialized (select distinct src, dst from ({edges}))",
        "d as materialized (select src as node, count(*) as n from e group by src)",
        f"r0 as (select node, 1.0::double as rank from ({first}))",
    ]
    for i in range(1, rounds + 1):
        gain = f"""select e.dst as node, 0.15 + 0.85 * sum(r.rank / d.n) as rank
                   from r{i-1} r join d on d.node = r.node join e on e.src = r.node group by e.dst"""
        if keep_all:
            gain = f"select r0.node, coalesce(g.rank, 0.15) as rank from r0 left join ({gain}) g on g.node = r0.node"
        parts.append(f"r{i} as materialized ({gain})")
    return f"with {', '.join(parts)} select node, rank from r{rounds}"


_TOL = 0.001
PAGERANK_TOL_SQL = f"""
with recursive e as materialized (select src, dst from ({G.TRADE_SQL}) union select dst, src from ({G.TRADE_SQL})),
d as materialized (select src as node, count(*) as n from e group by src),
nodes as materialized (select src as node from e union select dst from e),
r(node, rank, moved, i) as (
  select node, 1.0::double, 1e9::double, 0 from nodes
  union all
  select node, rank, max(abs(rank - was)) over (), i from (
    select p.node, 0.15 + 0.85 * coalesce(g.gain, 0) as rank, p.rank as was, p.i + 1 as i
    from r p left join (
      select e.dst as node, sum(q.rank / d.n) as gain
      from r q join d on d.node = q.node join e on e.src = q.node group by e.dst) g on g.node = p.node
    where p.moved >= {_TOL} and p.i < 100))
select node, round(rank, 6) as rank from r where i = (select max(i) from r)"""


@query(
    "pagerank_iter",
    f"select node, round(rank, 6) as rank from ({pagerank_sql(G.FLOW_SQL, ROUNDS, False)})",
)
def pagerank_iter(t: Tables):
    ranks = rank.pagerank(G.flow(t).select("src", "dst"), ROUNDS, keep_all=False).state
    return ranks.select("node", F.round("rank", 6).alias("rank"))


@query(
    "pagerank_grid",
    f"select node, round(rank, 6) as rank from ({pagerank_sql(G.FLOW_SQL, ROUNDS, True)})",
)
def pagerank_grid(t: Tables):
    """The edges lie in a grid of cells; a rank goes to the cells that hold an edge of its node."""
    ranks = rank.pagerank(G.flow(t).select("src", "dst"), ROUNDS, layout="2d").state
    return ranks.select("node", F.round("rank", 6).alias("rank"))


@query("pagerank_tol", PAGERANK_TOL_SQL)
def pagerank_tol(t: Tables):
    ranks = rank.pagerank(E.symmetric(G.trade(t)), rounds=None, tol=_TOL).state
    return ranks.select("node", F.round("rank", 6).alias("rank"))


@query(
    "pagerank_total",
    f"select round(sum(rank), 4) as total_rank from ({pagerank_sql(G.FLOW_SQL, ROUNDS, True)})",
)
def pagerank_total(t: Tables):
    ranks = rank.pagerank(G.flow(t).select("src", "dst"), ROUNDS).state
    return rank.total_rank(ranks).select(F.round("total_rank", 4).alias("total_rank"))


@query(
    "topk_rank",
    f"""select node, round(rank, 6) as rank from ({pagerank_sql(G.FLOW_SQL, ROUNDS, True)})
        order by rank desc, node limit 5""",
)
def topk_rank(t: Tables):
    ranks = rank.pagerank(G.flow(t).select("src", "dst"), ROUNDS).state
    return rank.top(ranks, 5).select("node", F.round("rank", 6).alias("rank"))


_TRIANGLES_SQL = f"""
with e as materialized (
  select distinct least(src, dst) as a, greatest(src, dst) as b from ({G.TRADE_SQL})),
t as materialized (
  select x.a as u, x.b as v, y.b as w from e x join e y on y.a = x.b join e z on z.a = x.a and z.b = y.b)"""


@query(
    "triangles_vertex",
    _TRIANGLES_SQL
    + """, c as (select node, count(*) as n from (
           select u as node from t union all select v from t union all select w from t) group by node)
       select n.node, coalesce(c.n, 0) as n_triangles
       from (select a as node from e union select b from e) n left join c on c.node = n.node""",
)
def triangles_vertex(t: Tables):
    return triangles.triangles_per_vertex(G.trade(t))


@query("triangles_total", _TRIANGLES_SQL + " select count(*) as n_triangles from t")
def triangles_total(t: Tables):
    return triangles.triangles_total(G.trade(t))


@query(
    "sssp",
    f"""with recursive e as materialized (
          select src, dst, min(weight) as weight from ({G.FLOW_SQL}) group by src, dst),
        sp(node, distance) using key (node) as (
          select node, case when node = 0 then 0.0::double else 'infinity'::double end
          from (select src as node from e union select dst from e)
          union
          select e.dst, min(p.distance + e.weight)
          from sp p join e on e.src = p.node join recurring.sp r on r.node = e.dst
          where p.distance < 'infinity'::double and p.distance + e.weight < r.distance group by e.dst)
        select node, distance from sp""",
)
def sssp(t: Tables):
    source = t.part.where("p_partkey = 0").selectExpr("2*p_partkey as node")
    return paths.shortest_paths(G.flow(t), source).state


@query(
    "transitive_closure",
    f"""with recursive e as materialized (select distinct src, dst from ({G.HIERARCHY_SQL})),
        tc as (select src, dst from e union select tc.src, e.dst from tc join e on e.src = tc.dst)
        select src, dst from tc""",
)
def transitive_closure(t: Tables):
    return paths.transitive_closure(G.hierarchy(t)).state


def _buyers(t: Tables) -> PropertyGraph:
    """Customers and suppliers with their balance; an edge per pair that traded."""
    vertices = t.customer.selectExpr("2*c_custkey as id", "c_acctbal as balance").unionByName(
        t.supplier.selectExpr("2*s_suppkey+1 as id", "s_acctbal as balance")
    )
    edges = G.purchases(t).selectExpr("2*customer as src", "2*supplier+1 as dst")
    return PropertyGraph(vertices, edges)


@query(
    "aggregate_messages",
    f"""select 2*supplier+1 as id, count(*) as n, cast(sum(cast(c_acctbal as decimal(18,2))) as double) / count(*) as mean_balance
        from ({G.PURCHASES_SQL}) join customer on c_custkey = customer
        join supplier on s_suppkey = supplier where c_acctbal > s_acctbal group by supplier""",
)
def aggregate_messages(t: Tables):
    return _buyers(t).aggregate_messages(
        F.col("source.balance") > F.col("target.balance"),
        {"one": F.lit(1), "balance": F.col("source.balance")},
        [
            F.sum("one").alias("n"),
            # exact cents, so the mean does not depend on the order of addition
            F.expr("double(sum(cast(balance as decimal(18,2)))) / count(1)").alias("mean_balance"),
        ],
    )


@query(
    "vertices_outer_join",
    """select c_custkey as id, c_name as name, coalesce(n, 0) as n_orders
       from customer left join (select o_custkey, count(*) as n from orders group by o_custkey)
       on o_custkey = c_custkey""",
)
def vertices_outer_join(t: Tables):
    people = t.customer.selectExpr("c_custkey as id", "c_name as name")
    edges = t.orders.selectExpr("o_custkey as src", "o_orderkey as dst")
    counts = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_orders"))
    return PropertyGraph(people, edges).join_vertices(counts, {"n_orders": 0}).vertices


@query(
    "subgraph",
    f"""select 2*customer as src, 2*supplier+1 as dst from ({G.PURCHASES_SQL})
        join customer on c_custkey = customer join supplier on s_suppkey = supplier
        where c_acctbal > 1000 and s_acctbal > 1000""",
)
def subgraph(t: Tables):
    return _buyers(t).subgraph(F.col("balance") > 1000).edges


@query(
    "degree_hist",
    f"""with e as (select distinct least(src, dst) as a, greatest(src, dst) as b from ({G.FLOW_SQL})),
        d as (select node, count(*) as n from (select a as node from e union all select b from e) group by node),
        v as (select 2*p_partkey as node from part union all select 2*s_suppkey+1 from supplier)
        select coalesce(n, 0) as degree, count(*) as n_nodes from v left join d using (node) group by 1""",
)
def degree_hist(t: Tables):
    nodes = t.part.selectExpr("2*p_partkey as node").unionByName(
        t.supplier.selectExpr("2*s_suppkey+1 as node")
    )
    return E.degree_histogram(G.flow(t).select("src", "dst"), nodes)


#: Lines of a task of the power iteration; fewer in all stay in the tasks of their grouping.
PAIR_ROWS = 500_000


def _by_source(pairs, total: int):
    """`pairs`, of `total` at most, with those of a node in one task, and no task of many.

    The planner puts small tasks together, by their bytes in files, to a few. The power iteration keeps
    these as its own and unpacks them, and sends each node's value to all tasks where it has a pair.
    """
    if total <= PAIR_ROWS:
        return pairs
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    return pairs.repartition(max(cores, -(-total // PAIR_ROWS)), "src")


@query("pic")
def pic(t: Tables):
    from pyspark.ml.clustering import PowerIterationClustering

    weighted = t.lineitem.groupBy(
        F.expr("2*l_partkey").alias("src"), F.expr("2*l_suppkey+1").alias("dst")
    ).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    job = PowerIterationClustering(k=3, maxIter=20, initMode="degree", weightCol="weight")
    return job.assignClusters(_by_source(weighted, t.lineitem.count())).selectExpr("id as node", "cluster")
