"""Graph queries over customers, orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import graph as G
from tessella.plans.base import Tables, query
from tessella.plans.search import BM25_CTE, bm25


def _edges(t: Tables):
    """Customers and nations: a bipartite graph with weights."""
    return t.customer.select(F.col("c_custkey").alias("src"), (-1 - F.col("c_nationkey").cast("long")).alias("dst"), (1.0 + F.col("c_custkey") % 3).alias("weight"))


PPR = """with recursive e as (select c_custkey src, -1 - c_nationkey::bigint dst, 1.0::double + c_custkey % 3 w from customer union all select -1 - c_nationkey::bigint, c_custkey, 1.0::double + c_custkey % 3 from customer),
m as (select src, dst, w / sum(w) over (partition by src) p from e), s as (select c_custkey node, 1.0::double / (select count(*) from customer where c_custkey % 50 = 0) e from customer where c_custkey % 50 = 0),
r0 as (select node, e score from s)"""
for _k in range(1, 13):
    PPR += f""", r{_k} as (select coalesce(f.node, s.node) node, 0.5 * coalesce(i, 0) + 0.5 * coalesce(e, 0) score from (select dst node, sum(score * p) i from r{_k - 1} join m on src = node group by dst) f full join s on s.node = f.node)"""


@query(PPR + " select node, round(score, 8) score from r12 where score > 0.000001")
def ppr_expand(t: Tables):
    return _expanded(t, 12)


def _expanded(t: Tables, rounds: int):
    e = G.symmetric(_edges(t))
    seeds = t.customer.where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("node"))
    return G.personalized(e, seeds, rounds=rounds).where("score > 0.000001").select("node", F.round("score", 8).alias("score"))


@query("select count(*) n_edges, count(distinct src) n_nodes, max(deg) top from (select src, dst, count(*) over (partition by src) deg from (select c_custkey src, -1 - c_nationkey dst from customer union select -1 - c_nationkey, c_custkey from customer))")
def graph_stats(t: Tables):
    per = G.symmetric(_edges(t)).groupBy("src").agg(F.count("*").alias("deg"))
    return per.agg(F.sum("deg").alias("n_edges"), F.count("*").alias("n_nodes"), F.max("deg").alias("top"))


@query("""with m as (select distinct l_partkey k, l_suppkey node from lineitem), s as (select k, count(*) n, min(node) src from m group by k having count(*) > 1)
select src, node dst, round(sum(1 / log2(1.0::double + n)), 4) weight from m join s using (k) where node <> src group by all""")
def fanout_edges(t: Tables):
    """Suppliers bridged by parts, discounted by the part's fan-out."""
    return G.bridges(t.lineitem.select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("node")), "k", "node").select("src", "dst", F.round("weight", 4).alias("weight"))


@query("""select src, dst, count(*) kinds from (select distinct o_custkey src, l_suppkey dst, l_returnflag kind from orders join lineitem on l_orderkey = o_orderkey where l_returnflag <> 'N') group by all""")
def typed_edges(t: Tables):
    """Directed typed edges, one of each kind, without an excluded relation."""
    e = t.orders.join(t.lineitem.where("l_returnflag <> 'N'"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("kind")).distinct()
    return e.groupBy("src", "dst").agg(F.count("*").alias("kinds"))


@query("""select distinct l2.l_suppkey hop from lineitem l1 join lineitem l2 on l1.l_orderkey = l2.l_orderkey where l1.l_suppkey = 7 and l2.l_suppkey <> 7""")
def one_hop(t: Tables):
    a = t.lineitem.where("l_suppkey = 7").select("l_orderkey").distinct()
    return t.lineitem.join(a, "l_orderkey", "left_semi").where("l_suppkey <> 7").select(F.col("l_suppkey").alias("hop")).distinct()


BUNDLE = f"""with {BM25_CTE}, f as (select query, doc, score from bm where rank <= 5), e as (select distinct a.doc_id src, a.doc_id + 1 dst from documents a where a.doc_id % 3 > 0),
r as (select query, dst doc, 0.15::double * sum(score) gain from f join e on f.doc = src group by all)
select coalesce(f.query, r.query) query, coalesce(f.doc, r.doc) doc, round(coalesce(score, gain) + case when score is not null and gain is not null then 0.05 else 0 end, 6) score from f full join r on f.query = r.query and f.doc = r.doc"""


@query(BUNDLE)
def bundle_expand(t: Tables):
    """Seeds and what their edges lead to; here an edge goes from a document to the next."""
    edges = t.documents.where("doc_id % 3 > 0").select(F.col("doc_id").alias("src"), (F.col("doc_id") + 1).alias("dst"))
    return G.bundle(bm25(t), edges, seeds=5)


@query()
def pagerank_converged(t: Tables):
    """Personalized PageRank to convergence over the customer graph; tests hold it against a power iteration."""
    seeds = t.customer.where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("node"))
    return G.converged(G.symmetric(_edges(t)), seeds).select("node", F.round("score", 6).alias("score"))
