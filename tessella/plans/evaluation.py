"""Evaluation of the BM25 ranking against documents that hold the passage verbatim."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.plans.base import Tables, query
from tessella.plans.documents import grounding_verbatim  # noqa: F401
from tessella.plans.search import BM25_CTE, bm25

EVAL_CTE = f"""{BM25_CTE},
gold as (select item_id query, list(distinct doc_id) gold from benchmark, documents where length(benchmark.text) >= 15 and contains(documents.text, benchmark.text) group by item_id),
rk as (select query, list(doc order by rank) ranked from bm group by query),
e as (select b.item_id query, coalesce(ranked, []) ranked, coalesce(gold, []) gold from benchmark b left join rk on rk.query = b.item_id left join gold g on g.query = b.item_id)"""


def judged(t: Tables):
    """query, ranked (ten ids), gold (ids) of every item."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    items = t.benchmark.where(F.length("text") >= 15).select(F.col("item_id").alias("query"), F.col("text").alias("passage"), F.xxhash64(F.slice(words(F.col("text")), 2, 3)).alias("g"))
    from tessella.functions.text import let

    grams = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.slice(w, i + 1, 3))))
    docs = t.documents.select("doc_id", "text", F.explode(let(words(F.col("text")), grams)).alias("g"))
    gold = docs.join(items, "g").where(F.contains("text", F.col("passage"))).select("query", "doc_id").distinct().groupBy("query").agg(F.collect_list("doc_id").alias("gold"))
    ranked = bm25(t).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "doc"))).alias("r")).select("query", F.transform("r", lambda x: x["doc"]).alias("ranked"))  # ten a query
    none = F.expr("cast(array() as array<bigint>)")
    return t.benchmark.select(F.col("item_id").alias("query")).join(ranked, "query", "left").join(gold, "query", "left").select("query", F.coalesce("ranked", none).alias("ranked"), F.coalesce("gold", none).alias("gold"))


SQL_METRICS = """
round(case when len(gold) = 0 then 0 else len(list_intersect(gold, ranked[1:5])) / len(gold) end, 6) recall5, round(len(list_intersect(gold, ranked[1:5])) / 5.0, 6) precision5,
case when len(gold) > 0 and len(list_intersect(gold, ranked[1:10])) = len(gold) then 1.0 else 0.0 end complete10,
round(coalesce(1.0 / list_min(list_filter(list_transform(range(1, len(ranked) + 1), lambda i: case when list_contains(gold, ranked[i]) then i end), lambda i: i is not null)), 0), 6) mrr"""


@query(f"with {EVAL_CTE} select query, {SQL_METRICS} from e")
def ir_metrics(t: Tables):
    r, g = F.col("ranked"), F.col("gold")
    return judged(t).select("query", F.round(V.recall(r, g, 5), 6).alias("recall5"), F.round(V.precision(r, g, 5), 6).alias("precision5"), V.complete(r, g, 10).alias("complete10"), F.round(V.reciprocal_rank(r, g), 6).alias("mrr"))


@query(f"""with {EVAL_CTE} select query, round(case when len(gold) = 0 then 0 else coalesce(list_sum(list_transform(range(1, len(ranked) + 1), lambda i: case when list_contains(gold, ranked[i]) then 1 / log2(i + 1) else 0 end)), 0) / list_sum(list_transform(range(1, least(len(gold), 10) + 1), lambda i: 1 / log2(i + 1))) end, 6) ndcg10 from e""")
def ndcg(t: Tables):
    return judged(t).select("query", F.round(V.ndcg(F.col("ranked"), F.col("gold"), 10), 6).alias("ndcg10"))


@query(f"""with {EVAL_CTE}, m as (select query % 8 matter, avg(case when len(gold) > 0 and len(list_intersect(gold, ranked[1:10])) = len(gold) then 1.0 else 0.0 end) c from e group by 1) select round(avg(c), 6) macro, count(*) matters from m""")
def macro_complete(t: Tables):
    """Mean over matters of the mean over their questions."""
    m = judged(t).groupBy((F.col("query") % 8).alias("matter")).agg(F.avg(V.complete(F.col("ranked"), F.col("gold"), 10)).alias("c"))
    return m.agg(F.round(F.avg("c"), 6).alias("macro"), F.count("*").alias("matters"))


@query("""with s as (select source, count_if(quality = 1) k, count(quality) n from documents d left join labels l on l.doc_id = d.doc_id group by source)
select source, k, n, case when n > 0 then round((k / n::double + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((k / n::double) * (1 - k / n::double) / n + 1.96 * 1.96 / (4 * n::double * n))) / (1 + 1.96 * 1.96 / n), 6) end lo,
case when n > 0 then round((k / n::double + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt((k / n::double) * (1 - k / n::double) / n + 1.96 * 1.96 / (4 * n::double * n))) / (1 + 1.96 * 1.96 / n), 6) end hi from s""")
def wilson(t: Tables):
    s = t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("quality").alias("n"))
    lo, hi = V.wilson(F.col("k"), F.col("n"))
    return s.select("source", "k", "n", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("""with m as (select l_suppkey % 40 matter, avg(l_discount) v from lineitem group by 1), r as (select unnest(range(0, 2000)) rep), d as (select rep, ('0x' || substr(md5(rep || ':' || i), 1, 8))::bigint % 40 pick from r, (select unnest(range(0, 40)) i)),
b as (select rep, avg(v) mean from d join m on m.matter = d.pick group by rep) select round(quantile_cont(mean, 0.025), 6) lo, round((select avg(v) from m), 6) mean, round(quantile_cont(mean, 0.975), 6) hi from b""")
def bootstrap_ci(t: Tables):
    """Percentile interval over 2,000 replicates whose draws are hashes, so every run draws alike."""
    return _bootstrap(t, 2000)


def _bootstrap(t: Tables, replicates: int):
    m = t.lineitem.groupBy((F.col("l_suppkey") % 40).alias("matter")).agg(F.avg("l_discount").alias("v"))
    draws = t.spark.range(replicates * 40).select((F.col("id") / 40).cast("long").alias("rep"), (F.col("id") % 40).alias("i"))
    pick = F.conv(F.substring(F.md5(F.concat(F.col("rep").cast("string"), F.lit(":"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long") % 40
    means = draws.withColumn("matter", pick).join(m, "matter").groupBy("rep").agg(F.avg("v").alias("mean"))
    whole = m.agg(F.round(F.avg("v"), 6).alias("mean"))
    return means.agg(F.round(F.percentile("mean", 0.025), 6).alias("lo"), F.round(F.percentile("mean", 0.975), 6).alias("hi")).join(F.broadcast(whole), F.lit(True)).select("lo", "mean", "hi")  # one row
