"""Catalogue queries: ids, filters, lookups, merged result lists, verdicts, queues, normalisers, retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import catalog as C
from tessella.plans.base import Tables, query


@query("select o_orderkey, o_orderstatus, o_orderpriority from orders where lower(o_orderstatus) = 'f' and lower(o_orderpriority) = '1-urgent' order by o_orderkey limit 50")
def filtered_links(t: Tables):
    """Optional filters whatever the case (a third one isn't given), in the order of the file, cut to 50 (the feature)."""
    return C.optional_filter(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderkey"], 50, o_orderstatus="f", o_orderpriority="1-URGENT", o_orderkey=None)


@query("""with q as (select 'id:' || doc_id query, ' ' || doc_id || ' ' text from documents where doc_id % 100 = 0 union all select 'text:' || item_id, text from benchmark union all select 'blank', '   ')
select query, doc_id doc, 0 rank from q join documents on trim(q.text) = doc_id::varchar""")
def direct_lookup(t: Tables):
    """Queries that are an id rank its row first; blank ones find nothing."""
    d, blank = t.documents, t.spark.range(1).select(F.lit("blank").alias("query"), F.lit("   ").alias("text"))
    q = d.where("doc_id % 100 = 0").select(F.concat(F.lit("id:"), "doc_id").alias("query"), F.concat(F.lit(" "), "doc_id", F.lit(" ")).alias("text"))
    q = q.unionByName(t.benchmark.select(F.concat(F.lit("text:"), "item_id").alias("query"), "text")).unionByName(blank)
    return C.direct(q, d.select(F.col("doc_id").alias("doc")))


@query("""select doc_id, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 hits, lang from documents where lang in ('en', 'fr') and source = (select min(source) from documents) and contains(lower(text), 'the')""")
def facet_search(t: Tables):
    """Facets (a set of languages, one source) before anything is scored."""
    d, low = t.documents, F.lower("text")
    first = d.agg(F.min("source").alias("source"))
    hit = d.where(F.col("lang").isin("en", "fr")).join(F.broadcast(first), "source", "left_semi").where(F.contains(low, F.lit("the")))  # first: one row
    return hit.select("doc_id", F.expr("(length(lower(text)) - length(replace(lower(text), 'the', ''))) div 3").alias("hits"), "lang")


@query("""with o as (select o_custkey, string_agg(o_orderpriority, '; ' order by o_orderpriority) priorities, count(*) n from (select distinct o_custkey, o_orderpriority from orders) group by 1)
select c_custkey, coalesce(priorities, '') priorities, coalesce(n, 0) n, case when c_mktsegment = 'BUILDING' then c_name end title from customer left join o on o_custkey = c_custkey""")
def nested_to_flat(t: Tables):
    nested = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    rows = t.customer.join(nested, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("p", F.coalesce("p", F.expr(T.EMPTY_STRINGS)))
    return rows.select("c_custkey", F.array_join("p", "; ").alias("priorities"), F.size("p").cast("long").alias("n"), F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).alias("title"))


@query("""with r as (select p_partkey, case when p_size % 5 > 0 then 'SRC' || lpad(p_partkey::varchar, 3, '0') end s, case when p_size % 7 > 0 then p_size::varchar || case when p_size % 2 = 0 then 'a' else '' end end n from part)
select p_partkey, case when s is not null and n is not null then s || ':s' || n else '' end id, case when s is not null and n is not null then upper(n) else '' end tail,
  nullif(regexp_extract(coalesce(s, 'junk') || '-s' || coalesce(n, ''), '^(SRC[0-9]+)-s(\\w+)$', 1), '') source, nullif(regexp_extract(coalesce(s, 'junk') || '-s' || coalesce(n, ''), '^(SRC[0-9]+)-s(\\w+)$', 2), '') number, split_part(coalesce(s, '') || '#k', '#', 1) parent from r""")
def composite_ids(t: Tables):
    """Ids built only from both parts, taken apart again, without their chunk, and their tails."""
    s = F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("SRC"), F.when(F.length(F.col("p_partkey").cast("string")) < 3, F.lpad(F.col("p_partkey").cast("string"), 3, "0")).otherwise(F.substring(F.col("p_partkey").cast("string"), 1, 3))))
    n = F.when(F.col("p_size") % 7 > 0, F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "a").otherwise("")))
    rows = t.part.select("p_partkey", "p_size", s.alias("s"), n.alias("n"))
    made = C.composite_id(F.col("s"), F.col("n"))
    parsed = C.parsed_id(F.concat(F.coalesce("s", F.lit("junk")), F.lit("-s"), F.coalesce("n", F.lit(""))))
    return rows.select("p_partkey", made.alias("id"), F.when(made == "", "").otherwise(C.id_tail(made)).alias("tail"), parsed["source"].alias("source"), parsed["number"].alias("number"), C.chunk_parent(F.concat(F.coalesce("s", F.lit("")), F.lit("#k"))).alias("parent"))


@query("select verdict, count(*) n, sum(o_orderkey) total from (select o_orderkey, case when o_orderstatus = 'F' and o_totalprice > 50000 then 'keep' when o_orderstatus = 'O' then 'drop' else 'unresolved' end verdict from orders) group by verdict")
def three_way_split(t: Tables):
    verdict = F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 50000), "keep").when(F.col("o_orderstatus") == "O", "drop").otherwise("unresolved")
    return t.orders.withColumn("verdict", verdict).groupBy("verdict").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))


@query("select p_partkey from part where contains(lower(p_name || ' ' || p_type), 'ring') and contains(lower(p_name || ' ' || p_type), 'economy')")
def conjunctive_search(t: Tables):
    words = F.array(F.lit("ring"), F.lit("economy"))
    return t.part.where(F.forall(words, lambda w: F.contains(F.lower(F.concat_ws(" ", "p_name", "p_type")), w))).select("p_partkey")


@query("select p_partkey from part where starts_with(lower(p_type), 'econ') or contains(lower(p_name), 'ring') or contains(lower(p_brand), '#3')")
def prefix_or_contains(t: Tables):
    return t.part.where(F.startswith(F.lower("p_type"), F.lit("econ")) | F.contains(F.lower("p_name"), F.lit("ring")) | F.contains(F.lower("p_brand"), F.lit("#3"))).select("p_partkey")


@query("select p_partkey, p_retailprice score, p_size >= 40 large, round(p_retailprice, 0) % 2 = 0 even from part")
def renamed_score(t: Tables):
    """The first score column that is there, under one name, and threshold flags."""
    name = C.pick(t.part, ("score", "similarity", "p_retailprice", "p_size"))
    return t.part.withColumnRenamed(name, "score").select("p_partkey", "score", (F.col("p_size") >= 40).alias("large"), (F.round("score", 0) % 2 == 0).alias("even"))


@query("""with r as (select l_orderkey, string_agg(l_linenumber::varchar || case when l_linenumber = 3 then ':NOT_FOUND' else '' end, ';' order by l_linenumber) cell from (select distinct l_orderkey, l_linenumber from lineitem) group by 1),
x as (select l_orderkey, cell, list_filter(string_split(cell, ';'), lambda v: v <> '' and not ends_with(v, ':NOT_FOUND')) e from r)
select l_orderkey, len(e) n_expected, coalesce(list_aggregate(list_sort(list_transform(regexp_split_to_array(cell, '[;\\s]+'), lambda v: lpad(v, 2, '0'))), 'string_agg', ','), '') ids from x""")
def multi_id_cells(t: Tables):
    """Cells of several ids: as an expected set, and each id padded."""
    part = F.concat(F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") == 3, ":NOT_FOUND").otherwise(""))
    cells = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(part)), ";").alias("cell"))
    padded = F.transform(F.split("cell", r"[;\s]+"), lambda v: F.when(F.length(v) < 2, F.lpad(v, 2, "0")).otherwise(F.substring(v, 1, 2)))
    return cells.select("l_orderkey", F.size(C.expected_ids(F.col("cell"))).cast("long").alias("n_expected"), F.array_join(F.array_sort(padded), ",").alias("ids"))


@query("""with o as (select o_custkey k, count(*) n_orders from orders group by 1), st as (select o_custkey k, string_agg(o_orderstatus, ';' order by o_orderstatus) statuses from (select distinct o_custkey, o_orderstatus from orders) group by 1),
f as (select o_custkey k, string_agg(l_returnflag, ';' order by l_returnflag) flags from (select distinct o_custkey, l_returnflag from orders join lineitem on l_orderkey = o_orderkey) group by 1)
select c_custkey, n_name, coalesce(n_orders, 0) n_orders, coalesce(statuses, '') statuses, coalesce(flags, '') flags from customer left join nation on n_nationkey = c_nationkey left join o on o.k = c_custkey left join st on st.k = c_custkey left join f on f.k = c_custkey""")
def nested_lists_join(t: Tables):
    """Each side is aggregated before the joins, so nothing multiplies."""
    o = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_orders"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ";").alias("statuses"))
    f = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("k")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ";").alias("flags"))
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").withColumn("k", F.col("c_custkey")).join(o, "k", "left").join(f, "k", "left")
    return rows.select("c_custkey", "n_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("statuses", "flags")])


@query("select o_orderkey, c_name from orders left join customer on 'commonlii-' || o_custkey = 'commonlii-' || c_custkey and o_custkey % 2 = 0")
def key_rewriting_join(t: Tables):
    """Keys of one side get the prefix of the other's before they meet."""
    a = t.orders.select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("commonlii-"), F.col("o_custkey").cast("string"))).alias("k"))
    return a.join(t.customer.select("c_name", F.concat(F.lit("commonlii-"), F.col("c_custkey").cast("string")).alias("k")), "k", "left").select("o_orderkey", "c_name")


@query("""select reason, count(*) n from (select case when o_orderkey is null then 'no-order' when p_partkey is null then 'no-part' when p_size > 45 then 'too-large' when o_orderstatus = 'P' then 'pending' when l_quantity < 5 then 'too-few' when l_shipdate < o_orderdate then 'before-order' end reason
from lineitem left join (select * from orders where o_orderkey % 11 > 0) on o_orderkey = l_orderkey left join (select * from part where p_partkey % 13 > 0) on p_partkey = l_partkey) group by reason""")
def reject_reasons(t: Tables):
    """Three tables joined, with the first of six reasons against a row; null rows are the gold."""
    j = t.lineitem.join(t.orders.where("o_orderkey % 11 > 0"), F.col("l_orderkey") == F.col("o_orderkey"), "left").join(t.part.where("p_partkey % 13 > 0"), F.col("l_partkey") == F.col("p_partkey"), "left")
    reasons = [("no-order", F.col("o_orderkey").isNull()), ("no-part", F.col("p_partkey").isNull()), ("too-large", F.col("p_size") > 45), ("pending", F.col("o_orderstatus") == "P"), ("too-few", F.col("l_quantity") < 5), ("before-order", F.col("l_shipdate") < F.col("o_orderdate"))]
    return C.rejected(j, reasons).groupBy("reason").agg(F.count("*").alias("n"))


@query("""with nodes as (select lower(p_name) k, min(p_partkey) node from part group by 1), refs as (select event_id, case when event_id % 4 = 0 then 'no such title' else (select lower(p_name) from part where p_partkey = event_id % 50) end k from events)
select case when node is null then 'unresolved' else 'DOC:' || node end target, count(*) n from refs left join nodes using (k) group by 1""")
def reference_join(t: Tables):
    """References by title become nodes; the unresolved are counted."""
    nodes = t.part.groupBy(F.lower("p_name").alias("k")).agg(F.min("p_partkey").alias("node"))
    refs = t.events.select("event_id", F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 50).alias("p_partkey")).join(t.part.select("p_partkey", F.lower("p_name").alias("k")), "p_partkey", "left")
    target = F.when(F.col("node").isNull(), "unresolved").otherwise(F.concat(F.lit("DOC:"), F.col("node").cast("string")))
    return refs.join(nodes, "k", "left").groupBy(target.alias("target")).agg(F.count("*").alias("n"))


@query("""with gold as (select distinct l_orderkey doc, l_linenumber page from lineitem where l_returnflag = 'R'), got as (select l_orderkey doc, l_linenumber page from lineitem where l_quantity > 25)
select doc, count(*) n_gold, count_if((doc, page) in (select (doc, page) from got)) n_found from gold group by doc""")
def evidence_match(t: Tables):
    """(document, page) pairs of the gold that were retrieved; the first match counts, however often it came."""
    page = lambda df: df.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")).distinct()
    gold, got = page(t.lineitem.where("l_returnflag = 'R'")), page(t.lineitem.where("l_quantity > 25")).withColumn("hit", F.lit(1))
    return gold.join(got, ["doc", "page"], "left").groupBy("doc").agg(F.count("*").alias("n_gold"), F.count("hit").alias("n_found"))


@query("""select conv_id, turn, case when page_id is null then null else regexp_matches(html, '(^|[^0-9])' || turn || '([^0-9]|$)') end stands from conversations left join pages on page_id = conv_id % 400""")
def stands_in_text(t: Tables):
    """Whether a number stands in the text of its document; null without a text."""
    rows = t.conversations.select("conv_id", "turn", (F.col("conv_id") % 400).alias("page_id")).join(t.pages.select("page_id", "html"), "page_id", "left")
    return rows.select("conv_id", "turn", F.regexp_like("html", F.concat(F.lit("(^|[^0-9])"), F.col("turn").cast("string"), F.lit("([^0-9]|$)"))).alias("stands"))


@query("""with e as (select distinct o_custkey q, o_orderkey % 40 id from orders) select q, count(*) n from e group by q having count_if(id not in (select p_size - 1 from part)) = 0""")
def scope_filter(t: Tables):
    """Questions all of whose expected ids are in the corpus."""
    e = t.orders.select(F.col("o_custkey").alias("q"), (F.col("o_orderkey") % 40).alias("id")).distinct()
    scope = t.part.select((F.col("p_size") - 1).cast("long").alias("id"), F.lit(1).alias("known")).distinct()
    return e.join(scope, "id", "left").groupBy("q").agg(F.count("*").alias("n"), F.count("known").alias("known")).where("n = known").select("q", "n")


@query("""select a.quality = b.toxic agree, count(*) n from labels a join labels b using (doc_id) group by 1""")
def model_agreement(t: Tables):
    """Two raters' verdicts on the same ids."""
    a, b = t.labels.select("doc_id", "quality"), t.labels.select("doc_id", "toxic")
    return a.join(b, "doc_id").groupBy((F.col("quality") == F.col("toxic")).alias("agree")).agg(F.count("*").alias("n"))


@query("""with v as (select user_id k, event_type verdict, row_number() over (partition by user_id order by event_id desc) r from events where event_id % 3 = 0)
select coalesce(verdict, 'pending') verdict, count(*) n from customer left join (select * from v where r = 1) on k = c_custkey group by 1""")
def verdict_merge(t: Tables):
    """The last verdict of an id wins; rows without one are pending."""
    v = t.events.where("event_id % 3 = 0").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("verdict"), "event_id")
    return C.last_verdicts(t.customer.select("c_custkey"), v, "c_custkey", "event_id").groupBy("verdict").agg(F.count("*").alias("n"))


@query("""select system, k1, b, rrf, count(*) n, sum(item_id) total from benchmark, (values ('bm25'), ('bm25f'), ('hybrid'), ('dense')) s(system), (values (0.9), (1.2), (1.5)) k(k1), (values (0.4), (0.75)) y(b), (values (10), (60), (100)) z(rrf) group by all""")
def parameter_grid(t: Tables):
    """Every question under every setting: a grid of fixed size (72 rows, broadcast)."""
    values = {"system": ("bm25", "bm25f", "hybrid", "dense"), "k1": (0.9, 1.2, 1.5), "b": (0.4, 0.75), "rrf": (10, 60, 100)}
    grid = t.spark.range(1).select(*[F.array(*map(F.lit, v)).alias(c) for c, v in values.items()])
    for c in values:
        grid = grid.withColumn(c, F.explode(c))
    return t.benchmark.select("item_id").crossJoin(F.broadcast(grid)).groupBy(*values).agg(F.count("*").alias("n"), F.sum("item_id").alias("total"))


MERGED = """r as (select user_id question, event_type finder, event_id % 30 doc, round(max(value), 4) score from events group by all),
k as (select *, row_number() over (partition by question, finder order by score desc, doc) rank from r),
m as (select question, doc, min(rank) best_rank, max(score) score, string_agg(distinct finder, ';' order by finder) found_by from k group by all)"""


@query(f"with {MERGED} select * from (select *, row_number() over (partition by question order by best_rank, score desc, doc) merged_rank from m) where merged_rank <= 40")
def multi_query_merge(t: Tables):
    """Result lists of several queries of a question merged by best rank, best score and id; at most 40 (the feature)."""
    r = t.events.groupBy(F.col("user_id").alias("question"), F.col("event_type").alias("finder"), (F.col("event_id") % 30).alias("doc")).agg(F.round(F.max("value"), 4).alias("score"))
    ranked = r.withColumn("rank", F.row_number().over(Window.partitionBy("question", "finder").orderBy(F.desc("score"), "doc")))
    return C.merged(ranked, 40)


@query("""with x as (select user_id question, event_id % 30 doc, event_type channel, round(max(value), 4) raw from events group by all)
select question, doc, string_agg(channel || '=' || printf('%.4f', raw), ',' order by channel) channels, round(max(raw), 4) best from x group by all""")
def channel_scores(t: Tables):
    """The raw score of each channel for a result, as a map."""
    x = t.events.groupBy(F.col("user_id").alias("question"), (F.col("event_id") % 30).alias("doc"), F.col("event_type").alias("channel")).agg(F.round(F.max("value"), 4).alias("raw"))
    m = x.groupBy("question", "doc").agg(F.map_from_entries(F.collect_list(F.struct("channel", "raw"))).alias("m"))  # as long as there are channels
    entries = F.array_sort(F.map_entries("m"))
    return m.select("question", "doc", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"]))), ",").alias("channels"), F.array_max(F.map_values("m")).alias("best"))


@query("""select dim, round(avg(v::int), 6) rate, count(v) n from (select unnest(['large', 'urgent', 'done']) dim, unnest([o_totalprice > 100000, o_orderpriority = '1-URGENT', o_orderstatus = 'F']) v from orders) group by dim""")
def dimension_rates(t: Tables):
    wide = t.orders.select((F.col("o_totalprice") > 100000).alias("large"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"), (F.col("o_orderstatus") == "F").alias("done"))
    long = wide.unpivot([], ["large", "urgent", "done"], "dim", "v")
    return long.groupBy("dim").agg(F.round(F.avg(F.col("v").cast("int")), 6).alias("rate"), F.count("v").alias("n"))


@query("""select c_mktsegment, count(*) n, count_if(c_acctbal > 5000) found, round(count_if(c_acctbal > 5000) / greatest(count(*), 1), 6) rate, round(avg(case when c_acctbal > 5000 then c_acctbal end), 4) mean_when_found from customer group by 1""")
def outcome_distribution(t: Tables):
    hit = F.col("c_acctbal") > 5000
    return t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(hit).alias("found"), F.round(F.count_if(hit) / F.greatest(F.count("*"), F.lit(1)), 6).alias("rate"), F.round(F.avg(F.when(hit, F.col("c_acctbal"))), 4).alias("mean_when_found"))


@query("""select step, n from (select unnest(['all', 'labelled', 'good', 'clean']) step, unnest([count(*), count(quality), count_if(quality = 1), count_if(quality = 1 and toxic = 0)]) n from documents left join labels using (doc_id))""")
def funnel(t: Tables):
    j = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    counts = j.agg(F.count("*").alias("all"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("clean"))
    return counts.unpivot([], ["all", "labelled", "good", "clean"], "step", "n")


@query("""select p_brand, count(*) n_sections, count(distinct p_size) n_distinct, max(p_size) highest_section, count_if(length(p_name) > 3) with_heading, count_if(length(p_name) <= 3) headings_missing, sum(length(p_name) - length(replace(p_name, 'e', ''))) n_markers from part group by 1""")
def section_summary(t: Tables):
    marks = F.length("p_name") - F.length(F.replace("p_name", F.lit("e"), F.lit("")))
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n_sections"), F.count_distinct("p_size").alias("n_distinct"), F.max("p_size").alias("highest_section"), F.count_if(F.length("p_name") > 3).alias("with_heading"), F.count_if(F.length("p_name") <= 3).alias("headings_missing"), F.sum(marks).cast("long").alias("n_markers"))


@query("select o_custkey, arg_min(o_orderpriority, o_orderkey) first_priority, arg_min(case when o_totalprice > 60000 then o_orderstatus end, case when o_totalprice > 60000 then o_orderkey end) first_large, round(count_if(o_totalprice > 60000 and o_orderstatus = 'F') / nullif(count_if(o_totalprice > 60000), 0), 6) recovered from orders group by 1")
def first_values(t: Tables):
    """The first value in the order of the file wins; and a ratio that is null without a denominator."""
    large = F.col("o_totalprice") > 60000
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("first_priority"), F.min_by(F.when(large, F.col("o_orderstatus")), F.when(large, F.col("o_orderkey"))).alias("first_large"), F.round(F.count_if(large & (F.col("o_orderstatus") == "F")) / F.nullif(F.count_if(large), F.lit(0)), 6).alias("recovered"))


@query("""select event_id, user_id, min(case when event_type <> 'error' then event_id end) over (partition by user_id order by event_id rows between 1 following and unbounded following) next_page from events""")
def page_after_gap(t: Tables):
    """The next numbered page after each place; errors are the gaps."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    return t.events.select("event_id", "user_id", F.first(F.when(F.col("event_type") != "error", F.col("event_id")), ignorenulls=True).over(w).alias("next_page"))


@query("""select n_nationkey, s_suppkey, (select max(s_suppkey) from supplier) + row_number() over (order by n_nationkey, s_suppkey) new_id from nation join supplier on s_nationkey = n_nationkey and s_suppkey % 7 = 0""")
def next_free_ids(t: Tables):
    """New rows continue the largest id; numbered within ranges, whose sizes alone are summed up."""
    from tessella.operators.relational import numbered

    new = t.nation.join(t.supplier.where("s_suppkey % 7 = 0"), F.col("n_nationkey") == F.col("s_nationkey")).select("n_nationkey", "s_suppkey")
    top = t.supplier.agg(F.max("s_suppkey").alias("top"))
    return numbered(new, ["n_nationkey", "s_suppkey"], "k").crossJoin(F.broadcast(top)).select("n_nationkey", "s_suppkey", (F.col("top") + F.col("k")).alias("new_id"))  # top: one row


@query("""select p_type, p_partkey edition from (select *, row_number() over (partition by p_type order by case when p_brand = 'Brand#1' then 0 when p_brand = 'Brand#2' then 1 else 2 end, p_size desc, p_partkey) r from part) where r = 1""")
def preferred_edition(t: Tables):
    rank = F.when(F.col("p_brand") == "Brand#1", 0).when(F.col("p_brand") == "Brand#2", 1).otherwise(2)
    return t.part.groupBy("p_type").agg(F.min_by("p_partkey", F.struct(rank, -F.col("p_size"), F.col("p_partkey"))).alias("edition"))


@query("""with s as (select o_orderkey, ['JANUARY','FEBRUARY','MARCH','APRIL','MAY','JUNE','JULY','AUGUST','SEPTEMBER','OCTOBER','NOVEMBER','DECEMBER'] m, o_orderkey % 12 + 1 a, (o_orderkey * 7) % 12 + 1 b, 1990 + o_orderkey % 9 y, 1990 + (o_orderkey * 5) % 9 z from orders)
select o_orderkey, case when o_orderkey % 10 = 0 then null else least(y || '-' || lpad(a::varchar, 2, '0'), z || '-' || lpad(b::varchar, 2, '0')) end session from s""")
def earliest_session(t: Tables):
    k, months = F.col("o_orderkey"), F.array(*map(F.lit, T.MONTHS))
    name = lambda m, y: F.concat(F.initcap(F.get(months, m.cast("int"))), F.lit(" "), y.cast("string"))
    text = F.concat(name(k % 12, 1990 + k % 9), F.lit(" / "), name(k * 7 % 12, 1990 + k * 5 % 9))
    return t.orders.select("o_orderkey", T.earliest_session(F.when(k % 10 == 0, "no session").otherwise(text)).alias("session"))


@query("""select user_id, event_id, ntile(4) over w as quarter, round(percent_rank() over w, 6) share, round(sum(value) over (partition by user_id order by event_id rows between 2 preceding and current row), 4) three, count(*) over (partition by user_id order by event_id range between 100 preceding and current row) near from events window w as (partition by user_id order by event_id)""")
def frames(t: Tables):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t.events.select("user_id", "event_id", F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("share"), F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("three"), F.count("*").over(w.rangeBetween(-100, 0)).alias("near"))


@query("select p_partkey, p_retailprice from (select * from part order by p_retailprice desc, p_partkey limit 15) order by p_retailprice, p_partkey")
def largest_ascending(t: Tables):
    return t.part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(15).orderBy("p_retailprice", "p_partkey").select("p_partkey", "p_retailprice")


@query("select c_mktsegment, round(avg(c_acctbal), 1) a, round(max(c_acctbal), 1) b from customer group by 1 order by round(avg(c_acctbal), 1) desc, round(max(c_acctbal), 1) desc, c_mktsegment desc limit 1")
def criterion_pick(t: Tables):
    """The best system by rounded metrics, the last name on a tie."""
    m = t.customer.groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 1).alias("a"), F.round(F.max("c_acctbal"), 1).alias("b"))
    return m.orderBy(F.desc("a"), F.desc("b"), F.desc("c_mktsegment")).limit(1)


@query("""with r as (select p_partkey, '  Rs.  ' || (p_partkey * 1000) || ',500' || case when p_size % 2 = 0 then '/=' else '/-' end || ' . ' v, p_name || ' ' || p_type || ' ' || p_size v2 from part)
select p_partkey, trim(replace(replace(replace(lower(trim(regexp_replace(v, '\\s+', ' ', 'g'))), ',', ''), '/=', ''), '/-', ''), ' .') platform, trim(regexp_replace(v, '\\s+', ' ', 'g')) strict,
case when length(regexp_replace(v2, '\\s+[0-9]{1,4}\\s*$', '')) >= 25 then regexp_replace(v2, '\\s+[0-9]{1,4}\\s*$', '') else v2 end tail, sha1(v2) cache_key from r""")
def normal_forms(t: Tables):
    v = F.concat(F.lit("  Rs.  "), (F.col("p_partkey") * 1000).cast("string"), F.lit(",500"), F.when(F.col("p_size") % 2 == 0, "/=").otherwise("/-"), F.lit(" . "))
    v2 = F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string"))
    return t.part.select("p_partkey", T.platform_norm(v).alias("platform"), T.strict_norm(v).alias("strict"), T.page_tail_stripped(v2).alias("tail"), F.sha1(v2.cast("binary")).alias("cache_key"))


CITED = "case p_size % 6 when 0 then 'Ordinance No. ' || p_size || ' of 1978' when 1 then 'Section 5 of the Act' when 2 then 'Civil Code, s. ' || p_size when 3 then '' when 4 then repeat('long ', 50) else p_name end"


@query(f"""with r as (select p_partkey, {CITED} c, p_name || ' [' || p_size || ', 79 of 1980] [12A, 3  of 1981].' h, 'act-' || p_size || '-of-1988-' || replace(p_name, ' ', '_') || '_' || (p_size + 1) || ' 1990' f from part)
select p_partkey, case when c = '' then 'empty' when regexp_matches(c, '(?i)Ordinance\\s+No\\.?\\s*\\d+\\s+of\\s+\\d{{4}}') then 'Ordinance-No-of-year' when regexp_matches(c, '(?i)\\bsections?\\b.{{0,6}}\\bof the\\b') then 'section-of-Act' when regexp_matches(c, '(?i),\\s*s\\.?\\s*\\d') then 'Code-comma-s' when length(c) > 200 then 'inline-fulltext (long)' else 'other' end format,
p_name heading, p_size || '|12A' sections, (p_size + 1) || '-1990-act-' || replace(p_name, ' ', '-') stem from (select r.*, p_name, p_size from r join part using (p_partkey))""")
def citations(t: Tables):
    """Formats, amendment markers and file names of citations."""
    n, k = F.col("p_size") % 6, F.col("p_size").cast("string")
    c = F.when(n == 0, F.concat(F.lit("Ordinance No. "), k, F.lit(" of 1978"))).when(n == 1, "Section 5 of the Act").when(n == 2, F.concat(F.lit("Civil Code, s. "), k)).when(n == 3, "").when(n == 4, F.repeat(F.lit("long "), 50)).otherwise(F.col("p_name"))
    marks = T.split_markers(F.concat("p_name", F.lit(" ["), k, F.lit(", 79 of 1980] [12A, 3  of 1981].")))
    file = F.concat(F.lit("act-"), k, F.lit("-of-1988-"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), (F.col("p_size") + 1).cast("string"), F.lit(" 1990"))
    return t.part.select("p_partkey", T.citation_format(c).alias("format"), marks["heading"].alias("heading"), F.array_join(F.transform(marks["markers"], lambda m: m["section"]), "|").alias("sections"), T.file_stem(file).alias("stem"))


@query("""with r as (select p_partkey, case p_size % 5 when 0 then lpad(p_partkey::varchar, 9, '0') || 'V' when 1 then '2001-05-' || lpad(p_size::varchar, 2, '0') when 2 then p_size || ' hectares' when 3 then ' ' || p_size || ' ' else p_name end v from part)
select p_partkey, regexp_full_match(trim(v), '[0-9]{9}[VXvx]|[0-9]{12}') nic, regexp_full_match(trim(v), '[0-9]{4}-[0-9]{2}-[0-9]{2}') iso_date, regexp_matches(v, '[0-9]') and regexp_matches(v, '(?i)\\b(ha|hectare|hectares)\\b') extent, regexp_full_match(trim(v), '[0-9]+') digits from r""")
def validated(t: Tables):
    k, n = F.col("p_size").cast("string"), F.col("p_size") % 5
    v = F.when(n == 0, F.concat(F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("V"))).when(n == 1, F.concat(F.lit("2001-05-"), F.lpad(k, 2, "0"))).when(n == 2, F.concat(k, F.lit(" hectares"))).when(n == 3, F.concat(F.lit(" "), k, F.lit(" "))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", T.validators(v).alias("v")).select("p_partkey", "v.*")


@query("""with r as (select p_partkey, '["' || p_name || '", ''' || p_type || ''', "' || p_size || '"' || case when p_size % 2 = 0 then ']' else '' end s from part)
select p_partkey, 3 n, r.s <> '' ok, p_type as "second" from r join part using (p_partkey)""")
def list_literals(t: Tables):
    """Items of list literals with mixed quotes, also where the end is cut off."""
    s = F.concat(F.lit('["'), "p_name", F.lit("\", '"), "p_type", F.lit("', \""), F.col("p_size").cast("string"), F.lit('"'), F.when(F.col("p_size") % 2 == 0, "]").otherwise(""))
    return t.part.select("p_partkey", "p_type", T.quoted_items(s).alias("i")).select("p_partkey", F.size("i").alias("n"), (F.get("i", 0) != "").alias("ok"), F.get("i", 1).alias("second"))


@query("""with m as (select user_id, event_type k, count(*) n from events group by all), z as (select user_id, sum(exp(n / 100.0)) total from m group by 1)
select user_id, arg_max(k, n * 1000 - ascii(k)) top, coalesce(max(case when k = 'purchase' then n end), 0) + 1 purchases, list_aggregate(list((k || ':' || n) order by n desc, k)[1:2], 'string_agg', ',') top_two, round(max(exp(n / 100.0) / total), 6) softmax from m join z using (user_id) group by user_id""")
def map_operations(t: Tables):
    """A map of counts: its largest key, one key or a default, the top two, and the largest softmax."""
    m = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    ordered = F.array_sort(F.transform(F.map_entries("m"), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    top = F.get(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.struct((F.ascii(e["key"]) - 1000 * e["value"]).alias("v"), e["key"].alias("k")))), 0)["k"]
    e = F.transform(F.map_values("m"), lambda n: F.exp(n / 100.0))
    return m.select("user_id", top.alias("top"), (F.coalesce(F.try_element_at("m", F.lit("purchase")), F.lit(0)) + 1).alias("purchases"), F.array_join(F.transform(F.slice(ordered, 1, 2), lambda x: F.concat(x["k"], F.lit(":"), (-x["v"]).cast("string"))), ",").alias("top_two"), F.round(F.array_max(e) / F.aggregate(e, F.lit(0.0), lambda a, x: a + x), 6).alias("softmax"))


@query("""with x as (select l_orderkey src, l_partkey dst, 1.0 w from lineitem where l_returnflag = 'A' union all select l_orderkey, l_suppkey, 1.2 from lineitem where l_returnflag = 'R' union all select l_orderkey, l_orderkey % 10, 0.25 from lineitem),
b as (select src, dst, w from x where src <> dst union all select dst, src, w from x where src <> dst) select src, count(*) degree, round(sum(w), 4) weight from (select src, dst, max(w) w from b group by all) group by src""")
def weighted_graph(t: Tables):
    """Cross references (1.0), amendments (1.2) and definitions (0.25) as one undirected graph; the heaviest edge of a pair counts."""
    l = t.lineitem  # noqa: E741
    e = lambda df, dst: df.select(F.col("l_orderkey").alias("src"), dst.cast("long").alias("dst"))
    g = C.weighted_edges([(e(l.where("l_returnflag = 'A'"), F.col("l_partkey")), 1.0), (e(l.where("l_returnflag = 'R'"), F.col("l_suppkey")), 1.2), (e(l, F.col("l_orderkey") % 10), 0.25)])
    return g.groupBy("src").agg(F.count("*").alias("degree"), F.round(F.sum("weight"), 4).alias("weight"))


RANKED = """k as (select user_id q, event_id doc, event_type act, row_number() over (partition by user_id order by value desc, event_id) r, event_id % 4 = 0 gold, event_id % 9 = 0 future from events),
top as (select * from k where r <= 10)"""


def _ranked(t: Tables):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return t.events.select(F.col("user_id").alias("q"), F.col("event_id").alias("doc"), F.col("event_type").alias("act"), F.row_number().over(w).alias("r"), (F.col("event_id") % 4 == 0).alias("gold"), (F.col("event_id") % 9 == 0).alias("future"))


@query(f"""with {RANKED} select q, max((act = 'purchase' and r <= 5)::int) act_acc5, round(count_if(future and r <= 10) / least(10, count(*)), 6) temporal_viol10, count_if(gold and r > 10) missed, max((gold and r = 1)::int) acc1, max((gold and r <= 3)::int) hit3, round(count_if(gold and r <= 5) / 5.0, 6) prec5, round(count_if(gold and r <= 10) / nullif(count_if(gold), 0), 6) rec10 from k group by q""")
def retrieval_report(t: Tables):
    """Act accuracy, temporal violations, missed gold; accuracy, hit, precision and recall at cuts."""
    at = lambda c, k: F.col(c) & (F.col("r") <= k)
    return _ranked(t).groupBy("q").agg(
        F.max(((F.col("act") == "purchase") & (F.col("r") <= 5)).cast("int")).alias("act_acc5"), F.round(F.count_if(at("future", 10)) / F.least(F.lit(10), F.count("*")), 6).alias("temporal_viol10"), F.count_if(F.col("gold") & (F.col("r") > 10)).alias("missed"),
        F.max(at("gold", 1).cast("int")).alias("acc1"), F.max(at("gold", 3).cast("int")).alias("hit3"), F.round(F.count_if(at("gold", 5)) / 5.0, 6).alias("prec5"), F.round(F.count_if(at("gold", 10)) / F.nullif(F.count_if(F.col("gold")), F.lit(0)), 6).alias("rec10"),
    )


@query(f"""with {RANKED}, m as (select q, count_if(gold and r <= 5) / 5.0 a, count_if(gold and r between 6 and 10) / 5.0 b from k group by q)
select case when a > b then 'first' when b > a then 'second' else 'tie' end winner, count(*) n, round(avg(a - b), 6) mean_difference from m group by 1""")
def engine_comparison(t: Tables):
    """Two engines' metrics on the same questions."""
    r = _ranked(t)
    one = lambda lo, hi, name: r.groupBy("q").agg((F.count_if(F.col("gold") & F.col("r").between(lo, hi)) / 5.0).alias(name))
    winner = F.when(F.col("a") > F.col("b"), "first").when(F.col("b") > F.col("a"), "second").otherwise("tie")
    return one(1, 5, "a").join(one(6, 10, "b"), "q").groupBy(winner.alias("winner")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("mean_difference"))


@query("select user_id, count(distinct event_id % 2) splits from events where event_id % 5 = 0 group by 1 having count(distinct event_id % 2) > 1")
def split_leaks(t: Tables):
    return C.leaks(t.events.where("event_id % 5 = 0").withColumn("split", F.col("event_id") % 2), "user_id", "split")


@query("""with a as (select p_partkey, substr(p_name, 1, 1) || substr(p_type, 1, 1) alias from part), live as (select lower(substr(n_name, 1, 1)) || upper(substr(n_name, 2, 1)) alias, n_nationkey::bigint k from nation union all select 'sE', 3),
per as (select alias, count(distinct p_partkey) owners, min(p_partkey) first_owner from a group by 1), tk as (select alias, count(*) live, min(k) lo, max(k) hi from live group by 1)
select p_partkey, alias, case when live > 0 and (lo <> p_partkey or hi <> p_partkey) then 'live' when owners > 1 then 'shared' else 'none' end collision, owners, first_owner from a join per using (alias) left join tk using (alias)""")
def alias_collisions(t: Tables):
    a = t.part.select("p_partkey", F.concat(F.substring("p_name", 1, 1), F.substring("p_type", 1, 1)).alias("alias"))
    live = t.nation.select(F.concat(F.lower(F.substring("n_name", 1, 1)), F.upper(F.substring("n_name", 2, 1))).alias("alias"), F.col("n_nationkey").cast("long").alias("key")).unionByName(t.spark.range(1).select(F.lit("sE").alias("alias"), F.lit(3).cast("long").alias("key")))
    return C.collisions(a, "p_partkey", "alias", live)


@query("""with x as (select doc_id, unnest(string_split(coalesce(lang, '') || ';' || coalesce(source, ''), ';')) topic from documents), known as (select distinct lang topic, 'primary' role from documents where lang <> 'fr')
select topic, coalesce(role, 'unlisted') role, count(*) n from x left join known using (topic) where topic <> '' group by all""")
def topic_reconciliation(t: Tables):
    """Topics by the authoritative column; roles are kept, the rest is unlisted."""
    d = t.documents
    x = d.select("doc_id", F.explode(F.split(F.concat_ws(";", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))), ";")).alias("topic")).where("topic <> ''")
    known = d.where("lang <> 'fr'").select(F.col("lang").alias("topic"), F.lit("primary").alias("role")).distinct()
    return x.join(known, "topic", "left").groupBy("topic", F.coalesce("role", F.lit("unlisted")).alias("role")).agg(F.count("*").alias("n"))


@query("select l_returnflag, round(count_if(l_tax = 0) / greatest(count(*), 1), 6) share, count_if(l_tax = 0) / greatest(count(*), 1) < 0.005 done from lineitem group by 1")
def coverage_stop(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(C.stop_rule(F.col("l_tax") != 0).alias("s")).select("l_returnflag", "s.*")


@query("""select queue, count(*) n, sum(o_orderkey) total from (select o_orderkey, case when o_orderstatus = 'F' then 'verified' when o_orderstatus = 'P' then 'review' else 'unresolved' end queue from orders) group by 1""")
def review_queues(t: Tables):
    band = t.orders.withColumn("band", F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "P", "review"))
    parts = [q.select(F.lit(n).alias("queue"), "o_orderkey") for n, q in C.queues(band).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("queue").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))


@query("""select doc_id, concat_ws(';', case when quality is null then 'no-label' end, case when quality = 0 and toxic = 1 then 'both-bad' end, case when lang is null or lang = '' then 'no-language' end, case when n_chars < 100 then 'short' end) problems from documents left join labels using (doc_id)""")
def rubric_problems(t: Tables):
    """All problems of a classified row, in the rubric's order."""
    j = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id", "left")
    problems = [("no-label", F.col("quality").isNull()), ("both-bad", (F.col("quality") == 0) & (F.col("toxic") == 1)), ("no-language", F.col("lang").isNull() | (F.col("lang") == "")), ("short", F.col("n_chars") < 100)]
    return j.select("doc_id", F.concat_ws(";", *[F.when(c, n) for n, c in problems]).alias("problems"))


@query("""with a as (select o_orderkey question, [o_custkey, o_custkey + 1] c from orders), e as (select distinct o_orderkey question, o_custkey doc from orders union select o_orderkey, o_custkey + 1 from orders where o_orderkey % 3 = 0)
select a.question, count(*) n_cited, count(e.doc) n_held, count(*) = count(e.doc) ok from (select question, unnest(c) doc from a) a left join e on e.question = a.question and e.doc = a.doc group by 1""")
def citation_gate(t: Tables):
    """An answer passes if it cites something, and only what was retrieved."""
    o = t.orders
    answers = o.select(F.col("o_orderkey").alias("question"), F.array("o_custkey", F.col("o_custkey") + 1).alias("cited"))
    held = o.select(F.col("o_orderkey").alias("question"), F.col("o_custkey").alias("doc")).unionByName(o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("question"), (F.col("o_custkey") + 1).alias("doc")))
    return C.cited(answers, held)
