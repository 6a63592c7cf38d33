"""Relational queries: joins, aggregates, windows, sorts, set operations, checks, samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import vectors as V
from tessella.operators import relational as R
from tessella.plans.base import Tables, query


@query("select c_custkey, coalesce(n_name, '') n_name, coalesce(r_name, '') r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def registry_left_join(t: Tables):
    out = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("c_custkey", F.coalesce("n_name", F.lit("")).alias("n_name"), F.coalesce("r_name", F.lit("")).alias("r_name"))


@query("select o_custkey, string_agg(distinct o_orderpriority, ';' order by o_orderpriority) priorities, count(*) n from orders join customer on o_custkey = c_custkey group by o_custkey")
def multi_edge_collect(t: Tables):
    """Keys collected per parent: distinct values only, so an array is as long as the value set."""
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ";").alias("priorities"), F.count("*").alias("n"))


@query("select c_custkey, o_orderkey from customer left join (select o_custkey, min(o_orderkey) o_orderkey from orders group by 1) on o_custkey = c_custkey")
def first_match_join(t: Tables):
    first = t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", "o_orderkey").alias("o_orderkey"))
    return t.customer.join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("select doc_id, lang, source from documents where doc_id in (select doc_id from labels where quality = 1)")
def semi_join(t: Tables):
    return t.documents.join(t.labels.where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang", "source")


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def anti_join(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id", "source")


@query("""select coalesce(a.k, b.k) k, case when a.k is null then 'right_only' when b.k is null then 'left_only' else 'both' end state
from (select distinct o_custkey k from orders) a full join (select distinct c_custkey k from customer where c_custkey % 3 > 0) b on a.k = b.k""")
def full_outer_reconcile(t: Tables):
    return R.reconcile(t.orders.select(F.col("o_custkey").alias("k")), t.customer.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k")), "k")


@query("""with k as (select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) k from part), m as (select k, min(p_partkey) first, count(*) n from k group by k)
select p_partkey, first, n from k join m using (k)""")
def normalized_key_join(t: Tables):
    k = t.part.select("p_partkey", T.key("p_name").alias("k"))
    return k.join(k.groupBy("k").agg(F.min("p_partkey").alias("first"), F.count("*").alias("n")), "k").select("p_partkey", "first", "n")


@query("select l_orderkey, l_linenumber, s_name from lineitem join supplier on l_suppkey = s_suppkey and l_linenumber = s_nationkey % 7")
def composite_key_join(t: Tables):
    s = t.supplier.withColumn("k", F.col("s_nationkey") % 7)
    l = t.lineitem  # noqa: E741
    return l.join(s, (l.l_suppkey == s.s_suppkey) & (l.l_linenumber == s.k)).select("l_orderkey", "l_linenumber", "s_name")


@query("""with hit as (select p_partkey, n_nationkey, lower(n_name) alias from part, nation where contains(' ' || lower(p_name) || ' ', ' ' || lower(substr(n_name, 1, 3)) || ' '))
select p_brand, count(*) n, count(distinct coalesce(h.n_nationkey, -1)) aliases from part left join hit h using (p_partkey) group by p_brand""")
def containment_join(t: Tables):
    """Aliases of a fixed list (25 rows, by its file a bounded dimension) inside titles, at word borders."""
    alias = F.broadcast(t.nation.select("n_nationkey", F.concat(F.lit(" "), F.lower(F.substring("n_name", 1, 3)), F.lit(" ")).alias("alias")))
    hit = t.part.join(alias, F.contains(F.concat(F.lit(" "), F.lower("p_name"), F.lit(" ")), F.col("alias")), "left")
    return hit.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("n_nationkey", F.lit(-1))).alias("aliases"))


@query("""with a as (select o_orderkey k, o_custkey % 5 target from orders where o_orderkey % 2 = 0), b as (select o_orderkey k, o_custkey % 4 target from orders where o_orderkey % 3 = 0)
select coalesce(a.k, b.k) k, coalesce(a.target, b.target) target, case when a.target = b.target then 'verified' when a.target is null and b.target is null then 'unresolved' else 'review' end band from a full join b on a.k = b.k""")
def two_resolver(t: Tables):
    a = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 5).alias("target"))
    b = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 4).alias("target"))
    return R.two_resolvers(a, b, "k")


@query("""with g as (select o_orderkey, o_orderdate, count_if(l_shipdate > o_orderdate + interval 60 day) late, count(l_orderkey) n from orders left join lineitem on l_orderkey = o_orderkey group by all)
select case when n = 0 then 'history-unknown' when late > 0 then 'superseded' else 'applicable' end status, count(*) n from g group by 1""")
def temporal_grade(t: Tables):
    o, l = t.orders, t.lineitem  # noqa: E741
    g = o.join(l, l.l_orderkey == o.o_orderkey, "left").groupBy("o_orderkey").agg(F.count_if(F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 60 day")).alias("late"), F.count("l_orderkey").alias("n"))
    return g.groupBy(F.when(F.col("n") == 0, "history-unknown").when(F.col("late") > 0, "superseded").otherwise("applicable").alias("status")).agg(F.count("*").alias("n"))


@query("""with p as (select event_id, user_id, ts from events where event_type = 'purchase'), v as (select user_id, ts, max(event_id) vid from events where event_type = 'view' group by all)
select p.event_id, v.vid as_of from p asof left join v on p.user_id = v.user_id and p.ts >= v.ts""")
def asof_version(t: Tables):
    e = t.events
    probe = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = e.where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("start")).agg(F.max("event_id").alias("as_of"))
    return R.as_of(probe, views, "user_id", "ts", "start", "as_of").select("event_id", "as_of")


@query("""select user_id, event_id, version_no, case when nxt is null then true else false end is_current, coalesce(nxt, -1) next_id from
(select user_id, event_id, row_number() over w version_no, lead(event_id) over w nxt from events window w as (partition by user_id order by event_id))""")
def interval_chain(t: Tables):
    return R.intervals(t.events, "user_id", "event_id").select("user_id", "event_id", "version_no", "is_current", F.coalesce("valid_to", F.lit(-1)).alias("next_id"))


@query("""select event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) filled from events""")
def ffill_state(t: Tables):
    e = t.events
    return e.select("event_id", R.forward_fill(e, ["user_id"], ["event_id"], F.when(F.col("event_type") == "signup", F.col("event_id"))).alias("filled"))


@query("""with f as (select user_id, event_id, value > 50 f from events), n as (select *, case when f <> lag(f) over (partition by user_id order by event_id) then 1 else 0 end c from f),
i as (select user_id, f, sum(c) over (partition by user_id order by event_id) island from n)
select user_id, max(len) longest from (select user_id, island, count(*) len from i where not f group by all) group by user_id""")
def quiet_islands(t: Tables):
    e = R.islands(t.events.select("user_id", "event_id", "value"), "user_id", "event_id", F.col("value") > 50)
    return e.where("not value > 50").groupBy("user_id", "island").count().groupBy("user_id").agg(F.max("count").alias("longest"))


@query("""select conv_id, turn, used from (select conv_id, turn, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint used from conversations) where used < 600""")
def running_budget(t: Tables):
    return R.running_budget(t.conversations, "conv_id", "turn", F.length("text"), 600).select("conv_id", "turn", F.col("used").cast("long").alias("used"))


@query("select round(avg(m), 6) macro from (select o_custkey, avg(o_totalprice) m from orders group by o_custkey)")
def macro_mean(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m")).agg(F.round(F.avg("m"), 6).alias("macro"))


@query("""select coalesce(lang, 'overall') bucket, count(*) n, round(avg(n_chars), 4) mean_chars from documents group by grouping sets ((), (lang))""")
def bucket_means(t: Tables):
    d = t.documents
    return d.groupingSets([[], [F.col("lang")]], F.col("lang")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars")).select(F.coalesce("lang", F.lit("overall")).alias("bucket"), "n", "mean_chars")


@query("""select 'text' col, count_if(trim(text) <> '') filled, count(*) total from documents union all select 'lang', count_if(trim(lang) <> ''), count(*) from documents union all select 'source', count_if(trim(source) <> ''), count(*) from documents""")
def completeness(t: Tables):
    one = t.documents.agg(F.count("*").alias("total"), *[F.count_if(F.trim(c) != "").alias(c) for c in ("text", "lang", "source")])
    return one.unpivot(["total"], ["text", "lang", "source"], "col", "filled").select("col", "filled", "total")


@query("""select min(v) lo, median(v) mid, round(avg(v), 6) mean, max(v) hi, count(*) - count(v) bad from (select try_cast(regexp_extract(props, '"k": *([0-9]+)', 1) as double) v from events)""")
def coerced_stats(t: Tables):
    v = t.events.select(F.get_json_object("props", "$.k").try_cast("double").alias("v"))
    return v.agg(F.min("v").alias("lo"), F.median("v").alias("mid"), F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("hi"), (F.count("*") - F.count("v")).alias("bad"))


@query("select (floor(year(o_orderdate) / 10) * 10)::bigint from_year, year(o_orderdate)::bigint yr, count(*) n from orders group by all")
def decade_hist(t: Tables):
    y = F.year("o_orderdate")
    return t.orders.groupBy((F.floor(y / 10) * 10).cast("long").alias("from_year"), y.cast("long").alias("yr")).agg(F.count("*").alias("n"))


@query("select coalesce(l_returnflag, '*') act, coalesce(l_linestatus, '*') section, count(*) n, round(sum(l_quantity), 2) qty from lineitem group by rollup (l_returnflag, l_linestatus)")
def act_rollup(t: Tables):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")).select(F.coalesce("l_returnflag", F.lit("*")).alias("act"), F.coalesce("l_linestatus", F.lit("*")).alias("section"), "n", "qty")


@query("""select user_id % 10 grp, count_if(event_type = 'click') click, count_if(event_type = 'error') error, count_if(event_type = 'purchase') purchase, count_if(event_type = 'signup') signup, count_if(event_type = 'view') view from events group by 1""")
def pivot_actions(t: Tables):
    kinds = ["click", "error", "purchase", "signup", "view"]
    return t.events.groupBy((F.col("user_id") % 10).alias("grp")).pivot("event_type", kinds).agg(F.count(F.lit(1))).na.fill(0)


@query("""with c as (select p_brand, count(*) n from part group by 1), r as (select *, row_number() over (order by n desc, p_brand) k from c)
select case when k <= 5 then p_brand else 'other' end brand, sum(n)::bigint n from r group by 1""")
def top_n_other(t: Tables):
    c = t.part.groupBy("p_brand").agg(F.count("*").alias("n"))
    top = c.orderBy(F.desc("n"), "p_brand").limit(5).select(F.col("p_brand").alias("brand"))
    return c.join(F.broadcast(top), F.col("p_brand") == F.col("brand"), "left").groupBy(F.coalesce("brand", F.lit("other")).alias("brand")).agg(F.sum("n").alias("n"))  # five rows


@query("select s_nationkey, max(s_acctbal) best, count(distinct s_name) names, count(*) n, string_agg(distinct substr(s_name, 1, 1), ',' order by substr(s_name, 1, 1)) initials from supplier group by s_nationkey")
def group_profile(t: Tables):
    return t.supplier.groupBy("s_nationkey").agg(F.max("s_acctbal").alias("best"), F.count_distinct("s_name").alias("names"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.substring("s_name", 1, 1))), ",").alias("initials"))


@query("""select k status, coalesce(n, 0) n from (values ('F'), ('O'), ('P'), ('X')) v(k) left join (select o_orderstatus, count(*) n from orders group by 1) on o_orderstatus = k""")
def zero_counts(t: Tables):
    """Counts per value of a fixed list, zeros kept."""
    kinds = t.spark.createDataFrame([(k,) for k in "FOPX"], "status string")
    return kinds.join(t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")), "status", "left").na.fill(0, ["n"])


@query("""with a as (select regexp_extract_all(lower(text), '[a-z0-9]+') w from documents), da as (select term, count(*) n from (select unnest(w) term from a) group by 1),
db as (select term, count(*) n from (select unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term from benchmark) group by 1)
select count(*) terms, sum(greatest(db.n - coalesce(da.n, 0), 0))::bigint missing, round(sum(greatest(db.n - coalesce(da.n, 0), 0)) / sum(db.n), 6) share from db left join da using (term)""")
def vocab_diff(t: Tables):
    """Multiset difference of words: what one side has that the other lacks."""
    count = lambda df, n: df.select(F.explode(T.tokens("text")).alias("term")).groupBy("term").agg(F.count("*").alias(n))
    j = count(t.benchmark, "b").join(count(t.documents, "a"), "term", "left").withColumn("miss", F.greatest(F.col("b") - F.coalesce("a", F.lit(0)), F.lit(0)))
    return j.agg(F.count("*").alias("terms"), F.sum("miss").alias("missing"), F.round(F.sum("miss") / F.sum("b"), 6).alias("share"))


@query("""with h as (select sha256(concat_ws(chr(31), n_nationkey::varchar, n_name, n_regionkey::varchar)) h from nation),
p as (select substr(h, 1, 4) p, count(*) n, sum(('0x' || substr(h, 5, 12))::bigint)::hugeint s from h group by 1)
select sha256(string_agg(p || ':' || n || ':' || s, ',' order by p || ':' || n || ':' || s)) fingerprint, sum(n)::bigint n from p""")
def fingerprint(t: Tables):
    return R.fingerprint(t.nation, ["n_nationkey", "n_name", "n_regionkey"])


@query("""with r as (select p_partkey, case when p_size % 7 = 0 then 'Schedule ' || p_size else p_size || case when p_partkey % 3 = 0 then 'A' when p_partkey % 5 = 0 then 'B' else '' end end sec from part)
select p_partkey, sec, row_number() over (order by not regexp_matches(sec, '^[0-9]'), try_cast(regexp_extract(sec, '^([0-9]+)', 1) as bigint), regexp_replace(sec, '^[0-9]+', ''), p_partkey) pos from r""")
def natural_sort(t: Tables):
    """Sections in natural order (1, 2, 12, 12A, 13; what has no number last), numbered over ranges."""
    sec = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("Schedule "), F.col("p_size").cast("string"))).otherwise(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "A").when(F.col("p_partkey") % 5 == 0, "B").otherwise("")))
    rows = t.part.select("p_partkey", sec.alias("sec"))
    keys = {f"__k{i}": k for i, k in enumerate(T.natural_order("sec"))}
    return R.numbered(rows.withColumns(keys), [*keys, "p_partkey"], "pos").select("p_partkey", "sec", "pos")


@query("""select doc_id, toxic, rank from (select d.doc_id, toxic, row_number() over (order by toxic desc nulls last, n_chars, d.doc_id) rank from documents d left join labels l on d.doc_id = l.doc_id) where rank <= 50""")
def nulls_last_sort(t: Tables):
    d = t.documents.join(t.labels, "doc_id", "left").orderBy(F.desc_nulls_last("toxic"), "n_chars", "doc_id").limit(50)
    return d.select("doc_id", "toxic", F.row_number().over(Window.orderBy(F.desc_nulls_last("toxic"), "n_chars", "doc_id")).alias("rank"))  # fifty rows


@query("select s_nationkey, s_suppkey, s_acctbal from (select *, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) r from supplier) where r = 1")
def dedupe_keep_best(t: Tables):
    return t.supplier.groupBy("s_nationkey").agg(F.max(F.struct("s_acctbal", (-F.col("s_suppkey")).alias("k"))).alias("b")).select("s_nationkey", (-F.col("b.k")).alias("s_suppkey"), F.col("b.s_acctbal").alias("s_acctbal"))


@query("select 'doc' kind, doc_id id, text from documents union all select 'item', item_id, text from benchmark")
def union_index(t: Tables):
    return t.documents.select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text").unionByName(t.benchmark.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), "text"))


@query("""select 'both' op, count(*) n from (select doc_id from documents intersect select doc_id from labels) union all select 'only', count(*) from (select doc_id from documents except select doc_id from labels) union all
select 'any', count(*) from (select doc_id from documents union select doc_id from labels) union all select 'langs', count(*) from (select distinct lang from documents)""")
def set_ops(t: Tables):
    d, l = t.documents.select("doc_id"), t.labels.select("doc_id")  # noqa: E741
    n = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return n(d.intersect(l), "both").unionByName(n(d.subtract(l), "only")).unionByName(n(d.union(l).distinct(), "any")).unionByName(n(t.documents.select("lang").distinct(), "langs"))


@query("""select count(*) total, count(l.doc_id) labelled, count(*) - count(l.doc_id) rest, count(*) = count(l.doc_id) + count_if(l.doc_id is null) law from documents d left join (select distinct doc_id from labels) l on d.doc_id = l.doc_id""")
def partition_law(t: Tables):
    d = t.documents.join(t.labels.select(F.col("doc_id").alias("l")).distinct(), F.col("doc_id") == F.col("l"), "left")
    return d.agg(F.count("*").alias("total"), F.count("l").alias("labelled"), (F.count("*") - F.count("l")).alias("rest"), (F.count("*") == F.count("l") + F.count_if(F.col("l").isNull())).alias("law"))


@query("""select d.doc_id, case when trim(text) = '' then 'empty' when n_chars < 200 then 'short' when quality is null then 'unlabelled' when quality = 0 then 'low' when toxic = 1 then 'toxic' else 'kept' end reason from documents d left join labels l on d.doc_id = l.doc_id""")
def drop_reason(t: Tables):
    """First reason that applies."""
    reason = F.when(F.trim("text") == "", "empty").when(F.col("n_chars") < 200, "short").when(F.col("quality").isNull(), "unlabelled").when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").otherwise("kept")
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", reason.alias("reason"))


@query("""select d.doc_id, concat_ws(',', case when n_chars < 200 then 'short' end, case when quality = 0 then 'low' end, case when toxic = 1 then 'toxic' end) failures from documents d left join labels l on d.doc_id = l.doc_id""")
def failure_array(t: Tables):
    """All reasons that apply."""
    fails = F.array_compact(F.array(F.when(F.col("n_chars") < 200, "short"), F.when(F.col("quality") == 0, "low"), F.when(F.col("toxic") == 1, "toxic")))
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.array_join(fails, ",").alias("failures"))


@query("""select o_orderkey, case when o_orderstatus = 'F' and o_totalprice > 100000 then 'use' when o_orderstatus = 'F' then 'shorten' when o_orderpriority like '1%' then 'rewrite' else 'drop' end action from orders""")
def decision_table(t: Tables):
    done = F.col("o_orderstatus") == "F"
    return t.orders.select("o_orderkey", F.when(done & (F.col("o_totalprice") > 100000), "use").when(done, "shorten").when(F.col("o_orderpriority").startswith("1"), "rewrite").otherwise("drop").alias("action"))


@query("""select count_if(q = 1 and x = 0) both_ok, count_if(q = 1 and x = 1) gap, count_if(q = 0) low, count(*) n from (select quality q, toxic x from labels)""")
def mask_algebra(t: Tables):
    q, x = F.col("quality") == 1, F.col("toxic") == 1
    return t.labels.agg(F.count_if(q & ~x).alias("both_ok"), F.count_if(q & x).alias("gap"), F.count_if(~q).alias("low"), F.count("*").alias("n"))


@query("""select o_orderpriority, o_orderkey, pick from (select *, row_number() over (partition by o_orderpriority order by sha256('s1' || o_orderkey)) pick from orders) where pick <= 5""")
def stratified_sample(t: Tables):
    return R.hash_sample(t.orders, "o_orderpriority", "o_orderkey", 5, "s1").select("o_orderpriority", "o_orderkey", "pick")


@query("""with r as (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by sha256('s2' || c_custkey)) k, count(*) over (partition by c_mktsegment) n from customer)
select c_custkey, c_mktsegment, case when k <= greatest(round_even(n * 0.17, 0), case when n >= 3 then 1 else 0 end) then 'dev' else 'test' end split from r""")
def stratified_split(t: Tables):
    return R.hash_split(t.customer, "c_mktsegment", "c_custkey", 0.17, "s2").select("c_custkey", "c_mktsegment", "split")


@query("select c_custkey, rank from (select c_custkey, row_number() over (order by sha256('s3' || c_custkey)) rank from customer) where rank <= 25")
def hash_order_sample(t: Tables):
    h = F.sha2(F.concat(F.lit("s3"), F.col("c_custkey").cast("string")), 256)
    top = t.customer.select("c_custkey", h.alias("h")).orderBy("h").limit(25)
    return top.select("c_custkey", F.row_number().over(Window.orderBy("h")).alias("rank"))  # 25 rows


@query("""select 'unique_order' rule, count(*) n from (select o_orderkey from orders group by 1 having count(*) > 1) union all select 'order_has_customer', count(distinct o_custkey) from orders where o_custkey not in (select c_custkey from customer) union all
select 'line_has_order', count(distinct l_orderkey) from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'status_known', count(*) from orders where o_orderstatus not in ('F', 'O')""")
def audit_keys(t: Tables):
    """Uniqueness, references and value lists; rules without violations are counted as zero."""
    o = t.orders
    bad = R.violations(
        {
            "unique_order": R.duplicates(o, "o_orderkey"),
            "order_has_customer": R.orphans(o, "o_custkey", t.customer, "c_custkey"),
            "line_has_order": R.orphans(t.lineitem, "l_orderkey", o, "o_orderkey"),
            "status_known": o.where(~F.col("o_orderstatus").isin("F", "O")).select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("detail")),
        }
    )
    rules = t.spark.createDataFrame([(r,) for r in ("unique_order", "order_has_customer", "line_has_order", "status_known")], "rule string")
    return rules.join(bad.groupBy("rule").agg(F.count("*").alias("n")), "rule", "left").na.fill(0, ["n"])


@query("select k + 1 gap_start, nxt - 1 gap_end from (select doc_id k, lead(doc_id) over (order by doc_id) nxt from labels) where nxt > k + 1")
def id_gaps(t: Tables):
    """Gaps between consecutive ids, found within ranges of ids; the ends of neighbouring ranges meet in a small table."""
    ids = t.labels.select(F.col("doc_id").alias("k")).distinct().withColumn("block", F.floor(F.col("k") / 4096))
    inner = ids.select("k", F.lead("k").over(Window.partitionBy("block").orderBy("k")).alias("nxt"))
    ends = ids.groupBy("block").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    outer = ends.select(F.col("hi").alias("k"), F.lead("lo").over(Window.orderBy("block")).alias("nxt"))
    return inner.where("nxt is not null").unionByName(outer).where("nxt > k + 1").select((F.col("k") + 1).alias("gap_start"), (F.col("nxt") - 1).alias("gap_end"))


@query("""with m as (select doc_id, case when doc_id % 10 = 0 then 'bad' when doc_id % 10 = 1 then null else sha256(replace(text, chr(13), chr(10))) end want from documents where doc_id % 10 <> 2)
select case when m.doc_id is null then 'unlisted' when want is null then 'legacy' when want = sha256(replace(text, chr(13), chr(10))) then 'ok' else 'mismatch' end state, count(*) n from documents d left join m on m.doc_id = d.doc_id group by 1""")
def manifest_verify(t: Tables):
    d = t.documents.select("doc_id", T.lf_hash("text").alias("have"))
    m = d.where("doc_id % 10 <> 2").select(F.col("doc_id").alias("m"), F.when(F.col("doc_id") % 10 == 0, "bad").when(F.col("doc_id") % 10 == 1, None).otherwise(F.col("have")).alias("want"))
    state = F.when(F.col("m").isNull(), "unlisted").when(F.col("want").isNull(), "legacy").when(F.col("want") == F.col("have"), "ok").otherwise("mismatch")
    return d.join(m, F.col("doc_id") == F.col("m"), "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""with b as (select p_partkey, p_size / 100.0::double x0, (p_size + 10) / 100.0::double x1, (p_partkey % 20) / 100.0::double y0, (p_partkey % 20 + 15) / 100.0::double y1 from part),
i as (select p_partkey, greatest(least(x1, 0.4) - greatest(x0, 0.2), 0) * greatest(least(y1, 0.3) - greatest(y0, 0.1), 0) ov, (x1 - x0) * (y1 - y0) a from b) select p_partkey, round(ov / (a + 0.04 - ov), 6) iou from i""")
def box_iou(t: Tables):
    f = lambda c: c.cast("double") / 100
    a = {"x0": f(F.col("p_size")), "x1": f(F.col("p_size") + 10), "y0": f(F.col("p_partkey") % 20), "y1": f(F.col("p_partkey") % 20 + 15)}
    b = {"x0": F.lit(0.2), "x1": F.lit(0.4), "y0": F.lit(0.1), "y1": F.lit(0.3)}
    return t.part.select("p_partkey", F.round(V.iou(a, b), 6).alias("iou"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) k, coalesce(json_extract_string(props, '$.none'), 'default') d from events")
def json_props(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.none"), F.lit("default")).alias("d"))


@query("""select o_orderkey, o_totalprice, year(o_orderdate)::bigint yr, (abs(year(o_orderdate) - 1998) * 10 + case o_orderstatus when 'O' then 0 else 1 end)::bigint prio from orders where year(o_orderdate) between 1996 and 1999 order by prio, o_orderkey limit 40""")
def range_filter_priority(t: Tables):
    y = F.year("o_orderdate")
    prio = (F.abs(y - 1998) * 10 + F.when(F.col("o_orderstatus") == "O", 0).otherwise(1)).cast("long")
    return t.orders.where(y.between(1996, 1999)).select("o_orderkey", "o_totalprice", y.cast("long").alias("yr"), prio.alias("prio")).orderBy("prio", "o_orderkey").limit(40)


@query("""select 'ACT' || lpad((row_number() over (order by p_name, p_partkey))::varchar, 5, '0') act_id, p_partkey from part""")
def sequential_ids(t: Tables):
    """Ids in the order of names, numbered over ranges."""
    return R.numbered(t.part.select("p_name", "p_partkey"), ["p_name", "p_partkey"], "k").select(F.concat(F.lit("ACT"), F.lpad(F.col("k").cast("string"), 5, "0")).alias("act_id"), "p_partkey")


@query("""select s_suppkey, s_acctbal from (select s_suppkey, s_acctbal, s_name from supplier where s_suppkey % 2 = 0 union all select s_suppkey, s_acctbal + 1, s_name from supplier where s_suppkey % 2 = 1)""")
def keyed_upsert(t: Tables):
    """New rows win over old ones of the same key."""
    old = t.supplier.select("s_suppkey", "s_acctbal")
    new = old.where("s_suppkey % 2 = 1").withColumn("s_acctbal", F.col("s_acctbal") + 1)
    return new.unionByName(old.join(new, "s_suppkey", "left_anti"))
