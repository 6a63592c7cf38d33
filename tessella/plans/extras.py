"""Beyond the inventory: warehouse-style queries that benchmark scans, joins and aggregations, and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.plans.base import Tables, query


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, round(avg(l_discount), 6) avg_disc, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def pricing_summary(t: Tables):
    l = t.lineitem.where("l_shipdate <= timestamp_ntz '1998-09-02'")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_regionkey = 2 group by n_name""")
def regional_revenue(t: Tables):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region.where("r_regionkey = 2"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H') slot, event_type, count(*) n, round(sum(value), 4) total from events group by all""")
def hourly_windows(t: Tables):
    return t.events.groupBy(F.date_format(F.window("ts", "1 hour").start, "yyyy-MM-dd HH").alias("slot"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end s from events), i as (select user_id, sum(s) over (partition by user_id order by ts rows between unbounded preceding and current row) k from g)
select user_id, count(distinct k) sessions, count(*) n from i group by user_id""")
def user_sessions(t: Tables):
    """Sessions with a gap of half an hour; a window of the gap's end is closed there, as in the SQL."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    start = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 30 minutes"), 0).otherwise(1)
    return t.events.withColumn("s", start).groupBy("user_id").agg(F.sum("s").alias("sessions"), F.count("*").alias("n"))
