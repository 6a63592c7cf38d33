"""Named relational operators: reconciliations, interval and as-of joins, windows, samples, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def first_match(left: DataFrame, right: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """left with the first row of right per key."""
    w = Window.partitionBy(key).orderBy(*order)
    return left.join(right.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n"), key, "left")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every key of either side with its state: both, left_only, right_only."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    state = F.when(F.col("l").isNull(), "right_only").when(F.col("r").isNull(), "left_only").otherwise("both")
    return a.join(b, key, "full").select(key, state.alias("state"))


def two_resolvers(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Answers of two resolvers (key, target): verified when equal, review when they differ or one is silent."""
    j = a.withColumnRenamed("target", "ta").join(b.withColumnRenamed("target", "tb"), key, "full")
    band = F.when(F.col("ta") == F.col("tb"), "verified").when(F.col("ta").isNull() & F.col("tb").isNull(), "unresolved").otherwise("review")
    return j.select(key, F.coalesce("ta", "tb").alias("target"), band.alias("band"))


def intervals(events: DataFrame, by: str, start: str) -> DataFrame:
    """Versions: each one ends where the next begins; the last is open and current."""
    w = Window.partitionBy(by).orderBy(start)
    return events.select(by, start, F.row_number().over(w).alias("version_no"), F.lead(start).over(w).alias("valid_to")).withColumn("is_current", F.col("valid_to").isNull())


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, start: str, value: str) -> DataFrame:
    """left with the value (null too) of right's latest row at or before its time: one union, one sort, one running pass; no theta join."""
    both = left.select(*left.columns, F.lit(1).alias("__probe"), F.col(at).alias("__t"), F.lit(None).cast(StructType([StructField("v", right.schema[value].dataType)])).alias("__v")).unionByName(
        right.select(by, F.lit(0).alias("__probe"), F.col(start).alias("__t"), F.struct(F.col(value).alias("v")).alias("__v")), allowMissingColumns=True
    )
    w = Window.partitionBy(by).orderBy("__t", "__probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)["v"]).where("__probe = 1").drop("__probe", "__t", "__v")


def forward_fill(df: DataFrame, by: list[str], order: list[str], value: Column) -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def running_budget(df: DataFrame, by: str, order: str, size: Column, budget: int) -> DataFrame:
    """Rows of each group while the sizes before them stay under the budget."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("used", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("used") < budget)


def islands(df: DataFrame, by: str, order: str, flag: Column) -> DataFrame:
    """df with the number of the run of equal flags that each row is in."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("__f", flag).withColumn("__new", (F.col("__f") != F.lag("__f").over(w)).cast("int")).withColumn("island", F.sum(F.coalesce("__new", F.lit(0))).over(w)).drop("__f", "__new")


def hash_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows per stratum in the order of sha256(seed, key)."""
    w = Window.partitionBy(stratum).orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256))
    return df.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)


def hash_split(df: DataFrame, stratum: str, key: str, share: float, seed: str) -> DataFrame:
    """df with split dev/test: dev has round(n * share) rows of each stratum, one at least where there are three."""
    w = Window.partitionBy(stratum).orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256))
    n = F.count("*").over(Window.partitionBy(stratum))
    dev = F.greatest(F.bround(n * share).cast("long"), F.when(n >= 3, 1).otherwise(0))
    return df.withColumn("split", F.when(F.row_number().over(w) <= dev, "dev").otherwise("test"))


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(rule, key, detail) rows of every check; each check is a frame of offending (key, detail)."""
    frames = [df.select(F.lit(rule).alias("rule"), F.col("key").cast("string").alias("key"), F.col("detail").cast("string").alias("detail")) for rule, df in checks.items()]
    return reduce(DataFrame.unionByName, frames)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("detail")).where("detail > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.join(parent, child[key] == parent[parent_key], "left_anti").select(F.col(key).alias("key"), F.lit("no parent").alias("detail")).distinct()


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One order-free hash of a table: row hashes are summed by 16-bit prefix before they meet, so nothing is collected."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    parts = df.select(row.alias("h")).groupBy(F.substring("h", 1, 4).alias("p")).agg(F.sum(F.conv(F.substring("h", 5, 12), 16, 10).cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    return parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "p", "n", "s"))), ","), 256).alias("fingerprint"), F.sum("n").alias("n"))  # 65,536 parts at most


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with 1, 2, ... in the order of the columns: numbered within ranges, whose sizes alone (one row a task) are summed up in one place."""
    from tessella.sources.tables import table

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = table(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.join(F.broadcast(base), "__part").withColumn(name, F.col("__base") + own).drop("__part", "__base")  # base: a row a task
