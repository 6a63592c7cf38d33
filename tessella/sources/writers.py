"""Sinks: generations behind a pointer, upserts by key, partitioned and single-format outputs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.readers import exists


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, written beside its place and renamed over it."""
    jvm = spark.sparkContext._jvm
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(target, False)
    fs.rename(beside, target)


def publish(df: DataFrame, root: str, fingerprint: str) -> str:
    """Write df as a new generation below root and point to it; a generation of the same fingerprint is reused."""
    spark, pointer = df.sparkSession, f"{root}/current.json"
    if exists(spark, pointer):
        now = json.loads(spark.read.option("wholetext", True).text(pointer).first()[0])
        if now["fingerprint"] == fingerprint and exists(spark, now["path"]):
            return now["path"]
    path = f"{root}/gen={uuid.uuid4().hex}"
    df.write.parquet(path)
    _write_text(spark, pointer, json.dumps({"fingerprint": fingerprint, "path": path}))
    return path


def current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(json.loads(spark.read.option("wholetext", True).text(f"{root}/current.json").first()[0])["path"])


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key new lacks."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"), allowMissingColumns=True)


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items not done yet; an interrupted build goes on with these."""
    return items.join(done.select(key), key, "left_anti")


def checked(df: DataFrame, n: int) -> DataFrame:
    """df, if it has n rows; else raises."""
    got = df.count()
    if got != n:
        raise ValueError(f"{got} rows instead of {n}")
    return df


def csv(df: DataFrame, path: str) -> bool:
    """Write a CSV with header; nothing for an empty table."""
    if df.isEmpty():
        return False
    df.write.option("header", True).mode("overwrite").csv(path)
    return True


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def by_bucket(df: DataFrame, path: str, bucket: str) -> None:
    """One folder per value of bucket; rows of a bucket are dealt over tasks, so a large one isn't a single file."""
    df.repartition(F.col(bucket), F.pmod(F.xxhash64(*[c for c in df.columns if c != bucket]), F.lit(16))).write.mode("overwrite").partitionBy(bucket).parquet(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A table for people: at most `most` rows."""
    rows = [df.columns, ["---"] * len(df.columns), *[[("" if v is None else str(v)).replace("|", "\\|") for v in r] for r in df.limit(most).collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
