"""Readers. Schemas are declared, blanks are empty strings, and a missing optional file is an empty table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def csv(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None, comment: str | None = None) -> DataFrame:
    """A CSV with header, all strings, blanks kept as "", a byte-order mark ignored; `comment` drops lines that start with it; `columns` are read only."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
    df = (reader.option("comment", comment) if comment else reader).csv(path)
    df = df.toDF(*[c.removeprefix("﻿") for c in df.columns])
    return (df.select(*columns) if columns else df).na.fill("")


def optional_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return csv(spark, path) if exists(spark, path) else spark.createDataFrame([], schema)


def jsonl(spark: SparkSession, path: str, schema: StructType, tolerant: bool = False) -> DataFrame:
    """JSON lines without blank ones; bad lines raise, or are dropped when tolerant."""
    if not tolerant:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    marked = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", marked, {"mode": "PERMISSIVE"}).alias("x"))
    return rows.where(F.col("x._corrupt_record").isNull()).select(*[F.col(f"x.`{f.name}`") for f in schema.fields])


def matching(df: DataFrame, condition, what: str) -> DataFrame:
    """Rows of a strict condition (null is no match); raises when there are none."""
    out = df.where(F.coalesce(condition, F.lit(False)))
    if out.isEmpty():
        raise ValueError(f"no {what}")
    return out


def whole_texts(spark: SparkSession, path: str, pattern: str = "*", encoding: str = "UTF-8") -> DataFrame:
    """(path, text) of every file below path; undecodable bytes become U+FFFD."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return raw.select("path", F.decode("content", encoding).alias("text"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc) of one JSON document a file, as VARIANT; files that don't parse have null."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("doc"))


def statute_nodes(documents: DataFrame, key: str, tree: str) -> DataFrame:
    """Flattens a tree of {id, text, children} (JSON text) into (key, path, text, depth), children below their parent."""
    from tessella.operators.trees import flatten

    return flatten(documents, key, tree)
