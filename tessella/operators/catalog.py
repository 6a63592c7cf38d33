"""Operators of catalogues and registries: optional filters, ids, lookups, merges of result lists, verdicts, queues, checks."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that hold raw values, and folders that may hold them.
VALUE_COLUMNS = ("value", "expected", "predicted", "verbatimValue", "normalizedValue", "text", "verbatimText", "fullPageTranscript", "reference", "hypothesis")
PRIVATE_FOLDERS = ("runs", "labels")


def optional_filter(df: DataFrame, order: list[str], limit: int | None = None, **wanted: str | None) -> DataFrame:
    """Rows that agree with every given value whatever the case (None: no filter), in the order of the file (`order`), cut to `limit`."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.lower(name) == value.lower())
    return df.orderBy(*order).limit(limit) if limit is not None else df


def pick(df: DataFrame, names: Iterable[str]) -> str | None:
    """The first of the names that is a column of df."""
    return next((n for n in names if n in df.columns), None)


def member_of(value: str, allowed: Iterable[str]) -> str:
    """value, or ValueError with the sorted list of what is allowed."""
    allowed = sorted(allowed)
    if value not in allowed:
        raise ValueError(f"{value!r} is none of {', '.join(allowed)}")
    return value


def guarded(df: DataFrame, path: str) -> DataFrame:
    """df, if it may be written to path: columns with raw values only go under a private folder."""
    leaked = sorted(set(VALUE_COLUMNS) & set(df.columns))
    if leaked and not set(PRIVATE_FOLDERS) & set(path.split("/")):
        raise ValueError(f"columns {leaked} can't be written to {path}")
    return df


def composite_id(source: Column, number: Column) -> Column:
    """source:sN if both are present, else empty."""
    given = lambda c: c.isNotNull() & (F.trim(c) != "")
    return F.when(given(source) & given(number), F.concat(source, F.lit(":s"), number)).otherwise("")


def parsed_id(c: Column) -> Column:
    """(source, number) of SRC001-s2; nulls for anything else."""
    part = lambda k: F.nullif(F.regexp_extract(c, r"^(SRC\d+)-s(\w+)$", k), F.lit(""))
    return F.struct(part(1).alias("source"), part(2).alias("number"))


def chunk_parent(c: Column) -> Column:
    return F.substring_index(c, "#", 1)


def id_tail(c: Column) -> Column:
    return F.upper(F.substring_index(c, ":s", -1))


def expected_ids(c: Column) -> Column:
    """Distinct ids of a `;` list, without blanks and *:NOT_FOUND."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ";"), F.trim), lambda x: (x != "") & ~x.endswith(":NOT_FOUND")))


def direct(queries: DataFrame, ids: DataFrame) -> DataFrame:
    """(query, doc, rank 0) of queries whose whole text is an id; ids: doc. Blank queries find nothing."""
    q = queries.where(F.trim("text") != "").select("query", F.trim("text").alias("__id"))
    return q.join(ids.select("doc", F.col("doc").cast("string").alias("__id")), "__id").select("query", "doc", F.lit(0).alias("rank"))


def merged(results: DataFrame, limit: int = 40) -> DataFrame:
    """Result lists (question, finder, doc, rank, score) of several queries of one question as one: best rank, best score, finders, merged_rank."""
    best = results.groupBy("question", "doc").agg(F.min("rank").alias("best_rank"), F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("finder")), ";").alias("found_by"))
    by = Window.partitionBy("question").orderBy("best_rank", F.desc("score"), "doc")
    return best.withColumn("merged_rank", F.row_number().over(by)).where(F.col("merged_rank") <= limit)


def rejected(df: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """df with the first reason that holds, or null."""
    return df.withColumn("reason", F.coalesce(*[F.when(c, n) for n, c in reasons]))


def queues(df: DataFrame, band: str = "band") -> dict[str, DataFrame]:
    """The accepted, review and unresolved rows as tables of their own; an unknown or missing band is unresolved."""
    at = F.coalesce(F.when(F.col(band).isin("verified", "review"), F.col(band)), F.lit("unresolved"))
    return {q: df.where(at == q) for q in ("verified", "review", "unresolved")}


def last_verdicts(rows: DataFrame, verdicts: DataFrame, key: str, order: str) -> DataFrame:
    """rows with the last verdict of their key; without one, pending."""
    last = verdicts.groupBy(key).agg(F.max_by("verdict", order).alias("verdict"))
    return rows.join(last, key, "left").withColumn("verdict", F.coalesce("verdict", F.lit("pending")))


def collisions(df: DataFrame, key: str, alias: str, live: DataFrame) -> DataFrame:
    """df with `collision`: other keys of the same alias, and whether it is a live alias (alias, key) of another one; none."""
    # Aliases shared by very many keys: the keys' number and their smallest name stand for the list.
    per = df.groupBy(alias).agg(F.count_distinct(key).alias("__n"), F.min(key).alias("__first"))
    taken = live.select(F.col("alias").alias(alias), F.col("key").alias("__key")).groupBy(alias).agg(F.count("*").alias("__live"), F.min("__key").alias("__owner"), F.max("__key").alias("__other"))
    out = df.join(per, alias).join(taken, alias, "left")
    foreign = (F.col("__live") > 0) & ((F.col("__owner") != F.col(key)) | (F.col("__other") != F.col(key)))
    kind = F.when(foreign, "live").when(F.col("__n") > 1, "shared").otherwise("none")
    return out.withColumn("collision", kind).withColumn("owners", F.col("__n")).withColumn("first_owner", F.col("__first")).drop("__n", "__first", "__live", "__owner", "__other")


def stop_rule(matched: Column, most: float = 0.005) -> Column:
    """(unmatched share, whether it is under `most`), as an aggregate."""
    share = F.count_if(~matched) / F.greatest(F.count("*"), F.lit(1))
    return F.struct(F.round(share, 6).alias("share"), (share < most).alias("done"))


def leaks(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that stand in several splits."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def checked_splits(rows: DataFrame, predictions: DataFrame, key: str, group: str, split: str) -> DataFrame:
    """rows, or ValueError if a group stands in several splits or a row has no prediction. Only one offender is fetched."""
    if bad := leaks(rows, group, split).first():
        raise ValueError(f"{bad[0]} stands in several splits")
    if bad := rows.join(predictions.select(key), key, "left_anti").first():
        raise ValueError(f"no prediction for {bad[key]}")
    return rows


def weighted_edges(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """(src, dst, weight) in both directions from edge tables (src, dst); of several, the heaviest counts; no loops."""
    one = lambda df, w: df.select("src", "dst", F.lit(w).alias("weight"))
    e = reduce(DataFrame.unionByName, [one(df, w) for df, w in parts]).where("src <> dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def cited(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answers (question, cited array) with ok: something is cited, and all of it was retrieved. evidence: question, doc."""
    flat = answers.select("question", F.explode("cited").alias("doc")).distinct()
    held = flat.join(evidence.select("question", "doc", F.lit(1).alias("hit")).distinct(), ["question", "doc"], "left").groupBy("question").agg(F.count("*").alias("n"), F.count("hit").alias("n_held"))
    return answers.join(held, "question", "left").withColumn("ok", F.coalesce(F.col("n") == F.col("n_held"), F.lit(False))).select("question", F.coalesce("n", F.lit(0)).alias("n_cited"), F.coalesce("n_held", F.lit(0)).alias("n_held"), "ok")


def with_model(df: DataFrame, column: str, model: Callable[[list[str]], list[str]] | None, out: str = "answer", batch: int = 64) -> DataFrame:
    """df with what an injected model says to `column`, in batches; null where there is no model."""
    if model is None:
        return df.withColumn(out, F.lit(None).cast("string"))
    from pyspark.sql.types import StringType, StructType

    names = [c for c in df.columns if c != out]
    schema = StructType([f for f in df.schema if f.name != out]).add(out, StringType())

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(model([t or "" for t in part.column(column).to_pylist()]), pa.string())], names=[*names, out])

    return df.select(*names).mapInArrow(run, schema)
