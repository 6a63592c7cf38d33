"""Quality rules with risk-controlled cutoffs (DataFrame functions only).

Base statistics are counted on whole texts. For each stratum and rule, labelled rows decide how strict a cutoff may be:
walking the fixed grid from its lenient end, a cutoff is certified while the exact binomial test rejects "this cutoff
loses more than `risk` of the good rows" at level delta / (rules * strata); the walk stops at the first cutoff
that fails, so the family-wise error over the grid needs no further division (fixed-sequence testing), and over rules and strata it is
Bonferroni's. Among certified cutoffs the one that rejects most bad rows is used, the most lenient one on a tie.
Since each of the rules has its own share of the risk, all of them together lose at most `risk` of a stratum's good rows.

Defined cases: a null or empty text has no words and fails the base rule; rows without or with null labels don't count;
of repeated labels for an id, a row is good if most say so; a stratum without enough labels has no certified cutoff, so only the base
rule holds there; a null stratum value is a stratum of its own; a text of any length is measured whole; repeated rows are judged each; an empty
table of documents gives an empty one, one of labels no cutoffs. `judge` replaces columns of the names it gives, `clean` leaves all as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import written

#: Characters that separate words, and symbols that count.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: A rule rejects a row whose ratio is above the cutoff. Grid from lenient to strict.
RULES = ("symbol_ratio", "shout_ratio", "dup_line_ratio", "repeat_ratio", "long_words")
GRIDS = {
    "symbol_ratio": (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "shout_ratio": (1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "dup_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.1),
    "repeat_ratio": (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "long_words": (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0),
}


def _let(value: Column, use) -> Column:
    """use(value) with value evaluated once, however often `use` names it and wherever the optimizer moves the result."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Up to this many different repeated windows, their starts are looked up in a list; beyond it, by sorting.
LISTED = 24


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that are found twice or more.

    Window hashes are sorted, equal neighbours name the repeated ones, and the union of their windows is measured. A text
    without any is done after a hash set; with few, a short list tells the starts; with many, (hash, start) pairs are sorted.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    repeated = lambda h: _let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k + 1))))
    listed = lambda h, d: F.filter(F.transform(h, lambda x, k: F.when(F.array_contains(d, x), k)), lambda k: k.isNotNull())
    pairs = lambda h: F.array_sort(F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("i"))))
    beside = lambda s: F.array_sort(
        F.transform(F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"] == x["h"])), lambda x: x["i"])
    )
    union = lambda starts: F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    some = lambda h: _let(repeated(h), lambda d: F.when(F.size(d) <= LISTED, union(listed(h, d))).otherwise(_let(pairs(h), lambda s: union(beside(s)))))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(some(h))))


def statistics(text: Column) -> Column:
    """A struct of the base statistics of one text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    by_word = _let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("c"), _repeat_words(w).alias("r")))
    by_line = _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    return _let(
        F.struct(by_word.alias("w"), by_line.alias("l"), F.regexp_count(t, F.lit(SYMBOLS)).alias("s"), F.regexp_count(t, F.lit("[!?]")).alias("e")),
        lambda x: F.struct(
            x["w"]["n"].cast("long").alias("n_words"),
            x["w"]["c"].cast("long").alias("word_chars"),
            x["s"].cast("long").alias("n_symbols"),
            (x["l"]["n"] - x["l"]["d"]).cast("long").alias("n_dup_lines"),
            x["w"]["r"].cast("long").alias("n_repeat_words"),
            x["l"]["n"].cast("long").alias("n_lines"),
            x["e"].cast("long").alias("n_shouts"),
            ((x["w"]["n"] < 50) | (100 * x["w"]["r"].cast("long") > 50 * x["w"]["n"])).alias("base_failed"),
        ),
    )


#: The columns that annotate() adds.
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "base_failed")


def annotate(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with STATISTICS; existing columns of these names are replaced."""
    keep = [c for c in docs.columns if c not in STATISTICS]
    return docs.select(*keep, statistics(F.col(text)).alias("__stats")).select(*keep, "__stats.*")


def ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_ratio": F.col("n_symbols") / n,
        "shout_ratio": F.col("n_shouts") / n,
        "dup_line_ratio": F.col("n_dup_lines") * 1.0 / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / n,
        "long_words": F.col("word_chars") / n,
    }


def _certified(n: Column, lost: Column, risk: Column, level: Column) -> Column:
    """Exact test: P(X <= lost) <= level for X ~ Binomial(n, risk), by summing log terms."""
    step = F.ln(risk) - F.ln(1 - risk)
    first = n * F.ln(1 - risk)
    tail = F.aggregate(
        F.when(lost > 0, F.sequence(F.lit(1).cast("long"), lost)).otherwise(F.expr("cast(array() as array<bigint>)")),
        F.struct(first.alias("term"), first.alias("total")),
        lambda a, j: F.struct(
            (a["term"] + F.ln((n - j + 1) / j) + step).alias("term"),
            F.greatest(a["total"], a["term"] + F.ln((n - j + 1) / j) + step).alias("top"),
            a["total"].alias("was"),
        ).withField(
            "total",
            F.greatest(a["total"], a["term"] + F.ln((n - j + 1) / j) + step)
            + F.ln(1 + F.exp(-F.abs(a["total"] - (a["term"] + F.ln((n - j + 1) / j) + step)))),
        ).dropFields("top", "was"),
        lambda a: a["total"],
    )
    return (n > 0) & (tail <= F.ln(level))


def cutoffs(stats: DataFrame, labels: DataFrame, stratum: str | None = "lang", key: str = "doc_id", quality: str = "quality", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row per stratum with a struct of certified cutoffs (null: the rule isn't used). stats: annotate() with the key and stratum."""
    good = labels.where(F.col(quality).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg((F.avg(F.col(quality).cast("double")) > 0.5).alias("good"))
    by = F.col(stratum).cast("string") if stratum else F.lit("all")
    rows = (
        stats.select("base_failed", F.col(key).alias("__key"), by.alias("stratum"), *[c.alias(r) for r, c in ratios().items()])
        .join(good, "__key")
    )
    grid = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), F.lit(k).alias("step"), F.lit(float(c)).alias("cutoff"), (F.col(r) > c).alias("out"))
            for r in RULES
            for k, c in enumerate(GRIDS[r])
        ]
    )
    cells = written(
        rows.select("base_failed", "stratum", "good", F.explode(grid).alias("g"))  # a filter here would compute the statistics twice
        .groupBy("stratum", "g.rule", "g.step", "g.cutoff")
        .agg(
            F.count_if(F.col("good") & ~F.col("base_failed")).alias("n"),
            F.count_if(F.col("good") & ~F.col("base_failed") & F.col("g.out")).alias("lost"),
            F.count_if(~F.col("good") & ~F.col("base_failed") & F.col("g.out")).alias("caught"),
        )
    )
    strata = cells.select("stratum").distinct().agg(F.count("*").alias("n_strata"))  # null is one of them
    tested = cells.crossJoin(F.broadcast(strata)).withColumn(  # strata: one row
        "ok", _certified(F.col("n"), F.col("lost"), F.lit(risk / len(RULES)), F.lit(delta / len(RULES)) / F.greatest(F.col("n_strata"), F.lit(1)))
    )
    return (
        tested.groupBy("stratum", "rule")
        .agg(F.min(F.when(~F.col("ok"), F.col("step"))).alias("stop"), F.collect_list(F.struct("step", "cutoff", "caught", "ok")).alias("cells"))  # one cell a grid step
        .withColumn("cells", F.filter("cells", lambda c: c["ok"] & (F.col("stop").isNull() | (c["step"] < F.col("stop"))) & (c["caught"] > 0)))
        .withColumn("best", F.array_max(F.transform("cells", lambda c: F.struct(c["caught"], (-c["step"]).alias("lenient"), c["cutoff"]))))
        .groupBy("stratum")
        .agg(*[F.max(F.when(F.col("rule") == r, F.col("best.cutoff"))).alias(f"cut_{r}") for r in RULES])
    )


#: Cutoff rows (one a stratum) up to this many are broadcast; beyond it, Spark joins by shuffle.
BROADCAST_STRATA = 10_000


def apply_cutoffs(stats: DataFrame, cut: DataFrame, stratum: str | None = "lang") -> DataFrame:
    """stats (with STATISTICS) with kept."""
    by = F.col(stratum).cast("string") if stratum else F.lit("all")
    small = cut.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    cut = F.broadcast(cut) if small else cut
    verdict = F.lit(False)
    for r, ratio in ratios().items():
        verdict = verdict | F.coalesce(ratio > F.col(f"cut_{r}"), F.lit(False))
    joined = stats.withColumn("__stratum", by).join(cut.withColumnRenamed("stratum", "__cut"), F.col("__stratum").eqNullSafe(F.col("__cut")), "left")
    return joined.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(~verdict)).drop("__stratum", "__cut", *[f"cut_{r}" for r in RULES])


def measured(docs: DataFrame, stratum: str | None = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, stratum and STATISTICS of every row, as a narrow table in the shared folder: no text is ever shuffled."""
    keep = list(dict.fromkeys([key, *([stratum] if stratum else [])]))
    return written(annotate(docs.select(*dict.fromkeys([*keep, text])), text).select(*keep, *STATISTICS))


def judge_statistics(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang", key: str = "doc_id", text: str = "text", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """key, stratum, STATISTICS and kept of every row; one pass over the texts."""
    stats = measured(docs, stratum, key, text)
    return apply_cutoffs(stats, written(cutoffs(stats, labels, stratum, key, quality_name(labels), risk, delta)), stratum)


def judged(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang", key: str = "doc_id", text: str = "text", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """`row` (a struct of docs' columns), key as __key, stratum as __stratum, STATISTICS and kept of every row. The texts are measured once, and wait for their
    verdict in the shared folder; they are never shuffled."""
    by = F.col(stratum).cast("string") if stratum else F.lit("all")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("__key"), by.alias("__stratum"), statistics(F.col(text)).alias("__stats"))
    held = written(rows.select("row", "__key", "__stratum", "__stats.*"))
    cut = written(cutoffs(held.drop("row"), labels.withColumnRenamed(key, "__key"), "__stratum", "__key", quality_name(labels), risk, delta))
    return apply_cutoffs(held, cut, "__stratum")


def judge(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang", key: str = "doc_id", text: str = "text", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """docs (all columns) with STATISTICS and kept; existing columns of these names are replaced."""
    ours = (*STATISTICS, "kept")
    out = judged(docs, labels, stratum, key, text, risk, delta)
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ours], *ours)


def clean(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang", key: str = "doc_id", text: str = "text", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of docs that are kept, with all of their columns as they were."""
    return judged(docs, labels, stratum, key, text, risk, delta).where("kept").select("row.*")


def quality_name(labels: DataFrame) -> str:
    return next(c for c in labels.columns if c.lower() == "quality")
