"""Functions, readers, writers, trees, graphs and streams on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import vectors as V
from tessella.operators import graph as G
from tessella.operators import html as H
from tessella.operators import relational as R
from tessella.operators import retrieval as RT
from tessella.operators import trees
from tessella.sources import readers, writers
from tessella.streaming import pipelines


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    L = F.lit
    cases = [
        (T.repair(L("a   b\n\nc")), "a b c"), (T.repair(L("inves­tigated�")), "investigated"), (T.normalize(L("‘a’  “b” – c")), "'a' \"b\" - c"), (T.mojibake(L("don�t")), "don't"),
        (T.year_of(L("1985")), 1985), (T.year_of(L("")), None), (T.year_of(L("circa 1900")), None), (T.query_tokens(L("deed deed gift deed")), ["deed", "gift"]),
        (T.slug(L(" Land & Deeds, Act ")), "land-and-deeds-act"), (T.acronym(L("Registration of Documents Ordinance")), "rdo"), (T.title_case(L("the law of the sea")), "The Law of the Sea"),
        (T.normal_title(L("The Trusts Ordinance")), "trusts"), (T.title_stem(L("Trusts Ordinance (Amendment) Act")), "trusts"), (T.sentences(L("A b. C! d")), ["A b.", "C!", "d"]),
        (T.grounded(L("The deed  is “void” here"), L("x the deed is 'void' here y")), True), (T.grounded(L("short"), L("short")), False), (T.lf_hash(L("a\r\nb\r")) == T.lf_hash(L("a\nb\n")), True),
        (T.script_of(L("abc")), "latin"), (T.script_of(L("ñéü")), "extended"), (T.script_of(L("12")), "none"), (T.null_collapse(L(" N/A ")), None), (T.content_tokens(L("the of")), ["the", "of"]),
        (F.size(T.chunks(F.repeat(L("x"), 4000))), 3), (F.size(T.chunks(L(""))), 0),
    ]
    for k, (column, want) in enumerate(cases):
        assert one(spark, column) == want, k
    assert tuple(one(spark, T.first_number_pair(L("Act 79 of 1988")))) == (79, 1988) and tuple(one(spark, T.first_number_pair(L("20 1977")))) == (20, 1977)
    df = spark.createDataFrame([(x,) for x in ["103", "12B", "2", "12", "Schedule", "12A", "13", "1"]], "s string")
    assert [r.s for r in df.orderBy(*T.natural_order("s")).collect()] == ["1", "2", "12", "12A", "12B", "13", "103", "Schedule"]
    how = lambda t, q, c: one(spark, T.masked_window(L(t), L(q), L(c)))["how"]
    assert [how("see Act 5 s 2 held", "held", "Act 5"), how("it was held", "held", "Act 5"), how("it was", "held", "Act 5")] == ["window-citation-masked", "window-quote-masked", "held-sentence-fallback"]


def test_metrics(spark):
    ranked, gold = F.array(*map(F.lit, ["y1", "x1", "z9", "x2"])), F.array(*map(F.lit, ["x1", "x2"]))
    none = F.expr("cast(array() as array<string>)")
    assert [one(spark, c) for c in (V.recall(ranked, gold, 5), V.complete(ranked, gold, 5), V.reciprocal_rank(ranked, gold), V.precision(ranked, F.array(F.lit("x1")), 5), V.recall(ranked, none, 5), V.reciprocal_rank(none, gold))] == [1.0, 1.0, 0.5, 0.2, 0.0, 0.0]
    assert one(spark, V.wilson(F.lit(0), F.lit(0))[0]) is None and 0 < one(spark, V.wilson(F.lit(5), F.lit(10))[0]) < 0.5
    assert one(spark, V.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0] and one(spark, V.unit(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]


def test_fusion(spark):
    rows = [("q", c, d, i + 1, 1.0) for c, ds in (("lexical", "abc"), ("graph", "bad")) for i, d in enumerate(ds)] + [("q", "graph", "b", 9, 1.0)]
    out = RT.fuse(spark.createDataFrame(rows, "query string, channel string, doc string, rank int, weight double"), limit=3).orderBy("rank").collect()
    assert [r.doc for r in out][:2] == ["a", "b"] and len(out) == 3 and out[0].signals == ["graph", "lexical"]


def test_graph(spark):
    e = G.symmetric(spark.createDataFrame([(1, 2, 1.0), (2, 1, 3.0), (2, 2, 9.0)], "src long, dst long, weight double"))
    assert sorted(map(tuple, e.collect())) == [(1, 2, 3.0), (2, 1, 3.0)]
    got = {r.node: r.score for r in G.personalized(e, spark.createDataFrame([(1,)], "node long"), rounds=2).collect()}
    assert got[1] == pytest.approx(0.75) and got[2] == pytest.approx(0.25)
    w = {r.dst: r.weight for r in G.bridges(spark.createDataFrame([("k", i) for i in range(2)] + [("m", i) for i in range(100, 113)], "k string, node long"), "k", "node").collect()}
    assert w[1] > w[101] > 0


def test_pagerank_to_convergence(spark):
    edges, seeds = [(1, 2, 1.0), (2, 3, 2.0), (2, 1, 1.0), (4, 1, 1.0)], {1: 0.5, 4: 0.5}
    rank = dict(seeds)
    for _ in range(200):
        new = {n: 0.5 * seeds.get(n, 0) for n in (1, 2, 3, 4)}
        for s, d, w in edges:
            new[d] += 0.5 * rank.get(s, 0) * w / sum(x[2] for x in edges if x[0] == s)
        for n in seeds:
            new[n] += 0.5 * rank.get(3, 0) * seeds[n]
        rank = new
    got = G.converged(spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame([(1,), (4,)], "node long"))
    assert {r.node: round(r.score, 4) for r in got.collect()} == {n: round(v, 4) for n, v in rank.items()}


def test_trees_and_html(spark):
    tree = {"id": "p", "text": "P", "children": [{"id": "a", "text": "A", "children": [{"id": "x", "text": "X"}]}, {"id": "b", "text": "B"}]}
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, None), (3, "{")], "k long, t string")
    assert [(r.path, r.subtree, r.depth) for r in trees.flatten(df, "k", "t").collect()] == [("p", "P A X B", 0), ("p/a", "A X", 1), ("p/a/x", "X", 2), ("p/b", "B", 1)]
    page = "<nav>n</nav><h1>T</h1><p>one &amp; <b>two</b></p><p><b>all bold</b></p><script>x('</p>')</script><footer>f</footer><p>no"
    got = H.segments(spark.createDataFrame([(1, page), (2, None)], "k long, h string"), "k", "h", "h1", ("footer",)).collect()
    assert [(r.tag, r.text, r.was_bold) for r in got] == [("h1", "T", False), ("p", "one & two", False), ("p", "all bold", True)]


def test_relational(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, target string"), spark.createDataFrame([(2, "y"), (1, "z"), (3, "w")], "k long, target string")
    assert {r.k: r.band for r in R.two_resolvers(a, b, "k").collect()} == {1: "review", 2: "verified", 3: "review"}
    v = R.intervals(spark.createDataFrame([("s", 1990), ("s", 2000)], "by string, start int"), "by", "start").orderBy("start").collect()
    assert [(r.version_no, r.valid_to, r.is_current) for r in v] == [(1, 2000, False), (2, None, True)]
    got = R.as_of(spark.createDataFrame([("s", 1995), ("s", 1980), ("t", 1)], "by string, at int"), spark.createDataFrame([("s", 1990, 7), ("s", 1999, 8)], "by string, start int, v int"), "by", "at", "start", "v")
    assert {(r.by, r.at): r.v for r in got.collect()} == {("s", 1995): 7, ("s", 1980): None, ("t", 1): None}
    f = lambda rows: R.fingerprint(spark.createDataFrame(rows, "a long, b string"), ["a", "b"]).first().fingerprint
    assert f([(1, "x"), (2, None)]) == f([(2, None), (1, "x")]) != f([(1, "x"), (2, "z")])
    split = R.hash_split(spark.range(100).withColumn("s", F.lit("a")), "s", "id", 0.17, "q")
    assert split.where("split = 'dev'").count() == 17


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,name\n# no\n1,\n2,\"x, y\"\n".encode())
    assert [tuple(r) for r in readers.csv(spark, f"file://{tmp_path}/a.csv", comment="#").collect()] == [("1", ""), ("2", "x, y")]
    assert readers.optional_csv(spark, f"file://{tmp_path}/none.csv", readers.strings("id")).count() == 0
    (tmp_path / "b.jsonl").write_text('{"id": "1"}\n\n{bad\n{"id": "2"}\n')
    assert readers.jsonl(spark, f"file://{tmp_path}/b.jsonl", readers.strings("id"), tolerant=True).count() == 2
    with pytest.raises(ValueError):
        readers.matching(spark.range(3), F.col("id") > 9, "rows")
    root = f"file://{tmp_path}/index"
    first = writers.publish(spark.range(3), root, "f1")
    assert writers.publish(spark.range(9), root, "f1") == first and writers.current(spark, root).count() == 3
    writers.publish(spark.range(5), root, "f2")
    assert writers.current(spark, root).count() == 5
    up = writers.upserted(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string"), ["k"])
    assert sorted(map(tuple, up.collect())) == [(1, "a"), (2, "c")]
    assert not writers.csv(spark.range(0), f"file://{tmp_path}/o") and writers.markdown(spark.range(1)) == "| id |\n| --- |\n| 0 |"
    with pytest.raises(ValueError):
        writers.checked(spark.range(2), 3)


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = pipelines.files(spark, f"{tmp_path}/in", events.schema, per_trigger=1)
    q = pipelines.counts(stream, "ts", "event_type", late="60 days").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) s from counts").first().s == events.count()
    pipelines.upsert(stream, f"file://{tmp_path}/out", ["event_id"], f"{tmp_path}/c2").awaitTermination()
    assert writers.current(spark, f"file://{tmp_path}/out").count() == events.count()
