import pandas as pd
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.operators import fuzzy as Z


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_boxes(spark):
    L = F.lit
    assert tuple(one(spark, G.from_pixels(L(-5), L(50), L(100), L(20), L(200), L(100)))) == (0.0, 0.2, 0.5, 0.5)
    b = G.box(L(0.1), L(0.2), L(0.3), L(0.4))
    assert [round(x, 6) for x in one(spark, G.affine(b, (0, -1, 1, 1, 0, 0)))] == [0.6, 0.1, 0.8, 0.3]
    assert one(spark, G.contains(G.box(L(0.1), L(0.1), L(0.5), L(0.5)), b)) is True


def test_orientation(spark):
    rows = [("a", 90.0, 0.9)] * 6 + [("a", 0.0, 0.1)] * 9 + [("b", 0.0, 0.9)] * 3 + [("c", 0.0, 0.9)] * 3 + [("c", 180.0, 0.9)] * 3 + [("d", -1.0, 0.9)] * 5 + [("e", 0.0, 0.1)]
    got = {r.p: r.orientation for r in G.orientation(spark.createDataFrame(rows, "p string, t double, c double"), "p", "t", "c").collect()}
    assert got == {"a": "90", "b": "uncertain", "c": "uncertain", "d": "0", "e": "uncertain"}


def test_fuzzy(spark):
    df = spark.createDataFrame([("the deed of gift was void in 1987", "held that the deed of gift was vold in 1987 and so on"), ("the deed of gift was void in 1987", "held that the deed of gift was vold in 1988 and so"), (None, "x"), ("abc def", None)], "q string, t string")
    got = df.select(Z.fuzzy_grounded("q", "t").alias("g"), Z.word_error_rate("q", "t").alias("w"), Z.token_f1("q", "t").alias("f")).collect()
    assert [r.g for r in got] == [True, False, False, False] and got[2].w is None and got[3].w == 1.0 and 0.6 < got[0].f < 1
    assert Z.first_object('x ```json\n{"a": {"b": 1}}\n``` {') == '{"a": {"b": 1}}' and Z.first_object("no {") is None
    assert one(spark, Z.nfkc(F.lit("ﬁ①"))) == "fi1"
    assert isinstance(pd.Series([1]), pd.Series)
