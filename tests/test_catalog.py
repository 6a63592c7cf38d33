"""Catalogue operators on small cases; their queries are held against SQL in test_queries.py."""

import pytest

from tessella.functions import text as T
from tessella.operators import catalog as C
from tessella.operators import relational as R


def test_members_and_columns(spark):
    assert C.member_of("b", {"a", "b"}) == "b"
    with pytest.raises(ValueError, match="a, b"):
        C.member_of("c", {"b", "a"})
    df = spark.createDataFrame([(1, "x")], "id long, text string")
    assert C.pick(df, ("score", "text", "id")) == "text" and C.pick(df, ("score",)) is None


def test_privacy_guard(spark):
    df = spark.createDataFrame([(1, "x")], "id long, text string")
    with pytest.raises(ValueError, match="text"):
        C.guarded(df, "reports/out.csv")
    assert C.guarded(df, "runs/a/out.csv") is df and C.guarded(df.drop("text"), "reports/out.csv").columns == ["id"]


def test_split_validation(spark):
    rows = spark.createDataFrame([("q1", "m1", "test"), ("q2", "m1", "dev"), ("q3", "m2", "dev")], "q string, m string, split string")
    with pytest.raises(ValueError, match="m1"):
        C.checked_splits(rows, rows, "q", "m", "split")
    fine = rows.where("q <> 'q1'")
    with pytest.raises(ValueError, match="q3"):
        C.checked_splits(fine, rows.where("q = 'q2'"), "q", "m", "split")
    assert C.checked_splits(fine, rows, "q", "m", "split").count() == 2


def test_injected_model(spark):
    df = spark.createDataFrame([(i, None if i == 3 else f"t{i}") for i in range(10)], "id long, text string")
    got = {r.id: r.answer for r in C.with_model(df, "text", lambda xs: [x.upper() for x in xs], batch=3).collect()}
    assert got == {i: "" if i == 3 else f"T{i}" for i in range(10)}
    assert all(r.answer is None for r in C.with_model(df, "text", None).collect())


def test_earliest_session_and_markers(spark):
    df = spark.createDataFrame([("OCTOBER 2021 / APRIL 2022",), ("circa 2020",), (None,)], "s string")
    assert [r[0] for r in df.select(T.earliest_session("s")).collect()] == ["2021-10", None, None]
    m = spark.createDataFrame([("Title of it [50, 79 of 1980] [3A, 4  of 1981].",), ("none",)], "s string").select(T.split_markers("s").alias("m")).collect()
    assert m[0].m.heading == "Title of it" and [tuple(x) for x in m[0].m.markers] == [("50", "79 of 1980"), ("3A", "4  of 1981")] and m[1].m.markers == []


def test_as_of_gives_the_latest_version_even_if_its_value_is_null(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, at int")
    right = spark.createDataFrame([("a", 2, "old"), ("a", 4, None), ("b", 9, "new")], "k string, start int, v string")
    got = {(r.k, r["at"]): r.v for r in R.as_of(left, right, "k", "at", "start", "v").collect()}
    assert got == {("a", 5): None, ("a", 1): None, ("b", 9): "new"}


def test_numbered_over_ranges(spark):
    df = spark.createDataFrame([(None if i % 7 == 0 else i * 37 % 101, i) for i in range(300)], "a long, b long")
    got = [(r.a, r.b) for r in sorted(R.numbered(df, ["a", "b"], "n").collect(), key=lambda r: r.n)]
    assert got == sorted(got, key=lambda x: (x[0] is not None, x[0] or 0, x[1])) and len(got) == 300
    assert sorted(r.n for r in R.numbered(df, ["a", "b"], "n").collect()) == list(range(1, 301))
    assert R.numbered(df.limit(0), ["a"], "n").count() == 0
