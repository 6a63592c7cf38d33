import importlib

import __spark_entry__ as entry


def test_entry_and_names(spark):
    importlib.reload(entry)
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    df = entry.entry(spark)
    assert df.columns == ["query", "doc", "score", "rank"] and df.count() > 0
    if entry.llm_queries is not None:
        assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)} and "pipeline" in names
