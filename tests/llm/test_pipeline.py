"""The pipeline against brute force, stage by stage and as a whole."""

import corpus_pipeline as cp
from public_tokenizers import path
from tests.llm.test_decontam import brute as hits
from tests.llm.test_minhash import brute as groups
from tests.llm.test_rules import brute as statistics
from tessella.llm import pii

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path(cp.TOKENIZER))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5

    out = cp.written(cp.STAGES[0][1](spark, docs, FOLDER))
    kept = {r.doc_id for r in out.collect()}
    passing = {i for i, r in rows.items() if not statistics(r.text)[-1]}
    assert kept <= passing and out.columns == columns
    assert not [i for i in passing - kept if labels.get(i) == 1]

    out = cp.written(cp.STAGES[1][1](spark, out, FOLDER))
    want = {d for d, _, _, first in groups([(i, rows[i].text) for i in sorted(kept)], 5, 80) if first}
    kept = {r.doc_id for r in out.collect()}
    assert kept == want and out.columns == columns

    out = cp.written(cp.STAGES[2][1](spark, out, FOLDER))
    want = {i for i in kept if not hits(rows[i].text, items)[1]}
    kept = {r.doc_id for r in out.collect()}
    assert kept == want and out.columns == columns

    out = cp.written(cp.STAGES[3][1](spark, out, FOLDER))
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts == {i: pii.mask(rows[i].text) for i in kept} and out.columns == columns

    got = cp.run(spark, FOLDER).collect()
    assert {r.doc_id: list(r.token_ids) for r in got} == {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    assert all(r.n_chars == len(r.text) for r in got)


def test_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None), (1, "", "en", "s", 0), (None, "x y " * 60, None, "s", 1), (5, "w " + " ".join(f"q{i}" for i in range(60)), None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for t, df in (("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    for rows in (docs, docs.limit(0)):
        out = rows
        for _, stage in cp.STAGES:
            out = cp.written(stage(spark, out, f"file://{tmp_path}"))
        assert [r.doc_id for r in out.collect()] == ([5] if rows is docs else [])
