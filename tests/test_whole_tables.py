"""Queries over whole tables."""

from tessella.plans import registry


def test_dense_queries_are_all(spark, tmp_path):
    rows = [(i, i % 7, [1.0, float(i), float(i * i % 31)]) for i in range(0, 2600, 5)]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = set(range(0, 2600, 100))
    got = registry.QUERIES["dense_topk"](spark, str(tmp_path)).collect()
    assert {r.query for r in got} == want and len(got) == 10 * len(want)
    assert {r.query for r in registry.QUERIES["dense_parent_pool"](spark, str(tmp_path)).collect()} == want


def test_dense_blocks_are_one_search(spark):
    from tessella.operators import retrieval as R

    items = spark.createDataFrame([(i, [1.0, float(i % 13), float(i)]) for i in range(60)], "doc long, v array<double>")
    queries = items.selectExpr("doc query", "v qv")
    assert sorted(R.dense_blocks(queries, items, 3, block=7).collect()) == sorted(R.dense(queries, items, 3).collect())


def test_section_references_of_all_rows(spark):
    folder = "/root/testdata/sf0.01"
    keys = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey").distinct()
    got = registry.QUERIES["section_xrefs"](spark, folder).select("l_orderkey").distinct()
    assert keys.where("l_orderkey >= 2000").count() > 0 and keys.subtract(got).count() == 0


def test_cue_paragraphs_are_in_the_window(spark, tmp_path):
    import hashlib
    import re

    from tessella.functions.text import CUE

    def brute(text):
        text = text.strip()
        if len(text) <= 16000:
            return text
        cues, left = [], 16000 - 2400 - 7200
        for p in filter(None, map(str.strip, re.split(r"\n\s*\n", text[2400:-7200]))):
            if re.search(CUE, p):
                cues.append(p)
                left -= len(p)
                if left <= 0:
                    break
        gap = "\n\n[...]\n\n"
        return (text[:2400] + (gap + "\n\n".join(cues) if cues else "") + gap + text[-7200:])[:18000]

    plain, cue = "The road was wet and nobody came. " * 9, "In my view the appeal is dismissed. "
    texts = ["", " short\n", "\n\n".join([plain] * 60), "\n\n".join([*[plain] * 20, cue, *[plain] * 20, "We\u00a0hold it so.", "WE hold it so: é", *[plain] * 40])]
    texts += ["\n \n".join([plain, cue * 40] * 60), "\n\n".join([plain] * 20 + [cue * 500] + [plain] * 40), "x" * 16000, "x" * 16001]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n, r.h) for r in registry.QUERIES["cue_window"](spark, str(tmp_path)).collect()}
    assert got == {i: (len(w), hashlib.md5(w.encode()).hexdigest()) for i, w in enumerate(map(brute, texts))}
    assert cue.strip() in brute(texts[3])
