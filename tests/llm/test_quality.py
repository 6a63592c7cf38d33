import zlib

import numpy as np

from tessella.llm import quality as q


def test_identity_equals_all_pairs():
    rng = np.random.default_rng(0)
    m = q.Machine(0.3, rng.normal(size=q.SIZE), rng.normal(size=(q.SIZE, 4)) * 0.1)
    index, values = rng.choice(q.SIZE, 30, replace=False), rng.normal(size=30)
    pairs = sum(m.v[index[i]] @ m.v[index[j]] * values[i] * values[j] for i in range(30) for j in range(i))
    want = 1 / (1 + np.exp(-(0.3 + m.w[index] @ values + pairs)))
    assert abs(m.score(index, values) - want) < 1e-9


def test_interactions_are_learned():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(1500):  # label is whether exactly one of two features is there: no linear score tells
        a, b = rng.integers(0, 2, 2)
        rows.append((np.array([10 + a, 20 + b], np.int32), np.ones(2, np.float32), int(a != b)))
    m = q.fit(rows, epochs=40, rate=0.1)
    assert np.mean([(m.score(i, v) > 0.5) == y for i, v, y in rows]) > 0.99


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = q.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got) and len(got) > 50
    good, bad = [[r.score for r in got if r.quality == y] for y in (1, 0)]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([r.predicted == r.quality for r in got]) > 0.85


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "a b", None), (None, "w " * 1000, "z"), (3, "x" * 10**5, "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, None), (9, 0)], "doc_id long, quality int")
    got = q.scored(docs, labels, metadata=("score",)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert q.scored(docs, labels.limit(0)).count() == 5 and q.scored(docs.limit(0), labels).count() == 0
