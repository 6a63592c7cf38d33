import hashlib
import random
import re

from tessella.llm import decontam as dc


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(doc, items):
    w, hit, got = words(doc), set(), []
    for i, t in items:
        v, found = words(t), False
        n = min(10, len(v))
        grams = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)} if v else set()
        for s in range(len(w) - n + 1) if v else ():
            if tuple(w[s : s + n]) in grams:
                hit.update(range(s, s + n))
                found = True
        if found:
            got.append(i)
    return len(w), len(hit), sorted(set(got))


def data():
    rnd = random.Random(3)
    vocab = ["a", "B", "é1", "ñx", "zz", "the", "of", "x9"]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)] + [(12, None), (13, ""), (14, "..!"), (3, "The, OF zz"), (None, "a")]
    docs = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([0, 2, 8, 40, 300])))) for i in range(60)]
    docs += [(60 + i, "x y z, " + (t or "") + " q-r") for i, (_, t) in enumerate(items)] + [(90, None), (91, ""), (91, items[2][1]), (None, items[5][1]), (92, (items[4][1] + " ") * 500)]
    return docs, items


def test_report_matches_brute_force(spark, monkeypatch):
    docs, items = data()
    df = spark.createDataFrame([(*d, "clash", 7) for d in docs], "doc_id long, text string, items string, n_words int")
    it = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, hits string")
    want = sorted(((d, *brute(t, [x for x in items if x[0] is not None])) for d, t in docs), key=str)
    for block, segment in ((1 << 20, 1 << 20), (20, 300)):
        monkeypatch.setattr(dc, "BLOCK_WORDS", block)
        got = dc.report(df, it).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == want
        for r in got:
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest()
            assert r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"])
    assert sorted(str(r.doc_id) for r in dc.clean(df, it).collect()) == sorted(str(d) for d, _, n, _ in want if not n)  # each row by its own text
    assert dc.report(df.limit(0), it).count() == 0
    assert all(r.n_hit == 0 for r in dc.report(df, it.limit(0)).collect())


def test_proximity():
    import numpy as np

    h = lambda t: next(dc.WORDS.of([t]))
    seg = dc.Segment(dc._segment([5, 6], [1, 2], [h(b"a q b r c"), h(b"a b x y z c")]))
    for slop, want in ((0, set()), (2, {(0, 1)}), (3, {(0, 1), (1, 1)})):
        _, pairs, close = seg.search([(1, h(b"a b c"))], 10, slop)
        assert close == want and not pairs
    assert np.array_equal(seg.phrase(seg.numbers(h(b"a b")), np.array([2, 2])), [seg.base[1]])


def test_proximity_matches_brute_force(spark):
    docs, items = data()
    items = [x for x in items if x[0] is not None]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")

    def near(t, slop):
        w, got = words(t), set()
        for i, v in ((i, words(v)) for i, v in items):
            n = min(10, len(v))
            for g in {tuple(v[s : s + n]) for s in range(len(v) - n + 1)} if v else ():
                for s in range(len(w)):
                    at = s if w[s] == g[0] else None
                    for x in g[1:]:
                        at = next((j for j in range(at + 1, len(w)) if w[j] == x), None) if at is not None else None
                    if at is not None and at - s < n + slop:
                        got.add(i)
        return sorted(got)

    for slop in (1, 2):
        got = sorted(((r.doc_id, list(r.near)) for r in dc.report(df, it, slop=slop).collect()), key=str)
        assert got == sorted(((d, near(t, slop)) for d, t in docs), key=str)


def test_rows_of_one_id_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_WORDS", 3)
    monkeypatch.setattr(dc, "SEGMENT_TOKENS", 4)
    docs = spark.createDataFrame([(1, "a b c d"), (1, "d c b a"), (1, "a b c d"), (None, "x a b c y")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c"), (2, "q r s"), (3, "d c b a"), (4, "z z z")], "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, list(r["items"])) for r in dc.report(docs, items).collect()), key=str)
    assert got == sorted([(1, 4, [1]), (1, 4, [3]), (1, 4, [1]), (None, 5, [1])], key=str)
    one = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert [r.text for r in dc.clean(docs, one).collect()] == ["d c b a"]
