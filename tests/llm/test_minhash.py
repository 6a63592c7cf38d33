import random

import numpy as np

from tessella.llm import minhash as mh


def brute(rows, k, percent):
    def shingles(t):
        w = (t or "").lower().encode().decode().split(" ")
        w = [x for x in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")).split(" ") if x]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(sets[i]), low[find(i)], low[find(i)] == d) for i, (d, _) in enumerate(rows)]


def family(rnd, size, words, edits):
    base = [f"w{rnd.randint(0, 300)}" for _ in range(words)]
    for _ in range(size):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 10**6)}"
        yield " ".join(w)


def test_groups_match_brute_force(spark, monkeypatch):
    rnd = random.Random(11)
    monkeypatch.setattr(mh, "GROUP", 16)
    texts = [t for size, words, edits in ((40, 80, 4), (30, 120, 9), (25, 40, 3), (20, 200, 10), (3, 9, 1), (60, 60, 0)) for t in family(rnd, size, words, edits)]
    texts += [None, "", "  \n", "A b", "a B", "a b c", "ÀB c", "àB c", "x" * 3000] + [" ".join(f"r{rnd.randint(0, 50)}" for _ in range(30)) for _ in range(60)]
    rnd.shuffle(texts)
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "clash", None) for r in rows], "doc_id long, text string, kept string, component_id long").repartition(5)
    for k in (4, 5):
        got = sorted((r.id, r.n_shingles, r.component_id, r.kept) for r in mh.groups(df, k).collect())
        assert got == sorted(brute(rows, k, 80))
    left = mh.deduplicated(df, 4)
    assert sorted(r.doc_id for r in left.collect()) == sorted(r[0] for r in brute(rows, 4, 80) if r[3]) and left.columns == df.columns
    assert mh.groups(df.limit(0), 4).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (4, "a b c d e")], "doc_id long, text string")
    assert sorted(((r.id, r.component_id, r.kept) for r in mh.groups(odd, 4).collect()), key=str) == [(3, 3, True), (3, 3, True), (4, 3, False), (None, None, False)]
    assert mh.deduplicated(odd, 4).count() == 3


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (202, 201), (5, 5)]
    got = {r.id: r.root for r in mh.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200}


def test_sketches_estimate_similarity():
    rnd = np.random.default_rng(4)
    for j in (0.7, 0.8, 0.9, 1.0):
        errors = []
        for _ in range(60):
            n = 600
            both = int(2 * n * j / (1 + j))
            x = rnd.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            a, b = (np.frombuffer(mh.sketch_of(mh.signature(s)), np.uint64) for s in (x[:n], x[n - both :]))
            errors.append(mh.estimate(np.bitwise_count(a ^ b).sum()) - j)
        assert abs(np.mean(errors)) < 0.03 and np.min(errors) > -0.16


def test_repeated_ids_are_compared_by_their_own_texts(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(10):
        one, other = ([f"t{i}{side}{rnd.randint(0, 400)}" for _ in range(60)] for side in "ab")
        near = [list(one), list(other)]
        for w in near:
            w[5] = "edited"
        rows += [(1000 + i, " ".join(one)), (1000 + i, " ".join(other)), (10 * i, " ".join(near[0])), (10 * i + 1, " ".join(near[1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.id, r.component_id) for r in mh.groups(df, 4).collect())
    assert got == sorted([(1000 + i, 10 * i + x) for i in range(10) for x in (0, 1)] + [(10 * i + x, 10 * i + x) for i in range(10) for x in (0, 1)])
    both = spark.createDataFrame([(1, rows[0][1]), (3, rows[2][1]), (3, rows[1][1])], "doc_id long, text string")
    assert sorted(r.text for r in mh.deduplicated(both, 4).collect()) == sorted([rows[0][1], rows[1][1]])


def test_a_large_family_around_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(mh, "GROUP", 64)
    rnd = random.Random(8)
    texts = list(family(rnd, 700, 100, 9))
    rows = list(enumerate(texts))
    got = sorted((r.id, r.n_shingles, r.component_id, r.kept) for r in mh.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 4).collect())
    want = sorted(brute(rows, 4, 80))
    assert got == want and 20 < sum(r[3] for r in want) < 680
