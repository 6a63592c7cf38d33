"""Hashes of words and runs: equal exactly where words and runs are equal, whatever the texts are cut into."""

import random

import numpy as np

from tessella.llm import common, decontam


def test_words(monkeypatch):
    rnd = random.Random(1)
    alphabet = ["a", "A", "b", "é", " ", "\t", "\n", "\x0b", "x", "-", "\x1c", " "]
    texts = ["".join(rnd.choices(alphabet, k=rnd.choice([0, 1, 5, 40, 300]))).encode() for _ in range(400)] + [b"", b" ", b"\n\n", b"y" * 900 + b" a " + b"z" * 700]
    for chunk in (common.CHUNK, 64, 257):
        monkeypatch.setattr(common, "CHUNK", chunk)
        by, of = {}, {}
        for t, h in zip(texts, common.BLANK_WORDS.of(texts), strict=True):
            words = t.lower().split()
            assert len(h) == len(words)
            for w, x in zip(words, h.tolist()):
                assert by.setdefault(w, x) == x and of.setdefault(x, w) == w
        if chunk == common.CHUNK:
            first = by
        assert by == first
    for t, h in zip(texts, decontam.WORDS.of(texts), strict=True):
        assert len(h) == len(t.translate(decontam.TO_WORDS).split())


def test_runs(monkeypatch):
    rnd = np.random.default_rng(2)
    h = common.mixed(rnd.integers(0, 4, 3000).astype(np.uint64))
    for k in (1, 2, 5, 26):
        by, of = {}, {}
        monkeypatch.setattr(common, "CHUNK", 1 << 18)
        runs = common.run_hashes(h, k)
        assert len(runs) == 3001 - k
        for i, x in enumerate(runs.tolist()):
            run = h[i : i + k].tobytes()
            assert by.setdefault(run, x) == x and of.setdefault(x, run) == run
        monkeypatch.setattr(common, "CHUNK", 100)
        assert np.array_equal(common.run_hashes(h, k), runs)
    assert len(common.run_hashes(h[:3], 4)) == 0 and len(common.shingles(h[:3], 4)) == 1 and len(common.shingles(h[:0], 4)) == 0
