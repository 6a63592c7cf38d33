import random
import zlib

import numpy as np
import pytest

from public_tokenizers import path
from tessella.llm import token_files as tf
from tessella.llm.common import shared_folder

TEXTS = [None, "", " ", "a", "  a  b \n c\t\td", "Don't we'll I'M it's'fine rock'n'roll", "HÉLLO Wörld — ÑANDÚ ß İ", "日本語 🎉🎉", "x" * 3000, "1234567 89.12!!", "<|endoftext|>a <|startoftext|> b", "a\x1cb\x85c d", "THEDNT!! EDHEAN!!", "Thnd*** iner&&&", "é a ́b", "'s 't 'so x's.", "a.b c,d -- e-f"]


def test_packing_round_trips():
    rnd = np.random.default_rng(1)
    for width in (1, 3, 7, 8, 13, 16, 17, 20, 32):
        ids = rnd.integers(0, 1 << width, 1001, dtype=np.uint64)
        data = tf.pack(ids, width)
        assert len(data) == -(-1001 * width // 8)
        for a, n in ((0, 1001), (5, 1), (999, 2), (17, 500), (0, 0)):
            assert (tf.unpack(data, width, a, n) == ids[a : a + n]).all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_files_match_the_library(spark, monkeypatch, name):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tf, "BLOCK_IDS", 300)
    lib, rnd = Tokenizer.from_file(path(name)), random.Random(5)
    rows = [(i * 7 % 101, t) for i, t in enumerate(TEXTS)] + [(200 + i, "".join(rnd.choices("abTh'. ,é1\n", k=rnd.randint(0, 80)))) for i in range(150)] + [(200, "again"), (None, "no id")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, start string").repartition(5)
    folder = tf.write(df, path(name), shared_folder(spark))
    got = tf.documents(spark, folder).collect()
    ids = [[*lib.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows]
    want = sorted((-1 if d is None else d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, _), x in zip(rows, ids))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.concatenate([[0], np.cumsum([r.n_tokens for r in ordered])[:-1]]).tolist()
    keys = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert keys == sorted(keys)
    a = ordered[40]
    assert zlib.crc32(tf.slice_of(spark, folder, a.start, a.n_tokens).tobytes()) == a.ids_crc32
    assert tf.digests(df.limit(0), path(name)).count() == 0
