import hashlib
import random

import pytest

from public_tokenizers import path
from tessella.llm import bpe

TEXTS = [None, "", " ", "\n\n", "a", "  a  b \n c\t\td  ", "don't we'll I'M it's'fine", "héllo wörld — ñandú ß", "日本語 テキスト 🎉🎉", "x" * 5000, "abc" * 2000, "1234567 89.12", "<|endoftext|>a <|endoftext|> b<|endoftext|>", "a b c\x1cd\x85e", "\n a\n b", "a\nb\n\nc \nd", "THEDNT!! EDHEAN!! TOSTOUHE!!", "Thnd*** iner*** ththsh$$$ a,%%% be,&&&", "a\r\nb\r\n", "﻿x", "aaaaaaa bbbb hhhhhh eeee tttt"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path("byte_bpe_50k.json"))


def test_ids_equal_the_library(library):
    ours, rnd = bpe.tokenizer(path("byte_bpe_50k.json")), random.Random(7)
    words = [ours.bytes_of[i].decode("utf-8", "ignore") for i in rnd.sample(range(50256), 3000)]
    mixes = ["".join(rnd.choices(words, k=rnd.randint(1, 12))) for _ in range(3000)]
    mixes += ["".join(rnd.choices("aehinorst ,.\n'", k=rnd.randint(1, 60))) for _ in range(3000)]
    mixes += ["".join(rnd.choices("ab", k=rnd.randint(1, 60))) for _ in range(300)]
    all_texts = [t or "" for t in TEXTS] + mixes
    for t, many in zip(all_texts, ours.encode_many(all_texts)):
        assert many == ours.encode(t)
        want = library.encode(t, add_special_tokens=False).ids
        assert ours.encode(t) == want, t
        assert ours.decode(want) == library.decode(want, skip_special_tokens=False)


def test_query_digests(spark, library):
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)] + [(0, None, "twice")], "doc_id long, text string, n_tokens string")
    got = bpe.digests(df, path("byte_bpe_50k.json")).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        t = TEXTS[r.doc_id] or ""
        ids = library.encode(t, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(df.limit(0), path("byte_bpe_50k.json")).count() == 0


def test_round_trip(spark):
    p = path("byte_bpe_50k.json")
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, token_ids int")
    back = bpe.decoded(bpe.encoded(df, p), p, text="back").collect()
    assert all(r.back == (r.text or "") for r in back) and len(back) == len(TEXTS)
