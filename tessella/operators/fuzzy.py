"""Fuzzy text operators where Spark has no built-in: grounding by matching blocks, sequence distances, Unicode normalisation, JSON in text."""

from __future__ import annotations

import json
import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """NFKC form."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def covered(quote: str, text: str, share: float = 0.9) -> bool:
    """Whether blocks of the quote cover `share` of it inside one window of twice its length, and the window has all its digits."""
    if not quote or not text:
        return False
    if quote in text:
        return True
    first = max(SequenceMatcher(None, quote, text, autojunk=False).get_matching_blocks(), key=lambda b: b.size)
    if first.size < 4:
        return False
    low = max(0, first.b - first.a - len(quote) // 2)
    window = text[low : low + 2 * len(quote)]
    blocks = SequenceMatcher(None, quote, window, autojunk=False).get_matching_blocks()
    return sum(b.size for b in blocks if b.size > 1) >= share * len(quote) and set(re.findall(r"\d+", quote)) <= set(re.findall(r"\d+", window))


@F.pandas_udf(BooleanType())
def fuzzy_grounded(quote: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([covered(q or "", t or "") for q, t in zip(quote, text)])


def edit_distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@F.pandas_udf(DoubleType())
def word_error_rate(reference: pd.Series, got: pd.Series) -> pd.Series:
    """Word edits over the reference's words; null for an empty reference."""
    return pd.Series([edit_distance((r or "").split(), (g or "").split()) / len(r.split()) if r and r.split() else None for r, g in zip(reference, got)])


def first_object(text: str) -> str | None:
    """The first balanced JSON object in a text that may have fences and prose around it."""
    start = text.find("{")
    decoder = json.JSONDecoder()
    while start >= 0:
        try:
            return json.dumps(decoder.raw_decode(text, start)[0], ensure_ascii=False, sort_keys=True)
        except ValueError:
            start = text.find("{", start + 1)
    return None


@F.pandas_udf(StringType())
def json_object(s: pd.Series) -> pd.Series:
    return s.map(lambda t: first_object(t) if t else None)


def token_f1(a, b):
    """F1 of two texts' token multisets, as a column."""
    from tessella.functions.text import let, tokens

    def score(x, y):
        n = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, w: s + F.least(F.size(F.filter(x, lambda v: v == w)), F.size(F.filter(y, lambda v: v == w))))
        return let(n, lambda k: F.when(k == 0, 0.0).otherwise(2.0 * k / (F.size(x) + F.size(y))))

    return let(F.struct(tokens(a).alias("x"), tokens(b).alias("y")), lambda p: score(p["x"], p["y"]))
