import math
import re
from collections import Counter

from tessella.llm import rules


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))


TEXTS = [None, "", "  \n\t", "a b c a b c", "a a a a a", "x\ny\nx\n\n", "é|é <b> \x0b\x0c z", "one two three " * 40, "\n".join(["same line"] * 30), " ".join(f"w{i}" for i in range(60)), "a b", "a b c", "w w w a"]


def test_statistics_match_brute_force(spark):
    rows = [(i, t, None, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string")
    got = rules.annotate(df.drop("n_words")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text), r


def test_exact_binomial_bound(spark):
    from pyspark.sql import functions as F

    cases = [(n, k, r, lv) for n in (1, 50, 400, 3000) for k in (0, 1, 5, 40) if k <= n for r in (0.01, 0.05) for lv in (0.05, 0.001)]
    df = spark.createDataFrame(cases, "n long, k long, risk double, level double")
    for r in df.withColumn("ok", rules._certified(F.col("n"), F.col("k"), F.col("risk"), F.col("level"))).collect():
        tail = sum(math.comb(r.n, j) * r.risk**j * (1 - r.risk) ** (r.n - j) for j in range(r.k + 1))
        assert r.ok == (tail <= r.level), r


def test_verdicts(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    junk = " ".join(f"word{i}***" for i in range(80))
    docs = spark.createDataFrame([(i, junk if i % 5 == 0 else clean, "en", "s") for i in range(4000)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 4000)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in rules.judge(docs, labels).collect()}
    assert all(got[i] == (i % 5 > 0) for i in range(4000))
    assert got == {r.doc_id: r.kept for r in rules.judge_statistics(docs, labels).collect()}
    none = rules.judge(docs, labels.limit(0)).collect()
    assert all(r.kept for r in none) and len(none) == 4000
    assert rules.judge(docs.limit(0), labels).count() == 0


def test_a_null_stratum_counts_in_the_division(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(60)), None if i % 2 else "en") for i in range(400)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(400)], "doc_id long, quality int")
    cut = rules.cutoffs(rules.measured(docs), labels)
    assert sorted((r.stratum for r in cut.collect()), key=str) == [None, "en"]
    assert len(set(map(str, (r[1:] for r in cut.collect())))) == 1


def test_clean_leaves_columns_as_they_are(spark):
    text = " ".join(f"w{j}" for j in range(60))
    docs = spark.createDataFrame([(1, text, "en", "mine", False, 3), (2, "short", "en", "x", True, 4), (1, text, None, None, None, None)], "doc_id long, text string, lang string, n_words string, kept boolean, __key int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = rules.clean(docs, labels)
    assert out.columns == docs.columns and sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, text, "en", "mine", False, 3), (1, text, None, None, None, None)], key=str)


def cutoffs_by_hand(rows, risk=0.02, delta=0.05):
    """rows: (stratum, good, ratios by rule), base failures left out -> stratum -> rule -> cutoff."""
    strata = {s for s, _, _ in rows}
    level = delta / len(rules.RULES) / len(strata)
    out = {}
    for s in strata:
        for rule in rules.RULES:
            good = [r[rule] for x, g, r in rows if x == s and g]
            bad = [r[rule] for x, g, r in rows if x == s and not g]
            best = None
            for k, c in enumerate(rules.GRIDS[rule]):
                lost, p = sum(x > c for x in good), risk / len(rules.RULES)
                if not good or sum(math.comb(len(good), j) * p**j * (1 - p) ** (len(good) - j) for j in range(lost + 1)) > level:
                    break
                caught = sum(x > c for x in bad)
                if caught and (best is None or caught > best[0]):
                    best = (caught, c)
            out.setdefault(s, {})[rule] = best and best[1]
    return out


def test_cutoffs_and_verdicts_match_brute_force(spark):
    import random

    rnd = random.Random(2)
    docs, labels = [], []
    for i in range(3000):
        junk = rnd.random() < 0.2
        words = [f"w{rnd.randint(0, 10**6)}" + ("*" if junk and rnd.random() < 0.7 else "") + ("!" if rnd.random() < 0.05 else "") for _ in range(rnd.randint(51, 70))]
        lang = ("en", "de", None)[0 if i < 2000 else 1 + i % 2]
        docs.append((i, " ".join(words), lang))
        labels.append((i, int(not junk)))
    df, lb = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")

    def ratios(t):
        n, chars, symbols, dup, repeat, _ = brute(t)
        lines = [x for x in t.split("\n") if x.strip()]
        return {"symbol_ratio": symbols / n, "shout_ratio": len(re.findall("[!?]", t)) / n, "dup_line_ratio": dup / max(len(lines), 1), "repeat_ratio": repeat / n, "long_words": chars / n}

    want = cutoffs_by_hand([(lang, labels[i][1], ratios(t)) for i, t, lang in docs])
    got = {r.stratum: {x: r[f"cut_{x}"] for x in rules.RULES} for r in rules.cutoffs(rules.measured(df), lb).collect()}
    assert got == want and any(want["en"].values())
    kept = {r.doc_id: r.kept for r in rules.judge_statistics(df, lb).collect()}
    assert kept == {i: not any(want[lang][x] is not None and v > want[lang][x] for x, v in ratios(t).items()) for i, t, lang in docs}
