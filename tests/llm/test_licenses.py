import re

import pytest

from tessella.llm import licenses as lic


@pytest.fixture(scope="module")
def model(spark):
    return lic.trained(spark)


def test_statements_and_other_text(spark, model):
    rows = [(f, frame.format(name)) for f in lic.FAMILIES for name in lic.NAMES[f] for k, frame in enumerate(lic.FRAMES) if k in lic.HELD_OUT]
    rows += [(f, t) for f, ts in lic.OPENINGS.items() for t in ts]
    other = ["She showed her driving license to the guard.", "The and of to a", "Thnd erth onti the er.", "Copyright is a right.", "x " * 5000, "", "the terms of the treaty"]
    df = spark.createDataFrame([(i, t, f, "clash") for i, (f, t) in enumerate(rows + [("", t) for t in other])], "doc_id long, text string, want string, families string")
    got = {r.doc_id: r for r in lic.scanned(df, model=model).collect()}
    right = sum(got[i]["families"] == [f] for i, (f, _) in enumerate(rows))
    assert right / len(rows) > 0.93, [(rows[i], got[i]) for i in range(len(rows)) if got[i]["families"] != [rows[i][0]]][:5]
    assert all(got[len(rows) + i]["families"] == [] for i in range(len(other)))


def test_documents(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = {"MIT License": "MIT", "GNU General Public License, version 3": "GPL", "CC BY-NC 4.0": "CC-BY-NC", "Apache License, Version 2.0": "Apache-2.0"}
    want = {r.doc_id: sorted({names[m] for m in re.findall("|".join(names), r.text)}) for r in docs.collect()}
    got = {r.doc_id: r["families"] for r in lic.scanned(docs, model=model).collect()}
    assert all(set(want[d]) <= set(f) for d, f in got.items()) and any(want.values())
    assert sum(got[d] != want[d] for d in got) <= 2  # cut statements such as "under the MIT"


def test_edges(spark, model):
    df = spark.createDataFrame([(1, None), (1, ""), (None, "Released under the MIT License.\n\nReleased under the MIT License.")], "doc_id long, text string")
    got = lic.scanned(df, model=model).collect()
    assert sorted((r.n_paragraphs, r.n_confirmed) for r in got) == [(0, 0), (0, 0), (2, 2)]
    assert lic.scanned(df.limit(0), model=model).count() == 0


def test_wrapped_openings_and_several_families(spark, model):
    import textwrap

    words = "the river ran past the old mill and the town beyond it slept under the snow".split()
    cases = [(textwrap.fill(o, width), [f]) for f, os in lic.OPENINGS.items() for o in os for width in (60, 72, 80) if not o.startswith("you may not use")]  # that has no n-gram of the model
    bsd = "\n".join(f" * {x}" for x in textwrap.wrap(" ".join(lic.OPENINGS["BSD"]), 70))
    cases += [
        (bsd, ["BSD"]),
        (" ".join(words * 9) + "\n" + textwrap.fill(lic.OPENINGS["MIT"][0], 72) + "\n" + " ".join(words * 9), ["MIT"]),
        ("Licensed under MIT or Apache-2.0.", ["Apache-2.0", "MIT"]),
        ("Licensed under the MIT License or the Apache License, Version 2.0.", ["Apache-2.0", "MIT"]),
        ("Licensed under the GNU Lesser General Public License.\nLicensed under the GNU General Public License.", ["GPL", "LGPL"]),
        (" ".join(words * 2) + " mit er. Licensed under CC BY-NC 4.0.", ["CC-BY-NC"]),
        (textwrap.fill(lic.OPENINGS["LGPL"][0] + " as published by the Free Software Foundation", 72), ["LGPL"]),
        (textwrap.fill("This library is released under the GNU Lesser General Public License.", 44), ["LGPL"]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in lic.scanned(df, model=model).collect()}
    assert not [(t, f, got[i]) for i, (t, f) in enumerate(cases) if got[i].families != f]
    assert got[len(cases) - 8].n_paragraphs == 1
