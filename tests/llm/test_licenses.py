import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import licenses


def _prose(draw, n=60):
    words = ["river", "the", "of", "software", "stone", "and", "to", "house", "use", "is", "license", "work", "free", "garden"]
    return ". ".join(" ".join(draw.choice(words) for _ in range(9)) for _ in range(n // 9)) + "."


@pytest.fixture(scope="module")
def scanner():
    draw = random.Random(0)
    return licenses._Scanner(licenses.fit([_prose(draw) for _ in range(300)]), licenses.CONFIRMING)


def test_templates_are_found_whole_and_inside_documents(scanner):
    draw = random.Random(1)
    for family, texts in licenses.TEMPLATES.items():
        for t in texts:
            found = scanner(pa.array([_prose(draw) + "\n" + t.upper() + "\n" + _prose(draw)]))[0]
            assert [(f["family"], f["confirmed"]) for f in found] == [(family, True)], t


def test_text_without_a_licence(scanner):
    draw = random.Random(2)
    found = scanner(pa.array([_prose(draw) for _ in range(300)] + ["", None, "license", "\n\n"]))
    assert sum(map(bool, found)) <= 3 and not any(f["confirmed"] for x in found for f in x)


def test_edited_notices_and_long_paragraphs(scanner):
    draw = random.Random(3)
    edited = ["This code is licensed under the Apache License, Version 2.0 (January 2004).", "it is licensed under the gnu general public license version 3"]
    found = scanner(pa.array(edited + [_prose(draw, 400) + " Released under the MIT License. " + _prose(draw, 400)]))
    assert [x[0]["family"] for x in found] == ["Apache", "GPL", "MIT"] and [x[0]["confirmed"] for x in found] == [True, True, True], found


def test_probabilities_are_calibrated(scanner):
    assert 0.5 <= scanner.model.accept < 1
    assert np.isfinite(scanner.model.weights).all()


def test_blocks_do_not_change_results(scanner, monkeypatch):
    draw = random.Random(4)
    texts = pa.array([_prose(draw) + "\n" + licenses.TEMPLATES["MIT"][k % 6] for k in range(20)])
    whole = scanner(texts)
    common = __import__("millrace.llm.common", fromlist=["x"])
    monkeypatch.setattr(licenses, "raw_blocks", lambda c: common.raw_blocks(c, 300))
    assert scanner(texts) == whole
    line = pa.array([_prose(draw, 300).replace(".", "") + " " + t[:-1] + " " + _prose(draw, 300).replace(".", "") for t in licenses.TEMPLATES["CC"][:7]])
    cut = [[f["family"] for f in x if f["confirmed"]] for x in scanner(line)]
    monkeypatch.undo()
    assert [[f["family"] for f in x if f["confirmed"]] for x in scanner(line)] == [["CC"]] * 7 and all(set(x) == {"CC"} for x in cut)


def test_documents(spark):
    draw = random.Random(5)
    rows = [(k, _prose(draw), "x") for k in range(80)] + [(100, "Released under the MIT License.\nLicensed under CC BY 4.0.", "x"), (101, None, "x"), (None, licenses.TEMPLATES["BSD"][2], "x"), (100, "Released under the MIT License.", "x"), (103, _prose(draw, 90_000) + "\n" + licenses.TEMPLATES["GPL"][0], None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, family string")
    out = licenses.scan_documents(df).collect()
    assert len(out) == len(rows)
    assert {r.doc_id for r in out if r.confirmed} == {100, None, 103}
    by = {r.doc_id: r for r in out if r.n_paragraphs != 1 or r.doc_id != 100}
    assert by[100].families == ["CC", "MIT"] and by[None].family == "BSD" and by[103].family == "GPL" and by[101].family == "none"
    assert licenses.scan_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("notice, family", [("Licensed under CC BY 4.0.", "CC"), ("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache")])
@pytest.mark.parametrize("words", [20, 30, 42, 49, 200])
def test_short_notices_inside_a_line_whatever_its_length(scanner, notice, family, words):
    prose = " ".join(["the river and the house of stone to garden"] * 30).split()[:words]
    lines = [" ".join(prose) + ". " + notice, " ".join(prose) + " " + notice, notice[:-1] + " " + " ".join(prose), " ".join(prose)]
    found = [[(f["family"], f["confirmed"]) for f in x if f["confirmed"]] for x in scanner(pa.array(lines))]
    assert found == [[(family, True)], [(family, True)], [(family, True)], []]


def test_the_paragraphs_of_the_unknown_class_are_a_parameter(monkeypatch):
    draw, sizes = random.Random(6), []
    monkeypatch.setattr(licenses, "adam", lambda gradient, start, *_: sizes.append(len(start)) or start)
    corpus = [_prose(draw) for _ in range(20)]
    few, many = (licenses.fit(corpus, paragraphs=n) for n in (5, licenses.UNKNOWN_PARAGRAPHS))
    assert licenses.UNKNOWN_PARAGRAPHS == 6000 and len(sizes) == 4 and few.families == many.families


def test_the_query_equals_a_scan_text_by_text(spark):
    """The distributed query against plain comparison: a document is of a family if a template of it is in the text."""
    draw = random.Random(8)
    rows = []
    for k in range(150):
        family = draw.choice(sorted(licenses.TEMPLATES)) if k % 3 == 0 else None
        notice = draw.choice(licenses.TEMPLATES[family]) if family else ""
        rows.append((k, "\n".join([_prose(draw), notice, _prose(draw)]), family))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, family string")
    for r in licenses.scan_documents(df).collect():
        plain = sorted({f for f, ts in licenses.TEMPLATES.items() for t in ts if t in rows[r.doc_id][1]})
        assert (rows[r.doc_id][2] in plain if rows[r.doc_id][2] else not plain) and set(r.families) == set(plain)
