"""Fill-in-the-middle cuts against lists of units, the check SQL and exact round trips."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from checking import compare, connect
from shelfline.llm import fill_middle

TEXTS = st.text(st.sampled_from("ab é日😀 \t\n\x0b\x1f\x85<PSM>"), max_size=400)


def plain(doc_id, text):
    text = text or ""
    units = re.findall(fill_middle.UNIT, text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (n, "plain", None, None, text)
    if h[3] % 100 < 80:
        return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.sampled_from([1, 2, 7, 64, 512]))
def test_every_cut_is_where_the_units_end(text, block):
    held, fill_middle.BLOCK = fill_middle.BLOCK, block
    try:
        blocks = fill_middle.Blocks(text.encode())
        units = re.findall(fill_middle.UNIT, text)
        assert blocks.n == len(units) and blocks.n_points == len(text)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert blocks.cut(k) == (len(head.encode()), len(head))
    finally:
        fill_middle.BLOCK = held


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(0, 400), st.integers(0, 400), st.sampled_from(["psm", "spm"]))
def test_round_trip(text, i, j, form):
    data = text.encode()
    if fill_middle.chosen_form(data, 0, 0) != "plain":
        a, b = sorted((i, j))
        parts = [x.encode() for x in (text[:a], text[a:b], text[b:])]
        assert fill_middle.restored(fill_middle.assembled(form, *parts), form) == data


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(spark, connect(sf), fill_middle.query, fill_middle.CHECK, sf) is None


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c"), (5, "has <P> in it"), (6, "é " * 200_000), (7, "x"), (8, "<" * 50 + "P"), (7, "other text with this id"), (7, "x")]
    rows += [(i, f"text number {i}  with <S and M> of  units\n") for i in range(20, 60)]
    docs = spark.createDataFrame([(*r, "own", 7) for r in rows], "doc_id int, text string, form string, `odd name` int")
    got = fill_middle.transform(docs)
    assert got.columns == ["doc_id", "text", "odd name", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"]
    found = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got.collect()), key=repr)
    assert found == sorted(((d, t, *plain(d, t)) for d, t in rows), key=repr)
    for r in got.collect():
        assert r.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
    assert {x[3] for x in found} == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rate,form", [(0, {"plain"}), (100, {"psm"})])
def test_rates_are_parameters(spark, rate, form):
    docs = spark.createDataFrame([(i, "some words here") for i in range(50)], "doc_id long, text string")
    got = fill_middle.transform(docs, rate=rate, suffix_first=0)
    assert {r.form for r in got.collect()} == form
