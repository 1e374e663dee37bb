"""SentencePiece encoding against the library, and exact round trips."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfline.llm import pieces
from shelfline.llm.common import table


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(pieces.MODEL)


def test_query_equals_the_library(spark, sf, library):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = pieces.query(spark, sf).collect()
    assert len(got) == len(texts)
    for row in got:
        assert row.token_ids == library.encode(texts[row.doc_id]) and row.n_tokens == len(row.token_ids)
        assert row.decoded == texts[row.doc_id]


def test_odd_texts(library, vocabulary):
    draw = random.Random(5)
    parts = list("aeth\n\t \u00e9\U0001f600\u65e5=<>_x0\u2581") + ["the", "ing", "    ", "  ", "<s>", "<0x41>", "======"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(3_000)]
    texts += [" " * n for n in range(40)] + ["a" + " " * n + "b" for n in range(40)] + ["x" * 5_000, "ab" * 3_000]
    got = pieces.encode_texts(texts, pieces.Encoder(vocabulary))
    assert got == library.encode(texts)
    assert [pieces.decode(ids, vocabulary.output) for ids in got] == [t.replace("\u2581", " ") for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), max_size=5))
def test_any_text_round_trips(library, vocabulary, texts):
    got = pieces.encode_texts(texts, pieces.Encoder(vocabulary))
    assert got == [library.encode(t) for t in texts]
    assert [pieces.decode(ids, vocabulary.output) for ids in got] == [t.replace("\u2581", " ") for t in texts]


def test_prefixes_are_reused(vocabulary):
    encoder = pieces.Encoder(vocabulary)
    words = sorted({"\u2581there", "\u2581thereafter", "\u2581the", "\u2581theory", "\u2581a"})
    alone = [pieces.Encoder(vocabulary).encode(w) for w in words]
    assert [encoder.encode(w) for w in words] == alone


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "one two"), (4, "one two"), (5, "word " * 100_000), (5, "word " * 100_000)]
    docs = spark.createDataFrame([(*r, [7]) for r in rows], "doc_id long, text string, token_ids array<int>")
    got = sorted(pieces.encode(spark, docs).collect(), key=repr)
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert by[1].token_ids == by[2].token_ids == [] and by[1].decoded == by[2].decoded == ""
    assert by[None].token_ids == by[4].token_ids and by[4].decoded == "one two"
    assert by[5].decoded == "word " * 100_000
    assert pieces.encode(spark, docs.limit(0)).count() == 0
