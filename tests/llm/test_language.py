"""Language identification: held-out accuracy, plain rank distances and edge rows."""

import zlib
from collections import Counter

import pytest

from shelfline.llm import language
from shelfline.llm.common import table

LETTERS = language.letter_table()


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    padded = f" {' '.join(words)} " if words else ""
    grams = Counter(c for c in padded if c != " ")
    grams.update(padded[i : i + 2] for i in range(len(padded) - 1))
    grams.update(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " ")
    return grams


def packed(gram):
    return sum(ord(c) << language.POINT * i for i, c in enumerate(gram))


@pytest.mark.parametrize("text", ["", "a", "Ab, ab  c3d", "Été öde ß İ 日本 x", "!!", "the other there the"])
def test_grams(text):
    want = {packed(g): n for g, n in plain_grams(text).items()}
    codes = language.gram_codes(text, LETTERS)
    got = dict(zip(*(x.tolist() for x in language.counted(codes)))) if len(codes) else {}
    assert got == want


def test_predictions_are_the_plain_distances_and_right(spark, sf):
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    counts = {}
    for r in docs.values():
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            counts.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    size = language.PROFILE
    profiles = {k: sorted(c, key=lambda g: (-c[g], packed(g)))[:size] for k, c in counts.items()}
    got = language.query(spark, sf).collect()
    assert len(got) == len(docs)
    right = held = 0
    for row in got:
        own = plain_grams(docs[row.doc_id].text)
        ranks = sorted(own, key=lambda g: (-own[g], packed(g)))[:size]
        far = {k: sum(abs(p.index(g) - i) if g in p else size for i, g in enumerate(ranks)) for k, p in profiles.items()}
        best = min(far, key=lambda k: (far[k], k))
        assert (row.lang_pred, round(row.score, 9)) == (best, round(1 - far[best] / (size * len(ranks)), 9))
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)
        held += row.held_out
        right += row.held_out and row.lang_pred == docs[row.doc_id].lang
    assert held > 50 and right / held > 0.98


def test_edge_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    profiles = language.learn(docs)
    rows = [(1, None, "en"), (2, "", None), (3, "12 !? \n", "fr"), (None, "the thing and the other", None), (5, "the of and " * 50_000, "de")]
    odd = spark.createDataFrame([(*r, 1.0, True) for r in rows], "doc_id long, text string, lang string, score double, held_out boolean")
    got = {r.doc_id: r for r in language.predict(odd.unionAll(odd), profiles).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[None].lang_pred == "en" and got[None].held_out is False and got[5].lang_pred == "en"
    assert language.predict(odd.limit(0), profiles).count() == 0
    unlabelled = odd.withColumn("lang", odd["text"].substr(1, 0)).where("doc_id = 77")
    assert language.learn(unlabelled).languages == []
    kept = language.keep_known(docs.unionByName(odd.select("doc_id", "text", "lang")))
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() + 2
    assert language.keep_known(docs.limit(0)).count() == 0
