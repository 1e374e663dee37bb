"""Benchmark decontamination against plain shingle overlap."""

from shelfline.llm import decontaminate as dc
from shelfline.llm.common import table


def runs(words):
    width = min(5, len(words))
    return set(zip(*(words[i:] for i in range(width)))) if words else set()


def plain(docs, items):
    wanted = {i: runs(dc.words_of(t)) for i, t in items}
    found = set()
    for d, text in docs:
        words = dc.words_of(text)
        held = runs(words)
        found |= {(d, i) for i, w in wanted.items() if len(w & held) >= 0.8 * len(w)}
    return found


def pairs(rows):
    return sorted((r.doc_id, r.item_id) for r in rows)


def test_query_finds_all_leaks(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    got = dc.query(spark, sf).collect()
    assert pairs(got) == sorted(plain(docs, items)) and got
    assert all(r.overlap >= 0.8 and r.score >= dc.RETRIEVED for r in got)


ITEM = "What is the name of the river that flows through the old town of the north? The river is called the grey water by all who live there."
FILL = " ".join(f"filler{i}" for i in range(3_000))


def test_edge_rows(spark, monkeypatch):
    items = [(1, ITEM), (1, ITEM), (2, "Short one."), (3, None), (4, ""), (None, "an item without any id at all is still an item")]
    docs = [
        (10, f"{FILL} {ITEM} {FILL}"), (11, ITEM.upper().replace(" ", "\n")), (12, ITEM.replace("name", "label")),
        (13, ITEM[:60]), (14, "The short one here"), (15, None), (16, ""), (None, ITEM), (18, "the river of the town is the name"),
        (19, f"{FILL} An item, without any ID at all, is still an item!"),
    ]
    bench = spark.createDataFrame([(*r, 0.5) for r in items], "item_id long, text string, score double")
    rows = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    want = [(10, 1), (11, 1), (12, 1), (14, 2), (19, None), (None, 1)]

    def found():
        return sorted(((r.doc_id, r.item_id) for r in dc.leaks(spark, rows, bench).collect()), key=repr)

    assert found() == sorted(want, key=repr)
    monkeypatch.setattr(dc, "ITEMS", 2)
    monkeypatch.setattr(dc, "TOGETHER", 3)
    assert found() == sorted(want, key=repr)
    clean = dc.keep_clean(spark, rows, bench)
    assert clean.columns == rows.columns
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted([13, 15, 16, 18, None], key=repr)
    assert dc.leaks(spark, rows.limit(0), bench).count() == 0
    assert dc.leaks(spark, rows, bench.limit(0)).count() == 0 and dc.keep_clean(spark, rows, bench.limit(0)).count() == 10
    assert dc.leaks(spark, rows.unionAll(rows), bench).count() == 12


def test_retrieval_equals_full_scoring(spark, sf):
    rows = [(r.item_id, r.text, [(x.word, x.w) for x in r.weights]) for r in dc.weighted_items(table(spark, sf, "benchmark")).collect()]
    index = dc.Index(rows)
    by_text = {t: dict(w) for _, t, w in rows}
    ordered = sorted(by_text, key=lambda t: (len(t), t))
    passage = dc.words_of(ordered[3] + " " + " ".join(ordered[7].split()[:12]) + " of the and")
    import numpy as np

    terms = np.unique([index.terms[w] for w in passage if w in index.terms])
    found = {i: s for _, i, s in zip(*(x.tolist() for x in index.retrieve(np.zeros(len(terms), np.int64), terms, 1)))}
    want = {i: sum(x for w, x in by_text[t].items() if w in set(passage)) for i, t in enumerate(ordered)}
    assert set(found) == {i for i, s in want.items() if s >= dc.RETRIEVED}
    assert all(abs(found[i] - want[i]) < 1e-9 for i in found) and 3 in found
