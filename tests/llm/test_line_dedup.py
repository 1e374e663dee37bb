"""Fuzzy line dedup against all pairs of lines."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfline.llm import line_dedup
from shelfline.llm.common import table


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = [i]
        for j, d in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
        before = row
    return before[-1]


def near(lines):
    """All pairs of lines of edit similarity SIMILAR or more."""
    likely = line_dedup.Likely(lines)
    found = []
    for i in range(len(lines) - 1):
        at = np.arange(i + 1, len(lines))
        for j in at[likely.to(i, at)].tolist():
            a, b = lines[i], lines[j]
            most = int((1 - line_dedup.SIMILAR) * max(len(a), len(b)) + 1e-9)
            if line_dedup.edit_distance(a, b, most) <= most:
                found.append((a, b))
    return found


def plain(rows):
    """doc_id -> text after removal, over all pairs of lines; doc ids are distinct."""
    places = {}
    for doc_id, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if words := line_dedup.normal_words(line):
                places.setdefault(" ".join(words), []).append((doc_id, pos))
    root = {x: x for x in places}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near(list(places)):
        root[top(a)] = top(b)
    kept = {}
    for x in places:
        kept[top(x)] = min(kept.get(top(x), (1 << 62, 0)), *places[x])
    gone = {p for x in places for p in places[x] if p != kept[top(x)]}
    return {d: t and "\n".join(y for i, y in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


def removed(before, after):
    """(doc_id, line) of what is gone, lines counted."""
    return {d: sorted(set(range(len((t or "").split("\n"))))) and len((t or "").split("\n")) - len((after[d] or "").split("\n")) for d, t in before.items()}


def test_query_finds_the_pairs_of_a_whole_table(spark, sf):
    rows = {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    got = line_dedup.query(spark, sf).collect()
    want = plain(list(rows.items()))
    found = {r.doc_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    gone, all_gone = (sum(removed(rows, x).values()) for x in (found, want))
    same = sum(found[d] == want[d] for d in rows)
    # Keys may miss a pair, never add one.
    assert 0 < gone <= all_gone and gone >= 0.98 * all_gone and same >= 0.97 * len(rows)
    assert sum(r.n_removed for r in got) >= gone


LONG = "this line tells at some length how the lines of a document are compared with each other word by word and then again"


def test_edge_rows(spark):
    near_line = LONG.replace("length", "lengths")
    rows = [
        (1, f"{LONG}\nshort line\nown first line of one two"), (2, f"\nshort line\n{LONG.upper()}!\n{near_line}\n"),
        (3, ""), (4, "\n\n"), (5, f"{LONG} 17\n{LONG} 23"), (6, "w " * 60_000 + "\nx y z a b c"), (7, "x  y, z a B c"), (8, "q " * 60_000 + "r"), (9, "q " * 60_000 + "s"),
    ]
    docs = spark.createDataFrame([(d, t, 5, "s") for d, t in rows], "doc_id long, text string, n_chars int, of_doc string")
    got = line_dedup.keep_first_lines(spark, docs)
    assert got.columns == docs.columns and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    want = plain(rows)
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert want[7] == "" and want[9] == "" and want[2] == "\n" and want[5] == ""
    assert line_dedup.keep_first_lines(spark, docs.limit(0)).count() == 0


def test_rows_without_an_id_or_with_one_id_are_judged_by_their_texts(spark):
    rows = [(None, LONG), (1, None), (2, f"{LONG}\nsome other line"), (2, "this one is not like it\nunlike lines"), (2, "this one is not like it\nunlike lines"), (3, LONG), (None, "unlike line")]
    got = line_dedup.keep_first_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    want = [(None, ""), (None, ""), (1, None), (2, f"{LONG}\nsome other line"), (2, rows[3][1]), (2, rows[3][1]), (3, "")]
    assert found == sorted(want, key=repr)


@pytest.mark.parametrize("cell", [1 << 20, 700])
def test_a_large_group_of_near_lines_keeps_one(spark, monkeypatch, cell):
    monkeypatch.setattr(line_dedup, "CELL_BYTES", cell)
    words = LONG.split() * 3
    texts = [" ".join(words[:i] + ["changed"] + words[i + 1 :]) for i in range(0, 60, 2)]
    texts += [t.replace("length", "lengths") for t in texts] + [" ".join(words[5:]), " ".join(words[::-1])]
    rows = [(i, t) for i, t in enumerate([" ".join(words), *texts])]
    got = line_dedup.keep_first_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == plain(rows)


@pytest.mark.parametrize("cell", [1 << 20, 300])
def test_lines_of_one_key_that_its_least_line_does_not_settle(spark, monkeypatch, cell):
    monkeypatch.setattr(line_dedup, "CELL_BYTES", cell)
    # Two groups and some lone lines under one key: pairs with the least line connect one group at most.
    stems = [LONG, "quite another text stands here and has nothing to do with what the first one says at all", "a third one"]
    texts = [f"{s}{x}" for s in stems for x in ("", " a", " b", " abc")] + ["lone", "single text"]

    def one_key(batches):
        for b in batches:
            keys = pa.array([[7, 8]] * b.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("line"), keys], ["line", "keys"])

    monkeypatch.setattr(line_dedup, "line_keys", one_key)
    rows = list(enumerate(texts))
    got = line_dedup.keep_first_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == plain(rows)


@settings(max_examples=200, deadline=None)
@given(st.text("abcd ", max_size=40), st.text("abcd ", max_size=40), st.integers(0, 50))
def test_edit_distance(a, b, most):
    want = distance(a, b)
    got = line_dedup.edit_distance(a, b, most)
    assert got == want or want > most and got > most


def test_many_pairs_are_compared_together_like_one_by_one(monkeypatch):
    draw, texts = random.Random(3), ["", "a"]
    for size in (3, 40, 63, 64, 65, 128, 200, 330, 700, 1500):
        for _ in range(12):
            line = "".join(draw.choices("etaoin shrdlu", k=size))
            for share in (0.01, 0.08, 0.11, 0.2):
                letters = list(line)
                for at in draw.sample(range(size), int(size * share)):
                    letters[at] = draw.choice(["", "x", "é", "字", "yz"])
                texts += [line, "".join(letters)]
    one, two = (x.tolist() for x in np.triu_indices(len(texts), 1))
    near = [(i, j) for i, j in zip(one, two) if j - i < 8 and abs(len(texts[i]) - len(texts[j])) <= 200]
    want = []
    for a, b in ((texts[i], texts[j]) for i, j in near):
        most = int((1 - line_dedup.SIMILAR) * max(len(a), len(b)) + 1e-9)
        want.append(line_dedup.edit_distance(a, b, most) <= most)
    held, (one, two) = line_dedup.Texts(texts), np.array(near).T
    assert held.similar(one, two).tolist() == want and 0 < sum(want) < len(want)
    assert held.likely(one, two)[np.array(want)].all()
    with monkeypatch.context() as patch:
        patch.setattr(line_dedup, "LETTERS", 8)
        assert line_dedup.Texts(texts).similar(one, two).tolist() == want
    calls = []
    monkeypatch.setattr(line_dedup, "edit_distance", lambda a, b, most: calls.append(a))
    line = "".join(draw.choices("etaoin shrdlu", k=300))
    rows = [(i, -i, line, line[:i] + "x" + line[i + 1 :]) for i in range(1, 200)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["a", "b", "a_norm", "b_norm"])
    assert sum(b.num_rows for b in line_dedup.verified(iter([batch]))) == 199 and not calls


def planted(draw, size, share, whole_words):
    words = ["".join(draw.choices("etaoinshrdlu", k=draw.randint(1, 9))) for _ in range(size // 5)]
    line = " ".join(words)[:size].strip()
    if whole_words:
        cut = line.split(" ")
        while 1 - distance(line, " ".join(cut)) / max(len(line), len(" ".join(cut))) > share:
            cut[draw.randrange(len(cut))] = "".join(draw.choices("etaoinshrdlu", k=draw.randint(3, 7)))
        return line, " ".join(cut)
    letters = list(line)
    for i in draw.sample(range(len(letters)), int(len(letters) * (1 - share))):
        letters[i] = "x" if letters[i] != " " else " "
    return line, "".join(letters)


def meet(a, b):
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([a, b])], ["line", "norm"])
    rows = {0: set(), 1: set()}
    for b in line_dedup.line_keys(iter([batch])):
        for r in b.to_pylist():
            rows[r["line"]] |= set(r["keys"])
    return bool(rows[0] & rows[1])


@pytest.mark.parametrize("size", [30, 57, 70, 150, 300])
@pytest.mark.parametrize("share,whole_words,least", [(0.97, False, 0.9), (0.95, True, 0.9), (0.95, False, 0.75), (0.9, True, 0.7)])
def test_planted_lines_share_a_key(size, share, whole_words, least):
    draw = random.Random(size)
    pairs = [planted(draw, size, share, whole_words) for _ in range(60)]
    pairs = [(a, b) for a, b in pairs if a != b and 1 - distance(a, b) / max(len(a), len(b)) >= line_dedup.SIMILAR]
    assert not pairs or np.mean([meet(a, b) for a, b in pairs]) >= least


def test_short_lines_and_text_without_spaces_are_lines_too(spark):
    rows = [(1, "one two\nown\n\n***"), (2, "One, two!\n\n***\nother"), (3, "這一行文字沒有空格但是重複出現"), (4, "這一行文字沒有空格但是重複出現。\n尾"), (5, "own")]
    got = line_dedup.keep_first_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == {1: rows[0][1], 2: "\n***\nother", 3: rows[2][1], 4: "尾", 5: ""}


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aZ_ 09\n\r\t\x1c٣²İß字")), max_size=60))
def test_normal_lines_hold_the_words_of_each_line(text):
    want = [" ".join(line_dedup.WORD.findall(x)) for x in line_dedup.DIGIT.sub("0", text.lower()).split("\n")]
    assert line_dedup.normal_lines(text) == want


def test_a_band_is_wide_enough_for_texts_that_are_shifted_against_each_other():
    draw, pairs = random.Random(5), []
    for size in (90, 300, 320, 500, 639, 640, 641, 900, 1500, 2600):
        for share in (0.02, 0.045, 0.05, 0.055, 0.1):
            line, cut = "".join(draw.choices("etaoin shrdlu", k=size)), int(size * share)
            at = draw.randrange(size - cut)
            for text in (line[cut:] + "x" * cut, "x" * cut + line[:-cut or None], line[:at] + line[at + cut :], line[:at] + "y" * cut + line[at:], line[cut:] + "x" * (cut + cut // 3)):
                pairs.append((line, text))
    held = line_dedup.Texts([t for p in pairs for t in p])
    most = [int((1 - line_dedup.SIMILAR) * max(len(a), len(b)) + 1e-9) for a, b in pairs]
    want = [line_dedup.edit_distance(a, b, k) <= k for (a, b), k in zip(pairs, most)]
    one = np.arange(0, 2 * len(pairs), 2)
    assert held.similar(one, one + 1).tolist() == want and 0 < sum(want) < len(want)


def test_lines_that_share_several_keys_are_compared_once(monkeypatch):
    draw, compared = random.Random(7), []
    words = ["".join(draw.choices("etaoin", k=6)) for _ in range(60)]
    # The same letter pairs, but for a few, in another order: only an edit distance tells them apart.
    texts = [" ".join(words), " ".join(words[30:] + words[:30]), " ".join(words[::-1])]
    rows = [(v, 0, 0, i, i, t, [3, 5, 8], 0) for v in (3, 5, 8) for i, t in enumerate(texts)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["value", "x", "y", "line", "root", "norm", "keys", "part"])
    similar = line_dedup.Texts.similar
    monkeypatch.setattr(line_dedup.Texts, "similar", lambda self, one, two: compared.extend(zip((one % 3).tolist(), (two % 3).tolist())) or similar(self, one, two))
    assert sum(b.num_rows for b in line_dedup.cell_links(iter([batch]))) == 0
    assert compared and len(set(compared)) == len(compared)


def test_only_lines_that_may_share_a_key_move(spark, monkeypatch):
    plans = []
    keep = line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda s, df, purpose: plans.append((purpose, df._jdf.queryExecution().optimizedPlan().toString())) or keep(s, df, purpose))
    lines = spark.createDataFrame([(i, f"{LONG} {'ab'[i % 2]}") for i in range(4)], "line long, norm string")
    line_dedup.line_links(spark, lines).collect()
    plan = dict(plans)["line-texts"].split("\n")
    joins = [i for i, x in enumerate(plan) if "Join" in x]
    # The filter joins by word, below the join with the lines that were asked for.
    assert len(joins) == 2 and "shiftright" in plan[joins[1]] and "shiftright" not in plan[joins[0]]
