"""Importance resampling against plain counts and the check SQL."""

import hashlib
import math
import re
import string
from collections import Counter
from zlib import crc32

import numpy as np
from checking import compare, connect
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfline.llm import resample

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


def plain(docs, target, percent=5, least=20):
    counts = [Counter(crc32(f.encode()) % 10_000 for t in texts for f in plain_features(t)[0]) for texts in ([t for _, t in docs], target)]
    s, t = (c.total() + 10_000 for c in counts)
    gain = [math.floor(1000 * math.log((counts[1][b] + 1) * s / ((counts[0][b] + 1) * t))) for b in range(10_000)]
    rows = []
    for doc_id, text in docs:
        features, words = plain_features(text)
        weight = sum(gain[crc32(f.encode()) % 10_000] for f in features)
        h = int(hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    may = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = rank + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_query_equals_its_sql(spark, sf):
    assert compare(spark, connect(sf), resample.query, resample.CHECK, sf) is None


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.text("aB9 \né_.\x00", max_size=30), max_size=8))
def test_batch_features_are_those_of_each_text(texts):
    owner, bucket, words = resample.batch_features([None if t is None else t.encode() for t in texts])
    got = sorted(zip(owner.tolist(), bucket.tolist()))
    want = [plain_features(t) for t in texts]
    assert got == sorted((i, crc32(f.encode()) % 10_000) for i, (features, _) in enumerate(want) for f in features)
    assert words.tolist() == [n for _, n in want]


def test_ties_copies_and_edge_rows(spark):
    rows = [(i % 150 if i % 3 else 7, f"word{i % 5} " * (i % 40)) for i in range(400)]
    rows += [(None, None), (None, "a b c " * 10), (500, ""), (501, None), (502, "x" * 100_000), (503, "É é Zz9 " * 20_000)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id int, text string, score int, part string")
    target = [(1, "word1 word2 word3"), (2, None), (3, "zz9")]
    frame = spark.createDataFrame(target, "item_id long, text string")
    for percent, least in ((5, 20), (50, 3), (100, 0)):
        got = resample.importance(spark, docs, frame, percent, least).select("doc_id", "n_features", "weight", "score", "rank")
        found = sorted((tuple(r) for r in got.collect()), key=repr)
        want = plain(rows, [t for _, t in target], percent, least)
        # Rows alike but for their rank may take it in any order.
        assert sorted(r[:4] for r in found if r[0] is not None) == sorted(r[:4] for r in want if r[0] is not None)
        by_rank = [sorted((r[4], r[3], r[0] or -1) for r in x if r[4]) for x in (found, want)]
        assert by_rank[0] == by_rank[1] and len(found) == len(want)
    assert resample.importance(spark, docs.limit(0), frame).count() == 0
    assert resample.importance(spark, docs, frame.limit(0)).count() == len(rows)


def test_ranks_pass_over_partitions(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "id % 7 as score")
    got = {r.doc_id: r.rank for r in resample.ranked(spark, rows.repartition(13), 1234).collect()}
    order = sorted(got, key=lambda i: (-(i % 7), i))
    assert [got[i] for i in order] == [n + 1 if n < 1234 else None for n in range(5000)]
    assert np.all([r.rank is None for r in resample.ranked(spark, rows, 0).collect()])
