"""SimHash near-dedup against all pairs, and the helpers it shares."""

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfline.llm import near_dedup
from shelfline.llm.common import components, table
from shelfline.llm.simhash import majority


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = {d: plain_fingerprint(t) for d, t in rows}
    root = {d: d for d in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: (f"{prints[d]:016x}", top(d)) for d in prints}


def test_query_equals_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = near_dedup.query(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == plain_components(rows)
    assert len(got) == len(rows)


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "a b c d e f"), (2, "A B  C\tD e f"), (3, None), (4, ""), (5, " \n"), (6, "one"), (7, "one two"), (8, long), (9, long)]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: (r.fp, r.component_id) for r in near_dedup.near_duplicates(spark, docs).collect()}
    want = plain_components(rows)
    assert {d: c for d, (_, c) in got.items()} == {d: c for d, (_, c) in want.items()}
    assert got[3] == got[4] == got[5] == (0, 3)
    kept = near_dedup.keep_one(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in want.items() if c == d)
    twice = near_dedup.near_duplicates(spark, docs.unionAll(docs))
    assert twice.count() == 18 and twice.distinct().count() == 9
    assert near_dedup.near_duplicates(spark, docs.limit(0)).count() == 0
    with_null = docs.limit(1).unionAll(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(spark, with_null).collect()} == {(1, 1), (None, 1)}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 60), st.sampled_from([0, 22, 43]))
def test_index_finds_exactly_the_near_pairs(seed, n, shift):
    draw = np.random.default_rng(seed)
    base = draw.integers(0, 2**63, 4, dtype=np.uint64)
    codes = base[draw.integers(0, 4, n)]
    for _ in range(3):
        codes = codes ^ (np.uint64(1) << draw.integers(0, 64, n).astype(np.uint64))
    codes = np.unique(codes)
    codes = codes[np.argsort(near_dedup.gray_rank(codes))]
    lead = (1 << 64) - (1 << 42)
    found = {frozenset(p) for a, b in near_dedup.near_pairs(codes, lead) for p in zip(a.tolist(), b.tolist())}
    listed = codes.tolist()
    want = {frozenset((a, b)) for a in listed for b in listed if a != b and (a ^ b).bit_count() <= 2 and not (a ^ b) & lead}
    assert found == want


def test_gray_rank_orders_neighbours_one_bit_apart():
    numbers = np.arange(1 << 10, dtype=np.uint64)
    codes = numbers ^ (numbers >> np.uint64(1))
    assert (near_dedup.gray_rank(codes) == numbers).all()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 700), min_size=1, max_size=6), st.integers(0, 2**32))
def test_votes(counts, seed):
    hashes = np.random.default_rng(seed).integers(0, 2**63, sum(counts), dtype=np.uint64)
    got = majority(hashes, np.array(counts)).tolist()
    at = 0
    for n, found in zip(counts, got):
        own = hashes[at : at + n].tolist()
        assert found == sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in own) > n)
        at += n


@pytest.mark.parametrize("links", [
    [], [(1, 2)], [(2, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 200)],
    [(5, 1), (5, 9), (9, 30), (31, 30), (-4, 8), (8, -4)],
])
def test_components(spark, links):
    root = {x: x for link in links for x in link}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    want = {x: top(x) for x in root if any(x in link for link in links if link[0] != link[1])}
    got = components(spark, spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
