"""Exact top-k search against all scores, with one and with many shards."""

import math

import duckdb
import numpy as np
import pytest
from checking import compare, connect

from shelfline.llm import topk


def test_query_matches_check(spark, sf):
    assert compare(spark, connect(sf), topk.query, topk.CHECK, sf) is None


def small_shards(monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 60)
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "LEAF", 4)


def plain(rows, k, step):
    kept = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * x) for x in v]))
    found = []
    for row, (q, a) in enumerate(kept):
        if q % step == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for other, (i, b) in enumerate(kept) if other != row)
            found += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(found)


def test_rows_of_one_id_are_rows(spark, monkeypatch, tmp_path):
    """Code and check SQL agree on repeated ids, with one shard and with many."""
    rows = [(1, [1.0, 0.0]), (1, [0.5, 0.0]), (3, [0.25, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0])]
    rows += [(i % 50, [i % 7 / 4, i % 5 / 4]) for i in range(200)]
    for part, name in ((rows[:4], "few"), (rows, "many")):
        vectors = spark.createDataFrame(part, "vec_id long, embedding array<float>")
        assert sorted(tuple(r) for r in topk.top_k(spark, vectors).collect()) == plain(part, 20, 20)
        vectors.coalesce(1).write.parquet(str(tmp_path / name / "embeddings.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/{name}/embeddings.parquet/*.parquet')")
        assert compare(spark, con, topk.query, topk.CHECK, str(tmp_path / name)) is None
        small_shards(monkeypatch)


@pytest.mark.parametrize("sharded", [False, True])
def test_ties_and_copies(spark, monkeypatch, sharded):
    if sharded:
        small_shards(monkeypatch)
    draw = np.random.default_rng(4)
    base = draw.integers(-2, 3, (40, 3)) / 8
    rows = [(i, base[draw.integers(0, 40)].tolist()) for i in range(300)] + [(i, [0.5, 0.5, 0.5]) for i in range(300, 400)]
    rows += [(-20, [1.0, -1.0, 0.0]), (1_000, None), (1_020, [1.0, None]), (1_040, [1.0, float("nan")]), (1_060, [float("inf")]),
             (1_080, []), (1_100, [2.0]), (None, [1.0]), (20, rows[20][1]), (40, [-9.0, 0.0])]
    vectors = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in topk.top_k(spark, vectors).collect())
    assert got == plain(rows, 20, 20)
    assert topk.top_k(spark, vectors.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(spark, few).collect()) == plain(rows[:4], 20, 20)


def test_many_shards_match_check(spark, sf, monkeypatch):
    small_shards(monkeypatch)
    assert compare(spark, connect(sf), topk.query, topk.CHECK, sf) is None


def test_large_components(spark):
    rows = [(0, [1e7, -3e6]), (1, [2e7, 5.0]), (20, [-1e7, 1e7]), (3, [1e7, 1e7])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(spark, vectors).collect()) == plain(rows, 20, 20)
