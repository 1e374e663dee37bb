"""Exact top-k search by inner product with ball-tree branch and bound per shard.

Components become floor(64 * x), so scores are exact integers. Candidates are dealt to shards and
queries to blocks by a hash of vec_id; a task holds one shard and one block. It builds a ball tree
of the shard, drops (query, node) pairs whose upper bound q.centre + |q| * radius is below the
query's k-th score, and visits the remaining leaves of each query by falling bound while the k-th
score rises. The k-th score is shared between shards: every query first searches one home shard,
and its k-th score there is the bound it starts with in all others.

Ties go to the smaller vec_id. Vectors that are null or hold a null or non-finite component take no
part; a shorter vector counts as padded with zeros. Rows that share a vec_id are rows of their own:
each is a candidate of all other rows, those with its vec_id included, and each such query row gets
its own ranks under the shared id. Rows without vec_id take no part. An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.llm.common import table, written

K = 20
SCALE = 64
#: Every so-manieth vec_id is a query.
QUERY_STEP = 20
#: Vectors in a shard and queries in a block, about.
SHARD, BLOCK = 8192, 2048
#: Vectors in a leaf, at most.
LEAF = 256
#: Scores below this keep exact keys of score and id rank in a long.
EXACT = 1 << 48


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): whole-number components of each row with a usable vector."""
    parts = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    usable = F.forall(parts, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = F.transform(parts, lambda x: F.floor(x * scale).cast("long"))
    rows = embeddings.where("vec_id is not null and embedding is not null").where(usable)
    return rows.select(F.col("vec_id").cast("long"), whole.alias("v"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, short rows padded with zeros."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    flat, lengths = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    result = np.zeros((len(lists), width), np.int64)
    result[np.arange(width) < lengths[:, None]] = flat
    return result


class BallTree:
    """Balls over the rows of x, kept as levels from the root to the leaves."""

    def __init__(self, x: np.ndarray, leaf: int) -> None:
        self.order = np.arange(len(x))
        self.levels: list[list[tuple[int, int]]] = [[(0, len(x))]]
        while max(b - a for a, b in self.levels[-1]) > leaf:
            below = []
            for a, b in self.levels[-1]:
                middle = (a + b) // 2
                own = self.order[a:b]
                points = x[own]
                far = points[np.argmax(((points - points.mean(axis=0)) ** 2).sum(axis=1))]
                other = points[np.argmax(((points - far) ** 2).sum(axis=1))]
                self.order[a:b] = own[np.argsort(points @ (other - far), kind="stable")]
                below += [(a, middle), (middle, b)]
            self.levels.append(below)
        self.balls = []
        for level in self.levels:
            centres = np.array([x[self.order[a:b]].mean(axis=0) for a, b in level])
            radii = np.array([np.sqrt(((x[self.order[a:b]] - c) ** 2).sum(axis=1).max()) for (a, b), c in zip(level, centres)])
            self.balls.append((centres, radii))


def search_shard(q_rows: np.ndarray, q: np.ndarray, bounds: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, vec id, score) of each query's k best in the shard that reach its bound.

    A query's own row is the one with its row key. Whole-number vectors; keys order by score, then by smaller id: score * n + n - 1 - rank of id.
    """
    by_id = np.argsort(ids)
    ids, rows, x = ids[by_id], rows[by_id], x[by_id].astype(np.float64)
    q = q.astype(np.float64)
    n = len(ids)
    tree = BallTree(x, LEAF)
    least = np.where(bounds == np.iinfo(np.int64).min, -EXACT, bounds) * n
    best = np.full((len(q), k), 0, np.int64) + (least - 1)[:, None]
    norms = np.sqrt((q**2).sum(axis=1))
    alive = np.ones((len(q), 1), bool)
    for centres, radii in tree.balls:
        if alive.shape[1] != len(radii):
            alive = np.repeat(alive, 2, axis=1)
        upper = q @ centres.T + norms[:, None] * radii
        upper += 1e-9 * (np.abs(upper) + norms[:, None] * np.abs(centres).max() + 1)
        alive &= np.floor(upper) * n + n > least[:, None]
    upper = np.where(alive, np.floor(upper), -np.inf)
    visit = np.argsort(-upper, axis=1, kind="stable")
    by_row = np.argsort(rows)
    own = by_row[np.minimum(np.searchsorted(rows, q_rows, sorter=by_row), n - 1)]
    own = np.where(rows[own] == q_rows, own, -1)
    leaves = [tree.order[a:b] for a, b in tree.levels[-1]]
    active = np.arange(len(q))
    for step in range(visit.shape[1]):
        ahead = upper[active, visit[active, step]]
        active = active[ahead * n + n > best[active].min(axis=1)]
        if not len(active):
            break
        targets = visit[active, step]
        for leaf in np.unique(targets):
            asking, members = active[targets == leaf], leaves[leaf]
            scores = np.rint(q[asking] @ x[members].T).astype(np.int64)
            keys = scores * n + (n - 1 - members)
            keys[members == own[asking][:, None]] = np.iinfo(np.int64).min
            merged = np.concatenate((best[asking], keys), axis=1)
            best[asking] = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
    row, column = np.nonzero(best >= least[:, None])
    found = best[row, column]
    return row, ids[n - 1 - found % n], found // n


def search_plain(q_rows: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[list, list, list]:
    """The same for scores too large for keys; such scores are clipped to the range of a long."""
    found = []
    vectors = [list(map(int, row)) for row in x]
    for place, (own, row) in enumerate(zip(q_rows.tolist(), (list(map(int, r)) for r in q))):
        scores = [(-sum(a * b for a, b in zip(row, v)), i) for r, i, v in zip(rows.tolist(), ids.tolist(), vectors) if r != own]
        found += [(place, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for s, i in sorted(scores)[:k]]
    return tuple(list(c) for c in zip(*found)) if found else ([], [], [])


def _cell(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, shard: pa.Table) -> pa.Table:
        names = ["query_row", "query_id", "vec_id", "score"]
        if not queries.num_rows or not shard.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        width = max(1, *(int(max(np.diff(c.offsets.to_numpy()), default=0)) for t in (queries.column("v"), shard.column("other")) for c in t.chunks))
        q, x = matrix(queries.column("v"), width), matrix(shard.column("other"), width)
        q_rows, q_ids = queries.column("query_row").to_numpy(), queries.column("query_id").to_numpy()
        rows, ids = shard.column("other_row").to_numpy(), shard.column("other_id").to_numpy()
        reach = max(float(np.abs(m.astype(np.float64)).max()) for m in (q, x))
        if reach * reach * width * len(ids) < EXACT:
            found = search_shard(q_rows, q, queries.column("bound").to_numpy(), rows, ids, x, k)
        else:
            found = search_plain(q_rows, q, rows, ids, x, k)
        place = np.array(found[0], np.int64)
        return pa.table([pa.array(c, pa.int64()) for c in (q_rows[place], q_ids[place], *found[1:])], names)

    return run


def top_k(spark: SparkSession, embeddings: DataFrame, k: int = K, query_step: int = QUERY_STEP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every row whose id divides by query_step."""
    # The key of a row is fixed by writing it down with the row.
    keyed = integer_vectors(embeddings).withColumn("row", F.monotonically_increasing_id())
    vectors = written(spark, keyed, "vectors")
    sizes = vectors.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % query_step == 0).alias("q")).first()
    shards, blocks = -(-sizes["n"] // SHARD) or 1, -(-sizes["q"] // BLOCK) or 1
    place = F.xxhash64("row")
    candidates = vectors.select(F.col("row").alias("other_row"), F.col("vec_id").alias("other_id"), F.col("v").alias("other"), F.pmod(place, F.lit(shards)).cast("int").alias("shard"))
    candidates = candidates.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    queries = vectors.where(F.col("vec_id") % query_step == 0)
    queries = queries.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "v", F.pmod(F.shiftrightunsigned(place, 32), F.lit(blocks)).cast("int").alias("block"))
    home = F.col("block") % shards
    shape = "query_row long, query_id long, vec_id long, score long"

    def searched(asked: DataFrame, offered: DataFrame) -> DataFrame:
        return asked.groupBy("block", "shard").cogroup(offered.groupBy("block", "shard")).applyInArrow(_cell(k), shape)

    none = F.lit(np.iinfo(np.int64).min)
    first = searched(queries.select("*", home.alias("shard"), none.alias("bound")), candidates.where(F.col("shard") == home))
    first = written(spark, first, "home")
    found = first
    if shards > 1:
        reached = first.groupBy("query_row").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        reached = reached.withColumnRenamed("query_row", "of_query")
        others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != home)
        asked = queries.join(reached, F.col("query_row") == F.col("of_query"), "left")
        asked = asked.select("query_row", "query_id", "v", "block", F.coalesce("kth", none).alias("bound"), F.explode(others).alias("shard"))
        found = first.unionAll(searched(asked, candidates.where(F.col("shard") != home)))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, table(spark, sf_dir, "embeddings"))


CHECK = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v,
    row_number() OVER () AS row FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.row <> c.row WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM pairs)
SELECT * FROM ranked WHERE rank <= 20
"""
