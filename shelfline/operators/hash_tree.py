"""Comparing two large keyed tables by trees of fingerprints.

A leaf is a range of keys with the number and the summed hashes of its rows; a node above sums 256
nodes below it. Building a tree scans a table once and moves one partial row per leaf and task,
never the rows. Two trees are compared from the top: children are looked at below unequal nodes
only. Rows are then compared in unequal leaves alone, and the scans get these as key ranges.

Keys are whole numbers, unique and not null. A sum of 64-bit hashes, kept as two halves, tells
tables apart whatever the order of rows; two leaves that differ are taken for equal with a chance
of about 2^-64.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions.columns import distinct_from
from shelfline.session import shared_dir

#: log2 of the keys in a leaf, and of the nodes below a node.
LEAF_BITS = 12
FAN_BITS = 8
#: Levels of a tree, leaves included.
LEVELS = 4
#: At most so many key ranges are handed to a scan; beyond it the ranges are made wider.
RANGES = 256

_MARKS = ["n", "low", "high"]


def leaf_of(key: str, bits: int = LEAF_BITS) -> Column:
    return F.shiftright(F.col(key).cast("long"), bits)


def tree(rows: DataFrame, key: str, fields: list[str], bits: int = LEAF_BITS) -> DataFrame:
    """(level, node, n, low, high): the fingerprints of all nodes; level 0 are the leaves."""
    # A null is hashed as such: the hash function itself passes over nulls.
    parts = [p for f in fields for p in (F.col(f), F.col(f).isNull())]
    hashed = F.xxhash64(F.col(key).cast("long"), *parts)
    leaves = rows.select(leaf_of(key, bits).alias("leaf"), hashed.alias("h")).groupBy("leaf").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("h").bitwiseAND(0xFFFFFFFF)).alias("low"),
        F.sum(F.shiftrightunsigned("h", 32)).alias("high"),
    )
    nodes = F.array(
        *[
            F.struct(F.lit(k).alias("level"), F.shiftright("leaf", FAN_BITS * k).alias("node"))
            for k in range(LEVELS)
        ]
    )
    every = leaves.select(F.inline(nodes), *_MARKS)
    return every.groupBy("level", "node").agg(*[F.sum(m).alias(m) for m in _MARKS])


def write_tree(found: DataFrame, path: str) -> None:
    """A tree kept beside its table, each level in files of its own."""
    found.hint("rebalance", "level").write.partitionBy("level").parquet(path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("node long, n long, low long, high long, level int").parquet(path)


def kept_tree(found: DataFrame) -> DataFrame:
    spark = found.sparkSession
    path = shared_dir(spark, "hash-tree")
    write_tree(found, path)
    return read_tree(spark, path)


def unequal_leaves(left: DataFrame, right: DataFrame) -> DataFrame:
    """(node): leaves whose fingerprints differ or that one tree lacks."""
    nodes = None
    for level in reversed(range(LEVELS)):
        sides = [t.where(F.col("level") == level).select("node", *_MARKS) for t in (left, right)]
        if nodes is not None:
            above = nodes.withColumnRenamed("node", "above")
            under = F.shiftright("node", FAN_BITS) == F.col("above")
            sides = [s.join(above, under, "left_semi") for s in sides]
        other = sides[1].select("node", *[F.col(m).alias(f"r_{m}") for m in _MARKS])
        differs = reduce(lambda a, b: a | b, [distinct_from(F.col(m), F.col(f"r_{m}")) for m in _MARKS])
        nodes = sides[0].join(other, "node", "full").where(differs).select("node")
    return nodes


def key_ranges(leaves: DataFrame, bits: int = LEAF_BITS) -> list[tuple[int, int]] | None:
    """At most ``RANGES`` ranges of keys that hold all these leaves; None if the tree's top has more.

    Ranges are nodes of the lowest level that has few enough of them.
    """
    levels = range(LEVELS)
    counts = leaves.agg(
        *[F.count_distinct(F.shiftright("node", FAN_BITS * k)).alias(f"k{k}") for k in levels]
    ).first()
    level = next((k for k in levels if counts[k] <= RANGES), None)
    if level is None:
        return None
    width = bits + FAN_BITS * level
    found = leaves.select(F.shiftright("node", FAN_BITS * level).alias("v")).distinct().collect()
    return [(r.v << width, ((r.v + 1) << width) - 1) for r in sorted(found)]


def tree_diff(
    source: DataFrame,
    read: DataFrame,
    fields: list[str],
    key: str = "id",
    trees: tuple[DataFrame, DataFrame] | None = None,
    bits: int = LEAF_BITS,
) -> DataFrame:
    """(key, kind) of rows that are ``missing`` in ``read``, ``extra`` there, or ``different``.

    ``trees`` are stored trees of both tables over the same fields, types and ``bits``; without them
    they are built and written below the shared folder. The unequal leaves are found when the function is called.
    """
    kinds = {f: source.schema[f].dataType for f in fields}
    typed = read.select(key, *[F.col(f).cast(kinds[f]).alias(f) for f in fields])
    source = source.select(key, *fields)
    left, right = trees or [kept_tree(tree(rows, key, fields, bits)) for rows in (source, typed)]
    leaves = unequal_leaves(left, right)
    ranges = key_ranges(leaves, bits)
    sides = [source, typed]
    if ranges is not None:
        near = reduce(
            lambda a, b: a | b, [F.col(key).between(lo, hi) for lo, hi in ranges], F.lit(False)
        )
        sides = [s.where(near) for s in sides]
    sides = [s.join(leaves, leaf_of(key, bits) == F.col("node"), "left_semi") for s in sides]
    a = sides[0].select(key, *fields, F.lit(True).alias("_a"))
    b = sides[1].select(key, *[F.col(f).alias(f"r_{f}") for f in fields], F.lit(True).alias("_b"))
    differs = reduce(
        lambda x, y: x | y, [distinct_from(F.col(f), F.col(f"r_{f}")) for f in fields], F.lit(False)
    )
    kind = (
        F.when(F.col("_b").isNull(), "missing")
        .when(F.col("_a").isNull(), "extra")
        .when(differs, "different")
    )
    return a.join(b, key, "full").select(key, kind.alias("kind")).where("kind IS NOT NULL")
