"""Exact quantiles whose state stays small on any data size.

The built-in exact percentile keeps every different value of a group in one task. Here a histogram
over value buckets finds the bucket of each wanted rank first. While one of these holds more than
``KEEP`` rows of different values, another histogram cuts each of them into equal slices between
its least and greatest value; only the values of the slices that hold a wanted rank are counted and
ranked. A bucket spans at most 2^44 doubles and each level leaves one slice in 16 384 of the span,
so ``LEVELS`` levels lead to single values wherever these lie. The histograms run when the function
is called, so that their few targets can be broadcast; the rest stays lazy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.functions.small import checked

#: Buckets per doubling of the value; a bucket spans about 0.3 % of it.
BUCKETS_PER_OCTAVE = 256
#: Equal slices of a bucket that holds a wanted rank.
SLICES = 16_384
#: Rows of different values that may be ranked in one window.
KEEP = 100_000
#: Levels of slices, at most.
LEVELS = 5


def _bucket(value: Column) -> Column:
    """A monotone bucket number; at most 2 x 16 384 buckets for values below 2^63."""
    magnitude = F.floor(F.log2(F.abs(value) + 1) * BUCKETS_PER_OCTAVE).cast("long")
    return F.when(value < 0, -magnitude - 1).otherwise(magnitude)


def _wanted(name: str, prob: float, total: Column, discrete: bool) -> list[Column]:
    """0-based ranks needed for a probability: nearest rank, or the two around the position."""

    def entry(side: str, rank: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"), F.lit(side).alias("side"), rank.cast("long").alias("rank")
        )

    if discrete:
        return [entry("lo", F.greatest(F.ceil(total * F.lit(prob)) - 1, F.lit(0)))]
    position = (total - 1) * F.lit(prob)
    return [entry("lo", F.floor(position)), entry("hi", F.ceil(position))]


def _counts(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Rows, least and greatest value of each bucket."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("top"), *more
    )


def _reached(rows: DataFrame, hist: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """The rows of the buckets that hold a target, with targets ranked within the bucket.

    ``hist`` has the buckets with their targets and, in ``upto``, the rows up to each bucket. The
    number is that of the rows in the largest such bucket with more than one value.
    """
    before = F.col("upto") - F.col("c")
    here = F.filter("targets", lambda t: (t["rank"] < F.col("upto")) & (t["rank"] >= before))
    within = F.transform(
        here,
        lambda t: F.struct(
            t["name"].alias("name"), t["side"].alias("side"), (t["rank"] - before).alias("rank")
        ),
    )
    targets = hist.withColumn("targets", within).where(F.size("targets") > 0)
    targets = targets.select(
        *[F.col(k).alias(f"t_{k}") for k in keys], "low", "top", "n", "max", "targets", "c"
    )
    targets = checked(targets)
    most = targets.agg(F.max(F.when(F.col("top") > F.col("low"), F.col("c"))).alias("c")).first().c
    same = [F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in keys]
    found = rows.join(targets, same, "inner").select(*keys, "v", "low", "top", "n", "max", "targets")
    return found, most or 0


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: list[str] | None = None,
    discrete: bool = False,
) -> DataFrame:
    """One row per group with a column per probability, plus ``n`` and ``max``.

    ``probs`` maps output names to probabilities. Continuous quantiles interpolate between the
    two neighbours; discrete ones take the nearest rank. Null values are ignored; with no group
    columns an empty input gives one row of nulls.
    """
    by = by or []
    rows = df.where(F.col(value).isNotNull()).select(
        *by, F.col(value).cast("double").alias("v"), _bucket(F.col(value)).alias("bucket")
    )
    in_group = Window.partitionBy(*by)
    hist = (
        _counts(rows, [*by, "bucket"])
        .withColumn("upto", F.sum("c").over(in_group.orderBy("bucket")))
        .withColumn("n", F.sum("c").over(in_group))
        .withColumn("max", F.max("top").over(in_group))
    )
    wanted = F.array(
        *[w for name, p in probs.items() for w in _wanted(name, p, F.col("n"), discrete)]
    )
    keys = [*by, "bucket"]
    inside, most = _reached(rows, hist.withColumn("targets", wanted), keys)
    share = F.try_divide(F.col("v") - F.col("low"), F.col("top") - F.col("low"))
    place = F.least(F.floor(share * SLICES), F.lit(SLICES - 1))
    carried = [F.any_value(c).alias(c) for c in ("n", "max", "targets")]
    for level in range(LEVELS):
        if most <= KEEP:
            break
        part = f"slice_{level}"
        inside = inside.withColumn(part, F.when(F.col("top") > F.col("low"), place).otherwise(0))
        hist = _counts(inside, [*keys, part], *carried).withColumn(
            "upto", F.sum("c").over(Window.partitionBy(*keys).orderBy(part))
        )
        keys = [*keys, part]
        inside, most = _reached(inside.select(*keys, "v"), hist, keys)
    counted = (
        inside.groupBy(*keys, "v")
        .agg(
            F.count(F.lit(1)).alias("c"),
            F.any_value("n").alias("n"),
            F.any_value("max").alias("max"),
            F.any_value("targets").alias("targets"),
        )
        .withColumn("upto", F.sum("c").over(Window.partitionBy(*keys).orderBy("v")))
    )
    hits = (
        counted.withColumn(
            "targets",
            F.filter(
                "targets",
                lambda t: (t["rank"] < F.col("upto")) & (t["rank"] >= F.col("upto") - F.col("c")),
            ),
        )
        .where(F.size("targets") > 0)
        .select(*by, "n", "max", "v", F.explode("targets").alias("t"))
    )

    def side(name, s):
        return F.max(F.when((F.col("t.name") == name) & (F.col("t.side") == s), F.col("v")))

    def quantile(name, p):
        lo = side(name, "lo")
        if discrete:
            return lo.alias(name)
        position = (F.max("n") - 1) * F.lit(p)
        return (lo + (side(name, "hi") - lo) * (position - F.floor(position))).alias(name)

    return hits.groupBy(*by).agg(
        F.max("n").alias("n"),
        *[quantile(name, p) for name, p in probs.items()],
        F.max("max").alias("max"),
    )
