"""Physical layouts for filter-and-sort shapes, and chunked loads with progress."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """Range-partition and sort by ``keys``; ``where`` keeps only the rows of a shape."""

    keys: tuple[str, ...]
    where: str | None = None


LAYOUTS = {
    "option_filter_first": Layout(("color", "size", "stock_status", "product_id")),
    "join_key_first": Layout(("product_id", "color", "size", "stock_status")),
    "category_latest": Layout(("category_id", "created_at", "id")),
    "category_price": Layout(("category_id", "price", "id")),
    "category_brand_price": Layout(("category_id", "brand_id", "price", "id")),
    "active_latest": Layout(("created_at", "id"), "status = 'ACTIVE'"),
}


def arranged(df: DataFrame, layout: Layout, files: int | None = None) -> DataFrame:
    """Rows in the layout's order, range-partitioned on all keys.

    The last key is unique or nearly so; ranging over all keys splits even a filter value that
    a third of the rows share.
    """
    rows = df.where(layout.where) if layout.where else df
    keys = [F.col(k) for k in layout.keys]
    ranged = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*layout.keys)


def write_layout(df: DataFrame, layout: Layout, path: str, files: int | None = None) -> None:
    arranged(df, layout, files).write.mode("overwrite").parquet(path)


def write_bucketed(
    df: DataFrame, key: str, buckets: int, table: str, path: str | None = None
) -> None:
    """A bucketed and sorted table; joins on ``key`` of two such tables need no shuffle.

    Rows are hashed to their bucket first, so every bucket is written by one task as one file.
    """
    writer = (
        df.repartition(buckets, key)
        .write.mode("overwrite")
        .bucketBy(buckets, key)
        .sortBy(key)
    )
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def write_chunked(df: DataFrame, path: str, files: int | None = None) -> None:
    """Loads rows in id order; each file covers a contiguous id range."""
    write_layout(df, Layout(("id",)), path, files)


#: log2 of the chunks in a range, whose running rows are one window.
RANGE_BITS = 16


def running_total(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Adds the running sum of ``value`` in the order of the whole-number ``key``, one row per key.

    Rows are summed within ranges of 2^RANGE_BITS keys, each a window of its own, and the totals of
    the ranges before are joined to them; only the totals, one row per range, meet in one window.
    """
    # A null key comes first, as it does in the sort order.
    span = F.coalesce(F.shiftright(F.col(key).cast("long"), RANGE_BITS), F.lit(-(1 << 50)))
    totals = rows.groupBy(span.alias("of_span")).agg(F.sum(value).alias("total"))
    # Zero for every range, but no constant: the rows are hashed, not gathered.
    all_ranges = Window.partitionBy(F.shiftright(F.abs("of_span"), 62)).orderBy("of_span")
    earlier = totals.select(
        "of_span", (F.sum("total").over(all_ranges) - F.col("total")).alias("earlier")
    )
    within = F.sum(value).over(Window.partitionBy("span").orderBy(key))
    found = rows.withColumn("span", span).withColumn("within", within)
    found = found.join(earlier, F.col("span") == F.col("of_span"))
    return found.select(*rows.columns, (F.col("within") + F.col("earlier")).alias(name))


def chunk_progress(df: DataFrame, chunk: int, target: int, key: Column | str = "id") -> DataFrame:
    """Per id chunk: rows, running rows and percent of the target.

    The running total is taken over one row per chunk, range by range.
    """
    key = F.col(key) if isinstance(key, str) else key
    per_chunk = df.groupBy(F.ceil(key / chunk).alias("chunk_no")).agg(
        F.count(F.lit(1)).alias("rows_inserted")
    )
    return running_total(per_chunk, "chunk_no", "rows_inserted", "inserted_so_far").withColumn(
        "percent", F.round(F.col("inserted_so_far") * 100.0 / F.lit(float(target)), 2)
    )
