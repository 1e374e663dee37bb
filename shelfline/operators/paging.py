"""Pages of an ordered result: offset, keyset and deep-offset forms, positions and cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.operators.spec import RESULT_WINDOW, SearchSpec
from shelfline.sources.layout import running_total
from shelfline.sources.snapshots import id_bucket

#: Up to this many leading rows a page is one top-k, of which every task contributes as many
#: rows; beyond it rank selection takes over and leaves at most ``DEEP_SKIP`` rows to skip. Both
#: give the same rows in the same order, null keys included.
TOP_K_LIMIT = RESULT_WINDOW
DEEP_SKIP = 1_000


def page(rows: DataFrame, spec: SearchSpec) -> DataFrame:
    """The requested page. Shallow pages are a top-k; deep ones find their start by counting."""
    if spec.offset + spec.limit > TOP_K_LIMIT:
        return deep_page(rows, spec)
    ordered = rows.orderBy(*spec.order())
    if spec.offset:
        ordered = ordered.offset(spec.offset)
    return ordered.limit(spec.limit)


def check_result_window(spec: SearchSpec, window: int = RESULT_WINDOW) -> None:
    if spec.offset + spec.limit > window:
        raise ValueError(f"offset + limit exceeds the result window of {window}")


def _beyond(column: Column, value, ascending: bool) -> Column:
    return column > value if ascending else column < value


def after_cursor(spec: SearchSpec, key_value, id_value) -> Column:
    """Rows strictly after (key, id) in the sort order.

    Written as a plain range test plus a tie test, so that the range reaches the file scan.
    """
    name, ascending = spec.sort_keys()
    key, rid = F.col(name), F.col("id")
    reached = key >= key_value if ascending else key <= key_value
    return reached & (_beyond(key, key_value, ascending) | _beyond(rid, id_value, ascending))


def keyset_page(rows: DataFrame, spec: SearchSpec, cursor: tuple | None) -> DataFrame:
    """The page after a cursor (key value, id); without a cursor the first page."""
    if cursor is not None:
        rows = rows.where(after_cursor(spec, F.lit(cursor[0]), F.lit(cursor[1])))
    return rows.orderBy(*spec.order()).limit(spec.limit)


def cursor_row(rows: DataFrame, spec: SearchSpec, offset: int) -> DataFrame:
    """One row (cursor_key, cursor_id): the last row before ``offset``; nulls when short."""
    name, _ = spec.sort_keys()
    last = page(
        rows.select("id", name), spec.at(limit=1, offset=offset - 1)
    )
    return last.agg(F.max(name).alias("cursor_key"), F.max("id").alias("cursor_id"))


def derive_cursor(rows: DataFrame, spec: SearchSpec, offset: int) -> tuple | None:
    row = cursor_row(rows, spec, offset).first()
    return None if row.cursor_id is None else (row.cursor_key, row.cursor_id)


def with_position(page_rows: DataFrame, spec: SearchSpec) -> DataFrame:
    """Numbers the rows of one page from 1; only for pages, which hold at most 100 rows."""
    return page_rows.withColumn("position", F.row_number().over(Window.orderBy(*spec.order())))


def page_summary(page_rows: DataFrame, spec: SearchSpec) -> DataFrame:
    return page_rows.agg(F.count(F.lit(1)).alias("returned_count")).select(
        F.lit(spec.limit).alias("limit"), F.lit(spec.offset).alias("offset"), "returned_count"
    )


def deep_page(rows: DataFrame, spec: SearchSpec) -> DataFrame:
    """A page at any depth, without moving the skipped rows to one task.

    Counting rows per slice of the sort key narrows down where the page starts; if very many
    rows share that key, counting per slice of the id does the same among them. What is left
    to skip then fits an ordinary top-k. A null key ranks below all others, as it does in the
    sort order. The counting jobs run when the function is called.
    """
    name, ascending = spec.sort_keys()
    plain = _as_long(rows, name)
    least = rows.agg(F.coalesce(F.min(plain), F.lit(0)).alias("v")).first().v - 1
    key = F.coalesce(plain, F.lit(least))
    start, before = narrow(rows, key, spec.offset, ascending, DEEP_SKIP)
    if start is None:
        return rows.limit(0)
    lo, hi = start
    skip = spec.offset - before
    # Plain ranges, which reach the file scan.
    rest = rows
    if not ascending:
        rest = rows.where((plain <= hi) | plain.isNull())
    elif lo > least:
        rest = rows.where(plain >= lo)
    if skip > DEEP_SKIP:  # lo == hi: one key value holds more rows than should be skipped
        tied = rows.where(key == lo)
        (lo_id, hi_id), before_id = narrow(tied, F.col("id"), skip, ascending, DEEP_SKIP)
        skip -= before_id
        reached = F.col("id") >= lo_id if ascending else F.col("id") <= hi_id
        rest = rest.where(_beyond(key, lo, ascending) | reached)
    return rest.orderBy(*spec.order()).offset(skip).limit(spec.limit)


SLICES = 16_384


def _as_long(rows: DataFrame, name: str) -> Column:
    if rows.schema[name].dataType.simpleString().startswith("timestamp"):
        epoch = F.lit("1970-01-01").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, F.col(name))
    return F.col(name).cast("long")


def slice_counts(rows: DataFrame, value: Column, lo: int, hi: int) -> tuple[int, list]:
    """Width and non-empty (slice number, rows) of at most ``SLICES`` equal slices of [lo, hi]."""
    width = (hi - lo) // SLICES + 1
    number = F.call_function("div", value - F.lit(lo), F.lit(width))
    counts = (
        rows.where(value.between(lo, hi)).groupBy(number.alias("slice")).count().collect()
    )
    return width, sorted((c["slice"], c["count"]) for c in counts)


def narrow(rows: DataFrame, value: Column, rank: int, ascending: bool, enough: int):
    """Smallest needed value range that holds the row of 0-based ``rank``, and the rows before.

    Every pass counts into a bounded number of slices and descends into one of them, until no
    more than ``enough`` rows of the range lie before the rank or the range is one value.
    A negative ``enough`` always goes on to one value.
    """
    bounds = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if bounds.lo is None:
        return None, 0
    lo, hi, before = bounds.lo, bounds.hi, 0
    while True:
        width, counts = slice_counts(rows, value, lo, hi)
        for number, count in counts if ascending else reversed(counts):
            if before + count > rank:
                base = lo
                lo, hi = base + number * width, min(hi, base + (number + 1) * width - 1)
                break
            before += count
        else:
            return None, before
        if rank - before <= enough or lo == hi:
            return (lo, hi), before


def id_windows(ids: DataFrame, batch_size: int, after: int | None = None) -> DataFrame:
    """(batch, lo, hi, rows): consecutive id ranges of at most ``batch_size`` ids above ``after``.

    Ids are counted by fixed id ranges, an eighth of a batch wide; the running total of these counts
    says which batch a range belongs to, so the plan takes the same few shuffles whatever the number
    of ids and none of it passes through the driver. Totals include the ids up to ``after``: a plan
    that starts later cuts what is left at the same places. Ids are unique and not null.
    """
    width = max(1, batch_size // 8)
    left = F.lit(True) if after is None else F.col("id") > after
    counts = ids.where("id IS NOT NULL").groupBy(id_bucket(width).alias("range")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(left).alias("rows"),
        F.min(F.when(left, F.col("id"))).alias("lo"),
        F.max(F.when(left, F.col("id"))).alias("hi"),
    )
    # The last range of a batch begins below the batch's end and holds at most ``width`` ids.
    room = batch_size - width + 1
    batch = F.call_function("div", F.col("until") - F.col("n"), F.lit(room))
    return (
        running_total(counts, "range", "n", "until")
        .where("rows > 0")
        .groupBy(batch.alias("batch"))
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("rows").alias("rows"))
    )
