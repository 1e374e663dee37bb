"""Comparing two results that should be equal: pages, top-k lists and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.operators.readmodels import option_count
from shelfline.functions.columns import distinct_from, one_row, ratio


def page_ids(page_rows: DataFrame) -> DataFrame:
    """One row with the ids of a page in order, and an empty list for an empty page.

    ``page_rows`` has ``position`` and ``id`` and holds one page.
    """
    pairs = F.array_sort(F.collect_list(F.struct("position", "id")))
    return page_rows.agg(F.transform(pairs, lambda p: p["id"]).alias("ids"))


def _side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Positions of two pages next to each other; a shorter page leaves nulls."""
    a = left.select("position", F.col("id").alias("left_id"))
    b = right.select("position", F.col("id").alias("right_id"))
    return a.join(b, "position", "full")


def compare_pages(left: DataFrame, right: DataFrame, scenario: str, offset: int) -> DataFrame:
    """One row: page sizes, whether ids and order agree, and the first differing pair."""
    differs = distinct_from(F.col("left_id"), F.col("right_id"))
    first = F.min_by(
        F.struct("left_id", "right_id"), F.when(differs, F.col("position"))
    )
    return (
        _side_by_side(left, right)
        .agg(
            F.count("left_id").alias("source_page_count"),
            F.count("right_id").alias("read_page_count"),
            F.count_if(differs).alias("differing"),
            first.alias("first"),
        )
        .select(
            F.lit(scenario).alias("scenario"),
            F.lit(offset).alias("offset_rows"),
            "source_page_count",
            "read_page_count",
            (F.col("differing") == 0).alias("ids_match"),
            F.when(F.col("differing") > 0, F.col("first.left_id")).alias(
                "first_mismatched_source_id"
            ),
            F.when(F.col("differing") > 0, F.col("first.right_id")).alias(
                "first_mismatched_read_id"
            ),
        )
    )


def require_equal(comparison: DataFrame) -> None:
    """Raises when any compared page differs."""
    bad = comparison.where(~F.col("ids_match")).limit(1).collect()
    if bad:
        raise AssertionError(f"pages differ: {bad[0].asDict()}")


def shadow_compare(db: DataFrame, found: DataFrame, scenario: str) -> DataFrame:
    """Top-k shadow comparison: missing and extra ids, differing positions, mismatch ratio."""
    ids = (
        db.select("id", F.lit(1).alias("d"))
        .join(found.select("id", F.lit(1).alias("s")), "id", "full")
        .agg(
            F.count_if(F.col("s").isNull()).alias("missing_in_search"),
            F.count_if(F.col("d").isNull()).alias("extra_in_search"),
        )
    )
    positions = _side_by_side(db, found).agg(
        F.count("left_id").alias("db_count"),
        F.count("right_id").alias("search_count"),
        F.count_if(distinct_from(F.col("left_id"), F.col("right_id"))).alias(
            "ordering_mismatches"
        ),
    )
    mismatches = (
        F.col("missing_in_search") + F.col("extra_in_search") + F.col("ordering_mismatches")
    )
    return one_row(positions, ids).select(
        F.lit(scenario).alias("scenario"), "*", mismatches.alias("mismatch_count")
    )


def dual_run_total(report: DataFrame) -> DataFrame:
    """Sums of a shadow report and the mismatch ratio over at least one row."""
    return report.agg(
        F.count(F.lit(1)).alias("scenario_count"),
        F.sum("db_count").alias("db_count"),
        F.sum("mismatch_count").alias("mismatch_count"),
    ).withColumn(
        "mismatch_ratio",
        ratio(F.col("mismatch_count"), F.greatest(F.col("db_count"), F.lit(1)), 6),
    )


def stale_documents(docs: DataFrame, products: DataFrame) -> DataFrame:
    """Documents whose source time differs from the product's current update time."""
    current = products.select("id", F.col("updated_at").alias("db_updated_at"))
    return (
        docs.select("id", "source_updated_at")
        .join(current, "id", "left")
        .where(distinct_from(F.col("source_updated_at"), F.col("db_updated_at")))
    )


#: Scalar fields of the document comparison.
COMPARED_FIELDS = [
    "seller_id",
    "category_id",
    "brand_id",
    "status",
    "price",
    "rating",
    "review_count",
    "created_at",
    "updated_at",
]


def compare_documents(
    left: DataFrame, right: DataFrame, fields: list[str] | None = None
) -> DataFrame:
    """(id, field, left_value, right_value) for every differing field of ids on both sides.

    Options are compared by the number of rows they stand for and then by position, each entry
    as a whole.
    """
    fields = fields or COMPARED_FIELDS
    renamed = right.select(
        "id", *[F.col(f).alias(f"r_{f}") for f in fields], F.col("options").alias("r_options")
    )
    both = left.select("id", *fields, "options").join(renamed, "id")

    def entry(name: Column, a: Column, b: Column) -> Column:
        return F.struct(
            name.alias("field"),
            a.cast("string").alias("left_value"),
            b.cast("string").alias("right_value"),
        )

    scalar = [
        F.when(
            distinct_from(F.col(f), F.col(f"r_{f}")),
            entry(F.lit(f), F.col(f), F.col(f"r_{f}")),
        )
        for f in fields
    ]
    count, r_count = option_count("options"), option_count("r_options")
    sizes = F.when(count != r_count, entry(F.lit("options.count"), count, r_count))
    pairs = F.arrays_zip(F.col("options").alias("a"), F.col("r_options").alias("b"))
    by_position = F.transform(
        pairs,
        lambda p, i: F.when(
            distinct_from(p["a"], p["b"]),
            entry(
                F.concat(F.lit("options["), i.cast("string"), F.lit("]")),
                F.to_json(p["a"]),
                F.to_json(p["b"]),
            ),
        ),
    )
    all_entries = F.concat(
        F.array(*scalar, sizes),
        F.when(count == r_count, by_position).otherwise(F.array()),
    )
    return both.select("id", F.inline(F.array_compact(all_entries)))


def id_set_diff(source: DataFrame, read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(missing, extra) ids between two tables with an ``id`` column."""
    a, b = source.select("id"), read.select("id")
    return a.join(b, "id", "left_anti"), b.join(a, "id", "left_anti")
