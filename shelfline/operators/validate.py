"""Validation of read models against their sources, as report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.functions.columns import distinct_from, has_delimiter
from shelfline.functions.small import checked

EXAMPLES = 50


def rule_violations(df: DataFrame, rules: dict[str, Column], table: str = "") -> DataFrame:
    """(table_name, rule, violations): all rules in one pass. A null rule result is no violation."""
    counts = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    entries = [
        F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules
    ]
    return counts.select(F.inline(F.array(*entries))).select(
        F.lit(table).alias("table_name"), "rule", "violations"
    )


def null_violations(df: DataFrame, columns: list[str], table: str = "") -> DataFrame:
    """Rows with a null in a column that must have a value, per column."""
    return rule_violations(df, {f"{c}_not_null": F.col(c).isNotNull() for c in columns}, table)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def products_without_options(products: DataFrame, options: DataFrame) -> DataFrame:
    owners = options.select(F.col("product_id").alias("id")).distinct()
    return products.join(owners, "id", "left_anti")


def orphan_options(products: DataFrame, options: DataFrame) -> DataFrame:
    """Option rows whose product does not exist.

    Orphan product ids are found first, on distinct ids; rows are fetched by them afterwards,
    without moving the options as long as few products are missing.
    """
    lost = (
        options.select(F.col("product_id").alias("id"))
        .distinct()
        .join(products.select("id"), "id", "left_anti")
        .withColumnRenamed("id", "product_id")
    )
    return options.join(checked(lost), "product_id", "left_semi")


def source_signature_counts(options: DataFrame) -> DataFrame:
    """Different complete triples per product; duplicates go before the shuffle."""
    complete = options.where("color IS NOT NULL AND size IS NOT NULL AND stock_status IS NOT NULL")
    triple = F.struct("color", "size", "stock_status")
    return complete.groupBy("product_id").agg(
        F.size(F.collect_set(triple)).cast("long").alias("source_signature_count")
    )


def signature_count_mismatches(options: DataFrame, table: DataFrame) -> DataFrame:
    read = table.select(
        "product_id", F.size("option_signatures").cast("long").alias("read_signature_count")
    )
    return (
        source_signature_counts(options)
        .join(read, "product_id")
        .where(F.col("source_signature_count") != F.col("read_signature_count"))
    )


API_FIELDS = ["seller_id", "rating", "updated_at"]


def api_field_mismatches(
    products: DataFrame, table: DataFrame, fields: list[str] | None = None
) -> DataFrame:
    """Rows of the read table whose API fields differ from the source."""
    fields = fields or API_FIELDS
    source = products.select(
        F.col("id").alias("product_id"), *[F.col(f).alias(f"source_{f}") for f in fields]
    )
    read = table.select("product_id", *[F.col(f).alias(f"read_{f}") for f in fields])
    differs = [distinct_from(F.col(f"read_{f}"), F.col(f"source_{f}")) for f in fields]
    return read.join(source, "product_id").where(reduce(lambda a, b: a | b, differs))


def api_field_mismatch_counts(
    products: DataFrame, table: DataFrame, fields: list[str] | None = None
) -> DataFrame:
    fields = fields or API_FIELDS
    return api_field_mismatches(products, table, fields).agg(
        *[
            F.count_if(distinct_from(F.col(f"read_{f}"), F.col(f"source_{f}"))).alias(
                f"{f}_mismatch_count"
            )
            for f in fields
        ]
    )


def fingerprint(
    products: DataFrame, options: DataFrame, table: DataFrame, profile: str
) -> DataFrame:
    """Row count, id range and newest time of each table; options carry no time."""

    def one(name, df, key, time):
        return df.agg(
            F.count(F.lit(1)).alias("row_count"),
            F.min(key).alias("min_id"),
            F.max(key).alias("max_id"),
            (F.max(time) if time else F.lit(None).cast("timestamp_ntz")).alias("max_updated_at"),
        ).select(F.lit(profile).alias("profile"), F.lit(name).alias("table_name"), "*")

    return _union(
        [
            one("products", products, "id", "updated_at"),
            one("options", options, "product_id", None),
            one("read_table", table, "product_id", "source_updated_at"),
        ]
    )


def signature_integrity(table: DataFrame) -> DataFrame:
    return table.agg(
        F.count_if(F.col("option_signatures").isNull()).alias("option_signatures_null_count"),
        F.count_if(F.size("option_signatures") == 0).alias("option_signatures_empty_count"),
        *[F.count_if(F.col(f).isNull()).alias(f"{f}_null_count") for f in API_FIELDS],
    )


#: Checks of the read model: name -> condition on a row of :func:`read_model_rows`.
CHECKS = {
    "products_without_options": lambda: F.col("known") & F.col("source_signature_count").isNull(),
    "missing_from_read": lambda: F.col("known") & ~F.col("read"),
    "missing_though_it_has_options": lambda: F.col("known")
    & ~F.col("read")
    & F.col("source_signature_count").isNotNull(),
    "extra_in_read": lambda: F.col("read") & ~F.col("known"),
    "signature_count_mismatch": lambda: F.col("read")
    & (F.col("source_signature_count") != F.col("read_signature_count")),
    "api_field_mismatch": lambda: F.col("known") & F.col("read") & F.col("fields_differ"),
    "null_or_empty_signatures": lambda: F.col("read")
    & (F.coalesce("read_signature_count", F.lit(0)) == 0),
    "delimiter_collision": lambda: F.coalesce("has_delimiter", F.lit(False)),
}
#: Checks that describe the data; they do not fail the read model.
INFORMATIVE = ["products_without_options", "missing_from_read"]


def read_model_rows(products: DataFrame, options: DataFrame, table: DataFrame) -> DataFrame:
    """One row per id known to products, options or read table, with all that is checked.

    Each table is read once; options collapse to one row per product before they move.
    """
    source = products.select(
        "id", F.lit(True).alias("is_product"), *[F.col(f).alias(f"p_{f}") for f in API_FIELDS]
    )
    triple = F.struct("color", "size", "stock_status")
    complete = F.when(
        F.col("color").isNotNull() & F.col("size").isNotNull() & F.col("stock_status").isNotNull(),
        triple,
    )
    owned = options.groupBy(F.col("product_id").alias("id")).agg(
        F.nullif(F.size(F.collect_set(complete)), F.lit(0)).alias("source_signature_count"),
        F.bool_or(has_delimiter("color", "size", "stock_status")).alias("has_delimiter"),
    )
    read = table.select(
        F.col("product_id").alias("id"),
        F.lit(True).alias("is_read"),
        F.size("option_signatures").alias("read_signature_count"),
        *[F.col(f).alias(f"r_{f}") for f in API_FIELDS],
    )
    differs = [distinct_from(F.col(f"p_{f}"), F.col(f"r_{f}")) for f in API_FIELDS]
    return (
        source.join(owned, "id", "full")
        .join(read, "id", "full")
        .select(
            "id",
            F.col("is_product").isNotNull().alias("known"),
            F.col("is_read").isNotNull().alias("read"),
            "source_signature_count",
            "read_signature_count",
            "has_delimiter",
            reduce(lambda a, b: a | b, differs).alias("fields_differ"),
        )
    )


def validate_read_model(
    products: DataFrame, options: DataFrame, table: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(report, examples) of the signature table.

    The report has one row per check with its value and whether it passes; all checks are
    aggregates of one joined pass. Examples show up to 50 ids per check with findings; the
    limit is applied in every task before rows move.
    """
    rows = read_model_rows(products, options, table)
    found = {name: F.coalesce(test(), F.lit(False)) for name, test in CHECKS.items()}
    sums = rows.agg(
        *[F.count_if(test).alias(name) for name, test in found.items()],
        F.count_if("known").alias("_products"),
        F.count_if("read").alias("_read"),
    )
    entries = [
        F.struct(
            F.lit(name).alias("check_name"),
            F.col(name).alias("value"),
            (F.lit(name in INFORMATIVE) | (F.col(name) == 0)).alias("passes"),
        )
        for name in found
    ]
    size_match = F.struct(
        F.lit("row_count_match").alias("check_name"),
        F.col("_read").alias("value"),
        (F.col("_read") == F.col("_products")).alias("passes"),
    )
    report = sums.select(F.inline(F.array(*entries, size_match)))
    failing = F.array_compact(
        F.array(*[F.when(test, F.lit(name)) for name, test in found.items()])
    )
    place = F.row_number().over(Window.partitionBy("check_name").orderBy("id"))
    examples = (
        rows.select("id", F.explode(failing).alias("check_name"))
        .withColumn("place", place)
        .where(F.col("place") <= EXAMPLES)
        .select("check_name", "id")
    )
    return report, examples
