"""The product-search model read from an order / line item / event star schema.

Orders become products, line items become options, events become the change outbox. Each
function is one projection over one scan, so column pruning reaches the parquet reader.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline import schemas
from shelfline.functions.columns import case, plus_ms


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _translate(column: str, mapping: dict[str, str]) -> Column:
    return case([(F.col(column) == key, F.lit(value)) for key, value in mapping.items()])


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        cust.alias("seller_id"),
        (cust % 5 + 1).alias("category_id"),
        (cust % 25 + 1).alias("brand_id"),
        _translate("o_orderstatus", {"O": "ACTIVE", "F": "SOLD_OUT", "P": "DELETED"}).alias(
            "status"
        ),
        F.floor("o_totalprice").cast("int").alias("price"),
        ((key % 501).cast("double") / 100).alias("rating"),
        ((key * 122949 + 77777) % 200).cast("int").alias("review_count"),
        F.col("o_orderdate").alias("created_at"),
        F.timestamp_add("DAY", (key % 60).cast("int"), F.col("o_orderdate")).alias("updated_at"),
    )


def option_columns() -> list[Column]:
    return [
        F.col("l_orderkey").alias("product_id"),
        _pick(schemas.COLORS, F.col("l_partkey") % 8).alias("color"),
        _pick(schemas.SIZES, F.col("l_suppkey") % 6).alias("size"),
        _translate(
            "l_returnflag", {"A": "IN_STOCK", "N": "LOW_STOCK", "R": "OUT_OF_STOCK"}
        ).alias("stock_status"),
    ]


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*option_columns())


def option_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``options`` with an ``id`` that orders the rows of a product."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("id")
    return table(spark, sf_dir, "lineitem").select(order, *option_columns())


def outbox_from_events(events: DataFrame) -> DataFrame:
    """Outbox rows from an events frame, batch or streaming."""
    eid, turn = F.col("event_id"), F.col("event_id") % 20
    status = (
        F.when(turn < 16, "DONE")
        .when(turn < 18, "PENDING")
        .when(turn == 18, "PROCESSING")
        .otherwise("FAILED")
    )
    staged = events.select(
        eid.alias("id"),
        F.lit("PRODUCT").alias("aggregate_type"),
        (F.col("user_id") * 101).alias("aggregate_id"),
        _translate(
            "event_type",
            {
                "signup": "PRODUCT_CREATED",
                "click": "PRODUCT_UPDATED",
                "error": "PRODUCT_DELETED",
                "view": "PRODUCT_STATUS_CHANGED",
                "purchase": "PRODUCT_OPTION_CHANGED",
            },
        ).alias("event_type"),
        F.lit(1).alias("schema_version"),
        F.col("props").alias("payload"),
        status.alias("status"),
        F.when(status == "PROCESSING", F.concat(F.lit("token-"), eid % 3)).alias("claim_token"),
        F.when(status != "PENDING", F.concat(F.lit("relay-"), eid % 4)).alias("claimed_by"),
        F.when(
            status != "PENDING",
            plus_ms(F.col("ts"), F.floor(F.col("value") * 100).cast("int")),
        ).alias("claimed_at"),
        (eid % 4).cast("int").alias("retry_count"),
        F.lit(None).cast("string").alias("last_error"),
        F.when(eid % 40 == 16, F.timestamp_add("DAY", F.lit(40), F.col("ts"))).alias(
            "next_retry_at"
        ),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("processed_at"),
    )
    finished = F.col("status").isin("DONE", "FAILED")
    processed = F.when(finished, plus_ms(F.col("claimed_at"), 250))
    return staged.withColumn("processed_at", processed).withColumn(
        "updated_at", F.coalesce("processed_at", "claimed_at", "created_at")
    )


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox_from_events(table(spark, sf_dir, "events"))
