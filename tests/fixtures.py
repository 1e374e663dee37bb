"""Small hand-made tables."""

from pyspark.sql import functions as F

from shelfline import schemas

T0 = "2026-05-02 12:00:00"


def products(spark, rows):
    """Rows of (id, status, price, review_count, updated_at) in category 75, brand 943."""
    df = spark.createDataFrame(
        rows, "id long, status string, price int, review_count int, updated_at string"
    )
    return df.select(
        "id",
        (-F.col("id")).alias("seller_id"),
        F.lit(75).cast("long").alias("category_id"),
        F.lit(943).cast("long").alias("brand_id"),
        "status",
        "price",
        F.lit("4.20").cast("decimal(3,2)").alias("rating"),
        "review_count",
        F.lit(T0).cast("timestamp_ntz").alias("created_at"),
        F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
    )


def options(spark, rows):
    return spark.createDataFrame(rows, schemas.OPTIONS)


def events(spark, rows, now=T0):
    """Outbox rows of (id, aggregate_id, event_type, overrides)."""
    at = F.lit(now).cast("timestamp")
    base = spark.createDataFrame(
        [r[:3] for r in rows], "id long, aggregate_id long, event_type string"
    )
    from shelfline.operators.outbox import pending_events

    df = pending_events(base, F.lit("{}"), at)
    for row in rows:
        for column, value in (row[3] if len(row) > 3 else {}).items():
            kind = df.schema[column].dataType
            df = df.withColumn(
                column,
                F.when(F.col("id") == row[0], F.lit(value).cast(kind)).otherwise(F.col(column)),
            )
    return df


def frozen(df):
    """The same rows without the plan behind them."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


CATCHUP_PRODUCTS = [
    (-20002004, "ACTIVE", 11900, 301, "2026-05-02 12:00:00"),
    (-20002003, "ACTIVE", 20900, 22, "2026-05-02 12:02:00"),
    (-20002002, "ACTIVE", 32900, 87, "2026-05-02 12:04:00"),
    (-20002001, "ACTIVE", 45900, 151, "2026-05-02 12:10:00"),
]
CATCHUP_OPTIONS = [
    (-2000200401, -20002004, "BLACK", "S", "IN_STOCK"),
    (-2000200402, -20002004, "WHITE", "M", "IN_STOCK"),
    (-2000200301, -20002003, "GRAY", "M", "LOW_STOCK"),
    (-2000200201, -20002002, "BLUE", "FREE", "IN_STOCK"),
    (-2000200101, -20002001, "NAVY", "M", "IN_STOCK"),
]
