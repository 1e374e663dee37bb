"""Column functions used across the read models. All are built-in expressions, no Python UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"
SIGNATURE_DELIMITER = "|"


def option_signature(color, size, stock_status) -> Column:
    """``color|size|stock``; null when any part is null."""
    bar = F.lit(SIGNATURE_DELIMITER)
    return F.concat(F.col(color), bar, F.col(size), bar, F.col(stock_status))


def register_sql_functions(spark: SparkSession) -> None:
    """Make ``product_option_signature(c, s, k)`` available to SQL text of this session."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION product_option_signature"
        "(c STRING, s STRING, k STRING) RETURNS STRING RETURN concat(c, '|', s, '|', k)"
    )


def distinct_from(left: Column, right: Column) -> Column:
    return ~left.eqNullSafe(right)


def has_delimiter(*names: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(n).contains(SIGNATURE_DELIMITER) for n in names])


def truncated(text: Column, limit: int = 1000) -> Column:
    return F.substring(text, 1, limit)


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, ISO_SECONDS)


def iso_wall_clock(text: Column) -> Column:
    """ISO text to ``timestamp_ntz``; an offset or ``Z`` is dropped and the wall clock kept."""
    return F.regexp_replace(text, r"(Z|[+-]\d{2}:\d{2})$", "").try_cast("timestamp_ntz")


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1000.0)


def elapsed_s(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1000000.0)


def plus_ms(ts: Column, ms: Column | int) -> Column:
    ms = ms if isinstance(ms, Column) else F.lit(ms)
    return F.timestamp_add("MILLISECOND", ms, ts)


def wait_or_unknown(start: Column, end: Column) -> Column:
    """Whole milliseconds from start to end; -1 when either is missing or the order is wrong."""
    ms = F.floor(elapsed_ms(start, end)).cast("long")
    return F.when(ms >= 0, ms).otherwise(F.lit(-1).cast("long"))


def share(part: Column, whole: Column, digits: int) -> Column:
    return F.round(part.cast("double") * 100.0 / whole.cast("double"), digits)


def ratio(part: Column, whole: Column, digits: int) -> Column:
    """part / whole, null when whole is 0."""
    return F.round(part.cast("double") / F.nullif(whole, F.lit(0)).cast("double"), digits)


def case(branches: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """CASE over (condition, value) pairs."""
    expr = reduce(lambda e, branch: e.when(*branch), branches, F)
    return expr if otherwise is None else expr.otherwise(otherwise)


def first_bucket(value: Column, bounds: list[tuple], otherwise: str) -> Column:
    """Label of the first bucket whose inclusive upper bound is not exceeded."""
    return case([(value <= F.lit(u), F.lit(label)) for u, label in bounds], F.lit(otherwise))


# Bucket labels and inclusive upper bounds of the distribution reports.
PRICE_BUCKETS = [
    (9_999, "001_1k_to_9,999"),
    (100_000, "002_10k_to_100k"),
    (300_000, "003_100,001_to_300k"),
    (700_000, "004_300,001_to_700k"),
]
PRICE_BUCKET_LAST = "005_700,001_to_1m"
REVIEW_BUCKETS = [(20, "001_0_to_20"), (200, "002_21_to_200"), (999, "003_201_to_999")]
REVIEW_BUCKET_LAST = "004_1000_plus"
AGE_BUCKETS = [
    (30, "001_recent_30_days"),
    (180, "002_31_to_180_days"),
    (365, "003_181_to_365_days"),
    (730, "004_366_to_730_days"),
]
AGE_BUCKET_LAST = "005_older_than_730_days"


def price_bucket(price: Column) -> Column:
    return first_bucket(price, PRICE_BUCKETS, PRICE_BUCKET_LAST)


def review_bucket(review_count: Column) -> Column:
    return first_bucket(review_count, REVIEW_BUCKETS, REVIEW_BUCKET_LAST)


def age_bucket(created_at: Column, now: Column) -> Column:
    """Age of a row against a given ``now``; the edge of a bucket belongs to the younger one."""
    age = F.timestamp_diff("MICROSECOND", created_at, now)
    day = 86_400_000_000
    return first_bucket(age, [(d * day, label) for d, label in AGE_BUCKETS], AGE_BUCKET_LAST)


def payload_field(name: str, payload: str = "payload") -> Column:
    return F.get_json_object(F.col(payload), f"$.{name}")


def one_row(*frames: DataFrame) -> DataFrame:
    """Several one-row tables with different columns as one row; no join is needed for that."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
