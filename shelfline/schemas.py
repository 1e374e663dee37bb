"""Explicit schemas, value domains and row rules of the product-search data model."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

# The closed value domains of the model.
COLORS = ["BLACK", "WHITE", "RED", "BLUE", "GREEN", "GRAY", "NAVY", "BEIGE"]
SIZES = ["XS", "S", "M", "L", "XL", "FREE"]
STOCK_STATUSES = ["IN_STOCK", "LOW_STOCK", "OUT_OF_STOCK"]
PRODUCT_STATUSES = ["ACTIVE", "SOLD_OUT", "DELETED"]
EVENT_TYPES = [
    "PRODUCT_CREATED",
    "PRODUCT_UPDATED",
    "PRODUCT_DELETED",
    "PRODUCT_STATUS_CHANGED",
    "PRODUCT_OPTION_CHANGED",
]
OUTBOX_STATUSES = ["PENDING", "PROCESSING", "DONE", "FAILED"]

#: A product has at most this many different (color, size, stock_status) triples.
MAX_DISTINCT_OPTIONS = len(COLORS) * len(SIZES) * len(STOCK_STATUSES)


_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "decimal(3,2)": T.DecimalType(3, 2),
    "array<string>": T.ArrayType(T.StringType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _struct(spec: str, **more: T.DataType) -> T.StructType:
    """Schema from lines of ``name type``; a trailing ``?`` marks a nullable column."""
    fields = []
    for line in spec.strip().splitlines():
        name, kind = line.split()
        fields.append(T.StructField(name, _TYPES[kind.rstrip("?")], kind.endswith("?")))
    fields += [T.StructField(name, kind) for name, kind in more.items()]
    return T.StructType(fields)


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


PRODUCTS = _struct("""
    id bigint
    seller_id bigint
    category_id bigint
    brand_id bigint
    status string
    price int
    rating decimal(3,2)
    review_count int
    created_at timestamp_ntz
    updated_at timestamp_ntz
""")

OPTIONS = _struct("""
    id bigint
    product_id bigint
    color string
    size string
    stock_status string
""")

OUTBOX = _struct("""
    id bigint
    aggregate_type string
    aggregate_id bigint
    event_type string
    schema_version int
    payload string
    status string
    claim_token string?
    claimed_by string?
    claimed_at timestamp?
    retry_count int
    last_error string?
    next_retry_at timestamp?
    created_at timestamp
    updated_at timestamp
    processed_at timestamp?
""")

PAYLOAD = _struct("""
    productId bigint?
    eventType string?
    sourceUpdatedAt string?
    tombstone boolean?
    changedFields array<string>?
    previousStatus string?
    newStatus string?
    smokeRun string?
""")

#: One entry per different triple of a product; ``copies`` counts the source rows behind it.
OPTION_ENTRY = "struct<color:string,size:string,stock_status:string,copies:bigint>"

SIGNATURE_TABLE = _struct("""
    product_id bigint
    seller_id bigint
    category_id bigint
    brand_id bigint
    status string
    price int
    rating decimal(3,2)
    created_at timestamp_ntz
    updated_at timestamp_ntz
    review_count int
    option_signatures array<string>
    source_updated_at timestamp_ntz
    document_refreshed_at timestamp
""")

#: A document in model form, as the snapshot store keeps it.
DOCUMENTS = T.StructType(
    [
        *PRODUCTS.fields,
        T.StructField(
            "options",
            T.ArrayType(
                T.StructType(
                    [
                        *_strings("color", "size", "stock_status").fields,
                        T.StructField("copies", T.LongType()),
                    ]
                )
            ),
        ),
        T.StructField("source_updated_at", T.TimestampNTZType()),
        T.StructField("document_refreshed_at", T.TimestampNTZType()),
    ]
)

#: JSON form of a document; the same field names travel through source and sink.
DOCUMENT_JSON = _struct("""
    productId bigint?
    sellerId bigint?
    categoryId bigint?
    brandId bigint?
    status string?
    price int?
    rating decimal(3,2)?
    reviewCount int?
    createdAt string?
    updatedAt string?
    sourceUpdatedAt string?
    documentRefreshedAt string?
""", options=T.ArrayType(
    T.StructType(
        [
            *_strings("color", "size", "stockStatus").fields,
            T.StructField("copies", T.LongType()),  # only in documents written with counted options
        ]
    )
))

API_COLUMNS = [f.name for f in PRODUCTS.fields]


def product_rules() -> dict:
    """Row rules of ``products`` as boolean columns; each must hold for every row."""
    return {
        "status_in_domain": F.col("status").isin(PRODUCT_STATUSES),
        "price_not_negative": F.col("price") >= 0,
        "rating_0_to_5": F.col("rating").between(0, 5),
        "review_count_not_negative": F.col("review_count") >= 0,
    }


def option_rules() -> dict:
    return {
        "color_in_domain": F.col("color").isin(COLORS),
        "size_in_domain": F.col("size").isin(SIZES),
        "stock_status_in_domain": F.col("stock_status").isin(STOCK_STATUSES),
    }


def outbox_rules() -> dict:
    finished = F.col("status").isin("DONE", "FAILED")
    return {
        "event_type_in_domain": F.col("event_type").isin(EVENT_TYPES),
        "status_in_domain": F.col("status").isin(OUTBOX_STATUSES),
        "schema_version_positive": F.col("schema_version") >= 1,
        "retry_count_not_negative": F.col("retry_count") >= 0,
        "finished_has_processed_at": ~finished | F.col("processed_at").isNotNull(),
    }
