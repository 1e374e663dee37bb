"""Documents as JSON files: a strict source, a sink and the two-line bulk export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline import schemas
from shelfline.functions.columns import iso_text, iso_wall_clock
from shelfline.operators.readmodels import expanded_options

CORRUPT = "_corrupt"
#: Fields a search result must carry; the rest may be missing.
REQUIRED_FIELDS = [
    "productId",
    "sellerId",
    "categoryId",
    "brandId",
    "status",
    "price",
    "rating",
    "reviewCount",
    "createdAt",
    "updatedAt",
]
SNAKE = {
    "productId": "id",
    "sellerId": "seller_id",
    "categoryId": "category_id",
    "brandId": "brand_id",
    "status": "status",
    "price": "price",
    "rating": "rating",
    "reviewCount": "review_count",
    "createdAt": "created_at",
    "updatedAt": "updated_at",
    "sourceUpdatedAt": "source_updated_at",
    "documentRefreshedAt": "document_refreshed_at",
}


def _loose(schema: T.StructType) -> T.StructType:
    """All scalars as text, so that ``"35"`` and ``35`` are both accepted and judged later."""
    fields = [
        T.StructField(f.name, f.dataType if f.name == "options" else T.StringType())
        for f in schema.fields
    ]
    return T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of a JSON folder.

    A row is rejected, with the reason, when its JSON is malformed, a required field is missing
    or a value does not fit its type. Documents come in model form.
    """
    raw = (
        spark.read.schema(_loose(schemas.DOCUMENT_JSON))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    types = {f.name: f.dataType.simpleString() for f in schemas.DOCUMENT_JSON.fields}

    def value(name):
        if name.endswith("At"):
            return iso_wall_clock(F.col(name))
        if types[name] in ("bigint", "int"):
            # a number with a fraction is cut like a numeric cast, text must be a whole number
            return F.col(name).try_cast("decimal(38,9)").try_cast(types[name])
        return F.col(name).try_cast(types[name])

    missing = [
        F.when(F.col(n).isNull(), F.lit(f"missing required field: {n}")) for n in REQUIRED_FIELDS
    ]
    unfit = [
        F.when(F.col(n).isNotNull() & value(n).isNull(), F.lit(f"malformed value: {n}"))
        for n in SNAKE
    ]
    reason = F.coalesce(
        F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed json")), *missing, *unfit
    )
    judged = raw.withColumn("reason", reason)
    triple = ["color", "size", "stockStatus"]

    def only_triple(o):
        return F.struct(*[o[c].alias(c) for c in triple])

    def copies(t):
        equal = F.filter("options", lambda o: only_triple(o).eqNullSafe(t))
        ones = F.transform(equal, lambda o: F.coalesce(o["copies"], F.lit(1).cast("long")))
        return F.aggregate(ones, F.lit(0).cast("long"), lambda n, one: n + one)

    counted = F.transform(
        F.array_distinct(F.transform("options", only_triple)),
        lambda t: F.struct(
            t["color"].alias("color"),
            t["size"].alias("size"),
            t["stockStatus"].alias("stock_status"),
            copies(t).alias("copies"),
        ),
    )
    docs = judged.where(F.col("reason").isNull()).select(
        *[value(n).alias(snake) for n, snake in SNAKE.items()],
        F.coalesce(
            counted, F.array().cast(f"array<{schemas.OPTION_ENTRY}>")
        ).alias("options"),
    )
    rejects = judged.where(F.col("reason").isNotNull()).select(
        "reason", F.col("productId").alias("product_id"), F.col(CORRUPT).alias("raw")
    )
    return docs, rejects


def to_json_fields(docs: DataFrame, counted: bool = False) -> DataFrame:
    """The 13 camelCase fields with ISO times and the full option list, or a counted one."""
    camel = [
        (iso_text(F.col(snake)) if name.endswith("At") else F.col(snake)).alias(name)
        for name, snake in SNAKE.items()
    ]
    return docs.select(*camel, expanded_options(counted=counted).alias("options"))


def write_documents(docs: DataFrame, path: str, counted: bool = False) -> None:
    to_json_fields(docs, counted).write.mode("overwrite").json(path)


def bulk_lines(docs: DataFrame, counted: bool = False) -> DataFrame:
    """Two lines per document: line_order 0 is the action, 1 the source."""
    fields = to_json_fields(docs, counted)
    action = F.to_json(F.struct(F.struct(F.col("productId").alias("_id")).alias("index")))
    source = F.to_json(F.struct(*fields.columns))
    lines = F.array(
        F.struct(F.lit(0).alias("line_order"), action.alias("line")),
        F.struct(F.lit(1).alias("line_order"), source.alias("line")),
    )
    return fields.select(F.col("productId").alias("id"), F.inline(lines))


def write_bulk(docs: DataFrame, path: str, counted: bool = False) -> None:
    """Text files in id order; a document never spans two files."""
    (
        docs.repartitionByRange("id")
        .sortWithinPartitions("id")
        .transform(bulk_lines, counted)
        .select("line")
        .write.mode("overwrite")
        .text(path)
    )


def strict_fields(spark: SparkSession, path: str) -> DataFrame:
    """(field) rows for JSON keys the schema does not know; empty for a conforming folder."""
    keys = F.explode(F.json_object_keys("value")).alias("field")
    known = reduce(
        lambda a, b: a | b, [F.col("field") == f.name for f in schemas.DOCUMENT_JSON.fields]
    )
    return spark.read.text(path).select(keys).distinct().where(~known)
