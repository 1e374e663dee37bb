"""Model tables on storage: typed scans, profile-selected sources and the active view."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline import schemas

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
ACTIVE_VIEW = "products_active"


@dataclass(frozen=True)
class Profile:
    """A matched pair of product and option tables."""

    name: str
    products_table: str
    options_table: str


# The profiles that exist and the tables that belong together.
PROFILES = {
    "uniform": Profile("uniform", "products_uniform", "product_options_uniform"),
    "moderate-skew": Profile(
        "moderate-skew", "products_moderate_skew", "product_options_moderate_skew"
    ),
    "high-skew": Profile("high-skew", "products_high_skew", "product_options_high_skew"),
}


def products(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PRODUCTS).parquet(path)


def options(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.OPTIONS).parquet(path)


def outbox(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.OUTBOX).parquet(path)


def with_payload(outbox_df: DataFrame) -> DataFrame:
    """Adds the JSON payload as a struct column ``event``; missing keys become null."""
    return outbox_df.withColumn("event", F.from_json("payload", schemas.PAYLOAD))


def inline(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small relation from literal rows (scenario lists, replica names)."""
    return spark.createDataFrame(rows, schema)


def simple_identifier(name: str) -> str:
    if not isinstance(name, str) or not _IDENTIFIER.match(name):
        raise ValueError(f"not a simple identifier: {name!r}")
    return name


def resolve_profile(products_table: str, options_table: str | None = None) -> Profile:
    """The allowed profile of a products table, given by profile or table name.

    A products table of one profile together with an options table of another is refused.
    """
    for profile in PROFILES.values():
        if products_table not in (profile.name, profile.products_table):
            continue
        if options_table is not None and options_table != profile.options_table:
            raise ValueError(f"{options_table!r} does not belong to profile {profile.name!r}")
        return profile
    simple_identifier(products_table)
    raise ValueError(f"unknown profile or table: {products_table!r}")


def load_profile(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, DataFrame]:
    profile = resolve_profile(name)
    return (
        products(spark, os.path.join(root, profile.products_table)),
        options(spark, os.path.join(root, profile.options_table)),
    )


def set_active(spark: SparkSession, root: str, name: str) -> Profile:
    """Points the view ``products_active`` at the products of one profile."""
    profile = resolve_profile(name)
    path = os.path.join(root, profile.products_table)
    products(spark, path).createOrReplaceTempView(ACTIVE_VIEW)
    return profile
