"""Distribution reports over products and options."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.functions.columns import age_bucket, price_bucket, review_bucket, share


def with_share(grouped: DataFrame, count: str, digits: int) -> DataFrame:
    """Adds ``percentage`` of the total. ``grouped`` has a small, fixed number of groups."""
    total = F.sum(count).over(Window.partitionBy())
    return grouped.withColumn("percentage", share(F.col(count), total, digits))


def group_counts(
    df: DataFrame, *keys: Column | str, digits: int | None = None, count: str = "row_count"
) -> DataFrame:
    """Rows per group, with their share when ``digits`` is given."""
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
    return grouped if digits is None else with_share(grouped, count, digits)


def top_groups(df: DataFrame, keys: list[str], n: int = 20, digits: int = 4) -> DataFrame:
    """The n largest groups with their share of all rows; ties go to the smaller keys.

    The total is a sum over the same counts, so the shuffled counts are used twice.
    """
    counts = group_counts(df, *keys)
    total = counts.agg(F.sum("row_count").alias("total")).scalar()
    ranked = counts.orderBy(F.col("row_count").desc(), *keys).limit(n)
    return ranked.withColumn("percentage", share(F.col("row_count"), total, digits))


def distinct_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*[F.count_distinct(F.col(c)).alias(f"{c}_count") for c in columns])


def pair_count(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number of different key combinations."""
    return df.select(*keys).distinct().agg(F.count(F.lit(1)).alias(name))


def extremes(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(
        *[f(c).alias(f"{p}_{c}") for c in columns for p, f in (("min", F.min), ("max", F.max))]
    )


def _long(section: str, df: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """Long form (section, label, metric, value) of a small report table."""
    entries = [
        F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values
    ]
    label = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("all")
    return df.select(
        F.lit(section).alias("section"), label.alias("label"), F.inline(F.array(*entries))
    )


def _one_row(df: DataFrame, sections: dict[str, list[str]]) -> DataFrame:
    """Long form of a one-row table whose columns belong to several sections."""
    entries = [
        F.struct(
            F.lit(section).alias("section"),
            F.lit("all").alias("label"),
            F.lit(v).alias("metric"),
            F.col(v).cast("double").alias("value"),
        )
        for section, values in sections.items()
        for v in values
    ]
    return df.select(F.inline(F.array(*entries)))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


#: Two single pairs of the report: the lowest and the highest category and brand id.
SAMPLE_PAIRS = {
    "hot_category_1_hot_brand_1": (1, 1),
    "cold_category_500_cold_brand_5000": (500, 5000),
}


def sample_pairs(products: DataFrame, rows: Column | None = None) -> DataFrame:
    """Row counts of the sample (category, brand) pairs, in one pass.

    ``rows`` is the number of products a row stands for, when the input is already counted.
    """
    rows = F.lit(1) if rows is None else rows
    hits = products.agg(
        *[
            F.coalesce(
                F.sum(F.when((F.col("category_id") == c) & (F.col("brand_id") == b), rows)),
                F.lit(0),
            ).alias(name)
            for name, (c, b) in SAMPLE_PAIRS.items()
        ]
    )
    entries = [
        F.struct(F.lit(n).alias("sample_name"), F.col(n).cast("long").alias("row_count"))
        for n in SAMPLE_PAIRS
    ]
    return hits.select(F.inline(F.array(*entries)))


def product_report(products: DataFrame, now: str) -> DataFrame:
    """The whole product distribution as one long table (section, label, metric, value).

    The products are read three times, whatever the number of sections. Everything about
    seller, category and brand comes from one count per (seller, category, brand), whose
    shuffle all those sections share. The status and bucket sections come from one pass that
    counts several labels per row before it shuffles. The extremes are one global aggregate.
    """
    base = products.groupBy("seller_id", "category_id", "brand_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    total = base.agg(F.sum("n").alias("row_count"))
    parts = [_long("total", total, [], "row_count")]

    def rolled(keys: list[str]) -> DataFrame:
        return base.groupBy(*keys).agg(F.sum("n").alias("row_count"))

    # groups are counted by their row_count: a count that ignores it would let the optimizer
    # drop the shared base and read the products again
    for key in ("category_id", "brand_id", "seller_id"):
        count = rolled([key]).agg(F.count("row_count").alias(f"{key}_count"))
        parts.append(_long("distinct", count, [], f"{key}_count"))
    for keys in (["category_id", "brand_id"], ["seller_id", "category_id"]):
        name = "_".join(k.removesuffix("_id") for k in keys) + "_pairs"
        pairs = rolled(keys).agg(F.count("row_count").alias(name))
        parts.append(_long("pairs", pairs, [], name))
    for keys in (["category_id"], ["brand_id"], ["seller_id"], ["category_id", "brand_id"]):
        top = (
            rolled(keys)
            .orderBy(F.col("row_count").desc(), *keys)
            .limit(20)
            .withColumn("percentage", share(F.col("row_count"), total.scalar(), 4))
        )
        parts.append(_long("top_" + "_".join(keys), top, keys, "row_count", "percentage"))
    samples = sample_pairs(base, F.col("n"))
    parts.append(_long("sample_pair", samples, ["sample_name"], "row_count"))

    at = F.lit(now).cast("timestamp_ntz")
    labels = {
        "status": F.col("status"),
        "price_bucket": price_bucket(F.col("price")),
        "review_bucket": review_bucket(F.col("review_count")),
        "created_at_bucket": age_bucket(F.col("created_at"), at),
    }
    tagged = products.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(s).alias("section"), c.alias("label"))
                    for s, c in labels.items()
                ]
            )
        )
    )
    counted = tagged.groupBy("section", "label").agg(F.count(F.lit(1)).alias("row_count"))
    in_section = F.sum("row_count").over(Window.partitionBy("section"))
    counted = counted.withColumn("percentage", share(F.col("row_count"), in_section, 2))
    metrics = [
        F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value"))
        for v in ("row_count", "percentage")
    ]
    parts.append(counted.select("section", "label", F.inline(F.array(*metrics))))

    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    times = ["created_at", "updated_at"]
    ends = extremes(products, "rating", *times)
    seconds = {c: F.timestamp_diff("SECOND", epoch, F.col(c)) for c in ends.columns if "_at" in c}
    sections = {"rating": ["min_rating", "max_rating"], "epoch_seconds": list(seconds)}
    parts.append(_one_row(ends.withColumns(seconds), sections))
    return _union(parts)


def fanout(options: DataFrame) -> DataFrame:
    return options.groupBy("product_id").agg(F.count(F.lit(1)).alias("options_per_product"))


def fanout_histogram(options: DataFrame, digits: int = 4) -> DataFrame:
    return group_counts(
        fanout(options), "options_per_product", digits=digits, count="product_count"
    )


def fanout_summary(options: DataFrame) -> DataFrame:
    return fanout(options).agg(
        F.count(F.lit(1)).alias("distinct_product_ids"),
        F.min("options_per_product").alias("min_options_per_product"),
        F.round(F.avg("options_per_product"), 4).alias("avg_options_per_product"),
        F.max("options_per_product").alias("max_options_per_product"),
    )


def top_options(
    products: DataFrame, options: DataFrame, keys: list[str], predicate: Column, n: int = 30
) -> DataFrame:
    """The n most frequent option triples among the products that meet ``predicate``.

    Options are counted per product before the join, so a product with very many equal options
    contributes one row per triple.
    """
    triple = ["color", "size", "stock_status"]
    per_product = options.groupBy("product_id", *triple).agg(F.count(F.lit(1)).alias("copies"))
    wanted = products.where(predicate).select(F.col("id").alias("product_id"), *keys)
    return (
        per_product.join(wanted, "product_id")
        .groupBy(*keys, *triple)
        .agg(
            F.sum("copies").alias("option_row_count"),
            F.count(F.lit(1)).alias("distinct_product_count"),
        )
        .orderBy(F.col("option_row_count").desc(), *triple, *keys)
        .limit(n)
    )


def option_report(products: DataFrame, options: DataFrame) -> DataFrame:
    """The whole option distribution as one long table (section, label, metric, value).

    All value sections roll up the counts of the at most 144 triples. The fan-out sections and
    the comparison with the products share one count per product.
    """
    per_product = fanout(options)
    triples = options.groupBy("color", "size", "stock_status").agg(
        F.count(F.lit(1)).alias("n")
    )
    sides = (
        products.select(F.col("id").alias("product_id"), F.lit(1).alias("known"))
        .join(per_product, "product_id", "full")
        .agg(
            F.count("known").alias("product_count"),
            F.coalesce(F.sum("options_per_product"), F.lit(0)).alias("option_count"),
            F.count_if(F.col("options_per_product").isNull()).alias("without_options"),
            F.coalesce(
                F.sum(F.when(F.col("known").isNull(), F.col("options_per_product"))), F.lit(0)
            ).alias("orphan_rows"),
            F.count("options_per_product").alias("distinct_product_ids"),
            F.min("options_per_product").alias("min_options_per_product"),
            F.round(F.avg("options_per_product"), 4).alias("avg_options_per_product"),
            F.max("options_per_product").alias("max_options_per_product"),
        )
    )
    sections = {
        "total": ["product_count", "option_count"],
        "join": ["without_options", "orphan_rows"],
        "fanout": [c for c in sides.columns if c.endswith(("product_ids", "per_product"))],
    }
    histogram = group_counts(per_product, "options_per_product", digits=4, count="product_count")
    parts = [
        _one_row(sides, sections),
        _long("fanout_histogram", histogram, ["options_per_product"],
              "product_count", "percentage"),
    ]
    for keys in (
        ["color"],
        ["size"],
        ["stock_status"],
        ["color", "size"],
        ["color", "size", "stock_status"],
    ):
        counts = with_share(triples.groupBy(*keys).agg(F.sum("n").alias("row_count")),
                            "row_count", 4)
        parts.append(_long("by_" + "_".join(keys), counts, keys, "row_count", "percentage"))
    return _union(parts)
