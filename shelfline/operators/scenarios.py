"""Scenario sets: candidate validation, selectivity controls and corpus preflight."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.columns import ratio
from shelfline.operators.spec import SearchSpec


def _all(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def _named(values: dict[str, str], value_name: str, label: str = "scenario") -> Column:
    entries = [
        F.struct(F.lit(name).alias(label), F.col(c).alias(value_name))
        for name, c in values.items()
    ]
    return F.inline(F.array(*entries))


def _copies_by_filter(options: DataFrame, filters: list[dict]) -> DataFrame:
    """Per product, the number of option rows that meet each filter (columns f0, f1, …).

    Only products that meet some filter stay; counts merge map-side.
    """
    tests = [_all([F.col(c) == v for c, v in f.items()]) for f in filters]
    relevant = options.where(reduce(lambda a, b: a | b, tests))
    return relevant.groupBy("product_id").agg(
        *[F.count_if(t).alias(f"f{i}") for i, t in enumerate(tests)]
    )


def selectivity(
    products: DataFrame, options: DataFrame, cases: dict[str, SearchSpec]
) -> DataFrame:
    """Per case: joined option rows, distinct products and rows per product (null for none).

    All cases share one join: options collapse to one row per product with a counter per
    different option filter, and each case is a pair of conditional aggregates.
    """
    filters = []
    for spec in cases.values():
        if spec.option_filters not in filters:
            filters.append(spec.option_filters)
    matched = _copies_by_filter(options, filters).withColumnRenamed("product_id", "id")
    joined = products.join(matched, "id")
    aggregates = []
    for i, spec in enumerate(cases.values()):
        copies = F.col(f"f{filters.index(spec.option_filters)}")
        hit = _all(spec.product_predicates()) & (copies > 0)
        aggregates.append(F.coalesce(F.sum(F.when(hit, copies)), F.lit(0)).alias(f"rows_{i}"))
        aggregates.append(F.count_if(hit).alias(f"products_{i}"))
    entries = [
        F.struct(
            F.lit(name).alias("control_case"),
            F.lit(spec.color).alias("color"),
            F.lit(spec.size).alias("size"),
            F.lit(spec.stock_status).alias("stock_status"),
            F.col(f"rows_{i}").alias("joined_option_rows"),
            F.col(f"products_{i}").alias("distinct_product_count"),
        )
        for i, (name, spec) in enumerate(cases.items())
    ]
    return (
        joined.agg(*aggregates)
        .select(F.inline(F.array(*entries)))
        .withColumn(
            "option_rows_per_distinct_product",
            ratio(F.col("joined_option_rows"), F.col("distinct_product_count"), 4),
        )
    )


def matching_counts(
    products: DataFrame, options: DataFrame, specs: dict[str, SearchSpec]
) -> DataFrame:
    """(scenario, matching_count) of all specs from one join; see :func:`selectivity`."""
    return selectivity(products, options, specs).select(
        F.col("control_case").alias("scenario"), F.col("distinct_product_count").alias("matching_count")
    )


def validate_candidates(
    profiles: dict[str, tuple[DataFrame, DataFrame]], specs: dict[str, SearchSpec]
) -> DataFrame:
    """Per profile and scenario: matches, matches needed for the page, and whether they suffice."""
    needed = F.create_map(
        *[x for n, s in specs.items() for x in (F.lit(n), F.lit(s.offset + s.limit))]
    )
    parts = [
        matching_counts(products, options, specs).select(
            F.lit(profile).alias("profile"), "scenario", "matching_count"
        )
        for profile, (products, options) in profiles.items()
    ]
    return (
        reduce(DataFrame.unionByName, parts)
        .withColumn("required_min_count", F.element_at(needed, F.col("scenario")))
        .withColumn("passes", F.col("matching_count") >= F.col("required_min_count"))
    )


def status_count_check(products: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows per status in source and documents, side by side."""

    def counts(df, name):
        return df.groupBy("status").agg(F.count(F.lit(1)).alias(name))

    both = counts(products, "expected").join(counts(docs, "actual"), "status", "full")
    return both.select(
        "status",
        F.coalesce("expected", F.lit(0)).alias("expected"),
        F.coalesce("actual", F.lit(0)).alias("actual"),
    ).withColumn("passes", F.col("expected") == F.col("actual"))


def counts_object(grouped: DataFrame, key: str, value: str) -> DataFrame:
    """One row with a key -> count map in key order; for a handful of groups."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key), F.col(value))))
    return grouped.agg(F.map_from_entries(pairs).alias("counts"))


def preflight(
    products: DataFrame, docs: DataFrame, specs: dict[str, SearchSpec]
) -> DataFrame:
    """(check_name, expected, actual, passes): corpus size, status counts, scenario counts.

    Scenario counts come from one pass over the documents.
    """
    from shelfline.operators.search import same_option

    hits = {}
    for i, spec in enumerate(specs.values()):
        predicates = spec.product_predicates()
        by_option = same_option(spec)
        hits[f"s{i}"] = _all(predicates if by_option is None else [*predicates, by_option])
    scenario_counts = docs.agg(*[F.count_if(c).alias(n) for n, c in hits.items()]).select(
        _named({name: f"s{i}" for i, name in enumerate(specs)}, "actual", "check_name")
    )
    needed = F.create_map(
        *[
            x
            for n, s in specs.items()
            for x in (F.lit(n), F.lit(s.offset + s.limit).cast("long"))
        ]
    )
    scenario_rows = scenario_counts.withColumn(
        "expected", F.element_at(needed, F.col("check_name"))
    ).withColumn("passes", F.col("actual") >= F.col("expected"))
    statuses = status_count_check(products, docs)
    status_rows = statuses.select(
        F.concat(F.lit("status_"), "status").alias("check_name"), "expected", "actual", "passes"
    )
    total_row = statuses.agg(
        F.sum("expected").alias("expected"), F.sum("actual").alias("actual")
    ).select(
        F.lit("document_count").alias("check_name"),
        "expected",
        "actual",
        (F.col("expected") == F.col("actual")).alias("passes"),
    )
    return status_rows.unionByName(total_row).unionByName(scenario_rows)
