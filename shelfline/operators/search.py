"""Four interchangeable search paths over the same request.

``search_join_distinct`` and ``search_exists`` work on products and options,
``search_signatures`` on the signature table, ``search_documents`` on nested documents.
Without an option filter the first two still ask for at least one option per product
(``require_option``), the signature table holds only such products, and documents keep all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline import schemas
from shelfline.operators import paging
from shelfline.operators.spec import RESULT_WINDOW, SORTS, SearchSpec


def _all(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates)


def filtered(rows: DataFrame, predicates: list[Column]) -> DataFrame:
    return rows.where(_all(predicates)) if predicates else rows


def option_owners(options: DataFrame, spec: SearchSpec) -> DataFrame:
    """Ids of products with an option row that meets all option filters, each id once.

    The distinct collapses a product's many matching rows inside each task before the shuffle,
    and leaves the ids partitioned as the following join needs them.
    """
    hits = filtered(options, [F.col(c) == v for c, v in spec.option_filters.items()])
    return hits.select(F.col("product_id").alias("id")).distinct()


def matches_join_distinct(
    products: DataFrame, options: DataFrame, spec: SearchSpec
) -> DataFrame:
    rows = filtered(products, spec.product_predicates()).select(*schemas.API_COLUMNS)
    return rows.join(option_owners(options, spec), "id", "inner").distinct()


def matches_exists(
    products: DataFrame, options: DataFrame, spec: SearchSpec, require_option: bool = True
) -> DataFrame:
    rows = filtered(products, spec.product_predicates()).select(*schemas.API_COLUMNS)
    if not spec.option_filters and not require_option:
        return rows
    return rows.join(option_owners(options, spec), "id", "left_semi")


def signature_predicate(spec: SearchSpec) -> Column | None:
    """All three parts known: containment of the whole signature. Else a part-wise test."""
    wanted = spec.option_filters
    if not wanted:
        return None
    parts = ["color", "size", "stock_status"]
    if len(wanted) == len(parts):
        return F.array_contains("option_signatures", "|".join(wanted[p] for p in parts))
    return F.exists(
        "option_signatures",
        lambda s: _all(
            [
                F.split_part(s, F.lit("|"), F.lit(parts.index(name) + 1)) == value
                for name, value in wanted.items()
            ]
        ),
    )


def matches_signatures(table: DataFrame, spec: SearchSpec) -> DataFrame:
    rows = table.withColumnRenamed("product_id", "id")
    predicates = spec.product_predicates()
    by_option = signature_predicate(spec)
    if by_option is not None:
        predicates.append(by_option)
    return filtered(rows, predicates).select(*schemas.API_COLUMNS)


def same_option(spec: SearchSpec, options: str = "options") -> Column | None:
    """All option filters hold in ONE option of the document.

    The cheap per-field tests come first: they run in generated code and discard most documents
    before the lambda looks at the options one by one. With one filter they are all it takes.
    """
    wanted = spec.option_filters
    if len(wanted) < 2:
        return any_option_each(spec, options)
    together = F.exists(options, lambda o: _all([o[c] == v for c, v in wanted.items()]))
    return any_option_each(spec, options) & together


def any_option_each(spec: SearchSpec, options: str = "options") -> Column | None:
    """Each option filter holds in SOME option: the flattened form with its false positives."""
    wanted = spec.option_filters
    if not wanted:
        return None
    return _all([F.array_contains(F.col(f"{options}.{c}"), v) for c, v in wanted.items()])


def matches_documents(docs: DataFrame, spec: SearchSpec, flattened: bool = False) -> DataFrame:
    predicates = spec.product_predicates()
    by_option = any_option_each(spec) if flattened else same_option(spec)
    if by_option is not None:
        predicates.append(by_option)
    return filtered(docs, predicates).select(*schemas.API_COLUMNS)


def search_join_distinct(products: DataFrame, options: DataFrame, spec: SearchSpec) -> DataFrame:
    return paging.page(matches_join_distinct(products, options, spec.validate()), spec)


def search_exists(
    products: DataFrame, options: DataFrame, spec: SearchSpec, require_option: bool = True
) -> DataFrame:
    return paging.page(matches_exists(products, options, spec.validate(), require_option), spec)


def search_signatures(table: DataFrame, spec: SearchSpec) -> DataFrame:
    return paging.page(matches_signatures(table, spec.validate()), spec)


def search_documents(
    docs: DataFrame, spec: SearchSpec, flattened: bool = False, window: int | None = RESULT_WINDOW
) -> DataFrame:
    """A page of documents; one that ends beyond ``window`` rows is refused, None sets no bound."""
    spec.validate()
    if window is not None:
        paging.check_result_window(spec, window)
    return paging.page(matches_documents(docs, spec, flattened), spec)


def write_postings(table: DataFrame, path: str, sort: str = "createdAtDesc") -> None:
    """Posting lists of a signature table: per signature its products, sorted by a sort key.

    A list is a partition, at most 144 in all. A long list is split over several files by ranges of
    its sort key, so one that a third of all products are in is no single task's work, and the
    top of a list lies in few files.
    """
    key, ascending = SORTS[sort]
    order = [F.col(c).asc() if ascending else F.col(c).desc() for c in (key, "id")]
    rows = table.withColumnRenamed("product_id", "id").select(
        *schemas.API_COLUMNS, F.explode(F.array_distinct("option_signatures")).alias("signature")
    )
    ranged = rows.repartitionByRange(F.col("signature"), *order)
    ranged.sortWithinPartitions("signature", *order).write.partitionBy("signature").parquet(path)


def read_postings(spark: SparkSession, path: str, products: T.StructType = schemas.PRODUCTS) -> DataFrame:
    """Posting lists with the column types of ``products``; nothing is inferred from the files."""
    shape = [products[name] for name in schemas.API_COLUMNS]
    return spark.read.schema(T.StructType([*shape, T.StructField("signature", T.StringType())])).parquet(path)


def search_postings(postings: DataFrame, spec: SearchSpec) -> DataFrame:
    """A page from the posting lists that the option filters choose.

    With all three parts known that is one list and an ordinary page of it. Otherwise the page is a
    merge: each list gives its first ``offset + limit`` rows, which hold the first rows of all lists
    together, and a product in several of them counts once. Pages beyond the result window merge
    whole lists, a product once.
    """
    wanted = spec.validate().option_filters
    parts = ["color", "size", "stock_status"]
    split = {p: F.split_part("signature", F.lit("|"), F.lit(i + 1)) for i, p in enumerate(parts)}
    if len(wanted) == len(parts):
        chosen = [F.col("signature") == "|".join(wanted[p] for p in parts)]
    else:
        chosen = [split[name] == value for name, value in wanted.items()]
    rows = filtered(postings, [*chosen, *spec.product_predicates()])
    if len(wanted) == len(parts):
        return paging.page(rows.select(*schemas.API_COLUMNS), spec)
    last = spec.offset + spec.limit
    if last <= paging.TOP_K_LIMIT:
        top = F.row_number().over(Window.partitionBy("signature").orderBy(*spec.order()))
        rows = rows.withColumn("_rank", top).where(F.col("_rank") <= last)
    return paging.page(rows.select(*schemas.API_COLUMNS).distinct(), spec)


def search_keyset(
    products: DataFrame, options: DataFrame | None, spec: SearchSpec, cursor: tuple | None
) -> DataFrame:
    """The page after ``cursor``; with options the rows must also own a matching option."""
    rows = filtered(products, spec.validate().product_predicates())
    if cursor is not None:
        rows = rows.where(paging.after_cursor(spec, F.lit(cursor[0]), F.lit(cursor[1])))
    if options is not None:
        rows = matches_exists(rows, options, spec)
    return paging.keyset_page(rows.select(*schemas.API_COLUMNS), spec, None)


def search(path: str, spec: SearchSpec, **tables: DataFrame) -> DataFrame:
    """One entry for all paths; every path returns the same rows and columns at every offset."""
    if path == "db":
        return search_exists(tables["products"], tables["options"], spec)
    if path == "documents":
        return search_documents(tables["documents"], spec, window=None)
    if path == "signatures":
        return search_signatures(tables["signatures"], spec)
    if path == "join_distinct":
        return search_join_distinct(tables["products"], tables["options"], spec)
    if path == "postings":
        return search_postings(tables["postings"], spec)
    raise ValueError(f"unknown read path: {path}")
