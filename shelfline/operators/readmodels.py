"""Read models: the option-signature table and the documents with nested options."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline import schemas
from shelfline.functions.columns import SIGNATURE_DELIMITER, option_signature
from shelfline.session import shared_dir
from shelfline.sources.snapshots import SHARE

TRIPLE = ["color", "size", "stock_status"]
#: What a signature table takes over from a product, in its order.
PRODUCT = ["seller_id", "category_id", "brand_id", "status", "price", "rating", "created_at", "updated_at", "review_count"]


def option_signatures(options: DataFrame) -> DataFrame:
    """(product_id, option_signatures): the different signatures of a product, sorted.

    The set of a product has at most 144 members and is built map-side first, so a product that
    owns very many option rows still sends only small partial sets through the shuffle.
    """
    return (
        options.where(" AND ".join(f"{c} IS NOT NULL" for c in TRIPLE))
        .select("product_id", option_signature(*TRIPLE).alias("signature"))
        .groupBy("product_id")
        .agg(F.sort_array(F.collect_set("signature")).alias("option_signatures"))
    )


def signature_table(
    products: DataFrame, options: DataFrame, refreshed_at: Column
) -> DataFrame:
    """The denormalized read table; products without options have no row."""
    return (
        products.join(
            option_signatures(options).withColumnRenamed("product_id", "id"), "id", "inner"
        )
        .select(
            F.col("id").alias("product_id"),
            "seller_id",
            "category_id",
            "brand_id",
            "status",
            "price",
            "rating",
            "created_at",
            "updated_at",
            "review_count",
            "option_signatures",
            F.col("updated_at").alias("source_updated_at"),
            refreshed_at.alias("document_refreshed_at"),
        )
    )


def option_deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """(product_id, code, other, change): by how many rows each triple of a product grew or shrank.

    ``code`` is the packed triple; one with a value outside the domains has none, its signature is
    ``other``. A triple with a missing part has no signature and is left out. Either side may be a
    whole snapshot or only the option rows that went and came. Counting happens map-side, so a hot
    product moves no more than a row per triple from each task.
    """
    sides = [s.select("product_id", *TRIPLE, F.lit(w).alias("w")) for s, w in ((old, -1), (new, 1))]
    packed = _packed(sides[0].unionAll(sides[1]).where(" AND ".join(f"{c} IS NOT NULL" for c in TRIPLE)))
    counts = packed.withColumn("other", option_signature(*TRIPLE)).groupBy("product_id", "code", "other")
    return counts.agg(F.sum("w").alias("change")).where("change <> 0")


def counted_signature_table(
    products: DataFrame, options: DataFrame, refreshed_at: Column
) -> DataFrame:
    """The signature table with ``copies``: the option rows behind each signature, in its order.

    With the counts kept, ``fold_options`` can follow changes without reading the options again.
    """
    none = options.limit(0)
    upserts, _ = fold_options(
        _no_signatures(products), products, option_deltas(none, options), refreshed_at
    )
    return upserts


def _no_signatures(products: DataFrame) -> DataFrame:
    return products.limit(0).select(
        F.col("id").alias("product_id"),
        F.array().cast("array<string>").alias("option_signatures"),
        F.array().cast("array<bigint>").alias("copies"),
    )


def _delta(changes: Column | dict[str, Column]) -> Column:
    """(signature, n) of a change."""
    known = F.array(*[F.lit(SIGNATURE_DELIMITER.join(triple)) for triple in itertools.product(*_VALUES.values())])
    code = changes["code"]
    signature = F.when(code.isNull(), changes["other"]).otherwise(F.element_at(known, code + 1))
    return F.struct(signature.alias("signature"), changes["change"].alias("n"))


def _held(signatures: Column, copies: Column, deltas: Column, known: Column) -> Column:
    """(key, value) of a product after its changes: signatures in order and their rows; a known one with fewer than none fails."""
    none, changes = F.lit(0).cast("long"), F.map_from_entries(deltas)
    both = F.map_zip_with(
        F.map_from_arrays(signatures, copies), changes, lambda _, n, more: F.coalesce(n, none) + F.coalesce(more, none)
    )
    wrong = F.concat(F.lit("more options removed than stored: product "), F.col("product_id"))
    left = F.map_filter(
        F.when(signatures.isNull(), changes).otherwise(both),
        lambda _, n: F.when(known & (n < 0), F.raise_error(wrong).cast("boolean")).otherwise(n > 0),
    )
    return F.sort_array(F.map_entries(left))


def _row(of: Column | None, refreshed_at: Column) -> list[Column]:
    """The columns of a counted signature table after ``product_id``."""
    own = (lambda c: F.col(c)) if of is None else (lambda c: of[c])
    return [
        *[own(c).alias(c) for c in PRODUCT],
        F.col("held.key").alias("option_signatures"),
        own("updated_at").alias("source_updated_at"),
        refreshed_at.alias("document_refreshed_at"),
        F.col("held.value").alias("copies"),
    ]


def fold_options(
    table: DataFrame, products: DataFrame, deltas: DataFrame, refreshed_at: Column
) -> tuple[DataFrame, DataFrame]:
    """(upserts, deletes) that bring a counted signature table up to date with option changes.

    ``deltas`` are as ``option_deltas`` gives them. Only products with a change are touched: their
    stored counts and the changes are summed, a signature leaves when its last row does, and a
    product when its last signature does or it is gone from ``products``. A change that takes away
    more rows than there are fails: the table is then not the state the changes follow. Changes of
    unknown products are left out; a product that comes anew brings all of its options as changes.
    """
    kept = _folded(table, products, deltas)
    upserts = kept.where("stays").select("product_id", *_row(None, refreshed_at))
    return upserts, kept.where("NOT stays").select("product_id")


def _folded(table: DataFrame, products: DataFrame, changes: DataFrame) -> DataFrame:
    """The changed products with their attributes, ``held`` and whether they stay."""
    deltas = changes.select("product_id", _delta(changes).alias("delta"))
    by_product = deltas.groupBy("product_id").agg(F.collect_list("delta").alias("deltas"))
    both = by_product.join(table.select("product_id", "option_signatures", "copies"), "product_id", "left")
    kept = both.join(products.withColumnRenamed("id", "product_id"), "product_id", "left")
    # ``seller_id`` has a value in every product.
    known = F.col("seller_id").isNotNull()
    held = _held(F.col("option_signatures"), F.col("copies"), F.col("deltas"), known)
    return kept.withColumn("held", held).withColumn("stays", known & (F.size("held") > 0))


def _whole_table(
    table: DataFrame, products: DataFrame, changes: DataFrame, refreshed_at: Column, bucket: Column
) -> DataFrame:
    """The table after the changes, its rows dealt by ``bucket``, a column over ``product_id``.

    Products, stored rows and changes move once and are grouped where they will be written. What a
    product holds is worked out in the aggregate, so no filter above repeats that.
    """
    sides = [
        products.select(F.col("id").alias("product_id"), F.struct(*PRODUCT).alias("new")),
        changes.select("product_id", F.struct("code", "other", "change").alias("change")),
    ]
    rest = [c for c in table.columns if c != "product_id"]
    sides.append(table.select("product_id", F.struct(*rest).alias("old")))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides)
    delta = F.when(F.col("change").isNotNull(), _delta(F.col("change")))
    product, stored = F.first("new", ignorenulls=True), F.first("old", ignorenulls=True)
    deltas = F.collect_list("delta")
    held = _held(stored["option_signatures"], stored["copies"], deltas, product.isNotNull())
    gathered = (
        rows.withColumn("_bucket", bucket)
        .repartition("_bucket")
        .withColumn("delta", delta)
        .groupBy("product_id", "_bucket")
        .agg(product.alias("product"), stored.alias("stored"), F.when(F.size(deltas) > 0, held).alias("held"))
    )
    changed, stored = F.col("held").isNotNull(), F.col("stored")
    stays = F.col("product").isNotNull() & (F.size("held") > 0)
    kept = gathered.where(F.when(changed, stays).otherwise(stored.isNotNull()))
    fresh = kept.select("*", F.struct(*_row(F.col("product"), refreshed_at)).alias("fresh"))
    return fresh.select(
        "product_id", *[F.when(changed, F.col("fresh")[c]).otherwise(stored[c]).alias(c) for c in rest]
    )


def rebuild_signatures(
    store, products: DataFrame, options: DataFrame, refreshed_at: Column, batch: str | None = None
) -> int | None:
    """Writes the counted table of all options into a store keyed by ``product_id``, from scratch."""
    if batch is not None and store.applied(batch):
        return None
    width = store.width_for(products.select(F.col("id").alias("product_id")))
    changes = option_deltas(options.limit(0), options)
    none = store.spark.createDataFrame([], store.schema)
    rows = _whole_table(none, products, changes, refreshed_at, store.bucket(width))
    return store.replace(rows, batch=batch, dealt=width)


def refresh_signatures(
    store, products: DataFrame, deltas: DataFrame, refreshed_at: Column, batch: str
) -> int | None:
    """Folds option changes into a stored counted table; a batch that was applied is skipped.

    The store is keyed by ``product_id``. Counts and signatures are one row, so one commit brings
    both and a crash leaves neither. Changes of a large share of the products are not written
    beside the table and worked in afterwards; the table is written anew with them.
    """
    if store.applied(batch):
        return None
    spark, path = store.spark, shared_dir(store.spark, "deltas")
    deltas.write.parquet(path)
    changes = spark.read.schema(deltas.schema).parquet(path)
    touched = changes.agg(F.approx_count_distinct("product_id")).first()[0]
    if not touched:
        return None
    width, stored = store.size("write")
    if touched > SHARE * stored:
        rows = _whole_table(store.read("write"), products, changes, refreshed_at, store.bucket(width))
        return store.replace(rows, batch=batch, dealt=width)
    kept = _folded(store.read("write"), products, changes)
    rows = kept.select("product_id", *_row(None, refreshed_at), (~F.col("stays")).alias("_deleted"))
    return store.apply_marked(rows, batch)


def compact_options(options: DataFrame) -> DataFrame:
    """Options with equal triples of a product counted: (id of the first, triple, copies).

    Every search path may use this table in place of the options. It holds at most 144 rows per
    product, so it can be bucketed by product id without a bucket growing with one hot product.
    """
    first = F.min("id") if "id" in options.columns else F.lit(0).cast("long")
    return options.groupBy("product_id", *TRIPLE).agg(
        F.count(F.lit(1)).alias("copies"), first.alias("id")
    )


#: The values of a triple's parts, in the order in which they are packed into a number.
_VALUES = {"color": schemas.COLORS, "size": schemas.SIZES, "stock_status": schemas.STOCK_STATUSES}


def _packed(options: DataFrame) -> DataFrame:
    """Options whose triple is one number, ``code``; its strings stay only where a value is unknown.

    Rows that move through a shuffle are a third as large that way.
    """
    code = F.lit(0)
    for name, values in _VALUES.items():
        place = F.create_map(*[F.lit(x) for v in zip(values, range(len(values))) for x in v])
        code = code * len(values) + F.element_at(place, F.col(name))
    packed = options.withColumn("code", code)
    return packed.withColumns({c: F.when(F.col("code").isNull(), F.col(c)) for c in TRIPLE})


def _unpacked(o: Column | dict[str, Column]) -> dict[str, Column]:
    """The parts of a packed triple."""
    parts, rest = {}, o["code"]
    for name, values in reversed(_VALUES.items()):
        known = F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(rest, F.lit(len(values))) + 1)
        parts[name] = F.when(o["code"].isNotNull(), known).otherwise(o[name])
        rest = F.call_function("div", rest, F.lit(len(values))).cast("int")
    return parts


def nested_options(options: DataFrame, listed: bool = False) -> DataFrame:
    """(product_id, options): one entry per different triple, in order of first appearance.

    Equal triples are counted in ``copies`` instead of being repeated. That keeps the multiset
    whole while the array stays within the 144 possible triples, however many rows a product
    owns; counting happens map-side before the first shuffle. Options that are compact already
    are not counted again. With ``listed`` every option row is an entry of its own, in order of
    its id, with repeats where they stand; such a list is as long as a product has options.
    """
    first = F.col("id") if "id" in options.columns else F.lit(0).cast("long")
    packed = _packed(options.select("*", first.alias("_first")))
    if listed:
        counted = packed.withColumn("copies", F.lit(1).cast("long"))
    elif "copies" in options.columns:
        counted = packed
    else:
        counted = packed.groupBy("product_id", "code", *TRIPLE).agg(
            F.count(F.lit(1)).alias("copies"), F.min("_first").alias("_first")
        )
    held = F.struct(F.col("_first").alias("id"), "code", *TRIPLE, "copies")

    def entry(o: Column) -> Column:
        parts = _unpacked(o)
        return F.struct(o["id"].alias("id"), *[parts[c].alias(c) for c in TRIPLE], o["copies"].alias("copies"))

    ordered = F.array_sort(F.transform(F.collect_list(held), entry))
    return counted.groupBy("product_id").agg(
        F.transform(
            ordered, lambda o: F.struct(*[o[c].alias(c) for c in [*TRIPLE, "copies"]])
        ).alias("options")
    )


def no_options() -> Column:
    return F.array().cast(
        "array<struct<color:string,size:string,stock_status:string,copies:bigint>>"
    )


def documents(
    products: DataFrame, options: DataFrame, refreshed_at: Column, listed: bool = False
) -> DataFrame:
    """One document per product, with an empty list where a product has no options.

    ``listed`` chooses between counted and listed options, see ``nested_options``.
    """
    return (
        products.join(
            nested_options(options, listed).withColumnRenamed("product_id", "id"), "id", "left"
        )
        .select(
            *products.columns,
            F.coalesce("options", no_options()).alias("options"),
            F.col("updated_at").alias("source_updated_at"),
            refreshed_at.alias("document_refreshed_at"),
        )
    )


def option_count(options: str = "options") -> Column:
    """Number of source option rows behind a document."""
    return F.aggregate(options, F.lit(0).cast("long"), lambda n, o: n + o["copies"])


def expanded_options(options: str = "options", counted: bool = False) -> Column:
    """The option list for writing, as (color, size, stockStatus, copies).

    Every copy is written out and ``copies`` is null; with ``counted`` an entry per triple says
    in ``copies`` how many rows it stands for. The shape is the caller's choice for all documents,
    whatever their size.
    """

    def entry(o: Column, copies: Column) -> Column:
        return F.struct(
            o["color"].alias("color"),
            o["size"].alias("size"),
            o["stock_status"].alias("stockStatus"),
            copies.cast("long").alias("copies"),
        )

    if counted:
        return F.transform(options, lambda o: entry(o, o["copies"]))
    return F.flatten(
        F.transform(
            options, lambda o: F.array_repeat(entry(o, F.lit(None)), o["copies"].cast("int"))
        )
    )
