"""Deterministic product and option data in three skew profiles.

Every value is a function of the product id alone, so rows can be generated by any number of
tasks in any order, without a shuffle. A profile is a set of parameter tables; the column
expressions read those tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline import schemas
from shelfline.functions.columns import case

# ---- fixed values: hash constants (multiplier, increment) modulo one million
MODULUS = 1_000_000
HASHES = {
    "seller": (214013, 2531011),
    "category": (174763, 192437),
    "brand": (48271, 128201),
    "status": (69621, 47237),
    "price": (93089, 13579),
    "rating": (199999, 424243),
    "review": (122949, 77777),
    "created": (44497, 246813),
    "updated": (23209, 97531),
}
# ---- fixed values: id spaces
SELLERS, CATEGORIES, BRANDS = 50_000, 500, 5_000
LOCAL_BRAND_BASE, LOCAL_BRANDS = 200, 4_800
BRANDS_PER_CATEGORY = 10
# ---- fixed values: (upper bound of the hash, lowest value, number of values)
PRICE_RANGES = [(700_000, 10_000, 90_001), (850_000, 1_000, 9_000), (MODULUS, 100_001, 900_000)]
REVIEW_RANGES = [
    (850_000, 0, 21),
    (970_000, 21, 180),
    (995_000, 201, 800),
    (MODULUS, 1_000, 9_000),
]
CREATED_DAY_RANGES = [(300_000, 0, 30), (MODULUS, 30, 699)]
RATING_STEPS = 501
# ---- fixed values: hash constants of the option columns, modulo one hundred
FANOUT_HASH = (1103515245, 12345)
OPTION_HASHES = {"color": (48271, 128201), "size": (69621, 47237), "stock": (93089, 13579)}


@dataclass(frozen=True)
class Head:
    """Brand drawn from a block of globally popular brands."""

    base: int
    count: int


@dataclass(frozen=True)
class Local:
    """Brand drawn from the first ``count`` brands that belong to the category."""

    count: int


@dataclass(frozen=True)
class SkewProfile:
    """Parameter tables of one profile; the ``hot_*`` ids are the lowest ids of their space."""

    status: list  # (upper bound, status)
    color: list  # (upper bound, color); empty = even spread over the domain
    size: list
    stock: list
    fanout: list  # (upper bound, options per product); empty = 1, 2, 3 in turn
    hot_sellers: int = 0
    hot_seller_share: int = 0
    hot_categories: int = 0
    stay_hot: tuple = ()  # (upper bound, spread): hot seller keeps near its own category
    stay_cold: tuple = ()
    brand_hot: tuple = ()  # (upper bound, Head | Local) for hot categories
    brand_cold: tuple = ()


# ---- fixed values: the three profiles
PROFILES = {
    "uniform": SkewProfile(
        status=[(900_000, "ACTIVE"), (970_000, "SOLD_OUT"), (MODULUS, "DELETED")],
        color=[],
        size=[],
        stock=[(40, "IN_STOCK"), (70, "LOW_STOCK"), (100, "OUT_OF_STOCK")],
        fanout=[],
        brand_cold=((100_000, Head(0, 200)), (MODULUS, Local(10))),
    ),
    "moderate-skew": SkewProfile(
        status=[(900_000, "ACTIVE"), (970_000, "SOLD_OUT"), (MODULUS, "DELETED")],
        color=[
            (25, "BLACK"), (45, "WHITE"), (60, "GRAY"), (70, "BLUE"),
            (80, "RED"), (88, "GREEN"), (95, "NAVY"), (100, "BEIGE"),
        ],
        size=[(25, "M"), (45, "L"), (62, "FREE"), (76, "S"), (89, "XL"), (100, "XS")],
        stock=[(70, "IN_STOCK"), (88, "LOW_STOCK"), (100, "OUT_OF_STOCK")],
        fanout=[(35, 1), (70, 2), (90, 3), (100, 4)],
        hot_sellers=5_000,
        hot_seller_share=550_000,
        hot_categories=100,
        stay_hot=(700_000, 5),
        stay_cold=(700_000, 5),
        brand_hot=(
            (350_000, Head(0, 100)), (450_000, Head(100, 100)),
            (750_000, Local(4)), (MODULUS, Local(10)),
        ),
        brand_cold=((450_000, Head(100, 100)), (700_000, Local(6)), (MODULUS, Local(10))),
    ),
    "high-skew": SkewProfile(
        status=[(950_000, "ACTIVE"), (990_000, "SOLD_OUT"), (MODULUS, "DELETED")],
        color=[
            (55, "BLACK"), (70, "WHITE"), (80, "GRAY"), (87, "NAVY"),
            (92, "BLUE"), (96, "RED"), (99, "GREEN"), (100, "BEIGE"),
        ],
        size=[(45, "M"), (70, "FREE"), (82, "L"), (90, "S"), (96, "XL"), (100, "XS")],
        stock=[(88, "IN_STOCK"), (97, "LOW_STOCK"), (100, "OUT_OF_STOCK")],
        fanout=[(65, 1), (80, 2), (95, 4), (100, 8)],
        hot_sellers=2_500,
        hot_seller_share=700_000,
        hot_categories=50,
        stay_hot=(850_000, 3),
        stay_cold=(750_000, 7),
        brand_hot=(
            (550_000, Head(0, 50)), (700_000, Head(50, 150)),
            (920_000, Local(3)), (MODULUS, Local(10)),
        ),
        brand_cold=((700_000, Head(50, 150)), (800_000, Local(5)), (MODULUS, Local(10))),
    ),
}


def by_bound(value: Column, table, result) -> Column:
    """``result(entry)`` of the first table entry whose upper bound lies above the value."""
    if len(table) == 1:
        return result(table[0])
    return case([(value < e[0], result(e)) for e in table[:-1]], result(table[-1]))


def _hash(n: Column, constants: tuple, modulus: int) -> Column:
    """(n * a + c) mod m, reduced before the product so that no id can overflow."""
    a, c = constants
    return ((n % modulus) * (a % modulus) + c % modulus) % modulus


def _wrap(base: int, size: int, step: Column) -> Column:
    """The id ``step`` places after the start of the block (base, base + size]."""
    return step % size + (base + 1)


def _ranged(h: Column, ranges: list) -> Column:
    return by_bound(h, ranges, lambda r: F.lit(r[1]) + h % r[2])


def gen_products(ids: DataFrame, profile: str, anchor_ts: str) -> DataFrame:
    """Products for the positive ids in column ``id``; ``anchor_ts`` stands for the load time."""
    p = PROFILES[profile]
    n = F.col("id")
    h = {name: _hash(n, constants, MODULUS) for name, constants in HASHES.items()}
    cycle = F.expr(f"(id - 1) div {SELLERS}")
    anchor = F.lit(anchor_ts).cast("timestamp_ntz")

    if p.hot_sellers:
        hot = (0, p.hot_sellers)
        cold = (p.hot_sellers, SELLERS - p.hot_sellers)
        seller = F.when(
            h["seller"] < p.hot_seller_share, _wrap(*hot, h["seller"])
        ).otherwise(_wrap(*cold, h["seller"]))
    else:
        seller = _wrap(0, SELLERS, n - 1)
    staged = ids.select(n, seller.alias("seller_id"))

    seller_id = F.col("seller_id")
    if p.hot_categories:
        hot = (0, p.hot_categories)
        cold = (p.hot_categories, CATEGORIES - p.hot_categories)

        def near_own(own, other, first_seller, stay):
            bound, spread = stay
            own_place = (seller_id - first_seller) % own[1]
            return F.when(
                h["category"] < bound, _wrap(*own, own_place + h["category"] % spread)
            ).otherwise(_wrap(*other, h["category"]))

        category = F.when(
            seller_id <= p.hot_sellers, near_own(hot, cold, 1, p.stay_hot)
        ).otherwise(near_own(cold, hot, p.hot_sellers + 1, p.stay_cold))
        local_step = h["brand"]
    else:
        category = _wrap(0, CATEGORIES, (seller_id - 1) % CATEGORIES + cycle % 3)
        local_step = seller_id + cycle
    staged = staged.withColumn("category_id", category.cast("long"))

    category_id = F.col("category_id")

    def brand_of(entry):
        rule = entry[1]
        if isinstance(rule, Head):
            return _wrap(rule.base, rule.count, h["brand"])
        place = (category_id - 1) * BRANDS_PER_CATEGORY + local_step % rule.count
        return _wrap(LOCAL_BRAND_BASE, LOCAL_BRANDS, place)

    brand = by_bound(h["brand"], p.brand_cold, brand_of)
    if p.hot_categories:
        brand = F.when(
            category_id <= p.hot_categories, by_bound(h["brand"], p.brand_hot, brand_of)
        ).otherwise(brand)

    created = F.timestamp_add(
        "SECOND",
        -(_ranged(h["created"], CREATED_DAY_RANGES) * 86_400 + h["updated"] % 86_400),
        anchor,
    )
    touched = F.timestamp_add(
        "SECOND",
        h["updated"] % 60 * 86_400 + F.floor(h["updated"] / 60) % 86_400,
        F.col("created_at"),
    )
    return staged.select(
        n,
        seller_id,
        category_id,
        brand.cast("long").alias("brand_id"),
        by_bound(h["status"], p.status, lambda e: F.lit(e[1])).alias("status"),
        _ranged(h["price"], PRICE_RANGES).cast("int").alias("price"),
        (h["rating"] % RATING_STEPS / F.lit(100)).cast("decimal(3,2)").alias("rating"),
        _ranged(h["review"], REVIEW_RANGES).cast("int").alias("review_count"),
        created.alias("created_at"),
    ).withColumn("updated_at", F.least(anchor, touched))


def product_ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1)


def gen_options(products: DataFrame, profile: str) -> DataFrame:
    """Options of the given products: a fan-out per product, then one row per option number."""
    p = PROFILES[profile]
    pid = F.col("product_id")
    if p.fanout:
        fanout = by_bound(_hash(pid, FANOUT_HASH, 100), p.fanout, lambda e: F.lit(e[1]))
    else:
        fanout = (pid - 1) % 3 + 1
    numbered = products.select(F.col("id").alias("product_id")).withColumn(
        "option_no", F.explode(F.sequence(F.lit(1), fanout.cast("int")))
    )
    h = {
        name: (_hash(pid, (a, 0), 100) + F.col("option_no") * (b % 100)) % 100
        for name, (a, b) in OPTION_HASHES.items()
    }

    def value(hashed, table, domain):
        if table:
            return by_bound(hashed, table, lambda e: F.lit(e[1]))
        values = F.array(*[F.lit(v) for v in domain])
        return F.element_at(values, (hashed % len(domain)).cast("int") + 1)

    return numbered.select(
        (pid * 10 + F.col("option_no")).alias("id"),
        pid,
        value(h["color"], p.color, schemas.COLORS).alias("color"),
        value(h["size"], p.size, schemas.SIZES).alias("size"),
        value(h["stock"], p.stock, schemas.STOCK_STATUSES).alias("stock_status"),
    )


def gen_backlog(
    ids: DataFrame, run: str, now: str, first_product_id: int = 1
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One ACTIVE product, one option and one PENDING update event per number in ``id``."""
    seq = F.col("id")
    at = F.lit(now).cast("timestamp")
    base = ids.select(seq, (seq + (first_product_id - 1)).alias("pid"))
    pid = F.col("pid")
    products = base.select(
        pid.alias("id"),
        (seq + 4500).alias("seller_id"),
        F.lit(75).cast("long").alias("category_id"),
        (seq % 10 + 900).alias("brand_id"),
        F.lit("ACTIVE").alias("status"),
        (seq + 10_000).cast("int").alias("price"),
        F.lit("4.50").cast("decimal(3,2)").alias("rating"),
        seq.cast("int").alias("review_count"),
        at.cast("timestamp_ntz").alias("created_at"),
        at.cast("timestamp_ntz").alias("updated_at"),
    )
    options = base.select(
        (pid * 10 + 1).alias("id"),
        pid.alias("product_id"),
        F.lit("BLACK").alias("color"),
        F.lit("M").alias("size"),
        F.lit("IN_STOCK").alias("stock_status"),
    )
    payload = F.to_json(
        F.struct(
            pid.alias("productId"),
            F.lit("PRODUCT_UPDATED").alias("eventType"),
            F.lit(run).alias("smokeRun"),
            F.lit(False).alias("tombstone"),
        )
    )
    none = F.lit(None)
    events = base.select(
        seq.alias("id"),
        F.lit("PRODUCT").alias("aggregate_type"),
        pid.alias("aggregate_id"),
        F.lit("PRODUCT_UPDATED").alias("event_type"),
        F.lit(1).alias("schema_version"),
        payload.alias("payload"),
        F.lit("PENDING").alias("status"),
        none.cast("string").alias("claim_token"),
        none.cast("string").alias("claimed_by"),
        none.cast("timestamp").alias("claimed_at"),
        F.lit(0).alias("retry_count"),
        none.cast("string").alias("last_error"),
        none.cast("timestamp").alias("next_retry_at"),
        at.alias("created_at"),
        at.alias("updated_at"),
        none.cast("timestamp").alias("processed_at"),
    )
    return products, options, events
