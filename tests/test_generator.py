"""Published match counts of the seed profiles, at one million products."""

import pytest
from pyspark.sql import functions as F

from shelfline.operators import search
from shelfline.operators.spec import SearchSpec
from shelfline.sources import generator

N = 1_000_000
GOLDEN = {
    # profile: (statuses, option rows, products with a repeated triple, broad, selective)
    "uniform": ((900_000, 70_000, 30_000), 1_999_999, 0, 36_001, 0),
    "moderate-skew": ((900_000, 70_000, 30_000), 2_050_000, 20_000, 72_000, 1_338),
    "high-skew": ((950_000, 40_000, 10_000), 1_950_000, 150_000, 294_500, 9),
}
BROAD = SearchSpec(status="ACTIVE", color="BLACK", size="M", stock_status="IN_STOCK")
SELECTIVE = BROAD.at(category_id=75, brand_id=943, min_price=10_000, max_price=100_000)


@pytest.mark.parametrize("profile", sorted(GOLDEN))
def test_golden_counts(spark, profile):
    statuses, option_rows, repeated, broad, selective = GOLDEN[profile]
    p = generator.gen_products(generator.product_ids(spark, N), profile, "2026-05-01 00:00:00")
    o = generator.gen_options(p, profile)
    counts = {r.status: r["count"] for r in p.groupBy("status").count().collect()}
    assert (counts["ACTIVE"], counts["SOLD_OUT"], counts["DELETED"]) == statuses
    assert o.count() == option_rows
    triples = o.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.size(F.collect_set(F.struct("color", "size", "stock_status"))).alias("d"),
    )
    assert triples.where("n > d").count() == repeated
    assert search.matches_exists(p, o, BROAD).count() == broad
    assert search.matches_exists(p, o, SELECTIVE).count() == selective


def test_generation_has_no_shuffle_and_survives_large_ids(spark):
    ids = spark.range(10**15, 10**15 + 5)
    p = generator.gen_products(ids, "high-skew", "2026-05-01 00:00:00")
    o = generator.gen_options(p, "high-skew")
    assert "Exchange" not in o._jdf.queryExecution().executedPlan().toString()
    assert p.count() == 5 and o.count() >= 5


def test_backlog(spark):
    p, o, e = generator.gen_backlog(
        generator.product_ids(spark, 10), "run-7", "2026-05-01 00:00:00", 36_100_001
    )
    assert (p.count(), o.count(), e.count()) == (10, 10, 10)
    assert e.where("status = 'PENDING' AND payload LIKE '%run-7%'").count() == 10
    assert p.join(e, p.id == e.aggregate_id).count() == 10
