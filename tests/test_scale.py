"""Skewed keys, co-located tables, plan shapes and exact quantiles."""

import math
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfline.functions import quantiles
from shelfline.functions.quantiles import exact_quantiles
from shelfline.operators import lag, readmodels, search
from shelfline.operators import outbox as ob
from shelfline.operators.spec import SearchSpec
from shelfline.sources import layout
from shelfline.sources import star_schema as star

NOW = "2024-02-01 00:00:00"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ids(df):
    return [r.id for r in df.collect()]


@pytest.fixture(scope="module")
def hot(spark, sf):
    """Products and options where one product owns half as many rows again as all others."""
    products, options = star.products(spark, sf), star.options(spark, sf)
    extra = spark.range(3_000).select(
        F.lit(17).cast("long").alias("product_id"),
        F.when(F.col("id") % 2 == 0, "BLACK").otherwise("RED").alias("color"),
        F.lit("M").alias("size"),
        F.lit("IN_STOCK").alias("stock_status"),
    )
    return products, options.unionByName(extra)


def test_hot_product_stays_bounded_and_whole(hot):
    products, options = hot
    at = F.lit(NOW).cast("timestamp_ntz")
    doc = readmodels.documents(products, options, at).where("id = 17").select(
        readmodels.option_count().alias("n"), F.size("options").alias("entries"),
        F.size(readmodels.expanded_options()).alias("expanded"),
    ).first()
    total = options.where("product_id = 17").count()
    assert doc.n == doc.expanded == total > 3_000
    assert doc.entries == options.where("product_id = 17").distinct().count()
    spec = SearchSpec(color="BLACK", size="M", stock_status="IN_STOCK", sort="priceAsc")
    want = [
        r.id
        for r in products.join(
            options.where("color = 'BLACK' AND size = 'M' AND stock_status = 'IN_STOCK'")
            .select(F.col("product_id").alias("id")).distinct(), "id")
        .orderBy("price", "id").limit(50).collect()
    ]
    assert ids(search.search_exists(products, options, spec)) == want
    assert ids(search.search_join_distinct(products, options, spec)) == want


@pytest.mark.parametrize("build", [search.option_owners, readmodels.nested_options])
def test_rows_of_a_key_are_combined_before_the_shuffle(hot, build):
    options = hot[1]
    df = build(options, SearchSpec(color="BLACK")) if build is search.option_owners else build(
        options
    )
    text = plan(df)
    below = text[text.rindex("Exchange hashpartitioning"):]
    assert "HashAggregate" in below.split("\n", 1)[1]


def test_compact_options_replace_options_on_every_path(hot):
    products, options = hot
    at = F.lit(NOW).cast("timestamp_ntz")
    compact = readmodels.compact_options(options)
    assert compact.groupBy("product_id").count().agg(F.max("count")).first()[0] <= 144
    for spec in (SearchSpec(color="BLACK", size="M"), SearchSpec(status="ACTIVE")):
        want = ids(search.search_exists(products, options, spec))
        assert ids(search.search_exists(products, compact, spec)) == want
        assert ids(search.search_join_distinct(products, compact, spec)) == want
    a, b = (readmodels.documents(products, o, at) for o in (options, compact))
    assert a.exceptAll(b).count() == 0 == b.exceptAll(a).count()
    a, b = (readmodels.signature_table(products, o, at) for o in (options, compact))
    assert a.exceptAll(b).count() == 0 == b.exceptAll(a).count()


def test_bucketed_tables_join_and_build_without_a_shuffle(spark, hot, tmp_path):
    products, options = hot
    at = F.lit(NOW).cast("timestamp_ntz")
    layout.write_bucketed(products, "id", 4, "hot_products", str(tmp_path / "p"))
    layout.write_bucketed(
        readmodels.compact_options(options), "product_id", 4, "hot_options", str(tmp_path / "o")
    )
    p, o = spark.table("hot_products"), spark.table("hot_options")
    spec = SearchSpec(status="ACTIVE", color="BLACK")
    for df in (
        search.search_exists(p, o, spec),
        readmodels.signature_table(p, o, at),
        readmodels.documents(p, o, at),
    ):
        assert "Exchange hashpartitioning" not in plan(df)
    assert ids(search.search_exists(p, o, spec)) == ids(
        search.search_exists(products, options, spec)
    )
    spark.sql("DROP TABLE hot_products")
    spark.sql("DROP TABLE hot_options")


def test_hot_event_product_is_decided_once(spark, sf):
    products = star.products(spark, sf)
    out = star.outbox(spark, sf).withColumn(
        "aggregate_id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("aggregate_id"))
    )
    groups = ob.group_by_product(out)
    assert groups.where("aggregate_id = 5").first().event_count >= 334
    assert groups.agg(F.sum("event_count")).first()[0] == 1_000
    decided = ob.decide_latest(groups, products)
    assert decided.count() == groups.count()


SIDE_EFFECTS = ("stream_", "backfill", "catch_up")


def test_no_query_plans_a_cross_join_or_row_wise_python(spark, sf):
    found = {}
    for name, query in entry.queries().items():
        if name.startswith(SIDE_EFFECTS):
            continue
        text = plan(query(spark, sf))
        bad = re.findall(
            r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython", text
        )
        if bad:
            found[name] = bad
    assert found == {}


def frame(spark, values, group="a"):
    return spark.createDataFrame([(group, v) for v in values], "g string, v double")


PROBS = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.one_of(
            st.integers(-50, 50).map(float),
            st.floats(-1e9, 1e9, allow_nan=False).map(lambda x: round(x, 3)),
        ),
        min_size=1,
        max_size=60,
    )
)
def test_exact_quantiles_match_a_plain_sort(spark, values):
    df = frame(spark, values)
    got = exact_quantiles(df, "v", PROBS).first()
    nearest = exact_quantiles(df, "v", PROBS, discrete=True).first()
    ordered = sorted(values)
    assert (got.n, got.max) == (len(values), ordered[-1])
    for name, p in PROBS.items():
        assert math.isclose(got[name], np.quantile(ordered, p), rel_tol=1e-9, abs_tol=1e-6)
        assert nearest[name] == ordered[max(0, math.ceil(p * len(ordered)) - 1)]


def test_exact_quantiles_per_group_and_with_nulls(spark):
    a = frame(spark, [1.0, 2.0, 4.0], "a")
    df = a.unionByName(frame(spark, [10.0], "b")).unionByName(
        spark.createDataFrame([("a", None), (None, 3.0)], "g string, v double")
    )
    got = {r.g: (r.n, r.p50) for r in exact_quantiles(df, "v", {"p50": 0.5}, ["g"]).collect()}
    assert got == {"a": (3, 2.0), "b": (1, 10.0), None: (1, 3.0)}
    assert exact_quantiles(df.limit(0), "v", {"p50": 0.5}).first().p50 is None
    assert exact_quantiles(df.limit(0), "v", {"p50": 0.5}, ["g"]).count() == 0
    assert lag.quantile_row(df.limit(0), "v").first().p95 == 0


def test_quantiles_of_close_values_rank_few_of_them(spark):
    """200 000 values in one bucket: no window sees more than a slice of them."""
    rows = spark.range(200_000).select((F.col("id") + 1_700_000_000_000).alias("v"))
    found = quantiles.exact_quantiles(rows, "v", {"p50": 0.5, "p99": 0.99})
    assert found.first().p50 == 1_700_000_000_000 + 99_999.5
    bucket = rows.select(quantiles._bucket(F.col("v")).alias("b")).distinct().count()
    assert bucket == 1


def test_quantiles_with_one_far_value_rank_few_values(spark, monkeypatch):
    """One far value stretches the slices; further levels cut the crowded one again."""
    monkeypatch.setattr(quantiles, "KEEP", 1_000)
    first = 1_701_000_000_000
    rows = spark.range(200_000).select((F.col("id") + first).cast("double").alias("v"))
    rows = rows.unionAll(spark.createDataFrame([(first + 3.8e9,)], "v double"))
    seen, reached = [], quantiles._reached

    def watched(*args):
        found = reached(*args)
        seen.append(found[1])
        return found

    monkeypatch.setattr(quantiles, "_reached", watched)
    got = quantiles.exact_quantiles(rows, "v", {"p50": 0.5, "p99": 0.99}).first()
    assert (got.p50, got.p99, got.n) == (first + 100_000, first + 198_000, 200_001)
    assert seen[0] > 100_000 and seen[-1] <= 1_000 and len(seen) <= quantiles.LEVELS + 1


def test_running_total_of_many_ranges_moves_no_row_to_one_task(spark, monkeypatch):
    monkeypatch.setattr(layout, "RANGE_BITS", 3)
    keys = [*range(-20, 40), 1 << 40]
    rows = spark.createDataFrame([(k, abs(k) + 1) for k in keys], "k long, n long")
    found = layout.running_total(rows, "k", "n", "so_far")
    want, total = {}, 0
    for k in keys:
        total += abs(k) + 1
        want[k] = total
    assert {r.k: r.so_far for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
