import itertools

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from shelfline.functions.columns import register_sql_functions
from shelfline.operators import paging, readmodels, search
from shelfline.operators.spec import SORTS, SearchSpec
from shelfline.sources import star_schema as star

NOW = "2026-05-02 13:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def ids(df):
    return [r.id for r in df.collect()]


@pytest.fixture(scope="module")
def model(spark, sf):
    p, o = star.products(spark, sf), star.options(spark, sf)
    return p, o, readmodels.signature_table(p, o, now()), readmodels.documents(p, o, now())


@pytest.mark.parametrize(
    "bad",
    [
        {"limit": 0},
        {"limit": 101},
        {"offset": -1},
        {"sort": "nameAsc"},
        {"min_price": 5, "max_price": 4},
        {"min_price": -1},
        {"max_price": -1},
    ],
)
def test_bad_arguments_are_rejected(bad):
    with pytest.raises(ValueError):
        SearchSpec(**bad).validate()


def test_defaults():
    spec = SearchSpec().validate()
    assert (spec.sort, spec.limit, spec.offset) == ("createdAtDesc", 50, 0)


@pytest.mark.parametrize("sort", sorted(SORTS))
@pytest.mark.parametrize(
    "filters",
    [
        {"color": "BLACK", "size": "M", "stock_status": "IN_STOCK"},
        {"size": "XL", "status": "ACTIVE"},
        {"color": "RED", "stock_status": "LOW_STOCK", "min_price": 100_000},
    ],
)
def test_four_paths_agree(model, sort, filters):
    p, o, table, docs = model
    spec = SearchSpec(**filters, sort=sort, limit=20, offset=3)
    expected = ids(search.search_exists(p, o, spec))
    assert expected
    assert ids(search.search_join_distinct(p, o, spec)) == expected
    assert ids(search.search_signatures(table, spec)) == expected
    assert ids(search.search_documents(docs, spec)) == expected


def test_without_option_filter_paths_keep_their_own_rule(model):
    p, o, table, docs = model
    spec = SearchSpec(status="ACTIVE")
    with_options = search.matches_exists(p, o, spec).count()
    assert search.matches_join_distinct(p, o, spec).count() == with_options
    assert search.matches_signatures(table, spec).count() == with_options
    every = p.where("status = 'ACTIVE'").count()
    assert search.matches_documents(docs, spec).count() == every
    assert search.matches_exists(p, o, spec, require_option=False).count() == every
    assert every - with_options == 7


def test_nested_match_needs_one_option_flattened_does_not(spark):
    p = fx.products(spark, [(1, "ACTIVE", 100, 1, fx.T0)])
    o = fx.options(
        spark, [(11, 1, "BLACK", "S", "IN_STOCK"), (12, 1, "WHITE", "M", "IN_STOCK")]
    )
    docs = readmodels.documents(p, o, now())

    def hits(flat=False, **f):
        return search.matches_documents(docs, SearchSpec(**f), flat).count()

    assert hits(color="BLACK", size="S") == 1
    assert hits(color="BLACK", size="M") == 0
    assert hits(True, color="BLACK", size="M") == 1


def test_documents_keep_order_of_option_ids_and_count_copies(spark):
    p = fx.products(spark, [(1, "ACTIVE", 100, 1, fx.T0), (2, "ACTIVE", 100, 1, fx.T0)])
    o = fx.options(
        spark,
        [
            (13, 1, "BLACK", "S", "IN_STOCK"),
            (12, 1, "WHITE", "M", "IN_STOCK"),
            (14, 1, "WHITE", "M", "IN_STOCK"),
        ],
    )
    one, two = readmodels.documents(p, o, now()).orderBy("id").collect()
    assert [(x.color, x.copies) for x in one.options] == [("WHITE", 2), ("BLACK", 1)]
    assert two.options == []
    table = readmodels.signature_table(p, o, now()).collect()
    assert [r.option_signatures for r in table] == [["BLACK|S|IN_STOCK", "WHITE|M|IN_STOCK"]]


@pytest.mark.parametrize("sort", sorted(SORTS))
def test_keyset_equals_offset(model, sort):
    p, o, _, _ = model
    spec = SearchSpec(sort=sort, size="M", limit=25)
    offset_page = ids(search.search_exists(p, o, spec.at(offset=60)))
    cursor = paging.derive_cursor(search.matches_exists(p, o, spec), spec, 60)
    assert ids(search.search_keyset(p, o, spec, cursor)) == offset_page
    assert ids(search.search_keyset(p, o, spec, None)) == ids(search.search_exists(p, o, spec))


def test_cursor_of_a_short_result_is_none(model):
    assert paging.derive_cursor(model[0], SearchSpec(), 1_000_000) is None


@pytest.mark.parametrize("sort", sorted(SORTS))
@pytest.mark.parametrize("offset", [0, 700, 1_490, 2_000])
def test_deep_page_equals_offset(model, monkeypatch, sort, offset):
    monkeypatch.setattr(paging, "DEEP_SKIP", 20)
    monkeypatch.setattr(paging, "SLICES", 16)
    spec = SearchSpec(sort=sort, limit=30, offset=offset)
    expected = ids(model[0].orderBy(*spec.order()).offset(offset).limit(30))
    assert ids(paging.deep_page(model[0], spec)) == expected


def test_deep_page_inside_one_shared_key(spark, monkeypatch):
    monkeypatch.setattr(paging, "DEEP_SKIP", 20)
    monkeypatch.setattr(paging, "SLICES", 16)
    rows = spark.range(5_000).select("id", F.lit(7).alias("price"))
    for sort in ("priceAsc", "priceDesc"):
        spec = SearchSpec(sort=sort, limit=40, offset=3_210)
        expected = ids(rows.orderBy(*spec.order()).offset(3_210).limit(40))
        assert ids(paging.deep_page(rows, spec)) == expected


def test_id_windows_cover_everything_within_the_batch_size(spark):
    keys = sorted({*range(-50, 30), *range(10_000, 10_400, 3), 5_000_000})
    df = spark.createDataFrame([(k,) for k in keys], "id long")
    for size, after in itertools.product((1, 7, 64), (None, -20, 10_050)):
        plan = paging.id_windows(df, size, after).orderBy("batch").collect()
        windows = [(r.lo, r.hi, r.rows) for r in plan]
        rest = [k for k in keys if after is None or k > after]
        covered = [[k for k in rest if lo <= k <= hi] for lo, hi, _ in windows]
        assert sum(covered, []) == rest
        assert [len(c) for c in covered] == [n for _, _, n in windows]
        assert all(n <= size for _, _, n in windows)
        whole = {r.hi for r in paging.id_windows(df, size).collect()}
        assert {hi for _, hi, _ in windows} <= whole  # a later start cuts at the same places
    assert paging.id_windows(df, 5, 9_999_999).count() == 0


def test_result_window_guard(model):
    with pytest.raises(ValueError):
        search.search_documents(model[3], SearchSpec(offset=10_001, limit=50))
    search.search_documents(model[3], SearchSpec(offset=10_000, limit=50))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_the_intended_shape(model):
    p, o, table, _ = model
    spec = SearchSpec(status="ACTIVE", color="BLACK", offset=10)
    exists = plan(search.search_exists(p, o, spec))
    assert "LeftSemi" in exists and "TakeOrderedAndProject" in exists
    joined = plan(search.search_join_distinct(p, o, spec))
    assert "Inner" in joined and "LeftSemi" not in joined
    assert plan(search.search_signatures(table, spec)).count("Join") == 1  # the table's own build


def test_keyset_and_filters_reach_the_scan(spark, model, tmp_path):
    path = str(tmp_path / "p")
    model[0].write.parquet(path)
    rows = spark.read.parquet(path)
    spec = SearchSpec(status="ACTIVE", category_id=3, min_price=10_000)
    cursor = ("2000-01-01 00:00:00", 500)
    df = search.search_keyset(rows, None, spec, (F.lit(cursor[0]).cast("timestamp_ntz"), 500))
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    pushed = [line for line in plan(df).splitlines() if "PushedFilters" in line][0]
    for part in ("EqualTo(status", "EqualTo(category_id", "GreaterThanOrEqual(price",
                 "LessThanOrEqual(created_at"):
        assert part in pushed


def test_search_dispatch_rejects_unknown_path():
    with pytest.raises(ValueError):
        search.search("cache", SearchSpec())


def test_signature_sql_function(spark):
    register_sql_functions(spark)
    row = spark.sql(
        "SELECT product_option_signature('A', 'B', 'C') AS s, "
        "product_option_signature('A', NULL, 'C') AS n"
    ).first()
    assert (row.s, row.n) == ("A|B|C", None)


@pytest.mark.parametrize("sort", ["priceAsc", "priceDesc"])
@pytest.mark.parametrize("limit", [10, 10_050])
def test_pages_with_null_keys_do_not_depend_on_the_top_k_limit(spark, monkeypatch, sort, limit):
    """More ids than slices; nulls come first when ascending, last when descending."""
    monkeypatch.setattr(paging, "TOP_K_LIMIT", limit)
    monkeypatch.setattr(paging, "DEEP_SKIP", 50)
    price = F.when(F.col("id") % 9 != 0, (F.col("id") * 7919) % 50_000).alias("price")
    rows = spark.range(40_000).select("id", price)
    for offset in (0, 3_000, 4_420, 20_000, 36_000, 39_990, 45_000):
        spec = SearchSpec(sort=sort, limit=30, offset=offset)
        expected = ids(rows.orderBy(*spec.order()).offset(offset).limit(30))
        assert ids(paging.page(rows, spec)) == expected


def test_deep_page_of_keys_that_are_all_null(spark, monkeypatch):
    monkeypatch.setattr(paging, "DEEP_SKIP", 20)
    rows = spark.range(3_000).select("id", F.lit(None).cast("int").alias("price"))
    spec = SearchSpec(sort="priceDesc", limit=5, offset=1_000)
    assert ids(paging.deep_page(rows, spec)) == list(range(1_999, 1_994, -1))


def test_posting_lists_are_read_by_partition_and_merged_exactly(spark, tmp_path):
    """Repeats over lists, a list with a third of the products, and pages beyond a list's end."""
    p = fx.products(spark, [(i, "ACTIVE", i % 7, i % 5, fx.T0) for i in range(300)])
    o = fx.options(
        spark,
        [(i * 3 + j, i, c, s, "IN_STOCK") for i in range(0, 300, 2) for j, (c, s) in
         enumerate([("RED", "M"), ("RED", "S")][: 1 + i % 4 // 2])]
        + [(9_000 + i, i, "BLUE", "M", "IN_STOCK") for i in range(0, 300, 3)],
    )
    table = readmodels.signature_table(p, o, F.lit(fx.T0).cast("timestamp_ntz"))
    for sort in ("priceAsc", "reviewCountDesc"):
        path = str(tmp_path / sort)
        search.write_postings(table, path, sort)
        lists = search.read_postings(spark, path)
        filters = [{"color": "RED"}, {"size": "M"}, {}, {"color": "GRAY"},
                   {"color": "RED", "size": "M", "stock_status": "IN_STOCK"}]
        for wanted, offset in itertools.product(filters, (0, 60, 500)):
            spec = SearchSpec(sort=sort, limit=40, offset=offset, **wanted)
            assert ids(search.search_postings(lists, spec)) == ids(search.search_signatures(table, spec))
    whole = SearchSpec(color="RED", size="M", stock_status="IN_STOCK")
    found = search.search_postings(lists, whole)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(signature" in plan and "Exchange" not in plan
    part = search.search_postings(lists, SearchSpec(color="RED"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in part and "PartitionFilters: [" in part.replace("PartitionFilters: []", "")


def test_posting_lists_beyond_the_result_window(spark, tmp_path, monkeypatch):
    p = fx.products(spark, [(i, "ACTIVE", i % 7, i % 5, fx.T0) for i in range(200)])
    o = fx.options(spark, [(i * 2 + j, i, c, "M", "IN_STOCK") for i in range(200) for j, c in enumerate(("RED", "BLUE"))])
    table = readmodels.signature_table(p, o, F.lit(fx.T0).cast("timestamp_ntz"))
    search.write_postings(table, str(tmp_path / "lists"), "priceAsc")
    monkeypatch.setattr(paging, "TOP_K_LIMIT", 100)
    spec = SearchSpec(size="M", sort="priceAsc", limit=30, offset=150)
    found = search.search_postings(search.read_postings(spark, str(tmp_path / "lists")), spec)
    assert ids(found) == ids(search.search_signatures(table, spec))
