"""Registered search and paging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfline import schemas
from shelfline.functions.small import checked
from shelfline.operators import paging, readmodels, search
from shelfline.operators.compare import (
    compare_pages,
    dual_run_total,
    page_ids,
    shadow_compare,
)
from shelfline.operators.lag import summary_json
from shelfline.operators.scenarios import selectivity
from shelfline.operators.spec import SearchSpec
from shelfline.plans import check_sql as q
from shelfline.plans.registry import add
from shelfline.session import shared_dir
from shelfline.sources import layout
from shelfline.sources import star_schema as star

REFRESHED_AT = "2024-02-01 00:00:00"

B1 = SearchSpec(
    category_id=3, status="ACTIVE", min_price=10_000, max_price=200_000, color="BLACK",
    stock_status="IN_STOCK", sort="reviewCountDesc", limit=20, offset=10,
)
B2 = SearchSpec(
    status="ACTIVE", color="BLACK", size="M", stock_status="IN_STOCK", limit=50, offset=20
)
B3 = SearchSpec(status="ACTIVE", color="BLACK", sort="createdAtDesc", limit=50, offset=1_000)
BENCHMARK_SET = {"b1": B1, "b2": B2, "b3": B3}

_CATEGORY = SearchSpec(category_id=3, status="ACTIVE", min_price=10_000, max_price=400_000)
SINGLE_TABLE_SET = {
    "q1": _CATEGORY.at(max_price=100_000, offset=100),
    "q2": _CATEGORY.at(brand_id=8, sort="priceAsc", offset=100),
    "q3": SearchSpec(category_id=3, status="ACTIVE", sort="reviewCountDesc", offset=100),
    "q4": _CATEGORY.at(offset=700),
    "q5": SearchSpec(status="ACTIVE", offset=100),
    "q6": SearchSpec(min_price=10_000, max_price=100_000, sort="priceAsc", offset=100),
}
_OPTION = {"color": "BLACK", "stock_status": "IN_STOCK"}
JOIN_SET = {
    "j1": _CATEGORY.at(**_OPTION, limit=20, offset=10),
    "j2": _CATEGORY.at(brand_id=8, color="BLACK", sort="priceAsc", limit=20, offset=5),
    "j3": SearchSpec(
        category_id=3, status="ACTIVE", **_OPTION, sort="reviewCountDesc", limit=50, offset=20
    ),
    "j4": _CATEGORY.at(color="BLACK", offset=200),
    "j5": SearchSpec(status="ACTIVE", **_OPTION, offset=100),
}
KEYSET_SET = {
    "k1": _CATEGORY.at(color="BLACK", stock_status="IN_STOCK", limit=20, offset=30),
    "k2": SearchSpec(status="ACTIVE", **_OPTION, offset=100),
    "k3": SearchSpec(status="ACTIVE", color="BLACK", offset=1_000),
}


def refreshed_at():
    return F.lit(REFRESHED_AT).cast("timestamp_ntz")


def tables(spark, sf):
    return star.products(spark, sf), star.options(spark, sf)


def signature_table(spark, sf):
    return readmodels.signature_table(*tables(spark, sf), refreshed_at())


def documents(spark, sf):
    return readmodels.documents(*tables(spark, sf), refreshed_at())


def postings(spark, sf, sort):
    """Posting lists of the signature table, written anew."""
    path = shared_dir(spark, "postings")
    search.write_postings(signature_table(spark, sf), path, sort)
    return search.read_postings(spark, path, star.products(spark, sf).schema)


PATHS = {
    "join_distinct": lambda s, sf, spec: search.search_join_distinct(*tables(s, sf), spec),
    "exists": lambda s, sf, spec: search.search_exists(*tables(s, sf), spec),
    "signatures": lambda s, sf, spec: search.search_signatures(signature_table(s, sf), spec),
    "nested": lambda s, sf, spec: search.search_documents(documents(s, sf), spec),
}
PATH_SQL = {
    "join_distinct": lambda spec: q.with_relations(
        q.page_of(q.join_rows(spec), spec), "products", "options"
    ),
    "exists": lambda spec: q.with_relations(
        q.page_of(q.exists_rows(spec), spec), "products", "options"
    ),
    "signatures": lambda spec: q.with_relations(
        q.page_of(q.signature_rows(spec), spec), "signature_table"
    ),
    "nested": lambda spec: q.with_relations(
        q.page_of(q.exists_rows(spec, bool(spec.option_filters)), spec), "products", "options"
    ),
}


def _add_path(name: str, path: str, spec: SearchSpec) -> None:
    add(
        name,
        lambda s, sf: paging.with_position(PATHS[path](s, sf, spec), spec),
        PATH_SQL[path](spec),
    )


for _name, _spec in BENCHMARK_SET.items():
    for _path in PATHS:
        _add_path(f"{_name}_{_path}", _path, _spec)
PATHS["postings"] = lambda s, sf, spec: search.search_postings(postings(s, sf, spec.sort), spec)
PATH_SQL["postings"] = PATH_SQL["signatures"]
for _name, _spec in BENCHMARK_SET.items():
    _add_path(f"{_name}_postings", "postings", _spec)
_add_path("postings_no_option", "postings", SearchSpec(status="ACTIVE", sort="priceAsc", offset=200))
for _name, _spec in JOIN_SET.items():
    _add_path(f"{_name}_join_distinct", "join_distinct", _spec)
    _add_path(f"{_name}_exists", "exists", _spec)

_add_path("partial_signature_1", "signatures", SearchSpec(status="ACTIVE", size="M", offset=40))
_add_path(
    "partial_signature_2",
    "signatures",
    SearchSpec(size="FREE", stock_status="LOW_STOCK", sort="priceDesc", offset=60),
)


def _add_single_table(name: str, spec: SearchSpec) -> None:
    def rows(spark, sf):
        return search.filtered(star.products(spark, sf), spec.product_predicates())

    sql = q.with_relations(q.page_of(q.exists_rows(spec, False), spec), "products")
    add(name, lambda s, sf: paging.with_position(paging.page(rows(s, sf), spec), spec), sql)

    def by_cursor(spark, sf):
        cursor = paging.derive_cursor(rows(spark, sf), spec, spec.offset)
        found = paging.keyset_page(rows(spark, sf), spec, cursor) if cursor else rows(
            spark, sf
        ).limit(0)
        return paging.with_position(found, spec)

    add(f"{name}_keyset", by_cursor, sql)


for _name, _spec in SINGLE_TABLE_SET.items():
    _add_single_table(_name, _spec)


def _keyset(spark, sf, spec):
    products, options = tables(spark, sf)
    cursor = paging.derive_cursor(
        search.matches_exists(products, options, spec), spec, spec.offset
    )
    if cursor is None:
        return products.limit(0)
    return search.search_keyset(products, options, spec, cursor)


for _name, _spec in {**KEYSET_SET, "b3": B3}.items():
    add(
        f"{_name}_keyset",
        lambda s, sf, spec=_spec: paging.with_position(_keyset(s, sf, spec), spec),
        PATH_SQL["exists"](_spec),
    )

for _name, _spec in {"k1": KEYSET_SET["k1"], "k3": KEYSET_SET["k3"]}.items():
    add(
        f"{_name}_cursor",
        lambda s, sf, spec=_spec: paging.cursor_row(
            search.matches_exists(*tables(s, sf), spec), spec, spec.offset
        ),
        q.with_relations(
            f"""SELECT max({_spec.sort_keys()[0]}) AS cursor_key, max(id) AS cursor_id
                FROM ({q.page_of(q.exists_rows(_spec), _spec.at(limit=1, offset=_spec.offset - 1))})""",
            "products",
            "options",
        ),
    )

# Equivalence of the offset and the keyset page, and of source and read-table pages.


def _same_page_sql(rows: str, spec: SearchSpec, scenario: str, *relations: str) -> str:
    return q.with_relations(
        f"""SELECT '{scenario}' AS scenario, {spec.offset} AS offset_rows,
                   count(*) AS source_page_count, count(*) AS read_page_count,
                   TRUE AS ids_match, CAST(NULL AS BIGINT) AS first_mismatched_source_id,
                   CAST(NULL AS BIGINT) AS first_mismatched_read_id
            FROM ({q.page_of(rows, spec)})""",
        *relations,
    )


def _offset_vs_keyset(spark, sf, name, spec):
    offset = paging.with_position(PATHS["exists"](spark, sf, spec), spec)
    keyset = paging.with_position(_keyset(spark, sf, spec), spec)
    return compare_pages(offset, keyset, name, spec.offset)


for _name, _spec in KEYSET_SET.items():
    add(
        f"{_name}_equivalence",
        lambda s, sf, n=_name, spec=_spec: _offset_vs_keyset(s, sf, n, spec),
        _same_page_sql(q.exists_rows(_spec), _spec, _name, "products", "options"),
    )


def _source_vs_read(spark, sf, name, spec):
    source = paging.with_position(PATHS["exists"](spark, sf, spec), spec)
    read = paging.with_position(PATHS["signatures"](spark, sf, spec), spec)
    return compare_pages(source, read, name, spec.offset)


for _name, _spec in BENCHMARK_SET.items():
    add(
        f"{_name}_page_equivalence",
        lambda s, sf, n=_name, spec=_spec: _source_vs_read(s, sf, n, spec),
        _same_page_sql(q.exists_rows(_spec), _spec, _name, "products", "options"),
    )

# Nested against flattened option matching: the flattened form finds too much.

_FLAT = SearchSpec(color="BLACK", size="M", stock_status="IN_STOCK")


def _flattened_sql(spec: SearchSpec) -> str:
    each = " AND ".join(
        f"EXISTS (SELECT 1 FROM options o WHERE o.product_id = p.id AND o.{c} = '{v}')"
        for c, v in spec.option_filters.items()
    )
    return f"SELECT {q.API} FROM products p WHERE {q.product_where(spec)} AND {each}"


def _first_mismatch(spark, sf):
    docs = documents(spark, sf)
    spec = _FLAT.at(status="ACTIVE")
    pages = [
        paging.with_position(search.search_documents(docs, spec, flattened), spec)
        for flattened in (False, True)
    ]
    return compare_pages(*pages, "nested_vs_flattened", 0)


def _pair_sql(left: str, right: str, spec: SearchSpec) -> dict[str, str]:
    return {"a": q.page_of(left, spec), "b": q.page_of(right, spec)}


add(
    "first_mismatch",
    _first_mismatch,
    q.with_relations(
        """, d AS (SELECT position, a.id AS l, b.id AS r FROM a FULL JOIN b USING (position)
             WHERE a.id IS DISTINCT FROM b.id ORDER BY position LIMIT 1)
        SELECT 'nested_vs_flattened' AS scenario, 0 AS offset_rows,
               (SELECT count(*) FROM a) AS source_page_count,
               (SELECT count(*) FROM b) AS read_page_count,
               (SELECT count(*) FROM d) = 0 AS ids_match,
               (SELECT l FROM d) AS first_mismatched_source_id,
               (SELECT r FROM d) AS first_mismatched_read_id""",
        "products",
        "options",
        **_pair_sql(
            q.exists_rows(_FLAT.at(status="ACTIVE")),
            _flattened_sql(_FLAT.at(status="ACTIVE")),
            _FLAT,
        ),
    ),
)


def _false_positives(spark, sf):
    docs = documents(spark, sf)
    return docs.where(search.any_option_each(_FLAT) & ~search.same_option(_FLAT)).select(
        "id", "status", readmodels.option_count().alias("option_count")
    )


add(
    "flattened_false_positive",
    _false_positives,
    q.with_relations(
        f"""SELECT p.id, p.status, d.option_count
            FROM ({_flattened_sql(_FLAT)}) p JOIN doc_options d ON d.product_id = p.id
            WHERE NOT {q.exists_option(_FLAT)}""",
        "products",
        "doc_options",
    ),
)

# Without an option filter the paths differ on products that have no options.

_NO_OPTION = SearchSpec(status="ACTIVE")


def _no_option_filter(spark, sf):
    products, options = tables(spark, sf)
    rows = {
        "join_distinct": search.matches_join_distinct(products, options, _NO_OPTION),
        "exists": search.matches_exists(products, options, _NO_OPTION),
        "exists_not_required": search.matches_exists(products, options, _NO_OPTION, False),
        "signatures": search.matches_signatures(signature_table(spark, sf), _NO_OPTION),
        "documents": search.matches_documents(documents(spark, sf), _NO_OPTION),
    }
    counted = [
        df.agg(F.count(F.lit(1)).alias("matching")).select(F.lit(n).alias("path"), "matching")
        for n, df in rows.items()
    ]
    result = counted[0]
    for part in counted[1:]:
        result = result.unionByName(part)
    return result


add(
    "exists_no_option_filter",
    _no_option_filter,
    q.with_relations(
        f"""SELECT path, CASE WHEN kept THEN (SELECT count(*) FROM products p
                 WHERE {q.product_where(_NO_OPTION)})
               ELSE (SELECT count(*) FROM ({q.exists_rows(_NO_OPTION)})) END AS matching
            FROM (VALUES ('join_distinct', FALSE), ('exists', FALSE),
                  ('exists_not_required', TRUE), ('signatures', FALSE), ('documents', TRUE))
                 v(path, kept)""",
        "products",
        "options",
    ),
)

# Envelope, dispatch, id list, deep offset.

add(
    "search_page_summary",
    lambda s, sf: paging.page_summary(PATHS["exists"](s, sf, B2), B2),
    q.with_relations(
        f"""SELECT {B2.limit} AS "limit", {B2.offset} AS "offset", count(*) AS returned_count
            FROM ({q.page_of(q.exists_rows(B2), B2)})""",
        "products",
        "options",
    ),
)


def _dispatch(spark, sf):
    products, options = tables(spark, sf)
    pages = [
        paging.with_position(
            search.search(
                path, B2, products=products, options=options,
                documents=documents(spark, sf), signatures=signature_table(spark, sf),
            ),
            B2,
        ).withColumn("path", F.lit(path))
        for path in ("db", "documents", "signatures", "join_distinct")
    ]
    result = pages[0]
    for part in pages[1:]:
        result = result.unionByName(part)
    return result.select("path", "position", "id")


add(
    "search_dispatch",
    _dispatch,
    q.with_relations(
        f"""SELECT path, position, id FROM ({q.page_of(q.exists_rows(B2), B2)})
            CROSS JOIN (VALUES ('db'), ('documents'), ('signatures'), ('join_distinct')) v(path)""",
        "products",
        "options",
    ),
)
add(
    "page_id_list",
    lambda s, sf: page_ids(
        paging.with_position(PATHS["exists"](s, sf, B2), B2)
    ).select(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids")),
    q.with_relations(
        f"""SELECT coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY position), '') AS ids
            FROM ({q.page_of(q.exists_rows(B2), B2)})""",
        "products",
        "options",
    ),
)

_DEEP = SearchSpec(sort="reviewCountDesc", limit=50, offset=5_000)
add(
    "deep_page_by_counting",
    lambda s, sf: paging.with_position(
        paging.deep_page(star.products(s, sf), _DEEP), _DEEP
    ),
    q.with_relations(q.page_of(q.exists_rows(_DEEP, False), _DEEP), "products"),
)

# Layouts and join hints change the plan, not the result.

_LAYOUT_SPECS = {
    "category_latest": SINGLE_TABLE_SET["q1"],
    "category_price": SINGLE_TABLE_SET["q6"],
    "category_brand_price": SINGLE_TABLE_SET["q2"],
    "active_latest": SINGLE_TABLE_SET["q5"],
}


def _from_layout(spark, sf, name, spec):
    """The query on a copy of the products written in the layout."""
    path = shared_dir(spark, f"layout-{name}")
    layout.write_layout(star.products(spark, sf), layout.LAYOUTS[name], path)
    rows = search.filtered(spark.read.parquet(path), spec.product_predicates())
    return paging.with_position(
        paging.page(rows.select(*schemas.API_COLUMNS), spec), spec
    )


for _name, _spec in _LAYOUT_SPECS.items():
    add(
        f"layout_{_name}",
        lambda s, sf, n=_name, spec=_spec: _from_layout(s, sf, n, spec),
        q.with_relations(q.page_of(q.exists_rows(_spec, False), _spec), "products"),
    )


def _options_from_layout(spark, sf, name):
    path = shared_dir(spark, f"layout-{name}")
    layout.write_layout(star.options(spark, sf), layout.LAYOUTS[name], path)
    page = search.search_exists(star.products(spark, sf), spark.read.parquet(path), B2)
    return paging.with_position(page, B2)


for _name in ("option_filter_first", "join_key_first"):
    add(
        f"layout_{_name}",
        lambda s, sf, n=_name: _options_from_layout(s, sf, n),
        PATH_SQL["exists"](B2),
    )


def _hinted(spark, sf, hint):
    products, options = tables(spark, sf)
    rows = search.filtered(products, B2.product_predicates()).select(*schemas.API_COLUMNS)
    owners = search.option_owners(options, B2)
    return paging.with_position(
        paging.page(rows.join(owners.hint(hint), "id", "left_semi"), B2), B2
    )


for _hint in ("merge", "shuffle_hash"):
    add(f"join_hint_{_hint}", lambda s, sf, h=_hint: _hinted(s, sf, h), PATH_SQL["exists"](B2))



def _checked_broadcast(spark, sf):
    """The matching ids are broadcast if there are few enough of them."""
    products, options = tables(spark, sf)
    rows = search.filtered(products, B2.product_predicates()).select(*schemas.API_COLUMNS)
    owners = checked(search.option_owners(options, B2))
    return paging.with_position(paging.page(rows.join(owners, "id", "left_semi"), B2), B2)


add("join_checked_broadcast", _checked_broadcast, PATH_SQL["exists"](B2))

# Selectivity controls.

SELECTIVITY_CASES = {
    "common_global": SearchSpec(color="BLACK", size="M", stock_status="IN_STOCK"),
    "less_common_global": SearchSpec(color="GRAY", size="XL", stock_status="OUT_OF_STOCK"),
    "common_q1_shape": _CATEGORY.at(color="BLACK", size="M", stock_status="IN_STOCK"),
    "common_q2_shape": _CATEGORY.at(
        brand_id=8, color="BLACK", size="M", stock_status="IN_STOCK"
    ),
    "less_common_q1_shape": _CATEGORY.at(
        color="GRAY", size="XL", stock_status="OUT_OF_STOCK"
    ),
    "less_common_q2_shape": _CATEGORY.at(
        brand_id=8, color="GRAY", size="XL", stock_status="OUT_OF_STOCK"
    ),
}


def _selectivity_sql() -> str:
    parts = [
        f"""SELECT '{name}' AS control_case, '{s.color}' AS color, '{s.size}' AS size,
                   '{s.stock_status}' AS stock_status, count(*) AS joined_option_rows,
                   count(DISTINCT p.id) AS distinct_product_count,
                   round(CAST(count(*) AS DOUBLE)
                         / CAST(nullif(count(DISTINCT p.id), 0) AS DOUBLE), 4)
                       AS option_rows_per_distinct_product
            FROM products p JOIN options o ON o.product_id = p.id
            WHERE {q.product_where(s)} AND {q.option_where(s)}"""
        for name, s in SELECTIVITY_CASES.items()
    ]
    return q.with_relations(" UNION ALL ".join(parts), "products", "options")


add(
    "j6_selectivity",
    lambda s, sf: selectivity(*tables(s, sf), SELECTIVITY_CASES),
    _selectivity_sql(),
)

# Top-k shadow comparison of the database path with documents that lag behind: documents of the
# products as they were at creation.

SHADOW_SET = {
    "c1": SearchSpec(
        status="ACTIVE", category_id=3, color="BLACK", size="M", stock_status="IN_STOCK",
        sort="reviewCountDesc",
    ),
    "c2": SearchSpec(status="ACTIVE", sort="reviewCountDesc"),
    "c3": SearchSpec(
        status="DELETED", color="GRAY", size="M", stock_status="LOW_STOCK", sort="reviewCountDesc"
    ),
}


def as_created(products):
    """The products as they were when created: active, at their first price, not yet updated."""
    return products.withColumns(
        {
            "status": F.lit("ACTIVE"),
            "price": (F.col("price") + F.col("review_count") % 7).cast("int"),
            "updated_at": F.col("created_at"),
        }
    )


AS_CREATED_SQL = """
    SELECT * REPLACE ('ACTIVE' AS status, CAST(price + review_count % 7 AS INTEGER) AS price,
                      created_at AS updated_at) FROM products"""


def _dual_run(spark, sf):
    products, options = tables(spark, sf)
    lagging = readmodels.documents(as_created(products), options, refreshed_at())
    parts = []
    for name, spec in SHADOW_SET.items():
        db = paging.with_position(search.search_exists(products, options, spec, False), spec)
        found = paging.with_position(search.search_documents(lagging, spec), spec)
        parts.append(shadow_compare(db, found, name))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def _shadow_sql(name: str, spec: SearchSpec) -> str:
    by_option = f" AND {q.exists_option(spec)}" if spec.option_filters else ""
    db = f"SELECT * FROM products p WHERE {q.product_where(spec)}{by_option}"
    found = f"SELECT * FROM old_products p WHERE {q.product_where(spec)}{by_option}"
    a, b = (q.page_of(rows, spec) for rows in (db, found))
    return f"""
        SELECT '{name}' AS scenario,
               (SELECT count(*) FROM ({a})) AS db_count,
               (SELECT count(*) FROM ({b})) AS search_count,
               (SELECT count(*) FROM ({a}) a FULL JOIN ({b}) b USING (position)
                WHERE a.id IS DISTINCT FROM b.id) AS ordering_mismatches,
               (SELECT count(*) FROM ({a}) a WHERE a.id NOT IN (SELECT id FROM ({b})))
                   AS missing_in_search,
               (SELECT count(*) FROM ({b}) b WHERE b.id NOT IN (SELECT id FROM ({a})))
                   AS extra_in_search"""


_SHADOW_SQL = (
    "SELECT *, ordering_mismatches + missing_in_search + extra_in_search AS mismatch_count FROM ("
    + " UNION ALL ".join(_shadow_sql(n, s) for n, s in SHADOW_SET.items())
    + ")"
)
add(
    "dual_run_report",
    _dual_run,
    q.with_relations(_SHADOW_SQL, "products", "options", old_products=AS_CREATED_SQL),
)
add(
    "dual_run_total",
    lambda s, sf: dual_run_total(_dual_run(s, sf)),
    q.with_relations(
        f"""SELECT count(*) AS scenario_count, CAST(sum(db_count) AS BIGINT) AS db_count,
                   CAST(sum(mismatch_count) AS BIGINT) AS mismatch_count,
                   round(CAST(sum(mismatch_count) AS DOUBLE)
                         / greatest(CAST(sum(db_count) AS DOUBLE), 1), 6) AS mismatch_ratio
            FROM ({_SHADOW_SQL})""",
        "products",
        "options",
        old_products=AS_CREATED_SQL,
    ),
)
add(
    "summary_artifact",
    lambda s, sf: summary_json(dual_run_total(_dual_run(s, sf))).select(
        F.get_json_object("value", "$.scenario_count").cast("long").alias("scenario_count"),
        F.get_json_object("value", "$.mismatch_count").cast("long").alias("mismatch_count"),
    ),
    q.with_relations(
        f"""SELECT count(*) AS scenario_count,
                   CAST(sum(mismatch_count) AS BIGINT) AS mismatch_count FROM ({_SHADOW_SQL})""",
        "products",
        "options",
        old_products=AS_CREATED_SQL,
    ),
)
