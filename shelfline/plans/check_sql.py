"""SQL text for checking queries on the star-schema tables with another engine."""

from __future__ import annotations

from shelfline import schemas
from shelfline.operators.spec import SearchSpec
from shelfline.sources import generator as gen


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: Named relations; later ones may use earlier ones.
RELATIONS = {
    "products": """
        SELECT o_orderkey AS id, o_custkey AS seller_id,
               o_custkey % 5 + 1 AS category_id, o_custkey % 25 + 1 AS brand_id,
               CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'F' THEN 'SOLD_OUT'
                    WHEN 'P' THEN 'DELETED' END AS status,
               CAST(floor(o_totalprice) AS INTEGER) AS price,
               CAST(o_orderkey % 501 AS DOUBLE) / 100 AS rating,
               CAST((o_orderkey * 122949 + 77777) % 200 AS INTEGER) AS review_count,
               o_orderdate AS created_at,
               o_orderdate + to_days(CAST(o_orderkey % 60 AS INTEGER)) AS updated_at
        FROM orders""",
    "options": f"""
        SELECT l_orderkey AS product_id,
               list_extract({_list(schemas.COLORS)}, CAST(l_partkey % 8 AS INTEGER) + 1) AS color,
               list_extract({_list(schemas.SIZES)}, CAST(l_suppkey % 6 AS INTEGER) + 1) AS size,
               CASE l_returnflag WHEN 'A' THEN 'IN_STOCK' WHEN 'N' THEN 'LOW_STOCK'
                    WHEN 'R' THEN 'OUT_OF_STOCK' END AS stock_status
        FROM lineitem""",
    "option_rows": f"""
        SELECT l_orderkey AS product_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp,
               list_extract({_list(schemas.COLORS)}, CAST(l_partkey % 8 AS INTEGER) + 1) AS color,
               list_extract({_list(schemas.SIZES)}, CAST(l_suppkey % 6 AS INTEGER) + 1) AS size,
               CASE l_returnflag WHEN 'A' THEN 'IN_STOCK' WHEN 'N' THEN 'LOW_STOCK'
                    WHEN 'R' THEN 'OUT_OF_STOCK' END AS stock_status
        FROM lineitem""",
    "outbox_base": """
        SELECT event_id AS id, user_id * 101 AS aggregate_id,
               CASE event_type WHEN 'signup' THEN 'PRODUCT_CREATED'
                    WHEN 'click' THEN 'PRODUCT_UPDATED' WHEN 'error' THEN 'PRODUCT_DELETED'
                    WHEN 'view' THEN 'PRODUCT_STATUS_CHANGED'
                    WHEN 'purchase' THEN 'PRODUCT_OPTION_CHANGED' END AS event_type,
               props AS payload,
               CASE WHEN event_id % 20 < 16 THEN 'DONE' WHEN event_id % 20 < 18 THEN 'PENDING'
                    WHEN event_id % 20 = 18 THEN 'PROCESSING' ELSE 'FAILED' END AS status,
               CASE WHEN event_id % 20 = 18 THEN 'token-' || (event_id % 3) END AS claim_token,
               CASE WHEN event_id % 20 NOT IN (16, 17) THEN 'relay-' || (event_id % 4) END
                   AS claimed_by,
               CASE WHEN event_id % 20 NOT IN (16, 17)
                    THEN ts + to_milliseconds(CAST(floor(value * 100) AS BIGINT)) END
                   AS claimed_at,
               CAST(event_id % 4 AS INTEGER) AS retry_count,
               CASE WHEN event_id % 40 = 16 THEN ts + to_days(40) END AS next_retry_at,
               ts AS created_at
        FROM events""",
    "outbox": """
        SELECT *, CASE WHEN status IN ('DONE', 'FAILED')
                       THEN claimed_at + to_milliseconds(250) END AS processed_at,
               CASE WHEN status IN ('DONE', 'FAILED') THEN claimed_at + to_milliseconds(250)
                    ELSE coalesce(claimed_at, created_at) END AS updated_at
        FROM outbox_base""",
    "signatures": """
        SELECT product_id, list_sort(list(DISTINCT color || '|' || size || '|' || stock_status))
                   AS option_signatures
        FROM options GROUP BY product_id""",
    "signature_table": """
        SELECT p.*, s.option_signatures FROM products p
        JOIN signatures s ON s.product_id = p.id""",
    "doc_options": """
        SELECT product_id, string_agg(color || '/' || size || '/' || stock_status || 'x' || copies,
                   ',' ORDER BY color, size, stock_status) AS options_text,
               CAST(sum(copies) AS BIGINT) AS option_count
        FROM (SELECT product_id, color, size, stock_status, count(*) AS copies
              FROM options GROUP BY ALL) GROUP BY product_id""",
    "document_rows": """
        SELECT p.*, coalesce(d.options_text, '') AS options_text,
               coalesce(d.option_count, 0) AS option_count
        FROM products p LEFT JOIN doc_options d ON d.product_id = p.id""",
}
_USES = {
    "outbox": ["outbox_base"],
    "signatures": ["options"],
    "signature_table": ["products", "options", "signatures"],
    "doc_options": ["options"],
    "document_rows": ["products", "options", "doc_options"],
}


def with_relations(body: str, *names: str, **extra: str) -> str:
    """``body`` after a WITH clause of the named relations and what they use."""
    wanted: list[str] = []
    for name in names:
        wanted += [*_USES.get(name, []), name]
    parts = [f"{n} AS ({RELATIONS[n]})" for n in dict.fromkeys(wanted)]
    parts += [f"{n} AS ({text})" for n, text in extra.items()]
    return f"WITH {', '.join(parts)} {body}"


API = ", ".join(schemas.API_COLUMNS)


def product_where(spec: SearchSpec, alias: str = "p") -> str:
    tests = [
        f"{alias}.{c} = {v!r}"
        for c, v in (
            ("category_id", spec.category_id),
            ("brand_id", spec.brand_id),
            ("status", spec.status),
        )
        if v is not None
    ]
    if spec.min_price is not None:
        tests.append(f"{alias}.price >= {spec.min_price}")
    if spec.max_price is not None:
        tests.append(f"{alias}.price <= {spec.max_price}")
    return " AND ".join(tests) or "TRUE"


def option_where(spec: SearchSpec, alias: str = "o") -> str:
    return " AND ".join(f"{alias}.{c} = '{v}'" for c, v in spec.option_filters.items()) or "TRUE"


def exists_option(spec: SearchSpec) -> str:
    return (
        f"EXISTS (SELECT 1 FROM options o WHERE o.product_id = p.id AND {option_where(spec)})"
    )


def order_by(spec: SearchSpec) -> str:
    key, ascending = spec.sort_keys()
    way = "ASC" if ascending else "DESC"
    return f"{key} {way}, id {way}"


def page_of(rows: str, spec: SearchSpec, columns: str = API) -> str:
    """A numbered page of a row query."""
    order = order_by(spec)
    return f"""
        SELECT row_number() OVER (ORDER BY {order}) AS position, {columns}
        FROM (SELECT * FROM ({rows}) r ORDER BY {order} LIMIT {spec.limit} OFFSET {spec.offset})"""


def exists_rows(spec: SearchSpec, require_option: bool = True) -> str:
    by_option = f" AND {exists_option(spec)}" if require_option else ""
    return f"SELECT {API} FROM products p WHERE {product_where(spec)}{by_option}"


def join_rows(spec: SearchSpec) -> str:
    columns = ", ".join(f"p.{c}" for c in schemas.API_COLUMNS)
    return f"""SELECT DISTINCT {columns} FROM products p JOIN options o ON o.product_id = p.id
        WHERE {product_where(spec)} AND {option_where(spec)}"""


def signature_rows(spec: SearchSpec) -> str:
    parts = ["color", "size", "stock_status"]
    tests = " AND ".join(
        f"split_part(s, '|', {parts.index(c) + 1}) = '{v}'"
        for c, v in spec.option_filters.items()
    )
    by_option = (
        f" AND len(list_filter(p.option_signatures, lambda s: {tests})) > 0" if tests else ""
    )
    return f"SELECT {API} FROM signature_table p WHERE {product_where(spec)}{by_option}"


# ---- generated data ------------------------------------------------------------------------


def _case(value: str, table, result) -> str:
    branches = " ".join(f"WHEN {value} < {e[0]} THEN {result(e)}" for e in table[:-1])
    last = result(table[-1])
    return f"(CASE {branches} ELSE {last} END)" if branches else f"({last})"


def _in_block(base: int, size: int, step: str) -> str:
    return f"({base + 1} + ({step}) % {size})"


def generated_products(profile: str, ids: str, anchor: str) -> str:
    """Products of a skew profile for a relation with column ``id``."""
    p = gen.PROFILES[profile]
    hashes = ", ".join(
        f"(id * {a} + {c}) % {gen.MODULUS} AS h_{name}" for name, (a, c) in gen.HASHES.items()
    )
    hot_s, hot_c = p.hot_sellers, p.hot_categories
    if hot_s:
        seller = (
            f"CASE WHEN h_seller < {p.hot_seller_share} THEN {_in_block(0, hot_s, 'h_seller')} "
            f"ELSE {_in_block(hot_s, gen.SELLERS - hot_s, 'h_seller')} END"
        )
    else:
        seller = _in_block(0, gen.SELLERS, "id - 1")
    if hot_c:
        blocks = [(0, hot_c), (hot_c, gen.CATEGORIES - hot_c)]

        def near(own, other, first, stay):
            step = f"(seller_id - {first}) % {own[1]} + h_category % {stay[1]}"
            return (
                f"CASE WHEN h_category < {stay[0]} THEN {_in_block(*own, step)} "
                f"ELSE {_in_block(*other, 'h_category')} END"
            )

        category = (
            f"CASE WHEN seller_id <= {hot_s} THEN {near(*blocks, 1, p.stay_hot)} "
            f"ELSE {near(*blocks[::-1], hot_s + 1, p.stay_cold)} END"
        )
        local = "h_brand"
    else:
        cycle = f"((id - 1) // {gen.SELLERS})"
        category = _in_block(
            0, gen.CATEGORIES, f"(seller_id - 1) % {gen.CATEGORIES} + {cycle} % 3"
        )
        local = f"(seller_id + {cycle})"

    def brand_rule(entry):
        rule = entry[1]
        if isinstance(rule, gen.Head):
            return _in_block(rule.base, rule.count, "h_brand")
        step = f"(category_id - 1) * {gen.BRANDS_PER_CATEGORY} + {local} % {rule.count}"
        return _in_block(gen.LOCAL_BRAND_BASE, gen.LOCAL_BRANDS, step)

    brand = _case("h_brand", p.brand_cold, brand_rule)
    if hot_c:
        brand = (
            f"CASE WHEN category_id <= {hot_c} THEN {_case('h_brand', p.brand_hot, brand_rule)} "
            f"ELSE {brand} END"
        )

    def ranged(h, ranges):
        return _case(h, ranges, lambda r: f"{r[1]} + {h} % {r[2]}")

    at = f"TIMESTAMP '{anchor}'"
    created = (
        f"{at} - to_days(CAST({ranged('h_created', gen.CREATED_DAY_RANGES)} AS INTEGER)) "
        "- to_seconds(h_updated % 86400)"
    )
    touched = (
        "created_at + to_days(CAST(h_updated % 60 AS INTEGER)) "
        "+ to_seconds((h_updated // 60) % 86400)"
    )
    status = _case("h_status", p.status, lambda e: f"'{e[1]}'")
    return f"""
        SELECT id, seller_id, category_id, CAST({brand} AS BIGINT) AS brand_id,
               {status} AS status,
               CAST({ranged('h_price', gen.PRICE_RANGES)} AS INTEGER) AS price,
               CAST(h_rating % {gen.RATING_STEPS} AS DOUBLE) / 100 AS rating,
               CAST({ranged('h_review', gen.REVIEW_RANGES)} AS INTEGER) AS review_count,
               created_at, least({at}, {touched}) AS updated_at
        FROM (SELECT *, CAST({category} AS BIGINT) AS category_id, {created} AS created_at
              FROM (SELECT *, CAST({seller} AS BIGINT) AS seller_id
                    FROM (SELECT id, {hashes} FROM ({ids}))))"""


def generated_options(profile: str, ids: str) -> str:
    p = gen.PROFILES[profile]
    a, c = gen.FANOUT_HASH
    fanout = (
        _case(f"((id * {a} + {c}) % 100)", p.fanout, lambda e: str(e[1]))
        if p.fanout
        else "((id - 1) % 3 + 1)"
    )
    hashes = ", ".join(
        f"(id * {m} + n * {k}) % 100 AS h_{name}" for name, (m, k) in gen.OPTION_HASHES.items()
    )

    def value(name, table, domain):
        if table:
            return _case(f"h_{name}", table, lambda e: f"'{e[1]}'")
        return f"list_extract({_list(domain)}, CAST(h_{name} % {len(domain)} AS INTEGER) + 1)"

    return f"""
        SELECT id * 10 + n AS id, id AS product_id,
               {value('color', p.color, schemas.COLORS)} AS color,
               {value('size', p.size, schemas.SIZES)} AS size,
               {value('stock', p.stock, schemas.STOCK_STATUSES)} AS stock_status
        FROM (SELECT id, n, {hashes}
              FROM (SELECT id, unnest(range(1, {fanout} + 1)) AS n FROM ({ids})))"""
