"""Registered queries on claims, pages, stores and streams where size, nulls or restarts matter."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfline import schemas
from shelfline.functions.quantiles import exact_quantiles
from shelfline.operators import outbox as ob
from shelfline.operators import paging, readmodels
from shelfline.operators.spec import SearchSpec
from shelfline.plans import check_sql as q
from shelfline.plans.outbox_queries import LEASE_MS, NOW, UPSERT_SQL, old_store, relay_source
from shelfline.plans.registry import add
from shelfline.plans.report_queries import flat_documents, restocked
from shelfline.plans.search_queries import refreshed_at
from shelfline.session import shared_dir
from shelfline.sources import documents_json
from shelfline.sources import star_schema as star
from shelfline.sources import tables as model
from shelfline.streaming import relay

#: More than any single top-k takes.
LARGE_CLAIM = 12_345


def _claim_large(spark, sf):
    """A claim from one creation event per product, cut by counting."""
    products = star.products(spark, sf)
    events = ob.capture_events(products.limit(0), products, F.lit(NOW), first_id=1)
    claimed = ob.claim(events, F.lit(NOW), LARGE_CLAIM, token="large", worker="w")
    return claimed.select("id", "aggregate_id", "status", "claim_token", "claimed_by")


add(
    "claim_large_batch",
    _claim_large,
    q.with_relations(
        f"""SELECT id * 4 + 1 AS id, id AS aggregate_id, 'PROCESSING' AS status,
                   'large' AS claim_token, 'w' AS claimed_by
            FROM products ORDER BY 1 LIMIT {LARGE_CLAIM}""",
        "products",
    ),
)

_NULLS = {
    "early": SearchSpec(sort="priceAsc", limit=50, offset=1_000),
    "ascending": SearchSpec(sort="priceAsc", limit=50, offset=12_000),
    "descending": SearchSpec(sort="priceDesc", limit=50, offset=12_000),
    "within_nulls": SearchSpec(sort="priceDesc", limit=50, offset=14_000),
}

def _null_pages(spark, sf):
    """Pages of products some of which have no price, on both sides of the top-k limit."""
    rows = star.products(spark, sf).select(
        "id", F.when(F.col("id") % 7 != 0, F.col("price")).alias("price")
    )
    found = None
    for name, spec in _NULLS.items():
        one = paging.with_position(paging.page(rows, spec), spec)
        one = one.select(F.lit(name).alias("page"), "position", "id", "price")
        found = one if found is None else found.unionAll(one)
    return found


def _null_page_sql(name: str, spec: SearchSpec) -> str:
    order = "price ASC NULLS FIRST, id" if spec.sort == "priceAsc" else "price DESC NULLS LAST, id DESC"
    return f"""SELECT '{name}' AS page, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS position, id, price
               FROM (SELECT * FROM priced ORDER BY {order} LIMIT {spec.limit} OFFSET {spec.offset})"""


add(
    "deep_page_null_keys",
    _null_pages,
    q.with_relations(
        " UNION ALL ".join(f"SELECT * FROM ({_null_page_sql(n, s)})" for n, s in _NULLS.items()),
        "products",
        priced="SELECT id, CASE WHEN id % 7 <> 0 THEN price END AS price FROM products",
    ),
)


def _streamed(spark, sf, store, **more):
    raw = relay.outbox_stream(
        spark, sf, star.table(spark, sf, "events").schema, glob="events.parquet"
    )
    query = relay.start_relay(
        star.outbox_from_events(raw),
        relay_source(spark, sf),
        store,
        shared_dir(spark, "relay-checkpoint"),
        lambda: NOW,
        **more,
    )
    query.awaitTermination()


def _replayed(spark, sf):
    """A stream's change rolled back and streamed anew with a checkpoint of its own."""
    store = old_store(spark, sf)
    _streamed(spark, sf, store)
    store.rollback()
    _streamed(spark, sf, store)
    return flat_documents(store.read())


add("stream_replay_after_rollback", _replayed, UPSERT_SQL)

_CONFIG = ob.RelayConfig(enabled=True, max_retry_count=3, processing_timeout_ms=86_400_000)


def _stream_outbox(spark, sf):
    """Events finished in the outbox by the stream; documents of every fifth product are refused."""
    out = star.outbox(spark, sf)
    events = relay.outbox_store(spark, shared_dir(spark, "outbox"), out, 4_000)
    events.replace(out)
    _streamed(
        spark, sf, old_store(spark, sf), outbox=events, config=_CONFIG, reject=F.col("id") % 5 == 0
    )
    return events.read().groupBy("status", "retry_count").agg(F.count("*").alias("events"))


add(
    "stream_outbox_status",
    _stream_outbox,
    q.with_relations(
        f"""SELECT CASE WHEN NOT taken THEN status WHEN NOT refused THEN 'DONE'
                        WHEN retry_count + 1 >= 3 THEN 'FAILED' ELSE 'PENDING' END AS status,
                   CAST(CASE WHEN taken AND refused THEN retry_count + 1 ELSE retry_count END AS INTEGER)
                       AS retry_count, count(*) AS events
            FROM judged GROUP BY ALL""",
        "outbox",
        "products",
        judged=f"""SELECT o.*, coalesce(p.status <> 'DELETED' AND p.id % 5 = 0, FALSE) AS refused,
                          (o.status = 'PENDING' AND (o.next_retry_at IS NULL OR o.next_retry_at <= TIMESTAMP '{NOW}'))
                          OR (o.status = 'PROCESSING' AND o.updated_at <= TIMESTAMP '{NOW}' - INTERVAL 1 DAY) AS taken
                   FROM outbox o LEFT JOIN products p ON p.id = o.aggregate_id""",
    ),
)


def _json_options(spark, sf):
    """Documents written with every option row in order, read back as plain JSON."""
    docs = readmodels.documents(
        star.products(spark, sf), star.option_rows(spark, sf), refreshed_at(), listed=True
    )
    path = shared_dir(spark, "documents-listed")
    documents_json.write_documents(docs, path)
    shape = "productId long, options array<struct<color string, size string, stockStatus string>>"
    found = spark.read.schema(shape).json(path)
    entry = F.transform("options", lambda o: F.concat_ws("/", o["color"], o["size"], o["stockStatus"]))
    return found.select(
        F.col("productId").alias("id"),
        F.array_join(entry, ",").alias("options_text"),
        F.size("options").alias("option_count"),
    )


add(
    "documents_json_options",
    _json_options,
    q.with_relations(
        """SELECT p.id, coalesce(string_agg(color || '/' || size || '/' || stock_status, ','
                      ORDER BY line, part, supp), '') AS options_text,
                  CAST(count(color) AS INTEGER) AS option_count
           FROM products p LEFT JOIN option_rows o ON o.product_id = p.id GROUP BY p.id""",
        "products",
        "option_rows",
    ),
)

#: So far from zero, all values share one bucket of the first histogram.
_FAR = 1_700_000_000_000


def _narrow_quantiles(spark, sf):
    """Quantiles of event ids far from zero, per type of event."""
    events = star.outbox(spark, sf)
    rows = events.select((F.col("id") + _FAR).alias("v"), "event_type")
    found = exact_quantiles(rows, "v", {"p05": 0.05, "p50": 0.5, "p99": 0.99}, ["event_type"])
    near = [F.round(F.col(c) - _FAR, 2).alias(c) for c in ("p05", "p50", "p99", "max")]
    return found.select("event_type", "n", *near)


add(
    "quantiles_narrow_range",
    _narrow_quantiles,
    q.with_relations(
        """SELECT event_type, count(*) AS n, round(quantile_cont(CAST(id AS DOUBLE), 0.05), 2) AS p05,
                  round(quantile_cont(CAST(id AS DOUBLE), 0.5), 2) AS p50,
                  round(quantile_cont(CAST(id AS DOUBLE), 0.99), 2) AS p99,
                  CAST(max(id) AS DOUBLE) AS max FROM outbox GROUP BY event_type""",
        "outbox",
    ),
)


def _captured_options(spark, sf):
    """Options whose stock, or every seventh of which the product, has changed."""
    new = star.option_rows(spark, sf)
    owner = F.when(F.col("id.l_linenumber") == 7, F.col("product_id") + 1)
    old = restocked(new).withColumn("product_id", F.coalesce(owner, "product_id"))
    events = ob.capture_option_events(old, new, F.lit(NOW), first_id=1)
    payload = F.from_json("payload", "productId long, addedOptions long, removedOptions long")
    return events.withColumn("e", payload).select("id", "aggregate_id", "event_type", "status", "e.*")


add(
    "capture_option_events",
    _captured_options,
    q.with_relations(
        """SELECT product_id * 4 + 1 AS id, product_id AS aggregate_id,
                  'PRODUCT_OPTION_CHANGED' AS event_type, 'PENDING' AS status,
                  product_id AS "productId",
                  CAST(sum(greatest(w, 0)) AS BIGINT) AS "addedOptions",
                  CAST(sum(greatest(-w, 0)) AS BIGINT) AS "removedOptions"
           FROM (SELECT product_id, color, size, stock_status, sum(w) AS w FROM (
                   SELECT product_id, color, size, stock_status, 1 AS w FROM option_rows
                   UNION ALL
                   SELECT CASE WHEN line = 7 THEN product_id + 1 ELSE product_id END, color, size,
                          CASE stock_status WHEN 'OUT_OF_STOCK' THEN 'IN_STOCK' ELSE stock_status END, -1
                   FROM option_rows) GROUP BY ALL)
           WHERE w <> 0 GROUP BY product_id""",
        "option_rows",
    ),
)


def _resumed(spark, sf):
    """Every event delivered twice: half of the files a batch, then all again after a restart.

    The second run goes on from the checkpoint of the first, so it takes the new files alone.
    """
    events, folder = star.table(spark, sf, "events"), shared_dir(spark, "event-files")
    store, checkpoint = old_store(spark, sf), shared_dir(spark, "relay-checkpoint")
    for parts in (["event_id % 2 = 0", "event_id % 2 = 1"], ["true"]):
        for part in parts:
            events.where(part).write.mode("append").parquet(folder)
        files = len(spark.read.schema(events.schema).parquet(folder).inputFiles())
        raw = relay.outbox_stream(spark, folder, events.schema, max_files=-(-files // 2))
        query = relay.start_relay(
            star.outbox_from_events(raw), relay_source(spark, sf), store, checkpoint, lambda: NOW
        )
        query.awaitTermination()
    return flat_documents(store.read())


add("stream_resume_redelivered", _resumed, UPSERT_SQL)


def _claim_tokens(spark, sf):
    """Two workers claim one after the other, each batch under a random token of its own."""
    out = star.outbox(spark, sf)
    first = ob.claim(out, F.lit(NOW), LARGE_CLAIM, LEASE_MS, worker="a")
    rest = ob.merge_changes(out, first)
    second = ob.claim(rest, F.lit(NOW), LARGE_CLAIM, LEASE_MS, worker="b")
    both = first.unionByName(second)
    return both.groupBy("claimed_by").agg(
        F.count(F.lit(1)).alias("events"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
        F.count_distinct("claim_token").alias("tokens"),
        F.max(F.length("claim_token")).alias("token_length"),
    )


add(
    "claim_tokens",
    _claim_tokens,
    q.with_relations(
        f"""SELECT CASE WHEN place <= {LARGE_CLAIM} THEN 'a' ELSE 'b' END AS claimed_by,
                   count(*) AS events, min(id) AS first_id, max(id) AS last_id,
                   CAST(1 AS BIGINT) AS tokens, CAST(36 AS INTEGER) AS token_length
            FROM (SELECT id, row_number() OVER (ORDER BY id) AS place FROM outbox
                  WHERE (status = 'PENDING' AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '{NOW}'))
                     OR (status = 'PROCESSING'
                         AND updated_at <= TIMESTAMP '{NOW}' - to_milliseconds({LEASE_MS})))
            WHERE place <= 2 * {LARGE_CLAIM} GROUP BY ALL""",
        "outbox",
    ),
)

#: What the tables of each profile hold here.
_PROFILE_ROWS = {"uniform": "ACTIVE", "moderate-skew": "SOLD_OUT", "high-skew": "DELETED"}


def _active_profiles(spark, sf):
    """The active view pointed at the tables of one profile after the other."""
    root = shared_dir(spark, "profiles")
    kinds = {f.name: f.dataType for f in schemas.PRODUCTS.fields}
    every = star.products(spark, sf)
    every = every.select(*[F.col(n).cast(kind).alias(n) for n, kind in kinds.items()])
    names = model.inline(spark, list(_PROFILE_ROWS.items()), "profile string, status string")
    options = star.options(spark, sf).withColumn("id", F.xxhash64("product_id"))
    # The options move once for all profiles; each profile's table is then written from its own part.
    owners = every.select(F.col("id").alias("product_id"), F.col("status").alias("of"))
    staged = options.join(owners, "product_id").select(*schemas.OPTIONS.names, "of")
    staged.write.partitionBy("of").parquet(f"{root}/staged")
    staged = spark.read.schema(staged.schema).parquet(f"{root}/staged")
    found = None
    for name, status in _PROFILE_ROWS.items():
        profile = model.resolve_profile(name)
        every.where(F.col("status") == status).write.parquet(f"{root}/{profile.products_table}")
        own = staged.where(F.col("of") == status).select(*schemas.OPTIONS.names)
        own.write.parquet(f"{root}/{profile.options_table}")
        model.set_active(spark, root, profile.products_table)
        _, profile_options = model.load_profile(spark, root, name)
        sides = [
            spark.table(model.ACTIVE_VIEW).select(F.lit(1).alias("p"), F.lit(0).alias("o"), "price"),
            profile_options.select(F.lit(0), F.lit(1), F.lit(0)),
        ]
        counts = sides[0].unionAll(sides[1]).select(F.lit(name).alias("profile"), "*")
        found = counts if found is None else found.unionAll(counts)
    found = found.groupBy("profile").agg(
        F.sum("p").alias("products"), F.sum("o").alias("options"), F.sum("price").alias("total_price")
    )
    return names.join(found, "profile")


add(
    "active_profiles",
    _active_profiles,
    q.with_relations(
        """SELECT CASE p.status WHEN 'ACTIVE' THEN 'uniform' WHEN 'SOLD_OUT' THEN 'moderate-skew'
                  ELSE 'high-skew' END AS profile, p.status, count(*) AS products,
                  CAST(sum(price) AS BIGINT) AS total_price, CAST(sum(n) AS BIGINT) AS options
           FROM products p LEFT JOIN (SELECT product_id, count(*) AS n FROM options GROUP BY ALL) o
             ON o.product_id = p.id
           GROUP BY ALL""",
        "products",
        "options",
    ),
)
