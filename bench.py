"""Benchmark: prints one JSON line.

Default: the star-schema tables in $BENCH_SF_DIR on local[$BENCH_CPUS]. With
``--published-scale N`` the data are N generated products of the moderate-skew profile, the
Products and compacted options are bucketed by product id, the read models range-partitioned by
category; all build times are part of the result.
"""

from __future__ import annotations

import argparse
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from shelfline.functions.quantiles import exact_quantiles  # noqa: E402
from shelfline.operators import distribution, lag, paging, readmodels, search  # noqa: E402
from shelfline.operators import outbox as ob  # noqa: E402
from shelfline.operators.spec import SearchSpec  # noqa: E402
from shelfline.plans import search_queries as sq  # noqa: E402
from shelfline.session import local_session  # noqa: E402
from shelfline.sources import generator, layout  # noqa: E402
from shelfline.sources import star_schema as star  # noqa: E402
from shelfline.streaming import relay  # noqa: E402

NOW = "2024-02-01 00:00:00"
REPEATS = 3
BUCKETS = 16


def drained(df):
    df.write.format("noop").mode("overwrite").save()


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def published_specs():
    """The scenarios of the published runs."""
    base = SearchSpec(category_id=35, status="ACTIVE", min_price=10_000, max_price=100_000)
    triple = {"color": "BLACK", "size": "M", "stock_status": "IN_STOCK"}
    b1 = SearchSpec(
        category_id=75, brand_id=943, status="ACTIVE", min_price=10_000, max_price=100_000,
        **triple, sort="reviewCountDesc", offset=100,
    )
    single = {
        "q1": base.at(offset=100),
        "q2": base.at(brand_id=543, sort="priceAsc", offset=100),
        "q3": SearchSpec(category_id=35, status="ACTIVE", sort="reviewCountDesc", offset=100),
        "q4": base.at(offset=10_000),
        "q5": SearchSpec(status="ACTIVE", offset=100),
        "q6": SearchSpec(min_price=10_000, max_price=100_000, sort="priceAsc", offset=100),
    }
    joins = {
        "j1": base.at(**triple, offset=100),
        "j2": base.at(brand_id=543, **triple, sort="priceAsc", offset=100),
        "j3": single["q3"].at(**triple),
        "j4": base.at(**triple, offset=10_000),
        "j5": SearchSpec(status="ACTIVE", **triple, offset=100),
    }
    sets = {
        "b1": b1,
        "b2": SearchSpec(status="ACTIVE", **triple, offset=100),
        "b3": b1.at(offset=10_000),
    }
    return single, joins, sets, {"q4": single["q4"]}


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("--published-scale", type=int, default=0)
    args.add_argument("--profile", default="moderate-skew")
    options_ = args.parse_args()
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(cpus, "shelfline-bench", "12g")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    times: dict[str, float] = {}
    rates: dict[str, float] = {}

    if options_.published_scale:
        n = options_.published_scale
        products = generator.gen_products(
            generator.product_ids(spark, n), options_.profile, "2026-05-01 00:00:00"
        )
        options = generator.gen_options(products, options_.profile)
        single, joins, sets, keyset = published_specs()
    else:
        products, options = star.products(spark, sf_dir), star.options(spark, sf_dir)
        single, joins, sets, keyset = (
            sq.SINGLE_TABLE_SET, sq.JOIN_SET, sq.BENCHMARK_SET, {"q4": sq.SINGLE_TABLE_SET["q4"]}
        )

    def stored(name, df):
        path = f"{root}/{name}"
        times[f"build_{name}"] = seconds(lambda: df.write.parquet(path))
        return spark.read.parquet(path)

    def bucketed(name, df, key):
        table = f"bench_{name}"
        times[f"build_{name}"] = seconds(
            lambda: layout.write_bucketed(df, key, BUCKETS, table, f"{root}/{name}")
        )
        return spark.table(table)

    products = bucketed("products", products, "id")
    raw_options = stored("raw_options", options)
    options = bucketed("options", readmodels.compact_options(raw_options), "product_id")
    at = F.lit(NOW).cast("timestamp_ntz")
    drained(products.limit(10))
    by_category = layout.Layout(("category_id", "brand_id", "id"))
    table = readmodels.signature_table(products, options, at).withColumnRenamed("product_id", "id")
    signatures = stored("signatures", layout.arranged(table, by_category)).withColumnRenamed(
        "id", "product_id"
    )
    docs = stored(
        "documents",
        layout.arranged(readmodels.documents(products, options, at), by_category),
    )
    rates["signature_rows_per_s"] = signatures.count() / times["build_signatures"]
    rates["document_rows_per_s"] = docs.count() / times["build_documents"]

    runs = {}
    for name, spec in single.items():
        rows = search.filtered(products, spec.product_predicates())
        runs[name] = lambda rows=rows, spec=spec: paging.page(rows, spec).collect()
    for name, spec in keyset.items():
        rows = search.filtered(products, spec.product_predicates())
        cursor = paging.derive_cursor(rows, spec, spec.offset)
        if cursor:
            runs[f"{name}_keyset"] = lambda rows=rows, spec=spec, c=cursor: paging.keyset_page(
                rows, spec, c
            ).collect()
    for name, spec in joins.items():
        runs[f"{name}_join_distinct"] = lambda spec=spec: search.search_join_distinct(
            products, options, spec
        ).collect()
        runs[f"{name}_exists"] = lambda spec=spec: search.search_exists(
            products, options, spec
        ).collect()
        runs[f"{name}_join_distinct_plain"] = lambda spec=spec: search.search_join_distinct(
            products, raw_options, spec
        ).collect()
    deep = SearchSpec(sort="reviewCountDesc", limit=50, offset=products.count() * 2 // 3)
    runs["deep_page"] = lambda: paging.page(products, deep).collect()
    runs["price_quantiles"] = lambda: exact_quantiles(
        products, "price", {"p50": 0.5, "p99": 0.99}
    ).collect()
    for name, spec in sets.items():
        runs[f"{name}_join_distinct"] = lambda spec=spec: search.search_join_distinct(
            products, options, spec
        ).collect()
        runs[f"{name}_exists"] = lambda spec=spec: search.search_exists(
            products, options, spec
        ).collect()
        runs[f"{name}_signatures"] = lambda spec=spec: search.search_signatures(
            signatures, spec
        ).collect()
        runs[f"{name}_nested"] = lambda spec=spec: paging.page(
            search.matches_documents(docs, spec), spec
        ).collect()
    runs["product_report"] = lambda: distribution.product_report(
        products, "2001-08-01 00:00:00"
    ).collect()
    runs["option_report"] = lambda: distribution.option_report(products, raw_options).collect()
    if not options_.published_scale:
        outbox = stored("outbox", star.outbox(spark, sf_dir))
        runs["lag_report"] = lambda: lag.lag_report(outbox, NOW).collect()
        runs["queue_wait"] = lambda: lag.queue_wait(outbox).collect()
    for name, run in runs.items():
        run()
        times[name] = statistics.median(seconds(run) for _ in range(REPEATS))

    if not options_.published_scale:
        events = relay.outbox_store(spark, f"{root}/outbox-store", outbox, 10_000)
        events.replace(outbox)
        store = relay.document_store(spark, f"{root}/document-store", products, 10_000)
        store.replace(docs)
        source = relay.Source(lambda: products, lambda: options)
        config = ob.RelayConfig(enabled=True, batch_size=4_000, max_drain_rounds=2)
        sizes: list[int] = []
        times["relay_drain"] = seconds(
            lambda: sizes.extend(relay.drain_outbox(events, store, source, NOW, config))
        )
        rates["relay_events_per_s"] = sum(sizes) / times["relay_drain"]
        rates["relay_events"] = sum(sizes)
        config = ob.RelayConfig(enabled=True, batch_size=100, max_drain_rounds=2)
        sizes = []
        times["relay_drain_100"] = seconds(
            lambda: sizes.extend(relay.drain_outbox(events, store, source, NOW, config))
        )
        rates["relay_events_per_s_100"] = sum(sizes) / times["relay_drain_100"]

    print(
        json.dumps(
            {
                "metric": "sum of query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in times.items()},
                "rates": {k: round(v, 1) for k, v in rates.items()},
                "sf": options_.published_scale or sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
