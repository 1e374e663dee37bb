import json
import re

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from shelfline import schemas
from shelfline.functions.columns import iso_wall_clock
from shelfline.operators import readmodels, validate
from shelfline.sources import documents_json, latency_log, layout, tables
from shelfline.sources.snapshots import FAN, SnapshotStore

GOOD = {
    "productId": 1, "sellerId": "2", "categoryId": 3, "brandId": 4, "status": "ACTIVE",
    "price": 100, "rating": "4.35", "reviewCount": 7, "createdAt": "2026-05-02T12:00:00Z",
    "updatedAt": "2026-05-02T12:00:00+09:00", "sourceUpdatedAt": "2026-05-02T12:00:00",
    "documentRefreshedAt": "2026-05-02T12:00:00",
    "options": [
        {"color": "RED", "size": "M", "stockStatus": "IN_STOCK"},
        {"color": "BLUE", "size": "M", "stockStatus": "IN_STOCK"},
        {"color": "RED", "size": "M", "stockStatus": "IN_STOCK"},
    ],
}


def write_lines(tmp_path, *lines):
    path = tmp_path / "docs"
    path.mkdir()
    (path / "part.json").write_text(
        "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines)
    )
    return str(path)


def test_json_source_is_strict_about_fields_and_types(spark, tmp_path):
    without = {k: v for k, v in GOOD.items() if k != "brandId"}
    path = write_lines(
        tmp_path, GOOD, without, {**GOOD, "price": "cheap"}, '{"productId": 9,',
        {**GOOD, "updatedAt": "yesterday"}, {**GOOD, "weight": 3},
    )
    docs, rejects = documents_json.read_documents(spark, path)
    row = docs.first()
    assert docs.count() == 2
    assert (row.seller_id, str(row.rating), row.price) == (2, "4.35", 100)
    assert row.created_at == row.updated_at  # offsets are dropped, not converted
    assert [(x.color, x.copies) for x in row.options] == [("RED", 2), ("BLUE", 1)]
    reasons = sorted(r.reason for r in rejects.collect())
    assert reasons == [
        "malformed json", "malformed value: price", "malformed value: updatedAt",
        "missing required field: brandId",
    ]
    assert [r.field for r in documents_json.strict_fields(spark, path).collect()] == ["weight"]


def test_a_document_with_very_many_options_is_written_whole(spark, tmp_path):
    p = fx.products(spark, [(1, "ACTIVE", 1, 1, fx.T0), (2, "ACTIVE", 1, 1, fx.T0)])
    many = 10_005
    o = spark.range(many).select(
        "id", F.lit(1).cast("long").alias("product_id"),
        F.when(F.col("id") < 7, "RED").otherwise("BLUE").alias("color"),
        F.lit("M").alias("size"), F.lit("IN_STOCK").alias("stock_status"),
    ).unionByName(fx.options(spark, [(-1, 2, "RED", "M", "IN_STOCK")]))
    docs = readmodels.documents(p, o, F.lit(fx.T0).cast("timestamp_ntz"))
    path = str(tmp_path / "docs")
    documents_json.write_documents(docs, path, counted=True)
    text = [r.value for r in spark.read.text(path).orderBy(F.length("value").desc()).collect()]
    assert len(text[0]) < 1_000 and "copies" in text[1]
    documents_json.write_documents(docs, str(tmp_path / "listed"))
    listed, _ = documents_json.read_documents(spark, str(tmp_path / "listed"))
    assert listed.where("id = 1").first().options[1].copies == many - 7
    back, _ = documents_json.read_documents(spark, path)
    first = back.where("id = 1").first()
    assert [(x.color, x.copies) for x in first.options] == [("RED", 7), ("BLUE", many - 7)]
    assert back.where("id = 2").first().options[0].copies == 1


def test_iso_times(spark):
    df = spark.createDataFrame(
        [("2026-05-02T12:00:00Z",), ("2026-05-02T12:00:00-11:00",), ("2026-05-02T12:00:00",)],
        "t string",
    )
    assert {str(r[0]) for r in df.select(iso_wall_clock(F.col("t"))).collect()} == {
        "2026-05-02 12:00:00"
    }


def test_bulk_files_keep_pairs_together_in_id_order(spark, tmp_path):
    p = fx.products(spark, [(i, "ACTIVE", 1, 1, fx.T0) for i in range(1, 40)])
    o = fx.options(
        spark, [(10 * i, i, "RED", "M", "IN_STOCK") for i in range(1, 40, 2)]
    )
    path = str(tmp_path / "bulk")
    docs = readmodels.documents(p, o, F.lit(fx.T0).cast("timestamp_ntz"))
    documents_json.write_bulk(docs, path)
    seen = []
    for f in sorted((tmp_path / "bulk").glob("part-*")):
        lines = f.read_text().splitlines()
        for action, source in zip(lines[::2], lines[1::2]):
            assert json.loads(action)["index"]["_id"] == json.loads(source)["productId"]
            seen.append(json.loads(source))
    assert [d["productId"] for d in seen] == list(range(1, 40))
    assert seen[0]["options"] == [{"color": "RED", "size": "M", "stockStatus": "IN_STOCK"}]
    assert seen[1]["options"] == [] and set(seen[1]) == set(GOOD)


def test_profiles(spark, tmp_path):
    assert tables.resolve_profile("products_uniform").name == "uniform"
    assert tables.resolve_profile(
        "high-skew", "product_options_high_skew"
    ).products_table == "products_high_skew"
    for bad in ("products; DROP TABLE x", "products", "1abc", ""):
        with pytest.raises(ValueError):
            tables.resolve_profile(bad)
    with pytest.raises(ValueError):
        tables.resolve_profile("products_uniform", "product_options_high_skew")
    for name, price in (("uniform", 1), ("high-skew", 2)):
        table = tables.resolve_profile(name).products_table
        fx.products(spark, [(1, "ACTIVE", price, 1, fx.T0)]).write.parquet(str(tmp_path / table))
        tables.set_active(spark, str(tmp_path), name)
        assert spark.table(tables.ACTIVE_VIEW).first().price == price


def test_outbox_payload(spark):
    out = fx.events(
        spark,
        [(1, 1, "PRODUCT_STATUS_CHANGED",
          {"payload": '{"productId": 1, "newStatus": "DELETED", "changedFields": ["a", "b"]}'})],
    )
    event = tables.with_payload(out).first().event
    assert (event.productId, event.newStatus, event.tombstone) == (1, "DELETED", None)
    assert event.changedFields == ["a", "b"]


def test_rules_find_violations(spark):
    out = fx.events(
        spark,
        [(1, 1, "PRODUCT_UPDATED", {"status": "DONE"}), (2, 1, "PRODUCT_LOST"),
         (3, 1, "PRODUCT_UPDATED", {"retry_count": -1})],
    )
    found = validate.rule_violations(out, schemas.outbox_rules(), "outbox").where("violations > 0")
    assert {r.rule: r.violations for r in found.collect()} == {
        "finished_has_processed_at": 1, "event_type_in_domain": 1, "retry_count_not_negative": 1
    }
    nulls = validate.null_violations(out, ["claim_token", "status"])
    assert {r.rule: r.violations for r in nulls.collect()} == {
        "claim_token_not_null": 3, "status_not_null": 0
    }


def test_latency_lines(spark, tmp_path):
    line = (
        "2026-05-11 INFO product_search_outbox_indexing_latency eventId=5 aggregateId=7 "
        "eventType=PRODUCT_UPDATED resultStatus=DONE queueWaitMs=-1 sourceDocumentLoadMs=3 "
        "openSearchWriteMs=4 outboxStateTransitionMs=x relayProcessingMs=9"
    )
    (tmp_path / "log.txt").write_text(f"noise\n{line}\n")
    rows = latency_log.read_latency_log(spark, str(tmp_path / "log.txt")).collect()
    assert len(rows) == 1
    assert (rows[0].event_id, rows[0].queue_wait_ms, rows[0].state_transition_ms) == (5, -1, None)


@pytest.fixture
def store(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, v string").schema
    return SnapshotStore(spark, str(tmp_path / "store"), schema, bucket_width=10)


def rows(spark, **pairs):
    data = [(int(k[1:].replace("m", "-")), v) for k, v in pairs.items()]
    return spark.createDataFrame(data, "id long, v string")


def content(df):
    return {r.id: r.v for r in df.collect()}


def test_store_upserts_deletes_and_rolls_back(spark, store):
    assert content(store.read()) == {}
    store.replace(rows(spark, k1="a", k5="b", km3="c", k25="d"))
    first = store.names()["read"]
    store.apply_changes(rows(spark, k5="B", k7="e"), rows(spark, km3="", k99="").select("id"))
    assert content(store.read()) == {1: "a", 5: "B", 7: "e", 25: "d"}
    untouched = [f for b, f in store._folders(store.names()["read"]).items() if b == 2]
    assert untouched == ["data/v000000001/bucket=2"]
    store.rollback()
    assert store.names()["read"] == first
    assert content(store.read()) == {1: "a", 5: "b", -3: "c", 25: "d"}
    assert content(store.refresh().read("current")) == content(store.read())


def test_store_switches_names_together(spark, store):
    store.replace(rows(spark, k1="v1"))
    second = store.replace(rows(spark, k2="v2"), "write")
    assert content(store.read()) == {1: "v1"}
    store.switch(second, "read", "current")
    assert content(store.read()) == {2: "v2"} == content(store.read("current"))
    store.rollback()
    assert content(store.read()) == {1: "v1"}
    store.view("search_view")
    assert spark.table("search_view").count() == 1


def test_store_ignores_data_of_a_crashed_change(spark, store):
    store.replace(rows(spark, k1="a"))
    store._write_buckets(rows(spark, k1="lost"), 2)  # written, never committed
    assert content(store.read()) == {1: "a"}
    store.apply_changes(rows(spark, k2="b"), None, batch="b1")
    assert content(store.read()) == {1: "a", 2: "b"}
    assert store.apply_changes(rows(spark, k2="again"), None, batch="b1") is None
    assert content(store.refresh().read()) == {1: "a", 2: "b"}


def test_changes_cost_what_they_bring(spark, tmp_path):
    """Rows written follow the batches, not the buckets; content equals that of a plain dict."""
    schema = spark.createDataFrame([], "id long, v string").schema
    store = SnapshotStore(spark, str(tmp_path / "store"), schema, bucket_width=1_000, closed=F.col("v") == "done")
    store.replace(spark.range(2_000).select("id", F.lit("old").alias("v")))
    want, brought = dict.fromkeys(range(2_000), "old"), 0
    for n in range(FAN + 2):
        up = {n: "done", 1_000 + n: f"n{n}", 7: f"again{n}"} if n % 2 else {n: "done", 5_000: f"b{n}"}
        gone = [1_500 + n, 5_000] if n == 3 else [1_500 + n]
        keys = spark.createDataFrame([(i,) for i in gone], "id long")
        store.apply_changes(spark.createDataFrame(list(up.items()), "id long, v string"), keys)
        want = {k: v for k, v in {**want, **up}.items() if k not in gone or k in up}
        brought += len(up) + len(gone)
        assert content(store.read()) == want
    assert content(store.refresh().read(closed=True)) == {k: v for k, v in want.items() if v == "done"}
    assert content(store.read(closed=False)) == {k: v for k, v in want.items() if v != "done"}
    version = store._version(store.names()["read"])
    assert {h["folder"].split("/")[1] for h in version.base.values()} == {"v000000001"}
    assert [c["level"] for c in version.changes] == [1, 0, 0]
    written = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "store" / "changes")).count()
    assert brought < written <= 2 * brought
    files = store.read(closed=False).inputFiles()
    assert not any("closed=true" in f for f in files)
    store.apply_changes(spark.range(400).select("id", F.lit("many").alias("v")), None)
    want.update(dict.fromkeys(range(400), "many"))
    assert content(store.read()) == want and len(store._version(store.names()["read"]).changes) == 4
    store.apply_changes(spark.range(400, 700).select("id", F.lit("more").alias("v")), None)
    want.update(dict.fromkeys(range(400, 700), "more"))
    assert content(store.read()) == want and not store._version(store.names()["read"]).changes
    store.clean_up(0)
    assert content(store.refresh().read()) == want and not any(f.startswith("changes") for f in store.folders())


def test_emptied_bucket_disappears(spark, store):
    store.replace(rows(spark, k1="a", k11="b"))
    store.apply_changes(None, rows(spark, k11="").select("id"))
    assert content(store.read()) == {1: "a"}
    store.apply_changes(None, rows(spark, k1="").select("id"))
    assert content(store.read()) == {}


def test_layouts_and_bucketed_join(spark, tmp_path):
    o = fx.options(spark, [(i, i % 7, "RED", "M", "IN_STOCK") for i in range(50)])
    for name in ("option_filter_first", "join_key_first"):
        path = str(tmp_path / name)
        layout.write_layout(o, layout.LAYOUTS[name], path, files=3)
        assert spark.read.parquet(path).count() == 50
    p = fx.products(spark, [(i, "ACTIVE", 1, 1, fx.T0) for i in range(50)])
    path = str(tmp_path / "active")
    layout.write_layout(p, layout.LAYOUTS["active_latest"], path)
    assert spark.read.parquet(path).count() == 50
    progress = layout.chunk_progress(p, 20, 50).orderBy("chunk_no").collect()
    assert [r.inserted_so_far for r in progress] == [1, 21, 41, 50]


def test_store_rolls_back_step_by_step_and_replays(spark, store):
    store.replace(rows(spark, k1="a"))
    for batch, row in (("b2", {"k2": "b"}), ("b3", {"k3": "c"})):
        store.apply_changes(rows(spark, **row), None, batch=batch)
    store.rollback()
    assert content(store.read()) == {1: "a", 2: "b"}
    store.rollback()
    assert content(store.read()) == {1: "a"}
    assert not store.refresh().applied("b2") and not store.applied("b3")
    assert store.apply_changes(rows(spark, k2="again"), None, batch="b2") is not None
    assert content(store.read()) == {1: "a", 2: "again"}
    assert store.apply_changes(rows(spark, k2="once more"), None, batch="b2") is None
    store.rollback()
    assert content(store.read()) == {1: "a"}
    with pytest.raises(ValueError):
        store.rollback()


def test_listed_options_keep_their_order_and_repeats(spark, tmp_path):
    p = fx.products(spark, [(1, "ACTIVE", 1, 1, fx.T0)])
    o = fx.options(
        spark,
        [(3, 1, "RED", "M", "IN_STOCK"), (1, 1, "RED", "M", "IN_STOCK"), (2, 1, "BLACK", "M", "IN_STOCK")],
    )
    docs = readmodels.documents(p, o, F.lit(fx.T0).cast("timestamp_ntz"), listed=True)
    assert [x.color for x in docs.first().options] == ["RED", "BLACK", "RED"]
    documents_json.write_documents(docs, str(tmp_path / "d"))
    line = spark.read.text(str(tmp_path / "d")).select(F.get_json_object("value", "$.options[*].color").alias("c"))
    assert line.first().c == '["RED","BLACK","RED"]'


def test_counted_signatures_follow_option_changes(spark, tmp_path):
    now = F.lit(fx.T0).cast("timestamp_ntz")
    p = fx.products(spark, [(i, "ACTIVE", 1, 1, fx.T0) for i in (1, 2, 3, 4)])
    red, blue = ("RED", "M", "IN_STOCK"), ("BLUE", "M", "IN_STOCK")
    steps = [
        [(1, 1, *red), (2, 1, *red), (3, 2, *red), (4, 3, None, *red[1:]), (5, 9, *red)],
        [(2, 1, *red), (3, 2, *red), (6, 2, *blue), (7, 3, *blue), (5, 9, *red)],  # one repeat goes
        [(6, 2, *blue), (7, 3, *blue), (8, 3, *blue), (9, 4, *red)],  # last rows go, one comes anew
        [],
    ]
    shape = "id long, product_id long, color string, size string, stock_status string"
    frames = [spark.createDataFrame(s, shape) for s in steps]
    full = readmodels.counted_signature_table(p, frames[0], now)
    store = SnapshotStore(spark, str(tmp_path / "s"), full.schema, "product_id", 2)
    store.replace(full)
    for number, (old, new) in enumerate(zip(frames, frames[1:])):
        deltas = readmodels.option_deltas(old, new)
        for again in range(2):
            version = readmodels.refresh_signatures(store, p, deltas, now, f"b{number}")
            assert (version is None) == bool(again)
        want = readmodels.signature_table(p, new, now)
        got = store.read()
        assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())
        copies = {(r.product_id, s): n for r in got.collect() for s, n in zip(r.option_signatures, r.copies)}
        rows = new.where("product_id < 9 AND color IS NOT NULL").collect()
        assert sum(copies.values()) == len(rows)
    with pytest.raises(Exception, match="more options removed than stored: product 1"):
        lost = readmodels.option_deltas(fx.options(spark, [(1, 1, *red)]), fx.options(spark, []))
        readmodels.refresh_signatures(store, p, lost, now, "wrong")


def test_signature_changes_of_many_products_rewrite_the_table_once(spark, tmp_path):
    now = F.lit(fx.T0).cast("timestamp_ntz")
    p = fx.products(spark, [(i, "ACTIVE", 1, 1, fx.T0) for i in range(1, 41)])
    red, pink = ("RED", "M", "IN_STOCK"), ("PINK", "M", "IN_STOCK")
    old = fx.options(spark, [(i, i, *red) for i in range(1, 41)] + [(90, 99, *red)])
    many = fx.options(spark, [(i, i, *(pink if i % 2 else red)) for i in range(1, 41)] + [(90, 1, *pink)])
    few = many.where("id <> 2")
    schema = readmodels.counted_signature_table(p, old, now).schema
    store = SnapshotStore(spark, str(tmp_path / "s"), schema, "product_id", 8)
    readmodels.rebuild_signatures(store, p, old, now)
    for name, a, b in (("many", old, many), ("few", many, few)):
        assert readmodels.refresh_signatures(store, p, readmodels.option_deltas(a, b), now, name)
        assert readmodels.refresh_signatures(store, p, readmodels.option_deltas(a, b), now, name) is None
        want = readmodels.counted_signature_table(p, b, now)
        assert store.read().dtypes == want.dtypes
        assert sorted(store.read().collect()) == sorted(want.collect())
        changes = [f for f in store.folders() if f.startswith("changes/")]
        assert len(changes) == (name == "few")
    assert {r.product_id: r.copies for r in store.read().collect()}[1] == [2]


def test_a_rewrite_works_out_signatures_once_a_product(spark, tmp_path):
    now = F.lit(fx.T0).cast("timestamp_ntz")
    p = fx.products(spark, [(i, "ACTIVE", 1, 1, fx.T0) for i in range(1, 9)])
    # Two triples with one signature, an unknown product, a missing part.
    rows = [(1, 1, "A|B", "M", "X"), (2, 1, "A", "B|M", "X"), (3, 2, "RED", "M", "IN_STOCK"), (4, 99, "RED", "M", "X"), (5, 3, "RED", None, "X")]
    options = spark.createDataFrame(rows, "id long, product_id long, color string, size string, stock_status string")
    deltas = readmodels.option_deltas(options.limit(0), options)
    assert {(r.product_id, r.other, r.change) for r in deltas.collect()} == {(1, "A|B|M|X", 2), (2, None, 1), (99, "RED|M|X", 1)}
    stored = readmodels.counted_signature_table(p, options.where("id = 3"), now)
    whole = readmodels._whole_table(stored, p, deltas, now, F.col("product_id") % 2)
    filters = re.findall(r"Filter .*", whole._jdf.queryExecution().optimizedPlan().toString())
    assert filters and not any("lambda" in f for f in filters)
    assert {r.product_id: (r.option_signatures, r.copies) for r in whole.collect()} == {1: (["A|B|M|X"], [2]), 2: (["RED|M|IN_STOCK"], [2])}


def test_a_large_table_takes_wider_buckets_and_stays_changeable(spark, tmp_path):
    rows = spark.range(-500, 9_500).select("id", (F.col("id") * 2).alias("v"))
    store = SnapshotStore(spark, str(tmp_path / "s"), rows.schema, bucket_width=10, most_buckets=16)
    store.replace(rows, keys=rows.select("id"))
    assert len(store.folders()) <= 17
    store.apply_changes(rows.where("id % 1000 = 0").withColumn("v", F.lit(1).cast("long")), rows.select("id").where("id = 7"))
    store.apply_changes(None, spark.range(8, 10))
    fresh = SnapshotStore(spark, str(tmp_path / "s"), rows.schema, bucket_width=10, most_buckets=16)
    fresh.apply_changes(rows.where("id = -500").withColumn("v", F.lit(3).cast("long")), None, compact=True)
    want = {i: i * 2 for i in range(-500, 9_500) if i not in (7, 8, 9)} | {i: 1 for i in range(0, 9_500, 1_000)} | {-500: 3}
    assert {r.id: r.v for r in fresh.read().collect()} == want
    empty = SnapshotStore(spark, str(tmp_path / "e"), rows.schema, bucket_width=10, most_buckets=16)
    empty.apply_changes(rows, None)
    assert empty.read().count() == 10_000 and sum(f.startswith("data/") for f in empty.folders()) <= 17


def test_packed_options_keep_values_outside_the_domains(spark):
    rows = [(1, 1, "BLACK", "S", "IN_STOCK"), (2, 1, "PINK", "S", None), (3, 1, "BLACK", "S", "IN_STOCK"),
            (4, 1, None, None, None), (5, 1, "BEIGE", "FREE", "OUT_OF_STOCK"), (6, 1, "PINK", "S", None)]
    o = spark.createDataFrame(rows, "id long, product_id long, color string, size string, stock_status string")
    (got,) = readmodels.nested_options(o).collect()
    assert [tuple(e) for e in got.options] == [
        ("BLACK", "S", "IN_STOCK", 2), ("PINK", "S", None, 2), (None, None, None, 1), ("BEIGE", "FREE", "OUT_OF_STOCK", 1)]
    (listed,) = readmodels.nested_options(o, listed=True).collect()
    assert [tuple(e)[:3] for e in listed.options] == [r[2:] for r in rows]
