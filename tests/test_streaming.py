import datetime as dt

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from shelfline.operators import outbox as ob
from shelfline.operators import readmodels, search, validate
from shelfline.operators.compare import compare_documents, id_set_diff, stale_documents
from shelfline.operators.spec import SearchSpec
from shelfline.sources import star_schema as star
from shelfline.streaming import backfill as bf
from shelfline.streaming import relay

NOW = "2026-05-02 13:00:00"
CONFIG = ob.RelayConfig(enabled=True, batch_size=10, max_drain_rounds=5)


def at(text=NOW):
    return F.lit(text).cast("timestamp_ntz")


def ids(df):
    return [r.id for r in df.collect()]


def build(spark, root, p, o, out, docs=None, width=1_000):
    source = relay.Source(lambda: p, lambda: o)
    docs_store = relay.document_store(spark, str(root / "docs"), p, width)
    if docs is not None:
        docs_store.replace(docs)
    events = relay.outbox_store(spark, str(root / "outbox"), out, width)
    events.replace(out)
    return source, docs_store, events


def test_relay_failure_isolation_and_replay(spark, tmp_path):
    p = fx.products(
        spark,
        [(-18002001, "ACTIVE", 45900, 151, "2026-05-02 09:10:00"),
         (-18002002, "ACTIVE", 27900, 42, fx.T0),
         (-18002003, "ACTIVE", 19900, 9, fx.T0)],
    )
    o = fx.options(
        spark,
        [(1, -18002001, "BLACK", "S", "IN_STOCK"), (2, -18002001, "WHITE", "M", "IN_STOCK"),
         (3, -18002002, "BLUE", "FREE", "IN_STOCK"), (4, -18002003, "GRAY", "M", "LOW_STOCK")],
    )
    out = fx.events(
        spark,
        [(1, -18002001, "PRODUCT_CREATED"), (2, -18002001, "PRODUCT_UPDATED"),
         (3, -18002002, "PRODUCT_CREATED"), (4, -18002003, "PRODUCT_CREATED")],
    )
    source, docs, events = build(spark, tmp_path, p, o, out)
    config = ob.RelayConfig(enabled=True, batch_size=10, max_drain_rounds=5, max_retry_count=1)
    sizes = relay.drain_outbox(
        events, docs, source, NOW, config, reject=F.col("id") == -18002003
    )
    assert sizes == [4]
    got = {r.id: (r.status, r.retry_count) for r in events.read().collect()}
    assert got == {1: ("DONE", 0), 2: ("DONE", 0), 3: ("DONE", 0), 4: ("FAILED", 1)}
    assert sorted(ids(docs.read())) == [-18002002, -18002001]

    # the same events again: one equal document per product
    before = fx.frozen(docs.read())
    events.apply_changes(out.where("id <= 2"), None)
    assert relay.relay_batch(events, docs, source, NOW, CONFIG) == 2
    assert sorted(ids(docs.read())) == [-18002002, -18002001]
    assert compare_documents(before, docs.read()).count() == 0


def test_deleted_and_missing_products_leave_the_store(spark, tmp_path):
    p = fx.products(spark, [(1, "ACTIVE", 1, 1, fx.T0), (2, "DELETED", 1, 1, fx.T0)])
    everything = fx.products(spark, [(i, "ACTIVE", 1, 1, fx.T0) for i in (1, 2, 3)])
    o = fx.options(spark, [(1, 1, "BLACK", "M", "IN_STOCK")])
    out = fx.events(
        spark, [(i, i, "PRODUCT_UPDATED") for i in (1, 2, 3, 4)]
    )
    old = readmodels.documents(everything, o, at())
    source, docs, events = build(spark, tmp_path, p, o, out, old)
    assert relay.relay_batch(events, docs, source, NOW, CONFIG) == 4  # 4 never existed
    assert ids(docs.read()) == [1]
    assert relay.relay_batch(events, docs, source, NOW, CONFIG) == 0


def test_catch_up_after_backfill(spark, tmp_path):
    p0 = fx.products(spark, fx.CATCHUP_PRODUCTS)
    o0 = fx.options(spark, fx.CATCHUP_OPTIONS)
    source0, docs, _ = build(spark, tmp_path, p0, o0, fx.events(spark, [(1, 1, "PRODUCT_UPDATED")]))
    done = bf.backfill(spark, source0, docs, str(tmp_path / "cp"), "r", 2, NOW)
    assert (done.status, done.processed, done.batches) == ("COMPLETED", 4, 2)

    changed = fx.products(
        spark,
        [fx.CATCHUP_PRODUCTS[0],
         (-20002003, "DELETED", 20900, 22, "2026-05-02 12:22:00"),
         (-20002002, "ACTIVE", 34900, 120, "2026-05-02 12:20:00"),
         fx.CATCHUP_PRODUCTS[3],
         (-20002000, "ACTIVE", 25900, 222, "2026-05-02 12:21:00")],
    )
    options = fx.options(
        spark,
        [*fx.CATCHUP_OPTIONS, (-2000200001, -20002000, "BLACK", "S", "IN_STOCK"),
         (-2000200002, -20002000, "RED", "M", "LOW_STOCK")],
    )
    out = fx.events(
        spark,
        [(5, 1, "PRODUCT_UPDATED"), (6, -20002002, "PRODUCT_UPDATED"),
         (7, -20002000, "PRODUCT_CREATED"), (8, -20002003, "PRODUCT_STATUS_CHANGED")],
    )
    events = relay.outbox_store(spark, str(tmp_path / "outbox2"), out, 1_000)
    events.replace(out)
    source = relay.Source(lambda: changed, lambda: options)
    sizes = relay.catch_up(
        events, docs, source, NOW, 5, ob.RelayConfig(enabled=True, batch_size=2)
    )
    assert sizes == [2, 1]
    assert events.read().where("status = 'PENDING'").count() == 1  # at the watermark

    found = docs.read()
    base = SearchSpec(status="ACTIVE", sort="reviewCountDesc")
    c1 = base.at(category_id=75, brand_id=943, color="BLACK", size="S", stock_status="IN_STOCK")
    c3 = base.at(color="GRAY", size="M", stock_status="LOW_STOCK")
    expected = {
        c1: [-20002004, -20002000],
        base: [-20002004, -20002000, -20002001, -20002002],
        c3: [],
    }
    for spec, want in expected.items():
        assert ids(search.search_documents(found, spec)) == want
        assert ids(search.search_exists(changed, options, spec, False)) == want
    assert stale_documents(found, changed).count() == 0


BACKFILL_PRODUCTS = [
    (-19002004, "ACTIVE", 11900, 301, fx.T0),
    (-19002003, "SOLD_OUT", 20900, 22, fx.T0),
    (-19002002, "ACTIVE", 32900, 87, fx.T0),
    (-19002001, "ACTIVE", 45900, 151, fx.T0),
]
BACKFILL_OPTIONS = [
    (1, -19002004, "BLACK", "S", "IN_STOCK"),
    (2, -19002004, "WHITE", "M", "IN_STOCK"),
    (3, -19002003, "GRAY", "M", "LOW_STOCK"),
    (4, -19002001, "BLUE", "FREE", "IN_STOCK"),
]


def test_backfill_stops_resumes_and_retries_once(spark, tmp_path):
    p, o = fx.products(spark, BACKFILL_PRODUCTS), fx.options(spark, BACKFILL_OPTIONS)
    source = relay.Source(lambda: p, lambda: o)
    store = relay.document_store(spark, str(tmp_path / "docs"), p, 1_000)
    checkpoints = str(tmp_path / "cp")

    def run(**more):
        return bf.backfill(spark, source, store, checkpoints, "run", 2, NOW, **more)

    part = run(max_batches=1)
    assert (part.status, part.processed, part.last_id) == ("RUNNING", 2, -19002003)
    assert sorted(ids(store.read())) == [-19002004, -19002003]

    calls = []

    def flaky(docs, keys, name):
        calls.append(name)
        if len(calls) == 1:
            raise RuntimeError("first try fails")
        store.apply_changes(docs, None, name)

    done = run(write=flaky)
    assert (done.status, done.processed, done.batches, done.retried) == ("COMPLETED", 4, 2, 1)
    missing, extra = id_set_diff(p, store.read())
    assert (missing.count(), extra.count()) == (0, 0)
    assert validate.products_without_options(p, o).count() == 1
    assert compare_documents(readmodels.documents(p, o, at()), store.read()).count() == 0
    assert run() == done  # nothing left to do


def test_backfill_batch_committed_before_a_crash_is_not_applied_twice(spark, tmp_path):
    p, o = fx.products(spark, BACKFILL_PRODUCTS), fx.options(spark, BACKFILL_OPTIONS)
    source = relay.Source(lambda: p, lambda: o)
    store = relay.document_store(spark, str(tmp_path / "docs"), p, 1_000)

    def crash_after_commit(docs, keys, name):
        if store.apply_changes(docs, None, name) is None:
            return
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        bf.backfill(spark, source, store, str(tmp_path / "cp"), "r", 2, NOW,
                    write=crash_after_commit)
    versions = store.names()["read"]
    bf.backfill(spark, source, store, str(tmp_path / "cp"), "r", 2, NOW, max_batches=1)
    assert store.names()["read"] == versions
    bf.backfill(spark, source, store, str(tmp_path / "cp"), "r", 2, NOW)
    assert sorted(ids(store.read())) == sorted(r[0] for r in BACKFILL_PRODUCTS)


def test_stream_in_several_batches_equals_one_batch(spark, sf, tmp_path):
    p, o = star.products(spark, sf), star.options(spark, sf)
    out = star.outbox(spark, sf)
    files = str(tmp_path / "events")
    for lo in range(0, 1_000, 250):
        out.where(F.col("id").between(lo, lo + 249)).coalesce(1).write.mode("append").parquet(files)
    source = relay.Source(lambda: p, lambda: o)
    store = relay.document_store(spark, str(tmp_path / "docs"), p, 400)

    def run(watermark=None):
        stream = relay.outbox_stream(spark, files, out.schema, max_files=1)
        query = relay.start_relay(
            stream, source, store, str(tmp_path / "cp"), lambda: NOW, watermark
        )
        query.awaitTermination()

    run()
    batches = [h.batch for h in store.history() if h.batch]
    assert len(batches) == 4 and len(set(batches)) == 4
    touched = out.select(F.col("aggregate_id").alias("id")).distinct()
    expected = readmodels.documents(
        p.where("status <> 'DELETED'").join(touched, "id", "left_semi"), o, at()
    )
    missing, extra = id_set_diff(expected, store.read())
    assert (missing.count(), extra.count()) == (0, 0)
    assert compare_documents(expected, store.read()).count() == 0

    # restarted with nothing new, and with a replayed batch: no new version
    version = store.names()["read"]
    run()
    decisions = ob.decide_latest(ob.group_by_product(out), p)
    relay.apply_decisions(decisions, source, store, at(), batch=batches[0])
    assert store.names()["read"] == version


def test_stream_skips_events_up_to_the_watermark(spark, sf, tmp_path):
    p, o, out = star.products(spark, sf), star.options(spark, sf), star.outbox(spark, sf)
    files = str(tmp_path / "events")
    out.write.parquet(files)
    store = relay.document_store(spark, str(tmp_path / "docs"), p, 400)
    query = relay.start_relay(
        relay.outbox_stream(spark, files, out.schema),
        relay.Source(lambda: p, lambda: o),
        store,
        str(tmp_path / "cp"),
        lambda: NOW,
        watermark=relay.high_watermark(out),
    )
    query.awaitTermination()
    assert store.read().count() == 0


def test_stream_with_a_new_checkpoint_is_no_replay(spark, sf, tmp_path):
    p, o, out = star.products(spark, sf), star.options(spark, sf), star.outbox(spark, sf)
    files = str(tmp_path / "events")
    out.write.parquet(files)
    store = relay.document_store(spark, str(tmp_path / "docs"), p, 400)

    def run(checkpoint):
        relay.start_relay(
            relay.outbox_stream(spark, files, out.schema), relay.Source(lambda: p, lambda: o),
            store, str(tmp_path / checkpoint), lambda: NOW,
        ).awaitTermination()

    run("cp1")
    first = store.read().count()
    store.replace(store.read().limit(0))
    run("cp2")
    assert store.read().count() == first > 0


def test_stream_finishes_its_events(spark, tmp_path):
    p = fx.products(spark, [(1, "ACTIVE", 1, 1, fx.T0), (2, "ACTIVE", 2, 1, fx.T0)])
    o = fx.options(spark, [(1, 1, "RED", "M", "IN_STOCK")])
    out = fx.events(spark, [(1, 1, "PRODUCT_CREATED"), (2, 2, "PRODUCT_CREATED"), (3, 9, "PRODUCT_DELETED")])
    source, docs, events = build(spark, tmp_path, p, o, out)
    files = str(tmp_path / "events")
    out.write.parquet(files)

    def run():
        relay.start_relay(
            relay.outbox_stream(spark, files, out.schema), source, docs, str(tmp_path / "cp"),
            lambda: NOW, outbox=events, reject=F.col("id") == 2,
        ).awaitTermination()

    run()
    got = {r.id: (r.status, r.retry_count, r.claim_token) for r in events.read().collect()}
    assert got == {1: ("DONE", 0, None), 2: ("PENDING", 1, None), 3: ("DONE", 0, None)}
    assert ids(docs.read()) == [1]
    version = events.names()["read"]
    run()
    assert events.names()["read"] == version


def test_a_retry_is_delivered_without_a_new_event(spark, tmp_path):
    p = fx.products(spark, [(1, "ACTIVE", 1, 1, fx.T0), (2, "ACTIVE", 2, 1, fx.T0)])
    o = fx.options(spark, [(1, 1, "RED", "M", "IN_STOCK")])
    out = fx.events(spark, [(1, 1, "PRODUCT_CREATED"), (2, 2, "PRODUCT_CREATED"), (3, 9, "PRODUCT_DELETED")])
    source, docs, events = build(spark, tmp_path, p, o, out)
    files, ticks = str(tmp_path / "events"), str(tmp_path / "ticks")
    out.write.parquet(files)
    spark.range(1).write.parquet(ticks)

    def run(at, reject, config=ob.RelayConfig(batch_size=1)):
        relay.start_relay(
            relay.outbox_stream(spark, files, out.schema), source, docs, str(tmp_path / "cp"), lambda: at,
            outbox=events, reject=reject, wake=relay.outbox_stream(spark, ticks, "id long"), config=config,
        ).awaitTermination()
        return {r.id: (r.status, r.retry_count) for r in events.read().collect()}

    # Rounds of one event each take all that are due.
    assert run(NOW, F.col("id") == 2) == {1: ("DONE", 0), 2: ("PENDING", 1), 3: ("DONE", 0)}
    spark.range(1).write.mode("append").parquet(ticks)
    soon = str(dt.datetime.fromisoformat(NOW) + dt.timedelta(seconds=5))
    assert run(soon, F.lit(False))[2] == ("PENDING", 1)
    spark.range(1).write.mode("append").parquet(ticks)
    later = str(dt.datetime.fromisoformat(NOW) + dt.timedelta(minutes=1))
    assert run(later, F.lit(False))[2] == ("DONE", 1) and ids(docs.read()) == [1, 2]
    with pytest.raises(ValueError):
        relay.start_relay(relay.outbox_stream(spark, files, out.schema), source, docs, str(tmp_path / "x"), lambda: NOW, wake=relay.outbox_stream(spark, ticks, "id long"))


def test_retention_removes_events_and_unreachable_folders(spark, tmp_path):
    rows = [(i, i, "PRODUCT_CREATED") for i in (1, 2, 1_001, 2_001)]
    out = fx.events(spark, rows)
    old, new = (F.lit(t).cast("timestamp_ntz") for t in ("2026-04-01 00:00:00", "2026-05-01 00:00:00"))
    out = out.withColumns({
        "status": F.when(F.col("id") == 2, "FAILED").otherwise("DONE"),
        "processed_at": F.when(F.col("id") == 2_001, new).otherwise(old),
    })
    store = relay.outbox_store(spark, str(tmp_path / "outbox"), out, 1_000)
    store.replace(out)
    store.apply_changes(out.where("id = 1"), None, batch="b")
    assert len(store.folders()) == 5  # three buckets, one of them twice, and the change
    kept = relay.retain(store, NOW, steps=5)
    # Only change folders that are worked into their buckets go.
    assert all(f.startswith("changes/") for f in kept) and sorted(ids(store.read())) == [2, 2_001]
    store.rollback()
    assert sorted(ids(store.read())) == [1, 2, 1_001, 2_001]
    removed = relay.retain(store, NOW, steps=0)
    assert sorted(ids(store.read())) == [2, 2_001] and len(store.folders()) == 2
    assert removed and store.applied("b") and store.clean_up(0) == []
    fresh = relay.outbox_store(spark, str(tmp_path / "outbox"), out, 1_000)
    assert sorted(ids(fresh.read())) == [2, 2_001]
    store.apply_changes(out.where("id = 1"), None)
    assert sorted(ids(store.read())) == [1, 2, 2_001]


def test_backfill_batch_that_grew_after_a_crash_is_applied(spark, tmp_path):
    o = fx.options(spark, BACKFILL_OPTIONS)
    held = fx.products(spark, BACKFILL_PRODUCTS)
    source = relay.Source(lambda: held, lambda: o)
    store = relay.document_store(spark, str(tmp_path / "docs"), held, 1_000)

    def crash_after_commit(docs, keys, name):
        store.apply_changes(docs, None, name)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        bf.backfill(spark, source, store, str(tmp_path / "cp"), "r", 10, NOW, write=crash_after_commit)
    more = fx.products(spark, [*BACKFILL_PRODUCTS, (-19002005, *BACKFILL_PRODUCTS[0][1:])])
    grown = relay.Source(lambda: more, lambda: o)
    done = bf.backfill(spark, grown, store, str(tmp_path / "cp"), "r", 10, NOW)
    assert done.status == "COMPLETED" and store.read().count() == more.count()


def test_backfill_commits_groups_of_batches(spark, tmp_path):
    """Jobs and driver rows of a backfill follow its commits, not its products."""
    rows = 2_000
    p = fx.products(spark, [(i * 3, "ACTIVE", 1, 1, fx.T0) for i in range(rows)])
    p.write.parquet(str(tmp_path / "p"))
    source = relay.Source(
        lambda: spark.read.parquet(str(tmp_path / "p")), lambda: fx.options(spark, [])
    )
    jobs = []
    for size in (1_000, 10):
        store = relay.document_store(spark, str(tmp_path / f"docs{size}"), p, 1_000_000)
        written = []

        def write(docs, keys, name):
            written.append(name)
            store.apply_changes(docs, None, name)

        spark.sparkContext.setJobGroup(f"backfill-{size}", "")
        bf.backfill(spark, source, store, str(tmp_path / f"cp{size}"), "r", size, NOW, max_batches=1,
                    write=write, commits=3)
        done = bf.backfill(spark, source, store, str(tmp_path / f"cp{size}"), "r", size, NOW,
                           write=write, commits=3)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"backfill-{size}")))
        assert (done.status, done.processed) == ("COMPLETED", rows) and len(written) <= 4
        assert store.read().count() == rows and done.batches >= rows // size
    spark.sparkContext.setJobGroup("", "")
    assert jobs[1] <= 2 * jobs[0]


def test_a_long_queue_is_emptied_in_a_bounded_number_of_versions(spark, tmp_path):
    p = fx.products(spark, [(i, "ACTIVE", 1, 1, fx.T0) for i in range(40)])
    out = fx.events(spark, [(i * 7_919, i, "PRODUCT_CREATED") for i in range(40)])
    source, docs, events = build(spark, tmp_path, p, fx.options(spark, []), out)
    files = str(tmp_path / "events")
    out.write.parquet(files)
    relay.start_relay(
        relay.outbox_stream(spark, files, out.schema), source, docs, str(tmp_path / "cp"), lambda: NOW,
        outbox=events, config=ob.RelayConfig(batch_size=3), reject=F.col("id") == 5,
    ).awaitTermination()
    batches = [h.batch for h in events.history() if h.batch]
    assert len(batches) == 2 and [h.batch for h in docs.history()][-1] == batches[0][: -len("-claimed")]
    claimed = next(h.names["read"] for h in events.history() if h.batch == batches[0])
    # Fourteen batches in id order, each under a token of its own.
    held = events.upserted(claimed).groupBy("claim_token").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    found = sorted((r.lo, r.hi, r.n) for r in held.collect())
    assert [n for _, _, n in found] == [3] * 13 + [1] and all(a[1] < b[0] for a, b in zip(found, found[1:]))
    got = {r.aggregate_id: (r.status, r.claim_token) for r in events.read().collect()}
    assert got.pop(5) == ("PENDING", None) and set(got.values()) == {("DONE", None)} and len(got) == 39
    assert docs.read().count() == 39
