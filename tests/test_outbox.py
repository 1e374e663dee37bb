import fixtures as fx
import pytest
from pyspark.sql import functions as F

from shelfline.operators import lag
from shelfline.operators import outbox as ob

NOW = "2026-05-02 13:00:00"


def test_claim_takes_due_pending_and_expired_processing(spark):
    early, late = "2026-05-02 12:58:00", "2026-05-02 12:59:30"
    out = fx.events(
        spark,
        [
            (1, 10, "PRODUCT_UPDATED", {"status": "DONE", "processed_at": early}),
            (2, 10, "PRODUCT_UPDATED"),
            (3, 11, "PRODUCT_UPDATED", {"next_retry_at": "2026-05-02 13:00:01"}),
            (4, 11, "PRODUCT_UPDATED", {"next_retry_at": NOW}),
            (5, 12, "PRODUCT_UPDATED",
             {"status": "PROCESSING", "claim_token": "old", "updated_at": early}),
            (6, 12, "PRODUCT_UPDATED",
             {"status": "PROCESSING", "claim_token": "old", "claimed_at": early,
              "updated_at": late}),
            (7, 13, "PRODUCT_UPDATED"),
        ],
    )
    got = ob.claim(out, NOW, 3, 60_000, "w", "tok").orderBy("id").collect()
    assert [r.id for r in got] == [2, 4, 5]
    assert all(
        (r.status, r.claim_token, r.claimed_by, r.next_retry_at)
        == ("PROCESSING", "tok", "w", None)
        for r in got
    )
    assert all(r.claimed_at == r.updated_at for r in got)
    merged = ob.merge_changes(out, ob.claim(out, NOW, 3, 60_000, "w", "tok"))
    assert merged.count() == 7 and merged.where("claim_token = 'tok'").count() == 3
    assert [r.id for r in ob.claim(out, NOW, 9, after_id=4).orderBy("id").collect()] == [5, 7]


def test_large_claims_are_cut_by_counting(spark, monkeypatch):
    monkeypatch.setattr(ob, "TOP_K_LIMIT", 10)
    rows = spark.range(0, 3_000, 3)
    got = [r.id for r in ob.lowest_ids(rows, 137).orderBy("id").collect()]
    assert got == list(range(0, 137 * 3, 3))
    assert ob.lowest_ids(rows, 5_000).count() == 1_000


@pytest.fixture
def reclaimed(spark):
    """One row that a second worker took over."""
    return fx.events(
        spark,
        [(1, 10, "PRODUCT_UPDATED", {"status": "PROCESSING", "claim_token": "new",
                                     "claimed_by": "b", "retry_count": 1})],
    )


@pytest.mark.parametrize("target", ["DONE", "RETRY", "FAILED"])
def test_stale_token_changes_nothing_and_is_reported(spark, reclaimed, target):
    def result(token):
        return spark.createDataFrame(
            [(1, token, target, "e" * 1500)], "id long, claim_token string, target string, error string"
        )

    assert ob.transition(reclaimed, result("old"), NOW).count() == 0
    assert ob.stale_results(reclaimed, result("old")).count() == 1
    assert ob.stale_results(reclaimed, result("new")).count() == 0
    row = ob.transition(reclaimed, result("new"), NOW, 5_000).first()
    assert row.claim_token is None and row.claimed_by == "b"
    if target == "DONE":
        assert (row.status, row.retry_count, row.last_error) == ("DONE", 1, None)
        assert row.processed_at is not None
    if target == "RETRY":
        assert (row.status, row.retry_count, len(row.last_error)) == ("PENDING", 2, 1000)
        assert row.next_retry_at.isoformat() == "2026-05-02T13:00:05"
        assert row.processed_at is None
    if target == "FAILED":
        assert (row.status, row.retry_count) == ("FAILED", 2)
        assert row.next_retry_at is None and row.processed_at is not None


def test_failing_group_is_isolated_and_fails_at_the_last_attempt(spark):
    held = fx.events(
        spark,
        [
            (1, 10, "PRODUCT_UPDATED", {"claim_token": "t", "retry_count": 0}),
            (2, 11, "PRODUCT_UPDATED", {"claim_token": "t", "retry_count": 0}),
            (3, 11, "PRODUCT_UPDATED", {"claim_token": "t", "retry_count": 2}),
        ],
    )
    failures = spark.createDataFrame([(11, "boom")], "aggregate_id long, error string")
    got = {r.id: r.target for r in ob.results_for(held, failures, 3).collect()}
    assert got == {1: "DONE", 2: "RETRY", 3: "FAILED"}


def test_decision_modes(spark):
    products = fx.products(
        spark,
        [(1, "ACTIVE", 1, 1, fx.T0), (2, "DELETED", 1, 1, fx.T0), (3, "SOLD_OUT", 1, 1, fx.T0)],
    )
    out = fx.events(
        spark,
        [
            (1, 1, "PRODUCT_UPDATED"),
            (2, 2, "PRODUCT_UPDATED"),
            (3, 3, "PRODUCT_STATUS_CHANGED"),
            (4, 4, "PRODUCT_CREATED"),
            (5, 2, "PRODUCT_STATUS_CHANGED"),
            (6, 1, "PRODUCT_DELETED"),
            (7, 1, "PRODUCT_UPDATED", {"payload": '{"tombstone": true}'}),
        ],
    )
    groups = ob.group_by_product(out)

    def by(df, key):
        return {r[key]: r.operation for r in df.collect()}

    assert by(ob.decide_latest(groups, products), "aggregate_id") == {
        1: "upsert", 2: "delete", 3: "upsert", 4: "delete"
    }
    assert by(ob.decide_missing_only(groups, products), "aggregate_id") == {
        1: "upsert", 2: "upsert", 3: "upsert", 4: "delete"
    }
    decided = ob.decide_by_event(out, products)
    assert by(decided, "id") == {
        1: "upsert", 2: "upsert", 3: "upsert", 4: "delete", 5: "delete", 6: "delete", 7: "delete"
    }
    assert by(ob.last_decision(decided), "aggregate_id")[1] == "delete"


def test_drain_rules():
    def run(config, sizes):
        left = iter(sizes)
        return ob.drain(lambda: next(left), config)

    on = ob.RelayConfig(enabled=True, batch_size=10, max_drain_rounds=3)
    assert run(ob.RelayConfig(enabled=False), [10]) == []
    assert run(on, [10, 4, 10]) == [10, 4]
    assert run(on, [10, 10, 10, 10]) == [10, 10, 10]
    assert run(ob.RelayConfig(enabled=True, batch_size=10, max_drain_rounds=0), [10, 1]) == [10]


def test_capture(spark):
    nothing = fx.products(spark, [(0, "ACTIVE", 1, 1, fx.T0)]).limit(0)
    created = fx.products(spark, [(-17001001, "ACTIVE", 34900, 128, "2026-05-01 09:00:00")])
    updated = fx.products(spark, [(-17001001, "ACTIVE", 35900, 128, "2026-05-01 09:10:00")])
    deleted = fx.products(spark, [(-17001001, "DELETED", 35900, 128, "2026-05-01 09:15:00")])
    at = F.lit(fx.T0)
    steps = [(nothing, created), (created, updated), (updated, deleted)]
    outbox = None
    for i, (old, new) in enumerate(steps):
        found = ob.capture_events(old, new, at, first_id=i * 10**9)
        outbox = found if outbox is None else outbox.unionByName(found)
    assert ob.capture_events(deleted, deleted, at).count() == 0
    first, second = ob.capture_summary(deleted, outbox, [-17001001, -17001002]).orderBy(
        F.col("aggregate_id").desc()
    ).collect()
    assert (first.price, first.status, first.captured_events) == (35900, "DELETED", 3)
    assert (first.created_events, first.updated_events, first.status_changed_events) == (1, 1, 1)
    assert first.pending_events == 3
    assert (second.product_count, second.captured_events) == (0, 0)
    payload = outbox.where("event_type = 'PRODUCT_UPDATED'").first().payload
    assert '"changedFields":["price"]' in payload
    assert outbox.select("id").distinct().count() == 3


def test_retention(spark):
    old, recent = "2026-04-22 13:00:00", "2026-05-02 09:00:00"
    out = fx.events(
        spark,
        [
            (1, 1, "PRODUCT_UPDATED", {"status": "DONE", "processed_at": old}),
            (2, 1, "PRODUCT_UPDATED", {"status": "DONE", "processed_at": recent}),
            (3, 1, "PRODUCT_UPDATED", {"status": "FAILED", "processed_at": old}),
            (4, 1, "PRODUCT_UPDATED", {"created_at": old}),
        ],
    )
    assert sorted(r.id for r in ob.purge(out, NOW).collect()) == [2, 3, 4]
    s = ob.purge_summary(out, NOW).first()
    assert (s.purged_done, s.kept_recent_done, s.kept_failed, s.kept_pending) == (1, 1, 1, 1)


def test_lag_gate_and_empty_reports(spark):
    done = {"status": "DONE", "processed_at": "2026-05-02 12:00:07.929"}
    out = fx.events(spark, [(i, i, "PRODUCT_UPDATED", done) for i in range(1, 6)])
    gate = lag.lag_gate(out, NOW).first()
    assert gate.lag_passed and gate.backlog_passed and gate.max_lag_s == 7.929
    report = lag.lag_report(out.limit(0), NOW).first()
    assert (report.done_count, report.lag_p95_ms, report.oldest_pending_age_ms) == (0, 0, 0)
    waiting = fx.events(spark, [(1, 1, "PRODUCT_UPDATED")])
    gate = lag.lag_gate(waiting, NOW).first()
    assert not gate.backlog_passed and gate.lag_passed
    scoped = fx.events(
        spark, [(1, 1, "PRODUCT_UPDATED", {"payload": '{"smokeRun": "run-a"}'}),
                (2, 1, "PRODUCT_UPDATED")]
    )
    assert lag.scoped(scoped, run="run-a").count() == 1
    assert lag.scoped(scoped, run="", window_start="").count() == 2
    assert lag.scoped(scoped, run_like="run-%").count() == 1


@pytest.mark.parametrize("n", [1, 9, 10, 11, 18_601, 20_000])
def test_claims_are_exact_where_a_slice_holds_many_ids(spark, monkeypatch, n):
    monkeypatch.setattr(ob, "TOP_K_LIMIT", 10)
    rows = spark.range(1, 200_001)
    found = ob.lowest_ids(rows, n).agg(F.count("*").alias("n"), F.max("id").alias("top")).first()
    assert (found.n, found.top) == (n, n)
