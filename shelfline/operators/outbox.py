"""The change outbox as tables: capture, claim, relay, transition, drain and retention.

The outbox is a snapshot plus small change sets. ``claim`` and ``transition`` return only the
rows they change; ``merge_changes`` folds a change set into the table. All functions take
``now`` as an argument.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.columns import distinct_from, iso_text, plus_ms, truncated
from shelfline.operators.paging import TOP_K_LIMIT, narrow
from shelfline.operators.readmodels import documents
from shelfline.sources.layout import running_total

ERROR_LIMIT_RELAY = 1000
ERROR_LIMIT_REPLAY = 4000


@dataclass(frozen=True)
class RelayConfig:
    """Relay settings; the values are the fixed defaults."""

    enabled: bool = False
    batch_size: int = 20
    fixed_delay_ms: int = 5_000
    max_drain_rounds: int = 1
    max_retry_count: int = 3
    retry_delay_ms: int = 10_000
    processing_timeout_ms: int = 60_000
    instance_id: str = "local-relay"


def new_token() -> str:
    return str(uuid.uuid4())


def as_time(now: Column | str, like: DataFrame, column: str = "created_at") -> Column:
    """``now`` in the time type the table uses."""
    now = now if isinstance(now, Column) else F.lit(now)
    return now.cast(like.schema[column].dataType)


def merge_changes(outbox: DataFrame, changes: DataFrame) -> DataFrame:
    """The outbox with the changed rows in place of the old ones."""
    kept = outbox.join(changes.select("id"), "id", "left_anti")
    return kept.select(*outbox.columns).unionByName(changes.select(*outbox.columns))


# ---- capture -------------------------------------------------------------------------------

#: Product columns whose change is an update; a status change is an event of its own.
TRACKED = ["seller_id", "category_id", "brand_id", "price", "rating", "review_count"]


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.title() for w in rest)


def capture_events(
    old: DataFrame, new: DataFrame, created_at: Column, first_id: int = 1
) -> DataFrame:
    """PENDING outbox rows for the difference of two product snapshots.

    A new id is created, a lost id deleted, a changed status and changed fields are one event
    each; an unchanged product yields nothing. Event ids start at ``first_id``, leave gaps and
    depend on the product id only, so a repeated task gives the same ids.
    """
    both = old.alias("o").join(new.alias("n"), "id", "full")
    o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    was, is_now = o("status").isNotNull(), n("status").isNotNull()
    changed_fields = F.array_compact(
        F.array(
            *[F.when(distinct_from(o(c), n(c)), F.lit(_camel(c))) for c in TRACKED]
        )
    )

    def event(kind: str, fields: Column, status_pair: bool, tombstone: bool) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("event_type"),
            fields.alias("changed_fields"),
            (o("status") if status_pair else none).alias("previous_status"),
            (n("status") if status_pair else none).alias("new_status"),
            F.lit(tombstone).alias("tombstone"),
        )

    nothing = F.lit(None).cast("array<string>")
    found = F.array(
        F.when(~was & is_now, event("PRODUCT_CREATED", nothing, False, False)),
        F.when(was & ~is_now, event("PRODUCT_DELETED", nothing, False, True)),
        F.when(
            was & is_now & (F.size(changed_fields) > 0),
            event("PRODUCT_UPDATED", changed_fields, False, False),
        ),
        F.when(
            was & is_now & (o("status") != n("status")),
            event("PRODUCT_STATUS_CHANGED", nothing, True, False),
        ),
    )
    events = both.select(
        F.col("id").alias("aggregate_id"),
        n("updated_at").alias("source_updated_at"),
        F.posexplode(F.array_compact(found)).alias("slot", "e"),
    ).select("aggregate_id", "source_updated_at", "slot", "e.*")
    payload = F.to_json(
        F.struct(
            F.col("aggregate_id").alias("productId"),
            F.col("event_type").alias("eventType"),
            iso_text(F.col("source_updated_at")).alias("sourceUpdatedAt"),
            F.col("tombstone"),
            F.col("changed_fields").alias("changedFields"),
            F.col("previous_status").alias("previousStatus"),
            F.col("new_status").alias("newStatus"),
        )
    )
    return pending_events(
        events.withColumn("id", _slot_id(first_id)),
        payload,
        created_at,
    )


def capture_option_events(
    old: DataFrame, new: DataFrame, created_at: Column, first_id: int = 1
) -> DataFrame:
    """One PENDING PRODUCT_OPTION_CHANGED row per product whose options differ in two snapshots.

    Options are compared as a multiset, by counts that are reduced map-side: a product with very
    many options moves at most one count per different triple and task. The event ids of a
    capture lie beyond the highest id of ``capture_events`` only if ``first_id`` says so.
    """
    triple = ["color", "size", "stock_status"]
    signed = [s.select("product_id", *triple, F.lit(w).alias("w")) for s, w in ((old, -1), (new, 1))]
    counts = signed[0].unionAll(signed[1]).groupBy("product_id", *triple).agg(F.sum("w").alias("w"))
    changed = counts.where("w <> 0").groupBy(F.col("product_id").alias("aggregate_id")).agg(
        F.sum(F.when(F.col("w") > 0, F.col("w")).otherwise(0)).alias("added"),
        F.sum(F.when(F.col("w") < 0, -F.col("w")).otherwise(0)).alias("removed"),
    )
    kind = "PRODUCT_OPTION_CHANGED"
    payload = F.to_json(
        F.struct(
            F.col("aggregate_id").alias("productId"),
            F.lit(kind).alias("eventType"),
            F.lit(False).alias("tombstone"),
            F.col("added").alias("addedOptions"),
            F.col("removed").alias("removedOptions"),
        )
    )
    events = changed.select(
        "*", F.lit(kind).alias("event_type"), F.lit(0).alias("slot")
    )
    return pending_events(events.withColumn("id", _slot_id(first_id)), payload, created_at)


def _slot_id(first_id: int) -> Column:
    """Two id slots per product, also for negative product ids."""
    pid = F.col("aggregate_id")
    place = F.when(pid >= 0, pid * 2).otherwise(-pid * 2 - 1)
    return place * 2 + F.col("slot") + F.lit(first_id)


def pending_events(events: DataFrame, payload: Column, created_at: Column) -> DataFrame:
    """Outbox rows in their initial state from (id, aggregate_id, event_type)."""
    none = F.lit(None)
    at_type = none.cast("timestamp")
    return events.select(
        "id",
        F.lit("PRODUCT").alias("aggregate_type"),
        "aggregate_id",
        "event_type",
        F.lit(1).alias("schema_version"),
        payload.alias("payload"),
        F.lit("PENDING").alias("status"),
        none.cast("string").alias("claim_token"),
        none.cast("string").alias("claimed_by"),
        at_type.alias("claimed_at"),
        F.lit(0).alias("retry_count"),
        none.cast("string").alias("last_error"),
        at_type.alias("next_retry_at"),
        created_at.cast("timestamp").alias("created_at"),
        created_at.cast("timestamp").alias("updated_at"),
        at_type.alias("processed_at"),
    )


def capture_summary(
    products: DataFrame, outbox: DataFrame, ids: list[int] | None = None
) -> DataFrame:
    """Per aggregate id with events, or per given id: product state and events per type.

    A given id that has neither a row nor an event shows zeros.
    """
    counted = outbox.groupBy("aggregate_id").agg(
        F.count(F.lit(1)).alias("captured_events"),
        *[
            F.count_if(F.col("event_type") == f"PRODUCT_{kind}").alias(f"{kind.lower()}_events")
            for kind in ("CREATED", "UPDATED", "STATUS_CHANGED")
        ],
        F.count_if(F.col("status") == "PENDING").alias("pending_events"),
    )
    counts = [c for c in counted.columns if c != "aggregate_id"]
    if ids is not None:
        wanted = products.sparkSession.createDataFrame([(i,) for i in ids], "aggregate_id long")
        counted = wanted.join(counted, "aggregate_id", "left")
    rows = products.select(F.col("id").alias("aggregate_id"), "price", "status")
    return counted.join(rows, "aggregate_id", "left").select(
        "aggregate_id",
        F.col("status").isNotNull().cast("int").alias("product_count"),
        "price",
        "status",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
    )


# ---- claim ---------------------------------------------------------------------------------


def eligible(
    outbox: DataFrame, now: Column, lease_ms: int, reclaim: bool = True
) -> DataFrame:
    """Due PENDING rows and, with ``reclaim``, PROCESSING rows that outlived their lease."""
    due = (F.col("status") == "PENDING") & (
        F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)
    )
    expired = (F.col("status") == "PROCESSING") & (
        F.col("updated_at") <= plus_ms(now, -lease_ms)
    )
    ready = (due | expired) if reclaim else due
    return outbox.where((F.col("aggregate_type") == "PRODUCT") & ready)


def lowest_ids(rows: DataFrame, n: int) -> DataFrame:
    """The rows with the n lowest ids; a large n is cut at an id found by counting."""
    if n <= TOP_K_LIMIT:
        return rows.orderBy("id").limit(n)
    found, _ = narrow(rows, F.col("id"), n - 1, True, -1)
    if found is None:
        return rows
    return rows.where(F.col("id") <= found[1])


def claim(
    outbox: DataFrame,
    now: Column | str,
    batch_size: int = RelayConfig.batch_size,
    lease_ms: int = RelayConfig.processing_timeout_ms,
    worker: str = RelayConfig.instance_id,
    token: str | None = None,
    after_id: int | None = None,
    reclaim: bool = True,
) -> DataFrame:
    """The next batch in its claimed state; fold it into the outbox with ``merge_changes``.

    ``after_id`` restricts the claim to events above a high watermark.
    """
    now = as_time(now, outbox)
    token = token or new_token()
    rows = eligible(outbox, now, lease_ms, reclaim)
    if after_id is not None:
        rows = rows.where(F.col("id") > after_id)
    return held_by(lowest_ids(rows, batch_size), now, worker, token)


def held_by(rows: DataFrame, now: Column | str, worker: str, token: str) -> DataFrame:
    """The rows in the state that a worker's claim leaves them in."""
    now = as_time(now, rows)
    return rows.withColumns(
        {
            "status": F.lit("PROCESSING"),
            "claim_token": F.lit(token),
            "claimed_by": F.lit(worker),
            "claimed_at": now,
            "next_retry_at": F.lit(None).cast(rows.schema["next_retry_at"].dataType),
            "updated_at": now,
        }
    )


def held_in_batches(
    rows: DataFrame, batch_size: int, now: Column | str, worker: str, token: str
) -> DataFrame:
    """All rows claimed at once, in batches of ``batch_size`` by id; batch n holds ``token-n``.

    The batch of a row follows from its place among the ids, a running total by id ranges.
    """
    placed = running_total(rows.withColumn("_one", F.lit(1)), "id", "_one", "_place")
    batch = F.call_function("div", F.col("_place") - 1, F.lit(batch_size))
    own = F.concat(F.lit(f"{token}-"), batch.cast("string"))
    return held_by(placed, now, worker, token).withColumn("claim_token", own).select(*rows.columns)


# ---- decisions -----------------------------------------------------------------------------


def group_by_product(events: DataFrame) -> DataFrame:
    """One row per product: first event id and number of events; counted map-side."""
    return events.groupBy("aggregate_id").agg(
        F.min("id").alias("first_event_id"), F.count(F.lit(1)).alias("event_count")
    )


def _with_product_status(events: DataFrame, products: DataFrame) -> DataFrame:
    """Events with the current ``product_status``; null where the product is missing.

    The status is looked up once per touched product and then joined to the events.
    """
    touched = events.select(F.col("aggregate_id").alias("id")).distinct()
    current = products.select("id", F.col("status").alias("product_status")).join(
        touched, "id", "left_semi"
    )
    return events.join(
        current.withColumnRenamed("id", "aggregate_id"), "aggregate_id", "left"
    )


def decide_latest(groups: DataFrame, products: DataFrame) -> DataFrame:
    """Latest state only: a missing or DELETED product is deleted, anything else upserted."""
    gone = F.col("product_status").isNull() | (F.col("product_status") == "DELETED")
    return _with_product_status(groups, products).withColumn(
        "operation", F.when(gone, "delete").otherwise("upsert")
    )


def decide_by_event(events: DataFrame, products: DataFrame) -> DataFrame:
    """Event aware: delete events, tombstones and status changes to DELETED delete."""
    tombstone = F.coalesce(F.get_json_object("payload", "$.tombstone") == "true", F.lit(False))
    status = F.col("product_status")
    gone = (
        (F.col("event_type") == "PRODUCT_DELETED")
        | tombstone
        | status.isNull()
        | ((F.col("event_type") == "PRODUCT_STATUS_CHANGED") & (status == "DELETED"))
    )
    return _with_product_status(events, products).withColumn(
        "operation", F.when(gone, "delete").otherwise("upsert")
    )


def decide_missing_only(groups: DataFrame, products: DataFrame) -> DataFrame:
    """Only a missing product is deleted; a DELETED one is upserted."""
    return _with_product_status(groups, products).withColumn(
        "operation", F.when(F.col("product_status").isNull(), "delete").otherwise("upsert")
    )


def last_decision(decided: DataFrame) -> DataFrame:
    """The operation of each product's last event; earlier ones are overwritten by it."""
    return decided.groupBy("aggregate_id").agg(
        F.max_by("operation", "id").alias("operation"), F.max("id").alias("last_event_id")
    )


def relay_changes(
    decisions: DataFrame, products: DataFrame, options: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """(upserts, deletes) for decided products, loading each touched product once.

    ``decisions`` has one row per ``aggregate_id`` with its ``operation``.
    """
    upsert_ids = decisions.where("operation = 'upsert'").select(F.col("aggregate_id").alias("id"))
    deletes = decisions.where("operation = 'delete'").select(F.col("aggregate_id").alias("id"))
    touched_options = options.join(
        upsert_ids.withColumnRenamed("id", "product_id"), "product_id", "left_semi"
    )
    touched_products = products.join(upsert_ids, "id", "left_semi")
    return documents(touched_products, touched_options, now), deletes


# ---- transitions ---------------------------------------------------------------------------


def results_for(
    claimed: DataFrame, failures: DataFrame | None, max_retry_count: int
) -> DataFrame:
    """(id, claim_token, target, error) of every claimed event.

    ``failures`` has (aggregate_id, error) of product groups whose write failed. Their events
    go to RETRY, or to FAILED when this was the last attempt; all others are DONE.
    """
    base = claimed.select("id", "aggregate_id", "claim_token", "retry_count")
    if failures is None:
        failed = F.lit(False)
        base = base.withColumn("error", F.lit(None).cast("string"))
    else:
        base = base.join(failures.select("aggregate_id", "error"), "aggregate_id", "left")
        failed = F.col("error").isNotNull()
    last_attempt = F.col("retry_count") + 1 >= max_retry_count
    target = (
        F.when(~failed, "DONE").when(last_attempt, "FAILED").otherwise("RETRY")
    )
    return base.select("id", "claim_token", target.alias("target"), "error")


def _fenced(outbox: DataFrame, results: DataFrame) -> DataFrame:
    """Outbox rows still held under the token of their result."""
    r = results.select("id", F.col("claim_token").alias("r_token"), "target", "error")
    held = (F.col("status") == "PROCESSING") & (F.col("claim_token") == F.col("r_token"))
    return outbox.join(r, "id").where(held)


def transition(
    outbox: DataFrame,
    results: DataFrame,
    now: Column | str,
    retry_delay_ms: int = RelayConfig.retry_delay_ms,
    error_limit: int = ERROR_LIMIT_RELAY,
) -> DataFrame:
    """Rows changed by the results; a result with a stale token changes nothing."""
    now = as_time(now, outbox)
    target = F.col("target")
    missed = target != "DONE"
    no_time = F.lit(None).cast(outbox.schema["next_retry_at"].dataType)
    return (
        _fenced(outbox, results)
        .withColumns(
            {
                "status": F.when(target == "RETRY", "PENDING").otherwise(target),
                "claim_token": F.lit(None).cast("string"),
                "retry_count": F.col("retry_count") + missed.cast("int"),
                "last_error": F.when(missed, truncated(F.col("error"), error_limit)),
                "next_retry_at": F.when(target == "RETRY", plus_ms(now, retry_delay_ms))
                .when(target == "FAILED", no_time)
                .otherwise(F.col("next_retry_at")),
                "processed_at": F.when(target == "RETRY", F.col("processed_at")).otherwise(now),
                "updated_at": now,
            }
        )
        .select(*outbox.columns)
    )


def stale_results(outbox: DataFrame, results: DataFrame) -> DataFrame:
    """Results that no longer hold their event: wrong token, other status or no such event."""
    held = (
        outbox.where("status = 'PROCESSING'")
        .select("id", "claim_token")
    )
    return results.join(held, ["id", "claim_token"], "left_anti")


# ---- drain and retention -------------------------------------------------------------------


def drain(run_batch, config: RelayConfig) -> list[int]:
    """Batch sizes of one scheduler run: full batches repeat up to the round limit.

    ``run_batch()`` processes one batch and returns its number of events.
    """
    if not config.enabled:
        return []
    sizes = []
    for _ in range(max(1, config.max_drain_rounds)):
        sizes.append(run_batch())
        if sizes[-1] < config.batch_size:
            break
    return sizes


def _past_retention(now: Column, keep_days: int) -> Column:
    cutoff = F.timestamp_add("DAY", F.lit(-keep_days), now)
    return (F.col("status") == "DONE") & (F.col("processed_at") < cutoff)


def purge(outbox: DataFrame, now: Column | str, keep_days: int = 7) -> DataFrame:
    """The outbox without DONE rows that finished more than ``keep_days`` ago."""
    return outbox.where(~F.coalesce(_past_retention(as_time(now, outbox), keep_days), F.lit(False)))


def past_retention(outbox: DataFrame, now: Column | str, keep_days: int = 7) -> DataFrame:
    """The DONE rows that ``purge`` leaves out."""
    return outbox.where(F.coalesce(_past_retention(as_time(now, outbox), keep_days), F.lit(False)))


def purge_summary(outbox: DataFrame, now: Column | str, keep_days: int = 7) -> DataFrame:
    old = F.coalesce(_past_retention(as_time(now, outbox), keep_days), F.lit(False))
    status = F.col("status")
    return outbox.agg(
        F.count_if(old).alias("purged_done"),
        F.count_if((status == "DONE") & ~old).alias("kept_recent_done"),
        F.count_if(status == "FAILED").alias("kept_failed"),
        F.count_if(status == "PENDING").alias("kept_pending"),
        F.count_if(status == "PROCESSING").alias("kept_processing"),
    )
