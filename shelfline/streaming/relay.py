"""Relaying outbox events into the document store, as batches and as a stream."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfline import schemas
from shelfline.operators import outbox as ob
from shelfline.sources.snapshots import MOST_BUCKETS, SnapshotStore, get_lines

Loader = Callable[[], DataFrame]


@dataclass
class Source:
    """Loaders of the current products and options; every batch reads them afresh."""

    products: Loader
    options: Loader


def document_store(
    spark: SparkSession, root: str, products: DataFrame, bucket_width: int = 1_000_000
) -> SnapshotStore:
    """A store for the documents of these products (their column types are kept)."""
    model = schemas.DOCUMENTS
    fields = [
        products.schema[f.name] if f.name in products.columns else f for f in model.fields
    ]
    return SnapshotStore(spark, root, type(model)(fields), bucket_width=bucket_width)


def outbox_store(
    spark: SparkSession,
    root: str,
    outbox: DataFrame,
    bucket_width: int = 1_000_000,
    most_buckets: int | None = MOST_BUCKETS,
) -> SnapshotStore:
    """A store for events; finished ones lie in files of their own, which a claim never reads."""
    finished = F.col("status").isin("DONE", "FAILED")
    return SnapshotStore(
        spark, root, outbox.schema, bucket_width=bucket_width, closed=finished, most_buckets=most_buckets
    )


def apply_decisions(
    decisions: DataFrame,
    source: Source,
    store: SnapshotStore,
    now: Column,
    batch: str | None = None,
    reject: Column | None = None,
) -> DataFrame:
    """Writes decided products to the store and returns the rejected (aggregate_id, error).

    A document for which ``reject`` holds is not written; its product group has failed, the
    others are not affected.
    """
    products, options = source.products(), source.options()
    failures = decisions.select("aggregate_id", F.lit("").alias("error")).limit(0)
    if reject is not None:
        refused = products.where(reject).select(F.col("id").alias("aggregate_id"))
        failures = (
            decisions.where("operation = 'upsert'")
            .join(refused, "aggregate_id", "left_semi")
            .select("aggregate_id", F.lit("document rejected").alias("error"))
        )
        decisions = decisions.join(failures, "aggregate_id", "left_anti")
    upserts, deletes = ob.relay_changes(decisions, products, options, now)
    store.apply_changes(upserts, deletes, batch=batch)
    return failures


def relay_batch(
    outbox: SnapshotStore,
    docs: SnapshotStore,
    source: Source,
    now: str,
    config: ob.RelayConfig,
    token: str | None = None,
    reject: Column | None = None,
    after_id: int | None = None,
    event_aware: bool = False,
) -> int:
    """Claims, relays and finishes one batch; returns the number of claimed events.

    ``after_id`` limits the batch to events above a high watermark. ``event_aware`` is the mode
    of a replay: each product's last event decides instead of its latest state only, and events
    that another worker holds are left alone.
    """
    token = token or ob.new_token()
    claimed = ob.claim(
        outbox.read(closed=False), now, config.batch_size, config.processing_timeout_ms, config.instance_id, token,
        after_id, reclaim=not event_aware,
    )
    version = outbox.apply_changes(claimed, None)
    if version is None:
        return 0
    held = outbox.upserted(version)
    n_held = held.count()
    products = source.products()
    if event_aware:
        decisions = ob.last_decision(ob.decide_by_event(held, products))
    else:
        decisions = ob.decide_latest(ob.group_by_product(held), products)
    at = F.lit(now).cast("timestamp_ntz")
    decisions = decisions.persist()
    try:
        failures = apply_decisions(decisions, source, docs, at, batch=token, reject=reject)
        results = ob.results_for(
            held, failures if reject is not None else None, config.max_retry_count
        )
        outbox.apply_changes(ob.transition(held, results, now, config.retry_delay_ms), None)
    finally:
        decisions.unpersist()
    return n_held


def drain_outbox(
    outbox: SnapshotStore,
    docs: SnapshotStore,
    source: Source,
    now: str,
    config: ob.RelayConfig,
    reject: Column | None = None,
) -> list[int]:
    """One scheduler run: batch sizes of the drained rounds."""
    return ob.drain(
        lambda: relay_batch(outbox, docs, source, now, config, reject=reject), config
    )


def catch_up(
    outbox: SnapshotStore,
    docs: SnapshotStore,
    source: Source,
    now: str,
    watermark: int,
    config: ob.RelayConfig,
) -> list[int]:
    """Replays all events above the watermark until none is left; returns the batch sizes."""
    sizes: list[int] = []
    while True:
        n = relay_batch(
            outbox, docs, source, now, config, after_id=watermark, event_aware=True
        )
        if n == 0:
            return sizes
        sizes.append(n)


def high_watermark(outbox: DataFrame) -> int:
    """The highest event id, 0 for an empty outbox; taken before a backfill starts."""
    return outbox.agg(F.coalesce(F.max("id"), F.lit(0)).alias("w")).first().w


def retain(outbox: SnapshotStore, now: Column | str, keep_days: int = 7, batch: str | None = None, steps: int = 1) -> list[str]:
    """Takes DONE events of more than ``keep_days`` ago out of the store, then removes what no version needs.

    Only buckets that hold such events, or changes not yet worked in, are rewritten. A named ``batch`` that ran before purges nothing
    again. Returns the removed folders.
    """
    old = ob.past_retention(outbox.read(closed=True), now, keep_days).select("id")
    outbox.apply_changes(None, old, batch=batch, compact=True)
    return outbox.clean_up(steps)


# ---- streaming -----------------------------------------------------------------------------


def outbox_stream(
    spark: SparkSession,
    path: str,
    schema,
    max_files: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """Appended outbox (or raw event) files as a stream."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def heartbeat(spark: SparkSession) -> DataFrame:
    """A stream of one row for each trigger: a polling relay then looks at the due events every time."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()


def start_relay(
    events: DataFrame,
    source: Source,
    store: SnapshotStore,
    checkpoint: str,
    now: Callable[[], str],
    watermark: int | None = None,
    interval: str | None = None,
    name: str = "document-relay",
    outbox: SnapshotStore | None = None,
    config: ob.RelayConfig | None = None,
    reject: Column | None = None,
    wake: DataFrame | None = None,
) -> StreamingQuery:
    """Keeps the store in step with a stream of events.

    Each micro-batch reduces its events to one decision per product, loads the current state
    of these products and applies the change as one store version. The version carries the
    stream's own id and the batch id: a replayed batch changes nothing, and a stream that starts
    anew on the same store, with a new checkpoint, is not taken for a replay. ``interval`` sets a
    polling trigger; without it the stream takes what is there and stops.

    With ``outbox``, that store is the queue of due events and a micro-batch is the occasion to
    empty it: all that are due are claimed there first, in batches of at most ``batch_size`` events
    under a token of their own, and finished there last, whether they came with this batch, wait
    for a retry, or were held by a worker whose lease has ended. The batches of an occasion are one
    change each for claim, documents and outcome. Outcomes are those of the batch relay: DONE, a retry,
    or FAILED after the last attempt. A document for which ``reject`` holds fails the events of
    its product only. ``wake`` is another stream (``heartbeat``, say) whose rows are occasions
    too, so a retry that falls due is delivered without a new event.
    """
    if watermark is not None:
        events = events.where(F.col("id") > watermark)
    if wake is not None:
        if outbox is None:
            raise ValueError("only an outbox store has events that fall due")
        events = events.select("id").unionByName(wake.select(F.lit(None).cast("long").alias("id")))
    config = config or ob.RelayConfig()
    spark = events.sparkSession
    stream: list[str] = []

    def batch_name(batch_id: int) -> str:
        if not stream:
            (line,) = get_lines(spark, f"{checkpoint}/metadata")
            stream.append(json.loads(line)["id"])
        return f"{name}-{stream[0]}-{batch_id}"

    def relay(batch: DataFrame, batch_id: int) -> None:
        own, at = batch_name(batch_id), F.lit(now()).cast("timestamp_ntz")
        if outbox is not None:
            empty_queue(own, at)
        elif not store.applied(own):
            decide(batch, own, at)

    def decide(held: DataFrame, own: str, at: Column) -> None:
        decisions = ob.decide_latest(ob.group_by_product(held), source.products()).persist()
        try:
            failures = apply_decisions(decisions, source, store, at, batch=own, reject=reject)
            if outbox is not None:
                results = ob.results_for(held, failures, config.max_retry_count)
                changes = ob.transition(held, results, at, config.retry_delay_ms)
                outbox.apply_changes(changes, None, batch=f"{own}-finished")
        finally:
            decisions.unpersist()

    def empty_queue(own: str, at: Column) -> None:
        """Rounds until nothing is due; a replayed batch passes over the rounds it has finished.

        A round takes all that is due, in batches that are written together: the number of jobs and
        versions does not grow with the queue.
        """
        for n in count():
            part = f"{own}-{n}"
            if outbox.applied(f"{part}-finished"):
                continue
            if not outbox.applied(f"{part}-claimed"):
                ready = ob.eligible(outbox.read(closed=False), at, config.processing_timeout_ms)
                if watermark is not None:
                    ready = ready.where(F.col("id") > watermark)
                taken = ob.held_in_batches(ready, config.batch_size, at, config.instance_id, part)
                taken = taken.select(*outbox.schema.names)
                version = outbox.apply_changes(taken, None, batch=f"{part}-claimed")
                if version is None:
                    return
                held = outbox.upserted(version)
            else:
                ours = (F.col("status") == "PROCESSING") & F.col("claim_token").startswith(f"{part}-")
                held = outbox.read(closed=False).where(ours)
            decide(held, part, at)

    writer = events.writeStream.foreachBatch(relay).option("checkpointLocation", checkpoint)
    writer = (
        writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    )
    return writer.start()


#: k of the running lag sketch, and the share of the rows by which its ranks may be off (99 % of the time).
SKETCH_K, RANK_ERROR = 4_096, 0.002


def _running(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    writer = rows.writeStream.outputMode("complete").format("memory").queryName(table)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lag_stream(events: DataFrame, table: str, checkpoint: str, probs: dict[str, float]) -> StreamingQuery:
    """Running events, longest lag and lag quantiles per status, in a memory table.

    The state of a status is one mergeable quantile sketch of some ten thousand numbers, however
    many events it has seen: a quantile's rank is right to within ``RANK_ERROR`` of the rows, the
    longest lag is exact. Events that are not processed have no lag and count as events only.
    """
    lag = F.timestamp_diff("MICROSECOND", F.col("created_at"), F.col("processed_at")) / 1000.0
    running = events.groupBy("status").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count(lag).alias("lag_count"),
        F.max(lag).alias("lag_max_ms"),
        F.kll_sketch_agg_double(lag, SKETCH_K).alias("sketch"),
    )

    def at(p):
        found = F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))
        return F.when(F.col("lag_count") > 0, found)

    found = running.select(
        "status", "event_count", "lag_count", "lag_max_ms", *[at(p).alias(n) for n, p in probs.items()]
    )
    return _running(found, table, checkpoint)


def status_stream(events: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Running events and longest lag per status and magnitude of the lag, in a memory table.

    ``lag_bits`` is the number of binary digits of the lag in whole milliseconds, null for events
    that are not processed: an exact histogram of at most 64 rows per status, from which a
    quantile can be read to within a factor of two.
    """
    lag = F.timestamp_diff("MICROSECOND", F.col("created_at"), F.col("processed_at")) / 1000.0
    bits = F.length(F.bin(F.floor(lag).cast("long")))
    running = events.groupBy("status", bits.alias("lag_bits")).agg(
        F.count(F.lit(1)).alias("event_count"), F.max(lag).alias("lag_max_ms")
    )
    return _running(running, table, checkpoint)
