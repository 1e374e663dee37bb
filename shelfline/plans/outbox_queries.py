"""Registered outbox, lag, latency, snapshot and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfline.functions.columns import wait_or_unknown
from shelfline.operators import lag
from shelfline.operators import outbox as ob
from shelfline.plans import check_sql as q
from shelfline.plans.registry import add
from shelfline.plans.report_queries import flat_documents
from shelfline.plans.search_queries import AS_CREATED_SQL, as_created, refreshed_at, tables
from shelfline.session import shared_dir
from shelfline.sources import latency_log
from shelfline.sources import star_schema as star
from shelfline.sources.snapshots import apply_changes
from shelfline.streaming import backfill as bf
from shelfline.streaming import relay

NOW = "2024-02-01 00:00:00"
LEASE_MS = 86_400_000
CLAIM = 100
#: Added to ids that only the older or only the newer side of a comparison has.
EARLIER, LATER = 1_000_000_000, 2_000_000_000


def _outbox(check: str, *more: str, **extra: str) -> str:
    return q.with_relations(check, "outbox", *more, **extra)


# ---- capture -------------------------------------------------------------------------------


def _snapshots(spark, sf):
    """Products before and after a change, each side with ids that the other does not have."""
    products = star.products(spark, sf)
    late = F.col("created_at") >= F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")
    apart = [F.when(late, F.col("id") + EARLIER), F.when(F.col("status") == "DELETED", F.col("id") + LATER)]
    before, after = (c.otherwise(F.col("id")).alias("id") for c in apart)
    rest = [c for c in products.columns if c != "id"]
    return as_created(products).select(before, *rest), products.select(after, *rest)


_SNAPSHOT_SQL = {
    "created": AS_CREATED_SQL,
    "old_products": f"""SELECT * REPLACE (CASE WHEN created_at >= TIMESTAMP '2001-01-01 00:00:00'
                                               THEN id + {EARLIER} ELSE id END AS id) FROM created""",
    "new_products": f"""SELECT * REPLACE (CASE WHEN status = 'DELETED' THEN id + {LATER} ELSE id END
                                          AS id) FROM products""",
}


def _captured(spark, sf):
    events = ob.capture_events(*_snapshots(spark, sf), F.lit(NOW), first_id=1)
    payload = F.from_json(
        "payload", "productId long, changedFields array<string>, previousStatus string, "
        "newStatus string, tombstone boolean, sourceUpdatedAt string"
    )
    return events.withColumn("e", payload).select(
        "id",
        "aggregate_id",
        "event_type",
        "status",
        F.col("e.productId").alias("payload_product_id"),
        F.array_join("e.changedFields", ",").alias("changed_fields"),
        F.col("e.previousStatus").alias("previous_status"),
        F.col("e.newStatus").alias("new_status"),
        F.col("e.tombstone").alias("tombstone"),
        F.col("e.sourceUpdatedAt").alias("source_updated_at"),
    )


add(
    "capture_events",
    _captured,
    q.with_relations(
        """, b AS (SELECT coalesce(o.id, n.id) AS aggregate_id, o.id IS NULL AS is_new,
                         n.id IS NULL AS is_gone, o.price <> n.price AS repriced,
                         o.status <> n.status AS moved, o.status AS was, n.status AS now_is,
                         strftime(n.updated_at, '%Y-%m-%dT%H:%M:%S') AS source_updated_at
                  FROM old_products o FULL JOIN new_products n ON n.id = o.id),
             e AS (
          SELECT aggregate_id, 0 AS slot, 'PRODUCT_CREATED' AS event_type, NULL AS changed_fields,
                 NULL AS previous_status, NULL AS new_status, FALSE AS tombstone, source_updated_at
          FROM b WHERE is_new
          UNION ALL SELECT aggregate_id, 0, 'PRODUCT_DELETED', NULL, NULL, NULL, TRUE, NULL
          FROM b WHERE is_gone
          UNION ALL SELECT aggregate_id, 0, 'PRODUCT_UPDATED', 'price', NULL, NULL, FALSE,
                 source_updated_at FROM b WHERE repriced
          UNION ALL SELECT aggregate_id, CASE WHEN repriced THEN 1 ELSE 0 END,
                 'PRODUCT_STATUS_CHANGED', NULL, was, now_is, FALSE, source_updated_at
          FROM b WHERE moved)
        SELECT aggregate_id * 4 + slot + 1 AS id, aggregate_id, event_type, 'PENDING' AS status,
               aggregate_id AS payload_product_id, changed_fields, previous_status, new_status,
               tombstone, source_updated_at FROM e""",
        "products",
        **_SNAPSHOT_SQL,
    ),
)


def _capture_check(spark, sf):
    """Events per type and product state of every product that has events."""
    return ob.capture_summary(star.products(spark, sf), star.outbox(spark, sf))


add(
    "capture_check",
    _capture_check,
    _outbox(
        """SELECT o.aggregate_id, CASE WHEN max(p.id) IS NULL THEN 0 ELSE 1 END AS product_count,
                  max(p.price) AS price, max(p.status) AS status,
                  count(*) AS captured_events,
                  count(*) FILTER (WHERE event_type = 'PRODUCT_CREATED') AS created_events,
                  count(*) FILTER (WHERE event_type = 'PRODUCT_UPDATED') AS updated_events,
                  count(*) FILTER (WHERE event_type = 'PRODUCT_STATUS_CHANGED')
                      AS status_changed_events,
                  count(*) FILTER (WHERE o.status = 'PENDING') AS pending_events
           FROM outbox o LEFT JOIN products p ON p.id = o.aggregate_id GROUP BY o.aggregate_id""",
        "products",
    ),
)
add(
    "payload_scope",
    lambda s, sf: star.outbox(s, sf)
    .withColumn("k", F.get_json_object("payload", "$.k"))
    .where(F.col("k").like("4%"))
    .groupBy("k")
    .agg(F.count(F.lit(1)).alias("events")),
    _outbox(
        """SELECT json_extract_string(payload, '$.k') AS k, count(*) AS events FROM outbox
           WHERE json_extract_string(payload, '$.k') LIKE '4%' GROUP BY ALL"""
    ),
)

# ---- claim and decisions -------------------------------------------------------------------

_ELIGIBLE_SQL = f"""
    (status = 'PENDING' AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '{NOW}'))
    OR (status = 'PROCESSING'
        AND updated_at <= TIMESTAMP '{NOW}' - to_milliseconds({LEASE_MS}))"""
_CLAIMED_SQL = {
    "claimed": f"SELECT * FROM outbox WHERE {_ELIGIBLE_SQL} ORDER BY id LIMIT {CLAIM}"
}


def _claim(spark, sf, batch=CLAIM):
    table = star.outbox(spark, sf)
    return table, ob.claim(table, NOW, batch, LEASE_MS, "worker-a", "token-a")


add(
    "claim_batch",
    lambda s, sf: _claim(s, sf)[1].select(
        "id", "aggregate_id", "status", "claim_token", "claimed_by", "claimed_at",
        "next_retry_at", "updated_at", "retry_count",
    ),
    _outbox(
        f"""SELECT id, aggregate_id, 'PROCESSING' AS status, 'token-a' AS claim_token,
                   'worker-a' AS claimed_by, TIMESTAMP '{NOW}' AS claimed_at,
                   CAST(NULL AS TIMESTAMP) AS next_retry_at, TIMESTAMP '{NOW}' AS updated_at,
                   retry_count FROM claimed""",
        **_CLAIMED_SQL,
    ),
)


def _claim_merged(spark, sf):
    table, claimed = _claim(spark, sf)
    return (
        ob.merge_changes(table, claimed)
        .groupBy("status", "claimed_by")
        .agg(F.count(F.lit(1)).alias("events"))
    )


add(
    "claim_merged_outbox",
    _claim_merged,
    _outbox(
        """SELECT status, claimed_by, count(*) AS events FROM (
             SELECT CASE WHEN id IN (SELECT id FROM claimed) THEN 'PROCESSING' ELSE status END
                        AS status,
                    CASE WHEN id IN (SELECT id FROM claimed) THEN 'worker-a' ELSE claimed_by END
                        AS claimed_by FROM outbox) GROUP BY ALL""",
        **_CLAIMED_SQL,
    ),
)
add(
    "events_by_product",
    lambda s, sf: ob.group_by_product(star.outbox(s, sf)),
    _outbox(
        """SELECT aggregate_id, min(id) AS first_event_id, count(*) AS event_count
           FROM outbox GROUP BY aggregate_id"""
    ),
)
_STATUS_JOIN = "FROM {} e LEFT JOIN products p ON p.id = e.aggregate_id"
_GROUPED = {"grouped": "SELECT aggregate_id, min(id) AS id FROM outbox GROUP BY aggregate_id"}
add(
    "relay_decisions_latest",
    lambda s, sf: ob.decide_latest(
        ob.group_by_product(star.outbox(s, sf)), star.products(s, sf)
    ).select("aggregate_id", "product_status", "operation"),
    _outbox(
        f"""SELECT aggregate_id, p.status AS product_status,
                   CASE WHEN p.id IS NULL OR p.status = 'DELETED' THEN 'delete' ELSE 'upsert' END
                       AS operation {_STATUS_JOIN.format('grouped')}""",
        "products",
        **_GROUPED,
    ),
)
add(
    "relay_decisions_missing_only",
    lambda s, sf: ob.decide_missing_only(
        ob.group_by_product(star.outbox(s, sf)), star.products(s, sf)
    ).select("aggregate_id", "product_status", "operation"),
    _outbox(
        f"""SELECT aggregate_id, p.status AS product_status,
                   CASE WHEN p.id IS NULL THEN 'delete' ELSE 'upsert' END AS operation
            {_STATUS_JOIN.format('grouped')}""",
        "products",
        **_GROUPED,
    ),
)
_BY_EVENT = {
    "decided": f"""SELECT e.id, e.aggregate_id, e.event_type, p.status AS product_status,
        CASE WHEN e.event_type = 'PRODUCT_DELETED'
               OR json_extract_string(e.payload, '$.tombstone') = 'true' OR p.id IS NULL
               OR (e.event_type = 'PRODUCT_STATUS_CHANGED' AND p.status = 'DELETED')
             THEN 'delete' ELSE 'upsert' END AS operation {_STATUS_JOIN.format('outbox')}"""
}
add(
    "relay_decisions_event",
    lambda s, sf: ob.decide_by_event(star.outbox(s, sf), star.products(s, sf)).select(
        "id", "aggregate_id", "event_type", "product_status", "operation"
    ),
    _outbox("SELECT * FROM decided", "products", **_BY_EVENT),
)
add(
    "relay_last_decision",
    lambda s, sf: ob.last_decision(
        ob.decide_by_event(star.outbox(s, sf), star.products(s, sf))
    ),
    _outbox(
        """SELECT aggregate_id, arg_max(operation, id) AS operation, max(id) AS last_event_id
           FROM decided GROUP BY aggregate_id""",
        "products",
        **_BY_EVENT,
    ),
)

# ---- transitions: results of a worker that believes all its claims carry token-0 ------------


def _results(spark, sf, target):
    table = star.outbox(spark, sf)
    results = table.where("status = 'PROCESSING'").select(
        "id",
        F.lit("token-0").alias("claim_token"),
        F.lit(target).alias("target"),
        F.repeat(F.lit("x"), 1_200).alias("error"),
    )
    return table, results


def _transition(target):
    def run(spark, sf):
        table, results = _results(spark, sf, target)
        return ob.transition(table, results, NOW).select(
            "id", "status", "claim_token", "claimed_by", "retry_count",
            F.length("last_error").alias("error_length"), "next_retry_at", "processed_at",
            "updated_at",
        )

    return run


def _transition_sql(target: str) -> str:
    missed = target != "DONE"
    status = "PENDING" if target == "RETRY" else target
    retry_at = f"TIMESTAMP '{NOW}' + to_milliseconds({ob.RelayConfig.retry_delay_ms})"
    done_at = f"TIMESTAMP '{NOW}'"
    return _outbox(
        f"""SELECT id, '{status}' AS status, CAST(NULL AS VARCHAR) AS claim_token, claimed_by,
                   CAST(retry_count + {int(missed)} AS INTEGER) AS retry_count,
                   CAST({1000 if missed else 'NULL'} AS INTEGER) AS error_length,
                   {retry_at if target == 'RETRY' else 'CAST(NULL AS TIMESTAMP)'} AS next_retry_at,
                   {'CAST(NULL AS TIMESTAMP)' if target == 'RETRY' else done_at} AS processed_at,
                   {done_at} AS updated_at
            FROM outbox WHERE status = 'PROCESSING' AND claim_token = 'token-0'"""
    )


for _target in ("DONE", "RETRY", "FAILED"):
    add(f"transition_{_target.lower()}", _transition(_target), _transition_sql(_target))


def _stale(spark, sf):
    table, results = _results(spark, sf, "DONE")
    return ob.stale_results(table, results).select("id", "claim_token", "target")


add(
    "stale_tokens",
    _stale,
    _outbox(
        """SELECT id, 'token-0' AS claim_token, 'DONE' AS target FROM outbox
           WHERE status = 'PROCESSING' AND claim_token <> 'token-0'"""
    ),
)


def _retry_policy(spark, sf):
    """Targets of all PROCESSING events when the groups of deleted products fail."""
    products = star.products(spark, sf)
    held = star.outbox(spark, sf).where("status = 'PROCESSING'")
    failures = products.where("status = 'DELETED'").select(
        F.col("id").alias("aggregate_id"), F.lit("write failed").alias("error")
    )
    return ob.results_for(held, failures, 3).select("id", "target", "error")


add(
    "retry_policy",
    _retry_policy,
    _outbox(
        """SELECT o.id, CASE WHEN p.id IS NULL THEN 'DONE' WHEN o.retry_count + 1 >= 3
                  THEN 'FAILED' ELSE 'RETRY' END AS target,
                  CASE WHEN p.id IS NOT NULL THEN 'write failed' END AS error
           FROM outbox o LEFT JOIN products p ON p.id = o.aggregate_id AND p.status = 'DELETED'
           WHERE o.status = 'PROCESSING'""",
        "products",
    ),
)
_OLD = f"status = 'DONE' AND processed_at < TIMESTAMP '{NOW}' - to_days(7)"
add(
    "retention_purge",
    lambda s, sf: ob.purge(star.outbox(s, sf), NOW).select("id", "status", "processed_at"),
    _outbox(f"SELECT id, status, processed_at FROM outbox WHERE NOT coalesce({_OLD}, FALSE)"),
)
add(
    "retention_summary",
    lambda s, sf: ob.purge_summary(star.outbox(s, sf), NOW),
    _outbox(
        f"""SELECT count(*) FILTER (WHERE {_OLD}) AS purged_done,
                   count(*) FILTER (WHERE status = 'DONE' AND NOT ({_OLD})) AS kept_recent_done,
                   count(*) FILTER (WHERE status = 'FAILED') AS kept_failed,
                   count(*) FILTER (WHERE status = 'PENDING') AS kept_pending,
                   count(*) FILTER (WHERE status = 'PROCESSING') AS kept_processing FROM outbox"""
    ),
)

# ---- lag -----------------------------------------------------------------------------------


def _ms(start: str, end: str) -> str:
    return f"(epoch_us({end}) - epoch_us({start})) / 1000.0"


def _quantiles_sql(prefix: str = "", suffix: str = "") -> str:
    parts = [
        f"round(coalesce(quantile_cont(v, {p}), 0), 3) AS {prefix}{n}{suffix}"
        for n, p in lag.QUANTILES.items()
    ]
    return ", ".join([*parts, f"round(coalesce(max(v), 0), 3) AS {prefix}max{suffix}"])


_LAG_SQL = {
    "lags": f"""SELECT CAST({_ms('created_at', 'processed_at')} AS DOUBLE) AS v FROM scoped
                WHERE status = 'DONE' AND processed_at IS NOT NULL"""
}


def _lag_report_sql(where: str = "TRUE") -> str:
    age = _ms("created_at", f"TIMESTAMP '{NOW}'")
    counts = ", ".join(
        f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}_count"
        for s in ("PENDING", "PROCESSING", "FAILED", "DONE")
    )
    return _outbox(
        f"""SELECT {counts}, CAST(coalesce(max({age}) FILTER (WHERE status = 'PENDING'), 0)
                   AS DOUBLE) AS oldest_pending_age_ms,
                   (SELECT count(*) FROM lags) AS lag_count,
                   any_value(l.lag_p50_ms) AS lag_p50_ms, any_value(l.lag_p95_ms) AS lag_p95_ms,
                   any_value(l.lag_p99_ms) AS lag_p99_ms, any_value(l.lag_max_ms) AS lag_max_ms
            FROM scoped CROSS JOIN (SELECT {_quantiles_sql('lag_', '_ms')} FROM lags) l""",
        scoped=f"SELECT * FROM outbox WHERE {where}",
        **_LAG_SQL,
    )


_WINDOW = {"window_start": "2024-01-05 00:00:00", "window_end": "2024-01-20 00:00:00"}
_IN_WINDOW = (
    f"created_at >= TIMESTAMP '{_WINDOW['window_start']}' "
    f"AND created_at < TIMESTAMP '{_WINDOW['window_end']}'"
)
add("lag_report", lambda s, sf: lag.lag_report(star.outbox(s, sf), NOW), _lag_report_sql())
add(
    "lag_report_window",
    lambda s, sf: lag.lag_report(star.outbox(s, sf), NOW, **_WINDOW),
    _lag_report_sql(_IN_WINDOW),
)


def _lag_json(spark, sf):
    """Every field of the JSON object."""
    counts = "pending_count long, processing_count long, failed_count long, done_count long"
    lags = "lag_count long, lag_p50_ms double, lag_p95_ms double, lag_p99_ms double, lag_max_ms double"
    shape = (
        "window struct<windowStart string, windowEnd string, smokeRun string>, "
        f"statusCounts struct<{counts}, oldest_pending_age_ms double>, "
        f"totalIndexingLagMs struct<{lags}>, "
        "retryCountDistribution array<struct<retryCount int, eventCount long>>"
    )
    found = lag.lag_report_json(star.outbox(spark, sf), NOW, **_WINDOW).select(
        F.from_json("value", shape).alias("v")
    )
    retry = F.transform("v.retryCountDistribution", lambda r: F.concat_ws(":", r["retryCount"], r["eventCount"]))
    return found.select(
        F.col("v.window.windowStart").alias("window_start"),
        F.col("v.window.windowEnd").alias("window_end"),
        "v.statusCounts.*",
        "v.totalIndexingLagMs.*",
        F.array_join(retry, ",").alias("retries"),
    )


add(
    "lag_report_json",
    _lag_json,
    f"""SELECT '{_WINDOW["window_start"]}' AS window_start, '{_WINDOW["window_end"]}' AS window_end,
               r.*, t.retries
        FROM ({_lag_report_sql(_IN_WINDOW)}) r CROSS JOIN ({_outbox(
            f"""SELECT string_agg(retry_count || ':' || n, ',' ORDER BY retry_count) AS retries FROM (
                    SELECT retry_count, count(*) AS n FROM outbox WHERE {_IN_WINDOW}
                    GROUP BY retry_count)"""
        )}) t""",
)
add(
    "lag_gate",
    lambda s, sf: lag.lag_gate(star.outbox(s, sf), NOW),
    _outbox(
        """SELECT p95_lag_s, max_lag_s, failed_count, pending_count,
                  p95_lag_s <= 30 AND max_lag_s <= 60 AND failed_count = 0 AS lag_passed,
                  pending_count = 0 AND failed_count = 0 AS backlog_passed
           FROM (SELECT round(round(quantile_cont(v, 0.95), 3) / 1000.0, 6) AS p95_lag_s,
                        round(round(max(v), 3) / 1000.0, 6) AS max_lag_s FROM lags),
                (SELECT count(*) FILTER (WHERE status = 'FAILED') AS failed_count,
                        count(*) FILTER (WHERE status = 'PENDING') AS pending_count FROM scoped)""",
        scoped="SELECT * FROM outbox",
        **_LAG_SQL,
    ),
)
_WAIT_SQL = f"""SELECT count(*) AS n, {_quantiles_sql()} FROM (
    SELECT CAST({_ms('created_at', 'claimed_at')} AS DOUBLE) AS v FROM outbox
    WHERE claimed_at IS NOT NULL)"""
add("queue_wait", lambda s, sf: lag.queue_wait(star.outbox(s, sf)), _outbox(_WAIT_SQL))


def _hourly(spark, sf):
    """The outbox with claim times cut to the hour, so that claims form batches."""
    return star.outbox(spark, sf).withColumn("claimed_at", F.date_trunc("hour", "claimed_at"))


_HOURLY = {"hourly": "SELECT * REPLACE (date_trunc('hour', claimed_at) AS claimed_at) FROM outbox"}
add(
    "claim_distribution",
    lambda s, sf: lag.claim_distribution(_hourly(s, sf)),
    _outbox(
        """SELECT count(*) AS batch_claim_count, round(avg(n), 4) AS avg_rows_per_claim,
                  max(n) AS max_rows_per_claim
           FROM (SELECT count(*) AS n FROM hourly
                 WHERE claimed_by IS NOT NULL AND claimed_at IS NOT NULL
                 GROUP BY claimed_by, claimed_at)""",
        **_HOURLY,
    ),
)


def _replicas(spark, sf):
    names = spark.range(6).select(F.concat(F.lit("relay-"), "id").alias("claimed_by"))
    return lag.replica_stats(_hourly(spark, sf), names)


add(
    "replica_stats",
    _replicas,
    _outbox(
        """SELECT r.claimed_by, count(h.id) AS claim_count,
                  count(DISTINCT h.claimed_at) AS batch_claim_count,
                  min(h.claimed_at) AS first_claim_at,
                  max(h.processed_at) FILTER (WHERE h.status = 'DONE') AS last_done_at
           FROM (SELECT 'relay-' || i AS claimed_by FROM range(6) t(i)) r
           LEFT JOIN hourly h ON h.claimed_by = r.claimed_by GROUP BY r.claimed_by""",
        **_HOURLY,
    ),
)
add(
    "duplicate_aggregates",
    lambda s, sf: lag.duplicate_aggregates(star.outbox(s, sf)),
    _outbox(
        """SELECT aggregate_id, count(*) AS event_count FROM outbox
           GROUP BY aggregate_id HAVING count(*) > 1"""
    ),
)
add(
    "retry_distribution",
    lambda s, sf: lag.retry_distribution(star.outbox(s, sf)),
    _outbox("SELECT retry_count, count(*) AS event_count FROM outbox GROUP BY retry_count"),
)
add(
    "strategy_comparison",
    lambda s, sf: lag.compare_runs(
        star.outbox(s, sf).withColumn("case_name", F.concat(F.lit("case-"), "retry_count")),
        "case_name",
    ),
    _outbox(
        f""", done AS (SELECT case_name, count(*) AS events,
                      CAST({_ms('min(created_at)', 'max(processed_at)')} AS DOUBLE) AS total_ms,
                      round(quantile_cont(CAST({_ms('created_at', 'processed_at')} AS DOUBLE),
                                          0.95), 3) AS lag_p95_ms
                      FROM cases WHERE status = 'DONE' GROUP BY case_name),
             c AS (SELECT case_name, count(*) AS claims, max(n) AS max_rows_per_claim FROM (
                     SELECT case_name, count(*) AS n FROM cases
                     WHERE claimed_by IS NOT NULL GROUP BY case_name, claimed_by, claimed_at)
                   GROUP BY case_name)
        SELECT done.case_name, events, total_ms,
               round(events * 1000 / nullif(total_ms, 0), 4) AS events_per_s, lag_p95_ms, claims,
               max_rows_per_claim
        FROM done LEFT JOIN c ON c.case_name = done.case_name""",
        cases="SELECT *, 'case-' || retry_count AS case_name FROM outbox",
    ),
)

# ---- latency lines, counters, request log --------------------------------------------------


def _latency_lines(spark, sf):
    """The latency line of every event, as text."""
    ms = (F.col("id") * 37) % 211
    rows = star.outbox(spark, sf).select(
        F.col("id").alias("event_id"),
        "aggregate_id",
        "event_type",
        F.col("status").alias("result_status"),
        wait_or_unknown(F.col("created_at"), F.col("claimed_at")).alias("queue_wait_ms"),
        (ms % 53).alias("source_document_load_ms"),
        (ms % 97).alias("write_ms"),
        (ms % 11).alias("state_transition_ms"),
        ms.alias("relay_processing_ms"),
    )
    return latency_log.format_latency_log(rows)


_LINES_SQL = {
    "lines": f"""SELECT id AS event_id, aggregate_id, event_type, status AS result_status,
        CASE WHEN claimed_at IS NULL OR claimed_at < created_at THEN -1
             ELSE CAST(floor({_ms('created_at', 'claimed_at')}) AS BIGINT) END AS queue_wait_ms,
        id * 37 % 211 % 53 AS source_document_load_ms, id * 37 % 211 % 97 AS write_ms,
        id * 37 % 211 % 11 AS state_transition_ms, id * 37 % 211 AS relay_processing_ms
        FROM outbox"""
}
add(
    "latency_log_parse",
    lambda s, sf: latency_log.parse_latency_log(_latency_lines(s, sf)),
    _outbox("SELECT * FROM lines", **_LINES_SQL),
)
add(
    "latency_nearest_rank",
    lambda s, sf: lag.stage_quantiles(
        latency_log.parse_latency_log(_latency_lines(s, sf))
    ),
    _outbox(
        " UNION ALL ".join(
            f"""SELECT '{stage}' AS stage, count(*) AS n,
                       {', '.join(f'CAST(quantile_disc({stage}, {p}) AS DOUBLE) AS {n}'
                                  for n, p in lag.QUANTILES.items())},
                       CAST(max({stage}) AS DOUBLE) AS max FROM lines"""
            for stage in latency_log.STAGES
        ),
        **_LINES_SQL,
    ),
)


def _samples(spark, sf):
    """Counter samples: the event number as a counter per instance."""
    return star.table(spark, sf, "events").select(
        "ts",
        F.lit("relay_processed_rows_total").alias("metric"),
        F.create_map(
            F.lit("instance_id"), F.concat(F.lit("relay-"), F.col("user_id") % 4)
        ).alias("labels"),
        F.col("event_id").cast("double").alias("value"),
    )


def _counter_delta(spark, sf):
    samples = _samples(spark, sf).withColumn("instance_id", F.col("labels")["instance_id"])
    return lag.counter_delta(
        samples, "2024-01-05 00:00:00", "2024-01-20 00:00:00", ["metric", "instance_id"]
    )


add(
    "counter_delta",
    _counter_delta,
    """SELECT *, greatest(0, at_end - at_start) AS increase FROM (
         SELECT 'relay_processed_rows_total' AS metric, 'relay-' || (user_id % 4) AS instance_id,
                coalesce(CAST(arg_max(event_id, ts) FILTER (WHERE ts <= TIMESTAMP
                    '2024-01-05 00:00:00') AS DOUBLE), 0) AS at_start,
                coalesce(CAST(arg_max(event_id, ts) AS DOUBLE), 0) AS at_end
         FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY ALL)""",
)


def _runs(spark, sf):
    """One scheduler run per instance and hour; a run without DONE events was empty."""
    return (
        star.outbox(spark, sf)
        .groupBy(
            F.concat(F.lit("relay-"), F.col("id") % 4).alias("instance_id"),
            F.date_trunc("hour", "created_at").alias("hour"),
        )
        .agg(
            F.count_if(F.col("status") == "DONE").alias("processed_rows"),
            F.count(F.lit(1)).alias("batch_attempts"),
            (
                F.timestamp_diff("MICROSECOND", F.min("created_at"), F.max("created_at")) / 1000.0
            ).alias("duration_ms"),
        )
    )


_RUNS_SQL = {
    "runs": f"""SELECT 'relay-' || (id % 4) AS instance_id,
        date_trunc('hour', created_at) AS hour,
        count(*) FILTER (WHERE status = 'DONE') AS processed_rows, count(*) AS batch_attempts,
        CAST({_ms('min(created_at)', 'max(created_at)')} AS DOUBLE) AS duration_ms
        FROM outbox GROUP BY ALL""",
    "labelled": """SELECT *, CASE WHEN processed_rows = 0 THEN 'empty' ELSE 'non_empty' END
        AS result FROM runs""",
}
add(
    "relay_run_rollup",
    lambda s, sf: lag.relay_run_rollup(_runs(s, sf)),
    _outbox(
        """SELECT instance_id, result, count(*) AS scheduler_runs,
                  CAST(sum(batch_attempts) AS BIGINT) AS batch_attempts,
                  CAST(sum(processed_rows) AS BIGINT) AS processed_rows,
                  round(quantile_cont(CAST(processed_rows AS DOUBLE), 0.5), 3) AS claim_rows_p50,
                  round(quantile_cont(CAST(processed_rows AS DOUBLE), 0.95), 3) AS claim_rows_p95,
                  round(quantile_cont(duration_ms, 0.95), 3) AS duration_p95_ms
           FROM labelled GROUP BY instance_id, result""",
        **_RUNS_SQL,
    ),
)
add(
    "empty_run_ratio",
    lambda s, sf: lag.empty_run_ratio(lag.relay_run_rollup(_runs(s, sf))),
    _outbox(
        """SELECT round(CAST(count(*) FILTER (WHERE result = 'empty') AS DOUBLE)
                        / CAST(count(*) AS DOUBLE), 6) AS empty_run_ratio FROM labelled""",
        **_RUNS_SQL,
    ),
)
#: The 40 / 40 / 20 mix of the three scenarios.
MIX = ["B1", "B1", "B2", "B2", "B3"]


def _requests(spark, sf):
    """A request log: latency is the event value, error events failed on the document path."""
    n = F.col("event_id")
    failed = F.col("event_type") == "error"
    mix, reasons = (F.array(*[F.lit(v) for v in values]) for values in (MIX, lag.REASONS))
    return star.table(spark, sf, "events").select(
        "ts",
        F.element_at(mix, (n % 5).cast("int") + 1).alias("scenario"),
        F.lit("documents").alias("read_path"),
        F.col("value").alias("duration_ms"),
        F.when(failed & (n % 10 == 9), 503).otherwise(200).alias("status"),
        F.when(n % 50 == 7, 49).otherwise(50).alias("returned_count"),
        F.lit(50).alias("limit"),
        F.when(failed, F.element_at(reasons, (n % 5).cast("int") + 1)).alias("failure_reason"),
    )


_REQUESTS_SQL = f"""
    SELECT ts, list_extract({MIX!r}, CAST(event_id % 5 AS INTEGER) + 1) AS scenario,
           value AS duration_ms,
           CASE WHEN event_type = 'error' AND event_id % 10 = 9 THEN 503 ELSE 200 END AS status,
           CASE WHEN event_type = 'error'
                THEN list_extract({lag.REASONS!r}, CAST(event_id % 5 AS INTEGER) + 1) END
               AS failure_reason,
           CASE WHEN event_id % 50 = 7 THEN 49 ELSE 50 END AS returned_count FROM events"""
add(
    "fallback_rollup",
    lambda s, sf: lag.fallback_rollup(_requests(s, sf)),
    f"""WITH r AS ({_REQUESTS_SQL})
        SELECT count(failure_reason) AS fallback_count,
               count(*) FILTER (WHERE failure_reason IS NOT NULL AND status = 200)
                   AS fallback_success_count,
               count(*) FILTER (WHERE failure_reason = 'TIMEOUT') AS timeout_count,
               count(*) FILTER (WHERE failure_reason <> 'CIRCUIT_OPEN') AS search_failure_count,
               count(*) FILTER (WHERE failure_reason = 'MALFORMED_RESPONSE')
                   AS invalid_response_count,
               count(*) FILTER (WHERE failure_reason = 'CIRCUIT_OPEN') AS short_circuited_count
        FROM r""",
)
add(
    "latency_rollup",
    lambda s, sf: lag.latency_rollup(_requests(s, sf)),
    f"""WITH r AS ({_REQUESTS_SQL}),
             a AS (SELECT * FROM r UNION ALL SELECT * REPLACE ('all' AS scenario) FROM r)
        SELECT scenario, count(*) AS requests,
               round(CAST(count(*) * 100 AS DOUBLE) / (SELECT count(*) FROM r), 4) AS share_pct,
               count(*) FILTER (WHERE status <> 200 OR returned_count <> 50) AS failed_checks,
               round(CAST(count(*) AS DOUBLE)
                     / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 0), 6)
                   AS requests_per_s,
               round(quantile_cont(duration_ms, 0.95), 3) AS p95_ms
        FROM a GROUP BY scenario""",
)

# ---- upsert sink, backfill, catch-up, streams ----------------------------------------------


def relay_source(spark, sf):
    products, options = tables(spark, sf)
    return relay.Source(lambda: products, lambda: options)


def _upsert_delete(spark, sf):
    """Documents as created, brought up to date for all products that have events."""
    products, options = tables(spark, sf)
    from shelfline.operators import readmodels

    old = readmodels.documents(as_created(products), options, refreshed_at())
    decisions = ob.decide_latest(ob.group_by_product(star.outbox(spark, sf)), products)
    upserts, deletes = ob.relay_changes(decisions, products, options, refreshed_at())
    return flat_documents(apply_changes(old, upserts, deletes))


_FLAT_COLUMNS = f"{q.API}, options_text, option_count"
_TOUCHED = {"touched": "SELECT DISTINCT aggregate_id AS id FROM outbox"}
UPSERT_SQL = q.with_relations(
    f"""SELECT {_FLAT_COLUMNS} FROM document_rows
        WHERE id IN (SELECT id FROM touched) AND status <> 'DELETED'
        UNION ALL
        SELECT {', '.join('d.' + c if c in ('options_text', 'option_count') else 'o.' + c
                          for c in _FLAT_COLUMNS.split(', '))}
        FROM old_products o JOIN document_rows d ON d.id = o.id
        WHERE o.id NOT IN (SELECT id FROM touched)""",
    "outbox",
    "document_rows",
    old_products=AS_CREATED_SQL,
    **_TOUCHED,
)
add("apply_changes", _upsert_delete, UPSERT_SQL)


def old_store(spark, sf, width=4_000):
    """A store holding the documents of the products as created."""
    from shelfline.operators import readmodels

    products, options = tables(spark, sf)
    store = relay.document_store(spark, shared_dir(spark, "store"), products, width)
    store.replace(readmodels.documents(as_created(products), options, refreshed_at()))
    return store


def _stream_relay(spark, sf):
    """The same change as ``apply_changes``, relayed from the event files as a stream."""
    store = old_store(spark, sf)
    raw = relay.outbox_stream(
        spark, sf, star.table(spark, sf, "events").schema, glob="events.parquet"
    )
    query = relay.start_relay(
        star.outbox_from_events(raw),
        relay_source(spark, sf),
        store,
        shared_dir(spark, "relay-checkpoint"),
        lambda: NOW,
    )
    query.awaitTermination()
    return flat_documents(store.read())


add("stream_relay", _stream_relay, UPSERT_SQL)


def _retention_store(spark, sf):
    """A stored outbox after its purge and clean-up, with the folders that hold it."""
    table = star.outbox(spark, sf)
    store = relay.outbox_store(spark, shared_dir(spark, "outbox"), table, 4_000, most_buckets=None)
    store.replace(table)
    before = len(store.folders())
    relay.retain(store, NOW, steps=0)
    rows = store.read().groupBy("status").agg(
        F.count(F.lit(1)).alias("events"), F.min("id").alias("first_id"), F.max("id").alias("last_id"),
        F.sum("aggregate_id").alias("aggregate_sum"),
    )
    # One folder per bucket of 4 000 ids, old or rewritten, none beside them.
    return rows.withColumns({"folders_before": F.lit(before).cast("long"), "folders": F.lit(len(store.folders())).cast("long")})


add(
    "retention_store",
    _retention_store,
    _outbox(
        f"""SELECT status, count(*) AS events, min(id) AS first_id, max(id) AS last_id,
                   CAST(sum(aggregate_id) AS BIGINT) AS aggregate_sum,
                   (SELECT count(DISTINCT CAST(floor(id / 4000.0) AS BIGINT)) FROM outbox) AS folders_before,
                   (SELECT count(DISTINCT CAST(floor(id / 4000.0) AS BIGINT)) FROM outbox
                    WHERE NOT coalesce({_OLD}, FALSE)) AS folders
            FROM outbox WHERE NOT coalesce({_OLD}, FALSE) GROUP BY status"""
    ),
)


#: When the second look at the due events takes place, later than any retry of the first.
LATER_ON = "2024-02-01 00:05:00"
_RETRIED = ob.RelayConfig(batch_size=1_000_000, processing_timeout_ms=LEASE_MS)


def _stream_retries(spark, sf):
    """Events of refused products come back by themselves: no event arrives for the second look."""
    table = star.outbox(spark, sf)
    events = relay.outbox_store(spark, shared_dir(spark, "outbox"), table, 1_000_000)
    events.replace(table)
    docs, files, ticks, checkpoint = (shared_dir(spark, x) for x in ("docs", "files", "ticks", "checkpoint"))
    products, _ = tables(spark, sf)
    store = relay.document_store(spark, docs, products)
    table.select("id").write.parquet(files)
    spark.range(1).write.parquet(ticks)
    for now, reject in ((NOW, F.col("id") % 5 == 0), (LATER_ON, F.lit(False))):
        relay.start_relay(
            relay.outbox_stream(spark, files, "id long"), relay_source(spark, sf), store, checkpoint,
            lambda at=now: at, outbox=events, config=_RETRIED, reject=reject,
            wake=relay.outbox_stream(spark, ticks, "id long"),
        ).awaitTermination()
        spark.range(1).write.mode("append").parquet(ticks)
    return events.read().groupBy("status", "retry_count").agg(
        F.count(F.lit(1)).alias("events"), F.max("id").alias("last_id"),
        F.sum("aggregate_id").alias("aggregate_sum"),
    )


add(
    "stream_retry_delivery",
    _stream_retries,
    _outbox(
        f""", seen AS (
          SELECT o.*, ({_ELIGIBLE_SQL.replace("status", "o.status").replace("updated_at", "o.updated_at")}) AS due,
                 p.id IS NOT NULL AND p.status <> 'DELETED' AND p.id % 5 = 0 AS refused
          FROM outbox o LEFT JOIN products p ON p.id = o.aggregate_id
        ), after_first AS (
          SELECT id, aggregate_id, CASE WHEN due AND refused THEN retry_count + 1 ELSE retry_count END AS retry_count,
                 CASE WHEN NOT due THEN status WHEN NOT refused THEN 'DONE'
                      WHEN retry_count + 1 >= {_RETRIED.max_retry_count} THEN 'FAILED' ELSE 'PENDING' END AS status,
                 CASE WHEN due THEN TIMESTAMP '{NOW}' + to_milliseconds({_RETRIED.retry_delay_ms}) ELSE next_retry_at END AS next_retry_at,
                 CASE WHEN due THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at
          FROM seen
        )
        SELECT CASE WHEN {_ELIGIBLE_SQL.replace(NOW, LATER_ON)} THEN 'DONE' ELSE status END AS status,
               retry_count, count(*) AS events, max(id) AS last_id, CAST(sum(aggregate_id) AS BIGINT) AS aggregate_sum
        FROM after_first GROUP BY ALL""",
        "products",
    ),
)


def _stream_status(spark, sf):
    raw = relay.outbox_stream(
        spark, sf, star.table(spark, sf, "events").schema, glob="events.parquet"
    )
    query = relay.status_stream(
        star.outbox_from_events(raw), "outbox_status_counts", shared_dir(spark, "status")
    )
    query.awaitTermination()
    return spark.table("outbox_status_counts")


add(
    "stream_status",
    _stream_status,
    _outbox(
        f"""SELECT status, CAST(length(bin(CAST(floor({_ms('created_at', 'processed_at')}) AS BIGINT)))
                         AS INTEGER) AS lag_bits,
                   count(*) AS event_count,
                   max(CAST({_ms('created_at', 'processed_at')} AS DOUBLE)) AS lag_max_ms
            FROM outbox GROUP BY ALL"""
    ),
)


def _stream_lag(spark, sf):
    """Lag quantiles kept by the stream, held against the ranks they have in the whole table."""
    raw = relay.outbox_stream(spark, sf, star.table(spark, sf, "events").schema, glob="events.parquet")
    relay.lag_stream(
        star.outbox_from_events(raw), "outbox_lag", shared_dir(spark, "lag"), {"p50": 0.5, "p95": 0.95}
    ).awaitTermination()
    kept = spark.table("outbox_lag").withColumnRenamed("status", "of")
    lag = F.timestamp_diff("MICROSECOND", F.col("created_at"), F.col("processed_at")) / 1000.0
    rows = star.outbox(spark, sf).select("status", lag.alias("lag")).join(F.broadcast(kept), F.col("status") == F.col("of"))

    def near(p, name):
        # The rank of the kept value lies within the stated error; equal values share a span of ranks.
        below, upto = F.count_if(F.col("lag") < F.col(name)), F.count_if(F.col("lag") <= F.col(name))
        n, slack = F.max("lag_count"), relay.RANK_ERROR
        fits = (below - 1 <= (p + slack) * n) & (upto + 1 >= (p - slack) * n)
        return F.when(n > 0, fits).alias(f"{name}_near")

    return rows.groupBy("status").agg(
        F.max("event_count").alias("event_count"), F.max("lag_count").alias("lag_count"),
        F.max("lag_max_ms").alias("lag_max_ms"), near(0.5, "p50"), near(0.95, "p95"),
    )


add(
    "stream_lag_quantiles",
    _stream_lag,
    _outbox(
        f"""SELECT status, count(*) AS event_count, count(processed_at) AS lag_count,
                   max(CAST({_ms('created_at', 'processed_at')} AS DOUBLE)) AS lag_max_ms,
                   CASE WHEN count(processed_at) > 0 THEN TRUE END AS p50_near,
                   CASE WHEN count(processed_at) > 0 THEN TRUE END AS p95_near
            FROM outbox GROUP BY status"""
    ),
)


def _backfill(spark, sf):
    """A backfill that is interrupted after one batch and resumed."""
    products, _ = tables(spark, sf)
    source = relay_source(spark, sf)
    store = relay.document_store(spark, shared_dir(spark, "store"), products, 4_000)
    checkpoints = shared_dir(spark, "backfill-checkpoint")
    size = max(1, products.count() // 4 + 1)
    for limit in (1, None):
        bf.backfill(
            spark, source, store, checkpoints, "run-1", size, NOW, max_batches=limit
        )
    return flat_documents(store.read())


add(
    "backfill_resume",
    _backfill,
    q.with_relations(f"SELECT {_FLAT_COLUMNS} FROM document_rows", "document_rows"),
)


def _catch_up(spark, sf):
    """All events above a watermark replayed by their own kind, until none is eligible."""
    table = star.outbox(spark, sf)
    events = relay.outbox_store(spark, shared_dir(spark, "outbox"), table, 4_000)
    events.replace(table)
    watermark = relay.high_watermark(table) // 2
    store = old_store(spark, sf)
    config = ob.RelayConfig(enabled=True, batch_size=10_000_000, processing_timeout_ms=LEASE_MS)
    relay.catch_up(events, store, relay_source(spark, sf), NOW, watermark, config)
    return events.read().groupBy("status").agg(F.count(F.lit(1)).alias("events"))


add(
    "catch_up_status",
    _catch_up,
    _outbox(
        f"""SELECT CASE WHEN ({_ELIGIBLE_SQL}) AND status = 'PENDING'
                             AND id > (SELECT max(id) // 2 FROM outbox)
                        THEN 'DONE' ELSE status END AS status, count(*) AS events
            FROM outbox GROUP BY ALL"""
    ),
)


# ---- windows, drained relay, alias switch --------------------------------------------------


def _windows(spark, sf):
    """The backfill windows of all products, summed up."""
    from shelfline.operators.paging import id_windows

    ids = star.products(spark, sf).select("id")
    return id_windows(ids, 1_000).agg(
        F.sum("rows").alias("covered_rows"),
        F.min("lo").alias("lowest_id"),
        F.max("hi").alias("highest_id"),
        F.count_if(F.col("rows") > 1_000).alias("oversized"),
    )


add(
    "backfill_windows",
    _windows,
    q.with_relations(
        """SELECT count(*) AS covered_rows, min(id) AS lowest_id, max(id) AS highest_id,
                  CAST(0 AS BIGINT) AS oversized FROM products""",
        "products",
    ),
)
_DRAIN = ob.RelayConfig(
    enabled=True, batch_size=400, max_drain_rounds=2, processing_timeout_ms=LEASE_MS
)


def _relay_drain(spark, sf):
    """One scheduler run of two rounds over the outbox; statuses afterwards."""
    table = star.outbox(spark, sf)
    events = relay.outbox_store(spark, shared_dir(spark, "outbox"), table, 4_000)
    events.replace(table)
    relay.drain_outbox(events, old_store(spark, sf), relay_source(spark, sf), NOW, _DRAIN)
    return events.read().groupBy("status").agg(
        F.count(F.lit(1)).alias("events"), F.max("id").alias("last_id")
    )


add(
    "relay_drain",
    _relay_drain,
    _outbox(
        f""", taken AS (SELECT id FROM outbox WHERE {_ELIGIBLE_SQL} ORDER BY id
                       LIMIT {_DRAIN.batch_size * _DRAIN.max_drain_rounds})
        SELECT CASE WHEN id IN (SELECT id FROM taken) THEN 'DONE' ELSE status END AS status,
               count(*) AS events, max(id) AS last_id FROM outbox GROUP BY ALL"""
    ),
)


def _alias_switch(spark, sf):
    """Content behind the read name: at first, after the switch, after the rollback."""
    from shelfline.operators import readmodels

    products, options = tables(spark, sf)
    store = old_store(spark, sf)
    fresh = store.replace(readmodels.documents(products, options, refreshed_at()), "write")

    def seen(stage):
        return store.read().agg(
            F.count(F.lit(1)).alias("documents"),
            F.count_if(F.col("status") == "ACTIVE").alias("active"),
            F.sum("price").alias("price_sum"),
        ).select(F.lit(stage).alias("stage"), "*")

    stages = seen("before")
    store.switch(fresh, "read", "current")
    stages = stages.unionByName(seen("switched"))
    store.rollback()
    return stages.unionByName(seen("rolled_back"))


add(
    "alias_switch_rollback",
    _alias_switch,
    q.with_relations(
        " UNION ALL ".join(
            f"""SELECT '{stage}' AS stage, count(*) AS documents,
                       count(*) FILTER (WHERE status = 'ACTIVE') AS active,
                       CAST(sum(price) AS BIGINT) AS price_sum FROM {source}"""
            for stage, source in (
                ("before", "old_products"), ("switched", "products"),
                ("rolled_back", "old_products"),
            )
        ),
        "products",
        old_products=AS_CREATED_SQL,
    ),
)
