"""Lag, queue-wait, latency and request reports over outbox rows, log lines and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.functions.columns import elapsed_ms, elapsed_s, one_row, ratio
from shelfline.functions.quantiles import exact_quantiles
from shelfline.operators.outbox import as_time
from shelfline.sources.latency_log import STAGES

QUANTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def scoped(
    outbox: DataFrame,
    window_start: str | None = None,
    window_end: str | None = None,
    run: str | None = None,
    run_like: str | None = None,
) -> DataFrame:
    """Events created in [start, end) and of one run; empty text means no bound."""
    rows = outbox
    if window_start:
        rows = rows.where(F.col("created_at") >= as_time(window_start, outbox))
    if window_end:
        rows = rows.where(F.col("created_at") < as_time(window_end, outbox))
    if run:
        rows = rows.where(F.get_json_object("payload", "$.smokeRun") == run)
    if run_like:
        rows = rows.where(F.get_json_object("payload", "$.smokeRun").like(run_like))
    return rows


def _or_zero(summary: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly one row: aggregates of an empty input become 0."""
    return summary.agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast(summary.schema[c].dataType).alias(c) for c in columns]
    )


def quantile_row(rows: DataFrame, value: str, digits: int = 3) -> DataFrame:
    """One row n, p50, p95, p99, max; zeros when there are no values."""
    stats = _or_zero(exact_quantiles(rows, value, QUANTILES), ["n", *QUANTILES, "max"])
    return stats.select("n", *[F.round(c, digits).alias(c) for c in [*QUANTILES, "max"]])


def done_lag(outbox: DataFrame) -> DataFrame:
    return outbox.where("status = 'DONE' AND processed_at IS NOT NULL").select(
        "*", elapsed_ms(F.col("created_at"), F.col("processed_at")).alias("lag_ms")
    )


def status_counts(outbox: DataFrame, now: Column | str) -> DataFrame:
    """Events per status and the age of the oldest PENDING one, 0 when there is none."""
    age = elapsed_ms(F.col("created_at"), as_time(now, outbox))
    pending = F.col("status") == "PENDING"
    return outbox.agg(
        *[
            F.count_if(F.col("status") == s).alias(f"{s.lower()}_count")
            for s in ("PENDING", "PROCESSING", "FAILED", "DONE")
        ],
        F.coalesce(F.max(F.when(pending, age)), F.lit(0.0)).alias("oldest_pending_age_ms"),
    )


def retry_distribution(outbox: DataFrame) -> DataFrame:
    return outbox.groupBy("retry_count").agg(F.count(F.lit(1)).alias("event_count"))


def lag_report(outbox: DataFrame, now: Column | str, **scope: str) -> DataFrame:
    """One row: status counts, oldest pending age and the lag quantiles of DONE events."""
    rows = scoped(outbox, **scope)
    lag = quantile_row(done_lag(rows), "lag_ms")
    renamed = lag.select(
        *[F.col(c).alias(f"lag_{c}_ms" if c != "n" else "lag_count") for c in lag.columns]
    )
    return one_row(status_counts(rows, now), renamed)


def lag_report_json(outbox: DataFrame, now: Column | str, **scope: str) -> DataFrame:
    """The lag report with its scope and retry distribution as one JSON object (column ``value``)."""
    retries = retry_distribution(scoped(outbox, **scope)).agg(
        F.array_sort(F.collect_list(F.struct("retry_count", "event_count"))).alias("retries")
    )
    both = one_row(lag_report(outbox, now, **scope), retries)
    bounds = {"windowStart": "window_start", "windowEnd": "window_end", "smokeRun": "run"}
    window = [F.lit(scope.get(name) or None).cast("string").alias(key) for key, name in bounds.items()]
    counts = [c for c in both.columns if c.endswith("_count") or c.startswith("oldest")]
    lags = [c for c in both.columns if c.startswith("lag_")]
    return both.select(
        F.to_json(
            F.struct(
                F.struct(*window).alias("window"),
                F.struct(*[c for c in counts if c not in lags]).alias("statusCounts"),
                F.struct(*lags).alias("totalIndexingLagMs"),
                F.transform(
                    "retries",
                    lambda r: F.struct(
                        r["retry_count"].alias("retryCount"), r["event_count"].alias("eventCount")
                    ),
                ).alias("retryCountDistribution"),
            )
        ).alias("value")
    )


def lag_gate(
    outbox: DataFrame, now: Column | str, p95_limit_s: float = 30.0, max_limit_s: float = 60.0
) -> DataFrame:
    """Whether lag and backlog stay within their limits."""
    report = lag_report(outbox, now)
    p95, top = F.round(F.col("lag_p95_ms") / 1000.0, 6), F.round(F.col("lag_max_ms") / 1000.0, 6)
    none_failed = F.col("failed_count") == 0
    return report.select(
        p95.alias("p95_lag_s"),
        top.alias("max_lag_s"),
        "failed_count",
        "pending_count",
        ((p95 <= p95_limit_s) & (top <= max_limit_s) & none_failed).alias("lag_passed"),
        (
            (F.col("pending_count") == 0) & (F.col("oldest_pending_age_ms") == 0) & none_failed
        ).alias("backlog_passed"),
    )


# ---- claims --------------------------------------------------------------------------------


def queue_wait(outbox: DataFrame, digits: int = 3) -> DataFrame:
    """Quantiles of the time from creation to claim."""
    waits = outbox.where("claimed_at IS NOT NULL").select(
        elapsed_ms(F.col("created_at"), F.col("claimed_at")).alias("wait_ms")
    )
    return quantile_row(waits, "wait_ms", digits)


def claim_groups(outbox: DataFrame) -> DataFrame:
    return (
        outbox.where("claimed_by IS NOT NULL AND claimed_at IS NOT NULL")
        .groupBy("claimed_by", "claimed_at")
        .agg(F.count(F.lit(1)).alias("rows_per_claim"))
    )


def claim_distribution(outbox: DataFrame) -> DataFrame:
    return claim_groups(outbox).agg(
        F.count(F.lit(1)).alias("batch_claim_count"),
        F.coalesce(F.round(F.avg("rows_per_claim"), 4), F.lit(0.0)).alias("avg_rows_per_claim"),
        F.coalesce(F.max("rows_per_claim"), F.lit(0)).alias("max_rows_per_claim"),
    )


def replica_stats(outbox: DataFrame, replicas: DataFrame) -> DataFrame:
    """Claims per replica in ``replicas.claimed_by``; replicas without claims show zeros.

    Rows collapse per (replica, claim time) first, then per replica.
    """
    batches = (
        outbox.where("claimed_by IS NOT NULL")
        .groupBy("claimed_by", "claimed_at")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max(F.when(F.col("status") == "DONE", F.col("processed_at"))).alias("last_done"),
        )
    )
    per_replica = batches.groupBy("claimed_by").agg(
        F.sum("n").alias("claim_count"),
        F.count("claimed_at").alias("batch_claim_count"),
        F.min("claimed_at").alias("first_claim_at"),
        F.max("last_done").alias("last_done_at"),
    )
    return replicas.join(per_replica, "claimed_by", "left").select(
        "claimed_by",
        F.coalesce("claim_count", F.lit(0)).alias("claim_count"),
        F.coalesce("batch_claim_count", F.lit(0)).alias("batch_claim_count"),
        "first_claim_at",
        "last_done_at",
    )


def duplicate_aggregates(outbox: DataFrame) -> DataFrame:
    return (
        outbox.groupBy("aggregate_id")
        .agg(F.count(F.lit(1)).alias("event_count"))
        .where("event_count > 1")
    )


def compare_runs(outbox: DataFrame, case: str) -> DataFrame:
    """One row per value of column ``case``: total time, events per second, lag and claims."""
    done = done_lag(outbox)
    claims = (
        outbox.where("claimed_by IS NOT NULL AND claimed_at IS NOT NULL")
        .groupBy(case, "claimed_by", "claimed_at")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(case)
        .agg(F.count(F.lit(1)).alias("claims"), F.max("n").alias("max_rows_per_claim"))
    )
    span = elapsed_ms(F.min("created_at"), F.max("processed_at"))
    totals = done.groupBy(case).agg(F.count(F.lit(1)).alias("events"), span.alias("total_ms"))
    lag = exact_quantiles(done, "lag_ms", {"p95": 0.95}, [case])
    return (
        totals.join(lag.select(case, F.round("p95", 3).alias("lag_p95_ms")), case)
        .join(claims, case, "left")
        .select(
            case,
            "events",
            "total_ms",
            ratio(F.col("events") * 1000, F.col("total_ms"), 4).alias("events_per_s"),
            "lag_p95_ms",
            "claims",
            "max_rows_per_claim",
        )
    )


# ---- latency -------------------------------------------------------------------------------


def stage_quantiles(lines: DataFrame) -> DataFrame:
    """Nearest-rank quantiles of every stage of the latency lines; unknown (-1) waits count."""
    entries = [
        F.struct(F.lit(s).alias("stage"), F.col(s).cast("double").alias("ms")) for s in STAGES
    ]
    long = lines.select(F.inline(F.array(*entries)))
    return exact_quantiles(long, "ms", QUANTILES, ["stage"], discrete=True)


def counter_delta(samples: DataFrame, start: str, end: str, by: list[str]) -> DataFrame:
    """Counter increase per series between two times, never negative.

    The value at a time is the last sample up to it; a series without one counts from 0.
    """
    t0, t1 = as_time(start, samples, "ts"), as_time(end, samples, "ts")

    def value_at(t):
        return F.coalesce(
            F.max_by("value", F.when(F.col("ts") <= t, F.col("ts"))), F.lit(0.0)
        )

    return (
        samples.where(F.col("ts") <= t1)
        .groupBy(*by)
        .agg(value_at(t0).alias("at_start"), value_at(t1).alias("at_end"))
        .withColumn("increase", F.greatest(F.lit(0.0), F.col("at_end") - F.col("at_start")))
    )


def relay_run_rollup(runs: DataFrame) -> DataFrame:
    """Scheduler runs per instance and result: attempts, rows, claim sizes and duration.

    ``runs`` has (instance_id, processed_rows, batch_attempts, duration_ms).
    """
    labelled = runs.withColumn(
        "result", F.when(F.col("processed_rows") == 0, "empty").otherwise("non_empty")
    )
    by = ["instance_id", "result"]
    totals = labelled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("scheduler_runs"),
        F.sum("batch_attempts").alias("batch_attempts"),
        F.sum("processed_rows").alias("processed_rows"),
    )
    measures = {"claim_rows": "processed_rows", "duration": "duration_ms"}
    long = labelled.select(
        *by,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("measure"), F.col(c).cast("double").alias("v"))
                    for m, c in measures.items()
                ]
            )
        ),
    )
    stats = exact_quantiles(long, "v", {"p50": 0.5, "p95": 0.95}, [*by, "measure"])

    def stat(measure, name):
        return F.round(F.max(F.when(F.col("measure") == measure, F.col(name))), 3)

    wide = stats.groupBy(*by).agg(
        stat("claim_rows", "p50").alias("claim_rows_p50"),
        stat("claim_rows", "p95").alias("claim_rows_p95"),
        stat("duration", "p95").alias("duration_p95_ms"),
    )
    return totals.join(wide, by)


def empty_run_ratio(rollup: DataFrame) -> DataFrame:
    empty = F.sum(F.when(F.col("result") == "empty", F.col("scheduler_runs")).otherwise(0))
    total = F.sum("scheduler_runs")
    return rollup.agg(
        F.coalesce(ratio(empty, total, 6), F.lit(0.0)).alias("empty_run_ratio")
    )


#: Failure reasons of a document-path request.
REASONS = ["TIMEOUT", "HTTP_5XX", "CONNECTION_FAILURE", "MALFORMED_RESPONSE", "CIRCUIT_OPEN"]


def fallback_rollup(requests: DataFrame) -> DataFrame:
    """Fallback counts; an open circuit is a fallback but not a failed search."""
    reason = F.col("failure_reason")
    return requests.agg(
        F.count("failure_reason").alias("fallback_count"),
        F.count_if(reason.isNotNull() & (F.col("status") == 200)).alias("fallback_success_count"),
        F.count_if(reason == "TIMEOUT").alias("timeout_count"),
        F.count_if(reason != "CIRCUIT_OPEN").alias("search_failure_count"),
        F.count_if(reason == "MALFORMED_RESPONSE").alias("invalid_response_count"),
        F.count_if(reason == "CIRCUIT_OPEN").alias("short_circuited_count"),
    )


def latency_rollup(requests: DataFrame) -> DataFrame:
    """Per scenario and in total: requests, share in percent, rate, p95 and failed checks.

    A check fails with any status but 200 and, where the log has both columns, with another number
    of rows than the limit asked for.
    """
    bad = F.col("status") != 200
    if {"returned_count", "limit"} <= set(requests.columns):
        bad = bad | (F.col("returned_count") != F.col("limit"))
    rows = requests.select(
        F.explode(F.array(F.col("scenario"), F.lit("all"))).alias("scenario"),
        "ts",
        "duration_ms",
        bad.alias("bad"),
    )
    totals = rows.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("bad").alias("failed_checks"),
        elapsed_s(F.min("ts"), F.max("ts")).alias("seconds"),
    )
    p95 = exact_quantiles(rows, "duration_ms", {"p95": 0.95}, ["scenario"])
    return totals.join(p95.select("scenario", "p95"), "scenario").select(
        "scenario",
        "requests",
        # A handful of rows, one for each scenario and the total.
        ratio(F.col("requests") * 100, F.max("requests").over(Window.partitionBy()), 4).alias("share_pct"),
        "failed_checks",
        ratio(F.col("requests"), F.col("seconds"), 6).alias("requests_per_s"),
        F.round("p95", 3).alias("p95_ms"),
    )


def summary_json(report: DataFrame) -> DataFrame:
    """Any one-row report as one JSON object in column ``value``."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("value"))
