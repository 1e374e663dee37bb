"""Relay latency log lines as a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The marker and the fields of one log line.
MARKER = "product_search_outbox_indexing_latency"
FIELDS = {
    "eventId": ("event_id", "bigint"),
    "aggregateId": ("aggregate_id", "bigint"),
    "eventType": ("event_type", "string"),
    "resultStatus": ("result_status", "string"),
    "queueWaitMs": ("queue_wait_ms", "bigint"),
    "sourceDocumentLoadMs": ("source_document_load_ms", "bigint"),
    "openSearchWriteMs": ("write_ms", "bigint"),
    "outboxStateTransitionMs": ("state_transition_ms", "bigint"),
    "relayProcessingMs": ("relay_processing_ms", "bigint"),
}
STAGES = [name for name, kind in FIELDS.values() if name.endswith("_ms")]


def parse_latency_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """One typed row per latency line; other lines are skipped, missing numbers become null."""
    tail = F.regexp_extract(F.col(column), MARKER + r"\s+(.*)$", 1)
    pairs = F.str_to_map(tail, F.lit(" "), F.lit("="))
    return (
        lines.where(F.col(column).contains(MARKER))
        .select(pairs.alias("kv"))
        .select(
            *[
                F.try_element_at("kv", F.lit(key)).try_cast(kind).alias(name)
                for key, (name, kind) in FIELDS.items()
            ]
        )
    )


def read_latency_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_latency_log(spark.read.text(path))


def format_latency_log(rows: DataFrame) -> DataFrame:
    """The text form of typed rows, in column ``value``."""
    pairs = [
        F.concat(F.lit(f"{key}="), F.col(name).cast("string"))
        for key, (name, _) in FIELDS.items()
    ]
    return rows.select(F.concat_ws(" ", F.lit(MARKER), *pairs).alias("value"))
