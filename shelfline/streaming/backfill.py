"""Backfill of documents in id windows, with a checkpoint after every commit of some windows."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.operators.paging import id_windows
from shelfline.operators.readmodels import documents
from shelfline.sources.snapshots import SnapshotStore, get_lines, put_text
from shelfline.streaming.relay import Source


@dataclass(frozen=True)
class Checkpoint:
    run_id: str
    last_id: int | None
    batch_size: int
    status: str  # RUNNING or COMPLETED
    batches: int = 0
    processed: int = 0
    retried: int = 0
    #: Batches that are committed together; chosen when the run begins.
    per_commit: int = 1


class CheckpointLog:
    """Checkpoints as one small file each; the last one counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def last(self) -> Checkpoint | None:
        found = [json.loads(line) for line in get_lines(self.spark, f"{self.root}/*")]
        if not found:
            return None
        return Checkpoint(**max(found, key=lambda c: (c["batches"], c["status"] == "COMPLETED")))

    def write(self, checkpoint: Checkpoint) -> Checkpoint:
        name = f"{checkpoint.batches:09d}-{checkpoint.status}"
        put_text(self.spark, f"{self.root}/{name}", json.dumps(asdict(checkpoint)))
        return checkpoint


#: A run commits at most about so many times, however many batches it has.
COMMITS = 64


def backfill(
    spark: SparkSession,
    source: Source,
    store: SnapshotStore,
    checkpoint_dir: str,
    run_id: str,
    batch_size: int,
    now: str,
    max_batches: int | None = None,
    write=None,
    commits: int = COMMITS,
) -> Checkpoint:
    """Indexes all products, or resumes after the last checkpoint of this folder.

    The plan of windows with at most ``batch_size`` products is a table beside the checkpoints.
    Neighbouring windows are committed together, in at most ``commits`` groups of a run, so neither
    the number of jobs nor what the driver holds grows with the products; each group is one Spark
    job over its id range, which reaches the file scans of products and options, and one
    checkpoint. A group that fails is tried once more. The store knows each group by its range and
    rows, so one that was committed before its checkpoint was written is not applied twice, and one
    that has grown since is. ``max_batches`` ends this call after so many batches.
    """
    log = CheckpointLog(spark, checkpoint_dir)
    state = log.last()
    if state is not None and state.status == "COMPLETED":
        return state
    write = write or (lambda docs, keys, name: store.apply_changes(docs, None, name))
    products, options = source.products(), source.options()
    at = F.lit(now).cast("timestamp_ntz")
    plan = plan_table(products, batch_size, state, log.root)
    first, last = plan.agg(F.min("batch"), F.max("batch")).first()
    if state is None:
        per_commit = 1 if last is None else -(-(last + 1) // commits)
        state = log.write(Checkpoint(run_id, None, batch_size, "RUNNING", per_commit=per_commit))
    end = None if last is None or not max_batches else first + max_batches
    for lo, hi, rows, batches in grouped(plan, state.per_commit, end):
        batch = window(products, lo, hi)
        docs = documents(batch, window(options, lo, hi, "product_id"), at)
        name = f"backfill-{state.run_id}-{lo}-{hi}-{rows}"
        retried = 0
        try:
            write(docs, batch.select("id"), name)
        except Exception:
            retried = 1
            write(docs, batch.select("id"), name)
        state = log.write(
            replace(
                state,
                last_id=hi,
                batches=state.batches + batches,
                processed=state.processed + rows,
                retried=state.retried + retried,
            )
        )
    if end is None or end > last:
        state = log.write(replace(state, status="COMPLETED"))
    return state


def plan_table(
    products: DataFrame, batch_size: int, state: Checkpoint | None, root: str
) -> DataFrame:
    """The windows still to do, written anew whenever a run begins or goes on."""
    plan = id_windows(products.select("id"), batch_size, state and state.last_id)
    path = f"{root}-plan/{state.batches if state else 0:09d}"
    plan.write.mode("overwrite").parquet(path)
    return products.sparkSession.read.schema(plan.schema).parquet(path)


def grouped(plan: DataFrame, per_commit: int, end: int | None) -> list[tuple]:
    """(lo, hi, rows, batches) of each commit, in order; as many rows as the run has commits."""
    chosen = plan if end is None else plan.where(F.col("batch") < end)
    commit = F.call_function("div", F.col("batch"), F.lit(per_commit))
    found = chosen.groupBy(commit.alias("commit")).agg(
        F.min("lo"), F.max("hi"), F.sum("rows"), F.count(F.lit(1))
    )
    return [tuple(r)[1:] for r in found.orderBy("commit").collect()]


def window(rows: DataFrame, lo: int, hi: int, key: str = "id") -> DataFrame:
    return rows.where(F.col(key).between(lo, hi))
