"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfline.session import shared_dir


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(spark: SparkSession, df: DataFrame, purpose: str) -> DataFrame:
    """Cuts the lineage by a table in the shared folder, which outlives a lost executor."""
    path = shared_dir(spark, purpose)
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def in_batches(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], shape: str | StructType) -> DataFrame:
    """Rows mapped in Arrow batches that Spark bounds by bytes, however long single texts are.

    The bound is a session setting; it is set here only where the session has none.
    """
    conf = rows.sparkSession.conf
    if conf.get(BATCH_BYTES, None) is None:
        conf.set(BATCH_BYTES, "32m")
    return rows.mapInArrow(run, shape)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The strings of an Arrow column as their UTF-8 bytes."""
    return pc.cast(column, pa.binary()).to_pylist()


def portions(batches: Iterator[pa.RecordBatch], text: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds about `size` bytes of text, or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b) as rows (node, root), root the least node.

    Alternates the large-star and small-star steps: each links the neighbours of a node to the
    least of them, so the links shrink to one star per component in a logarithmic number of
    rounds. Minima are aggregated before they move, and the join back to the links is one that
    adaptive execution can split, so a node with very many links is no single task's work.
    Nodes without links have no row; null ends are left out.
    """
    kept = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    kept = written(spark, kept.distinct(), "links")
    before = None
    while True:
        both = kept.unionAll(kept.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(spark, large.where("a <> b").distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        kept = written(spark, small.distinct(), "links")
        mark = kept.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
    roots = kept.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(kept.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
