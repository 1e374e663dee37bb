"""Importance resampling of documents towards a target corpus, by hashed n-gram counts.

Words are runs of letters a-z, digits and all non-ASCII characters, after A-Z are lower-cased (WORD).
Features are all runs of one to three consecutive words of a text, joined by one space; a feature's
bucket is the CRC-32 of its bytes modulo BUCKETS. Raw and target corpora give the share of each bucket;
a bucket's gain is the logarithm of target share over raw share, in whole thousandths. A document's
weight is the sum of the gains of its features, its score the weight plus a Gumbel draw seeded by
doc_id, and the highest scores are drawn: sampling without replacement in proportion to the weights.

Texts are taken in batches. The texts of a batch are joined into one string of bytes with separators;
a single regex pass finds the words of all of them, and a search of the words' places in the sorted
text offsets gives each word's text. N-grams whose words lie in different texts are masked out before
the buckets are counted. A word's checksum is continued over the words behind it, so a feature costs
one call and no joining.

Each task sends one count per bucket, whatever it reads. What the driver holds is one table of BUCKETS
gains. Ranks need no single sorted partition: scores are range-partitioned and written, rows are
numbered inside their partition and moved on by the counts of the partitions before it.

Cases: null and empty texts have no features, weight zero and are never drawn; documents with fewer
than `least_words` words are never drawn; a null doc_id draws as the text "null" and ranks after others
of its score; repeated rows give a row each and take a rank each; an empty table gives no rows; an
empty target makes all gains follow the smoothing alone; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.llm.common import in_batches, portions, table, utf8, written

#: Fixed value: bytes of a word, upper case already lowered.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BUCKETS = 10_000
LONGEST = 3
SEED = 42
PERCENT = 5
LEAST_WORDS = 20
SEPARATOR = b"\n"


def batch_features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, bucket) of every feature of the texts, and the count of words of each text."""
    texts = [t or b"" for t in texts]
    joined = SEPARATOR.join(texts).lower()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + len(SEPARATOR)
    offsets = np.cumsum(sizes) - sizes
    words, starts = [], []
    for found in WORD.finditer(joined):
        words.append(found[0])
        starts.append(found.start())
    owner = np.searchsorted(offsets, np.array(starts, np.int64), side="right") - 1
    owners, buckets = [], []
    sums = list(map(crc32, words))
    behind = [b" " + w for w in words]
    for n in range(LONGEST):
        if n:
            # The checksum of a run goes on from that of the run without its last word.
            sums = list(map(crc32, behind[n:], sums))
        within = owner[n:] == owner[: len(owner) - n]
        owners.append(owner[n:][within])
        buckets.append((np.array(sums, np.int64)[within] % BUCKETS))
    return np.concatenate(owners), np.concatenate(buckets), np.bincount(owner, minlength=len(texts))


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts lie in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for part in portions(batches, "text"):
            total += np.bincount(batch_features(utf8(part.column("text")))[1], minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    found = in_batches(texts.select(F.col("text").cast("string")), run, "bucket long, n long")
    total = np.zeros(BUCKETS, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r["bucket"]] = r["n"]
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed target share over its raw share."""
    s, t = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """docs with `text` replaced by n_words, n_features and weight."""
    kept = docs.select("doc_id", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text"):
            owner, bucket, words = batch_features(utf8(part.column("text")))
            features = np.bincount(owner, minlength=len(words))
            # Sums of whole numbers below 2**53 are exact in doubles.
            weight = np.bincount(owner, gain[bucket], len(words)).astype(np.int64)
            arrays = [part.column("doc_id"), *map(pa.array, (words, features, weight))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_features", "weight"])

    return in_batches(kept, run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: F.Column, seed: int = SEED) -> F.Column:
    """Whole thousandths of a standard Gumbel draw that depends on doc_id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(spark: SparkSession, rows: DataFrame, most: int) -> DataFrame:
    """rows with `rank`: from 1 for the `most` of highest score, ties to the smaller doc_id; null for others."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # The partition of a row is written with it, so later jobs see one and the same division.
    dealt = written(spark, rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "by-score")
    sizes = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect())
    ahead = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    reached = [(part, n) for (part, _), n in zip(sizes, ahead) if n < most]
    last = reached[-1][0] if reached else -1
    starts = spark.createDataFrame(reached, "of_part int, ahead long")
    numbered = dealt.where(F.col("part") <= last).withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    place = F.col("place") + F.col("ahead")
    drawn = numbered.join(starts, F.col("part") == F.col("of_part")).select(*rows.columns, F.when(place <= most, place).alias("rank"))
    rest = dealt.where(F.col("part") > last).select(*rows.columns, F.lit(None).cast("long").alias("rank"))
    return drawn.unionAll(rest)


def importance(
    spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of docs; rank is null if not drawn."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = weighed(docs, gains(bucket_counts(docs), bucket_counts(target)))
    rows = written(spark, rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "weighed")
    may = F.col("n_words") >= least_words
    short = rows.where(~may).withColumn("rank", F.lit(None).cast("long"))
    return ranked(spark, rows.where(may), percent * rows.where(may).count() // 100).unionAll(short)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: The checksum byte by byte, by a table made from the polynomial 0xEDB88320, once per different feature.
CHECK = """
WITH RECURSIVE steps AS (
  SELECT i AS byte, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) r(i)
  UNION ALL
  SELECT byte, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), lookup AS (
  SELECT list(c ORDER BY byte) AS t FROM steps WHERE k = 8
), texts AS (
  SELECT 0 AS target, row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT 1, -row_number() OVER (), NULL,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark
), runs AS (
  SELECT target, row, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS feature
  FROM texts
), counted AS (
  SELECT target, row, feature, count(*) AS n FROM runs GROUP BY ALL
), names AS (
  SELECT feature, hex(encode(feature)) AS x FROM counted GROUP BY feature
), hashed AS (
  SELECT feature, xor(4294967295, list_reduce(
    list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), CAST(4294967295 AS BIGINT))) % 10000 AS bucket
  FROM names, lookup
), held AS (
  SELECT target, row, bucket, sum(n) AS n FROM counted JOIN hashed USING (feature) GROUP BY ALL
), shares AS (
  SELECT b AS bucket, coalesce(sum(n) FILTER (target = 0), 0) AS s, coalesce(sum(n) FILTER (target = 1), 0) AS t
  FROM range(10000) r(b) LEFT JOIN held ON held.bucket = b GROUP BY b
), sums AS (
  SELECT sum(s) AS all_s, sum(t) AS all_t FROM shares
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1.0::DOUBLE) * (all_s + 10000)) / ((s + 1.0::DOUBLE) * (all_t + 10000)))) AS BIGINT) AS g
  FROM shares, sums
), weights AS (
  SELECT row, sum(n) AS n_features, sum(n * g) AS weight FROM held JOIN gain USING (bucket) WHERE target = 0 GROUP BY row
), scored AS (
  SELECT texts.row, doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((
      CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM texts LEFT JOIN weights ON weights.row = texts.row WHERE target = 0
), placed AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE words >= 20
)
SELECT scored.doc_id, CAST(scored.n_features AS BIGINT) AS n_features, CAST(scored.weight AS BIGINT) AS weight,
  CAST(scored.score AS BIGINT) AS score, CASE WHEN place <= (SELECT 5 * count(*) // 100 FROM placed) THEN place END AS rank
FROM scored LEFT JOIN placed ON placed.row = scored.row
"""
