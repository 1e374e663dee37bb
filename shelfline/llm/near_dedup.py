"""Near-duplicate documents by SimHash fingerprints and a Gray-order hierarchical index.

Fingerprints follow the fixed recipe: ASCII lower case, words between ASCII white space, 3-word
shingles with repeats (a shorter text is one shingle, a text without words has fingerprint zero),
XXH64 with seed 42, a bit for each majority. Two documents are linked if their fingerprints differ
in at most two bits.

Only distinct fingerprints are compared, so copies cost nothing. Two bits cannot touch all three
blocks of a fingerprint, hence each is sent to three places, once by each block's value, and all
links between fingerprints that share the block are found there. In a place, fingerprints are
sorted by Gray rank; runs of neighbours share upper nodes that keep the bits common to the run.
A pair of nodes is dropped when the bits known of both already differ too much, with all pairs of
fingerprints below it.

Cases: null text is a text without words; null doc_id takes part as a document of its own rows but
never is the smallest id while another exists; repeated rows and ties share one fingerprint; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import components, in_batches, portions, table, utf8, written
from shelfline.llm.simhash import majority

LIMIT = 2
SHINGLE_WORDS = 3
SEED = 42
#: First bit (from the top) and width of each block; more blocks than differing bits.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Children of an upper node.
FAN = 8
#: Node pairs that are expanded together.
FRONTIER = 20_000


def shingle_hashes(text: bytes) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    if len(words) < SHINGLE_WORDS:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    runs = map(b" ".join, zip(words, words[1:], words[2:]))
    return list(map(xxhash.xxh64_intdigest, runs, repeat(SEED)))


def fingerprint_texts(texts: list[bytes | None]) -> np.ndarray:
    """Unsigned 64-bit fingerprints of texts."""
    hashed = [shingle_hashes(t or b"") for t in texts]
    counts = np.array([len(h) for h in hashed], np.int64)
    flat = np.fromiter((h for row in hashed for h in row), np.uint64, int(counts.sum()))
    return majority(flat, counts)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text"):
            found = fingerprint_texts(utf8(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return in_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def near_pairs(codes: np.ndarray, lead: int, limit: int = LIMIT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of distinct codes with equal bits under `lead` that differ in at most `limit` bits.

    `codes` are in Gray order. Level 0 of the index holds the codes; a node above holds the bits
    that are one in all (`ones`) or in any (`some`) of its children.
    """
    levels = [(codes, codes)]
    while len(levels[-1][0]) > 1:
        ones, some = levels[-1]
        at = np.arange(0, len(ones), FAN)
        levels.append((np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(some, at)))
    held = np.uint64(lead)
    grid_a, grid_b = (x.ravel() for x in np.meshgrid(np.arange(FAN), np.arange(FAN), indexing="ij"))
    root = np.zeros(1, np.int64)
    waiting = [(len(levels) - 1, root, root)] if len(levels) > 1 else []
    while waiting:
        level, left, right = waiting.pop()
        if len(left) > FRONTIER:
            waiting += [(level, left[i : i + FRONTIER], right[i : i + FRONTIER]) for i in range(0, len(left), FRONTIER)]
            continue
        ones, some = levels[level - 1]
        a = (left[:, None] * FAN + grid_a).ravel()
        b = (right[:, None] * FAN + grid_b).ravel()
        fits = (a <= b if level > 1 else a < b) & (b < len(ones)) & (a < len(ones))
        a, b = a[fits], b[fits]
        differ = (ones[a] & ~some[b]) | (ones[b] & ~some[a])
        fits = ((differ & held) == 0) & (np.bitwise_count(differ) <= limit)
        a, b = a[fits], b[fits]
        if level == 1:
            yield codes[a], codes[b]
        elif len(a):
            waiting.append((level - 1, a, b))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the fingerprints of one partition, as few as keep its groups connected."""
    found = [(b.column("block").to_numpy(), b.column("fp").to_numpy()) for b in batches]
    if not found:
        return
    block, codes = (np.concatenate(x) for x in zip(*found))
    codes = codes.view(np.uint64)
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for k, (shift, width) in enumerate(BLOCKS):
        own = codes[block == k]
        if shift:
            own = (own << np.uint64(shift)) | (own >> np.uint64(64 - shift))
        own = own[np.argsort(gray_rank(own), kind="stable")]
        lead = ((1 << width) - 1) << (64 - width)
        for pair in near_pairs(own, lead):
            if shift:
                pair = tuple((x >> np.uint64(shift)) | (x << np.uint64(64 - shift)) for x in pair)
            for a, b in zip(*(x.view(np.int64).tolist() for x in pair)):
                a, b = top(a), top(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    nodes = [(x, top(x)) for x in list(parent)]
    nodes = [x for x in nodes if x[0] != x[1]]
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*nodes)], ["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints (fp) at most LIMIT bits apart, directly or in steps."""
    places = []
    for k, (shift, width) in enumerate(BLOCKS):
        value = F.shiftrightunsigned(F.shiftleft("fp", shift), 64 - width)
        places.append(F.struct(F.lit(k).alias("block"), value.alias("value")))
    sent = distinct.select("fp", F.explode(F.array(*places)).alias("at")).select("fp", "at.block", "at.value")
    return in_batches(sent.repartition("block", "value").select("block", "fp"), _linked, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    marked = written(spark, fingerprints(docs), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = components(spark, links(distinct.select("fp")))
    rooted = distinct.join(groups, F.col("fp") == F.col("node")).select("fp", "least", "root")
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = rooted.join(of_root, "root").select(F.col("fp").alias("key"), "component_id")
    alone = distinct.join(groups, F.col("fp") == F.col("node"), "left_anti").select(F.col("fp").alias("key"), F.col("least").alias("component_id"))
    return marked.join(moved.unionAll(alone), F.col("fp") == F.col("key")).select("doc_id", "fp", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the documents that are near copies of one with a smaller doc_id; all columns stay.

    A row without doc_id cannot be named and stays; rows that share a doc_id stay or go together.
    """
    found = near_duplicates(spark, docs)
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, table(spark, sf_dir, "documents"))
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", text.alias("fingerprint"), "component_id")
