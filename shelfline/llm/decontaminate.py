"""Benchmark leaks in documents by a BM25 inverted index of test items with block-max bounds.

Every document is cut into passages of two strides, one stride apart, where a stride is the longest
item's number of words: wherever an item stands, one passage holds it whole. Each passage is a query
against the index of items. A weight is the BM25 weight of a word in an item over the item's sum of
weights, so a score is the share of the item that the passage matches. As in block-max WAND, a
passage whose words' largest weights in any item do not sum up to the threshold is done, a block of
items whose largest weights do not is skipped, and only items of the remaining blocks are scored;
the tests are evaluated for all passages of a portion at once. Every item at or above the threshold
is retrieved and then verified: enough of its 5-word shingles stand in the passage, and enough
different words of its question (all sentences but the last) and of its answer (the last sentence).

The index is built by aggregations and sent to the tasks in shards of at most about ITEMS items;
with more items there are more shards and as many passes over the documents, never a larger
broadcast. Words are runs of word characters in lower case.

Cases: null or wordless texts, of documents or items, match nothing; an item of fewer than five
words is one shingle; equal items of one id count once; repeated documents give their rows again;
null ids are carried along; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import in_batches, portions, table

WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.?!])\s+")
K1, B = 1.2, 0.75
#: Share of an item's BM25 weight that retrieves it.
RETRIEVED = 0.5
SHINGLE_WORDS = 5
#: Least shares of an item's shingles, and of the words of its question and answer.
SIMILAR, PART = 0.8, 0.6
#: Items in an index shard, about, and in a block of it.
ITEMS, BLOCK = 10_000, 8
#: Passages whose block bounds are computed together.
TOGETHER = 2_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def expanded(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges, the number of the range and the position of each element."""
    lengths = ends - starts
    owner = np.repeat(np.arange(len(starts)), lengths)
    first = np.cumsum(lengths) - lengths
    return owner, np.arange(lengths.sum()) - np.repeat(first - starts, lengths)


class Item:
    """What verification needs of a test item."""

    def __init__(self, item_id: int | None, text: str, terms: dict[str, int]) -> None:
        self.item_id = item_id
        ids = [terms[w] for w in words_of(text)]
        self.width = min(SHINGLE_WORDS, len(ids))
        self.shingles = set(zip(*(ids[i:] for i in range(self.width))))
        sentences = [s for s in SENTENCE_END.split(text) if WORD.search(s)]
        self.answer = {terms[w] for w in words_of(sentences[-1])}
        self.question = {terms[w] for s in sentences[:-1] for w in words_of(s)} or self.answer


class Index:
    """Postings by term in blocks of items, with the largest weight of each list and block."""

    def __init__(self, rows: list[tuple[int | None, str, list[tuple[str, float]]]]) -> None:
        rows = sorted(rows, key=lambda r: (len(r[1]), r[1], r[0] is not None, r[0] or 0))
        self.terms = {w: i for i, w in enumerate(sorted({w for _, _, weights in rows for w, _ in weights}))}
        self.items = [Item(item_id, text, self.terms) for item_id, text, _ in rows]
        self.stride = max((len(words_of(text)) for _, text, _ in rows), default=1)
        entries = sorted((self.terms[w], i, x) for i, (_, _, weights) in enumerate(rows) for w, x in weights)
        term, item, weight = (np.array([e[k] for e in entries]) for k in range(3))
        self.item, self.weight = item.astype(np.int64), weight.astype(np.float64)
        self.blocks = -(-len(rows) // BLOCK)
        key = term.astype(np.int64) * self.blocks + self.item // BLOCK
        self.entry = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        self.entry_end = np.append(self.entry[1:], len(key))
        self.entry_block = key[self.entry] % self.blocks
        self.entry_max = np.maximum.reduceat(self.weight, self.entry)
        entry_term = key[self.entry] // self.blocks
        self.list = np.searchsorted(entry_term, np.arange(len(self.terms)))
        self.list_end = np.searchsorted(entry_term, np.arange(len(self.terms)), side="right")
        self.list_max = np.maximum.reduceat(self.entry_max, self.list)

    def retrieve(self, owner: np.ndarray, term: np.ndarray, passages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all scores that reach RETRIEVED; (owner, term) are distinct."""
        sums = np.bincount(owner, self.list_max[term], passages)
        kept = sums[owner] >= RETRIEVED
        owner, term = owner[kept], term[kept]
        at, entry = expanded(self.list[term], self.list_end[term])
        cell = owner[at] * self.blocks + self.entry_block[entry]
        sums = np.bincount(cell, self.entry_max[entry], passages * self.blocks)
        kept = sums[cell] >= RETRIEVED
        entry, at = entry[kept], at[kept]
        inner, posting = expanded(self.entry[entry], self.entry_end[entry])
        cell = owner[at[inner]] * len(self.items) + self.item[posting]
        cells, place = np.unique(cell, return_inverse=True)
        scores = np.bincount(place, self.weight[posting], len(cells))
        cells, scores = cells[scores >= RETRIEVED], scores[scores >= RETRIEVED]
        return cells // len(self.items), cells % len(self.items), scores

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, float, float, float, float, int]]:
        """(text, item, score, overlap, question and answer overlap, first word of the passage), one for each text and item."""
        get = self.terms.get
        known = [np.array([get(w, -1) for w in words_of(t)], np.int64) for t in texts]
        sizes = np.array([len(k) for k in known], np.int64)
        strides = -(-sizes // self.stride)
        first = np.cumsum(strides) - strides
        text, place = expanded(np.zeros(len(texts), np.int64), sizes)
        term = np.concatenate(known) if known else np.zeros(0, np.int64)
        segment = first[text] + place // self.stride
        owned = term >= 0
        pairs = np.unique(segment[owned] * len(self.terms) + term[owned])
        segment, term = pairs // len(self.terms), pairs % len(self.terms)
        total = int(strides.sum())
        bound = np.bincount(segment, self.list_max[term], total)
        of_text = np.repeat(np.arange(len(texts)), strides)
        # A passage starts at each segment but a text's last, unless that is its only one.
        last = np.concatenate((of_text[1:] != of_text[:-1], [True]))[:total] if total else np.zeros(0, bool)
        alone = strides[of_text] == 1
        following = np.where(last, 0.0, np.append(bound[1:], 0.0)) if total else bound
        starts = np.flatnonzero((~last | alone) & (bound + following >= RETRIEVED))
        begin, end = np.searchsorted(segment, starts), np.searchsorted(segment, np.where(last[starts], starts, starts + 1), side="right")
        best: dict[tuple[int, int], tuple] = {}
        for i in range(0, len(starts), TOGETHER):
            owner, at = expanded(begin[i : i + TOGETHER], end[i : i + TOGETHER])
            distinct = np.unique(owner * len(self.terms) + term[at])
            found = self.retrieve(distinct // len(self.terms), distinct % len(self.terms), len(starts[i : i + TOGETHER]))
            for passage, item, score in zip(*(x.tolist() for x in found)):
                start = int(starts[i + passage])
                k = int(of_text[start])
                word = (start - int(first[k])) * self.stride
                verified = self.verify(self.items[item], known[k][word : word + 2 * self.stride].tolist())
                if verified:
                    best[k, item] = max(best.get((k, item), ()), (verified[0], score, *verified[1:], -word))
        return [(k, item, x[1], x[0], x[2], x[3], -x[4]) for (k, item), x in sorted(best.items())]

    @staticmethod
    def verify(item: Item, passage: list[int]) -> tuple[float, float, float] | None:
        held = set(zip(*(passage[i:] for i in range(item.width))))
        overlap = len(item.shingles & held) / len(item.shingles)
        if overlap < SIMILAR:
            return None
        question, answer = (len(part.intersection(passage)) / len(part) for part in (item.question, item.answer))
        return (overlap, question, answer) if question >= PART and answer >= PART else None


def weighted_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, text, weights) of distinct items with words; weights are (word, share of the item's BM25 sum)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text"):
            rows = []
            for item_id, text in zip(part.column("item_id").to_pylist(), part.column("text").to_pylist()):
                words = words_of(text)
                rows += [(item_id, text, w, words.count(w), len(words)) for w in dict.fromkeys(words)]
            types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            columns = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["item_id", "text", "word", "tf", "size"])

    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").distinct()
    counts = in_batches(items, count, "item_id long, text string, word string, tf long, size long")
    totals = counts.select("item_id", "text", "size").distinct().agg(F.count("*"), F.avg("size")).first()
    if not totals[0]:
        return counts.limit(0).groupBy("item_id", "text").agg(F.collect_list(F.struct("word", F.lit(0.0).alias("w"))).alias("weights"))
    n, size = totals
    spread = counts.groupBy(F.col("word").alias("of_word")).agg(F.count("*").alias("df"))
    idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    bm25 = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(size)))
    rows = counts.join(spread, F.col("word") == F.col("of_word")).select("item_id", "text", "word", bm25.alias("w"))
    grouped = rows.groupBy("item_id", "text").agg(F.sum("w").alias("total"), F.collect_list(F.struct("word", "w")).alias("raw"))
    shares = F.transform("raw", lambda x: F.struct(x["word"].alias("word"), (x["w"] / F.col("total")).alias("w")))
    return grouped.select("item_id", "text", shares.alias("weights"))


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap, first_word) of every leaked item of each document."""
    weighted = weighted_items(benchmark)
    shards = -(-benchmark.count() // ITEMS) or 1
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shape = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double, first_word long"
    names = ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap", "first_word"]
    result = None
    for shard in range(shards):
        own = weighted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard).collect()
        if not own:
            continue
        sent = spark.sparkContext.broadcast(Index([(r["item_id"], r["text"], [(x["word"], x["w"]) for x in r["weights"]]) for r in own]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for part in portions(batches, "text"):
                found = index.leaks(part.column("text").to_pylist())
                taken = pa.array([x[0] for x in found], pa.int64())
                items = pa.array([index.items[x[1]].item_id for x in found], pa.int64())
                rest = [pa.array([x[k] for x in found], pa.int64() if k == 6 else pa.float64()) for k in range(2, 7)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(taken), items, *rest], names)

        found = in_batches(chosen, run, shape)
        result = found if result is None else result.unionAll(found)
    return spark.createDataFrame([], shape) if result is None else result


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item; all columns stay.

    A row without doc_id cannot be named and stays.
    """
    leaked = leaks(spark, docs, benchmark).select(F.col("doc_id").alias("leaked_id")).distinct()
    return docs.join(leaked, docs["doc_id"] == leaked["leaked_id"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
