"""Language of documents by rank-order n-gram profiles and out-of-place distance.

A profile lists the most frequent 1- to 3-grams of letters in lower case; words are padded with a
space at both ends, and anything but letters separates words. A document's distance to a language
is the sum, over the n-grams of its own profile, of how far the ranks lie apart, and the profile
length for n-grams the language does not list. The nearest language wins, ties go to the lesser
name. The score is one less the distance over the largest one possible.

Profiles are learned from a bounded sample: about `fit_documents` documents of each language, chosen
by a hash of doc_id, out of the labelled documents that are not held out. Every document is
predicted from its whole text.

Cases: null text or text without a letter is `und` with score 0; null lang is never learned from;
without any labelled document everything is `und`; a null doc_id is held out of learning and its
held_out is false; repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import in_batches, portions, table

UNKNOWN = "und"
#: N-grams kept in a profile.
PROFILE = 400
#: About so many documents of each language teach its profile.
FIT_DOCUMENTS = 1000
#: In the pipeline, documents with a lesser score are rejected.
MIN_SCORE = 0.2
SPACE = 32
#: Bits that hold a code point.
POINT = 21


def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_codes(text: str, letters: np.ndarray) -> np.ndarray:
    """All 1- to 3-grams of a text, each as its code points packed into a long."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.concatenate(([SPACE], np.where(letters[points], points, SPACE), [SPACE]))
    # One space between words.
    points = points[np.concatenate(([True], (points[1:] != SPACE) | (points[:-1] != SPACE)))]
    if len(points) < 3:
        return np.zeros(0, np.int64)
    pairs = points[:-1] | points[1:] << POINT
    threes = points[:-2] | points[1:-1] << POINT | points[2:] << 2 * POINT
    return np.concatenate((points[points != SPACE], pairs, threes[points[1:-1] != SPACE]))


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[starts], np.diff(np.concatenate((starts, [len(codes)])))


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes in order of rank; equal counts in order of code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:size]


class Profiles:
    """Language profiles, sorted by language name, as one table of code -> rank in each."""

    def __init__(self, ranks: dict[str, list[int]]) -> None:
        self.languages = sorted(ranks)
        self.codes = np.array(sorted({c for codes in ranks.values() for c in codes}), np.int64)
        self.ranks = np.full((len(self.codes) + 1, len(self.languages)), -1, np.int64)
        for k, name in enumerate(self.languages):
            self.ranks[np.searchsorted(self.codes, ranks[name]), k] = np.arange(len(ranks[name]))

    def predict(self, text: str | None, letters: np.ndarray) -> tuple[str, float]:
        codes = gram_codes(text or "", letters)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        own = ranked(*counted(codes))
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        known = self.ranks[np.where(self.codes[at] == own, at, len(self.codes))]
        distance = np.where(known < 0, PROFILE, np.abs(known - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(distance))
        return self.languages[best], 1 - float(distance[best]) / (PROFILE * len(own))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> Profiles:
    """Profiles from the labelled documents of docs that are not held out."""
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Profiles({})
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, fit_documents / n))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        found: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for part in portions(batches, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                for code, n in zip(*(x.tolist() for x in counted(gram_codes(text, letters)))):
                    found[lang][code] += n
        for lang, counts in found.items():
            arrays = [pa.array([lang] * len(counts), pa.string()), pa.array(counts, pa.int64()), pa.array(counts.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "code", "n"])

    sample = usable.where(place < share[F.col("lang")]).select("lang", "text")
    grams = in_batches(sample, count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    entry = F.struct((-F.col("n")).alias("n"), "code")
    top = grams.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, PROFILE).alias("top"))
    return Profiles({r["lang"]: [x["code"] for x in r["top"]] for r in top.collect()})


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for part in portions(batches, "text"):
            found = [profiles.predict(t, letters) for t in part.column("text").to_pylist()]
            arrays = [part.column("doc_id"), part.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score"])

    chosen = docs.select(F.col("doc_id").cast("long"), held_out("doc_id").alias("held_out"), F.col("text").cast("string"))
    return in_batches(chosen, run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame) -> DataFrame:
    """docs without the documents of no or no known language; all columns stay.

    Rejected are texts without a letter and texts far from every language (score below MIN_SCORE).
    """
    profiles = learn(docs)
    kept = [f.name for f in docs.schema.fields]
    mark = "verdict"
    while mark in kept:
        mark += "_"

    @F.pandas_udf("boolean")
    def known(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        letters = letter_table()
        for part in texts:
            found = (profiles.predict(t, letters) for t in part)
            yield pd.Series([lang != UNKNOWN and score >= MIN_SCORE for lang, score in found], dtype=bool)

    if not profiles.languages:
        return docs.where(F.lit(False))
    return docs.withColumn(mark, known(F.col("text"))).where(F.col(mark)).select(*kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs))
