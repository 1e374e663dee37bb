"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words; only the bag has a label. Each passage is encoded from
its hashed byte pairs and a few measures of form into HIDDEN learned values. Gated attention, a tanh
unit times a sigmoid unit, weighs the passages of a document; the weighted sum of their codes is the
document's representation, and a logistic unit scores it. Encoder, attention and score are learned
together from the labels of documents.

Learning takes a bounded sample: about `fit_documents` documents of each label, chosen by a hash of
doc_id, out of the labelled documents that are not held out. Each counts by its label's share among all
of these, so that scores are calibrated to it. In learning only, the bag of a text of more than
FIT_PASSAGES passages is thinned to evenly spaced ones. The sample is learned from in one task and only
the fitted numbers reach the driver. Every document is scored from all passages of its whole text.

Cases: null text counts as empty; an empty text is one passage without words and gets a score; a
doc_id whose labels differ, a null doc_id and a label other than 0 or 1 teach nothing; of rows that
share a doc_id the least text teaches; with labels of one sort only, or none, all scores are
(ones + 1) / (labels + 2); a null doc_id's held_out is false; repeated rows give a row each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import in_batches, portions, table, utf8
from shelfline.llm.language import held_out

PASSAGE_WORDS = 64
#: Cells that byte pairs are hashed into, learned values of a passage, width of the attention.
CELLS, HIDDEN, ATTENTION = 512, 24, 16
#: About so many documents of each label teach, each by at most so many passages.
FIT_DOCUMENTS, FIT_PASSAGES = 800, 256
EPOCHS, LEAST_STEPS, BAGS, RATE, DECAY = 20, 400, 64, 3e-3, 1e-4
SEED = 7
#: Passages encoded at once.
TOGETHER = 2048
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = 10


class Passages:
    """The passages of a list of texts as ranges of one array of bytes."""

    def __init__(self, texts: list[bytes | None]) -> None:
        whole = [(t or b"") + b"\n" for t in texts]
        self.data = np.frombuffer(b"".join(whole), np.uint8)
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        self.last = np.cumsum(sizes) - 1
        space = SPACES[self.data]
        ends = np.flatnonzero(~space[:-1] & space[1:])
        doc = np.searchsorted(self.last, ends)
        words = np.bincount(doc, minlength=len(texts))
        rank = np.arange(len(ends)) - (np.cumsum(words) - words)[doc]
        # A passage starts behind every PASSAGE_WORDS-th word that is not a text's last.
        cut = (rank % PASSAGE_WORDS == PASSAGE_WORDS - 1) & (rank + 1 < words[doc])
        self.starts = np.sort(np.concatenate((self.last - sizes + 1, ends[cut] + 1)))
        self.stops = np.concatenate((self.starts[1:], [len(self.data)]))
        self.counts = np.bincount(np.searchsorted(self.last, self.starts), minlength=len(texts))
        self.words = np.bincount(np.searchsorted(self.starts, ends, side="right") - 1, minlength=len(self.starts))

    def features(self, chosen: np.ndarray) -> np.ndarray:
        """One row for each of the chosen passages: roots of byte-pair shares and measures of form."""
        rows = []
        for i in range(0, len(chosen), TOGETHER):
            part = chosen[i : i + TOGETHER]
            sizes = self.stops[part] - self.starts[part]
            before = np.cumsum(sizes) - sizes
            at = np.repeat(self.starts[part] - before, sizes) + np.arange(sizes.sum())
            own = np.repeat(np.arange(len(part)), sizes)
            one = self.data[at]
            two = self.data[np.minimum(at + 1, len(self.data) - 1)]
            # What stands behind a text's end is another text.
            two[np.isin(at, self.last[np.searchsorted(self.last, self.starts[part])], kind="sort")] = NEWLINE
            cell = ((one.astype(np.uint32) * np.uint32(257) + two) * np.uint32(2654435761)) >> np.uint32(23)
            counts = np.bincount(own * CELLS + cell, minlength=len(part) * CELLS).reshape(-1, CELLS)
            words = np.maximum(1, self.words[part])
            form = [
                np.log1p(self.words[part]), sizes / words / 10, np.bincount(own, (one >= 65) & (one <= 90), len(part)) / sizes * 5,
                np.bincount(own, one == NEWLINE, len(part)) / words * 5, (counts > 0).sum(axis=1) / np.minimum(sizes, CELLS),
            ]
            rows.append(np.concatenate((np.sqrt(counts / sizes[:, None]), np.stack(form, axis=1)), axis=1).astype(np.float32))
        return np.concatenate(rows) if rows else np.zeros((0, CELLS + 5), np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Passage encoder, gated attention and score of a bag."""

    def __init__(self, width: int = CELLS + 5, prior: float = 0.5) -> None:
        draw = np.random.default_rng(SEED)

        def start(rows: int, columns: int) -> np.ndarray:
            return draw.normal(0, rows**-0.5, (rows, columns)).astype(np.float32)

        self.center, self.spread = np.zeros(width, np.float32), np.ones(width, np.float32)
        self.weights = {
            "encode": start(width, HIDDEN), "encode_at": np.zeros(HIDDEN, np.float32),
            "value": start(HIDDEN, ATTENTION), "value_at": np.zeros(ATTENTION, np.float32),
            "gate": start(HIDDEN, ATTENTION), "gate_at": np.zeros(ATTENTION, np.float32),
            "attend": start(ATTENTION, 1)[:, 0], "score": start(HIDDEN, 1)[:, 0], "score_at": np.zeros(1, np.float32),
        }
        #: The score of all texts while nothing is learned.
        self.prior, self.fitted = prior, False

    def encoded(self, features: np.ndarray) -> np.ndarray:
        scaled = np.clip((features - self.center) / self.spread, -8, 8)
        return np.tanh(scaled @ self.weights["encode"] + self.weights["encode_at"])

    def pooled(self, codes: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """Attention over the passages of each bag; bag i owns the next counts[i] codes."""
        w, starts, bag = self.weights, np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
        value, gate = np.tanh(codes @ w["value"] + w["value_at"]), sigmoid(codes @ w["gate"] + w["gate_at"])
        energy = (value * gate) @ w["attend"]
        raised = np.exp(energy - np.maximum.reduceat(energy, starts)[bag])
        share = raised / np.add.reduceat(raised, starts)[bag]
        whole = np.add.reduceat(share[:, None] * codes, starts, axis=0)
        return {"value": value, "gate": gate, "share": share, "whole": whole, "logit": whole @ w["score"] + w["score_at"], "bag": bag, "starts": starts}

    def gradients(self, features: np.ndarray, counts: np.ndarray, labels: np.ndarray, cost: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the summed cross entropy, each bag's times its cost."""
        w, codes = self.weights, self.encoded(features)
        p = self.pooled(codes, counts)
        error = (sigmoid(p["logit"]) - labels) * cost
        to_whole = (error[:, None] * w["score"])[p["bag"]]
        to_share = (to_whole * codes).sum(axis=1)
        to_energy = p["share"] * (to_share - np.add.reduceat(p["share"] * to_share, p["starts"])[p["bag"]])
        spread = to_energy[:, None] * w["attend"]
        to_value, to_gate = spread * p["gate"] * (1 - p["value"] ** 2), spread * p["value"] * p["gate"] * (1 - p["gate"])
        to_codes = p["share"][:, None] * to_whole + to_value @ w["value"].T + to_gate @ w["gate"].T
        to_input = to_codes * (1 - codes**2)
        scaled = np.clip((features - self.center) / self.spread, -8, 8)
        return {
            "encode": scaled.T @ to_input, "encode_at": to_input.sum(axis=0), "value": codes.T @ to_value, "value_at": to_value.sum(axis=0),
            "gate": codes.T @ to_gate, "gate_at": to_gate.sum(axis=0), "attend": (p["value"] * p["gate"]).T @ to_energy,
            "score": p["whole"].T @ error, "score_at": error.sum(keepdims=True),
        }

    def fit(self, features: np.ndarray, counts: np.ndarray, labels: np.ndarray, cost: np.ndarray) -> None:
        """Adam over shuffled groups of bags."""
        self.center, self.spread = features.mean(axis=0), features.std(axis=0) + 0.02
        draw, starts = np.random.default_rng(SEED), np.cumsum(counts) - counts
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        groups, step = -(-len(counts) // BAGS), 0
        for _ in range(max(EPOCHS, -(-LEAST_STEPS // groups))):
            for bags in np.array_split(draw.permutation(len(counts)), groups):
                rows = np.concatenate([np.arange(starts[i], starts[i] + counts[i]) for i in bags])
                found = self.gradients(features[rows], counts[bags], labels[bags], cost[bags] / cost[bags].sum())
                step += 1
                for name, weight in self.weights.items():
                    g = found[name].astype(np.float32) + DECAY * weight
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    self.weights[name] = weight - RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
        self.fitted = True

    def score(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, number of passages and place of the passage with most attention of each text."""
        held = Passages(texts)
        if not self.fitted:
            return np.full(len(texts), self.prior), held.counts, np.zeros(len(texts), np.int64)
        every = np.arange(len(held.starts))
        codes = [self.encoded(held.features(every[i : i + TOGETHER])) for i in range(0, len(every), TOGETHER)]
        p = self.pooled(np.concatenate(codes), held.counts)
        order = np.lexsort((-p["share"], p["bag"]))
        return sigmoid(p["logit"].astype(np.float64)), held.counts, order[p["starts"]] - p["starts"]


def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, quality, n, features): the encoded input of each text that teaches, in rows of bytes."""
    for part in portions(batches, "text"):
        held = Passages(utf8(part.column("text")))
        starts = np.cumsum(held.counts) - held.counts
        rows = []
        for start, n in zip(starts.tolist(), held.counts.tolist()):
            step = -(-n // FIT_PASSAGES)
            rows.append(held.features(np.arange(start, start + n, step)))
        arrays = [part.column("doc_id"), part.column("quality"), pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "quality", "n", "features"])


def learn(docs: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> Network:
    """The network fitted to the labels of documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("q")).where("id is not null and q in (0, 1)")
    known = known.where(~held_out("id")).groupBy("id").agg(F.min("q").alias("quality"), F.max("q").alias("most")).where("quality = most")
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    prior = (sizes.get(1, 0) + 1) / (total + 2)
    if len(sizes) < 2:
        return Network(prior=prior)
    share = F.create_map(*[F.lit(x) for q, n in sizes.items() for x in (q, min(1.0, fit_documents / n))])
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(1 << 20)
    # About 2 * fit_documents ids.
    chosen = F.broadcast(known.where(place < share[F.col("quality")]).select("id", "quality"))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = found.join(chosen, F.col("doc_id") == F.col("id")).groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0])
        network = Network(prior=prior)
        marks = np.array([r[1] for r in rows], np.float64)
        if 0 < marks.sum() < len(marks):
            features = np.concatenate([np.frombuffer(r[3], np.float32) for r in rows]).reshape(-1, CELLS + 5)
            cost = np.array([sizes[q] / total / (marks == q).mean() for q in (0, 1)])
            network.fit(features, np.array([r[2] for r in rows], np.int64), marks, cost[marks.astype(int)])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(network.__dict__)], pa.binary())], ["fitted"])

    teaching = in_batches(found, bags, "doc_id long, quality int, n long, features binary")
    network = Network(prior=prior)
    fitted = in_batches(teaching.repartition(1), train, "fitted binary").head()
    if fitted:
        network.__dict__.update(pickle.loads(fitted["fitted"]))
    return network


def scored(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, top_passage) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text", 1 << 20):
            score, counts, top = network.score(utf8(part.column("text")))
            arrays = [part.column("doc_id"), part.column("held_out"), *map(pa.array, (score, (score >= 0.5).astype(np.int32), counts, top))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted", "n_passages", "top_passage"])

    chosen = docs.select(F.col("doc_id").cast("long"), held_out("doc_id").alias("held_out"), F.col("text").cast("string"))
    return in_batches(chosen, run, "doc_id long, held_out boolean, score double, predicted int, n_passages long, top_passage long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, learn(docs, table(spark, sf_dir, "labels")))
