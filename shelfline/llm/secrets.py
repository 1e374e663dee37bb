"""Secrets in documents: fixed patterns, and a small character network for what they miss.

The base spans are the matches of three patterns, leftmost and non-overlapping for each kind. Every
other long token that holds a digit or changes from lower to upper case is a candidate: the network
reads all its characters and the characters around it, and adds the span, with kind `model`, if its
score reaches the threshold. The network is a one-hot character convolution with a maximum over
positions and a logistic output, in numpy. It learns from the different findings of all documents,
of any length: base spans are secrets, other candidates are not. Every step of the descent sums the gradients of all
of them in Spark, as whole numbers, so the sum does not depend on how rows are dealt out; the driver
holds one gradient. Scores are whole multiples of 1 / GRID; of a quarter of the findings, chosen by a
hash and not learned from, their counts by score fit a slope and an intercept. The highest threshold
that still finds at least RECALL of the secrets held back bounds the choice; the one in force lies
midway between it and the next lower score of another candidate, where no more mistakes are made, and
never below one half.

Cases: null text is empty; a document without findings has zero counts, the digest of the empty
string and empty spans; without enough findings of both sorts nothing is added; null ids and
repeated rows give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import in_batches, portions, table, written

# The base patterns, in the order of their kinds, and the least length of a finding.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20
#: An assignment needs one of these in the lower-cased text.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
MIXED = re.compile(r"[0-9]|[a-z][A-Z]")
#: Characters read before and after a candidate.
AROUND = 16
#: The characters told apart; all others share one more class, and padding has another.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-:'\" \n@"
WIDTH, FILTERS = 5, 16
STEPS, RATE = 60, 0.03
#: Fractions of one in gradients and in scores, and the bound of scores.
PARTS, GRID, BOUND = 1 << 28, 1 << 10, 64
RECALL = 0.98
#: Positions scored together.
CHUNK = 200_000

OTHER, PAD = len(ALPHABET), len(ALPHABET) + 1
CLASSES = len(ALPHABET) + 2
CODES = np.full(128, OTHER, np.uint8)
CODES[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, in order."""
    found = []
    lowered = text.lower()
    if any(w in lowered for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGNED]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the tokens that may be secrets and touch no base span."""
    found = [m.span() for m in CANDIDATE.finditer(text) if MIXED.search(m.group())]
    return [(a, b) for a, b in found if not any(s < b and a < e for s, _, e in base)]


def encoded(text: str, start: int, end: int) -> np.ndarray:
    """Character classes of a span and its surroundings; beyond the text there is padding."""
    cut = text[max(0, start - AROUND) : end + AROUND]
    points = np.frombuffer(cut.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(points < 128, CODES[np.minimum(points, 127)], np.uint8(OTHER))
    before, after = AROUND - min(AROUND, start), AROUND - min(AROUND, len(text) - end)
    return np.concatenate((np.full(before, PAD, np.uint8), codes, np.full(after, PAD, np.uint8)))


class Network:
    """One convolution over one-hot characters, ReLU, maximum over positions, logistic output."""

    def __init__(self, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        self.kernel = draw.normal(0, 0.15, (WIDTH, CLASSES, FILTERS))
        self.shift = np.zeros(FILTERS)
        self.weight = draw.normal(0, 0.3, FILTERS)
        self.bias = np.zeros(1)
        self.slope, self.intercept, self.threshold = 1.0, 0.0, 2.0
        self.steps, self.moments = 0, [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights()]

    def weights(self) -> list[np.ndarray]:
        return [self.kernel, self.shift, self.weight, self.bias]

    def features(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima over positions of a padded batch (row, position), and where they stand.

        Positions beyond a row's own size do not count: its score is the same in any batch. Long rows
        are read some positions at a time, so memory does not grow with a finding's filters.
        """
        span = codes.shape[1] - WIDTH + 1
        top, at = np.full((len(codes), FILTERS), -np.inf), np.zeros((len(codes), FILTERS), np.int64)
        step = max(1, CHUNK // len(codes))
        for start in range(0, span, step):
            stop = min(span, start + step)
            total = self.shift + sum(self.kernel[j][codes[:, start + j : stop + j]] for j in range(WIDTH))
            total[np.arange(start, stop) >= (sizes - WIDTH + 1)[:, None]] = -np.inf
            place = total.argmax(axis=1)
            best = np.take_along_axis(total, place[:, None], axis=1)[:, 0]
            at = np.where(best > top, place + start, at)
            top = np.maximum(best, top)
        return top, at

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        """Scores before calibration, on the grid."""
        result = np.zeros(len(rows))
        for some in alike(rows):
            top, _ = self.features(*padded([rows[i] for i in some]))
            found = (np.maximum(top, 0) * self.weight).sum(axis=1) + self.bias[0]
            result[some] = np.clip(np.rint(found * GRID) / GRID, -BOUND, BOUND)
        return result

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return logistic(self.slope * self.raw(rows) + self.intercept)

    def gradients(self, rows: list[np.ndarray], labels: np.ndarray, balance: tuple[float, float]) -> np.ndarray:
        """The summed gradients of all weights, one after the other, in whole parts."""
        kernel, rest = np.zeros(self.kernel.shape, np.int64), np.zeros(2 * FILTERS + 1, np.int64)
        lanes = np.arange(FILTERS)
        for some in alike(rows):
            codes, sizes = padded([rows[i] for i in some])
            top, at = self.features(codes, sizes)
            active = np.maximum(top, 0)
            error = logistic((active * self.weight).sum(axis=1) + self.bias[0]) - labels[some]
            error *= np.where(labels[some], balance[1], balance[0])
            back = np.rint(error[:, None] * self.weight * (top > 0) * PARTS).astype(np.int64)
            for j in range(WIDTH):
                np.add.at(kernel[j], (np.take_along_axis(codes, at + j, axis=1), lanes), back)
            each = np.rint(np.concatenate((active * error[:, None], error[:, None]), axis=1) * PARTS).astype(np.int64)
            rest += np.concatenate((back.sum(axis=0), each.sum(axis=0)))
        return np.concatenate((kernel.ravel(), rest))

    def descend(self, total: np.ndarray, n: int) -> None:
        """One step of Adam along the summed gradients of n findings."""
        self.steps += 1
        start = 0
        for w, (m, v) in zip(self.weights(), self.moments):
            g = total[start : start + w.size].reshape(w.shape) / (PARTS * n)
            start += w.size
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)

    def train(self, rows: list[np.ndarray], labels: np.ndarray) -> None:
        balance = balanced(int((~labels).sum()), int(labels.sum()))
        for _ in range(STEPS):
            self.descend(self.gradients(rows, labels, balance), len(rows))

    def calibrate(self, raw: np.ndarray, others: np.ndarray, known: np.ndarray) -> None:
        """Fits slope and intercept, then sets the threshold, on counts by ascending score."""
        n = known + others
        for _ in range(500):
            error = (logistic(self.slope * raw + self.intercept) * n - known) / n.sum()
            self.slope = max(1e-3, self.slope - 0.1 * float((error * raw).sum()))
            self.intercept -= 0.1 * float(error.sum())
        scores = logistic(self.slope * raw + self.intercept)
        place = np.searchsorted(known.cumsum(), int((1 - RECALL) * known.sum()), side="right")
        highest = float(scores[place])
        below = scores[(others > 0) & (scores < highest)]
        self.threshold = max(0.5, (highest + float(below.max(initial=0.0))) / 2)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows])
    result = np.full((len(rows), sizes.max()), PAD, np.uint8)
    for i, r in enumerate(rows):
        result[i, : len(r)] = r
    return result, sizes


def alike(rows: list[np.ndarray]) -> Iterator[list[int]]:
    """Positions of rows of like length, to be worked on together."""
    order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop - start + 1) * len(rows[order[stop]]) <= CHUNK:
            stop += 1
        yield order[start:stop]
        start = stop


def balanced(others: int, known: int) -> tuple[float, float]:
    """Weights by which both sorts of findings count the same."""
    n = others + known
    return 0.5 * n / max(others, 1), 0.5 * n / max(known, 1)


def findings(docs: DataFrame) -> DataFrame:
    """(known, codes, held): the different findings of all documents, whole, a quarter of them held back."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text"):
            rows = set()
            for text in part.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = [(True, a, b) for a, _, b in base] + [(False, a, b) for a, b in candidates(text, base)]
                rows |= {(known, encoded(text, a, b).tobytes()) for known, a, b in spans}
            labels, codes = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.bool_()), pa.array(codes, pa.binary())], ["known", "codes"])

    found = in_batches(docs.select(F.col("text").cast("string")), find, "known boolean, codes binary").distinct()
    return found.withColumn("held", F.pmod(F.xxhash64("codes"), F.lit(4)) == 3)


def unpacked(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    rows = [np.frombuffer(c, np.uint8) for c in batch.column("codes").to_pylist()]
    return rows, np.array(batch.column("known").to_pylist(), bool)


def summed_gradients(found: DataFrame, network: Network, balance: tuple[float, float]) -> np.ndarray:
    """The gradients of all findings, summed in every task and then by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = network.gradients(*unpacked(batch), balance)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "parts"])

    table = in_batches(found.select("known", "codes"), run, "place long, parts long").groupBy("place").agg(F.sum("parts").alias("parts")).toArrow()
    return table.column("parts").to_numpy()[np.argsort(table.column("place").to_numpy())]


def held_scores(found: DataFrame, network: Network) -> pa.Table:
    """(raw, others, known): findings by score, at most one row for each score of the grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels = unpacked(batch)
            yield pa.RecordBatch.from_arrays([pa.array(network.raw(rows)), pa.array(labels)], ["raw", "known"])

    scored = in_batches(found.select("known", "codes"), run, "raw double, known boolean")
    counts = scored.groupBy("raw").agg(F.count_if(~F.col("known")).alias("others"), F.count_if("known").alias("known"))
    return counts.toArrow().sort_by("raw")


def learn(docs: DataFrame) -> Network:
    network = Network()
    found = written(docs.sparkSession, findings(docs), "findings")
    counts = {(r.held, r.known): r["count"] for r in found.groupBy("held", "known").count().collect()}
    sizes = {key: counts.get(key, 0) for key in ((False, False), (False, True), (True, False), (True, True))}
    if min(sizes.values()) < 5:
        return network
    fit, held = found.where("NOT held"), found.where("held")
    n = (sizes[False, False], sizes[False, True])
    for _ in range(STEPS):
        network.descend(summed_gradients(fit, network, balanced(*n)), sum(n))
    scored = held_scores(held, network)
    network.calibrate(*(scored.column(c).to_numpy() for c in ("raw", "others", "known")))
    return network


def scan(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            based = [base_spans(t) for t in texts]
            asked = [(i, a, b) for i, (t, base) in enumerate(zip(texts, based)) for a, b in candidates(t, base)]
            spans = [list(base) for base in based]
            if asked and network.threshold <= 1:
                scores = network.score([encoded(texts[i], a, b) for i, a, b in asked])
                for (i, a, b), score in zip(asked, scores):
                    if score >= network.threshold:
                        spans[i].append((a, len(KINDS), b))
            names = (*KINDS, "model")
            joined = [[",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(s)) for s in group] for group in (based, spans)]
            counts = [pa.array([sum(k == kind for _, k, _ in s) for s in spans], pa.int64()) for kind in range(4)]
            digests = pa.array([hashlib.sha256(s.encode()).hexdigest() for s in joined[0]], pa.string())
            arrays = [part.column("doc_id"), *counts[:3], digests, pa.array(joined[1], pa.string()), counts[3]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"])

    shape = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long"
    return in_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, shape)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, learn(docs))
