"""Attention-based quality scores: held-out accuracy, plain forward pass, gradients and edge rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from shelfline.llm import quality
from shelfline.llm.common import table


def plain_passages(text):
    data = ((text or "").encode() + b"\n")
    cuts, words, in_word = [0], 0, False
    total = len(data.split())
    for i, c in enumerate(data):
        space = c in b" \t\n\x0b\x0c\r"
        if in_word and space:
            words += 1
            if words % quality.PASSAGE_WORDS == 0 and words < total:
                cuts.append(i)
        in_word = not space
    return [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)])], data


def plain_features(text):
    passages, data = plain_passages(text)
    rows, at = [], 0
    for p in passages:
        counts = Counter()
        for i in range(at, at + len(p)):
            two = data[i + 1] if i + 1 < len(data) else 10
            counts[(((data[i] * 257 + two) * 2654435761) % (1 << 32)) >> 23] += 1
        words = len(p.split())
        row = [math.sqrt(counts[k] / len(p)) for k in range(quality.CELLS)]
        row += [math.log1p(words), len(p) / max(1, words) / 10, sum(65 <= c <= 90 for c in p) / len(p) * 5, p.count(b"\n") / max(1, words) * 5, len(counts) / min(len(p), quality.CELLS)]
        rows.append(row)
        at += len(p)
    return np.array(rows)


TEXTS = [None, "", "one", " \n ", "a b c " * 100, "Ünïcode wörds HERE. " * 40 + "\n" * 9, "x" * 3000, "w " * 64, "w " * 65, "tail\n" * 129 + "end"]


def test_features_are_those_of_each_text():
    held = quality.Passages([None if t is None else t.encode() for t in TEXTS])
    want = [plain_features(t) for t in TEXTS]
    assert held.counts.tolist() == [len(w) for w in want]
    assert np.allclose(held.features(np.arange(len(held.starts))), np.concatenate(want), atol=1e-6)


def test_score_is_the_plain_weighted_sum():
    network = quality.Network()
    network.fitted = True
    w = {k: v.astype(float) for k, v in network.weights.items()}
    got, counts, top = network.score([None if t is None else t.encode() for t in TEXTS])
    for text, score, n, best in zip(TEXTS, got, counts, top):
        codes = np.tanh(np.clip(plain_features(text), -8, 8) @ w["encode"] + w["encode_at"])
        energy = [sum(math.tanh(c @ w["value"][:, k]) / (1 + math.exp(-(c @ w["gate"][:, k]))) * w["attend"][k] for k in range(quality.ATTENTION)) for c in codes]
        share = np.exp(energy) / np.exp(energy).sum()
        assert score == pytest.approx(1 / (1 + math.exp(-(share @ codes) @ w["score"])), abs=1e-5)
        assert n == len(codes) and share[best] == pytest.approx(share.max(), abs=1e-6)


def test_gradients():
    draw = np.random.default_rng(1)
    network = quality.Network(6)
    network.weights = {k: draw.normal(0, 0.5, v.shape) for k, v in network.weights.items()}
    x, counts, labels, cost = draw.normal(0, 1, (9, 6)), np.array([2, 1, 6]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 0.5, 2.0])

    def loss():
        p = quality.sigmoid(network.pooled(network.encoded(x), counts)["logit"])
        return -(cost * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum()

    for name, found in network.gradients(x, counts, labels, cost).items():
        flat = network.weights[name].reshape(-1)
        for i in range(0, len(flat), 5):
            held = flat[i]
            flat[i] = held + 1e-5
            above = loss()
            flat[i] = held - 1e-5
            below = loss()
            flat[i] = held
            assert found.reshape(-1)[i] == pytest.approx((above - below) / 2e-5, rel=1e-3, abs=1e-6), name


def test_held_out_documents_are_told_apart(spark):
    sf = "/root/testdata/sf0.1"
    marks = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    got = quality.query(spark, sf).collect()
    assert len(got) == table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.predicted, marks[r.doc_id]) for r in got if r.held_out and r.doc_id in marks]
    right = {q: np.mean([p == q for p, m in held if m == q]) for q in (0, 1)}
    assert len(held) > 1000 and right[0] > 0.95 and right[1] > 0.98


def test_edge_rows(spark):
    good, bad = "These are plain words of a text and more of it. " * 9, "BUY!!! now$$$ | " * 30
    rows = [(i, f"{good if i % 2 else bad} {i}") for i in range(120)] + [(None, good), (200, None), (201, ""), (202, good * 3000), (7, "aaa"), (7, "aaa")]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id int, text string, quality string, id double")
    labels = spark.createDataFrame([(i, i % 2, 9) for i in range(120)] + [(5, 0, 1), (None, 1, 1), (3, 7, 0), (7, 1, 1)], "doc_id long, quality int, text int")
    network = quality.learn(docs, labels)
    got = quality.scored(docs, network)
    found = got.collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert by_id[None].predicted == 1 and by_id[None].held_out is False and by_id[202].predicted == 1 and by_id[202].n_passages > 300
    assert by_id[200].score == by_id[201].score
    right = [r.predicted == r.doc_id % 2 for r in found if r.doc_id is not None and r.doc_id < 120 and r.doc_id != 7]
    assert np.mean(right) > 0.95
    assert quality.scored(docs.limit(0), network).count() == 0
    for some, want in ((labels.where("quality = 1"), None), (labels.limit(0), 0.5)):
        alone = quality.learn(docs, some)
        scores = {r.score for r in quality.scored(docs, alone).collect()}
        assert not alone.fitted and len(scores) == 1 and (want is None or scores == {want})
    # Labels without documents teach nothing.
    lost = quality.learn(docs.limit(0), labels)
    assert not lost.fitted
