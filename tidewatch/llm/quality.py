"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of 32 words. A passage is encoded from its hashed byte trigrams and a
few shares (distinct words, capitals, marks, digits); gated attention gives every passage a weight, and
the weighted sum of the encodings is scored. Labels are known of documents only, so the weights are
learned from those, by back-propagation in numpy over a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .logistic import sigmoid
from .sample import FOLDS, Sample, labelled_sample, remainder
from .texts import Block, blocks, byte_set, give_back, mix, ranges, span_hashes

PASSAGE = 32
BUCKETS, SHARES = 1024, 6
WIDTH, GATE = 32, 16
#: Bounds of the labelled sample: rows and bytes of text per label.
ROWS, SIZE = 4_000, 5 << 20
EPOCHS, BATCH, RATE = 8, 64, 0.003

_CAPITAL = byte_set(range(0x41, 0x5B))
_DIGIT = byte_set(range(0x30, 0x3A))
_MARK = byte_set([*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])
_LOGS = np.log1p(np.arange(256)).astype(np.float32)


def encode_passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram counts (up to 255) and shares of every passage, and the passages per text: one at least."""
    block = Block(texts)
    bags = np.maximum(-(-block.counts // PASSAGE), 1)
    first = np.cumsum(bags) - bags
    total = int(bags.sum())
    counts, shares = np.zeros((total, BUCKETS), np.uint8), np.zeros((total, SHARES), np.float32)
    if not len(block.starts):
        return counts, shares, bags
    packed, starts, ends = block.pack()
    owner = block.owner()
    passage = first[owner] + (np.arange(len(owner)) - block.first[owner]) // PASSAGE
    sizes = ends - starts + 1
    of_byte = np.repeat(passage, sizes)
    code = packed.astype(np.uint64)
    tri = code.copy()
    tri[1:] |= code[:-1] << np.uint64(8)
    tri[2:] |= code[:-2] << np.uint64(16)
    bucket = (mix(tri) >> np.uint64(54)).astype(np.int64)
    flat = np.bincount(of_byte * BUCKETS + bucket, minlength=total * BUCKETS)
    counts[:] = np.minimum(flat, 255).reshape(total, BUCKETS)
    bytes_ = np.maximum(np.bincount(of_byte, minlength=total), 1)
    words = np.maximum(np.bincount(passage, minlength=total), 1)
    for i, table in enumerate((_CAPITAL, _DIGIT, _MARK)):
        shares[:, i] = np.bincount(of_byte, weights=table[packed], minlength=total) / bytes_
    hashes = span_hashes(packed, starts, ends)
    pairs = np.unique(mix(hashes + passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    shares[:, 3] = np.bincount(passage[pairs], minlength=total) / words
    shares[:, 4] = np.log1p(bytes_ / words) / 4
    shares[:, 5] = np.log1p(words) / 4
    return counts, shares, bags


@dataclass
class Model:
    """Encoder (w, b), attention (v, u, a) and score (c, d)."""

    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    d: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)

        def of(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        zero = np.zeros(WIDTH, np.float32)
        return cls(of(BUCKETS + SHARES, WIDTH), zero, of(WIDTH, GATE), of(WIDTH, GATE), of(GATE), of(WIDTH), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.w, self.b, self.v, self.u, self.a, self.c, self.d]

    def forward(self, counts: np.ndarray, shares: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        x = np.concatenate([_LOGS[counts], 4 * shares], axis=1)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True)) + 1e-6
        first = np.cumsum(bags) - bags
        h = np.tanh(3 * (x @ self.w) + self.b)
        left, gate = np.tanh(h @ self.v), sigmoid(h @ self.u)
        energy = (left * gate) @ self.a
        energy = np.exp(energy - np.repeat(np.maximum.reduceat(energy, first), bags))
        weight = energy / np.repeat(np.add.reduceat(energy, first), bags)
        z = np.add.reduceat(weight[:, None] * h, first, axis=0)
        return {"x": x, "h": h, "left": left, "gate": gate, "weight": weight, "z": z, "first": first, "logit": z @ self.c + self.d}

    def gradients(self, run: dict[str, np.ndarray], bags: np.ndarray, y: np.ndarray, importance: np.ndarray) -> list[np.ndarray]:
        h, left, gate, weight = run["h"], run["left"], run["gate"], run["weight"]
        slope = (importance * (sigmoid(run["logit"]) - y) / len(y)).astype(np.float32)
        c, d = run["z"].T @ slope, slope.sum(keepdims=True)
        z = np.repeat(slope[:, None] * self.c, bags, axis=0)
        h_slope = weight[:, None] * z
        own = (z * h).sum(axis=1)
        energy = weight * (own - np.repeat(np.add.reduceat(weight * own, run["first"]), bags))
        a = (left * gate).T @ energy
        both = energy[:, None] * self.a
        left_slope, gate_slope = both * gate * (1 - left * left), both * left * gate * (1 - gate)
        h_slope += left_slope @ self.v.T + gate_slope @ self.u.T
        pre = h_slope * (1 - h * h)
        return [3 * (run["x"].T @ pre), pre.sum(axis=0), h.T @ left_slope, h.T @ gate_slope, a, c, d]

    def score(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.forward(*encode_passages(texts))["logit"].astype(np.float64))


def train(sample: Sample, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Adam over batches of documents; rows weigh by the share of their label among all training rows."""
    model, rng = Model.fresh(seed), np.random.default_rng(seed)
    y = sample.labels.astype(np.float32)
    if len(set(sample.labels.tolist())) < 2:
        model.c[:] = 0
        model.d[:] = 10.0 if sample.totals[1] else -10.0
        return model
    parts, at = [], 0
    while at < len(sample.texts):
        end, size = at, 0
        while end < len(sample.texts) and (end == at or size + len(sample.texts[end]) <= 1 << 20):
            size += len(sample.texts[end])
            end += 1
        parts.append(encode_passages(sample.texts[at:end]))
        at = end
    counts, shares, bags = (np.concatenate([p[i] for p in parts]) for i in range(3))
    first = np.cumsum(bags) - bags
    share = np.array(sample.totals, float) / np.bincount(sample.labels, minlength=2)
    importance = (share / (share @ np.bincount(sample.labels, minlength=2) / len(y)))[sample.labels].astype(np.float32)
    momentum = [[np.zeros_like(p), np.zeros_like(p)] for p in model.parts()]
    # Small samples get as many steps as a few full epochs have.
    epochs = max(epochs, -(-400 * BATCH // max(1, len(y))) if len(y) < 400 * BATCH // epochs else epochs)
    step, last = 0, epochs * -(-len(y) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(y), BATCH):
            own = order[start : start + BATCH]
            rows = ranges(first[own], bags[own])
            run = model.forward(counts[rows], shares[rows], bags[own])
            step += 1
            rate = RATE * min(1.0, 2 * (1 - step / (last + 1)))
            for p, g, m in zip(model.parts(), model.gradients(run, bags[own], y[own], importance[own]), momentum):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.001 * (g * g - m[1])
                p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    give_back()
    return model


def score_documents(
    docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), rows: int = ROWS, size: int = SIZE
) -> DataFrame:
    """doc_id, held_out and the quality ``score`` of every row, and the columns named in ``keep``.

    Learns from ``labels.quality`` outside the held-out fold, on a sample of ``rows`` rows and ``size`` bytes
    per label at most. A null or empty text is one empty passage. Without labels of both kinds the
    score is that of the kind there is. A null doc_id is not held out.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(labelled_sample(docs, labels, "quality", rows, size)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            others = [part.column(f"other_{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(model.value.score(texts)), *others],
                names=["doc_id", "held_out", "score", *[f"other_{i}" for i in range(len(keep))]],
            )

    frame = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(remainder(FOLDS) == 0, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
        *[F.col(c).alias(f"other_{i}") for i, c in enumerate(keep)],
    )
    types = dict(frame.dtypes)
    schema = "doc_id long, held_out boolean, score double" + "".join(
        f", other_{i} {types[f'other_{i}']}" for i in range(len(keep))
    )
    scored = frame.mapInArrow(run, schema)
    return scored.select("doc_id", "held_out", "score", *[F.col(f"other_{i}").alias(c) for i, c in enumerate(keep)])
