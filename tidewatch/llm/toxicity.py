"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary texts.

Both are models of the bytes of a word (A-Z lower-cased) behind up to five earlier bytes of it. The
orders above three belong to a class: counts of six bytes, and below them the number of different
bytes seen in front. Orders up to three come from both classes together, so an expression that is
rare in a class falls back on the same numbers in both and says little. As the shared part cancels
out, what is kept per class pair is the difference of the log probabilities of each known n-gram and
of the back-off weights of each context: a text costs one look-up per byte of a new word, and more
only where it falls back.

A text's score comes from the length-normalised difference of its log-likelihoods, over the whole
text and over its most suspicious passage, through a logistic curve fitted on features of sample
rows by counts that have not seen them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import logistic
from .sample import FOLDS, Sample, labelled_sample, remainder
from .texts import BLOCK, Block, blocks, give_back, ranges, span_hashes

ORDER, SHARED = 6, 3
#: Words of a passage, and numbers of most suspicious words that are looked at together.
PASSAGE = 3
TOP = (1, 4, 12)
FEATURES = 3 + len(TOP) + 1
#: So many bytes of ordinary text stand beside a text and beside a passage, so that a few words prove little.
BESIDE, BESIDE_PASSAGE = 64, 16
#: Bounds of the labelled sample: rows and bytes of text per label.
ROWS, SIZE = 6_000, 6 << 20


def _grams(block: Block, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The six bytes that end at each byte of the words and the space behind them, and the first of each word.

    Earlier bytes end at the word's start; spaces stand in their place.
    """
    packed, starts, ends = block.pack()
    if words is not None:
        sizes = ends[words] - starts[words] + 1
        packed = packed[ranges(starts[words], sizes)]
        ends = np.cumsum(sizes) - 1
        starts = ends - sizes + 1
    inside = np.arange(len(packed)) - np.repeat(starts, ends - starts + 1)
    keys = packed.astype(np.uint64)
    for back in range(1, ORDER):
        earlier = np.full(len(packed), 0x20, np.uint64)
        earlier[back:] = packed[:-back]
        earlier[inside < back] = 0x20
        keys |= earlier << np.uint64(8 * back)
    return keys, starts


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts, a column per class."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first, axis=0)


def _discount(times: np.ndarray) -> np.ndarray:
    """Per class what Kneser-Ney takes off a count, from the numbers of n-grams counted once and twice."""
    once, twice = (times == 1).sum(axis=0), (times == 2).sum(axis=0)
    return np.clip(once / np.maximum(once + 2 * twice, 1), 0.5, 0.95)


@dataclass
class Model:
    """Per order from the highest: known n-grams with their log ratio, known contexts with that of the back-off."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    curve: logistic.Curve | None = None
    #: The log ratio per byte of ordinary text.
    ordinary: float = 0.0

    def log_ratios(self, keys: np.ndarray) -> np.ndarray:
        """log toxic - log ordinary probability of the last byte of each key."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        for (known, ratio), (context, back), order in zip(self.grams, self.contexts, range(ORDER, SHARED, -1)):
            if not len(left) or not len(known):
                break
            own = keys[left] & np.uint64((1 << (8 * order)) - 1)
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = known[at] == own
            out[left[hit]] += ratio[at[hit]]
            left, own = left[~hit], own[~hit] >> np.uint64(8)
            at = np.minimum(np.searchsorted(context, own), len(context) - 1)
            out[left] += np.where(context[at] == own, back[at], 0.0)
        return out

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Log ratios of each text over lengths of its own.

        Per byte of the whole text and of its highest passage (each beside some ordinary text), per word of its most suspicious words (of a
        shorter text, per word asked for), the share of words that clearly speak for toxicity, and the
        log of its words.
        """
        out = np.zeros((len(texts), FEATURES))
        out[:, :2] = self.ordinary
        block = Block(texts, lower=True)
        if not len(block.starts):
            return out
        sizes = block.ends - block.starts + 1
        hashes = span_hashes(block.data, block.starts, block.ends)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        keys, begins = _grams(block, first)
        word = np.add.reduceat(self.log_ratios(keys), begins)[which]
        total = np.concatenate([[0.0], np.cumsum(word)])
        length = np.concatenate([[0], np.cumsum(sizes)])
        a, b = block.first[:-1], block.first[1:]
        full = b > a
        beside = BESIDE * self.ordinary
        out[full, 0] = ((total[b] - total[a]) + beside)[full] / ((length[b] - length[a]) + BESIDE)[full]
        owner = block.owner()
        start = np.arange(len(word))
        end = np.minimum(start + PASSAGE, b[owner])
        # The last words of a text lie in the passage before; a shorter text is one passage.
        passage = (total[end] - total[start] + BESIDE_PASSAGE * self.ordinary) / (length[end] - length[start] + BESIDE_PASSAGE)
        passage[(end - start < PASSAGE) & (start != a[owner])] = -np.inf
        out[full, 1] = np.maximum.reduceat(passage, a[full])
        out[:, 2] = np.log1p(b - a)
        best = np.concatenate([[0.0], np.cumsum(word[np.lexsort((-word, owner))])])
        for i, number in enumerate(TOP):
            out[:, 3 + i] = (best[np.minimum(b, a + number)] - best[a]) / number
        clear = np.concatenate([[0], np.cumsum(word > 2)])
        out[full, -1] = (clear[b] - clear[a])[full] / (b - a)[full]
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.curve(self.features(texts))


def count_model(texts: list[bytes], labels: np.ndarray) -> Model:
    """The two models from the counts of labelled texts (column 0 ordinary, 1 toxic)."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held, size = [], 0
    for text, label in [*zip(texts, labels.tolist()), (None, 0)]:
        if text is not None:
            held.append((text, label))
            size += len(text)
        if held and (text is None or size > 1 << 20):
            for label_ in (0, 1):
                keys, _ = _grams(Block([t for t, x in held if x == label_], lower=True))
                if len(keys):
                    own, counts = np.unique(keys, return_counts=True)
                    pair = np.zeros((len(own), 2), np.int32)
                    pair[:, label_] = counts
                    found.append((own, pair))
            # What is counted so far stays small: chunks share most of their n-grams.
            if len(found) > 4:
                found = [_counted(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]))]
            held, size = [], 0
    if not found:
        return Model([], [])
    keys, counts = _counted(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]))
    # Six bytes seen once in all say nothing about a class.
    seen = counts.sum(axis=1) > 1
    tables = {ORDER: (keys[seen], counts[seen])}
    for order in range(ORDER - 1, 0, -1):
        above, times = tables[order + 1] if order + 1 < ORDER else (keys, counts)
        suffix = above & np.uint64((1 << (8 * order)) - 1)
        kinds = (times > 0).astype(np.int64)
        if order == SHARED:
            kinds = np.repeat((times.sum(axis=1) > 0).astype(np.int64)[:, None], 2, axis=1)
        tables[order] = _counted(suffix, kinds)
    lower_keys, lower = None, None
    grams, contexts = [], []
    for order in range(1, ORDER + 1):
        own, times = tables[order]
        context = own >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        which = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(own)]])))
        total = np.add.reduceat(times, first, axis=0)
        kinds = np.add.reduceat((times > 0).astype(np.int64), first, axis=0)
        off = _discount(counts if order == ORDER else times)
        back = np.where(total > 0, off * kinds / np.maximum(total, 1), 1.0)
        if order == 1:
            below = np.full((len(own), 2), 1 / 256)
        else:
            below = lower[np.searchsorted(lower_keys, own & np.uint64((1 << (8 * (order - 1))) - 1))]
        chance = np.maximum(times - off, 0) / np.maximum(total[which], 1) + back[which] * below
        lower_keys, lower = own, chance
        if order > SHARED:
            ratio = np.log(chance)
            grams.append((own, (ratio[:, 1] - ratio[:, 0]).astype(np.float32)))
            backs = np.log(back)
            contexts.append((context[first], (backs[:, 1] - backs[:, 0]).astype(np.float32)))
    return Model(grams[::-1], contexts[::-1])


def _features(model: Model, texts: list[bytes]) -> np.ndarray:
    """Features of many texts, about a block of bytes at a time."""
    out, at = [np.zeros((0, FEATURES))], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
            size += len(texts[end])
            end += 1
        out.append(model.features(texts[at:end]))
        at = end
    return np.concatenate(out)


def train(sample: Sample, folds: int = 5) -> Model:
    """Counts from the whole sample; the curve from features of each fifth by the counts of the others.

    The curve weighs the rows by the share of their label among all training rows.
    """
    y = sample.labels
    if len(set(y.tolist())) < 2:
        return Model([], [], logistic.constant(FEATURES, sample.totals[1] > 0))
    part = np.arange(len(sample.texts)) % folds
    x, ordinary = np.zeros((len(sample.texts), FEATURES)), None
    for fold in range(folds):
        own = part == fold
        held = [t for t, f in zip(sample.texts, own) if f]
        model = count_model([t for t, f in zip(sample.texts, own) if not f], y[~own])
        plain = (y[own] == 0).nonzero()[0]
        if ordinary is None and len(plain):
            # From ordinary rows of the first fold that has any.
            ordinary = float(np.median(_features(model, [held[i] for i in plain])[:, 0]))
        model.ordinary = ordinary or 0.0
        x[own] = _features(model, held)
    ordinary = ordinary or 0.0
    weight = np.array(sample.totals, float)[y] / np.bincount(y, minlength=2)[y]
    curve = logistic.fit(x, y, weight)
    model = count_model(sample.texts, y)
    model.curve, model.ordinary = curve, ordinary
    give_back()
    return model


def score_documents(
    docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), rows: int = ROWS, size: int = SIZE
) -> DataFrame:
    """doc_id, held_out and the toxicity ``score`` of every row, and the columns named in ``keep``.

    Learns from ``labels.toxic`` outside the held-out fold, on a sample of ``rows`` rows and ``size`` bytes
    per label at most. Null and empty texts get a score too. Without labels of both kinds the score is
    that of the kind there is. A null doc_id is not held out.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(labelled_sample(docs, labels, "toxic", rows, size)))

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
