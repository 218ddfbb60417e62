"""Scoring documents with a gated recurrent language model.

Counts first: every training token of the corpus is counted by word in Spark. The words with at least a
4 000 000th of all tokens go to the tasks with their counts, the most frequent ones up to ``WORD_BYTES`` in
all; rarer words are looked up by a join. Every text is looked up once: what the network takes of it is
written, and both training and scoring read that. The network (``gru``) knows the 511 most frequent words and the end of a text as
words of their own, in classes of like frequency; all other words belong to the class of their shape,
and within it a word has the share of its count, with one place for words never seen.

Training goes over every token of every training document once, in three rounds, at every size of the
corpus: each task trains from the same weights on its own documents (truncated back-propagation), and the
weights are averaged by tokens, in Spark. Scoring runs whole documents side by side and carries the state from window to window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import gru
from .sample import remainder
from .texts import Block, blocks, byte_set, give_back

FOLDS, HELD_OUT = 7, 2
#: Words that go to the tasks have this share of all tokens at least, and so many bytes at most, each and in all.
LEAST_SHARE, LONGEST, WORD_BYTES = 4_000_000, 64, 24 << 20
#: Bytes of text whose words are looked up at once; tokens that are trained on or scored at once.
TEXTS, CHUNK = 4 << 20, 2_000_000
#: Shares of the training documents in eighths, and the learning rates, of the rounds of training.
ROUNDS = ((1, 0.01), (3, 0.007), (4, 0.003))
SHAPES = 36

_WORDLIKE = byte_set([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_STOPS = byte_set(b".,")


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The shape of words: first byte, last byte, characters beyond ASCII, length."""
    wide = np.concatenate([[0], np.cumsum(data >= 0x80)])
    last = data[ends - 1]
    kind = np.where(_WORDLIKE[last], 0, np.where(_STOPS[last], 1, 2))
    size = ends - starts
    length = (size > 4).astype(np.int64) + (size > 8)
    shape = kind * 2 + _WORDLIKE[data[starts]]
    shape = shape * 2 + (wide[ends] > wide[starts])
    return shape * 3 + length


class Tokens:
    """The words of texts, lower-cased, and where each text ends."""

    def __init__(self, texts: list[bytes]):
        block = Block(texts, lower=True)
        self.block = block
        sizes = block.ends - block.starts
        bounds = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=bounds[1:])
        raw = np.ascontiguousarray(block.data[block.member])
        self.words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]
        )

    def shapes(self) -> np.ndarray:
        return _shapes(self.block.data, self.block.starts, self.block.ends)


def word_counts(docs: DataFrame) -> DataFrame:
    """word and c over all words of all texts; the empty word is the end of a text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        held = 0

        def merged() -> pa.Table:
            table = pa.concat_tables(parts).group_by("word").aggregate([("c", "sum")])
            return table.select(["word", "c_sum"]).rename_columns(["word", "c"])

        for _, texts in blocks(batches, TEXTS):
            found = Tokens(texts).words.value_counts()
            parts.append(pa.table([found.field("values"), found.field("counts")], names=["word", "c"]))
            parts.append(pa.table([pa.array([b""], pa.large_binary()), pa.array([len(texts)], pa.int64())], names=["word", "c"]))
            held += len(found)
            if held > 1_000_000:
                parts = [merged()]
                held = parts[0].num_rows
                if held > 500_000:
                    yield from parts[0].cast(small).combine_chunks().to_batches(20_000)
                    parts, held = [], 0
        if parts:
            yield from merged().cast(small).combine_chunks().to_batches(20_000)

    small = pa.schema([("word", pa.binary()), ("c", pa.int64())])
    rows = docs.select(F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The words that go to the tasks, the most frequent first; the end of a text is the first of all."""

    words: pa.Array
    counts: np.ndarray
    #: Training tokens and words of each shape beyond the words the network knows.
    shape_tokens: np.ndarray
    shape_words: np.ndarray
    tokens: int
    types: int

    @classmethod
    def of(cls, counts: DataFrame) -> Vocabulary:
        total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        least = max(1, -(-total["n"] // LEAST_SHARE))
        power = F.floor(F.log2(F.greatest("c", F.lit(1)).cast("double"))).cast("int")
        # A row per power of two; a word has its bytes, an offset and a count.
        sizes = counts.filter(F.octet_length("word") <= LONGEST).groupBy(power.alias("power")).agg(F.sum(F.octet_length("word") + 16).alias("bytes"))
        room = WORD_BYTES
        for row in sorted(sizes.collect(), key=lambda r: -r["power"]):
            room -= row["bytes"]
            if room < 0:
                least = max(least, 2 << row["power"])
                break
        often = counts.filter((F.col("c") >= least) & (F.octet_length("word") <= LONGEST)).select("word", "c").toArrow()
        often = often.sort_by([("c", "descending"), ("word", "ascending")]).combine_chunks()
        words = often.column("word").combine_chunks().cast(pa.large_binary())
        amounts = often.column("c").combine_chunks().to_numpy()
        named = pc.binary_length(words).to_numpy() > 0
        ends = amounts[~named].tolist()
        words, amounts = words.filter(pa.array(named)), amounts[named]
        if not ends:
            ends = [r["c"] for r in counts.filter(F.octet_length("word") == 0).collect()] or [0]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens, words = np.zeros(SHAPES), np.zeros(SHAPES)
            for batch in batches:
                own = Block(batch.column("word").to_pylist())
                shape = _shapes(own.data, own.starts, own.ends)
                tokens += np.bincount(shape, weights=batch.column("c").to_numpy(), minlength=SHAPES)
                words += np.bincount(shape, minlength=SHAPES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(SHAPES, dtype=np.int32)), pa.array(tokens.astype(np.int64)), pa.array(words.astype(np.int64))],
                names=["shape", "tokens", "words"],
            )

        sums = counts.filter(F.octet_length("word") > 0).mapInArrow(run, "shape int, tokens long, words long")
        shape_tokens, shape_words = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
        for r in sums.groupBy("shape").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect():
            shape_tokens[r["shape"]], shape_words[r["shape"]] = r["tokens"], r["words"]
        if len(words):
            known = words.slice(0, gru.WORDS - 1).to_pylist()
            own = Block(known)
            shape = _shapes(own.data, own.starts, own.ends)
            shape_tokens -= np.bincount(shape, weights=amounts[: len(known)], minlength=SHAPES).astype(np.int64)
            shape_words -= np.bincount(shape, minlength=SHAPES)
        return cls(
            pa.concat_arrays([pa.array([b""], pa.large_binary()), words]),
            np.concatenate([[ends[0]], amounts]).astype(np.int64),
            shape_tokens,
            shape_words,
            int(total["n"]),
            int(total["v"]),
        )

    def network(self) -> gru.Network:
        """Untrained weights whose constants are the shares of classes and words."""
        head = np.zeros(gru.WORDS)
        head[: min(gru.WORDS, len(self.counts))] = self.counts[: gru.WORDS]
        head = head.reshape(gru.WORD_CLASSES, gru.PER_CLASS)
        classes = np.concatenate([head.sum(axis=1), self.shape_tokens]) + 0.01
        inner = head + 0.01
        return gru.Network.fresh(
            SHAPES, np.log(classes / classes.sum()), np.log(inner / inner.sum(axis=1, keepdims=True))
        )

    def lookup(self, texts: list[bytes]) -> Looked:
        """The tokens of texts as the network takes them, with the ends, and their places in this vocabulary."""
        tokens = Tokens(texts)
        at = pc.index_in(tokens.words, value_set=self.words).fill_null(-1).to_numpy()
        shape = tokens.shapes()
        head = (at >= 0) & (at < gru.WORDS)
        inputs = np.where(head, at, gru.WORDS + shape).astype(np.int16)
        behind = tokens.block.first[1:]
        inputs = np.insert(inputs, behind, 0)
        place = np.insert(at, behind, 0)
        bounds = np.concatenate([[0], behind + np.arange(1, len(texts) + 1)])
        return Looked(tokens, place, inputs, bounds)


@dataclass
class Looked:
    tokens: Tokens
    place: np.ndarray
    inputs: np.ndarray
    bounds: np.ndarray


def _targets(inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each token and the place of a known word in it."""
    inputs = inputs.astype(np.int32)
    known = inputs < gru.WORDS
    classes = np.where(known, inputs // gru.PER_CLASS, inputs - gru.WORDS + gru.WORD_CLASSES)
    return classes, np.where(known, inputs % gru.PER_CLASS, -1)


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and bounds of several blocks as one."""
    shift = np.cumsum([0, *[len(i) for i, _ in parts]])
    bounds = np.concatenate([[0], *[b[1:] + s for (_, b), s in zip(parts, shift)]])
    return np.concatenate([i for i, _ in parts]), bounds


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray]]]:
    """Looked-up documents with their inputs and bounds."""
    for batch in batches:
        raw = batch.column("inputs").to_pylist()
        bounds = np.concatenate([[0], np.cumsum([len(r) // 2 for r in raw])])
        yield batch, (np.frombuffer(b"".join(raw), "<i2"), bounds)


def train(looked: DataFrame, vocabulary: Vocabulary) -> gru.Network:
    """The network after all rounds over looked-up documents (columns part, 0 to 7, and inputs)."""
    context = looked.sparkSession.sparkContext
    net = vocabulary.network()
    # The untrained network alone, without the words.
    fresh = context.broadcast(net)
    size = net.flat().size
    low = 0
    for eighths, rate in ROUNDS:
        weights = context.broadcast(net.flat())

        def run(batches: Iterable[pa.RecordBatch], weights=weights, rate=rate) -> Iterator[pa.RecordBatch]:
            trainer = gru.Trainer(fresh.value.filled(weights.value))
            parts, held, total = [], 0, 0

            def learn() -> None:
                inputs, bounds = _joined(parts)
                trainer.train(bounds, inputs, *_targets(inputs), rate)

            for _, part in _read(batches):
                parts.append(part)
                held += len(part[0])
                total += len(part[0])
                if held >= CHUNK:
                    learn()
                    parts, held = [], 0
            if held:
                learn()
            if total:
                flat = trainer.net.flat().astype("<f8") * total
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([TaskContext.get().partitionId() % 64], pa.int32()),
                        pa.array([total], pa.int64()),
                        pa.array([flat.tobytes()], pa.binary()),
                    ],
                    names=["slot", "tokens", "weights"],
                )
            give_back()

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, tokens = np.zeros(size), 0
            for batch in batches:
                for n, raw in zip(batch.column("tokens").to_pylist(), batch.column("weights").to_pylist()):
                    total += np.frombuffer(raw, "<f8")
                    tokens += n
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tokens], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["tokens", "weights"]
                )

        part = looked.filter((F.col("part") >= low) & (F.col("part") < low + eighths)).select("inputs")
        low += eighths
        trained = part.mapInArrow(run, "slot int, tokens long, weights binary")
        sums = trained.repartition(64, "slot").mapInArrow(add, "tokens long, weights binary").collect()  # 64 rows at most
        if sums:
            tokens = sum(r["tokens"] for r in sums)
            net = net.filled(sum(np.frombuffer(r["weights"], "<f8") for r in sums) / tokens)
    return net


LOOKED = (
    "rid long, doc_id long, held_out boolean, part int, n_known long, logs double, own double, inputs binary, word binary, n long"
)
LOOKED_SCHEMA = pa.schema(
    [("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("part", pa.int32()), ("n_known", pa.int64()),
     ("logs", pa.float64()), ("own", pa.float64()), ("inputs", pa.binary()), ("word", pa.binary()), ("n", pa.int64())]
)


def look_up(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """A row per document with its inputs and what its task knows of it, and a row per rarer word of it (word, n)."""
    words = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_words = words.value
        logs = np.log10(own_words.counts + 1.0)
        inside = np.log10(own_words.shape_tokens + own_words.shape_words + 1.0)
        rid = TaskContext.get().partitionId() << 40
        for batch, texts in blocks(batches, TEXTS):
            looked = own_words.lookup(texts)
            place, bounds = looked.place, looked.bounds
            number = len(texts)
            doc = np.repeat(np.arange(number), np.diff(bounds))
            found = place >= 0
            value = np.where(found, logs[place], 0.0)
            beyond = place >= gru.WORDS
            rare = looked.inputs >= gru.WORDS
            cost = np.zeros(len(place))
            cost[rare] = inside[looked.inputs[rare].astype(np.int64) - gru.WORDS]
            rids = rid + np.arange(number)
            rid += number
            raw = looked.inputs.astype("<i2").tobytes()
            ends = (2 * bounds).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rids),
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    batch.column("part"),
                    pa.array(np.bincount(doc, weights=found & (own_words.counts[place] > 0), minlength=number).astype(np.int64)),
                    pa.array(np.bincount(doc, weights=value, minlength=number)),
                    pa.array(np.bincount(doc, weights=np.where(beyond, value, 0.0) - cost, minlength=number)),
                    pa.array([raw[a:b] for a, b in zip(ends, ends[1:])], pa.binary()),
                    pa.nulls(number, pa.binary()),
                    pa.nulls(number, pa.int64()),
                ],
                schema=LOOKED_SCHEMA,
            )
            # The other words, each once per document.
            at = np.flatnonzero(place[np.delete(np.arange(len(place)), bounds[1:] - 1)] < 0)
            if len(at):
                names = looked.tokens.words.take(pa.array(at)).dictionary_encode()
                owner = looked.tokens.block.owner()[at]
                pairs, times = np.unique(
                    owner * len(names.dictionary) + names.indices.to_numpy(), return_counts=True
                )
                which = names.dictionary.take(pa.array(pairs % len(names.dictionary))).cast(pa.binary())
                nothing = [pa.nulls(len(pairs), f.type) for f in list(LOOKED_SCHEMA)[1:8]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rids[pairs // len(names.dictionary)]), *nothing, which, pa.array(times.astype(np.int64))],
                    schema=LOOKED_SCHEMA,
                )

    return rows.mapInArrow(run, LOOKED)


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, own double"


def _scored(looked: DataFrame, net: gru.Network) -> DataFrame:
    """What a task knows of its documents, with the network's part."""
    context = looked.sparkSession.sparkContext
    trained = context.broadcast(net)
    kept = ("rid", "doc_id", "held_out", "n_known", "logs", "own")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        waiting: list[pa.RecordBatch] = []

        def scores() -> Iterator[pa.RecordBatch]:
            inputs, bounds = _joined(parts)
            nn = gru.score_documents(trained.value, bounds, inputs, *_targets(inputs)) / np.log(10)
            rows = pa.Table.from_batches(waiting).combine_chunks()
            columns = {name: rows.column(name) for name in kept}
            columns["own"] = pa.array(rows.column("own").to_numpy() + nn)
            columns["n_tokens"] = pa.array(np.diff(bounds))
            names = [f.split(" ")[0] for f in SCORED.split(", ")]
            yield from pa.table({name: columns[name] for name in names}).to_batches()

        for batch, part in _read(batches):
            parts.append(part)
            waiting.append(batch.select(list(kept)))
            if sum(len(i) for i, _ in parts) >= CHUNK:
                yield from scores()
                parts.clear()
                waiting.clear()
        if parts:
            yield from scores()
        give_back()

    return looked.select(*kept, "inputs").mapInArrow(run, SCORED)


def score_documents(docs: DataFrame) -> DataFrame:
    """The log10 probability of every text under the trained model and under add-one word shares.

    Tokens are words between ASCII white space, A-Z lower-cased, and one end per text; a null text is
    empty. Rows whose crc32(doc_id) modulo 7 is 2 are held out of counts and training; a null doc_id is
    not. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row. A
    word never seen in training has the one place of its class that is kept for all of them, as in the
    base. Other columns are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(remainder(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.pmod(F.xxhash64("doc_id"), F.lit(8)).cast("int").alias("part"),
        F.col("text").cast("string").alias("text"),
    )
    counts = written(word_counts(rows.filter("not held_out")))
    vocabulary = Vocabulary.of(counts)
    looked = written(look_up(rows, vocabulary))
    texts = looked.filter("inputs is not null")
    net = train(texts.filter("not held_out"), vocabulary)
    scored = written(_scored(texts, net))
    rare = (
        looked.filter("word is not null")
        .select("rid", "word", "n")
        .join(counts, "word", "left")
        .groupBy("rid")
        .agg(
            F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"),
            F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("log"),
        )
    )
    floor = float(np.log10(vocabulary.tokens + vocabulary.types + 1.0))
    log = F.coalesce("log", F.lit(0.0))
    return scored.join(rare, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + log - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("own") + log).alias("score"),
    )
