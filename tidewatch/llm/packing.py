"""Best-fit packing planned on the histogram of piece lengths.

Documents become token ids once, in tasks; what goes on is a row per piece with its length. The plan
needs the histogram alone: lengths fall from the longest, and each takes the fullest open sequences
it still fits in, whole groups of equal sequences at a time. It names slots by length and rank, so
it has as many rows as groups, whatever the number of documents. Pieces then take their slots by a
join on their rank within their length; the ranks come from counts per task, so no length is
numbered in one place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written
from .spans import distinct_spans
from .texts import Block, blocks, byte_set, ranges

CAPACITY = 2048
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Words a worker keeps the ids of, words that are encoded at once, and bytes of texts of a block.
KEPT_WORDS, TOGETHER, BLOCK_BYTES = 450_000, 256, 2 << 20

_LETTER = byte_set([*range(0x41, 0x5B), *range(0x61, 0x7B)])
#: ASCII digits and marks, without those of contractions and of special tokens.
_MARK = byte_set(set(range(0x21, 0x41)) | set(range(0x5B, 0x61)) | set(range(0x7B, 0x7F))) & ~byte_set(b"'<|>")


def _between(data: np.ndarray) -> np.ndarray:
    """Places where a letter meets a mark; the tokenizer always cuts there."""
    letter, mark = _LETTER[data], _MARK[data]
    return np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1


class WordIds:
    """The token ids of words, each word encoded once while it is kept.

    The tokenizer cuts at white space, lowers the case and cuts between letters and marks, so a text's
    ids are those of its parts in order. Special tokens hold neither white space nor such a cut; in a
    block that may hold one, A-Z stays as it is. The words of a block meet by a hash and are compared byte by
    byte, so only distinct ones are looked up. Beyond ``KEPT_WORDS`` the older half is forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.first = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the words learned last."""
        half = len(self.known) // 2
        self.known = {word: n - half for word, n in self.known.items() if n >= half}
        start = self.first[half]
        self.ids, self.first, self.counts = self.ids[start:].copy(), self.first[half:] - start, self.counts[half:].copy()

    def _learn(self, words: list[bytes]) -> None:
        found, sizes = [], []
        for at in range(0, len(words), TOGETHER):
            part = [w.decode("utf-8") for w in words[at : at + TOGETHER]]
            joined = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            offsets = np.array(joined.offsets, np.int64).reshape(-1, 2)[:, 0]
            sizes.append(np.bincount(np.searchsorted(starts, offsets, side="right"), minlength=len(part)))
            found.append(np.array(joined.ids, np.uint32))
        counts = np.concatenate(sizes)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, *found])
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, an id 0 behind each, and where each text begins, with the end."""
        special = any(b"<|" in text for text in texts)
        block = Block(texts, lower=not special, cuts=_between)
        packed, starts, ends = block.pack()
        which = np.zeros(0, np.int64)
        if len(starts):
            if len(self.known) > KEPT_WORDS:
                self._forget()
            first, number = distinct_spans(packed, starts, ends)
            raw = packed.tobytes()
            words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            new = [w for w in words if w not in self.known]
            if new:
                self._learn(new)
            which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[number]
        counts = self.counts[which]
        behind = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids[ranges(self.first[which], counts)]
        ends = behind[block.first[1:]]
        return np.insert(ids, ends, 0), np.concatenate([[0], ends + np.arange(1, len(texts) + 1)])


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One per worker, as its words outlive a task."""
    return WordIds(path)


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, its task and its rank in there within its length.

    A document is its ids and an id 0; only longer ones than ``capacity`` are cut. The rank depends on
    the order of rows in a task, so the result is to be written before it is used twice.
    """
    extra = ", ids array<int>" if with_ids else ""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = word_ids(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for rows, texts in blocks(batches, BLOCK_BYTES):
            ids, bounds = encoder.encode(texts)
            ids = ids.astype("<u4")
            sizes = np.diff(bounds)
            parts = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), parts)
            number = ranges(np.zeros(len(sizes), np.int64), parts)
            start = number * capacity
            length = np.minimum(sizes[owner] - start, capacity)
            at = bounds[owner] + start
            raw = ids.tobytes()
            sums = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
            by = np.argsort(length, kind="stable")
            counts = np.bincount(length, minlength=capacity + 1)
            rank = np.empty(len(length), np.int64)
            rank[by] = ranges(seen[counts > 0], counts[counts > 0])
            seen += counts
            columns = [
                rows.column("doc_id").take(pa.array(owner)),
                pa.array(number, pa.int32()),
                pa.array(start),
                pa.array(length, pa.int64()),
                pa.array(sums, pa.int64()),
                pa.array(np.full(len(length), task, np.int32)),
                pa.array(rank),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + extra
    )


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """The plan for so many pieces of each length.

    Rows are (length, first rank, rank behind the last, first sequence, offset, pieces a sequence): the
    pieces of these ranks fill the sequences from the first on, so many in each, from the offset on.
    """
    plan, sequences = [], 0
    #: Open sequences by the room left: ranges of numbers, and the rooms in order.
    open_: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def put(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, number))

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, first = capacity, sequences
                number = -(-(count - rank) // (capacity // length))
                sequences += number
            each = room // length
            full = min(number, (count - rank) // each)
            if full:
                plan.append((length, rank, rank + full * each, first, capacity - room, each))
                rank += full * each
                put(room - each * length, first, full)
            rest = count - rank
            if full < number and rest:
                plan.append((length, rank, count, first + full, capacity - room, rest))
                rank = count
                put(room - rest * length, first + full, 1)
                full += 1
            put(room, first + full, number - full)
    return plan


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset for every row of written ``pieces``, instead of task and rank."""
    spark = found.sparkSession
    counts = written(found.groupBy("length", "task").agg(F.count(F.lit(1)).alias("number")))
    # At most as many rows as there are lengths.
    histogram = {r["length"]: r["number"] for r in counts.groupBy("length").agg(F.sum("number").alias("number")).collect()}
    plan = spark.createDataFrame(
        best_fit(histogram, capacity),
        "length long, low long, high long, first long, at long, each long",
    )
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("number").over(before), F.lit(0)))
    slots = bases.join(plan, "length").filter("low < base + number and high > base")
    return (
        found.join(slots, ["length", "task"])
        .withColumn("place", F.col("base") + F.col("rank") - F.col("low"))
        .filter("place >= 0 and place < high - low")
        .withColumn("sequence_id", F.expr("first + place div each"))
        .withColumn("offset", F.expr("at + (place % each) * length"))
        .select(*[c for c in found.columns if c not in ("task", "rank")], "sequence_id", "offset")
    )


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, with_ids: bool = False
) -> DataFrame:
    """Pack documents into as few sequences of at most ``capacity`` tokens as best fit finds.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, the ids. A
    null text is an empty one, a null doc_id stays null, repeated rows are packed each. Other columns
    are not read.
    """
    return pack(written(pieces(docs, capacity, tokenizer, with_ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of each sequence, from a packing with ids. A sequence has ``capacity`` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
