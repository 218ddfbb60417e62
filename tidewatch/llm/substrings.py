"""Substring dedup by super-k-mers of words.

Every window of twenty words has a minimiser: the least hash of its runs of four words. Consecutive
windows with the same minimiser travel as one packed string to the bucket of that minimiser, so equal
windows meet, and a word travels about three times instead of twenty. A task gathers what it sends to
a bucket in compressed parcels. In a bucket the windows are sorted by hash, equal hashes are compared
as text, and every window but the first of its sequence marks its words.

Hot minimisers: a first pass counts, for each of 65 536 slots of minimisers, the bytes that would
travel. Windows of slots far above the mean travel one by one to the bucket of their own hash instead,
and a task sends each such sequence once, its first occurrence; all others in the task are marked at
once. So a passage that a third of all documents share costs a row per task, and a common line inside
different passages spreads over all buckets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import NO_ID, Block, blocks, keyed, mix, ranges, span_hashes

WINDOW = 20
SLOTS = 1 << 16
#: A slot is hot beyond so many times the mean, and beyond so many bytes.
HOT_TIMES, HOT_BYTES = 4, 64 << 10
#: Bytes of packed strings per bucket, and those a task holds before it sends them.
BUCKET_BYTES, HELD_BYTES = 3 << 20, 24 << 20
#: Bytes of whole texts that meet their marked spans in one group.
HOME_BYTES = 2 << 20
#: Windows of one packed string.
LONGEST = 2_000


def _pairs(h: np.ndarray, reach: int) -> np.ndarray:
    """From hashes of runs of some words to those of runs of ``reach`` more words than their start is apart."""
    return mix(h[: len(h) - reach] * np.uint64(0x9E3779B97F4A7C15) + h[reach:])


def _window_hashes(words: np.ndarray) -> np.ndarray:
    """The hash of the twenty words from each word on, where there are so many."""
    if len(words) < WINDOW:
        return np.zeros(0, np.uint64)
    four = _pairs(_pairs(words, 1), 2)
    sixteen = _pairs(_pairs(four, 4), 8)
    return mix(sixteen[: len(words) - WINDOW + 1] * np.uint64(0xD6E8FEB86659FD93) + four[16 : 16 + len(words) - WINDOW + 1])


def _minimisers(words: np.ndarray) -> np.ndarray:
    """The least hash of four words within the twenty from each word on."""
    if len(words) < WINDOW:
        return np.zeros(0, np.uint64)
    least = _pairs(_pairs(words, 1), 2)
    for reach in (1, 2, 4, 8):
        least = np.minimum(least[: len(least) - reach], least[reach:])
    return np.minimum(least[:-1], least[1:])


@dataclass
class Kmers:
    """The super-k-mers of a block: where each starts, how many windows it has, and its minimiser."""

    block: Block
    packed: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    at: np.ndarray
    windows: np.ndarray
    minimiser: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Kmers:
        block = Block(texts)
        packed, starts, ends = block.pack()
        words = span_hashes(packed, starts, ends)
        least = _minimisers(words)
        owner = block.owner()
        whole = owner[: len(least)] == owner[WINDOW - 1 :] if len(least) else np.zeros(0, bool)
        valid = np.flatnonzero(whole)
        if not len(valid):
            none = np.zeros(0, np.int64)
            return cls(block, packed, starts, ends, words, none, none, none.view(np.uint64))
        new = np.ones(len(valid), bool)
        new[1:] = (np.diff(valid) > 1) | (least[valid[1:]] != least[valid[:-1]]) | (
            owner[valid[1:]] != owner[valid[:-1]]
        )
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate([first, [len(valid)]]))
        parts = -(-size // LONGEST)
        number = ranges(np.zeros(len(size), np.int64), parts)
        at = np.repeat(valid[first], parts) + number * LONGEST
        windows = np.minimum(np.repeat(size, parts) - number * LONGEST, LONGEST)
        return cls(block, packed, starts, ends, words, at, windows, least[at])

    def slots(self) -> np.ndarray:
        """Minimisers are small numbers, so they are mixed once more."""
        return (mix(self.minimiser) >> np.uint64(48)).astype(np.int64)

    def bytes_of(self) -> tuple[np.ndarray, np.ndarray]:
        return self.starts[self.at], self.ends[self.at + self.windows + WINDOW - 2] + 1


def _count_slots(docs: DataFrame) -> np.ndarray:
    """Bytes of packed strings per slot, over all documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for _, texts in blocks(batches):
            kmers = Kmers.of(texts)
            start, end = kmers.bytes_of()
            total += np.bincount(kmers.slots(), weights=end - start, minlength=SLOTS).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "bytes"])

    sums = docs.mapInArrow(run, "slot long, bytes long").groupBy("slot").agg(F.sum("bytes").alias("bytes"))
    out = np.zeros(SLOTS, np.int64)
    table = sums.toArrow()  # a row per slot at most
    out[table.column("slot").to_numpy()] = table.column("bytes").to_numpy()
    return out


PARCEL = "bucket long, doc_ids binary, starts binary, windows binary, text binary, marks binary"


def _parcel(bucket: int, docs: np.ndarray, starts: np.ndarray, windows: np.ndarray, text: bytes, marks: np.ndarray):
    """A row: packed strings, each behind the other, where they come from, and marked spans (doc_id, from, to)."""
    press = zstandard.ZstdCompressor(level=3).compress
    return (
        bucket,
        press(docs.astype("<i8").tobytes()),
        press(starts.astype("<i4").tobytes()),
        press(windows.astype("<i2").tobytes()),
        press(text),
        press(marks.astype("<i8").tobytes()),
    )


def _unpack(column: pa.Array, kind: str | None = None):
    press = zstandard.ZstdDecompressor()
    raw = b"".join(press.decompress(x) for x in column.to_pylist())
    return raw if kind is None else np.frombuffer(raw, kind)


def _spans(docs: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Marked windows (document, start) as spans of words (doc_id, from, to), joined where they overlap."""
    order = np.lexsort((windows, docs))
    docs, windows = docs[order], windows[order]
    if not len(docs):
        return np.zeros((0, 3), np.int64)
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (windows[1:] > windows[:-1] + WINDOW)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(docs)]]) - 1
    return np.column_stack([docs[first], windows[first], windows[last] + WINDOW])


class _Sender:
    """What a task holds for the buckets."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.text: list[bytes] = []
        self.columns: list[tuple[np.ndarray, ...]] = []
        self.hot: dict[bytes, tuple[int, int]] = {}
        self.marked: list[tuple[int, int]] = []
        self.held = 0

    def cold(self, kmers: Kmers, which: np.ndarray, docs: np.ndarray, first: np.ndarray) -> None:
        start, end = kmers.bytes_of()
        raw = kmers.packed.tobytes()
        self.text += [raw[a:b] for a, b in zip(start[which].tolist(), end[which].tolist())]
        owner = np.searchsorted(kmers.block.first, kmers.at[which], side="right") - 1
        bucket = mix(kmers.minimiser[which] + np.uint64(1)) % np.uint64(self.buckets)
        self.columns.append(
            (bucket.astype(np.int64), docs[owner], kmers.at[which] - first[owner], kmers.windows[which])
        )
        self.held += int((end[which] - start[which]).sum()) + 100 * len(which)

    def one_by_one(self, kmers: Kmers, which: np.ndarray, docs: np.ndarray, first: np.ndarray) -> None:
        """Windows of hot slots: the first of each sequence stays to be sent, the others are marked."""
        at = ranges(kmers.at[which], kmers.windows[which])
        owner = np.searchsorted(kmers.block.first, at, side="right") - 1
        raw = kmers.packed.tobytes()
        places = zip(
            kmers.starts[at].tolist(), kmers.ends[at + WINDOW - 1].tolist(), docs[owner].tolist(), (at - first[owner]).tolist()
        )
        for a, b, doc, start in places:
            key = raw[a:b]
            have = self.hot.get(key)
            if have is None:
                self.hot[key] = (doc, start)
                self.held += b - a + 200
            elif (doc, start) < have:
                self.hot[key] = (doc, start)
                self.marked.append(have)
                self.held += 100
            elif (doc, start) > have:
                self.marked.append((doc, start))
                self.held += 100

    def parcels(self) -> Iterator[tuple]:
        none = np.zeros((0, 3), np.int64)
        if self.hot:
            keys = list(self.hot)
            data = np.frombuffer(b"".join(keys), np.uint8)
            ends = np.cumsum([len(k) for k in keys])
            hashes = span_hashes(data, np.concatenate([[0], ends[:-1]]), ends)
            own = np.array(list(self.hot.values()), np.int64)
            self.text += [k + b" " for k in keys]
            self.columns.append(
                ((hashes % np.uint64(self.buckets)).astype(np.int64), own[:, 0], own[:, 1], np.ones(len(keys), np.int64))
            )
        if self.columns:
            bucket, docs, starts, windows = (np.concatenate([c[i] for c in self.columns]) for i in range(4))
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own = order[a:b]
                text = b"".join([self.text[i] for i in own.tolist()])
                yield _parcel(int(bucket[own[0]]), docs[own], starts[own], windows[own], text, none)
        if self.marked:
            spans = np.array(self.marked, np.int64)
            spans = _spans(spans[:, 0], spans[:, 1])
            nothing = np.zeros(0, np.int64)
            # Marked spans only pass through a bucket, any one.
            for at in range(0, len(spans), 20_000):
                part = spans[at : at + 20_000]
                bucket = int(part[0, 1] + part[0, 0]) % self.buckets
                yield _parcel(bucket, nothing, nothing, nothing, b"", part)
        self.clear()


def _send(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    names = [c.split(" ")[0] for c in PARCEL.split(", ")]

    def rows_of(parcels: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        for parcel in parcels:
            part.append(parcel)
            if len(part) == 64:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=names)
                part = []
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(buckets)
        for rows, texts in blocks(batches):
            kmers = Kmers.of(texts)
            if len(kmers.at):
                ids = rows.column("doc_id").to_numpy()
                warm = hot[kmers.slots()]
                sender.cold(kmers, np.flatnonzero(~warm), ids, kmers.block.first)
                sender.one_by_one(kmers, np.flatnonzero(warm), ids, kmers.block.first)
            if sender.held > HELD_BYTES:
                yield from rows_of(sender.parcels())
        yield from rows_of(sender.parcels())

    return docs.mapInArrow(run, PARCEL)


def _repeats(docs: np.ndarray, starts: np.ndarray, windows: np.ndarray, text: bytes) -> np.ndarray:
    """The spans of words in windows of these packed strings whose sequence starts earlier."""
    data = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(data == 0x20)
    begins = np.concatenate([[0], ends[:-1] + 1])
    hashes = _window_hashes(span_hashes(data, begins, ends))
    words = windows + WINDOW - 1
    first = np.cumsum(words) - words
    at = ranges(first, windows)
    own = hashes[at]
    by = np.argsort(own)
    same = own[by][1:] == own[by][:-1]
    alike = np.zeros(len(at), bool)
    alike[by[1:][same]] = alike[by[:-1][same]] = True
    which = np.flatnonzero(alike)
    if not len(which):
        return np.zeros((0, 3), np.int64)
    string = np.repeat(np.arange(len(windows)), windows)[which]
    place = at[which]
    doc, start = docs[string], starts[string] + (place - first[string])
    order = np.lexsort((start, doc, own[which]))
    place, doc, start, group = place[order], doc[order], start[order], own[which][order]
    new = np.concatenate([[True], group[1:] != group[:-1]])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = np.flatnonzero((doc != doc[head]) | (start != start[head]))
    a, b = begins[place], ends[place + WINDOW - 1]
    verdict = np.zeros(len(place), bool)
    verdict[later] = [
        text[p:q] == text[r:s]
        for p, q, r, s in zip(a[later].tolist(), b[later].tolist(), a[head[later]].tolist(), b[head[later]].tolist())
    ]
    for clash in np.unique(head[later[~verdict[later]]]).tolist():
        # Different texts under one hash: each text has its own first window.
        known: dict[bytes, tuple[int, int]] = {}
        for i in range(clash, len(place)):
            if head[i] != clash:
                break
            have = known.setdefault(text[a[i] : b[i]], (doc[i], start[i]))
            verdict[i] = have != (doc[i], start[i])
    return _spans(doc[verdict], start[verdict])


def repeated_spans(docs: DataFrame, homes: int = 1) -> DataFrame:
    """home, doc_id (null as the smallest number), lo and hi: spans of words that windows with an earlier start cover.

    A sequence of twenty words counts as repeated where it also starts in a smaller doc_id or earlier in
    the same one. Spans of one document may overlap. Rows that share a doc_id are one document. ``home``
    deals the documents into so many groups.
    """
    rows = keyed(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    slots = _count_slots(rows)
    hot = slots > max(HOT_BYTES, HOT_TIMES * float(slots.mean()))
    buckets = max(1, -(-int(slots.sum()) // BUCKET_BYTES))
    names = ["home", "doc_id", "lo", "hi"]

    def run(table: pa.Table) -> pa.Table:
        text = _unpack(table.column("text"))
        spans = [_unpack(table.column("marks"), "<i8").reshape(-1, 3)]
        if text:
            spans.append(
                _repeats(
                    _unpack(table.column("doc_ids"), "<i8"),
                    _unpack(table.column("starts"), "<i4").astype(np.int64),
                    _unpack(table.column("windows"), "<i2").astype(np.int64),
                    text,
                )
            )
        found = np.concatenate(spans)
        return pa.table([pa.array(_homes(found[:, 0], homes)), *[pa.array(found[:, i]) for i in range(3)]], names=names)

    return _send(rows, hot, buckets).groupBy("bucket").applyInArrow(run, "home long, doc_id long, lo long, hi long")


def _homes(docs: np.ndarray, homes: int) -> np.ndarray:
    """The group where a document meets its spans."""
    return (mix(docs.astype(np.int64).view(np.uint64)) % np.uint64(homes)).astype(np.int64)


def _text_parcels(docs: DataFrame, homes: int) -> DataFrame:
    """Whole texts by home: home, doc_ids, sizes and texts, compressed together."""
    names = ["home", "doc_ids", "sizes", "texts"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        texts: list[bytes] = []
        held = 0

        def parcels() -> Iterator[pa.RecordBatch]:
            press = zstandard.ZstdCompressor(level=3).compress
            doc = np.concatenate(ids)
            home = _homes(doc, homes)
            order = np.argsort(home, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(home[order]) != 0, [True]])).tolist()
            rows = []
            for a, b in zip(edges[:-1], edges[1:]):
                own = order[a:b]
                part = [texts[i] for i in own.tolist()]
                sizes = np.array([len(t) for t in part], "<i8")
                rows.append((int(home[own[0]]), press(doc[own].astype("<i8").tobytes()), press(sizes.tobytes()), press(b"".join(part))))
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + 64])], names=names)

        for rows, own in blocks(batches):
            ids.append(rows.column("doc_id").to_numpy())
            texts.extend(own)
            held += sum(map(len, own)) + 100 * len(own)
            if held > HELD_BYTES:
                yield from parcels()
                ids, texts, held = [], [], 0
        if ids:
            yield from parcels()

    return docs.mapInArrow(run, "home long, doc_ids binary, sizes binary, texts binary")


def _without(docs: np.ndarray, texts: list[bytes], spans: pa.Table) -> pa.Table:
    """The documents of a home without the words of their spans."""
    block = Block(texts)
    packed, starts, ends = block.pack()
    order = np.argsort(docs, kind="stable")
    own = spans.column("doc_id").to_numpy()
    first = np.searchsorted(docs[order], own, side="left")
    number = np.searchsorted(docs[order], own, side="right") - first
    row = order[ranges(first, number)]
    edge = np.zeros(len(starts) + 1, np.int64)
    for column, step in (("lo", 1), ("hi", -1)):
        word = np.repeat(spans.column(column).to_numpy(), number)
        np.add.at(edge, block.first[row] + np.minimum(word, block.counts[row]), step)
    kept = np.cumsum(edge[:-1]) == 0
    sizes = ends - starts + 1
    raw = packed[np.repeat(kept, sizes)].tobytes()
    behind = np.concatenate([[0], np.cumsum(sizes * kept)])[block.first]
    removed = np.concatenate([[0], np.cumsum(~kept)])[block.first]
    # The space behind the last word goes.
    out = [raw[a : max(a, b - 1)] for a, b in zip(behind[:-1].tolist(), behind[1:].tolist())]
    return pa.table(
        [
            pa.array(docs),
            pa.array(out, pa.binary()).cast(pa.string()),
            pa.array(block.counts.astype(np.int64)),
            pa.array(np.diff(removed)),
        ],
        names=["doc_id", "text", "n_words", "n_removed"],
    )


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """Remove every word that a repeated window of twenty words covers.

    Words lie between ASCII white space and are unchanged. Returns doc_id, text (the words kept, joined
    by one space), n_words and n_removed of every row; a null text has no words, a null doc_id is smaller
    than any other. Rows that share a doc_id are one document: what is marked in one goes from all.
    Other columns are not read.
    """
    rows = keyed(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    homes = max(1, -(-size // HOME_BYTES))

    def finish(parcels: pa.Table, spans: pa.Table) -> pa.Table:
        ids = _unpack(parcels.column("doc_ids"), "<i8")
        sizes = _unpack(parcels.column("sizes"), "<i8")
        raw = _unpack(parcels.column("texts"))
        ends = np.cumsum(sizes)
        texts = [raw[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
        return _without(ids.astype(np.int64), texts, spans)

    spans = repeated_spans(docs, homes)
    done = (
        _text_parcels(rows, homes)
        .groupBy("home")
        .cogroup(spans.groupBy("home"))
        .applyInArrow(finish, "doc_id long, text string, n_words long, n_removed long")
    )
    return done.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
