"""SimHash near-duplicates through an inverted index over the bytes of the fingerprints.

A fingerprint has eight bytes. Two that differ in at most four bits differ in at most four bytes,
so they share four positional bytes at least: that is the count a pair must reach. Of any seven
positions they then share three, so the postings are kept per three of the first seven positions
and their bytes; one byte alone would put a 256th of all rows in a list. Inside a list the shared
positional bytes of a pair are tallied, pairs below four are dropped, the rest are verified on
their bits. Fingerprints are indexed once each, however many documents have them.

A list links its members by a spanning forest, never by all pairs. A list of more than
``list_limit`` fingerprints is dealt again by four bytes, and if that is still too long its members
are linked through midpoints: two values at most four bits apart have a value at most two bits
from both, and sharing one proves the link. So no list is cut and none grows in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import components
from .texts import NO_ID, Block, blocks, keyed

BITS = 4
SHARED = 8 - BITS
TRIPLES = list(combinations(range(7), 3))
#: Pairs inside lists up to this length are compared all at once.
SHORT = 8
LIST_LIMIT = 20_000


def _simhash(texts: list[bytes], words: int) -> np.ndarray:
    """The fingerprints of the texts of a block."""
    block = Block(texts, lower=True)
    packed, starts, ends = block.pack()
    raw = packed.tobytes()
    counts = np.where(block.counts >= words, block.counts - words + 1, np.minimum(block.counts, 1))
    out = np.zeros(len(texts), np.uint64)
    own = np.flatnonzero(counts)
    if not len(own):
        return out
    counts = counts[own]
    behind = np.cumsum(counts)
    places = np.arange(behind[-1]) + np.repeat(block.first[own] - (behind - counts), counts)
    last = places + np.repeat(np.minimum(block.counts[own], words) - 1, counts)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(raw[a:b], 42) for a, b in zip(starts[places].tolist(), ends[last].tolist())),
        np.uint64,
        len(places),
    )
    for text, a, b in zip(own.tolist(), (behind - counts).tolist(), behind.tolist()):
        tally = np.zeros(64, np.int64)
        for at in range(a, b, 1 << 16):
            part = hashes[at : min(b, at + (1 << 16))]
            tally += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
                axis=0, dtype=np.int32
            )
        out[text] = np.packbits(2 * tally > b - a, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, row (a hash of the text) and the 64-bit SimHash ``fp`` of every row, as a signed long.

    Words lie between ASCII white space, A-Z lower-cased; features are runs of ``words`` words with
    their repeats, or all words of a shorter text. A null or wordless text has fingerprint zero.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches):
            prints = _simhash(texts, words).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("row"), pa.array(prints)], names=["doc_id", "row", "fp"]
            )

    return keyed(docs).mapInArrow(run, "doc_id long, row long, fp long")


def _near(x: np.ndarray) -> np.ndarray:
    """Of differences: enough shared positional bytes, and few enough bits."""
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    return (shared >= SHARED) & (np.bitwise_count(x) <= BITS)


def _forest(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The links of a spanning forest of a list, per found node: it and those first reached from it."""
    left = values
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            hit = _near(left ^ node)
            if hit.any():
                reached, left = left[hit], left[~hit]
                queue.extend(reached)
                yield node, reached


def _lists(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """The lists of two and more of a task sorted by key: key, values and whether it is a part of one too long."""
    key, parts, size, over = None, [], 0, False

    def done():
        if over:
            yield key, np.concatenate(parts), True
        elif size > 1:
            yield key, np.concatenate(parts), False

    for batch in batches:
        keys, values = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = np.concatenate([[0], cuts, [len(keys)]])
        # Lone rows inside the batch are most of it; only the first and last run may go on elsewhere.
        runs = np.flatnonzero((np.diff(edges) > 1) | (np.arange(len(edges) - 1) == len(edges) - 2))
        for r in sorted({0, *runs.tolist()}) if len(keys) else []:
            a, b = edges[r], edges[r + 1]
            if keys[a] != key:
                if key is not None:
                    yield from done()
                key, parts, size, over = keys[a], [], 0, False
            parts.append(values[a:b])
            size += b - a
            if size > limit:
                yield key, np.concatenate(parts), True
                parts, size, over = [values[:0]], 0, True
    if key is not None:
        yield from done()


def _links(lists: DataFrame, limit: int) -> DataFrame:
    """key, a and b: links inside the lists; of lists beyond the limit their members, a with b null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            keys, a, b = (np.concatenate([x[i] for x in out]) for i in range(3))
            gone = np.concatenate([np.full(len(x[0]), x[3]) for x in out])
            return pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(a.view(np.int64)), pa.array(b.view(np.int64), mask=gone)],
                names=["key", "a", "b"],
            )

        for key, values, over in _lists(batches, limit):
            if over:
                found = [(values, values, True)]
            elif len(values) <= SHORT:
                i, j = np.triu_indices(len(values), 1)
                hit = _near(values[i] ^ values[j])
                found = [(values[i][hit], values[j][hit], False)] if hit.any() else []
            else:
                found = [(np.full(len(reached), node), reached, False) for node, reached in _forest(values)]
            for a, b, gone in found:
                out.append((np.full(len(a), key, np.int64), a, b, gone))
                held += len(a)
            if held > 50_000:
                yield flush()
                out, held = [], 0
        if out:
            yield flush()

    ordered = lists.repartition("key").sortWithinPartitions("key", "fp")
    return ordered.mapInArrow(run, "key long, a long, b long")


def _byte(position: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255))


def _posting(number: int, positions: tuple[int, ...]) -> Column:
    key = F.lit(number).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(p))
    return key


def link_fingerprints(prints: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """a and b: links that connect exactly the distinct values ``fp`` at most four bits apart.

    Values that only midpoints connect appear as nodes of their own.
    """
    postings = prints.select(
        F.explode(F.array(*[_posting(i, c) for i, c in enumerate(TRIPLES)])).alias("key"), "fp"
    )
    found = written(_links(postings, list_limit))
    links = found.filter("b is not null").select("a", "b")
    if found.filter("b is null").isEmpty():
        return links
    # Too long a list: the same three bytes and one more of the other five.
    number = F.shiftrightunsigned("key", 24).cast("int")
    again = found.filter("b is null").select("key", F.col("a").alias("fp"), number.alias("number"))
    deeper = None
    for i, triple in enumerate(TRIPLES):
        others = [p for p in range(8) if p not in triple]
        keys = F.array(*[_posting(i * 8 + p, (*triple, p)) for p in others])
        deeper = F.when(F.col("number") == i, keys) if deeper is None else deeper.when(F.col("number") == i, keys)
    more = written(_links(again.select(F.explode(deeper).alias("key"), "fp").distinct(), list_limit))
    links = links.union(more.filter("b is not null").select("a", "b"))
    rest = more.filter("b is null").select(F.col("a").alias("fp")).distinct()
    masks = [0, *[1 << i for i in range(64)], *[1 << i | 1 << j for i, j in combinations(range(64), 2)]]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    mids = rest.select(
        F.col("fp").alias("a"), F.explode(F.transform(F.lit(signed), lambda m: F.col("fp").bitwiseXOR(m))).alias("b")
    )
    shared = mids.groupBy("b").agg(F.min("a").alias("least"), F.max("a").alias("most")).filter("least < most")
    return links.union(mids.join(shared, "b", "left_semi").select("a", "b"))


def near_duplicates(docs: DataFrame, words: int = 4, list_limit: int = LIST_LIMIT) -> DataFrame:
    """doc_id, row, fp, component_id (smallest doc_id reachable by links) and first of every row.

    ``first`` marks the one document of a component that stands for it: that of the smallest doc_id, of
    rows that share it the smallest ``row``. Repeated rows give repeated results. A null doc_id keeps
    its row and comes last; it names a component only if no member has an id. Other columns of
    ``docs`` are not read.
    """
    prints = written(fingerprints(docs, words))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    nodes = prints.groupBy("fp").agg(F.min(place).alias("least"))
    tree = components.roots(link_fingerprints(nodes.select("fp"), list_limit))
    labelled = nodes.join(tree.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    labelled = written(labelled)
    named = labelled.groupBy("root").agg(F.min("least").alias("least"))
    names = labelled.select("fp", "root").join(named, "root").select("fp", "least")
    return prints.join(names, "fp").select(
        "doc_id",
        "row",
        "fp",
        F.col("least.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("row") == F.col("least.row"))).alias("first"),
    )


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that stand for their component in ``found``, rows alike in all columns once."""
    gone = found.filter("not first").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("own_id"), "row").distinct()
    text = F.col("text").cast("string")
    keyed_ = docs.withColumns({"own_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "row": F.xxhash64(text)})
    return keyed_.join(gone, ["own_id", "row"], "left_anti").drop("own_id", "row").dropDuplicates()


def digits(fp: Column) -> Column:
    """A fingerprint as 16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
