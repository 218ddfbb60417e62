"""Benchmark decontamination with suffix arrays over shards of the training texts.

A task cuts its documents into shards of whole texts and sorts the suffixes of each shard by words,
as deep as the longest benchmark item. Every suffix of the benchmark is then looked up by binary
search: its interval of the suffix array is narrowed word by word, so the interval after a window's
length holds all places of that window. Places found are compared as text and followed to the end
of the longest verbatim match. Documents are never shuffled; the benchmark, whose size is measured
first, goes to the tasks in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import ALNUM, Block, as_bytes, blocks, keyed, ranges, span_hashes

WINDOW = 10
#: Bytes of text in a shard, and bytes of benchmark text that go to the tasks at once.
SHARD = 2 << 20
BENCHMARK_BLOCK = 16 << 20

FOUND = (
    "doc_id long, row long, n_words long, hits array<struct<lo: long, hi: long>>, items array<long>, "
    "longest array<struct<item_id: long, item_word: long, doc_word: long, words: long>>"
)


class Words:
    """The words of texts, packed, with their hashes."""

    def __init__(self, texts: list[bytes]):
        block = Block(texts, ALNUM, lower=True)
        self.first, self.counts = block.first, block.counts
        packed, self.starts, self.ends = block.pack()
        self.hashes = span_hashes(packed, self.starts, self.ends)
        self.text = packed.tobytes()

    def span(self, start: int, words: int) -> bytes:
        return self.text[self.starts[start] : self.ends[start + words - 1]]


@dataclass
class Benchmark:
    """A block of the benchmark, as it goes to the tasks."""

    ids: np.ndarray
    named: np.ndarray
    texts: list[bytes]

    def prepared(self) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, int]:
        """Its words, and per suffix: the item, the words left in it, and the length of its window (0: none)."""
        words = Words(self.texts)
        item = np.repeat(np.arange(len(self.texts)), words.counts)
        behind = (words.first[:-1] + words.counts)[item]
        left = behind - np.arange(len(item))
        size = words.counts[item]
        window = np.where(size >= WINDOW, np.where(left >= WINDOW, WINDOW, 0), np.where(left == size, size, 0))
        return words, item, left, window, int(words.counts.max(initial=0))


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of a row of small positive numbers in order of their first ``depth`` numbers.

    Three numbers make one key at first; then only ties are sorted again, each time by the rank of
    the suffix as far behind as the ranks already reach, so the depth doubles.
    """
    n = len(ids)
    bits = 21 if n and ids.max() < 1 << 21 else 31
    reach = 3 if bits == 21 else 2
    padded = np.concatenate([ids, np.zeros(reach, np.int64)])
    key = padded[:n]
    for d in range(1, reach):
        key = (key << bits) | padded[d : d + n]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    ranks = np.empty(n + 1, np.int64)
    ranks[n] = -1
    group = np.flatnonzero(new)[np.cumsum(new) - 1] if n else np.zeros(0, np.int64)
    ranks[order] = group
    while reach < depth:
        # Places in the order whose group has more than one member.
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        who = order[at]
        key = ranks[who] * (n + 2) + ranks[np.minimum(who + reach, n)] + 1
        by = np.argsort(key)
        key, who = key[by], who[by]
        order[at] = who
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[at] = fresh
        ranks[who] = at[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        reach *= 2
    return order


def search(ids: np.ndarray, order: np.ndarray, wanted: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, ...]:
    """The suffixes of ``wanted`` whose window occurs, with their intervals of the suffix array."""
    n = len(order)
    padded = np.concatenate([ids, np.zeros(1, np.int64)])
    alive = np.flatnonzero(window)
    low, high = np.zeros(len(alive), np.int64), np.full(len(alive), n, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    depth = 0
    while len(alive):
        word = wanted[alive + depth]

        def bound(right: bool, low=low, high=high, word=word, depth=depth) -> np.ndarray:
            a, b = low.copy(), high.copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                value = padded[np.minimum(order[np.minimum(mid, n - 1)] + depth, n)]
                up = open_ & ((value <= word) if right else (value < word))
                a = np.where(up, mid + 1, a)
                b = np.where(open_ & ~up, mid, b)
            return a

        low, high = bound(False), bound(True)
        keep = (low < high) & (word > 0)
        alive, low, high = alive[keep], low[keep], high[keep]
        depth += 1
        full = window[alive] == depth
        if full.any():
            found.append((alive[full], low[full], high[full]))
            alive, low, high = alive[~full], low[~full], high[~full]
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found))


def _matches(shard: Words, test: Words, left: np.ndarray, window: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Per place of a window: the suffix of the benchmark, the word of the shard, the words of the longest match."""
    known, ids = np.unique(shard.hashes, return_inverse=True)
    at = np.minimum(np.searchsorted(known, test.hashes), len(known) - 1)
    wanted = np.where(known[at] == test.hashes, at + 1, 0)
    # Between documents stands 0, which no word of the benchmark has.
    gap = np.zeros(len(ids) + len(shard.counts), np.int64)
    place = np.arange(len(ids)) + np.repeat(np.arange(len(shard.counts)), shard.counts)
    gap[place] = ids + 1
    word_at = np.zeros(len(gap), np.int64)
    word_at[place] = np.arange(len(ids))
    order = suffix_array(gap, depth)
    suffix, low, high = search(gap, order, wanted, window)
    where = order[ranges(low, high - low)]
    suffix = np.repeat(suffix, high - low)
    # The binary search works on hashes of words; what it finds is compared as text.
    same = np.fromiter(
        (
            shard.span(w, k) == test.span(s, k)
            for w, s, k in zip(word_at[where].tolist(), suffix.tolist(), window[suffix].tolist())
        ),
        bool,
        len(where),
    )
    where, suffix = where[same], suffix[same]
    length = window[suffix]
    more = np.arange(len(where))
    gap = np.concatenate([gap, np.zeros(1, np.int64)])
    while len(more):
        next_ = np.minimum(where[more] + length[more], len(gap) - 1)
        can = length[more] < left[suffix[more]]
        test_at = np.minimum(suffix[more] + length[more], len(wanted) - 1)
        more = more[can & (wanted[test_at] > 0) & (gap[next_] == wanted[test_at])]
        length[more] += 1
    return suffix, word_at[where], length


class Finder:
    """Looks a block of the benchmark up in shards of texts."""

    def __init__(self, block: Benchmark):
        self.block = block
        self.test, self.item, self.left, self.window, self.depth = block.prepared()

    def places(self, shard: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per place of a window: the suffix of the benchmark, the word of the shard, the words of the longest match."""
        if len(shard.hashes) and len(self.test.hashes):
            return _matches(shard, self.test, self.left, self.window, self.depth)
        return tuple(np.zeros(0, np.int64) for _ in range(3))


def _scan(block: Benchmark):
    """The task over documents for one block of the benchmark."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(block)
        test, item, window = finder.test, finder.item, finder.window
        for rows, texts in blocks(batches, SHARD):
            shard = Words(texts)
            suffix, word, length = finder.places(shard)
            hit = np.zeros(len(shard.hashes) + 1, np.int64)
            np.add.at(hit, word, 1)
            np.add.at(hit, word + window[suffix], -1)
            hit = np.cumsum(hit)[:-1] > 0
            owner = np.searchsorted(shard.first, word, side="right") - 1
            hits, items, longest = [[] for _ in texts], [[] for _ in texts], [[] for _ in texts]
            for doc in np.unique(owner).tolist():
                start = int(shard.first[doc])
                flags = np.concatenate([[False], hit[start : shard.first[doc + 1]], [False]])
                edges = np.flatnonzero(flags[1:] != flags[:-1]).tolist()
                hits[doc] = [{"lo": a, "hi": b} for a, b in zip(edges[0::2], edges[1::2])]
                own = np.flatnonzero(owner == doc)
                which = item[suffix[own]]
                # The longest match of each item, the first in the document among equals.
                best = own[np.lexsort((word[own], -length[own], which))]
                which = item[suffix[best]]
                best = best[np.concatenate([[True], which[1:] != which[:-1]])]
                which = item[suffix[best]]
                items[doc] = sorted(set(block.ids[which[block.named[which]]].tolist()))
                longest[doc] = [
                    {
                        "item_id": int(block.ids[i]) if block.named[i] else None,
                        "item_word": int(suffix[m] - test.first[i]),
                        "doc_word": int(word[m] - start),
                        "words": int(length[m]),
                    }
                    for m, i in zip(best.tolist(), which.tolist())
                ]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    rows.column("row"),
                    pa.array(shard.counts.astype(np.int64)),
                    pa.array(hits, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
                    pa.array(items, pa.list_(pa.int64())),
                    pa.array(
                        longest,
                        pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "item_word", "doc_word", "words")])),
                    ),
                ],
                names=["doc_id", "row", "n_words", "hits", "items", "longest"],
            )

    return run


def benchmark_blocks(benchmark: DataFrame, limit: int = BENCHMARK_BLOCK) -> list[Benchmark]:
    """The benchmark in blocks of at most ``limit`` bytes of text, or one longer item each."""
    rows = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    sizes = rows.agg(F.sum(F.octet_length("text") + 1).alias("bytes")).first()["bytes"] or 0
    number = -(-sizes // limit)
    out = []
    for i in range(number):
        part = rows if number == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == i)
        items = part.toArrow().combine_chunks()
        if items.num_rows:
            ids = items.column("item_id").combine_chunks()
            out.append(
                Benchmark(
                    ids.fill_null(0).to_numpy(zero_copy_only=False),
                    ids.is_valid().to_numpy(zero_copy_only=False),
                    as_bytes(items.column("text").combine_chunks()),
                )
            )
    return out


def find_matches(docs: DataFrame, benchmark: DataFrame, limit: int = BENCHMARK_BLOCK) -> DataFrame:
    """What each document shares with the benchmark.

    Returns doc_id, n_words, hits (spans of words inside occurring windows, not overlapping), items
    (their ids, sorted, each once) and longest (per item the longest verbatim match: where it starts
    in the item and in the document, and its words).

    Words are letters and digits of ASCII (A-Z lower-cased) and all characters beyond it. A window is
    ten words of an item, or all words of a shorter one. Null texts have no words. Rows that share
    an item_id are one item; a null item_id marks words but is not named. Repeated documents give
    repeated rows. Other columns are not read.
    """
    rows = keyed(docs)
    parts = benchmark_blocks(benchmark, limit) or [Benchmark(np.zeros(0, np.int64), np.zeros(0, bool), [])]
    scans = [rows.mapInArrow(_scan(block), FOUND) for block in parts]
    if len(scans) == 1:
        return scans[0].drop("row")
    # One scan of the documents per block: what they found meets by document.
    together = (
        reduce(DataFrame.unionByName, scans)
        .groupBy("doc_id", "row", "n_words")
        .agg(
            F.flatten(F.collect_list("hits")).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.flatten(F.collect_list("longest")).alias("longest"),
            (F.count(F.lit(1)) / len(scans)).cast("int").alias("copies"),
        )
    )
    spans = F.aggregate(
        F.array_sort("hits"),
        F.lit([]).cast("array<struct<lo: long, hi: long>>"),
        lambda done, span: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["hi"] >= span["lo"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["lo"].alias("lo"),
                        F.greatest(F.element_at(done, -1)["hi"], span["hi"]).alias("hi"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(span))),
    )
    return (
        together.withColumn("hits", spans)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        .drop("copy", "copies", "row")
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, limit: int = BENCHMARK_BLOCK) -> DataFrame:
    """The documents, with all their columns, that hold no window of the benchmark. Nothing is shuffled."""

    def without(block: Benchmark):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(block)
            for rows, texts in blocks(batches, SHARD):
                shard = Words(texts)
                _, word, _ = finder.places(shard)
                clean = np.ones(len(texts), bool)
                clean[np.searchsorted(shard.first, word, side="right") - 1] = False
                yield rows.filter(pa.array(clean))

        return run

    for block in benchmark_blocks(benchmark, limit):
        docs = docs.mapInArrow(without(block), docs.schema)
    return docs


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, from ``find_matches``."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
