"""Whole texts as blocks of bytes: word places and word hashes by numpy inside a task.

A block holds whole texts, one after the other, with a separator in front of each and behind the
last. A block is about ``BLOCK`` bytes; a longer text is a block of its own. Nulls read as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SPACES = b" \t\n\x0b\x0c\r"
#: Takes the place of a null doc_id where rows meet by it: smaller than any other.
NO_ID = -(1 << 63)

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def keyed(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, row (a hash of the text, which tells rows of one doc_id apart), text, and other_0, other_1, ..."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("row"),
        text.alias("text"),
        *[F.col(c).alias(f"other_{i}") for i, c in enumerate(others)],
    )


def byte_set(inside: Iterable[int]) -> np.ndarray:
    """A table of 256 flags."""
    table = np.zeros(256, bool)
    table[list(inside)] = True
    return table


#: Bytes of a word between ASCII white space.
SPACED = ~byte_set(SPACES)
#: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = byte_set([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: A-Z to a-z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the usual block size."""
    have = _POWERS.get(base)
    if have is not None and len(have) >= n:
        return have
    out = np.ones(max(n, BLOCK + (1 << 16)), np.uint64)
    done = 1
    while done < len(out):
        step = min(done, len(out) - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    if len(out) <= 4 * BLOCK:
        _POWERS[base] = out
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    base = (_BASE + 2 * salt * 0x2545F4914F6CDD1D) % (1 << 64)
    powers = _powers(base, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=total[1:])
    back = _powers(pow(base, -1, 1 << 64), len(data) + 1)
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


class Block:
    """Texts of one block and the words in them.

    ``cuts`` may name places of the block's bytes in front of which a word is cut in two.
    """

    def __init__(
        self,
        texts: list[bytes],
        inside: np.ndarray = SPACED,
        lower: bool = False,
        cuts: Callable[[np.ndarray], np.ndarray] | None = None,
    ):
        data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        places = np.cumsum(np.array([1] + [len(t) + 1 for t in texts], np.int64))
        if lower:
            data = LOWER[data]
        if cuts is not None:
            at = cuts(data)
            data = np.insert(data, at, 0x20)
            places = places + np.searchsorted(at, places)
        member = inside[data]
        edges = np.flatnonzero(member[1:] != member[:-1]) + 1
        self.data, self.member = data, member
        self.starts, self.ends = edges[0::2], edges[1::2]
        #: First word of each text, and the number of words at the end.
        self.first = np.searchsorted(self.starts, places)
        self.counts = np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def pack(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words alone, one space behind each, with their starts and ends there."""
        kept = self.member.copy()
        kept[self.ends] = True
        packed = self.data[kept]
        ends = np.cumsum(self.ends - self.starts + 1) - 1
        starts = ends - (self.ends - self.starts)
        packed[ends] = 0x20
        return packed, starts, ends


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column in UTF-8, null as empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches of about 8 MB, unless it names a size of its own.

    The default is a number of rows, and rows here are whole texts.
    """
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, 8 << 20)
    return spark


def give_back() -> None:
    """Return freed memory to the system: a worker lives on between tasks and stages of other work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def blocks(
    batches: Iterable[pa.RecordBatch], limit: int = BLOCK, column: str = "text"
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The rows of a task in blocks of whole texts, each with its rows."""
    try:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0).to_numpy()
            start, size = 0, 0
            for i, own in enumerate(sizes.tolist()):
                if i > start and size + own > limit:
                    part = batch.slice(start, i - start)
                    yield part, as_bytes(part.column(column))
                    start, size = i, 0
                size += own + 1
            if start < len(sizes):
                part = batch.slice(start)
                yield part, as_bytes(part.column(column))
    finally:
        give_back()


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... of every range, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return np.arange(total, dtype=np.int64) + shift
