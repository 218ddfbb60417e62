"""Line dedup against levelled sorted runs of line hashes.

The runs hold every line key seen so far as a 128-bit hash, each key in one run. A run is a table
bucketed and sorted by hash, so a new batch meets it in a merge join without moving the run. Keys a
run knows are anti-joined away; the rest become the batch's own run. Whenever a level has
``fanout`` runs they are merged into one run of the next level, so a batch meets few runs.

Hot lines: keys are counted by grouped minimums that combine before the shuffle, and the join that
brings the verdicts back to the lines has one row per key on one side, so its hot partitions split.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .texts import NO_ID, blocks, keyed

MIN_CHARS = 10
FANOUT = 2
BATCHES = 4


def line_key(line: bytes) -> bytes:
    """A line without ASCII white space around it, A-Z lower-cased."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def _chars(key: bytes) -> int:
    """Code points of UTF-8 text."""
    return len(key) if key.isascii() else len(key.decode("utf-8", "surrogatepass"))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, row (a hash of the text, which tells rows of one doc_id apart), pos, h1 and h2 of every keyed line."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            owner, places, first, second = [], [], [], []
            for i, text in enumerate(texts):
                for at, line in enumerate(text.split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_chars and _chars(key) >= min_chars:
                        digest = xxhash.xxh3_128_intdigest(key)
                        owner.append(i)
                        places.append(at)
                        first.append(digest >> 64)
                        second.append(digest & 0xFFFFFFFFFFFFFFFF)
            which = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(which),
                    batch.column("row").take(which),
                    pa.array(places, pa.int32()),
                    pa.array(np.array(first, np.uint64).view(np.int64)),
                    pa.array(np.array(second, np.uint64).view(np.int64)),
                ],
                names=["doc_id", "row", "pos", "h1", "h2"],
            )

    return _keyed(docs).mapInArrow(run, "doc_id long, row long, pos int, h1 long, h2 long")


def _keyed(docs: DataFrame, *others: str) -> DataFrame:
    return keyed(docs, *others).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))


@dataclass
class LineRuns:
    """The runs of one corpus. ``levels`` names the tables of each level, the newest last."""

    spark: SparkSession
    fanout: int = FANOUT
    levels: dict[int, list[str]] = field(default_factory=lambda: defaultdict(list))

    def names(self) -> list[str]:
        return [name for level in sorted(self.levels) for name in self.levels[level]]

    def _store(self, keys: DataFrame, level: int) -> None:
        buckets = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        name = f"line_run_{uuid.uuid4().hex}"
        (
            keys.select("h1", "h2")
            .repartition(buckets, "h1", "h2")
            .write.bucketBy(buckets, "h1", "h2")
            .sortBy("h1", "h2")
            .option("compression", "zstd")
            .saveAsTable(name)
        )
        self.levels[level].append(name)

    def add(self, lines: DataFrame) -> DataFrame:
        """Judge the lines of a new batch and take its keys in.

        Returns the doc_id, row and pos of lines that go: all lines of a key an earlier batch has
        had, and lines of a key new in this batch except in its smallest doc_id.
        """
        keys = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        known = []
        for i, name in enumerate(self.names()):
            run = self.spark.table(name).withColumn(f"in_{i}", F.lit(True))
            keys = keys.join(run, ["h1", "h2"], "left")
            known.append(F.col(f"in_{i}"))
        seen = F.coalesce(*known, F.lit(False))
        judged = written(keys.select("h1", "h2", "first", "last", seen.alias("seen")))
        self._store(judged.filter("not seen"), 0)
        self.compact()
        again = judged.filter("seen or first < last").select("h1", "h2", F.expr("if(seen, null, first)").alias("keeper"))
        return lines.join(again, ["h1", "h2"]).filter("keeper is null or doc_id <> keeper").select("doc_id", "row", "pos")

    def compact(self) -> None:
        """Merge the runs of every full level into one of the next."""
        level = 0
        while len(self.levels[level]) >= self.fanout:
            names = self.levels[level]
            merged = self.spark.table(names[0])
            for name in names[1:]:
                merged = merged.union(self.spark.table(name))
            self._store(merged, level + 1)
            self.levels[level] = []
            for name in names:
                self.spark.sql(f"DROP TABLE {name}")
            level += 1

    def drop(self) -> None:
        """Forget all keys."""
        for name in self.names():
            self.spark.sql(f"DROP TABLE {name}")
        self.levels.clear()


def dropped_lines(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS, fanout: int = FANOUT) -> DataFrame:
    """doc_id, row and pos of every line that goes, with the documents fed as batches of rising doc_id."""
    lines = written(line_hashes(docs, min_chars))
    marks = [i / batches for i in range(1, batches)]
    edges = lines.agg(F.percentile_approx("doc_id", marks, 10_000).alias("edges")).first()["edges"] if marks else []
    edges = sorted(set(edges or []))
    runs, gone = LineRuns(docs.sparkSession, fanout), []
    try:
        for low, high in zip([None, *edges], [*edges, None]):
            part = lines
            if low is not None:
                part = part.filter(F.col("doc_id") > low)
            if high is not None:
                part = part.filter(F.col("doc_id") <= high)
            gone.append(written(runs.add(part)))
    finally:
        runs.drop()
    out = gone[0]
    for part in gone[1:]:
        out = out.union(part)
    return out


def dedup_lines(docs: DataFrame, keep: tuple[str, ...] = (), batches: int = BATCHES) -> DataFrame:
    """Drop lines other documents have had.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Lines whose key
    has ten code points or more and is in two documents or more stay only in the smallest doc_id that
    has it. Returns doc_id, text (the lines left, joined), n_lines (before), n_dropped, and the columns
    named in ``keep``; others are not read. A null or empty text is one empty line. A null doc_id is
    smaller than any other. Rows that share a doc_id are one document.
    """

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, whole in blocks(parts):
            texts, n_lines, n_gone = [], [], []
            for text, gone in zip(whole, batch.column("gone").to_pylist()):
                own = text.split(b"\n")
                n_lines.append(len(own))
                n_gone.append(len(gone or ()))
                if gone:
                    out = set(gone)
                    text = b"\n".join(line for at, line in enumerate(own) if at not in out)
                texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                    pa.array(n_lines, pa.int64()),
                    pa.array(n_gone, pa.int64()),
                    *[batch.column(f"other_{i}") for i in range(len(keep))],
                ],
                names=["doc_id", "text", "n_lines", "n_dropped", *[f"other_{i}" for i in range(len(keep))]],
            )

    rows = _keyed(docs, *keep)
    gone = dropped_lines(docs, batches).distinct().groupBy("doc_id", "row").agg(F.collect_list("pos").alias("gone"))
    types = dict(rows.dtypes)
    schema = "doc_id long, text string, n_lines long, n_dropped long" + "".join(
        f", other_{i} {types[f'other_{i}']}" for i in range(len(keep))
    )
    out = rows.join(gone, ["doc_id", "row"], "left").mapInArrow(run, schema)
    doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    return out.select(
        doc_id.alias("doc_id"), "text", "n_lines", "n_dropped", *[F.col(f"other_{i}").alias(c) for i, c in enumerate(keep)]
    )
