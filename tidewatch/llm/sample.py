"""A bounded sample of labelled documents for a classifier."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import as_bytes

FOLDS = 5


def remainder(folds: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``folds``. Null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


@dataclass
class Sample:
    """Texts with their 0/1 labels, and how many training rows each label has in all."""

    texts: list[bytes]
    labels: np.ndarray
    totals: tuple[int, int]


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int, size: int, folds: int = FOLDS) -> Sample:
    """Whole texts of about ``rows`` documents per label at most, and of ``size`` bytes in all per label.

    Only rows outside the held-out fold count, null labels and ids do not, and of several labels of
    one doc_id the largest holds, as of several texts. Rows are taken by the hash of their doc_id, so the sample does not
    hang on their order, and it needs no sort: the share to take follows from the count. A text that
    alone goes beyond what is left of ``size`` is passed over.
    """
    own = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .filter("doc_id is not null and label in (0, 1)")
        .filter(remainder(folds) != 0)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    counts = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = (counts.get(0, 0), counts.get(1, 0))
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 62) - 1))
    limits = [int((1 << 62) * min(1.0, rows / max(1, n))) for n in totals]
    taken = own.filter(place < F.when(F.col("label") == 0, limits[0]).otherwise(limits[1]))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").alias("size"))
    chosen, used = set(), [0, 0]
    # One row per doc_id, however many rows of ``docs`` have it.
    met = taken.join(sized, "doc_id").groupBy("doc_id", "label").agg(F.max("size").alias("size"))
    listed = met.select("doc_id", "label", "size", place.alias("place")).collect()
    for r in sorted(listed, key=lambda r: (r["place"], r["doc_id"])):
        if used[r["label"]] + (r["size"] or 0) <= size:
            used[r["label"]] += r["size"] or 0
            chosen.add(r["doc_id"])
    label_of = {r["doc_id"]: r["label"] for r in listed}
    spark = docs.sparkSession
    ids = spark.createDataFrame([(i,) for i in sorted(chosen)], "doc_id long")
    # The ids are bounded by ``rows``.
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = got.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))
    table = one.toArrow().combine_chunks()
    texts: dict[int, bytes] = {}
    if table.num_rows:
        texts = dict(zip(table.column("doc_id").to_pylist(), as_bytes(table.column("text").combine_chunks())))
    order = sorted(texts)
    return Sample([texts[i] for i in order], np.array([label_of[i] for i in order], np.int64), totals)
