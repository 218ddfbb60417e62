"""Documents to packed training sequences: five stages over the whole corpus.

Each stage takes what its predecessor kept, applies one operator of ``tidewatch.llm`` and is written as
Parquet in the shared folder. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, lines, packing, simhash, toxicity
from tidewatch.llm.texts import bounded_batches
from tidewatch.session import scratch, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TYPES = ("long", "string", "string", "string", "long")


def _shaped(docs: DataFrame) -> DataFrame:
    """The columns of ``documents`` alone, whatever else is there."""
    bounded_batches(docs.sparkSession)
    return docs.select(*[F.col(c).cast(t).alias(c) for c, t in zip(COLUMNS, TYPES)])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; rows without a text stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_documents(_shaped(docs), labels, keep=COLUMNS[1:])
    return _shaped(scored.filter("score < 0.5"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that a smaller doc_id has; n_chars follows. A null text becomes empty."""
    kept = lines.dedup_lines(_shaped(docs), keep=("lang", "source"))
    return _shaped(kept.withColumn("n_chars", F.char_length("text").cast("long")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that of the smallest doc_id. Rows alike in all columns are one."""
    rows = _shaped(docs)
    return simhash.keep_first(rows, simhash.near_duplicates(rows))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _shaped(decontaminate.clean_documents(_shaped(docs), benchmark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences."""
    return packing.pack_documents(_shaped(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: Scores of a trained model cannot be said in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's rows go when the next ones are written.

    So do the tables that a stage writes on its way.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    files = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system, before = files.getFileSystem(spark._jsc.hadoopConfiguration()), None
    for name, stage in STAGES:
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
        if before is not None:
            system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{before}"), True)
        before = name
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
