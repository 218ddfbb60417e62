"""How far the sources of a language lie apart in their words.

Terms are counted per (language, source) by numpy inside tasks, added up before the shuffle, and a
language keeps the terms that enough of its documents have. The distances of all pairs of sources come
from a cube: the sources of a language are cut into blocks, its terms into blocks, and a task owns one
cell (block of sources, block of sources, block of terms). The slice of a block of sources at a block of
terms is copied to the cells that need it, a cell lays its two slices out as dense arrays and returns the
partial distance of each pair, and the partial distances are added along the terms. A slice has at most
``GROUPS`` times about ``TERMS`` values, however large the corpus; nothing is sent to the driver.

All values are whole numbers: a share is 1 + floor(10^9 (count + 5) / (all + 5 V)).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .spans import as_strings, distinct_spans
from .texts import Block, blocks, bounded_batches, byte_set

LEAST_DOCUMENTS, TOP_TERMS = 30, 50
#: Sources and (about) terms of a block of the cube.
GROUPS, TERMS = 32, 4096
#: Bytes of texts counted at once, and rows of counts a task holds before it sends them.
COUNT_BYTES, HELD = 2 << 20, 250_000
#: ASCII letters, and every byte of a character beyond ASCII.
LETTERS = byte_set([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
BETWEEN = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")

COUNTS = "lang string, source string, term string, n long, documents long"
PARTIAL = "lang string, source string, item string, apart long, partial long"
SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("documents", pa.int64())])


def count_texts(texts: list[bytes], group: np.ndarray, groups: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, occurrences, texts that have it) of texts that belong to numbered groups."""
    block = Block(texts, LETTERS, lower=True)
    first, number = distinct_spans(block.data, block.starts, block.ends)
    pairs, times = np.unique(number * len(texts) + block.owner(), return_counts=True)
    keys, at = np.unique(pairs // len(texts) * groups + group[pairs % len(texts)], return_inverse=True)
    n, documents = np.zeros(len(keys), np.int64), np.bincount(at, minlength=len(keys))
    np.add.at(n, at, times)
    term = first[keys // groups]
    return as_strings(block.data, block.starts[term], block.ends[term]), keys % groups, n, documents.astype(np.int64)


def slices(text: bytes, limit: int) -> Iterator[bytes]:
    """A long text cut in front of bytes that no term has."""
    at = 0
    while len(text) - at > limit:
        cut = BETWEEN.search(text, at + limit)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def added(parts: list[pa.Table]) -> pa.Table:
    """Counts of the same language, source and term as one row."""
    whole = pa.concat_tables(parts)
    out = whole.group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("documents", "sum")])
    return out.rename_columns(["lang", "source", "term", "n", "documents"]).cast(SCHEMA)


def count_terms(docs: DataFrame, count_bytes: int = COUNT_BYTES) -> DataFrame:
    """lang, source, term, n (occurrences) and documents (rows that have it), added up per task.

    Every language and source also has a row of the empty term, which stands for the group itself.
    """

    def counted(rows: pa.RecordBatch, texts: list[bytes]) -> Iterator[pa.Table]:
        lang, source = (rows.column(c).dictionary_encode() for c in ("lang", "source"))
        wide = len(source.dictionary) or 1
        codes = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * wide + source.indices.to_numpy(zero_copy_only=False)
        known, group = np.unique(codes, return_inverse=True)
        langs, sources = lang.dictionary.take(pa.array(known // wide)), source.dictionary.take(pa.array(known % wide))

        def table(term: pa.Array, own: np.ndarray, n: np.ndarray, documents: np.ndarray) -> pa.Table:
            at = pa.array(own)
            return pa.table([langs.take(at), sources.take(at), term, pa.array(n), pa.array(documents)], schema=SCHEMA)

        none = np.zeros(len(known), np.int64)
        yield table(pa.array([""] * len(known), pa.string()), np.arange(len(known)), none, none)
        if len(texts) > 1 or len(texts[0]) <= 2 * count_bytes:
            yield table(*count_texts(texts, group, len(known)))
            return
        # One very long text, in slices: each of its terms counts one document.
        parts = [table(*count_texts([part], group, 1)) for part in slices(texts[0], count_bytes)]
        whole = added(parts)
        one = pa.array(np.ones(whole.num_rows, np.int64))
        yield whole.set_column(4, "documents", one)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for rows, texts in blocks(batches, count_bytes):
            for part in counted(rows, texts):
                held.append(part)
                size += part.num_rows
            if size > HELD:
                held = [added(held)]
                size = held[0].num_rows
                if size > HELD // 2:
                    yield from held[0].to_batches(max_chunksize=100_000)
                    held, size = [], 0
        if held:
            yield from added(held).to_batches(max_chunksize=100_000)

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*text).mapInArrow(run, COUNTS)


def share(count: Column, everything: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (everything + 5 terms)), exactly; 0 where there are no terms."""
    above = (count + 5).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    below = (everything + 5 * terms).cast("decimal(20,0)")
    # Integer division, which the Column API has as a function of SQL only.
    return F.when(terms > 0, F.call_function("div", above, F.when(terms > 0, below)) + 1).otherwise(F.lit(0)).cast("long")


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS, count_bytes: int = COUNT_BYTES) -> DataFrame:
    """lang, source, term, n and total (n over the language) of the terms a language keeps, as a written table.

    The empty term is there once per language and source. Counts meet by (lang, term), so adding them up
    and looking at the documents of a language is one shuffle.
    """
    met = count_terms(docs, count_bytes).repartition("lang", "term")
    summed = met.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    # As many rows as the language has sources.
    everywhere = Window.partitionBy("lang", "term")
    judged = summed.select(
        "lang", "source", "term", "n", F.sum("n").over(everywhere).alias("total"), F.sum("documents").over(everywhere).alias("held")
    )
    return written(judged.filter((F.col("term") == "") | (F.col("held") >= least)).drop("held"))


def groups_of(kept: DataFrame) -> DataFrame:
    """One row per language and source: what it counts in all, its number in the language, and the language's figures."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    terms = kept.filter("term != ''").groupBy("lang", "term").agg(F.max("total").alias("total"))
    figures = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_size"))
    # As many rows as the language has sources.
    numbered = own.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    whole = numbered.join(figures, "lang", "left").na.fill(0, ["terms", "lang_size"])
    return whole.withColumn("unseen", share(F.lit(0), F.col("size"), F.col("terms")))


def pair_distances(kept: DataFrame, groups: DataFrame, block_groups: int = GROUPS, block_terms: int = TERMS) -> DataFrame:
    """lang, source, item (another source of the language) and value, both ways round."""
    cut = groups.select(
        "*",
        F.floor(F.col("number") / block_groups).cast("long").alias("block"),
        F.floor((F.max("number").over(Window.partitionBy("lang"))) / block_groups).cast("long").alias("last"),
        F.greatest(F.lit(1), F.ceil(F.col("terms") / block_terms)).cast("long").alias("cuts"),
    )
    place = ["lang", "source", "number", "block", "last"]
    values = (
        kept.filter("term != '' and n > 0")
        .join(cut, ["lang", "source"])
        .select(
            *place,
            F.pmod(F.xxhash64("term"), F.col("cuts")).alias("cut"),
            "term",
            share(F.col("n"), F.col("size"), F.col("terms")).alias("value"),
        )
    )
    # A source is in each of its cells, also where it has no term of the block.
    present = cut.select(
        *place, F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), F.lit(None).cast("string").alias("term"), F.col("unseen").alias("value")
    )
    copied = values.unionByName(present).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    cells = copied.select(
        "lang",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        "cut",
        "block",
        "number",
        "source",
        "term",
        "value",
    )

    def cell(key: tuple, table: pa.Table) -> pa.Table:
        lang, low, high = (k.as_py() for k in key[:3])
        missing = pc.is_null(table.column("term"))
        names, rows = table.filter(missing), table.filter(pc.invert(missing))
        code = rows.column("term").combine_chunks().dictionary_encode()
        width = len(code.dictionary)
        column = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        number, value = rows.column("number").to_numpy(), rows.column("value").to_numpy()
        owner = rows.column("block").to_numpy()
        known, unseen = names.column("number").to_numpy(), names.column("value").to_numpy()
        block = names.column("block").to_numpy()
        source = names.column("source").to_pylist()

        def dense(which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = np.flatnonzero(block == which)
            at = at[np.argsort(known[at])]
            out = np.repeat(unseen[at][:, None], width, axis=1)
            inside = owner == which
            out[np.searchsorted(known[at], number[inside]), column[inside]] = value[inside]
            return at, unseen[at], out

        left_at, left_unseen, left = dense(low)
        right_at, right_unseen, right = (left_at, left_unseen, left) if low == high else dense(high)
        found: list[tuple[str, str, int, int]] = []
        for i in range(len(left_at)):
            start = i + 1 if low == high else 0
            apart = np.abs(right_unseen[start:] - left_unseen[i])
            # Terms that neither has are added for the whole language at the end.
            partial = np.abs(right[start:] - left[i]).sum(axis=1) - width * apart
            one = source[left_at[i]]
            found += [(one, source[j], a, p) for j, a, p in zip(right_at[start:].tolist(), apart.tolist(), partial.tolist())]
        columns = zip(*found) if found else ([], [], [], [])
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.table([pa.array([lang] * len(found), pa.string()), *arrays], names=["lang", "source", "item", "apart", "partial"])

    partial = cells.groupBy("lang", "low", "high", "cut").applyInArrow(cell, PARTIAL)
    reduced = partial.groupBy("lang", "source", "item", "apart").agg(F.sum("partial").alias("partial"))
    terms = groups.groupBy("lang").agg(F.max("terms").alias("terms"))
    summed = reduced.join(terms, "lang").withColumn("value", F.col("partial") + F.col("terms") * F.col("apart"))
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return summed.select("lang", F.explode(ways).alias("way"), "value").select("lang", "way.source", "way.item", "value")


def prominent_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (a term the source uses more than its language) and value, how much more."""
    own = kept.filter("term != '' and n > 0").join(groups, ["lang", "source"])
    p = share(F.col("n"), F.col("size"), F.col("terms"))
    q = share(F.col("total"), F.col("lang_size"), F.col("terms"))
    return own.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")


def audit_sources(
    docs: DataFrame,
    least: int = LEAST_DOCUMENTS,
    top: int | None = TOP_TERMS,
    block_groups: int = GROUPS,
    block_terms: int = TERMS,
    count_bytes: int = COUNT_BYTES,
) -> DataFrame:
    """lang, source, part, item, value and rank of every language and source of the documents.

    Part ``pair`` lists every other source of the language, the farthest first; part ``term`` the terms
    the source has more of than its language, up to rank ``top`` (all with None). Every row is a document,
    also where rows repeat; a null text, language or source reads as empty. A source without terms, and a
    language that keeps none, still has its pairs; a language of one source has none. No documents give no
    rows. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    kept = kept_terms(docs, least, count_bytes)
    # As many rows as there are languages and sources; read by both parts.
    groups = written(groups_of(kept))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_distances(kept, groups, block_groups, block_terms).withColumn("rank", place)
    terms = prominent_terms(kept, groups).withColumn("rank", place)
    if top is not None:
        terms = terms.filter(F.col("rank") <= top)
    parts = [part.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, part in (("pair", pairs), ("term", terms))]
    return parts[0].unionByName(parts[1])
