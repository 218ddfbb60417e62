"""Document fingerprints by order MinHash, in DataFrame functions only.

A text is cut into pieces of up to eight characters at white space; four pieces in a row are a k-mer.
K-mers that repeat are numbered by occurrence, so every one of them is different. Their hashes deal
them into bins; each bin selects its least k-mers, puts them back into text order and hashes that
tuple. Texts of small edit distance keep most k-mers in the same order, so they agree in most bins,
while moving text around changes the order in the tuples. One pass over the k-mers fills all bins.

Arrays of longs carry a k-mer's hash in the upper 37 bits and its place in the lower 26, so one plain
sort orders by hash and then by place. (Beyond 67 million pieces places run into the hash; the result
still depends on the text alone.) Each step is a column of its own behind a one-row generator, which
keeps the optimizer from writing one step's expression into the lambda of the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written
from .texts import NO_ID

PIECE, RUN = 8, 4
BIN_BITS, LEAST = 5, 2
PLACE_BITS, HASH_BITS = 26, 37
PLACES = (1 << PLACE_BITS) - 1
HASHES = (1 << HASH_BITS) - 1
PIECES = rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"


def _step(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """The kept columns and the new ones, computed here and nowhere else."""
    return df.select(*keep, F.inline(F.array(F.struct(*[e.alias(name) for name, e in columns.items()]))))


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, PLACE_BITS)


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(PLACES))


def _packed(hash_: Column, place: Column) -> Column:
    upper = F.shiftleft(hash_.bitwiseAND(F.lit(HASHES)), PLACE_BITS)
    return upper.bitwiseOR(place.cast("long").bitwiseAND(F.lit(PLACES)))


def _bin(packed: Column) -> Column:
    """The top bits of the hash, so that a plain sort brings bins together, the least k-mer first."""
    return F.shiftright(packed, PLACE_BITS + HASH_BITS - BIN_BITS)


def fingerprint(df: DataFrame, keep: list[str], texts: dict[str, str]) -> DataFrame:
    """``keep`` and, for each text column, a column of bin signatures (bin * 2**32 + 32 bits), by bin.

    ``texts`` maps text columns, without nulls, to the names of their signatures. A text without pieces
    has none; one of fewer than four pieces is one k-mer.
    """
    out = list(texts.values())

    def each(columns: DataFrame, **steps) -> DataFrame:
        made = {f"{step}_{name}": body(*(F.col(f"{s}_{name}") for s in needs)) for step, (needs, body) in steps.items() for name in out}
        return _step(columns, keep, **made)

    df = _step(df, keep, **{f"pieces_{n}": F.regexp_extract_all(F.col(t), F.lit(PIECES), F.lit(0)) for t, n in texts.items()})
    df = each(df, hashes=(["pieces"], lambda p: F.transform(p, lambda x: F.xxhash64(x))))
    df = each(
        df,
        kmers=(
            ["hashes"],
            lambda h: F.when(
                F.size(h) >= RUN,
                F.transform(
                    F.slice(h, 1, F.greatest(F.size(h) - (RUN - 1), F.lit(0))),
                    lambda x, i: _packed(F.xxhash64(x, *[F.get(h, i + d) for d in range(1, RUN)]), i),
                ),
            )
            .when(F.size(h) > 0, F.array(_packed(F.xxhash64(h), F.lit(0))))
            .otherwise(F.array().cast("array<long>")),
        ),
    )
    df = each(df, sorted=(["kmers"], F.sort_array))
    # The first occurrences of each k-mer; what is left are second and later ones, still in order.
    df = each(
        df,
        sorted=(["sorted"], lambda s: s),
        firsts=(
            ["sorted"],
            lambda s: F.filter(s, lambda x, j: (j == 0) | (_hash(x) != _hash(F.get(s, j - 1)))),
        ),
    )
    df = each(
        df,
        firsts=(["firsts"], lambda s: s),
        later=(["sorted", "firsts"], lambda s, f: F.when(F.size(s) > F.size(f), F.array_except(s, f)).otherwise(F.array().cast("array<long>"))),
    )
    df = each(
        df,
        firsts=(["firsts"], lambda s: s),
        later=(["later"], lambda s: s),
        runs=(
            ["later"],
            lambda s: F.filter(
                F.transform(s, lambda x, j: F.when((j == 0) | (_hash(x) != _hash(F.get(s, j - 1))), j).otherwise(-1)),
                lambda j: j >= 0,
            ),
        ),
    )

    def numbered(firsts: Column, later: Column, runs: Column) -> Column:
        """Each k-mer hashed with its occurrence, packed with its place."""
        one = F.transform(firsts, lambda x: _packed(F.xxhash64(_hash(x), F.lit(0)), _place(x)))
        more = F.transform(
            runs,
            lambda start, r: F.transform(
                F.slice(later, start + 1, F.coalesce(F.get(runs, r + 1), F.size(later)) - start),
                lambda x, o: _packed(F.xxhash64(_hash(x), o + 1), _place(x)),
            ),
        )
        return F.when(F.size(later) > 0, F.concat(one, F.flatten(more))).otherwise(one)

    df = each(df, numbered=(["firsts", "later", "runs"], numbered))
    df = each(df, by_bin=(["numbered"], F.sort_array))
    df = each(
        df,
        chosen=(
            ["by_bin"],
            lambda s: F.filter(s, lambda x, j: (j < LEAST) | (_bin(F.get(s, j - LEAST)) != _bin(x))),
        ),
    )

    def signatures(s: Column) -> Column:
        """Per bin the hash of its k-mers in text order, as bin and 32 bits."""

        def one(head: Column, j: Column) -> Column:
            own = F.filter(F.slice(s, j + 1, LEAST), lambda y: _bin(y) == _bin(head))
            in_order = F.sort_array(F.transform(own, lambda y: F.struct(_place(y).alias("p"), _hash(y).alias("h"))))
            tuple_ = F.xxhash64(F.transform(in_order, lambda y: y["h"]))
            return F.shiftleft(_bin(head), 32).bitwiseOR(tuple_.bitwiseAND(F.lit(0xFFFFFFFF)))

        heads = F.transform(s, lambda x, j: F.when((j == 0) | (_bin(F.get(s, j - 1)) != _bin(x)), one(x, j)).otherwise(F.lit(-1)))
        return F.filter(heads, lambda x: x >= 0)

    df = each(df, signatures=(["chosen"], signatures))
    return df.select(*keep, *[F.col(f"signatures_{n}").alias(n) for n in out])


def likeness(a: Column, b: Column) -> Column:
    """The share of equal signatures among the bins that either has; 1 if neither has any."""
    bins = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 32)), F.transform(b, lambda x: F.shiftright(x, 32))))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / bins)


def digits(signatures: Column) -> Column:
    """Signatures as text: ten hexadecimal digits each."""
    return F.array_join(F.transform(signatures, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def next_ids(ids: DataFrame) -> DataFrame:
    """id and the next smaller one of each distinct id; the smallest has the largest.

    The ids are dealt by ranges; inside a range a window finds the neighbour, and one row per range goes
    on to find the last of the range before.
    """
    ranged = written(ids.distinct().repartitionByRange("id").withColumn("range", F.spark_partition_id()))
    own = Window.partitionBy("range").orderBy("id")
    edges = ranged.groupBy("range").agg(F.max("id").alias("most"))
    ordered = Window.orderBy("range")
    around = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select(
        "range", F.coalesce(F.lag("most").over(ordered), F.max("most").over(around)).alias("before")
    )
    return (
        ranged.withColumn("inside", F.lag("id").over(own))
        .join(edges, "range")
        .select("id", F.coalesce("inside", "before").alias("next_id"))
    )


def edited_texts(docs: DataFrame) -> DataFrame:
    """id, next_id, text, n_chars and edited: the text whose last half is that of the next document's start.

    The last floor(n_chars / 2) code points give way to as many first ones of the next document in
    falling order of doc_id, or to all it has; the last is followed by the first. A null text is empty, a
    null doc_id (id: the least number) comes last. Of rows that share the next doc_id the least text
    is taken.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"))
    sizes = rows.groupBy("id").agg(F.max(F.char_length("text")).alias("n"))
    following = written(next_ids(rows.select("id")).join(sizes, "id"))
    wanted = following.select(
        F.col("next_id").alias("id"), F.col("id").alias("for_id"), F.expr("n div 2").cast("int").alias("most")
    )
    # One shuffle of the texts serves both sides.
    dealt = rows.repartition("id")
    starts = (
        dealt.groupBy("id").agg(F.min("text").alias("text"))
        .join(wanted, "id")
        .select(F.col("for_id").alias("id"), F.col("id").alias("next_id"), F.col("text").substr(F.lit(1), F.col("most")).alias("start"))
    )
    n = F.char_length("text")
    half = F.expr("char_length(text) div 2").cast("int")
    return dealt.join(starts, "id").select(
        "id",
        "next_id",
        "text",
        n.cast("long").alias("n_chars"),
        F.concat(F.col("text").substr(F.lit(1), n - half), F.col("start").substr(F.lit(1), half)).alias("edited"),
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, the signatures of each text, of its edited text and of the next document.

    Of rows that share the next doc_id the least signatures count. Other columns are not read.
    """
    rows = edited_texts(docs).withColumn("edited_sha256", F.sha2("edited", 256))
    found = written(
        fingerprint(rows, ["id", "next_id", "n_chars", "edited_sha256"], {"text": "own", "edited": "changed"})
    )
    nexts = found.groupBy("id").agg(F.min("own").alias("following")).withColumnRenamed("id", "next_id")
    return found.join(nexts, "next_id").select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", "own", "changed", "following"
    )
