"""Raw list files and bodies as ``(source, line_no, line)``, and the source catalogue."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze_ends
from ..operators.merge import trust_of
from ..schemas import PROTOCOLS
from ..session import written

KINDS = ["http-list", "json-endpoint", "local-file"]


def confined(path: str, root: str) -> str:
    """A path under ``root``; one that leaves it is refused."""
    base, target = PurePosixPath(root), PurePosixPath(root) / path
    if ".." in PurePosixPath(path).parts or not target.is_relative_to(base):
        raise ValueError(f"{path} resolves outside {root}")
    return str(target)


def with_source(rows: DataFrame, places: DataFrame, file: Column) -> DataFrame:
    """Add ``source``, the one of ``places`` (path, source) a file belongs to by its own path or that of its folder."""
    path = F.regexp_replace(file, "^file:/+", "/")
    by = {name: places.select(F.col("path").alias(f"_{name}"), F.col("source").alias(f"_by_{name}")) for name in ("path", "folder")}
    told = rows.withColumns({"_path": path, "_folder": F.regexp_replace(path, "/[^/]*$", "")})
    told = told.join(by["path"], "_path", "left").join(by["folder"], "_folder", "left")
    return told.withColumn("source", F.coalesce("_by_path", "_by_folder")).drop("_path", "_folder", "_by_path", "_by_folder")


def read_lists(spark: SparkSession, paths: str | Sequence[str], source: Column | DataFrame | None = None) -> DataFrame:
    """Lines of text files with their exact line number.

    Files are split like any text input: a line's number is its place in the split plus the
    lines of the splits before, so a file of any size is read in parallel. ``source``, over the columns
    ``file`` and ``name``, defaults to the file name, or is a table of places (:func:`with_source`); the files of one source are numbered on, in the order
    of their paths. A final line break does not add a row (see :func:`line_totals`).
    """
    raw = (
        spark.read.option("lineSep", "\n")
        .text(paths)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_name").alias("name"),
            F.col("_metadata.file_size").alias("file_size"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("place"),
            F.col("value"),
        )
    )
    # Ids and splits of one scan: another scan might cut the files elsewhere.
    raw = written(raw)
    # Inside one split the ids rise by one, so their distance to the lowest is the place.
    sizes = raw.groupBy("file", "name", "split").agg(F.min("place").alias("first"), F.count("*").alias("lines"))
    # A source is told once per split, not per line.
    if isinstance(source, DataFrame):
        sizes = with_source(sizes, source, F.col("file"))
    else:
        sizes = sizes.withColumn("source", source if source is not None else F.col("name"))
    earlier = Window.partitionBy("source").orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "source", "file", "split", "first", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before")
    )
    return raw.join(offsets, ["file", "split"]).select(
        "source",
        (F.col("before") + F.col("place") - F.col("first")).alias("line_no"),
        F.regexp_replace("value", "\r$", "").alias("line"),
        "file_size",
        (F.octet_length("value") + 1).alias("line_bytes"),
    )


def read_local(spark: SparkSession, path: str, root: str, source: Column | None = None) -> DataFrame:
    """:func:`read_lists` of a path of the catalogue, which may not leave ``root``."""
    return read_lists(spark, confined(path, root), source)


def line_totals(lines: DataFrame) -> DataFrame:
    """(source, total_lines); text that ends in a line break has one more, empty, line.

    The bytes read equal the file size exactly when the last line ends in a break.
    """
    return lines.groupBy("source").agg(
        (F.count("*") + (F.sum("line_bytes") == F.max("file_size")).cast("int")).alias("total_lines")
    )


def split_bodies(bodies: DataFrame, source: str = "source", body: str = "body") -> DataFrame:
    """Lines of bodies held in a column."""
    return bodies.select(
        F.col(source).alias("source"), F.posexplode(F.split(body, r"\r?\n")).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no").cast("bigint"))


def validate_sources(configs: DataFrame) -> DataFrame:
    """Add ``fault`` (first broken rule, NULL when sound), ``trust`` in 0..1 and ``enabled``.

    Columns: id, kind, url, path, protocol, trust, enabled, ord. An id is a duplicate when a
    row with a lower ``ord`` has it; equal ids are counted by a grouped minimum.
    """
    c = F.col
    cleaned = configs.withColumn("id", squeeze_ends(F.coalesce("id", F.lit(""))))
    firsts = cleaned.groupBy("id").agg(F.min("ord").alias("_first"))
    has = lambda name: F.coalesce(c(name), F.lit("")) != ""
    local = c("kind") == "local-file"
    fault = (
        F.when(~c("id").rlike(r"^[a-z0-9][a-z0-9._-]{1,63}$"), "invalid id")
        .when(c("ord") > c("_first"), "duplicate id")
        .when(~F.coalesce(c("kind").isin(*KINDS), F.lit(False)), "unknown kind")
        .when(local & ~has("path"), "path required")
        .when(local & c("path").contains(".."), "path leaves the root")
        .when(~local & ~has("url"), "url required")
        .when(c("protocol").isNotNull() & ~c("protocol").isin(*PROTOCOLS), "invalid protocol")
    )
    return (
        cleaned.join(firsts, "id")
        .withColumn("fault", fault)
        .withColumn("trust", trust_of(c("trust")))
        .withColumn("enabled", F.coalesce("enabled", F.lit(True)))
        .drop("_first")
    )


def enabled_sources(configs: DataFrame) -> DataFrame:
    """Sound and enabled sources in catalogue order, as the merge wants them."""
    return (
        validate_sources(configs)
        .filter("fault is null and enabled")
        .select(F.col("id").alias("source"), F.col("ord").alias("source_ord"), "trust", "kind", "protocol")
    )
