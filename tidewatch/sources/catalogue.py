"""From the rows of the source catalogue to lines and feed items, by the kind of each source.

Collectors have written the body of every URL source to ``folder/<id>`` (a file, or a folder of files);
local sources are read where the catalogue says, under one root. A source that cannot be read, or whose feed
is no JSON or has no list, is a row of ``faults`` and the others go on without it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import feeds, json_scan, lists
from .ledger import Ledger

FAULTS = "source string, reason string"
LINES = "source string, line_no bigint, line string"
#: Fixed value: the reason of a source without a readable file.
UNREADABLE = "could not be read"


@dataclass
class Discovered:
    """Lines and mapped feed items of the sources that could be read, and the faults of the others."""

    lines: DataFrame
    mapped: DataFrame | None
    faults: DataFrame
    sources: DataFrame
    #: The protocol the catalogue gives a source, as a column over ``source``.
    hint: Column


class Present:
    """Which paths are there, by one listing per folder instead of a question per path."""

    def __init__(self, spark: SparkSession, system: JavaObject) -> None:
        self.jvm, self.system = spark._jvm, system
        self.folders: dict[str, tuple[str, set[str]]] = {}

    def _folder(self, folder: str) -> tuple[str, set[str]]:
        if folder not in self.folders:
            path = self.jvm.org.apache.hadoop.fs.Path(folder)
            names: set[str] = set()
            if self.system.exists(path):
                found = self.jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(self.system.listStatus(path))
                names = {one.getName() for one in found}
            self.folders[folder] = self.system.makeQualified(path).toUri().toString().rstrip("/"), names
        return self.folders[folder]

    def uri(self, target: str) -> str | None:
        """The whole path as Spark names it, None if nothing is there."""
        folder, _, name = target.rpartition("/")
        if folder and re.fullmatch("[A-Za-z0-9_=-][A-Za-z0-9._=-]*", name):
            above, names = self._folder(folder)
            return f"{above}/{name}" if name in names else None
        # Names that a path would write in another way.
        path = self.jvm.org.apache.hadoop.fs.Path(target)
        return self.system.makeQualified(path).toUri().toString() if self.system.exists(path) else None


def read_catalogue(spark: SparkSession, configs: DataFrame, folder: str, root: str | None = None) -> Discovered:
    """Read the enabled, sound sources of a catalogue (:func:`.lists.validate_sources`).

    Columns beyond those: ``items_path`` and ``mapping`` (a name of :func:`.feeds.register_source_mapping`) of
    JSON sources. All list sources are one scan, JSON sources one scan per path and mapping.
    """
    wanted = [name for name in ("items_path", "mapping") if name in configs.columns]
    checked = lists.validate_sources(configs).filter("fault is null and enabled")
    # The catalogue is configuration: a row per source.
    rows = checked.select("id", "kind", "path", "protocol", *wanted).orderBy("ord").collect()
    files = Ledger(spark, folder)

    def place(row) -> str | None:
        if row["kind"] != "local-file":
            return f"{folder.rstrip('/')}/{row['id']}"
        try:
            return None if root is None else lists.confined(row["path"], root)
        except ValueError:
            return None

    paths, lost = {}, []
    present = Present(spark, files.files())
    for row in rows:
        target = place(row)
        path = None if target is None else present.uri(target)
        if path is None:
            lost.append((row["id"], UNREADABLE))
        else:
            paths[row["id"]] = path

    def places(own: list[str]) -> DataFrame:
        """(path, source): a table to join, as a constant would be searched for every line."""
        # Local paths are written with one slash or three behind their scheme.
        named = {re.sub("^file:/+", "/", path): source for source, path in paths.items()}
        wanted = {re.sub("^file:/+", "/", path) for path in own}
        return spark.createDataFrame([(path, source) for path, source in named.items() if path in wanted], "path string, source string")

    plain = [paths[r["id"]] for r in rows if r["id"] in paths and r["kind"] != "json-endpoint"]
    lines = lists.read_lists(spark, plain, places(plain)).select("source", "line_no", "line") if plain else None
    faults = spark.createDataFrame(lost, FAULTS)
    mapped = None
    groups: dict[tuple[str, str | None], list[str]] = {}
    for row in rows:
        if row["id"] in paths and row["kind"] == "json-endpoint":
            said = row.asDict()
            groups.setdefault((said.get("items_path") or "", said.get("mapping")), []).append(paths[row["id"]])
    for (items_path, mapping), own in groups.items():
        pieces = lists.with_source(json_scan.pieces_of_files(spark, own).drop("source"), places(own), F.col("split.file"))
        items, bad = json_scan.scan_items(pieces, items_path)
        part = cut_lineage(feeds.map_json_fields(items, feeds.source_mapping(mapping)))
        mapped = part if mapped is None else mapped.unionByName(part)
        faults = faults.unionByName(bad)
    # A set of ids per protocol is hashed; a map would be searched from its start for every line.
    hint = F.lit(None).cast("string")
    for protocol in sorted({r["protocol"] for r in rows if r["protocol"] is not None}):
        hint = F.when(F.col("source").isin([r["id"] for r in rows if r["protocol"] == protocol]), protocol).otherwise(hint)
    return Discovered(
        lines if lines is not None else spark.createDataFrame([], LINES),
        mapped,
        faults,
        lists.enabled_sources(configs),
        hint,
    )
