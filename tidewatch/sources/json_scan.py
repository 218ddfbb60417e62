"""JSON feeds of any size: the items of an array without holding the body.

A body is read in pieces, cut at its commas by Spark's text reader, so one file is read by many tasks. What a
comma means hangs on all that is in front of it: whether a string is open, and how deep it is nested.
Both are running values over blocks of pieces: a block is scanned for either state of the quotes, one row
per block carries the true state on, and a comma between items is one that is outside of strings at the
depth of the array. The array is found by the keys in front of it; only pieces above its depth are looked at
for keys. Items alone become variant values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

#: Pieces of a block.
BLOCK_PIECES = 20_000
PIECES = ["source", "split", "place", "text"]


def pieces_of_files(spark: SparkSession, paths: str | Sequence[str], source: Column | None = None) -> DataFrame:
    """(source, split, place, text): the pieces between commas, as a written table. ``source`` is the file name.

    Files of one source follow each other in the order of their paths, as if a comma stood between them.
    """
    raw = spark.read.option("lineSep", ",").text(paths)
    name = F.col("_metadata.file_name") if source is None else source
    # Ids and splits of one scan: another scan might cut the files elsewhere.
    return written(
        raw.select(
            name.alias("source"),
            F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")).alias("split"),
            F.monotonically_increasing_id().alias("place"),
            F.col("value").alias("text"),
        )
    )


def pieces_of_bodies(bodies: DataFrame, source: str = "source", body: str = "body") -> DataFrame:
    """The same of bodies held in a column; a null body is one empty piece."""
    text = F.coalesce(F.col(body), F.lit(""))
    return bodies.select(
        F.col(source).alias("source"), F.lit(0).cast("bigint").alias("split"), F.posexplode(F.split(text, ",", -1)).alias("place", "text")
    ).withColumn("place", F.col("place").cast("bigint"))


def _nesting(parts: Column, first: int) -> Column:
    """Opened minus closed brackets in every second part."""
    kept = F.concat_ws("", F.filter(parts, lambda _, i: i % 2 == first))
    count = lambda marks: F.length(kept) - F.length(F.translate(kept, marks, ""))
    return count("[{") - count("]}")


def scanned(pieces: DataFrame, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Pieces with ``open`` (a string is open where the piece begins), ``depth`` there, and the same behind it.

    ``part`` numbers the blocks of a source in order, ``place`` the pieces in a split.
    """
    bare = F.split(F.regexp_replace("text", r"(?s)\\.", ""), '"', -1)
    base = pieces.withColumn("block", F.floor(F.col("place") / block_pieces)).select(
        *PIECES, "block", bare.alias("parts")
    )
    counted = base.select(
        *PIECES, "block", (F.size("parts") - 1).alias("quotes"), _nesting(F.col("parts"), 0).alias("shut"), _nesting(F.col("parts"), 1).alias("within")
    )
    own = Window.partitionBy("source", "split", "block").orderBy("place")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    told = counted.withColumn("odd", odd)
    deep = lambda state: F.when(F.col("odd") == state, F.col("shut")).otherwise(F.col("within"))
    # One way if the block begins outside of strings, the other if inside.
    ways = told.withColumns({"way0": deep(0), "way1": deep(1)})
    local = ways.withColumns({f"down{k}": F.coalesce(F.sum(f"way{k}").over(before), F.lit(0)) for k in (0, 1)})
    totals = ways.groupBy("source", "split", "block").agg(
        *[F.sum(name).alias(f"all_{name}") for name in ("quotes", "way0", "way1")]
    )
    # One row per block.
    order = Window.partitionBy("source").orderBy("split", "block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    entered = totals.withColumns(
        {"inside": F.coalesce(F.sum("all_quotes").over(earlier), F.lit(0)) % 2, "part": F.row_number().over(order)}
    ).withColumn("own_depth", F.when(F.col("inside") == 0, F.col("all_way0")).otherwise(F.col("all_way1")))
    carried = entered.select(
        "source", "split", "block", "part", "inside", F.coalesce(F.sum("own_depth").over(earlier), F.lit(0)).alias("above")
    )
    pick = lambda name: F.when(F.col("inside") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    depth = (F.col("above") + pick("down")).cast("int")
    open_ = (F.col("inside") + F.col("odd")) % 2
    return local.join(carried, ["source", "split", "block"]).select(
        "source",
        "part",
        "place",
        "text",
        (open_ == 1).alias("open"),
        depth.alias("depth"),
        ((open_ + F.col("quotes")) % 2 == 1).alias("open_behind"),
        (depth + pick("way")).cast("int").alias("depth_behind"),
    )


MARK = r'(?s)"(?:[^"\\]|\\.)*"\s*:?|[\[\]{}]'
EVENT = "array<struct<at:int,kind:string,depth:int>>"


def _events(text: Column, depth: Column) -> Column:
    """Keys and brackets of a piece outside of strings: where they begin, what they are, the depth in front of them."""
    start = F.struct(F.lit(0).alias("at"), depth.cast("int").alias("depth"), F.array().cast(EVENT).alias("out"))

    def step(state: Column, part: Column) -> Column:
        mark = part["mark"]
        change = F.when(mark.isin("[", "{"), 1).when(mark.isin("]", "}"), -1).otherwise(0)
        at = state["at"] + F.length(part["gap"])
        event = F.struct(at.alias("at"), mark.alias("kind"), state["depth"].alias("depth"))
        return F.struct(
            (at + F.length(mark)).cast("int").alias("at"),
            (state["depth"] + change).cast("int").alias("depth"),
            F.concat(state["out"], F.array(event)).cast(EVENT).alias("out"),
        )

    marks = F.regexp_extract_all(text, F.lit(MARK), F.lit(0))
    gaps = F.split(text, MARK, -1)
    return F.aggregate(F.arrays_zip(marks.alias("mark"), F.slice(gaps, F.lit(1), F.size(marks)).alias("gap")), start, step, lambda s: s["out"])


def find_array(scan: DataFrame, items_path: str = "") -> DataFrame:
    """(source, part, place, at) of the bracket that opens the array at a dotted path, and of the one that closes it.

    Of a key that repeats the last one counts, as in a JSON reader. Columns ``end_*`` are null without an end.
    """
    steps = [step for step in items_path.split(".") if step]
    level = len(steps)
    # A string that is open in front runs to its quote; a piece that opens one shows no key behind it.
    text = F.when(F.col("open"), F.regexp_replace("text", r'(?s)^(?:[^"\\]|\\.)*"', F.lit(""))).otherwise(F.col("text"))
    skipped = F.length("text") - F.length(text)
    shallow = scan.filter((F.col("depth") <= level + 1) | (F.col("depth_behind") <= level))
    shallow = shallow.filter(~F.col("open") | F.contains(F.col("text"), F.lit('"')))
    events = shallow.select(
        "source", "part", "place", skipped.alias("skipped"), F.explode(_events(text, F.col("depth"))).alias("e")
    ).filter(F.col("e.depth") <= level + 1)
    events = events.select(
        "source",
        F.struct("part", "place", (F.col("skipped") + F.col("e.at")).alias("at")).alias("spot"),
        F.col("e.kind").alias("kind"),
        F.col("e.depth").alias("depth"),
    )
    is_key = F.col("kind").endswith(":")
    name = F.from_json(F.concat(F.lit("["), F.regexp_replace("kind", r"\s*:$", ""), F.lit("]")), "array<string>")[0]
    keys = {f"key{d}": F.when(is_key & (F.col("depth") == d), name) for d in range(1, level + 1)}
    # As many rows as there are keys and brackets above the array.
    upto = Window.partitionBy("source").orderBy("spot").rowsBetween(Window.unboundedPreceding, -1)
    placed = written(events.withColumns(keys)).withColumns(
        {f"key{d}": F.last(f"key{d}", ignorenulls=True).over(upto) for d in range(1, level + 1)}
    )
    right = (F.col("kind") == "[") & (F.col("depth") == level)
    for d, step in enumerate(steps, 1):
        right = right & (F.col(f"key{d}") == step)
    starts = placed.filter(right).groupBy("source").agg(F.max("spot").alias("start"))
    ends = (
        events.filter((F.col("kind") == "]") & (F.col("depth") == level + 1))
        .join(starts, "source")
        .filter(F.col("spot") > F.col("start"))
        .groupBy("source")
        .agg(F.min("spot").alias("end"))
    )
    return starts.join(ends, "source", "left")


def scan_items(pieces: DataFrame, items_path: str = "", block_pieces: int = BLOCK_PIECES) -> tuple[DataFrame, DataFrame]:
    """((source, pos, item), (source, reason)) of JSON bodies in pieces.

    ``item`` is a variant. A body whose brackets or quotes do not close, or with an item that is no JSON, is
    ``not json`` and gives no items; one without an array at the path is ``no list``.
    """
    scan = written(scanned(pieces, block_pieces))
    found = written(find_array(scan, items_path))
    level = len([step for step in items_path.split(".") if step])
    last = F.max_by(F.struct("depth_behind", "open_behind"), F.struct("part", "place"))
    shape = scan.groupBy("source").agg(last.alias("end"), F.min("depth_behind").alias("least"), F.max(F.col("text").rlike(r"\S")).alias("any"))
    spot = F.struct("part", "place")
    inside = scan.join(found.filter("end is not null"), "source").filter(
        (spot >= F.struct("start.part", "start.place")) & (spot <= F.struct("end.part", "end.place"))
    )
    first = (F.col("part") == F.col("start.part")) & (F.col("place") == F.col("start.place"))
    final = (F.col("part") == F.col("end.part")) & (F.col("place") == F.col("end.place"))
    upto = F.when(final, F.col("end.at")).otherwise(F.length("text"))
    begin = F.when(first, F.col("start.at") + 1).otherwise(0)
    # Is the comma behind a piece one between items?
    comma = (~final & ~F.col("open_behind") & (F.col("depth_behind") == level + 1)).cast("bigint")
    cut = inside.select("source", "part", "place", F.substring(F.col("text"), begin + 1, upto - begin).alias("text"), comma.alias("comma"))
    cut = written(cut)
    sums = cut.groupBy("source", "part").agg(F.sum("comma").alias("commas"))
    # One row per block.
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("source", "part", F.coalesce(F.sum("commas").over(before), F.lit(0)).alias("before"))
    local = Window.partitionBy("source", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    numbered = cut.withColumn("nth", F.coalesce(F.sum("comma").over(local), F.lit(0))).join(carried, ["source", "part"])
    texts = numbered.groupBy("source", (F.col("before") + F.col("nth")).alias("pos")).agg(
        F.array_sort(F.collect_list(F.struct("part", "place", "text"))).alias("parts")
    )
    joined = texts.select("source", "pos", F.array_join(F.transform("parts", lambda p: p["text"]), ",").alias("text"))
    read = written(joined.select("source", "pos", F.try_parse_json("text").alias("item"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text")))
    # ``[]`` has one empty text and no item.
    size = read.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("item").isNull()).alias("bad"), F.max(F.col("text") == "").alias("blank"))
    judged = shape.join(found.select("source", F.lit(True).alias("listed")), "source", "left").join(size, "source", "left")
    empty = F.coalesce((F.col("n") == 1) & F.col("blank"), F.lit(False))
    broken = (F.col("end.depth_behind") != 0) | F.col("end.open_behind") | (F.col("least") < 0) | ~F.col("any") | ((F.coalesce("bad", F.lit(0)) > 0) & ~empty)
    reason = F.when(broken, "not json").when(F.col("listed").isNull(), "no list")
    faults = written(judged.select("source", reason.alias("reason")).filter("reason is not null"))
    items = read.filter("item is not null").join(faults.select("source"), "source", "left_anti").select("source", F.col("pos").cast("int").alias("pos"), "item")
    return items, faults
