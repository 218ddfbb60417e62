"""JSON feeds: items at a path, mapped fields, metadata put back on parsed entries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entry import anonymity_level, detect_protocol
from ..functions.text import squeeze_ends
from ..operators.running import evaluate_once, running

ITEM_BLOCK = 20_000  # items of a feed that are numbered together

# The field names looked at, in this order. `anonymity` is no endpoint
# name here, or items that carry host, port and anonymity would be lost.
DEFAULT_FIELDS: dict[str, list[str]] = {
    "endpoint": ["proxy", "endpoint", "server", "address", "host_port"],
    "host": ["host", "ip", "ip_address", "address"],
    "port": ["port"],
    "protocol": ["protocol", "scheme", "type"],
    "country": ["country", "country_code", "geo", "location_code"],
    "anonymity": ["anonymity", "anon", "level"],
    "username": ["username", "user", "login"],
    "password": ["password", "pass"],
}
_MAPPINGS: dict[str, dict[str, list[str]]] = {}


def register_source_mapping(name: str, fields: Mapping[str, Sequence[str]]) -> None:
    """Name a field mapping; fields it leaves out keep their defaults."""
    _MAPPINGS[name] = {key: list(names) for key, names in fields.items()}


def source_mapping(name: str | None) -> dict[str, list[str]]:
    return {**DEFAULT_FIELDS, **_MAPPINGS.get(name or "", {})}


def read_json_items(
    bodies: DataFrame, items_path: str = "", source: str = "source", body: str = "body", max_items: int | None = None
) -> DataFrame:
    """(source, pos, item): the array at a dotted path, all of it or its first ``max_items`` items.

    The path goes through objects only; anything else, and text that is no JSON, has no items
    (:func:`feed_faults` names those bodies, and what a limit leaves out).
    """
    steps = "".join(f"['{step}']" for step in items_path.split(".") if step)
    items = F.try_variant_get(F.try_parse_json(body), f"${steps}", "array<variant>")
    taken = items if max_items is None else F.slice(items, 1, max_items)
    return bodies.select(F.col(source).alias("source"), F.posexplode(taken).alias("pos", "item"))


def feed_faults(
    bodies: DataFrame, items_path: str = "", source: str = "source", body: str = "body", max_items: int | None = None
) -> DataFrame:
    """(source, reason, left_out): bodies that give no items, and how many items a limit leaves out.

    A reason is ``not json`` (or more than a variant value holds), ``no list`` or ``over limit``.
    """
    steps = "".join(f"['{step}']" for step in items_path.split(".") if step)
    doc = F.try_parse_json(body)
    size = F.size(F.try_variant_get(doc, f"${steps}", "array<variant>"))
    read = bodies.select(*evaluate_once([F.col(source).alias("source")], [doc.isNotNull().alias("_json"), size.alias("_size")]))
    over = F.lit(0) if max_items is None else F.greatest(F.col("_size") - max_items, F.lit(0))
    reason = (
        F.when(~F.col("_json"), "not json").when(F.col("_size") < 0, "no list").when(over > 0, "over limit")
    )
    return (
        read.fillna({"_size": -1})
        .select("source", reason.alias("reason"), F.when(reason == "over limit", over).alias("left_out"))
        .filter("reason is not null")
    )


def _text(item: Column, name: str) -> Column:
    """Text of a string or number field; other values count as absent text."""
    value = F.try_variant_get(item, f"$['{name}']", "variant")
    kind = F.schema_of_variant(value)
    plain = kind.isin("STRING", "BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.struct(
        (value.isNotNull() & (kind != "VOID")).alias("there"),
        F.when(plain, F.try_variant_get(item, f"$['{name}']", "string")).alias("text"),
    )


def pick_text(item: Column, names: Sequence[str]) -> Column:
    """Text of the first field that is there and not null."""
    fields = [_text(item, name) for name in names]
    out = F.when(fields[0]["there"], fields[0]["text"])
    for field in fields[1:]:
        out = out.when(field["there"], field["text"])
    return out


def map_json_fields(items: DataFrame, fields: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(source, pos, line, meta_key, protocol, country, anonymity, username, password).

    A string item is a line. In an object the endpoint text wins over host plus port; items
    without both are dropped. ``meta_key`` is the lower-case ``host:port`` of objects.
    """
    names = {**DEFAULT_FIELDS, **(fields or {})}
    kind = F.schema_of_variant("item")
    is_text, is_object = kind == "STRING", kind.startswith("OBJECT")
    staged = [
        F.when(is_text, F.try_variant_get("item", "$", "string")).alias("_line"),
        *[
            F.when(is_object, pick_text(F.col("item"), names[field])).alias(f"_{field}")
            for field in DEFAULT_FIELDS
        ],
    ]
    df = items.select(*evaluate_once(["source", "pos"], staged))
    c = F.col
    endpoint = F.when(F.coalesce("_endpoint", F.lit("")) != "", squeeze_ends(c("_endpoint")))
    server = F.substring_index(F.regexp_replace(endpoint, "(?s)^.*?://", ""), "@", -1)
    parts = F.split(server, ":")
    host = F.when(endpoint.isNotNull(), F.get(parts, F.lit(0))).otherwise(squeeze_ends(c("_host")))
    port = F.when(endpoint.isNotNull(), F.substring_index(F.get(parts, F.lit(1)), "/", 1)).otherwise(
        squeeze_ends(c("_port"))
    )
    df = df.select("*", endpoint.alias("_full"), host.alias("_h"), port.alias("_p"))
    country = squeeze_ends(c("_country"))
    filled = lambda name: F.when(c(name) != "", c(name))
    return df.filter("_line is not null or (coalesce(_h, '') <> '' and coalesce(_p, '') <> '')").select(
        "source",
        "pos",
        F.coalesce("_line", "_full", F.concat_ws(":", "_h", "_p")).alias("line"),
        F.when(
            c("_line").isNull(), F.lower(F.concat(squeeze_ends(c("_h")), F.lit(":"), squeeze_ends(c("_p"))))
        ).alias("meta_key"),
        detect_protocol(c("_protocol")).alias("protocol"),
        F.when(country.rlike("(?i)^[a-z]{2}$"), F.upper(country)).alias("country"),
        anonymity_level(c("_anonymity")).alias("anonymity"),
        filled("_username").alias("username"),
        filled("_password").alias("password"),
    )


def feed_lines(mapped: DataFrame) -> DataFrame:
    """The flat list the mapped items stand for, ready for the line parser.

    An item may hold several lines; they keep the item order.
    """
    parts = mapped.select("source", "pos", F.split("line", r"\r?\n").alias("_parts"))
    counted = running(
        parts, ["source"], ["pos"], F.floor(F.col("pos") / ITEM_BLOCK), {"_upto": ("sum", F.size("_parts"))}
    )
    return counted.select(
        "source", F.col("_upto") - F.size("_parts"), F.posexplode("_parts").alias("_sub", "line")
    ).toDF("source", "_first", "_sub", "line").select(
        "source", (F.col("_first") + F.col("_sub")).cast("bigint").alias("line_no"), "line"
    )


def attach_metadata(entries: DataFrame, mapped: DataFrame) -> DataFrame:
    """Put per-item metadata back on parsed entries by ``host:port``; the last item wins.

    A protocol only replaces http, an account only fills a gap; country and anonymity replace.
    """
    fields = ["protocol", "country", "anonymity", "username", "password"]
    told = F.coalesce(*fields).isNotNull()
    meta = (
        mapped.filter(F.col("meta_key").isNotNull() & told)
        .groupBy("source", "meta_key")
        .agg(F.max_by(F.struct(*fields), "pos").alias("_m"))
    )
    keyed = entries.withColumn("meta_key", F.lower(F.concat_ws(":", "host", "port")))
    m, c = (lambda name: F.col(f"_m.{name}")), F.col
    login = m("username").isNotNull() & c("username").isNull()
    new = {
        "protocol": F.when((c("protocol") == "http") & m("protocol").isNotNull(), m("protocol")).otherwise(c("protocol")),
        "country": F.coalesce(m("country"), c("country")),
        "anonymity": F.coalesce(m("anonymity"), c("anonymity")),
        "username": F.when(login, m("username")).otherwise(c("username")),
        "password": F.when(login & m("password").isNotNull(), m("password")).otherwise(c("password")),
    }
    joined = keyed.join(meta, ["source", "meta_key"], "left")
    return joined.select(*[new.get(name, c(name)).alias(name) for name in entries.columns])


