"""List lines to endpoints: entry grammar, section labels, per-source reports.

``parse_entries`` works through the grammar in stages of plain columns. Each stage
is one projection; the first failed rule, in grammar order, names the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import entry as E
from ..functions.keys import dedupe_key, redacted_url
from ..functions.text import skip_chars, squeeze_ends, utf16_units
from ..session import spread
from .running import evaluate_once, running

BLOCK_LINES = 200_000  # lines one task carries of one source
PARSED = [
    "ok",
    "reason",
    "host",
    "port",
    "protocol",
    "protocol_source",
    "username",
    "password",
    "country",
    "anonymity",
]


def _too_long(raw: Column) -> Column:
    # Bytes bound UTF-16 units from above, so the exact count is rarely needed.
    return F.when(F.octet_length(raw) <= E.MAX_ENTRY, False).otherwise(utf16_units(raw) > E.MAX_ENTRY)


def parse_entries(
    df: DataFrame, line: str = "line", hint: str | None = None, default_protocol: str = "http"
) -> DataFrame:
    """Add the :data:`PARSED` columns for the entry text in ``line``.

    Shapes: ``h:p``, ``h p``, ``h:p:user:pw[:cc]``, ``user:pw@h:p``, ``scheme://...``,
    ``scheme:h:p`` and ``scheme://[v6]:p``. ``hint`` names a column with the protocol of
    the enclosing section.
    """
    keep = [F.col(name) for name in df.columns]
    c = F.col
    # Scheme.
    df = df.select(*keep, squeeze_ends(F.coalesce(c(line), F.lit(""))).alias("_raw"))
    df = df.select(
        *keep,
        "_raw",
        F.lower(F.regexp_extract("_raw", r"(?i)^([a-z][a-z0-9+.-]{0,15})://", 1)).alias("_scheme"),
        F.when(
            ~c("_raw").contains("@"), F.lower(F.regexp_extract("_raw", r"(?i)^([a-z][a-z0-9+.-]{0,15}):", 1))
        )
        .otherwise("")
        .alias("_prefix"),
    )
    slashed, prefixed = c("_scheme") != "", c("_prefix") != ""
    name = F.when(slashed, c("_scheme")).when(prefixed, c("_prefix"))
    df = df.select(
        *keep,
        "_raw",
        E.scheme_protocol(name).alias("_given"),
        F.when(slashed, skip_chars(c("_raw"), F.length("_scheme") + 3))
        .when(prefixed, skip_chars(c("_raw"), F.length("_prefix") + 1))
        .otherwise(c("_raw"))
        .alias("_rest"),
        F.when(c("_raw") == "", "empty")
        .when(_too_long(c("_raw")), "too_long")
        .when(c("_raw").rlike(r"[\r\n\t]"), "ambiguous_format")
        .when(E.looks_like_markup(c("_raw")), "not_an_entry")
        .when((slashed | prefixed) & E.scheme_protocol(name).isNull(), "invalid_scheme")
        .when(slashed & (F.length("_raw") == F.length("_scheme") + 3), "invalid_host")
        .alias("_why"),
    )
    # Authority and account.
    df = df.select(*keep, "_raw", "_given", "_why", F.substring_index("_rest", "/", 1).alias("_auth"))
    at_sign = c("_auth").contains("@")
    df = df.select(
        *keep,
        "_raw",
        "_given",
        F.coalesce(c("_why"), F.when(c("_auth").rlike("[?#]"), "ambiguous_format")).alias("_why"),
        at_sign.alias("_at"),
        F.when(at_sign, F.regexp_extract("_auth", r"(?s)^(.*)@", 1)).alias("_info"),
        F.substring_index("_auth", "@", -1).alias("_server"),
    )
    df = df.select(
        *keep,
        "_raw",
        "_given",
        F.coalesce(
            c("_why"),
            F.when(c("_at") & (c("_server").contains(" ") | (squeeze_ends(c("_server")) == "")), "invalid_host"),
        ).alias("_why"),
        "_at",
        "_info",
        "_server",
        F.split("_server", ":").alias("_parts"),
        c("_server").rlike(r"^\[[^\]]+\]").alias("_boxed"),
    )
    # Layout.
    part = lambda i: F.get("_parts", F.lit(i))
    count = F.size("_parts")
    spaced = ~c("_boxed") & c("_server").contains(" ") & ~c("_server").contains(":")
    hexish = F.forall("_parts", lambda p: p.rlike("(?i)^[0-9a-f]{0,4}$"))
    gap = F.exists("_parts", lambda p: p == "")
    bare_v6 = (count >= 5) & hexish & (gap | (count >= 7))
    layout = (
        F.when(c("_at"), "account")
        .when(spaced, "spaced")
        .when(c("_boxed"), "boxed")
        .when(bare_v6, "bare_v6")
        .when(count == 1, "lone")
        .when(count == 2, "pair")
        .when(count.isin(4, 5), "fields")
        .when(count == 3, "triple")
        .otherwise("many")
    )
    df = df.select(*keep, "_raw", "_given", "_why", "_info", "_server", "_parts", layout.alias("_layout"))
    words = F.split("_server", r"\s+")
    behind = F.regexp_replace(E.behind_bracket(c("_server")), "^:", "")
    is_layout = lambda *names: c("_layout").isin(*names)
    df = df.select(
        *keep,
        "_raw",
        "_given",
        "_why",
        "_server",
        "_layout",
        "_parts",
        E.normalize_host(
            F.when(is_layout("spaced"), F.get(words, F.lit(0)))
            .when(is_layout("boxed"), F.substring("_server", F.lit(1), F.locate("]", c("_server"))))
            .otherwise(part(0))
        ).alias("_host"),
        E.normalize_port(
            F.when(is_layout("spaced"), F.get(words, F.lit(1)))
            .when(is_layout("boxed") | (is_layout("account") & c("_server").startswith("[")), behind)
            .when(is_layout("account"), F.array_join(F.slice("_parts", 2, 64), ":"))
            .otherwise(part(1))
        ).alias("_port"),
        F.when(is_layout("account"), F.substring_index("_info", ":", 1))
        .when(is_layout("fields"), part(2))
        .alias("_user"),
        F.when(
            is_layout("account") & c("_info").contains(":"),
            skip_chars(c("_info"), F.locate(":", c("_info"))),
        )
        .when(is_layout("fields"), part(3))
        .alias("_pass"),
        F.when(is_layout("fields"), part(4)).alias("_cc"),
    )
    port_token = F.when(c("_server").startswith("["), E.behind_bracket(c("_server"))).otherwise(
        skip_chars(c("_server"), F.locate(":", c("_server")))
    )
    has_token = c("_server").rlike(r"[:\]]") & (squeeze_ends(port_token) != "")
    hex_only = F.forall("_parts", lambda p: p.rlike("(?i)^[0-9a-f]+$"))
    given = lambda column: F.coalesce(c(column), F.lit("")) != ""
    df = df.select(
        *keep,
        "_given",
        F.coalesce(
            c("_why"),
            F.when(is_layout("bare_v6"), "ipv6_requires_brackets")
            .when(is_layout("fields") & (c("_user") == ""), "ambiguous_format")
            .when(is_layout("fields") & c("_cc").isNotNull() & ~c("_cc").rlike("^[A-Za-z]{2}$"), "ambiguous_format")
            .when(is_layout("triple"), "ambiguous_format")
            .when(
                is_layout("lone") & c("_host").isNull(),
                F.when(c("_raw").contains(":"), "ipv6_requires_brackets").otherwise("invalid_host"),
            )
            .when(is_layout("lone"), "no_port")
            .when(is_layout("many"), F.when(hex_only, "ipv6_requires_brackets").otherwise("ambiguous_format"))
            .when(c("_host").isNull(), "invalid_host")
            .when(c("_port").isNull(), F.when(has_token, "invalid_port").otherwise("no_port")),
        ).alias("_why"),
        "_host",
        "_port",
        given("_user").alias("_has_user"),
        given("_pass").alias("_has_pass"),
        F.when(given("_user"), E.clean_credential(c("_user"))).alias("_user"),
        F.when(given("_pass"), E.clean_credential(c("_pass"))).alias("_pass"),
        F.upper("_cc").alias("_cc"),
    )
    # Account checks and the protocol.
    bad_account = (
        (c("_has_user") & c("_user").isNull())
        | (c("_has_pass") & c("_pass").isNull())
        | (c("_has_pass") & ~c("_has_user"))
    )
    df = df.withColumn("_why", F.coalesce(c("_why"), F.when(bad_account, "invalid_credentials")))
    section = c(hint) if hint else F.lit(None).cast("string")
    good = c("_why").isNull()
    staged = [
        good.alias("ok"),
        c("_why").alias("reason"),
        F.when(good, c("_host")).alias("host"),
        F.when(good, c("_port")).alias("port"),
        F.when(good, F.coalesce(c("_given"), section, F.lit(default_protocol))).alias("protocol"),
        F.when(
            good,
            F.when(c("_given").isNotNull(), "scheme").when(section.isNotNull(), "hint").otherwise("default"),
        ).alias("protocol_source"),
        F.when(good, c("_user")).alias("username"),
        F.when(good, c("_pass")).alias("password"),
        F.when(good, c("_cc")).alias("country"),
        F.when(good, "unknown").alias("anonymity"),
    ]
    return df.select(*evaluate_once(keep, staged))


def label_lines(lines: DataFrame) -> DataFrame:
    """Add ``text`` and ``kind``: blank, comment, label, noise, rejected or entry."""
    text = squeeze_ends(F.col("line"))
    df = lines.withColumn("text", text)
    t = F.col("text")
    kind = (
        F.when(t == "", "blank")
        .when(t.rlike("^(?:#|//|;)"), "comment")
        .when(_too_long(t) | E.looks_like_markup(t), "rejected")
        .when(t.contains(":"), "entry")
        .when(E.detect_protocol(t).isNotNull(), "label")
        .when(~t.rlike(r"\s") & t.rlike(r"\d"), "entry")
        .otherwise("noise")
    )
    return df.withColumn("kind", kind)


def section_hints(labelled: DataFrame, start_hint: Column | str | None = None, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Add ``hint``: the last label above each line of its source.

    Lines are cut into blocks, so one endless source is still many tasks.
    """
    label = F.when(F.col("kind") == "label", E.detect_protocol(F.col("text")))
    block = F.floor(F.col("line_no") / block_lines)
    hinted = running(labelled, ["source"], ["line_no"], block, {"hint": ("last", label)})
    return hinted.withColumn("hint", F.coalesce("hint", F.lit(start_hint)))


def parse_lines(lines: DataFrame, start_hint: Column | str | None = None, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Every line of ``(source, line_no, line)`` with its kind and parsed entry.

    ``outcome`` is blank, skipped, rejected or accepted; repeats are still in. Lines are dealt to all
    cores for the labels, and once more for the grammar, as a source may be one block.
    """
    hinted = section_hints(label_lines(spread(lines)), start_hint, block_lines)
    parsed = parse_entries(spread(hinted), "text", "hint")
    kind, ok = F.col("kind"), F.col("ok")
    outcome = (
        F.when(kind == "blank", "blank")
        .when(kind.isin("comment", "label", "noise"), "skipped")
        .when((kind == "entry") & ok, "accepted")
        .otherwise("rejected")
    )
    accepted = F.col("outcome") == "accepted"
    df = parsed.withColumn("outcome", outcome).withColumn(
        "reason", F.when(F.col("outcome") == "rejected", F.col("reason"))
    )
    return df.select(
        *lines.columns,
        "outcome",
        "reason",
        *[F.when(accepted, F.col(name)).alias(name) for name in PARSED if name not in ("ok", "reason")],
        F.when(
            accepted,
            dedupe_key(F.col("protocol"), F.col("host"), F.col("port"), F.col("username")),
        ).alias("entry_key"),
    )


CANDIDATE = ["protocol", "host", "port", "username", "password", "country", "anonymity"]


def first_entries(parsed: DataFrame) -> DataFrame:
    """Distinct accepted entries per source, first line first, with ``copies``.

    A grouped minimum, so repeats of one endpoint collapse before the shuffle.
    """
    first = F.min(F.struct("line_no", *CANDIDATE))
    return (
        parsed.filter("outcome = 'accepted'")
        .groupBy("source", "entry_key")
        .agg(first.alias("_first"), F.count("*").alias("copies"))
        .select("source", "_first.line_no", "entry_key", *[f"_first.{name}" for name in CANDIDATE], "copies")
    )


def cut_after_accepted(parsed: DataFrame, max_entries: int, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Drop every line behind the ``max_entries``-th distinct accepted one of its source."""
    ranked = running(
        first_entries(parsed).select("source", "line_no"),
        ["source"],
        ["line_no"],
        F.floor(F.col("line_no") / block_lines),
        {"rank": ("sum", F.lit(1))},
    )
    last = ranked.filter(F.col("rank") == max_entries).select("source", F.col("line_no").alias("_last"))
    return (
        parsed.join(last, "source", "left")
        .filter(F.col("_last").isNull() | (F.col("line_no") <= F.col("_last")))
        .drop("_last")
    )


def source_report(parsed: DataFrame, total_lines: DataFrame | None = None) -> DataFrame:
    """Per source: total, skipped, accepted, rejected and duplicate lines.

    ``total_lines`` (source, total_lines) replaces the counted lines when lines were cut.
    Grouping by entry first keeps a much repeated endpoint out of one task.
    """
    per_entry = parsed.groupBy("source", "entry_key", "outcome").agg(F.count("*").alias("n"))
    hit = F.col("outcome") == "accepted"
    report = per_entry.groupBy("source").agg(
        F.sum("n").alias("total_lines"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "skipped", F.col("n"))), F.lit(0)).alias("skipped_lines"),
        F.count_if(hit).alias("accepted"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "rejected", F.col("n"))), F.lit(0)).alias("rejected"),
        F.coalesce(F.sum(F.when(hit, F.col("n") - 1)), F.lit(0)).alias("duplicates"),
    )
    if total_lines is not None:
        report = total_lines.join(report.drop("total_lines"), "source", "left").na.fill(0)
    return report


def rejects(parsed: DataFrame) -> DataFrame:
    """Every rejected line with its place and reason."""
    return parsed.filter("outcome = 'rejected'").select("source", "line_no", "reason", "line")


def reject_samples(parsed: DataFrame, per_source: int = 25) -> DataFrame:
    """The first rejected lines of each source, to show; :func:`rejects` has them all."""
    order = Window.partitionBy("source").orderBy("line_no")
    return (
        rejects(parsed)
        .select("source", "line_no", "reason", squeeze_ends(F.col("line")).alias("sample"))
        .withColumn("nth", F.row_number().over(order))
        .filter(F.col("nth") <= per_source)
    )


def reject_reasons(parsed: DataFrame) -> DataFrame:
    """Rejected lines by reason."""
    return parsed.filter("outcome = 'rejected'").groupBy("reason").agg(F.count("*").alias("lines"))


def normalize_report(parsed: DataFrame, samples: int = 25) -> DataFrame:
    """:func:`source_report` plus the first rejects of each source as an array."""
    picked = (
        reject_samples(parsed, samples)
        .groupBy("source")
        .agg(F.sort_array(F.collect_list(F.struct("line_no", "sample", "reason"))).alias("rejection_samples"))
    )
    return source_report(parsed).join(picked, "source", "left")


def redacted(endpoints: DataFrame) -> Column:
    """Credential-free rendering of an endpoint row."""
    return redacted_url(*[endpoints[name] for name in ("protocol", "host", "port", "username")])
