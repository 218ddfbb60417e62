"""URL parts, the fetch policy over URLs and request identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .address import inspect_address, ipv6_words, is_ipv4, is_metadata_host
from .idna import ascii_host
from .text import BLANK, let, squeeze_ends

MAX_URL_LENGTH = 2048

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
# A web URL: any slashes, the authority, then path, query and fragment.
_WEB = r"^[A-Za-z][A-Za-z0-9+.-]*:[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def _authority(url: Column) -> Column:
    return F.regexp_extract(url, _WEB, 1)


def _server(url: Column) -> Column:
    return F.substring_index(_authority(url), "@", -1)


def _host_of(server: Column) -> Column:
    return F.lower(F.regexp_extract(server, r"^(\[[^\]]*\]|[^:]*)(?::.*)?$", 1))


def _port_of(server: Column) -> Column:
    return F.regexp_extract(server, r"^(?:\[[^\]]*\]|[^:\[]*):(.*)$", 1)


def raw_host(url: Column) -> Column:
    """Host as written, lower case, without account and port."""
    return _host_of(_server(url))


def port_text(url: Column) -> Column:
    return _port_of(_server(url))


def path_of(url: Column) -> Column:
    """Path with a leading slash."""
    path = F.translate(F.regexp_extract(url, _WEB, 2), "\\", "/")
    return F.when(path == "", "/").otherwise(path)


def query_of(url: Column) -> Column:
    """Query without its question mark."""
    return F.regexp_replace(F.regexp_extract(url, _WEB, 3), r"^\?", "")


def _ip_number(label: Column) -> Column:
    """Decimal, octal (leading 0) or hex (leading 0x) number of a host label."""
    return (
        F.when(label.rlike(r"^0[xX]$"), F.lit(0).cast("bigint"))
        .when(label.rlike(r"^0[xX][0-9a-fA-F]{1,8}$"), F.conv(F.substring(label, 3, 8), 16, 10).try_cast("bigint"))
        .when(label.rlike(r"^0[0-7]+$"), F.conv(label, 8, 10).try_cast("bigint"))
        .when(label.rlike(r"^(0|[1-9]\d{0,9})$"), label.try_cast("bigint"))
    )


def canonical_host(url: Column) -> Column:
    """Host as a browser would read it: number-like hosts become dotted quads.

    NULL when a number-like host is no address, which makes the URL malformed.
    """
    return let(raw_host(url), _canonical)


def _canonical(host: Column) -> Column:
    # Hosts may be written in percent codes and in any script; plain ones, the usual case, go through.
    odd = host.rlike(r"[^\x00-\x7F]|%[0-9a-fA-F]{2}") & ~host.startswith("[")
    decoded = F.coalesce(F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B"))), host)
    return let(F.when(odd, let(decoded, ascii_host)).otherwise(host), _numbered)


def _numbered(host: Column) -> Column:
    def quad(value: Column) -> Column:
        return F.concat_ws(
            ".", *[(F.shiftright(value, shift) % 256).cast("string") for shift in (24, 16, 8, 0)]
        )

    def address(numbers: Column) -> Column:
        # All but the last number are one byte; the last one fills what is left.
        count, tail = F.size(numbers), F.element_at(numbers, -1)
        room = F.when(count == 1, 2**32).when(count == 2, 2**24).when(count == 3, 2**16).otherwise(2**8)
        lead = F.aggregate(
            F.transform(
                F.slice(numbers, F.lit(1), count - 1),
                lambda n, i: F.when(i == 0, n * 2**24).when(i == 1, n * 2**16).otherwise(n * 2**8),
            ),
            F.lit(0).cast("bigint"),
            lambda total, n: total + n,
        )
        fits = (
            (count <= 4)
            & ~F.exists(numbers, lambda n: n.isNull())
            & F.forall(F.slice(numbers, F.lit(1), count - 1), lambda n: n <= 255)
            & (tail < room)
        )
        return F.when(fits, let(lead + tail, quad))

    labels = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")
    numberish = host.rlike(r"(?:^|\.)(?:\d+|0[xX][0-9a-fA-F]*)\.?$") & ~host.startswith("[")
    # A clean dotted quad, the usual case, is its own canonical form.
    return F.when(~numberish | is_ipv4(host), host).otherwise(let(F.transform(labels, _ip_number), address))


def origin_of(url: Column) -> Column:
    """``scheme://host[:port]`` with the default port left out; NULL when malformed."""
    scheme, port = scheme_of(url), port_text(url)
    usual = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    shown = F.when((port == "") | usual, "").otherwise(F.concat(F.lit(":"), port))
    return F.when(
        scheme.isin("http", "https") & (raw_host(url) != ""),
        F.concat(scheme, F.lit("://"), canonical_host(url), shown),
    )


def url_policy(
    url: Column,
    protocols: Sequence[str] = ("http:", "https:"),
    allow_private: bool = False,
    block_metadata: bool = True,
    ports: Sequence[int] = (),
    max_length: int = MAX_URL_LENGTH,
) -> Column:
    """struct(ok, reason): the first failed rule names the reason."""

    def parts(value: Column) -> Column:
        return let(_authority(value), lambda authority: let(facts(value, authority), judge))

    def facts(value: Column, authority: Column) -> Column:
        server = F.substring_index(authority, "@", -1)
        return F.struct(
            value.alias("value"),
            scheme_of(value).alias("scheme"),
            authority.alias("authority"),
            _port_of(server).alias("port"),
            let(_host_of(server), _canonical).alias("canonical"),
        )

    def judge(f: Column) -> Column:
        value, scheme, authority, port, canonical = (
            f[name] for name in ("value", "scheme", "authority", "port", "canonical")
        )
        bad_host = (
            canonical.isNull()
            | (canonical == "")
            | (~canonical.startswith("[") & canonical.rlike(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]"))
            | (canonical.startswith("[") & ipv6_words(canonical).isNull())
        )
        # A failing cast builds an error text per row, so only digits get there.
        given = F.when(port.rlike(r"^\d{1,5}$"), port.try_cast("int"))
        bad_port = ~port.rlike(r"^\d{0,5}$") | F.coalesce(given > 65535, F.lit(False))
        malformed = (scheme == "") | (scheme.isin("http", "https") & (bad_host | bad_port))
        host = F.regexp_replace(canonical, r"^\[|\]$", "")
        number = F.coalesce(given, F.when(scheme == "https", 443).otherwise(80))
        address = let(
            inspect_address(host),
            lambda v: F.when(
                (v["kind"] != "hostname")
                & v["blocked"]
                & ~(v["classification"] != "cloud_metadata" if allow_private else F.lit(False)),
                F.concat(v["classification"], F.lit(" address ("), host, F.lit(") is not allowed")),
            ),
        )
        early = (
            F.when(value == "", "empty url")
            .when(F.length(value) > max_length, f"url longer than {max_length} characters")
            .when(
                value.rlike(BLANK + r"|[\x00-\x1f\x7f-\x9f]"), "url contains whitespace or control characters"
            )
            .when(malformed, "url is not absolute or is malformed")
            .when(
                ~F.concat(scheme, F.lit(":")).isin(*protocols),
                F.concat(F.lit('protocol "'), scheme, F.lit(':" is not allowed')),
            )
            .when(authority.contains("@") & ~authority.rlike("^:?@[^@]*$"), "credentials in URL are not allowed")
            .when(F.coalesce(host, F.lit("")) == "", "missing hostname")
            .when((host == "localhost") | host.endswith(".localhost"), "the localhost name space is not allowed")
            .when(
                is_metadata_host(host) if block_metadata else F.lit(False),
                "cloud metadata endpoints are not allowed",
            )
        )
        late = (
            F.when(number < 1, "invalid port")
            .when(
                ~number.isin(*ports) if ports else F.lit(False),
                F.concat(F.lit("port "), number.cast("string"), F.lit(" is not in the allowed port list")),
            )
            .when(number == 25, "SMTP port 25 is not allowed")
        )
        return F.coalesce(early, address, late)

    reason = let(squeeze_ends(F.coalesce(url, F.lit(""))), parts)
    return let(reason, lambda why: F.struct(why.isNull().alias("ok"), why.alias("reason")))


def host_is_literal_ip(host: Column) -> Column:
    return inspect_address(host)["kind"] != "hostname"


def cache_key(url: Column, namespace: str = "pp") -> Column:
    """Path and sorted query without the cache-busting parameters.

    Names and values are read and written again, so one text has one spelling.
    """

    def read(part: Column) -> Column:
        # Text that is no valid escape stands for itself.
        return F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))

    pairs = F.transform(
        F.filter(F.split(query_of(url), "&"), lambda p: p != ""),
        lambda p: F.struct(
            read(F.substring_index(p, "=", 1)).alias("name"),
            read(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("value"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~p["name"].isin("bypass_cache", "_"))
    # Equal names keep their order, so the position breaks ties, not the value.
    ordered = F.array_sort(
        F.transform(kept, lambda p, i: F.struct(p["name"].alias("name"), i.alias("pos"), p["value"].alias("value")))
    )
    query = F.array_join(
        F.transform(ordered, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))), "&"
    )
    return F.concat(
        F.lit(namespace + ":"), path_of(url), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))
    )


def client_address(forwarded: Column, fallback: Column) -> Column:
    """First forwarded address, else the fallback header's."""

    def first(header: Column) -> Column:
        entry = squeeze_ends(F.substring_index(header, ",", 1))
        return F.when(F.length(entry) > 0, entry)

    return F.coalesce(first(forwarded), first(fallback), F.lit("unknown"))


def odd_client(client: Column, most: int = 64) -> Column:
    """A client address longer than an address can be."""
    return F.length(client) > most
