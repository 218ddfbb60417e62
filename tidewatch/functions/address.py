"""Address literals and the network policy over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, squeeze_ends

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

# Cloud metadata endpoints.
METADATA_HOSTS = [
    "169.254.169.254",
    "169.254.170.2",
    "metadata.google.internal",
    "metadata.goog",
    "fd00:ec2::254",
]


def is_ipv4(text: Column) -> Column:
    """Dotted quad without leading zeros."""
    return text.rlike(IPV4)


def octets(text: Column) -> Column:
    """The four numbers of a dotted quad as an array; NULL for anything else."""
    return F.when(is_ipv4(text), F.transform(F.split(text, r"\."), lambda part: part.try_cast("int")))


def ipv6_words(text: Column) -> Column:
    """Eight 16-bit words of an IPv6 literal, or NULL when it is malformed.

    A dotted quad is understood as a whole segment (``::1.2.3.4``), not behind
    other groups of the same segment.
    """
    none = F.array().cast("array<int>")

    def words(segment: Column) -> Column:
        groups = F.split(segment, ":")
        pair = lambda q: F.array(q[0] * 256 + q[1], q[2] * 256 + q[3])
        return (
            F.when(segment == "", none)
            .when(segment.contains("."), F.when(is_ipv4(segment), let(octets(segment), pair)))
            .when(
                F.forall(groups, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$")),
                F.transform(groups, lambda g: F.conv(g, 16, 10).try_cast("int")),
            )
        )

    def fill(sides: Column) -> Column:
        left, right = sides["left"], sides["right"]
        missing = F.lit(8) - F.size(left) - F.size(right)
        fits = F.when(sides["gap"], missing >= 0).otherwise(missing == 0)
        return F.when(fits, F.concat(left, F.array_repeat(F.lit(0), F.greatest(missing, F.lit(0))), right))

    def read(body: Column) -> Column:
        gap = body.contains("::")
        head = F.substring_index(body, "::", 1)
        tail = F.when(gap, F.substring_index(body, "::", -1)).otherwise("")
        sides = F.struct(gap.alias("gap"), words(head).alias("left"), words(tail).alias("right"))
        return F.when((body != "") & ~body.rlike("::.*::|:::"), let(sides, fill))

    inner = F.regexp_replace(squeeze_ends(text), r"^\[(.*)\]$", "$1")
    return let(F.substring_index(inner, "%", 1), read)


def classify_quad(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Class of an IPv4 address. The special-purpose ranges."""
    return (
        F.when(a == 0, "unspecified")
        .when(a == 10, "private")
        .when(a == 127, "loopback")
        .when((a == 100) & b.between(64, 127), "carrier_nat")
        .when((a == 169) & (b == 254) & (c == 169) & (d == 254), "cloud_metadata")
        .when((a == 169) & (b == 254), "link_local")
        .when((a == 172) & b.between(16, 31), "private")
        .when((a == 192) & (b == 168), "private")
        .when((a == 192) & (b == 0) & (c == 0), "reserved")
        .when((a == 192) & (b == 0) & (c == 2), "documentation")
        .when((a == 192) & (b == 88) & (c == 99), "reserved")
        .when((a == 198) & b.isin(18, 19), "benchmark")
        .when((a == 198) & (b == 51) & (c == 100), "documentation")
        .when((a == 203) & (b == 0) & (c == 113), "documentation")
        .when(a.between(224, 239), "multicast")
        .when(a >= 240, "reserved")
        .otherwise("public")
    )


def classify_ipv4(text: Column) -> Column:
    """Class of a dotted quad; NULL when the text is none."""
    return F.when(is_ipv4(text), let(octets(text), lambda q: classify_quad(q[0], q[1], q[2], q[3])))


def classify_words(words: Column) -> Column:
    """Class of an IPv6 address given as eight words; embedded IPv4 decides by itself."""
    w = [words[i] for i in range(8)]

    def zero(start: int, stop: int) -> Column:
        out = w[start] == 0
        for item in w[start + 1 : stop]:
            out = out & (item == 0)
        return out

    def quad(high: Column, low: Column) -> Column:
        return classify_quad(F.shiftright(high, 8), high % 256, F.shiftright(low, 8), low % 256)

    nat64 = (w[0] == 0x64) & (w[1] == 0xFF9B)
    return (
        F.when((w[0] == 0xFD00) & (w[1] == 0x0EC2), "cloud_metadata")
        .when(zero(0, 8), "unspecified")
        .when(zero(0, 7) & (w[7] == 1), "loopback")
        .when(zero(0, 5) & (w[5] == 0xFFFF), quad(w[6], w[7]))
        .when(nat64 & zero(2, 6), quad(w[6], w[7]))
        .when(w[0] == 0x2002, quad(w[1], w[2]))
        .when(nat64, "reserved")
        .when((w[0] == 0x0100) & zero(1, 8), "reserved")
        .when((w[0] == 0x2001) & (w[1] == 0x0C00), "documentation")
        .when(w[0].between(0xFC00, 0xFDFF), "unique_local")
        .when(w[0].between(0xFE80, 0xFEBF), "link_local")
        .when(w[0] >= 0xFF00, "multicast")
        .when(w[0] == 0x3FFE, "reserved")
        .when(zero(0, 4), "reserved")
        .otherwise("public")
    )


def is_noncanonical_ip(host: Column) -> Column:
    """Padded, hex or bare-number spellings of an address."""
    labels = F.split(host, r"\.")
    numeric = F.forall(labels, lambda x: x.rlike(r"^(?:0[xX][0-9a-fA-F]+|\d+)$"))
    odd = F.exists(labels, lambda x: x.rlike(r"^0\d+$") | (F.length(x) > 3) | (_number(x) > 255))
    return (
        F.when(F.size(labels) == 1, host.rlike(r"^\d+$"))
        .when(F.size(labels) > 4, F.lit(False))
        .otherwise(numeric & odd)
    )


def _number(label: Column) -> Column:
    return F.when(
        label.rlike(r"^0[xX]"), F.conv(F.substring(label, 3, 8), 16, 10).try_cast("bigint")
    ).otherwise(label.try_cast("bigint"))


def bare_host(host: Column) -> Column:
    """One bracket off either end."""
    return F.regexp_replace(host, r"^\[|\]$", "")


def inspect_address(host: Column) -> Column:
    """struct(blocked, kind, classification, reason) for a literal host."""
    return let(F.lower(bare_host(squeeze_ends(host))), _inspect)


def _inspect(raw: Column) -> Column:
    v6, odd = raw.contains(":"), is_noncanonical_ip(raw)
    words_class = let(ipv6_words(raw), lambda w: F.when(w.isNull(), "invalid").otherwise(classify_words(w)))
    facts = F.struct(
        F.when(raw == "", "hostname")
        .when(is_ipv4(raw), "ipv4")
        .when(v6, "ipv6")
        .when(odd, "ipv4")
        .otherwise("hostname")
        .alias("kind"),
        F.when(raw == "", "invalid")
        .when(is_ipv4(raw), classify_ipv4(raw))
        .when(v6, words_class)
        .when(odd, "private")
        .otherwise("public")
        .alias("label"),
    )
    return let(facts, lambda f: _verdict(raw, f["kind"], f["label"]))


def _verdict(raw: Column, kind: Column, label: Column) -> Column:
    reason = (
        F.when(raw == "", "empty host")
        .when(kind == "hostname", "hostname requires DNS check")
        .when(label == "invalid", "malformed IPv6 literal")
        .when(
            (kind == "ipv4") & ~is_ipv4(raw),
            "non-canonical IP literal (octal, hex or abbreviated form) is not allowed",
        )
        .when(label == "public", F.concat(F.lit("public "), kind))
        .otherwise(F.concat(label, F.lit(" "), kind, F.lit(" is not allowed")))
    )
    return F.struct(
        (label != "public").alias("blocked"),
        kind.alias("kind"),
        label.alias("classification"),
        reason.alias("reason"),
    )


def endpoint_allowed(
    verdict: Column, host: Column, allow_private: bool = False, allow: Sequence[str] = ()
) -> Column:
    """Policy over an inspected host: the allow list first, metadata never lifted."""
    listed = bare_host(host).isin(*allow) if allow else F.lit(False)
    lifted = (
        verdict["classification"] != "cloud_metadata" if allow_private else F.lit(False)
    )
    return listed | ~verdict["blocked"] | lifted


def is_metadata_host(host: Column) -> Column:
    name = bare_host(F.lower(host))
    return name.isin(*METADATA_HOSTS) | name.endswith(".metadata.google.internal")


def host_in(host: Column, allowed: Sequence[str]) -> Column:
    """Exact match or subdomain of an allowed host."""
    name = F.lower(host)
    out = F.lit(False)
    for item in allowed:
        out = out | (name == item) | name.endswith("." + item)
    return out
