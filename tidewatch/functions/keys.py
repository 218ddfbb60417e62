"""Identity keys, fingerprints and rendered forms of an endpoint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import utf16_units

# FNV-1a start values and primes. The 64-bit state is kept as two
# 32-bit halves, so no step can overflow a bigint with ANSI arithmetic on.
FNV64_HIGH, FNV64_LOW = 3421674724, 2216829733
FNV64_PRIME_LOW = 435  # the prime is 2**40 + 435
FNV32_START, FNV32_PRIME = 2166136261, 16777619
LOW32 = 0xFFFFFFFF


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda letter: letter != "")


def _code(letter: Column) -> Column:
    return F.ascii(letter).cast("bigint")


def _hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 8, "0")


def dedupe_key(protocol: Column, host: Column, port: Column, username: Column) -> Column:
    """Same protocol, host, port and account is the same endpoint."""
    return F.concat_ws(
        "|", protocol, F.lower(host), port.cast("string"), F.lower(F.coalesce(username, F.lit("")))
    )


def fnv64(text: Column) -> Column:
    """FNV-1a 64 as 16 hex digits."""

    def step(state: Column, letter: Column) -> Column:
        mixed = state["lo"].bitwiseXOR(_code(letter))
        product = mixed * FNV64_PRIME_LOW
        return F.struct(
            (state["hi"] * FNV64_PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(mixed, 8))
            .bitwiseAND(F.lit(LOW32))
            .alias("hi"),
            product.bitwiseAND(F.lit(LOW32)).alias("lo"),
        )

    start = F.struct(
        F.lit(FNV64_HIGH).cast("bigint").alias("hi"), F.lit(FNV64_LOW).cast("bigint").alias("lo")
    )
    return F.aggregate(_letters(text), start, step, lambda s: F.concat(_hex(s["hi"]), _hex(s["lo"])))


def dedupe_hash(protocol: Column, host: Column, port: Column, username: Column) -> Column:
    """The stored unique key: it never contains the account name."""
    return fnv64(dedupe_key(protocol, host, port, username))


def utf16_codes(text: Column) -> Column:
    """The UTF-16 code units of a text; characters beyond the basic plane have two."""

    def units(letter: Column) -> Column:
        pairs = F.hex(F.encode(letter, "UTF-16BE"))
        first = F.conv(F.substring(pairs, 1, 4), 16, 10).cast("bigint")
        second = F.conv(F.substring(pairs, 5, 4), 16, 10).cast("bigint")
        return F.when(F.length(pairs) > 4, F.array(first, second)).otherwise(F.array(first))

    # Almost every letter is one unit, whose number is its code point.
    return F.when(
        text.rlike("[^\\x{0}-\\x{FFFF}]"), F.flatten(F.transform(_letters(text), units))
    ).otherwise(F.transform(_letters(text), _code))


def fnv32(text: Column) -> Column:
    """FNV-1a 32 over UTF-16 code units, as a bigint."""
    return F.aggregate(
        utf16_codes(text),
        F.lit(FNV32_START).cast("bigint"),
        lambda h, c: (h.bitwiseXOR(c) * FNV32_PRIME).bitwiseAND(F.lit(LOW32)),
    )


def fnv32_hex(text: Column) -> Column:
    return _hex(fnv32(text))


def bucket_of(text: Column, buckets: int) -> Column:
    """Stable bucket number; one bucket or fewer is always bucket 0."""
    return fnv32(text) % buckets if buckets > 1 else F.lit(0).cast("bigint")


def short_hash(text: Column) -> Column:
    """Length and fingerprint, enough to correlate a secret without showing it."""
    units = utf16_units(text).cast("bigint").cast("string")
    return F.concat(F.lit("len="), units, F.lit(" fnv="), fnv32_hex(text))


def redacted_url(protocol: Column, host: Column, port: Column, username: Column) -> Column:
    """``protocol://[***:***@]host:port`` with IPv6 hosts in brackets."""
    account = F.when(F.coalesce(username, F.lit("")) != "", "***:***@").otherwise("")
    shown = F.when(F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    return F.concat(protocol, F.lit("://"), account, shown, F.lit(":"), port.cast("string"))


def cycle_id(started_at: Column, salt: Column) -> Column:
    """``cyc_<utc stamp>_<8 hex>``: text order is time order."""
    return F.concat(
        F.lit("cyc_"), F.date_format(started_at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("_"), fnv32_hex(salt)
    )
