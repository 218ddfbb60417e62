"""International host names as ASCII: character mapping and the Punycode encoder, in column functions.

The encoder is a fold over the code points of a label. What a browser maps away before it is mapped here by
rules: case, full-width forms, ideographic dots, invisible characters and letters with a separate accent that
have a form of their own. Compatibility forms beyond the full-width block are encoded as they are.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, lookup

# The parameters of Punycode.
BASE, LEAST, MOST, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
# Dots besides the full stop, and characters that are left out of a name.
DOTS = "。．｡"
LEFT_OUT = "­​⁠﻿" + "".join(map(chr, range(0xFE00, 0xFE10)))
#: The printable characters of ASCII and their full-width forms.
WIDE = "".join(chr(0xFF01 + i) for i in range(94))
NARROW = "".join(chr(0x21 + i) for i in range(94))


@lru_cache
def composed() -> dict[str, str]:
    """Letter and accent -> the one character they make, for all canonical pairs."""
    pairs = {}
    for code in range(0xC0, 0x30000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            pair = "".join(chr(int(p, 16)) for p in parts)
            if unicodedata.normalize("NFC", pair) == chr(code):
                pairs[pair] = chr(code)
    return pairs


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda letter: letter != "")


def compose(text: Column) -> Column:
    """Accents put on the letter in front of them, one after the other, where that is one character."""
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("last"))

    def step(state: Column, letter: Column) -> Column:
        one = lookup(composed(), F.concat(state["last"], letter))
        return let(
            one,
            lambda c: F.struct(
                F.when(c.isNull(), F.concat(state["out"], state["last"])).otherwise(state["out"]).alias("out"),
                F.coalesce(c, letter).alias("last"),
            ),
        )

    return F.aggregate(_letters(text), start, step, lambda s: F.concat(s["out"], s["last"]))


def mapped(host: Column) -> Column:
    """A host name as it is compared: no wide forms, one kind of dot, lower case, nothing invisible."""
    plain = F.translate(F.translate(host, WIDE + DOTS, NARROW + "." * len(DOTS)), LEFT_OUT, "")
    # The last letter of a Greek word has no form of its own in a capital.
    small = F.lower(F.translate(plain, "Σ", "σ"))
    return F.when(small.rlike(r"\p{M}"), compose(small)).otherwise(small)


def _adapt(delta: Column, points: Column, first: Column) -> Column:
    """The next bias."""
    damped = F.floor(F.when(first, F.floor(delta / DAMP)).otherwise(F.floor(delta / 2)))
    whole = damped + F.floor(damped / points)
    start = F.struct(whole.cast("bigint").alias("delta"), F.lit(0).cast("bigint").alias("k"))
    limit = (BASE - LEAST) * MOST // 2

    def step(state: Column, _: Column) -> Column:
        big = state["delta"] > limit
        return F.struct(
            F.when(big, F.floor(state["delta"] / (BASE - LEAST))).otherwise(state["delta"]).cast("bigint").alias("delta"),
            (state["k"] + F.when(big, BASE).otherwise(0)).cast("bigint").alias("k"),
        )

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(6)),
        start,
        step,
        lambda s: (s["k"] + F.floor((BASE - LEAST + 1) * s["delta"] / (s["delta"] + SKEW))).cast("bigint"),
    )


def _number(delta: Column, bias: Column) -> Column:
    """A number as digits of changing weight."""
    start = F.struct(delta.cast("bigint").alias("q"), F.lit("").alias("out"), F.lit(False).alias("done"))
    digit = lambda n: F.substring(F.lit(DIGITS), (n + 1).cast("int"), F.lit(1))

    def step(state: Column, nth: Column) -> Column:
        k = nth * BASE
        t = F.when(k <= bias, LEAST).when(k >= bias + MOST, MOST).otherwise(k - bias).cast("bigint")
        last = state["q"] < t
        rest = state["q"] - t
        return F.struct(
            F.when(state["done"] | last, state["q"]).otherwise(F.floor(rest / (BASE - t))).cast("bigint").alias("q"),
            F.when(state["done"], state["out"])
            .otherwise(F.concat(state["out"], digit(F.when(last, state["q"]).otherwise(t + rest % (BASE - t)))))
            .alias("out"),
            (state["done"] | last).alias("done"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, step, lambda s: s["out"])


def punycode(label: Column) -> Column:
    """A label in Punycode, without the ``xn--`` in front."""
    codes = F.transform(_letters(label), lambda letter: F.ascii(letter).cast("bigint"))

    def encode(points: Column) -> Column:
        plain = F.filter(points, lambda c: c < FIRST_CODE)
        count = F.size(plain).cast("bigint")
        others = F.array_sort(F.array_distinct(F.filter(points, lambda c: c >= FIRST_CODE)))
        head = F.concat_ws("", F.transform(plain, lambda c: F.char(c)))
        start = F.struct(
            F.lit(0).cast("bigint").alias("delta"),
            F.lit(FIRST_BIAS).cast("bigint").alias("bias"),
            count.alias("done"),
            F.lit(FIRST_CODE).cast("bigint").alias("n"),
            F.when(count > 0, F.concat(head, F.lit("-"))).otherwise("").alias("out"),
        )

        def outer(state: Column, m: Column) -> Column:
            begun = F.struct(
                (state["delta"] + (m - state["n"]) * (state["done"] + 1)).cast("bigint").alias("delta"),
                state["bias"].alias("bias"),
                state["done"].alias("done"),
                m.alias("n"),
                state["out"].alias("out"),
            )

            def inner(s: Column, c: Column) -> Column:
                hit = c == m
                return F.struct(
                    F.when(hit, 0).when(c < m, s["delta"] + 1).otherwise(s["delta"]).cast("bigint").alias("delta"),
                    F.when(hit, _adapt(s["delta"], s["done"] + 1, s["done"] == count)).otherwise(s["bias"]).cast("bigint").alias("bias"),
                    (s["done"] + F.when(hit, 1).otherwise(0)).cast("bigint").alias("done"),
                    s["n"].alias("n"),
                    F.when(hit, F.concat(s["out"], _number(s["delta"], s["bias"]))).otherwise(s["out"]).alias("out"),
                )

            return F.aggregate(
                points,
                begun,
                inner,
                lambda s: F.struct(
                    (s["delta"] + 1).cast("bigint").alias("delta"), s["bias"].alias("bias"), s["done"].alias("done"), (m + 1).alias("n"), s["out"].alias("out")
                ),
            )

        return F.aggregate(others, start, outer, lambda s: s["out"])

    return let(codes, encode)


def ascii_host(host: Column) -> Column:
    """A host name with its international labels as ``xn--`` labels; one that is ASCII only gets lower case."""

    def label(text: Column) -> Column:
        return F.when(text.rlike(r"[^\x00-\x7F]"), F.concat(F.lit("xn--"), punycode(text))).otherwise(text)

    named = let(mapped(host), lambda name: F.array_join(F.transform(F.split(name, r"\."), label), "."))
    return F.when(host.rlike(r"[^\x00-\x7F]"), named).otherwise(F.lower(host))
