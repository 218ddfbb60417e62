"""Secret redaction of free text, URLs and whole records.

A text is cut into parts, each part is told by a letter, and what the letters say of their neighbours is
found in the string of letters, from left to right: a value may hold key words itself, which are then used
up. Parameters are found with their whole value in one match, accounts by cutting the text in front of
every authority. Each step is linear in the text, and a text without a telling word is not cut at all.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import short_hash
from .text import BLANK, let

REDACTED = "[redacted]"

# What the name of a query parameter holds if its value is secret.
QUERY_WORDS = ["password", "token", "secret", "key", "sig", "auth"]
# Words in front of a credential.
SCHEME_WORDS = ["bearer", "basic", "digest", "token"]
# Keys whose value is secret in free text.
TEXT_KEYS = [
    "password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth", "cookie", "authorization",
]
# Words of a field name whose value is always secret, and names of several words.
NAME_WORDS = [
    "password", "password2", "passwd", "pass", "secret", "token", "authorization", "apikey", "accesskey", "privatekey",
    "clientsecret", "credential", "credentials", "cookie", "session", "auth",
]
NAME_PHRASES = ["api_key", "access_key", "private_key", "client_secret", "set_cookie"]
# The least lengths of a credential and of a value.
LEAST_CREDENTIAL, LEAST_VALUE = 6, 3

# ``?name=value`` or ``&name=value``. A name starts at ``&`` or at the first ``?`` of a run, so each run is read once.
PARAMETER = rf"((?:&|(?:^|(?<=[=#]))[^=&#?]*+\?)(?=[^=&#]*?(?:{'|'.join(QUERY_WORDS)}))[^=&#]*+=)[^&#]*+"
# What a text is cut into to find pairs: blanks, marks that end a value, and the chunks between them. From a blank
# behind a chunk on up to the last word in front of a separator no text is in a pair, so that is one part.
MARKS = "\"',;}&"
_BLANKS = BLANK[1:-1]
FAR = f"(?<=[^:=\"'{_BLANKS}]){BLANK}[^:=]*(?={BLANK}+[^:={_BLANKS}])"
CUT = f"{FAR}|{BLANK}+|[{MARKS}]|[^{_BLANKS}{MARKS}]+"
# What a text of one chunk, without parameters and accounts, has not; other than plain characters count as blanks here.
SEVERAL = r"[\x00-\x20\x7F-\x{10FFFF}" + MARKS + "?]|://"
# The blanks behind a word that announces a credential.
ANNOUNCING = f"(?i)(?<=(?<![A-Za-z0-9_])(?:{'|'.join(SCHEME_WORDS)})){BLANK}+"
LAST_WORD = "([A-Za-z0-9_]*)$"


def _pieces(text: Column, ahead: str, needs: Column, clean: Callable[[Column], Column]) -> Column:
    """The text with every piece but the first cleaned; pieces start where ``ahead`` is ahead."""
    parts = F.split(text, f"(?i)(?={ahead})")
    return F.when(needs, F.array_join(F.transform(parts, clean), "")).otherwise(text)


def _behind(text: Column, start: Column) -> Column:
    """What follows a beginning."""
    return F.substring(text, F.length(start) + 1, F.length(text))


def _authority(piece: Column) -> Column:
    """``://user:password@host...``: the account goes."""

    def clean(authority: Column) -> Column:
        host = F.substring_index(authority, "@", -1)
        account = F.substring(authority, F.lit(1), F.length(authority) - F.length(host) - 1)
        shown = F.concat(F.lit(f"://{REDACTED}@"), host, F.substring(piece, F.length(authority) + 4, F.length(piece)))
        return F.when(authority.contains("@") & account.contains(":"), shown).otherwise(piece)

    authority = F.regexp_extract(F.substring(piece, F.lit(4), F.length(piece)), r"^[^/\s]*", 0)
    return F.when(piece.startswith("://"), let(authority, clean)).otherwise(piece)


def _replaced(text: Column, needs: Column, pattern: str, shown: str) -> Column:
    """The text with every match replaced; the search goes on behind a match, so values are taken whole."""
    return F.when(needs, F.regexp_replace(text, F.lit(f"(?i){pattern}"), F.lit(shown))).otherwise(text)


def _ends_with(text: Column, words: list[str]) -> Column:
    """Whether the word a text ends with is one of a list, whatever its case.

    Only as much of the end is looked at as tells a word of the list from a longer one.
    """
    most = max(map(len, words)) + 1
    end = F.substring(text, F.greatest(F.length(text) - most + 1, F.lit(1)), F.lit(most))
    return F.lower(F.regexp_extract(end, LAST_WORD, 1)).isin(*words)


# Credentials: a text is cut at the blanks behind words that announce one, and every piece told by one letter. What
# matters is whether a piece begins with a credential, with one and nothing else, and whether it ends with such a word.
#   c  is a credential            X  is one that ends with such a word
#   y  begins with one            Y  and ends with such a word
#   z  anything else              Z  ends with such a word
# A piece behind X, Y or Z loses its credential; c and X are then used up and announce nothing.
ANNOUNCED, AS_CREDENTIAL = "([XYZ])([Xc])|([XYZ])(?=[Yy])", "$1$3!$2"


def _lead(piece: Column) -> Column:
    """The characters of a credential that a piece begins with."""
    return F.regexp_extract(piece, "^[A-Za-z0-9._~+/=-]*", 0)


def _without_credentials(text: Column) -> Column:
    def letter(piece: Column) -> Column:
        telling = _ends_with(piece, SCHEME_WORDS)
        whole = F.when(F.length(_lead(piece)) == F.length(piece), F.when(telling, "X").otherwise("c"))
        begun = F.coalesce(whole, F.when(telling, "Y").otherwise("y"))
        return F.when(F.length(_lead(piece)) >= LEAST_CREDENTIAL, begun).otherwise(F.when(telling, "Z").otherwise("z"))

    def joined(pieces: Column) -> Column:
        letters = F.array_join(F.transform(pieces, letter), "")
        told = F.regexp_extract_all(F.regexp_replace(letters, F.lit(ANNOUNCED), F.lit(AS_CREDENTIAL)), F.lit("!?[a-zA-Z]"), F.lit(0))
        # The first piece has no blank in front.
        gaps = F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(ANNOUNCING), F.lit(0)))
        rows = F.arrays_zip(pieces.alias("piece"), told.alias("told"), gaps.alias("gap"))

        def shown(row: Column) -> Column:
            rest = F.substring(row["piece"], F.length(_lead(row["piece"])) + 1, F.length(row["piece"]))
            return F.when(row["told"].startswith("!"), F.concat(F.lit(f" {REDACTED}"), rest)).otherwise(
                F.concat(row["gap"], row["piece"])
            )

        return F.array_join(F.transform(rows, shown), "")

    return let(F.split(text, ANNOUNCING, -1), joined)


# Pairs: a text is cut into chunks, blanks and marks (CUT), and every part told by one letter.
#   b  blanks      d  a double quote      q  a single quote      p  another mark, or text far from any pair
#   e  a separator alone                  l  a chunk too short for a value
#   V  a chunk     K  that ends with a key                       S  that ends with a key and a separator
#   A  a separator with a value behind    C  that ends with a key    B  that ends with a key and a separator
#   f  a separator with too little behind F  that is long enough for a value
# A value is a whole chunk behind ``S`` or ``K e``, blanks between and in equal quotes or none, or what an A, B or
# C holds behind its separator if a key stands in front. What is taken as a value is no key any more.
# ``!`` in front of a letter marks a whole value, behind a letter what follows its separator.
PAIRED = "((?:[SB]|[KC][dq]?b?e)b?(?:d(?=.d)|q(?=.q)|(?![dq])))([ABCFKSV])|([KC][dq]?b?)([ABC])"
AS_VALUE = "$1$3$4!$2"


# Up to the first separator with a key in front; the look back is only taken at separators.
KEY_BEHIND = f"(?is)^.*?[:=](?<=(?<![A-Za-z0-9_])(?:{'|'.join(TEXT_KEYS)})[:=])"


def _key_behind(chunk: Column) -> Column:
    """Length of a chunk up to the first separator with a key in front, 0 without one."""
    return F.length(F.regexp_extract(chunk, KEY_BEHIND, 0))


def _without_values(text: Column) -> Column:
    def letter(part: Column) -> Column:
        def chunk(key: Column) -> Column:
            size, separated = F.length(part), part.rlike("^[:=]")
            inside = (key > 0) & (size - key >= LEAST_VALUE)
            # A pair inside a chunk takes its end along.
            end = F.when(inside, 0).when((key > 0) & (key == size), 2).when(_ends_with(part, TEXT_KEYS), 1).otherwise(0)
            by_end = lambda none, key_, both: F.when(end == 0, none).when(end == 1, key_).otherwise(both)
            return (
                F.when(separated & (size == 1), "e")
                .when(separated & (size > LEAST_VALUE), by_end("A", "C", "B"))
                .when(separated, F.when(size >= LEAST_VALUE, "F").otherwise("f"))
                .when(size < LEAST_VALUE, "l")
                .otherwise(by_end("V", "K", "S"))
            )

        return (
            F.when(part == '"', "d")
            .when(part == "'", "q")
            .when(part.isin(*MARKS), "p")
            .when(part.rlike(f"^{BLANK}"), F.when(part.rlike(f"[^{_BLANKS}]"), "p").otherwise("b"))
            .otherwise(let(_key_behind(part), chunk))
        )

    def shown(part: Column, told: Column) -> Column:
        def inner(key: Column) -> Column:
            cut = (key > 0) & (F.length(part) - key >= LEAST_VALUE)
            return F.when(cut, F.concat(F.substring(part, F.lit(1), key), F.lit(REDACTED))).otherwise(part)

        return (
            F.when(told.startswith("!"), F.lit(REDACTED))
            .when(told.endswith("!"), F.concat(F.substring(part, 1, 1), F.lit(REDACTED)))
            .when(told == "p", part)
            .otherwise(let(_key_behind(part), inner))
        )

    def joined(parts: Column) -> Column:
        letters = F.array_join(F.transform(parts, letter), "")
        told = F.regexp_extract_all(F.regexp_replace(letters, F.lit(PAIRED), F.lit(AS_VALUE)), F.lit("[ABC]!|![a-zA-Z]|[a-zA-Z]"), F.lit(0))
        return F.array_join(F.zip_with(parts, told, shown), "")

    return let(F.regexp_extract_all(text, F.lit(CUT), F.lit(0)), joined)


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def redact_url(text: Column) -> Column:
    """Accounts in URLs, secret query values and bearer tokens."""
    steps: list[Callable[[Column], Column]] = [
        lambda t: _pieces(t, "://", t.contains("://") & t.contains("@"), _authority),
        lambda t: _replaced(
            t, t.contains("=") & (t.contains("?") | t.contains("&")), PARAMETER, f"$1{REDACTED}"
        ),
        lambda t: F.when(let(F.lower(t), lambda low: _any(low, SCHEME_WORDS)), _without_credentials(t)).otherwise(t),
    ]
    for step in steps:
        text = let(text, step)
    return text


def redact_text(text: Column) -> Column:
    """:func:`redact_url` plus ``key: value`` and ``key=value`` pairs."""
    paired = lambda t: t.rlike("[:=]") & let(F.lower(t), lambda low: _any(low, TEXT_KEYS))
    whole = let(redact_url(text), lambda t: F.when(paired(t), _without_values(t)).otherwise(t))
    # A chunk alone has no neighbours to be told of, and only a pair in it to lose.
    alone = F.regexp_replace(text, F.lit(f"({KEY_BEHIND}).{{{LEAST_VALUE},}}$"), F.lit(f"$1{REDACTED}"))
    return F.when(text.rlike(SEVERAL), whole).otherwise(alone)


def redact_secret(value: Column) -> Column:
    """What stands in for a secret: a mark and a fingerprint."""
    return F.when(
        F.length(value) > 0, F.concat(F.lit(REDACTED + " ("), short_hash(value), F.lit(")"))
    ).otherwise(F.when(value.isNotNull(), REDACTED))


def is_secret_name(name: str) -> bool:
    """A field name with a secret word between its dashes and underscores, or a secret phrase."""
    words = re.split("[_-]", name.lower())
    joined = f"_{'_'.join(words)}_"
    return any(w in NAME_WORDS for w in words) or any(f"_{p}_" in joined for p in NAME_PHRASES)


def secret_name(name: Column) -> Column:
    """:func:`is_secret_name` of a column."""
    joined = F.concat(F.lit("_"), F.translate(F.lower(name), "-", "_"), F.lit("_"))
    words = F.arrays_overlap(F.split(joined, "_"), F.array(*[F.lit(w) for w in NAME_WORDS]))
    return words | let(joined, lambda j: _any(j, [f"_{p}_" for p in NAME_PHRASES]))


def redact_value(value: Column, kind: T.DataType, name: str) -> Column:
    """Clean one value by its field name and type; nested values keep their shape and all their parts."""
    if is_secret_name(name):
        if isinstance(kind, T.StringType):
            return redact_secret(value)
        return F.when(value.isNotNull(), F.lit(REDACTED))
    if isinstance(kind, T.StringType):
        return redact_text(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: redact_value(v, kind.elementType, name))
    if isinstance(kind, T.StructType):
        return F.when(
            value.isNotNull(),
            F.struct(*[redact_value(value[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]),
        )
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
        return F.map_from_entries(
            F.transform(
                F.map_entries(value),
                lambda e: F.struct(
                    e["key"],
                    F.when(secret_name(e["key"]), redact_secret(e["value"])).otherwise(redact_text(e["value"])),
                ),
            )
        )
    return value
