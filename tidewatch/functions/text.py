"""Text, number and time helpers shared by the other column functions."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blank at either end of a line.
BLANKS = (
    " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
BLANK = r"[ \t\n\x0B\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def squeeze_ends(text: Column) -> Column:
    """Strip Unicode blanks from both ends."""
    return F.btrim(text, F.lit(BLANKS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named.

    Columns are trees: a value named twenty times is planned twenty times. A one-element
    transform binds it to a name instead and keeps the plan small.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def utf16_units(text: Column) -> Column:
    """Length in UTF-16 code units; code points only differ outside the basic plane."""
    return F.octet_length(F.encode(text, "UTF-16BE")) / F.lit(2)


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Round halves toward plus infinity, as a double."""
    scale = float(10**digits)
    if digits == 0:
        return F.floor(value + 0.5).cast("double")
    return F.floor(value * scale + 0.5) / scale


def clamp(value: Column, low: float, high: float) -> Column:
    """Limit a value to ``low..high``; NULL stays NULL."""
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)


def skip_chars(text: Column, count: Column | int) -> Column:
    """Drop the first ``count`` characters."""
    return F.substring(text, F.lit(1) + count, F.length(text))


def instant(moment: datetime | str) -> datetime:
    """A naive UTC datetime from an ISO text or a datetime."""
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment.replace("Z", "+00:00"))
    if moment.tzinfo is not None:
        moment = (moment - moment.utcoffset()).replace(tzinfo=None)
    return moment


def at(moment: datetime | str, minutes_back: float = 0) -> Column:
    """A constant instant, optionally some minutes earlier, that pushes down to a scan."""
    value = instant(moment) - timedelta(minutes=minutes_back)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def iso_text(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSSZ``, the text form of instants at the edges."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def minutes_since(ts: Column, now: datetime | str | Column) -> Column:
    """Minutes from ``ts`` to ``now`` at millisecond resolution; NULL stays NULL."""
    end = now if isinstance(now, Column) else at(now)
    return F.timestamp_diff("MILLISECOND", ts, end) / 60000.0


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since the epoch for a UTC instant."""
    return F.unix_millis(ts.cast("timestamp"))


def lookup(mapping: dict, key: Column) -> Column:
    """A small constant dictionary; unknown keys give NULL. The key is planned once."""
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def safe_message(text: Column, limit: int = 200) -> Column:
    """One-line text of at most ``limit`` characters, an ellipsis marking a cut."""
    flat = squeeze_ends(F.regexp_replace(F.regexp_replace(text, r"[\r\n\t]+", " "), BLANK + "{2,}", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))
    )
