"""Spans of a block of bytes: which of them are the same text, and spans as Arrow strings."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from .texts import ranges, span_hashes


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first span of each distinct text, and the number of its text for every span.

    Spans meet by a 64-bit hash and are then compared byte by byte; should two texts share a hash,
    texts themselves are the keys.
    """
    number, seen = pd.factorize(span_hashes(data, starts, ends))
    first = np.empty(len(seen), np.int64)
    first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    sizes, like = ends - starts, first[number]
    if np.array_equal(sizes, sizes[like]) and np.array_equal(data[ranges(starts, sizes)], data[ranges(starts[like], sizes)]):
        return first, number
    known: dict[bytes, int] = {}
    places = []
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        text = data[a:b].tobytes()
        if text not in known:
            known[text] = len(known)
            places.append(i)
        number[i] = known[text]
    return np.array(places, np.int64), number


def as_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an Arrow column."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[ranges(starts, sizes)]))
