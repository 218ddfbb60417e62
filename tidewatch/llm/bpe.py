"""Byte-level BPE: whole texts to token ids and back.

A text is split by a pattern and every piece is merged by itself. The tree of a piece has one leaf per
byte position; a leaf holds the rank of the pair that starts there, joined with its position, so the
root is the leftmost pair of least rank. A merge sets three leaves (the pair itself, its left neighbour
and the dead right half) and the path above each. Pieces of one size stand side by side in one array and
take their merges in step; a few long pieces go one at a time over the same tree.

A worker keeps the ids of the pieces it has seen, up to ``KNOWN`` of them, so a piece is merged once.
Spark deals out the texts; nothing is shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import blocks, ranges

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Pieces a worker keeps, and the bytes they may have in all.
KNOWN, KNOWN_BYTES = 300_000, 16 << 20
#: Characters of a text that are split at once, positions of trees that are merged at once, and bytes of ids sent at once.
SLICE, POSITIONS, OUT_BYTES = 1 << 20, 1 << 20, 8 << 20
#: Beyond this size a group of fewer than ``FEW`` pieces is merged one piece at a time.
SHORT, FEW = 64, 16
NEVER = np.iinfo(np.int64).max

ENCODED = "doc_id long, n_tokens long, ids binary"
DECODED = "doc_id long, n_tokens long, ids binary, bytes binary"


class Vocabulary:
    """Tokens by id, and the id that every pair of tokens merges to."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.single < 0).any():
            raise ValueError(f"{path} lacks single bytes")
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, NEVER)
        self.merged = np.array([pairs[k] for k in keys.tolist()] + [0], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NEVER`` where it does not merge."""
        wanted = left << 32 | right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.merged[at], NEVER)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.data[ranges(self.starts[ids], self.sizes[ids])].tobytes()


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def leaf(ranks: np.ndarray, size: int, position: np.ndarray) -> np.ndarray:
    """A rank joined with its position: the least one is the leftmost of least rank."""
    return np.where(ranks == NEVER, NEVER, np.where(ranks == NEVER, 0, ranks) * size + position)


def merge_together(pieces: list[bytes], size: int, vocab: Vocabulary) -> list[np.ndarray]:
    """The ids of pieces of at most ``size`` bytes (a power of two), one merge of each per round."""
    n, wide = len(pieces), size + 1
    lengths = np.array([len(p) for p in pieces], np.int64)
    place = np.arange(wide)
    used = place < lengths[:, None]
    token = np.zeros((n, wide), np.int64)
    token[used] = vocab.single[np.frombuffer(b"".join(pieces), np.uint8)]
    alive = used.ravel()
    following = np.tile(place + 1, n)
    before = np.tile(place - 1, n)
    first = np.where(
        used[:, 1:], leaf(vocab.pair_ranks(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, size), size, place[:-1]), NEVER
    )
    tree = np.full((n, 2 * size), NEVER, np.int64)
    tree[:, size:] = first
    level = size // 2
    while level:
        np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
        level //= 2
    tree, token = tree.ravel(), token.ravel()
    live = np.arange(n)
    while True:
        best = tree[live * 2 * size + 1]
        go = best != NEVER
        live, best = live[go], best[go]
        if not len(live):
            break
        row, root = live * wide, live * 2 * size
        left = best % size
        right = following[row + left]
        behind = following[row + right]
        ahead = before[row + left]
        token[row + left] = best // size
        alive[row + right] = False
        following[row + left] = behind
        before[row + behind] = left
        tree[root + size + right] = NEVER
        inside = behind < lengths[live]
        ranks = np.where(inside, vocab.pair_ranks(token[row + left], token[row + np.where(inside, behind, 0)]), NEVER)
        tree[root + size + left] = leaf(ranks, size, left)
        led = ahead >= 0
        ahead = np.where(led, ahead, right)
        ranks = np.where(led, vocab.pair_ranks(token[row + ahead], token[row + left]), NEVER)
        tree[root + size + ahead] = leaf(ranks, size, ahead)
        node = np.concatenate([left, right, ahead]) + size
        own = np.concatenate([root, root, root])
        span = size
        while span > 1:
            node >>= 1
            at = own + 2 * node
            tree[own + node] = np.minimum(tree[at], tree[at + 1])
            span >>= 1
    counts = alive.reshape(n, wide).sum(axis=1)
    return np.split(token[alive], np.cumsum(counts)[:-1])


def merge_alone(piece: bytes, vocab: Vocabulary) -> np.ndarray:
    """The ids of one piece over the same tree, for pieces too long to have many beside them."""
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    ids = vocab.single[np.frombuffer(piece, np.uint8)]
    whole = np.full(2 * size, NEVER, np.int64)
    whole[size : size + n - 1] = leaf(vocab.pair_ranks(ids[:-1], ids[1:]), size, np.arange(n - 1))
    level = size // 2
    while level:
        whole[level : 2 * level] = np.minimum(whole[2 * level : 4 * level : 2], whole[2 * level + 1 : 4 * level : 2])
        level //= 2
    never, pairs = int(NEVER), vocab.pairs
    tree, token = whole.tolist(), ids.tolist()
    following, before = list(range(1, n + 1)), list(range(-1, n))
    while tree[1] != never:
        rank, left = divmod(tree[1], size)
        right = following[left]
        behind, ahead = following[right], before[left]
        token[left], token[right] = rank, -1
        following[left] = behind
        before[behind] = left
        found = pairs.get(rank << 32 | token[behind]) if behind < n else None
        changes = [(right, never), (left, never if found is None else found * size + left)]
        if ahead >= 0:
            found = pairs.get(token[ahead] << 32 | rank)
            changes.append((ahead, never if found is None else found * size + ahead))
        for place, value in changes:
            node = place + size
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least
    return np.array([t for t in token if t >= 0], np.int64)


def merge_pieces(pieces: list[bytes], vocab: Vocabulary) -> list[np.ndarray]:
    """The ids of every piece, in the order given. A piece that is a token is that token."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
    sizes: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        rank = vocab.ranks.get(piece)
        if rank is not None:
            out[i] = np.array([rank], np.int64)
        elif piece:
            sizes.setdefault(1 << max(1, (len(piece) - 1).bit_length()), []).append(i)
    for size, members in sizes.items():
        if size > SHORT and len(members) < FEW:
            for i in members:
                out[i] = merge_alone(pieces[i], vocab)
            continue
        step = max(1, POSITIONS // size)
        for start in range(0, len(members), step):
            part = members[start : start + step]
            for i, ids in zip(part, merge_together([pieces[i] for i in part], size, vocab)):
                out[i] = ids
    return out


class Encoder:
    """Splits texts and remembers the ids of pieces."""

    def __init__(self, path: str = RANKS, pattern: str = PATTERN):
        import regex

        self.vocab = vocabulary(path)
        self.split = regex.compile(pattern)
        #: No match of the pattern reaches from a character that is no white space to one that is.
        self.seam = regex.compile(r"(?<=\S)\s")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes = 0
        self.pool = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    def learn(self, pieces: set[str]) -> None:
        """Merge the pieces that are not known yet."""
        new = [p for p in pieces if p not in self.known]
        if not new:
            return
        data = [p.encode() for p in new]
        size = sum(map(len, data))
        if self.known and (len(self.known) + len(new) > KNOWN or self.bytes + size > KNOWN_BYTES):
            self.forget()
            new = list(pieces)
            data = [p.encode() for p in new]
            size = sum(map(len, data))
        merged = merge_pieces(data, self.vocab)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.bytes += size
        sizes = np.array([len(m) for m in merged], np.int64)
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, *merged]).astype(np.uint32)

    def slices(self, text: str) -> Iterator[str]:
        """A long text cut where no piece crosses."""
        at = 0
        while len(text) - at > SLICE:
            seam = self.seam.search(text, at + SLICE)
            if seam is None:
                break
            yield text[at : seam.start()]
            at = seam.start()
        yield text[at:]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        out, held, size = [], [], 0

        def flush() -> Iterator[np.ndarray]:
            self.learn(set().union(*held))
            for pieces in held:
                rows = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
                yield self.pool[ranges(self.starts[rows], self.sizes[rows])]

        owners: list[int] = []
        found: list[list[np.ndarray]] = [[] for _ in texts]
        for i, text in enumerate(texts):
            for part in self.slices(text):
                held.append(self.split.findall(part))
                owners.append(i)
                size += len(part)
                if size > SLICE:
                    for owner, ids in zip(owners, flush()):
                        found[owner].append(ids)
                    held, owners, size = [], [], 0
        if held:
            for owner, ids in zip(owners, flush()):
                found[owner].append(ids)
        for parts in found:
            out.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
        return out


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per worker, as its pieces outlive a task."""
    return Encoder(path, pattern)


def encode_documents(docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every row.

    A null or empty text has no ids; a null doc_id stays null; rows that repeat are encoded as often as
    they are there. Bytes that are no UTF-8 read as the replacement character. Strings of special tokens
    are ordinary text. Other columns are not read. ``pattern`` must be one whose matches cover the text
    and none of whose matches goes on from a non-space to white space.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks, pattern)
        for rows, texts in blocks(batches):
            ids = own.encode([t.decode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()),
                ],
                names=["doc_id", "n_tokens", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, ENCODED
    )


def decode_documents(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """The rows of :func:`encode_documents` with ``bytes``, what the ids stand for. Null ids read as none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks)
        for rows, ids in blocks(batches, OUT_BYTES, "ids"):
            texts = [vocab.decode(np.frombuffer(i, "<u4").astype(np.int64)) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("n_tokens"), rows.column("ids"), pa.array(texts, pa.binary())],
                names=["doc_id", "n_tokens", "ids", "bytes"],
            )

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, DECODED)
