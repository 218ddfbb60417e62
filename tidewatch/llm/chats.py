"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as marked turns, encoded once with offsets, and the spans of the turns that
count for the loss are intersected with the spans of the tokens by binary search. The marks are tokens
of their own, so no token lies across the edge of a turn, and encoding a run of turns gives the very
ids the whole conversation would have there. A long conversation is therefore worked on in blocks of
turns by many tasks, each in bounded memory; only its digests pass through one task, as a stream.

Control strings inside texts are escaped: ``<`` followed by backslashes (or none) and ``|`` gets one
backslash more, so no text holds ``<|``, and reading takes one away again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Turn numbers of a block; rows and characters that a task renders at once.
BLOCK_TURNS, PART_TURNS, PART_CHARS = 64, 256, 1 << 20
LOSS_ROLES = ("assistant",)

FORMATTED = "conv_id long, block long, part int, text string, ids array<int>, mask array<boolean>"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


class Chat:
    """The template with its tokenizer."""

    def __init__(self, path: str = TOKENIZER, loss_roles: tuple[str, ...] = LOSS_ROLES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.add_special_tokens([START, SEPARATOR, END])
        self.start, self.separator, self.end = (self.tokenizer.token_to_id(x) for x in (START, SEPARATOR, END))
        self.loss_roles = loss_roles

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The turns as marked text, and the spans of the texts that count for the loss."""
        parts, spans, at = [], [], 0
        for role, text in turns:
            head, body = f"{START}{escape(role)}{SEPARATOR}", escape(text)
            if role in self.loss_roles:
                spans.append((at + len(head), at + len(head) + len(body)))
            parts.append(f"{head}{body}{END}\n")
            at += len(parts[-1])
        return "".join(parts), spans

    def encode(self, text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a rendered text and whether each token lies in a span."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        offsets = np.array(found.offsets, np.int64).reshape(-1, 2)
        edges = np.array(spans, np.int64).reshape(-1, 2)
        first = np.searchsorted(offsets[:, 0], edges[:, 0], side="left")
        behind = np.maximum(np.searchsorted(offsets[:, 1], edges[:, 1], side="right"), first)
        step = np.zeros(len(offsets) + 1, np.int64)
        np.add.at(step, first, 1)
        np.add.at(step, behind, -1)
        return np.array(found.ids, np.int32), np.cumsum(step[:-1]) > 0

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[list[tuple[str, str]], list[str]]:
        """The turns, and the texts under the mask, from ids and mask alone."""
        marks = np.flatnonzero(np.isin(ids, [self.start, self.separator, self.end]))
        pieces, own = [], ids.tolist()
        kinds = ids[marks].tolist()
        for kind, a, b in zip(kinds, marks.tolist(), [*marks[1:].tolist(), len(own)]):
            if kind != self.end:
                pieces.append(own[a + 1 : b])
        runs = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
        texts = self.tokenizer.decode_batch([*pieces, *[own[a:b] for a, b in runs]], skip_special_tokens=False)
        texts = [unescape(t) for t in texts]
        turns = texts[: len(pieces)]
        return list(zip(turns[0::2], turns[1::2])), texts[len(pieces) :]


def format_chats(
    conversations: DataFrame, tokenizer: str = TOKENIZER, loss_roles: tuple[str, ...] = LOSS_ROLES
) -> DataFrame:
    """conv_id, block, part, text, ids and mask: a conversation is its parts in order.

    Rows go by turn, rows of one turn by role and text; nulls come first and a null role or text is
    empty. A null conv_id is a conversation of its own. The mask is true for tokens of texts whose role
    counts for the loss. Other columns are not read.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS).cast("long"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat, out = Chat(tokenizer, loss_roles), []
        key, part, turns, size, held = None, 0, [], 0, 0

        def close() -> None:
            nonlocal part, turns, size, held
            if turns:
                text, spans = chat.render(turns)
                out.append((*key, part, text, *chat.encode(text, spans)))
                held += len(text)
                part, turns, size = part + 1, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            conv, block, number, text, ids, mask = zip(*out)
            out.clear()
            held = 0
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(conv, pa.int64()),
                    pa.array(block, pa.int64()),
                    pa.array(number, pa.int32()),
                    pa.array(text, pa.string()),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array(mask, pa.list_(pa.bool_())),
                ],
                names=["conv_id", "block", "part", "text", "ids", "mask"],
            )

        for batch in batches:
            for conv, block, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "role", "text"))):
                if (conv, block) != key:
                    close()
                    key, part = (conv, block), 0
                turns.append((role, text))
                size += len(text)
                if len(turns) >= PART_TURNS or size > PART_CHARS:
                    close()
                if held > 4 * PART_CHARS:
                    yield flush()
        close()
        if out:
            yield flush()

    ordered = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    return ordered.select("conv_id", "block", "role", "text").mapInArrow(run, FORMATTED)


def digests(formatted: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per conversation what its ids and mask say when read back.

    Returns conv_id, n_turns, turns_sha256 (role, line feed, text, line feed per turn), loss_chars and
    loss_sha256 (the texts under the mask, one behind the other), and formatted_chars. A hash needs its
    text in order, so the parts of a conversation pass through one task, one part at a time.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat, out = Chat(tokenizer), []
        key, state = None, None
        names = [c.split(" ")[0] for c in DIGESTS.split(", ")]

        def done() -> None:
            if state is not None:
                out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out.clear()
            return batch

        for batch in batches:
            for i, conv in enumerate(batch.column("conv_id").to_pylist()):
                if state is None or conv != key:
                    done()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns, loss = chat.read(
                    batch.column("ids")[i].values.to_numpy(),
                    batch.column("mask")[i].values.to_numpy(zero_copy_only=False),
                )
                state[0] += len(turns)
                for role, text in turns:
                    state[1].update(f"{role}\n{text}\n".encode())
                for text in loss:
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += batch.column("chars")[i].as_py()
            if len(out) > 10_000:
                yield flush()
        done()
        if out:
            yield flush()

    ordered = (
        formatted.select("conv_id", "block", "part", "ids", "mask", F.char_length("text").cast("long").alias("chars"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "block", "part")
    )
    return ordered.mapInArrow(run, DIGESTS)
