"""Cheapest repair of conversations whose turns do not alternate or are faulty.

A conversation is a lattice: a column per row (and one behind the last), in each column the states of the
grammar ``(s?(ua)+)?`` over role initials. Keeping, rerolling or deleting a row leads to the next column,
inserting an empty turn stays in its column. The cheapest way through is found from both ends at once: a
forward and a reverse heap take nodes by cost, nodes of one cost in the order of the columns (a kept row
costs nothing), until no cheaper or equal way can be found; of all crossings of least cost the one whose
joined audit is least in ASCII order is taken. An audit determines its way, as every state allows only one
role to insert or reroll to, so equal audits cannot hide different repairs.

Rows are sorted over all conversations by ranges and cut into blocks of consecutive rows, so a conversation
of any length is spread over tasks. A block that is a whole conversation is solved at once. Of any other
block the cheapest way from each state to each state is found, the states at the edges of the blocks are
then chosen from costs and ranks alone (one small row per block), and each block writes down its own part.
Where insertions stand at the edge of blocks they belong to the block behind, so two different audits up to
an edge always differ before either ends.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .texts import bounded_batches

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing yet, behind a system turn, behind a user turn, behind an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = (EMPTY, SYSTEM, USER, ASSISTANT)
NEXT = {EMPTY: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The role that may be inserted or rerolled to, with the state behind it.
TURN = {EMPTY: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
GOALS = (EMPTY, ASSISTANT)
#: Insertions behind the last row that end a conversation.
TAIL = {EMPTY: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
FINE, SHORTENED, FAULTY = 0, 1, 2

#: Rows and characters of a block, and blocks a task sends at once.
BLOCK_ROWS, BLOCK_CHARS, SENT = 512, 1 << 20, 64
#: Rows of a range, and how many it may have where that would make more ranges than the session shuffles into.
RANGE_ROWS, MOST_ROWS = 8192, 1_000_000

BLOCKS = (
    "conv_id long, part int, block int, roles array<string>, texts array<string>, kinds array<int>, copies array<long>, "
    "counts array<long>, edges array<string>, turns array<long>, costs array<long>, orders array<int>"
)
CHOICES = "conv_id long, part int, block int, start int, goal int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
#: goal: the state behind the block, -1 for a whole conversation, which has its cost here.
WRITTEN = "conv_id long, part int, block int, cost long, audit string, repaired string, n_turns long, goal int"
ENDS = "conv_id long, cost long, audit string, n_turns long, repaired_sha256 string"


@dataclass
class Step:
    """A column of the lattice: a row that may stay, or a run of ``copies`` rows that have to go."""

    kind: int
    initial: str = ""
    copies: int = 1


Edge = tuple[int, str, int, int]


def forward_edges(steps: list[Step], column: int, state: int, tail: bool) -> Iterator[Edge]:
    """(cost, label, column, state) of what leaves a node. A run of rows that go has one label."""
    if column < len(steps):
        step = steps[column]
        yield DELETE * step.copies, "D", column + 1, state
        if step.kind != FAULTY:
            extra = TRUNCATED if step.kind == SHORTENED else 0
            kept = NEXT[state].get(step.initial)
            if kept is not None:
                yield extra, "K", column + 1, kept
            yield REROLE + extra, "R", column + 1, TURN[state][1]
    if column < len(steps) or tail:
        yield INSERT, "I", column, TURN[state][1]


def reverse_edges(steps: list[Step], column: int, state: int, tail: bool) -> Iterator[Edge]:
    """(cost, label, column, state) of what leads to a node."""
    for source in STATES:
        if column > 0:
            for cost, label, _, goal in forward_edges(steps, column - 1, source, False):
                if label != "I" and goal == state:
                    yield cost, label, column - 1, source
        if (column < len(steps) or tail) and TURN[source][1] == state:
            yield INSERT, "I", column, source


class Side:
    """One of the two searches: settled nodes with cost and least audit, and a heap of the others."""

    def __init__(self, starts: list[tuple[int, int]], columns: int, ahead: bool):
        self.ahead, self.columns = ahead, columns
        self.best: dict[tuple[int, int], tuple[int, str]] = {node: (0, "") for node in starts}
        self.done: set[tuple[int, int]] = set()
        self.heap = [(0, self.order(node[0]), node) for node in starts]
        heapq.heapify(self.heap)

    def order(self, column: int) -> int:
        return column if self.ahead else self.columns - column

    def least(self) -> int | None:
        """The cost of the next node to settle."""
        while self.heap and self.heap[0][2] in self.done:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def settle(self) -> tuple[int, int]:
        node = heapq.heappop(self.heap)[2]
        self.done.add(node)
        return node

    def offer(self, node: tuple[int, int], cost: int, audit: str) -> None:
        have = self.best.get(node)
        if node not in self.done and (have is None or (cost, audit) < have):
            self.best[node] = (cost, audit)
            if have is None or cost < have[0]:
                heapq.heappush(self.heap, (cost, self.order(node[0]), node))


def search(steps: list[Step], start: int, goals: Iterable[int], tail: bool = True) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest way from a state to one of the goals, None if there is none.

    Without ``tail`` nothing is inserted behind the last row.
    """
    end = len(steps)
    ahead, back = Side([(0, start)], end, True), Side([(end, g) for g in goals], end, False)
    found: tuple[int, str] | None = None
    if not steps and start in goals:
        return 0, ""

    def cross(cost: int, audit: str) -> None:
        nonlocal found
        if found is None or (cost, audit) < found:
            found = (cost, audit)

    while True:
        left, right = ahead.least(), back.least()
        if left is None or right is None or (found is not None and left + right > found[0]):
            # With one side used up, every way has been seen from it.
            return found
        if left <= right:
            node = ahead.settle()
            cost, audit = ahead.best[node]
            for step, label, *goal in forward_edges(steps, *node, tail):
                after = (goal[0], goal[1])
                if after in back.done:
                    rest = back.best[after]
                    cross(cost + step + rest[0], audit + label + rest[1])
                ahead.offer(after, cost + step, audit + label)
        else:
            node = back.settle()
            cost, audit = back.best[node]
            for step, label, *source in reverse_edges(steps, *node, tail):
                before = (source[0], source[1])
                if before in ahead.done:
                    front = ahead.best[before]
                    cross(front[0] + step + cost, front[1] + label + audit)
                back.offer(before, cost + step, label + audit)


def steps_of(roles: list[str], kinds: list[int], copies: list[int]) -> list[Step]:
    """The columns of rows; neighbours that have to go are one."""
    steps: list[Step] = []
    for role, kind, n in zip(roles, kinds, copies):
        if kind == FAULTY and steps and steps[-1].kind == FAULTY:
            steps[-1].copies += n
        else:
            steps.append(Step(kind, role[:1], n))
    return steps


def apply_audit(
    roles: list[str], texts: list[str], kinds: list[int], copies: list[int], start: int, audit: str
) -> tuple[str, list[str]]:
    """The audit with a letter per row that goes, and the turns (``role:text``) that it gives."""
    state, row, letters, turns = start, 0, [], []
    for label in audit:
        if label == "I":
            role, state = TURN[state]
            turns.append(f"{role}:")
        elif label == "D":
            n = copies[row]
            # Neighbours that have to go are one label.
            while kinds[row] == FAULTY and row + 1 < len(kinds) and kinds[row + 1] == FAULTY:
                row += 1
                n += copies[row]
            label *= n
            row += 1
        else:
            if label == "K":
                role, state = roles[row], NEXT[state][roles[row][:1]]
            else:
                role, state = TURN[state]
            turns.append(f"{role}:{texts[row]}")
            row += 1
        letters.append(label)
    return "".join(letters), turns


LEGAL = {"su", "ua", "au"}


@dataclass
class Block:
    """Consecutive rows of one conversation."""

    conv_id: int | None
    part: int
    number: int
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    copies: list[int] = field(default_factory=list)
    #: blank, duplicate, truncated, illegal, distinct turns
    counts: list[int] = field(default_factory=lambda: [0] * 5)
    #: first and last role initial, if there are rows
    edges: list[str] = field(default_factory=list)
    #: least and largest turn, if there are any
    turns: list[int] = field(default_factory=list)
    chars: int = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, again: bool) -> None:
        """``copies`` rows alike; ``again``: a row of an earlier turn has the same role and text."""
        if not copies:
            return
        self.chars += len(role) + len(text)
        bare = text.strip(" \t\n\x0b\x0c\r")
        kind = SHORTENED if bare and bare[-1] not in ".!?" else FINE
        repeats = copies if again else copies - 1
        if not bare:
            self.counts[0] += copies
            self._row(role, "", FAULTY, copies)
        else:
            self.counts[1] += repeats
            if not again:
                self.counts[2] += kind == SHORTENED
                self._row(role, text, kind, 1)
            if repeats:
                self._row(role, "", FAULTY, repeats)
        initial = role[:1]
        self.counts[3] += bool(self.edges and self.edges[1] + initial not in LEGAL) + (copies - 1) * (initial * 2 not in LEGAL)
        self.edges = [self.edges[0] if self.edges else initial, initial]
        if turn is not None:
            self.counts[4] += not self.turns or turn != self.turns[1]
            self.turns = [self.turns[0] if self.turns else turn, turn]

    def _row(self, role: str, text: str, kind: int, copies: int) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.kinds.append(kind)
        self.copies.append(copies)

    def ways(self, whole: bool) -> tuple[list[int], list[int]]:
        """Costs and order of the cheapest way from each state (row) to each state (column).

        The order is that of the audits from one state. A cost of -1: no way. A block that is a whole
        conversation needs no ways; its lists are empty.
        """
        if whole:
            return [], []
        steps = steps_of(self.roles, self.kinds, self.copies)
        costs, orders = [], []
        for start in STATES:
            ways = [search(steps, start, [goal], tail=False) for goal in STATES]
            audits = sorted(w[1] for w in ways if w is not None)
            costs += [-1 if w is None else w[0] for w in ways]
            orders += [-1 if w is None else audits.index(w[1]) for w in ways]
        return costs, orders

    def row(self, whole: bool) -> tuple:
        lists = (self.roles, self.texts, self.kinds, self.copies, self.counts, self.edges, self.turns)
        return (self.conv_id, self.part, self.number, *lists, *self.ways(whole))


def arrow_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()),
        "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
    }
    names, types = zip(*(f.split(" ") for f in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], names=list(names))


def sent(rows: Iterable[tuple], schema: str, most: int = SENT) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most ``most``."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield arrow_batch(held, schema)
            held = []
    if held:
        yield arrow_batch(held, schema)


def or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0 where the row is dropped) of every row, damaged by its key.

    The key is the crc32 of ``conv_id:turn``, a null of which reads as one space, like a null role or text.
    """
    fault = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20
    text = or_space("text")
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, F.lit("user")).otherwise(or_space("role")).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def gathered(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows alike as one with the sum of their copies, and whether an earlier turn has the same role and text.

    A conversation whose rows are all dropped keeps one row of 0 copies. Also how many rows there are.
    """
    there = F.col("copies") > 0
    bare = rows.select(
        "conv_id",
        F.when(there, F.col("turn")).alias("turn"),
        F.when(there, F.col("role")).otherwise("").alias("role"),
        F.when(there, F.col("text")).otherwise("").alias("text"),
        F.col("copies"),
        there.alias("there"),
    )
    alike = bare.groupBy("conv_id", "turn", "role", "text", "there").agg(F.sum("copies").alias("copies"))
    alike = written(alike.withColumn("key", F.sha2(F.concat(F.col("role"), F.lit("\n"), F.sha2("text", 256)), 256)))
    found = alike.filter("there").groupBy("conv_id", "key").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("turn").isNull()).alias("none"), F.min("turn").alias("first"))
    # Only what more than one turn says can be an earlier one's.
    spread = found.filter("n > 1").select(F.col("conv_id").alias("own"), F.col("key").alias("said"), "none", "first")
    joined = alike.join(spread, F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("key") == F.col("said")), "left")
    again = F.col("said").isNotNull() & F.col("there") & F.col("turn").isNotNull() & (F.col("none") | (F.col("turn") > F.col("first")))
    return joined.select("conv_id", "turn", "role", "text", "copies", again.alias("again")), alike.count()


def cut_blocks(rows: DataFrame, number: int, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block of consecutive rows, as a written table.

    Rows go by conversation, turn (nulls first), role and text. Ranges are dealt by prefixes of bounded
    size that keep this order, about ``RANGE_ROWS`` of the ``number`` of rows each: the rows of one long
    conversation are far more work than their bytes tell, so ranges are not joined by size.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(-(-number // RANGE_ROWS), max(width, -(-number // MOST_ROWS))))
    long_role = F.char_length("role") > 32
    near = [F.substring("role", 1, 32), long_role, F.when(long_role, F.lit("")).otherwise(F.substring("text", 1, 128))]
    ordered = rows.repartitionByRange(parts, "conv_id", "turn", *near).sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def cut() -> Iterator[tuple]:
            block, first = None, True
            for batch in batches:
                columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "again"))
                for conv, turn, role, text, copies, again in zip(*columns):
                    same = block is not None and conv == block.conv_id
                    if block is None or not same or len(block.roles) >= block_rows or block.chars > block_chars:
                        if block is not None:
                            # The first conversation of a task may have begun in the one before.
                            yield block.row(whole=not first and not same)
                            first = first and same
                        block = Block(conv, part, block.number + 1 if same else 0)
                        if same:
                            first = True
                    block.add(turn, role, text, copies, again)
            if block is not None:
                yield block.row(whole=False)

        yield from sent(cut(), BLOCKS)

    return written(ordered.select("conv_id", "turn", "role", "text", "copies", "again").mapInArrow(run, BLOCKS))


class Chain:
    """The blocks of one conversation in order: costs and ranks of the cheapest ways to the states."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.keys: list[tuple[int, int]] = []
        self.from_states = bytearray()
        #: state: (cost, rank among the audits so far)
        self.ways = {EMPTY: (0, 0)}
        self.totals = [0] * 5
        self.initial: str | None = None
        self.turns: list[int] = []
        self.whole = False

    def add(self, part: int, number: int, counts: list[int], edges: list[str], turns: list[int], costs: list[int], orders: list[int]) -> None:
        self.keys.append((part, number))
        self.totals = [a + b for a, b in zip(self.totals, counts)]
        if edges:
            self.totals[3] += self.initial is not None and self.initial + edges[0] not in LEGAL
            self.initial = edges[1]
        if turns:
            self.totals[4] -= bool(self.turns) and self.turns[1] == turns[0]
            self.turns = [self.turns[0] if self.turns else turns[0], turns[1]]
        if not costs:
            self.whole = True
            return
        reached = {}
        for goal in STATES:
            ways = []
            for start, (cost, rank) in self.ways.items():
                at = 4 * start + goal
                if costs[at] >= 0:
                    ways.append((cost + costs[at], rank, orders[at], start))
            if ways:
                reached[goal] = min(ways)
        # Audits up to an edge differ before either ends, so the earlier rank decides and then the own order.
        places = sorted({(rank, order) for _, rank, order, _ in reached.values()})
        self.ways = {goal: (cost, places.index((rank, order))) for goal, (cost, rank, order, _) in reached.items()}
        self.from_states += bytes(reached[g][3] if g in reached else 9 for g in STATES)

    def rows(self) -> Iterator[tuple]:
        """A row per block: the states at its edges. Figures of the conversation are in the row of the first."""
        blank, duplicate, truncated, illegal, distinct = self.totals
        gaps = self.turns[1] - self.turns[0] + 1 - distinct if self.turns else 0
        goals: list[int] = []
        total = -1
        if not self.whole:
            total, _, state = min((cost + INSERT * len(TAIL[g]), rank, g) for g, (cost, rank) in self.ways.items())
            for i in range(len(self.keys) - 1, -1, -1):
                goals.append(state)
                state = self.from_states[4 * i + state]
            goals.reverse()
        for i, (part, number) in enumerate(self.keys):
            start = (goals[i - 1] if i else EMPTY) if goals else EMPTY
            figures = (gaps, blank, duplicate, truncated, illegal, total) if i == 0 else (None,) * 6
            yield (self.conv_id, part, number, start, goals[i] if goals else -1, *figures)


def choose(blocks: DataFrame) -> DataFrame:
    """The states at the edges of every block, and the figures of every conversation in its first row.

    A block gives a row of some forty numbers, and a conversation's pass through one task as a stream.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("conv_id", "part", "block", "counts", "edges", "turns", "costs", "orders")

        def chosen() -> Iterator[tuple]:
            chain = None
            for batch in batches:
                for conv, *rest in zip(*(batch.column(c).to_pylist() for c in names)):
                    if chain is None or conv != chain.conv_id:
                        if chain is not None:
                            yield from chain.rows()
                        chain = Chain(conv)
                    chain.add(*rest)
            if chain is not None:
                yield from chain.rows()

        yield from sent(chosen(), CHOICES, 10_000)

    small = blocks.select("conv_id", "part", "block", "counts", "edges", "turns", "costs", "orders")
    return small.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(run, CHOICES)


def write_parts(blocks: DataFrame, choices: DataFrame) -> DataFrame:
    """The audit and the turns of every block, with the cost in the row of a whole conversation."""
    own = [F.col(c).alias(f"own_{c}") for c in ("conv_id", "part", "block")]
    edges = choices.select(*own, "start", "goal")
    met = blocks.join(
        edges,
        F.col("conv_id").eqNullSafe(F.col("own_conv_id")) & (F.col("part") == F.col("own_part")) & (F.col("block") == F.col("own_block")),
    )
    names = ("conv_id", "part", "block", "roles", "texts", "kinds", "copies", "start", "goal")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> Iterator[tuple]:
            for batch in batches:
                for conv, part, number, roles, texts, kinds, copies, start, goal in zip(*(batch.column(c).to_pylist() for c in names)):
                    steps = steps_of(roles, kinds, copies)
                    whole = goal < 0
                    way = search(steps, start, GOALS) if whole else search(steps, start, [goal], tail=False)
                    audit, turns = apply_audit(roles, texts, kinds, copies, start, way[1])
                    yield conv, part, number, way[0] if whole else None, audit, "\n".join(turns), len(turns), goal

        yield from sent(done(), WRITTEN)

    return met.select(*names).mapInArrow(run, WRITTEN)


def joined(parts: DataFrame) -> DataFrame:
    """cost (of whole conversations), audit, n_turns and repaired_sha256 of every conversation.

    A hash needs its text in order, so the parts of a conversation pass through one task, one at a time.
    """
    names = ("conv_id", "cost", "audit", "repaired", "n_turns", "goal")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole() -> Iterator[tuple]:
            key, state = None, None

            def end() -> tuple:
                for letter in TAIL.get(state[4], ""):
                    role, state[4] = TURN[state[4]]
                    state[1].append(letter)
                    state[3].update(f"{chr(10) if state[2] else ''}{role}:".encode())
                    state[2] += 1
                return key, state[0], "".join(state[1]), state[2], state[3].hexdigest()

            for batch in batches:
                for conv, cost, audit, repaired, n, goal in zip(*(batch.column(c).to_pylist() for c in names)):
                    if state is None or conv != key:
                        if state is not None:
                            yield end()
                        key, state = conv, [cost, [], 0, hashlib.sha256(), EMPTY]
                    state[1].append(audit)
                    if n:
                        state[3].update(f"{chr(10) if state[2] else ''}{repaired}".encode())
                        state[2] += n
                    state[4] = goal
            if state is not None:
                yield end()

        yield from sent(whole(), ENDS, 1000)

    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    return ordered.select(*names).mapInArrow(run, ENDS)


def repair_rows(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame]:
    """(parts, digests) of rows of conv_id, turn, role, text and copies.

    ``parts`` has the audit and the repaired turns of every block in order, ``digests`` one row per
    conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, n_turns, repaired_sha256.
    """
    bounded_batches(rows.sparkSession)
    blocks = cut_blocks(*gathered(rows), block_rows, block_chars)
    choices = written(choose(blocks))
    parts = written(write_parts(blocks, choices))
    figures = choices.filter("gaps is not null").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("cost").alias("chained"))
    ends = joined(parts).withColumnRenamed("conv_id", "own")
    digests = figures.join(ends, F.col("conv_id").eqNullSafe(F.col("own"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.coalesce("cost", "chained").alias("cost"), "audit", "n_turns", "repaired_sha256"
    )
    return parts, digests


def repair_conversations(conversations: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Damage conversations and repair them: one row per conv_id of the input, with counts, cost and audit.

    Rows go by turn (nulls first), rows of one turn by role and text. A null role or text is one space, a
    null conv_id a conversation of its own. Of rows that repeat the first may stay. A conversation that
    lost all its rows has zeros, an empty audit and the hash of an empty text; no rows give no rows. Other
    columns are not read.
    """
    return repair_rows(damage(conversations), block_rows, block_chars)[1]
