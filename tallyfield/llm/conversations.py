"""Repair of conversations: the cheapest edits that make the turns of each alternate properly.

The turns of a conversation span a lattice: a node is a number of turns read and what was written
last (nothing, a system turn, a user turn, an assistant turn), an arc is an edit with a whole cost. An
auction finds the cheapest way to the end: a path grows along the arc that is cheapest by the price of
its head, and where a node's price is too low it rises and the path shrinks by one node. Once the
path reaches the end, the prices of its nodes are their exact costs. Arcs whose cost is the
difference of two exact prices are tight, and the tight path whose letters come first is the repair.

A row is kept (K), given the role user or assistant (R), deleted (D, always if blank or a copy of an
earlier one), or preceded by an empty user or assistant turn (I).

Long conversations are cut into blocks of ``BLOCK_ROWS`` turns. Rows are dealt by range of
(conversation, turn), so that one conversation may lie in many tasks; auctions run block by block
and give the cost from each entry to each exit. Streams of one small row per block carry the costs to the
end backwards and the chosen entries forwards; no task holds the blocks of a conversation at once.

Defined cases: a null role or text is one space; null turns come first; rows of one turn are ordered
by role, then by a hash of the text; a null conversation id is a conversation; a role that is
empty or begins with none of s, u and a cannot be kept; repeated rows are copies; other columns are not
read. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyfield.llm.text import BLANKS
from tallyfield.session import written

# Costs of the edits, and the ends of a whole turn.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
ENDS = ".!?"

BLOCK_ROWS, BLOCK_BYTES = 32, 1 << 20
#: What was written last. The role of a row is coded alike, 0 for any other.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
ROLE = ("", "system", "user", "assistant")
CODE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: The turn that may be inserted, the states a turn may follow, and the turns still owed at the end.
INSERTED = (USER, USER, ASSISTANT, USER)
FOLLOWS = {SYSTEM: (NOTHING,), USER: (NOTHING, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
OWED = (0, 2, 1, 0)
#: From where an exit can be reached at all.
REACH = ((NOTHING,), (NOTHING, SYSTEM), range(4), range(4))
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
BLANK, CUT, COPY = 4, 8, 16
FAR = 1 << 40


def lattice(marks: bytes) -> list[list[tuple[str, int, int]]]:
    """The arcs (letter, cost, node) of each node in the order of their letters; 4 nodes a row."""
    arcs = []
    for i, mark in enumerate(marks):
        bound = mark & (BLANK | COPY)
        extra = TRUNCATED if mark & CUT and not bound else 0
        below = STATES * (i + 1)
        for state in range(STATES):
            out = [("D", DELETE, below + state), ("I", INSERT, STATES * i + INSERTED[state])]
            if not bound:
                if state in FOLLOWS.get(mark & 3, ()):
                    out.append(("K", extra, below + (mark & 3)))
                out.append(("R", REROLE + extra, below + INSERTED[state]))
            arcs.append(out)
    return arcs


def auction(arcs: list, price: list[int], origin: int, end: int, limit: int) -> int:
    """Raise prices until a path of tight arcs leads from ``origin`` to ``end``; its cost.

    Prices never exceed the cheapest cost to the end by the arcs, and go to ``FAR`` where they pass
    ``limit``, beyond which no end is reached.
    """
    path = [origin]
    while path[-1] != end:
        node = path[-1]
        best, head = FAR, -1
        for _, cost, to in arcs[node]:
            if cost + price[to] < best:
                best, head = cost + price[to], to
        if best > limit:
            best = FAR
        if price[node] < best:
            price[node] = best
            if len(path) > 1:
                path.pop()
        elif best == FAR:
            return FAR
        else:
            path.append(head)
    return price[origin]


def _ended(marks: bytes, costs: tuple[int, ...]) -> tuple[list, list[int], int, int]:
    """Arcs with an end after the last row, at which each state has its cost, and prices to begin with."""
    n = len(marks)
    end = STATES * (n + 1)
    arcs = lattice(marks) + [[("", costs[s], end)] for s in range(STATES)]
    open_from = {s for q in range(STATES) if costs[q] < FAR for s in REACH[q]}
    price = [0 if s in open_from else FAR for _ in range(n) for s in range(STATES)]
    return arcs, price + list(costs) + [0], end, max([c for c in costs if c < FAR], default=0) + 5 * n + 8


@functools.lru_cache(1 << 14)
def passage(marks: bytes) -> tuple[tuple[int, ...], ...]:
    """The cheapest cost through a block from each entry (rows) to each exit."""
    columns = []
    for leave in range(STATES):
        arcs, price, end, limit = _ended(marks, tuple(0 if s == leave else FAR for s in range(STATES)))
        columns.append([auction(arcs, price, s, end, limit) if price[s] < FAR else FAR for s in range(STATES)])
    return tuple(zip(*columns, strict=True))


@functools.lru_cache(1 << 14)
def traced(marks: bytes, costs: tuple[int, ...], entry: int) -> tuple[int, str]:
    """The exit and the letters of the first of the cheapest paths from ``entry``.

    A head's price is made exact by an auction from it before its arc is judged tight.
    """
    arcs, price, end, limit = _ended(marks, costs)
    node, letters = entry, []
    if auction(arcs, price, node, end, limit) >= FAR:
        return entry, ""
    while node < STATES * len(marks):
        for letter, cost, to in arcs[node]:
            if cost + price[to] > price[node]:
                continue
            if price[node] == cost + auction(arcs, price, to, end, limit):
                letters.append(letter)
                node = to
                break
    return node % STATES, "".join(letters)


def edits(letters: str, entry: int, roles: list[str], texts: list[str]):
    """(letter, row or None, role, text) of each edit; role and text are null where the row goes."""
    state, row = entry, 0
    for letter in letters:
        if letter == "I":
            state = INSERTED[state]
            yield letter, None, ROLE[state], ""
            continue
        if letter == "D":
            yield letter, row, None, None
        else:
            state = INSERTED[state] if letter == "R" else CODE[roles[row][0]]
            yield letter, row, ROLE[state] if letter == "R" else roles[row], texts[row]
        row += 1


def damage_turns(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by a hash of conversation and turn, to have something to repair."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("_fault")).where(
        F.col("_fault") != 0
    ).select(
        "conv_id",
        "turn",
        F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_fault") == 1, "")
        .when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


_BLOCKS = (
    "conv_id long, block long, marks binary, turns array<long>, roles array<string>, texts array<string>, digests array<binary>"
)


def blocks_of(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The turns in order, in blocks of one conversation whose numbers rise along it."""
    known = rows.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(role, F.lit(" ")).alias("role"),
        F.coalesce(text, F.lit(" ")).alias("text"),
    )
    # Equal rows may be dealt to any side of a bound, so that very many of them spread.
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.xxhash64("text"), F.asc("_row")]
    dealt = known.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order)

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        conv, held, size = None, [], 0

        def block():
            marks, digests = bytearray(), []
            for _, r, t in held:
                end = t.rstrip(BLANKS)[-1:]
                marks.append(CODE.get(r[:1], 0) | (BLANK if not end else 0 if end in ENDS else CUT))
                digests.append(hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest() if end else None)
            turns, roles, texts = zip(*held, strict=True)
            return [conv], [number], [bytes(marks)], [turns], [roles], [texts], [digests]

        def out(made):
            types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.binary()))
            columns = [pa.array([v for m in made for v in m[i]], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays(columns, names=[p.split()[0] for p in _BLOCKS.split(", ")])

        made, bulk = [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")]
            for c, *row in zip(*columns, strict=True):
                if held and (c != conv or len(held) >= BLOCK_ROWS or size >= BLOCK_BYTES):
                    made.append(block())
                    bulk += size
                    held, size, number = [], 0, number + 1
                    if bulk >= BLOCK_BYTES or len(made) >= 2000:
                        yield out(made)
                        made, bulk = [], 0
                conv = c
                held.append(row)
                size += len(row[2])
        if held:
            made.append(block())
        if made:
            yield out(made)

    return dealt.sortWithinPartitions(*order).select("conv_id", "turn", "role", "text").mapInArrow(run, _BLOCKS)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(schema))


def _streamed(df: DataFrame, last_first: bool, step, schema: str) -> DataFrame:
    """Run ``step(rows)`` over the rows of whole conversations in the order of their blocks."""
    order = [F.asc_nulls_first("conv_id"), F.desc("block") if last_first else F.asc("block")]

    def run(batches):
        carry = step()
        for batch in batches:
            yield pa.RecordBatch.from_pylist([carry(r) for r in batch.to_pylist()], schema=arrow)

    arrow = _arrow(schema)
    return df.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def _backwards():
    """Costs from each block's exits to the end of its conversation, less the least of them."""
    conv, costs = (), None

    def carry(row):
        nonlocal conv, costs
        last = conv != (row["conv_id"],)
        if last:
            conv, costs = (row["conv_id"],), tuple(INSERT * n for n in OWED)
        after, ways = costs, passage(row["marks"])
        costs = [min(ways[s][q] + after[q] for q in range(STATES)) for s in range(STATES)]
        least = min(costs)
        costs = tuple(min(c - least, FAR) if c < FAR else FAR for c in costs)
        return {"block": row["block"], "after": list(after), "last": last}

    return carry


def _forwards():
    """The entry of each block, its letters and costs, and whether its first row is out of order."""
    conv, state, role = (), NOTHING, 0

    def carry(row):
        nonlocal conv, state, role
        first, marks = conv != (row["conv_id"],), row["marks"]
        if first:
            conv, state = (row["conv_id"],), NOTHING
        codes = [m & 3 for m in marks]
        pairs = list(zip(codes, codes[1:]))
        if not first:
            pairs.append((role, codes[0]))
        role = codes[-1]
        entry = state
        state, letters = row["exits"][entry], row["letters"][entry]
        cost = passage(marks)[entry][state]
        if row["last"]:
            cost += INSERT * OWED[state]
            letters += "I" * OWED[state]
        return {
            "conv_id": row["conv_id"], "block": row["block"], "entry": entry, "audit": letters, "cost": cost,
            "illegal": sum(p not in LEGAL for p in pairs), "alone": first and row["last"],
            "blank": sum(m & BLANK > 0 for m in marks),
            "duplicate": sum(m & BLANK == 0 and m & COPY > 0 for m in marks),
            "truncated": sum(m & (BLANK | COPY) == 0 and m & CUT > 0 for m in marks),
        }

    return carry


class Repair:
    """A repair worked out: ``turns`` in order in blocks, and the edits of each block."""

    def __init__(self, blocks: DataFrame, chosen: DataFrame):
        self.blocks, self.chosen = blocks, chosen

    def edits(self) -> DataFrame:
        """(conv_id, block, place, edit, turn, role, text): one row per edit, in order.

        ``turn`` is null for an inserted row; ``role`` and ``text`` are null for a deleted one.
        """
        return self._per_block(
            "conv_id long, block long, place int, edit string, turn long, role string, text string",
            lambda conv, block, made: (
                {"conv_id": conv, "block": block, "place": i, "edit": e, "turn": t, "role": r, "text": x}
                for i, (e, t, r, x) in enumerate(made)
            ),
        )

    def joined(self) -> DataFrame:
        """(conv_id, block, alone, n, joined): the repaired ``role:text`` of each block, joined by newlines."""
        def row(conv, block, made):
            kept = [f"{r}:{x}" for _, _, r, x in made if r is not None]
            yield {"conv_id": conv, "block": block, "n": len(kept), "joined": "\n".join(kept)}

        return self._per_block("conv_id long, block long, n int, joined string", row).join(
            self.chosen.select("block", "alone"), "block"
        )

    def _per_block(self, schema: str, make) -> DataFrame:
        arrow = _arrow(schema)

        def run(batches):
            for batch in batches:
                for start in range(0, batch.num_rows, 64):
                    out = []
                    for b in batch.slice(start, 64).to_pylist():
                        made = [
                            (e, None if at is None else b["turns"][at], r, x)
                            for e, at, r, x in edits(b["audit"], b["entry"], b["roles"], b["texts"])
                        ]
                        out += make(b["conv_id"], b["block"], made)
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

        held = self.blocks.select("conv_id", "block", "turns", "roles", "texts")
        return held.join(self.chosen.select("block", "entry", "audit"), "block").mapInArrow(run, schema)

    def summary(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation with rows."""
        turns = self.blocks.select("conv_id", F.explode("turns").alias("turn")).where("turn IS NOT NULL").distinct()
        gaps = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
        parts = F.array_sort(F.collect_list(F.struct("block", "audit")))
        counts = ("blank", "duplicate", "truncated", "illegal", "cost")
        totals = self.chosen.groupBy("conv_id").agg(
            *(F.sum(c).alias(c) for c in counts), F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit")
        )
        found = totals.join(gaps.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left")
        return found.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), *counts, "audit")

    def hashes(self) -> DataFrame:
        """(conv_id, repaired_sha256): the hash of each conversation's repaired rows, joined by newlines.

        Conversations of several blocks are hashed as their blocks stream past.
        """
        joined = self.joined()
        alone = joined.where("alone").select("conv_id", F.sha2(F.col("joined").cast("binary"), 256).alias("repaired_sha256"))
        order = [F.asc_nulls_first("conv_id"), F.asc("block")]

        def run(batches):
            conv, digest, begun = (), None, False

            def done():
                return pa.RecordBatch.from_arrays(
                    [pa.array([conv[0]], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"]
                )

            for batch in batches:
                for c, n, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "n", "joined")), strict=True):
                    if conv != (c,):
                        if conv:
                            yield done()
                        conv, digest, begun = (c,), hashlib.sha256(), False
                    if n:
                        digest.update(b"\n" * begun + text.encode())
                        begun = True
            if conv:
                yield done()

        several = joined.where("NOT alone").select("conv_id", "block", "n", "joined")
        streamed = several.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(
            run, "conv_id long, repaired_sha256 string"
        )
        return alone.unionByName(streamed)


def repair_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> Repair:
    """The cheapest repair of each conversation; the audit that comes first in ASCII order decides ties."""
    blocks = written(blocks_of(rows, conv, turn, role, text), "turn-blocks")
    seen = blocks.select("conv_id", "block", F.posexplode("digests").alias("at", "digest")).where("digest IS NOT NULL")
    first = seen.groupBy("conv_id", "digest").agg(F.min(F.struct("block", "at")).alias("f"))
    firsts = first.groupBy("f.block").agg(F.collect_list("f.at").alias("firsts"))

    def mark(batches):
        for batch in batches:
            marks = []
            for m, known in zip(batch.column("marks").to_pylist(), batch.column("firsts").to_pylist(), strict=True):
                new = set(known or ())
                marks.append(bytes(x if i in new or x & BLANK else x | COPY for i, x in enumerate(m)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("block"), pa.array(marks, pa.binary())], names=["conv_id", "block", "marks"]
            )

    narrow = "conv_id long, block long, marks binary"
    marked = written(
        blocks.select("conv_id", "block", "marks").join(firsts, "block", "left").mapInArrow(mark, narrow), "turn-marks"
    )
    after = _streamed(marked, True, _backwards, "block long, after array<long>, last boolean")

    def trace(batches):
        for batch in batches:
            found = [
                [traced(m, tuple(costs), s) for s in range(STATES)]
                for m, costs in zip(batch.column("marks").to_pylist(), batch.column("after").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("conv_id", "block", "marks", "last")),
                    pa.array([[x for x, _ in f] for f in found], pa.list_(pa.int32())),
                    pa.array([[a for _, a in f] for f in found], pa.list_(pa.string())),
                ],
                names=["conv_id", "block", "marks", "last", "exits", "letters"],
            )

    paths = marked.join(after, "block").mapInArrow(
        trace, f"{narrow}, last boolean, exits array<int>, letters array<string>"
    )
    chosen = _streamed(
        paths, False, _forwards,
        "conv_id long, block long, entry int, audit string, cost long, illegal long, alone boolean, "
        "blank long, duplicate long, truncated long",
    )
    return Repair(blocks, written(chosen, "turn-edits"))
