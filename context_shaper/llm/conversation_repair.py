"""Repairing the structure of conversations with the fewest edits, by Four-Russians block tables.

Rows of a conversation are kept, given another role or deleted, and rows are inserted, so that roles follow
``(system? (user assistant)+)?``; blank and repeated rows must go, truncated ones cost extra.  The tables of
``four_russians`` process blocks of rows by lookup.

One conversation may hold a third of all rows.  Equal rows are counted before any shuffle, the counted rows are
sorted over all tasks by conversation and place, and cut into chunks of some thousand rows wherever they lie.
Each chunk becomes a matrix of costs from state to state; one row per chunk is followed through the
conversation, backward for the costs behind every chunk and forward for the state before it; between the two,
chunks are traced independently.  Texts take no part in this.  They are shuffled once, to meet their edits
in order, and pass through one at a time: a digest of a whole conversation is made in sequence by definition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from context_shaper.llm.four_russians import (
    AFTER_U, INITIALS, KEEP, LEGAL, MAKE, ROW_LETTERS, START, TAILS, EditCosts, block_tables, final_vector, through,
)
from context_shaper.session import stage

SPACES = " \t\n\x0b\x0c\r"
PIECE = 4096
OUT_BYTES = 1 << 22
ROLES = {True: "user", False: "assistant"}


@dataclass(frozen=True)
class Repair:
    """``chunk``: rows of one conversation that are processed as one; it changes no result."""

    costs: EditCosts = EditCosts()
    chunk: int = 4096


def _rows(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, key, row letter if first, row letter if repeated)."""
    rows = messages.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    said = F.rtrim("text", F.lit(SPACES))
    status = F.when(said == "", 2).when(F.right(said, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)), F.lit(0)) - 1, F.lit(3))
    initial = F.when(F.col("role") == "", 3).otherwise(initial)

    def letter(of: Column) -> Column:
        return F.substring(F.lit(ROW_LETTERS), 4 * of + initial + 1, F.lit(1))

    return rows.withColumn("key", F.md5("text")).withColumn("first", letter(status)).withColumn(
        "again", letter(F.when(said == "", 2).otherwise(3))
    )


def _counted(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one, with their number and whether the role and text came in an earlier turn."""
    runs = rows.groupBy("conv_id", "turn", "role", "key", "first", "again").agg(F.count(F.lit(1)).alias("n"))
    spread = runs.groupBy("conv_id", "role", "key").agg(
        F.min(F.struct("turn")).alias("earliest"), F.count(F.lit(1)).alias("turns")
    ).filter("turns > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"), "earliest.turn")
    same = runs["conv_id"].eqNullSafe(spread["c"]) & (runs["role"] == spread["r"]) & (runs["key"] == spread["k"])
    later = spread["c"].isNotNull() | spread["r"].isNotNull()
    return runs.join(spread, same, "left").select(
        "conv_id", runs["turn"], "role", "key", "again", "n",
        F.when(later & ~runs["turn"].eqNullSafe(spread["turn"]), F.col("again")).otherwise(F.col("first")).alias("first"),
    )


def _chunked(size: int):
    """Sorted rows(conv_id, turn, role, key, letters) to chunks, numbered in their order over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        head, letters, held = None, [], 0
        for batch in batches:
            columns = [column.to_pylist() for column in batch.columns]
            chunks = []
            for conv, turn, role, key, some in zip(*columns):
                if head is not None and (conv != head[0] or held >= size):
                    chunks.append((*head, number, "".join(letters)))
                    head, letters, held, number = None, [], 0, number + 1
                if head is None:
                    head = (conv, turn, role, key)
                letters.append(some)
                held += len(some)
            if chunks:
                yield _batch(chunks, batch.schema, ["chunk", "letters"])
        if head is not None:
            yield _batch([(*head, number, "".join(letters))], batch.schema, ["chunk", "letters"])

    return run


def _batch(rows: list[tuple], schema: pa.Schema, last: list[str]) -> pa.RecordBatch:
    kinds = [field.type for field in schema][:4]
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), [*kinds, pa.int64(), pa.string()])]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "key", *last])


def _add_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    names = [name for name in batch.schema.names if name not in drop]
    return pa.RecordBatch.from_arrays([*[batch.column(name) for name in names], *columns.values()], names=[*names, *columns])


def _transitions(costs: EditCosts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = block_tables(costs)
        for batch in batches:
            found = [tables.transitions(tables.blocks(rows)) for rows in batch.column("letters").to_pylist()]
            yield _add_columns(batch, {"transitions": pa.array(found, pa.list_(pa.int64()))})

    return run


def _backward(costs: EditCosts):
    """The vector behind each chunk; a conversation's chunks come last first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_conv, vector = object(), ()
        for batch in batches:
            behind, ends = [], []
            for conv, matrix in zip(batch.column("conv_id").to_pylist(), batch.column("transitions").to_pylist()):
                ends.append(conv != open_conv)
                if conv != open_conv:
                    open_conv, vector = conv, final_vector(costs)
                behind.append(list(vector))
                vector = through(matrix, vector)
            yield _add_columns(
                batch, {"behind": pa.array(behind, pa.list_(pa.int64())), "ends": pa.array(ends, pa.bool_())}, ("transitions",)
            )

    return run


def _trace(costs: EditCosts):
    """Per chunk the edits and the state behind it, for each state before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = block_tables(costs)
        for batch in batches:
            edits, states = [], []
            for rows, behind, ends in zip(*[batch.column(name).to_pylist() for name in ("letters", "behind", "ends")]):
                paths = tables.trace(tables.blocks(rows), tuple(behind))
                edits.append([letters + (TAILS[state] if ends else "") for letters, state in paths])
                states.append([state for _, state in paths])
            yield _add_columns(
                batch, {"edits": pa.array(edits, pa.list_(pa.string())), "states": pa.array(states, pa.list_(pa.int32()))},
                ("behind", "ends"),
            )

    return run


def _cost(letters: str, edits: str, costs: EditCosts) -> int:
    total = costs.insert * edits.count("I") + costs.delete * edits.count("D") + costs.rerole * edits.count("R")
    if any(x in letters for x in ROW_LETTERS[4:8]):
        kept = zip(letters, edits.replace("I", ""))
        total += costs.truncated * sum(row in ROW_LETTERS[4:8] and edit != "D" for row, edit in kept)
    return total


FACTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def _forward(costs: EditCosts):
    """The edits from the state each chunk is entered in, and the chunk's figures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_conv, state, last = object(), START, None
        for batch in batches:
            names = ("conv_id", "letters", "edits", "states")
            chosen, facts = [], []
            for conv, rows, edits, states in zip(*[batch.column(name).to_pylist() for name in names]):
                if conv != open_conv:
                    open_conv, state, last = conv, START, None
                initials = [ROW_LETTERS.index(row) % 4 for row in rows]
                before = [*([] if last is None else [last]), *initials]
                illegal = sum(pair not in LEGAL for pair in zip(before, before[1:]))
                blank, duplicate, truncated = (
                    sum(rows.count(x) for x in ROW_LETTERS[low : low + 4]) for low in (8, 12, 4)
                )
                chosen.append(edits[state])
                facts.append((blank, duplicate, truncated, illegal, _cost(rows, edits[state], costs)))
                state, last = states[state], initials[-1]
            columns = {"edits": pa.array(chosen, pa.string())}
            columns |= {name: pa.array(values, pa.int64()) for name, values in zip(FACTS, zip(*facts))}
            yield _add_columns(batch, columns, ("letters", "edits", "states"))

    return run


def repair_edits(messages: DataFrame, options: Repair = Repair()) -> DataFrame:
    """The cheapest edits of messages(conv_id, turn, role, text), a row per chunk of a conversation, staged.

    (conv_id, turn, role, key, chunk, edits, blank, duplicate, truncated, illegal, cost): the place of the chunk's
    first row, its number in the order of chunks, a letter per edit (K keep, R another role, D delete,
    I insert), and figures over its rows.
    """
    return _edits(_counted(_rows(messages)), options)


def _edits(counted: DataFrame, options: Repair) -> DataFrame:
    start = F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(PIECE).cast("bigint"))).alias("piece", "at")
    size = F.least(F.col("n") - F.col("at"), F.lit(PIECE)).cast("int")
    letters = F.concat(F.when(F.col("piece") == 0, F.col("first")).otherwise(F.col("again")), F.repeat("again", size - 1))
    place = ["conv_id", "turn", "role", "key"]
    pieces = counted.select("*", start).select(*place, "piece", letters.alias("letters"))
    pieces = pieces.repartitionByRange(*place, "piece").sortWithinPartitions(*place, "piece").drop("piece")
    kinds = ", ".join(f"{name} {pieces.schema[name].dataType.simpleString()}" for name in place)
    chunks = stage(pieces.mapInArrow(_chunked(options.chunk), f"{kinds}, chunk bigint, letters string"), "chunks")
    at = f"{kinds}, chunk bigint"
    costs = options.costs
    matrices = chunks.mapInArrow(_transitions(costs), f"{at}, letters string, transitions array<bigint>")
    followed = matrices.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("chunk")).mapInArrow(
        _backward(costs), f"{at}, letters string, behind array<bigint>, ends boolean"
    )
    traced = followed.repartition("chunk").mapInArrow(
        _trace(costs), f"{at}, letters string, edits array<string>, states array<int>"
    )
    facts = ", ".join(f"{name} bigint" for name in FACTS)
    chosen = traced.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(
        _forward(costs), f"{at}, edits string, {facts}"
    )
    return stage(chosen, "edits")


def _meeting(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """Texts and edits by conversation, in order; edits come before the first row they are of."""
    texts = _rows(messages).select(
        "conv_id", "turn", "role", "key", F.lit(1).alias("step"), F.lit(None).cast("bigint").alias("chunk"),
        F.lit(None).cast("string").alias("edits"), "text", *[F.lit(0).cast("bigint").alias(name) for name in FACTS],
    )
    orders = edits.select(
        "conv_id", "turn", "role", "key", F.lit(0).alias("step"), "chunk", "edits", F.lit(None).cast("string").alias("text"), *FACTS,
    )
    place = ["conv_id", "turn", "role", "key", "step", "chunk"]
    return texts.unionByName(orders).repartition("conv_id").sortWithinPartitions(*place).drop("key", "step", "chunk")


class _Conversation:
    """Edits of one conversation applied to its rows as they come."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.state, self.rows = conv_id, START, 0
        self.pending, self.at = "", 0

    def order(self, edits: str) -> None:
        self.pending, self.at = self.pending[self.at :] + edits, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.pending) and self.pending[self.at] == "I":
            self.at += 1
            self.state = MAKE[self.state]
            yield ROLES[self.state == AFTER_U], "", "I"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.pending[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEEP[self.state, INITIALS.index(role[0])]
            yield role, text, edit
        elif edit == "R":
            self.state = MAKE[self.state]
            yield ROLES[self.state == AFTER_U], text, edit


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "position", "turn", "role", "text", "edit"]
    kinds, rows, held, open_one = None, [], 0, None

    def flush() -> pa.RecordBatch:
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def take(turn, found) -> None:
        nonlocal held
        for role, text, edit in found:
            rows.append((open_one.conv_id, open_one.rows, None if edit == "I" else turn, role, text, edit))
            open_one.rows += 1
            held += len(text) + 64

    for batch in batches:
        kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for conv, turn, role, edits, text in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "turn", "role", "edits", "text")]):
            if open_one is None or conv != open_one.conv_id:
                if open_one is not None:
                    take(None, open_one.inserted())
                open_one = _Conversation(conv)
            if edits is not None:
                open_one.order(edits)
            else:
                take(turn, open_one.row(role, text))
            if held > OUT_BYTES:
                yield flush()
                rows, held = [], 0
    if open_one is not None:
        take(None, open_one.inserted())
    if rows:
        yield flush()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", *FACTS, "audit", "repaired_sha256"]
    kinds, open_one, digest, audit, facts = None, None, None, [], [0] * len(FACTS)

    def add(found) -> None:
        for role, text, _ in found:
            digest.update(f"{chr(10) if open_one.rows else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            open_one.rows += 1

    def done() -> tuple:
        add(open_one.inserted())
        return (open_one.conv_id, *facts, "".join(audit), digest.hexdigest())

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        kinds = [batch.schema.field("conv_id").type, *[pa.int64()] * len(FACTS), pa.string(), pa.string()]
        rows = []
        used = ["conv_id", "role", "edits", "text", *FACTS]
        for conv, role, edits, text, *some in zip(*[batch.column(x).to_pylist() for x in used]):
            if open_one is None or conv != open_one.conv_id:
                if open_one is not None:
                    rows.append(done())
                open_one, digest, audit, facts = _Conversation(conv), hashlib.sha256(), [], [0] * len(FACTS)
            if edits is not None:
                open_one.order(edits)
                audit.append(edits)
                facts = [a + b for a, b in zip(facts, some)]
            else:
                add(open_one.row(role, text))
        if rows:
            yield out(rows)
    if open_one is not None:
        yield out([done()])


def repaired_messages(messages: DataFrame, options: Repair = Repair()) -> DataFrame:
    """(conv_id, position, turn, role, text, edit): the repaired conversations, inserted rows with a null turn.

    Rows of messages(conv_id, turn, role, text, ...) are ordered by turn, missing ones first, and rows of one turn by
    role and a hash of the text; equal rows stand together.  A null role or text is one space, a null conv_id a
    conversation of its own.  A row is blank without a character other than the six ASCII spaces, repeated if its
    conversation has its role and text before, truncated if its last such character is not one of ``.!?``; the
    first of these counts.  Roles are told apart by their first letter.  Of the cheapest sequences of edits the
    first in the alphabet is taken.  Long texts pass one at a time.  Other columns are ignored, an empty
    table gives an empty result.
    """
    kind = messages.schema["conv_id"].dataType.simpleString()
    return _meeting(messages, repair_edits(messages, options)).mapInArrow(
        _repaired, f"conv_id {kind}, position bigint, turn bigint, role string, text string, edit string"
    )


def audit_conversations(messages: DataFrame, options: Repair = Repair()) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row per conversation.

    ``gaps`` counts the turns missing between the least and the greatest, ``illegal`` the neighbouring rows whose
    initials cannot follow each other, both before the repair; ``audit`` holds a letter per edit, in order;
    the hash is of the repaired ``role:text`` lines.  Rows and ties as in ``repaired_messages``.
    """
    counted = _counted(_rows(messages))
    kind = messages.schema["conv_id"].dataType.simpleString()
    facts = ", ".join(f"{name} bigint" for name in FACTS)
    digests = _meeting(messages, _edits(counted, options)).mapInArrow(
        _digested, f"conv_id {kind}, {facts}, audit string, repaired_sha256 string"
    )
    missing = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = counted.groupBy(F.col("conv_id").alias("c")).agg(F.coalesce(missing, F.lit(0)).alias("gaps"))
    return digests.join(gaps, digests["conv_id"].eqNullSafe(gaps["c"])).select(
        "conv_id", "gaps", *FACTS, "audit", "repaired_sha256"
    )
