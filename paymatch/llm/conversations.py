"""Conversation structure repair by a square-root checkpointed dynamic programme.

The turns of a conversation are made to read ``(system? (user assistant)+)?`` by
the cheapest edits: keep a turn, give it another role, delete it, insert an
empty one. Four states (nothing yet, after a system, a user, an assistant turn) suffice, so a
row of a conversation is a 4 x 4 min-plus step and the cheapest rest from each state is
a vector of four costs, computed backwards.

Vectors are kept only at checkpoints. All rows are put in one order and cut into
blocks of about the square root of their number, so a conversation of any length
is many blocks of bounded size:

1. every block is reduced to its 4 x 4 matrix of costs;
2. per conversation the matrices (square root many at most) give the vector at the end of each block;
3. every block recomputes its vectors from that checkpoint (again keeping only
   square root many) while it walks forward from each of the four states, taking at every row the
   ASCII-least edit that is tight;
4. per conversation the blocks' exits tell the state in which each block is entered.

Only codes of one letter a row go through these passes. Texts are shuffled once, to
their surviving rows: a text survives at most once per conversation, as later copies are deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import inf, isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paymatch.llm.ordering import in_order
from paymatch.llm.store import save

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
SPACE = " \t\n\x0b\x0c\r"
#: Initials of roles as the states read them; any other role is the last one.
INITIALS = "sua?"
BLANK, DUPLICATE, CUT_SHORT = 1, 2, 3
#: State after keeping a turn of an initial, and the role that comes next, per state.
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_NEXT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
#: Cheapest ends: nothing or a closed pair is done, the others insert what is missing.
END = (0, 6, 3, 0)
_LEAST_BITS = 8
#: Repeated code strings up to so many rows are worked out once.
_SHORT = 64

Vector = tuple[float, float, float, float]


def letter(initial: Column, fault: Column) -> Column:
    """A row as one letter: initial and first fault."""
    return F.chr(F.lit(65) + 4 * initial + fault)


def _read(code: str) -> tuple[str, int]:
    number = ord(code) - 65
    return INITIALS[number // 4], number % 4


def _back(code: str, after: Vector) -> Vector:
    """Costs before a row (insertions before it included) from the costs after it."""
    initial, fault = _read(code)
    out = [DELETE + v for v in after]
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED if fault == CUT_SHORT else 0
        for state in range(4):
            out[state] = min(out[state], extra + REROLE + after[_NEXT[state]])
            kept = _KEPT[state].get(initial)
            if kept is not None:
                out[state] = min(out[state], extra + after[kept])
    user, assistant = min(out[2], INSERT + out[3]), min(out[3], INSERT + out[2])
    return min(out[0], INSERT + user), min(out[1], INSERT + user), user, assistant


def _matrix(codes: str) -> list[float]:
    """Cheapest cost from each state before a block to each after it, row by row."""
    columns = []
    for state in range(4):
        vector: Vector = tuple(0 if s == state else inf for s in range(4))
        for code in reversed(codes):
            vector = _back(code, vector)
        columns.append(vector)
    return [columns[t][s] for s in range(4) for t in range(4)]


def _edits(code: str, now: Vector, after: Vector, state: int) -> tuple[str, int]:
    """ASCII-least tight edits at a row, and the state after it."""
    initial, fault = _read(code)
    extra = TRUNCATED if fault == CUT_SHORT else 0
    done = ""
    while True:
        if DELETE + after[state] == now[state]:
            return done + "D", state
        if INSERT + now[_NEXT[state]] == now[state]:
            done += "I"
            state = _NEXT[state]
            continue
        kept = _KEPT[state].get(initial)
        if kept is not None and extra + after[kept] == now[state]:
            return done + "K", kept
        return done + "R", _NEXT[state]


def _walks(codes: str, after: Vector, last: bool) -> tuple[list[str], list[int]]:
    """Per state in which a block is entered: its edits (row by row, comma-joined) and the state at its end.

    The last block of a conversation has one more element, the insertions that close it.
    """
    n = len(codes)
    step = isqrt(n) + 1
    kept = {n: after}
    vector = after
    for i in range(n - 1, -1, -1):
        vector = _back(codes[i], vector)
        if i % step == 0:
            kept[i] = vector
    states, done = [0, 1, 2, 3], [[] for _ in range(4)]
    for a in range(0, n, step):
        b = min(a + step, n)
        vectors = [kept[b]]
        for i in range(b - 1, a - 1, -1):
            vectors.append(_back(codes[i], vectors[-1]))
        vectors.reverse()
        for k in range(4):
            for i in range(a, b):
                edits, states[k] = _edits(codes[i], vectors[i - a], vectors[i - a + 1], states[k])
                done[k].append(edits)
    if last:
        for k in range(4):
            closing = ""
            while after[states[k]]:
                closing += "I"
                states[k] = _NEXT[states[k]]
            done[k].append(closing)
    return [",".join(d) for d in done], states


def _illegal(codes: str) -> int:
    """Adjacent turns that are not system-user, user-assistant or assistant-user."""
    initials = [INITIALS[(ord(c) - 65) // 4] for c in codes]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, block, codes) to (conv_id, block, matrix, ends, illegal): what a conversation needs of a block."""
    once = lru_cache(1 << 14)(_matrix)
    for batch in batches:
        codes = batch.column(2).to_pylist()
        matrices = [(once if len(c) <= _SHORT else _matrix)(c) for c in codes]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(matrices, pa.list_(pa.float64())),
             pa.array([c[0] + c[-1] for c in codes]), pa.array([_illegal(c) for c in codes], pa.int64())],
            ["conv_id", "block", "matrix", "ends", "illegal"])


def _checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, its blocks' sums in order) to each block's vector at its end; the first also has cost and illegal pairs."""
    for batch in batches:
        out = {c: [] for c in ("row", "block", "after", "last", "cost", "illegal")}
        for row, blocks in enumerate(batch.column(1).to_pylist()):
            vector: Vector = END
            for b in reversed(blocks):
                out["row"].append(row)
                out["block"].append(b["block"])
                out["after"].append(vector)
                out["last"].append(b is blocks[-1])
                out["cost"].append(None)
                out["illegal"].append(None)
                m = b["matrix"]
                vector = tuple(min(m[4 * s + t] + vector[t] for t in range(4)) for s in range(4))
            out["cost"][-1] = int(vector[0])
            seams = "".join(b["ends"] for b in blocks)[1:-1]
            out["illegal"][-1] = sum(b["illegal"] for b in blocks) + sum(
                _illegal(seams[i:i + 2]) for i in range(0, len(seams), 2))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(out["row"], pa.int64())), pa.array(out["block"], pa.int64()),
             pa.array(out["after"], pa.list_(pa.float64())), pa.array(out["last"], pa.bool_()),
             pa.array(out["cost"], pa.int64()), pa.array(out["illegal"], pa.int64())],
            ["conv_id", "block", "after", "last", "cost", "illegal"])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, block, codes, after, last) to (conv_id, block, walks, exits)."""
    once = lru_cache(1 << 14)(_walks)
    for batch in batches:
        walks, exits = [], []
        for codes, after, last in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4))):
            w, e = (once if len(codes) <= _SHORT else _walks)(codes, tuple(after), last)
            walks.append(w)
            exits.append(e)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(walks, pa.list_(pa.string())),
                                          pa.array(exits, pa.list_(pa.int32()))], ["conv_id", "block", "walks", "exits"])


_ITEMS = "place long, step int, edit string, role string, same binary"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, members, walk, state) to the turns that stand after the edits."""
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for row, (members, walk, state) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
            for i, edits in enumerate(walk.split(",")):
                # what closes the conversation follows its last row
                member = members[min(i, len(members) - 1)]
                first = 0 if i < len(members) else 1 << 20
                for step, edit in enumerate(edits):
                    if edit == "D":
                        continue
                    kept = edit == "K"
                    role = member["role"] if kept else _ROLE[state]
                    state = _KEPT[state][role[0]] if kept else _NEXT[state]
                    for column, value in zip(out, (row, member["place"], first + step, edit, role,
                                                   None if edit == "I" else member["same"])):
                        column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
             pa.array(out[3], pa.string()), pa.array(out[4], pa.string()), pa.array(out[5], pa.binary())],
            ["conv_id", "place", "step", "edit", "role", "same"])


@dataclass
class Repair:
    """``summary``: a row per conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit);
    ``turns``: the repaired conversations (conv_id, place, step, edit, role, text), ordered by place and step."""

    summary: DataFrame
    turns: DataFrame


def same_of(conv_id: Column, role: Column, text: Column) -> Column:
    """Digest of a turn's conversation, role and text."""
    conv = F.coalesce(conv_id.cast("string"), F.lit("-"))
    sizes = [F.octet_length(c).cast("string") for c in (conv, role)]
    return F.unhex(F.sha2(F.concat(F.concat_ws(":", conv_id.isNull().cast("string"), *sizes, conv), role, text), 256))


def repair(rows: DataFrame) -> Repair:
    """Cheapest repair of every conversation of ``rows`` (conv_id, turn, role, text; other columns are not read).

    Rows go by turn, nulls first; rows of one turn by role and a digest of the text, so that ties
    have a defined order. Null roles and texts count as one space. Null conv_ids are
    one conversation. A row's first fault counts: blank (nothing but ASCII white space), duplicate (role
    and text seen earlier), truncated (its last other character is not one of ``.!?``). Costs: rerole 3,
    delete 4 (blank and duplicate rows must be deleted), insert 3, a truncated row that stays 3. A role that
    begins with none of the letters s, u, a can't be kept. No rows give no rows.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    end = F.rtrim(text, F.lit(SPACE))
    named = rows.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                        end.alias("end")).withColumn("same", same_of(*map(F.col, ("conv_id", "role", "text"))))
    fault = F.when(F.col("end") == "", BLANK).when(~F.substring("end", -1, 1).isin(".", "!", "?"), CUT_SHORT).otherwise(0)
    narrow = named.select("conv_id", "turn", "role", "same", fault.alias("fault"))
    ordered = in_order(narrow, ["conv_id", "turn", "role", "same"], "turns")
    # blocks of about the square root of all rows
    bits = max(_LEAST_BITS, (isqrt(ordered.count()) - 1).bit_length())
    first = ordered.groupBy("same").agg(F.min("place").alias("at")).select("at")
    start = F.substring("role", 1, 1)
    initial = F.when(start == "s", 0).when(start == "u", 1).when(start == "a", 2).otherwise(3)
    seen = (F.col("fault") != BLANK) & F.col("at").isNull()
    coded = (ordered.join(first, F.col("place") == F.col("at"), "left")
             .withColumn("fault", F.when(seen, DUPLICATE).otherwise(F.col("fault")))
             .select("conv_id", "turn", "fault", F.shiftright("place", bits).alias("block"),
                     F.struct("place", letter(initial, F.col("fault")).alias("code"), "role", "same").alias("member")))
    coded = save(coded, "turn-codes")
    members = F.array_sort(F.collect_list("member"))
    blocks = save(coded.groupBy("conv_id", "block").agg(members.alias("members"))
                  .withColumn("codes", F.array_join("members.code", "")), "turn-blocks")

    key = f"conv_id {conv}, block long"
    sums = blocks.select("conv_id", "block", "codes").mapInArrow(
        _summed, f"{key}, matrix array<double>, ends string, illegal long")
    per_conv = sums.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "matrix", "ends", "illegal"))))
    points = save(per_conv.mapInArrow(_checkpoints, f"{key}, after array<double>, last boolean, cost long, illegal long"),
                  "turn-checkpoints")

    def with_block(left: DataFrame, right: DataFrame) -> DataFrame:
        named = right.withColumnRenamed("conv_id", "_conv").withColumnRenamed("block", "_block")
        return left.join(named, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))
                         ).drop("_conv", "_block")

    walked = save(with_block(blocks.select("conv_id", "block", "codes"), points.select("conv_id", "block", "after", "last"))
                  .mapInArrow(_walked, f"{key}, walks array<string>, exits array<int>"), "turn-walks")
    exits = walked.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "exits"))).alias("all"))
    # the state in which each block is entered: the exits of those before it, from state 0
    entered = exits.select("conv_id", F.explode(F.aggregate(
        "all", F.struct(F.lit(0).alias("state"), F.array().cast("array<struct<block:bigint,state:int>>").alias("found")),
        lambda s, b: F.struct(F.get(b["exits"], s["state"]).alias("state"), F.array_append(
            s["found"], F.struct(b["block"].alias("block"), s["state"].alias("state"))).alias("found")))["found"]).alias("e"))
    entered = entered.select("conv_id", F.col("e.block").alias("block"), F.col("e.state").alias("state"))
    chosen = save(with_block(walked, entered).select("conv_id", "block", F.get("walks", F.col("state")).alias("walk"), "state"),
                  "turn-edits")
    items = save(with_block(blocks.select("conv_id", "block", "members"), chosen)
                 .select("conv_id", "members", "walk", "state").mapInArrow(_items, f"conv_id {conv}, {_ITEMS}"), "turn-items")
    return Repair(_summary(coded, points, chosen), _turns(items, named))


def _summary(coded: DataFrame, points: DataFrame, chosen: DataFrame) -> DataFrame:
    def faults(kind: int, name: str) -> Column:
        return F.count(F.when(F.col("fault") == kind, 1)).alias(name)

    names = ("blank", "duplicate", "truncated")
    per_turn = coded.groupBy("conv_id", "turn").agg(*[faults(k, n) for k, n in zip((BLANK, DUPLICATE, CUT_SHORT), names)])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    counted = per_turn.groupBy("conv_id").agg(gaps, *[F.sum(n).alias(n) for n in names])
    costs = points.where("cost is not null").select(F.col("conv_id").alias("_c"), "illegal", "cost")
    edits = F.array_sort(F.collect_list(F.struct("block", F.translate("walk", ",", "").alias("audit"))))
    audits = chosen.groupBy(F.col("conv_id").alias("_a")).agg(F.array_join(edits["audit"], "").alias("audit"))
    return (counted.join(costs, F.col("conv_id").eqNullSafe(F.col("_c")))
            .join(audits, F.col("conv_id").eqNullSafe(F.col("_a"))).drop("_c", "_a"))


def _turns(items: DataFrame, named: DataFrame) -> DataFrame:
    # the join takes the partitioning of the aggregation: texts are shuffled once
    texts = named.groupBy(F.col("same").alias("_same")).agg(F.first("text").alias("text"))
    kept = items.where("same is not null").join(texts, F.col("same") == F.col("_same"))
    columns = ["conv_id", "place", "step", "edit", "role", "text"]
    inserted = items.where("same is null").withColumn("text", F.lit(""))
    return kept.select(*columns).unionByName(inserted.select(*columns))


def damage(rows: DataFrame) -> DataFrame:
    """Test damage by ``crc32("conv_id:turn") % 20`` (nulls there are one space, as are null roles and texts):
    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    return (rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
                                         text.alias("text"), copies.alias("_copy")).drop("_copy"))


def digests(turns: DataFrame) -> DataFrame:
    """sha256 of each conversation's ``role:text`` lines.

    One hash runs over a conversation from front to back, so its lines pass
    through one task, as a stream: only the running hash and the current batch are held.
    """
    conv = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, at, running, ids, found = None, None, None, [], []

        def emit(every: int) -> Iterator[pa.RecordBatch]:
            if len(ids) >= every and kind is not None:
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(found)], ["conv_id", "repaired_sha256"])
                ids.clear()
                found.clear()

        for batch in batches:
            kind = batch.column(0).type
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in (0, 3, 4))):
                line = f"{role}:{text}".encode()
                if running is not None and conv_id == at:
                    running.update(b"\n" + line)
                    continue
                if running is not None:
                    ids.append(at)
                    found.append(running.hexdigest())
                    yield from emit(4096)
                at, running = conv_id, hashlib.sha256(line)
        if running is not None:
            ids.append(at)
            found.append(running.hexdigest())
        yield from emit(1)

    partitions = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (turns.select("conv_id", "place", "step", "role", "text").repartition(partitions, "conv_id")
            .sortWithinPartitions("conv_id", "place", "step")
            .mapInArrow(run, f"conv_id {conv}, repaired_sha256 string"))
