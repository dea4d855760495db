"""Least-cost repair of conversations: cost layers of grammar states, read back bit by bit.

The roles of a whole conversation read ``(s?(ua)+)?`` by their initials.  Edits cost: Keep 0, Rerole (to
user or assistant) 1, Delete 2, Insert (an empty user or assistant row) 5; a row that is cut short and
not deleted costs 5 more; a blank row or one that was said before must go.  ``repair`` finds the
cheapest edits, and of those the least string of their initials.

*Layers.*  For each turn there is one bitset of grammar states (start, s, u, a) for each increasing
cost: those from which the rest of the conversation is repaired at that very cost.  All layers of a
turn lie side by side in one integer, four bits each, so that an edit is a shift: by two layers for
Delete, five for Insert.  The lowest layer that holds the start state at the first turn gives the cost;
from there the bits tell, edit by edit in order D, I, K, R, which one still leads to the end at what is left.
Costs of a turn's states differ by 12 at most (u and a reach each other by an insertion, each stands in
for start and s by at most 12), so 16 layers above the lowest hold them all.

*On Spark.*  Rows are range-partitioned by conversation and turn and each partition is folded in order.
Conversations that lie inside a partition and have at most ``segment_rows`` rows are done there.
Others (the first and last of each partition, and long ones, of any share of all rows) go on in
segments: a segment's cost matrix between states (four runs over its layers) is made in its own task,
suffixes of matrices give what is left behind each segment, each segment is traced from all four
states in its own task, and last the traces are chained.  Two passes see a long conversation whole, a
record for each segment and nothing kept but four numbers or a hash; SHA-256 takes a text in order,
so the last can't be split.

Defined cases: a null role or text is one space, so it is blank or no role of the grammar; a null conv_id is a
conversation; null turns come first; rows of one turn stand in the order of a hash of role and text,
equal ones together; an empty role has no initial; no rows leave no conversations; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.text import columns_of
from quern.scratch import Scratch

SEGMENT_ROWS, SEGMENT_CHARS = 512, 1 << 20
#: Sequences of turns whose repair a worker keeps, some 300 bytes each.
KNOWN = 100_000

START, S, U, A = range(4)
_LAYERS = 16
_ALL = (1 << 4 * _LAYERS) - 1
_OF = [sum(1 << 4 * c + q for c in range(_LAYERS + 24)) for q in range(4)]
FINE, TRUNCATED, BLANK = range(3)
_UNREACHED = 1 << 60
#: What is left to pay behind the last row, by state: an insertion after u, two after s.
_END = (0, 10, 5, 0)
ROLES = {U: "user", A: "assistant"}


def _before(layers: int, initial: str) -> int:
    """Per layer, the states from which a row of that initial leads into the layer's set."""
    if initial == "u":
        into = layers & _OF[U]
        return into >> 2 | into >> 1 | into << 1
    if initial == "a":
        return (layers & _OF[A]) >> 1
    return (layers & _OF[S]) >> 1 if initial == "s" else 0


def _after(state: int, initial: str) -> int | None:
    """The state behind a row of that initial."""
    if initial == "u":
        return U if state != U else None
    if initial == "a":
        return A if state == U else None
    return S if initial == "s" and state == START else None


def _packed(costs) -> tuple[int, int]:
    """The lowest of four costs, and layers above it."""
    low = min(costs)
    return low, sum(1 << 4 * (c - low) + q for q, c in enumerate(costs) if c - low < _LAYERS)


def _layers(turns: tuple, end) -> list[tuple[int, int]]:
    """(lowest cost, layers above it) before each turn and at the end; ``turns``: (fault, initial), a row that must go as (BLANK, ...)."""
    base, layers = _packed(end)
    out = [(base, layers)]
    for fault, initial in reversed(turns):
        now = layers << 8
        if fault != BLANK:
            extra = 20 if fault == TRUNCATED else 0
            now |= _before(layers, initial) << extra | (_before(layers, "u") | _before(layers, "a")) << 4 + extra
        for _ in range(2):  # a third insertion in a row leads back
            now |= (_before(now, "u") | _before(now, "a")) << 20
        lowest = ((now & -now).bit_length() - 1) // 4
        base, layers = base + lowest, now >> 4 * lowest & _ALL
        out.append((base, layers))
    out.reverse()
    return out


def _costs(at: tuple[int, int]) -> list[int]:
    """The least cost of each state."""
    base, layers = at
    out = []
    for q in range(4):
        own = layers & _OF[q]
        out.append(base + ((own & -own).bit_length() - 1) // 4 if own else _UNREACHED)
    return out


def _trace(turns: tuple, layers: list, state: int, last: bool) -> tuple[str, int]:
    """The least audit from ``state`` on, and the state behind it; ``last``: no rows follow."""

    def open_at(place: int, q: int | None, cost: int) -> bool:
        base, bits = layers[place]
        return q is not None and 0 <= cost - base < _LAYERS and bits >> 4 * (cost - base) + q & 1 == 1

    out, left = [], _costs(layers[0])[state]
    for place, (fault, initial) in enumerate(turns):
        while True:
            following = _after(state, "u") or _after(state, "a")
            extra = 5 if fault == TRUNCATED else 0
            if open_at(place + 1, state, left - 2):
                out.append("D")
                left -= 2
                break
            if open_at(place, following, left - 5):
                out.append("I")
                state, left = following, left - 5
                continue
            kept = _after(state, initial)
            if open_at(place + 1, kept, left - extra):
                out.append("K")
                state, left = kept, left - extra
            else:
                out.append("R")
                state, left = following, left - extra - 1
            break
    while last and state in (S, U):
        out.append("I")
        state = _after(state, "u") or A
    return "".join(out), state


def solve(turns: tuple) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    layers = _layers(turns, _END)
    return _costs(layers[0])[START], _trace(turns, layers, START, True)[0]


def matrix(turns: tuple) -> list[int]:
    """The least cost from each state before the turns to each state behind them, insertions behind the last turn left out; row by row."""
    columns = []
    for q in range(4):
        end = [_UNREACHED] * 4
        end[q] = 0
        columns.append(_costs(_layers(turns, end)[0]))
    return [columns[j][i] for i in range(4) for j in range(4)]


def applied(audit: str, state: int, rows: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], int]:
    """(role, text) of the rows that an audit leaves and inserts, and the state behind."""
    out, at = [], 0
    for edit in audit:
        if edit in "IR":
            state = _after(state, "u") or A
            out.append((ROLES[state], rows[at][1] if edit == "R" else ""))
        elif edit == "K":
            state = _after(state, rows[at][0][:1])
            out.append(rows[at])
        at += edit != "I"
    return out, state


class _Totals:
    """What is counted along a conversation, row by row in order."""

    def __init__(self):
        self.faults, self.illegal, self.cost = [0, 0, 0], 0, 0
        self.turns: tuple | None = None  # first, last, distinct
        self.initial: str | None = None
        self._hash, self._some = hashlib.sha256(), False

    def see(self, turn: int | None, initial: str, fault: int | None) -> None:
        if fault is not None:
            self.faults[fault] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None:
            first, last, distinct = self.turns or (turn, None, 0)
            self.turns = first, turn, distinct + (turn != last)

    def said(self, rows: list[tuple[str, str]]) -> None:
        for role, text in rows:
            self._hash.update(f"{'\n' if self._some else ''}{role}:{text}".encode())
            self._some = True

    def values(self) -> tuple:
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return gaps, *self.faults, self.illegal, self.cost, self._hash.hexdigest()


_FAULTS = {BLANK: 0, "duplicate": 1, TRUNCATED: 2}
_TOTALS = [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("repaired_sha256", pa.string())]
_DONE = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("segment", pa.int32()), ("last", pa.bool_()), ("audit", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), *_TOTALS])
_ROW = [("pos", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.int32())]
_FOLDED = pa.schema([*_DONE, *_ROW, ("open", pa.bool_())])
_DDL = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.string(): "string", pa.list_(pa.string()): "array<string>", pa.list_(pa.int64()): "array<long>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def fault_of(text: Column) -> Column:
    """BLANK without a character other than white space, TRUNCATED if the last one ends no sentence."""
    return F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(FINE)


def _seen(turn: int | None, role: str, fault: int, repeated: bool, totals: _Totals) -> tuple:
    """Counts a row, and returns it as the grammar sees it."""
    first = BLANK if fault == BLANK else "duplicate" if repeated else fault
    totals.see(turn, role[:1], _FAULTS.get(first))
    return BLANK if repeated else fault, role[:1] if role[:1] in "sua" else ""


def _fold(batches, segment_rows: int):
    """Conversations of a sorted partition: done where they are whole and short, else their rows, open."""
    part, known = TaskContext.get().partitionId(), {}
    out, none_done, none_row = [], (None,) * len(_DONE), (None,) * len(_ROW)
    now, held, chars, is_open = None, [], 0, True
    number = pos = segment = 0  # conversations and rows met, segments of this conversation

    def done(conv_id, rows):
        totals, seen, turns = _Totals(), set(), []
        said = [(role, text) for _, _, role, text, _, gone in rows if not gone]
        for _, turn, role, text, fault, gone in rows:
            if not gone:
                turns.append(_seen(turn, role, fault, fault != BLANK and (role, text) in seen, totals))
                seen.add((role, text))
        key = tuple(turns)
        if key not in known:
            if len(known) >= KNOWN:
                known.clear()
            known[key] = solve(key)
        totals.cost, audit = known[key]
        left, _ = applied(audit, START, said)
        totals.said(left)
        return conv_id, part, 0, True, audit, [r for r, _ in left], [t for _, t in left], *totals.values(), *none_row, False

    def opened(conv_id, rows):
        return [(conv_id, part, segment, *none_done[3:], at, turn, role, text, -1 if gone else fault, True) for at, turn, role, text, fault, gone in rows]

    def closed(conv_id, rows):
        out.extend(opened(conv_id, rows) if is_open else [done(conv_id, rows)])

    for batch in batches:
        for conv_id, turn, role, text, fault, gone in zip(*(c.to_pylist() for c in batch.columns)):
            if number == 0 or conv_id != now:
                if number > 0:
                    closed(now, held)
                now, is_open, held, chars, segment = conv_id, number == 0, [], 0, 0
                number += 1
            held.append((pos, turn, role, text, fault, gone))
            pos, chars = pos + 1, chars + len(text)
            if len(held) >= segment_rows or chars >= SEGMENT_CHARS:
                is_open = True
                closed(now, held)
                held, chars, segment = [], 0, segment + 1
        while out:
            yield _batch(out[:1000], _FOLDED)
            del out[:1000]
    is_open = True
    closed(now, held)
    yield _batch(out, _FOLDED)


def in_order(rows: DataFrame, gone: str | None, partition_bytes: int) -> DataFrame:
    """conv_id, turn, role, text, fault and gone, in ranges of conversation and turn of some ``partition_bytes`` in the mean; equal rows may lie in two."""
    rows = columns_of(rows, "conv_id", "turn", "role", "text", *([gone] if gone else []))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-size // partition_bytes))
    text, role = (F.coalesce(c, F.lit(" ")) for c in ("text", "role"))
    plain = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), fault_of(text).cast("int").alias("fault"), (F.col(gone) if gone else F.lit(False)).alias("gone"))
    keyed = plain.withColumn("h", F.xxhash64("role", "text")).withColumn("k", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("h"), F.col("k")]
    return keyed.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).drop("h", "k")


_LISTS = [("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("faults", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int64()))]
_SEGMENT = [("conv_id", pa.int64()), ("part", pa.int32()), ("segment", pa.int32()), ("pos", pa.int64())]
_MEASURED = pa.schema([*_SEGMENT, *_LISTS, ("costs", pa.list_(pa.int64()))])
_BEHIND = pa.schema([("part", pa.int32()), ("pos", pa.int64()), ("behind", pa.list_(pa.int64())), ("last", pa.bool_())])
_TRACED = pa.schema([*_SEGMENT, *_LISTS, ("last", pa.bool_()), ("audits", pa.list_(pa.string())), ("ends", pa.list_(pa.int64())), ("paid", pa.list_(pa.int64()))])


def _by_rows(schema: pa.Schema, row):
    """A function of batches that makes one row of each."""
    return lambda batches: (_batch([row(**r) for r in batch.to_pylist()], schema) for batch in batches)


def _as_seen(roles, faults, firsts) -> tuple:
    """The turns of a segment as the grammar sees them; the fault of a row that is gone is -1."""
    return tuple((BLANK if not first else fault, role[:1] if role[:1] in "sua" else "") for role, fault, first in zip(roles, faults, firsts) if fault >= 0)


def _measure(roles, faults, firsts, **rest) -> tuple:
    return *(rest[n] for n in ("conv_id", "part", "segment", "pos", "turns")), roles, rest["texts"], faults, firsts, matrix(_as_seen(roles, faults, firsts))


def _left_behind(batches):
    """What is left to pay behind each segment, by state; segments of a conversation come last first."""
    now, left, some = None, _END, False
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            new = not some or r["conv_id"] != now
            now, some = r["conv_id"], True
            left = _END if new else left
            out.append((r["part"], r["pos"], list(left), new))
            left = tuple(min(min(r["costs"][4 * i + j] + left[j] for j in range(4)), _UNREACHED) for i in range(4))
        yield _batch(out, _BEHIND)


def _trace_all(roles, faults, firsts, behind, last, **rest) -> tuple:
    """The segment's trace from each state."""
    turns = _as_seen(roles, faults, firsts)
    layers = _layers(turns, behind)
    costs = _costs(layers[0])
    traces = [_trace(turns, layers, q, last) if costs[q] < _UNREACHED else ("", q) for q in range(4)]
    paid = [cost - (0 if last else behind[end]) for cost, (_, end) in zip(costs, traces)]
    return *(rest[n] for n in ("conv_id", "part", "segment", "pos", "turns")), roles, rest["texts"], faults, firsts, last, [t for t, _ in traces], [end for _, end in traces], paid


def _chain(batches):
    """Segments of a conversation in order: each goes on from the state behind the one before."""
    totals, state = _Totals(), START
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            rows = []
            for turn, role, text, fault, first in zip(*(r[n] for n in ("turns", "roles", "texts", "faults", "firsts"))):
                if fault >= 0:
                    _seen(turn, role, fault, not first and fault != BLANK, totals)
                    rows.append((role, text))
            audit, paid = r["audits"][state], r["paid"][state]
            left, end = applied(audit, state, rows)
            totals.cost += paid
            totals.said(left)
            out.append((r["conv_id"], r["part"], r["segment"], r["last"], audit, [x for x, _ in left], [x for _, x in left], *(totals.values() if r["last"] else [None] * len(_TOTALS))))
            state = end
            if r["last"]:
                totals, state = _Totals(), START
        yield _batch(out, _DONE)


def repair(rows: DataFrame, scratch: Scratch, gone: str | None = None, partition_bytes: int = 64 << 20, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The repaired conversations in segments, ordered by part and segment: conv_id, audit, and the repaired roles and texts.

    The last segment of each conversation carries its totals: gaps between turns, rows by their first fault (blank,
    duplicate, truncated), illegal neighbours, cost, and the SHA-256 of all of it (``role:text`` lines).
    ``gone`` names a boolean column of rows that only tell that a conversation exists.
    """
    folded = scratch.cut(in_order(rows, gone, partition_bytes).mapInArrow(lambda b: _fold(b, segment_rows), _ddl(_FOLDED)), "folded", rows_per_batch=1000)
    rest = folded.where("open").select("conv_id", "part", "segment", *[n for n, _ in _ROW])
    heard = rest.where(F.col("fault").isin(FINE, TRUNCATED)).groupBy("conv_id", "role", "text").agg(F.min(F.struct("part", "pos")).alias("at"))
    # a row is the first of its kind or not; the join is by the row's place, so a frequent text doesn't meet itself
    marked = rest.join(heard.select("at.part", "at.pos", F.lit(1).cast("long").alias("first")), ["part", "pos"], "left")
    fault = F.col("fault").cast("long")
    row = F.struct("pos", "turn", "role", "text", fault.alias("fault"), F.when(F.col("fault") == BLANK, 1).otherwise(F.coalesce("first", F.lit(0))).cast("long").alias("first"))
    # at most segment_rows rows each
    each = marked.groupBy("conv_id", "part", "segment").agg(F.array_sort(F.collect_list(row)).alias("r"))
    lists = {"turns": "turn", "roles": "role", "texts": "text", "faults": "fault", "firsts": "first"}
    segments = each.select("conv_id", "part", "segment", F.col("r")[0]["pos"].alias("pos"), *[F.col(f"r.{field}").alias(n) for n, field in lists.items()])
    measured = scratch.cut(segments.mapInArrow(_by_rows(_MEASURED, _measure), _ddl(_MEASURED)), "segments", rows_per_batch=50)
    backwards = [F.col("conv_id"), F.col("part").desc(), F.col("pos").desc()]
    behind = measured.select("conv_id", "part", "pos", "costs").repartition("conv_id").sortWithinPartitions(*backwards).mapInArrow(_left_behind, _ddl(_BEHIND))
    traced = measured.drop("costs").join(behind, ["part", "pos"]).mapInArrow(_by_rows(_TRACED, _trace_all), _ddl(_TRACED))
    chained = traced.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos").mapInArrow(_chain, _ddl(_DONE))
    chained = scratch.cut(chained, "chained", rows_per_batch=50)
    return folded.where("not open").select(_DONE.names).unionByName(chained)


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with faults by a checksum of conv_id and turn: 0 drops a row (``gone``), 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's; nulls count as a space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = columns_of(rows, "conv_id", "turn", "role", "text")
    fate = rows.withColumn("fate", F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20)
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(space("role"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return fate.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") == 0).alias("gone"), copies).drop("copy")


def summaries(segments: DataFrame) -> DataFrame:
    """One row for each conversation: its totals and the audit of all its segments."""
    in_order_ = F.array_sort(F.collect_list(F.struct("part", "segment", "audit")))
    totals = [F.max(n).alias(n) for n, _ in _TOTALS]
    return segments.groupBy("conv_id").agg(*totals, F.array_join(F.transform(in_order_, lambda s: s["audit"]), "").alias("audit"))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return summaries(repair(rows, Scratch(spark), "gone"))
