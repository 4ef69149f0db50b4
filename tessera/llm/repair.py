"""Repair of the structure of conversations: cheapest edits by Dial's bucket queue, the audit by a lexicographic walk along tight arcs.

A conversation is well formed if the initials of its roles read `(s?(ua)+)?`: four states, in which each letter leads to one state at most. A node is a
place between rows and a state. Arcs keep a row (0), give it the role that fits (2), delete it (3) or insert an empty turn of the role that
fits (2); rows that stay although they are cut off cost 1 more, and blank rows and repeats can only be deleted. Costs are small integers,
so distances to the end are found with one bucket for each distance, backwards from the end and no further than the start's distance. The walk then takes,
node by node, the tight arc whose letter comes first: D, I, K, R. As a letter leads to one node, this is the ASCII-least of the cheapest audits.

Rows are taken in order of turn (nulls first), then role and text. Null roles and texts count as one space; rows without conv_id form one
conversation. Equal rows are repeats of each other. An empty table has no edits. Columns other than conv_id, turn, role and text do not matter.

A conversation of ordinary size is repaired in one task. Larger ones (`most`: rows, and KiB of text) are cut into blocks of consecutive rows: each block gives its
4 x 4 distances, these are chained backwards to the distances at its end, the walks of a block from all four states are chained forwards, and with its first
state known each block is repaired on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import small, stage

FAR = 1 << 60
SPACE = " \t\n\v\f\r"
ROLES = {"u": "user", "a": "assistant"}

#: What each state may read, and where that leads: start, after s, after u, after a. The start and after a may be the end.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that fits each state, which can be inserted or given to a row.
FITS = tuple(next((c, t) for c, t in own.items() if c in ROLES) for own in STEPS)
BACK = tuple([(s, c) for s, own in enumerate(STEPS) for c, t in own.items() if t == state] for state in range(4))
END = (0, FAR, FAR, 0)

#: A row as the search sees it: its role's initial, whether it must go, and what it costs more to let it stay.
Row = tuple[str, bool, int]


def distances(rows: list[Row], end: tuple[int, ...] = END, whole: bool = True) -> list[int]:
    """Distance to the end from each node (4 * rows before it + state); end has what lies behind the last row.

    If not whole, only up to the distance of the first node: those beyond it are upper bounds.
    """
    n = len(rows)
    far, settled = [FAR] * (4 * n + 4), bytearray(4 * n + 4)
    least = min(end)
    buckets: list[list[int]] = [[] for _ in range(max((d for d in end if d < FAR), default=least) - least + 4)]
    for state, d in enumerate(end):
        if d < FAR:
            far[4 * n + state] = d - least
            buckets[d - least].append(4 * n + state)
    d = 0
    while d < len(buckets):
        while len(buckets) < d + 4:
            buckets.append([])
        for node in buckets[d]:  # free arcs add to it meanwhile
            if settled[node]:
                continue
            settled[node] = 1
            place, state = divmod(node, 4)
            arcs = [(node - state + s, 2) for s, c in BACK[state] if c in ROLES]
            if place:
                initial, gone, more = rows[place - 1]
                arcs.append((node - 4, 3))
                if not gone:
                    for s, c in BACK[state]:
                        if c == initial:
                            arcs.append((node - state - 4 + s, more))
                        elif c in ROLES:
                            arcs.append((node - state - 4 + s, 2 + more))
            for to, cost in arcs:
                if d + cost < far[to]:
                    far[to] = d + cost
                    buckets[d + cost].append(to)
        if not whole and settled[0] or not any(buckets[d:]):
            break
        buckets[d] = []
        d += 1
    return [x + least if x < FAR else FAR for x in far]


def walk(rows: list[Row], far: list[int], state: int = 0, last: bool = True) -> tuple[str, int]:
    """The ASCII-least letters along tight arcs from a state before the first row, and the state they end in.

    A block that is not the last leaves insertions behind its last row to the next.
    """
    out, node = [], state
    while node < 4 * len(rows) or last and far[node]:
        place, state = divmod(node, 4)
        fitting, to = FITS[state]
        arcs = []
        if place < len(rows):
            initial, gone, more = rows[place]
            arcs.append(("D", 3, node + 4))
            if not gone:
                if initial in STEPS[state]:
                    arcs.append(("K", more, 4 * place + 4 + STEPS[state][initial]))
                arcs.append(("R", 2 + more, 4 * place + 4 + to))
        arcs.append(("I", 2, 4 * place + to))
        letter, _, node = min(a for a in arcs if far[a[2]] + a[1] == far[node])
        out.append(letter)
    return "".join(out), node % 4


FIELDS = "step long, edit string, fault string, was string, role string, text string, cost int"


class Edits:
    """Rows of conv_id, turn and FIELDS, given out in batches."""

    def __init__(self, schema: T.StructType):
        self.names, self.kinds, self.rows = schema.names, [to_arrow_type(f.dataType) for f in schema], []
        self.size = 0

    def add(self, conv_id, first: int, letters: str, state: int, rows: list[tuple], faults: list[str | None]) -> None:
        """The edits of rows (turn, role, text) from a state on; first is the number of edits before them."""
        place = 0
        for step, letter in enumerate(letters, first):
            fitting, to = FITS[state]
            if letter == "I":
                self.rows.append((conv_id, None, step, letter, None, None, ROLES[fitting], "", 2))
                state = to
                continue
            (turn, was, text), fault = rows[place], faults[place]
            place += 1
            late = int(fault == "truncated")
            if letter == "D":
                own = None, None, 3
            elif letter == "R":
                own, state = (ROLES[fitting], text, 2 + late), to
            else:
                own, state = (was, text, late), STEPS[state][was[:1]]
            self.rows.append((conv_id, turn, step, letter, fault, was, *own))
            self.size += len(text)

    def given(self, all_of_them: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (all_of_them or len(self.rows) >= 4096 or self.size > 8 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows, strict=True), self.kinds, strict=True)], names=self.names)
            self.rows, self.size = [], 0


def fault_of(text: str, repeated: bool) -> str | None:
    end = text.rstrip(SPACE)[-1:]
    return "blank" if not end else "duplicate" if repeated else None if end in ".!?" else "truncated"


def searched(roles: list[str], faults: list[str | None]) -> list[Row]:
    return [(role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")) for role, fault in zip(roles, faults, strict=True)]


def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def repaired(turns: DataFrame, most: int = 50_000, block: int = 65_536) -> DataFrame:
    """conv_id, turn, step, edit, fault, was, role, text, cost: the edits of each conversation of turns (conv_id, turn, role, text), in order of step.

    role and text are those of the repaired conversation (null for deleted rows), was is the role before (null for inserted rows). step
    counts a conversation's edits from 0. fault is a row's first fault of blank, duplicate and truncated.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", "turn", space("role"), space("text"))
    schema = T.StructType([rows.schema["conv_id"], rows.schema["turn"], *T.StructType.fromDDL(FIELDS).fields])
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    weight = F.sum(F.lit(1) + F.floor(F.octet_length("text") / 1024))
    large = stage(rows.groupBy("conv_id").agg(weight.alias("weight")).where(F.col("weight") > most), "large")
    total = large.agg(F.sum("weight")).head()[0]

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, own, conv_id = Edits(schema), [], None

        def end() -> None:
            seen: set[tuple[str, str]] = set()
            faults = []
            for _, role, text in own:
                faults.append(fault_of(text, (role, text) in seen))
                seen.add((role, text))
            found = searched([r for _, r, _ in own], faults)
            out.add(conv_id, 0, walk(found, distances(found, whole=False))[0], 0, own, faults)

        for conv, *row in rows_in(batches):
            if own and conv != conv_id:
                end()
                yield from out.given()
                own = []
            conv_id = conv
            own.append(tuple(row))
        if own:
            end()
        yield from out.given(True)

    if total is None:
        return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(repair, schema)
    ids = small(large.select(F.col("conv_id").alias("large_id")))
    is_large = F.col("conv_id").eqNullSafe(F.col("large_id"))
    ordinary = rows.join(ids, is_large, "left_anti").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(repair, schema)
    return ordinary.unionByName(in_blocks(rows.join(ids, is_large, "left_semi"), schema, order, max(1, -(-total // most)), block))


def in_blocks(rows: DataFrame, schema: T.StructType, order: list, partitions: int, block: int) -> DataFrame:
    """repaired for large conversations, cut into blocks of consecutive rows."""
    salted = stage(rows.withColumn("salt", F.rand(7)), "salted")  # equal rows can be told apart, so that they can be dealt out
    placed_schema = T.StructType([*salted.schema.fields[:-1], *T.StructType.fromDDL("part int, place long, block long, digest binary, fault string").fields])
    placed_kinds = [to_arrow_type(f.dataType) for f in placed_schema]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = []
            for conv_id, turn, role, text, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = hashlib.sha256(f"{len(role)} {role}{text}".encode()).digest()
                own.append((conv_id, turn, role, text, part, k, (part << 32) + k // block, digest, fault_of(text, False)))
                k += 1
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own, strict=True), placed_kinds, strict=True)], names=placed_schema.names)

    # A partition's rows are in order, partitions are in order, and a block is a run of rows of a partition.
    sorted_ = salted.repartitionByRange(partitions, *order, "salt").sortWithinPartitions(*order, "salt")
    placed = stage(sorted_.mapInArrow(place, placed_schema), "placed")
    firsts = placed.where("fault is null or fault <> 'blank'").groupBy("conv_id", "digest").agg(F.min(F.struct("part", "place")).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("f_id")) & (F.col("digest") == F.col("f_digest"))
    repeat = (F.col("fault").isNull() | (F.col("fault") != "blank")) & (F.struct("part", "place") > F.col("first"))
    marked = placed.join(firsts.toDF("f_id", "f_digest", "first"), same, "left").select("conv_id", "turn", "role", "text", "place", "block", F.when(repeat, "duplicate").otherwise(F.col("fault")).alias("fault"))
    marked = stage(marked, "marked")
    facts = marked.select("conv_id", "block", "place", F.substring("role", 1, 1).alias("role"), "fault")
    key = T.StructType([schema["conv_id"], T.StructField("block", T.LongType())])
    kinds = [to_arrow_type(f.dataType) for f in key]
    added = lambda ddl: T.StructType([*key.fields, *T.StructType.fromDDL(ddl).fields])

    def ordered(table: pa.Table) -> dict[str, list]:
        return table.sort_by("place").to_pydict()

    def table(own: list[tuple], names: list[str], more: list[pa.DataType]) -> pa.Table:
        columns = zip(*own, strict=True) if own else [()] * len(names)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, [*kinds, *more], strict=True)], names=names)

    def across(own: pa.Table) -> pa.Table:
        """Distances from each state before a block to each state behind it."""
        x = ordered(own)
        found = searched(x["role"], x["fault"])
        to_each = [distances(found, tuple(0 if t == end else FAR for t in range(4)))[:4] for end in range(4)]
        return table([(x["conv_id"][0], x["block"][0], [d for far in to_each for d in far])], ["conv_id", "block", "far"], [pa.list_(pa.int64())])

    def behind(own: pa.Table) -> pa.Table:
        """Distances to a conversation's end from the states behind each of its blocks."""
        x, end, out = own.sort_by([("block", "descending")]).to_pydict(), list(END), []
        for conv_id, b, far in zip(x["conv_id"], x["block"], x["far"], strict=True):
            out.append((conv_id, b, end, not out))
            end = [min(FAR, *(far[4 * t + s] + end[t] for t in range(4))) for s in range(4)]
        return table(out, ["conv_id", "block", "end", "last"], [pa.list_(pa.int64()), pa.bool_()])

    def walks(own: pa.Table, way: pa.Table) -> pa.Table:
        """Where a walk through a block ends, and its number of edits, from each state before it that leads on."""
        x, end, last = ordered(own), tuple(way.column("end")[0].as_py()), way.column("last")[0].as_py()
        found = searched(x["role"], x["fault"])
        far = distances(found, end)
        ways = [walk(found, far, s, last) if far[s] < FAR else ("", 0) for s in range(4)]
        return table([(x["conv_id"][0], x["block"][0], [w[1] for w in ways], [len(w[0]) for w in ways])], ["conv_id", "block", "to", "edits"], [pa.list_(pa.int64())] * 2)

    def starts(own: pa.Table) -> pa.Table:
        """The state before each block of a conversation, and the edits before it."""
        x, state, step, out = own.sort_by("block").to_pydict(), 0, 0, []
        for conv_id, b, to, n in zip(x["conv_id"], x["block"], x["to"], x["edits"], strict=True):
            out.append((conv_id, b, state, step))
            state, step = to[state], step + n[state]
        return table(out, ["conv_id", "block", "state", "step"], [pa.int64()] * 2)

    def edits(own: pa.Table, way: pa.Table) -> pa.Table:
        x, out = ordered(own), Edits(schema)
        end, last, state, step = (way.column(c)[0].as_py() for c in ("end", "last", "state", "step"))
        found = searched(x["role"], x["fault"])
        letters, _ = walk(found, distances(found, tuple(end)), state, last)
        out.add(x["conv_id"][0], step, letters, state, [*zip(x["turn"], x["role"], x["text"], strict=True)], x["fault"])
        return pa.Table.from_batches([*out.given(True)])

    by = ["conv_id", "block"]
    ends = stage(facts.groupBy(*by).applyInArrow(across, added("far array<long>")).groupBy("conv_id").applyInArrow(behind, added("end array<long>, last boolean")), "ends")
    through = facts.groupBy(*by).cogroup(ends.groupBy(*by)).applyInArrow(walks, added("to array<long>, edits array<long>"))
    first = stage(through.groupBy("conv_id").applyInArrow(starts, added("state long, step long")), "starts")
    met = reduce(lambda x, c: x & F.col(f"e.{c}").eqNullSafe(F.col(f"s.{c}")), by, F.lit(True))
    ways = ends.alias("e").join(first.alias("s"), met).select("e.*", "state", "step")
    return marked.groupBy(*by).cogroup(ways.groupBy(*by)).applyInArrow(edits, schema)


def digests(edits: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of repaired's edits.

    SHA-256 takes a text from its start to its end, so a conversation's edits pass through one task, in order, and are not held there.
    """
    out = T.StructType([edits.schema["conv_id"], *T.StructType.fromDDL("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string").fields])
    kinds = [to_arrow_type(f.dataType) for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now: Digest | None = None
        for conv_id, turn, edit, fault, was, role, text, cost in rows_in(batches):
            if now is None or now.conv_id != conv_id:
                if now:
                    done.append(now.row())
                now = Digest(conv_id)
                if len(done) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=out.names)
                    done = []
            now.add(turn, edit, fault, was, role, text, cost)
        if now:
            done.append(now.row())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=out.names)

    rows = edits.repartition("conv_id").sortWithinPartitions("conv_id", "step")
    return rows.select("conv_id", "turn", "edit", "fault", "was", "role", "text", "cost").mapInArrow(run, out)


class Digest:
    def __init__(self, conv_id):
        self.conv_id, self.cost, self.letters, self.illegal = conv_id, 0, bytearray(), 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.before: str | None = None
        self.first = self.turn = None
        self.turns, self.hash, self.some = 0, hashlib.sha256(), False

    def add(self, turn, edit: str, fault: str | None, was: str | None, role: str | None, text: str | None, cost: int) -> None:
        self.letters += edit.encode()
        self.cost += cost
        if fault:
            self.faults[fault] += 1
        if edit != "I":
            if self.before is not None:
                self.illegal += self.before + was[:1] not in ("su", "ua", "au")
            self.before = was[:1]
            if turn is not None and (self.turn is None or turn != self.turn):
                self.first, self.turn, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if role is not None:
            self.hash.update(("\n" * self.some + f"{role}:{text}").encode())
            self.some = True

    def row(self) -> tuple:
        gaps = 0 if self.turn is None else min(self.turn - self.first + 1 - self.turns, (1 << 63) - 1)
        return self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, self.letters.decode(), self.hash.hexdigest()


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of turns with faults by crc32 of `conv_id:turn` (nulls: one space), modulo 20.

    0 drops a row, 1 empties its text, 2 takes its full stops and marks away, 3 repeats it, 4 gives it the role user. Null roles and texts become one space.
    """
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), how.alias("how")).where("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy"))
    return rows.drop("copy")


def audited(turns: DataFrame) -> DataFrame:
    """digests of the repaired conversations of damaged turns, and a row of zeros for each conversation that damage leaves no row of."""
    found = digests(repaired(damaged(turns)))
    ids = turns.select(F.col("conv_id").alias("id")).distinct()
    rows = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
