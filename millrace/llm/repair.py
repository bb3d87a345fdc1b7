"""Conversation structure repair by weighted interval parsing (CYK with minimum cells).

The role initials of a repaired conversation must match ``(s?(ua)+)?``. Its automaton has the states START, SYSTEM, USER and
ASSISTANT; the repair grammar in Chomsky normal form has one nonterminal X[p,q] for every two states, which derives the edits
that lead from p to q:

    X[p,q] -> X[p,r] X[r,q]      two neighbouring spans
    X[p,q] -> a row              kept or reroled, if its initial leads from p to q
    X[p,p] -> a row              deleted
    X[p,q] -> nothing            inserted rows only; this closure stands on both sides of every row

A cell holds, for each X[p,q] that derives its span, the minimum of (cost, audit), the audit being the initials of the edits.
Cells are combined bottom-up by span length (1, 2, 4, ...). X[p,q] takes every state r between two spans, so all splits of a span
give the same cell and one split for each span is enough; this makes the work linear and lets spans of one conversation
be parsed by different tasks. (cost, audit) minima may be concatenated because an insertion costs more than nothing: audits of
equal cost over the same rows are never proper prefixes of each other.

A conversation within ``LONG_ROWS`` rows and ``LONG_BYTES`` bytes is one chunk, parsed by one call. Rows of a longer one are dealt by ranges of its
order and parsed in chunks; only their cells meet in one place, and the chosen states go back to the chunks. Its digest is the one
thing that reads its repaired lines in order, as a stream.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordered import join_on, skew_join

from .common import id_type, picked, written

LONG_ROWS = 1_024
LONG_BYTES = 1 << 18
#: Characters between words.
SPACE = " \t\n\x0b\x0c\r"

START, SYSTEM, USER, ASSISTANT = range(4)
#: Initial -> the states it leads from and to.
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
DONE = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}

Cell = dict[tuple[int, int], tuple[int, str]]


class Costs(NamedTuple):
    """Costs of the edits; keeping costs nothing. ``truncated`` is added for a truncated row that is not deleted. An insertion
    must cost more than nothing."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Kind(NamedTuple):
    """All that the grammar knows of a row: its role's initial, and ``gone`` (must be deleted), ``cut`` (truncated) or ``fine``."""

    initial: str
    state: str


def _least(cell: Cell, at: tuple[int, int], cost: int, audit: str) -> None:
    if at not in cell or (cost, audit) < cell[at]:
        cell[at] = (cost, audit)


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: Cell = {}
    for (p, r), (c, a) in left.items():
        for (s, q), (d, b) in right.items():
            if r == s and ((p, q) not in out or c + d <= out[p, q][0]):
                _least(out, (p, q), c + d, a + b)
    return out


@lru_cache(maxsize=64)
def inserted(costs: Costs) -> Cell:
    """The insertion closure: the cheapest ways from state to state by inserted rows alone."""
    if costs.insert <= 0:
        raise ValueError("an insertion must cost more than nothing")
    step: Cell = {(p, p): (0, "") for p in range(4)}
    for to in ROLES:
        for p, q in MOVES[to].items():
            _least(step, (p, q), costs.insert, "I")
    out = step
    for _ in range(4):
        out = joined(out, step)
    return out


@lru_cache(maxsize=4096)
def row_cell(kind: Kind, costs: Costs) -> Cell:
    """The cell of one row."""
    own: Cell = {(p, p): (costs.delete, "D") for p in range(4)}
    if kind.state != "gone":
        extra = costs.truncated if kind.state == "cut" else 0
        for p, q in MOVES.get(kind.initial, {}).items():
            _least(own, (p, q), extra, "K")
        for to in ROLES:
            for p, q in MOVES[to].items():
                _least(own, (p, q), extra + costs.rerole, "R")
    return joined(joined(inserted(costs), own), inserted(costs))


@lru_cache(maxsize=1 << 15)
def _short(kinds: tuple[Kind, ...], costs: Costs) -> Cell:
    if len(kinds) == 1:
        return row_cell(kinds[0], costs)
    half = len(kinds) // 2
    return joined(_short(kinds[:half], costs), _short(kinds[half:], costs))


#: Spans up to this length are remembered by their kinds.
REMEMBERED = 4


def span_cell(kinds: list[Kind], costs: Costs = Costs()) -> Cell:
    """The cell of a run of rows, combined bottom-up by span length."""
    cells = [_short(tuple(kinds[k : k + REMEMBERED]), costs) for k in range(0, len(kinds), REMEMBERED)]
    while len(cells) > 1:
        cells = [joined(cells[k], cells[k + 1]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    return cells[0] if cells else inserted(costs)


def best(cell: Cell) -> tuple[int, str, int]:
    """(cost, audit, last state) of the cheapest repair of a whole conversation."""
    return min((*cell[START, q], q) for q in DONE if (START, q) in cell)


def choose(cells: list[Cell]) -> tuple[int, str, list[tuple[int, int]]]:
    """Cost and audit of a conversation from the cells of its chunks, and for each chunk the two states chosen for it.

    Audits of inner spans are dropped as soon as the longer span is known; only the states between two spans are remembered.
    """
    levels: list[list[dict]] = []
    while len(cells) > 1:
        made, between = [], []
        for k in range(0, len(cells) - 1, 2):
            out: Cell = {}
            via: dict[tuple[int, int], int] = {}
            for (p, r), (c, a) in cells[k].items():
                for (s, q), (d, b) in cells[k + 1].items():
                    if r == s and ((p, q) not in out or c + d <= out[p, q][0]) and ((p, q) not in out or (c + d, a + b) < out[p, q]):
                        out[p, q], via[p, q] = (c + d, a + b), r
            made.append(out)
            between.append(via)
        if len(cells) % 2:
            made.append(cells[-1])
        levels.append(between)
        cells = made
    cost, audit, last = best(cells[0])
    states = [(START, last)]
    for between in reversed(levels):
        parts = []
        for k, (p, q) in enumerate(states):
            parts += [(p, r := between[k][p, q]), (r, q)] if k < len(between) else [(p, q)]
        states = parts
    return cost, audit, states


def lines(rows: list[tuple[str, str]], audit: str, state: int = START) -> list[tuple[str, str]]:
    """Repaired (role, text) of rows under an audit. Roles of inserted and reroled rows follow from the state."""
    out, at = [], 0
    for edit in audit:
        role, text = (None, "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else "a" if state == USER else "u"
        state = MOVES[initial][state]
        out.append((role if edit == "K" else ROLES[initial], text))
    return out


def state_of(text: str) -> str:
    """``blank``, ``cut`` or ``fine``, without regard to other rows."""
    end = text.rstrip(SPACE)
    return "blank" if not end else "fine" if end[-1] in ".!?" else "cut"


def _digest(parts: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{r}:{t}" for r, t in parts).encode("utf-8", "replace")


# rows of conversations


def damaged(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, n): rows with planted damage, ``n`` the number of times the row now stands (0: dropped).

    crc32 of ``conv:turn`` modulo 20 decides: 0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it a
    user's. NULLs read as one space (in ``turn`` only for the decision: it stays NULL and sorts first).
    """
    rows = picked(table, conv_col, turn_col, role_col, text_col).toDF("conv", "turn", "role", "text")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), times.cast("long").alias("n"))


def _short_chunks(rows: DataFrame) -> DataFrame:
    """One chunk for each conversation; its rows sorted by turn (NULL first), role and text."""
    listed = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "n"))).alias("rows"))
    return listed.select("conv", F.lit(0).alias("part"), F.lit(0).alias("no"), F.lit(True).alias("whole"), F.transform("rows", lambda r: F.struct(r.turn, r.role, r.text, r.n, F.lit(None).cast("boolean").alias("seen"))).alias("rows"))


def _long_chunks(rows: DataFrame, chunk_rows: int, chunk_bytes: int) -> DataFrame:
    """Chunks of conversations of any length. Identical rows are one row with a count before anything is dealt; what was seen
    earlier is found by the first place of each (role, text)."""
    one = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = one.where("n > 0").groupBy("conv", "role", "text").agg(F.min(place).alias("_first"))
    known = skew_join(one, first, ["conv", "role", "text"]).select("conv", "turn", "role", "text", "n", F.coalesce(F.col("_first") < place, F.lit(False)).alias("seen"))
    sorted_rows = known.repartitionByRange("conv", "turn", "role", "text").sortWithinPartitions("conv", "turn", "role", "text")
    kind = known.schema
    out = f"conv {kind['conv'].dataType.simpleString()}, part int, no int, whole boolean, rows array<struct<turn:{kind['turn'].dataType.simpleString()},role:string,text:string,n:bigint,seen:boolean>>"

    def run(batches):
        from pyspark import TaskContext

        part, held, weight, no, owner, schema = TaskContext.get().partitionId(), [], 0, 0, None, None

        def chunk():
            return pa.RecordBatch.from_arrays([pa.array([owner[0]], schema.field("conv").type), pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([False]), pa.array([held], pa.list_(pa.struct([schema.field(c) for c in ("turn", "role", "text", "n", "seen")])))], ["conv", "part", "no", "whole", "rows"])

        for batch in batches:
            schema = batch.schema
            for r in batch.to_pylist():
                conv = (r.pop("conv"),)
                size = len(r["text"]) + len(r["role"]) + 16
                if held and (conv != owner or len(held) >= chunk_rows or weight + size > chunk_bytes):
                    yield chunk()
                    no, held, weight = no + 1, [], 0
                owner, weight = conv, weight + size
                held.append(r)
        if held:
            yield chunk()

    return sorted_rows.mapInArrow(run, out)


def chunks(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """(conv, part, no, whole, rows): all conversations in chunks, stored. ``whole`` chunks hold a conversation alone; the others
    follow each other by (part, no)."""
    size = F.octet_length("text") + F.octet_length("role") + 16
    sizes = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"))
    long = written(sizes.where((F.col("rows") > long_rows) | (F.col("bytes") > long_bytes)).select("conv"), "repair-long")
    if long.isEmpty():
        return written(_short_chunks(rows), "repair-chunks")
    short = _short_chunks(join_on(rows, long, ["conv"], "left_anti"))
    return written(short.unionByName(_long_chunks(join_on(rows, long, ["conv"], "left_semi"), long_rows, long_bytes)), "repair-chunks")


class Seen(NamedTuple):
    """A chunk spelled out: rows, their kinds, and the counts of faults."""

    rows: list[tuple[str, str]]
    kinds: list[Kind]
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    turns: list


def looked_at(listed: list[dict]) -> Seen:
    """First fault of every row of a chunk. Rows of a long conversation know whether they were seen before."""
    rows, kinds, turns, seen = [], [], [], set()
    count = {"blank": 0, "duplicate": 0, "cut": 0, "fine": 0}
    for r in listed:
        row = (r["role"], r["text"])
        for k in range(r["n"]):
            state = state_of(r["text"])
            if state != "blank" and (k > 0 or r["seen"] or row in seen):
                state = "duplicate"
            seen.add(row)
            count[state] += 1
            rows.append(row)
            kinds.append(Kind(r["role"][:1], "gone" if state in ("blank", "duplicate") else state))
            turns.append(r["turn"])
    illegal = sum(a.initial + b.initial not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
    return Seen(rows, kinds, count["blank"], count["duplicate"], count["cut"], illegal, turns)


def _gaps(turns: list) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _whole_reports(whole: DataFrame, costs: Costs) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                s = looked_at(r["rows"])
                cost, audit, _ = best(span_cell(s.kinds, costs))
                out.append((_gaps(s.turns), s.blank, s.duplicate, s.truncated, s.illegal, cost, audit, hashlib.sha256(_digest(lines(s.rows, audit))).hexdigest()))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("conv"), *[pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 8, kinds)]], ["conv", *[x.split()[0] for x in REPORT.split(", ")]])

    return whole.select("conv", "rows").mapInArrow(run, f"conv {id_type(whole, 'conv')}, {REPORT}")


def _chunk_cells(parts: DataFrame, costs: Costs) -> DataFrame:
    """(conv, part, no, blank, duplicate, truncated, illegal, first, last, cell) of chunks of long conversations; ``first`` and ``last``
    are the initials at its ends, NULL if no row is left."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.select(["rows"]).to_pylist():
                s = looked_at(r["rows"])
                ends = (s.kinds[0].initial, s.kinds[-1].initial) if s.kinds else (None, None)
                out.append((s.blank, s.duplicate, s.truncated, s.illegal, *ends, json.dumps([[*k, *v] for k, v in span_cell(s.kinds, costs).items()])))
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            made = [pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 7, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("part"), batch.column("no"), *made], ["conv", "part", "no", "blank", "duplicate", "truncated", "illegal", "first", "last", "cell"])

    return parts.select("conv", "part", "no", "rows").mapInArrow(run, f"conv {id_type(parts, 'conv')}, part int, no int, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, cell string")


def _chosen(cells: DataFrame) -> DataFrame:
    """Per chunk of a long conversation the states (p, q) chosen for it; the first chunk also carries the conversation's cost, audit
    and number of illegal pairs between chunks. A task holds the cells of one conversation: some ten bytes for each row."""
    conv = id_type(cells, "conv")
    out = f"conv {conv}, part int, no int, p int, q int, cost bigint, audit string, between bigint"

    def run(frame):
        frame = frame.sort_values(["part", "no"])
        cost, audit, states = choose([{(p, q): (c, a) for p, q, c, a in json.loads(x)} for x in frame["cell"]])
        ends = [(a, b) for a, b in zip(frame["first"], frame["last"]) if isinstance(a, str)]
        between = sum(a[1] + b[0] not in ("su", "ua", "au") for a, b in zip(ends, ends[1:]))
        frame = frame[["conv", "part", "no"]].assign(p=[s[0] for s in states], q=[s[1] for s in states])
        first = [k == 0 for k in range(len(frame))]
        return frame.assign(cost=[cost if f else None for f in first], audit=[audit if f else None for f in first], between=[between if f else None for f in first])

    return cells.select("conv", "part", "no", "first", "last", "cell").groupBy("conv").applyInPandas(run, out)


def _chunk_lines(parts: DataFrame, chosen: DataFrame, costs: Costs) -> DataFrame:
    """(conv, part, no, lines): the repaired rows of every chunk of long conversations."""
    states = chosen.select("conv", "part", "no", "p", "q")
    both = join_on(parts.select("conv", "part", "no", "rows"), states, ["conv", "part", "no"])
    item = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.select(["rows", "p", "q"]).to_pylist():
                s = looked_at(r["rows"])
                audit = span_cell(s.kinds, costs)[r["p"], r["q"]][1]
                out.append([{"role": a, "text": b} for a, b in lines(s.rows, audit, r["p"])])
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("part"), batch.column("no"), pa.array(out, item)], ["conv", "part", "no", "lines"])

    return both.mapInArrow(run, f"conv {id_type(parts, 'conv')}, part int, no int, lines array<struct<role:string,text:string>>")


def _long_digests(said: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): the lines of a conversation go through one hash in their order, chunk by chunk."""
    conv = id_type(said, "conv")
    ordered = said.repartition("conv").sortWithinPartitions("conv", "part", "no")

    def run(batches):
        owner, state, empty, kind = None, None, True, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([owner[0]], kind), pa.array([state.hexdigest()])], ["conv", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field("conv").type
            for r in batch.to_pylist():
                if (r["conv"],) != owner:
                    if owner:
                        yield done()
                    owner, state, empty = (r["conv"],), hashlib.sha256(), True
                if r["lines"]:
                    state.update((b"" if empty else b"\n") + _digest([(x["role"], x["text"]) for x in r["lines"]]))
                    empty = False
        if owner:
            yield done()

    return ordered.mapInArrow(run, f"conv {conv}, repaired_sha256 string")


def _long_reports(parts: DataFrame, costs: Costs) -> DataFrame:
    cells = written(_chunk_cells(parts, costs), "repair-cells")
    chosen = written(_chosen(cells), "repair-chosen")
    counts = cells.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    turns = parts.select("conv", F.explode("rows").alias("r")).where("r.n > 0 and r.turn is not null").select("conv", "r.turn").distinct()
    spread = turns.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    out = join_on(chosen.where("cost is not null").select("conv", "cost", "audit", "between"), counts, ["conv"])
    out = join_on(join_on(out, spread, ["conv"]), _long_digests(_chunk_lines(parts, chosen, costs)), ["conv"])
    return out.select("conv", F.coalesce("gaps", F.lit(0)).cast("bigint").alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + F.col("between")).alias("illegal"), "cost", "audit", "repaired_sha256")


def reports(parts: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conversation of ``chunks``.

    Rows are ordered by turn, NULL first; rows of one turn by role and text, copies side by side. The first fault of a row counts:
    blank, then duplicate (role and text seen earlier), then truncated. A role that is empty or starts with another letter
    than s, u, a cannot be kept. Conversations with NULL ids are one conversation. One without rows left has zeros, an empty audit
    and the hash of the empty string. No rows give no rows.
    """
    out = _whole_reports(parts.where("whole"), costs)
    long = parts.where("not whole")
    return out if long.isEmpty() else out.unionByName(_long_reports(long, costs))


def repaired(parts: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(conv, at, role, text): the repaired rows of all conversations of ``chunks``, numbered from 0 within each."""

    def run(batches):
        item = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            out = []
            for r in batch.select(["rows"]).to_pylist():
                s = looked_at(r["rows"])
                out.append([{"role": a, "text": b} for a, b in lines(s.rows, best(span_cell(s.kinds, costs))[1])])
            zeros = pa.array([0] * len(out), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("conv"), zeros, zeros, pa.array(out, item)], ["conv", "part", "no", "lines"])

    conv = id_type(parts, "conv")
    said = parts.where("whole").select("conv", "rows").mapInArrow(run, f"conv {conv}, part int, no int, lines array<struct<role:string,text:string>>")
    long = parts.where("not whole")
    if not long.isEmpty():
        said = said.unionByName(_chunk_lines(long, written(_chosen(_chunk_cells(long, costs)), "repair-chosen"), costs))
    # one row for each chunk: its number of lines before
    before = Window.partitionBy("conv").orderBy("part", "no").rowsBetween(Window.unboundedPreceding, -1)
    sizes = said.select("conv", "part", "no", F.size("lines").alias("k")).select("conv", "part", "no", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("_base"))
    placed = join_on(said, sizes, ["conv", "part", "no"])
    return placed.select("conv", "_base", F.posexplode("lines").alias("at", "line")).select("conv", (F.col("_base") + F.col("at")).alias("at"), "line.role", "line.text")


def op13(spark, table: DataFrame) -> DataFrame:
    """The report of every conversation after the planted damage, under the default costs."""
    return reports(chunks(damaged(table))).withColumnRenamed("conv", "conv_id")

