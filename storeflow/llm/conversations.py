"""Conversation structure repair.

A conversation should run ``(s?(ua)+)?`` by the initials of its roles: a
system row or none, then user and assistant in turn, or nothing at all. Its
rows are taken by turn (nulls first; rows of one turn by role and by the
SHA-256 of role and text). A row's first fault counts: blank, duplicate
(role and text were seen earlier in the conversation), truncated (the last
character that is no white space is not one of ``. ! ?``). Edits: keep (0),
rerole to user or assistant (1), delete (2; blank and duplicate rows must
go), insert an empty row of user or assistant anywhere (5); a truncated row
that stays adds 5. The audit has the initials of the cheapest edits in order
(D, I, K, R), the least string of equally cheap ones.

Method: cost DP, then path ranking by prefix doubling.

* Nodes are (row, state): nothing yet, after system, user or assistant. A
  row is a 4 x 4 matrix of least costs between states, so costs to the end
  are suffix products of matrices (sum and minimum), taken by doubling.
* Arcs that keep the least cost to the end are optimal. A node's state says
  which role follows, so its optimal arcs have different letters and the
  least audit of any length begins with one arc. Nodes are ranked by the
  least audits of 1, 2, 4, .. letters: the rank of a doubled length is that
  of the pair (own rank, rank of the node that the pointer reaches), and the
  pointer of a doubled length is the pointer's pointer. Each node takes the
  arc least by letter and by the rank that it leads to; positions of a path
  are read off the doubled pointers, all at once.

Scale. Equal rows of one turn are one row with a count (all but the first
are duplicates and go, a run of D). Rows are numbered by a range-partitioned
sort and cut into pieces of at most ``PIECE`` rows; a conversation that lies
in several pieces gives one matrix for each, these are combined (at most two
per piece), and the pieces are worked on with the costs behind them, for each
state that a path may enter in; the entered states are then followed through.
So a conversation of any length is shared out. Only its text digest is made in
one task, as a stream: SHA-256 takes its bytes in order.

Nulls: a null role or text is one space (so such a text is blank), a null
turn sorts first and takes no part in gaps, rows of a null conv_id are one
conversation. Empty and very long texts are rows like others; a row whose
role is empty or of another initial cannot be kept as it is; ``gaps`` is null
where it passes 64 bits; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import sorted_blocks
from .byte_bpe import ragged
from .stages import Stage, with_package

#: Rows of a piece, as a power of two.
PIECE_BITS = 16
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
RUN_OUT = " \t\n\x0b\x0c\r"

# ---- states and costs -------------------------------------------------------

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
LETTERS = "DIKR"
INSERT = 5
FAR = 1 << 60
#: The state after a row that is inserted or reroled.
_NEXT = np.array([USER, USER, ASSISTANT, USER])
#: The state after a row that is kept, by its initial (s, u, a, other); -1: not possible.
_KEEP = np.full((4, 4), -1)
_KEEP[NOTHING, 0] = SYSTEM
_KEEP[[NOTHING, SYSTEM, ASSISTANT], 1] = USER
_KEEP[USER, 2] = ASSISTANT


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 4 x 4 cost matrices."""
    out = a[:, :, 0, None] + b[:, 0, None, :]
    for k in range(1, 4):
        np.minimum(out, a[:, :, k, None] + b[:, k, None, :], out=out)
    return np.minimum(out, FAR, out=out)


def _insertions() -> np.ndarray:
    cost = np.full((4, 4), FAR)
    for s in range(4):
        cost[s, s], cost[s, _NEXT[s]] = 0, INSERT
        cost[s, _NEXT[_NEXT[s]]] = min(cost[s, _NEXT[_NEXT[s]]], 2 * INSERT)
    return cost


_INSERTIONS = _insertions()
#: Least cost from each state to an end without further rows.
_END = np.minimum(_INSERTIONS[:, NOTHING], _INSERTIONS[:, ASSISTANT])


class Steps:
    """The rows of some segments (each a run of rows of one conversation) as
    steps: one per row, and one for the equal rows that follow it."""

    def __init__(self, first: np.ndarray, initial: np.ndarray, fault: np.ndarray, n: np.ndarray):
        rows = len(initial)
        size = 1 + (n > 1)
        begin = np.cumsum(size) - size
        self.row = np.repeat(np.arange(rows), size)
        again = np.arange(len(self.row)) != begin[self.row]
        must_go = again | (fault[self.row] == BLANK) | (fault[self.row] == DUPLICATE)
        stays = np.where(fault[self.row] == TRUNCATED, 5, 0)
        self.of_row = begin
        self.initial = initial[self.row]
        self.delete = np.where(again, 2 * (n[self.row] - 1), 2)
        self.keep, self.rerole = np.where(must_go, FAR, stays), np.where(must_go, FAR, stays + 1)
        self.segment = np.searchsorted(first, self.row, "right") - 1
        self.first = begin[first]
        self.end = np.append(self.first[1:], len(self.row))

    def matrices(self) -> np.ndarray:
        n = len(self.row)
        m = np.full((n, 4, 4), FAR)
        for s in range(4):
            m[:, s, _NEXT[s]] = self.rerole
            kept = _KEEP[s][self.initial]
            ok = np.flatnonzero(kept >= 0)
            m[ok, s, kept[ok]] = np.minimum(m[ok, s, kept[ok]], self.keep[ok])
            m[:, s, s] = np.minimum(m[:, s, s], self.delete)
        return min_plus(np.broadcast_to(_INSERTIONS, m.shape), m)

    def to_end(self) -> np.ndarray:
        """For each step, the product of the matrices from it to its segment's end."""
        p, last, step = self.matrices(), self.end[self.segment] - 1, 1
        while True:
            more = np.flatnonzero(np.arange(len(p)) + step <= last)
            if not len(more):
                return p
            p[more] = min_plus(p[more], p[more + step])
            step *= 2


# ---- ranked paths -----------------------------------------------------------

def ranked_paths(ok: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Least paths over the arcs ``ok`` of each letter and node, which lead to
    ``target``; nodes without arcs are ends. (letter of each node's arc, -1 at
    ends; rank of each node; pointers over 1, 2, 4, .. letters; letters to the end.)"""
    nodes = np.arange(ok.shape[1])
    goes = ok.any(axis=0)
    letter = np.where(goes, ok.argmax(axis=0), -1)
    rank, length = letter + 1, goes.astype(np.int64)
    pointer = np.where(goes, target[letter, nodes], nodes)
    jumps = [pointer]
    while (pointer[pointer] != pointer).any():
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[pointer], return_inverse=True)[1]
        length = length + length[pointer]
        pointer = pointer[pointer]
        jumps.append(pointer)
    by = np.where(ok, np.arange(len(ok))[:, None] * (int(rank.max(initial=0)) + 1) + rank[target], np.iinfo(np.int64).max)
    return np.where(goes, by.argmin(axis=0), -1), rank, jumps, length


def read_paths(roots: np.ndarray, jumps: list[np.ndarray], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) of every node that the paths from ``roots`` leave, in order."""
    n = length[roots]
    which = np.repeat(np.arange(len(roots)), n)
    at, node = ragged(np.zeros(len(roots), np.int64), n), roots[which]
    for k, jump in enumerate(jumps):
        some = (at >> k & 1).astype(bool)
        node[some] = jump[node[some]]
    return which, node


# ---- rows -------------------------------------------------------------------

def conversation() -> Column:
    """conv_id as text; a null one as a space."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))


def distinct_rows(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text and the number n of equal rows (``times`` where
    the table has that column), with the digest d of role and text, the role's
    initial and the fault that a row has by itself."""
    times = F.col("times").cast("bigint") if "times" in rows.columns else F.lit(1).cast("bigint")
    told = rows.select(conversation().alias("conv"), F.col("turn").cast("bigint").alias("turn"),
                       F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"), times.alias("n"))
    told = told.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    shown = F.rtrim("text", F.lit(RUN_OUT))
    initial = F.left("role", F.lit(1))
    return (told.withColumn("d", F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
                .withColumn("initial", F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3))
                .withColumn("fault", F.when(shown == "", BLANK).when(F.right(shown, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATED)))


def numbered(texts: DataFrame) -> DataFrame:
    """The rows in order, without their texts: ``at`` rises along each
    conversation, ``piece`` holds 2 ** PIECE_BITS consecutive numbers."""
    narrow = texts.select("conv", "turn", "role", "d", "n", "initial", "fault")
    return (sorted_blocks(narrow, ["conv"], ["turn", "role", "d"])
            .withColumnRenamed("_mid", "at").withColumn("piece", F.shiftright("at", PIECE_BITS)).drop("_blk"))


def with_duplicates(rows: DataFrame) -> DataFrame:
    """Rows whose role and text came earlier in the conversation are duplicates."""
    first = rows.groupBy("conv", "d").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    seen = F.coalesce(F.col("_first") < F.col("at"), F.lit(False)) & (F.col("fault") != BLANK)
    return rows.join(first, ["conv", "d"], "left").withColumn("fault", F.when(seen, DUPLICATE).otherwise(F.col("fault"))).drop("_first")


# ---- pieces -----------------------------------------------------------------

def _pieces(batches) -> Iterator[pa.Table]:
    """The rows of one piece at a time; a partition has whole pieces, in order."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        piece = batch.column("piece").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)]
        for a, b in zip(cuts, cuts[1:]):
            if held and piece[a] != now:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            now = piece[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _numbers(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows.column(c).to_numpy().astype(np.int64) for c in names]


def _segments(rows: pa.Table) -> np.ndarray:
    """First rows of the conversations of a piece."""
    codes = pc.dictionary_encode(rows.column("conv")).combine_chunks()
    return np.flatnonzero(np.diff(codes.indices.to_numpy(zero_copy_only=False), prepend=-1))


def edge_matrices(rows: DataFrame) -> DataFrame:
    """(conv, piece, matrix) of the first and last conversation of each piece:
    only these may lie in other pieces too."""
    def run(batches):
        for table in _pieces(batches):
            first = _segments(table)
            bounds = np.append(first, table.num_rows)
            for k in sorted({0, len(first) - 1}):
                part = table.slice(bounds[k], bounds[k + 1] - bounds[k])
                steps = Steps(np.zeros(1, np.int64), *_numbers(part, "initial", "fault", "n"))
                whole = steps.to_end()[0].ravel().tolist()
                yield pa.RecordBatch.from_arrays([part.column("conv").chunk(0).slice(0, 1), pa.array([part.column("piece")[0].as_py()]), pa.array([whole], pa.list_(pa.int64()))],
                                                 names=["conv", "piece", "matrix"])

    return (rows.select("piece", "at", "conv", "initial", "fault", "n").repartition("piece").sortWithinPartitions("piece", "at")
                .mapInArrow(run, "conv string, piece bigint, matrix array<bigint>"))


def _behind(table: pa.Table) -> pa.Table:
    """Costs behind each piece of one conversation."""
    order = np.argsort(table.column("piece").to_numpy())
    matrix = [np.array(table.column("matrix")[int(k)].as_py(), np.int64).reshape(1, 4, 4) for k in order]
    cost, exits = _END, []
    for m in reversed(matrix):
        exits.append(cost.tolist())
        cost = (m[0] + cost).min(axis=1)
    n = len(order)
    return pa.table([table.column("conv"), table.column("piece").take(pa.array(order)), pa.array(exits[::-1], pa.list_(pa.int64())),
                     pa.array([k == 0 for k in range(n)]), pa.array([k == n - 1 for k in range(n)])], names=["conv", "piece", "exit", "first", "final"])


_EDITED = ("conv string, turn bigint, role string, d string, n bigint, fault int, piece bigint, before int, op string, to int, after int, "
           "entry int, left int, cost bigint, part boolean")


def piece_edits(rows: DataFrame, behind: DataFrame) -> DataFrame:
    """Every row with its edit; conversations of several pieces once for each
    state that their path may be in when it enters the piece."""
    def run(batches):
        for table in _pieces(batches):
            told = pc.equal(table.column("at"), -1)
            marks = {r["conv"]: r for r in table.filter(told).select(["conv", "exit", "first", "final"]).to_pylist()}
            table = table.filter(pc.invert(told)).combine_chunks()
            first = _segments(table)
            count = len(first)
            exits, is_first, is_final = np.tile(_END, (count, 1)), np.ones(count, bool), np.ones(count, bool)
            for k in {0, count - 1} if marks else ():
                if mark := marks.get(table.column("conv")[int(first[k])].as_py()):
                    exits[k], is_first[k], is_final[k] = mark["exit"], mark["first"], mark["final"]
            yield from _edited(table, first, exits, is_first, is_final)

    both = rows.unionByName(behind.withColumn("at", F.lit(-1).cast("bigint")), allowMissingColumns=True)
    return both.repartition("piece").sortWithinPartitions("piece", "at").mapInArrow(run, _EDITED)


def _edited(table: pa.Table, first: np.ndarray, exits: np.ndarray, is_first: np.ndarray, is_final: np.ndarray) -> Iterator[pa.RecordBatch]:
    initial, fault, n = _numbers(table, "initial", "fault", "n")
    steps = Steps(first, initial, fault, n)
    count, size = len(first), len(steps.row)
    # a boundary before each step, and one at the end of each segment
    here, ends = np.arange(size) + steps.segment, steps.end + np.arange(count)
    states = np.arange(4)
    cost = np.empty((size + count, 4), np.int64)
    cost[here] = (steps.to_end() + exits[steps.segment][:, None, :]).min(axis=2)
    cost[ends] = exits
    arc, target = np.full((4, size + count, 4), FAR), np.zeros((4, size + count, 4), np.int64)
    node = 4 * np.arange(size + count)[:, None]
    kept = _KEEP[:, steps.initial].T
    arc[0, here], target[0, here] = steps.delete[:, None], node[here] + 4 + states
    arc[1, here], target[1] = INSERT, node + _NEXT
    arc[1, ends[is_final]] = INSERT
    arc[2, here], target[2, here] = np.where(kept >= 0, steps.keep[:, None], FAR), node[here] + 4 + np.maximum(kept, 0)
    arc[3, here], target[3, here] = steps.rerole[:, None], node[here] + 4 + _NEXT
    arc, target, flat = arc.reshape(4, -1), target.reshape(4, -1), cost.ravel()
    ok = (arc < FAR) & (arc + flat[target] == flat)
    letter, _, jumps, length = ranked_paths(ok, target)

    entries = np.where(is_first, 1, 4)
    segment = np.repeat(np.arange(count), entries)
    entry = ragged(np.zeros(count, np.int64), entries)
    roots = 4 * (steps.first[segment] + segment) + entry
    which, path = read_paths(roots, jumps, length)
    boundary, state, letter = path // 4, path % 4, letter[path]
    own = segment[which]
    at_end = boundary == ends[own]
    # each root's steps lie one after the other
    sizes = (steps.end - steps.first)[segment]
    base = np.cumsum(sizes) - sizes
    place = base[which] + boundary - own - steps.first[own]
    op, to, before = (np.zeros(int(sizes.sum()), np.int64) for _ in range(3))
    does = letter != 1
    op[place[does]] = letter[does]
    again = letter == 3
    to[place[again]] = _NEXT[state[again]]
    role_bit = np.where(_NEXT[state] == USER, 1, 2)
    some = (letter == 1) & ~at_end
    np.bitwise_or.at(before, place[some], role_bit[some])
    after_end = np.zeros(len(roots), np.int64)
    some = (letter == 1) & at_end
    np.bitwise_or.at(after_end, which[some], role_bit[some])
    # the first step of each row; the run behind it always goes
    row_first, row_end = first, np.append(first[1:], table.num_rows)
    rows_of = (row_end - row_first)[segment]
    row = ragged(row_first[segment], rows_of)
    root = np.repeat(np.arange(len(roots)), rows_of)
    step = base[root] + steps.of_row[row] - steps.first[segment[root]]
    head, tail = row == row_first[segment[root]], row == row_end[segment[root]] - 1
    part = ~(is_first & is_final)
    left, start = jumps[-1][roots] % 4, flat[roots]
    none = lambda values, keep: pa.array(values, mask=~keep)
    out = table.take(pa.array(row))
    columns = [out.column(c).combine_chunks() for c in ("conv", "turn", "role", "d", "n")] + [
        pa.array(fault[row].astype(np.int32)), out.column("piece").combine_chunks(), pa.array(before[step].astype(np.int32)),
        pa.array(np.array(list(LETTERS))[op[step]].tolist(), pa.string()), pa.array(to[step].astype(np.int32)),
        pa.array(np.where(tail, after_end[root], 0).astype(np.int32)), pa.array(entry[root].astype(np.int32)),
        none(left[root].astype(np.int32), head), none(start[root], head & is_first[segment[root]]), pa.array(part[segment[root]])]
    whole = pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _EDITED.split(", ")])
    for lo in range(0, whole.num_rows, 1 << 14):
        yield whole.slice(lo, 1 << 14)


def _followed(table: pa.Table) -> pa.Table:
    """The state in which the path of one conversation enters each piece."""
    found = {(p, e): left for p, e, left in zip(*(table.column(c).to_pylist() for c in ("piece", "entry", "left")))}
    state, entries, pieces = 0, [], sorted({p for p, _ in found})
    for p in pieces:
        entries.append(state)
        state = found[p, state]
    return pa.table([pa.array([table.column("conv")[0].as_py()] * len(pieces)), pa.array(pieces, pa.int64()), pa.array(entries, pa.int32())], names=["conv", "piece", "entry"])


def edits(texts: DataFrame) -> DataFrame:
    """The cheapest edits of all rows of ``distinct_rows``: conv, turn, role,
    d, n, fault (0 none, 1 blank, 2 duplicate, 3 truncated); ``before`` and
    ``after``, the roles inserted there (1 user, 2 assistant, 3 both); ``op``
    (D, K, R; of equal rows all but the first go), ``to`` (state of the new
    role of R) and, in a conversation's first row, its whole cost."""
    with_package(texts.sparkSession)
    rows = Stage(with_duplicates(numbered(texts)), "conversation-rows").df
    edges = Stage(edge_matrices(rows), "conversation-edges").df
    several = edges.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv")
    behind = edges.join(several, "conv").groupBy("conv").applyInArrow(_behind, "conv string, piece bigint, exit array<bigint>, first boolean, final boolean")
    made = Stage(piece_edits(rows, Stage(behind, "conversation-exits").df), "conversation-edits").df
    parts = made.where("part")
    path = parts.where("left is not null").select("conv", "piece", "entry", "left").groupBy("conv").applyInArrow(_followed, "conv string, piece bigint, entry int")
    return made.where("not part").unionByName(parts.join(path, ["conv", "piece", "entry"]).select(*made.columns)).drop("piece", "entry", "left", "part")


# ---- results ----------------------------------------------------------------

def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv, turn (of the row, or of the row
    beside which a row was inserted), place (order within row), role, text."""
    texts = Stage(distinct_rows(rows), "conversation-texts").df
    made = edits(texts).select("conv", "turn", "role", "d", "before", "op", "to", "after")
    whole = made.withColumnsRenamed({"conv": "_conv", "turn": "_turn", "role": "_role", "d": "_d"}).join(
        texts, (F.col("_conv") == F.col("conv")) & F.col("_turn").eqNullSafe(F.col("turn")) & (F.col("_role") == F.col("role")) & (F.col("_d") == F.col("d")))
    row = lambda role, text, when: F.when(when, F.struct(role.alias("role"), text.alias("text")))
    new = lambda column, bit, role: row(F.lit(role), F.lit(""), F.col(column).bitwiseAND(bit) > 0)
    own = row(F.when(F.col("op") == "K", F.col("role")).when(F.col("to") == USER, "user").otherwise("assistant"), F.col("text"), F.col("op") != "D")
    listed = F.array_compact(F.array(new("before", 1, "user"), new("before", 2, "assistant"), own, new("after", 1, "user"), new("after", 2, "assistant")))
    return whole.select("conv", "turn", F.col("role").alias("row_role"), "d", F.posexplode(listed).alias("place", "row")).select(
        "conv", "turn", "row_role", "d", "place", "row.role", "row.text")


class _Digest:
    """What is told of one conversation, row by row in order."""

    LEGAL = frozenset(("su", "ua", "au"))

    def __init__(self, conv: str):
        self.conv, self.cost = conv, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.initial = None
        self.audit: list[str] = []
        self.sha, self.rows = hashlib.sha256(), 0

    def _row(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if not self.rows else chr(10)}{role}:{text}".encode())
        self.rows += 1

    def _new(self, bits: int) -> str:
        for bit, role in ((1, "user"), (2, "assistant")):
            if bits & bit:
                self._row(role, "")
        return "I" * bits.bit_count()

    def add(self, turn, role, n, fault, before, op, to, after, cost, text) -> None:
        if cost is not None:
            self.cost = cost
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        initial = role[:1]
        self.illegal += n - 1 + (self.initial is not None and self.initial + initial not in self.LEGAL)
        self.initial = initial
        self.blank += n * (fault == BLANK)
        self.duplicate += 0 if fault == BLANK else n - (fault != DUPLICATE)
        self.truncated += fault == TRUNCATED
        self.audit.append(self._new(before) + op + "D" * (n - 1))
        if op != "D":
            self._row(role if op == "K" else ROLE[to], text)
        self.audit.append(self._new(after))

    def told(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps if gaps < 1 << 63 else None, self.blank, self.duplicate, self.truncated, self.illegal, self.cost,
                "".join(self.audit), self.sha.hexdigest())


_TOLD = "conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def digests(rows: DataFrame) -> DataFrame:
    """Per conversation (``conv``) with rows: gaps, the numbers of faults and
    of illegal neighbours, cost, audit and repaired_sha256 (repaired
    ``role:text`` joined by line breaks)."""
    texts = Stage(distinct_rows(rows), "conversation-texts").df
    made = edits(texts).withColumn("tag", F.lit(0))
    # an edit goes before its row's text, so the stream holds one row at a time
    both = made.unionByName(texts.select("conv", "turn", "role", "d", "text").withColumn("tag", F.lit(1)), allowMissingColumns=True)
    names = ["conv", "tag", "turn", "role", "n", "fault", "before", "op", "to", "after", "cost", "text"]

    def run(batches):
        now = edit = None
        out: list[tuple] = []
        fields = [pa.field(a, pa.int64() if b == "bigint" else pa.string()) for a, b in (c.split() for c in _TOLD.split(", "))]

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(fields)], schema=pa.schema(fields))
        for rows in batches:
            for conv, tag, *rest in zip(*(rows.column(c).to_pylist() for c in names)):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.told())
                    now = _Digest(conv)
                if tag:
                    now.add(*edit[:-1], rest[-1])
                else:
                    edit = rest
            yield batch()
            out.clear()
        if now is not None:
            out.append(now.told())
            yield batch()

    return both.select(*names, "d").repartition("conv").sortWithinPartitions("conv", "turn", "role", "d", "tag").mapInArrow(run, _TOLD)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of ``conv_id:turn`` mod 20: 0 drops the row, 1
    empties its text, 2 takes its ``. ! ?`` away, 3 repeats it (``times`` 2),
    4 makes its role user. Nulls are one space, but for conv_id and turn."""
    kind = F.crc32(F.concat(conversation(), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    return (conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                    F.when(F.col("kind") == 3, 2).otherwise(1).alias("times")))


def audited(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """``digests`` of ``rows`` for every conv_id of ``conversations``; one
    without rows has zeros, an empty audit and the digest of no bytes."""
    every = conversations.select("conv_id").distinct().withColumn("_conv", conversation())
    both = every.join(digests(rows), F.col("_conv") == F.col("conv"), "left")
    none = F.col("conv").isNull()
    numbers = [F.when(none, F.lit(0).cast("bigint")).otherwise(F.col(c)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
