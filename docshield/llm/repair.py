"""Conversation structure repair by an auction algorithm for shortest paths.

A conversation's rows are the layers of a lattice; a node is a layer and how far the roles
`(s?(ua)+)?` have come (nothing yet, after s, after u, after a).  Arcs are the edits: keep a row,
give it another role, delete it, or insert an empty turn inside a layer, each with a whole
number as its cost.  The auction keeps a price for every node and one path: while no arc out
of the path's end is tight, the end's price is raised to the least arc cost plus price there and
the path contracts by a node; else it extends along the tight arc.  It starts from layers a
few rows before those that are settled, and a path that meets a settled node is done, so long
conversations take time in proportion to their rows.  Converged prices are distances; arcs
that are tight and lead to the end by tight arcs are those of the cheapest repairs, and the
trace takes the least edit letter at each.

Conversations are sorted by range, so one with very many rows lies over many tasks, in
segments of at most ``SEGMENT`` rows.  A conversation inside one task's rows is solved there.
For the others each segment gives its costs between entry and exit states (an auction for
each exit); a pass over the segments from the last to the first adds these up to prices at the
segments' ends, each segment is traced from every entry state under these prices, and a
pass from first to last picks the traces and feeds the repaired rows to the hash.  Either
pass keeps a few numbers for each conversation.

Defined cases: null ids, turns, roles and texts are one space where a string is made of them; a
null conv_id is a conversation; null turns come first; rows of one turn are ordered by role,
then by the text's SHA-256, repeated rows are adjacent; an empty role has no initial and can't be
kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docshield.llm.common import cut

SEGMENT = 1024  # rows
SEGMENT_BYTES = 4 << 20  # of text; a longer row is a segment
STAGE = 8  # layers between the origins of the auction
INF = 1 << 60
KEPT, TRUNCATED, BLANK, DUPLICATE = range(4)  # a row's first fault; a row's code is its initial's place in "sua" (others: 3) + 4 * fault
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}  # by a turn of the role that is due
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
INSERT, ENDS = 5, (0, 10, 5, 0)  # cost of an inserted turn; cost of ending in each state, by the insertions that are due


def _row_arcs(code: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, cost, next state) of the edits that use up a row."""
    initial, fault = code % 4, code // 4
    arcs = [("D", 2, state)]
    if fault < BLANK:
        more = 5 if fault == TRUNCATED else 0
        if initial == 0 and state == START:
            arcs.append(("K", more, AFTER_S))
        elif initial < 3 and initial and NEXT[state] == (AFTER_U, AFTER_A)[initial - 1]:
            arcs.append(("K", more, NEXT[state]))
        arcs.append(("R", 1 + more, NEXT[state]))
    return tuple(arcs)


ARCS = tuple(tuple(_row_arcs(code, q) for q in range(4)) for code in range(16))


def prices(codes: bytes, exits: list[int]) -> list[int]:
    """Cost from each node (4 * layer + state) to the end, where leaving in state q costs ``exits[q]`` (INF: not allowed).

    Exact for all nodes on a cheapest path from a stage's layer, the first among them; nowhere too high."""
    n = len(codes)
    base = min(exits)
    p = [0] * (4 * n) + [x - base if x < INF else INF for x in exits]
    settled = bytearray(4 * n) + b"\1" * 4
    if INF in exits:  # nodes that reach no allowed exit have no path
        for i in range(n - 1, -1, -1):
            ok = [any(p[4 * i + 4 + to] < INF for _, _, to in ARCS[codes[i]][q]) for q in range(4)]
            for q in (AFTER_A, AFTER_U, AFTER_A, AFTER_S, START):
                ok[q] = ok[q] or ok[NEXT[q]]
            for q in range(4):
                if not ok[q]:
                    p[4 * i + q] = INF
    first = n
    while first > 0:
        first = max(0, first - STAGE)
        for origin in range(4 * first, 4 * first + 4):
            if p[origin] >= INF:
                continue
            path = [origin]
            while not settled[path[-1]]:
                node = path[-1]
                layer, q = node >> 2, node & 3
                to = 4 * layer + NEXT[q]
                least = INSERT + p[to]
                below = 4 * layer + 4
                for _, cost, state in ARCS[codes[layer]][q]:
                    if cost + p[below + state] < least:
                        least, to = cost + p[below + state], below + state
                if least > p[node]:
                    p[node] = least
                    if len(path) > 1:
                        path.pop()
                else:
                    path.append(to)
            for node in path:
                settled[node] = 1
    return [x + base if x < INF else INF for x in p]


def traces(codes: bytes, p: list[int]) -> list[tuple[str, int]]:
    """For each entry state the least letters along tight arcs that lead to the end, and the exit state ("" and -1: no path)."""
    n = len(codes)
    good = bytearray(4 * n) + bytes(int(x < INF) for x in p[4 * n:])
    for i in range(n - 1, -1, -1):
        at, below = 4 * i, 4 * i + 4
        for q in range(4):
            own = p[at + q]
            good[at + q] = own < INF and any(good[below + to] and own == cost + p[below + to] for _, cost, to in ARCS[codes[i]][q])
        for q in sorted(range(4), key=lambda q: p[at + q]):  # a tight insertion leads to a lower price
            if p[at + q] < INF and p[at + q] == INSERT + p[at + NEXT[q]] and good[at + NEXT[q]]:
                good[at + q] = 1
    out = []
    for entry in range(4):
        layer, q, letters = 0, entry, []
        if not good[entry]:
            out.append(("", -1))
            continue
        while layer < n:
            own, below, taken = p[4 * layer + q], 4 * layer + 4, None
            for letter, cost, to in ARCS[codes[layer]][q]:
                if own == cost + p[below + to] and good[below + to] and (taken is None or letter < taken[0]):
                    taken = (letter, to)
            to = NEXT[q]
            if (taken is None or taken[0] > "I") and own == INSERT + p[4 * layer + to] and good[4 * layer + to]:
                letters.append("I")
                q = to
                continue
            letters.append(taken[0])
            layer, q = layer + 1, taken[1]
        out.append(("".join(letters), q))
    return out


@lru_cache(maxsize=1 << 13)
def solved(codes: bytes) -> tuple[str, int]:
    """Edits of a whole conversation before its end, and the state they leave."""
    return traces(codes, prices(codes, list(ENDS)))[START]


def transfer(codes: bytes) -> list[int]:
    """Costs from each entry to each exit state, row by row."""
    by_exit = [prices(codes, [0 if q == k else INF for q in range(4)])[:4] for k in range(4)]
    return [by_exit[k][q] for q in range(4) for k in range(4)]


class _Repaired:
    """A conversation's counts, audit and hash, fed with its segments in order."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.state, self.cost, self.letters = conv_id, START, 0, []
        self.faults, self.illegal, self.last = [0, 0, 0, 0], 0, None
        self.low = self.high = None
        self.turns, self.hash, self.some = 0, hashlib.sha256(), False

    def _turn(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.some else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.some = True

    def add(self, r: dict, letters: str, state: int) -> None:
        for code in r["codes"]:
            self.faults[code // 4] += 1
            self.illegal += self.last is not None and (self.last, code % 4) not in ((0, 1), (1, 2), (2, 1))
            self.last = code % 4
        if r["low"] is not None:
            self.turns += r["turns"] - (self.high == r["low"] and self.high is not None)
            self.low = r["low"] if self.low is None else self.low
            self.high = r["high"]
        self._edit(r["codes"], r["roles"], r["texts"], letters)
        self.state = state

    def _edit(self, codes: bytes, roles: list[str], texts: list[str], letters: str) -> None:
        self.letters.append(letters)
        q, k = self.state, 0
        for letter in letters:
            if letter == "I":
                q = NEXT[q]
                self._turn(ROLE[q], "")
                self.cost += INSERT
                continue
            if letter != "D":
                q = AFTER_S if letter == "K" and codes[k] % 4 == 0 else NEXT[q]
                self._turn(roles[k] if letter == "K" else ROLE[q], texts[k])
            self.cost += 2 if letter == "D" else (letter == "R") + 5 * (codes[k] // 4 == TRUNCATED)
            k += 1

    def row(self) -> list:
        self._edit(b"", [], [], "I" * (ENDS[self.state] // INSERT))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [self.conv_id, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, self.cost, "".join(self.letters), self.hash.hexdigest()]


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PART = "seg long, codes binary, roles array<string>, texts array<string>, low long, high long, turns long"
NAMES = [x.split()[0] for x in RESULT.split(", ")]
PART_NAMES = [x.split()[0] for x in PART.split(", ")]
PART_TYPES = [pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.int64()] * 3]
RESULT_TYPES = [*[pa.int64()] * 6, pa.string(), pa.string()]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest, id, code (null: a dropped row, kept for its conv_id): rows after damage."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"),
                                F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(20)).alias("kind"), (2 * F.monotonically_increasing_id()).alias("id"))
    kind, text = F.col("kind"), F.col("text")
    rows = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(text).alias("text"), (kind == 0).alias("gone"),
                       F.explode(F.when(kind == 3, F.array(F.col("id"), F.col("id") + 1)).otherwise(F.array("id"))).alias("id"))
    fault = F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~text.rlike(r"[.!?][\x20\x09-\x0D]*+\z"), TRUNCATED).otherwise(KEPT)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return rows.select("conv_id", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"), "id", F.when(~F.col("gone"), initial + 4 * fault).alias("code"))


def _parts(segment: int, conv_type: pa.DataType):
    """Conversations that lie inside the task's rows as results, the others as segments."""
    def run(batches):
        task, nth = TaskContext.get().partitionId(), 0
        done, parts = [], []
        current, began, runs, whole, repeated = None, False, 0, True, False
        held: dict = {}

        def clear():
            held.update(codes=bytearray(), roles=[], texts=[], low=None, high=None, turns=0, bytes=0)

        def part():
            nonlocal nth
            row = {"conv_id": current, "seg": (task << 33) + nth, **{k: held[k] for k in PART_NAMES[1:]}, "codes": bytes(held["codes"])}
            nth += 1
            clear()
            return row

        def close(edge: bool):
            """The end of a conversation's rows in this task; at the task's first and last it may go on elsewhere."""
            if edge or not whole:
                parts.append(part())
                return
            row = part()
            out = _Repaired(current)
            out.add(row, *solved(row["codes"]))
            done.append(out.row())

        def batch():
            none = [None] * len(done), [None] * len(parts)
            cols = [pa.array([r[0] for r in done] + [r["conv_id"] for r in parts], conv_type)]
            cols += [pa.array([r[k + 1] for r in done] + none[1], t) for k, t in enumerate(RESULT_TYPES)]
            cols += [pa.array(none[0] + [r[k] for r in parts], t) for k, t in zip(PART_NAMES, PART_TYPES, strict=True)]
            done.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays(cols, ["conv_id", *NAMES, *PART_NAMES])

        clear()
        for b in batches:
            for conv_id, turn, role, text, code, mark in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "code", "mark")), strict=True):
                if mark:
                    repeated = True
                    continue
                if not began or conv_id != current:
                    if began:
                        close(runs == 1)
                    current, began, whole = conv_id, True, True
                    runs += 1
                if code is None:
                    continue
                if len(held["codes"]) >= segment or held["bytes"] and held["bytes"] + len(text) > SEGMENT_BYTES:
                    whole = False
                    parts.append(part())
                    if len(parts) >= 8:
                        yield batch()
                held["codes"].append(code % 4 + 4 * DUPLICATE if repeated and code // 4 != BLANK else code)
                held["roles"].append(role)
                held["texts"].append(text)
                held["bytes"] += len(text)
                if turn is not None:
                    held["turns"] += turn != held["high"]
                    held["low"] = turn if held["low"] is None else held["low"]
                    held["high"] = turn
                repeated = False
            if done or parts:
                yield batch()
        if began:
            close(True)
            yield batch()
    return run


def _transfers(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("seg"), pa.array([transfer(x) for x in b.column("codes").to_pylist()], pa.list_(pa.int64()))], ["conv_id", "seg", "costs"])


def _ends(batches):
    """Prices at each segment's end: segments come from a conversation's last to its first."""
    current, ends = object(), None
    for b in batches:
        out = []
        for conv_id, costs in zip(b.column("conv_id").to_pylist(), b.column("costs").to_pylist(), strict=True):
            if conv_id != current:
                current, ends = conv_id, list(ENDS)
            out.append(ends)
            ends = [min(costs[4 * q + k] + ends[k] for k in range(4)) for q in range(4)]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("seg"), pa.array(out, pa.list_(pa.int64()))], ["conv_id", "seg", "ends"])


def _traced(batches):
    for b in batches:
        letters, states = [], []
        for codes, ends in zip(b.column("codes").to_pylist(), b.column("ends").to_pylist(), strict=True):
            found = traces(codes, prices(codes, ends))
            letters.append([x[0] for x in found])
            states.append([x[1] for x in found])
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("seg"), pa.array(letters, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int32()))], ["conv_id", "seg", "letters", "states"])


def _joined(conv_type: pa.DataType):
    """Results of conversations in several segments: a segment's traces come before its rows."""
    def run(batches):
        out, found = None, []

        def batch():
            cols = [pa.array([r[0] for r in found], conv_type), *(pa.array([r[k + 1] for r in found], t) for k, t in enumerate(RESULT_TYPES))]
            found.clear()
            return pa.RecordBatch.from_arrays(cols, ["conv_id", *NAMES])

        trace = None
        for b in batches:
            for r in b.to_pylist():
                if r["letters"] is not None:
                    trace = r
                    continue
                if out is None or r["conv_id"] != out.conv_id:
                    if out is not None:
                        found.append(out.row())
                    out = _Repaired(r["conv_id"])
                out.add(r, trace["letters"][out.state], trace["states"][out.state])
            if found:
                yield batch()
        if out is not None:
            found.append(out.row())
            yield batch()
    return run


def repaired(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    conversations = conversations.select("conv_id", "turn", "role", "text")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    rows = cut(damaged(conversations if kind in ("bigint", "int", "string") else conversations.withColumn("conv_id", F.col("conv_id").cast("string"))))
    conv = f"conv_id {dict(rows.dtypes)['conv_id']}"
    # of rows with the same role and text the first is no duplicate; marks of the others go through the sort beside them
    same = [F.col("conv_id"), F.col("role"), F.col("digest")]
    said = rows.where(F.col("code") < 4 * BLANK)
    first = said.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("turn", "id"))["id"].alias("first")).where("n > 1").withColumnsRenamed({"conv_id": "_conv", "role": "_role", "digest": "_digest"})
    again = said.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))).where("id <> first")
    order = ["conv_id", "turn", "role", "digest", "id"]
    marked = rows.withColumn("mark", F.lit(False)).unionByName(again.select("conv_id", "turn", "role", F.lit(None).cast("string").alias("text"), "digest", "id", F.lit(None).cast("int").alias("code"), F.lit(True).alias("mark")))
    parts = cut(marked.repartitionByRange(*order).sortWithinPartitions(*order, F.col("mark").desc()).mapInArrow(_parts(segment, arrow), f"{conv}, {RESULT}, {PART}"))
    whole, pieces = parts.where("seg IS NULL").select("conv_id", *NAMES), parts.where("seg IS NOT NULL").select("conv_id", *PART_NAMES)
    small = pieces.select("conv_id", "seg", "codes")
    costs = small.mapInArrow(_transfers, f"{conv}, seg long, costs array<long>")
    ends = cut(costs.repartition("conv_id").sortWithinPartitions("conv_id", F.col("seg").desc()).mapInArrow(_ends, f"{conv}, seg long, ends array<long>"))
    traced = small.join(ends.select("seg", "ends"), "seg").mapInArrow(_traced, f"{conv}, seg long, letters array<string>, states array<int>")
    both = pieces.withColumns({"letters": F.lit(None).cast("array<string>"), "states": F.lit(None).cast("array<int>")}).unionByName(traced, allowMissingColumns=True)
    rest = both.repartition("conv_id").sortWithinPartitions("conv_id", "seg", F.col("letters").isNull()).mapInArrow(_joined(arrow), f"{conv}, {RESULT}")
    return whole.unionByName(rest)
