"""Repair of conversations: the cheapest edits that give them legal turns, by A* on the edit lattice.

A node of the lattice is (rows consumed, state), where the state says what stands
last in the repaired conversation: nothing, system, user or assistant. Edits keep a
row, give it the role that the state asks for, delete it, or insert an empty turn of
that role; role initials have to come out as ``(s?(ua)+)?``. The heuristic is the
suffix sum of what no path avoids: a deletion for each blank or duplicate row, the
truncation charge for each truncated one. It never falls by more than an edge costs,
so nodes leave the queue, keyed (cost plus heuristic, audit), once, each with its
cheapest and then ASCII-least audit.

Rows are put in one order of conversation, turn, role and text by a range shuffle and
cut into cells of ``cell`` rows, so a conversation of any length is spread. Equal rows
are counted before that and form one row with a number of copies. A conversation
within a cell is solved there. One that crosses cells gets, from each cell, the best
audits from each state to each other one; these are chained by cost and the audits'
order alone. Repaired texts are hashed in order, streamed row by row, as the digest of
one conversation asks; only its flags and audit are held.

Defined results: nulls count as one space; rows without conv_id are one conversation;
rows of one turn are ordered by role, then text (after damage); a turn of null comes
first; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.shared import spread_join, stored
from talus.llm.subwords import text_chunks

SPACE = " \t\n\x0b\x0c\r"
#: Kinds of faults.
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: States: what stands last in the repaired conversation.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)  # the role that an insertion or another role gives
_ROLE = (None, "system", "user", "assistant")
_LEGAL = ("su", "ua", "au")


@dataclass(frozen=True)
class Charges:
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


@dataclass(frozen=True)
class RepairRules:
    charges: Charges = Charges()
    #: Rows of one cell.
    cell: int = 1024


#: A row of the lattice: role initial, fault, and copies after it, which have to go.
Row = tuple[str, int, int]


def _kept(state: int, initial: str) -> int | None:
    """The state after a row of this initial is kept, if that is legal."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    return _NEXT[state] if initial == "xsua"[_NEXT[state]] else None


def best_edits(rows: list[Row], charges: Charges, entry: int = NOTHING, whole: bool = True) -> dict[int, tuple[int, str]]:
    """State at the end -> (cost, audit) of the cheapest edits; for a whole conversation only its best legal end.

    Copies after a row are one step, one D of the audit. Unless the conversation ends
    here, edits end with a row: what is inserted then belongs to the next rows.
    """
    steps = [step for initial, fault, copies in rows for step in ([(initial, fault, 1), ("", DUPLICATE, copies)] if copies else [(initial, fault, 1)])]
    n, ahead = len(steps), [0] * (len(steps) + 1)
    for i in range(n - 1, -1, -1):
        _, fault, times = steps[i]
        ahead[i] = ahead[i + 1] + (charges.delete * times if fault in (BLANK, DUPLICATE) else min(charges.truncated, charges.delete) if fault == TRUNCATED else 0)
    queue = [(ahead[0], "", 0, entry)]
    done: set[tuple[int, int]] = set()
    ends: dict[int, tuple[int, str]] = {}
    while queue:
        key, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        cost = key - ahead[i]
        if i == n:
            if not whole or state in (NOTHING, ASSISTANT):
                ends[state] = (cost, audit)
                if whole:
                    break
            if not whole:
                continue
        else:
            initial, fault, times = steps[i]
            heapq.heappush(queue, (cost + charges.delete * times + ahead[i + 1], audit + "D", i + 1, state))
            if fault not in (BLANK, DUPLICATE):
                cut = charges.truncated if fault == TRUNCATED else 0
                after = _kept(state, initial)
                if after is not None:
                    heapq.heappush(queue, (cost + cut + ahead[i + 1], audit + "K", i + 1, after))
                heapq.heappush(queue, (cost + cut + charges.rerole + ahead[i + 1], audit + "R", i + 1, _NEXT[state]))
        heapq.heappush(queue, (cost + charges.insert + ahead[i], audit + "I", i, _NEXT[state]))
    return ends


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows with the faults that crc32 of conversation and turn deals out."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    role = F.when(kind == 4, "user").otherwise(part("role"))
    return rows.where(kind != 0).select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def _placed(rows: DataFrame) -> DataFrame:
    """at, conv_id, turn, role, text, fault, copies of every different row, numbered in order."""
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    named = F.when(F.col("conv_id").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("conv_id").cast("string")))
    key = F.md5(F.concat_ws(":", F.length(named), named, F.length("role"), F.col("role"), F.col("text")))
    when: Column = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    counted = counted.withColumn("key", key).withColumn("when", when)
    seen = stored(counted.groupBy("key").agg(F.min("when").alias("first"), F.count("*").alias("n")).where("n > 1"))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(F.col("when") > F.col("first"), DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    rows = spread_join(counted, seen.select("key", "first"), "key", "turn", "left", counts=seen)
    start = [F.substring(c, 1, 64) for c in ("role", "text")]  # samples of the range shuffle stay small
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.select(*order, fault.alias("fault"), "copies").repartitionByRange("conv_id", "turn", *start).sortWithinPartitions(*order)
    return stored(rows.withColumn("at", F.monotonically_increasing_id()))


_STATS = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")


def _segments(placed: DataFrame, rules: RepairRules) -> DataFrame:
    """One row for each conversation in each cell: its first place, counts, first and last initial, costs and audits.

    costs and audits: of the one best way, if the conversation lies within the cell, else
    from each state (four of four) to each one, -1 where there is no way.
    """
    conv = placed.schema["conv_id"].dataType.simpleString()
    light = placed.select(F.shiftright("at", rules.cell.bit_length() - 1).alias("cell"), "at", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "copies")

    def solve(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        rows = list(zip(*(group.column(c).to_pylist() for c in ("conv_id", "at", "turn", "initial", "fault", "copies")), strict=True))
        cuts = [i for i in range(len(rows)) if not i or rows[i][0] != rows[i - 1][0]] + [len(rows)]
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = rows[a:b]
            lattice = [(initial, fault, copies - 1) for _, _, _, initial, fault, copies in own]
            turns = sorted({r[2] for r in own if r[2] is not None})
            count = lambda f: sum((fault == f) + (copies if fault == BLANK == f or fault != BLANK and f == DUPLICATE else 0) for _, fault, copies in lattice)  # noqa: B023, E731
            illegal = sum(c for _, _, c in lattice) + sum(x[0] + y[0] not in _LEGAL for x, y in zip(lattice, lattice[1:], strict=False))
            stats = [count(BLANK), count(DUPLICATE), count(TRUNCATED), illegal, len(turns), turns[0] if turns else None, turns[-1] if turns else None]
            if a and b < len(rows):
                ((cost, audit),) = best_edits(lattice, rules.charges).values()
                costs, audits = [cost], [audit]
            else:
                costs, audits = [], []
                for entry in range(4):
                    ends = best_edits(lattice, rules.charges, entry, whole=False)
                    costs += [ends[e][0] if e in ends else -1 for e in range(4)]
                    audits += [ends[e][1] if e in ends else "" for e in range(4)]
            out.append((own[0][0], own[0][1], stats, [own[0][3], own[-1][3]], costs, audits))
        columns = zip(*out, strict=True)
        kinds = [group.schema.field("conv_id").type, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string())]
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "at", "stats", "ends", "costs", "audits"])

    schema = f"conv_id {conv}, at long, stats array<long>, ends array<string>, costs array<long>, audits array<string>"
    return stored(light.groupBy("cell").applyInArrow(solve, schema))


def _chain(segments: list[tuple[list[int], list[str]]], charges: Charges) -> tuple[int, list[int], str]:
    """Cost, the audit to take from each segment, and what is inserted at the end. segments: costs, ranks of the audits from each state."""
    at = {NOTHING: (0, 0)}  # state -> cost, place in the order of audits
    back: list[dict[int, int]] = []
    for costs, ranks in segments:
        ways: dict[int, tuple] = {}
        for entry, (cost, order) in at.items():
            for end in range(4):
                c = costs[4 * entry + end]
                if c >= 0 and (end not in ways or (cost + c, order, ranks[4 * entry + end]) < ways[end][:3]):
                    ways[end] = (cost + c, order, ranks[4 * entry + end], entry)
        order = {way[1:3]: k for k, way in enumerate(sorted(ways.values(), key=lambda w: w[1:3]))}
        at = {end: (way[0], order[way[1:3]]) for end, way in ways.items()}
        back.append({end: way[3] for end, way in ways.items()})
    last = {NOTHING: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}  # turns to insert
    end = min(at, key=lambda s: (at[s][0] + charges.insert * last[s], at[s][1]))
    cost, tail, taken = at[end][0] + charges.insert * last[end], "I" * last[end], []
    for ways in reversed(back):
        taken.append(4 * ways[end] + end)
        end = ways[end]
    return cost, taken[::-1], tail


class _Conversation:
    """What is held of one conversation while its segments and rows stream past."""

    def __init__(self, conv_id, charges: Charges):
        self.conv_id, self._charges = conv_id, charges
        self._stats, self._segments, self._ends = [0, 0, 0, 0], [], None
        self._turns, self._low, self._high = 0, None, None
        self._cost, self._taken, self._tail = 0, None, ""
        self._audit: list[str] = []
        self._edits: Iterator[str] = iter("")
        self._state, self._sha, self._some = NOTHING, hashlib.sha256(), False

    def segment(self, stats: list, ends: list[str], costs: list[int], ranks: list[int]) -> None:
        self._stats = [a + b for a, b in zip(self._stats, stats[:4], strict=True)]
        self._stats[3] += self._ends is not None and self._ends + ends[0] not in _LEGAL
        self._ends = ends[1]
        if stats[4]:
            self._turns += stats[4] - (self._high == stats[5])
            self._low, self._high = stats[5] if self._low is None else self._low, stats[6]
        self._segments.append((costs, ranks))

    def audits(self, audits: list[str]) -> None:
        if self._taken is None:
            if len(self._segments) == 1 and len(self._segments[0][0]) == 1:
                self._cost, self._taken = self._segments[0][0][0], [0]
            else:
                self._cost, self._taken, self._tail = _chain(self._segments, self._charges)
            self._taken.reverse()
        for edit in self._edits:  # what the segment before inserts after its last row
            self._inserted(edit)
        self._edits = iter(audits[self._taken.pop()])

    def _write(self, role: str, text: bytes) -> None:
        self._sha.update(b"\n" * self._some + role.encode() + b":" + text)
        self._some = True

    def _inserted(self, edit: str) -> None:
        self._state = _NEXT[self._state]
        self._write(_ROLE[self._state], b"")
        self._audit.append(edit)

    def row(self, role: str, text: bytes, copies: int) -> None:
        for times in [1, copies - 1] if copies > 1 else [1]:
            while (edit := next(self._edits)) == "I":
                self._inserted(edit)
            self._audit.append(edit * times)
            if edit == "K":
                self._state = SYSTEM if role[0] == "s" else _NEXT[self._state]
                self._write(role, text)
            elif edit == "R":
                self._state = _NEXT[self._state]
                self._write(_ROLE[self._state], text)

    def result(self) -> tuple:
        for edit in [*self._edits, *self._tail]:
            self._inserted(edit)
        gaps = self._high - self._low + 1 - self._turns if self._turns else 0
        return self.conv_id, gaps, *self._stats, self._cost, "".join(self._audit), self._sha.hexdigest()


def repaired(conversations: DataFrame, broken: DataFrame, rules: RepairRules = RepairRules()) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    conversations names the conversations to return; broken has their rows: conv_id, turn, role, text, copies.
    """
    placed = _placed(broken)
    segments = _segments(placed, rules)
    conv = conversations.schema["conv_id"].dataType.simpleString()
    empty = lambda kind: F.lit(None).cast(kind)
    light = {"stats": "array<long>", "ends": "array<string>", "costs": "array<long>", "ranks": "array<int>", "audits": "array<string>", "role": "string", "text": "string", "copies": "long"}

    def part(df: DataFrame, phase: int, **own: Column) -> DataFrame:
        return df.select("conv_id", F.lit(phase).alias("phase"), own.pop("at").alias("at"), *[own.get(c, empty(k)).alias(c) for c, k in light.items()])

    def rank(i: Column, audits: Column) -> Column:  # place of an audit among those from the same state
        entry = F.floor(i / 4).cast("int")
        return F.size(F.filter(F.slice(audits, entry * 4 + 1, 4), lambda a: a < F.element_at(audits, i + 1)))

    ranks = F.transform(F.sequence(F.lit(0), F.size("audits") - 1), lambda i: rank(i, F.col("audits")).cast("int"))
    first = F.lit(0).cast("long")
    every = part(conversations.select("conv_id").distinct(), 0, at=first)
    every = every.unionByName(part(segments, 1, at=F.col("at"), stats=F.col("stats"), ends=F.col("ends"), costs=F.col("costs"), ranks=ranks))
    every = every.unionByName(part(segments, 2, at=F.col("at") * 2, audits=F.col("audits")))
    every = every.unionByName(part(placed, 2, at=F.col("at") * 2 + 1, role=F.col("role"), text=F.col("text"), copies=F.col("copies")))
    names = ["conv_id", "gaps", *_STATS[:4], "cost", "audit", "repaired_sha256"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Conversation | None = None
        kind = None

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), kind if n == "conv_id" else pa.string() if n in names[-2:] else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)], names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for a, b, texts in text_chunks(batch.column("text")):
                out = []
                columns = [batch.column(c).slice(a, b - a).to_pylist() for c in ("conv_id", "phase", "stats", "ends", "costs", "ranks", "audits", "role", "copies")]
                for conv_id, phase, stats, ends, costs, ranks_, audits, role, copies, text in zip(*columns, texts, strict=True):
                    if held is None or held.conv_id != conv_id:
                        out += [held.result()] if held else []
                        held = _Conversation(conv_id, rules.charges)
                    if phase == 1:
                        held.segment(stats, ends, costs, ranks_)
                    elif phase == 2 and role is None:
                        held.audits(audits)
                    elif phase == 2:
                        held.row(role, text, copies)
                if out:
                    yield batch_of(out)
        if held is not None:
            yield batch_of([held.result()])

    schema = f"conv_id {conv}, gaps long, " + ", ".join(f"{s} long" for s in _STATS[:4]) + ", cost long, audit string, repaired_sha256 string"
    return every.repartition("conv_id").sortWithinPartitions("conv_id", "phase", "at").mapInArrow(task, schema)


def repair(conversations: DataFrame, rules: RepairRules = RepairRules()) -> DataFrame:
    """Damages conversations and repairs them."""
    return repaired(conversations, damaged(conversations), rules)


_CRC = """xor(list_reduce([4294967295] || list_transform(string_split({0}, ''), lambda x: CAST(ord(x) AS BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

#: The best (cost, audit, text) of each state, row by row; at most one insertion is of use before a row.
ORACLE_SQL = rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations),
harm AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM src, (SELECT unnest([1, 2]) AS c) WHERE k <> 0 AND (c = 1 OR k = 3)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS ch, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM harm),
told AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM numbered),
flagged AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM told),
stats AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated
  FROM flagged GROUP BY conv_id),
pairs AS (SELECT conv_id, ch || lead(ch) OVER (PARTITION BY conv_id ORDER BY i) AS two FROM flagged),
wrong AS (SELECT conv_id, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id),
move(st, want, edit, price, ends, head, role) AS (VALUES
  (0, 's', 'K', 0, 1, '', NULL), (0, 'u', 'K', 0, 2, '', NULL), (1, 'u', 'K', 0, 2, '', NULL), (3, 'u', 'K', 0, 2, '', NULL), (2, 'u', 'IK', 2, 2, 'assistant:', NULL),
  (2, 'a', 'K', 0, 3, '', NULL), (0, 'a', 'IK', 2, 3, 'user:', NULL), (1, 'a', 'IK', 2, 3, 'user:', NULL), (3, 'a', 'IK', 2, 3, 'user:', NULL),
  (0, '*', 'R', 2, 2, '', 'user'), (1, '*', 'R', 2, 2, '', 'user'), (3, '*', 'R', 2, 2, '', 'user'), (2, '*', 'R', 2, 3, '', 'assistant'),
  (0, '*', 'IR', 4, 3, 'user:', 'assistant'), (1, '*', 'IR', 4, 3, 'user:', 'assistant'), (3, '*', 'IR', 4, 3, 'user:', 'assistant'), (2, '*', 'IR', 4, 2, 'assistant:', 'user')),
dp(conv_id, i, st, b) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} FROM stats
  UNION ALL
  SELECT conv_id, i, st, min(b) FROM (
    SELECT d.conv_id, f.i, d.st, {{'c': d.b.c + 3, 'a': d.b.a || 'D', 't': d.b.t}} AS b FROM dp d JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i + 1
    UNION ALL
    SELECT d.conv_id, f.i, m.ends, {{'c': d.b.c + m.price + CASE WHEN fault = 3 THEN 1 ELSE 0 END, 'a': d.b.a || m.edit,
           't': d.b.t || chr(10) || CASE WHEN m.head = '' THEN '' ELSE m.head || chr(10) END || coalesce(m.role, f.role) || ':' || f.text}}
    FROM dp d JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i + 1 JOIN move m ON m.st = d.st AND m.want IN (f.ch, '*') WHERE fault NOT IN (1, 2))
  GROUP BY conv_id, i, st),
last AS (
  SELECT d.conv_id, min({{'c': b.c + CASE st WHEN 2 THEN 2 WHEN 1 THEN 4 ELSE 0 END, 'a': b.a || CASE st WHEN 2 THEN 'I' WHEN 1 THEN 'II' ELSE '' END,
         't': b.t || CASE st WHEN 2 THEN chr(10) || 'assistant:' WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE '' END}}) AS b
  FROM dp d JOIN stats s ON s.conv_id IS NOT DISTINCT FROM d.conv_id AND s.n = d.i GROUP BY d.conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN wrong w ON w.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN last l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
"""
