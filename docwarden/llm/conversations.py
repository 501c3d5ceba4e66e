"""Conversation repair by depth-first branch and bound.

A conversation's turns are edited at least cost until the initials of their roles read
``(s?(ua)+)?``: keep a turn, give it the role user or assistant, delete it, or insert an empty turn.
Blank and repeated turns have to go; a turn that ends in the middle of a sentence costs extra if it
stays. Of the cheapest repairs the one whose audit (the edits' initials D, I, K, R in order) comes
first in ASCII order is taken.

The search keeps an explicit stack of prefixes ``(turn, state, cost, audit)``. A prefix is left

* if its cost and a lower bound of the suffix exceed the incumbent, or just reach it while its audit
  already stands after the incumbent's. The bound is the cost of a relaxed repair, in which system
  turns may stay anywhere as long as nothing precedes, and a lone system turn may end it;
* if the dominance table of its node (turn and state) holds a prefix with a smaller cost and audit:
  whatever follows follows both, so the worse prefix can never win.

An empty stack proves the incumbent to be the best. A conversation is searched in segments of
``SEGMENT`` turns, which are numbered by a distributed prefix sum: a segment's best repairs from
each state to each state are joined segment by segment, under the same order of cost and audit. So
a conversation of any length is searched by many tasks. Only the last step, the text of the result
in order, goes through one task per conversation, as a stream that holds the audit and one batch.

Defined cases: null ids are one conversation; null roles and texts are one space; turns come by
number, nulls first, and those of one number by the digest of role and text; a role is illegal
unless it begins with s, u or a; a conversation that lost all its turns has an empty repair; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.llm.ranks import ranked
from docwarden.llm.storage import bounded_batches, stored

SEGMENT = 512
WHITE_SPACE = " \t\n\v\f\r"
FAULTS = ("", "blank", "duplicate", "truncated")
#: Initials that may follow each other.
LEGAL = {"su", "ua", "au"}
#: State after an initial: 0 nothing yet, 1 after system, 2 after user, 3 after an answer.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTED = (0, 3)
ROLES = {"u": "user", "a": "assistant"}


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def bounds(turns: list[tuple[str, int]], ends: tuple[int, ...], costs: Costs) -> list[tuple[float, ...]]:
    """For each suffix, a lower bound of its cost from each state.

    After the beginning, the cost of a relaxed repair that may also end with a lone system turn. At
    the beginning, that of one in which system turns may stay anywhere."""
    never, insert = float("inf"), costs.insert
    u = 0 if {1, 3} & set(ends) else never
    a = 0 if 2 in ends else never
    u, a = min(u, insert + a), min(a, insert + u)
    free_u, free_a = min(u, 0 if 0 in ends else never), a
    out = [(free_u, u, a, u)]
    for initial, fault in reversed(turns):
        stay = fault not in (1, 2)
        extra = costs.truncated if fault == 3 else 0
        as_user, as_answer = (extra + (0 if initial == letter else costs.rerole) for letter in "ua")

        def before(u: float, a: float, system: bool) -> tuple[float, float]:
            to_u, to_a = costs.delete + u, costs.delete + a
            if stay:
                to_u, to_a = min(to_u, as_user + a), min(to_a, as_answer + u)
                if system:
                    to_u, to_a = min(to_u, extra + u), min(to_a, extra + a)
            return min(to_u, insert + to_a), min(to_a, insert + to_u)

        u, a = before(u, a, False)
        free_u, free_a = before(free_u, free_a, initial == "s")
        out.append((free_u, u, a, u))
    return out[::-1]


def search(
    turns: list[tuple[str, int]], start: int = 0, ends: tuple[int, ...] = ACCEPTED, costs: Costs = Costs()
) -> tuple[int, str] | None:
    """The cheapest ``(cost, audit)`` that leads ``turns`` (initial, fault) from a state to one of
    ``ends``, ties to the smallest audit; None if there is none."""
    bound = bounds(turns, ends, costs)
    if bound[0][start] == float("inf"):
        return None
    best, best_cost = None, 1 << 62  # dead ends have infinite bounds
    first = (0, "")
    dominant: dict[tuple[int, int], tuple[int, str]] = {(0, start): first}
    stack = [(0, start, first)]
    while stack:
        i, state, prefix = stack.pop()
        cost, audit = prefix
        if dominant[i, state] is not prefix:
            continue  # a better prefix reached this node meanwhile
        least = cost + bound[i][state]
        if least > best_cost or (least == best_cost and audit > best[1][: len(audit)]):
            continue
        if i == len(turns) and state in ends and (best is None or prefix < best):
            best, best_cost = prefix, cost
        step = STEP[state]
        nexts = [(i, step[letter], cost + costs.insert, "I") for letter in "ua" if letter in step]
        if i < len(turns):
            initial, fault = turns[i]
            nexts.append((i + 1, state, cost + costs.delete, "D"))
            if fault not in (1, 2):
                extra = cost + (costs.truncated if fault == 3 else 0)
                if initial in step:
                    nexts.append((i + 1, step[initial], extra, "K"))
                nexts += [(i + 1, step[letter], extra + costs.rerole, "R") for letter in "ua" if letter in step]
        # the most promising prefix goes on top
        nexts.sort(key=lambda x: (x[2] + bound[x[0]][x[1]], x[3]), reverse=True)
        for j, reached, price, edit in nexts:
            if price + bound[j][reached] > best_cost:
                continue
            longer = (price, audit + edit)
            known = dominant.get((j, reached))
            if known is None or longer < known:
                dominant[j, reached] = longer
                stack.append((j, reached, longer))
    return best


def _solved(costs: Costs, segment: int):
    """One row per segment: its best repairs between states, its faults and its borders."""
    names = ["tree", "seg", "repairs", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high",
             "first", "last"]
    repair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    types = [pa.string(), pa.int64(), repair, *[pa.int64()] * 7, pa.string(), pa.string()]
    schema = pa.schema(list(zip(names, types)))

    def solved(tree: str, seg: int, n: int, turns: list[tuple[str, int]], numbers: list[int | None]) -> dict:
        number = [t for t in numbers if t is not None]
        initials = "".join(i for i, _ in turns)
        if n <= segment:
            cost, audit = search(turns, costs=costs)
            repairs = [{"start": 0, "end": 0, "cost": cost, "audit": audit}]
        else:
            found = ((s, e, search(turns, s, (e,), costs)) for s in range(4) for e in range(4))
            repairs = [{"start": s, "end": e, "cost": f[0], "audit": f[1]} for s, e, f in found if f]
        faults = [sum(f == k for _, f in turns) for k in (1, 2, 3)]
        illegal = sum(initials[i: i + 2] not in LEGAL for i in range(len(initials) - 1))
        # by number, so equal ones are neighbours
        distinct = sum(i == 0 or number[i] != number[i - 1] for i in range(len(number)))
        ends = (number[0], number[-1]) if number else (None, None)
        return dict(zip(names, [tree, seg, repairs, *faults, illegal, distinct, *ends, initials[0], initials[-1]]))

    def run(batches):
        head, turns, numbers = None, [], []
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("tree", "seg", "n", "initial", "fault", "turn"))
            for tree, seg, n, initial, fault, number in zip(*columns):
                if head != (tree, seg, n):
                    if head:
                        out.append(solved(*head, turns, numbers))
                    head, turns, numbers = (tree, seg, n), [], []
                turns.append((initial, fault))
                numbers.append(number)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if head:
            yield pa.RecordBatch.from_pylist([solved(*head, turns, numbers)], schema)

    return run, ("tree string, seg long, repairs array<struct<start:int,end:int,cost:long,audit:string>>, blank long, "
                 "duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string")


class _Summary:
    """Segments of one conversation, joined one after another."""

    def __init__(self):
        self.best, self.settled = {0: (0, "")}, []
        self.faults, self.illegal, self.turns = [0, 0, 0], 0, 0
        self.low = self.high = self.last = None

    def add(self, s: dict) -> None:
        self.faults = [a + s[k] for a, k in zip(self.faults, FAULTS[1:])]
        self.illegal += s["illegal"] + (self.last is not None and self.last + s["first"] not in LEGAL)
        self.turns += s["turns"] - (s["turns"] > 0 and self.high == s["low"])
        self.low = s["low"] if self.low is None else self.low
        self.high, self.last = self.high if s["high"] is None else s["high"], s["last"]
        reached = {}
        for r in s["repairs"]:
            if r["start"] in self.best:
                cost, audit = self.best[r["start"]]
                longer = (cost + r["cost"], audit + r["audit"])
                reached[r["end"]] = min(longer, reached.get(r["end"], longer))
        # what all states share is settled and need not be copied again
        common = commonprefix([a for _, a in reached.values()])
        self.settled.append(common)
        self.best = {q: (c, a[len(common):]) for q, (c, a) in reached.items()}

    def row(self) -> dict:
        cost, audit = min(self.best[q] for q in ACCEPTED if q in self.best)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, **dict(zip(FAULTS[1:], self.faults)), "illegal": self.illegal, "cost": cost,
                "audit": "".join([*self.settled, audit])}


class _Edits:
    """Apply an audit to turns that come in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _role(self) -> str:
        letter = "a" if self.state == 2 else "u"
        self.state = STEP[self.state][letter]
        return ROLES[letter]

    def inserted(self):
        while self.audit[self.at: self.at + 1] == "I":
            self.at += 1
            yield self._role(), ""

    def turn(self, role: str, text: str):
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "R":
            yield self._role(), text
        elif edit == "K":
            self.state = STEP[self.state][role[:1]]
            yield role, text


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
REPAIRED = "tree string, place long, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
#: Repaired turns handed on at once.
TURNS_AT_ONCE = 1000


def _repaired(batches):
    """A conversation's summary (place -1) and its repaired turns, in order."""
    schema = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()),
                        *[(c, pa.int64()) for c in REPORT[:-1]], ("audit", pa.string())])
    out: list[dict] = []
    tree = summary = edits = None
    place = 0

    def begun():
        """The summary is complete: every segment has come."""
        row = summary.row()
        out.append({"tree": tree, "place": -1, **row})
        return _Edits(row["audit"])

    def put(turns):
        nonlocal place
        for role, text in turns:
            out.append({"tree": tree, "place": place, "role": role, "text": text})
            place += 1

    def end():
        nonlocal edits
        if tree is not None:
            edits = edits or begun()
            put(edits.inserted())

    for batch in batches:
        segments = batch.column("segment")
        columns = (batch.column(c).to_pylist() for c in ("tree", "kind", "role", "text"))
        for at, (name, kind, role, text) in enumerate(zip(*columns)):
            if kind == 0:
                end()
                tree, summary, edits, place = name, _Summary(), None, 0
            elif kind == 1:
                summary.add(segments[at].as_py())
            else:
                edits = edits or begun()
                put(edits.turn(role, text))
            if len(out) >= TURNS_AT_ONCE:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
    end()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def damaged(
    rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in, decided by the crc-32 of ``conv_id:turn``."""
    c, t, r, x = (F.col(f"`{name}`") for name in (conv_id, turn, role, text))
    said = lambda v: F.coalesce(v.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(c), F.lit(":"), said(t)).cast("binary")) % 20
    text_ = F.when(kind == 1, "").when(kind == 2, F.translate(said(x), ".!?", "")).otherwise(said(x))
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(kind != 0).select(
        c.alias("conv_id"), t.cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(said(r)).alias("role"),
        text_.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _tree(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("+"), conv_id.cast("string")), F.lit(""))


def repair(
    rows: DataFrame, conversations: DataFrame, *, costs: Costs = Costs(), segment: int = SEGMENT
) -> DataFrame:
    """Repaired turns (``tree, place, role, text``), each conversation's after a row of its own
    with ``place`` -1, its faults, cost and audit. Rows of a conversation follow each other.

    ``rows`` has ``conv_id, turn, role, text`` without null roles or texts; ``conversations`` is
    one column ``conv_id`` of all conversations to report, those without rows too.
    """
    bounded_batches(rows.sparkSession)
    stripped = F.rtrim(F.col("text"), F.lit(WHITE_SPACE))
    ends_well = F.right(stripped, F.lit(1)).isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    turns = ranked(rows.select(
        _tree(F.col("conv_id")).alias("tree"), "turn", "role", "text",
        F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row")), "tree", ["turn", "digest", "row"])
    first = turns.groupBy("tree", "digest").agg(F.min("idx").alias("first"), F.count("*").alias("rows")).where(
        "rows > 1").drop("rows")
    fault = F.when(stripped == "", 1).when(F.col("idx") > F.col("first"), 2).when(~ends_well, 3).otherwise(0)
    facts = turns.select(
        "tree", "idx", "n", "turn", "digest", F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("initial"),
        F.when(stripped == "", "").when(ends_well, ".").otherwise("x").alias("text"))
    judged = facts.join(first, ["tree", "digest"], "left").select(
        "tree", F.floor(F.col("idx") / segment).alias("seg"), "idx", "n", "turn", "initial", fault.alias("fault"))
    solve, schema = _solved(costs, segment)
    # few bytes, much work: partitions of the session's number, not of an advisory size
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segments = stored(judged.repartition(partitions, "tree", "seg").sortWithinPartitions("tree", "seg", "idx").mapInArrow(solve, schema))
    heads = conversations.select(_tree(F.col("conv_id")).alias("tree")).distinct().withColumn("kind", F.lit(0))
    found = segments.select(
        "tree", F.lit(1).alias("kind"), F.col("seg").alias("idx"),
        F.struct(*[c for c in segments.columns if c != "tree"]).alias("segment"))
    texts = turns.select("tree", F.lit(2).alias("kind"), "idx", "role", "text")
    everything = heads.unionByName(found, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    return everything.repartition("tree").sortWithinPartitions("tree", "kind", "idx").mapInArrow(_repaired, REPAIRED)


def _reported(batches):
    """One row per conversation with the digest of its repaired turns."""
    names = ["tree", *REPORT, "repaired_sha256"]
    schema = pa.schema([("tree", pa.string()), *[(c, pa.int64()) for c in REPORT[:-1]], ("audit", pa.string()),
                        ("repaired_sha256", pa.string())])
    row, running = None, None
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("place", "role", "text"))
        for at, (place, role, text) in enumerate(zip(*columns)):
            if place < 0:
                if row:
                    out.append(row | {"repaired_sha256": running.hexdigest()})
                row, running = {c: batch.column(c)[at].as_py() for c in names[:-1]}, hashlib.sha256()
            else:
                running.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if row:
        yield pa.RecordBatch.from_pylist([row | {"repaired_sha256": running.hexdigest()}], schema)


def repair_report(rows: DataFrame, conversations: DataFrame, **options) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    kind = conversations.schema["conv_id"].dataType
    found = repair(rows, conversations, **options).mapInArrow(
        _reported, "tree string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
        "audit string, repaired_sha256 string")
    conv_id = F.when(F.col("tree") != "", F.substr("tree", F.lit(2))).cast(kind).alias("conv_id")
    return found.select(conv_id, *REPORT, "repaired_sha256")
