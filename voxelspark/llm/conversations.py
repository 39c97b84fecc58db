"""Repair of conversation structure by a run-length dynamic programme.

A conversation's rows, in order, are a sequence of symbols: the initial of the role, and the first fault. Equal
consecutive symbols are collapsed to runs. The cheapest edits are found over the states of a conversation so far
(nothing yet, after a system turn, after a user, after an assistant): a symbol is a 4 x 4 transition in the min-plus
algebra, whose binary powers are cached, so a run of any length advances the costs by a few products. Choices are then
unrolled for the audit, halving runs; a half that starts and ends as the other does repeats its edits.

Spark deals the rows out:

* equal rows of a turn are counted before anything moves, so a row that comes many times is one row with a number;
* what was said earlier in a conversation is told by the first turn of each (role, text), found by partial aggregates
  and met by the whole key, so no conversation and no text is a hot key;
* rows are range-partitioned by conversation and turn, so a conversation of any length may go over many tasks. A task
  finishes every conversation that it holds whole. Of the one that it starts with and the one that it ends with, a piece,
  it returns the runs and their product. Pieces (two a task at most) are joined by these products: the costs to the
  right of each, then for each state on the left the edits, then the states from left to right.

Texts of such conversations are streamed in order to one task each for their SHA-256, which has no parallel form.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, text_batches

# Costs of the edits, and of a truncated row that stays.
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after a system turn, after a user, after an assistant. What a user or assistant turn leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
FAR = 1 << 60
#: Symbols: BAD (blank or duplicate: only deleted), or the role's initial (place in ROLES), and 4 more if truncated.
ROLES, BAD = "suax", 8
Costs = tuple[int, ...]
Matrix = tuple[Costs, ...]


def times(m: Matrix, v: Costs) -> Costs:
    return tuple(min(FAR, *(a + b for a, b in zip(row, v, strict=True))) for row in m)


def product(a: Matrix, b: Matrix) -> Matrix:
    columns = tuple(zip(*b, strict=True))
    return tuple(tuple(min(FAR, *(x + y for x, y in zip(row, c, strict=True))) for c in columns) for row in a)


UNIT: Matrix = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))
#: Inserted turns, none or as many as help, from each state.
INSERTS: Matrix = tuple(tuple(0 if i == j else INSERT if NEXT[i] == j else 2 * INSERT if NEXT[NEXT[i]] == j else FAR for j in range(4)) for i in range(4))
#: Costs after the last row: a conversation is empty or ends with an assistant.
END: Costs = times(INSERTS, (0, FAR, FAR, 0))


def kept_state(symbol: int, state: int) -> int | None:
    """The state after the row is kept as it is."""
    role = ROLES[symbol % 4]
    if symbol == BAD or role == "x":
        return None
    if role == "s":
        return SYSTEM if state == START else None
    to = NEXT[state]
    return to if (to == USER) == (role == "u") else None


@cache
def transition(symbol: int, power: int = 0) -> Matrix:
    """Least costs of 2 ** power rows of one symbol, with turns inserted before them."""
    if power:
        half = transition(symbol, power - 1)
        return product(half, half)
    rows = []
    for state in range(4):
        row = [FAR] * 4
        row[state] = DELETE
        if symbol != BAD:
            left = TRUNCATED if symbol >= 4 else 0
            row[NEXT[state]] = min(row[NEXT[state]], RELABEL + left)
            if (to := kept_state(symbol, state)) is not None:
                row[to] = min(row[to], left)
        rows.append(tuple(row))
    return product(INSERTS, tuple(rows))


def advance(symbol: int, count: int, v: Costs) -> Costs:
    """Costs to the end from before `count` rows of a symbol, from those after them."""
    power = 0
    while count:
        if count & 1:
            v = times(transition(symbol, power), v)
        count, power = count >> 1, power + 1
    return v


def whole(runs: list[tuple[int, int]]) -> Matrix:
    """The product of all runs."""
    out = UNIT
    for symbol, count in runs:
        power = 0
        while count:
            if count & 1:
                out = product(out, transition(symbol, power))
            count, power = count >> 1, power + 1
    return out


def choose(symbol: int, state: int, after: Costs) -> tuple[str, int]:
    """The edits, the last one of a row, that are cheapest; of these, the first by letters: D, I, K, R."""
    now, edits = advance(symbol, 1, after), ""
    left = TRUNCATED if symbol >= 4 else 0
    while True:
        if DELETE + after[state] == now[state]:
            return edits + "D", state
        if INSERT + now[NEXT[state]] == now[state]:
            edits, state = edits + "I", NEXT[state]
            continue
        if (to := kept_state(symbol, state)) is not None and left + after[to] == now[state]:
            return edits + "K", to
        return edits + "R", NEXT[state]


def unroll(symbol: int, count: int, state: int, after: Costs) -> tuple[str, int]:
    """The edits of a run, and the state after it."""
    if count == 1:
        return choose(symbol, state, after)
    second = count // 2
    middle = advance(symbol, second, after)
    edits, there = unroll(symbol, count - second, state, middle)
    if there == state and 2 * second == count and len({a - b for a, b in zip(middle, after, strict=True) if a < FAR or b < FAR}) == 1:
        return edits * 2, state  # the second half sees the same differences of costs
    more, there = unroll(symbol, second, there, after)
    return edits + more, there


def audit(runs: list[tuple[int, int]], state: int, after: Costs) -> tuple[str, int]:
    """The edits of all runs from a state, and the state after them."""
    costs = [after]
    for symbol, count in reversed(runs):
        costs.append(advance(symbol, count, costs[-1]))
    edits = []
    for (symbol, count), v in zip(runs, reversed(costs[:-1]), strict=True):
        e, state = unroll(symbol, count, state, v)
        edits.append(e)
    return "".join(edits), state


def closing(state: int) -> str:
    """Turns inserted after the last row."""
    return "I" * {SYSTEM: 2, USER: 1}.get(state, 0)


class Repaired:
    """Takes the rows of a conversation in order and gives the turns that its edits leave, as (edit, role, text)."""

    def __init__(self, edits: str) -> None:
        self.edits, self.at, self.state = edits, 0, START

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.edits[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            yield "I", self.speaker(), ""

    def speaker(self) -> str:
        return "user" if self.state == USER else "assistant"

    def row(self, role: str, text: str, count: int) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.edits[self.at]
        if edit == "R":
            self.state = NEXT[self.state]
            yield edit, self.speaker(), text
        elif edit == "K":
            self.state = SYSTEM if role[:1] == "s" else NEXT[self.state]
            yield edit, role, text
        self.at += count  # further copies are deleted, before anything is inserted


class Seen:
    """What is counted over the rows of a conversation, or of a piece of it, in order."""

    def __init__(self) -> None:
        self.runs: list[tuple[int, int]] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.first = self.last = None

    def row(self, turn: int | None, initial: str, symbol: int, blank: bool, count: int) -> None:
        for s, n in ((symbol, 1), (BAD, count - 1)):
            if n and self.runs and self.runs[-1][0] == s:
                self.runs[-1] = (s, self.runs[-1][1] + n)
            elif n:
                self.runs.append((s, n))
        self.blank += count if blank else 0
        self.duplicate += 0 if blank else count if symbol == BAD else count - 1
        self.truncated += BAD > symbol >= 4
        self.illegal += count - 1 + (self.last is not None and not legal(self.last, initial))
        if turn is not None:
            self.turns += turn != self.most  # turns do not fall
            self.least, self.most = turn if self.least is None else self.least, turn
        self.first, self.last = initial if self.first is None else self.first, initial

    def numbers(self) -> list:
        return [self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.least, self.most, self.first, self.last]

    def gaps(self) -> int:
        return 0 if self.most is None else self.most - self.least + 1 - self.turns

    @staticmethod
    def joined(pieces: list[list]) -> Seen:
        """Of the numbers of neighbouring pieces."""
        out = Seen()
        for blank, duplicate, truncated, illegal, turns, least, most, first, last in pieces:
            out.illegal += illegal + (out.last is not None and not legal(out.last, first))
            out.blank, out.duplicate, out.truncated = out.blank + blank, out.duplicate + duplicate, out.truncated + truncated
            if least is not None:
                out.turns += turns - (least == out.most)
                out.least, out.most = least if out.least is None else out.least, most
            out.first, out.last = first if out.first is None else out.first, last
        return out


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


# What the tasks return: reports of conversations, turns of repaired ones, pieces, and the rows of pieces.
REPORT, TURN, PIECE, ROW = range(4)
OUT = pa.schema([("kind", pa.int32()), ("c", pa.string()), ("part", pa.int32()), ("i", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("edits", pa.string()), ("info", pa.string())])
OUT_SQL = "kind int, c string, part int, i long, role string, text string, n long, edits string, info string"
#: Characters of text that an Arrow batch of results has before it is sent.
SEND = 1 << 20


class Sender:
    """Collects results and hands them on in batches."""

    def __init__(self) -> None:
        self.rows, self.size = [], 0

    def add(self, **row) -> None:
        self.rows.append(row)
        self.size += 100 + sum(len(x) for x in row.values() if isinstance(x, str))

    def ready(self, most: int = SEND) -> Iterator[pa.RecordBatch]:
        if self.size > most:
            yield pa.RecordBatch.from_pylist(self.rows, schema=OUT)
            self.rows, self.size = [], 0


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _info(seen: Seen, cost: int, digest: str, turns: int) -> str:
    return json.dumps([seen.gaps(), seen.blank, seen.duplicate, seen.truncated, seen.illegal, cost, digest, turns])


def _report(out: Sender, c: str, seen: Seen, cost: int, edits: str, rows: Iterator[tuple], turns: bool) -> Iterator[pa.RecordBatch]:
    """Sends a conversation's turns, if they are wanted, and its report. rows: (role, text, count), in order."""
    repaired, digest, place = Repaired(edits), hashlib.sha256(), 0

    def said() -> Iterator[tuple[str, str, str]]:
        for row in rows:
            yield from repaired.row(*row)
        yield from repaired.inserted()

    for edit, role, text in said():
        digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if turns:
            out.add(kind=TURN, c=c, i=place, role=role, text=text, edits=edit)
            yield from out.ready()
        place += 1
    out.add(kind=REPORT, c=c, edits=edits, info=_info(seen, cost, digest.hexdigest(), place))
    yield from out.ready()


def _solve(turns: bool):
    """Rows of a range of conversations, in order -> OUT. Only the first and the last conversation may go on elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), Sender()
        now, seen, rows, is_first = None, Seen(), [], True

        def opened() -> None:
            for i, (role, text, n) in enumerate(rows):
                out.add(kind=ROW, c=now, part=part, i=i, role=role, text=text, n=n)

        def piece() -> None:
            out.add(kind=PIECE, c=now, part=part, edits=json.dumps(seen.runs), info=json.dumps([whole(seen.runs), seen.numbers()]))

        for c, turn, role, text, n, symbol, blank in _rows_of(batches):
            if c != now:
                if is_first and now is not None:
                    piece()
                    is_first = False
                elif now is not None:
                    edits, state = audit(seen.runs, START, END)
                    cost = seen_cost(seen.runs)
                    yield from _report(out, now, seen, cost, edits + closing(state), iter(rows), turns)
                now, seen, rows, place = c, Seen(), [], 0
            seen.row(turn, role[:1], symbol, blank, n)
            if is_first:
                out.add(kind=ROW, c=c, part=part, i=place, role=role, text=text, n=n)
                place += 1
                yield from out.ready()
            else:
                rows.append((role, text, n))
        if now is not None:
            opened()
            piece()
        yield from out.ready(-1)

    return run


def seen_cost(runs: list[tuple[int, int]]) -> int:
    v = END
    for symbol, count in reversed(runs):
        v = advance(symbol, count, v)
    return v[START]


def _unroll(after: dict[tuple[str, int], Costs]):
    """(c, part, edits: runs) of pieces -> for each state before a piece: its edits, and the state after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, part, runs in _rows_of(batches):
            found = [audit(json.loads(runs), state, after[c, part]) for state in range(4)]
            yield pa.RecordBatch.from_pylist([{"c": c, "part": part, "state": s, "edits": e, "to": to} for s, (e, to) in enumerate(found)], schema=UNROLLED)

    return run


UNROLLED = pa.schema([("c", pa.string()), ("part", pa.int32()), ("state", pa.int32()), ("edits", pa.string()), ("to", pa.int32())])


def _finish(turns: bool):
    """Rows by conversation: the piece with its edits and numbers first, then its rows in order -> OUT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender()
        for c, rows in groupby(_rows_of(batches), key=itemgetter(0)):
            _, _, _, _, edits, info = next(rows)
            cost, numbers = json.loads(info)
            yield from _report(out, c, Seen.joined(numbers), cost, edits, ((role, text, n) for _, role, text, n, _, _ in rows), turns)
        yield from out.ready(-1)

    return run


def ordered_rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(c, turn, role, text, n, symbol, blank): each different row once, n times; written once."""
    spaces = F.lit(" \t\n\x0b\x0c\r")
    rows = conversations.select(
        key(F.col(conv_col)).alias("c"),
        F.col(turn_col).isNotNull().alias("told"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(0).cast("long")).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
    ).withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    one = ["c", "told", "turn", "role", "sha"]
    counted = rows.groupBy(*one).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("c", "role", "sha").agg(F.min(F.struct("told", "turn")).alias("at"))
    first = first.select("c", "at.told", "at.turn", "role", "sha", F.lit(True).alias("is_first"))
    end = F.rtrim(F.col("text"), spaces)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = F.length(end) == 0
    symbol = F.when(blank | F.col("is_first").isNull(), BAD).otherwise(role + F.when(F.substring(end, -1, 1).isin(".", "!", "?"), 0).otherwise(4))
    return durable(counted.join(first, one, "left").select("c", "told", "turn", "role", "text", "n", symbol.cast("int").alias("symbol"), blank.alias("blank")))


def key(conv: Column) -> Column:
    return F.when(conv.isNull(), "n").otherwise(F.concat(F.lit("v"), conv.cast("string")))


def repaired(conversations: DataFrame, turns: bool, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """OUT of all conversations."""
    spark = conversations.sparkSession
    rows = ordered_rows(conversations, conv_col, turn_col, role_col, text_col)
    sent = [F.when(F.col("told"), F.col("turn")).alias("turn") if x == "turn" else F.col(x) for x in ("c", "turn", "role", "text", "n", "symbol", "blank")]
    with text_batches(spark):
        # Bounds of ranges hold the first characters of texts, as equal bounds only keep rows together.
        dealt = rows.repartitionByRange("c", "told", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("c", "told", "turn", "role", "text")
        solved = durable(dealt.select(*sent).mapInArrow(_solve(turns), OUT_SQL))

        # Two pieces a task at most: their products, not their rows or edits, reach the driver.
        pieces: dict[str, list] = {}
        for r in solved.where(F.col("kind") == PIECE).select("c", "part", "info").collect():
            pieces.setdefault(r["c"], []).append((r["part"], *json.loads(r["info"])))
        after: dict[tuple[str, int], Costs] = {}
        costs: dict[str, int] = {}
        for c, found in pieces.items():
            v = END
            for part, matrix, _ in sorted(found, reverse=True):
                after[c, part], v = v, times(matrix, v)
            costs[c] = v[START]
        unrolled = durable(solved.where(F.col("kind") == PIECE).select("c", "part", "edits").mapInArrow(_unroll(after), "c string, part int, state int, edits string, to int"))
        leads = {(r["c"], r["part"], r["state"]): r["to"] for r in unrolled.select("c", "part", "state", "to").collect()}
        chosen, heads = [], []
        for c, found in pieces.items():
            state = START
            for part, _, _ in sorted(found):
                chosen.append((c, part, state))
                state = leads[c, part, state]
            heads.append((c, closing(state), json.dumps([costs[c], [numbers for _, _, numbers in sorted(found)]])))
        way = spark.createDataFrame(chosen, "c string, part int, state int")
        heads = spark.createDataFrame(heads, "c string, closing string, info string")
        edits = unrolled.join(F.broadcast(way), ["c", "part", "state"]).groupBy("c").agg(F.sort_array(F.collect_list(F.struct("part", "edits"))).alias("e"))
        first = edits.join(F.broadcast(heads), "c").select("c", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("i"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n"), F.concat(F.array_join("e.edits", ""), "closing").alias("edits"), "info")
        open_rows = first.unionByName(solved.where(F.col("kind") == ROW).select("c", "part", "i", "role", "text", "n", "edits", "info"))
        streamed = open_rows.repartition("c").sortWithinPartitions("c", "part", "i").select("c", "role", "text", "n", "edits", "info")
        finished = durable(streamed.mapInArrow(_finish(turns), OUT_SQL))
    return solved.where(F.col("kind").isin(REPORT, TURN)).unionByName(finished)


def _conv(kind: str, name: str) -> Column:
    return F.when(F.col("c") != "n", F.expr(f"cast(substring(c, 2) as {kind})")).alias(name)


def repaired_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, place, role, text, edit): the turns of repaired conversations, places from 0. Cases as in repair_report."""
    found = repaired(conversations, True, conv_col, turn_col, role_col, text_col).where(F.col("kind") == TURN)
    return found.select(_conv(conversations.schema[conv_col].dataType.simpleString(), conv_col), F.col("i").alias("place"), "role", "text", F.col("edits").alias("edit"))


def repair_report(conversations: DataFrame, ids: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, n_turns.

    Rows are taken by turn (null first), then role and text, so ties have one order; equal rows are duplicates of the
    first. A null role or text is one space, a null conversation id is an id like others. audit has the initials of the
    cheapest edits that give role initials (s?(ua)+)?, of these the first in ASCII order. ids: a table with a column
    conv_col; its conversations without rows are reported with zeros, an empty audit and the hash of the empty text.
    Other columns are ignored, whatever their names. Texts of any length are one row; no rows and no ids give no rows.
    """
    kind = conversations.schema[conv_col].dataType.simpleString()
    found = repaired(conversations, False, conv_col, turn_col, role_col, text_col).where(F.col("kind") == REPORT)
    info = F.from_json("info", "array<string>")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = found.select("c", *[info[k].cast("long").alias(x) for k, x in enumerate(numbers)], F.col("edits").alias("audit"), info[6].alias("repaired_sha256"), info[7].cast("long").alias("n_turns"))
    if ids is not None:
        asked = ids.select(key(F.col(conv_col)).alias("c")).distinct()
        none = {x: F.lit(0).cast("long") for x in [*numbers, "n_turns"]} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
        out = asked.join(out, "c", "left").select("c", *[F.coalesce(x, none[x]).alias(x) for x in out.columns[1:]])
    return out.select(_conv(kind, conv_col), *out.columns[1:])


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with faults by a checksum of conversation and turn: a twentieth each is dropped,
    emptied, stripped of sentence ends, repeated, or given to the user. Null roles and texts become one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")), F.lit(20))
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    times_said = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    rows = conversations.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(told("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times_said)).alias("copy"))
    return rows.drop("copy")


REPAIR_SQL = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(
           string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ord(x)::UBIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: k::UBIGINT)),
                                    lambda x, k: xor(x >> 1, (x & 1) * 3988292384::UBIGINT)))) % 20 AS fault
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM src, range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (
  SELECT c, turn, role, text, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed,
         row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i
  FROM damaged d JOIN ids ON d.conv_id IS NOT DISTINCT FROM ids.conv_id),
rows AS (
  SELECT *, trimmed = '' AS blank, trimmed <> '' AND row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS duplicate,
         lag(initial) OVER (PARTITION BY c ORDER BY i) AS before
  FROM placed),
faults AS (
  SELECT *, NOT blank AND NOT duplicate AND right(trimmed, 1) NOT IN ('.', '!', '?') AS truncated FROM rows),
-- States: 0 nothing yet, 1 after a system turn, 2 after a user, 3 after an assistant.
inserts(state, into_state, extra, letters) AS (
  VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (2, 3, 5, 'I'), (3, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')),
edits(state, into_state, kind, initial) AS (
  VALUES (0, 0, 'D', ''), (1, 1, 'D', ''), (2, 2, 'D', ''), (3, 3, 'D', ''), (0, 2, 'R', ''), (1, 2, 'R', ''), (2, 3, 'R', ''), (3, 2, 'R', ''),
         (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (3, 2, 'K', 'u'), (2, 3, 'K', 'a')),
steps AS (
  SELECT c, i, e.state, n.into_state, CASE kind WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN truncated AND kind <> 'D' THEN 5 ELSE 0 END + extra AS cost, kind || letters AS letters
  FROM faults f JOIN edits e ON kind = 'D' OR NOT blank AND NOT duplicate AND (kind = 'R' OR e.initial = f.initial) JOIN inserts n ON n.state = e.into_state),
best(c, i, state, b) AS (
  SELECT c, 0, into_state, {'cost': extra, 'audit': letters} FROM ids, inserts WHERE state = 0
  UNION ALL
  SELECT s.c, s.i, s.into_state, min({'cost': b.b.cost + s.cost, 'audit': b.b.audit || s.letters})
  FROM best b JOIN steps s ON s.c = b.c AND s.i = b.i + 1 AND s.state = b.state
  GROUP BY s.c, s.i, s.into_state),
solved AS (
  SELECT c, min(b) AS b FROM best JOIN (SELECT c, max(i) AS i FROM faults GROUP BY c) USING (c, i) WHERE state IN (0, 3) GROUP BY c),
letters AS (
  SELECT c, k, b.audit[k] AS letter FROM (SELECT c, b, unnest(range(1, length(b.audit) + 1)) AS k FROM solved)),
turns AS (
  SELECT c, letter, count(*) FILTER (letter <> 'D') OVER upto AS place, count(*) FILTER (letter <> 'I') OVER upto AS i
  FROM letters WINDOW upto AS (PARTITION BY c ORDER BY k)),
said AS (
  SELECT t.c, place, letter, CASE WHEN letter = 'I' THEN '' ELSE text END AS text, role,
         bool_or(place = 1 AND letter = 'K' AND f.initial = 's') OVER (PARTITION BY t.c) AS system_first
  FROM turns t LEFT JOIN faults f ON f.c = t.c AND f.i = t.i WHERE letter <> 'D'),
digests AS (
  SELECT c, count(*) AS n_turns, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - CAST(system_first AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place) AS repaired
  FROM said GROUP BY c),
counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit,
       sha256(coalesce(repaired, '')) AS repaired_sha256, coalesce(n_turns, 0) AS n_turns
FROM ids LEFT JOIN counts USING (c) LEFT JOIN solved USING (c) LEFT JOIN digests USING (c)
"""
