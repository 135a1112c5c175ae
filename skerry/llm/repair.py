"""Conversation repair: cheapest edits to legal roles by an auction algorithm for shortest paths.

Edits of a conversation are paths through a lattice. A node is a row and what was said last (nothing,
system, user, assistant); Keep, Rerole and Delete lead to the next row, Insert stays at the row. Every
node has a price. The path that starts at the origin is contracted, raising the price of its last node
to the least ``cost + price`` of its arcs, where the price is below that, and otherwise extended along
the arc of that least sum, until it reaches the end. The prices of a finished path's nodes are exact
distances, and an arc is on some cheapest path if and only if it is tight, ``price = cost + price``,
between exact prices. The edits are traced over tight arcs, the least letter first.

Conversations are cut into chunks of ``CHUNK`` rows; the prices at a chunk's start are the costs of
leaving the chunk before it, so prices are settled from the last chunk to the first and traced from the
first to the last. Equal chunks are solved once.

A conversation is one sequence and its hash is sequential, so its rows pass through one task, sorted by
Spark. A task holds a byte a row for one conversation, never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.scratch import Scratch

CHUNK = 32
BLANKS = " \t\n\x0b\x0c\r"
_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
_AFTER = {"s": {_NOTHING: _SYSTEM}, "u": {_NOTHING: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}, "": {}}
_INITIALS = ("s", "u", "a", "")
#: State that an inserted or renamed row leads to; it is an assistant after a user and a user otherwise.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_DELETE, _INSERT, _KEEP, _RENAME = 3, 2, 0, 2


def code_of(initial: str, must_go: bool, truncated: bool) -> int:
    """A row as one byte: 0 must be deleted; else the initial and whether keeping it costs one more."""
    return 0 if must_go else 1 + 2 * _INITIALS.index(initial if initial in ("s", "u", "a") else "") + truncated


def _arcs(code: int, state: int) -> list[tuple[str, int, int, int]]:
    """``(letter, rows passed, next state, cost)``, letters ascending."""
    arcs = [("D", 1, state, _DELETE), ("I", 0, _NEXT[state], _INSERT)]
    if code:
        initial, more = _INITIALS[(code - 1) // 2], (code - 1) % 2
        if state in _AFTER[initial]:
            arcs.append(("K", 1, _AFTER[initial][state], _KEEP + more))
        arcs.append(("R", 1, _NEXT[state], _RENAME + more))
    return arcs


_ARCS = [[_arcs(code, state) for state in range(4)] for code in range(9)]


class Auction:
    """Prices over one chunk's lattice; node ``4 * row + state``, and the end behind the last row's nodes.

    ``leaving`` has the cost of leaving the chunk from each state; None stands for the conversation's
    end, where only nothing and an assistant may be last and rows may still be inserted.
    """

    def __init__(self, codes: bytes, leaving: tuple[int, ...] | None):
        last = 4 * len(codes)
        self.end = last + 4
        self.arcs: list[list[tuple[str, int, int]]] = [[(x, node - node % 4 + 4 * rows + to, cost) for x, rows, to, cost in _ARCS[codes[node // 4]][node % 4]] for node in range(last)]
        for state in range(4):
            if leaving is not None:
                self.arcs.append([("", self.end, leaving[state])])
            else:
                stop = [("", self.end, 0)] if state in (_NOTHING, _ASSISTANT) else []
                self.arcs.append([*stop, ("I", last + _NEXT[state], _INSERT)])
        self.price = [0] * (self.end + 1)
        self.exact = [False] * self.end + [True]

    def settle(self, origin: int) -> int:
        """Run the auction from ``origin`` until its price is exact. Prices of other origins' runs are kept: they only rise."""
        price, path = self.price, [origin]
        while not self.exact[path[-1]]:
            node = path[-1]
            least, to = min((cost + price[to], to) for _, to, cost in self.arcs[node])
            if price[node] < least:
                price[node] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        for node in path:
            self.exact[node] = True
        return price[origin]

    def trace(self, state: int) -> tuple[str, int]:
        """The least of the cheapest edits' letters from a state on, and the state in which the chunk is left."""
        node, letters = state, []
        self.settle(node)
        while True:
            for letter, to, cost in self.arcs[node]:
                # a price that isn't exact is too low, so an arc that isn't tight with it never will be
                if self.price[node] >= cost + self.price[to] and self.price[node] == cost + self.settle(to) if to != self.end else self.price[node] == cost:
                    break
            letters.append(letter)
            if to == self.end:
                return "".join(letters), node % 4
            node = to


@lru_cache(maxsize=1 << 14)
def _entering(codes: bytes, leaving: tuple[int, ...] | None) -> tuple[int, ...]:
    lattice = Auction(codes, leaving)
    return tuple(lattice.settle(state) for state in range(4))


@lru_cache(maxsize=1 << 14)
def _traced(codes: bytes, leaving: tuple[int, ...] | None, state: int) -> tuple[str, int]:
    return Auction(codes, leaving).trace(state)


def cheapest_edits(codes: bytes, chunk: int = CHUNK) -> tuple[int, str]:
    """Cost and letters of a conversation's edits."""
    parts = [codes[i : i + chunk] for i in range(0, len(codes), chunk)] or [b""]
    leaving: list[tuple[int, ...] | None] = [None] * len(parts)
    cost = 0
    for k in range(len(parts) - 1, 0, -1):
        prices = _entering(parts[k], leaving[k])
        low = min(prices)  # prices stay small: only differences matter within a chunk
        cost += low
        leaving[k - 1] = tuple(p - low for p in prices)
    cost += _entering(parts[0], leaving[0])[_NOTHING]
    state, letters = _NOTHING, []
    for part, out in zip(parts, leaving):
        piece, state = _traced(part, out, state)
        letters.append(piece)
    return cost, "".join(letters)


class _Repaired:
    """Hash of one conversation's repaired rows, which come one by one."""

    def __init__(self, letters: str):
        self.letters, self.at, self.state = letters, 0, _NOTHING
        self.hash, self.empty = hashlib.sha256(), True

    def _say(self, role: str, text: str, state: int) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty, self.state = False, state

    def _due(self) -> tuple[str, int]:
        to = _NEXT[self.state]
        return ("assistant" if to == _ASSISTANT else "user"), to

    def insert(self) -> None:
        while self.letters[self.at : self.at + 1] == "I":
            role, to = self._due()
            self._say(role, "", to)
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.insert()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self._say(role, text, _AFTER[role[:1]][self.state])
        elif letter == "R":
            due, to = self._due()
            self._say(due, text, to)

    def close(self) -> str:
        self.insert()
        return self.hash.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that a CRC-32 of ``conv_id:turn`` chooses."""
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def judged(rows: DataFrame) -> DataFrame:
    """The rows with ``pos`` in their conversation, ``initial``, ``fault`` (the first one or null), whether the role may follow and the turn is new.

    One shuffle, by conversation; both windows and their sorts stay in it.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    seen = Window.partitionBy("conv_id", "role", "text").orderBy("pos")
    initial = F.substring("role", 1, 1)
    shown = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.withColumn("initial", initial)
    rows = rows.withColumns({"pos": F.row_number().over(order).cast("long"), "before": F.lag(F.concat("initial", F.lit("|"))).over(order), "turn_before": F.lag("turn").over(order)})
    fault = F.when(shown == "", "blank").when(F.row_number().over(seen) > 1, "duplicate").when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), "truncated")
    illegal = F.col("before").isNotNull() & ~F.concat("before", "initial").isin("s|u", "u|a", "a|u")
    new_turn = F.col("turn").isNotNull() & ~F.coalesce(F.col("turn") == F.col("turn_before"), F.lit(False))
    return rows.select("conv_id", "turn", "pos", "role", "text", "initial", fault.alias("fault"), illegal.alias("illegal"), new_turn.alias("new_turn"))


def _row_code() -> Column:
    kind = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    return F.when(F.col("fault").isin("blank", "duplicate"), 0).otherwise(1 + 2 * kind + F.when(F.col("fault") == "truncated", 1).otherwise(0)).cast("tinyint")


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos")


def repair(conversations: DataFrame) -> DataFrame:
    """Faults, cheapest edits and the repaired text's hash of every original conversation, after the damage.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``. Null values
    count as one space, a null turn comes first, and rows without a ``conv_id`` are one conversation. Rows
    of one turn are taken by role, then text; repeated rows are duplicates. A conversation without rows
    after the damage has zeros, an empty audit and the hash of nothing; an empty table gives no rows. Other
    columns are not read. Roles count by their first character; one that is not s, u or a can't be kept.
    """
    scratch = Scratch(conversations.sparkSession, "repair")
    given = conversations.select(conversations["conv_id"], conversations["turn"].cast("long").alias("turn"), conversations["role"].alias("role"), conversations["text"].alias("text"))
    kind = given.schema["conv_id"].dataType.simpleString()
    rows = scratch.write(judged(damaged(given)), "rows")
    count = lambda what: F.count(F.when(what, 1))
    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - count(F.col("new_turn")), F.lit(0).cast("long"))
    stats = rows.groupBy("conv_id").agg(span.alias("gaps"), *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], count(F.col("illegal")).alias("illegal"))

    def edits(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _batched(((conv, *cheapest_edits(bytes(codes))) for conv, codes in _gathered(arrow)), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names=["conv_id", "cost", "audit"])

    kinds = (pa.string(), pa.int64(), pa.string())
    coded = _together(rows.select(F.col("conv_id").cast("string").alias("conv_id"), "pos", _row_code().alias("code")))
    audits = scratch.write(coded.mapInArrow(edits, "conv_id string, cost bigint, audit string"), "edits")

    def hashes(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _batched(_hashed(arrow), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some)], names=["conv_id", "repaired_sha256"])

    texts = rows.select(F.col("conv_id").cast("string").alias("conv_id"), "pos", "role", "text")
    texts = texts.union(audits.select("conv_id", F.lit(0).cast("long"), F.lit(""), "audit"))  # before the first row
    hashed = _together(texts).mapInArrow(hashes, "conv_id string, repaired_sha256 string")
    audits, hashed = (x.withColumn("conv_id", F.col("conv_id").cast(kind)) for x in (audits, hashed))
    parts = [given.select("conv_id").distinct(), stats, audits, hashed]
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy("conv_id")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.agg(
        *[F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(nothing)).alias("repaired_sha256")
    )


def _gathered(arrow: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, bytearray]]:
    """Each conversation and its rows' codes."""
    now, codes = None, bytearray()
    for batch in arrow:
        for conv, code in zip(batch.column("conv_id").to_pylist(), batch.column("code").to_pylist()):
            if codes and conv != now:
                yield now, codes
                codes = bytearray()
            now = conv
            codes.append(code)
    if codes:
        yield now, codes


def _hashed(arrow: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, str]]:
    now, repaired = None, None
    for batch in arrow:
        for conv, pos, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "pos", "role", "text"))):
            if pos == 0:
                if repaired:
                    yield now, repaired.close()
                now, repaired = conv, _Repaired(text)
            else:
                repaired.row(role, text)
    if repaired:
        yield now, repaired.close()


def _batched(rows: Iterator[tuple], most: int) -> Iterator[list[tuple]]:
    some = []
    for row in rows:
        some.append(row)
        if len(some) == most:
            yield some
            some = []
    if some:
        yield some
