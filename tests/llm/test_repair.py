"""Conversation repair: the auction against all edit sequences and a plain dynamic program, the operator against a plain version."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from skerry.llm.repair import Auction, cheapest_edits, code_of, repair

LEGAL = re.compile(r"(s?(ua)+)?")


def _best(rows):
    """Least (cost, letters) over ``(initial, must_go, truncated)`` rows, by a dynamic program over whole strings of letters."""
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def closed(layer):
        for _ in range(4):
            for state, (cost, letters) in list(layer.items()):
                for r in "ua":
                    if r in moves[state]:
                        new = (cost + 2, letters + "I")
                        layer[r] = min(layer.get(r, new), new)
        return layer

    layer = closed({"": (0, "")})
    for initial, must_go, truncated in rows:
        after = {}
        for state, (cost, letters) in layer.items():
            options = [(state, cost + 3, "D")]
            if not must_go:
                if initial in moves[state]:
                    options.append((initial, cost + truncated, "K"))
                options += [(r, cost + 2 + truncated, "R") for r in "ua" if r in moves[state]]
            for to, c, x in options:
                new = (c, letters + x)
                after[to] = min(after.get(to, new), new)
        layer = closed(after)
    return min(layer[s] for s in ("", "a") if s in layer)


def _all_edits(rows, longest):
    """Least (cost, letters) among all edit sequences with at most two insertions at a place."""
    best = None
    inserts = ["", "u", "a", "uu", "ua", "au", "aa"]
    kinds = [[("D", "", 3)] + ([] if g else [("K", i, t), ("R", "u", 2 + t), ("R", "a", 2 + t)]) for i, g, t in rows]
    for choice in product(*kinds):
        for places in product(inserts, repeat=len(rows) + 1):
            said = places[0] + "".join(c[1] + p for c, p in zip(choice, places[1:]))
            if LEGAL.fullmatch(said):
                cost = sum(c[2] for c in choice) + 2 * sum(map(len, places))
                letters = "I" * len(places[0]) + "".join(c[0] + "I" * len(p) for c, p in zip(choice, places[1:]))
                best = min(best or (cost, letters), (cost, letters))
    return best


def _random_rows(rng, n):
    return [(rng.choice("ssuuuaaax"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]


def test_auction_against_all_edits():
    rng = random.Random(1)
    for n in (0, 1, 1, 2, 2, 2, 3, 3, 3, 3):
        rows = _random_rows(rng, n)
        assert cheapest_edits(bytes(code_of(*r) for r in rows)) == _all_edits(rows, 2), rows


@pytest.mark.parametrize("chunk", [1, 2, 5, 32, 1000])
def test_auction_against_dynamic_program(chunk):
    rng = random.Random(chunk)
    for _ in range(60):
        rows = _random_rows(rng, rng.randint(0, 60))
        assert cheapest_edits(bytes(code_of(*r) for r in rows), chunk) == _best(rows), rows


def test_prices_obey_complementary_slackness():
    rng = random.Random(9)
    for _ in range(20):
        lattice = Auction(bytes(code_of(*r) for r in _random_rows(rng, 12)), None)
        before = list(lattice.price)
        for origin in (0, 3, 1, 20):
            lattice.settle(origin)
            assert all(a <= b for a, b in zip(before, lattice.price))
            before = list(lattice.price)
            assert all(lattice.price[i] <= cost + lattice.price[to] for i, arcs in enumerate(lattice.arcs) for _, to, cost in arcs)


def test_long_conversations_take_time_in_proportion():
    rows = _random_rows(random.Random(2), 40_000)
    codes = bytes(code_of(*r) for r in rows)
    cost, letters = cheapest_edits(codes)
    assert sum(x != "I" for x in letters) == len(rows) and cost > 0
    assert cheapest_edits(codes[:3000], 32) == cheapest_edits(codes[:3000], 64)


def _plain(table):
    blanks = " \t\n\x0b\x0c\r"
    given = {}
    for conv, turn, role, text, *_ in table:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        rows = given.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in given.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in rows:
            shown = text.rstrip(blanks)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [role[:1] for _, role, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, letters = _best([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults)])
        said, last, left = [], "", list(rows)
        for x in letters:
            due = "assistant" if last == "u" else "user"
            if x == "I":
                said.append(f"{due}:")
                last = due[0]
                continue
            _, role, text = left.pop(0)
            if x != "D":
                role = role if x == "K" else due
                said.append(f"{role}:{text}")
                last = role[0]
        assert LEGAL.fullmatch("".join(s[0] for s in said))
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, letters, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return out


def _table():
    rng, rows = random.Random(4), []
    texts = ["One.", "Two!", "Cut off", "", " \n", None, "Why? ", "a\xa0", "Said twice.", "x\x1f", "é.", "　"]
    for conv in [*range(40), None, -3]:
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, 2 * turn, None]), rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", "", "unknown"]), rng.choice(texts), "extra", 1))
    rows += [(100, t, ("user", "assistant")[t % 2], f"Turn {t}." if t % 11 else f"Turn {t}", "x", 2) for t in range(500)]
    rows += [(101, 5, "user", "Same.", "x", 2)] * 3
    rows += [(c, t, "user", "alone", "x", 2) for c in range(200, 260) for t in (0,)]  # some of these are left without rows
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string, pos string, cost int"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_against_plain_version(spark):
    got = repair(spark.createDataFrame(_table(), SCHEMA))
    assert got.columns == COLUMNS and [t for _, t in got.dtypes][1:7] == ["bigint"] * 6
    key = lambda r: (r[0] is not None, r[0] or 0)
    want = sorted(_plain(_table()), key=key)
    assert sorted(map(tuple, got.collect()), key=key) == want
    assert any(r[7] == "" for r in want)


def test_repair_of_no_rows(spark):
    assert repair(spark.createDataFrame([], SCHEMA)).collect() == []
