"""Conversation repair against a recursive search over all edits."""

import hashlib
import random
import zlib
from functools import cache

import numpy as np
import pytest

from assay.llm import conversations, registry

SPACE = " \t\n\x0b\x0c\r"


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(name.encode()) % 20
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def repair_by_hand(rows, damage=True):
    groups = {r[0]: [] for r in rows}
    for r in damaged_by_hand(rows) if damage else rows:
        groups[r[0]].append((r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in own if r[0] is not None]
        seen, faults = set(), []
        for _, role, text in own:
            body = text.rstrip(SPACE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        letters = [r[1][:1] for r in own]

        def legal(roles):
            rest = roles[1:] if roles[:1] == "s" else roles
            return all(x == "ua"[i % 2] for i, x in enumerate(rest))

        @cache
        def best(i, roles_so_far):
            """Cheapest (cost, edits); roles written are told apart by system row, parity and emptiness only."""
            ways = [(0, "")] if i == len(own) and roles_so_far in ("", "ua", "sua") else []

            def step(cost, letter, roles, j, room):
                if legal(roles):
                    short = roles if len(roles.lstrip("s")) < 3 else ("s" if roles[0] == "s" else "") + roles.lstrip("s")[2:]
                    got = inner(j, short, room)
                    if got:
                        ways.append((cost + got[0], letter + got[1]))

            if i < len(own):
                step(4, "D", roles_so_far, i + 1, 2)
                if faults[i] in ("", "truncated"):
                    more = 3 if faults[i] else 0
                    if letters[i] in ("s", "u", "a"):
                        step(more, "K", roles_so_far + letters[i], i + 1, 2)
                    for x in "ua":
                        step(3 + more, "R", roles_so_far + x, i + 1, 2)
            return ways

        @cache
        def inner(i, roles, room):
            ways = list(best(i, roles))
            if room:
                for x in "ua":
                    new = roles + x
                    if legal(new):
                        short = new if len(new.lstrip("s")) < 3 else ("s" if new[0] == "s" else "") + new.lstrip("s")[2:]
                        got = inner(i, short, room - 1)
                        if got:
                            ways.append((3 + got[0], "I" + got[1]))
            return min(ways) if ways else None

        cost, audit = inner(0, "", 2)
        i, text = 0, []
        for e in audit:
            if e == "D":
                i += 1
                continue
            last = text[-1].split(":")[0][:1] if text else ""
            role = own[i][1] if e == "K" else "assistant" if last == "u" else "user"
            text.append(f"{role}:{'' if e == 'I' else own[i][2]}")
            i += e != "I"
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(x) for x in conversations.FAULTS],
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])), cost, audit,
                     hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: tuple(r)[1:9] for r in df.collect()}


def random_rows(seed, convs, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why?", "a.\nb", "ok. ", None]
    return [(c, rng.choice([None, *range(longest)]) if rng.random() < 0.2 else t, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]),
             rng.choice(texts) if rng.random() < 0.7 else f"Text {rng.random()}.")
            for c in [*range(convs), None] for t in range(rng.randint(1, longest))]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("segment_rows", [1, 3, 1024])
def test_random_conversations(spark, segment_rows):
    rows = random_rows(segment_rows, 60, 14)
    rows += rows[::7]  # repeated rows
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for damaged in (True, False):
        assert got(conversations.repair(df, damaged=damaged, segment_rows=segment_rows)) == repair_by_hand(rows, damaged)


def test_one_long_conversation(spark):
    rows = [(1, t, ["user", "assistant", "assistant", "user", "tool"][t * t % 5], "word" if t % 7 == 0 else f"Turn {t % 400}.") for t in range(1500)] + [(2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    a, b = (got(conversations.repair(df, segment_rows=n)) for n in (64, 1024))
    assert a == b and len(a[1][6]) > 1000
    short = [r for r in rows if r[1] < 150]
    assert got(conversations.repair(spark.createDataFrame(short, SCHEMA), segment_rows=16)) == repair_by_hand(short, False)


def test_rows_come_back(spark):
    rows = [("x", 1, "user", "Hi."), ("x", 2, "user", "Hi."), ("x", 4, "tool", "Tell me"), (None, None, None, None)]
    out = {r.conv_id: r for r in conversations.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"), with_rows=True).collect()}
    assert out["x"].audit == "KDR" and [tuple(r) for r in out["x"].repaired] == [("user", "Hi."), ("assistant", "Tell me")]
    assert out["x"].gaps == 1 and out["x"].cost == 10 and out[None].blank == 1 and out[None].audit == "D" and out[None].repaired == []


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(empty).count() == 0
    extra = spark.createDataFrame([(1, 0, "user", "A.", 5, 6), (1, 1, "assistant", "b" * 100_000 + ".", 5, 6)], SCHEMA + ", conv int, fault int")
    assert got(conversations.repair(extra))[1][5:7] == (0, "KK")


def test_ranks_order_paths():
    """Least paths of a segment whose cheapest edits tie in many ways."""
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 9))
        initial, fault = rng.integers(0, 4, n), rng.choice([0, 0, 1, 3], n)
        edits, state, cost = conversations.least_paths(np.array([0, n]), initial, fault, conversations.END[None, :], np.array([[0, 0]]))
        rows = [(0, i, " sua"[x], ["T%d." % i, "", None, "t%d" % i][f]) for i, (x, f) in enumerate(zip(initial, fault))]
        assert (cost[0], edits[0] + conversations.AT_END[state[0]]) == repair_by_hand(rows, False)[0][5:7]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, sf):
    rows = [tuple(r) for r in registry.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got(registry.op13_conversation_repair(spark, sf)) == repair_by_hand(rows)
