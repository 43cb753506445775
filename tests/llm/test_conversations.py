"""Conversation repair against dynamic programming over whole conversations, and the damage row by row."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sparkselect.llm import conversation_repair as cr

ROW = "conv_id long, turn long, role string, text string, id long, part int, seq long, live boolean, same string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, 7, False, "x") for r in rows], ROW)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if n == 1:
            text = ""
        if n == 2:
            text = re.sub("[.!?]", "", text)
        out += [] if n == 0 else [(conv, turn, "user" if n == 4 else role, text)] * (2 if n == 3 else 1)
    return out


def cheapest(rows):
    """(cost, edits, output) by dynamic programming with the edits in ASCII order."""
    turn = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(2):
            for s, (c, e, o) in list(best.items()):
                new = (c + 5, e + "I", o + ((name[turn[s]], ""),))
                best[turn[s]] = min(best.get(turn[s], new), new)
        return best

    best = {"": (0, "", ())}
    for role, text, fault in rows:
        nxt = {}
        for s, (c, e, o) in inserted(best).items():
            steps = [(s, c + 2, "D", o)]
            if fault not in (1, 2):
                extra = 5 if fault == 3 else 0
                if (s, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    steps.append((role[:1], c + extra, "K", o + ((role, text),)))
                steps.append((turn[s], c + 1 + extra, "R", o + ((name[turn[s]], text),)))
            for t, cost, edit, out in steps:
                nxt[t] = min(nxt.get(t, (cost, e + edit, out)), (cost, e + edit, out))
        best = nxt
    best = inserted(best)
    return min(best[s] for s in ("", "a") if s in best)


def plain(rows, named=()):
    out = []
    convs = {r[0] for r in rows} | set(named)
    for conv in convs:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in own:
            last = text.rstrip(" \t\n\v\f\r")[-1:]
            faults.append(1 if not last else 2 if (role, text) in seen else 0 if last in ".!?" else 3)
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        initials = [r[2][:1] for r in own]
        cost, edits, fixed = cheapest([(r[2], r[3], f) for r, f in zip(own, faults)])
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
                    sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, edits,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()))
    return sorted(out, key=str)


def some_rows(rnd, convs, longest):
    rows = []
    for conv in convs:
        for turn in range(rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User", None])
            text = rnd.choice(["Yes.", "No", f"t{rnd.randint(0, 30)}!", f"t{rnd.randint(0, 9)} é?\n", "", " \t", "ok . ", None, "x" * 50 + "."])
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


def test_small_conversations(spark):
    rnd = random.Random(21)
    rows = some_rows(rnd, [None, *range(300)], 9)
    rows += rows[:20]
    got = sorted(map(tuple, cr.op13_frame(frame(spark, rows)).collect()), key=str)
    assert got == plain(damage(rows), {r[0] for r in rows})
    assert cr.op13_frame(frame(spark, [])).collect() == []


def test_long_conversations_over_chunks_and_partitions(spark):
    rnd = random.Random(22)
    rows = some_rows(rnd, [1], 9) + [r for c, n in ((2, 900), (3, 600)) for r in some_rows(rnd, [c], 2) + [(c, i // 2, rnd.choice(["user", "assistant"]), f"m{rnd.randint(0, 2000)}.") for i in range(n)]]
    rows += [(4, i, "system", "s" + str(i)) for i in range(300)] + [(5, None, None, None)] * 400
    rows += [(6, i, ("user", "assistant")[i % 2], "same.") for i in range(700)]
    repaired = sorted(map(tuple, cr.repair(frame(spark, rows).repartition(5)).collect()), key=str)
    whole = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert repaired == plain(whole)
    gone = sorted(map(tuple, cr.repair(frame(spark, rows), F.col("turn") % 2 == 0).where("conv_id = 4").collect()))
    assert gone == plain([r for r in whole if r[0] == 4 and r[1] % 2 == 0])


def test_every_small_lattice():
    """All row sequences of up to four rows over roles and faults, in blocks of two rows."""
    kinds = list(itertools.product("usx", (0, 1, 3))) + [("a", 0), ("a", 3)]
    step, cr.STEP = cr.STEP, 2
    try:
        for n in range(5):
            for rows in itertools.islice(itertools.product(kinds, repeat=n), 0, None, 1 if n < 4 else 3):
                cost = cr.chunk_prices(list(rows), list(cr.END), [0])[0]
                audit, state = cr.chunk_traces(list(rows), list(cr.END), [0])[0]
                best = cheapest([(r, "", f) for r, f in rows])
                assert (cost, audit + cr.END_EDITS[state]) == best[:2], rows
    finally:
        cr.STEP = step


@pytest.mark.parametrize("rows", [[("u", 0), ("a", 3), ("s", 0)], [("x", 3)] * 40, [("u", 0), ("u", 0)] * 20])
def test_prices_are_dual_feasible_and_tight_on_the_path(rows):
    lattice, price = cr.solve(rows, list(cr.END), [0])
    for i, own in enumerate(lattice):
        assert all(price[i] <= cost + price[j] for cost, j, _ in own)
    labels, _ = cr.trace(lattice, price, 0)
    assert labels
