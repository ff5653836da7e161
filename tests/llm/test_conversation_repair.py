"""Conversation repair against an exhaustive search, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from quarry.llm import conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, n long, piece string, kept string, conv string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "k", "c") for r in rows], SCHEMA)


def searched(turns):
    """(cost, audit, lines) by trying all edits; ``turns`` are (role, text, fault)."""
    n = len(turns)

    @lru_cache(None)
    def best(i, done, inserted):
        # ``done`` is what the next turn may be: s or u at first, then u and a in turn.
        found = []
        if i == n and done in ("", "a"):
            found.append((0, "", ()))
        if inserted < 3:
            role = "a" if done == "u" else "u"
            cost, audit, lines = best(i, role, inserted + 1)
            found.append((5 + cost, "I" + audit, ({"u": "user", "a": "assistant"}[role] + ":", *lines)))
        if i < n:
            role, text, fault = turns[i]
            cost, audit, lines = best(i + 1, done, 0)
            found.append((2 + cost, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                more, initial = 5 * (fault == "truncated"), role[:1]
                fits = {"": "su", "s": "u", "u": "a", "a": "u"}[done]
                if initial and initial in fits:
                    cost, audit, lines = best(i + 1, initial, 0)
                    found.append((more + cost, "K" + audit, (f"{role}:{text}", *lines)))
                given = "a" if done == "u" else "u"
                cost, audit, lines = best(i + 1, given, 0)
                found.append((1 + more + cost, "R" + audit, ({"u": "user", "a": "assistant"}[given] + f":{text}", *lines)))
        return min(found, default=(10**9, "", ()))

    for i in range(n, -1, -1):  # from the end, so that no call goes deep
        for done in ("", "s", "u", "a"):
            best(i, done, 0)
    return best(0, "", 0)


def expected(rows):
    """The report's row for one conversation's rows (turn, role, text)."""
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r[2])))
    seen, turns = set(), []
    for _, role, text in rows:
        body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        turns.append((role, text, fault))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    counts = [sum(f == k for _, _, f in turns) for k in ("blank", "duplicate", "truncated")]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    cost, audit, lines = searched(tuple(turns))
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def made(rng, conv, length):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]
    texts = ["Yes.", "No!", "cut off", " \n", None, "", "Why? ", "a.b", "Größe.\n\n"]
    rows = []
    for turn in range(length):
        number = rng.choice([turn, turn, turn + rng.randint(0, 3), None])
        text = rng.choice(texts) if rng.random() < 0.5 else f"Turn {rng.randint(0, 6)}{rng.choice(['.', '!', ''])}"
        rows += [(conv, number, rng.choice(roles[: rng.choice([2, 4, 9])]), text)] * rng.choice([1, 1, 1, 2, 4])
    return rows


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(31)
    out = [r for conv in [*range(150), None] for r in made(rng, conv, rng.randint(1, 14))]
    out += [(200, None, "user", None), (200, None, None, "x."), (201, 5, "user", "Only one.")]
    return out + [(202, t, "user", f"Long {t}.") for t in range(300)] + [(203, 1, "assistant", "Same.")] * 500


def report(spark, rows):
    docs = rows_of(spark, rows)
    found = conversation_repair.report(docs, docs)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r)[1:] for r in found.collect()}


def by_conversation(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, role, text))
    return out


@pytest.mark.parametrize("batch", [10_000, 3])
def test_repair_is_the_cheapest_and_least(spark, rows, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)  # conversations in many pieces
    try:
        found = report(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {conv: expected(mine) for conv, mine in by_conversation(rows).items()}
    assert found == want


def test_powers_are_the_product_of_single_turns():
    for symbol in [("u", False, False), ("a", False, True), ("", False, False), conversation_repair.GONE]:
        one = conversation_repair.power(symbol, 0)
        whole = one
        for length in range(2, 40):
            whole = conversation_repair._times(whole, one)
            assert np.array_equal(conversation_repair.run(symbol, length), whole)


def test_damage_is_dealt_by_conversation_and_turn(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in [*range(8), None]] + [(None, None, None, None)]
    found = sorted(map(repr, (tuple(r) for r in conversation_repair.damaged(rows_of(spark, rows)).collect())))
    want = []
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text, fault = role or " ", text or " ", zlib.crc32(name.encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        want += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    assert found == sorted(map(repr, want))


def test_conversations_without_rows(spark):
    docs = rows_of(spark, [(1, 1, "user", "Hi."), (1, 2, "assistant", "Ho."), (None, 1, "user", "")])
    found = conversation_repair.report(docs, docs.filter("conv_id = 1"))
    nothing = hashlib.sha256(b"").hexdigest()
    assert {tuple(r) for r in found.collect()} == {
        (1, 0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:Hi.\nassistant:Ho.").hexdigest()), (None, 0, 0, 0, 0, 0, 0, "", nothing),
    }
    assert conversation_repair.report(docs.limit(0), docs.limit(0)).count() == 0
    fixed = conversation_repair.repair(docs)
    assert sorted((r["as"], r["text"]) for r in fixed.lines.collect()) == [("assistant", "Ho."), ("user", "Hi.")]
