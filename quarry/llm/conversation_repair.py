"""Cheapest repair of conversations' turns by a dynamic programme over runs of equal symbols."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.session import materialize

#: What separates words, what ends a sentence, costs of the edits, legal neighbours.
BLANK, ENDED = r"^[\x20\x09-\x0D]*\z", r"[.!?][\x20\x09-\x0D]*\z"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}
#: States: nothing yet, after a system turn, after a user's, after an assistant's. A user's turn or an
#: assistant's is made from each state; a repair may end where nothing is open.
MADE, ROLES, ENDS = (2, 2, 3, 2), {2: "user", 3: "assistant"}, (0, 3)
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_FAR = 1 << 60
GONE = ("", True, False)  # the symbol of turns that must go


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _FAR)


def _after(a: np.ndarray, costs: tuple[int, ...]) -> tuple[int, ...]:
    return tuple((a + np.array(costs)).min(axis=1).tolist())


def _inserts() -> np.ndarray:
    out = np.full((4, 4), _FAR)
    for state in range(4):
        at, cost = state, 0
        for _ in range(3):
            out[state, at] = min(out[state, at], cost)
            at, cost = MADE[at], cost + INSERT
    return out


def edits(state: int, symbol: tuple[str, bool, bool]) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up one turn, in the order of their letters."""
    initial, gone, truncated = symbol
    out = [("D", DELETE, state)]
    if not gone:
        more = TRUNCATED if truncated else 0
        if state in KEPT.get(initial, {}):
            out.append(("K", more, KEPT[initial][state]))
        out.append(("R", REROLE + more, MADE[state]))
    return out


@lru_cache(None)
def power(symbol: tuple[str, bool, bool], k: int) -> np.ndarray:
    """The transition over 2^k equal turns, inserted ones in front of each."""
    if k:
        half = power(symbol, k - 1)
        return _times(half, half)
    one = np.full((4, 4), _FAR)
    for state in range(4):
        for _, cost, to in edits(state, symbol):
            one[state, to] = min(one[state, to], cost)
    return _times(_inserts(), one)


def run(symbol: tuple[str, bool, bool], length: int) -> np.ndarray:
    """The transition over a run of equal turns, from the binary powers of one."""
    out = None
    for k in range(length.bit_length()):
        if length >> k & 1:
            out = power(symbol, k) if out is None else _times(out, power(symbol, k))
    return out


@lru_cache(1 << 16)
def choose(state: int, symbol: tuple[str, bool, bool], after: tuple[int, ...]) -> tuple[str, int]:
    """The least letters of a cheapest way over one turn, and the state behind it; ``after``: costs behind it."""
    before, letters = _after(power(symbol, 0), after), ""
    while True:
        ways = {letter: to for letter, cost, to in edits(state, symbol) if cost + after[to] == before[state]}
        if "D" not in ways and before[state] == INSERT + before[MADE[state]]:
            letters, state = letters + "I", MADE[state]
            continue
        letter = min(ways)
        return letters + letter, ways[letter]


def unroll(symbol: tuple[str, bool, bool], length: int, state: int, after: tuple[int, ...]) -> tuple[list[str], int]:
    """Letters of each turn of a run. The run is halved, with the costs in the middle from the powers."""
    if length == 1:
        least = min(after)
        letters, state = choose(state, symbol, tuple(x - least for x in after))
        return [letters], state
    half = length // 2
    first, state = unroll(symbol, half, state, _after(run(symbol, length - half), after))
    second, state = unroll(symbol, length - half, state, after)
    return first + second, state


def runs(symbols: list[tuple[tuple, int]]) -> list[tuple[tuple, int]]:
    """(symbol, length) of runs of equal neighbours in a list of (symbol, times)."""
    return [(s, sum(n for _, n in group)) for s, group in groupby(symbols, key=lambda x: x[0])]


def _symbols(rows: list[dict]) -> list[tuple[tuple, int]]:
    out = []
    for r in rows:
        gone = r["blank"] or r["seen"]
        out.append((GONE, r["n"]) if gone else ((r["role"][:1], False, r["truncated"]), 1))
        if not gone and r["n"] > 1:
            out.append((GONE, r["n"] - 1))
    return out


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_TURN = "turn: long, role: string, digest: binary"
_PIECE = (
    "piece long, matrix array<long>, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, "
    f"opens string, closes string, rows array<struct<{_TURN}, n: long, blank: boolean, truncated: boolean, seen: boolean>>"
)
_END = (
    "piece long, after array<long>, first boolean, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
)
_UNROLLED = f"piece long, entry int, exit int, audit string, kept array<struct<{_TURN}, as: string>>"


def _mapped(df: DataFrame, made, columns: str) -> DataFrame:
    """Rows (conv, ``columns``) from lists of dicts that ``made`` yields for a task's batches."""
    schema = StructType([df.schema["conv"], *StructType.fromDDL(columns)])
    arrow = to_arrow_schema(schema)

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (pa.RecordBatch.from_pylist(rows, arrow) for rows in made(given) if rows)

    return df.mapInArrow(batches, schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """One row for each conversation in a batch of sorted turns: its transition, its counts, and its turns."""
    for batch in batches:
        out = []
        for conv, group in groupby(batch.to_pylist(), key=lambda r: r["conv"]):
            rows = list(group)
            matrix = None
            for symbol, length in runs(_symbols(rows)):
                step = run(symbol, length)
                matrix = step if matrix is None else _times(matrix, step)
            initials = [r["role"][:1] for r in rows]
            turns = [r["turn"] for r in rows if r["turn"] is not None]
            out.append({
                "conv": conv, "piece": rows[0]["place"], "matrix": matrix.ravel().tolist(),
                "blank": sum(r["n"] for r in rows if r["blank"]),
                "duplicate": sum(r["n"] - (not r["seen"]) for r in rows if not r["blank"]),
                "truncated": sum(not r["blank"] and not r["seen"] and r["truncated"] for r in rows),
                "illegal": sum(r["n"] - 1 for r in rows) + sum(a + b not in LEGAL for a, b in pairwise(initials)),
                "turns": len(set(turns)), "low": turns[0] if turns else None, "high": turns[-1] if turns else None,
                "opens": initials[0], "closes": initials[-1], "rows": rows,
            })
        yield out


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[dict]]]:
    """Rows of sorted batches by conversation."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=lambda r: r["conv"])


def _listed(made, most: int = 5000):
    """Lists of about ``most`` rows that ``made`` yields one by one."""
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        out: list[dict] = []
        for row in made(batches):
            out.append(row)
            if len(out) >= most:
                yield out
                out = []
        yield out

    return lists


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Costs behind each piece, and with a conversation's first piece the counts of all."""
    for conv, group in _conversations(batches):
        pieces = list(group)
        costs = _after(_inserts(), tuple(0 if s in ENDS else _FAR for s in range(4)))
        total = {c: sum(p[c] for p in pieces) for c in _COUNTS}
        for a, b in pairwise(pieces):
            total["illegal"] += a["closes"] + b["opens"] not in LEGAL
            total["turns"] -= a["high"] is not None and a["high"] == b["low"]
        low, high = ([p[c] for p in pieces if p[c] is not None] for c in ("low", "high"))
        turns = total.pop("turns")
        total["gaps"] = high[-1] - low[0] + 1 - turns if low else 0
        for k in range(len(pieces) - 1, -1, -1):
            p = pieces[k]
            found = {"conv": conv, "piece": p["piece"], "after": list(costs), "first": k == 0, "last": k == len(pieces) - 1}
            costs = _after(np.array(p["matrix"]).reshape(4, 4), costs)
            yield found if k else found | total | {"cost": costs[0]}


def _kept(rows: list[dict], letters: Iterator[str], state: int) -> Iterator[dict]:
    """The turns that stay or are made, in order; ``letters`` are those of the turns that may stay."""
    for r in rows:
        if r["blank"] or r["seen"]:
            continue
        for letter in next(letters):
            if letter == "I":
                state = MADE[state]
                yield {"turn": None, "role": None, "digest": None, "as": ROLES[state]}
            elif letter != "D":
                state = KEPT[r["role"][:1]][state] if letter == "K" else MADE[state]
                yield {c: r[c] for c in ("turn", "role", "digest")} | {"as": r["role"] if letter == "K" else ROLES[state]}


def _unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Each piece's audit and turns after the repair, from every state that it may be entered in."""
    for batch in batches:
        out = []
        for p in batch.to_pylist():
            parts, behind = runs(_symbols(p["rows"])), [tuple(p["after"])]
            for symbol, length in reversed(parts[1:]):
                behind.append(_after(run(symbol, length), behind[-1]))
            for entry in (0,) if p["first"] else range(4):
                state, audit, letters = entry, [], []
                for (symbol, length), costs in zip(parts, reversed(behind), strict=True):
                    if symbol == GONE:  # deletions come before inserted turns of equal cost, and keep the state
                        audit.append("D" * length)
                        continue
                    more, state = unroll(symbol, length, state, costs)
                    audit += more
                    letters += more
                kept = list(_kept(p["rows"], iter(letters), entry))
                while p["last"] and state not in ENDS:
                    state = MADE[state]
                    audit.append("I")
                    kept.append({"turn": None, "role": None, "digest": None, "as": ROLES[state]})
                out.append({"conv": p["conv"], "piece": p["piece"], "entry": entry, "exit": state, "audit": "".join(audit), "kept": kept})
        yield out


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The state that each piece is entered in."""
    for _, group in _conversations(batches):
        state, piece = 0, None
        for r in group:
            if r["entry"] == state and r["piece"] != piece:
                yield {c: r[c] for c in ("conv", "piece", "entry")}
                state, piece = r["exit"], r["piece"]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """SHA-256 of each conversation's lines, read as a stream."""
    for conv, group in _conversations(batches):
        total, between = hashlib.sha256(), b""
        for line in group:
            total.update(between + f"{line['as']}:{line['text']}".encode())
            between = b"\n"
        yield {"conv": conv, "repaired_sha256": total.hexdigest()}


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with a fault in a fixed share of them, dealt by conv_id and turn.

    Of 20 rows about one each is dropped, emptied, robbed of its sentence ends, repeated, given to the user.
    Nulls of role and text become one space, as do nulls of conv_id and turn where the fault is dealt.
    """
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).filter("fault <> 0").select(
        "conv_id", "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


@dataclass(frozen=True)
class Repair:
    """counts(conv, gaps, blank, duplicate, truncated, illegal, cost), audits(conv, audit), lines(conv, piece, pos, as, text).

    ``conv`` is a struct of conv_id, so that a missing id is a key like any other.
    """

    counts: DataFrame
    audits: DataFrame
    lines: DataFrame


def repair(rows: DataFrame) -> Repair:
    """The cheapest edits that give each conversation of ``rows`` (conv_id, turn, role, text) legal roles.

    Turns are sorted by turn (nulls first), equal ones by role and the SHA-256 of the text. A turn's first
    fault counts: blank, duplicate (role and text seen earlier), truncated. Legal are an optional system
    turn and pairs of a user's and an assistant's turn, told by the initials of the roles, or no turn at
    all. Of equally cheap audits the least by letters is taken. Null roles and texts are one space; an
    empty role has no initial and never stays; empty tables give empty results; other columns are not read.

    Equal rows are folded to one with a number. All narrow rows are then sorted by range, so that a long
    conversation lies in many tasks; each batch of a task gives a piece of it with the product of its runs'
    transitions. A conversation's pieces (one for some 10,000 different rows) meet in one task, and so do
    their audits, which are one cell of the result; its lines pass one task as a stream.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    typed = rows.select(F.struct("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    typed = typed.withColumn("digest", F.unhex(F.sha2("text", 256)))
    key = ["conv", "turn", "role", "digest"]
    folded = typed.select(*key, F.rlike("text", F.lit(BLANK)).alias("blank"), (~F.rlike("text", F.lit(ENDED))).alias("truncated"))
    folded = folded.groupBy(*key).agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    folded = materialize(folded, "turns")
    earliest = folded.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("earliest"))
    marked = folded.join(earliest, ["conv", "role", "digest"]).withColumn("seen", ~F.col("turn").eqNullSafe(F.col("earliest.turn")))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest"]
    placed = marked.drop("earliest").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    pieces = materialize(_mapped(placed, _pieces, _PIECE), "pieces")

    by_conversation = pieces.drop("rows").repartition("conv").sortWithinPartitions("conv", "piece")
    ends = materialize(_mapped(by_conversation, _listed(_combined), _END), "piece-ends")
    known = pieces.select("conv", "piece", "rows").join(ends.select("piece", "after", "first", "last"), "piece")
    ways = materialize(_mapped(known, _unrolled, _UNROLLED), "ways")
    exits = ways.select("conv", "piece", "entry", "exit").repartition("conv").sortWithinPartitions("conv", "piece", "entry")
    taken = ways.join(_mapped(exits, _listed(_entered), "piece long, entry int").drop("conv"), ["piece", "entry"])
    taken = materialize(taken.drop("exit"), "taken")

    parts = F.array_sort(F.collect_list(F.struct("piece", "audit")))
    audits = taken.groupBy("conv").agg(F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"))
    lines = taken.select("conv", "piece", F.posexplode("kept").alias("pos", "kept")).select("conv", "piece", "pos", "kept.*")
    texts = typed.dropDuplicates(key).alias("t")
    same = (
        (F.col("l.conv") == F.col("t.conv")) & F.col("l.turn").eqNullSafe(F.col("t.turn"))
        & (F.col("l.role") == F.col("t.role")) & (F.col("l.digest") == F.col("t.digest"))
    )
    own = lines.filter("digest IS NOT NULL").alias("l").join(texts, same).select("l.conv", "piece", "pos", "as", "text")
    made = lines.filter("digest IS NULL").select("conv", "piece", "pos", "as", F.lit("").alias("text"))
    counts = ends.filter("first").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return Repair(counts, audits, own.unionByName(made))


def report(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Counts, cost, audit and the SHA-256 of the repaired ``role:text`` lines, for every conv_id of ``ids``.

    A conversation without rows has zeros, an empty audit and the hash of nothing.
    """
    fixed = repair(rows)
    ordered = fixed.lines.repartition("conv").sortWithinPartitions("conv", "piece", "pos")
    hashes = _mapped(ordered, _listed(_hashed), "repaired_sha256 string")
    every = ids.select(F.struct("conv_id").alias("conv")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    joined = every.join(fixed.counts, "conv", "left").join(fixed.audits, "conv", "left").join(hashes, "conv", "left")
    return joined.select(
        "conv.conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
