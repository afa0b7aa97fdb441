"""Repair of conversations whose turns lost their structure, one solution per signature.

A conversation's signature is a string with a letter for each turn: what its role and its fault mean for the repair. Cheapest edits depend on the
signature alone, so each distinct one is solved once and its audit (the edits' initials) is joined back and replayed on the turns.

Turns are sorted, never gathered: faults, signatures and replays are made while a task reads its conversations turn by turn, so
of a conversation it holds 16 bytes and two letters a turn, but not its texts. Signatures that many conversations have are joined
by broadcast, all others by key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .store import materialize

#: Prices of the edits, and what a truncated turn adds if it stays.
PRICES = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5
#: Signatures that may be broadcast.
BROADCAST_SIGNATURES = 10_000
#: Bytes that these may have together.
BROADCAST_BYTES = 32 << 20

#: States of the wanted order of roles: nothing yet, after a system, after a user, after an assistant turn; conversations end in the first or last.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
_ROLE = {_SYSTEM: "system", _USER: "user", _ASSISTANT: "assistant"}
#: A letter's role: system, user, assistant, another.
_INITIAL = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}


def solve(signature: str) -> tuple[int, str]:
    """Cost and audit of the cheapest edits, of these the ASCII-least audit.

    Letters: ``x`` must go; ``s``, ``u``, ``a``, ``o`` by role, capital if truncated. The recursion is on (turns left, state), remembered from the end, so
    its depth doesn't matter. Audits of one turn's states are compared by their first letters and then by the rank of what follows, so a
    step takes the same time in a long conversation.
    """
    n = len(signature)
    # per place and state: the letters up to and with this turn's edit, and the state after it
    choice: list[list[tuple[str, int]]] = [[("", 0)] * 4 for _ in range(n + 1)]
    none = (1 << 60, 0, "")
    costs, ranks = [0, none[0], none[0], 0], [0, 0, 0, 0]
    costs, ranks = _inserted([(c, ("", -1)) for c in costs], [("", s) for s in range(4)], choice[n])
    for i in range(n - 1, -1, -1):
        letter = signature[i]
        late = TRUNCATED if letter.isupper() else 0
        role = _INITIAL.get(letter.lower())
        best, after = [], []
        for state in range(4):
            options = [(PRICES["D"] + costs[state], ("D", ranks[state]), state)]
            if letter != "x":
                if role is not None and (role == _NEXT[state] or role == _SYSTEM and state == _START):
                    options.append((late + costs[role], ("K", ranks[role]), role))
                to = _NEXT[state]
                options.append((PRICES["R"] + late + costs[to], ("R", ranks[to]), to))
            cost, key, to = min(options)
            best.append((cost, key))
            after.append((key[0], to))
        costs, ranks = _inserted(best, after, choice[i])
    audit, state = [], _START
    for i in range(n + 1):
        letters, state = choice[i][state]
        audit.append(letters)
    return costs[_START], "".join(audit)


def _inserted(best: list[tuple[int, tuple[str, int]]], after: list[tuple[str, int]], choice: list[tuple[str, int]]) -> tuple[list[int], list[int]]:
    """Costs and ranks of a place's states when up to two turns may be inserted first (a third would come back to a state); fills ``choice``."""
    found = []
    for state in range(4):
        options, at = [], state
        for inserts in range(3):
            cost, (letters, rank) = best[at]
            options.append((cost + inserts * PRICES["I"], ("I" * inserts + letters, rank), at))
            at = _NEXT[at]
        cost, key, at = min(options)
        choice[state] = (key[0], after[at][1])
        found.append((cost, key))
    keys = sorted({k for _, k in found})
    return [c for c, _ in found], [keys.index(k) for _, k in found]


def replayed(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired turns: kept ones as they are, others with the role that the order of roles asks for."""
    state, turns = _START, iter(turns)
    for edit in audit:
        if edit == "D":
            next(turns)
            continue
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "K":
            state = _INITIAL[role[0]]
        else:
            state = _NEXT[state]
            role = _ROLE[state]
        yield role, text


def damaged(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns with the faults that a crc32 of ``conv_id:turn`` modulo 20 asks for: 0 drops the row, 1 empties the text, 2 takes its ``.!?`` out, 3 repeats the row, 4 makes the role user.

    In the crc32, and as role and text, a null is one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space(conv_id), F.lit(":"), space(turn))) % 20
    t = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"), fate.alias("fate")).filter("fate <> 0")
    text_ = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    t = t.select("conv_id", "turn", F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text_.alias("text"), F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return t.drop("copy")


def _letters() -> tuple[Column, Column]:
    """Whether a text is blank, and whether it is truncated."""
    stripped = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    return stripped == "", ~F.substring(stripped, -1, 1).isin(".", "!", "?")


def _mapped(rows: DataFrame, function: Callable[[Iterator[tuple]], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """``function`` over the rows of each partition, which are sorted by conversation, one by one."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = function(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        while some := list(islice(out, 5_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


def _signed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Counts and signature of each conversation from its rows in order."""
    current, seen = None, set()
    counts, letters, last = [0, 0, 0, 0], [], None
    low = high = previous = None
    distinct = 0

    def done() -> tuple:
        gaps = high - low + 1 - distinct if distinct else 0
        return (current, gaps, *counts, "".join(letters))

    for conv, number, initial, blank, truncated, digest in rows:
        if conv != current:
            if current is not None:
                yield done()
            current, seen, counts, letters, last = conv, set(), [0, 0, 0, 0], [], None
            low = high = previous = None
            distinct = 0
        if number is not None:
            low, high = number if low is None else low, number
            distinct += number != previous
            previous = number
        again = digest in seen
        seen.add(digest)
        fault = 0 if blank else 1 if again else 2 if truncated else None
        if fault is not None:
            counts[fault] += 1
        counts[3] += last is not None and last + initial not in ("su", "ua", "au")
        last = initial
        letter = initial if initial in _INITIAL else "o"
        letters.append("x" if fault in (0, 1) else letter.upper() if fault == 2 else letter)
    if current is not None:
        yield done()


def _digested(rows: Iterator[tuple]) -> Iterator[tuple]:
    """SHA-256 of each conversation's repaired turns."""
    rows = iter(rows)
    ahead = next(rows, None)
    while ahead is not None:
        conv, audit = ahead[0], ahead[1]

        def mine() -> Iterator[tuple[str, str]]:
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                yield ahead[2], ahead[3]
                ahead = next(rows, None)

        digest, turns = hashlib.sha256(), mine()
        for i, (role, text) in enumerate(replayed(audit, turns)):
            digest.update(f"{chr(10) if i else ''}{role}:{text}".encode())
        for _ in turns:
            pass
        yield conv, digest.hexdigest()


def with_audits(conversations: DataFrame, most: int = BROADCAST_SIGNATURES, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``conversations`` (with a ``signature``) beside the ``cost`` and ``audit`` of theirs, each distinct signature solved once.

    Signatures of more than a ``most``-th of the conversations are fewer than ``most``; if they have at most ``most_bytes`` together they are
    broadcast, and no key of the join of the others has more than that share of the rows.
    """
    solved = conversations.groupBy("signature").agg(F.count("*").alias("n"))

    @F.arrow_udf("struct<cost:long,audit:string>")
    def audits(signatures: pa.Array) -> pa.Array:
        found = [solve(s) for s in signatures.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["cost", "audit"])

    solved = materialize(solved.withColumn("solved", audits("signature")).select("signature", "n", "solved.cost", "solved.audit"), "repair-signatures")
    total = solved.agg(F.sum("n")).head()[0] or 0
    often = F.col("n") * most > total
    if (solved.filter(often).agg(F.sum(2 * F.length("signature"))).head()[0] or 0) > most_bytes:
        return conversations.join(solved.drop("n"), "signature")
    frequent = F.broadcast(solved.filter(often).drop("n"))
    joined = conversations.join(frequent, "signature", "left")
    hit = joined.filter("cost is not null")
    rest = joined.filter("cost is null").drop("cost", "audit").join(solved.filter(~often).drop("n"), "signature")
    return hit.unionByName(rest)


def repair(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Faults, cheapest repair and digest of the repaired turns for every conversation of ``ids`` (column ``conv_id``).

    ``turns``: conv_id, turn, role, text. A conversation's rows are ordered by turn (null first), then role and text, so repeated rows stand side by side. Columns:
    ``gaps`` in the turn numbers (nulls ignored), ``blank``, ``duplicate`` and ``truncated`` rows (a row's first fault counts), ``illegal`` neighbours, ``cost``,
    ``audit``, ``repaired_sha256``. Conversations without rows have zeros, no audit and the digest of the empty string. Null ids are left out. Nulls in
    role or text count as one space. Other columns are ignored.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    t = turns.filter("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    blank, truncated = _letters()
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    said = t.withColumns({"initial": F.substring("role", 1, 1), "blank": blank, "truncated": truncated, "digest": digest})
    said = said.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "initial", "blank", "truncated", "digest")
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal"]
    ident, string = t.schema["conv_id"], T.StringType()
    signed = _mapped(said, _signed, T.StructType([ident, *[T.StructField(c, T.LongType()) for c in longs], T.StructField("signature", string)]))
    audited = materialize(with_audits(materialize(signed, "repair-signed")), "repair-audits")
    replay = t.join(audited.select("conv_id", "audit"), "conv_id").repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "audit", "role", "text")
    digests = _mapped(replay, _digested, T.StructType([ident, T.StructField("repaired_sha256", string)]))
    every = ids.select("conv_id").filter("conv_id is not null").distinct()
    full = every.join(audited.drop("signature"), "conv_id", "left").join(digests, "conv_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return full.select("conv_id", *[zero(c) for c in [*longs, "cost"]], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
