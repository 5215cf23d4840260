"""Repair of conversations: the cheapest edits that give the roles ``(s?(ua)+)?``, found on one automaton for all.

A turn becomes one character, its role and first fault, and a conversation the word of them, its signature.
Equal signatures collapse. The rest form an automaton minimised from the end: a state is a suffix, shared by all
signatures that end in it. Signatures are range-partitioned and sorted by their *reversal*, so those with a common suffix
are neighbours; a task keeps the states of the current one on a stack, drops those the next does not share and adds
what is new. So the cost-to-go and the best edit of a (suffix, grammar state) pair are computed once across all
conversations (a task computes again only the path to its first signature), and a task's memory is its longest
signature. States whose costs differ by a constant only are one entry of a table, so a new state is one look-up.

Edits are Keep (0), Rerole to user or assistant (2), Delete (3, a must for blank and duplicate turns) and Insert of a turn
without text (2, anywhere); a truncated turn that stays costs 1 more. Different edits have different initials, so of
the cheapest audits the least in ASCII is found turn by turn: the least initial that still leads to the least cost.

Texts are shuffled once, when the edits are applied: what the signatures need is a role and two hashes. Both passes
stream over turns sorted by conversation, so a conversation with most of all turns takes two bytes a turn and no text.

Defined results: a null role or text counts as one space, a null conversation id is a conversation, null turns come
first; turns with equal numbers are ordered by role and hash of the text; repeated turns are duplicates. An empty role has an
empty initial: kept, it leaves the grammar state as it is. An empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.shared import settle

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Grammar states: nothing yet, after the system turn, after a user turn, after an assistant turn. What may follow each.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {("s", BEGIN): SYSTEM, ("u", BEGIN): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
MUST_GO = "d"
BATCH = 2_000

Steps = tuple[tuple[str, int], ...]  # for each grammar state: the initials of the edits at this turn, and the state after them


def _least(base: list[tuple[float, str, int]]) -> list[tuple[float, str, int]]:
    """Of each grammar state: cost, initials and next state, where up to two turns are inserted first."""
    best = list(base)
    for _ in range(2):
        grown = [(best[NEXT[s]][0] + INSERT, "I" + best[NEXT[s]][1], best[NEXT[s]][2]) for s in range(4)]
        best = [min(base[s], grown[s]) for s in range(4)]
    return best


def end_state() -> tuple[tuple[float, ...], Steps]:
    """Costs and steps of the empty suffix."""
    never = float("inf")
    best = _least([(0.0, "", BEGIN), (never, "", SYSTEM), (never, "", USER), (0.0, "", ASSISTANT)])
    return tuple(b[0] for b in best), tuple((b[1], b[2]) for b in best)


def state_before(symbol: str, after: tuple[float, ...]) -> tuple[tuple[float, ...], Steps]:
    """Costs and steps of a suffix that begins with ``symbol``, from the costs of the rest."""
    extra, initial = TRUNCATED if symbol.isupper() else 0, symbol.lower()
    base = []
    for s in range(4):
        ways = [(DELETE + after[s], "D", s)]
        if symbol != MUST_GO:
            ways.append((REROLE + extra + after[NEXT[s]], "R", NEXT[s]))
            kept = s if initial == "e" else LEGAL.get((initial, s))
            if kept is not None:
                ways.append((KEEP + extra + after[kept], "K", kept))
        base.append(min(ways))
    best = _least(base)
    return tuple(b[0] for b in best), tuple((b[1], b[2]) for b in best)


class SuffixAutomaton:
    """States of the suffixes of the current signature, the empty one first; signatures come sorted by their reversal."""

    def __init__(self) -> None:
        cost, steps = end_state()
        self.word = ""
        self.costs: list[float] = [min(cost)]  # least cost of each suffix; with ``shapes`` the costs of all grammar states
        self.shapes: list[tuple[float, ...]] = [tuple(c - min(cost) for c in cost)]
        self.steps: list[Steps] = [steps]
        self.table: dict[tuple[str, tuple[float, ...]], tuple[float, tuple[float, ...], Steps]] = {}
        self.made = 0

    def repair(self, signature: str) -> tuple[int, str]:
        """Cost and audit of a signature."""
        word, shared = signature[::-1], 0
        most = min(len(word), len(self.word))
        while shared < most and word[shared] == self.word[shared]:
            shared += 1
        for states in (self.costs, self.shapes, self.steps):
            del states[shared + 1 :]
        for symbol in word[shared:]:
            key = (symbol, self.shapes[-1])
            known = self.table.get(key)
            if known is None:
                cost, steps = state_before(*key)
                known = self.table[key] = (min(cost), tuple(c - min(cost) for c in cost), steps)
            self.costs.append(self.costs[-1] + known[0])
            self.shapes.append(known[1])
            self.steps.append(known[2])
        self.made += len(word) - shared
        self.word = word
        audit, state = [], BEGIN
        for steps in reversed(self.steps):
            initials, state = steps[state]
            audit.append(initials)
        return int(self.costs[-1] + self.shapes[-1][BEGIN]), "".join(audit)


def cheapest(signatures: DataFrame) -> DataFrame:
    """signature, cost and audit of all distinct signatures (column ``signature``)."""

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton()
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.column(0).slice(lo, BATCH)
                found = [automaton.repair(x) for x in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([part, pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["signature", "cost", "audit"])

    ordered = signatures.repartitionByRange(F.reverse("signature")).sortWithinPartitions(F.reverse("signature"))
    return ordered.mapInArrow(repair, "signature string, cost bigint, audit string")


def turns_of(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text, h1, h2 with nulls made plain."""
    plain = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"))
    return plain.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))


def _order() -> list:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")]


def signatures_of(turns: DataFrame) -> DataFrame:
    """Of each conversation: signature, gaps, blank, duplicate, truncated, illegal."""
    seen = "row_number() OVER (PARTITION BY conv, role, h1, h2 ORDER BY turn NULLS FIRST) > 1"
    initial = "CASE substr(role, 1, 1) WHEN 's' THEN 's' WHEN 'u' THEN 'u' WHEN 'a' THEN 'a' WHEN '' THEN 'e' ELSE 'x' END"
    ends = "rtrim(' \\t\\n\\u000b\\f\\r', text)"
    narrow = turns.selectExpr("conv", "turn", "role", "h1", "h2", f"{initial} AS initial", f"CASE WHEN {ends} = '' THEN 'b' WHEN right({ends}, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'o' END AS state")
    dealt = narrow.repartition("conv")  # one shuffle: the window below and the sort need no other
    marked = dealt.selectExpr("*", f"CASE WHEN state = 'b' THEN 'b' WHEN {seen} THEN 'd' ELSE state END AS fault")
    return marked.sortWithinPartitions(F.col("conv").asc_nulls_first(), *_order()).select("conv", "turn", "initial", "fault").mapInArrow(_signed, _SIGNED)


_SIGNED = "conv bigint, signature string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
_TO_UPPER = bytes.maketrans(b"suaxe", b"SUAXE")


class _Conversation:
    """What a stream of one conversation's turns, in order, adds up to: two bytes a turn."""

    def __init__(self, conv: int | None):
        self.conv, self.initials, self.faults = conv, bytearray(), bytearray()
        self.low: int | None = None
        self.high: int | None = None
        self.distinct = 0

    def add(self, turns: np.ndarray, initials: bytes, faults: bytes) -> None:
        """``turns`` holds the known numbers among the turns added."""
        if len(turns):
            self.distinct += int(np.count_nonzero(np.diff(turns))) + (self.high is None or int(turns[0]) != self.high)
            self.low, self.high = int(turns[0]) if self.low is None else self.low, int(turns[-1])
        self.initials += initials
        self.faults += faults

    def row(self) -> tuple:
        initials, faults = bytes(self.initials), bytes(self.faults)
        upper = initials.translate(_TO_UPPER)
        as_array = lambda x: np.frombuffer(x, np.uint8)
        f = as_array(faults)
        word = np.where((f == ord("b")) | (f == ord("d")), ord(MUST_GO), np.where(f == ord("t"), as_array(upper), as_array(initials))).astype(np.uint8)
        legal = sum(initials.count(pair) for pair in (b"su", b"ua", b"au"))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.conv, word.tobytes().decode(), gaps, faults.count(b"b"), faults.count(b"d"), faults.count(b"t"), max(0, len(initials) - 1) - legal


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int | None, int, int]]:
    """Conversations of a sorted batch: id, first and last row."""
    conv = batch.column(0)
    ids = conv.fill_null(0).to_numpy(zero_copy_only=False)
    none = conv.is_null().to_numpy(zero_copy_only=False)
    cut = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (none[1:] != none[:-1])) + 1).tolist(), len(ids)]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield None if none[a] else int(ids[a]), a, b


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SIGNED.split(", ")]
    types = [pa.string() if n == "signature" else pa.int64() for n in names]
    now: _Conversation | None = None
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) if done else [()] * len(names)
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        done.clear()
        return made

    for batch in batches:
        if not batch.num_rows:
            continue
        known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        turn = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
        initials, faults = ("".join(batch.column(c).to_pylist()).encode() for c in (2, 3))
        for conv, a, b in _runs(batch):
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.row())
                now = _Conversation(conv)
            now.add(turn[a:b][known[a:b]], initials[a:b], faults[a:b])
            if len(done) >= BATCH:
                yield out()
    if now is not None:
        done.append(now.row())
    yield out()


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, int | None, str, str]]:
    """Repaired turns in order: conv, edit, turn, role, text; and once a conversation, at its end, edit ``end``.

    Each conversation begins with a row that holds its audit.
    """
    conv, audit, at, state = None, "", 0, BEGIN

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, NEXT[state]
            yield conv, "insert", None, ROLES[state], ""

    open_ = False
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv", "turn", "role", "text", "audit")]
        for c, turn, role, text, plan in zip(*columns, strict=True):
            if plan is not None:
                if open_:
                    yield from inserted()
                    yield conv, "end", None, "", ""
                conv, audit, at, state, open_ = c, plan, 0, BEGIN, True
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "R":
                state = NEXT[state]
                yield conv, "rerole", turn, ROLES[state], text
            elif edit == "K":
                state = LEGAL[role[0], state] if role else state
                yield conv, "keep", turn, role, text
    if open_:
        yield from inserted()
        yield conv, "end", None, "", ""


def _in_tables(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def placed() -> Iterator[tuple]:
        place = 0
        for conv, edit, turn, role, text in _edited(batches):
            if edit == "end":
                place = 0
            else:
                yield conv, place, turn, role, text, edit
                place += 1

    return _in_tables(placed(), ["conv", "place", "turn", "role", "text", "edit"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def digests() -> Iterator[tuple]:
        digest, first = hashlib.sha256(), True
        for conv, edit, _, role, text in _edited(batches):
            if edit == "end":
                yield conv, digest.hexdigest()
                digest, first = hashlib.sha256(), True
            else:
                digest.update(f"{role}:{text}".encode() if first else f"\n{role}:{text}".encode())
                first = False

    return _in_tables(digests(), ["conv", "repaired_sha256"], [pa.int64(), pa.string()])


class Repair:
    """The repair of a table of turns: ``report`` (a row per conversation: signature, counts of faults, cost, audit),
    ``turns()`` (the repaired turns) and ``digests()`` (a hash of each repaired conversation)."""

    def __init__(self, df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"):
        self._turns = turns_of(df, conv_col, turn_col, role_col, text_col)
        signed = settle(signatures_of(self._turns))
        audits = cheapest(signed.select("signature").distinct())
        self.report = settle(signed.join(audits, "signature"))

    def _with_audits(self) -> DataFrame:
        audits = self.report.selectExpr("conv", "CAST(NULL AS bigint) AS turn", "CAST(NULL AS string) AS role", "CAST(NULL AS bigint) AS h1", "CAST(NULL AS bigint) AS h2", "CAST(NULL AS string) AS text", "audit")
        rows = audits.unionByName(self._turns.selectExpr("conv", "turn", "role", "h1", "h2", "text", "CAST(NULL AS string) AS audit"))
        return rows.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("audit").isNull(), *_order()).select("conv", "turn", "role", "text", "audit")

    def turns(self) -> DataFrame:
        """conv, place (from 0), turn (null for inserted ones), role, text, edit (keep, rerole, insert)."""
        return self._with_audits().mapInArrow(_repaired, "conv bigint, place bigint, turn bigint, role string, text string, edit string")

    def digests(self) -> DataFrame:
        """conv, repaired_sha256: of all repaired ``role:text``, joined by newlines."""
        return self._with_audits().mapInArrow(_digested, "conv bigint, repaired_sha256 string")


def damage(df: DataFrame) -> DataFrame:
    """Conversations with planted faults, chosen by crc32(``conv_id:turn``) % 20: 0 drops the turn, 1 empties its text, 2
    takes out ``.!?``, 3 repeats it, 4 makes it a user's. Nulls count as one space."""
    space = F.lit(" ")
    spaced = df.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.col("fault")
    role = F.when(fault == 4, "user").otherwise(F.col("role"))
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1)))
    hit = spaced.withColumn("fault", F.crc32(key.cast("binary")) % 20).where("fault <> 0")
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repaired_conversations(df: DataFrame) -> DataFrame:
    """Every conversation after damage and repair; one that lost all turns has zeros and empty texts."""
    done = Repair(damage(df))
    all_ = df.groupBy("conv_id").agg(F.lit(1).alias("one")).drop("one")
    made = done.report.drop("signature").join(done.digests().withColumnRenamed("conv", "of"), F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    whole = all_.join(made, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return whole.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
