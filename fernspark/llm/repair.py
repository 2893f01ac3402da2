"""Conversation structure repair by Hirschberg's divide and conquer over a four-state automaton.

A conversation is well formed if the initials of its roles read `(s?(ua)+)?`: nothing, or a system turn or none and then
pairs of a user's and an assistant's turn. States: 0 nothing yet, 1 after the system turn, 2 after a user's, 3 after an
assistant's turn; 0 and 3 accept. Each row is kept (K), given the role user or assistant (R), or deleted (D), and empty
turns of a user or an assistant are inserted (I) before it or at the end; a state allows one role of the two, so the letters
of the edits, the audit, tell the repair. The cheapest edits are sought, of equally cheap ones the least audit in ASCII.

1. Rows are sorted by range over (conversation, turn), so that a huge conversation lies in many partitions, and cut into
   blocks: rows of one conversation and partition, bounded in rows and bytes, with one byte per row for the search.
2. A search goes to the middle of a stretch of rows: a forward vector has for each state the least cost of arriving there,
   and the rank of the least audit that does so; a backward vector has the least cost from each state to the end. Of the
   states where their sum is least, the one of the least rank is crossed, and both halves are searched in turn. Only the
   four-state vectors are held, so space is linear in the audit. Audits that have consumed the same rows end in a row's
   letter, so none is the beginning of another, and ranks decide as whole audits would.
3. Where a conversation has several blocks, each block first becomes a matrix, a forward vector for each state that it may
   be entered in. Matrices are multiplied within each partition, then forward and backward vectors meet at the borders of
   partitions, then at those of blocks, and each block is searched between the states so found.
4. What comes out is the repaired blocks. Digests of a conversation are taken along its blocks in order, block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch, discard, staged

#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows and bytes of text of a block; a longer single text is a block of its own.
BLOCK_ROWS, BLOCK_BYTES = 1024, 4 << 20
#: Repeated texts, or blocks of long conversations, that are broadcast: some 100 bytes each.
FEW = 100_000
WHITE = " \t\n\x0b\x0c\r"
FAR = 1 << 60
#: The role that an edit leads to from each state, and the state then.
_NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
#: Letters of a row's initial as the search sees it: s, u, a, anything else.
_KINDS = {"s": 0, "u": 1, "a": 2}
#: Where a role of each kind leads from each state.
_KEEPS = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
#: Cheapest ends: inserts from each state to an accepting one.
_ENDS = (0, 2, 1, 0)

Vector = tuple[tuple[int, ...], tuple[int, ...]]  # costs and ranks by state


def code(initial: str, must_go: bool, truncated: bool) -> int:
    """What the search knows of a row."""
    return _KINDS.get(initial, 3) | 4 * must_go | 8 * truncated


@lru_cache(None)
def edges(row: int) -> tuple[tuple[tuple[int, str], ...], ...]:
    """For each pair of states the least (cost, letters) of inserts and then one edit of a row of this code."""
    out = [[(FAR, "")] * 4 for _ in range(4)]
    for state in range(4):
        middle, cost, letters = state, 0, ""
        for _ in range(3):  # more than two inserts come back to a state that fewer reach
            found = [(middle, cost + DELETE, letters + "D")]
            if not row & 4:
                stays = cost + TRUNCATED * (row >> 3 & 1)
                found.append((_NEXT[middle][1], stays + REROLE, letters + "R"))
                if (middle, row & 3) in _KEEPS:
                    found.append((_KEEPS[middle, row & 3], stays, letters + "K"))
            for to, price, spelt in found:
                out[state][to] = min(out[state][to], (price, spelt))
            middle, cost, letters = _NEXT[middle][1], cost + INSERT, letters + "I"
    return tuple(map(tuple, out))


def start_vector(state: int) -> Vector:
    return tuple(0 if s == state else FAR for s in range(4)), (0, 0, 0, 0)


def end_costs(end: int) -> tuple[int, ...]:
    """Backward vector at the end: -1 for the end of a conversation, else the state to arrive in."""
    return tuple(INSERT * n for n in _ENDS) if end < 0 else start_vector(end)[0]


def _ranked(best: list[tuple[int, int, object]]) -> Vector:
    """A vector from the best (cost, rank before, what was added) of each state."""
    order = sorted({x[1:] for x in best if x[0] < FAR})
    return tuple(x[0] for x in best), tuple(order.index(x[1:]) if x[0] < FAR else 0 for x in best)


@lru_cache(1 << 16)
def _step(vector: Vector, row: int) -> Vector:
    """vector after one more row. Costs are taken relative to the least, so that few vectors are ever seen."""
    costs, ranks = vector
    moves = edges(row)
    best = []
    for to in range(4):
        found = [(costs[s] + moves[s][to][0], ranks[s], moves[s][to][1]) for s in range(4) if costs[s] < FAR and moves[s][to][0] < FAR]
        best.append(min(found, default=(FAR, 0, "")))
    return _ranked(best)


def _relative(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return (costs, 0) if least in (0, FAR) else (tuple(c - least if c < FAR else FAR for c in costs), least)


def forward(vector: Vector, rows: bytes) -> Vector:
    costs, total = _relative(vector[0])
    ranks = vector[1]
    for row in rows:
        costs, ranks = _step((costs, ranks), row)
        costs, least = _relative(costs)
        total += least
    return tuple(c + total if c < FAR else FAR for c in costs), ranks


@lru_cache(1 << 16)
def _step_back(costs: tuple[int, ...], row: int) -> tuple[int, ...]:
    moves = edges(row)
    return tuple(min(FAR, *(moves[s][t][0] + costs[t] for t in range(4))) for s in range(4))


def backward(costs: tuple[int, ...], rows: bytes) -> tuple[int, ...]:
    costs, total = _relative(costs)
    for row in reversed(rows):
        costs, least = _relative(_step_back(costs, row))
        total += least
    return tuple(c + total if c < FAR else FAR for c in costs)


def crossing(ahead: Vector, behind: tuple[int, ...]) -> tuple[int, int]:
    """The least cost of a path through this border, and the state in which the least audit crosses it."""
    cost, _, state = min((a + b, r, s) for s, (a, r, b) in enumerate(zip(*ahead, behind)))
    return cost, state


def audit(rows: bytes, start: int = 0, end: int = -1) -> str:
    """The least audit of the cheapest edits of `rows` from a state to a state (-1: the end of a conversation)."""
    if not rows:
        return "I" * _ENDS[start] if end < 0 else ""
    if len(rows) == 1:
        closing = end_costs(end)
        return min((c + closing[t], letters + ("I" * _ENDS[t] if end < 0 else "")) for t, (c, letters) in enumerate(edges(rows[0])[start]) if c < FAR and closing[t] < FAR)[1]
    middle = len(rows) // 2
    _, state = crossing(forward(start_vector(start), rows[:middle]), backward(end_costs(end), rows[middle:]))
    return audit(rows[:middle], start, state) + audit(rows[middle:], state, end)


def audit_cost(letters: str, rows: bytes) -> int:
    """What the edits cost, with the truncated rows that stay."""
    left = [x for x in letters if x != "I"]
    stays = sum(row >> 3 & 1 for row, x in zip(rows, left) if x != "D")
    return REROLE * letters.count("R") + DELETE * letters.count("D") + INSERT * letters.count("I") + TRUNCATED * stays


def apply_audit(letters: str, roles: list[str], texts: list[str], start: int = 0) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits."""
    state, at = start, 0
    out_roles: list[str] = []
    out_texts: list[str] = []
    for letter in letters:
        if letter == "D":
            at += 1
            continue
        role, to = _NEXT[state]
        if letter == "K":
            role, to = roles[at], _KEEPS[state, _KINDS[roles[at][:1]]]
        out_roles.append(role)
        out_texts.append("" if letter == "I" else texts[at])
        at, state = at + (letter != "I"), to
    return out_roles, out_texts


# Matrices of stretches of rows: a forward vector for each state to start in.


def matrix(rows: bytes) -> list[Vector]:
    return [forward(start_vector(s), rows) for s in range(4)]


def through(vector: Vector, stretch: list[Vector]) -> Vector:
    """vector after a stretch of rows."""
    costs, ranks = vector
    best = []
    for to in range(4):
        found = [(costs[s] + stretch[s][0][to], ranks[s], stretch[s][1][to]) for s in range(4) if costs[s] < FAR and stretch[s][0][to] < FAR]
        best.append(min(found, default=(FAR, 0, 0)))
    return _ranked(best)


def _packed(m: list[Vector]) -> list[int]:
    return [x for costs, ranks in m for x in (*costs, *ranks)]


def _unpacked(x: list[int]) -> list[Vector]:
    return [(tuple(x[k : k + 4]), tuple(x[k + 4 : k + 8])) for k in range(0, 32, 8)]


def borders(stretches: list[list[Vector]], start: int, end: int) -> list[tuple[int, int]]:
    """The states in which the least audit enters and leaves each stretch (-1: the conversation ends there)."""
    ahead = [start_vector(start)]
    for m in stretches[:-1]:
        ahead.append(through(ahead[-1], m))
    behind, out = end_costs(end), []
    for k in reversed(range(len(stretches))):
        behind_here = tuple(min(FAR, *(stretches[k][s][0][t] + behind[t] for t in range(4))) for s in range(4))
        entered = crossing(ahead[k], behind_here)[1]
        out.append((entered, out[-1][0] if out else end))
        behind = behind_here
    return out[::-1]


# Spark


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls in roles and texts as one space, damaged by crc32(`conv_id:turn`) % 20: 0 drops the row, 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3 repeats it, 4 makes its role user."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), (F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    hit = rows.filter("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"))
    return hit.drop("copy")


KEY = ["none", "conv"]
_ORDER = [*KEY, "dated", "at", "head_role", "head_text", "mark", "part"]
_FACTS = "rows long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, first_turn long, last_turn long, turns long"
_BLOCK = f"none boolean, conv long, part long, n long, codes binary, {_FACTS}, roles array<string>, texts array<string>"


def _sorted_rows(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows in the order of `_ORDER`, dealt by range, with `again` for those whose role and text came in an earlier turn (or another input partition)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.select(
        F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("conv"), F.col("turn").isNotNull().alias("dated"), F.coalesce("turn", F.lit(0)).alias("at"), "role", "text",
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("mark"), F.spark_partition_id().alias("part"),
    )
    rows = scratch.staged(rows, "turns")
    place = F.struct("dated", "at", "part")
    repeats = rows.groupBy(*KEY, "mark").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first")).filter("copies > 1").drop("copies")
    repeats = scratch.staged(repeats, "repeats")
    few = repeats.count() <= FEW
    rows = rows.join(F.broadcast(repeats) if few else repeats, [*KEY, "mark"], "left")
    trimmed = F.rtrim("text", F.lit(WHITE))
    rows = rows.select(
        *KEY, "dated", "at", "role", "text", "mark", "part", F.left("role", F.lit(16)).alias("head_role"), F.left("text", F.lit(64)).alias("head_text"),
        F.coalesce(place > F.col("first"), F.lit(False)).alias("again"), (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    return rows.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a partition's rows."""
    task = TaskContext.get()
    part = task.partitionId() if task else 0
    legal, n = {"su", "ua", "au"}, 0
    schema = pa.schema([("none", pa.bool_()), ("conv", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("codes", pa.binary()), *((c, pa.int64()) for c in ("rows", "blank", "duplicate", "truncated", "illegal")), ("first_initial", pa.string()), ("last_initial", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
    held: list[dict] = []
    block: dict | None = None
    before, size, waiting = None, 0, 0
    for batch in batches:
        for none, conv, dated, turn, role, text, mark, again, blank, truncated in zip(*(batch.column(k).to_pylist() for k in range(10))):
            if block is None or (block["none"], block["conv"]) != (none, conv) or block["rows"] >= BLOCK_ROWS or size + len(text) > BLOCK_BYTES:
                if block:
                    held.append(block)
                    waiting += size
                if len(held) >= 5000 or waiting > BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist([b | {"codes": bytes(b["codes"])} for b in held], schema)
                    held, waiting = [], 0
                block = dict(none=none, conv=conv, part=part, n=n, codes=bytearray(), rows=0, blank=0, duplicate=0, truncated=0, illegal=0, first_initial=role[:1], last_initial=None, first_turn=None, last_turn=None, turns=0, roles=[], texts=[])
                n, size = n + 1, 0
            same = (none, conv, dated, turn, mark)
            duplicate = not blank and (again or same == before)
            fault = "blank" if blank else "duplicate" if duplicate else "truncated" if truncated else None
            if fault:
                block[fault] += 1
            if block["rows"] and block["last_initial"] + role[:1] not in legal:
                block["illegal"] += 1
            if dated and turn != block["last_turn"]:
                block["turns"] += 1
                block["last_turn"] = turn
                block["first_turn"] = turn if block["first_turn"] is None else block["first_turn"]
            block["codes"].append(code(role[:1], blank or duplicate, fault == "truncated"))
            block["rows"] += 1
            block["last_initial"] = role[:1]
            block["roles"].append(role)
            block["texts"].append(text)
            before, size = same, size + len(text)
    if block:
        held.append(block)
    if held:
        yield pa.RecordBatch.from_pylist([b | {"codes": bytes(b["codes"])} for b in held], schema)


def _border_states(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """none, conv, part, n, entered, left of each block of the conversations that have several."""
    several = scratch.staged(blocks.groupBy(*KEY).agg(F.count(F.lit(1)).alias("blocks")).filter("blocks > 1").select(*KEY), "long-conversations")
    few = several.count() <= FEW
    mine = blocks.select(*KEY, "part", "n", "codes").join(F.broadcast(several) if few else several, KEY, "left_semi")

    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([_packed(matrix(x)) for x in b.column(4).to_pylist()], pa.list_(pa.int64()))], names=[*KEY, "part", "n", "m"])

    key = "none boolean, conv long"
    matrices = scratch.staged(mine.mapInArrow(measure, f"{key}, part long, n long, m array<long>"), "matrices")

    def product(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        vectors = [start_vector(s) for s in range(4)]
        for x in table.column("m").to_pylist():
            step = _unpacked(x)
            vectors = [through(v, step) for v in vectors]
        return table.slice(0, 1).select([*KEY, "part"]).append_column("m", pa.array([_packed(vectors)], pa.list_(pa.int64())))

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        found = borders([_unpacked(x) for x in table.column("m").to_pylist()], 0, -1)
        return pa.table([*table.select([*KEY, "part"]).columns, *(pa.array([f[k] for f in found], pa.int64()) for k in range(2))], names=[*KEY, "part", "s", "e"])

    def meet_within(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        found = borders([_unpacked(x) for x in table.column("m").to_pylist()], table.column("s")[0].as_py(), table.column("e")[0].as_py())
        return pa.table([*table.select([*KEY, "part", "n"]).columns, *(pa.array([f[k] for f in found], pa.int64()) for k in range(2))], names=[*KEY, "part", "n", "entered", "left"])

    parts = matrices.groupBy(*KEY, "part").applyInArrow(product, f"{key}, part long, m array<long>")
    states = scratch.staged(parts.groupBy(*KEY).applyInArrow(meet, f"{key}, part long, s long, e long"), "partition-borders")
    return scratch.staged(matrices.join(states, [*KEY, "part"]).groupBy(*KEY, "part").applyInArrow(meet_within, f"{key}, part long, n long, entered long, left long"), "block-borders")


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = b.schema.names
        at = {c: k for k, c in enumerate(names)}
        letters, costs, roles, texts = [], [], [], []
        for codes, own_roles, own_texts, entered, left in zip(*(b.column(at[c]).to_pylist() for c in ("codes", "roles", "texts", "entered", "left"))):
            letters.append(audit(codes, entered, left))
            costs.append(audit_cost(letters[-1], codes))
            r, t = apply_audit(letters[-1], own_roles, own_texts, entered)
            roles.append(r)
            texts.append(t)
        facts = [b.column(at[c]) for c in (*KEY, "part", "n", *(x.split()[0] for x in _FACTS.split(", ")))]
        lists = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([*facts, pa.array(costs, pa.int64()), pa.array(letters, pa.string()), pa.array(roles, lists), pa.array(texts, lists), b.column(at["whole"])], names=[*KEY, "part", "n", *(x.split()[0] for x in _FACTS.split(", ")), "cost", "audit", "roles", "texts", "whole"])


_REPAIRED = f"none boolean, conv long, part long, n long, {_FACTS}, cost long, audit string, roles array<string>, texts array<string>, whole boolean"


def repair_blocks(turns: DataFrame) -> DataFrame:
    """Repaired conversations as blocks of rows: none, conv (the conversation), part, n (order of its blocks), facts about the rows, audit, roles and texts after the edits, whole (it is the conversation's only block).

    turns: conv_id, turn, role, text. Rows are in the order of turn, nulls first; rows of one turn by the first 16 characters
    of the role, the first 64 of the text, and then a digest of both. A null role or text is one space; a role whose initial
    is not s, u or a (or has none) cannot be kept as it is. Rows with a null conv_id are one conversation. A row's first
    fault counts: blank (white space only), duplicate (its role and text came earlier), truncated (its last other character
    is not `.`, `!` or `?`). Blank and duplicate rows must be deleted. Repeated rows are duplicates. An empty table gives no
    rows; other columns are not looked at. Texts may be of any length: a long one is a block of its own.
    """
    scratch = Scratch()
    blocks = staged(_sorted_rows(turns, scratch).select(*KEY, "dated", "at", "role", "text", "mark", "again", "blank", "truncated").mapInArrow(_cut, _BLOCK), "blocks")
    scratch.discard()
    states = _border_states(blocks, scratch)
    place = [*KEY, "part", "n"]
    few = states.count() <= FEW
    found = F.broadcast(states) if few else states
    alone = blocks.join(found, place, "left_anti").withColumns({"entered": F.lit(0).cast("long"), "left": F.lit(-1).cast("long"), "whole": F.lit(True)})
    parts = blocks.join(found, place).withColumn("whole", F.lit(False))
    columns = [*alone.columns]
    out = staged(alone.unionByName(parts.select(*columns)).mapInArrow(_repair, _REPAIRED), "repaired")
    scratch.discard()
    discard(blocks)
    return out


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """conv_id, part, n, place, role, text: the turns of repaired blocks, one row each; part, n and place give their order."""
    rows = repaired.select(_conv_id(), "part", "n", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "turn"))
    return rows.select("conv_id", "part", "n", "place", F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text"))


def _conv_id() -> Column:
    return F.when(~F.col("none"), F.col("conv")).alias("conv_id")


_REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order to one row per conversation; of a conversation the digest's state, the counts and the audit are held."""
    legal, now, out = {"su", "ua", "au"}, None, []

    def row() -> tuple:
        letters = "".join(now["audit"])
        gaps = now["last"] - now["first"] + 1 - now["turns"] if now["turns"] else 0
        return now["id"], gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["cost"], letters, now["sha"].hexdigest()

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        arrays = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, names=_REPORT)

    for b in batches:
        for r in b.to_pylist():
            key = (r["none"], r["conv"])
            if now is None or now["key"] != key:
                if now:
                    out.append(row())
                now = dict(key=key, id=None if r["none"] else r["conv"], sha=hashlib.sha256(), started=False, blank=0, duplicate=0, truncated=0, illegal=0, turns=0, cost=0, first=None, last=None, initial=None, audit=[])
            for c in ("blank", "duplicate", "truncated", "illegal", "turns", "cost"):
                now[c] += r[c]
            if now["initial"] is not None and now["initial"] + r["first_initial"] not in legal:
                now["illegal"] += 1
            now["initial"] = r["last_initial"]
            if r["turns"]:
                now["turns"] -= now["last"] == r["first_turn"]  # a turn that lies on both sides of the border
                now["first"] = r["first_turn"] if now["first"] is None else now["first"]
                now["last"] = r["last_turn"]
            now["audit"].append(r["audit"])
            if r["roles"]:
                text = "\n".join(f"{x}:{y}" for x, y in zip(r["roles"], r["texts"]))
                now["sha"].update((("\n" if now["started"] else "") + text).encode())
                now["started"] = True
        if out:
            yield batch()
    if now:
        out.append(row())
        yield batch()


def conversation_report(repaired: DataFrame) -> DataFrame:
    """One row per conversation of repaired blocks: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation of several blocks goes along one task, block by block: the digest of its whole text leaves no other way.
    Whole ones stay where they are.
    """
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    columns = repaired.drop("rows")
    ordered = columns.filter("NOT whole").repartition(*KEY).sortWithinPartitions(*KEY, "part", "n")
    return columns.filter("whole").mapInArrow(_report, schema).unionByName(ordered.mapInArrow(_report, schema))
