"""Repair of the structure of conversations by shortest paths in a lattice of edits.

A repaired conversation has at most one system turn, at its start, and then pairs of user and assistant turns. A node of
the lattice is (rows read, what was said last); its arcs are the edits Delete, Insert, Keep and Rerole with small integer
costs. Cheapest edits are found by the auction algorithm: a path grows from the origin along the arc that is best at its
end's price, or the end's price rises to that of its best arc and the path contracts. Prices never break dual
feasibility, so at the end every arc of every cheapest path is tight; the ASCII-least of these paths is traced.

The lattice is solved in blocks from the end: the prices at a block's start are the exit costs of the block before. A
conversation of more than one piece is composed: each piece gives its costs from every entry to every exit state, a scan
of these small tables back and forth tells each piece its exit costs and its entry state, and pieces are repaired alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.pieces import BYTES, MOST_KEYS, ROWS, in_order, large_pieces, per_row, scan, sizes
from cohortloom.session import cut

#: States: nothing said yet, system said, user said, assistant said. Where each letter leads, and where an inserted or
#: reroled turn (the only one of user and assistant that is legal) leads.
LEADS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
PUT = (2, 2, 3, 2)
WRITES = {2: "user", 3: "assistant"}
DELETE, INSERT, REROLE, LATE = 3, 2, 2, 1
#: What it takes to end in each state, and the letters of that.
END, END_EDITS = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
NEVER = 1 << 60
#: Free rows of a block.
BLOCK = 16
BLANKS = " \t\n\x0b\x0c\r"


def lattice(block: str, exits: tuple[int, ...]) -> list[list[tuple[str, int, int]]]:
    """Arcs (label, cost, node) of every node 4 * row + state, in the order of their labels; the last node is the end."""
    n = len(block)
    arcs: list[list[tuple[str, int, int]]] = []
    for i, row in enumerate(block):
        late, letter = LATE * row.isupper(), row.lower()
        for s in range(4):
            out = [("D", DELETE, 4 * (i + 1) + s), ("I", INSERT, 4 * i + PUT[s])]
            if letter in LEADS[s]:
                out.append(("K", late, 4 * (i + 1) + LEADS[s][letter]))
            arcs.append([*out, ("R", REROLE + late, 4 * (i + 1) + PUT[s])])
    arcs += [[("", e, 4 * n + 4)] if e < NEVER else [] for e in exits]
    return arcs


@lru_cache(maxsize=1 << 16)
def solve(block: str, exits: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int] | None, ...]]:
    """Costs from each entry state to the end of a block, and the ASCII-least cheapest edits with their exit state.

    ``block`` has a letter for each row, in upper case for a truncated one; the least exit cost is zero.
    """
    arcs = lattice(block, exits)
    end = len(arcs)
    # No node that has a way to the end is farther than that.
    bound = DELETE * len(block) + 2 * INSERT + max(e for e in exits if e < NEVER)
    prices = [0] * (end + 1)
    for origin in range(4):
        path = [origin]
        while path[-1] != end and prices[origin] < NEVER:
            node = path[-1]
            best, step = min(((cost + prices[to], to) for _, cost, to in arcs[node]), default=(NEVER, end))
            if best > bound:
                best = NEVER
            if best > prices[node]:
                prices[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(step)
    arrives: dict[int, bool] = {end: True}

    def tight(node: int) -> Iterator[tuple[str, int]]:
        return ((label, to) for label, cost, to in arcs[node] if prices[node] == cost + prices[to] and leads(to))

    def leads(node: int) -> bool:
        if node not in arrives:
            arrives[node] = any(True for _ in tight(node))
        return arrives[node]

    traces: list[tuple[str, int] | None] = []
    for node in range(4):
        labels = []
        if prices[node] >= NEVER:
            traces.append(None)
            continue
        while node != end:
            last = node % 4
            label, node = next(tight(node))
            labels.append(label)
        traces.append(("".join(labels), last))
    return tuple(prices[:4]), tuple(traces)


def blocks(code: str) -> list[str]:
    return [code[i : i + BLOCK] for i in range(0, len(code), BLOCK)]


def costs_back(code: str, exits: tuple[int, ...]) -> tuple[tuple[int, ...], list[tuple[tuple[str, int] | None, ...]]]:
    """Costs from each entry state of a piece, and the traces of its blocks in order."""
    traces = []
    for block in reversed(blocks(code)):
        base = min(exits)
        prices, found = solve(block, tuple(e - base if e < NEVER else NEVER for e in exits))
        exits = tuple(p + base if p < NEVER else NEVER for p in prices)
        traces.append(found)
    return exits, traces[::-1]


def edits(traces: list, entry: int) -> tuple[str, int]:
    """Labels from an entry state through the blocks, and the exit state."""
    labels = []
    for found in traces:
        some, entry = found[entry]
        labels.append(some)
    return "".join(labels), entry


class Rows:
    """A piece: its rows with their faults. ``seen`` rows repeat an earlier row; ``n`` counts equal rows in a place."""

    def __init__(self, rows: list[dict]):
        self.rows, self.code = rows, ""
        self.faults: list[str] = []
        met: set = set()
        code = []
        for r in rows:
            said = (r["role"], r["text"])
            last = r["text"].rstrip(BLANKS)[-1:]
            fault = "blank" if not last else "duplicate" if r["seen"] or said in met else "truncated" if last not in ".!?" else ""
            met.add(said)
            self.faults.append(fault)
            if fault in ("", "truncated"):
                letter = r["role"][:1] if r["role"][:1] in ("s", "u", "a") else "x"
                code.append(letter.upper() if fault else letter)
        self.code = "".join(code)

    def forced(self, i: int) -> int:
        return self.rows[i]["n"] - (self.faults[i] in ("", "truncated"))

    def apply(self, labels: str, state: int, last: bool) -> tuple[str, list[dict], int]:
        """(edits of all rows, repaired turns, cost) of the edits of the free rows."""
        audit, turns, at, cost = [], [], 0, 0

        def forced() -> None:
            """Deletes what must go, as far as the next free row, and its repeats."""
            nonlocal at, cost
            while at < len(self.rows) and self.faults[at] in ("blank", "duplicate"):
                audit.append("D" * self.forced(at))
                cost += DELETE * self.forced(at)
                at += 1

        forced()
        for label in labels:
            if label == "I":
                state = PUT[state]
                turns.append({"role": WRITES[state], "text": ""})
                cost += INSERT
                audit.append(label)
                continue
            row, late = self.rows[at], LATE * (self.faults[at] == "truncated")
            if label == "K":
                state = LEADS[state][row["role"][:1]]
                turns.append({"role": row["role"], "text": row["text"]})
                cost += late
            elif label == "R":
                state = PUT[state]
                turns.append({"role": WRITES[state], "text": row["text"]})
                cost += REROLE + late
            else:
                cost += DELETE
            audit.append(label + "D" * self.forced(at))
            cost += DELETE * self.forced(at)
            at += 1
            forced()
        if last:
            for label in END_EDITS[state]:
                state = PUT[state]
                turns.append({"role": WRITES[state], "text": ""})
                audit.append(label)
                cost += INSERT
        return "".join(audit), turns, cost

    def facts(self) -> dict:
        """Counts of faults and what the neighbouring pieces need."""
        out = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "n_turns"), 0)
        before = turn = None
        for r, fault in zip(self.rows, self.faults, strict=True):
            letter = r["role"][:1]
            again = r["n"] - 1
            if fault:
                out[fault] += 1
            out["blank" if fault == "blank" else "duplicate"] += again
            out["illegal"] += again + (before is not None and before + letter not in ("su", "ua", "au"))
            out["n_turns"] += r["turn"] is not None and r["turn"] != turn
            before, turn = letter, r["turn"]
        some = [r["turn"] for r in self.rows if r["turn"] is not None]
        least, most = (some[0], some[-1]) if some else (None, None)
        return out | {"first_initial": self.rows[0]["role"][:1], "last_initial": before, "min_turn": least, "max_turn": most}


# ---- Tables -----------------------------------------------------------------------------------------------------------

FACTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, n_turns bigint, first_initial string, last_initial string, min_turn bigint, max_turn bigint"
PIECE = f"piece bigint, audit string, cost bigint, {FACTS}, repaired array<struct<role:string,text:string>>"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
DIGEST = ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string"


def repair_piece(row: dict, exits: tuple[int, ...], entry: int, last: bool) -> dict:
    rows = Rows(row["rows"])
    _, traces = costs_back(rows.code, exits)
    audit, turns, cost = rows.apply(edits(traces, entry)[0], entry, last)
    return rows.facts() | {"piece": row["piece"], "audit": audit, "cost": cost, "repaired": turns}


def between(row: dict) -> dict:
    """The free rows of a piece as letters, and its costs from every entry (4 * exit + entry) to every exit state."""
    code = Rows(row["rows"]).code
    table = [costs_back(code, tuple(0 if s == e else NEVER for s in range(4)))[0] for e in range(4)]
    return {"piece": row["piece"], "code": code, "table": [c for costs in table for c in costs]}


def hops(row: dict) -> dict:
    """Exit state of a piece for every entry state, with known exit costs."""
    _, traces = costs_back(row["code"], tuple(row["exits"]))
    return {"piece": row["piece"], "exits": row["exits"], "hops": [edits(traces, s)[1] for s in range(4)], "last": row["last"]}


def _back(exits, row: dict):
    last = exits is None
    exits = END if last else exits
    known = [(c, e) for c, e in zip((row["table"][4 * e : 4 * e + 4] for e in range(4)), exits, strict=True) if e < NEVER]
    entry = tuple(min([NEVER, *[c[s] + e for c, e in known]]) for s in range(4))
    return entry, {"piece": row["piece"], "code": row["code"], "exits": list(exits), "last": int(last)}


def _forth(entry: int, row: dict):
    return row["hops"][entry], {"piece": row["piece"], "exits": row["exits"], "entry": entry, "last": row["last"]}


def damage(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (key, turn, role, text, n) with the faults that crc32 of "key:turn" modulo 20 asks for: 0 drops the row, 1
    empties its text, 2 removes its end marks, 3 repeats it (``n`` = 2), 4 gives it to the user. Nulls read as one space,
    but a null turn or key stays null as such."""
    space = F.lit(" ")
    said = F.coalesce(F.col(text).cast("string"), space)
    number = F.concat(F.coalesce(F.col(key).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    code = F.crc32(number.cast("binary")) % 20
    rows = conversations.select(F.col(key).alias("key"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role).cast("string"), space).alias("role"), said.alias("text"), code.alias("code"))
    changed = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    given = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    kept = rows.filter(F.col("code") != 0)
    return kept.select("key", "turn", given.alias("role"), changed.alias("text"), F.when(F.col("code") == 3, 2).otherwise(1).cast("bigint").alias("n"))


def _large_repaired(rows: DataFrame, kind: str, most: int, size: int) -> DataFrame:
    """Repaired pieces of conversations of several pieces."""
    once = rows.groupBy("key", "turn", "role", "text").agg(F.sum("n").alias("n"))
    said = F.md5(F.concat_ws("\x00", "role", "text").cast("binary"))
    known = cut(once.withColumn("said", said))
    first = known.groupBy(F.col("key").alias("k"), F.col("said").alias("s")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"), F.count(F.lit(1)).alias("times"))
    first = first.filter("times > 1").drop("times")
    later = (F.col("turn") > F.col("first.turn")) | (F.col("turn").isNotNull() & F.col("first.turn").isNull() & F.col("first").isNotNull())
    marked = known.join(first, F.col("key").eqNullSafe(F.col("k")) & (F.col("said") == F.col("s")), "left").withColumn("seen", F.coalesce(later, F.lit(False)))
    item = F.struct("turn", "role", "text", "n", "seen")
    order = [F.col("turn"), F.col("role"), F.substring("text", 1, 64)]
    pieces = cut(large_pieces(marked, "key", order, item, F.octet_length("text"), most, size))
    tables = pieces.mapInArrow(per_row("piece bigint, code string, table array<bigint>", between), f"key {kind}, piece bigint, code string, table array<bigint>")
    back_types = "piece bigint, code string, exits array<bigint>, last bigint"
    back = in_order(tables, F.col("piece").desc()).mapInArrow(scan(back_types, None, _back), f"key {kind}, {back_types}")
    hop_types = "piece bigint, exits array<bigint>, hops array<bigint>, last bigint"
    hopped = back.repartition("piece").mapInArrow(per_row(hop_types, hops), f"key {kind}, {hop_types}")
    forth_types = "piece bigint, exits array<bigint>, entry bigint, last bigint"
    forth = in_order(hopped, "piece").mapInArrow(scan(forth_types, 0, _forth), f"key {kind}, {forth_types}")
    known_ends = forth.select(F.col("piece").alias("p"), "exits", "entry", "last")
    both = pieces.join(known_ends, F.col("piece") == F.col("p")).drop("p")
    fn = per_row(PIECE, lambda r: repair_piece(r, tuple(r["exits"]), r["entry"], bool(r["last"])))
    return both.mapInArrow(fn, f"key {kind}, {PIECE}")


def repaired_parts(rows: DataFrame, most: int = ROWS, size: int = BYTES) -> tuple[DataFrame, DataFrame | None]:
    """Pieces of conversations of one piece, and those of larger ones (None if there are none)."""
    kind = rows.schema["key"].dataType.simpleString()
    large = cut(sizes(rows, "key", F.octet_length("text") * F.col("n"), most, size).filter("large").select("group"))
    n = large.count()
    some = F.broadcast(large) if n <= MOST_KEYS else large
    same = F.col("key").eqNullSafe(F.col("group"))
    small = rows.join(some, same, "left_anti") if n else rows
    item = F.struct("turn", "role", "text", "n", F.lit(False).alias("seen"))
    whole = small.groupBy("key").agg(F.lit(0).cast("bigint").alias("piece"), F.sort_array(F.collect_list(item)).alias("rows"))
    alone = whole.mapInArrow(per_row(PIECE, lambda r: repair_piece(r, END, 0, True)), f"key {kind}, {PIECE}")
    return alone, _large_repaired(rows.join(some, same, "left_semi"), kind, most, size) if n else None


def repair(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = ROWS, size: int = BYTES) -> DataFrame:
    """Rows (key, piece, audit, cost, counts of faults, repaired): the repaired turns of a piece of a conversation, in order
    of ``piece``; most conversations are one piece.

    Turns are taken by number, nulls first, ties by role and text. A null role or text reads as one space; rows of a null
    key are one conversation. Rows that are repeated are duplicates after the first. Texts of any length; no rows, no pieces.
    """
    space = F.lit(" ")
    rows = conversations.select(
        F.col(key).alias("key"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role).cast("string"), space).alias("role"),
        F.coalesce(F.col(text).cast("string"), space).alias("text"),
        F.lit(1).cast("bigint").alias("n"),
    )
    alone, large = repaired_parts(rows, most, size)
    return (alone.unionByName(large) if large is not None else alone).withColumnRenamed("key", key)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its pieces in order; texts are hashed as they stream by."""
    out: list[dict] = []
    held: dict = {}
    kind = None

    def told() -> pa.RecordBatch:
        columns = [pa.array([r["key"] for r in out], kind)]
        columns += [pa.array([r[c] for r in out], pa.int64()) for c in COUNTS] + [pa.array([r[c] for r in out], pa.string()) for c in ("audit", "repaired_sha256")]
        return pa.RecordBatch.from_arrays(columns, names=["key", *COUNTS, "audit", "repaired_sha256"])

    def close() -> None:
        if held:
            span = 0 if held["least"] is None else held["most"] - held["least"] + 1 - held["distinct"]
            out.append({**held, "gaps": min(span, (1 << 63) - 1), "audit": "".join(held["edits"]), "repaired_sha256": held["sha"].hexdigest()})

    for batch in batches:
        kind = batch.schema.field("key").type
        for r in batch.to_pylist():
            if not held or r["key"] != held["key"]:
                close()
                held = dict.fromkeys(COUNTS, 0) | {"key": r["key"], "sha": hashlib.sha256(), "any": False, "edits": [], "least": None, "most": None, "distinct": 0, "before": None}
            for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                held[c] += r[c]
            held["illegal"] += held["before"] is not None and held["before"] + r["first_initial"] not in ("su", "ua", "au")
            held["before"] = r["last_initial"]
            if r["min_turn"] is not None:
                held["distinct"] += r["n_turns"] - (held["most"] == r["min_turn"])
                held["least"] = r["min_turn"] if held["least"] is None else held["least"]
                held["most"] = r["max_turn"]
            held["edits"].append(r["audit"])
            for t in r["repaired"]:
                held["sha"].update((("\n" if held["any"] else "") + t["role"] + ":" + t["text"]).encode())
                held["any"] = True
        if len(out) >= 1000:
            yield told()
            out = []
    close()
    if out:
        yield told()


def audit_damaged(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = ROWS, size: int = BYTES) -> DataFrame:
    """One row per conversation of the damaged rows (see :func:`damage`): key, gaps, counts of faults, cost, audit and
    repaired_sha256. A conversation that lost every row has zeros, an empty audit and the hash of the empty string; see
    :func:`repair` for nulls and ties. Extra columns are left out."""
    rows = damage(conversations, key, turn, role, text)
    kind = rows.schema["key"].dataType.simpleString()
    alone, large = repaired_parts(rows, most, size)
    types = f"key {kind}, {DIGEST}"
    found = alone.mapInArrow(_digests, types)
    if large is not None:
        found = found.unionByName(in_order(large, "piece").mapInArrow(_digests, types))
    nothing = [F.lit(0).cast("bigint").alias(c) for c in COUNTS] + [F.lit("").alias("audit"), F.sha2(F.lit("").cast("binary"), 256).alias("repaired_sha256")]
    every = conversations.select(F.col(key).alias("key")).distinct().select("key", *nothing, F.lit(0).alias("rank"))
    best = F.max_by(F.struct(*COUNTS, "audit", "repaired_sha256"), "rank").alias("best")
    return found.withColumn("rank", F.lit(1)).unionByName(every).groupBy("key").agg(best).select(F.col("key").alias(key), "best.*")
