import random
import re
import zlib

import pytest
from brute import sha

from cohortloom.llm.repair import END, NEVER, audit_damaged, repair, solve

EDGES = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """(cost, audit, turns) by dynamic programming over (rows read, last letter); rows are (role, text, fault)."""
    best = {"": (0, "", [])}

    def put_in(best):
        out = dict(best)
        for _ in range(3):
            for s, (c, a, t) in list(out.items()):
                n = "a" if s == "u" else "u"
                new = (c + 2, a + "I", [*t, (dict(u="user", a="assistant")[n], "")])
                out[n] = min(out.get(n, new), new, key=lambda v: v[:2])
        return out

    for role, text, fault in rows:
        nxt = {}

        def offer(s, v, nxt=nxt):
            nxt[s] = min(nxt.get(s, v), v, key=lambda v: v[:2])

        for s, (c, a, t) in put_in(best).items():
            offer(s, (c + 3, a + "D", t))
            if fault in ("blank", "duplicate"):
                continue
            late = fault == "truncated"
            if role[:1] and role[:1] in EDGES[s]:
                offer(role[:1], (c + late, a + "K", [*t, (role, text)]))
            n = "a" if s == "u" else "u"
            offer(n, (c + 2 + late, a + "R", [*t, (dict(u="user", a="assistant")[n], text)]))
        best = nxt
    return min((v for s, v in put_in(best).items() if s in ("", "a")), key=lambda v: v[:2])


def plain(rows):
    """Contract columns by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        left, turns = [], []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            left += [(turn is not None, turn or 0, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
        left.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        seen, judged = set(), []
        for known, turn, role, text in left:
            turns += [turn] * known
            said = re.findall("[^\x20\x09-\x0d]", text)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        cost, audit, turns_after = cheapest(judged)
        initials = [r[0][:1] for r in judged]
        faults = [r[2] for r in judged]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        text = "\n".join(f"{r}:{t}" for r, t in turns_after)
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha(text))
    return out


def made(seed, n):
    rnd = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "unnamed"], ["Yes.", "no", "", " \t", None, "Why?\n", "é", "ok!  ", "Yes."]
    rows = []
    for conv in [*range(n), None]:
        for i in range(rnd.choice([1, 2, 3, 5, 8, 40])):
            text = rnd.choice(texts) if rnd.random() < 0.4 else f"turn {rnd.randrange(9)}" + rnd.choice(["", ".", "? "])
            role = rnd.choice(roles) if rnd.random() < 0.4 else ["user", "assistant"][i % 2]
            rows.append((conv, None if rnd.random() < 0.05 else rnd.choice([i, i, i, i + 1, -3]), role, text))
    rows += [(500, i % 7, "user", "same.") for i in range(400)] + [(501, 1, "user", "x" * 300_000)]
    return rows


@pytest.mark.parametrize("most", [1024, 3])
def test_matches_plain_version_in_one_piece_and_in_many(spark, most):
    rows = made(7, 60)
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in audit_damaged(df, most=most).collect()}
    assert got == plain(rows)


def test_prices_agree_with_plain_shortest_paths():
    rnd = random.Random(3)
    for _ in range(300):
        code = "".join(rnd.choice("suaxSUAX") for _ in range(rnd.randrange(1, 17)))
        prices, traces = solve(code, END)
        rows = [({"s": "system", "u": "user", "a": "assistant", "x": "tool"}[c.lower()], "t", "truncated" if c.isupper() else "") for c in code]
        cost, audit, _ = cheapest(rows)
        assert prices[0] == cost and audit.startswith(traces[0][0])
    assert solve("ss", (0, NEVER, NEVER, NEVER))[0] == (6, NEVER, NEVER, NEVER)


def test_repaired_turns_and_empty_table(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "More."), (1, 2, "assistant", "cut"), (2, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: ([(t.role, t.text) for t in r.repaired], r.audit, r.cost) for r in repair(df).collect()}
    assert got[1] == ([("user", "Hi."), ("assistant", ""), ("user", "More."), ("assistant", "cut")], "KIKK", 3)
    assert got[2] == ([], "D", 3)
    assert repair(df.limit(0)).count() == 0
    assert audit_damaged(df.limit(0)).count() == 0
