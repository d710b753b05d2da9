import random
import zlib

import numpy as np
import pytest
from brute import sha

from cohortloom.llm.tries import DoubleArray, prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    """Contract rows, sorted."""
    own = {}
    for conv in {r[0] for r in rows if r[0] is not None}:
        said = sorted(((t is not None, t or 0, (r or "").encode(), (x or "").encode()) for c, t, r, x in rows if c == conv))
        own[conv] = [(r.decode(), x.decode()) for *_, r, x in said]
    nodes = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        donor = own.get(conv - (conv % 100 if conv >= 0 else -(-conv % 100)), [])
        seq = tuple(donor[:h] + turns[h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append((conv, d == len(seq)))
    kids = {k: [j for j in nodes if len(j) == len(k) + 1 and j[: len(k)] == k] for k in nodes}
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[j] for j in kids[k]) or 1
        saved[k] = (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[j] for j in kids[k])
    out = []
    for k, members in nodes.items():
        up = min(c for c, _ in nodes[k[:-1]]) if k else None
        ends = ",".join(str(c) for c in sorted(c for c, end in members if end))
        out.append((min(c for c, _ in members), len(k), up, len(members), len(kids[k]), leaves[k], saved[k], sha(ends)))
    return sorted(out, key=str)


def made(seed):
    rnd = random.Random(seed)
    rows = []
    for conv in [*range(95, 130), *range(200, 240), -105, -100, -7, None]:
        for i in range(rnd.choice([1, 1, 2, 4, 6, 7, 12, 30])):
            role = rnd.choice(["user", "assistant", None, ""]) if rnd.random() < 0.2 else ["user", "assistant"][i % 2]
            rows.append((conv, None if rnd.random() < 0.03 else rnd.choice([i, i, i, i + 1]), role, rnd.choice(["a", "bb", "é", None, "", "x" * 3000])))
    rows += [(1000 + c, i, "user", f"same {i}") for c in range(60) for i in range(9)]
    return rows


@pytest.mark.parametrize(("most", "shard"), [(1024, 1 << 17), (1024, 12), (3, 40)])
def test_matches_plain_version(spark, most, shard):
    rows = made(5)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(4)
    got = prefix_trie(df, most=most, shard=shard)
    assert tuple(got.columns) == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie(df).count() == 0


def test_double_array_finds_exactly_its_children():
    rnd = np.random.default_rng(1)
    trie, children, states = DoubleArray(), {}, [0]
    for _ in range(300):
        state = states.pop(0)
        codes = sorted({int(c) for c in rnd.integers(1, 200, rnd.integers(1, 20))})
        base = trie.add(state, codes)
        children[state] = {c: base + c for c in codes}
        states += [base + c for c in codes]
    for state, known in children.items():
        found = {c: trie.base[state] + c for c in range(1, 200) if trie.base[state] + c < len(trie.check) and trie.check[trie.base[state] + c] == state}
        assert found == known
