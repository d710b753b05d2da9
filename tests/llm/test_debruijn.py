import random
import re

from brute import sha

from cohortloom.llm.debruijn import SPAN, remove_repeats, repeat_digest

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(rows):
    """(key, n_words, n_removed, hash of the kept words) of every row."""
    words = [(k, WORD.findall(t or "")) for k, t in rows]
    low = {}
    for k, w in words:
        for i in range(len(w) - SPAN + 1 if k is not None else 0):
            g = tuple(w[i : i + SPAN])
            low[g] = min(low.get(g, k), k)
    out = []
    for k, w in words:
        gone = set()
        for i in range(len(w) - SPAN + 1 if k is not None else 0):
            if low[tuple(w[i : i + SPAN])] < k:
                gone |= set(range(i, i + SPAN))
        out.append((k, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


def made(seed):
    rnd = random.Random(seed)
    some = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    passages = [some(n) for n in (49, 50, 51, 70, 120, 400)] + [["a", "b", "c"] * 40, ["é"] * 130]
    rows = []
    for k in range(120):
        w = some(rnd.choice([0, 3, 40, 90]))
        for _ in range(rnd.choice([0, 1, 1, 2, 4])):
            p = rnd.choice(passages)
            cut = rnd.choice([0, 0, rnd.randrange(len(p))])
            w += p[cut : cut + rnd.choice([len(p), len(p), rnd.randrange(1, 90)])] + some(rnd.choice([0, 0, 5, 60]))
        rows.append((k, rnd.choice([" ", "\n", "\t \x0b"]).join(w)))
    hot = " ".join(passages[4])
    rows += [(200 + i, hot if i % 2 else f"{i} {hot} end") for i in range(150)]
    rows += [(500, None), (501, ""), (502, " \n"), (None, hot), (None, None), (3, hot), (3, hot), (600, " ".join(some(30_000) + passages[5]))]
    return rows


def test_matches_plain_version(spark):
    rows = made(2)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, first int, low int").repartition(6)
    got = repeat_digest(df)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_keys_of_text_kept_words_and_empty_table(spark):
    twice = " ".join(f"x{i}" for i in range(60))
    df = spark.createDataFrame([("a", twice), ("b", f"new  {twice}\tend")], "name string, body string")
    got = {r.name: (r.n_words, r.n_removed, bytes(r.kept)) for r in remove_repeats(df, "name", "body").collect()}
    assert got == {"a": (60, 0, twice.encode()), "b": (62, 60, b"new end")}
    assert remove_repeats(df.limit(0), "name", "body").count() == 0
