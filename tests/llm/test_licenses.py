import random

from brute import alnum_words

from cohortloom.llm.licenses import PHRASES, TEMPLATES, Automaton, automaton, license_digest

MIT = dict(TEMPLATES)["mit"]
CASES = [
    None,
    "",
    "Licensed under CC BY-NC 4.0. All rights reserved.",
    "all all rights reserved rights reserved GENERAL Public license cc by cc by",
    "the license of the software by cc all rights",
    "é cc  by\nÉ",
    "cc" + " cc by" * 20_000,
    "Copyright. " + MIT.upper().replace(" ", ", "),
    "foo " * 50 + " ".join(MIT.split()[:40]) + " bar " * 5 + " ".join(MIT.split()[40:]),
    "permission is hereby",
    "by all rights reserved general public license",
]


def plain(text):
    w = alnum_words(text)
    places = [(i, label) for phrase, label in PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), places


def test_matches_plain_version(spark):
    rows = [(i, t, 5) for i, t in enumerate(CASES)] + [(3, CASES[3], 5), (None, CASES[2], 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels int")
    got = license_digest(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, text, _ in rows:
        n, places = plain(text)
        r = by_id[i]
        assert (r.n_words, r.n_base) == (n, len(places))
        starts = [p for p, _ in places]
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert by_id[7].labels == "mit" and by_id[7].score == 1.0
    assert by_id[8].labels == "mit" and by_id[8].findings[0].first == 50
    assert by_id[9].score == 0.0
    assert license_digest(df.limit(0)).count() == 0


def test_matching_statistics():
    rng = random.Random(3)
    letters = "a b c".split()
    sequences = tuple((" ".join(rng.choice(letters) for _ in range(rng.randint(2, 9))), "x") for _ in range(6))
    machine = Automaton((), tuple((label, text) for text, label in sequences))
    grams = {tuple(s.split()[i:j]) for s, _ in sequences for i in range(20) for j in range(i + 1, len(s.split()) + 1)}
    for _ in range(50):
        text = [rng.choice([w for w in letters if w in machine.words]) for _ in range(30)]
        for i, _, length in machine.walk([machine.words[w] for w in text]):
            want = max((n for n in range(i + 2) if tuple(text[i + 1 - n : i + 1]) in grams), default=0)
            assert length == want


def test_automaton_is_small():
    machine = automaton(PHRASES, TEMPLATES)
    assert len(machine.states) < 2 * sum(machine.lengths)
