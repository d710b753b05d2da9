"""Every copy of a template is found, passages that repeat inside a template are matched at all places, short phrases alone."""

import pyarrow as pa

from cohortloom.llm.licenses import PHRASES, TEMPLATES, automaton, pieces_of, scan_row
from cohortloom.llm.text import chunks

T = dict(TEMPLATES)
LABELS = [label for label, _ in TEMPLATES]


def scan(text, phrases=PHRASES, templates=TEMPLATES):
    machine = automaton(phrases, templates)
    _, pieces = pieces_of(machine, next(chunks(pa.array([text]))))
    places, found = scan_row(machine, pieces.get(0, []))
    return sorted(places), sorted((templates[t][0], a, b, round(c, 6)) for t, a, b, c in found)


def test_every_copy_is_found():
    mit = T["mit"].split()
    for gap in (0, 3, 60):
        step = len(mit) + gap
        _, found = scan((T["mit"] + " " + "foo " * gap) * 7)
        assert [f for f in found if f[0] == "mit"] == [("mit", i * step, i * step + len(mit), 1.0) for i in range(7)]
    _, found = scan((T["isc"] + " x ") * 3_000)
    assert len([f for f in found if f[0] == "isc"]) == 3_000


def test_repeated_passage_of_a_template():
    bsd = T["bsd"].split()
    twice = "the above copyright notice this list of conditions and the following disclaimer".split()
    starts = [i for i in range(len(bsd)) if bsd[i : i + len(twice)] == twice]
    assert len(starts) == 2
    # The first passage is edited away; only its second place continues the chain.
    end = starts[1] + len(twice)
    text = bsd[: starts[0] - 6] + ["foo"] * 3 + bsd[starts[0] + len(twice) : starts[1]] + ["bar"] + twice + ["baz"] + bsd[end:]
    _, found = scan(" ".join(text))
    covered = len(bsd) - len(twice) - 6
    assert [f for f in found if f[0] == "bsd"] == [("bsd", 0, len(text), round(covered / len(bsd), 6))]


def test_phrases_of_one_word():
    phrases = (("gpl", "gpl"), ("free software", "free"))
    assert scan("gpl", phrases)[0] == [(0, 0)]
    assert scan("foo gpl bar GPL, free software gpl", phrases)[0] == [(0, 1), (0, 3), (0, 6), (1, 4)]
