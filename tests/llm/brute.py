"""Plain versions of the operators' contracts, for comparison on small tables."""

import hashlib
import re

ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(text):
    return (text or "").translate(FOLD)


def alnum_words(text):
    return ALNUM.findall(fold(text))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(text):
    """Counts and base spans of the secret contract."""
    t = text or ""
    keys = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    spans = [(m.start(), 0, "assign", m.end()) for m in keys.finditer(t) if len(m[2]) >= 8]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    text_spans = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))
    return tuple(sum(x[1] == i for x in spans) for i in range(3)), text_spans


def contamination(docs, items):
    """doc rows (id, text) and item rows (id, text) -> list of (id, n_words, n_hit, item ids as sorted text)."""
    windows = []
    for item, text in items:
        w = alnum_words(text)
        n = min(13, len(w))
        windows += [(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    out = []
    for doc, text in docs:
        w = alnum_words(text)
        hit, found = set(), set()
        for item, g in windows:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found.add(str(item))
        out.append((doc, len(w), len(hit), ",".join(sorted(found))))
    return out
