"""Secret scan with a trigram index.

Each rule's regex is reduced to a Boolean query over trigrams that every match must contain (lower-cased). The index of
the rows holds one posting bit per trigram asked for, stored with the row (an index partitioned by document), so that
postings are intersected with bit operations and no posting or text is shuffled. Rows that satisfy a rule's query are
verified with the regex itself; a rule without mandatory trigrams is run over every row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.text import ascii_lower


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and non-overlapping; a match stays if ``group`` has ``least`` or more characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# The three base kinds, in the order in which ties of a start are listed. The pattern of ``access`` and
# ``hex`` holds its own least length, which for one maximal run of a class is the same as dropping short runs.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
)
#: Kinds that the method adds: public token formats with a fixed prefix.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)

MOST_STRINGS = 64


def _strings(items) -> set[str] | None:
    """All strings that a piece of a regex can match, lower-cased, or None when they are many or unbounded."""
    out = {""}
    for op, arg in items:
        part = _strings_of(op, arg)
        if part is None or len(out) * len(part) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def _strings_of(op, arg) -> set[str] | None:
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
        return {chr(a).lower() for _, a in arg}
    if op is sre.SUBPATTERN:
        return _strings(arg[3])
    if op is sre.BRANCH:
        parts = [_strings(branch) for branch in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is sre.MAX_REPEAT and arg[1] is not sre.MAXREPEAT and arg[1] <= 3:
        once = _strings(arg[2])
        return None if once is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in _products(once, n)}
    return {""} if op is sre.AT else None


def _products(once: set[str], n: int) -> list[tuple[str, ...]]:
    return reduce(lambda heads, _: [(*h, x) for h in heads for x in once], range(n), [()])


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """Clauses that all hold for a text with a match; a clause is a list of alternatives, each a list of trigrams."""
    clauses: list[list[list[str]]] = []

    def close(run: set[str]) -> set[str]:
        if all(len(s) >= 3 for s in run):
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            # An alternative that asks for more than another one adds nothing.
            clauses.append(sorted(sorted(x) for x in sets if not any(y < x for y in sets)))
        return {""}

    def walk(items, run: set[str]) -> set[str]:
        for op, arg in items:
            part = _strings_of(op, arg)
            if part is not None and len(run) * len(part) <= MOST_STRINGS:
                run = {a + b for a in run for b in part}
            elif part is not None:
                close(run)
                run = part
            elif op is sre.SUBPATTERN:
                run = walk(arg[3], run)
            else:  # a class or a repeat without bound ends the known run
                run = close(run)
        return run

    close(walk(sre_parser.parse(pattern), {""}))
    return clauses


def posting_bits(lowered: Column, trigrams: list[str]) -> list[Column]:
    """The postings of a row: one bit per trigram, 62 to a word."""
    words = []
    for at in range(0, len(trigrams), 62):
        bits = [F.when(F.contains(lowered, F.lit(t)), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, t in enumerate(trigrams[at : at + 62])]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), bits))
    return words


def candidates(rule: Rule, trigrams: list[str], word: str) -> Column:
    """Whether a row's postings satisfy the rule's query."""

    def has(alternative: list[str]) -> Column:
        masks: dict[int, int] = {}
        for t in alternative:
            at = trigrams.index(t)
            masks[at // 62] = masks.get(at // 62, 0) | 1 << at % 62
        return reduce(lambda a, b: a & b, [F.col(f"{word}{w}").bitwiseAND(F.lit(m)) == F.lit(m) for w, m in masks.items()])

    clauses = [reduce(lambda a, b: a | b, [has(x) for x in clause]) for clause in trigram_query(rule.pattern)]
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def rule_spans(df: DataFrame, text: str, rule: Rule, rank: int, wanted: Column, out: str) -> DataFrame:
    """Add the array of the rule's spans to the rows; rows that are not ``wanted`` get an empty array.

    The pieces between matches and the matches themselves, laid end to end, give every position in code points. The work
    grows with the square of the matches in one text, not with its length.
    """
    pattern = F.lit(rule.pattern)
    none = F.array().cast("array<string>")
    df = df.withColumn("__m", F.when(wanted, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(none))
    some = F.size("__m") > 0
    df = df.withColumn("__p", F.when(some, F.split(text, rule.pattern, -1)).otherwise(none))
    inner = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else F.col("__m")
    df = df.withColumn("__g", F.when(some, inner).otherwise(none))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, s: acc + F.char_length(s))

    def span(m: Column, i: Column) -> Column:
        start = total(F.slice("__p", 1, i + 1)) + total(F.slice("__m", 1, i))
        ok = F.char_length(F.get("__g", i)) >= rule.least
        return F.when(ok, F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (start + F.char_length(m)).alias("end")))

    found = F.filter(F.transform("__m", span), lambda s: s.isNotNull())
    return df.withColumn(out, F.when(some, found).otherwise(F.array().cast(SPAN))).drop("__m", "__p", "__g")


def scan_secrets(docs: DataFrame, text: str = "text", more: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """The rows with ``secret_spans``, an array of (start, rank, kind, end) by start and rank (code points, end exclusive).

    Null and empty texts have no spans; equal rows have equal spans; an empty table stays empty. The other columns pass
    through, but for one that is already called secret_spans, which is replaced. No shuffle and no Python.
    """
    rules = (*BASE_RULES, *more)
    trigrams = sorted({t for r in rules for clause in trigram_query(r.pattern) for alt in clause for t in alt})
    kept = [c for c in docs.columns if c != "secret_spans"]
    df = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    df = df.withColumn("__lower", ascii_lower(F.col("__text")))
    words = posting_bits(F.col("__lower"), trigrams)
    df = df.select("*", *[w.alias(f"__bits{i}") for i, w in enumerate(words)]).drop("__lower")
    for rank, rule in enumerate(rules):
        df = rule_spans(df, "__text", rule, rank, candidates(rule, trigrams, "__bits"), f"__spans{rank}")
    spans = F.array_sort(F.concat(*[f"__spans{i}" for i in range(len(rules))]))
    return df.select(*[F.col(f"`{c}`") for c in kept], spans.alias("secret_spans"))


def secret_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, counts of the base kinds, the hash of the base spans and all spans as text."""
    base = len(BASE_RULES)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    df = scan_secrets(docs.select(F.col(key).alias("__key"), F.col(text).alias("text")))
    df = df.withColumn("__base", F.filter("secret_spans", lambda s: s["rank"] < base))
    count = lambda rank: F.size(F.filter("__base", lambda s: s["rank"] == rank)).cast("bigint")
    return df.select(
        F.col("__key").alias(key),
        *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)],
        F.sha2(joined(F.col("__base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
    )
