"""Which plain strings a text must hold for a pattern to match it, so that patterns are tried only where they can match."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.functions.batches import Finder, chunks, flat_texts

try:
    from re import _parser as parser
except ImportError:  # Python before 3.11
    import sre_parse as parser  # type: ignore[no-redef]

#: The shortest string worth a look in bytes, the most strings of one clause, and the clauses of one pattern.
LEAST, MOST, CLAUSES = 3, 40, 3
#: Letters that other scripts' letters equal when case is folded by Unicode.
_FOLDED = set("kKsSiI")


def _worth(clause: frozenset[str]) -> tuple[int, int]:
    """Clauses of long strings, and of few, leave out most texts."""
    return min(len(x.encode()) for x in clause), -len(clause)


def _needed(parts) -> list[frozenset[str]]:
    """Clauses that every match of a parsed pattern meets: one string at least of each is in it."""
    clauses: list[frozenset[str]] = []
    run = ""
    for kind, value in [*parts, (None, None)]:
        name = str(kind)
        if name == "LITERAL":
            run += chr(value)
            continue
        if len(run.encode()) >= LEAST:
            clauses.append(frozenset([run.lower()]))
        run = ""
        if name == "SUBPATTERN":
            clauses += _needed(value[-1])
        elif name == "ATOMIC_GROUP":
            clauses += _needed(value)
        elif name == "BRANCH":
            each = [max(_needed(p), key=_worth, default=None) for p in value[1]]
            if all(each) and len(union := frozenset().union(*each)) <= MOST:
                clauses.append(union)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
            clauses += _needed(value[2])
    return clauses


@cache
def required(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Clauses of lower-case strings: of each clause one string is in the lower-case form of every text that the pattern
    matches. Empty where nothing is sure."""
    flags = re.match(r"\(\?([a-z]+)\)", pattern)
    try:
        found = _needed(parser.parse(pattern.replace("(?iu)", "(?i)").replace("(?isu)", "(?is)")))
    except (re.error, OverflowError):
        return ()
    fine = [c for c in dict.fromkeys(found) if all(x == x.lower().upper().lower() for x in c)]
    if flags and "u" in flags[1]:
        fine = [c for c in fine if not any(_FOLDED & set(x) for x in c)]
    return tuple(tuple(sorted(c)) for c in sorted(fine, key=_worth, reverse=True)[:CLAUSES])


def held(lower: Column, patterns) -> Column:
    """Of the strings that the patterns need, those that a text, given in lower case, holds."""
    every = needed_by(patterns)
    strings = F.lit(every) if every else F.array().cast("array<string>")
    # the text is an element of an array, as else its lower case would be worked out for every string
    return F.flatten(F.transform(F.array(lower), lambda text: F.filter(strings, lambda x: F.contains(text, x))))


def needed_by(patterns) -> list[str]:
    """The strings that the patterns need."""
    return sorted({x for p in patterns for clause in required(p) for x in clause})


class Needs:
    """Which of some patterns texts in lower case may match, by the strings that they hold."""

    def __init__(self, patterns):
        self.find = Finder(needed_by(patterns))
        clauses = [(i, clause) for i, p in enumerate(patterns) for clause in required(p)]
        self.of = [[k for k, (_, clause) in enumerate(clauses) if x in clause] for x in needed_by(patterns)]
        self.pattern, self.least = [i for i, _ in clauses], [len(required(p)) for p in patterns]
        self.always = [i for i, n in enumerate(self.least) if not n]

    def __call__(self, data, offsets) -> list[list[int]]:
        """The numbers of the patterns that each text may match, in order."""
        out = []
        for found in self.find(data, offsets):
            met: dict[int, int] = {}
            for k in {k for i in found for k in self.of[i]}:
                met[self.pattern[k]] = met.get(self.pattern[k], 0) + 1
            out.append(sorted([i for i, n in met.items() if n == self.least[i]] + self.always))
        return out


def held_in_task(lower: Column, patterns) -> Column:
    """held() of a column, empty for null texts, by one search for all strings."""
    strings = needed_by(patterns)

    @F.arrow_udf("array<string>")
    def run(texts):
        import pyarrow as pa

        find = Finder(strings)
        rows = [[strings[i] for i in f] for a, b in chunks(flat_texts(texts)[1]) for f in find(*flat_texts(texts.slice(a, b - a)))]
        return pa.array(rows, pa.list_(pa.string()))

    # else the optimiser repeats the function, and all that leads to it, wherever its result is used
    return run.asNondeterministic()(lower)


def may_match(found: Column, pattern: str) -> Column:
    """Whether a text whose strings held() found holds what the pattern needs."""
    out = F.lit(True)
    for clause in required(pattern):
        out = out & F.arrays_overlap(found, F.lit(list(clause)))
    return out
