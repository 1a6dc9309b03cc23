"""What commands and the commands inside texts can do: fetch and run, open a shell to outside, send secrets, destroy.

A capability is a condition over signals, which are patterns. A command is judged as a whole; a text in line-aligned windows,
each of which overlaps the next by half, so that signals count together only where they stand near each other.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tamis.functions.batches import Finder, chunks, flat_texts, in_task
from tamis.functions.capability_rules import CAPABILITIES, SIGNALS
from tamis.functions.literals import held, may_match, needed_by, required
from tamis.functions.text import ascii_bounds, once, text_or_empty

#: A block of whole lines has up to so many characters before its last line end, or is one longer line. A window is two blocks.
BLOCK = 1000
#: The windows that the directives to agents are read in; capabilities of texts are looked for in all windows.
HINT = r"(?i)curl|wget|fetch|base64|eval|exec|system|spawn|popen|subprocess|/dev/|/inet/|\bnc\b|ncat|socat|openssl|socket|connect|printenv|\benv\b|export|http|git\.path|BASH_ENV|terminal\.integrated|registry|index|GOPROXY|resolved|\|"
_NETCAT = re.compile("(?<![a-z0-9_])nc(?:at)?(?![a-z0-9_])")
#: What texts in lower case must hold for signals for which required() has no string, or only common ones.
_BESIDES = {"netcat_shell": [(_NETCAT,)], "pipe_file": [("mkfifo", "mknod")], "pipe_file_netcat": [("mkfifo", "mknod"), (_NETCAT,)], "hex_unpacked": [("h*",)], "eval_of_transform": [("$(",)], "fetch_substituted": [("$(",)], "environment_to_file": [(">",)]}
_FOUND = "array<struct<ord:int,id:string,decision:string>>"


def resolved(t: Column, keep_lines: bool) -> Column:
    """A command without the quotes, escapes and $IFS that split its words, and with home folders as one place.

    keep_lines keeps the line ends of a text, but joins lines that a backslash continues."""
    t = F.regexp_replace(F.regexp_replace(t, r'"?\$\{HOME:0:1\}"?', "/"), r"\$\{(?:HOME|PWD|ROOT)[^}]*\}", "/__ROOTED__")
    t = F.regexp_replace(F.regexp_replace(t, r"\\([A-Za-z0-9/.:_-])", "$1"), "['\"`]", "")
    t = F.regexp_replace(t, r"\$\{IFS\}|\$IFS", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\\\r?\n", " "), r"[ \t\r\f\x0B]+", " ") if keep_lines else F.regexp_replace(t, r"[ \t\n\r\f\x0B]+", " ")
    return F.trim(t)


def holds(t: Column, condition, strings: Column | None = None, besides: bool = False) -> Column:
    """Whether a text meets a condition; see CAPABILITIES for their forms. strings, if given, are those of the strings that the
    signals need that the text holds, besides: those of _BESIDES too; patterns that cannot match are then not tried."""
    may = lambda p: F.lit(True) if strings is None else may_match(strings, p)
    if isinstance(condition, str):
        out = may(SIGNALS[condition])
        for clause in _BESIDES.get(condition, []) if besides else []:
            out = out & F.arrays_overlap(strings, F.lit([x if isinstance(x, str) else x.pattern for x in clause]))
        return out & t.rlike(ascii_bounds(SIGNALS[condition]))
    kind, *parts = condition
    if kind in ("all", "any"):
        out = holds(t, parts[0], strings, besides)
        for p in parts[1:]:
            out = (out & holds(t, p, strings, besides)) if kind == "all" else (out | holds(t, p, strings, besides))
        return out
    if kind == "within":
        return may(parts[0]) & may(parts[1]) & F.exists(F.regexp_extract_all(t, F.lit(parts[0]), F.lit(0)), lambda x: x.rlike(ascii_bounds(parts[1])))
    if kind == "urls":
        return may(parts[0]) & F.exists(F.regexp_extract_all(t, F.lit(ascii_bounds(parts[0])), F.lit(1)), lambda x: ~x.rlike(parts[1]))
    stages = F.filter(F.transform(F.split(t, r"\|+"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")
    first, later = map(ascii_bounds, parts)

    def piped(stages):
        at = F.array_position(F.transform(stages, lambda s: s.rlike(first)), True)
        behind = F.slice(stages, (at + 1).cast("int"), F.size(stages))
        found = F.exists(behind, lambda s: (s.rlike(later) | s.rlike(ascii_bounds(SIGNALS["sends"]))) if kind == "dump" else s.rlike(later))
        return (at > 0) & found

    return may(parts[0]) & (F.array_contains(strings, "|") if besides else F.lit(True)) & once(stages, piped)


def _patterns(condition) -> list[str]:
    """The patterns of a condition of which a text must hold the strings, those of its parts included."""
    if isinstance(condition, str):
        return [SIGNALS[condition]]
    kind, *parts = condition
    return [p for part in parts for p in _patterns(part)] if kind in ("all", "any") else parts if kind == "within" else [parts[0]]


def _used(kind: str, ids=None) -> dict[str, list]:
    """The capabilities of a kind of text by their group: (ord, name, decision, condition)."""
    groups: dict[str, list] = {}
    for i, (name, group, decision, where, condition) in enumerate(CAPABILITIES):
        if where in ("both", kind) and (ids is None or name in ids):
            groups.setdefault(group, []).append((i, name, decision, condition))
    return groups


def _needed(groups: dict[str, list]) -> list[str]:
    return [p for own in groups.values() for *_, c in own for p in _patterns(c)]


def _found_in(forms: list[Column], groups: dict[str, list], besides: bool = False) -> Column:
    """Array of (ord, id, decision) by forms, each null or (text, strings), the strings that signals need which it holds."""
    def found(x):
        one = lambda own: F.coalesce(*[F.when(holds(x["text"], c, x["strings"], besides), F.struct(F.lit(i).alias("ord"), F.lit(name).alias("id"), F.lit(decision).alias("decision"))) for i, name, decision, c in own])
        return F.array_compact(F.array(*map(one, groups.values())))

    return F.array_distinct(F.flatten(F.transform(F.array_compact(F.array(*forms)), found))).cast(_FOUND)


def capabilities_of(forms: list[Column], kind: str, ids=None) -> Column:
    """Array of (ord, id, decision): of each group of capabilities, the first that one of a text's forms has."""
    groups = _used(kind, ids)
    return _found_in([F.struct(form.alias("text"), held(F.lower(form), _needed(groups)).alias("strings")) for form in forms], groups)


def command_capabilities(commands: DataFrame, id_col: str = "event_id", command_col: str = "command") -> DataFrame:
    """(id, ord, capability, decision) of commands, read as the shell reads them; null and empty commands have none."""
    c = resolved(text_or_empty(command_col), False)
    rows = commands.select(id_col, c.alias("_c")).select(id_col, F.explode(capabilities_of([F.col("_c")], "command")).alias("f"))
    return rows.select(id_col, "f.ord", F.col("f.id").alias("capability"), "f.decision")


def windows_of(text: str) -> list[str]:
    """The windows of a text: every two neighbouring blocks of whole lines; short texts are one window."""
    blocks, at, n = [], 0, len(text)
    while at < n:
        end = n if n - at <= BLOCK else text.rfind("\n", at + 1, at + BLOCK + 1) + 1 or text.find("\n", at) + 1 or n
        blocks.append(text[at:end])
        at = end
    return [a + b for a, b in zip(blocks, blocks[1:])] if len(blocks) > 1 else blocks


_CHANGES = re.compile(r"[\\'\"`$\t\r\f\x0B]|  ")
_STEPS = [(re.compile(p), put) for p, put in ((r'"?\$\{HOME:0:1\}"?', "/"), (r"\$\{(?:HOME|PWD|ROOT)[^}]*\}", "/__ROOTED__"), (r"\\([A-Za-z0-9/.:_-])", r"\1"), ("['\"`]", ""), (r"\$\{IFS\}|\$IFS", " "), (r"\\\r?\n", " "), (r"[ \t\r\f\x0B]+", " "))]
def resolved_lines(text: str) -> str:
    """resolved() with its lines kept, of a Python string."""
    if _CHANGES.search(text):
        for pattern, put in _STEPS:
            text = pattern.sub(put, text)
    return text.strip(" ")


#: What the shell may leave out between two letters, in the dialect of Arrow.
_LEFT_OUT = "['\"`\\\\]*"


def _clauses(condition) -> list[tuple]:
    """Of each clause, a text that meets the condition, which is no list of others, holds one string or match."""
    if isinstance(condition, str):
        return [*required(SIGNALS[condition]), *_BESIDES.get(condition, [])]
    kind, first, *others = condition
    return [*required(first), *(required(others[0]) if kind == "within" else [("|",)] if kind in ("pipe", "dump") else [])]


def _possible(condition):
    """A function of what a text holds: whether the text may meet a condition."""
    if not isinstance(condition, str) and condition[0] in ("all", "any"):
        each, over = [_possible(p) for p in condition[1:]], all if condition[0] == "all" else any
        return lambda has: over(f(has) for f in each)
    clauses = _clauses(condition)
    return lambda has: all(any(map(has, clause)) for clause in clauses)


def _least_clause(condition) -> set | None:
    """The clause of a condition that the fewest texts should meet: with the fewest plain words, and of long strings."""
    cost = lambda clause: (sum(isinstance(x, str) and x.isalpha() for x in clause), -min(len(x) if isinstance(x, str) else 9 for x in clause))
    if not isinstance(condition, str) and condition[0] in ("all", "any"):
        each = [_least_clause(p) for p in condition[1:]]
        if condition[0] == "any":
            return set().union(*each) if all(each) else None
    else:
        each = list(map(set, _clauses(condition)))
    return min(filter(None, each), key=cost, default=None)


def gate(conditions) -> str | None:
    """A pattern, whatever the case, for Arrow that matches every text which may meet one of the conditions as it stands or as
    the shell reads it: a string of each, with what the shell leaves out, or what stands for others. None: any text may."""
    each = [_least_clause(c) for c in conditions]
    if not all(each):
        return None

    def spelled(x):
        if x is _NETCAT:
            return f"(?:^|[^a-z0-9_])n{_LEFT_OUT}c(?:{_LEFT_OUT}a{_LEFT_OUT}t)?(?:[^a-z0-9_]|$)"
        return _LEFT_OUT.join(re.escape(c) for c in max(x.split(), key=len) if c not in "'\"`\\")

    return "|".join([r"\$\{", r"\$IFS", *sorted(map(spelled, set().union(*each)))])


def windows_in_task(groups: dict[str, list], id_col: str, hint: str | None, read=None):
    """A step over Arrow batches of (id, text): rows (id, _w, _ws, _r, _rs) of the windows that may have a capability as they
    stand, with the strings that signals need which they hold, or as the shell reads them (null if that is the same).

    hint: windows that do not match it are left out. read: what is made of texts beyond ASCII first."""
    conditions = [c for own in groups.values() for *_, c in own]
    every = needed_by(_needed(groups))
    strings = [*every, *sorted({"|", *(x for own in _BESIDES.values() for clause in own for x in clause if isinstance(x, str))} - set(every))]
    first, each = gate(conditions), list(map(_possible, conditions))

    def judged(texts):
        """Of each text the strings that it holds for patterns, and whether it may have a capability."""
        import pyarrow as pa

        low, out = [x.lower() for x in texts], []
        for text, found in zip(low, find(*flat_texts(pa.array(low, pa.large_string())))):
            own = {strings[i] for i in found}
            has = lambda x: x in own if isinstance(x, str) else x.search(text) is not None
            may = any(f(has) for f in each)
            out.append(([*own, *([_NETCAT.pattern] if may and has(_NETCAT) else [])], may))
        return out

    find = Finder(strings)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def passing(column):
            return pc.indices_nonzero(pc.match_substring_regex(column, first, ignore_case=True)) if first else pa.array(range(len(column)), pa.uint64())

        kinds = (pa.string(), pa.list_(pa.string())) * 2
        for batch in batches:
            for a, b in chunks(flat_texts(batch.column(1))[1]):
                ids, texts = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
                if read:
                    texts = pa.array([t if t.isascii() else read(t) for t in texts.to_pylist()], pa.string())
                cut = [(i, w) for i in passing(texts).to_pylist() for w in windows_of(texts[i].as_py())]
                column = pa.array([w for _, w in cut], pa.string())
                some = passing(column)
                if hint:
                    some = some.filter(pc.match_substring_regex(column.take(some), hint))
                cut = [cut[j] for j in some.to_pylist()]
                plain, shell = [w for _, w in cut], [resolved_lines(w) for _, w in cut]
                other = [k for k, (w, r) in enumerate(zip(plain, shell)) if w != r]
                again = dict(zip(other, judged([shell[k] for k in other])))
                rows, at = [], []
                for k, (held_w, may) in enumerate(judged(plain)):
                    held_r, may_r = again.get(k, (None, False))
                    if may or may_r:
                        rows.append((plain[k], held_w, shell[k] if k in again else None, held_r))
                        at.append(cut[k][0])
                if rows:
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *columns], names=[id_col, "_w", "_ws", "_r", "_rs"])

    return in_task(run)


def content_capabilities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hint: str | None = None, read=None) -> DataFrame:
    """(id, ord, capability, decision), each once, that a window of a text has, as it stands or as the shell reads it.

    Patterns are tried on the windows that hold the strings which some capability needs. With hint, only windows that match it
    count; read is a function of a text beyond ASCII that gives the text to look at. Null texts have none; rows that share an id count as one text."""
    groups = _used("content")
    kinds = StructType([docs.schema[id_col], *[StructField(c, StringType() if c in ("_w", "_r") else ArrayType(StringType())) for c in ("_w", "_ws", "_r", "_rs")]])
    windows = docs.select(id_col, text_or_empty(text_col).alias("_t")).mapInArrow(windows_in_task(groups, id_col, hint, read), kinds)
    forms = [F.struct(F.col("_w").alias("text"), F.col("_ws").alias("strings")), F.when(F.col("_r").isNotNull(), F.struct(F.col("_r").alias("text"), F.col("_rs").alias("strings")))]
    # outer, as else a filter of windows without capabilities would try the patterns a second time
    found = windows.select(id_col, F.explode_outer(_found_in(forms, groups, True)).alias("f")).where("f is not null")
    return found.select(id_col, "f.ord", F.col("f.id").alias("capability"), "f.decision").distinct()


def decide(commands: DataFrame, found: DataFrame, id_col: str = "event_id") -> DataFrame:
    """(id, decision, capability) of every distinct id: deny before ask before allow, with the capability that decides."""
    worst = found.groupBy(F.col(id_col).alias("_f")).agg(F.min(F.struct(F.when(F.col("decision") == "deny", 0).otherwise(1).alias("r"), "ord", "capability")).alias("w"))
    out = commands.select(id_col).distinct().join(worst, F.col(id_col).eqNullSafe(F.col("_f")), "left")
    decision = F.when(F.col("w.r") == 0, "deny").when(F.col("w.r") == 1, "ask").otherwise("allow")
    return out.select(id_col, decision.alias("decision"), F.col("w.capability").alias("capability"))
