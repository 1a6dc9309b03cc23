"""Injected instructions: pattern rules, intent, arguments, standing directives, verdicts and what follows from them."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions import injection_rules as ir
from tamis.functions.batches import Finder, chunks, flat_texts, lower_texts
from tamis.functions.literals import Needs, held_in_task, may_match
from tamis.functions.normalize import normalized_texts
from tamis.functions.text import ascii_bounds, once, text_or_empty
from tamis.operators.secrets import HINT, redact

#: Characters of evidence that a finding carries.
EVIDENCE = 120
#: Long texts are judged in windows of so many characters, each beginning so many after the one before.
WINDOW, STEP = 8000, 7488
HITS = "array<struct<ord:int,rule:string,severity:string,evidence:string>>"
VERDICTS = ["allow", "warn", "block"]


def rank_of(severity: Column) -> Column:
    """0 for low to 3 for critical."""
    return (F.array_position(F.array(*map(F.lit, ir.SEVERITIES)), severity) - 1).cast("int")


def first_matches(t: Column, may: Column, rules) -> Column:
    """Array of (ord, rule, severity, evidence) of the rules that match, each with its first match. may: the numbers of the
    rules that the text may match, others are not tried."""
    def hit(i, rule):
        name, severity, pattern = rule[0], rule[1], ascii_bounds(rule[2])
        found = F.regexp_extract(t, pattern, 0)
        short = F.when(F.length(found) > EVIDENCE, F.concat(F.substring(found, 1, EVIDENCE), F.lit("..."))).otherwise(found)
        return F.when(F.array_contains(may, i), F.when(t.rlike(pattern), F.struct(F.lit(i).alias("ord"), F.lit(name).alias("rule"), F.lit(severity).alias("severity"), short.alias("evidence"))))

    return F.array_compact(F.array(*[hit(i, r) for i, r in enumerate(rules)])).cast(HITS)


def _read(docs: DataFrame, columns: list[str], text_col: str, rules) -> DataFrame:
    """The columns with _t, the text, _n, the text after every step of normalisation, and _tm and _nm, the numbers of the rules
    that they may match (_tm only where they differ)."""
    patterns = [r[2] for r in rules]

    @F.arrow_udf("n string, nm array<int>, tm array<int>")
    def run(texts):
        import pyarrow as pa
        import pyarrow.compute as pc

        may, gates = Needs(patterns), [(i, ir.GATES[p]) for i, p in enumerate(patterns) if p in ir.GATES]

        def possible(column):
            own = may(*lower_texts(column))
            for i, g in gates:
                for row in pc.indices_nonzero(pc.invert(pc.match_substring_regex(column, g, ignore_case=True))).to_pylist():
                    own[row] = [k for k in own[row] if k != i]
            return own

        out = []
        for a, b in chunks(flat_texts(texts)[1]):
            part = texts.slice(a, b - a)
            after = normalized_texts(part)
            changed = pc.is_valid(after)
            before: list = [[] for _ in range(b - a)]
            for i, own in zip(pc.indices_nonzero(changed).to_pylist(), possible(part.filter(changed))):
                before[i] = own
            out.append((after, possible(pc.coalesce(after, part)), before))
        kind = pa.list_(pa.int32())
        columns = [pa.concat_arrays([x for x, _, _ in out] or [pa.array([], pa.string())]), *(pa.array([own for x in out for own in x[k]], kind) for k in (1, 2))]
        return pa.StructArray.from_arrays(columns, ["n", "nm", "tm"])

    # else the optimiser repeats the function wherever its result is used
    rows = docs.select(*columns, text_or_empty(text_col).alias("_t")).withColumn("_r", run.asNondeterministic()("_t"))
    return rows.select(*columns, "_t", F.coalesce("_r.n", "_t").alias("_n"), F.col("_r.tm").alias("_tm"), F.col("_r.nm").alias("_nm"))


def _forms() -> Column:
    """Of a row of _read, the normalised text and, where that is another, the text as it stands."""
    form = lambda t, may: F.struct(F.col(t).alias("text"), F.col(may).alias("may"))
    return F.array_compact(F.array(form("_n", "_nm"), F.when(F.col("_n") != F.col("_t"), form("_t", "_tm"))))


def scan_rules(docs: DataFrame, rules=ir.RULES, least: str = "low", disabled: tuple[str, ...] = (), custom=(), most: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ord, rule, severity, evidence, original): every rule's first match in the normalised text, or, where that has
    none, in the text as it stands (original). least, disabled and custom choose the rules before anything is scanned; most
    keeps so many findings of a text, in the order of the rules. Null texts are empty; rows with null or repeated ids are
    scanned one by one."""
    floor = ir.SEVERITIES.index(least)
    used = [r for r in [*rules, *custom] if r[0] not in disabled and ir.SEVERITIES.index(r[1]) >= floor]
    plain = _read(docs, [id_col], text_col, used)
    # a function over an array, so that the rules stand in the plan once and are not compiled
    hits = F.transform(_forms(), lambda x: first_matches(x["text"], x["may"], used))
    both = plain.select(id_col, hits.alias("h")).select(id_col, F.get("h", F.lit(0)).alias("a"), F.coalesce(F.get("h", F.lit(1)), F.array().cast(HITS)).alias("b"))
    known = F.transform("a", lambda x: x["ord"])
    extra = F.filter("b", lambda x: ~F.array_contains(known, x["ord"]))
    tagged = F.concat(F.transform("a", lambda x: F.struct(x.alias("f"), F.lit(False).alias("original"))), F.transform(extra, lambda x: F.struct(x.alias("f"), F.lit(True).alias("original"))))
    if most is not None:
        tagged = F.slice(tagged, 1, most)
    return both.select(id_col, F.explode(tagged).alias("h")).select(id_col, "h.f.ord", "h.f.rule", "h.f.severity", "h.f.evidence", "h.original")


def injected(docs: DataFrame, rules=ir.RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with injected: whether any rule matches the text, normalised or not."""
    plain = _read(docs, docs.columns, text_col, rules)
    hit = lambda x: F.coalesce(*[F.when(F.array_contains(x["may"], i) & x["text"].rlike(ascii_bounds(p)), F.lit(True)) for i, (_, _, p) in enumerate(rules)], F.lit(False))
    found = F.exists(_forms(), hit)
    return plain.withColumn("injected", found).drop("_t", "_n", "_tm", "_nm")


#: Of a byte: 0 for a blank, 1 for a-z and digits, 2 for all else.
_KINDS = np.full(256, 2, np.uint8)
_KINDS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = 1
_KINDS[np.frombuffer(b" \t\n\r\f", np.uint8)] = 0


def _lower(column) -> tuple[np.ndarray, np.ndarray]:
    """lower_texts(), with the last sigma of a word as lower() has it."""
    import pyarrow as pa

    if b"\xce\xa3" in flat_texts(column)[0].tobytes():
        return flat_texts(pa.array([x.lower() for x in column.to_pylist()], pa.large_string()))
    return lower_texts(column)


def _runs(kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a byte is of another kind than the one before it in its text."""
    new = np.ones(len(kinds), bool)
    new[1:] = kinds[1:] != kinds[:-1]
    new[offsets[:-1][offsets[:-1] < len(kinds)]] = True
    return new


def _blanks_joined(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with one blank for every run of white space."""
    kinds = _KINDS[data]
    keep = (kinds > 0) | _runs(kinds, offsets)
    return np.where(kinds == 0, np.uint8(32), data)[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def _tokens_of(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """How many runs of letters or of other signs each text has."""
    kinds = _KINDS[data]
    return np.diff(np.concatenate([[0], np.cumsum(_runs(kinds, offsets) & (kinds > 0))])[offsets]).tolist()


def intents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, category, score, confidence, n_matched): the kind of attack whose phrases weigh most, clean below 0.45.

    A category's score is 0.7 of the share of its weights that the text holds and 0.6 of the share of tokens that are
    phrases (0.5 at most; 0.3 of it for one light phrase), 1 at most. White space between words counts as one blank. Empty
    texts are clean with confidence 1."""
    every = sorted({p for phrases in ir.INTENTS.values() for p in phrases})

    @F.arrow_udf("tokens int, said array<string>, row binary")
    def read(texts):
        import pyarrow as pa

        find, rows = Finder(every), []
        for a, b in chunks(flat_texts(texts)[1]):
            data, offsets = _blanks_joined(*_lower(texts.slice(a, b - a)))
            said = [[every[i] for i in f] for f in find(data, offsets)]
            digests = [hashlib.sha256(data[x:y]).digest() for x, y in zip(offsets[:-1], offsets[1:])]
            rows.append((_tokens_of(data, offsets), said, digests))
        tokens, said, digests = ([x for part in rows for x in part[k]] for k in range(3))
        return pa.StructArray.from_arrays([pa.array(tokens, pa.int32()), pa.array(said, pa.list_(pa.string())), pa.array(digests, pa.binary())], ["tokens", "said", "row"])

    # else the optimiser repeats the function wherever its result is used
    base = docs.select(id_col, read.asNondeterministic()(text_or_empty(text_col)).alias("_r")).select(id_col, "_r.tokens", "_r.said", F.col("_r.row").alias("_row"))
    scored = []
    for i, (name, phrases) in enumerate(ir.INTENTS.items()):
        hit = [F.array_contains("said", p) for p in phrases]
        weight = sum((h.cast("int") * w for h, w in zip(hit, phrases.values())), F.lit(0.0))
        n = sum((h.cast("int") for h in hit), F.lit(0))
        scored.append(F.struct(weight.alias("w"), n.alias("n"), F.lit(-i).alias("ord"), F.lit(name).alias("name"), F.lit(sum(phrases.values())).alias("all")))

    def rated(c):
        density = c["n"] / F.greatest(F.col("tokens"), F.lit(1))
        damped = F.when((c["n"] <= 1) & (c["w"] < 0.6), density * 0.3).otherwise(F.least(density, F.lit(0.5)))
        score = F.round(F.least(F.lit(1.0), c["w"] / c["all"] * 0.7 + damped * 0.6), 6)
        return F.struct(score.alias("score"), c["ord"].alias("ord"), c["name"].alias("name"), c["n"].alias("n"))

    rows = base.select(id_col, "_row", F.array_max(F.transform(F.array(*scored), rated)).alias("b"), (F.col("tokens") == 0).alias("empty"))
    top = rows.groupBy(id_col, "_row").agg(F.max("b").alias("b"), F.max("empty").alias("empty")).select(id_col, "b.*", "empty")
    s = F.col("score")
    sure = F.when(F.col("empty"), 1.0).when(s < 0.1, 0.95).when(s < 0.2, 0.7).when(s < 0.4, s + 0.5).when(s < 0.6, s * 0.3 + 0.6).otherwise(s * 0.25 + 0.75)
    return top.select(id_col, F.when(s < 0.45, "clean").otherwise(F.col("name")).alias("category"), "score", F.round(F.least(F.lit(1.0), sure), 6).alias("confidence"), F.col("n").cast("long").alias("n_matched"))


def sensitive(t: Column) -> Column:
    """Whether a text names a sensitive topic."""
    out = F.lit(False)
    for p in ir.SENSITIVE:
        out = out | t.rlike(ascii_bounds(p))
    return out


#: Verbs that make a claim of authority surer.
COMMANDING = r"(?i)\b(?:override|disable|bypass|lift|remove|ignore|forget)\b"


def arguments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule, severity, evidence, confidence): roles, authority, framings, examples, rewritten rules, goals, premises.

    Texts of fewer than 15 characters have none. Framings, examples and premises count only beside a sensitive topic; claims
    of authority and examples are surer with a commanding verb, or with a second example. A pattern is tried once, and only
    on texts that hold a string that it needs; topics only where a rule asks for one."""
    every = [p for _, _, patterns, _ in ir.ARGUMENTS for p in patterns]
    strings = held_in_task(F.lower("t"), [*every, *ir.SENSITIVE])
    base = docs.select(id_col, text_or_empty(text_col).alias("t")).where(F.length("t") >= 15).select(id_col, "t", strings.alias("strings"))
    met = lambda x, p: F.when(may_match(x["strings"], p), x["t"].rlike(ascii_bounds(p)))
    first = lambda x, p: F.when(met(x, p), F.regexp_extract(x["t"], ascii_bounds(p), 0))
    own, at = {}, 0
    for name, _, patterns, _ in ir.ARGUMENTS:
        own[name], at = range(at, at + len(patterns)), at + len(patterns)
    ask = [i for name, _, _, needs_topic in ir.ARGUMENTS if needs_topic for i in own[name]]

    def rules(x, found, topic):
        out = []
        for name, severity, _, needs_topic in ir.ARGUMENTS:
            each = [F.get(found, F.lit(i)) for i in own[name]]
            last = name in ("logic-authority-impersonation", "logic-example-injection")
            evidence = F.coalesce(*(reversed(each) if last else each))
            sure, level = F.lit(1.0), F.lit(severity)
            if name == "logic-authority-impersonation":
                sure = F.when(x["t"].rlike(COMMANDING), 1.0).otherwise(0.6)
            if name == "logic-example-injection":
                sure = F.when(sum((e.isNotNull().cast("int") for e in each), F.lit(0)) >= 2, 1.0).otherwise(0.7)
            if last:
                level = F.when(sure >= 0.9, "critical").otherwise("high")
            on = evidence.isNotNull() & topic if needs_topic else evidence.isNotNull()
            out.append(F.when(on, F.struct(F.lit(name).alias("rule"), level.alias("severity"), F.substring(evidence, 1, 200).alias("evidence"), sure.alias("confidence"))))
        return F.array_compact(F.array(*out))

    def of(x):
        topic = F.coalesce(*[F.when(met(x, p), F.lit(True)) for p in ir.SENSITIVE], F.lit(False))
        asks = lambda found: F.when(F.coalesce(*[F.get(found, F.lit(i)) for i in ask]).isNotNull(), topic).otherwise(False)
        return once(F.array(*[first(x, p) for p in every]), lambda found: once(asks(found), lambda topic: rules(x, found, topic)))

    # outer, as else a filter of texts without findings would try the patterns a second time
    return base.select(id_col, F.explode_outer(once(F.struct("t", "strings"), of)).alias("f")).where("f is not null").select(id_col, "f.*")


def standing_directive(t: Column) -> Column:
    """Why a text must not be stored, null if it may: it sends a key file away, or fetches a script and runs it."""
    runs = t.rlike(ascii_bounds(ir.RUN)) & t.rlike(ascii_bounds(ir.SCRIPT_URL)) & (t.rlike("(?i)http://") | t.rlike(ascii_bounds(ir.STANDING)))
    fetches = t.rlike(ascii_bounds(ir.STANDING)) & t.rlike("(?i)https?://") & t.rlike(ascii_bounds(ir.FETCH)) & t.rlike(ascii_bounds(ir.TO_SHELL))
    return F.when(t.rlike(ascii_bounds(ir.EXPOSE)) & t.rlike(ascii_bounds(ir.SECRET_FILE)), "sends a key file").when(runs | fetches, "fetches and runs a script")


def persistent_directives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, reason) of the texts that carry a standing directive."""
    return docs.select(id_col, standing_directive(text_or_empty(text_col)).alias("reason")).where("reason is not null")


def content_findings(docs: DataFrame, rules=ir.RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ord, rule, severity) of pattern rules and of intent, whose severity goes by its score."""
    by_rule = scan_rules(docs, rules, id_col=id_col, text_col=text_col).select(id_col, "ord", "rule", "severity")
    s = F.col("score")
    level = F.when(s > 0.7, "critical").when(s > 0.5, "high").otherwise("medium")
    by_intent = intents(docs, id_col, text_col).where((s > 0.45) & (F.col("category") != "clean")).select(id_col, F.lit(len(rules)).alias("ord"), F.concat(F.lit("semantic-"), F.col("category")).alias("rule"), level.alias("severity"))
    return by_rule.unionByName(by_intent)


def verdicts(docs: DataFrame, findings: DataFrame, block_at: str = "critical", warn_at: str = "high", id_col: str = "doc_id") -> DataFrame:
    """(id, verdict, severity, labels) per distinct id of docs: block, warn or allow by the worst finding; the finding that
    decides leads the labels, five at most. Ids without findings are allowed with a null severity."""
    worst = findings.groupBy(F.col(id_col).alias("_f")).agg(F.max(rank_of(F.col("severity"))).alias("worst"), F.sort_array(F.collect_list(F.struct((-rank_of(F.col("severity"))).alias("r"), "ord", "rule"))).alias("all"))
    in_order = F.array_sort("all", lambda x, y: x["ord"] - y["ord"])
    labels = F.slice(F.array_distinct(F.concat(F.array(F.col("all")[0]["rule"]), F.transform(in_order, lambda x: x["rule"]))), 1, 5)
    out = docs.select(id_col).distinct().join(worst, F.col(id_col).eqNullSafe(F.col("_f")), "left")
    level = F.coalesce("worst", F.lit(-1))
    verdict = F.when(level >= ir.SEVERITIES.index(block_at), "block").when(level >= ir.SEVERITIES.index(warn_at), "warn").otherwise("allow")
    return out.select(id_col, verdict.alias("verdict"), F.get(F.array(*map(F.lit, ir.SEVERITIES)), F.when(level >= 0, level)).alias("severity"), F.coalesce(labels, F.array().cast("array<string>")).alias("labels"))


def text_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, step: int = STEP) -> DataFrame:
    """(id, start, text) of overlapping windows; texts of at most `size` characters are one window."""
    n = F.length(text_or_empty(text_col))
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(step)))
    return docs.select(id_col, text_or_empty(text_col).alias("_t"), F.explode(starts).alias("start")).select(id_col, "start", F.substring(F.col("_t"), F.col("start") + 1, F.lit(size)).alias("text"))


def window_verdicts(docs: DataFrame, rules=ir.RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, verdict, windows): the strictest verdict of a text's windows. Splits long texts, which would make long tasks."""
    w = text_windows(docs, id_col, text_col).withColumn("_w", F.struct(id_col, "start"))
    each = verdicts(w, content_findings(w, rules, "_w", "text"), id_col="_w")
    level = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))
    return each.groupBy(F.col(f"_w.{id_col}").alias(id_col)).agg(F.get(F.array(*map(F.lit, VERDICTS)), (F.max(level) - 1).cast("int")).alias("verdict"), F.count("*").alias("windows"))


def gate(findings: DataFrame, least: str = "high", id_col: str = "doc_id") -> DataFrame:
    """(id, violations, worst) of the ids with findings of at least that severity: the rows that a data check rejects."""
    over = findings.where(rank_of(F.col("severity")) >= ir.SEVERITIES.index(least))
    return over.groupBy(id_col).agg(F.count("*").alias("violations"), F.get(F.array(*map(F.lit, ir.SEVERITIES)), F.max(rank_of(F.col("severity")))).alias("worst"))


def nonce_of(secret: str, key: Column) -> Column:
    """Sixteen hexadecimal digits that only the holder of the secret can foresee."""
    return F.substring(F.sha2(F.concat(F.lit(secret), key.cast("string")), 256), 1, 16)


MARK_OPEN, MARK_CLOSE = "⟦UNTRUSTED-DATA ", "⟧"


def neutralized(t: Column) -> Column:
    """A text whose frame marks, in any case and with invisible characters or blanks put in, no longer read as marks."""
    return F.regexp_replace(t, "(?i)[⟦\\[]+[\\s\\x{200B}-\\x{200F}\\x{2060}]*(UNTRUSTED-DATA)", "($1")


def forged_mark(t: Column) -> Column:
    """Whether a text holds something that reads as a frame mark."""
    return neutralized(t) != t


def spotlight(docs: DataFrame, secret: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text between frame lines keyed by a nonce; a text that is such a frame already stays as it is."""
    mark = F.concat(F.lit(MARK_OPEN), nonce_of(secret, F.col(id_col)), F.lit(MARK_CLOSE))
    head, tail = F.concat(mark, F.lit(" BEGIN\n")), F.concat(F.lit("\n"), mark, F.lit(" END"))
    t = text_or_empty(text_col)
    framed = t.startswith(head) & t.endswith(tail)
    return docs.withColumn(text_col, F.when(framed, t).otherwise(F.concat(head, neutralized(t), tail)))


def sanitize(docs: DataFrame, verdict: DataFrame, secret: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, verdict, shown, stored, secrets_redacted): what may be shown and stored of external texts.

    Blocked texts show a notice, warned ones their frame; neither is stored. Allowed ones are shown and stored with secrets
    masked and frame marks undone."""
    clean = redact(docs, id_col, text_col)
    framed = spotlight(clean, secret, id_col, "text").select(F.col(id_col).alias("_i"), F.col("text").alias("_framed"))
    v = verdict.select(F.col(id_col).alias("_v"), "verdict", "labels")
    rows = clean.join(v, F.col(id_col) == F.col("_v")).join(framed, F.col(id_col) == F.col("_i"))
    notice = F.concat(F.lit("[blocked: "), F.array_join("labels", "; "), F.lit("]"))
    plain = neutralized(F.col("text"))
    shown = F.when(F.col("verdict") == "block", notice).when(F.col("verdict") == "warn", F.col("_framed")).otherwise(plain)
    return rows.select(id_col, "verdict", shown.alias("shown"), F.when(F.col("verdict") == "allow", plain).alias("stored"), "secrets_redacted")


def seams(records: DataFrame, first: str, second: str, reach: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """(id, text): the end of one field joined to the beginning of the next, where an instruction may be split in two."""
    a, b = text_or_empty(first), text_or_empty(second)
    return records.select(id_col, F.concat(F.right(a, F.lit(reach)), F.lit("\n"), F.left(b, F.lit(reach))).alias("text"))


def judge_commands(commands: DataFrame, rules=ir.COMMANDS, command_col: str = "command") -> DataFrame:
    """commands with decision and rule: the first deny rule, else the first ask rule, else allow. Commands are read with
    blanks collapsed and without the quotes, escapes and $IFS that split words; empty ones are allowed."""
    c = F.regexp_replace(F.trim(text_or_empty(command_col)), r"\\([A-Za-z0-9/.:_-])", "$1")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "['\"`]", ""), r"\$\{IFS\}|\$IFS", " "), "[ \\t\\n\\r\\f]+", " ")
    rows = commands.withColumn("_c", c).withColumn("_raw", F.trim(text_or_empty(command_col)))
    hit = lambda kind: F.coalesce(*[F.when(F.col("_c").rlike(ascii_bounds(p)) | F.col("_raw").rlike(ascii_bounds(p)), F.lit(r)) for r, d, p in rules if d == kind])
    deny, ask = hit("deny"), hit("ask")
    decision = F.when(deny.isNotNull(), "deny").when(ask.isNotNull(), "ask").otherwise("allow")
    return rows.withColumn("decision", decision).withColumn("rule", F.coalesce(deny, ask)).drop("_c", "_raw")


def judge_writes(writes: DataFrame, path_col: str = "path") -> DataFrame:
    """writes with decision and rule by the path that is written."""
    p = text_or_empty(path_col)
    hit = lambda kind: F.coalesce(*[F.when(p.rlike(ascii_bounds(x)), F.lit(r)) for r, d, x in ir.PATHS if d == kind])
    deny, ask = hit("deny"), hit("ask")
    return writes.withColumn("decision", F.when(deny.isNotNull(), "deny").when(ask.isNotNull(), "ask").otherwise("allow")).withColumn("rule", F.coalesce(deny, ask))


def fetches_web(command: Column) -> Column:
    """Whether a command reads a web address (git fetch does not)."""
    return command.rlike(r"(?i)\b(?:curl|wget|Invoke-WebRequest|iwr|Invoke-RestMethod|irm)\b") & command.rlike(r"(?i)\bhttps?://")


#: Address blocks that are not public: first and last address. Fixed values.
RESERVED = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]


def reserved_ranges() -> list[tuple[int, int]]:
    out = []
    for block in RESERVED:
        address, bits = block.split("/")
        first = sum(int(x) << (24 - 8 * i) for i, x in enumerate(address.split(".")))
        out.append((first, first + (1 << (32 - int(bits))) - 1))
    return out


def is_public(url: Column) -> Column:
    """Whether an address may be fetched: http or https, and its host neither local by name nor in a reserved block."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    parts = F.split(host, "\\.")
    number = sum((F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0).cast("bigint"))
    inside = F.lit(False)
    for first, last in reserved_ranges():
        inside = inside | number.between(first, last)
    v4 = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    v6 = host.startswith("[")
    local6 = host.rlike(r"^\[(::1|::|fe[89ab].*|f[cd].*|::ffff:.*)\]$")
    local = host.rlike(r"^(localhost|.*\.localhost|.*\.local|.*\.internal)$")
    return F.when(host == "", False).when(v4, ~inside).when(v6, ~local6).otherwise(~local)
