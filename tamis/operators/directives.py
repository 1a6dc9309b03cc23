"""Instructions that a text gives to the agent that reads it, told by signals that stand near each other.

Where two signals must be close, their matches become rows with places in the text, and one ordered pass over them finds for
each the nearest of the other kind; nothing is joined match by match, however often a text repeats itself.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions import directive_rules as dr
from tamis.functions.capability_rules import SIGNALS
from tamis.functions.batches import chunks, flat_texts, lower_texts
from tamis.functions.literals import Needs
from tamis.functions.text import ascii_bounds, once, text_or_empty
from tamis.operators.capabilities import HINT, content_capabilities

SEVERITY = "high"


_INVISIBLE = re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), dr.INVISIBLE)
_UNSEEN, _TO_LATIN = re.compile(_INVISIBLE), str.maketrans(dr.CONFUSABLES)
_FOLDABLE = re.compile(f"{_INVISIBLE}|[{''.join(dr.CONFUSABLES)}]")


def _folded(text: str) -> str:
    text = unicodedata.normalize("NFKC", text)
    return _UNSEEN.sub("", text).translate(_TO_LATIN) if _FOLDABLE.search(text) else text


def folded_in_task(patterns=()):
    """A function of a text column without nulls: (text, may), the text in compatibility form, without invisible characters and
    with look-alike letters as Latin ones, null where that is the text, and the numbers of the patterns that it may match."""

    @F.arrow_udf("text string, may array<int>")
    def run(texts):
        import pyarrow as pa
        import pyarrow.compute as pc

        found: list[str | None] = [None] * len(texts)
        for i in pc.indices_nonzero(pc.match_substring_regex(texts, "[^\\x00-\\x7F]")).to_pylist():
            text = texts[i].as_py()
            after = _folded(text)
            if after != text:
                found[i] = after
        after, needs, may = pa.array(found, pa.string()), Needs(patterns), []
        for a, b in chunks(flat_texts(texts)[1]) if patterns else []:
            may += needs(*lower_texts(pc.coalesce(after.slice(a, b - a), texts.slice(a, b - a))))
        return pa.StructArray.from_arrays([after, pa.array(may if patterns else [[]] * len(texts), pa.list_(pa.int32()))], ["text", "may"])

    # else the optimiser repeats the function wherever its result is used
    return run.asNondeterministic()


def fold_confusables(docs: DataFrame, text_col: str = "text", out: str = "folded") -> DataFrame:
    """docs with the text in compatibility form, without invisible characters and with look-alike letters as Latin ones.

    Texts of ASCII alone stay as they are. Null texts are empty."""
    rows = docs.withColumn(out, text_or_empty(text_col))
    return rows.withColumn(out, F.coalesce(folded_in_task()(F.col(out))["text"], F.col(out)))


def spans(rows: DataFrame, key: list[str], text_col: str, patterns: dict[str, str]) -> DataFrame:
    """(key, kind, begin, end) of every match of each pattern: begin counts from 0, end is behind the match.

    key must tell rows apart."""
    t, each = F.col(text_col), []
    for kind, pattern in patterns.items():
        p = ascii_bounds(pattern)
        each.append(F.struct(F.lit(kind).alias("kind"), F.arrays_zip(F.transform(F.split(t, p, -1), lambda x: F.length(x)).alias("gap"), F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(0)), lambda x: F.length(x)).alias("hit")).alias("parts")))
    cut = rows.select(*key, F.explode(F.array(*each)).alias("e")).select(*key, "e.kind", F.posexplode("e.parts").alias("i", "p"))
    before = Window.partitionBy(*key, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("p.gap") + F.coalesce("p.hit", F.lit(0))).over(before)
    return cut.withColumn("end", end).where(F.col("p.hit").isNotNull()).select(*key, "kind", (F.col("end") - F.col("p.hit")).alias("begin"), "end")


def beside(found: DataFrame, key: list[str], a: str, b: str, reach: int, whole: bool = True, unless: str | None = None, unless_reach: int = 0) -> DataFrame:
    """The keys for which some match of kind a has one of kind b near it: from `reach` characters before a begins to `reach`
    behind its end. whole: b ends there too, else it only begins there. Matches of a that one of kind `unless` comes before,
    whole and within unless_reach characters, do not count. Matches of one kind do not overlap."""
    order = Window.partitionBy(*key).orderBy("begin", "end")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    rows = found.where(F.col("kind").isin(a, b, *([unless] if unless else [])))
    place = F.struct("begin", "end")
    rows = rows.withColumn("_last", F.last(of(b, place), ignorenulls=True).over(back)).withColumn("_next", F.first(of(b, place), ignorenulls=True).over(ahead))
    edge = F.col("end") + reach
    near = lambda c: F.coalesce((F.col(f"{c}.begin") >= F.col("begin") - reach) & ((F.col(f"{c}.end") <= edge) if whole else (F.col(f"{c}.begin") < edge)), F.lit(False))
    rows = rows.withColumn("_near", near("_last") | near("_next"))
    if unless:
        held = F.max(of(unless, F.struct("end", "begin"))).over(back)
        rows = rows.withColumn("_held", held).withColumn("_near", F.col("_near") & ~F.coalesce((F.col("_held.end") <= F.col("begin")) & (F.col("_held.begin") >= F.col("begin") - unless_reach), F.lit(False)))
    return rows.where((F.col("kind") == a) & F.col("_near")).select(*key).distinct()


def fetches_remote(t: Column) -> Column:
    """Whether some curl or wget reads from another machine: the first address on its line is not a loopback one, or there
    is neither an address nor the name of this machine."""
    ahead = F.regexp_extract_all(t, F.lit(ascii_bounds(dr.FETCH_TOOL) + f"(?=([^\\n]{{0,{dr.FETCH_REACH}}}))"), F.lit(1))
    host = lambda x: F.regexp_extract(x, ascii_bounds(dr.HOST), 1)
    return F.exists(ahead, lambda x: F.when(host(x) != "", ~host(x).rlike(dr.LOOPBACK)).otherwise(~x.rlike(dr.LOOPBACK_NAMED)))


def _has(t: Column, pattern: str) -> Column:
    return t.rlike(ascii_bounds(pattern))


def sentences(rows: DataFrame, key: list[str], text_col: str) -> DataFrame:
    """(key, s, sentence): texts cut at line ends and at . ! ? before white space."""
    return rows.select(*key, F.posexplode(F.split(F.col(text_col), dr.SENTENCE_END)).alias("s", "sentence"))


def overrides(rows: DataFrame, key: list[str], text_col: str) -> DataFrame:
    """The keys of texts with a verb that puts rules aside near its object, in one sentence, and not negated."""
    t = F.col(text_col)
    some = sentences(rows.where(_has(t, dr.OVERRIDE) & _has(t, dr.RULES_NOUN)), key, text_col)
    some = some.where(_has(F.col("sentence"), dr.OVERRIDE) & _has(F.col("sentence"), dr.RULES_NOUN))
    found = spans(some, [*key, "s"], "sentence", {"verb": dr.OVERRIDE, "object": dr.RULES_NOUN, "negation": dr.NEGATION})
    return beside(found, [*key, "s"], "verb", "object", dr.REACH, whole=False, unless="negation", unless_reach=dr.NEGATED).select(*key).distinct()


#: Pairs of signals that make a directive where they stand near each other.
NEAR_PAIRS = [("directive-decode-run", dr.ENCODED, dr.RUNS), ("directive-secret-exfil", dr.STRONG_SECRET, dr.EXPOSE), ("directive-secret-exfil", dr.WEAK_SECRET, dr.SEND), ("directive-tls-downgrade", dr.TLS_OFF, dr.AGENT_FRAMING)]
#: Marks of a text, which are no directives: plain HTTP that is fetched, and what is fetched piped into a program.
PLAIN_HTTP, PIPED = "plain-http", "piped"
#: Patterns that are tried only on texts that hold the strings they need.
_READ = [dr.COMMAND_RUN, dr.FETCH_TOOL, dr.URL, dr.TOKEN_MARKER, dr.ROLE, dr.REGISTRY, dr.APPROVES, dr.WAIVES, dr.REVIEWER, dr.EXCUSES, dr.OUTPUT_AWAY, dr.PRIVATE_OUT, dr.ADDRESSED, dr.ACTION, dr.STRONG_SECRET, dr.WEAK_SECRET, dr.SENDS_TO_URL, dr.OVERRIDE, dr.RULES_NOUN, SIGNALS["fetches_plain_http"], *(p for _, *pair in NEAR_PAIRS for p in pair)]


def _signs(x: Column) -> Column:
    """Of a text and the numbers of the patterns of _READ that it may match: found, the directives and marks that it has by itself; near, which of
    NEAR_PAIRS it holds both signals of; over, whether it holds an override's verb and object; and the text, if either."""
    t, may = x["text"], lambda p: F.array_contains(x["may"], _READ.index(p))
    has = lambda p: may(p) & _has(t, p)
    both = lambda a, b: may(a) & may(b) & _has(t, a) & _has(t, b)
    agent = lambda y: may(dr.ADDRESSED) & may(dr.ACTION) & _has(y, dr.ADDRESSED) & _has(y, dr.ACTION) & (may(dr.STRONG_SECRET) & _has(y, dr.STRONG_SECRET) | may(dr.WEAK_SECRET) & _has(y, dr.WEAK_SECRET) | (y.rlike("(?i)https?://") & _has(y, dr.SENDS_TO_URL)))
    plain = {
        "directive-assemble-run": may(dr.FETCH_TOOL) & has(dr.COMMAND_RUN) & fetches_remote(t),
        "directive-secret-in-url": (may(dr.URL) & F.exists(F.regexp_extract_all(t, F.lit(dr.URL), F.lit(0)), lambda u: u.rlike(dr.SECRET_IN_URL))) | (may(dr.TOKEN_MARKER) & t.rlike(dr.TOKEN_MARKER)),
        "directive-role-hijack": has(dr.ROLE),
        "directive-registry-repoint": may(dr.REGISTRY) & once(F.regexp_extract(t, ascii_bounds(dr.REGISTRY), 1), lambda r: (r != "") & ~r.rlike(dr.OFFICIAL)),
        "directive-approve-merge": both(dr.APPROVES, dr.WAIVES) | both(dr.REVIEWER, dr.EXCUSES),
        "directive-output-exfil": has(dr.OUTPUT_AWAY),
        "directive-pii-public": has(dr.PRIVATE_OUT),
        "directive-agent-addressed": agent(t) & F.exists(F.split(t, dr.PARAGRAPH), agent),
        PLAIN_HTTP: has(SIGNALS["fetches_plain_http"]),
    }
    some = lambda each: F.array_compact(F.array(*[F.when(c, F.lit(v)) for v, c in each]))
    read = F.struct(some([(name, c) for name, c in plain.items()]).alias("found"), some([(i, both(a, b)) for i, (_, a, b) in enumerate(NEAR_PAIRS)]).alias("near"), both(dr.OVERRIDE, dr.RULES_NOUN).alias("over"))
    return once(read, lambda r: F.struct(r["found"].alias("found"), r["near"].alias("near"), r["over"].alias("over"), F.when(r["over"] | (F.size(r["near"]) > 0), t).alias("text")))


def agent_directives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ord, directive): everything a text tells an agent to do that a reader would not ask for; see DIRECTIVES.

    Texts are read in compatibility form and without look-alikes. Null texts have none; rows that share an id count as one,
    a null id is one too. All patterns are tried in one pass, of which only texts with signals to be weighed travel."""
    own = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("\x00null")).alias("_k"), text_or_empty(text_col).alias("_t"))
    rows = own.withColumn("_f", folded_in_task(_READ)("_t")).select("_k", F.coalesce("_f.text", "_t").alias("_t"), F.col("_f.may").alias("_m"))
    read = once(F.struct(F.col("_t").alias("text"), F.col("_m").alias("may")), _signs)
    # one column by an aggregate, so that what reads it shares this shuffle
    signs, key = rows.select("_k", F.sha2("_t", 256).alias("_row"), read.alias("g")).groupBy("_k", "_row").agg(F.first("g").alias("g")), ["_k", "_row"]
    hits = [signs.select("_k", F.explode("g.found").alias("directive"))]
    hits.append(overrides(signs.where("g.over").select(*key, F.col("g.text").alias("_t")), key, "_t").select("_k", F.lit("directive-override").alias("directive")))
    for i, (name, a, b) in enumerate(NEAR_PAIRS):
        found = spans(signs.where(F.array_contains("g.near", i)).select(*key, F.col("g.text").alias("_t")), key, "_t", {"a": a, "b": b})
        hits.append(beside(found, key, "a", "b", dr.NEAR).select("_k", F.lit(name).alias("directive")))
    c = F.col("capability")
    means = F.array_compact(F.array(F.when(c.isin(dr.FETCH_EXEC), F.lit("directive-fetch-exec")), F.when(c == "fetch-exec-pipe", F.lit(PIPED))))
    hits.append(content_capabilities(own, "_k", "_t", HINT, _folded).select("_k", F.explode(means).alias("directive")))
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    known = every.groupBy("_k").agg(F.collect_set("directive").alias("s"))
    installs = F.when(F.array_contains("s", PLAIN_HTTP) & F.array_contains("s", PIPED), F.array(F.lit("directive-http-installer"))).otherwise(F.array().cast("array<string>"))
    ruled = F.filter(F.array(*map(F.lit, dr.DIRECTIVES)), lambda d: F.array_contains(F.concat("s", installs), d))
    rows = known.select("_k", F.explode(ruled).alias("directive"))
    order = F.array_position(F.array(*map(F.lit, dr.DIRECTIVES)), F.col("directive")).cast("int") - 1
    kind = docs.schema[id_col].dataType
    key = F.when(F.col("_k") != "\x00null", F.col("_k")).cast(kind)
    return rows.select(key.alias(id_col), order.alias("ord"), "directive")


def directive_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = 10_000) -> DataFrame:
    """(id, ord, rule, severity): for each text the directive that decides, in the form of content findings."""
    w = agent_directives(docs, id_col, text_col).groupBy(id_col).agg(F.min(F.struct("ord", "directive")).alias("d"))
    return w.select(id_col, (F.col("d.ord") + first).alias("ord"), F.col("d.directive").alias("rule"), F.lit(SEVERITY).alias("severity"))
