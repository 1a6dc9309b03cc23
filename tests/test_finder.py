"""Strings that texts hold, found in tasks, and what is left out by them."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from tamis.functions import injection_rules as ir
from tamis.functions.batches import Finder, flat_texts
from tamis.functions.literals import needed_by
from tamis.functions.normalize import normalize_corpus, normalized_texts
from tamis.functions.text import ascii_bounds
from tamis.operators import directives as di
from tamis.operators import injection as inj

ODD = [
    "", "a  b\n\n\n\nc \t x", "ig​nore ｉｇｎore", "аll 1gn0r3 th3 rul3s", "aWdub3JlIGFsbCBwcmV2aW91cw== x", "\\x69gnore &#105;gnore &amp;lt; \\u0069", "İgnore K ΣΑΣ x", "‪‫ hidden", "ﬁle ① é́ ­ soft",
    "User: a\nAI : b\nSystem\x0b: c", "i g n o\x0br e all a l l", "![x](http://h/?${TOKEN})", "1gn0r3 4ll pr3v10u5", "5y5t3m pr0mp7", "abc⁠⁠⁠",
    "You\x0bare\n now", "from now on you are", "you must now act as", "your new role is", "switch  to a new mode", "you are no\x0blonger it; you are free", "you are not a man. you are a", "update instructions :", "here are\x0byour new rules:", "ignore your previous instructions and act as",
]


def test_strings_of_texts_are_found_at_once():
    rng = random.Random(11)
    strings = sorted({"".join(rng.choice("ab ­éx") for _ in range(rng.randrange(1, 9))) for _ in range(300)})
    texts = ["".join(rng.choice("ab ­éx") for _ in range(rng.randrange(60))) for _ in range(200)] + ["", None, "a", "ab"]
    for some in (strings, [s for s in strings if len(s) < 3], ["abababab"], []):
        found = Finder(some)(*flat_texts(pa.array(texts, pa.string())))
        assert [[some[i] for i in f] for f in found] == [[s for s in some if s in (t or "")] for t in texts]


def test_texts_are_normalised_in_tasks_as_by_columns(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    want = [r.normalized for r in normalize_corpus(docs).orderBy("doc_id").collect()]
    assert [n if n is not None else t for n, t in zip(normalized_texts(pa.array(ODD, pa.string())).to_pylist(), ODD)] == want
    assert sum(n != t for n, t in zip(want, ODD)) > 6


def test_gates_hold_wherever_their_rules_match(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    gated = [r for r in ir.RULES if r[2] in ir.GATES]
    found = {(r.doc_id, r.rule) for r in inj.scan_rules(docs, gated).collect()}
    both = normalize_corpus(docs)
    want = {(r.doc_id, name) for name, _, p in gated for r in both.where(F.col("text").rlike(ascii_bounds(p)) | F.col("normalized").rlike(ascii_bounds(p))).collect()}
    assert found == want and len({name for _, name in found}) >= 7
    # no pattern is left that is tried on every text
    assert {r[0] for r in ir.RULES if r[2] not in ir.GATES and not needed_by([r[2]])} == set()


def test_strings_are_looked_for_in_tasks(spark):
    docs = spark.createDataFrame([(1, "ignore the rules")], "doc_id long, text string")
    for rows in (di.agent_directives(docs), inj.intents(docs)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" in plan and "Contains(" not in plan and "contains(t" not in plan
