"""Stems, loanwords, synonyms, expansion and weighted search against answers worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tamis.functions import words as wd
from tamis.operators import expansion as ex

STEMS = {"relational": "relate", "deploying": "deploy", "cats": "cats", "tests": "test", "happiness": "happy", "use": "use", "Running": "runn", "station": "station", "formation": "form", "ability": "abil", "ies": "ies", "": "", "stress": "stres"}


def by_rules(word):
    if len(word) < wd.STEM_LEAST:
        return word
    low = word.lower()
    for suffix, put, least in wd.STEM_RULES:
        if low.endswith(suffix) and len(low) - len(suffix) + len(put) >= least:
            return low[: len(low) - len(suffix)] + put
    return low


def test_stems_and_loanwords(spark):
    words = [w for w in STEMS] + ["데이터베이스", "database", "constructor", None]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", wd.stem(F.col("w")).alias("s"), wd.transliterate(F.col("w")).alias("t")).collect()
    got = {r.w: (r.s, r.t) for r in rows}
    assert all(got[w][0] == by_rules(w) for w in words if w is not None)
    assert [got[w][0] for w in ("relational", "deploying", "cats", "happiness", "formation")] == ["relate", "deploy", "cats", "happy", "form"]
    assert got["데이터베이스"][1] == "database" and got["database"][1] == "데이터베이스" and got["constructor"][1] is None and got[None] == (None, None)


def test_expansion_in_order_and_once(spark):
    known = ex.synonyms(spark.createDataFrame([(1, "deploy"), (1, "Release"), (2, "release"), (2, "ship"), (None, "x"), (3, None)], "group int, word string"))
    assert {tuple(r) for r in known.collect()} == {("deploy", "release"), ("release", "deploy"), ("release", "ship"), ("ship", "release")}
    related = spark.createDataFrame([("deploy", 1, "server"), ("deploy", 2, "release"), ("deploy", 4, "late")], "word string, rank int, neighbour string")
    q = spark.createDataFrame([(1, "deploy testing 데이터베이스 deploy"), (2, None), (3, "the")], "item_id long, text string")
    got = {(r.query_id, r.term): (r.source, r.related_to) for r in ex.expand_queries(q, known, related).collect()}
    assert got == {
        (1, "deploy"): ("original", None), (1, "testing"): ("original", None), (1, "데이터베이스"): ("original", None), (1, "release"): ("synonym", "deploy"), (1, "server"): ("cooccurrence", "deploy"),
        (1, "test"): ("stem", "testing"), (1, "database"): ("transliteration", "데이터베이스"), (1, "디플로이"): ("transliteration", "deploy"),
    }


def test_weighted_search_by_hand(spark):
    rows = [("a", "testing server", 1.0, 0, "2025-12-31"), ("b", "tests of the 서버", 0.5, 3, "2025-12-01"), ("c", "boats on the lake", 1.0, 9, "2026-01-01"), ("d", None, 1.0, 0, "2026-01-01")]
    store = spark.createDataFrame(rows, "id string, content string, confidence double, access_count int, accessed_at string")
    asked = spark.createDataFrame([(1, "testing"), (1, "server"), (2, "missing")], "query_id long, term string")
    got = {(r.query_id, r.id): (r.rank, r.score) for r in ex.memory_search(store, asked, F.lit("2026-01-01")).collect()}
    idf, mean = {"testing": math.log((4 - 1 + 0.5) / 1.5 + 1), "server": math.log((4 - 2 + 0.5) / 2.5 + 1)}, (2 + 2 + 2 + 0) / 4
    one = lambda idf, tf, n: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))
    a = (one(idf["testing"], 1, 2) + one(idf["server"], 1, 2)) * math.exp(-0.005) * 1.0
    b = (one(idf["testing"], 0.7, 2) + one(idf["server"], 1, 2)) * math.exp(-0.005 * 31) * 0.75 * (1 + 0.1 * math.log(4))
    assert set(got) == {(1, "a"), (1, "b")} and got[1, "a"][0] == 1
    assert got[1, "a"][1] == pytest.approx(a, abs=1e-5) and got[1, "b"][1] == pytest.approx(b, abs=1e-5)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ex.term_keys(docs).count() == 0
    store = spark.createDataFrame([], "id string, content string, confidence double, access_count int, accessed_at timestamp")
    assert ex.memory_search(store, spark.createDataFrame([(1, "x")], "query_id long, term string"), F.current_timestamp()).count() == 0
