"""op13 against a count by hand, with samples that propose everything, something and nothing."""

import random
import re
from collections import Counter
from fractions import Fraction
from math import floor

import pytest
from pyspark.sql import types as T

from tamis.llm.phrases import mine_phrases

SCHEMA = "lang string, text string"


def by_hand(rows, least, longest=3, inside=50, top=2000):
    f, n, lower = Counter(), Counter(), str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = []
    for (lang, p), a in f.items():
        if len(p) == 1 or a < least:
            continue
        cuts = [(floor(Fraction(1000000 * a * a, f[lang, p[:k]] * f[lang, p[k:]])), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        outer = [b for (other, q), b in f.items() if other == lang and b >= least and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if not any(100 * b >= inside * a for b in outer):
            score, _, left, right = min(cuts)
            found.append((lang, " ".join(p), a, left, right, n[lang], score))
    found.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    out, rank = [], Counter()
    for x in found:
        rank[x[0]] += 1
        if rank[x[0]] <= top:
            out.append((x[0], rank[x[0]], *x[1:]))
    return out


def corpus(seed, docs=120, words=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["É", "日本", "x" * 30, "y" * 16]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    made = lambda: "".join(w + rng.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n"]) for w in rng.choices(vocabulary, weights, k=rng.randrange(25)))
    return [(rng.choice(["en", "fr", None, "und"]), rng.choice([made(), made().upper(), None, ""])) for _ in range(docs)]


@pytest.mark.parametrize("sample", [0.0, 0.3, 1.0])
@pytest.mark.parametrize("least,longest,top", [(4, 3, 2000), (2, 4, 2000), (3, 2, 5)])
def test_counts_by_hand(spark, sample, least, longest, top):
    rows = corpus(least * 10 + longest)
    got = mine_phrases(spark.createDataFrame(rows, SCHEMA).repartition(3), least=least, longest=longest, top=top, sample=sample).collect()
    assert sorted(map(tuple, got)) == sorted(by_hand(rows, least, longest, top=top)) and got


def test_large_counts_are_exact(spark):
    from tamis.llm import phrases

    a, other = 3_000_000_019, 3_000_000_037
    counts = spark.createDataFrame([("en", None, 10**12), ("en", "a", a), ("en", "b", other), ("en", "a b", a)], "lang string, phrase string, n long")
    kept, phrases.phrase_counts = phrases.phrase_counts, lambda *_: counts
    try:
        row = mine_phrases(counts).first()
    finally:
        phrases.phrase_counts = kept
    assert row.score == 1000000 * a * a // (a * other) and (row.a, row.l, row.r, row.n) == (a, a, other, 10**12)


def test_empty_tables_hot_rows_and_clashing_columns(spark):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "text", "phrase", "n", "rank")])
    assert mine_phrases(spark.createDataFrame([], schema)).count() == 0
    rows = [("en", "Hot line here. hot line", "p", "n", "r")] * 60 + [(None, "..", "p", None, None)]
    got = {r.phrase: r for r in mine_phrases(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"hot line here"} and (got["hot line here"].a, got["hot line here"].l, got["hot line here"].r, got["hot line here"].n) == (60, 120, 60, 300)
