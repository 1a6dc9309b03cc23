import pyarrow as pa
from pyspark.sql import functions as F

from tamis.functions.batches import codes_of, lower_texts, token_spans
from tamis.functions.text import tokens
from tamis.operators import knowledge as kn

TEXTS = ["The İstanbul PARSER-2 reads 가 가나 힣힣 a b-c", None, "", "x" * 200 + " KelvinKelvin  the end", "한글word ㄱㄴ 힤힥 -- 1 22 333", "of the and", "é ÀB cdé\U0001f600ef", "word", "word"]


def test_words_of_batches_are_tokens(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    want = [r.w for r in docs.orderBy("id").select(tokens("text").alias("w")).collect()]
    for texts, expected in ((TEXTS, want), (TEXTS[1:], want[1:]), (TEXTS[1:3], want[1:3])):  # with and without the letter that becomes two
        data, offsets = lower_texts(pa.array(texts, pa.string()))
        starts, ends, codes, at = token_spans(data, offsets)
        found = [[] for _ in texts]
        for a, b, i in zip(starts, ends, at):
            found[i].append(data[a:b].tobytes().decode())
        assert found == expected
        assert codes.tolist() == codes_of([w for ws in expected for w in ws]).tolist() if any(expected) else not len(codes)


def test_topics_go_over_batches_and_beyond_the_bound_are_joined(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat("text", F.lit(". Of the and of the and. İstanbul alpha İstanbul beta")).alias("text"))
    spoken = kn.sentences(docs)
    rows = lambda: sorted((r.doc_id, r.n, r.sentence, r.topic) for r in kn.topics(spoken).collect())
    sent = rows()
    # words are not dealt out by a shuffle
    assert "RepartitionByExpression" not in kn.topics(spoken)._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(kn, "SENT_WORDS", 0)
    assert rows() == sent and any(r[3] == "general" for r in sent)


def test_bm25_meets_terms_in_tasks_and_beyond_the_bound_joins_them(spark, sf, monkeypatch):
    from tamis.operators import store

    docs = spark.createDataFrame([(i % 7, t) for i, t in enumerate(TEXTS * 2)] + [(None, "word")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "word reads 가나 word"), (2, "the"), (3, "b-c kelvinkelvin"), (4, None)], "item_id long, text string")
    rows = lambda d, q: sorted(map(tuple, store.bm25_search(d, q).collect()), key=repr)
    none = asked.where("item_id = 2")
    sent = rows(docs, asked), rows(docs.limit(0), asked), rows(docs, none)
    assert sent[0] and not sent[1] and not sent[2]
    plan = store.bm25_search(docs, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    monkeypatch.setattr(store, "SENT_TERMS", -1)
    assert (rows(docs, asked), rows(docs.limit(0), asked), rows(docs, none)) == sent


def test_weighted_search_meets_words_in_tasks_and_beyond_the_bound_joins_them(spark, monkeypatch):
    from tamis.operators import expansion as ex

    rows = [(i, t, 0.5, i % 3, "2025-12-01") for i, t in enumerate([*TEXTS, "testing the 서버", "tests server", "deploying"])]
    store = spark.createDataFrame(rows, "id long, content string, confidence double, access_count int, accessed_at string")
    asked = spark.createDataFrame([(1, "test"), (1, "server"), (2, "reads"), (2, "word"), (3, "deploy")], "query_id long, term string")
    found = lambda: sorted(map(tuple, ex.memory_search(store, asked, F.lit("2026-01-01")).collect()))
    sent = found()
    assert sent and "MapInArrow" in ex.memory_search(store, asked, F.lit("2026-01-01"))._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(ex, "SENT_WORDS", -1)
    assert found() == sent


def test_pairs_of_words_are_counted_in_tasks_and_weighed_in_blocks(spark, monkeypatch):
    import math
    import random
    from collections import Counter

    from tamis.functions import pairs
    from tamis.operators import store

    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "서버", "éa", *(f"w{i}" for i in range(60))]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(200)] + ["beta " * 70, "the", "", None, *TEXTS]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    met, freq = Counter(), Counter()
    for ws in [r.w for r in docs.select(tokens("text").alias("w")).collect()]:
        freq.update(ws)
        for i, w in enumerate(ws):
            met.update((w, x) for j, x in enumerate(ws[max(0, i - 5) : i + 6], max(0, i - 5)) if j != i)
    weighed = {(a, b): (n, math.log2(n * sum(met.values()) / (freq[a] * freq[b]))) for (a, b), n in met.items()}

    def check():
        rows = store.pmi(docs)
        assert "MapInArrow" in rows._jdf.queryExecution().optimizedPlan().toString()
        rows = rows.collect()
        found = {(r.word, r.neighbour): (r.n, r.pmi) for r in rows}
        assert len(found) == len(rows) and found.keys() == {k for k, v in weighed.items() if v[1] >= 5e-7}
        assert all(n == weighed[k][0] and abs(p - weighed[k][1]) < 1e-6 for k, (n, p) in found.items())

    check()
    monkeypatch.setattr(store, "buckets_for", lambda *_: 7)
    check()
    assert store.pmi(docs.limit(0)).count() == 0

    # the same blocks, however many pairs a step holds, and from either way to add up counts
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    vocabulary = [r for b in pairs.words_in_task(5)(iter([batch])) for r in b.to_pylist()]
    assert sum(r["n"] for r in vocabulary if r["word"] is None) * 2 == sum(met.values()) and {r["word"]: r["n"] for r in vocabulary if r["word"]} == freq
    for step in (1, 7, 64, 1 << 23):
        monkeypatch.setattr(pairs, "PAIRS", step)
        blocks = Counter()
        for b in pairs.pairs_in_task(5, 4)(iter([batch])):
            for r in b.to_pylist():
                low, high, i, j, n = pairs._pairs_of(r["data"])
                for a, c, k in zip(low[i], high[j], n):
                    assert r["block"] == pairs.block_of(*pairs.bucket_of(pa.array([a, c]).to_numpy(), 4).tolist(), 4)
                    blocks[a, c] += int(k)
        assert sum(blocks.values()) * 2 == sum(met.values()) and len(blocks) == len({tuple(sorted(k)) for k in met})
    assert [pairs.buckets_for(p, 16) for p in (0, 5, 1 << 21, 100 << 23)] == [1, 1, 6, 14]
