"""op11 against the library, by whole texts, by appends and by edits."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import types as T

from tamis.llm.byte_bpe import WORDS, Bulk, BytePairs, apply_edits, decode_tokens, encode_texts, ids_within
from tamis.llm.queries import QUERIES

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ALPHABET = "aeinrst  \n\t'.,!sdLLéÀ世界🙂٣12 　vrelm'''\x85"
HARD = ["", " ", "'s", " 's", "a's b're c'VE d'll", "x  y", "x \n y \n", "\n\n  ", "''s", "'", " '", "a'", "1'd", "  a", "<|endoftext|>", "x" * 5000, " " * 700, "é" * 40, "🙂 🙂", "-" * 300 + "a", "\x00a"]


@pytest.fixture(scope="module")
def known():
    return BytePairs.read(RANKS, PATTERN)


@pytest.fixture(scope="module")
def library(known):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=known.ranks, special_tokens={})


def texts(n, seed=3):
    rng = random.Random(seed)
    return HARD + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(80))) for _ in range(n)]


def test_both_ways_of_encoding_are_the_librarys(known, library):
    own = texts(4000)
    raw = [t.encode() for t in own]
    ids, bounds = Bulk(known).texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    assert PATTERN == WORDS
    for i, text in enumerate(own):
        want = library.encode_ordinary(text)
        assert ids[bounds[i] : bounds[i + 1]].tolist() == want
        assert np.frombuffer(known.encode(text), "<u4").tolist() == want


def test_every_prefix_has_its_encoding(known):
    rng = random.Random(4)
    for _ in range(200):
        raw = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 25)))
        last = known.extend(raw, [])
        for end in range(len(raw) + 1):
            assert [known.bytes[t] for t in known.tokens(last, end)] == known.merged(raw[:end])


def test_appends_and_edits_leave_the_table_exact_and_work_near_the_edit_only(known, library):
    rng = random.Random(5)
    for text in texts(600, 6):
        table, want = known.table(text), text
        for _ in range(4):
            at, removed, put = rng.randrange(len(want) + 2), rng.randrange(6), "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(6)))
            at = min(at, len(want))
            want = want[:at] + put + want[at + removed :]
            table.edit(at, removed, put)
            assert table.text == want and table.tokens() == library.encode_ordinary(want)
    long = "some words of a long text " * 2000
    table = known.table(long)
    before = table.worked
    table.edit(25_000, 3, "other")
    table.append(" and more")
    assert table.tokens() == library.encode_ordinary(table.text) and table.worked - before < 60


def test_query_round_trip_on_whole_tables(spark, sf, library):
    rows = {r.doc_id: r for r in QUERIES["op11_byte_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_nulls_repeats_empty_tables_and_clashing_columns(spark, library):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("token_ids", T.StringType()), T.StructField("n_tokens", T.StringType())])
    docs = spark.createDataFrame([(None, "a b", "x", "y"), (1, None, None, None), (1, "", "x", "y"), (1, "long " * 40_000, None, "y")], schema)
    out = decode_tokens(encode_texts(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, len(r.decoded)) for r in out) == [(0, 2, 3), (1, 0, 0), (1, 0, 0), (1, 40_001, 200_000)]
    empty = encode_texts(docs.limit(0), RANKS, PATTERN)
    assert empty.count() == 0 and decode_tokens(empty, RANKS, PATTERN).count() == 0
    tables = encode_texts(docs.where("doc_id is null"), RANKS, PATTERN, with_prefixes=True).select("last_tokens", ids_within("token_ids", 1).alias("cut")).first()
    assert tables.last_tokens == [64, 220, 275] and np.frombuffer(tables.cut, "<u4").tolist() == [64]


def test_edits_as_a_table(spark, library):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "untouched"), (None, "x")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 0, 3, "1"), (1, 1, 99, 0, " four"), (2, None, None, None, "new"), (9, 1, 0, 0, "x"), (None, 1, 0, 0, "x")], "doc_id long, seq int, at int, removed int, put string")
    out = {r.doc_id: r for r in apply_edits(docs, edits, RANKS, PATTERN).collect()}
    assert {k: r.text for k, r in out.items()} == {1: "1 two three four", 2: "new"}
    assert all(np.frombuffer(r.token_ids, "<u4").tolist() == library.encode_ordinary(r.text) for r in out.values())
