import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tamis.functions import text as tx
from tamis.operators import audit, detect, secrets, store, web
from tamis.sources import tables
from tamis.streaming import guards

KEY = "AKIA" + "QZ7XW3" + "R9T2LM8VKB"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_secrets_mask_dedupe_and_placeholders(spark):
    d = docs(spark, [(1, f"key {KEY} and {KEY}"), (2, "password = 'changeme123'"), (3, None), (4, ""), (5, "token: \"your-token-here-please\""), (6, f"x {KEY}")])
    rows = secrets.scan_secrets(d).collect()
    assert [(r.doc_id, r.rule) for r in sorted(rows)] == [(1, "aws-akid"), (6, "aws-akid")]
    assert all(KEY not in r.evidence and r.masked.startswith("AKIA") and r.masked.endswith("KB") for r in rows)
    out = {r.doc_id: r for r in secrets.redact(d).collect()}
    assert KEY not in out[1].text and out[1].secrets_redacted == 1 and out[3].text == "" and len(out) == 6
    assert secrets.reused_secrets(secrets.scan_secrets(d)).first().documents == 2
    assert {r.doc_id: r.still_present for r in secrets.still_present(secrets.scan_secrets(d.where("doc_id = 1")), secrets.scan_secrets(d.where("doc_id = 6"))).collect()} == {1: True}


def test_entropy_windows_match_brute_force(spark):
    text = "abab " * 20 + "".join(chr(33 + i % 90) for i in range(0, 900, 7)) + "zz" * 50
    found = detect.entropy_windows(docs(spark, [(1, text), (2, None), (3, "short")])).collect()

    def bits(s):
        return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())

    want, free = [], 0
    for i in range(0, len(text) - 63, 16):
        if i >= free and bits(text[i : i + 64]) > 4.5:
            want.append((i, round(bits(text[i : i + 64]), 6)))
            free = i + 64
    assert [(r.offset, r.bits) for r in sorted(found)] == want and want


def test_repetition(spark):
    rows = detect.repetition(docs(spark, [(1, "a" * 25), (2, "xy" * 30), (3, "plain"), (4, None)])).collect()
    assert {(r.doc_id, r.unit) for r in rows} == {(1, "a"), (2, "xy")}


def test_pmi_counts_both_directions(spark):
    rows = {(r.word, r.neighbour): r.n for r in store.cooccurrence(docs(spark, [(1, "alpha beta gamma alpha"), (2, None), (3, "alpha")])).collect()}
    assert rows[("alpha", "beta")] == rows[("beta", "alpha")] == 2


def test_chunks_cover_the_text(spark):
    paragraphs = [f"paragraph {i} " + "word " * 40 for i in range(12)]
    rows = sorted(web.chunk_paragraphs(docs(spark, [(1, "\n\n".join(paragraphs)), (2, None), (3, "one")]), 500, 50).collect())
    one = [r.text for r in rows if r.doc_id == 1]
    assert all(any(p.strip() in c for c in one) for p in paragraphs) and [r.text for r in rows if r.doc_id == 3] == ["one"] and not [r for r in rows if r.doc_id == 2]


def _chunk_text(text, size, overlap):
    """src/docparser/chunker.ts by its steps."""
    chunks, current, begin, offset = [], "", 0, 0
    for para in re.split(r"\n{2,}", text):
        p = para.strip()
        if not p:
            offset += len(para) + 2
            continue
        new = re.search(r"^(?:#{1,6}\s|[A-Z][A-Z\s]{5,}$|\d+\.\s+[A-Z]|={3,}$|-{3,}$)", p, re.M)
        if current and (len(current) + len(p) > size or new):
            chunks.append((current.strip(), begin))
            if overlap > 0 and len(current) > overlap:
                current, begin = current[-overlap:] + "\n\n" + p, offset - overlap
            else:
                current, begin = p, offset
        else:
            begin = begin if current else offset
            current = current + "\n\n" + p if current else p
        offset += len(para) + 2
    return chunks + ([(current.strip(), begin)] if current.strip() else [])


def test_chunks_are_those_of_the_reference(spark):
    rng = random.Random(4)
    lines = ["plain words here", "# Title", "ALL CAPITALS", "2. Numbered", "====", "---", "é ñ ü", "", " ", "\t", "x" * 90, "SHORT", "#none", "a\u00a0"]
    texts = ["", " \n\n ", "one\ntwo", "\n\n\nA\n\n\n\n# B"] + ["".join(rng.choice(lines) + rng.choice(["\n", "\n\n", "\n\n\n", " "]) for _ in range(rng.randint(1, 30))) for _ in range(80)]
    d = docs(spark, [*enumerate(texts), (999, None)])
    for size, overlap in ((120, 20), (200, 0), (1000, 200)):
        got = {(r.doc_id, r.chunk_index): (r.text, r.start_offset) for r in web.chunk_paragraphs(d, size, overlap).collect()}
        assert got == {(i, k): c for i, t in enumerate(texts) for k, c in enumerate(_chunk_text(t, size, overlap))}


def test_tokens_and_masks(spark):
    r = docs(spark, [(1, "The Quick-fix, a B2 über x")]).select(tx.tokens("text").alias("w")).first()
    assert r.w == ["quick-fix", "b2", "ber"]


def test_audit_unit_diff_and_attribution(spark):
    a, b = docs(spark, [(1, "x\ny\ny")]), docs(spark, [(1, "x\ny\nz")])
    got = {(r.unit, r.nth, r.change) for r in audit.unit_diff(audit.line_units(a), audit.line_units(b)).collect()}
    assert got == {("z", 1, "added"), ("y", 2, "removed")}
    ch = spark.createDataFrame([("f", 10), ("g", 10)], "path string, accepted_at long")
    w = spark.createDataFrame([("f", 5, "old"), ("f", 12, "b"), ("f", 11, "a")], "path string, ts long, writer string")
    assert {r.path: r.writer for r in audit.attribute_changes(ch, w, "path").collect()} == {"f": "a", "g": None}


def test_added_lines_of_a_patch(spark):
    patch = "--- a/f.py\n+++ b/f.py\n@@ -1,2 +1,3 @@\n one\n+two\n three\n@@ -9 +10,2 @@\n+ten\n-old\n+eleven"
    rows = tables.added_lines(spark.createDataFrame([("c1", patch)], "commit string, patch string")).collect()
    assert [(r.file, r.line_no, r.line) for r in sorted(rows, key=lambda r: r.line_no)] == [("f.py", 2, "two"), ("f.py", 10, "ten"), ("f.py", 11, "eleven")]


def test_store_and_session_log(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text('{"id":"1","content":"a","accessedAt":"2"}\nbroken\n{"id":"1","content":"b","accessedAt":"3"}\n')
    rows = tables.observation_store(spark, str(tmp_path / "s"))
    assert [(r.id, r.content) for r in rows.collect()] == [("1", "b")]
    assert tables.merge_store(rows, rows.withColumn("id", F.lit("2")).unionByName(rows)).count() == 2
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "x.jsonl").write_text('{"type":"user","sessionId":"s","timestamp":"2025-01-01T00:00:00Z","message":{"role":"user","content":"hi"}}\n{"message":{"role":"assistant","content":[{"type":"text","text":"a"},{"type":"tool_use"}]}}\nnope\n')
    assert [r.text for r in tables.session_log(spark, str(tmp_path / "l")).collect()] == ["hi", "a"]


def test_streams_equal_batches(spark, sf, tmp_path):
    events = tables.table(spark, sf, "events")
    path = str(tmp_path / "events")
    events.repartition(2).write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    q = guards.exposure_stream(stream, "error", "purchase").writeStream.outputMode("complete").format("memory").queryName("levels").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {r.user_id: r.level for r in guards.exposure_stream(events, "error", "purchase").collect()}
    assert {r.user_id: r.level for r in spark.table("levels").collect()} == batch
    q = guards.counts_by_window(stream.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", "1 hour").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()


def test_quarantine_split(spark, tmp_path):
    path = str(tmp_path / "in")
    docs(spark, [(1, f"k {KEY}"), (2, "fine"), (3, None)]).write.parquet(path)
    stream = guards.guard_stream(spark.readStream.schema("doc_id long, text string").parquet(path))
    guards.quarantine_sink(stream, str(tmp_path / "ok"), str(tmp_path / "held"), str(tmp_path / "cp")).awaitTermination()
    assert {r.doc_id for r in spark.read.parquet(str(tmp_path / "ok")).collect()} == {2, 3}
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "held")).collect()] == [1]
