from pyspark.sql import functions as F

from tamis.functions import normalize as nz
from tamis.operators import files as fl
from tamis.operators import graph


def test_normalisation(spark):
    d = spark.createDataFrame([(1, "раss​word  ＡＢ\n\n\n\nx"), (2, "plain"), (3, None)], "id int, text string")
    text, steps = nz.normalized("text")
    got = {r.id: (r.t, r.s) for r in d.select("id", text.alias("t"), steps.alias("s")).collect()}
    assert got[1] == ("password AB\n\nx", ["invisible", "look_alikes", "full_width", "blanks"])
    assert got[2] == ("plain", []) and got[3] == ("", [])


def test_trigram_similarity(spark):
    d = spark.createDataFrame([("night", "nights"), ("ab", "abc"), ("same", "same"), ("abc", "xyz")], "a string, b string")
    got = [round(r.s, 4) for r in d.select(nz.trigram_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    t = lambda w: {f"  {w} "[i : i + 3] for i in range(len(w) + 1)}
    assert got == [round(len(t("night") & t("nights")) / len(t("night") | t("nights")), 4), 0.0, 1.0, 0.0]


def test_graph_and_store_updates(spark):
    o = spark.createDataFrame([("1", "web", "cache", ["x", "y"], 0.5, 0, True), ("2", "db", "cache", ["x"], 0.95, 2, True), ("3", "db", "index", None, 0.1, 1, True)], "id string, domain string, topic string, tags array<string>, confidence double, accessCount long, valid boolean")
    assert {(r.node, r.weight) for r in graph.concept_nodes(o).collect()} == {("domain:web", 1), ("domain:db", 2), ("topic:cache", 2), ("topic:index", 1), ("tag:x", 2), ("tag:y", 1)}
    assert [(r.src, r.dst, r.topic) for r in graph.tunnels(o).collect()] == [("db", "web", "cache")]
    start = spark.createDataFrame([("tag:y",)], "node string")
    assert {(r.node, r.hop) for r in graph.expand(start, graph.concept_edges(o), 2).collect()} == {("tag:y", 0), ("topic:cache", 1), ("tag:x", 2), ("domain:web", 2), ("domain:db", 2)}
    ids = spark.createDataFrame([("2",)], "id string")
    assert {r.id: (round(r.confidence, 2), r.accessCount) for r in graph.confirm(o, ids).collect()}["2"] == (1.0, 3)
    assert {r.id: r.valid for r in graph.invalidate(o, ids).collect()} == {"1": True, "2": False, "3": True}
    assert graph.forget(o, ids).count() == 2


def test_closest(spark):
    t, c = spark.createDataFrame([("parseFlie",), ("zzz",)], "target string"), spark.createDataFrame([("parseFile",), ("parseFiles",), ("open",)], "candidate string")
    assert [(r.target, r.candidate) for r in graph.closest(t, c).collect()] == [("parseFlie", "parseFile")]


def test_file_audits(spark):
    f = spark.createDataFrame(
        [("src/a.ts", 'import { b } from "./b";\nimport "../lib/c.js";\n'), ("src/b.ts", "x\ny\n"), ("lib/c.ts", "const q = require('../src/b')\n"), ("m.py", "import os\nfrom a.b import c\n"), (".env", "A=1\nB='two'\n# C=3\n"), (".env.example", "A=2\nD=\n")],
        "path string, content string",
    )
    deps = fl.dependencies(f)
    assert {(r.src, r.dst) for r in deps.collect()} == {("src/a.ts", "src/b.ts"), ("src/a.ts", "lib/c.ts"), ("lib/c.ts", "src/b.ts")}
    assert fl.hotspots(deps).first().path == "src/b.ts"
    assert "src/a.ts" in {r.path for r in fl.entry_points(f, deps).collect()}
    assert {r.target for r in fl.imports(f.where("path = 'm.py'")).collect()} == {"os", "a.b"}
    s = fl.settings(f)
    assert {(r.path, r.key, r.value) for r in s.collect()} == {(".env", "A", "1"), (".env", "B", "two"), (".env.example", "A", "2"), (".env.example", "D", "")}
    assert [r.key for r in fl.conflicting_settings(s).collect()] == ["A"]
    assert [r.key for r in fl.missing_settings(s.where("path = '.env.example'"), s.where("path = '.env'")).collect()] == ["D"]
    assert {r.path: r.language for r in fl.inventory(f).collect()}["m.py"] == "Python"
    block = "\n".join(f"line {i}" for i in range(5))
    assert fl.repeated_blocks(spark.createDataFrame([("z", "\nq\n".join([block] * 4))], "path string, content string")).count() >= 1


def test_word_pairs_are_counted_once_for_both_sides(spark):
    from collections import Counter

    from tamis.operators import store

    texts = ["alpha beta alpha alpha gamma", "beta", "", None, "delta " * 4 + "alpha beta gamma delta omega sigma", "gamma gamma"]
    want = Counter()
    for t in texts:
        w = (t or "").split()
        want.update((w[i], w[j]) for i in range(len(w)) for j in range(max(0, i - 3), min(len(w), i + 4)) if i != j)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {(r.word, r.neighbour): r.n for r in store.cooccurrence(docs, 3).collect()} == dict(want)
    half = store._met(docs, 3, "text").collect()
    assert all(r.a <= r.b for r in half) and sum(r.n for r in half) * 2 == sum(want.values())
    freq = Counter(x for t in texts for x in (t or "").split())
    import math

    found = {(r.word, r.neighbour): (r.n, r.pmi) for r in store.pmi(docs, 3).collect()}
    weighed = {p: (n, round(math.log2(n * sum(want.values()) / (freq[p[0]] * freq[p[1]])), 6)) for p, n in want.items()}
    assert found == {p: v for p, v in weighed.items() if v[1] > 0}


def test_topics_by_hand_and_each_sentence_once(spark):
    import math
    from collections import Counter

    from tamis.operators import knowledge as kn

    texts = ["Alpha beta alpha gamma. Delta beta epsilon here!", "the and of to in on at by with from. Zeta zeta alpha beta gamma", None, " \t Omega sigma omega delta\t. Omega sigma omega delta"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    spoken = kn.sentences(docs)
    stop = set(kn.STOP_WORDS)
    words = {(r.doc_id, r.n): [w for w in r.sentence.lower().split() if w not in stop] for r in spoken.collect()}
    df = Counter(t for w in words.values() for t in set(w))
    n = sum(1 for w in words.values() if w)
    want = {}
    for key, w in words.items():
        v = [w.count(t) * (math.log((n + 1) / (df[t] + 1)) + 1) for t in w]
        options = [(round(x, 6), -i, t) for i, (x, t) in enumerate(zip(v, w))] + [(round((v[i] + v[i + 1]) * 1.5, 6), -i - 1_000_000, f"{w[i]} {w[i + 1]}") for i in range(len(w) - 1) if v[i] > 1 and v[i + 1] > 1]
        want[key] = max(options)[2] if options else "general"
    topics = kn.topics(spoken)
    assert {(r.doc_id, r.n): r.topic for r in topics.collect()} == want
    # one shuffle of sentences and no window over their words
    plan = topics._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "general" in {*want.values()}


def test_expansion_reads_its_edges_once_a_hop(spark):
    from tamis.operators import graph

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "a"), ("d", "a"), ("y", "z")], "src string, dst string")
    starts = spark.createDataFrame([("a",), ("a",), ("q",)], "node string")
    found = graph.expand(starts, edges, 2)
    assert {(r.node, r.hop) for r in found.collect()} == {("a", 0), ("q", 0), ("b", 1), ("x", 1), ("d", 1), ("c", 2)} and found.count() == 6
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 3
