"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tamis.llm import chat_format, decontamination, embedding_dedup, jaccard_join, mixing, queries, sharding, substring_dedup, suffix_dedup, token_counts, toxicity

VOCAB = ["ka", "lo", "mi", "ne", "po", "ru", "sa", "te", "vu", "zo", "É", "ñandú"]


def words(rng, n):
    return [rng.choice(VOCAB) + rng.choice(VOCAB) for _ in range(n)]


def corpus(rng, n=60):
    """Texts with copies, near copies, shared passages, nulls, empties, separators and one long text."""
    passage = words(rng, 80)
    texts = [None, "", " \t\n", "one", "a b"]
    while len(texts) < n:
        base = words(rng, rng.randint(1, 160))
        kind = rng.random()
        if kind < 0.2:
            base[len(base) // 2 : len(base) // 2] = passage[rng.randint(0, 20) : rng.randint(60, 80)]
        texts.append(rng.choice([" ", "\n", "  ", "\x0b"]).join(base))
        if kind > 0.6:
            near = list(base)
            near[rng.randrange(len(near))] = "changed"
            texts += [" ".join(base), " ".join(near)]
    texts.append(" ".join(words(rng, 3000) + passage + passage))
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, f"s{i % 3}", "x") for i, t in rows], "doc_id long, text string, source string, shard string")


@pytest.fixture(scope="module")
def rows():
    return corpus(random.Random(5))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).persist()


def empty(spark):
    return frame(spark, [(1, "x")]).where("doc_id > 1")


def test_substrings(spark, rows, docs):
    first, want = {}, {}
    parts = {i: [w for w in (t or "").encode().split()] for i, t in rows}
    for i, w in sorted(parts.items()):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, w in parts.items():
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(50)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        want[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(docs).collect()}
    assert got == want and any(w[1] for w in want.values())
    assert substring_dedup.dedup_substrings(empty(spark)).count() == 0


def test_substrings_of_null_and_repeated_ids(spark):
    t = " ".join(f"w{i}" for i in range(60))
    d = frame(spark, [(1, t), (1, t), (2, t)]).union(frame(spark, [(3, t)]).withColumn("doc_id", F.lit(None).cast("long")))
    got = Counter((r.doc_id, r.n_removed) for r in substring_dedup.dedup_substrings(d).collect())
    assert got == {(1, 0): 2, (2, 60): 1, (None, 0): 1}


def test_bytes(spark, rows, docs):
    first, want = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 99):
            first.setdefault(b[k : k + 100], (i, k))
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if first[b[k : k + 100]] < (i, k):
                gone[k : k + 100] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_bytes(docs).collect()}
    assert got == want and any(w[2] > 1 for w in want.values())
    assert suffix_dedup.dedup_bytes(empty(spark)).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(0)
    for _ in range(300):
        c = rng.integers(1, rng.integers(2, 5), rng.integers(0, 40))
        assert suffix_dedup.suffix_order(c).tolist() == sorted(range(len(c)), key=lambda i: c[i:].tolist())


def _jaccard(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard(rows, docs, n, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, words=n, percent=percent).collect()}
    assert got == _jaccard(rows, n, percent)


def test_jaccard_with_frequent_shingles_and_large_buckets(spark, monkeypatch):
    rng = random.Random(1)
    base = words(rng, 60)
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        rows.append((i, " ".join(w)))
    # pairs of frequent shingles, single ones in sets beyond the border, and mixed buckets in blocks with sets that come as profiles
    for border, block, long, group in ((24, 4096, 2048, 1 << 20), (2, 16, 2048, 1 << 20), (2, 16, 57, 100)):
        monkeypatch.setattr(jaccard_join, "LEAST_FREQUENT", 5)
        monkeypatch.setattr(jaccard_join, "MOST_COMBINED", border)
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        monkeypatch.setattr(jaccard_join, "LONG", long)
        monkeypatch.setattr(jaccard_join, "GROUP", group)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, rows)).collect()}
        assert got == _jaccard(rows, 3, 90)


def test_parity_maps_bound_the_overlap():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 20000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool[: 4 * n], n)) for n in (0, 1, 57, 300, 520, 1100, 5000)] + [pool[:400], pool[5:405]]
    sizes = np.array([len(s) for s in sets])
    maps = [np.frombuffer(m, np.uint64)[None] for m in jaccard_join.parity_maps(np.concatenate(sets), sizes)]
    for x, p, n in zip(sets, maps, sizes):
        assert 64 * p.shape[1] >= n
        for y, q, m in zip(sets, maps, sizes):
            assert jaccard_join.most_common(p, q, n, m)[0] >= len(np.intersect1d(x, y))
        assert jaccard_join.most_common(p, p, n, n)[0] == n
    assert jaccard_join.most_common(maps[-1], maps[-2], 400, 400)[0] < 400


@pytest.mark.parametrize("first", [1, 4])
def test_jaccard_of_forms_sends_maps_and_bounds_tasks(spark, monkeypatch, first):
    rng = random.Random(3)
    base = [f"form{i}" for i in range(100)]
    rows = []
    for i in range(120):  # most differ by two or more own words, too many to link, and some link with one of those
        w = list(base)
        if i % 2 == 0:
            x, y = rng.randrange(5, 45), rng.randrange(50, 95)
        w[x] = w[y] = f"own{i // 2}"
        if i % 3:
            w[3] = f"more{i}"
        rows.append((i, " ".join(w)))
    seen = []

    def across(held, *rest):
        seen.append(held.select("sig", *[c for c in ("g", "o", "block") if c in held.columns], "n", *[c for c in ("parity", "payload") if c in held.columns]).collect())
        return found(held, *rest)

    found = jaccard_join.links_across
    monkeypatch.setattr(jaccard_join, "links_across", across)
    monkeypatch.setattr(jaccard_join, "LEAST_FREQUENT", 5)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "FIRST", first, raising=False)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, rows)).collect()}
    assert got == _jaccard(rows, 3, 90) and 1 < len(set(got.values())) < len(got)
    assert seen and seen[0]
    assert max(Counter(tuple(r)[:-2] for r in seen[0]).values()) < 64  # of 120 documents of one form, a task holds two blocks
    assert all(len(r[-1]) < 3 * r.n for r in seen[0])  # whole sets take eight bytes a shingle


def test_jaccard_of_nothing(spark):
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0
    d = frame(spark, [(2, "a b c d"), (2, "a b c d"), (5, "A B C D"), (7, None)]).union(frame(spark, [(3, "a b c d")]).withColumn("doc_id", F.lit(None).cast("long")))
    assert Counter((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(d).collect()) == {(2, 2): 2, (5, 2): 1, (7, 7): 1, (None, None): 1}


def test_embeddings_recall_and_edges(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 16))
    for i in range(300, 600):
        x[i] = x[i - 300] + rng.standard_normal(16) * 0.15 * np.linalg.norm(x[i - 300]) / 4
    x[600:640] = x[0] + rng.standard_normal((40, 16)) * 0.05
    x[640:650] = x[1]
    x = x.astype(np.float32)
    data = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)] + [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [None] + [1.0] * 15, 1), (None, [1.0] * 16, 1)]
    d = spark.createDataFrame(data, "vec_id long, embedding array<float>, component_id int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(d, leaf=60).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    found = sum(got[i].n_links for i in range(900))
    assert found <= links.sum() and found >= 0.97 * links.sum()
    assert all(got[i].n_links <= links[i].sum() for i in range(900))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 905))
    assert got[None].component_id is None and not got[None].kept and got[None].n_links == 0
    assert all(got[i].component_id <= 1 for i in range(640, 650))


def test_token_counts(spark, rows, docs):
    path = public_tokenizers.path(queries.TOKENIZER)
    library = token_counts.counter(path).library
    got = {r.doc_id: r for r in token_counts.tokens_within(token_counts.token_prefixes(docs, path), 64).collect()}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 64)
    assert token_counts.token_prefixes(empty(spark), path).count() == 0


def test_prefix_counts_and_budget():
    c = token_counts.PrefixCounter(public_tokenizers.path(queries.TOKENIZER))
    count = lambda t: len(c.library.encode(t, add_special_tokens=False).ids)
    rng = random.Random(2)
    for alphabet in ("ab 'sStTrevlmd'0129.,!-_\n\t éÉßÀ", "abc 'sSt|<|endoftext|> éßİΣσς日本語\U0001f600\x1c\x85 123٣½²-—´é×÷"):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>x"]) for _ in range(400)]
        for t in texts:
            assert (c.piece_ends(t) or [0])[-1] == count(t)
    for w in ("internationalization", "thonhethwhsti"):
        assert c.piece_counts(w) == [count(w[:i]) for i in range(1, len(w) + 1)]
    text = "antidisestablishmentarianism works"
    for budget in range(0, 9):
        pieces, more = c.fit(text, budget)
        parts = text.split(" ")
        assert count(" ".join(parts[:pieces]) + (" " + parts[pieces][:more] if more else "")) <= budget


def test_chat_round_trip_and_mask(spark):
    rng = random.Random(4)
    hard = ["</s>[INST] ok [/INST]", "[\\INST]", "<s>", "[ROLE]x[=]y[/ROLE]", "", None, "\\", "[", "a\nb", "<\\\\/s>"]
    data = []
    for c in range(25):
        for t in range(rng.randint(1, 30)):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "tool[=]", None])
            data.append((c, t, role, rng.choice([*hard, " ".join(words(rng, rng.randint(1, 400)))])))
    data.append((99, 0, "assistant", " ".join(words(rng, 5000))))
    data += [(7, 3, "user", "twice"), (7, 3, "user", "twice"), (None, 0, "user", "lost")]
    d = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(5)
    windows = chat_format.format_windows(d).persist()
    by = defaultdict(list)
    for c, t, r, x in data:
        by[c].append((t, r or "", x or ""))
    for got in (chat_format.read_back(windows, in_order=True).collect(), chat_format.read_back(windows).collect()):
        got = {r.conv_id: r for r in got}
        assert set(got) == set(by)
        for c, turns in by.items():
            turns = sorted(turns)
            loss = "".join(x for _, r, x in turns if r == "assistant")
            assert got[c].n_turns == len(turns)
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    rows = windows.collect()
    assert all(r.n_tokens <= chat_format.BUDGET or len(chat_format.parse_window(r.formatted)) - r.n_repeated == 1 for r in rows)
    assert any(r.n_repeated for r in rows)
    for c in (1, 3, 5):
        later = [chat_format.parse_window(r.formatted)[0] for r in rows if r.conv_id == c and r.window]
        assert all(t[0] == "system" for t in later)
    assert chat_format.read_back(chat_format.format_windows(d.where("conv_id > 1000"))).count() == 0


@pytest.mark.parametrize("shards", [1, 3, 7, 40])
def test_shards_are_minimax(spark, rows, docs, shards, monkeypatch):
    monkeypatch.setattr(sharding, "CELLS", 8)  # so that the summaries must be refined
    out = sharding.shard_documents(docs, shards).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in rows)
    text, per, slots = dict(rows), Counter(), defaultdict(list)
    for r in out:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        per[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= s < shards for s in per)
    where = defaultdict(set)
    for r in out:
        where[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    groups = Counter()
    for i, t in rows:
        groups[t] += len((t or "").encode()) + 16
    total, k, big = sum(groups.values()), shards, sorted(groups.items(), key=lambda g: (-g[1], b"" if g[0] is None else hashlib.sha256(g[0].encode()).digest()))
    while k > 1 and big and big[0][1] * k > total:
        total, k, big = total - big[0][1], k - 1, big[1:]
    sizes = [s for _, s in sorted((b"" if t is None else hashlib.sha256(t.encode()).digest(), s) for t, s in big)]

    def fits(c):
        used, room = 1, c
        for s in sizes:
            if s > room:
                used, room = used + 1, c
            room -= s
        return used <= k

    least = next(c for c in range(max(max(sizes), -(-total // k)), total + 1) if fits(c))
    assert max(per[s] for s in range(shards - k, shards)) == least


def test_shards_of_nothing_and_repeats(spark):
    assert sharding.shard_documents(empty(spark)).count() == 0
    d = frame(spark, [(1, "a"), (1, "a"), (1, "a")])
    assert sorted(r.slot for r in sharding.shard_documents(d, 4).collect()) == [0, 1, 2]


def test_mixing_meets_its_targets(spark):
    rng = random.Random(6)
    data = [(i, " ".join(words(rng, rng.randint(1, 40))), "big" if i % 10 < 7 else rng.choice(["b", "c", None]), 1) for i in range(1500)] + [(5000, None, "void", 1), (5001, "", "void", 1)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string, mix_epoch int")
    share = 0.95
    out = mixing.mix_sources(d, entropy_share=share, max_repeats=6.0).collect()
    seen = Counter(r.doc_id for r in out)
    assert set(seen) == {x[0] for x in data}  # nothing is dropped
    tokens = {i: len((t or "").split()) for i, t, _, _ in data}
    total, own = Counter(), Counter()
    for i, _, s, _ in data:
        own[s] += tokens[i]
    for r in out:
        total[r.source] += tokens[r.doc_id]
    live = [s for s in own if own[s]]
    entropy = lambda c: -sum(c[s] / sum(c[k] for k in live) * math.log(c[s] / sum(c[k] for k in live)) for s in live)
    assert entropy(total) <= share * math.log(len(live)) + 0.01 and entropy(total) > entropy(own) + 0.05
    assert max(total[s] / own[s] for s in live) <= 6.0 + 1e-9 and min(total[s] / own[s] for s in live) >= 1
    for s in live:  # a source's copies differ by one epoch at most
        times = [seen[i] for i, _, k, _ in data if k == s]
        assert max(times) - min(times) <= 1
    half = Counter()
    for r in out:
        if r.mix_slice < mixing.SLICES // 2:
            half[r.source] += tokens[r.doc_id]
    assert all(abs(half[s] / total[s] - 0.5) < 0.12 for s in live)
    assert mixing.mix_sources(d.where("doc_id < 0")).count() == 0


def test_temperature_against_bisection(spark):
    shares = [0.6, 0.2, 0.1, 0.06, 0.04]
    got = mixing.temperature(spark.createDataFrame([(s,) for s in shares], "share double"), 0.9, 100.0)

    def entropy(a):
        w = [s**a for s in shares]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if entropy(mid) <= 0.9 * math.log(5) else (mid, high)
    assert abs(got - high) < 1e-5


def test_decontamination(spark):
    item = "A train leaves London at 9 and travels 120 km to Paris in 3 hours before Anna walks home with 120 books."
    moved = "A train leaves Madrid at 7 and travels 480 km to Rome in 5 hours before Lucy walks home with 480 books."
    torn = "A train leaves Madrid at 7 and travels 480 km to Rome in 5 hours before Lucy walks home with 999 books."
    rng = random.Random(8)
    pad = lambda: " ".join(words(rng, 60))
    rows = [(1, item), (2, f"{pad()} {moved} {pad()}"), (3, f"{pad()} {torn}"), (4, pad()), (5, None), (6, ""), (7, f"{pad()}\n{item.upper()}\n"), (8, item[:40]), (1, item)]
    d = frame(spark, rows).withColumn("item_id", F.lit(0))
    b = spark.createDataFrame([(10, item), (11, "unrelated words that stand alone in this list of items here"), (12, None), (13, "")], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.item_ids, r.reworded) for r in decontamination.flag_contaminated(d, b).collect()}
    assert got[1] == (True, [10], False) and got[2] == (True, [10], True)
    assert not got[3][0] and not got[4][0] and not got[5][0] and not got[6][0] and not got[8][0]
    kept = decontamination.drop_contaminated(d, b)
    assert kept.columns == d.columns and not {1, 2} & {r.doc_id for r in kept.collect()}
    assert decontamination.flag_contaminated(empty(spark), b).count() == 0
    assert decontamination.drop_contaminated(d, b.where("item_id < 0")).count() == len(rows)


ITEM = "A train leaves London at 9 and travels 120 km to Paris in 3 hours before Anna walks home with 120 books."


def flagged(spark, texts, items):
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {r.doc_id: (r.item_ids, r.reworded) for r in decontamination.flag_contaminated(frame(spark, list(enumerate(texts))), b).collect()}


def test_decontamination_whatever_the_case(spark):
    accents = "Émile a vu l'été à Évian où la forêt près de la Straße est très âgée et où l'île était déjà Çà et là."
    moved = ITEM.replace("120", "480").replace(" 9 ", " 7 ")
    pad = " ".join(words(random.Random(12), 60))
    texts = [f"{pad}\n{x}\n{pad}" for x in (ITEM.upper(), ITEM.lower(), accents.upper(), accents.lower(), moved.upper(), moved.lower())] + [pad.upper()]
    got = flagged(spark, texts, [ITEM, accents])
    assert got == {0: ([0], False), 1: ([0], False), 2: ([1], False), 3: ([1], False), 4: ([0], True), 5: ([0], True), 6: ([], False)}


def test_decontamination_with_words_put_in_or_left_out(spark):
    item = " ".join(f"{a}{i}" for i, a in enumerate(words(random.Random(13), 38)))
    w = item.split()
    pad = " ".join(words(random.Random(14), 60))
    around = [w[:19] + ["inserted"] + w[19:], w[:19] + w[20:], w[:19] + ["a", "longer", "aside"] + w[19:], w[:6] + w[31:]]
    got = flagged(spark, [f"{pad} {' '.join(x)} {pad}" for x in around], [item, ITEM])
    assert got == {0: ([0], False), 1: ([0], False), 2: ([0], False), 3: ([], False)}
    # copies with other fills side by side, with a word put in, and a slot torn beside a literal copy of most windows
    moved = ITEM.replace("120", "480").replace("London", "Madrid").replace(" and travels", " sharp and travels")
    other = ITEM.replace("120", "77").replace("London", "Turin")
    torn = f"{ITEM} {' '.join(w[:20])}"
    half = torn.replace("London", "Oslo", 1).replace("with 120 books", "with 7 books").replace("travels 120 km", "travels 9 km")
    got = flagged(spark, [f"{pad} {moved} {pad}", f"{pad} {other} {moved} {other} {pad}", f"{pad} {half} {pad}"], [ITEM, torn])
    assert got == {0: ([0], True), 1: ([0, 1], True), 2: ([1], True)}  # other alone is 15 windows of torn's first half


def test_decontamination_of_short_items_in_long_texts(spark):
    items = ["Who wrote Moby Dick then?", "seven plain words make one window here", "Anna paid 12 euros today", "eleven"]
    pad = " ".join(words(random.Random(15), 40))
    texts = [f"{pad} {x} {pad}" for x in ("who wrote moby dick, THEN", items[1], "Anna paid 15 euros today", "Anna paid 12 euros today", "who wrote", "Eleven!")] + ["seven plain words make one window here", pad]
    assert flagged(spark, texts, items) == {0: ([0], False), 1: ([1], False), 2: ([], False), 3: ([2], False), 4: ([], False), 5: ([3], False), 6: ([1], False), 7: ([], False)}
    assert flagged(spark, [pad + " eleven", pad], ["eleven", None, ""]) == {0: ([0], False), 1: ([], False)}


def _kernel(s, t, n, lam):
    """Lodhi's kernel by its definition."""
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(s)), n):
        for j in combinations(range(len(t)), n):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += lam ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_string_kernel():
    s, t = ["^idiot$", "^i.d-iot$", "^other$", "x"], ["^idiot$", "diot", "the"]
    got = toxicity.subsequence_kernel(s, t, 3, 0.6)
    for i, a in enumerate(s):
        for j, b in enumerate(t):
            assert got[i, j] == pytest.approx(_kernel(a, b, 3, 0.6), rel=1e-4, abs=1e-7)


def sentences(ws):
    return [ws[i : i + toxicity.SENTENCE] for i in range(0, len(ws), toxicity.SENTENCE)]


def test_common_lengths():
    marks, ws = ["^idiot$", "abcab", "x" * 40, "é"], ["^i.d-iot$", "bacbab", "", "xyx", "é^", "z" * 30]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            row = [0, *(max(row[j + 1], row[j] + 1 if c == b[j] else 0) for j in range(len(b)))]
            for j in range(len(b)):
                row[j + 1] = max(row[j + 1], row[j])
        return row[-1]

    assert toxicity.CommonLengths(marks).of(ws).tolist() == [[lcs(w, m) for m in marks] for w in ws]


@pytest.fixture(scope="module")
def learned():
    rng = random.Random(9)
    bags = []
    for i in range(700):
        w = words(rng, 60)
        bad = i % 4 == 0
        if bad:
            w[3] = rng.choice(["blockhead", "nitwit", "nitwits"])
        bags.append((sentences(w), bad))
    return toxicity.fit_toxicity(bags)


def test_toxicity_learns_and_tolerates(spark, learned):
    texts = ["you nitwit", "you NITWIT", "a block-head here", "blockhe.ad", "n i t w i t is you", "kalo mine pora", None, "", " ".join(["kalo"] * 20000) + " blockhead", "b" * 500]
    got = [r.score for r in sorted(toxicity.score_toxicity(frame(spark, list(enumerate(texts))), learned).collect())]
    assert min(got[0], got[1], got[8]) >= 0.7 and min(got[2], got[3]) > got[5]
    assert max(got[5], got[6], got[7], got[9]) < 0.3 and got[6] == got[7]
    kept = toxicity.keep_clean(frame(spark, list(enumerate(texts))), learned, 0.7)
    assert {0, 1, 8}.isdisjoint({r.doc_id for r in kept.collect()}) and {5, 6, 7, 9} <= {r.doc_id for r in kept.collect()}
    assert toxicity.score_toxicity(empty(spark), learned).count() == 0


def test_toxicity_without_labels():
    m = toxicity.fit_toxicity([])
    assert 0 <= m.score(np.zeros((1, toxicity.TOP)))[0] <= 1


def test_toxicity_of_words_that_a_clean_text_holds_too():
    rng = random.Random(16)
    insults = ["blockhead", "nitwit", "dunderhead"]
    bags = [(sentences(words(rng, 60) + ([rng.choice(insults)] if i % 4 == 0 else [])), i % 4 == 0) for i in range(700)]
    m = toxicity.fit_toxicity([*bags, *((sentences(words(rng, 60) + [w]), False) for w in insults)])
    scores = toxicity._scores(m, pa.array(["you " + w for w in insults] + ["kalo mine pora", "", None]))
    assert min(scores[:3]) >= 0.7 and max(scores[3:]) < 0.3


def test_held_out_recall_and_precision(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.op2_toxicity(spark, folder).join(queries.read(spark, folder, "labels"), "doc_id").where("held_out").collect()
    caught = sum(r.predicted for r in rows if r.toxic)
    assert caught >= 0.9 * sum(1 for r in rows if r.toxic) and caught >= 0.92 * sum(r.predicted for r in rows)


def test_toxicity_of_null_and_repeated_ids_and_clashing_columns(spark, learned):
    d = spark.createDataFrame([(None, "you nitwit", "a"), (1, "you nitwit", "b"), (1, "kalo", "c"), (2, None, "d")], "doc_id long, text string, score string")
    got = toxicity.score_toxicity(d, learned).collect()
    assert Counter((r.doc_id, r.score >= 0.7) for r in got) == {(None, True): 1, (1, True): 1, (1, False): 1, (2, False): 1}
    assert sorted(r.score for r in toxicity.keep_clean(d, learned, 0.7).collect()) == ["c", "d"]
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert Counter(y for _, y in toxicity.labelled_sentences(d, labels)) == {True: 2}



def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    docs = queries.read(spark, sf, "documents")
    columns = docs.columns
    start = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    for name, stage in p.STAGES:
        before = [r.doc_id for r in kept.collect()] if name != "sharding" else None
        kept = stage(spark, kept, sf)
        if name != "sharding":
            assert kept.columns == columns
            after = [r.doc_id for r in kept.collect()]
            assert set(after) <= set(before) and after
            if name == "near_duplicates":
                want = _jaccard([(i, start[i]) for i in before], 5, 80)
                assert sorted(after) == sorted(i for i in before if want[i][1] == i)
            if name == "mixing":
                assert set(after) == set(before)
            last = after
    assert sorted(r.doc_id for r in kept.collect()) == sorted(last)


def thue_morse(n, letters="ab"):
    """Two complementary words of n letters, which every sum of powers modulo 2**64 takes for the same."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


def test_texts_that_fool_sums_of_powers(spark):
    a, b = thue_morse(1024)
    e, x = thue_morse(1024, "ex")
    lead = [f"w{i}" for i in range(49)]
    rows = [(1, a), (2, b), (3, e), (4, x), (5, " ".join([*lead, a])), (6, " ".join([*lead, b])), (7, "z" * 70), (8, "z" * 134), (9, a + "a" * 200), (10, b + "a" * 200)]
    d = frame(spark, rows)
    assert all(r.component_id == (5 if r.doc_id == 6 else r.doc_id) for r in jaccard_join.jaccard_components(d).collect())  # 47 of 49 shingles
    assert all(r.n_removed == 0 for r in substring_dedup.dedup_substrings(d).collect())
    first, gone = {}, Counter()
    for i, t in rows:
        raw = t.encode()
        for k in range(len(raw) - 99):
            first.setdefault(raw[k : k + 100], (i, k))
        gone[i] = len({k + j for k in range(len(raw) - 99) if first[raw[k : k + 100]] < (i, k) for j in range(100)})
    assert {r.doc_id: r.n_removed for r in suffix_dedup.dedup_bytes(d).collect()} == gone
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.TOKENIZER)
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_prefixes(d, path).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows}
