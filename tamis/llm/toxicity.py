"""Toxicity by a support vector machine over a gapped-subsequence string kernel with Nyström landmarks."""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from hashlib import sha256
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import chunks, flat_texts, in_task, word_hashes, word_spans

#: The labelled rows that are learned from: at most so many of either label, taken by the hash of their id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 3000
#: Length of the common subsequences, and what every character that they span multiplies them by.
ORDER, DECAY = 4, 0.6
#: Character sequences that the landmarks begin with, at most; their characters (with ^ and $ for a word's ends), the share
#: of toxic texts that must hold one, and the least log odds.
STEMS, SHORTEST, LONGEST, LEAST_SHARE, LEAST_ODDS = 16, 4, 9, 0.02, 2.0
#: Words of toxic and of clean labelled sentences that join each of them as landmarks, at most.
FROM_TOXIC, FROM_CLEAN = 16, 16
#: A word is no evidence of toxicity if clean texts hold it more often than so many times as often as toxic ones.
MOST_CLEAN = 0.1
#: The kernel counts as none where less than this share of a landmark is a common subsequence.
LEAST_COMMON = 0.85
#: Words of a sentence (a text is cut into stretches of so many), and sentences of a labelled text that are learned from.
SENTENCE, SAMPLE_SENTENCES = 8, 512
#: Clean sentences that a round learns from: so many spread over all, and so many of the most toxic ones by the round before.
HARD = 6000
#: A longer word is scored in overlapping pieces of so many characters.
PIECE = 32
#: Sentences of a text whose decisions make its score, and the size to which a decision counts.
TOP, CLIP = 3, 3.0
#: Words whose scores a task remembers, words and pairs of words scored at a time, and rows that leave a task at a time.
REMEMBERED, BATCH, PAIRS, ROWS = 100_000, 1024, 4096, 1000
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _padded(strings: list[str], fill: int) -> np.ndarray:
    width = max(map(len, strings), default=1) or 1
    raw = "".join(s.ljust(width, "\0") for s in strings).encode("utf-32-le", "surrogatepass")
    out = np.frombuffer(raw, np.uint32).astype(np.int64).reshape(len(strings), width)
    out[out == 0] = fill
    return out


def pair_kernel(x: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """For every pair of rows (characters, below 0 beyond the word's end): the common subsequences of `order` characters,
    each weighed by decay to the power of the characters it spans in both. Gaps and inserted characters lower a match,
    they do not end it."""
    square, fall = np.float32(decay * decay), np.float32(decay)
    width = t.shape[1]
    # so[i][:, j]: common subsequences of i characters in what was read of the word and the mark's first j
    so = [np.full((len(x), width + 1), i == 0, np.float32) for i in range(order)]
    k = np.zeros(len(x), np.float32)
    for c in range(x.shape[1]):
        same = (x[:, c, None] == t) * square
        k += (same * so[order - 1][:, :-1]).sum(axis=1)
        for i in range(order - 1, 0, -1):
            gain = same * so[i - 1][:, :-1]
            for j in range(1, width):
                gain[:, j] += fall * gain[:, j - 1]
            so[i] *= fall
            so[i][:, 1:] += gain
    return k


def kernel_of(words: list[str], marks: list[str], at: np.ndarray, mark: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """pair_kernel of the words and marks at the given places."""
    out = np.zeros(len(at), np.float32)
    used, at = np.unique(at, return_inverse=True)
    words = [words[i] for i in used.tolist()]
    m_size, w_size = np.array([len(m) for m in marks], np.int64), np.array([len(w) for w in words], np.int64)
    t, x = _padded(marks, -2).astype(np.int32), _padded(words, -1).astype(np.int32)
    by_size = np.lexsort((w_size[at], m_size[mark]))
    for a in range(0, len(at), PAIRS):
        i = by_size[a : a + PAIRS]
        out[i] = pair_kernel(x[at[i], : w_size[at[i]].max()], t[mark[i], : m_size[mark[i]].max()], order, decay)
    return out


def subsequence_kernel(words: list[str], marks: list[str], order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The kernel of every word with every mark."""
    at, mark = np.divmod(np.arange(len(words) * len(marks)), max(1, len(marks)))
    return kernel_of(words, marks, at, mark, order, decay).reshape(len(words), len(marks))


class CommonLengths:
    """Which words have how long a common subsequence with which marks: the marks stand side by side in 64-bit rows, a
    bit a character and one between, and every character of a word moves all of them on by one addition."""

    def __init__(self, marks: list[str]):
        self.letters = {c: i + 1 for i, c in enumerate(sorted({c for m in marks for c in m}))}
        self.row, self.shift, at, row = [], [], 0, 0
        for m in marks:
            if at + len(m) + 1 > 64:
                at, row = 0, row + 1
            self.row.append(row)
            self.shift.append(at)
            at += len(m) + 1
        self.bits = np.zeros((len(self.letters) + 1, row + 1), np.uint64)
        self.field = np.zeros(row + 1, np.uint64)
        self.masks = np.array([(1 << len(m)) - 1 for m in marks], np.uint64)
        for m, r, at in zip(marks, self.row, self.shift):
            for j, c in enumerate(m):
                self.bits[self.letters[c], r] |= np.uint64(1 << (at + j))
                self.field[r] |= np.uint64(1 << (at + j))
        self.row, self.shift = np.array(self.row, np.int64), np.array(self.shift, np.uint64)
        most = max(map(ord, self.letters), default=0) + 1
        self.code = np.zeros(most + 1, np.int64)
        for c, i in self.letters.items():
            self.code[ord(c)] = i

    def of(self, words: list[str]) -> np.ndarray:
        x = _padded(words, len(self.code) - 1)
        x = self.code[np.minimum(x, len(self.code) - 1)]
        v = np.broadcast_to(self.field, (len(words), len(self.field))).copy()
        for c in range(x.shape[1]):
            u = v & self.bits[x[:, c]]
            v = ((v + u) | (v ^ u)) & self.field
        return np.bitwise_count(~(v[:, self.row] >> self.shift) & self.masks)


def units_of(word: str) -> list[str]:
    """A word in lower case between its end marks; long words in overlapping pieces."""
    marked = f"^{word.lower()}$"
    if len(marked) <= PIECE:
        return [marked]
    return [marked[i : i + PIECE] for i in range(0, len(marked) - PIECE // 2, PIECE // 2)]


@dataclass
class ToxicityModel:
    """Landmarks, the weight of each one's kernel value in a sentence's decision, and the calibrations of a text's TOP
    largest decisions to a score: alone, and beside the logarithms of how many sentences the text has and how many of them
    the machine calls toxic, as among more sentences the largest decision is larger by chance."""

    marks: list[str]
    weights: np.ndarray
    bias: float
    slope: tuple[float, ...]
    offset: float
    sized: tuple[float, ...] = ()

    def values(self, words: list[str]) -> np.ndarray:
        """What each word adds to the decision of its sentence; of a long word, its most toxic piece."""
        if not self.marks or not words:
            return np.zeros(len(words))
        at, mark, k = near_landmarks(words, self.marks)
        return _most_toxic_piece(at, k * self.weights[mark], len(words))

    def score(self, decisions: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """decisions: one row of TOP values for each text, the largest first; sizes: its sentences, and those called toxic.
        The larger of the two calibrations counts; that with the sizes only where some sentence is called toxic."""
        d = np.clip(decisions, -CLIP, CLIP)
        z = d @ np.array(self.slope) + self.offset
        if self.sized and sizes is not None:
            z = np.where(sizes[:, 1] > 0, np.maximum(z, np.hstack([d, np.log1p(sizes)]) @ np.array(self.sized[:-1]) + self.sized[-1]), z)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def near_landmarks(words: list[str], marks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word and piece, mark, kernel) where enough of the mark is a common subsequence; a word's pieces are told by halves:
    entry 0 is the word's place, entry 1 the piece."""
    units, owner, piece = [], [], []
    for i, w in enumerate(words):
        for j, u in enumerate(units_of(w)):
            units.append(u)
            owner.append(i)
            piece.append(j)
    lengths, need = CommonLengths(marks), np.array([max(ORDER, int(np.ceil(LEAST_COMMON * len(m)))) for m in marks])
    order = sorted(range(len(units)), key=lambda i: len(units[i]))
    unit, mark = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(order), BATCH):
        part = np.array(order[a : a + BATCH])
        x, y = np.nonzero(lengths.of([units[i] for i in part]) >= need)
        unit.append(part[x])
        mark.append(y)
    unit, mark = np.concatenate(unit), np.concatenate(mark)
    k = kernel_of(units, marks, unit, mark)
    return np.stack([np.array(owner, np.int64)[unit], np.array(piece, np.int64)[unit]]), mark, k


def _most_toxic_piece(at: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    if not len(value):
        return out
    order = np.lexsort((at[1], at[0]))
    word, piece, value = at[0][order], at[1][order], value[order]
    new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (piece[1:] != piece[:-1])]))
    sums = np.add.reduceat(value, new)
    best = np.full(n, -np.inf)
    np.maximum.at(best, word[new], sums)
    out[np.isfinite(best)] = best[np.isfinite(best)]
    return out


def _grams(word: str, size: int) -> set[str]:
    return {u[i : i + size] for u in units_of(word) for i in range(len(u) - size + 1)}


@dataclass
class Evidence:
    """In how many toxic and clean texts each word stands, and how many texts there are of either kind."""

    bad: Counter
    good: Counter
    toxic: int
    clean: int

    def usual(self) -> set[str]:
        """Words of clean texts that are no evidence: those which toxic texts do not hold far more often."""
        return {w for w, times in self.good.items() if times * self.toxic > MOST_CLEAN * self.bad[w] * self.clean}


def _stems(seen: Evidence, usual: set[str]) -> list[str]:
    """Character sequences that mark toxic texts, most telling first; words that one explains count no further."""
    bad = {w: times for w, times in seen.bad.items() if w not in usual}
    least = max(3, LEAST_SHARE * seen.toxic)
    # a sequence is counted only if both that are one character shorter are frequent, which keeps the counts few
    p: dict[str, int] = {}
    for size in range(SHORTEST, LONGEST + 1):
        level: Counter = Counter()
        for word, times in bad.items():
            for g in _grams(word, size):
                if size == SHORTEST or (g[:-1] in p and g[1:] in p):
                    level[g] += times
        p |= {g: times for g, times in level.items() if times >= least}
    n = dict.fromkeys(p, 0)

    def held(word):
        return [g for size in range(SHORTEST, LONGEST + 1) for g in _grams(word, size) if g in p]

    for word, times in seen.good.items():
        for g in held(word):
            n[g] += times

    def odds(g):
        return np.log((p[g] + 0.5) / (seen.toxic + 1)) - np.log((n[g] + 0.5) / (seen.clean + 1))

    out: list[str] = []
    while len(out) < STEMS:
        left = [g for g in n if p[g] >= least and odds(g) >= LEAST_ODDS]
        if not left:
            break
        top = max(left, key=lambda g: (odds(g) * np.sqrt(p[g]), len(g), g))
        # the longest sequence around it that is about as frequent says more
        top = max((g for g in left if top in g and p[g] >= 0.9 * p[top]), key=lambda g: (len(g), p[g], g))
        out.append(top)
        for word in [w for w in bad if any(top in u for u in units_of(w))]:
            for g in held(word):
                p[g] -= bad[word]
            del bad[word]
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1e4, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss: Newton steps over the examples inside the margin, some rows at a time."""
    size = x.shape[1] + 1
    keep = np.eye(size)
    keep[-1, -1] = 1e-6
    w, before = np.zeros(size), None
    for _ in range(rounds):
        inside, left, right = np.zeros(len(x), bool), keep.copy(), np.zeros(size)
        for a in range(0, len(x), BATCH):
            z = np.hstack([x[a : a + BATCH], np.ones((len(x[a : a + BATCH]), 1))])
            at = y[a : a + BATCH] * (z @ w) < 1
            part = z[at] * (2 * c * weight[a : a + BATCH][at])[:, None]
            left += part.T @ z[at]
            right += part.T @ y[a : a + BATCH][at]
            inside[a : a + BATCH] = at
        if before is not None and np.array_equal(inside, before):
            break
        before, w = inside, np.linalg.solve(left, right)
    return w[:-1], float(w[-1])


def _with_insertions(words: list[str], most: int = 400) -> list[str]:
    """Each word with one character put in, at a place and of a kind that go by its number."""
    return [w[: 1 + i % max(1, len(w) - 1)] + ".-*_"[i % 4] + w[1 + i % max(1, len(w) - 1) :] for i, w in enumerate(words[:most]) if len(w) > 3]


def _landmarks(stems: list[str], bad: Counter, usual: set[str]) -> list[str]:
    """The stems, words of toxic sentences that hold them, and the words of clean sentences that are nearest to them."""
    out = dict.fromkeys(stems)
    for stem in stems:
        own = [w for w in bad if w not in usual and any(stem in u for u in units_of(w))]
        out.update(dict.fromkeys(units_of(w)[0] for w in sorted(own, key=lambda w: (-bad[w], w))[:FROM_TOXIC]))
    near = sorted(w for w in usual if len(w) < PIECE - 1)
    at, mark, k = near_landmarks(near, stems)
    for j in range(len(stems)):
        own = np.flatnonzero(mark == j)
        for i in own[np.lexsort((at[0][own], -k[own]))][:FROM_CLEAN]:
            out[units_of(near[at[0][i]])[0]] = None
    return list(out)


def fit_toxicity(texts: list[tuple[list[list[str]], bool]], rounds: int = 2, c: float = 1e4) -> ToxicityModel:
    """Learn from (sentences, toxic) of labelled texts; a sentence is a list of words.

    The examples are sentences: a sentence's kernel with a landmark is the sum over its words, and its coordinates are
    Nyström's. As sentences are not labelled one by one, each toxic text is a bag whose best sentence speaks for it: those
    with a word that holds a stem begin as toxic ones, after each round every toxic text's best sentence joins them.
    """
    seen, digests, bags = Evidence(Counter(), Counter(), 0, 0), set(), []
    for sentences, label in texts:
        own = {w for s in sentences for w in s}
        digest = (sha256(" ".join(sorted(own)).encode()).digest(), label)
        if digest not in digests:  # texts of the same words count once
            digests.add(digest)
            bags.append((sentences, label))
            (seen.bad if label else seen.good).update(own)
    y = np.array([t for _, t in bags], bool)
    seen.toxic, seen.clean = int(y.sum()), int((~y).sum())
    usual = seen.usual()
    stems = _stems(seen, usual) if seen.toxic and seen.clean else []
    share = seen.toxic / max(1, len(bags))
    if not stems:
        return ToxicityModel([], np.zeros(0), 0.0, (0.0,) * TOP, float(np.log((share + 0.01) / (1.01 - share))))
    marks = _landmarks(stems, seen.bad, usual)
    gram = subsequence_kernel(marks, marks).astype(np.float64)
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-9))
    unit = gram * scale[:, None] * scale
    values, vectors = np.linalg.eigh((unit + unit.T) / 2)
    # Nyström: with unit landmarks, k(x) @ root are the coordinates of x; they are brought to the size of a whole match
    root = (scale[:, None] * (vectors @ np.diag(np.maximum(values, 1e-2) ** -0.5) @ vectors.T)) * float(np.median(1 / scale))
    words = sorted({*seen.bad, *seen.good})
    place = {w: i for i, w in enumerate(words)}
    at, mark, k = near_landmarks(words, marks)
    first = at[1] == 0  # a long word's later pieces are scored, not learned from
    near = defaultdict(list)
    for i, e in zip(at[0][first].tolist(), np.flatnonzero(first).tolist()):
        near[i].append(e)
    positive = {i for i in near if words[i] not in usual and any(m in u for u in units_of(words[i]) for m in stems)}
    # sentences that touch no landmark are all alike; one row without entries stands for them
    row, entry, text, begins = [], [], [-1], [False]
    for b, (sentences, _) in enumerate(bags):
        for s in sentences:
            own = [i for w in s if (i := place[w]) in near]
            if own:
                new = [e for i in own for e in near[i]]
                row += [len(text)] * len(new)
                entry += new
                text.append(b)
                begins.append(bool(y[b]) and any(i in positive for i in own))
    row, entry = np.array(row, np.int64), np.array(entry, np.int64)
    mark, k, text, begins = mark[entry], k[entry], np.array(text), np.array(begins)

    def coordinates(rows):
        x, at = np.zeros((len(rows), len(marks)), np.float32), np.full(len(text), -1, np.int64)
        at[rows] = np.arange(len(rows))
        own = at[row] >= 0
        np.add.at(x, (at[row[own]], mark[own]), k[own])
        return x @ root.astype(np.float32)

    # insults with a character put in are learned from as well
    put = _with_insertions([words[i] for i in sorted(positive)])
    gapped = np.zeros((len(put), len(marks)), np.float32)
    g_at, g_mark, g_k = near_landmarks(put, marks)
    np.add.at(gapped, (g_at[0], g_mark), g_k)
    gapped = gapped @ root.astype(np.float32)
    negative = np.flatnonzero((text < 0) | ~y[np.maximum(text, 0)])
    nearest = np.bincount(row, k / np.diag(gram)[mark], len(text))
    used = np.union1d(negative[:: max(1, len(negative) // HARD)], negative[np.argsort(-nearest[negative])][:HARD])
    for _ in range(rounds):
        own = np.concatenate([np.flatnonzero(begins), used])
        sign = np.concatenate([np.ones(begins.sum()), -np.ones(len(used)), np.ones(len(gapped))])
        weight = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / len(used))
        w, bias = _svm(np.vstack([coordinates(own), gapped]), sign, weight, c)
        weights = root @ w
        decision = np.bincount(row, k * weights[mark], len(text)) + bias
        used = np.union1d(used, negative[np.argsort(-decision[negative])][:HARD])
        best = np.full(len(bags), -np.inf)
        np.maximum.at(best, text[1:], decision[1:])
        begins[1:] |= (decision[1:] > 0) & (decision[1:] == best[text[1:]]) & y[text[1:]]
    d, sizes = np.full((len(bags), TOP), bias), np.zeros((len(bags), 2))
    by_text = defaultdict(list)
    for b, v in zip(text[1:].tolist(), decision[1:].tolist()):
        by_text[b].append(v)
    for b, (sentences, _) in enumerate(bags):
        top = sorted([*by_text[b], *[bias] * min(TOP, len(sentences) - len(by_text[b]))], reverse=True)[:TOP]
        d[b, : len(top)] = top
        sizes[b] = len(sentences), sum(v > 0 for v in by_text[b])
    label = y.astype(float)
    *slope, offset = _rising(np.clip(d, -CLIP, CLIP), label)
    return ToxicityModel(marks, weights, bias, tuple(slope), offset, _rising(np.hstack([np.clip(d, -CLIP, CLIP), np.log1p(sizes)]), label))


def _logistic(d: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and offset of the logistic fit of the label on the decisions, with Platt's softened targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    z = np.hstack([d, np.ones((len(d), 1))])
    ridge = np.diag([1e-2] * d.shape[1] + [0])
    w = np.array([1.0 / max(1, d.shape[1])] * d.shape[1] + [0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w)), z.T @ (p - target) + ridge @ w)
        w = w - move * min(1.0, 5 / (np.abs(move).max() + 1e-9))
        if np.abs(move).max() < 1e-6:
            break
    return w


def _rising(d: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """The fit in which none of the first TOP weights is negative: columns that would have one are left out of it."""
    used = np.arange(d.shape[1])
    while True:
        w = _logistic(d[:, used], y)
        falls = (w[:-1] < 0) & (used < TOP)
        if not falls.any():
            out = np.zeros(d.shape[1] + 1)
            out[[*used, -1]] = w
            return tuple(out.tolist())
        used = used[~falls]


def _single_letters(data, starts, ends, bounds) -> list[tuple[int, str]]:
    """(text, word) of runs of four or more one-letter words, which spell a word with blanks between."""
    lone = (ends - starts) == 1
    if not lone.any():
        return []
    edge = np.zeros(len(lone) + 1, bool)
    edge[bounds] = True
    new = lone & np.concatenate([[True], ~lone[:-1] | edge[1:-1]])
    stop = lone & np.concatenate([~lone[1:] | edge[1:-1], [True]])
    a, b = np.flatnonzero(new), np.flatnonzero(stop) + 1
    long = b - a >= 4
    return [(int(np.searchsorted(bounds, i, side="right") - 1), data[starts[i:j]].tobytes().decode("utf-8", "replace")) for i, j in zip(a[long], b[long])]


def sentences_of(column):
    """(texts' bounds in words, words' bytes, starts, ends) of an Arrow string column a few MB at a time, without A-Z."""
    data, offsets = flat_texts(column)
    for a, b in chunks(offsets, 4 << 20):
        part = _FOLD[data[offsets[a] : offsets[b]]]
        starts, ends, bounds = word_spans(part, offsets[a : b + 1] - offsets[a])
        yield a, b, part, starts, ends, bounds


def labelled_sentences(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[list[list[str]], bool]]:
    """(sentences, toxic) of the labelled sample; an id that labels repeat counts once, rows of docs that repeat it count each.

    At most SAMPLE_TOXIC and SAMPLE_CLEAN ids by the hash of the id, and of each text at most SAMPLE_SENTENCES sentences by
    the hash of their words; null ids, null labels and null texts are left out.
    """
    given = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("l_id"), (F.col(label_col) > 0).alias("l_toxic"), F.xxhash64(id_col).alias("o"))
    given = given.groupBy("l_id", "o").agg(F.max("l_toxic").alias("l_toxic"))
    parts = [given.where(kind).orderBy("o", "l_id").limit(most) for kind, most in (("l_toxic", SAMPLE_TOXIC), ("not l_toxic", SAMPLE_CLEAN))]
    sample = F.broadcast(parts[0].union(parts[1]))  # SAMPLE_TOXIC + SAMPLE_CLEAN rows at most

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, part, starts, ends, bounds in sentences_of(batch.column(1)):
                raw, out = part.tobytes(), []
                for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = [b" ".join(raw[starts[i] : ends[i]] for i in range(j, min(j + SENTENCE, hi))) for j in range(lo, hi, SENTENCE)]
                    if len(own) > SAMPLE_SENTENCES:
                        own = sorted(own, key=lambda s: crc32(s))[:SAMPLE_SENTENCES]
                    out.append([s.decode("utf-8", "replace") for s in own])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out, pa.list_(pa.string()))], names=["toxic", "sentences"])

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("d_id"), F.col(text_col).cast("string").alias("x")).join(sample, F.col("d_id") == F.col("l_id")).select("l_toxic", "x")
    table = rows.mapInArrow(in_task(cut), "toxic boolean, sentences array<string>").toArrow()
    one: dict[str, str] = {}  # a word is held once
    found = ((t.as_py(), bool(y.as_py())) for t, y in zip(table["sentences"], table["toxic"]))
    return sorted(([[one.setdefault(w, w) for w in s.split(" ")] for s in t], y) for t, y in found)


def _scores(m: ToxicityModel, column, known: dict | None = None) -> np.ndarray:
    """Scores of an Arrow string column; known remembers the values of words while a task runs."""
    known = {} if known is None else known
    out, sizes = np.full((len(column), TOP), m.bias), np.zeros((len(column), 2))
    for a, b, part, starts, ends, bounds in sentences_of(column):
        hashes, first, back = np.unique(word_hashes(part, starts, ends), return_index=True, return_inverse=True)
        value = np.array([known.get(h, np.nan) for h in hashes.tolist()]) if len(hashes) else np.zeros(0)
        miss = np.flatnonzero(np.isnan(value))
        raw = part.tobytes()
        for c in range(0, len(miss), 64 * BATCH):
            j = miss[c : c + 64 * BATCH]
            value[j] = m.values([raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in first[j].tolist()])
        if len(known) > REMEMBERED:
            known.clear()
        known.update(zip(hashes[miss].tolist(), value[miss].tolist()))
        # the sentences' decisions, the most toxic of a text first
        words = np.diff(bounds)
        count = -(-words // SENTENCE)
        if not count.sum():
            continue
        text = np.repeat(np.arange(b - a), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        decision = np.add.reduceat(value[back], bounds[text] + nth * SENTENCE) + m.bias
        extra = _single_letters(part, starts, ends, bounds)
        if extra:
            text = np.append(text, [i for i, _ in extra])
            decision = np.append(decision, m.values([w for _, w in extra]) + m.bias)
        sizes[a:b, 0] = count
        sizes[a:b, 1] = np.bincount(text[decision > 0], minlength=b - a)
        order = np.lexsort((-decision, text))
        text, decision = text[order], decision[order]
        rank = np.arange(len(text)) - np.searchsorted(text, text)
        top = rank < TOP
        out[a + text[top], rank[top]] = decision[top]
    return m.score(out, sizes)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id and score in [0, 1], that of the text's TOP most toxic sentences, gapped or inserted characters and
    letters set apart by blanks included. Null and empty texts score as one sentence without evidence; ids are only passed
    on, null and repeated ones as well, and every row is scored by itself. Other columns are not carried."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        known: dict = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(sent.value, batch.column(1), known))], names=["id", "score"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(in_task(run), f"`{id_col}` {kind}, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text scores at least threshold; all columns are kept, whatever their names, and no row
    moves. Null and empty texts stay (unless the threshold is below the score of no evidence); rows with null or repeated ids
    are judged one by one; an empty table stays empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        known: dict = {}
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                yield part.filter(pa.array(_scores(sent.value, part.column(at).cast(pa.string()), known) < threshold))

    return docs.mapInArrow(in_task(run), docs.schema)
