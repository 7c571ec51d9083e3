"""Jaccard join, ranked search and divergence against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from foliant.llm import divergence, impact, jaccard
from tests.llm.cases import ROWS, alike, documents

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edited(rnd, words, share):
    out = list(words)
    for _ in range(max(1, int(len(words) * share))):
        i = rnd.randrange(len(out))
        out[i : i + rnd.choice((0, 1, 1, 2))] = [f"w{rnd.randrange(10**6)}"]
    return out


def made_documents(rnd, n=120):
    """Texts of all sizes with copies, near and less near ones, one passage that many have, and chains of edits."""
    passage, rows = [f"p{i}" for i in range(40)], []
    for _ in range(n):
        kind = rnd.random()
        if not rows or kind < 0.35:
            words = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice((1, 3, 4, 7, 9, 14, 25, 60, 200, 900)))]
        else:
            words = rnd.choice(rows)
            words = edited(rnd, words, rnd.choice((0.005, 0.01, 0.02, 0.04, 0.08, 0.2))) if kind < 0.85 else list(words)
        if rnd.random() < 0.3:
            at = rnd.randrange(len(words) + 1)
            words = words[:at] + passage + words[at:]
        rows.append(words)
    return [(i, " ".join(w), "en", "a", 0) for i, w in enumerate(rows)]


def shingles(text, k=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(FOLD)) if w]
    return frozenset(" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def joined(rows, same=85):
    own = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(own):
        for j in range(i):
            both = len(a & own[j])
            if a and own[j] and 100 * both >= same * (len(a) + len(own[j]) - both):
                root[top(i)] = top(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[top(i)].append(r[0])
    least = {t: min((x for x in ids if x is not None), default=None) for t, ids in groups.items()}
    return [(r[0], len(own[i]), least[top(i)]) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("seed", "hot", "few", "first"), [(1, 8192, 1 << 18, 8), (2, 3, 0, 0), (3, 4, 1 << 18, 1), (4, 8192, 0, 0)])
def test_jaccard(spark, monkeypatch, seed, hot, few, first):
    monkeypatch.setattr(jaccard, "FIRST", first)
    rows = made_documents(random.Random(seed))
    alike(jaccard.join(documents(spark, rows), hot=hot, few=few).collect(), joined(rows))


def test_jaccard_awkward(spark):
    want = joined(ROWS)
    alike(jaccard.join(documents(spark, extra=True)).collect(), want)
    assert jaccard.join(documents(spark, [])).collect() == []
    rows = [(1, "a\x00b c d e", "", "", 0), (2, "a b c d e", "", "", 0), (3, "A\x00B\tC\nD e", "", "", 0), (4, "one", "", "", 0), (5, "ONE ", "", "", 0), (6, "", "", "", 0), (7, None, "", "", 0)]
    alike(jaccard.join(documents(spark, rows)).collect(), joined(rows))


def test_jaccard_bands():
    """Two sets that link lie in one band or two neighbouring ones and differ by no more than the lower one's bound."""
    bands = jaccard.Bands()
    for a in range(1, 400):
        for b in range(a, 100 * a // 85 + 1):
            low, high = (int(np.searchsorted(bands.edges, x, side="right")) - 1 for x in (a, b))
            assert high - low <= 1
            both = -(-85 * (a + b) // 185)
            assert a + b - 2 * both <= bands.apart[low]


def test_jaccard_bound():
    """What the bitmaps allow is never less than the overlap."""
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate((rng.choice(base, m, replace=False), rng.integers(0, 1 << 63, x).astype(np.uint64)))) for m, x in ((250, 10), (260, 5), (200, 60), (290, 0), (240, 200))]
    maps = jaccard.Maps([jaccard.bitmap(s) for s in sets], np.array([len(s) for s in sets]), 85)
    may = maps.may_link(np.arange(5), np.arange(5))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert may[i, j] or not jaccard.Bands().linked(a, b)
    assert not may[0, 4]


def ranked(rows, items, k=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    docs = [(r[0], Counter(words(r[1]))) for r in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for *_, n in docs)
    held, out = Counter(t for _, c, _ in docs for t in c), []
    for item, text in items:
        scored = []
        for place, (i, c, n) in enumerate(docs):
            m, score = 25 + 75 * n * n_docs // n_terms, 0
            for t, r in Counter(words(text)).items():
                if c[t]:
                    score += r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score:
                scored.append((-score, i is None, i, place))
        out += [(item, rank, i, -s) for rank, (s, _, i, _) in enumerate(sorted(scored)[:k], 1)]
    return out


ITEMS = [(1, "the dog eats THE bone, the old tree"), (2, None), (3, "..."), (4, "nowhere else"), (5, "le chat mange la souris"), (5, "x endoftext 12 345"), (None, "ünïcode words Ünïcode")]


@pytest.mark.parametrize(("block", "size", "entries"), [(4 << 20, 2048, 1 << 18), (4 << 20, 2, 1 << 18), (100, 3, 5)])
def test_ranked_search(spark, block, size, entries):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    got = impact.search(documents(spark, extra=True), items, block_bytes=block, docs_a_block=size, entries=entries)
    alike(got.collect(), ranked(ROWS, ITEMS))
    rows = [(i, " ".join(random.Random(i).choices("abcdefghij", k=1 + i % 40)), "", "", 0) for i in range(300)]
    asked = [(i, " ".join(random.Random(-i).choices("abcdefghijk", k=i % 7))) for i in range(1, 12)]
    got = impact.search(documents(spark, rows), spark.createDataFrame(asked, "item_id int, text string"), block_bytes=block, docs_a_block=10 * size)
    alike(got.collect(), ranked(rows, asked))


def test_ranked_search_empty(spark):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert impact.search(documents(spark, []), items).collect() == []
    assert impact.search(documents(spark), items.limit(0)).collect() == []


def test_slices():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n, n_terms, top = int(rng.integers(1, 300)), int(rng.integers(1, 6)), int(rng.choice([1, 3, 50, 10**9]))
        entries = {(int(rng.integers(n_terms)), int(rng.integers(n))): int(rng.integers(0, top + 1)) for _ in range(int(rng.integers(0, 200)))}
        term, at = (np.array([x[c] for x in entries], np.int64) for c in (0, 1))
        own = impact.Slices(term, at, np.array(list(entries.values()), np.int64), n)
        query = {int(rng.integers(n_terms + 1)): int(rng.integers(1, 9)) for _ in range(4)}
        want = [0] * n
        for (t, i), x in entries.items():
            want[i] += x * query.get(t, 0)
        for k in (1, 3, 10, 1000):
            where, scores = own.best(own.total(query), k)
            assert sorted(zip((-scores).tolist(), where.tolist(), strict=True)) == sorted((-w, i) for i, w in enumerate(want) if w)[:k]


def apart(rows, least, most):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    held, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        g = (lang or "", source or "")
        groups.add(g)
        own = Counter(words(text))
        held[g[0]].update(own.keys())
        count[g].update(own)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in held[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        total = sum((count[lang, s] for s in sources), Counter())
        rate = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: rate(count[lang, s]) for s in sources}, rate(total)
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(pairs, 1)]
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:most]
            out += [(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(terms, 1)]
    return out


@pytest.mark.parametrize(("least", "tile", "held"), [(2, 256, 1 << 18), (1, 2, 5), (3, 3, 1)])
def test_divergence(spark, monkeypatch, least, tile, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rnd = random.Random(least)
    rows = [(i, " ".join(rnd.choices(["alpha", "Beta", "éclair", "delta9", "x-y", "ZETA", f"only{i % 5}"], k=rnd.randrange(0, 30))), rnd.choice(["en", "fr", None]), rnd.choice([None, "", "s1", "s2", "S3", "ü", "s5", "s6"]), 0) for i in range(90)]
    alike(divergence.divergence(documents(spark, rows, extra=True), least=least, most=3, tile=tile).collect(), apart(rows, least, 3))
    alike(divergence.divergence(documents(spark), least=least, tile=tile).collect(), apart(ROWS, least, 50))


def test_divergence_empty(spark):
    assert divergence.divergence(documents(spark, [])).collect() == []
    alike(divergence.divergence(documents(spark, [(1, "a b", "en", "x", 0), (2, None, "en", "y", 0)])).collect(), [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)])
