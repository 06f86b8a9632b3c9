import random

import numpy as np
import pytest

from pairweave.llm import neardup as N
from pairweave.llm.hashing import shingles


def exact(texts, k, percent):
    """Smallest id reachable by links between full shingle sets, by brute force."""

    def words(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\v\f\r":
            t = t.replace(c, " ")
        w = [x for x in t.split(" ") if x]
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    ids = sorted(texts)
    sets = {i: words(texts[i]) for i in ids}
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(seed, n, edits):
    """Copies of one text with random words replaced, chains of edits, and strangers."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    base = [word() for _ in range(60)]
    texts, chain = {}, list(base)
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = word()
        texts[i] = " ".join(w)
        chain = list(chain)
        chain[rng.randrange(len(chain))] = word()
        texts[1000 + i] = " ".join(chain)
        texts[2000 + i] = " ".join(word() for _ in range(rng.randint(0, 30)))
    texts[3000], texts[3001], texts[3002] = "One", "one", " \t "
    return texts


@pytest.mark.parametrize(("seed", "edits", "k"), [(1, 4, 2), (2, 8, 2), (3, 6, 5)])
def test_equals_brute_force(spark, seed, edits, k):
    texts = family(seed, 40, edits)
    got = N.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == exact(texts, k, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_open_buckets_lose_no_link(spark):
    """Pivots that only some members reach: all links come from the set differences."""
    texts = family(5, 60, 10)
    got = N.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 2, 80, bands=40, rows=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == exact(texts, 2, 80)


def test_sketch():
    rng = np.random.default_rng(1)
    for n in (1, 3, 50, 5000):
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        x = N.fast_similarity_sketch(s, 240)
        assert (x != N._EMPTY).all() and (x == N.fast_similarity_sketch(s[::-1].copy(), 240)).all()
    same = []
    for seed in range(60):
        rng = np.random.default_rng(seed)
        u = np.unique(rng.integers(0, 2**63, 90).astype(np.uint64))
        same.append((N.fast_similarity_sketch(u[:70], 240) == N.fast_similarity_sketch(u[20:], 240)).mean())
    assert abs(np.mean(same) - 50 / 90) < 0.02  # agreement estimates the similarity


def test_words_are_ascii_lowered():
    assert (shingles("AB cd", 2) == shingles("ab\x0bCD", 2)).all() and (shingles("É x", 2) != shingles("é x", 2)).all()
    assert len(shingles("a\xa0b", 1)) == 1 and not len(shingles(None, 2)) and not len(shingles("", 2))


def test_edges(odd, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(odd, 2, 80).collect()), key=str)
    assert got == sorted([(1, 8, 1, True), (1, 8, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (None, 6, None, True), (5, 1, 5, True), (6, 3, 6, True), (7, 8, 1, False)], key=str)
    assert N.near_duplicates(none).count() == 0
    kept = N.keep_one_of_each(odd, 2)
    assert kept.columns == odd.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == [1, 2, 3, 4, 5, 6, None]
    assert N.keep_one_of_each(none).count() == 0
