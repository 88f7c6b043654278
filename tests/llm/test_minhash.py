import re

import numpy as np
import pytest

from patronage.llm import minhash

UPPER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def brute_force(rows, size, percent):
    sets = {d: shingles(t, size) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_equals_brute_force(docs, corpus, size, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept)
           for r in minhash.near_duplicates(docs, shingle=size, percent=percent).collect()}
    assert got == brute_force([(r[0], r[1]) for r in corpus], size, percent)


def test_many_small_chunks_give_the_same(docs, corpus, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK_TEXTS", 4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept)
           for r in minhash.near_duplicates(docs, shingle=3, percent=85).collect()}
    assert got == brute_force([(r[0], r[1]) for r in corpus], 3, 85)


def test_odd_rows(odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs, shingle=3, percent=85).collect()
    assert len(rows) == 6
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert {r.component_id for r in rows if r.doc_id == 1} == {1}
    assert 1 in {r.component_id for r in rows if r.doc_id == 2}
    assert minhash.near_duplicates(no_docs).count() == 0


def test_pairs_below_the_threshold_are_not_compared(monkeypatch):
    """Collisions decide which sets are looked at; a pair needs both counts."""
    pick = np.random.default_rng(3)
    sets = [np.unique(pick.integers(0, 400, 300).astype(np.uint64)) for _ in range(12)]
    sets += [np.delete(s, slice(0, 9)) for s in sets[:6]]
    posts = [pick.integers(0, 3, 64).astype(np.uint64) + (np.arange(64, dtype=np.uint64) << np.uint64(32))
             for _ in range(12)]
    posts += [p.copy() for p in posts[:4]] + [p ^ np.uint64(7) for p in posts[4:6]]
    seen, counted = [], minhash._shared
    monkeypatch.setattr(minhash, "_shared", lambda a, b: seen.append((len(a), len(b))) or counted(a, b))
    got = {tuple(p) for p in minhash._similar(sets, sets, posts, posts, 50, 90).tolist()}
    meet = {(i, j) for i in range(18) for j in range(18) if (posts[i] == posts[j]).sum() >= 50}
    like = {(i, j) for i in range(18) for j in range(18) if 100 * len(np.intersect1d(sets[i], sets[j]))
            >= 90 * len(np.union1d(sets[i], sets[j]))}
    assert got == meet & like and {(i, 12 + i) for i in range(4)} <= got and (4, 16) in like - got
    assert seen == [(18, 18), (18, 18)]
    far = [p + np.uint64(10 + i) for i, p in enumerate(posts)]
    assert len(minhash._similar(sets, sets, posts, far, 50, 90)) == 0 and len(seen) == 3
