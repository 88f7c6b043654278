import hashlib
import re
from collections import defaultdict

import pytest

from patronage.llm import mixing


def brute_force(rows, weights=(5, 2, 1), most=3):
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in rows}
    members = defaultdict(list)
    for d, _, _, source, *_ in rows:
        members[source].append(d)
    names = sorted(members, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = {s: sum(size[d] for d in members[s]) for s in names}
    open_, target, left = set(names), {}, sum(total.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = most * total[s]
            left -= target[s]
        open_ -= over
    out = {}
    for s in names:
        budget = round(target[s])
        passes = budget // total[s] if total[s] else 0
        rest, begin = budget - passes * total[s], 0

        def key(d):
            return int(hashlib.md5(f"{d}:17".encode()).hexdigest()[:15], 16), d
        for d in sorted(members[s], key=key):
            out[d] = (size[d], total[s], target[s],
                      passes * size[d] + max(0, min(rest - begin, size[d])))
            begin += size[d]
    return out


def test_mix_equals_brute_force(docs, corpus):
    want = brute_force(corpus)
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert got.keys() == want.keys()
    for d, (size, total, target, taken) in want.items():
        assert (got[d].size, got[d].source_size, got[d].taken) == (size, total, taken)
        assert got[d].target == pytest.approx(target)
        assert got[d].taken <= 3 * size


def test_reruns_agree(docs):
    first = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(3)).collect()}
    assert first == {(r.doc_id, r.taken) for r in mixing.mix(docs).collect()}


def test_mixed_documents_are_whole_and_near_their_targets(docs, corpus):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    texts = {d: t for d, t, *_ in corpus}
    words, largest = defaultdict(int), defaultdict(int)
    want = brute_force(corpus)
    source = {d: s for d, _, _, s, *_ in corpus}
    for d, s in source.items():
        largest[s] = max(largest[s], want[d][0])
    for r in out.collect():
        assert r.text == texts[r.doc_id]
        words[r.source] += want[r.doc_id][0]
    for s in set(source.values()):
        target = next(want[d][2] for d in source if source[d] == s)
        assert abs(words[s] - target) <= largest[s] / 2 + 1


def test_weights_by_name_leave_others_out(docs):
    rows = mixing.mix(docs, weights={"a": 1.0, "b": 3.0}, share=0.1).collect()
    assert sum(r.taken for r in rows if r.source not in ("a", "b")) == 0
    assert sum(r.taken for r in rows if r.source == "b") > 0


def test_odd_rows(odd_docs, no_docs):
    assert mixing.mix(odd_docs).count() == 6
    assert mixing.mixed_documents(odd_docs).columns == odd_docs.columns
    assert mixing.mixed_documents(odd_docs).filter("text is null").count() == 0
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
