import hashlib
import re

import pytest

from patronage.llm import decontaminate

UPPER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute_force(docs, items, window):
    patterns = {}
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            patterns.setdefault(tuple(w[i:i + n]), set()).add(name)
    out = {}
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(p) for p in patterns}:
            for i in range(len(w) - n + 1):
                names = patterns.get(tuple(w[i:i + n]))
                if names:
                    found |= names
                    hit.update(range(i, i + n))
        names = sorted(str(x) for x in found if x is not None)
        out[d] = (len(w), len(hit), len(names),
                  hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
    return out


@pytest.fixture(scope="module")
def items(corpus):
    texts = {r[0]: r[1] for r in corpus}

    def cut(d, a, b):
        return " ".join(words(texts[d])[a:b])
    return [(1, cut(0, 5, 25)), (2, cut(1, 0, 10)), (3, cut(2, 3, 9)), (30, "the"),
            (4, "Two, WORDS!"), (5, None), (6, " ... "), (None, cut(4, 2, 16)),
            (2, cut(6, 1, 14)), (7, cut(7, 0, 12).upper()), (8, "never in any text at all, not once")]


@pytest.mark.parametrize("window", [10, 3, 1])
@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_equals_brute_force(spark, docs, corpus, items, window, block_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate, "PATTERN_BYTES", block_bytes)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
           for r in decontaminate.contamination(docs, benchmark, window=window).collect()}
    want = brute_force([(r[0], r[1]) for r in corpus], items, window)
    assert got == want and any(w[4] for w in want.values())
    kept = decontaminate.clean_documents(docs, benchmark, window=window)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, w in want.items() if not w[4]}


def test_odd_rows(spark, odd_docs, no_docs):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    full = spark.createDataFrame([(1, "beta gamma")], "item_id bigint, text string")
    rows = decontaminate.contamination(odd_docs, full).collect()
    assert len(rows) == 6 and sum(r.contaminated for r in rows) == 4
    assert not any(r.contaminated for r in decontaminate.contamination(odd_docs, empty).collect())
    assert decontaminate.clean_documents(odd_docs, empty).count() == 6
    assert decontaminate.contamination(no_docs, full).count() == 0
    assert decontaminate.clean_documents(odd_docs, full).columns == odd_docs.columns
