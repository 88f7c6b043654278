import zlib

import numpy as np
import pytest

from patronage.llm import language


@pytest.fixture(scope="module")
def model(docs):
    return language.learn(docs)


def test_predictions_equal_a_plain_loop(docs, corpus, model):
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    makers = language._compressors(model)
    for d, text, *_ in corpus:
        clean, r = language.normalised(text), got[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
            continue
        blocks = [clean[i:i + language.BLOCK_CHARS].encode()
                  for i in range(0, len(clean), language.BLOCK_CHARS)]
        used = 17 if len(clean) <= 400 else 1
        sizes = [sum(len(c.compress(b)) for c in every[:used] for b in blocks) for every in makers]
        best = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        assert r.lang_pred == model.names[best[0]]
        assert r.score == (sizes[best[1]] - sizes[best[0]]) / sizes[best[1]]
        assert r.accepted == (r.score >= 0.005) and 0 <= r.score <= 1
    kept = language.accepted_documents(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.accepted}


def test_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = language.identify(docs, language.learn(docs)).join(docs, "doc_id") \
        .filter("held_out").select("lang", "lang_pred", "accepted").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9


def test_nothing_of_the_held_out_rows_is_learned(docs, model):
    changed = docs.selectExpr("doc_id", "if(crc32(cast(doc_id AS string)) % 5 = 0, 'zzz', text) AS text",
                              "if(crc32(cast(doc_id AS string)) % 5 = 0, 'xx', lang) AS lang")
    assert language.learn(changed) == model


def test_the_sample_is_bounded(docs):
    small = language.learn(docs, texts=3, chars=50)
    assert all(len(s) <= 3 * 51 * 4 for s in small.samples)


def test_odd_rows(odd_docs, no_docs):
    model = language.learn(odd_docs)
    rows = language.identify(odd_docs, model).collect()
    assert len(rows) == 6 and all(not r.held_out for r in rows if r.doc_id is None)
    assert sum(r.lang_pred == "und" for r in rows) in (1, 6)
    nothing = language.learn(no_docs)
    assert nothing.names == ()
    assert {r.lang_pred for r in language.identify(odd_docs, nothing).collect()} == {"und"}
    assert language.identify(no_docs, model).count() == 0
    assert language.accepted_documents(odd_docs, model).columns == odd_docs.columns
