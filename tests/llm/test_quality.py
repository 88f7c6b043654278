import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patronage.llm import quality
from patronage.llm.queries import GRADE


def test_thresholds_are_ordered_and_recover_a_known_model():
    pick = np.random.default_rng(4)
    n, m = 3000, 40
    truth = pick.normal(0, 1.2, m)
    x = pick.random((n, m)) < 0.3
    noise = np.log(1 / pick.random(n) - 1)
    grades = np.searchsorted([-1.0, 1.5], x @ truth + noise)
    flat = np.concatenate([np.flatnonzero(r) for r in x])
    bounds = np.concatenate([[0], np.cumsum(x.sum(1))])
    fit = quality.fit_grades(flat, bounds, grades, 3, epochs=40, rate=0.02, decay=1e-5)
    assert np.all(np.diff(fit.thresholds) > 0)
    assert np.corrcoef(fit.weights[:m], truth)[0, 1] > 0.95
    below = fit.at_most(x @ fit.weights[:m])
    for k in range(2):  # calibrated on the whole
        assert below[:, k].mean() == pytest.approx((grades <= k).mean(), abs=0.03)


def test_features_do_not_depend_on_neighbours(corpus):
    texts = [r[1] for r in corpus]

    def of(some):
        out = []
        for flat, at in quality.features(pa.array(some, pa.string())):
            out += [flat[a:b].tolist() for a, b in zip(at, at[1:])]
        return out
    together = of(texts)
    assert together == [of([t])[0] for t in texts]
    assert all(len(f) >= 4 and f == sorted(set(f)) for f in together)


def test_grades_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    grader = quality.learn(docs, labels, grade=F.expr(GRADE))
    again = quality.learn(docs.repartition(3), labels, grade=F.expr(GRADE))
    assert np.allclose(grader.weights, again.weights)
    rows = (quality.grade_documents(docs, grader).join(labels, "doc_id")
            .filter("crc32(cast(doc_id AS string)) % 5 = 0")
            .withColumn("grade", F.expr(GRADE)).collect())
    good = [r.p_tail for r in rows if r.grade == 2]
    assert np.mean([r.keep for r in rows if r.grade == 2]) > 0.95
    for other in (0, 1):
        bad = [r.p_tail for r in rows if r.grade == other]
        assert np.mean([a > b for a in good for b in bad]) > 0.85
    assert all(0 <= r.p_tail <= 1 and 0 <= r.expected_grade <= 2 for r in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 2), (1, 0), (2, None), (None, 1), (9, 7)],
                                   "doc_id bigint, grade int")
    grader = quality.learn(odd_docs, labels)
    rows = quality.grade_documents(odd_docs, grader).collect()
    assert len(rows) == 6 and all(0 <= r.p_tail <= 1 for r in rows)
    nothing = quality.learn(no_docs, labels.limit(0))
    assert np.allclose(nothing.at_most(np.zeros(1)), [[1 / 3, 2 / 3]])
    assert quality.grade_documents(no_docs, grader).count() == 0
