import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from patronage.llm import neighbours, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def clustered(n, dims=24, seed=3):
    pick = np.random.default_rng(seed)
    middles = pick.normal(size=(12, dims))
    at = pick.integers(0, 12, n)
    return (middles[at] + 0.6 * pick.normal(size=(n, dims))).astype(np.float32)


def brute_force(rows, every=50, k=5):
    """(query_id, rank) -> (vec_id, cosine), each pair on its own in double precision."""
    usable = [(i, [float(x) for x in v]) for i, v in rows
              if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = {}
    for at, (i, v) in enumerate(usable):
        if i % every:
            continue
        near = []
        for other, (j, w) in enumerate(usable):
            if other != at:
                dot = math.fsum(a * b for a, b in zip(v, w))
                near.append((-dot / math.sqrt(math.fsum(a * a for a in v) * math.fsum(b * b for b in w)), j))
        for rank, (score, j) in enumerate(sorted(near)[:k], 1):
            out[i, rank] = (j, -score)
    return out


def query(spark, rows, monkeypatch, schema="vec_id bigint, embedding array<float>"):
    table = spark.createDataFrame(rows, schema).repartition(4)
    monkeypatch.setattr(queries, "table", lambda *_: table)
    got = queries.op13_nearest_vectors(spark, "")
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "double"]
    return got.collect()


def recall(got, want):
    found = {(r.query_id, r.vec_id) for r in got}
    return len(found & {(q, i) for (q, _), (i, _) in want.items()}) / len(want)


@pytest.mark.parametrize("block", [2048, 64])
def test_recall_and_scores_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(2500))]
    got, want = query(spark, rows, monkeypatch), brute_force(rows)
    assert len(got) == len(want) == 250
    assert recall(got, want) >= 0.95
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    for r in got:
        a, b = vectors[r.query_id], vectors[r.vec_id]
        assert r.score == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-14)
    ranks = {}
    for r in got:
        ranks.setdefault(r.query_id, {})[r.rank] = (-r.score, r.vec_id)
    for by_rank in ranks.values():
        assert sorted(by_rank) == [1, 2, 3, 4, 5]
        assert [by_rank[i] for i in range(1, 6)] == sorted(by_rank.values())


def test_reruns_agree(spark, monkeypatch):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(600, 12))]
    assert sorted(query(spark, rows, monkeypatch)) == sorted(query(spark, rows, monkeypatch))


def test_ties_and_a_third_of_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    base = clustered(900, 16)
    rows = [(i, (base[0] if i % 3 == 0 else base[i]).tolist()) for i in range(900)]
    random.Random(1).shuffle(rows)
    got, want = query(spark, rows, monkeypatch), brute_force(rows)
    copies = {(r.query_id, r.rank): r.vec_id for r in got if r.query_id % 3 == 0}
    for (q, rank), (i, _) in want.items():
        if q % 3 == 0:
            assert copies[q, rank] == i
    assert recall(got, want) >= 0.95


def test_vectors_that_take_no_part(spark, monkeypatch):
    good = clustered(40, 6).astype(np.float64)
    rows = [(i, v.tolist()) for i, v in enumerate(good)]
    bad = [None, [], [0.0] * 6, [1.0, None, 2.0, 3.0, 4.0, 5.0], [math.nan] * 6, [math.inf] + [1.0] * 5,
           [1.0, 2.0]]
    rows += [(50 * (i + 1), v) for i, v in enumerate(bad)] + [(None, good[0].tolist()), (0, good[0].tolist())]
    rows += [(1000, (good[3] * 1e300).tolist()), (1050, (good[4] * 1e-300).tolist())]
    got = query(spark, rows, monkeypatch, "vec_id bigint, embedding array<double>")
    # The rows 0, 0, 1000 and 1050 ask.
    assert len(got) == 20 and {r.query_id for r in got} == {0, 1000, 1050}
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append(r)
    assert sum(r.vec_id == 0 and r.rank == 1 for r in by_query[0]) == 2
    assert [r.vec_id for r in by_query[1000] if r.rank == 1] == [3]
    assert [r.vec_id for r in by_query[1050] if r.rank == 1] == [4]
    assert all(abs(r.score) <= 1 + 1e-12 for r in got)


def test_few_and_no_rows(spark, monkeypatch):
    got = query(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], monkeypatch)
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1), (2, 2)]
    assert query(spark, [(0, [1.0, 0.0])], monkeypatch) == []
    assert query(spark, [], monkeypatch) == []
    assert query(spark, [(0, None), (50, [0.0])], monkeypatch) == []


def test_clashing_columns(spark, monkeypatch):
    table = spark.createDataFrame([(i, v.tolist(), 1, 2) for i, v in enumerate(clustered(80, 4))],
                                  "vec_id bigint, embedding array<float>, list int, row int") \
        .selectExpr("*", "1 AS rank", "2.0 AS score", "3 AS part", "4 AS id", "5 AS asks")
    monkeypatch.setattr(queries, "table", lambda *_: table)
    assert queries.op13_nearest_vectors(spark, "").count() == 10


def test_abandoned_vectors_are_far():
    """Against the true k-th distance, the scan loses at most a few of the k nearest."""
    pick = np.random.default_rng(5)
    rows = pick.normal(size=(2000, 64)).astype(np.float32)
    rows /= np.sqrt((rows * rows).sum(1))[:, None]
    asked = rows[:100] + 0.05 * pick.normal(size=(100, 64)).astype(np.float32)
    far = np.sort(((asked[:, None] - rows) ** 2).sum(2), 1)[:, 4]
    columns = [np.ascontiguousarray(rows[:, i:i + 16].T) for i in range(0, 64, 16)]
    q, r = neighbours.scan(columns, asked, far.astype(np.float64), 5, np.full(100, -1))
    near = {(i, j) for i in range(100) for j in np.argsort(((asked[i] - rows) ** 2).sum(1))[:5].tolist()}
    assert len(near & set(zip(q.tolist(), r.tolist()))) >= 0.98 * len(near)
    assert len(q) < 2 * len(near)
    own = np.arange(100)
    q, r = neighbours.scan(columns, asked, np.full(100, np.inf), 5, own)
    assert not (q == r).any() and np.bincount(q, minlength=100).min() >= 5


def test_fit_holds_few_products_at_once():
    """As many lists as there can be: the products of the sample with the centres are never held whole."""
    rows = clustered(6000, 8)
    rows /= np.sqrt((rows * rows).sum(1))[:, None]
    tracemalloc.start()
    centres = neighbours._centres(rows, neighbours.MOST_LISTS, turns=2)
    probes = neighbours._probes(rows, centres, 5, 0.99)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 40e6 < 6000 * neighbours.MOST_LISTS * 4
    products = rows @ centres.T
    assert (neighbours._nearest_centre(rows, centres) == products.argmax(1)).all()
    assert 1 <= probes <= neighbours.MOST_LISTS


def packs(index, sizes, rows, far, monkeypatch, nearest=False):
    """(bucket, query row, lists) as the packer makes them."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 10)
    deal = neighbours._Deal(np.array(sizes), index, 3)
    schema = pa.schema([("bucket", pa.int32()), ("asks", pa.bool_()), ("list", pa.int32()), ("row", pa.int64()),
                        ("id", pa.int64()), ("raw", pa.binary()), ("far", pa.float64()), ("lists", pa.binary())])
    asked = pa.RecordBatch.from_arrays([
        pa.array(range(len(rows)), pa.int64()), pa.array(range(len(rows)), pa.int64()),
        pa.array([r.astype("<f4").tobytes() for r in rows], pa.binary()), pa.array(far, pa.float64())],
        names=["row", "id", "raw", "far"])
    out = [r for b in neighbours._packer(schema, index, deal, 1, nearest)(iter([asked])) for r in b.to_pylist()]
    return deal, [(r["bucket"], r["row"], np.frombuffer(r["lists"], "<u2").tolist()) for r in out]


def test_a_query_goes_once_to_a_bucket_and_not_to_lists_beyond_its_reach(monkeypatch):
    centres = np.eye(4, dtype=np.float32)
    index = neighbours.Index(4, "<f4", np.eye(4, dtype=np.float32), centres, 4)
    rows = np.array([[1, 0.1, 0, 0], [0, 1, 0.9, 0]], np.float32)
    deal, got = packs(index, [10, 10, 25, 0], rows, [math.inf, math.inf], monkeypatch)
    # Parts: one, one, three; two to a bucket. The empty list is read by nobody.
    assert deal.buckets == 3 and deal.bucket_parts == 2
    assert sorted(got) == [(0, 0, [1]), (0, 1, [0]), (1, 0, [2]), (1, 1, [2]), (2, 0, [2]), (2, 1, [2])]
    _, got = packs(index, [10, 10, 25, 0], rows, [math.inf, math.inf], monkeypatch, nearest=True)
    assert sorted(got) == [(0, 0, [0]), (0, 1, [1])]
    # The border between the two nearest lists of the second query is 0.05 away, all others are farther.
    _, got = packs(index, [10, 10, 25, 0], rows, [0.0, 0.01], monkeypatch)
    assert sorted(got) == [(1, 1, [2]), (2, 1, [2])]
