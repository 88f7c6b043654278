import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from patronage.llm import periodic, queries
from patronage.llm.texts import text_bytes, word_hashes

WHITE = " \t\n\r\x0b\x0c"


def brute_runs(words, least=12):
    """Every stretch with a period, by comparing each word with the one each distance later."""
    out, n = [], len(words)
    for period in range(1, n // 2 + 1):
        at = 0
        while at + period < n:
            end = at
            while end + period < n and words[end] == words[end + period]:
                end += 1
            size = end + period - at
            if end > at and size >= max(least, 2 * period):
                part = words[at:at + size]
                if all(part[q:] != part[:-q] for q in range(1, period)):
                    out.append((at, size, period))
            at = max(end, at + 1)
    return sorted(out)


def collapse(words, runs):
    return " ".join(w for i, w in enumerate(words)
                    if not any(s + p <= i < s + n for s, n, p in runs))


def split(text):
    for sign in WHITE:
        text = text.replace(sign, " ")
    return [w for w in text.split(" ") if w]


def odd_text(pick):
    kinds, n = pick.choice([1, 2, 2, 3, 60]), pick.randint(0, 110)
    words = [str(pick.randrange(kinds)) for _ in range(n)]
    if pick.random() < 0.7 and n > 10:
        period, at = pick.randint(1, n // 2), pick.randrange(n // 2)
        words = [w if i < at else words[at + (i - at) % period] for i, w in enumerate(words)]
    return words


@pytest.mark.parametrize("tile", [1 << 18, 40, 14])
def test_tiles_give_the_runs_of_a_search_by_comparison(monkeypatch, tile):
    monkeypatch.setattr(periodic, "TILE_WORDS", tile)
    pick = random.Random(tile)
    for least in (12, 4, 20):
        texts = [odd_text(pick) for _ in range(60)]
        words, bounds = word_hashes(*text_bytes(pa.array([" ".join(t) for t in texts])), fold=None)
        rows = periodic.intervals(words, bounds, least)
        for i, text in enumerate(texts):
            got = sorted((s, e - s, p) for _, s, e, p in rows[rows[:, 0] == i].tolist())
            assert got == brute_runs(text, least)


def test_long_periods_and_one_word_over_and_over():
    pick = random.Random(1)
    base = [str(pick.randrange(10 ** 6)) for _ in range(1500)]
    for text in (base * 2 + ["x"], ["w"] * 5000, ["x"] + base[:700] * 3 + base[:100]):
        words, bounds = word_hashes(*text_bytes(pa.array([" ".join(text)])), fold=None)
        rows = periodic.intervals(words, bounds, 12).tolist()
        if text[0] == "w":
            assert rows == [[0, 0, 5000, 1]]
        elif text[0] == "x":
            assert rows == [[0, 1, 2201, 700]]
        else:
            assert rows == [[0, 0, 3000, 1500]]


def test_intervals_of_a_run_are_stitched(spark):
    parts = spark.createDataFrame(
        [(1, 0, 30, 5), (1, 25, 60, 5), (1, 58, 80, 5), (1, 20, 70, 7), (2, 60, 90, 5)],
        "row bigint, start bigint, end bigint, period bigint").repartition(4)
    got = sorted(tuple(r) for r in periodic.stitched(parts).collect())
    assert got == [(1, 0, 60, 5), (1, 20, 50, 7), (1, 58, 22, 5), (2, 60, 30, 5)]


def expected(doc_id, text):
    words = split(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines),
            sha(collapse(words, runs)))


def query(spark, docs, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = queries.op12_periodic_runs(spark, "")
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                           "runs_sha256", "collapsed_sha256"]
    return got.collect()


def test_query_against_comparison(spark, corpus, docs, monkeypatch):
    pick = random.Random(3)
    more = [(1000 + i, " \t".join(odd_text(pick)), "en", "a", 0) for i in range(120)]
    more += [(2000, "Alpha " * 40 + "alpha " * 40, "en", "a", 0), (None, "a b " * 9, "en", "a", 0)]
    rows = spark.createDataFrame(more, docs.schema).unionByName(docs)
    got = sorted((tuple(r) for r in query(spark, rows, monkeypatch)), key=repr)
    want = sorted((expected(r[0], r[1]) for r in [*corpus, *more]), key=repr)
    assert got == want
    assert sum(w[1] > 0 for w in want) > 30


def test_small_tiles_change_no_result(spark, corpus, docs, monkeypatch):
    texts = [" ".join(odd_text(random.Random(i))) for i in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = sorted(map(tuple, periodic.periodic_runs(rows).collect()))
    for _, n, runs, text in want:
        assert n >= len(text.split())
    got = sorted((i, len(t.split()), brute_runs(t.split()), collapse(t.split(), brute_runs(t.split())))
                 for i, t in enumerate(texts))
    assert [(i, n, [tuple(r) for r in runs], text) for i, n, runs, text in want] == got


def test_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    got = query(spark, odd_docs, monkeypatch)
    assert len(got) == 6 and all(r.n_runs == 0 and r.start is None for r in got)
    assert query(spark, no_docs, monkeypatch) == []
    assert periodic._primitive(None, np.empty(0), np.empty(0), 0).tolist() == []


def test_a_batch_takes_little_memory_beside_its_texts(monkeypatch):
    import tracemalloc
    import types
    monkeypatch.setattr(periodic.TaskContext, "get", lambda: types.SimpleNamespace(partitionId=lambda: 0))
    rng = random.Random(3)
    texts = [" ".join(str(rng.randrange(10 ** 6)) for _ in range(600)) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], names=["id", "text"])
    found = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "period")]))
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()),
                        ("collapsed", pa.string()), ("text", pa.string()), ("found", found)])
    run = periodic._finder(schema, 12, "sha256")
    assert sum(b.num_rows for b in run(iter([batch]))) == 400
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in run(iter([batch]))) == 400
        assert tracemalloc.get_traced_memory()[1] < 12e6
    finally:
        tracemalloc.stop()
