"""Each stage against a brute-force version on what its predecessor kept."""

from collections import Counter

import pytest

import corpus_pipeline
from patronage.llm import language
from test_decontaminate import brute_force as decontaminate_brute
from test_minhash import brute_force as minhash_brute
from test_mixing import brute_force as mixing_brute
from test_tokens import brute_force as tokens_by_id


def tokens_brute(pairs):
    """Rows in id order; repeats of a document stand next to each other."""
    single = tokens_by_id({(d, t or "") for d, t in pairs})
    out, start = [], 0
    for d, _ in sorted(pairs):
        _, n, crc = single[d]
        out.append((d, start, n, crc))
        start += n
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, docs, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    texts = {r[0]: r[1] for r in corpus}
    items = [(1, " ".join(texts[8].split()[4:30])), (2, texts[11]), (3, None)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(
        f"{path}/benchmark.parquet")
    return path, items


def test_stages_equal_brute_force(spark, sf_dir):
    folder, items = sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_dedup", "decontamination", "source_mix", "token_output"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        pairs = [(r.doc_id, r.text) for r in before]
        out = corpus_pipeline.settle(stage(spark, docs, folder))
        rows = out.collect()
        if name == "token_output":
            assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
            assert sorted(map(tuple, rows), key=lambda r: r[1]) == tokens_brute(pairs)
            break
        assert out.columns == docs.columns and out.schema == docs.schema
        assert {tuple(r) for r in rows} <= {tuple(r) for r in before}
        kept = Counter(r.doc_id for r in rows)
        if name == "language_id":
            sure = {r.doc_id for r in language.identify(docs, language.learn(docs)).collect()
                    if r.accepted}
            assert kept == Counter(sure) and 0 < len(sure) < len(before)
        elif name == "near_dedup":
            want = {d for d, (_, _, keep) in minhash_brute(pairs, 5, 80).items() if keep}
            assert kept == Counter(want) and len(want) < len(before)
        elif name == "decontamination":
            bad = {d for d, w in decontaminate_brute(pairs, items, 10).items() if w[4]}
            assert kept == Counter({d for d, _ in pairs} - bad) and bad
        else:
            taken = mixing_brute([(r.doc_id, r.text, r.lang, r.source) for r in before])
            for source in {r.source for r in before}:
                size = {r.doc_id: taken[r.doc_id][0] for r in before if r.source == source}
                words = sum(kept[d] * n for d, n in size.items())
                target = next(taken[d][2] for d in size)
                assert abs(words - target) <= max(size.values()) / 2 + 1
            assert max(kept.values()) <= 3
        docs = out


def test_run_gives_the_last_stage(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir[0]).orderBy("start").collect()
    assert rows[0].start == 0
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))


def test_empty_table(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_pass_through(spark, odd_docs, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = corpus_pipeline.settle(stage(spark, docs, str(tmp_path)))
        if name != "token_output":
            assert docs.columns == odd_docs.columns
    assert docs.count() > 0
