import os
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pytest

from patronage.llm import tokens
from patronage.llm.queries import TOKENIZER


def plain_ids(text):
    encoder = tokens._Encoder(TOKENIZER).tokenizer if not hasattr(plain_ids, "t") else plain_ids.t
    plain_ids.t = encoder
    return encoder.encode(text or "", add_special_tokens=False).ids


def brute_force(rows):
    out, start = {}, 0
    for d, text in sorted(rows):
        ids = plain_ids(text) + [tokens.END_ID]
        out[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_written_shards_give_every_document_back(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_TOKENS", 700)
    path = os.path.join(tempfile.mkdtemp(), "t")
    tokens.write_tokens(docs, path, TOKENIZER)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32)
           for r in tokens.read_tokens(spark, path).collect()}
    assert got == brute_force([(r[0], r[1] or "") for r in corpus])


def test_one_document_without_its_shard(spark, docs, corpus):
    path = os.path.join(tempfile.mkdtemp(), "t")
    tokens.write_tokens(docs, path, TOKENIZER)
    texts = {r[0]: r[1] for r in corpus}
    for row in spark.read.parquet(path).collect():
        shard = row.asDict()
        for i, d in list(enumerate(shard["ids"]))[::7]:
            assert tokens.document_ids(shard, i).tolist() == plain_ids(texts[d]) + [tokens.END_ID]


def test_remembered_words_change_nothing(corpus, monkeypatch):
    texts = [r[1] for r in corpus]
    want = [plain_ids(t) for t in texts]
    for limit in (tokens.WORD_LIMIT, 50):
        monkeypatch.setattr(tokens, "WORD_LIMIT", limit)
        monkeypatch.setattr(tokens, "PIECE_BYTES", 500)
        for _ in range(2):
            got = list(tokens.encode_column(TOKENIZER, pa.array(texts, pa.string())))
            assert [g.tolist() for g in got] == want


@pytest.mark.parametrize("seed", range(6))
def test_repair_round_trip(seed):
    pick = np.random.default_rng(seed)
    ids = pick.choice([0, 1, 2, 3, 50_256], pick.integers(0, 3000)).astype(np.uint16)
    left, rules = tokens.repair(ids, least=2)
    lengths = tokens.expansion_lengths(rules)
    back = tokens.expand(left, rules, lengths)
    assert back.tolist() == ids.tolist()
    assert int(lengths[left].sum()) == len(ids)
    if len(ids) > 100:
        assert len(left) + 2 * len(rules) < len(ids)


def test_odd_rows(spark, odd_docs, no_docs):
    path = os.path.join(tempfile.mkdtemp(), "t")
    tokens.write_tokens(odd_docs, path, TOKENIZER)
    rows = tokens.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 1, 1, 2, 2]
    assert rows[0].n_tokens == 1 and rows[2].ids_crc32 == rows[3].ids_crc32
    path = os.path.join(tempfile.mkdtemp(), "t")
    tokens.write_tokens(no_docs, path, TOKENIZER)
    assert tokens.read_tokens(spark, path).count() == 0


def test_added_tokens_are_one_id():
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(TOKENIZER)
    texts = ["alpha beta", "", "a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> <|endoftext|>y z",
             "<|endoftext", "|>", "plain words <|endoftext|>", "it's <|endoftext|>"]
    got = [g.tolist() for g in tokens.encode_column(TOKENIZER, pa.array(texts, pa.string()))]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50_256 in got[2]


def test_words_are_encoded_in_groups_and_known_again(monkeypatch):
    encoder = tokens._Encoder(TOKENIZER)
    calls = []
    plain = encoder.plain
    monkeypatch.setattr(encoder, "plain", lambda texts: calls.append(len(texts)) or plain(texts))
    texts = [f"first{i} café{i % 7} -- {i}\nx" for i in range(300)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for known in (False, True):
        assert [x.tolist() for x in encoder.encode(data, bounds)] == want
        assert not calls  # neither whole texts nor words one by one
        assert (encoder.known > 0) and (not known or encoder.known == learned)
        learned = encoder.known
