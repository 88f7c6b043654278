import hashlib
import os
import tempfile
from collections import Counter

import numpy as np
import pytest

from patronage.llm import alignment, queries

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(queries.TOKENIZER)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


def sign_bytes():
    """Byte-level signs, found from the library: what each single byte is shown as."""
    from tokenizers.pre_tokenizers import ByteLevel
    split, out = ByteLevel(add_prefix_space=False, use_regex=False), {}
    for point in range(0x800):
        shown = split.pre_tokenize_str(chr(point))[0][0]
        out |= dict(zip(shown, chr(point).encode()))
    for high in (0x1F600, 0x40000, 0x80000, 0xC0000, 0x100000):
        out |= dict(zip(split.pre_tokenize_str(chr(high))[0][0], chr(high).encode()))
    for point in range(0x800, 0x10000, 64):
        if not 0xD800 <= point < 0xE000:
            out |= dict(zip(split.pre_tokenize_str(chr(point))[0][0], chr(point).encode()))
    return out


def brute_force(rows, libraries):
    """Tokens' ends one by one, groups between common ends, links of every two that end together."""
    a, b = libraries
    signs, vocabulary = sign_bytes(), {i: t for t, i in a.get_vocab().items()}
    made, total = [], Counter()
    for key, text in rows:
        if not text:
            made.append((key, [], [], [], []))
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a = [bytes(signs[c] for c in vocabulary[i]) for i in ids_a]
        raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                 for i in ids_b for p in [b.id_to_piece(i)]]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            made.append((key, [], [], [], []))
            continue
        ends_a = np.cumsum([len(r) for r in raw_a]).tolist()
        ends_b = np.cumsum([len(r) for r in raw_b]).tolist()
        both, groups, x, y = sorted(set(ends_a) & set(ends_b)), [], 0, 0
        for end in both:
            u, v = ends_a.index(end, x) + 1, ends_b.index(end, y) + 1
            groups.append((ids_a[x:u], ids_b[y:v]))
            x, y = u, v
        at_b = dict(zip(ends_b, ids_b))
        links = [(i, at_b[e]) for i, e in zip(ids_a, ends_a) if e in at_b]
        total.update(links)
        made.append((key, ids_a, ids_b, groups, links))
    highest = Counter()
    for (_, i), n in total.items():
        highest[i] = max(highest[i], n)
    out = []
    for key, ids_a, ids_b, groups, links in made:
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((key, len(ids_a), len(ids_b), len(groups), len(links),
                    sum(total[p] == highest[p[1]] for p in links), sum(total[p] for p in links),
                    hashlib.sha256(shown.encode()).hexdigest() if shown else ""))
    return out


def query(spark, docs, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = queries.op11_align_tokens(spark, "")
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("links", [1 << 18, 50])
def test_query_against_brute_force(spark, corpus, docs, libraries, monkeypatch, links):
    monkeypatch.setattr(alignment, "CHUNK_LINKS", links)
    more = [(900 + i, t, "en", "a", 0) for i, t in enumerate((
        "<|endoftext|> <s> </s> <unk>", "▁under ▁▁score", "emoji \U0001F600 and ́ marks",
        " leading", "trailing ", "a b", "x\x00y", "日本語 за", "ﬁ ligature ①",
        "line\nbreaks\n\n\tand tabs", "don't can't 12,345.67", "  "))] + [(None, "no id here", "en", "a", 0)]
    rows = spark.createDataFrame(more, docs.schema).unionByName(docs).repartition(3)
    got = query(spark, rows, monkeypatch)
    want = sorted(brute_force([(r[0], r[1]) for r in [*corpus, *more]], libraries), key=repr)
    assert got == want
    assert sum(r[3] > 0 for r in want) > 50 and sum(r[3] == 0 for r in want) == 3


def test_groups_read_back(spark, docs, corpus, libraries):
    path = os.path.join(tempfile.mkdtemp(), "t")
    alignment.write_alignments(docs, path, queries.TOKENIZER, queries.PIECES)
    a, b = libraries
    texts = {r[0]: r[1] for r in corpus}
    for r in alignment.read_alignments(spark, path).collect():
        if r.groups:
            sides = [g.split("|") for g in r.groups.split(";")]
            assert [int(i) for g, _ in sides for i in g.split(",")] == a.encode(
                " " + texts[r.doc_id], add_special_tokens=False).ids
            assert [int(i) for _, g in sides for i in g.split(",")] == b.encode(texts[r.doc_id])


def test_overlaps_and_groups_of_intervals():
    pick = np.random.default_rng(2)
    for _ in range(50):
        size = int(pick.integers(1, 40))
        cut = lambda: np.unique(np.append(pick.integers(1, size + 1, pick.integers(0, size)), size))
        a_end, b_end = cut(), cut()
        a_start, b_start = (np.concatenate([[0], e[:-1]]) for e in (a_end, b_end))
        got = set(zip(*(x.tolist() for x in alignment.overlaps(a_start, a_end, b_start, b_end))))
        assert got == {(i, j) for i in range(len(a_end)) for j in range(len(b_end))
                       if max(a_start[i], b_start[j]) < min(a_end[i], b_end[j])}
        groups = alignment.coalesce(a_start, a_end, b_start, b_end)
        common = sorted(set(a_end) & set(b_end))
        for ends, group in zip((a_end, b_end), groups):
            assert group.tolist() == np.searchsorted(common, ends).tolist()


def test_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    got = query(spark, odd_docs, monkeypatch)
    assert len(got) == 6 and [r[0] for r in got].count(None) == 2
    assert [r for r in got if r[1] == 0] == [(None, 0, 0, 0, 0, 0, 0, "")]
    assert query(spark, no_docs, monkeypatch) == []
