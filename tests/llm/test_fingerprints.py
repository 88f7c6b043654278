import hashlib

import numpy as np

from patronage.llm import fingerprints


def slow_likeness(a, b):
    """Longest common subsequence by the textbook table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    if a == b:
        return 1.0
    runs = {a[i:i + fingerprints.COMMON] for i in range(len(a) - fingerprints.COMMON + 1)}
    if not any(r in b for r in runs):
        return 0.0
    return 2 * row[-1] / (len(a) + len(b))


def test_likeness_equals_the_textbook_table():
    pick = np.random.default_rng(1)
    left, right = [], []
    for _ in range(300):
        a = "".join(pick.choice(list("ABC/"), pick.integers(0, 65)))
        cut = pick.integers(0, len(a) + 1)
        b = (a[:cut] + "".join(pick.choice(list("ABx/"), pick.integers(0, 30))))[:64]
        left.append(a)
        right.append(b)
    got = fingerprints.signature_likeness(left, right)
    assert np.allclose(got, [slow_likeness(a, b) for a, b in zip(left, right)])


def test_rolling_hash_sees_seven_bytes():
    data = np.frombuffer(b"abcdefghijklmnop", np.uint8)
    other = np.frombuffer(b"ABCdefghijklmnop", np.uint8)
    a, b = fingerprints.rolling_hash(data), fingerprints.rolling_hash(other)
    assert (a[9:] == b[9:]).all() and (a[:9] != b[:9]).all()


def test_rows_equal_brute_force(docs, corpus):
    order = sorted((r[0], r[1] or "") for r in corpus)
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    assert len(got) == len(order)
    for i, (d, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = got[d]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprints.fingerprint(text)
        assert r.edited_fingerprint == fingerprints.fingerprint(edited)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if text == edited:
            assert r.near_edited == 1


def test_edits_are_nearer_than_other_texts(docs):
    long = fingerprints.fingerprints(docs.filter("length(text) > 300 and doc_id < 60")).collect()
    assert np.mean([r.near_edited > 0.3 for r in long]) > 0.9
    assert np.mean([r.near_next < 0.2 for r in long]) > 0.9


def test_texts_of_any_length_are_near_their_edits():
    """Half of each text is unchanged; short texts and texts that repeat themselves show it too."""
    pick = np.random.default_rng(9)
    vocabulary = ["".join(pick.choice(list("abcdefghijklmno"), pick.integers(2, 9))) for _ in range(900)]

    def prose(size):
        return " ".join(pick.choice(vocabulary, size // 4 + 2))[:size]

    for size in (60, 200, 1000, 5000):
        texts = [prose(size) for _ in range(60)]
        if size == 5000:
            texts += [(prose(int(p)) * size)[:size] for p in pick.integers(8, 90, 30)]
        others = texts[1:] + texts[:1]
        edits = [fingerprints.edited_text(t, o) for t, o in zip(texts, others)]
        marks, edited = ([fingerprints.fingerprint(t) for t in x] for x in (texts, edits))
        near = fingerprints.likeness(marks, edited)
        assert np.mean(near[:60] > 0.3) >= 0.95, size
        # Of texts with one short period, some have no chunk borders that their edits have too.
        assert np.mean(near > 0.3) >= 0.85, size
        apart = fingerprints.likeness(marks[:60], marks[1:60] + marks[:1])
        assert np.mean(apart < 0.3) >= 0.9, size


def test_odd_rows(odd_docs, no_docs):
    rows = fingerprints.fingerprints(odd_docs).collect()
    assert len(rows) == 6
    same = {r.fingerprint for r in rows if r.n_chars == 22}
    assert len(same) == 1
    assert {r.fingerprint for r in rows if r.n_chars == 0} == {"3" + ":" * 8}
    assert fingerprints.fingerprints(no_docs).count() == 0
    alone = fingerprints.fingerprints(odd_docs.filter("source = 't'")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1


def test_long_likeness_equals_the_textbook_table():
    pick = np.random.default_rng(2)
    left, right = [], []
    for n in (0, 3, 63, 64, 65, 66, 127, 128, 129, 200, 300):
        for _ in range(4):
            a = "".join(pick.choice(list("ABC/"), n))
            cut = pick.integers(0, n + 1)
            left.append(a)
            right.append(a[:cut // 2] + "".join(pick.choice(list("ABx/"), pick.integers(0, 90)))
                         + a[cut:])
    for a, b in ((left, right), (right, left)):
        got = fingerprints.signature_likeness(a, b)
        assert np.allclose(got, [slow_likeness(x, y) for x, y in zip(a, b)])


def test_a_signature_covers_the_whole_text():
    pick = np.random.default_rng(3)
    for _ in range(40):  # a phrase whose chosen size has many chunks
        phrase = "".join(pick.choice(list("abcdefgh "), 40))
        text = phrase * 400
        if len(fingerprints.fingerprint(text).split(":")[1]) > 200:
            break
    other = " ".join("".join(pick.choice(list("qrstuvwxyz"), 6)) for _ in range(3000))
    edited = fingerprints.edited_text(text, other)
    one, two = fingerprints.fingerprint(text), fingerprints.fingerprint(edited)
    assert len(one.split(":")[1]) > 200
    mixed = text[:len(text) // 2] + other[:len(text) // 2]
    ends = fingerprints.fingerprint(mixed + "x"), fingerprints.fingerprint(mixed + "y")
    assert ends[0] != ends[1]
    assert fingerprints.likeness([one], [two])[0] < 0.8
