"""Context-triggered piecewise hashes of texts, compared by edit distance.

A rolling hash over the last seven bytes decides where chunks end: at block size b a chunk ends
where the hash is b - 1 modulo b. Every chunk becomes one of 64 characters. Block sizes are
3 * 2**k, so the ends at one size are among those at half of it. A fingerprint is its size, the
largest that gives at least 32 chunks, and the signatures at one, two, four and so on up to 128 times
that size, joined by colons. A signature has all chunks of the text. Two fingerprints are compared at
the sizes they have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronage.llm.texts import _BASE, _power_tables, _BYTE_VALUE, mix64
from patronage.session import settle

SMALLEST = 3
LEAST_CHUNKS = 32
WORD_BITS = 64
LETTERS = np.frombuffer(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
COMMON = 4
LEVELS = 8
NEAR_LEVELS = 4
SHORT = 16


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """For every byte: a hash of it and the six bytes before, as in piecewise hashing.

    The sum of the bytes, their sum weighted by nearness, and their shifted exclusive or.
    """
    n = len(data)
    padded = np.zeros(n + 6, np.uint32)
    padded[6:] = data
    plain = np.zeros(n, np.uint32)
    weighted = np.zeros(n, np.uint32)
    shifted = np.zeros(n, np.uint32)
    for back in range(7):
        byte = padded[6 - back:6 - back + n]
        plain += byte
        weighted += np.uint32(7 - back) * byte
        shifted ^= byte << np.uint32(5 * back)
    return plain + weighted + shifted


def _signature(total: np.ndarray, ends: np.ndarray, n: int) -> bytes:
    """One character per chunk, to the end of the text."""
    if not n:
        return b""
    bounds = np.concatenate([[0], ends + 1, [n]])
    if bounds[-2] == n:
        bounds = bounds[:-1]
    _, down = _power_tables(n + 1)
    start, end = bounds[:-1], bounds[1:]
    return LETTERS[mix64((total[end] - total[start]) * down[start]) & np.uint64(63)].tobytes()


def fingerprint(text: str | None) -> str:
    """The fingerprint of a text; a null or empty text has the smallest size and empty signatures."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    n = len(data)
    rolled = rolling_hash(data)
    size, ends = SMALLEST, np.flatnonzero(rolled % np.uint32(SMALLEST) == SMALLEST - 1)
    at_ends = rolled[ends]
    while True:
        wider = at_ends % np.uint32(2 * size) == 2 * size - 1
        if np.count_nonzero(wider) < LEAST_CHUNKS:
            break
        size, ends, at_ends = 2 * size, ends[wider], at_ends[wider]
    up, _ = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[:n], out=total[1:])
    parts = [str(size)]
    for level in range(LEVELS):
        here = at_ends % np.uint32(size << level) == (size << level) - 1
        parts.append(_signature(total, ends[here], n).decode())
    return ":".join(parts)


def _codes(signatures: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in signatures], np.int64)
    codes = np.zeros((len(signatures), WORD_BITS), np.uint8)
    flat = np.frombuffer("".join(signatures).encode(), np.uint8)
    codes[np.arange(WORD_BITS) < lengths[:, None]] = flat
    return codes, lengths


def _related(left: str, right: str, short: bool) -> bool:
    """Whether the two have a run of ``COMMON`` in common; if ``short``, a quarter of one is enough."""
    size = min(COMMON, -(-min(len(left), len(right)) // 4)) if short else COMMON
    runs = {left[i:i + size] for i in range(len(left) - size + 1)}
    return size > 0 and any(right[i:i + size] in runs for i in range(len(right) - size + 1))


def _common_short(left: list[str], right: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of all pairs together, for at most 64 characters."""
    a, la = _codes(left)
    b, lb = _codes(right)
    rows = np.arange(len(left))
    masks = np.zeros((len(left), 128), np.uint64)
    for i in range(WORD_BITS):
        here = la > i
        masks[rows[here], a[here, i]] |= np.uint64(1 << i)
    state = np.full(len(left), ~np.uint64(0))
    for j in range(WORD_BITS):
        here = lb > j
        match = np.where(here, masks[rows, b[:, j]], np.uint64(0))
        used = state & match
        state = (state + used) | (state - used)
    return np.bitwise_count(~state).astype(np.int64)


def _common_long(left: str, right: str) -> int:
    """The same for one pair of any length, on one long integer; equal ends are counted at once."""
    least = min(len(left), len(right))
    a, b = (np.frombuffer(x.encode(), np.uint8) for x in (left, right))
    unlike = np.flatnonzero(a[:least] != b[:least])
    ahead = int(unlike[0]) if len(unlike) else least
    a, b, least = a[ahead:], b[ahead:], least - ahead
    unlike = np.flatnonzero(a[::-1][:least] != b[::-1][:least])
    behind = int(unlike[0]) if len(unlike) else least
    a, b = a[:len(a) - behind], b[:len(b) - behind]
    masks = {c: int.from_bytes(np.packbits(a == c, bitorder="little").tobytes(), "little")
             for c in np.unique(a).tolist()}
    every = (1 << len(a)) - 1
    state = every
    for c in b.tolist():
        used = state & masks.get(c, 0)
        if used:
            state = ((state + used) | (state - used)) & every
    return ahead + behind + len(a) - state.bit_count()


def signature_likeness(left: list[str], right: list[str], short: bool = False) -> np.ndarray:
    """1 - edit distance / total length for pairs of signatures, insertions and deletions only.

    The longest common subsequences of pairs of up to 64 characters are found together, 64 rows to
    a machine word; longer ones pair by pair. Signatures of at least ``COMMON`` characters without
    a common run of that length count as unlike, as single characters meet by chance; shorter ones
    only as alike when equal. With ``short``, a run of a quarter of the shorter one is enough.
    """
    like = np.array([float(x == y) for x, y in zip(left, right)])
    related = [i for i, (x, y) in enumerate(zip(left, right)) if x != y and _related(x, y, short)]
    brief = [i for i in related if max(len(left[i]), len(right[i])) <= WORD_BITS]
    common = dict(zip(brief, _common_short([left[i] for i in brief],
                                           [right[i] for i in brief]).tolist()))
    for i in related:
        if i not in common:
            common[i] = _common_long(left[i], right[i])
        like[i] = 2 * common[i] / (len(left[i]) + len(right[i]))
    return like


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness of fingerprint pairs, 0 to 1: the best over the block sizes they share.

    Shared sizes count among the first ``NEAR_LEVELS`` of both. Where the finest shared signatures
    are shorter than ``SHORT``, or shared only further up, these two are compared as short ones.
    """
    one = [f.split(":") for f in left]
    two = [f.split(":") for f in right]
    best = np.array([float(x == y) for x, y in zip(left, right)])
    # By how many doublings the second's smallest size is above the first's.
    above = [int(y[0]).bit_length() - int(x[0]).bit_length() for x, y in zip(one, two)]

    def compare(rows: list[int], levels: list[int], short: bool) -> None:
        if rows:
            got = signature_likeness([one[i][n + above[i] + 1] for i, n in zip(rows, levels)],
                                     [two[i][n + 1] for i, n in zip(rows, levels)], short)
            best[rows] = np.maximum(best[rows], got)

    for level in range(NEAR_LEVELS):
        rows = [i for i, k in enumerate(above) if 0 <= level + k < NEAR_LEVELS and best[i] < 1
                and (one[i][level + k + 1] or two[i][level + 1])]
        compare(rows, [level] * len(rows), False)
    finest = [max(0, -k) for k in above]
    rows = [i for i, (k, n) in enumerate(zip(above, finest)) if best[i] < 1 and abs(k) < LEVELS and (
        abs(k) >= NEAR_LEVELS or min(len(one[i][n + k + 1]), len(two[i][n + 1])) < SHORT)]
    compare(rows, [finest[i] for i in rows], True)
    return best


def edited_text(text: str, following: str) -> str:
    """The second half of a text replaced by the start of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _rows(pairs: list[tuple]) -> dict[str, list]:
    """Result columns for (id, text, next text); the next one's fingerprint is made once."""
    made: dict[int, str] = {}

    def of(text: str) -> str:
        key = id(text)
        if key not in made:
            made[key] = fingerprint(text)
        return made[key]

    edits = [edited_text(t, f) for _, t, f in pairs]
    own = [of(t) for _, t, _ in pairs]
    after = [of(f) for _, _, f in pairs]
    changed = [fingerprint(e) if e != t else o for e, (_, t, _), o in zip(edits, pairs, own)]
    return {"doc_id": [p[0] for p in pairs], "n_chars": [len(p[1]) for p in pairs],
            "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edits],
            "fingerprint": own, "edited_fingerprint": changed,
            "near_edited": likeness(own, changed).tolist(),
            "near_next": likeness(own, after).tolist()}


def _along(schema: pa.Schema):
    """Pairs of neighbours inside one range of ids; its first and last texts go out as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = last = None

        def out(columns: dict) -> pa.RecordBatch:
            n = len(columns["doc_id"])
            return pa.RecordBatch.from_pydict(
                {f.name: columns.get(f.name, [None] * n) for f in schema}, schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                here = list(zip(some.column(0).to_pylist(), some.column(1).to_pylist()))
                if first is None:
                    first = here[0]
                elif last is not None:
                    here.insert(0, last)
                last = here[-1]
                pairs = [(k, t, f) for (k, t), (_, f) in zip(here, here[1:])]
                if pairs:
                    yield out(_rows(pairs))
        if first is not None:
            yield out({"part": [part], "doc_id": [last[0]], "first_text": [first[1]],
                       "last_text": [last[1]]})
    return run


def _across(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pydict(
                    _rows([(row["doc_id"], row["last_text"], row["following"])]), schema=schema)
    return run


COLUMNS = ("n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next). The edited text has its last half replaced by the start of the text that follows in
    ascending id order; the first follows the last. ``near_next`` compares with the following
    text itself. Texts are ranged by id once; only the first and last text of each range, which
    meet their neighbours in another range, are looked at a second time.

    A null text is an empty one; its fingerprint is ``3::::``, and like only to itself. Null ids come
    first; rows that repeat an id stand next to each other, ordered by text. A table of one row
    follows itself. An empty table gives an empty result. Other columns are not looked at.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    plain = spark.createDataFrame([], f"doc_id {id_type}, {COLUMNS}").schema
    wide = spark.createDataFrame(
        [], f"doc_id {id_type}, {COLUMNS}, part int, first_text string, last_text string").schema
    ranged = settle(texts.repartitionByRange("id").sortWithinPartitions("id", "text")
                    .mapInArrow(_along(to_arrow_schema(wide)), wide))
    # One row per range from here on: its last text meets the first text of the next range.
    ends = ranged.filter("part is not null").select("part", "doc_id", "first_text", "last_text")
    parts = ends.select("part")
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = parts.select("part", F.coalesce(
        F.lead("part").over(order), F.min("part").over(whole)).alias("next_part"))
    firsts = ends.select(F.col("part").alias("next_part"), F.col("first_text").alias("following"))
    seams = (ends.join(following, "part").join(firsts, "next_part")
             .select("doc_id", "last_text", "following")
             .mapInArrow(_across(to_arrow_schema(plain)), plain))
    return ranged.filter("part is null").select(*plain.names).unionByName(seams)
