"""Quality classifier: ordinal regression of graded ratings on hashed text features.

One weight vector, shared by all grades, scores a text; ordered thresholds cut the score into
grades: P(grade <= k) = sigmoid(threshold[k] - score). From these come the expected grade and the
probability of the top grades, by which texts are selected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.llm.language import held_out
from patronage.llm.texts import NOT_SPACE, pieces, ragged, text_bytes, word_hashes

BITS = 18
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SIGN = NOT_SPACE & ~_WORD
_SHAPES = 4
_BINS = 16


def _share_bins(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.minimum((part / np.maximum(whole, 1) * _BINS).astype(np.int64), _BINS - 1)


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each piece of a text column: distinct feature numbers of its texts, and their bounds.

    Features are words (A-Z folded) and runs of signs by hash, and four shapes in bins: the shares
    of capitals, of signs and of distinct words, and the logarithm of the length. Every text has
    the four shapes, also one without words.
    """
    data, bounds = text_bytes(column)
    for a, b in pieces(bounds):
        d, at = data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a]
        n = b - a
        words, word_at = word_hashes(d, at, _WORD)
        signs, sign_at = word_hashes(d, at, _SIGN)
        capital = np.concatenate([[0], np.cumsum((d >= 65) & (d <= 90))])[at]
        sign = np.concatenate([[0], np.cumsum(_SIGN[d])])[at]
        size = np.diff(at)
        text_of = np.repeat(np.arange(n), np.diff(word_at))
        own = _distinct(text_of, words)
        shapes = np.stack([
            _share_bins(np.diff(capital), size), _share_bins(np.diff(sign), size),
            _share_bins(np.bincount(own[0], minlength=n), np.diff(word_at)),
            np.minimum(np.log2(size + 1).astype(np.int64), _BINS - 1)], 1)
        shapes += np.arange(_SHAPES) * _BINS
        first = _SHAPES * _BINS
        room = np.uint64((1 << BITS) - first)
        rows = np.concatenate([np.repeat(np.arange(n), _SHAPES), own[0],
                               np.repeat(np.arange(n), np.diff(sign_at))])
        numbers = np.concatenate([
            shapes.ravel(), (own[1] % room).astype(np.int64) + first,
            ((signs ^ np.uint64(0x5F)) % room).astype(np.int64) + first])
        keys = np.unique(rows << BITS | numbers)
        yield (keys & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(
            keys >> BITS, np.arange(n + 1))


def _distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[new], h[new]


@dataclass(frozen=True)
class Grader:
    weights: np.ndarray
    thresholds: np.ndarray

    def at_most(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= k) for every text and every grade but the last."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds - scores[:, None], -30, 30)))


def fit_grades(flat: np.ndarray, bounds: np.ndarray, grades: np.ndarray, n_grades: int,
               epochs: int = 30, rate: float = 0.01, decay: float = 1e-3,
               least_share: float = 0.0015, batch: int = 256, seed: int = 3) -> Grader:
    """Maximum likelihood of a cumulative-link model by Adam over shuffled batches.

    Features of less than ``least_share`` of the texts, or of fewer than four, keep weight 0.
    Thresholds are a first one and positive steps, so they stay ordered. Without texts all grades
    are equally likely.
    """
    everything = np.zeros(1 << BITS)
    start = np.log(np.arange(1, n_grades) / np.arange(n_grades - 1, 0, -1))
    if not len(grades):
        return Grader(everything, start)
    used = np.bincount(flat, minlength=1 << BITS) >= max(4, least_share * len(grades))
    numbers = np.flatnonzero(used)
    kept = used[flat]
    bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
    flat = (np.cumsum(used, dtype=np.int32) - 1)[flat[kept]]
    weights = np.zeros(len(numbers))
    share = np.array([(grades <= k).mean() for k in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    share = np.maximum.accumulate(share + 1e-4 * np.arange(n_grades - 1))
    theta = np.log(share / (1 - share))
    cuts = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])
    state = {"w": [0 * weights, 0 * weights], "c": [0 * cuts, 0 * cuts]}
    random, turn = np.random.default_rng(seed), 0
    lengths = np.diff(bounds)
    for _ in range(epochs):
        for rows in np.array_split(random.permutation(len(grades)), -(-len(grades) // batch)):
            turn += 1
            some = flat[ragged(bounds[rows], lengths[rows])]
            of = np.repeat(np.arange(len(rows)), lengths[rows])
            score = np.bincount(of, weights[some], len(rows))
            theta = np.concatenate([cuts[:1], cuts[0] + np.cumsum(np.exp(cuts[1:]))])
            upper = np.concatenate([theta, [30.0]])[np.minimum(grades[rows], n_grades - 1)]
            lower = np.concatenate([[-30.0], theta])[grades[rows]]
            p_up = 1 / (1 + np.exp(-np.clip(upper - score, -30, 30)))
            p_low = 1 / (1 + np.exp(-np.clip(lower - score, -30, 30)))
            mass = np.maximum(p_up - p_low, 1e-12)
            g_up, g_low = p_up * (1 - p_up) / mass, p_low * (1 - p_low) / mass
            slope = (g_up - g_low) / len(rows)  # of the loss, by the score
            g_theta = np.zeros(n_grades - 1)
            for k in range(n_grades - 1):
                g_theta[k] = (-g_up[grades[rows] == k].sum()
                              + g_low[grades[rows] == k + 1].sum()) / len(rows)
            after = np.cumsum(g_theta[::-1])[::-1]
            g_cuts = np.concatenate([after[:1], after[1:] * np.exp(cuts[1:])])
            gradient = np.bincount(some, slope[of], len(numbers))
            touched = np.flatnonzero(gradient)
            g = gradient[touched] + decay * weights[touched]
            weights[touched] -= _adam(state["w"], touched, g, turn, rate)
            cuts = cuts - _adam(state["c"], slice(None), g_cuts, turn, rate)
    everything[numbers] = weights
    return Grader(everything, np.concatenate([cuts[:1], cuts[0] + np.cumsum(np.exp(cuts[1:]))]))


def _adam(state: list[np.ndarray], at, g: np.ndarray, turn: int, rate: float) -> np.ndarray:
    first, second = state
    first[at] = 0.9 * first[at] + 0.1 * g
    second[at] = 0.99 * second[at] + 0.01 * g * g
    return rate * (first[at] / (1 - 0.9 ** turn)) / (np.sqrt(second[at] / (1 - 0.99 ** turn)) + 1e-8)


def _features_out(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for flat, at in features(batch.column(1)):
                n = len(at) - 1
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, n), lists], schema=schema)
                done += n
    return run


def learn(docs: DataFrame, ratings: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          rating_id_col: str = "doc_id", grade: Column | None = None, n_grades: int = 3,
          rows: int = 40_000) -> Grader:
    """A grader from a bounded sample of rated documents.

    ``grade`` is a column of ``ratings`` with 0 (worst) to ``n_grades - 1``. At most about ``rows``
    ratings are used, chosen by a hash of the id; held-out ids (see ``language.held_out``) and null
    grades do not count, and of several ratings of one id the lowest does.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    grade = F.col("grade") if grade is None else grade
    rated = (ratings.select(F.col(rating_id_col).alias("id"), grade.cast("int").alias("grade"))
             .filter(F.col("id").isNotNull() & F.col("grade").between(0, n_grades - 1)
                     & ~held_out("id")).groupBy("id").agg(F.min("grade").alias("grade")))
    n = rated.count()
    sample = rated.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30))
                          < int((1 << 30) * min(1.0, rows / max(n, 1))))
    # Bounded by ``rows``, so the texts need no shuffle.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .join(F.broadcast(sample), "id").select("grade", "text")
    out = texts.select("grade", F.lit(None).cast("array<int>").alias("features")).schema
    table = texts.mapInArrow(_features_out(to_arrow_schema(out)), out).toArrow()
    lists = table.column("features").combine_chunks()
    lengths = np.array(lists.value_lengths()).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    grades = np.array(table.column("grade")).astype(np.int64)
    # The same order of rows whatever order the tasks ended in.
    marks = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
    order = np.lexsort((marks, lengths, grades)) if marks else np.empty(0, np.int64)
    flat = flat[ragged(bounds[order], lengths[order])]
    return fit_grades(flat, np.concatenate([[0], np.cumsum(lengths[order])]), grades[order], n_grades)


def grade_documents(docs: DataFrame, grader: Grader, *, id_col: str = "doc_id",
                    text_col: str = "text", tail: int | None = None, least: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, p_tail, keep) for every row, from its whole text.

    ``p_tail`` is the probability of grade ``tail`` (default: the top one) or better, and ``keep``
    whether it reaches ``least``. Null, empty and wordless texts are judged by their shapes alone.
    Rows that repeat an id are judged one by one, and equal texts alike. An empty table gives an
    empty result. Other columns are not looked at.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    tail = len(grader.thresholds) if tail is None else tail
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.select("doc_id", F.lit(0.0).alias("expected_grade"), F.lit(0.0).alias("p_tail"),
                      F.lit(False).alias("keep")).schema
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for flat, at in features(batch.column(1)):
                n = len(at) - 1
                scores = np.add.reduceat(grader.weights[flat], at[:-1])
                below = grader.at_most(scores)
                good = 1 - below[:, tail - 1] if tail else np.ones(n)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(done, n), pa.array((1 - below).sum(1)), pa.array(good),
                    pa.array(good >= least)], schema=schema)
                done += n

    return rows.mapInArrow(run, out)
