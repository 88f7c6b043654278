"""Periodic runs of words: where a text repeats itself at a fixed distance, and the text without it.

A run is a stretch of words, as long as possible, in which words a period apart are identical; its
period is the smallest such distance and it is at least ``least`` words and two periods long.

Periods are searched by octave, [P, 2P). For each octave a document is exploded into tiles of words
that overlap by what a run of that octave needs, with cuts at regular places inside. A run of period
p contains a cut c with c + p also inside, so it shows in the Z-values at the cut: how far the words
from c on equal those from c + p on, and how far the words before c equal those before c + p. Both
are read from hashes of 1, 2, 4, ... words, and only where a block of words next to the cut equals
the one a period later, which no run can lack. What a tile finds is an interval, cut off where the
tile's knowledge ends; intervals of the same document and period that overlap by a period are one
run and are stitched by Spark after a shuffle by document and period.

Tiles are solved where their document is read: as rows they would be some sixty times the text. What
is shuffled are intervals, already merged within their tile, and the texts of documents that have
any. Words are compared by 64-bit hashes. Memory of a task is one tile's hashes, a few hundred bytes
a word of at most ``TILE_WORDS`` or four periods.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from patronage.llm.texts import mix64, pieces, text_bytes, word_hashes
from patronage.session import settle

TILE_WORDS = 1 << 18
# Comparisons made at once, which bounds the memory of one step.
CELLS = 1 << 17
# Texts whose words are hashed together; a longer text is taken alone.
PIECE_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class _Blocks:
    """Hashes of all blocks of 1, 2, 4, ... words of an array of word hashes, made when asked for."""

    def __init__(self, words: np.ndarray):
        self.levels = [words]

    def at(self, level: int) -> np.ndarray:
        while len(self.levels) <= level:
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            wide = len(last) - half
            self.levels.append(mix64(last[:wide] * _BASE + last[half:]) if wide > 0
                               else np.empty(0, np.uint64))
        return self.levels[level]

    def equal(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the blocks that begin at i and j are equal; false for a place that has none."""
        block = self.at(level)
        if not len(block):
            return np.zeros(np.broadcast_shapes(i.shape, j.shape), bool)
        inside = (i >= 0) & (j >= 0) & (i < len(block)) & (j < len(block))
        return inside & (block.take(i, mode="clip") == block.take(j, mode="clip"))

    def z_after(self, i: np.ndarray, j: np.ndarray, room: np.ndarray, top: int) -> np.ndarray:
        """How many words from i on equal those from j on, at most ``room``."""
        got = np.zeros(len(i), np.int64)
        for level in range(top, -1, -1):
            size = 1 << level
            got += size * ((got + size <= room) & self.equal(level, i + got, j + got))
        return got

    def z_before(self, i: np.ndarray, j: np.ndarray, room: np.ndarray, top: int) -> np.ndarray:
        """How many words before i equal those before j, at most ``room``."""
        got = np.zeros(len(i), np.int64)
        for level in range(top, -1, -1):
            size = 1 << level
            got += size * ((got + size <= room)
                           & self.equal(level, i - got - size, j - got - size))
        return got


def _needed(period: np.ndarray | int, least: int) -> np.ndarray:
    """How many words of a run have another one a period later, at least."""
    return np.maximum(least, 2 * period) - period


def _step(first: int, least: int) -> int:
    """Cuts so far apart that every run with a period in [first, 2 * first) holds one."""
    if 2 * first >= least:
        return first
    return int(min(_needed(p, least) for p in range(first, min(2 * first, least))))


def _smallest_factors(limit: int) -> np.ndarray:
    factor = np.arange(limit)
    for i in range(2, int(limit ** 0.5) + 1):
        if factor[i] == i:
            rest = factor[i * i::i]
            factor[i * i::i] = np.where(rest == np.arange(i * i, limit, i), i, rest)
    return factor


def _primitive(blocks: _Blocks, start: np.ndarray, period: np.ndarray, level: int) -> np.ndarray:
    """Whether no part of the period is a period too. ``level``: of the octave's lowest period.

    An interval of two periods has a smaller period only if that divides the period, so it is
    enough to try the period divided by each of its prime factors.
    """
    out = np.ones(len(start), bool)
    if not len(start):
        return out
    factor = _smallest_factors(int(period.max()) + 1)
    rest, size = period.copy(), 1 << level
    while True:
        open_ = rest > 1
        if not open_.any():
            return out
        prime = np.where(open_, factor[rest], 1)
        part = period // prime
        repeats = open_
        for at in (start, start + period - size):  # two blocks that cover the period
            repeats = repeats & blocks.equal(level, at, at + part)
        out &= ~repeats
        rest = np.where(open_, rest // prime, rest)


def solve_tiles(blocks: _Blocks, low: np.ndarray, high: np.ndarray, cut_from: np.ndarray,
                cut_to: np.ndarray, first: int, least: int) -> tuple[np.ndarray, ...]:
    """(tile, period, start, end) of the intervals that the cuts of the tiles show.

    A tile knows the words in [low, high) and has cuts in [cut_from, cut_to).
    """
    step, reach = _step(first, least), max(2 * first, least)
    level = first.bit_length() - 1
    near = max(0, ((step + 1) // 2).bit_length() - 1)  # one side of a cut has at least half
    top = reach.bit_length() - 1
    counts = np.maximum(0, -(-(cut_to - cut_from) // step))
    tile = np.repeat(np.arange(len(low)), counts)
    cuts = cut_from[tile] + step * (np.arange(len(tile)) - (np.cumsum(counts) - counts)[tile])
    fits = cuts + first <= high[tile]
    tile, cuts = tile[fits], cuts[fits]
    found = []
    offsets, size, chunk = np.arange(first, 2 * first), 1 << near, max(1, CELLS // first)
    for a in range(0, len(cuts), chunk):
        c, t = cuts[a:a + chunk, None], tile[a:a + chunk]
        lo, hi = low[t][:, None], high[t][:, None]
        later = c + offsets
        hit = blocks.equal(near, c, later) & (later + size <= hi)
        hit |= blocks.equal(near, c - size, later - size) & (c - size >= lo) & (later <= hi)
        row, column = np.nonzero(hit)
        if not len(row):
            continue
        t, c, period = t[row], cuts[a:a + chunk][row], offsets[column]
        after = blocks.z_after(c, c + period, np.minimum(reach, high[t] - c - period), top)
        before = blocks.z_before(c, c + period, np.minimum(reach, c - low[t]), top)
        keep = before + after >= _needed(period, least)
        t, period = t[keep], period[keep]
        start, end = (c - before)[keep], (c + after)[keep] + period
        keep = _primitive(blocks, start, period, level)
        found.append((t[keep], period[keep], start[keep], end[keep]))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found))


def _merged(doc: np.ndarray, period: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Intervals (doc, start, end, period) after those that overlap by a period have become one."""
    order = np.lexsort((end, start, period, doc))
    doc, period, start, end = doc[order], period[order], start[order], end[order]
    if not len(doc):
        return np.empty((0, 4), np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (period[1:] != period[:-1]) | (start[1:] > end[:-1] - period[1:])
    heads = np.flatnonzero(new)
    out = np.stack([doc[heads], start[heads], np.maximum.reduceat(end, heads), period[heads]], 1)
    return out[np.argsort(out[:, 0], kind="stable")]


def intervals(words: np.ndarray, bounds: np.ndarray, least: int) -> np.ndarray:
    """Rows (document, start, end, period) that the tiles of each document give, by document.

    Documents of one tile share their block hashes; a longer one is solved tile by tile.
    """
    sizes, found = np.diff(bounds), []
    shared = _Blocks(words)
    first = 1
    while len(sizes) and max(least, 2 * first) <= sizes.max():
        step, reach = _step(first, least), max(2 * first, least)
        core = max(TILE_WORDS, 4 * first, 2 * least) // step * step
        some = np.flatnonzero((sizes >= max(least, 2 * first)) & (sizes <= core))
        low, high = bounds[some], bounds[some + 1]
        tile, period, start, end = solve_tiles(shared, low, high, low, high, first, least)
        found.append((some[tile], period, start - low[tile], end - low[tile]))
        for doc in np.flatnonzero(sizes > core):
            own = words[bounds[doc]:bounds[doc + 1]]
            for at in range(0, len(own), core):
                lo, hi = max(0, at - reach), min(len(own), at + core + 2 * first + reach)
                place = [np.array([x - lo]) for x in (lo, hi, at, min(at + core, len(own)))]
                _, period, start, end = solve_tiles(_Blocks(own[lo:hi]), *place, first, least)
                found.append((np.full(len(period), doc), period, start + lo, end + lo))
        first *= 2
    if not found:
        return np.empty((0, 4), np.int64)
    return _merged(*(np.concatenate(x) for x in zip(*found)))


def _shown(words: list[bytes], form: str) -> str:
    text = b" ".join(words)
    return hashlib.sha256(text).hexdigest() if form == "sha256" else text.decode()


def _finder(schema: pa.Schema, least: int, form: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            for a, b in pieces(bounds, PIECE_BYTES):
                raw, own = data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a]
                words, word_bounds = word_hashes(raw, own, fold=None)
                rows = intervals(words, word_bounds, least)
                counts = np.bincount(rows[:, 0], minlength=b - a)
                texts = [raw[x:y].tobytes() for x, y in zip(own.tolist(), own[1:].tolist())]
                spans = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in (1, 2, 3)],
                                               ["start", "end", "period"]))
                busy = counts > 0
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(at, at + b - a)), batch.column(0).slice(a, b - a),
                    pa.array(np.diff(word_bounds)),
                    pa.array([None if x else _shown(t.split(), form)
                              for x, t in zip(busy.tolist(), texts)], pa.string()),
                    pa.array([t.decode() if x else None for x, t in zip(busy.tolist(), texts)],
                             pa.string()), spans.cast(schema.field(5).type)], schema=schema)
                at += b - a
    return run


def _collapser(schema: pa.Schema, form: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = text.encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                for r in runs:
                    edge[r["start"] + r["period"]] += 1
                    edge[r["start"] + r["length"]] -= 1
                kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
                out.append(_shown([words[i] for i in kept], form))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3).cast(schema.field(2).type),
                 pa.array(out, pa.string())], schema=schema)
    return run


def stitched(found: DataFrame) -> DataFrame:
    """(row, start, length, period) from intervals (row, start, end, period).

    Intervals of the same row and period belong to one run if they overlap by a period.
    """
    along = Window.partitionBy("row", "period").orderBy("start", "end")
    apart = F.coalesce(F.col("start") > F.lag("end").over(along) - F.col("period"), F.lit(True))
    return (found.withColumn("_new", apart.cast("int"))
            .withColumn("_run", F.sum("_new").over(along))
            .groupBy("row", "period", "_run").agg(F.min("start").alias("start"), F.max("end").alias("_end"))
            .select("row", "start", (F.col("_end") - F.col("start")).alias("length"), "period"))


def periodic_runs(docs: DataFrame, *, least: int = 12, collapsed: str = "text",
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) of every row.

    Words are separated by white space (tab to carriage return, and space). ``runs`` are
    (start, length, period), ordered by start, then period, starts counted in words from 0.
    ``collapsed`` is the text of the words, joined by one space, without those that stand in a run
    after its first period; with ``collapsed="sha256"`` it is that text's checksum, which spares
    carrying the texts.

    Null, empty and blank texts have no words, no runs and an empty text. Rows that repeat an id,
    and rows without one, are judged one by one. Other columns are not read. An empty table gives
    an empty one.
    """
    if collapsed not in ("text", "sha256"):
        raise ValueError(f"collapsed must be 'text' or 'sha256', got {collapsed!r}")
    kept = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    spark, id_type = docs.sparkSession, kept.schema["id"].dataType.simpleString()

    def arrow(ddl: str) -> pa.Schema:
        return to_arrow_schema(spark.createDataFrame([], ddl).schema)

    shape = (f"row bigint, id {id_type}, n_words bigint, collapsed string, text string, "
             "found array<struct<start:bigint,end:bigint,period:bigint>>")
    first = settle(kept.mapInArrow(_finder(arrow(shape), least, collapsed), shape))
    busy = F.col("text").isNotNull()
    runs = (stitched(first.filter(busy).select("row", F.explode("found").alias("_f"))
                     .select("row", "_f.*"))
            .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period")))
                                .alias("runs")))
    shape = f"id {id_type}, n_words bigint, runs {RUNS}, collapsed string"
    repeated = (first.filter(busy).join(runs, "row").select("id", "n_words", "text", "runs")
                .mapInArrow(_collapser(arrow(shape), collapsed), shape))
    plain = first.filter(~busy).select("id", "n_words", F.array().cast(RUNS).alias("runs"), "collapsed")
    return plain.unionByName(repeated).withColumnRenamed("id", id_col)


def planted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every tenth text, by the checksum of its id, made periodic from some word on.

    With h the checksum, g = h // 10 and n words, the words from a = g % n on repeat the first
    1 + (n - a) // (3 + g % 8) of them. Rows without id or without words stay as they are.
    """
    words = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    periodic = F.array_join(F.slice(F.concat(F.slice(words, 1, a), cycle), 1, n), " ")
    return docs.withColumn(text_col, F.when((h % 10 == 0) & (n > 0), periodic)
                           .otherwise(F.col(f"`{text_col}`")))
