"""Benchmark decontamination with Wu-Manber search for many word sequences at once.

Every window of ``window`` consecutive item words is a pattern, over words instead of letters.
Patterns of one length are searched together. Standing at a document word, the block of the two
words that end there is looked up: the shift table says how far the next possible end of a pattern
is, a block or word in no pattern lets the search skip a whole pattern, and a block that ends
patterns leads to their bucket, where all words are compared directly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERN_BYTES = 2 << 20
_WORD = bytes([*range(48, 58), *range(97, 123)])
# ASCII signs become spaces, A-Z become a-z; the bytes of all other characters stay.
_CLEAN = bytes(c if c in _WORD or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_CLEAN).split() if text else []


class _Search:
    """Shift table and buckets of the windows of one length.

    Words of the items are numbered; a block of two words is one number. A bucket holds the places
    (item, start) of its windows, and a window is compared with the item's own words.
    """

    def __init__(self, length: int, window: int, items: list[tuple[object, list[bytes]]]):
        self.length = length
        self.items = [(name, w) for name, w in items if min(window, len(w)) == length]
        self.number: dict[bytes, int] = {}
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list[tuple[int, int]]] = {}
        single = length == 1
        for item, (_, words) in enumerate(self.items):
            ids = [self.number.setdefault(w, len(self.number)) for w in words]
            for start in range(len(words) - length + 1):
                for at in range(start + (not single), start + length):
                    key = ids[at] if single else ids[at - 1] << 32 | ids[at]
                    left = start + length - 1 - at
                    if self.shift.get(key, length) > left:
                        self.shift[key] = left
                self.buckets.setdefault(key, []).append((item, start))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list]]:
        """(start, names of the items) of every occurrence."""
        at, n, length, number, shift = self.length - 1, len(words), self.length, self.number, self.shift
        while at < n:
            last = number.get(words[at])
            if last is None:  # no window holds this word
                at += length
                continue
            if length == 1:
                key = last
            else:
                before = number.get(words[at - 1])
                if before is None:
                    at += length - 1
                    continue
                key = before << 32 | last
            step = shift.get(key, max(length - 1, 1))
            if not step:
                start = at - length + 1
                here = words[start:at + 1]
                names = [self.items[item][0] for item, first in self.buckets[key]
                         if self.items[item][1][first:first + length] == here]
                if names:
                    yield start, names
                step = 1
            at += step


def compile_items(items: Iterable[tuple[object, str | None]], window: int) -> list[_Search]:
    """Searches for the windows of the items, one per pattern length."""
    worded = [(name, words_of(text)) for name, text in items]
    lengths = {min(window, len(w)) for _, w in worded if w}
    return [_Search(n, window, worded) for n in sorted(lengths)]


_compiled: dict[tuple, list[_Search]] = {}


def _searches(block: tuple, window: int) -> list[_Search]:
    """The tables of a block, built once per worker; tasks carry the texts alone."""
    key = block, window
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = compile_items(block, window)
    return _compiled[key]


def _scan(block: tuple, window: int, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = _searches(block, window)
        for batch in batches:
            counts, spans, names = [], [], []
            for text, old_spans, old_names in zip(*(batch.column(i) for i in (1, 2, 3))):
                words = words_of(text.as_py())
                found: list[list[int]] = list(old_spans.as_py())
                items = set(old_names.as_py())
                for search in searches:
                    for start, who in search.find(words):
                        items.update(str(w) for w in who if w is not None)
                        if found and found[-1][0] <= start <= found[-1][1]:
                            found[-1][1] = max(found[-1][1], start + search.length)
                        else:
                            found.append([start, start + search.length])
                counts.append(len(words))
                spans.append(found)
                names.append(sorted(items))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(spans, schema.field(2).type),
                pa.array(names, schema.field(3).type), pa.array(counts, pa.int64())], schema=schema)
    return run


def _covered(spans: list[list[int]]) -> int:
    total = reach = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def _report(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [_covered(s) for s in batch.column(2).to_pylist()]
            names = batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(4), pa.array(hits, pa.int64()),
                pa.array([len(n) for n in names], pa.int64()),
                pa.array([hashlib.sha256(",".join(n).encode()).hexdigest() for n in names]),
                pa.array([h > 0 for h in hits]), batch.column(3), batch.column(2)], schema=schema)
    return run


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple]:
    """The benchmark's items in blocks of at most ``PATTERN_BYTES`` of text (or one longer item).

    Each block costs one more search of the documents, in the same tasks; its tables take about
    50 times its size in a worker.
    """
    block, size = [], 0
    items = benchmark.select(F.col(id_col), F.col(text_col)).filter(F.col(text_col) != "")
    for name, text in items.toLocalIterator():
        if block and size + len(text) > PATTERN_BYTES:
            yield tuple(block)
            block, size = [], 0
        block.append((name, text))
        size += len(text)
    if block:
        yield tuple(block)


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  window: int = 10) -> DataFrame:
    """What of the benchmark occurs in every document.

    Returns (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans): words,
    words inside any occurrence, items with occurrences, the digest of their sorted ids, and the
    occurrences as word ranges (start, end). Words are runs of digits, a-z after folding A-Z, and
    characters beyond ASCII. An item of fewer words than ``window`` is one window.

    Null and wordless texts have no words and no hits; null and wordless items have no windows; an
    item without an id marks words but is not listed. Rows that repeat an id are judged one by
    one, repeated items count once. An empty benchmark leaves all documents clean. Other columns
    are not looked at. Documents are not shuffled; the patterns travel with the code in blocks.
    """
    spark = docs.sparkSession
    from pyspark.sql.pandas.types import to_arrow_schema
    state = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                        F.lit(None).cast("array<array<bigint>>").alias("spans"),
                        F.lit(None).cast("array<string>").alias("items"),
                        F.lit(0).cast("bigint").alias("n_words"))
    state = state.withColumns({"spans": F.coalesce("spans", F.array().cast("array<array<bigint>>")),
                               "items": F.coalesce("items", F.array().cast("array<string>"))})
    id_type = state.schema["doc_id"].dataType.simpleString()
    between = spark.createDataFrame([], f"doc_id {id_type}, text string, spans "
                                    "array<array<bigint>>, items array<string>, n_words bigint")
    for block in list(item_blocks(benchmark, item_col, item_text_col)) or [()]:
        state = state.mapInArrow(
            _scan(block, window, to_arrow_schema(between.schema)), between.schema)
    out = spark.createDataFrame(
        [], f"doc_id {id_type}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
        "contaminated boolean, items array<string>, spans array<array<bigint>>")
    return state.mapInArrow(_report(to_arrow_schema(out.schema)), out.schema)


def _occurs(searches: list[_Search], words: list[bytes]) -> bool:
    return any(next(search.find(words), None) for search in searches)


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text",
                    window: int = 10) -> DataFrame:
    """The rows in which no window occurs, with the columns of ``docs``; nothing is shuffled.

    Occurrences are those of ``contamination``. Rows with a null or wordless text stay.
    """
    position = docs.columns.index(text_col)

    def keep(block: tuple) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searches = _searches(block, window)
            for batch in batches:
                yield batch.filter(pa.array(
                    [not _occurs(searches, words_of(t.as_py())) for t in batch.column(position)],
                    pa.bool_()))
        return run

    out = docs
    for block in item_blocks(benchmark, item_col, item_text_col):
        out = out.mapInArrow(keep(block), docs.schema)
    return out
