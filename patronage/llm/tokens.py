"""Token ids of documents, Re-Pair compressed per shard, written and read as a table of shards.

File format: a Parquet table with one row per shard of about ``SHARD_TOKENS`` ids, in document
order. ``part`` and ``shard`` order the rows, ``before`` counts the ids of the part's earlier shards;
``ids`` names the shard's documents, ``tokens`` says
how many ids each has, ``first_symbol`` where its symbols begin. ``rules`` holds, for nonterminal
``FIRST_RULE + i``, the two symbols it stands for, and ``expansion`` how many ids that is; a
document's ids are found by expanding its symbols alone. Symbols, and the two sides of a rule, are
little-endian unsigned 16-bit integers, expansion lengths unsigned 32-bit. Rules never cross the end
of a document.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patronage.llm.texts import pieces, ragged, span_hashes, text_bytes

FIRST_RULE = 50_257
LAST_SYMBOL = 65_535
SHARD_TOKENS = 1 << 20
END_ID = 0
TABLE = 1 << 18

# Known words have two possible slots each in a table; all are forgotten after so many were learned.
WORD_LIMIT = 2_000_000
WORD_SLOTS = 1 << 21
WORDS_AT_ONCE = 1_000
PIECE_BYTES = 1 << 20

# Classes of bytes: letter, digit, other, white space, and bytes the fast path leaves alone.
_LETTER, _DIGIT, _OTHER, _SPACE, _ALIEN = range(5)
_CLASS = np.full(256, _ALIEN, np.int8)
_CLASS[:128] = _OTHER
_CLASS[[*range(48, 58)]] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[39, 28, 29, 30, 31]] = _ALIEN  # an apostrophe may begin a contraction
_encoders: dict[str, "_Encoder"] = {}


class _Encoder:
    """A vocabulary with the ids of the words it has met.

    The vocabulary's first step cuts a text into words (a run of letters, digits or other signs,
    with a space before it) and single white-space characters; each is encoded alone. For texts of
    ASCII and the Latin letters of U+00C0 to U+00FF without apostrophes and without wider white
    space that cut follows from byte classes, so every distinct word is encoded once and found
    again by a 64-bit hash and its length. All other texts, and those that hold one of the
    vocabulary's added tokens, are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode()
                      for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Bytes of each id: the byte-level alphabet has one character a byte.
        names = self.tokenizer.get_vocab()
        self.widths = np.zeros(max(names.values(), default=0) + 1, np.int64)
        for name, code in names.items():
            self.widths[code] = len(name)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(WORD_SLOTS, np.uint64)
        self.first = np.zeros(WORD_SLOTS, np.int32)
        self.count = np.zeros(WORD_SLOTS, np.int32)  # 0: a free slot
        self.flat, self.used, self.known = np.empty(1 << 16, np.uint16), 0, 0

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has.

        Words are handed over in groups, each encoded alone. The ids of a word have as many bytes
        as the word, which tells where it ends.
        """
        groups = [words[i:i + WORDS_AT_ONCE] for i in range(0, len(words), WORDS_AT_ONCE)]
        ids = np.fromiter(itertools.chain.from_iterable(
            e.ids for e in self.tokenizer.encode_batch_fast(
                groups, is_pretokenized=True, add_special_tokens=False)), np.uint16)
        ends = np.cumsum(self.widths[ids])
        last = np.cumsum(np.fromiter((len(w.encode()) for w in words), np.int64, len(words)))
        upto = np.searchsorted(ends, last, "right")
        if len(ids) and upto[0] and np.array_equal(ends[upto - 1], last):
            return ids, np.diff(upto, prepend=0)
        each = self.plain(words)
        return (np.fromiter(itertools.chain.from_iterable(each), np.uint16),
                np.fromiter(map(len, each), np.int64, len(each)))

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = np.uint64(WORD_SLOTS - 1)
        return (keys & last).astype(np.int64), ((keys >> np.uint64(32)) & last).astype(np.int64)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word begin and how many it has; 0 of a word that is not known."""
        one, two = self._slots(keys)
        slot = np.where(self.keys[one] == keys, one, two)
        return self.first[slot].astype(np.int64), np.where(
            self.keys[slot] == keys, self.count[slot], 0).astype(np.int64)

    def _learn(self, keys: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What ``_find`` gives for new words, of which each pushes out another one at most."""
        ids, counts = self._word_ids(words)
        if self.used + len(ids) > len(self.flat):
            wider = np.empty(max(2 * len(self.flat), self.used + len(ids)), np.uint16)
            wider[:self.used] = self.flat[:self.used]
            self.flat = wider
        first = self.used + np.cumsum(counts) - counts
        self.flat[self.used:self.used + len(ids)] = ids
        self.used, self.known = self.used + len(ids), self.known + len(words)
        one, two = self._slots(keys)
        slot = np.where((self.count[one] > 0) & (self.count[two] == 0), two, one)
        # Of new words that share a slot one stays, in all three arrays the same.
        slot, kept = np.unique(slot, return_index=True)
        self.keys[slot], self.first[slot], self.count[slot] = keys[kept], first[kept], counts[kept]
        return first, counts

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of one piece of UTF-8 bytes."""
        texts, n = len(bounds) - 1, len(data)
        if not n:
            return [np.empty(0, np.uint16)] * texts
        kind = _CLASS[data]
        after_c3 = np.zeros(n, bool)
        after_c3[1:] = data[:-1] == 0xC3
        latin = (data == 0xC3) | (after_c3 & (data >= 0x80) & (data <= 0xBF)
                                  & (data != 0x97) & (data != 0xB7))
        kind[latin] = _LETTER
        first = np.zeros(n + 1, bool)
        first[bounds] = True
        space = kind == _SPACE
        odd = kind == _ALIEN
        odd[1:] |= space[1:] & space[:-1] & ~first[1:-1]
        text_odd = np.diff(np.concatenate([[0], np.cumsum(odd)])[bounds]) > 0
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                text_odd[np.searchsorted(bounds, at, "right") - 1] = True
                at = raw.find(token, at + 1)
        begins = first[:-1] | space
        begins[1:] |= kind[1:] != kind[:-1]
        # A single space before another character of its text belongs to the word it precedes.
        joins = np.zeros(n, bool)
        joins[:-1] = (data[:-1] == 0x20) & ~first[1:-1]
        begins[1:] &= ~joins[:-1]
        start = np.flatnonzero(begins)
        end = np.append(start[1:], n)
        keys = span_hashes(data, start, end) ^ (end - start).astype(np.uint64)
        if self.known > WORD_LIMIT:
            self.forget()
        places, counts = self._find(keys)
        new = np.flatnonzero(counts == 0)
        if len(new):
            distinct, sample, which = np.unique(keys[new], return_index=True, return_inverse=True)
            at = new[sample]
            learned = self._learn(distinct, [raw[a:b].decode("utf-8", "replace") for a, b in zip(
                start[at].tolist(), end[at].tolist())])
            places[new], counts[new] = (x[which] for x in learned)
        ids = self.flat[ragged(places, counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        cuts = total[np.searchsorted(start, bounds)].tolist()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        if text_odd.any():
            odd_texts = np.flatnonzero(text_odd).tolist()
            whole = [data[bounds[i]:bounds[i + 1]].tobytes().decode() for i in odd_texts]
            for i, code in zip(odd_texts, self.plain(whole)):
                out[i] = np.array(code, np.uint16)
        return out


def encode_column(path: str, column: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each text of a column as 16-bit integers; null is an empty text."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    data, bounds = text_bytes(column)
    for a, b in pieces(bounds, PIECE_BYTES):
        yield from _encoders[path].encode(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a])


def _slots(pairs: np.ndarray) -> np.ndarray:
    return (pairs * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE.bit_length() + 1)


def repair(symbols: np.ndarray, rounds: int = 4, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair: (what is left, rules as rows of two symbols).

    Each round counts the pairs of neighbours and gives the most frequent ones nonterminals, best
    first, as long as a pair occurs ``least`` times and 16-bit symbols are free. Occurrences are
    replaced from left to right without overlap. The end id takes part in no pair.
    """
    rules: list[np.ndarray] = []
    free = LAST_SYMBOL + 1 - FIRST_RULE
    made = 0
    for turn in range(rounds):
        room = (free - made) // (rounds - turn)
        if len(symbols) < 2 or room <= 0:
            break
        left, right = symbols[:-1], symbols[1:]
        pairs = left.astype(np.uint32) << np.uint32(16) | right
        inner = (left != END_ID) & (right != END_ID)
        ordered = np.sort(pairs[inner])
        edges = np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]))
        counts = np.diff(edges, append=len(ordered))
        enough = np.flatnonzero(counts >= least)
        if not len(enough):
            break
        best = enough[np.lexsort((ordered[edges[enough]], -counts[enough]))][:room]
        chosen = ordered[edges[best]]
        slot = _slots(chosen)
        table = np.zeros(TABLE, np.int32)
        table[slot[::-1]] = np.arange(len(chosen), dtype=np.int32)[::-1]
        chosen = chosen[table[slot] == np.arange(len(chosen))]  # of a shared slot the best stays
        table[_slots(chosen)] = np.arange(len(chosen), dtype=np.int32)
        place = table[_slots(pairs)]
        hit = np.flatnonzero((chosen[place] == pairs) & inner)
        # In a run of overlapping occurrences every second one, from the left, is replaced.
        run_start = np.diff(hit, prepend=-2) != 1
        first = np.maximum.accumulate(np.where(run_start, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
        symbols = symbols.copy()
        symbols[hit] = FIRST_RULE + made + place[hit]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        symbols = symbols[keep]
        rules.append(np.stack([chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)], 1)
                     .astype("<u2"))
        made += len(chosen)
    return symbols, np.concatenate(rules) if rules else np.empty((0, 2), "<u2")


def expansion_lengths(rules: np.ndarray) -> np.ndarray:
    """How many ids each symbol up to the last nonterminal stands for."""
    lengths = np.ones(FIRST_RULE + len(rules), np.uint32)
    for i, (a, b) in enumerate(rules.tolist()):
        lengths[FIRST_RULE + i] = lengths[a] + lengths[b]
    return lengths


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for; the last rules are undone first."""
    while len(rules) and len(symbols) and int(symbols.max()) >= FIRST_RULE:
        which = np.flatnonzero(symbols >= FIRST_RULE)
        sides = rules[symbols[which] - FIRST_RULE]
        step = np.ones(len(symbols), np.int64)
        step[which] = 2
        at = np.cumsum(step) - step
        wider = np.empty(int(step.sum()), symbols.dtype)
        wider[at] = symbols
        wider[at[which]] = sides[:, 0]
        wider[at[which] + 1] = sides[:, 1]
        symbols = wider
    return symbols


def _shard(ids: list, encoded: list[np.ndarray]) -> dict:
    tokens = np.array([len(e) + 1 for e in encoded], np.int64)
    end = np.array([END_ID], np.uint16)
    flat = np.concatenate([x for e in encoded for x in (e, end)]) if encoded else end[:0]
    # Id 0 may also be an ordinary id of a text; only the last id of a document ends it.
    ends = np.cumsum(tokens) - 1
    symbols, rules = repair(flat)
    lengths = expansion_lengths(rules)
    reach = np.cumsum(lengths[symbols].astype(np.int64))
    first = np.concatenate([[0], np.searchsorted(reach, ends + 1)[:-1] + 1]) if len(ids) else ends
    return {"ids": ids, "tokens": tokens.tolist(), "first_symbol": first.tolist(),
            "rules": rules.tobytes(), "expansion": lengths[FIRST_RULE:].astype("<u4").tobytes(),
            "symbols": symbols.astype("<u2").tobytes()}


def _encoder(path: str, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        ids: list = []
        encoded: list[bytes] = []
        held = before = 0

        def flush() -> pa.RecordBatch:
            row = {"part": part, "shard": shard, "before": before, **_shard(ids, encoded)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for key, code in zip(batch.column(0).to_pylist(), encode_column(path, batch.column(1))):
                if held and held + len(code) + 1 > SHARD_TOKENS:
                    yield flush()
                    before, shard = before + held, shard + 1
                    ids, encoded, held = [], [], 0
                ids.append(key)
                encoded.append(code)
                held += len(code) + 1
        if ids:
            yield flush()
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Encode every whole text, append the end id, and write shards in ascending id order.

    Null and empty texts have the end id alone. Null ids come first; rows that repeat an id stand
    next to each other, ordered by text. An empty table writes an empty table. The ids of a
    vocabulary above 50,257 do not fit this format.
    """
    kept = docs.select(F.col(id_col).alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = kept.schema["id"].dataType.simpleString()
    schema = (f"part int, shard int, before bigint, ids array<{id_type}>, tokens array<bigint>, "
              "first_symbol array<bigint>, rules binary, expansion binary, symbols binary")
    arrow = _arrow_schema(docs.sparkSession, schema)
    (kept.repartitionByRange("id").sortWithinPartitions("id", "text")
     .mapInArrow(_encoder(tokenizer_path, arrow), schema).write.parquet(path))


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def shard_ids(rules: bytes, symbols: bytes) -> np.ndarray:
    """All ids of one shard."""
    pairs = np.frombuffer(rules, "<u2").reshape(-1, 2)
    return expand(np.frombuffer(symbols, "<u2"), pairs, None)


def document_ids(shard: dict, position: int) -> np.ndarray:
    """The ids of one document of a shard, expanding its symbols alone."""
    pairs = np.frombuffer(shard["rules"], "<u2").reshape(-1, 2)
    symbols = np.frombuffer(shard["symbols"], "<u2")
    bounds = [*shard["first_symbol"], len(symbols)]
    return expand(symbols[bounds[position]:bounds[position + 1]], pairs, None)


def _decoder(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                value = {n: row.column(i)[0] for i, n in enumerate(row.schema.names)}
                wide = shard_ids(value["rules"].as_py(), value["symbols"].as_py()).astype("<u4")
                tokens = np.array(value["tokens"].as_py(), np.int64)
                ends = np.cumsum(tokens)
                starts = ends - tokens
                raw = memoryview(wide.tobytes())
                sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                base = value["before"].as_py()
                yield pa.RecordBatch.from_arrays(
                    [value["ids"].values, pa.array(starts + base), pa.array(tokens),
                     pa.array(sums, pa.int64())], schema=schema)
    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the written shards.

    ``start`` counts the ids of all documents before it: in earlier parts, which one row per
    written part tells, in earlier shards of the part, and before it in its shard.
    """
    shards = spark.read.parquet(path)
    held = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, b: a + b)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.max(F.col("before") + held).alias("held")).select(
        "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("part_before"))
    id_type = shards.schema["ids"].dataType.elementType.simpleString()
    schema = f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint"
    arrow = _arrow_schema(spark, schema)
    return (shards.join(F.broadcast(parts), "part")
            .select("ids", "tokens", "rules", "symbols",
                    (F.col("before") + F.col("part_before")).alias("before"))
            .mapInArrow(_decoder(arrow), schema))
