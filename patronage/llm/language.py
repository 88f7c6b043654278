"""Language identification by compression.

Each language has a zstandard dictionary of raw sample text. A text is compressed block by block
with every dictionary; the language whose dictionary leaves the fewest bytes wins, and the lead
over the runner-up says how sure that is. A short text leaves few bytes, so that languages would
often tie; it is also compressed with each of ``PARTS`` pieces of every sample, and the bytes are
added up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVEL = 5
BLOCK_CHARS = 4000
SHORT_CHARS = 400
PARTS = 16
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalised(text: str | None) -> str:
    """Letters in lower case, everything else as single spaces; empty without a letter."""
    return _NOT_LETTERS.sub(" ", (text or "").lower()).strip()


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


@dataclass(frozen=True)
class Languages:
    """Dictionaries by language, the most frequent language first."""

    names: tuple[str, ...]
    samples: tuple[bytes, ...]


def held_out(id_col: str, folds: int = 5) -> Column:
    """Whether a row takes no part in learning: crc32 of its id as text is 0 modulo ``folds``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", texts: int = 250, chars: int = 1000) -> Languages:
    """Dictionaries from a bounded sample of labelled rows that are not held out.

    Per language, ``texts`` documents chosen by a hash of the id give at most ``chars`` characters
    each, so a dictionary has at most ``texts * chars`` characters whatever the table's size. Rows
    without an id, a language or a text do not count.
    """
    usable = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                         F.col(text_col).alias("text")).filter(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))
    counts = {r["lang"]: r["rows"] for r in usable.groupBy("lang").agg(
        F.count("*").alias("rows")).collect()}
    if not counts:
        return Languages((), ())
    # About three times the rows needed pass a hash threshold; the exact number is cut from those.
    place = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 30))
    limits = F.create_map(*[x for lang, n in counts.items() for x in (
        F.lit(lang), F.lit(min(1 << 30, int((1 << 30) * (3 * texts + 50) / n))))])
    some = (usable.filter(place < F.element_at(limits, F.col("lang")))
            .filter(F.col("text").rlike(r"\p{L}"))
            .withColumn("place", place)
            .withColumn("turn", F.row_number().over(
                Window.partitionBy("lang").orderBy("place", "id", "text")))
            .filter(F.col("turn") <= texts)
            .select("lang", "turn", F.substring("text", 1, 2 * chars).alias("text")))
    found: dict[str, list[str]] = {}
    for row in sorted(some.collect(), key=lambda r: (r["lang"], -r["turn"])):
        found.setdefault(row["lang"], []).append(normalised(row["text"])[:chars])
    names = sorted(found, key=lambda k: (-counts[k], k))
    return Languages(tuple(names), tuple(" ".join(found[k]).encode() for k in names))


def _compressor(sample: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def _compressors(model: Languages) -> list[list[zstandard.ZstdCompressor]]:
    """Per language: one for the whole sample, and one for each of its pieces."""
    made = []
    for sample in model.samples:
        step = max(1, len(sample) // PARTS)
        made.append([_compressor(sample), *[
            _compressor(sample[i * step:(i + 1) * step] or sample) for i in range(PARTS)]])
    return made


def compressed_sizes(text: str, compressors: list) -> np.ndarray:
    """Bytes left of a normalised text per language."""
    if len(text) <= SHORT_CHARS:
        data = text.encode()
        return np.array([sum([len(c.compress(data)) for c in every]) for every in compressors],
                        np.int64)
    blocks = [text[i:i + BLOCK_CHARS].encode() for i in range(0, len(text), BLOCK_CHARS)]
    return np.array([sum([len(whole.compress(b)) for b in blocks]) for whole, *_ in compressors],
                    np.int64)


def judge(sizes: np.ndarray) -> tuple[int, float]:
    """(best, margin): the runner-up's bytes above the best, as a share of the runner-up's.

    Equal sizes go to the language that comes first, the more frequent one.
    """
    order = np.argsort(sizes, kind="stable")
    if len(sizes) == 1:
        return 0, 1.0
    best, second = sizes[order[0]], sizes[order[1]]
    return int(order[0]), float((second - best) / second)


def _predict(model: Languages, least: float, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(model)
        for batch in batches:
            names, scores, sure = [], [], []
            for value in batch.column(2):
                text = value.as_py()
                clean = normalised(text)
                if not compressors or not has_letter(clean):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    sure.append(False)
                    continue
                best, margin = judge(compressed_sizes(clean, compressors))
                names.append(model.names[best])
                scores.append(margin)
                sure.append(margin >= least)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(names, pa.string()),
                pa.array(scores, pa.float64()), pa.array(sure, pa.bool_())], schema=schema)
    return run


def identify(docs: DataFrame, model: Languages, *, id_col: str = "doc_id", text_col: str = "text",
             least_margin: float = 0.005) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) per row; only the whole text is looked at.

    ``score`` is the margin, 0 to 1; ``accepted`` is false where it is below ``least_margin`` or
    the language unknown. A null text, or one without a letter, is ``und`` with score 0, and so is
    every text if no language was learned. With a single language the margin is 1. A row without
    an id is judged like others and is not held out. An empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"),
                       F.col(text_col).alias("text"))
    out = rows.select("doc_id", "held_out", F.lit("").alias("lang_pred"),
                      F.lit(0.0).alias("score"), F.lit(False).alias("accepted")).schema
    return rows.mapInArrow(_predict(model, least_margin, to_arrow_schema(out)), out)


def accepted_documents(docs: DataFrame, model: Languages, *, id_col: str = "doc_id",
                       text_col: str = "text", least_margin: float = 0.005) -> DataFrame:
    """The rows whose language is accepted, with the columns of ``docs``; texts are not shuffled."""
    position = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(model)
        for batch in batches:
            keep = []
            for value in batch.column(position):
                clean = normalised(value.as_py())
                keep.append(bool(compressors) and has_letter(clean)
                            and judge(compressed_sizes(clean, compressors))[1] >= least_margin)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
