"""WARC files: reading, writing, and derivatives of response records.

A record is a row (record_id, kind, target_uri, date, refers_to, concurrent_to, content_type, block,
block_digest, payload_digest, extra), with ``extra`` holding any other named fields. Derivatives of a
response are a metadata record about it and a conversion record with its plain text, both of which
name it by id, address and date.

Files are written by Spark's text writer, one record after the other; the two line breaks that end a
record are the writer's separator. They are read in pieces that begin with the version line, one
piece at a time, and a block with such a line of its own is put together again by its stated length.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import html
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

VERSION = "WARC/1.1"
BREAK = "\r\n"
END = BREAK + BREAK
# Fixed value: the alphabet of base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# What a page loses whole, what separates its lines, and what else is markup.
_HIDDEN = re.compile(r"<!--.*?-->|<(?:script|style|title|noscript)[^>]*>.*?"
                     r"</(?:script|style|title|noscript) *>", re.I | re.S)
_BLOCKS = frozenset(
    "p div h1 h2 h3 h4 h5 h6 li ul ol table tr td th article section header footer nav aside main form "
    "blockquote pre br hr".split())
_NAME = re.compile(r"/?(\w+)", re.A)
BATCH_BYTES = 4 << 20
NAMED = {"WARC-Record-ID": "record_id", "WARC-Type": "kind", "WARC-Target-URI": "target_uri",
         "WARC-Date": "date", "WARC-Refers-To": "refers_to",
         "WARC-Concurrent-To": "concurrent_to", "Content-Type": "content_type",
         "WARC-Block-Digest": "block_digest", "WARC-Payload-Digest": "payload_digest"}


def digest(data: Column) -> Column:
    """``sha1:`` and the SHA-1 of text or bytes in base 32: eight groups of five hex digits."""
    letters = F.array(*[F.lit(c) for c in BASE32])

    def spelled(hexed: Column) -> Column:
        def group(i: int) -> Column:
            return F.conv(F.substring(hexed, i * 5 + 1, 5), 16, 10).cast("int")
        return F.concat(F.lit("sha1:"), *[
            F.get(letters, F.shiftright(group(i), 15 - 5 * k).bitwiseAND(31))
            for i in range(8) for k in range(4)])

    # Inside a lambda the hash is a value, which is computed once.
    return F.get(F.transform(F.array(F.sha1(data.cast("binary"))), spelled), F.lit(0))


def record_id(*parts: Column) -> Column:
    """A ``urn:uuid`` that depends on the parts alone."""
    h = F.md5(F.array_join(F.array(*[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]), "\n"))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]),
                    F.lit(">"))


def responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A response record per page, with ``page_id`` kept beside it in ``extra``.

    A null page has an empty payload, a null address stays null.
    """
    body = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                          "Content-Length: "), F.octet_length(body).cast("string"), F.lit(END))
    block = F.concat(head, body)
    return pages.select(
        record_id(F.lit("response"), F.col(id_col), F.col(url_col), body).alias("record_id"),
        F.lit("response").alias("kind"), F.col(url_col).cast("string").alias("target_uri"),
        F.lit(date).alias("date"), F.lit(None).cast("string").alias("refers_to"),
        F.lit(None).cast("string").alias("concurrent_to"),
        F.lit("application/http;msgtype=response").alias("content_type"), block.alias("block"),
        digest(block).alias("block_digest"), digest(body).alias("payload_digest"),
        F.when(F.col(id_col).isNotNull(), F.create_map(
            F.lit("X-Page-ID"), F.col(id_col).cast("string")))
        .otherwise(F.create_map().cast("map<string,string>")).alias("extra"))


@functools.lru_cache(4096)
def _tag_text(tag: str) -> str:
    """What stands for a tag, without its angle brackets: a line break or nothing."""
    name = _NAME.match(tag)
    return "\n" if name and name.group(1).lower() in _BLOCKS else ""


def _without_tags(text: str) -> str:
    """``text`` with tags gone; an angle bracket that begins no tag stays, an open tag ends the text."""
    first, *rest = text.split("<")
    out, held = [first], ""
    for part in rest:
        if not held and not (part and (part[0].isascii() and part[0].isalpha() or part[0] in "/!?")):
            out += ("<", part)
            continue
        held = f"{held}<{part}" if held else part
        tag, closed, after = held.partition(">")
        if closed:
            out += (_tag_text(tag), after)
            held = ""
    return "".join(out)


def plain_text(page: str) -> str:
    """The text of a page: scripts, styles, titles, comments and tags go, blocks become lines.

    White space becomes one space, lines without text go. Character references, named or by number,
    become the characters they stand for, and a space that does not break becomes a plain one.
    """
    # Bytes are split at the white space of ASCII only.
    text = b" ".join(_HIDDEN.sub("", page).encode().split()).decode()
    text = _without_tags(text)
    if "&" in text:
        text = html.unescape(text).replace("\xa0", " ")
    return "\n".join(x for x in (line.strip(" ") for line in text.split("\n")) if x)


def _digest(data: str) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data.encode()).digest()).decode()


def _derived_id(kind: str, source: str | None) -> str:
    h = hashlib.md5("\n".join((kind, "-" if source is None else source)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _derived(source: dict) -> Iterator[dict]:
    """The metadata and the conversion record of one response."""
    head, _, body = (source["block"] or "").partition(END)
    status, *headers = head.split(BREAK)
    fields = [f"http-status: {status}", *(f"http-header: {h}" for h in headers),
              f"source-block-digest: {source['block_digest'] or '-'}",
              f"source-payload-digest: {source['payload_digest'] or '-'}",
              f"source-payload-length: {len(body.encode())}", ""]
    uri, date, name = source["target_uri"], source["date"], source["record_id"]
    extra = dict(source["extra"] or ())
    if uri is not None:
        extra |= {"WARC-Refers-To-Target-URI": uri, "WARC-Refers-To-Date": date}
    for kind, content_type, block in (
            ("metadata", "application/warc-fields", BREAK.join(fields)),
            ("conversion", "text/plain; charset=utf-8", plain_text(body))):
        yield {"record_id": _derived_id(kind, name), "kind": kind, "target_uri": uri, "date": date,
               "refers_to": name, "concurrent_to": name if kind == "metadata" else None,
               "content_type": content_type, "block": block, "block_digest": _digest(block),
               "payload_digest": source["payload_digest"], "extra": list(extra.items())}


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row["block"])
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


RECORD = ", ".join([*(f"{c} string" for c in NAMED.values()), "extra map<string,string>",
                    "block string"])
_ORDER = ["record_id", "kind", "target_uri", "date", "refers_to", "concurrent_to", "content_type",
          "block", "block_digest", "payload_digest", "extra"]


def _deriver(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched((d for batch in batches for s in batch.to_pylist() for d in _derived(s)),
                            schema)
    return run


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response record; other records give none.

    The metadata block lists the source's status line, headers and digests and the length of its
    payload, in the named-field form of its content type. The conversion block is the plain text,
    also when it is empty. Both refer to the response by id, address and date; ids depend on the
    response's id alone, so derivatives can be built again. Null blocks count as empty; repeated
    responses give repeated derivatives; without records the result is empty. Columns other than
    those of a record are not looked at. A task holds a few megabytes of blocks, or one longer block.
    """
    out = records.sparkSession.createDataFrame([], RECORD).schema
    source = records.filter("kind = 'response'").select(
        "record_id", "target_uri", "date", "block", "block_digest", "payload_digest", "extra")
    return source.mapInArrow(_deriver(to_arrow_schema(out)), out).select(*_ORDER)


def write_warc(records: DataFrame, path: str, compression: str = "gzip",
               level: str = "BEST_SPEED") -> None:
    """Write records as WARC text; fields that are null are left out. ``level`` is that of gzip."""
    named = [F.concat(F.lit(f"{name}: "), F.col(column)) for name, column in NAMED.items()]
    others = F.transform(F.map_entries("extra"),
                         lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    block = F.coalesce(F.col("block"), F.lit(""))
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    lines = F.array_compact(F.concat(F.array(F.lit(VERSION), *named), others, F.array(length)))
    (records.select(F.concat(F.array_join(lines, BREAK), F.lit(END), block).alias("value"))
     .write.option("lineSep", END).option("compression", compression)
     .option("zlib.compress.level", level).text(path))


def _fields(head: bytes) -> dict[str, str]:
    lines = (x.split(":", 1) for x in head.decode("utf-8", "replace").split(BREAK) if ":" in x)
    return {name.strip().lower(): value.strip() for name, value in lines}


def _length(fields: dict[str, str]) -> int:
    stated = fields.get("content-length", "")
    return int(stated) if stated.isascii() and stated.isdigit() else -1


def _record(piece: bytes) -> dict:
    head, _, rest = piece.partition(END.encode())
    fields = _fields(head)
    length = _length(fields)
    complete = 0 <= length and rest[length:] == END.encode() and len(rest) >= length
    block = rest[:length] if complete else rest.removesuffix(END.encode())
    known = {n.lower(): c for n, c in NAMED.items()}
    row = {column: fields.get(name) for name, column in known.items()}
    names = {x.split(b":", 1)[0].strip().decode("utf-8", "replace")
             for x in head.split(BREAK.encode()) if b":" in x}
    extra = {n: fields[n.lower()] for n in sorted(names)
             if n.lower() not in known and n.lower() != "content-length"}
    return row | {"extra": list(extra.items()), "block": block.decode("utf-8", "replace"),
                  "complete": complete}


def _whole_records(pieces: Iterator[bytes]) -> Iterator[dict]:
    """Records from pieces cut before every version line.

    A piece that is shorter than its stated length takes in the pieces after it if they make up
    that length exactly; otherwise it is an incomplete record, and they are looked at anew.
    """
    waiting: deque[bytes] = deque()
    mark = f"{VERSION}{BREAK}".encode()

    def settled(more: bool) -> Iterator[dict]:
        while waiting:
            if not waiting[0]:  # before the first version line of a file
                waiting.popleft()
                continue
            head, found, rest = waiting[0].partition(END.encode())
            length = _length(_fields(head)) if found else -1
            want = length + len(END)
            have, used = len(rest), 1
            while have < want and used < len(waiting):
                have += len(mark) + len(waiting[used])
                used += 1
            if length >= 0 and have < want and more:
                return  # the rest may still come
            if length < 0 or have != want:
                used = 1
            yield _record(mark.join(waiting.popleft() for _ in range(used)))

    for piece in pieces:
        waiting.append(piece)
        yield from settled(True)
    yield from settled(False)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, with ``complete``: whether a block has its stated length.

    Field names are matched without regard to case; of repeated fields the last counts. Blocks are
    read as UTF-8, other bytes become the replacement character. Memory holds one record at a
    time; a record whose length is stated too high holds what follows until that is reached. A
    compressed file is read by one task, a plain one may be split, and a block with a version line
    just where it is split is incomplete.
    """
    out = spark.createDataFrame([], RECORD + ", complete boolean").schema
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(_whole_records(v.as_py() for batch in batches for v in batch.column(0)),
                            schema)

    raw = spark.read.option("lineSep", f"{VERSION}{BREAK}").text(path)
    return (raw.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, out)
            .select(*_ORDER, "complete"))
