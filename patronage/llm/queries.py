"""One query per operator over the corpus tables, with production parameters, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm import (
    alignment, decontaminate, fingerprints, html, language, minhash, mixing, neighbours,
    periodic, pii, quality, tokens, warc)
from patronage.llm.texts import table
from patronage.session import durable_root, shipped

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder among those that all executors share."""
    return f"{durable_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).drop("key", "passes", "in_part")


def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), shingle=3, percent=85)


# Grades of the labels: 0 toxic, 1 harmless but of low quality, 2 good.
GRADE = "CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 WHEN quality = 1 THEN 2 END"


def op3_quality_grades(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    grader = quality.learn(docs, table(spark, folder, "labels"), grade=F.expr(GRADE))
    return quality.grade_documents(docs, grader)


def op4_token_output(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_folder(spark, "tokens")
    tokens.write_tokens(table(spark, folder, "documents"), path, TOKENIZER)
    return tokens.read_tokens(spark, path)


def op5_pii_sanitise(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.sanitise(table(spark, folder, "documents"))
    # A document without spans stays as it is and has no text here.
    return found.withColumn("sanitised_sha256", F.sha2("sanitised", 256)).drop("sanitised")


def op6_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    sources, made = fresh_folder(spark, "warc"), fresh_folder(spark, "warc-derivatives")
    warc.write_warc(warc.responses(pages), sources)
    warc.write_warc(warc.derivatives(warc.read_warc(spark, sources)), made)
    extra = F.col("extra")
    return warc.read_warc(spark, made).select(
        extra["X-Page-ID"].try_cast(pages.schema["page_id"].dataType).alias("page_id"), "record_id",
        "kind", "target_uri", "date", "refers_to",
        extra["WARC-Refers-To-Target-URI"].alias("refers_to_target_uri"),
        extra["WARC-Refers-To-Date"].alias("refers_to_date"), "concurrent_to", "content_type",
        "block", "block_digest", "payload_digest")


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("items", "spans")


def op8_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, folder, "documents"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.identify(docs, language.learn(docs))


def op10_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html.extract(pages, html.learn(pages))


def op11_align_tokens(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_folder(spark, "alignments")
    alignment.write_alignments(table(spark, folder, "documents"), path, TOKENIZER, PIECES)
    return alignment.read_alignments(spark, path, groups="sha256").withColumnRenamed(
        "groups", "groups_sha256")


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = periodic.planted(table(spark, folder, "documents"))
    found = periodic.periodic_runs(docs, least=12, collapsed="sha256")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short"))))
    lines = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", *[r[n].cast("string") for n in ("start", "length", "period")]), F.lit("\n")))
    return found.withColumn("_longest", longest).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("_longest.before")).alias("start"), F.col("_longest.length").alias("length"),
        (-F.col("_longest.short")).alias("period"),
        F.expr("(1000 * _longest.length) div -_longest.short").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.col("collapsed").alias("collapsed_sha256"))


def op13_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


QUERIES: dict[str, Query] = {f.__name__: shipped(f) for f in (
    op1_mix_sources, op2_minhash_near_dedup, op3_quality_grades, op4_token_output,
    op5_pii_sanitise, op6_warc_derivatives, op7_decontaminate, op8_fingerprint, op9_language_id,
    op10_html_extract, op11_align_tokens, op12_periodic_runs,
    op13_nearest_vectors)}


# How SQL turns a page into text, step by step. Of character references it knows only those that the
# given pages hold; a test holds the others against the standard library.
_TAG_STEPS = (
    (r"(?is)<!--.*?-->", ""),
    (r"(?is)<(?:script|style|title|noscript)[^>]*>.*?</(?:script|style|title|noscript)[ ]*>", ""),
    (r"[\x09-\x0D\x20]{2,}|[\x09-\x0D]", " "),
    (r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|table|tr|td|th|article|section|header|footer|nav|aside|main"
     r"|form|blockquote|pre|br|hr)\b[^>]*>", "\n"),
    (r"<[a-zA-Z/!?][^>]*(?:>|$)", ""),
)
_REFERENCES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("copy", "©"),
               ("middot", "·"), ("amp", "&"))
_LINE_STEPS = ((r" *\n[ \n]*", "\n"), (r"^\n+|\n+$", ""))


def _warc_sql() -> str:
    """The derivatives of ``op6_warc_derivatives`` from the pages themselves."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def shown(text: str) -> str:
        return text.replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '")

    def digest(data: str) -> str:
        return (f"'sha1:' || array_to_string(list_transform(range(8), lambda i: list_transform([("
                f"'0x' || substr(sha1({data}), (i * 5 + 1)::BIGINT, 5))::INT], lambda v: "
                + " || ".join(f"substr('{warc.BASE32}', ((v >> {15 - 5 * k}) & 31) + 1, 1)"
                              for k in range(4)) + ")[1]), '')")

    def record_id(*parts: str) -> str:
        h = "md5(" + " || chr(10) || ".join(f"coalesce({p}::VARCHAR, '-')" for p in parts) + ")"
        cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
        return "'<urn:uuid:' || " + " || '-' || ".join(
            f"substr({h}, {a}, {n})" for a, n in cuts) + " || '>'"

    text = "body"
    for pattern, by in (*_TAG_STEPS, *((f"&{n};", sign) for n, sign in _REFERENCES), *_LINE_STEPS):
        text = f"regexp_replace({text}, {quoted(pattern)}, {'chr(10)' if by == chr(10) else quoted(by)}, 'g')"
    size = "octet_length(encode(body))::VARCHAR"
    head = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ")
    fields = ("'http-status: HTTP/1.1 200 OK' || crlf || 'http-header: Content-Type: text/html; "
              f"charset=utf-8' || crlf || 'http-header: Content-Length: ' || {size} || crlf || "
              "'source-block-digest: ' || source_block || crlf || 'source-payload-digest: ' || "
              f"payload_digest || crlf || 'source-payload-length: ' || {size} || crlf")
    return f"""
WITH source AS (
  SELECT page_id, url, coalesce(html, '') AS body, chr(13) || chr(10) AS crlf FROM pages),
signed AS (
  SELECT *, {record_id("'response'", "page_id", "url", "body")} AS source_id,
         {digest("body")} AS payload_digest,
         {digest(f"('{shown(head)}' || {size} || crlf || crlf || body)")} AS source_block
  FROM source),
made AS (
  SELECT *, 'metadata' AS kind, 'application/warc-fields' AS content_type, {fields} AS block FROM signed
  UNION ALL
  SELECT *, 'conversion', 'text/plain; charset=utf-8', trim({text}) FROM signed)
SELECT page_id, {record_id("kind", "source_id")} AS record_id, kind, url AS target_uri,
       '2024-01-01T00:00:00Z' AS date, source_id AS refers_to, url AS refers_to_target_uri,
       CASE WHEN url IS NOT NULL THEN '2024-01-01T00:00:00Z' END AS refers_to_date,
       CASE WHEN kind = 'metadata' THEN source_id END AS concurrent_to, content_type, block,
       {digest("block")} AS block_digest, payload_digest
FROM made"""


# The mix: hash keys, running totals within each source, and the level at which targets stop.
_MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, '17')), 1, 15))::BIGINT AS hash_key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
rooms AS (
  SELECT *, source_size * 3 AS most, (source_size * 3)::DOUBLE / weight AS room FROM sources),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(most) OVER (ORDER BY room, source NULLS LAST
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / sum(weight) OVER (ORDER BY room, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM rooms),
targets AS (
  SELECT source, source_size,
         CASE WHEN coalesce(room < top, true) THEN most::DOUBLE ELSE top * weight END AS target
  FROM (SELECT *, max(level) FILTER (WHERE level <= room) OVER () AS top FROM levels)),
budgets AS (
  SELECT *, round(target)::BIGINT AS budget,
         CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS passes
  FROM targets),
placed AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.budget, b.passes, s.source,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash_key, s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, source,
       (passes * size + greatest(0, least(budget - passes * source_size - before, size)))::BIGINT AS taken
FROM placed"""

# Near-duplicates: all pairs that share a shingle, and the closure of the links.
_NEAR_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3
         THEN [array_to_string(w, ' ')] ELSE list_transform(range(len(w) - 2),
         lambda i: w[(i + 1)::INT] || ' ' || w[(i + 2)::INT] || ' ' || w[(i + 3)::INT]) END) AS s
  FROM worded),
single AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM shingled),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared
  FROM single a JOIN single b ON a.x = b.x AND a.doc_id < b.doc_id
       AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85
  GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * shared >= 85 * (na + nb - shared)),
ends AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT u, v FROM ends
  UNION SELECT r.u, e.v FROM reach r JOIN ends e ON r.v = e.u),
lowest AS (SELECT u, min(v) AS low FROM reach GROUP BY u)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM shingled LEFT JOIN lowest ON doc_id = u"""

# Decontamination: windows of documents and items as strings, joined per window length.
_LEAK_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pattern AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS x
  FROM (SELECT item_id, w, least(10, len(w)) AS size,
               unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM pattern),
spots AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS x
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM doc CROSS JOIN sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, item_id, s.size, i FROM spots s JOIN pattern p ON s.x = p.x AND s.size = p.size),
hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS names
  FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

ORACLES: dict[str, str] = {
    "op1_mix_sources": _MIX_SQL, "op2_minhash_near_dedup": _NEAR_SQL,
    "op6_warc_derivatives": _warc_sql(), "op7_decontaminate": _LEAK_SQL}
