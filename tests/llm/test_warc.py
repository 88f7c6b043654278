import base64
import glob
import gzip
import hashlib
import html
import os
import random
import re
import tempfile

import pytest

from patronage.llm import queries, warc

PAGES = [(1, "http://a/1", "<html><title>t</title><body><p>Hello &amp; <b>bye</b></p><p>two</p></body>"),
         (2, "http://a/2", ""), (3, None, None), (4, "http://é/", "ü\r\n\r\nWARC\r\n\r\nx"),
         (4, "http://é/", "ü\r\n\r\nWARC\r\n\r\nx"), (None, "http://n/", "<p>n" + "y" * 50_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr(
        "*", "1 AS block", "2 AS kind", "3 AS extra", "4 AS date")


def sha(text):
    return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_records(pages):
    for r in warc.responses(pages).collect():
        head, _, body = r.block.partition("\r\n\r\n")
        assert head.startswith("HTTP/1.1 200 OK\r\n")
        assert f"Content-Length: {len(body.encode())}" in head
        assert r.block_digest == sha(r.block) and r.payload_digest == sha(body)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_files_are_warc_and_read_back(spark, pages, compression):
    records = warc.responses(pages)
    path = os.path.join(tempfile.mkdtemp(), "w")
    warc.write_warc(records, path, compression)
    found = []
    for name in glob.glob(f"{path}/part-*"):
        data = gzip.open(name).read() if compression == "gzip" else open(name, "rb").read()
        while data:  # as the format says: fields, empty line, so many bytes, two line breaks
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            n = int(fields["Content-Length"])
            assert rest[n:n + 4] == b"\r\n\r\n"
            found.append((fields["WARC-Record-ID"], rest[:n].decode()))
            data = rest[n + 4:]
    want = records.collect()
    assert sorted(found) == sorted((r.record_id, r.block) for r in want)
    back = warc.read_warc(spark, path)
    assert back.filter("not complete").count() == 0
    key = lambda r: (r["record_id"], str(r))
    assert sorted((r.asDict() for r in back.drop("complete").collect()), key=key) == sorted(
        (r.asDict() for r in want), key=key)


def test_derivatives_refer_to_their_source(pages):
    sources = {r.record_id: r for r in warc.responses(pages).collect()}
    made = warc.derivatives(warc.responses(pages)).collect()
    assert len(made) == 2 * len(PAGES) and {r.refers_to for r in made} == set(sources)
    for r in made:
        s = sources[r.refers_to]
        assert r.target_uri == s.target_uri and r.date == s.date
        assert r.payload_digest == s.payload_digest and r.block_digest == sha(r.block)
        assert (r.concurrent_to == s.record_id) == (r.kind == "metadata")
        assert r.extra.get("WARC-Refers-To-Target-URI") == s.target_uri
        assert r.record_id not in sources
        if r.kind == "metadata":
            assert "http-status: HTTP/1.1 200 OK\r\n" in r.block
            assert "http-header: Content-Type: text/html; charset=utf-8\r\n" in r.block
            assert f"source-block-digest: {s.block_digest}\r\n" in r.block
    texts = {r.target_uri: r.block for r in made if r.kind == "conversion"}
    assert texts["http://a/1"] == "Hello & bye\ntwo" and texts["http://a/2"] == ""
    again = warc.derivatives(warc.responses(pages)).collect()
    assert {r.record_id for r in again} == {r.record_id for r in made}


def test_blocks_with_version_lines_come_back_whole(spark):
    odd = ["x\r\n\r\nWARC/1.1\r\n", "WARC/1.1\r\nWARC/1.1\r\n\r\n", "\r\n\r\n",
           "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"]
    pages = spark.createDataFrame([(i, f"u{i}", t) for i, t in enumerate(odd * 3)],
                                  "page_id bigint, url string, html string").coalesce(1)
    path = os.path.join(tempfile.mkdtemp(), "w")
    warc.write_warc(warc.responses(pages), path)
    rows = warc.read_warc(spark, path).collect()
    assert len(rows) == 12 and all(r.complete for r in rows)
    assert sorted(r.block.partition("\r\n\r\n")[2] for r in rows) == sorted(odd * 3)


def test_broken_records_do_not_hide_others(spark):
    def record(block, stated):
        return f"WARC/1.1\r\nwarc-type: response\r\nContent-Length: {stated}\r\n\r\n{block}\r\n\r\n"
    path = os.path.join(tempfile.mkdtemp(), "w.warc.gz")
    with gzip.open(path, "wt", newline="") as out:
        out.write(record("good", 4) + record("short", 400) + record("fine", 4) + record("bad", "x")
                  + record("long", 2) + record("last", 4))
    rows = warc.read_warc(spark, path).collect()
    assert [(r.block, r.complete) for r in rows] == [
        ("good", True), ("short", False), ("fine", True), ("bad", False), ("long", False),
        ("last", True)]
    assert {r.kind for r in rows} == {"response"}


def test_nothing(spark, pages):
    none = warc.responses(pages.limit(0))
    assert warc.derivatives(none).count() == 0
    path = os.path.join(tempfile.mkdtemp(), "w")
    warc.write_warc(none, path)
    assert warc.read_warc(spark, path).count() == 0
    assert warc.derivatives(warc.responses(pages).withColumn("kind", warc.F.lit("request"))).count() == 0


def test_all_references_are_decoded():
    names = sorted(html.entities.html5)
    for name in names:
        want = html.unescape(f"a&{name}b").replace("\xa0", " ")
        if not set(want) & set("\n\t "):
            assert warc.plain_text(f"<p>a&{name}b</p>") == want, name
    assert warc.plain_text("<i>caf&eacute; &#8217;s &#x27;x&#X27; &amp;lt; AT&T &unknown; &#169;") == \
        "café ’s 'x' &lt; AT&T &unknown; ©"
    assert warc.plain_text("a&nbsp;b") == "a b" and warc.plain_text("&lt;b&gt;") == "<b>"


def by_patterns(page):
    """The text of a page by the patterns that the SQL uses, tags in the order of the page."""
    for pattern, by in queries._TAG_STEPS[:3]:
        page = re.sub(pattern, by, page)
    (lines, _), (others, _) = queries._TAG_STEPS[3:]
    page = re.sub(f"({lines.removeprefix('(?i)')})|{others}", lambda m: "\n" if m.group(1) else "", page,
                  flags=re.I | re.A)
    page = html.unescape(page).replace("\xa0", " ")
    for pattern, by in queries._LINE_STEPS:
        page = re.sub(pattern, by, page)
    return page.strip(" ")


def test_text_equals_a_chain_of_patterns(spark):
    pick = random.Random(4)
    parts = ["<p>", "</p>", "<P class='x>y'>", "<b>", "</b >", "<br/>", "<p-x>", "< b", "<", ">", "a < b", "&lt;",
             "&amp;lt;", "text", "more text ", "\n", "\t ", "<!-- c <p> -->", "<script>if (a<b) x</script>",
             "<style >s</style>", "<title>t</title>", "<h2>", "</h2>", "<h7>", "<!doctype html>", "<?x?>",
             "<a href='", "&#10;", "é", "\u2003", "\x1c", "<td", "</div>", "</", "</1>", "<é>"]
    for _ in range(3000):
        page = "".join(pick.choice(parts) for _ in range(pick.randint(0, 14)))
        assert warc.plain_text(page) == by_patterns(page), page


def test_query_with_and_without_ids(spark, pages, monkeypatch):
    """Both kinds come back from their own files, also for a page without an id or address."""
    monkeypatch.setattr(queries, "table", lambda *_: pages)
    got = queries.op6_warc_derivatives(spark, "").collect()
    assert len(got) == 2 * len(PAGES) and {r.page_id for r in got} == {None, 1, 2, 3, 4}
    for r in got:
        url = r.target_uri
        assert (r.refers_to_target_uri, r.refers_to_date) == (
            (url, "2024-01-01T00:00:00Z") if url else (None, None))
        assert r.block_digest == sha(r.block)
    texts = {r.page_id: r.block for r in got if r.kind == "conversion"}
    assert texts[None] == "n" + "y" * 50_000 and texts[4] == "ü WARC x"
    named = spark.createDataFrame([("seven", "u", "<p>x"), ("", "v", "y")],
                                  "page_id string, url string, html string")
    monkeypatch.setattr(queries, "table", lambda *_: named)
    assert {r.page_id for r in queries.op6_warc_derivatives(spark, "").collect()} == {"seven", ""}
    monkeypatch.setattr(queries, "table", lambda *_: named.limit(0))
    assert queries.op6_warc_derivatives(spark, "").collect() == []
