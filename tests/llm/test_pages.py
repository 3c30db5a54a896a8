"""Page text and archives."""

import base64
import hashlib
import io
import time

import pytest

from quarry.llm import html_text, warc


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("  \n", ""), ("<html><head><title>t</title></head><body></body></html>", ""),
    ("<p>One, two &amp; three&nbsp;four.<p>Five<br>six <b>sev</b>en", "One, two & three four. Five six seven"),
    ("<nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>Body text, with commas, here.</p><div class='comments'><p>Nice, very nice, so nice.</p></div></article><footer><p>Foot, foot.</p></footer>", "Title Body text, with commas, here."),
    ("<div id=sidebar><p>Side, side, side, side</p></div><div class=content><p>First paragraph, long enough to count.</p><ul><li>one<li>two</ul></div><form><p>Mail, now</p></form>", "First paragraph, long enough to count. one two"),
    ("<body><article><p>Cut off, before its end <a href='x", "Cut off, before its end"),
    ("<article><script>var t='</p>';</script><p>Kept, text.</p><style>p{}</style><!-- no, no, no --></article>", "Kept, text."),
    ("<div><p>Short, but all there is.</p></div>", "Short, but all there is."),
])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


PARAGRAPH = "<p>" + "A long paragraph, with commas, and words enough to count for its whole length, " * 5 + "again.</p>"


@pytest.mark.parametrize("page", [
    "<body><article><h1>Title</h1><div class=content>{}</div><ul><li>item</ul><pre>code</pre></article></body>",
    "<body><main><div><h1>Title</h1><div class=content>{}</div></div><table><tr><td>item</table><p>code</p></main></body>",
    "<body><div><h1>Title</h1><div class=content>{}</div><ul><li>item</ul><p>code</p></div></body>",
])
@pytest.mark.parametrize("n", [1, 12])
def test_what_stands_beside_the_text_stays(page, n):
    text = html_text.main_text(page.format(PARAGRAPH * n))
    assert text.startswith("Title A long") and text.endswith("again. item code") and text.count("again.") == n


@pytest.mark.parametrize(("page", "text"), [
    ("<body><div class='page has-sidebar'><div id=with-nav><article><p>Kept, whole, text.</p></article></div></div></body>", "Kept, whole, text."),
    ("<body><article><p>One, two.</p><section id=search-results-explained><p>Three, four.</p></section><div class=share-widget><p>Five, six.</p></div></article></body>", "One, two. Three, four."),
    ("<body><div class=notice><article><p>Kept, whole, text.</p></article></div></body>", "Kept, whole, text."),
    ("<body><div class=notice><p>Kept, whole, text.</p><p>And, so, on.</p></div><p>End</p></body>", "Kept, whole, text. And, so, on. End"),
    ("<body><div class=widget><p>One, two, three.</p></div><div class=social><p>Four, five, six.</p></div><div class=promo><p>Seven, eight, nine.</p></div></body>", "One, two, three. Four, five, six. Seven, eight, nine."),
    ("<body><article><p>Text, of it.</p></article><div id=comments><article class=comment><p>" + "No, no, no. " * 30 + "</p></article></div></body>", "Text, of it."),
])
def test_ordinary_words_in_classes_cost_no_text(page, text):
    assert html_text.main_text(page) == text


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 5000 + "deep, text" + "</div>" * 5000) == "deep, text"
    assert len(html_text.main_text("<article>" + "<p>word, word</p>" * 20000)) == 20000 * 11 - 1


@pytest.mark.parametrize("part", ["<section>{}</section>", "<div class=sec>{}</div>", "<td>{}</td>"])
def test_short_sections_stay(part):
    page = "<body>" + part.format("<h2>A</h2>" + PARAGRAPH * 5) + part.format("<p>B, in a few words.</p>") + part.format("<h2>C</h2><p>Short.</p>") + part.format("<a href=x>Link one</a> <a href=y>Link two</a>") + "</body>"
    assert html_text.main_text(page).endswith("again. B, in a few words. C Short.")


@pytest.mark.parametrize("page", [
    "<a " * 330_000, '<a "x' * 200_001 + ">", "<a '\"x" * 100_001 + ">", "<![CDATA[>" * 100_000, "<script>" + "</script " * 100_000, "<!" * 300_000, "<a<a" * 200_000 + ">", "<" * 1_000_000,
    "<div><p>a, b</p>" * 20_000, "<div>" * 20_000 + "</section>" * 20_000, "<header>" * 40_000, "<b>" * 20_000 + "<div></div>" * 20_000, "<ul>" + "<b>" * 20_000 + "<li></li>" * 20_000,
])
def test_time_grows_with_the_length(page):
    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 5


@pytest.mark.parametrize(("page", "text"), [
    ("<p title='a > b' class=\"x\">One, two</p><p data-x='>'>three", "One, two three"), ("<p>a < b, c > d</p>", "a < b, c > d"), ("<p>One, <a 'x>two</p>", "One, <a 'x>two"),
    ("<p>One,<!-- <p>no --> two<![CDATA[ <p>no ]]></p><!bogus>three", "One, two three"), ("<p>One, two</P ><p/>three</p>", "One, two three"), ("<p>One, <b>two</i></b> three</p></ul>four", "One, two three four"),
])
def test_tags_and_quotes(page, text):
    assert html_text.main_text(page) == text


def test_extraction_keeps_every_row(spark):
    rows = [(1, "u", "<p>a, b</p>", "x", 5), (1, "u", "<p>a, b</p>", "x", 5), (2, None, None, "x", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    assert sorted(map(tuple, html_text.extract_pages(df).collect()), key=repr) == sorted([(1, "u", "a, b", 4), (1, "u", "a, b", 4), (2, None, "", 0)], key=repr)


def digest(s):
    return base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()


def test_archives_come_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 3)
    pages = [(7, "http://a/x y", "same\r\n\r\nWARC/1.1\r\n"), (3, "http://b/", "same\r\n\r\nWARC/1.1\r\n"), (4, "http://c/", "other é\n"), (5, None, None), (6, "http://d/", ""), (9, "http://e/", "x" * 100_000), (8, "http://é/", "other é\n")]
    df = spark.createDataFrame([(*p, "d", 1) for p in pages], "page_id long, url string, html string, digest string, n int")
    got = {r.page_id: tuple(r)[1:5] for r in warc.archive_round_trip(df).collect()}
    first = {7: 3, 8: 4, 6: 5}
    assert got == {i: (len((h or "").encode()), digest(h or ""), "revisit" if i in first else "response", first.get(i)) for i, _, h in pages}
    small = {r.page_id: r.record_type for r in warc.archive_round_trip(df, min_revisit_bytes=10).collect()}
    assert small[6] == small[8] == "response" and small[7] == "revisit"
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_archives_of_null_ids_ties_and_long_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None)
    long = "é" * 200_000
    rows = [(None, "u", "a"), (4, "v", "a"), (4, "w", "a"), (5, None, "a"), (None, None, "b"), (None, "x", "b"), (None, "y", None), (6, "z", long), (7, "z", long), (2, "z", "c" * 1500), (2, "z", "c" * 1400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((tuple(r)[:5] for r in warc.archive_round_trip(df).collect()), key=repr)
    say = lambda i, h, kind, first=None: (i, len(h.encode()), digest(h), kind, first)
    assert got == sorted([
        say(None, "a", "revisit", 4), say(4, "a", "response"), say(4, "a", "response"), say(5, "a", "revisit", 4), say(None, "b", "response"), say(None, "b", "response"),
        say(None, "", "response"), say(6, long, "response"), say(7, long, "revisit", 6), say(2, "c" * 1500, "response"), say(2, "c" * 1400, "response"),
    ], key=repr)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) == before


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    block = warc.arc_version_block(version, "f.arc", "20240102030405")
    data = block + warc.arc_record(version, "http://a b/", "20240102030405", b"HTTP/1.1 200 OK\r\n\r\nhi\n") + warc.arc_record(version, "dns:x", "2024", b"")
    a, b = warc.parse_arc(data)
    assert (a.url, a.body, a.version, b.body) == ("http://a%20b/", b"HTTP/1.1 200 OK\r\n\r\nhi\n", version, b"")
    ((fields, payload),) = warc.parse_warc(io.BytesIO(warc.convert(a) + b"\r\n\r\n"))
    assert fields["warc-type"] == "response" and fields["warc-date"] == "2024-01-02T03:04:05Z" and payload == a.body
    assert fields["warc-payload-digest"] == "sha1:" + digest("hi\n")
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-30]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://a/ 0.0.0.0 2024 text/html 1\nx\n"))


def test_names_that_clash(spark):
    names = "payload_bytes long, payload_digest string, record_type string, refers_to long, n_chars long, text string, record string, archive string"
    df = spark.createDataFrame([(i, f"u{i % 2}", f"<p>page, {i % 2}</p>", *([None] * 8)) for i in range(6)], "page_id long, url string, html string, " + names)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.archive_round_trip(df).collect()) == [(0, "response", None), (1, "response", None), *[(i, "revisit", i % 2) for i in range(2, 6)]]
    assert {(r.page_id, r.text) for r in html_text.extract_pages(df).collect()} == {(i, f"page, {i % 2}") for i in range(6)}
