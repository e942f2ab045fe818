import duckdb
import pytest

from graphloom.llm import exact_dedup, line_dedup, quality_rules, warc

from .conftest import ODD, prose


def sql(rows, query):
    import pandas as pd

    documents = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": pd.array([r[1] for r in rows], "string"), "source": pd.array([r[3] if len(r) > 3 else None for r in rows], "string")})
    c = duckdb.connect()
    c.register("documents", documents)
    return c.sql(query).df()


def same(spark_rows, frame):
    names = sorted(frame.columns)
    plain = lambda v: None if v is None or v != v else v
    a = sorted(str(tuple(r[n] for n in names)) for r in spark_rows)
    b = sorted(str(tuple(plain(v) for v in r)) for r in frame[names].astype(object).itertuples(index=False))
    assert a == b


def hosted():
    line = "this line is on very many pages of the host"
    rows = [(k, "\n".join([line, prose(k, 40), prose(k + 500, 30), line.upper() + " "]), "en", "a") for k in range(30)]
    rows += [(100 + k, line + f"\n{prose(k + 50, 3)}", "en", "a" if k % 2 else "b") for k in range(10)]
    rows += [(200 + k, "the same page\n" + prose(7, 20), "en", "b") for k in range(40)]
    return rows


PLAIN = [r for k, r in enumerate(ODD) if r[0] not in (6, None) or k == 5][:-1]  # distinct ids, no control characters


@pytest.mark.parametrize("module, run", [(quality_rules, quality_rules.apply_rules), (exact_dedup, exact_dedup.exact_dedup)])
def test_against_sql(docs_of, module, run):
    rows = hosted() + [(1000 + k, t) for k, (_, t) in enumerate(PLAIN)] + [(3000, "a b c d e f a b c d e f g"), (3001, "x x x x x x x x x x x"), (3002, "#*$%&|<> ok\nok\n\nok \nok")]
    same(run(docs_of(rows, extra=True)).collect(), sql(rows, module.SQL))


def test_rules_verdicts(docs_of):
    out = {r.doc_id: r for r in quality_rules.apply_rules(docs_of(hosted())).collect()}
    assert all(out[k].kept and out[k].n_removed_words == 20 for k in range(30))
    assert all(not out[100 + k].kept for k in range(1, 10, 2)) and all(out[100 + k].kept for k in range(0, 10, 2))
    assert not any(out[200 + k].kept for k in range(40))  # documents count, so copies make their lines frequent


def test_rules_limits_of_hosts(docs_of):
    """A tiny host has too few documents to tell; in a very large one a fixed number of documents is enough."""
    line = "the line of the host"
    rows = [(k, f"{line}\n{prose(k, 2)}", "en", "tiny") for k in range(20)] + [(100 + k, f"{line}\n{prose(k, 2)}" if k < 25 else prose(k, 12), "en", "small") for k in range(60)]
    rows += [(1000 + k, f"{line}\n{prose(k, 2)}" if k < 31 else prose(k, 12), "en", "hot") for k in range(4000)]
    out = {r.doc_id: r.n_removed_words for r in quality_rules.apply_rules(docs_of(rows)).where("n_removed_words > 0 OR doc_id < 100").collect()}
    assert {i for i, n in out.items() if n} == {100 + k for k in range(25)} and len(out) == 45
    out = quality_rules.apply_rules(docs_of(rows), limits=(20, 30)).where("n_removed_words > 0")
    assert {r.doc_id for r in out.collect()} == {100 + k for k in range(25)} | {1000 + k for k in range(31)}


def test_rules_of_odd_rows(docs_of):
    assert quality_rules.apply_rules(docs_of(ODD, extra=True)).count() == len(ODD)
    assert quality_rules.apply_rules(docs_of([])).count() == 0


def logs():
    rows = [(k, f"{prose(k, 30)}\nuser {k} logged in from host{k} at last\n{prose(k + 900, 12)}") for k in range(30)]
    rows += [(100 + k, f"session opened for admin{k % 3} by root today\nshort line") for k in range(20)]
    return rows + [(200 + k, "only copies have this line of words\n" + prose(1, 9)) for k in range(30)]


def test_templates_against_sql(docs_of):
    rows = logs() + [(1000 + k, t) for k, (_, t) in enumerate(PLAIN)]
    from pyspark.sql import functions as F

    out = line_dedup.drop_recurring_lines(docs_of(rows, extra=True)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
    same(out.collect(), sql(rows, line_dedup.SQL))


def test_templates_with_variable_fields_recur(docs_of):
    out = {r.doc_id: r for r in line_dedup.drop_recurring_lines(docs_of(logs())).collect()}
    assert all(out[k].n_dropped == 1 and "logged in" not in out[k].kept_text for k in range(30))
    assert all(out[200 + k].n_dropped == 0 for k in range(30))


@pytest.mark.parametrize("times", [1, 10, 40])
def test_templates_are_the_same_as_data_grow(docs_of, times):
    """Fields whose values recur ever more often stay fields; short lines and several templates of one leaf are found."""
    rows = []
    for k in range(60 * times):
        lines = [f"Posted on the blog by {'abcdefghijklmnopqrstuvwxyz'[k % 26]}name in {'uvwxyz'[k * 7 % 6]}section", "Subscribe to our newsletter", "Home", f"Page {k % 9} of 12", f"12:0{k % 10} 2024 INFO " + ("user logged in from somewhere", "disk is full on volume", "job has ended without errors")[k % 3] + f" {k}"]
        rows.append((k, "\n".join([*lines, prose(k, 9, [f"w{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]).translate(str.maketrans("", "", "0123456789"))])))
    out = line_dedup.drop_recurring_lines(docs_of(rows)).collect()
    assert {r.n_dropped for r in out} == {5} and all(len(r.kept_text.split("\n")) == 1 for r in out)


def test_templates_need_no_broadcast(spark, docs_of):
    found = []
    for size in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        found.append(sorted(map(tuple, line_dedup.drop_recurring_lines(docs_of(logs())).collect())))
    assert found[0] == found[1]


def test_templates_of_odd_rows(docs_of):
    assert line_dedup.drop_recurring_lines(docs_of(ODD, extra=True)).count() == len(ODD)
    assert line_dedup.drop_recurring_lines(docs_of([])).count() == 0


PAGE = (
    '<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>"; if (a<b) {}</script></head><body><!-- no --><nav><a href="/x?a=1&amp;b=2">X</a> <a href=\'y\'>Y</a><a href=/x?a=1&amp;b=2>again</a></nav>'
    "<p>One <b>bold</b>\n word.<br>Two é</p><noscript>hidden</noscript></body></html>"
)


def test_derivatives_of_a_page():
    source = warc.response("http://h.example/d/", PAGE.encode(), "1")
    (about, about_block), (text_headers, text) = warc.derive(*source)
    assert text.decode() == "A & B\nX Yagain\nOne bold\nword.\nTwo é"
    for h in (about, text_headers):
        assert h["WARC-Refers-To"] == source[0]["WARC-Record-ID"] and h["WARC-Target-URI"] == "http://h.example/d/" and h["WARC-Refers-To-Payload-Digest"] == warc.sha1_digest(PAGE.encode())
        assert h["WARC-Date"] == source[0]["WARC-Date"]
    said = about_block.decode().split("\r\n")
    assert "title: A & B" in said and [x for x in said if x.startswith("outlink")] == ["outlink: http://h.example/x?a=1&b=2", "outlink: http://h.example/d/y"]
    assert "source-warc-type: response" in said and "http-status: HTTP/1.1 200 OK" in said
    assert warc.derive(about, about_block) == []


def test_files_round_trip(spark, tmp_path):
    import gzip

    made = [warc.response(f"http://h.example/{k}", PAGE.encode() * k, str(k)) for k in range(4)]
    made += [d for r in made for d in warc.derive(*r)]
    plain = b"".join(warc.to_bytes(*r) for r in made)
    zipped = b"".join(gzip.compress(warc.to_bytes(*r)) for r in made)
    assert list(warc.parse(plain)) == list(warc.parse(zipped)) == made
    for cut in (plain[:-20], zipped[:-20]):
        wrong = []
        assert list(warc.parse(cut, wrong)) == made[:-1] and len(wrong) >= 1
    wrong = []
    assert list(warc.parse(b"junk", wrong)) == [] and len(wrong) == 1
    broken = b"".join(warc.to_bytes(*r) if k != 2 else warc.to_bytes({"WARC-Type": "response"}, b"x") + b"junk\r\n" for k, r in enumerate(made))
    wrong = []
    assert list(warc.parse(broken, wrong)) == made[:2] + made[3:] and len(wrong) == 1
    (tmp_path / "a.warc.gz").write_bytes(zipped)
    records = warc.read_warc(spark, str(tmp_path))
    assert records.count() == 12 and warc.derivatives(records).count() == 8 and records.where("damage IS NOT NULL").isEmpty()
    (tmp_path / "b.warc").write_bytes(broken)
    records = warc.read_warc(spark, str(tmp_path))
    assert records.count() == 12 + 11 + 1 and records.where("damage IS NOT NULL").count() == 1
    assert warc.derivatives(records).count() == 8 + 6


def http(body, *headers, status="HTTP/1.1 200 OK"):
    block = "\r\n".join([status, *headers]).encode() + b"\r\n\r\n" + body
    return {"warc-type": "response", "warc-record-id": "<urn:x>", "WARC-TARGET-URI": "http://h.example/", "warc-date": "2020-01-01T00:00:00Z"}, block


def conversion(*response):
    made = warc.derive(*response)
    assert [h["WARC-Type"] for h, _ in made][0] == "metadata" and all(h["WARC-Refers-To"] == "<urn:x>" for h, _ in made)
    return made[1][1].decode() if len(made) > 1 else None


def test_payload_encodings_and_types():
    import gzip
    import zlib

    page = b"<p>hello <i>there</i>"
    half = b"c\r\n" + page[:12] + b"\r\n%x;x=y\r\n" % len(page[12:]) + page[12:] + b"\r\n0\r\n\r\n"
    for body, *headers in (
        (page,), (half, "Transfer-Encoding: chunked"), (page, "transfer-encoding: chunked"), (gzip.compress(page), "Content-Encoding: gzip"), (page, "content-encoding: gzip"),
        (zlib.compress(page), "Content-Encoding: deflate"), (zlib.compress(page, wbits=-15), "Content-Encoding: deflate"), (page, "Content-Type: application/xhtml+xml"), (page, "Content-Type: text/html; Charset=nope"),
    ):
        assert conversion(*http(body, *headers)) == "hello there", headers
    both = gzip.compress(page)
    both = b"%x\r\n" % len(both) + both + b"\r\n0\r\n\r\n"
    assert conversion(*http(both, "Content-Encoding: gzip", "Transfer-Encoding: chunked")) == "hello there"
    assert conversion(*http("<p>é".encode("latin-1"), "Content-Type: text/html; charset=ISO-8859-1")) == "é"
    assert conversion(*http(b"a <b> c\n d", "Content-Type: text/plain")) == "a <b> c\n d"
    for body, *headers in ((b"\x89PNG", "Content-Type: image/png"), (page, "Content-Encoding: br"), (b"a\0b", "Content-Type: text/html"), (b"\x89PNG\0",)):
        assert conversion(*http(body, *headers)) is None


def test_damaged_pages():
    assert warc.plain_text("<a title='x>y' href=z>t</a> <p data-x=\"1>2\">u") == "t\nu"
    assert warc.plain_text("<p>a<!-- note <b>x</b> trailing words") == "a" and warc.plain_text("<p>a<script>var secret=1;b") == "a"
    assert warc.plain_text("a<!-->b<!-- - -->c<?x y>d<!doctype html>e</>f") == "a b cde</>f"
    assert warc.plain_text("<p title=\"a>b<p>c") == "b\nc"  # a quote that is never closed
    assert warc._scan("<a data-href='no' HREF = yes>x<a href=\"q?a=1&amp;b\"><a href><a name=x>").hrefs == ["yes", "q?a=1&amp;b"]
    assert warc._scan("<title>a <b> c</TITLE ><title>d</title>").title == "a <b> c" and warc._scan("<title>a<p>b").title is None


def test_derivatives_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "http://[bad", "<a href='http://[bad'>x"), (2, "u", ""), (2, "u", ""), (3, "v", "<p>" * 100_000), (4, "w", "plain < text > & more")], "page_id long, url string, html string")
    out = warc.derivatives(warc.responses(pages)).collect()
    assert len(out) == 12 and {r.headers["WARC-Type"] for r in out} == {"metadata", "conversion"}
    assert [bytes(r.block).decode() for r in out if r.page_id == 4 and r.headers["WARC-Type"] == "conversion"] == ["plain < text > & more"]
    assert warc.derivatives(warc.responses(pages.where("page_id > 9"))).count() == 0


def test_pages_that_never_close_their_tags():
    import time

    began = time.monotonic()
    for unit in ("<script>", "<p ", "<a ", "<!-- ", "<title>", "<a href=x <b", "</script ", "<", "&amp", "<a b='", "<a b=\">", "<a b='><a b=\"", "<?", "<a   ", "<title></p>", "=\"'"):
        page = unit * 60_000
        warc.plain_text(page)
        warc.plain_text("<p>" + page + "<script>" + page + ">")
        warc.derive(*warc.response("http://h.example/", page.encode()))
    assert time.monotonic() - began < 60
    assert warc.plain_text("<p>a<script>b<p>c") == "a" and warc.plain_text("a <b") == "a <b"
