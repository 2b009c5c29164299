"""Operator 4 on responses that are packed, encoded or written in odd ways, and its query over made pages."""

import gzip
import hashlib
import html
import random
import zlib

import pytest

pytest.importorskip("kinloom.llm")

from kinloom.llm import queries as Q  # noqa: E402
from kinloom.llm import warc_derive as W  # noqa: E402


def derived(head, payload, **more):
    named = {"WARC-Type": "response", "WARC-Record-ID": "<urn:x>"} | more
    data = W.record(list(named.items()), b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + payload)
    about, text = (list(W.records(r))[0] for r in W.derive(1, data))
    return about[1].decode(), text[1].decode()


PAGE = "<p>caf\xe9 €</p>"


@pytest.mark.parametrize(
    "head, payload, text",
    [
        (b"Content-Type: text/html; charset=idna", b"<p>a..b\xff", "a..b�"),
        (b"Content-Type: text/html; charset=undefined", b"<p>x", "x"),
        (b"Content-Type: text/html; charset=base64", b"<p>x", "x"),
        (b"Content-Type: text/html; charset=no-such", b"<p>x", "x"),
        (b"Content-Type: text/html; charset=iso-8859-15", PAGE.encode("iso-8859-15"), "caf\xe9 €"),
        (b"Content-Type: text/html", b'<meta charset="windows-1252">' + PAGE.encode("cp1252"), "caf\xe9 €"),
        (b"Content-Type: text/html", b"<META http-equiv=x content='text/html; charset=windows-1252'>" + PAGE.encode("cp1252"), "caf\xe9 €"),
        (b"Content-Type: text/html; charset=latin-1", b"\xef\xbb\xbf" + PAGE.encode(), "caf\xe9 €"),
        (b"Content-Type: text/html", b"\xff\xfe" + PAGE.encode("utf-16-le"), "caf\xe9 €"),
        (b"Content-Type: text/html", b'<meta charset="utf-16"><p>x', "x"),
        (b"Content-Encoding: gzip", gzip.compress(b"<p>one ") + gzip.compress(b"two"), "one two"),
        (b"Content-Encoding: gzip", gzip.compress(b"<p>one") + b"rubbish behind", "one"),
        (b"Content-Encoding: gzip", gzip.compress(b"<p>one two three")[:-9], "one two three"[:0] or None),
        (b"Content-Encoding: gzip", b"<p>not packed", "not packed"),
        (b"Content-Encoding: deflate, gzip", gzip.compress(zlib.compress(b"<p>twice")), "twice"),
        (b"Content-Encoding: identity", b"<p>x", "x"),
        (b"Content-Type: image/png", b"<p>x", ""),
    ],
)
def test_charsets_and_codings(head, payload, text):
    got = derived(head, payload)[1]
    assert got == text if text is not None else "one two three".startswith(got)


def test_what_cannot_be_read_has_no_text_and_says_so(monkeypatch):
    for coding in ("br", "zstd"):
        about, text = derived(f"Content-Encoding: {coding}".encode(), b"\x1b\x00packed")
        assert text == "" and f"no-text: content-encoding {coding}\r\n" in about
    monkeypatch.setattr(W, "MOST", 1000)
    about, text = derived(b"Content-Encoding: gzip", gzip.compress(b"x" * 2000))
    assert text == "" and "no-text: too large\r\n" in about
    assert "no-text" not in derived(b"Content-Encoding: gzip", gzip.compress(b"x" * 999))[0]


def test_headers_keep_their_lines_and_an_id_is_made_up():
    about, _ = derived(b"Set-Cookie: a=1\r\nSET-COOKIE: b=2,3\r\nX-Fold: one\r\n two", b"x")
    assert "source-http-Set-Cookie: a=1\r\nsource-http-SET-COOKIE: b=2,3\r\nsource-http-X-Fold: one two\r\n" in about
    data = W.record([("WARC-Type", "response")], b"HTTP/1.1 200 OK\r\n\r\n<p>x")
    first, second = (W.derive(None, data) for _ in range(2))
    own = list(W.records(first[0]))[0][0]
    assert first == second and own["warc-refers-to"].startswith("<urn:uuid:")


@pytest.mark.parametrize(
    "page, text",
    [('<a title="1 > 0">t</a>', "t"), ("<p class='a>b'>t<br title=\"<\">u", "t\nu"), ("<a title=x>y", "y"), ("1 < 2 <b>x</b> <3", "1 < 2 x <3"), ("<a b='c'd>e", "e")],
)
def test_quoted_values_are_whole(page, text):
    assert W.plain_text(page) == text


def made(rng):
    """A page and its text, built side by side."""
    page, lines, line = [], [], ""
    for _ in range(rng.randrange(1, 12)):
        word = rng.choice(["plain", "a & b", "x < y", "caf\xe9", "tag", "中文", "it's"])
        kind = rng.randrange(7)
        if kind == 0:
            page.append(rng.choice(["<p>", "<br>", '<div class="x > y">', "</li>"]))
            lines.append(line)
            line = ""
        elif kind == 1:
            page.append(rng.choice(["<script>var x = '<p>no</p>'</script>", "<style>p > a {}</style>", "<!-- no <p> -->", "<noscript>no</noscript>", "<svg><text>no</text></svg>"]))
            line += " "
        elif kind == 2:
            page.append(f'<a href="?a=1&b=\'2\'" title="{html.escape(word)} >">{html.escape(word)}</a>')
            line += word
        else:
            page.append(html.escape(word) + rng.choice([" ", "  \t", "\n"]))
            line += word + " "
    lines.append(line)
    return "".join(page), "\n".join(x for x in (" ".join(y.split()) for y in lines) if x)


def test_the_query_against_pages_whose_text_is_known(spark, tmp_path):
    rng = random.Random(8)
    pages = [(k // 2, f"http://h/{k % 7}" if k % 5 else None, *made(rng)) for k in range(300)] + [(None, "u", None, ""), (9, "u", "", ""), (9, "u", "", "")]
    spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = Q.QUERIES["op4_warc_derive"](spark, str(tmp_path)).collect()
    text = sorted((repr(r["page_id"]), r["target_uri"] or "", r["source_digest"], r["chars"], r["block_sha256"]) for r in got if r["type"] == "conversion")
    want = sorted((repr(k), u or "", W.digest((h or "").encode()), len(t), hashlib.sha256(t.encode()).hexdigest()) for k, u, h, t in pages)
    assert text == want and len({r["record_id"] for r in got}) == len(got) == 2 * len(pages)
    again = Q.QUERIES["op4_warc_derive"](spark, str(tmp_path)).select("record_id").collect()
    assert {r["record_id"] for r in again} == {r["record_id"] for r in got}
