"""Operators on pages: text extraction, archives, language."""

import hashlib

import pytest

from brevilog.llm import html_text, language_id, warc

SCHEMA = "page_id long, url string, html string, digest string, first string"


@pytest.mark.parametrize("html,text", [
    ("", ""), ("plain only", "plain only"), ("<p>one", "one"), ("<script>var a='<p>x</p>'</script>", ""), ("a &lt; b &amp; c <p", "a < b & c"),
    ("<body><nav><a>x</a></nav><article><h1>T &eacute;</h1><p><b>one\n  two<br>three<p>four</article><footer>f</footer>", "T é\n\none two three\n\nfour"),
    ("<article><header><h1>T</h1></header><p>x y</p><section class=comments><article class=comment><p>no no no</p></article></section></article>", "T\n\nx y"),
    ("<div id=menu><a>one</a></div><div class=content><h1>T</h1><p>A long enough paragraph of text, with words.<p>And a second one, as long as that."
     "</div><div class=ad-slot>Buy this</div><aside>side</aside><form>Sign up<input></form>",
     "T\n\nA long enough paragraph of text, with words.\n\nAnd a second one, as long as that."),
])
def test_extract(html, text):
    assert html_text.extract(html) == text


def words(name, n=40):
    return f"Paragraph {name} " + " ".join(f"{name}word{i}" for i in range(n)) + "."


@pytest.mark.parametrize("block", ["<div>{}</div>", "<section><div>{}</div></section>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<ol><li>{}</li></ol>",
                                   "<table><tr><td>{}</td></tr></table>", "<figure><figcaption>{}</figcaption></figure>", "<dl><dd>{}</dd></dl>"])
def test_text_in_several_blocks_without_article(block):
    parts = [words(c) for c in "abcdef"]
    html = ("<body><div><a href=x>Home</a> <a href=y>News</a></div><div><section><h2>First heading of it all here</h2><p>" + "</p><p>".join(parts[:4]) + "</p></section>"
            + "".join(block.format(f"<p>{p}</p>") for p in parts[4:]) + "</div></body>")
    got = html_text.extract(html)
    assert [p for p in parts if p in got] == parts and "News" not in got


@pytest.mark.parametrize("rest", ["<body><p>one</p><p>two</p>", "<p>one</p><p>two", "<div>one</div>two", "one<p>two"])
def test_head_that_is_not_closed(rest):
    assert html_text.extract("<html><head><title>T</title><meta name=x>\n<script>no</script>" + rest) == "one\n\ntwo"


def test_deep_page():
    assert html_text.extract("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"


def rows():
    big = "<p>" + "same page " * 30 + "</p>"
    return [(5, "http://a/b", big, "x", "y"), (3, "http://a/\r\nX: y", big, "x", "y"), (9, None, big, "x", "y"), (1, "u", None, "x", "y"), (2, "u", "", "x", "y"),
            (4, "u", "short", "x", "y"), (6, "u", "short", "x", "y"), (None, "u", big, "x", "y"), (7, "http://ü", "é" * 100, "x", "y"), (3, "again", big, "x", "y")]


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame(rows(), SCHEMA).repartition(2)
    archives = warc.write(pages, archive_bytes=500)
    got = sorted((repr(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(archives).collect())
    want = []
    for i, _, html, *_ in rows():
        raw = (html or "").encode()
        other = len(raw) >= 100 and html.startswith("<p>") and i != 3
        want.append((repr(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if other else "response", 3 if other else None))
    assert got == sorted(want)
    # real files, through Spark's own reader
    for r in archives.collect():
        (tmp_path / r.path).write_bytes(r.content)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert warc.read(files).count() == len(rows())
    assert warc.write(pages.limit(0)).count() == 0


def test_dictionary_and_damage(spark):
    pages = [warc.page_record(i, f"http://h/{i}", (f"<html><p>page {i} of many alike pages</p>" * 9).encode(), "", None) for i in range(300)]
    data = warc.archive(pages, "x")
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    assert list(warc.frames(data))[1:] == pages
    for bad in (data[:-3], data[:2000] + b"?" * 40 + data[2040:], b"?" * 50):
        with pytest.raises(ValueError):
            list(warc.frames(bad))
    good = warc.record("response", {"WARC-Record-ID": "<urn:x:1>"}, b"block")
    assert warc.parse(good)[1] == b"block"
    for bad in (good.replace(b"Content-Length: 5", b"Content-Length: 6"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"Other"), b""):
        with pytest.raises(ValueError):
            warc.parse(bad)
    table = spark.createDataFrame([("a", bytearray(b"?" * 50)), ("b", bytearray(data))], "path string, content binary")
    lax = warc.read(table, strict=False).collect()
    assert [r.path for r in lax if r.error and r.path == "a"] == ["a"]


def test_language(spark):
    docs = spark.createDataFrame([("the cat and the dog with this and that " * 5, "en", 1), ("der hund und die katze mit dem und das ist " * 5, "de", 1), (None, "en", 1), ("x", None, 1)],
                                 "text string, lang string, host int")
    pages = [(i, f"http://h{i % 3}.example.de/de/{i}", f"<html lang='de'><p>der hund und die katze {i}</p>", "", "") for i in range(40)]
    pages += [(100 + i, f"http://e.example.com/en/{i}", f"<html lang=en><p>this and the dog {i}</p>", "", "") for i in range(40)]
    pages += [(200, "http://h1.example.de/de/7", "<html lang=de><p>123</p>", "", ""), (201, None, None, "", ""), (202, "http://h2.example.de/", "", "", "")]
    got = {r.page_id: r for r in language_id.identify(spark.createDataFrame(pages, SCHEMA), docs).collect()}
    assert all(got[i].lang == "de" for i in range(40)) and all(got[100 + i].lang == "en" for i in range(40))
    assert got[200].lang == "de" and got[202].lang == "de"  # without text, by declaration, suffix and host
    assert got[201].lang in ("de", "en") and 0 < got[201].probability <= 1
    assert language_id.identify(spark.createDataFrame([], SCHEMA), docs).count() == 0
    assert language_id.identify(spark.createDataFrame(pages[:1], SCHEMA), docs.limit(0)).first().lang is None


def test_rare_declarations_count_by_themselves_and_empty_pages_do_not_vote(spark):
    docs = spark.createDataFrame([("the cat and the dog with this and that " * 5, "en"), ("der hund und die katze mit dem und das ist " * 5, "de")], "text string, lang string")
    say = {"en": "this and the dog", "de": "der hund und die katze"}
    pages = [(i, f"http://h{i}.example.org/", f"<html lang=en><p>{say['en']} {i}</p>", "", "") for i in range(60)]
    pages += [(100 + i, f"http://g{i}.example.org/", f"<html lang={x}><p>{say['de']} {i}</p>", "", "") for i, x in enumerate(["de", "de", "de", "nds", "nds", "nds"])]
    pages += [(300 + i, f"http://k{i}.example.org/", f"<html lang={x}><p>{say['en']} {i}</p>", "", "") for i, x in enumerate(["sco"] * 10)]
    few = spark.createDataFrame(pages, SCHEMA)
    asked = [(200, "http://x.other/", "<html lang=nds><p>1", "", ""), (201, "http://y.other/", "<html lang=sco><p>2", "", "")]
    asked = [(i, u, h, "", "") for i, u, h, *_ in asked]
    got = {r.page_id: r for r in language_id.identify(few.union(spark.createDataFrame(asked, SCHEMA)), docs).collect()}
    alone = {r.page_id: r for r in language_id.identify(few, docs).collect()}
    # seen three and ten times: each speaks for its own language
    share = lambda r: r.probability if r.lang == "de" else 1 - r.probability
    assert share(got[200]) > 2 * share(got[201])
    assert got[200].text_lang is None and got[100].text_lang == "de"
    # what pages without text are given tells nothing of others
    assert all(abs(got[i].probability - alone[i].probability) < 1e-12 and got[i].lang == alone[i].lang for i in alone)


def test_no_suffix_is_left_out(spark):
    """More values than any fixed number: the last ones count as the first ones do."""
    docs = spark.createDataFrame([("the cat and the dog with this and that " * 5, "en"), ("der hund und die katze mit dem und das ist " * 5, "de")], "text string, lang string")
    pages = [(i, f"http://a.t{i % 1500}/", "<p>der hund und die katze" if i % 1500 == 1499 else "<p>this and the dog", "", "") for i in range(30_000)]
    pages.append((-1, "http://b.t1499/", "", "", ""))
    got = language_id.identify(spark.createDataFrame(pages, SCHEMA), docs).where("page_id = -1").first()
    assert got.lang == "de" and got.text_lang is None


def test_damaged_archives_are_value_errors():
    """A damaged or cut dictionary, and a skippable frame that runs past the end, are errors as damaged frames are."""
    import struct

    import zstandard

    from brevilog.llm import warc
    press = zstandard.ZstdCompressor()
    record, held = press.compress(b"one record"), press.compress(bytes(range(256)) * 40)
    skip = lambda body, size=None: struct.pack("<II", warc.DICT_MAGIC, len(body) if size is None else size) + body
    other = struct.pack("<II", 0x184D2A51, 50) + b"too short"
    broken = held[:12] + bytes([held[12] ^ 0xFF]) + held[13:-3] + b"\0\0\0"
    for archive in (skip(held[:-5]) + record, skip(broken[:9] + b"\xff" * 20) + record, skip(held, len(held) + 999), record + other):
        with pytest.raises(ValueError):
            list(warc.frames(archive))
    assert list(warc.frames(record + struct.pack("<II", 0x184D2A51, 3) + b"abc" + record)) == [b"one record"] * 2
