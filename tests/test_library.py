"""EPUB rules, and the import of files in batches and by a stream that breaks off."""

import io
import zipfile

import pytest

from leafmill.scratch import Tables
from leafmill.sources import files
from leafmill.sources.packing import archive
from leafmill.streaming import library
from leafmill.streaming.library import TABLES, Library


def book(items, spine=None, opf="OPS/content.opf"):
    """items: (href, member name, bytes)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", f'<c:container xmlns:c="x"><c:rootfile full-path="{opf}"/></c:container>')
        manifest = "".join(f'<item id="i{n}" href="{href}"/>' for n, (href, _, _) in enumerate(items))
        order = "".join(f'<itemref idref="{i}"/>' for i in spine or [f"i{n}" for n in range(len(items))])
        z.writestr(opf, f'<package xmlns="y"><manifest>{manifest}<item id="half"/></manifest><spine>{order}<itemref/></spine></package>')
        for _, name, body in items:
            if name is not None:
                z.writestr(name, body)
    return out.getvalue()


def damaged(content, name):
    """The archive with a byte of one entry changed."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        info = z.getinfo(name)
    at = info.header_offset + 30 + len(info.filename) + info.compress_size // 2
    return content[:at] + bytes([content[at] ^ 0xFF]) + content[at + 1 :]


def test_epub_items():
    items = [
        ("a%20b.xhtml?x=1#top", "OPS/a b.xhtml", b"<h1> One </h1><p>x</p>"),
        ("empty.xhtml", "OPS/empty.xhtml", b"<p> </p><script>s</script>"),
        ("gb.xhtml", "OPS/gb.xhtml", "<p>中文</p>".encode("gb18030")),
        ("wide.xhtml", "OPS/wide.xhtml", b"\xff\xfe" + "<h2></h2><h2>宽</h2>".encode("utf-16-le")),
        ("bad.xhtml", "OPS/bad.xhtml", b"<p>" + bytes(range(256)) * 40 + b"</p>"),
        ("../up.xhtml", None, b""),
        ("gone.xhtml", None, b""),
        ("./c.xhtml", "OPS/c.xhtml", b"<table><tr><td>q<td>r</table>"),
    ]
    content = damaged(book(items, ["i0", "i1", "i2", "i3", "i4", "i5", "i6", "i7", "i0", "none", "half"]), "OPS/bad.xhtml")
    got = [(x[0], x[1], x[3], x[4], x[5]) for x in files.epub_items(content)]
    assert got == [
        (0, 0, "One", "One\n\nx", ""),
        (2, 1, "第 2 节", "中文", ""),
        (3, 2, "宽", "宽", ""),
        (4, None, None, None, "UNREADABLE_ITEM"),
        (5, None, None, None, "UNSAFE_CONTENT_PATH"),
        (6, None, None, None, "MISSING_CONTENT_FILE"),
        (7, 3, "第 4 节", "qr", ""),
        (8, 4, "One", "One\n\nx", ""),
        (9, None, None, None, "MISSING_SPINE_ITEM"),
        (10, None, None, None, "MISSING_SPINE_ITEM"),
    ]


def test_containers_that_cannot_be_used():
    why = lambda content: [x[-1] for x in files.epub_items(content)]
    good = book([("a", "OPS/a", b"<p>x</p>")])
    assert why(good) == [""] and why(b"") == why(good[:40]) == ["CORRUPT_CONTAINER"]
    assert why(damaged(good, "OPS/content.opf")) == ["CORRUPT_CONTAINER"]
    assert why(book([("a", "OPS/a", b" ")])) == ["NO_CONTENT"]
    assert why(book([("a", "a", b"<p>x</p>")], opf="content.opf")) == [""]
    assert why(book([("a", "OPS/a", b"x"), ("b", "../b", b"y")])) == ["UNSAFE_ENTRY"]


def tables(kept):
    out = {}
    for name in TABLES:
        df = kept.table(name)
        out[name] = sorted(map(str, df.collect()))
    return out


FILES = {
    "a.txt": "﻿　第一章 雨\n他来了。\n\n第二章\n完".encode("utf-8-sig"),
    "b.md": "中文没有标题，".encode("gb18030") * 30,
    "c.epub": book([("x", "OPS/x", b"<h1>T</h1><p>text</p>"), ("y", None, b"")]),
    "d.epub": b"no archive",
    "e.mobi": b"x",
    "f.TXT": b"",
}


def test_import_of_all_formats(spark):
    made = files.import_files(spark.createDataFrame([*FILES.items(), ("copy.md", FILES["b.md"])], "path string, content binary"))
    assert {(r["path"], r["format"], r["encoding"]) for r in made["documents"].collect()} == {("a.txt", "text", "utf-8-bom"), ("b.md", "markdown", "gb18030"), ("c.epub", "epub", None), ("f.TXT", "text", "utf-8")}
    name = {r["document_id"]: r["path"] for r in made["documents"].collect()}
    assert {(name[r["document_id"]], r["ordinal"], r["title"]) for r in made["chapters"].collect()} == {("a.txt", 0, "第一章 雨"), ("a.txt", 1, "第二章"), ("b.md", 0, "正文"), ("c.epub", 0, "T"), ("f.TXT", 0, "正文")}
    issues = {(r["path"], r["ordinal"], r["code"], r["severity"]) for r in made["issues"].collect()}
    assert {("d.epub", None, "CORRUPT_CONTAINER", "error"), ("e.mobi", None, "UNSUPPORTED_FORMAT", "error"), ("c.epub", 1, "MISSING_CONTENT_FILE", "warning"), ("b.md", None, "NO_CHAPTER_HEADINGS", "warning"), ("f.TXT", None, "EMPTY_DOCUMENT", "error")} <= issues
    assert {r["content"] for r in made["segments"].collect()} >= {"他来了。", "完", "T", "text"}


def test_a_batch_counts_once(spark):
    kept = Library(spark, Tables(spark).path("library"))
    rows = spark.createDataFrame(list(FILES.items()), "path string, content binary")
    assert kept.table("documents") is None
    assert kept.add(rows.where("path < 'c'"), "1") == 1
    first = tables(kept)
    assert kept.add(rows.where("path < 'c'"), "1") == 1 and tables(kept) == first
    assert kept.add(rows, "2") == 2 and len(tables(kept)["documents"]) == 4
    assert kept.add(rows.limit(0), "3") == 3
    assert sorted(map(str, kept.table("documents", 1).collect())) == first["documents"]


def test_a_stream_that_breaks_off_goes_on(spark, tmp_path, monkeypatch):
    source, checkpoint = tmp_path / "in", str(tmp_path / "check")
    source.mkdir()
    for name in ("a.txt", "c.epub"):
        (source / name).write_bytes(FILES[name])
    kept = Library(spark, f"file://{tmp_path}/library")
    kept.follow(f"file://{source}", f"file://{checkpoint}")
    assert {r["format"] for r in kept.table("documents").collect()} == {"text", "epub"}
    (source / "sub").mkdir()
    (source / "sub" / "b.md").write_bytes(FILES["b.md"])
    (source / "again.txt").write_bytes(FILES["a.txt"])
    real, calls = library.Store.commit, []

    def breaking(self, entries, after=None):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("power cut")
        return real(self, entries, after)

    monkeypatch.setattr(library.Store, "commit", breaking)
    with pytest.raises(Exception, match="power cut"):
        kept.follow(f"file://{source}", f"file://{checkpoint}")
    assert kept.table("documents").count() == 2  # what the broken batch has written is not there
    kept.follow(f"file://{source}", f"file://{checkpoint}")
    assert kept.table("documents").count() == 3 and kept.table("chapters").count() == 4
    version = kept.store.latest()
    kept.follow(f"file://{source}", f"file://{checkpoint}")
    assert kept.store.latest() == version


def test_packed_pages_are_read_again():
    assert [x[4] for x in files.epub_items(archive([("p.xhtml", "<p>a</p><div>b</div>")]))] == ["a\n\nb"]


def test_a_batch_cuts_its_files_once(spark, tmp_path, monkeypatch):
    from leafmill.operators import structure
    from leafmill.streaming import library

    seen, cut, given = spark.sparkContext.accumulator(0), structure._cut, []
    made = library.import_files
    monkeypatch.setattr(library, "import_files", lambda *a: given.append(a) or made(*a))

    def counted(docs, key, text, how, columns):
        return cut(docs, key, text, lambda t: (seen.add(1), how(t))[1], columns)

    monkeypatch.setattr(structure, "_cut", counted)
    kept = library.Library(spark, str(tmp_path / "kept"))
    kept.add(spark.createDataFrame([(f"{n}.txt", f"第1章 a\n{n}".encode()) for n in range(10)], "path string, content binary"), "one")
    assert seen.value == 20  # lines once, segments once
    kept.add(spark.createDataFrame([(f"{n}.txt", f"第1章 a\n{n}".encode()) for n in range(12)], "path string, content binary"), "two")
    assert seen.value == 24 and given[-1][0].count() == 2  # known files are not cut again
    assert [kept.table(n).count() for n in ("documents", "chapters", "segments")] == [12, 12, 12]
