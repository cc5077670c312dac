from __future__ import annotations

import io
import json
import zipfile

import pytest

from quillforge.operators.render import Node, render_markdown, render_plain
from quillforge.sources import files, formats, media, store
from quillforge.streaming import ingest


@pytest.fixture
def folder(tmp_path):
    put = lambda name, data: ((tmp_path / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / name).write_bytes(data))
    put("a.md", b"# H\n\ntext\n")
    put("b.csv", b"x,y\n1,2\n")
    put("c.json", b'{"a": [1, true, null]}')
    put("sub/d.txt", b"bad \xff byte\r\nend")
    put("sub/e.toml", b"a = 1")
    put("sub/copy.md", b"# H\n\ntext\n")
    put("f.bin", b"\x00\x01")
    put("broken.json", b"{nope")
    put(".hidden/g.txt", b"x")
    put("sub/.h.txt", b"x")
    put("_b.txt", b"under")
    put("_sub/c=d.txt", b"x")
    return tmp_path


def test_scan_and_parse(spark, folder):
    found = files.scan(spark, str(folder))
    names = {r.path.rsplit("/", 1)[-1] for r in found.select("path").collect()}
    plain = {"a.md", "b.csv", "c.json", "d.txt", "e.toml", "copy.md", "f.bin", "broken.json", "_b.txt", "c=d.txt"}
    assert names == plain and found.count() == 10
    every = files.scan(spark, str(folder), skip_hidden=False)
    assert {r.path.rsplit("/", 1)[-1] for r in every.select("path").collect()} == plain | {"g.txt", ".h.txt"} and every.count() == 12
    assert {bytes(r.content) for r in every.where("path LIKE '%/_b.txt'").collect()} == {b"under"}
    assert len({r.doc_id for r in found.select("doc_id").collect()}) == 9
    rows = files.parse_files(found).collect()
    by = {}
    for r in rows:
        by.setdefault(r.location.rsplit("/", 1)[-1], []).append(r)
    assert [r.content for r in by["c.json"]][1] == "{'a': [1, True, None]}" and by["d.txt"][1].content == "bad \ufffd byte\nend"
    assert [r.ctype for r in by["b.csv"]] == ["root", "table", "tablerow", "tablerow"] and json.loads(by["b.csv"][1].metadata)["last_row_with_data"] == 1
    assert by["f.bin"][0].error == "no parser" and len(by["f.bin"]) == 1
    assert by["broken.json"][1].content == "{nope" and by["broken.json"][0].error is None
    assert [r.ctype for r in by["a.md"]] == ["root", "header", "para"] and [r.path for r in by["a.md"]] == [[0], [0, 0], [0, 0, 0]]


def test_registry():
    reg = files.ParserRegistry({"t": [formats.parse_text]})
    mine, other = (lambda d, p: Node("", "root")), (lambda d, p: Node("", "root"))
    reg.register({"t": [mine]})
    assert reg.resolve("x", "t") == [mine, formats.parse_text] and reg.resolve("x", "u") == []
    with pytest.raises(ValueError):
        reg.resolve("x", "u", strict=True)
    with pytest.raises(KeyError), reg.temporary({"t": [other]}, [lambda p, m: mine if p == "x" else None]):
        assert reg.resolve("x", "t") == [mine, other, mine, formats.parse_text]
        raise KeyError
    assert reg.resolve("x", "t") == [mine, formats.parse_text]
    always = lambda d, p: Node("", "root")
    reg.register(callbacks=[lambda p, m: always])
    with reg.temporary({"t": [other]}):  # temporary extras come before registered callbacks
        assert reg.resolve("x", "t") == [other, always, mine, formats.parse_text]
        with reg.temporary(callbacks=[lambda p, m: mine]):
            assert reg.resolve("x", "t") == [mine, other, always, mine, formats.parse_text]


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, x in parts.items():
            z.writestr(n, x)
    return out.getvalue()


def test_xlsx():
    rels = '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>'
    book = '<workbook xmlns:r="http://x/r"><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>'
    sheet = '<worksheet><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><v>3.0</v></c></row><row r="3"><c r="B3"><v>2.5</v></c><c r="C3" t="e"><v>#N/A</v></c></row></sheetData><mergeCells><mergeCell ref="A2:B2"/></mergeCells></worksheet>'
    root = formats.parse_xlsx(zipped({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": "<sst><si><t>a\nb</t></si></sst>"}), "x")
    table = root.children[0].children[0]
    assert root.children[0].content == "S" and [r.content for r in table.children] == ["a\\\\nb,,3", ",2.5,"]
    assert table.metadata == {"merged_cells": [[0, 0, 0, 1]], "first_row_with_data": 1, "last_row_with_data": 2}


def test_docx_pptx_odt_epub_rtf():
    w = 'xmlns:w="http://x/w"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    assert render_plain(formats.parse_docx(zipped({"word/document.xml": doc}), "x")) == "H\n\ntext\n\nx"
    slide = '<sld xmlns:a="http://x/a"><a:sp><a:off x="5" y="9"/><a:p><a:t>second</a:t></a:p></a:sp><a:sp><a:ph type="title"/><a:off x="1" y="1"/><a:p><a:t>first</a:t></a:p></a:sp><a:graphicFrame><a:off x="0" y="20"/><a:tbl><a:tr><a:tc><a:t>a|b</a:t></a:tc></a:tr></a:tbl></a:graphicFrame></sld>'
    s = formats.parse_pptx(zipped({"ppt/slides/slide1.xml": slide}), "x").children[0]
    assert s.content == "**Slide 1**" and [c.content for c in s.children] == ["first", "second", "| a\\|b |\n| --- |"] and s.children[0].ctype == "header"
    odt = '<o xmlns:t="http://x/t"><text><t:h t:outline-level="2">H</t:h><t:p>body</t:p></text></o>'
    assert [n.ctype for _, n in formats.parse_odt(zipped({"content.xml": odt}), "x").walk()] == ["root", "header", "para"]
    epub = {"META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<p><item id="1" href="a.xhtml"/><itemref idref="1"/></p>', "o/a.xhtml": "<h1>T</h1><p>x</p>"}
    assert render_markdown(formats.parse_epub(zipped(epub), "x")) == "# T\n\nx"
    rtf = rb"{\rtf1{\fonttbl{\f0 Arial;}}one\par tw\'e9o \u233?x\{\par}"
    assert [c.content for c in formats.parse_rtf(rtf, "x").children] == ["one", "twéo éx{"]


def test_html():
    html = b"<html><head><title>t</title></head><body><h1>A &amp; B</h1><p>one<br>two</p><div style='display: none'>no</div><ul><li>x<ul><li>y</li></ul></li></ul><h2>S</h2><table><tr><td>1</td><td>a b</td></tr><tr><td></td></tr></table><pre>  code</pre><p></p></body></html>"
    root = formats.parse_html(html, "x")
    assert root.children[0].content == "A & B" and root.children[0].children[0].content == "one\ntwo"
    sub = root.children[0].children[-1]
    assert sub.content == "S" and [c.ctype for c in sub.children] == ["table", "code"] and [r.content for r in sub.children[0].children] == ["1,a b"]
    assert "no" not in render_plain(root).split() and "- x" in render_plain(root) and "- y" in render_plain(root)
    assert formats.parse_html(b"", "x").children == []
    broken = formats.parse_html(b"<p>a</p><![foo[x]]><p>b</p>", "x")
    assert [c.content for c in broken.children] == ["a", "b"]


def test_ipynb_and_markup():
    nb = {"cells": [{"cell_type": "markdown", "source": ["# T\n", "text"]}, {"cell_type": "code", "source": "1+1", "outputs": [{"data": {"text/plain": ["2"]}}]}]}
    assert [c.content for c in formats.parse_ipynb(json.dumps(nb).encode(), "x").children] == ["# T", "1+1", "2"]
    assert render_markdown(formats.parse_rst(b"Top\n===\n\ntext\n\nSub\n---\n\nmore", "x")) == "# Top\n\ntext\n\n## Sub\n\nmore"
    assert render_markdown(formats.parse_org(b"* A\nx\n** B\ny", "x")) == "# A\n\nx\n\n## B\n\ny"
    assert render_markdown(formats.parse_tex(b"\\section{A}\nx\n\\subsection{B}\ny", "x")) == "# A\n\nx\n\n## B\n\ny"


def test_media(spark):
    parse = media.page_parser(lambda: lambda d, p: [media.Element("Title", "T", 1, (0, 0, 1, 0.1)), media.Element("table", "x", 2)], by_page=True)
    root = parse(b"", "x")
    assert [(n.ctype, n.metadata.get("page")) for _, n in root.walk()] == [("root", None), ("page", 1), ("header", 1), ("page", 2), ("table", 2)]
    heard = media.speech_parser(lambda: lambda d, p: [{"start": 0, "end": 1, "text": " a "}, {"start": 1, "end": 2, "text": "b"}], "video")(b"", "x").children[0]
    assert heard.content == "a b" and heard.metadata["source_type"] == "video" and len(heard.metadata["segments"]) == 2


def test_store(spark, tmp_path):
    rows = [("d", "r", None, [0], "root", None), ("d", "a", "r", [0, 0], "para", b"x"), ("d", "b", "a", [0, 0, 0], "para", None)]
    t = spark.createDataFrame(rows, "doc_id string, chunk_id string, parent_id string, path array<int>, ctype string, content_bytes binary")
    s = store.ChunkStore(spark, str(tmp_path / "s"))
    s.save(t)
    s.save(t.where("chunk_id = 'a'").withColumn("ctype", t.doc_id), 1)
    assert s.nodes().count() == 3 and s.get("a").first().ctype == "d" and s.contains("b") and not s.contains("z")
    assert {r.chunk_id: r.content_bytes for r in s.content(s.nodes()).collect()}["a"] == b"x"
    gone = t.where("chunk_id = 'a'")
    assert s.without(gone).count() == 2 and s.without(gone, cascade=True).count() == 1


def test_stream(spark, folder, tmp_path_factory):
    out, check = tmp_path_factory.mktemp("out"), tmp_path_factory.mktemp("check")
    run = lambda: ingest.ingest(spark, str(folder), f"{out}/nodes", str(check)).awaitTermination(120)
    assert run()
    first = spark.read.parquet(f"{out}/nodes")
    assert first.where("ctype = 'root'").count() == 7
    (folder / "new.md").write_bytes(b"# New\n")
    (folder / "again.md").write_bytes(b"# H\n\ntext\n")
    assert run()
    assert spark.read.parquet(f"{out}/nodes").where("ctype = 'root'").count() == 8


@pytest.mark.parametrize("kind", ["file", "memory"])
def test_store_groups_deletes_and_links(spark, tmp_path, kind):
    s = store.ChunkStore(spark, str(tmp_path / "g")) if kind == "file" else store.MemoryStore(spark)
    with pytest.raises(ValueError):
        s.nodes()
    rows = [("d", "r", None, [0], b"x"), ("d", "a", "r", [0, 0], None), ("d", "a1", "a", [0, 0, 0], b"y"), ("d", "b", "r", [0, 1], None), ("e", "z", None, [0], None)]
    nodes = spark.createDataFrame(rows, "doc_id string, chunk_id string, parent_id string, path array<int>, content_bytes binary")
    s.save_group(spark.createDataFrame([("r", 0, "a"), ("r", 1, "b")], "root_id string, group_ord bigint, chunk_id string"), nodes)
    assert {r.chunk_id for r in s.nodes().collect()} == {"a", "a1", "b"}
    s.save(nodes, 1)
    assert s.nodes().count() == 5 and {r.chunk_id: r.content_bytes for r in s.content(s.nodes()).where("content_bytes IS NOT NULL").collect()} == {"r": bytearray(b"x"), "a1": bytearray(b"y")}
    assert {r.chunk_id: r.to_chunk_id for r in store.linked(s.nodes(), "parent_id", s).collect()} == {"r": None, "a": "r", "a1": "a", "b": "r", "z": None}
    with pytest.raises(ValueError):
        store.linked(nodes, "parent_id", None)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "chunk_id string")
    s.delete(ids("a", "nobody"), cascade=True, round_no=1)
    assert {r.chunk_id for r in s.nodes().collect()} == {"r", "b", "z"} and not s.contains("a1")
    s.delete(ids("r"), round_no=1)
    s.save(nodes.where("chunk_id = 'a'"), 2)
    assert {r.chunk_id for r in s.nodes().collect()} == {"a", "b", "z"}
