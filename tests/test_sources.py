"""File parsers, stores and the stream of changes."""

import io
import zipfile

from pyspark.sql import functions as F

from lectern.operators import analytics, pages
from lectern.sources import files, stores
from lectern.streaming import changes


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


W = 'xmlns:w="urn:w"'
DOCX = zipped(word__document_xml=f'<w:document {W}><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>')
ODS = zipped(content_xml='<d xmlns:t="urn:t" xmlns:x="urn:x"><t:table t:name="S1"><t:table-row><t:table-cell><x:p>a</x:p></t:table-cell><t:table-cell/></t:table-row><t:table-row><t:table-cell/></t:table-row></t:table></d>')
ODT = zipped(content_xml='<d xmlns:x="urn:x"><x:h>Title</x:h><x:p>One <x:s>two</x:s></x:p><x:p> </x:p></d>')
ODP = zipped(content_xml='<d xmlns:x="urn:x"><x:frame/><x:frame><x:p>Hello</x:p></x:frame></d>')
SLIDE = '<s xmlns:a="urn:a"><a:txBody><a:p><a:t>{}</a:t></a:p></a:txBody></s>'


def pptx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/presentation.xml", '<p xmlns:r="urn:r"><sldId id="1" r:id="r2"/><sldId id="2" r:id="r1"/></p>')
        z.writestr("ppt/_rels/presentation.xml.rels", '<R><X Id="r1" Target="slides/slide1.xml"/><X Id="r2" Target="slides/slide2.xml"/></R>')
        z.writestr("ppt/slides/slide1.xml", SLIDE.format("last"))
        z.writestr("ppt/slides/slide2.xml", SLIDE.format("first"))
    return out.getvalue()


def test_files(spark):
    given = {
        "/a/x.DOCX": (DOCX, "One\ttwo\n\nThree\na | b"), "/a/x.ods": (ODS, "--- S1 ---\na | "), "/a/x.odt": (ODT, "One two\n\n# Title"), "/a/x.odp": (ODP, "--- Slide 2 ---\nHello"),
        "/a/x.pptx": (pptx(), "--- Slide 1 ---\nfirst\n\n\n--- Slide 2 ---\nlast\n"), "/a/x.eml": (b"Subject: S\nFrom: a@b\nTo: c@d\n\nBody\n", "Subject: S\nFrom: a@b\nTo: c@d\n\nBody\n"),
        "/a/x.rtf": (rb"{\rtf1{\fonttbl{\f0 Arial;}}\f0 caf\'e9 \u8364?5\par {\b bold} \{x\}}", "café €5\nbold {x}"), "/a/x.html": (b"<p>One <b>two</b></p><script>no()</script>", "One\ntwo"), "/a/x.txt": ("é".encode("latin-1"), "é"),
    }
    rows = [(p, bytearray(d)) for p, (d, _) in given.items()] + [("/a/bad.docx", bytearray(b"no zip")), ("/a/x.xyz", bytearray(b"")), ("/a/none.txt", None)]
    got = {r["path"]: r for r in files.parsed(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert {p: got[p]["content"] for p in given} == {p: t for p, (_, t) in given.items()}
    assert [got[p]["status"] for p in ("/a/bad.docx", "/a/x.xyz", "/a/none.txt")] == ["error", "error", "empty"]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b";c', None), (2, None, "x")], "id long, q string, c string")
    stores.export_csv(df, f"{tmp_path}/csv", "id")
    lines = [x for f in sorted((tmp_path / "csv").glob("*.csv")) for x in f.read_text().splitlines()]
    assert [x for x in lines if x != lines[0]] == ['"2";"";"x"', '"1";"a ""b"";c";""'] and lines[0] == '"id";"q";"c"'
    points = spark.createDataFrame([("7", "p"), ("6F7F2C3A-1b6e-4b8a-9c2d-5e1f0a9b8c7d", "q"), ("z", "r")], "id string, payload string")
    stores.export_points(points, f"{tmp_path}/points")
    got = stores.import_points(spark, f"{tmp_path}/points", "id string, payload string").orderBy("payload").collect()
    assert [(r["number"], r["uuid"]) for r in got] == [(7, None), (None, "6f7f2c3a-1b6e-4b8a-9c2d-5e1f0a9b8c7d"), (None, None)]


def workbook():
    rels = '<R><X Id="r1" Target="worksheets/sheet1.xml"/><X Id="r2" Target="worksheets/sheet2.xml"/></R>'
    book = '<b xmlns:r="urn:r"><sheets><sheet name="Un" r:id="r2"/><sheet name="Deux" r:id="r1"/></sheets></b>'
    one = '<w><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row r="2"><c r="A2"/></row><row r="3"><c r="B3" t="inlineStr"><is><t>x|y</t></is></c></row></w>'
    return zipped(**{"xl__workbook_xml": book, "xl__sharedStrings_xml": "<s><si><t>nom</t></si></s>", "xl___rels__workbook_xml.rels": rels, "xl__worksheets__sheet1_xml": "<w/>", "xl__worksheets__sheet2_xml": one})


def test_workbooks(spark):
    rows = spark.createDataFrame([("/a/b.xlsx", bytearray(workbook())), ("/a/broken.xlsx", bytearray(b"x"))], "path string, content binary")
    got = {r["path"]: r for r in files.parsed(rows).collect()}
    assert got["/a/b.xlsx"]["content"] == "## Un\n\n| nom |  | 2.5 |\n|---|---|---|\n|  | x\\|y |  |\n\n---\n\n## Deux\n"
    assert got["/a/broken.xlsx"]["status"] == "error"
    assert [tuple(r) for r in files.sheet_rows(rows).collect()] == [("/a/b.xlsx", "Un", 0, ["nom", "", "2.5"]), ("/a/b.xlsx", "Un", 1, ["", "x|y"])]


def test_front_matter_is_no_text(spark):
    rows = spark.createDataFrame([("/a.md", bytearray("\ufeff---\nclient: x\n---\nBonjour".encode())), ("/b.md", bytearray(b"---\nno end"))], "path string, content binary")
    assert {r["path"]: r["content"] for r in files.parsed(rows).collect()} == {"/a.md": "Bonjour", "/b.md": "---\nno end"}


def test_folders_golden_sets_and_logs(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "a.txt").write_text("un")
    (tmp_path / "deep" / "er" / "b.html").write_text("<p>deux</p>")
    assert sorted(r["content"] for r in files.read_folder(spark, str(tmp_path / "deep")).collect()) == ["deux", "un"]
    (tmp_path / "golden.jsonl").write_text('{"id": "A-1", "question": "q", "sources_reference": ["Tome 1"]}\n\nnot json\n{"id": "A-2"}\n')
    assert [(r["id"], r["sources_reference"]) for r in files.golden_set(spark, str(tmp_path / "golden.jsonl")).orderBy("id").collect()] == [("A-1", ["Tome 1"]), ("A-2", None)]
    (tmp_path / "w.log").write_text("\n".join(f"line {k}" if k % 3 else " " for k in range(100)))
    assert [tuple(r) for r in files.log_tail(spark, str(tmp_path / "w.log"), 3).orderBy("nth").collect()] == [(0, "line 95"), (1, "line 97"), (2, "line 98")]


def test_stores(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS stores LOCATION '%s'" % (tmp_path / "db"))
    spark.catalog.setCurrentDatabase("stores")
    try:
        sheet = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
        stores.replace_table(sheet, "t_one", "/x/book.xlsx", "One")
        stores.replace_table(sheet, "t_two", "/x/book.xlsx", "Two")
        stores.replace_table(sheet.limit(1), "t_one", "/x/book.xlsx", "One")
        stores.replace_table(sheet, "t_three", "/x/other.xlsx", "Three")
        assert {r["table_name"]: r["row_count"] for r in stores.sheet_catalog(spark).collect()} == {"t_one": 1, "t_two": 2, "t_three": 2}
        stores.drop_table(spark, "t_two")
        assert stores.drop_source(spark, "/x/book.xlsx") == ["t_one"]
        assert [r["table_name"] for r in stores.sheet_catalog(spark).collect()] == ["t_three"] and not spark.catalog.tableExists("t_one")
        index = spark.range(2500).select(F.col("id").alias("document_id"), F.lit("x").alias("text"))
        assert stores.create_index(index, "idx_docs", buckets=4) and not stores.create_index(index, "idx_docs", buckets=4)
        seen, last = [], None
        while page := [r["document_id"] for r in stores.scroll(spark, "idx_docs", last).collect()]:
            seen, last = seen + page, page[-1]
        assert seen == list(range(2500))
        stores.create_index(index, "idx_more", buckets=4)
        stores.drop_index(spark, "IDX_MORE")
        assert not spark.catalog.tableExists("idx_more") and stores.clear_indexes(spark, "IDX_") == ["idx_docs"]
    finally:
        spark.catalog.setCurrentDatabase("default")
        spark.sql("DROP DATABASE stores CASCADE")


def test_wrapped_exports_and_reports(spark, tmp_path):
    points = spark.createDataFrame([("7", "p"), ("8", 'q"')], "id string, payload string").repartition(2)
    for kind in ("points", "documents"):
        stores.export_wrapped(points, f"{tmp_path}/{kind}", "c", kind)
        got = stores.import_points(spark, f"{tmp_path}/{kind}", "id string, payload string").orderBy("id").collect()
        assert [(r["id"], r["payload"], r["number"]) for r in got] == [("7", "p", 7), ("8", 'q"', 8)]
    stores.export_csv(points.orderBy("id").coalesce(1), f"{tmp_path}/bom", bom=True)
    text = "".join(f.read_text(encoding="utf-8") for f in (tmp_path / "bom").glob("part-*"))
    assert text == '\ufeff"id";"payload"\n"7";"p"\n"8";"q"""\n'
    rows = spark.createDataFrame([("p", True, True, "COUVERT", 2, 1), ("q", False, True, "PARTIEL", None, None)], "projet string, evasive boolean, right_volume boolean, coverage string, facts int, invention int")
    stores.export_campaign(rows, analytics.campaign(rows, "projet"), f"{tmp_path}/campaign")
    lines = "".join(f.read_text() for f in (tmp_path / "campaign" / "report").glob("part-*")).splitlines()
    assert lines[0].startswith("all ") and "cases 2  evasive 1  right volume 2  coverage 1/1/0  facts 2.0" in lines[0] and len(lines) == 3
    assert spark.read.json(f"{tmp_path}/campaign/rows").count() == 2


def test_changes(spark, tmp_path):
    schema = "path string, action string, content_hash string, seq long"
    days = [
        [("a", "upsert", "h1", 1), ("a", "upsert", "h2", 2), ("b", "upsert", "h1", 3), ("c", "delete", None, 4)],
        [("a", "upsert", "h2", 5), ("b", "delete", None, 6), ("d", "upsert", "h1", 7)],
        [("a", "upsert", "h3", 8), ("b", "upsert", "h1", 9)],
    ]
    store = f"{tmp_path}/store"
    for day in days:
        spark.createDataFrame(day, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        changes.apply_changes(stream, store, f"{tmp_path}/checkpoint").awaitTermination()
    got = {r["path"]: (r["content_hash"], r["version"]) for r in changes.current(spark, store, stream.schema).collect()}
    assert got == {"a": ("h3", 2), "b": ("h1", 1), "d": ("h1", 1)}


def test_texts_of_all_extensions(spark):
    rows = [(f"/d/a{x}", bytearray("clé: 1\n".encode(e))) for x, e in ((".rst", "utf-8"), (".ini", "latin-1"), (".cfg", "utf-8"), (".yaml", "utf-8"), (".YML", "latin-1"))]
    got = files.parsed(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert {(r["status"], r["content"]) for r in got} == {("ok", "clé: 1\n")} and len(got) == 5


def test_golden_lines_that_are_none(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"id": "1", "question": "q"}\n\n{"question": "no id"}\nnot json\n{"id": "2"\n')
    assert [r["id"] for r in files.golden_set(spark, str(tmp_path / "g.jsonl")).collect()] == ["1"]
    assert sorted((r["line"], r["error"]) for r in files.golden_errors(spark, str(tmp_path / "g.jsonl")).collect()) == [("not json", "no JSON"), ('{"id": "2"', "no JSON"), ('{"question": "no id"}', "no id")]


def test_sure_blocks(spark):
    blocks = [("d", 1, 1, "b", 0.3), ("d", 1, 0, "a", 0.9), ("d", 1, 2, "c", 0.29), ("d", 2, 0, "x", None), ("d", 3, 0, None, 1.0), ("e", 1, 0, "", 1.0)]
    got = pages.read_texts(spark.createDataFrame(blocks, "k string, page int, place int, text string, confidence double"), "k").collect()
    assert sorted(map(tuple, got)) == [("d", 1, "a\nb"), ("e", 1, "")]
