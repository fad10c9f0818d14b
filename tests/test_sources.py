import io
import zipfile

from pyspark.sql import functions as F

from tessera.sources import readers, writers


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def docx(*body):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(body)}</w:body></w:document>")
    return b.getvalue()


def test_text_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("# T\n\nSource: s.pdf\nChunk ID: s_001\nSection Path: A > B\n---\n\nbody text\n")
    (tmp_path / "a" / "_skip.txt").write_text("x")
    (tmp_path / "blank.txt").write_text(" \n")
    (tmp_path / "t.csv").write_text("a,b\n1,2\n3,4\n")
    t = readers.text_files(spark, str(tmp_path))
    assert t.count() == 1
    assert tuple(t.select(*readers.chunk_header()).first()) == ("T", "s.pdf", "s_001", "A > B", "body text")
    assert rows(readers.delimited(spark, str(tmp_path / "t.csv")), "a", "b") == [("1", "2"), ("3", "4")]
    f = readers.discover(spark, str(tmp_path))
    assert f.count() == 3 and readers.discover(spark, str(tmp_path), only=["t.csv"]).count() == 1
    assert [b for b, _ in rows(readers.batches(f, str(tmp_path)), "batch", "files")] == ["a"]


def test_office(spark, tmp_path):
    p = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>'
    t = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    (tmp_path / "d.docx").write_bytes(docx(p, "<w:p><w:r><w:t>Text</w:t></w:r></w:p>", t))
    files = spark.read.format("binaryFile").load(str(tmp_path / "d.docx"))
    assert rows(readers.office_rows(files, readers.docx_blocks, "level int, text string"), "ord", "level", "text") == [(0, 1, "Title"), (1, 0, "Text"), (2, 0, "| a | b |")]
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s}><sheets><sheet name="One"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>hi</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row r="1"><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>')
    assert readers.xlsx_rows(b.getvalue()) == [("One", 1, ["hi", "5"])]


def test_decoding(spark):
    df = spark.createDataFrame([("a.txt", "é".encode()), ("b.txt", "é".encode("latin-1")), ("c.docx", b"x")], "path string, content binary")
    assert [r["text"] for r in readers.decoded(df).orderBy("path").collect()] == ["é", "é", None]


def test_catalog_and_registry(spark):
    c = readers.Catalog({"lending_g": {"aliases": ["Lending Guide"]}})
    n = spark.createDataFrame([("lending-g",), ("LENDING GUIDE",), ("other",)], "name string")
    assert rows(c.resolve(n), "graph") == [("lending_g",), ("lending_g",), ("other",)]
    r = readers.Registry()
    r.register("one", [".md"], lambda f: f.withColumn("by", F.lit("one")))
    r.register("two", [".md", ".txt"], lambda f: f.withColumn("by", F.lit("two")))
    files = spark.createDataFrame([("a", ".md"), ("b", ".txt"), ("c", ".pdf")], "path string, extension string")
    assert rows(r.run(files), "path", "by") == [("a", "one"), ("b", "two")]


def test_writers(spark, tmp_path):
    c = spark.createDataFrame([("T one", "s", "c1", ["A b", "x"], "body"), ("T-one", "s", "c2", ["A b", "y"], "more")], "title string, source string, chunk_id string, path array<string>, content string")
    assert [f for f, in rows(writers.chunk_files(c), "file")] == ["a_b/t_one_c1.txt", "a_b/t_one_c2.txt"]
    g = spark.createDataFrame([("g1", 1), ("g2", 2)], "graph_name string, v int")
    writers.replace_graph(g, str(tmp_path / "g"))
    writers.replace_graph(spark.createDataFrame([("g1", 9)], "graph_name string, v int"), str(tmp_path / "g"))
    assert rows(spark.read.parquet(str(tmp_path / "g")), "graph_name", "v") == [("g1", 9), ("g2", 2)]


def test_located_chunks(spark):
    index = readers.chunk_index(spark.createDataFrame([([("c1", "One", "a/one.txt"), ("c2", "Two", "x/two.txt"), ("c3", "Gone", "y/gone.txt")],)], "structure array<struct<chunk_id:string,title:string,path:string>>"))
    files = spark.createDataFrame([("a/one.txt",), ("deep/down/two.txt",), ("other/one.txt",)], "path string")
    assert sorted((r["chunk_id"], r["file"]) for r in readers.located_chunks(index, files).collect()) == [("c1", "a/one.txt"), ("c2", "deep/down/two.txt")]
