"""Readers: text trees, delimited files, office files, JSON graphs, catalogs. All go through Spark's file sources."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.text import graph_key, strip

EXTENSIONS = [".md", ".txt", ".csv", ".tsv", ".xlsx", ".docx", ".pdf"]


def discover(spark: SparkSession, path: str, extensions: list[str] = EXTENSIONS, only: list[str] | None = None) -> DataFrame:
    """path, extension, length of files below a folder; contents are not read. Names that begin with `_` or `.` are not seen,
    as by all of Spark's file sources."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    files = files.withColumn("extension", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))).where(F.col("extension").isin(extensions))
    return files.where(F.regexp_extract("path", r"([^/]+)$", 1).isin(only)) if only else files


def batches(files: DataFrame, root: str) -> DataFrame:
    """batch, files: files by their first folder below root."""
    rest = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").rsplit("/", 1)[-1]) + "/", "")
    own = files.withColumn("batch", F.regexp_extract(rest, "^([^/]+)/", 1)).where("batch <> ''")
    return own.groupBy("batch").agg(F.sort_array(F.collect_list("path")).alias("files"))


def text_files(spark: SparkSession, path: str, pattern: str = "*.txt", skip_private: bool = True) -> DataFrame:
    """path, content of whole files that are not blank; names that begin with `_` are left out."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    t = t.select(F.input_file_name().alias("path"), F.col("value").alias("content")).where(F.regexp_like("content", F.lit(r"\S")))
    return t.where(~F.regexp_like("path", F.lit("/_[^/]*$"))) if skip_private else t


def delimited(spark: SparkSession, path: str, schema: StructType | str | None = None, tabs: bool = False) -> DataFrame:
    """CSV or TSV with a header; bad lines are dropped. Without a schema all columns are text: no pass to infer."""
    r = spark.read.option("header", "true").option("sep", "\t" if tabs else ",").option("mode", "DROPMALFORMED")
    return (r.schema(schema) if schema else r).csv(path)


def knowledge_graphs(spark: SparkSession, paths: list[str], schema: StructType | str) -> DataFrame:
    """Graph documents, one JSON object a file, of the first candidate path that exists."""
    for p in paths:
        h = spark._jvm.org.apache.hadoop.fs.Path(p)
        if h.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(h):
            return spark.read.schema(schema).option("multiLine", "true").json(p)
    raise FileNotFoundError(paths)


def chunk_index(metadata: DataFrame) -> DataFrame:
    """chunk_id, title, path, key of metadata rows (structure: array of chunk_id, title, path)."""
    from tessera.functions.text import title_key

    return metadata.select(F.explode("structure").alias("s")).select("s.*").withColumn("key", title_key("title"))


def located_chunks(index: DataFrame, files: DataFrame) -> DataFrame:
    """chunk_index() rows with file: of files (path) the one of the stated path, else the only one of its name, else the first
    that ends with its last two segments; rows without a file are left out."""
    from tessera.operators.search import resolve_chunks

    found = resolve_chunks(index.select(F.col("chunk_id").alias("ref_id"), "path").distinct(), files)
    return index.join(found.select(F.col("ref_id").alias("chunk_id"), "path", F.col("chunk").alias("file")), ["chunk_id", "path"]).where("file IS NOT NULL")


def chunk_text_index(chunks: DataFrame, limit: int = 1200) -> DataFrame:
    """chunks with the first characters of their text, headings left out."""
    return chunks.withColumn("content_snippet", F.substring(strip(F.regexp_replace("content", r"(?m)^#+\s.*$", "")), 1, limit))


def chunk_header(content: str = "content") -> list:
    """Columns of a written chunk: title, source, chunk_id, section_path and the body after the line `---`."""
    c = F.col(content)
    one = lambda p: F.regexp_extract(c, p, 1)
    return [one(r"(?m)\A# (.*)$").alias("title"), one(r"(?m)^Source: (.*)$").alias("source"), one(r"(?m)^Chunk ID: (.*)$").alias("chunk_id"), one(r"(?m)^Section Path: (.*)$").alias("section_path"), strip(F.regexp_extract(c, r"(?s)\n---\n(.*)", 1)).alias("body")]


def decoded(files: DataFrame) -> DataFrame:
    """binaryFile rows with text: UTF-8 where it is valid, else Latin-1; office and PDF files have null."""
    office = F.regexp_like(F.lower("path"), F.lit(r"\.(docx?|xlsx?|pptx?|pdf|zip|png|jpe?g)$"))
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    return files.withColumn("text", F.when(~office, F.coalesce(utf8, F.decode("content", "ISO-8859-1"))))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def docx_blocks(data: bytes) -> list[tuple[int, str]]:
    """(heading level or 0, text) of paragraphs; a table is one block of `| a | b |` lines."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out = []
    for e in body if body is not None else []:
        if e.tag == f"{_W}tbl":
            rows = ["| " + " | ".join(text(c) for c in r.iter(f"{_W}tc")) + " |" for r in e.iter(f"{_W}tr")]
            out.append((0, "\n".join(rows)))
        elif e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            level = re.match(r"[Hh]eading\s*(\d)", style.get(f"{_W}val", "")) if style is not None else None
            out.append((int(level[1]) if level else 0, text(e)))
    return [b for b in out if b[1].strip()]


def xlsx_rows(data: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, row from 1, cells) of a workbook, sheets in order of their files."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [("".join(t.text or "" for t in s.iter(f"{_S}t"))) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        out = []
        for title, name in zip(titles, sheets):
            for r in ElementTree.fromstring(z.read(name)).iter(f"{_S}row"):
                cells = []
                for c in r.iter(f"{_S}c"):
                    v = c.find(f"{_S}v")
                    inline = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    cells.append(inline if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text)
                out.append((title, int(r.get("r", len(out) + 1)), cells))
    return out


def pptx_slides(data: bytes, slides: int = 20, bullets: int = 8) -> list[tuple[int, str, list[str]]]:
    """(number, title, lines) of the first slides, in order of their numbers."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        own = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))[:slides]
        out = []
        for i, n in enumerate(own, 1):
            lines = ["".join(t.text or "" for t in p.iter(f"{_A}t")).strip() for p in ElementTree.fromstring(z.read(n)).iter(f"{_A}p")]
            lines = [x for x in lines if x]
            out.append((i, lines[0] if lines else "", lines[1 : 1 + bullets]))
    return out


def office_rows(files: DataFrame, parse: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    """path, ord and the rows that `parse` gives for each binaryFile row."""
    names = ["path", "ord", *[c.split()[0] for c in schema.split(", ")]]

    def run(frames):
        for f in frames:
            yield pd.DataFrame([(p, i, *r) for p, c in zip(f["path"], f["content"]) for i, r in enumerate(parse(bytes(c)))], columns=names)

    return files.select("path", "content").mapInPandas(run, f"path string, ord int, {schema}")


class Registry:
    """Chunkers by extension; the first that was registered for a file's extension gets it."""

    def __init__(self):
        self.chunkers: list[tuple[str, list[str], Callable[[DataFrame], DataFrame]]] = []

    def register(self, name: str, extensions: list[str], chunk: Callable[[DataFrame], DataFrame]) -> None:
        self.chunkers.append((name, extensions, chunk))

    def run(self, files: DataFrame) -> DataFrame:
        """The chunks of all files (path, extension, ...), each by its chunker."""
        out, taken = None, []
        for _, extensions, chunk in self.chunkers:
            own = [e for e in extensions if e not in taken]
            taken += own
            part = chunk(files.where(F.col("extension").isin(own)))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out


class Catalog:
    """Graph names: a key, its aliases and the location of its tables. Names resolve by key, alias, then as they are."""

    def __init__(self, graphs: dict[str, dict]):
        self.graphs = graphs

    def resolve(self, names: DataFrame, column: str = "name") -> DataFrame:
        pairs = [(k, k) for k in self.graphs] + [(a, k) for k, g in self.graphs.items() for a in g.get("aliases", [])]
        table = names.sparkSession.createDataFrame(pairs or [("", "")], "_a string, _graph string")  # as many rows as names in the manifest
        first = table.groupBy(graph_key("_a").alias("_a")).agg(F.first("_graph").alias("_graph"))
        out = names.join(F.broadcast(first), graph_key(column) == F.col("_a"), "left")
        return out.withColumn("graph", F.coalesce("_graph", column)).drop("_a", "_graph")


def graph_counts(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """graph, rules, entities of each graph."""
    r, c = rules.groupBy("graph").agg(F.count("*").alias("rules")), categories.groupBy("graph").agg(F.count("*").alias("entities"))
    return r.join(c, "graph", "full").fillna(0)
