"""Sources: raw files, markdown with metadata, chunk files, test sets, acronym dictionaries."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.fixed_values import RAW_EXTENSIONS
from docloom.functions.text import nfc, strip
from docloom.functions.urls import category

CHUNK = "id string, chunk_id string, doc_id string, text string, metadata map<string,string>, start_char_idx int, end_char_idx int"
ITEM = "id string, question string, ground_truth string, metadata map<string,string>"


def _stem(path: str = "path"):
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def _category(path: str = "path"):
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def raw_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, category, stem, ext, content, size) of files one folder down, the folder's name being the category."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", _category().alias("category"), _stem().alias("stem"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("ext"), "content", F.col("length").alias("size"))


def find_raw(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (category, document_id) its file: that name and the first known extension, else the first name that starts so."""
    order = F.array_position(F.array(*map(F.lit, RAW_EXTENSIONS)), F.col("ext"))
    exact = (F.col("stem") == F.col("document_id")) & (order > 0)
    # Every prefix of a name is joined by value; file names are short, and contents aren't carried along.
    starts = files.where("stem <> ''").select("path", "category", "stem", "ext", F.explode(F.sequence(F.lit(1), F.length("stem"))).alias("__l"))
    near = starts.withColumn("document_id", F.substring("stem", F.lit(1), F.col("__l"))).join(wanted.select("category", "document_id").distinct(), ["category", "document_id"])
    ranked = near.withColumn("__o", F.when(exact, order).otherwise(1000)).withColumn("__n", F.row_number().over(Window.partitionBy("category", "document_id").orderBy("__o", "path")))
    return ranked.where("__n = 1").select("path", "document_id").join(files, "path")


def valid_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("size") > 0)


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX joined by line ends."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in (body if body is not None else []) if p.tag == f"{w}p")


def xlsx_text(data: bytes) -> str:
    """Sheets with a title line each and rows of non-empty cells."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        for k, sheet in enumerate(book.iter(f"{ns}sheet"), 1):
            out.append(f"--- Sheet: {sheet.get('name')} ---")
            root = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml"))
            for row in root.iter(f"{ns}row"):
                cells = []
                for c in row.iter(f"{ns}c"):
                    v, inline = c.find(f"{ns}v"), c.find(f"{ns}is")
                    if inline is not None:
                        cells.append("".join(t.text or "" for t in inline.iter(f"{ns}t")))
                    elif v is not None and v.text is not None:
                        cells.append(shared[int(v.text)] if c.get("t") == "s" else v.text)
                if cells:
                    out.append(" | ".join(cells))
    return "\n".join(out)


def html_text(data: bytes) -> str:
    text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", data.decode("utf-8", "replace"))
    return re.sub(r"[ \t]+", " ", re.sub(r"<[^>]+>", " ", text)).strip()


#: Parsers by extension. PDF pages need a library of the user's choice: register one that takes bytes and returns text.
PARSERS: dict[str, Callable[[bytes], str]] = {".docx": docx_text, ".xlsx": xlsx_text, ".html": html_text, ".txt": lambda b: b.decode("utf-8", "replace"), ".md": lambda b: b.decode("utf-8", "replace")}


def _parse(parsers: dict[str, Callable[[bytes], str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for ext, data in zip(b.column(1).to_pylist(), b.column(2)):
                parser, text, error = parsers.get(ext), "", None
                if parser is None:
                    error = f"no parser for {ext}"
                else:
                    try:
                        text = parser(data.as_py())
                    except Exception as e:  # a broken file is a row with an error, not a failed job
                        error = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "text", "error"])

    return run


def parse_files(files: DataFrame, parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, text, error) by each file's extension; files without a parser or with broken content get an error."""
    return files.select("path", "ext", "content").mapInArrow(_parse({**PARSERS, **(parsers or {})}), "path string, text string, error string")


def with_ocr(pages: DataFrame, ocr, least: int = 100) -> DataFrame:
    """Texts of fewer than ``least`` stripped characters replaced by those of ``ocr`` (a column)."""
    return pages.withColumn("text", F.when(F.length(strip(F.col("text"))) < least, ocr).otherwise(F.col("text")))


def markdown_documents(spark: SparkSession, folder: str, metadata_schema: str) -> DataFrame:
    """Markdown files with the metadata of JSON files of the same name: document_id, category, text and the metadata's columns.

    Texts are NFC; blank ones are left out. The id is that of the metadata, else the file's name.
    """
    return markdown_rows(whole_files(spark, folder, "*.md"), whole_files(spark, folder, "*.json"), metadata_schema)


def whole_files(spark: SparkSession, folder: str, names: str = "*") -> DataFrame:
    """(path, value): each text file of a folder, or of a glob, as one row."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter=names, recursiveFileLookup=True).select(F.input_file_name().alias("path"), "value")


def markdown_rows(texts: DataFrame, meta: DataFrame, metadata_schema: str) -> DataFrame:
    """:func:`markdown_documents` from tables of whole files (path, value); broken metadata is as good as none."""
    found = texts.select(_category().alias("category"), _stem().alias("stem"), nfc("value").alias("text")).where(strip(F.col("text")) != "")
    parsed = meta.select(_category().alias("category"), _stem().alias("stem"), F.from_json("value", metadata_schema).alias("m"))
    parsed = parsed.select("category", "stem", "m.*")
    joined = found.join(parsed, ["category", "stem"], "left")
    named = F.coalesce("document_id", "stem") if "document_id" in parsed.columns else F.col("stem")
    return joined.withColumn("document_id", named).drop("stem")


def chunk_files(spark: SparkSession, glob: str) -> DataFrame:
    return chunk_rows(whole_files(spark, glob))


def chunk_rows(rows: DataFrame) -> DataFrame:
    """Chunks of chunk files (value: a JSON array); unreadable files give no rows. The id is ``id`` or ``chunk_id``; ``doc_id`` goes before the metadata's document id."""
    chunks = rows.select(F.explode(F.from_json("value", f"array<struct<{CHUNK}>>")).alias("c")).where("c is not null").select("c.*")
    return chunks.select(F.coalesce("id", "chunk_id").alias("chunk_id"), F.coalesce("doc_id", F.col("metadata")["document_id"]).alias("document_id"), "text", "metadata", "start_char_idx", "end_char_idx")


def test_sets(spark: SparkSession, glob: str) -> DataFrame:
    return item_rows(whole_files(spark, glob))


def item_rows(rows: DataFrame) -> DataFrame:
    """Items of test set files (path, value: a JSON array) with their file's name; bad files give no rows."""
    named = rows.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.explode(F.from_json("value", f"array<struct<{ITEM}>>")).alias("i"))
    return named.where("i is not null").select("i.*", "file")


def acronyms(path: str) -> dict[str, str]:
    """An acronym dictionary of ``KEY: "meaning"`` lines, small enough to be a literal in a plan."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            if m := re.match(r"""\s*([^#:\s][^:]*?)\s*:\s*(?:"([^"]*)"|'([^']*)'|([^#]*?))\s*(?:#.*)?$""", line):
                out[m[1]] = next((x for x in m.groups()[1:] if x is not None), "")
    return out


def categories(docs: DataFrame) -> DataFrame:
    return docs.select("category").distinct()


def by_category(folders: DataFrame, categories: list[str], name: str = "name") -> DataFrame:
    """(category, name): the folders of each of ``categories``, by the rules for names; a category without any has one row without a name."""
    every = folders.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    return every.join(folders.select(F.col(name).alias("name"), category(F.col(name)).alias("category")), "category", "left").select("category", "name")


def excel_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a workbook's first sheets by the XLSX reader above, cells in order; the first row names the columns and is left out."""
    files = spark.read.format("binaryFile").load(path).select("path", F.lit(".xlsx").alias("ext"), "content")
    lines = parse_files(files).select(F.posexplode(F.split("text", "\n")).alias("rn", "line")).where(~F.startswith("line", F.lit("--- Sheet: ")) & (F.col("rn") > 1))
    cells = F.split("line", r" \| ")
    return lines.select("rn", *[F.get(cells, F.lit(k)).alias(c) for k, c in enumerate(columns)])


def fetched(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Pages with whether the portal session was logged in, and whether it had expired."""
    low = F.lower(F.coalesce(F.col(html), F.lit("")))
    return pages.withColumn("logged_in", F.contains(low, F.lit("đăng xuất")) | F.contains(low, F.lit("logout"))).withColumn(
        "expired", F.contains(low, F.lit("edit-name")) | F.contains(F.coalesce(F.col(url), F.lit("")), F.lit("user/login"))
    )


def crawl(seeds: DataFrame, links: DataFrame, score, depth: int = 3, most: int | None = None) -> DataFrame:
    """Pages reached from seeds (url) over a table of links (url, href): url, depth, priority, best first.

    Each step joins the frontier with the links and drops what was reached before; ``score`` gives a URL's priority.
    """
    from docloom.plans.stored import stored

    reached = stored(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "reached")
    frontier = reached
    for step in range(1, depth + 1):
        found = frontier.select("url").join(links, "url").select(F.col("href").alias("url")).distinct()
        frontier = stored(found.join(reached, "url", "left_anti").withColumn("depth", F.lit(step)), "frontier")
        reached = stored(reached.unionByName(frontier), "reached")
    ranked = reached.withColumn("priority", score(F.col("url")))
    out = ranked.orderBy(F.desc("priority"), "url")
    return out.limit(most) if most else out
