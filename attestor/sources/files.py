"""Files in and out: uploads, parsed documents, packets on disk."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators import ingest
from attestor.shipping import ship_code

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_PARSED = "path string, file_type string, blocks array<struct<block_idx: int, text: string, block_type: string, page: int>>, tables array<array<array<string>>>, error string"


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(packet_id, filename, path, content) of files laid out as packet/name."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("packet_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "path", "content")


def parse_docx(content: bytes) -> tuple[list[dict], list[list[list[str]]]]:
    """Paragraph blocks in order, styles of headings and titles as headings,
    and tables as rows of cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    blocks, tables = [], []
    told = lambda node: "".join(t.text or "" for t in node.iter(f"{_WORD}t"))
    for node in body if body is not None else ():
        if node.tag == f"{_WORD}tbl":
            tables.append([["\n".join(map(told, cell.iter(f"{_WORD}p"))) for cell in row.iter(f"{_WORD}tc")] for row in node.iter(f"{_WORD}tr")])
        elif node.tag == f"{_WORD}p" and (text := told(node).strip()):
            style = node.find(f"{_WORD}pPr/{_WORD}pStyle")
            name = style.get(f"{_WORD}val", "") if style is not None else ""
            blocks.append({"text": text, "block_type": "heading" if re.match("Heading|Title", name) else "paragraph", "page": None})
    return blocks, tables


def parse_pdf(content: bytes) -> tuple[list[dict], list[list[list[str]]]]:
    """Blocks and tables of a PDF, if a PDF library is there."""
    try:
        import fitz
    except ImportError:
        raise ValueError("no PDF library is installed") from None
    blocks, tables = [], []
    with fitz.open(stream=content, filetype="pdf") as doc:
        for number, page in enumerate(doc, 1):
            found = page.find_tables().tables if len(doc) <= 50 else []
            tables.extend([[cell or "" for cell in row] for row in t.extract()] for t in found)
            for b in page.get_text("dict")["blocks"]:
                x, y = (b["bbox"][0] + b["bbox"][2]) / 2, (b["bbox"][1] + b["bbox"][3]) / 2
                spans = [s for line in b.get("lines", ()) for s in line["spans"]]
                text, size = "".join(s["text"] for s in spans).strip(), max((s["size"] for s in spans), default=0)
                if not text or any(t.bbox[0] <= x <= t.bbox[2] and t.bbox[1] <= y <= t.bbox[3] for t in found):
                    continue
                note = y > page.rect.height * ingest.FOOTNOTE_FROM and 0 < size <= ingest.FOOTNOTE_SIZE
                blocks.append({"text": text, "block_type": "heading" if size >= ingest.HEADING_SIZE else "footnote" if note else "paragraph", "page": number})
    return blocks, tables


_PARSERS = {"docx": parse_docx, "pdf": parse_pdf}


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, kind, content in zip(pdf["path"], pdf["file_type"], pdf["content"], strict=True):
            try:
                blocks, tables = _PARSERS[kind](bytes(content))
                rows.append((path, kind, [{"block_idx": i, **b, "text": b["text"].replace("\x00", "")} for i, b in enumerate(blocks)], tables, None))
            except Exception as e:  # one bad file is a row with an error, not a failed job
                rows.append((path, kind, [], [], f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["path", "file_type", "blocks", "tables", "error"])


def parse_files(files: DataFrame) -> DataFrame:
    """Checked files (path, file_type, content) parsed into blocks and tables;
    what cannot be read has an error."""
    ship_code(files.sparkSession)
    known = files.where(F.col("file_type").isin(*_PARSERS)).select("path", "file_type", "content")
    return known.mapInPandas(_parse, _PARSED)


def position_blocks(parsed: DataFrame) -> DataFrame:
    """Blocks (doc_id is the path) with offsets, sections and paragraphs."""
    rows = parsed.select(F.col("path").alias("doc_id"), F.explode("blocks").alias("b")).select("doc_id", "b.*")
    return ingest.add_paragraphs(ingest.add_sections(ingest.add_offsets(rows)))


def safe_name(filename: str) -> str:
    """A name that stays in its folder."""
    name = filename.replace("\\", "/").rsplit("/", 1)[-1]
    return "upload.bin" if name in ("", ".", "..") else name


def write_packets(df: DataFrame, path: str) -> None:
    """A table in one folder for each packet."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("packet_id").parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A database table, read in parts by ranges of a key where one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()
