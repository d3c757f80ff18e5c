"""From files and texts to blocks with positions.

blocks: doc_id, block_idx, text, block_type (paragraph, heading, table,
footnote), page, paragraph, char_start, char_end, section_header. Offsets
count code points, the end is exclusive, and a document's raw text is its
blocks joined by one newline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADING_SIZE, FOOTNOTE_SIZE, FOOTNOTE_FROM = 13.0, 9.0, 0.85
PDF_MAGIC, ZIP_MAGIC = b"%PDF", b"PK\x03\x04"


def block_type(max_size: Column, centre_y: Column, page_height: Column) -> Column:
    """Type of a laid-out block by its largest font and place on the page."""
    low = (centre_y > page_height * FOOTNOTE_FROM) & (max_size > 0) & (max_size <= FOOTNOTE_SIZE)
    return F.when(max_size >= HEADING_SIZE, "heading").when(low, "footnote").otherwise("paragraph")


def in_table(centre_x: Column, centre_y: Column, tables: Column) -> Column:
    """Whether a block's centre lies in one of the table boxes (x0, y0, x1, y1)."""
    return F.exists(tables, lambda t: (centre_x >= t[0]) & (centre_x <= t[2]) & (centre_y >= t[1]) & (centre_y <= t[3]))


def sniff_type(content: Column) -> Column:
    """pdf, docx or null by the first bytes of a file and a document marker,
    which is looked for in the bytes as they are."""
    binary = lambda b: F.unhex(F.lit(b.hex()))
    marks = F.position(binary(b"[Content_Types].xml"), content) + F.position(binary(b"word/document"), content) > 0
    return F.when(F.startswith(content, binary(PDF_MAGIC)), "pdf").when(F.startswith(content, binary(ZIP_MAGIC)) & marks, "docx")


def check_files(files: DataFrame, max_mb: int = 50) -> DataFrame:
    """files (packet_id, filename, content) with file_type, error and, for
    the packet as a whole, accepted: one bad file rejects its packet."""
    kind = sniff_type(F.col("content"))
    size = F.octet_length("content")
    error = (
        F.when(F.col("content").isNull() | (size == 0), "No file attached. Please select a PDF or DOCX file.")
        .when(size > max_mb * 1024 * 1024, F.concat(F.lit("File exceeds "), F.lit(str(max_mb)), F.lit(" MB")))
        .when(kind.isNull(), "File type is not supported. Only PDF and DOCX files are accepted.")
    )
    rows = files.withColumns({"file_type": kind, "error": error})
    verdict = rows.groupBy("packet_id").agg(F.bool_and(F.col("error").isNull()).alias("accepted"))
    return rows.join(verdict, "packet_id")


def paper_metadata(title: Column, author: Column, date: Column, first_page: Column) -> Column:
    """struct<title, authors, year>, null if nothing is known. Authors are cut
    at semicolons and at commas between a lower and an upper case letter."""
    clean = F.trim(F.coalesce(title, F.lit("")))
    names = F.filter(F.transform(F.split(F.trim(F.coalesce(author, F.lit(""))), r"[;]|(?<=[a-z]),\s*(?=[A-Z])"), lambda a: F.trim(a)), lambda a: a != "")
    dated = F.regexp_extract(F.coalesce(date, F.lit("")), r"((?:19|20)\d{2})", 1)
    seen = F.regexp_extract(F.substring(F.coalesce(first_page, F.lit("")), 1, 2000), r"\b((?:19|20)\d{2})\b", 1)
    year = F.nullif(F.when(dated != "", dated).otherwise(seen), F.lit(""))
    known_title, known_authors = F.when(F.length(clean) > 5, clean), F.when(F.size(names) > 0, names)
    whole = F.struct(known_title.alias("title"), known_authors.alias("authors"), year.alias("year"))
    return F.when(known_title.isNotNull() | known_authors.isNotNull() | year.isNotNull(), whole)


def split_blocks(docs: DataFrame, heading_words: int = 3) -> DataFrame:
    """Blocks (doc_id, block_idx, text, block_type) of plain texts: one a
    line; a line of few words without an end mark is a heading."""
    line = F.posexplode(F.split("text", "\n")).alias("block_idx", "text")
    short = (F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) <= heading_words) & ~F.col("text").rlike(r"[.!?]\s*$")
    return docs.select("doc_id", line).withColumn("block_type", F.when(short & (F.trim("text") != ""), "heading").otherwise("paragraph"))


def _in_doc():
    return Window.partitionBy("doc_id").orderBy("block_idx")


def add_offsets(blocks: DataFrame) -> DataFrame:
    """char_start and char_end: each block starts one after the end of the one
    before it."""
    before = F.sum(F.length("text") + 1).over(_in_doc().rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)).cast("long")
    return blocks.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length("text"))


def add_sections(blocks: DataFrame) -> DataFrame:
    """section_header: the last heading so far, null on headings themselves."""
    heading = F.col("block_type") == "heading"
    last = F.last(F.when(heading, F.col("text")), ignorenulls=True).over(_in_doc().rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("section_header", F.when(~heading, last))


def add_paragraphs(blocks: DataFrame) -> DataFrame:
    """paragraph: counted from 0 on each page."""
    return blocks.withColumn("paragraph", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("block_idx")) - 1)


def raw_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, raw_text) of blocks, by their order."""
    ordered = F.array_sort(F.collect_list(F.struct("block_idx", "text")))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "\n").alias("raw_text"))


def serialise(blocks: DataFrame) -> DataFrame:
    """(doc_id, parsed_content): a document's blocks as JSON without NUL."""
    position = F.struct("page", "paragraph", "char_start", "char_end", "section_header")
    one = F.struct("block_idx", F.replace("text", F.lit("\x00"), F.lit("")).alias("text"), "block_type", position.alias("position"))
    return blocks.groupBy("doc_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("blocks"))).alias("parsed_content"))
