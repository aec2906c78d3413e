"""Tables inside word-processor documents: Python opens the files, Spark expressions read their cells."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import or_
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strataforge.functions.text import document_period

# Words in headers, the columns they announce, and texts that are not codes.
NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
TABLE_WORDS = ("MÃ", "MA", "MỤC TIÊU", "MUC TIEU", "MỨC ĐẠT", "MUC DAT", "MỨC ĐĂNG KÝ")
COLUMN_WORDS = (
    ("code", ("MÃ",)),
    ("description", ("NỘI DUNG", "MỤC TIÊU", "CHỈ TIÊU")),
    ("frequency", ("ĐỊNH KỲ", "DINH KY", "THU THẬP")),
    ("planned", ("ĐĂNG KÝ", "DANG KY", "KẾ HOẠCH")),
    ("achieved", ("MỨC ĐẠT", "MUC DAT", "KẾT QUẢ ĐẠT")),
    ("result", ("KẾT QUẢ", "KET QUA", "ĐÁNH GIÁ")),
    ("cause", ("NGUYÊN NHÂN", "NGUYEN NHAN")),
    ("action", ("HÀNH ĐỘNG", "KHẮC PHỤC", "HANH DONG")),
)
CODE_HEADER = "MA"
NOT_CODES = ("N/A", "STT", "TT", "MÃ", "MA")
EMPTY = {"cause": "", "action": ""}
ABSENT = "N/A"

CELLS = pa.list_(pa.list_(pa.list_(pa.string())))
SLICE = 64  # documents whose cells one Python worker holds at a time
UNREADABLE = (zipfile.BadZipFile, zlib.error, KeyError, EOFError, RuntimeError, ElementTree.ParseError)


def _text(node) -> str:
    return "".join([t.text or "" for t in node.iter(f"{NS}t")]).strip()


def _content(file: bytes) -> tuple[str | None, str | None, list]:
    """What stopped the reading, the text of all paragraphs, and the cells of all tables."""
    try:
        with zipfile.ZipFile(io.BytesIO(file or b"")) as package:
            root = ElementTree.fromstring(package.read("word/document.xml"))
    except UNREADABLE as error:
        return type(error).__name__, None, []
    tables = [[[_text(cell) for cell in line.iter(f"{NS}tc")] for line in table.iter(f"{NS}tr")] for table in root.iter(f"{NS}tbl")]
    return None, "\n".join(_text(p) for p in root.iter(f"{NS}p")), tables


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``read_documents`` gives, a few documents at a time: memory does not grow with the batch."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            found = [_content(file.as_py()) for file in part.column(1)]
            errors, texts, tables = ([f[i] for f in found] for i in range(3))
            yield pa.record_batch(
                {"path": part.column(0), "error": pa.array(errors, pa.string()), "text": pa.array(texts, pa.string()), "tables": pa.array(tables, CELLS)}
            )


def read_documents(documents: DataFrame) -> DataFrame:
    """(path, error, text, tables): one row per document of (path, content); every task opens the files it reads.

    ``error`` names what made a document unreadable, else it is NULL.
    """
    return documents.select("path", "content").mapInArrow(opened, "path string, error string, text string, tables array<array<array<string>>>")


def _any_word(text: Column, words) -> Column:
    return reduce(or_, [text.contains(w) for w in words])


def _role(header: Column) -> Column:
    """The column a header announces; the first entry of the list that fits, else NULL."""
    role = F.when(header == CODE_HEADER, "code")
    for name, words in COLUMN_WORDS:
        role = role.when(_any_word(header, words), name)
    return role


def _rows(tables: Column) -> Column:
    """The rows of each table as structs; none unless its first line is a known header with a code column.

    Each step is a transform of its own, so that headers are read once per table, not once per cell.
    """
    headed = F.transform(
        tables,
        lambda t: F.struct(
            F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))).alias("lines"),
            F.transform(F.coalesce(F.get(t, F.lit(0)), F.array().cast("array<string>")), F.upper).alias("headers"),
        ),
    )
    with_roles = F.transform(headed, lambda t: F.struct(t["lines"].alias("lines"), t["headers"].alias("headers"), F.transform(t["headers"], _role).alias("roles")))

    def place(table: Column, name: str) -> Column:
        return F.nullif(F.array_position(table["roles"], F.lit(name)).cast("int"), F.lit(0)) - 1

    def placed(table: Column) -> Column:
        known = _any_word(F.array_join(table["headers"], " "), TABLE_WORDS) & F.array_contains(table["roles"], F.lit("code"))
        lines = F.when(known, table["lines"]).otherwise(F.slice(table["lines"], 1, 0))
        return F.struct(lines.alias("lines"), *[place(table, name).alias(name) for name, _ in COLUMN_WORDS])

    def row(cells: Column, places: Column) -> Column:
        values = []
        for name, _ in COLUMN_WORDS:
            cell = F.nullif(F.get(cells, places[name]), F.lit(""))
            values.append(F.coalesce(cell, F.lit("" if name == "code" else EMPTY.get(name, ABSENT))).alias(name))
        return F.struct(*values)

    def coded(found: Column) -> Column:
        code = found["code"]
        return (F.length(code) >= 2) & ~F.upper(code).isin(*NOT_CODES)

    return F.transform(F.transform(with_roles, placed), lambda t: F.filter(F.transform(t["lines"], lambda cells: row(cells, t)), coded))


def table_rows(read: DataFrame) -> DataFrame:
    """Coded rows of all recognised tables of documents from ``read_documents``, numbered per document."""
    rows = F.flatten(_rows(F.col("tables")))
    found = read.where("error IS NULL").select("path", document_period(F.col("text")).alias("period"), F.posexplode(rows))
    names = [name for name, _ in COLUMN_WORDS]
    return found.select("path", (F.col("pos") + 1).alias("row_no"), "period", *[F.col(f"col.{n}").alias(n) for n in names])


def failed_documents(read: DataFrame) -> DataFrame:
    """(path, error) of the documents that could not be read."""
    return read.where("error IS NOT NULL").select("path", "error")


def extract_tables(documents: DataFrame) -> DataFrame:
    """Rows of the tables in (path, content) documents; ``failed_documents`` tells which were unreadable."""
    return table_rows(read_documents(documents))
