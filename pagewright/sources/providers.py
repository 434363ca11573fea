"""Plug points for what Spark can't do itself: reading PDFs, recognition, embedding, chat.

A provider is a picklable object. It is made once a Python worker, because every use is
an iterator-style map, and gives plain rows; all relational logic comes after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

WORDS = "doc_id string, page int, pos long, text string, x0 double, x1 double, top double, bottom double, error string"
IMAGES = "doc_id string, page int, x0 double, x1 double, top double, bottom double, error string"
PAGES = "doc_id string, page int, width double, height double, text string, error string"
OCR_WORDS = "doc_id string, page int, block_no int, line_no int, word_no int, value string, confidence double, line_bbox struct<x1:double,y1:double,x2:double,y2:double>, error string"
WORD_TABLE = "doc_id string, page int, word_pos long, block_num int, text string, conf double, left double, top double, width double, height double, error string"
TABLES = "doc_id string, page int, table_no int, accuracy double, rows array<array<string>>, bbox struct<x1:double,y1:double,x2:double,y2:double>, width double, height double, error string"


class PdfReader(Protocol):
    """Each method yields dictionaries with the columns of the DDL above, for one file."""

    def pages(self, doc_id: str, content: bytes) -> Iterator[dict]: ...

    def words(self, doc_id: str, content: bytes) -> Iterator[dict]: ...

    def images(self, doc_id: str, content: bytes) -> Iterator[dict]: ...

    def tables(self, doc_id: str, content: bytes) -> Iterator[dict]: ...


class OcrEngine(Protocol):
    """Yields word rows of one page, as ``OCR_WORDS`` has them."""

    def recognise(self, doc_id: str, page: int, content: bytes) -> Iterator[dict]: ...


class BatchOcrEngine(Protocol):
    """The same rows for a batch of pages (doc_id, page, content) at a time."""

    batch_pages: int

    def recognise_batch(self, pages: list[tuple[str, int, bytes]]) -> Iterator[dict]: ...


class WordTableEngine(Protocol):
    """Yields the word table of one page, as ``WORD_TABLE`` has it, with pixel boxes."""

    def word_table(self, doc_id: str, page: int, content: bytes) -> Iterator[dict]: ...


class ChatClient(Protocol):
    def chat(self, messages: list[dict], tools: list[dict] | None = None) -> dict: ...


def _rows(ddl: str, rows_of, columns: tuple[str, ...], source: DataFrame) -> DataFrame:
    """Map rows of ``columns`` to any number of dictionaries; keys that lack become nulls."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(len(columns)))):
                found = list(rows_of(*row))
                if found:
                    yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in schema.names} for r in found], schema=schema)

    return source.select(*columns).mapInArrow(run, ddl)


def _failure(doc: str, page: int, e: Exception) -> dict:
    return {"doc_id": doc, "page": page, "error": f"{type(e).__name__}: {e}"}


def extract(files: DataFrame, reader: PdfReader, what: str, ddl: str) -> DataFrame:
    """Rows of one kind from (doc_id, content); a file that fails gives one row with its error, on page 1."""

    def rows_of(doc: str, content: bytes) -> list[dict]:
        try:
            return list(getattr(reader, what)(doc, content))
        except Exception as e:  # noqa: BLE001 - a broken file must not stop the others
            return [_failure(doc, 1, e)]

    return _rows(ddl, rows_of, ("doc_id", "content"), files)


def recognise(pages: DataFrame, engine: OcrEngine | BatchOcrEngine | WordTableEngine, ddl: str | None = None) -> DataFrame:
    """Recognition rows of (doc_id, page, content); a page that fails gives one row with its error.

    An engine with ``recognise_batch`` gets ``batch_pages`` pages a call. If a batch fails,
    its pages are tried one by one, so that one bad page costs only itself.
    """
    if hasattr(engine, "recognise_batch"):
        return _recognise_batches(pages, engine, ddl or OCR_WORDS)
    call = getattr(engine, "word_table", None) or engine.recognise

    def rows_of(doc: str, page: int, content: bytes) -> list[dict]:
        try:
            return list(call(doc, page, content))
        except Exception as e:  # noqa: BLE001
            return [_failure(doc, page, e)]

    return _rows(ddl or (WORD_TABLE if hasattr(engine, "word_table") else OCR_WORDS), rows_of, ("doc_id", "page", "content"), pages)


def _recognise_batches(pages: DataFrame, engine: BatchOcrEngine, ddl: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def one_by_one(rows: list[tuple]) -> list[dict]:
        out = []
        for row in rows:
            try:
                out += list(engine.recognise_batch([row]))
            except Exception as e:  # noqa: BLE001
                out.append(_failure(row[0], row[1], e))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, engine.batch_pages):
                part = batch.slice(at, engine.batch_pages)
                rows = list(zip(*(part.column(k).to_pylist() for k in range(3))))
                try:
                    found = list(engine.recognise_batch(rows))
                except Exception:  # noqa: BLE001
                    found = one_by_one(rows)
                if found:
                    yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in schema.names} for r in found], schema=schema)

    return pages.select("doc_id", "page", "content").mapInArrow(run, ddl)
