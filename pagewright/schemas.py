"""Schemas of documents, chunks, catalogue and jobs, as Spark DDL, and request checks."""

from __future__ import annotations

from dataclasses import dataclass

BLOCK_TYPES = ("paragraph", "table", "header", "footer", "list", "image")
JOB_STATES = ("queued", "processing", "uploaded", "failed")
DOCUMENT_STATES = ("pending", "processing", "processed", "failed")

BLOCK = "struct<block_id:string,type:string,text:string,bbox:array<double>,confidence:double,rows:array<array<string>>,lines:array<struct<text:string,bbox:array<double>>>>"
PAGE = f"struct<page:int,source:string,blocks:array<{BLOCK}>,width:double,height:double,unit:string>"
DOCUMENT = f"doc_id string, source_file string, total_pages int, processing_date timestamp_ntz, pages array<{PAGE}>"
CHUNK = "chunk_id string, document_id string, source_file string, page_number int, block_id string, block_type string, text string, confidence double"
CATALOG = f"document_id string, file_hash string, filename string, file_size long, pdf_path string, status string, created_at timestamp_ntz, processed_at timestamp_ntz, error_message string, total_pages int, pages array<{PAGE}>"
JOB = "job_id string, filename string, status string, created_at timestamp_ntz, started_at timestamp_ntz, completed_at timestamp_ntz, error_message string, file_hash string, document_id string"
JOB_EVENT = "job_id string, seq long, ts timestamp_ntz, status string, error_message string, file_hash string"


@dataclass(frozen=True)
class SearchRequest:
    query: str
    n_results: int = 10
    document_id: str | None = None
    min_similarity: float | None = None

    def __post_init__(self) -> None:
        if not self.query:
            raise ValueError("query must not be empty")
        if not 1 <= self.n_results <= 100:
            raise ValueError("n_results must lie within 1..100")
        if self.min_similarity is not None and not 0 <= self.min_similarity <= 1:
            raise ValueError("min_similarity must lie within 0..1")


@dataclass(frozen=True)
class AgentRequest:
    query: str
    document_id: str | None = None
    max_iterations: int | None = None

    def __post_init__(self) -> None:
        if not self.query:
            raise ValueError("query must not be empty")
        if self.max_iterations is not None and not 1 <= self.max_iterations <= 20:
            raise ValueError("max_iterations must lie within 1..20")
