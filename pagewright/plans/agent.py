"""A tool-calling agent: the loop runs on the driver, every tool is a bounded Spark query."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import agent_results, catalog as C, vector_search as V
from ..schemas import AgentRequest, SearchRequest
from ..sources.providers import ChatClient

SYSTEM = "You answer questions about a collection of documents. Use the tools to find evidence, and name the documents and pages you rely on."
FORCED = "Answer now from what the tools have returned. Do not call any further tool."
CUT = "... [truncado]"

TOOLS = {
    "search_chunks": {"query": "string", "n_results": "integer", "document_id": "string"},
    "get_document": {"document_id": "string"},
    "list_documents": {"status": "string", "limit": "integer"},
    "search_document_text": {"document_id": "string", "keyword": "string", "query": "string"},
}
REQUIRED = {"search_chunks": ["query"], "get_document": ["document_id"], "list_documents": [], "search_document_text": ["document_id"]}


def tool_schemas(scoped: bool = False) -> list[dict]:
    """Declarations for the model; under a scope the document can't be chosen."""
    out = []
    for name, params in TOOLS.items():
        shown = {k: {"type": t} for k, t in params.items() if not (scoped and k == "document_id")}
        need = [k for k in REQUIRED[name] if k in shown]
        note = " Works on the selected document only." if scoped else ""
        out.append({"type": "function", "function": {"name": name, "description": name.replace("_", " ").capitalize() + "." + note, "parameters": {"type": "object", "properties": shown, "required": need}}})
    return out


@dataclass
class ToolRegistry:
    """Tools over vectors and catalogue. A forced document is a predicate on every tool."""

    vectors: DataFrame
    catalog: DataFrame
    client: V.EmbeddingClient
    forced: str | None = None

    def scoped_to(self, document_id: str | None) -> "ToolRegistry":
        return ToolRegistry(self.vectors, self.catalog, self.client, document_id)

    def search_chunks(self, query: str, n_results: int = 5, document_id: str | None = None) -> DataFrame:
        found = V.enrich_source(V.search(self.vectors, SearchRequest(query, n_results, document_id), self.client), self.catalog)
        return found.orderBy(F.desc("similarity"), "chunk_id").select(F.to_json(F.struct("chunk_id", "document_id", F.col("source_file").alias("filename"), F.col("page_number").alias("page"), F.round("similarity", 4).alias("similarity"), "text")).alias("line"))

    def get_document(self, document_id: str) -> DataFrame:
        return C.get(self.catalog, document_id).select(F.to_json(F.struct("document_id", "filename", "status", "total_pages", "created_at")).alias("line"))

    def list_documents(self, status: str | None = None, limit: int = 20) -> DataFrame:
        return C.list_page(self.catalog, status, limit).select(F.to_json(F.struct("document_id", "filename", "status", "total_pages")).alias("line"))

    def search_document_text(self, document_id: str, keyword: str | None = None, query: str | None = None) -> DataFrame:
        hits = C.search_text(self.catalog, document_id, keyword or query or "")
        return hits.select(F.to_json(F.struct("document_id", "page", F.col("block_id").alias("chunk_id"), "text")).alias("line"))

    def execute(self, name: str, arguments: dict, max_chars: int = 0) -> str:
        """Run a tool; every failure becomes a message. Values are cast by the declared types."""
        if self.forced is not None and name == "list_documents":
            name, arguments = "get_document", {}
        if name not in TOOLS:
            return f"Unknown tool: {name}"
        known = TOOLS[name]
        try:
            given = {k: int(v) if known[k] == "integer" and v is not None else v for k, v in arguments.items()}
            if self.forced is not None and "document_id" in known:
                given["document_id"] = self.forced
            text = "\n".join(r.line for r in getattr(self, name)(**given).collect()) or "No results."
        except Exception as e:  # noqa: BLE001
            return f"Tool {name} failed: {type(e).__name__}: {e}"[:500]
        return text if not max_chars or len(text) <= max_chars else text[:max_chars] + CUT


@dataclass
class AgentResult:
    answer: str
    sources: list[dict] = field(default_factory=list)
    iterations: int = 0


_BLOCK = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
_FUNCTION = re.compile(r"<function=([^>]+)>(.*?)</function>", re.S)
_PARAMETER = re.compile(r"<parameter=([^>]+)>(.*?)</parameter>", re.S)


def text_tool_calls(text: str) -> list[dict]:
    """The driver's copy of ``agent_results.parse_tool_calls`` for one message."""
    out = []
    for block in _BLOCK.findall(text or ""):
        first = _FUNCTION.search(block)
        if first and first.group(1).strip():
            out.append({"name": first.group(1).strip(), "arguments": {k.strip(): v.strip() for k, v in _PARAMETER.findall(first.group(2))}})
    return out


def strip_markup(text: str) -> str:
    return re.sub(r"\n{3,}", "\n", _BLOCK.sub("", text or "")).strip()


def message_chars(messages: list[dict]) -> int:
    return sum(len(m.get("content") or "") + sum(len(c["name"]) + len(c["arguments"] if isinstance(c["arguments"], str) else json.dumps(c["arguments"])) for c in m.get("tool_calls") or []) for m in messages)


class AgentRunner:
    def __init__(self, spark: SparkSession, chat: ChatClient, tools: ToolRegistry, config: EngineConfig = EngineConfig()):
        self.spark, self.chat, self.tools, self.config = spark, chat, tools, config

    def run(self, request: AgentRequest) -> AgentResult:
        """At most ``max_iterations`` model turns; the last one has no tools, and so has one
        that starts with less than the forcing share of the character budget left."""
        tools = self.tools.scoped_to(request.document_id) if request.document_id else self.tools
        messages = [{"role": "system", "content": SYSTEM}]
        if request.document_id:
            messages.append({"role": "system", "content": f"Only document {request.document_id} may be used."})
        messages.append({"role": "user", "content": request.query})
        results: list[str] = []
        most = request.max_iterations or self.config.agent_max_iterations
        budget = self.config.agent_char_budget
        for turn in range(1, most + 1):
            left = budget - message_chars(messages)
            if left < self.config.agent_force_share * budget:
                return self._forced(messages, results, turn)
            reply = self.chat.chat(messages, None if turn == most else tool_schemas(bool(request.document_id)))
            content = reply.get("content") or ""
            calls = [] if turn == most else list(reply.get("tool_calls") or []) or text_tool_calls(content)
            if not calls:
                answer = strip_markup(content)
                return AgentResult(answer, self._sources(results), turn) if answer else self._forced(messages, results, turn)
            messages.append({"role": "assistant", "content": content, "tool_calls": calls})
            share = max(left // len(calls), 1000)
            for call in calls:
                results.append(tools.execute(call["name"], self._arguments(call["arguments"]), share))
                messages.append({"role": "tool", "tool_call_id": call.get("id"), "content": results[-1]})
        return self._forced(messages, results, most)

    @staticmethod
    def _arguments(given: str | dict) -> dict:
        """Arguments that don't parse as an object count as none."""
        try:
            found = json.loads(given) if isinstance(given, str) else given
        except ValueError:
            return {}
        return found if isinstance(found, dict) else {}

    def _forced(self, messages: list[dict], results: list[str], turn: int) -> AgentResult:
        try:
            answer = strip_markup(self.chat.chat([*messages, {"role": "user", "content": FORCED}], None).get("content") or "")
        except Exception:  # noqa: BLE001 - sources are still worth returning
            answer = ""
        return AgentResult(answer, self._sources(results), turn)

    def _sources(self, results: list[str]) -> list[dict]:
        if not results:
            return []
        rows = self.spark.createDataFrame(list(enumerate(results)), "result_no int, content string")
        return [r.asDict() for r in agent_results.sources(rows).orderBy("result_no", "line_no").drop("result_no", "line_no").collect()]


Tool = Callable[..., DataFrame]
