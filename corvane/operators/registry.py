"""Named query functions: register, look up, list, run."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any


TIMEOUT = 30.0


@dataclass(frozen=True)
class Tool:
    name: str
    run: Callable[..., Any]
    description: str = ""
    parameters: dict = field(default_factory=dict)


class ToolRegistry:
    """The last registration of a name wins; a missing tool is a failed result, not an error."""

    def __init__(self) -> None:
        self._tools: dict[str, Tool] = {}

    def register(self, tool: Tool) -> ToolRegistry:
        self._tools[tool.name] = tool
        return self

    def unregister(self, name: str) -> ToolRegistry:
        self._tools.pop(name, None)
        return self

    def get(self, name: str) -> Tool | None:
        return self._tools.get(name)

    def names(self) -> list[str]:
        return [*self._tools]

    def specs(self) -> list[dict]:
        return [{"name": t.name, "description": t.description, "parameters": t.parameters} for t in self._tools.values()]

    def execute(self, name: str, **arguments: Any) -> dict:
        tool = self.get(name)
        if tool is None:
            return {"success": False, "output": None, "error": f"no tool named {name}"}
        try:
            return {"success": True, "output": tool.run(**arguments), "error": None}
        except Exception as e:
            return {"success": False, "output": None, "error": str(e)}

    def execute_many(self, calls: list[tuple[str, dict]], timeout: float | None = TIMEOUT, parallel: bool = True) -> list[dict]:
        """Results in the order of the calls, at the same time or one by one. A call that takes over `timeout`
        seconds is a failed result; its thread is left to end."""
        pool = ThreadPoolExecutor(max_workers=max(1, len(calls)) if parallel else 1)
        started = [pool.submit(self.execute, name, **arguments) for name, arguments in calls] if parallel else []
        out, began = [], time.monotonic()
        for k, (name, arguments) in enumerate(calls):
            if not parallel:
                began = time.monotonic()
                started.append(pool.submit(self.execute, name, **arguments))
            try:
                left = None if timeout is None else max(0.0, began + timeout - time.monotonic())
                out.append(started[k].result(left))
            except TimeoutError:
                out.append({"success": False, "output": None, "error": f"timed out after {timeout:g} s"})
                if not parallel:
                    pool = ThreadPoolExecutor(max_workers=1)
        pool.shutdown(wait=False)
        return out


class Approvals:
    """Approved and denied names exclude each other; an unknown name is approved."""

    def __init__(self) -> None:
        self._denied: set[str] = set()

    def approve(self, name: str) -> None:
        self._denied.discard(name)

    def deny(self, name: str) -> None:
        self._denied.add(name)

    def is_approved(self, name: str) -> bool:
        return name not in self._denied


def assembled_prompt(sections: list[Callable[[], str]]) -> str:
    """Sections in order, parted by blank lines; one that fails or is blank is left out."""
    out = []
    for section in sections:
        try:
            text = section().strip()
        except Exception:
            continue
        if text:
            out.append(text)
    return "\n\n".join(out)


def formatted_hits(hits: list[dict]) -> str:
    """Search hits as a model reads them."""
    return "\n\n".join(f"[{i}] {h.get('filename') or 'Unknown'} (Page {h.get('page_num', '?')}):\n{h['text']}" for i, h in enumerate(hits, 1))


def formatted_findings(findings: list[dict], most: int = 500) -> str:
    return "\n\n".join(f"[{i}] {f['source']}:\n{f['content'][:most]}{'...' if len(f['content']) > most else ''}" for i, f in enumerate(findings, 1))


def document_search(search: Callable[[str, int, str | None], list[dict]]) -> Tool:
    """The tool that searches the documents: search(query, top_k, doc_id) -> hits with text, filename, page_num."""

    def run(query: str = "", top_k: int = 5, doc_id: str | None = None) -> str:
        if not query:
            raise ValueError("a query is required")
        hits = search(query, top_k, doc_id)
        return formatted_hits(hits) if hits else "No document matches this query."

    parameters = {
        "type": "object",
        "properties": {"query": {"type": "string"}, "top_k": {"type": "integer", "default": 5}, "doc_id": {"type": "string"}},
        "required": ["query"],
    }
    return Tool("document_search", run, "Passages of the documents that answer a query, with their sources.", parameters)


def researched(registry: ToolRegistry, query: str, top_k: int = 5, confidence: float = 0.9) -> list[dict]:
    """A first look into the documents, before any other step; nothing if there is no such tool or it fails."""
    if registry.get("document_search") is None:
        return []
    found = registry.execute("document_search", query=query, top_k=top_k)
    return [{"source": "document_search", "content": found["output"], "confidence": confidence}] if found["success"] else []
