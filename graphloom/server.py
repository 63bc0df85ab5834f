"""The tools over JSON-RPC on standard input and output, one message a line."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import IO

from . import __version__
from .plans.graph import CodeGraph
from .plans.scratch import temporary_tables
from .tools import TOOLS, call_tool

PROTOCOL = "2024-11-05"


class Server:
    """``graph`` is asked for a new graph when ``state`` has changed; until then edges are resolved once. What a call writes goes with it."""

    def __init__(self, graph: Callable[[], CodeGraph], state: Callable[[], object] = lambda: None):
        self.graph, self.state = graph, state
        self._current: tuple[object, CodeGraph] | None = None

    def current(self) -> CodeGraph:
        state = self.state()
        if self._current is None or self._current[0] != state:
            self.close()
            self._current = state, self.graph()
        return self._current[1]

    def close(self) -> None:
        if self._current:
            self._current[1].close()
        self._current = None

    def _call(self, name: str, arguments: dict | None) -> str:
        g = self.current()
        with temporary_tables(g.files.sparkSession):
            return call_tool(g, name, arguments)

    def handle(self, message: dict) -> dict | None:
        """The response to a request; None for a notification."""
        method, params, id_ = message.get("method"), message.get("params") or {}, message.get("id")
        if id_ is None:
            return None
        if method == "initialize":
            return self._ok(id_, {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "graphloom", "version": __version__}})
        if method == "ping":
            return self._ok(id_, {})
        if method == "tools/list":
            return self._ok(id_, {"tools": [{"name": t.name, "description": t.about, "inputSchema": t.json_schema()} for t in TOOLS.values()]})
        if method == "tools/call":
            try:
                return self._ok(id_, {"content": [{"type": "text", "text": self._call(params.get("name", ""), params.get("arguments"))}]})
            except ValueError as e:
                return self._ok(id_, {"content": [{"type": "text", "text": str(e)}], "isError": True})
        return {"jsonrpc": "2.0", "id": id_, "error": {"code": -32601, "message": f"unknown method: {method}"}}

    @staticmethod
    def _ok(id_, result: dict) -> dict:
        return {"jsonrpc": "2.0", "id": id_, "result": result}

    def serve(self, source: IO[str], sink: IO[str]) -> None:
        for line in source:
            if not line.strip():
                continue
            try:
                answer = self.handle(json.loads(line))
            except json.JSONDecodeError as e:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
            except Exception as e:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32603, "message": str(e)}}
            if answer is not None:
                print(json.dumps(answer, ensure_ascii=False), file=sink, flush=True)
