"""Requests by name to an engine, in the form of JSON-RPC 2.0, with its error codes."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from tagweave.engine import Engine
from tagweave.operators.search import SearchConfig
from tagweave.sources.files import repository

#: Fixed values of the protocol.
PARSE, REQUEST, METHOD, PARAMS, INTERNAL, FAILED = -32700, -32600, -32601, -32602, -32603, -32000


class RequestError(Exception):
    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


class Requests:
    """Answers requests: {"jsonrpc": "2.0", "id": ..., "method": ..., "params": {...}}, as text or as a dictionary."""

    def __init__(self, engine: Engine) -> None:
        self.engine = engine
        self.tracked: dict[str, dict] = {}
        self.methods: dict[str, tuple[Callable[..., Any], dict[str, type | tuple], tuple[str, ...]]] = {
            # name: what answers, its parameters and their kinds, those that must be there
            "query": (self._query, {"query": str, "max_results": int, "mode": str, "max_recall": bool}, ("query",)),
            "match": (lambda query, limit=100: self._rows(self.engine.match(query, limit)), {"query": str, "limit": int}, ("query",)),
            "illuminate": (self._illuminate, {"seed": str, "depth": int, "max_nodes": int}, ("seed",)),
            "distill": (lambda seed=None, radius=2, max_atoms=1000: self.engine.distill(seed, radius, max_atoms), {"seed": str, "radius": int, "max_atoms": int}, ()),
            "read_file": (lambda path, start_line=0, end_line=1 << 30: {"content": self.engine.read_file(path, start_line, end_line)}, {"path": str, "start_line": int, "end_line": int}, ("path",)),
            "list_compounds": (lambda filter=None: self._rows(self.engine.list_compounds(filter)), {"filter": str}, ()),
            "get_stats": (lambda: self.engine.stats(), {}, ()),
            "ingest_text": (lambda source, content, bucket=None: self.engine.ingest(source, content, bucket), {"source": str, "content": str, "bucket": str}, ("source", "content")),
            "ingest_file": (lambda path: self.engine.ingest_file(path), {"path": str}, ("path",)),
            "chat": (lambda messages: self.engine.chat(messages), {"messages": list}, ("messages",)),
            "health": (lambda: self.engine.health(), {}, ()),
            "list_paths": (lambda: {"paths": self.engine.settings.watched()}, {}, ()),
            "add_path": (lambda path: {"added": self.engine.settings.add_path(path)}, {"path": str}, ("path",)),
            "remove_path": (lambda path: {"removed": self.engine.settings.remove_path(path)}, {"path": str}, ("path",)),
            "ingest_repository": (lambda archive, repository: self.engine.ingest_archive(archive, repository), {"archive": str, "repository": str}, ("archive", "repository")),
            "track_repository": (self._track, {"url": str, "interval_seconds": int}, ("url",)),
            "list_repositories": (lambda: list(self.tracked.values()), {}, ()),
            "list_quarantine": (lambda: self._rows(self.engine.store.table("quarantined").drop("content")), {}, ()),
            "quarantine": (lambda source_id, reason="": self.engine.store.quarantine(source_id, reason), {"source_id": str, "reason": str}, ("source_id",)),
            "restore": (lambda source_id: self.engine.store.restore(source_id, self.engine.options), {"source_id": str}, ("source_id",)),
        }

    def answer(self, request: str | dict) -> dict:
        """The response to one request; errors have a code and a message and raise nothing."""
        told = None
        try:
            if isinstance(request, str):
                try:
                    request = json.loads(request)
                except json.JSONDecodeError as e:
                    raise RequestError(PARSE, str(e)) from e
            if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
                raise RequestError(REQUEST, "a request needs jsonrpc 2.0 and a method")
            told = request.get("id")
            return {"jsonrpc": "2.0", "id": told, "result": self._called(request["method"], request.get("params", {}))}
        except RequestError as e:
            return {"jsonrpc": "2.0", "id": told, "error": {"code": e.code, "message": str(e)}}

    def _called(self, method: str, params: Any) -> Any:
        if method not in self.methods:
            raise RequestError(METHOD, f"no method {method}")
        call, kinds, needed = self.methods[method]
        if not isinstance(params, dict):
            raise RequestError(PARAMS, "params must be an object")
        params = {k: v for k, v in params.items() if v is not None}
        for k, v in params.items():
            if k not in kinds:
                raise RequestError(PARAMS, f"{method} has no parameter {k}")
            if not isinstance(v, kinds[k]) or kinds[k] is int and isinstance(v, bool):
                raise RequestError(PARAMS, f"{k} must be of kind {kinds[k].__name__}")
        missing = [k for k in needed if k not in params]
        if missing:
            raise RequestError(PARAMS, f"{', '.join(missing)} must be given")
        try:
            return call(**params)
        except (KeyError, ValueError) as e:  # what was asked for isn't there, or is none of what may be asked for
            raise RequestError(FAILED, f"{method}: {e}") from e
        except RequestError:
            raise
        except Exception as e:
            raise RequestError(INTERNAL, f"{method}: {e}") from e

    @staticmethod
    def _rows(df) -> list[dict]:
        """Rows of a result that its own limit, or the number of sources, bounds."""
        return [r.asDict(recursive=True) for r in df.collect()]

    def _query(self, query: str, max_results: int = 50, mode: str = "combined", max_recall: bool = False) -> dict:
        config = SearchConfig(max_results=max_results, mode="max_recall" if max_recall else mode)
        rows = self._rows(self.engine.search(query, config))
        return {"results": rows, "planets": sum(r["kind"] == "planet" for r in rows), "moons": sum(r["kind"] == "moon" for r in rows)}

    def _illuminate(self, seed: str, depth: int = 2, max_nodes: int = 50) -> dict:
        nodes, told = self.engine.illuminate(seed, depth, max_nodes)
        return told | {"nodes": self._rows(nodes)}

    def _track(self, url: str, interval_seconds: int = 3600) -> dict:
        from pyspark.sql import functions as F

        found = self.engine.spark.range(1).select(repository(F.lit(url)).alias("r")).first().r
        if found is None:
            raise ValueError(f"{url} is no repository")
        own = {"owner": found.owner, "repo": found.repo, "ref": found.ref, "enabled": True, "last_sync": None, "interval_seconds": interval_seconds}
        return self.tracked.setdefault(f"{found.owner}/{found.repo}", own)
