"""Sessions over stores, and a small tool surface with JSON-like requests."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import SparkSession

from ..sources import ndjson
from ..sources.store import Store, StoreError
from . import engine

MOST_SESSIONS = 64


class ServiceError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class Broker:
    """Open stores by growing session numbers, 64 at most; searches are text searches."""

    def __init__(self, spark: SparkSession):
        self.spark, self.sessions, self.last = spark, {}, 0

    def open(self, root: str, create: bool = False) -> int:
        if len(self.sessions) >= MOST_SESSIONS:
            raise ServiceError("invalid_request", f"broker session limit exceeded: {MOST_SESSIONS}")
        store = Store(self.spark, root)
        try:
            store.create() if create else store.manifest()
        except StoreError as e:
            raise ServiceError("storage", str(e)) from e
        self.last += 1
        self.sessions[self.last] = store
        return self.last

    def store(self, session: int) -> Store:
        if session not in self.sessions:
            raise ServiceError("session_not_found", f"no session {session}")
        return self.sessions[session]

    def close(self, session: int) -> None:
        self.store(session)
        del self.sessions[session]

    def search(self, session: int, text: str, top_k: int = 5, include_preview: bool = False) -> list[dict]:
        found = engine.search(self.store(session), engine.SearchRequest("text", text, None, top_k, include_preview))
        return [r.asDict() for r in found.collect()]  # top_k rows


class Tools:
    """Requests {"tool": ..., ...}; roots must lie under the allowed one."""

    def __init__(self, spark: SparkSession, allowed: str):
        self.broker, self.allowed = Broker(spark), PurePosixPath(allowed)

    def handle(self, request: dict) -> dict:
        try:
            return {"ok": True, "result": self._run(request)}
        except ServiceError as e:
            return {"ok": False, "code": e.code, "error": str(e)}
        except (KeyError, ValueError) as e:
            return {"ok": False, "code": "invalid_request", "error": str(e)}
        except StoreError as e:
            return {"ok": False, "code": "storage", "error": str(e)}

    def _run(self, request: dict):
        tool = request["tool"]
        if "root" in request:
            root = PurePosixPath(request["root"])
            if ".." in root.parts or self.allowed not in (root, *root.parents):
                raise ServiceError("invalid_request", f"root must be under {self.allowed}")
        if tool in ("open", "create"):
            return self.broker.open(request["root"], tool == "create")
        if tool == "close":
            return self.broker.close(request["session"])
        if tool == "search":
            return self.broker.search(request["session"], request["text"], request.get("top_k", 5), request.get("include_preview", False))
        if tool == "ingest":
            store = self.broker.store(request["session"])
            return store.publish_documents(ndjson.documents(store.spark, request["path"]))
        raise ServiceError("invalid_request", f"unknown tool {tool}")
