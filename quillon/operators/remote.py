"""Vector search for programs elsewhere: the calls of an index as JSON, and a client for them.

`SearchService` answers calls on the driver, `serve` puts it behind HTTP, and `SearchClient`
makes the calls by any function that posts JSON. Answers hold n rows at most.
"""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import TYPE_CHECKING, Any

from quillon.operators import vector

if TYPE_CHECKING:
    from quillon.database import Database

#: post(path, payload) sends and returns parsed JSON.
Post = Callable[[str, dict[str, Any]], Any]


class SearchService:
    """The calls, by name. A call or an index that isn't known is a KeyError."""

    CALLS = ("list", "describe", "nearest_from_array", "nearest_from_id", "add", "delete")

    def __init__(self, db: Database):
        self.db = db

    def __call__(self, path: str, payload: dict[str, Any]) -> Any:
        name = path.strip("/")
        if name not in self.CALLS:
            raise KeyError(f"no call {name!r}")
        return getattr(self, f"_{name}")(**payload)

    def _list(self) -> list[str]:
        return sorted(self.db.indexes)

    def _rows(self, index: str):
        found = self.db.indexes[index]
        return found, *self.db.index_rows(found)

    def _describe(self, index: str) -> dict[str, Any]:
        found, rows, _, column = self._rows(index)
        return vector.describe(rows, column, found.measure).first().asDict()

    def _nearest_from_array(self, index: str, vector_: Sequence[float], n: int = 100) -> list[list]:
        found, rows, key, column = self._rows(index)
        return [list(r) for r in vector.nearest(rows, key, column, list(vector_), n, found.measure).collect()]

    def _nearest_from_id(self, index: str, id_: Any, n: int = 100) -> list[list]:
        found, rows, key, column = self._rows(index)
        return [list(r) for r in vector.nearest_to_id(rows, key, column, id_, n, found.measure).collect()]

    def _add(self, index: str, items: dict[str, list[float]]) -> int:
        """Vectors by id; those whose ids are there already are replaced."""
        found, _, key, column = self._rows(index)
        self._delete(index, list(items))
        self.db.insert(found.table, [{key: i, column: v} for i, v in items.items()])
        return len(items)

    def _delete(self, index: str, ids: list) -> int:
        found, _, key, _ = self._rows(index)
        gone = self.db.frame([{key: i} for i in ids], {key: self.db.store.fields(found.table)[key]})
        self.db.store.rewrite(found.table, lambda rows: vector.delete(rows, gone, key))
        return len(ids)


class SearchClient:
    def __init__(self, post: Post, index: str):
        self.post, self.index = post, index

    def list(self) -> list[str]:
        return self.post("list", {})

    def describe(self) -> dict[str, Any]:
        return self.post("describe", {"index": self.index})

    def nearest_from_array(self, query: Sequence[float], n: int = 100) -> tuple[list, list[float]]:
        """(ids, scores), best first."""
        return _columns(self.post("nearest_from_array", {"index": self.index, "vector_": [float(x) for x in query], "n": n}))

    def nearest_from_id(self, id_: Any, n: int = 100) -> tuple[list, list[float]]:
        return _columns(self.post("nearest_from_id", {"index": self.index, "id_": id_, "n": n}))

    def add(self, items: dict[str, Sequence[float]]) -> int:
        return self.post("add", {"index": self.index, "items": {k: [float(x) for x in v] for k, v in items.items()}})

    def delete(self, ids: Sequence) -> int:
        return self.post("delete", {"index": self.index, "ids": [*ids]})


def _columns(rows: list[list]) -> tuple[list, list[float]]:
    return [r[0] for r in rows], [r[1] for r in rows]


def http_post(base: str, timeout: float = 60.0) -> Post:
    """Calls to a served index. A call that the service refuses is a KeyError or a ValueError."""

    def post(path: str, payload: dict[str, Any]) -> Any:
        request = urllib.request.Request(f"{base.rstrip('/')}/{path}", json.dumps(payload).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            raise (KeyError if e.code == 404 else ValueError)(json.load(e)["error"]) from None

    return post


def serve(service: SearchService, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """Answer calls on a thread until shutdown(); port 0 is any free one."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            status, out = 200, None
            try:
                out = service(self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            except KeyError as e:
                status, out = 404, {"error": str(e.args[0]) if e.args else "not found"}
            except (ValueError, TypeError) as e:
                status, out = 400, {"error": str(e)}
            body = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: Any) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
