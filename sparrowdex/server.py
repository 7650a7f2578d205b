"""An HTTP server over one engine, by the standard library."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException

from sparrowdex import validate
from sparrowdex.engine import Engine
from sparrowdex.storage import is_folder, temporaries

MOST_BODY = 1 << 20


class Refused(Exception):
    """A request that does not fit its schema."""


def body_of(handler: BaseHTTPRequestHandler) -> tuple[str, int]:
    """(query, k) of a JSON body; k is 5 by default and at most 10."""
    size = int(handler.headers.get("Content-Length") or 0)
    if size > MOST_BODY:
        raise Refused("the body is too long")
    try:
        body = json.loads(handler.rfile.read(size))
        return validate.query(body.get("query")), validate.count(body.get("k", 5), 10)
    except (ValueError, AttributeError) as e:
        raise Refused(str(e)) from e


def parameters(query: str, *names: str) -> list[str]:
    given = {k: v[-1] for k, v in parse_qs(query).items()}
    if missing := [n for n in names if n not in given]:
        raise Refused("missing: " + ", ".join(missing))
    return [given[n] for n in names]


def make(engine: Engine, host: str = "127.0.0.1", port: int = 8000, hybrid: bool = False) -> ThreadingHTTPServer:
    """GET / and /health, POST /search, /answer, /search_dataset and /answer_dataset; answers are made one at a time. Port 0 takes any free one."""
    generating = threading.Lock()

    def saved(path):
        """A document's content; a folder of lines, which may be large, only by its name."""
        if is_folder(engine.spark, path):
            return {"saved": path}
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    def search(h, query):
        q, k = body_of(h)
        rows = engine.search(q, k, hybrid).collect()
        return {"question": q, "sources": [{"file_path": r["path"], "first_character_index": r["first"], "last_character_index": r["last"]} for r in rows]}

    def answer(h, query):
        q, k = body_of(h)
        with generating:
            return {"query": q, "answer": engine.answer(q, k, hybrid)}

    def search_dataset(h, query):
        path, k, folder = parameters(query, "dataset_path", "k", "save_directory")
        if not k.isdecimal():
            raise Refused("k must be an integer")
        return saved(engine.search_dataset(path, int(k), folder, hybrid))

    def answer_dataset(h, query):
        path, folder = parameters(query, "student_search_results_path", "save_directory")
        with generating:
            return saved(engine.answer_dataset(path, folder, hybrid))

    routes = {("GET", "/"): lambda h, q: "ready", ("GET", "/health"): lambda h, q: {"status": "ok"}, ("POST", "/search"): search, ("POST", "/answer"): answer, ("POST", "/search_dataset"): search_dataset, ("POST", "/answer_dataset"): answer_dataset}

    class Handler(BaseHTTPRequestHandler):
        def reply(self) -> None:
            url = urlsplit(self.path)
            known = routes.get((self.command, url.path))
            try:
                with temporaries(engine.spark):
                    code, out = (200, known(self, url.query)) if known else (405 if any(p == url.path for _, p in routes) else 404, {"detail": "no such resource"})
            except Refused as e:
                code, out = 422, {"detail": str(e)}
            except (ValueError, OSError) as e:
                code, out = 400, {"detail": str(e)}
            except (PySparkException, Py4JError) as e:
                code, out = 500, {"detail": str(e)[:500]}
            data = json.dumps(out, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = reply

        def log_message(self, *args) -> None:
            pass

    engine.tables  # noqa: B018  an index that cannot be read fails here, not at the first request
    return ThreadingHTTPServer((host, port), Handler)
