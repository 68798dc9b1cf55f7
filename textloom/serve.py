"""Records over HTTP: a thin server around the kernels; no Spark job for a request.

GET / and /health, /v1/rules; POST /v1/clean, /v1/check, /v1/clean-and-check with {record, ...options}.
Wrong requests get 400, unknown paths 404, errors of the server 500, a body must tell its length.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .kernels import records
from .kernels.cleaner import META_VERSION

MAX_BODY = 50 * 1024 * 1024
CLEAN_OPTIONS = ("fields", "rules", "add_meta", "meta_detail", "max_meta_spans", "max_meta_changes", "line_no")
CHECK_OPTIONS = ("checks", "excerpt_chars", "line_no")
ROUTES = {
    "/v1/clean": (records.clean_record, CLEAN_OPTIONS),
    "/v1/check": (records.check_record, CHECK_OPTIONS),
    "/v1/clean-and-check": (records.clean_and_check, tuple(dict.fromkeys(CLEAN_OPTIONS + CHECK_OPTIONS))),
}


def get(path: str) -> tuple[int, dict]:
    if path in ("/", "/health"):
        return 200, {"status": "ok", "service": "textloom", "version": META_VERSION, "endpoints": ["/v1/rules", *ROUTES]}
    return (200, records.catalog()) if path == "/v1/rules" else (404, {"error": "not_found"})


def post(path: str, body: bytes) -> tuple[int, dict]:
    if path not in ROUTES:
        return 404, {"error": "not_found"}
    run, options = ROUTES[path]
    try:
        payload = json.loads(body.decode("utf-8"))
        if not isinstance(payload, dict) or not isinstance(payload.get("record"), dict):
            raise ValueError("the body and its record must be JSON objects")
        return 200, run(payload["record"], **{o: payload[o] for o in options if o in payload})
    except (TypeError, ValueError) as error:
        return 400, {"error": "invalid_request", "message": str(error)}
    except RuntimeError as error:
        return 503, {"error": "service_unavailable", "message": str(error)}
    except Exception:
        return 500, {"error": "internal_error"}


class Handler(BaseHTTPRequestHandler):
    server_version = "Textloom/1.0"

    def _answer(self, status: int, payload: dict) -> None:
        body = json.dumps(payload, ensure_ascii=False).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json; charset=utf-8")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self) -> None:
        self._answer(*get(self.path))

    def do_POST(self) -> None:
        told = self.headers.get("Content-Length", "")
        if not told.isdigit() or int(told) > self.server.max_body:
            self.close_connection = True
            self._answer(400, {"error": "invalid_request", "message": f"a Content-Length of at most {self.server.max_body} is required"})
            return
        self._answer(*post(self.path, self.rfile.read(int(told))))

    def log_message(self, *_) -> None:
        pass


def server(host: str = "127.0.0.1", port: int = 8000, max_body: int = MAX_BODY) -> ThreadingHTTPServer:
    made = ThreadingHTTPServer((host, port), Handler)
    made.max_body = max(1, max_body)
    return made
