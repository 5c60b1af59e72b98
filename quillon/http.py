"""The service over HTTP: GET /api/search, /api/du, /api/stats, /api/feed, /api/health; POST /api/rescan, /api/rebuild."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from quillon.service import Service


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def answer(service: Service, method: str, target: str, rescan: Callable[[], None] | None = None, rebuild: Callable[[], None] | None = None) -> tuple[int, dict]:
    """(status, body). Errors of a query are answers of status 200 with ok: false."""
    url = urlsplit(target)
    q = {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
    if method == "GET":
        if url.path == "/api/health":
            return 200, service.health()
        if url.path == "/api/search":
            return 200, service.search(q.get("q", ""), _number(q.get("limit")), q.get("sort"), q.get("desc"))
        if url.path == "/api/du":
            top = _number(q.get("top"))
            return 200, service.du(q.get("path", ""), _number(q.get("depth")), 20 if top is None else top, q.get("allocated", "0"))
        if url.path == "/api/stats":
            return 200, service.stats()
        if url.path == "/api/feed":
            return 200, service.feed()
    elif method == "POST" and url.path == "/api/rescan" and rescan:
        rescan()
        return 200, {"ok": True, "reloaded": service.refresh()}
    elif method == "POST" and url.path == "/api/rebuild" and rebuild:
        rebuild()
        return 200, {"ok": True, "requested": "rebuild"}
    return 404, {"ok": False, "error": f"no {url.path}"}


def server(service: Service, host: str = "127.0.0.1", port: int = 0, rescan: Callable[[], None] | None = None, rebuild: Callable[[], None] | None = None) -> ThreadingHTTPServer:
    """Not yet serving; port 0 takes a free one. Requests that change something must come from the
    page of this server, or from no page."""
    class Handler(BaseHTTPRequestHandler):
        def _reply(self):
            origin = self.headers.get("Origin")
            if self.command == "POST" and origin and urlsplit(origin).netloc != self.headers.get("Host"):
                status, body = 403, {"ok": False, "error": "another origin"}
            else:
                status, body = answer(service, self.command, self.path, rescan, rebuild)
            raw = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _reply

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
