"""HTTP front end: POST a job document, read the log as it runs.

GET /api/v1/ping, GET /api/v1/files/<path>, POST /api/v1/job, and a one-page form at /.  Any origin may
call.  Files outside the base folder are refused.
"""

from __future__ import annotations

import json
import os
import traceback
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from .plans import job
from .sources.fits import safe_path

PAGE = """<!doctype html><meta charset="utf-8"><title>frameloom</title><h1>Run a job</h1>
<textarea id="j" rows="20" cols="80">{"type": "seq", "steps": []}</textarea><br><button id="b">Run</button><pre id="o"></pre>
<script>document.getElementById("b").onclick = async () => { const r = await fetch("/api/v1/job", {method: "POST", body: document.getElementById("j").value});
document.getElementById("o").textContent = await r.text(); };</script>"""


def handler(spark: SparkSession, base: str):
    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: bytes, kind: str = "text/plain; charset=utf-8") -> None:
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Access-Control-Allow-Headers", "*")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_OPTIONS(self):
            self._send(204, b"")

        def do_GET(self):
            path = self.path.split("?")[0]
            if path in ("/", "/index.html"):
                self._send(200, PAGE.encode(), "text/html; charset=utf-8")
            elif path == "/api/v1/ping":
                self._send(200, b'{"message": "pong"}', "application/json")
            elif path.startswith("/api/v1/files"):
                self._file(path.removeprefix("/api/v1/files").lstrip("/"))
            else:
                self._send(404, b"not found")

        def _file(self, name: str) -> None:
            try:
                at = os.path.join(base, safe_path(name)) if name else base
                if os.path.isdir(at):
                    self._send(200, json.dumps(sorted(os.listdir(at))).encode(), "application/json")
                else:
                    with open(at, "rb") as f:
                        self._send(200, f.read(), "application/octet-stream")
            except (ValueError, OSError) as e:
                self._send(404, str(e).encode())

        def do_POST(self):
            if self.path != "/api/v1/job":
                self._send(404, b"not found")
                return
            try:
                plan = job.from_json(json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0)))))
            except (ValueError, TypeError) as e:
                self._send(400, str(e).encode())
                return
            self.send_response(200)
            self.send_header("Content-Type", "text/plain; charset=utf-8")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            say = lambda line: (self.wfile.write((line + "\n").encode()), self.wfile.flush())
            say(json.dumps(plan.to_json()))
            try:
                state = job.PipelineState(spark, f"file://{base}", f"file://{base}")
                for step in plan.steps if isinstance(plan, job.Sequence) else [plan]:
                    say(f"running {step.kind}")
                    state = step.run(state)
                say("done")
            except Exception as e:
                say(f"failed: {e}")
                say(traceback.format_exc(limit=1))

        def log_message(self, *args):
            job.log.info(*args)

    return Handler


def serve(spark: SparkSession, base: str, port: int = 8080) -> None:
    ThreadingHTTPServer(("", port), handler(spark, base)).serve_forever()
