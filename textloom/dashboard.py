"""A page on the loopback interface to start one run at a time and look at its result."""

from __future__ import annotations

import json
import shutil
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from typing import Any

from . import cli
from .profiles import PROFILES

PREVIEW_RECORDS, MOST_BYTES = 100_000, 65_536
DOWNLOADS = {"report": "json_report", "html": "html_report", "policy": "resolved_policy"}
#: Outputs that are folders of part files; they are sent as one file.
CORPORA = {"cleaned": "cleaned_corpus", "rejected": "rejected_records"}
PAGE = """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>textloom</title><style>body{font-family:sans-serif;margin:2em;max-width:60em}label{display:block;margin:.4em 0}
.bar{background:#88a;height:.8em}</style></head><body><h1>textloom</h1><form id="f"><label>Input <input name="input" size="60" required></label><label>Mode <select name="mode"><option>preview<option>analyze<option>clean</select></label>
<label>Profile <select name="profile" id="p"></select></label><label>Text field <input name="text_field" value="text"></label><label><input type="checkbox" name="near_dedup"> near duplicates</label><fieldset><legend>Policy (empty: default)</legend><span id="o"></span></fieldset><button>Start</button></form><pre id="s"></pre><div id="r"></div>
<script>const $=i=>document.getElementById(i);fetch('/api/meta').then(r=>r.json()).then(m=>m.profiles.forEach(p=>{const o=document.createElement('option');o.value=p.key;o.textContent=p.name;$('p').append(o)})||m.options.forEach(n=>{const l=document.createElement('label'),i=document.createElement('input');l.textContent=n+' ';i.name=n;l.append(i);$('o').append(l)}));
$('f').onsubmit=e=>{e.preventDefault();const d=Object.fromEntries(new FormData($('f')));d.near_dedup=d.near_dedup==='on';for(const k of Object.keys(d))if(d[k]==='')delete d[k];fetch('/api/start',{method:'POST',headers:{'Content-Type':'application/json'},body:JSON.stringify(d)}).then(r=>r.json()).then(x=>{$('s').textContent=JSON.stringify(x)})};
setInterval(()=>fetch('/api/status').then(r=>r.json()).then(x=>{$('s').textContent=x.state+' '+(x.stage||'')+' '+(x.error||'');const r=x.result;$('r').replaceChildren();if(!r)return;const most=Math.max(1,...Object.values(r.findings_by_code));
for(const[k,n]of Object.entries(r.findings_by_code)){const t=document.createElement('div');t.textContent=k+': '+n;const b=document.createElement('div');b.className='bar';b.style.width=100*n/most+'%';$('r').append(t,b)}
for(const[k,v]of Object.entries(r.script_threshold_preview)){const t=document.createElement('div');t.textContent='script ratio below '+k+': '+v.records_below;const b=document.createElement('div');b.className='bar';b.style.width=v.percentage+'%';$('r').append(t,b)}
for(const n of ['cleaned','rejected','report','html','policy'])if(r.outputs[{cleaned:'cleaned_corpus',rejected:'rejected_records',report:'json_report',html:'html_report',policy:'resolved_policy'}[n]]){const a=document.createElement('a');a.href='/download/'+n;a.textContent=n+' ';$('r').append(a)}
for(const[k,v]of Object.entries(r.examples_by_code))for(const x of v){const p=document.createElement('p');p.textContent=k+' #'+x.record+': '+x.text;$('r').append(p)}}),1000)</script></body></html>"""


class Jobs:
    """The one job that may run, and the result of the last."""

    def __init__(self, output_root: Path):
        self.root, self.lock, self.state = output_root, threading.Lock(), {"state": "idle"}

    def start(self, wish: dict[str, Any]) -> tuple[int, dict[str, Any]]:
        """(status, answer): the wish is checked as command line options are."""
        mode = wish.get("mode")
        if mode not in ("preview", "analyze", "clean") or not isinstance(wish.get("input"), str) or not Path(wish["input"]).is_file():
            return 400, {"error": "mode must be preview, analyze or clean, and input an existing file"}
        line = ["clean" if mode == "clean" else "analyze", wish["input"], "--text-field", str(wish.get("text_field") or "text")]
        line += ["--near-dedup"] if wish.get("near_dedup") is True else []
        try:
            for name in cli.OVERRIDES:
                if wish.get(name) is not None:
                    line += ["--" + name.replace("_", "-"), str(wish[name])]
            arguments = cli.parser().parse_args(line)
            policy, profile = cli.policy_of(arguments)
        except (SystemExit, ValueError) as error:
            return 400, {"error": f"bad policy: {error}"}
        with self.lock:
            if self.state["state"] == "running":
                return 409, {"error": "a job is running"}
            out = self.root / time.strftime("%Y%m%d-%H%M%S")
            self.state = {"state": "running", "mode": mode, "stage": "starting", "output_dir": str(out)}
        threading.Thread(target=self._run, args=(arguments, policy, profile, out, PREVIEW_RECORDS if mode == "preview" else None), daemon=True).start()
        return 202, dict(self.state)

    def _run(self, arguments: Any, policy: Any, profile: Any, out: Path, limit: int | None) -> None:
        from .run import run_audit

        try:
            report = run_audit(cli.session(), arguments.input, out, arguments.command, policy, profile, arguments.format, arguments.text_field, limit, True, progress=lambda stage: self._set(stage=stage))
            self._set(state="done", result=report)
        except Exception as error:  # noqa: BLE001  the job's failure is its answer
            self._set(state="failed", error=str(error)[:500])

    def _set(self, **values: Any) -> None:
        with self.lock:
            self.state = {**self.state, **values}


def handler(jobs: Jobs) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_: Any) -> None:
            pass

        def _send(self, status: int, body: bytes, kind: str = "application/json") -> None:
            self.send_response(status)
            for name, value in (("Content-Type", kind + "; charset=utf-8"), ("Content-Length", str(len(body))), ("X-Content-Type-Options", "nosniff"), ("Cache-Control", "no-store")):
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(body)

        def _send_parts(self, folder: Path) -> None:
            """The part files of a folder in their order, as one download, a block at a time."""
            parts = sorted(folder.glob("part-*"))
            self.send_response(200)
            for name, value in (("Content-Type", "text/plain; charset=utf-8"), ("Content-Length", str(sum(p.stat().st_size for p in parts))), ("Content-Disposition", f'attachment; filename="{folder.name}"'), ("X-Content-Type-Options", "nosniff"), ("Cache-Control", "no-store")):
                self.send_header(name, value)
            self.end_headers()
            for part in parts:
                with part.open("rb") as file:
                    shutil.copyfileobj(file, self.wfile)

        def _json(self, status: int, value: Any) -> None:
            self._send(status, json.dumps(value, ensure_ascii=False, default=str).encode())

        def _trusted(self) -> bool:
            port = self.server.server_address[1]
            hosts = {f"127.0.0.1:{port}", f"localhost:{port}"}
            origin = self.headers.get("Origin")
            return self.headers.get("Host") in hosts and (origin is None or origin.removeprefix("http://") in hosts)

        def do_GET(self) -> None:  # noqa: N802
            if not self._trusted():
                return self._json(403, {"error": "foreign host or origin"})
            outputs = (jobs.state.get("result") or {}).get("outputs", {})
            if self.path == "/":
                return self._send(200, PAGE.encode(), "text/html")
            if self.path == "/api/meta":
                return self._json(200, {"profiles": [{"key": p.key, "name": p.name} for p in PROFILES.values()], "options": [name for name in cli.OVERRIDES if name != "profile"]})
            if self.path == "/api/status":
                return self._json(200, jobs.state)
            corpus = CORPORA.get(self.path.removeprefix("/download/"), "")
            if corpus in outputs:
                return self._send_parts(Path(outputs[corpus]))
            name = "html_report" if self.path == "/report" else DOWNLOADS.get(self.path.removeprefix("/download/"), "") if self.path.startswith("/download/") else ""
            if name in outputs:
                return self._send(200, Path(outputs[name]).read_bytes(), "text/html" if name == "html_report" else "application/json")
            self._json(404, {"error": "not found"})

        def do_POST(self) -> None:  # noqa: N802
            if not self._trusted():
                return self._json(403, {"error": "foreign host or origin"})
            if self.path != "/api/start":
                return self._json(404, {"error": "not found"})
            if self.headers.get("Content-Type", "").split(";")[0] != "application/json":
                return self._json(415, {"error": "JSON only"})
            size = int(self.headers.get("Content-Length") or 0)
            if not 1 <= size <= MOST_BYTES:
                return self._json(413, {"error": f"1 to {MOST_BYTES} bytes"})
            try:
                wish = json.loads(self.rfile.read(size))
            except ValueError:
                wish = None
            if not isinstance(wish, dict):
                return self._json(400, {"error": "a JSON object"})
            self._json(*jobs.start(wish))

    return Handler


def server(port: int, output_root: Path) -> ThreadingHTTPServer:
    return ThreadingHTTPServer(("127.0.0.1", port), handler(Jobs(output_root)))


def serve(port: int, output_root: Path) -> None:
    with server(port, output_root) as running:
        print(f"http://127.0.0.1:{running.server_address[1]}/")
        running.serve_forever()
