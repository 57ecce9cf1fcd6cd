"""Run pages in HTML, comparisons of runs, and alerts that are delivered once."""

from __future__ import annotations

import html
import json
import urllib.request
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

from . import runner
from .store import append, lines

_PAGE = "<!doctype html><meta charset=utf-8><title>{title}</title><style>body{{font:15px/1.5 sans-serif;margin:2em;max-width:60em}}td,th{{padding:.2em .8em;text-align:left;border-bottom:1px solid #ddd}}</style><h1>{title}</h1>{body}"


def _table(head: list[str], rows: list[list[Any]]) -> str:
    cell = lambda tag, x: f"<{tag}>{html.escape(f'{x:.6g}' if isinstance(x, float) else str(x))}</{tag}>"
    return "<table><tr>" + "".join(cell("th", h) for h in head) + "</tr>" + "".join("<tr>" + "".join(cell("td", x) for x in r) + "</tr>" for r in rows) + "</table>"


def run_page(root: Path, run: str) -> str:
    """The page of a run: its stages, metrics and warnings, from its events."""
    events, _ = runner.read_events(root / "runs" / run / "events.jsonl")
    state = runner.replay(events)
    seconds = {e["stage"]: e["seconds"] for e in events if e["kind"] == "stage" and "seconds" in e}
    body = f"<p>{html.escape(state['status'])}</p>" + _table(["stage", "status", "seconds"], [[n, s, seconds.get(n, "")] for n, s in state["stages"].items()])
    if state["metrics"]:
        body += _table(["metric", "value"], [[k, v] for k, v in state["metrics"].items()])
    body += "".join(f"<p>{html.escape(w)}</p>" for w in state["warnings"])
    return _PAGE.format(title=html.escape(run), body=body)


def write_pages(root: Path, out: Path) -> list[Path]:
    """A page a run and an index."""
    out.mkdir(parents=True, exist_ok=True)
    runs, made = lines(root / "runs.jsonl"), []
    for r in runs:
        made.append(out / f"{r['run']}.html")
        made[-1].write_text(run_page(root, r["run"]))
    rows = "".join(f"<li><a href='{html.escape(r['run'])}.html'>{html.escape(r['run'])}</a> {html.escape(r['signature'][:12])}</li>" for r in reversed(runs))
    (out / "index.html").write_text(_PAGE.format(title="Runs", body=f"<ul>{rows}</ul>"))
    return [*made, out / "index.html"]


def compare(root: Path, a: str, b: str) -> dict[str, str]:
    """stage -> same, differs, only in the first or only in the second, by the contents of outputs."""
    by = {r["run"]: r["stages"] for r in lines(root / "runs.jsonl")}
    x, y = by[a], by[b]
    return {n: "only in the second" if n not in x else "only in the first" if n not in y else "same" if x[n] == y[n] else "differs" for n in sorted({*x, *y})}


class Delivery:
    """Sends each alert once to a sink: a file of JSON lines, the terminal, a webhook, or a paging command."""

    def __init__(self, root: Path, sink: str = "jsonl", url: str = "", send: Callable[[str, bytes], None] | None = None):
        if sink not in ("jsonl", "stdout", "webhook", "page"):
            raise ValueError(f"no such sink: {sink}")
        self.path, self.sink, self.url, self.send = root / "alerts.jsonl", sink, url, send or self._post

    @staticmethod
    def _post(url: str, body: bytes) -> None:
        urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=10).close()

    def __call__(self, run: str, what: str, detail: Mapping[str, Any] | None = None) -> bool:
        """Whether it was sent now: an alert of a run is sent once, and counts as sent only when sending worked."""
        if any(r["run"] == run and r["what"] == what for r in lines(self.path)):
            return False
        alert = {"run": run, "what": what, "detail": dict(detail or {})}
        if self.sink in ("webhook", "page"):
            self.send(self.url, json.dumps(alert).encode())
        elif self.sink == "stdout":
            print(f"{run}: {what}")
        append(self.path, alert)
        return True


def check_runs(root: Path, deliver: Delivery, now: float, alive: Callable[[str], bool], patience: float = 3600) -> list[tuple[str, str]]:
    """Judges every run by its events and delivers what is new."""
    sent = []
    for log in sorted(root.glob("runs/*/events.jsonl")):
        events, _ = runner.read_events(log)
        run = log.parent.name
        what = runner.judge(runner.replay(events), events[-1]["at"] if events else 0.0, alive(run), now, patience)
        if what and deliver(run, what):
            sent.append((run, what))
    return sent
