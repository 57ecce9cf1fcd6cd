"""A stage graph that runs what has changed.

A stage's key is made of its specification, code, version and the contents of its inputs, so a changed stage whose
output is the same as before stops there: what follows keeps its key. Plans (what would run) need no data. Stage
functions get frames and return unevaluated frames; the store's write is where they run.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import os
import socket
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from contextvars import ContextVar
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from .identity import canonical, code_digest, digest, environment
from .store import Ledger, Manifest, Store, append, dig, lines


class Events:
    """JSON lines of a run, numbered; a listener that fails is left out, the run goes on."""

    def __init__(self, path: Path | None = None, listeners: Iterable[Callable[[dict], None]] = ()):
        self.path, self.listeners, self.n = path, list(listeners), 0

    def __call__(self, kind: str, **what) -> None:
        self.n += 1
        event = {"seq": self.n, "kind": kind, "at": time.time()} | what
        if self.path:
            append(self.path, event)
        for listener in list(self.listeners):
            try:
                listener(event)
            except Exception:
                self.listeners.remove(listener)


_current: ContextVar[Events | None] = ContextVar("events", default=None)


def progress(done: float, text: str = "") -> None:
    """From inside a stage: how far it is (0 to 1). Nothing happens outside a run."""
    _tell("progress", done=done, text=text)


def metric(name: str, value: float | None) -> None:
    """From inside a stage: a number worth showing while the run goes on; null where it isn't finite."""
    _tell("metric", name=name, value=value if value is not None and math.isfinite(value) else None)


def warning(text: str) -> None:
    """From inside a stage: what whoever reads the run should know."""
    _tell("warning", text=text)


def _tell(kind: str, **what) -> None:
    events = _current.get()
    if events is not None:
        events(kind, **what)


def read_events(path: Path, offset: int = 0) -> tuple[list[dict], int]:
    """Whole lines from a byte offset on, and the offset after them; a line still being written stays."""
    raw = path.read_bytes()[offset:] if path.exists() else b""
    end = raw.rfind(b"\n") + 1
    return [json.loads(x) for x in raw[:end].splitlines()], offset + end


def replay(events: Iterable[dict]) -> dict:
    """The state of a run from its events."""
    state: dict[str, Any] = {"status": "unknown", "stages": {}, "metrics": {}, "warnings": []}
    for e in events:
        if e["kind"] in ("run_started", "run_finished", "run_failed"):
            state["status"] = {"run_started": "running", "run_finished": "ok", "run_failed": "failed"}[e["kind"]]
        elif e["kind"] == "stage":
            state["stages"][e["stage"]] = e["status"]
        elif e["kind"] == "metric":
            state["metrics"][e["name"]] = e["value"]
        elif e["kind"] == "progress":
            state["progress"] = {"done": e["done"], "text": e["text"]}
        elif e["kind"] == "warning":
            state["warnings"].append(e["text"])
    return state


def judge(state: dict, last_event: float, alive: bool, now: float, patience: float = 3600) -> str | None:
    """failed, died or stalled, if the run needs someone."""
    if state["status"] == "failed":
        return "failed"
    if state["status"] == "running":
        return "died" if not alive else "stalled" if now - last_event > patience else None
    return None


@dataclass(frozen=True)
class Stage:
    """fn(spec?, *inputs) -> DataFrame, JSON value or Outputs.

    fingerprint: of a source's data, in place of inputs. A stage without inputs and without one reads who knows what, so
    it runs every time (what follows is still reused if its output is the same), unless source is False: then its
    specification and code are all that it depends on.
    """

    name: str
    fn: Callable
    inputs: Sequence[str] = ()
    spec: Any = None
    version: int = 1
    fingerprint: Callable[[], str] | None = None
    side: Sequence[str] = ()
    source: bool = True

    @property
    def volatile(self) -> bool:
        """A source of which nothing tells whether its data have changed: it runs every time."""
        return not self.inputs and self.fingerprint is None and self.source

    def key(self, inputs: Sequence[str], spark: SparkSession | None = None) -> str:
        return digest(self.name, self.version, canonical(self.spec), code_digest(self.fn), list(inputs), self.fingerprint() if self.fingerprint else None, environment(spark))


@dataclass(frozen=True)
class Headline:
    """Where a book's verdict lies in a stage's output, by dotted paths, and the family of trials that it belongs to."""

    stage: str
    sharpe: str
    n: str
    daily: str
    value: str = "pnl"
    family: str = "book"
    periods: int = 252

    def read(self, output: Any) -> dict:
        return {"sharpe": dig(output, self.sharpe), "n": dig(output, self.n)}

    def series(self, output: Any) -> dict[str, float]:
        return {str(d["date"]): float(d[self.value]) for d in dig(output, self.daily)}


@dataclass(frozen=True)
class Outputs:
    """A value and named side outputs, read by other stages as stage.side."""

    value: Any
    side: dict[str, Any] = field(default_factory=dict)


@dataclass
class Result:
    name: str
    key: str
    output: str
    reused: bool
    seconds: float
    side: dict[str, str]


class Pipeline:
    def __init__(self, stages: Sequence[Stage], root: str | Path, spark: SparkSession, headline: dict[str, str] | None = None, books: Sequence[Headline] = ()):
        self.stages = {s.name: s for s in stages}
        if len(self.stages) < len(stages):
            raise ValueError("two stages share a name")
        known = set(self.stages) | {f"{s.name}.{x}" for s in stages for x in s.side}
        for s in stages:
            if lost := [i for i in s.inputs if i not in known]:
                raise ValueError(f"stage {s.name}: no such input {lost}")
        self.root, self.spark, self.headline, self.books = Path(root), spark, headline or {}, tuple(books)
        self.store, self.manifest, self.ledger = Store(root, spark), Manifest(root), Ledger(root)
        self.order = self._sorted()

    def _sorted(self) -> list[str]:
        done: list[str] = []
        open_: set[str] = set()

        def visit(name: str) -> None:
            if name in open_:
                raise ValueError(f"stages depend on each other: {sorted(open_)}")
            if name not in done:
                open_.add(name)
                for i in self.stages[name].inputs:
                    visit(i.split(".")[0])
                open_.discard(name)
                done.append(name)

        for name in self.stages:
            visit(name)
        return done

    def needed(self, targets: Sequence[str] | None) -> list[str]:
        want, todo = set(), list(targets or self.stages)
        while todo:
            if (n := todo.pop()) not in want:
                want.add(n)
                todo += [i.split(".")[0] for i in self.stages[n].inputs]
        return [n for n in self.order if n in want]

    def _decide(self, stage: Stage, inputs: Sequence[str]) -> tuple[str, dict | None]:
        """The one rule of reuse: a known key, not of a volatile source, whose objects are all there."""
        key = stage.key(inputs, self.spark)
        record = None if stage.volatile else self.manifest.find(key)
        if record and all(map(self.store.has, [record["output"], *record["side"].values()])):
            return key, record
        return key, None

    def _refs(self, stage: Stage, done: dict[str, dict]) -> list[str] | None:
        out = []
        for i in stage.inputs:
            name, _, side = i.partition(".")
            if name not in done:
                return None
            out.append(done[name]["side"][side] if side else done[name]["output"])
        return out

    def plan(self, targets: Sequence[str] | None = None) -> dict[str, str]:
        """hit, run, or upstream (decided once its inputs have run)."""
        done, out = {}, {}
        for name in self.needed(targets):
            refs = self._refs(self.stages[name], done)
            if refs is None:
                out[name] = "upstream"
                continue
            _, record = self._decide(self.stages[name], refs)
            out[name] = "hit" if record else "run"
            if record:
                done[name] = record
        return out

    def signature(self) -> str:
        """Of the whole graph by definition alone: the same study on the same sources is the same trial."""
        keys: dict[str, str] = {}
        for n in self.order:
            s = self.stages[n]
            keys[n] = s.key(spark=self.spark, inputs=[keys[i.split(".")[0]] + i.partition(".")[2] for i in s.inputs])
        return digest(keys)

    def run(self, targets: Sequence[str] | None = None, listeners: Iterable[Callable[[dict], None]] = (), charge: bool = True, meta: dict | None = None) -> dict[str, Result]:
        """meta: of the run, for its record (the study and its parameters)."""
        run_id = f"{dt.datetime.now(dt.UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:6]}"
        events = Events(self.root / "runs" / run_id / "events.jsonl", listeners)
        events("run_started", run=run_id, stages=self.needed(targets), pid=os.getpid(), host=socket.gethostname())
        token = _current.set(events)
        done: dict[str, dict] = {}
        results: dict[str, Result] = {}
        try:
            for name in self.needed(targets):
                stage, began = self.stages[name], time.time()
                refs = self._refs(stage, done) or []
                key, record = self._decide(stage, refs)
                reused = record is not None
                if record is None:
                    events("stage", stage=name, status="running")
                    got = stage.fn(*([stage.spec] if stage.spec is not None else []), *map(self.store.get, refs))
                    got = got if isinstance(got, Outputs) else Outputs(got)
                    if set(got.side) != set(stage.side):
                        raise ValueError(f"stage {name} declares side outputs {sorted(stage.side)} and gave {sorted(got.side)}")
                    record = {"stage": name, "key": key, "inputs": refs, "output": self.store.put(got.value), "side": {k: self.store.put(v) for k, v in got.side.items()}}
                    self.manifest.add(**record)
                done[name] = record
                results[name] = Result(name, key, record["output"], reused, time.time() - began, record["side"])
                events("stage", stage=name, status="reused" if reused else "built", seconds=results[name].seconds)
        except Exception as e:
            events("run_failed", error=str(e)[:500])
            raise
        finally:
            _current.reset(token)
        if charge and not targets:
            head = {k: dig(self.store.get(done[p.split(".")[0]]["output"]), p.partition(".")[2]) for k, p in self.headline.items()}
            self.ledger.charge(self.signature(), head)
            for b in self.books:
                verdict = b.read(self.store.get(done[b.stage]["output"]))
                self.ledger.charge(f"{b.stage}:{done[b.stage]['key']}", verdict | {"stage": b.stage, "family": b.family}, kind="book")
        events("run_finished")
        append(self.root / "runs.jsonl", {"run": run_id, "signature": self.signature(), "stages": {n: r.output for n, r in results.items()}, "sides": {n: r.side for n, r in results.items() if r.side}, "keys": {n: r.key for n, r in results.items()}} | ({"meta": meta} if meta else {}))
        return results

    def rebase(self, root: str | Path) -> Pipeline:
        """The same stages over another folder."""
        return Pipeline(list(self.stages.values()), root, self.spark, self.headline, self.books)

    def load(self, name: str) -> Any:
        """A stage's newest output, built by the plan's keys; raises if it isn't there."""
        name, _, side = name.partition(".")
        runs = [r for r in lines(self.root / "runs.jsonl") if name in r["stages"]]
        if not runs:
            raise KeyError(f"{name} has not been built")
        return self.store.get(runs[-1]["sides"][name][side] if side else runs[-1]["stages"][name])
