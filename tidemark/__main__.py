"""python -m tidemark: run, plan, sweep, search, rerun, watch, report, compare and audit studies.

A study is MODULE:FUNCTION or FILE.py:FUNCTION; the function takes (root, spark, **params) and returns a Pipeline.
"""

from __future__ import annotations

import argparse
import importlib
import importlib.util
import json
import sys
import tempfile
import time
from collections.abc import Callable
from pathlib import Path

from .plans import config, experiment, report, runner, search, service
from .plans.store import Ledger, lines


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tidemark").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _study(ref: str, root: str, values: dict) -> runner.Pipeline:
    place, _, name = ref.partition(":")
    if place.endswith(".py"):
        spec = importlib.util.spec_from_file_location(Path(place).stem, place)
        module = importlib.util.module_from_spec(spec)
        sys.modules[spec.name] = module
        spec.loader.exec_module(module)
    else:
        module = importlib.import_module(place)
    factory = getattr(module, name)
    return factory(root, _spark(), **experiment.checked(factory, values))


def _values(params: list[str]) -> dict:
    out = {}
    for p in params:
        k, _, v = p.partition("=")
        try:
            out[k] = json.loads(v)
        except ValueError:
            out[k] = v
    return out


def _run(a, root: Path, settings) -> int:
    values = _values(a.set)
    p = _study(a.study, str(root), values)
    done = p.run(a.target, listeners=[service.Heartbeat()], meta={"study": a.study, "params": values})
    for r in done.values():
        print(f"{r.name}\t{'reused' if r.reused else 'built'}\t{r.seconds:.2f} s\t{r.output}")
    return 0


def _plan(a, root: Path, settings) -> int:
    print("\n".join(f"{n}\t{what}" for n, what in _study(a.study, str(root), _values(a.set)).plan(a.target).items()))
    return 0


def _signature(a, root: Path, settings) -> int:
    print(_study(a.study, str(root), _values(a.set)).signature())
    return 0


def _show(a, root: Path, settings) -> int:
    value = _study(a.study, str(root), _values(a.set)).load(a.stage)
    value.show(20) if hasattr(value, "show") else print(json.dumps(value, indent=1, ensure_ascii=False))
    return 0


def _cells(a, root: Path, settings) -> int:
    """Runs every cell of an experiment, after all have been checked; candidates that are the same study run once."""
    e = experiment.load(a.experiment)
    built = [(c, _study(e.study, str(root), c)) for c in e.cells()]
    marked = [(c, p, p.signature()) for c, p in built]
    first = search.distinct([{"at": i, "signature": s} for i, (_, _, s) in enumerate(marked)], lambda c: c["signature"])
    if getattr(a, "dry_run", False):
        for c, _, s in marked:
            print(json.dumps({"params": c, "signature": s[:12]}, default=str))
        return 0
    ran = []
    for c in first:
        cell, p, signature = marked[c["at"]]
        done = p.run(meta={"study": e.study, "params": cell})
        cost = e.search.cost(cell) if e.search else 0.0
        print(json.dumps({"params": cell, "signature": signature[:12], "built": sum(not r.reused for r in done.values()), "cost": cost}, default=str))
        ran.append((f"c{len(ran):03d}", cell, p, done, cost))
    if a.command == "search":
        _judge(a.experiment, root, e, ran)
    return 0


def _judge(path: Path, root: Path, e: experiment.Experiment, ran: list) -> None:
    """Judges the search itself: the best deflated, selection without hindsight, the probability of overfitting."""
    from .operators.judge import judged_search

    books = ran[0][2].books
    wanted = (e.search.objective or "").split(":")[0] if isinstance(e.search.objective, str) else ""
    head = next((b for b in books if b.stage == wanted), books[0] if books and not wanted else None)
    if head is None:
        print("not judged: the study names no book" + (f" {wanted}" if wanted else ""))
        return
    rows, sharpes, costs, table = [], {}, {}, []
    for name, cell, p, done, cost in ran:
        output = p.store.get(done[head.stage].output)
        sharpes[name], costs[name] = head.read(output)["sharpe"], cost
        rows += [(name, d, x) for d, x in head.series(output).items()]
        table.append({"candidate": name, "params": cell, "sharpe": sharpes[name], "sharpe_without_top5": runner.dig(output, head.sharpe.rpartition(".")[0] + ".sharpe_without_top5" if "." in head.sharpe else "sharpe_without_top5"), "cost": cost})
    series = _spark().createDataFrame(rows, "candidate string, date string, pnl double").selectExpr("candidate", "cast(date as date) as date", "pnl")
    verdict = judged_search(series, sharpes, head.periods, costs)
    record = {"experiment": str(path), "book": head.stage, "candidates": table, **verdict}
    out = root / "searches" / f"{time.strftime('%Y%m%dT%H%M%S')}-{e.search.seed}.json"
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(json.dumps(record, indent=1, default=str))
    d, s, o = verdict["deflated"], verdict["selection"], verdict["overfitting"]
    print(f"best {d['best']} {d['sharpe']:+.3f}, by luck {d['expected_by_luck']:+.3f} of {d['trials']}, probability {d['probability']:.3f}")
    print(f"selected without hindsight {s['sharpe']:+.3f} over {s['n_days']} dates, with hindsight {s['hindsight_sharpe'] or 0:+.3f}; overfitting {o['pbo']}")
    print(out)


def _rerun(a, root: Path, settings) -> int:
    """Runs a recorded run's study again from nothing, in a folder of its own, and compares every stage's output."""
    record = next((r for r in lines(root / "runs.jsonl") if r["run"] == a.run), None)
    if record is None or "meta" not in record:
        raise SystemExit(f"no record of how {a.run} was started")
    with tempfile.TemporaryDirectory() as folder:
        p = _study(record["meta"]["study"], folder, record["meta"]["params"])
        done = p.run(list(record["stages"]), charge=False)
    worst = 0
    for name, output in record["stages"].items():
        same = done[name].output == output
        moved = "" if done[name].key == record["keys"][name] else "\tkey moved: code, data, settings or libraries"
        print(f"{name}\t{'same' if same else 'differs'}{moved}")
        worst |= not same
    return int(worst)


def _runs(a, root: Path, settings) -> int:
    for r in lines(root / "runs.jsonl"):
        if a.run in (None, r["run"]):
            print(f"{r['run']}\t{len(r['stages'])} stages\t{r['signature'][:12]}\t{json.dumps(r.get('meta', {}))}")
            if a.run:
                print("\n".join(f"  {n}\t{ref}" for n, ref in r["stages"].items()))
    return 0


def _watch(a, root: Path, settings) -> int:
    """Prints the newest run's events until it ends (or, with --once, as far as it is)."""
    logs = sorted(root.glob("runs/*/events.jsonl"))
    if not logs:
        return 1
    at, seen = 0, []
    while True:
        fresh, at = runner.read_events(logs[-1], at)
        seen += fresh
        for e in fresh:
            print("\t".join(str(e[k]) for k in ("kind", "stage", "status", "name", "value", "text", "seconds") if k in e))
        state = runner.replay(seen)["status"]
        if a.once or state in ("ok", "failed"):
            return {"ok": 0, "running": 2}.get(state, 1)
        time.sleep(0.5)


def _report(a, root: Path, settings) -> int:
    print("\n".join(map(str, report.write_pages(root, a.out))))
    return 0


def _compare(a, root: Path, settings) -> int:
    found = report.compare(root, a.a, a.b)
    print("\n".join(f"{n}\t{x}" for n, x in found.items()))
    return int(any(x != "same" for x in found.values()))


def _alerts(a, root: Path, settings) -> int:
    deliver = report.Delivery(root, settings["alerts.sink"], settings["alerts.url"])
    sent = report.check_runs(root, deliver, time.time(), service.run_alive(root), settings["alerts.patience"])
    print("\n".join(f"{run}\t{what}" for run, what in sent))
    return 0


def _ledger(a, root: Path, settings) -> int:
    ledger = Ledger(root)
    print(f"{len(ledger.trials())} trials, {len(ledger.books())} books, holdout {'open' if ledger.opened() else 'sealed'}")
    return 0


def _holdout(a, root: Path, settings) -> int:
    print(Ledger(root).open_holdout(a.reason)["at"])
    return 0


def _config(a, root: Path, settings) -> int:
    if a.what == "init":
        place = Path("tidemark.toml")
        if place.exists():
            raise SystemExit(f"{place} is there already")
        place.write_text(config.starter())
    if a.what == "show":
        print("\n".join(f"{k} = {v!r}\t({settings.origin[k]})" for k, v in sorted(settings.values.items())))
    return 0  # check: loading the settings has refused what is wrong


def _status(a, root: Path, settings) -> int:
    logs = sorted(root.glob("runs/*/events.jsonl"))
    events = runner.read_events(logs[-1])[0] if logs else []
    state = runner.replay(events)
    if state["status"] == "running" and not service.alive(events):
        state["status"] = "died"
    print(json.dumps(state, ensure_ascii=False))
    return {"ok": 0, "running": 2}.get(state["status"], 1)


def _unit(a, root: Path, settings) -> int:
    print(service.unit([sys.executable, "-m", "tidemark", "--root", str(root), "run", a.study, *[x for s in a.set for x in ("--set", s)]], a.study, settings["alerts.patience"], str(Path.cwd())), end="")
    return 0


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__.split("\n")[0])
    parser.add_argument("--root", default=None)
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, do: Callable, *arguments: str, **options) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        s.set_defaults(do=do)
        for x in arguments:
            s.add_argument(x, **options.get(x, {}))
        return s

    for name, do in (("run", _run), ("plan", _plan), ("signature", _signature), ("show", _show), ("unit", _unit)):
        s = command(name, do, "study", *(["stage"] if name == "show" else []))
        s.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
        s.add_argument("--target", action="append")
    for name in ("sweep", "search"):
        command(name, _cells, "experiment", experiment={"type": Path}).add_argument("--dry-run", action="store_true")
    command("rerun", _rerun, "run")
    command("runs", _runs, "run", run={"nargs": "?"})
    command("log", _runs).set_defaults(run=None)
    command("watch", _watch).add_argument("--once", action="store_true")
    command("report", _report, "out", out={"type": Path})
    command("compare", _compare, "a", "b")
    command("config", _config, "what", what={"nargs": "?", "default": "show", "choices": ["show", "check", "init"]})
    command("holdout", _holdout, "reason")
    for name, do in (("ledger", _ledger), ("status", _status), ("alerts", _alerts)):
        command(name, do)
    a = parser.parse_args(args)
    settings = config.load([Path.home() / ".tidemark.toml", Path("tidemark.toml")], overrides={"paths.root": a.root} if a.root else None)
    return a.do(a, Path(settings["paths.root"]), settings)


if __name__ == "__main__":
    sys.exit(main())
