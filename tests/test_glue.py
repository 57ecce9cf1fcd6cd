import datetime as dt
import json

import pytest

from tidemark import __main__ as cli
from tidemark.plans import experiment, report, store
from tidemark.sources import refs


def test_refs(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("x")
    ref, roots, cache = refs.DataRef("here", "d"), {"here": str(tmp_path)}, refs.StatCache(tmp_path / "stat.jsonl")
    h = ref.fingerprint(roots, cache)
    assert ref.fingerprint(roots) == h == refs.DataRef("here", "d").fingerprint(roots, refs.StatCache(tmp_path / "stat.jsonl"))
    (tmp_path / "d" / ".hidden").write_text("y")
    assert ref.fingerprint(roots) == h
    (tmp_path / "d" / "a.txt").write_text("z!")
    assert ref.fingerprint(roots, cache) != h and refs.fingerprint_of([ref], roots) != refs.fingerprint_of([], roots)
    with pytest.raises(KeyError, match="no data root"):
        refs.DataRef("there").path(roots)


def factory(root, spark, window: int = 1, ic: float = 0.1, start: dt.date = dt.date(2020, 1, 1), tags: list[str] | None = None):
    return window, ic, start, tags


def test_experiments(tmp_path):
    f = tmp_path / "e.toml"
    f.write_text('study = "m:f"\n[params]\nic = 0.2\n[sweep]\nwindow = [1, 3]\n')
    assert experiment.load(f).cells() == [{"ic": 0.2, "window": 1}, {"ic": 0.2, "window": 3}]
    assert experiment.checked(factory, {"ic": 1, "start": "2021-02-03", "tags": ["a"]}) == {"ic": 1.0, "start": dt.date(2021, 2, 3), "tags": ["a"]}
    for bad in ({"nope": 1}, {"window": 1.5}, {"window": True}, {"tags": [1]}):
        with pytest.raises((ValueError, TypeError)):
            experiment.checked(factory, bad)
    f.write_text("x = 1")
    with pytest.raises(ValueError, match="unknown"):
        experiment.load(f)


def test_command_line(spark, tmp_path, capsys):
    root, e = str(tmp_path / "r"), tmp_path / "e.toml"
    e.write_text('study = "tidemark.plans.toy:study"\n[sweep]\nwindow = [1, 2, 1]\n')
    assert cli.main(["--root", root, "sweep", str(e)]) == 0
    cells = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [c["built"] for c in cells] == [7, 5]
    assert cli.main(["--root", root, "status"]) == 0 and cli.main(["--root", root, "ledger"]) == 0
    assert "2 trials" in capsys.readouterr().out
    runs = [r["run"] for r in store.lines(tmp_path / "r" / "runs.jsonl")]
    assert cli.main(["--root", root, "compare", *runs]) == 1
    assert "evaluate\tdiffers" in capsys.readouterr().out
    assert cli.main(["--root", root, "report", str(tmp_path / "html")]) == 0 and (tmp_path / "html" / "index.html").exists()
    assert cli.main(["--root", root, "plan", "tidemark.plans.toy:study", "--set", "window=2"]) == 0
    assert "run" not in capsys.readouterr().out.split("\n")[-2]
    assert cli.main(["--root", root, "holdout", "done"]) == 0 and cli.main(["--root", root, "alerts"]) == 0


def one(root, spark, lift: float = 0.0, seed: int = 1):
    """A study of one book, whose mean daily result is lift."""
    import numpy as np

    from tidemark.plans.runner import Headline, Pipeline, Stage

    def book(how):
        x = np.random.default_rng(how[1]).normal(how[0], 1, 400)
        days = [str(dt.date(2018, 1, 1) + dt.timedelta(days=3 * i)) for i in range(400)]
        return {"ls": {"sharpe": float(x.mean() / x.std() * 120**0.5), "n": 400, "sharpe_without_top5": 0.0, "daily": [{"date": d, "pnl": float(v)} for d, v in zip(days, x, strict=True)]}}

    return Pipeline([Stage("eval_a", book, spec=(lift, seed), source=False)], root, spark, books=[Headline("eval_a", "ls.sharpe", "ls.n", "ls.daily", periods=120)])


def test_a_search_is_judged(spark, tmp_path, capsys):
    root, e = str(tmp_path / "r"), tmp_path / "e.toml"
    e.write_text('study = "tests.test_glue:one"\n[search]\nsampler = "grid"\nbudget = 0\n[search.params]\nlift = [0.0, 0.4]\nseed = [1, 2, 3]\n[search.complexity.lift]\n"0.4" = 0.05\n')
    assert cli.main(["--root", root, "search", str(e), "--dry-run"]) == 0 and capsys.readouterr().out.count("signature") == 6
    assert cli.main(["--root", root, "search", str(e)]) == 0
    said = capsys.readouterr().out
    assert "best c00" in said and "overfitting" in said
    record = json.loads(next((tmp_path / "r" / "searches").glob("*.json")).read_text())
    assert record["deflated"]["probability"] > 0.95 and record["overfitting"]["pbo"] < 0.3 and len(record["candidates"]) == 6 and record["candidates"][-1]["cost"] == 0.05
    assert len(store.Ledger(tmp_path / "r").books()) == 6


def test_runs_are_shown_watched_and_run_again(spark, tmp_path, capsys, monkeypatch):
    root = str(tmp_path / "r")
    assert cli.main(["--root", root, "run", "tidemark.plans.toy:study", "--set", "window=2"]) == 0
    run = store.lines(tmp_path / "r" / "runs.jsonl")[0]["run"]
    capsys.readouterr()
    assert cli.main(["--root", root, "rerun", run]) == 0 and "differs" not in capsys.readouterr().out
    assert cli.main(["--root", root, "runs", run]) == 0 and '"window": 2' in capsys.readouterr().out
    assert cli.main(["--root", root, "watch", "--once"]) == 0 and "run_finished" in capsys.readouterr().out
    assert cli.main(["--root", root, "unit", "m:f"]) == 0 and "WatchdogSec" in capsys.readouterr().out
    monkeypatch.chdir(tmp_path)
    assert cli.main(["--root", root, "config", "init"]) == 0 and cli.main(["--root", root, "config", "check"]) == 0 and (tmp_path / "tidemark.toml").exists()


def test_a_dead_run_is_seen(tmp_path):
    import os
    import socket
    import subprocess
    import sys

    from tidemark.plans import service

    gone = subprocess.Popen([sys.executable, "-c", ""])
    gone.wait()
    began = {"kind": "run_started", "at": 0.0, "host": socket.gethostname()}
    assert service.alive([began | {"pid": os.getpid()}]) and not service.alive([began | {"pid": gone.pid}]) and service.alive([began | {"pid": gone.pid, "host": "elsewhere"}])
    store.append(tmp_path / "runs" / "r1" / "events.jsonl", began | {"pid": gone.pid})
    assert report.check_runs(tmp_path, report.Delivery(tmp_path), 1.0, service.run_alive(tmp_path)) == [("r1", "died")]
    said = []
    beat = service.Heartbeat(said.append, iter([0, 0, 0.1, 5, 5]).__next__)
    for e in ({"kind": "run_started"}, {"kind": "stage", "stage": "a", "status": "running"}, {"kind": "metric"}):
        beat(e)
    assert said == ["READY=1", "WATCHDOG=1", "STATUS=a running", "WATCHDOG=1"]


def test_alerts_are_sent_once(tmp_path):
    sent = []
    deliver = report.Delivery(tmp_path, "webhook", "u", lambda url, body: sent.append((url, json.loads(body))))
    store.append(tmp_path / "runs" / "r1" / "events.jsonl", {"kind": "run_started", "at": 0.0})
    check = lambda: report.check_runs(tmp_path, deliver, 10_000, lambda run: True)
    assert check() == [("r1", "stalled")] and check() == [] and len(sent) == 1
    with pytest.raises(ValueError, match="no such sink"):
        report.Delivery(tmp_path, "email")


def test_guard(spark, tmp_path):
    ledger = store.Ledger(tmp_path)
    rows = spark.createDataFrame([(dt.date(2020, 1, d), dt.date(2020, 1, d + 5)) for d in range(1, 21)], "t0 date, horizon date")
    seal = dt.date(2020, 1, 11)
    fingerprint = store.with_holdout(lambda: "data", ledger)
    before = fingerprint()
    assert store.guard(rows, ledger, seal).count() == 10 and store.guard(rows, ledger, seal, horizon="horizon").count() == 5
    ledger.open_holdout("look")
    assert store.guard(rows, ledger, seal).count() == 20 and store.guard(rows, ledger, seal, horizon="horizon").count() == 15 and fingerprint() != before
