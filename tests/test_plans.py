import dataclasses
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.plans import identity, runner, search, store, toy
from tidemark.plans.runner import Outputs, Pipeline, Stage


def test_toy_study(spark, tmp_path):
    p = toy.study(tmp_path, spark)
    got = p.run()
    assert p.store.get(got["evaluate"].output) == {"days": 150, "ic_mean": 0.1072, "ic_t": 10.07}
    preds = p.load("fit")
    r = preds.agg(F.count("*"), F.sum("pred"), F.sum("y")).first()
    assert r[0] == 7500 and r[1:] == pytest.approx((4.90007752, 33.19066983), abs=1e-7)
    assert [tuple(f.values())[1:] for f in p.store.get(got["folds"].output)] == [(144, 150, 199), (194, 200, 249), (244, 250, 299)]
    assert all(r.reused for r in p.run().values()) and set(p.plan().values()) == {"hit"}
    wider = toy.study(tmp_path, spark, window=3).run()
    assert {n for n, r in wider.items() if not r.reused} == {"features", "dataset", "fit", "evaluate", "report"}
    assert len(p.ledger.trials()) == 2 and p.ledger.trials()[0]["headline"] == {"ic": 0.1072}
    logs = sorted(tmp_path.glob("runs/*/events.jsonl"))
    events, end = runner.read_events(logs[0])
    assert runner.replay(events)["status"] == "ok" and runner.read_events(logs[0], end) == ([], end)


def test_equal_output_stops_the_change(spark, tmp_path):
    def first(k):
        return [k % 2]

    def second(x):
        return {"x": x[0]}

    make = lambda k: Pipeline([Stage("a", first, spec=k), Stage("b", second, ("a",))], tmp_path, spark)
    make(1).run()
    again = make(3).run()
    assert not again["a"].reused and again["b"].reused
    assert make(2).plan() == {"a": "run", "b": "upstream"}


def test_side_outputs_failures_and_bad_graphs(spark, tmp_path):
    p = Pipeline([Stage("a", lambda: Outputs(1, {"s": [2]}), side=("s",)), Stage("b", lambda s: s[0], ("a.s",))], tmp_path, spark)
    got = p.run()
    assert p.store.get(got["b"].output) == 2
    with pytest.raises(ValueError, match="no such input"):
        Pipeline([Stage("a", lambda x: x, ("z",))], tmp_path, spark)
    with pytest.raises(ValueError, match="depend on each other"):
        Pipeline([Stage("a", lambda x: x, ("b",)), Stage("b", lambda x: x, ("a",))], tmp_path, spark)
    bad = Pipeline([Stage("a", lambda: {"x": float("nan")})], tmp_path / "bad", spark)
    with pytest.raises(ValueError, match=r"\$\.x"):
        bad.run()
    events, _ = runner.read_events(next((tmp_path / "bad").glob("runs/*/events.jsonl")))
    state = runner.replay(events)
    assert state["status"] == "failed" and runner.judge(state, 0, True, 0) == "failed"
    assert runner.judge({"status": "running"}, 0, False, 1) == "died" and runner.judge({"status": "running"}, 0, True, 9999) == "stalled"


def test_content_hash_ignores_layout(spark):
    df = spark.range(100).withColumn("x", F.col("id") / 7)
    h = identity.content_hash(df)
    assert identity.content_hash(df.repartition(5).orderBy(F.rand())) == h
    assert identity.content_hash(df.filter("id <> 3")) != h and identity.content_hash(df.select("x", "id")) != h


@dataclasses.dataclass(frozen=True)
class Spec:
    a: int = 1
    b: float = dataclasses.field(default=2.0, metadata={"added": True})


def test_added_fields_keep_identity():
    assert identity.canonical(Spec())["fields"] == {"a": 1} and identity.digest(Spec(b=3.0)) != identity.digest(Spec())
    for wrong in (float("nan"), object()):
        with pytest.raises((ValueError, TypeError)):
            identity.canonical(wrong)


@given(st.dictionaries(st.text(max_size=3), st.integers() | st.booleans() | st.text(max_size=3), max_size=5))
def test_order_of_a_mapping_is_no_identity(d):
    assert identity.digest(d) == identity.digest(dict(reversed(d.items())))


def test_ledger_opens_once(tmp_path):
    ledger = store.Ledger(tmp_path)
    assert ledger.charge("s", {"x": 1}) and not ledger.charge("s") and ledger.charge("s", kind="book")
    assert ledger.opened() is None
    ledger.open_holdout("final look")
    with pytest.raises(RuntimeError, match="opens once"):
        ledger.open_holdout("again")
    assert len(ledger.trials()) == len(ledger.books()) == 1


def test_a_source_without_a_fingerprint_always_runs(spark, tmp_path):
    path = str(tmp_path / "data")
    read = lambda: spark.read.parquet(path)

    def counted(rows):
        return {"n": rows.count()}

    p = lambda: Pipeline([Stage("source", read), Stage("count", counted, ("source",))], tmp_path / "store", spark)
    spark.range(3).write.parquet(path)
    p().run()
    assert p().plan() == {"source": "run", "count": "upstream"}
    same = p().run()
    assert not same["source"].reused and same["count"].reused
    spark.range(7).write.mode("overwrite").parquet(path)
    changed = p().run()
    assert not changed["count"].reused and p().load("count") == {"n": 7}
    told = Pipeline([Stage("source", read, fingerprint=lambda: "v1")], tmp_path / "told", spark)
    assert not told.run()["source"].reused and told.run()["source"].reused


def test_an_edited_operator_is_other_code(monkeypatch):
    """Code reached through a module, in a lambda, in an inner function and in a class belongs to a stage."""
    from tidemark.operators import models
    from tidemark.plans import study

    before = identity.code_digest(study._fit)
    monkeypatch.setattr(models, "check_predictions", lambda *a, **k: None)
    assert identity.code_digest(study._fit) != before
    monkeypatch.undo()
    assert identity.code_digest(study._fit) == before
    monkeypatch.setattr(study, "SHOWN", ("sharpe",))
    assert identity.code_digest(study._report) != identity.code_digest(study._fit)


def test_environment_and_code(spark, tmp_path):
    before = identity.environment(spark)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert identity.environment(spark) != before
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert identity.environment(spark) == before and "no commit" in identity.code_identity(tmp_path)


def test_stages_tell_metrics_and_progress(spark, tmp_path):
    def stage():
        runner.progress(0.5, "half way")
        runner.metric("ic", 0.2)
        runner.metric("odd", float("nan"))
        runner.warning("thin")
        return 1

    stage()  # outside a run nothing happens
    heard = []
    p = Pipeline([Stage("a", stage, source=False)], tmp_path, spark)
    p.run(listeners=[heard.append])
    events, _ = runner.read_events(next(tmp_path.glob("runs/*/events.jsonl")))
    state = runner.replay(events)
    assert state["metrics"] == {"ic": 0.2, "odd": None} and state["warnings"] == ["thin"] and state["progress"]["done"] == 0.5
    assert [e["kind"] for e in heard].count("metric") == 2
    assert p.run()["a"].reused and p.rebase(tmp_path / "else").plan() == {"a": "run"}


def test_search_space():
    raw = {"params": {"a": [1, 2, 3], "b": {"low": 0.1, "high": 10, "log": True}}, "budget": 10, "seed": 3, "complexity": {"a": {"3": 0.1}}}
    s = search.SearchSpace.parse(raw)
    got = s.candidates()
    assert len(got) == 10 and got == s.candidates() and all(0.1 <= c["b"] <= 10 for c in got) and s.cost({"a": 3}) == 0.1
    assert len(search.SearchSpace.parse({"params": {"a": [1, 2], "c": [3, 4]}, "sampler": "grid"}).candidates()) == 4
    for wrong in ({"nope": 1}, {"params": {"a": []}}, {"params": {"a": {"low": 1}}}, {"params": {"a": {"low": 1, "high": 2}}, "sampler": "grid"}):
        with pytest.raises(ValueError):
            search.SearchSpace.parse(wrong)
    assert search.sweep({"x": [1, 2], "y": [3, 4]}) == [{"x": 1, "y": 3}, {"x": 1, "y": 4}, {"x": 2, "y": 3}, {"x": 2, "y": 4}]
    assert search.distinct([{"a": 1}, {"a": -1}, {"a": 2}], lambda c: str(abs(c["a"]))) == [{"a": 1}, {"a": 2}]


def test_event_stream(spark, tmp_path):
    from tidemark.streaming.events import event_stream

    log = runner.Events(tmp_path / "runs" / "r1" / "events.jsonl")
    log("run_started", run="r1")
    log("metric", name="ic", value=0.1)
    q = event_stream(spark, str(tmp_path / "runs")).writeStream.format("memory").queryName("events_seen").start()
    q.processAllAvailable()
    q.stop()
    assert {r["kind"] for r in spark.table("events_seen").collect()} == {"run_started", "metric"}
    assert json.loads((tmp_path / "runs" / "r1" / "events.jsonl").read_text().split("\n")[1])["value"] == 0.1
