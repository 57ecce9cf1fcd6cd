import datetime as dt
import functools

import pytest
from pyspark.sql import functions as F

from tidemark.functions import cross_section as cs
from tidemark.operators import books, fitting, folds
from tidemark.plans import config, study
from tidemark.sources import twins


@pytest.fixture(scope="module")
def panel(spark):
    df = twins.to_spark(spark, twins.cross_section_frame(twins.CrossSection(names=40, dates=72, signals=(0.3,), noise_features=1)))
    return df.withColumns({"r_sig": cs.percentile_rank("f_sig0"), "r_noise": cs.percentile_rank("f_noise0"), "y_rank": cs.percentile_rank("y"), "y_z": cs.zscore("y")}).cache()


W = folds.WalkForward(start=dt.date(2012, 1, 1), first_test_year=2014, embargo=1)
STATS = study.Stats(12, 6, 200, 6, 3)


def cross(path, **how):
    fits = {"ridge": study.Model(study.FeatureSet(("r_sig", "r_noise")), fitting.Fit(options={"alpha": how.pop("alpha", 0.1)})), "sign": study.Model(study.FeatureSet(("r_sig",)), fitting.Fit("composite"))}
    told = {"sources": {"panel": study.Source(functools.partial(_reload, path), fingerprint=lambda: "twin")}, "index": "panel", "schedule": W, "models": fits, "ensembles": {"both": study.Ensemble({"ridge": 0.5, "sign": 0.5})}, "book": study.CrossSectionBook("panel", 0.2), "stats": STATS}
    return study.Study(**told | how)


@pytest.fixture(scope="module")
def path(spark, panel, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("panel") / "panel")
    panel.write.parquet(at)
    return at


def test_stages_are_one_for_each_declared_piece(path):
    each = lambda n: [f"book_{n}", f"paths_{n}", f"eval_{n}"]
    assert [x.name for x in cross(path).stages()] == ["panel", "folds", "fit_ridge", "fit_sign", "ens_both", *each("ridge"), *each("sign"), *each("both"), "power", "report"]
    assert "report" not in {x.name for x in cross(path, evaluate=()).stages()}


def test_cross_section_study(spark, path, tmp_path):
    p = cross(path).pipeline(tmp_path, spark)
    got = p.run()
    report, result = p.load("report"), p.load("eval_ridge")
    assert set(report["books"]) == {"ridge", "sign", "both"} and report["books"]["ridge"]["sharpe"] > 1 and not any(r.reused for r in got.values())
    assert result["ic_by_date"]["t_nw"] > 3 and len(result["ic"]["by_year"]) >= 3 and result["ic"]["worst"] <= result["ic"]["mean"]
    assert result["ls"]["n_years"] >= result["ls"]["years_pos"] >= 3 and len(result["ls"]["daily"]) == result["ls"]["n"]
    assert report["models"]["ridge"]["inputs"]["r_sig"]["sign_agreement"] == 1 and report["power"]["panel"]["mde_ic"] > 0
    assert {m["input"] for m in p.load("fit_ridge.models")} == {"r_sig", "r_noise"}
    assert [(b["headline"]["stage"], b["headline"]["family"]) for b in p.ledger.books()] == [(f"eval_{n}", "long-short") for n in ("ridge", "sign", "both")]
    assert all(r.reused for r in cross(path).pipeline(tmp_path, spark).run().values())
    again = cross(path, alpha=0.5).pipeline(tmp_path, spark).run()
    ran = {n for n, r in again.items() if not r.reused}
    assert "fit_ridge" in ran and ran <= {"fit_ridge", "ens_both", "report"} | {f"{s}_{n}" for s in ("book", "paths", "eval") for n in ("ridge", "both")}


def test_pool_book_with_paths_of_its_own(spark, path, tmp_path):
    def paths(positions, panel):
        assert "y_z" in panel.columns
        return books.one_period_paths(positions.filter("side is not null"))

    book = study.CrossSectionBook("panel", 0.2, pool_days=62, min_pool=60, paths=paths, paths_inputs=("panel",), per_position=True, min_live=5, end=dt.date(2016, 12, 31))
    s = cross(path, book=book, evaluate=("ridge",), ensembles={}, power=None)
    assert next(x for x in s.stages() if x.name == "paths_ridge").inputs == ("book_ridge", "panel")
    p = s.pipeline(tmp_path, spark)
    p.run()
    result = p.load("eval_ridge")
    assert result["least_live"] >= 5 and result["ls"]["daily"][-1]["date"] <= "2016-12-31" and "all_rows" in result["ic"]


def _series():
    from pyspark.sql import SparkSession

    return twins.to_spark(SparkSession.getActiveSession(), twins.time_series_frame(twins.TimeSeries(days=1300, beta=(0.2,))))


def test_time_series_study(spark, tmp_path):
    fit = fitting.Fit(target="y", rank_target="y", cross_section=False, options={"intercept": True})
    book = study.TimeSeriesBook("twin", short_or_flat=True, constants=(("hold", 1.0),), benchmark="hold")
    s = study.Study({"twin": study.Source(_series, fingerprint=lambda: "s")}, "twin", folds.WalkForward(start=dt.date(2012, 1, 1), first_test_year=2014, mode="expanding", embargo=1, entry="date"),
                    {"r": study.Model(study.FeatureSet(("x_sig0", "x_noise0")), fit)}, book, keys=("date",), stats=study.Stats(draws=200))
    assert [x.name for x in s.stages()] == ["twin", "folds", "fit_r", "eval_r", "eval_baselines", "active_r", "power", "report"]
    p = s.pipeline(tmp_path, spark)
    p.run()
    shown, active, mine, held = p.load("report")["books"], p.load("active_r"), p.load("eval_r"), p.load("eval_baselines")
    assert set(shown) == {"r", "r_short_or_flat", "hold"} and shown["hold"]["vs_hold"]["d_sharpe"] == 0 and shown["r"]["vs_hold"]["d_sharpe"] > 0
    day = active["daily"][0]["date"]
    at = lambda b: next(d["pnl"] for d in b["daily"] if d["date"] == day)
    assert active["benchmark"] == "hold" and active["daily"][0]["pnl"] == pytest.approx(at(mine["book"]) - at(held["hold"]), abs=1e-15)
    assert mine["short_or_flat"]["share_short"] <= 1 and p.load("power")["mde_sharpe"] > 0 and p.ledger.books()[0]["headline"]["family"] == "active over hold"


def _trades():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().createDataFrame(twins.paths_frame(twins.Paths(days=900, stop=3.0)))


def _marks(twin):
    return twin.select("t0", "date", "pnl")


def _days(twin):
    return twin.select("date").distinct()


def _some_days(twin):
    return _days(twin).filter("date <> date '2017-03-15'")


def _entries(twin):
    return twins.path_entries(twin).withColumn("w_half", F.lit(0.5))


@pytest.mark.parametrize("whole", [True, False])
def test_path_study(spark, tmp_path, whole):
    fit = fitting.Fit(target="y", rank_target="y", cross_section=False, options={"intercept": True, "alpha": 0.01})
    sources = {"twin": study.Source(_trades, fingerprint=lambda: "s"), "trades": study.Source(_marks, ("twin",)), "calendar": study.Source(_days if whole else _some_days, ("twin",)), "panel": study.Source(_entries, ("twin",))}
    s = study.Study(sources, "panel", folds.WalkForward(start=dt.date(2014, 1, 1), first_test_year=2016, embargo=21), {"ridge": study.Model(study.FeatureSet(("x_sig", "x_noise0")), fit)},
                    study.PathBook("trades", "calendar", "panel", baselines_=(("half", "w_half"),), flag="stopped"), keys=("t0",), stats=study.Stats(draws=200), power=None)
    p = s.pipeline(tmp_path, spark)
    if not whole:
        with pytest.raises(ValueError, match="not on the calendar"):
            p.run()
        return
    p.run()
    got, per = p.load("eval_ridge"), p.load("eval_ridge.trades")
    assert {"book", "constant", "half", "vs_constant", "vs_half", "active", "sizing"} <= set(got)
    assert got["sizing"]["rank_ic"] > 0.1 and got["book"]["n"] == got["constant"]["n"] == got["active"]["n"]
    assert abs(got["half"]["sharpe"] - got["constant"]["sharpe"]) < 1e-9 and 0 < got["sizing"]["share_flagged"] < 1
    assert per.columns == ["t0", "pred", "w", "y", "stopped"] and abs(per.agg(F.avg("w")).first()[0] - 1) < 0.2
    assert {"ridge", "ridge_active", "constant", "half"} == set(p.load("report")["books"])
    assert [(b["headline"]["stage"], b["headline"]["family"]) for b in p.ledger.books()] == [("eval_ridge", "gain over constant")]


def test_selection_and_transforms_inside_folds(spark, panel):
    rows = folds.dealt(panel, folds.collected(folds.make_folds(panel, W), W), W).withColumns({"r_b": F.col("r_sig") + 0.01 * F.col("r_noise"), "r_c": F.col("r_sig") - 0.01 * F.col("r_noise")}).cache()
    features = ["r_sig", "r_b", "r_c", "r_noise"]
    preds, held = fitting.fit_walk_forward(rows, features, fitting.Fit(selection=fitting.Clusters(singleton_ir=99.0)))
    by = {}
    for r in held.collect():
        by.setdefault(r["fold"], []).append(r["input"])
    assert all(len(v) == 1 and v[0] != "r_noise" for v in by.values()) and set(by) == {r[0] for r in rows.select("fold").distinct().collect()}
    assert preds.count() == rows.count()
    chain = (fitting.Winsorize(0.05), fitting.Interactions(2), fitting.Components(2, keep_inputs=False))
    preds, held = fitting.fit_walk_forward(rows, ["r_sig", "r_noise"], fitting.Fit(transforms=chain, keep_train=False))
    assert {r["input"] for r in held.collect()} == {"pc1", "pc2"} and preds.filter("is_train").count() == 0
    names = fitting.applied(rows, ["r_sig", "r_noise"], (fitting.Components(1, keep_inputs=True),), "y_z")[1]
    assert names == ["r_sig", "r_noise", "pc1"]
    with pytest.raises(ValueError, match="no feature"):
        fitting.fit_walk_forward(rows, ["r_noise"], fitting.Fit(selection=fitting.Clusters(singleton_ir=99.0)))
    with pytest.raises(ValueError, match="no such model"):
        fitting.fit_walk_forward(rows, ["r_noise"], fitting.Fit("nope"))
    assert study.FeatureSet(exclude=("t0",)).of(rows.select("t0", "r_b")) == ["r_b"]
    with pytest.raises(KeyError, match="zz"):
        study.FeatureSet(("zz",)).of(rows)


def test_fold_tables_as_json(spark, panel):
    table = folds.check_folds(panel, folds.collected(folds.make_folds(panel, W), W), W)
    rows = study.fold_table(table)
    assert rows[0]["test_start"].startswith("2014-") and sorted(study.folds_from(spark, rows).collect()) == sorted(table.collect())


def _reload(path):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().read.parquet(path)


def test_twins(spark):
    ts = twins.time_series_frame(twins.TimeSeries(days=1500, beta=(0.2,)))
    assert ts["x_sig0"].corr(ts["r_next"]) > 0.1 and abs(ts["x_noise0"].corr(ts["r_next"])) < 0.1
    paths = spark.createDataFrame(twins.paths_frame(twins.Paths(days=60, stop=2.0)))
    entries = twins.path_entries(paths)
    assert entries.count() == 60 and entries.filter("stopped and y >= -2").count() == 0 and entries.filter("not stopped and exit_date <> expiry").count() == 0


def test_planted_signal_is_found_and_noise_is_not(spark):
    rates = {(r["ic"], r["feature"]): r["rate"] for r in twins.detection_rates(spark, twins.CrossSection(names=60, dates=40), [0.0, 0.2], seeds=6).collect()}
    assert rates[0.2, "signal"] > 0.9 and max(rates[0.2, "noise"], rates[0.0, "signal"], rates[0.0, "noise"]) <= 0.34
    assert len(rates) == 4
    curve = {r["ic"]: r for r in twins.power_curve(spark, {"small": twins.CrossSection(names=60, dates=40)}, [0.0, 0.3], seeds=4).collect()}
    assert curve[0.3]["power"] == curve[0.3]["decile_power"] == 1 and max(curve[0.0]["power"], curve[0.0]["decile_power"], curve[0.3]["false_positives"]) <= 0.5


def test_config_layers(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('[compute]\nworkers = 3\n[profile.big.compute]\nworkers = 9\n[paths]\ndata = "${HOME}/d"\n')
    r = config.load([f], "big", {"TIDEMARK_ALERTS__SINK": "stdout", "HOME": "/h"}, {"compute.master": "local[2]"})
    assert r["compute.workers"] == 9 and r.origin["compute.workers"].endswith("[big]") and r["alerts.sink"] == "stdout" and r.origin["compute.master"] == "command line"
    for bad in ({"nope": 1}, {"compute.workers": "x"}, {"alerts.sink": "email"}):
        with pytest.raises(ValueError):
            config.load([], None, {}, bad)
