import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import books, folds, judge, models, selection, transforms

D = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(400)]


@pytest.fixture(scope="module")
def index(spark):
    days = [d for d in (dt.date(2016, 1, 4) + dt.timedelta(days=i) for i in range(2915)) if d.weekday() < 5 and d.year <= 2023]
    rows = [(n, d, d + dt.timedelta(days=21), d.year) for d in days for n in ("A", "B", "C")]
    return spark.createDataFrame(rows, "root string, t0 date, exit_date date, y_year int").cache()


W = folds.WalkForward(start=dt.date(2016, 1, 4), first_test_year=2017, last_test_year=2023, end=dt.date(2023, 12, 31))


def test_folds(index):
    made = folds.collected(folds.make_folds(index, W), W)
    table = sorted(folds.check_folds(index, made, W, ("root", "t0")).collect(), key=lambda r: r["fold"])
    assert [r["fold"] for r in table] == list(range(2017, 2024))
    assert [r["mode"] for r in table] == ["expanding"] * 4 + ["rolling"] * 3
    assert table[4]["train_start"] == dt.date(2017, 1, 1) and table[6]["train_start"] == dt.date(2019, 1, 1)
    assert min(r["gap_td"] for r in table) == 21


def test_no_room_for_the_embargo(index):
    w = folds.WalkForward(start=dt.date(2016, 12, 20), first_test_year=2017, last_test_year=2017, embargo=21)
    with pytest.raises(ValueError, match="fewer than 21"):
        folds.collected(folds.make_folds(index, w), w)


@pytest.fixture(scope="module")
def fit_rows(spark):
    rng = np.random.default_rng(5)
    rows = []
    for fold in (1, 2):
        for i in range(300):
            x = rng.normal(size=3)
            rows.append((fold, i % 25, i, i < 200, *[float(v) for v in x], float(x[0] - 0.5 * x[1] + rng.normal()) if i % 11 else None))
    return spark.createDataFrame(rows, "fold int, t0 int, root int, is_train boolean, a double, b double, c double, y double").cache()


def _train(fit_rows, fold):
    rows = [r for r in fit_rows.collect() if r["fold"] == fold and r["is_train"] and r["y"] is not None]
    return np.array([[r["a"], r["b"], r["c"]] for r in rows]), np.array([r["y"] for r in rows])


@pytest.mark.parametrize("prior", [None, {"a": 1.0, "b": -1.0}])
def test_ridge_against_numpy(fit_rows, prior):
    model = models.ridge(fit_rows, ["a", "b", "c"], "y", 0.3, True, prior)
    for fold in (1, 2):
        x, y = _train(fit_rows, fold)
        sd = x.std(0) + 1e-9
        z, yc = (x - x.mean(0)) / sd, y - y.mean()
        w0 = np.zeros(3)
        if prior:
            d = np.array([1.0, -1.0, 0.0])
            w0 = d * ((z @ d) @ yc) / ((z @ d) @ (z @ d))
        lam = 0.3 * len(y)
        want = np.linalg.solve(z.T @ z + lam * np.eye(3), z.T @ yc + lam * w0)
        assert model.folds[fold][2] == pytest.approx(want, abs=1e-9)
    out = model.predict(fit_rows).collect()
    mu, sd, w, c = model.folds[1]
    r = next(r for r in out if r["fold"] == 1)
    assert r["pred"] == pytest.approx(float((np.array([r["a"], r["b"], r["c"]]) - mu) / sd @ w + c))


def test_composite(fit_rows):
    model = models.composite(fit_rows, ["a", "b", "c"], "y", signs={"c": -2.0})
    for fold in (1, 2):
        assert model.folds[fold][2] == pytest.approx([1 / 3, -1 / 3, -1 / 3])


def test_rule_against_numpy(fit_rows):
    got = {r["fold"]: r for r in models.rule(fit_rows, ["a", "b"], "y", position=1.0).collect()}
    for fold in (1, 2):
        x, y = _train(fit_rows, fold)
        best = None
        for j in range(2):
            for q in models.QUANTILES:
                t = np.quantile(x[:, j], q)
                for above in (True, False):
                    on = x[:, j] > t if above else x[:, j] < t
                    if on.mean() >= 0.2:
                        p = np.where(on, y, 0.0)
                        s = p.mean() / p.std(ddof=1) * math.sqrt(252)
                        if best is None or s > best[0] + 1e-12:
                            best = (s, j, t, above)
        always = y.mean() / y.std(ddof=1) * math.sqrt(252)
        r = got[fold]
        assert (r["best"], r["always"]) == pytest.approx((best[0], always))
        assert (r["input"], r["threshold"], r["above"]) == (best[1], pytest.approx(best[2]), best[3])


def test_transforms(spark, fit_rows):
    rows = spark.createDataFrame([(1, True, float(i)) for i in range(101)] + [(1, False, v) for v in (-50.0, 50.0, 500.0)], "fold int, is_train boolean, x double")
    assert sorted(r["x"] for r in transforms.winsorize(rows, ["x"], 0.1).filter("not is_train").collect()) == [10, 50, 90]
    out = transforms.interactions(fit_rows, ["a", "b", "c"], "y", top=2)
    assert out.agg(F.count("`a×b`"), F.count("`a×c`"), F.count("`b×c`")).first()[:] == (600, 0, 0)
    scored, loadings = transforms.pca(fit_rows, ["a", "b", "c"], "y", k=3)
    for fold in (1, 2):
        x, _ = _train(fit_rows, fold)
        z = (x - x.mean(0)) / (x.std(0) + 1e-9)
        v = np.linalg.svd(z, full_matrices=False)[2]
        got = np.array([[r["loading"] for r in sorted(loadings.filter(f"fold={fold} and component={k}").collect(), key=lambda r: r["input"])] for k in (1, 2, 3)])
        assert np.abs(got) == pytest.approx(np.abs(v), abs=1e-6)
        assert all(row[np.abs(row).argmax()] > 0 for row in got)
    assert {"pc1", "pc2", "pc3"} <= set(scored.columns)


def test_linkage():
    d = np.array([[0, 0.1, 0.2, 0.9], [0.1, 0, 0.3, 0.9], [0.2, 0.3, 0, 0.9], [0.9, 0.9, 0.9, 0]])
    assert selection.average_linkage(d, 0.4) == [[0, 1, 2], [3]]
    assert selection.average_linkage(d, 0.2) == [[0, 1], [2], [3]]


def test_constant_prediction(fit_rows):
    flat = fit_rows.withColumn("pred", F.lit(1.0))
    with pytest.raises(AssertionError, match="constant"):
        models.check_predictions(flat)
    with pytest.raises(AssertionError, match="cross_section=False"):
        models.check_predictions(flat.withColumn("t0", F.col("root")))


def test_signal_book(spark):
    ret = spark.createDataFrame(list(zip(D, [0.01, -0.02, 0.03, 0.0, 0.01])), "date date, r_next double")
    sd1 = [-1.0, 0.0, 1.0]
    preds = spark.createDataFrame([(D[i], p, 1, False) for i, p in enumerate([2.0, -0.5, 0.5, 0.0, -3.0])] + [(D[100 + i], p, 1, True) for i, p in enumerate(sd1)], "date date, pred double, fold int, is_train boolean")
    rows = books.signal_book(preds, ret, cost=0.001).orderBy("date").collect()
    assert [r["position"] for r in rows] == pytest.approx([1, -0.5, 0.5, 0, -1])
    assert [r["turnover"] for r in rows] == pytest.approx([1, 1.5, 1, 0.5, 1])
    assert [r["pnl"] for r in rows] == pytest.approx([0.009, 0.0085, 0.014, -0.0005, -0.011])
    assert [r["position"] for r in books.signal_book(preds, ret, kind="sign").orderBy("date").collect()] == [1, -1, 1, 0, -1]
    ruled = ret.withColumn("p", F.element_at(F.array(*[F.lit(v) for v in (-2.0, -0.5, 0.0, None, 1.0)]), F.datediff("date", F.lit(D[0])) + 1))
    assert [r["position"] for r in books.rule_book(ruled, "p", D[0], D[4], short_only=True).orderBy("date").collect()] == [-1, -0.5, 0, 0, 0]


def test_quantile_and_pool_books(spark):
    names = [(f"N{i}", D[0], float(i)) for i in range(21)] + [("X", D[0], 999.0)]
    preds = spark.createDataFrame(names, "root string, t0 date, pred double")
    frame = preds.select("root", "t0", (F.col("root") != "X").alias("eligible"))
    rows = books.quantile_book(preds, frame, q=0.1).collect()
    assert {r["root"] for r in rows if r["side"] == "long"} == {"N18", "N19", "N20"} and {r["root"] for r in rows if r["side"] == "short"} == {"N0", "N1", "N2"}
    assert {r["n_eligible"] for r in rows} == {21} and max(r["decile"] for r in rows) == 9
    dates = [dt.date(2020, 1, 1), dt.date(2020, 1, 1), dt.date(2020, 1, 5), dt.date(2020, 3, 1), dt.date(2020, 3, 1)]
    pool = spark.createDataFrame(list(zip(range(5), dates, [1.0, 3.0, 2.0, 5.0, 0.0])), "i int, t0 date, pred double")
    pct = lambda days: [r["pct"] for r in books.trailing_pct(pool, pool_days=days, min_pool=2).orderBy("i").collect()]
    assert pct(10) == [None, None, 0.5, None, None] and pct(90) == [None, None, 0.5, 1.0, 0.0]


def test_paths(spark):
    trades = spark.createDataFrame([(D[0], D[0], -1.0), (D[0], D[1], 1.0), (D[0], D[2], 5.0), (D[1], D[1], 0.0), (D[1], D[2], -4.0)], "t0 date, date date, pnl double")
    weights = spark.createDataFrame([(D[0], 0.5), (D[1], 2.0)], "t0 date, w double")
    days = books.path_pnl(trades, weights, scale=10)
    assert {r["date"]: r["pnl"] for r in days.collect()} == {D[0]: -5.0, D[1]: 10.0, D[2]: 20.0 - 80.0}
    assert {r["t0"]: r["y"] for r in books.final_pnl(trades, scale=10).collect()} == {D[0]: 50.0, D[1]: -40.0}
    book = spark.createDataFrame([(D[1], 1.0), (D[3], 2.0)], "date date, pnl double")
    cal = spark.createDataFrame([(d,) for d in D[:5]], "date date")
    assert [r["pnl"] for r in books.on_calendar(book, cal, D[0], D[4]).orderBy("date").collect()] == [0, 1, 0, 2, 0]
    with pytest.raises(ValueError, match="not on the calendar"):
        books.on_calendar(book, cal.filter(F.col("date") != F.lit(D[3])), D[0], D[4])


def test_sizes_against_a_loop(spark):
    rng = np.random.default_rng(9)
    rows = [(D[i], float(rng.normal()), 1 + i // 30, i % 30 < 18) for i in range(60)]
    preds = spark.createDataFrame(rows, "t0 date, pred double, fold int, is_train boolean")
    for rule in ("rank", "tercile", "inverse", "direct", "constant"):
        got = {r["t0"]: r["w"] for r in books.sizes(preds, rule).collect()}
        past = []
        for fold in (1, 2):
            train = [r[1] for r in rows if r[2] == fold and r[3]]
            own = []
            for r in (r for r in rows if r[2] == fold and not r[3]):
                h = train + (own if rule == "direct" else past)
                share, med, up = np.mean(np.array(h) < r[1]), np.median(h), np.mean(np.maximum(h, 0))
                w = {"rank": 2 * share, "tercile": float(np.select([share < 1 / 3, share < 2 / 3], [0, 1], 2)), "constant": 1.0,
                     "inverse": float(np.clip(med / r[1], 0, 2)) if r[1] > 0 and med > 0 else 1.0, "direct": min(max(r[1], 0) / (up if up > 0 else 1), 2)}[rule]
                assert got[r[0]] == pytest.approx(w), rule
                own.append(r[1])
                past.append(r[1])


def test_daily_book(spark):
    positions = spark.createDataFrame([("a", 0, "long"), ("b", 0, "short"), ("c", 0, None)], "root string, t0 int, side string")
    paths = spark.createDataFrame([("a", 0, D[0], 0.0), ("a", 0, D[1], 1.0), ("a", 0, D[2], 3.0), ("b", 0, D[0], 5.0), ("b", 0, D[1], 4.0), ("b", 0, D[2], 4.0), ("c", 0, D[0], 9.0)], "root string, t0 int, date date, pnl double")
    rows = books.daily_book(positions, paths).orderBy("date").collect()
    assert [r["long"] for r in rows] == [0, 1, 2] and [r["short"] for r in rows] == [0, -1, 0] and [r["ls"] for r in rows] == [0, 2, 2] and [r["n_long"] for r in rows] == [1, 1, 1]


def test_series_statistics(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0.01, 1, 300)
    s = spark.createDataFrame([("s", D[i], float(v)) for i, v in enumerate(x)], "candidate string, date date, pnl double")
    r = judge.series_stats(s, ["candidate"]).first()
    cum = np.cumsum(x)
    assert r["sharpe"] == pytest.approx(x.mean() / x.std(ddof=1) * math.sqrt(252)) and r["max_drawdown"] == pytest.approx((cum - np.maximum.accumulate(cum)).min())
    assert r["top5_share"] == pytest.approx(np.sort(x)[-5:].sum() / x.sum())
    m = judge.moments(s, ["candidate"]).first()
    d = x - x.mean()
    assert (m["skew"], m["kurt"]) == pytest.approx(((d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2))
    v = judge.newey_west_variance(s, "pnl", "date", 3).first()
    want = d @ d / 300 + sum(2 * (1 - k / 4) * (d[k:] @ d[:-k]) / 300 for k in (1, 2, 3))
    assert v["lrv"] == pytest.approx(want)


def test_scalars():
    assert judge.mde_sharpe(5) == pytest.approx(3.418 / math.sqrt(5), abs=1e-3) and judge.mde_ic(0.15, 60) == pytest.approx(3.418 * 0.15 / math.sqrt(60), abs=1e-3)
    assert judge.deflated_sharpe([1.0], 1000).probability == pytest.approx(0.9766, abs=5e-4)
    assert judge.bootstrap(np.ones(50) + np.arange(50) % 2)["p_mean_le_0"] == 0
    with pytest.raises(ValueError, match="fewer than a block"):
        judge.bootstrap(np.arange(5.0))


def test_attribution(spark):
    half = spark.createDataFrame([(d, (i % 7) / 2, float(i % 7)) for i, d in enumerate(D[:40])], "date date, y double, m double")
    got = {r["term"]: r for r in judge.attribution(half, "y", ["m"]).collect()}
    assert (got["alpha"]["coef"], got["m"]["coef"], got["m"]["r2"]) == pytest.approx((0, 0.5, 1), abs=1e-12)
    rng = np.random.default_rng(4)
    rows = [(s, D[i], *map(float, rng.normal(size=3))) for s in "ab" for i in range(60)] + [("c", D[i], 1.0, 2.0, float(i)) for i in range(4)]
    got = {(r["s"], r["term"]): r for r in judge.attribution(spark.createDataFrame(rows, "s string, date date, y double, f double, g double"), "y", ["f", "g"], by=["s"]).collect()}
    assert {s for s, _ in got} == {"a", "b"}
    for s in "ab":
        v = np.array([r[2:] for r in rows if r[0] == s])
        y, x = v[:, 0], np.column_stack([np.ones(60), v[:, 1:]])
        beta = np.linalg.solve(x.T @ x, x.T @ y)
        u = x * (y - x @ beta)[:, None]
        meat = u.T @ u + sum((1 - k / 4) * (u[k:].T @ u[:-k] + u[:-k].T @ u[k:]) for k in (1, 2, 3))
        inner = np.linalg.inv(x.T @ x)
        t = beta / np.sqrt(np.diag(inner @ meat @ inner) * 60 / 57)
        for k, term in enumerate(["alpha", "f", "g"]):
            assert (got[s, term]["coef"], got[s, term]["t"]) == pytest.approx((beta[k], t[k]))


def test_judged_search(spark):
    rng = np.random.default_rng(5)
    days = [dt.date(2018, 1, 1) + dt.timedelta(days=7 * i) for i in range(200)]
    rows = [(f"c{j}", d, float(v)) for j in range(6) for d, v in zip(days, rng.normal(0.4 * (j == 2), 1, 200), strict=True)]
    series = spark.createDataFrame(rows, "candidate string, date date, pnl double")
    sharpes = {r["candidate"]: r["sharpe"] for r in judge.series_stats(series, ["candidate"], periods=52).orderBy("candidate").collect()}
    got = judge.judged_search(series, sharpes, 52, blocks=6)
    assert got["deflated"]["best"] == "c2" and got["deflated"]["trials"] == 6 and got["deflated"]["probability"] > 0.9
    assert got["selection"]["hindsight"] == "c2" and got["selection"]["sharpe"] <= got["selection"]["hindsight_sharpe"] + 1e-9 and got["overfitting"]["pbo"] < 0.2
    assert judge.judged_search(series.filter("candidate = 'c1'"), {"c1": sharpes["c1"]}, 52)["overfitting"]["pbo"] is None
    years = judge.ic_by_year(spark.createDataFrame([(D[0], 2018, 1.0, 1.0), (D[0], 2018, 2.0, 2.0), (D[1], 2019, 1.0, 2.0), (D[1], 2019, 2.0, 1.0)], "t0 date, y_year int, pred double, y_rank double"))
    assert judge.overall_ic(years) == {"mean": 0.0, "worst_year": 2019, "worst": -1.0, "years": 2}


def test_pbo(spark):
    rng = np.random.default_rng(2)
    rows = lambda edge: [(f"c{j}", D[i], float(v)) for j in range(8) for i, v in enumerate(rng.normal(edge * (j == 3), 1, 200))]
    schema = "candidate string, date date, pnl double"
    assert judge.pbo(spark.createDataFrame(rows(0.5), schema), 6)["pbo"] < 0.1
    assert judge.pbo(spark.createDataFrame(rows(0.0), schema), 6)["pbo"] > 0.2


def test_holdout(spark):
    rows = spark.createDataFrame([(D[i], D[i + 10]) for i in range(30)], "t0 date, expiry date")
    c = judge.holdout_counts(rows, D[20], "t0", "expiry").first()
    assert tuple(c) == (10, 10, 10)
    assert judge.holdout(rows, D[20], horizon="expiry").count() == 10 and judge.holdout(rows, D[20], horizon="expiry", opened=True).count() == 20
    with pytest.raises(ValueError, match="horizon"):
        judge.holdout(rows, D[20], early_exit=True)


def test_ensemble_members_must_match(spark, fit_rows):
    a = fit_rows.select("root", "t0", "fold", "is_train", F.col("a").alias("pred"))
    with pytest.raises(Exception, match="same rows"):
        models.zscore_ensemble([a, a.filter("root <> 3")], [0.5, 0.5], ["root", "t0"]).collect()
