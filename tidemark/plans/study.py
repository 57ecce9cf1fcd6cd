"""A study declared once: sources, folds, models, ensembles and a book become the stages that fit and judge them.

Each kind of book says itself which stages judge a prediction, which baselines stand beside it, and where the verdict is
found; a study only strings them together. What a stage does is a module's function of its specification and inputs.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cross_section import spearman
from ..operators import books, fitting, folds, judge, models
from .runner import Headline, Outputs, Pipeline, Stage, metric


@dataclass(frozen=True)
class FeatureSet:
    """Columns of a panel: those named, or all but the excluded."""

    columns: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def of(self, frame: DataFrame) -> list[str]:
        if lost := [c for c in self.columns if c not in frame.columns]:
            raise KeyError(f"the panel has no column {', '.join(lost)}")
        return list(self.columns) or [c for c in frame.columns if c not in self.exclude]


@dataclass(frozen=True)
class Source:
    """A stage that reads or derives data: fn(spec?, *inputs). Without inputs and fingerprint it runs every time."""

    fn: Callable[..., Any]
    inputs: tuple[str, ...] = ()
    spec: Any = None
    fingerprint: Callable[[], str] | None = None


@dataclass(frozen=True)
class Model:
    """fit on features of a source (by default the study's index)."""

    features: FeatureSet
    fit: fitting.Fit = field(default_factory=fitting.Fit)
    panel: str | None = None


@dataclass(frozen=True)
class Ensemble:
    """Members by weight. cross_section: whether they are standardised within dates; by default if all were fitted so."""

    members: Mapping[str, float]
    cross_section: bool | None = None


@dataclass(frozen=True)
class Stats:
    periods: int = 252
    block: int = 21
    draws: int = 2000
    least_year: int = 60
    least_half: int = 40

    def of(self, series: DataFrame) -> dict[str, dict]:
        """name -> statistics of the series (name, date, pnl)."""
        return judge.series_report(series, ["name"], self.periods, self.block, self.least_year, self.least_half, self.draws)

    def difference(self, base: Mapping[str, float], other: Mapping[str, float]) -> dict | None:
        """The paired difference of Sharpes over common dates; None over fewer dates than a block."""
        days = sorted(base.keys() & other.keys())
        pair = [np.array([s[d] for d in days], float) for s in (base, other)]
        return judge.paired_sharpe_diff(*pair, self.periods, self.block, self.draws) if len(days) >= self.block else None


@dataclass(frozen=True)
class Power:
    alpha: float = 0.01
    power: float = 0.8


def plain(value: Any) -> Any:
    """value as JSON holds it: dates as text, numbers that aren't finite as null."""
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    if isinstance(value, float | np.floating):
        return float(value) if math.isfinite(value) else None
    return int(value) if isinstance(value, np.integer) else str(value) if isinstance(value, dt.date) else value


def _named(frame: DataFrame, name: str, date: str = "date") -> DataFrame:
    return frame.select(F.lit(name).alias("name"), F.col(date).alias("date"), F.col("pnl").cast("double").alias("pnl"))


def _stacked(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _judged(stats: Stats, series: DataFrame) -> dict[str, dict]:
    """Statistics and daily values by name, for all series of (name, date, pnl) together."""
    found = stats.of(series.filter("pnl is not null"))
    days: dict[str, list[dict]] = {n: [] for n in found}
    for r in series.filter("pnl is not null").orderBy("date").collect():
        days[r["name"]].append({"date": str(r["date"]), "pnl": r["pnl"]})
    return {n: plain(s) | {"daily": days[n]} for n, s in found.items()}


def _by_date(book: Mapping) -> dict[str, float]:
    return {d["date"]: d["pnl"] for d in book["daily"]}


def _span(table: DataFrame) -> tuple[dt.date, dt.date]:
    """The whole test window."""
    return tuple(table.agg(F.min("test_start"), F.max("test_end")).first())


# books ----------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class CrossSectionBook:
    """The outer quantiles of each date, or of a trailing pool, held along paths.

    frame: the source with keys, eligible (by default all are), y and the rank target. paths(positions, *paths_inputs)
    gives keys, date and the position's running pnl; by default two marks, nought at entry and y at exit. per_position
    judges the equal-weight spread; min_live begins once both sides hold as many; end cuts the days off.
    """

    frame: str
    q: float = 0.1
    pool_days: int = 0
    min_pool: int = 0
    paths: Callable[..., DataFrame] | None = None
    paths_inputs: tuple[str, ...] = ()
    paths_fingerprint: Callable[[], str] | None = None
    end: dt.date | None = None
    per_position: bool = False
    min_live: int = 0
    ic_target: str = "y_rank"
    frame_for: tuple[tuple[str, str], ...] = ()
    benchmark: None = None

    def stages(self, study: Study, name: str, preds: str) -> list[Stage]:
        frame = dict(self.frame_for).get(name, self.frame)
        rule = (self.q, self.pool_days, self.min_pool, study.keys, study.schedule.entry)
        path = Stage(f"paths_{name}", self.paths, (f"book_{name}", *self.paths_inputs), fingerprint=self.paths_fingerprint) if self.paths else Stage(f"paths_{name}", _two_marks, (f"book_{name}",), (study.keys, study.schedule.entry, study.schedule.exit))
        how = (study.keys, study.schedule.entry, self.end, self.per_position, self.min_live, self.ic_target, self.pool_days > 0, study.stats)
        return [Stage(f"book_{name}", _positions, (preds, frame), rule), path, Stage(f"eval_{name}", _evaluate_sides, (f"book_{name}", f"paths_{name}", preds, frame), how)]

    def baselines(self, study: Study, names: Sequence[str]) -> list[Stage]:
        return []

    def headline(self, study: Study, name: str) -> Headline:
        return Headline(f"eval_{name}", "ls.sharpe", "ls.n", "ls.daily", family="long-short", periods=study.stats.periods)

    def power_stage(self, study: Study) -> Stage:
        panels: dict[str, tuple[FeatureSet, ...]] = {}
        for m in study.models.values():
            panels[m.panel or study.index] = (*panels.get(m.panel or study.index, ()), m.features)
        return Stage("power", _panel_power, ("folds", *panels), (study.power, tuple(panels), tuple(panels.values()), self.ic_target, study.schedule.entry, self.pool_days > 0))


@dataclass(frozen=True)
class TimeSeriesBook:
    """A position through time, beside constant positions and rules that are columns of frame.

    sign_models' predictions are positions already. short_or_flat judges each model's short side too. benchmark: the
    baseline whose daily result is taken off, if it is one.
    """

    frame: str
    kind: str = "scaled"
    cap: float = 1.0
    cost: float = 0.0
    long_only: bool = False
    short_only: bool = False
    ret: str = "r_next"
    sign_models: tuple[str, ...] = ()
    short_or_flat: bool = False
    constants: tuple[tuple[str, float], ...] = (("always_long", 1.0), ("always_short", -1.0))
    rules: tuple[tuple[str, str], ...] = ()
    benchmark: str = "always_short"
    ic_target: str = "y"

    @property
    def _has_benchmark(self) -> bool:
        return self.benchmark in {n for n, _ in (*self.constants, *self.rules)}

    def stages(self, study: Study, name: str, preds: str) -> list[Stage]:
        kind = "sign" if name in self.sign_models else self.kind
        how = (kind, self.cap, self.cost, self.long_only, self.short_only, self.short_or_flat, study.schedule.entry, self.ret, self.ic_target, study.stats)
        return [Stage(f"eval_{name}", _evaluate_signal, (self.frame, preds), how)]

    def baselines(self, study: Study, names: Sequence[str]) -> list[Stage]:
        how = (self.constants, self.rules, self.cap, self.cost, self.long_only, self.short_only, study.schedule.entry, self.ret, study.stats)
        out = [Stage("eval_baselines", _evaluate_baselines, (self.frame, "folds"), how)]
        return out + [Stage(f"active_{n}", _over_benchmark, (f"eval_{n}", "eval_baselines"), (self.benchmark, study.stats)) for n in names if self._has_benchmark]

    def headline(self, study: Study, name: str) -> Headline:
        if self._has_benchmark:
            return Headline(f"active_{name}", "sharpe", "n", "daily", family=f"active over {self.benchmark}", periods=study.stats.periods)
        return Headline(f"eval_{name}", "book.sharpe", "book.n", "book.daily", periods=study.stats.periods)

    def power_stage(self, study: Study) -> Stage:
        return Stage("power", _years_power, ("folds",), study.power)


@dataclass(frozen=True)
class PathBook:
    """Overlapping trades marked along their paths, sized by the prediction at entry, against baselines on the same entries.

    trades: a row a trade and mark date, with the running pnl. calendar: the days every book is marked on. frame: a row a
    trade with the outcome, the baselines' weight columns and perhaps a flag. The gain over benchmark is the verdict.
    """

    trades: str
    calendar: str
    frame: str
    rule: str = "rank"
    cap: float = 2.0
    unit: str | None = None
    scale: float = 1.0
    baselines_: tuple[tuple[str, str], ...] = ()
    benchmark: str = "constant"
    outcome: str = "y"
    flag: str | None = None

    def stages(self, study: Study, name: str, preds: str) -> list[Stage]:
        return [path_stage(f"eval_{name}", preds, self, study.stats, study.schedule.entry)]

    def baselines(self, study: Study, names: Sequence[str]) -> list[Stage]:
        return []

    def headline(self, study: Study, name: str) -> Headline:
        return path_headline(f"eval_{name}", self.benchmark, study.stats.periods)

    def power_stage(self, study: Study) -> Stage:
        return Stage("power", _years_power, ("folds",), study.power)


def path_stage(name: str, preds: str, book: PathBook, stats: Stats, entry: str = "t0") -> Stage:
    """A path book's judgement of any stage of predictions; what it returns has the side output `trades`."""
    how = (book.rule, book.cap, book.unit, book.scale, book.baselines_, book.benchmark, book.outcome, book.flag, entry, stats)
    return Stage(name, _evaluate_paths, (book.trades, book.calendar, book.frame, preds), how, side=("trades",))


def path_headline(stage: str, benchmark: str = "constant", periods: int = 252) -> Headline:
    return Headline(stage, "active.sharpe", "active.n", "active.daily", family=f"gain over {benchmark}", periods=periods)


# the study ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Study:
    """index: the source whose rows are dealt to folds. evaluate: which models and ensembles get a book (all).

    Stages: the sources, folds, fit_NAME, ens_NAME, the book's own for each name, its baselines, power, report, extra.
    """

    sources: Mapping[str, Source]
    index: str
    schedule: folds.WalkForward
    models: Mapping[str, Model]
    book: CrossSectionBook | TimeSeriesBook | PathBook
    ensembles: Mapping[str, Ensemble] = field(default_factory=dict)
    evaluate: tuple[str, ...] | None = None
    keys: tuple[str, ...] = ("root", "t0")
    stats: Stats = field(default_factory=Stats)
    power: Power | None = field(default_factory=Power)
    extra: tuple[Stage, ...] = ()
    judged: tuple[Headline, ...] = ()

    @property
    def names(self) -> list[str]:
        return list(self.evaluate) if self.evaluate is not None else [*self.models, *self.ensembles]

    def stages(self) -> list[Stage]:
        w, fits = self.schedule, {n: m.fit for n, m in self.models.items()}
        out = [Stage(n, s.fn, s.inputs, s.spec, fingerprint=s.fingerprint) for n, s in self.sources.items()]
        out.append(Stage("folds", _folds, (self.index,), (w, self.keys)))
        out += [Stage(f"fit_{n}", _fit, (m.panel or self.index, "folds"), (w, m.fit, m.features, self.keys), side=("models",)) for n, m in self.models.items()]
        for n, e in self.ensembles.items():
            within = e.cross_section if e.cross_section is not None else isinstance(self.book, CrossSectionBook) and all(fits[x].cross_section for x in e.members)
            out.append(Stage(f"ens_{n}", _ensemble, tuple(f"fit_{x}" for x in e.members), (tuple(e.members.values()), self.keys, w.entry, within)))
        for n in self.names:
            out += self.book.stages(self, n, f"fit_{n}" if n in self.models else f"ens_{n}")
        out += self.book.baselines(self, self.names)
        evals = [s.name for s in out if s.name.startswith("eval_")]
        if self.power:
            out.append(self.book.power_stage(self))
        if self.names:
            more = (["power"] if self.power else []) + [f"fit_{n}.models" for n in self.models]
            signed = tuple(m.fit.kind in ("ridge", "composite") for m in self.models.values())
            out.append(Stage("report", _report, (*evals, *more), (tuple(evals), self.book.benchmark, bool(self.power), tuple(self.models), signed, self.stats)))
        return [*out, *self.extra]

    def judged_books(self) -> tuple[Headline, ...]:
        """Every book that counts as a trial: each evaluated name's, and those of extra stages."""
        return (*(self.book.headline(self, n) for n in self.names), *self.judged)

    def pipeline(self, root: str | Path, spark: SparkSession, headline: dict[str, str] | None = None) -> Pipeline:
        return Pipeline(self.stages(), root, spark, headline, self.judged_books())


# what stages do -------------------------------------------------------------------------------------------------------


def _folds(spec: tuple, panel: DataFrame) -> DataFrame:
    w, keys = spec
    return folds.check_folds(panel, folds.collected(folds.make_folds(panel, w), w), w, keys)


def _fit(spec: tuple, panel: DataFrame, table: DataFrame) -> Outputs:
    w, fit, features, keys = spec
    preds, held = fitting.fit_walk_forward(folds.dealt(panel, table, w), features.of(panel), fit, keys, w.entry)
    described = [{"fold": r["fold"], "input": r["input"], "weight": r["weight"]} for r in held.orderBy("fold", "input").collect()]
    return Outputs(preds, {"models": plain(described)})


def _ensemble(spec: tuple, *members: DataFrame) -> DataFrame:
    weights, keys, entry, within = spec
    return models.zscore_ensemble(members, weights, list(keys), entry, within)


def _positions(spec: tuple, preds: DataFrame, frame: DataFrame) -> DataFrame:
    q, pool_days, min_pool, keys, entry = spec
    rows = frame if "eligible" in frame.columns else frame.withColumn("eligible", F.lit(True))
    return books.quantile_book(preds, rows, list(keys), q, entry, pool_days, min_pool)


def _two_marks(spec: tuple, positions: DataFrame) -> DataFrame:
    keys, entry, leave = spec
    return books.one_period_paths(positions.filter("side is not null"), list(keys), "y", entry, leave)


def _evaluate_sides(spec: tuple, positions: DataFrame, paths: DataFrame, preds: DataFrame, frame: DataFrame) -> dict:
    keys, entry, end, per_position, min_live, target, pooled, stats = spec
    days = books.daily_book(positions.filter("side is not null"), paths, list(keys), end)
    if per_position:
        days = days.withColumn("ls", F.col("ls_pp"))
    if min_live:
        days = books.from_first_live(days, min_live)
    days = days.select("date", "long", "short", "ls", "n_long", "n_short")
    out = _judged(stats, _stacked([_named(days.withColumn("pnl", F.col(c)), c) for c in ("long", "short", "ls")]))
    live = days.agg(F.count("*").alias("n_days"), F.avg("n_long").alias("avg_live_long"), F.avg("n_short").alias("avg_live_short"), F.min(F.least("n_long", "n_short")).alias("least_live")).first().asDict()
    rows = frame.join(books.out_of_sample(preds).select(*keys, "pred"), list(keys))
    if pooled:  # a few rows a date: the correlation is read across a year's rows, and by month for its t
        years = judge.ts_ic_by_year(rows, "pred", target, entry)
        monthly = rows.withColumn(entry, F.trunc(entry, "month"))
    else:
        years = judge.ic_by_year(rows.withColumn("_year", F.year(entry)), "pred", target, entry, "_year")
        monthly = rows
    macbeth = judge.fama_macbeth(monthly, "pred", target, entry).first().asDict()
    ic = {"by_year": {str(r[0]): r["ic"] for r in years.collect()}} | judge.overall_ic(years)
    if pooled:
        ic["all_rows"] = spearman(rows, "pred", target).first()["ic"]
    metric("sharpe", out["ls"]["sharpe"])
    return out | plain(live | {"ic": ic, "ic_by_date": macbeth | {"p_two_sided": judge.two_sided_p(macbeth["t_nw"])}})


def _evaluate_signal(spec: tuple, frame: DataFrame, preds: DataFrame) -> dict:
    kind, cap, cost, long_only, short_only, short_or_flat, date, ret, target, stats = spec
    sides = {"book": (long_only, short_only)} | ({"short_or_flat": (False, True)} if short_or_flat else {})
    made = {n: books.signal_book(preds, frame, kind, cap, cost, lo, so, date, ret) for n, (lo, so) in sides.items()}
    out = _judged(stats, _stacked([_named(b, n, date) for n, b in made.items()]))
    for n, b in made.items():
        out[n] |= plain(b.agg(F.avg((F.col("position") < 0).cast("double")).alias("share_short"), F.avg(F.abs("position")).alias("mean_abs_position")).first().asDict())
    rows = books.out_of_sample(preds).join(frame.select(date, target), date)
    years = judge.ts_ic_by_year(rows, "pred", target, date)
    metric("sharpe", out["book"]["sharpe"])
    return out | {"ic": plain({"by_year": {str(r["year"]): r["ic"] for r in years.collect()}, "all_rows": spearman(rows, "pred", target).first()["ic"]} | judge.overall_ic(years))}


def _evaluate_baselines(spec: tuple, frame: DataFrame, table: DataFrame) -> dict:
    constants, rules, cap, cost, long_only, short_only, date, ret, stats = spec
    span = _span(table)
    made = {n: books.constant_book(frame, x, *span, cost, date, ret) for n, x in constants} | {n: books.rule_book(frame, c, *span, cap, cost, long_only, short_only, date, ret) for n, c in rules}
    if not made:
        return {}
    out = _judged(stats, _stacked([_named(b, n, date) for n, b in made.items()]))
    for n, b in made.items():
        out[n]["share_short"] = b.agg(F.avg((F.col("position") < 0).cast("double"))).first()[0]
    return out


def _over_benchmark(spec: tuple, result: dict, baselines: dict) -> dict:
    """The book's days less the benchmark's, judged as a series of its own."""
    benchmark, stats = spec
    mine, held = _by_date(result["book"]), _by_date(baselines[benchmark])
    days = [(dt.date.fromisoformat(d), mine[d] - held[d]) for d in sorted(mine.keys() & held.keys())]
    spark = SparkSession.getActiveSession()
    out = _judged(stats, _named(spark.createDataFrame(days, "date date, pnl double"), "active"))["active"]
    metric("active_sharpe", out["sharpe"])
    return out | {"benchmark": benchmark}


def _evaluate_paths(spec: tuple, trades: DataFrame, calendar: DataFrame, frame: DataFrame, preds: DataFrame) -> Outputs:
    rule, cap, unit, scale, named, benchmark, outcome, flag, entry, stats = spec
    sized = books.sizes(preds, rule, entry, cap)
    lo, hi = sized.agg(F.min(entry), F.max(entry)).first()
    if lo is None:
        raise ValueError("there is no out-of-sample prediction to size")
    held = frame.filter(F.col(entry).between(F.lit(lo), F.lit(hi)))
    weights = {"book": sized, "constant": held.select(entry, F.lit(1.0).alias("w"))} | {n: held.select(entry, F.col(c).cast("double").alias("w")) for n, c in named}
    if benchmark not in weights or benchmark == "book":
        raise KeyError(f"the benchmark {benchmark} is none of the baselines {sorted(weights.keys() - {'book'})}")
    raw = {n: books.path_pnl(trades, w, entry, unit=unit, scale=scale) for n, w in weights.items()}
    end = max(d for d in (r.agg(F.max("date")).first()[0] for r in raw.values()) if d is not None)
    marked = {n: books.on_calendar(r, calendar, lo, end) for n, r in raw.items()}
    marked["active"] = books.active(marked["book"], marked[benchmark])
    out = _judged(stats, _stacked([_named(m, n) for n, m in marked.items()]))
    days = {n: _by_date(b) for n, b in out.items()}
    gains = {f"vs_{n}": plain(stats.difference(days[n], days["book"])) for n in weights if n != "book"}
    out["active"]["benchmark"] = benchmark
    per = sized.join(frame.select(entry, F.col(outcome).cast("double").alias("y"), *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ([flag] if flag else [])]), entry, "left")
    table = {r["year"]: r for r in judge.sizing(sized, per.drop("pred", "w"), entry, flag).collect()}
    ranks = spearman(per, "pred", "y").first()
    by_year = spearman(per.withColumn("_year", F.year(entry)), "pred", "y", ["_year"]).filter("n >= 3")
    sizing = {"n_entries": table[None]["n"], "mean_w": table[None]["mean_w"], "corr_w_y": table[None]["corr"], "rank_ic": ranks["ic"] if ranks["n"] >= 3 else None, "rank_ic_by_year": {str(r["_year"]): r["ic"] for r in by_year.collect()}}
    if flag:
        sizing |= {"mean_w_flagged": table[None]["mean_w_flagged"], "share_flagged": per.agg(F.avg(F.col(flag).cast("double"))).first()[0]}
    metric("sharpe", out["book"]["sharpe"])
    metric("gain", (gains[f"vs_{benchmark}"] or {}).get("d_sharpe"))
    return Outputs(out | gains | {"sizing": plain(sizing)}, {"trades": per.orderBy(entry)})


def _panel_power(spec: tuple, table: DataFrame, *panels: DataFrame) -> dict:
    power, names, sets, target, date, monthly = spec
    lo, hi = _span(table)
    out = {}
    for name, features, frame in zip(names, sets, panels, strict=True):
        columns = sorted({c for f in features for c in f.of(frame)} - {target})
        rows = frame.withColumn(date, F.trunc(date, "month")) if monthly else frame
        dates = rows.filter(F.col(date).between(F.lit(lo), F.lit(hi))).select(date).distinct().count()
        out[name] = judge.power_report(rows, columns, target, date, dates, (hi - lo).days / 365.25, power.alpha, power.power)
        metric(f"mde_ic of {name}", out[name]["mde_ic"])
    return plain(out)


def _years_power(power: Power, table: DataFrame) -> dict:
    lo, hi = _span(table)
    years = (hi - lo).days / 365.25
    least = judge.mde_sharpe(years, power.alpha, power.power)
    metric("mde_sharpe", least)
    return {"test_years": years, "alpha": power.alpha, "power": power.power, "mde_sharpe": least}


SHOWN = ("sharpe", "sharpe_ci", "n", "total", "max_drawdown", "years_pos", "n_years", "top5_share", "sharpe_without_top5")


def _report(spec: tuple, *inputs) -> dict:
    """Every book's headline beside the others, its paired difference from the benchmark, power, and how stable models are."""
    evals, benchmark, powered, fitted, signed, stats = spec
    results, rest = dict(zip(evals, inputs, strict=False)), list(inputs[len(evals) :])
    rows: dict[str, dict] = {}
    for stage, result in results.items():
        name = stage.removeprefix("eval_")
        for label, book in result.items():
            if not isinstance(book, Mapping) or "daily" not in book or label in ("long", "short"):
                continue
            alone = label in ("book", "ls")
            shown = name if alone else label if name == "baselines" or label not in ("active", "short_or_flat") else f"{name}_{label}"
            rows.setdefault(shown, {k: book.get(k) for k in SHOWN} | {"daily": _by_date(book)})
    base = rows.get(benchmark, {}).get("daily") if benchmark else None
    out: dict[str, Any] = {"books": {}}
    for name, row in rows.items():
        days = row.pop("daily")
        out["books"][name] = row | ({f"vs_{benchmark}": plain(stats.difference(base, days))} if base else {})
    if powered:
        out["power"] = rest.pop(0)
    out["models"] = {n: _stability(held, s) for n, held, s in zip(fitted, rest, signed, strict=True)}
    return out


def _stability(held: list[dict], signed: bool) -> dict:
    """How often a model's weights keep their sign over folds: by input, and the share of inputs that always do."""
    spark = SparkSession.getActiveSession()
    table = spark.createDataFrame([(m["fold"], m["input"], m["weight"]) for m in held], "fold int, input string, weight double")
    inputs = {r["input"]: {k: r[k] for k in ("folds", "mean", "mean_abs", "sign_agreement")} for r in models.stability(table, signed).collect()}
    agreed = [v["sign_agreement"] for v in inputs.values() if v["sign_agreement"] is not None]
    return plain({"folds": len({m["fold"] for m in held}), "inputs": inputs, "sign_stable": sum(a == 1 for a in agreed) / len(agreed) if agreed else None})


def fold_table(table: DataFrame) -> list[dict]:
    """A fold table as JSON rows, dates as text."""
    return [plain(r.asDict()) for r in table.orderBy("fold").collect()]


def folds_from(spark: SparkSession, rows: Sequence[Mapping]) -> DataFrame:
    """The frame of fold_table's rows."""
    dates = ("train_start", "train_exit_cut", "test_start", "test_end")
    kinds = {"fold": "int", "mode": "string"} | dict.fromkeys(dates, "date") | dict.fromkeys(("train_rows", "test_rows"), "bigint") | {"gap_td": "int"}
    names = [n for n in kinds if rows and n in rows[0]] or list(kinds)
    read = lambda n, v: dt.date.fromisoformat(v) if n in dates and v is not None else v
    return spark.createDataFrame([tuple(read(n, r[n]) for n in names) for r in rows], ", ".join(f"{n} {kinds[n]}" for n in names))
