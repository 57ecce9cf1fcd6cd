"""The catalogue's queries in DuckDB's SQL."""

from __future__ import annotations


def _pr(c: str, p: str = "t0", rows: bool = False) -> str:
    part = f"partition by {p}" if p else ""
    both = f"partition by {p}, {c}" if p else f"partition by {c}"
    n = "*" if rows else c
    return f"case when {c} is not null then cast(rank() over ({part} order by {c} nulls last) + (count(*) over ({both}) - 1) / 2 - 1 as double) / greatest(count({n}) over ({part}) - 1, 1) end"


def _ar(c: str, p: str) -> str:
    return f"(rank() over (partition by {p} order by {c}) + (count(*) over (partition by {p}, {c}) - 1) / 2)"


def _pearson(a: str, b: str) -> str:
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


def _r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 as {name}"


CS = """
months as (
  select l_suppkey as root, cast(date_trunc('month', l_shipdate) as date) as t0, round(sum(l_extendedprice * (1 - l_discount)), 4) as f1,
         round(avg(l_discount), 8) as f2, round(avg(l_quantity), 8) as f3 from lineitem group by 1, 2),
led as (select *, lead(t0) over w as exit_date, round(ln(lead(f1) over w / f1), 10) as y from months window w as (partition by root order by t0)),
cs as (
  select led.root, t0, exit_date, f1, f2, f3, y, cast(year(t0) as int) as y_year, r_name as sector from led join supplier on s_suppkey = root
  join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where exit_date is not null)"""

XS = CS + f""",
xs as (
  select *, {_pr('f1')} as r1, {_pr('f2')} as r2, {_pr('f3')} as r3, {_pr('y')} as y_rank,
         (y - avg(y) over (partition by t0)) / nullif(stddev_samp(y) over (partition by t0), 0) as y_z from cs)"""


def _folds(src: str, entry: str, first: int, embargo: int, rolling: bool) -> str:
    start = "case when y - 1995 > 4 then greatest(make_date(y - 4, 1, 1), date '1995-01-01') else date '1995-01-01' end" if rolling else "date '1995-01-01'"
    mode = "case when y - 1995 > 4 then 'rolling' else 'expanding' end" if rolling else "'expanding'"
    return f""",
cal as (select d, row_number() over (order by d) as pos from (select {entry} as d from {src} union select exit_date from {src}) where d is not null),
yrs as (select cast(year(d) as int) as y, min(d) as test_start, max(d) as test_end, min(pos) as p from cal group by 1),
folds as (
  select y as fold, {mode} as mode, {start} as train_start, c.d as train_exit_cut, test_start, test_end from yrs join cal as c on c.pos = yrs.p - {embargo}
  where y between {first} and (select max(year({entry})) from {src}))"""


DEALT = XS + _folds("cs", "t0", 1998, 1, True) + """,
dealt as (
  select xs.*, f.fold, not (t0 between f.test_start and f.test_end) as is_train from xs join folds as f
  on (t0 >= train_start and exit_date <= train_exit_cut) or t0 between test_start and test_end)"""

PREDS = DEALT + """,
preds as (select *, round(r1 - r2 / 2 + r3 / 4, 9) as pred from dealt)"""

TS = """
days as (select cast(l_shipdate as date) as date, round(sum(l_extendedprice * (1 - l_discount)), 4) as rev from lineitem group by 1),
ts0 as (
  select *, round(ln(rev / lag(rev) over w), 10) as r, round(ln(lead(rev) over w / rev), 10) as r_next, lead(date) over w as exit_date, cast(year(date) as int) as y_year
  from days window w as (order by date)),
ts as (
  select *, case when count(rev) over w21 >= 10 then round((rev - avg(rev) over w21) / nullif(stddev_samp(rev) over w21, 0), 10) end as x1,
         case when count(r) over w63 >= 31 then round((r - avg(r) over w63) / nullif(stddev_samp(r) over w63, 0), 10) end as x2
  from ts0 window w21 as (order by date rows between 20 preceding and current row), w63 as (order by date rows between 62 preceding and current row))"""

TS_DEALT = TS + _folds("ts", "date", 1999, 5, False) + """,
dealt as (
  select ts.*, f.fold, not coalesce(date between f.test_start and f.test_end, false) as is_train from ts join folds as f
  on (date >= train_start and exit_date <= train_exit_cut) or date between test_start and test_end)"""

TS_PREDS = TS_DEALT + """,
preds as (select *, x1 as pred from dealt where x1 is not null)"""

TRADES = """,
runs as (select date, row_number() over (order by date) as k, sum(coalesce(r, 0)) over (order by date rows unbounded preceding) as total from ts),
trades as (
  select a.date as t0, b.date, b.total - a.total as pnl from runs as a join runs as b on b.k between a.k and a.k + 20)"""

SERIES = CS + """,
regions as (select sector as candidate, t0 as date, round(sum(f1), 4) as rev from cs group by 1, 2),
series0 as (select candidate, date, round(ln(rev / lag(rev) over (partition by candidate order by date)), 10) as pnl from regions),
series as (select * from series0 where pnl is not null)"""

HOLES = CS + """,
holes as (select *, case when root % 7 <> 0 then f3 end as x from cs)"""

RIDGE_SUMS = DEALT + """,
fit as (select fold, coalesce(r1, 0.5) as x1, coalesce(r2, 0.5) as x2, y_z as yy from dealt where is_train and y_z is not null),
mom as (
  select fold, count(*) as n, avg(x1) as m1, avg(x2) as m2, stddev_pop(x1) + 1e-9 as s1, stddev_pop(x2) + 1e-9 as s2, var_pop(x1) as v1, var_pop(x2) as v2,
         covar_pop(x1, x2) as c12, covar_pop(x1, yy) as c1, covar_pop(x2, yy) as c2, stddev_pop(yy) as sy from fit group by fold),
z as (select *, n * v1 / (s1 * s1) as z11, n * v2 / (s2 * s2) as z22, n * c12 / (s1 * s2) as z12, n * c1 / s1 as y1, n * c2 / s2 as y2 from mom)"""


def _ridge(prior: bool) -> str:
    along = "(y1 - 0.5 * y2) / (z11 - z12 + 0.25 * z22)"
    return RIDGE_SUMS + f""",
sys as (select *, z11 + 0.5 * n as a11, z22 + 0.5 * n as a22, y1 + {f'0.5 * n * {along}' if prior else '0'} as b1, y2 + {f'0.5 * n * (-0.5) * {along}' if prior else '0'} as b2 from z),
w as (select *, (b1 * a22 - b2 * z12) / (a11 * a22 - z12 * z12) as w1, (b2 * a11 - b1 * z12) / (a11 * a22 - z12 * z12) as w2 from sys),
scored as (
  select dealt.*, (coalesce(r1, 0.5) - m1) / s1 * w1 + (coalesce(r2, 0.5) - m2) / s2 * w2 as pred from dealt join w using (fold))"""


BOOK = PREDS + f""",
eligible as (
  select c.*, p.pred, p.fold from cs as c join (select root, t0, pred, fold from preds where not is_train) as p using (root, t0) where c.f3 >= 24),
ranked as (select *, {_pr('pred', rows=True)} as pct, count(*) over (partition by t0) as n_eligible from eligible),
book as (
  select *, case when pct >= 1 - 0.2 - 1e-12 then 'long' when pct <= 0.2 + 1e-12 then 'short' end as side,
         cast(least(greatest(floor(pct * 10 + 1e-12), 0), 9) as int) as decile from ranked)"""

DAYS = BOOK + """,
marks as (select root, t0, t0 as date, 0.0::double as pnl from cs union all select root, t0, exit_date, y from cs),
steps as (
  select m.date, b.side, coalesce(m.pnl - lag(m.pnl) over (partition by m.root, m.t0 order by m.date), 0) as d from marks as m join book as b using (root, t0)),
sums as (
  select date, coalesce(sum(d) filter (side = 'long'), 0) as long, coalesce(sum(d) filter (side = 'short'), 0) as short,
         count(*) filter (side = 'long') as n_long, count(*) filter (side = 'short') as n_short from steps group by date),
live as (
  select *, long / greatest(n_long, 1) as long_pp, short / greatest(n_short, 1) as short_pp, long - short as ls,
         long / greatest(n_long, 1) - short / greatest(n_short, 1) as ls_pp from sums)"""


def _signal(position: str) -> str:
    return TS_PREDS + f""",
sds as (select fold, stddev_samp(pred) as sd from preds where is_train group by fold),
held as (select p.date, p.fold, p.r_next, {position} as position from preds as p join sds using (fold) where not is_train),
turned as (select *, abs(position - coalesce(lag(position) over (order by date), 0)) as turnover from held),
book as (select *, position * r_next - 0.0005 * turnover as pnl from turned)"""


SCALED = _signal("least(greatest(pred / sd, -1), 1)")


def _plain_book(position: str) -> str:
    return f"""
held as (select date, r_next, {position} as position from ts where date between date '1999-01-01' and date '2001-06-30'),
turned as (select *, abs(position - coalesce(lag(position) over (order by date), 0)) as turnover from held),
plain as (select *, position * r_next - 0.0005 * turnover as pnl from turned)"""


def _sizes(weight: str, own_fold: bool = False) -> str:
    earlier = "(p.is_train and p.fold = t.fold) or (not p.is_train and p.date < t.date" + (" and p.fold = t.fold)" if own_fold else ")")
    return f"""with {TS_PREDS},
test as (select date, pred, fold from preds where not is_train),
hist as (
  select t.date, t.pred, count(p.pred) as n, count(p.pred) filter (p.pred < t.pred) as below, median(p.pred) as med, avg(greatest(p.pred, 0)) as up
  from test as t left join preds as p on {earlier} group by t.date, t.pred)
select date as t0, {_r('pred', 'pred')}, {_r(weight, 'w')} from hist"""


def _ics(src: str, x: str, y: str, by: str, where: str = "true") -> str:
    return f"""
known as (select * from {src} where {x} is not null and {y} is not null and {where}),
ranks as (select {by}, {_ar(x, by)} as a, {_ar(y, by)} as b from known),
ics as (select {by}, {_pearson('a', 'b')} as ic, count(*) as n from ranks group by {by})"""


def _sharpe(x: str, periods: int = 12) -> str:
    return f"avg({x}) / (stddev_samp({x}) + 1e-12) * sqrt({periods})"


def _phi(x: str) -> str:
    """The normal distribution function by its series around nought: exact to rounding for |x| < 6."""
    terms = f"list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln(abs({x}) + 1e-300) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2))"
    return f"(0.5 + sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum({terms}))"


ALIGNED = SERIES + """,
common as (select date from series group by date having count(distinct candidate) = (select count(distinct candidate) from series)),
aligned as (select candidate, date, pnl from series join common using (date))"""


def _selection(cost: str) -> str:
    return ALIGNED + f""",
years as (
  select candidate, cast(year(date) as int) as year, coalesce(avg(pnl) / nullif(stddev_samp(pnl), 0), 0) * sqrt(12) as year_sharpe from aligned group by 1, 2),
past as (
  select y.candidate, y.year, y.year_sharpe, coalesce(avg(a.pnl) / nullif(stddev_samp(a.pnl), 0), 0) * sqrt(12) - {cost} as past_sharpe
  from years as y join aligned as a on a.candidate = y.candidate and year(a.date) < y.year group by 1, 2, 3),
picks as (select year, candidate as picked, past_sharpe, year_sharpe from past qualify row_number() over (partition by year order by past_sharpe desc, candidate) = 1)"""


RULE = TS_DEALT + """,
fit as (select fold, -r_next as r, coalesce(x1, 0.5) as x1, coalesce(x2, 0.5) as x2 from dealt where is_train and r_next is not null),
qs as (select unnest(range(1, 10)) as k),
cuts as (
  select fold, 0 as input, k, quantile_cont(x1, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])[k] as t from fit, qs group by fold, k
  union all select fold, 1, k, quantile_cont(x2, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])[k] from fit, qs group by fold, k),
cands as (select *, unnest([true, false]) as above from cuts),
lit as (
  select c.fold, c.input, c.k, c.t, c.above, f.r, case when c.above then (case c.input when 0 then x1 else x2 end) > c.t else (case c.input when 0 then x1 else x2 end) < c.t end as lit
  from cands as c join fit as f using (fold)),
scored as (
  select fold, input, k, t, above, avg(case when lit then 1.0 else 0.0 end) as share, avg(case when lit then r else 0 end) / nullif(stddev_samp(case when lit then r else 0 end), 0) * sqrt(252) as sharpe
  from lit group by 1, 2, 3, 4, 5),
base as (select fold, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252) as always from fit group by fold),
kept as (select *, count(*) over (partition by fold) as m from scored where share >= 0.2),
best as (select * from kept qualify row_number() over (partition by fold order by sharpe desc, input, k, above desc) = 1),
chosen as (select b.fold, b.always, s.*, coalesce(s.sharpe - b.always > 0.1, false) as lead from base as b left join best as s using (fold))"""


def _features() -> str:
    return " union all ".join(f"select root, t0, y_year, fold, is_train, y_rank, y_z, '{f}' as feature, {f} as x from dealt" for f in ("r1", "r2", "r3"))


INTER = DEALT + f""",
tr as (select * from dealt where is_train and y_z is not null),
c as (
  select fold, avg(r1) as m1, avg(r2) as m2, avg(r3) as m3, abs(coalesce({_pearson('r1', 'y_z')}, 0)) as c1, abs(coalesce({_pearson('r2', 'y_z')}, 0)) as c2,
         abs(coalesce({_pearson('r3', 'y_z')}, 0)) as c3 from tr group by fold),
k as (
  select *, cast(c2 > c1 as int) + cast(c3 > c1 as int) < 2 as in1, cast(c1 >= c2 as int) + cast(c3 > c2 as int) < 2 as in2, cast(c1 >= c3 as int) + cast(c2 >= c3 as int) < 2 as in3 from c)"""

_KEYS = "root, t0"

SQL = {
    "percentile_rank": f"with {HOLES} select {_KEYS}, {_r(_pr('x'), 'pct')} from holes",
    "rank_of_rows": f"with {HOLES} select {_KEYS}, {_r(_pr('x', rows=True), 'pct')} from holes",
    "zscore_within_date": f"with {CS} select {_KEYS}, " + ", ".join(_r(f"(f{i} - avg(f{i}) over (partition by t0)) / nullif(stddev_samp(f{i}) over (partition by t0), 0)", f"z{i}") for i in (1, 2)) + " from cs",
    "demean_sector": f"with {CS} select {_KEYS}, {_r('y - avg(y) over (partition by t0, sector)', 'y_in_sector')}, {_r('f3 - avg(f3) over (partition by t0)', 'f3_in_date')} from cs",
    "rank_panel": f"with {XS} select {_KEYS}, {_r('r1', 'f1')}, {_r('r2', 'f2')}, {_r('r3', 'f3')} from xs",
    "residualize_sector_beta": f"""with {CS},
b as (select *, case when root % 11 <> 0 then f3 end as beta from cs),
d as (select root, t0, case when beta is not null then y - avg(case when beta is not null then y end) over g end as yy, beta - avg(beta) over g as xx from b window g as (partition by t0, sector))
select {_KEYS}, {_r('yy - coalesce(sum(xx * yy) over (partition by t0) / nullif(sum(xx * xx) over (partition by t0), 0), 0) * xx', 'residual')} from d""",
    "residualize_general": f"""with {XS},
d as (select root, t0, y - avg(y) over g as yy, r1 - avg(r1) over g as a, r2 - avg(r2) over g as b from xs where y is not null and r1 is not null and r2 is not null window g as (partition by t0, sector)),
p as (select t0, sum(a * a) as aa, sum(b * b) as bb, sum(a * b) as ab, sum(a * yy) as ay, sum(b * yy) as byy from d group by t0),
q as (select *, case when aa > 0 then bb - ab * ab / aa else bb end as rest from p),
w as (select t0, ok, case when ok then (byy - case when aa > 0 then ab * ay / aa else 0 end) / rest else 0 end as wb, aa, ab, ay from (select *, rest > 1e-18 * bb as ok from q)),
f as (select d.*, w.wb, case when w.aa > 0 then (w.ay - w.wb * w.ab) / w.aa else 0 end as wa from d join w using (t0))
select cs.root, cs.t0, {_r('f.yy - f.wa * f.a - f.wb * f.b', 'residual')} from cs left join f using (root, t0)""",
    "rolling_zscore": f"""with {TS} select date, case when count(rev) over a >= 10 then {_r('(rev - avg(rev) over a) / nullif(stddev_samp(rev) over a, 0)', 'z').removesuffix(' as z')} end as z21,
case when count(r) over b >= 10 then {_r('(r - avg(r) over b) / nullif(stddev_samp(r) over b, 0)', 'z').removesuffix(' as z')} end as z63 from ts0
window a as (order by date rows between 20 preceding and current row), b as (order by date rows between 62 preceding and current row)""",
    "rolling_mean": f"with {CS} select {_KEYS}, {_r('avg(f1) over (partition by root order by t0 rows between 2 preceding and current row)', 'mean3')} from cs",
    "lag_forward_return": f"with {CS} select {_KEYS}, {_r('lag(f1) over w', 'lag1')}, {_r('ln(lead(f1, 2) over w / f1)', 'ahead2')} from cs window w as (partition by root order by t0)",
    "momentum": f"with {CS} select {_KEYS}, {_r('lag(f1, 1) over w / nullif(lag(f1, 12) over w, 0) - 1', 'momentum')} from cs window w as (partition by root order by t0)",
    "fold_table": f"""with {DEALT},
agg as (select fold, count(*) filter (is_train) as train_rows, count(*) filter (not is_train) as test_rows, max(exit_date) filter (is_train) as x, min(t0) filter (not is_train) as e from dealt group by fold)
select f.fold, mode, train_start, train_exit_cut, test_start, test_end, train_rows, test_rows, cast(b.pos - a.pos as int) as gap_td
from folds as f join agg using (fold) join cal as a on a.d = x join cal as b on b.d = e""",
    "ridge_walk_forward": f"with {_ridge(False)} select {_KEYS}, fold, is_train, {_r('pred', 'pred')} from scored",
    "ridge_prior_walk_forward": f"with {_ridge(True)} select {_KEYS}, fold, is_train, {_r('pred', 'pred')} from scored",
    "composite_walk_forward": f"""with {RIDGE_SUMS},
s as (select *, case when abs(c1 / (nullif(s1 - 1e-9, 0) * sy)) >= 0.001 then sign(c1) else 0 end as g1, case when abs(c2 / (nullif(s2 - 1e-9, 0) * sy)) >= 0.001 then sign(c2) else 0 end as g2 from z)
select {_KEYS}, fold, is_train, {_r('((coalesce(r1, 0.5) - m1) / s1 * g1 + (coalesce(r2, 0.5) - m2) / s2 * g2) / greatest(abs(g1) + abs(g2), 1)', 'pred')} from dealt join s using (fold)""",
    "rule_walk_forward": f"""with {RULE} select fold, case when lead then input else -1 end as input, {_r('case when lead then t else 0 end', 'threshold')}, case when lead then above end as above,
{_r('case when lead then sharpe else always end', 'sharpe')}, {_r('always', 'always')}, {_r('sharpe', 'best')}, 0.1::double as margin, coalesce(m, 0) + 1 as candidates from chosen""",
    "in_sample_ic": f"with {_ridge(False)}, preds as (select *, round(pred, 9) as p9 from scored), {_ics('preds', 'p9', 'y_rank', 'fold, t0', 'is_train')} select fold, {_r('avg(ic)', 'is_ic')} from ics group by fold",
    "winsorize_in_fold": f"""with {DEALT},
q as (select fold, quantile_cont(f1, [0.1, 0.9]) as a, quantile_cont(f2, [0.1, 0.9]) as b from dealt where is_train group by fold)
select {_KEYS}, fold, is_train, {_r('least(greatest(f1, a[1]), a[2])', 'f1')}, {_r('least(greatest(f2, b[1]), b[2])', 'f2')} from dealt join q using (fold)""",
    "interactions_in_fold": f"""with {INTER} select {_KEYS}, fold, is_train, {_r('case when in1 and in2 then (r1 - m1) * (r2 - m2) end', 'p12')},
{_r('case when in1 and in3 then (r1 - m1) * (r3 - m3) end', 'p13')}, {_r('case when in2 and in3 then (r2 - m2) * (r3 - m3) end', 'p23')} from dealt join k using (fold)""",
    "pca_in_fold": f"""with {RIDGE_SUMS} select {_KEYS}, fold, is_train, {_r('((coalesce(r1, 0.5) - m1) / s1 + sign(c12) * (coalesce(r2, 0.5) - m2) / s2) / sqrt(2)', 'pc1', 5)},
{_r('((coalesce(r1, 0.5) - m1) / s1 - sign(c12) * (coalesce(r2, 0.5) - m2) / s2) / sqrt(2)', 'pc2', 5)} from dealt join z using (fold)""",
    "selection_scores": f"""with {DEALT}, long as ({_features()}), {_ics('long', 'x', 'y_rank', 'fold, feature, t0, y_year', 'is_train')},
yr as (select fold, feature, y_year, avg(ic) as ic from ics where ic is not null group by 1, 2, 3),
m as (select fold, feature, avg(ic) as m, stddev_samp(ic) as sd, count(*) as n_years from yr group by 1, 2)
select m.fold, m.feature, {_r('any_value(m)', 'ic')}, {_r('any_value(case when sd > 0 then m / sd else abs(m) end)', 'ir')},
{_r('avg(case when sign(yr.ic) = sign(m) then 1.0 else 0.0 end)', 'cons')}, any_value(n_years) as n_years from m join yr using (fold, feature) group by 1, 2""",
    "zscore_ensemble": f"""with {DEALT} select {_KEYS}, fold, is_train, {_r('0.6 * (r1 - avg(r1) over g) / (stddev_samp(r1) over g + 1e-12) + 0.4 * (r3 - avg(r3) over g) / (stddev_samp(r3) over g + 1e-12)', 'pred')}
from dealt window g as (partition by t0, fold, is_train)""",
    "zscore_ensemble_ts": f"""with {TS_DEALT}, both_known as (select * from dealt where x1 is not null and x2 is not null),
m as (select fold, avg(x1) as m1, stddev_samp(x1) as s1, avg(x2) as m2, stddev_samp(x2) as s2 from both_known where is_train group by fold)
select date, fold, is_train, {_r('0.6 * (x1 - m1) / (s1 + 1e-12) + 0.4 * (x2 - m2) / (s2 + 1e-12)', 'pred')} from both_known join m using (fold)""",
    "weight_stability": f"""with {_ridge(False)}, l as (select fold, 'r1' as input, w1 as v from w union all select fold, 'r2', w2 from w)
select input, count(*) as folds, {_r('avg(v)', 'mean')}, {_r('avg(abs(v))', 'mean_abs')}, {_r('greatest(count(*) filter (v > 0), count(*) filter (v < 0)) / count(*)', 'sign_agreement')} from l group by input""",
    "quantile_book": f"with {BOOK} select {_KEYS}, {_r('pred', 'pred')}, {_r('pct', 'pct')}, n_eligible, side, decile from book",
    "trailing_pool_book": f"""with ev as (select o_orderkey as key, cast(o_orderdate as date) as t0, o_totalprice as pred from orders),
pool as (
  select a.key, a.t0, any_value(a.pred) as pred, count(b.pred) as n, count(b.pred) filter (b.pred < a.pred) as lo, count(b.pred) filter (b.pred <= a.pred) as hi
  from ev as a left join ev as b on b.t0 >= a.t0 - 91 and b.t0 < a.t0 group by 1, 2),
p as (select *, case when n >= 20 then (lo + hi) / (2 * n) end as pct, count(*) over (partition by t0) as n_eligible from pool)
select key, t0, {_r('pct', 'pct')}, n_eligible, case when pct >= 0.9 - 1e-12 then 'long' when pct <= 0.1 + 1e-12 then 'short' end as side from p""",
    "fold_standardised": f"""with {PREDS}, m as (select fold, avg(pred) as mu, stddev_samp(pred) as sd from preds where is_train group by fold)
select {_KEYS}, fold, {_r('case when sd > 0 then (pred - mu) / sd else pred end', 'pred')} from preds left join m using (fold) where not is_train""",
    "daily_book": f"with {DAYS} select date, " + ", ".join(_r(c, c) for c in ("long", "short", "long_pp", "short_pp", "ls", "ls_pp")) + ", n_long, n_short from live",
    "daily_book_from_first_live": f"with {DAYS} select date, {_r('ls', 'ls')}, n_long, n_short from live where date >= (select min(date) from live where n_long >= 2 and n_short >= 2)",
    "book_stats": f"""with {DAYS}, sides as (select date, 'long' as side, long as pnl from live union all select date, 'short', short from live union all select date, 'ls', ls from live),
sc as (select *, sum(pnl) over (partition by side order by date) as cum from sides), su as (select *, cum - max(cum) over (partition by side order by date) as down from sc)
select side, count(*) as n, {_r(_sharpe('pnl'), 'sharpe')}, {_r('sum(pnl)', 'total')}, {_r('min(down)', 'max_drawdown')},
{_r('(select avg(n_long) from live)', 'avg_live_long')}, {_r('(select avg(n_short) from live)', 'avg_live_short')} from su group by side""",
    "fold_correlations": f"""with {DEALT}, w as (select fold, r1, r1 + 0.1 * r2 as r1b, r1 - 0.1 * r3 as r1c, r2, r3 from dealt where is_train),
v as (select fold, coalesce(r1, 0.5) as r1, coalesce(r1b, 0.5) as r1b, coalesce(r1c, 0.5) as r1c, coalesce(r2, 0.5) as r2, coalesce(r3, 0.5) as r3 from w)
""" + " union all ".join(f"select fold, '{a}' as first, '{b}' as second, {_r(_pearson(a, b), 'corr')} from v group by fold" for k, a in enumerate(('r1', 'r1b', 'r1c', 'r2', 'r3')) for b in ('r1', 'r1b', 'r1c', 'r2', 'r3')[k + 1:]),
    "signal_book": f"with {SCALED} select date, fold, {_r('position', 'position')}, {_r('turnover', 'turnover')}, {_r('pnl', 'pnl')} from book",
    "signal_book_short_only": f"with {_signal('least(greatest(sign(pred), -1), 0)')} select date, fold, {_r('cast(position as double)', 'position')}, {_r('cast(turnover as double)', 'turnover')}, {_r('pnl', 'pnl')} from book",
    "constant_book": f"with {TS}, {_plain_book('cast(-1 as double)')} select date, {_r('position', 'position')}, {_r('turnover', 'turnover')}, {_r('pnl', 'pnl')} from plain",
    "rule_book": f"with {TS}, {_plain_book('least(greatest(coalesce(x2, 0), 0), 1.5)')} select date, {_r('position', 'position')}, {_r('turnover', 'turnover')}, {_r('pnl', 'pnl')} from plain",
    "active_series": f"with {SCALED}, {_plain_book('cast(-1 as double)').replace('held as', 'held2 as').replace('from held)', 'from held2)').replace('turned as', 'turned2 as').replace('from turned)', 'from turned2)')} select date, {_r('b.pnl - p.pnl', 'pnl')} from book as b join plain as p using (date)",
    "path_sizes_constant": _sizes("cast(1 as double)"),
    "path_sizes_rank": _sizes("2 * case when n > 0 then below / n else 0.5 end"),
    "path_sizes_tercile": _sizes("cast(case when n = 0 then 1 when below / n < 1 / 3 then 0 when below / n < 2 / 3 then 1 else 2 end as double)"),
    "path_sizes_inverse": _sizes("case when pred > 0 and coalesce(med, pred) > 0 then least(greatest(coalesce(med, pred) / pred, 0), 2) else 1 end"),
    "path_sizes_direct": _sizes("least(greatest(pred, 0) / case when up > 0 then up else 1 end, 2)", own_fold=True),
    "path_daily_pnl": f"""with {TS_PREDS}{TRADES},
steps as (select t.date, coalesce(t.pnl - lag(t.pnl) over (partition by t.t0 order by t.date), t.pnl) * p.pred * 7.3123 as x from trades as t join preds as p on p.date = t.t0 and not p.is_train)
select date, {_r('sum(x)', 'pnl')} from steps group by date""",
    "path_on_calendar": f"""with {TS_PREDS}{TRADES},
steps as (select t.date, coalesce(t.pnl - lag(t.pnl) over (partition by t.t0 order by t.date), t.pnl) * p.pred * 7.3123 as x from trades as t join preds as p on p.date = t.t0 and not p.is_train),
pd as (select date, sum(x) as pnl from steps group by date),
calendar as (select cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date from trades)
select date, {_r('coalesce(pd.pnl, 0)', 'pnl')} from calendar left join pd using (date) where date between date '1999-01-01' and date '2001-06-30'""",
    "path_final_pnl": f"with {TS}{TRADES} select t0, {_r('arg_max(pnl, date) * 7.3123', 'y')} from trades group by t0",
    "sizing_diagnostics": f"""with {TS_PREDS}{TRADES},
yy as (select t0, arg_max(pnl, date) * 7.3123 as y from trades group by t0),
b as (select unnest([-1, cast(year(t0) as int)]) as k, pred as w, y from preds as p join yy on yy.t0 = p.date where not is_train),
r as (select *, {_ar('w', 'k')} as a, {_ar('y', 'k')} as c from b)
select case when k >= 0 then k end as year, count(*) as n, {_r('avg(w)', 'mean_w')}, {_r(_pearson('w', 'y'), 'corr')}, {_r('case when count(*) >= 3 then ' + _pearson('a', 'c') + ' end', 'rank_ic')} from r group by k""",
    "decile_spread": f"""with {PREDS}, o as (select *, {_pr('pred', rows=True)} as pct from preds where not is_train),
d as (select t0, avg(y) filter (pct >= 0.9 - 1e-12) - avg(y) filter (pct <= 0.1 + 1e-12) as d from o group by t0)
select count(d) as n, {_r('avg(d)', 'mean')}, {_r('avg(d) * sqrt(count(d)) / nullif(stddev_samp(d), 0)', 't')} from d""",
    "ic_by_year": f"with {PREDS}, {_ics('preds', 'pred', 'y_rank', 't0, y_year', 'not is_train')} select y_year, {_r('avg(ic)', 'ic')} from ics group by y_year",
    "ts_ic_by_year": f"with {TS_PREDS}, {_ics('preds', 'pred', 'r_next', 'y_year', 'not is_train')} select y_year as year, {_r('ic', 'ic')}, n from ics",
    "per_date_ic": f"with {PREDS}, {_ics('preds', 'pred', 'y', 't0', 'not is_train')} select t0, {_r('ic', 'ic')} from ics where ic is not null",
    "fama_macbeth": f"""with {PREDS}, {_ics('preds', 'pred', 'y', 't0', 'not is_train')},
d as (select t0, ic, ic - avg(ic) over () as d from ics where ic is not null),
p as (select ic, d * d as p0, d * lag(d, 1) over w as p1, d * lag(d, 2) over w as p2, d * lag(d, 3) over w as p3 from d window w as (order by t0)),
v as (select count(*) as n, avg(ic) as m, stddev_samp(ic) as sd, greatest((sum(p0) + 1.5 * sum(p1) + sum(p2) + 0.5 * sum(p3)) / count(*), 0) as lrv from p)
select n as n_dates, {_r('m', 'mean_ic')}, {_r('sd', 'sd_ic')}, {_r('case when n >= 3 and lrv > 0 then m / sqrt(lrv / n) end', 't_nw')} from v""",
    "power_ic_volatility": f"""with {CS}, long as (select t0, y, 'f1' as feature, f1 as x from cs union all select t0, y, 'f2', f2 from cs union all select t0, y, 'f3', f3 from cs),
{_ics('long', 'x', 'y', 'feature, t0')} select feature, count(*) as n_dates, {_r('stddev_samp(ic)', 'sd_ic')} from ics where ic is not null group by feature having count(*) > 2""",
    "series_stats": f"""with {SERIES},
c as (select *, sum(pnl) over (partition by candidate order by date) as cum, row_number() over (partition by candidate order by pnl desc, date) as k from series),
u as (select *, cum - max(cum) over (partition by candidate order by date) as down from c)
select candidate, count(*) as n, {_r('avg(pnl)', 'mean')}, {_r('stddev_samp(pnl)', 'sd')}, {_r(_sharpe('pnl'), 'sharpe')}, {_r('sum(pnl)', 'total')}, {_r('min(down)', 'max_drawdown')},
{_r('sum(pnl) filter (k <= 5) / nullif(sum(pnl), 0)', 'top5_share')}, {_r('avg(pnl) filter (k > 5) / (stddev_samp(pnl) filter (k > 5) + 1e-12) * sqrt(12)', 'sharpe_without_top5')} from u group by candidate""",
    "sharpe_by_year": f"with {SERIES} select candidate, cast(year(date) as int) as period, count(*) as n, {_r(_sharpe('pnl'), 'sharpe')} from series group by 1, 2 having count(*) >= 12",
    "sharpe_by_half_year": f"with {SERIES} select candidate, year(date) || case when month(date) <= 6 then 'H1' else 'H2' end as period, count(*) as n, {_r(_sharpe('pnl'), 'sharpe')} from series group by 1, 2 having count(*) >= 6",
    "factor_attribution_1f": f"""with {SERIES}, m as (select date, round(avg(pnl), 10) as x from series group by date)
select candidate, count(*) as n, {_r('avg(pnl) - covar_pop(pnl, x) / nullif(var_pop(x), 0) * avg(x)', 'alpha')}, {_r('covar_pop(pnl, x) / nullif(var_pop(x), 0)', 'beta')},
{_r('coalesce(covar_pop(pnl, x) * covar_pop(pnl, x) / nullif(var_pop(x) * var_pop(pnl), 0), 0)', 'r2')} from series join m using (date) group by candidate""",
    "factor_attribution": f"""with {ALIGNED}, nm as (select candidate, row_number() over (order by candidate) as k from (select distinct candidate from aligned)),
w as (select date, max(pnl) filter (k = 1) as y, max(pnl) filter (k = 2) as a, max(pnl) filter (k = 3) as b from aligned join nm using (candidate) group by date),
m as (select count(*) as n, avg(y) as my, avg(a) as ma, avg(b) as mb from w),
c as (select date, y - my as y, a - ma as a, b - mb as b from w, m),
s as (select sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * y) as ay, sum(b * y) as byy, sum(y * y) as yy from c),
f as (select *, aa * bb - ab * ab as det, (bb * ay - ab * byy) / (aa * bb - ab * ab) as wa, (aa * byy - ab * ay) / (aa * bb - ab * ab) as wb from s),
u as (select date, y - wa * a - wb * b as e, (y - wa * a - wb * b) * a as p, (y - wa * a - wb * b) * b as q from c, f),
l as (select *, lag(e, 1) over o as e1, lag(e, 2) over o as e2, lag(e, 3) over o as e3, lag(p, 1) over o as p1, lag(p, 2) over o as p2, lag(p, 3) over o as p3,
  lag(q, 1) over o as q1, lag(q, 2) over o as q2, lag(q, 3) over o as q3 from u window o as (order by date)),
v as (select sum(e * e) as ee, {', '.join(f"sum({i} * {j}) + {' + '.join(f'{1 - g / 4} * sum({i} * {j}{g} + {j} * {i}{g})' for g in (1, 2, 3))} as w{i}{j}" for i, j in ('ee', 'ep', 'eq', 'pp', 'pq', 'qq'))} from l),
t as (select *, wee / (n * n) as v00, (wep * bb - weq * ab) / det / n as c01, (weq * aa - wep * ab) / det / n as c02,
  (bb * bb * wpp - 2 * ab * bb * wpq + ab * ab * wqq) / (det * det) as v1, (ab * ab * wpp - 2 * aa * ab * wpq + aa * aa * wqq) / (det * det) as v2,
  (-ab * bb * wpp + (aa * bb + ab * ab) * wpq - aa * ab * wqq) / (det * det) as c12 from m, f, v),
r as (select *, sqrt(n / (n - 3)) as up, my - wa * ma - wb * mb as alpha, v00 + ma * ma * v1 + mb * mb * v2 - 2 * ma * c01 - 2 * mb * c02 + 2 * ma * mb * c12 as v3 from t),
z as (select 'alpha' as term, n, alpha as coef, alpha / (sqrt(v3) * up) as t, cast(null as double) as corr, 1 - ee / yy as r2 from r
  union all select 'first', n, wa, wa / (sqrt(v1) * up), ay / sqrt(aa * yy), 1 - ee / yy from r
  union all select 'second', n, wb, wb / (sqrt(v2) * up), byy / sqrt(bb * yy), 1 - ee / yy from r)
select term, n, {_r('coef', 'coef')}, {_r('t', 't')}, {_r('corr', 'corr')}, {_r('r2', 'r2')} from z""",
    "return_moments": f"""with {SERIES}, d as (select candidate, pnl - avg(pnl) over (partition by candidate) as d from series)
select candidate, count(*) as n, {_r('avg(d * d * d) / pow(avg(d * d), 1.5)', 'skew')}, {_r('avg(d * d * d * d) / pow(avg(d * d), 2)', 'kurt')} from d group by candidate""",
    "deflated_sharpe": f"""with recursive {SERIES}, st as (select candidate, count(*) as n, {_sharpe('pnl')} as s from series group by candidate),
a as (select count(*) as k, min(n) as n, var_samp(s / sqrt(12)) as v, max(s) as top, arg_min(candidate, (-s, candidate)) as best from st),
it as (select 0 as step, q, p, cast(0 as double) as x from (select 1 as q, 1 - 1 / k as p from a union all select 2, 1 - 1 / (k * exp(1)) from a)
  union all select step + 1, q, p, x - ({_phi('x')} - p) * sqrt(2 * pi()) * exp(x * x / 2) from it where step < 30),
l as (select *, case when k > 1 and v > 0 then sqrt(v) * ((1 - 0.5772156649015329) * (select x from it where step = 30 and q = 1) + 0.5772156649015329 * (select x from it where step = 30 and q = 2)) else 0 end as luck, top / sqrt(12) as sr from a),
z as (select *, (sr - luck) * sqrt(greatest(n - 1, 1)) / sqrt(1 + sr * sr / 2) as x1, sr * sqrt(greatest(n - 1, 1)) / sqrt(1 + sr * sr / 2) as x0 from l)
select best, cast(k as int) as trials, {_r('top', 'sharpe')}, {_r('luck * sqrt(12)', 'expected_by_luck')}, {_r(_phi('x1'), 'probability')}, {_r(_phi('x0'), 'probability_above_zero')} from z""",
    "align_series": f"""with {SERIES}, s as (select * from series where candidate <> 'ASIA' or month(date) <> 5),
c as (select date from s group by date having count(distinct candidate) = (select count(distinct candidate) from s)) select candidate, date, pnl from s join c using (date)""",
    "walk_forward_selection": f"""with {_selection("case when y.candidate = 'ASIA' then 0.01 else 0 end")} select year, picked, {_r('past_sharpe', 'past_sharpe')}, {_r('year_sharpe', 'year_sharpe')} from picks""",
    "stitched_series": f"with {_selection('0')} select date, {_r('pnl', 'pnl')} from aligned as a join picks as p on p.picked = a.candidate and p.year = year(a.date)",
    "pbo_logits": f"""with {ALIGNED},
d as (select date, row_number() over (order by date) - 1 as k, count(*) over () as t from (select distinct date from aligned)),
e as (select b, round_even(t * b / 6, 0) as lo, round_even(t * (b + 1) / 6, 0) as hi from (select unnest(range(0, 6)) as b), (select any_value(t) as t from d)),
dealt as (select a.candidate, a.pnl, e.b from aligned as a join d using (date) join e on d.k >= e.lo and d.k < e.hi),
combos as (
  select row_number() over (order by a, b, c) - 1 as split, [a, b, c] as ins from (select unnest(range(0, 6)) as a), (select unnest(range(0, 6)) as b), (select unnest(range(0, 6)) as c)
  where a < b and b < c),
s as (
  select split, candidate, list_contains(ins, b) as inside, round(coalesce(avg(pnl) / nullif(stddev_samp(pnl), 0), 0) * sqrt(12), 12) as v from dealt, combos group by 1, 2, 3),
io as (select split, candidate, max(v) filter (inside) as i, max(v) filter (not inside) as o from s group by 1, 2),
p as (
  select *, row_number() over (partition by split order by i desc, candidate) as f, {_ar('o', 'split')} / (count(*) over (partition by split) + 1) as w from io)
select cast(split as int) as split, candidate as winner, {_r('ln(w / (1 - w))', 'logit')} from p where f = 1""",
    "holdout_dev": f"with {CS} select {_KEYS} from cs where t0 < date '2000-07-01'",
    "holdout_horizon": f"""with {CS}, h as (select t0, cast(t0 + interval 2 month as date) as z from cs)
select count(*) filter (z < date '2000-07-01') as n_dev, count(*) filter (t0 >= date '2000-07-01' and not z < date '2000-07-01') as n_held,
count(*) filter (not z < date '2000-07-01' and not t0 >= date '2000-07-01') as n_straddling from h""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
