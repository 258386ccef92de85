"""The SQL each registered query is checked against, written independently of the Spark plans."""

from __future__ import annotations

from surveyloom.operators.spaces import draw_params
from surveyloom.plans.cases import CASES_SQL, GAPPED_SQL, _digits_sql
from surveyloom.plans.registry import DRAWS, GIVEN, LINEAR_SCORE, RULES, SCALED, SHRINKING, SMOOTHING
from surveyloom.schema import CATEGORIES, FEATURES

COLUMNS = "case_id, district_name, district_code, gender, severity, diet, smoke, water, toilet, hard_access, label"
NUMERIC = [*FEATURES, "label"]
# The drawn candidates of the searches, as plain numbers.
SMOOTHINGS = [p["var_smoothing"] for p in draw_params(SMOOTHING, DRAWS, 42)]
SHRINKAGES = [p["shrinkage"] for p in draw_params(SHRINKING, DRAWS, 42)]


def _hash(key: str, seed: int) -> str:
    return f"md5(concat_ws(':', cast({key} as varchar), '{seed}'))"


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) as {name}"


SPLIT_SQL = (
    CASES_SQL
    + f""",
ranked as (select *, row_number() over (order by {_hash('case_id', 1)}) as rn, count(*) over () as n from cases),
marked as (select *, case when rn <= ceil(n * 0.2::double) then 'test' else 'train' end as split from ranked)"""
)

THREE_SQL = (
    SPLIT_SQL
    + """,
three as (select *, case when rn <= ceil(n * 0.2::double) then 'test'
    when rn <= ceil(n * 0.2::double) + ceil((n - ceil(n * 0.2::double)) * 0.2::double) then 'val'
    else 'train' end as part from ranked)"""
)

FOLD_SQL = (
    CASES_SQL
    + f""",
folded as (select *, cast(ntile(5) over (partition by label order by {_hash('case_id', 42)}) - 1 as int) as fold from cases)"""
)

JUDGED_SQL = (
    CASES_SQL
    + """,
judged as (select *, cast(case when severity >= 4 then 1 else 0 end as int) as prediction,
    (2 * severity + 3 * hard_access + 1.0::double) / 16.0::double as score from cases)"""
)

COUNTS = """sum(case when label = 1 and prediction = 1 then 1 else 0 end)::double as tp,
    sum(case when label = 0 and prediction = 1 then 1 else 0 end)::double as fp,
    sum(case when label = 1 and prediction = 0 then 1 else 0 end)::double as fn,
    sum(case when label = 0 and prediction = 0 then 1 else 0 end)::double as tn"""
F_POS = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)"
F_NEG = "coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)"
ACC = "(tp + tn) / (tp + fp + fn + tn)"
PREC = "coalesce(tp / nullif(tp + fp, 0), 0)"
REC = "coalesce(tp / nullif(tp + fn, 0), 0)"
F_W = f"({F_POS} * (tp + fn) + {F_NEG} * (tn + fp)) / (tp + fp + fn + tn)"
FIVE = ", ".join(
    [_r(ACC, "accuracy"), _r(PREC, "precision"), _r(REC, "recall"), _r(F_POS, "f1"), _r(F_W, "f1_weighted")]
)


def _rules_sql(source: str, by: str = "") -> str:
    group = f"{by}, " if by else ""
    parts = []
    for name, cut in RULES.items():
        inner = f"(select *, case when severity >= {cut} then 1 else 0 end as prediction from {source})"
        tail = f" group by {by}" if by else ""
        parts.append(f"select '{name}' as model, {group}{COUNTS} from {inner}{tail}")
    return " union all ".join(parts)


def _describe(source: str, cols: list[str], digits: int) -> str:
    parts = []
    for c in cols:
        v = f"cast({c} as double)"
        stats = [
            _r(f"avg({v})", "mean", digits),
            _r(f"stddev_samp({v})", "std", digits),
            _r(f"min({v})", "min", digits),
            _r(f"quantile_cont({v}, 0.25)", "q25", digits),
            _r(f"quantile_cont({v}, 0.5)", "q50", digits),
            _r(f"quantile_cont({v}, 0.75)", "q75", digits),
            _r(f"max({v})", "max", digits),
        ]
        parts.append(f"select '{c}' as feature, count({c}) as n, {', '.join(stats)} from {source}")
    return " union all ".join(parts)


def _rank_corr(source: str, cols: list[str], with_: str) -> str:
    """All ordered pairs: average ranks from two window counts, then plain correlation."""
    ranks = ", ".join(
        f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double as {c}" for c in cols
    )
    pairs = " union all ".join(
        f"select '{a}' as feature_x, '{b}' as feature_y, {_r(f'corr({a}, {b})', 'rho')} from ranks" for a in cols for b in cols
    )
    lead = f"{with_}, " if with_ else "with "
    return f"{lead}ranks as (select {ranks} from {source}), pairs as ({pairs}) select * from pairs"


def _long(source: str, cols: list[str]) -> str:
    return " union all ".join(
        f"select '{c}' as feature, cast({c} as varchar) as value, label from {source} where {c} is not null" for c in cols
    )


def _bayes() -> str:
    means = ", ".join(f"avg({c}) as m_{c}, var_pop({c}) as v_{c}" for c in FEATURES)
    largest = "greatest(" + ", ".join(f"var_pop({c})" for c in FEATURES) + ")"
    terms = " ".join(
        f"- 0.5::double * ln(2 * pi() * (v_{c} + extra)) - 0.5::double * ({c} - m_{c}) * ({c} - m_{c}) / (v_{c} + extra)"
        for c in FEATURES
    )
    return f"""{SPLIT_SQL},
stats as (select label as k, count(*) as cn, {means} from marked where split = 'train' group by label),
overall as (select count(*) as total, 1e-9::double * {largest} as extra from marked where split = 'train'),
scores as (select case_id, label, k, ln(cn / total::double) {terms} as ll from marked, stats, overall where split = 'test'),
margins as (select case_id, label, sum(case when k = 1 then ll else -ll end) as margin from scores group by case_id, label)
select case_id, label, case when margin > 0 then 1.0::double else 0.0::double end as prediction,
  {_r('1 / (1 + exp(-margin))', 'probability')} from margins"""


def _cv_bayes(smoothings: list[float], folds: int = 5) -> str:
    """means(trial, score, spread): weighted F1 of naive Bayes over the folds of the training rows, per smoothing."""
    order = _hash("case_id", 42)
    stats = ", ".join(f"avg({c}) as m_{c}, var_pop({c}) as v_{c}" for c in FEATURES)
    widest = ", ".join(f"var_pop({c})" for c in FEATURES)
    ll = " ".join(
        f"- 0.5::double * ln(2 * pi() * (v_{c} + extra)) - 0.5::double * ({c} - m_{c}) * ({c} - m_{c}) / (v_{c} + extra)" for c in FEATURES
    )
    trials = ", ".join(f"({i}, {s!r}::double)" for i, s in enumerate(smoothings))
    return f"""{SPLIT_SQL},
t as (select *, ntile({folds}) over (partition by label order by {order}) - 1 as fold from marked where split = 'train'),
held as (select unnest(range({folds})) as h),
trials(trial, smoothing) as (values {trials}),
stats as (select h, label as k, count(*) as cn, {stats} from t, held where fold != h group by h, label),
overall as (select h, trial, count(*) as total, any_value(smoothing) * greatest({widest}) as extra from t, held, trials where fold != h group by h, trial),
scores as (select t.case_id, t.label, o.trial, s.h, k, ln(cn / total::double) {ll} as ll
           from t join stats s on t.fold = s.h join overall o on o.h = s.h),
margins as (select case_id, label, trial, h, sum(case when k = 1 then ll else -ll end) as margin from scores group by all),
c as (select trial, h, count(*)::double as n, sum((label = 1 and margin > 0)::int)::double as tp, sum((label = 0 and margin > 0)::int)::double as fp,
             sum((label = 1 and margin <= 0)::int)::double as fn, sum((label = 0 and margin <= 0)::int)::double as tn from margins group by trial, h),
f as (select trial, h, (2 * tp / (2 * tp + fp + fn) * (tp + fn) + 2 * tn / (2 * tn + fp + fn) * (tn + fp)) / n as f1w from c),
means as (select trial, round(avg(f1w), 12) as score, stddev_pop(f1w) as spread from f group by trial)"""


def _eliminate(size: int, keys: tuple[str, ...] = (), first: str = "e", done: int = 0) -> str:
    """Tables ``e1`` ... that solve the systems of ``e0`` (keys, i, j, v; column ``size`` is the right side), a column at a time."""
    cols = "".join(f"e.{k}, " for k in keys)
    same = lambda t: "".join(f" and {t}.{k} = e.{k}" for k in keys)
    return ",\n".join(
        f"{first}{k + 1} as materialized (select {cols}e.i, e.j, case when e.i = {k} then e.v / p.v else e.v - l.v * r.v / p.v end as v from {first}{k} e "
        f"join {first}{k} p on p.i = {k} and p.j = {k}{same('p')} join {first}{k} l on l.i = e.i and l.j = {k}{same('l')} "
        f"join {first}{k} r on r.i = {k} and r.j = e.j{same('r')})"
        for k in range(size)
    )


def _cv_discriminant(shrinkages: list[float], folds: int = 5) -> str:
    """c(trial, h, tp, fp, fn, tn): linear discriminant analysis on the folds of the training rows, per shrinkage."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    name = lambda i, j: f"c_{min(i, j)}_{max(i, j)}"
    covs = ", ".join(f"covar_pop({FEATURES[i]}, {FEATURES[j]}) as {name(i, j)}" for i, j in pairs)
    pooled = ", ".join(f"sum(n * {name(i, j)}) / sum(n) as {name(i, j)}" for i, j in pairs)
    spread = ", ".join(f"stddev_pop({c}) as s_{i}, avg({c}) as a_{i}" for i, c in enumerate(FEATURES))
    cells = " union all ".join(f"select h, {i} as i, {j} as j, {name(i, j)} / (s_{i} * s_{j}) as v from pooled join spread using (h)" for i in range(d) for j in range(d))
    class_means = ", ".join(f"avg({c}) as m_{i}" for i, c in enumerate(FEATURES))
    gaps = " union all ".join(
        f"select a.h, {i} as f, (b.m_{i} - a.m_{i}) / s_{i} as gap, (a.m_{i} + b.m_{i} - 2 * a_{i}) / s_{i} as both_m, ln(b.n / a.n) as odds "
        f"from class_means a join class_means b on a.h = b.h and a.label = 0 and b.label = 1 join spread s on s.h = a.h"
        for i in range(d)
    )
    trials = ", ".join(f"({t}, {s!r}::double)" for t, s in enumerate(shrinkages))
    wide = ", ".join(f"max(w) filter (where f = {i}) as w_{i}" for i in range(d))
    margin = " + ".join(f"w_{i} * ({c} - a_{i}) / s_{i}" for i, c in enumerate(FEATURES))
    return f"""{SPLIT_SQL},
t as (select *, ntile({folds}) over (partition by label order by {_hash("case_id", 42)}) - 1 as fold from marked where split = 'train'),
held as (select unnest(range({folds})) as h),
trials(trial, lam) as (values {trials}),
spread as (select h, {spread} from t, held where fold != h group by h),
class_means as (select h, label, count(*)::double as n, {class_means} from t, held where fold != h group by h, label),
within as (select h, label, count(*)::double as n, {covs} from t, held where fold != h group by h, label),
pooled as (select h, {pooled} from within group by h),
cov as ({cells}),
gap as ({gaps}),
e0 as (select trial, h, i, j, (1 - lam) * v + case when i = j then lam / {d} * sum(case when i = j then v end) over (partition by trial, h) else 0 end as v
       from cov, trials union all select trial, h, f, {d}, gap from gap, trials),
{_eliminate(d, ("trial", "h"))},
w as (select trial, h, i as f, v as w from e{d} where j = {d}),
coefs as (select trial, h, {wide}, -0.5::double * sum(both_m * w) + max(odds) as b from w join gap using (h, f) group by trial, h),
margins as (select case_id, label, trial, k.h, {margin} + b as margin from t join coefs k on t.fold = k.h join spread s on s.h = k.h),
c as (select trial, h, count(*)::double as n, sum((label = 1 and margin > 0)::int)::double as tp, sum((label = 0 and margin > 0)::int)::double as fp,
             sum((label = 1 and margin <= 0)::int)::double as fn, sum((label = 0 and margin <= 0)::int)::double as tn from margins group by trial, h)"""


def _tuned() -> str:
    f1 = _r("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)", "score")
    parts = [("Naive Bayes", _cv_bayes(SMOOTHINGS)), ("LDA", _cv_discriminant(SHRINKAGES))]
    return " union all ".join(f"select * from ({sql} select '{m}' as model, trial::int as trial, h::int as fold, {f1} from c)" for m, sql in parts)


def _best_report() -> str:
    """The shrinkage of the best mean weighted F1, and the report of its fit on all training rows."""
    best = f"""({_cv_discriminant(SHRINKAGES)},
f as (select trial, (2 * tp / (2 * tp + fp + fn) * (tp + fn) + 2 * tn / (2 * tn + fp + fn) * (tn + fp)) / n as f1w from c)
select lam from (select trial, round(avg(f1w), 12) as score from f group by trial) join trials using (trial) order by score desc, trial limit 1)"""
    judged = _discriminant(f"(select lam from {best})")
    return f"""with judged as materialized ({judged}),
c as (select {COUNTS} from judged),
per as (select '1' as class_name, {PREC} as precision, {REC} as recall, {F_POS} as f1, tp + fn as support from c
  union all select '0', coalesce(tn / nullif(tn + fn, 0), 0), coalesce(tn / nullif(tn + fp, 0), 0), {F_NEG}, tn + fp from c),
every as (select * from per union all
  select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from per union all
  select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) from per union all
  select 'actual ' || label || ', predicted ' || prediction::int, null, null, null, count(*) from judged group by label, prediction)
select class_name, {_r('precision', 'precision')}, {_r('recall', 'recall')}, {_r('f1', 'f1')}, support::bigint as support from every"""


def _logistic(steps: int = 9) -> str:
    """Newton steps on the sum of the log losses and half the squared weights; each system is solved by elimination."""
    d = len(FEATURES)
    x = [*FEATURES, "1.0::double"]
    cells = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    parts = []
    for k in range(steps):
        margin = " + ".join(f"w_{i} * {c}" for i, c in enumerate(x))
        sums = ", ".join([*(f"sum(p * (1 - p) * {x[i]} * {x[j]}) as h_{i}_{j}" for i, j in cells), *(f"sum((p - label) * {c}) as g_{i}" for i, c in enumerate(x))])
        entries = [f"select {i} as i, {j} as j, h_{min(i, j)}_{max(i, j)}{' + 1' if i == j < d else ''} as v from s{k}" for i in range(d + 1) for j in range(d + 1)]
        entries += [f"select {i}, {d + 1}, -(g_{i}{f' + w_{i}' if i < d else ''}) from s{k}, w{k}" for i in range(d + 1)]
        moved = ", ".join(f"w_{i} + (select v from n{k}_{d + 1} where i = {i} and j = {d + 1}) as w_{i}" for i in range(d + 1))
        parts += [
            f"p{k} as materialized (select *, 1 / (1 + exp(-({margin}))) as p from marked, w{k} where split = 'train')",
            f"s{k} as materialized (select {sums} from p{k})",
            f"n{k}_0 as materialized ({' union all '.join(entries)})",
            _eliminate(d + 1, first=f"n{k}_"),
            f"w{k + 1} as materialized (select {moved} from w{k})",
        ]
    margin = " + ".join(f"w_{i} * {c}" for i, c in enumerate(x))
    start = ", ".join(f"0.0::double as w_{i}" for i in range(d + 1))
    return f"""{SPLIT_SQL},
w0 as (select {start}),
{", ".join(parts)},
margins as (select case_id, label, {margin} as margin from marked, w{steps} where split = 'test')
select case_id, label, case when margin > 0 then 1.0::double else 0.0::double end as prediction, {_r('1 / (1 + exp(-margin))', 'probability')} from margins"""


def _stumps(rounds: int = 5, rate: float = 0.3) -> str:
    """Adaptive boosting of stumps; ties within a billionth go to the first feature and the lowest threshold."""
    long = " union all ".join(f"select case_id, label, {i} as f, {c}::double as v from marked where split = 'train'" for i, c in enumerate(FEATURES))
    parts = ["w0 as (select case_id, 1.0::double as w from marked where split = 'train')"]
    for k in range(rounds):
        parts += [
            f"h{k} as (select f, v, sum(case when label = 1 then w else 0 end) as p, sum(case when label = 0 then w else 0 end) as n from x join w{k} using (case_id) group by f, v)",
            f"r{k} as (select f, v, (v + lead(v) over o) / 2 as cut, sum(p) over o as lp, sum(n) over o as ln, sum(p) over (partition by f) as tp, "
            f"sum(n) over (partition by f) as tn from h{k} window o as (partition by f order by v))",
            f"i{k} as (select *, lp * ln / (lp + ln) + (tp - lp) * (tn - ln) / (tp - lp + tn - ln) as impurity from r{k} where cut is not null)",
            f"b{k} as materialized (select f, cut, case when lp > ln then 1 else 0 end as l, case when tp - lp > tn - ln then 1 else 0 end as r from i{k} "
            f"where impurity <= (select min(impurity) from i{k}) * (1 + 1e-9::double) order by f, cut limit 1)",
            f"q{k} as materialized (select case_id, w, (case when v <= cut then l else r end != label)::int as wrong from x join b{k} using (f) join w{k} using (case_id))",
            f"a{k} as materialized (select {rate}::double * ln((1 - e) / e) as alpha from (select sum(w * wrong) / sum(w) as e from q{k}))",
            f"w{k + 1} as materialized (select case_id, w * exp(alpha * wrong) as w from q{k}, a{k})",
        ]
    names = ", ".join(f"'{c}'" for c in FEATURES)
    rows = " union all ".join(f"select {k + 1}::int as round, list_extract([{names}], f + 1) as feature, cut as threshold, {_r('alpha', 'alpha')} from b{k}, a{k}" for k in range(rounds))
    return f"{SPLIT_SQL}, x as materialized ({long}), {', '.join(parts)} {rows}"


def _tree(depth: int = 5) -> str:
    """A decision tree by Gini impurity, level by level, with thresholds halfway between values; sibling leaves of one class are joined."""
    gini = lambda p, n: f"(1 - ({p} * {p} + {n} * {n})::double / (({p} + {n}) * ({p} + {n})))"
    parts = ["t0 as materialized (select *, 1 as n0 from marked)"]
    for k in range(depth):
        long = " union all ".join(f"select n{k} as node, {i} as f, {c} as v, label from t{k} where split = 'train' and n{k} is not null" for i, c in enumerate(FEATURES))
        moved = " ".join(f"when b.f = {i} then ({c} > cut)::int" for i, c in enumerate(FEATURES))
        parts += [
            f"h{k} as (select node, f, v, sum(label) as p, sum(1 - label) as n from ({long}) group by node, f, v)",
            f"r{k} as (select node, f, (v + lead(v) over o) / 2.0::double as cut, sum(p) over o as lp, sum(n) over o as ln, sum(p) over (partition by node, f) as tp, "
            f"sum(n) over (partition by node, f) as tn from h{k} window o as (partition by node, f order by v))",
            f"g{k} as (select node, f, cut, {gini('tp', 'tn')} - (lp + ln) / (tp + tn) * {gini('lp', 'ln')} - (tp + tn - lp - ln) / (tp + tn) * {gini('(tp - lp)', '(tn - ln)')} as gain "
            f"from (select node, f, cut, lp::double as lp, ln::double as ln, tp::double as tp, tn::double as tn from r{k} where cut is not null))",
            f"b{k} as materialized (select * from g{k} where gain > 1e-15::double qualify row_number() over (partition by node order by round(gain, 12) desc, f, cut) = 1)",
            f"t{k + 1} as materialized (select t.*, case when b.f is not null then 2 * n{k} + (case {moved} end) end as n{k + 1} from t{k} t left join b{k} b on b.node = n{k})",
        ]
    for k in range(depth, -1, -1):
        counts = f"c{k} as materialized (select n{k} as node, sum(label)::double as p, sum(1 - label)::double as n from t{depth} where split = 'train' and n{k} is not null group by n{k})"
        if k == depth:
            leaf = f"l{k} as materialized (select node, p, n, true as leaf from c{k})"
        else:
            leaf = (
                f"l{k} as materialized (select c.node, c.p, c.n, b.f is null or (x.leaf and y.leaf and (x.p > x.n) = (y.p > y.n)) as leaf from c{k} c "
                f"left join b{k} b on b.node = c.node left join l{k + 1} x on x.node = 2 * c.node left join l{k + 1} y on y.node = 2 * c.node + 1)"
            )
        parts += [counts, leaf]
    joins = " ".join(f"left join l{k} on l{k}.node = n{k}" for k in range(depth + 1))
    share = "case " + " ".join(f"when l{k}.leaf then l{k}.p / (l{k}.p + l{k}.n)" for k in range(depth + 1)) + " end"
    return f"""{SPLIT_SQL}, {", ".join(parts)},
scored as (select case_id, label, {share} as share from t{depth} {joins} where split = 'test')
select case_id, label, case when share > 0.5 then 1.0::double else 0.0::double end as prediction, {_r('share', 'probability')} from scored"""


def _discriminant(shrinkage: str) -> str:
    """Linear discriminant analysis; the linear system is solved by elimination, a column at a time."""
    d = len(FEATURES)
    moments = ", ".join(f"avg({c}) as a_{c}, stddev_pop({c}) as s_{c}" for c in FEATURES)
    long = " union all ".join(f"select case_id, label, split, {i} as f, ({c} - a_{c}) / s_{c} as z from marked, moments" for i, c in enumerate(FEATURES))
    return f"""{SPLIT_SQL},
moments as (select {moments} from marked where split = 'train'),
z as ({long}),
m as (select f, label, avg(z) as m, count(*)::double as n from z where split = 'train' group by f, label),
centred as (select case_id, z.f, z - m as z from z join m on z.f = m.f and z.label = m.label where split = 'train'),
cov as (select a.f as i, b.f as j, sum(a.z * b.z) / (select sum(n) from m where f = 0) as v
        from centred a join centred b on a.case_id = b.case_id group by a.f, b.f),
gap as (select a.f, b.m - a.m as gap, a.m + b.m as both_m, ln(b.n / a.n) as odds from m a join m b on a.f = b.f and a.label = 0 and b.label = 1),
e0 as (select i, j, (1 - {shrinkage}) * v + case when i = j then {shrinkage} / {d} * (select sum(v) from cov where i = j) else 0 end as v from cov
       union all select f, {d}, gap from gap),
{_eliminate(d)},
w as (select i as f, v as w from e{d} where j = {d}),
b as (select -0.5::double * sum(both_m * w) + max(odds) as b from w join gap using (f)),
margins as (select case_id, label, sum(z * w) + any_value(b) as margin from z join w using (f), b where split = 'test' group by case_id, label)
select case_id, label, case when margin > 0 then 1.0::double else 0.0::double end as prediction,
  {_r('1 / (1 + exp(-margin))', 'probability')} from margins"""


def _linear(tail: str) -> str:
    means = ", ".join(f"avg({c}) as m_{c}" for c in LINEAR_SCORE)
    base = "-10.0::double + " + " + ".join(f"({w}::double) * m_{c}" for c, w in LINEAR_SCORE.items())
    parts = " union all ".join(
        f"select case_id, '{c}' as feature, {c}::double as value, ({w}::double) * ({c} - m_{c}) as contribution, {base} as base "
        f"from marked, means where split = 'test'"
        for c, w in LINEAR_SCORE.items()
    )
    return f"""{SPLIT_SQL},
means as (select {means} from marked where split = 'train'),
contrib as ({parts}) {tail}"""


def _info() -> str:
    types = ["bigint", "string", *["int"] * 9]
    return " union all ".join(
        f"select {i}::int as position, '{c}' as column_name, '{t}' as data_type, count({c}) as non_null from gapped"
        for i, (c, t) in enumerate(zip(COLUMNS.split(", "), types))
    )


def _null_report() -> str:
    parts = " union all ".join(
        f"select '{c}' as column_name, count(*) - count({c}) as n_null, count(*) as n from gapped" for c in COLUMNS.split(", ")
    )
    return f"select column_name, n_null, {_r('100.0::double * n_null / n', 'pct_null')} from ({parts}) where n_null > 0"


def _series() -> str:
    parts = []
    for unit, fmt in (("day", "%Y-%m-%d"), ("month", "%Y-%m"), ("year", "%Y")):
        text = f"case when {_digits_sql('date')} % 19 = 0 then '2024-02-30x' else strftime(o_orderdate, '{fmt}') end"
        parts.append(
            f"select o_orderkey, try_strptime({text}, '{fmt}') as date, o_totalprice as value, '{unit}' as unit from orders"
        )
    return f"select * from ({' union all '.join(parts)}) where date is not null"


N_COLUMNS = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
    "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}

LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]

ORACLES: dict[str, str] = {
    "load_cases": f"{CASES_SQL} select {COLUMNS} from cases",
    "canonical_rename": """select o_orderkey as row_key, o_custkey as owner, o_orderstatus as state,
        o_totalprice as amount, o_orderdate as day, o_orderpriority as urgency from orders""",
    "table_replace": f"""{CASES_SQL} select district_name, gender, severity, diet, smoke, water, toilet, hard_access,
        label from cases""",
    "append_distinct": f"{CASES_SQL} select distinct district_name, severity, label from cases",
    "list_tables": " union all ".join(
        f"select '{t}' as table_name, count(*) as n_rows, {N_COLUMNS[t]}::bigint as n_columns from {t}" for t in GIVEN
    ),
    "list_base_tables": f"""{CASES_SQL}
        select 'surveyloom_rows' as table_name, count(*) as n_rows, 11::bigint as n_columns from cases union all
        select 'surveyloom_counts', count(*), 3::bigint from (select distinct district_name, label from cases)""",
    "drop_columns": f"""{CASES_SQL} select district_name, gender, severity, diet, smoke, water, toilet, hard_access,
        label from cases""",
    "numeric_columns": f"""{CASES_SQL} select case_id, district_code, gender, severity, diet, smoke, water, toilet,
        hard_access, label from cases""",
    "head_n": f"{CASES_SQL} select {COLUMNS} from cases order by case_id limit 5",
    "sample_n": f"{CASES_SQL} select {COLUMNS} from cases order by {_hash('case_id', 3)} limit 50",
    "sample_range": f"""{CASES_SQL}, placed as (select row_number() over (order by case_id) - 1 as position, * from cases)
        select position, case_id, severity, label from placed where position between 10 and 1010
        order by {_hash('position', 2)} limit 30""",
    "rows_by_key": f"{CASES_SQL} select {COLUMNS} from cases order by {_hash('case_id', 5)} limit 40",
    "shape": f"{CASES_SQL} select count(*) as n_rows, 11::bigint as n_columns from cases",
    "column_info": f"{GAPPED_SQL} {_info()}",
    "label_names": f"""{CASES_SQL} select case_id, case label when 0 then 'not affected' else 'affected' end as label_name
        from cases""",
    "forecast_band": """select o_orderdate as date, o_totalprice as original, o_totalprice * 0.5::double as predicted,
        o_totalprice * 0.75::double as upper, o_totalprice * 0.25::double as lower from orders""",
    "align_xy": f"{CASES_SQL} select case_id, {', '.join(FEATURES)}, label from cases",
    "describe_numeric": _describe("lineitem", LINEITEM, 4),
    "describe_cases": f"{GAPPED_SQL} {_describe('gapped', NUMERIC, 6)}",
    "null_report": f"{GAPPED_SQL} {_null_report()}",
    "group_count": f"""{GAPPED_SQL} select district_name, severity, count(*) as n from gapped
        where district_name is not null and severity is not null group by all""",
    "value_share": f"""{GAPPED_SQL} select severity, count(*) as n,
        {_r('count(*)::double / (select count(severity) from gapped)', 'share')} from gapped
        where severity is not null group by severity""",
    "count_share_all": f"""{GAPPED_SQL} select severity, count(*) as n,
        {_r('count(*)::double / (select count(*) from gapped)', 'share')} from gapped
        where severity is not null group by severity""",
    "class_value_share": f"""{GAPPED_SQL}, long as ({_long('gapped', CATEGORIES)}),
        counted as (select feature, label, value, count(*) as n from long group by all)
        select feature, label, value, n, {_r('n::double / sum(n) over (partition by feature, label)', 'share')} from counted""",
    "feature_label_counts": f"""{GAPPED_SQL}, long as ({_long('gapped', CATEGORIES)})
        select feature, value, label, count(*) as n from long group by all""",
    "crosstab": f"""{CASES_SQL} select district_name, count(*) filter (where label = 0) as negative,
        count(*) filter (where label = 1) as positive from cases group by district_name""",
    "spearman_matrix": _rank_corr("cases", NUMERIC, CASES_SQL),
    "spearman_continuous": _rank_corr("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ""),
    "high_corr_pairs": _rank_corr("cases", NUMERIC, CASES_SQL) + " where feature_x < feature_y and abs(rho) > 0.5",
    "bucket_rank": """select o_orderkey, o_orderstatus, o_totalprice,
        rank() over (partition by o_orderstatus order by o_totalprice)
        + (count(*) over (partition by o_orderstatus, o_totalprice) - 1) / 2.0::double as avg_rank from orders""",
    "parse_series": _series(),
    "factorize": """with e as (select event_id, case when event_id % 7 <> 3 then event_type end as event_type from events),
        firsts as (select event_type, row_number() over (order by min(event_id)) - 1 as c from e
                   where event_type is not null group by event_type)
        select e.event_id, e.event_type, cast(coalesce(c, -1) as int) as code from e left join firsts using (event_type)""",
    "district_dim": f"""{CASES_SQL} select district_name, cast(row_number() over (order by min(case_id)) - 1 as int) as code
        from cases group by district_name""",
    "standardize": f"""{CASES_SQL}, m as (select {', '.join(f'avg({c}) as m_{c}, stddev_pop({c}) as s_{c}' for c in SCALED)}
        from cases) select case_id, {', '.join(_r(f'({c} - m_{c}) / s_{c}', c) for c in SCALED)} from cases, m""",
    "accuracy": f"{JUDGED_SQL}, c as (select {COUNTS} from judged) select {_r(ACC, 'accuracy')} from c",
    "binary_metrics": f"""{JUDGED_SQL}, c as (select district_name, {COUNTS} from judged group by district_name)
        select district_name, {FIVE} from c""",
    "class_report": f"""{JUDGED_SQL}, c as (select {COUNTS} from judged),
        per as (select 'affected' as class_name, {PREC} as precision, {REC} as recall, {F_POS} as f1, tp + fn as support from c
          union all select 'not affected', coalesce(tn / nullif(tn + fn, 0), 0), coalesce(tn / nullif(tn + fp, 0), 0),
          {F_NEG}, tn + fp from c),
        every as (select * from per union all
          select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from per union all
          select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
            sum(f1 * support) / sum(support), sum(support) from per)
        select class_name, {_r('precision', 'precision')}, {_r('recall', 'recall')}, {_r('f1', 'f1')},
          support::bigint as support from every""",
    "confusion_matrix": f"""{JUDGED_SQL}, grid as (select a::int as actual, p::int as predicted
        from (values (0), (1)) x(a), (values (0), (1)) y(p))
        select actual, predicted, count(case_id) as n from grid left join judged
        on label = actual and prediction = predicted group by actual, predicted""",
    "f1_weighted": f"{JUDGED_SQL}, c as (select {COUNTS} from judged) select {_r(F_W, 'f1_weighted')} from c",
    "roc_auc": f"""{JUDGED_SQL}, r as (select label, rank() over (order by score)
          + (count(*) over (partition by score) - 1) / 2.0::double as rk from judged),
        s as (select sum(case when label = 1 then rk end) as rs, sum(label)::double as p, (count(*) - sum(label))::double as q
          from r) select {_r('(rs - p * (p + 1) / 2) / (p * q)', 'auc')} from s""",
    "log_loss": f"""{JUDGED_SQL},
        clipped as (select label, least(greatest(score, 1e-15::double), 1 - 1e-15::double) as p from judged)
        select {_r('avg(-(label * ln(p) + (1 - label) * ln(1 - p)))', 'log_loss')} from clipped""",
    "cv_summary": f"""{FOLD_SQL}, c as ({_rules_sql('folded', 'fold')}),
        s as (select model, {ACC} as a from c)
        select model, {_r('avg(a)', 'cv_mean', 4)}, {_r('stddev_pop(a)', 'cv_std', 4)} from s group by model""",
    "best_model": f"""{CASES_SQL}, c as ({_rules_sql('cases')}), s as (select model, {FIVE} from c)
        select * from s order by accuracy desc, model limit 1""",
    "union_metrics": f"""{CASES_SQL}, c as ({_rules_sql('cases')}), s as (select model, {FIVE} from c)
        select model, accuracy, case when model = 'severity>=3' then f1 end as f1 from s
        where model in ('severity>=3', 'severity>=4')""",
    "train_test_split": f"{SPLIT_SQL} select case_id, label, split from marked",
    "stratified_split": f"""{CASES_SQL},
        sizes as (select label, count(*) as cn, sum(count(*)) over () as total from cases group by label),
        shares as (select label, cn, ceil(total * 0.2::double)::bigint as m, total::bigint as total from sizes),
        floors as (select label, (cn * m) // total as q, (cn * m) % total as rest, m from shares),
        quotas as (select label, q + case when row_number() over (order by rest desc, label) <= m - sum(q) over ()
          then 1 else 0 end as quota from floors),
        r as (select case_id, label, row_number() over (partition by label order by {_hash('case_id', 1)}) as rn from cases)
        select case_id, label, case when rn <= quota then 'test' else 'train' end as split from r join quotas using (label)""",
    "three_way_split": f"{THREE_SQL} select case_id, label, part as split from three",
    "stratified_kfold": f"{FOLD_SQL} select case_id, label, fold from folded",
    "split_counts": f"""{THREE_SQL} select part as split, count(*) as n,
        {_r('count(*)::double / (select count(*) from three)', 'share')} from three group by part""",
    "gaussian_nb": _bayes(),
    "lda_fit": _discriminant("0.1::double"),
    "logreg_fit": _logistic(),
    "dt_fit": _tree(),
    "adaboost_rounds": _stumps(),
    "tune_random": _tuned(),
    "best_report": _best_report(),
    "cv_score": f"""{_cv_bayes([1e-9])}
        select 'Naive Bayes' as model, round(score, 4) as cv_mean, round(spread, 4) as cv_std from means""",
    "best_trial": f"""{_cv_bayes(SMOOTHINGS)}
        select 'Naive Bayes' as model, cast(trial as int) as trial, round(score, 6) as score,
               round(list_extract([{', '.join(f'{x!r}::double' for x in SMOOTHINGS)}], trial + 1), 6) as var_smoothing
        from means order by score desc, trial limit 1""",
    "knn_predict": f"""with ranked as (select vec_id, label, embedding::double[] as x,
          row_number() over (order by {_hash('vec_id', 1)}) as rn, count(*) over () as n from embeddings),
        marked as (select *, rn <= ceil(n * 0.2::double) as is_test from ranked),
        near as (select q.vec_id, q.label, t.label as other, row_number() over (partition by q.vec_id
          order by list_distance(q.x, t.x), t.vec_id) as place from marked q, marked t where q.is_test and not t.is_test),
        votes as (select vec_id, label, other, count(*) as v from near where place <= 5 group by all)
        select vec_id, label, prediction::double as prediction from (select vec_id, label, other as prediction,
          row_number() over (partition by vec_id order by v desc, other) as best from votes) where best = 1""",
    "knn_cases": f"""{SPLIT_SQL},
        near as (select q.case_id, q.label, t.label as other, row_number() over (partition by q.case_id
          order by {' + '.join(f'abs(q.{c} - t.{c})' for c in FEATURES)}, t.case_id) as place
          from marked q, marked t where q.split = 'test' and t.split = 'train' qualify place <= 7),
        votes as (select case_id, label, sum(other) as ones from near group by all)
        select case_id, label, case when ones > 3.5 then 1.0::double else 0.0::double end as prediction,
          {_r('ones / 7.0::double', 'probability')} from votes""",
    "shapley_linear": _linear(
        f"""select case_id, feature, value, {_r('contribution', 'contribution')}, {_r('base', 'base')} from contrib"""
    ),
    "shapley_summary": _linear(
        f"""select feature, {_r('avg(abs(contribution))', 'mean_abs')},
        {_r('covar_pop(value, contribution) / nullif(stddev_pop(value) * stddev_pop(contribution), 0)', 'value_corr')},
        {', '.join(_r(f'quantile_cont(contribution, {p}::double)', n) for p, n in
                   ((0.05, 'q05'), (0.25, 'q25'), (0.5, 'q50'), (0.75, 'q75'), (0.95, 'q95')))}
        from contrib group by feature"""
    ),
    "force_rows": _linear(
        f""", picked as (select case_id from marked where split = 'test' order by {_hash('case_id', 2)} limit 30),
        sums as (select case_id, min(base) + sum(contribution) as score from contrib group by case_id)
        select case_id, feature, value, {_r('contribution', 'contribution')}, {_r('base', 'base')}, {_r('score', 'score')}
        from contrib join picked using (case_id) join sums using (case_id)"""
    ),
    "dependence": _linear(
        f"""select feature, value, {_r('avg(contribution)', 'contribution')}, count(*) as n from contrib group by feature, value"""
    ),
}
