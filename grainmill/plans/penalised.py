"""Penalised linear models tuned over folds and refitted. The SQL runs the same coordinate descent on the same sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import text as tx
from grainmill.operators import linear, metrics, resample
from grainmill.operators.scale import settle
from grainmill.plans.registry import query
from grainmill.plans.roles import HOUSES, LABELLED, RIDES, houses, labelled, r, rides
from grainmill.session import fresh_path
from grainmill.sources import files

FOLDS = 5
#: 25 penalties for one mixture, 5 by 5 points for both, 5 by 5 for the rentals.
PENALTIES = linear.penalty_grid(-5, 0, 25)
FIVE = linear.penalty_grid(-5, 0, 5)
MIXES = [0.01, 0.245, 0.48, 0.715, 0.95]
RENTAL_FIVE = linear.penalty_grid(-10, 0, 5)
RENTAL_MIXES = [0.0, 0.25, 0.5, 0.75, 1.0]


def in_train_sql(id_: str, seed: int) -> str:
    return f"cast('0x' || substr(md5({id_} || ':{seed}'), 1, 8) as bigint) < 3221225472"


def fold_sql(id_: str, seed: int) -> str:
    return f"(cast('0x' || substr(md5({id_} || ':{seed}'), 1, 8) as bigint) % {FOLDS})::int"


def tuned_sql(rows, columns, levels, penalties, mixes, sweeps=100):
    """CTEs over `rows` (a CTE list that ends with h: id, y, train, fold, columns): means of the errors, fit of the best point,
    scored (id, y, train, pred). Coordinate descent is a fold over the steps of all sweeps; state: coefficients, then residuals."""
    folds = FOLDS
    dummy = ", ".join(f"list_transform(lv.{c}[2:], lambda l: (h.{c} = l)::double)" for c in levels)
    lists = ", ".join(f"list_sort(list(distinct {c})) as {c}" for c in levels)
    x = f"list_concat([1.0::double], [{', '.join(f'({c})::double' for c in columns)}]" + (f", {dummy}" if levels else "") + ", [y::double])"
    gj = "g[(k[1]::int % p) * p + k[1]::int % p + 1]"
    if any(mixes):  # one step of coordinate descent after another
        solved = f"""solved as (select t, mix, penalty, list_reduce(list_transform(range(0, {sweeps} * p), lambda q: [q::double]), lambda s, k:
      list_transform(s, lambda e, i: case
        when i = k[1]::int % p + 1 then sign(s[p + i] + {gj} * e) * greatest(abs(s[p + i] + {gj} * e) - penalty * mix, 0) / ({gj} + penalty * (1 - mix))
        when i > p then e - g[(k[1]::int % p) * p + i - p] * (
          sign(s[p + k[1]::int % p + 1] + {gj} * s[k[1]::int % p + 1]) * greatest(abs(s[p + k[1]::int % p + 1] + {gj} * s[k[1]::int % p + 1]) - penalty * mix, 0)
          / ({gj} + penalty * (1 - mix)) - s[k[1]::int % p + 1])
        else e end),
      list_concat(list_transform(c, lambda e: 0::double), c)) as s, p from mats, points)"""
    else:  # without the absolute part the equations are linear: elimination, one column after another
        at = "(((o - 1) // (p + 1)) * (p + 1) + k[1]::int)"
        solved = f"""solved as (select t, mix, penalty, list_transform(range(1, p + 1), lambda i: m[i * (p + 1)]) as s, p from (
      select t, mix, penalty, p, list_reduce(list_transform(range(1, p + 1), lambda q: [q::double]), lambda s, k:
        list_transform(s, lambda e, o: case when (o - 1) // (p + 1) + 1 = k[1]::int then e / s[(k[1]::int - 1) * (p + 1) + k[1]::int]
          else e - s[{at}] * s[(k[1]::int - 1) * (p + 1) + (o - 1) % (p + 1) + 1] / s[(k[1]::int - 1) * (p + 1) + k[1]::int] end),
        list_transform(range(1, p * (p + 1) + 1), lambda o: case when (o - 1) % (p + 1) < p
          then g[((o - 1) // (p + 1)) * p + (o - 1) % (p + 1) + 1] + case when (o - 1) // (p + 1) = (o - 1) % (p + 1) then penalty else 0 end
          else c[(o - 1) // (p + 1) + 1] end)) as m from mats, points))"""
    return f"""{rows},
  lv as (select {lists or 'count(*) as n'} from h where train),
  xs as (select id, train, fold, y, {x} as x from h, lv),
  w as (select any_value(len(x)) as w from xs),
  sums as (select fold, i, j, sum(x[i] * x[j]) as s from xs, w, range(1, w + 1) a(i), range(1, w + 1) b(j) where train group by all),
  sets as (select t, i, j, sum(s) filter (fold <> t) as s, sum(s) filter (t = -1 or fold = t) as h from sums, range(-1, {folds}) a(t) group by all),
  sides as (select t, i, max(s) filter (j = 1) as total, max(s) filter (i = j) as square from sets group by t, i),
  counts as (select t, total as n from sides where i = 1),
  marks as (select t, i, total / n as m, case when square / n - (total / n) * (total / n) > 1e-12 * square / n
            then sqrt(square / n - (total / n) * (total / n)) end as d from sides join counts using (t)),
  unit as (select e.t, e.i, e.j, coalesce((s / n - a.m * b.m) / a.d / case when e.j = w then 1 else b.d end, 0) as v
    from sets e join counts using (t) join marks a on a.t = e.t and a.i = e.i join marks b on b.t = e.t and b.i = e.j, w
    where e.i > 1 and e.i < w and e.j > 1),
  mats as (select t, list(v order by i, j) filter (j < w) as g, list(v order by i) filter (j = w) as c, any_value(w) - 2 as p
    from unit, w group by t),
  points as (select unnest({[float(q) for q in penalties]!r}) ::double as penalty, mix from (select unnest({[float(m) for m in mixes]!r})::double as mix)),
  {solved},
  scaled as (select t, mix, penalty, i, coalesce(s[i - 1] / d, 0) as b, m from solved join marks using (t), w where i > 1 and i < w),
  fits as (select t, mix, penalty, marks.m - sum(b * scaled.m) as b0, list(b order by scaled.i) as b
    from scaled join marks using (t), w where marks.i = w group by t, mix, penalty, marks.m),
  errors as (select t, mix, penalty, sum(h * v[i] * v[j]) as squares, max(h) filter (i = 1 and j = 1) as n
    from (select *, list_concat([b0], b, [-1.0]) as v from fits) join sets using (t) where t >= 0 group by t, mix, penalty),
  means as (select mix, penalty, avg(sqrt(squares / n)) as mean, stddev_samp(sqrt(squares / n)) as sd from errors where n > 0 group by mix, penalty),
  best as (select mix, penalty from means order by round(mean, 9), penalty desc, mix desc limit 1),
  fit as (select fits.mix, fits.penalty, b0, b from fits join best on fits.mix = best.mix and fits.penalty = best.penalty where t = -1),
  scored as (select id, y, train, b0 + list_sum(list_transform(b, lambda e, i: e * x[i + 1])) as pred from xs, fit)"""


# ---- houses ------------------------------------------------------------------------------------

_NUMBERS = ["lot_frontage", "price", "liv_area", "rooms", "baths", "age", "balance"]
_CATEGORIES = ["quality", "zoning", "status"]
_HOUSE_ROWS = f"""{HOUSES}, g as (select id, ln(lot_area + 1) as lot, ln(sale_price) as price, coalesce(lot_frontage, 0) as lot_frontage,
    coalesce(liv_area, 0) as liv_area, coalesce(rooms, 0) as rooms, coalesce(baths, 0) as baths, yr_sold - year_built as age, balance,
    coalesce(quality, 'None') as quality, coalesce(zoning, 'None') as zoning, status, {in_train_sql('id', 1491)} as train,
    {fold_sql('id', 7)} as fold from houses where lot_area is not null)"""
_LOT_ROWS = f"{_HOUSE_ROWS}, h as (select *, lot as y from g)"
_PRICE_ROWS = f"{_HOUSE_ROWS}, h as (select *, price as y from g)"
_PRICE_NUMBERS = ["lot_frontage", "lot", "liv_area", "rooms", "baths", "age", "balance"]


def _houses(t):
    """Houses with a lot, without gaps; train share and folds by hashes of the id."""
    h = houses(t).where("lot_area is not null").na.fill({"lot_frontage": 0.0, "liv_area": 0.0, "rooms": 0, "baths": 0})
    h = h.na.fill({"quality": "None", "zoning": "None"}).withColumns(
        {
            "lot": F.log1p("lot_area"),
            "price": F.log("sale_price"),
            "age": (F.col("yr_sold") - F.col("year_built")).cast("double"),
        }
    )
    h = resample.kfold(resample.random_split(h, "id", 0.75, 1491), "id", FOLDS, 7)
    return settle(h.select("id", "lot", *_NUMBERS, *_CATEGORIES, "part", "fold"), "houses")


def _tuned(src, numbers, categories, target, penalties, mixes):
    """(grid errors, fit, columns by name)"""
    train = src.where("part = 'train'")
    columns = {c: F.col(c) for c in numbers} | (linear.dummies(train, categories) if categories else {})
    return *linear.tuned(train, [*columns.values()], F.col(target), "fold", FOLDS, penalties, mixes), columns


def _new_rows(src, *how):
    """The rows outside the training share with their `prediction`."""
    _, fit, columns = _tuned(src, *how)
    return linear.with_linear_value(src.where("part = 'holdout'"), fit, [*columns.values()])


def _predicted(t, penalties, mixes):
    found = _new_rows(_houses(t), _NUMBERS, _CATEGORIES, "lot", penalties, mixes)
    return found.select("id", r("lot").alias("y"), r("prediction").alias("prediction"))


def _predicted_sql(penalties, mixes):
    return f"""with {tuned_sql(_LOT_ROWS, _NUMBERS, _CATEGORIES, penalties, mixes)}
        select id, round(y, 6) + 0.0 as y, round(pred, 6) + 0.0 as prediction from scored where not train"""


@query("lasso_regression", _predicted_sql(PENALTIES, [1.0]))
def lasso_regression(t):
    """Best of 25 penalties over five folds, refitted on all training rows, applied to new ones."""
    return _predicted(t, PENALTIES, [1.0])


@query("ridge_regression", _predicted_sql(PENALTIES, [0.0]))
def ridge_regression(t):
    return _predicted(t, PENALTIES, [0.0])


@query(
    "elastic_net",
    f"""with {tuned_sql(_LOT_ROWS, _NUMBERS, _CATEGORIES, FIVE, MIXES)}
        select m.penalty, m.mix as mixture, round(mean, 6) as mean, round(sd, 6) as sd, m.mix = best.mix and m.penalty = best.penalty as best from means m, best""",
)
def elastic_net(t):
    """Both penalties tuned: the error of every point of the grid, the best one marked."""
    errors, _, _ = _tuned(_houses(t), _NUMBERS, _CATEGORIES, "lot", FIVE, MIXES)
    return errors.select("penalty", F.col("mix").alias("mixture"), r("mean").alias("mean"), r("sd").alias("sd"), "best")


@query("elastic_net_fit", _predicted_sql(FIVE, MIXES))
def elastic_net_fit(t):
    """The best point of the grid of `elastic_net`, refitted and applied."""
    return _predicted(t, FIVE, MIXES)


@query(
    "nonzero_coefficients",
    f"""with {tuned_sql(_LOT_ROWS, _NUMBERS, _CATEGORIES, PENALTIES, [1.0])}
        select len(b)::bigint as n_coefficients, len(list_filter(b, lambda e: e <> 0))::bigint as n_nonzero from fit""",
)
def nonzero_coefficients(t):
    """How many columns the tuned lasso uses; the coefficients stay a table."""
    _, fit, columns = _tuned(_houses(t), _NUMBERS, _CATEGORIES, "lot", PENALTIES, [1.0])
    return linear.coefficient_table(fit, [*columns]).agg(
        F.count(F.lit(1)).alias("n_coefficients"), F.count_if(F.col("coefficient") != 0).alias("n_nonzero")
    )


@query(
    "score_and_submit",
    f"""with {tuned_sql(_PRICE_ROWS, _PRICE_NUMBERS, _CATEGORIES, PENALTIES, [1.0])}
        select id, round(exp(pred), 2) as sale_price from scored where not train""",
)
def score_and_submit(t):
    """Predictions of new rows by the tuned lasso, back on the price scale, written as CSV and read again."""
    found = _new_rows(_houses(t), _PRICE_NUMBERS, _CATEGORIES, "price", PENALTIES, [1.0])
    path = fresh_path(t.spark, "submission")
    files.write_csv(found.select("id", r(F.exp("prediction"), 2).alias("sale_price")), path)
    return files.read_csv(t.spark, path, "id long, sale_price double")


# ---- rentals -----------------------------------------------------------------------------------

_RIDE_NUMBERS = ["temp", "temp2", "hour", "workingday"]
_RIDE_CATEGORIES = ["season", "weather", "kind"]


def _ride_rows(target):
    return f"""{RIDES}, h as (select id, ln({target} + 1) as y, temp, temp * temp as temp2, hour(datetime) as hour, workingday, season::varchar as season,
        weather::varchar as weather, kind, {in_train_sql('id', 29)} as train, {fold_sql('id', 11)} as fold from rides)"""


def _component_sql(target):
    return f"(with {tuned_sql(_ride_rows(target), _RIDE_NUMBERS, _RIDE_CATEGORIES, RENTAL_FIVE, RENTAL_MIXES)} select id, pred from scored where not train)"


@query(
    "component_model_sum",
    f"select a.id, round(exp(a.pred) - 1 + exp(b.pred) - 1, 4) + 0.0 as pred from {_component_sql('registered')} a join {_component_sql('casual')} b on a.id = b.id",
)
def component_model_sum(t):
    """Registered and casual rentals modelled apart, each tuned, added after each is taken back from its logarithm."""
    src = rides(t).withColumns(
        {
            "registered": F.log1p("registered"), "casual": F.log1p("casual"), "hour": F.hour("datetime"),
            "temp2": F.col("temp").cast("double") * F.col("temp"),
            "season": F.col("season").cast("string"), "weather": F.col("weather").cast("string"),
        }
    )
    src = resample.kfold(resample.random_split(src, "id", 0.75, 29), "id", FOLDS, 11)
    src = settle(src.select("id", "registered", "casual", *_RIDE_NUMBERS, *_RIDE_CATEGORIES, "part", "fold"), "rides")
    parts = []
    for target in ("registered", "casual"):
        found = _new_rows(src, _RIDE_NUMBERS, _RIDE_CATEGORIES, target, RENTAL_FIVE, RENTAL_MIXES)
        parts.append(found.select("id", F.col("prediction").alias("pred")))
    return metrics.sum_components(*parts, F.expm1).withColumn("pred", r("pred", 4))


# ---- texts -------------------------------------------------------------------------------------

_TEXT_ROWS = f"""{LABELLED}, h as (select id, target as y, length(text) as character_count, len(regexp_extract_all(text, '#')) as hashtag_count,
    contains(text, '#')::int as has_hashtag, len(regexp_extract_all(text, '@')) as mention_count, contains(text, '@')::int as has_mention,
    len(regexp_extract_all(text, 'https?://')) as link_count, regexp_matches(text, 'https?://')::int as has_link,
    len(regexp_extract_all(text, '{tx.WORD_CHAR}+')) as word_count, len(list_distinct(string_split(text, ' '))) as unique_words,
    {in_train_sql('id', 3)} as train, {fold_sql('id', 5)} as fold from labelled)"""


@query(
    "linear_probability",
    f"""with {tuned_sql(_TEXT_ROWS, tx.TEXT_FEATURES, [], [1e-4], [0.0])}
        select id, y as target, round(pred, 6) + 0.0 as prediction, (round(pred, 6) > 0.6)::int as label_60, (round(pred, 6) > 0.65)::int as label_65 from scored where not train""",
)
def linear_probability(t):
    """A straight line on a 0/1 target, cut at two thresholds."""
    src = labelled(t).select("id", "target", *[c.alias(n) for n, c in tx.text_features().items()])
    src = settle(resample.kfold(resample.random_split(src, "id", 0.75, 3), "id", FOLDS, 5), "features")
    scored = _new_rows(src, tx.TEXT_FEATURES, [], "target", [1e-4], [0.0])
    scored = scored.select("id", "target", r("prediction").alias("prediction"))
    return scored.select(
        "*", metrics.threshold_label(F.col("prediction"), 0.6).alias("label_60"),
        metrics.threshold_label(F.col("prediction"), 0.65).alias("label_65"),
    )
