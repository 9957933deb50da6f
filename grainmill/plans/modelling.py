"""Models, tuning, scoring. Results depend on the solver, so only their rows are checked against SQL-free rules."""

from __future__ import annotations

from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, RFormula, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from grainmill.functions import text as tx
from grainmill.operators import linear, logistic, models, resample, sparse, textmine, vectors
from grainmill.operators.scale import settle
from grainmill.plans.mining import ranked_with_vectors
from grainmill.plans.registry import query
from grainmill.plans.roles import LABELLED, RIDES, TWEETS, labelled, r, rides, texts
from grainmill.plans.words import WORD_SQL, tokens_sql

# ---- tables for training -----------------------------------------------------------------------

# fixed values: folds of the rentals and of the texts whose penalties are compared
RIDE_FOLDS, TEXT_FOLDS = 5, 3


def _rides(t):
    src = rides(t).withColumns(
        {
            "y": F.log1p("registered"),
            "y_casual": F.log1p("casual"),
            "hour": F.hour("datetime"),
            "season": F.col("season").cast("string"),
            "weather": F.col("weather").cast("string"),
            "temp2": F.col("temp") * F.col("temp"),
            "workday": F.col("workingday").cast("string"),
        }
    )
    src = resample.kfold(resample.random_split(src, "id", 0.75, 29), "id", RIDE_FOLDS, 11)
    return src.where("part = 'train'"), src.where("part = 'holdout'")


_RIDE_STAGES = (["temp", "temp2", "hour", "workingday"], ["season", "weather", "kind"])


def _texts(t):
    src = labelled(t).withColumns(tx.text_features())
    src = models.with_tokens(src.select("id", "text", "target", *tx.text_features())).drop("text")
    src = resample.random_split(src, "id", 0.75, 3)
    return src.where("part = 'train'"), src.where("part = 'holdout'")


def _text_stages():
    return [
        *models.tfidf_stages("tokens"),
        VectorAssembler(inputCols=[*tx.text_features(), "tfidf"], outputCol="features"),
    ]


# ---- linear models -----------------------------------------------------------------------------


def _split_sql(col, seed):
    return f"cast('0x' || substr(md5({col} || ':{seed}'), 1, 8) as bigint) < 3221225472"


def _fold_sql(col, folds, seed):
    return f"cast(cast('0x' || substr(md5({col} || ':{seed}'), 1, 8) as bigint) % {folds} as integer)"


@query(
    "ols_formula",
    f"""with {RIDES}, s as (select id, ln(registered + 1) as y, temp as x, temp * temp as z, weather || '-' || workingday as g, {_split_sql('id', 29)} as train from rides),
        m as (select g, avg(x) as mx, avg(z) as mz, avg(y) as my from s where train group by g),
        k as (select sum((x - mx) * (x - mx)) as xx, sum((x - mx) * (z - mz)) as xz, sum((z - mz) * (z - mz)) as zz, sum((x - mx) * (y - my)) as xy,
              sum((z - mz) * (y - my)) as zy from s join m on s.g = m.g where train),
        b as (select (xy * zz - zy * xz) / (xx * zz - xz * xz) as bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) as bz from k)
        select id, round(exp(y) - 1, 4) as actual, round(exp(my + bx * (x - mx) + bz * (z - mz)) - 1, 4) as pred from s join m on s.g = m.g, b where not train""",
)
def ols_formula(t):
    """Factors, their interaction, a number and its square, by formula; predictions back on the scale of the
    counts. The SQL solves the same least squares problem from the deviations within the factor cells."""
    train, new = _rides(t)
    formula = RFormula(
        formula="y ~ weather:workday + temp + temp2", featuresCol="features", labelCol="y", handleInvalid="error"
    )
    # one column per cell of the two factors takes the place of the intercept: full rank, solved directly
    model = LinearRegression(labelCol="y", regParam=0.0, fitIntercept=False, solver="normal")
    _, scored = models.fit_and_score([formula], model, train, new, "y")
    return scored.select("id", r(F.expm1("y"), 4).alias("actual"), r(F.expm1("prediction"), 4).alias("pred"))


@query("linear_svm")
def linear_svm(t):
    train, new = _texts(t)
    model = LinearSVC(labelCol="target", regParam=0.01, maxIter=30)
    return models.fit_and_score(_text_stages(), model, train, new, "target", unnamed=["features"])[1]


# ---- trees -------------------------------------------------------------------------------------


@query("random_forest")
def random_forest(t):
    train, new = _rides(t)
    model = RandomForestRegressor(labelCol="y", numTrees=20, minInstancesPerNode=5, maxDepth=6, seed=5)
    return models.fit_and_score(models.feature_stages(*_RIDE_STAGES), model, train, new, "y")[1]


@query("random_forest_classes")
def random_forest_classes(t):
    train, new = _texts(t)
    model = RandomForestClassifier(labelCol="target", numTrees=20, minInstancesPerNode=5, seed=5)
    return models.fit_and_score(_text_stages(), model, train, new, "target", unnamed=["features"])[1]


def _gbt(**more):
    settings = dict(
        labelCol="y", maxIter=15, stepSize=0.1, maxDepth=4, subsamplingRate=0.8, minInstancesPerNode=5,
        featureSubsetStrategy="0.8", seed=9,
    )
    return GBTRegressor(**{**settings, **more})


@query("boosted_trees")
def boosted_trees(t):
    train, new = _rides(t)
    return models.fit_and_score(models.feature_stages(*_RIDE_STAGES), _gbt(), train, new, "y")[1]


@query("boosted_trees_classes")
def boosted_trees_classes(t):
    train, new = _texts(t)
    stages = models.feature_stages(tx.TEXT_FEATURES)
    model = GBTClassifier(labelCol="target", maxIter=10, maxDepth=3, stepSize=0.1, seed=9)
    return models.fit_and_score(stages, model, train, new, "target")[1]


@query("staged_rmse")
def staged_rmse(t):
    """Error on new rows after each tree."""
    train, new = _rides(t)
    fitted, features = models.prepare(models.feature_stages(*_RIDE_STAGES), train, ["id", "y", "features"])
    model = _gbt().fit(features)
    return models.staged_errors(model, settle(fitted.transform(new).select("y", "features"), "features"))


@query("boosted_best_count")
def boosted_best_count(t):
    """The curve over five folds says how many trees to grow; the model of that many scores the new rows."""
    train, new = _rides(t)
    fitted, features = models.prepare(models.feature_stages(*_RIDE_STAGES), train, ["id", "y", "fold", "features"])
    model, _ = models.boosted_to_best(_gbt(stepSize=0.3, maxIter=25), features, "fold", RIDE_FOLDS)
    scored = model.transform(fitted.transform(new))
    return scored.select("id", "y", "prediction", F.lit(model.getNumTrees).alias("n_trees"))


@query("early_stopping")
def early_stopping(t):
    """Boosting stops when the error on marked validation rows stops falling."""
    train, new = _rides(t)
    train = train.withColumn("validation", F.col("fold") == 0)
    model = _gbt(maxIter=40, validationIndicatorCol="validation", validationTol=0.01)
    stages = models.feature_stages(*_RIDE_STAGES)
    trained, scored = models.fit_and_score(stages, model, train, new, "y", extra=["validation"])
    return scored.withColumn("n_trees", F.lit(trained.getNumTrees))


@query("grid_search_cv")
def grid_search_cv(t):
    """Every grid point on every fold; the metric table with the chosen point."""
    train, _ = _rides(t)
    _, features = models.prepare(models.feature_stages(*_RIDE_STAGES), train, ["id", "y", "fold", "features"])
    model = RandomForestRegressor(labelCol="y", seed=5)
    grid = ParamGridBuilder().addGrid(model.numTrees, [5, 10]).addGrid(model.minInstancesPerNode, [2, 10]).build()
    return models.grid_search(model, grid, RegressionEvaluator(labelCol="y"), features, "fold", RIDE_FOLDS)[1]


@query("auc_search_cv")
def auc_search_cv(t):
    """Penalties of a logistic model compared by area under the curve."""
    train, _ = _texts(t)
    train = resample.kfold(train, "id", TEXT_FOLDS, 5)
    _, features = models.prepare(_text_stages(), train, ["id", "target", "fold", "features"], unnamed=["features"])
    model = LogisticRegression(labelCol="target", elasticNetParam=1.0, maxIter=30)
    grid = ParamGridBuilder().addGrid(model.regParam, [0.001, 0.01, 0.1]).build()
    return models.grid_search(model, grid, BinaryClassificationEvaluator(labelCol="target"), features, "fold", TEXT_FOLDS)[1]


# ---- vectors -----------------------------------------------------------------------------------


_WEIGHTS = f"""{LABELLED}, {tokens_sql('labelled')}, dtm as (select id, word, count(*) as n from tokens group by id, word),
    vocab as (select word, count(*) as docs, row_number() over (order by word) as place from dtm group by word having count(*) >= 5),
    raw as (select id, place, n / sum(n) over (partition by id) * ln(((select count(*) from labelled) + 1) / (docs + 1)) as w from dtm join vocab using (word)),
    terms as (select id, place, w / nullif(sqrt(sum(w * w) over (partition by id)), 0) as w from raw)"""
_NUMBERS_SQL = f"""select id, unnest(range(0, 9)) as position, unnest([length(text), len(regexp_extract_all(text, '#')), contains(text, '#')::int,
    len(regexp_extract_all(text, '@')), contains(text, '@')::int, len(regexp_extract_all(text, 'https?://')), regexp_matches(text, 'https?://')::int,
    len(regexp_extract_all(text, '{tx.WORD_CHAR}+')), len(list_distinct(string_split(text, ' ')))])::double as value from labelled"""
_LEVELS_SQL = """select id, 8 + dense_rank() over (order by keyword) as position, 1.0::double as value from labelled where keyword is not null"""
_MATRIX = f"""{_WEIGHTS}, levels as ({_LEVELS_SQL}), numbers as ({_NUMBERS_SQL}),
    entries as (select * from numbers union all select * from levels
      union all select id, 8 + (select count(distinct keyword) from labelled) + place, w from terms)"""


def combined_matrix(t):
    """(entries, columns): nine text features, one column per keyword, L2 TF-IDF of the words in five texts or more."""
    src = settle(labelled(t).select("id", "text", "keyword", *[c.alias(n) for n, c in tx.text_features().items()]), "texts")
    counts = settle(textmine.doc_term_counts(src), "counts")
    vocab = counts.groupBy("word").agg(F.count(F.lit(1)).alias("doc_count")).where("doc_count >= 5")
    kept = textmine.restrict_to_vocabulary(counts, vocab.withColumn("docs", F.col("doc_count")), extra=["docs"])
    weights = textmine.tfidf(kept.withColumnRenamed("docs", "doc_count"), textmine.count_of(src), "l2")
    numbers = {n: F.col(n) for n in tx.text_features()}
    return sparse.assemble(src, numbers, ["keyword"], weights, vocab, "tfidf")


@query(
    "assemble_features",
    f"with {_MATRIX} select id, position::bigint as position, round(value, 6) as value from entries where value <> 0",
)
def assemble_features(t):
    """Numbers, keyword levels and TF-IDF weights of all labelled texts in one sparse matrix."""
    entries, _ = combined_matrix(t)
    return entries.select("id", "position", r("value").alias("value"))


@query(
    "assembled_columns",
    f"""with {_MATRIX}, named as (select unnest(range(0, 9)) as position, unnest({tx.TEXT_FEATURES!r}) as name
        union all select distinct 8 + dense_rank() over (order by keyword), 'keyword=' || keyword from labelled where keyword is not null
        union all select 8 + (select count(distinct keyword) from labelled) + place, word from vocab)
        select named.position::bigint as position, name, count(id)::bigint as n, round(sum(value), 4) as total
        from named left join (select * from entries where value <> 0) e on e.position = named.position group by all""",
)
def assembled_columns(t):
    """Name, entries and sum of each column of the matrix of `assemble_features`."""
    entries, columns = combined_matrix(t)
    sums = entries.groupBy("position").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return columns.join(sums, "position", "left").select("position", "name", F.coalesce("n", F.lit(0)).alias("n"), r("total", 4).alias("total"))


def _term_rows(t):
    """(L2 TF-IDF entries (id, position, value) of the words in ten texts or more, labelled rows with part and fold)."""
    src = settle(labelled(t).select("id", "text", "target"), "texts")
    counts = settle(textmine.doc_term_counts(src), "counts")
    vocab = counts.groupBy("word").agg(F.count(F.lit(1)).alias("doc_count")).where("doc_count >= 10")
    kept = textmine.restrict_to_vocabulary(counts, vocab.withColumn("docs", F.col("doc_count")), extra=["docs"])
    weights = textmine.tfidf(kept.withColumnRenamed("docs", "doc_count"), textmine.count_of(src), "l2")
    entries = settle(sparse.term_entries(weights, settle(sparse.term_index(vocab, 0), "index"), "tfidf"), "entries")
    rows = resample.kfold(resample.random_split(src.drop("text"), "id", 0.75, 3), "id", 5, 5)
    return entries, settle(rows.withColumnRenamed("target", "y"), "rows")


@query("logistic_elastic_net")
def logistic_elastic_net(t):
    """Lasso on words: 25 penalties on five folds by accuracy, the best one fitted on all training rows, predictions for
    the others. Each model takes forty accelerated rounds at most, so the smallest penalties act by early stopping."""
    entries, rows = _term_rows(t)
    paths = logistic.Paths(entries, rows.where("part = 'train'"), 5, linear.penalty_grid(-10, 0, 25), rounds=40)
    _, fitted = logistic.best_coefficients(paths)
    scored = logistic.with_probability(rows.where("part = 'holdout'"), entries, fitted)
    return scored.select("id", F.col("y").alias("target"), "prediction", "probability")


@query(
    "logistic_first_penalties",
    f"""with {_WEIGHTS.replace('count(*) >= 5', 'count(*) >= 10')}, rows as (select id, target::double as y, {_fold_sql('id', 5, 5)} as fold from labelled where {_split_sql('id', 3)}),
        own as (select place, w, y, fold from terms join rows using (id) where w <> 0), size as (select count(*) as n from rows),
        scales as (select place, sqrt(sum(w * w) / (select n from size) - (sum(w) / (select n from size)) ** 2) as scale from own group by place
          having sum(w * w) / (select n from size) - (sum(w) / (select n from size)) ** 2 > 1e-12 * sum(w * w) / (select n from size)),
        sets as (select unnest(range(-1, 5)) as training), means as (select training, avg(y) as m, count(*) as n from sets, rows where fold <> training group by training),
        slopes as (select training, place, abs(sum(w / scale * (y - m))) / any_value(n) as g from own join scales using (place), means where fold <> training group by training, place)
        select training::int as training, round(max(g), 6) as penalty from slopes group by training""",
)
def logistic_first_penalties(t):
    """Where the paths of `logistic_elastic_net` begin: the smallest penalty without a coefficient, per training set."""
    entries, rows = _term_rows(t)
    return logistic.first_penalties(entries, rows.where("part = 'train'"), 5).select("training", r("penalty", 6).alias("penalty"))


@query("pca")
def pca(t):
    """Embeddings centred and projected to three components."""
    src = settle(t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw")), "vectors")
    centred = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(src).transform(src)
    model = PCA(k=3, inputCol="centred", outputCol="pc").fit(centred)
    done = model.transform(centred).withColumn("pc", vector_to_array("pc"))
    return done.select("vec_id", *[F.get("pc", i).alias(f"pc{i + 1}") for i in range(3)])


@query("train_word_vectors")
def train_word_vectors(t):
    """Vectors of 100 numbers for every word of the documents that has a neighbour, from the co-occurrence table."""
    return vectors.word_vectors(textmine.cooccurrence(texts(t)), 100)


_PAIRS = f"""{TWEETS}, arrays as (select regexp_extract_all(lower(text), '{WORD_SQL}') as a from tweets),
    places as (select a, unnest(range(1, len(a) + 1)) as pos from arrays),
    near as (select a[pos] as x, a[pos + d] as y, 60 // d as w from places, range(1, 6) as u(d) where pos + d <= len(a)),
    pairs as (select least(x, y) as x, greatest(x, y) as y, ln(1 + sum(w) / 60) as w from near group by 1, 2),
    twoway as (select x as word, y as context, w from pairs union all select y, x, w from pairs where x <> y)"""


@query(
    "word_projection",
    f"""with {_PAIRS}, dims as (select unnest(range(0, 6)) as dim)
        select word, dim::int as dim, round(sum(w * case when ((strpos('0123456789abcdef', substr(md5(context || ':0'), (dim // 4 + 1)::int, 1)) - 1) >> (3 - dim % 4)::int) & 1 = 1
        then 1 else -1 end), 4) + 0.0 as value from twoway, dims group by word, dim""",
)
def word_projection(t):
    """The first step of `train_word_vectors`: each word's weights against the signs of its neighbours, six numbers."""
    found = vectors.projected(textmine.cooccurrence(texts(t)), 6)
    return found.select("word", "dim", r("value", 4).alias("value"))


@query("embedding_classifier")
def embedding_classifier(t):
    """Averaged word vectors, a dense layer of 16, two classes."""
    means = textmine.mean_embedding(textmine.doc_term_counts(labelled(t)), ranked_with_vectors(t))
    means = settle(means.join(labelled(t).select("id", "target"), "id"), "vectors")
    parts = resample.random_split(means, "id", 0.75, 3)
    model = MultilayerPerceptronClassifier(labelCol="target", layers=[64, 16, 2], maxIter=40, seed=3)
    trained = model.fit(parts.where("part = 'train'"))
    scored = trained.transform(parts.where("part = 'holdout'"))
    return scored.select("id", "target", "prediction", F.get(vector_to_array("probability"), F.lit(1)).alias("probability"))
