"""Small tables for the places where engines and languages differ."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from grainmill.functions import cleaning, encode, numeric
from grainmill.functions import text as tx
from grainmill.operators import columns, impute, profile, reshape, rows, stats, textmine, transforms, windows
from grainmill.recipe import steps
from grainmill.sources import files


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_outlier_nulls(spark):
    df = spark.createDataFrame([(2, None), (2, 0), (0, 0)], "a int, b int")
    test = (F.col("a") > 1) & (F.col("b") < 1)
    assert rows.drop_where(df, test, keep_null=False).count() == 1
    assert rows.drop_where(df, test, keep_null=True).count() == 2


def test_rank_ties(spark):
    df = spark.createDataFrame([("g", v) for v in (1, 2, 2, 3)], "g string, v int")
    assert windows.top_n_ties(df, ["g"], "v", 2).count() == 3


def test_constant_column(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (1.0, 3.0, 1)], "x double, y double, id int")
    assert stats.corr_matrix(df, ["x", "y"]).first().r is None
    assert transforms.standardize(df, ["x"]).first().x is None
    assert steps.drop_near_zero_variance("x", "y").fit(df).transform(df).columns == ["y", "id"]
    assert {r.bin for r in stats.histogram(df, "x", 4).collect()} == {1}


def test_unicode_words(spark):
    assert one(spark, tx.count_words(F.lit("Sträße näh"))) == 2
    assert one(spark, tx.tokens(F.lit("Don't stop Élan_1"))) == ["don't", "stop", "élan_1"]


def test_split_edges(spark):
    assert one(spark, tx.squish(F.lit(" a  b "))) == "a b"
    assert one(spark, tx.distinct_pieces(F.lit("a  b a"))) == 3
    df = spark.createDataFrame([(" a  bbb ",), ("",)], "text string")
    assert stats.mean_word_length(df, []).first().mean_word_len == 2.0


def test_short_texts_have_no_bigrams(spark):
    df = spark.createDataFrame([(1, ""), (2, "one"), (3, "one two")], "id int, text string")
    assert [tuple(r) for r in textmine.unnest_ngrams(df).collect()] == [(3, "one two")]


def test_first_match_only(spark):
    text = F.lit("l1 http://a.b x http://c.d")
    assert one(spark, tx.remove_first(text, r"https?://\S+")) == "l1  x http://c.d"
    assert one(spark, tx.remove_all(text, r"https?://\S+")) == "l1  x "
    assert one(spark, tx.replace_first(F.lit("a\nb\nc"), "\n", "$")) == "a$b\nc"


def test_punctuation_is_not_a_letter_set(spark):
    assert one(spark, tx.punctuation_to_space(F.lit("punct: t$t"))) == "punct  t t"


def test_words_leave_as_whole_words(spark):
    words = ["a", "an", "and", "don", "don't", "the"]
    text = "the man and a don't, don theme"
    assert one(spark, tx.remove_words(F.lit(text), words)) == " man   ,  theme"
    flat = F.regexp_replace(F.lit(text), rf"(?U)\b(?:{tx.any_word(words)})\b", "")
    assert one(spark, flat) == " man   ,  theme"


def test_rules_run_in_order(spark):
    got = one(spark, cleaning.apply_rules(F.lit("See HTTPS://x.y %20 &amp; café 42 @_bob b #tag"), cleaning.rules_v1()))
    assert got == "see caf tag"


def test_unseen_level(spark):
    train = spark.createDataFrame([(i, "a") for i in range(9)] + [(9, "b"), (10, None)], "id int, k string")
    test = spark.createDataFrame([(1, "c"), (2, None), (3, "a"), (4, "b")], "id int, k string")
    lumped = {r.id: r.k for r in steps.lump_rare("k", 2, ["id"]).fit(train).transform(test).collect()}
    assert lumped == {1: "other", 2: None, 3: "a", 4: "other"}
    hot = {r.id: (r.k_a, r.k_b) for r in steps.one_hot("k").fit(train).transform(test).collect()}
    assert hot == {1: (0, 0), 2: (0, 0), 3: (1, 0), 4: (0, 1)}
    assert one(spark, encode.level_map(F.lit("c"), {"a": 1})) is None
    codes = {r.id: r.k for r in steps.label_encode("k", ["id"]).fit(train).transform(test).collect()}
    assert codes == {1: None, 2: None, 3: 0, 4: 1}


def test_group_without_values_stays_missing(spark):
    df = spark.createDataFrame([(1, "g1", None), (2, "g1", None), (3, "g2", "x"), (4, "g2", None), (5, None, "y"), (6, None, None)],
                               "id int, g string, v string")
    got = {r.id: r.v for r in impute.fill_mode_group(df, ["g"], "v", ["id"]).collect()}
    assert got == {1: None, 2: None, 3: "x", 4: "x", 5: "y", 6: "y"}


def test_half_rounding(spark):
    for x, places, want in ((2.5, 0, 2.0), (-0.5, 0, 0.0), (0.125, 2, 0.12)):
        assert one(spark, numeric.round_half_even(F.lit(x), places)) == want


def test_published_missing_percents(spark):
    counts = {"PoolQC": 1453, "MiscFeature": 1406, "Alley": 1369, "Fence": 1179, "FireplaceQu": 690, "LotFrontage": 259,
              "Garage": 81, "Bsmt": 38, "Mas": 8, "Electrical": 1}
    df = spark.range(1460).select(*[F.when(F.col("id") >= n, 1).alias(c) for c, n in counts.items()])
    got = {r.name: round(r.pct_missing, 2) for r in profile.null_percent(df, style="r").collect()}
    assert got == {"PoolQC": 99.52, "MiscFeature": 96.3, "Alley": 93.77, "Fence": 80.75, "FireplaceQu": 47.26,
                   "LotFrontage": 17.74, "Garage": 5.55, "Bsmt": 2.6, "Mas": 0.55, "Electrical": 0.07}


def test_csv_round_trip(spark, tmp_path):
    rows_ = [(1, 'a,"b"', "x\ny"), (2, None, "None"), (3, " lead", "é;'")]
    df = spark.createDataFrame(rows_, "id int, a string, b string")
    files.write_csv(df, str(tmp_path / "out"))
    back = files.read_csv(spark, str(tmp_path / "out"), "id int, a string, b string", multi_line=True)
    assert sorted(tuple(r) for r in back.collect()) == rows_


def test_csv_missing_cells(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,a,b\n1,,NA\n2,NA,None\n3,5,x\n")
    got = files.read_csv(spark, str(tmp_path / "in.csv")).orderBy("id")
    assert dict(got.dtypes) == {"id": "int", "a": "int", "b": "string"}
    assert [tuple(r) for r in got.collect()] == [(1, None, None), (2, None, "None"), (3, 5, "x")]


def test_json_that_does_not_parse(spark):
    df = spark.createDataFrame([(1, '{"k": 3, "s": "x"}'), (2, "oops"), (3, None)], "id int, j string")
    schema = files.infer_json_schema(df, "j")
    got = {r.id: (r.k, r.s) for r in files.json_columns(df, "j", schema).collect()}
    assert got == {1: (3, "x"), 2: (None, None), 3: (None, None)}


def test_json_fields_of_late_rows(spark):
    texts = ['{"k": 1}', '{"k": 2, "z": "q", "o": {"p": 1.5}}', '{"k": 3, "z": 7, "n": null}']
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    got = files.json_columns(df, "j", files.infer_json_schema(df, "j")).orderBy("k").collect()
    assert [(r.k, r.z, r.o and r.o.p, r.n) for r in got] == [(1, None, None, None), (2, "q", 1.5, None), (3, "7", None, None)]
    with pytest.raises(ValueError):
        files.infer_json_schema(df.where("false"), "j")


def test_csv_is_read_in_parts(spark, tmp_path):
    files.write_csv(spark.range(0, 200_000, 1, 1), str(tmp_path / "out"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        back = files.read_csv(spark, str(tmp_path / "out"), "id long")
        assert back.rdd.getNumPartitions() > 3 and back.selectExpr("sum(id) s").first().s == sum(range(200_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["Sale Price", "1stFlrSF", "sale.price", "3SsnPorch"])
    assert columns.clean_names(df).columns == ["sale_price", "x1st_flr_sf", "sale_price_2", "x3ssn_porch"]


def test_flags_and_buckets(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    got = df.select(
        encode.flag(F.col("x") > 2).alias("a"), encode.flag(F.col("x") > 2, True).alias("b"),
        encode.buckets(F.col("x"), [(0, 1, "low"), (2, 4, "mid")]).alias("c"),
    ).collect()
    assert [tuple(r) for r in got] == [(0, 0, "low"), (1, 1, None), (None, 0, None)]


def test_level_labels(spark):
    levels = ["x", "y"]
    assert [one(spark, encode.level_label(F.lit(i), levels)) for i in (0, 1, 2, 3)] == [None, "x", "y", None]
    assert [one(spark, encode.level_position(F.lit(v), levels)) for v in ("y", "z")] == [2, None]


def test_padding(spark):
    s = F.array(*[F.lit(i) for i in (1, 2, 3)])
    assert one(spark, textmine.pad(s, 5)) == [0, 0, 1, 2, 3]
    assert one(spark, textmine.pad(s, 2)) == [2, 3]
    assert one(spark, textmine.pad(s, 5, "post")) == [1, 2, 3, 0, 0]
    assert one(spark, textmine.pad(s, 2, "post", "post")) == [1, 2]


def test_normal_quantile(spark):
    ps = [1e-12, 1e-4, 0.02, 0.075, 0.2, 0.5, 0.8, 0.99, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = {r.p: r.z for r in df.select("p", numeric.normal_quantile(F.col("p")).alias("z")).collect()}
    for p in ps:
        assert got[p] == pytest.approx(NormalDist().inv_cdf(p), rel=1e-9, abs=1e-12)


def test_logs_of_columns_with_zeros(spark):
    df = spark.createDataFrame([(0.0, 1.0, 5.0)] * 1 + [(1.0, 2.0, 6.0)] * 8 + [(100.0, 900.0, 7.0)], "a double, b double, c double")
    top = transforms.log_if_skewed(df, ["a", "b", "c"]).orderBy(F.desc("a")).first()
    assert top.a == pytest.approx(math.log(101)) and top.b == pytest.approx(math.log(900)) and top.c == 7.0


def test_inverse_goes_with_its_transform(spark):
    price = steps.LogColumn("y", 1.0)
    df = spark.createDataFrame([(3.0,)], "y double")
    assert price.step().transform(df).select(price.inverse(F.col("y")).alias("y")).first().y == pytest.approx(3.0)


def test_grid_keeps_all_levels(spark):
    counts = spark.createDataFrame([("k1", 0, 3), ("k2", 1, 2)], "key string, target int, n long")
    got = {(r.target, r.key): r.n for r in reshape.complete_counts(counts, "target", "key").collect()}
    assert got == {(0, "k1"): 3, (1, "k1"): 0, (0, "k2"): 0, (1, "k2"): 2}
