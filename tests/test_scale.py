"""The building blocks against brute force, with one key holding a third of the rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.operators import joins, metrics, scale, stats, textmine, windows
from grainmill.operators.rows import filter_group_size
from grainmill.plans import mining
from grainmill.sources.tables import Tables


def skewed(n=3000, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None])
        v = 7.0 if i % 5 == 0 else round(rng.gauss(0, 10), 1)
        rows.append((i, g, v, rng.randint(1, 4)))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(skewed(), "id long, g string, v double, w long").repartition(7).cache()


def test_positions(table, route):
    got = {r.id: r.pos for r in scale.row_positions(table, ["v", "id"]).collect()}
    order = sorted(skewed(), key=lambda r: (r[2], r[0]))
    assert got == {r[0]: i for i, r in enumerate(order, 1)}


def test_running_weight_by_group(table, route):
    out = scale.running_weight(table, ["v", "id"], "w", by=["g"], total="all").collect()
    groups = defaultdict(list)
    for r in sorted(skewed(), key=lambda r: (r[2], r[0])):
        groups[r[1]].append(r)
    want = {}
    for rows in groups.values():
        done, total = 0, sum(r[3] for r in rows)
        for r in rows:
            want[r[0]] = (done, total)
            done += r[3]
    assert {r.id: (r.before, r["all"]) for r in out} == want


def test_positions_of_empty_table(table, route):
    assert scale.row_positions(table.where("id < 0"), ["v", "id"]).count() == 0


def test_positions_ignore_partitioning(table, route):
    one = scale.row_positions(table.repartition(1), ["v", "id"]).orderBy("id").collect()
    many = scale.row_positions(table.repartition(7), ["v", "id"]).orderBy("id").collect()
    assert one == many


def test_quantiles(table, route):
    probs = [0.0, 0.2, 0.5, 0.83, 1.0]
    out = scale.exact_quantiles(table, ["v", "w"], probs, ["g"]).collect()
    groups = defaultdict(list)
    for r in skewed():
        groups[(r[1], "v")].append(r[2])
        groups[(r[1], "w")].append(r[3])
    assert len(out) == len(groups)
    for r in out:
        assert np.allclose(r.q, np.quantile(groups[(r.g, r.name)], probs))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_attach_by_key_splits_hot_keys(table, route, how):
    sizes = scale.key_counts(table.where("g is null or g <> 'b'"), ["g"], "n").withColumn("twice", F.col("n") * 2)
    out = scale.attach_by_key(table, sizes, ["g"], "n", ["id"], how).collect()
    count = Counter(r[1] for r in skewed())
    want = {r[0]: None if r[1] == "b" else 2 * count[r[1]] for r in skewed() if how == "left" or r[1] != "b"}
    assert len(out) == len(want)
    assert {r.id: r.twice for r in out} == want


def test_modes(spark):
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", "c"), ("x", "a"), ("x", "b"), ("y", None)], "g string, v string")
    assert [tuple(r) for r in stats.group_mode(df, ["g"], "v").collect()] == [("x", "a", 2)]


def test_filter_group_size(table, route):
    count = Counter(r[1] for r in skewed())
    limit = sorted(count.values())[2]
    got = {r.id for r in filter_group_size(table, ["g"], limit, ["id"]).collect()}
    assert got == {r[0] for r in skewed() if count[r[1]] > limit}


def test_quantile_tiers_count_rows(table, route):
    got = {r.g: r.tier for r in windows.quantile_tiers(table, ["g"], "w").collect()}
    groups = defaultdict(list)
    for r in skewed():
        groups[r[1]].append(r[3])
    med = {g: np.median(v) for g, v in groups.items()}
    rows = [med[r[1]] for r in skewed()]
    lo, hi = np.quantile(rows, [0.2, 0.8])
    assert got == {g: 2 if m > hi else 0 if m < lo else 1 for g, m in med.items()}


def test_auc_with_ties(table, route):
    df = table.select((F.col("w") % 2).alias("y"), F.round("v").alias("s"))
    got = metrics.auc(df, "y", "s").first().auc
    pos = [float(np.floor(abs(r[2]) + 0.5) * np.sign(r[2])) for r in skewed() if r[3] % 2 == 1]
    neg = [float(np.floor(abs(r[2]) + 0.5) * np.sign(r[2])) for r in skewed() if r[3] % 2 == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert got == pytest.approx(wins / (len(pos) * len(neg)))


def test_ecdf_ends_at_one(table, route):
    shares = [r.share for r in stats.ecdf(table, "v").orderBy("value").collect()]
    assert shares == sorted(shares) and shares[-1] == 1.0


def test_cooccurrence_brute_force(spark):
    texts = ["a b a c", "b", "", "a b c d e f g h"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = Counter()
    for text in texts:
        words = text.split()
        for i, x in enumerate(words):
            for d in range(1, 6):
                if i + d < len(words):
                    want[tuple(sorted((x, words[i + d])))] += 1 / d
    got = {(r.term_a, r.term_b): r.weight for r in textmine.cooccurrence(df).collect()}
    assert got == pytest.approx(dict(want))


def test_vocabulary_brute_force(spark):
    texts = ["a b a", "", "b b c", "Ä ä a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.word: (r.term_count, r.doc_count) for r in textmine.vocabulary(df).collect()}
    assert got == {"a": (3, 2), "b": (3, 2), "c": (1, 1), "ä": (2, 1)}


def test_ranks_give_sequences(spark, route):
    df = spark.createDataFrame([(1, "b a a"), (2, ""), (3, "c a b")], "id int, text string")
    ranked = textmine.ranked_vocabulary(textmine.vocabulary(df))
    got = {r.id: r.seq for r in textmine.encode_sequences(df, ranked, 3).collect()}
    assert got == {1: [2, 1, 1], 2: [], 3: [1, 2]}


def test_level_lists_have_a_bound(spark, table):
    with pytest.raises(Exception, match="more than 3 levels"):
        joins.level_row(table, ["w"], most=3).collect()


def test_top_n_is_cut_before_the_shuffle(table):
    plan = windows.top_n_ties(table, ["g"], "v", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_spread_leaves_many_pieces_alone(spark, table):
    assert scale.spread(table.repartition(64), "id").rdd.getNumPartitions() == 64
    assert scale.spread(table.coalesce(1), "id").rdd.getNumPartitions() == 16


def test_lookup_of_a_key_with_a_third_of_all_rows(spark, table, route):
    names = spark.createDataFrame([("hot", 1), ("hot", 2), ("hot", 2), ("a", 3), (None, 4), ("z", 5)], "g string, name int")
    got = sorted((r.id, r.name or 0) for r in joins.lookup(table, names, "g").collect())
    rows = {"hot": [1, 2], "a": [3]}
    assert got == sorted((r[0], n) for r in skewed() for n in rows.get(r[1], [0]))


def test_rows_of_a_frequent_key_are_spread(spark, monkeypatch):
    """Beyond the broadcast, no task holds more than a few shares of the rows of a key with 30 percent of them."""
    spark.conf.set("grainmill.broadcast.bytes", "0")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(40_000).selectExpr("id", "if(id % 10 < 3, 'hot', concat('k', id % 997)) as word")
        vectors = spark.range(997).selectExpr("concat('k', id) as word", "array(float(id), float(1)) as vec")
        vectors = vectors.union(spark.sql("select 'hot', array(float(-1), float(0))"))
        found = textmine.lookup_vectors(rows, vectors, 2)
        sizes = [r["n"] for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 40_000 and max(sizes) < 2.5 * 40_000 / 8
        assert found.where("word = 'hot' and vec[0] = -1").count() == 12_000
    finally:
        spark.conf.unset("grainmill.broadcast.bytes")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_many_narrow_rows_are_not_broadcast(spark):
    """Numbered words: few bytes in files, many on the driver. Results are those of a plain join."""
    spark.conf.set("grainmill.broadcast.rows", "30")
    try:
        rows = spark.createDataFrame([(i, "w0" if i % 2 else f"w{i % 60}") for i in range(400)] + [(900, None), (901, "zz")], "id long, word string")
        known = [("w0", 207, 399), (None, 1, 900), *[(f"w{i}", 7, i) for i in range(2, 60, 2)]]
        stats = spark.createDataFrame(known, "word string, n long, last long")
        found = scale.attach_by_key(rows, stats, ["word"], "n", ["id"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        joins = [x for x in plan.splitlines() if "last#" in x and "Join" in x]
        assert "SortMergeJoin" in plan and not any("BroadcastHashJoin" in x for x in joins)
        last = {w: v for w, _, v in known}
        assert {r.id: r.last for r in found.collect()} == {r.id: last.get(r.word) for r in rows.collect()} and found.count() == 402
    finally:
        spark.conf.unset("grainmill.broadcast.rows")


def test_words_are_weighed_where_their_texts_are_dealt(spark, tmp_path):
    """Texts dealt by id once: no exchange of counted words, to count them or to weigh them per document."""
    texts = [(i, f"a b{i % 2} c{i % 3} a", "s", "en") for i in range(60)]
    spark.createDataFrame(texts, "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    found = mining.tfidf_l2(Tables(spark, str(tmp_path)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(id" in plan and not re.search(r"Exchange hashpartitioning\(id#\d+L, word", plan)
    assert plan.count("Exchange hashpartitioning(id") == 1
    raw = {"a": 0.5 * np.log(61 / 61), "b0": 0.25 * np.log(61 / 31), "c0": 0.25 * np.log(61 / 21)}
    got = {r.word: r.tfidf for r in found.where("id = 0").collect()}
    assert got == {w: pytest.approx(v / np.sqrt(sum(x * x for x in raw.values())), abs=1e-6) for w, v in raw.items()}
