"""Word vectors and the combined matrix against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.operators import sparse, textmine, vectors


def low_rank_pairs(spark, n, rank):
    """Pairs whose ln(1 + weight) is a matrix of known rank."""
    rng = np.random.default_rng(n)
    half = rng.uniform(0.2, 1, (n, rank))
    matrix = half @ half.T
    rows = [(f"w{i:03}", f"w{j:03}", float(np.expm1(matrix[i, j]))) for i in range(n) for j in range(i, n)]
    return matrix, spark.createDataFrame(rows, "term_a string, term_b string, weight double").repartition(5)


@pytest.mark.parametrize("block, piece", [(7, 5), (16, 40), (8192, 500_000)])
def test_vectors_of_a_matrix_of_low_rank(spark, monkeypatch, block, piece):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "PIECE", piece)
    matrix, pairs = low_rank_pairs(spark, 40, 3)
    found = sorted((r.word, r.vec) for r in vectors.word_vectors(pairs, 6).collect())
    assert [w for w, _ in found] == [f"w{i:03}" for i in range(40)]
    table = np.array([v for _, v in found])
    assert table.shape == (40, 3) and table @ table.T == pytest.approx(matrix, abs=1e-6)


def test_largest_values_come_first(spark):
    matrix, pairs = low_rank_pairs(spark, 30, 30)
    table = np.array([r.vec for r in sorted(vectors.word_vectors(pairs, 4, rounds=6).collect())])
    values = np.linalg.eigvalsh(matrix)[::-1][:4]
    assert (table**2).sum(0) == pytest.approx(values, rel=1e-2)


def test_projection_uses_the_signs_of_the_seed(spark):
    matrix, pairs = low_rank_pairs(spark, 12, 2)
    signs = np.array([vectors.seed_signs(f"w{i:03}", 130) for i in range(12)])
    assert set(signs.ravel()) == {-1.0, 1.0}
    got = {(r.word, r.dim): r.value for r in vectors.projected(pairs, 130).collect()}
    want = matrix @ signs
    assert all(got[f"w{i:03}", d] == pytest.approx(want[i, d]) for i in range(12) for d in range(130))


def test_no_words_and_one_word(spark):
    schema = "term_a string, term_b string, weight double"
    assert vectors.word_vectors(spark.createDataFrame([], schema), 5).count() == 0
    assert vectors.word_vectors(spark.createDataFrame([(None, "a", 1.0)], schema), 5).count() == 0
    (one,) = vectors.word_vectors(spark.createDataFrame([("a", "a", 3.0)], schema), 5).collect()
    assert one.vec == pytest.approx([np.log(4) ** 0.5])


def test_matrix_positions(spark, route):
    df = spark.createDataFrame([(1, 2.0, "b"), (2, 0.0, "a"), (3, None, None), (4, 5.0, "b")], "id long, x double, g string")
    weights = spark.createDataFrame([(1, "u", 0.5), (2, "v", 0.25), (2, "u", 0.0), (3, "z", 9.0)], "id long, word string, w double")
    vocab = spark.createDataFrame([("v", 1), ("u", 2)], "word string, doc_count long")
    entries, columns = sparse.assemble(df, {"x": F.col("x"), "twice": F.col("x") * 2}, ["g"], weights, vocab, "w")
    assert sorted(tuple(r) for r in columns.collect()) == [(0, "x"), (1, "twice"), (2, "g=a"), (3, "g=b"), (4, "u"), (5, "v")]
    assert sorted(tuple(r) for r in entries.collect()) == [
        (1, 0, 2.0), (1, 1, 4.0), (1, 3, 1.0), (1, 4, 0.5), (2, 2, 1.0), (2, 5, 0.25), (4, 0, 5.0), (4, 1, 10.0), (4, 3, 1.0),
    ]


def test_pairs_are_made_once_for_both_directions(spark):
    """Word counts behind the pairs are not taken twice, once per direction."""
    texts = spark.createDataFrame([(1, "a b a c"), (2, None), (3, "b b")], "id long, text string")
    plan = vectors.projected(textmine.cooccurrence(texts), 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(term_a") == 1
    rows = [("a", "b", 1.0), ("b", "b", 2.0), (None, "z", 4.0)]
    found = vectors.mirrored(spark.createDataFrame(rows, "term_a string, term_b string, weight double")).collect()
    want = [("a", "b", 1.0), ("b", "a", 1.0), ("b", "b", 2.0), (None, "z", 4.0)]
    assert sorted(((r.word, r.context, round(np.expm1(r.weight), 9)) for r in found), key=str) == sorted(want, key=str)


def test_mean_vectors_shuffle_no_vector_per_word_of_a_document(spark, monkeypatch):
    rng = np.random.default_rng(4)
    table = rng.normal(size=(40, 8)).astype("float32")
    counts = [(d if d else None, f"w{w}", int(rng.integers(1, 5))) for d in range(60) for w in rng.choice(50, 12, replace=False)]
    words = [(f"w{w}", [float(x) for x in table[w]], 20) for w in range(40)] + [("w45", None, 3)]
    counted = spark.createDataFrame(counts, "id long, word string, n long")
    known = spark.createDataFrame(words, "word string, vec array<float>, doc_count long")
    for entries in (7, 100_000):
        monkeypatch.setattr(textmine, "BLOCK_ENTRIES", entries)
        monkeypatch.setattr(textmine, "STEP", entries)
        found = textmine.mean_embedding(counted, known)
        got = {r.id: r.features.toArray() for r in found.collect()}
        for d in {c[0] for c in counts}:
            own = [(table[int(w[1:])].astype(float), n) for i, w, n in counts if i == d and int(w[1:]) < 40]
            assert got[d] == pytest.approx(sum(v * n for v, n in own) / sum(n for _, n in own))
        assert found.count() == 60
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate(keys=[id" in x]
