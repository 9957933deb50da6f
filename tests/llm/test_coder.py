"""The range coder: every id comes back, also over carries, short last blocks and ids that no list holds."""

import numpy as np

from grainmill.llm import coder


def test_ids_come_back():
    rng = np.random.default_rng(7)
    for ids, block in (
        (np.zeros(1), 16),
        (np.zeros(5000), 64),
        (rng.integers(0, 1 << 17, 30_000), 500),
        (rng.permutation(1 << 17)[:40_000], 4096),
        ((1 << 17) - 1 - np.repeat(np.arange(12_000), 5) % 9_000, 1000),
        (rng.zipf(1.2, 60_000) % 50_257, 333),
        (np.tile(rng.integers(0, 50_000, 40), 500), 77),
        (np.where(rng.random(50_000) < 0.97, 3, rng.integers(0, 50_000, 50_000)), 4096),
    ):
        ids = ids.astype(np.uint32)
        found = coder.from_segment(coder.to_segment([1], [len(ids)], ids, block))
        assert found[2].tolist() == ids.tolist()


def test_carries_go_through_words_of_ones():
    """Blocks whose code passes many words on the way up, one of them shorter."""
    for seed in range(20):
        rng = np.random.default_rng(seed)
        ids = np.where(rng.random(3000) < 0.999, 1, 2).astype(np.uint32)
        ids[rng.integers(0, 3000, 3)] = 100_000
        assert coder.from_segment(coder.to_segment([1], [3000], ids, 700))[2].tolist() == ids.tolist()


def test_every_range_keeps_room():
    """The distribution learns after a period, not at every step, and no range loses its last place."""
    model = coder.Model(3)
    start = model.cdf.copy()
    none = np.zeros(3, bool)
    for step in range(coder.PERIOD * 40):
        model.predict()
        assert np.array_equal(model.cdf, start) == (step < coder.PERIOD)
        model.learn(np.full(3, 5, np.uint32), np.full(3, 2), none, none)
    assert (np.diff(model.starts, axis=0) > 0).all()
    assert model.starts[0].tolist() == [0] * 3 and model.starts[-1].tolist() == [1 << coder.TOTAL_BITS] * 3
    assert (np.diff(model.starts, axis=0)[2] > 1500).all()


def test_decoded_ids_are_not_shuffled(spark, tmp_path):
    df = spark.createDataFrame([(i, f"some words {i} " * i) for i in range(30)], "doc_id long, text string")
    coder.write_tokens(df, str(tmp_path / "t"))
    found = coder.read_tokens(spark, str(tmp_path / "t"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.index("BroadcastHashJoin") < plan.index("MapInArrow")
    assert found.count() == 30
