import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskforge.plans.search import METHODS, LocalScorer, Options, SparkScorer, Task, interval, learned, search, single, staged, swarms


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(1)
    x = rng.random((120, 12))
    x[:, 10], x[:, 11] = 0.5, x[:, 0]
    return x, (x[:, 2] + x[:, 5] + x[:, 8] > 1.5).astype(int), np.arange(120) % 10 < 3


@pytest.mark.parametrize("name", sorted(METHODS))
def test_method(table, name):
    o = Options(n=8, rounds=6, interval_rounds=2, seed=3)
    found, again = (search(name, Task(LocalScorer(*table)), o) for _ in range(2))
    assert len(found.mask) == 12 and set(found.mask) <= {0, 1} and sum(found.mask) > 0
    assert len(found.curve) == o.rounds and all(a >= b for a, b in zip(found.curve, found.curve[1:], strict=False))
    assert 0 <= found.fitness <= 1
    assert (found.mask, found.curve) == (again.mask, again.curve)


def test_finds_planted_features(table):
    found = search("PSOPG_SOPF", Task(LocalScorer(*table)), Options(n=12, rounds=12, seed=1))
    assert {2, 5, 8} <= {i for i, b in enumerate(found.mask) if b}


def test_models_weigh_planted_features():
    rng = np.random.default_rng(2)
    x = rng.random((300, 6))
    y = (x[:, 1] + x[:, 4] > 1).astype(int)
    for weight in (learned.forest_importance(rng, x, y), learned.gate_importance(rng, x, y)):
        assert set(np.argsort(-weight)[:2]) == {1, 4}
    assert (learned.gate_importance(rng, x, y * 0) == 0.5).all()
    # two groups that only features 0 and 3 tell apart; the others are nearly constant
    z = np.where(np.isin(np.arange(6), (0, 3)), (np.arange(80) % 2)[:, None], 0.01) + 0.01 * rng.random((80, 6))
    assert set(np.argsort(-learned.factor_weights(rng, z, np.arange(80) % 2, 6, 20))[:2]) == {0, 3}


def test_like_features_share_a_group():
    like = np.eye(4)
    like[0, 2] = like[2, 0] = 0.9
    assert [g.tolist() for g in staged.like_groups(np.array([0.5, 0.4, 0.3, 0.0]), like)] == [[0, 2], [1]]


def test_repeated_masks_swap_features():
    rng, masks = np.random.default_rng(0), np.array([[True, True, False, False], [False] * 4])
    trial = np.array([[0.9, 0.8, 0.1, 0.2], [0.1, 0.1, 0.1, 0.1], [0.9, 0.1, 0.1, 0.9]])
    out = swarms.unlike(rng, trial, masks, 0.6)
    assert (out[0] > 0.6).sum() == 2 and (out[0] > 0.6).tobytes() != masks[0].tobytes()
    assert (out[1] == trial[1]).all() and (out[2] == trial[2]).all()


def test_mates_lower_no_cost(table):
    task = Task(LocalScorer(*table)).prepared(Options(n=6, threshold=0.6))
    inside = np.arange(task.d) % 2 == 0
    x = np.concatenate((task.rng.random((6, task.d)), single.chaotic(task, 6)))
    before = np.sort(task.score(single.bits_within(x, inside, 0.6)))[:6]
    after = task.score(single.bits_within(single.mated(task, x, inside, task.options), inside, 0.6))
    assert len(after) == 6 and (after <= before).all()
    assert single.likeness(np.array([True, False]), np.array([False, True])) == pytest.approx(1) and single.likeness(np.ones(3), np.zeros(3)) == 0


def test_levels_of_the_surrogate(table):
    x, y, valid = (np.concatenate([t] * 5) for t in table)
    found = search("SAGA", Task(LocalScorer(x, y, valid)), Options(n=8, rounds=20, seed=1))
    assert found.extra["levels"] > 1 and found.extra["scored_on_samples"] > 0 and len(found.curve) == 20


def test_unknown_names_and_modes(table):
    with pytest.raises(KeyError):
        search("none", Task(LocalScorer(*table)))
    with pytest.raises(ValueError):
        search("interval_ga", Task(LocalScorer(*table)), Options(mode="none"))


def test_scorers_agree(spark, table):
    x, y, valid = table
    rows = [(i, [float(v) for v in x[i]], int(y[i]), bool(valid[i])) for i in range(len(y))]
    split = spark.createDataFrame(rows, "row_id long, features array<double>, label int, is_valid boolean")
    masks = np.array([[1] * 12, [0, 0, 1, 0, 0, 1, 0, 0, 1, 0, 0, 0], [1] + [0] * 11])
    for func, folds in ((0, 0), (1, 0), (2, 0), (0, 5)):
        o = Options(func=func, folds=folds)
        assert np.allclose(SparkScorer(split).errors(masks, o), LocalScorer(x, y, valid).errors(masks, o))


@pytest.mark.parametrize("name", ["HPSOLS", "igpso", "inf", "mrmra", "qlfs", "lapsodr", "godcpso", "CUSSPSO", "spfsr", "SAGA", "FCNDE"])
def test_value_guided_methods_agree(spark, table, name):
    """The same result whether a table is scored in this process or by jobs."""
    x, y, valid = table
    rows = [(i, [float(v) for v in x[i]], int(y[i]), bool(valid[i])) for i in range(len(y))]
    split = spark.createDataFrame(rows, "row_id long, features array<double>, label int, is_valid boolean")
    o = Options(n=4, rounds=2, seed=3)
    here, there = (search(name, Task(s), o) for s in (LocalScorer(*table), SparkScorer(split)))
    assert here.mask == there.mask and np.allclose(here.curve, there.curve)


def test_classifiers_and_unlabelled_fitness(spark, table):
    x, y, valid = table
    rows = [(i, [float(v) for v in x[i]], int(y[i]), bool(valid[i])) for i in range(len(y))]
    split = spark.createDataFrame(rows, "row_id long, features array<double>, label int, is_valid boolean")
    masks = np.array([[0, 0, 1, 0, 0, 1, 0, 0, 1, 0, 0, 0], [1] + [0] * 11])
    error = SparkScorer(split).errors(masks, Options(classifier="dt"))
    assert error[0] < error[1]
    assert np.isfinite(SparkScorer(split).errors(masks, Options(func=4))).all()
    with pytest.raises(ValueError):
        LocalScorer(*table).errors(masks, Options(classifier="dt"))


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 400), st.integers(0, 400), st.integers(0, 1 << 30))
def test_pruned_has_the_size(d, k, seed):
    rng = np.random.default_rng(seed)
    out = interval.pruned(rng.random(d), k, rng.random(d), rng)
    assert (out >= 0.5).sum() == min(k, d)


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 3000), st.integers(0, 3))
def test_bounds_ascend_within_range(d, scheme):
    n = interval.interval_count(d)
    bounds = interval.ascending(interval.partition(0, d, n, scheme, interval.least_width(d, n)), d)
    assert bounds[0] == 0 and (np.diff(bounds) >= 0).all() and bounds.max() <= d


def test_length_state():
    bounds = np.arange(0, 101, 20)
    assert interval.length_state(np.array([0.1, 0.2, 0.3, 0.4, 0.5]), bounds, 0, 100, 5)[0] == 0
    assert interval.length_state(np.array([0.5, 0.4, 0.3, 0.2, 0.1]), bounds, 0, 100, 5)[0] == 1
    assert interval.length_state(np.array([0.5, 0.2, 0.1, 0.2, 0.4]), bounds, 0, 100, 5)[0] == 2
    assert interval.length_state(np.array([0.5, 0.2, 0.1, 0.2, 0.4]), bounds, 0, 20, 5)[0] == 3


def test_learned_value():
    q = interval.learned(np.ones((4, 4)), 0, 1, 0.5, 2, 0.2, 0.0)
    assert q[0, 1] == pytest.approx(0.9) and q.sum() == pytest.approx(15.9)
