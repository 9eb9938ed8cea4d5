"""Training, explanation, probes, bundles and the model swap."""

import multiprocessing
import pickle
import tracemalloc
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow import schemas as S
from riskflow.ml import boosting, bundle as bundles, contributions, probes, team as team_module, training
from riskflow.ml.team import together


@pytest.fixture(scope="module")
def data(spark):
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0
    cols = {n: u(i) * 10 for i, n in enumerate(S.BASE_FEATURES)}
    cols |= {"merchant_risk_score": u(50), "ip_risk_score": u(51), "is_device_trusted": u(52) < 0.5, "has_country_mismatch": u(53) < 0.5,
             "hour_of_day": F.floor(u(54) * 24).cast("int"), "merchant_category": F.lit("TRAVEL"), "card_type": F.lit("DEBIT")}
    df = spark.range(1500).select(F.col("id").cast("string").alias("transaction_id"), F.lit("u").alias("user_id"), *[c.alias(n) for n, c in cols.items()])
    return df.withColumn("is_fraud", (F.col("merchant_risk_score") + F.col("ip_risk_score")) > 1.2)


@pytest.fixture(scope="module")
def bundle(data):
    return training.train(data, "1", n_estimators=6, max_depth=3, skip_tuning=True)


def test_learns_and_reports(bundle):
    assert bundle.metrics["average_precision"] > 0.8
    assert set(bundle.metrics) >= {"threshold", "threshold_strategy", "confusion_matrix", "accuracy", "precision", "recall", "f1_score", "support"}
    assert set(bundle.feature_caps) == set(S.CAPPED_FEATURES)


def test_rounds_end_after_patience_at_the_best():
    best_round = boosting.best_round
    assert best_round([5, 4, 4.5, 3.9, 4, 4, 4, 1], 3) == (4, True)
    assert best_round([5, 4, 4.5, 3.9, 4], 3) == (4, False) and best_round([5, 6, 7], 2) == (1, True)
    assert best_round([float("nan")] * 3, 1) == (3, False)


def test_search_takes_the_best_trial_and_rounds_follow_the_settings(data, monkeypatch):
    asked, fits = [], boosting.fit
    monkeypatch.setattr(boosting, "fit", lambda f, n, nominal, points, rounds, patience, *a: asked.append((len(points), rounds, patience)) or fits(f, n, nominal, points, rounds, patience, *a))
    monkeypatch.setattr(training, "trial_params", lambda n, seed: [dict(training.DEFAULT_PARAMS, max_depth=d, min_child_samples=20) for d in (1, 3)])
    trained = training.train(data, "2", n_estimators=24, early_stopping_rounds=4, n_trials=2, search_rounds=5)
    assert asked == [(2, 5, 50), (1, 24, 4)]
    assert 4 < len(trained.model.trees) <= 24 and trained.params["n_estimators"] == 24 and trained.params["max_depth"] == 3
    assert set(training.SEARCH_RANGES) == set(training.DEFAULT_PARAMS)


@pytest.fixture(scope="module")
def fitting(spark, data):
    from riskflow.operators import evaluate
    from riskflow.plans.feature_vector import engineer_features

    ready = training.with_split(evaluate.with_class_weight(engineer_features(training.encoded(data))))
    return training.fitting_rows(ready, list(S.FEATURES), {}, "is_fraud").cache()


def test_lockstep_table_and_partitions_grow_the_same_trees(fitting):
    points = [dict(training.DEFAULT_PARAMS, max_depth=3, min_child_samples=15), dict(training.DEFAULT_PARAMS, max_depth=4, num_leaves=6, subsample=1.0)]
    fit = lambda df, p, **kw: boosting.fit(df, list(S.FEATURES), training.NOMINAL, p, 12, 3, **kw)
    alone = [fit(fitting, [p])[0] for p in points]
    for other in (fit(fitting.repartition(5), points), fit(fitting, points, local_rows=100)):
        for a, b in zip(alone, other):
            assert a.ensemble.trees == b.ensemble.trees and a.losses == b.losses
            assert a.average_precision == pytest.approx(b.average_precision)
    assert max(sum(f < 0 for f in t.feature) for t in alone[1].ensemble.trees) <= 6
    assert len(alone[0].ensemble.trees) > boosting.REFRESH or len(alone[1].ensemble.trees) > 3


def test_first_split_is_the_best_of_all(fitting):
    point = dict(training.DEFAULT_PARAMS, max_depth=1, min_child_samples=10, subsample=1.0, colsample_bytree=1.0, reg_alpha=0.0, reg_lambda=1.0)
    model = boosting.fit(fitting, list(S.FEATURES), training.NOMINAL, [point], 1, 1)[0].ensemble
    rows = fitting.filter("NOT is_validation").toPandas()
    x, y, w = rows[[f"x_{n}" for n in S.FEATURES]].to_numpy(float), rows.label.to_numpy(), rows.weight.to_numpy()
    p = 1 / (1 + np.exp(-model.base))
    g, h = w * (p - y), w * p * (1 - p)
    worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
    codes, every = model.binning.codes(x), np.ones(len(y), bool)
    best = max(worth(codes[:, f] <= b) + worth(codes[:, f] > b) - worth(every) for f in range(x.shape[1]) for b in range(boosting.BINS)
               if 10 <= (codes[:, f] <= b).sum() <= len(y) - 10)
    assert model.trees[0].gain[0] == pytest.approx(best, rel=1e-4)
    went = (np.uint64(model.trees[0].bins[0]) >> codes[:, model.trees[0].feature[0]].astype(np.uint64)) & np.uint64(1) == 1
    assert model.trees[0].value[model.trees[0].left[0]] == pytest.approx(-g[went].sum() / (h[went].sum() + 1) * point["learning_rate"], rel=1e-4)


def test_only_a_set_of_categories_separates_and_it_adds_up(spark):
    rows = [(float(c), float(i % 7), c in (0, 3, 5), 1.0, i % 5 == 0, i) for i in range(800) for c in [i % 8]]
    df = spark.createDataFrame(rows, "x_merchant_category double, x_amount double, label boolean, weight double, is_validation boolean, id long")
    point = dict(training.DEFAULT_PARAMS, max_depth=1, min_child_samples=10, subsample=1.0, colsample_bytree=1.0)
    names = ["merchant_category", "amount"]
    got = boosting.fit(df, names, {"merchant_category"}, [point], 30, 30)[0]
    as_numbers = boosting.fit(df, names, set(), [point], 30, 30)[0]
    assert got.average_precision == 1.0 and as_numbers.average_precision < 1.0
    left = got.ensemble.trees[0].bins[0]
    assert {c for c in range(8) if left >> (c + 1) & 1} in ({0, 3, 5}, {1, 2, 4, 6, 7})
    x = np.array([[c, 2.0] for c in range(8)] + [[np.nan, np.nan], [70.0, 1e9]])
    phi = contributions.shapley_values(x, got.ensemble)
    assert np.allclose(phi.sum(axis=1), got.ensemble.margins(got.ensemble.binning.codes(x)))
    assert np.allclose(phi[:, 1], 0)


def test_no_rows_and_no_positives(spark, fitting):
    empty = boosting.fit(fitting.limit(0), list(S.FEATURES), training.NOMINAL, [training.DEFAULT_PARAMS], 3, 3)[0]
    assert empty.ensemble.trees == [] and empty.average_precision == 0
    calm = boosting.fit(fitting.withColumn("label", F.lit(False)), list(S.FEATURES), training.NOMINAL, [training.DEFAULT_PARAMS], 3, 3)[0]
    assert calm.average_precision == 0 and calm.ensemble.base < -10


def test_pieces_of_a_model_give_the_same_scores_and_contributions(spark, data, bundle):
    from riskflow.plans.feature_vector import engineer_features

    rows = engineer_features(training.encoded(data)).limit(50)
    inputs = training.model_inputs(rows, bundle.feature_names, bundle.feature_caps)
    assert len(bundle.model.pieces(500)) > 1
    whole = {r.transaction_id: r.p for r in boosting.scored(inputs, bundle.model, "p").collect()}
    parts = {r.transaction_id: r.p for r in boosting.scored(inputs, bundle.model, "p", 500).collect()}
    assert whole == pytest.approx(parts)
    for most in (500, 1 << 20):
        for r in contributions.contributions(rows, bundle, most=most).collect():
            assert sum(r.phi) + r.base == pytest.approx(np.log(whole[r.transaction_id] / (1 - whole[r.transaction_id])))


def test_bundle_comes_back_as_it_was(spark, bundle, tmp_path):
    again = bundles.load_bundle(spark, bundles.save_bundle(bundle, spark, str(tmp_path)))
    assert again.model.trees == bundle.model.trees and again.model.binning == bundle.model.binning and again.model.base == bundle.model.base


def test_missing_base_feature_is_named(data):
    with pytest.raises(ValueError, match="ip_risk_score"):
        training.train(data.drop("ip_risk_score"), "x")


def test_split_is_repeatable(data):
    a, b = training.with_split(data), training.with_split(data.repartition(7))
    assert a.select("transaction_id", "part").exceptAll(b.select("transaction_id", "part")).count() == 0


def _random_tree(rng, features, depth):
    tree = boosting.Tree()
    open_ = [(tree.add(rng.normal(), 64.0), 0)]
    while open_:
        node, d = open_.pop(0)
        if d == depth or d and rng.random() < 0.2 or tree.cover[node] < 2:
            continue
        tree.feature[node], tree.bins[node] = int(rng.integers(features)), int(rng.integers(1, 1 << 62))
        share = rng.uniform(0.2, 0.8)
        tree.left[node] = tree.add(rng.normal(), tree.cover[node] * share)
        tree.right[node] = tree.add(rng.normal(), tree.cover[node] * (1 - share))
        open_ += [(tree.left[node], d + 1), (tree.right[node], d + 1)]
    return tree


@pytest.mark.parametrize("seed", range(6))
def test_contributions_equal_enumerated_shapley_values(seed):
    rng, features = np.random.default_rng(seed), 4
    trees = [_random_tree(rng, features, 6) for _ in range(3)]  # features come back on a path
    model = boosting.Ensemble(boosting.Binning(list("abcd"), [True] * features, [[]] * features), 0.7, trees)
    x = rng.integers(0, 60, (7, features)).astype(float)
    codes = model.binning.codes(x)

    def worth(row, known):
        def at(t, node):
            f = t.feature[node]
            if f < 0:
                return t.value[node]
            a, b = t.left[node], t.right[node]
            if f in known:
                return at(t, a if t.bins[node] >> int(row[f]) & 1 else b)
            return (t.cover[a] * at(t, a) + t.cover[b] * at(t, b)) / t.cover[node]

        return model.base + sum(at(t, 0) for t in trees)

    got = contributions.shapley_values(x, model)
    for r, row in enumerate(codes):
        for i in range(features):
            others = [j for j in range(features) if j != i]
            want = sum(factorial(len(s)) * factorial(features - 1 - len(s)) / factorial(features) * (worth(row, {*s, i}) - worth(row, set(s)))
                       for k in range(features) for s in combinations(others, k))
            assert got[r, i] == pytest.approx(want)
        assert got[r, -1] == pytest.approx(worth(row, set())) and got[r].sum() == pytest.approx(worth(row, set(range(features))))


def test_a_model_of_full_size_is_explained_in_bounded_time():
    """500 trees of depth 10: about 0.1 s a row alone, a few milliseconds in a batch."""
    import time

    rng = np.random.default_rng(5)
    trees = [_random_tree(rng, 31, 10) for _ in range(500)]
    model = boosting.Ensemble(boosting.Binning([str(i) for i in range(31)], [True] * 31, [[]] * 31), 0.0, trees)
    x = rng.integers(0, 60, (400, 31)).astype(float)
    start = time.perf_counter()
    phi = contributions.shapley_values(x, model)
    assert time.perf_counter() - start < 120
    assert np.allclose(phi.sum(axis=1), model.margins(model.binning.codes(x)))


def test_explanation_is_capped_inside_and_uncapped_outside(spark, data, bundle):
    from riskflow.plans.feature_vector import engineer_features

    rows = engineer_features(training.encoded(data))
    out = contributions.explain(training.score(rows, bundle), bundle).first()
    assert len(out.contributions) == 5
    values = {c.feature_name: c.feature_value for c in out.contributions}
    row = rows.filter(F.col("transaction_id") == out.transaction_id).first()
    assert all(v == pytest.approx(float(row[n])) for n, v in values.items())
    sizes = [abs(c.contribution) for c in out.contributions]
    assert sizes == sorted(sizes, reverse=True)


def test_probes_use_training_caps(spark, bundle):
    got = {r.probe: r.fraud_probability for r in probes.score_probes(spark, bundle).collect()}
    assert len(got) == 6 and all(0 <= p <= 1 for p in got.values())
    assert got["large_first_transaction_risky_context"] >= got["ordinary_first_transaction"]
    features = {r.probe: r for r in probes.probe_features(spark).collect()}
    assert features["large_first_transaction_risky_context"].amount_deviation == 9_999
    assert features["small_velocity_burst"].recency_velocity == pytest.approx(0.2)


def test_bad_release_leaves_the_model_in_force(spark, bundle, tmp_path):
    root, registry = str(tmp_path / "models"), str(tmp_path / "registry")
    bundles.save_bundle(bundle, spark, root)
    bundles.publish_release(spark, registry, "lgbm_1", "models", 100)
    active = bundles.ActiveModel(spark, registry, root)
    assert active.current().version == "1"
    bundles.publish_release(spark, registry, "lgbm_2", "models", 200)
    assert active.current().version == "1"
    bundles.publish_release(spark, registry, "draft", "models", 300)
    assert active.current().version == "1"


def test_first_release_must_load(spark, tmp_path):
    registry = str(tmp_path / "registry")
    bundles.publish_release(spark, registry, "lgbm_x", "models", 100)
    with pytest.raises(bundles.ModelLoadError):
        bundles.ActiveModel(spark, registry, str(tmp_path)).current()


def test_a_level_in_a_task_adds_up_at_most_half_of_the_rows(monkeypatch):
    rng = np.random.default_rng(5)
    n, width = 4000, 6
    codes = np.column_stack([rng.integers(0, size, n) for size in (64, 3, 8, 64, 2, 25)]).astype(np.uint8)
    label = rng.random(n) < codes[:, 0] / 64
    block = lambda: boosting.Block(codes, label, np.ones(n), np.arange(n) % 10 == 0, np.arange(n, dtype=np.uint64), np.zeros((1, n)))
    point = dict(training.DEFAULT_PARAMS, max_depth=4, min_child_samples=5, subsample=1.0, colsample_bytree=1.0)
    nominal, added, bincount = np.array([False, True, False, False, False, False]), [], np.bincount
    monkeypatch.setattr(boosting.np, "bincount", lambda key, *a, **k: added.append(len(key)) or bincount(key, *a, **k))
    model = boosting.Growing(point)
    boosting.grow([model], boosting.InMemory(block(), nominal, 1), 3, 9, width, nominal, 1)
    grown = int((~block().judging).sum())
    assert len(model.trees) == 3 and sum(added) <= 3 * 3 * width * grown * (1 + 3 / 2)
    # The sums are those of the whole walk, so the trees are too.
    for tree in model.trees[:1]:
        whole = block().histogram(0, boosting.Tree([-1], [0], [-1], [-1], [0.0], [0.0], [0.0]), [0], np.arange(width), np.flatnonzero(~block().judging))
        gain, feature, bins = boosting.best_splits(whole, np.arange(width), nominal, point)[0][:3]
        assert (tree.gain[0], tree.feature[0], tree.bins[0]) == (gain, feature, bins)


def test_rows_without_a_weight_spoil_only_the_sums_they_are_in():
    rng = np.random.default_rng(6)
    n, width = 3000, 4
    codes = rng.integers(0, 20, (n, width)).astype(np.uint8)
    label, weight = rng.random(n) < codes[:, 0] / 20, np.where(np.arange(n) % 500 == 0, np.nan, 1.0)
    block = boosting.Block(codes, label, weight, np.zeros(n, bool), np.arange(n, dtype=np.uint64), np.zeros((1, n)))
    point = dict(training.DEFAULT_PARAMS, max_depth=4, min_child_samples=5, subsample=1.0, colsample_bytree=1.0)
    nominal, checked = np.zeros(width, bool), []

    class Compared(boosting.InMemory):
        def splits(self, models, level, features, number):
            out = super().splits(models, level, features, number)
            whole = self.block.histogram(0, models[0].tree, models[0].open, features[0], np.arange(n))
            checked.append(np.array_equal(np.stack([self.rounds[0].hist[node] for node in models[0].open]), whole, equal_nan=True))
            return out

    boosting.grow([boosting.Growing(point)], Compared(block, nominal, 1), 1, 9, width, nominal, 1)
    assert checked and all(checked)


def test_no_level_is_summed_when_no_leaf_is_left():
    rng = np.random.default_rng(7)
    n, width = 3000, 4
    codes = rng.integers(0, 40, (n, width)).astype(np.uint8)
    block = boosting.Block(codes, rng.random(n) < codes[:, 0] / 40, np.ones(n), np.arange(n) % 9 == 0, np.arange(n, dtype=np.uint64), np.zeros((1, n)))
    point = dict(training.DEFAULT_PARAMS, max_depth=8, num_leaves=4, min_child_samples=5, subsample=0.8, colsample_bytree=1.0)
    nominal, levels = np.zeros(width, bool), []

    class Counted(boosting.InMemory):
        def splits(self, models, level, features, number):
            levels.append((number, len(models[0].open)))
            return super().splits(models, level, features, number)

    model = boosting.Growing(point)
    boosting.grow([model], Counted(block, nominal, 1), 3, 9, width, nominal, 1)
    assert [sum(f < 0 for f in t.feature) for t in model.trees] == [4] * 3
    assert levels == [(r, k) for r in range(3) for k in (1, 2)]


def test_held_margins_are_those_of_the_kept_trees():
    rng = np.random.default_rng(8)
    n, width = 2000, 3
    codes = rng.integers(0, 64, (n, width)).astype(np.uint8)
    nominal = np.array([False, True, False])
    point = dict(training.DEFAULT_PARAMS, max_depth=6, learning_rate=0.9, min_child_samples=2, subsample=0.7, colsample_bytree=1.0, reg_alpha=0.0, reg_lambda=0.1)
    for judging in (np.arange(n) % 4 == 0, np.zeros(n, bool)):
        block = boosting.Block(codes, rng.random(n) < 0.3 + codes[:, 1] / 200, np.ones(n), judging, np.arange(n, dtype=np.uint64), np.zeros((1, n)))
        model, passes = boosting.Growing(point), boosting.InMemory(block, nominal, 1)
        boosting.grow([model], passes, 12, 5, width, nominal, 1)
        ensemble = boosting.Ensemble(boosting.Binning(list("abc"), nominal.tolist(), [[]] * width), 0.0, model.trees)
        assert np.array_equal(passes.held_margins(0, model), ensemble.margins(codes[judging]))
        assert (len(model.trees) < len(model.losses)) == judging.any()


def test_training_walks_the_trees_once_for_each_part(data, monkeypatch):
    read, plans = [], {name: getattr(training.evaluate, name) for name in ("average_precision", "fbeta_threshold", "confusion", "classification_report")}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for name, evaluated in plans.items():
        monkeypatch.setattr(training.evaluate, name, lambda df, *a, _n=name, _f=evaluated, **k: read.append((_n, plan(df))) or _f(df, *a, **k))
    training.train(data, "1", n_estimators=3, max_depth=3, skip_tuning=True)
    assert {name for name, _ in read} == set(plans)
    assert not any("ArrowEvalPython" in p for _, p in read)


def test_a_batch_is_explained_in_one_walk_and_its_rows_on_their_own(monkeypatch):
    rng, walk, walks = np.random.default_rng(9), contributions.add_tree, []
    model = boosting.Ensemble(boosting.Binning(list("abcd"), [True] * 4, [[]] * 4), 0.2, [_random_tree(rng, 4, 4) for _ in range(2)])
    x = rng.integers(0, 60, (8000, 4)).astype(float)
    monkeypatch.setattr(contributions, "add_tree", lambda tree, codes, out: walks.append(len(codes)) or walk(tree, codes, out))
    whole = contributions.shapley_values(x, model)
    assert walks == [8000, 8000] and whole.flags.c_contiguous
    assert all(np.array_equal(whole[i:i + 1], contributions.shapley_values(x[i:i + 1], model)) for i in range(0, 8000, 997))


def _noise(seed, n=6000, width=5, weight=None):
    rng = np.random.default_rng(seed)
    codes = np.column_stack([rng.integers(0, size, n) for size in (64, 3, 8, 40, 25)]).astype(np.uint8)
    return boosting.Block(codes, rng.random(n) < codes[:, 0] / 64, np.ones(n) if weight is None else weight, np.arange(n) % 7 == 0,
                          np.arange(n, dtype=np.uint64), np.zeros((1, n)))


@pytest.mark.parametrize("spoilt", [False, True])
def test_processes_of_a_task_grow_the_trees_of_one(spoilt):
    weight = np.where(np.arange(6000) % 500 == 0, np.nan, 1.0) if spoilt else None
    block, nominal = _noise(11, weight=weight), np.array([False, True, False, False, False])
    point = dict(training.DEFAULT_PARAMS, max_depth=6, min_child_samples=3, subsample=0.7, colsample_bytree=0.8)

    def grown(team):
        mine = block.part(team.place, team.size)
        model, passes = boosting.Growing(point), boosting.InMemory(mine, nominal, 1, team)
        boosting.grow([model], passes, 8, 4, 5, nominal, 1)
        return model.trees, model.losses, None if spoilt else passes.held_margins(0, model), team.gather((len(mine.label), len(passes.columns[0])))

    one, three = together(1, grown), together(3, grown)
    # repr, as a NaN isn't equal to itself.
    assert repr(one[0]) == repr(three[0]) and (spoilt or max(len(t.feature) for t in one[0]) > 20)
    assert np.array_equal(one[1], three[1], equal_nan=True) and (spoilt or np.array_equal(one[2], three[2]))
    assert one[3] == [(6000, 6000)] and three[3] == [(2000, 2000)] * 3


def test_large_arrays_meet_in_turns(monkeypatch):
    monkeypatch.setattr(team_module, "TURN", 64)
    sums = together(3, lambda team: [team.sum(np.arange(n, dtype=float).reshape(1, -1) * (team.place + 1)) for n in (1, 64, 65, 1000)])
    assert all(np.array_equal(s, np.arange(s.size)[None] * 6.0) for s in sums)


@pytest.mark.parametrize("place", [0, 2])
def test_a_process_that_fails_ends_the_others(place):
    def work(team):
        for turn in range(3):
            if turn == 2 and team.place == place:
                raise ValueError("broken")
            team.sum(np.ones(3))

    with pytest.raises(ValueError if place == 0 else RuntimeError):
        together(3, work)
    assert not multiprocessing.active_children()


def test_a_model_alone_has_the_cores_and_many_share_them(spark, fitting, monkeypatch):
    cores = team_module.free_cores(spark, 1)
    assert 1 <= cores <= team_module.MOST_PROCESSES and team_module.free_cores(spark, 1000) == 1
    asked = []
    monkeypatch.setattr(boosting, "LEAST_SHARE", 100)
    monkeypatch.setattr(boosting, "with_cores", lambda spark, n: asked.append(n))
    points = [dict(training.DEFAULT_PARAMS, max_depth=4, min_child_samples=20)]
    fit = lambda: boosting.fit(fitting, list(S.FEATURES), training.NOMINAL, points, 6, 3)[0]
    together_grown = fit()
    monkeypatch.setattr(boosting, "free_cores", lambda spark, n: 1)
    alone = fit()
    assert asked == [cores, 1] and together_grown == alone


def test_readers_of_blocks_hold_a_few_of_them(spark, fitting, monkeypatch, tmp_path):
    import pyarrow.dataset as ds

    paths, records = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(boosting, "GROUP_BYTES", 1 << 12, raising=False)
    monkeypatch.setattr(boosting, "shared_dir", lambda spark, name: paths.append(str(tmp_path / f"{name}-{len(paths)}")) or paths[-1])
    spark.conf.set(records, 50)
    try:
        boosting.fit(fitting.coalesce(1), list(S.FEATURES), training.NOMINAL, [dict(training.DEFAULT_PARAMS, max_depth=2, min_child_samples=20)] * 2, 2, 2, local_rows=1)
    finally:
        spark.conf.unset(records)
    assert [p.rsplit("/", 1)[1][:4] for p in paths] == ["binn", "boos"]
    for path in paths:
        groups = [piece.num_rows for fragment in ds.dataset(path, format="parquet").get_fragments() for piece in fragment.row_groups]
        assert sum(groups) > 10 and max(groups) <= 2


def test_more_rows_than_a_task_may_hold_are_shared_by_its_processes(spark, fitting, monkeypatch):
    points = [dict(training.DEFAULT_PARAMS, max_depth=4, num_leaves=9, min_child_samples=15, subsample=s) for s in (0.6, 1.0, 0.8)]
    fit = lambda df=fitting, **kw: boosting.fit(df, list(S.FEATURES), training.NOMINAL, points, 6, 3, **kw)
    whole, total = fit(), fitting.count()
    monkeypatch.setattr(boosting, "LEAST_SHARE", 100)
    monkeypatch.setattr(boosting, "InTable", lambda *a: pytest.fail("a job a level"))
    shared = fit(fitting.repartition(5), local_rows=total - 1)
    assert shared == whole and all(len(f.ensemble.trees) > 1 for f in shared)
    # Still more rows stay in the table.
    monkeypatch.undo()
    lockstep = fit(local_rows=10)
    assert [f.ensemble.trees for f in lockstep] == [f.ensemble.trees for f in whole]


def test_teams_fill_the_cores(spark, monkeypatch):
    monkeypatch.setattr(team_module, "_executors", lambda spark: (3, 6))
    assert [team_module.teams_at_once(spark, cores) for cores in (1, 2, 4, 6)] == [18, 9, 3, 3]
    assert [team_module.free_cores(spark, tasks) for tasks in (1, 3, 4, 9, 50)] == [4, 4, 3, 2, 1]


def test_a_task_holds_the_arrays_of_a_model_alone():
    rng = np.random.default_rng(12)
    trees = [_random_tree(rng, 4, 6) for _ in range(200)]
    model = boosting.Ensemble(boosting.Binning(list("abcd"), [True] * 4, [[]] * 4), 0.2, trees)
    sent, arrays = [pickle.dumps(piece) for piece in model.pieces()], sum(a.nbytes for tree in model.packed() for a in tree)
    tracemalloc.start()
    pieces = [pickle.loads(piece) for piece in sent]
    packed = [tree for piece in pieces for tree in piece.packed()]
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(packed) == 200 and held < 2 * (arrays + 200 * 6 * 150)
    x = rng.integers(0, 60, (50, 4)).astype(float)
    codes = model.binning.codes(x)
    assert np.array_equal(model.margins(codes), pieces[0].margins(codes))
    assert np.array_equal(contributions.shapley_values(x, model), contributions.shapley_values(x, pieces[0]))


def test_rows_that_meet_the_same_conditions_are_walked_as_one(monkeypatch):
    rng, widths, zeros = np.random.default_rng(13), [], np.zeros_like
    trees = [_random_tree(rng, 4, 6) for _ in range(4)]  # features come back on a path
    model = boosting.Ensemble(boosting.Binning(list("abcd"), [True] * 4, [[]] * 4), 0.2, trees)
    x = rng.integers(0, 60, (8000, 4)).astype(float)
    monkeypatch.setattr(contributions.np, "zeros_like", lambda a: widths.append(a.shape[1]) or zeros(a))
    whole = contributions.shapley_values(x, model)
    inner = sum(f >= 0 for tree in trees for f in tree.feature)
    assert len(widths) == inner and sum(widths) < inner * len(x) / 2
    # Each row on its own to the last bit.
    assert all(np.array_equal(whole[i:i + 1], contributions.shapley_values(x[i:i + 1], model)) for i in range(0, 8000, 499))
