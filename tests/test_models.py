"""Metrics, boosted quantile trees, registry, training and prediction."""

import math
import random
from datetime import datetime, timedelta, timezone
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstile.operators import boosting
from turnstile.operators import registry
from turnstile.operators.boosting import BoostingParams, QuantileModel, candidates, fit_quantile, score, search_params
from turnstile.operators.dataset import feature_matrix, training_features, training_rows
from turnstile.operators.features import FEATURES, children_of
from turnstile.operators.halving import halving_search, rung_rounds
from turnstile.operators.joins import named_stations
from turnstile.operators.metrics import coverage, evaluate, mae, pinball_loss, rmse
from turnstile.plans.prediction import predict_batch
from turnstile.plans.training import TrainingConfig, load_models, run_training
from turnstile.session import shared_folder
from turnstile.showcase import QUERIES
from turnstile.showcase.data import LINE_FEATURES, line_rows, line_split


def test_metric_values(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 2.0), (2.0, 1.0)], "y double, p double")
    y, p = F.col("y"), F.col("p")
    got = df.agg(mae(y, p), rmse(y, p), pinball_loss(y, p, 0.5), pinball_loss(y, p, 0.9), coverage(y, p - 1, p + 1)).first()
    assert tuple(got) == pytest.approx((2 / 3, (2 / 3) ** 0.5, 1 / 3, (0.9 + 0.1) / 3, 1.0))
    row = evaluate(df.withColumn("hi", p + 0.5), "y", {0.5: "p", 0.9: "hi"}).first().asDict()
    assert set(row) == {f"val_{m}_{q}" for m in ("pinball", "mae", "rmse") for q in ("p50", "p90")} | {"val_coverage"}
    assert row["val_coverage"] == pytest.approx(1 / 3)


def steps(spark, n=600, seed=3):
    """Noise around a step of x, so each side has its own quantiles."""
    draw = random.Random(seed)
    data = []
    for i in range(n):
        x = draw.random()
        data.append((i, x, draw.random(), (10.0 if x > 0.5 else 0.0) + draw.random()))
    return spark.createDataFrame(data, "i long, x double, noise double, y double")


PARAMS = BoostingParams(rounds=8, learning_rate=0.4, leaves=4, min_rows=5, checkpoint_every=4)


def test_quantile_trees_learn_a_step(spark, tmp_path):
    df = steps(spark)
    train, valid = df.filter("i < 480"), df.filter("i >= 480")
    models = {f"p{int(q * 100)}": fit_quantile(train, valid, ["x", "noise"], "y", q, PARAMS) for q in (0.5, 0.9)}
    scored = score(valid, models)
    got = evaluate(scored, "y", {0.5: "p50", 0.9: "p90"}).first()
    constant = evaluate(valid.withColumn("c", F.lit(models["p50"].base)), "y", {0.5: "c"}).first()
    assert got["val_pinball_p50"] < constant["val_pinball_p50"] / 4
    below = scored.agg(F.avg((F.col("y") <= F.col("p90")).cast("double"))).first()[0]
    assert 0.8 <= below <= 0.99
    model = models["p50"]
    assert model.losses == sorted(model.losses, reverse=True) or min(model.losses) == model.losses[len(model.trees) - 1]
    assert model.mean_importance() == sum(t.splits for t in model.trees) / 2
    weights = model.feature_importance()
    assert weights["x"] > weights["noise"]
    model.save(spark, str(tmp_path / "m"))
    again = QuantileModel.load(spark, str(tmp_path / "m"))
    pairs = again.predict(model.predict(valid, "a"), "b").select("a", "b").collect()
    assert all(r["a"] == r["b"] for r in pairs)


def test_early_stopping_keeps_the_best_round(spark):
    df = steps(spark, 200).withColumn("y", F.col("noise") * 0 + F.rand(5))
    params = BoostingParams(rounds=30, learning_rate=1.0, leaves=32, min_rows=1, early_stopping=2)
    model = fit_quantile(df.filter("i < 100"), df.filter("i >= 100"), ["x", "noise"], "y", 0.5, params)
    best = model.losses.index(min(model.losses)) + 1
    assert len(model.trees) == best and len(model.losses) <= best + 2


@pytest.mark.parametrize("rows", [12_000])
def test_a_model_depends_on_the_rows_alone(spark, rows):
    df = steps(spark, rows)
    params = BoostingParams(rounds=4, leaves=6, learning_rate=0.5, min_rows=5, row_fraction=0.6, feature_fraction=0.5, checkpoint_every=3)
    train, valid = df.filter("i % 5 > 0"), df.filter("i % 5 = 0")
    one, other = (fit_quantile(train.repartition(n), valid.repartition(n), ["x", "noise"], "y", 0.9, params) for n in (4, 9))
    assert one == other and len(one.trees) > 1 and all(t.splits for t in one.trees)


def test_a_tree_keeps_to_its_number_of_leaves(spark):
    df = steps(spark, 400)
    model = fit_quantile(df, None, ["x", "noise"], "y", 0.5, BoostingParams(rounds=2, leaves=5, min_rows=2))
    assert all(t.splits <= 4 for t in model.trees)


def test_planning_does_not_grow_with_the_trees(spark):
    from turnstile.operators.boosting import Tree

    tree = Tree()
    tree.split(0, 0, 3, 1.0)
    model = QuantileModel(0.5, ["x"], 1.0, 0.1, [[float(i) for i in range(9)]], [tree] * 300)
    plan = model.predict(spark.range(5).select(F.col("id").cast("double").alias("x")), "p")
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Project") <= 2


def test_fit_needs_labels(spark):
    df = steps(spark, 5).withColumn("y", F.lit(None).cast("double"))
    with pytest.raises(ValueError, match="no labelled"):
        fit_quantile(df, None, ["x"], "y", 0.5)


def test_search_returns_a_candidate(spark):
    df = steps(spark, 120)
    start = BoostingParams(rounds=2, min_rows=5)
    best = search_params(df.filter("i < 90"), df.filter("i >= 90"), ["x", "noise"], "y", 0.5, 2, start)
    assert best.rounds == 2 and 0.01 <= best.learning_rate <= 0.3 and 16 <= best.leaves <= 128
    assert search_params(df, df, ["x"], "y", 0.5, 0, start) == start


def test_halving_drops_as_separate_fits_would(spark):
    """Every trial of the shared passes is the model of its parameters alone; drops follow from those models' losses."""
    df = steps(spark, 400)
    train, valid = df.filter("i % 4 > 0"), df.filter("i % 4 = 0").withColumn("extra", F.lit(1))
    start = BoostingParams(rounds=8, min_rows=5, bins=16, early_stopping=3, checkpoint_every=3)
    found = halving_search(train.repartition(3), valid, ["x", "noise"], "y", 0.7, 5, start)
    drawn = candidates(5, start)
    alone = [fit_quantile(train, valid, ["x", "noise"], "y", 0.7, p) for p in drawn]
    assert rung_rounds(5, 8) == [1, 2, 4]
    live = list(range(5))
    for rung in found.rungs:
        best = {i: min(alone[i].losses[: rung.rounds]) for i in live}
        assert rung.losses == pytest.approx(best, rel=1e-12)
        live = sorted(live, key=lambda i: (best[i], i))[: -(-len(live) // 2)]
        assert rung.kept == live
    assert len(found.rungs) == 3 and live == [found.number] and found.params == drawn[found.number]
    assert found.model.trees == alone[found.number].trees
    assert found.model.losses == pytest.approx(alone[found.number].losses, rel=1e-12)


def test_halving_without_validation_or_trials(spark):
    df = steps(spark, 80)
    with pytest.raises(ValueError, match="validation"):
        halving_search(df, df.limit(0), ["x"], "y", 0.5, 2, BoostingParams(rounds=2))
    start = BoostingParams(rounds=2, leaves=4, min_rows=2, bins=8)
    found = halving_search(df, df, ["x"], "y", 0.5, 0, start)
    assert found.params == start and found.rungs == [] and found.model.trees == fit_quantile(df, df, ["x"], "y", 0.5, start).trees


def test_missing_features_count_as_zero(spark):
    df = steps(spark, 100)
    model = fit_quantile(df, None, ["x", "noise"], "y", 0.5, BoostingParams(rounds=2, leaves=4, min_rows=2))
    zeros = df.limit(1).select("i", F.lit(0.0).alias("x"), F.lit("bad").alias("noise"))
    want = model.predict(zeros, "p").first()["p"]
    assert model.predict(df.limit(1).select("i"), "p").first()["p"] == want


def test_feature_matrix(spark):
    df = spark.createDataFrame([("1.5", None, 2.0), ("x", 3.0, None)], "a string, b double, label_p50 double")
    got = feature_matrix(df, ["a", "b"]).select("features", "label").collect()
    assert [(list(r["features"]), r["label"]) for r in got] == [([1.5, 0.0], 2.0), ([0.0, 3.0], 0.0)]
    with pytest.raises(ValueError, match="missing columns"):
        feature_matrix(df, ["a", "zz"])


START = datetime(2024, 1, 1)


def gold_rows(spark, n=4):
    data = [
        (i + 1, 0.5 / (i + 1), 2.0 + i / 2, 2.0 + i / 2, 2.5 + i / 2, 3.0 + 0.4 * i, f"o{i}", f"d{i}", START + timedelta(minutes=i), 10)
        for i in range(n)
    ]
    columns = "active_trips long, avg_departure_delay_s double, rolling_mean_7d double, hist_p50 double, hist_p90 double, label_p50 double, "
    return spark.createDataFrame(data, columns + "origin_stop string, dest_stop string, minute timestamp, horizon_min int")


def test_training_set_filters(spark):
    gold = gold_rows(spark, 6).unionByName(gold_rows(spark, 2).withColumn("horizon_min", F.lit(20)))
    gold = gold.unionByName(gold_rows(spark, 1).withColumn("label_p50", F.lit(None).cast("double")))
    assert training_rows(gold, 10).count() == 6
    assert training_rows(gold, 10, "2024-01-01 00:01:00", "2024-01-01 00:03:00").count() == 3
    assert training_features(gold, 10).count() == 7
    assert training_features(gold, 20, end="2024-01-01 00:00:00").count() == 1
    assert feature_matrix(training_rows(gold, 10)).first()["features"].size == 5


def test_registry(spark, tmp_path):
    path = str(tmp_path / "registry")
    early, late = datetime(2024, 1, 1, tzinfo=timezone.utc), datetime(2024, 1, 2, tzinfo=timezone.utc)
    registry.register(spark, path, "gbt", {"p50": "x"}, {"dataset": {"horizon_min": 10}}, {"mae": 1.0}, created_at=late)
    registry.register(spark, path, "gbt", {"p50": "y"}, {}, {"mae": 2.0}, created_at=early)
    registry.register(spark, path, "tft", {}, {}, {"mae": 3}, created_at=datetime(2024, 1, 3, tzinfo=timezone.utc))
    entry = registry.latest(spark, path, "gbt")
    assert (entry["version"], entry["artifacts"], entry["metrics"]) == ("20240102000000", {"p50": "x"}, {"mae": 1.0})
    assert registry.latest(spark, path, "none") is None
    assert registry.entries(spark, path).count() == 3


def test_train_register_and_predict(spark, tmp_path):
    root = str(tmp_path)
    gold = gold_rows(spark, 40)
    config = TrainingConfig(boosting=BoostingParams(rounds=3, leaves=4, min_rows=2))
    entry = run_training(spark, root, config, gold)
    assert {"val_pinball_p50", "val_pinball_p90", "val_coverage"} <= set(entry["metrics"])
    assert registry.report(spark, f"{root}/reports").filter("kind = 'metric'").count() == len(entry["metrics"])
    models = load_models(spark, root)
    assert set(models) == {"p50", "p90"} and models["p50"].features == list(FEATURES)
    snapshot = gold.withColumn("h3", F.lit("c")).withColumn("active_trips", F.col("active_trips").cast("double"))
    stops = spark.createDataFrame([], "stop_id string, stop_name string, parent_station string")
    asked = gold.select("origin_stop", "dest_stop", "horizon_min").limit(3)
    got = predict_batch(asked, snapshot, named_stations(stops), children_of(stops), models=models).collect()
    assert len(got) == 3 and all(r["p50"] > 0 and r["source"] == "direct" for r in got)


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_leaf_quantiles_are_exact(spark):
    rng = random.Random(3)
    values = [rng.choice([0.0, -0.0, 1.0, 1.0 + 2**-52, -1e300, 1e-300, rng.gauss(0, 1), float(rng.randrange(5))]) for _ in range(600)]
    rows = spark.createDataFrame([(float(i % 7), v, True, i) for i, v in enumerate(values)], "__f0 double, __y double, __train boolean, __row long")
    bounds = [[1.0, 3.0]]
    tree = boosting.Tree()
    tree.split(0, 0, 0, 1.0)
    state = boosting._packed(rows, 1, bounds).withColumn("__pred", F.lit(0.0))
    for p in (0.0, 0.1, 0.5, 0.9, 1.0):
        got = boosting._leaf_quantiles(state, 1, bounds, [], 0.1, tree, p)
        for leaf, mine in ((1, [v for i, v in enumerate(values) if i % 7 <= 1]), (2, [v for i, v in enumerate(values) if i % 7 > 1])):
            want = sorted(mine)[max(math.ceil(len(mine) * p), 1) - 1]
            assert got[leaf] == want, (leaf, p)
    keys = boosting.sortable(np.array(sorted(set(values))))
    assert (np.diff(keys) > 0).all() and (boosting.unsorted(keys) == np.array(sorted(set(values)))).all()


def test_the_state_is_blocks_of_cells(spark):
    """A few large rows, not one per training row; every pass over them gives what the rows give."""
    rng = random.Random(5)
    data = [(float(rng.randrange(5)), rng.choice([0.0, 0.5]), rng.randrange(40) / 4, i % 5 > 0, rng.getrandbits(60)) for i in range(3000)]
    rows = spark.createDataFrame(data, "__f0 double, __f1 double, __y double, __train boolean, __row long").repartition(3)
    bounds = [[0.0, 1.0, 2.0, 3.0], [0.0]]
    state = boosting._packed(rows, 2, bounds).withColumn("__pred", F.lit(4.0)).checkpoint()
    assert state.count() <= 2 * 3
    tree, limit = boosting.Tree(), 400_000
    left, right = tree.split(0, 0, 1, 1.0)
    tree.value[left], tree.value[right] = 0.5, -1.0
    shares = rows.filter("__train").withColumn("s", F.pmod(F.xxhash64(F.lit(9), "__row"), F.lit(1_000_000))).filter(f"s < {limit}")
    want = {}
    for r in shares.collect():
        bins = boosting.binned(np.array([[r["__f0"], r["__f1"]]]), bounds)[0]
        node, predicted = (0, 4.0 + 0.5 * 0.5) if bins[0] <= 1 else (1, 4.0 - 0.5)
        for f in range(2):
            n, g = want.get((node, f, bins[f]), (0, 0))
            want[node, f, bins[f]] = n + 1, g + (7000 if r["__y"] > predicted else -3000)
    later = boosting._advanced(state, 2, bounds, [tree], 0.5)
    for frame, done in ((state, [tree]), (later, [])):
        sample = boosting.shared(frame.filter("__train"), 9)
        counts, sums = boosting._level_sums(sample, 2, bounds, done, 0.5, tree, [left, right], 5, 7000, limit)
        assert {tuple(at): (counts[tuple(at)], sums[tuple(at)]) for at in np.argwhere(counts)} == want
        errors = [r["__y"] - (4.25 if r["__f0"] <= 1 else 3.5) for r in rows.filter("not __train").collect()]
        loss = sum(max(0.3 * e, -0.7 * e) for e in errors) / len(errors)
        assert boosting._loss(frame, 2, bounds, done, 0.5, 0.3) == pytest.approx(loss, rel=1e-8)


def test_a_round_passes_over_blocks_only(spark, monkeypatch):
    """What each round of a fit reads are its blocks; the rows written before packing are gone after it."""
    seen, grown = [], boosting._leaf_quantiles
    monkeypatch.setattr(boosting, "_leaf_quantiles", lambda state, *rest: seen.append(state.count()) or grown(state, *rest))
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("rows-*"))
    df = steps(spark, 500).repartition(2)
    model = fit_quantile(df.filter("i < 400"), df.filter("i >= 400"), ["x", "noise"], "y", 0.5, BoostingParams(rounds=2, leaves=4, min_rows=5, checkpoint_every=1))
    assert len(model.losses) == 2 and len(seen) == 2 and max(seen) <= 4
    assert set(folder.glob("rows-*")) == before


def test_both_quantiles_of_quantile_model_grow_on_rows_packed_once(spark, tmp_path, monkeypatch):
    """One packing without hashes, as all rows take part in each round; each model is the one of its quantile alone."""
    draw = random.Random(4)
    lines = []
    for i in range(400):
        quantity = draw.choice([None, *range(1, 11)])
        lines.append((i // 4, i % 4, i % 9, datetime(2024, 1, 1 + i % 28), quantity, draw.random() / 10, 0.02, (quantity or 0) * 10 + draw.randrange(40)))
    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_shipdate timestamp, l_quantity double, l_discount double, l_tax double, l_extendedprice double"
    lines = [(*line[:4], *(None if x is None else float(x) for x in line[4:])) for line in lines]
    spark.createDataFrame(lines, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    seen, packed = [], boosting._packed
    monkeypatch.setattr(boosting, "_packed", lambda *given: seen.append(packed(*given)) or seen[-1])
    got = QUERIES["quantile_model"](spark, str(tmp_path))
    assert [frame.columns for frame in seen] == [["__bins", "__counts", "__y", "__train"]]
    train, valid = line_split(spark, str(tmp_path))
    params = BoostingParams(rounds=12, leaves=8, learning_rate=0.3, early_stopping=3, checkpoint_every=5)
    alone = {name: fit_quantile(train, valid, LINE_FEATURES, "l_extendedprice", q, params) for q, name in ((0.5, "p50"), (0.9, "p90"))}
    assert all(model.trees for model in alone.values())
    want = score(line_rows(spark, str(tmp_path)), alone).select(*got.columns)
    assert sorted(got.collect()) == sorted(want.collect())
    half = BoostingParams(rounds=2, leaves=4, row_fraction=0.5)
    both = boosting.fit_quantiles(train, valid, LINE_FEATURES, "l_extendedprice", (0.9, 0.2), half)
    assert both == [fit_quantile(train, valid, LINE_FEATURES, "l_extendedprice", q, half) for q in (0.9, 0.2)]
