"""Sliced calculations equal the plain window over the whole key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnstile.operators import slices
from turnstile.operators.dataset import add_time_index, encoder_windows, min_encoder_rows, ordered_cutoff, ordered_split
from turnstile.operators.gold import exact_group_quantiles, group_quantiles, rolling_stats, row_labels
from turnstile.operators.joins import next_in_sequence
from turnstile.operators.slices import positions, sliced_window


def series(spark, n=400, seed=1, span=3000):
    """One key holds most rows, one is null; times tie and leave gaps."""
    draw = random.Random(seed)
    data = [
        (draw.choice(["hot", "hot", "hot", "a", "b", None]), draw.randrange(span), i, draw.randrange(-500, 900))
        for i in range(n)
    ]
    return spark.createDataFrame(data, "k string, t long, id long, v long")


SLICES = [5, 40, 10**6, None]  # many hot keys, some, none, no search


@pytest.mark.parametrize("per_slice", SLICES)
@pytest.mark.parametrize("ties", [True, False])
def test_totals(spark, rows, per_slice, ties):
    df = series(spark)
    order = ["t"] if ties else ["t", "id"]
    window = Window.partitionBy("k").orderBy(*order)
    window = (window.rangeBetween if ties else window.rowsBetween)(Window.unboundedPreceding, 0)
    got = sliced_window(df, ["k"], order, totals={"total": F.col("v")}, ties=ties, rows_per_slice=per_slice)
    want = df.withColumn("total", F.sum("v").over(window))
    assert got.columns == want.columns
    assert rows(got, "k", "id", "total") == rows(want, "k", "id", "total")


@pytest.mark.parametrize("per_slice", SLICES)
def test_positions_without_key(spark, rows, per_slice):
    df = series(spark, 100)
    got = positions(df, [], ["t", "id"], rows_per_slice=per_slice)
    want = df.withColumn("position", F.row_number().over(Window.orderBy("t", "id")))
    assert rows(got, "id", "position") == rows(want, "id", "position")


@pytest.mark.parametrize("per_slice", [2, *SLICES])
@pytest.mark.parametrize("span", [1, 30, 3000])
def test_near_rows(spark, rows, per_slice, span):
    """Narrow spans give many ties, and slices with fewer rows than the reach."""
    df = series(spark, 200, span=span)
    plain = Window.partitionBy("k").orderBy("t", "id")

    def columns(w):
        return {"next5": F.lead("v", 5).over(w), "last3": F.sum("v").over(w.rowsBetween(-3, -1)), "prev": F.lag("id").over(w)}

    got = sliced_window(df, ["k"], ["t", "id"], near=columns, before=3, after=5, rows_per_slice=per_slice)
    assert rows(got, "k", "id", "next5", "last3", "prev") == rows(df.withColumns(columns(plain)), "k", "id", "next5", "last3", "prev")


@pytest.mark.parametrize("per_slice", SLICES)
def test_totals_see_rows_that_near_columns_skip(spark, rows, per_slice):
    df = series(spark, 150)
    odd = F.col("id") % 2 == 1
    got = sliced_window(
        df,
        ["k"],
        ["t", "id"],
        totals={"total": F.col("v")},
        ties=False,
        keep=odd,
        near=lambda w: {"nxt": F.lead("id", 2).over(w)},
        after=2,
        rows_per_slice=per_slice,
    )
    plain = Window.partitionBy("k").orderBy("t", "id")
    want = df.withColumn("total", F.sum("v").over(plain.rowsBetween(Window.unboundedPreceding, 0))).filter(odd)
    want = want.withColumn("nxt", F.lead("id", 2).over(plain))
    assert rows(got, "k", "id", "total", "nxt") == rows(want, "k", "id", "total", "nxt")


def test_order_columns_of_other_types(spark, rows):
    df = series(spark, 120, span=40).withColumn("d", F.when(F.col("id") % 9 != 0, F.date_add(F.lit("2024-01-01"), F.col("t").cast("int"))))
    df = df.withColumn("x", F.col("t") / 64)
    for first in ("d", "x"):
        got = positions(df, ["k"], [first, "id"], rows_per_slice=10)
        want = df.withColumn("position", F.row_number().over(Window.partitionBy("k").orderBy(first, "id")))
        assert rows(got, "id", "position") == rows(want, "id", "position")


@pytest.mark.parametrize("per_slice", SLICES)
@pytest.mark.parametrize("with_totals", [True, False])
def test_columns_per_key(spark, rows, per_slice, with_totals):
    df = series(spark, 200)
    side = df.groupBy("k").agg(F.max("v").alias("top"), F.lit(None).cast("long").alias("none")).filter("k is null or k <> 'b'")
    totals = {"n": F.lit(1).cast("long")} if with_totals else None
    got = sliced_window(
        df, ["k"], ["t", "id"], totals=totals, ties=False, near=lambda w: {"nxt": F.lead("id").over(w)}, after=1, per_key=side, rows_per_slice=per_slice
    )
    plain = Window.partitionBy("k").orderBy("t", "id")
    want = df.withColumns({"n": F.row_number().over(plain), "nxt": F.lead("id").over(plain), "top": F.max("v").over(Window.partitionBy("k"))})
    top = F.when(F.coalesce(F.col("k"), F.lit("")) != "b", F.col("top"))
    want = want.withColumns({"top": top, "none": F.lit(None)})
    columns = ["k", "id", "nxt", "top", "none"] + (["n"] if with_totals else [])
    assert rows(got, *columns) == rows(want, *columns)


@pytest.mark.parametrize("drop_last", [True, False])
def test_next_in_sequence(spark, rows, drop_last):
    df = series(spark, 120)
    got = next_in_sequence(df, ["k"], ["t", "id"], "v", "nxt", drop_last=drop_last, rows_per_slice=10)
    want = df.withColumn("nxt", F.lead("v").over(Window.partitionBy("k").orderBy("t", "id")))
    want = want.filter("nxt is not null") if drop_last else want
    assert rows(got, "k", "id", "nxt") == rows(want, "k", "id", "nxt")


@pytest.mark.parametrize("per_slice", SLICES)
def test_rolling_stats_equal_sliding_frame(spark, per_slice):
    df = series(spark).withColumn("x", F.when(F.col("id") % 7 != 0, F.col("v") / 8)).withColumn("ts", F.timestamp_seconds("t"))
    frame = Window.partitionBy("k").orderBy("t").rangeBetween(-300, 0)
    want = df.withColumns({"m": F.avg("x").over(frame), "s": F.stddev_pop("x").over(frame)})
    got = rolling_stats(df, ["k"], "ts", "x", window_seconds=300, mean="m", std="s", rows_per_slice=per_slice)
    left = {r["id"]: r for r in got.collect()}
    assert len(left) == df.count() == got.count()
    for r in want.collect():
        mine = left[r["id"]]
        assert mine["m"] == pytest.approx(r["m"], abs=1e-9) if r["m"] is not None else mine["m"] is None
        assert mine["s"] == pytest.approx(r["s"], abs=1e-6) if r["s"] is not None else mine["s"] is None


@pytest.mark.parametrize("per_slice", SLICES)
def test_labels_on_the_rolling_pass(spark, rows, per_slice):
    df = series(spark).dropDuplicates(["k", "t"]).withColumn("ts", F.timestamp_seconds("t")).withColumn("x", F.col("v") / 8)
    want = row_labels(df, ["k"], ["t"], "x", [1, 30])
    got = rolling_stats(df, ["k"], "ts", "x", window_seconds=300, labels={"label_1": 1, "label_30": 30}, rows_per_slice=per_slice)
    assert rows(got, "k", "id", "label_1", "label_30") == rows(want, "k", "id", "label_1", "label_30")


def test_small_slices_share_tasks(spark, rows):
    """Slices keep their size, ties their slice; tasks do not grow with the number of slices."""
    df = series(spark, 3000).withColumn("v", F.col("v") % 5)
    hot = df.filter("k = 'hot'")
    n = hot.count()
    cold, dealt = slices._deal(df, hot.select("k").distinct(), n, ["k"], ["v"], 10)
    assert dealt.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and cold.count() == 3000 - n
    assert dealt.groupBy("v").agg(F.countDistinct("__slice").alias("n")).filter("n > 1").isEmpty()
    dealt = slices._deal(df, hot.select("k").distinct(), n, ["k"], ["v", "id"], 10)[1]
    sizes = dealt.groupBy("__slice").agg(F.count("*").alias("n"), F.min(F.struct("v", "id")).alias("a"), F.max(F.struct("v", "id")).alias("b")).orderBy("__slice").collect()
    assert sum(r.n for r in sizes) == n and max(r.n for r in sizes) == 10 and len(sizes) <= n / 10 + dealt.rdd.getNumPartitions()
    assert all(r.b < s.a for r, s in zip(sizes, sizes[1:]))


def test_rolling_window_ends_are_inclusive(spark):
    data = [("a", 0, 1.0), ("a", 604800, 3.0), ("a", 604801, 5.0)]
    df = spark.createDataFrame(data, "k string, t long, x double").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["t"]: r["rolling_mean_7d"] for r in rolling_stats(df, ["k"], "ts", "x").collect()}
    assert got == {0: 1.0, 604800: 2.0, 604801: 4.0}


def test_rolling_stats_hold_large_values(spark):
    df = spark.createDataFrame([("a", i, 1.0e9 + i) for i in range(4)], "k string, t long, x double")
    got = rolling_stats(df.withColumn("ts", F.timestamp_seconds("t")), ["k"], "ts", "x", digits=6)
    last = got.filter("t = 3").first()
    assert last["rolling_mean_7d"] == pytest.approx(1.0e9 + 1.5)
    assert last["rolling_std_7d"] == pytest.approx(1.25**0.5, abs=1e-6)


@pytest.mark.parametrize("per_slice", SLICES)
def test_exact_quantiles(spark, rows, per_slice):
    df = series(spark, 300).withColumn("x", F.col("v") / 4)
    probs = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    got = exact_group_quantiles(df, ["k"], "x", probs, per_slice)
    want = group_quantiles(df, ["k"], "x", probs, 1_000_000)
    assert rows(got, "k", *probs) == rows(want, "k", *probs)


def test_time_index(spark, rows):
    df = series(spark, 80, span=50).withColumn("ts", F.timestamp_seconds("t"))
    want = df.withColumn("time_idx", F.dense_rank().over(Window.orderBy("ts")) - 1)
    got = add_time_index(df, "ts", rows_per_slice=9)
    assert rows(got, "id", "time_idx") == rows(want, "id", "time_idx")
    assert min_encoder_rows(got) == 16
    assert min_encoder_rows(got.filter("time_idx < 3")) == 4
    assert min_encoder_rows(got.filter("time_idx < 9")) == 9


@pytest.mark.parametrize("per_slice", SLICES)
def test_encoder_windows(spark, rows, per_slice):
    df = series(spark, 150)
    got = encoder_windows(df, ["k"], ["t", "id"], ["v"], most=16, least=4, rows_per_slice=per_slice)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(-16, -1)
    want = df.withColumn("encoder", F.collect_list(F.struct("v")).over(w)).filter("size(encoder) >= 4")
    assert rows(got, "id", "encoder") == rows(want, "id", "encoder")


@pytest.mark.parametrize("n, accuracy", [(1, 10_000), (2, 10_000), (5, 10), (97, 10), (97, 10_000), (400, 100)])
def test_ordered_split(spark, n, accuracy):
    df = series(spark, n, seed=n)
    cutoff = ordered_cutoff(df, ["t", "id"], 0.8, accuracy)
    train, valid = ordered_split(df, ["t", "id"])
    ordered = sorted((r["t"], r["id"]) for r in df.collect())
    cut = max(int(n * 0.8), 1)
    assert tuple(cutoff) == ordered[cut - 1]
    assert {r["id"] for r in train.collect()} == {i for _, i in ordered[:cut]}
    assert {r["id"] for r in valid.collect()} == {i for _, i in ordered[cut:]}


def test_ordered_split_of_nothing(spark):
    empty = series(spark, 1).filter("false")
    train, valid = ordered_split(empty, ["t", "id"])
    assert train.count() == valid.count() == 0


def slice_sizes(spark, df, order, per_slice):
    """Rows per slice of the hot keys."""
    from turnstile.operators import slices

    hot, n_rows = slices._hot_keys(df, ["k"], per_slice)
    cold, dealt = slices._deal(df, hot, n_rows, ["k"], order, per_slice)
    assert cold.count() + dealt.count() == df.count()
    return [r["count"] for r in dealt.groupBy("k", "__slice").count().collect()]


@pytest.mark.parametrize("outlier", [0, 10**15, None])
def test_an_outlier_does_not_widen_a_slice(spark, outlier):
    df = spark.range(1_000_000, 1_020_000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), "id")
    df = df.unionByName(spark.createDataFrame([("hot", outlier, -1)], "k string, t long, id long"))
    sizes = slice_sizes(spark, df, ["t", "id"], 1000)
    assert len(sizes) > 15 and max(sizes) <= 3 * 1000


def test_ties_are_cut_along_the_further_columns(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.lit(5).alias("t"), "id")
    assert max(slice_sizes(spark, df, ["t", "id"], 1000)) <= 3 * 1000


def test_text_and_zoneless_order_columns(spark, rows):
    df = series(spark, 150).withColumn("text", F.concat(F.lit("n"), F.col("t").cast("string")))
    df = df.withColumn("ntz", F.timestamp_seconds("t").cast("timestamp_ntz"))
    for first in ("text", "ntz"):
        got = positions(df, ["k"], [first, "id"], rows_per_slice=10)
        want = df.withColumn("position", F.row_number().over(Window.partitionBy("k").orderBy(first, "id")))
        assert rows(got, "id", "position") == rows(want, "id", "position")


def test_a_hot_key_reads_the_input_twice(spark, tmp_path):
    series(spark, 300).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    got = sliced_window(df, ["k"], ["t", "id"], near=lambda w: {"nxt": F.lead("id").over(w)}, after=1, rows_per_slice=20)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1  # the ordinary keys; the hot rows come from their checkpoint
