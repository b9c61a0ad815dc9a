"""The hand-made operators against brute force, with a key that holds a third of all rows."""

import random

import pytest
from pyspark.sql import Window, functions as F

from tollbook.operators.neighbourhood import pairs_within, rows_in_reach, sums_behind
from tollbook.operators.numbering import numbered
from tollbook.operators.quantiles import Distinct, grouped, med, quantiles
from tollbook.operators.ranking import first_row, most_frequent, top_per
from tollbook.operators.sampling import first_by_hash
from tollbook.operators.running import Carry, lookahead, lookback, running, span_blocks


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.34 else f"k{rng.randrange(40)}", i, rng.choice([None, 1.5, -2.0, 7.25]), rng.randrange(100)) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, at int, v double, n int").cache()


def carries():
    return [
        Carry("s", F.col("n")), Carry("s_before", F.col("n"), inclusive=False), Carry("m", F.col("v"), "max", inclusive=False),
        Carry("l", F.col("v"), "last"), Carry("l_next", F.col("v"), "last", inclusive=False, backwards=True), Carry("s_rest", F.col("n"), backwards=True),
        lookback("prev", "at", "v"), lookahead("next", "at", "v"),
    ]


@pytest.mark.parametrize("span", [1, 7, 100, 10_000])
def test_blocks_do_not_change_running_values(points, span):
    plain = running(points, ["k"], ["at"], carries())
    cut = running(points, ["k"], ["at"], carries(), span_blocks("at", span))
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.select(plain.columns).collect()))


def test_running_matches_window_functions(points):
    w = Window.partitionBy("k").orderBy("at")
    got = running(points, ["k"], ["at"], carries(), span_blocks("at", 50)).withColumns({
        "w_s": F.sum("n").over(w), "w_prev": F.lag("at").over(w), "w_next": F.lead("at").over(w)})
    bad = got.where("s <> w_s OR NOT (prev.at <=> w_prev) OR NOT (next.at <=> w_next)")
    assert bad.count() == 0


def test_block_plan_has_no_exchange_on_the_key_alone_for_rows(points):
    plan = running(points, ["k"], ["at"], [Carry("s", F.col("n"))], span_blocks("at", 50))._jdf.queryExecution().executedPlan().toString()
    assert "_block" in plan


@pytest.mark.parametrize("q", [0.0, 0.5, 0.9, 0.99, 1.0])
def test_narrowed_quantiles_are_exact(points, q):
    df = points.withColumn("x", F.when(F.col("n") % 3 == 0, F.col("n") / 1e4).otherwise(F.col("n") * 1e5 * F.signum("v")))
    exact = {r.k: r.e for r in df.groupBy("k").agg(F.percentile("x", F.lit(q)).alias("e")).collect()}
    got = {r.k: r.x for r in quantiles(df, ["k"], {"x": (F.col("x"), q)}).collect() if r.x is not None}
    assert {k: v for k, v in exact.items() if v is not None} == pytest.approx(got)


def test_grouped_is_what_percentile_gives(points):
    for keys in (["k"], []):
        small = points.groupBy(*keys).agg(F.count("*").alias("c"), F.percentile(F.col("n").cast("double"), F.lit(0.5)).alias("m"), F.percentile("v", F.lit(0.9)).alias("p"))
        large = grouped(points, keys, [F.count("*").alias("c")], {"m": med("n"), "p": (F.col("v"), 0.9)})
        assert sorted(map(tuple, small.select(*keys, "c", "m", "p").collect())) == sorted(map(tuple, large.select(*keys, "c", "m", "p").collect()))


def test_quantiles_of_large_groups_and_ties(spark):
    """Groups far larger than the sketch is exact for, with values that make up most of a group."""
    df = spark.range(400_000).select((F.col("id") % 3 == 0).alias("k"), F.when(F.col("id") % 5 < 3, 7.0).otherwise(F.xxhash64("id") / 1e17).alias("v"), F.pow(F.col("id") % 1000 / 100.0, 9).alias("w"))
    for q in (0.001, 0.25, 0.5, 0.9, 0.999):
        exact = sorted(map(tuple, df.groupBy("k").agg(F.percentile("v", F.lit(q)), F.percentile("w", F.lit(q))).collect()))
        got = sorted(map(tuple, quantiles(df, ["k"], {"v": (F.col("v"), q), "w": (F.col("w"), q)}).collect()))
        assert [r[0] for r in got] == [r[0] for r in exact] and [x for r in got for x in r[1:]] == pytest.approx([x for r in exact for x in r[1:]], rel=1e-12)


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert [tuple(r) for r in grouped(none, [], [F.count("*").alias("c")], {"m": med("v")}).collect()] == [(0, None)]
    assert grouped(none, ["k"], [F.count("*").alias("c")], {"m": med("v")}).count() == 0


def test_quantiles_move_no_rows(points):
    plan = quantiles(points, ["k"], {"x": (F.col("n"), 0.5)})._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan


def test_null_group_keys_keep_their_quantile(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    got = {r.k: r.m for r in grouped(df, ["k"], [F.count("*").alias("c")], {"m": med("v")}).collect()}
    assert got == {None: 2.0, "a": 5.0}


def test_reach_counts_positions_with_ties(spark):
    rows = [("s", p) for p in (1, 1, 2, 5, 6, 10, 10, 10)]
    df = spark.createDataFrame(rows, "k string, p long")
    got = {(r.k, r.p): r.n for r in rows_in_reach(df, ["k"], "p", 0, 4, "n").collect()}
    for p in {p for _, p in rows}:
        assert got[("s", p)] == sum(p <= x <= p + 4 for _, x in rows)


def test_pairs_within_is_the_bounded_range_join(spark):
    rng = random.Random(5)
    left = [("s", i, rng.randrange(60)) for i in range(20)]
    right = [("s", i, rng.randrange(60)) for i in range(80)]
    a = spark.createDataFrame(left, "k string, a int, p long")
    b = spark.createDataFrame(right, "k string, b int, p long")
    got = sorted((r.a, r.b) for r in pairs_within(a, b, ["k"], "p", 1, 20).collect())
    assert got == sorted((x[1], y[1]) for x in left for y in right if 0 < y[2] - x[2] <= 20)


def test_ranking(spark):
    df = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("a", "y", 2), ("a", "x", 9), ("b", None, 1)], "k string, v string, n int")
    assert sorted(map(tuple, most_frequent(df, "k", {"v": "v"}).collect())) == [("a", "x")]
    assert sorted((r.k, r.n) for r in first_row(df, "k", ["n"], ["v", "n"]).collect()) == [("a", 1), ("b", 1)]
    assert sorted((r.k, r.n) for r in top_per(df, ["k"], [F.desc("n")], 2).collect()) == [("a", 3), ("a", 9), ("b", 1)]


def test_top_per_limits_before_the_exchange(spark):
    df = spark.range(1000).withColumn("k", F.floor(F.sqrt("id")))
    plan = top_per(df, ["k"], [F.col("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_numbering_is_global_and_dense(spark):
    df = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("k")).repartition(7)
    got = [r.k for r in numbered(df, ["k"], "no").orderBy("no").collect()]
    assert got == sorted(got)
    assert [r.no for r in numbered(df, ["k"], "no").orderBy("no").select("no").collect()] == list(range(1, 5001))


@pytest.mark.parametrize("n", [0, 1, 7, 500, 1999, 2000, 5000])
def test_samples_are_the_lowest_hashes(spark, n):
    df = spark.range(1000).select((F.col("id") % 700).alias("k"), F.col("id").alias("v")).union(spark.range(1000).select(F.lit(-5).cast("long").alias("k"), F.col("id").alias("v")))  # half of all rows share a hash
    want = sorted(map(tuple, df.orderBy(F.md5(F.col("k").cast("string")), "k", "v").limit(n).collect()))
    assert sorted(map(tuple, first_by_hash(df, F.md5(F.col("k").cast("string")), n, ["k", "v"]).collect())) == want


def test_samples_do_not_pass_through_one_task(spark):
    plan = first_by_hash(spark.range(10**6), F.md5(F.col("id").cast("string")), 300_000, ["id"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in text and "GlobalLimit" not in text
    assert plan.count() == 300_000


@pytest.mark.parametrize("keys", [["k"], []])
def test_distinct_counts_keep_their_place_among_aggregates(points, keys):
    with_null = points.withColumn("k", F.nullif("k", F.lit("k3")))
    got = grouped(with_null, keys, [F.sum("n").alias("s"), Distinct("d", "n"), F.max("at").alias("m")], {"q": med("v")})
    want = with_null.groupBy(*keys).agg(F.sum("n").alias("s"), F.count_distinct("n").alias("d"), F.max("at").alias("m"), F.percentile("v", 0.5).alias("q"))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("stretch", [1, 7, 4096])
def test_sums_behind_are_range_frames(points, stretch):
    w = Window.partitionBy("k").orderBy("at").rangeBetween(-10, 0)
    moved = points.withColumn("at", F.col("at") - 1500)  # positions below zero too
    want = moved.withColumn("s", F.sum("n").over(w))
    got = sums_behind(moved, ["k"], "at", 10, F.col("n"), "s", stretch)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
