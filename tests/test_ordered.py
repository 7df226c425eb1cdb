"""Running totals and average ranks against plain windows / pandas on tied, NULL-bearing data."""
import random

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from vendorlens.operators.ordered import average_rank, running_totals


def _data(spark, n=500, seed=7):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["a", "b", "c"]), float(rnd.randint(0, 20)), rnd.randint(1, 5)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g string, v double, w int")


def test_global_running_matches_window(spark):
    df = _data(spark)
    got = running_totals(df, [F.col("v").desc(), F.col("id").asc()], {"cw": F.col("w")}, row_number="rn")
    w = Window.orderBy(F.col("v").desc(), F.col("id").asc()).rowsBetween(Window.unboundedPreceding, 0)
    exp = df.select("id", F.row_number().over(Window.orderBy(F.col("v").desc(), F.col("id"))).alias("rn"),
                    F.sum("w").over(w).alias("cw"))
    assert sorted(got.select("id", "rn", "cw").collect()) == sorted(exp.collect())


def test_segmented_running_matches_window(spark):
    df = _data(spark).repartition(7)
    got = running_totals(df, [F.col("v").asc(), F.col("id").asc()], {"cw": F.col("w")}, row_number="rn",
                         segment_by=["g"], partitions=5)
    w = Window.partitionBy("g").orderBy("v", "id")
    exp = df.select("id", F.row_number().over(w).alias("rn"),
                    F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cw"))
    assert sorted(got.select("id", "rn", "cw").collect()) == sorted(exp.collect())


def test_result_independent_of_partitioning(spark):
    df = _data(spark)
    a = running_totals(df.repartition(1), [F.col("v"), F.col("id")], {"c": F.col("w")}, partitions=3)
    b = running_totals(df.repartition(64), [F.col("v"), F.col("id")], {"c": F.col("w")}, partitions=11)
    assert sorted(a.collect()) == sorted(b.collect())


def test_average_rank_matches_pandas_ties(spark):
    # FIXTURES "ties": 10, 10, 20, NULL, 30 -> .375, .375, .75, NULL, 1.0 as rank(pct=True)
    df = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 20.0), (4, None), (5, 30.0)], "id long, x double")
    got = average_rank(df, "x", "r", count_out="n").select("id", (F.col("r") / F.col("n")).alias("p"))
    got = {r["id"]: r["p"] for r in got.collect()}
    exp = pd.Series([10, 10, 20, None, 30], index=[1, 2, 3, 4, 5], dtype="float64").rank(pct=True)
    for i in exp.index:
        if pd.isna(exp[i]):
            assert got[i] is None
        else:
            assert abs(got[i] - exp[i]) < 1e-12


def test_following_crosses_partitions(spark):
    from vendorlens.operators.ordered import running_totals
    rows = [(i % 3, i, None if i % 7 == 0 else i * 10) for i in range(300)] + [(9, 1, 5)]
    df = spark.createDataFrame(rows, "s int, k int, v int").repartition(5)
    got = running_totals(df, [F.col("k").desc()], {"t": F.col("k")}, "n", ["s"], partitions=16, following={"nv": F.col("v"), "nk": F.col("k")}).collect()
    assert len(got) == len(rows)
    for s in (0, 1, 2, 9):
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: -r[1])
        here = sorted((r for r in got if r.s == s), key=lambda r: -r.k)
        assert [(r.k, r.n) for r in here] == [(k, i + 1) for i, (_, k, _) in enumerate(mine)]
        assert [(r.nk, r.nv) for r in here] == [(k, v) for _, k, v in mine[1:]] + [(None, None)]


def test_common_values_do_not_fill_one_task(spark):
    from vendorlens.operators.ordered import average_rank, join_common
    n = 20000
    value = F.when(F.col("id") % 10 != 0, F.lit(7.0)).when(F.col("id") % 100 != 0, F.col("id").cast("double"))
    df = spark.range(0, n, 1, 8).select("id", value.alias("v"))
    got = average_rank(df, "v", "r", count_out="c")
    tasks = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == n and max(tasks) < n // 4  # 90 % of the rows share a value
    ranks = {r.id: (r.r, r.c) for r in got.collect()}
    whole = [7.0 if i % 10 else None if i % 100 == 0 else float(i) for i in range(n)]
    known = sorted(v for v in whole if v is not None)
    below, up = {}, {}
    for place, v in enumerate(known):
        below.setdefault(v, place)
        up[v] = place + 1
    assert all(ranks[i] == ((None, None) if v is None else ((below[v] + 1 + up[v]) / 2, len(known))) for i, v in enumerate(whole))
    lookup = df.groupBy("v").count().where("v is not null").withColumn("w", F.col("v") + 1)
    assert join_common(df, lookup, ["v"], "count").where("w is null").count() == n // 100


def test_roc_keeps_the_corners(spark):
    import random

    from vendorlens.operators.stats import roc_points
    rnd = random.Random(5)
    rows = [(round(rnd.random(), 2), rnd.randint(0, 1)) for _ in range(400)] + [(None, 1), (0.5, None)] + [(1 + i / 100, 0) for i in range(50)]
    df = spark.createDataFrame(rows, "p double, y int")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        got = sorted(((r.fpr, r.tpr, -1e9 if r.threshold is None else -r.threshold) for r in roc_points(df, {"m": "p"}, "y").collect()), key=lambda r: (r[0], r[1], r[2]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    scores = sorted({p for p, y in rows if p is not None and y is not None}, reverse=True)
    step = [(sum(p == s and y == 0 for p, y in rows), sum(p == s and y == 1 for p, y in rows)) for s in scores]
    keep = [i for i in range(len(step)) if i in (0, len(step) - 1) or step[i] != step[i + 1]]
    neg, pos = sum(a for a, _ in step), sum(b for _, b in step)
    want = [(0.0, 0.0, -1e9)] + [(sum(a for a, _ in step[:i + 1]) / neg, sum(b for _, b in step[:i + 1]) / pos, -scores[i]) for i in keep]
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2])) and len(keep) < len(step)


def test_the_registered_curve_has_every_distinct_score(spark):
    from vendorlens import constants as K
    from vendorlens.registry import REGISTRY
    from vendorlens.suite.risk import PROB, fscored
    sf = "/root/testdata/sf0.001"
    scores = fscored(spark, sf).where(f"{PROB} is not null and {K.TARGET} is not null").select(PROB).distinct().count()
    got = REGISTRY["roc_curve"].build(spark, sf).collect()
    assert len(got) == scores + 1 and sum(r.threshold is None for r in got) == 1


def test_points_on_straight_lines_stay_without_corners(spark):
    from vendorlens.operators.stats import roc_points
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 1), (0.6, 0), (0.5, 0), (None, 1)], "p double, y int")
    assert {r.threshold for r in roc_points(df, {"m": "p"}, "y", corners=False).collect()} == {None, 0.9, 0.8, 0.7, 0.6, 0.5}
    assert {r.threshold for r in roc_points(df, {"m": "p"}, "y").collect()} == {None, 0.9, 0.7, 0.5}
