"""Exact quantiles without a group in one buffer; capacity gain; the last quarter of a selection; all events kept."""
import numpy as np
from pyspark.sql import functions as F

from vendorlens.operators.ordered import quantiles
from vendorlens.plans import economics as E
from vendorlens.plans import portfolio as G
from vendorlens.sources.adapter import load_inputs, raw

SF = "/root/testdata/sf0.001"


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v), float(w)) for g in ("a", "b", None) for v, w in zip(rng.integers(0, 9, 101), rng.normal(size=101))]
    rows += [("a", 4.0, None)] * 200 + [("empty", None, None), ("one", 2.5, None)]  # a value held by most rows
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(5)
    probs = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q9": 0.9, "q10": 1.0}
    got = {(r["metric"], r["g"]): r for r in quantiles(df, {"v": F.col("v"), "w": F.col("w")}, probs, ["g"]).collect()}
    want = {}
    for m, i in (("v", 1), ("w", 2)):
        for g in ("a", "b", None, "one"):
            if vals := [r[i] for r in rows if r[0] == g and r[i] is not None]:
                want[m, g] = vals
    assert set(got) == set(want)
    for k, vals in want.items():
        for name, p in probs.items():
            assert abs(got[k][name] - np.quantile(vals, p)) < 1e-9, (k, name)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert quantiles(df, {"v": F.col("v")}, {"m": 0.5}).count() == 0
    assert df.where("false").select(F.lit(1)).count() == 0
    assert spark.range(1).select(quantiles(df, {"v": F.col("v")}, {"m": 0.5}).select("m").scalar().alias("m")).first().m is None


def test_quantiles_shuffle_counts_not_rows(spark):
    plan = quantiles(spark.range(1000).select(F.col("id").cast("double").alias("v")), {"v": F.col("v")}, {"m": 0.5})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_capacity_gain(spark):
    t = spark.createDataFrame([("rule", 5), ("forest", 9), ("worse", 3)], "model string, caught long")
    got = {r.model: (r.extra_caught, r.extra_worth) for r in E.capacity_gain(t, "rule", 10.0).collect()}
    assert got == {"rule": (0, 0.0), "forest": (4, 40.0), "worse": (-2, 20.0)}
    assert E.capacity_gain(t, "absent").where("extra_caught is not null").count() == 0


def test_latest_rows_fall_back_to_the_last_scored_quarter(spark):
    df = spark.createDataFrame([(1, 6, 0.2), (2, 7, 0.4), (3, 7, None), (4, 8, None)], "supplier_id long, qi int, p double")
    assert [r.supplier_id for r in G.latest_quarter_rows(df, "p").collect()] == [2]


def test_every_event_is_kept(spark):
    assert load_inputs(spark, SF).event.count() == raw(spark, SF, "events").count()
