"""Weighted supplier scorecard, re-ranking and weight robustness.

Percentile ranks are *relative to the passed supplier set*. All six metric ranks come from one
range-partitioned running count over the distinct (metric, value) pairs, so ties collapse to one
row; the ranks of common values return by broadcast. Neither a large supplier set nor a repeated value lands on one task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendorlens import constants as K
from vendorlens.functions.scalar import grade as grade_of
from vendorlens.operators.ordered import average_rank, running_totals
from vendorlens.session import materialize, tasks_for

# FIXED VALUES — scored metrics and direction (True = higher is better).
METRICS = [("otif_rate", True), ("avg_delay_days", False), ("reject_rate_pct", False),
           ("invoice_accuracy", True), ("dispute_rate", False), ("external_credit_score", True)]
PILLARS = ["delivery_score", "quality_score", "invoice_score", "financial_score"]


def pct_rank_metrics(sup: DataFrame, segment_by: list[str] | None = None) -> DataFrame:
    """``pr_<metric>`` = average-tie rank ÷ non-NULL count × 100 (lower-is-better metrics use
    ``(1 − r) × 100``); a NULL value keeps a NULL percentile. One row per supplier."""
    seg = list(segment_by or [])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m, _ in METRICS])
    long = sup.select(*seg, "supplier_id", F.inline(pairs))
    j = average_rank(long, "value", "rank", [*seg, "metric"], count_out="nn").withColumn("r", F.col("rank") / F.col("nn"))
    hib = F.create_map(*[x for m, h in METRICS for x in (F.lit(m), F.lit(h))])[F.col("metric")]
    pct = F.when(hib, F.col("r")).otherwise(1 - F.col("r")) * 100
    wide = (j.select(*seg, "supplier_id", "metric", pct.alias("p"))
            .groupBy(*seg, "supplier_id").pivot("metric", [m for m, _ in METRICS]).agg(F.first("p")))
    return wide.select(*seg, "supplier_id", *[F.col(m).alias("pr_" + m) for m, _ in METRICS])


def pillars(sup: DataFrame) -> DataFrame:
    """Pillar scores of every supplier (weights not involved)."""
    pr = pct_rank_metrics(sup)
    return sup.join(pr, "supplier_id", "left").withColumns({
        "delivery_score": F.col("pr_otif_rate") * 0.6 + F.col("pr_avg_delay_days") * 0.4,
        "quality_score": F.col("pr_reject_rate_pct"),
        "invoice_score": F.col("pr_invoice_accuracy") * 0.7 + F.col("pr_dispute_rate") * 0.3,
        "financial_score": F.col("pr_external_credit_score"),
    }).drop(*["pr_" + m for m, _ in METRICS])


def _normalised(w_delivery, w_quality, w_invoice, w_financial):
    tot = max(w_delivery + w_quality + w_invoice + w_financial, 1e-9)
    return [w_delivery / tot, w_quality / tot, w_invoice / tot, w_financial / tot]


def composite(wd, wq, wi, wf):
    return (F.col("delivery_score") * wd + F.col("quality_score") * wq
            + F.col("invoice_score") * wi + F.col("financial_score") * wf)


def build_scorecard(sup: DataFrame, w_delivery: float, w_quality: float, w_invoice: float,
                    w_financial: float, scored_pillars: DataFrame | None = None) -> DataFrame:
    """Pillars, weight-normalised composite (0–100), grade and rank 1..n (composite
    descending, NULL last, ties by supplier id). Pillars may be passed in to reuse them."""
    wd, wq, wi, wf = _normalised(w_delivery, w_quality, w_invoice, w_financial)
    p = scored_pillars if scored_pillars is not None else pillars(sup)
    d = p.withColumn("composite_score", composite(wd, wq, wi, wf)).withColumn("grade", grade_of(F.col("composite_score")))
    return running_totals(d, [F.col("composite_score").desc_nulls_last(), F.col("supplier_id").asc()],
                          row_number="rank")


def rank_moves(sc: DataFrame, base: DataFrame) -> DataFrame:
    """Rank move = base rank − new rank."""
    b = base.select("supplier_id", F.col("rank").alias("base_rank"), F.col("composite_score").alias("base_composite"))
    return sc.join(b, "supplier_id", "inner").withColumn("rank_move", F.col("base_rank") - F.col("rank"))


MOST_EXTREMES = 30


def k_extremes(n) -> F.Column:
    """k = max(3, min(30, n // 10))."""
    return F.greatest(F.lit(3), F.least(F.lit(MOST_EXTREMES), F.floor(n / 10)))


def stability(moves: DataFrame) -> DataFrame:
    """Spearman ρ of the two composites (Pearson on average ranks over the suppliers where
    both exist), k, top-k and bottom-k overlap, largest |move|."""
    n = moves.select(F.count(F.lit(1))).scalar()
    k = k_extremes(n)
    both = moves.where(F.col("composite_score").isNotNull() & F.col("base_composite").isNotNull())
    ranked = average_rank(average_rank(both, "composite_score", "r_now"), "base_composite", "r_base")
    rho = ranked.select(F.corr("r_now", "r_base")).scalar()
    return moves.agg(
        F.count_if((F.col("rank") > n - k) & (F.col("base_rank") > n - k)).alias("bottom_retained"),
        F.count_if((F.col("rank") <= k) & (F.col("base_rank") <= k)).alias("top_retained"),
        F.max(F.abs("rank_move")).alias("max_move"),
    ).select(n.alias("suppliers"), rho.alias("rank_corr"), k.cast("long").alias("k"), "bottom_retained",
             "top_retained", "max_move")


def grade_distribution(sc: DataFrame) -> DataFrame:
    """Suppliers per grade over the four grades (missing grades as 0)."""
    spark = sc.sparkSession
    dom = spark.createDataFrame([(g, i) for i, g in enumerate(K.GRADE_ORDER)], "grade string, grade_order int")
    cnt = sc.groupBy("grade").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(dom).join(cnt, "grade", "left").select("grade", "grade_order", F.coalesce("n", F.lit(0)).alias("suppliers"))


def pillar_profile(sc: DataFrame) -> DataFrame:
    """Mean pillar scores of the top-k and bottom-k of the ranking."""
    n = sc.select(F.count(F.lit(1))).scalar()
    k = k_extremes(n)
    tagged = sc.withColumn("slice", F.when(F.col("rank") <= k, "top").when(F.col("rank") > n - k, "bottom"))
    return (tagged.where(F.col("slice").isNotNull()).groupBy("slice")
            .agg(*[F.avg(p).alias(p) for p in PILLARS], F.count(F.lit(1)).alias("suppliers")))


def rank_movers(moves: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest absolute moves (ties in ranking order)."""
    return (moves.where(F.col("rank_move") != 0).withColumn("abs_move", F.abs("rank_move"))
            .orderBy(F.col("abs_move").desc(), F.col("rank").asc()).limit(n)
            .select("supplier_id", F.substring("supplier_name", 1, 28).alias("supplier_label"), "rank", "base_rank",
                    "rank_move", "abs_move"))


def search(sc: DataFrame, grades: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """Grade ``IN`` list and case-insensitive regex name search (NULL name never matches)."""
    d = sc
    if grades:
        d = d.where(F.col("grade").isin(grades))
    if pattern:
        d = d.where(F.coalesce(F.col("supplier_name").rlike("(?i)" + pattern), F.lit(False)))
    return d.select("rank", "supplier_id", "supplier_name", "supplier_tier", "primary_category", "abc_class",
                    "composite_score", *PILLARS, (F.col("otif_rate") * 100).alias("otif_pct"),
                    (F.col("invoice_accuracy") * 100).alias("invoice_accuracy_pct"), "external_credit_score",
                    (F.col("total_spend_inr").cast("double") / 1e7).alias("spend_cr"), "grade")


SWEEP_ROWS_PER_TASK = 1_000_000


def weight_sets(spark, n: int) -> DataFrame:
    """Deterministic weight sets 1..n. The moduli are different primes, so no two of the first 10,000 sets are equal."""
    i = F.col("id") + 1
    return spark.range(n).select(
        i.alias("weight_id"),
        (i * 37 % 101).cast("double").alias("w_delivery"),
        (i * 53 % 103).cast("double").alias("w_quality"),
        (i * 71 % 107).cast("double").alias("w_invoice"),
        (i * 89 % 109).cast("double").alias("w_financial"))


def weight_sweep(sup: DataFrame, n_sets: int = 800) -> DataFrame:
    """For each weight set, Spearman ρ against the base weights and bottom-k retention.

    Pillars and base ranks are computed once; every supplier row is repeated once per weight set with a
    generator (``explode`` of the set ids). One range-partitioned numbering by (set, score) gives the ranks: ties
    share the mean of their numbers, and ρ follows from sums per tie, so nothing is joined back. The bottom k of a
    set are a top-k query, which Spark cuts to k rows per task and set before it shuffles."""
    p = pillars(sup)
    bw = _normalised(*K.BASE_WEIGHTS.values())
    p = p.withColumn("base_composite", composite(*bw))
    base = running_totals(p, [F.col("base_composite").desc_nulls_last(), F.col("supplier_id").asc()],
                          row_number="base_rank")
    # the base ranks do not depend on the set
    base = materialize(average_rank(base, "base_composite", "r_base").select(
        "supplier_id", "base_composite", "base_rank", "r_base", *PILLARS))
    spark = sup.sparkSession
    ws = weight_sets(spark, n_sets)
    # repeated and sorted in tasks of bounded size, whatever the number of suppliers
    tasks = tasks_for(spark, base.count() * n_sets, SWEEP_ROWS_PER_TASK)
    rows = base.repartition(tasks, "supplier_id").select("*", F.explode(F.sequence(F.lit(1), F.lit(n_sets))).alias("weight_id"))
    rows = rows.join(F.broadcast(ws), "weight_id", "inner")
    tot = F.greatest(F.col("w_delivery") + F.col("w_quality") + F.col("w_invoice") + F.col("w_financial"), F.lit(1e-9))
    rows = rows.select("weight_id", "supplier_id", "base_composite", "base_rank", "r_base", composite(
        F.col("w_delivery") / tot, F.col("w_quality") / tot, F.col("w_invoice") / tot, F.col("w_financial") / tot).alias("composite_score"))
    both = rows.where(F.col("composite_score").isNotNull() & F.col("base_composite").isNotNull())
    ranked = running_totals(both.select("weight_id", "composite_score", "supplier_id", "r_base"),
                            [F.col("composite_score").asc(), F.col("supplier_id").asc()], row_number="place",
                            segment_by=["weight_id"], partitions=tasks)
    ties = ranked.groupBy("weight_id", "composite_score").agg(
        F.count(F.lit(1)).alias("c"), F.avg("place").alias("r"), F.sum("r_base").alias("b"), F.sum(F.col("r_base") ** 2).alias("bb"))
    c, x, y = F.sum("c"), F.sum(F.col("c") * F.col("r")), F.sum("b")
    rho = ties.groupBy("weight_id").agg(F.try_divide(
        F.sum(F.col("r") * F.col("b")) - x * y / c,
        F.sqrt((F.sum(F.col("c") * F.col("r") ** 2) - x * x / c) * (F.sum("bb") - y * y / c))).alias("rank_corr"))
    n = sup.select(F.count(F.lit(1))).scalar()
    k = k_extremes(n)
    worst = Window.partitionBy("weight_id").orderBy(F.col("composite_score").asc_nulls_first(), F.col("supplier_id").desc())
    bottom = rows.select("weight_id", "composite_score", "supplier_id", "base_rank", F.row_number().over(worst).alias("from_end")).where(
        F.col("from_end") <= MOST_EXTREMES)
    ret = bottom.groupBy("weight_id").agg(
        F.count_if((F.col("from_end") <= k) & (F.col("base_rank") > n - k)).alias("bottom_retained"))
    return (ws.join(rho, "weight_id", "left").join(ret, "weight_id", "left")
            .withColumn("k", k.cast("long"))
            .withColumn("bottom_retention", F.col("bottom_retained") / F.col("k")))


def sweep_summary(sweep: DataFrame) -> DataFrame:
    """Mean and least rank correlation and bottom-k retention over the weight sets."""
    return sweep.agg(F.count(F.lit(1)).alias("weight_sets"), F.avg("rank_corr").alias("mean_rank_corr"),
                     F.min("rank_corr").alias("min_rank_corr"), F.avg("bottom_retention").alias("mean_bottom_retention"),
                     F.min("bottom_retention").alias("min_bottom_retention"))
