"""Kraljic portfolio quadrants."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlens import constants as K
from vendorlens.operators.ordered import quantiles


def latest_quarter_rows(scored: DataFrame, prob: str, fall_back: bool = False) -> DataFrame:
    """P10: rows of the latest quarter that carries a score (one-row max, then equality filter). For a selection
    without the latest scored quarter that is the greatest scored quarter it holds. With ``fall_back`` a selection
    without any score gives the rows of its greatest quarter, unscored as they are."""
    has = F.col(prob).isNotNull()
    latest = scored.select(F.max(F.when(has, F.col("qi")))).scalar()
    if not fall_back:
        return scored.where(has & (F.col("qi") == latest))
    last = scored.select(F.max("qi")).scalar()
    return scored.where((F.col("qi") == F.coalesce(latest, last)) & (has | latest.isNull()))


def kraljic_quadrants(scored: DataFrame, prob: str, risk_cut: float = 70, impact_cut: float = 70) -> DataFrame:
    """G1: supply risk = .6p + .2·sole + .2/(1+alternates); profit impact = share·criticality (0.5
    when unknown); cut-offs are exact linear quantiles of the segment."""
    seg = latest_quarter_rows(scored, prob)
    seg = seg.withColumns({
        "supply_risk": F.col(prob) * 0.6 + F.col("is_sole_source") * 0.20
                       + (1 / (1 + F.col("num_alternate_suppliers"))) * 0.20,
        "profit_impact": F.col("spend_share_of_quarter_pct") * F.coalesce("category_criticality", F.lit(0.5)),
    })
    cuts = quantiles(seg, {c: F.col(c) for c in ("supply_risk", "profit_impact")},
                     {"rq": risk_cut / 100.0, "iq": impact_cut / 100.0})
    rq = cuts.where("metric = 'supply_risk'").select("rq").scalar()
    iq = cuts.where("metric = 'profit_impact'").select("iq").scalar()
    hi_r, hi_i = F.col("supply_risk") >= rq, F.col("profit_impact") >= iq
    lo_r, lo_i = F.col("supply_risk") < rq, F.col("profit_impact") < iq
    quadrant = (F.when(hi_r & hi_i, "Strategic").when(hi_r & lo_i, "Bottleneck")
                .when(lo_r & hi_i, "Leverage").otherwise("Non-critical"))
    return seg.withColumn("quadrant", quadrant).withColumns({"risk_cutoff": rq, "impact_cutoff": iq})


def kraljic_summary(quadrants: DataFrame, prob: str, y: str = K.TARGET) -> DataFrame:
    """The four quadrants (absent ones as zeros) with count, spend, share, mean risk, observed
    failure rate and the posture text."""
    spark = quadrants.sparkSession
    dom = spark.createDataFrame([(q, i, K.QUADRANT_ACTIONS[q]) for i, q in enumerate(K.QUADRANTS)],
                                "quadrant string, quadrant_order int, action string")
    agg = quadrants.groupBy("quadrant").agg(
        F.count(F.lit(1)).alias("suppliers"), F.sum("total_spend_inr").alias("spend"),
        F.sum("spend_share_of_quarter_pct").alias("spend_share"), F.avg(prob).alias("mean_risk"),
        F.avg(y).alias("actual_failure"))
    out = F.broadcast(dom).join(agg, "quadrant", "left")
    return out.select("quadrant", "quadrant_order",
                      F.coalesce("suppliers", F.lit(0)).alias("suppliers"),
                      F.coalesce("spend", F.lit(0.0)).alias("spend"),
                      F.coalesce("spend_share", F.lit(0.0)).alias("spend_share"),
                      F.coalesce("mean_risk", F.lit(0.0)).alias("mean_risk"),
                      F.coalesce("actual_failure", F.lit(0.0)).alias("actual_failure"), "action")
