"""Incremental incident counts with Structured Streaming.

The batch analytics count incidents per supplier, quarter and severity (A5/A24). When incident
events arrive as a stream of files, the same aggregation runs incrementally: a file source with a
declared schema, the known-supplier flag by a stream-static join, and a keyed count kept in the state
store. An event that is delivered again counts once. ``foreachBatch`` hands each updated result to a sink (for example a table the reports read).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorlens import constants as K
from vendorlens.functions import calendar as cal

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def incident_stream(spark: SparkSession, source_dir: str, suppliers: DataFrame,
                    max_files: int | None = None) -> DataFrame:
    """All streaming incidents, mapped like the batch input (severity by value, quarter from the event id);
    ``known`` tells whether the supplier id is in ``suppliers``."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    raw = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(source_dir)
    v, eid = F.col("value"), F.col("event_id")
    raw = raw.dropDuplicates(["event_id"])  # the state store keeps the ids seen
    ev = raw.select(
        "event_id", F.col("user_id").alias("supplier_id"),
        cal.label_of_quarter_number(eid % 30).alias("fiscal_quarter"),
        F.when(v >= 110, "Critical").when(v >= 70, "High").when(v >= 35, "Medium").otherwise("Low").alias("severity"))
    known = suppliers.select("supplier_id", F.lit(True).alias("known"))
    return ev.join(known, "supplier_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def incident_counts(events: DataFrame) -> DataFrame:
    """A5/A24 as a stateful streaming aggregate (complete or update output mode)."""
    return events.groupBy("supplier_id", "fiscal_quarter", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.max("known").alias("known"),
        F.count_if(F.col("severity").isin(K.HIGH_SEVERITIES)).alias("high_or_critical"))


def start(spark: SparkSession, source_dir: str, suppliers: DataFrame, checkpoint_dir: str, sink):
    """Start the incremental count; ``sink(batch_df, batch_id)`` receives each updated result.
    The checkpoint folder must be on shared storage so a restarted query resumes its state."""
    q = (incident_counts(incident_stream(spark, source_dir, suppliers))
         .writeStream.outputMode("update").option("checkpointLocation", checkpoint_dir)
         .foreachBatch(sink).start())
    return q
