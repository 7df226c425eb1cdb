"""Intermediate tables in the shared checkpoint folder."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorlens.session import ensure_checkpoint_dir


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the session's shared checkpoint folder and read it back. This cuts the
    lineage: a lost executor loses nothing that was stored."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


SMALL_BYTES = 16 << 20


def is_small(df: DataFrame, limit: int = SMALL_BYTES) -> bool:
    """Whether the rows of ``df``, measured over all of them, take at most ``limit`` bytes."""
    def width(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        return F.coalesce(F.size(c), F.lit(0)) * 8 + 16 if isinstance(field.dataType, T.ArrayType) else F.lit(16)
    measured = df.agg(F.sum(sum((width(f) for f in df.schema.fields), F.lit(16)))).first()[0]
    return (measured or 0) <= limit


def small(df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """``df``, to be broadcast if it is small; beyond that Spark joins it by shuffling."""
    return F.broadcast(df) if is_small(df, limit) else df


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
