"""Readers and writers: CSV/Parquet inputs with declared schemas, derived-table sinks."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorlens import session
from vendorlens.sources import schemas
from vendorlens.sources.adapter import Inputs

_FILES = {
    "supplier": "dim_supplier", "item": "dim_item", "contract": "dim_contract",
    "po": "fact_purchase_order", "receipt": "fact_goods_receipt", "invoice": "fact_invoice",
    "risk": "dim_supplier_quarterly_risk", "event": "fact_supplier_event",
}
PANEL = "ml_supplier_quarter_panel"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Ingest rule: floating NaN becomes SQL NULL, so comparisons and sums follow NULL logic."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.when(F.isnan(f.name), F.lit(None).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# FIXED VALUES — cells that count as missing, in columns of any type.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
           "NULL", "NaN", "None", "n/a", "nan", "null"]
#: Columns in which a token is a value: an invoice without error has the error type ``None``.
VALUES = {"invoice_error_type": ["None"]}


def _cells(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The cells as text, missing ones as ''; columns are found by position, as declared."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    rows = spark.read.schema(text).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return rows.select(*[F.coalesce(F.col(f"`{f.name}`"), F.lit("")).alias(f.name) for f in schema.fields])


def _missing(field: T.StructField):
    return F.col(f"`{field.name}`").isin([t for t in MISSING if t not in VALUES.get(field.name, [])])


def _value(field: T.StructField):
    """The cell as its declared type: NULL where it is missing or does not fit."""
    cell = F.when(~_missing(field), F.col(f"`{field.name}`"))
    return cell if isinstance(field.dataType, T.StringType) else cell.try_cast(field.dataType)


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a declared schema. Cells that hold one of ``MISSING`` read as NULL, but for those that
    ``VALUES`` names; a cell that does not fit its type reads as NULL too (``cell_counts`` tells both apart)."""
    return _cells(spark, path, schema).select(*[_value(f).alias(f.name) for f in schema.fields])


def cell_counts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(column, rows, missing, rejected): per column of a CSV table the cells that hold a missing-value token and those
    that do not fit the declared type, in one pass."""
    cells = _cells(spark, path, schema)
    sums = []
    for i, f in enumerate(schema.fields):
        sums += [F.count_if(_missing(f)).alias(f"m{i}"), F.count_if(~_missing(f) & _value(f).isNull()).alias(f"r{i}")]
    counted = cells.agg(F.count(F.lit(1)).alias("rows"), *sums)
    return counted.select(F.inline(F.array(*[F.struct(F.lit(f.name).alias("column"), F.col("rows"), F.col(f"m{i}").alias("missing"),
                                                      F.col(f"r{i}").alias("rejected")) for i, f in enumerate(schema.fields)])))


def rejected_rows(spark: SparkSession, path: str, schema: T.StructType) -> int:
    """Rows of a CSV table with a cell that does not fit the declared schema."""
    bad = F.lit(False)
    for f in schema.fields:
        bad = bad | (~_missing(f) & _value(f).isNull())
    return _cells(spark, path, schema).where(bad).count()


def read_panel(spark: SparkSession, folder: str, fmt: str = "csv") -> DataFrame:
    """The ready-made supplier x quarter panel, from which folds and models can start."""
    return _read(spark, f"{folder.rstrip('/')}/{PANEL}.{fmt}", schemas.ML_SUPPLIER_QUARTER_PANEL, fmt)


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    if fmt == "csv":
        return read_csv_table(spark, path, schema)
    return nan_to_null(spark.read.parquet(path).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]))


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON records such as the metrics record, with a declared schema."""
    return spark.read.schema(schema).json(path)


def read_inputs(spark: SparkSession, folder: str, fmt: str = "csv") -> Inputs:
    """Read the eight procurement inputs from ``folder/<name>.<fmt>``. Joins of facts get tasks by the files' length."""
    size = sum(session.stored_bytes(spark, f"{folder.rstrip('/')}/{_FILES[attr]}.{fmt}") for attr in ("po", "receipt"))
    return Inputs(**{attr: _read(spark, f"{folder.rstrip('/')}/{name}.{fmt}", schemas.INPUTS[name], fmt)
                     for attr, name in _FILES.items()}, tasks=session.tasks_for(spark, size, session.FILE_BYTES_PER_TASK))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet",
                compression: str | None = None) -> None:
    """Overwrite a derived table, in folders by ``partition_by``, so that a filter on it prunes files."""
    w = df.write.mode("overwrite")
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has ended."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_whole(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet beside ``path`` and rename it into place. A reader finds all of it or nothing, and of
    two applications that do the same work the first one's result stays."""
    spark, fs_path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path
    at, _, name = path.rpartition("/")
    beside, target = f"{at}/_{name.replace('=', '-')}-{uuid.uuid4().hex}", fs_path(path)
    df.write.parquet(beside)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) and not written(spark, path):
        fs.delete(target, True)  # a write that never ended
    if fs.exists(target) or not fs.rename(fs_path(beside), target):
        remove(spark, beside)


def remove(spark: SparkSession, path: str) -> None:
    """Delete what was written at ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_inputs(inputs: Inputs, folder: str, fmt: str = "parquet") -> None:
    """Write the eight inputs as ``read_inputs`` reads them, with the declared columns; text is compressed."""
    for attr, name in _FILES.items():
        columns = schemas.INPUTS[name].names
        write_table(getattr(inputs, attr).select(*columns), f"{folder.rstrip('/')}/{name}.{fmt}", fmt=fmt,
                    compression="gzip" if fmt == "csv" else None)
