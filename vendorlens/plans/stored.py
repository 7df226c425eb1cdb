"""Marts that are built once per application and state of the input files.

The first use writes a mart as Parquet into the shared checkpoint folder; every later query of the same
application reads those files, with column pruning, pushed filters and file statistics. The files survive
lost executors. A mart belongs to the names, lengths and times of the files it was made of: after a change it is
built anew, and the old one is removed. A stopped application's records are dropped when the next one asks for a mart.

Tables of quarter grain are partitioned by the quarter's index, so that a quarter range reads its files only. Before
the write Spark rebalances the rows by quarter: few files a quarter, and a large quarter in several.
"""
from __future__ import annotations

import hashlib
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import vendorlens
from vendorlens.plans import marts as M
from vendorlens.plans import panel as P
from vendorlens.session import ensure_checkpoint_dir
from vendorlens.sources.adapter import Inputs, by_supplier, line_tasks, load_inputs, order_lines
from vendorlens.sources.io import remove, write_table

TABLES = ("region", "nation", "supplier", "part", "orders", "lineitem", "events")
_STORED: dict[tuple[str, str, str], tuple[str, str]] = {}
_SCHEMAS: dict[str, T.StructType] = {}


def fingerprint(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = TABLES) -> str:
    """A digest of the names, lengths and modification times of the input files. Tables of one file are asked from
    the file system; the files of folders are listed, counted and hashed by Spark, which does not read them."""
    jvm, found, folders = spark._jvm, [], []
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{table}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            continue
        status = fs.getFileStatus(path)
        if status.isDirectory():
            folders.append(path.toString())
        else:
            found.append((table, status.getLen(), status.getModificationTime()))
    if folders:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
        found.append(tuple(files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.sum("length")).first()))
    return hashlib.sha256(repr(found).encode()).hexdigest()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` itself, the same for every application. A local session without the
    setting (tests, laptops) has one in the machine's temporary folder."""
    own = ensure_checkpoint_dir(spark)
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.startswith("local"):
        named = f"file://{tempfile.gettempdir()}/vendorlens-work"
    return (named or own).rstrip("/")


def code_state() -> str:
    """A digest of the library's modules: work that other code began is not taken up."""
    files = sorted(p for p in Path(vendorlens.__file__).parent.rglob("*.py") if "llm" not in p.parts)
    return hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()


def resumed_at(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """The path at which ``write(path)`` goes on with long work for the present files of ``sf_dir``; a later
    application finds there what an earlier one has finished. ``name`` says all that the work depends on besides."""
    app, state = spark.sparkContext.applicationId, fingerprint(spark, sf_dir)
    key = (app, sf_dir.rstrip("/"), name)
    if _STORED.get(key, ("", ""))[0] != state:
        if key in _STORED:
            remove(spark, _STORED.pop(key)[1])
        path = f"{shared_folder(spark)}/work-{name}-{state[:24]}-{code_state()[:16]}"
        write(path)
        _STORED[key] = (state, path)
    return _STORED[key][1]


def once_at(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """The path of what ``write(path)`` wrote for the present files of ``sf_dir``."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _STORED if k[0] != app]:
        del _STORED[key]
    key, state = (app, sf_dir.rstrip("/"), name), fingerprint(spark, sf_dir)
    if key in _STORED and _STORED[key][0] != state:
        remove(spark, _STORED.pop(key)[1])
    if key not in _STORED:
        path = f"{ensure_checkpoint_dir(spark)}/mart-{name}-{uuid.uuid4().hex}"
        write(path)
        _STORED[key] = (state, path)
    return _STORED[key][1]


def once(spark: SparkSession, sf_dir: str, name: str, build, by: str | None = None) -> DataFrame:
    """The stored table ``name`` of ``sf_dir``; ``build()`` makes it on first use. ``by`` is the column that its
    files are partitioned by."""
    def write(path: str) -> None:
        df = build()
        _SCHEMAS[path] = df.schema
        write_table(df.hint("rebalance", by) if by else df, path, [by] if by else None)
    path = once_at(spark, sf_dir, name, write)
    return spark.read.schema(_SCHEMAS[path]).parquet(path).select(*_SCHEMAS[path].names)


def forget(sf_dir: str) -> None:
    """Build the marts of ``sf_dir`` anew on their next use."""
    for key in [k for k in _STORED if k[1] == sf_dir.rstrip("/")]:
        del _STORED[key]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines, those of a supplier together."""
    return once(spark, sf_dir, "lines", lambda: by_supplier(order_lines(spark, sf_dir), line_tasks(spark, sf_dir)))


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    """The eight inputs over the stored order lines."""
    return load_inputs(spark, sf_dir, lines(spark, sf_dir))


def axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "axis", lambda: M.quarter_axis(inputs(spark, sf_dir)).coalesce(1))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "suppliers",
                lambda: M.supplier_summary(inputs(spark, sf_dir), axis(spark, sf_dir)))


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarter mart, with the sums that coarser rollups need."""
    return once(spark, sf_dir, "quarters",
                lambda: M.supplier_quarter(inputs(spark, sf_dir), axis(spark, sf_dir)), "qi")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "panel", lambda: P.build_panel(
        inputs(spark, sf_dir), axis(spark, sf_dir), quarters(spark, sf_dir)), "qi")


def scored_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "scored", lambda: P.scored_panel(
        inputs(spark, sf_dir), dq=axis(spark, sf_dir), panel=panel(spark, sf_dir)), "qi")
