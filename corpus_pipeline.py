"""Corpus preparation: documents through four filtering or rewriting stages and a mixing stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlens.llm import decontam, jaccard, mixing, secrets, toxicity
from vendorlens.llm.queries import table
from vendorlens.llm.tables import release, stored
from vendorlens.llm.textarrays import fold_of


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier predicts as toxic go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), F.col("toxic"), fold_of(5) != 0)
    return toxicity.score(spark, docs, model, docs.columns).where("predicted = 0").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents that links of similarity >= 0.8 on 5-word shingles form, the least id stays."""
    return jaccard.keep_one(docs, 5, 80, 100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least one word in 20 lies inside a benchmark window go; the others lose the
    words inside windows, and their ``n_chars`` follows."""
    out = decontam.cut_windows(spark, docs, table(spark, sf_dir, "benchmark", "item_id", "text"), docs.columns)
    out = out.where(~decontam.is_contaminated(F.col("n_hit"), F.col("n_words")))
    cut = F.col("n_cut") > 0
    new = {"text": F.when(cut, F.col("cut_text")).otherwise(F.col("doc.text"))}
    if "n_chars" in docs.columns:
        length = F.length("cut_text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(cut, length).otherwise(F.col("doc.n_chars"))
    return out.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported secret becomes a mask; ``n_chars`` follows the text."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, with all their columns and what the mix takes of each."""
    return mixing.mix(docs, carry=[c for c in docs.columns if c not in ("doc_id", "source")])


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: Toxicity is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage in turn; each result is written as Parquet to the shared checkpoint folder and read
    back, and the one before it released."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if last is not None:
            release(last)
        last = docs
    return docs
