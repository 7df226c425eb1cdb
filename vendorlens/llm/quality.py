"""Quality selection by ordinal (cumulative-link) regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut the linear
score into grades. The result is the expected grade and the tail probability P(grade > k) for each k.
Fitted on a bounded sample of labelled rows (``max_rows``); scoring reads every whole text.

Defined results: null and empty texts have no features and get the thresholds' base probabilities;
without labelled rows all weights are zero; repeated rows are scored each for itself.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vendorlens.llm.linear import MAX_ROWS, Ordinal, fit_ordinal, labelled_sample, slots
from vendorlens.llm.textarrays import per_text


def train(docs: DataFrame, labels: DataFrame, grade, allowed, grades: int, max_rows: int = MAX_ROWS) -> Ordinal:
    """Fit on the labelled rows that ``allowed`` admits; ``grade`` runs from 0 to ``grades`` - 1."""
    lists, y = labelled_sample(docs, labels, grade, allowed, max_rows)
    return fit_ordinal(lists, np.clip(y, 0, grades - 1), grades)


def score(spark: SparkSession, docs: DataFrame, model: Ordinal, keep: list[str], select_from: int = 1) -> DataFrame:
    """Struct ``doc`` with the kept columns, ``expected_grade``, ``tails`` (P(grade > k) for ascending k) and
    ``tail_prob`` = P(grade >= select_from)."""
    held = spark.sparkContext.broadcast(model)  # the weights that the sample supports

    def make():
        m: Ordinal = held.value

        def fn(texts):
            t = np.concatenate([m.tails(m.linear(*part)) for part in slots(texts)])
            return [pa.array(t.sum(1)), pa.array(list(t), pa.list_(pa.float64())), pa.array(t[:, select_from - 1])]
        return fn
    return per_text(docs, keep, [("expected_grade", T.DoubleType()), ("tails", T.ArrayType(T.DoubleType())),
                                 ("tail_prob", T.DoubleType())], make)
