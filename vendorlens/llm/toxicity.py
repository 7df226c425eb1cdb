"""Toxicity classifier, regularised with counterfactual swaps of identity terms.

Labelled sentences that name a group are copied with the term swapped for another of its set, and for no
term at all; the fit penalises any change of the score, so the mere mention of a group carries little weight. The model is a
two-grade cumulative-link regression on hashed presence features (``linear.py``), fitted on a bounded
sample of labelled rows (``max_rows``); scoring reads every whole text.

Defined results: null and empty texts get the model's base score; without labelled rows every score is
0.5 minus an epsilon (predicted 0); repeated rows are scored each for itself.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vendorlens.llm.linear import MAX_ROWS, Ordinal, fit_ordinal, labelled_sample, slots, word_slot
from vendorlens.llm.textarrays import per_text

#: Sets of terms that name groups; a term swaps to the next one of its set.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("female", "male"),
    ("gay", "lesbian", "straight"), ("black", "white", "asian"),
    ("muslim", "christian", "jewish", "hindu", "atheist"), ("immigrant", "native"), ("young", "old"),
    ("frau", "mann"), ("femme", "homme"), ("mujer", "hombre"),
)


def swaps(terms=IDENTITY_TERMS) -> dict[int, int]:
    return {word_slot(a): word_slot(b) for group in terms for a, b in zip(group, (*group[1:], group[0]))}


def train(docs: DataFrame, labels: DataFrame, grade, allowed, terms=IDENTITY_TERMS, max_rows: int = MAX_ROWS,
          swap_penalty: float = 1.0) -> Ordinal:
    """Fit on the labelled rows that ``allowed`` admits."""
    lists, y = labelled_sample(docs, labels, grade, allowed, max_rows)
    table = swaps(terms)
    swapped = []
    for i, x in enumerate(lists):
        if any(int(s) in table for s in x[np.isin(x, list(table))]):
            swapped.append((i, np.unique(np.array([table.get(int(s), int(s)) for s in x], np.uint32))))
            swapped.append((i, x[~np.isin(x, list(table))]))
    model = fit_ordinal(lists, y, 2, swapped, set(table), swap_penalty)
    if not len(y):
        model.thresholds = np.array([1e-6])
    return model


def score(spark: SparkSession, docs: DataFrame, model: Ordinal, keep: list[str]) -> DataFrame:
    """Struct ``doc`` with the kept columns, ``score`` in [0, 1] and ``predicted`` (score >= 0.5)."""
    held = spark.sparkContext.broadcast(model)  # the weights that the sample supports

    def make():
        m: Ordinal = held.value

        def fn(texts):
            p = np.concatenate([m.tails(m.linear(*part))[:, 0] for part in slots(texts)])
            return [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
        return fn
    return per_text(docs, keep, [("score", T.DoubleType()), ("predicted", T.IntegerType())], make)
