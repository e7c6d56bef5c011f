"""Confidence masks, pseudo-labels and OOD flags (THR1-3, THR10, THR16).

Input ``(row_id, batch_id, probs)``; operators add ``conf``, ``pl`` and
``mask`` (double).  Stateless policies are pure projections; the stateful
ones (FlexMatch, FreeMatch, SoftMatch, alignment, ...) live in
``sslspark.operators.adaptive`` and reduce N rows to B x K state first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sslspark.constants import OOD, UNLABELLED
from sslspark.functions.arrays import argmax, confidence, one_hot, sharpen, smooth_label, softmax, tsa_threshold
from sslspark.functions.keys import hash_u

__all__ = ["with_conf", "ood_by_confidence", "ood_by_confidence_long", "pseudo_label", "fixed_threshold",
           "tsa_mask", "abc_mask"]


def with_conf(df: DataFrame, probs_col: str = "probs") -> DataFrame:
    """TOP1 on a probability column: ``conf`` and first-index ``pl``."""
    return df.withColumns({"conf": confidence(probs_col), "pl": argmax(probs_col)})


def ood_by_confidence(df: DataFrame, probs_col: str = "probs", label_col: str = "label_id",
                      tau: float = 0.9, out: str | None = None) -> DataFrame:
    """THR1: unlabelled rows with conf < tau become OOD (-100).

    Row-wise and batch-independent (trap T2), every row tested (T3).  Rows
    with a label keep it; only unlabelled rows can turn OOD.
    """
    out = out or label_col
    conf = confidence(probs_col)
    return df.withColumn(out, F.when((F.col(label_col) == UNLABELLED) & (conf < F.lit(tau)), F.lit(OOD))
                         .otherwise(F.col(label_col)).cast("int"))


def ood_by_confidence_long(long_df: DataFrame, probs_col: str = "probs", label_col: str = "label_id",
                           tau: float = 0.9) -> DataFrame:
    """THR1 for all tasks at once over a long ``(row, task, label_id, probs)``
    table — one pass instead of one re-read per task."""
    return ood_by_confidence(long_df, probs_col, label_col, tau)


def pseudo_label(df: DataFrame, probs_col: str = "probs", mode: str = "hard", T: float = 1.0,
                 K: int | None = None, smoothing: float | None = None, out: str = "pseudo") -> DataFrame:
    """THR2: hard (argmax, optionally label-smoothed to a K-vector) or soft
    (sharpened probabilities p^(1/T), normalised).  From logits use softmax
    first (``functions.softmax(logits, T)``)."""
    if mode == "hard":
        pl = argmax(probs_col)
        if smoothing is not None:
            if K is None:
                raise ValueError("K is needed for label smoothing")
            return df.withColumn(out, smooth_label(pl, K, smoothing))
        return df.withColumn(out, pl)
    if mode == "soft":
        return df.withColumn(out, sharpen(probs_col, T) if T != 1.0 else F.col(probs_col))
    raise ValueError(f"unknown pseudo-label mode {mode!r}")


def fixed_threshold(df: DataFrame, probs_col: str = "probs", tau: float = 0.95, out: str = "mask") -> DataFrame:
    """THR3: mask = conf >= tau."""
    return df.withColumn(out, (confidence(probs_col) >= F.lit(tau)).cast("double"))


def tsa_mask(df: DataFrame, probs_col: str, label_col: str, schedule: str, progress: float, K: int,
             out: str = "tsa_mask") -> DataFrame:
    """THR10 (UDA): labelled rows whose largest probability is <= tsa(t) stay
    in the supervised loss (whatever class has it; ``label_col`` marks the
    rows that have a label)."""
    return df.withColumn(out, (F.col(label_col).isNotNull() & (confidence(probs_col) <= tsa_threshold(schedule, progress, K))).cast("double"))


def abc_mask(df: DataFrame, probs_col: str, keep_col: str, id_col: str, seed: int, tau: float = 0.95,
             out: str = "mask") -> DataFrame:
    """THR16 (ABC): conf >= tau AND a Bernoulli(keep) draw (md5-seeded)."""
    keep = hash_u(id_col, seed) < F.col(keep_col)
    return df.withColumn(out, ((confidence(probs_col) >= F.lit(tau)) & keep).cast("double"))
