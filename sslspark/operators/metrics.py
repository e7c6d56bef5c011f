"""Evaluation metrics and model selection (AGG4-9, WIN14-15).

Input is one long table ``(task, truth, pred)`` (task optional), so every
metric of every task is one grouped aggregate — no per-task loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sslspark.functions.arrays import cross_entropy_hard

__all__ = ["confusion_matrix", "accuracy", "balanced_accuracy", "precision_recall_f1", "eval_loss",
           "evaluate_multitask", "best_so_far", "pick_best_round"]


def confusion_matrix(df: DataFrame, truth: str = "truth", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """AGG4: counts per (truth, pred) and the row-normalised share over truth."""
    g = df.groupBy(*by, truth, pred).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, truth)))


def accuracy(df: DataFrame, truth: str = "truth", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """AGG5."""
    return df.groupBy(*by).agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"))


def _per_class(df, truth, pred, by):
    """TP / support / predicted counts per (by, class) in one pass of two
    partial aggregates (rows are exploded to at most two class keys)."""
    t = df.select(*by, F.col(truth).alias("cls"), (F.col(truth) == F.col(pred)).cast("long").alias("tp"),
                  F.lit(1).cast("long").alias("support"), F.lit(0).cast("long").alias("npred"))
    p = df.select(*by, F.col(pred).alias("cls"), F.lit(0).cast("long").alias("tp"),
                  F.lit(0).cast("long").alias("support"), F.lit(1).cast("long").alias("npred"))
    return (t.unionByName(p).groupBy(*by, "cls")
            .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("npred").alias("npred")))


def balanced_accuracy(df: DataFrame, truth: str = "truth", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """AGG6: mean recall over classes present in truth."""
    pc = _per_class(df, truth, pred, by).filter(F.col("support") > 0)
    return pc.groupBy(*by).agg(F.avg(F.col("tp") / F.col("support")).alias("balanced_accuracy"))


def precision_recall_f1(df: DataFrame, truth: str = "truth", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """AGG7: micro and macro precision / recall / F1 (zero_division = 0).

    Micro P = R = F1 = accuracy for single-label data (trap T20).  Macro
    averages over the union of true and predicted classes.
    """
    pc = _per_class(df, truth, pred, by)
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    pc = pc.withColumn("p", prec).withColumn("r", rec).withColumn(
        "f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
        .otherwise(F.lit(0.0)))
    micro_p = F.sum("tp") / F.sum("npred")
    micro_r = F.sum("tp") / F.sum("support")
    return pc.groupBy(*by).agg(
        micro_p.alias("micro_precision"), micro_r.alias("micro_recall"),
        F.when(micro_p + micro_r > 0, 2 * micro_p * micro_r / (micro_p + micro_r)).otherwise(F.lit(0.0)).alias("micro_f1"),
        F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.avg("f").alias("macro_f1"))


def eval_loss(df: DataFrame, logits_col: str = "logits", label_col: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """AGG8: mean cross-entropy over rows with label >= 0 (-1 ignored, T26)."""
    return (df.filter(F.col(label_col) >= 0)
            .groupBy(*by).agg(F.avg(cross_entropy_hard(logits_col, label_col)).alias("loss")))


def evaluate_multitask(df: DataFrame, task: str = "task", truth: str = "truth", pred: str = "pred") -> DataFrame:
    """AGG9: accuracy, balanced accuracy and P/R/F1 for every task in one job."""
    acc = accuracy(df, truth, pred, [task])
    bal = balanced_accuracy(df, truth, pred, [task])
    prf = precision_recall_f1(df, truth, pred, [task])
    return acc.join(bal, task).join(prf, task)


def best_so_far(df: DataFrame, metric: str, order_col: str, by: Sequence[str] = (), patience: int = 20) -> DataFrame:
    """WIN14: strict ``>`` running best, evaluations since the last
    improvement and the early-stop flag (``> patience``)."""
    w_prev = Window.partitionBy(*by).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    w_run = Window.partitionBy(*by).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("prev_best", F.max(metric).over(w_prev))
    out = out.withColumn("improved", F.col("prev_best").isNull() | (F.col(metric) > F.col("prev_best")))
    out = out.withColumn("best", F.greatest(F.coalesce("prev_best", F.col(metric)), F.col(metric)))
    # position of the latest improvement so far; evaluations since = rank gap
    out = out.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(order_col)))
    out = out.withColumn("_last_imp", F.max(F.when(F.col("improved"), F.col("_rn"))).over(w_run))
    out = out.withColumn("since_best", (F.col("_rn") - F.col("_last_imp")).cast("int"))
    out = out.withColumn("stop", F.col("since_best") > F.lit(patience))
    return out.drop("_rn", "_last_imp")


def pick_best_round(df: DataFrame, metric: str, order_col: str, by: Sequence[str] = ()) -> DataFrame:
    """WIN15: the row with the max metric, earliest on ties (one aggregate,
    no global sort)."""
    key = F.struct(F.col(metric).alias("m"), (-F.col(order_col)).alias("o"))
    cols = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.max_by(F.struct(*cols), key).alias("b"))
    return best.select(*by, "b.*")
