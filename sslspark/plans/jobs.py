"""Composite text-model jobs with ``pyspark.ml`` (JOB4, JOB5, JOB7-9).

The reference fine-tunes transformer nets on GPUs; here the model is a
multinomial logistic regression on hashed TF-IDF of the whole text, so the
self-training rounds run end to end on Spark.  The driver loop only carries
round numbers and a few metrics; every round's table is cut from its lineage
with a reliable checkpoint into the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sslspark.functions.arrays import argmax, confidence, element, log_softmax
from sslspark.operators import metrics
from sslspark.operators.imbalance import top_confident_per_class
from sslspark.session import cut_lineage

__all__ = ["text_pipeline", "fit_baseline", "score", "self_train", "generational_self_train",
           "multitask_self_train"]


def text_pipeline(text_col: str, label_col: str, weight_col: str | None = None, num_features: int = 1 << 16,
                  max_iter: int = 30, reg: float = 0.01) -> Pipeline:
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"(?U)\W+", minTokenLength=1)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="_features")
    lr = LogisticRegression(featuresCol="_features", labelCol=label_col, family="multinomial",
                            maxIter=max_iter, regParam=reg, probabilityCol="_prob", rawPredictionCol="_raw",
                            predictionCol="_pred")
    if weight_col:
        lr.setWeightCol(weight_col)
    return Pipeline(stages=[tok, tf, idf, lr])


def term_frequencies(df: DataFrame, text_col: str, num_features: int = 1 << 16) -> DataFrame:
    """Tokenise and hash the whole text once (``_tf`` vectors), checkpointed:
    self-training rounds refit only IDF + the classifier on these."""
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"(?U)\W+", minTokenLength=1)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features)
    return cut_lineage(tf.transform(tok.transform(df)).drop("_tok", text_col))


def _fit_tf(train_tf: DataFrame, label_col: str, weight_col: str | None = None, max_iter: int = 30,
            reg: float = 0.01) -> PipelineModel:
    idf = IDF(inputCol="_tf", outputCol="_features")
    lr = LogisticRegression(featuresCol="_features", labelCol=label_col, family="multinomial", maxIter=max_iter,
                            regParam=reg, probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred")
    if weight_col:
        lr.setWeightCol(weight_col)
    return Pipeline(stages=[idf, lr]).fit(train_tf)


def fit_baseline(train: DataFrame, text_col: str, label_col: str, weight_col: str | None = None,
                 **kw) -> PipelineModel:
    """JOB4: supervised text classifier (one per task)."""
    d = train.withColumn(label_col, F.col(label_col).cast("double"))
    return text_pipeline(text_col, label_col, weight_col, **kw).fit(d)


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """JOB5: logits, probabilities, prediction and confidence per row."""
    out = model.transform(df)
    return out.select(*keep, vector_to_array("_raw").alias("logits"), vector_to_array("_prob").alias("probs")) \
        .withColumns({"pl": argmax("probs"), "conf": confidence("probs")})


def _report(rows: list[tuple], like: DataFrame, schema: str) -> DataFrame:
    """A handful of rows (one a round) as a DataFrame."""
    return like.sparkSession.createDataFrame(rows, schema)


def self_train(labelled: DataFrame, unlabelled: DataFrame, evaluation: DataFrame, id_col: str, text_col: str,
               label_col: str, rounds: int = 6, tau: float = 0.9, strong_text_col: str | None = None,
               patience: int = 20, **kw) -> DataFrame:
    """JOB7: score the weak view -> fixed-threshold mask -> keep the strong
    view's features with ``weight = mask`` -> refit on labelled ∪ pseudo-labelled;
    per-round accuracy on ``evaluation``, running best (WIN14).  Stops when
    ``patience`` rounds bring nothing better.  Texts are hashed once."""
    kw_fit = {k: v for k, v in kw.items() if k in ("max_iter", "reg")}
    lb = term_frequencies(labelled.select(id_col, text_col, F.col(label_col).cast("double").alias("_y"),
                                          F.lit(1.0).alias("_w")), text_col)
    ev_tf = term_frequencies(evaluation.select(id_col, text_col, label_col), text_col)
    u_weak = term_frequencies(unlabelled.select(id_col, text_col), text_col)
    u_strong = (u_weak if strong_text_col is None else
                term_frequencies(unlabelled.select(id_col, F.col(strong_text_col).alias("_strong_text")), "_strong_text"))
    train, rows, best, best_round = lb, [], -1.0, 0
    for r in range(rounds):
        model = _fit_tf(train, "_y", "_w", **kw_fit)
        ev = score(model, ev_tf, [id_col, label_col])
        acc = metrics.accuracy(ev.withColumn("truth", F.col(label_col).cast("int")).withColumnRenamed("pl", "pred")).first()["accuracy"]
        if strong_text_col is None:
            picked = score(model, u_weak, [id_col, "_tf"]).filter(F.col("conf") >= F.lit(tau))
        else:
            picked = score(model, u_weak, [id_col]).filter(F.col("conf") >= F.lit(tau)).join(u_strong, id_col)
        pseudo = cut_lineage(picked.select(id_col, F.col("pl").cast("double").alias("_y"), F.lit(1.0).alias("_w"), "_tf"))
        rows.append((r, acc, pseudo.count()))
        if acc > best:
            best, best_round = acc, r
        if r - best_round > patience:
            break
        train = lb.unionByName(pseudo)
    rep = _report(rows, labelled, "round_no int, accuracy double, n_pseudo long")
    return metrics.best_so_far(rep, "accuracy", "round_no", patience=patience)


def generational_self_train(labelled: DataFrame, unlabelled: DataFrame, evaluation: DataFrame, id_col: str,
                            text_col: str, label_col: str, K: int, generations: int = 6, alpha: float = 3.0,
                            t_min: float = 0.5, **kw) -> DataFrame:
    """JOB8 (CReST): each generation refits from scratch on labelled ∪ the
    per-class quota of the most confident pseudo-labelled rows (WIN8).

    The imbalance ratio comes from the labelled class counts.  Distribution
    alignment is progressive: the target is the labelled distribution raised
    to t (FN7), t going from 1 to ``t_min`` over the generations; the scores
    are scaled by target over mean score before they are ranked."""
    from sslspark.functions.arrays import _div_by_sum
    from sslspark.operators.imbalance import crest_quota
    kw_fit = {k: v for k, v in kw.items() if k in ("max_iter", "reg")}
    lb = term_frequencies(labelled.select(id_col, text_col, F.col(label_col).cast("double").alias("_y")), text_col)
    ev_tf = term_frequencies(evaluation.select(id_col, text_col, label_col), text_col)
    u_tf = term_frequencies(unlabelled.select(id_col, text_col), text_col)
    counts = {int(r["_y"]): r["n"] for r in lb.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}  # K rows
    n = [max(1, counts.get(c, 0)) for c in range(K)]
    rates = crest_quota(K, max(n) / min(n), alpha)
    train, rows = lb, []
    for g in range(generations):
        t = 1.0 - (1.0 - t_min) * g / max(1, generations - 1)
        raised = [(x / sum(n)) ** t for x in n]
        target = [x / sum(raised) for x in raised]
        model = _fit_tf(train, "_y", **kw_fit)
        ev = score(model, ev_tf, [id_col, label_col])
        acc = metrics.accuracy(ev.withColumn("truth", F.col(label_col).cast("int")).withColumnRenamed("pl", "pred")).first()["accuracy"]
        sc = score(model, u_tf, [id_col, "_tf"])
        mean = sc.agg(*[F.avg(F.col("probs")[c]) for c in range(K)]).first()  # K numbers
        scale = F.array(*[F.lit(target[c] / max(mean[c] or 0.0, 1e-12)) for c in range(K)])
        sc = sc.withColumn("probs", _div_by_sum(F.zip_with("probs", scale, lambda p, s: p * s))).withColumn("pl", argmax("probs"))
        picked = top_confident_per_class(sc, rates, id_col=id_col).filter("picked")
        picked = cut_lineage(picked.select(id_col, "_tf", F.col("pl").cast("double").alias("_y")))
        rows.append((g, acc, t, picked.count()))
        train = lb.unionByName(picked)
    return _report(rows, labelled, "generation int, accuracy double, t double, n_picked long")


def multitask_self_train(labelled: DataFrame, unlabelled: DataFrame, evaluation: DataFrame, id_col: str, text_col: str,
                         task_col: str, relation_col: str, rounds: int = 6, tau: float = 0.95, w_task: float = 1.0,
                         w_rel: float = 0.5, **kw) -> DataFrame:
    """JOB9: a task head and a relation head on the same text features.

    The relation head is fitted on every row (each has a relation); the task
    head on the rows with a task label, and from the second round on also on
    the rows without (sentinel -200) whose weak score reaches ``tau``, with
    their pseudo-label.  Per round: accuracies and the loss
    ``w_task * CE(task) + w_rel * CE(relation)`` on ``evaluation``."""
    kw_fit = {k: v for k, v in kw.items() if k in ("max_iter", "reg")}
    task, rel = F.col(task_col).cast("double").alias("_y"), F.col(relation_col).cast("double").alias("_r")
    every = term_frequencies(labelled.select(id_col, text_col, task, rel).unionByName(unlabelled.select(id_col, text_col, task, rel)), text_col)
    ev_tf = term_frequencies(evaluation.select(id_col, text_col, task_col, relation_col), text_col)
    lb, ulb = every.filter(F.col("_y") >= 0), every.filter(F.col("_y") == -200.0)
    ev_r = score(_fit_tf(every, "_r", **kw_fit), ev_tf, [id_col]).select(id_col, F.col("logits").alias("lr"), F.col("pl").alias("pl_rel"))
    ev_r = cut_lineage(ev_r)
    train, rows = lb.select(id_col, "_tf", "_y"), []
    for r in range(rounds):
        model = _fit_tf(train, "_y", **kw_fit)
        ev_t = score(model, ev_tf, [id_col, task_col, relation_col]).withColumnRenamed("logits", "lt").withColumnRenamed("pl", "pl_task")
        j = ev_t.join(ev_r, id_col)
        ce_t, ce_r = -element(log_softmax("lt"), F.col(task_col)), -element(log_softmax("lr"), F.col(relation_col))
        m = j.agg(F.avg((F.col(task_col) == F.col("pl_task")).cast("double")), F.avg((F.col(relation_col) == F.col("pl_rel")).cast("double")),
                  F.avg(F.lit(w_task) * ce_t + F.lit(w_rel) * ce_r), F.avg(ce_r)).first()
        pseudo = cut_lineage(score(model, ulb, [id_col, "_tf"]).filter(F.col("conf") >= F.lit(tau))
                             .select(id_col, "_tf", F.col("pl").cast("double").alias("_y")))
        rows.append((r, *m, pseudo.count()))
        train = lb.select(id_col, "_tf", "_y").unionByName(pseudo)
    return _report(rows, labelled, "round_no int, task_accuracy double, relation_accuracy double, weighted_loss double, relation_loss double, n_pseudo long")
