"""Evaluation queries (AGG4-9, WIN14-15, JOB6) over the scored fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sslspark.operators import encode, metrics, policies
from sslspark.plans import corpus_jobs
from sslspark.plans import fixtures as fx
from sslspark.plans import sql_expr as X
from sslspark.plans.catalog import query, r6
from sslspark.plans.q_sources import scratch
from sslspark.plans.sql_fixtures import with_ctes


def preds(spark, sf) -> DataFrame:
    s = policies.with_conf(fx.scored(spark, sf))
    return s.select("row_id", "batch_id", F.col("label_true").alias("truth"), F.col("pl").alias("pred"), "logits")


def two_task_preds(spark, sf) -> DataFrame:
    w = policies.with_conf(fx.scored(spark, sf)).select(F.lit("weak").alias("task"), F.col("label_true").alias("truth"),
                                                         F.col("pl").alias("pred"))
    s = policies.with_conf(fx.scored(spark, sf, strong=True)).select(
        F.lit("strong").alias("task"), F.col("label_true").alias("truth"), F.col("pl").alias("pred"))
    return w.unionByName(s)


P_SQL = f"SELECT row_id, batch_id, label_true AS truth, {X.argmax('probs')} AS pred, logits FROM scored"
TT_SQL = (f"SELECT 'weak' AS task, label_true AS truth, {X.argmax('probs')} AS pred FROM scored UNION ALL "
          f"SELECT 'strong', label_true, {X.argmax('probs')} FROM scored_strong")
PC_SQL = """SELECT task, cls, sum(tp) AS tp, sum(support) AS support, sum(npred) AS npred FROM (
  SELECT task, truth AS cls, CAST(truth = pred AS INTEGER) AS tp, 1 AS support, 0 AS npred FROM tt
  UNION ALL SELECT task, pred, 0, 0, 1 FROM tt) GROUP BY task, cls"""
PRF_SQL = """SELECT task, sum(tp) / sum(npred) AS micro_precision, sum(tp) / sum(support) AS micro_recall,
  2 * (sum(tp) / sum(npred)) * (sum(tp) / sum(support)) / (sum(tp) / sum(npred) + sum(tp) / sum(support)) AS micro_f1,
  avg(p) AS macro_precision, avg(r) AS macro_recall,
  avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS macro_f1
FROM (SELECT *, CASE WHEN npred > 0 THEN tp / npred ELSE 0 END AS p,
             CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM pc) GROUP BY task"""


@query("agg4_confusion_matrix", with_ctes("scored", extra=[("p", P_SQL)]) + """
SELECT truth, pred, CAST(count(*) AS BIGINT) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY truth), 6) AS share FROM p GROUP BY truth, pred""")
def q_agg4(spark, sf):
    return metrics.confusion_matrix(preds(spark, sf)).select("truth", "pred", "n", r6("share"))


@query("agg5_accuracy", with_ctes("scored", extra=[("p", P_SQL)]) + """
SELECT batch_id, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY batch_id""")
def q_agg5(spark, sf):
    return metrics.accuracy(preds(spark, sf), by=["batch_id"]).select("batch_id", r6("accuracy"))


@query("agg6_balanced_accuracy", with_ctes("scored", "scored_strong", extra=[("tt", TT_SQL), ("pc", PC_SQL)]) + """
SELECT task, round(avg(tp / support), 6) AS balanced_accuracy FROM pc WHERE support > 0 GROUP BY task""")
def q_agg6(spark, sf):
    return metrics.balanced_accuracy(two_task_preds(spark, sf), by=["task"]).select("task", r6("balanced_accuracy"))


PRF_COLS = ["micro_precision", "micro_recall", "micro_f1", "macro_precision", "macro_recall", "macro_f1"]


@query("agg7_precision_recall_f1", with_ctes("scored", "scored_strong", extra=[("tt", TT_SQL), ("pc", PC_SQL)])
       + "SELECT task, " + ", ".join(f"round({c}, 6) AS {c}" for c in PRF_COLS) + f" FROM ({PRF_SQL})")
def q_agg7(spark, sf):
    out = metrics.precision_recall_f1(two_task_preds(spark, sf), by=["task"])
    return out.select("task", *[r6(c) for c in PRF_COLS])


@query("agg8_eval_loss", with_ctes("scored") + f"""
SELECT batch_id, round(avg({X.ce_hard('logits', 'lab')}), 6) AS loss FROM (
  SELECT batch_id, logits, CASE WHEN row_id % 7 = 0 THEN -1 ELSE label_true END AS lab FROM scored)
WHERE lab >= 0 GROUP BY batch_id""")
def q_agg8(spark, sf):
    s = fx.scored(spark, sf).withColumn(
        "lab", F.when(F.col("row_id") % 7 == 0, F.lit(-1)).otherwise(F.col("label_true")))
    return metrics.eval_loss(s, "logits", "lab", by=["batch_id"]).select("batch_id", r6("loss"))


@query("agg9_evaluate_multitask", with_ctes("scored", "scored_strong", extra=[("tt", TT_SQL), ("pc", PC_SQL)]) + f"""
SELECT a.task, round(a.accuracy, 6) AS accuracy, round(b.balanced_accuracy, 6) AS balanced_accuracy,
       {", ".join(f"round(c.{c}, 6) AS {c}" for c in PRF_COLS)}
FROM (SELECT task, avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM tt GROUP BY task) a
JOIN (SELECT task, avg(tp / support) AS balanced_accuracy FROM pc WHERE support > 0 GROUP BY task) b ON a.task = b.task
JOIN ({PRF_SQL}) c ON a.task = c.task""")
def q_agg9(spark, sf):
    out = metrics.evaluate_multitask(two_task_preds(spark, sf))
    return out.select("task", r6("accuracy"), r6("balanced_accuracy"), *[r6(c) for c in PRF_COLS])


@query("job6_evaluate_run", with_ctes("scored", extra=[("p", P_SQL)]) + """
SELECT truth_name, pred_name, mismatch, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT ['c0','c1','c2','c3','c4','c5','c6','c7','c8','c9'][truth + 1] AS truth_name,
         ['c0','c1','c2','c3','c4','c5','c6','c7','c8','c9'][pred + 1] AS pred_name,
         truth IS DISTINCT FROM pred AS mismatch FROM p) GROUP BY ALL""")
def q_job6(spark, sf):
    """JOB6 with its sinks: the rows, decoded and flagged, as written."""
    run = corpus_jobs.evaluate_run(preds(spark, sf), [f"c{i}" for i in range(fx.K_SCORED)], sink=scratch(spark, "run"))
    return run.predictions.groupBy("truth_name", "pred_name", "mismatch").agg(F.count(F.lit(1)).alias("n"))


@query("job6_evaluate_run_summary", with_ctes("scored", extra=[("p", P_SQL)]) + """
SELECT round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       (SELECT round(avg(r), 6) FROM (SELECT avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END) AS r FROM p GROUP BY truth)) AS balanced_accuracy
FROM p""")
def q_job6_summary(spark, sf):
    run = corpus_jobs.evaluate_run(preds(spark, sf), [f"c{i}" for i in range(fx.K_SCORED)], sink=scratch(spark, "run"))
    return run.summary.select(r6("accuracy"), r6("balanced_accuracy"))


@query("win14_best_so_far", with_ctes("rounds") + """
SELECT round_no, round(acc, 6) AS acc, round(best, 6) AS best, improved, since_best, since_best > 3 AS stop FROM (
  SELECT *, greatest(coalesce(prev_best, acc), acc) AS best,
         CAST(round_no_rn - max(CASE WHEN improved THEN round_no_rn END) OVER (ORDER BY round_no
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS since_best FROM (
    SELECT *, prev_best IS NULL OR acc > prev_best AS improved FROM (
      SELECT *, max(acc) OVER (ORDER BY round_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best,
             row_number() OVER (ORDER BY round_no) AS round_no_rn FROM rounds)))""")
def q_win14(spark, sf):
    # the evaluation series has one row per day: a tiny, bounded table
    out = metrics.best_so_far(fx.rounds(spark, sf), "acc", "round_no", patience=3)
    return out.select("round_no", r6("acc"), r6("best"), "improved", "since_best", "stop")


@query("win15_pick_best_round", with_ctes("rounds") + """
SELECT round_no, round(acc, 6) AS acc FROM rounds ORDER BY acc DESC, round_no LIMIT 1""")
def q_win15(spark, sf):
    b = metrics.pick_best_round(fx.rounds(spark, sf), "acc", "round_no")
    return b.select("round_no", r6("acc"))
