"""Text-model jobs on the documents corpus (JOB4, JOB5, JOB7-9): rows-only
checks (the fitted model is numeric, not SQL-reproducible)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sslspark.operators import encode, metrics
from sslspark.plans import fixtures as fx
from sslspark.plans import jobs
from sslspark.plans.catalog import query, r6

LANGS = ["de", "en", "es", "fr"]


def lang_corpus(spark, sf) -> DataFrame:
    c = fx.corpus(spark, sf).withColumn("lang_id", encode.encode_label("lang", LANGS))
    return c.withColumn("role", F.when(F.col("doc_id") % 5 == 0, F.lit("labelled"))
                        .when(F.col("doc_id") % 5 == 1, F.lit("eval")).otherwise(F.lit("unlabelled")))


@query("job4_fit_baseline")
def q_job4(spark, sf):
    c = lang_corpus(spark, sf)
    model = jobs.fit_baseline(c.filter("role = 'labelled'"), "text", "lang_id", max_iter=30)
    ev = jobs.score(model, c.filter("role = 'eval'"), ["doc_id", "lang_id"])
    p = ev.select(F.lit("lang").alias("task"), F.col("lang_id").alias("truth"), F.col("pl").alias("pred"))
    out = metrics.evaluate_multitask(p)
    return out.select("task", r6("accuracy"), r6("macro_f1"), r6("micro_f1"))


@query("job5_score")
def q_job5(spark, sf):
    c = lang_corpus(spark, sf)
    model = jobs.fit_baseline(c.filter("role = 'labelled'"), "text", "lang_id", max_iter=30)
    sc = jobs.score(model, c, ["doc_id"])
    return sc.select("doc_id", "pl", encode.decode_label("pl", LANGS).alias("pred_lang"), r6("conf"))


@query("job7_self_train")
def q_job7(spark, sf):
    c = lang_corpus(spark, sf)
    rep = jobs.self_train(c.filter("role = 'labelled'"), c.filter("role = 'unlabelled'"), c.filter("role = 'eval'"),
                          "doc_id", "text", "lang_id", rounds=6, tau=0.9, max_iter=30)
    return rep.select("round_no", r6("accuracy"), "n_pseudo", "improved", "since_best")


@query("job8_generational_self_train")
def q_job8(spark, sf):
    c = lang_corpus(spark, sf)
    return jobs.generational_self_train(c.filter("role = 'labelled'"), c.filter("role = 'unlabelled'"),
                                        c.filter("role = 'eval'"), "doc_id", "text", "lang_id", K=4,
                                        generations=6, max_iter=30).select("generation", r6("accuracy"), r6("t"), "n_picked")


@query("job9_multitask_self_train")
def q_job9(spark, sf):
    c = lang_corpus(spark, sf).withColumn("quality_id", F.coalesce(F.col("quality"), F.lit(-200)).cast("int"))
    lb = c.filter("role = 'labelled'").withColumn("task", F.col("quality_id"))
    ulb = c.filter("role = 'unlabelled'").withColumn("task", F.lit(-200))
    ev = c.filter("role = 'eval' AND quality IS NOT NULL").withColumn("task", F.col("quality_id"))
    out = jobs.multitask_self_train(lb, ulb, ev, "doc_id", "text", "task", "lang_id", max_iter=30)
    return out.select("round_no", *[r6(x) for x in out.columns[1:-1]], "n_pseudo")
