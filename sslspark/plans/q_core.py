"""Core queries: the flagship OOD slice, TOP1, THR1-3 and the FN* building
blocks, each checked through a grouped query over the ``scored`` fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sslspark.constants import UNLABELLED
from sslspark.functions import arrays as A
from sslspark.operators import aggs, policies
from sslspark.operators.encode import role_of
from sslspark.plans import fixtures as fx
from sslspark.plans import sql_expr as X
from sslspark.plans.catalog import query, r6
from sslspark.plans.sql_fixtures import with_ctes

K = fx.K_SCORED


def long_avg(df: DataFrame, keys: list[str], arr, out: str = "v") -> DataFrame:
    """Mean of an array column per (keys, class_id), long form."""
    return (df.select(*keys, F.posexplode(arr).alias("class_id", "_v"))
            .groupBy(*keys, F.col("class_id").cast("int").alias("class_id"))
            .agg(r6(F.avg("_v"), out)))


def sql_long_avg(src: str, keys: list[str], arr: str, out: str = "v") -> str:
    k = ", ".join(keys)
    return (f"SELECT {k}, class_id, round(avg(v), 6) AS {out} FROM "
            f"(SELECT {k}, {X.long_of(arr)} FROM {src}) GROUP BY {k}, class_id")


def two_views(spark: SparkSession, sf: str) -> DataFrame:
    """scored (weak view) with the strong-view logits of the same row."""
    w = fx.scored(spark, sf)
    s = fx.scored(spark, sf, strong=True).select("row_id", F.col("logits").alias("logits_s"),
                                                 F.col("probs").alias("probs_s"))
    return w.join(s, "row_id")


TWO_VIEWS_SQL = ("SELECT w.*, s.logits AS logits_s, s.probs AS probs_s FROM scored w "
                 "JOIN scored_strong s ON w.row_id = s.row_id")


# --- flagship: which unlabelled rows are OOD; class report before / after ---------------------

def ood_report(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.scored(spark, sf)
    after = policies.ood_by_confidence(s, "probs", "label_id", 0.9, out="label_after")
    long = after.select(F.explode(F.array(
        F.struct(F.lit("before").alias("task"), F.col("label_id").alias("label_id")),
        F.struct(F.lit("after").alias("task"), F.col("label_after").alias("label_id")))).alias("x")).select("x.*")
    vocab = spark.range(K).select(F.col("id").cast("string").alias("label"), F.col("id").cast("int").alias("label_id"))
    vocab = vocab.select(F.explode(F.array(F.lit("before"), F.lit("after"))).alias("task"), "label", "label_id")
    return aggs.label_report(long, vocab).withColumnRenamed("task", "stage")


OOD_REPORT_SQL = with_ctes("scored", extra=[
    ("lab", "SELECT label_id AS before, CASE WHEN label_id = -200 AND list_max(probs) < 0.9 THEN -100 "
            "ELSE label_id END AS after FROM scored"),
    ("lng", "SELECT 'before' AS stage, before AS label_id FROM lab UNION ALL SELECT 'after', after FROM lab"),
    ("voc", "SELECT s.stage, CAST(r.c AS VARCHAR) AS label, r.c AS label_id FROM range(0, 10) r(c), "
            "(VALUES ('before'), ('after')) s(stage)"),
]) + """
SELECT v.stage, v.label, CAST(count(l.label_id) AS BIGINT) AS n FROM voc v
  LEFT JOIN lng l ON l.stage = v.stage AND l.label_id = v.label_id GROUP BY v.stage, v.label
UNION ALL SELECT stage, 'ood', CAST(count(*) FILTER (WHERE label_id = -100) AS BIGINT) FROM lng GROUP BY stage
UNION ALL SELECT stage, 'total-lb', CAST(count(*) FILTER (WHERE label_id >= 0) AS BIGINT) FROM lng GROUP BY stage
UNION ALL SELECT stage, 'total-ulb', CAST(count(*) FILTER (WHERE label_id = -200) AS BIGINT) FROM lng GROUP BY stage
"""
query("thr1_ood_report", OOD_REPORT_SQL)(ood_report)


@query("thr1_ood_by_confidence", with_ctes("scored") + """
SELECT row_id, CAST(CASE WHEN label_id = -200 AND list_max(probs) < 0.9 THEN -100 ELSE label_id END AS INTEGER)
         AS label_id, round(list_max(probs), 6) AS conf FROM scored""")
def q_thr1(spark, sf):
    s = policies.ood_by_confidence(fx.scored(spark, sf), tau=0.9)
    return s.select("row_id", "label_id", r6(A.confidence("probs"), "conf"))


@query("top1_argmax_confidence", with_ctes("scored") + f"""
SELECT row_id, {X.argmax('probs')} AS pl, round({X.conf('probs')}, 6) AS conf FROM scored""")
def q_top1(spark, sf):
    s = policies.with_conf(fx.scored(spark, sf))
    return s.select("row_id", "pl", r6("conf"))


@query("thr2_pseudo_label_hard", with_ctes("scored") + f"""
SELECT batch_id, {X.argmax('probs')} AS pseudo, CAST(count(*) AS BIGINT) AS n FROM scored
WHERE role = 'unlabelled' GROUP BY ALL""")
def q_thr2_hard(spark, sf):
    s = policies.pseudo_label(fx.scored(spark, sf).filter("role = 'unlabelled'"), mode="hard")
    return s.groupBy("batch_id", "pseudo").agg(F.count(F.lit(1)).alias("n"))


@query("thr2_pseudo_label_soft", with_ctes("scored") + sql_long_avg(
    f"(SELECT batch_id, {X.sharpen('probs', 0.5)} AS q FROM scored WHERE role = 'unlabelled')",
    ["batch_id"], "q", "p_mean"))
def q_thr2_soft(spark, sf):
    s = policies.pseudo_label(fx.scored(spark, sf).filter("role = 'unlabelled'"), mode="soft", T=0.5)
    return long_avg(s, ["batch_id"], "pseudo", "p_mean")


@query("thr2_pseudo_label_smoothed", with_ctes("scored") + sql_long_avg(
    f"(SELECT batch_id, {X.smooth_label(X.argmax('probs'), K, 0.1)} AS q FROM scored WHERE role = 'unlabelled')",
    ["batch_id"], "q", "p_mean"))
def q_thr2_smooth(spark, sf):
    s = policies.pseudo_label(fx.scored(spark, sf).filter("role = 'unlabelled'"), mode="hard", K=K, smoothing=0.1)
    return long_avg(s, ["batch_id"], "pseudo", "p_mean")


@query("thr3_fixed_threshold", with_ctes("scored") + """
SELECT batch_id, CAST(sum(CASE WHEN list_max(probs) >= 0.95 THEN 1 ELSE 0 END) AS BIGINT) AS n_masked,
       round(avg(CASE WHEN list_max(probs) >= 0.95 THEN 1.0 ELSE 0.0 END), 6) AS util_ratio
FROM scored WHERE role = 'unlabelled' GROUP BY batch_id""")
def q_thr3(spark, sf):
    s = policies.fixed_threshold(fx.scored(spark, sf).filter("role = 'unlabelled'"), tau=0.95)
    return s.groupBy("batch_id").agg(F.sum(F.col("mask").cast("long")).alias("n_masked"),
                                     r6(F.avg("mask"), "util_ratio"))


@query("agg13_util_ratio", with_ctes("scored") + """
SELECT batch_id, round(avg(CASE WHEN list_max(probs) >= 0.7 THEN 1.0 ELSE 0.0 END), 6) AS util_ratio
FROM scored WHERE role = 'unlabelled' GROUP BY batch_id""")
def q_agg13(spark, sf):
    s = policies.fixed_threshold(fx.scored(spark, sf).filter("role = 'unlabelled'"), tau=0.7)
    return aggs.util_ratio(s).select("batch_id", r6("util_ratio"))


@query("prj8_assign_role", with_ctes("scored") + """
SELECT CASE WHEN lab >= 0 THEN 'labelled' WHEN lab = -100 THEN 'ood' WHEN lab = -200 THEN 'unlabelled' END AS role,
       CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN label_id = -200 AND list_max(probs) < 0.9 THEN -100 ELSE label_id END AS lab FROM scored)
GROUP BY 1""")
def q_prj8(spark, sf):
    s = policies.ood_by_confidence(fx.scored(spark, sf))
    return s.groupBy(role_of("label_id").alias("role")).agg(F.count(F.lit(1)).alias("n"))


# --- FN* building blocks ------------------------------------------------------------------------

@query("fn1_softmax_temperature", with_ctes("scored") + sql_long_avg(
    f"(SELECT batch_id, {X.softmax('logits', 2.0)} AS q FROM scored)", ["batch_id"], "q", "p_mean"))
def q_fn1(spark, sf):
    return long_avg(fx.scored(spark, sf), ["batch_id"], A.softmax("logits", 2.0), "p_mean")


@query("fn2_log_softmax", with_ctes("scored") + sql_long_avg(
    f"(SELECT batch_id, {X.log_softmax('logits')} AS q FROM scored)", ["batch_id"], "q", "logp_mean"))
def q_fn2(spark, sf):
    return long_avg(fx.scored(spark, sf), ["batch_id"], A.log_softmax("logits"), "logp_mean")


@query("fn3_sharpen", with_ctes("scored") + sql_long_avg(
    f"(SELECT batch_id, {X.sharpen('probs', 0.5)} AS q FROM scored)", ["batch_id"], "q", "p_mean"))
def q_fn3(spark, sf):
    return long_avg(fx.scored(spark, sf), ["batch_id"], A.sharpen("probs", 0.5), "p_mean")


@query("fn4_average_views", with_ctes("scored", "scored_strong", extra=[("tv", TWO_VIEWS_SQL)]) + sql_long_avg(
    f"(SELECT batch_id, {X.zip_with('probs', 'probs_s', '({x} + {y}) / 2.0')} AS q FROM tv)",
    ["batch_id"], "q", "p_mean"))
def q_fn4(spark, sf):
    return long_avg(two_views(spark, sf), ["batch_id"], A.average_views("probs", "probs_s"), "p_mean")


@query("fn5_smooth_label_ce", with_ctes("scored") + f"""
SELECT batch_id, round(avg({X.ce_soft('logits', X.smooth_label('label_id', K, 0.1))}), 6) AS loss
FROM scored WHERE role = 'labelled' GROUP BY batch_id""")
def q_fn5(spark, sf):
    s = fx.scored(spark, sf).filter("role = 'labelled'")
    return s.groupBy("batch_id").agg(
        r6(F.avg(A.cross_entropy_soft("logits", A.smooth_label("label_id", K, 0.1))), "loss"))


@query("fn9_cross_entropy", with_ctes("scored") + f"""
SELECT batch_id, label_true, round(avg({X.ce_hard('logits', 'label_true')}), 6) AS loss,
       CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY batch_id, label_true""")
def q_fn9(spark, sf):
    s = fx.scored(spark, sf)
    return s.groupBy("batch_id", "label_true").agg(
        r6(F.avg(A.cross_entropy_hard("logits", "label_true")), "loss"), F.count(F.lit(1)).alias("n"))


@query("fn10_consistency_ce_masked", with_ctes("scored", "scored_strong", extra=[("tv", TWO_VIEWS_SQL)]) + f"""
SELECT batch_id, round(avg({X.ce_hard('logits_s', X.argmax('probs'))}
       * CASE WHEN list_max(probs) >= 0.6 THEN 1.0 ELSE 0.0 END), 6) AS unsup_loss
FROM tv WHERE role = 'unlabelled' GROUP BY batch_id""")
def q_fn10(spark, sf):
    s = two_views(spark, sf).filter("role = 'unlabelled'")
    mask = (A.confidence("probs") >= 0.6).cast("double")
    return s.groupBy("batch_id").agg(
        r6(F.avg(A.consistency_loss("logits_s", A.argmax("probs"), "ce", mask)), "unsup_loss"))


@query("fn10_consistency_mse", with_ctes("scored", "scored_strong", extra=[("tv", TWO_VIEWS_SQL)]) + f"""
SELECT batch_id, round(avg(list_sum({X.zip_with(X.softmax('logits_s'), 'probs', '({x} - {y}) * ({x} - {y})')})
       / len(probs)), 6) AS unsup_loss FROM tv GROUP BY batch_id""")
def q_fn10_mse(spark, sf):
    s = two_views(spark, sf)
    return s.groupBy("batch_id").agg(r6(F.avg(A.consistency_loss("logits_s", "probs", "mse")), "unsup_loss"))


@query("fn11_entropy", with_ctes("scored") + f"""
SELECT batch_id, round(avg({X.entropy('probs')}), 6) AS entropy FROM scored GROUP BY batch_id""")
def q_fn11(spark, sf):
    return fx.scored(spark, sf).groupBy("batch_id").agg(r6(F.avg(A.entropy("probs")), "entropy"))


@query("fn12_kl_divergence", with_ctes("scored", "scored_strong", extra=[("tv", TWO_VIEWS_SQL)]) + f"""
SELECT batch_id, round(avg(list_sum({X.zip_with(X.softmax('logits'),
    X.zip_with(X.log_softmax('logits'), X.log_softmax('logits_s'), '{x} - {y}'), '{x} * {y}')})), 6) AS kl
FROM tv GROUP BY batch_id""")
def q_fn12(spark, sf):
    return two_views(spark, sf).groupBy("batch_id").agg(r6(F.avg(A.kl_from_logits("logits", "logits_s")), "kl"))


@query("fn13_tempered_kl", with_ctes("scored", "scored_strong", extra=[("tv", TWO_VIEWS_SQL)]) + f"""
SELECT batch_id, round(avg(-{X.dot(X.softmax('logits', 2.0), X.log_softmax('logits_s', 1.0))}
       * CASE WHEN list_max(probs) >= 0.6 THEN 1.0 ELSE 0.0 END), 6) AS loss FROM tv GROUP BY batch_id""")
def q_fn13(spark, sf):
    s = two_views(spark, sf)
    mask = (A.confidence("probs") >= 0.6).cast("double")
    return s.groupBy("batch_id").agg(r6(F.avg(A.tempered_kl("logits_s", "logits", 1.0, mask)), "loss"))


@query("fn14_cosine_to_prototype", with_ctes("emb", "protos") + f"""
SELECT e.label, round(avg({X.cosine('e.emb', 'p.proto')}), 6) AS mean_cos,
       round(avg({X.norm(X.transform('e.emb', '{x} / greatest(' + X.norm('e.emb').replace('{', '{{').replace('}', '}}') + ', 1e-12)'))}), 6) AS mean_norm
FROM emb e JOIN protos p ON e.label = p.label GROUP BY e.label""")
def q_fn14(spark, sf):
    from sslspark.operators.aggs import class_prototypes, prototype_map
    e = fx.embeddings(spark, sf)
    e = e.withColumn("_P", prototype_map(class_prototypes(e, "label", "emb")))
    return e.groupBy("label").agg(
        r6(F.avg(A.cosine("emb", F.element_at(F.col("_P"), F.col("label")))), "mean_cos"),
        r6(F.avg(A.l2_norm(A.l2_normalise("emb"))), "mean_norm"))


@query("fn20_mtl_weighted_loss", with_ctes("scored", "scored_strong", extra=[("tv", TWO_VIEWS_SQL)]) + f"""
SELECT batch_id, round(avg(1.0 * {X.ce_hard('logits', 'label_true')} + 0.5 * {X.ce_hard('logits_s', 'label_true % 5')}), 6)
       AS loss FROM tv GROUP BY batch_id""")
def q_fn20(spark, sf):
    s = two_views(spark, sf)
    task = A.cross_entropy_hard("logits", "label_true")
    rel = A.cross_entropy_hard("logits_s", F.col("label_true") % 5)
    return s.groupBy("batch_id").agg(r6(F.avg(A.mtl_weighted_loss(task, rel)), "loss"))


@query("prj14_one_hot", with_ctes("scored") + sql_long_avg(
    f"(SELECT batch_id, {X.one_hot('label_true', K)} AS q FROM scored)", ["batch_id"], "q", "share"))
def q_prj14(spark, sf):
    return long_avg(fx.scored(spark, sf), ["batch_id"], A.one_hot("label_true", K), "share")
