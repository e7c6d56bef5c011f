"""Batch-ordered state queries: AGG10-12, WIN9-10, WIN12, THR4-9, THR11, THR15, THR17.

The oracles compute each EMA in closed form (a self-join summing
m^(t-s) weights) — an independent formula from the chunked scan in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sslspark.functions import arrays as A
from sslspark.operators import adaptive, aggs, state
from sslspark.plans import fixtures as fx
from sslspark.plans import sql_expr as X
from sslspark.plans.catalog import query, r6
from sslspark.plans.q_core import long_avg, sql_long_avg
from sslspark.plans.sql_fixtures import with_ctes

K = fx.K_SCORED


def ulb(spark, sf) -> DataFrame:
    return fx.scored(spark, sf).filter("role = 'unlabelled'")


ULB_SQL = "SELECT * FROM scored WHERE role = 'unlabelled'"
MEANP_SQL = ("SELECT batch_id, class_id, avg(v) AS x FROM (SELECT batch_id, " + X.long_of("probs")
             + " FROM ulb) GROUP BY batch_id, class_id")


def sql_ema(src: str, keys: list[str], m: float, init: float | None) -> str:
    """(keys, batch_id, v) for v_t = m v_{t-1} + (1-m) x_t over ``src(keys, batch_id, x)``."""
    on = " AND ".join([f"b.{k} = a.{k}" for k in keys] + ["b.batch_id <= a.batch_id"])
    ks = ", ".join(f"a.{k}" for k in keys)
    if init is None:
        body = (f"sum(pow({m}, a.batch_id - b.batch_id) * CASE WHEN b.batch_id = 0 THEN b.x "
                f"ELSE {1 - m} * b.x END)")
    else:
        body = f"pow({m}, a.batch_id + 1) * {init} + sum(pow({m}, a.batch_id - b.batch_id) * {1 - m} * b.x)"
    return f"SELECT {ks}, a.batch_id, {body} AS v FROM {src} a JOIN {src} b ON {on} GROUP BY {ks}, a.batch_id"


@query("agg10_mean_probs_by_batch", with_ctes("scored", extra=[("ulb", ULB_SQL), ("mp", MEANP_SQL)]) + """
SELECT batch_id, class_id, round(x, 6) AS mean_p FROM mp""")
def q_agg10(spark, sf):
    return aggs.mean_probs_by_batch(ulb(spark, sf), out="mean_p").select("batch_id", "class_id", r6("mean_p"))


@query("agg11_conf_stats", with_ctes("scored") + f"""
SELECT -1 AS class_id, CAST(count(*) AS BIGINT) AS n, round(avg(c), 6) AS mean, round(var_samp(c), 6) AS var,
       round(quantile_cont(c, 0.8), 6) AS quantile FROM (SELECT list_max(probs) AS c FROM scored)
UNION ALL
SELECT class_id, CAST(count(*) AS BIGINT), round(avg(c), 6), round(var_samp(c), 6), round(quantile_cont(c, 0.8), 6)
FROM (SELECT {X.argmax('probs')} AS class_id, list_max(probs) AS c FROM scored) GROUP BY class_id""")
def q_agg11(spark, sf):
    s = fx.scored(spark, sf).withColumns({"conf": A.confidence("probs"), "class_id": A.argmax("probs")})
    overall = aggs.conf_stats(s).withColumn("class_id", F.lit(-1))
    per = aggs.conf_stats(s, by=["class_id"])
    cols = ["class_id", "n", r6("mean"), r6("var"), r6("quantile")]
    return overall.select(*cols).unionByName(per.select(*cols))


@query("agg12_pseudo_label_histogram", with_ctes("scored", extra=[("ulb", ULB_SQL)]) + f"""
SELECT g.batch_id, CAST(c.class_id AS INTEGER) AS class_id, CAST(count(u.pl) AS BIGINT) AS n,
       round(count(u.pl) / (SELECT count(*) FROM ulb x WHERE x.batch_id = g.batch_id), 6) AS share
FROM (SELECT DISTINCT batch_id FROM ulb) g CROSS JOIN range(0, {K}) c(class_id)
LEFT JOIN (SELECT batch_id, {X.argmax('probs')} AS pl FROM ulb) u ON u.batch_id = g.batch_id AND u.pl = c.class_id
GROUP BY g.batch_id, c.class_id""")
def q_agg12(spark, sf):
    h = aggs.pseudo_label_histogram(ulb(spark, sf).withColumn("pl", A.argmax("probs")), "pl", K, by=["batch_id"])
    return h.select("batch_id", "class_id", "n", r6("share"))


@query("win9_queue_mean", with_ctes("scored", extra=[("ulb", ULB_SQL), ("mp", MEANP_SQL)]) + """
SELECT batch_id, class_id, round(sum(x) OVER (PARTITION BY class_id ORDER BY batch_id
       ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) / 4.0, 6) AS queue_mean FROM mp""")
def q_win9(spark, sf):
    st = aggs.mean_probs_by_batch(ulb(spark, sf), out="x")
    q = state.queue_mean(st, ["class_id"], "batch_id", "x", 4, "queue_mean", chunk=4)
    return q.select("batch_id", "class_id", r6("queue_mean"))


@query("win10_ema_over_batches", with_ctes("scored", extra=[("ulb", ULB_SQL), ("mp", MEANP_SQL),
                                                            ("e1", sql_ema("mp", ["class_id"], 0.7, None)),
                                                            ("e2", sql_ema("mp", ["class_id"], 0.3, 0.1))]) + """
SELECT e1.batch_id, e1.class_id, round(e1.v, 6) AS ema_first, round(e2.v, 6) AS ema_init
FROM e1 JOIN e2 ON e1.batch_id = e2.batch_id AND e1.class_id = e2.class_id""")
def q_win10(spark, sf):
    st = aggs.mean_probs_by_batch(ulb(spark, sf), out="x")
    e = state.ema(st, ["class_id"], "batch_id", "x", 0.7, None, "ema_first")
    # m = 0.3 gives chunks of 34 steps: at sf0.1 (40 batches) the carry path runs
    e = state.ema(e, ["class_id"], "batch_id", "x", 0.3, 0.1, "ema_init")
    return e.select("batch_id", "class_id", r6("ema_first"), r6("ema_init"))


def _align_q(spark, sf, **kw) -> DataFrame:
    a = adaptive.align_distribution(ulb(spark, sf), K=K, **kw)
    return long_avg(a, ["batch_id"], "probs_aligned", "p_mean")


def _align_sql(model_vec_cte: str, target_expr: str, extra: list) -> str:
    return with_ctes("scored", extra=[("ulb", ULB_SQL), ("mp", MEANP_SQL), *extra, (
        "al", f"SELECT u.batch_id, {X.normalise_sum(X.zip_with(X.zip_with('u.probs', target_expr, '{x} * ({y} + 1e-6)'), 'pm.vec', '{x} / ({y} + 1e-6)'))} AS q "
              f"FROM ulb u JOIN {model_vec_cte} pm ON pm.batch_id = u.batch_id")]) + sql_long_avg("al", ["batch_id"], "q", "p_mean")


UNIFORM = "[" + ", ".join(["0.1"] * K) + "]"
GT = [0.05, 0.05, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.15, 0.15]


@query("thr11_align_ema_uniform", _align_sql("pmv", UNIFORM, [
    ("e", sql_ema("mp", ["class_id"], 0.9, None)),
    ("pmv", "SELECT batch_id, list(v ORDER BY class_id) AS vec FROM e GROUP BY batch_id")]))
def q_thr11_ema(spark, sf):
    return _align_q(spark, sf, mode="ema", target="uniform", m=0.9)


@query("thr11_align_queue_gt", _align_sql("pmv", "[" + ", ".join(map(str, GT)) + "]", [
    ("q", "SELECT batch_id, class_id, sum(x) OVER (PARTITION BY class_id ORDER BY batch_id "
          "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / 3.0 AS v FROM mp"),
    ("pmv", "SELECT batch_id, list(v ORDER BY class_id) AS vec FROM q GROUP BY batch_id")]))
def q_thr11_queue(spark, sf):
    return _align_q(spark, sf, mode="queue", target="gt", L=3, p_target=GT)


@query("thr11_align_model_target", with_ctes("scored", extra=[
    ("ulb", ULB_SQL), ("mp", MEANP_SQL),
    ("lb", "SELECT * FROM scored WHERE role = 'labelled'"),
    ("lmp", "SELECT batch_id, class_id, avg(v) AS x FROM (SELECT batch_id, " + X.long_of("probs") + " FROM lb) "
            "GROUP BY batch_id, class_id"),
    ("e", sql_ema("mp", ["class_id"], 0.9, None)), ("et", sql_ema("lmp", ["class_id"], 0.9, 0.1)),
    ("pmv", "SELECT e.batch_id, list(e.v ORDER BY e.class_id) AS vec, list(et.v ORDER BY et.class_id) AS tvec "
            "FROM e JOIN et ON e.batch_id = et.batch_id AND e.class_id = et.class_id GROUP BY e.batch_id"),
    ("al", f"SELECT u.batch_id, {X.normalise_sum(X.zip_with(X.zip_with('u.probs', 'pm.tvec', '{x} * ({y} + 1e-6)'), 'pm.vec', '{x} / ({y} + 1e-6)'))} AS q "
           "FROM ulb u JOIN pmv pm ON pm.batch_id = u.batch_id")]) + sql_long_avg("al", ["batch_id"], "q", "p_mean"))
def q_thr11_model(spark, sf):
    lb = fx.scored(spark, sf).filter("role = 'labelled'")
    return _align_q(spark, sf, mode="ema", target="model", m=0.9, lb=lb)


# --- FlexMatch -------------------------------------------------------------------------------

def two_epochs(spark, sf) -> DataFrame:
    """Unlabelled rows seen twice (two epochs) with the second epoch's
    strong-view probabilities, so ids get re-selected with new labels."""
    u1 = ulb(spark, sf).select("row_id", "batch_id", "probs")
    nb = fx.scored(spark, sf).agg(F.max("batch_id") + 1).scalar()
    u2 = (fx.scored(spark, sf, strong=True).filter("role = 'unlabelled'")
          .select("row_id", (F.col("batch_id") + nb).alias("batch_id"), "probs"))
    return u1.unionByName(u2)


TWO_EPOCHS_SQL = ("SELECT row_id, batch_id, probs FROM scored WHERE role = 'unlabelled' UNION ALL "
                  "SELECT row_id, batch_id + (SELECT max(batch_id) + 1 FROM scored), probs FROM scored_strong "
                  "WHERE role = 'unlabelled'")


def _flex_sql(tau: float, warmup: bool) -> str:
    denom = "greatest(maxc, n - sel)" if warmup else "maxc"
    return with_ctes("scored", "scored_strong", extra=[
        ("d", f"SELECT row_id, batch_id, list_max(probs) AS conf, {X.argmax('probs')} AS pl FROM ({TWO_EPOCHS_SQL})"),
        ("nn", "SELECT count(DISTINCT row_id) AS n FROM d"),
        ("sel", f"SELECT row_id, batch_id, pl FROM d WHERE conf >= {tau}"),
        ("grid", "SELECT DISTINCT batch_id AS t FROM d"),
        ("latest", "SELECT g.t, s.row_id, arg_max(s.pl, s.batch_id) AS pl FROM grid g JOIN sel s ON s.batch_id <= g.t "
                   "GROUP BY g.t, s.row_id"),
        ("cnt", f"SELECT g.t, c.class_id, count(l.row_id) AS cnt FROM grid g CROSS JOIN range(0, {K}) c(class_id) "
                "LEFT JOIN latest l ON l.t = g.t AND l.pl = c.class_id GROUP BY g.t, c.class_id"),
        ("st", "SELECT t, class_id, cnt, sum(cnt) OVER (PARTITION BY t) AS sel, max(cnt) OVER (PARTITION BY t) AS maxc, "
               "(SELECT n FROM nn) AS n FROM cnt"),
        ("acc", f"SELECT t, class_id, CASE WHEN greatest(maxc, n - sel) < n THEN cnt / {denom} END AS acc_new FROM st"),
        ("accf", "SELECT t, class_id, coalesce(last_value(acc_new IGNORE NULLS) OVER (PARTITION BY class_id ORDER BY t "
                 "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS acc FROM acc"),
    ]) + f"""
SELECT d.row_id, d.batch_id, round(coalesce(a.acc, 0.0), 6) AS classwise_acc,
       CAST(d.conf >= {tau} * coalesce(a.acc, 0.0) / (2.0 - coalesce(a.acc, 0.0)) AS INTEGER) AS mask
FROM d LEFT JOIN accf a ON a.t = d.batch_id - 1 AND a.class_id = d.pl"""


@query("thr4_flexmatch_warmup", _flex_sql(0.7, True))
def q_thr4(spark, sf):
    m = adaptive.flexmatch_mask(two_epochs(spark, sf), K=K, tau=0.7, warmup=True)
    return m.select("row_id", "batch_id", r6("classwise_acc"), F.col("mask").cast("int").alias("mask"))


@query("thr4_flexmatch_no_warmup", _flex_sql(0.7, False))
def q_thr4b(spark, sf):
    m = adaptive.flexmatch_mask(two_epochs(spark, sf), K=K, tau=0.7, warmup=False)
    return m.select("row_id", "batch_id", r6("classwise_acc"), F.col("mask").cast("int").alias("mask"))


# --- FreeMatch / SoftMatch / AdaMatch / Dash / ADSH / DebiasPL -----------------------------------

FREE_EXTRA = [
    ("ulb", ULB_SQL), ("mp", MEANP_SQL),
    ("d", f"SELECT row_id, batch_id, probs, list_max(probs) AS conf, {X.argmax('probs')} AS pl FROM ulb"),
    ("bs", "SELECT 0 AS k, batch_id, avg(conf) AS x FROM d GROUP BY batch_id"),
    ("tp", sql_ema("bs", ["k"], 0.9, 0.1)),
    ("pm", sql_ema("mp", ["class_id"], 0.9, 0.1)),
    ("hx", f"SELECT g.batch_id, c.class_id, count(d.pl) / (SELECT count(*) FROM d z WHERE z.batch_id = g.batch_id) AS x "
           f"FROM (SELECT DISTINCT batch_id FROM d) g CROSS JOIN range(0, {K}) c(class_id) "
           "LEFT JOIN d ON d.batch_id = g.batch_id AND d.pl = c.class_id GROUP BY g.batch_id, c.class_id"),
    ("lh", sql_ema("hx", ["class_id"], 0.9, 0.1)),
    ("stv", "SELECT pm.batch_id, list(pm.v ORDER BY pm.class_id) AS p_model, list(lh.v ORDER BY lh.class_id) AS label_hist "
            "FROM pm JOIN lh ON pm.batch_id = lh.batch_id AND pm.class_id = lh.class_id GROUP BY pm.batch_id"),
    ("fm", "SELECT d.*, s.p_model, s.label_hist, tp.v AS time_p, "
           "CAST(d.conf >= tp.v * s.p_model[d.pl + 1] / list_max(s.p_model) AS DOUBLE) AS mask "
           "FROM d JOIN stv s ON s.batch_id = d.batch_id JOIN tp ON tp.batch_id = d.batch_id"),
]
FREE_SQL = with_ctes("scored", extra=FREE_EXTRA)


@query("thr5_freematch_mask", FREE_SQL + """
SELECT batch_id, round(any_value(time_p), 6) AS time_p, round(avg(mask), 6) AS util_ratio,
       round(max(list_max(p_model)), 6) AS p_model_max, round(max(list_max(label_hist)), 6) AS label_hist_max
FROM fm GROUP BY batch_id""")
def q_thr5(spark, sf):
    m = adaptive.freematch_mask(ulb(spark, sf), K=K, m=0.9)
    return m.groupBy("batch_id").agg(
        r6(F.first("time_p"), "time_p"), r6(F.avg("mask"), "util_ratio"),
        r6(F.max(F.array_max("p_model")), "p_model_max"), r6(F.max(F.array_max("label_hist")), "label_hist_max"))


@query("win10_clamped_ema", with_ctes("scored", extra=[
    ("ulb", ULB_SQL), ("mp", MEANP_SQL),
    ("e", "SELECT CAST(c AS INTEGER) AS class_id, CAST(-1 AS BIGINT) AS batch_id, CAST(0.1 AS DOUBLE) AS v FROM range(0, 10) t(c) UNION ALL "
          "SELECT e.class_id, m.batch_id, least(greatest(0.5 * e.v + 0.5 * m.x, 0.09), 0.11) FROM e JOIN mp m ON m.batch_id = e.batch_id + 1 AND m.class_id = e.class_id"),
], recursive=True) + "SELECT class_id, batch_id, round(v, 6) AS v FROM e WHERE batch_id >= 0")
def q_win10_clamped(spark, sf):
    mp = aggs.mean_probs_by_batch(ulb(spark, sf), out="x").withColumn("b", 0.5 * F.col("x"))
    return state.clamped_scan(mp, ["class_id"], "batch_id", "b", 0.5, 0.09, 0.11, 0.1, chunk=3).select("class_id", "batch_id", r6("v"))


@query("thr5_freematch_quantile_clip", with_ctes("scored", extra=[
    *[(n, b) for n, b in FREE_EXTRA if n in ("ulb", "mp", "d", "pm")],
    ("bs", "SELECT batch_id, quantile_cont(conf, 0.8) AS x FROM d GROUP BY batch_id"),
    ("tp", "SELECT CAST(-1 AS BIGINT) AS batch_id, CAST(0.1 AS DOUBLE) AS v UNION ALL "
           "SELECT bs.batch_id, least(greatest(0.2 * tp.v + 0.8 * bs.x, 0.0), 0.95) FROM tp JOIN bs ON bs.batch_id = tp.batch_id + 1"),
    ("pm2", sql_ema("mp", ["class_id"], 0.2, 0.1)),
    ("pv", "SELECT batch_id, list(v ORDER BY class_id) AS p FROM pm2 GROUP BY batch_id")], recursive=True) + """
SELECT d.batch_id, round(any_value(tp.v), 6) AS time_p, CAST(sum(CASE WHEN d.conf >= tp.v * pv.p[d.pl + 1] / list_max(pv.p) THEN 1 ELSE 0 END) AS BIGINT) AS n_masked
FROM d JOIN tp ON tp.batch_id = d.batch_id JOIN pv ON pv.batch_id = d.batch_id GROUP BY d.batch_id""")
def q_thr5_quantile_clip(spark, sf):
    m = adaptive.freematch_mask(ulb(spark, sf), K=K, m=0.2, use_quantile=True, clip=True)
    return m.groupBy("batch_id").agg(r6(F.first("time_p"), "time_p"), F.sum(F.col("mask").cast("long")).alias("n_masked"))


@query("thr17_fairness_entropy", with_ctes("scored", "scored_strong", extra=FREE_EXTRA)[:-1] + f""",
fs AS (SELECT fm.*, s.probs AS probs_s FROM fm JOIN scored_strong s ON s.row_id = fm.row_id WHERE fm.mask > 0),
hs AS (SELECT g.batch_id, c.class_id, count(x.pls) AS cnt, any_value(g.n) AS n FROM
        (SELECT batch_id, count(*) AS n FROM fs GROUP BY batch_id) g CROSS JOIN range(0, {K}) c(class_id)
        LEFT JOIN (SELECT batch_id, {X.argmax('probs_s')} AS pls FROM fs) x ON x.batch_id = g.batch_id AND x.pls = c.class_id
        GROUP BY g.batch_id, c.class_id),
ms AS (SELECT batch_id, class_id, avg(v) AS mp FROM (SELECT batch_id, {X.long_of('probs_s')} FROM fs) GROUP BY ALL),
sv AS (SELECT batch_id, class_id, pm, lh FROM (SELECT DISTINCT batch_id, p_model, label_hist FROM fs),
        LATERAL (SELECT unnest(p_model) AS pm, unnest(label_hist) AS lh, CAST(unnest(range(0, {K})) AS BIGINT) AS class_id)),
j AS (SELECT sv.batch_id, sv.class_id, sv.pm * CASE WHEN sv.lh = 0 THEN 0 ELSE 1.0 / sv.lh END AS mm,
             ms.mp * CASE WHEN hs.cnt = 0 THEN 0 ELSE 1.0 / (hs.cnt / hs.n) END AS mms
      FROM sv JOIN ms ON ms.batch_id = sv.batch_id AND ms.class_id = sv.class_id
      JOIN hs ON hs.batch_id = sv.batch_id AND hs.class_id = sv.class_id)
SELECT batch_id, round(sum(mm / smm * ln(mms / smms + 1e-12)), 6) AS ent_loss FROM (
  SELECT *, sum(mm) OVER (PARTITION BY batch_id) AS smm, sum(mms) OVER (PARTITION BY batch_id) AS smms FROM j)
GROUP BY batch_id""")
def q_thr17(spark, sf):
    m = adaptive.freematch_mask(ulb(spark, sf), K=K, m=0.9)
    s = fx.scored(spark, sf, strong=True).select("row_id", F.col("probs").alias("probs_s"))
    e = adaptive.fairness_entropy(m.join(s, "row_id"), K=K)
    return e.select("batch_id", r6("ent_loss"))


def _soft_sql(per_class: bool) -> str:
    if not per_class:
        extra = [
            ("d", f"SELECT row_id, batch_id, list_max(probs) AS conf, {X.argmax('probs')} AS pl FROM ulb"),
            ("bs", "SELECT 0 AS k, batch_id, avg(conf) AS mu0, var_samp(conf) AS v0 FROM d GROUP BY batch_id"),
            ("bm", "SELECT k, batch_id, mu0 AS x FROM bs"), ("bv", "SELECT k, batch_id, v0 AS x FROM bs"),
            ("emu", sql_ema("bm", ["k"], 0.9, 0.1)), ("evr", sql_ema("bv", ["k"], 0.9, 1.0)),
            ("w", "SELECT d.row_id, d.batch_id, exp(-(pow(least(d.conf - emu.v, 0.0), 2)) / (2 * evr.v / 4.0)) AS w "
                  "FROM d JOIN emu ON emu.batch_id = d.batch_id JOIN evr ON evr.batch_id = d.batch_id"),
        ]
    else:
        extra = [
            ("d", f"SELECT row_id, batch_id, list_max(probs) AS conf, {X.argmax('probs')} AS pl FROM ulb"),
            ("g", f"SELECT b.batch_id, c.class_id FROM (SELECT DISTINCT batch_id FROM d) b CROSS JOIN range(0, {K}) c(class_id)"),
            ("bs", "SELECT g.class_id, g.batch_id, CASE WHEN count(d.conf) > 1 THEN avg(d.conf) ELSE 0.0 END AS mu0, "
                   "CASE WHEN count(d.conf) > 1 THEN var_samp(d.conf) ELSE 1.0 END AS v0 FROM g LEFT JOIN d "
                   "ON d.batch_id = g.batch_id AND d.pl = g.class_id GROUP BY g.class_id, g.batch_id"),
            ("bm", "SELECT class_id, batch_id, mu0 AS x FROM bs"), ("bv", "SELECT class_id, batch_id, v0 AS x FROM bs"),
            ("emu", sql_ema("bm", ["class_id"], 0.9, 0.1)), ("evr", sql_ema("bv", ["class_id"], 0.9, 1.0)),
            ("w", "SELECT d.row_id, d.batch_id, exp(-(pow(least(d.conf - emu.v, 0.0), 2)) / (2 * evr.v / 4.0)) AS w "
                  "FROM d JOIN emu ON emu.batch_id = d.batch_id AND emu.class_id = d.pl "
                  "JOIN evr ON evr.batch_id = d.batch_id AND evr.class_id = d.pl"),
        ]
    return with_ctes("scored", extra=[("ulb", ULB_SQL), *extra]) + """
SELECT batch_id, round(avg(w), 6) AS mean_weight, round(min(w), 6) AS min_weight FROM w GROUP BY batch_id"""


@query("thr6_softmatch_weight", _soft_sql(False))
def q_thr6(spark, sf):
    m = adaptive.softmatch_weight(ulb(spark, sf), K=K, m=0.9, n_sigma=2.0)
    return m.groupBy("batch_id").agg(r6(F.avg("mask"), "mean_weight"), r6(F.min("mask"), "min_weight"))


@query("thr6_softmatch_weight_per_class", _soft_sql(True))
def q_thr6b(spark, sf):
    m = adaptive.softmatch_weight(ulb(spark, sf), K=K, m=0.9, n_sigma=2.0, per_class=True)
    return m.groupBy("batch_id").agg(r6(F.avg("mask"), "mean_weight"), r6(F.min("mask"), "min_weight"))


@query("thr7_adamatch_relative_threshold", with_ctes("scored") + """
SELECT u.batch_id, round(any_value(c.cutoff), 6) AS cutoff,
       CAST(sum(CASE WHEN list_max(u.probs) >= c.cutoff THEN 1 ELSE 0 END) AS BIGINT) AS n_masked
FROM scored u JOIN (SELECT batch_id, 0.95 * avg(list_max(probs)) AS cutoff FROM scored WHERE role = 'labelled'
  GROUP BY batch_id) c ON c.batch_id = u.batch_id WHERE u.role = 'unlabelled' GROUP BY u.batch_id""")
def q_thr7(spark, sf):
    s = fx.scored(spark, sf)
    m = adaptive.adamatch_mask(s.filter("role = 'unlabelled'"), s.filter("role = 'labelled'"), tau=0.95)
    return m.groupBy("batch_id").agg(r6(F.first("cutoff"), "cutoff"), F.sum(F.col("mask").cast("long")).alias("n_masked"))


@query("thr8_dash_loss_threshold", with_ctes("scored", extra=[
    ("r0", f"SELECT avg({X.ce_hard('logits', 'label_id')}) AS rho0 FROM scored WHERE role = 'labelled'"),
    ("d", f"""SELECT batch_id, greatest(1.0001 * pow(1.27, -floor(batch_id / 2)) * (SELECT rho0 FROM r0), 0.6) AS rho,
      {X.ce_hard('logits', X.argmax('logits'))} AS ce_h,
      {X.ce_soft('logits', X.softmax('logits', 0.5))} AS ce_s FROM scored WHERE role = 'unlabelled'"""),
    ("l", "SELECT batch_id, rho, CASE WHEN rho = 0.6 THEN ce_h ELSE ce_s END AS loss FROM d")]) + """
SELECT batch_id, round(any_value(rho), 6) AS rho, CAST(sum(CASE WHEN loss <= rho THEN 1 ELSE 0 END) AS BIGINT) AS n_masked
FROM l GROUP BY batch_id""")
def q_thr8(spark, sf):
    s = fx.scored(spark, sf)
    rho0 = s.filter("role = 'labelled'").select(F.avg(A.cross_entropy_hard("logits", "label_id"))).scalar()
    m = adaptive.dash_mask(s.filter("role = 'unlabelled'"), rho0, T=0.5, rho_min=0.6, period=2)
    return m.groupBy("batch_id").agg(r6(F.first("rho"), "rho"), F.sum(F.col("mask").cast("long")).alias("n_masked"))


ADSH_SQL = with_ctes("scored", extra=[
    ("d", f"SELECT row_id, list_max(probs) AS conf, {X.argmax('probs')} AS pl FROM scored WHERE role = 'unlabelled'"),
    ("h", "SELECT count(*) AS n0, count(*) FILTER (WHERE conf >= 0.7) AS hi FROM d WHERE pl = 0"),
    ("rho", "SELECT CASE WHEN hi >= 1 THEN (hi - 1) / n0 ELSE 1.0 END AS rho FROM h"),
    ("rk", "SELECT *, row_number() OVER (PARTITION BY pl ORDER BY conf DESC, row_id) AS rn, "
           "count(*) OVER (PARTITION BY pl) AS n FROM d"),
    ("th", "SELECT pl, any_value(conf) AS threshold FROM rk WHERE rn = CASE WHEN floor(n * (SELECT rho FROM rho)) = 0 "
           "THEN n ELSE floor(n * (SELECT rho FROM rho)) END GROUP BY pl"),
    ("thk", f"SELECT CAST(c AS INTEGER) AS class_id, coalesce(th.threshold, exp(-0.7)) AS threshold "
            f"FROM range(0, {K}) r(c) LEFT JOIN th ON th.pl = r.c"),
])


@query("win12_adsh_thresholds", ADSH_SQL + "SELECT class_id, round(threshold, 6) AS threshold FROM thk")
def q_win12(spark, sf):
    t = adaptive.adsh_thresholds(ulb(spark, sf), K=K, tau=0.7)
    return t.select("class_id", r6("threshold"))


@query("thr9_adsh_mask", ADSH_SQL + """
SELECT d.pl AS class_id, CAST(sum(CASE WHEN d.conf >= t.threshold THEN 1 ELSE 0 END) AS BIGINT) AS n_masked,
       CAST(count(*) AS BIGINT) AS n FROM d JOIN thk t ON t.class_id = d.pl GROUP BY d.pl""")
def q_thr9(spark, sf):
    u = ulb(spark, sf)
    m = adaptive.adsh_mask(u, adaptive.adsh_thresholds(u, K=K, tau=0.7))
    return m.groupBy(A.argmax("probs").alias("class_id")).agg(
        F.sum(F.col("mask").cast("long")).alias("n_masked"), F.count(F.lit(1)).alias("n"))


@query("thr15_debiased_probs", with_ctes("scored", extra=[
    ("ulb", ULB_SQL), ("mp", MEANP_SQL), ("ph", sql_ema("mp", ["class_id"], 0.9, 0.1)),
    ("phv", "SELECT batch_id, list(v ORDER BY class_id) AS p_hat FROM ph GROUP BY batch_id"),
    ("db", "SELECT u.batch_id, " + X.softmax(X.zip_with("u.logits", "p.p_hat", "{x} - 0.4 * ln({y})"))
           + " AS q FROM ulb u JOIN phv p ON p.batch_id = u.batch_id")]) + sql_long_avg("db", ["batch_id"], "q", "p_mean"))
def q_thr15(spark, sf):
    d = adaptive.debiased_probs(ulb(spark, sf), K=K, tau=0.4, m=0.9)
    return long_avg(d, ["batch_id"], "probs_debiased", "p_mean")


@query("udf1_policy_registry", with_ctes("scored") + f"""
SELECT 'fixmatch' AS policy, batch_id, CAST(sum(CASE WHEN list_max(probs) >= 0.7 THEN 1 ELSE 0 END) AS BIGINT) AS n_masked
FROM scored WHERE role = 'unlabelled' GROUP BY batch_id
UNION ALL
SELECT 'pseudolabel', batch_id, CAST(sum(CASE WHEN list_max(probs) >= 0.6 THEN 1 ELSE 0 END) AS BIGINT)
FROM scored WHERE role = 'unlabelled' GROUP BY batch_id""")
def q_udf1(spark, sf):
    from sslspark.operators.registry import apply_policy
    u = ulb(spark, sf)
    a = apply_policy(u, "fixmatch", p_cutoff=0.7).groupBy("batch_id").agg(
        F.lit("fixmatch").alias("policy"), F.sum(F.col("mask").cast("long")).alias("n_masked"))
    b = apply_policy(u, "pseudolabel", p_cutoff=0.6).groupBy("batch_id").agg(
        F.lit("pseudolabel").alias("policy"), F.sum(F.col("mask").cast("long")).alias("n_masked"))
    return a.unionByName(b).select("policy", "batch_id", "n_masked")


@query("thr10_tsa_mask", with_ctes("scored") + """
SELECT batch_id, CAST(sum(CASE WHEN list_max(probs) <= 0.5 * (1 - 1.0 / 10) + 1.0 / 10 THEN 1 ELSE 0 END) AS BIGINT)
       AS n_kept, CAST(count(*) AS BIGINT) AS n FROM scored WHERE role = 'labelled' GROUP BY batch_id""")
def q_thr10(spark, sf):
    from sslspark.operators.policies import tsa_mask
    lb = fx.scored(spark, sf).filter("role = 'labelled'")
    m = tsa_mask(lb, "probs", "label_id", "linear", 0.5, K)
    return m.groupBy("batch_id").agg(F.sum(F.col("tsa_mask").cast("long")).alias("n_kept"), F.count(F.lit(1)).alias("n"))


@query("fn17_fn18_fn19_schedules", with_ctes("scored") + """
SELECT batch_id, round(exp((batch_id / 9.0 - 1) * 5) * 0.9 + 0.1, 6) AS tsa_exp,
       round((1 - exp(-(batch_id / 9.0) * 5)) * 0.9 + 0.1, 6) AS tsa_log,
       round(least(greatest(batch_id / 4.0, 0.0), 1.0), 6) AS ramp,
       round(greatest(1.0001 * pow(1.27, -batch_id) * 2.0, 0.05), 6) AS rho
FROM (SELECT DISTINCT batch_id FROM scored)""")
def q_fn17(spark, sf):
    b = fx.scored(spark, sf).select("batch_id").distinct()
    prog = F.col("batch_id") / F.lit(9.0)
    return b.select("batch_id", r6(A.tsa_threshold("exp", prog, K), "tsa_exp"), r6(A.tsa_threshold("log", prog, K), "tsa_log"),
                    r6(A.ramp(F.col("batch_id"), 4), "ramp"), r6(A.dash_rho(1.0001, 1.27, F.col("batch_id"), 2.0, 0.05), "rho"))
