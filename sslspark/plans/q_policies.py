"""Every registered policy applied to the scored fixture, against DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from sslspark.operators.registry import apply_policy, compose
from sslspark.plans import fixtures as fx
from sslspark.plans import sql_expr as X
from sslspark.plans.catalog import query, r6
from sslspark.plans.q_core import TWO_VIEWS_SQL, two_views
from sslspark.plans.q_similarity import SCORED_EMB, feats
from sslspark.plans.q_state import MEANP_SQL, ULB_SQL, sql_ema
from sslspark.plans.sql_fixtures import with_ctes

K = 10


def _split(spark, sf):
    s = fx.scored(spark, sf)
    return s.filter("role = 'unlabelled'"), s.filter("role = 'labelled'")


def _masked(df, mask: str = "mask"):
    return df.groupBy("batch_id").agg(F.sum(F.col(mask).cast("long")).alias("n_masked"))


@query("policy_dash", with_ctes("scored", extra=[
    ("r0", f"SELECT avg({X.ce_hard('logits', 'label_id')}) AS rho0 FROM scored WHERE role = 'labelled'"),
    ("d", f"""SELECT batch_id, greatest(1.0001 * pow(1.27, -batch_id) * (SELECT rho0 FROM r0), 0.05) AS rho,
      {X.ce_hard('logits', X.argmax('logits'))} AS ce_h, {X.ce_soft('logits', X.softmax('logits', 0.5))} AS ce_s,
      {X.argmax('probs')} AS pl FROM scored WHERE role = 'unlabelled'""")]) + """
SELECT batch_id, CAST(sum(CASE WHEN CASE WHEN rho = 0.05 THEN ce_h ELSE ce_s END <= rho THEN 1 ELSE 0 END) AS BIGINT) AS n_masked
FROM d GROUP BY batch_id""")
def q_dash(spark, sf):
    u, lb = _split(spark, sf)
    return _masked(apply_policy(u, "dash", lb))


@query("policy_adamatch", with_ctes("scored", extra=[
    ("ulb", ULB_SQL), ("mp", MEANP_SQL), ("lb", "SELECT * FROM scored WHERE role = 'labelled'"),
    ("lmp", "SELECT batch_id, class_id, avg(v) AS x FROM (SELECT batch_id, " + X.long_of("probs") + " FROM lb) GROUP BY batch_id, class_id"),
    ("e", sql_ema("mp", ["class_id"], 0.999, None)), ("et", sql_ema("lmp", ["class_id"], 0.999, 0.1)),
    ("pmv", "SELECT e.batch_id, list(e.v ORDER BY e.class_id) AS vec, list(et.v ORDER BY et.class_id) AS tvec "
            "FROM e JOIN et ON e.batch_id = et.batch_id AND e.class_id = et.class_id GROUP BY e.batch_id"),
    ("al", f"SELECT u.batch_id, {X.normalise_sum(X.zip_with(X.zip_with('u.probs', 'pm.tvec', '{x} * ({y} + 1e-6)'), 'pm.vec', '{x} / ({y} + 1e-6)'))} AS q "
           "FROM ulb u JOIN pmv pm ON pm.batch_id = u.batch_id"),
    ("c", "SELECT batch_id, 0.95 * avg(list_max(probs)) AS cutoff FROM lb GROUP BY batch_id")]) + """
SELECT al.batch_id, CAST(sum(CASE WHEN list_max(q) >= cutoff THEN 1 ELSE 0 END) AS BIGINT) AS n_masked
FROM al JOIN c ON c.batch_id = al.batch_id GROUP BY al.batch_id""")
def q_adamatch(spark, sf):
    u, lb = _split(spark, sf)
    return _masked(apply_policy(u, "adamatch", lb))


@query("policy_two_views", with_ctes("scored", "scored_strong", extra=[("tv", TWO_VIEWS_SQL)]) + f"""
SELECT batch_id, round(avg(least(batch_id / 4.0, 1.0) * list_sum({X.zip_with(X.softmax('logits_s'), 'probs', '({x} - {y}) * ({x} - {y})')})
       / len(probs)), 6) AS unsup_loss FROM tv WHERE role = 'unlabelled' GROUP BY batch_id""")
def q_two_views(spark, sf):
    d = apply_policy(two_views(spark, sf).filter("role = 'unlabelled'"), "pimodel", ramp_len=4.0)
    return d.groupBy("batch_id").agg(r6(F.avg(F.col("unsup_loss") * F.col("unsup_weight")), "unsup_loss"))


@query("policy_vat", with_ctes("scored", "scored_strong", extra=[("tv", TWO_VIEWS_SQL)]) + f"""
SELECT batch_id, round(avg(list_sum({X.zip_with(X.softmax('logits'),
    X.zip_with(X.log_softmax('logits'), X.log_softmax('logits_s'), '{x} - {y}'), '{x} * {y}')})), 6) AS kl,
    round(avg(0.06 * {X.entropy('probs')}), 6) AS ent FROM tv WHERE role = 'unlabelled' GROUP BY batch_id""")
def q_vat(spark, sf):
    d = apply_policy(two_views(spark, sf).filter("role = 'unlabelled'"), "vat")
    return d.groupBy("batch_id").agg(r6(F.avg("unsup_loss"), "kl"), r6(F.avg("ent_loss"), "ent"))


@query("policy_mixmatch", with_ctes("scored", "scored_strong", extra=[("tv", TWO_VIEWS_SQL), (
    "m", "SELECT batch_id, " + X.zip_with("probs", "probs_s", "({x} + {y}) / 2") + " AS p FROM tv WHERE role = 'unlabelled'"),
    ("q", "SELECT batch_id, " + X.sharpen("p", 0.5) + " AS q FROM m")]) + """
SELECT batch_id, round(avg(list_max(q)), 6) AS mean_top FROM q GROUP BY batch_id""")
def q_mixmatch(spark, sf):
    d = apply_policy(two_views(spark, sf).filter("role = 'unlabelled'"), "mixmatch")
    return d.groupBy("batch_id").agg(r6(F.avg(F.array_max("pseudo")), "mean_top"))


@query("policy_crmatch", with_ctes("scored", "scored_strong", extra=[("tv", TWO_VIEWS_SQL), (
    "m", f"""SELECT batch_id, CASE WHEN list_max(probs) >= 0.6 THEN 1.0 ELSE 0.0 END AS k, {X.ce_hard('logits_s', X.argmax('probs'))} AS ce,
    greatest({X.cosine('logits_s', 'logits')}, 0.0) AS rep FROM tv WHERE role = 'unlabelled'""")]) + """
SELECT batch_id, round(avg(ce * k), 6) AS unsup_loss, round(avg(rep * k), 6) AS repulsion_loss FROM m GROUP BY batch_id""")
def q_crmatch(spark, sf):
    # the tables have no descriptor head; the views' logits stand for its outputs
    tv = two_views(spark, sf).filter("role = 'unlabelled'").withColumns({"ds": F.col("logits"), "ds_s": F.col("logits_s")})
    d = apply_policy(tv, "crmatch", p_cutoff=0.6)
    return d.groupBy("batch_id").agg(r6(F.avg("unsup_loss"), "unsup_loss"), r6(F.avg("repulsion_loss"), "repulsion_loss"))


@query("policy_defixmatch", with_ctes("scored") + """
SELECT batch_id, CAST(sum(CASE WHEN list_max(probs) >= 0.6 THEN CASE WHEN role = 'labelled' THEN -1 ELSE 1 END ELSE 0 END) AS BIGINT) AS net
FROM scored GROUP BY batch_id""")
def q_defixmatch(spark, sf):
    u, lb = _split(spark, sf)
    d = apply_policy(u, "defixmatch", lb, p_cutoff=0.6)
    return d.groupBy("batch_id").agg(F.sum(F.col("mask") * F.col("weight")).cast("long").alias("net"))


@query("policy_fullysupervised", with_ctes("scored") + f"""
SELECT batch_id, round(avg({X.ce_hard('logits', 'label_id')}), 6) AS loss FROM scored WHERE role = 'labelled' GROUP BY batch_id""")
def q_fully(spark, sf):
    _, lb = _split(spark, sf)
    return apply_policy(lb, "fullysupervised").groupBy("batch_id").agg(r6(F.avg("sup_loss"), "loss"))


@query("policy_mtl_fixmatch", with_ctes("scored") + f"""
SELECT batch_id, {X.argmax('probs')} AS pl, CAST(count(*) AS BIGINT) AS n FROM scored WHERE label_id = -200 AND list_max(probs) >= 0.6 GROUP BY ALL""")
def q_mtl_fixmatch(spark, sf):
    d = apply_policy(fx.scored(spark, sf), "mtl_fixmatch", p_cutoff=0.6).filter("mask > 0")
    from sslspark.functions.arrays import argmax
    return d.groupBy("batch_id", argmax("probs").alias("pl")).agg(F.count(F.lit(1)).alias("n"))


@query("policy_abc_over_fixmatch", with_ctes("imbalanced", extra=[(
    "k", "SELECT label_true, min(n) OVER () / n AS keep_p FROM (SELECT r.c AS label_true, greatest(count(i.row_id), 1) AS n FROM range(0, 10) r(c) "
         "LEFT JOIN imbalanced i ON i.label_true = r.c AND i.role = 'labelled' GROUP BY r.c)")]) + f"""
SELECT i.batch_id, CAST(sum(CASE WHEN list_max(i.probs) >= 0.6
         AND CAST(('0x' || substr(md5(concat_ws(':', i.row_id, 13)), 1, 8)) AS UBIGINT) / 4294967296.0 < k.keep_p THEN 1 ELSE 0 END) AS BIGINT) AS n_abc,
       CAST(sum(CASE WHEN list_max(i.probs) >= 0.7 THEN 1 ELSE 0 END) AS BIGINT) AS n_base
FROM imbalanced i JOIN k ON k.label_true = {X.argmax('i.probs')} WHERE i.role = 'unlabelled' GROUP BY i.batch_id""")
def q_abc(spark, sf):
    s = fx.imbalanced(spark, sf)
    f = compose("abc", "fixmatch", {"p_cutoff": 0.6}, {"p_cutoff": 0.7}, labelled=s.filter("role = 'labelled'"))
    d = f(s.filter("role = 'unlabelled'"))
    return d.groupBy("batch_id").agg(F.sum(F.col("mask_abc").cast("long")).alias("n_abc"), F.sum(F.col("mask").cast("long")).alias("n_base"))


@query("policy_saw_weights", with_ctes("imbalanced", extra=[
    ("c", f"SELECT CAST(r.c AS INTEGER) AS pl, greatest(count(u.pl), 1) AS n FROM range(0, 10) r(c) "
          f"LEFT JOIN (SELECT {X.argmax('probs')} AS pl FROM imbalanced WHERE role = 'unlabelled') u ON u.pl = r.c GROUP BY r.c"),
    ("w", "SELECT pl, n, (1 - beta) / (1 - pow(beta, n)) AS w0 FROM (SELECT pl, n, (avg(n) OVER () - 1) / avg(n) OVER () AS beta FROM c)"),
    ("wn", "SELECT pl, w0 / sum(w0) OVER () * count(*) OVER () AS weight FROM w")]) + f"""
SELECT i.batch_id, round(sum(wn.weight), 4) AS total FROM imbalanced i JOIN wn ON wn.pl = {X.argmax('i.probs')}
WHERE i.role = 'unlabelled' GROUP BY i.batch_id""")
def q_saw(spark, sf):
    u = fx.imbalanced(spark, sf).filter("role = 'unlabelled'")
    d = compose("saw", "fixmatch")(u)
    return d.groupBy("batch_id").agg(F.round(F.sum("weight"), 4).alias("total"))


@query("policy_comatch", with_ctes("scored", "emb", extra=[
    ("sf", SCORED_EMB), ("ulb", "SELECT * FROM sf WHERE role = 'unlabelled'"), ("mp", MEANP_SQL),
    ("qm", "SELECT batch_id, class_id, sum(x) OVER (PARTITION BY class_id ORDER BY batch_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) / 4.0 AS v FROM mp"),
    ("pv", "SELECT batch_id, list(v ORDER BY class_id) AS vec FROM qm GROUP BY batch_id"),
    ("al", f"SELECT u.row_id, u.batch_id, u.feat, {X.normalise_sum(X.zip_with('u.probs', 'pv.vec', '{x} * (0.1 + 1e-6) / ({y} + 1e-6)'))} AS p "
           "FROM ulb u JOIN pv ON pv.batch_id = u.batch_id"),
    ("rows_", f"SELECT row_id, batch_id, feat, p AS bp FROM al UNION ALL SELECT row_id, batch_id, feat, {X.one_hot('label_id', K)} FROM sf WHERE role = 'labelled'"),
    ("rk", "SELECT *, row_number() OVER (ORDER BY batch_id, row_id) AS rk FROM rows_"),
    ("up", "SELECT t.batch_id, coalesce((SELECT max(rk) FROM rk WHERE rk.batch_id < t.batch_id), 0) AS last FROM (SELECT DISTINCT batch_id FROM al) t"),
    ("bk", "SELECT up.batch_id, list({'f': rk.feat, 'p': rk.bp} ORDER BY rk.rk DESC) AS bank FROM up JOIN rk ON rk.rk <= up.last AND rk.rk > up.last - 40 GROUP BY up.batch_id"),
    ("aw", "SELECT al.*, " + X.softmax(X.transform("bk.bank", "list_dot_product(al.feat, {x}.f) / 0.2")) + " AS a, bk.bank FROM al LEFT JOIN bk ON bk.batch_id = al.batch_id"),
    ("sm", "SELECT batch_id, CASE WHEN bank IS NULL THEN p ELSE list_transform(range(0, 10), lambda c: 0.9 * p[c + 1] + 0.1 * "
           "list_sum(list_transform(list_zip(a, bank), lambda z: z[1] * z[2].p[c + 1]))) END AS q FROM aw")]) + """
SELECT batch_id, CAST(sum(CASE WHEN list_max(q) >= 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS n_masked, round(avg(list_max(q)), 6) AS conf FROM sm GROUP BY batch_id""")
def q_comatch(spark, sf):
    f = feats(spark, sf)
    d = apply_policy(f.filter("role = 'unlabelled'"), "comatch", f.filter("role = 'labelled'"), p_cutoff=0.6, da_len=4, queue_rows=40)
    return d.groupBy("batch_id").agg(F.sum(F.col("mask").cast("long")).alias("n_masked"), r6(F.avg(F.array_max("probs")), "conf"))
