"""Imbalance queries on the long-tailed fixture (AGG16-18, WIN8, WIN13, FN7-8,
FN23, THR13, THR16, TOP2-3)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sslspark.functions import arrays as A
from sslspark.operators import aggs, imbalance, policies, similarity
from sslspark.plans import fixtures as fx
from sslspark.plans import sql_expr as X
from sslspark.plans.catalog import query, r6
from sslspark.plans.q_core import long_avg, sql_long_avg
from sslspark.plans.sql_fixtures import _lst, with_ctes

K = fx.K_SCORED
LB_COUNTS_SQL = ("SELECT CAST(r.c AS INTEGER) AS label_true, count(i.row_id) AS n FROM range(0, 10) r(c) "
                 "LEFT JOIN imbalanced i ON i.label_true = r.c AND i.role = 'labelled' GROUP BY r.c")


def lb_counts(spark, sf) -> DataFrame:
    return aggs.class_counts(fx.imbalanced(spark, sf).filter("role = 'labelled'"), "label_true", K)


def _eff_sql(src: str) -> str:
    return f"""SELECT label_true, n, w / sum(w) OVER () * count(*) OVER () AS weight FROM (
  SELECT label_true, n, (1 - beta) / (1 - pow(beta, n)) AS w FROM (
    SELECT label_true, n, (avg(n) OVER () - 1) / avg(n) OVER () AS beta FROM {src}))"""


@query("agg16_effective_weights", with_ctes("imbalanced", extra=[
    ("c", "SELECT label_true, greatest(n, 1) AS n FROM (" + LB_COUNTS_SQL + ")")]) + f"""
SELECT label_true, CAST(n AS BIGINT) AS n, round(weight, 6) AS weight FROM ({_eff_sql('c')})""")
def q_agg16(spark, sf):
    c = lb_counts(spark, sf).withColumn("n", F.greatest("n", F.lit(1)))
    return aggs.effective_weights(c).select("label_true", F.col("n").cast("long").alias("n"), r6("weight"))


@query("agg17_refresh_weights_from_pseudo_labels", with_ctes("imbalanced", extra=[
    ("c", f"SELECT CAST(r.c AS INTEGER) AS label_true, greatest(count(u.pl), 1) AS n FROM range(0, 10) r(c) "
          f"LEFT JOIN (SELECT {X.argmax('probs')} AS pl FROM imbalanced WHERE role = 'unlabelled') u ON u.pl = r.c "
          "GROUP BY r.c")]) + f"""
SELECT label_true, CAST(n AS BIGINT) AS n, round(weight, 6) AS weight FROM ({_eff_sql('c')})""")
def q_agg17(spark, sf):
    u = fx.imbalanced(spark, sf).filter("role = 'unlabelled'").withColumn("pl", A.argmax("probs"))
    c = aggs.class_counts(u, "pl", K).withColumnRenamed("pl", "label_true")
    w = aggs.refresh_weights_from_pseudo_labels(c)
    return w.select("label_true", F.col("n").cast("long").alias("n"), r6("weight"))


@query("agg18_min_over_count", with_ctes("imbalanced") + """
SELECT label_true, round(min(n) OVER () / n, 6) AS keep_p FROM (
  SELECT label_true, count(*) AS n FROM imbalanced GROUP BY label_true)""")
def q_agg18(spark, sf):
    c = fx.imbalanced(spark, sf).groupBy("label_true").agg(F.count(F.lit(1)).alias("n"))
    return aggs.min_over_count(c).select("label_true", r6("keep_p"))


@query("top2_sort_classes_by_frequency", with_ctes("imbalanced") + """
SELECT CAST(label_true AS INTEGER) AS class_id, CAST(count(*) AS BIGINT) AS n,
       CAST(row_number() OVER (ORDER BY count(*) DESC, label_true) AS INTEGER) AS freq_rank
FROM imbalanced GROUP BY label_true""")
def q_top2(spark, sf):
    c = fx.imbalanced(spark, sf).groupBy(F.col("label_true").alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    # K rows: a single ordered window over the class counts is bounded by K
    return imbalance.sort_classes_by_frequency(c).withColumn(
        "freq_rank", F.row_number().over(Window.orderBy(F.desc("n"), "class_id")).cast("int"))


def _crest_rates(spark, sf) -> list[float]:
    # imbalance ratio of the labelled class counts: two numbers
    r = lb_counts(spark, sf).agg(F.max("n").alias("mx"), F.min(F.greatest("n", F.lit(1))).alias("mn")).first()
    return imbalance.crest_quota(K, r["mx"] / r["mn"], alpha=3.0)


@query("win8_top_confident_per_class", with_ctes("imbalanced", extra=[
    ("lc", LB_COUNTS_SQL), ("mu", "SELECT pow(min(greatest(n, 1)) / max(n), 1.0 / 9.0) AS mu FROM lc"),
    ("d", f"SELECT row_id, list_max(probs) AS conf, {X.argmax('probs')} AS pl FROM imbalanced WHERE role = 'unlabelled'"),
    ("rk", "SELECT *, row_number() OVER (PARTITION BY pl ORDER BY conf DESC, row_id) AS rn, "
           "count(*) OVER (PARTITION BY pl) AS n FROM d")]) + """
SELECT row_id, pl FROM rk WHERE rn <= floor(n * pow(pow((SELECT mu FROM mu), 9 - pl), 1.0 / 3.0))""")
def q_win8(spark, sf):
    u = fx.imbalanced(spark, sf).filter("role = 'unlabelled'")
    p = imbalance.top_confident_per_class(u, _crest_rates(spark, sf))
    return p.filter("picked").select("row_id", A.argmax("probs").alias("pl"))


DARP_Q_SQL = ("SELECT r.c AS class_id, CAST(count(s.label_id) AS DOUBLE) AS q FROM range(0, 10) r(c) "
              "LEFT JOIN scored s ON s.label_id = r.c AND s.role = 'labelled' GROUP BY r.c")


@query("win13_top_k_mass_per_class", with_ctes("scored", extra=[
    ("lng", f"SELECT row_id, {X.long_of('probs')} FROM scored WHERE role = 'unlabelled'"),
    ("rk", "SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY v DESC, row_id) AS rn FROM lng"),
    ("tq", DARP_Q_SQL),
    ("top", "SELECT class_id, sum(v) AS kp, count(*) AS n FROM rk JOIN tq USING (class_id) WHERE rn <= 2 * q GROUP BY class_id")]) + """
SELECT CAST(r.c AS INTEGER) AS class_id, CAST(coalesce(t.n, 0) AS BIGINT) AS n_flagged,
       round((tq.q + 1e-6) / (coalesce(t.kp, 0) + 1e-6), 6) AS weight
FROM range(0, 10) r(c) JOIN tq ON tq.class_id = r.c LEFT JOIN top t ON t.class_id = r.c""")
def q_win13(spark, sf):
    s = fx.scored(spark, sf)
    u = s.filter("role = 'unlabelled'")
    q = {r["label_id"]: float(r["n"]) for r in aggs.class_counts(s.filter("role = 'labelled'"), "label_id", K).collect()}  # K rows
    flags, w = imbalance.top_k_mass_per_class(u, [q[c] for c in range(K)], 2.0, K)
    n = flags.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_flagged"))
    return (w.join(n, "class_id", "left")
            .select("class_id", F.coalesce("n_flagged", F.lit(0)).cast("long").alias("n_flagged"), r6("weight")))


@query("fn7_progressive_target", with_ctes("imbalanced", extra=[("lc", LB_COUNTS_SQL)]) + """
SELECT label_true AS class_id, round(pow(n / tot, 0.5) / sum(pow(n / tot, 0.5)) OVER (), 6) AS target FROM (
  SELECT label_true, n, sum(n) OVER () AS tot FROM lc)""")
def q_fn7(spark, sf):
    c = lb_counts(spark, sf)
    dist = aggs.class_distribution(c).select(F.sort_array(F.collect_list(F.struct("label_true", "share"))).alias("d"))
    t = dist.select(A.progressive_target(F.transform("d", lambda s: s["share"]), 0.5).alias("t"))
    return t.select(F.posexplode("t").alias("class_id", "target")).select(
        F.col("class_id").cast("int").alias("class_id"), r6("target"))


def _prior_vec(spark, sf):
    c = lb_counts(spark, sf).withColumn("n", F.greatest("n", F.lit(1)))
    return aggs.class_distribution(c).select(
        F.transform(F.sort_array(F.collect_list(F.struct("label_true", "share"))), lambda s: s["share"])).scalar()


PRIOR_SQL = ("SELECT list(n / tot ORDER BY label_true) AS prior FROM (SELECT label_true, greatest(n, 1) AS n, "
             "sum(greatest(n, 1)) OVER () AS tot FROM lc)")


@query("fn8_logit_adjust", with_ctes("imbalanced", extra=[("lc", LB_COUNTS_SQL), ("pr", PRIOR_SQL)]) + f"""
SELECT batch_id, {X.argmax(X.zip_with('logits', '(SELECT prior FROM pr)', '{x} - 1.0 * ln({y})'))} AS pl_adj,
       CAST(count(*) AS BIGINT) AS n FROM imbalanced GROUP BY ALL""")
def q_fn8(spark, sf):
    s = fx.imbalanced(spark, sf).withColumn("_prior", _prior_vec(spark, sf))
    return s.groupBy("batch_id", A.argmax(A.logit_adjust("logits", "_prior", 1.0, -1)).alias("pl_adj")).agg(
        F.count(F.lit(1)).alias("n"))


@query("fn23_class_temper", with_ctes("imbalanced", extra=[("lc", LB_COUNTS_SQL), (
    "r", "SELECT list(min_n / n ORDER BY label_true) AS ratio FROM (SELECT label_true, greatest(n, 1) AS n, "
         "min(greatest(n, 1)) OVER () AS min_n FROM lc)"), (
    "la", "SELECT " + X.transform("ratio", "ln(pow({x}, 1.0) + 1e-12)") + " AS la FROM r")]) + f"""
SELECT CAST(generate_subscripts(la, 1) - 1 AS INTEGER) AS class_id, round(unnest(la), 6) AS la,
       round(unnest({X.transform(X.softmax(X.transform('la', '-{x}')), '2.0 * {x} + 2.0')}), 6) AS t_logit FROM la""")
def q_fn23(spark, sf):
    c = lb_counts(spark, sf).withColumn("n", F.greatest("n", F.lit(1)))
    ratio = aggs.min_over_count(c, "n", "r").select(
        F.transform(F.sort_array(F.collect_list(F.struct("label_true", "r"))), lambda s: s["r"]).alias("ratio"))
    la, tl = A.class_temper("ratio", 1.0, 2.0, 2.0)
    out = ratio.select(F.posexplode(F.arrays_zip(la.alias("la"), tl.alias("t_logit"))).alias("class_id", "z"))
    return out.select(F.col("class_id").cast("int").alias("class_id"), r6("z.la", "la"), r6("z.t_logit", "t_logit"))


@query("thr16_abc_mask", with_ctes("imbalanced", extra=[(
    "k", "SELECT label_true, min(count(*)) OVER () / count(*) AS keep_p FROM imbalanced WHERE role = 'labelled' "
         "GROUP BY label_true")]) + f"""
SELECT i.batch_id, CAST(sum(CASE WHEN list_max(i.probs) >= 0.6
         AND CAST(('0x' || substr(md5(concat_ws(':', i.row_id, 13)), 1, 8)) AS UBIGINT) / 4294967296.0 < k.keep_p
       THEN 1 ELSE 0 END) AS BIGINT) AS n_masked
FROM imbalanced i JOIN k ON k.label_true = {X.argmax('i.probs')} WHERE i.role = 'unlabelled' GROUP BY i.batch_id""")
def q_thr16(spark, sf):
    imb = fx.imbalanced(spark, sf)
    keep = aggs.min_over_count(imb.filter("role = 'labelled'").groupBy("label_true").agg(F.count(F.lit(1)).alias("n")))
    u = imb.filter("role = 'unlabelled'").withColumn("_pl", A.argmax("probs"))
    j = u.join(F.broadcast(keep.withColumnRenamed("label_true", "_pl")), "_pl")  # K-row side
    m = policies.abc_mask(j, "probs", "keep_p", "row_id", 13, tau=0.6)
    return m.groupBy("batch_id").agg(F.sum(F.col("mask").cast("long")).alias("n_masked"))


@query("thr13_blend_pseudo_label", with_ctes("imbalanced", "scored_strong", extra=[
    ("u", "SELECT * FROM imbalanced WHERE role = 'unlabelled'"),
    ("h", f"SELECT list(cnt ORDER BY c) AS dist FROM (SELECT r.c, count(x.pl) / (SELECT count(*) FROM u) AS cnt "
          f"FROM range(0, 10) r(c) LEFT JOIN (SELECT {X.argmax('probs')} AS pl FROM u) x ON x.pl = r.c GROUP BY r.c)"),
    ("sd", "SELECT " + X.sharpen("dist", 1.5) + " AS sd FROM h"),
    ("m", f"""SELECT u.row_id, u.batch_id, sd.sd[{X.argmax('u.probs')} + 1] / list_max(sd.sd) AS v, u.probs, s.probs AS p_sim
         FROM u JOIN scored_strong s ON s.row_id = u.row_id, sd"""),
    ("mx", "SELECT batch_id, " + X.zip_with("probs", "p_sim", "(1 - v) * {x} + v * {y}") + " AS q FROM m")]) + f"""
SELECT batch_id, {X.argmax('q')} AS pl_mix, CAST(count(*) AS BIGINT) AS n FROM mx GROUP BY ALL""")
def q_thr13(spark, sf):
    u = fx.imbalanced(spark, sf).filter("role = 'unlabelled'")
    h = aggs.pseudo_label_histogram(u.withColumn("pl", A.argmax("probs")), "pl", K)
    dist = h.select(F.transform(F.sort_array(F.collect_list(F.struct("class_id", "share"))), lambda s: s["share"])).scalar()
    sim = fx.scored(spark, sf, strong=True).select("row_id", F.col("probs").alias("p_sim"))
    b = imbalance.blend_pseudo_label(u.join(sim, "row_id").withColumn("_d", dist), F.col("_d"), "probs", "p_sim", 1.5)
    return b.groupBy("batch_id", "pl_mix").agg(F.count(F.lit(1)).alias("n"))


@query("top3_hard_donors", with_ctes("imbalanced", extra=[
    ("lng", f"SELECT row_id, label_id, {X.long_of('probs')} FROM imbalanced"),
    ("rk", "SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY v DESC, row_id) AS rn FROM lng "
           "WHERE label_id IS DISTINCT FROM class_id")]) + """
SELECT class_id, row_id FROM rk WHERE rn <= 5""")
def q_top3(spark, sf):
    d = imbalance.hard_donors(fx.imbalanced(spark, sf), K, 5)
    return d.select("class_id", "row_id")


@query("joi11_prototype_similarity", with_ctes("emb", "protos", extra=[
    ("ps", "SELECT e.row_id, list(" + X.cosine("e.emb", "p.proto") + " / 0.5 ORDER BY p.label) AS lg "
           "FROM emb e, protos p GROUP BY e.row_id"),
    ("pq", "SELECT row_id, " + X.softmax("lg") + " AS q FROM ps")]) + """
SELECT row_id % 4 AS grp, class_id, round(avg(v), 6) AS p_mean FROM (SELECT row_id, """ + X.long_of("q") + """ FROM pq)
GROUP BY ALL""")
def q_joi11(spark, sf):
    e = fx.embeddings(spark, sf)
    protos = aggs.class_prototypes(e, "label", "emb")
    s = similarity.prototype_similarity(e, "emb", protos, 0.5)
    return long_avg(s.withColumn("grp", F.col("row_id") % 4), ["grp"], "p_sim", "p_mean")


@query("agg15_class_prototypes", with_ctes("emb", "protos") + """
SELECT label, round(list_sum(proto), 6) AS proto_sum, round(sqrt(list_dot_product(proto, proto)), 6) AS proto_norm,
       round(list_sum(list_transform(proto, lambda x: x / sqrt(list_dot_product(proto, proto)))), 6) AS unit_sum FROM protos""")
def q_agg15(spark, sf):
    e = fx.embeddings(spark, sf)
    p = aggs.class_prototypes(e, "label", "emb")
    pn = aggs.class_prototypes(e, "label", "emb", normalise=True).select("label", F.col("proto").alias("unit"))
    j = p.join(pn, "label")
    return j.select("label", r6(A.asum("proto"), "proto_sum"), r6(A.l2_norm("proto"), "proto_norm"),
                    r6(A.asum("unit"), "unit_sum"))


@query("thr14_refine_to_target")
def q_thr14(spark, sf):
    """DARP refinement of the unlabelled rows towards N_ulb x the labelled class
    distribution; rows-only check (iterative, tolerance-based)."""
    s = fx.scored(spark, sf)
    u = s.filter("role = 'unlabelled'")
    lbc = aggs.class_counts(s.filter("role = 'labelled'"), "label_id", K).orderBy("label_id").collect()  # K rows
    n_u = u.count()
    tot = sum(r["n"] for r in lbc)
    target = [n_u * r["n"] / tot for r in lbc]
    ref, _ = imbalance.refine_to_target(u, target, num_iter=10)
    return long_avg(ref.withColumn("grp", F.lit(0)), ["grp"], "probs_refined", "p_mean").select(
        "class_id", (F.col("p_mean") * F.lit(n_u)).alias("class_mass"))


@query("smp2_resample_weighted", with_ctes("imbalanced", extra=[
    ("w", "SELECT label_true, 1.0 / count(*) AS weight FROM imbalanced GROUP BY label_true"),
    ("u", "SELECT i.label_true, i.row_id, w.weight, (CAST(CAST(('0x' || substr(md5(concat_ws(':', i.row_id, 17)), 1, 13)) AS UBIGINT) AS DOUBLE) + 0.5) "
          "/ 4503599627370496.0 AS u FROM imbalanced i JOIN w ON w.label_true = i.label_true")]) + """
SELECT label_true, CAST(count(*) AS BIGINT) AS n_sampled FROM (
  SELECT label_true, row_number() OVER (ORDER BY -ln(u) / weight, row_id) AS rn FROM u) WHERE rn <= 60 GROUP BY label_true""")
def q_smp2(spark, sf):
    """Weighted sampling without replacement (Efraimidis-Spirakis keys,
    class-balanced weights = 1 / class count): sampled rows per class."""
    from sslspark.operators.split import class_balanced_weights, resample_weighted
    imb = fx.imbalanced(spark, sf)
    w = class_balanced_weights(imb.groupBy("label_true").agg(F.count(F.lit(1)).alias("n")))
    d = imb.join(F.broadcast(w.select("label_true", "weight")), "label_true")  # K rows
    s = resample_weighted(d, "row_id", "weight", 60, seed=17)
    return s.groupBy("label_true").agg(F.count(F.lit(1)).alias("n_sampled"))


@query("fn16_interpolate_tail", with_ctes("imbalanced", "scored_strong", extra=[
    ("c", "SELECT label_true, count(*) AS n_c, max(count(*)) OVER () AS n_max FROM imbalanced GROUP BY label_true"),
    ("j", "SELECT i.row_id, i.batch_id, i.probs, s.probs AS donor, c.n_c, c.n_max, "
          "CAST(('0x' || substr(md5(concat_ws(':', i.row_id, 31)), 1, 8)) AS UBIGINT) / 4294967296.0 AS u, "
          "0.6 + 0.4 * CAST(('0x' || substr(md5(concat_ws(':', i.row_id, 32)), 1, 8)) AS UBIGINT) / 4294967296.0 AS lam "
          "FROM imbalanced i JOIN scored_strong s ON s.row_id = i.row_id JOIN c ON c.label_true = i.label_true"),
    ("m", "SELECT batch_id, u < (n_max - n_c) / n_max AS mixed, CASE WHEN u < (n_max - n_c) / n_max THEN "
          + X.zip_with("probs", "donor", "lam * {x} + (1 - lam) * {y}") + " ELSE probs END AS q FROM j")]) + """
SELECT batch_id, class_id, round(avg(v), 6) AS p_mean, CAST(sum(CAST(mixed AS INTEGER)) AS BIGINT) AS n_mixed
FROM (SELECT batch_id, mixed, """ + X.long_of("q") + """ FROM m) GROUP BY batch_id, class_id""")
def q_fn16(spark, sf):
    imb = fx.imbalanced(spark, sf)
    from pyspark.sql import Window
    c = imb.groupBy("label_true").agg(F.count(F.lit(1)).alias("n_c"))
    c = c.withColumn("n_max", F.max("n_c").over(Window.partitionBy()))  # K rows
    don = fx.scored(spark, sf, strong=True).select("row_id", F.col("probs").alias("donor"))
    j = imb.join(don, "row_id").join(F.broadcast(c), "label_true")
    m = imbalance.interpolate_tail(j, "probs", "donor", "label_true", "n_c", "n_max", "row_id", 31, 0.6, out="q")
    return (m.select("batch_id", "mixed", F.posexplode("q").alias("class_id", "v"))
            .groupBy("batch_id", F.col("class_id").cast("int").alias("class_id"))
            .agg(r6(F.avg("v"), "p_mean"), F.sum(F.col("mixed").cast("long")).alias("n_mixed")))


SYN_KEY = "concat_ws(':', d.class_id, d.slot)"


@query("thr19_tail_feature_synthesis", with_ctes("imbalanced", "emb", extra=[
    ("im", "SELECT i.*, e.emb FROM imbalanced i JOIN emb e ON e.row_id = i.row_id"),
    ("lb", "SELECT * FROM im WHERE role = 'labelled'"),
    ("nc", f"SELECT CAST(c AS INTEGER) AS class_id, (SELECT count(*) FROM lb WHERE label_id = c) AS n_c FROM range(0, {K}) t(c)"),
    ("pl", "SELECT *, (SELECT max(n_c) FROM nc) - n_c AS aug FROM nc"),
    ("lg", f"SELECT row_id, emb, CASE WHEN role = 'labelled' THEN label_id END AS own, {X.long_of('probs')} FROM im"),
    ("dn", "SELECT lg.emb AS x_donor, pl.class_id, pl.n_c, pl.aug, row_number() OVER (PARTITION BY pl.class_id ORDER BY lg.v DESC, lg.row_id) AS slot "
           "FROM lg JOIN pl ON pl.class_id = lg.class_id WHERE lg.own IS DISTINCT FROM lg.class_id AND pl.aug > 0 AND pl.n_c > 0"),
    ("mb", "SELECT label_id AS class_id, emb AS x_member, row_number() OVER (PARTITION BY label_id ORDER BY md5(concat_ws(':', row_id, 4)), row_id) AS m_rank FROM lb"),
    ("sl", f"SELECT d.*, {X.hash_beta(SYN_KEY, 6, 0.75)} AS lam, "
           f"CAST(floor((('0x' || substr(md5(concat_ws(':', {SYN_KEY}, 5)), 1, 8))::BIGINT / 4294967296.0) * d.n_c) + 1 AS BIGINT) AS m_rank FROM dn d WHERE d.slot <= d.aug"),
    ("sy", "SELECT sl.class_id AS label_id, sl.lam, " + X.zip_with("mb.x_member", "sl.x_donor", "sl.lam * {x} + (1 - sl.lam) * {y}")
           + " AS feat FROM sl JOIN mb ON mb.class_id = sl.class_id AND mb.m_rank = sl.m_rank"),
    ("al", "SELECT label_id, emb AS feat, NULL AS lam, 0 AS syn FROM lb UNION ALL SELECT label_id, feat, lam, 1 FROM sy")]) + """
SELECT label_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(syn) AS BIGINT) AS n_synthetic, round(min(lam), 6) AS lam_min, round(max(lam), 6) AS lam_max,
       round(avg(list_sum(feat)), 6) AS feat_mean FROM al GROUP BY label_id""")
def q_thr19(spark, sf):
    """CoSSL feature synthesis on the long-tailed fixture: rows per class after
    synthesis (all equal n_max), the lam range and the mean feature sum."""
    imb = fx.imbalanced(spark, sf, keep_emb=True)
    lb = imb.filter("role = 'labelled'").select("row_id", F.col("emb").alias("feat"), "probs", "label_id")
    ulb = imb.filter("role = 'unlabelled'").select("row_id", F.col("emb").alias("feat"), "probs")
    out = imbalance.tail_feature_synthesis(lb, ulb, K, seed=3)
    return out.groupBy("label_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("synthetic").cast("long")).alias("n_synthetic"),
                                       r6(F.min("lam"), "lam_min"), r6(F.max("lam"), "lam_max"), r6(F.avg(A.asum("feat")), "feat_mean"))
