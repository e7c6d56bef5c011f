"""Bank / graph / pairing queries (JOI7-10, JOI12, FN15, FN21-22, THR12, THR18,
WIN16-17, JOB12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sslspark.functions import arrays as A
from sslspark.operators import aggs, policies, similarity as S
from sslspark.plans import fixtures as fx
from sslspark.plans import sql_expr as X
from sslspark.plans.catalog import query, r6
from sslspark.plans.q_core import long_avg, sql_long_avg, two_views, TWO_VIEWS_SQL
from sslspark.plans.sql_fixtures import with_ctes

K = fx.K_SCORED
L = 32


def feats(spark, sf) -> DataFrame:
    """scored + unit-normalised embedding as the feature."""
    return fx.scored(spark, sf, keep_emb=True).withColumn("feat", A.l2_normalise("emb")).drop("emb")


SCORED_EMB = ("SELECT s.*, " + X.transform("e.emb", "{x} / greatest(" + X.norm("e.emb").replace("{", "{{").replace("}", "}}")
              + ", 1e-12)") + " AS feat FROM scored s JOIN emb e ON e.row_id = s.row_id")
RING_SQL = (f"SELECT row_id, batch_id, feat, CASE WHEN role = 'labelled' THEN {X.one_hot('label_id', K)} ELSE probs END AS bp "
            f"FROM sf ORDER BY batch_id DESC, row_id DESC LIMIT {L}")


def ring(spark, sf, f: DataFrame) -> DataFrame:
    b = f.select("row_id", "batch_id", "feat",
                 F.when(F.col("role") == "labelled", A.one_hot("label_id", K)).otherwise(F.col("probs")).alias("bp"))
    return S.ring_bank(b, L)


@query("win16_ring_bank", with_ctes("scored", extra=[("sf", SCORED_EMB), ("rb", RING_SQL)]) + """
SELECT row_id, round(list_sum(bp), 6) AS mass, round(list_max(bp), 6) AS top FROM rb""")
def q_win16(spark, sf):
    r = ring(spark, sf, feats(spark, sf))
    return r.select("row_id", r6(A.asum("bp"), "mass"), r6(F.array_max("bp"), "top"))


def _smooth(spark, sf) -> DataFrame:
    f = feats(spark, sf)
    d = S.attach_bank(f, ring(spark, sf, f), ["feat", "bp"])
    d = d.withColumn("A", S.bank_similarity("feat", "_bank", "feat", 0.1))
    return d.withColumn("p_smooth", S.neighbour_smooth("probs", "A", "_bank", "bp", 0.9, K))


SMOOTH_SQL = [("sf", SCORED_EMB), ("rb", RING_SQL),
              ("bk", "SELECT list({'f': feat, 'p': bp} ORDER BY batch_id DESC, row_id DESC) AS bank FROM rb"),
              ("aw", "SELECT sf.*, " + X.softmax(X.transform("bk.bank", "list_dot_product(sf.feat, {x}.f) / 0.1"))
                     + " AS a, bk.bank FROM sf, bk")]


@query("joi7_bank_similarity", with_ctes("scored", "emb", extra=SMOOTH_SQL) + f"""
SELECT batch_id, round(avg(list_max(a)), 6) AS max_weight, round(avg({X.entropy('a')}), 6) AS weight_entropy
FROM aw GROUP BY batch_id""")
def q_joi7(spark, sf):
    d = _smooth(spark, sf)
    return d.groupBy("batch_id").agg(r6(F.avg(F.array_max("A")), "max_weight"), r6(F.avg(A.entropy("A")), "weight_entropy"))


@query("joi8_neighbour_smooth", with_ctes("scored", "emb", extra=SMOOTH_SQL + [(
    "sm", "SELECT batch_id, list_transform(range(0, 10), lambda c: 0.9 * probs[c + 1] + 0.1 * "
          "list_sum(list_transform(list_zip(a, bank), lambda z: z[1] * z[2].p[c + 1]))) AS q FROM aw")])
       + sql_long_avg("sm", ["batch_id"], "q", "p_mean"))
def q_joi8(spark, sf):
    return long_avg(_smooth(spark, sf), ["batch_id"], "p_smooth", "p_mean")


def _keyed(spark, sf) -> DataFrame:
    f = feats(spark, sf)
    lb = f.filter("role = 'labelled'").select("row_id", "batch_id", "feat", "label_id")
    kb = S.keyed_bank(lb, "row_id", "batch_id", "feat").join(lb.select("row_id", "label_id"), "row_id")
    return S.propagate_over_bank(f.filter("role = 'unlabelled'"), kb, K, 0.1, 0.2, 0.9)


KEYED_SQL = [("sf", SCORED_EMB),
             ("kb", "SELECT list({'f': feat, 'l': label_id} ORDER BY row_id) AS bank FROM sf WHERE role = 'labelled'"),
             ("aw", "SELECT sf.*, " + X.softmax(X.transform("kb.bank", "list_dot_product(sf.feat, {x}.f) / 0.1"))
                    + " AS a, " + X.softmax(X.transform("kb.bank", "list_dot_product(sf.feat, {x}.f) / 0.2"))
                    + " AS a_s, kb.bank FROM sf, kb WHERE sf.role = 'unlabelled'"),
             ("tp", "SELECT *, list_transform(list_zip(a, bank), lambda z: z[1] * probs[z[2].l + 1]) AS raw FROM aw"),
             ("tq", "SELECT *, list_transform(raw, lambda x: x / list_sum(raw)) AS teacher, "
                    "list_transform(range(0, 10), lambda c: 0.9 * probs[c + 1] + 0.1 * list_sum(list_transform("
                    "list_zip(a, bank), lambda z: CASE WHEN z[2].l = c THEN z[1] ELSE 0.0 END))) AS p_prop FROM tp")]


@query("joi9_label_propagate", with_ctes("scored", "emb", extra=KEYED_SQL) + sql_long_avg("tq", ["batch_id"], "p_prop", "p_mean"))
def q_joi9(spark, sf):
    return long_avg(_keyed(spark, sf), ["batch_id"], "p_prop", "p_mean")


@query("fn22_instance_consistency", with_ctes("scored", "emb", extra=KEYED_SQL) + """
SELECT batch_id, round(avg(-list_sum(list_transform(list_zip(teacher, a_s), lambda z: z[1] * ln(z[2])))), 6) AS in_loss
FROM tq GROUP BY batch_id""")
def q_fn22(spark, sf):
    return _keyed(spark, sf).groupBy("batch_id").agg(r6(F.avg("in_loss"), "in_loss"))


def _two_epoch_lb(spark, sf) -> DataFrame:
    f = feats(spark, sf).filter("role = 'labelled'").select("row_id", "batch_id", "feat")
    epoch = fx.scored(spark, sf).agg(F.max("batch_id") + 1).scalar()  # the second epoch follows the first
    g = fx.scored(spark, sf, strong=True, keep_emb=True).filter("role = 'labelled'").select(
        "row_id", (F.col("batch_id") + epoch).alias("batch_id"), A.l2_normalise(A.scale_array("emb", 2.0)).alias("feat"))
    # second epoch: the same ids with a perturbed feature (scaled, then re-normalised, plus the strong prototype)
    g = g.withColumn("feat", A.l2_normalise(F.transform("feat", lambda a: a + F.lit(0.05))))
    return f.unionByName(g)


@query("win17_keyed_bank", with_ctes("scored", "emb", extra=[
    ("sf", SCORED_EMB),
    ("e2", "SELECT s.row_id, s.batch_id + (SELECT max(batch_id) + 1 FROM scored) AS batch_id, list_transform(n, lambda x: x / sqrt(list_dot_product(n, n))) AS feat "
           "FROM (SELECT row_id, batch_id, list_transform(u, lambda x: x + 0.05) AS n FROM (SELECT row_id, batch_id, "
           "list_transform(emb, lambda x: 2 * x / greatest(sqrt(list_dot_product(emb, emb)) * 2, 1e-12)) AS u "
           "FROM (SELECT s.row_id, s.batch_id, e.emb FROM scored s JOIN emb e ON e.row_id = s.row_id "
           "WHERE s.role = 'labelled'))) s"),
    ("mix", "SELECT a.row_id, list_transform(list_zip(a.feat, b.feat), lambda z: 0.7 * z[1] + 0.3 * z[2]) AS m "
            "FROM sf a JOIN e2 b ON a.row_id = b.row_id WHERE a.role = 'labelled'")]) + """
SELECT e2.row_id, round(list_sum(e2.feat), 6) AS replaced_sum,
       round(list_sum(list_transform(mix.m, lambda x: x / sqrt(list_dot_product(mix.m, mix.m)))), 6) AS ema_sum
FROM e2 JOIN mix ON mix.row_id = e2.row_id""")
def q_win17(spark, sf):
    d = _two_epoch_lb(spark, sf)
    rep = S.keyed_bank(d, "row_id", "batch_id", "feat").select("row_id", r6(A.asum("feat"), "replaced_sum"))
    em = S.keyed_bank(d, "row_id", "batch_id", "feat", m=0.7).select("row_id", r6(A.asum("feat"), "ema_sum"))
    return rep.join(em, "row_id")


PART_SQL = """SELECT a.row_id, b.row_id AS partner_id, a.batch_id FROM
  (SELECT row_id, batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY md5(concat_ws(':', row_id, 21)), row_id) AS rn FROM scored) a
  JOIN (SELECT row_id, batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY md5(concat_ws(':', row_id, 22)), row_id) AS rn FROM scored) b
  ON a.batch_id = b.batch_id AND a.rn = b.rn"""


@query("joi12_random_partner", with_ctes("scored") + "SELECT row_id, partner_id FROM (" + PART_SQL + ")")
def q_joi12(spark, sf):
    return S.random_partner(fx.scored(spark, sf), "row_id", "batch_id", 21, 22).select("row_id", "partner_id")


@query("fn15_mixup", with_ctes("scored", extra=[("pp", PART_SQL), (
    "mx", "SELECT pp.batch_id, " + X.zip_with("a.probs", "b.probs", "0.7 * {x} + 0.3 * {y}") + " AS q FROM pp "
          "JOIN scored a ON a.row_id = pp.row_id JOIN scored b ON b.row_id = pp.partner_id")]) + sql_long_avg("mx", ["batch_id"], "q", "p_mean"))
def q_fn15(spark, sf):
    s = fx.scored(spark, sf)
    p = S.random_partner(s.select("row_id", "batch_id", "probs"), "row_id", "batch_id", 21, 22)
    p = p.join(s.select(F.col("row_id").alias("partner_id"), F.col("probs").alias("probs_b")), "partner_id")
    return long_avg(p, ["batch_id"], A.mixup("probs", "probs_b", 0.7), "p_mean")


@query("fn15_mixup_beta", with_ctes("scored", extra=[("pp", PART_SQL), (
    "lm", "SELECT *, " + X.hash_beta("row_id", 23, 0.75) + " AS b FROM pp"), (
    "mx", "SELECT lm.batch_id, greatest(lm.b, 1 - lm.b) AS lam, " + X.zip_with("a.probs", "b.probs", "greatest(lm.b, 1 - lm.b) * {x} + (1 - greatest(lm.b, 1 - lm.b)) * {y}")
          + " AS q FROM lm JOIN scored a ON a.row_id = lm.row_id JOIN scored b ON b.row_id = lm.partner_id")])
       + sql_long_avg("mx", ["batch_id"], "q", "p_mean"))
def q_fn15_beta(spark, sf):
    s = fx.scored(spark, sf)
    p = S.random_partner(s.select("row_id", "batch_id", "probs"), "row_id", "batch_id", 21, 22)
    p = p.join(s.select(F.col("row_id").alias("partner_id"), F.col("probs").alias("probs_b")), "partner_id")
    return long_avg(p, ["batch_id"], A.mixup_beta("probs", "probs_b", "row_id", 23, 0.75), "p_mean")


@query("fn21_cosine_repulsion", with_ctes("scored", "emb", "protos", extra=[("sf", SCORED_EMB)]) + f"""
SELECT sf.batch_id, round(avg(greatest({X.cosine('sf.feat', 'p.proto')}, 0.0)
       * CASE WHEN list_max(sf.probs) >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS loss
FROM sf JOIN protos p ON p.label = {X.argmax('sf.probs')} GROUP BY sf.batch_id""")
def q_fn21(spark, sf):
    f = feats(spark, sf)
    e = fx.embeddings(spark, sf)
    f = f.withColumn("_P", aggs.prototype_map(aggs.class_prototypes(e, "label", "emb")))
    f = f.withColumn("proto", F.element_at(F.col("_P"), A.argmax("probs")))
    mask = (A.confidence("probs") >= 0.5).cast("double")
    return f.groupBy("batch_id").agg(r6(F.avg(A.cosine_repulsion("feat", "proto", mask)), "loss"))


def _graph(spark, sf) -> DataFrame:
    f = feats(spark, sf).filter("role = 'unlabelled'")
    d = S.batch_arrays(f, "batch_id", ["probs", "feat"])
    d = d.withColumn("Q", S.pseudo_label_graph("row_id", "probs", "_batch", 0.3))
    return d.withColumn("c_loss", S.contrastive_loss("Q", "feat", "feat", "_batch", 0.2))


GRAPH_SQL = [("sf", SCORED_EMB),
             ("u", "SELECT * FROM sf WHERE role = 'unlabelled'"),
             ("bt", "SELECT batch_id, list({'id': row_id, 'p': probs, 'f': feat}) AS bt FROM u GROUP BY batch_id"),
             ("g0", "SELECT u.row_id, u.batch_id, u.feat, bt.bt, list_transform(bt.bt, lambda e: CASE WHEN e.id = u.row_id "
                    "THEN 1.0 ELSE list_dot_product(u.probs, e.p) END) AS q0 FROM u JOIN bt ON bt.batch_id = u.batch_id"),
             ("g1", "SELECT *, list_transform(q0, lambda x: CASE WHEN x >= 0.3 THEN x ELSE 0.0 END) AS q1 FROM g0"),
             ("g2", "SELECT *, list_transform(q1, lambda x: x / list_sum(q1)) AS q FROM g1")]


@query("joi10_pseudo_label_graph", with_ctes("scored", "emb", extra=GRAPH_SQL) + """
SELECT batch_id, round(avg(list_count(list_filter(q, lambda x: x > 0))), 6) AS mean_degree,
       round(avg(list_max(q)), 6) AS mean_top FROM g2 GROUP BY batch_id""")
def q_joi10(spark, sf):
    d = _graph(spark, sf)
    deg = F.size(F.filter("Q", lambda x: x > 0))
    return d.groupBy("batch_id").agg(r6(F.avg(deg), "mean_degree"), r6(F.avg(F.array_max("Q")), "mean_top"))


@query("thr18_contrastive_loss", with_ctes("scored", "emb", extra=GRAPH_SQL + [(
    "cl", "SELECT batch_id, -list_sum(list_transform(list_zip(q, " + X.softmax(
        X.transform("bt", "list_dot_product(feat, {x}.f) / 0.2")) + "), lambda z: z[1] * ln(z[2] + 1e-7))) AS c FROM g2")]) + """
SELECT batch_id, round(avg(c), 6) AS contrast_loss FROM cl GROUP BY batch_id""")
def q_thr18(spark, sf):
    return _graph(spark, sf).groupBy("batch_id").agg(r6(F.avg("c_loss"), "contrast_loss"))


@query("thr12_double_view_mask", with_ctes("scored", "scored_strong", extra=[("tv", TWO_VIEWS_SQL)]) + f"""
SELECT role, round(avg(m), 6) AS util_ratio, round(avg(l * m), 6) AS masked_loss FROM (
  SELECT role, CASE WHEN list_max(probs) >= 0.6 THEN 1.0 ELSE 0.0 END AS m,
         {X.ce_hard('logits_s', X.argmax('probs'))} AS l FROM tv) GROUP BY role""")
def q_thr12(spark, sf):
    """DeFixMatch: the same mask rule on labelled and unlabelled rows; the
    loss difference is the unlabelled minus the labelled masked loss."""
    t = policies.fixed_threshold(two_views(spark, sf), "probs", 0.6)
    t = t.withColumn("l", A.cross_entropy_hard("logits_s", A.argmax("probs")))
    return t.groupBy("role").agg(r6(F.avg("mask"), "util_ratio"), r6(F.avg(F.col("l") * F.col("mask")), "masked_loss"))


@query("job12_weighted_losses_report", with_ctes("scored", "scored_strong", extra=[("tv", TWO_VIEWS_SQL), (
    "rows", f"""SELECT batch_id, role,
      CASE WHEN role = 'labelled' THEN {X.ce_hard('logits', 'label_id')} END AS sup,
      CASE WHEN role = 'unlabelled' THEN {X.ce_hard('logits_s', X.argmax('probs'))}
           * CASE WHEN list_max(probs) >= 0.6 THEN 1.0 ELSE 0.0 END END AS u_fix,
      CASE WHEN role = 'unlabelled' THEN list_sum({X.zip_with(X.softmax('logits_s'), 'probs', '({x} - {y}) * ({x} - {y})')}) / 10.0 END AS u_pi
    FROM tv""")]) + """
SELECT batch_id, policy, round(sup, 6) AS sup_loss, round(unsup, 6) AS unsup_loss,
       round(sup + 1.0 * least(greatest(batch_id / 4.0, 0.0), 1.0) * unsup, 6) AS total_loss FROM (
  SELECT batch_id, 'fixmatch' AS policy, avg(sup) AS sup, avg(u_fix) AS unsup FROM rows GROUP BY batch_id
  UNION ALL SELECT batch_id, 'pimodel', avg(sup), avg(u_pi) FROM rows GROUP BY batch_id)""")
def q_job12(spark, sf):
    """Per batch: supervised CE + lambda * ramp(t) * unsupervised term, for a
    hard-label (FixMatch) and an MSE (Pi-model) policy."""
    t = two_views(spark, sf)
    lab = F.col("role") == "labelled"
    t = t.select("batch_id", "role",
                 F.when(lab, A.cross_entropy_hard("logits", "label_id")).alias("sup"),
                 F.when(~lab, A.consistency_loss("logits_s", A.argmax("probs"), "ce",
                                                 (A.confidence("probs") >= 0.6).cast("double"))).alias("u_fix"),
                 F.when(~lab, A.consistency_loss("logits_s", "probs", "mse")).alias("u_pi"))
    g = t.groupBy("batch_id").agg(F.avg("sup").alias("sup"), F.avg("u_fix").alias("u_fix"), F.avg("u_pi").alias("u_pi"))
    g = g.select("batch_id", "sup", F.explode(F.array(
        F.struct(F.lit("fixmatch").alias("policy"), F.col("u_fix").alias("unsup")),
        F.struct(F.lit("pimodel").alias("policy"), F.col("u_pi").alias("unsup")))).alias("x")).select("batch_id", "sup", "x.*")
    total = F.col("sup") + F.lit(1.0) * A.ramp(F.col("batch_id"), 4) * F.col("unsup")
    return g.select("batch_id", "policy", r6("sup", "sup_loss"), r6("unsup", "unsup_loss"), r6(total, "total_loss"))


# --- state as of each batch ------------------------------------------------------------------------

FIFO = 5


@query("win11_fifo_prototypes", with_ctes("scored", "emb", extra=[
    ("r", "SELECT s.label_true AS label, s.batch_id, s.row_id, e.emb, row_number() OVER (PARTITION BY s.label_true ORDER BY s.batch_id, s.row_id) AS rk "
          "FROM scored s JOIN emb e ON e.row_id = s.row_id"),
    ("t", "SELECT label, batch_id, max(rk) AS last FROM r GROUP BY label, batch_id"),
    ("m", f"SELECT t.label, t.batch_id, pos, count(*) AS n, avg(v) AS v FROM t JOIN (SELECT label, rk, unnest(range(1, len(emb) + 1)) AS pos, unnest(emb) AS v FROM r) x "
          f"ON x.label = t.label AND x.rk <= t.last AND x.rk > t.last - {FIFO} GROUP BY t.label, t.batch_id, pos")]) + """
SELECT label, batch_id, CAST(max(n) AS BIGINT) AS n, round(sum(v), 6) AS total, round(max(v), 6) AS top FROM m GROUP BY label, batch_id""")
def q_win11(spark, sf):
    s = fx.scored(spark, sf, keep_emb=True).withColumnRenamed("label_true", "label")
    d = S.fifo_prototypes(s, "label", "emb", FIFO)
    return d.select("label", "batch_id", F.col("n").cast("long").alias("n"), r6(A.asum("proto"), "total"), r6(F.array_max("proto"), "top"))


def bank_rows(f: DataFrame) -> DataFrame:
    return f.select("row_id", "batch_id", "feat", F.when(F.col("role") == "labelled", A.one_hot("label_id", K)).otherwise(F.col("probs")).alias("bp"))


RANKED_SQL = (f"SELECT row_id, batch_id, feat, CASE WHEN role = 'labelled' THEN {X.one_hot('label_id', K)} ELSE probs END AS bp, "
              "row_number() OVER (ORDER BY batch_id, row_id) AS rk FROM sf")
AS_OF_SQL = [("sf", SCORED_EMB), ("rk", RANKED_SQL),
             ("up", "SELECT t.batch_id, coalesce((SELECT max(rk) FROM rk WHERE rk.batch_id < t.batch_id), 0) AS last FROM (SELECT DISTINCT batch_id FROM sf) t"),
             ("bk", f"SELECT up.batch_id, list({{'f': rk.feat, 'p': rk.bp}} ORDER BY rk.rk DESC) AS bank FROM up JOIN rk ON rk.rk <= up.last AND rk.rk > up.last - {L} "
                    "GROUP BY up.batch_id"),
             ("aw", "SELECT sf.*, " + X.softmax(X.transform("bk.bank", "list_dot_product(sf.feat, {x}.f) / 0.1"))
                    + " AS a, bk.bank FROM sf LEFT JOIN bk ON bk.batch_id = sf.batch_id")]


@query("win16_bank_as_of_batch", with_ctes("scored", "emb", extra=AS_OF_SQL) + """
SELECT sf.batch_id, CAST(coalesce(any_value(len(bk.bank)), 0) AS BIGINT) AS n,
       round(coalesce(any_value(list_sum(list_transform(bk.bank, lambda b: list_max(b.p)))), 0), 6) AS top
FROM sf LEFT JOIN bk ON bk.batch_id = sf.batch_id GROUP BY sf.batch_id""")
def q_win16_as_of(spark, sf):
    f = feats(spark, sf)
    d = S.ring_bank_as_of(f.select("row_id", "batch_id"), bank_rows(f), L, ["bp"])
    top = F.aggregate("_bank", F.lit(0.0), lambda a, b: a + F.array_max(b["bp"]))
    return d.groupBy("batch_id").agg(F.max(F.size("_bank")).cast("long").alias("n"), r6(F.max(top), "top"))


@query("joi8_smooth_as_of_batch", with_ctes("scored", "emb", extra=AS_OF_SQL + [(
    "sm", "SELECT batch_id, CASE WHEN bank IS NULL THEN probs ELSE list_transform(range(0, 10), lambda c: 0.9 * probs[c + 1] + 0.1 * "
          "list_sum(list_transform(list_zip(a, bank), lambda z: z[1] * z[2].p[c + 1]))) END AS q FROM aw")])
       + sql_long_avg("sm", ["batch_id"], "q", "p_mean"))
def q_joi8_as_of(spark, sf):
    f = feats(spark, sf)
    return long_avg(S.smooth_with_bank(f, bank_rows(f), L, K, 0.1, 0.9), ["batch_id"], "p_smooth", "p_mean")
