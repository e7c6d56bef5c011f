"""Class-imbalance policies (WIN8, WIN13, THR13, THR16, TOP2-3, FN16).

Per-class quotas are K numbers; the ranked selections use the bucketed
exact ``rank_select`` (a head class can hold a third of the rows).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sslspark.functions.arrays import argmax, confidence, element, sharpen
from sslspark.functions.keys import hash_beta, hash_u
from sslspark.operators.split import rank_select

__all__ = ["crest_quota", "top_confident_per_class", "top_k_mass_per_class", "blend_pseudo_label",
           "sort_classes_by_frequency", "hard_donors", "interpolate_tail"]


def crest_quota(K: int, imb_ratio: float, alpha: float, by: str = "class_id",
                class_order: Sequence[int] | None = None) -> list[float]:
    """WIN8 keep-rate per class: (mu^(K-1-e))^(1/alpha), mu = (1/imb)^(1/(K-1)).

    ``by='class_id'``: e = class id (the reference, T17); ``by='rank'``: e =
    the class's frequency rank (``class_order`` = classes by count desc)."""
    mu = math.pow(1.0 / imb_ratio, 1.0 / (K - 1))
    if by == "class_id":
        e = list(range(K))
    else:
        if class_order is None:
            raise ValueError("by='rank' needs class_order")
        e = [0] * K
        for r, c in enumerate(class_order):
            e[c] = r
    return [math.pow(math.pow(mu, (K - 1) - e[c]), 1.0 / alpha) for c in range(K)]


def top_confident_per_class(df: DataFrame, rates: Sequence[float] | Column, id_col: str = "row_id",
                            probs_col: str = "probs", out: str = "picked") -> DataFrame:
    """WIN8 (CReST): within each predicted class keep the first
    ``int(n_c * rate_c)`` rows by confidence (desc, id)."""
    d = df.withColumns({"_conf": confidence(probs_col), "_pl": argmax(probs_col)})
    arr = rates if isinstance(rates, Column) else F.array(*[F.lit(float(r)) for r in rates])
    q = lambda n: F.floor(n.cast("double") * F.element_at(arr, F.col("_pl") + 1)).cast("long")
    return rank_select(d, ["_pl"], id_col, 0, {out: q}, score=F.col("_conf")).drop("_conf", "_pl")


def top_k_mass_per_class(df: DataFrame, target_counts: Sequence[float], alpha: float, K: int,
                         id_col: str = "row_id", probs_col: str = "probs"):
    """WIN13 (DARP step 1): for each class c the top int(alpha * q_c) rows by
    p_c get flag 1; weight_c = (q_c + 1e-6) / (sum of those p_c + 1e-6).

    Returns (flags long table (row, class_id), K-row weight table)."""
    lng = (df.select(id_col, F.posexplode(probs_col).alias("class_id", "p"))
           .withColumn("class_id", F.col("class_id").cast("int")))
    quota = F.array(*[F.lit(int(alpha * q)) for q in target_counts])
    sel = rank_select(lng, ["class_id"], id_col, 0,
                      {"_top": lambda n: F.element_at(quota, F.col("class_id") + 1).cast("long")},
                      score=F.col("p"))
    flags = sel.filter("_top").select(id_col, "class_id", "p")
    mass = flags.groupBy("class_id").agg(F.sum("p").alias("k_prob"))
    qt = df.sparkSession.createDataFrame([(c, float(q)) for c, q in enumerate(target_counts)], "class_id int, q double")
    w = (F.broadcast(qt).join(mass, "class_id", "left")
         .select("class_id", ((F.col("q") + 1e-6) / (F.coalesce("k_prob", F.lit(0.0)) + 1e-6)).alias("weight")))
    return flags, w


def blend_pseudo_label(df: DataFrame, dist: Column, probs_col: str, sim_col: str, T_dist: float = 1.5,
                       out: str = "probs_mix") -> DataFrame:
    """THR13 (DASO): v = (dist^(1/T) normalised) / max at the predicted class;
    p_mix = (1 - v) p + v p_sim; the new pseudo-label is argmax(p_mix).
    ``dist``: K-vector Column (pseudo-label distribution, e.g. a scalar subquery)."""
    d = df.withColumn("_dist", sharpen(dist, T_dist))
    v = element("_dist", argmax(probs_col)) / F.array_max("_dist")
    d = d.withColumn("_v", v)
    mix = F.zip_with(F.col(probs_col), F.col(sim_col), lambda p, s: (F.lit(1.0) - F.col("_v")) * p + F.col("_v") * s)
    return d.withColumn(out, mix).withColumn("pl_mix", argmax(out)).drop("_dist", "_v")


def sort_classes_by_frequency(counts: DataFrame, count_col: str = "n") -> DataFrame:
    """TOP2: K rows ordered by count desc (then class)."""
    return counts.orderBy(F.desc(count_col), "class_id")


def hard_donors(df: DataFrame, K: int, size: int, id_col: str = "row_id", probs_col: str = "probs",
                label_col: str = "label_id") -> DataFrame:
    """TOP3 (CoSSL): for each target class c, the top ``size`` rows *not*
    labelled c (other classes and unlabelled rows) by p_c."""
    lng = (df.select(id_col, label_col, F.posexplode(probs_col).alias("class_id", "p"))
           .withColumn("class_id", F.col("class_id").cast("int"))
           .filter(~F.col(label_col).eqNullSafe(F.col("class_id"))))
    sel = rank_select(lng, ["class_id"], id_col, 0, {"_top": lambda n: F.lit(int(size)).cast("long")},
                      score=F.col("p"))
    return sel.filter("_top").drop("_top")


def interpolate_tail(df: DataFrame, feat_col: str, donor_col: str, label_col: str, counts_col: str,
                     n_max, id_col: str, seed: int, max_lam: float = 0.6, out: str = "feat_mix") -> DataFrame:
    """FN16 (CoSSL): with probability (n_max - n_c) / n_max a row is mixed
    with its donor, lam ~ U(max_lam, 1) (md5-seeded); label kept."""
    u = hash_u(id_col, seed)
    lam = F.lit(max_lam) + (F.lit(1.0) - F.lit(max_lam)) * hash_u(id_col, seed + 1)
    nm = (F.col(n_max) if isinstance(n_max, str) else n_max if isinstance(n_max, Column) else F.lit(n_max)).cast("double")
    use = u < (nm - F.col(counts_col)) / nm
    mixed = F.zip_with(F.col(feat_col), F.col(donor_col), lambda a, b: lam * a + (F.lit(1.0) - lam) * b)
    return df.withColumn(out, F.when(use, mixed).otherwise(F.col(feat_col))).withColumn("mixed", use)


def refine_to_target(df: DataFrame, target: Sequence[float], id_col: str = "row_id", probs_col: str = "probs",
                     num_iter: int = 10, num_secant: int = 500, tol: float = 0.1, out: str = "probs_refined"):
    """THR14 (DARP): rescale probabilities so class masses match ``target``
    (row sums stay 1), with entropy weights w_i = 1 / H(p_i).

    Alternating scaling: the row step is a closed-form expression; the class
    step solves K one-dimensional roots sum_i A_ik X_i exp(-nu_k / w_i) = c_k
    by the secant method from the previous roots (tolerance ``tol``, at most
    ``num_secant`` steps).  Each secant step for all K classes is ONE
    aggregate over the rows returning K sums; only the K roots live on the
    driver, and the row table is read from cache (no lineage growth).
    Returns (refined rows, list of K roots).
    """
    import math as _m
    K = len(target)
    e = _m.e
    base = df.select(id_col, F.transform(F.col(probs_col), lambda p: p / F.lit(e)).alias("_ae"),
                     (F.lit(1.0) / (-F.aggregate(F.transform(F.col(probs_col), lambda p: p * F.log(p + F.lit(1e-6))),
                                                 F.lit(0.0), lambda a, x: a + x))).alias("_w")).persist()

    def x_of(nu):
        nu_arr = F.array(*[F.lit(float(v)) for v in nu])
        denom = F.aggregate(F.zip_with("_ae", nu_arr, lambda a, n: a * F.exp(-n / F.col("_w"))), F.lit(0.0),
                            lambda s, x: s + x)
        return F.lit(1.0) / denom

    def f_all(xt_df, xs):
        aggs_ = [F.sum(F.element_at("_ae", k + 1) * F.col("_x") * F.exp(F.lit(-float(xs[k])) / F.col("_w")))
                 for k in range(K)]
        row = xt_df.agg(*aggs_).first()
        return [row[k] - float(target[k]) for k in range(K)]

    nu = [0.0] * K
    for _ in range(num_iter):
        xt = base.withColumn("_x", x_of(nu)).select("_ae", "_w", "_x")
        # scipy-style secant start
        x0 = list(nu)
        x1 = [v * (1 + 1e-4) + (1e-4 if v >= 0 else -1e-4) for v in x0]
        f0, f1 = f_all(xt, x0), f_all(xt, x1)
        done = [False] * K
        for _s in range(num_secant):
            x2 = list(x1)
            for k in range(K):
                if done[k]:
                    continue
                if f1[k] == f0[k]:
                    done[k] = True
                    continue
                x2[k] = x1[k] - f1[k] * (x1[k] - x0[k]) / (f1[k] - f0[k])
                if abs(x2[k] - x1[k]) < tol:
                    done[k] = True
            x0, f0, x1 = x1, f1, x2
            if all(done):
                break
            f1 = f_all(xt, x1)
        nu = x1
    nu_arr = F.array(*[F.lit(float(v)) for v in nu])
    res = base.withColumn("_x", x_of(nu)).select(
        id_col, F.zip_with("_ae", nu_arr, lambda a, n: a * F.col("_x") * F.exp(-n / F.col("_w"))).alias(out))
    return res, nu


def tail_feature_synthesis(lb: DataFrame, ulb: DataFrame, K: int, id_col: str = "row_id", feat_col: str = "feat",
                           label_col: str = "label_id", probs_col: str = "probs", seed: int = 0,
                           alpha: float = 0.75) -> DataFrame:
    """THR19 (CoSSL TFE): top up every class to n_max labelled rows with
    lam * x_member + (1 - lam) * x_donor, lam ~ Beta(alpha, alpha).

    Donors of class c: the top (n_max - n_c) rows of the *other* labelled rows
    and all unlabelled rows by p_c (the j-th synthetic row uses the j-th
    donor).  Members: drawn with replacement from class c by a hashed index
    into the class's exact rank.  Both ranks come from the bucketed
    ``rank_select``; lam is a hashed draw of the slot (``hash_beta``).
    Output: labelled rows plus synthetic rows, ``(id, feat, label, synthetic)``.
    """
    counts = lb.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    cls = lb.sparkSession.range(K).select(F.col("id").cast("int").alias("class_id"))
    plan = (F.broadcast(cls).join(counts.withColumnRenamed(label_col, "class_id"), "class_id", "left")
            .withColumn("n_c", F.coalesce("n_c", F.lit(0))))
    plan = plan.withColumn("aug", F.max("n_c").over(Window.partitionBy()) - F.col("n_c"))  # K rows
    pool = (lb.select(id_col, feat_col, probs_col, label_col)
            .unionByName(ulb.select(id_col, feat_col, probs_col, F.lit(None).cast("int").alias(label_col))))
    lng = (pool.select(id_col, feat_col, label_col, F.posexplode(probs_col).alias("class_id", "p"))
           .withColumn("class_id", F.col("class_id").cast("int"))
           .filter(~F.col(label_col).eqNullSafe(F.col("class_id")))
           .join(F.broadcast(plan.select("class_id", "aug", "n_c")), "class_id")
           .filter((F.col("aug") > 0) & (F.col("n_c") > 0)))
    aug_map = plan.select(F.map_from_entries(F.collect_list(F.struct("class_id", "aug")))).scalar()  # K entries
    donors = rank_select(lng, ["class_id"], id_col, seed,
                         {"_d": lambda n: F.element_at(aug_map, F.col("class_id")).cast("long")},
                         score=F.col("p"), rank_col="slot").filter("_d")
    members = rank_select(lb.select(id_col, feat_col, F.col(label_col).alias("class_id")), ["class_id"], id_col,
                          seed + 1, {"_m": lambda n: n}, rank_col="m_rank")
    slots = donors.select("class_id", "slot", F.col(feat_col).alias("x_donor"), "n_c")
    slots = slots.withColumn("m_rank", (F.floor(hash_u(F.concat_ws(":", "class_id", "slot"), seed + 2) * F.col("n_c"))
                                        + 1).cast("long"))
    slots = slots.join(members.select("class_id", "m_rank", F.col(feat_col).alias("x_member")), ["class_id", "m_rank"])
    slots = slots.withColumn("lam", hash_beta(F.concat_ws(":", "class_id", "slot"), seed + 3, alpha))
    synth = slots.select(
        F.concat_ws(":", F.lit("syn"), "class_id", "slot").alias(id_col),
        F.zip_with("x_member", "x_donor", lambda a, b: F.col("lam") * a + (F.lit(1.0) - F.col("lam")) * b).alias(feat_col),
        F.col("class_id").alias(label_col), F.lit(True).alias("synthetic"), "lam")
    base = lb.select(F.col(id_col).cast("string").alias(id_col), feat_col, label_col, F.lit(False).alias("synthetic"),
                     F.lit(None).cast("double").alias("lam"))
    return base.unionByName(synth)
