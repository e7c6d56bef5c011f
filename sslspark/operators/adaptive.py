"""Stateful confidence policies (THR4-9, THR11, THR15, THR17).

Shape of every operator: rows ``(row_id, batch_id, probs[, logits])`` ->
per-batch aggregates (B x K) -> a recurrence from ``operators.state`` ->
a B-row state table with K-arrays -> joined back to rows on ``batch_id``.
The N-row side is never grouped by anything but batch / class with
map-side partial aggregation, and the joined state is B rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sslspark.functions.arrays import (
    align, argmax, confidence, cross_entropy_soft, element, log_softmax, logit_adjust, softmax, vec_lit,
)
from sslspark.operators.aggs import exact_quantile, mean_probs_by_batch
from sslspark.operators.split import rank_select
from sslspark.operators.state import (
    as_vector_per_batch, batch_class_grid, clamped_scan, dense_steps, ema, last_value, queue_mean, running_sum,
)
from sslspark.session import cut_lineage

__all__ = ["align_distribution", "flexmatch_mask", "freematch_mask", "softmatch_weight", "adamatch_mask",
           "dash_mask", "adsh_thresholds", "adsh_mask", "debiased_probs", "fairness_entropy"]


def _state_vec(long_state: DataFrame, batch_col: str, value_col: str, out: str) -> DataFrame:
    return as_vector_per_batch(long_state.select(batch_col, "class_id", value_col), batch_col, value_col, out)


def align_distribution(df: DataFrame, probs_col: str = "probs", batch_col: str = "batch_id", K: int = 10,
                       mode: str = "ema", target: str = "uniform", m: float = 0.999, L: int = 128,
                       p_target: Sequence[float] | None = None, lb: DataFrame | None = None,
                       lb_probs_col: str = "probs", out: str = "probs_aligned") -> DataFrame:
    """THR11: p * (p_target + 1e-6) / (p_model + 1e-6), renormalised.

    p_model per batch: ``mode='ema'`` (first batch sets, then blend with m;
    updated before aligning, T12) or ``mode='queue'`` (sum of the last L batch
    means / L, zeros before the queue fills, T11).  ``target``: 'uniform',
    'gt' (given ``p_target``) or 'model' (running mean of the labelled rows'
    probabilities ``lb``: EMA from uniform, or a queue)."""
    stats = mean_probs_by_batch(df, probs_col, batch_col, "x")
    if mode == "ema":
        pm = ema(stats, ["class_id"], batch_col, "x", m, None, "p_model")
    elif mode == "queue":
        pm = queue_mean(stats, ["class_id"], batch_col, "x", L, "p_model")
    else:
        raise ValueError(f"unknown alignment mode {mode!r}")
    state = _state_vec(pm, batch_col, "p_model", "_p_model")
    if target == "uniform":
        tgt = vec_lit([1.0 / K] * K)
    elif target == "gt":
        if p_target is None:
            raise ValueError("target='gt' needs p_target")
        tgt = vec_lit(p_target)
    elif target == "model":
        if lb is None:
            raise ValueError("target='model' needs the labelled rows (lb)")
        ls = mean_probs_by_batch(lb, lb_probs_col, batch_col, "x")
        if mode == "ema":
            pt = ema(ls, ["class_id"], batch_col, "x", m, 1.0 / K, "p_t")
        else:
            pt = queue_mean(ls, ["class_id"], batch_col, "x", L, "p_t")
        state = state.join(_state_vec(pt, batch_col, "p_t", "_p_target"), batch_col, "left")
        tgt = F.col("_p_target")
    else:
        raise ValueError(f"unknown alignment target {target!r}")
    j = df.join(state, batch_col, "left")
    return j.withColumn(out, align(probs_col, tgt, "_p_model")).drop("_p_model", "_p_target")


def flexmatch_mask(df: DataFrame, id_col: str = "row_id", batch_col: str = "batch_id", probs_col: str = "probs",
                   K: int = 10, tau: float = 0.95, n_ulb: int | Column | None = None, warmup: bool = True,
                   out: str = "mask") -> DataFrame:
    """THR4 (FlexMatch curriculum threshold).

    mask_t = conf >= tau * a_c / (2 - a_c) with a = classwise "accuracy" as of
    the *previous* batch (mask first, then update, T13).  Each id keeps its
    last label selected with conf >= tau (initially -1); a_c = count_c / max
    count (warm-up: -1 counts in the max; otherwise it does not); no update
    while a single value holds every id (T14).

    Batch mode: per-id ``lag`` over selected rows gives +1/-1 deltas per
    (batch, class); running sums over batches give the counts; the state of
    batch t-1 is joined to batch t.  ``n_ulb`` = size of the unlabelled set
    (number of ids); default: distinct ids of ``df``.
    """
    d = df.withColumns({"_conf": confidence(probs_col), "_pl": argmax(probs_col)})
    sel = d.filter(F.col("_conf") >= F.lit(tau)).select(id_col, batch_col, "_pl")
    prev = F.lag("_pl").over(Window.partitionBy(id_col).orderBy(batch_col))
    sel = sel.withColumn("_prev", prev)
    plus = sel.select(batch_col, F.col("_pl").alias("class_id"), F.lit(1).alias("_d"))
    minus = sel.filter(F.col("_prev").isNotNull()).select(batch_col, F.col("_prev").alias("class_id"),
                                                           F.lit(-1).alias("_d"))
    deltas = plus.unionByName(minus).groupBy(batch_col, "class_id").agg(F.sum("_d").alias("_d"))
    grid = batch_class_grid(d, batch_col, K)
    g = grid.join(deltas, [batch_col, "class_id"], "left").withColumn("_d", F.coalesce("_d", F.lit(0)))
    g = running_sum(g, ["class_id"], batch_col, "_d", "_cnt")
    n_ids = (d.select(F.countDistinct(id_col)).scalar() if n_ulb is None
             else (n_ulb if isinstance(n_ulb, Column) else F.lit(int(n_ulb))))
    wb = Window.partitionBy(batch_col)
    g = g.withColumn("_sel", F.sum("_cnt").over(wb)).withColumn("_maxc", F.max("_cnt").over(wb))
    g = g.withColumn("_neg", n_ids - F.col("_sel"))
    all_same = F.greatest("_maxc", "_neg") >= n_ids
    denom = F.greatest("_maxc", "_neg") if warmup else F.col("_maxc")
    g = g.withColumn("_acc_new", F.when(~all_same, F.col("_cnt") / denom))
    # carry the last updated value forward; before any update a_c = 0
    g = last_value(g, ["class_id"], batch_col, "_acc_new", 0.0, "_acc")
    # the state after a batch is used by the next batch that there is
    steps = dense_steps(d, batch_col)
    after = steps.select((F.col("_step") - 1).alias("_step"), F.col(batch_col).alias("_next"))
    g = g.join(steps.join(after, "_step").select(batch_col, "_next"), batch_col).withColumn(batch_col, F.col("_next"))
    st = _state_vec(g, batch_col, "_acc", "_cw")
    j = d.join(st, batch_col, "left").withColumn("_cw", F.coalesce("_cw", vec_lit([0.0] * K)))
    a_c = element("_cw", "_pl")
    return (j.withColumn("classwise_acc", a_c)
            .withColumn(out, (F.col("_conf") >= F.lit(tau) * a_c / (F.lit(2.0) - a_c)).cast("double"))
            .drop("_conf", "_pl", "_cw"))


def freematch_mask(df: DataFrame, batch_col: str = "batch_id", probs_col: str = "probs", K: int = 10,
                   m: float = 0.999, use_quantile: bool = False, clip: bool = False, out: str = "mask") -> DataFrame:
    """THR5 (FreeMatch self-adaptive threshold): update then mask (T13).

    time_p <- m*time_p + (1-m)*mean(conf) (or its 0.8-quantile); p_model <-
    EMA of mean probs; label_hist <- EMA of the normalised pseudo-label
    histogram; all start at 1/K.  mask = conf >= time_p * p_model[pl] / max(p_model).
    Also returns ``time_p``, ``p_model`` and ``label_hist`` per row's batch.
    ``clip`` keeps time_p in [0, 0.95] after every update.
    """
    d = df.withColumns({"_conf": confidence(probs_col), "_pl": argmax(probs_col)})
    # one pass over the rows gives all B x K statistics
    each = F.posexplode(probs_col).alias("class_id", "_p")
    grid = cut_lineage(d.select(batch_col, "_conf", "_pl", each).groupBy(batch_col, F.col("class_id").cast("int").alias("class_id")).agg(
        F.avg("_p").alias("x"), F.avg((F.col("_pl") == F.col("class_id")).cast("double")).alias("_h"), F.avg("_conf").alias("_x")))
    pm = ema(grid.select(batch_col, "class_id", "x"), ["class_id"], batch_col, "x", m, 1.0 / K, "p_model")
    lh = ema(grid.select(batch_col, "class_id", F.col("_h").alias("x")), ["class_id"], batch_col, "x", m, 1.0 / K, "label_hist")
    g = exact_quantile(d, "_conf", [batch_col], 0.8, "x") if use_quantile else grid.where("class_id = 0").select(batch_col, F.col("_x").alias("x"))
    g = g.withColumn("_k", F.lit(0))
    tp = (clamped_scan(g.withColumn("_b", F.lit(1.0 - m) * F.col("x")), ["_k"], batch_col, "_b", m, 0.0, 0.95, 1.0 / K, "time_p") if clip
          else ema(g, ["_k"], batch_col, "x", m, 1.0 / K, "time_p"))
    st = (_state_vec(pm, batch_col, "p_model", "p_model")
          .join(_state_vec(lh, batch_col, "label_hist", "label_hist"), batch_col)
          .join(tp.select(batch_col, "time_p"), batch_col))
    j = d.join(cut_lineage(st), batch_col, "left")
    mod = element("p_model", "_pl") / F.array_max("p_model")
    return (j.withColumn(out, (F.col("_conf") >= F.col("time_p") * mod).cast("double"))
            .drop("_conf", "_pl"))


def softmatch_weight(df: DataFrame, batch_col: str = "batch_id", probs_col: str = "probs", K: int = 10,
                     m: float = 0.999, n_sigma: float = 2.0, per_class: bool = False, out: str = "mask") -> DataFrame:
    """THR6 (SoftMatch truncated Gaussian weight), update then weight.

    mu, var: EMAs (m) of the batch mean and unbiased variance of conf, from
    1/K and 1.0; per class, a class with <= 1 row in a batch contributes
    (0, 1) for that batch (the reference's rule), and the per-class state
    starts at 1/K (T15).  weight = exp(-(min(conf - mu, 0))^2 / (2 var / n_sigma^2)).
    """
    d = df.withColumns({"_conf": confidence(probs_col), "_pl": argmax(probs_col)})
    if not per_class:
        s = d.groupBy(batch_col).agg(F.avg("_conf").alias("_mu"), F.var_samp("_conf").alias("_var"))
        s = s.withColumn("_k", F.lit(0))
        s = ema(s, ["_k"], batch_col, "_mu", m, 1.0 / K, "mu")
        s = ema(s, ["_k"], batch_col, "_var", m, 1.0, "var")
        j = d.join(s.select(batch_col, "mu", "var"), batch_col, "left")
        mu, var = F.col("mu"), F.col("var")
    else:
        s = d.groupBy(batch_col, F.col("_pl").alias("class_id")).agg(
            F.count(F.lit(1)).alias("_n"), F.avg("_conf").alias("_m0"), F.var_samp("_conf").alias("_v0"))
        g = batch_class_grid(d, batch_col, K).join(s, [batch_col, "class_id"], "left")
        big = F.coalesce(F.col("_n"), F.lit(0)) > 1
        g = g.withColumn("_mu", F.when(big, F.col("_m0")).otherwise(F.lit(0.0))) \
             .withColumn("_var", F.when(big, F.col("_v0")).otherwise(F.lit(1.0)))
        g = ema(g, ["class_id"], batch_col, "_mu", m, 1.0 / K, "mu")
        g = ema(g, ["class_id"], batch_col, "_var", m, 1.0, "var")
        st = _state_vec(g, batch_col, "mu", "_mu_v").join(_state_vec(g, batch_col, "var", "_var_v"), batch_col)
        j = d.join(st, batch_col, "left")
        mu, var = element("_mu_v", "_pl"), element("_var_v", "_pl")
        j = j.withColumn("mu", mu).withColumn("var", var).drop("_mu_v", "_var_v")
        mu, var = F.col("mu"), F.col("var")
    diff = F.least(F.col("_conf") - mu, F.lit(0.0))
    w = F.exp(-(diff * diff) / (F.lit(2.0) * var / F.lit(float(n_sigma) ** 2)))
    return j.withColumn(out, w).drop("_conf", "_pl")


def adamatch_mask(ulb: DataFrame, lb: DataFrame, batch_col: str = "batch_id", probs_col: str = "probs",
                  tau: float = 0.95, out: str = "mask") -> DataFrame:
    """THR7 (AdaMatch): cut-off = tau * mean max-prob of the labelled rows of
    the same batch; mask = conf >= cut-off."""
    cut = lb.groupBy(batch_col).agg((F.lit(tau) * F.avg(confidence(probs_col))).alias("cutoff"))
    j = ulb.join(cut, batch_col, "left")
    return j.withColumn(out, (confidence(probs_col) >= F.col("cutoff")).cast("double"))


def dash_mask(df: DataFrame, rho0: Column, batch_col: str = "batch_id", logits_col: str = "logits",
              T: float = 0.5, C: float = 1.0001, gamma: float = 1.27, rho_min: float = 0.05,
              period: int = 1, out: str = "mask") -> DataFrame:
    """THR8 (Dash): rho_t = max(C * gamma^-k * rho0, rho_min), k = t // period
    updates so far; hard pseudo-labels once rho reached the floor, else
    softmax(logits / T); keep rows whose CE to their pseudo-label <= rho_t.
    ``rho0``: the labelled loss (a scalar Column, e.g. a scalar subquery of AGG8)."""
    k = F.floor(F.col(batch_col) / F.lit(period))
    rho = F.greatest(F.lit(float(C)) * F.pow(F.lit(float(gamma)), -k) * rho0, F.lit(float(rho_min)))
    d = df.withColumn("rho", rho)
    hard = F.col("rho") == F.lit(float(rho_min))
    lsm = log_softmax(logits_col)
    ce_hard = -element(lsm, argmax(logits_col))
    ce_soft = cross_entropy_soft(logits_col, softmax(logits_col, T))
    loss = F.when(hard, ce_hard).otherwise(ce_soft)
    return d.withColumn("pl_loss", loss).withColumn(out, (F.col("pl_loss") <= F.col("rho")).cast("double"))


def adsh_thresholds(df: DataFrame, probs_col: str = "probs", id_col: str = "row_id", K: int = 10,
                    tau: float = 0.95) -> DataFrame:
    """WIN12: per class the confidence at rank int(n_c * rho) (rank 0 = the
    last row, T18), rho = (#head-class rows >= tau - 1) / n_head, or 1.0 when
    none reaches tau.  Classes without rows keep threshold exp(-tau).

    Ranks come from the bucketed exact ``rank_select`` (no class in one task).
    """
    d = df.select(id_col, confidence(probs_col).alias("conf"), argmax(probs_col).alias("pl"))
    head = d.filter(F.col("pl") == 0).agg(F.count(F.lit(1)).alias("n0"),
                                           F.count_if(F.col("conf") >= F.lit(tau)).alias("hi"))
    rho = head.select(F.when(F.col("hi") >= 1, (F.col("hi") - 1) / F.col("n0")).otherwise(F.lit(1.0))).scalar()

    def quota(n: Column) -> Column:
        rr = F.floor(n.cast("double") * rho).cast("long")
        return F.when(rr == 0, n).otherwise(rr)

    sel = rank_select(d, ["pl"], id_col, 0, {"_top": quota}, score=F.col("conf"))
    th = sel.filter("_top").groupBy("pl").agg(F.min("conf").alias("threshold"))
    cls = batch_class_grid(d.select(F.lit(0).alias("_b")), "_b", K).select(F.col("class_id").alias("pl"))
    return (cls.join(th, "pl", "left")
            .select(F.col("pl").alias("class_id"),
                    F.coalesce("threshold", F.exp(F.lit(-float(tau)))).alias("threshold")))


def adsh_mask(df: DataFrame, thresholds: DataFrame, probs_col: str = "probs", out: str = "mask") -> DataFrame:
    """THR9: mask = conf >= threshold[pl] (K-row table, broadcast)."""
    d = df.withColumn("_pl", argmax(probs_col))
    j = d.join(F.broadcast(thresholds.withColumnRenamed("class_id", "_pl")), "_pl", "left")
    return j.withColumn(out, (confidence(probs_col) >= F.col("threshold")).cast("double")).drop("_pl")


def debiased_probs(df: DataFrame, batch_col: str = "batch_id", logits_col: str = "logits", K: int = 10,
                   tau: float = 0.4, m: float = 0.999, out: str = "probs_debiased") -> DataFrame:
    """THR15 (DebiasPL): running prior p_hat (EMA with one momentum m from
    1/K, current batch included, T16), probs = softmax(logits - tau * log p_hat)."""
    d = df.withColumn("_p", softmax(logits_col))
    ph = ema(mean_probs_by_batch(d, "_p", batch_col, "x"), ["class_id"], batch_col, "x", m, 1.0 / K, "p_hat")
    st = _state_vec(ph, batch_col, "p_hat", "p_hat")
    j = d.join(st, batch_col, "left")
    return j.withColumn(out, softmax(logit_adjust(logits_col, "p_hat", tau, -1))).drop("_p")


def fairness_entropy(df: DataFrame, batch_col: str = "batch_id", probs_s_col: str = "probs_s",
                     mask_col: str = "mask", p_model_col: str = "p_model", label_hist_col: str = "label_hist",
                     K: int = 10) -> DataFrame:
    """THR17 (FreeMatch fairness term) per batch over the masked rows.

    hist_s = normalised histogram of the strong-view argmax; mod_model =
    p_model / label_hist, normalised; mod_mean = mean strong probs / hist_s,
    normalised (1/0 -> 0 in both); loss = sum(mod_model * log(mod_mean + 1e-12)).
    Batches without masked rows yield no row.
    """
    d = df.filter(F.col(mask_col) > 0)
    # one pass over the masked rows: B x K sums with the batch's state beside them
    rows = d.select(batch_col, argmax(probs_s_col).alias("_pl"), F.posexplode(F.arrays_zip(
        F.col(probs_s_col).alias("p"), F.col(p_model_col).alias("m"), F.col(label_hist_col).alias("h"))).alias("class_id", "_z"))
    g = cut_lineage(rows.groupBy(batch_col, F.col("class_id").cast("int").alias("class_id")).agg(
        F.avg("_z.p").alias("_mp"), F.sum((F.col("_pl") == F.col("class_id")).cast("long")).alias("_c"), F.count(F.lit(1)).alias("_n"),
        F.first("_z.m").alias("_pm"), F.first("_z.h").alias("_lh")))
    wb = Window.partitionBy(batch_col)
    inv = lambda c: F.when(c == 0, F.lit(0.0)).otherwise(F.lit(1.0) / c)
    g = g.withColumn("_hs", F.col("_c") / F.col("_n"))
    g = g.withColumn("_mm", F.col("_pm") * inv(F.col("_lh"))).withColumn("_mm", F.col("_mm") / F.sum("_mm").over(wb))
    g = g.withColumn("_ms", F.col("_mp") * inv(F.col("_hs"))).withColumn("_ms", F.col("_ms") / F.sum("_ms").over(wb))
    return g.groupBy(batch_col).agg(F.sum(F.col("_mm") * F.log(F.col("_ms") + F.lit(1e-12))).alias("ent_loss"))
