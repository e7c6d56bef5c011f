"""Policy registry (UDF1-3): name -> (parameters, DataFrame -> DataFrame).

Every policy takes a scored frame ``(row_id, batch_id, probs[, logits])`` of
unlabelled rows and adds ``mask`` (and ``pseudo`` where it makes one), or its
loss; those in ``WITH_LABELLED`` also take the labelled rows.
Unknown names raise KeyError.  Imbalance policies wrap a base policy by
function composition ``df.transform(base).transform(imb)``, with the
reference's compatibility limits.

Defaults below are FIXED VALUES carried over from the reference's policies.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sslspark.constants import UNLABELLED
from sslspark.functions.arrays import (argmax, average_views, consistency_loss, cosine_repulsion, cross_entropy_hard, entropy, kl_from_logits,
                                       mtl_weighted_loss, one_hot, ramp, sharpen)
from sslspark.operators import adaptive, aggs, imbalance, metrics, policies, similarity

__all__ = ["POLICIES", "IMBALANCE", "get_policy", "apply_policy", "compose"]


@dataclass(frozen=True)
class FixMatchParams:
    T: float = 0.5
    p_cutoff: float = 0.95
    hard_label: bool = True


@dataclass(frozen=True)
class FlexMatchParams:
    T: float = 0.5
    p_cutoff: float = 0.95
    thresh_warmup: bool = True
    num_classes: int = 10


@dataclass(frozen=True)
class FreeMatchParams:
    T: float = 0.5
    ema_p: float = 0.999
    ent_loss_ratio: float = 0.01
    use_quantile: bool = False
    clip_thresh: bool = False
    num_classes: int = 10


@dataclass(frozen=True)
class CoMatchParams:
    T: float = 0.2
    p_cutoff: float = 0.95
    smoothing_alpha: float = 0.9
    da_len: int = 256
    queue_rows: int = 2560
    warm_batches: int = 0
    num_classes: int = 10


@dataclass(frozen=True)
class SoftMatchParams:
    T: float = 0.5
    ema_p: float = 0.999
    n_sigma: float = 2.0
    per_class: bool = False
    num_classes: int = 10


@dataclass(frozen=True)
class UDAParams:
    T: float = 0.4
    p_cutoff: float = 0.8


@dataclass(frozen=True)
class PseudoLabelParams:
    p_cutoff: float = 0.95


@dataclass(frozen=True)
class DashParams:
    T: float = 0.5
    gamma: float = 1.27
    C: float = 1.0001
    rho_min: float = 0.05
    period: int = 1


@dataclass(frozen=True)
class AdaMatchParams:
    p_cutoff: float = 0.95
    ema_p: float = 0.999
    hard_label: bool = True
    num_classes: int = 10


@dataclass(frozen=True)
class TwoViewParams:
    ramp_len: float = 1.0


@dataclass(frozen=True)
class VATParams:
    ramp_len: float = 1.0
    ent_weight: float = 0.06


@dataclass(frozen=True)
class MixMatchParams:
    T: float = 0.5


@dataclass(frozen=True)
class MultiTaskParams:
    T: float = 0.5
    p_cutoff: float = 0.95
    hard_label: bool = True
    unlabelled_id: int = UNLABELLED


@dataclass(frozen=True)
class NoParams:
    pass


@dataclass(frozen=True)
class ABCParams:
    p_cutoff: float = 0.95
    num_classes: int = 10
    seed: int = 13


@dataclass(frozen=True)
class ADSHParams:
    tau: float = 0.95
    num_classes: int = 10


@dataclass(frozen=True)
class SAWParams:
    num_classes: int = 10


@dataclass(frozen=True)
class CReSTParams:
    alpha: float = 3.0
    num_classes: int = 10


@dataclass(frozen=True)
class DebiasPLParams:
    tau: float = 0.4
    ema_p: float = 0.999
    num_classes: int = 10


def _fixmatch(df: DataFrame, p: FixMatchParams) -> DataFrame:
    # soft targets are the probabilities as they are; T only sharpens logits
    d = policies.pseudo_label(df, mode="hard" if p.hard_label else "soft", T=1.0)
    return policies.fixed_threshold(d, tau=p.p_cutoff)


def _flexmatch(df: DataFrame, p: FlexMatchParams) -> DataFrame:
    d = adaptive.flexmatch_mask(df, K=p.num_classes, tau=p.p_cutoff, warmup=p.thresh_warmup)
    return policies.pseudo_label(d, mode="hard")


def _freematch(df: DataFrame, p: FreeMatchParams) -> DataFrame:
    d = adaptive.freematch_mask(df, K=p.num_classes, m=p.ema_p, use_quantile=p.use_quantile, clip=p.clip_thresh)
    return policies.pseudo_label(d, mode="hard")


def _comatch(df: DataFrame, p: CoMatchParams, labelled: DataFrame) -> DataFrame:
    """Alignment with the queue, smoothing by the bank as it was before the row's
    batch (aligned unlabelled and one-hot labelled rows), then mask and soft
    pseudo-label.  ``feat`` is the unit-length feature; batches below
    ``warm_batches`` are not smoothed."""
    d = adaptive.align_distribution(df, K=p.num_classes, mode="queue", target="uniform", L=p.da_len, out="_p")
    bank = d.select("row_id", "batch_id", "feat", F.col("_p").alias("bp")).unionByName(
        labelled.select("row_id", "batch_id", "feat", one_hot("label_id", p.num_classes).alias("bp")))
    d = similarity.smooth_with_bank(d, bank, p.queue_rows, p.num_classes, p.T, p.smoothing_alpha, probs_col="_p", out="_q")
    d = d.withColumn("probs", F.when(F.col("batch_id") >= p.warm_batches, F.col("_q")).otherwise(F.col("_p"))).drop("_p", "_q")
    return policies.pseudo_label(policies.fixed_threshold(d, tau=p.p_cutoff), mode="soft", T=1.0)


def _softmatch(df: DataFrame, p: SoftMatchParams) -> DataFrame:
    a = adaptive.align_distribution(df, K=p.num_classes, m=p.ema_p, out="_aligned")
    d = adaptive.softmatch_weight(a, probs_col="_aligned", K=p.num_classes, m=p.ema_p, n_sigma=p.n_sigma,
                                  per_class=p.per_class)
    # pseudo-label from the unaligned probabilities (as the reference does)
    return policies.pseudo_label(d.drop("_aligned"), mode="hard")


def _uda(df: DataFrame, p: UDAParams) -> DataFrame:
    d = policies.fixed_threshold(df, tau=p.p_cutoff)
    return policies.pseudo_label(d, mode="soft", T=1.0)  # probabilities are not sharpened again


def _pseudolabel(df: DataFrame, p: PseudoLabelParams) -> DataFrame:
    return policies.pseudo_label(policies.fixed_threshold(df, tau=p.p_cutoff), mode="hard")


def _dash(df: DataFrame, p: DashParams, labelled: DataFrame) -> DataFrame:
    rho0 = metrics.eval_loss(labelled, "logits", "label_id").scalar()
    d = adaptive.dash_mask(df, rho0, T=p.T, C=p.C, gamma=p.gamma, rho_min=p.rho_min, period=p.period)
    return policies.pseudo_label(d, mode="hard")


def _adamatch(df: DataFrame, p: AdaMatchParams, labelled: DataFrame) -> DataFrame:
    a = adaptive.align_distribution(df, K=p.num_classes, m=p.ema_p, target="model", lb=labelled, out="_aligned")
    d = adaptive.adamatch_mask(a, labelled.withColumnRenamed("probs", "_aligned"), probs_col="_aligned", tau=p.p_cutoff)
    return policies.pseudo_label(d, probs_col="_aligned", mode="hard" if p.hard_label else "soft").drop("_aligned")


def _two_views(df: DataFrame, p: TwoViewParams) -> DataFrame:
    """Mean squared difference to the other view (Pi model) or the teacher's
    probabilities (mean teacher), in ``probs``; the student's in ``logits_s``."""
    return df.withColumns({"unsup_loss": consistency_loss("logits_s", "probs", "mse"), "unsup_weight": ramp(F.col("batch_id"), p.ramp_len)})


def _vat(df: DataFrame, p: VATParams) -> DataFrame:
    return df.withColumns({"unsup_loss": kl_from_logits("logits", "logits_s"), "ent_loss": F.lit(p.ent_weight) * entropy("probs"),
                           "unsup_weight": ramp(F.col("batch_id"), p.ramp_len)})


def _mixmatch(df: DataFrame, p: MixMatchParams) -> DataFrame:
    return df.withColumn("pseudo", sharpen(average_views("probs", "probs_s"), p.T))


def _crmatch(df: DataFrame, p: FixMatchParams) -> DataFrame:
    """FixMatch with the strong view's loss, and the repulsion of the two views'
    descriptors ``ds`` (weak) and ``ds_s`` (strong); the rotation head is not built."""
    d = _fixmatch(df, p)
    return d.withColumns({"unsup_loss": consistency_loss("logits_s", "pseudo", "ce", mask="mask", hard=p.hard_label),
                          "repulsion_loss": cosine_repulsion("ds_s", "ds", "mask")})


def _defixmatch(df: DataFrame, p: FixMatchParams, labelled: DataFrame) -> DataFrame:
    """Labelled rows go through the same mask with weight -1, which takes the bias out."""
    both = df.withColumn("weight", F.lit(1.0)).unionByName(labelled.withColumn("weight", F.lit(-1.0)))
    return _fixmatch(both, p)


def _fullysupervised(df: DataFrame, p: NoParams) -> DataFrame:
    return df.withColumn("sup_loss", cross_entropy_hard("logits", "label_id"))


def _mtl_fullysupervised(df: DataFrame, p: NoParams) -> DataFrame:
    return df.withColumn("sup_loss", mtl_weighted_loss(cross_entropy_hard("logits", "label_id"), cross_entropy_hard("logits_rel", "relation_id")))


def _mtl_fixmatch(df: DataFrame, p: MultiTaskParams) -> DataFrame:
    """Only rows without a label for the task are masked and pseudo-labelled."""
    rows = df.filter(F.col("label_id") == F.lit(p.unlabelled_id))
    return _fixmatch(rows, FixMatchParams(T=p.T, p_cutoff=p.p_cutoff, hard_label=p.hard_label))


def _mtl_vat(df: DataFrame, p: VATParams) -> DataFrame:
    return _vat(df.filter(F.col("label_id") == F.lit(UNLABELLED)), p)


POLICIES: dict[str, tuple[type, Callable]] = {
    "fixmatch": (FixMatchParams, _fixmatch),
    "flexmatch": (FlexMatchParams, _flexmatch),
    "freematch": (FreeMatchParams, _freematch),
    "softmatch": (SoftMatchParams, _softmatch),
    "uda": (UDAParams, _uda),
    "pseudolabel": (PseudoLabelParams, _pseudolabel),
    "dash": (DashParams, _dash),
    "adamatch": (AdaMatchParams, _adamatch),
    "pimodel": (TwoViewParams, _two_views),
    "meanteacher": (TwoViewParams, _two_views),
    "vat": (VATParams, _vat),
    "mixmatch": (MixMatchParams, _mixmatch),
    "defixmatch": (FixMatchParams, _defixmatch),
    "crmatch": (FixMatchParams, _crmatch),
    "comatch": (CoMatchParams, _comatch),
    "fullysupervised": (NoParams, _fullysupervised),
    "mtl_fullysupervised": (NoParams, _mtl_fullysupervised),
    "mtl_fixmatch": (MultiTaskParams, _mtl_fixmatch),
    "mtl_vat": (VATParams, _mtl_vat),
}

#: Policies that also look at the labelled rows.
WITH_LABELLED = frozenset({"dash", "adamatch", "defixmatch", "comatch"})


def _debiaspl(df: DataFrame, p: DebiasPLParams) -> DataFrame:
    d = adaptive.debiased_probs(df, K=p.num_classes, tau=p.tau, m=p.ema_p, out="_deb")
    return d.withColumn("probs", F.col("_deb")).drop("_deb")


def _abc(df: DataFrame, p: ABCParams, labelled: DataFrame) -> DataFrame:
    counts = aggs.class_counts(labelled, "label_id", p.num_classes).withColumn("n", F.greatest("n", F.lit(1)))
    keep = aggs.min_over_count(counts).select(F.col("label_id").alias("_pl"), F.col("keep_p").alias("_keep"))
    d = df.withColumn("_pl", argmax("probs")).join(F.broadcast(keep), "_pl")  # K rows
    return policies.abc_mask(d, "probs", "_keep", "row_id", p.seed, tau=p.p_cutoff, out="mask_abc").drop("_pl", "_keep")


def _adsh(df: DataFrame, p: ADSHParams) -> DataFrame:
    d = adaptive.adsh_mask(df, adaptive.adsh_thresholds(df, K=p.num_classes, tau=p.tau), out="mask_adsh")
    return d.drop("threshold")


def _saw(df: DataFrame, p: SAWParams) -> DataFrame:
    d = df.withColumn("_pl", argmax("probs"))
    counts = aggs.class_counts(d, "_pl", p.num_classes).withColumn("n", F.greatest("n", F.lit(1)))
    weights = aggs.refresh_weights_from_pseudo_labels(counts).select("_pl", "weight")
    return d.join(F.broadcast(weights), "_pl").drop("_pl")  # K rows


def _crest(df: DataFrame, p: CReSTParams, labelled: DataFrame) -> DataFrame:
    r = (aggs.class_counts(labelled, "label_id", p.num_classes)
         .agg(F.max(F.greatest("n", F.lit(1))).alias("mx"), F.min(F.greatest("n", F.lit(1))).alias("mn")).first())  # two numbers
    return imbalance.top_confident_per_class(df, imbalance.crest_quota(p.num_classes, r["mx"] / r["mn"], p.alpha))


IMBALANCE: dict[str, tuple[type, Callable, frozenset | None, frozenset]] = {
    # name: (params, fn, allowed bases (None = any), refused bases)
    "debiaspl": (DebiasPLParams, _debiaspl, None, frozenset({"mixmatch", "meanteacher", "pimodel"})),
    "abc": (ABCParams, _abc, None, frozenset()),
    "adsh": (ADSHParams, _adsh, frozenset({"fixmatch"}), frozenset()),
    "saw": (SAWParams, _saw, None, frozenset()),
    "crest": (CReSTParams, _crest, None, frozenset()),
}


IMB_WITH_LABELLED = frozenset({"abc", "crest"})


def get_policy(name: str):
    if name not in POLICIES:
        raise KeyError(f"unknown policy {name!r}")
    return POLICIES[name]


def _params(cls, overrides: dict):
    known = {f.name for f in fields(cls)}
    bad = set(overrides) - known
    if bad:
        raise TypeError(f"unknown parameters for {cls.__name__}: {sorted(bad)}")
    return replace(cls(), **overrides)


def _run(name: str, fn: Callable, needs: frozenset, df: DataFrame, params, labelled: DataFrame | None) -> DataFrame:
    if name not in needs:
        return fn(df, params)
    if labelled is None:
        raise ValueError(f"{name} needs the labelled rows")
    return fn(df, params, labelled)


def apply_policy(df: DataFrame, name: str, labelled: DataFrame | None = None, **overrides) -> DataFrame:
    cls, fn = get_policy(name)
    return _run(name, fn, WITH_LABELLED, df, _params(cls, overrides), labelled)


def compose(imb: str, base: str, imb_params: dict | None = None, base_params: dict | None = None, labelled: DataFrame | None = None):
    """UDF3: an imbalance policy over a base policy (imbalance step first,
    e.g. DebiasPL adjusts the probabilities the base policy then masks)."""
    if imb not in IMBALANCE:
        raise KeyError(f"unknown imbalance policy {imb!r}")
    cls, fn, allowed, refused = IMBALANCE[imb]
    if (allowed is not None and base not in allowed) or base in refused:
        raise ValueError(f"{imb} does not support {base} as the base policy")
    bcls, bfn = get_policy(base)
    ip, bp = _params(cls, imb_params or {}), _params(bcls, base_params or {})
    return lambda df: _run(base, bfn, WITH_LABELLED, _run(imb, fn, IMB_WITH_LABELLED, df, ip, labelled), bp, labelled)
