"""Row-level probability / logit math as pure Column expressions (FN1-23, TOP1).

Arrays are fixed-length ``ARRAY<DOUBLE>`` of K class scores.  Everything is a
Spark higher-order function (``transform``, ``zip_with``, ``aggregate``), so it
runs inside the JVM with no Python per row and no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sslspark.functions.keys import hash_beta

__all__ = [
    "let", "col_of", "asum", "dot", "l2_norm", "l2_normalise", "cosine", "softmax", "log_softmax",
    "confidence", "argmax", "sharpen", "average_views", "one_hot", "smooth_label", "align",
    "progressive_target", "logit_adjust", "cross_entropy_hard", "cross_entropy_soft",
    "consistency_loss", "entropy", "kl_from_logits", "tempered_kl", "mse", "mixup",
    "tsa_threshold", "ramp", "dash_rho", "mtl_weighted_loss", "cosine_repulsion",
    "class_temper", "scale_array", "vec_lit", "element", "to_double_array",
]


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, body) -> Column:
    """Bind ``value`` once and use it several times in ``body(v)``.

    ``element_at(transform(array(value), v -> body(v)), 1)``: the value is
    evaluated once per row.  Without it, a helper that reads its input
    twice inside a lambda would recompute the whole upstream expression per
    array element (Catalyst inlines single-reference projections).
    """
    return F.element_at(F.transform(F.array(col_of(value)), body), 1)


def to_double_array(c) -> Column:
    return F.transform(col_of(c), lambda x: x.cast("double"))


def asum(arr) -> Column:
    """Sum of a numeric array."""
    return F.aggregate(col_of(arr), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return asum(F.zip_with(col_of(a), col_of(b), lambda x, y: x * y))


def l2_norm(a) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a, eps: float = 1e-12) -> Column:
    """FN14: x / max(||x||, eps) (torch ``F.normalize`` convention)."""
    return let(a, lambda v: let(F.greatest(l2_norm(v), F.lit(eps)),
                                lambda n: F.transform(v, lambda x: x / n)))


def cosine(a, b) -> Column:
    """FN14: cosine similarity of two vectors."""
    return let(a, lambda x: let(b, lambda y: dot(x, y) / (l2_norm(x) * l2_norm(y))))


def scale_array(a, s) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(col_of(a), lambda x: x * s)


def vec_lit(values) -> Column:
    """A small K-vector as a literal array (K is a class count, bounded)."""
    return F.array(*[F.lit(float(v)) for v in values])


def element(arr, idx) -> Column:
    """0-based element access."""
    if isinstance(idx, str):
        idx = F.col(idx)
    elif not isinstance(idx, Column):
        idx = F.lit(int(idx))
    return F.element_at(col_of(arr), (idx + 1).cast("int"))


def softmax(logits, T: float | Column = 1.0) -> Column:
    """FN1: softmax(logits / T), max-shifted for stability."""
    t = T if isinstance(T, Column) else F.lit(float(T))
    return let(logits, lambda lg: _div_by_sum(_exp_shift(lg, t)))


def _exp_shift(lg: Column, t: Column) -> Column:
    return let(F.array_max(lg), lambda m: F.transform(lg, lambda x: F.exp((x - m) / t)))


def _div_by_sum(e: Column) -> Column:
    return let(asum(e), lambda s: F.transform(e, lambda x: x / s))


def log_softmax(logits, T: float = 1.0) -> Column:
    """FN2: log softmax(logits / T)."""
    t = F.lit(float(T))
    return let(logits, lambda lg: let(F.array_max(lg), lambda m: let(
        F.log(asum(F.transform(lg, lambda x: F.exp((x - m) / t)))),
        lambda lse: F.transform(lg, lambda x: (x - m) / t - lse))))


def confidence(probs) -> Column:
    """TOP1: max probability."""
    return F.array_max(col_of(probs))


def argmax(probs) -> Column:
    """TOP1: index of the max; ties resolve to the first index (trap T19)."""
    return let(probs, lambda p: (F.array_position(p, F.array_max(p)) - 1).cast("int"))


def sharpen(probs, T: float) -> Column:
    """FN3: p^(1/T) normalised."""
    return _div_by_sum(F.transform(col_of(probs), lambda x: F.pow(x, F.lit(1.0 / T))))


def average_views(p1, p2) -> Column:
    """FN4: element-wise mean of two probability arrays."""
    return F.zip_with(col_of(p1), col_of(p2), lambda x, y: (x + y) / 2.0)


def one_hot(label, K: int) -> Column:
    """PRJ14: label -> K-vector target."""
    classes = F.sequence(F.lit(0), F.lit(K - 1))
    return let(col_of(label), lambda lab: F.transform(classes, lambda i: (i == lab).cast("double")))


def smooth_label(label, K: int, eps: float) -> Column:
    """FN5: 1-eps on the class, eps/(K-1) elsewhere."""
    classes = F.sequence(F.lit(0), F.lit(K - 1))
    return let(col_of(label), lambda lab: F.transform(
        classes, lambda i: F.when(i == lab, F.lit(1.0 - eps)).otherwise(F.lit(eps / (K - 1)))))


def align(probs, target, model, eps: float = 1e-6) -> Column:
    """FN6: p * (t + eps) / (m + eps), renormalised."""
    q = F.zip_with(F.zip_with(col_of(probs), col_of(target), lambda p, t: p * (t + eps)),
                   col_of(model), lambda x, m: x / (m + eps))
    return _div_by_sum(q)


def progressive_target(dist, tau) -> Column:
    """FN7: t^tau normalised."""
    t = tau if isinstance(tau, Column) else F.lit(float(tau))
    return _div_by_sum(F.transform(col_of(dist), lambda x: F.pow(x, t)))


def logit_adjust(logits, prior, tau: float, sign: int = -1) -> Column:
    """FN8: logits + sign * tau * log(prior)."""
    return F.zip_with(col_of(logits), col_of(prior),
                      lambda x, p: x + F.lit(float(sign * tau)) * F.log(p))


def cross_entropy_hard(logits, label) -> Column:
    """FN9: -log_softmax(logits)[label]."""
    return -element(log_softmax(logits), col_of(label))


def cross_entropy_soft(logits, target) -> Column:
    """FN9: -sum(target * log_softmax(logits))."""
    return -dot(col_of(target), log_softmax(logits))


def mse(a, b) -> Column:
    """Mean squared difference of two arrays (over K)."""
    return let(a, lambda av: asum(F.zip_with(av, col_of(b), lambda x, y: (x - y) * (x - y))) / F.size(av))


def consistency_loss(logits, target, name: str = "ce", mask=None, hard: bool = True) -> Column:
    """FN10 per row: CE (hard label or soft target) or MSE of probabilities, times mask.

    The reference averages this over *all* rows of the batch (masked rows count as 0).
    """
    if name == "ce":
        loss = cross_entropy_hard(logits, target) if hard else cross_entropy_soft(logits, target)
    elif name == "mse":
        loss = mse(softmax(logits), target)
    else:
        raise ValueError(f"unknown consistency loss {name!r}")
    return loss * col_of(mask) if mask is not None else loss


def entropy(probs) -> Column:
    """FN11: -sum p log p (0 log 0 = 0)."""
    return -asum(F.transform(col_of(probs), lambda p: F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0))))


def kl_from_logits(q_logits, p_logits) -> Column:
    """FN12: KL(softmax(q) || softmax(p)) = sum q (log q - log p)."""
    return let(q_logits, lambda ql: let(softmax(ql), lambda q: asum(F.zip_with(
        q, F.zip_with(log_softmax(ql), log_softmax(p_logits), lambda a, b: a - b), lambda x, y: x * y))))


def tempered_kl(student_logits, teacher_logits, T: float = 1.0, mask=None) -> Column:
    """FN13 per row: -sum softmax(teacher/2T) * log_softmax(student/T) * T^2 * mask."""
    q = softmax(teacher_logits, 2.0 * T)
    loss = -dot(q, log_softmax(student_logits, T)) * F.lit(T * T)
    return loss * col_of(mask) if mask is not None else loss


def mixup(a, b, lam) -> Column:
    """FN15: lam * a + (1 - lam) * b, element-wise."""
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    return F.zip_with(col_of(a), col_of(b), lambda x, y: lam * x + (1 - lam) * y)


def mixup_beta(a, b, id_col, seed, alpha: float) -> Column:
    """FN15 with its draw: lam ~ Beta(alpha, alpha), the larger of lam and
    1 - lam, so that ``a`` weighs more; alpha 0 keeps ``a``."""
    if alpha == 0:
        return col_of(a)
    lam = hash_beta(id_col, seed, alpha)
    return let(F.greatest(lam, 1 - lam), lambda l: mixup(a, b, l))


def tsa_threshold(schedule: str, progress, K: int) -> Column:
    """FN17: training-signal-annealing threshold for progress t/T in [0,1]."""
    t = progress if isinstance(progress, Column) else F.lit(float(progress))
    if schedule == "none":
        return F.lit(1.0)
    if schedule == "linear":
        th = t
    elif schedule == "exp":
        th = F.exp((t - 1) * 5)
    elif schedule == "log":
        th = 1 - F.exp(-t * 5)
    else:
        raise ValueError(f"unknown TSA schedule {schedule!r}")
    return th * (1 - 1.0 / K) + 1.0 / K


def ramp(step, ramp_len) -> Column:
    """FN18: clip(step / ramp_len, 0, 1)."""
    s = step if isinstance(step, Column) else F.lit(float(step))
    return F.least(F.greatest(s / F.lit(float(ramp_len)), F.lit(0.0)), F.lit(1.0))


def dash_rho(C: float, gamma: float, k, rho0, rho_min: float) -> Column:
    """FN19: max(C * gamma^-k * rho0, rho_min)."""
    k = k if isinstance(k, Column) else F.lit(float(k))
    rho0 = rho0 if isinstance(rho0, Column) else F.lit(float(rho0))
    return F.greatest(F.lit(float(C)) * F.pow(F.lit(float(gamma)), -k) * rho0, F.lit(float(rho_min)))


def mtl_weighted_loss(task_loss, relation_loss, w_task: float = 1.0, w_rel: float = 0.5) -> Column:
    """FN20: 1 * CE(task) + 0.5 * CE(relation)."""
    return F.lit(w_task) * col_of(task_loss) + F.lit(w_rel) * col_of(relation_loss)


def cosine_repulsion(s, w, mask=None) -> Column:
    """FN21: max(0, cos(s, w)) * mask."""
    v = F.greatest(cosine(s, w), F.lit(0.0))
    return v * col_of(mask) if mask is not None else v


def class_temper(prior_ratio, tro: float = 1.0, A: float = 2.0, B: float = 2.0):
    """FN23 on a K-vector of min/n_c ratios: returns (la, T_logit).

    la = log(ratio^tro + 1e-12); T_logit = A * softmax(-la) + B.
    """
    la = F.transform(col_of(prior_ratio), lambda r: F.log(F.pow(r, F.lit(float(tro))) + F.lit(1e-12)))
    neg = F.transform(la, lambda x: -x)
    t_logit = F.transform(softmax(neg), lambda x: F.lit(float(A)) * x + F.lit(float(B)))
    return la, t_logit
