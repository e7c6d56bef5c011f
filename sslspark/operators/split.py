"""Splits, per-class quotas, sampling and set operations (WIN1-8, SMP1-5, SET1-5).

Randomness is ``md5(id:seed)`` (see ``functions.keys``): deterministic,
partitioning-independent and reproducible in SQL.

Scale note.  A per-group ``row_number`` over a hash puts a whole group in
one task; strata and head classes can hold a third of all rows.
``rank_select`` gives the *same exact* ranks without that: it histograms the
first 16 bits of the hash per group (partial aggregate, <= 65536 x groups
rows), turns it into "rows before this bucket" with a running sum, and ranks
rows only inside their (group, bucket) partition (~ N / 65536 rows each).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sslspark.functions.keys import hash_key, hash_u, hash_u52
from sslspark.session import cut_lineage

__all__ = [
    "rank_select", "stratified_test_split", "sample_labelled_unlabelled", "split_ssl", "imbalance_profile",
    "imbalance_counts", "ordered_split_per_class", "fraction_per_class", "first_n_per_class",
    "resample_uniform", "resample_weighted", "class_balanced_weights", "bernoulli_keep",
    "include_labelled_in_unlabelled", "append_unlabelled", "augment_labelled_with_pseudo",
    "full_supervised_pool", "distinct_values", "bround_quota",
]

QuotaFn = Callable[[Column], Column]   # group size n -> quota (may use group columns)


def bround_quota(frac: float) -> QuotaFn:
    """Python ``round(frac * n)`` (banker's rounding) — pandas' per-stratum sample size (T9)."""
    return lambda n: F.bround(F.lit(float(frac)) * n.cast("double"), 0).cast("long")


def score_bucket(score: Column) -> Column:
    """Ascending bucket (below 65536) for a descending order on a [0, 1] score,
    log-spread towards both ends."""
    x = F.lit(1.0) - score
    high = F.when(x <= 0, F.lit(0)).otherwise(F.lit(1) + F.floor((F.log(x) + F.lit(37.0)) * F.lit(800.0)))
    low = F.when(score <= 1e-300, F.lit(65535)).otherwise(F.lit(32768) + F.floor(-F.log(score) * F.lit(45.0)))
    return F.when(score >= 0.5, high).otherwise(low).cast("int")


def _split_large(base: DataFrame, by: list[str], keys: list[str], id_col: str, out: str, target: int) -> DataFrame:
    """Buckets of more than ``target`` rows are cut into 1024 slices, in the
    order (score desc, id): by the score's place between the bucket's
    extremes, or by the id's where all scores are equal."""
    large = (base.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("_n1"), F.min("_s").alias("_s0"), F.max("_s").alias("_s1"),
                                          F.min(id_col).alias("_i0"), F.max(id_col).alias("_i1")).where(F.col("_n1") > target))
    if large.isEmpty():
        return base.withColumn(out, F.lit(0))
    by_id = F.floor((F.col(id_col) - F.col("_i0")) / (F.col("_i1") - F.col("_i0") + 1) * 1024)
    by_score = F.floor((F.col("_s1") - F.col("_s")) / (F.col("_s1") - F.col("_s0")) * 1023)
    slot = F.when(F.col("_n1").isNull(), F.lit(0)).when(F.col("_s0") == F.col("_s1"), by_id).otherwise(by_score)
    return base.join(large, [*by, *keys], "left").withColumn(out, slot.cast("int")).drop("_n1", "_s0", "_s1", "_i0", "_i1")


def rank_select(df: DataFrame, by: Sequence[str], id_col: str, seed, quotas: Mapping[str, QuotaFn],
                score: Column | None = None, rank_col: str | None = None, target: int = 65536) -> DataFrame:
    """For each quota q: flag rows whose rank inside their ``by`` group, in
    ``(md5(id:seed), id)`` order, is <= q(n).  Exact; no group in one task.

    With ``score`` (a number in [0, 1]) the order is ``(score desc, id)``, for
    numeric ids.  Its buckets follow the score; any that holds more than
    ``target`` rows is cut again by its own extremes, twice if need be, and
    rows of one score are cut by their ids."""
    by = list(by)
    if score is None:
        base = df.withColumn("_h", hash_key(id_col, seed)).withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
        keys, order = ["_b"], [F.col("_h")]
    else:
        # written once: the input is read for the buckets' sizes and for the ranks
        base = cut_lineage(df.withColumn("_s", score.cast("double")).withColumn("_b", score_bucket(F.col("_s"))))
        base = _split_large(base, by, ["_b"], id_col, "_b1", target)
        base = _split_large(base, by, ["_b", "_b1"], id_col, "_b2", target)
        keys, order = ["_b", "_b1", "_b2"], [F.desc("_s")]
    hist = base.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("_cnt"))
    wg = Window.partitionBy(*by)
    wc = wg.orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    hist = (hist.withColumn("_n", F.sum("_cnt").over(wg))
            .withColumn("_before", F.sum("_cnt").over(wc) - F.col("_cnt")))
    for name, fn in quotas.items():
        hist = hist.withColumn(f"_q_{name}", fn(F.col("_n")))
    qcols = [f"_q_{n}" for n in quotas]
    # exact rank = rows of the group in lower buckets + rank inside the bucket;
    # the window partitions by (group, bucket), never a whole group
    out = base.join(hist, [*by, *keys])
    out = out.withColumn("_rank", F.col("_before") + F.row_number().over(
        Window.partitionBy(*by, *keys).orderBy(*order, id_col)))
    for name, q in zip(quotas, qcols):
        out = out.withColumn(name, F.col("_rank") <= F.col(q))
    if rank_col:
        out = out.withColumn(rank_col, F.col("_rank"))
    return out.drop("_h", "_s", *keys, "_cnt", "_n", "_before", "_rank", *qcols)


def stratified_test_split(df: DataFrame, strata_col: str, id_col: str, frac: float = 0.3, seed: int = 0,
                          out: str = "split") -> DataFrame:
    """WIN1: per stratum take exactly ``bround(frac * n)`` rows as test (smallest
    md5 keys), rest train.  Stratum 0 (rows with no label) never reaches
    test (T10)."""
    sel = rank_select(df, [strata_col], id_col, seed, {"_in_test": bround_quota(frac)})
    is_test = F.col("_in_test") & (F.col(strata_col) > 0)
    return sel.withColumn(out, F.when(is_test, F.lit("test")).otherwise(F.lit("train"))).drop("_in_test")


def imbalance_counts(n_max: int, K: int, gamma: float) -> list[int]:
    """WIN4 quota list (driver-side, K numbers)."""
    if gamma == 1.0:
        return [int(n_max)] * K
    mu = math.pow(1.0 / abs(gamma), 1.0 / (K - 1))
    out = [int(n_max * math.pow(mu, c)) for c in range(K - 1)] + [int(n_max / abs(gamma))]
    return out[::-1] if gamma < 0 else out


def imbalance_profile(spark: SparkSession, n_max: int, K: int, gamma: float) -> DataFrame:
    """WIN4 as a K-row table ``(class_id, n)`` computed by Spark expressions."""
    mu = F.pow(F.lit(1.0 / abs(gamma)), F.lit(1.0 / (K - 1)))
    c = F.col("id")
    n = F.when(c == K - 1, F.floor(F.lit(float(n_max)) / F.lit(abs(gamma)))).otherwise(
        F.floor(F.lit(float(n_max)) * F.pow(mu, c)))
    out = spark.range(K).select(c.cast("int").alias("class_id"), n.cast("long").alias("n"))
    if gamma < 0:
        out = out.withColumn("class_id", (F.lit(K - 1) - F.col("class_id")).cast("int"))
    return out


def _per_class_quota(values: Sequence[int] | None, label_col: str) -> QuotaFn | None:
    if values is None:
        return None
    arr = F.array(*[F.lit(int(v)) for v in values])
    return lambda n: F.element_at(arr, F.col(label_col) + 1).cast("long")


def sample_labelled_unlabelled(df: DataFrame, label_col: str, id_col: str, K: int, lb_num: int,
                               ulb_num: int | None = None, lb_gamma: float = 1.0, ulb_gamma: float = 1.0,
                               seed: int = 0, out: str = "split_role") -> DataFrame:
    """WIN2: per class, in md5 order: first n_c -> labelled, next m_c (or all
    the rest when ``ulb_num`` is None) -> unlabelled, others dropped.
    Balanced budgets must divide by K (as in the reference)."""
    if lb_gamma == 1.0:
        if lb_num % K:
            raise ValueError("lb_num must be divisible by the number of classes in the balanced setting")
        lb = [lb_num // K] * K
    else:
        lb = imbalance_counts(lb_num, K, lb_gamma)
    if ulb_gamma == 1.0:
        if ulb_num is None:
            ulb = None
        else:
            if ulb_num % K:
                raise ValueError("ulb_num must be divisible by the number of classes in the balanced setting")
            ulb = [ulb_num // K] * K
    else:
        if ulb_num is None:
            raise ValueError("ulb_num must be set in the imbalanced setting")
        ulb = imbalance_counts(ulb_num, K, ulb_gamma)
    quotas = {"_lb": _per_class_quota(lb, label_col)}
    if ulb is not None:
        tot = [a + b for a, b in zip(lb, ulb)]
        quotas["_ulb"] = _per_class_quota(tot, label_col)
    sel = rank_select(df.filter(F.col(label_col).between(0, K - 1)), [label_col], id_col, seed, quotas)
    in_ulb = F.col("_ulb") if ulb is not None else F.lit(True)
    role = F.when(F.col("_lb"), F.lit("labelled")).when(in_ulb, F.lit("unlabelled"))
    sel = sel.withColumn(out, role).filter(F.col(out).isNotNull())
    return sel.drop("_lb", *(["_ulb"] if ulb is not None else []))


def split_ssl(df: DataFrame, label_col: str, id_col: str, K: int, lb_num: int, ulb_num: int | None = None,
              seed: int = 0, include_lb_to_ulb: bool = True, lb_ids: DataFrame | None = None,
              ulb_ids: DataFrame | None = None, out: str = "split_role") -> DataFrame:
    """WIN3: WIN2, optionally overridden by explicit id lists (semi-joins),
    optionally with the labelled rows repeated in the unlabelled set (SET1)."""
    s = sample_labelled_unlabelled(df, label_col, id_col, K, lb_num, ulb_num, seed=seed, out=out)
    lb = s.filter(F.col(out) == "labelled")
    ulb = s.filter(F.col(out) == "unlabelled")
    if lb_ids is not None:
        lb = df.join(lb_ids.select(id_col).distinct(), id_col, "left_semi").withColumn(out, F.lit("labelled"))
    if ulb_ids is not None:
        ulb = df.join(ulb_ids.select(id_col).distinct(), id_col, "left_semi").withColumn(out, F.lit("unlabelled"))
    if include_lb_to_ulb:
        ulb = include_labelled_in_unlabelled(lb, ulb, out)
    return lb.unionByName(ulb)


def ordered_split_per_class(df: DataFrame, label_col: str, order_col: str, frac: float = 0.8,
                            out: str = "split") -> DataFrame:
    """WIN5: first ``int(frac * n_c)`` rows of each class in file order -> train, rest test."""
    # ranks in file order: the row's place between the first and the last one is a decreasing score
    ends = df.agg(F.min(order_col).cast("double").alias("a"), F.max(order_col).cast("double").alias("b")).select(F.struct("a", "b").alias("e"))
    d = df.withColumn("_e", ends.scalar())
    place = (F.col(order_col).cast("double") - F.col("_e.a")) / F.greatest(F.col("_e.b") - F.col("_e.a"), F.lit(1.0))
    sel = rank_select(d, [label_col], order_col, 0, {"_train": lambda n: F.floor(F.lit(float(frac)) * n.cast("double")).cast("long")},
                      score=F.lit(1.0) - place)
    return sel.withColumn(out, F.when(F.col("_train"), F.lit("train")).otherwise(F.lit("test"))).drop("_train", "_e")


def fraction_per_class(df: DataFrame, label_col: str, id_col: str, pct: float, seed: int = 0,
                       out: str = "picked") -> DataFrame:
    """WIN6: ``int(n_c * pct)`` rows per class (md5 order, exact, skew-safe)."""
    q = lambda n: F.floor(F.lit(float(pct)) * n.cast("double")).cast("long")
    return rank_select(df, [label_col], id_col, seed, {out: q})


def first_n_per_class(df: DataFrame, label_col: str, order_col: str, n: int, out: str = "picked") -> DataFrame:
    """WIN7: first n rows of each class in input order, flag + complement.
    ``row_number() <= n`` with a literal n lets Spark apply its window
    group limit (map-side top-n) when only the picked rows are kept."""
    w = Window.partitionBy(label_col).orderBy(order_col)
    return df.withColumn(out, F.row_number().over(w) <= F.lit(n))


def resample_uniform(df: DataFrame, id_col: str, n: int, N: int, seed: int) -> DataFrame:
    """SMP1: ``n // N`` full copies of the set plus the ``n % N`` rows with the
    smallest md5 keys (sampling without replacement), ``seed`` = epoch.
    N is the set size (pass the known count; it is not collected here)."""
    reps, rem = divmod(n, N)
    full = df.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.lit(reps)))) if reps > 0 else None
    part = None
    if rem > 0:
        sel = rank_select(df.withColumn("_all", F.lit(0)), ["_all"], id_col, seed,
                          {"_pick": lambda _n: F.lit(rem).cast("long")})
        part = sel.filter("_pick").drop("_pick", "_all").withColumn("copy_no", F.lit(reps + 1))
    if full is None:
        return part
    return full if part is None else full.unionByName(part)


def resample_weighted(df: DataFrame, id_col: str, weight_col: str, n: int, seed: int) -> DataFrame:
    """SMP2 without replacement: Efraimidis-Spirakis keys; the n smallest
    ``-ln(u) / w`` are the sample (the same order as the largest ``u^(1/w)``,
    without its underflow).  ``rank_select`` takes the key as the decreasing
    score ``1 / (1 + key)``.  ``n`` above the set's size repeats it: whole
    copies first, then the sample of the remainder; ``copy_no`` tells them."""
    d = df.withColumn("_es", F.lit(1.0) / (F.lit(1.0) - F.log(hash_u52(id_col, seed)) / F.col(weight_col))).withColumn("_all", F.lit(0))
    sel = rank_select(d, ["_all"], id_col, seed, {"_more": lambda rows: F.lit(int(n)) % F.greatest(rows, F.lit(1)),
                                                  "_copy": lambda rows: rows}, score=F.col("_es"))
    size = df.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    copies = F.floor(F.lit(int(n)) / size).cast("int") + F.col("_more").cast("int")
    return (sel.withColumn("copy_no", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies))))
            .drop("_more", "_copy", "_all", "_es"))


def class_balanced_weights(counts: DataFrame, count_col: str = "n", out: str = "weight",
                           target_rate: float = 1.0) -> DataFrame:
    """SMP3: per-class sampling weight = target rate / class count (K rows)."""
    return counts.withColumn(out, F.lit(float(target_rate)) / F.col(count_col))


def bernoulli_keep(df: DataFrame, keep_col: str, id_col: str, seed: int, out: str = "kept") -> DataFrame:
    """SMP5: keep a row with probability ``keep_col`` (md5-seeded uniform)."""
    return df.withColumn(out, hash_u(id_col, seed) < F.col(keep_col))


def include_labelled_in_unlabelled(lb: DataFrame, ulb: DataFrame, role_col: str = "split_role") -> DataFrame:
    """SET1: labelled rows repeated in the unlabelled set."""
    return ulb.unionByName(lb.withColumn(role_col, F.lit("unlabelled")))


def append_unlabelled(base: DataFrame, extra: DataFrame) -> DataFrame:
    """SET2: base ∪ extra pool (missing columns become null)."""
    return base.unionByName(extra, allowMissingColumns=True)


def augment_labelled_with_pseudo(lb: DataFrame, picked: DataFrame, label_col: str, pl_col: str) -> DataFrame:
    """SET3: labelled ∪ picked pseudo-labelled rows, with provenance."""
    a = lb.withColumn("source", F.lit("labelled"))
    b = picked.withColumn(label_col, F.col(pl_col).cast("int")).withColumn("source", F.lit("pseudo"))
    return a.unionByName(b.select(*a.columns))


def full_supervised_pool(lb: DataFrame, ulb: DataFrame, id_col: str) -> DataFrame:
    """SET4: every row back as labelled, one per id (the labelled row, where there is one)."""
    both = (lb.withColumn("_p", F.lit(0)).unionByName(ulb.withColumn("_p", F.lit(1)), allowMissingColumns=True))
    rest = [c for c in both.columns if c not in (id_col, "_p")]
    return (both.groupBy(id_col).agg(F.min_by(F.struct(*rest), F.col("_p")).alias("_r"))
            .select(*[F.col(id_col) if c == id_col else F.col(f"_r.{c}").alias(c) for c in both.columns if c != "_p"]))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """SET5."""
    return df.select(col).distinct()
