"""Aggregations over class / batch keys (AGG1-3, AGG10-18).

All of them aggregate N rows down to K (classes) or B x K (batch x class)
rows with partial (map-side) aggregation first, so the shuffle carries
K-sized partials per task, never N rows.  Anything attached back to rows is
K-sized and broadcast (or a scalar subquery).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sslspark.constants import OOD, UNLABELLED
from sslspark.functions.arrays import col_of
from sslspark.session import cut_lineage

__all__ = [
    "class_counts", "class_distribution", "label_report", "mean_probs_by_batch", "conf_stats", "exact_quantile",
    "pseudo_label_histogram", "util_ratio", "class_prototypes", "prototype_map", "effective_weights",
    "refresh_weights_from_pseudo_labels", "min_over_count", "class_range",
]


def class_range(spark: SparkSession, K: int, name: str = "class_id") -> DataFrame:
    """The K class ids as a tiny dimension table."""
    return spark.range(K).select(F.col("id").cast("int").alias(name))


def class_counts(df: DataFrame, label_col: str, K: int, out: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """AGG1: rows per class, zero classes kept (right join to the K ids)."""
    counts = df.filter(F.col(label_col).between(0, K - 1)).groupBy(*by, label_col).agg(F.count(F.lit(1)).alias(out))
    dims = class_range(df.sparkSession, K, label_col)
    if by:
        raise NotImplementedError("per-key class counts: use label_report / pseudo_label_histogram")
    return (F.broadcast(dims).join(counts, label_col, "left")
            .select(label_col, F.coalesce(F.col(out), F.lit(0)).cast("long").alias(out)))


def class_distribution(counts: DataFrame, count_col: str = "n", out: str = "share") -> DataFrame:
    """AGG2: count / total over a K-row table (K rows -> one small window)."""
    return counts.withColumn(out, F.col(count_col) / F.sum(count_col).over(Window.partitionBy()))


def label_report(long_df: DataFrame, vocab: DataFrame, task_col: str = "task",
                 id_col: str = "label_id") -> DataFrame:
    """AGG3: per task every class (zero-filled), ``ood``, ``total-lb``, ``total-ulb``.

    ``long_df``: one row per (row, task) with an encoded id (>=0, -100, -200 or
    null = unlabelled).  ``vocab``: (task, label, label_id).  One grouped
    aggregate; class rows and total rows are both derived from it (the
    exchange is reused).
    """
    key = (F.when(F.col(id_col) >= 0, F.col(id_col))
           .when(F.col(id_col) == OOD, F.lit(OOD))
           .otherwise(F.lit(UNLABELLED)))
    g = long_df.groupBy(task_col, key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    per_class = (F.broadcast(vocab.select(task_col, "label", F.col("label_id").alias("k")))
                 .join(g, [task_col, "k"], "left")
                 .select(task_col, "label", F.coalesce("n", F.lit(0)).cast("long").alias("n")))
    tot = g.groupBy(task_col).agg(
        F.sum(F.when(F.col("k") == OOD, F.col("n")).otherwise(0)).cast("long").alias("ood"),
        F.sum(F.when(F.col("k") >= 0, F.col("n")).otherwise(0)).cast("long").alias("total-lb"),
        F.sum(F.when(F.col("k") == UNLABELLED, F.col("n")).otherwise(0)).cast("long").alias("total-ulb"))
    totals = tot.unpivot(task_col, ["ood", "total-lb", "total-ulb"], "label", "n")
    return per_class.unionByName(totals.select(task_col, "label", F.col("n").cast("long")))


def mean_probs_by_batch(df: DataFrame, probs_col: str = "probs", batch_col: str = "batch_id",
                        out: str = "mean_p") -> DataFrame:
    """AGG10: per (batch, class) mean probability, long form (B x K rows)."""
    return (df.select(batch_col, F.posexplode(probs_col).alias("class_id", "p"))
            .groupBy(batch_col, "class_id").agg(F.avg("p").alias(out))
            .withColumn("class_id", F.col("class_id").cast("int")))


def exact_quantile(df: DataFrame, value_col: str, by: Sequence[str], q: float, out: str = "quantile",
                   slots: int = 1024, small: int = 65536) -> DataFrame:
    """``(*by, out)``: the q-quantile with linear interpolation between the two
    order statistics beside it, exactly, without a group in one task.

    Each round counts the values between a group's bounds in ``slots`` equal
    slots (a partial aggregate) and keeps the slot that holds the wanted rank as
    the new bounds; when no group has more than ``small`` values between its
    bounds, only those are sorted.  The driver sees one number a round.  Nulls
    and NaN have no rank; a group of them only has a null quantile."""
    by = list(by)
    key = "_one" if not by else None
    keys = by or [key]
    x = F.col(value_col).cast("double")
    d = df.select(*by, *([F.lit(1).alias(key)] if key else []), x.alias("_x"))
    valid = cut_lineage(d.where(F.col("_x").isNotNull() & ~F.isnan("_x")))
    pos = F.lit(float(q)) * (F.col("_n") - 1)
    ends = valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    rank = F.explode(F.array(F.struct(F.lit(0).alias("w"), F.floor(pos).alias("r")), F.struct(F.lit(1).alias("w"), F.ceil(pos).alias("r")))).alias("_t")
    # ranks wanted, from 0 inside the bounds; _m values lie between the bounds
    state = cut_lineage(ends.select(*keys, "_lo", "_hi", (pos - F.floor(pos)).alias("_f"), F.col("_n").alias("_m"), rank)
                        .select(*keys, "_lo", "_hi", "_f", "_m", F.col("_t.w").alias("_w"), F.col("_t.r").cast("long").alias("_r")))

    def between(s: DataFrame) -> DataFrame:
        return valid.join(s, keys).where((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))

    while True:
        most = state.where("_lo < _hi").agg(F.max("_m")).first()[0] or 0
        if most <= small:
            break
        place = F.floor((F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * slots)
        hist = (between(state.where((F.col("_lo") < F.col("_hi")) & (F.col("_m") > small)))
                .groupBy(*keys, "_w", "_r", "_f", F.least(place, F.lit(slots - 1)).alias("_s"))
                .agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")))
        up = Window.partitionBy(*keys, "_w").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        found = (hist.withColumn("_b", F.coalesce(F.sum("_c").over(up), F.lit(0)))
                 .where((F.col("_b") <= F.col("_r")) & (F.col("_r") < F.col("_b") + F.col("_c")))
                 .select(*keys, "_lo", "_hi", "_f", F.col("_c").alias("_m"), "_w", (F.col("_r") - F.col("_b")).alias("_r")))
        state = cut_lineage(found.unionByName(state.where((F.col("_lo") >= F.col("_hi")) | (F.col("_m") <= small))))
    order = Window.partitionBy(*keys, "_w").orderBy("_x")
    sorted_ = (between(state.where("_lo < _hi")).withColumn("_i", F.row_number().over(order) - 1).where("_i = _r")
               .select(*keys, "_w", "_f", F.col("_x").alias("_v")))
    got = sorted_.unionByName(state.where("_lo >= _hi").select(*keys, "_w", "_f", F.col("_lo").alias("_v")))
    both = got.groupBy(*keys).agg(F.max(F.when(F.col("_w") == 0, F.col("_v"))).alias("_a"), F.max(F.when(F.col("_w") == 1, F.col("_v"))).alias("_b"),
                                  F.max("_f").alias("_f"))
    value = both.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias(out))
    if key:
        return d.select(key).limit(1).join(value, key, "left").drop(key)
    return d.select(*keys).distinct().join(value, keys, "left")


def conf_stats(df: DataFrame, conf_col: str = "conf", by: Sequence[str] = (), q: float = 0.8,
               exact: bool = True) -> DataFrame:
    """AGG11: mean, unbiased variance and the q-quantile (linear interpolation,
    as torch.quantile) of confidence, overall or per key (keys without nulls).
    The exact quantile holds no group in one task (``exact_quantile``);
    ``exact=False`` uses ``percentile_approx``."""
    by = list(by)
    basic = [F.count(F.lit(1)).alias("n"), F.avg(conf_col).alias("mean"), F.var_samp(conf_col).alias("var")]
    if not exact:
        return df.groupBy(*by).agg(*basic, F.percentile_approx(conf_col, F.lit(q), F.lit(10000)).alias("quantile"))
    slim = cut_lineage(df.select(*by, conf_col))
    stats, quantile = slim.groupBy(*by).agg(*basic), exact_quantile(slim, conf_col, by, q)
    return stats.join(quantile, by) if by else stats.withColumn("quantile", quantile.scalar())


def pseudo_label_histogram(df: DataFrame, pl_col: str, K: int, by: Sequence[str] = ()) -> DataFrame:
    """AGG12: bincount of pseudo-labels (zero classes kept), normalised by the total."""
    cls = class_range(df.sparkSession, K, "class_id")
    counts = df.groupBy(*by, F.col(pl_col).alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    if by:
        # every key gets its K class slots by exploding a K-sequence (no join)
        grid = counts.select(*by).distinct().select(
            *by, F.explode(F.sequence(F.lit(0), F.lit(K - 1))).alias("class_id"))
    else:
        grid = cls
    out = grid.join(counts, [*by, "class_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    return out.withColumn("share", F.col("n") / F.sum("n").over(w))


def util_ratio(df: DataFrame, mask_col: str = "mask", by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """AGG13: mean mask = share of unlabelled rows used."""
    return df.groupBy(*by).agg(F.avg(F.col(mask_col).cast("double")).alias("util_ratio"))


def class_prototypes(df: DataFrame, label_col: str, feat_col: str, normalise: bool = False, weight: Column | None = None) -> DataFrame:
    """AGG15: mean feature per class -> (label, proto array<double>), weighted by ``weight`` if given.

    ``posexplode`` + ``groupBy(label, pos).avg``: the partial aggregate keeps
    K x D values per task before the shuffle.  ``normalise`` L2-normalises
    each prototype (weight imprinting).
    """
    v = F.col("v").cast("double")
    if weight is None:
        long = df.select(label_col, F.posexplode(feat_col).alias("pos", "v")).groupBy(label_col, "pos").agg(F.avg(v).alias("v"))
    else:
        long = (df.select(label_col, weight.cast("double").alias("_w"), F.posexplode(feat_col).alias("pos", "v"))
                .groupBy(label_col, "pos").agg((F.sum(v * F.col("_w")) / F.sum("_w")).alias("v")))
    protos = long.groupBy(label_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("proto"))
    if normalise:
        from sslspark.functions.arrays import l2_normalise
        protos = protos.withColumn("proto", l2_normalise("proto"))
    return protos


def prototype_map(protos: DataFrame, label_col: str = "label", proto_col: str = "proto") -> Column:
    """K prototypes as one map literal computed once (scalar subquery).

    The map holds K x D doubles — bounded by the vocabulary and the feature
    width, never by N — and is evaluated once per query, not joined per row.
    """
    return protos.select(F.map_from_entries(F.collect_list(F.struct(label_col, proto_col)))).scalar()


def effective_weights(counts: DataFrame, count_col: str = "n", out: str = "weight") -> DataFrame:
    """AGG16: N = sum(n)/K, beta = (N-1)/N, w = (1-beta)/(1-beta^n), scaled to sum K."""
    w_all = Window.partitionBy()
    k = F.count(F.lit(1)).over(w_all)
    n_bar = F.sum(count_col).over(w_all) / k
    beta = (n_bar - 1) / n_bar
    raw = (1 - beta) / (1 - F.pow(beta, F.col(count_col)))
    return (counts.withColumn("_raw", raw)
            .withColumn(out, F.col("_raw") / F.sum("_raw").over(w_all) * F.count(F.lit(1)).over(w_all))
            .drop("_raw"))


def refresh_weights_from_pseudo_labels(pl_counts: DataFrame, count_col: str = "n", out: str = "weight") -> DataFrame:
    """AGG17: counts floored at 1, then AGG16."""
    return effective_weights(pl_counts.withColumn(count_col, F.greatest(F.col(count_col), F.lit(1))), count_col, out)


def min_over_count(counts: DataFrame, count_col: str = "n", out: str = "keep_p") -> DataFrame:
    """AGG18: min(n) / n_c keep probability."""
    return counts.withColumn(out, F.min(count_col).over(Window.partitionBy()) / F.col(count_col))
