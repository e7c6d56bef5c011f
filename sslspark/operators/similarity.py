"""Similarity, prototypes, banks and in-batch pairing (JOI6-12).

Rules followed here: the only sides attached to every row are K-sized
(prototypes, per-class vectors) or bank-sized (a bounded top-L bank); pairs
are only formed inside one ``batch_id`` (never globally).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sslspark.functions.arrays import col_of, cosine, let, softmax
from sslspark.functions.keys import hash_key
from sslspark.operators.aggs import prototype_map
from sslspark.operators.state import last_value, running_sum
from sslspark.session import cut_lineage

__all__ = ["prototype_logits", "prototype_similarity", "random_partner"]


def prototype_logits(df: DataFrame, feat_col: str, protos: DataFrame, T: float,
                     label_col: str = "label", out: str = "logits") -> DataFrame:
    """JOI11 (first half): logits[c] = cosine(feature, prototype_c) / T.

    The K prototypes are one map computed once (scalar subquery); class
    order = ascending class id.
    """
    # the map is projected once as a column: subqueries cannot sit inside lambdas
    with_p = df.withColumn("_protos", prototype_map(protos, label_col))
    P = F.col("_protos")
    keys = F.array_sort(F.map_keys(P))
    lg = let(F.col(feat_col), lambda feat: F.transform(keys, lambda k: cosine(feat, F.element_at(P, k)) / F.lit(float(T))))
    return with_p.withColumn(out, lg).drop("_protos")


def prototype_similarity(df: DataFrame, feat_col: str, protos: DataFrame, T: float,
                         label_col: str = "label", out: str = "p_sim") -> DataFrame:
    """JOI11: softmax(cosine(feature, prototype) / T)."""
    tmp = "_proto_logits"
    return prototype_logits(df, feat_col, protos, T, label_col, tmp).withColumn(out, softmax(tmp)).drop(tmp)


def random_partner(df: DataFrame, id_col: str, batch_col: str, seed: int, seed_b: int | None = None) -> DataFrame:
    """JOI12: pair each row with a row of a seeded permutation of its batch.

    Rows are numbered inside each batch by two md5 orders and equi-joined on
    ``(batch, rn)``: a permutation per batch, no global shuffle order.
    """
    seed_b = seed + 1 if seed_b is None else seed_b
    w1 = Window.partitionBy(batch_col).orderBy(hash_key(id_col, seed), id_col)
    w2 = Window.partitionBy(batch_col).orderBy(hash_key(id_col, seed_b), id_col)
    a = df.withColumn("_rn", F.row_number().over(w1))
    b = df.select(F.col(batch_col).alias("_b"), F.col(id_col).alias("partner_id"),
                  F.row_number().over(w2).alias("_rn"))
    return (a.join(b, (a[batch_col] == b["_b"]) & (a["_rn"] == b["_rn"]))
            .drop("_b", "_rn"))


# --- banks: a bounded set of (feature, target) rows attached to every query row -------------------

def ring_bank(df: DataFrame, L: int, order_cols=("batch_id", "row_id")) -> DataFrame:
    """WIN16: the newest L rows (batch desc, id desc): a top-L, no global window."""
    return df.orderBy(*[F.desc(c) for c in order_cols]).limit(L)


def _ranked(df: DataFrame, by: list[str], batch_col: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``_rank`` (1, 2, ... in (batch, id) order inside ``by``), and
    ``(*by, batch, _last)``: the rank of the last row of each batch.  Counts of
    the batches are summed up in chunks; rows are numbered inside their batch."""
    counts = df.groupBy(*by, batch_col).agg(F.count(F.lit(1)).alias("_n"))
    ends = cut_lineage(running_sum(counts, by, batch_col, "_n", "_last").withColumn("_last", F.col("_last").cast("long")))
    inside = F.row_number().over(Window.partitionBy(*by, batch_col).orderBy(id_col))
    rows = df.withColumn("_i", inside).join(ends, [*by, batch_col]).withColumn("_rank", F.col("_last") - F.col("_n") + F.col("_i"))
    return rows.drop("_i", "_n", "_last"), ends.drop("_n")


def _newest(rows: DataFrame, ends: DataFrame, by: list[str], L: int) -> DataFrame:
    """Each of ``ends(*by, ..., _last)`` with the ``L`` rows up to ``_last``: an
    equi-join on chunks of L ranks, a row in its own and the next one."""
    chunk = F.floor((F.col("_rank") - 1) / F.lit(L)).cast("long")
    r = rows.withColumn("_chunk", F.explode(F.array(chunk, chunk + 1)))
    e = ends.withColumn("_chunk", F.floor((F.col("_last") - 1) / F.lit(L)).cast("long"))
    return r.join(e, [*by, "_chunk"]).where((F.col("_rank") <= F.col("_last")) & (F.col("_rank") > F.col("_last") - L)).drop("_chunk")


def fifo_prototypes(df: DataFrame, label_col: str, feat_col: str, L: int, batch_col: str = "batch_id", id_col: str = "row_id",
                    out: str = "proto") -> DataFrame:
    """WIN11: for each class and batch that has rows of it, the mean of the
    class's last ``L`` features up to the batch's end: ``label, batch, n, out``.
    No class lies in one task: rows meet a batch's end by chunks of L ranks, and
    the sums are partial aggregates over (class, batch, place in the vector)."""
    rows, ends = _ranked(df.select(label_col, feat_col, batch_col, id_col), [label_col], batch_col, id_col)
    near = _newest(rows.drop(batch_col, id_col), ends, [label_col], L)
    long = (near.select(label_col, batch_col, F.posexplode(feat_col).alias("pos", "v"))
            .groupBy(label_col, batch_col, "pos").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("v").cast("double")).alias("v")))
    return long.groupBy(label_col, batch_col).agg(
        F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias(out))


def ring_bank_as_of(df: DataFrame, rows: DataFrame, L: int, cols: list[str], batch_col: str = "batch_id", id_col: str = "row_id",
                    out: str = "_bank") -> DataFrame:
    """WIN16 as of each batch: every row of ``df`` gets the newest ``L`` of
    ``rows`` that came in batches before its own, newest first (an empty array
    before there are any).  A batch's bank has L rows by construction, and is
    put together once for the batch."""
    ranked, ends = _ranked(rows.select(batch_col, id_col, *[c for c in cols if c not in (batch_col, id_col)]), [], batch_col, id_col)
    asked = df.select(batch_col).distinct().withColumn("_asked", F.lit(True))
    grid = asked.join(ends, batch_col, "full")
    # the last rank before each batch: of the batches in between, the greatest
    before = last_value(grid.withColumn("_k", F.lit(0)).withColumn("_last", F.col("_last").cast("double")), ["_k"], batch_col, "_last", 0.0, "_upto")
    own = ranked.groupBy(batch_col).agg(F.count(F.lit(1)).alias("_own"))
    before = (before.join(own, batch_col, "left").where("_asked")
              .select(F.col(batch_col).alias("_for"), (F.col("_upto") - F.coalesce("_own", F.lit(0))).cast("long").alias("_last")).where("_last > 0"))
    near = _newest(ranked, before, [], L)
    bank = near.groupBy("_for").agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct(F.col("_rank"), F.struct(*cols).alias("e"))))),
                                                lambda s: s["e"]).alias(out))
    return (df.join(bank.withColumnRenamed("_for", batch_col), batch_col, "left")
            .withColumn(out, F.coalesce(F.col(out), F.array().cast(bank.schema[out].dataType))))


def smooth_with_bank(df: DataFrame, rows: DataFrame, L: int, K: int, T: float, alpha: float, feat_col: str = "feat", probs_col: str = "probs",
                     bank_probs: str = "bp", out: str = "p_smooth") -> DataFrame:
    """JOI7 and JOI8 over the bank as of each batch: where the bank has rows,
    alpha * p + (1 - alpha) * their similarity-weighted targets, else p."""
    d = ring_bank_as_of(df, rows, L, [feat_col, bank_probs])
    d = d.withColumn("_a", bank_similarity(feat_col, "_bank", feat_col, T))
    mixed = neighbour_smooth(probs_col, "_a", "_bank", bank_probs, alpha, K)
    return d.withColumn(out, F.when(F.size("_bank") > 0, mixed).otherwise(F.col(probs_col))).drop("_a", "_bank")


def keyed_bank(df: DataFrame, id_col: str, batch_col: str, feat_col: str, m: float | None = None) -> DataFrame:
    """WIN17: one feature per id.  ``m=None``: the latest one replaces the
    rest (``max_by`` per id).  Otherwise v <- normalise(m v + (1-m) x) over the
    id's appearances in batch order (a fold over its rows; an id appears once
    per epoch, so the list per id is bounded by the number of epochs)."""
    from sslspark.functions.arrays import l2_normalise
    if m is None:
        return df.groupBy(id_col).agg(F.max_by(F.col(feat_col), F.col(batch_col)).alias(feat_col))
    seq = F.array_sort(F.collect_list(F.struct(F.col(batch_col).alias("b"), F.col(feat_col).alias("x"))))
    g = df.groupBy(id_col).agg(seq.alias("_s"))
    first = l2_normalise(F.col("_s")[0]["x"])
    fold = F.aggregate(F.expr("slice(_s, 2, size(_s))"), first,
                       lambda v, s: l2_normalise(F.zip_with(v, s["x"], lambda a, b: F.lit(m) * a + F.lit(1.0 - m) * b)))
    return g.select(id_col, fold.alias(feat_col))


def attach_bank(df: DataFrame, bank: DataFrame, cols: list[str], out: str = "_bank") -> DataFrame:
    """Attach a ring bank (top-L by construction) to every row as one array of
    structs (a scalar subquery, evaluated once).  Banks that grow with the
    labelled rows go through ``propagate_over_bank``."""
    return df.withColumn(out, bank.select(F.collect_list(F.struct(*cols)).alias("b")).scalar())


def bank_similarity(feat_col: str, bank_col: str, bank_feat: str, T: float) -> Column:
    """JOI7: softmax over the bank of (feature . bank feature) / T (features L2-normalised upstream)."""
    from sslspark.functions.arrays import dot
    # the row's feature is bound once: it is read inside the loop over the bank
    return let(F.col(feat_col), lambda f: softmax(
        F.transform(F.col(bank_col), lambda b: dot(f, b[bank_feat]) / F.lit(float(T)))))


def neighbour_smooth(probs_col: str, weights_col: str, bank_col: str, bank_probs: str, alpha: float, K: int) -> Column:
    """JOI8: alpha * p + (1 - alpha) * sum_j A_j * p_j (A = bank similarity weights)."""
    zero = F.array_repeat(F.lit(0.0), K)
    mix = let(F.col(weights_col), lambda w: F.aggregate(
        F.arrays_zip(w.alias("a"), F.col(bank_col).alias("e")), zero,
        lambda acc, z: F.zip_with(acc, z["e"][bank_probs], lambda x, q: x + z["a"] * q)))
    return F.zip_with(F.col(probs_col), mix, lambda p, q: F.lit(alpha) * p + F.lit(1.0 - alpha) * q)


def label_propagate(probs_col: str, weights_col: str, bank_col: str, bank_label: str, alpha: float, K: int):
    """JOI9 (SimMatch): teacher_j ∝ A_j * p[label_j] (normalised) and
    p <- alpha * p + (1 - alpha) * (sum of A_j per bank label).  Returns
    (teacher Column, smoothed probs Column)."""
    from sslspark.functions.arrays import _div_by_sum
    labels = F.transform(F.col(bank_col), lambda e: e[bank_label])
    # weights, bank labels and the row's probabilities are bound once, then
    # one pass over the bank builds the teacher and the per-class mass
    teacher = let(F.col(probs_col), lambda p: _div_by_sum(
        F.zip_with(F.col(weights_col), labels, lambda a, lab: a * F.element_at(p, lab + 1))))
    zero = F.array_repeat(F.lit(0.0), K)
    mass = F.aggregate(F.zip_with(F.col(weights_col), labels, lambda a, lab: F.struct(a.alias("a"), lab.alias("l"))),
                       zero, lambda acc, t: F.transform(acc, lambda x, i: x + F.when(i == t["l"], t["a"])
                                                        .otherwise(F.lit(0.0))))
    smoothed = F.zip_with(F.col(probs_col), mass, lambda p, q: F.lit(alpha) * p + F.lit(1.0 - alpha) * q)
    return teacher, smoothed


def _block_sums(x, y, of, n, T: float, T_student: float, tile: int = 512):
    """For unit rows ``x`` against bank rows ``y`` (``of``: one column a label,
    holding how often the entry occurs, ``n``): the sums over the bank of
    exp(s/T) by label, of the same times s, and of exp(s/T_student).  Tile by
    tile, so the similarities of a block pair are never held whole."""
    import numpy as np
    m, c, z = np.zeros((len(x), of.shape[1])), np.zeros((len(x), of.shape[1])), np.zeros(len(x))
    for i in range(0, len(x), tile):
        at = slice(i, i + tile)
        for j in range(0, len(y), tile):
            to = slice(j, j + tile)
            s = x[at] @ y[to].T
            w = np.exp(s / T)
            m[at] += w @ of[to]
            w *= s
            c[at] += w @ of[to]
            s /= T_student
            z[at] += np.exp(s, out=s) @ n[to]
    return m, c, z


def propagate_over_bank(df: DataFrame, bank: DataFrame, K: int, T: float, T_student: float, alpha: float, id_col: str = "row_id",
                        feat_col: str = "feat", probs_col: str = "probs", label_col: str = "label_id", block: int = 4096,
                        smoothed: str = "p_prop", loss: str = "in_loss") -> DataFrame:
    """JOI9 + FN22 (SimMatch) for a bank of any size: ``df`` with the smoothed
    probabilities and the instance-consistency loss.

    Rows and bank meet in blocks of about ``block`` (features L2-normalised
    upstream).  A block pair gives each of its rows four sums over its part of
    the bank: exp(s/T) for each label, the same times s, and exp(s/T_student);
    the softmax weights, the teacher and its cross term follow from their
    totals, so neither bank nor teacher is ever held whole.  Equal rows, and
    equal entries of the bank, are one with a count, so that copies don't fill a block."""
    import numpy as np
    import pandas as pd
    blocks = lambda d: max(1, -(-d.count() // block))
    times = F.count(F.lit(1)).cast("double").alias("n")
    rows, entries = df.groupBy(id_col, feat_col).agg(times), bank.groupBy(feat_col, label_col).agg(times)
    left, right = blocks(rows), blocks(entries)
    rows = (rows.withColumn("i", F.pmod(F.xxhash64(id_col, feat_col), F.lit(left).cast("long")))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(right - 1)))))
    entries = (entries.withColumn("j", F.pmod(F.xxhash64(feat_col), F.lit(right).cast("long")).cast("int"))
               .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(left - 1).cast("long")))))

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({id_col: [], "m": [], "c": [], "z": []}, dtype=object)
        n, k = b["n"].to_numpy(), a["n"].to_numpy()
        of = (b[label_col].to_numpy()[:, None] == np.arange(K)[None, :]) * n[:, None]
        m, c, z = _block_sums(np.stack(a[feat_col].to_numpy()), np.stack(b[feat_col].to_numpy()), of, n, T, T_student)
        return pd.DataFrame({id_col: a[id_col].to_numpy(), "m": list(m * k[:, None]), "c": list(c * k[:, None]), "z": z * k})

    kind = df.schema[id_col].dataType.simpleString()
    parts = (rows.groupBy("i", "j").cogroup(entries.groupBy("i", "j"))
             .applyInPandas(pair, f"`{id_col}` {kind}, m array<double>, c array<double>, z double"))
    at = lambda c: [F.sum(F.col(c)[k]).alias(f"_{c}{k}") for k in range(K)]
    sums = parts.groupBy(id_col).agg(*at("m"), *at("c"), F.sum("z").alias("_z"))
    sums = sums.select(id_col, F.array(*[f"_m{k}" for k in range(K)]).alias("_m"), F.array(*[f"_c{k}" for k in range(K)]).alias("_c"), "_z")
    total = F.aggregate("_m", F.lit(0.0), lambda a, x: a + x)
    weigh = lambda c: F.aggregate(F.zip_with(probs_col, c, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    mixed = F.zip_with(probs_col, "_m", lambda p, m: F.lit(alpha) * p + F.lit(1.0 - alpha) * m / F.col("_t"))
    return (df.join(sums, id_col).withColumn("_t", total).withColumns({
        smoothed: mixed, loss: F.log("_z") - weigh("_c") / weigh("_m") / F.lit(float(T_student))}).drop("_m", "_c", "_z", "_t"))


def instance_consistency(teacher_col: str, student_weights_col: str) -> Column:
    """FN22: -sum_j teacher_j * log(student_j)."""
    return -F.aggregate(F.zip_with(F.col(teacher_col), F.col(student_weights_col), lambda t, s: t * F.log(s)),
                        F.lit(0.0), lambda a, x: a + x)


def batch_arrays(df: DataFrame, batch_col: str, cols: list[str], id_col: str = "row_id",
                 ) -> DataFrame:
    """Each row of a batch gets the batch's (id, cols) as one array: the
    in-batch graph below needs every row of its batch (a training step's
    size), never rows of other batches."""
    g = df.groupBy(batch_col).agg(F.collect_list(F.struct(id_col, *cols)).alias("_batch"))
    return df.join(g, batch_col)


def pseudo_label_graph(id_col: str, probs_col: str, batch_col_arr: str = "_batch", tau: float = 0.8) -> Column:
    """JOI10 (CoMatch): row i's graph row Q_ij = p_i . p_j (1 on the
    diagonal), dropped below tau, normalised over j."""
    from sslspark.functions.arrays import dot
    q = let(F.col(probs_col), lambda p: F.transform(
        F.col(batch_col_arr), lambda e: F.when(e[id_col] == F.col(id_col), F.lit(1.0)).otherwise(dot(p, e[probs_col]))))
    from sslspark.functions.arrays import _div_by_sum
    return _div_by_sum(F.transform(q, lambda x: F.when(x >= F.lit(tau), x).otherwise(F.lit(0.0))))


def contrastive_loss(q_col: str, feat0_col: str, feat1_name: str, batch_col_arr: str = "_batch",
                     T: float = 0.2) -> Column:
    """THR18: -sum_j Q_ij log(softmax_j(f0_i . f1_j / T) + 1e-7)."""
    from sslspark.functions.arrays import dot
    sp = let(F.col(feat0_col), lambda f: softmax(
        F.transform(F.col(batch_col_arr), lambda e: dot(f, e[feat1_name]) / F.lit(float(T)))))
    return -F.aggregate(F.zip_with(F.col(q_col), sp, lambda q, s: q * F.log(s + F.lit(1e-7))), F.lit(0.0),
                        lambda a, x: a + x)
