"""Structured Streaming forms of the online hooks (STR1-7).

* STR1 stateless scoring: the batch projections applied to a stream.
* STR2 / STR3 keep K-row state (alignment prior, FreeMatch / SoftMatch
  statistics) across micro-batches in ``foreachBatch``: the state is a tiny
  parquet table versioned by ``epoch_id`` in the checkpoint folder, so a
  replayed epoch reads the same previous version and rewrites its own
  (idempotent).  The update itself reuses the batch-mode scans.
* STR4 / STR5 keep keyed state with ``applyInPandasWithState``.
* STR6 / STR7 are event-time windowed aggregates with a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sslspark.functions.arrays import align, argmax, confidence, vec_lit
from sslspark.operators import policies
from sslspark.operators.aggs import mean_probs_by_batch
from sslspark.operators.state import as_vector_per_batch, ema
from sslspark.session import path_exists

__all__ = ["stream_score_and_mask", "AlignState", "FreeMatchState", "stream_curriculum_deltas",
           "stream_prototypes", "pseudo_label_distribution", "windowed_metrics", "latest_state"]


def stream_score_and_mask(df: DataFrame, probs_col: str = "probs", label_col: str = "label_id",
                          ood_tau: float = 0.9, tau: float = 0.95) -> DataFrame:
    """STR1: conf, pseudo-label, fixed-threshold mask and OOD flag per row."""
    d = policies.ood_by_confidence(df, probs_col, label_col, ood_tau)
    d = policies.with_conf(d, probs_col)
    return policies.fixed_threshold(d, probs_col, tau)


def latest_state(spark: SparkSession, state_dir: str, before_epoch: int) -> DataFrame | None:
    """Newest state version written by an epoch < ``before_epoch`` (None if none)."""
    if not path_exists(spark, state_dir):
        return None
    st = spark.read.parquet(state_dir)
    st = st.filter(F.col("epoch") < before_epoch)
    last = st.agg(F.max("epoch")).first()[0]
    if last is None:
        return None
    return st.filter(F.col("epoch") == last).drop("epoch")


def write_epoch(df: DataFrame, epoch_id: int, path: str) -> None:
    """Output and state go to a partition of their epoch, which a replayed
    micro-batch writes over."""
    (df.withColumn("epoch", F.lit(epoch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("epoch").parquet(path))


class AlignState:
    """STR2: EMA distribution alignment across micro-batches (``foreachBatch``).

    Each micro-batch may hold one or more consecutive ``batch_id``s; they are
    processed in order exactly as ``adaptive.align_distribution(mode='ema',
    target='uniform')``: the first batch ever sets p_model, later ones blend.
    """

    def __init__(self, state_dir: str, out_path: str, K: int, m: float = 0.999,
                 probs_col: str = "probs", batch_col: str = "batch_id"):
        self.state_dir, self.out_path, self.K, self.m = state_dir, out_path, K, m
        self.probs_col, self.batch_col = probs_col, batch_col

    def __call__(self, df: DataFrame, epoch_id: int) -> None:
        spark = df.sparkSession
        b = self.batch_col
        prev = latest_state(spark, self.state_dir, epoch_id)
        stats = mean_probs_by_batch(df, self.probs_col, b, "x")
        base = stats.agg(F.min(b)).first()[0]
        if base is None:
            return
        stats = stats.withColumn("_t", F.col(b) - F.lit(base))
        if prev is None:
            pm = ema(stats, ["class_id"], "_t", "x", self.m, None, "p_model")
        else:
            stats = stats.join(F.broadcast(prev.select("class_id", F.col("v").alias("_init"))), "class_id")
            pm = ema(stats, ["class_id"], "_t", "x", self.m, F.col("_init"), "p_model")
        vec = as_vector_per_batch(pm.select(b, "class_id", "p_model"), b, "p_model", "_p_model")
        out = df.join(vec, b).withColumn(
            "probs_aligned", align(self.probs_col, vec_lit([1.0 / self.K] * self.K), "_p_model")).drop("_p_model")
        write_epoch(out, epoch_id, self.out_path)
        last = pm.filter(F.col("_t") == pm.agg(F.max("_t")).first()[0])
        write_epoch(last.select("class_id", F.col("p_model").alias("v")), epoch_id, self.state_dir)


class FreeMatchState:
    """STR3: FreeMatch self-adaptive threshold across micro-batches (update then
    mask), state = (time_p, p_model[K], label_hist[K]) from 1/K.

    ``clip=True`` clips time_p to [0, 0.95] after every update (not linear, so
    each micro-batch must hold exactly one step: ``maxFilesPerTrigger=1``)."""

    def __init__(self, state_dir: str, out_path: str, K: int, m: float = 0.999,
                 probs_col: str = "probs", batch_col: str = "batch_id", clip: bool = False):
        self.state_dir, self.out_path, self.K, self.m = state_dir, out_path, K, m
        self.clip = clip
        self.probs_col, self.batch_col = probs_col, batch_col

    def __call__(self, df: DataFrame, epoch_id: int) -> None:
        spark = df.sparkSession
        b, K, m = self.batch_col, self.K, self.m
        prev = latest_state(spark, self.state_dir, epoch_id)
        base = df.agg(F.min(b)).first()[0]
        if base is None:
            return
        d = df.withColumns({"_t": F.col(b) - F.lit(base), "_conf": confidence(self.probs_col),
                            "_pl": argmax(self.probs_col)})
        # long state rows: class_id -1 holds time_p; 0..K-1 p_model; K..2K-1 label_hist
        if prev is None:
            init = spark.range(-1, 2 * K).select(F.col("id").cast("int").alias("class_id"),
                                                 F.lit(1.0 / K).alias("_init"))
        else:
            init = prev.select("class_id", F.col("v").alias("_init"))
        tp = d.groupBy("_t").agg(F.avg("_conf").alias("x")).withColumn("class_id", F.lit(-1))
        pm = mean_probs_by_batch(d, self.probs_col, "_t", "x")
        n = d.groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
        grid = d.select("_t").distinct().select("_t", F.explode(F.sequence(F.lit(0), F.lit(K - 1))).alias("class_id"))
        h = (grid.join(d.groupBy("_t", F.col("_pl").alias("class_id")).agg(F.count(F.lit(1)).alias("_c")),
                       ["_t", "class_id"], "left").join(n, "_t")
             .select("_t", (F.col("class_id") + K).alias("class_id"), (F.coalesce("_c", F.lit(0)) / F.col("_n")).alias("x")))
        stats = tp.select("_t", "class_id", "x").unionByName(pm.select("_t", "class_id", "x")).unionByName(h)
        st = ema(stats.join(F.broadcast(init), "class_id"), ["class_id"], "_t", "x", m, F.col("_init"), "v")
        if self.clip:
            if d.agg(F.countDistinct("_t")).first()[0] > 1:
                raise ValueError("clip needs one step per micro-batch")
            st = st.withColumn("v", F.when(F.col("class_id") == -1, F.least(F.greatest("v", F.lit(0.0)), F.lit(0.95)))
                               .otherwise(F.col("v")))
        vec_pm = as_vector_per_batch(st.filter((F.col("class_id") >= 0) & (F.col("class_id") < K))
                                     .select("_t", "class_id", "v"), "_t", "v", "p_model")
        tpv = st.filter(F.col("class_id") == -1).select("_t", F.col("v").alias("time_p"))
        out = d.join(vec_pm, "_t").join(tpv, "_t")
        mod = F.element_at("p_model", F.col("_pl") + 1) / F.array_max("p_model")
        out = out.withColumn("mask", (F.col("_conf") >= F.col("time_p") * mod).cast("double"))
        write_epoch(out.drop("_t", "_conf", "_pl"), epoch_id, self.out_path)
        last = st.filter(F.col("_t") == st.agg(F.max("_t")).first()[0])
        write_epoch(last.select("class_id", "v"), epoch_id, self.state_dir)


def stream_curriculum_deltas(df: DataFrame, id_col: str = "row_id", batch_col: str = "batch_id",
                             probs_col: str = "probs", tau: float = 0.95) -> DataFrame:
    """STR4: per id, the last label selected with conf >= tau is kept as state;
    each new selection emits +1 for the new class and -1 for the old one.
    Summing the deltas per class gives FlexMatch's counts (see THR4)."""
    sel = df.select(id_col, batch_col, argmax(probs_col).alias("pl"), confidence(probs_col).alias("conf")) \
        .filter(F.col("conf") >= F.lit(tau))

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        for pdf in pdfs:
            for b, pl in sorted(zip(pdf[batch_col].tolist(), pdf["pl"].tolist())):
                if last is not None and last != pl:
                    rows.append((b, int(last), -1))
                if last != pl:
                    rows.append((b, int(pl), 1))
                last = int(pl)
        state.update((last,))
        yield pd.DataFrame(rows, columns=[batch_col, "class_id", "delta"])

    return sel.groupBy(id_col).applyInPandasWithState(
        step, f"{batch_col} long, class_id int, delta int", "last int", "append", GroupStateTimeout.NoTimeout)


def stream_prototypes(df: DataFrame, label_col: str, feat_col: str, batch_col: str, id_col: str, L: int) -> DataFrame:
    """STR5: per class a FIFO of the last L features (state bounded by L);
    emits the class prototype (mean of the FIFO) after each micro-batch."""

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fifo = list(state.get[0]) if state.exists else []
        for pdf in pdfs:
            newest = pdf.sort_values([batch_col, id_col])[feat_col].tail(L)
            fifo = (fifo + [[float(x) for x in v] for v in newest])[-L:]
        state.update((fifo,))
        k = len(fifo[0]) if fifo else 0
        proto = [sum(f[i] for f in fifo) / len(fifo) for i in range(k)] if fifo else []
        yield pd.DataFrame({label_col: [int(key[0])], "n": [len(fifo)], "proto": [proto]})

    return df.select(label_col, feat_col, batch_col, id_col).groupBy(label_col).applyInPandasWithState(
        step, f"{label_col} int, n int, proto array<double>", "fifo array<array<double>>", "update",
        GroupStateTimeout.NoTimeout)


def pseudo_label_distribution(df: DataFrame, ts_col: str, key_col: str, window: str = "1 day",
                              slide: str | None = None, watermark: str = "1 day") -> DataFrame:
    """STR6: rolling counts per (event-time window, pseudo-label); late rows
    follow Spark's watermark.  Works on a stream or a static frame."""
    w = F.window(ts_col, window, slide) if slide else F.window(ts_col, window)
    return (df.withWatermark(ts_col, watermark).groupBy(w.alias("w"), key_col)
            .agg(F.count(F.lit(1)).alias("n")))


def windowed_metrics(df: DataFrame, ts_col: str, truth: str, pred: str, mask_col: str | None = None,
                     window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """STR7: accuracy (and util ratio when a mask is given) per event-time window."""
    aggs = [F.count(F.lit(1)).alias("n"), F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy")]
    if mask_col:
        aggs.append(F.avg(F.col(mask_col).cast("double")).alias("util_ratio"))
    return df.withWatermark(ts_col, watermark).groupBy(F.window(ts_col, window).alias("w")).agg(*aggs)


def update_sink(stream: DataFrame, path: str, checkpoint: str):
    """Start ``stream`` (update mode, all that is there, then stop) into
    ``path``: each epoch writes its changed rows to its own folder, over what a
    replay of the epoch may have left there.  Returns the running query."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch}")

    return (stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(write).start())


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of each key among the epochs of ``update_sink``."""
    rows = spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/epoch=*")
    rest = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("epoch")).alias("_r")).select(*keys, "_r.*")
