"""Batch-ordered state as windows over per-batch aggregates (WIN9-13).

The reference updates small state once per batch (EMA vectors, ring
queues, running counts).  Here N rows are first reduced to B x K per-batch
aggregates; the recurrences then run over those rows.  Steps may have gaps or
start anywhere: every scan numbers the distinct steps it gets 0..B-1 first.

Scale: no recurrence runs as one window over all B steps of a key.  The
steps are cut into chunks of C; each chunk is scanned in its own window
partition, and chunk results are carried to the next chunk with a join:

* running sums (a = 1): carry = sum of all earlier chunk totals, a window
  over the B/C chunk totals;
* EMAs (0 <= a < 1): C is chosen so that a^C < e^-40 (below double
  precision), so only the previous chunk's end value carries in; within a
  chunk the factored prefix sum a^off * sum(a^-off_s * b_s) stays below e^40.

* clamped steps (EMA, then a clip): x -> min(max(a x + b, lo), hi) with a >= 0
  are closed under composition, so a chunk of steps is one such step; chunks
  are folded over the composed steps, then inside.

All are exact to double precision, and independent of the number of steps.  A
scan writes its B x K input once (a reliable checkpoint), as it is read for the
steps' numbers, the chunks and their ends; rows are not read again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sslspark.session import cut_lineage

__all__ = ["linear_scan", "clamped_scan", "ema", "running_sum", "queue_mean", "batch_class_grid", "as_vector_per_batch",
           "last_value", "dense_steps"]

DEFAULT_CHUNK = 4096


def dense_steps(df: DataFrame, t_col: str, out: str = "_step") -> DataFrame:
    """``(t_col, out)``: the distinct steps and their ordinals.  Numbered in
    two levels (ranges of steps, then inside a range); one row for each step."""
    steps = df.select(t_col).distinct().withColumn("_r", F.floor(F.col(t_col) / F.lit(DEFAULT_CHUNK)))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = steps.groupBy("_r").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_r").orderBy(t_col)) - 1
    return (steps.withColumn("_i", inside).join(ranges, "_r").select(t_col, (F.col("_base") + F.col("_i")).cast("long").alias(out)))


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def linear_scan(df: DataFrame, keys: Sequence[str], t_col: str, b_col: str, a: float, init=0.0,
                out: str = "v", chunk: int | None = None) -> DataFrame:
    """v_t = a * v_{t-1} + b_t per key, v_{-1} = init; adds column ``out``."""
    keys = list(keys)
    a = float(a)
    if a < 0 or a > 1:
        raise ValueError("scan factor must be in [0, 1]")
    if a == 0.0:
        return df.withColumn(out, F.col(b_col).cast("double"))
    if a == 1.0:
        return running_sum(df, keys, t_col, b_col, out, chunk, init)
    df = cut_lineage(df)
    return _scan(df.join(dense_steps(df, t_col), t_col), keys, b_col, a, init, out, chunk).drop("_step")


def _scan(df: DataFrame, keys: list[str], b_col: str, a: float, init, out: str, chunk: int | None) -> DataFrame:
    """``linear_scan`` over the dense ordinal ``_step``."""
    # a chunk must be long enough that a^C is below double precision
    C = max(chunk or 0, math.ceil(40.0 / math.log(1.0 / a)), 1)
    la = math.log(a)
    t = F.col("_step")
    d = df.withColumn("_c", F.floor(t / F.lit(C)).cast("long")).withColumn("_off", (t - F.col("_c") * C).cast("double"))
    term = F.col(b_col).cast("double") * F.exp(-F.col("_off") * F.lit(la))          # b * a^-off
    w = Window.partitionBy(*keys, "_c").orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_local", F.exp(F.col("_off") * F.lit(la)) * F.sum(term).over(w))
    ends = (d.groupBy(*keys, "_c").agg((F.lit(math.exp((C - 1) * la)) * F.sum(term)).alias("_end"))
            .withColumn("_c", F.col("_c") + 1))
    d = d.join(ends, [*keys, "_c"], "left")
    carry = F.when(F.col("_c") == 0, _lit(init)).otherwise(F.coalesce(F.col("_end"), F.lit(0.0)))
    d = d.withColumn(out, F.col("_local") + F.exp((F.col("_off") + 1) * F.lit(la)) * carry)
    return d.drop("_c", "_off", "_local", "_end")


def running_sum(df: DataFrame, keys: Sequence[str], t_col: str, x_col: str, out: str = "v",
                chunk: int | None = None, init=0.0) -> DataFrame:
    """Inclusive running sum per key in two levels (chunks, then chunk totals)."""
    keys = list(keys)
    C = chunk or DEFAULT_CHUNK
    d = cut_lineage(df).withColumn("_c", F.floor(F.col(t_col) / F.lit(C)).cast("long"))
    w = Window.partitionBy(*keys, "_c").orderBy(t_col).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_local", F.sum(F.col(x_col).cast("double")).over(w))
    tot = d.groupBy(*keys, "_c").agg(F.sum(F.col(x_col).cast("double")).alias("_tot"))
    wc = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("_carry", F.coalesce(F.sum("_tot").over(wc), F.lit(0.0))).drop("_tot")
    d = d.join(tot, [*keys, "_c"], "left")
    return d.withColumn(out, F.col("_local") + F.col("_carry") + _lit(init)).drop("_c", "_local", "_carry")


def ema(df: DataFrame, keys: Sequence[str], t_col: str, x_col: str, m: float, init=None,
        out: str = "v", chunk: int | None = None) -> DataFrame:
    """WIN10: v_t = m * v_{t-1} + (1 - m) * x_t.

    ``init=None``: the first step *sets* v (v_0 = x_0), later steps blend
    (trap T12).  Otherwise v_{-1} = init (a number or a Column)."""
    b = F.lit(1.0 - m) * F.col(x_col)
    if init is not None or m in (0.0, 1.0):
        if init is None and m == 1.0:
            raise ValueError("a scan with m = 1 needs an initial value")
        return linear_scan(df.withColumn("_b", b), keys, t_col, "_b", m, 0.0 if init is None else init, out, chunk).drop("_b")
    df = cut_lineage(df)
    d = df.join(dense_steps(df, t_col), t_col).withColumn("_b", F.when(F.col("_step") == 0, F.col(x_col)).otherwise(b))
    return _scan(d, list(keys), "_b", float(m), 0.0, out, chunk).drop("_b", "_step")


def _clamp(x: Column, f: Column) -> Column:
    return F.least(F.greatest(x, f["lo"]), f["hi"])


def _after(f: Column, g: Column) -> Column:
    """The clamped step ``g`` after ``f``, as one step."""
    def at(x: Column) -> Column:
        return _clamp(g["a"] * x + g["b"], g)
    return F.struct((g["a"] * f["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"), at(f["lo"]).alias("lo"), at(f["hi"]).alias("hi"))


def clamped_scan(df: DataFrame, keys: Sequence[str], t_col: str, b_col: str, a: float, lo: float, hi: float, init: float,
                 out: str = "v", chunk: int = 256) -> DataFrame:
    """v_t = min(max(a * v_{t-1} + b_t, lo), hi) per key, v_{-1} = init, a >= 0.

    Three levels: steps are composed to chunks, chunks to super-chunks; a key's
    super-chunks (B / chunk^2 rows) are folded one after the other, then the
    chunks of each, then the steps of each: no more than ``chunk`` steps, or one
    array of B / chunk^2, meet in a task."""
    if a < 0:
        raise ValueError("a clamped scan needs a factor of 0 or more")
    keys = list(keys)
    df = cut_lineage(df)
    inf = F.lit(float("inf"))
    same = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), (-inf).alias("lo"), inf.alias("hi"))
    step = F.struct(F.lit(float(a)).alias("a"), F.col(b_col).cast("double").alias("b"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))

    def grouped(rows: DataFrame, by: list[str], order: str) -> DataFrame:
        fs = F.transform(F.array_sort(F.collect_list(F.struct(order, "f"))), lambda s: s["f"])
        return rows.groupBy(*by).agg(fs.alias("fs"), F.array_sort(F.collect_list(order)).alias("at"))

    def starts(rows: DataFrame, before: Column, order: str, value: str) -> DataFrame:
        """A row for each member: the value before it."""
        trail = F.aggregate(F.expr("slice(fs, 1, size(fs) - 1)"), F.array(before),
                            lambda acc, f: F.concat(acc, F.array(_clamp(f["a"] * F.element_at(acc, -1) + f["b"], f))))
        by = [c for c in rows.columns if c not in ("fs", "at", "v0")]
        return (rows.select(*by, F.explode(F.arrays_zip(F.col("at"), trail.alias("v"))).alias("z"))
                .select(*by, F.col("z.at").alias(order), F.col("z.v").alias(value)))

    d = df.join(dense_steps(df, t_col), t_col)
    d = (d.withColumn("_c", F.floor(F.col("_step") / F.lit(chunk)).cast("long"))
         .withColumn("_u", F.floor(F.col("_step") / F.lit(chunk * chunk)).cast("long")))
    composed = F.aggregate("fs", same, _after)
    chunks = cut_lineage(grouped(d.select(*keys, "_u", "_c", "_step", step.alias("f")), [*keys, "_u", "_c"], "_step"))
    supers = grouped(chunks.select(*keys, "_u", "_c", composed.alias("f")), [*keys, "_u"], "_c")
    tops = grouped(supers.select(*keys, "_u", composed.alias("f")), keys, "_u")
    at_super = starts(tops, F.lit(float(init)), "_u", "v0")
    at_chunk = starts(supers.join(at_super, [*keys, "_u"]), F.col("v0"), "_c", "v0")
    at_step = starts(chunks.join(at_chunk, [*keys, "_u", "_c"]), F.col("v0"), "_step", "_before").select(*keys, "_step", "_before")
    value = F.least(F.greatest(F.lit(float(a)) * F.col("_before") + F.col(b_col), F.lit(float(lo))), F.lit(float(hi)))
    return d.join(at_step, [*keys, "_step"]).withColumn(out, value).drop("_step", "_c", "_u", "_before")


def queue_mean(df: DataFrame, keys: Sequence[str], t_col: str, x_col: str, L: int, out: str = "v",
               chunk: int | None = None) -> DataFrame:
    """WIN9: sum of the last L values / L (the queue starts as zeros, T11).

    Rows are scanned per (key, chunk); the last L-1 rows of each chunk are
    copied into the next chunk so every frame is complete."""
    keys = list(keys)
    C = max(chunk or DEFAULT_CHUNK, L)
    df = cut_lineage(df)
    d = df.join(dense_steps(df, t_col), t_col).withColumn("_c", F.floor(F.col("_step") / F.lit(C)).cast("long"))
    off = F.col("_step") - F.col("_c") * C
    owners = F.when(off >= F.lit(C - (L - 1)), F.array(F.col("_c"), F.col("_c") + 1)).otherwise(F.array(F.col("_c")))
    d = d.withColumn("_own", F.col("_c")).withColumn("_c", F.explode(owners))
    w = Window.partitionBy(*keys, "_c").orderBy("_step").rowsBetween(-(L - 1), 0)
    d = d.withColumn(out, F.sum(F.col(x_col).cast("double")).over(w) / F.lit(float(L)))
    return d.filter(F.col("_c") == F.col("_own")).drop("_c", "_own", "_step")


def batch_class_grid(batches: DataFrame, batch_col: str, K: int) -> DataFrame:
    """Every (batch, class) pair for the batches present (B x K rows)."""
    return batches.select(batch_col).distinct().select(
        batch_col, F.explode(F.sequence(F.lit(0), F.lit(K - 1))).alias("class_id"))


def as_vector_per_batch(long_state: DataFrame, batch_col: str, value_col: str, out: str) -> DataFrame:
    """(batch, class_id, value) -> (batch, K-array ordered by class)."""
    return long_state.groupBy(batch_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("class_id", value_col))), lambda s: s[value_col]).alias(out))


def last_value(df: DataFrame, keys: Sequence[str], t_col: str, x_col: str, init: float, out: str, chunk: int | None = None) -> DataFrame:
    """The last non-null ``x`` up to each step per key (``init`` before any),
    in two levels: inside chunks of steps, then the chunks' last values."""
    keys = list(keys)
    d = cut_lineage(df).withColumn("_c", F.floor(F.col(t_col) / F.lit(chunk or DEFAULT_CHUNK)).cast("long"))
    w = Window.partitionBy(*keys, "_c").orderBy(t_col).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_local", F.last(x_col, ignorenulls=True).over(w))
    ends = d.groupBy(*keys, "_c").agg(F.max_by(F.col(x_col), F.when(F.col(x_col).isNotNull(), F.col(t_col))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_c", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    return (d.join(ends, [*keys, "_c"]).withColumn(out, F.coalesce("_local", "_carry", F.lit(float(init)))).drop("_c", "_local", "_carry"))
