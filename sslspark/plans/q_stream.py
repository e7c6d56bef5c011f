"""Streaming operators, on static frames and on streams (same builders)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sslspark.plans import fixtures as fx
from sslspark.plans.catalog import query, r6
from sslspark.plans.q_sources import scratch
from sslspark.plans.sql_fixtures import with_ctes
from sslspark.session import table
from sslspark.streaming import stream


@query("str1_stream_score_and_mask", with_ctes("scored") + """
SELECT batch_id, CAST(sum(CASE WHEN list_max(probs) >= 0.95 THEN 1 ELSE 0 END) AS BIGINT) AS n_masked,
       CAST(sum(CASE WHEN label_id = -200 AND list_max(probs) < 0.9 THEN 1 ELSE 0 END) AS BIGINT) AS n_ood
FROM scored GROUP BY batch_id""")
def q_str1(spark, sf):
    s = stream.stream_score_and_mask(fx.scored(spark, sf))
    return s.groupBy("batch_id").agg(F.sum(F.col("mask").cast("long")).alias("n_masked"),
                                     F.sum((F.col("label_id") == -100).cast("long")).alias("n_ood"))


@query("str6_pseudo_label_distribution", """
SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY ALL""")
def q_str6(spark, sf):
    ev = table(spark, sf, "events")
    d = stream.pseudo_label_distribution(ev, "ts", "event_type", "6 hours")
    return d.select(F.col("w.start").alias("window_start"), "event_type", "n")


@query("str7_stream_metrics", """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, CAST(count(*) AS BIGINT) AS n,
       round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(avg(CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END), 6) AS util_ratio
FROM events GROUP BY 1""")
def q_str7(spark, sf):
    ev = table(spark, sf, "events").withColumns({
        "truth": F.lit("purchase"), "mask": (F.col("value") >= 50).cast("double")})
    m = stream.windowed_metrics(ev, "ts", "truth", "event_type", "mask", "1 day")
    return m.select(F.col("w.start").alias("window_start"), "n", r6("accuracy"), r6("util_ratio"))


# --- on a stream: the events arrive in four parts, each over the whole time, so later parts bring late rows

PARTS = 4


def arriving(spark, sf, build, keys: list[str]):
    """``build(stream)`` over the events as they arrive, part by part: each part
    is put into the source's folder, and the query goes on from its checkpoint."""
    folder = scratch(spark, "events")
    ev = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant
    for k in range(PARTS):
        ev.where(F.col("event_id") % PARTS == k).write.parquet(f"{folder}/in/part{k}")
        src = spark.readStream.schema(ev.schema).parquet(f"{folder}/in/*")
        stream.update_sink(build(src), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return stream.latest_rows(spark, f"{folder}/out", keys)


def _kept_sql(step: str) -> str:
    """Events that the watermark (a day behind the parts before) lets into their window."""
    return (f"SELECT *, time_bucket(INTERVAL {step}, ts) AS window_start FROM (SELECT *, event_id % {PARTS} AS k FROM events) e WHERE k = 0 OR "
            f"time_bucket(INTERVAL {step}, ts) + INTERVAL {step} > (SELECT max(ts) FROM events p WHERE p.event_id % {PARTS} < e.k) - INTERVAL 1 DAY")


@query("str6_distribution_on_stream", f"""
SELECT window_start, event_type, CAST(count(*) AS BIGINT) AS n FROM ({_kept_sql('6 HOUR')}) GROUP BY ALL""")
def q_str6_stream(spark, sf):
    d = arriving(spark, sf, lambda s: stream.pseudo_label_distribution(s, "ts", "event_type", "6 hours"), ["w", "event_type"])
    return d.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("str7_metrics_on_stream", f"""
SELECT window_start, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(avg(CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END), 6) AS util_ratio FROM ({_kept_sql('1 DAY')}) GROUP BY ALL""")
def q_str7_stream(spark, sf):
    def build(src):
        ev = src.withColumns({"truth": F.lit("purchase"), "mask": (F.col("value") >= 50).cast("double")})
        return stream.windowed_metrics(ev, "ts", "truth", "event_type", "mask", "1 day")

    m = arriving(spark, sf, build, ["w"])
    return m.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", r6("accuracy"), r6("util_ratio"))
