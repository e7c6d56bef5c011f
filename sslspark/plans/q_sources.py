"""Sources and sinks (SRC2-11): each query writes rows of the driver tables
below the shared checkpoint folder, in the format the reader expects, and
reads them back through the operator."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sslspark.plans import fixtures as fx
from sslspark.plans import corpus_jobs
from sslspark.plans.catalog import query, r6
from sslspark.plans.sql_fixtures import with_ctes
from sslspark.session import ensure_checkpoint_dir, table
from sslspark.sources import io

CLEAN = "regexp_replace({0}, '[|\\s]+', ' ', 'g')"


def scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sslspark-{uuid.uuid4().hex}/{name}"


RECORD_SQL = """
SELECT c_custkey AS idx, CAST(c_nationkey AS INTEGER) AS label_id, c_name AS ori, c_mktsegment AS aug_0, {aug_1} AS aug_1 FROM customer"""


def _records(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("idx"), F.col("c_name").alias("ori"), F.col("c_mktsegment").alias("aug_0"),
        F.reverse("c_name").alias("aug_1"), F.col("c_nationkey").cast("int").alias("label"))


def _flat(views):
    return views.select("idx", "label_id", F.col("views")[0].alias("ori"), F.col("views")[1].alias("aug_0"), F.col("views")[2].alias("aug_1"))


@query("src2_json_records", RECORD_SQL.format(aug_1="reverse(c_name)"))
def q_src2(spark, sf):
    path = scratch(spark, "records")
    r = _records(spark, sf).withColumn("part", F.floor(F.col("idx") / 1000))  # a file holds 1000 records at most
    entry = F.struct(F.col("idx").cast("string"), F.struct("ori", "aug_0", "aug_1", "label"))
    files = r.groupBy("part").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    files.repartition("part").write.partitionBy("part").text(path)
    return _flat(io.read_json_records(spark, path, "train"))


@query("src2_json_lines_eval", RECORD_SQL.format(aug_1="CAST(NULL AS VARCHAR)").replace("c_mktsegment AS aug_0", "CAST(NULL AS VARCHAR) AS aug_0"))
def q_src2_lines(spark, sf):
    path = scratch(spark, "lines")
    _records(spark, sf).write.json(path)
    return _flat(io.read_json_lines(spark, path, "test"))


@query("src3_path_label_list", """
SELECT 'img/' || CAST(vec_id AS VARCHAR) || '.png' AS path, CAST(label AS INTEGER) AS label_id FROM embeddings
UNION ALL SELECT 'more/' || CAST(doc_id AS VARCHAR) || '.png', CAST(quality AS INTEGER) FROM labels WHERE quality IS NOT NULL""")
def q_src3(spark, sf):
    a, b = scratch(spark, "list"), scratch(spark, "extra")
    table(spark, sf, "embeddings").select(F.concat(F.lit("img/"), "vec_id", F.lit(".png "), "label")).write.text(a)
    (table(spark, sf, "labels").where("quality IS NOT NULL")
     .select(F.concat(F.lit("more/"), "doc_id", F.lit(".png "), "quality")).write.text(b))
    return io.read_path_label_list(spark, a, extra=b)


@query("src4_class_dirs", """
SELECT class_name, CAST(dense_rank() OVER (ORDER BY class_name) - 1 AS INTEGER) AS label_id FROM (
  SELECT DISTINCT 'lang=' || lang AS class_name FROM documents WHERE lang IS NOT NULL)""")
def q_src4(spark, sf):
    path = scratch(spark, "classes")
    table(spark, sf, "documents").where("lang IS NOT NULL").select("doc_id", "lang").write.partitionBy("lang").json(path)
    return io.read_class_dirs(spark, path, ["json"]).select("class_name", "label_id").distinct()


@query("src5_shard_glob", "SELECT CAST(o_orderkey % 4 AS INTEGER) AS shard_no, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def q_src5(spark, sf):
    path = scratch(spark, "shards")
    table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).cast("int").alias("k")).write.partitionBy("k").parquet(path)
    s = io.read_shards(spark, f"{path}/k=*")
    return s.groupBy(F.regexp_extract("shard", r"/k=(\d+)/", 1).cast("int").alias("shard_no")).agg(F.count(F.lit(1)).alias("n"))


@query("src6_src7_pipe_round_trip", f"""
SELECT conv_id AS original_index, CAST(conv_id AS VARCHAR) AS label, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(length(rtrim({CLEAN.format("text")}))) AS BIGINT) AS chars FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def q_src67(spark, sf):
    path = scratch(spark, "pipe")
    clean = table(spark, sf, "conversations").where("text IS NOT NULL").select(
        "conv_id", F.regexp_replace("text", r"[|\s]+", " ").alias("text"))
    io.export_pipe(clean, path, "conv_id", "text")
    return (io.import_pipe(spark, path).groupBy("original_index", "label")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.rtrim("sentence"))).alias("chars")))


@query("src8_write_split", with_ctes("scored") + "SELECT role, batch_id, CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY ALL")
def q_src8(spark, sf):
    path = scratch(spark, "split")
    io.write_split(fx.scored(spark, sf).select("row_id", "batch_id", "role"), path, ["role"])
    return spark.read.parquet(path).groupBy("role", "batch_id").agg(F.count(F.lit(1)).alias("n"))


@query("src9_write_predictions", """
SELECT doc_id, CAST(quality AS INTEGER) AS truth, CAST(toxic AS INTEGER) AS pred, quality <> toxic AS mismatch
FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def q_src9(spark, sf):
    path = scratch(spark, "predictions")
    lab = table(spark, sf, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL").select(
        "doc_id", F.col("quality").cast("int").alias("truth"), F.col("toxic").cast("int").alias("pred"))
    io.write_predictions(lab, path, "truth", "pred", ["doc_id"])
    return spark.read.parquet(path)


@query("src10_class_distribution", """
SELECT class_id, round(n / sum(n) OVER (), 6) AS share FROM (
  SELECT CAST(label AS INTEGER) AS class_id, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label)""")
def q_src10(spark, sf):
    path = scratch(spark, "distribution")
    from sslspark.operators import aggs
    counts = table(spark, sf, "embeddings").where("label IS NOT NULL").groupBy(F.col("label").cast("int").alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    io.write_class_distribution(aggs.class_distribution(counts), path)
    parsed = F.from_json("value", "distribution array<double>")["distribution"]
    return spark.read.text(path).select(F.posexplode(parsed).alias("class_id", "s")).select("class_id", r6("s", "share"))


@query("src11_cached_split", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings WHERE vec_id % 10 < 3")
def q_src11(spark, sf):
    base, key = scratch(spark, "cached"), {"num_labels": 30, "seed": 1}
    e = table(spark, sf, "embeddings").select("vec_id")
    io.cached_split(spark, base, key, lambda: e.where("vec_id % 10 < 3"))
    again = io.cached_split(spark, base, key, lambda: e.limit(0))  # the saved one is read
    return again.agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"))


@query("job11_augmentation_round_trip", """
SELECT c_custkey, c_name, c_name AS first, lower(c_name) AS second, CASE WHEN c_custkey % 2 = 0 THEN reverse(c_name) END AS third FROM customer""")
def q_job11(spark, sf):
    """JOB11: the augmenter here is a Spark job over the folders, two or three variants an id."""
    def augment(source: str, target: str) -> None:
        t = spark.read.option("sep", "|").schema("id long, label string, text string").csv(source)
        three = F.array("text", F.lower("text"), F.reverse("text"))
        lines = t.select("id", "label", F.posexplode(F.when(F.col("id") % 2 == 0, three).otherwise(F.slice(three, 1, 2))).alias("k", "v"))
        lines.sort("id", "k").select(F.concat_ws("|", "id", "label", "v")).write.text(target)

    corpus = table(spark, sf, "customer").select("c_custkey", "c_name")
    return corpus_jobs.augmentation_round_trip(corpus, scratch(spark, "augmented"), augment, ["first", "second", "third"], "c_custkey", "c_name")
