"""Fixture views derived from the driver tables (see FIXTURES.md §3).

Each function reads whole tables from ``sf_dir`` and returns a lazy
DataFrame; the DuckDB twins live in ``sslspark.plans.sql_fixtures``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sslspark.constants import UNLABELLED
from sslspark.functions.arrays import softmax, to_double_array
from sslspark.operators.aggs import class_prototypes
from sslspark.operators.similarity import prototype_logits
from sslspark.operators.split import rank_select
from sslspark.session import table

BATCH_ROWS = 50          # rows per batch in the scored fixture
PROTO_T = 0.05           # prototype temperature
K_SCORED = 10

# Label spaces of the six-task ``contexts`` fixture (in-space values).
CONTEXT_SPACES = {
    "location": ["AFRICA", "AMERICA", "ASIA"],
    "cell_line": [f"NATION_{i}" for i in range(10)],
    "cell_type": ["BUILDING", "MACHINERY"],
    "organ": ["1-URGENT", "2-HIGH", "5-LOW"],
    "disease": ["F"],
    "species": ["Y1996", "Y1997", "Y1998"],
}
RELATION_SPACE = ["F", "O", "P"]
CONTEXT_TASKS = list(CONTEXT_SPACES)
ALLOWED_REGIONS = ["AFRICA", "AMERICA", "ASIA"]
VARIANT_COLS = ["umls", "sr", "ri", "rs", "rd", "original"]


IMB_GAMMA = 10           # head to tail ratio of the long-tailed fixture


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("label").cast("int").alias("label"),
        to_double_array("embedding").alias("emb"))


def scored(spark: SparkSession, sf_dir: str, strong: bool = False, keep_emb: bool = False) -> DataFrame:
    """FIXTURES 3.1 / 3.2: ``(row_id, batch_id, label_true, role, label_id, logits, probs)``."""
    emb = embeddings(spark, sf_dir)
    # the strong view's prototypes weigh all rows otherwise: 1, 2, 3, 4 in turn
    protos = class_prototypes(emb, "label", "emb", weight=F.col("row_id") % 4 + 1 if strong else None)
    lg = prototype_logits(emb, "emb", protos, PROTO_T)
    labelled = F.col("row_id") % 5 == 0
    cols = [
        "row_id", F.floor(F.col("row_id") / BATCH_ROWS).cast("long").alias("batch_id"),
        F.col("label").alias("label_true"),
        F.when(labelled, F.lit("labelled")).otherwise(F.lit("unlabelled")).alias("role"),
        F.when(labelled, F.col("label")).otherwise(F.lit(UNLABELLED)).cast("int").alias("label_id"),
        "logits", softmax("logits").alias("probs"),
    ]
    if keep_emb:
        cols.append("emb")
    return lg.select(*cols)


def imbalanced(spark: SparkSession, sf_dir: str, keep_emb: bool = False) -> DataFrame:
    """FIXTURES 3.3: long-tailed subset of ``scored`` (rank by md5 within label):
    n_c = int(n_max * (1/gamma)^(c/(K-1))), n_max = rows of the largest class."""
    s = scored(spark, sf_dir, keep_emb=keep_emb)
    largest = embeddings(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").cast("double")).scalar()
    share = F.pow(F.lit(1.0 / IMB_GAMMA), F.col("label_true") / F.lit(float(K_SCORED - 1)))
    return rank_select(s, ["label_true"], "row_id", 42,
                       {"_in": lambda n: F.floor(largest * share + 1e-9).cast("long")}).filter("_in").drop("_in")


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES 3.4: six-task wide corpus from orders x customer x nation x region."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    j = (o.join(c, o.o_custkey == c.c_custkey)
         .join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
         .join(F.broadcast(r), n.n_regionkey == r.r_regionkey))
    return j.select(
        F.col("o_orderkey").alias("original_index"),
        F.concat_ws(" ", "o_orderstatus", "c_name").alias("text"),
        F.col("r_name").alias("location"), F.col("n_name").alias("cell_line"),
        F.col("c_mktsegment").alias("cell_type"), F.col("o_orderpriority").alias("organ"),
        F.col("o_orderstatus").alias("disease"),
        F.concat(F.lit("Y"), F.year("o_orderdate").cast("string")).alias("species"),
        F.col("o_orderstatus").alias("relation"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES 3.5: documents left join labels (quality / toxic nullable, lang full)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id", "left")


def variant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES 3.6: long augmentation lines ``(original_index, line_no, sentence)``."""
    cv = table(spark, sf_dir, "conversations")
    return cv.select(F.col("conv_id").alias("original_index"), F.col("turn").alias("line_no"),
                     F.col("text").alias("sentence"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES 3.7: ``(row_key, subj, obj, species)`` from lineitem x orders."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    reg = F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name"))
    j = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
         .join(reg, F.col("c_nationkey") == reg.n_nationkey))
    return j.select(
        "l_orderkey", "l_linenumber",
        F.concat(F.lit("S#"), F.col("l_suppkey").cast("string")).alias("subj"),
        F.concat(F.lit("C#"), F.col("o_custkey").cast("string")).alias("obj"),
        F.col("r_name").alias("species"))


def _entity_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S#"), F.col("s_suppkey").cast("string")).alias("entity"), F.col("s_nationkey").alias("nk"))
    c = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C#"), F.col("c_custkey").cast("string")).alias("entity"), F.col("c_nationkey").alias("nk"))
    return s.unionByName(c)


def species_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary entity -> species_full dimension (only allowed regions)."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    reg = F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("nk"), "r_name"))
    return (_entity_nations(spark, sf_dir).join(reg, "nk")
            .filter(F.col("r_name").isin(ALLOWED_REGIONS))
            .select("entity", F.col("r_name").alias("species_full")))


def species_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallback entity -> candidate list: regions of the next and the previous
    nation.  Every entity has one; the pair resolution asks it only for those
    that the primary dimension does not know."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    reg = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("k"), "r_name")
    nxt = reg.select(((F.col("k") + 24) % 25).alias("nk"), F.col("r_name").alias("r_next"))
    prv = reg.select(((F.col("k") + 1) % 25).alias("nk"), F.col("r_name").alias("r_prev"))
    dim = F.broadcast(nxt.join(prv, "nk"))
    return _entity_nations(spark, sf_dir).join(dim, "nk").select("entity", F.array("r_next", "r_prev").alias("species"))


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES 3.8: daily share of purchases, as an evaluation series."""
    ev = table(spark, sf_dir, "events")
    return (ev.groupBy(F.to_date("ts").alias("day"))
            .agg(F.avg((F.col("event_type") == "purchase").cast("double")).alias("acc"))
            .withColumn("round_no", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("int")))
