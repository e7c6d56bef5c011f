"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sslspark.session import ensure_checkpoint_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and read
    it back.  Cuts the lineage: a lost executor costs no recomputation of what
    lies before, because the files are in shared storage."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(taken: Iterable[str], name: str) -> str:
    """A column name like ``name`` that is not taken (letter case aside)."""
    lower = {c.lower() for c in taken}
    name = f"_{name}"
    while name in lower:
        name += "_"
    return name


def lists(batches: Iterator[pa.RecordBatch], max_rows: int = 1000) -> Iterator[list[list]]:
    """Columns of each batch as Python lists, a bounded number of rows at a
    time; string columns come as UTF-8 ``bytes`` (no decoding)."""
    for batch in batches:
        for at in range(0, batch.num_rows, max_rows):
            part = batch.slice(at, max_rows)
            yield [(c.cast(pa.binary()) if pa.types.is_string(c.type) else c).to_pylist() for c in part.columns]


def _is_star(edges: DataFrame) -> bool:
    """True when each node has one smaller neighbour at most and that one is a root."""
    n, heads = edges.agg(F.count("*"), F.count_distinct("u")).first()
    if n != heads:
        return False
    return edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``edges`` that is not itself a root;
    ``root`` is the smallest node reachable.  Alternating large-star and
    small-star rounds: only pairs (node, minimum) are shuffled, each round is
    written to the shared folder, and the driver sees two counts a round."""
    cur = stored(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while not _is_star(cur):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))))
        cur = stored(small.distinct(), "edges")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
