"""Sharding by extendible hashing.

A row's place is the bit string of its key's hash.  The directory starts as
one bucket; a bucket that holds more bytes than a shard may have is split on
the next bit, the others stay as they are.  Twelve bits are settled in one
round from a histogram of at most 4096 entries for each bucket still too
large, so rows are never moved to find the directory, and a histogram is summed
before it is shuffled.

After 60 bits of the key's hash, rows of one key go on with 60 bits of a hash
of the whole row; rows equal in all columns are then dealt in pages.  So a key
with any share of the rows is split too; only a single row larger than the
limit gets a shard above it (``oversize``).

Defined cases: a null text has 0 bytes; null keys are one key; repeated rows are
dealt in pages if they must be; an empty table gives no rows; further columns
only take part in the hash of the whole row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from sslspark.llm.common import stored

ROUND = 12  # bits settled in a round
WORD = 60   # bits of a hash


def key_hash(key: str) -> Column:
    """60 bits of a key's MD5, as SQL engines have it."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _bits(number: Column | str, width: int | Column) -> Column:
    digits = F.concat(F.lit("0" * WORD), F.bin(number))
    return F.when(F.lit(width) > 0, F.right(digits, F.lit(width))).otherwise("")


def _hashable(field: StructField) -> Column:
    """A column for a row's hash; Spark has none of maps, so their text is taken."""
    c = F.col(f"`{field.name}`")
    return F.to_json(F.struct(c)) if "map<" in field.dataType.simpleString() else c


def assign(docs: DataFrame, max_bytes: int, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<key>, bytes, shard, depth, shard_bytes, oversize`` for every row:
    the shard's name is its bit string, with the page after a dot."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = stored(docs.select(
        key, size.alias("bytes"), key_hash(key).alias("h"),
        F.shiftrightunsigned(F.xxhash64(*[_hashable(f) for f in docs.schema]), 64 - WORD).alias("h2"), F.monotonically_increasing_id().alias("row")), "rows")
    live = rows.withColumn("path", F.lit(""))
    done = []
    for k in range(2 * WORD // ROUND):
        down = WORD - ROUND * (k % (WORD // ROUND) + 1)
        live = live.withColumn("sub", F.shiftright("h" if k < WORD // ROUND else "h2", down).bitwiseAND((1 << ROUND) - 1))
        hist = live.groupBy("path", "sub").agg(F.sum("bytes").alias("bytes"))
        node = Window.partitionBy("path", "d", F.expr(f"shiftright(sub, {ROUND} - d)"))
        nodes = (hist.withColumn("d", F.explode(F.sequence(F.lit(min(k, 1)), F.lit(ROUND))))
                 .withColumn("total", F.sum("bytes").over(node)))
        directory = stored(nodes.groupBy("path", "sub").agg(
            F.min(F.when(F.col("total") <= max_bytes, F.struct("d", "total"))).alias("leaf")), "directory")
        found = live.join(directory, ["path", "sub"])
        done.append(found.where("leaf IS NOT NULL").select(
            key, "bytes", F.concat("path", F.expr(f"IF(leaf.d = 0, '', left(lpad(bin(sub), {ROUND}, '0'), leaf.d))")).alias("shard"),
            (F.col("leaf.d") + ROUND * k).alias("depth"), F.col("leaf.total").alias("shard_bytes"), F.lit(False).alias("oversize")))
        if directory.where("leaf IS NULL").isEmpty():
            break
        live = (found.where("leaf IS NULL").withColumn("path", F.concat("path", F.expr(f"lpad(bin(sub), {ROUND}, '0')")))
                .drop("sub", "leaf"))
    else:
        done.append(_pages(stored(live, "equal"), max_bytes, key))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _pages(live: DataFrame, max_bytes: int, key: str) -> DataFrame:
    """Rows equal in all hash bits, numbered in two passes (counts of each
    reading task, then places within it) and dealt in pages."""
    live = live.withColumn("task", F.shiftright("row", 33))
    before = Window.partitionBy("path").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = (live.groupBy("path", "task").agg(F.count("*").alias("n"))
              .select("path", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    place = F.row_number().over(Window.partitionBy("path", "task").orderBy("row")) - 1
    each = live.withColumn("place", place).join(counts, ["path", "task"]).withColumn("place", F.col("place") + F.col("base"))
    per_page = F.greatest(F.lit(1), F.floor(F.lit(max_bytes) / F.greatest("bytes", F.lit(1))))
    paged = each.withColumn("page", F.floor(F.col("place") / per_page)).withColumn("shard", F.concat_ws(".", "path", F.col("page").cast("string")))
    totals = paged.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"))
    return paged.join(totals, "shard").select(
        key, "bytes", "shard", F.lit(2 * WORD).alias("depth"), "shard_bytes", (F.col("shard_bytes") > max_bytes).alias("oversize"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write ``docs`` (unique keys) with one folder a shard."""
    placed = docs.join(assigned.select(key, F.concat(F.lit("s"), "shard").alias("shard")), key)
    placed.repartition("shard").write.partitionBy("shard").parquet(path)


def oracle_sql(max_bytes: int) -> str:
    """DuckDB twin for tables whose buckets all fit after 40 bits."""
    return f"""
WITH r AS (
  SELECT doc_id, COALESCE(strlen(text), 0) AS bytes,
         ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS h FROM documents),
d AS (SELECT r.*, t.d AS depth, h >> CAST({WORD} - t.d AS BIGINT) AS p FROM r, range(0, 41) t(d)),
s AS (SELECT *, SUM(bytes) OVER (PARTITION BY depth, p) AS total FROM d),
l AS (SELECT doc_id, h, bytes, MIN(depth) AS depth, arg_min(total, depth) AS total FROM s WHERE total <= {max_bytes}
      GROUP BY doc_id, h, bytes)
SELECT doc_id, CAST(bytes AS BIGINT) AS bytes,
       CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> CAST({WORD} - depth AS BIGINT)), CAST(depth AS INT), '0') END AS shard,
       CAST(depth AS INT) AS depth, CAST(total AS BIGINT) AS shard_bytes, FALSE AS oversize FROM l"""
