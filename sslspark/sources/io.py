"""Sources and sinks (SRC1-11): Spark readers / writers only.

Excel workbooks have no Spark source: convert them upstream to parquet/CSV.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sslspark.session import path_exists

__all__ = [
    "CORPUS_SCHEMA", "read_corpus", "read_json_records", "read_json_lines", "read_path_label_list",
    "read_class_dirs", "read_shards", "export_pipe", "import_pipe", "write_split", "write_predictions",
    "write_class_distribution", "cached_split",
]

CORPUS_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in [
    "text", "location", "cell_line", "cell_type", "organ", "disease", "species", "relation", "subj", "obj"]])


def read_corpus(spark: SparkSession, path: str, columns: Sequence[str], fmt: str = "parquet",
                schema: T.StructType | None = None, **options) -> DataFrame:
    """SRC1: read a corpus and keep ``text`` + the task columns (pruned at the scan)."""
    r = spark.read.format(fmt).options(**options)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path).select(*columns)


_RECORD = T.MapType(T.StringType(), T.StructType([
    T.StructField("ori", T.StringType()), T.StructField("aug_0", T.StringType()),
    T.StructField("aug_1", T.StringType()), T.StructField("label", T.IntegerType())]))


def read_json_records(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """SRC2: ``{"<idx>": {"ori", "aug_0", "aug_1", "label"}}`` files -> one row
    per record with ``views = [ori, aug_0, aug_1]`` (train) or
    ``[ori, null, null]`` (dev / test).  One whole file per task: for large
    corpora write JSON lines and use ``read_json_lines``."""
    raw = spark.read.text(path, wholetext=True)
    recs = raw.select(F.explode(F.from_json("value", _RECORD)).alias("idx", "r"))
    return _views(recs.select(F.col("idx").cast("long").alias("idx"), "r.*"), split)


def read_json_lines(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """SRC2 at scale: one JSON object ``{"idx", "ori", "aug_0", "aug_1", "label"}`` per line."""
    schema = "idx long, ori string, aug_0 string, aug_1 string, label int"
    return _views(spark.read.schema(schema).json(path), split)


def _views(df: DataFrame, split: str) -> DataFrame:
    none = F.lit(None).cast("string")
    if split == "train":
        views = F.array("ori", "aug_0", "aug_1")
    else:
        views = F.array(F.col("ori"), none, none)
    return df.select("idx", views.alias("views"), F.col("label").cast("int").alias("label_id"))


def read_path_label_list(spark: SparkSession, path: str, sep: str = " ", extra: str | None = None) -> DataFrame:
    """SRC3: lines ``relative/path label``; an optional extra list is appended."""
    def one(p):
        t = spark.read.text(p).filter(F.length(F.trim("value")) > 0)
        parts = F.split("value", sep)
        return t.select(parts[0].alias("path"), parts[1].cast("int").alias("label_id"))
    out = one(path)
    return out.unionByName(one(extra)) if extra else out


def read_class_dirs(spark: SparkSession, root: str, extensions: Sequence[str] = ()) -> DataFrame:
    """SRC4: class = parent directory; id = rank of the sorted class names.

    Only file paths are read (the ``content`` column is never selected)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path"))
    if extensions:
        pat = "(?i)\\.(" + "|".join(e.lstrip(".") for e in extensions) + ")$"
        files = files.filter(F.col("path").rlike(pat))
    files = files.withColumn("class_name", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    classes = files.select("class_name").distinct()
    # one row per class: the ranking window is bounded by the number of classes
    classes = classes.withColumn("label_id", (F.dense_rank().over(Window.orderBy("class_name")) - 1).cast("int"))
    return files.join(classes, "class_name")


def read_shards(spark: SparkSession, glob: str, fmt: str = "parquet") -> DataFrame:
    """SRC5: sorted shard files concatenated; the shard name is kept as a column."""
    return spark.read.format(fmt).load(glob).withColumn("shard", F.input_file_name())


def export_pipe(df: DataFrame, path: str, id_col: str = "original_index", text_col: str = "text") -> None:
    """SRC6: pipe-delimited ``id|id|text`` without header (input of the text augmenter)."""
    (df.select(F.col(id_col).cast("string"), F.col(id_col).cast("string").alias("label"), text_col)
     .write.mode("overwrite").option("sep", "|").option("header", "false").option("quote", "\u0000").csv(path))


def import_pipe(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: ``id|label|sentence`` lines -> ``(original_index, line_no, label, sentence)``.

    Blank lines or lines starting with ``##`` are invalid and raise.
    ``line_no`` orders the lines by file name and offset: the rank of their
    part of a file (name, block start), then the place within it."""
    t = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start").alias("_part"),
                                     F.monotonically_increasing_id().alias("_at"))
    # one row for each part of a file; places count within the task, so they only grow inside a part
    parts = t.select("_part").distinct().withColumn("_rank", F.row_number().over(Window.orderBy("_part")) - 1)
    t = (t.join(parts, "_part")
         .withColumn("line_no", F.shiftleft(F.col("_rank").cast("long"), 33) + F.col("_at").bitwiseAND((1 << 33) - 1))
         .drop("_part", "_rank", "_at"))
    bad = t.filter(F.col("value").rlike(r"^##|^\s*$")).limit(1).count()
    if bad:
        raise ValueError("augmented data was not found")
    parts = F.split(F.regexp_replace("value", r"\s+$", ""), r"\|")
    return t.select(parts[0].cast("long").alias("original_index"), "line_no",
                    parts[1].alias("label"), parts[2].alias("sentence"))


def write_split(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """SRC8: train / test / OOD / augmented table sink."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_predictions(df: DataFrame, path: str, truth: str, pred: str, keep: Sequence[str] = ()) -> None:
    """SRC9: truth, prediction and the mismatch flag (Excel styling not built)."""
    from sslspark.operators.encode import flag_mismatch
    df.select(*keep, truth, pred, flag_mismatch(truth, pred).alias("mismatch")).write.mode("overwrite").parquet(path)


def write_class_distribution(counts: DataFrame, path: str, class_col: str = "class_id", share_col: str = "share") -> None:
    """SRC10: ``{"distribution": [...]}`` from a K-row distribution table."""
    doc = counts.select(F.to_json(F.struct(F.transform(
        F.array_sort(F.collect_list(F.struct(class_col, share_col))), lambda s: s[share_col]).alias("distribution")))
        .alias("value"))
    doc.coalesce(1).write.mode("overwrite").text(path)


def cached_split(spark: SparkSession, base: str, key: dict, compute: Callable[[], DataFrame]) -> DataFrame:
    """SRC11: reuse a saved split keyed by e.g. (num_labels, imbalance ratio,
    seed): read it when the key's folder exists, else compute and write it."""
    sub = "/".join(f"{k}={v}" for k, v in key.items())
    path = f"{base.rstrip('/')}/{sub}"
    if not path_exists(spark, f"{path}/_SUCCESS"):  # other errors of a saved split are raised, never written over
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
