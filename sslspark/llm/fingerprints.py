"""Document fingerprints: a threshold-scaled sketch.

Of the hashes of a text's word shingles the sketch keeps all that lie below a
fixed fraction of the hash range, so its size follows the text and two
sketches can be compared, merged (union) and used for containment whatever the
texts' lengths.  Where no hash is below the threshold the smallest one is kept,
so that only a text without words has an empty sketch.

A fingerprint is the sorted distinct kept hashes, 16 hex digits each.

Defined cases: a null text is an empty text; texts with fewer words than a
shingle have one shingle, all their words; two empty fingerprints have
likeness 1, an empty and another one 0; repeated rows are compared like any
neighbours; ties of the order are broken by the text; rows without an id come
last; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

_MIX = np.uint64(0x9E3779B97F4A7C15)


def sketch(text: bytes, words: int = 5, scale: int = 8) -> np.ndarray:
    """Sorted distinct shingle hashes below 2**64 / scale of a UTF-8 text."""
    import xxhash
    found = text.split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    span = min(words, len(h))
    with np.errstate(over="ignore"):
        mixed = np.zeros(len(h) - span + 1, np.uint64)
        for j in range(span):
            mixed = mixed * _MIX + h[j:j + len(mixed)]
        mixed ^= mixed >> np.uint64(30)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(27)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
    kept = mixed[mixed < np.uint64((1 << 64) // scale)]
    return np.unique(kept if len(kept) else mixed.min(keepdims=True))


def as_text(kept: np.ndarray) -> str:
    return kept.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated resemblance (shared of all shingles)."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def containment(a: np.ndarray, b: np.ndarray, scale: int = 8) -> float:
    """Estimated share of the smaller text's shingles that the other one has.
    Hashes kept above the threshold only count where both texts have no others."""
    below = [x[x < np.uint64((1 << 64) // scale)] for x in (a, b)]
    if len(below[0]) or len(below[1]):
        a, b = below
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, scale: int = 8) -> DataFrame:
    """``<id>, fingerprint`` of every row."""
    kind, arrow_kind = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                prints = [as_text(sketch(t or b"", words, scale)) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow_kind), pa.array(prints, pa.string())], names=[id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def merge(fingerprints: DataFrame, by: list[str], column: str = "fingerprint", scale: int = 8) -> DataFrame:
    """Fingerprints of whole groups (a source, a shard): the union of the
    members' hashes below the threshold, which is the sketch of the union of
    their shingles.  Returned one hash a row (``*by, hash``), so that a group
    with any share of the rows stays spread out."""
    parts = F.expr(f"transform(sequence(1, length({column}) div 16), i -> substring({column}, 16 * i - 15, 16))")
    return (fingerprints.where(F.length(column) > 0).select(*by, F.explode(parts).alias("hash"))
            .where(F.col("hash") < f"{(1 << 64) // scale:016x}").distinct())


def containment_of_groups(members: DataFrame, by: list[str], other: DataFrame) -> DataFrame:
    """Share of each group's hashes (``merge``) that the merged ``other(hash)`` holds."""
    known = other.select("hash").distinct().withColumn("_k", F.lit(1))
    return members.join(known, "hash", "left").groupBy(*by).agg((F.count("_k") / F.count("*")).alias("containment"))


def _number(docs: DataFrame, id_col: str) -> Column:
    """A number in the order of the ids; of strings the six bytes after those that
    all of them share (ids that agree there too lie in one bucket)."""
    if docs.schema[id_col].dataType.simpleString() not in ("string", "binary"):
        return F.col(id_col).cast("double")
    own = F.col(id_col).cast("binary")
    first, last = docs.agg(F.min(own), F.max(own)).first()
    shared = len(os.path.commonprefix([bytes(first or b""), bytes(last or b"")]))
    return F.conv(F.rpad(F.hex(F.substring(own, shared + 1, 6)), 12, "0"), 16, 10).cast("double")


def _in_order(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Rows in ``buckets`` ranges of the id: ``bucket, <id>, text, lends``.
    The first rows of a bucket (those with its smallest id) are lent to the
    bucket before, whose last document needs their text, and the first
    bucket's to the last one.  The driver sees the range bounds only."""
    from pyspark.ml.feature import Bucketizer
    x = docs.select(F.coalesce(_number(docs, id_col), F.lit(float("nan"))).alias("_x"), id_col, text_col)
    inner = x.where(~F.isnan("_x")).approxQuantile("_x", [k / buckets for k in range(1, buckets)], 0.25 / buckets)
    cuts = [-math.inf, *sorted(set(inner)), math.inf]
    rows = (Bucketizer(splits=cuts if len(cuts) > 2 else [-math.inf, 0.0, math.inf], inputCol="_x", outputCol="_b", handleInvalid="keep")
            .transform(x).select(F.col("_b").cast("int").alias("bucket"), id_col, text_col))
    firsts = (rows.groupBy("bucket").agg(F.min(id_col).alias("first"), F.max(F.col(id_col).isNull()).alias("none")))
    around = Window.orderBy("bucket")
    firsts = firsts.select("bucket", "first", "none", F.coalesce(F.lag("bucket").over(around), F.max("bucket").over(
        around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    lent = (rows.join(F.broadcast(firsts.withColumnRenamed("bucket", "_b")), F.col("bucket") == F.col("_b"))
            .select(F.explode(F.when(F.when(F.col("none"), F.col(id_col).isNull()).otherwise(F.col(id_col) == F.col("first")),
                                     F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("lends")),
                                             F.struct(F.col("to").alias("bucket"), F.lit(True).alias("lends"))))
                              .otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("lends"))))).alias("p"),
                    id_col, text_col))
    return lent.select("p.bucket", "p.lends", id_col, text_col)


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, scale: int = 8) -> DataFrame:
    """Every document against its edited text and against the next document
    (ascending id; after the last the first).  The edited text has its last
    floor(n / 2) code points replaced by the next document's first as many.

    The texts are shuffled once, into ranges of the id, and streamed through
    each task in order; nothing is held but the row before."""
    kind, arrow_kind = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _in_order(docs, id_col, text_col, 4 * n)
    ordered = rows.repartition(n, "bucket").sortWithinPartitions("bucket", "lends", id_col, text_col)

    def finish(doc, text: str, own: np.ndarray, after: str, theirs: np.ndarray) -> tuple:
        half = len(text) // 2
        edited = (text[:len(text) - half] + after[:half]).encode()
        other = sketch(edited, words, scale)
        return (doc, len(text), hashlib.sha256(edited).hexdigest(), as_text(own), as_text(other), likeness(own, other),
                likeness(own, theirs), containment(own, other), containment(own, theirs))

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited", "contained_next"]
    kinds = [arrow_kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before: bucket, id, text, sketch
        done = None  # the bucket whose lent row has come
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                bucket, lends, doc = (batch.column(c)[k].as_py() for c in range(3))
                if bucket == done:
                    continue  # lent rows beyond the first
                text = batch.column(3)[k].as_py() or ""
                own = sketch(text.encode(), words, scale)
                if held is not None:
                    out.append(finish(*held[1:], text, own))
                    size += len(out[-1][3]) + len(out[-1][4])
                held = None if lends else (bucket, doc, text, own)
                done = bucket if lends else None
                if len(out) >= 500 or size >= 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return ordered.mapInArrow(run, f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                   "near_edited double, near_next double, contained_edited double, contained_next double")
