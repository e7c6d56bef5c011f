"""SimHash near-dedup with pigeonhole blocks.

A fingerprint is cut into ``blocks`` blocks.  Two fingerprints that differ in
at most ``max_bits`` bits agree on all but ``max_bits`` blocks, so they share
the bits of at least one choice of ``blocks - max_bits`` blocks; the
fingerprints are joined on these choices and the Hamming distance is verified.
Equal fingerprints are one row from the start, and what leaves a block is a
spanning forest of its links, never all its pairs.

A block with more than ``max_block`` fingerprints is cut again by the same
principle over its free bits, until a block has so few free bits that its size
is bounded by construction (some thousands of fingerprints).

Defined cases: null and empty texts and texts without words have fingerprint
zero and link like any other; repeated rows share a component; a component's id
is its smallest non-null document id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sslspark.llm.common import connected_components, free, lists, stored


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a UTF-8 text over its word shingles, repeats included."""
    import xxhash
    found = text.lower().split()  # bytes: A-Z, and white space \x20 \x09-\x0D
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        begins = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(begins[:1 - words].tolist(), ends[words - 1:].tolist())),
                             np.uint64, len(found) - words + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        votes += np.unpackbits(hashes[at:at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``<id>, fp`` (signed 64-bit) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in lists(batches):
            fps = np.fromiter((fingerprint(t or b"", words, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_pydict({id_col: ids, "fp": fps.view(np.int64)}, pa.schema([(id_col, arrow_id), ("fp", pa.int64())]))

    from pyspark.sql.pandas.types import to_arrow_type
    arrow_id = to_arrow_type(docs.schema[id_col].dataType)
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _blocks(bits: list[int], n: int) -> list[int]:
    """Masks of ``n`` blocks of neighbouring bits."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _choices(masks: list[int], keep: int) -> list[int]:
    return [sum(c) for c in combinations(masks, keep)]


def _forest(block: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of runs of equal keys; rows come sorted by the key
    columns, the fingerprint last.  A run is bounded (see the module)."""
    limit = 16

    def links(keys: list[np.ndarray], fp: np.ndarray) -> list[np.ndarray]:
        change = np.zeros(len(fp), bool)
        change[:1] = True
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(change)
        sizes = np.diff(np.append(starts, len(fp)))
        run = np.repeat(np.arange(len(starts)), sizes)
        out = []
        small = sizes[run] <= limit
        for lag in range(1, int(min(limit, sizes.max(initial=0)))):
            same = (run[lag:] == run[:-lag]) & small[lag:]
            near = same & (np.bitwise_count(fp[lag:] ^ fp[:-lag]) <= max_bits)
            at = np.flatnonzero(near)
            out.append(np.stack([fp[at], fp[at + lag]]))
        for s, m in zip(starts[sizes > limit].tolist(), sizes[sizes > limit].tolist()):
            left = fp[s:s + m]
            while len(left):
                queue, left, lead = left[:1], left[1:], left[0]
                while len(queue) and len(left):
                    front, queue = queue[:256], queue[256:]
                    near = np.zeros(len(left), bool)
                    for a in range(0, len(left), 65536):
                        part = left[a:a + 65536]
                        near[a:a + 65536] = (np.bitwise_count(front[:, None] ^ part[None, :]) <= max_bits).any(0)
                    got, left = left[near], left[~near]
                    if len(got):
                        out.append(np.stack([np.full(len(got), lead), got]))
                        queue = np.concatenate([queue, got])
        return out

    held: list[np.ndarray] | None = None
    for batch in block:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = np.ones(len(cols[0]), bool)
        for k in cols[:-1]:
            last &= k == k[-1]
        cut = int(np.argmax(last))
        held = [c[cut:] for c in cols]
        if cut:
            for e in links([c[:cut] for c in cols[:-1]], cols[-1][:cut].view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in e], names=["a", "b"])
    if held is not None:
        for e in links(held[:-1], held[-1].view(np.uint64)):
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in e], names=["a", "b"])


def links(fps: DataFrame, max_bits: int = 3, blocks: int = 6, max_block: int = 2048, fine: int = 8) -> DataFrame:
    """Links ``a, b`` between different fingerprints of ``fps(fp)`` at
    ``max_bits`` or fewer differing bits: a spanning forest of each block."""
    coarse = _choices(_blocks(list(range(64)), blocks), blocks - max_bits)
    keys = fps.select(F.posexplode(F.expr("transform(array(" + ",".join(f"{_signed(m)}L" for m in coarse) + "), m -> fp & m)"))
                      .alias("c", "k"), "fp")
    sizes = stored(keys.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1"), "blocks")

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _forest(batches, max_bits)

    def spanned(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.repartition(*by).sortWithinPartitions(*by).select(*by, "fp").mapInArrow(forest, "a long, b long")

    usual = spanned(keys.join(sizes.where(F.col("n") <= max_block), ["c", "k"]).select("c", "k", "fp"), ["c", "k"])
    finer = []
    for m in coarse:
        free = [b for b in range(64) if not m >> b & 1]
        finer.append("array(" + ",".join(f"{_signed(x)}L" for x in _choices(_blocks(free, fine), fine - max_bits)) + ")")
    large = (keys.join(sizes.where(F.col("n") > max_block), ["c", "k"])
             .select("c", "k", "fp", F.posexplode(F.expr(
                 "transform(element_at(array(" + ",".join(finer) + "), c + 1), m -> fp & m)")).alias("c2", "k2")))
    return usual.unionByName(spanned(large, ["c", "k", "c2", "k2"]))


def _rooted(classes: DataFrame, max_bits: int, max_block: int) -> DataFrame:
    """``classes`` (a row for each ``fp``) with the ``root`` of its component."""
    classes = stored(classes, "classes")
    roots = connected_components(links(classes.select("fp"), max_bits, max_block=max_block))
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3,
                  seed: int = 42, max_block: int = 2048) -> DataFrame:
    """``<id>, fp, component_id`` for every row of ``docs``."""
    fps = stored(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    by_class = _rooted(fps.groupBy("fp").agg(F.min(id_col).alias("rep")), max_bits, max_block)
    least = by_class.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = by_class.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(id_col, "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3,
                seed: int = 42, max_block: int = 2048) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component of fingerprints,
    the one with the smallest id (null ids last, equal ids by a hash of the
    text).  Rows have numbers of their own: equal or null ids merge nothing."""
    row, group, bits = (free(docs.columns, x) for x in ("row", "group", "bits"))
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")  # a table: the numbers stay when it is read again
    place = F.struct(F.col(id_col).isNull().alias("x"), F.col(id_col).alias("d"), F.xxhash64(text_col).alias("t"), F.col(row).alias("r"))
    fps = fingerprints(rows.select(place.alias("place"), F.col(text_col).alias("text")), "place", "text", words, seed)
    by_class = _rooted(fps.groupBy("fp").agg(F.min("place").alias("rep")), max_bits, max_block)
    # a bit for each row, 64 in one number: small enough that Spark need not shuffle the texts for it until it is large itself
    of, bit = f"shiftright(`{row}`, 6)", f"shiftleft(1L, CAST(`{row}` & 63 AS INT))"
    stay = by_class.groupBy("root").agg(F.min("rep").alias("rep")).select(F.col("rep.r").alias(row))
    stay = stored(stay.groupBy(F.expr(of).alias(group)).agg(F.expr(f"bit_or({bit})").alias(bits)), "stay")
    return rows.withColumn(group, F.expr(of)).join(stay, group).where(f"`{bits}` & {bit} <> 0").select(*docs.columns)
