"""Substring dedup with prefix-partitioned suffix trees over words.

A suffix is a word position, looked at to the depth of ``window`` words.  A
position belongs to the group of its variable-length prefix:

* The shortest prefix is content-defined: of the ``window - gram + 1`` runs of
  ``gram`` words in a window the one with the smallest hash is its anchor.
  Equal windows have equal anchors at equal offsets, so the windows of one
  anchor are a group, and an anchor that occurs once in the whole corpus has no
  repeat: its windows go no further.
* A group with more occurrences than ``max_group`` is split by the longest
  prefix, the whole window; a count with partial aggregation decides it.

In all other groups a task builds the subtree: it sorts the suffixes word by
word, takes the longest common prefixes of neighbours (the depths of the
internal nodes), and every leaf below a node as deep as the window starts a
repeat.  Words are compared as 32-bit symbols, after the 64-bit anchors agree.

Defined cases: a null text has no words; texts shorter than a window keep all
words; equal rows count as separate documents and get the same result; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sslspark.llm.common import lists, stored

_MIX = np.uint64(0x9E3779B97F4A7C15)


def symbols(words: list[bytes]) -> np.ndarray:
    import xxhash
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchors(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of the words ``h`` (its first word's position in turn):
    the position of its anchor; and the anchors' keys at all positions."""
    n = len(h) - gram + 1
    with np.errstate(over="ignore"):
        key = np.zeros(n, np.uint64)
        for j in range(gram):
            key = key * _MIX + h[j:j + n]
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(32)
    span = window - gram + 1
    views = np.lib.stride_tricks.sliding_window_view(key, span)
    at = np.empty(len(views), np.int64)
    for a in range(0, len(views), 65536):
        at[a:a + 65536] = views[a:a + 65536].argmin(axis=1)
    at += np.arange(len(views))
    return at, key, np.flatnonzero(np.diff(at, prepend=-1))


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``uid, <id>, z``: texts compressed, as two joins shuffle them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(2).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([squeeze(t or b"") for t in texts], pa.binary())],
                    names=["uid", id_col, "z"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.xxhash64(id_col, text_col).alias("uid"), id_col, text_col)
            .mapInArrow(run, f"uid long, `{id_col}` {kind}, z binary"))


def _anchor_rows(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uids, texts in lists(batches, 200):
            us, ps, ks = [], [], []
            for uid, text in zip(uids, texts, strict=True):
                words = (text or b"").split()
                if len(words) >= window:
                    at, key, first = anchors(symbols(words), window, gram)
                    pos = at[first]
                    us.append(np.full(len(pos), uid, np.int64))
                    ps.append(pos.astype(np.int32))
                    ks.append(key[pos].view(np.int64))
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, ps, ks)], names=["uid", "pos", "key"])

    return docs.select(F.xxhash64(id_col, text_col).alias("uid"), text_col).mapInArrow(run, "uid long, pos int, key long")


def _contexts(rows: DataFrame, id_col: str, kind: str, arrow_kind: pa.DataType, window: int, gram: int) -> DataFrame:
    """Rows of ``uid, <id>, z, at`` (positions of repeated anchors) to one row
    for each of these anchors: its windows ``start .. start + n - 1`` and the
    symbols of their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        expand = zstandard.ZstdDecompressor().decompress
        for uids, ids, zs, ats in lists(batches, 100):
            out: list[list] = [[] for _ in names]
            for uid, doc, z, found in zip(uids, ids, zs, ats, strict=True):
                words = expand(z).split() if z is not None else []
                if len(words) < window:
                    continue
                h = symbols(words)
                at, key, first = anchors(h, window, gram)
                ends = np.append(first[1:], len(at))
                low = h.astype(">u4")  # the low half, big-endian: bytes sort like numbers
                hot = {x["pos"]: x["hot"] for x in found}
                for s, e in zip(first.tolist(), ends.tolist()):
                    if (p := int(at[s])) in hot:
                        for x, v in zip(out, (uid, doc, int(key[p].view(np.int64)), hot[p], s, e - s, p - s, low[s:e + window - 1].tobytes()), strict=True):
                            x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=names)

    names = ["uid", id_col, "key", "hot", "start", "n", "offset", "words"]
    kinds = (pa.int64(), arrow_kind, pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return rows.mapInArrow(run, f"uid long, `{id_col}` {kind}, key long, hot boolean, start int, n int, offset int, words binary")


def _repeated_windows(counts: np.ndarray, words: list[bytes], offset: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Subtrees of whole groups.  Each context (row) has ``counts`` suffixes;
    returns for all suffixes in turn whether a second one equals it to the
    full depth.  ``offset`` is the anchor's place in a context's first window."""
    width = 4 * window
    data = np.frombuffer(b"".join(words), np.uint8)
    begins = np.cumsum([0, *map(len, words)])[:-1]
    row = np.repeat(np.arange(len(counts)), counts)
    k = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    views = np.lib.stride_tricks.sliding_window_view(data, width)
    repeated = np.zeros(len(row), bool)
    to_anchor = offset[row] - k
    for o in np.unique(to_anchor):  # equal suffixes have their anchor at the same place
        some = np.flatnonzero(to_anchor == o)
        leaf = np.empty((len(some), width + 8), np.uint8)
        leaf[:, :8] = group[row[some]].astype(">i8").view(np.uint8).reshape(-1, 8)
        leaf[:, 8:] = views[begins[row[some]] + 4 * k[some]]
        order = np.argsort(leaf.view(f"V{width + 8}").ravel(), kind="stable")
        leaf = leaf[order]
        equal = leaf[1:] == leaf[:-1]
        depth = np.where(equal.all(1), width + 8, equal.argmin(1))  # of the node above two neighbouring leaves, in bytes
        deep = depth >= width + 8
        repeated[some[order[1:][deep]]] = True
        repeated[some[order[:-1][deep]]] = True
    return repeated


def _subtrees(rows: DataFrame, id_col: str, kind: str, window: int, batch_rows: int = 2048) -> DataFrame:
    """Groups (sorted runs of one key) to ``uid, <id>, start, mask``: bit i says
    that the window at ``start + i`` is repeated."""
    def solve(t: pa.Table) -> pa.RecordBatch:
        counts = t["n"].to_numpy()
        got = _repeated_windows(counts, t["words"].to_pylist(), t["offset"].to_numpy(), t["key"].to_numpy(), window)
        k = np.arange(len(got)) - np.repeat(np.cumsum(counts) - counts, counts)
        masks = np.add.reduceat(np.where(got, np.left_shift(1, k), 0), np.cumsum(counts) - counts)
        keep = np.flatnonzero(masks)
        t = t.take(pa.array(keep)).combine_chunks()
        return pa.RecordBatch.from_arrays([t[c].combine_chunks() if t.num_rows else pa.array([], t[c].type) for c in ("uid", id_col, "start")]
                                          + [pa.array(masks[keep], pa.int64())], names=["uid", id_col, "start", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                held.append(batch.slice(at, batch_rows))
                n += held[-1].num_rows
                if n >= batch_rows:
                    t = pa.Table.from_batches(held)
                    keys = t["key"].to_numpy()
                    cut = int(np.searchsorted(keys, keys[-1]))
                    if cut:
                        yield solve(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
                    n = t.num_rows - cut
        if n:
            yield solve(pa.Table.from_batches(held))

    return rows.mapInArrow(run, f"uid long, `{id_col}` {kind}, start int, mask long")


def repeats(docs: DataFrame, packed: DataFrame, id_col: str, text_col: str, window: int, gram: int, max_group: int) -> DataFrame:
    """``uid, <id>, start, mask`` of the windows that occur more than once."""
    kind, arrow_kind = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    found = stored(_anchor_rows(docs, id_col, text_col, window, gram), "anchors")
    again = stored(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
                   .select("key", (F.col("n") > max_group).alias("hot")), "repeated")  # a table, so that a hot key's join is split
    at = (found.join(again, "key").groupBy("uid", "pos").agg(F.max("hot").alias("hot"))
          .groupBy("uid").agg(F.collect_list(F.struct("pos", "hot")).alias("at")))
    rows = stored(_contexts(packed.join(at, "uid").select("uid", id_col, "z", "at"), id_col, kind, arrow_kind, window, gram), "contexts")
    usual = rows.where(~F.col("hot")).drop("hot")
    trees = _subtrees(usual.repartition("key").sortWithinPartitions("key"), id_col, kind, window)
    each = (rows.where("hot").select("uid", id_col, F.posexplode(F.expr(
        f"transform(sequence(0, n - 1), i -> substring(words, 4 * i + 1, {4 * window}))")).alias("i", "w"), "start")
        .select("uid", id_col, (F.col("start") + F.col("i")).alias("start"), F.unhex(F.md5("w")).alias("w")))
    twice = stored(each.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w"), "twice")
    return trees.unionByName(each.join(twice, "w", "left_semi").select("uid", id_col, "start", F.lit(1).cast("long").alias("mask")))


def _covered(found: list[dict], n_words: int, window: int) -> np.ndarray:
    """Which words lie in a repeated window."""
    cover = np.zeros(n_words + 1, np.int32)
    if found:
        start = np.array([x["start"] for x in found], np.int64)
        mask = np.array([x["mask"] for x in found], np.uint64)
        bit = np.arange(64, dtype=np.uint64)
        r, b = np.nonzero((mask[:, None] >> bit) & np.uint64(1))
        s = np.unique(start[r] + b)
        np.add.at(cover, s, 1)
        np.add.at(cover, s + window, -1)
    return np.cumsum(cover)[:n_words] > 0


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 5,
                     max_group: int = 65536) -> DataFrame:
    """``<id>, n_words, spans, kept``: the word ranges ``[begin, end)`` of the
    maximal repeats (runs of repeated windows), and the text left over."""
    kind, arrow_kind = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    packed = _packed(docs, id_col, text_col)
    found = (repeats(docs, packed, id_col, text_col, window, gram, max_group)
             .select("uid", F.col(id_col).alias("_id"), F.struct("start", "mask").alias("s")).distinct()
             .groupBy("uid", "_id").agg(F.collect_list("s").alias("found")))
    rows = packed.join(found, (packed["uid"] == found["uid"]) & packed[id_col].eqNullSafe(found["_id"]), "left").select(
        packed[id_col], "z", "found")
    spans_kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        expand = zstandard.ZstdDecompressor().decompress
        for ids, zs, hits in lists(batches, 200):
            ns, spans, kept = [], [], []
            for z, hit in zip(zs, hits, strict=True):
                words = expand(z).split()
                gone = _covered(hit or [], len(words), window)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                ns.append(len(words))
                spans.append([{"begin": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
                kept.append(b" ".join(words if not hit else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, arrow_kind), pa.array(ns, pa.int64()), pa.array(spans, spans_kind), pa.array(kept, pa.binary()).cast(pa.string())],
                names=[id_col, "n_words", "spans", "kept"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words long, spans array<struct<begin:long,end:long>>, kept string")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``<id>, n_words, n_removed, kept_sha256`` of ``dedup_substrings``."""
    removed = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.begin)")
    return found.select(id_col, "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
