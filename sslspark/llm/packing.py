"""Packing: concatenate and cut.

Documents are tokenised once, in the partitions in which Spark reads them.
Two-pass prefix sums give every document its place in one long token stream:
the first pass leaves the running token count inside each partition, the
second adds up the partition totals.  The stream is then cut into windows of a
fixed length, so only the very last window is not full.

Defined cases: a null text is an empty text (only the end-of-document id); a
repeated row is packed again; an empty table gives no rows; columns beside
the id and the text are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sslspark.llm.common import stored

_CUT = re.compile(r"(?<=\S) (?=\S)")


class Coder:
    """Token ids of many texts, each different word encoded once (as far as
    ``most`` words kept from earlier batches go).

    A byte-level BPE tokeniser with the usual split pattern never merges
    across a single space between two other characters, so the ids of a text
    are the ids of its words (each with the space before it) in turn.  The
    different words of a batch are encoded together and parted where the
    tokens' bytes reach the words' ends.  Texts with white space in a row or
    added tokens are encoded by themselves.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        kind = json.loads(tokenizer.to_str())
        split = kind["pre_tokenizer"] or {}
        if kind["normalizer"] or kind["post_processor"] or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space"):
            raise ValueError("a byte-level BPE tokenizer with the usual split pattern is needed")
        self.encode, self.encode_batch = tokenizer.encode, tokenizer.encode_batch_fast
        self.is_stop, self.is_plain = np.zeros(256, bool), np.zeros(256, bool)
        self.is_stop[list(b",.;:!?")] = True
        self.is_plain[[b for b in range(128) if chr(b).isalnum()]] = True
        self.stop_id = np.zeros(256, np.uint32)
        for b in b",.;:!?":
            self.stop_id[b], = tokenizer.encode(chr(b), add_special_tokens=False).ids
        self.most = most
        self.kept = pa.array([], pa.large_string()), np.empty(0, "<u4"), np.empty(0, np.int64)  # words, their ids, sizes
        self.added = [t["content"] for t in kind["added_tokens"]]
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a character of a token stands for a byte
        self.n_bytes[list(vocabulary.values())] = list(map(len, vocabulary))

    def text(self, text: str) -> np.ndarray:
        """Ids of a text, cut where single spaces stand between words."""
        first, *rest = _CUT.split(text)
        return np.array([i for x in (first, *(" " + x for x in rest)) for i in self.encode(x, add_special_tokens=False).ids], "<u4")

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with a space before each, one after the other, and
        the number of each word's ids.  The words have no white space at
        their ends."""
        kind = pa.large_string()
        spaced = pc.binary_join_element_wise(pa.scalar("", kind), words, pa.scalar(" ", kind))
        ends = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset + 1:spaced.offset + len(spaced) + 1]
        data = spaced.buffers()[2].to_pybytes() if len(spaced) else b""
        begin = int(ends[0]) - len(spaced[0].as_py().encode()) if len(spaced) else 0
        marks = [begin, *ends[63::64].tolist()]
        if len(spaced) and marks[-1] != ends[-1]:
            marks.append(int(ends[-1]))
        found: list[np.ndarray] = []
        for at in range(0, len(marks) - 1, 128):
            some = marks[at:at + 129]
            parts = [data[a:b].decode() for a, b in zip(some, some[1:])]
            found += [np.array(e.ids, "<u4") for e in self.encode_batch(parts, add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.empty(0, "<u4")
        cuts = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends - begin) + 1
        if len(cuts) and cuts[-1] != len(ids):
            raise ValueError("the tokens don't spell the words")
        return ids, np.diff(cuts, prepend=0)

    def look_up(self, words: pa.Array) -> np.ndarray:
        """Places of different words among those kept; new ones are encoded."""
        place = pc.index_in(words, value_set=self.kept[0])
        if len(self.kept[0]) + place.null_count > self.most:
            self.kept = tuple(x[:0] for x in self.kept)
            place = pa.nulls(len(words), pa.int32())
        new = words.filter(pc.is_null(place))
        before = len(self.kept[0])
        self.kept = tuple(pa.concat_arrays([a, b]) if isinstance(a, pa.Array) else np.concatenate([a, b])
                          for a, b in zip(self.kept, (new, *self.words(new)), strict=True))
        place = place.fill_null(-1).to_numpy().astype(np.int64)
        place[place < 0] = before + np.arange(len(new))
        return place

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``words``.  A stop after a letter or digit at a word's end is a
        piece of its own for the split pattern, so the word is looked up without it."""
        if not len(words):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset + 1:words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)
        size = np.asarray(pc.binary_length(words))
        last, before = data[ends - 1], data[np.maximum(ends - 2, 0)]
        stop = (size > 1) & self.is_stop[last] & self.is_plain[before]
        heads = pc.if_else(pa.array(stop), pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
        place = self.look_up(heads.dictionary)[heads.indices.to_numpy()]
        _, ids, sizes = self.kept
        n = sizes[place]
        total = n + stop
        out_ends = np.cumsum(total)
        out = np.empty(int(out_ends[-1]), "<u4")
        head = np.ones(len(out), bool)
        head[out_ends[stop] - 1] = False
        begin = (np.cumsum(sizes) - sizes)[place]
        out[head] = ids[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        out[~head] = self.stop_id[last[stop]]
        return out, total

    def texts(self, texts: pa.Array, end_id: int) -> pa.Array:
        """Little-endian unsigned 32-bit ids of each text, ``end_id`` last."""
        split = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), " ")
        begins = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        words = split.flatten().dictionary_encode()
        place, known = words.indices.to_numpy().astype(np.int64), words.dictionary
        bare = pc.utf8_trim_whitespace(known)
        bad = ~np.asarray(pc.equal(bare, known)) | (np.asarray(pc.binary_length(known)) == 0)
        for added in self.added:
            bad |= np.asarray(pc.match_substring(known, added))
        odd = bad[place]  # white space in a row: these texts are cut by a pattern
        odd[begins] &= np.asarray(pc.binary_length(known))[place[begins]] > 0
        doc = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(place))))
        ids, sizes = self.ids_of(known.filter(pa.array(~bad)))
        size = np.zeros(len(known), np.int64)
        size[~bad] = sizes
        first = pc.take(known, pa.array(place[begins])).to_pylist()  # words without a space before them
        more = [np.array(self.encode(x, add_special_tokens=False).ids, "<u4") for x in first]
        for d in np.unique(doc[odd]).tolist():
            more[d] = self.text(texts[d].as_py())
            place[begins[d]:begins[d + 1] if d + 1 < len(begins) else len(place)] = len(known) + len(more)
        place[begins] = len(known) + np.arange(len(more))
        size = np.concatenate([size, np.fromiter(map(len, more), np.int64, len(more)), [0, 1]])  # nothing, the end
        source = np.concatenate([ids, *more, np.array([end_id], "<u4")])
        all_places = np.full(len(place) + len(begins), len(size) - 1)
        all_places[np.arange(len(place)) + doc] = place
        count = size[all_places]
        ends = np.cumsum(count)
        take = np.repeat((np.cumsum(size) - size)[all_places] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
        last_word = np.append(begins[1:], len(place)) + np.arange(len(begins))
        offsets = np.concatenate(([0], ends[last_word] * 4)).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(source[take])]).cast(pa.binary())


def tokenise(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
             end_id: int = 0) -> DataFrame:
    """First pass: ``part, at, n, <id>, ids`` with the ids of each document
    (unsigned 32-bit, little-endian) and its offset within its partition.
    Written to the shared folder, so the offsets stay fixed."""
    kind = docs.schema[id_col].dataType.simpleString()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, code = TaskContext.get().partitionId(), 0, Coder(tokenizer)
        for batch in batches:
            row = 0
            ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)))
            while row < batch.num_rows:  # rows by bytes, so very long texts stay apart
                upto = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + 6_000_000)))
                ids = code.texts(batch.column(1).slice(row, upto - row), end_id)
                counts = np.asarray(pc.binary_length(ids)).astype(np.int64) // 4
                starts = at + np.cumsum(counts) - counts
                at += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(counts), batch.column(0).slice(row, upto - row), ids],
                    names=["part", "at", "n", id_col, "ids"])
                row = upto

    return stored(docs.select(id_col, text_col).mapInArrow(
        run, f"part int, at long, n long, `{id_col}` {kind}, ids binary"), "tokens")


def place(tokens: DataFrame) -> DataFrame:
    """Second pass: adds ``begin``, a document's offset in the whole stream.

    Only partition totals are summed, in blocks of 1024 partitions: one row
    for each input partition is what is broadcast, never one for a document.
    """
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n")).withColumn("block", F.expr("part div 1024"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (totals.groupBy("block").agg(F.sum("n").alias("n"))
              .select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("block_base")))
    base = (totals.withColumn("in_block", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, "block")
            .select("part", (F.col("block_base") + F.col("in_block")).alias("base")))
    return tokens.join(F.broadcast(base), "part").select(
        "*", (F.col("base") + F.col("at")).alias("begin")).drop("base")


def pieces(placed: DataFrame, length: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """One row for each piece of a document that lies in one window:
    ``<id>, start, length, ids, doc_tokens, sequence_id, offset``."""
    cut = F.expr(
        f"transform(sequence(begin div {length}, (begin + n - 1) div {length}), s -> struct("
        f"s AS sequence_id, greatest(s * {length}, begin) AS a, least((s + 1) * {length}, begin + n) AS b))")
    each = placed.withColumn("cuts", cut).withColumn("cuts", F.expr(
        "transform(cuts, c -> struct(c.sequence_id AS sequence_id, c.a - begin AS start, c.b - c.a AS length,"
        f" c.a - c.sequence_id * {length} AS offset,"
        " substring(ids, CAST((c.a - begin) * 4 + 1 AS INT), CAST((c.b - c.a) * 4 AS INT)) AS ids))"))
    return (each.select(id_col, F.col("n").alias("doc_tokens"), F.explode("cuts").alias("c"))
            .select(id_col, "c.start", "c.length", "c.ids", "doc_tokens", "c.sequence_id", "c.offset"))


def sequences(placed: DataFrame, length: int = 1024) -> DataFrame:
    """The packed windows themselves: ``sequence_id, ids``.

    Windows that lie within one read of a partition are cut on the spot;
    only the boundary records (pieces of windows that two reads share) are
    shuffled and joined.
    """
    step = 4 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            runs: list[tuple[int, list[bytes]]] = []
            ends = None
            for b, x in zip(begins, parts, strict=True):
                if b != ends:
                    runs.append((b, []))
                runs[-1][1].append(x)
                ends = b + len(x) // 4
            for b, xs in runs:
                data, at, ids, seqs, offs = b"".join(xs), 0, [], [], []
                while at < len(data):
                    off = (b + at // 4) % length
                    take = min(step - 4 * off, len(data) - at)
                    seqs.append((b + at // 4) // length)
                    offs.append(off)
                    ids.append(data[at:at + take])
                    at += take
                yield pa.RecordBatch.from_pydict({
                    "sequence_id": pa.array(seqs, pa.int64()), "offset": pa.array(offs, pa.int64()),
                    "ids": pa.array(ids, pa.binary())})

    cut = stored(placed.select("begin", "ids").mapInArrow(run, "sequence_id long, offset long, ids binary"), "windows")
    whole = F.length("ids") == step
    joined = (cut.where(~whole).groupBy("sequence_id")
              .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
              .select("sequence_id", F.expr("aggregate(p, CAST('' AS BINARY), (a, x) -> a || x.ids)").alias("ids")))
    return cut.where(whole).select("sequence_id", "ids").unionByName(joined)


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, id_col: str = "doc_id", text_col: str = "text",
         end_id: int = 0) -> DataFrame:
    """Pack ``docs``; see ``pieces`` for the columns."""
    return pieces(place(tokenise(docs, tokenizer, id_col, text_col, end_id)), length, id_col)
