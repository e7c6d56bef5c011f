"""Source divergence audit by single-pass in-memory indexing.

1. A task reads its documents once and builds postings (language, term) to
   (source, occurrences, documents) in memory.  When the block is full it is
   spilled as a run: sorted by language and term, parted into hash shards, each
   part in compressed pages.
2. The runs of a shard meet in one task, which merges them page by page, with
   a heap of the open pages' last terms, and sums up the postings of each term:
   the frequencies.  A term is one entry of a run and source, however often it
   occurs, so frequent terms are no hot keys.
3. A term's smoothed share in a group is an integer, so are all divergences.
   The divergence of two sources over all terms is taken in three parts: terms
   that neither has (all alike), terms that one has (from the histogram of its
   counts, without the terms), and for the terms that both have a correction,
   which is streamed from the postings.  No source is compared with a term
   that it does not have.

Defined cases: null texts, languages and sources are empty strings; equal rows
are separate documents; a group without terms has a row for each other source
of its language; a source alone in its language has no pair; a language
without kept terms has divergence 0; ties are ranked by the item's UTF-8 bytes;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import io
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sslspark.llm.common import stored

#: Terms are runs of ASCII letters and of characters beyond ASCII; only A-Z are lower-cased.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_AS_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCALE = 1_000_000_000
#: Ends the language in an entry's key (language, term); no byte of UTF-8, so keys sort alike in all runs.
_AND = b"\xff"
_ENTRY = pa.schema([("key", pa.binary()), ("source", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_AS_TERM).split()


class _Numbers(dict):
    """A number for each different key, in the order in which they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Block:
    """Postings of some documents, in memory."""

    def __init__(self):
        self.terms = _Numbers()
        self.groups = _Numbers()
        self.found: list[np.ndarray] = []  # term, occurrences, group: a column for each term of a document
        self.size = 0

    def add(self, langs: list[bytes], sources: list[bytes], texts: list[bytes]) -> None:
        """Some documents; equal terms of one are one posting."""
        for lang, source, text in zip(langs, sources, texts, strict=True):
            counts = Counter(terms_of(text))  # small, so that the block's large table is asked once for each different term
            part = np.empty((3, len(counts)), np.int64)
            part[0] = np.fromiter(map(self.terms.__getitem__, counts), np.int64, len(counts))
            part[1] = np.fromiter(counts.values(), np.int64, len(counts))
            part[2] = self.groups[lang, source]
            self.found.append(part)
            self.size += len(counts)

    def spill(self, shards: int, page: int) -> Iterator[tuple[int, bytes]]:
        """The run: for each hash shard its entries, in order, in pages."""
        if not self.size:
            return
        terms = sorted(self.terms)
        groups = sorted(self.groups, key=lambda g: (g[0] + _AND, g[1]))
        langs = sorted({g[0] for g in groups}, key=lambda x: x + _AND)
        rank, place = np.empty(len(terms), np.int64), np.empty(len(groups), np.int64)
        rank[[self.terms[t] for t in terms]] = np.arange(len(terms))
        place[[self.groups[g] for g in groups]] = np.arange(len(groups))
        number = {x: k for k, x in enumerate(langs)}
        lang_of = np.array([number[g[0]] for g in groups], np.int64)
        term, n, group = np.concatenate(self.found, axis=1)
        term, group = rank[term], place[group]
        order = np.lexsort((group, term, lang_of[group]))
        term, n, group = term[order], n[order], group[order]
        new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (group[1:] != group[:-1])))
        docs = np.diff(np.append(new, len(term)))
        n, term, group = np.add.reduceat(n, new), term[new], group[new]
        salt = np.array([zlib.crc32(x) for x in langs], np.uint64)
        shard = np.fromiter(map(zlib.crc32, terms), np.uint64, len(terms))[term] ^ salt[lang_of[group]]
        shard = ((shard * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)
        by = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(shard[by]) != 0))
        all_terms, all_langs, sources = (pa.array(x, pa.binary()) for x in (terms, [g[0] for g in groups], [g[1] for g in groups]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)]):
            some = by[a:b]
            whose = pa.array(group[some])
            key = pc.binary_join_element_wise(all_langs.take(whose), all_terms.take(pa.array(term[some])), pa.scalar(_AND))
            entries = pa.RecordBatch.from_arrays([key, sources.take(whose), pa.array(n[some]), pa.array(docs[some])], schema=_ENTRY)
            out = io.BytesIO()
            with pa.ipc.new_stream(out, _ENTRY, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                for at in range(0, entries.num_rows, page):
                    writer.write_batch(entries.slice(at, page))
            yield int(shard[some[0]]), out.getvalue()


def runs(docs: DataFrame, text_col: str, lang_col: str, source_col: str, shards: int, max_postings: int = 2_000_000,
         max_bytes: int = 64_000_000, page: int = 4096) -> DataFrame:
    """``shard, entries``: the runs that the tasks spill."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = Block(), 0

        def out() -> Iterator[pa.RecordBatch]:
            for shard, entries in block.spill(shards, page):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([entries], pa.binary())], names=["shard", "entries"])

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                cols = [c.cast(pa.binary()).to_pylist() for c in batch.slice(at, 200).columns]
                known = len(block.terms)
                block.add(cols[1], cols[2], cols[0])
                held += 100 * (len(block.terms) - known)
                if block.size >= max_postings or held >= max_bytes:
                    yield from out()
                    block, held = Block(), 0
        yield from out()

    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (text_col, lang_col, source_col)]).mapInArrow(
        run, "shard int, entries binary")


def _merged(parts: list[bytes]) -> Iterator[pa.Table]:
    """Entries of the runs of a shard, so that no key is in two tables.  The
    heap holds the last key of each run's open page; up to the smallest of them
    all entries are at hand."""
    pages = [iter(pa.ipc.open_stream(p)) for p in parts]
    open_ = [next(p) for p in pages]
    heap = [(page.column(0)[-1].as_py(), k) for k, page in enumerate(open_)]
    heapq.heapify(heap)
    while heap:
        bound = heap[0][0]
        ready = []
        for k, page in enumerate(open_):
            if page is None or (heap[0][1] != k and page.column(0)[0].as_py() > bound):
                continue
            keys = page.column(0)
            upto = bisect_right(range(len(keys)), bound, key=lambda i: keys[i].as_py())
            ready.append(page.slice(0, upto))
            open_[k] = page.slice(upto)
        while heap and heap[0][0] == bound:
            k = heapq.heappop(heap)[1]
            open_[k] = next(pages[k], None)
            while open_[k] is not None and open_[k].column(0)[-1].as_py() == bound:  # a key may go on in the next page
                ready.append(open_[k])
                open_[k] = next(pages[k], None)
            if open_[k] is not None:
                keys = open_[k].column(0)
                upto = bisect_right(range(len(keys)), bound, key=lambda i: keys[i].as_py())
                ready.append(open_[k].slice(0, upto))
                open_[k] = open_[k].slice(upto)
                heapq.heappush(heap, (keys[-1].as_py(), k))
        yield pa.Table.from_batches(ready)


def frequencies(spilled: DataFrame, min_docs: int) -> DataFrame:
    """``lang, term, docs, n, posts`` of the terms in at least ``min_docs``
    documents of their language; ``posts`` are (source, n), by source."""
    def table(entries: pa.Table) -> pa.RecordBatch:
        terms = entries.group_by("key", use_threads=False).aggregate([("docs", "sum"), ("n", "sum")])
        terms = terms.filter(pc.greater_equal(terms["docs_sum"], min_docs)).sort_by("key").combine_chunks()
        kept = entries.filter(pc.is_in(entries["key"], terms["key"]))
        posts = kept.group_by(["key", "source"], use_threads=False).aggregate([("n", "sum")]).sort_by([("key", "ascending"), ("source", "ascending")])
        ends = np.asarray(pc.run_end_encode(posts["key"].combine_chunks()).run_ends) if len(posts) else np.empty(0, np.int32)
        keys = [k.partition(_AND) for k in terms["key"].to_pylist()]
        pairs = pa.StructArray.from_arrays([pa.array(posts["source"].to_pylist(), pa.binary()).cast(pa.string()), pa.array(np.asarray(posts["n_sum"]), pa.int64())],
                                           names=["source", "n"])
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0].decode() for k in keys], pa.string()), pa.array([k[2].decode() for k in keys], pa.string()),
             pa.array(np.asarray(terms["docs_sum"]), pa.int64()), pa.array(np.asarray(terms["n_sum"]), pa.int64()),
             pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pairs)], names=["lang", "term", "docs", "n", "posts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []
        for batch in batches:
            for s, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != shard:
                    yield from map(table, _merged(parts))
                    shard, parts = s, []
                parts.append(part)
        yield from map(table, _merged(parts))

    return spilled.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        run, "lang string, term string, docs long, n long, posts array<struct<source:string,n:long>>")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exactly."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)")
    below = F.greatest(total + 2 * terms, F.lit(1)).cast("decimal(19,0)")
    return F.call_function("div", whole, below) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most SCALE + 1, so 64 bits do."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def groups(docs: DataFrame, found: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """``lang, source, n, some, lang_n, terms``: every group that occurs, its
    occurrences and different terms, those of the language, and the kept terms."""
    text = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    every = docs.select(text(lang_col, "lang"), text(source_col, "source")).distinct()
    own = found.select("lang", F.explode("posts").alias("p")).groupBy("lang", F.col("p.source").alias("source")).agg(
        F.sum("p.n").alias("n"), F.count("*").alias("some"))
    langs = found.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count("*").alias("terms"))
    return every.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "some", "lang_n", "terms"])


def _corrections(posts: DataFrame, entries: int = 1_000_000) -> DataFrame:
    """``lang, a, b, value`` (a before b) from ``lang, posts(source, p, p0)``:
    for terms that two sources have, what the true divergence is above the sum
    of those with one of the two counts set to zero."""
    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    def solve(part: pa.RecordBatch) -> pa.RecordBatch:
        lists = part.column(1)
        flat = lists.flatten()
        size = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(size)), size)
        lang = part.column(0).dictionary_encode()
        source = flat.field(0).dictionary_encode()
        p, p0 = flat.field(1).to_numpy(), flat.field(2).to_numpy()
        n = max(1, len(source.dictionary))
        code = source.indices.to_numpy().astype(np.int64)
        base = lang.indices.to_numpy().astype(np.int64)[row] * n * n
        keys, values = [], []
        for lag in range(1, int(size.max(initial=0))):
            a = np.flatnonzero(row[lag:] == row[:-lag])
            b = a + lag
            value = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
            key, at = np.unique(base[a] + code[a] * n + code[b], return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, at, value)
            keys.append(key)
            values.append(total)
        key = np.concatenate([np.empty(0, np.int64), *keys])
        take = lambda d, k: d.dictionary.take(pa.array(k))
        return pa.RecordBatch.from_arrays([take(lang, key // (n * n)), take(source, key // n % n), take(source, key % n),
                                           pa.array(np.concatenate([np.empty(0, np.int64), *values]))], names=["lang", "a", "b", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy()[1:]
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + entries)))
                yield solve(pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(at, upto - at)]) for c in batch.columns], names=batch.schema.names))
                at = upto

    return posts.mapInArrow(run, "lang string, a string, b string, value long")


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10,
                      top: int = 10, shards: int | None = None) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each source of a language
    its divergence from every other one (part ``pair``), and the ``top`` terms
    that it has more of than the language (part ``term``)."""
    spark = docs.sparkSession
    shards = shards or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stored(frequencies(runs(docs, text_col, lang_col, source_col, shards), min_docs), "frequencies")
    by_group = stored(groups(docs, found, lang_col, source_col), "groups")
    each = (found.select("lang", "term", F.col("n").alias("term_n"), F.explode("posts").alias("p"))
            .select("lang", "term", "term_n", F.col("p.source").alias("source"), F.col("p.n").alias("c"))
            .join(by_group, ["lang", "source"])
            .withColumns({"p": share(F.col("c"), F.col("n"), F.col("terms")), "p0": share(F.lit(0), F.col("n"), F.col("terms"))}))

    # terms
    q = share(F.col("term_n"), F.col("lang_n"), F.col("terms"))
    more = each.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_terms = more.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    # pairs
    zero = share(F.lit(0), F.col("n"), F.col("terms"))
    own = by_group.select("lang", F.col("source").alias("a"), zero.alias("p0_a"), F.col("some").alias("some_a"), "terms")
    other = by_group.select("lang", F.col("source").alias("b"), zero.alias("p0_b"), F.col("some").alias("some_b"))
    pairs = own.join(other, "lang").where("a <> b")
    neither = pairs.select("lang", "a", "b", ((F.col("terms") - F.col("some_a") - F.col("some_b")) * apart(F.col("p0_a"), F.col("p0_b"))).alias("value"))
    histogram = each.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("k"))
    one = pairs.join(histogram, ["lang", "a"]).groupBy("lang", "a", "b").agg(F.sum(F.col("k") * apart(F.col("p"), F.col("p0_b"))).alias("value"))
    posts = each.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "p0"))).alias("posts")).where(F.size("posts") > 1)
    both = _corrections(posts.select("lang", "posts")).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("w")
    of_pairs = neither.unionByName(one.unionByName(both).select("lang", ways, "value").select("lang", "w.a", "w.b", "value"))
    of_pairs = (of_pairs.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").alias("value"))
                .select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked)))
    return of_pairs.unionByName(of_terms)


def oracle_sql(min_docs: int = 10, top: int = 10) -> str:
    """DuckDB twin on ``documents``: every group with every kept term."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    p = "1 + ({c} + 2)::HUGEINT * 1000000000 // greatest({n} + 2 * v, 1)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
                  translate(COALESCE(text, ''), '{letters.upper()}', '{letters}') AS x FROM documents),
w AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(x, '{TERM}')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, COUNT(*) AS tc FROM w GROUP BY lang, term HAVING COUNT(DISTINCT r) >= {min_docs}),
c AS MATERIALIZED (SELECT lang, source, term, COUNT(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, COUNT(*) AS v, SUM(tc) AS ln FROM kept GROUP BY lang),
g AS MATERIALIZED (
  SELECT lang, source, COALESCE(n, 0) AS n, COALESCE(v, 0) AS v, COALESCE(ln, 0) AS ln
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, SUM(c) AS n FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN l USING (lang)),
p AS MATERIALIZED (
  SELECT lang, source, term, COALESCE(c, 0) AS c, {p.format(c="COALESCE(c, 0)", n="n")} AS p, {p.format(c="tc", n="ln")} AS q
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(COALESCE(SUM((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  WHERE x.term IS NULL OR y.term IS NOT NULL
  GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE c > 0 AND p > q),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "binary") AS INTEGER) AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""
