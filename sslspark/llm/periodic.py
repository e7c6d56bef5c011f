"""Periodic run detection by maximal-pair enumeration.

A run is a stretch of words with smallest period ``q`` that no neighbouring
word extends keeping ``q``, of ``max(min_length, min_exponent * q)`` words or
more.  A run of period ``q`` from word ``s`` on is the maximal pair of the
suffixes ``s`` and ``s + q``: they share all but the last ``q`` words of the
run, and differ in the word before and the word after.  The other way round, a
maximal pair whose distance ``d`` meets the length constraint is a run, so
nothing is extended; multiples of the period give the same stretch again, the
smallest distance names it.

Each document is worked on by itself, in the partition in which Spark reads it:

1. Suffixes whose first words (a gram as long as the shortest common prefix
   that counts) occur once in the document are below no node that counts.  The
   others, with as many words as decide their order, are sorted by prefix
   doubling (exact ranks, lexicographic), and the ranks of all rounds give the
   longest common prefixes of neighbours.
2. A suffix whose nearest neighbour of the same gram is farther away than its
   longest common prefix allows is in no pair, and leaves the tree.
3. The intervals of the others are closed bottom-up.  A node keeps its suffixes
   in order of place, and the same for every class of left word.  The smaller
   child is merged into the larger; each of its suffixes looks at the places
   within the distance allowed at this depth, and jumps over those of its own
   class.  Occurrences of a long prefix so close to each other are equally
   spaced with one left word inside, so few pairs are looked at that don't count.

Defined cases: a null text has no words; a text with fewer words than a run has
none; equal rows get equal results; white space is not part of words, so texts
that differ in it only have the same runs; the collapsed text joins the words
kept by single spaces; an empty table gives no rows; columns of the result's
names are replaced, all others are kept.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Words as the operator takes them, for expressions over the same words.
WORD = r"[^\x20\x09-\x0D]+"
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """A number for each different key, in the order in which they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _least_depth(min_length: int, min_exponent: int) -> int:
    """Shortest common prefix that a run of any period has."""
    depth = 1
    while depth + depth // (min_exponent - 1) < min_length:
        depth += 1
    return depth


def _candidates(words: np.ndarray, doc: np.ndarray, gram: int) -> np.ndarray:
    """Places whose next ``gram`` words come again in the same document (a
    hash only filters: places too many do no harm)."""
    n = len(words) - gram + 1
    if n < 2:
        return np.empty(0, np.int64)
    key = doc[:n].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    for j in range(gram):
        key = (key ^ words[j:j + n].astype(np.uint64) + np.uint64(1)) * _MIX
        key ^= key >> np.uint64(29)
    inside = doc[:n] == doc[gram - 1:gram - 1 + n]
    key = key[inside]
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order[1:]] == key[order[:-1]]
    return np.flatnonzero(inside)[np.sort(order[same[1:] | same[:-1]])]


def _segments(words: np.ndarray, doc: np.ndarray, at: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words that decide the order of the suffixes ``at``: each stretch of
    neighbouring places with ``gram`` more words, and an end of its own.
    Returns symbols, their places (-1 for ends), and where ``at`` are in them."""
    new = np.flatnonzero(np.diff(at, prepend=-9) != 1)
    first, last = at[new], at[np.append(new[1:], len(at)) - 1]
    after = np.searchsorted(doc, doc[first], side="right")  # end of the document
    sizes = np.minimum(last + 1 + gram, after) - first
    ends = np.cumsum(sizes + 1)
    place = np.arange(ends[-1]) - np.repeat(ends - sizes - 1 - first, sizes + 1)
    stop = ends - 1
    symbol = words[np.minimum(place, len(words) - 1)].astype(np.int64)
    symbol[stop] = int(words.max()) + 1 + np.arange(len(stop))
    place[stop] = -1
    keep = np.zeros(len(words) + 1, bool)
    keep[at] = True
    return symbol, place, np.flatnonzero(keep[place] & (place >= 0))


def _ranks(symbol: np.ndarray) -> list[np.ndarray]:
    """Ranks of the prefixes of 1, 2, 4, ... words of every suffix, until all differ."""
    out = [np.unique(symbol, return_inverse=True)[1].astype(np.int64)]
    n, step = len(symbol), 1
    while True:
        rank = out[-1]
        count = np.bincount(rank)
        open_ = np.flatnonzero(count[rank] > 1)
        if not len(open_):
            return out
        base = np.cumsum(count) - count  # the first rank of each class, if all were told apart
        fresh = base[rank]
        second = np.where(open_ + step < n, rank[np.minimum(open_ + step, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[open_]))
        r, s = rank[open_][order], second[order]
        head = np.ones(len(order), bool)
        head[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
        number = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
        begin = np.maximum.accumulate(np.where(np.append(True, r[1:] != r[:-1]), np.arange(len(order)), 0))
        fresh[open_[order]] = base[r] + number - begin
        out.append(np.unique(fresh, return_inverse=True)[1].astype(np.int64))
        step *= 2


def _common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common prefixes of the suffixes ``a`` and ``b``, pair by pair."""
    a, b, n = a.copy(), b.copy(), len(ranks[0])
    depth = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
        step = np.where(same, 1 << k, 0)
        a, b, depth = a + step, b + step, depth + step
    return depth


class _Node:
    """Suffixes below a node, in order of place, and so for each left word."""

    __slots__ = ("places", "classes")

    def __init__(self, place: int, left: int):
        self.places = [place]
        self.classes = {left: [place]}


def _neighbours(node: _Node, place: int, left: int, reach: int, lefts: dict[int, int]) -> Iterator[int]:
    """Places of ``node`` within ``reach`` of ``place`` that have another left
    word.  Where places of the same class follow one another in the list of
    all, a search by doubling finds the last of them."""
    own = node.classes.get(left)
    every = node.places
    for step in (1, -1):
        k = bisect_left(every, place) - (step < 0)
        while 0 <= k < len(every) and abs(every[k] - place) <= reach:
            if lefts[every[k]] != left:
                yield every[k]
                k += step
                continue
            c = bisect_left(own, every[k])

            def same(t: int) -> bool:
                return (0 <= k + step * t < len(every) and 0 <= c + step * t < len(own)
                        and every[k + step * t] == own[c + step * t])

            known, beyond = 0, 1
            while same(beyond):
                known, beyond = beyond, 2 * beyond
            while beyond - known > 1:
                middle = (known + beyond) // 2
                known, beyond = (middle, beyond) if same(middle) else (known, middle)
            k += step * beyond


def _merge(a: list[int], b: list[int]) -> None:
    """``b`` into the sorted list ``a``."""
    if len(b) * 8 < len(a):
        for x in b:
            insort(a, x)
    else:
        a.extend(b)
        a.sort()


def _pairs(places: list[int], depths: list[int], lefts: dict[int, int], min_length: int, min_exponent: int) -> Iterator[tuple[int, int, int]]:
    """Maximal pairs ``i, j, depth`` of the interval tree whose distance counts.
    ``depths[k]`` is the common prefix of the suffixes ``k - 1`` and ``k``."""
    lowest = _least_depth(min_length, min_exponent)

    def join(x: _Node, y: _Node, depth: int) -> Iterator[tuple[int, int, int]]:
        if len(x.places) < len(y.places):
            x, y = y, x
        reach = depth // (min_exponent - 1)
        if not (len(x.classes) == len(y.classes) == 1 and x.classes.keys() == y.classes.keys()):
            for left, some in y.classes.items():
                for p in some:
                    for other in _neighbours(x, p, left, reach, lefts):
                        if depth + abs(p - other) >= min_length:
                            yield min(p, other), max(p, other), depth
        _merge(x.places, y.places)
        for left, some in y.classes.items():
            if left in x.classes:
                _merge(x.classes[left], some)
            else:
                x.classes[left] = some
        both.append(x)

    stack: list[tuple[int, _Node]] = []  # open nodes below one another, each with the depth at which it meets the one before
    both: list[_Node] = []
    for place, depth in zip([*places, -1], [*depths, 0], strict=True):
        while stack and stack[-1][0] >= max(depth, lowest) and len(stack) > 1:
            at, node = stack.pop()
            before, other = stack.pop()
            yield from join(other, node, at)
            stack.append((before, both.pop()))
        if depth < lowest:
            stack.clear()
        if place >= 0:
            stack.append((depth, _Node(place, lefts[place])))


def runs_of(words: np.ndarray, doc: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """Runs ``start, length, period`` of numbered words; ``doc`` (ascending)
    tells the documents apart, starts are places in ``words``."""
    gram = _least_depth(min_length, min_exponent)
    at = _candidates(words, doc, gram)
    if len(at) < 2:
        return []
    # words of different documents differ, so that each document has a tree of its own
    own = np.unique(doc * np.int64(int(words.max()) + 1) + words, return_inverse=True)[1]
    symbol, place, suffix = _segments(own, doc, at, gram)
    ranks = _ranks(symbol)
    suffix = suffix[np.argsort(ranks[-1][suffix])]
    depth = np.concatenate(([0], _common(ranks, suffix[:-1], suffix[1:]))) if len(suffix) > 1 else np.zeros(1, np.int64)
    spot = place[suffix]
    # the nearest place of the same gram, and the longest prefix shared with any suffix
    tree = np.cumsum(depth < gram)
    order = np.lexsort((spot, tree))
    gap = np.full(len(spot) + 1, np.iinfo(np.int64).max)
    gap[1:-1] = np.where(tree[order[1:]] == tree[order[:-1]], np.diff(spot[order]), gap[0])
    nearest = np.empty(len(spot), np.int64)
    nearest[order] = np.minimum(gap[1:], gap[:-1])
    longest = np.maximum(depth, np.append(depth[1:], 0))
    live = np.flatnonzero(nearest <= longest // (min_exponent - 1))
    if len(live) < 2:
        return []
    between = np.minimum.reduceat(depth[:live[-1] + 1], np.append(0, live[:-1] + 1))
    spots = spot[live].tolist()
    before = np.where((spot[live] > 0) & (doc[np.maximum(spot[live] - 1, 0)] == doc[spot[live]]), words[np.maximum(spot[live] - 1, 0)], -1 - spot[live])
    lefts = dict(zip(spots, before.tolist(), strict=True))  # no word before: a class of its own
    best: dict[tuple[int, int], int] = {}
    for i, j, l in _pairs(spots, between.tolist(), lefts, min_length, min_exponent):
        stretch = (i, j - i + l)
        best[stretch] = min(best.get(stretch, j - i), j - i)
    return sorted((s, n, d) for (s, n), d in best.items())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_exponent: int = 4,
                  batch_bytes: int = 2_000_000) -> DataFrame:
    """``docs`` without the text, with ``n_words``, ``runs`` (start, length,
    period; by start, then period) and ``collapsed``: the words that no run
    contains after its first period."""
    if min_exponent < 2 or min_length < min_exponent:
        raise ValueError("a run repeats at least once")
    found = ["n_words", "runs", "collapsed"]
    rest = [f for f in docs.schema if f.name not in (*found, text_col)]
    names = [f.name for f in rest]
    kinds = [to_arrow_type(f.dataType) for f in rest]
    runs_kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def solve(part: pa.RecordBatch) -> pa.RecordBatch:
        numbers = _Numbers()
        split = [(t or b"").split() for t in part.column(len(names)).cast(pa.binary()).to_pylist()]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        begin = np.cumsum(sizes) - sizes
        words = np.concatenate([np.fromiter(map(numbers.__getitem__, x), np.int64, len(x)) for x in split])
        doc = np.repeat(np.arange(len(split)), sizes)
        runs: list[list[dict]] = [[] for _ in split]
        gone = np.zeros(len(words) + 1, np.int64)
        for s, n, q in runs_of(words, doc, min_length, min_exponent):
            d = int(doc[s])
            runs[d].append({"start": s - int(begin[d]), "length": n, "period": q})
            gone[s + q] += 1
            gone[s + n] -= 1
        kept = np.cumsum(gone)[:-1] == 0
        for r in runs:
            r.sort(key=lambda x: (x["start"], x["period"]))
        texts = [b" ".join(x if not r else [w for w, k in zip(x, kept[b:b + len(x)].tolist(), strict=True) if k])
                 for x, r, b in zip(split, runs, begin.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [part.column(k).cast(kind) for k, kind in enumerate(kinds)]
            + [pa.array(sizes), pa.array(runs, runs_kind), pa.array(texts, pa.binary()).cast(pa.string())], names=names + found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(len(names))), 0)))
            at = 0
            while at < batch.num_rows:  # rows by bytes, so very long texts stay apart
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + batch_bytes)))
                yield solve(batch.slice(at, upto - at))
                at = upto

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)
    return docs.select(*[F.col(f"`{n}`") for n in names], F.col(text_col)).mapInArrow(
        run, schema + "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text with the repetition that the query's contract asks for: with h
    the crc32 of the id, g = floor(h / 10), in every tenth document the words
    from a = g % n on repeat the first p = 1 + floor((n - a) / (3 + g % 8)) of
    them.  Other texts are unchanged."""
    h = f"crc32(CAST(CAST({id_col} AS STRING) AS BINARY))"
    g = F.floor(F.crc32(F.col(id_col).cast("string").cast("binary")) / 10).cast("long")
    tenth = F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0

    def repeat(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (g % 8 + 3)).cast("long")
        again = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.element_at(w, (a + i % p + 1).cast("int")))
        return F.concat_ws(" ", F.slice(w, F.lit(1), a.cast("int")), again)

    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))
    changed = F.element_at(F.transform(F.array(words), repeat), 1)  # the words are bound once
    return F.when(tenth & F.col(text_col).rlike(WORD), changed).otherwise(F.col(text_col))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``<id>, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256`` of ``periodic_runs``; the columns in the middle are of the
    run with the greatest length / period (ties: smallest start, then period)."""
    best = F.expr(
        "aggregate(runs, CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>), (b, x) -> "
        "CASE WHEN b IS NULL OR x.length * b.period > b.length * x.period OR (x.length * b.period = b.length * x.period"
        " AND (x.start < b.start OR (x.start = b.start AND x.period < b.period))) THEN x ELSE b END)")
    lines = F.expr("array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\\n')), '')")
    return found.withColumn("_best", best).select(
        id_col, F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
