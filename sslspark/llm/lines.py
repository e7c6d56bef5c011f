"""Line dedup by a segment-partition edit join.

Lines within a few edits of each other are copies; of each class of linked
lines the first one (smallest document id, then line number) stays.

A line that may have ``t`` edits is cut into ``t + 1`` segments; a line within
``t`` edits has one of these segments unchanged, at a place that the segment's
number confines to a few.  The index holds (length class, number, segment); the
lines of the class, and longer ones within reach of it, probe it with their
substrings at those places.  Lines that meet there are compared, each pair once:
by their lengths, by counts of their characters, and by an edit distance along
diagonals, for many edits over a band of ``2 t + 1`` of them in one integer's bits.

The edits allowed grow with the shorter line: none below 25 characters, one
below 50, two below 300, from there one for every 75 characters.

* The lines of a class have segments of one size.  Half of them are counted from
  the line's start and half from its end: if each of the first ``h + 1`` and of
  the last ``t - h`` segments had an edit that moves the next ones, there would be
  more than ``t``; so one segment ``i`` of these is unchanged and moved by ``i``
  places at most.
* From 300 characters on these places are many, so a segment is known by the
  gram of it that is the smallest by hash; a probe takes the smallest grams at
  its places, most of which are the same one.
* From 9,600 characters on even these are many.  Lines within their edits have 60
  unchanged characters in a row, so they share a gram that is the smallest of
  some window of grams (winnowing); it is joined with the classes of the line's
  length and its place.

Equal lines are one line from the start.  Few lines that meet under a key are
given out as pairs, and a pair that met under many keys is compared once.  Of
more lines (``few``) a spanning forest leaves the bucket, never all pairs; beyond
``block`` lines the bucket is compared in pairs of blocks, so no task holds more
than two blocks.

Lines shorter than ``min_chars`` are left out of the edit join; equal lines of
``exact_chars`` characters or more are copies (by default ``min_chars``, so
shorter lines are left alone; the query and the pipeline take every line that
is not empty).

Defined cases: a null text stays null and has no lines; repeated rows (same id
and text) get the same result; ties go to the smaller id and line number; lines
without any document id come after all others; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sslspark.llm.common import connected_components, free, stored

MIN_CHARS = 20
#: Shortest line of which exact copies go, in the query and the pipeline.
EXACT_CHARS = 1
#: Long lines: their length, characters of a line for each edit.
LONG, RATE = 300, 75
#: Characters of a gram; length of very long lines, and grams of their windows.
GRAM, WIDE, WINDOW = 28, 9600, 33
#: Most edits that are followed along their diagonals.
FAR = 48
#: Least number of tasks that compare the lines of large keys.
TASKS = 96


def allowed(length: int) -> int:
    """Edits that a line may be away from a shorter line of this length."""
    return 0 if length < 25 else 1 if length < 50 else 2 if length < LONG else length // RATE


def _reaches(a: str, b: str, k: int) -> bool:
    """Whether ``k`` edits lead from ``a`` to ``b``: for each number of edits the
    farthest place of ``a`` on each diagonal from which the last one is still
    within reach.  About ``k * k / 2`` steps, whatever the length of the lines."""
    n, m = len(a), len(b)
    last = m - n
    if abs(last) > k:
        return False
    far = [-2] * (2 * k + 3)  # of diagonal ``d`` (place in ``b`` less that in ``a``) at ``d + k + 1``
    far[k + 1] = -1
    for e in range(k + 1):
        new = [-2] * (2 * k + 3)
        for d in range(max(-e, last - k + e), min(e, last + k - e) + 1):
            at = d + k + 1
            i = max(far[at] + 1, far[at - 1], far[at + 1] + 1)  # changed, put in, left out
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            j = i + d
            while i < n and j < m and a[i] == b[j]:
                if a[i:i + 32] == b[j:j + 32]:
                    step = min(32, n - i, m - j)
                    i += step
                    j += step
                else:
                    i += 1
                    j += 1
            if d == last and i == n:
                return True
            new[at] = i
        far = new
    return False


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is ``k`` or less.

    Few edits are followed along their diagonals (``_reaches``).  For many, column
    by column of ``b``: bit ``t`` stands for row ``j - k + t``.  The
    vertical differences of the band are two integers; the distance is counted
    along the diagonal on which the two ends lie, and only grows there."""
    if abs(len(a) - len(b)) > k:
        return False
    n = min(len(a), len(b))
    lo = 0
    step = 64
    while lo < n:  # common beginning
        if a[lo:lo + step] == b[lo:lo + step]:
            lo += min(step, n - lo)
        else:
            while lo < n and a[lo] == b[lo]:
                lo += 1
            break
    hi, x, y = 0, len(a), len(b)
    while hi + step <= n - lo and a[x - hi - step:x - hi] == b[y - hi - step:y - hi]:  # common end
        hi += step
    while hi < n - lo and a[x - 1 - hi] == b[y - 1 - hi]:
        hi += 1
    a, b = a[lo:len(a) - hi], b[lo:len(b) - hi]
    if not a or not b:
        return max(len(a), len(b)) <= k
    if k <= FAR:
        return _reaches(a, b, k)
    diagonal = len(a) - len(b)
    distance = abs(diagonal)
    full = (1 << 2 * k + 1) - 1
    up, down = full >> k << k, 0
    where: dict[str, int] = {}  # the places of each character in ``a``, as bits
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    for j in range(1, len(b) + 1):
        first = j - k - 1
        places = where.get(b[j - 1], 0)
        equal = (places >> first if first >= 0 else places << -first) & full
        x = equal | down
        zero = ((up + (x & up)) ^ up | x) & full
        right_down = up & zero
        right_up = (down | ~(up | zero)) & full
        if j > -diagonal and not zero >> k + diagonal & 1:
            distance += 1
            if distance > k:
                return False
        zero >>= 1
        up = (right_down | ~(right_up | zero)) & full
        down = right_up & zero
    return distance <= k


def keys_of(line: str) -> list[int]:
    """Index and probe keys of a line.  For the line's own length an index
    entry is also the probe at that place."""
    keys = class_keys([line])[0].tolist()
    if len(line) >= WIDE:
        keys += gram_keys([line])[0].tolist()
    return list(dict.fromkeys(keys))


#: What each task computes once: powers of a base, places of a class.
_POWERS: dict[int, np.ndarray] = {}
_PLACES: dict[int, tuple] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """The first ``n + 1`` powers of ``base``, at least."""
    if len(_POWERS.get(base, ())) <= n:
        out = np.full(max(n + 1, 1 << 16), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[base]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


class _Sums:
    """Hashes of substrings of many lines, by differences of one running sum."""

    base = 0x5851F42D4C957F2D

    def __init__(self, lines: list[str]):
        self.sizes = np.array([len(x) for x in lines], np.int64)
        self.ends = np.cumsum(self.sizes)
        c = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(c) * _powers(len(c), self.base)[:len(c)], dtype=np.uint64)])
        self.back = _powers(len(c), pow(self.base, -1, 1 << 64))

    def least(self, width: int) -> np.ndarray:
        """The smallest hash of ``width`` grams from each place on."""
        out = _mixed((self.sums[GRAM:] - self.sums[:-GRAM]) * self.back[:len(self.sums) - GRAM])
        done = 1
        while done < width:
            step = min(done, width - done)
            out = np.minimum(out[:-step], out[step:])
            done += step
        return out

    def grams(self) -> np.ndarray:
        return self.least(1)

    def at(self, start: np.ndarray, size: int) -> np.ndarray:
        return _mixed((self.sums[start + size] - self.sums[start]) * self.back[start])


def _classes() -> np.ndarray:
    """Least length of each class of lines, and of the very long ones: short
    classes grow by an eighth, long ones have one number of edits each."""
    out = [25]
    while out[-1] < LONG:
        stop = 50 if out[-1] < 50 else LONG
        out.append(min(stop, out[-1] + max(4, out[-1] // 8)))
    return np.array([*out, *range(LONG + RATE, WIDE + 1, RATE)])


LEAST = _classes()


def _places(kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Of a class of lines: probe places from the start, probe places from the
    end, the segment numbers of both, and the segments' size."""
    if kind in _PLACES:
        return _PLACES[kind]
    edits = allowed(int(LEAST[kind]))
    size = int(LEAST[kind]) // (edits + 1)
    half = edits // 2
    left = [(i * size + d, i) for i in range(half + 1) for d in range(-i, i + 1)]
    right = [(-(j + 1) * size + d, edits - j) for j in range(edits - half) for d in range(-j, j + 1)]
    _PLACES[kind] = (np.array([x for x, _ in left]), np.array([x for x, _ in right]), np.array([i for _, i in left], np.uint64),
                     np.array([i for _, i in right], np.uint64), size)
    return _PLACES[kind]


def class_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of lines below ``WIDE`` characters, and the number of each key's
    line: of a line's own class, and of the class below if it is within reach."""
    sizes = np.array([len(x) for x in lines], np.int64)
    own = np.searchsorted(LEAST, sizes, side="right") - 1
    edits = np.array([allowed(n) for n in LEAST.tolist()])
    keys, whose = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for below in (0, 1):
        use = np.flatnonzero((own > 0) & (sizes - LEAST[own] < edits[own - 1]) if below else (own >= 0) & (own < len(LEAST) - 1))
        for kind in np.unique(own[use]).tolist():
            some = use[own[use] == kind]
            text = _Sums([lines[k] for k in some.tolist()])
            left, right, number, last, size = _places(kind - below)
            start = np.concatenate([(text.ends - text.sizes)[:, None] + left, text.ends[:, None] + right], axis=1)
            number = np.concatenate([number, last])
            tag = _mixed(number + np.uint64(kind - below << 20 | 1 << 40))
            if LEAST[kind - below] < LONG:
                value, new = text.at(start, size), np.ones(start.shape, bool)
            else:
                value = text.least(size - GRAM + 1)[start]
                new = np.ones(start.shape, bool)
                new[:, 1:] = (value[:, 1:] != value[:, :-1]) | (number[1:] != number[:-1])
            keys.append(_mixed(value ^ tag)[new])
            whose.append(np.repeat(some, new.sum(1)))
    return np.concatenate(keys), np.concatenate(whose)


def gram_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of very long lines and the number of each key's line.

    The grams of all lines are hashed together, by differences of one running
    sum.  Of equal grams of a window the first is taken.  Lines of a pair and the
    places of a gram in them are at most ``length // RATE`` apart, so each key
    is given for the classes on both sides where a class ends in between."""
    text = _Sums(lines)
    sizes, ends, grams = text.sizes, text.ends, text.grams()
    low = np.uint64((1 << 24) - 1)
    least = grams & ~low | np.arange(len(grams), dtype=np.uint64) & low
    width = 1
    while width < WINDOW:  # smallest of ``width`` grams from each one on
        step = min(width, WINDOW - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    owner = np.repeat(np.arange(len(lines)), sizes)
    at = np.flatnonzero(np.arange(len(least)) + GRAM + WINDOW - 1 <= ends[owner[:len(least)]])
    least, owner = least[at], owner[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    at, owner = at[new], owner[new]
    at = at + ((least[new] & low).astype(np.int64) - at) % (1 << 24)  # places of the grams
    place = at - (ends - sizes)[owner]
    reach = sizes // RATE
    keys, whose = [], []
    kinds = [(np.log2(x) * 3).astype(np.int64) for x in (sizes, sizes - reach)]
    for k, kind in enumerate(kinds):
        wide = (2.0 ** (kind / 3) / 6).astype(np.int64)[owner]
        parts = [place // wide, (place + reach[owner]) // wide]
        for j, part in enumerate(parts):
            use = np.ones(len(at), bool) if not k else (kind != kinds[0])[owner]
            if j:
                use &= part != parts[0]
            keys.append(_mixed(grams[at[use]] ^ _mixed((kind[owner[use]] << 40 | part[use]).astype(np.uint64) + np.uint64(1))))
            whose.append(owner[use])
    return np.concatenate(keys), np.concatenate(whose)


def _digest(line: bytes) -> bytes:
    import xxhash
    return xxhash.xxh3_128_digest(line)


def _uid(id_col: str, text_col: str):
    return F.xxhash64(id_col, text_col).alias("uid")


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    kind, arrow_kind = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                row, no, line, short = [], [], [], []
                for k, text in enumerate(part.column(2).to_pylist()):
                    for n, x in enumerate((text or "").split("\n")):
                        if len(x) >= min_chars:
                            row.append(k)
                            no.append(n)
                            line.append(_digest(x.encode()))
                            short.append(int.from_bytes(line[-1][:8], "little", signed=True))
                pick = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pick), part.column(1).take(pick).cast(arrow_kind), pa.array(no, pa.int32()), pa.array(line, pa.binary()),
                     pa.array(short, pa.int64())], names=["uid", id_col, "no", "line", "short"])

    return docs.select(_uid(id_col, text_col), id_col, text_col).mapInArrow(run, f"uid long, `{id_col}` {kind}, no int, line binary, short long")


def _keys(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """``key, short`` (64 bits of the line's digest); lines met before in a
    task are left out, as far as a bounded memory goes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def out(keys: np.ndarray, shorts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(shorts, pa.int64())], names=["key", "short"])

        def found(lines: list[str], own: list[int]) -> Iterator[pa.RecordBatch]:
            of = np.array(own, np.int64)
            keys, whose = class_keys(lines)
            yield out(keys, of[whose])
            wide = [k for k, x in enumerate(lines) if len(x) >= WIDE]
            if wide:
                keys, whose = gram_keys([lines[k] for k in wide])
                yield out(keys, of[wide][whose])

        for batch in batches:
            lines, own, size = [], [], 0
            for text in batch.column(0):
                for x in (text.as_py() or "").split("\n"):
                    if len(x) >= min_chars and allowed(len(x)):
                        short = int.from_bytes(_digest(x.encode())[:8], "little", signed=True)
                        if short not in seen:
                            if len(seen) >= 100_000:
                                seen.clear()
                            seen.add(short)
                            lines.append(x)
                            own.append(short)
                            size += len(x)
                            if size > 2_000_000:
                                yield from found(lines, own)
                                lines, own, size = [], [], 0
            if lines:
                yield from found(lines, own)

    return docs.select(text_col).mapInArrow(run, "key long, short long")


def _runs(cols: list[np.ndarray]) -> np.ndarray:
    change = np.ones(len(cols[0]), bool)
    change[1:] = False
    for c in cols:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _shared(keys: DataFrame, few: int, block: int) -> DataFrame:
    """What meets under a key: ``key, a, b, block``.  Up to ``few`` lines of a
    key come as pairs ``a < b`` (block -1); of more, each comes as ``a`` with the
    number of its block.  The rows of a key are streamed in order; no more than
    ``few`` and a batch are held."""
    names = ["key", "a", "b", "block"]

    def rows(key, a, b, number) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(number, pa.int32())], names=names)

    def met(key: np.ndarray, short: np.ndarray, base: int, more: bool) -> Iterator[pa.RecordBatch]:
        """Whole runs of keys; ``base`` lines of the first key went out before, and its run is a large one if ``more``."""
        starts = _runs([key])
        sizes = np.diff(np.append(starts, len(key)))
        run_ = np.repeat(np.arange(len(starts)), sizes)
        large = sizes > few
        large[0] |= more
        number = np.arange(len(key)) - starts[run_]
        number[:sizes[0]] += base
        big = large[run_]
        if big.any():
            yield rows(key[big], short[big], np.zeros(big.sum(), np.int64), number[big] // block)
        key, short, run_ = key[~big], short[~big], run_[~big]
        for lag in range(1, few):
            at = np.flatnonzero(run_[lag:] == run_[:-lag])
            if not len(at):
                break
            yield rows(np.zeros(len(at), np.int64), short[at], short[at + lag], np.full(len(at), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64))
        last = None  # the last line that went out of the first run held, if it is a large one
        base = 0
        for batch in batches:
            key, short = (np.append(h, c.to_numpy(zero_copy_only=False)) for h, c in zip(held, batch.columns, strict=True))
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (short[1:] != short[:-1])
            if last is not None:
                new[0] = (key[0], short[0]) != last
            key, short = key[new], short[new]
            if not len(key):
                held = (key, short)
                continue
            if last is not None and key[0] != last[0]:
                last, base = None, 0
            cut = int(_runs([key])[-1])
            if cut:
                yield from met(key[:cut], short[:cut], base, last is not None)
                key, short, last, base = key[cut:], short[cut:], None, 0
            if len(key) > few or last is not None:  # a large run: its lines go out as they come
                yield from met(key, short, base, True)
                base += len(key)
                last = (key[-1], short[-1])
                key, short = key[:0], short[:0]
            held = (key, short)
        if len(held[0]):
            yield from met(*held, base, last is not None)

    return keys.repartition("key").sortWithinPartitions("key", "short").mapInArrow(run, "key long, a long, b long, block int")


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``short, line, text`` of the lines ``wanted(uid, line)``, from their documents."""
    at = wanted.groupBy("uid").agg(F.collect_set("line").alias("lines"))
    rows = docs.select(_uid(id_col, text_col), F.col(text_col).alias("text")).join(at, "uid").select("text", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                out: dict[bytes, str] = {}
                for text, lines in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    left = set(lines)
                    for x in text.split("\n"):
                        if (d := _digest(x.encode())) in left:
                            out[d] = x
                yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(d[:8], "little", signed=True) for d in out], pa.int64()), pa.array(list(out), pa.binary()),
                                                  pa.array(list(out.values()), pa.string())], names=["short", "line", "text"])

    return rows.mapInArrow(run, "short long, line binary, text string").dropDuplicates(["line"])


CHARS, PAIRS = 31, 512


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _char_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(c % CHARS, minlength=CHARS)


def _pair_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount((c[1:] * np.uint32(37) + c[:-1] * np.uint32(101)) % PAIRS, minlength=PAIRS)


def _counts(texts: list[str]) -> np.ndarray:
    """Counts of characters by class, then of pairs of neighbours: each edit
    moves at most two of the first and four of the others by one."""
    out = np.empty((len(texts), CHARS + PAIRS), np.int32)
    for k, t in enumerate(texts):
        c = _points(t)
        out[k, :CHARS], out[k, CHARS:] = _char_counts(c), _pair_counts(c)
    return out


def _may_link(a: str, b: str, edits: int) -> bool:
    """As ``_alike`` for one pair; pairs of neighbours only where the characters agree."""
    c, d = _points(a), _points(b)
    return (np.abs(_char_counts(c) - _char_counts(d)).sum() <= 2 * edits
            and np.abs(_pair_counts(c) - _pair_counts(d)).sum() <= 4 * edits)


def _alike(a: np.ndarray, b: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Which rows of counts don't rule out that many edits."""
    near = np.flatnonzero(np.abs(a[:, :CHARS] - b[..., :CHARS]).sum(1) <= 2 * edits)
    b = b if b.ndim == 1 else b[near]
    return near[np.abs(a[near, CHARS:] - b[..., CHARS:]).sum(1) <= 4 * edits[near]]


class _Known:
    """What is known of lines that meet again and again under other keys of one
    leading line: their counts, which were compared, and which are linked."""

    def __init__(self, most: int = 2_000_000):
        self.parent: dict[bytes, bytes] = {}
        self.bags: dict[bytes, np.ndarray] = {}
        self.compared: dict[bytes, set[bytes]] = {}
        self.size = 0
        self.most = most

    def root(self, x: bytes) -> bytes:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def link(self, a: bytes, b: bytes) -> None:
        self.parent[self.root(a)] = self.root(b)

    def counts(self, lines: list[bytes], texts: list[str]) -> np.ndarray:
        if len(self.bags) > self.most // 200:
            self.bags.clear()
        new = {x: t for x, t in zip(lines, texts) if x not in self.bags}
        if new:
            self.bags.update(zip(new, _counts(list(new.values()))))
        return np.stack([self.bags[x] for x in lines])

    def new(self, x: bytes, lines: list[bytes]) -> list[int]:
        """Which lines ``x`` was not compared with yet; from now on it was."""
        if self.size > self.most:
            self.compared.clear()
            self.size = 0
        mine = self.compared.setdefault(x, {x})
        out = [k for k, y in enumerate(lines) if y not in mine]
        for k in out:
            self.compared.setdefault(lines[k], {lines[k]}).add(x)
        mine.update(lines)
        self.size += 2 * len(out)
        return out


def _forest(lines: list[bytes], texts: list[str], known: _Known) -> Iterator[tuple[bytes, bytes]]:
    """Spanning links of one bucket, but for those known.  Lines of the largest
    component known need not be compared with each other, so the others are
    compared with all that they were not compared with yet."""
    roots = [known.root(x) for x in lines]
    most, n = Counter(roots).most_common(1)[0]
    if n == len(lines):
        return
    size = edits = bags = None
    for i in [k for k, r in enumerate(roots) if r != most]:
        new = known.new(lines[i], lines)
        if not new:
            continue
        if size is None:
            size = np.array([len(t) for t in texts])
            edits = np.array([allowed(k) for k in size.tolist()])
            bags = known.counts(lines, texts)
        near = np.array(new)
        reach = np.minimum(edits[near], edits[i])
        close = np.abs(size[near] - size[i]) <= reach
        near, reach = near[close], reach[close]
        some = _alike(bags[near], bags[i], reach)
        for j, k in zip(near[some].tolist(), reach[some].tolist()):
            if known.root(lines[i]) != known.root(lines[j]) and within(texts[i], texts[j], k):
                known.link(lines[i], lines[j])
                yield lines[i], lines[j]


def _verified(pairs: DataFrame) -> DataFrame:
    """Of ``line_a, text_a, line_b, text_b`` the links ``a, b``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                size = [np.asarray(pc.utf8_length(part.column(c))).astype(np.int64) for c in (1, 3)]
                k = np.array([allowed(n) for n in np.minimum(*size).tolist()])
                part, k = part.take(pa.array(np.flatnonzero(np.abs(size[0] - size[1]) <= k))), k[np.abs(size[0] - size[1]) <= k]
                if not part.num_rows:
                    continue
                a, x, b, y = (c.to_pylist() for c in part.columns)
                found = [(a[i], b[i]) for i, n in enumerate(k.tolist()) if a[i] != b[i] and _may_link(x[i], y[i], n) and within(x[i], y[i], n)]
                yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in found], pa.binary()) for c in (0, 1)], names=["a", "b"])

    return pairs.mapInArrow(run, "a binary, b binary")


def _once(met: DataFrame) -> DataFrame:
    """``met`` with one key for each set of lines: close lines share many keys,
    and comparing the same lines again finds nothing new.  Sets are told apart
    by their sizes and 128 bits."""
    sets = met.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("short")).alias("x"), F.bit_xor(F.xxhash64("short", F.lit(1))).alias("y"))
    one = sets.groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    return stored(met.join(stored(one.select("key"), "sets"), "key", "left_semi"), "met")


def links(docs: DataFrame, per_line: DataFrame, id_col: str, text_col: str, min_chars: int, block: int, few: int = 16) -> DataFrame:
    """Spanning links ``a, b`` (digests) between different lines."""
    shared = stored(_shared(_keys(docs, text_col, min_chars), min(few, block), block), "shared")
    pairs = stored(shared.where("block < 0").select("a", "b").distinct(), "pairs")
    met = _once(shared.where("block >= 0").select("key", F.col("a").alias("short"), "block"))
    shorts = stored(met.select("short").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("short"))).distinct(), "shorts")
    texts = stored(_texts(docs, per_line.join(shorts, "short").select("uid", "line"), id_col, text_col), "texts")
    of = lambda c: texts.select(F.col("short").alias(c), F.col("line").alias(f"line_{c}"), F.col("text").alias(f"text_{c}"))
    few_links = _verified(pairs.join(of("a"), "a").join(of("b"), "b").select("line_a", "text_a", "line_b", "text_b"))
    leads = met.groupBy("key").agg(F.min("short").alias("lead"), F.max("block").alias("blocks"))
    units = (met.join(leads, "key").select("key", "short", "block", "lead", "blocks", F.explode(F.sequence(F.lit(0), "blocks")).alias("other"))
             .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "lead", "blocks", "short")
             # keys of one leading line one after the other, as much the same lines meet there; pairs of blocks anywhere
             .withColumn("lead", F.when(F.col("blocks") == 0, F.col("lead")).otherwise(F.xxhash64("key", "i", "j"))))
    by = ["lead", "key", "i", "j"]
    # a number of tasks of its own: few bytes can be much work, so tasks must not be merged by their bytes
    tasks = max(TASKS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    full = units.join(texts, "short").select(*by, "line", "text").repartition(tasks, "lead").sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        known: list = [None, None]  # the leading line, and what is known of its lines

        def solve(t: pa.Table) -> pa.RecordBatch:
            starts = _runs([t[c].to_numpy() for c in by])
            ends = np.append(starts[1:], t.num_rows)
            leads, lines, texts = t["lead"].to_numpy(), t["line"].to_pylist(), t["text"].to_pylist()
            found = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if leads[s] != known[0]:
                    known[:] = [leads[s], _Known()]
                found += _forest(lines[s:e], texts[s:e], known[1])
            return pa.RecordBatch.from_arrays([pa.array([p[x] for p in found], pa.binary()) for x in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch])
            cut = int(_runs([t[c].to_numpy() for c in by])[-1])
            if cut:
                yield solve(t.slice(0, cut))
            held = t.slice(cut).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    return full.mapInArrow(run, "a binary, b binary").unionByName(few_links)


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, block: int = 2048,
                    exact_chars: int | None = None) -> DataFrame:
    """``uid, <id>, nos``: for each document with any, the numbers of the lines that go."""
    rows = stored(_lines(docs, id_col, text_col, min_chars if exact_chars is None else min(exact_chars, min_chars)), "lines")
    per_line = stored(rows.groupBy("line").agg(F.min("uid").alias("uid"), F.min("short").alias("short"), F.count("*").alias("n")), "per_line")
    roots = connected_components(links(docs, per_line, id_col, text_col, min_chars, block)).withColumnRenamed("node", "line")
    place = F.struct(F.col(id_col).isNull().alias("x"), F.col(id_col).alias("d"), "uid", "no")
    linked = roots.select("line").unionByName(roots.select(F.col("root").alias("line")))
    more = per_line.where("n > 1").select("line")  # lines that stand alone go no further
    some = stored(rows.join(stored(linked.unionByName(more).distinct(), "wanted"), "line").drop("short"), "some")
    classes = stored(some.groupBy("line").agg(F.min(place).alias("first")).join(roots, "line", "left")
                     .select("line", "first", F.coalesce("root", "line").alias("root")), "classes")
    firsts = classes.groupBy("root").agg(F.min("first").alias("first"))
    keep = classes.select("line", "root").join(firsts, "root").select("line", "first")
    gone = some.join(keep, "line").where(~place.eqNullSafe(F.col("first")))
    return gone.groupBy("uid", id_col).agg(F.collect_set("no").alias("nos"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, block: int = 2048,
                exact_chars: int | None = None) -> DataFrame:
    """``docs`` with the text left over, and ``n_lines, n_removed`` appended
    (columns of these names are replaced)."""
    docs = docs.drop("n_lines", "n_removed")
    rest = list(docs.columns)
    own, uid, doc, nos = (free(rest, x) for x in ("own", "uid", "doc", "nos"))
    gone = (duplicate_lines(docs.select(id_col, text_col), id_col, text_col, min_chars, block, exact_chars)
            .select(F.col("uid").alias(uid), F.col(id_col).alias(doc), F.col("nos").alias(nos)))
    rows = docs.select("*", _uid(id_col, text_col).alias(own)).join(
        gone, (F.col(own) == F.col(uid)) & F.col(id_col).eqNullSafe(F.col(doc)), "left").select(*rest, nos)
    kinds = {f.name: to_arrow_type(f.dataType) for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts, n, m = [], [], []
                for text, nos in zip(part.column(rest.index(text_col)).to_pylist(), part.column(len(rest)).to_pylist(), strict=True):
                    every = [] if text is None else text.split("\n")
                    out = set(nos or ())
                    n.append(len(every))
                    m.append(len(out))
                    texts.append("\n".join(x for k, x in enumerate(every) if k not in out) if out else text)
                cols = [pa.array(texts, pa.string()) if c == text_col else part.column(k).cast(kinds[c]) for k, c in enumerate(rest)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=[*rest, "n_lines", "n_removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return rows.mapInArrow(run, schema + ", n_lines long, n_removed long")
