"""Embedding near-dedup with a robust-pruned flat graph.

1. Equal vectors under one label are one node (with a count).
2. The nodes of a label are split into overlapping cluster shards: as long as a
   shard is too large, it is split around a few pivots fitted on a bounded
   sample; a node also goes to other pivots that are almost as near.  What is
   too tight for that is cut into blocks, and every two blocks are a shard: a
   split must leave clearly fewer nodes than blocks would.
3. Each shard builds its graph: robust pruning keeps, of a node's nearest and
   some random candidates, those that no kept one is much nearer to.
4. The adjacency lists of a node from all its shards are united: each shard gets
   those edges of the others of which it has both ends.
5. In each shard all nodes are searched for at once: a greedy search from the
   medoid, whose range then expands along every node found near enough.
   Pairs found are verified in double precision.  A pair that two shards share
   counts in the first one, and what leaves a shard is a link count for each
   node and a spanning forest, never the pairs.
6. The recall is audited on a bounded sample against brute force; below the
   target, the overlap and the search are widened and steps 2 to 5 run again.
   If ``rounds`` of that don't do, every two nodes of a group are compared, in blocks.

Defined cases: rows with a null label, or a null or zero vector, or one with
null or non-finite components, link with nothing; vectors of different lengths
don't link; repeated ids are separate vectors, under other labels too; ids may be
of any type that has an order; rows without an id are compared like others, are
no component's id where one of it has an id, and then are not kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sslspark.llm.common import connected_components, stored

FANOUT = 8
#: Pivots that share this part of the rows of the smaller one are as good as one.
SAME = 0.8
#: A split must leave at most this part of the nodes that shards of blocks would have.
GAIN = 0.8
#: Of each path that was split: its pivots, or the number of its blocks.  A path is the
#: parts taken (``.0.3``), ``@`` and the group.
Tree = dict[str, np.ndarray | int]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length, kept as the bytes of their doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def unit_rows(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``id, grp, v, key`` of every row: ``v`` is the vector at unit length, in
    double precision (the bytes of its doubles), ``grp`` its label and length, ``key``
    a digest of both; they are null where the row links with nothing."""
    given = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                ids, labels, lists = batch.slice(at, 2000).columns
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                start = np.cumsum(size) - size
                flat = lists.flatten().to_numpy(zero_copy_only=False)  # a null is NaN
                label = labels.to_pylist()
                out: list[list] = [[None] * len(label) for _ in range(3)]
                for d in np.unique(size[size > 0]).tolist():
                    idx = np.flatnonzero(size == d)
                    x = flat[start[idx][:, None] + np.arange(d)]
                    with np.errstate(all="ignore"):
                        norm = np.sqrt(np.add.accumulate(x * x, axis=1)[:, -1])  # summed in the order of the components
                        x = x / norm[:, None] + 0.0  # no -0.0
                        usable = np.isfinite(x).all(1) & (norm > 0) & (norm < np.inf)
                    for i, v in zip(idx[usable].tolist(), x[usable], strict=True):
                        if label[i] is not None:
                            out[0][i], out[1][i] = f"{d}:{label[i]}", v.tobytes()
                            out[2][i] = blake2b(out[0][i].encode() + b"\0" + out[1][i], digest_size=16).digest()
                yield pa.RecordBatch.from_arrays([ids, pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["id", "grp", "v", "key"])

    schema = given.select("id").schema.add("grp", "string").add("v", "binary").add("key", "binary")
    return given.mapInArrow(unit, schema)


def nodes(rows: DataFrame) -> DataFrame:
    """``grp, node, least, copies, v, key``: the different vectors of ``unit_rows``;
    ``node`` is a number of its own (fixed once the table is stored), ``least`` the
    smallest id."""
    return (rows.where(F.col("v").isNotNull()).groupBy("grp", "v", "key").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
            .withColumn("node", F.monotonically_increasing_id()))


def _hits(x: np.ndarray, pivots: np.ndarray, overlap: float) -> np.ndarray:
    """Which pivots are each row's nearest or almost as near."""
    near = x @ pivots.T
    return near >= near.max(1, keepdims=True) - overlap


def _pivots(x: np.ndarray, k: int, overlap: float) -> np.ndarray:
    """A few rounds of spherical k-means on a bounded sample of one shard; of pivots
    that share nearly all rows (several in one tight group) one stays."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(6):
        near = (x @ c.T).argmax(1)
        sums = np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    while len(c) > 1:
        hit = _hits(x, c, overlap).astype(np.float64)
        size = np.maximum(hit.sum(0), 1)
        same = hit.T @ hit / np.minimum(size, size[:, None])
        np.fill_diagonal(same, 0)
        i, j = np.unravel_index(same.argmax(), same.shape)
        if same[i, j] < SAME:
            break
        c = np.delete(c, i if size[i] < size[j] else j, axis=0)
    return c


def _places(tree: Tree, overlap: float, b: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """The paths that the rows of a batch lie at after all splits so far, each with its rows."""
    coded, v, block = b["grp"].dictionary_encode(), b["v"], b["block"].to_numpy()
    of = coded.indices.to_numpy()
    for g, name in enumerate(coded.dictionary.to_pylist()):
        own = np.flatnonzero(of == g)
        x = _matrix(v.take(pa.array(own))) if f"@{name}" in tree else None
        todo = [(f"@{name}", np.arange(len(own)))]
        while todo:
            path, idx = todo.pop()
            split, steps = tree.get(path), path[:len(path) - len(name) - 1]
            if split is None:
                yield path, own[idx]
            elif isinstance(split, int):  # every two blocks are a shard
                i = block[own[idx]] % split
                for j in range(split):
                    for k in range(j, split):
                        if len(both := idx[(i == j) | (i == k)]):
                            yield f"{steps}#{j}-{k}@{name}", own[both]
            else:
                hit = _hits(x[idx], split, overlap)
                todo += [(f"{steps}.{j}@{name}", idx[hit[:, j]]) for j in np.flatnonzero(hit.any(0)).tolist()]


def _up(path: str) -> str:
    steps, _, grp = path.partition("@")
    return f"{steps.rpartition('.')[0]}@{grp}"


def _blocks(n: int, max_shard: int) -> int:
    return -(-2 * n // max_shard) if n > max_shard else 1


def _split_groups(all_nodes: DataFrame, max_shard: int) -> dict[str, int]:
    """The groups larger than a shard; there are not more of them than such shards."""
    sizes = all_nodes.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > max_shard)
    return {f"@{r['grp']}": r["n"] for r in sizes.collect()}


def _parts(batches: Iterator[pa.RecordBatch], groups: set[str]) -> Iterator[pa.RecordBatch]:
    """Those rows whose group is one of ``groups``."""
    for b in batches:
        b = b.filter(pa.array([g in groups for g in b["grp"].to_pylist()], pa.bool_()))
        if b.num_rows:
            yield b


def shards(all_nodes: DataFrame, max_shard: int, overlap: float, sample: int = 64) -> Tree:
    """Splits after which no shard has more than ``max_shard`` nodes.  A level of
    splits takes two passes over the vectors, and nothing of them is written: a
    pass follows all splits so far.  What the driver and the tasks hold of a
    split is its pivots."""
    tree: Tree = {}
    given = all_nodes.select("grp", "node", "v", F.xxhash64(F.lit("block"), "node").alias("block"), F.pmod(F.xxhash64(F.lit("sample"), "node"), F.lit(1 << 30)).alias("draw"))
    large = _split_groups(all_nodes, max_shard)
    for _ in range(40):
        if not large:
            break
        rate = {path: (1 << 30) * FANOUT * sample / n for path, n in large.items()}  # about FANOUT * sample nodes of each, evenly by hash
        splits, wide = dict(tree), {path.partition("@")[2] for path in large}

        def chosen(batches: Iterator[pa.RecordBatch], splits: Tree = splits, rate: dict[str, float] = rate, wide: set[str] = wide) -> Iterator[pa.RecordBatch]:
            for b in _parts(batches, wide):
                draw = b["draw"].to_numpy()
                at = [(path, idx[draw[idx] < rate[path]]) for path, idx in _places(splits, overlap, b) if path in rate]
                if at:
                    rows = pa.array(np.concatenate([idx for _, idx in at]))
                    yield pa.RecordBatch.from_arrays([pa.array([path for path, idx in at for _ in idx], pa.string()), b["node"].take(rows), b["v"].take(rows)],
                                                     names=["path", "node", "v"])

        def fitted(t: pa.Table) -> pa.Table:
            t = t.sort_by("node")
            parts = min(FANOUT, _blocks(large[t["path"][0].as_py()], max_shard))
            return pa.table({"path": t["path"][:1], "pivots": pa.array([_pivots(_matrix(t["v"]), parts, overlap).tobytes()], pa.binary())})

        fits = given.mapInArrow(chosen, "path string, node long, v binary").groupBy("path").applyInArrow(fitted, "path string, pivots binary").collect()
        tree |= {r["path"]: np.frombuffer(r["pivots"]).reshape(-1, int(r["path"].partition("@")[2].partition(":")[0])) for r in fits}
        splits = dict(tree)

        def counted(batches: Iterator[pa.RecordBatch], splits: Tree = splits, fresh: frozenset[str] = frozenset(large), wide: set[str] = wide) -> Iterator[pa.RecordBatch]:
            total: dict[str, int] = {}
            for b in _parts(batches, wide):
                for path, idx in _places(splits, overlap, b):
                    if _up(path) in fresh:
                        total[path] = total.get(path, 0) + len(idx)
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.string()), pa.array(total.values(), pa.int64())], names=["path", "n"])

        sizes = {r["path"]: r["n"] for r in given.mapInArrow(counted, "path string, n long").groupBy("path").agg(F.sum("n").alias("n")).collect()}
        # where splitting saves little (a tight group, which every part has nearly whole), every two blocks of
        # the path make a shard instead: all pairs still meet, no shard is too large, and parts don't multiply
        cost = dict.fromkeys(large, 0)
        for path, n in sizes.items():
            cost[_up(path)] += n * _blocks(n, max_shard)
        stuck = {path for path, n in large.items() if path not in tree or cost[path] > GAIN * n * _blocks(n, max_shard)}
        tree |= {path: _blocks(large[path], max_shard) for path in stuck}
        large = {path: n for path, n in sizes.items() if n > max_shard and _up(path) not in stuck}
    return tree | {path: _blocks(n, max_shard) for path, n in large.items()}


def every_pair(all_nodes: DataFrame, max_shard: int) -> Tree:
    """Splits after which every two nodes of a group meet."""
    return {grp: _blocks(n, max_shard) for grp, n in _split_groups(all_nodes, max_shard).items()}


def _home(path: str) -> int:
    return int.from_bytes(blake2b(path.encode(), digest_size=8).digest(), "little", signed=True)


def members(all_nodes: DataFrame, tree: Tree, overlap: float) -> DataFrame:
    """``grp, home, node, copies, v, homes`` of the overlapping shards: ``home`` is the
    shard's number in its group, ``homes`` (bytes of 64-bit numbers) has those of all
    shards of the node."""
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = list(_places(tree, overlap, b))
            if not at:
                continue
            rows, home = np.concatenate([idx for _, idx in at]), np.repeat([_home(path) for path, _ in at], [len(idx) for _, idx in at])
            order = np.argsort(rows, kind="stable")
            rows, home = rows[order], home[order]
            end = np.cumsum(np.bincount(rows, minlength=b.num_rows)).tolist()
            lists = pa.array([home[i:j].tobytes() for i, j in zip([0, *end], end)], pa.binary())
            for i in range(0, len(rows), 10_000):
                idx = pa.array(rows[i:i + 10_000])
                yield pa.RecordBatch.from_arrays([b["grp"].take(idx), pa.array(home[i:i + 10_000]), *(b[c].take(idx) for c in ("node", "copies", "v")), lists.take(idx)],
                                                 names=["grp", "home", "node", "copies", "v", "homes"])

    return (all_nodes.select("grp", "node", "copies", "v", F.xxhash64(F.lit("block"), "node").alias("block"))
            .mapInArrow(placed, "grp string, home long, node long, copies long, v binary, homes binary"))


def robust_prune(x: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Adjacency (rows padded with -1) out of candidate lists ``pool``: the
    nearest candidate is kept, and candidates that it is ``alpha`` times nearer
    to than the node is are dropped; and so on."""
    out = np.full((len(pool), degree), -1, np.int64)
    for at in range(0, len(pool), 128):
        own = np.arange(at, min(at + 128, len(pool)))
        cand = pool[own]
        vec = x[np.maximum(cand, 0)]
        dist = 2 - 2 * (vec @ x[own][:, :, None])[:, :, 0]
        between = (2 - 2 * (vec @ vec.transpose(0, 2, 1))) * (alpha * alpha)
        dist[(cand < 0) | (cand == own[:, None])] = np.inf
        rows = np.arange(len(own))
        for r in range(degree):
            best = dist.argmin(1)
            ok = np.isfinite(dist[rows, best])
            if not ok.any():
                break
            out[own[ok], r] = cand[rows[ok], best[ok]]
            gone = between[rows, best] <= dist
            gone[rows, best] = True
            gone[~ok] = False
            dist[gone] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = 24, pool: int = 64, alpha: float = 1.2, seed: int = 7) -> np.ndarray:
    """Pruned adjacency of one shard, with reverse edges (2 * degree columns)."""
    m = len(x)
    k = min(pool - pool // 4, m)
    near = np.empty((m, k), np.int64)
    for at in range(0, m, 512):
        s = x[at:at + 512] @ -x.T
        near[at:at + 512] = np.argpartition(s, k - 1, axis=1)[:, :k] if k < m else np.arange(m)
    far = np.random.default_rng(seed).integers(0, m, (m, pool // 4))
    out = robust_prune(x, np.concatenate([near, far], axis=1), degree, alpha)
    src, dst = np.nonzero(out >= 0)[0], out[out >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    rank = np.arange(len(dst)) - np.searchsorted(dst, dst)
    back = np.full((m, pool), -1, np.int64)
    fits = rank < pool
    back[dst[fits], rank[fits]] = src[fits]
    return np.concatenate([out, robust_prune(x, back, degree, alpha)], axis=1)


def search(x: np.ndarray, graph: np.ndarray, bound: float, beam: int, slack: float = 0.1) -> np.ndarray:
    """For all rows of ``x`` at once: which rows are at cosine ``bound`` or
    above, as far as a greedy search from the medoid (``beam`` steps) and the
    expansion of everything within ``bound - slack`` come.  One matrix product
    gives a batch the cosines that it reads where it comes (far less work than to
    gather the vectors)."""
    m = len(x)
    medoid = int((x @ x.mean(0)).argmax())
    found = np.zeros((m, m), bool)
    into, to = np.nonzero(graph >= 0)[0], graph[graph >= 0]
    into = into[np.argsort(to, kind="stable")]
    degree = np.bincount(to, minlength=m)
    first = np.cumsum(degree) - degree
    graph = np.where(graph < 0, np.arange(m)[:, None], graph)
    for at in range(0, m, 128):
        q = np.arange(at, min(at + 128, m))
        sims = x[q] @ x.T
        seen = np.zeros((len(q), m), bool)
        todo = np.full((len(q), m), -np.inf)  # seen, not expanded
        seen[:, medoid], todo[:, medoid] = True, sims[:, medoid]
        rows = np.arange(len(q))

        for _ in range(beam):
            best = todo.argmax(1)
            live = np.isfinite(todo[rows, best])
            if not live.any():
                break
            r, c = rows[live], best[live]
            todo[r, c] = -np.inf
            r, c = np.repeat(r, graph.shape[1]), graph[c].ravel()
            new = ~seen[r, c]
            r, c = r[new], c[new]
            seen[r, c], todo[r, c] = True, sims[r, c]
        near = sims >= bound - slack
        while True:
            front = near & (todo > -np.inf) & ~seen.all(1)[:, None]  # the other rows have nothing left to come to
            n_front, n_open = np.count_nonzero(front), np.count_nonzero(~seen[front.any(1)])
            if not n_front:
                break
            todo[front] = -np.inf
            new = np.zeros((len(q), m), bool)
            if n_front <= n_open:
                r, c = np.nonzero(front)
                for a in range(0, len(r), 20_000):
                    new[r[a:a + 20_000, None], graph[c[a:a + 20_000]]] = True
            else:  # fewer rows are still to see: look for those that have an edge from the front
                r, c = np.nonzero(~seen & front.any(1)[:, None])
                for a in range(0, len(r), 20_000):
                    size = degree[c[a:a + 20_000]]
                    at_edge = np.repeat(first[c[a:a + 20_000]] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    hit = front[np.repeat(r[a:a + 20_000], size), into[at_edge]]
                    got = np.repeat(np.arange(len(size)), size)[hit]
                    new[r[a + got], c[a + got]] = True
            new &= ~seen
            seen |= new
            np.copyto(todo, sims, where=new)
        found[q] = seen & (sims >= bound)
    found |= found.T
    np.fill_diagonal(found, False)
    return found


def _forest(found: np.ndarray) -> np.ndarray:
    """Smallest index reachable, for each row of a symmetric matrix."""
    label = np.arange(len(found))
    while True:
        least = label.copy()
        for at in range(0, len(found), 256):
            least[at:at + 256] = np.minimum(label[at:at + 256], np.where(found[at:at + 256], label, len(found)).min(1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _shared(t: pa.Table) -> tuple[int, list[tuple[int, np.ndarray]]]:
    """The number of a shard, and those of the others that rows of it lie in, each with these rows."""
    size = pc.binary_length(t["homes"]).to_numpy() // 8
    flat, row = np.frombuffer(b"".join(t["homes"].to_pylist()), np.int64), np.repeat(np.arange(len(size)), size)
    order = np.argsort(flat, kind="stable")
    homes, start = np.unique(flat[order], return_index=True)
    here = t["home"][0].as_py()
    return here, [(h, idx) for h, idx in zip(homes.tolist(), np.split(row[order], start[1:]), strict=True) if h != here]


def _adjacency(m: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Lists (rows padded with -1) of the different edges."""
    src, dst = np.divmod(np.unique(src * m + dst), m)
    rank = np.arange(len(src)) - np.searchsorted(src, src)
    out = np.full((m, max(1, rank.max(initial=0) + 1)), -1, np.int64)
    out[src, rank] = dst
    return out


def _built(t: pa.Table) -> pa.Table:
    """The lists of one shard: its own as numbers of its rows in the order of the
    nodes, and for each other shard the edges of which both ends lie there too."""
    t = t.sort_by("node")
    ids, graph = t["node"].to_numpy(), build_graph(_matrix(t["v"]))
    here, others = _shared(t)
    out: list[tuple[int, bytes | None, bytes | None, bytes | None]] = [(here, graph.astype(np.int32).tobytes(), None, None)]
    inside = np.zeros(len(ids) + 1, bool)  # the last is that of -1
    for other, idx in others:
        inside[idx] = True
        part = graph[idx]
        r, c = np.nonzero(inside[part])
        inside[idx] = False
        if len(r):
            out.append((other, None, ids[idx[r]].tobytes(), ids[part[r, c]].tobytes()))
    home, own, src, dst = zip(*out, strict=True)
    return pa.table({"grp": pa.array([t["grp"][0].as_py()] * len(out), pa.string()), "home": pa.array(home, pa.int64()),
                     "own": pa.array(own, pa.binary()), "src": pa.array(src, pa.binary()), "dst": pa.array(dst, pa.binary())})


def _united(ids: np.ndarray, edges: pa.Table) -> np.ndarray:
    """Adjacency of one shard: its own lists and what other shards have of its nodes."""
    m = len(ids)
    own = np.frombuffer(b"".join(b for b in edges["own"].to_pylist() if b is not None), np.int32).reshape(m, -1).astype(np.int64)
    more = [np.searchsorted(ids, np.frombuffer(b"".join(b for b in edges[c].to_pylist() if b is not None), np.int64)) for c in ("src", "dst")]
    return _adjacency(m, np.concatenate([np.nonzero(own >= 0)[0], more[0]]), np.concatenate([own[own >= 0], more[1]]))


def _counted(t: pa.Table, found: np.ndarray) -> pa.Table:
    """``node, links, pairs, root`` of those nodes of a shard that have links."""
    live = np.flatnonzero(found.any(1))
    if not len(live):
        return pa.table({c: pa.array([], pa.int64()) for c in ("node", "links", "pairs", "root")})
    t, found = t.take(pa.array(live)), found[np.ix_(live, live)]
    ids, root = t["node"].to_numpy(), _forest(found)
    here, others = _shared(t)
    for other, idx in others:
        if other < here:
            found[np.ix_(idx, idx)] = False  # counted in an earlier shard
    return pa.table({"node": ids, "links": found @ t["copies"].to_numpy(), "pairs": found.sum(1), "root": ids[root]})


def _once(all_nodes: DataFrame, bound: float, max_shard: int, overlap: float, beam: int, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """``node, links, pairs`` (vectors linked, and different ones of them) of the
    nodes that have links, and the forest; ``exact`` compares every two nodes of
    a group in blocks."""
    placed = members(all_nodes, every_pair(all_nodes, max_shard) if exact else shards(all_nodes, max_shard, overlap), overlap)

    def compared(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        x = _matrix(t["v"])
        found = x @ x.T >= bound
        np.fill_diagonal(found, False)
        return _counted(t, found)

    def searched(t: pa.Table, edges: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        return _counted(t, search(_matrix(t["v"]), _united(t["node"].to_numpy(), edges), bound, beam))

    by = placed.groupBy("grp", "home")
    result = "node long, links long, pairs long, root long"
    if exact:
        found = by.applyInArrow(compared, result)
    else:
        lists = by.applyInArrow(_built, "grp string, home long, own binary, src binary, dst binary")
        found = by.cogroup(lists.groupBy("grp", "home")).applyInArrow(searched, result)
    hits = stored(found, "hits")
    return hits.groupBy("node").agg(F.sum("links").alias("links"), F.sum("pairs").alias("pairs")), hits.select("node", "root")


def audit(all_nodes: DataFrame, links: DataFrame, bound: float, queries: int = 200) -> float:
    """Share of the true links that were found, for ``queries`` nodes at most
    (those with the smallest hash); brute force over all nodes.  The smaller of
    the shares by vectors and by different vectors, so that a large group of
    copies hides no lost pair."""
    h = F.xxhash64("node")
    sample = all_nodes.orderBy(h, "node").limit(queries).select("grp", "node", "v").collect()
    if not sample:
        return 1.0
    groups: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for g in {r["grp"] for r in sample}:
        own = [r for r in sample if r["grp"] == g]
        groups[g] = (np.array([r["node"] for r in own]), np.stack([np.frombuffer(r["v"]) for r in own]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = b["grp"].dictionary_encode()
            for k, g in enumerate(coded.dictionary.to_pylist()):
                if g in groups:
                    ids, x = groups[g]
                    part = b.filter(pc.equal(coded.indices, k))
                    near = x @ _matrix(part["v"]).T >= bound
                    near &= ids[:, None] != part["node"].to_numpy()[None, :]
                    yield pa.RecordBatch.from_pydict({"node": ids, "n": near @ part["copies"].to_numpy(), "m": near.sum(1)})

    true = (all_nodes.select("grp", "node", "copies", "v").mapInArrow(compare, "node long, n long, m long")
            .groupBy("node").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
    n, got, m, had = true.join(links, "node", "left").agg(F.sum("n"), F.sum(F.coalesce("links", F.lit(0))), F.sum("m"), F.sum(F.coalesce("pairs", F.lit(0)))).first()
    return min(float(got or 0) / n if n else 1.0, float(had or 0) / m if m else 1.0)


def embedding_dedup(vectors: DataFrame, bound: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    max_shard: int = 3000, overlap: float = 0.06, beam: int = 24, target: float = 0.95, rounds: int = 4) -> DataFrame:
    """``<id>, n_links, component_id, kept, audited_recall`` for every row."""
    rows = unit_rows(vectors, id_col, vec_col, label_col)
    all_nodes = stored(nodes(rows), "nodes")
    for _ in range(rounds):
        links, forest = _once(all_nodes, bound, max_shard, overlap, beam)
        links = stored(links, "links")
        recall = audit(all_nodes, links, bound)
        if recall >= target:
            break
        overlap, beam = 2 * overlap, 2 * beam
    else:  # the search does not come near enough: every two nodes of a group
        links, forest = _once(all_nodes, bound, max_shard, overlap, beam, exact=True)
        links, recall = stored(links, "links"), 1.0
    roots = connected_components(forest.withColumnsRenamed({"node": "a", "root": "b"}))
    by_node = stored(all_nodes.join(links, "node", "left").join(roots, "node", "left")
                     .select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "node").alias("root")), "by_node")
    least = by_node.groupBy("root").agg(F.min("least").alias("c"))
    per_node = by_node.join(least, "root").select("key", "n", "c", F.lit(True).alias("usable"))
    return (rows.select("id", "key").join(per_node, "key", "left")
            .select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("usable"), F.col("c")).otherwise(F.col("id")).alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
            .withColumn("audited_recall", F.lit(recall)))
