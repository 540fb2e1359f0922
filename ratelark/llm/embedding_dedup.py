"""Embedding near-dedup: a navigable small-world graph per shard, queried by every vector."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settings
from .common import Scratch, components, ragged, schema_of

#: Links of a node in upper layers; the lowest layer has twice as many.
LINKS = 16
#: Beam while a graph is built, and the beam that queries begin with.
BUILD_BEAM = 64
BEAM = 32
#: Nodes added to a layer, or queries worked on, at once.
BATCH = 512
#: Bytes of vectors in a shard, and the least number of shards; narrow vectors count as so many
#: bytes at least, for their ids and links.
SHARD_BYTES = 32 << 20
SHARDS = 8
LEAST_BYTES = 256
#: Queries that meet a shard in one go.
BLOCK = 8192
#: Settings under which every file is a partition of its own, and every row an Arrow batch.
APART = {"spark.sql.files.maxPartitionBytes": str(1 << 40),
         "spark.sql.files.openCostInBytes": str(1 << 40),
         "spark.sql.execution.arrow.maxRecordsPerBatch": "1"}
#: Queries with links, and as many without, that are audited against all vectors of the shard; the
#: recall asked for, and the chance that a bound on it does not hold.
AUDITED = 1024
RECALL = 0.99
DOUBT = 0.05
#: What single precision may take from a similarity.
SLACK = 1e-3
#: Similarities held at once where queries meet all vectors of a shard.
CELLS = 1 << 22


def _top(sims: np.ndarray, n: int) -> np.ndarray:
    """Columns of the ``n`` largest values of each row."""
    if sims.shape[1] <= n:
        return np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    return np.argpartition(-sims, n - 1, axis=1)[:, :n]


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray,
                beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` best nodes that a best-first walk from ``entries`` finds for each query, and
    their similarities; -1 where there are fewer.  All queries walk at once."""
    n = len(queries)
    line = np.arange(n)
    ids = np.full((n, beam), -1, np.int64)
    sims = np.full((n, beam), -np.inf, np.float32)
    closed = np.ones((n, beam), bool)
    visited = np.zeros((n, len(links)), bool)
    ids[:, 0] = entries
    sims[:, 0] = np.einsum("nd,nd->n", vectors[entries], queries)
    closed[:, 0] = False
    visited[line, entries] = True
    live = line
    while len(live):
        waiting = np.where(closed[live], -np.inf, sims[live])
        pick = _top(waiting, width)
        rows = np.arange(len(live))[:, None]
        fresh = waiting[rows, pick] > -np.inf
        some = fresh.any(1)
        live, pick, fresh = live[some], pick[some], fresh[some]
        if not len(live):
            break
        rows = live[:, None]
        closed[rows, pick] = True
        near = np.where(fresh[:, :, None], links[ids[rows, pick]], -1).reshape(len(live), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        new = (near >= 0) & ~visited[rows, near]
        most = max(1, int(new.sum(1).max()))
        front = np.argsort(~new, axis=1, kind="stable")[:, :most]
        inner = np.arange(len(live))[:, None]
        near, new = near[inner, front], new[inner, front]
        at, column = np.nonzero(new)
        visited[live[at], near[at, column]] = True
        found = np.full(near.shape, -np.inf, np.float32)
        found[at, column] = np.einsum("nd,nd->n", vectors[near[at, column]], queries[live[at]])
        all_sims = np.concatenate([sims[live], found], 1)
        best = _top(all_sims, beam)
        ids[live] = np.concatenate([ids[live], near], 1)[inner, best]
        closed[live] = np.concatenate([closed[live], ~new], 1)[inner, best]
        sims[live] = all_sims[inner, best]
    return ids, sims


def select_links(vectors: np.ndarray, found: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` neighbours of each row from candidates: first those that are closer to the
    row than to any neighbour already taken, then the closest of the others."""
    order = np.argsort(-sims, axis=1, kind="stable")
    line = np.arange(len(found))[:, None]
    found, sims = found[line, order], sims[line, order]
    valid = (found >= 0) & (sims > -np.inf)
    points = vectors[found]
    between = points @ points.transpose(0, 2, 1)
    taken = np.zeros(found.shape, bool)
    closest = np.full(found.shape, -np.inf, np.float32)
    for j in range(found.shape[1]):
        take = valid[:, j] & (closest[:, j] <= sims[:, j]) & (taken.sum(1) < most)
        taken[:, j] = take
        closest[take] = np.maximum(closest[take], between[take, :, j])
    rank = np.argsort(np.where(taken, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.where(valid[line, rank], found[line, rank], -1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out


class SmallWorld:
    """A hierarchical navigable small-world graph over unit vectors.

    Nodes are ordered by the layer they reach, so a layer holds a prefix of them.  Layers are
    built from the top, nodes joining in batches no larger than what is there already; nodes of
    a batch also see each other.
    """

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.layers = vectors, layers

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 0) -> tuple["SmallWorld", np.ndarray]:
        """The graph, and the order in which it holds the given vectors."""
        n = len(vectors)
        draw = np.random.default_rng(seed).random(n)
        level = np.floor(-np.log(np.maximum(draw, 1e-300)) / math.log(LINKS)).astype(np.int64)
        order = np.argsort(-level, kind="stable")
        vectors = np.ascontiguousarray(vectors[order], np.float32)
        graph = cls(vectors, [])
        for floor in range(int(level.max()), -1, -1):
            graph._add_layer(int((level >= floor).sum()), 2 * LINKS if floor == 0 else LINKS)
        return graph, order

    def _add_layer(self, n: int, most: int) -> None:
        links = np.full((n, most), -1, np.int64)
        above = len(self.layers[-1]) if self.layers else 0
        done = min(n, 64)
        sims = self.vectors[:done] @ self.vectors[:done].T
        np.fill_diagonal(sims, -np.inf)
        links[:done] = select_links(self.vectors, np.broadcast_to(
            np.arange(done), sims.shape).copy(), sims, most)
        while done < n:
            size = min(done, n - done, BATCH)
            batch = np.arange(done, done + size)
            queries = self.vectors[batch]
            entries = self._entries(queries) if done >= above else np.zeros(size, np.int64)
            found, sims = beam_search(self.vectors, links[:done], queries, entries, BUILD_BEAM)
            mates = queries @ queries.T
            np.fill_diagonal(mates, -np.inf)
            some = _top(mates, LINKS)
            line = np.arange(size)[:, None]
            found = np.concatenate([found, batch[some]], 1)
            sims = np.concatenate([sims, mates[line, some]], 1)
            chosen = select_links(self.vectors, found, sims, LINKS)
            links[batch, :LINKS] = chosen
            self._link_back(links, batch, chosen)
            done += size
        self.layers.append(links)

    def _link_back(self, links: np.ndarray, batch: np.ndarray, chosen: np.ndarray) -> None:
        """Every chosen neighbour links back, and keeps the best of what it then has."""
        source = np.repeat(batch, chosen.shape[1])
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        sims = np.einsum("nd,nd->n", self.vectors[source], self.vectors[target])
        order = np.lexsort((-sims, target))
        source, target = source[order], target[order]
        nodes, first = np.unique(target, return_index=True)
        rank = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
        most = links.shape[1]
        fit = rank < most
        added = np.full((len(nodes), most), -1, np.int64)
        added[np.searchsorted(nodes, target[fit]), rank[fit]] = source[fit]
        for a in range(0, len(nodes), BATCH):
            part = nodes[a:a + BATCH]
            found = np.concatenate([links[part], added[a:a + BATCH]], 1)
            found.sort(axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            sims = np.where(found >= 0, np.einsum(
                "ncd,nd->nc", self.vectors[found], self.vectors[part]), -np.inf)
            links[part] = select_links(self.vectors, found, sims, most)

    def _entries(self, queries: np.ndarray, layers: int | None = None) -> np.ndarray:
        """Where queries enter the next layer, after a walk through the layers above it."""
        at = np.zeros(len(queries), np.int64)
        for links in self.layers[:layers]:
            found, sims = beam_search(self.vectors, links, queries, at, 4)
            at = found[np.arange(len(queries)), sims.argmax(1)]
        return at

    def within(self, queries: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) of at least ``least`` similarity.  The beam of a query doubles
        until it holds something below, so the walk has gone around all that lies within."""
        rows, nodes = [], []
        for a in range(0, len(queries), BATCH):
            part = np.arange(a, min(a + BATCH, len(queries)))
            entries = self._entries(queries[part], len(self.layers) - 1)
            size = beam
            while len(part):
                size = min(size, len(self.vectors))
                found, sims = beam_search(self.vectors, self.layers[-1], queries[part], entries, size)
                full = (sims >= least).all(1) & (size < len(self.vectors))
                i, j = np.nonzero((sims >= least) & ~full[:, None])
                rows.append(part[i])
                nodes.append(found[i, j])
                part, entries, size = part[full], entries[full], 2 * size
        return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(nodes or [np.zeros(0, int)])


def most_lost(lost: np.ndarray, of: int) -> float:
    """An upper bound of the mean of ``of`` values in [0, 1] of which ``lost`` is a uniform sample
    (Chernoff's, but with probability DOUBT; their mean if the sample is all of them)."""
    if len(lost) == of:
        return float(lost.mean()) if of else 0.0
    mean, low, high = float(lost.mean()), float(lost.mean()), 1.0
    for _ in range(50):
        p = (low + high) / 2
        apart = sum(a * math.log(a / b) for a, b in ((mean, p), (1 - mean, 1 - p)) if a > 0 and b > 0)
        low, high = (p, high) if len(lost) * apart < -math.log(DOUBT) else (low, p)
    return high


def merged(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and for each row its place among them."""
    bits = np.ascontiguousarray(exact + 0.0)                 # no negative zeros
    _, first, at = np.unique(bits.view(f"V{bits.dtype.itemsize * bits.shape[1]}").ravel(),
                             return_index=True, return_inverse=True)
    return exact[first], at


class Shard:
    """Rows of one shard; their distinct vectors, with the graph over these.  ``at`` is the place
    of each row's vector (by default, every row has its own), ``row`` its number in the table,
    ``plain`` the vectors as they came, where those take less room."""

    def __init__(self, ids: np.ndarray, exact: np.ndarray, graph: SmallWorld, labels: np.ndarray,
                 at: np.ndarray | None = None, row: np.ndarray | None = None,
                 plain: np.ndarray | None = None):
        self.ids, self.exact, self.graph, self.labels = ids, exact, graph, labels
        self.at = np.arange(len(ids)) if at is None else at
        self.row, self.plain = ids if row is None else row, plain
        self.only = only_ids(ids, self.at, len(exact))

    def links(self, ids: np.ndarray, exact: np.ndarray, least: float, at: np.ndarray | None = None
              ) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, vector) that have rows with different ids and whose cosine, in double
        precision, is at least ``least``.  ``at`` is the query of each of ``ids``.

        Some queries are audited against all vectors.  The beam doubles until the recall is met;
        if the widest beam fails too, or the sample is too small to tell, all queries meet all
        vectors."""
        only = only_ids(ids, np.arange(len(ids)) if at is None else at, len(exact))
        queries = exact.astype(np.float32)
        beam = BEAM
        while True:
            row, node = self._linked(
                only, exact, least, *self.graph.within(queries, least - SLACK, beam))
            recall, sure = self._recall(only, exact, least, row)
            if sure >= RECALL:
                return row, node
            if recall >= RECALL or beam >= len(self.exact):
                rows, nodes = zip(*self._compared(only, exact, least))
                return np.concatenate(rows), np.concatenate(nodes)
            beam *= 2

    def counts(self, ids: np.ndarray, at: np.ndarray, row: np.ndarray, node: np.ndarray
               ) -> np.ndarray:
        """How many rows with other ids each query row links to, through the pairs found."""
        n = len(self.exact)
        weight = np.bincount(self.at, minlength=n)
        total = np.bincount(row, weight[node], int(at.max(initial=-1)) + 1).astype(np.int64)
        own, own_at, times = _repeats(self.ids, self.at)
        low, high = np.searchsorted(own, ids, "left"), np.searchsorted(own, ids, "right")
        which = np.repeat(np.arange(len(ids)), high - low)
        other = ragged(low, high - low)
        cells, cell = np.unique(at[which] * n + own_at[other], return_inverse=True)
        linked = np.zeros(len(cells) + 1, bool)
        for a in range(0, len(row) if len(cells) else 0, 1 << 20):
            pair = row[a:a + (1 << 20)] * n + node[a:a + (1 << 20)]
            place = np.searchsorted(cells, pair)
            linked[place[cells[np.minimum(place, len(cells) - 1)] == pair]] = True
        same = linked[cell]
        out = total[at]
        np.subtract.at(out, which[same], times[other[same]])
        return out

    def _linked(self, only: tuple, exact: np.ndarray, least: float, row: np.ndarray,
                node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that link."""
        ok = np.empty(len(row), bool)
        for a in range(0, len(row), 1 << 16):
            b = slice(a, a + (1 << 16))
            ok[b] = np.einsum("nd,nd->n", exact[row[b]], self.exact[node[b]]) >= least
        (low, high), (own_low, own_high) = only, self.only
        ok &= (low[row] != own_high[node]) | (high[row] != own_low[node])
        return row[ok], node[ok]

    def _compared(self, only: tuple, exact: np.ndarray, least: float
                  ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs that link, by comparing every query with every vector, CELLS at a time."""
        size = max(1, CELLS // len(self.exact))
        for a in range(0, len(exact), size):
            part = exact[a:a + size].astype(np.float32)
            row, node = np.nonzero(part @ self.graph.vectors.T >= least - SLACK)
            yield self._linked(only, exact, least, row + a, node)

    def _recall(self, only: tuple, exact: np.ndarray, least: float, row: np.ndarray
                ) -> tuple[float, float]:
        """The mean share of its links that a query with links found, and a bound that it keeps
        above.  Queries that found links and those without are sampled apart."""
        found = np.bincount(row, minlength=len(exact))
        draw = np.random.default_rng(0)
        lost, most, n = [], [], []
        for stratum in (np.flatnonzero(found), np.flatnonzero(found == 0)):
            some = np.sort(draw.choice(stratum, min(AUDITED, len(stratum)), replace=False))
            there = np.zeros(len(some), np.int64)
            for at, _ in self._compared(tuple(x[some] for x in only), exact[some], least):
                there += np.bincount(at, minlength=len(some))
            share = np.where(there > 0, 1 - found[some] / np.maximum(there, 1), 0.0)
            n.append(len(stratum))
            lost.append(float(share.mean()) if len(share) else 0.0)
            most.append(most_lost(share, len(stratum)))

        def recall(part, rest):
            """Of the queries without links, the share ``rest`` has lost all of its own."""
            there = n[0] + n[1] * rest
            return n[0] * (1 - part) / there if there else 1.0
        return recall(*lost), recall(*most)

    def blocks(self) -> Iterator[tuple[np.ndarray, ...]]:
        """The vectors, BLOCK at a time: (rows, their ids, labels and places, vectors)."""
        order = np.argsort(self.at, kind="stable")
        starts = np.arange(0, len(self.exact), BLOCK)
        ends = np.searchsorted(self.at[order], starts + BLOCK)
        for start, low, high in zip(starts.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
            own = np.sort(order[low:high])
            yield (self.row[own], self.ids[own], self.labels[own], self.at[own] - start,
                   self.exact[start:start + BLOCK])

    def pack(self) -> bytes:
        layers = self.graph.layers
        vectors = self.exact if self.plain is None else self.plain
        head = np.array([len(self.ids), *self.exact.shape, vectors.itemsize, len(layers),
                         *(x for g in layers for x in g.shape)], "<i8")
        parts = [np.array([len(head)], "<i8"), head, self.row, self.ids, self.labels, self.at,
                 vectors.ravel(), *(g.astype("<i4").ravel() for g in layers)]
        return b"".join(p.tobytes() for p in parts)

    @classmethod
    def unpack(cls, raw: bytes) -> "Shard":
        size = int(np.frombuffer(raw, "<i8", 1)[0])
        rows, n, width, item, _, *shapes = np.frombuffer(raw, "<i8", size, 8).tolist()
        at = 8 + 8 * size

        def take(kind: str, items: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, items, at)
            at += out.nbytes
            return out
        row, ids, labels, place = (take("<i8", rows) for _ in range(4))
        exact = take(f"<f{item}", n * width).reshape(n, width)
        if item < 8:
            exact = unit(exact)
        layers = [take("<i4", a * b).reshape(a, b).astype(np.int64)
                  for a, b in zip(shapes[::2], shapes[1::2])]
        return cls(ids, exact, SmallWorld(exact.astype(np.float32), layers), labels, place, row)


def only_ids(ids: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest id of the rows at each of ``n`` places."""
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, at, ids)
    np.maximum.at(high, at, ids)
    return low, high


def _repeats(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of an id and a place, sorted, and how often each occurs."""
    order = np.lexsort((at, ids))
    ids, at = ids[order], at[order]
    first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (at[1:] != at[:-1])))
    return ids[first], at[first], np.diff(np.append(first, len(ids)))


def local_components(n: int, a: np.ndarray, b: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The least name that links reach from each of ``n`` nodes."""
    label = names.copy()
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        if (least == label).all():
            return label
        label = least


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _build(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Graph of each shard of a partition sorted by shard, and its vectors' links inside it."""
    for (shard, width), ids, vectors, row in _shards(batches):
        exact, at = merged(unit(vectors))
        _, first = np.unique(at, return_index=True)
        graph, order = SmallWorld.build(exact)
        exact, at = exact[order], np.argsort(order)[at]
        plain = vectors[first[order]] if vectors.dtype == np.float32 else None
        built = Shard(ids, exact, graph, ids, at, row, plain)
        q, node = built.links(ids, exact, least, at)
        copies = np.setdiff1d(np.flatnonzero(built.only[0] != built.only[1]), q[q == node])
        q, node = np.append(q, copies), np.append(node, copies)
        built.labels = local_components(len(exact), q, node, built.only[0])[at]
        nodes = pa.StructArray.from_arrays(
            [pa.array(x) for x in (row, ids, built.labels, built.counts(ids, at, q, node))],
            ["row", "id", "label", "links"])
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int64()), "width": pa.array([width], pa.int32()),
            "graph": pa.array([built.pack()], pa.binary()),
            "nodes": pa.ListArray.from_arrays([0, len(nodes)], nodes)})


def _shards(batches: Iterator[pa.RecordBatch]):
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    last = None

    def whole():
        ids, vectors, row = (np.concatenate(p) for p in zip(*held))
        return last, ids, vectors, row

    for batch in batches:
        shard, width = batch.column("shard").to_numpy(), batch.column("width").to_numpy()
        if not len(shard):
            continue
        cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (width[1:] != width[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)]):
            key = int(shard[a]), int(width[a])
            if held and key != last:
                yield whole()
                held = []
            last = key
            part = batch.slice(a, b - a)
            vectors = part.column("vector").flatten().to_numpy(zero_copy_only=False)
            held.append((part.column("id").to_numpy(), vectors.reshape(-1, key[1]),
                         part.column("row").to_numpy()))
    if held:
        yield whole()


def _ask(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links of all vectors of a shard to those of another one: the number of each row, and which
    parts of the two shards they join."""
    for batch in batches:
        for graph, asking in zip(batch.column("graph"), batch.column("asking")):
            shard = Shard.unpack(graph.as_buffer().to_pybytes())
            for row, ids, labels, at, exact in Shard.unpack(asking.as_buffer().to_pybytes()).blocks():
                q, node = shard.links(ids, exact, least, at)
                count = shard.counts(ids, at, q, node)
                some = np.flatnonzero(count)
                u, _ = only_ids(labels, at, len(exact))
                v, _ = only_ids(shard.labels, shard.at, len(shard.exact))
                pairs = np.unique(np.stack([u[q], v[node]], 1), axis=0)
                gone, none = pa.nulls(len(pairs), pa.int64()), pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[some]), none, none, pa.array(count[some])],
                    ["row", "u", "v", "links"])
                yield pa.RecordBatch.from_arrays(
                    [gone, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), gone],
                    ["row", "u", "v", "links"])


def deal(rows: dict[int, int]) -> tuple[dict[int, int], dict[int, int], int]:
    """From the rows of each width the number of its shards, the cell of its first shard (the
    others follow it) and the number of cells, which hold SHARD_BYTES each on average."""
    size = {w: n * max(8 * w, LEAST_BYTES) for w, n in rows.items()}
    shards, first, last = {}, {}, 0
    for w in sorted(size, key=lambda w: (-size[w], w)):
        shards[w] = max(SHARDS, math.ceil(size[w] / SHARD_BYTES))
        first[w], last = last, last + shards[w]
    return shards, first, max(*shards.values(), math.ceil(sum(size.values()) / SHARD_BYTES))


def embedding_dedup(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """One row per input row: the id column, ``n_links``, ``component_id`` and ``kept``.

    Vectors of equal size link when their cosine, in double precision, is at least ``least``;
    ``n_links`` counts the other vectors found to link directly, ``component_id`` is the
    smallest id that links reach, ``kept`` marks the vector with that id.

    Vectors are dealt to shards by a hash.  Each shard's graph, over its distinct vectors, is built
    by one task and written once, a file for each cell of shards; then one task for each pair of
    files reads both, and all vectors of one shard are asked against the other, in blocks.  No graph
    goes through a shuffle.  Only counts and, for each vector, the parts of a shard it links to
    leave a task, never the pairs of a dense group.

    Ids are integers.  Vectors that are null, empty or zero or hold null or non-finite components
    link with nothing.  A row without an id has neither links nor component.  Rows that repeat an
    id are one vector to the components and don't link with each other.  An empty table gives no
    rows; other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "embedding-dedup")
    v = F.col("vector")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    source = vectors.select(F.col(id_col).cast("bigint").alias("id"),
                            F.col(vector_col).alias("vector"))
    valid = source.where(F.col("id").isNotNull() & v.isNotNull()).where(
        finite & F.exists(v, lambda x: x != 0)).select(
        "id", "vector", F.size(v).alias("width"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.stage(valid, "vectors")
    sizes = rows.groupBy("width").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return source.select(
            F.col("id").cast(schema_of(vectors, id_col)).alias(id_col),
            F.lit(0).cast("bigint").alias("n_links"),
            F.col("id").cast(schema_of(vectors, id_col)).alias("component_id"),
            F.col("id").isNotNull().alias("kept"))
    shards, first, cells = deal({r["width"]: r["n"] for r in sizes})

    def of_width(values: dict[int, int]):
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("width")]

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), of_width(shards))).repartitionById(
        cells, F.pmod(F.col("shard") + of_width(first), F.lit(cells)).cast("int")
    ).sortWithinPartitions("width", "shard", "row")
    built = scratch.stage(dealt.mapInArrow(
        lambda b: _build(b, least), "shard bigint, width int, graph binary, "
        "nodes array<struct<row:bigint,id:bigint,label:bigint,links:bigint>>"), "graphs")
    nodes = scratch.stage(built.select(F.explode("nodes").alias("node")).select("node.*"), "nodes")
    scratch.drop("vectors")
    asked = built.select("width", "shard", "graph").hint("shuffle_replicate_nl")
    asking = built.select(F.col("width").alias("size"), F.col("shard").alias("of"),
                          F.col("graph").alias("asking"))
    work = asked.join(asking, (F.col("width") == F.col("size")) & (F.col("of") != F.col("shard")))
    with settings(vectors.sparkSession, APART):
        answers = scratch.stage(work.select("graph", "asking").mapInArrow(
            lambda b: _ask(b, least), "row bigint, u bigint, v bigint, links bigint"), "answers")
    scratch.drop("graphs")

    joined = components(answers.select("u", "v").union(nodes.select("id", "label")))
    more = answers.where("row is not null").groupBy("row").agg(F.sum("links").alias("more"))
    counted = nodes.join(more, "row", "left").groupBy("id").agg(
        F.max(F.col("links") + F.coalesce("more", F.lit(0))).alias("n"))
    found = counted.join(joined, counted["id"] == joined["node"], "left").select(
        "id", "n", "component")
    result = source.select("id").join(found, "id", "left").select(
        F.col("id").cast(schema_of(vectors, id_col)).alias(id_col),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "id").cast(schema_of(vectors, id_col)).alias("component_id"))
    return result.withColumn("kept", F.coalesce(
        F.col("component_id") == F.col(id_col), F.lit(False)))
