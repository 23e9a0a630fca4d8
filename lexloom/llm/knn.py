"""The k most similar vectors of every vector, by cosine, through balanced posting lists.

1. Centroids are fitted by recursive balanced k-means on a sample that grows with the lists: coarse cells on the driver,
   the lists of each cell on the executors. In the order of the splitting trees neighbouring lists are similar, and runs
   of lists form the partitions.
2. A graph over the centroids (nearest neighbours, entered through a layer of means) is searched in memory for each vector. The
   vector is stored in its nearest list and replicated to others whose centroid is almost as near (boundary vectors);
   as a query it visits the lists within a distance ratio of the nearest. The ratio of each region of lists is fitted:
   so large that a share WANTED of the true neighbours of sampled queries, found by comparing them with all, is met.
3. One shuffle sends a vector once to every partition that holds one of its lists, with float32 numbers. Each
   list is compared with its queries by a matrix product around its mean; what rounding can't tell from the best is
   measured in double precision, and the best of a query in a partition go to a last aggregation by query. A list that
   is too long (there are at most MAX_LISTS) is split again, in its task, by the same rules. Where vectors go to many
   partitions, the partitions take turns: the disk holds one turn's shuffle and the best of each query in earlier turns.

Every valid vector is indexed and is a query. Recall is measured in the tests and stated in the README.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.storage import delete, fresh_path, release, staged

#: Vectors per list, and the bound on the number of lists: centroids take at most MAX_LISTS * dimension * 4 bytes.
LIST_SIZE = 400
MAX_LISTS = 262_144
#: A list that holds more than so many times LIST_SIZE is split in its task.
LONG = 4
#: Sampled vectors per list, and lists per cell: the driver fits one centroid for each cell.
SAMPLE_PER_LIST = 32
LISTS_PER_CELL = 256
#: A vector is stored in lists up to this distance ratio of the nearest, at most MAX_COPIES; it visits all lists up to
#: the ratio of its region. PROBES are looked for at first, and all centroids are measured where the last is near too.
COPY_RATIO, MAX_COPIES = 1.06, 2
PROBES = (8, 32)
#: The ratios are fitted so that this share of neighbours is met, on so many queries, with so many neighbours to a region.
WANTED, FITTED_QUERIES, PAIRS_PER_REGION = 0.998, 2_048, 2_000
#: A query goes on, whatever the ratio, until its lists hold about so many vectors for each neighbour that is wanted.
LEAST_MET = 5
#: Graph neighbours of a centroid, and the least and greatest length of the runs whose means are the layer above.
DEGREE = 24
RUNS = (16, 128)
#: Nodes of the runs that a query enters, about, and its nearest nodes that must be expanded before its search ends.
ENTERED, CLIMB = 4_096, 2
#: Lists per partition, at least and as a rule; the vectors that a partition of several lists holds at most.
MIN_LISTS_PER_PART, LISTS_PER_PART, VECTORS_PER_PART = 8, 64, 50_000
#: Partitions are made smaller where more vectors visit one of them on average; one that more visit still is split by visitor.
VISITORS_PER_TASK = 100_000
#: If more copies of a vector than the first number would be shuffled, the vectors are staged and shuffled in turns, each
#: of about the second number of copies.
COPIES_AT_ONCE, COPIES_PER_TURN, MAX_TURNS = 2.5, 1.0, 60
#: Queries whose neighbours are held at once while lists are compared.
QUERIES_AT_ONCE = 16_384


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * (c * c).sum(1), 1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Cluster of each row; a penalty on full clusters keeps them balanced."""
    c = x[rng.choice(len(x), k, replace=False)].copy()
    penalty = np.zeros(k, np.float32)
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        score = x @ c.T - 0.5 * (c * c).sum(1)
        spread = float(np.std(score)) or 1.0
        own = np.argmax(score - penalty, 1)
        counts = np.bincount(own, minlength=k)
        penalty += (0.1 * spread) * (counts / (len(x) / k) - 1).clip(-1, 1).astype(np.float32)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        alive = counts > 0
        c[alive] = sums[alive] / counts[alive, None]
        for dead in np.flatnonzero(~alive):
            c[dead] = x[rng.integers(len(x))]
    return own


def fit_centroids(sample: np.ndarray, lists: int, seed: int = 7, branch: int = 8) -> np.ndarray:
    """About ``lists`` centroids (rows), ordered by the splitting tree."""
    rng = np.random.default_rng(seed)
    target = max(1.0, len(sample) / lists)
    out: list[np.ndarray] = []

    def split(rows: np.ndarray) -> None:
        parts = int(min(branch, round(len(rows) / target), len(rows)))
        if parts < 2:
            out.append(sample[rows].mean(0))
            return
        own = _kmeans(sample[rows], parts, rng)
        pieces = [rows[own == j] for j in range(parts)]
        pieces = [p for p in pieces if len(p)]
        if len(pieces) < 2:
            out.append(sample[rows].mean(0))
            return
        means = np.array([sample[p].mean(0) for p in pieces])
        axis = np.linalg.svd(means - means.mean(0), full_matrices=False)[2][0]
        for j in np.argsort(means @ axis, kind="stable"):
            split(pieces[j])

    if len(sample):
        split(np.arange(len(sample)))
    for _ in range(3):  # the lists go to the nearest centroid, which is less even than the splits
        c = np.array(out, np.float32)
        own = np.concatenate([_nearest(sample[at : at + 8192], c) for at in range(0, len(sample), 8192)]) if len(sample) else np.empty(0, int)
        counts = np.bincount(own, minlength=len(out))
        if not len(counts) or counts.max() <= 2 * target:
            break
        order = np.argsort(own, kind="stable")
        starts = np.r_[0, np.cumsum(counts)]
        old, out[:] = list(out), []
        for j, mean in enumerate(old):
            if counts[j] > 1.5 * target:
                split(order[starts[j] : starts[j + 1]])
            elif counts[j]:
                out.append(mean)
    return np.array(out, np.float32).reshape(len(out), sample.shape[1])


@dataclass
class CentroidGraph:
    """Centroids in the order of their tree, a graph of near neighbours, and a coarser layer above it: the means of runs of centroids.

    The neighbours of node i are ``heads[starts[i] : starts[i + 1]]``; run j has the nodes from ``j * run`` on.
    """

    centroids: np.ndarray
    starts: np.ndarray
    heads: np.ndarray
    means: np.ndarray
    run: int

    @classmethod
    def build(cls, centroids: np.ndarray, degree: int = DEGREE, block: int = 512, blocks: int = 32) -> CentroidGraph:
        """Neighbours are looked for in the ``blocks`` nearest stretches of ``block`` centroids, by their means."""
        n = len(centroids)
        degree = min(degree, n)
        near = np.empty((n, degree), np.int32)
        half = 0.5 * (centroids * centroids).sum(1)
        parts = [np.arange(at, min(n, at + block)) for at in range(0, n, block)]
        middle = np.array([centroids[r].mean(0) for r in parts]) if n else centroids
        for part in parts:
            if len(parts) > blocks:
                close = np.argpartition(-(middle @ centroids[part].mean(0) - 0.5 * (middle * middle).sum(1)), blocks)[:blocks]
                cand = np.concatenate([parts[j] for j in np.sort(close)])
            else:
                cand = np.arange(n)
            score = centroids[part] @ centroids[cand].T - half[cand]
            best = np.argpartition(-score, degree - 1, 1)[:, :degree] if degree < len(cand) else np.tile(np.arange(len(cand)), (len(part), 1))
            near[part] = cand[best]
        tails, heads = np.repeat(np.arange(n, dtype=np.int64), degree), near.ravel().astype(np.int64)
        edges = np.unique(np.concatenate([tails * n + heads, heads * n + tails]))
        run = int(np.clip(round(np.sqrt(n) / 2), *RUNS))
        means = np.array([centroids[at : at + run].mean(0) for at in range(0, n, run)], np.float32).reshape(-1, centroids.shape[1])
        return cls(centroids, np.searchsorted(edges, np.arange(n + 1) * n), (edges % max(n, 1)).astype(np.int32), means, run)

    def search(self, x: np.ndarray, k: int, entered: int = ENTERED) -> tuple[np.ndarray, np.ndarray]:
        """Per row the k nearest centroids found and their distances, nearest first (-1 and inf where there are fewer).

        Many queries at once: the upper layer gives each the nearest runs, with about ``entered`` nodes, and the queries
        of a run are compared with its nodes by one product. From there each climbs the graph: it expands its nearest
        node that isn't expanded yet, as long as that is one of its CLIMB nearest.
        """
        found = [self._search(x[at : at + 2_000], k, -(-entered // self.run)) for at in range(0, max(1, len(x)), 2_000)]
        return tuple(np.concatenate(c) for c in zip(*found))

    def _search(self, x: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, c, half = len(self.centroids), self.centroids, 0.5 * (self.centroids * self.centroids).sum(1)
        norm = (x * x).sum(1)
        runs, beam = len(self.means), min(beam, len(self.means))
        doors = _nearest_first(-(x @ self.means.T - 0.5 * (self.means * self.means).sum(1)), beam)[0]
        far = np.full((len(x), beam, self.run), np.inf, np.float32)
        row, slot = np.divmod(np.arange(doors.size), beam)
        for j, at in _groups(np.arange(doors.size), doors.ravel()):
            nodes = slice(j * self.run, min(n, (j + 1) * self.run))
            far[row[at], slot[at], : nodes.stop - nodes.start] = norm[row[at]][:, None] - 2 * (x[row[at]] @ c[nodes].T - half[nodes])
        width = min(max(k, CLIMB), n)
        best, dist = _nearest_first(far.reshape(len(x), -1), min(width, beam * self.run))
        ids = (np.take_along_axis(doors, best // self.run, 1) * self.run + best % self.run).astype(np.int32)
        dist = np.sqrt(np.maximum(dist, 0))
        ids[np.isinf(dist)] = -1
        if beam < runs:
            done = ids < 0
            live = np.arange(len(x))
            while True:
                live = live[~done[live, :CLIMB].all(1)]
                if not len(live):
                    break
                rank = (~done[live, :CLIMB]).argmax(1)
                nodes = ids[live, rank]
                done[live, rank] = True
                order = np.argsort(nodes, kind="stable")
                for at in range(0, len(live), 1_024):
                    self._expand(x, norm, half, live[order[at : at + 1_024]], nodes[order[at : at + 1_024]], ids, dist, done)
        return ids[:, :k], dist[:, :k]

    def _expand(self, x: np.ndarray, norm: np.ndarray, half: np.ndarray, rows: np.ndarray, nodes: np.ndarray, ids: np.ndarray, dist: np.ndarray, done: np.ndarray) -> None:
        """Puts the neighbours of each row's node among the row's nearest."""
        size = self.starts[nodes + 1] - self.starts[nodes]
        slot = np.arange(int(size.max()))
        real = slot < size[:, None]
        cand = np.where(real, self.heads[np.where(real, self.starts[nodes][:, None] + slot, 0)], -1)
        near = np.matmul(self.centroids[cand], x[rows][:, :, None])[:, :, 0]
        far = np.where(real, np.sqrt(np.maximum(norm[rows][:, None] - 2 * (near - half[cand]), 0)), np.inf).astype(np.float32)
        last = dist[rows, -1]
        some = np.flatnonzero((far < last[:, None]).sum(1) > 0)  # most have nothing nearer
        if not len(some):
            return
        cand, far, own = cand[some], far[some], rows[some]
        m = min(ids.shape[1], cand.shape[1])
        best = np.argpartition(far, m - 1, 1)[:, :m] if m < cand.shape[1] else np.tile(np.arange(m), (len(own), 1))
        cand, far = np.take_along_axis(cand, best, 1), np.take_along_axis(far, best, 1)
        far[(cand[:, :, None] == ids[own][:, None, :]).any(2)] = np.inf
        all_dist = np.concatenate([dist[own], far], 1)
        order = np.argsort(all_dist, 1, kind="stable")[:, : ids.shape[1]]
        dist[own] = np.take_along_axis(all_dist, order, 1)
        none = np.isinf(dist[own])
        ids[own] = np.where(none, -1, np.take_along_axis(np.concatenate([ids[own], cand], 1), order, 1))
        done[own] = none | np.take_along_axis(np.concatenate([done[own], np.zeros(cand.shape, bool)], 1), order, 1)


def _groups(rows: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    for part in np.split(order, np.flatnonzero(np.diff(sorted_keys)) + 1) if len(order) else []:
        yield int(keys[part[0]]), rows[part]


@dataclass
class Index:
    """What the executors need: the graph, the partition of each list, into how many tasks each partition is split, about how many vectors each list holds, the distance ratio of those nearest to each list, how many vectors a query should meet at least, and the turns of tasks (the first task of each, and the number of tasks)."""

    graph: CentroidGraph
    part_of: np.ndarray
    splits: np.ndarray
    held: np.ndarray
    ratio: np.ndarray
    need: int
    turns: np.ndarray | None = None


def _measured(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of rows to all centroids."""
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * (x @ c.T - 0.5 * (c**2).sum(1)), 0))


def _nearest_first(far: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` nearest places of each row, nearest first, and their distances."""
    ids = np.argpartition(far, most - 1, 1)[:, :most] if most < far.shape[1] else np.tile(np.arange(far.shape[1]), (len(far), 1))
    ids = np.take_along_axis(ids, np.argsort(np.take_along_axis(far, ids, 1), 1, kind="stable"), 1)
    return ids, np.take_along_axis(far, ids, 1)


def route(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For unit vectors: (row, list, stored, visited) of each list that a vector has to do with."""
    graph, out, left = index.graph, [], np.arange(len(x))
    n = len(graph.centroids)
    for probes in (*PROBES, n):
        if not len(left):
            break
        exact = probes >= n
        step = max(1, 4_000_000 // n) if exact else len(left)
        wide = []
        for at in range(0, len(left), step):
            rows = left[at : at + step]
            if exact:  # as many as the ratio lets in
                far = _measured(x[rows], graph.centroids)
                ratio = index.ratio[far.argmin(1)]
                most = int((far <= ratio[:, None] * np.maximum(far.min(1, keepdims=True), 1e-6)).sum(1).max())
                ids, dist = _nearest_first(far, min(n, max(most, MAX_COPIES, PROBES[-1])))
            else:
                ids, dist = graph.search(x[rows], probes)
            first = np.maximum(dist[:, :1], 1e-6)
            stored = (dist <= COPY_RATIO * first) & (np.arange(ids.shape[1]) < MAX_COPIES)
            held = index.held[ids]
            visited = ((dist <= index.ratio[ids[:, :1]] * first) | (np.cumsum(held, 1) - held < index.need)) & (ids >= 0)
            stored[:, 0] = visited[:, 0] = True
            more = visited[:, -1] & (not exact)
            wide.append(rows[more])
            row, place = np.nonzero((visited | stored) & ~more[:, None])
            out.append((rows[row], ids[row, place], stored[row, place], visited[row, place]))
        left = np.concatenate(wide)
    return tuple(np.concatenate(c) for c in zip(*out))


def needed_ratio(c: np.ndarray, x: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` its nearest list, and the distance ratio up to which it must go on to meet the same row of ``others``."""
    own, ratio = [], []
    for at in range(0, len(x), max(1, 4_000_000 // max(1, len(c)))):
        part = slice(at, at + max(1, 4_000_000 // len(c)))
        mine, theirs = _measured(x[part], c), _measured(others[part], c)
        holds = np.full(len(mine), np.inf)
        ids, dist = _nearest_first(theirs, min(MAX_COPIES, len(c)))
        for j in range(ids.shape[1]):
            held = (dist[:, j] <= COPY_RATIO * np.maximum(dist[:, 0], 1e-6)) | (j == 0)
            holds = np.where(held, np.minimum(holds, np.take_along_axis(mine, ids[:, j : j + 1], 1)[:, 0]), holds)
        own.append(mine.argmin(1))
        ratio.append(holds / np.maximum(mine.min(1), 1e-6))
    return np.concatenate(own), np.concatenate(ratio)


def fitted_ratios(lists: int, own: np.ndarray, needed: np.ndarray, wanted: float = WANTED, per_region: int = PAIRS_PER_REGION) -> np.ndarray:
    """The ratio of each list: of its region (a run of lists) the quantile ``wanted`` of the ratios that the pairs of its sampled queries need."""
    out = np.ones(lists)
    order = np.argsort(own, kind="stable")
    regions = max(1, len(own) // per_region)
    edges = own[order][np.arange(regions) * len(own) // regions] if len(own) else np.zeros(1, int)
    edges[0] = 0
    edges = np.unique(edges)
    for a, b in zip(edges, [*edges[1:], lists]):
        mine = needed[(own >= a) & (own < b)]
        out[a:b] = np.quantile(mine, wanted) if len(mine) else np.quantile(needed, wanted) if len(needed) else 1.15
    return out * (1 + 1e-6)


#: Bound of the error of a float32 product of two vectors, relative to their lengths.
ROUNDING = 4e-6


def _cosines(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, as right for near vectors as their float32 numbers allow; 1 for equal ones."""
    out = np.empty(len(a))
    for at in range(0, len(a), 65_536):
        u, v = x[a[at : at + 65_536]].astype(np.float64), x[b[at : at + 65_536]].astype(np.float64)
        n, m = np.sqrt((u * u).sum(1)), np.sqrt((v * v).sum(1))
        u -= v
        out[at : at + 65_536] = 1 - ((u * u).sum(1) - (n - m) ** 2) / (2 * n * m)
    return out


def best_in_lists(x: np.ndarray, entries: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, other, similarity): for each list (stored rows, visiting rows in order) the k + 1 best of each visitor, then the k best per query."""
    found = []
    for low in range(0, len(x), QUERIES_AT_ONCE):
        some = [(stored, visiting[np.searchsorted(visiting, low) : np.searchsorted(visiting, low + QUERIES_AT_ONCE)]) for stored, visiting in entries]
        found.append(_best_of_some(x, some, k))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else _best_of_some(x, [], k)


def _best_of_some(x: np.ndarray, entries: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    qs, os_, ss = [], [], []
    for stored, visiting in entries:
        if not len(stored) or not len(visiting):
            continue
        m = min(k + 1, len(stored))
        block = max(1, 4_000_000 // len(stored))
        middle = x[stored].mean(0)
        base = x[stored] - middle
        half = 0.5 * (base * base).sum(1)
        longest = np.sqrt(2 * half.max())
        base = base.T.copy()
        for at in range(0, len(visiting), block):
            q = visiting[at : at + block]
            y = x[q] - middle
            near = y @ base - half
            least = np.partition(near, len(stored) - m, 1)[:, len(stored) - m]
            least -= ROUNDING * longest * (np.sqrt((y * y).sum(1)) + longest)
            row, col = np.nonzero(near >= least[:, None])
            qs.append(q[row])
            os_.append(stored[col])
            ss.append(_cosines(x, q[row], stored[col]))
    if not qs:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    q, o, s = np.concatenate(qs), np.concatenate(os_), np.concatenate(ss)
    other = q != o
    q, o, s = q[other], o[other], s[other]
    order = np.lexsort((o, -s, q))
    q, o, s = q[order], o[order], s[order]
    fresh = np.ones(len(q), bool)  # a replica has the same similarity
    fresh[1:] = (q[1:] != q[:-1]) | (o[1:] != o[:-1])
    q, o, s = q[fresh], o[fresh], s[fresh]
    if len(q):
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        keep = rank < k
        q, o, s = q[keep], o[keep], s[keep]
    return q, o, s


def split_list(x: np.ndarray, stored: np.ndarray, visiting: np.ndarray, ratio: float, list_size: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A long list as several: its stored rows are divided among centroids of their own, which its visitors search by the same ratio."""
    lists = max(1, round(len(stored) / list_size))
    graph = CentroidGraph.build(fit_centroids(x[stored[:: max(1, list_size // SAMPLE_PER_LIST)]], lists))
    n = len(graph.centroids)
    held = np.full(n, len(stored) / n)
    index = Index(graph, np.zeros(n, np.int32), np.ones(1, np.int64), held, np.full(n, ratio), LEAST_MET * k)
    rows = np.union1d(stored, visiting)
    is_stored, is_visiting = np.isin(rows, stored), np.isin(rows, visiting)
    row, lists_, stores, visits = (np.concatenate(c) for c in zip(*(_shifted(route(index, x[rows[at : at + 10_000]]), at) for at in range(0, len(rows), 10_000))))
    stores, visits = stores & is_stored[row], visits & is_visiting[row]
    return [(np.sort(rows[row[at[stores[at]]]]), np.sort(rows[row[at[visits[at]]]])) for _, at in _groups(np.arange(len(row)), lists_)]


def _shifted(routed: tuple, at: int) -> tuple:
    return (routed[0] + at, *routed[1:])


#: A direction that this many vectors share is hot: only its k + 1 smallest keys are indexed, which changes no result,
#: as equally similar vectors rank by key. At most 1 / HOT_SHARE of all directions can be hot.
HOT_ROWS, HOT_SHARE = 1_000, 1_000
ROWS_PER_TASK = 400_000


def _hash() -> Column:
    return F.shiftrightunsigned(F.xxhash64("id"), 1)


def _unit(batches: Iterator[pa.RecordBatch], size: int, whole: bool) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        lists = batch.column(1)
        right = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == size)
        lists = lists.take(pa.array(right))
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        norm = np.sqrt((x * x).sum(1))
        good = np.isfinite(norm) & (norm > 0)
        unit = (x[good] / norm[good, None]).astype(np.float32) + np.float32(0)  # no -0.0
        raw = [row.tobytes() for row in unit]
        keys = batch.column(0).take(pa.array(right[good]))
        directions = pa.array(np.array([xxhash.xxh3_64_intdigest(r) for r in raw], np.uint64).view(np.int64))
        columns = [keys, directions, pa.array(raw, pa.binary())] if whole else [keys, directions]
        yield pa.RecordBatch.from_arrays(columns, ["id", "direction", "vec"][: len(columns)])


class Units:
    """Float32 unit vectors (id, direction, vec) of the valid rows of a table, ``direction`` a hash of the vector; read anew for each pass.

    Rows are left out whose key or vector is null, whose vector has another size, a null, NaN or infinite number, or is
    all zeros. A key that comes twice keeps the vector with the greatest hash. ``keys`` is (id, direction), staged.
    """

    def __init__(self, df: DataFrame, key: str, vector: str, size: int) -> None:
        rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
        self._rows, self._size, self._single, self._first = rows.filter(~F.exists("v", lambda x: x.isNull())), size, None, None
        keys = self._rows.mapInArrow(lambda it: _unit(it, size, False), "id bigint, direction bigint")
        self.keys = staged(keys, "vector-keys")
        if self.keys.groupBy("id").count().filter("count > 1").limit(1).count():
            self._single = staged(self.vectors().groupBy("id").agg(F.max(F.struct("direction", "vec")).alias("x")).select("id", "x.*"), "unit-vectors")
            self.keys = staged(self._single.select("id", "direction"), "vector-keys")

    def only_first(self, first: DataFrame) -> None:
        """From now on, of the directions in ``first`` (direction, first) only the keys listed there."""
        self._first = first

    def vectors(self, share: float = 1.0, of: DataFrame | None = None) -> DataFrame:
        """The vectors, or those of the ``share`` of all keys with the least hashes, or those of the few keys ``of`` (id)."""
        where = _hash() < int(2**63 * share) if share < 1 else F.lit(True)
        some = lambda rows: rows.filter(where) if of is None else rows.filter(where).join(F.broadcast(of), "id", "left_semi")
        if self._single is None:
            size = self._size
            out = some(self._rows).mapInArrow(lambda it: _unit(it, size, True), "id bigint, direction bigint, vec binary")
        else:
            out = some(self._single)
        if self._first is not None:
            out = out.join(F.broadcast(self._first), "direction", "left").filter(F.col("first").isNull() | F.array_contains("first", F.col("id"))).select("id", "direction", "vec")
        return out


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.float32).reshape(len(parts), size)


def _cells(batches: Iterator[pa.RecordBatch], shared, size: int) -> Iterator[pa.RecordBatch]:
    c = shared.value
    for batch in batches:
        cell = _nearest(_matrix(batch.column("vec"), size), c) if len(c) > 1 else np.zeros(batch.num_rows, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("id"), batch.column("vec")], ["cell", "id", "vec"])


def _fitted(table: pa.Table, size: int, per_list: float) -> pa.Table:
    table = table.sort_by("id")
    x = _matrix(table["vec"], size)
    c = fit_centroids(x, max(1, round(len(x) / per_list)))
    n = np.bincount(np.concatenate([_nearest(x[at : at + 8192], c) for at in range(0, len(x), 8192)]), minlength=len(c))
    cell = pa.array(np.full(len(c), table["cell"][0].as_py(), np.int32))
    return pa.Table.from_arrays([cell, pa.array(np.arange(len(c), dtype=np.int32)), pa.array(n), pa.array([row.tobytes() for row in c], pa.binary())], ["cell", "at", "n", "vec"])


def _nearest_of_all(batches: Iterator[pa.RecordBatch], shared, size: int, k: int) -> Iterator[pa.RecordBatch]:
    """Of each query the ``k`` nearest vectors of all batches but those of its own key."""
    keys, q = shared.value
    best, who = np.full((len(q), k), -np.inf, np.float32), np.zeros((len(q), k), np.int64)
    for whole in batches:
        for start in range(0, whole.num_rows, 2_000):
            batch = whole.slice(start, 2_000)
            ids = batch.column("id").to_numpy()
            near = q @ _matrix(batch.column("vec"), size).T
            near[keys[:, None] == ids] = -np.inf
            rows = np.flatnonzero(near.max(1) > best.min(1))
            top = np.argpartition(-near[rows], k - 1, 1)[:, :k] if k < len(ids) else np.tile(np.arange(len(ids)), (len(rows), 1))
            found, own = np.concatenate([best[rows], np.take_along_axis(near[rows], top, 1)], 1), np.concatenate([who[rows], ids[top]], 1)
            top = np.argpartition(-found, k - 1, 1)[:, :k]
            best[rows], who[rows] = np.take_along_axis(found, top, 1), np.take_along_axis(own, top, 1)
    row, at = np.nonzero(np.isfinite(best))
    yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(best[row, at]), pa.array(who[row, at])], ["q", "near", "id"])


def build_index(units: Units, total: int, size: int, list_size: int = LIST_SIZE, k: int = 10) -> Index | None:
    """The index over ``total`` unit vectors, fitted on a sample by key hash that grows with the lists; None if there are no vectors.

    The driver sees one centroid for each list, a sample that grows with the cells, and FITTED_QUERIES vectors.
    """
    if not total:
        return None
    lists = min(MAX_LISTS, max(1, round(total / list_size)))
    sample = staged(units.vectors(min(1.0, SAMPLE_PER_LIST * lists / total)).select("id", "vec"), "vector-sample")
    sampled = sample.count()
    if not sampled:
        sample = staged(units.vectors().select("id", "vec").orderBy("id").limit(1), "vector-sample")
        sampled = 1
    context = sample.sparkSession.sparkContext
    least = lambda most: sample.select("id", "vec", _hash().alias("hash")).orderBy("hash", "id").limit(most).toArrow()
    cells = -(-lists // LISTS_PER_CELL)
    coarse = fit_centroids(_matrix(least(SAMPLE_PER_LIST * cells)["vec"], size), cells) if cells > 1 else np.zeros((1, size), np.float32)
    shared_cells, per_list = context.broadcast(coarse), sampled / lists
    in_cells = sample.mapInArrow(lambda it: _cells(it, shared_cells, size), "cell int, id bigint, vec binary")
    fitted = in_cells.groupBy("cell").applyInArrow(lambda t: _fitted(t, size, per_list), "cell int, at int, n bigint, vec binary").toArrow().sort_by([("cell", "ascending"), ("at", "ascending")])
    graph = CentroidGraph.build(_matrix(fitted["vec"], size))
    n = len(graph.centroids)
    parts = max(1, min(n // MIN_LISTS_PER_PART, 12 + n // LISTS_PER_PART))
    parts = min(n, max(parts, -(-total // VECTORS_PER_PART)))
    queries = least(FITTED_QUERIES)
    keys, x = queries["id"].to_numpy(), _matrix(queries["vec"], size)
    shared_queries = context.broadcast((keys, x))
    near = units.vectors().select("id", "vec").mapInArrow(lambda it: _nearest_of_all(it, shared_queries, size, k), "q bigint, near float, id bigint")
    near = near.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "id"))).filter(F.col("rn") <= k).select("q", "id")
    near = staged(near, "vector-nearest")
    met = near.join(units.vectors(of=near.select("id").distinct()), "id").select("q", "vec").toArrow()
    own, needed = needed_ratio(graph.centroids, x[met["q"].to_numpy()], _matrix(met["vec"], size)) if met.num_rows else (np.empty(0, np.int64), np.empty(0))
    index = Index(graph, np.zeros(n, np.int32), np.ones(1, np.int64), fitted["n"].to_numpy() * (total / sampled), fitted_ratios(n, own, needed), LEAST_MET * k)
    place(index, parts, total, *route(index, x))
    return index


def place(index: Index, parts: int, total: int, row: np.ndarray, lists: np.ndarray, stored: np.ndarray, visited: np.ndarray) -> None:
    """Divides the lists among ``parts`` partitions or more, and these among tasks and turns, by the routes of a sample of all ``total`` vectors."""
    n, scale = len(index.part_of), total / len(np.unique(row))
    sent = lambda part, some, parts: np.bincount(np.unique(row[some] * parts + part[lists[some]]) % parts, minlength=parts) * scale
    while True:
        part = (np.arange(n) * parts // n).astype(np.int32)
        visitors = sent(part, visited, parts)
        more = min(max(1, n // MIN_LISTS_PER_PART), int(-(-visitors.sum() // VISITORS_PER_TASK)))
        if more <= parts:
            break
        parts = more
    splits = np.maximum(1, np.ceil(visitors / VISITORS_PER_TASK)).astype(np.int64)
    load = np.repeat(sent(part, visited | stored, parts) / splits, splits)
    load += np.repeat(sent(part, stored, parts) * (splits - 1) / splits, splits)  # what is stored goes to all tasks of a partition
    index.part_of, index.splits, index.turns = part, splits, turns_of(load / total)


def turns_of(load: np.ndarray) -> np.ndarray:
    """The first task of each turn, and the number of tasks; ``load`` is about how many copies of a vector each task gets."""
    copies = load.sum()
    turns = 1 if copies <= COPIES_AT_ONCE else int(min(MAX_TURNS, len(load), np.ceil(copies / COPIES_PER_TURN)))
    edges = np.searchsorted(np.cumsum(load), copies * np.arange(1, turns) / turns) + 1
    return np.unique(np.r_[0, edges, len(load)])


def _coded(batches: Iterator[pa.RecordBatch], shared, size: int) -> Iterator[pa.RecordBatch]:
    """(id, vec, lists, turns): the lists that each vector has to do with, coded, and a bit for each turn in which it is sent."""
    index = shared.value
    start = np.r_[0, np.cumsum(index.splits)[:-1]]
    for whole in batches:
        done = 0
        while done < whole.num_rows:  # fewer rows at once where each may visit many lists
            batch = whole.slice(done, max(1_024, 200_000_000 // len(index.part_of)))
            done += batch.num_rows
            row, lists, stored, visited = route(index, _matrix(batch.column("vec"), size))
            code = (lists.astype(np.int32) << 2) | (stored.astype(np.int32) << 1) | visited
            order = np.lexsort((code, row))
            row, code = row[order], code[order].astype(np.int32)
            part = index.part_of[code >> 2]
            first = np.searchsorted(index.turns, start[part], "right") - 1
            last = np.searchsorted(index.turns, start[part] + index.splits[part] - 1, "right") - 1
            starts = np.searchsorted(row, np.arange(batch.num_rows))
            turns = np.bitwise_or.reduceat((np.int64(1) << (last + 1)) - (np.int64(1) << first), starts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)].astype(np.int32)), pa.array(code)), pa.array(turns)], ["id", "vec", "lists", "turns"])


def _sent(batches: Iterator[pa.RecordBatch], shared, turn: int) -> Iterator[pa.RecordBatch]:
    """(part, id, vec, lists): a coded vector for each task of a turn, numbered from 0, and the lists it has to do with there."""
    index = shared.value
    start = np.r_[0, np.cumsum(index.splits)[:-1]]
    low, high = index.turns[turn : turn + 2]
    for batch in batches:
        lists = batch.column("lists")
        row, code = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        part = index.part_of[code >> 2]
        splits = index.splits[part]
        own = (batch.column("id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)[row] % splits
        # a visitor goes to one task of a split partition, what is stored to all of them
        copies = np.where(code & 2 > 0, splits, 1)
        at = np.repeat(np.arange(len(row)), copies)
        turned = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
        turned = (own[at] + turned) % splits[at]
        code = np.where(turned == own[at], code[at], code[at] & ~1)
        row, task = row[at], (start[part[at]] + turned).astype(np.int32)
        here = (task >= low) & (task < high)
        row, task, code = row[here], task[here] - np.int32(low), code[here]
        if not len(row):
            continue
        order = np.lexsort((code, task, row))
        row, task, code = row[order], task[order], code[order].astype(np.int32)
        starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (task[1:] != task[:-1])])
        at = pa.array(row[starts])
        offsets = pa.array(np.r_[starts, len(row)].astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(task[starts]), batch.column("id").take(at), batch.column("vec").take(at), pa.ListArray.from_arrays(offsets, pa.array(code))], ["part", "id", "vec", "lists"])


def _searched(batches: Iterator[pa.RecordBatch], shared, size: int, list_size: int, k: int) -> Iterator[pa.RecordBatch]:
    """(id, others, sims): the best in the lists of one partition."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    index, table = shared.value, pa.Table.from_batches(got).sort_by("id")
    x = _matrix(table["vec"], size)
    keys = table["id"].to_numpy()
    lists = table["lists"].combine_chunks()
    row = np.repeat(np.arange(len(x)), lists.value_lengths().to_numpy())
    code = lists.flatten().to_numpy()
    entries = []
    for number, at in _groups(np.arange(len(code)), code >> 2):
        stored, visiting = row[at[code[at] & 2 > 0]], row[at[code[at] & 1 > 0]]
        if len(stored) > LONG * list_size and len(visiting):
            entries += split_list(x, stored, visiting, float(index.ratio[number]), list_size, k)
        else:
            entries.append((stored, visiting))
    q, o, s = best_in_lists(x, entries, k)
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    offsets = pa.array(np.r_[starts, len(q)].astype(np.int32))
    found = [pa.array(keys[q[starts]]), pa.ListArray.from_arrays(offsets, pa.array(keys[o])), pa.ListArray.from_arrays(offsets, pa.array(s))]
    yield from pa.Table.from_arrays(found, ["id", "others", "sims"]).to_batches(20_000)


def _top(batches: Iterator[pa.RecordBatch], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, other, similarity, rank) of the ``k`` best of each query, by query and rank."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int32)
    table = pa.Table.from_batches(got)
    lists = table["others"].combine_chunks()
    q = np.repeat(table["id"].to_numpy(), lists.value_lengths().to_numpy())
    o, s = lists.flatten().to_numpy(), table["sims"].combine_chunks().flatten().to_numpy()
    order = np.lexsort((-s, o, q))
    q, o, s = q[order], o[order], s[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (o[1:] != o[:-1])
    q, o, s = q[fresh], o[fresh], s[fresh]
    order = np.lexsort((o, -s, q))
    q, o, s = q[order], o[order], s[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)])) + 1
    keep = rank <= k
    return q[keep], o[keep], s[keep], rank[keep].astype(np.int32)


def _best(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    yield from pa.Table.from_arrays([pa.array(x) for x in _top(batches, k)], ["id", "other", "similarity", "rank"]).to_batches(50_000)


def _merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(id, others, sims) once for each query."""
    q, o, s, rank = _top(batches, k)
    starts = np.flatnonzero(rank == 1)
    offsets = pa.array(np.r_[starts, len(q)].astype(np.int32))
    yield from pa.Table.from_arrays([pa.array(q[starts]), pa.ListArray.from_arrays(offsets, pa.array(o)), pa.ListArray.from_arrays(offsets, pa.array(s))], ["id", "others", "sims"]).to_batches(20_000)


_FOUND = "id bigint, others array<bigint>, sims array<double>"


def _found(units: Units, index: Index, total: int, size: int, list_size: int, k: int) -> DataFrame:
    """(id, others, sims): the best of each query in the tasks that it visits, or in the turns if there are several."""
    spark = units.keys.sparkSession
    shared = spark.sparkContext.broadcast(index)
    coded = units.vectors().select("id", "vec").mapInArrow(lambda it: _coded(it, shared, size), "id bigint, vec binary, lists array<int>, turns bigint")

    def searched(rows: DataFrame, turn: int) -> DataFrame:
        sent = rows.select("id", "vec", "lists").mapInArrow(lambda it: _sent(it, shared, turn), "part int, id bigint, vec binary, lists array<int>")
        return sent.repartitionById(int(index.turns[turn + 1] - index.turns[turn]), "part").mapInArrow(lambda it: _searched(it, shared, size, list_size, k), _FOUND)

    turns = len(index.turns) - 1
    if turns == 1:
        return searched(coded, 0)
    path, found = fresh_path(spark, "vectors-coded"), fresh_path(spark, "neighbours-found")
    coded.write.option("compression", "zstd").parquet(path)
    coded = spark.read.schema(coded.schema).parquet(path)
    tasks = max(1, -(-total * k // ROWS_PER_TASK))
    for turn in range(turns):
        mine = searched(coded.filter(F.col("turns").bitwiseAND(1 << turn) != 0), turn)
        mine.repartition(tasks, "id").mapInArrow(lambda it: _merged(it, k), _FOUND).write.mode("append").option("compression", "zstd").parquet(found)
        del mine
        release(spark)
    delete(spark, path)
    return spark.read.schema(_FOUND).parquet(found)


def nearest_neighbours(df: DataFrame, key: str = "row_ix", vector: str = "matrix", size: int = 128, k: int = 10, list_size: int = LIST_SIZE) -> DataFrame:
    """(id, other, similarity, rank): for each valid row its ``k`` most similar other valid rows by cosine.

    Equal similarities rank by key. Fewer rows come out only where the visited lists hold fewer others. Similarities are
    those of the float32 unit vectors, in double precision. An empty table, or one without a valid row, gives an empty result.
    ``df`` is read five times. Where the index sends a vector to many partitions, they are searched in turns before this returns.
    """
    spark = df.sparkSession
    units = Units(df, key, vector, size)
    keys = units.keys
    total = keys.count()
    hot = keys.groupBy("direction").agg(F.count("*").alias("n")).filter(F.col("n") >= max(HOT_ROWS, total // HOT_SHARE)).select("direction")
    hot = staged(hot, "hot-directions")
    copies = None
    if hot.limit(1).count():
        of_hot = keys.join(F.broadcast(hot), "direction")
        first = of_hot.withColumn("rn", F.row_number().over(Window.partitionBy("direction").orderBy("id"))).filter(F.col("rn") <= k + 1)
        first = staged(first.groupBy("direction").agg(F.sort_array(F.collect_list("id")).alias("first")), "hot-first")
        rest = of_hot.join(F.broadcast(first), "direction").filter(~F.array_contains("first", F.col("id")))
        copies = rest.select("id", F.posexplode(F.slice("first", 1, k)).alias("at", "other")).select("id", "other", F.lit(1.0).alias("similarity"), (F.col("at") + 1).cast("int").alias("rank"))
        total -= rest.count()
        units.only_first(first)
    schema = "id bigint, other bigint, similarity double, rank int"
    index = build_index(units, total, size, list_size, k)
    if index is None:
        return spark.createDataFrame([], schema)
    found = _found(units, index, total, size, list_size, k)
    tasks = max(1, -(-total * k * 3 // ROWS_PER_TASK))
    best = found.repartition(tasks, "id").mapInArrow(lambda it: _best(it, k), schema)
    return best if copies is None else best.unionByName(copies)


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """(row_ix_a, row_ix_b): each pair once, smaller key first, of which one is among the nearest of the other."""
    return neighbours.select(F.least("id", "other").alias("row_ix_a"), F.greatest("id", "other").alias("row_ix_b")).distinct()


def with_words(neighbours: DataFrame, words: DataFrame) -> DataFrame:
    """Neighbours with the words of both rows.

    A row's word is the smallest of its trimmed words that is neither blank nor ``nan``, else null.
    """
    w = F.trim("words")
    named = words.filter(F.col("row_ix").isNotNull()).groupBy(F.col("row_ix").cast("bigint").alias("row_ix")).agg(F.min(F.when((w != "") & (F.lower(w) != "nan"), w)).alias("word"))
    rows = neighbours.join(named.select(F.col("row_ix").alias("id"), "word"), "id", "left")
    rows = rows.join(named.select(F.col("row_ix").alias("other"), F.col("word").alias("other_word")), "other", "left")
    return rows.select(F.col("id").alias("row_ix"), "word", "rank", F.col("other").alias("other_row_ix"), "other_word", F.round("similarity", 4).alias("similarity"))
