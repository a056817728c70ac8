"""Most similar vectors for every vector, by an inverted multi-index.

Vectors are cut into two halves and each half is quantised by its own k-means;
a cell is a pair of centroids. A query walks the pairs in the order of summed
distance with a heap until the cells it has met should hold enough entries, and
the entries of those cells are reranked by exact cosine.

Vectors of equal direction are one entry: a class keeps its smallest row ids,
and every row of the class gets its list from those, so copies cost nothing.
The float32 products only choose what is reranked, with a margin above their
error, so ties are kept whole also where scales leave directions a little apart.

The number of centroids grows with the root of the number of rows, so a cell
holds about as many entries at any size and a query looks at as many. Blocks of
work are neighbouring cells with a bounded number of entries: an entry is sent
to its one block, a query to the few blocks that its cells lie in. A single cell
that alone is too large becomes a grid of chunks of entries and salts of queries.

Defined results: rows whose vector is null, not of the wanted width, not
finite, or all zero take no part. With fewer than k + 1 usable rows each gets
all others. Similarity is the cosine rounded to 9 decimals, ties to the smaller
row id. Recall is measured against brute force in tests and in the README.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pagewright.session import cut_lineage, parallelism, salted_join, spread

# Documented bounds of the sample that centroids and expected cell sizes are fitted on: rows for each centroid, at least and at most in all.
FIT_EACH, FIT_LEAST, FIT_MOST = 48, 24_000, 400_000
ENTRIES_PER_CELL = 8
MOST_CENTROIDS = FIT_MOST // FIT_EACH  # of a half; enough for ENTRIES_PER_CELL up to 550 M classes, beyond which cells grow
ENTRIES_PER_BLOCK = 24_000


def centroids_for(rows: int) -> int:
    return int(np.clip(round(math.sqrt(max(rows, 1) / ENTRIES_PER_CELL)), 4, MOST_CENTROIDS))


@dataclass(frozen=True)
class Index:
    """Fitted model: centroids of both halves, the expected entries of each cell that the sample has seen, and which cells hold any entry at all.

    Cells that hold entries but were not seen share the rest evenly.
    """

    first: np.ndarray
    second: np.ndarray
    seen: dict[int, float]  # first * len(second) + second -> expected entries
    unseen: float
    rows: int
    occupied: bytes | None = None  # a bit for each cell; null: not known, so any may hold entries

    def with_occupied(self, cells: np.ndarray) -> Index:
        """With the cells that hold entries, of all entries."""
        bits = np.zeros(len(self.first) * len(self.second), bool)
        bits[cells] = True
        unseen = max(1.0, (self.rows - sum(self.seen.values())) / max(1, bits.sum() - len(self.seen)))
        return replace(self, unseen=unseen, occupied=np.packbits(bits, bitorder="little").tobytes())

    def centres(self, cells: np.ndarray) -> np.ndarray:
        return np.concatenate([self.first[cells // len(self.second)], self.second[cells % len(self.second)]], axis=1)


@dataclass(frozen=True)
class Blocks:
    """Which block a cell belongs to: a tree of planes over the centres of the cells; a cell too heavy for a block has a grid of blocks of its own."""

    planes: np.ndarray
    cuts: np.ndarray
    children: np.ndarray  # next node on either side of a plane, or ~block
    grid: dict[int, int]  # first block of a heavy cell -> side of its grid
    count: int

    @classmethod
    def of(cls, index: Index, most: float) -> Blocks:
        cells, load = np.array(list(index.seen)), np.array(list(index.seen.values()))
        centre = index.centres(cells).astype(np.float64)
        planes, cuts, children, grid, count = [], [], [], {}, 0
        todo = [(np.arange(len(cells)), -1, 0)]
        while todo:
            ids, parent, side = todo.pop()
            total = load[ids].sum()
            if total <= most or len(ids) == 1:
                here = ~count
                edge = math.ceil(total / most) if total > most else 1
                if edge > 1:
                    grid[count] = edge
                count += edge * edge
            else:  # halves of the load along the direction of greatest spread
                x = (centre[ids] - np.average(centre[ids], axis=0, weights=load[ids])) * np.sqrt(load[ids])[:, None]
                plane = np.linalg.eigh(x.T @ x)[1][:, -1].astype(np.float32)
                along = centre[ids].astype(np.float32) @ plane
                order = np.argsort(along, kind="stable")
                filled = np.cumsum(load[ids[order]])
                middle = int(np.clip(np.searchsorted(filled, filled[-1] / 2) + 1, 1, len(ids) - 1))
                here = len(planes)
                planes.append(plane)
                cuts.append((along[order[middle - 1]] + along[order[middle]]) / 2)
                children.append([0, 0])
                low = along <= cuts[-1]
                if low.all():  # equal along the plane: the cut is at random, as for cells that are not known
                    low = np.arange(len(ids)) < len(ids) // 2
                todo += [(ids[low], here, 0), (ids[~low], here, 1)]
            if parent >= 0:
                children[parent][side] = here
        return cls(np.array(planes).reshape(-1, centre.shape[1]), np.array(cuts), np.array(children, np.int64).reshape(-1, 2), grid, count)

    def of_cells(self, centres: np.ndarray) -> np.ndarray:
        """Block of each cell, given by its centre; the first one of its grid for a heavy cell."""
        node = np.zeros(len(centres), np.int64) if len(self.planes) else np.full(len(centres), ~0)
        while (active := np.flatnonzero(node >= 0)).size:
            at = node[active]
            right = np.einsum("nd,nd->n", centres[active], self.planes[at]) > self.cuts[at]
            node[active] = self.children[at, right.astype(int)]
        return ~node


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm; empty centroids move to the points furthest from theirs."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        sums = np.add.reduceat(x[order], (np.cumsum(n) - n)[n > 0], axis=0)
        c[n > 0] = sums / n[n > 0, None]
        if (n == 0).any():
            far = np.argsort(-((x - c[at]) ** 2).sum(1))[: (n == 0).sum()]
            c[n == 0] = x[far]
    return c.astype(np.float32)


def fit(sample: np.ndarray, rows: int) -> Index:
    """Index of rows entries, fitted on a bounded sample of unit vectors."""
    half = sample.shape[1] // 2
    k = min(centroids_for(rows), max(1, len(sample) // 4))
    first, second = kmeans(sample[:, :half], k, seed=7), kmeans(sample[:, half:], k, seed=11)
    i, j = (_nearest(h, c) for h, c in ((sample[:, :half], first), (sample[:, half:], second)))
    cells, count = np.unique(i * len(second) + j, return_counts=True)
    n = len(first) * len(second)
    smooth = 0.25 * len(sample) / n
    scale = rows / (len(sample) + smooth * n)
    return Index(first, second, dict(zip(cells.tolist(), ((count + smooth) * scale).tolist())), smooth * scale, rows)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each row, in steps of bounded memory."""
    norm = (c * c).sum(1)
    return np.concatenate([(norm - 2 * x[at : at + 8192] @ c.T).argmin(1) for at in range(0, len(x), 8192)])


NEAR = 128  # centroids of a half that a walk sorts at first


def walk(near: tuple[list, list, list, list], index: Index, wanted: float, whole: bool) -> list[tuple[int, int]] | None:
    """Cells that hold entries, in the order of summed distance, until they should hold the wanted number of them.

    near has the nearest centroids of both halves with their distances, in
    order. Null if the walk came to their end and they are not the whole.
    """
    la, sa, lb, sb = near
    heap, out, have, width = [(sa[0] + sb[0], 0, 0)], [], 0.0, len(index.second)
    occupied, seen, unseen = index.occupied, index.seen, index.unseen
    na, nb = len(la), len(lb)
    while heap and have < wanted:
        _, r, s = heapq.heappop(heap)
        if not whole and (r + 1 == na or s + 1 == nb):
            return None
        cell = la[r] * width + lb[s]
        if occupied is None or occupied[cell >> 3] >> (cell & 7) & 1:
            out.append((la[r], lb[s]))
            have += seen.get(cell, unseen)
        # each pair has one parent: right moves always, down moves only from the first column
        if s + 1 < nb:
            heapq.heappush(heap, (sa[r] + sb[s + 1], r, s + 1))
        if s == 0 and r + 1 < na:
            heapq.heappush(heap, (sa[r + 1] + sb[0], r + 1, 0))
    return out


def walks(index: Index, u: np.ndarray, wanted: float) -> Iterator[tuple[list[tuple[int, int]], int, int]]:
    """The walk and the own cell of each unit vector."""
    half = len(index.first[0])
    halves = [(c, (c * c).sum(1), u[:, part]) for c, part in ((index.first, slice(0, half)), (index.second, slice(half, None)))]
    for at in range(0, len(u), 2048):
        # distances without the query's own norm, which is the same for all cells
        d = [n - 2 * x[at : at + 2048] @ c.T for c, n, x in halves]
        some = min(NEAR, len(index.first))
        ids = [np.argpartition(x, some - 1, axis=1)[:, :some] if some < x.shape[1] else np.tile(np.arange(some), (len(x), 1)) for x in d]
        for k, x in enumerate(d):
            ids[k] = np.take_along_axis(ids[k], np.argsort(np.take_along_axis(x, ids[k], 1), axis=1, kind="stable"), 1)
        near = [y for k, x in enumerate(d) for y in (ids[k].tolist(), np.take_along_axis(x, ids[k], 1).tolist())]
        for r in range(len(d[0])):
            one = tuple(y[r] for y in near)
            found = walk(one, index, wanted, some == len(index.first))
            if found is None:
                order = [np.argsort(x[r], kind="stable") for x in d]
                found = walk(tuple(y for x, o in zip(d, order) for y in (o.tolist(), x[r][o].tolist())), index, wanted, True)
            yield found, one[0][0], one[2][0]


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


SENT = "block int, id long, ids array<long>, own int, cells binary, vector binary"
_SENT = pa.schema([("block", pa.int32()), ("id", pa.int64()), ("ids", pa.list_(pa.int64())), ("own", pa.int32()), ("cells", pa.binary()), ("vector", pa.binary())])
FOUND = "id long, near array<struct<d:double,id:long>>"
_FOUND = pa.schema([("id", pa.int64()), ("near", pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64())])))])


def _mix(key: int, side: int) -> int:
    return (key * 0x9E3779B97F4A7C15 >> 29 & 0xFFFFFFFF) % side


def _router(model, wanted: int, width: int):
    """Arrow mapper: each vector goes to the blocks that its walk comes into, as a query, and to the block of its own cell as an entry too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, blocks = model.value
        n = len(index.second)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                keys, ids = part.column(0).to_pylist(), part.column(1).to_pylist()
                raw = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(keys), width)
                found = list(walks(index, unit(raw).astype(np.float32), wanted))
                flat = np.array([i * n + j for cells, *_ in found for i, j in cells])
                home_cell = np.array([a * n + b for _, a, b in found])
                known, back = np.unique(np.concatenate((flat, home_cell)), return_inverse=True)
                block_of = blocks.of_cells(index.centres(known))[back]
                ends = np.cumsum([len(cells) for cells, *_ in found])
                out: list[tuple] = []
                for r, (home, cell, stop) in enumerate(zip(block_of[len(flat) :].tolist(), home_cell.tolist(), ends.tolist())):
                    mine = slice(ends[r - 1] if r else 0, stop)
                    asked: dict[int, list[int]] = {}
                    for block, c in zip(block_of[mine].tolist(), flat[mine].tolist()):
                        asked.setdefault(block, []).append(c)
                    data = raw[r].tobytes()
                    for block, wants in asked.items():
                        sent = np.array(wants, np.int32).tobytes()
                        side = blocks.grid.get(block, 1)
                        if side == 1:
                            here = block == home
                            out.append((block, keys[r], ids[r] if here else None, cell if here else -1, sent, data))
                            continue
                        salt = _mix(keys[r] + 1, side)
                        out += [(block + chunk * side + salt, keys[r], None, -1, sent, data) for chunk in range(side)]
                    side = blocks.grid.get(home, 1)
                    if side > 1 or home not in asked:
                        chunk = _mix(keys[r], side)
                        out += [(home + chunk * side + salt, keys[r], ids[r], cell, b"", data) for salt in range(side)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SENT.types)], schema=_SENT)

    return run


def _top(q: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, by similarity, ties to the smaller id; in order of query."""
    order = np.lexsort((ids, -s, q))
    by = q[order]
    start = np.concatenate(([True], by[1:] != by[:-1]))
    at = np.arange(len(by))
    return order[at - np.maximum.accumulate(np.where(start, at, 0)) < k]


def _reranker(k: int, width: int):
    """Exact cosine of the queries of one block with the entries of the cells they walked into; the rows of the best k classes of each."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids = t.column("id").to_numpy()
        own = t.column("own").to_numpy()
        u = unit(np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float32).reshape(len(ids), width))
        f = u.astype(np.float32)
        entry = np.flatnonzero(own >= 0)
        entry = entry[np.lexsort((ids[entry], own[entry]))]
        entry_cell = own[entry]
        lists = [np.frombuffer(c, np.int32) for c in t.column("cells").to_pylist()]
        who, what = np.repeat(np.arange(len(ids)), [len(x) for x in lists]), np.concatenate([np.zeros(0, np.int32), *lists])
        order = np.argsort(what, kind="stable")
        who, what = who[order], what[order]
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # twice the error that a float32 product of two unit vectors can have, and the rounding of similarities
        margin = 2 * (width + 4) * 2.0**-24 + 1e-9
        for cell in np.unique(entry_cell):
            e = entry[slice(*np.searchsorted(entry_cell, (cell, cell + 1)))]
            a, b = np.searchsorted(what, (cell, cell + 1))
            for at in range(a, b, 2048):
                q = who[at : min(b, at + 2048)]
                for low in range(0, len(e), 8192):
                    es = e[low : low + 8192]
                    s = f[q] @ f[es].T
                    least = np.partition(s, len(es) - k, axis=1)[:, len(es) - k, None] - margin if k < len(es) else -2.0
                    near = s >= least
                    # many entries tie about a hot direction: then fewer queries at a time
                    step = len(q) if np.count_nonzero(near) <= 1 << 18 else max(1, (1 << 18) // len(es))
                    for first in range(0, len(q), step):
                        r, c = np.nonzero(near[first : first + step])
                        if len(r):
                            qs, sim = q[first + r], np.round(np.einsum("nd,nd->n", u[q[first + r]], u[es[c]]), 9)
                            best = _top(qs, sim, ids[es[c]], k)
                            parts.append((qs[best], es[c][best], sim[best]))
        if not parts:
            return _FOUND.empty_table()
        q, e, s = (np.concatenate(x) for x in zip(*parts))
        best = _top(q, s, ids[e], k)
        q, e, s = q[best], e[best], s[best]
        # a class brings its rows
        held = t.column("ids").combine_chunks().take(pa.array(e))
        size = held.value_lengths().to_numpy()
        rows, q, s = held.flatten().to_numpy(), np.repeat(q, size), np.repeat(s, size)
        best = _top(q, s, rows, k)
        q, s, rows = q[best], s[best], rows[best]
        start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        near = pa.StructArray.from_arrays([pa.array(-s), pa.array(rows)], names=["d", "id"])
        return pa.table({"id": pa.array(ids[q[start]]), "near": pa.ListArray.from_arrays(pa.array(np.append(start, len(q)), pa.int32()), near)}, schema=_FOUND)

    return run


def usable(pages: DataFrame, width: int) -> DataFrame:
    """(rev_id, embedding) of the rows that take part."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return pages.select("rev_id", "embedding").filter(F.col("rev_id").isNotNull() & (F.size(e) == width) & finite & F.exists(e, lambda x: x != 0))


KEYED = "rev_id long, embedding array<float>, h1 long, h2 long"


def _directions(width: int):
    """Arrow mapper that adds two hashes of the unit vector, taken as whole multiples of 1e-12: equal for one direction at any scale that float32 holds exactly."""
    weights = np.random.default_rng(41).integers(1, 1 << 63, size=(2, width), dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, width)
                whole = np.rint(unit(raw) * 1e12).astype(np.int64).view(np.uint64)
                whole = (whole ^ whole >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
                whole ^= whole >> np.uint64(29)
                keys = [pa.array((whole * w).sum(1, dtype=np.uint64).view(np.int64)) for w in weights]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(raw), pa.list_(pa.float32())), *keys], names=["rev_id", "embedding", "h1", "h2"])

    return run


def _cells_of(model, width: int):
    """Arrow mapper: the distinct cells that a batch of vectors lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, half = model.value, width // 2
        for batch in batches:
            if batch.num_rows:
                u = unit(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, width)).astype(np.float32)
                cells = np.unique(_nearest(u[:, :half], index.first) * len(index.second) + _nearest(u[:, half:], index.second))
                yield pa.RecordBatch.from_arrays([pa.array(cells)], names=["cell"])

    return run


def occupied_cells(classes: DataFrame, index: Index, width: int) -> np.ndarray:
    """The cells that hold any entry, of all entries. They come to the driver as 4 KB of bits for 32,768 cells, 9 MB at most."""
    model = classes.sparkSession.sparkContext.broadcast(index)
    cells = classes.select("embedding").mapInArrow(_cells_of(model, width), "cell long")
    parts = cells.groupBy(F.floor(F.col("cell") / (1 << 15)).alias("part")).agg(F.bitmap_construct_agg(F.pmod("cell", F.lit(1 << 15))).alias("bits"))
    return np.concatenate([np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")) + (r.part << 15) for r in parts.collect()])


def nearest(pages: DataFrame, k: int = 5, width: int = 64, wanted: int = 1200) -> DataFrame:
    """(rev_id, other, sim, rank) of the k most similar rows of every usable row.

    wanted is how many entries a query looks at, by expected cell sizes: it is
    where accuracy is traded for time.
    """
    spark = pages.sparkSession
    rows = usable(pages, width)
    # equal directions become one class, known by two hashes of the unit vector; the window keeps the first ids
    # of each, and is limited before the shuffle, so that a hot class sends a few rows from each task
    keyed = rows.mapInArrow(_directions(width), KEYED)
    ranked = keyed.withColumn("r", F.row_number().over(W.partitionBy("h1", "h2").orderBy("rev_id"))).filter(F.col("r") <= k + 2)
    classes = ranked.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("rev_id")).alias("ids"), F.min_by("embedding", "rev_id").alias("embedding"))
    # three later steps read the classes: they are written once into the shared folder
    classes = cut_lineage(classes.select(F.col("ids")[0].alias("id"), "ids", "h1", "h2", "embedding"))
    n, hot = classes.agg(F.count(F.lit(1)), F.count_if(F.size("ids") > k + 1)).first()
    if not n:
        return spark.createDataFrame([], "rev_id long, other long, sim double, rank int")
    # by hash, about as many as the fit takes, and never more than half as many again
    fit_rows = int(np.clip(FIT_EACH * centroids_for(n), FIT_LEAST, FIT_MOST))
    share = min(1 << 30, fit_rows * (1 << 30) // n)
    taken = classes.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= share).limit(fit_rows * 3 // 2).select("embedding").toArrow().column(0)
    sample = unit(np.asarray(taken.combine_chunks().flatten(), np.float32).reshape(-1, width)).astype(np.float32)
    index = fit(sample, n)
    index = index.with_occupied(occupied_cells(classes, index, width))
    blocks = Blocks.of(index, min(ENTRIES_PER_BLOCK, max(500, n / (2 * parallelism(spark)))))
    model = spark.sparkContext.broadcast((index, blocks))  # bounded by MOST_CENTROIDS and FIT_MOST
    sent = spread(classes.select("id", F.slice("ids", 1, k + 1).alias("ids"), "embedding"), "id", per_task=4 << 20).mapInArrow(_router(model, wanted, width), SENT)
    # four places for each block, so that few blocks share a task
    found = sent.repartition(min(4 * blocks.count, 1 << 16), "block").groupBy("block").applyInArrow(_reranker(k + 1, width), FOUND)
    lists = found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    # the list of a class serves all its rows: small classes know them, the rows of large ones are joined
    known = lists.join(classes.select("id", "ids", "h1", "h2"), "id")
    out = known.filter(F.size("ids") <= k + 1).select(F.explode("ids").alias("rev_id"), "near")
    if hot:
        large = known.filter(F.size("ids") > k + 1).select("h1", "h2", "near")
        out = out.unionByName(salted_join(keyed.select("rev_id", "h1", "h2"), large, ["h1", "h2"], "rev_id").select("rev_id", "near"))
    mine = F.slice(F.filter("near", lambda x: x["id"] != F.col("rev_id")), 1, k)
    return out.select("rev_id", F.posexplode(mine).alias("p", "x")).select("rev_id", F.col("x.id").alias("other"), (-F.col("x.d")).alias("sim"), (F.col("p") + 1).alias("rank"))


def neighbour_pairs(pages: DataFrame, k: int = 5, width: int = 64) -> DataFrame:
    """(rev_id_a, rev_id_b) with rev_id_a < rev_id_b where one is among the k most similar rows of the other."""
    near = nearest(pages, k, width)
    return near.select(F.least("rev_id", "other").alias("rev_id_a"), F.greatest("rev_id", "other").alias("rev_id_b")).distinct()


def brute_force(ids: np.ndarray, vectors: np.ndarray, k: int = 5) -> set[tuple[int, int]]:
    """The exact pairs, in blocks of rows, for tests."""
    u, pairs = unit(vectors), set()
    for lo in range(0, len(ids), 512):
        s = np.round(u[lo : lo + 512] @ u.T, 9)
        for r in range(len(s)):
            s[r, lo + r] = -9
            for o in np.lexsort((ids, -s[r]))[: min(k, len(ids) - 1)]:
                pairs.add((int(min(ids[lo + r], ids[o])), int(max(ids[lo + r], ids[o]))))
    return pairs
