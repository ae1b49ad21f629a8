"""The most similar vectors of every vector, with an inverted multi-index.

Unit vectors are cut into two halves and each half is quantised by its own codebook,
so K centroids a half make K x K cells. A cell that is full gets two codebooks of its
own, fitted to its vectors, and is divided into smaller ones, again and again; what is
not divided is a *leaf*. For every vector the pairs of centroids are traversed with a
heap in the order of summed distance, through the small cells of full ones too, until
enough leaves are met. The vectors of these leaves are its candidates, and are reranked.

Leaves near to each other form regions of bounded size, one task each. Vectors stand in
the region of their own leaf; a vector asks in the few regions that hold the leaves it
met. So what is moved is a small multiple of the collection, however large it is.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from threadloom.session import cut_lineage

#: Unit vectors are kept as 16-bit integers; a product is then off by about 1e-5.
SCALE = 32767.0


@dataclass(frozen=True)
class Options:
    """``k``: neighbours of each vector. ``dim``: values of a usable vector.

    ``sample``: vectors a pair of codebooks is fitted to, at most (all are indexed).
    ``per_cell``: vectors for each cell that set the number of centroids, up to
    ``most_centroids`` a half. ``full``: a cell with more is divided, into cells of about
    ``per_small_cell``, in at most ``levels`` rounds. ``least_leaves``, ``candidates``:
    leaves and vectors that a traversal must meet. ``region``: vectors that stand
    together; a leaf above twice of it, of vectors that no codebook tells apart, is
    answered in blocks of the vectors that ask.
    """

    k: int = 5
    dim: int = 64
    sample: int = 20_000
    per_cell: float = 8.0
    most_centroids: int = 512
    full: int = 4000
    per_small_cell: float = 250.0
    levels: int = 4
    least_leaves: int = 5
    candidates: int = 80
    region: int = 10_000
    rounds: int = 8


# -- vectors -----------------------------------------------------------------------


def _unit(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            # Lists of the right size without nulls in them; the rest takes no part.
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            with np.errstate(all="ignore"):
                peak = np.abs(flat).max(axis=1) if len(flat) else np.empty(0)
                scaled = flat / peak[:, None]
                norm = np.sqrt((scaled * scaled).sum(axis=1))
                good = np.isfinite(flat).all(axis=1) & (peak > 0)
                unit = np.rint(scaled / norm[:, None] * SCALE)
            kept = unit[good].astype("<i2")
            yield pa.RecordBatch.from_arrays(
                [ids.filter(pa.array(good)), pa.array([row.tobytes() for row in kept], pa.binary())], names=["id", "q"]
            )

    return run


def unit_vectors(vectors: DataFrame, options: Options = Options()) -> DataFrame:
    """``id, q``: usable vectors, scaled to one norm, as little-endian 16-bit integers.

    Unusable are null, vectors of another length, and vectors with a null, infinite or
    undefined value or of zeros only.
    """
    usable = vectors.where(
        F.col("id").isNotNull() & (F.size("embedding") == options.dim) & ~F.exists("embedding", lambda x: x.isNull())
    )
    return usable.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>")).mapInArrow(_unit(options.dim), "id long, q binary")


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors of a binary column as float32 rows of norm one."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = []
    for c in chunks:
        raw = np.frombuffer(b"".join(c.to_pylist()), "<i2")
        parts.append(raw.reshape(-1, dim))
    out = np.concatenate(parts) if parts else np.empty((0, dim), "<i2")
    return out.astype(np.float32) / np.float32(SCALE)


# -- codebooks ---------------------------------------------------------------------


def _nearest(x: np.ndarray, centroids: np.ndarray, block: int = 8192) -> np.ndarray:
    half = (centroids * centroids).sum(axis=1) / 2
    out = np.empty(len(x), np.int32)
    for a in range(0, len(x), block):
        out[a : a + block] = (x[a : a + block] @ centroids.T - half).argmax(axis=1)
    return out


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Plain k-means; a centroid that loses all its vectors is put on a random one."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        of = _nearest(x, centroids)
        order = np.argsort(of, kind="stable")
        counts = np.bincount(of, minlength=k)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        full = counts > 0
        sums = np.add.reduceat(x[order], starts[full], axis=0)
        centroids[full] = sums / counts[full][:, None]
        if not full.all():
            centroids[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centroids


@dataclass
class Codebooks:
    first: np.ndarray
    second: np.ndarray

    @property
    def k(self) -> int:
        return max(len(self.first), len(self.second), 1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        half = x.shape[1] // 2
        return _nearest(x[:, :half], self.first) * self.k + _nearest(x[:, half:], self.second)


def _fitted(x: np.ndarray, k: int, options: Options) -> Codebooks:
    half = options.dim // 2
    return Codebooks(k_means(x[:, :half], k, options.rounds, 1), k_means(x[:, half:], k, options.rounds, 2))


def fit_codebooks(units: DataFrame, total: int, options: Options = Options()) -> Codebooks:
    """Two codebooks from a sample by hash of at most ``options.sample`` vectors."""
    share = max(1, -(-total // options.sample))
    rows = units.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("q").limit(options.sample * 2).toArrow()
    k = int(min(options.most_centroids, max(1, round((total / options.per_cell) ** 0.5))))
    return _fitted(_matrix(rows.column(0), options.dim), k, options)


# -- leaves --------------------------------------------------------------------------


@dataclass
class Index:
    """Cells of the two codebooks, and the codebooks of full cells with their first leaf.

    Leaves are numbered: first the K x K cells, then the small cells of each full cell,
    which may be full again. ``counts`` has the vectors of every leaf, ``region_of`` its
    region, ``blocks_of`` the blocks of every region.
    """

    books: Codebooks
    inner: dict[int, tuple[int, Codebooks]] = field(default_factory=dict)
    size: int = 0
    counts: np.ndarray | None = None
    region_of: np.ndarray | None = None
    blocks_of: np.ndarray | None = None

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of ``x``."""
        out = self.books.cells(x) if len(x) else np.empty(0, np.int64)
        todo = np.arange(len(x)) if self.inner else ()
        while len(todo):
            order = todo[np.argsort(out[todo], kind="stable")]
            found, starts = np.unique(out[order], return_index=True)
            divided = []
            for cell, rows in zip(found.tolist(), np.split(order, starts[1:])):
                if cell in self.inner:
                    first, books = self.inner[cell]
                    out[rows] = first + books.cells(x[rows])
                    divided.append(rows)
            todo = np.concatenate(divided) if divided else ()
        return out

    def centres(self, leaves: np.ndarray) -> np.ndarray:
        """The two halves of each leaf's centre side by side; ``leaves`` rise."""
        out = []
        for first, books in [(0, self.books), *self.inner.values()]:  # by rising first leaf
            own = leaves[(leaves >= first) & (leaves < first + books.k**2)] - first
            out.append(np.concatenate([books.first[own // books.k], books.second[own % books.k]], axis=1))
        return np.concatenate(out)

    def cells(self, point: tuple[np.ndarray, np.ndarray], books: Codebooks, first: int = 0) -> Iterator[int]:
        """All leaves from a point by rising summed distance, cell by cell."""
        for cell in _pairs(books, *point):
            inside = self.inner.get(first + cell)
            if inside:
                yield from self.cells(point, inside[1], inside[0])
            else:
                yield first + cell

    def traverse(self, vector: np.ndarray, options: Options) -> list[int]:
        """The occupied leaves met from a vector until they are enough."""
        half, met, found, counts = len(vector) // 2, [], 0, self.counts
        for leaf in self.cells((vector[:half], vector[half:]), self.books):
            n = counts[leaf]
            if n:
                met.append(leaf)
                found += n
                if found > options.candidates and len(met) >= options.least_leaves:
                    break
        return met


def _pairs(books: Codebooks, first_half: np.ndarray, second_half: np.ndarray) -> Iterator[int]:
    """All pairs of centroids by rising summed distance from a point, as cells.

    A heap holds the frontier of the two sorted centroid lists; a pair is pushed once
    both its predecessors are out, so no pair is visited twice.
    """
    sorted_ = []
    for half, centroids in ((first_half, books.first), (second_half, books.second)):
        d = ((centroids - half) ** 2).sum(axis=1)
        order = d.argsort(kind="stable")
        sorted_.append((order.tolist(), d[order].tolist()))
    (rows, d1), (cols, d2) = sorted_
    k = books.k
    heap = [(d1[0] + d2[0], 0, 0)]
    reached = [0] * (len(rows) + 1)  # how far each row of the grid is popped
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, a, b = pop(heap)
        yield rows[a] * k + cols[b]
        reached[a] = b + 1
        if a + 1 < len(rows) and reached[a + 1] == b:
            push(heap, (d1[a + 1] + d2[b], a + 1, b))
        if b + 1 < len(cols) and (a == 0 or reached[a - 1] > b + 1):
            push(heap, (d1[a] + d2[b + 1], a, b + 1))


def _tally(spark: SparkSession, reps: DataFrame, index: Index, options: Options) -> tuple[np.ndarray, np.ndarray]:
    """Occupied leaves, rising, and their numbers of vectors; counted in each task first."""
    shared = spark.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(shared.value.leaves(_matrix(batch.column(1), options.dim)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n, pa.int64())], names=["leaf", "n"])

    table = reps.mapInArrow(count, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).orderBy("leaf").toArrow()
    return table.column("leaf").to_numpy(), table.column("n").to_numpy()


def _divide(spark: SparkSession, reps: DataFrame, index: Index, full: dict[int, int], options: Options) -> None:
    """Codebooks for the full cells, each fitted by one task to a sample of its vectors."""
    shared = spark.sparkContext.broadcast((index, {c: max(1, -(-n // options.sample)) for c, n in full.items()}))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, share = shared.value
        for batch in batches:
            cells = held.leaves(_matrix(batch.column(2), options.dim))
            hashes = batch.column(1).to_numpy()
            keep = np.array([c in share and h % share[c] == 0 for c, h in zip(cells.tolist(), hashes.tolist())], bool)
            yield pa.RecordBatch.from_arrays([pa.array(cells[keep], pa.int32()), batch.column(2).filter(pa.array(keep))], names=["cell", "q"])

    def fit(group: pa.Table) -> pa.Table:
        cell = group.column("cell")[0].as_py()
        k = int(min(options.most_centroids, max(2, round((full[cell] / options.per_small_cell) ** 0.5))))
        books = _fitted(_matrix(group.column("q"), options.dim), k, options)
        return pa.table({"cell": pa.array([cell], pa.int32()), "first": [books.first.tobytes()], "second": [books.second.tobytes()]})

    picked = reps.select("id", F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("h"), "q").mapInArrow(pick, "cell int, q binary")
    half = options.dim // 2
    for row in picked.groupBy("cell").applyInArrow(fit, "cell int, first binary, second binary").orderBy("cell").toLocalIterator():
        books = Codebooks(*(np.frombuffer(row[c], np.float32).reshape(-1, half) for c in ("first", "second")))
        index.inner[row["cell"]] = (index.size, books)
        index.size += books.k**2


def _regions(occupied: np.ndarray, counts: np.ndarray, centres: np.ndarray, most: int) -> np.ndarray:
    """The region of each occupied leaf: the leaves are halved by 2-means until they fit."""
    region_of = np.zeros(len(occupied), np.int32)
    todo, regions = [np.arange(len(occupied))] if len(occupied) else [], 0
    while todo:
        rows = todo.pop()
        weight = counts[rows]
        if len(rows) == 1 or weight.sum() <= most:
            region_of[rows] = regions
            regions += 1
            continue
        x = centres[rows]
        axis = x - x.mean(axis=0)
        along = axis @ axis[np.argmax((axis * axis).sum(axis=1))]
        side = along > np.median(along)
        for _ in range(6):
            if side.all() or not side.any():
                break
            a, b = (np.average(x[s], axis=0, weights=weight[s]) for s in (side, ~side))
            side = ((x - a) ** 2).sum(axis=1) < ((x - b) ** 2).sum(axis=1)
        share = weight[side].sum() / weight.sum()
        if not 0.1 < share < 0.9:  # lopsided: halve along the widest axis
            order = np.argsort(along, kind="stable")
            side = np.zeros(len(rows), bool)
            side[order[: max(1, int(np.searchsorted(np.cumsum(weight[order]), weight.sum() / 2)))]] = True
        todo += [rows[side], rows[~side]]
    return region_of


def build_index(reps: DataFrame, options: Options = Options()) -> Index:
    """Codebooks, leaves and regions of a table ``id, q`` of distinct vectors.

    To the driver come the sample, one count per leaf and the codebooks of full cells:
    at most ``most_centroids`` squared leaves and one for every ``per_small_cell``
    vectors of full cells.
    """
    spark = reps.sparkSession
    index = Index(fit_codebooks(reps, reps.count(), options))
    index.size = index.books.k**2
    occupied, n = _tally(spark, reps, index, options)
    for _ in range(options.levels):
        full = {int(c): int(m) for c, m in zip(occupied, n) if m > options.full}
        if not full:
            break
        _divide(spark, reps, index, full, options)
        occupied, n = _tally(spark, reps, index, options)
    index.counts = np.zeros(index.size, np.int64)
    index.counts[occupied] = n
    index.region_of = np.full(index.size, -1, np.int32)
    index.region_of[occupied] = _regions(occupied, n, index.centres(occupied), options.region)
    held = np.bincount(index.region_of[occupied], weights=n, minlength=1).astype(np.int64)
    index.blocks_of = np.maximum(1, -(-held // (2 * options.region))).astype(np.int32)
    return index


# -- scatter and rerank --------------------------------------------------------------

_PLACED = "region int, block int, leaf int, id long, q binary, seek binary"


def _scatter(shared, options: Options):
    """Every vector where it stands, and where it asks with the leaves to be searched there.

    ``leaf`` is -1 where a vector only asks, ``seek`` is empty where it only stands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        names = [c.split()[0] for c in _PLACED.split(", ")]
        for batch in batches:
            x = _matrix(batch.column(1), options.dim)
            rows = []
            for vector, leaf, ident, q in zip(x, index.leaves(x).tolist(), batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                home = int(index.region_of[leaf])
                seeks: dict[int, list[int]] = {}
                for met in index.traverse(vector, options):
                    seeks.setdefault(int(index.region_of[met]), []).append(met)
                for region in {home, *seeks}:
                    blocks = int(index.blocks_of[region])
                    asked = ident % blocks
                    for block in range(blocks) if region == home else (asked,):
                        seek = np.array(seeks.get(region, ()) if block == asked else (), np.int32).tobytes()
                        rows.append((region, block, leaf if region == home else -1, ident, q, seek))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def best_of(x: np.ndarray, y: np.ndarray, x_ids: np.ndarray, y_ids: np.ndarray, k: int, block: int = 1024):
    """For each row of ``x`` the ``k`` rows of ``y`` with the highest product: ids and products.

    Rows with the same id are no neighbours; among equals the lower id goes first. What
    is missing is filled up with products of -2.
    """
    order = np.argsort(y_ids, kind="stable")
    y, y_ids = y[order], y_ids[order]
    ids, values = np.zeros((len(x), k), np.int64), np.full((len(x), k), -2, np.float32)
    most = min(k, len(y))
    for a in range(0, len(x), block):
        s = x[a : a + block] @ y.T
        s[x_ids[a : a + block, None] == y_ids[None, :]] = -2
        if len(y) > 8 * k:
            # All that reach the k-th best product, so that ties are left to the ids.
            least = np.partition(s, len(y) - k, axis=1)[:, len(y) - k, None]
            width = int((s >= least).sum(axis=1).max())
            at = np.sort(np.argpartition(-s, width - 1, axis=1)[:, :width], axis=1)
        else:
            at = np.broadcast_to(np.arange(len(y)), s.shape)
        value = np.take_along_axis(s, at, axis=1)
        rank = np.argsort(-value, axis=1, kind="stable")[:, :most]
        ids[a : a + block, :most] = y_ids[np.take_along_axis(at, rank, axis=1)]
        values[a : a + block, :most] = np.take_along_axis(value, rank, axis=1)
    return ids, values


_NEAR = pa.list_(pa.struct([("d", pa.float64()), ("other", pa.int64())]))


def _lists(ids: np.ndarray, best_ids: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """``id, near``: the ids with what was found for them, best first."""
    real = best > -2
    ends = np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype(np.int32)
    near = pa.StructArray.from_arrays([pa.array(-best[real].astype(np.float64)), pa.array(best_ids[real])], names=["d", "other"])
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(ends), near).cast(_NEAR)], names=["id", "near"])


def _rerank(options: Options):
    """Answers one block of a region: the best of the leaves that each vector seeks in it."""

    def run(group: pa.Table) -> pa.Table:
        leaf, ids = group.column("leaf").to_numpy(), group.column("id").to_numpy()
        x = _matrix(group.column("q"), options.dim)
        stands = np.flatnonzero(leaf >= 0)
        stands = stands[np.argsort(leaf[stands], kind="stable")]
        found, starts = np.unique(leaf[stands], return_index=True)
        rows_of = dict(zip(found.tolist(), np.split(stands, starts[1:])))
        seeks = [np.frombuffer(b, np.int32) for b in group.column("seek").to_pylist()]
        asks = np.flatnonzero([len(s) for s in seeks])
        place = np.full(len(ids), -1)
        place[asks] = np.arange(len(asks))
        who = np.repeat(asks, [len(seeks[i]) for i in asks]) if len(asks) else asks
        what = np.concatenate([seeks[i] for i in asks]) if len(asks) else np.empty(0, np.int32)
        order = np.argsort(what, kind="stable")
        targets, at = np.unique(what[order], return_index=True)
        k = options.k
        best_ids, best = np.zeros((len(asks), k), np.int64), np.full((len(asks), k), -2, np.float32)
        for target, group_rows in zip(targets.tolist(), np.split(who[order], at[1:])):
            base = rows_of.get(target)
            if base is None:
                continue
            got_ids, got = best_of(x[group_rows], x[base], ids[group_rows], ids[base], k)
            mine = place[group_rows]
            both_ids, both = np.concatenate([best_ids[mine], got_ids], axis=1), np.concatenate([best[mine], got], axis=1)
            rank = np.lexsort((both_ids, -both), axis=1)[:, :k]
            best_ids[mine], best[mine] = np.take_along_axis(both_ids, rank, axis=1), np.take_along_axis(both, rank, axis=1)
        return pa.Table.from_batches([_lists(ids[asks], best_ids, best)])

    return run


def _distinct_neighbours(reps: DataFrame, options: Options) -> DataFrame:
    """Neighbours among vectors of which no two are equal."""
    index = build_index(reps, options)
    shared = reps.sparkSession.sparkContext.broadcast(index)
    placed = reps.select("id", "q").mapInArrow(_scatter(shared, options), _PLACED)
    parts = placed.groupBy("region", "block").applyInArrow(_rerank(options), "id long, near array<struct<d:double,other:long>>")
    # A vector has one part for each region it asked in.
    lists = parts.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, options.k).alias("near"))
    return lists.select("id", F.explode("near").alias("e")).select("id", F.col("e.other").alias("other"), (-F.col("e.d")).alias("similarity"))


def neighbours(vectors: DataFrame, options: Options = Options()) -> DataFrame:
    """The ``k`` most similar other vectors of every usable vector of ``id, embedding``.

    ``id, other, similarity``: cosine similarity, approximately the best ones; among
    equals the lower id is taken. Ids must be unique.

    Equal vectors are searched for once: the lowest ids of each class of copies stand
    for it, and results are given back to every copy, so a vector that fills a third
    of the table costs one search.

    Defined results: unusable vectors (see :func:`unit_vectors`) are neither asked for
    nor found; collections of fewer than ``k + 1`` vectors give what there is; an empty
    one gives nothing; other columns may have any name.
    """
    units = cut_lineage(unit_vectors(vectors, options), "units")
    copies = units.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep")).where(F.col("n") > 1)
    marked = units.join(copies, "q", "left")
    reps = cut_lineage(marked.where(F.col("n").isNull() | (F.col("id") == F.col("rep"))).select("id", "q"), "units")
    found = _distinct_neighbours(reps, options)
    member = cut_lineage(marked.where(F.col("n").isNotNull()).select("id", F.col("rep").alias("class")), "copies")
    if member.isEmpty():
        return found
    # The k + 1 lowest ids of each class suffice; the limit is applied before the shuffle.
    low = member.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("r") <= options.k + 1)
    low = low.groupBy("class").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    wide = (
        found.join(low.select(F.col("class").alias("other"), "ids"), "other", "left")
        .select("id", F.explode(F.coalesce("ids", F.array("other"))).alias("other"), "similarity")
        .unionByName(low.select(F.col("class").alias("id"), F.explode("ids").alias("other"), F.lit(1.0).alias("similarity")))
    )
    best = F.struct((-F.col("similarity")).alias("d"), F.col("other"))
    lists = (
        wide.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.col("similarity").desc(), "other")))
        .where(F.col("r") <= 2 * options.k + 2)
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(best)).alias("list"))
    )
    asking = member.select(F.col("id").alias("asker"), F.col("class").alias("id"))
    each = lists.join(asking, "id", "left").select(F.coalesce("asker", "id").alias("id"), "list")
    own = F.slice(F.filter("list", lambda e: e["other"] != F.col("id")), 1, options.k)
    return each.select("id", F.explode(own).alias("e")).select("id", F.col("e.other").alias("other"), (-F.col("e.d")).alias("similarity"))


def exact(asked: DataFrame, units: DataFrame, options: Options = Options(), block: int = 2000) -> DataFrame:
    """The true ``k`` best of the vectors ``asked`` (``id, q``) among ``units``, for measuring recall.

    The vectors that ask are sent block by block to where the others are; every task keeps
    the best it has and only these are shuffled.
    """
    kind = "id long, near array<struct<d:double,other:long>>"
    out = None
    blocks = max(1, -(-asked.count() // block))
    for n in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).select("id", "q").toArrow()
        shared = asked.sparkSession.sparkContext.broadcast((mine.column("id").to_numpy(), _matrix(mine.column("q"), options.dim)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, x = shared.value
            best_ids, best = np.zeros((len(ids), options.k), np.int64), np.full((len(ids), options.k), -2, np.float32)
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                got_ids, got = best_of(x, _matrix(batch.column(1), options.dim), ids, batch.column(0).to_numpy(), options.k)
                both_ids, both = np.concatenate([best_ids, got_ids], axis=1), np.concatenate([best, got], axis=1)
                rank = np.lexsort((both_ids, -both), axis=1)[:, : options.k]
                best_ids, best = np.take_along_axis(both_ids, rank, axis=1), np.take_along_axis(both, rank, axis=1)
            yield _lists(ids, best_ids, best)

        part = units.select("id", "q").mapInArrow(run, kind)
        out = part if out is None else out.unionByName(part)
    lists = out.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, options.k).alias("near"))
    return lists.select("id", F.explode("near").alias("e")).select("id", F.col("e.other").alias("other"), (-F.col("e.d")).alias("similarity"))


def pairs(found: DataFrame) -> DataFrame:
    """``id_a < id_b``: pairs in which either is among the neighbours of the other."""
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
