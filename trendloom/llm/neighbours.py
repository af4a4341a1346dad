"""Nearest neighbours by an inverted multi-index: rows shuffled by cell once, queries sent to the cells they need."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.llm.common import drawn
from trendloom.plans.scratch import Scratch

#: Vectors that the centroids are fitted on at most, about; rows of a cell on average; centroids of either half at most, which bounds the cells.
SAMPLE, CELL_ROWS, CENTROIDS = 16_384, 256, 256
#: Rows of one block of a cell, about; queries that are held against a block in one go; rows that a query's first cells hold at least.
ROWS, QUERIES, RERANK = 8192, 256, 2048
#: Pairs whose exact distance is taken in one go; relative error allowed for in bounds.
_PAIRS_AT_ONCE, _SLACK = 1 << 16, 1e-9


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null, not zero, no null and no non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, seed: int = 3, steps: int = 12) -> np.ndarray:
    """At most k centroids of the rows of x; fewer if x has fewer rows."""
    rng = np.random.default_rng(seed)
    if not len(x):
        return np.zeros((1, x.shape[1]))
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return squared(x, c).argmin(1)


class MultiIndex:
    """Centroids of the two halves of a vector and, for each pair of them (a cell), its rows' number and distances to the two.

    Picklable and bounded: at most CENTROIDS**2 cells.
    """

    def __init__(self, books: tuple[np.ndarray, np.ndarray]):
        self.books, self.h = books, books[0].shape[1]
        cells = len(books[0]) * len(books[1])
        self.rows, self.first = np.zeros(cells, dtype=np.int64), np.zeros(cells + 1, dtype=np.int64)
        self.least, self.most = np.zeros((2, cells)), np.zeros((2, cells))

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row's halves to the centroids."""
        parts = (x[:, : self.h], self.books[0]), (x[:, self.h :], self.books[1])
        return tuple(np.sqrt(np.maximum(squared(p, c), 0)) for p, c in parts)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell of each row and its distances to the two centroids."""
        a, b = self.distances(x)
        i, j = a.argmin(1), b.argmin(1)
        at = np.arange(len(x))
        return i * len(self.books[1]) + j, a[at, i], b[at, j]

    def describe(self, cell: np.ndarray, rows: np.ndarray, least: np.ndarray, most: np.ndarray, block_rows: int) -> None:
        """Takes in the cells' statistics; a cell has a block for each ``block_rows`` rows begun."""
        self.rows[cell], self.least[:, cell], self.most[:, cell] = rows, least, most
        self.first = np.append(0, np.cumsum(-(-self.rows // block_rows)))

    def blocks(self, cells: np.ndarray) -> np.ndarray:
        """The blocks of the cells."""
        return np.concatenate([np.arange(self.first[c], self.first[c + 1]) for c in cells]) if len(cells) else np.zeros(0, dtype=np.int64)

    def nearest_cells(self, a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
        """The cells with the smallest summed squared distances to a query's halves, until they hold ``rows`` rows.

        Pairs of centroids come off a heap in that order: a pair is followed by its neighbours
        in the two orders of centroids.
        """
        a, b = a * a, b * b
        order = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        x, y = a[order[0]], b[order[1]]
        heap, out, held = [(float(x[0] + y[0]), 0, 0)], [], 0
        while heap and held < rows:
            _, i, j = heapq.heappop(heap)
            if j + 1 < len(y):
                heapq.heappush(heap, (float(x[i] + y[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(x):
                heapq.heappush(heap, (float(x[i + 1] + y[0]), i + 1, 0))
            cell = int(order[0][i] * len(y) + order[1][j])
            if self.rows[cell]:
                out.append(cell)
                held += int(self.rows[cell])
        return np.array(out, dtype=np.int64)

    def cells_within(self, a: np.ndarray, b: np.ndarray, worst: float, scale: float) -> np.ndarray:
        """The cells that may hold a row at most ``worst`` away: no row is nearer than its distances to the two centroids tell."""
        d = np.stack([np.repeat(a, len(b)), np.tile(b, len(a))])
        low = np.maximum(np.maximum(d - self.most, self.least - d), 0)
        bound = (low * low).sum(0)
        return np.flatnonzero((self.rows > 0) & ~(bound * (1 - _SLACK) - _SLACK * scale > worst * worst))

    def scale(self) -> float:
        """A bound of the rows' squared lengths, for tolerances."""
        some = self.rows > 0
        reach = [np.linalg.norm(c, axis=1).max(initial=0) + m[some].max(initial=0) for c, m in zip(self.books, self.most, strict=True)]
        return float(reach[0] ** 2 + reach[1] ** 2)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def rerank(ids: np.ndarray, x: np.ndarray, own: np.ndarray, q: np.ndarray, worst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance): of each query the k nearest rows of the block at most ``worst`` away, ties by id; rows with the query's id are left out."""
    norm, q_norm = (x * x).sum(1), (q * q).sum(1)
    near = norm + q_norm[:, None] - 2 * q @ x.T
    near[np.isnan(near)] = -np.inf  # beyond the range of squares: decided exactly
    other = own[:, None] != ids
    near[~other] = np.inf
    limit = np.minimum(np.partition(near, k - 1, axis=1)[:, k - 1] if x.shape[0] >= k else np.inf, worst * worst)
    i, j = np.nonzero((near <= (limit + _SLACK * (q_norm + norm.max(initial=0)))[:, None]) & other)
    # Terms are added one after the other, so that any engine that does the same agrees to the last bit.
    parts = [np.sqrt(np.cumsum((x[j[at : at + _PAIRS_AT_ONCE]] - q[i[at : at + _PAIRS_AT_ONCE]]) ** 2, axis=1)[:, -1]) for at in range(0, len(i), _PAIRS_AT_ONCE)]
    exact = np.concatenate(parts) if parts else np.zeros(0)
    order = np.lexsort((ids[j], exact, i))
    i, j, exact = i[order], j[order], exact[order]
    first = np.searchsorted(i, i, side="left")
    kept = np.arange(len(i)) - first < k
    return i[kept], j[kept], exact[kept]


def fit_books(vectors: DataFrame, rows: int, sample: int | None = None, seed: int = 23) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of the two halves, fitted on about ``sample`` of ``rows`` vectors by seeded hash of the id."""
    sample = sample or SAMPLE
    t = vectors.where(drawn("vec_id", sample / max(1, rows), seed)).orderBy("vec_id").select("v").toArrow()
    x = np.array(t["v"].to_pylist(), dtype=float) if t.num_rows else np.zeros((0, 2))
    h, k = x.shape[1] // 2, int(min(CENTROIDS, max(2, np.ceil(np.sqrt(rows / CELL_ROWS)))))
    return kmeans(x[:, :h], k), kmeans(x[:, h:], k)


def distinct_rows(rows: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """rows (vec_id, v) less repeats of both, and of equal vectors those of the k + 1 smallest ids.

    No query needs more of them: the others come after k ids that are nearer to its own place
    in the order. Only vectors that occur twice are sorted, after a limit in each task, so a
    vector that a third of all rows repeat is no hot group.
    """
    keyed = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64("v", F.lit(77))})
    repeated = scratch.save(keyed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2"), "repeated")
    if repeated.isEmpty():
        return rows
    w = Window.partitionBy("h1", "h2").orderBy("vec_id")
    some = keyed.join(repeated, ["h1", "h2"], "left_semi").withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= k + 1)
    some = some.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2", "vec_id").orderBy("r"))).where("n = 1")
    return keyed.join(repeated, ["h1", "h2"], "left_anti").select("vec_id", "v").union(some.select("vec_id", "v"))


def build(rows: DataFrame, scratch: Scratch) -> tuple[MultiIndex, DataFrame, int]:
    """The index of rows (vec_id, v), their table (vec_id, v, block) and the length of a vector."""
    vectors = scratch.save(rows, "vectors")
    n = vectors.count()
    d = vectors.limit(1).select(F.size("v")).first()
    d = d[0] if d else 2
    index = MultiIndex(fit_books(vectors, n))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, da, db = index.assign(_matrix(b.column("v"), d))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(da), pa.array(db)], names=["vec_id", "v", "cell", "da", "db"])

    coded = scratch.save(vectors.mapInArrow(assign, "vec_id long, v array<double>, cell int, da double, db double"), "coded")
    stats = coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f.__name__ + c) for f in (F.min, F.max) for c in ("da", "db")]).orderBy("cell").toPandas()
    index.describe(stats["cell"].to_numpy(), stats["n"].to_numpy(), stats[["minda", "mindb"]].to_numpy().T, stats[["maxda", "maxdb"]].to_numpy().T, ROWS)
    stats["first"] = index.first[stats["cell"].to_numpy()]
    stats["blocks"] = index.first[stats["cell"].to_numpy() + 1] - stats["first"]
    places = rows.sparkSession.createDataFrame(stats[["cell", "first", "blocks"]].values.tolist(), "cell int, first long, blocks long")
    block = F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("blocks"))
    return index, coded.join(F.broadcast(places), "cell").select("vec_id", "v", block.alias("block")), d


def _held_against(rows: DataFrame, queries: DataFrame, k: int, d: int) -> DataFrame:
    """(query_id, vec_id, score): rows (vec_id, v, block) nearest to queries (query_id, v, worst, block) of their block.

    Rows and queries of a block meet in one task, rows first; a task holds one block's rows,
    while its queries stream by.
    """
    at_once = QUERIES
    both = rows.select("block", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "v", F.lit(None).cast("double").alias("worst"))
    both = both.join(queries.select("block").distinct(), "block", "left_semi")
    both = both.union(queries.select("block", F.lit(1), "query_id", "v", "worst"))
    both = both.repartition("block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, block = None, [], None
        for b in batches:
            key = b.column("block").to_numpy() * 2 + b.column("kind").to_numpy()
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=int)
            for start, end in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
                part = b.slice(int(start), int(end - start))
                ids, x = part.column("id").to_numpy(), _matrix(part.column("v"), d)
                if key[start] // 2 != current:
                    current, held, block = key[start] // 2, [], None
                if key[start] % 2 == 0:
                    held.append((ids, x))
                    continue
                if block is None and held:
                    block, held = tuple(np.concatenate(c) for c in zip(*held, strict=True)), []
                if block is None:
                    continue
                worst = part.column("worst").to_numpy(zero_copy_only=False)
                for at in range(0, len(ids), at_once):
                    own = ids[at : at + at_once]
                    i, j, score = rerank(*block, own, x[at : at + at_once], worst[at : at + at_once], k)
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(own[i]), "vec_id": pa.array(block[0][j]), "score": pa.array(score)})

    return both.mapInArrow(run, "query_id long, vec_id long, score double")


def search(embeddings: DataFrame, every: int = 100, k: int = 10, exact: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query, a row whose vec_id is divisible by ``every``.

    Rows are assigned to cells, a pair of centroids each, and shuffled by cell; large cells by
    blocks of about ROWS rows. A query goes first to the cells that come off the heap until
    they hold RERANK rows. With ``exact`` it then goes to those other cells too that its k-th
    distance so far doesn't rule out, which are few where vectors cluster and most where
    they don't; so recall is 1. Without, the first cells decide alone. Rows are never copied;
    queries are, once for each block that they visit.

    Unusable vectors (see usable()), rows without vec_id, and vectors of another length than
    the most frequent take no part. Rows that repeat vec_id and vector count once; rows that
    repeat a vec_id with other vectors are candidates and queries each, their results merged by
    query_id. Ties go to the smaller vec_id; other columns are ignored whatever their names; an
    empty table gives an empty one.
    """
    scratch = Scratch(embeddings.sparkSession, "neighbours")
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = embeddings.where(F.col("vec_id").isNotNull() & usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (sizes["n"] if sizes else 0))
    index, coded, d = build(distinct_rows(rows, k, scratch), scratch)
    queries = scratch.save(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").distinct(), "queries")
    probe, scale = RERANK, index.scale()

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, out = _matrix(b.column("v"), d), []
            again = "worst" in b.schema.names
            worst = b.column("worst").to_numpy(zero_copy_only=False) if again else np.full(len(x), np.inf)
            norm = (x * x).sum(1)
            for i, (da, db) in enumerate(zip(*index.distances(x), strict=True)):
                cells = index.nearest_cells(da, db, probe)
                if again:
                    cells = np.setdiff1d(index.cells_within(da, db, worst[i], scale + norm[i]), cells)
                out.append(index.blocks(cells))
            yield pa.RecordBatch.from_pydict({"query_id": b.column("query_id"), "v": b.column("v"), "worst": pa.array(worst), "blocks": pa.array(out, pa.list_(pa.int64()))})

    def sent(q: DataFrame) -> DataFrame:
        return q.mapInArrow(visits, "query_id long, v array<double>, worst double, blocks array<long>").select("query_id", "v", "worst", F.explode("blocks").alias("block"))

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    found = scratch.save(_held_against(coded, scratch.save(sent(queries), "sent"), k, d), "near")
    if exact:
        best = found.distinct().withColumn("rank", rank).where(F.col("rank") == k).select("query_id", F.col("score").alias("worst"))
        further = scratch.save(sent(queries.join(best, "query_id", "left").select("query_id", "v", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))), "further")
        found = found.union(_held_against(coded, further, k, d))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
