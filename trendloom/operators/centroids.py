"""Vector operators: group means, nearest groups, reassignment of outliers, merging, drift, silhouette."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.functions.vectors import EPS, clip, cosine_distance, dot, unit
from trendloom.plans.scratch import Scratch

#: Rows x components of a matrix that is broadcast at once; larger tables come in parts of that size, one after the other.
MATRIX_CELLS = 20_000_000

#: Rows and matrix columns that are multiplied at once, so what a worker holds doesn't grow with either.
BLOCK_ROWS, BLOCK_COLUMNS = 256, 8192


def centroids(docs: DataFrame, by: list[str], least: int = 1, normalise: bool = False, vector: str = "embedding") -> DataFrame:
    """A3: (by..., n, centroid): unit mean of the vectors of each group of ``least`` rows or more.

    Means are taken of raw vectors, or of unit vectors with ``normalise``, by an aggregate
    with map-side partials.
    """
    v = unit(vector) if normalise else F.transform(vector, lambda x: x.cast("double"))
    rows = docs.where(F.col(vector).isNotNull()).select(*by, array_to_vector(v).alias("_v"))
    means = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("_v")).alias("_m")).where(F.col("n") >= least)
    return means.select(*by, "n", unit(vector_to_array("_m")).alias("centroid"))


def _parts(table: DataFrame, key: str, vector: str) -> Iterator[pa.Table]:
    """A table's rows on the driver, MATRIX_CELLS cells at a time, about, by hash of the key; none if it is empty."""
    size = table.agg(F.count(F.lit(1)).alias("k"), F.max(F.size(vector)).alias("d")).first()
    n = min(size["k"], -(-size["k"] * max(1, size["d"] or 0) // max(1, MATRIX_CELLS)))
    for i in range(n):
        part = (table.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) if n > 1 else table).orderBy(key).toArrow()
        if part.num_rows:
            yield part


def _rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as a matrix; null components are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    sizes = pc.list_value_length(column)
    if column.null_count or pc.min(sizes) != pc.max(sizes):
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    x = _rows(column)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), EPS)


def _blocks(x: np.ndarray, m: np.ndarray, m32: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, column, products) of x @ m.T in single precision, BLOCK_ROWS x BLOCK_COLUMNS at a time, all columns of a row one after the other."""
    x32 = x.astype(np.float32)
    for at in range(0, len(x), BLOCK_ROWS):
        for c in range(0, len(m), BLOCK_COLUMNS):
            yield at, c, x32[at : at + BLOCK_ROWS] @ m32[c : c + BLOCK_COLUMNS].T


def _slack(m: np.ndarray) -> float:
    """What single precision and rounding may take from a product of two unit vectors of m's length, and more."""
    return 1.2e-7 * (m.shape[1] + 16) + 1e-9


def _exact(x: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of rows i of x and j of m in double precision, to 9 places."""
    return np.concatenate([np.zeros(0), *(np.round((x[i[a : a + 65536]] * m[j[a : a + 65536]]).sum(1), 9) for a in range(0, len(i), 65536))])


def _nearest(x: np.ndarray, m: np.ndarray, m32: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and cosines of the k nearest rows of m to each row of x, all if m has fewer, ties to the smaller number; NaN comes last.

    Block by block, what single precision can't rule out against the k-th so far is worked out exactly.
    """
    k, slack = min(k, len(m)), _slack(m)
    number, sim = np.zeros((len(x), k), dtype=np.int64), np.full((len(x), k), np.nan)
    odd = bool(np.isnan(x).any() or np.isnan(m).any())
    for at, c, s in _blocks(x, m, m32):
        n = len(s)
        if odd:
            s = np.where(np.isnan(s), -np.inf, s)
        if c == 0:
            best, have, own = np.zeros((n, 0), dtype=np.int64), np.zeros((n, 0)), x[at : at + n]
        if have.shape[1] < k:  # the first blocks of few columns: any may be among the k
            width = min(k, s.shape[1])
            low = np.partition(s, s.shape[1] - width, axis=1)[:, s.shape[1] - width] - 2 * slack
            i, j = np.nonzero(s >= low[:, None])
        else:
            i, j = np.nonzero(s > np.where(np.isneginf(have[:, -1]), -np.inf, have[:, -1] - slack)[:, None])
        if len(i):
            v = _exact(own, m, i, j + c)
            v = np.where(np.isnan(v), -np.inf, v)
            row = np.concatenate([np.repeat(np.arange(n), have.shape[1]), i])
            num, v = np.concatenate([best.ravel(), j + c]), np.concatenate([have.ravel(), v])
            order = np.lexsort((num, -v, row))
            row, num, v = row[order], num[order], v[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < min(k, have.shape[1] + s.shape[1])
            best, have = num[keep].reshape(n, -1), v[keep].reshape(n, -1)
        if c + s.shape[1] == len(m):
            number[at : at + n], sim[at : at + n] = best, np.where(np.isneginf(have), np.nan, have)
    return number, sim


def _first_of_equal(m: np.ndarray, k: int) -> np.ndarray:
    """The rows of m that are among the first k of those equal to them, in order; later ones are among no k nearest."""
    m = np.ascontiguousarray(m)
    _, same = np.unique(m.view(np.dtype((np.void, m.itemsize * m.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    return np.sort(order[np.arange(len(m)) - np.searchsorted(same[order], same[order]) < k])


def _near(x: np.ndarray, m: np.ndarray, m32: np.ndarray, sim: float, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, cosine) of the products of ``sim`` or more, block by block, of those that wanted(row, column) says."""
    low = sim - _slack(m)
    for at, c, s in _blocks(x, m, m32):
        i, j = np.nonzero(s >= low)
        i, j = i + at, j + c
        ok = wanted(i, j)
        i, j = i[ok], j[ok]
        v = _exact(x, m, i, j)
        yield i[v >= sim], j[v >= sim], v[v >= sim]


def _bounded(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    """The batches, none of them empty, in slices whose product with a matrix of so many columns is no larger than a block."""
    step = max(1, BLOCK_ROWS * BLOCK_COLUMNS // max(1, columns))
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def _dealt(rows: DataFrame) -> DataFrame:
    """rows over all cores: each meets a whole matrix, so a small file, one task's otherwise, is much work."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def _schema(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def top_two(docs: DataFrame, cents: DataFrame, keep: list[str], vector: str = "embedding", single_margin: float = 1.0) -> DataFrame:
    """(keep..., best_topic, best_sim, second_sim, margin) of each row with a vector, ties to the smaller topic.

    Rows are multiplied by a broadcast matrix of centroids. Where that would have more than
    MATRIX_CELLS cells it comes in parts, and the two best so far go along with the rows,
    written in between; so rows are never shuffled, and each is returned as often as it comes.
    With one centroid there is no second, and the margin is ``single_margin``.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "top-two")
    none = F.lit(None).cast("double")
    rows = docs.where(F.col(vector).isNotNull()).select(*keep, F.col(vector).alias("_v"), F.lit(None).cast("int").alias("best_topic"), none.alias("best_sim"), none.alias("second_sim"))
    names = [*keep, "_v", "best_topic", "best_sim", "second_sim"]
    schema = _schema(rows, names)
    cents = scratch.save(cents.select("topic", "centroid"), "centroids")
    before = 0
    for part in _parts(cents, "topic", "centroid"):
        shared = spark.sparkContext.broadcast((part["topic"].to_numpy().astype(np.int64), _rows(part["centroid"])))
        if before:
            rows = scratch.save(rows, "so-far")
        before += part.num_rows

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            topics, m = shared.value
            for b in _bounded(batches, len(m)):
                best, sim, second = (b.column(len(keep) + k).to_numpy(zero_copy_only=False).astype(float) for k in (1, 2, 3))
                at = np.arange(b.num_rows)
                s = np.round(_unit_rows(b.column(len(keep))) @ m.T, 12)
                first = s.argmax(1)  # topics are in order, so the smallest of equals
                top = s[at, first]
                s[at, first] = -np.inf
                rest = s.max(1) if len(topics) > 1 else np.full(len(s), np.nan)
                wins = np.isnan(sim) | (top > sim) | ((top == sim) & (topics[first] < best))
                second = np.fmax(np.where(wins, sim, top), np.fmax(second, rest))
                best, sim = np.where(wins, topics[first], best), np.where(wins, top, sim)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep) + 1], pa.array(best.astype(np.int32)), pa.array(sim), pa.array(second, from_pandas=True)], names)

        rows = rows.mapInArrow(score, schema)
    return rows.drop("_v").withColumn("margin", F.when(F.col("best_topic").isNotNull(), F.coalesce(F.col("best_sim") - F.col("second_sim"), F.lit(single_margin))))


def top_k(docs: DataFrame, labels: DataFrame, k: int, doc: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """(doc, label columns, sim, rank) of the k nearest rows of labels (..., embedding) to each row with a vector, ties by the label columns.

    As top_two(), but dealt over all cores: rows carry the numbers of their k best labels so far
    past the parts of the labels' matrix, and only then meet the labels' columns, by number.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "top-k")
    names = [c for c in labels.columns if c != "embedding"]
    ordered = labels.where(F.col("embedding").isNotNull())
    ordered = ordered.repartitionByRange(*names).sortWithinPartitions(*names) if names else ordered
    numbered = scratch.save(ordered.withColumn("_i", F.monotonically_increasing_id()), "labels")
    rows = _dealt(docs.where(F.col(vector).isNotNull()).select(doc, F.col(vector).alias("_v"))).select(doc, "_v", F.array().cast("array<long>").alias("_n"), F.array().cast("array<double>").alias("_s"))
    schema, first = _schema(rows, [doc, "_v", "_n", "_s"]), True
    for part in _parts(numbered.select("_i", "embedding"), "_i", "embedding") if k > 0 else ():
        m = _unit_rows(part["embedding"])
        some = _first_of_equal(m, k)
        shared = spark.sparkContext.broadcast((part["_i"].to_numpy()[some], m[some]))
        if not first:
            rows = scratch.save(rows, "so-far")
        first = False

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, m = shared.value
            m32 = m.astype(np.float32)
            for b in batches:
                if not b.num_rows:
                    continue
                best, sim = _nearest(_unit_rows(b.column(1)), m, m32, k)
                number = ids[best]
                if len(b.column(2).values):  # all rows have as many so far
                    number = np.hstack([b.column(2).values.to_numpy().reshape(b.num_rows, -1), number])
                    sim = np.hstack([b.column(3).values.to_numpy().reshape(b.num_rows, -1), sim])
                    order = np.lexsort((number, -sim), axis=1)[:, :k]
                    number, sim = np.take_along_axis(number, order, axis=1), np.take_along_axis(sim, order, axis=1)
                lists = [pa.array(list(x), t) for x, t in ((number, pa.list_(pa.int64())), (sim, pa.list_(pa.float64())))]
                yield pa.RecordBatch.from_arrays([*b.columns[:2], *lists], [doc, "_v", "_n", "_s"])

        rows = rows.mapInArrow(score, schema)
    each = rows.select(doc, F.posexplode(F.arrays_zip("_n", "_s")).alias("_p", "_x")).select(doc, F.col("_x._n").alias("_i"), F.col("_x._s").alias("sim"), (F.col("_p") + 1).alias("rank"))
    return each.join(numbered.drop("embedding"), "_i").select(doc, *names, "sim", "rank")


def quantile(df: DataFrame, column: str, q: float) -> float | None:
    """Exact, interpolated."""
    return df.agg(F.percentile(column, q)).first()[0]


def gate_threshold(docs: DataFrame, gate: tuple[float, float], auto_quantile: float | None) -> tuple[float, float]:
    """The gate (similarity, entropy), its entropy that quantile among outliers of that similarity where one is given and there are any."""
    if auto_quantile is None:
        return gate
    return gate[0], quantile(docs.where((F.col("topic") == -1) & (F.col("cso_top1_sim") >= gate[0]) & F.col("entropy").isNotNull()), "entropy", min(max(auto_quantile, 0.0), 1.0)) or gate[1]


def reassign(
    docs: DataFrame, sim: float = 0.65, margin: float = 0.0, auto_quantile: float | None = None, gate: tuple[float, float] | None = None, least: int = 2, most: int = 0, gate_quantile: float | None = None
) -> DataFrame:
    """M6: docs (doc_id, topic, embedding, ...) with outliers given to the nearest centroid that is near and clear enough.

    Centroids are of topics of ``least`` documents. An outlier (-1) moves if its best cosine is
    ``sim`` or more and its margin to the second is ``margin`` or more; with ``auto_quantile``
    the margin is that quantile among outliers near enough. ``gate`` (similarity, entropy)
    protects documents whose cso_top1_sim reaches the one and whose entropy is no more than the
    other, or than the quantile ``gate_quantile`` of such outliers' entropies. With ``most``
    above 0, only the first so many outliers by doc_id are looked at (L1). Assigned rows never
    change. Adds old_topic, similarity_score, similarity_margin, assignment_source and
    assignment_confidence; where docs has the last two, rows that don't move keep theirs.
    """
    cents = centroids(docs.where("topic <> -1"), ["topic"], least)
    scored = top_two(first_outliers(docs, most), cents, ["doc_id"])
    near = F.col("best_sim") >= sim
    if auto_quantile is not None:
        margin = max(quantile(scored.where(near), "margin", min(max(auto_quantile, 0.0), 1.0)) or 0.0, 0.0)
    moves = scored.where(near & (F.col("margin") >= margin))
    if gate is not None:
        low, high = gate_threshold(docs, gate, gate_quantile)
        safe = docs.where((F.col("cso_top1_sim") >= low) & (F.col("entropy") <= high)).select("doc_id")
        moves = moves.join(safe, "doc_id", "left_anti")
    out = docs.join(moves.select("doc_id", "best_topic", "best_sim", F.col("margin").alias("_margin")), "doc_id", "left")
    moved = F.col("best_topic").isNotNull() & (F.col("topic") == -1)
    sure = clip(F.col("best_sim") * F.least(F.lit(1.0), F.col("_margin") / (margin + EPS)), 0.0, 1.0)
    source = F.when(F.col("topic") == -1, "outlier").otherwise(F.coalesce(F.when(F.col("assignment_source") != "outlier", F.col("assignment_source")), F.lit("model")) if "assignment_source" in docs.columns else F.lit("model"))
    before = F.col("assignment_confidence") if "assignment_confidence" in docs.columns else F.lit(None).cast("double")
    return out.withColumns({
        "old_topic": F.col("topic"), "similarity_score": F.when(moved, F.col("best_sim")), "similarity_margin": F.when(moved, F.col("_margin")),
        "assignment_source": F.when(moved, "centroid").otherwise(source), "assignment_confidence": F.when(moved, sure).otherwise(before),
        "topic": F.when(moved, F.col("best_topic")).otherwise(F.col("topic")),
    }).drop("best_topic", "best_sim", "_margin")


def first_outliers(docs: DataFrame, most: int = 0) -> DataFrame:
    """L1: the outliers, or the first ``most`` of them by doc_id."""
    rows = docs.where("topic = -1")
    return rows.orderBy("doc_id").limit(most) if most > 0 else rows


def sweep(docs: DataFrame, sims: list[float], margins: list[float], least: int = 1, most: int = 0) -> DataFrame:
    """Q21: what reassignment would do for each pair of thresholds, from one scoring of the outliers.

    Centroids are of unit vectors. A cell without reassignment has null figures and an empty
    list of targets.
    """
    spark = docs.sparkSession
    cents = centroids(docs.where("topic <> -1"), ["topic"], least, normalise=True)
    scored = top_two(first_outliers(docs, most), cents, ["doc_id"], single_margin=float("inf"))
    counts = docs.agg(F.count(F.lit(1)).alias("N"), F.count_if(F.col("topic") == -1).alias("n_outliers_in"))
    grid = spark.createDataFrame([(a, b) for a in sims for b in margins], "tau_sim double, tau_mar double")
    hits = scored.join(F.broadcast(grid), (F.col("best_sim") >= F.col("tau_sim")) & (F.col("margin") >= F.col("tau_mar")))
    by = hits.groupBy("tau_sim", "tau_mar").agg(
        F.count(F.lit(1)).alias("n_reassigned"), F.avg("best_sim").alias("mean_best_sim"), F.median("best_sim").alias("median_best_sim"), F.percentile("best_sim", 0.9).alias("p90_best_sim"),
        F.avg("margin").alias("mean_margin"), F.median("margin").alias("median_margin"), F.percentile("margin", 0.9).alias("p90_margin"),
    )
    each = hits.groupBy("tau_sim", "tau_mar", "best_topic").agg(F.count(F.lit(1)).alias("n"))
    top = each.groupBy("tau_sim", "tau_mar").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "best_topic"))).alias("t"))
    named = F.array_join(F.transform(F.slice("t", 1, 5), lambda x: F.concat(x["best_topic"].cast("string"), F.lit(":"), (-x["m"]).cast("string"))), ";")
    out = grid.join(by, ["tau_sim", "tau_mar"], "left").join(top.select("tau_sim", "tau_mar", named.alias("top5_target_topics")), ["tau_sim", "tau_mar"], "left").join(F.broadcast(counts), F.lit(True))
    n = F.coalesce("n_reassigned", F.lit(0))
    return out.withColumns({
        "n_reassigned": n, "n_outliers_out": F.col("n_outliers_in") - n, "coverage_base": 1 - F.col("n_outliers_in") / F.col("N"),
        "coverage_after": 1 - (F.col("n_outliers_in") - n) / F.col("N"), "delta_coverage": n / F.col("N"), "top5_target_topics": F.coalesce("top5_target_topics", F.lit("")),
    })


def certainty(docs: DataFrame, least: int = 3) -> DataFrame:
    """Q15: mean cosine of assigned documents to their own centroid, over topics of ``least`` documents."""
    own = docs.where("topic <> -1")
    joined = own.join(centroids(own, ["topic"], least), "topic")
    return joined.agg(F.avg(dot(unit("embedding"), "centroid")).alias("certainty"), F.count(F.lit(1)).alias("docs"))


def topic_spread(docs: DataFrame) -> DataFrame:
    """A4: (topic, n, mean_sim, std_sim): cosines of documents to their own centroid."""
    own = docs.where("topic <> -1")
    joined = own.join(centroids(own, ["topic"]), "topic").withColumn("sim", dot(unit("embedding"), "centroid"))
    return joined.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.avg("sim").alias("mean_sim"), F.stddev_pop("sim").alias("std_sim"))


def silhouette(docs: DataFrame) -> DataFrame:
    """Q14: mean silhouette by cosine distance, exact, without pairs.

    A document's mean distance to a group is 1 less its product with the group's sum of unit
    vectors over its size, so sums by topic are all that is needed; they come as top_two()'s
    centroids do. A topic of one document counts 0; without two topics the table is empty.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "silhouette")
    own = docs.where((F.col("topic") != -1) & F.col("embedding").isNotNull()).select("topic", unit("embedding").alias("u"))
    sums = own.select("topic", array_to_vector("u").alias("v")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), Summarizer.sum(F.col("v")).alias("s"))
    sums = scratch.save(sums.select("topic", "n", vector_to_array("s").alias("s")), "sums")
    none = F.lit(None).cast("double")
    rows, first = own.select("topic", "u", none.alias("a"), none.alias("b")), True
    schema = _schema(rows, rows.columns)
    for part in _parts(sums, "topic", "s") if sums.count() >= 2 else ():
        shared = spark.sparkContext.broadcast((part["topic"].to_numpy(), part["n"].to_numpy(), _rows(part["s"])))
        if not first:
            rows = scratch.save(rows, "so-far")
        first = False

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            topics, n, s = shared.value
            for batch in _bounded(batches, len(s)):
                a, b = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (2, 3))
                u = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, -1)
                away = n - u @ s.T  # summed distances to each group
                mine = topics == batch.column(0).to_numpy()[:, None]
                i, j = np.nonzero(mine)
                a[i] = np.where(n[j] == 1, np.nan, away[i, j] / np.maximum(n[j] - 1, 1))
                b = np.fmin(b, np.where(mine, np.inf, away / n).min(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(a), pa.array(b)], ["topic", "u", "a", "b"])

        rows = rows.mapInArrow(score, schema)
    s = F.when(F.isnan("a"), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(EPS)))
    return rows.where("b is not null").agg(F.avg(s).alias("silhouette"), F.count(F.lit(1)).alias("docs")).where("docs > 0")


def drift(docs: DataFrame, least: int = 5, consecutive: bool = False, by_gap: bool = False) -> DataFrame:
    """Q9: a row for each topic with two years or more: how far its centroid moves.

    Centroids by topic and year of ``least`` documents; distances between successive years,
    over the years between them with ``by_gap`` (drift_mode per_year, else raw_step), and only
    between neighbouring years with ``consecutive``. The robust score is the mean step times
    ln(steps + 2); the columns named raw are of distances not divided; missing_emb_rate is the
    share of a topic's documents without a vector.
    """
    own = docs.where("topic <> -1")
    cents = centroids(own, ["topic", "year"], least)
    w = Window.partitionBy("topic").orderBy("year")
    used = Window.partitionBy("topic")
    steps = cents.select(
        "topic", "year", "centroid", F.lag("centroid").over(w).alias("p"), F.lag("year").over(w).alias("y0"),
        F.count(F.lit(1)).over(used).cast("int").alias("years"), F.min("year").over(used).alias("first_year"), F.max("year").over(used).alias("last_year"),
    ).where("p is not null")
    if consecutive:
        steps = steps.where("year - y0 = 1")
    gap = (F.col("year") - F.col("y0")).cast("double")
    steps = steps.select("topic", "years", "first_year", "last_year", gap.alias("gap"), cosine_distance("centroid", "p").alias("raw"))
    steps = steps.withColumn("step", F.col("raw") / F.col("gap") if by_gap else F.col("raw"))
    out = steps.groupBy("topic", "years", "first_year", "last_year").agg(
        (F.count(F.lit(1)) + 1).cast("int").alias("years_used"), F.sum("step").alias("drift_total_dist"), F.avg("step").alias("drift_step_mean"), F.avg("gap").alias("mean_year_gap"),
        F.sum("raw").alias("drift_total_dist_raw"), F.avg("raw").alias("drift_step_mean_raw"),
    )
    missing = own.groupBy("topic").agg((1 - F.count("embedding") / F.count(F.lit(1))).alias("missing_emb_rate"))
    out = out.join(missing, "topic").withColumn("drift_mode", F.lit("per_year" if by_gap else "raw_step"))
    return out.withColumn("drift_robust_score", F.col("drift_step_mean") * F.ln(F.col("years_used") + F.lit(1.0)))


def merge_map(docs: DataFrame, min_size: int = 10, sim: float = 0.85) -> list[tuple]:
    """Merges of topics under ``min_size`` into the nearest larger one, in order of size; a row for each.

    Only the centroids, one for each topic, reach the driver: each merge moves a centroid that
    later ones see.
    """
    rows = centroids(docs.where("topic <> -1"), ["topic"]).collect()
    size = {r["topic"]: r["n"] for r in rows}
    cent = {r["topic"]: np.array(r["centroid"]) for r in rows}
    out = []
    for t in sorted((t for t in size if size[t] < min_size), key=lambda t: (size[t], t)):
        big = sorted(b for b in size if size[b] >= min_size and b != t)
        if not big:
            break
        sims = np.round([float(cent[b] @ cent[t]) for b in big], 9)
        b = big[int(sims.argmax())]
        if sims.max() < sim:
            continue
        m = cent[b] * size[b] + cent[t] * size[t]
        cent[b] = m / max(float(np.linalg.norm(m)), EPS)
        out.append((t, b, float(sims.max()), size[t], size[b], size[b] + size[t]))
        size[b] += size[t]
        size.pop(t)
    return out


MERGE_SCHEMA = "from_topic int, to_topic int, sim double, from_size long, to_size_before long, to_size_after long"


def merge_micro(docs: DataFrame, min_size: int = 10, sim: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Docs with merged topics, and the map of merges."""
    spark = docs.sparkSession
    rows = merge_map(docs, min_size, sim)
    table = spark.createDataFrame(rows, MERGE_SCHEMA)
    to = F.broadcast(table.select(F.col("from_topic").alias("topic"), "to_topic"))
    return docs.join(to, "topic", "left").withColumn("topic", F.coalesce("to_topic", "topic")).drop("to_topic"), table


def near_pairs(labels: DataFrame, sim: float, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Pairs (a < b) of the rows of a label table whose cosine is ``sim`` or more.

    Rows are multiplied by the table's matrix, as many cells of it at a time as may be
    broadcast, and only near pairs come out; none are joined, and rows are shuffled once, to deal
    them out. Rows without a vector are in no pair. The work grows with the square of the table,
    which has a row for each label.
    """
    kind = labels.schema[key].dataType.simpleString()

    def pairs(batches: Iterator[pa.RecordBatch], ids: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        m32 = m.astype(np.float32)
        for b in batches:
            own, same = b.column(0).to_numpy(zero_copy_only=False), b.schema.field(0).type
            for i, j, s in _near(_unit_rows(b.column(1)), m, m32, sim, lambda i, j, own=own: own[i] < ids[j]) if b.num_rows else ():
                yield pa.RecordBatch.from_arrays([pa.array(own[i], same), pa.array(ids[j], same), pa.array(s)], ["a", "b", "sim"])

    return _by_parts(labels, key, vector, pairs, f"a {kind}, b {kind}, sim double")


def near_forest(labels: DataFrame, sim: float, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Pairs (u, v) of near_pairs() that join the same components as all of them: a task leaves out those whose ends its others join.

    Near pairs may grow with the square of the table; these are no more than a task's rows and
    the matrix's, for each task.
    """
    kind = labels.schema[key].dataType.simpleString()

    def forest(batches: Iterator[pa.RecordBatch], ids: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        m32, group = m.astype(np.float32), np.arange(len(m))
        for b in batches:
            own, same = b.column(0).to_numpy(zero_copy_only=False), b.schema.field(0).type
            met = np.full(b.num_rows, -1)  # a column that a row is joined to

            def news(i: np.ndarray, j: np.ndarray, own=own, met=met) -> np.ndarray:
                return (own[i] < ids[j]) & ((met[i] < 0) | (group[met[i]] != group[j]))

            for i, j, _ in _near(_unit_rows(b.column(1)), m, m32, sim, news) if b.num_rows else ():
                _, first = np.unique(i * len(m) + group[j], return_index=True)  # a row's first of each group
                i, j = i[first], j[first]
                if len(i):
                    fresh = met[i] < 0
                    met[i[fresh]] = j[fresh]
                    group, some = _joined(group, group[met[i]], group[j])
                    some |= fresh & (met[i] == j)
                    yield pa.RecordBatch.from_arrays([pa.array(own[i[some]], same), pa.array(ids[j[some]], same)], ["u", "v"])

    return _by_parts(labels, key, vector, forest, f"u {kind}, v {kind}")


def _joined(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups (a number for each place) after those of a became one with those of b, named by the smallest, and which of these were still two."""
    to, two = np.arange(len(group)), np.zeros(len(a), dtype=bool)

    def root(x: int) -> int:
        while to[x] != x:
            to[x] = to[to[x]]
            x = to[x]
        return x

    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        to[max(x, y)], two[k] = min(x, y), x != y
    while (to[to] != to).any():
        to = to[to]
    return to[group], two


def _by_parts(labels: DataFrame, key: str, vector: str, run: Callable[[Iterator[pa.RecordBatch], np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What run(batches, ids, matrix) makes of the rows (key, vector) with each part of their own matrix of unit vectors."""
    spark = labels.sparkSession
    rows = labels.where(F.col(vector).isNotNull()).select(F.col(key).alias("a"), F.col(vector).alias("_v"))
    out = spark.createDataFrame([], schema)
    for part in _parts(rows, "a", "_v"):
        shared = spark.sparkContext.broadcast((part["a"].to_numpy(zero_copy_only=False), _unit_rows(part["_v"])))
        out = out.union(_dealt(rows).mapInArrow(lambda batches, shared=shared: run(batches, *shared.value), schema))
    return out
