"""SimHash near-duplicates: fingerprints compared bit-sliced, many at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.llm.common import bounded_batches, fresh
from trendloom.operators.components import connected_components
from trendloom.plans.scratch import Scratch

RADIUS = 3
SHINGLE, SEED = 3, 42
#: Bits of the five blocks of a fingerprint. At most three differing bits leave two blocks equal.
BLOCKS = (13, 13, 13, 13, 12)
#: Fingerprints of one bucket that are compared with those of another chunk in one go; bytes of payload in a chunk at most.
CHUNK, CHUNK_BYTES = 8192, 16 << 20
_PAIRS_AT_ONCE, _ROWS_AT_ONCE = 1 << 14, 100_000
_ONE, _FULL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """64 bits, each set if it is in over half the XXH64 hashes of the text's 3-word shingles.

    A-Z are lower-cased, words end at ASCII white space, repeated shingles count each time.
    Fewer than three words are one shingle; no word gives 0.
    """
    ws = text.encode("utf-8", "replace").lower().split() if text else []
    if not ws:
        return 0
    if len(ws) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(ws), SEED)
    joined, digest = b" ".join(ws), xxhash.xxh64_intdigest
    starts = np.zeros(len(ws), dtype=np.int64)
    np.cumsum(np.fromiter(map(len, ws[:-1]), dtype=np.int64, count=len(ws) - 1) + 1, out=starts[1:])
    ends = [*(starts[SHINGLE:] - 1).tolist(), len(joined)]
    n = len(ends)
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends, strict=True)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_column(docs: DataFrame, text: str = "text") -> Column:
    """fingerprint() as a signed long."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in s], dtype=np.uint64).view(np.int64))

    return run(F.col(text))


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each row's smallest row so far) after joining rows a[i] and b[i]."""
    while True:
        p, q = label[a], label[b]
        apart = p != q
        if not apart.any():
            return label
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(p, q), np.minimum(p, q))
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def link_runs(fps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For rows in runs that begin at ``starts``: each row's smallest row linked to it within its run, by any path.

    A run's fingerprints stand as bit planes: bit p of up to 64 of them in one word. A
    fingerprint is compared with a word by adding, plane by plane, the differing lanes to
    two-bit carry-save counters; a lane whose fourth difference carries out is over the
    radius, and a word is abandoned once all its lanes are.
    """
    n = len(fps)
    size = np.diff(np.append(starts, n))
    run = np.repeat(np.arange(len(starts)), size)
    pos = np.arange(n) - starts[run]
    words = -(-size // 64)
    base = np.cumsum(words) - words
    word, lane = base[run] + pos // 64, (pos % 64).astype(np.uint64)
    first = np.flatnonzero(lane == 0)
    planes = np.empty((64, len(first)), dtype=np.uint64)
    for p in range(64):
        planes[p] = np.bitwise_or.reduceat(((fps >> np.uint64(p)) & _ONE) << lane, first)
    valid = np.bitwise_or.reduceat(_ONE << lane, first)
    each = words[run] - pos // 64  # with its own word and those after it
    upto = np.cumsum(each)
    label = np.arange(n)
    for begin in range(0, int(upto[-1]) if n else 0, _PAIRS_AT_ONCE):
        k = np.arange(begin, min(begin + _PAIRS_AT_ONCE, int(upto[-1])))
        row = np.searchsorted(upto, k, side="right")
        w = word[row] + (k - (upto[row] - each[row]))
        f = fps[row]
        live = np.where(w == word[row], valid[w] & ~(_FULL >> (np.uint64(63) - lane[row])), valid[w])  # later lanes only
        low, high = np.zeros(len(k), dtype=np.uint64), np.zeros(len(k), dtype=np.uint64)
        for p in range(64):
            differs = planes[p][w] ^ (np.uint64(0) - ((f >> np.uint64(p)) & _ONE))
            carry = low & differs
            low ^= differs
            live &= ~(high & carry)
            high ^= carry
            if p % 8 == 7:
                on = live != 0
                if not on.all():
                    row, w, f, live, low, high = row[on], w[on], f[on], live[on], low[on], high[on]
                if not len(row):
                    break
        if len(row):
            hit, at = np.nonzero(np.unpackbits(live.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            label = merge_labels(label, row[hit], first[w[hit]] + at)
    return label


def _keys(fp: Column) -> Column:
    """A bucket key for each two of the five blocks."""
    ends = np.cumsum(BLOCKS).tolist()
    block = [F.shiftrightunsigned(fp, e - b).bitwiseAND(F.lit((1 << b) - 1).cast("long")) for e, b in zip(ends, BLOCKS, strict=True)]
    return F.array(*[F.lit(t).cast("long") * (1 << 26) + block[i] * (1 << 13) + block[j] for t, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))])


def bucket_links(rows: DataFrame, payload: str, chunk: int, link: Callable[[np.ndarray | pa.ChunkedArray, np.ndarray], np.ndarray], fetch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(u, v) links found by ``link`` within the buckets of rows (bucket, id); the payload is the id or what ``fetch`` adds.

    Buckets of one row fall away by their count. A bucket of more than ``chunk`` rows, or of more
    than CHUNK_BYTES by the rows' column ``bytes`` if there is a ``fetch``, is dealt over chunks
    by hash, and each two chunks meet in a task of their own, so no task holds more than about
    two chunks of a bucket, however many rows share its key. Only then are payloads fetched.
    Each row of a bucket gives one link at most, to the smallest row it is connected with there.
    """
    size = F.lit(0) if fetch is None else F.sum("bytes") / CHUNK_BYTES
    n = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), size.alias("by_size")).where("n > 1")
    n = n.select("bucket", F.ceil(F.greatest(F.col("n") / chunk, "by_size")).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col("chunks")).cast("int")
    met = rows.join(n, "bucket").withColumn("own", own)
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: (F.col("chunks") == 1) | (j != F.col("own")))
    ends = F.transform(others, lambda j: F.least("own", j).cast("long") * (1 << 31) + F.greatest("own", j))
    dealt = met.withColumn("part", F.explode(ends)).drop("own", "chunks", "bytes")
    if fetch is not None:
        dealt = fetch(dealt)
    dealt = dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns(held: list[pa.RecordBatch]) -> pa.Table:
            return pa.Table.from_batches(held).combine_chunks()

        def links(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            ids = t["id"].to_numpy()
            value = ids if payload == "id" else t[payload]
            label = link(value, starts)
            joined = np.flatnonzero(label != np.arange(len(ids)))
            return pa.RecordBatch.from_pydict({"u": pa.array(ids[label[joined]], pa.int64()), "v": pa.array(ids[joined], pa.int64())})

        def begins(t: pa.Table) -> np.ndarray:
            b, p = t["bucket"].to_numpy(), t["part"].to_numpy()
            return np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (p[1:] != p[:-1])])

        held: list[pa.RecordBatch] = []
        rows_held = bytes_held = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows_held += b.num_rows
            bytes_held += b.nbytes
            if rows_held >= _ROWS_AT_ONCE or bytes_held >= 2 * CHUNK_BYTES:
                t = columns(held)
                s = begins(t)
                if len(s) > 1:
                    yield links(t.slice(0, int(s[-1])), s[:-1])
                    t = t.slice(int(s[-1])).combine_chunks()
                held, rows_held, bytes_held = t.to_batches(), t.num_rows, t.nbytes
        if held:
            t = columns(held)
            yield links(t, begins(t))

    return dealt.mapInArrow(run, "u long, v long")


def near_links(fps: DataFrame) -> DataFrame:
    """(u, v): for a table of distinct fingerprints (id), links within RADIUS that connect what all such links connect."""
    rows = fps.select("id", F.explode(_keys(F.col("id"))).alias("bucket"))
    return bucket_links(rows, "id", CHUNK, lambda ids, starts: link_runs(np.ascontiguousarray(ids).view(np.uint64), starts))


def near_components(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    Rows whose fingerprints differ in at most three bits are linked; component_id is the
    smallest id reachable, the row's own included (null only if a component has no id).
    Null and empty texts have fingerprint 0 and are linked like any others; repeated rows are
    linked with each other and returned each; texts are read whole however long; other columns
    are ignored whatever their names; an empty table gives an empty one.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    marked = scratch.save(docs.select("doc_id", fingerprint_column(docs).alias("fp")), "fingerprints")
    groups = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    links = scratch.save(near_links(groups.select(F.col("fp").alias("id"))), "links")
    parts = scratch.save(connected_components(links, scratch), "parts").select(F.col("node").alias("fp"), "component")
    joined = groups.join(parts, "fp").select("fp", "component", "low")
    lowest = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    moved = joined.join(lowest, "component").select("fp", "component_id")
    named = scratch.save(groups.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")), "named")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, similar: Callable[[DataFrame, DataFrame, Scratch], DataFrame] | None = None) -> DataFrame:
    """docs, all columns, with one document of each component: that with the smallest id.

    ``similar`` may join components further: from docs and (doc_id, component_id) it gives
    (node, component) of those that it joins.

    Rows that repeat an id are told apart by their texts: of such a row's component's rows
    with that id, each different text stays once, the row whose columns hash least. Rows
    without an id can't be told apart and stay. Null and empty texts are near-duplicates of
    each other; texts are read whole however long; columns keep their names and values; an
    empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "simhash-keep")
    found = near_components(docs, scratch)
    if similar is not None:
        found = scratch.save(found.select("doc_id", "component_id"), "near")
        found = found.join(similar(docs, found, scratch), F.col("component_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "component_id").alias("component_id"))
    found = found.where("doc_id = component_id")
    kept = scratch.save(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "kept")
    once = kept.where("n = 1").select("doc_id")
    out = docs.join(once, "doc_id", "left_semi")
    if not kept.where("n > 1").isEmpty():
        digest, rank = fresh(docs, "digest"), fresh(docs, "rank")
        some = docs.join(kept.where("n > 1").select("doc_id"), "doc_id", "left_semi").withColumn(digest, F.sha2("text", 256))
        w = Window.partitionBy("doc_id", digest).orderBy(F.sha2(F.to_json(F.struct(*docs.columns)), 256))
        out = out.unionByName(some.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).select(*docs.columns))
    return out.unionByName(docs.where(F.col("doc_id").isNull()))
