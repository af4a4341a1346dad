"""Media columns: local image descriptors that find cropped or edited copies."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import bounded_batches
from trendloom.operators.components import connected_components
from trendloom.plans.scratch import Scratch

#: Scales of the pyramid; corners that are described in one go.
SCALES, CORNERS_AT_ONCE = (1.0, 0.75, 0.5), 1024
#: Pixels around a corner that its tests look at; those that have to lie inside the image, whose edges are repeated beyond; number of tests.
PATCH, MARGIN, TESTS = 22, 12, 256
#: Hamming tables: bits of a descriptor that a key is made of, tables.
KEY_BITS, TABLES = 32, 8
#: Differing bits of matching descriptors at most; matches that one similarity has to explain; pixels they may be off.
MATCH_BITS, INLIERS, OFF = 55, 6, 2.0
#: Blocks of images that meet two by two: bytes of signatures in one at most, blocks that are made in any case if they hold CHUNK images each; pairs of corners at once.
BLOCK_BYTES, BLOCKS, CHUNK, _PAIRS_AT_ONCE = 32 << 20, 3, 2048, 1 << 18

_rng = np.random.default_rng(20)
_PAIRS = np.clip(_rng.normal(0, PATCH / 2, (TESTS, 2, 2)), -PATCH, PATCH)
_DISC = [(y, x) for y in range(-PATCH + 1, PATCH) for x in range(-PATCH + 1, PATCH) if x * x + y * y < (PATCH - 1) ** 2]
_DY, _DX = np.array(_DISC).T


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of an image in binary PGM or PPM, or in PNG with up to 8 bits a channel, palettes included, not interlaced; else None."""
    try:
        if data is None:
            return None
        if data[:2] in (b"P5", b"P6"):
            head = data.split(maxsplit=4)
            w, h, c = int(head[1]), int(head[2]), 3 if data[:2] == b"P6" else 1
            x = np.frombuffer(data[-w * h * c :], dtype=np.uint8).reshape(h, w, c).astype(np.float32)
            return x.mean(axis=2) if w * h else None
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _decode_png(data)
    except (ValueError, IndexError, KeyError, struct.error, zlib.error):
        return None
    return None


def _decode_png(data: bytes) -> np.ndarray | None:
    at, body, head, palette = 8, [], None, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = part
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    w, h, depth, color, _, _, interlaced = head
    c = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    if depth > 8 or interlaced:
        return None
    step = max(1, c * depth // 8)  # bytes from a pixel to the next
    width = (w * c * depth + 7) // 8
    raw = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(h, 1 + width)
    out = np.zeros((h, width), dtype=np.uint8)
    up = np.zeros(width, dtype=np.uint8)
    for y in range(h):
        up = out[y] = _unfilter(int(raw[y, 0]), raw[y, 1:], up, step)
    if depth < 8:
        bits = np.unpackbits(out, axis=1).reshape(h, -1, depth)[:, :w] @ (1 << np.arange(depth)[::-1])
        out = bits if color == 3 else bits * 255 // ((1 << depth) - 1)
    if color == 3:
        return np.frombuffer(palette, dtype=np.uint8).reshape(-1, 3)[out.astype(int)].astype(np.float32).mean(axis=2)
    x = out.reshape(h, w, c).astype(np.float32)
    return x[:, :, : 3 if c >= 3 else 1].mean(axis=2)


def _unfilter(kind: int, line: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    """A line of bytes with its PNG filter undone. Filters 3 and 4 need each byte's left one first, so they loop over plain integers."""
    if kind == 0:
        return line
    if kind == 2:
        return line + up
    if kind == 1:
        padded = np.append(line, np.zeros(-len(line) % step, dtype=np.uint8)).reshape(-1, step)
        return np.cumsum(padded, axis=0, dtype=np.uint8).ravel()[: len(line)]
    out, above, data = [0] * step, [0] * step + up.tolist(), line.tolist()
    if kind == 3:
        for i, v in enumerate(data):
            out.append((v + (out[i] + above[i + step]) // 2) & 255)
    elif kind == 4:
        for i, v in enumerate(data):
            a, b, c = out[i], above[i + step], above[i]
            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            out.append((v + (a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c)) & 255)
    else:
        raise ValueError(f"filter {kind}")
    return np.array(out[step:], dtype=np.uint8)


def resize(x: np.ndarray, by: float) -> np.ndarray:
    """Bilinear."""
    if by == 1.0:
        return x
    h, w = max(1, round(x.shape[0] * by)), max(1, round(x.shape[1] * by))
    ys, xs = np.clip((np.arange(h) + 0.5) / by - 0.5, 0, x.shape[0] - 1), np.clip((np.arange(w) + 0.5) / by - 0.5, 0, x.shape[1] - 1)
    y0, x0 = np.minimum(ys.astype(int), x.shape[0] - 2 if x.shape[0] > 1 else 0), np.minimum(xs.astype(int), x.shape[1] - 2 if x.shape[1] > 1 else 0)
    y1, x1 = np.minimum(y0 + 1, x.shape[0] - 1), np.minimum(x0 + 1, x.shape[1] - 1)
    fy, fx = (ys - y0)[:, None], xs - x0
    return (x[y0][:, x0] * (1 - fx) + x[y0][:, x1] * fx) * (1 - fy) + (x[y1][:, x0] * (1 - fx) + x[y1][:, x1] * fx) * fy


def box(x: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2r + 1 pixels, edges repeated."""
    p = np.pad(x, r + 1, mode="edge")[:-1, :-1] if r else x
    s = p.cumsum(0).cumsum(1)
    k = 2 * r + 1
    return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / (k * k)


def corners(x: np.ndarray) -> list[tuple[float, int, int]]:
    """(strength, y, x) of local maxima of the Harris response that are MARGIN or more inside."""
    h, w = x.shape
    if min(h, w) < 2 * PATCH:
        return []
    gy, gx = np.gradient(x)
    a, b, c = box(gx * gx, 2), box(gy * gy, 2), box(gx * gy, 2)
    r = a * b - c * c - 0.05 * (a + b) ** 2
    m = MARGIN
    inner = r[m:-m, m:-m]
    around = np.max([r[m + dy : h - m + dy, m + dx : w - m + dx] for dy in (-2, -1, 0, 1, 2) for dx in (-2, -1, 0, 1, 2)], axis=0)
    ys, xs = np.nonzero((inner >= around) & (inner > 50.0))
    return [(float(inner[y, k]), int(y) + m, int(k) + m) for y, k in zip(ys, xs, strict=True)]


def describe(x: np.ndarray | None) -> bytes:
    """Corners with their places, scales, orientations and descriptors: 4 float32 and 32 bytes each, strongest first.

    A corner's orientation is that of its patch's centre of intensity; the tests' places are
    turned by it before the smoothed values there are compared.
    """
    if x is None:
        return b""
    out = []
    for s in SCALES:
        level = resize(x, s)
        found = corners(level)
        smooth = box(level, 4) if found else level
        for at in range(0, len(found), CORNERS_AT_ONCE):
            some = found[at : at + CORNERS_AT_ONCE]
            ys, xs = np.array([f[1] for f in some]), np.array([f[2] for f in some])
            patch = smooth[np.clip(ys[:, None] + _DY, 0, level.shape[0] - 1), np.clip(xs[:, None] + _DX, 0, level.shape[1] - 1)]
            patch = patch - patch.mean(axis=1, keepdims=True)
            turn = np.arctan2(patch @ _DY, patch @ _DX)
            cos, sin = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
            dy, dx = _PAIRS[None, :, :, 0], _PAIRS[None, :, :, 1]
            py = np.rint(ys[:, None, None] + sin * dx + cos * dy).astype(int)
            px = np.rint(xs[:, None, None] + cos * dx - sin * dy).astype(int)
            value = smooth[np.clip(py, 0, level.shape[0] - 1), np.clip(px, 0, level.shape[1] - 1)]
            bits = np.packbits(value[:, :, 0] < value[:, :, 1], axis=1)
            out += [(f[0], struct.pack("<4f", (k + 0.5) / s, (y + 0.5) / s, s, t) + b.tobytes()) for f, y, k, t, b in zip(some, ys, xs, turn, bits, strict=True)]
    out.sort(key=lambda t: -t[0])
    return b"".join(b for _, b in out)


_CORNER = np.dtype([("place", "<f4", 2), ("scale", "<f4"), ("turn", "<f4"), ("bits", "<u8", TESTS // 64)])


def corner_keys(signature: bytes) -> np.ndarray:
    """Bucket keys of each corner of a signature, one for each table: the table's bits."""
    bits = np.unpackbits(np.frombuffer(signature, dtype=_CORNER)["bits"].copy().view(np.uint8).reshape(-1, TESTS // 8), axis=1)
    parts = bits[:, : TABLES * KEY_BITS].reshape(-1, TABLES, KEY_BITS).astype(np.int64) @ (1 << np.arange(KEY_BITS))
    return (np.arange(TABLES) << KEY_BITS) + parts


def keys(signature: bytes) -> list[int]:
    """Distinct bucket keys of a signature."""
    return np.unique(corner_keys(signature)).tolist()


def nearest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each descriptor of a the nearest of b and the bits they differ in, in blocks of bounded size."""
    best, apart = np.zeros(len(a), dtype=int), np.zeros(len(a), dtype=np.int16)
    step = max(1, _PAIRS_AT_ONCE // len(b))
    for at in range(0, len(a), step):
        d = sum(np.bitwise_count(a[at : at + step, None, w] ^ b[None, :, w]).astype(np.int16) for w in range(a.shape[1]))
        best[at : at + step] = d.argmin(axis=1)
        apart[at : at + step] = d.min(axis=1)
    return best, apart


def consensus(a: np.ndarray, b: np.ndarray) -> int:
    """Corners of a with a match in b, each the other's nearest, that one turn, scale and shift explains, the most of any.

    The search ends once INLIERS are found.
    """
    if len(a) < INLIERS or len(b) < INLIERS:
        return 0
    best, apart = nearest(a["bits"], b["bits"])
    i = np.flatnonzero(apart <= MATCH_BITS)
    if len(i) < INLIERS:
        return 0
    to, which = np.unique(best[i], return_inverse=True)
    i = i[nearest(b["bits"][to], a["bits"])[0][which] == i]
    if len(i) < INLIERS:
        return 0
    p = a["place"][i] @ np.array([1, 1j])
    q = b["place"][best[i]] @ np.array([1, 1j])
    most = 0
    for m in range(len(i) - 1):  # each two matches propose a similarity
        n = np.arange(m + 1, len(i))
        n = n[np.abs(p[m] - p[n]) > 6]
        by = (q[n] - q[m]) / (p[n] - p[m])
        by = by[(np.abs(by) > 0.4) & (np.abs(by) < 2.5)]
        step = max(1, _PAIRS_AT_ONCE // len(i))
        for at in range(0, len(by), step):
            fits = np.abs(q[m] + by[at : at + step, None] * (p - p[m]) - q) <= OFF
            most = max(most, int(fits.sum(axis=1).max(initial=0)))
            if most >= INLIERS:
                return most
    return most


def block_links(component: np.ndarray, block: np.ndarray, corners: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) that join what all links between images of different blocks (of one block, if there is but one) join.

    Images are rows in ascending order, and ``owner`` is the row of each corner. Two images are
    held against each other if corners of theirs share a key and differ in MATCH_BITS at most,
    unless their classes or links found before join them. A class gives one link at most.
    """
    n, two = len(component), block.min() != block.max()
    _, first, which = np.unique(component, return_index=True, return_inverse=True)
    start = first[which]
    label, bound = start.copy(), np.searchsorted(owner, np.arange(n + 1))
    mask, step = (1 << KEY_BITS) - 1, 1 << 15
    keys = np.concatenate([(corner_keys(corners[at : at + step].tobytes()) & mask).astype(np.uint32) for at in range(0, len(corners), step)])
    found, ends, held = [], [], 0
    for key in keys.T:  # of each table the runs of equal keys that hold several classes, in both blocks if there are two
        order = np.argsort(key, kind="stable")
        begins = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        size = np.diff(np.append(begins, len(order)))
        several = size > 1
        for x in (label, block) if two else (label,):
            of = x[owner[order]]
            several &= np.minimum.reduceat(of, begins) != np.maximum.reduceat(of, begins)
        found.append(order[np.repeat(several, size)].astype(np.int32))
        ends.append(held + np.repeat(np.cumsum(size[several]), size[several]))
        held += len(found[-1])
    del keys
    member, end = np.concatenate(found), np.concatenate(ends)
    pos = np.argsort(owner[member], kind="stable")
    after = end[pos] - pos - 1  # corners of the run that follow, of the same image or later ones
    upto = np.cumsum(after)
    done = np.zeros(0, dtype=np.int64)
    for begin in range(0, int(upto[-1]) if len(upto) else 0, _PAIRS_AT_ONCE):
        k = np.arange(begin, min(begin + _PAIRS_AT_ONCE, int(upto[-1])))
        e = np.searchsorted(upto, k, side="right")
        p, q = member[pos[e]], member[pos[e] + 1 + k - (upto[e] - after[e])]
        last = owner[p[-1]]
        i, j = owner[p], owner[q]
        apart = label[i] != label[j]
        if two:
            apart &= block[i] != block[j]
        p, q = p[apart], q[apart]
        near = np.bitwise_count(corners["bits"][p] ^ corners["bits"][q]).sum(axis=1, dtype=np.int16) <= MATCH_BITS
        pairs = np.unique(owner[p[near]] * n + owner[q[near]])
        pairs = pairs[~np.isin(pairs, done)]
        for i, j in zip((pairs // n).tolist(), (pairs % n).tolist(), strict=True):
            if label[i] != label[j] and consensus(corners[bound[i] : bound[i + 1]], corners[bound[j] : bound[j + 1]]) >= INLIERS:
                label[label == max(label[i], label[j])] = min(label[i], label[j])
        done = np.append(done, pairs)
        done = done[done // n == last]
    joined = first[label[first] != first]
    return label[joined], joined


def _links_in_blocks(left: DataFrame, signatures: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) links that join what all links between images of left (bucket, id, component) with a matching corner in a common bucket join.

    Images are dealt over blocks by hash. A task holds two blocks, with the signatures of those
    images that share a bucket with one of the other block, looks their pairs up and verifies
    them; pairs don't come out.
    """
    all_bytes, n = signatures.agg(F.sum(F.octet_length("signature")), F.count(F.lit(1))).first()
    blocks = max(1, -(-(all_bytes or 0) // BLOCK_BYTES), min(BLOCKS, -(-n // CHUNK)))
    at = left.select("bucket", "id", "component", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(blocks)).cast("int").alias("block"))
    inside = at.groupBy("bucket", "block").agg((F.min("component") != F.max("component")).alias("several"))
    others = inside.groupBy("bucket").agg(F.collect_list(F.struct("block", "several")).alias("others"))
    pairs = F.transform(F.filter("others", lambda o: (o["block"] != F.col("block")) | o["several"]), lambda o: F.least("block", o["block"]).cast("long") * (1 << 31) + F.greatest("block", o["block"]))
    met = at.join(others, "bucket").select("id", "component", "block", F.array_sort(pairs).alias("pairs"))
    met = scratch.save(met.groupBy("id", "component", "block").agg(F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")), "blocks")
    dealt = met.join(signatures, "id").select(F.explode("pairs").alias("pair"), "id", "component", "block", "signature")
    dealt = dealt.repartition("pair").sortWithinPartitions("pair", "id")

    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        ids, component, block = (t[c].to_numpy() for c in ("id", "component", "block"))
        signature = t["signature"].chunk(0).cast(pa.large_binary())
        ends = np.frombuffer(signature.buffers()[1], dtype=np.int64)[signature.offset : signature.offset + len(ids) + 1]
        corners = np.frombuffer(signature.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view(_CORNER)
        u, v = block_links(component, block, corners, np.repeat(np.arange(len(ids)), np.diff(ends) // _CORNER.itemsize))
        return pa.RecordBatch.from_pydict({"u": pa.array(ids[u], pa.int64()), "v": pa.array(ids[v], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            pair = b.column("pair").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pair)) + 1).tolist(), len(pair)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if end > begin:
                    if held and held[-1].column("pair")[0].as_py() != pair[begin]:
                        yield links(held)
                    held.append(b.slice(begin, end - begin))
        if held:
            yield links(held)

    return dealt.mapInArrow(run, "u long, v long")


def verify(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (u, v) whose images one similarity transform links."""
    a = signatures.select(F.col("id").alias("u"), F.col("signature").alias("a"))
    b = signatures.select(F.col("id").alias("v"), F.col("signature").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            sigs = [[np.frombuffer(s, dtype=_CORNER) for s in t.column(k).to_pylist()] for k in (2, 3)]
            yield t.select(["u", "v"]).filter(pa.array([consensus(x, y) >= INLIERS for x, y in zip(*sigs, strict=True)], pa.bool_()))

    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def image_links(rows: DataFrame, signatures: DataFrame, scratch: Scratch, rounds: int = 2) -> DataFrame:
    """(u, v) links that connect what all links between images with a matching corner in a common bucket connect, from rows (id, bucket).

    First, ids alone: in each round an image is held against one smallest id of a bucket of its
    own, that which it shares most buckets with, outside its class so far, unless it has been.
    Copies of one image meet in nearly all their buckets, so that joins them by a pair each.
    Then, exactly: every two images of different classes with corners that match in a common
    bucket are held against each other, in tasks that hold two blocks of images.
    """
    counted = rows.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("bucket")
    rows = scratch.save(rows.join(counted, "bucket").select("bucket", "id"), "shared")
    links = scratch.save(rows.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0), "none")
    tried, classed = links, rows.withColumn("component", F.col("id"))
    for k in range(rounds):
        lead = classed.groupBy("bucket").agg(F.min(F.struct("id", "component")).alias("lead"))
        # the pairs of images that nothing has joined are those of the round before
        open_rows = classed.join(parts.select("id"), "id", "left_semi") if k else classed
        met = open_rows.join(lead, "bucket").where("component <> lead.component").groupBy(F.col("lead.id").alias("u"), F.col("id").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        best = met.groupBy("v").agg(F.max(F.struct("n", (-F.col("u")).alias("m"))).alias("b")).select((-F.col("b.m")).alias("u"), "v")
        best = scratch.save(best.join(tried, ["u", "v"], "left_anti"), "best")
        tried = tried.union(best)
        links = scratch.save(links.union(verify(best, signatures)), "verified")
        parts = connected_components(links, scratch).select(F.col("node").alias("id"), "component")
        before, classed = classed, scratch.save(rows.join(parts, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component")), "classed")
        scratch.drop(before)
    mixed = classed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("bucket")
    return links.union(_links_in_blocks(classed.join(mixed, "bucket"), signatures, scratch))


def signature_column(image: Column, docs: DataFrame) -> Column:
    """struct(content string, signature binary, decoded boolean) of encoded images; all null for null but the signature."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("content string, signature binary, decoded boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for images in batches:
            rows = []
            for data in images:
                x = decode(data)
                rows.append((None if data is None else hashlib.sha256(data).hexdigest(), describe(x), None if data is None else x is not None))
            yield pd.DataFrame(rows, columns=["content", "signature", "decoded"])

    return run(image)


def key_column(signature: str) -> Column:
    """corner_keys(); images of fewer than INLIERS corners have none."""

    @F.pandas_udf("array<array<long>>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([corner_keys(x).tolist() if len(x) >= INLIERS * _CORNER.itemsize else [] for x in s], dtype=object)

    return run(F.col(signature))


def copies(images: DataFrame, image: Column | None = None) -> DataFrame:
    """(image_id, corners, class_id, linked, decoded) of every row of images (image_id, image).

    Equal bytes are one class. Different images are linked if a matching corner of theirs shares a key
    of a Hamming table and one similarity transform explains INLIERS of their matching corners; class_id is
    the smallest image_id reachable, linked whether the class has an image of other bytes.
    Nulls and bytes that can't be decoded have no corners, and decoded says null and false;
    images are decoded one at a time; undecodable bytes are still equal to equal bytes, a null is equal to nothing and its class is its own id. Rows without an id
    are linked by their bytes only. Repeated rows are returned each; other columns are ignored
    whatever their names; an empty table gives an empty one.
    """
    scratch = Scratch(images.sparkSession, "media")
    made = signature_column(F.col("image") if image is None else image, images)
    marked = scratch.save(images.select(F.col("image_id").cast("long").alias("image_id"), made.alias("m")).select("image_id", "m.*"), "signatures")
    groups = marked.where("content is not null").groupBy("content").agg(F.min("image_id").alias("id"), F.any_value("signature").alias("signature"))
    groups = scratch.save(groups, "distinct")
    rows = groups.where("id is not null").select("id", F.explode(F.array_distinct(F.flatten(key_column("signature")))).alias("bucket"))
    links = scratch.save(image_links(rows, groups.where("id is not null").select("id", "signature"), scratch), "links")
    parts = connected_components(links, scratch).select(F.col("node").alias("id"), "component")
    named = groups.select("content", "id").join(parts, "id", "left").select("content", F.coalesce("component", "id").alias("class_id"), F.col("component").isNotNull().alias("linked"))
    out = marked.join(named, "content", "left")
    size = _CORNER.itemsize
    return out.select("image_id", (F.octet_length("signature") / size).cast("int").alias("corners"), F.when(F.col("content").isNull(), F.col("image_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("linked", F.lit(False)).alias("linked"), "decoded")


def mosaic(vector: np.ndarray | None, cell: int = 8, gain: float = 400.0) -> bytes | None:
    """A PGM image of a vector: squares of grey in a square grid, one for each component; null without a vector."""
    if vector is None or not len(vector):
        return None
    v = np.array([0.0 if x is None or not np.isfinite(x) else x for x in vector], dtype=float)
    side = int(np.ceil(np.sqrt(len(v))))
    grid = np.full(side * side, 128.0)
    grid[: len(v)] = np.clip(128 + gain * v, 0, 255)
    x = np.kron(np.rint(grid).astype(np.uint8).reshape(side, side), np.ones((cell, cell), dtype=np.uint8))
    return b"P5 %d %d 255\n" % x.shape[::-1] + x.tobytes()


def mosaic_column(vector: str) -> Column:
    """mosaic() as a column: the test tables hold no images, so their vectors are drawn."""

    @F.pandas_udf("binary")
    def draw(s: pd.Series) -> pd.Series:
        return pd.Series([mosaic(v) for v in s], dtype=object)

    return draw(F.col(vector))
