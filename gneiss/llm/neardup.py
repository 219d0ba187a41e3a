"""Operator 7: near-duplicate vectors by collision counting.

Vectors of one length are projected on random orthogonal directions.  Two vectors collide in a
projection if one lies in the window centred on the other; vectors at the cosine threshold collide in
each with probability WINDOW_RECALL at least, so a pair must reach a count that such pairs miss with
probability MISS at most.  Counts are taken first in the widest windows, all that lies on a vector's own
side (bits, which leave few pairs), then in narrow ones.  Pairs that reach both are verified by their
cosine in double precision.

Which pairs are counted: up to ALL_PAIRS distinct vectors, all.  Beyond, those that share a bucket in
one of several tables.  A table's bucket is told by one or two rotations (two beyond ONE_ROTATION
vectors): by the direction of each, or its opposite, that a vector lies nearest to.  There are as many
tables as let a pair at the threshold share no bucket with a probability of TABLE_MISS at most; closer
pairs are missed less often.  A pair is told in the first table that it meets in, so links are sums.

Vectors are sent once a table, some tables at a time and no more rows at once than there are vectors
(or SENT_BYTES); what was sent is deleted before the next are.  Buckets are cut into blocks, and each
pair of blocks is a group of its own; a table whose cut buckets make more rows is sent in several
passes.  So the disk taken is a fixed multiple of the input, whatever the buckets.

Equal vectors are one class and compared once.  Vectors that are null, empty, zero or hold null or
non-finite components are linked with nothing.  Vectors of different lengths are not linked.
Repeated rows count as equal vectors.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.base import durable, if_small, pick, release, swept
from gneiss.llm.components import connected
from gneiss.llm.groups import block_pairs, each_group, gathered
from gneiss.llm.jaccard import spread

PROJECTIONS = 32
WINDOW_RECALL = 0.99
MISS = 1e-7
TABLE_MISS = 1e-4
SIDES = 64  # directions of a rotation at most
ALL_PAIRS = 8192
ONE_ROTATION = 400_000
MOST_TABLES = 128  # a threshold that takes more has all pairs counted
SENT_BYTES = 64_000_000
BLOCK = 2048
TASK_ROWS = 100_000  # sent to a task, about
TILE = 64  # rows whose counts are held at once


@functools.lru_cache(maxsize=8)
def _directions(width: int, seed: int = 20, most: int = PROJECTIONS) -> np.ndarray:
    """Orthonormal rows, as many as there are dimensions and `most` at most."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(most, width))))
    return q.T


@functools.lru_cache(maxsize=4)
def _rotations(width: int, n: int) -> np.ndarray:
    """The directions of n rotations, one after the other."""
    return np.concatenate([_directions.__wrapped__(width, 1000 + j, SIDES) for j in range(n)]).astype(np.float32)


def _nearest(units: np.ndarray, n: int) -> np.ndarray:
    """For each vector and rotation, the direction (even) or its opposite (odd) that it lies nearest to."""
    on = (units.astype(np.float32) @ _rotations(units.shape[1], n).T).reshape(len(units), n, -1)
    side = np.abs(on).argmax(axis=2)
    return (2 * side + (np.take_along_axis(on, side[:, :, None], axis=2)[:, :, 0] < 0)).astype(np.uint8)


@functools.lru_cache(maxsize=16)
def _agreement(threshold: float) -> float:
    """The chance that vectors with this cosine are nearest to the same direction of a rotation, from
    samples, less four standard errors.  It falls with the dimensions up to about 128 and stays there."""
    n, least = 20_000, 1.0
    for width in (SIDES, 2 * SIDES, 4 * SIDES):
        rng = np.random.default_rng(width)
        x, y = rng.normal(size=(n, width)), rng.normal(size=(n, width))
        x /= np.linalg.norm(x, axis=1)[:, None]
        y -= (x * y).sum(axis=1)[:, None] * x
        y /= np.linalg.norm(y, axis=1)[:, None]
        y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * y
        i, j = (np.abs(v[:, :SIDES]).argmax(axis=1) for v in (x, y))
        p = float(((i == j) & (x[np.arange(n), i] * y[np.arange(n), j] > 0)).mean())
        least = min(least, p - 4 * math.sqrt(p * (1 - p) / n))
    return max(least, 1e-9)


def tables_for(threshold: float, depth: int, miss: float = TABLE_MISS) -> int:
    """How many tables of `depth` rotations let a pair at the threshold share no bucket with probability miss."""
    return 1 if depth == 0 or threshold >= 1 else math.ceil(math.log(miss) / math.log1p(-(_agreement(threshold) ** depth)))


def depth_for(n: int, threshold: float) -> int:
    """Rotations that tell a bucket of n vectors; 0: all pairs are counted."""
    depth = 0 if n <= ALL_PAIRS else 1 if n <= ONE_ROTATION else 2
    while depth and tables_for(threshold, depth) > MOST_TABLES:
        depth -= 1
    return depth


def plan_rounds(rows: list[int], budget: int) -> list[tuple[int, int, int]]:
    """(first table, end, passes): tables sent together while their rows are within the budget; one that
    has more is alone, in as many passes as keep within it."""
    out, at = [], 0
    while at < len(rows):
        end = at + 1
        while end < len(rows) and sum(rows[at : end + 1]) <= budget:
            end += 1
        out.append((at, end, max(1, -(-rows[at] // budget)) if end == at + 1 else 1))
        at = end
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    a = vectors.astype(np.float64)
    a /= np.abs(a).max(axis=1)[:, None]
    return a / np.sqrt(np.einsum("ij,ij->i", a, a))[:, None]


def _read(batches, functions: int | None):
    """Rows of vec_id and class; or, with a number of functions, of class, width, vector and codes."""
    for batch in batches:
        lists, n = batch.column("vector"), batch.num_rows
        length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(length) - length
        flat = pc.fill_null(lists.flatten(), math.nan).to_numpy(zero_copy_only=False)
        names: list = [None] * n
        found: list[list] = [[], [], [], []]
        for width in np.unique(length[length > 0]).tolist():
            at = np.flatnonzero(length == width)
            a = flat[start[at][:, None] + np.arange(width)]
            ok = np.isfinite(a).all(axis=1) & a.any(axis=1)
            at, a = at[ok], a[ok] + a.dtype.type(0)  # no negative zeros
            if not len(at):
                continue
            units = _unit(a)
            own = [hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in units]
            for i, name in zip(at.tolist(), own, strict=True):
                names[i] = name
            if functions is not None:
                codes = _nearest(units, functions) if functions else np.zeros((len(at), 0), np.uint8)
                found[0] += own
                found[1] += [width] * len(at)
                found[2] += [v.tobytes() for v in a]
                found[3] += [c.tobytes() for c in codes]
        if functions is None:
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(names, pa.binary())], names=["vec_id", "class"])
        else:
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.binary()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.binary()), pa.array(found[3], pa.binary())], names=["class", "width", "vector", "codes"])


@functools.lru_cache(maxsize=16)
def _sigmas(p: float) -> float:
    """Half-width, in standard deviations, that a normal variate stays within with probability p."""
    low, high = 0.0, 12.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erf(mid / math.sqrt(2)) < p else (low, mid)
    return high


@functools.lru_cache(maxsize=64)
def least_count(m: int, p: float = WINDOW_RECALL, miss: float = MISS) -> int:
    """The largest count that at least 1 - miss of the pairs reach, each of m collisions having chance p."""
    below = 0.0
    for count in range(m + 1):
        below += math.comb(m, count) * p**count * (1 - p) ** (m - count)
        if below > miss:
            return count
    return m


def _meet(threshold: float, depth: int, kind: str):
    def handle(table: pa.Table) -> pa.RecordBatch:
        group = np.stack([table.column(c).to_numpy() for c in ("bucket", "first", "second")])
        begin = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(axis=0)]))
        out: list[list] = [[], [], []]
        for s, e in zip(begin.tolist(), [*begin[1:].tolist(), group.shape[1]], strict=True):
            if e - s < 2:
                continue
            bucket, first, second = (int(v) for v in group[:, s])
            width, earlier = bucket >> 32, bucket >> 16 & 0xFFFF
            part = table.slice(s, e - s)
            name, own, weight = part.column("class").to_pylist(), part.column("own").to_numpy(), part.column("weight").to_numpy()
            x = np.flatnonzero(own == first)
            y = x if first == second else np.flatnonzero(own == second)
            if not len(x) or not len(y):
                continue
            units = _unit(np.frombuffer(b"".join(part.column("vector").to_pylist()), kind).reshape(-1, width))
            linked = _linked(units[x], units[y], threshold)
            if first == second:
                np.fill_diagonal(linked, False)
            if earlier and linked.any():
                codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint16 if depth == 2 else np.uint8).reshape(e - s, -1)[:, :earlier]
                for i in np.flatnonzero(linked.any(axis=1)).tolist():  # what met in an earlier table was told there
                    to = np.flatnonzero(linked[i])
                    linked[i, to] = ~(codes[x[i]] == codes[y[to]]).any(axis=1)
            root_x, root_y = x.copy(), y.copy()
            in_x, in_y = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            root_x[in_x], root_y[in_y] = spread(linked[np.ix_(in_x, in_y)], x[in_x], y[in_y])
            for members, total, root in [(x, linked @ weight[y], root_x)] + ([] if first == second else [(y, weight[x] @ linked, root_y)]):
                told = np.flatnonzero(total)
                out[0] += [name[members[i]] for i in told]
                out[1] += total[told].tolist()
                out[2] += [name[root[i]] for i in told]
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["class", "links", "root"])

    return lambda batches: each_group(batches, "bucket", handle)


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs collide often enough and have the cosine."""
    width = x.shape[1]
    rows = _directions(width)
    half = _sigmas(WINDOW_RECALL) * math.sqrt(max(0.0, 2 - 2 * threshold) / width) + 1e-6
    need = least_count(len(rows)) if width > 8 else 0  # in few dimensions projections are not normal
    # places in steps of a 24th of the half-width, modulo 256: what lies in the window is at most 25
    # steps away, so one unsigned byte tells it; far values that fall together only add candidates
    at_x, at_y = (np.floor(v @ rows.T * (24 / half)).astype(np.int64).astype(np.uint8) for v in (x, y))
    at_x += np.uint8(25)
    sides = 2 * min(SIDES, width)
    most = sides - least_count(sides, 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) if width > 8 else sides
    side_x, side_y = _sides(x), _sides(y)
    linked = np.zeros((len(x), len(y)), bool)
    for at in range(0, len(x), TILE):
        apart = np.zeros((len(x[at : at + TILE]), len(y)), np.uint8)
        for j in range(side_x.shape[1]):
            apart += np.bitwise_count(side_x[at : at + TILE, j, None] ^ side_y[None, :, j])
        i, k = np.nonzero(apart <= most)
        reach = (at_x[at + i] - at_y[k] <= np.uint8(50)).sum(axis=1) >= need
        i, k = i[reach], k[reach]
        if len(i) * 20 > apart.size:  # dense: the whole product is cheaper than picking pairs
            linked[at : at + TILE][i, k] = (x[at : at + TILE] @ y.T)[i, k] >= threshold
        else:
            linked[at + i, k] = np.einsum("ij,ij->i", x[at + i], y[k]) >= threshold
    return linked


def _sides(units: np.ndarray) -> np.ndarray:
    """The sides of two rotations' directions that vectors lie on, as bits."""
    width = units.shape[1]
    rows = np.concatenate([_directions(width, seed, SIDES) for seed in (21, 22)])
    bits = np.packbits(units @ rows.T > 0, axis=1)
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)


def near_duplicates(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = 0.9, block: int = BLOCK, depth: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of df.  depth: rotations that tell a bucket
    (0, 1 or 2; None: by the number of distinct vectors)."""
    rows = pick(df, vec_id=id_column, vector=vector_column)
    id_kind = rows.schema["vec_id"].dataType.simpleString()
    single = rows.schema["vector"].dataType.simpleString() == "array<float>"
    rows = rows.select("vec_id", F.col("vector").cast("array<float>" if single else "array<double>").alias("vector"))
    with swept(df.sparkSession):
        all_rows = durable(rows.mapInArrow(lambda batches: _read(batches, None), f"vec_id {id_kind}, class binary"))
        about = durable(all_rows.filter("class IS NOT NULL").groupBy("class").agg(F.count("*").alias("weight"), F.min("vec_id").alias("vec")))
        n = about.count()
        depth = depth_for(n, threshold) if depth is None else depth
        checked = _checked(rows, n, threshold, block, depth, np.float32 if single else np.float64)
        links = durable(checked.groupBy("class").agg(F.sum("links").alias("links")))
        root = durable(connected(checked.filter("class <> root"), "class", "root"))
        told = about.join(links, "class", "left").join(root.select(F.col("node").alias("class"), "component"), "class", "left")
        told = durable(told.select("class", "weight", "vec", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "class").alias("component")))
        smallest = durable(told.groupBy("component").agg(F.min("vec").alias("component_id")))
        told = durable(told.join(smallest, "component").select("class", "component_id", (F.col("links") + F.col("weight") - 1).alias("n_links")))
    out = all_rows.select("vec_id", "class").join(told, "class", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _checked(rows: DataFrame, n: int, threshold: float, block: int, depth: int, kind: type) -> DataFrame:
    """class, links and root (a class it is connected with), some rows for each class that has links."""
    tables = tables_for(threshold, depth)
    functions = tables * depth
    read = rows.mapInArrow(lambda batches: _read(batches, functions), "class binary, width long, vector binary, codes binary")
    read = read.groupBy("class").agg(F.count("*").alias("weight"), F.first(F.struct("width", "vector", "codes")).alias("v"))
    classes = durable(read.select("class", "weight", "v.*"))
    code = F.conv(F.hex(F.expr(f"substring(codes, {depth} * t + 1, {depth})")), 16, 10).cast("long") if depth else F.lit(0)
    bucket = (F.col("width") * (1 << 32) + F.col("t") * (1 << 16) + code).alias("bucket")

    def dealt(first: int, end: int) -> DataFrame:
        return classes.withColumn("t", F.explode(F.sequence(F.lit(first), F.lit(end - 1)))).withColumn("bucket", bucket)

    # buckets that are cut, and the rows that cutting adds to each table
    large = durable(dealt(0, tables).groupBy("t", "bucket").agg(F.count("*").alias("size")).filter(F.col("size") > block))
    added = dict(large.groupBy("t").agg(F.sum(F.col("size") * (F.ceil(F.col("size") / block) - 1))).collect())
    row_bytes = 160 + int(classes.agg(F.avg(F.octet_length("vector"))).first()[0] or 0)
    rounds = plan_rounds([n + added.get(t, 0) for t in range(tables)], max(n, SENT_BYTES // row_bytes))
    large = if_small(large.drop("t"))
    checked = []
    at_least = rows.sparkSession.sparkContext.defaultParallelism
    for first, end, passes in rounds:
        parts = max(at_least, sum(n + added.get(t, 0) for t in range(first, end)) // passes // TASK_ROWS)
        whole = dealt(first, end).join(large, "bucket", "left")
        sent = block_pairs(whole, "bucket", "class", F.coalesce("size", F.lit(1)), block)
        sent = sent.select("bucket", "first", "second", "own", "class", "weight", "vector", "codes")
        for k in range(passes):
            here = sent.filter(F.pmod(F.xxhash64("bucket", "first", "second"), F.lit(passes)) == k) if passes > 1 else sent
            checked.append(durable(gathered(here, "bucket", parts).mapInArrow(_meet(threshold, depth, np.dtype(kind).str), "class binary, links long, root binary")))
    release(classes)
    return functools.reduce(DataFrame.unionAll, checked)
