"""Operator 4: n-gram Jaccard join by a MinHash LSH forest with exact verification.

A text is the set of its runs of five words (a shorter text: one run of all its words; no words: no
set, linked with nothing).  Texts with equal sets are one class and only classes are compared.

Candidates: each of TREES prefix tries orders the classes by its own sequence of LONGEST min-hashes;
the leaves that share a prefix of the least useful length (at which pairs at the threshold are found
with the target recall, by formula) are kept, sorted by tree and sequence.  The walk starts at the
longest prefixes and shortens them step by step: at each step classes under a node are compared,
unless all of them share a longer prefix and have been compared before.  From the ties found so far,
each weighed by the chance that such a pair is found at this depth, it estimates how many are still
missing, and it stops as soon as the target recall is reached.  Under a prefix, classes whose whole
sketches agree too little to reach the threshold are not joined; the remaining ties give groups in
which every candidate pair lies.  Groups and prefixes of any size are cut into blocks, one task a
pair of blocks, so nothing is capped and no task grows with a group.

Verification: within a group every pair of classes is compared by exact intersection sizes; only
sums of links per class leave a task, never pairs.

Result: one row per document with its class_id (the smallest id reachable by links), n_links (other
documents linked directly, copies counted each) and kept (it is that smallest id).  Rows repeated
with their id count as copies.  Rows with a null id are linked like others; class_id is null where no
row reached has an id.  An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.base import durable, if_small, pick, release, slices, splitmix, strings
from gneiss.llm.components import connected
from gneiss.llm.groups import block_pairs, each_group, gathered
from gneiss.llm.words import shingle_hashes, word_hashes

TREES = 24
LONGEST = 8
TARGET_RECALL = 0.99999
SKETCH = 96  # min-hashes, two bytes of each in the sketch
STEP = SKETCH // TREES  # a tree's sequence begins so many min-hashes behind that of the tree before
AT_ONCE = 400_000  # shingles sorted together
BLOCK_SHINGLES = 1_000_000  # of the sets of a block of classes, on the average
UNSEEN = 3  # pairs at the threshold that may exist besides those found, in the estimate of the recall


def recall(threshold: float, depth: int, trees: int = TREES) -> float:
    """Chance that a pair of this similarity shares a prefix of this depth in some tree."""
    return 1 - (1 - threshold**depth) ** trees


def prefix_depth(threshold: float, target: float = TARGET_RECALL, trees: int = TREES) -> int:
    """The longest prefix with the target recall."""
    depth = LONGEST
    while depth > 1 and recall(threshold, depth, trees) < target:
        depth -= 1
    return depth


def depths(threshold: float) -> list[int]:
    """The lengths of prefixes that the walk visits, down to the least useful one."""
    least = prefix_depth(threshold)
    return sorted({LONGEST, (LONGEST + least) // 2, least}, reverse=True)


def least_agreement(threshold: float) -> int:
    """Min-hashes of the sketch that must agree: six standard deviations below what the threshold gives."""
    p = threshold
    return max(1, int(SKETCH * p - 6 * (SKETCH * p * (1 - p)) ** 0.5))


def estimated_recall(ties: DataFrame, threshold: float, depth: int) -> float:
    """The share of similar pairs that prefixes of this depth find, from the ties (a, b, agree) found."""
    alike = F.col("agree") / SKETCH
    chance = 1 - F.pow(1 - F.pow(alike, F.lit(depth)), F.lit(TREES))
    found, missing = ties.distinct().filter(alike >= threshold).agg(F.count("*"), F.sum(1 / chance - 1)).first()
    missing = (missing or 0.0) + UNSEEN * (1 - recall(threshold, depth))
    return found / (found + missing) if found else 0.0


_SEEDS = splitmix(np.arange(1001, 1001 + 2 * SKETCH, dtype=np.uint64)).astype(np.uint32)


def _signature(shingles: np.ndarray) -> np.ndarray:
    """SKETCH min-hashes of a set, 32 bits each."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        h = (x[at : at + 2048, None] ^ _SEEDS[None, :SKETCH]) * (_SEEDS[None, SKETCH:] | np.uint32(1))
        h ^= h >> np.uint32(15)
        np.minimum(best, h.min(axis=0), out=best)
    return best


def _class_of(shingles: np.ndarray) -> bytes:
    """A 128-bit name of the set."""
    a = np.add.reduce(splitmix(shingles + np.uint64(0x1234567)), dtype=np.uint64)
    b = np.bitwise_xor.reduce(splitmix(shingles ^ np.uint64(0x5DEECE66D5DEECE6))) + np.uint64(len(shingles))
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def fingerprints(df: DataFrame, id_column: str, text_column: str, words: int) -> DataFrame:
    """doc_id, class (null without words), n (the set's size) and sketch of every text: SKETCH min-hashes of two bytes each,
    and the first ones again, so that each tree's sequence is a run of bytes of it."""
    rows = pick(df, doc_id=id_column, text=text_column)

    def run(batches):
        for batch in slices(batches, "text"):
            hashes, offset = word_hashes(strings(batch, "text"))
            names, sizes, sketches = [], [], []
            for a, b in pairwise(offset.tolist()):
                s = shingle_hashes(hashes[a:b], words)
                sizes.append(len(s))
                names.append(_class_of(s) if len(s) else None)
                if not len(s):
                    sketches.append(None)
                    continue
                short = (_signature(s) & np.uint32(0xFFFF)).astype(">u2")
                sketches.append(np.concatenate([short, short[: LONGEST - STEP]]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], names=["doc_id", "class", "n", "sketch"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, class binary, n long, sketch binary")


def _tie(agree: int):
    """Ties (a, b, and how many min-hashes agree) that connect, within each group, the classes whose
    sketches agree enough.  Classes under the same child have been compared at a step before, those of
    one block are compared in the task of that block alone: what connects them is not told again."""

    def handle(table: pa.Table) -> pa.RecordBatch:
        name, child, own = (table.column(c).to_numpy() for c in ("cid", "child", "own"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), ">u2").reshape(len(name), -1)[:, :SKETCH].astype(np.uint16)
        group = np.stack([table.column(c).to_numpy() for c in ("key", "first", "second")])
        begin = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(axis=0)]))
        end = np.append(begin[1:], len(name))
        two = begin[end - begin == 2]
        alike = (sketch[two] == sketch[two + 1]).sum(axis=1)
        told = (alike >= agree) & (child[two] != child[two + 1])
        told &= (own[two] != own[two + 1]) | (group[1, two] == group[2, two])
        a, b, same = [name[two[told]]], [name[two[told] + 1]], [alike[told]]
        for s, e in zip(begin[end - begin > 2].tolist(), end[end - begin > 2].tolist(), strict=True):
            part = child[s:e] if group[1, s] == group[2, s] else own[s:e]
            for i, j, n in _links(sketch[s:e], child[s:e], part, agree):
                a.append(name[s + i])
                b.append(name[s + j])
                same.append(n)
        a, b, same = np.hstack(a), np.hstack(b), np.hstack(same)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64()), pa.array(same, pa.int32())], names=["a", "b", "agree"])

    return lambda batches: each_group(batches, "key", handle)


def _links(sketch: np.ndarray, child: np.ndarray, part: np.ndarray, agree: int) -> list[tuple[int, int, int]]:
    """Pairs (i, j, how many min-hashes agree) that connect the rows whose sketches agree enough, none of
    them between rows that pairs of the same child or part connect by themselves."""
    n, links = len(sketch), []
    known, clump = np.arange(n), np.full(n, -1)
    if len(np.unique(child)) < n or len(np.unique(part)) < n:
        left = np.arange(n)
        while len(left):  # breadth first, over pairs that are told elsewhere
            queue, left = [left[0]], left[1:]
            clump[queue[0]] = queue[0]
            while queue and len(left):
                here = queue.pop()
                hit = ((child[left] == child[here]) | (part[left] == part[here])) & ((sketch[left] == sketch[here]).sum(axis=1) >= agree)
                clump[left[hit]] = clump[here]
                queue += left[hit].tolist()
                left = left[~hit]
    else:
        clump = known
    waiting = np.ones(n, bool)
    for start in range(n):
        if not waiting[start]:
            continue
        queue = np.flatnonzero(clump == clump[start]).tolist()
        waiting[queue] = False
        while queue:
            here = queue.pop()
            left = np.flatnonzero(waiting)
            if not len(left):
                break
            alike = (sketch[left] == sketch[here]).sum(axis=1)
            hit = np.flatnonzero(alike >= agree)
            if not len(hit):
                continue
            reached, at = np.unique(clump[left[hit]], return_index=True)
            links += [(int(here), int(left[hit[k]]), int(alike[hit[k]])) for k in at.tolist()]
            more = np.flatnonzero(waiting & np.isin(clump, reached))
            waiting[more] = False
            queue += more.tolist()
    return links


def forest_ties(classes: DataFrame, threshold: float, block: int, target: float = TARGET_RECALL) -> tuple[DataFrame, int]:
    """Ties between classes (cid, sketch) by the walk through the prefix tries, and the depth at which
    it stopped."""

    def prefix(depth: int) -> Column:
        return F.xxhash64("tree", F.col("label").substr(1, 2 * depth))

    steps = depths(threshold)
    label = F.expr(f"substring(sketch, tree * {2 * STEP} + 1, {2 * LONGEST})")
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    leaves = classes.select("cid", "sketch", trees.alias("tree")).select("cid", F.col("tree").cast("byte").alias("tree"), label.alias("label"))
    leaves = leaves.select("cid", "tree", prefix(steps[-1]).alias("root"))
    crowded = durable(leaves.groupBy("root").agg(F.count("*").alias("size")).filter("size > 1").select("root"))
    forest = leaves.join(if_small(crowded), "root").select("cid", "tree").join(classes.select("cid", "sketch"), "cid")
    forest = durable(forest.withColumn("label", label).sortWithinPartitions("tree", "label"))
    ties, used = None, [crowded]
    for nth, depth in enumerate(steps):
        child = prefix(steps[nth - 1]) if nth else F.col("cid")
        keyed = forest.select("cid", "sketch", prefix(depth).alias("key"), child.alias("child"))
        nodes = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("child").alias("least"), F.max("child").alias("most"))
        nodes = durable(nodes.filter("size > 1 AND least <> most").select("key", "size"))
        tasks = block_pairs(keyed.join(if_small(nodes), "key"), "key", "cid", F.col("size"), 2 * block)
        tasks = gathered(tasks.select("key", "first", "second", "own", "cid", "child", "sketch"), "key")
        found = durable(tasks.mapInArrow(_tie(least_agreement(threshold)), "a long, b long, agree int").distinct())
        ties = found if ties is None else ties.unionAll(found)
        used.append(nodes)
        if depth == steps[-1] or estimated_recall(ties, threshold, depth) >= target:
            break
    release(forest, *used)
    return ties, depth


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Exact intersection sizes of all pairs of two lists of sorted sets, by ranges of their elements
    so that no more than about AT_ONCE are sorted together."""
    if len(x) * len(y) <= 16:
        return np.array([[len(np.intersect1d(p, q, assume_unique=True)) for q in y] for p in x], dtype=np.int64).reshape(len(x), len(y))
    sets = [*x, *y]
    parts = -(-sum(map(len, sets)) // AT_ONCE)
    total = np.zeros((len(x), len(y)), np.float64)
    edges = np.array([(k << 64) // parts for k in range(1, parts)], dtype=np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(s, edges), [len(s)]]).astype(np.int64) for s in sets]
    for k in range(parts):
        some = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)]
        owner = np.repeat(np.arange(len(some)), [len(s) for s in some])
        _, column, count = np.unique(np.concatenate(some), return_inverse=True, return_counts=True)
        shared = count > 1
        place = np.cumsum(shared) - 1
        use = shared[column]
        owner, column = owner[use], place[column[use]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        width = int(shared.sum())
        for at in range(0, width, 8192):
            lo, hi = np.searchsorted(column, [at, at + 8192])
            bits = np.zeros((len(sets), min(8192, width - at)), np.float32)
            bits[owner[lo:hi], column[lo:hi] - at] = 1
            total += bits[: len(x)] @ bits[len(x) :].T
    return np.rint(total).astype(np.int64)


def spread(linked: np.ndarray, labels_x: np.ndarray, labels_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the rows and columns of a link matrix after taking the smallest label reachable."""
    large = np.iinfo(np.int64).max
    while True:
        x = np.minimum(labels_x, np.where(linked, labels_y[None, :], large).min(axis=1, initial=large))
        y = np.minimum(labels_y, np.where(linked, x[:, None], large).min(axis=0, initial=large))
        if (x == labels_x).all() and (y == labels_y).all():
            return x, y
        labels_x, labels_y = x, y


def _verify(threshold: float):
    def handle(table: pa.Table) -> pa.RecordBatch:
        group = np.stack([table.column(c).to_numpy() for c in ("comp", "first", "second")])
        begin = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(axis=0)]))
        end = np.append(begin[1:], group.shape[1])
        name, raw = table.column("class").to_pylist(), table.column("shingles").to_pylist()
        weight, own = table.column("weight").to_numpy(), table.column("own").to_numpy()
        out: list[list] = [[], [], []]
        for s, e in zip(begin.tolist(), end.tolist(), strict=True):
            rows = list({name[i]: i for i in range(s, e)}.values())  # a class given twice counts once
            rows.sort(key=name.__getitem__)
            first, second = group[1, s], group[2, s]
            x = [i for i in rows if own[i] == first]
            y = x if first == second else [i for i in rows if own[i] == second]
            if not x or not y:
                continue
            sets = {i: np.frombuffer(raw[i], np.uint64) for i in rows}
            inter = overlaps([sets[i] for i in x], [sets[i] for i in y])
            nx, ny = np.array([len(sets[i]) for i in x]), np.array([len(sets[i]) for i in y])
            linked = inter >= threshold * (nx[:, None] + ny[None, :] - inter) - 1e-9
            order = {i: k for k, i in enumerate(rows)}
            lx, ly = np.array([order[i] for i in x]), np.array([order[i] for i in y])
            if first == second:
                np.fill_diagonal(linked, False)
            root_x, root_y = spread(linked, lx, ly)
            links = [(x, linked @ weight[y], root_x)] + ([] if first == second else [(y, weight[x] @ linked, root_y)])
            for members, total, root in links:
                out[0] += [name[i] for i in members]
                out[1] += total.tolist()
                out[2] += [name[rows[r]] for r in root]
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["class", "links", "root"])

    return lambda batches: each_group(batches, "comp", handle)


def join(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, threshold: float = 0.8, block: int = 256) -> DataFrame:
    """doc_id, class_id, n_links and kept for every row of df."""
    prints = durable(fingerprints(df, id_column, text_column, words))
    classes = prints.filter("class IS NOT NULL").groupBy("class").agg(F.count("*").alias("weight"), F.min("doc_id").alias("doc"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"))
    classes = durable(classes.withColumn("cid", F.monotonically_increasing_id()))
    ties, _ = forest_ties(classes, threshold, block)
    groups = durable(connected(ties, "a", "b").select(F.col("node").alias("cid"), F.col("component").alias("comp")))

    # the sets of all classes in groups, taken again from the texts of one document each
    sets_of = groups.join(classes.select("cid", "n"), "cid").groupBy("comp")
    size = durable(sets_of.agg(F.greatest(F.count("*"), F.ceil(F.sum("n") * block / BLOCK_SHINGLES)).alias("size")))
    wanted = durable(groups.join(if_small(size), "comp").join(classes.select("cid", "class", "weight", "doc"), "cid"))
    rows = pick(df, doc=id_column, text=text_column)
    needed = wanted.select("doc", "class", "comp", "size", "weight")
    lacking = needed.filter("doc IS NULL").drop("doc")
    needed, lacking = if_small(needed), if_small(lacking)
    texts = rows.join(needed, "doc")

    def sets(batches):
        for batch in slices(batches, "text"):
            hashes, offset = word_hashes(strings(batch, "text"))
            kept, blobs = [], []
            for i, (a, b) in enumerate(pairwise(offset.tolist())):
                s = shingle_hashes(hashes[a:b], words)
                if len(s) and _class_of(s) == batch.column("class")[i].as_py():  # an id may stand for several texts
                    kept.append(i)
                    blobs.append(s.tobytes())
            small = batch.select(["class", "comp", "size", "weight"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*small.columns, pa.array(blobs, pa.binary())], names=["class", "comp", "size", "weight", "shingles"])

    held = texts.select("text", "class", "comp", "size", "weight").mapInArrow(sets, "class binary, comp long, size long, weight long, shingles binary")

    def named(batches):
        for batch in slices(batches, "text"):
            hashes, offset = word_hashes(strings(batch, "text"))
            found = [s for s in (shingle_hashes(hashes[a:b], words) for a, b in pairwise(offset.tolist())) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_class_of(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["class", "shingles"])

    if not lacking.isEmpty():  # classes of rows without an id go by their name
        own = rows.filter("doc IS NULL").select("text").mapInArrow(named, "class binary, shingles binary").join(lacking, "class")
        held = held.unionByName(own.groupBy("class", "comp", "size", "weight").agg(F.any_value("shingles").alias("shingles")))
    tasks = gathered(block_pairs(held, "comp", "class", F.col("size"), block), "comp")
    checked = durable(tasks.mapInArrow(_verify(threshold), "class binary, links long, root binary"))

    links = durable(checked.groupBy("class").agg(F.sum("links").alias("links")))
    root = durable(connected(checked.filter("class <> root"), "class", "root"))
    about = classes.select("class", "weight", "doc").join(links, "class", "left").join(root.select(F.col("node").alias("class"), "component"), "class", "left")
    about = durable(about.select("class", "weight", "doc", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "class").alias("component")))
    smallest = durable(about.groupBy("component").agg(F.min("doc").alias("class_id")))
    placed = durable(about.join(smallest, "component").select("class", "component", "class_id", (F.col("links") + F.col("weight") - 1).alias("n_links")))
    release(classes, groups, size, wanted, checked, links, root, about, smallest)
    about = placed
    out = prints.select("doc_id", "class").join(about, "class", "left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
