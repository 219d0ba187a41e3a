"""Operators 4 and 7 against all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import components, jaccard, neardup, queries
from gneiss.llm.base import durable
from tests.llm import cases


def shingles(text):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(fold))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def linked_rows(n, near):
    """Links per row and the members of each row's component."""
    links, parent = [0] * n, list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if near(i, j):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    return links, [find(i) for i in range(n)]


def expected(ids, near):
    links, root = linked_rows(len(ids), near)
    least = {}
    for i, r in zip(ids, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return Counter((i, least.get(r), k) for i, r, k in zip(ids, root, links, strict=True))


def test_jaccard_query(spark, tmp_path):
    data = cases.texts()
    sets = [shingles(t) for _, t in data]
    near = lambda i, j: bool(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9
    rows = queries.op4_lsh_forest_jaccard(spark, cases.write(cases.documents(spark), tmp_path, "documents")).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in rows) == expected([i for i, _ in data], near)
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)


def test_jaccard_links_rows_without_an_id(spark):
    rng = random.Random(21)
    base, other = cases.prose(rng, 80), cases.prose(rng, 80)
    data = [(7, base), (None, base + " tail"), (None, base + " tail"), (None, "head " + base), (None, other), (None, other + " tail"), (8, cases.prose(rng, 40))]
    sets = [shingles(t) for _, t in data]
    near = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9
    rows = jaccard.join(spark.createDataFrame(data, "doc_id long, text string")).collect()
    want = expected([i for i, _ in data], near)
    assert want[7, 7, 3] == 1 and want[None, None, 1] == 2
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in rows) == want


def test_jaccard_large_group_in_small_blocks(spark):
    rng = random.Random(9)
    base = cases.prose(rng, 60)
    data = [(i, cases.edited(rng, base, i % 3)) for i in range(90)]
    sets = [shingles(t) for _, t in data]
    near = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9
    rows = jaccard.join(spark.createDataFrame(data, "doc_id long, text string"), block=8).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in rows) == expected([i for i, _ in data], near)


def test_jaccard_of_nothing(spark):
    assert jaccard.join(cases.nothing(spark)).count() == 0


def test_prefix_depth_meets_the_target():
    depth = jaccard.prefix_depth(0.8)
    assert jaccard.recall(0.8, depth) >= jaccard.TARGET_RECALL > jaccard.recall(0.8, depth + 1)


def forest(spark, data, target):
    prints = jaccard.fingerprints(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string"), "doc_id", "text", 5)
    ties, depth = jaccard.forest_ties(durable(prints.select(F.col("doc_id").alias("cid"), "sketch")), 0.8, 256, target)
    return {(r.a, r.b) for r in ties.collect()}, depth


def test_links_connect_what_agrees_and_no_more():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(3, 40))
        sketch = rng.integers(0, 3, (n, 8)).astype(np.uint16)
        child, part = rng.integers(0, 6, n), rng.integers(0, 3, n)
        near = lambda i, j, sketch=sketch: (sketch[i] == sketch[j]).sum() >= 5
        found = jaccard._links(sketch, child, part, 5)
        assert all(near(i, j) and child[i] != child[j] and part[i] != part[j] for i, j, _ in found)
        silent = lambda i, j, near=near, child=child, part=part: near(i, j) and (child[i] == child[j] or part[i] == part[j])
        pairs = {frozenset((i, j)) for i, j, _ in found}
        _, want = linked_rows(n, near)
        _, got = linked_rows(n, lambda i, j, pairs=pairs, silent=silent: frozenset((i, j)) in pairs or silent(i, j))
        assert [[a == b for b in want] for a in want] == [[a == b for b in got] for a in got]
        _, alone = linked_rows(n, silent)
        assert len(found) == len(set(alone)) - len(set(want))


def test_forest_shortens_prefixes_only_as_far_as_needed(spark):
    rng = random.Random(31)
    base = [cases.prose(rng, 250) for _ in range(60)]
    close = base + [t + " one more" for t in base]
    ties, depth = forest(spark, close, 0.999)
    assert depth == jaccard.LONGEST and all((i, 60 + i) in ties for i in range(60))
    loose = base + [cases.edited(rng, t, 5) for t in base]  # similarity near 0.82
    ties, depth = forest(spark, loose, 0.999)
    assert depth < jaccard.LONGEST
    near = [i for i in range(60) if len(shingles(base[i]) & shingles(loose[60 + i])) >= 0.8 * len(shingles(base[i]) | shingles(loose[60 + i]))]
    assert len(near) > 20 and all((i, 60 + i) in ties for i in near)
    assert jaccard.depths(0.8)[-1] == jaccard.prefix_depth(0.8) and jaccard.depths(0.8)[0] == jaccard.LONGEST


@pytest.mark.parametrize("at_once", [400_000, 100])
def test_overlaps_by_sets(monkeypatch, at_once):
    monkeypatch.setattr(jaccard, "AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 500, n).astype(np.uint64) << np.uint64(55)) for n in (0, 1, 30, 200, 400, 7, 90)]
    assert (jaccard.overlaps(sets, sets) == [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]).all()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100)}


def vectors():
    rng = np.random.default_rng(4)
    rows = []
    for c in range(30):
        centre = rng.normal(size=64)
        for k in range(1 + c % 6):
            rows.append((centre + rng.normal(size=64) * (0.35 if k % 2 else 0.2)).tolist())
    rows += [rows[3], rows[3], (np.array(rows[3]) * 4).tolist(), None, [], [0.0] * 64, [float("nan")] * 64, [1.0] * 63 + [None], [math.inf] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0], [-1.0, 0.5]]
    return [(i, v) for i, v in enumerate(rows)]


def test_near_duplicate_vectors_query(spark, tmp_path):
    data = vectors()
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in data] + [(None, data[0][1], 1, 2, "x")], "vec_id long, embedding array<double>, width int, own int, class string")
    rows = queries.op7_collision_counting_near_duplicates(spark, cases.write(df, tmp_path, "embeddings")).collect()

    def unit(v):
        if not v or None in v or not all(map(math.isfinite, v)) or not any(v):
            return None
        return np.array(v) / np.linalg.norm(v)

    every = [*data, (None, data[0][1])]
    units = [unit(v) for _, v in every]
    near = lambda i, j: units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.9
    assert Counter((r.vec_id, r.component_id, r.n_links) for r in rows) == expected([i for i, _ in every], near)


def test_near_duplicates_in_many_blocks(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(200, 32))
    data = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.15, 0.3, 0.4)])
    units = data / np.linalg.norm(data, axis=1)[:, None]
    near = units @ units.T >= 0.9
    rows = neardup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>"), block=64).collect()
    assert {r.vec_id: r.n_links for r in rows} == dict(enumerate((near.sum(axis=1) - 1).tolist()))


def close_vectors(n, width, near=400, seed=12):
    """Random vectors and a group around one, some at the threshold's cosine from another."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x[:near] = x[0] + rng.normal(size=(near, width)) * 0.2
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    cosine = rng.uniform(0.88, 0.93, (n, 1))
    return np.concatenate([x, (cosine * x + np.sqrt(1 - cosine**2) * y)[: n // 2]])


@pytest.mark.parametrize(("depth", "width"), [(1, 24), (2, 90)])
def test_tables_of_buckets_find_all_links_once(spark, monkeypatch, depth, width):
    monkeypatch.setattr(neardup, "SENT_BYTES", 10_000_000)
    data = close_vectors(800, width)
    units = data / np.linalg.norm(data, axis=1)[:, None]
    near = units @ units.T >= 0.9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    rows = neardup.near_duplicates(df, block=64, depth=depth).collect()
    assert near.sum() > 50_000
    got, want = np.array([r.n_links for r in sorted(rows, key=lambda r: r.vec_id)]), near.sum(axis=1) - 1
    assert (got <= want).all() and (want - got).sum() <= neardup.TABLE_MISS * near.sum()
    _, root = linked_rows(len(data), lambda i, j: near[i, j])
    smallest = {r: i for i, r in reversed(list(enumerate(root)))}
    assert sum(r.component_id != smallest[root[r.vec_id]] for r in rows) <= 1


@pytest.mark.parametrize("width", [3, 16, 64, 65, 100, 400])
def test_agreement_holds_for_every_width(width):
    rng, n = np.random.default_rng(5), 1500
    x, h = rng.normal(size=(n, width)), rng.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    h -= (x * h).sum(axis=1)[:, None] * x
    y = 0.9 * x + math.sqrt(0.19) * h / np.linalg.norm(h, axis=1)[:, None]
    same = (neardup._nearest(x, 40) == neardup._nearest(y, 40)).mean()
    assert same >= neardup._agreement(0.9)
    for depth in (1, 2):
        assert (1 - same**depth) ** neardup.tables_for(0.9, depth) <= neardup.TABLE_MISS


@pytest.mark.parametrize("width", [9, 16, 64, 90])
def test_pairs_at_the_threshold_reach_the_counts(width):
    rng, n = np.random.default_rng(6), 20_000
    x, h = rng.normal(size=(n, width)), rng.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    h -= (x * h).sum(axis=1)[:, None] * x
    y = 0.9001 * x + math.sqrt(1 - 0.9001**2) * h / np.linalg.norm(h, axis=1)[:, None]
    assert all(neardup._linked(x[a : a + 100], y[a : a + 100], 0.9).diagonal().all() for a in range(0, n, 100))


def test_what_is_sent_at_once_is_bounded(spark, monkeypatch):
    """Vectors used to be sent once for every block within reach, all at once: five times here."""
    assert neardup.plan_rounds([10, 10, 10, 95, 10, 10], 20) == [(0, 2, 1), (2, 3, 1), (3, 4, 5), (4, 6, 1)]
    monkeypatch.setattr(neardup, "SENT_BYTES", 0)
    sent, real = [], neardup.gathered

    def counted(df, key, parts):
        sent.append(df.count())
        return real(df, key, parts)

    monkeypatch.setattr(neardup, "gathered", counted)
    data = close_vectors(400, 64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    rows = neardup.near_duplicates(df, block=120, depth=0).collect()
    assert sum(sent) == 5 * 600 and len(sent) == 5 and max(sent) <= 2 * 600
    units = data / np.linalg.norm(data, axis=1)[:, None]
    assert {r.vec_id: r.n_links for r in rows} == dict(enumerate(((units @ units.T >= 0.9).sum(axis=1) - 1).tolist()))


def test_shuffle_files_go_with_the_query(spark):
    from gneiss.llm.base import swept

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    with pytest.raises(ValueError, match="inside"), swept(spark):
        assert spark.conf.get(setting) == "true"
        raise ValueError("inside")
    assert spark.conf.get(setting) == before


def test_no_vectors(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("m", [1, 16, 64])
def test_count_is_calibrated(m):
    p, need = neardup.WINDOW_RECALL, neardup.least_count(m)
    missed = sum(math.comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(need))
    assert missed <= neardup.MISS


def test_groups_stay_whole_over_batch_bounds():
    import pyarrow as pa

    from gneiss.llm.groups import each_group

    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randint(1, 9) for _ in range(rng.randint(1, 8))]
        rows = [(k // 3, k % 3, 0, v) for k, n in enumerate(sizes) for v in range(n)]
        table = pa.table({c: [r[i] for r in rows] for i, c in enumerate(("key", "first", "second", "v"))})
        seen = []

        def handle(part, seen=seen):
            seen.append([(r["key"], r["first"], r["second"], r["v"]) for r in part.to_pylist()])

        list(each_group(iter(table.to_batches(max_chunksize=rng.randint(1, 6))), "key", handle))
        assert [r for part in seen for r in part] == rows
        groups = [{r[:3] for r in part} for part in seen]
        assert all(not (a & b) for i, a in enumerate(groups) for b in groups[:i])
