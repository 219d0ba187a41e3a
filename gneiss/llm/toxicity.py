"""Operator 6: toxicity from the nearest labelled examples by exact TF-IDF cosine.

Labelled examples (at most `examples`, half of each class where there are as many) are taken by a
hash of the id.  Terms are all words of all examples; their document frequencies are counted over the
whole corpus.  Words whose presence depends on the label among the examples (chi-square test, at most
`terms`) weigh more: a vector is the unit TF-IDF vector of all words beside the unit vector of these
words alone, LABEL_SHARE of the square of the norm in the latter (none where a text has none of them),
so that a cosine is 1 exactly where both agree.  A word of no example would only scale all cosines of
a text alike and is left out.  Examples lie in an inverted index, alike ones next to each other, in
blocks with each frequent term's largest weight per block; a frequent term's postings of a block are
kept as a row of weights.  Queries read the postings of their rarer terms, and then those of the
frequent terms in the blocks that can still reach the k-th best cosine, and in no others; all sums
are of double precision, so their neighbours are exact Votes
weighted by similarity, corrected for the classes' sampling rates, give a raw score that isotonic
regression on leave-one-out scores turns into a probability.

A text without any word of an example (null and empty ones too) has no neighbours and gets the share
of toxic examples among the examples without a word.  Without examples every score is 0.  Conflicting
labels of an id count as toxic; repeated rows and other columns have no effect on a row's result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.base import pick, slices, strings
from gneiss.llm.words import word_hashes

BLOCK = 64
FREQUENT = 0.06  # a term of more than this part of the examples has bounds
QUERIES = 64  # handled together, at most
POSTINGS = 1_500_000  # read together, unless one query has more
SLACK = 1e-6  # on bounds, which are of single precision
LABEL_SHARE = 0.8  # of a vector's square, in the words that depend on the label


def _flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in all binary values of a column, one after another, and how many are in each."""
    chunks = column.chunks
    size = np.concatenate([np.zeros(0, np.int64), *(pc.binary_length(c).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize for c in chunks)])
    parts = []
    for c in chunks:
        ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1] if len(c) else [0]
        if ends[-1] > ends[0]:
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind))
    return np.concatenate([np.zeros(0, kind), *parts]), size.astype(np.int64)


def _ranges(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places begin[i], begin[i] + 1, ... (size[i] of them) one after another, and size."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(begin - (end - size), size), size


def _arranged(offset: np.ndarray, rows: np.ndarray, lines: int, words: int, kinds: int = 8, leading: int = 300) -> np.ndarray:
    """An order in which alike vectors are close: those with rows from `words` on first, then by
    kind (means of the most frequent rows' directions, as a few rounds of k-means find them), then by
    the number of terms."""
    n, size = len(offset) - 1, np.diff(offset)
    owner = np.repeat(np.arange(n), size)
    told = np.bincount(owner, weights=rows >= words, minlength=n) == 0
    often = np.argsort(-np.bincount(rows, minlength=lines), kind="stable")[:leading]
    column = np.full(lines, -1)
    column[often] = np.arange(len(often))
    own = column[rows]
    has = np.zeros((n, len(often)))
    has[owner[own >= 0], own[own >= 0]] = 1
    has /= np.maximum(np.linalg.norm(has, axis=1, keepdims=True), 1e-9)
    centre = has[np.linspace(0, n - 1, kinds).astype(int)] if n else has
    kind = np.zeros(n, np.int64)
    for _ in range(10 if n else 0):
        kind = np.argmax(np.round(has @ centre.T, 9), axis=1)
        centre = np.stack([has[kind == c].mean(axis=0) if (kind == c).any() else centre[c] for c in range(len(centre))])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    return np.lexsort((np.arange(n), size, kind, told))


@dataclass
class Index:
    terms: np.ndarray  # sorted word hashes
    idf: np.ndarray
    k: int = 16
    label: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted places in terms of the words that depend on the label
    prior: float = 0.0
    empty: float = 0.0  # score without any term
    steps: np.ndarray = field(default_factory=lambda: np.zeros(0))  # isotonic calibration
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    example: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # ids by place
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))  # by place
    vote: np.ndarray = field(default_factory=lambda: np.zeros(0))  # inverse sampling rate by place

    def bags(self, words: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and count of every distinct known word of texts."""
        if not len(self.terms) or not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == words)
        text = np.searchsorted(offset, hit, side="right") - 1
        code, count = np.unique(text * len(self.terms) + at[hit], return_counts=True)
        return code // len(self.terms), code % len(self.terms), count

    def vectors(self, text: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors of n texts: offsets of each, rows (terms, then those of `label`) and weights."""
        w = (1 + np.log(count)) * self.idf[term]
        row = np.full(len(self.terms) + 1, -1, np.int32)
        row[self.label] = np.arange(len(self.label)) + len(self.terms)
        row = row[term]
        own = row >= 0
        whole = np.bincount(text, weights=w * w, minlength=n)
        part = np.bincount(text[own], weights=w[own] ** 2, minlength=n)
        one = np.sqrt(np.where(part > 0, 1 - LABEL_SHARE, 1.0) / np.where(whole > 0, whole, 1))
        two = np.sqrt(LABEL_SHARE / np.where(part > 0, part, 1))
        weights = np.concatenate([w * one[text], w[own] * two[text[own]]])
        rows, text = np.concatenate([term.astype(np.int32), row[own]]), np.concatenate([text, text[own]])
        order = np.argsort(text, kind="stable")
        return np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]), rows[order], weights[order]

    def build(self, offset: np.ndarray, rows: np.ndarray, weights: np.ndarray, lines: int) -> None:
        """The index of unit vectors in the order of places, over rows 0 to lines - 1."""
        n = len(offset) - 1
        blocks = max(1, -(-n // BLOCK))
        place = np.repeat(np.arange(n), np.diff(offset))
        size = np.bincount(rows, minlength=lines)
        common = np.flatnonzero(size > max(2, FREQUENT * n))
        self.slot = np.full(lines, -1, np.int32)  # of a frequent row
        self.slot[common] = np.arange(len(common))
        often = self.slot[rows] >= 0
        self.dense = np.zeros((blocks, len(common), BLOCK))
        self.dense[place[often] // BLOCK, self.slot[rows[often]], place[often] % BLOCK] = weights[often]
        self.bound = np.ascontiguousarray(self.dense.max(axis=2).T.astype(np.float32))
        by = np.argsort(rows[~often], kind="stable")  # places rise within a row
        self.posting, self.weight = place[~often][by].astype(np.int32), weights[~often][by]
        self.pointer = np.concatenate([[0], np.cumsum(np.bincount(rows[~often], minlength=lines))])

    def nearest(self, offset: np.ndarray, rows: np.ndarray, weights: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, place and cosine of the k nearest examples that share a term with each of the queries
        (vectors as from `vectors`), the nearest first; skip: a place that is left out, for each."""
        out, a = [], 0
        length = np.concatenate([[0], np.cumsum(self.pointer[rows + 1] - self.pointer[rows])])[offset]  # postings before each query
        while a < len(offset) - 1:
            b = int(np.searchsorted(length, length[a] + POSTINGS, side="right")) - 1
            b = min(max(b, a + 1), a + QUERIES, len(offset) - 1)
            some = offset[a : b + 1]
            got = self._nearest(some - some[0], rows[some[0] : some[-1]], weights[some[0] : some[-1]], None if skip is None else skip[a:b])
            out.append((got[0] + a, got[1], got[2]))
            a = b
        empty = np.zeros(0, np.int64)
        return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (empty, empty, np.zeros(0))

    def _nearest(self, offset: np.ndarray, rows: np.ndarray, weights: np.ndarray, skip: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m, (blocks, frequent, _) = len(offset) - 1, self.dense.shape
        query, slot = np.repeat(np.arange(m), np.diff(offset)), self.slot[rows]
        rare = slot < 0
        by = np.flatnonzero(rare)
        by = by[np.argsort(rows[by], kind="stable")]  # a row's postings are read by all its queries at once
        begin = self.pointer[rows[by]]
        at, size = _ranges(begin, self.pointer[rows[by] + 1] - begin)
        cell = np.repeat(query[by] * (blocks * BLOCK), size) + self.posting[at]
        score = np.zeros(m * blocks * BLOCK)
        if len(at):
            score = np.bincount(cell, weights=self.weight[at] * np.repeat(weights[by], size), minlength=len(score))
        score = score.reshape(m, blocks, BLOCK)
        if skip is not None:
            score[np.arange(m), skip // BLOCK, skip % BLOCK] = -4.0  # below any cosine
        # the k-th best block is a lower bound of the k-th best cosine: no other block can matter
        ask = np.zeros((m, frequent))
        ask[query[~rare], slot[~rare]] = weights[~rare]
        top = score.max(axis=2)
        alive = top + ask.astype(np.float32) @ self.bound >= self._kth(top)[:, None] - SLACK
        for b in np.flatnonzero(alive.any(axis=0)).tolist():
            some = np.flatnonzero(alive[:, b])
            score[some, b] += ask[some] @ self.dense[b]
        score = np.round(score, 9)
        least = np.maximum(self._kth(score.max(axis=2)), 1e-9)
        query, block, place = np.nonzero(score >= least[:, None, None])
        cosine = score[query, block, place]
        place += block * BLOCK
        order = np.lexsort((place, -cosine, query))
        query, place, cosine = query[order], place[order], cosine[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        best = nth < self.k
        return query[best], place[best], np.minimum(cosine[best], 1.0)

    def _kth(self, top: np.ndarray) -> np.ndarray:
        """The k-th largest of each row, 0 where there are fewer."""
        return np.maximum(np.partition(top, -self.k, axis=1)[:, -self.k], 0.0) if top.shape[1] >= self.k else np.zeros(len(top))

    def raw(self, n: int, query: np.ndarray, place: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Votes of the neighbours of n queries, shrunk towards the share of toxic examples."""
        w = cosine**2 * self.vote[place]
        return (np.bincount(query, weights=w * self.toxic[place], minlength=n) + 0.5 * self.prior) / (np.bincount(query, weights=w, minlength=n) + 0.5)

    def score(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.steps, self.values) if len(self.steps) else raw


def fit(
    df: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    label_id_column: str | None = None,
    examples: int = 8000,
    terms: int = 4096,
    chi_square: float = 25.0,
    least_expected: float = 0.3,
) -> Index:
    """An index of at most `examples` labelled rows over all their words, of which at most `terms` weigh more."""
    spark = df.sparkSession
    label = pick(labels, doc_id=label_id_column or id_column, toxic=label_column).filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
    label = label.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    have = {r["toxic"]: r["n"] for r in label.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    deal = F.xxhash64("doc_id", F.lit("toxicity"))
    cap = examples // 2
    chosen = None
    for value in (0, 1):
        part = label.filter(F.col("toxic") == value).withColumn("deal", deal).orderBy("deal", "doc_id").limit(cap)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = pick(df, doc_id=id_column, text=text_column).join(F.broadcast(chosen), "doc_id")  # at most `examples` rows

    def bags(batches):
        for batch in slices(batches, "text"):
            words, offset = word_hashes(strings(batch, "text"))
            got = [np.unique(words[a:b], return_counts=True) for a, b in pairwise(offset.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([w.tobytes() for w, _ in got], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in got], pa.binary())], names=["doc_id", "toxic", "words", "counts"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.select("doc_id", "toxic", "text").mapInArrow(bags, f"doc_id {kind}, toxic int, words binary, counts binary").toArrow().sort_by("doc_id")
    toxic, ids = np.array(got.column("toxic").to_pylist(), dtype=np.int64), got.column("doc_id").to_pylist()
    words, size = _flat(got.column("words"), np.uint64)
    counts, _ = _flat(got.column("counts"), np.int32)
    n = len(toxic)
    del got
    rate = np.array([min(1.0, cap / max(1, have.get(v, 0))) for v in (0, 1)])

    # terms, and those of them that depend on the label
    edge = np.concatenate([[0], np.cumsum(size)])
    digest = [hashlib.blake2b(words[i:j].tobytes() + counts[i:j].tobytes() + bytes([y])).digest() for i, j, y in zip(edge, edge[1:], toxic.tolist(), strict=False)]
    alone = np.zeros(n, bool)
    alone[list({d: i for i, d in enumerate(digest)}.values())] = True  # copies count once
    word, term = np.unique(words, return_inverse=True)
    term, text = term.astype(np.int32), np.repeat(np.arange(n, dtype=np.int32), size)
    del words, digest
    own = alone[text]
    m, m1 = int(alone.sum()), int(toxic[alone].sum())
    a = np.bincount(term[own & (toxic[text] == 1)], minlength=len(word)).astype(float)
    total = np.bincount(term[own], minlength=len(word)).astype(float)
    b = total - a
    below = (a + b) * (m - a - b) * m1 * (m - m1)
    chi = np.where(below > 0, m * (a * (m - m1 - b) - b * (m1 - a)) ** 2 / np.maximum(below, 1), 0)
    expected = total * min(m1, m - m1) / max(1, m)  # of the rarer label, were it independent
    kept = np.flatnonzero((chi >= chi_square) & (expected >= least_expected))
    kept = kept[np.argsort(-chi[kept], kind="stable")[:terms]]
    del own, a, b, total, below, chi, expected

    # document frequencies of the terms over the whole corpus
    shared = spark.sparkContext.broadcast(word)

    def counted(batches):
        here = shared.value
        times, seen = np.zeros(len(here) + 1, np.int64), 0
        for batch in slices(batches, "text"):
            words, offset = word_hashes(strings(batch, "text"))
            seen += batch.num_rows
            if len(here) and len(words):
                at = np.minimum(np.searchsorted(here, words), len(here) - 1)
                hit = np.flatnonzero(here[at] == words)
                doc = np.searchsorted(offset, hit, side="right")
                times[: len(here)] += np.bincount(np.unique(doc * len(here) + at[hit]) % len(here), minlength=len(here))
        times[-1] = seen
        found = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times[found])], names=["term", "n"])

    df_rows = pick(df, text=text_column).mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(len(word) + 1)
    frequency[df_rows.column("term").to_numpy()] = df_rows.column("n").to_numpy()
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1

    index = Index(word, idf, label=np.sort(kept))
    vote = np.where(toxic == 1, 1 / rate[1], 1 / rate[0]) if n else np.zeros(0)
    index.prior = float(vote @ toxic / vote.sum()) if n else 0.0
    bare = size == 0
    index.empty = float((vote[bare] @ toxic[bare] + index.prior) / (vote[bare].sum() + 1)) if n else 0.0
    offset, rows_, weights = index.vectors(text, term, counts, n)
    del text, term, counts
    lines = len(word) + len(kept)
    order = _arranged(offset, rows_, lines, len(word))
    order = order[~bare[order]]
    at, length = _ranges(offset[order], np.diff(offset)[order])
    offset, rows_, weights = np.concatenate([[0], np.cumsum(length)]), rows_[at], weights[at]
    del at
    index.example = np.array([ids[i] for i in order])
    index.toxic, index.vote = toxic[order].astype(float), vote[order]
    index.build(offset, rows_, weights, lines)
    # calibration: leave-one-out scores of the examples themselves
    if len(order):
        index.steps, index.values = isotonic(index.raw(len(order), *index.nearest(offset, rows_, weights, np.arange(len(order)))), index.toxic, index.vote)
    return index


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted least-squares non-decreasing fit (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weighted sum, weight, weighted x
    for i in order:
        pools.append([y[i] * w[i], w[i], x[i] * w[i]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.clip([p[0] / p[1] for p in pools], 0.0, 1.0)


def score(df: DataFrame, index: Index, id_column: str = "doc_id", text_column: str = "text", evidence: bool = True) -> DataFrame:
    """doc_id, score (the probability of label 1) and, unless evidence is False, the nearest examples
    (id, similarity, toxic)."""
    rows = pick(df, doc_id=id_column, text=text_column)
    shared = df.sparkSession.sparkContext.broadcast(index)  # bounded by the words of `examples` texts
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        ix = shared.value
        for batch in slices(batches, "text"):
            n = batch.num_rows
            bags = ix.bags(*word_hashes(strings(batch, "text")))
            near = ix.nearest(*ix.vectors(*bags, n)) if len(ix.example) else (np.zeros(0, np.int64),) * 3
            known = np.bincount(bags[0], minlength=n) > 0
            scores = np.where(known, ix.score(ix.raw(n, *near)), ix.empty) if len(ix.example) else np.full(n, ix.empty)
            columns, names = [batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"]
            if evidence:
                parts = [pa.array(ix.example[near[1]].tolist(), batch.schema.field("doc_id").type), pa.array(near[2], pa.float64()), pa.array(ix.toxic[near[1]].astype(np.int32))]
                ends = np.concatenate([[0], np.cumsum(np.bincount(near[0], minlength=n))]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, names=["example", "similarity", "toxic"])))
                names.append("evidence")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, score double" + f", evidence array<struct<example:{kind},similarity:double,toxic:int>>" * evidence)
