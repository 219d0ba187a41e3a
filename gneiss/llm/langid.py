"""Operator 1: language identification by error-correcting output codes.

Every language has a codeword; for each bit a binary classifier over hashed byte n-grams tells which
half of the languages a text belongs to.  Decoding sums, for each codeword, the logistic losses of
the calibrated margins, weighted by how well the bit's classifier did on calibration rows, and takes
the nearest codeword (ties: the first language in alphabetical order).  A text whose two nearest
codewords are close is flagged ambiguous.

The classifiers are fitted on about `train_docs` labelled ids at most (40 a language at least), spread
evenly over the languages and chosen by a hash of the id (one text each, the smallest); prediction
reads whole texts.  The model takes 0.4 MB a language and bit.  Null texts and texts
without a letter are `und` with score 0; without any labelled row every text is.  Repeated rows and
other columns have no effect on a row's result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.base import durable, if_small, pick, release, slices, strings

BITS = 15  # of an n-gram's hash
ORDERS = (2, 3, 4)
SIZE = len(ORDERS) << BITS
UNIT = 1 << 32  # a row's n-grams are counted in this many parts of the row
UNDETERMINED = "und"
_ALNUM = re.compile(r"[^\W\d_]")
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _ALNUM.finditer(text)) if text else False


def _grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the n-grams that start at each byte, for each order, and starts and sizes of texts."""
    raw = [b" " + t.lower().encode("utf-8", "surrogatepass") + b"   " for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer((b"".join(raw) + b"   ").translate(_FOLD), np.uint8).astype(np.uint32)
    n = len(data) - 3
    out, gram, end = [], data[:n].copy(), np.cumsum(size)
    for k, order in enumerate(range(2, max(ORDERS) + 1)):
        gram = (gram << np.uint32(8)) | data[order - 1 : n + order - 1]
        for back in range(1, order):
            gram[end - back] = 0x20202020  # what would reach into the next text is taken as blanks
        hashed = (gram * np.uint32(2654435761) + np.uint32(order * 40503)) * np.uint32(2246822519)
        out.append((hashed >> np.uint32(32 - BITS)).astype(np.int32) + np.int32(k << BITS))
    return out, np.cumsum(size) - size, size


def codewords(n: int) -> np.ndarray:
    """A matrix of n rows of -1 and 1: every split of the languages in two for up to seven, else the
    best of many random codes by the smallest distance of two rows."""
    if n <= 1:
        return np.ones((n, 0), np.int8)
    if n <= 7:
        columns = [[1 if (i == 0) or (m >> (i - 1)) & 1 else -1 for i in range(n)] for m in range(2 ** (n - 1) - 1)]
        return np.array(columns, np.int8).T
    rng, best = np.random.default_rng(7), None
    width = math.ceil(10 * math.log2(n))
    for _ in range(64):
        code = np.where(np.argsort(rng.random((n, width)), axis=0) < n // 2, 1, -1).astype(np.int8)
        near = code.astype(np.int32) @ code.T.astype(np.int32)
        np.fill_diagonal(near, -width)
        if best is None or near.max() < best[0]:
            best = (near.max(), code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # bits x n-gram buckets, float32
    slope: np.ndarray
    shift: np.ndarray
    trust: np.ndarray  # of each bit
    sharpness: float

    def margins(self, texts: list[str]) -> np.ndarray:
        """Calibrated margins, texts x bits."""
        grams, start, size = _grams(texts)
        total = np.zeros((len(self.weights), len(texts)))
        for bit, w in enumerate(self.weights):
            for g in grams:
                total[bit] += np.add.reduceat(w[g], start)
        return total.T / np.sqrt(size)[:, None] * self.slope + self.shift

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """texts x languages."""
        out = np.zeros((len(margins), len(self.languages)))
        for i, row in enumerate(self.code):
            out[:, i] = np.logaddexp(0, -margins * row) @ self.trust
        return out

    def probabilities(self, losses: np.ndarray) -> np.ndarray:
        z = np.exp(-self.sharpness * (losses - losses.min(axis=1, keepdims=True)))
        return z / z.sum(axis=1, keepdims=True)


def fit(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", train_docs: int = 4000) -> Model:
    """A model from rows with a language.  What reaches the driver is a sum per language and n-gram
    bucket, in whole numbers, and the margins of the calibration rows: the model does not depend on
    how rows are dealt to tasks."""
    spark = df.sparkSession
    rows = pick(df, doc_id=id_column, text=text_column, lang=lang_column).filter("lang IS NOT NULL")
    count = durable(rows.groupBy("lang").agg(F.count("*").alias("n")))
    share = max(40, train_docs // max(1, count.count()))
    rate = count.select("lang", F.ceil(F.lit(1e6 * share) / F.col("n")).alias("wanted"))
    picked = rows.filter("text IS NOT NULL").withColumn("deal", F.xxhash64("doc_id", F.lit("language"))).join(if_small(rate), "lang")
    picked = picked.filter(F.pmod("deal", F.lit(1_000_000)) < F.col("wanted"))
    sample = durable(picked.groupBy("lang", "deal").agg(F.min("text").alias("text")).withColumn("for_fit", F.pmod(F.floor(F.col("deal") / 1_000_003), F.lit(10)) < 7))

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        rows_of: dict[str, int] = {}
        for batch in slices(batches, "text"):
            grams, start, size = _grams(strings(batch, "text"))
            for lang, a, n in zip(batch.column("lang").to_pylist(), start.tolist(), size.tolist(), strict=True):
                bucket, times = np.unique(np.concatenate([g[a : a + n] for g in grams]), return_counts=True)
                mine = total.setdefault(lang, np.zeros(SIZE, np.int64))
                mine[bucket] += times * UNIT // n
                rows_of[lang] = rows_of.get(lang, 0) + 1
        for lang, mine in total.items():
            bucket = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(bucket) + 1)), pa.array(np.append(bucket, -1)), pa.array(np.append(mine[bucket], rows_of[lang]))], names=["lang", "bucket", "total"])

    summed = sample.filter("for_fit").select("lang", "text").repartition(8, "lang", F.xxhash64("text")).mapInArrow(sums, "lang string, bucket long, total long")
    got = summed.groupBy("lang", "bucket").agg(F.sum("total").alias("total")).toArrow()
    languages = sorted(r["lang"] for r in count.select("lang").collect())
    number = {lang: i for i, lang in enumerate(languages)}
    # each language's distribution of n-grams, every row with the same weight
    code = codewords(len(languages))
    mean, rows_of = np.zeros((len(languages), SIZE)), np.ones(len(languages))
    lang = np.array([number[x] for x in got.column("lang").to_pylist()], dtype=np.int64)
    bucket, total = got.column("bucket").to_numpy(), got.column("total").to_numpy()
    mean[lang[bucket >= 0], bucket[bucket >= 0]] = total[bucket >= 0] / UNIT
    rows_of[lang[bucket < 0]] = total[bucket < 0]
    mean /= rows_of[:, None]
    floor = 1e-5
    weights = np.zeros((code.shape[1], SIZE), np.float32)
    for bit in range(code.shape[1]):
        one, other = mean[code[:, bit] > 0].mean(axis=0), mean[code[:, bit] < 0].mean(axis=0)
        weights[bit] = np.log((one + floor) / (other + floor))
    model = Model(languages, code, weights, np.ones(code.shape[1]), np.zeros(code.shape[1]), np.ones(code.shape[1]), 1.0)
    if code.shape[1]:
        shared = spark.sparkContext.broadcast(model)

        def margins(batches):
            for batch in slices(batches, "text"):
                raw = shared.value.margins(strings(batch, "text"))
                yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("deal"), pa.array(raw.tolist(), pa.list_(pa.float64()))], names=["lang", "deal", "raw"])

        held = sample.filter("NOT for_fit").select("lang", "deal", "text").mapInArrow(margins, "lang string, deal long, raw array<double>")
        _calibrate(model, held.toArrow().sort_by([("lang", "ascending"), ("deal", "ascending")]))
    release(count, sample)
    return model


def _calibrate(model: Model, held: pa.Table) -> None:
    """Slope, shift and trust of each bit and the sharpness, from margins (raw) of rows of known language."""
    if not held.num_rows:
        return
    lang = np.array([model.languages.index(x) for x in held.column("lang").to_pylist()])
    raw = np.array(held.column("raw").to_pylist())
    truth = model.code[lang]
    for bit in range(model.code.shape[1]):
        model.slope[bit], model.shift[bit] = _logistic(raw[:, bit], truth[:, bit])
    margin = raw * model.slope + model.shift
    wrong = np.clip((np.sign(margin) != truth).mean(axis=0), 0.5 / len(lang), 0.45)
    model.trust = np.log((1 - wrong) / wrong)
    model.trust /= model.trust.mean()
    losses = model.losses(margin)
    tries = []
    for sharpness in np.geomspace(0.05, 1, 24):
        model.sharpness = float(sharpness)
        p = model.probabilities(losses)[np.arange(len(lang)), lang]
        tries.append((-np.log(np.maximum(p, 1e-12)).mean(), model.sharpness))
    model.sharpness = min(tries)[1]


def _logistic(x: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a regularised one-dimensional logistic regression (Newton's method)."""
    one, a, b = truth > 0, 1.0 / (x.std() + 1e-9), 0.0
    y = np.where(one, (one.sum() + 1) / (one.sum() + 2), 1 / ((~one).sum() + 2))  # soft targets: no endless slope
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, v = p - y, p * (1 - p) + 1e-9
        grad = np.array([(g * x).sum() + 1e-3 * a, g.sum() + 1e-3 * b])
        hess = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
    return max(a, 1e-6), b


def predict(df: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", margin: float = 0.2) -> DataFrame:
    """doc_id, lang_pred, score (the language's share after decoding), runner_up and ambiguous (the
    two best are less than `margin` apart)."""
    rows = pick(df, doc_id=id_column, text=text_column)
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is set by the code and BITS

    def run(batches):
        m = shared.value
        for batch in slices(batches, "text"):
            texts = strings(batch, "text")
            n = len(m.languages)
            known = np.array([n > 0 and has_letter(t) for t in texts])
            p = m.probabilities(m.losses(m.margins(texts))) if n else np.zeros((len(texts), 1))
            order = np.argsort(-p, axis=1, kind="stable")
            best = p[np.arange(len(texts)), order[:, 0]]
            second = p[np.arange(len(texts)), order[:, 1]] if n > 1 else np.zeros(len(texts))
            name = lambda k, i: m.languages[order[i, k]] if known[i] and k < n else None
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([name(0, i) or UNDETERMINED for i in range(len(texts))], pa.string()),
                    pa.array(np.where(known, best, 0.0)),
                    pa.array([name(1, i) for i in range(len(texts))], pa.string()),
                    pa.array(~known | (best - second < margin)),
                ],
                names=["doc_id", "lang_pred", "score", "runner_up", "ambiguous"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, runner_up string, ambiguous boolean")
