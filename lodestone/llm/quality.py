"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Each text gives a vector of statistics (shares of kinds of bytes, word and line repetition, compressibility). Random cosine
features of the standardised vector approximate a Gaussian kernel; each partition sums its normal equations, the sums meet in
a tree of bounded fan-in, and the driver solves one system of FEATURES + 1 unknowns. Raw scores of a part of the labelled rows that the fit
didn't see are counted in BINS equal bins, and pool-adjacent-violators over the bins gives the calibration. All
labelled rows take part; nothing on the driver grows with the input.

Defined results: null and empty texts have all statistics zero and are scored; texts of any length are read whole; repeated
rows are scored row by row; a label row with a null id, or a label that is neither 0 nor 1, is left out; repeated labels count as often as
they stand; with no labels the score is 0.5, with one class only it is that class; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import fold, materialize
from lodestone.llm.sums import partition_sums

FEATURES = 256
RIDGE = 1e-3
BINS = 2048
#: Raw scores outside this range count in the end bins.
LOW, HIGH = -1.0, 2.0
SEED = 20240607
THRESHOLD = 0.3

_KINDS = np.zeros((256, 10), np.float64)
for _i in range(256):
    _c = chr(_i)
    _KINDS[_i] = [
        "a" <= _c <= "z", "A" <= _c <= "Z", "0" <= _c <= "9", _c == " ", _c == "\n", _c in ".,;:'\"-()?", _c == "!", _c == "|",
        _c in "#$%&*@^~<>{}[]\\/=+_`", _i >= 128,
    ]
STATISTICS = 24


def statistics_of(text: bytes) -> list[float]:
    """The statistics of one text."""
    words = text.split()
    n, m = len(text), len(words)
    if not m:
        return [0.0] * STATISTICS
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    p = counts[counts > 0] / n
    lines = text.split(b"\n")
    distinct = set(words)
    doubled = sum(map(eq, words, words[1:]))
    apart = sum(map(eq, words, words[2:])) + sum(map(eq, words, words[3:]))
    ends = sum(w[-1] in b"!$%&*#|" for w in distinct) / len(distinct)
    capital = sum(w.isupper() for w in distinct) / len(distinct)
    single = words.count(b"|") / m
    return [
        *(counts @ _KINDS / n).tolist(),
        math.log1p(n), math.log1p(m), (n - m) / m, -float(p @ np.log2(p)), len(distinct) / m, len(distinct) / math.sqrt(m),
        doubled / m, apart / m, len(set(lines)) / len(lines), math.log1p(n / len(lines)),
        len(zstandard.ZstdCompressor(level=1).compress(text)) / n, ends, capital, single,
    ]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) of every document."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics_of(t.as_py()) for t in batch["text"]]
            flat = pa.array(np.array(rows, np.float32).reshape(-1))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * STATISTICS), flat)], names=["id", "x"])

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col(id_col).cast("long").alias("id"), text).mapInArrow(measure, "id long, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


@dataclass
class Model:
    """mean, scale: of the statistics; turn, shift: the random features; weights: with the intercept last; knots, values: the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.hstack([np.cos(z @ self.turn + self.shift) * math.sqrt(2 / len(self.shift)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def isotonic(centres: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins: (centre, value) of each pool, values rising."""
    pools: list[list[float]] = []  # weight, sum of labels, sum of weighted centres
    for c, w, y in zip(centres, n, positive, strict=True):
        if not w:
            continue
        pools.append([w, y, w * c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def fit(measured: DataFrame, labels: DataFrame, learn=None, calibrate=None, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Fit on labelled documents. measured: from statistics(); learn and calibrate: conditions on ``id``, which rows to use for what."""
    learn = learn if learn is not None else F.lit(True)
    calibrate = calibrate if calibrate is not None else F.crc32(F.concat(F.lit("c"), F.col("id").cast("string"))) % 4 == 0
    y = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where(F.col("y").isin(0.0, 1.0))
    rows = materialize(measured.where(learn).join(y, "id").select("x", "y", calibrate.alias("c")), "labelled")

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch["x"])
        return np.concatenate([[len(x), np.sum(batch["y"].to_numpy())], x.sum(0), (x * x).sum(0)])

    sums = partition_sums(rows, 2 + 2 * STATISTICS, moments)
    total, positive = sums[:2]
    mean = sums[2 : 2 + STATISTICS] / max(total, 1)
    scale = np.sqrt(np.maximum(sums[2 + STATISTICS :] / max(total, 1) - mean**2, 0))
    rng = np.random.default_rng(SEED)
    turn, shift = rng.standard_normal((STATISTICS, FEATURES)) / math.sqrt(STATISTICS), rng.uniform(0, 2 * math.pi, FEATURES)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), turn, shift, np.zeros(FEATURES + 1), np.array([0.0]), np.array([positive / total if total else 0.5]))
    if not 0 < positive < total:
        return model

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        take = ~batch["c"].to_numpy(zero_copy_only=False)
        phi = model.features(_matrix(batch["x"])[take])
        return np.concatenate([(phi.T @ phi).reshape(-1), phi.T @ batch["y"].to_numpy()[take], [take.sum()]])

    d = FEATURES + 1
    sums = partition_sums(rows, d * d + d + 1, equations)
    if sums[-1]:
        model.weights = np.linalg.solve(sums[: d * d].reshape(d, d) + RIDGE * sums[-1] * np.eye(d) / d, sums[d * d : -1])

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        take = batch["c"].to_numpy(zero_copy_only=False)
        raw, y = model.raw(_matrix(batch["x"])[take]), batch["y"].to_numpy()[take]
        at = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, minlength=BINS)])

    bins = partition_sums(rows, 2 * BINS, histogram)
    if bins[:BINS].sum():
        model.knots, model.values = isotonic(LOW + (np.arange(BINS) + 0.5) * (HIGH - LOW) / BINS, bins[:BINS], bins[BINS:])
    return model


def score(measured: DataFrame, model: Model) -> DataFrame:
    """(id, score) of measured documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(model.score(_matrix(batch["x"])))], names=["id", "score"])

    return measured.mapInArrow(run, "id long, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted): learned from labels outside the fold that is held out."""
    measured = materialize(statistics(docs, id_col, text_col), "statistics")
    model = fit(measured, labels, learn=fold(F.col("id")) != 0, id_col=id_col)
    return score(measured, model).select("id", (fold(F.col("id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of a table that classify() predicts 1, with all their columns, whatever their names. Rows are decided one by one, so repeated rows and
    ids, and null ids, have each row's own outcome, and no text is shuffled; a null or empty text is scored as such; an empty table gives
    an empty table. Each text is measured once: rows are written with their statistics, and read again when the model is known."""

    def measure(texts: pa.Array) -> pa.Array:
        rows = [statistics_of(t.as_py()) for t in texts]
        flat = pa.array(np.array(rows, np.float32).reshape(-1))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * STATISTICS), flat)

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    measured = materialize(docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.arrow_udf(measure, "array<float>")(text).alias("x")), "measured")
    model = fit(measured.select("id", "x"), labels, learn=fold(F.col("id")) != 0, id_col=id_col)
    good = F.arrow_udf(lambda x: pa.array(model.score(_matrix(x)) >= threshold, pa.bool_()) if len(x) else pa.array([], pa.bool_()), "boolean")
    return measured.where(good("x")).select("row.*")
