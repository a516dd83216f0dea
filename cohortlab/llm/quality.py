"""Quality classifier on naive-Bayes-scaled n-gram indicators: a linear hinge-loss model fitted by dual coordinate descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import buffers, column, release

DIM = 1 << 17  # 2**16 for exact byte pairs, 2**16 for hashed runs of four bytes


def indicators(text: np.ndarray) -> np.ndarray:
    """Indices of the n-grams of bytes in a text (2 and 4 bytes long), each once. A text too short has none."""
    seen = np.zeros(DIM, bool)
    if len(text) >= 2:
        pair = text[:-1].astype(np.uint32) << 8 | text[1:]
        seen[pair] = True
        if len(text) >= 4:
            seen[(1 << 16) + ((pair[:-2] << 16 | pair[2:]) * np.uint32(2654435761) >> np.uint32(16))] = True
    return np.flatnonzero(seen)


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # the linear model's, times the log-count ratios
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum()) / np.sqrt(max(1, len(found))) + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = np.full(DIM, smooth), np.full(DIM, smooth)
    for x, good in zip(rows, y):
        (p if good else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float, epochs: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss (L1-SVM) model with features scale[i] / sqrt(n); classes weigh the same in sum."""
    sign = np.where(y > 0, 1.0, -1.0)
    upper = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y <= 0).sum())))
    w, bias, alpha, rng = np.zeros(DIM), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    values = [(scale[x] / np.sqrt(max(1, len(x)))).astype(np.float32) for x in rows]
    square = np.array([v @ v + 1.0 for v in values])
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            x, v = rows[i], values[i]
            step = sign[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - step / square[i], 0.0), upper[i])
            if change := (new - alpha[i]) * sign[i]:
                w[x] += change * v
                bias += change
                alpha[i] = new
    return w, bias


def platt(margins: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of the logistic law of the labels given the margins, by Newton's method on smoothed targets."""
    good, bad = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x, theta = np.stack([margins, np.ones(len(y))], 1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hessian, x.T @ (p - t)), -2, 2)
    return float(theta[0]), float(theta[1])


def fit_rows(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, epochs: int = 8) -> QualityModel:
    """Fit on three quarters of the rows, then calibrate on the rest. With rows of one class only, the score is its share."""
    if len(set(y.tolist())) < 2:
        share = np.clip((y.sum() + 1) / (len(y) + 2), 1e-6, 1 - 1e-6)
        return QualityModel(np.zeros(DIM), 0.0, 0.0, float(np.log(share / (1 - share))))
    order = np.random.default_rng(1).permutation(len(y))
    cut = max(2, len(y) * 3 // 4)
    fit, rest = order[:cut], order[cut:]
    if len(set(y[fit].tolist())) < 2 or len(set(y[rest].tolist())) < 2:
        fit, rest = order, order
    ratios = log_count_ratios([rows[i] for i in fit], y[fit])
    w, bias = dual_coordinate_descent([rows[i] for i in fit], ratios, y[fit], cost, epochs)
    model = QualityModel(w * ratios, bias, 1.0, 0.0)
    slope, shift = platt(np.array([model.margin(rows[i]) for i in rest]), y[rest])
    return QualityModel(w * ratios, bias, slope, shift)


def train(documents: DataFrame, labels: DataFrame, label_col: str = "quality", most_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit on the labelled documents whose crc32(id) mod 5 is not 0.

    most_rows: if there are more of them, those with the smallest hashes of the id are used (a bounded sample; about 6 KB each
    at the driver). Null labels and ids are left out; of several labels for an id the largest counts, of several documents of an id one. Whole texts are read, however long;
    null and empty ones have no n-gram. Without labelled documents, or with one label only, the model scores all texts alike.
    """
    own = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null and __y is not null").where(F.crc32(F.col("__id").cast("string")) % 5 != 0)
    own = own.groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(most_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(column(batch, "text"))
            found = [indicators(data[a:b]) for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([column(batch, "__id"), column(batch, "__y"), pa.array([x.astype("<i4").tobytes() for x in found], pa.binary())], ["__id", "__y", "x"])

    chosen = documents.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(own), "__id")  # at most most_rows labels
    rows = chosen.mapInArrow(features, "__id long, __y int, x binary").groupBy("__id", "__y").agg(F.min("x").alias("x"))  # one a label
    got = sorted((i, y, bytes(x)) for i, y, x in rows.collect())
    model = fit_rows([np.frombuffer(x, "<i4") for _, _, x in got], np.array([int(y > 0) for _, y, _ in got], dtype=np.int64))
    del got
    release()
    return model


def score(df: DataFrame, model: QualityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """df with score and predicted (1 if score >= threshold); columns of df with these names are replaced.

    Whole texts are read, however long; null and empty texts have no n-gram and get the model's score of none. Repeated rows are scored each by itself; an empty df stays empty.
    """
    rest = [c for c in df.columns if c not in ("score", "predicted")]
    sent = df.sparkSession.sparkContext.broadcast(model)  # DIM floats and three more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            data, off = buffers(column(batch, text_col))
            s = np.array([m.score(indicators(data[a:b])) for a, b in zip(off[:-1], off[1:])], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in rest), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*rest, "score", "predicted"])

    return df.select(*rest).mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.select(*rest).dtypes) + ", score double, predicted int")
