"""Document quality from a linear-chain conditional random field over lines.

A line has features of its own text and of the lines next to it. The field labels every line good or bad; forward-backward
gives each line's marginal, and the marginals, weighted by line length, give the quality of the document. A logistic curve
fitted on the training documents turns that into a probability of label 1.

Training needs labels of documents only: a first model without transitions finds the lines of bad documents that look bad,
and the field is then fitted to those line labels. It uses a bounded sample, drawn by a hash of the id; scoring reads every
whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import id_and_text, prepare

# Labelled documents used for training, and the lines of a training document beyond which it is not used.
MAX_TRAINING_DOCUMENTS = 4000
MAX_TRAINING_LINES = 1000

# Classes of bytes: letters A-Z, a-z, digits, ! and ?, separators, other ASCII punctuation, spaces, lead bytes beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
for _number, _members in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!?", b"|<>{}[]=_*#~^\\/", b".,;:'\"()-&%@$+`",
     b" \t\r\x0b\x0c", bytes(range(0xC2, 0x100))), 1
):
    _CLASS[list(_members)] = _number
_CLASSES = 8
OWN = 20
FEATURES = 3 * OWN + 3


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths in characters) of the lines of a text; the empty text is one empty line."""
    lines = text.split("\n")
    data = np.frombuffer((text + "\n").encode(), np.uint8)
    kinds = _CLASS[data]
    # Upper-case letters of the Latin-1 block are C3 80 to C3 9E.
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E))
    kinds[capital] = 1
    kinds[np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x9F))] = 2
    line_of = np.zeros(len(data), np.int64)
    np.cumsum(data[:-1] == 10, out=line_of[1:])
    n = len(lines)
    counts = np.bincount(line_of * (_CLASSES + 1) + kinds, minlength=n * (_CLASSES + 1)).reshape(n, -1)[:, 1:].astype(float)
    lengths = np.array([len(line) for line in lines], float)
    words = [line.split() for line in lines]
    n_words = np.array([len(w) for w in words], float)
    distinct = np.array([len(set(w)) for w in words], float)
    seen: set[str] = set()
    repeated = np.array([line in seen or seen.add(line) is not None for line in lines], float) * (lengths > 0)
    some, letters = np.maximum(lengths, 1), np.maximum(counts[:, 0] + counts[:, 1], 1)
    fresh = distinct / np.maximum(n_words, 1)
    upper, loud, marks = counts[:, 0] / letters, counts[:, 3] / some, counts[:, 4] / some
    own = np.column_stack([
        np.log1p(lengths) / 5, lengths == 0, lengths > 200, upper, upper > 0.5, counts[:, 2] / some, loud, loud > 0.04, marks,
        marks > 0.04, counts[:, 5] / some, counts[:, 5] / some > 0.12, counts[:, 6] / some, counts[:, 7] / some,
        fresh, (fresh < 0.3) & (n_words > 5), (fresh < 0.6) & (n_words > 5), np.log1p(n_words) / 5,
        np.minimum(lengths / np.maximum(n_words, 1), 40) / 10, repeated,
    ]).astype(float)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    edge = np.zeros((n, 3))
    edge[:, 0], edge[0, 1], edge[-1, 2] = 1, 1, 1
    return np.hstack([own, before, after, edge]), np.maximum(lengths, 1)


@dataclass(frozen=True)
class Model:
    """Weights of a line's log odds of being good, log potentials of label pairs, and the curve of the document score."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float
    offset: float


def marginals(odds: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains of one length: odds (chains, lines) -> P(good) (chains, lines) and the expected counts of
    label pairs (2, 2) per chain."""
    chains, lines = odds.shape
    score = np.stack([np.zeros_like(odds), odds], axis=2)
    ahead, back = np.empty_like(score), np.zeros_like(score)
    ahead[:, 0] = score[:, 0]
    for t in range(1, lines):
        ahead[:, t] = score[:, t] + np.logaddexp(ahead[:, t - 1, :1] + moves[0], ahead[:, t - 1, 1:] + moves[1])
    for t in range(lines - 2, -1, -1):
        after = score[:, t + 1] + back[:, t + 1]
        back[:, t] = np.logaddexp(after[:, :1] + moves[:, 0], after[:, 1:] + moves[:, 1])
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    good = np.exp(ahead[:, :, 1] + back[:, :, 1] - total[:, None])
    pairs = np.zeros((chains, 2, 2))
    for i in range(2):
        for j in range(2):
            steps = ahead[:, :-1, i] + moves[i, j] + score[:, 1:, j] + back[:, 1:, j]
            pairs[:, i, j] = np.exp(steps - total[:, None]).sum(axis=1)
    return good, pairs


def _ascend(gradient, start: np.ndarray, steps: int, rate: float = 0.1) -> np.ndarray:
    """Gradient ascent with per-coordinate step sizes (Adam)."""
    x, mean, square = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for k in range(1, steps + 1):
        g = gradient(x)
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        x += rate * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8)
    return x


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(documents: list[tuple[np.ndarray, np.ndarray]], labels: list[int], steps: int = 150) -> Model:
    """Fit the field to documents given as (line features, line lengths). With one class only, the score is that class's share."""
    y = np.array(labels, float)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    sizes = np.array([len(x) for x, _ in documents])
    lines = np.vstack([x for x, _ in documents])
    of_line = np.repeat(y, sizes)
    # Each class weighs as much as the other, and each document as much as the next.
    weight = np.repeat(np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) / sizes, sizes)
    plain = _ascend(lambda w: lines.T @ (weight * (of_line - _sigmoid(lines @ w))) - 1e-4 * w, np.zeros(FEATURES), 300)
    line_labels = np.where((of_line == 1) | (lines @ plain > 0), 1.0, 0.0)

    groups = []
    for size in np.unique(sizes):
        which = np.flatnonzero(sizes == size)
        place = np.concatenate([[0], np.cumsum(sizes)])[which][:, None] + np.arange(size)
        known = line_labels[place]
        pairs = np.zeros((2, 2))
        share = weight[place[:, 0]]
        for i in range(2):
            for j in range(2):
                pairs[i, j] = (share[:, None] * ((known[:, :-1] == i) & (known[:, 1:] == j))).sum()
        groups.append((place, known, pairs, share))

    def gradient(params: np.ndarray) -> np.ndarray:
        w, moves = params[:FEATURES], params[FEATURES:].reshape(2, 2)
        odds = lines @ w
        miss, turn = np.zeros(len(lines)), np.zeros((2, 2))
        for place, known, pairs, share in groups:
            good, expected = marginals(odds[place], moves)
            miss[place] = share[:, None] * (known - good)
            turn += pairs - (share[:, None, None] * expected).sum(axis=0)
        return np.concatenate([lines.T @ miss, turn.ravel()]) - 1e-4 * params

    params = _ascend(gradient, np.concatenate([plain, np.zeros(4)]), steps, 0.05)
    raw = Model(params[:FEATURES], params[FEATURES:].reshape(2, 2), 1.0, 0.0)
    quality = np.array([_quality(x, n, raw) for x, n in documents])
    curve = _ascend(
        lambda c: np.array([((y - _sigmoid(c[0] * quality + c[1])) * q).mean() for q in (quality, 1.0)]), np.array([4.0, -2.0]), 2000
    )
    return Model(raw.weights, raw.moves, float(curve[0]), float(curve[1]))


def _quality(features: np.ndarray, lengths: np.ndarray, model: Model) -> float:
    good, _ = marginals((features @ model.weights)[None], model.moves)
    return float(good[0] @ lengths / lengths.sum())


def score(text: str, model: Model) -> float:
    """Probability of label 1 for one whole text."""
    return float(_sigmoid(model.slope * _quality(*line_features(text), model) + model.offset))


def held_out(id_column: str) -> F.Column:
    """Rows never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1


def training_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", limit: int = MAX_TRAINING_DOCUMENTS):
    """At most `limit` (doc_id, label) rows that may be learnt from, drawn by a hash of the id. Ids with both labels are left out."""
    return (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
        .filter(F.col("label").isin(0, 1) & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id", "label")
    )


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_documents: int = MAX_TRAINING_DOCUMENTS, max_lines: int = MAX_TRAINING_LINES,
) -> Model:
    """Fit a model on a bounded sample: features are made where the texts are, and at most `max_documents` x `max_lines` rows of
    them reach the driver."""
    prepare(docs.sparkSession)
    # At most max_documents rows, so the broadcast is bounded.
    sample = id_and_text(docs, id_col, text_col).join(
        F.broadcast(training_ids(labels, label_col=label_col, limit=max_documents)), "doc_id"
    ).dropDuplicates(["doc_id"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text.count("\n") < max_lines:
                    x, n = line_features(text)
                    yield pa.RecordBatch.from_pydict({
                        "label": pa.array([label], pa.int32()), "x": [x.astype("f4").tobytes()], "n": [n.astype("f4").tobytes()]
                    })

    rows = (
        sample.select("text", F.col("label").cast("int").alias("label"), "doc_id").orderBy("doc_id").select("text", "label")
        .mapInArrow(features, "label int, x binary, n binary").collect()
    )
    parsed = [
        (np.frombuffer(r["x"], "f4").reshape(-1, FEATURES).astype(float), np.frombuffer(r["n"], "f4").astype(float)) for r in rows
    ]
    return fit(parsed, [r["label"] for r in rows])


def with_score(docs: DataFrame, model: Model, name: str = "score", text_col: str = "text") -> DataFrame:
    """Add the probability of label 1 of every whole text. A null text counts as the empty text, which is one empty line."""
    prepare(docs.sparkSession)

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        return pd.Series([score(text or "", model) for text in texts], dtype="float64")

    return docs.withColumn(name, judge(F.col(text_col)))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row; other columns are left behind."""
    return with_score(id_and_text(docs, id_col, text_col), model).select("doc_id", "score")
