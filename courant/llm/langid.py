"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is its lower-cased UTF-8 bytes with every ASCII non-letter as a space;
its subwords are the byte n-grams of ORDERS, hashed into BUCKETS. Their
embeddings are averaged and a linear layer scores the languages. Both layers
are trained together by stochastic gradient descent, one text a step, on a
bounded sample (at most SAMPLE rows, chosen by a hash of text and label;
a row is at most BUCKETS pairs of numbers). A fifth of the sample is held back:
it sets the temperature of the softmax and the score below which an answer
is rejected. A softmax is sure of texts in languages it never saw, too; so the
mean log frequency that a text's subwords have in the sample is measured as
well, and a text far below any of those held back is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS, BUCKETS, WIDTH = (2, 3, 4), 1 << 14, 16
SAMPLE, EPOCHS, RATE, SEED = 3000, 6, 8.0, 7
#: An answer is rejected below this score, or lower still if that would reject
#: more than one in a thousand of the right answers held back.
REJECT_SCORE, REJECT_SHARE = 0.35, 0.001
#: A text is unlike the sample if its subwords are less frequent there than those of the
#: least usual text held back, by this share of that text's distance from the median.
UNLIKE = 0.5
UNKNOWN = "und"
_SPACED = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))
_ODD = 0x9E3779B1


def buckets(text: str) -> np.ndarray:
    """How often each bucket is hit by the subwords of a text."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_SPACED) + b" ", np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    wide = raw.astype(np.uint32)
    gram = wide[:-1] | (wide[1:] << np.uint32(8))
    for order in ORDERS:
        if order > 2:
            if len(gram) < 2:
                break
            gram = gram[:-1] | (wide[order - 1 :] << np.uint32(8 * (order - 1)))
        hashed = ((gram ^ np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(_ODD)) >> np.uint32(18)
        counts += np.bincount(hashed, minlength=BUCKETS)
    return counts


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass(frozen=True)
class Model:
    """What a prediction needs: a weight for each bucket and language."""

    languages: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    reject_below: float
    frequency: np.ndarray  # logarithm, by bucket
    unlike_below: float

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return _softmax(counts @ self.weights / max(1, counts.sum()) + self.bias)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        counts = buckets(text)
        scores = self.scores(counts)
        best = int(scores.argmax())
        unlike = counts @ self.frequency / max(1, counts.sum()) < self.unlike_below
        return self.languages[best], float(scores[best]), bool(unlike or scores[best] < self.reject_below)

    def column(self, text: Column | str) -> Column:
        """struct(lang_pred, score, rejected) of a text column.

        `und` with score 0, rejected, for null and for texts without a letter. Each row is
        judged by its text alone, so repeated rows get the same, whatever other columns there are.
        """
        sent = F.col(text).alias("text") if isinstance(text, str) else text
        held = _session().sparkContext.broadcast(self)

        @F.pandas_udf("lang_pred string, score double, rejected boolean")
        def predict(texts: pd.Series) -> pd.DataFrame:
            model = held.value
            return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

        return predict.asNondeterministic()(sent)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang") -> Model:
    """Train on a bounded sample of the rows with a label and a text that has letters.

    The sample does not depend on the order or the partitions of the rows.
    Without any such row the model knows no language and rejects everything.
    """
    rows = docs.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    rows = rows.where(r"label IS NOT NULL AND text RLIKE '\\p{L}'")
    key = F.xxhash64("text", "label")
    # Twice as many as needed pass by their hash, so that no task has many texts to hand on.
    share = min(1.0, 2 * SAMPLE / max(1, rows.count()))
    rows = rows.where(F.pmod(key, F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    chosen = rows.orderBy(key, "label").limit(SAMPLE)
    # The model is trained where the sample lies, so the driver gets the weights and never the sample.
    found = chosen.coalesce(1).mapInArrow(_trained, _MODEL).first()
    if found is None:
        return train([], [], [])
    weights, bias, frequency = (np.frombuffer(found[c], np.float64) for c in ("weights", "bias", "frequency"))
    return Model(tuple(found["languages"]), weights.reshape(BUCKETS, -1), bias, found["reject_below"], frequency, found["unlike_below"])


_MODEL = "languages array<string>, weights binary, bias binary, reject_below double, frequency binary, unlike_below double"


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with the model of all (label, text) rows, if there are any; of a text only its pairs of numbers are kept."""
    labels, hits, counts = [], [], []
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            for label, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                row = buckets(text)
                hit = np.flatnonzero(row)
                labels.append(label)
                hits.append(hit.astype(np.int32))
                counts.append(row[hit].astype(np.int32))
    if not labels:
        return
    model = train(labels, hits, counts)
    row = {
        "languages": pa.array([list(model.languages)], pa.list_(pa.string())),
        "weights": pa.array([model.weights.tobytes()], pa.binary()), "bias": pa.array([model.bias.tobytes()], pa.binary()),
        "reject_below": pa.array([model.reject_below], pa.float64()),
        "frequency": pa.array([model.frequency.tobytes()], pa.binary()),
        "unlike_below": pa.array([model.unlike_below], pa.float64()),
    }
    yield pa.RecordBatch.from_arrays(list(row.values()), list(row))


def train(labels: list[str], hits: list[np.ndarray], counts: list[np.ndarray]) -> Model:
    languages = tuple(sorted(set(labels)))
    rng = np.random.default_rng(SEED)
    order = sorted(range(len(labels)), key=lambda i: (labels[i], hits[i].tobytes(), counts[i].tobytes()))
    order = rng.permutation(np.array(order, dtype=np.int64))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    goal = {label: i for i, label in enumerate(languages)}
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    out, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    steps, step = max(1, EPOCHS * len(used)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            share = counts[i] / counts[i].sum()
            hidden = share @ emb[hits[i]]
            error = _softmax(hidden @ out + bias)
            error[goal[labels[i]]] -= 1
            rate = RATE * (1 - step / steps)
            back = out @ error
            out -= 0.1 * rate * np.outer(hidden, error)
            bias -= 0.01 * rate * error
            emb[hits[i]] -= rate * np.outer(share, back)
            step += 1
    weights = emb @ out
    times = np.ones(BUCKETS)
    for i in used:
        times[hits[i]] += counts[i]
    frequency = np.log(times / times.sum())
    if not len(held):
        return Model(languages, weights, bias, REJECT_SCORE if languages else 1.0, frequency, -math.inf)
    usual = np.array([counts[i] @ frequency[hits[i]] / counts[i].sum() for i in held])
    unlike = float(usual.min() - UNLIKE * (np.median(usual) - usual.min()))
    logits = np.array([counts[i] @ weights[hits[i]] / counts[i].sum() + bias for i in held])
    right = np.array([goal[labels[i]] for i in held])
    loss = {
        t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), right], 1e-12)).mean()
        for t in np.geomspace(0.25, 8, 41)
    }
    heat = min(loss, key=loss.get)
    scores = _softmax(logits / heat)
    sure = scores.max(axis=1)[scores.argmax(axis=1) == right]
    limit = min(REJECT_SCORE, float(np.quantile(sure, REJECT_SHARE))) if len(sure) else REJECT_SCORE
    return Model(languages, weights / heat, bias / heat, limit, frequency, unlike)
