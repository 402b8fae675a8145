"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words, all of them. A passage's statistics are encoded by a learned
layer, gated attention weighs the encoded passages within their document, and a logistic head scores the weighted mean.
Encoder, gates and head are trained together by gradient descent from document labels alone, on a bounded sample of
labelled documents; scoring covers every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, slices, text_buffers
from .tokens import mix, span_hashes, word_spans

PASSAGE = 64
#: Byte classes counted in a passage (fixed values).
CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "white": (32, 9, 10, 11, 12, 13), "stop": b".,;:", "bang": b"!?",
    "pipe": b"|", "symbol": b"#*$%&<>@^~", "bracket": b"()[]{}/\\=+_", "quote": b"\"'`-", "wide": range(128, 256),
}
N_FEATURES = len(CLASSES) + 4


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of a UTF-8 buffer, and the index of each row's first one (one more than rows).

    A row without words has one passage, of zeros.
    """
    starts, ends, first = word_spans(data, offsets)
    n_words = np.diff(first)
    count = np.maximum(-(-n_words // PASSAGE), 1)
    bag = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(count)), count)
    inner = np.arange(bag[-1]) - bag[row]
    w_lo = first[row] + inner * PASSAGE
    w_hi = np.minimum(w_lo + PASSAGE, first[row + 1])
    has = w_hi > w_lo
    out = np.zeros((bag[-1], N_FEATURES), np.float32)
    if not has.any():
        return out, bag
    lo, hi = starts[w_lo[has]], ends[w_hi[has] - 1]
    words, size = (w_hi - w_lo)[has], hi - lo
    sums = np.zeros(len(data) + 1, np.int32)
    for k, members in enumerate(CLASSES.values()):
        lookup = np.zeros(256, bool)
        lookup[list(members)] = True
        np.cumsum(lookup[data], out=sums[1:])
        out[has, k] = (sums[hi] - sums[lo]) / size
    np.cumsum(data == 10, out=sums[1:])
    out[has, -4] = (sums[hi] - sums[lo]) / words
    out[has, -3] = np.log1p(size / words)
    out[has, -2] = np.log1p(words) / 4
    owner = np.repeat(np.flatnonzero(has), words)
    keys = np.unique(mix(span_hashes(data, starts, ends) + mix(owner.astype(np.uint64))), return_index=True)[1]
    out[has, -1] = np.bincount(owner[keys], minlength=len(out))[has] / words
    return out, bag


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    centre: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def _forward(self, x: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        w, row, first = self.weights, np.repeat(np.arange(len(bag) - 1), np.diff(bag)), bag[:-1]
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (t * g) @ w["w"]
        a = np.exp(e - np.maximum.reduceat(e, first)[row])
        a /= np.add.reduceat(a, first)[row]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"row": row, "first": first, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["u"] + w["c"])}

    def gradients(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss by every weight, for prepared passages."""
        f, w = self._forward(x, bag), self.weights
        h, t, g, a, row, first = (f[k] for k in ("h", "t", "g", "a", "row", "first"))
        dp = (f["p"] - y) / len(y)
        dz = dp[:, None] * w["u"]
        da = (dz[row] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, first)[row])
        dt, dg = de[:, None] * w["w"] * g * (1 - t * t), de[:, None] * w["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz[row] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "u": f["z"].T @ dp, "c": dp.sum()}

    def prepared(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -5, 5)

    def score(self, x: np.ndarray, bag: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each bag of passages."""
        return self._forward(self.prepared(x), bag)["p"] if len(bag) > 1 else np.zeros(0)


def train(x: np.ndarray, bag: np.ndarray, y: np.ndarray, hidden: int = 24, gates: int = 12, steps: int = 200, seed: int = 9) -> AttentionModel:
    """Fit by full-batch Adam on the log loss of bag labels; without both labels the score is their mean (0.5 if none)."""
    rng = np.random.default_rng(seed)
    d = N_FEATURES
    shapes = {"W": (d, hidden), "b": (hidden,), "V": (hidden, gates), "U": (hidden, gates), "w": (gates,), "u": (hidden,), "c": ()}
    weights = {k: rng.normal(0, 1 / np.sqrt(max(1, s[0] if len(s) > 1 else hidden)), s) if k not in "bc" else np.zeros(s) for k, s in shapes.items()}
    model = AttentionModel(x.mean(axis=0) if len(x) else np.zeros(d), np.maximum(x.std(axis=0), 0.01) if len(x) else np.ones(d), weights)
    if len(set(y.tolist())) < 2:
        rate = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        weights["u"] = np.zeros(hidden)
        weights["c"] = np.log(rate / (1 - rate))
        return model
    x = model.prepared(x)
    moment = {k: [np.zeros(s), np.zeros(s)] for k, s in shapes.items()}
    for step in range(1, steps + 1):
        for k, grad in model.gradients(x, bag, y).items():
            grad = grad + (1e-5 * weights[k] if k not in "bc" else 0)
            m, v = moment[k]
            moment[k] = [0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad]
            m, v = moment[k][0] / (1 - 0.9**step), moment[k][1] / (1 - 0.999**step)
            weights[k] = weights[k] - 0.02 * m / (np.sqrt(v) + 1e-8)
    return model


def held_out(id_col: str):
    """True for every fifth id hash: crc32 of the id as text, modulo 5, is 0. A missing id is held out too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 4000) -> AttentionModel:
    """Train on the ``max_rows`` labelled documents of the smallest id hashes that aren't held out (a documented bound).

    Passages of these documents are encoded on the executors; only their statistics reach the driver.
    """
    sample = labelled_sample(docs, labels.where(~held_out(id_col)), id_col, text_col, label_col, max_rows)

    def encoded(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for lo, hi in slices(offsets):
                x, bag = passages(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                raw = [x[bag[i] : bag[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(raw, pa.binary())], ["o", "y", "x"])

    got = sorted(map(tuple, sample.mapInArrow(encoded, "o long, y long, x binary").collect()))
    bags = [np.frombuffer(r[2], np.float32).reshape(-1, N_FEATURES) for r in got]
    bag = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    return train(np.concatenate(bags) if bags else np.zeros((0, N_FEATURES)), bag, np.array([r[1] for r in got], float))


def classify(docs: DataFrame, model: AttentionModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 if score >= threshold, else 0); columns of these names are replaced.

    Null or empty text is one empty passage and gets a score like any other. Only the text is an input of the score. Repeated
    rows and rows without an id stay and are scored alike. An empty table gives no rows.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    fitted, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def scored(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(at))
            scores = [
                fitted.value.score(*passages(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])) for lo, hi in slices(offsets)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], [*batch.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(scored, f"{fields}, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` that the classifier, learned from ``labels``, doesn't reject; the columns of ``docs``.

    Null and empty texts are judged by the score of an empty passage. Repeated rows go or stay together. Without labels of both
    kinds no document is told from another, and all stay unless labels say that nearly all are bad. An empty table gives no rows.
    """
    model = learn(docs, labels, id_col, text_col)
    # clashing names would be replaced by classify: score them under other names
    renamed = {c: f"own_{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() in ("score", "predicted")}
    found = classify(docs.withColumnsRenamed(renamed), model, text_col).where("predicted = 1").drop("score", "predicted")
    return found.withColumnsRenamed({v: k for k, v in renamed.items()}).select(*docs.columns)
