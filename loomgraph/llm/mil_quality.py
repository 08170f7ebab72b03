"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage is
encoded by what its words look like (length, case, symbols, digits, repeats,
and hashed words), then by a learned layer h = tanh(x W + b).  Gated attention
(Ilse et al., 2018) weighs the passages: a = softmax(w (tanh(h V) * sigm(h U))),
and the weighted passage representation is scored by a logistic.  All weights
are learned from document labels.

Fitting reads a bounded sample of labelled documents (``LABELLED`` of at most
``LONGEST`` bytes, by a hash of the id), whole texts; every document is scored
whole.

Edge cases: a null or empty text is one empty passage.  Without labels of both
classes every score is the share of label 1 (0.5 without labels).  Null labels
are left out, a document labelled twice has the greater label.  Repeated rows
each return; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import as_bytes, held_out, small_batches
from loomgraph.llm.samples import labelled

PASSAGE, LABELLED, LONGEST, HASHED, HIDDEN = 64, 6000, 1 << 20, 16, 16
SHAPE = 9
#: Of a word, then of a passage: share of repeated neighbours, share of distinct words, log of length.
WIDTH = SHAPE + HASHED + 3
_UPPER, _LOWER, _DIGITS = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
_SYMBOLS, _STOPS, _HIGH = b"!#$%&*+/<=>@\\^_`{|}~", b".,;:?\"'()-", bytes(range(128, 256))


class WordLooks(dict):
    """Rows of ``table`` by word."""

    def __init__(self, most: int = 600_000):
        super().__init__()
        self.most, self.table = most, np.zeros((1024, SHAPE + HASHED), np.float32)

    def __missing__(self, word: bytes) -> int:
        k = len(self)
        if k == len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        n = len(word)
        plain = word.isascii() and word.isalpha() and word.islower()
        upper, lower, digits, symbols, stops, high = (0, n, 0, 0, 0, 0) if plain else (n - len(word.translate(None, c)) for c in (_UPPER, _LOWER, _DIGITS, _SYMBOLS, _STOPS, _HIGH))
        h = xxhash.xxh32_intdigest(word, 9)
        row = self.table[k]
        row[:] = 0
        row[:SHAPE] = (n / 8, upper / n, lower / n, digits / n, symbols / n, stops / n, high / n, symbols > 0, upper > 1)
        row[SHAPE + h % HASHED] = 1 if h & 0x10000 else -1
        self[word] = k
        return k


_looks = WordLooks()


def passages(text: bytes, size: int = PASSAGE) -> np.ndarray:
    """One row of ``WIDTH`` numbers for each passage."""
    words = text.split()
    if not words:
        return np.zeros((1, WIDTH), np.float32)
    if len(_looks) > _looks.most:
        _looks.clear()
    k = np.fromiter(map(_looks.__getitem__, words), np.int64, len(words))
    starts = np.arange(0, len(words), size)
    count = np.diff(np.append(starts, len(words))).astype(np.float32)
    means = np.add.reduceat(_looks.table[k], starts, axis=0) / count[:, None]
    same = np.concatenate(([0.0], k[1:] == k[:-1]))
    of = np.arange(len(words)) // size
    distinct = np.bincount(np.unique(of * (k.max() + 1) + k) // (k.max() + 1), minlength=len(starts))
    extra = np.stack([np.add.reduceat(same, starts) / count, distinct / count, np.log1p(count) / 4], axis=1)
    return np.concatenate((means, extra.astype(np.float32)), axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class MilModel:
    """Weights by name; ``forward`` scores bags of passages given as segments."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    @classmethod
    def start(cls, seed: int = 9) -> MilModel:
        draw = np.random.default_rng(seed)
        shapes = {"W": (WIDTH, HIDDEN), "V": (HIDDEN, HIDDEN), "U": (HIDDEN, HIDDEN), "w": (HIDDEN, 1), "c": (HIDDEN, 1)}
        weights = {k: draw.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()}
        return cls(weights | {"b": np.zeros(HIDDEN), "d": np.zeros(1), "mean": np.zeros(WIDTH), "scale": np.ones(WIDTH)})

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """starts: the first passage of each bag, none of which is empty."""
        p = self.weights
        x = (x - p["mean"]) / p["scale"]
        sizes = np.diff(np.append(starts, len(x)))
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = ((t * g) @ p["w"])[:, 0]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"x": x, "sizes": sizes, "h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid((z @ p["c"])[:, 0] + p["d"])}

    def gradient(self, f: dict[str, np.ndarray], starts: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss."""
        p, sizes = self.weights, f["sizes"]
        dy = (f["y"] - label) / len(label)
        dz = np.repeat(dy, sizes)[:, None] * p["c"][:, 0]
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), sizes))
        dtg = de[:, None] * p["w"][:, 0]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dx, "b": dx.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de[:, None], "c": f["z"].T @ dy[:, None], "d": dy.sum(keepdims=True)}

    def scores(self, texts: list[bytes]) -> np.ndarray:
        found = [passages(t) for t in texts]
        if not found:
            return np.empty(0)
        starts = np.cumsum([0] + [len(x) for x in found[:-1]])
        return self.forward(np.concatenate(found), starts)["y"]


def fit(bags: list[np.ndarray], label: np.ndarray, steps: int = 250, rate: float = 0.02, decay: float = 1e-4) -> MilModel:
    """Adam on full batches."""
    model = MilModel.start()
    p = model.weights
    share = label.mean() if len(label) else 0.5
    if share in (0, 1) or not len(label):
        p |= {"c": np.zeros_like(p["c"]), "d": np.full(1, np.log((share + 1e-9) / (1 - share + 1e-9)))}
        return model
    x = np.concatenate(bags).astype(np.float64)
    starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
    p |= {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-3}
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        for k, g in model.gradient(model.forward(x, starts), starts, label).items():
            g = g + decay * p[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _bag_rows(batches):
    for batch in batches:
        found = [passages(t).ravel() for t in as_bytes(batch["text"])]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(found, pa.list_(pa.float32()))], ["doc_id", "label", "passages"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = LABELLED, longest: int = LONGEST) -> MilModel:
    """Fits on rows that are not held out; brings the passages of at most ``most``
    documents of at most ``longest`` bytes to the driver."""
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    chosen = labelled(docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest), labels, label, most).select("doc_id", "label", "text")
    rows = chosen.mapInArrow(_bag_rows, f"doc_id {id_type}, label int, passages array<float>").toArrow().sort_by("doc_id")
    bags = [np.asarray(x.values, np.float32).reshape(-1, WIDTH) for x in rows["passages"]]
    return fit(bags, np.asarray(rows["label"], np.float64))


def score(docs: DataFrame, model: MilModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(model.scores(as_bytes(batch["text"])), pa.float64())], ["doc_id", "held_out", "score"])

    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
