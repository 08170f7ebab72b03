"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the distinct words and stems of a text, in numpy, is trained from confirmed
toxic documents and from unlabelled text, never from documents marked clean.
With the class prior p, the risk is p times the loss of the positives as
positive, plus the loss of the unlabelled as negative less p times that of the
positives as negative; the latter difference cannot be below 0 for true
risks, so where the estimate falls below, the step is taken to raise it
(Kiryo et al., 2017).

Fitting reads bounded samples (``POSITIVES`` and ``UNLABELLED`` documents of at
most ``LONGEST`` bytes, by a hash of the id); the prior is counted over all
labelled rows that are not held out, and every document is scored whole.

Edge cases: a null or empty text scores as a text without known words.
Without positives every score is 0.  Null labels count as unlabelled, a
document labelled twice is toxic if one label says so.  Repeated rows each
return; further columns are ignored.
"""

from __future__ import annotations

import math
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import as_bytes, held_out, small_batches
from loomgraph.llm.samples import first_ids

#: Documents to fit on, at most, and bytes of one; documents a word must be in.
POSITIVES, UNLABELLED, LONGEST, LEAST_DOCUMENTS = 2000, 6000, 1 << 20, 8
#: Times the noise of a word's gradient: what is below selects no word.
LASSO = 1.0
#: Documents added to those of a word when its noise is estimated.
SMOOTH = 4
#: Bytes of a stem; one distinct word in so many must have it, for the text to be full of it.
STEMS, DENSE = (5, 7), 100
_DROP = string.punctuation.encode()


def words(text: bytes) -> set[int]:
    """CRC-32 of the distinct words, without case and punctuation, of the first bytes of
    the longer ones (``STEMS``), of those that two words or more begin with, and of those
    that one distinct word in ``DENSE`` begins with."""
    found = set(text.lower().translate(None, _DROP).split())
    stems = Counter(w[:n] for n in STEMS for w in found if len(w) > n)
    codes = set(map(zlib.crc32, found))
    for stem, n in stems.items():
        code = zlib.crc32(stem)
        codes.add(zlib.crc32(b"*", code))
        if n > 1:
            codes.add(zlib.crc32(b"**", code))
            if n * DENSE >= len(found):
                codes.add(zlib.crc32(b"%", code))
    return codes


class PuModel:
    """Weights by word code, and bias; ``score`` is the logistic of their sum."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: bytes) -> float:
        total = self.bias + math.fsum(self.weights[w] for w in words(text) & self.weights.keys())
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def _loss_slope(z: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """Logistic loss of the margin sign * z, and its slope in z."""
    m = np.clip(sign * z, -30, 30)
    return np.log1p(np.exp(-m)), -sign / (1 + np.exp(m))


def risk_slope(z: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """Slope in z of the non-negative risk, or against the part that fell below 0."""
    n_pos, n_unl = positive.sum(), (~positive).sum()
    _, pull = _loss_slope(z[positive], 1)
    miss, push = _loss_slope(z[positive], -1)
    rest, rest_push = _loss_slope(z[~positive], -1)
    slope = np.zeros(len(z))
    if rest.mean() - prior * miss.mean() >= 0:
        slope[positive] = prior * (pull - push) / n_pos
        slope[~positive] = rest_push / n_unl
    else:
        slope[positive] = prior * push / n_pos
        slope[~positive] = -rest_push / n_unl
    return slope


def descend(bag: np.ndarray, word: np.ndarray, n_words: int, positive: np.ndarray, prior: float, lasso: np.ndarray | float, steps: int, rate: float = 0.1, ridge: float = 1e-4) -> np.ndarray:
    """Weights of the words and, last, the bias: proximal Adam on full batches.
    ``bag`` and ``word`` list which bag has which word."""
    theta = np.zeros(n_words + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = np.bincount(bag, theta[word], len(positive)) + theta[-1]
        slope = risk_slope(z, positive, prior)
        gradient = np.append(np.bincount(word, slope[bag], n_words) + ridge * theta[:-1], slope.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        pace = rate / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        theta -= pace * first / (1 - 0.9**step)
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - lasso * pace[:-1], 0)
    return theta


def fit(word: np.ndarray, bag: np.ndarray, positive: np.ndarray, prior: float) -> PuModel:
    """``word``, ``bag``: which bag has which word code.  A lasso in proportion
    to the noise of each word's gradient (that of as many positives, drawn from
    all bags) selects words; they are fitted anew."""
    if not positive.any() or positive.all() or not 0 < prior < 1:
        return PuModel({}, 30.0 if positive.any() and prior >= 1 else -30.0)
    for least, times, steps in ((LEAST_DOCUMENTS, LASSO, 150), (1, 0.0, 800)):
        names, often = np.unique(word, return_counts=True)
        names, often = names[often >= least], often[often >= least]
        lasso = times * prior * np.sqrt((often + SMOOTH) / len(positive) / positive.sum())
        keep = np.isin(word, names)
        word, bag = word[keep], bag[keep]
        place = np.searchsorted(names, word)
        theta = descend(bag, place, len(names), positive, prior, lasso, steps)
        chosen = theta[:-1] != 0
        word, bag = word[chosen[place]], bag[chosen[place]]
    return PuModel(dict(zip(names[chosen].tolist(), theta[:-1][chosen].tolist())), float(theta[-1]))


def _word_rows(batches):
    for batch in batches:
        bags = [np.sort(np.fromiter(words(t), np.uint32)).view(np.int32) for t in as_bytes(batch["text"])]
        yield pa.RecordBatch.from_arrays([batch["toxic"], batch["h"], pa.array(bags, pa.list_(pa.int32()))], ["toxic", "h", "words"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, longest: int = LONGEST) -> PuModel:
    """Fits on rows that are not held out; brings at most ``positives`` +
    ``unlabelled`` bags of words, of texts of at most ``longest`` bytes, to the driver."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & ~held_out())
    prior = known.agg(F.avg((F.col(label) == 1).cast("double"))).first()[0] or 0.0
    toxic = first_ids(known.where(F.col(label) == 1), positives).withColumn("toxic", F.lit(1))
    rest = first_ids(docs, unlabelled).withColumn("toxic", F.lit(0))
    chosen = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest).select("doc_id", "text").join(F.broadcast(toxic.union(rest).limit(positives + unlabelled)), "doc_id")
    rows = chosen.select("toxic", F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(_word_rows, "toxic int, h long, words array<int>").toArrow()
    rows = rows.sort_by([("toxic", "ascending"), ("h", "ascending")])
    word = np.asarray(pc.list_flatten(rows["words"])).view(np.uint32)
    bag = np.repeat(np.arange(rows.num_rows, dtype=np.int32), np.asarray(pc.list_value_length(rows["words"])))
    return fit(word, bag, np.asarray(rows["toxic"]) == 1, prior)


def score(docs: DataFrame, model: PuModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches):
        for batch in batches:
            found = [model.score(t) for t in as_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(found, pa.float64())], ["doc_id", "held_out", "score"])

    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, model: PuModel) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic."""

    @F.pandas_udf("boolean")
    def is_clean(text):
        return text.map(lambda t: model.score((t or "").encode()) < 0.5).astype(bool)

    small_batches(docs.sparkSession)
    return docs.where(is_clean("text"))
