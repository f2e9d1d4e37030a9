"""Toxicity by non-negative positive-unlabelled learning.

Positives are texts confirmed as toxic; everything else is unlabelled. With class prior p the
risk of a scorer g is p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)]): the unlabelled
loss minus the share that hidden positives cause, cut at zero so that a flexible model cannot
drive it negative. When the bracket of a mini-batch is negative, the step ascends on it instead.

A text's features are the distinct words in it (A-Z lowered, other ASCII signs split words) and
the distinct word beginnings of four to seven bytes. The vocabulary holds those whose share of
the positives lies ``MIN_Z`` deviations or more above their share of the unlabelled texts. A
linear model with the sigmoid loss is trained by numpy on the driver, on bounded samples of both
kinds (``max_positive``, ``max_unlabelled``; the rows with the smallest hashes of their id). The
labels' toxic share gives the prior. The raw score is then mapped to a probability with two
numbers fitted on the labelled training rows. Scoring runs over all rows in tasks.

Defined results: null and empty texts hold no word and get the score of an empty feature set;
labels that are null count as unlabelled; a document labelled toxic by any of repeated label rows
is a positive; without positives every score is 0; an empty table gives no rows. Scores never
read id, language or source.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestrank.llm.common import slices, texts

THRESHOLD = 0.7
MAX_POSITIVE, MAX_UNLABELLED, MAX_LABELLED = 3_000, 6_000, 3_000
MAX_WORDS = 2_000  # distinct words kept of one sampled training text; scoring reads whole texts
MIN_COUNT, MIN_Z, MAX_FEATURES = 4, 4.0, 2_000
BEGINNINGS = (4, 5, 6, 7)
_SPLIT = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(128)) + bytes(range(128, 256))


def words_of(text: str) -> set[bytes]:
    """Distinct words of a text."""
    return set(text.encode("utf-8").lower().translate(_SPLIT).split())


def features_of(words: set[bytes] | bytes) -> set[bytes]:
    """The words and their beginnings (marked, so that a short word is not its own beginning)."""
    words = words.split() if isinstance(words, bytes) else words
    found = set(words)
    for size in BEGINNINGS:
        found.update([b"^" + w[:size] for w in words if len(w) > size])
    return found


@dataclass
class Model:
    """Weights by feature, a bias, and the two numbers of the probability map."""

    weights: dict[bytes, float]
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, text: str) -> float:
        return self.raw_words(words_of(text))

    def raw_words(self, words: set[bytes] | bytes) -> float:
        return self.bias + sum(self.weights[f] for f in self.weights.keys() & features_of(words))

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.raw(text) + self.shift, -60, 60))))


def _matrix(bags: list[bytes], index: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ones."""
    rows, cols = [], []
    for i, bag in enumerate(bags):
        found = sorted(index[f] for f in index.keys() & features_of(bag))
        rows += [i] * len(found)
        cols += found
    return np.array(rows, np.int64), np.array(cols, np.int64)


def _vocabulary(positive: list[bytes], unlabelled: list[bytes]) -> dict[bytes, int]:
    """Features that positives hold more often than unlabelled texts do, the clearest ones first."""
    first: dict[bytes, int] = {}
    for bag in positive:
        for feature in features_of(bag):
            first[feature] = first.get(feature, 0) + 1
    first = {f: c for f, c in first.items() if c >= MIN_COUNT}
    other = dict.fromkeys(first, 0)
    for bag in unlabelled:
        for feature in other.keys() & features_of(bag):
            other[feature] += 1
    n, m = max(len(positive), 1), max(len(unlabelled), 1)
    clear = []
    for feature, count in first.items():
        share = (other[feature] + 1) / (m + 1)
        z = (count / n - share) / np.sqrt(share * (1 - share) / n + 1e-12)
        if z >= MIN_Z:
            clear.append((-z, feature))
    return {feature: i for i, (_, feature) in enumerate(sorted(clear)[:MAX_FEATURES])}


def fit(
    positive: list[bytes], unlabelled: list[bytes], prior: float,
    epochs: int = 60, rate: float = 0.05, decay: float = 1e-4, batches: int = 8, seed: int = 7,
) -> Model:
    """Minimise the non-negative risk with Adam; a bag is a text's distinct words, joined by spaces."""
    index = _vocabulary(positive, unlabelled)
    if not positive or not index:
        return Model({})
    rng = np.random.default_rng(seed)
    sets = {}
    for name, bags in (("p", positive), ("u", unlabelled)):
        rows, cols = _matrix(bags, index)
        part = rng.integers(0, batches, len(bags))
        sets[name] = [
            (lambda keep, r, c: (np.searchsorted(keep, r), c, len(keep)))(
                np.flatnonzero(part == b), rows[part[rows] == b], cols[part[rows] == b]
            )
            for b in range(batches)
        ]
    size = len(index)
    w = np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v, t = np.zeros(size + 1), np.zeros(size + 1), 0

    def outputs(rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(rows, w[cols], n) + w[-1]

    def gradient(rows: np.ndarray, cols: np.ndarray, slope: np.ndarray) -> np.ndarray:
        out = np.append(np.bincount(cols, slope[rows], size), slope.sum())
        return out / max(len(slope), 1)

    for _ in range(epochs):
        for b in rng.permutation(batches):
            p, u = sets["p"][b], sets["u"][b]
            if not p[2] or not u[2]:
                continue
            sp, su = (1 / (1 + np.exp(-np.clip(outputs(*x), -40, 40))) for x in (p, u))
            # sigmoid loss: l(z) = sigmoid(-z)
            rest = su.mean() - prior * sp.mean()
            slope_p, slope_u = sp * (1 - sp), su * (1 - su)
            back = gradient(*u[:2], slope_u) - prior * gradient(*p[:2], slope_p)
            grad = -prior * gradient(*p[:2], slope_p) + back if rest >= 0 else -back
            grad[:-1] += decay * w[:-1]
            t += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model({word: float(w[i]) for word, i in index.items() if abs(w[i]) > 1e-3}, float(w[-1]))


def calibrate(model: Model, raw: np.ndarray, toxic: np.ndarray) -> Model:
    """Slope and shift of the probability map, by Newton steps on the labelled rows."""
    if not model.weights or toxic.min(initial=1) == toxic.max(initial=0):
        return model
    center, scale = raw.mean(), raw.std() or 1.0
    x = np.stack([(raw - center) / scale, np.ones(len(raw))], 1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        step = np.linalg.solve(
            (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (toxic - p) - 1e-3 * theta
        )
        theta += step
        if np.abs(step).max() < 1e-9:
            break
    model.slope = float(theta[0] / scale)
    model.shift = float(theta[1] - theta[0] * center / scale)
    return model


def train(
    docs: DataFrame, labels: DataFrame, allowed: str, id_col: str = "doc_id", text_col: str = "text",
    max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_labelled: int = MAX_LABELLED,
) -> Model:
    """Fit on bounded samples. ``allowed``: condition on ``docs`` under which labels may be read.

    The unlabelled sample is drawn from the allowed rows, whatever their label.
    """
    marks = labels.groupBy(id_col).agg(F.max("toxic").alias("_toxic")).where("_toxic is not null")
    allowed_docs = docs.where(allowed).where(F.col(id_col).isNotNull()).select(
        id_col, F.col(text_col).cast("string").alias("_text")
    )
    known = allowed_docs.select(id_col).join(marks, id_col)
    share = known.agg(F.avg(F.col("_toxic").cast("double"))).first()[0]
    if not share:
        return Model({})

    def bags(rows: DataFrame, most: int) -> list[tuple[int | None, bytes]]:
        """The ``most`` rows with the smallest hash of their id; only their words reach the driver."""
        chosen = rows.select(id_col, "_toxic").distinct().orderBy(F.xxhash64(id_col), id_col).limit(most)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "_text"):
                    found = [b" ".join(sorted(words_of(t), key=zlib.crc32)[:MAX_WORDS]) for t in texts(part, "_text")]
                    yield pa.RecordBatch.from_arrays([part.column("_toxic"), pa.array(found, pa.binary())], ["toxic", "words"])

        picked = allowed_docs.join(chosen, id_col).select("_toxic", "_text")
        kind = picked.schema["_toxic"].dataType.simpleString()
        return [(r[0], bytes(r[1])) for r in picked.mapInArrow(run, f"toxic {kind}, words binary").collect()]

    positive = [b for _, b in bags(known.where("_toxic = 1"), max_positive)]
    unlabelled = [b for _, b in bags(allowed_docs.select(id_col).withColumn("_toxic", F.lit(None).cast("int")), max_unlabelled)]
    model = fit(positive, unlabelled, min(max(share, 0.001), 0.9))
    labelled = bags(known, max_labelled)
    raw = np.array([model.raw_words(bag) for _, bag in labelled])
    return calibrate(model, raw, np.array([float(t) for t, _ in labelled]))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, over its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                scores = [model.score(t) for t in texts(part, text_col)]
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(scores, pa.float64())], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(
        run, f"`{id_col}` {kind}, score double"
    )


def keep_clean(
    docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Rows of ``docs`` that score under ``threshold``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array([model.score(t) < threshold for t in texts(part, text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
