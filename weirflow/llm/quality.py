"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

Each pair of a better and a worse document is a comparison that the better one
won. Scores are linear in features of the text; weights minimise the logistic
loss of feature differences over the pairs, with a small ridge. The threshold is
a quantile of the scores of the labelled documents, and the final score maps the
ranking to 0..1 so that the threshold stands at `cut`.

Features come from the whole text and nothing else. A null text counts as empty
and has the features of an empty text. Labels that are null, or other than 0 and
1, are left out; documents may have several labels, and ties are equal scores. An
empty table gives no rows. Without labels of both kinds, every score is `cut`.
Columns other than the id and the text are ignored.

Two bounds hold for what is fitted, not for what is scored: the labelled rows are at
most `max_rows`, those of the smallest hash of the id, which spreads over all labels;
and of their better-worse pairs `pairs` are drawn (fit_pairs). Features are shares of kinds of bytes,
words and lines, and hashed trigrams of bytes, so that the ranking learns from contents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import ship, strings, text_of, tidied

#: Features of the surface, and the number of hashed byte trigrams that make up the rest.
SURFACE = ("log_words", "log_bytes", "upper", "digit", "punctuation", "symbol", "other", "line", "distinct", "distinct_lines", "word_bytes", "next_same", "common_word", "line_words", "symbol_words", "upper_words")
GRAMS = 256
RIDGE, GRAM_RIDGE = 1e-2, 1.0
#: Fixed value: a multiplier that spreads trigrams over the hashes (2**32 by the golden ratio).
_SPREAD = 2_654_435_761


def _classes() -> np.ndarray:
    """Of each byte: 0 other ASCII, 1 upper, 2 digit, 3 prose punctuation, 4 symbol, 5 space, 6 line end, 7 not ASCII, 8 lower."""
    out = np.zeros(256, np.int64)
    for b in range(33, 127):
        out[b] = 4
    for chars, kind in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (".,;:'\"-()?!", 3), ("abcdefghijklmnopqrstuvwxyz", 8), (" \t", 5), ("\n", 6)):
        for c in chars:
            out[ord(c)] = kind
    out[128:] = 7
    return out


_CLASS = _classes()


def grams(raw: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Counts of the trigrams of a text's bytes (A-Z as a-z) by hash, some of them at a time."""
    out = np.zeros(GRAMS, np.int64)
    for at in range(0, max(0, len(raw) - 2), step):
        own = raw[at : at + step + 2].astype(np.uint32)
        own[(own >= 65) & (own <= 90)] += 32
        g = own[:-2] << np.uint32(16) | own[1:-1] << np.uint32(8) | own[2:]
        out += np.bincount((g * np.uint32(_SPREAD) >> np.uint32(24)).astype(np.int64), minlength=GRAMS)
    return out


def features(text: str) -> np.ndarray:
    """The features of one text: those of SURFACE, then root shares of its trigrams."""
    data = text.encode()
    n = len(data)
    if not n:
        return np.zeros(len(SURFACE) + GRAMS)
    raw = np.frombuffer(data, np.uint8)
    k = np.bincount(_CLASS, weights=np.bincount(raw, minlength=256), minlength=9)
    tokens = text.split()
    m = max(1, len(tokens))
    lines = text.split("\n")
    letters = max(1.0, k[1] + k[8])
    counts: dict[str, int] = {}
    get = counts.get
    for t in tokens:
        counts[t] = get(t, 0) + 1
    symbols = sum(c for t, c in counts.items() if not t[-1].isalnum() and t[-1] not in ".,;:?!'\")")
    upper = sum(c for t, c in counts.items() if t.isupper())
    same = sum(map(str.__eq__, tokens, tokens[1:]))
    surface = [
        np.log1p(len(tokens)), np.log1p(n), k[1] / letters, k[2] / n, k[3] / n, k[4] / n, k[0] / n, k[6] / m, len(counts) / m, len(set(lines)) / len(lines), n / m / 10, same / m,
        max(counts.values(), default=0) / m, np.log1p(m / len(lines)), symbols / m, upper / m,
    ]
    return np.concatenate([surface, np.sqrt(grams(raw) / max(1, n - 2))])


def fit_pairs(better: np.ndarray, worse: np.ndarray, pairs: int = 20_000, ridge: float | np.ndarray = 1e-2, steps: int = 60, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and scales of a Bradley-Terry model, by Newton steps on the logistic loss of the feature differences of `pairs` drawn pairs."""
    both = np.concatenate([better, worse])
    scale = both.std(axis=0)
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(seed)
    d = (better[rng.integers(len(better), size=pairs)] - worse[rng.integers(len(worse), size=pairs)]) / scale
    w, ridge = np.zeros(d.shape[1]), np.broadcast_to(ridge, d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # the chance that the worse one wins
        gradient = -(d * p[:, None]).mean(axis=0) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w, scale


class Model:
    """Scores by features; see fit()."""

    def __init__(self, weights: np.ndarray | None, scale: np.ndarray | None, threshold: float, spread: float, cut: float):
        self.weights, self.scale, self.threshold, self.spread, self.cut = weights, scale, threshold, spread, cut

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.cut)
        z = (x / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip((z - self.threshold) / self.spread + np.log(self.cut / (1 - self.cut)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, cut: float = 0.7) -> Model:
    """A model from labelled features; the threshold is the score quantile that separates the labels best."""
    if len(y) == 0 or y.min() == y.max():
        return Model(None, None, 0.0, 1.0, cut)
    # Trigrams are many and each says little, so their weights are held closer to 0.
    ridge = np.where(np.arange(x.shape[1]) < len(SURFACE), RIDGE, GRAM_RIDGE)
    w, scale = fit_pairs(x[y == 1], x[y == 0], ridge=ridge)
    z = (x / scale) @ w
    low, high = z[y == 0], z[y == 1]
    levels = np.linspace(0, 1, 1001)
    at = np.quantile(z, levels)
    error = (low[None, :] >= at[:, None]).mean(axis=1) + (high[None, :] < at[:, None]).mean(axis=1)
    best = np.flatnonzero(error <= error.min() + 1e-12)
    q = levels[best].mean()  # the middle of the levels that do as well
    middle = 0.5 * (at[best[0]] + at[best[-1]]) if at[best[-1]] > at[best[0]] else float(np.quantile(z, q))
    return Model(w, scale, float(middle), float(max(z.std() / 4, 1e-6)), cut)


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most max_rows labelled documents."""
    ship(docs.sparkSession)
    good = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1))
    # Bounded by max_rows, so it can be broadcast.
    some = F.broadcast(good.orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t).astype(np.float32).tobytes() for t in strings(batch.column(1))], pa.binary())], names=["label", "x"])

    found = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(some, "_id").select("_label", "_text").mapInArrow(run, "label int, x binary").toArrow()
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).astype(float).reshape(-1, len(SURFACE) + GRAMS)
    y = np.array(found.column("label").to_pylist(), int)
    order = np.lexsort((*x.T, y))  # the same model whatever the order of arrival
    return x[order], y[order]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every document."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, batch.column(1)), pa.float64())], names=[id_col, "score"])

    return docs.select(F.col(id_col), text_of(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that score at least the model's cut, with all their columns."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column(batch.schema.get_field_index(text_col))) >= model.cut))

    return docs.mapInArrow(tidied("quality", run), docs.schema)


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    return model.scores(np.array([features(t) for t in strings(texts)], float).reshape(-1, len(SURFACE) + GRAMS))


def remainder(id_col: str = "doc_id", n: int = 4):
    """crc32 of the id as text, mod n; null ids have none."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, cut: float = 0.7) -> Model:
    """A model from the labelled rows that are not held out (remainder 2)."""
    x, y = labelled(docs, labels.where(remainder() != 2), max_rows)
    return fit(x, y, cut)
