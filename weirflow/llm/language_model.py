"""Language-model scoring with a gated recurrent network, in numpy.

Tokens are words (A-Z lower-cased, split at white space) and one end per document.

Output, factored by class. The most frequent words of the training documents, as many
as make up `coverage` of their tokens, are cut into classes, each with a softmax over
its members given the state; their number grows with the counts. Other words
that are broadcast go to classes by the size of their count, and all the rest,
unseen words included, to the last class; there, members follow their smoothed
counts. P(token) = P(class | state) * P(word | class[, state]) sums to one over all
tokens seen plus one unseen.

State. A gated recurrent unit reads the class of the last token, and the word
itself where it is frequent. It is trained by truncated backpropagation: windows of
WINDOW steps, the state carried from one window to the next and reset only where a
document begins. Training documents are dealt by a hash of id and text to shards of about SHARD tokens and sorted by it, so that
weights don't depend on the layout of the table; every shard trains on all its documents, from common
weights; the results are averaged, weighted by tokens. Scoring carries the state
through the whole document, so the sum is the log probability of the complete text. Texts side by side need memory for
their tokens only, whatever their lengths, and a text of more than LONG bytes is read in pieces, with the state carried.

Base scores need the count of every word. Counts are summed within a partition
first, then by word, and come back in two ways: the most frequent `head` words by
broadcast (a bound on its size), all others by a join of the words that documents
have with the counts. Nothing of the size of the vocabulary reaches the driver.

Null texts count as empty: one end token. Rows without an id are not held out; ties
and repeated rows are scored alike. Without training tokens every count is 0 and the
network keeps its first weights. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import raw_texts, ship, text_of, text_runs, tidied, word_runs, written

#: The token that ends a document; words have no white space.
END = b"\n"
WINDOW = 24
ALPHA = 0.1
#: Weights of a row, where the weights of shards are averaged, and shards averaged at a time.
BLOCK, FAN = 16_384, 64
#: Training tokens of a shard, about; bytes of texts that are read side by side; and those from which a text is read in pieces.
SHARD, SIDE, LONG = 4_000_000, 16_000_000, 4_000_000


@dataclass
class Shape:
    """Sizes. frequent: words with an embedding and a softmax of their own, in `fine` classes; coarse: classes of the others, the last for the words that are not broadcast.

    Where `frequent` is not given it follows the counts: the fewest words that make up `coverage` of all training
    tokens (of the `head` words that are broadcast at most), in as many classes as the root of their number.
    """

    hidden: int = 12
    frequent: int | None = None
    fine: int | None = None
    coverage: float = 0.7
    coarse: int = 16
    lanes: int = 512
    head: int = 131_072

    def fitted(self, counts: np.ndarray, total: int) -> Shape:
        """The shape with its sizes for these falling counts of the broadcast words."""
        n = self.frequent
        if n is None:
            n = int(np.searchsorted(np.cumsum(counts), self.coverage * total)) + 1
        n = min(n, len(counts))
        return replace(self, frequent=n, fine=self.fine or max(1, int(np.ceil(np.sqrt(n)))))


# -- counts ----------------------------------------------------------------------
def _split(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of texts in turn, as words() gives them, with empty strings where white space stands at either end; and where each text's begin."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string())))
    return lists.values, lists.offsets.to_numpy()


def _portions(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(which texts, their bytes): all texts of at most LONG bytes at once, then the longer ones in pieces."""
    short = [i for i, t in enumerate(texts) if len(t) <= LONG]
    if short:
        yield np.array(short), [texts[i] for i in short]
    for i, text in enumerate(texts):
        if len(text) > LONG:
            yield from ((np.array([i]), [piece]) for piece in text_runs(text, LONG))


def token_counts(docs: DataFrame, training, text_col: str = "text") -> DataFrame:
    """(token, n) of the documents for which `training` holds; about SIDE bytes of text are counted before sums are passed on."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ends = ["token", "n"], 0
        for batch in batches:
            ends += batch.num_rows
            for _, texts in _groups(batch, 0):
                for _, own in _portions(texts):
                    counts = pc.value_counts(_split(own)[0])
                    found = pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], names=names)
                    yield found.filter(pc.greater(pc.binary_length(counts.field(0)), 0))
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END.decode()]), pa.array([ends], pa.int64())], names=names)

    return docs.where(training).select(text_of(text_col).alias("_text")).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The broadcast words by falling count, their classes, and their log10 shares within coarse classes."""

    def __init__(self, tokens: list[bytes], counts: list[int], total: int, distinct: int, shape: Shape):
        self.counts, self.total, self.distinct = np.array(counts, float), total, distinct
        self.shape = s = shape.fitted(self.counts, total)
        n = s.frequent
        self.frequent = n
        self.index, self.tokens = {t: i for i, t in enumerate(tokens)}, pa.array(tokens, pa.binary())
        # Fine classes: stretches of the frequent words with about equal sums of root counts.
        weight = np.sqrt(np.maximum(self.counts[:n], 1)).cumsum()
        fine = np.minimum((weight - 1e-9) / (weight[-1] if n else 1) * s.fine, s.fine - 1).astype(np.int64)
        self.members = np.bincount(fine, minlength=s.fine)
        self.starts = np.concatenate([[0], np.cumsum(self.members)[:-1]])
        # Coarse classes: octaves of the count. One more entry stands for all words that are not broadcast.
        coarse = s.fine + np.minimum(np.log2(np.maximum(self.counts[n:], 1)).astype(np.int64), s.coarse - 2)
        last = s.fine + s.coarse - 1
        self.class_of = np.concatenate([fine, coarse, [last]]).astype(np.int32)
        self.classes = last + 1
        # Kinds of inputs: frequent words, then coarse classes.
        self.kind_of = np.concatenate([np.arange(n), n + self.class_of[n:] - s.fine]).astype(np.int32)
        # Smoothed mass: ALPHA for each distinct token, and for one unseen.
        smooth = self.counts + ALPHA
        rest = total - self.counts.sum() + ALPHA * (distinct - len(tokens) + 1)
        self.mass = np.bincount(self.class_of, weights=np.append(smooth, rest), minlength=self.classes)
        self.within = np.zeros(len(tokens) + 1)
        self.within[n:-1] = np.log10(smooth[n:] / self.mass[coarse])
        self.seen = np.append(self.counts > 0, False).astype(np.int64)
        self.rest_log10 = float(np.log10(rest))  # a word of the rest adds log10(c + ALPHA) less this
        self.smooth_log10 = np.append(np.log10(smooth), 0.0)
        self.norm_log10 = float(np.log10(total + ALPHA * (distinct + 1)))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all tokens in turn (the last place: not broadcast), and the number of tokens of each text; words as words() gives them."""
        values, firsts = _split(texts)
        own = pc.binary_length(values).to_numpy() > 0
        sizes = np.diff(np.concatenate([[0], np.cumsum(own)])[firsts]) + 1
        places = pc.fill_null(pc.index_in(values, self.tokens.view(pa.string())), len(self.index)).to_numpy()
        out, ends = np.empty(int(sizes.sum()), np.int32), np.cumsum(sizes) - 1
        inside = np.ones(len(out), bool)
        inside[ends] = False
        out[inside], out[ends] = places[own], self.index.get(END, len(self.index))
        return out, sizes

    def encode_long(self, text: bytes) -> Iterator[np.ndarray]:
        """The same for one text, in pieces, the end in the last one."""
        last = np.zeros(0, np.int32)
        for own in word_runs(text, LONG):
            if len(last):
                yield last
            last = np.fromiter(map(self.index.get, own, repeat(len(self.index))), np.int32, len(own))
        yield np.append(last, np.int32(self.index.get(END, len(self.index))))


# -- the network -----------------------------------------------------------------
@dataclass
class Passed:
    """What the unit went through, [steps, values, lanes]: what its gates read (the state before a step, the input, 1, the reset state), the states after, both sigmoid gates and the proposed states."""

    read: np.ndarray
    states: np.ndarray
    zr: np.ndarray
    n: np.ndarray


class Network:
    """Parameters by name in one flat vector, so that they can be averaged."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None, seed: int = 5):
        v, s = vocabulary, vocabulary.shape
        h, c, n = s.hidden, vocabulary.classes, v.frequent
        self.v, self.h = v, h
        # Biases lie beside what they are added to: "C_cb" has them in its last row, "O_ob" in its last column.
        shapes = {"E": (c + n, h), "W": (h, 3 * h), "U": (h, 2 * h), "Un": (h, h), "b": (3 * h,), "C_cb": (h + 1, c), "O_ob": (n, h + 1)}
        size = sum(int(np.prod(x)) for x in shapes.values())
        if flat is None:
            flat = np.random.default_rng(seed).normal(0, 0.15, size).astype(np.float32)
            own = flat[size - n * (h + 1) :]
            own[:] = np.concatenate([own[: n * h].reshape(n, h), own[n * h :, None]], axis=1).ravel()
        self.flat = np.ascontiguousarray(flat, np.float32)
        self.p, at = {}, 0
        for name, shape in shapes.items():
            k = int(np.prod(shape))
            self.p[name] = self.flat[at : at + k].reshape(shape)
            at += k
        both, own = self.p["C_cb"], self.p["O_ob"]
        self.p |= {"C": both[:h], "cb": both[h], "O": own[:, :h], "ob": own[:, h]}

    @classmethod
    def fresh(cls, v: Vocabulary) -> Network:
        """Small weights, biases at the logs of the counts: before training this is the unigram model."""
        net = cls(v)
        net.p["cb"][:] = np.log(np.maximum(v.mass / max(v.mass.sum(), 1e-9), 1e-22))
        net.p["ob"][:] = np.log(np.maximum(v.counts[: v.frequent], 0.5))
        net.p["b"][:] = 0
        net.p["b"][: v.shape.hidden] = 1.0  # the state is kept at first
        return net

    def step(self, inputs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, Passed]:
        """One step of the unit: inputs are rows of E already multiplied by W, plus b; a state a row."""
        passed = self.passed(inputs[None], np.zeros((1, len(inputs)), bool), state, (np.eye(3 * self.h, dtype=np.float32), np.zeros(3 * self.h, np.float32)))
        return passed.states[0].T, passed

    def embedded(self) -> np.ndarray:
        """What each kind of input reads: a frequent word its class's row and its own, the others their class's row; zeros, in the last row, where a document begins."""
        v, e = self.v, self.p["E"]
        return np.concatenate([e[v.class_of[: v.frequent]] + e[v.classes :], e[v.shape.fine : v.classes], np.zeros((1, self.h), np.float32)])

    def passed(self, inputs: np.ndarray, fresh: np.ndarray, state: np.ndarray, weights: tuple[np.ndarray, np.ndarray] | None = None) -> Passed:
        """The unit over all steps; inputs are [steps, lanes, values], which weights (W and b) take to the gates. Inside, lanes lie together for arithmetic by element.

        Sigmoids are taken as (1 + tanh(x / 2)) / 2, so what goes into them is halved.
        """
        (w, b), (steps, lanes, k), h = weights or (self.p["W"], self.p["b"]), inputs.shape, self.h
        out = Passed(*(np.empty((steps, x, lanes), np.float32) for x in (2 * h + k + 1, h, 2 * h, h)))
        out.read[:, h : h + k], out.read[:, h + k] = inputs.transpose(0, 2, 1), 1
        by_zr = np.ascontiguousarray(0.5 * np.concatenate([self.p["U"], w[:, : 2 * h], b[None, : 2 * h]]).T)
        by_n = np.ascontiguousarray(np.concatenate([w[:, 2 * h :], b[None, 2 * h :], self.p["Un"]]).T)
        state, some_fresh = np.ascontiguousarray(state.T, np.float32), fresh.any(axis=1).tolist()
        for t in range(steps):
            read, zr, n, after = out.read[t], out.zr[t], out.n[t], out.states[t]
            before = read[:h]
            before[:] = state
            if some_fresh[t]:
                before[:, fresh[t]] = 0
            np.matmul(by_zr, read[: h + k + 1], out=zr)
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            np.multiply(zr[h:], before, out=read[h + k + 1 :])
            np.matmul(by_n, read[h:], out=n)
            np.tanh(n, out=n)
            np.subtract(before, n, out=after)
            after *= zr[:h]
            after += n
            state = after
        return out

    def weights(self) -> tuple[tuple[np.ndarray, bool], tuple[np.ndarray, bool]]:
        """Of the classes and of the frequent words: weights [hidden + 1, members], the biases in the last row, and whether logits may be too large for exponentials (states lie in -1 to 1)."""
        found = self.p["C_cb"], self.p["O_ob"].T
        # Most often the largest weight alone tells that no sum of a word's is beyond.
        top = [len(w) * float(max(w.max(initial=0), -w.min(initial=0))) for w in found]
        return tuple((w, t > 60 and float(np.abs(w).sum(axis=0).max(initial=0)) > 60) for w, t in zip(found, top, strict=True))

    def by_class(self, classes: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """Rows `some` by class, and (first row, end, first word, words) of each class among them that has more than one word: a lone word is certain."""
        order = some[np.argsort(classes[some].astype(np.uint16), kind="stable")]
        cuts = np.searchsorted(classes[order], np.arange(self.v.shape.fine + 1))
        own = np.flatnonzero((np.diff(cuts) > 0) & (self.v.members > 1))
        return order, np.stack([cuts[own], cuts[own + 1], self.v.starts[own], self.v.members[own]], axis=1).tolist()

    def outputs(self, states: np.ndarray, classes: np.ndarray, ids: np.ndarray, weights=None) -> np.ndarray:
        """Natural log probabilities of the class, and of the word within a fine class, given the states."""
        (c, c_large), (o, o_large) = weights or self.weights()
        flat = _with_ones(states)
        out = np.empty(len(flat), np.float32)
        for a, b in _blocks(len(flat), c.shape[1]):
            _, sums, picked, _ = _softmax(flat[a:b] @ c, classes[a:b], c_large)
            out[a:b] = np.log(picked) - np.log(sums)
        order, groups = self.by_class(classes, np.flatnonzero(ids >= 0))
        flat, at = flat.take(order, axis=0), ids[order] - self.v.starts[classes[order]]
        sums, picked = np.ones(len(order), np.float32), np.ones(len(order), np.float32)
        for first, end, a, m in groups:
            for i, j in _blocks(end - first, m, first):
                _, sums[i:j], picked[i:j], _ = _softmax(flat[i:j] @ o[:, a : a + m], at[i:j], o_large)
        out[order] += np.log(picked) - np.log(sums)
        return out

    def window_gradient(self, x_kinds, y_classes, y_ids, fresh, weight, state) -> tuple[np.ndarray, float, np.ndarray]:
        """(gradient, loss, state after) of windows of WINDOW steps, one after another, [steps, lanes]; fresh marks where a document begins, weight is 0 for padding."""
        p, h, v = self.p, self.h, self.v
        steps, lanes = x_kinds.shape
        embedded = self.embedded()
        kinds = np.where(fresh, len(embedded) - 1, x_kinds)
        unit = self.passed(embedded.take(kinds, axis=0), fresh, state)
        flat, grad = _with_ones(_turned(unit.states).reshape(-1, h)), np.zeros_like(self.flat)
        g = Network(v, grad).p
        yc, yi, w = y_classes.ravel(), y_ids.ravel(), weight.ravel().astype(np.float32)
        scale = np.float32(1 / max(float(w.sum()), 1.0))
        (c, c_large), (o, o_large) = self.weights()
        d_states, chances = np.empty((len(flat), h), np.float32), np.empty(len(flat), np.float32)
        for a, b in _blocks(len(flat), c.shape[1]):
            own, sums, picked, places = _softmax(flat[a:b] @ c, yc[a:b], c_large)
            chances[a:b] = picked / sums
            own *= (w[a:b] * scale / sums)[:, None]
            own.reshape(-1)[places] -= w[a:b] * scale
            g["C_cb"] += flat[a:b].T @ own
            np.matmul(own, p["C"].T, out=d_states[a:b])
        loss = -float((np.log(chances + 1e-20) * w).sum())
        order, groups = self.by_class(yc, np.flatnonzero((yi >= 0) & (w > 0)))
        flat, at = flat.take(order, axis=0), yi[order] - v.starts[yc[order]]
        d_own, sums, picked = np.zeros((len(order), h), np.float32), np.ones(len(order), np.float32), np.ones(len(order), np.float32)
        # Rows of the gradient by logits would be multiplied by scale / sums; the shorter ones that they are multiplied with are.
        for first, end, a, m in groups:
            for i, j in _blocks(end - first, m, first):
                own, sums[i:j], picked[i:j], places = _softmax(flat[i:j] @ o[:, a : a + m], at[i:j], o_large)
                own.reshape(-1)[places] = picked[i:j] - sums[i:j]
                g["O_ob"][a : a + m] += own.T @ (flat[i:j] * (scale / sums[i:j])[:, None])
                np.matmul(own, p["O"][a : a + m], out=d_own[i:j])
        loss -= float(np.log(picked / sums + 1e-20).sum())
        d_own *= (scale / sums)[:, None]
        d_states[order] += d_own
        # Back through the unit; what doesn't depend on later steps is taken for all steps at once.
        d_states = _turned(d_states.reshape(steps, lanes, h))
        befores, rs, z, r, by_n = unit.read[:, :h], unit.read[:, 2 * h + 1 :], unit.zr[:, :h], unit.zr[:, h:], 1 - unit.n * unit.n
        by_n *= 1 - z
        by_z, by_r = (befores - unit.n) * z * (1 - z), rs * (1 - r)
        d_gates = np.empty((steps, 3 * h, lanes), np.float32)
        later, some_fresh = np.zeros((h, lanes), np.float32), fresh.any(axis=1).tolist()
        for t in reversed(range(steps)):
            d = d_states[t]
            d += later
            own = d_gates[t]
            np.multiply(d, by_n[t], out=own[2 * h :])
            drs = p["Un"] @ own[2 * h :]
            np.multiply(d, by_z[t], out=own[:h])
            np.multiply(drs, by_r[t], out=own[h : 2 * h])
            if t % WINDOW == 0:
                later[:] = 0  # truncated: a window's gradient stays in it
                continue
            np.matmul(p["U"], own[: 2 * h], out=later)
            d *= z[t]
            drs *= r[t]
            later += d
            later += drs
            if some_fresh[t]:
                later[:, fresh[t]] = 0
        # What all gates read is one array, so its products with theirs are the gradients of U, W, b and Un.
        both = np.matmul(d_gates, unit.read.transpose(0, 2, 1)).sum(axis=0)
        g["U"][:], g["W"][:], g["b"][:], g["Un"][:] = both[: 2 * h, :h].T, both[:, h : 2 * h].T, both[:, 2 * h], both[2 * h :, 2 * h + 1 :].T
        found, back = _sums(kinds.ravel(), _turned(np.matmul(p["W"], d_gates)).reshape(-1, h), len(embedded))
        frequent, coarse = found < v.frequent, (found >= v.frequent) & (found < len(embedded) - 1)
        g["E"][v.classes + found[frequent]] = back[frequent]
        g["E"][v.shape.fine + found[coarse] - v.frequent] = back[coarse]
        _add_rows(g["E"], v.class_of[found[frequent]], back[frequent])
        return grad, loss, unit.states[-1].T


def _turned(x: np.ndarray) -> np.ndarray:
    """[steps, lanes, values] as [steps, values, lanes], and back."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


def _with_ones(states: np.ndarray) -> np.ndarray:
    """Rows with a last value of 1, which biases are multiplied by."""
    out = np.ones((len(states), states.shape[1] + 1), np.float32)
    out[:, :-1] = states
    return out


def _blocks(rows: int, columns: int, first: int = 0, values: int = 1 << 18) -> list[tuple[int, int]]:
    """(start, end) of stretches of rows from `first` on with about so many values, which a core's cache holds."""
    most = max(64, values // max(columns, 1))
    return [(a, min(a + most, first + rows)) for a in range(first, first + rows, most)]


def _softmax(logits: np.ndarray, at: np.ndarray, large: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(exponentials in place of the logits, their sums by row, those at `at`, and where these lie among all); shifted by row only where they may be large, as rows are short."""
    if large:
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    places = np.arange(0, logits.size, logits.shape[1])
    places += at
    return logits, logits @ _ones(logits.shape[1]), logits.reshape(-1).take(places), places


@lru_cache(4096)
def _ones(n: int) -> np.ndarray:
    return np.ones(n, np.float32)


def _sums(at: np.ndarray, rows: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """(the different values of `at`, rising, and under `below`; the sum of the rows of each): sorted, then summed by segment."""
    order = np.argsort(at.astype(np.uint16) if below <= 1 << 16 else at, kind="stable")
    own = at[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return own[first], np.add.reduceat(rows.take(order, axis=0), first, axis=0)


def _add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """out[at] += rows, with repeats."""
    if len(at):
        found, sums = _sums(at, rows, len(out))
        out[found] += sums


class Trainer:
    """Adam over windows."""

    def __init__(self, net: Network, rate: float = 0.01):
        self.net, self.rate, self.m, self.s, self.t = net, rate, np.zeros_like(net.flat), np.zeros_like(net.flat), 0

    def step(self, gradient: np.ndarray, share: float = 1.0) -> None:
        """share: the window's tokens by those of a full one, so that windows where few lanes go on move the weights as little as they weigh."""
        self.t += 1
        norm = float(np.sqrt(np.dot(gradient, gradient)))
        factor = 1 / norm if norm > 1 else 1.0
        rate, by_m, by_s = share * self.rate / (1 + self.t / 400) ** 0.5, 1 - 0.9**self.t, 1 - 0.99**self.t
        # Block by block, in place: values stay in a core's cache.
        for a in range(0, len(gradient), BLOCK):
            g, m, s = gradient[a : a + BLOCK] * factor, self.m[a : a + BLOCK], self.s[a : a + BLOCK]
            m *= 0.9
            s *= 0.99
            by = g * g
            by *= 0.01
            s += by
            g *= 0.1
            m += g
            np.divide(s, by_s, out=by)
            np.sqrt(by, out=by)
            by += 1e-8
            np.divide(m, by, out=by)
            by *= rate / by_m
            self.net.flat[a : a + BLOCK] -= by


# -- lanes: documents side by side ---------------------------------------------------
def in_lanes(lengths: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lane, first step) of each document, and where lanes end, longest lane first: long documents first, each to the lane that ends first."""
    import heapq

    count = max(1, min(lanes, len(lengths)))
    heap = [(0, k) for k in range(count)]
    lane, first = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        end, k = heapq.heappop(heap)
        lane[i], first[i] = k, end
        heapq.heappush(heap, (end + int(lengths[i]), k))
    ends = np.zeros(count, np.int64)
    for end, k in heap:
        ends[k] = end
    order = np.argsort(-ends, kind="stable")
    place = np.empty(count, np.int64)
    place[order] = np.arange(count)
    return place[lane], first, ends[order]


# -- training and scoring -------------------------------------------------------------
@dataclass
class Lanes:
    """Texts laid out in lanes, one lane after the other: token places, where documents begin, lanes' starts and ends (longest first), and the place of each token in turn."""

    flat: np.ndarray
    fresh: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    cells: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, tokens: np.ndarray, sizes: np.ndarray, lanes: int) -> Lanes:
        lane, first, ends = in_lanes(sizes, lanes)
        starts = np.cumsum(ends) - ends
        cells = np.arange(len(tokens)) + np.repeat(starts[lane] + first - (np.cumsum(sizes) - sizes), sizes)
        flat = np.empty(len(tokens), np.int32)
        flat[cells] = tokens
        fresh = np.zeros(len(tokens), bool)
        fresh[cells[np.cumsum(sizes) - sizes]] = True
        return cls(flat, fresh, starts, ends, cells, sizes)

    @classmethod
    def piece(cls, tokens: np.ndarray, begins: bool) -> Lanes:
        """A part of one text in one lane."""
        n = len(tokens)
        fresh = np.zeros(n, bool)
        fresh[:1] = begins
        return cls(tokens, fresh, np.zeros(1, np.int64), np.array([n]), np.arange(n), np.array([n]))

    def windows(self, width: int, before: int = 0, full: int = 1, most: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(places, which are -1 beyond a lane's end, tokens read, tokens to predict, -1 beyond, fresh) of each window [steps, lanes that go on]; before: the token before a piece.

        Where fewer than `full` lanes go on, up to `most` windows come together, one after another, as many as make up for it.
        """
        a = 0
        while a < int(self.ends[0]):
            on = int((self.ends > a).sum())
            stop = min(a + width * max(1, min(most, full // on)), int(self.ends[0]))
            t = np.arange(a, stop)[:, None]
            within = t < self.ends[:on]
            at = np.where(within, self.starts[:on] + t, 0)
            read = self.flat[np.maximum(at - 1, 0)]
            if a == 0:
                read[0] = before  # a document begins in each lane, or a piece goes on
            yield np.where(within, at, -1), on, read, np.where(within, self.flat[at], -1), self.fresh[at] & within
            a = stop


def _read(v: Vocabulary, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes and frequent ids (-1: none) of token places."""
    return v.class_of[grid], np.where(grid < v.frequent, grid, -1)


def _train(net: Network, trainer: Trainer, lanes: Lanes, state: np.ndarray, before: int, full: int) -> tuple[float, np.ndarray]:
    loss = 0.0
    for _, on, x, y, fresh in lanes.windows(WINDOW, before, full):
        gradient, own, state = net.window_gradient(net.v.kind_of[x], *_read(net.v, y), fresh, y >= 0, state[:on])
        trainer.step(gradient, float((y >= 0).sum()) / (WINDOW * full))
        loss += own
    return loss, state


def train_on(net: Network, trainer: Trainer, texts: list[bytes]) -> tuple[float, int]:
    """One pass of truncated backpropagation over whole documents: (loss in nats, tokens)."""
    loss, tokens, short = 0.0, 0, [t for t in texts if len(t) <= LONG]
    if short:
        lanes = Lanes.of(*net.v.encode(short), net.v.shape.lanes)
        loss, _ = _train(net, trainer, lanes, np.zeros((len(lanes.ends), net.h), np.float32), 0, len(lanes.ends))
        tokens = len(lanes.flat)
    for text in (t for t in texts if len(t) > LONG):
        state, before = np.zeros((1, net.h), np.float32), -1
        for own in net.v.encode_long(text):
            more, state = _train(net, trainer, Lanes.piece(own, before < 0), state, max(before, 0), net.v.shape.lanes)
            loss, tokens, before = loss + more, tokens + len(own), int(own[-1])
    return loss, tokens


def _logs(net: Network, ready: tuple, lanes: Lanes, state: np.ndarray, before: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(natural logs of the network's part of each token's probability, by place, and the state after); ready: what the network's inputs read, and its weights."""
    embedded, weights = ready
    out = np.zeros(len(lanes.flat), np.float32)
    for at, on, x, y, fresh in lanes.windows(WINDOW, before, net.v.shape.lanes):
        unit = net.passed(embedded.take(np.where(fresh, len(embedded) - 1, net.v.kind_of[x]), axis=0), fresh, state[:on])
        state = unit.states[-1].T
        yc, yi = _read(net.v, y)
        some = np.flatnonzero(y.ravel() >= 0)
        out[at.ravel()[some]] = net.outputs(_turned(unit.states).reshape(-1, net.h)[some], yc.ravel()[some], yi.ravel()[some], weights)
    return out, state


def log10_of(net: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: log10 by the network without the counts of words that are not broadcast; tokens; broadcast tokens seen in training; sum of their log10(c + ALPHA)."""
    v, ready = net.v, (net.embedded(), net.weights())
    out = np.zeros((4, len(texts)))

    def summed(logs: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        own = logs * np.log10(np.e) + v.within[places]
        own[places >= len(v.index)] -= v.rest_log10
        firsts = np.cumsum(sizes) - sizes
        return np.array([np.add.reduceat(own, firsts), sizes, np.add.reduceat(v.seen[places], firsts), np.add.reduceat(v.smooth_log10[places], firsts)])

    short = [i for i, t in enumerate(texts) if len(t) <= LONG]
    if short:
        lanes = Lanes.of(*v.encode([texts[i] for i in short]), v.shape.lanes)
        logs, _ = _logs(net, ready, lanes, np.zeros((len(lanes.ends), net.h), np.float32))
        out[:, short] = summed(logs[lanes.cells], lanes.flat[lanes.cells], lanes.sizes)
    for i in (i for i, t in enumerate(texts) if len(t) > LONG):
        state, before = np.zeros((1, net.h), np.float32), -1
        for own in v.encode_long(texts[i]):
            logs, state = _logs(net, ready, Lanes.piece(own, before < 0), state, max(before, 0))
            out[:, i] += summed(logs, own, np.array([len(own)]))[:, 0]
            before = int(own[-1])
    return out[0], out[1].astype(np.int64), out[2], out[3]


def _groups(batch: pa.RecordBatch, column: int, most: int = SIDE) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch of about `most` bytes of text (a longer text stands alone)."""
    texts = raw_texts(batch.column(column))
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield batch.slice(start, i - start), texts[start:i]
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def vocabulary(counts: DataFrame, shape: Shape) -> Vocabulary:
    """The head of the counts: a threshold by octaves of counts leaves at most shape.head words, which come to the driver."""
    octave = F.floor(F.log2("n")).cast("int")
    sizes = {r["o"]: (r["k"], r["n"]) for r in counts.groupBy(octave.alias("o")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).collect()}
    total, distinct = sum(n for _, n in sizes.values()), sum(k for k, _ in sizes.values())
    least, room = max(sizes, default=0) + 1, shape.head
    while least - 1 in sizes and sizes[least - 1][0] <= room:
        least -= 1
        room -= sizes[least][0]
    top = counts.where((octave >= least) | (F.col("token") == END.decode())).select("token", "n").toArrow()
    tokens, own = [t.encode() for t in top.column("token").to_pylist()], top.column("n").to_pylist()
    order = sorted(range(len(tokens)), key=lambda i: (-own[i], tokens[i]))
    return Vocabulary([tokens[i] for i in order], [own[i] for i in order], total, distinct, shape)


def train(docs: DataFrame, training, v: Vocabulary, warm_rows: int = 400, warm_bytes: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Averaged weights: a bounded sample (the texts of at most warm_bytes with the least hashes) warms the network up, then every shard goes over all its training documents."""
    spark = docs.sparkSession
    rows = docs.where(training).select(F.xxhash64(F.col(f"`{id_col}`"), text_of(text_col)).alias("_row"), text_of(text_col).alias("_text"))
    net = Network.fresh(v)
    first = [r[0].encode() for r in rows.where(F.octet_length("_text") <= warm_bytes).orderBy("_row").limit(warm_rows).select("_text").collect()]
    if first:
        warm = Trainer(net, 0.02)
        for _ in range(2):
            train_on(net, warm, first)
    if not v.total:
        return net.flat
    sent = spark.sparkContext.broadcast((v, net.flat))
    shards = -(-v.total // SHARD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_v, flat = sent.value
        own = Network(own_v, flat.copy())
        trainer, tokens, held, size, shard = Trainer(own, 0.005), 0, [], 0, 0
        for batch in batches:
            # Steps follow the texts' sizes, not those of batches.
            for text in raw_texts(batch.column(1)):
                held.append(text)
                size += len(text) + 1
                if size >= SIDE:
                    tokens += train_on(own, trainer, held)[1]
                    held, size = [], 0
            if batch.num_rows:
                shard = batch.column(0)[0].as_py()
        if held:
            tokens += train_on(own, trainer, held)[1]
        if tokens:
            starts = range(0, len(own.flat), BLOCK)
            columns = [pa.array(starts, pa.int64()), pa.array([shard] * len(starts), pa.int64()), pa.array([own.flat[k : k + BLOCK].tobytes() for k in starts], pa.binary()), pa.array([tokens] * len(starts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "s", "x", "w"])

    def mean(group: pa.Table) -> pa.Table:
        group = group.sort_by("s")
        w = np.array(group.column("w").to_pylist(), float)
        x = sum(np.frombuffer(b, np.float32) * k for b, k in zip(group.column("x").to_pylist(), w / w.sum(), strict=True))
        return pa.table({"k": group.column("k")[:1], "s": group.column("s")[:1], "x": pa.array([x.astype(np.float32).tobytes()], pa.binary()), "w": pa.array([int(w.sum())], pa.int64())})

    schema = "k long, s long, x binary, w long"
    dealt = rows.withColumn("s", F.pmod("_row", F.lit(shards))).repartitionById(shards, F.col("s").cast("int")).sortWithinPartitions("_row", "_text").select("s", "_text")
    parts = written(dealt.mapInArrow(tidied("language model", run), schema), "weights")
    # Some shards at a time, so that no task holds more than FAN blocks, however many shards there are.
    while shards > FAN:
        shards = -(-shards // FAN)
        parts = written(parts.withColumn("s", F.floor(F.col("s") / FAN)).groupBy("k", "s").applyInArrow(mean, schema), "weights")
    means = parts.groupBy("k").applyInArrow(mean, schema).select("k", "x").toArrow()
    out = np.array(net.flat)
    for k, x in zip(means.column("k").to_pylist(), means.column("x").to_pylist(), strict=True):
        out[k : k + BLOCK] = np.frombuffer(x, np.float32)
    return out


def scored(docs: DataFrame, training, shape: Shape | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    ship(spark)
    shape = shape or Shape()
    counts = written(token_counts(docs, training, text_col), "counts")
    v = vocabulary(counts, shape)
    flat = train(docs, training, v, id_col=id_col, text_col=text_col)
    sent = spark.sparkContext.broadcast((v, flat))  # at most shape.head words
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.xxhash64(F.col(id_col), text_of(text_col)).alias("row"), F.col(id_col), text_of(text_col).alias("_text"))

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_v, weights = sent.value
        net = Network(own_v, weights)
        for batch in batches:
            for part, texts in _groups(batch, 2):
                score, sizes, known, base = log10_of(net, texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes), pa.array(known.astype(np.int64)), pa.array(base.astype(float)), pa.array(score.astype(float))], names=["row", id_col, "n_tokens", "head_known", "head_base", "head_score"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value[0].tokens.view(pa.string())
        for batch in batches:
            for part, texts in _groups(batch, 1):
                for which, own in _portions(texts):
                    values, firsts = _split(own)
                    other = pc.and_(pc.is_null(pc.index_in(values, known)), pc.greater(pc.binary_length(values), 0))
                    coded = values.filter(other).dictionary_encode()
                    at = np.repeat(which, np.diff(firsts))[other.to_numpy(zero_copy_only=False)]
                    pairs, times = np.unique(at * max(len(coded.dictionary), 1) + coded.indices.to_numpy(), return_counts=True)
                    at, code = np.divmod(pairs, max(len(coded.dictionary), 1))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), coded.dictionary.take(pa.array(code)), pa.array(times.astype(np.int32))], names=["row", "token", "times"])

    summary = rows.mapInArrow(tidied("language model", head), f"row long, `{id_col}` {kind}, n_tokens long, head_known long, head_base double, head_score double")
    tail = rows.select("row", "_text").mapInArrow(tidied("language model", rest), "row long, token string, times int")
    joined = tail.join(counts, "token", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("n"))
    per_row = joined.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + ALPHA)).alias("rest_base"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rest_known"))
    # Repeated rows have one hash, and their words were counted together.
    copies = F.count(F.lit(1)).over(Window.partitionBy("row"))
    full = summary.withColumn("copies", copies).join(per_row, "row", "left")
    base, known = F.coalesce(F.col("rest_base") / F.col("copies"), F.lit(0.0)), F.coalesce((F.col("rest_known") / F.col("copies")).cast("long"), F.lit(0))
    return full.select(
        id_col, "n_tokens", (F.col("head_known") + known).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("head_base") + base - F.col("n_tokens") * F.lit(v.norm_log10)).alias("base_score"), (F.col("head_score") + base).alias("score"),
    )
