"""Toxicity: a support vector machine with a gappy subsequence string kernel and Nystroem landmarks.

Kernel.  A word, between two edge marks, is described by all its subsequences of three bytes that span at most ``SPAN + 1``
places, each weighted with ``DECAY ** span``; the kernel of two words is the inner product of these weights, divided by a
norm that depends on the words' lengths.  An inserted character or a gap only lengthens a span, so that ``id*iot`` stays
near ``idiot``.  Runs of three or more one-letter words (``i d i o t``) also count as the word they spell, and a word with
marks before its last letter (``i-d-i-o-t``) also as the word without them.

Learning.  A labelled text, be it a sentence or a long document, is a bag of words of which only some word need be toxic
(MI-SVM: the strongest word stands for a toxic bag, words of clean texts are negative, the hardest are mined in rounds).  Words are mapped to their kernels with ``LANDMARKS`` landmark words, whitened, and a linear
machine with squared hinge loss is fitted by Newton steps.  As the kernel is an explicit inner product, the machine folds into one
weight a subsequence, which scores any word exactly as the kernel expansion would, without visiting the landmarks.

A text's score is a logistic curve over its largest word margin and the numbers and shares of its words above some margins
(a word that is an insult by chance is rare in a long text).  All is fitted on the driver on at most
``MAX_TOXIC + MAX_CLEAN`` labelled documents of at most ``MAX_BYTES`` in all, chosen by a digest of their ids; every text
is scored whole.

Defined results: a null or empty text has no words and the largest margin ``EMPTY``; labels that are null are left out, and a document labelled
twice is toxic if any label says so; without labels of both kinds every score is 0; repeated rows are scored each; an empty table
gives an empty result; only id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import LOWER_BYTES, _IS_SPACE, batches, in_small_batches, joined, tidy, written

SPAN, DECAY, LANDMARKS, NOISY, MINED, COST = 5, 0.7, 256, 200, 2500, 10.0
FOLDS = 3
MAX_TOXIC, MAX_CLEAN, MAX_BYTES = 1500, 2500, 16 << 20
EMPTY = -2.0
_PAIRS = [(g, h) for h in range(2, SPAN + 1) for g in range(1, h)]


def _classes() -> np.ndarray:
    """Each byte's class below 128: A-Z as a-z, white space as 32 (the edge mark), UTF-8 continuation bytes in free places."""
    out = np.frombuffer(LOWER_BYTES, np.uint8).astype(np.int32)
    out[_IS_SPACE] = 32
    free = [*range(2, 9), *range(14, 32), *range(65, 91)]
    for i in range(64):
        out[128 + i] = free[i % len(free)]
    out[192:] = 1
    return out


_CLASS = _classes()
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def _norm(length: np.ndarray) -> np.ndarray:
    """The norm of words of so many bytes."""
    total = np.zeros(len(length))
    for _, h in _PAIRS:
        total += np.maximum(length + 2 - h, 0) * DECAY ** (2 * h)
    return np.sqrt(total)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words of bytes that start and end with white space."""
    space = _IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    return edge[0::2], edge[1::2]


def _codes(data: np.ndarray):
    """For each pair of gaps: (span, positions that are valid, code of the subsequence that starts at each position)."""
    cls = _CLASS[data]
    gaps = np.flatnonzero(_IS_SPACE[data])
    left = np.diff(gaps, append=len(data))
    ahead = np.repeat(gaps, left) + np.repeat(left, left) - np.arange(gaps[0], len(data)) if len(gaps) else np.empty(0, np.int64)
    for g, h in _PAIRS:  # ahead: distance to the next white space
        n = len(data) - h
        if n > 0:
            yield h, ahead[:n] >= h, (cls[:n] << 14) | (cls[g : n + g] << 7) | cls[h:]


def word_margins(data: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, ends, margins without bias) of the words of bytes that start and end with white space."""
    begin, end = word_spans(data)
    sums = np.zeros(len(data) + 1, np.float64)
    own = np.zeros(len(data), np.float32)
    for h, valid, code in _codes(data):
        own[: len(code)] += np.where(valid, weights[code], np.float32(0)) * np.float32(DECAY**h)
    np.cumsum(own, out=sums[1:])
    return begin, end, (sums[end] - sums[begin - 1]) / _norm(end - begin)


def spelled(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, bytes]]:
    """(index of the first word, the word spelled) of each run of three or more one-byte words."""
    single = (end - begin == 1).astype(np.int8)
    edge = np.flatnonzero(np.diff(single, prepend=0, append=0))
    return [(a, data[begin[a:b]].tobytes()) for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= 3]


def unmarked(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, bytes]]:
    """(index, the word without its marks) of each word with a mark before its last letter."""
    at = np.flatnonzero(_MARK[data[:-1]] & ~_IS_SPACE[data[1:]] & ~_MARK[data[1:]])
    words = np.unique(np.searchsorted(begin, at, side="right") - 1).tolist() if len(at) else []
    found = [(i, data[begin[i] : end[i]]) for i in words]
    return [(i, w[~_MARK[w]].tobytes()) for i, w in found]


#: Margins above which a text's words are counted.
STEPS = (-0.5, 0.0, 0.5)


def text_features(margin: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each text: its largest word margin (held within 3), and how many and how large a share of its words lie above each step.

    ``first``: where each text's margins begin (n + 1); a text without words has the margin EMPTY.
    """
    out = np.zeros((len(words), 1 + 2 * len(STEPS)))
    out[:, 0] = EMPTY
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        out[some, 0] = np.clip(np.maximum.reduceat(margin, first[some]), -3, 3)
        for k, step in enumerate(STEPS):
            above = np.add.reduceat((margin > step).astype(np.int64), first[some])
            out[some, 1 + 2 * k] = np.log1p(above)
            out[some, 2 + 2 * k] = np.log1p(100.0 * above / np.maximum(words[some], 1))
    return out


@dataclass
class Model:
    weights: np.ndarray  # of the subsequences
    bias: float
    texts: np.ndarray  # of a text's features, and the shift last

    def margins(self, texts: pa.Array) -> np.ndarray:
        """The log odds of each text."""
        data, starts = joined(texts)
        data = np.concatenate((np.array([32], np.uint8), data))
        begin, end, margin = word_margins(data, self.weights)
        first = np.searchsorted(begin, starts + 1)
        runs = spelled(data, begin, end) + unmarked(data, begin, end) if len(begin) else []
        if runs:
            at = np.array([i for i, _ in runs])
            _, _, more = word_margins(np.frombuffer(b" " + b" ".join(w for _, w in runs) + b" ", np.uint8), self.weights)
            np.maximum.at(margin, at, more)
        features = text_features(margin + self.bias, first, np.diff(first))
        return features @ self.texts[:-1] + self.texts[-1]

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(margins, -30, 30)))


def _words(text: str) -> list[bytes]:
    """A text's words, and those that its runs of letters and marked words stand for."""
    words = text.encode().translate(LOWER_BYTES).split()
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    spans = word_spans(data)
    return words + [w for _, w in spelled(data, *spans) + unmarked(data, *spans)]


class _Kernel:
    """Subsequence weights of a list of words, flat."""

    def __init__(self, words: list[bytes]):
        data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
        begin, end = word_spans(data)
        hit = np.zeros(len(data) + 1, np.int64)
        hit[begin] = 1
        owner = np.cumsum(hit)[: len(data)] - 1
        owner[begin - 1] += 1  # an edge mark belongs to the word after it
        at, code, value = [], [], []
        for h, valid, codes in _codes(data):
            i = np.flatnonzero(valid)
            at.append(owner[i])
            code.append(codes[i])
            value.append(np.full(len(i), DECAY**h, np.float32))
        order = np.argsort(np.concatenate(at), kind="stable")
        self.owner, self.code, self.value = (np.concatenate(x)[order] for x in (at, code, value))
        self.value = (self.value / _norm(end - begin)[self.owner]).astype(np.float32)
        self.n = len(words)
        self.known, self.column = np.unique(self.code, return_inverse=True)
        self.begin = np.searchsorted(self.owner, np.arange(self.n + 1))

    def one(self, i: int) -> np.ndarray:
        """The weights of one word's subsequences, a place for each that is known."""
        part = slice(self.begin[i], self.begin[i + 1])
        return np.bincount(self.column[part], self.value[part], len(self.known))

    def against(self, table: np.ndarray) -> np.ndarray:
        """The kernel of all words with a combination of words."""
        return np.bincount(self.owner, table[self.column] * self.value, self.n)

    def spread(self, table: np.ndarray) -> np.ndarray:
        """A combination as one weight for each possible subsequence."""
        out = np.zeros(1 << 21, np.float32)
        out[self.known] = table
        return out


def _score(words: list[bytes], weights: np.ndarray, bias: float, step: int = 20_000) -> np.ndarray:
    """Margins of a list of words, some at a time."""
    parts = [word_margins(np.frombuffer(b" " + b" ".join(words[i : i + step]) + b" ", np.uint8), weights)[2] for i in range(0, len(words), step)]
    return np.concatenate(parts) + bias if parts else np.empty(0)


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine, by Newton steps on its support vectors."""
    z1 = np.hstack([z, np.ones((len(z), 1))])
    ridge = np.eye(z1.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(z1.shape[1])
    for _ in range(30):
        on = y * (z1 @ w) < 1
        weighted = z1[on] * cost[on, None]
        new = np.linalg.solve(ridge + weighted.T @ z1[on], weighted.T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights and shift of P(toxic | features), with a ridge that keeps them finite on separable data."""
    x = np.hstack([x, np.ones((len(x), 1))])
    keep = ridge * np.eye(x.shape[1])
    keep[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _corrupted(word: bytes, rng: np.random.Generator) -> list[bytes]:
    """The word with one and with two characters put into it, with one doubled, and with a mark after each."""
    out = []
    for times in (1, 1, 2):
        new = word
        for _ in range(times):
            at = int(rng.integers(1, max(2, len(new))))
            new = new[:at] + bytes([b"*.-_'~+=abcdefghijklmnopqrstuvwxyz"[int(rng.integers(0, 34))]]) + new[at:]
        out.append(new)
    at, mark = int(rng.integers(0, len(word))), bytes([b"*.-_"[int(rng.integers(0, 4))]])
    letters = word.decode(errors="replace")
    return [*out, word[: at + 1] + word[at:], mark.decode().join(letters).encode()]


def fit(texts: list[str], toxic: list[int], rounds: int = 3, seed: int = 5) -> Model:
    """Learn from whole labelled documents.

    The words are learnt once for each fold, on all other texts; the curve over a text's features is fitted on features out of
    fold, and the machines, which are linear, are averaged.
    """
    y = np.array(toxic)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << 21, np.float32), EMPTY, np.array([0.0] * (1 + 2 * len(STEPS)) + [-30.0]))
    place: dict[bytes, int] = {}
    rows, sizes = [], []
    for t in texts:
        ids = [place.setdefault(w, len(place)) for w in _words(t or "")]
        rows.append(np.array(ids, np.int64))
        sizes.append(len(ids))
    vocab, sizes = list(place), np.array(sizes)
    del place
    fold = np.arange(len(y)) % FOLDS
    features = np.zeros((len(y), 1 + 2 * len(STEPS)))
    learnt = []
    for k in range(FOLDS):
        own, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        if not len(rest) or y[rest].min() == y[rest].max():
            rest = np.arange(len(y))
        learnt.append(_fit_words(vocab, [rows[i] for i in rest], y[rest], rounds, seed + k))
        if len(own):
            score = _score(vocab, *learnt[-1])
            features[own] = text_features(np.concatenate([score[rows[i]] for i in own]), np.concatenate(([0], np.cumsum(sizes[own]))), sizes[own])
    weights, bias = (sum(x) / FOLDS for x in zip(*learnt, strict=True))
    return Model(weights, bias, _logistic(features, y))


def _fit_words(vocab: list[bytes], rows: list[np.ndarray], y: np.ndarray, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights of the subsequences, and the bias, from bags of words and their labels."""
    rng = np.random.default_rng(seed)
    rows = [np.unique(r) for r in rows]
    empty = np.empty(0, np.int64)
    seen = np.stack([np.bincount(np.concatenate([empty, *(r for r, label in zip(rows, y, strict=True) if label == k)]), minlength=len(vocab)) for k in (0, 1)], 1).astype(float)
    score = np.log((seen[:, 1] + 0.5) / (y.sum() + 1)) - np.log((seen[:, 0] + 0.5) / ((1 - y).sum() + 1))
    clean = np.flatnonzero(seen[:, 0] > 0)
    common = clean[np.argsort(-seen[clean, 0], kind="stable")[:MINED]]
    hard = empty
    weights, bias = np.zeros(1 << 21, np.float32), EMPTY
    for _ in range(rounds):
        top = [int(r[np.argmax(score[r])]) for r, label in zip(rows, y, strict=True) if label and len(r)]
        if not top or not len(clean):
            break
        witness, bags_of = np.unique(top, return_counts=True)
        keep = seen[witness, 0] * (y.sum() + 1) < 0.2 * seen[witness, 1] * ((1 - y).sum() + 1)
        witness, bags_of = (witness[keep], bags_of[keep]) if keep.any() else (witness, bags_of)
        often = witness[np.argsort(-bags_of, kind="stable")[:NOISY]]
        noisy = [w for i in often for w in _corrupted(vocab[i], rng)]
        negative = np.setdiff1d(np.concatenate([common, hard, clean[rng.permutation(len(clean))[:MINED]]]), witness)
        k = _Kernel([vocab[i] for i in witness] + noisy + [vocab[i] for i in negative])
        label = np.array([1.0] * (len(witness) + len(noisy)) + [-1.0] * len(negative))
        cost = np.concatenate([np.log1p(bags_of) + 1, np.full(len(noisy), 1.0), 1 + np.log1p(seen[negative, 0]) / 4])
        cost[label > 0] *= cost[label < 0].sum() / cost[label > 0].sum()
        best = np.argsort(-bags_of, kind="stable")[: LANDMARKS // 3]
        best = np.concatenate([best, len(witness) + rng.permutation(len(noisy))[: LANDMARKS // 3]])
        marks = np.concatenate([best, len(witness) + len(noisy) + rng.permutation(len(negative))[: LANDMARKS - len(best)]])
        gram = np.empty((k.n, len(marks)))
        for j, i in enumerate(marks):
            gram[:, j] = k.against(k.one(int(i)))
        values, vectors = np.linalg.eigh(gram[marks] + 1e-9 * np.eye(len(marks)))
        good = values > 1e-6 * values.max()
        whiten = vectors[:, good] / np.sqrt(values[good])
        w, bias = _svm(gram @ whiten, label, COST * cost)
        both = np.zeros(len(k.known))
        for a, i in zip(whiten @ w, marks, strict=True):
            both += a * k.one(int(i))
        weights = k.spread(both)
        score = _score(vocab, weights, bias)
        hard = clean[np.argsort(-score[clean], kind="stable")[:MINED]]
    return weights, bias


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list[str], list[int]]:
    """A bounded sample of labelled documents, the same on every run.

    Texts are chosen by their lengths before any is collected; one that doesn't fit into what is left is left out alone.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(F.col(label_col)) > 0).cast("int").alias("_y"))
    some = known.limit(0)
    for label, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        some = some.unionByName(known.where(F.col("_y") == label).orderBy(F.xxhash64("_id"), "_id").limit(most))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(some), "_id").dropDuplicates(["_id"])
    rows = written(rows.select("_id", "_t", "_y", F.coalesce(F.octet_length("_t"), F.lit(0)).alias("_n")), "toxicity-rows")
    order = lambda r: str(r["_id"])[::-1]
    sizes = sorted(rows.select("_id", "_y", "_n").collect(), key=order)
    taken, size = [], 0
    for r in sizes:
        if size + r["_n"] <= MAX_BYTES:
            size += r["_n"]
            taken.append(r)
    if lost := {r["_y"] for r in sizes} - {r["_y"] for r in taken}:
        raise ValueError(f"no text with the label {lost.pop()} fits into {MAX_BYTES} bytes")
    if len(taken) < len(sizes):
        rows = rows.where(F.col("_id").isin([r["_id"] for r in taken]))
    found = sorted(rows.select("_id", "_t", "_y").collect(), key=order)
    return [r["_t"] or "" for r in found], [r["_y"] for r in found]


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, margin and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(it):
        for batch in it:
            for a, b in batches(batch.column(1).cast(pa.large_string()), 1 << 20):
                m = sent.value.margins(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(m), pa.array(sent.value.scores(m))], names=[id_col, "margin", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_small_batches(docs).select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(tidy(score), f"`{id_col}` {kind}, margin double, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Train on the labelled documents and score all: id, margin, score."""
    return score_documents(docs, fit(*training_rows(docs, labels, id_col, text_col, label_col)), id_col, text_col)


def clean_documents(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold, with the same columns."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def keep(it):
        for batch in it:
            for a, b in batches(batch.column(at).cast(pa.large_string()), 1 << 20):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(sent.value.scores(sent.value.margins(part.column(at))) < threshold))

    return in_small_batches(docs).mapInArrow(tidy(keep), docs.schema)
