"""Document quality by a conditional random field over lines.

Every line of a text is labelled good or bad from features of its own and of the lines beside it:
letters, capitals, digits, marks, word lengths, repeated words. A linear-chain field ties neighbours.
The marginals of forward-backward, weighted by the lines' lengths, give a document's share of good
text, and a logistic curve fitted to the documents' labels turns that into a score.

Labels are of documents, so lines start with their document's label; twice, the field is
refitted with the lines of bad documents that it finds good relabelled as good.

Fitting uses the whole texts of up to ``per_class`` labelled documents of either class (at most ``class_bytes``, and at most ``class_lines`` lines, for what the driver holds goes by lines;
a text of more lines than that is not drawn); chains
are cut into segments of 256 lines for fitting only. Scoring takes whole texts, however long: their lines are measured some at a time, and
three numbers a line are kept for the chain.

Defined cases: null and empty texts are one empty line; without labels of both classes every score is
the share of label 1 (or 0.5); repeated rows come out once each; an empty table gives no rows; other columns are kept or
ignored as the caller asks, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import fold, slices, text_of
from .labelled import CLASS_BYTES, FOLDS, sample, segments

PER_CLASS = 2000
#: Lines of a class's texts that are fitted.
CLASS_LINES = 1 << 17
THRESHOLD = 0.3

_CLASS = np.full(256, 5, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[128:] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 4
_OWN = 11
#: Lines that are measured at a time, and lines of a chain in fitting.
_LINES, _SEGMENT = 1 << 15, 256


def own_features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line by itself, line lengths in bytes)."""
    raw = [x.encode() for x in lines]
    size = np.array([len(x) for x in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    row = np.repeat(np.arange(len(raw)) * 6, size)
    row += _CLASS[data]
    kinds = np.bincount(row, minlength=6 * len(raw)).reshape(-1, 6).astype(float)
    del row
    words = np.empty((len(raw), 3))
    for i, x in enumerate(lines):
        w = x.split()
        words[i] = len(w), len(set(w)), sum(map(eq, w, w[1:]))
    n = np.maximum(size, 1)
    nw = np.maximum(words[:, 0], 1)
    inked = np.maximum(size - kinds[:, 3], 1)
    own = np.empty((len(raw), _OWN))
    own[:, 0] = kinds[:, 0] / inked
    own[:, 1] = kinds[:, 1] / np.maximum(kinds[:, 0] + kinds[:, 1], 1)
    own[:, 2] = kinds[:, 2] / inked
    own[:, 3] = kinds[:, 4] / inked
    own[:, 4] = kinds[:, 5] / inked
    own[:, 5] = np.minimum(1, 10 * own[:, 4])
    own[:, 6] = words[:, 1] / nw
    own[:, 7] = words[:, 2] / nw
    own[:, 8] = np.minimum(inked / nw, 20) / 10
    own[:, 9] = np.log1p(words[:, 0]) / 4
    own[:, 10] = kinds[:, 3] / n
    return own, size


def split_lines(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """All lines, and their number by text."""
    lines: list[str] = []
    count = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = (t or "").split("\n")
        count[i] = len(own)
        lines += own
    return lines, count


def beside(values: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the lines before and after; at a text's ends the line's own."""
    first = np.cumsum(count) - count
    last = first + count - 1
    before, after = np.roll(values, 1, axis=0), np.roll(values, -1, axis=0)
    before[first], after[last] = values[first], values[last]
    return before, after


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line with its neighbours' and a constant, lines by document, line lengths in bytes), for fitting."""
    lines, count = split_lines(texts)
    x, size = np.ones((len(lines), 3 * _OWN + 1)), np.empty(len(lines), np.int64)
    for k in range(0, len(lines), _LINES):
        x[k : k + _LINES, :_OWN], size[k : k + _LINES] = own_features(lines[k : k + _LINES])
    for j in range(_OWN):
        x[:, _OWN + j], x[:, 2 * _OWN + j] = beside(x[:, j], count)
    return x, count, size


def within_lines(rows: list[tuple[int, str]], most: int) -> list[tuple[int, str]]:
    """The (label, text) rows, in their order, whose texts fit into ``most`` lines of their label."""
    left: dict[int, int] = {}
    out = []
    for y, text in rows:
        n = text.count("\n") + 1
        if n <= left.setdefault(y, most):
            left[y] -= n
            out.append((y, text))
    return out


class Model:
    """Fitted weights: of lines (mean, scale, weights, transitions) and of the document's curve."""

    def __init__(self, rows: list[tuple[int, str]], counts: dict[int, int], class_lines: int = CLASS_LINES):
        rows = within_lines(rows, class_lines)
        total = sum(counts.values())
        self.base = counts.get(1, 0) / total if total else 0.5
        self.weights = None
        y = np.array([r[0] for r in rows], np.int64)
        if len(set(y.tolist())) < 2:
            return
        x, count, size = line_features([r[1] for r in rows])
        self.mean, self.scale = x.mean(0), x.std(0)
        self.mean[-1], self.scale[-1] = 0, 1
        self.scale[self.scale < 1e-6] = 1
        x -= self.mean
        x /= self.scale
        z = x
        doc = np.repeat(y, count)
        labels = doc.copy()
        for again in range(3):
            if again:
                labels = np.where((doc == 0) & (self.lines(z @ self.weights, count) > 0.5), 1, doc)
                if len(set(labels.tolist())) < 2:
                    labels = doc.copy()
            self.weights, self.trans = crf.fit(lambda w: z @ w, lambda g: z.T @ g, z.shape[1], labels, segments(count, _SEGMENT), rounds=60)
        share = self.shares(self.lines(z @ self.weights, count), count, size)
        rates = np.bincount(y, minlength=2) / len(y)
        wanted = np.array([1 - self.base, self.base])
        self.curve = crf.logistic(share, y, (wanted / rates)[y])

    def lines(self, unary: np.ndarray, count: np.ndarray) -> np.ndarray:
        return crf.marginals(unary, count, self.trans)

    def unary(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score of label 1 over label 0 by line, lines by document, line lengths in bytes): of each line only what it says of itself and of the lines beside it is kept."""
        lines, count = split_lines(texts)
        w = self.weights / self.scale
        parts = np.stack([w[:_OWN], w[_OWN : 2 * _OWN], w[2 * _OWN : 3 * _OWN]], axis=1)
        says, size = np.empty((len(lines), 3)), np.empty(len(lines), np.int64)
        for k in range(0, len(lines), _LINES):
            own, size[k : k + _LINES] = own_features(lines[k : k + _LINES])
            says[k : k + _LINES] = own @ parts
        del lines
        # a line speaks of the one after it as its "before", and of the one before it as its "after"
        before, after = beside(says[:, 1], count)[0], beside(says[:, 2], count)[1]
        return says[:, 0] + before + after + self.weights[-1] - self.mean[:-1] @ w[:-1], count, size

    @staticmethod
    def shares(p: np.ndarray, count: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Length-weighted means by document of the marginals, and of their log-odds."""
        first = np.cumsum(count) - count
        weight = size + 1.0
        total = np.add.reduceat(weight, first)
        q = np.add.reduceat(weight * p, first) / total
        bad = np.add.reduceat(weight * (p < 0.5), first) / total
        return np.column_stack([q, bad])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if self.weights is None:
            return np.full(len(texts), self.base)
        unary, count, size = self.unary(texts)
        share = self.shares(self.lines(unary, count), count, size)
        return 1 / (1 + np.exp(-np.clip(np.column_stack([share, np.ones(len(share))]) @ self.curve, -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES, class_lines: int = CLASS_LINES) -> Model:
    return Model(*sample(docs, labels, "quality", per_class, class_bytes), class_lines)


def _score(model, at: int, keep, name: str = "text"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, name):
            yield from keep(b, model.score(b.column(at).to_pylist()))

    return run


def quality_scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""
    d = docs.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), text_of().alias("text"))

    def keep(b: pa.RecordBatch, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_score(model, 2, keep), f"doc_id {kind}, held_out boolean, score double, predicted int")


def quality_filter(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score ``threshold`` or more, with all their columns."""
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    docs = docs.withColumn(docs.columns[at], text_of(docs.columns[at]))

    def keep(b: pa.RecordBatch, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(_score(model, at, keep, docs.columns[at]), docs.schema)
