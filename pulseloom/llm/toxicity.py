"""Toxic spans by a conditional random field over tokens.

Labels are of documents, so tokens are labelled by distant supervision: words and word beginnings
whose document frequency among toxic documents exceeds that among clean ones by far mark a token
of a toxic document as toxic, all other tokens are clean. A linear-chain field over
lower-cased words, with their neighbours' evidence as features, is fitted to those tokens. The marginals of
forward-backward aggregate to a document's score (a logistic curve over the expected number
of toxic tokens, their density and the highest marginal), and runs of tokens above one half are the offending offsets.

Fitting uses the whole texts of up to ``per_class`` labelled documents of either class (at most ``class_bytes``), and
of their traits the ``traits_kept`` that speak loudest; chains are cut into segments of 256 words for fitting only. Scoring takes whole
texts, however long: one is read some words at a time, and only numbers are kept of them.

Words are found in the text as it is and lower-cased one by one, so offsets are those of the text, whatever its letters become.
Defined cases: null and empty texts have no token and score as a text without toxic tokens; without labels of both
classes every score is the share of label 1 (or 0.5); repeated rows come out once each; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import fold, slices, text_of
from .labelled import CLASS_BYTES, FOLDS, sample, segments

PER_CLASS = 2000
THRESHOLD = 0.5
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 200_000
_SEGMENT = 256
#: Words of a text that are held at a time.
_WORDS = 1 << 16


def words(text: str | None) -> Iterator[list[str]]:
    """The words of a text, some at a time."""
    if len(text or "") < 1 << 20:
        yield _WORD.findall(text or "")
        return
    found = (m[0] for m in _WORD.finditer(text))
    while some := list(islice(found, _WORDS)):
        yield some


def traits(word: str) -> list[str]:
    """What may speak for a word: itself, and its beginnings of three to eight letters."""
    return [word, *[word[:k] + "*" for k in range(3, min(8, len(word)) + 1)]]


def _surprise(a: int, n1: int, b: int, n0: int) -> float:
    """Likelihood-ratio statistic of a of n1 against b of n0; a bound on it holds against many candidates."""
    share = (a + b) / (n1 + n0)
    cells = ((a, n1 * share), (n1 - a, n1 * (1 - share)), (b, n0 * share), (n0 - b, n0 * (1 - share)))
    return 2 * sum(k * math.log(k / e) for k, e in cells if k)


class Model:
    """Lexicon (trait to weight), transitions, neighbour weights and the document's curve."""

    def __init__(self, rows: list[tuple[int, str]], counts: dict[int, int], min_docs: int = 3, min_odds: float = 1.5, min_surprise: float = 20.0, traits_kept: int = 20_000):
        total = sum(counts.values())
        self.base = counts.get(1, 0) / total if total else 0.5
        self.lexicon: dict[str, int] | None = None
        y = np.array([r[0] for r in rows], np.int64)
        if len(set(y.tolist())) < 2:
            return
        n = np.bincount(y, minlength=2)
        # texts are split again in each pass, and clean texts count only what toxic ones have: the driver's memory stays small
        seen = (Counter(), Counter())
        for label in (1, 0):
            for k, t in rows:
                if k == label:
                    own = {f for w in {w.lower() for some in words(t) for w in some} for f in traits(w)}
                    seen[label].update(own if label else own & seen[1].keys())
            if label:
                for f in [f for f, c in seen[1].items() if c < min_docs]:
                    del seen[1][f]
        found = []
        for f, a in seen[1].items():
            b = seen[0][f]
            odds = np.log((a + 0.5) / (n[1] + 1)) - np.log((b + 0.5) / (n[0] + 1))
            if odds > min_odds and (g := _surprise(a, int(n[1]), b, int(n[0]))) >= min_surprise:
                found.append((-g, f))
        self.lexicon = {f: i for i, (_, f) in enumerate(sorted(found)[:traits_kept])}
        size = len(self.lexicon)
        # sparse evidence: positions and traits that fire there
        pos, trait, sizes, at = array("q"), array("q"), [], 0
        labels = array("b")
        for label, t in rows:
            before = at
            for w in (w for some in words(t) for w in some):
                own = [self.lexicon[f] for f in traits(w.lower()) if f in self.lexicon]
                pos.extend([at] * len(own))
                trait.extend(own)
                labels.append(int(bool(own) and label == 1))
                at += 1
            sizes.append(at - before)
        pos, trait = np.array(pos, np.int64), np.array(trait, np.int64)
        labels, lengths = np.array(labels, np.int64), segments(np.array(sizes, np.int64), _SEGMENT)
        hit = np.zeros(at)
        hit[pos] = 1
        edge = np.zeros(at, bool)
        edge[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        before, after = np.roll(hit, 1), np.roll(hit, -1)
        before[edge] = 0
        after[np.roll(edge, -1)] = 0

        def unary(w):
            return np.bincount(pos, w[trait], minlength=at) + w[size] * before + w[size + 1] * after + w[size + 2]

        def back(g):
            return np.concatenate([np.bincount(trait, g[pos], minlength=size), [g @ before, g @ after, g.sum()]])

        self.w, self.trans = crf.fit(unary, back, size + 3, labels, lengths, rounds=60, rate=0.25, ridge=1e-7)
        by_doc = np.array(sizes, np.int64)
        p = unary(self.w)
        for a, b, some in crf.batches(by_doc):
            p[a:b] = crf.marginals(p[a:b], some, self.trans)
        x = self.document(p, by_doc)
        rates = np.bincount(y, minlength=2) / len(y)
        wanted = np.array([1 - self.base, self.base])
        self.curve = crf.logistic(x, y, (wanted / rates)[y])
        self.prepare()

    def prepare(self) -> None:
        size = len(self.lexicon)
        self.weight = {f: float(self.w[i]) for f, i in self.lexicon.items()}
        self.ahead, self.behind, self.const = (float(v) for v in self.w[size:])

    @staticmethod
    def document(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        sums, most = np.zeros(len(lengths)), np.zeros(len(lengths))
        some = lengths > 0
        if some.any():
            first = (np.cumsum(lengths) - lengths)[some]
            strong = np.where(p > 0.3, p, 0)  # else the background of a very long text adds up
            sums[some] = np.add.reduceat(strong, first)
            most[some] = np.maximum.reduceat(p, first)
        return np.column_stack([np.log1p(sums), np.log1p(100 * sums / (lengths + 10)), most])

    def evidence(self, texts: list[str | None], cache: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all tokens of the texts, NaN-free, and the texts' lengths in tokens."""
        get, weight = cache.get, self.weight
        scores, lengths = array("d"), []
        for t in texts:
            before = len(scores)
            for some in words(t):
                own = [get(w) for w in some]
                if None in own:
                    for i, v in enumerate(own):
                        if v is None:
                            w = some[i]
                            v = sum(weight.get(f, 0.0) for f in traits(w.lower()))
                            if len(cache) < _CACHE:
                                cache[w] = v
                            own[i] = v
                scores.extend(own)
            lengths.append(len(scores) - before)
        return np.array(scores), np.array(lengths, np.int64)

    def tokens(self, texts: list[str | None], cache: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        own, lengths = self.evidence(texts, cache)
        hit = (own != 0).astype(float)
        first = (np.cumsum(lengths) - lengths)[lengths > 0]
        before, after = np.roll(hit, 1), np.roll(hit, -1)
        before[first] = 0
        after[np.cumsum(lengths)[lengths > 0] - 1] = 0
        return crf.marginals(own + self.ahead * before + self.behind * after + self.const, lengths, self.trans), lengths

    def score(self, texts: list[str | None], cache: dict[str, float]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Scores, and the offending spans (code points, end exclusive)."""
        if self.lexicon is None:
            return np.full(len(texts), self.base), [[] for _ in texts]
        p, lengths = self.tokens(texts, cache)
        x = np.column_stack([self.document(p, lengths), np.ones(len(texts))])
        s = 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))
        spans: list[list[tuple[int, int]]] = []
        start = np.cumsum(lengths) - lengths
        for i, t in enumerate(texts):
            bad = p[start[i] : start[i] + lengths[i]] > 0.5
            own: list[tuple[int, int]] = []
            if bad.any():
                on = False
                for m, flag in zip(_WORD.finditer(t), bad.tolist(), strict=True):
                    if flag and on:
                        own[-1] = (own[-1][0], m.end())
                    elif flag:
                        own.append(m.span())
                    on = flag
            spans.append(own)
        return s, spans


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> Model:
    return Model(*sample(docs, labels, "toxic", per_class, class_bytes))


def toxicity_scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted and spans (start:end, comma-joined)."""
    d = docs.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), text_of().alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for b in slices(batches, "text"):
            s, spans = model.score(b.column(2).to_pylist(), cache)
            joined = [",".join(f"{i}:{j}" for i, j in x) for x in spans]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(joined)], names=["doc_id", "held_out", "score", "predicted", "spans"]
            )

    return d.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, spans string")
