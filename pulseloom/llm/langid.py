"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read whole, in windows of ``WINDOW`` bytes that tile it. In each window one gated recurrent unit runs forwards and
one backwards; from both states every byte gets a probability of each language, and the mean over all bytes of
the text is the document's. The network is trained in numpy, by backpropagation
through time over the same windows, on the driver.

Training uses the whole texts of up to ``per_lang`` documents of each language, ``max_docs`` in all (languages take turns), that have at most
``text_bytes`` each and ``sample_bytes`` in all; each step draws documents, and of each a window. Prediction takes whole texts.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without training
rows all texts are ``und``; languages that are equally likely go to the first by code point; a very long text is read whole, window by window, some windows at a time; repeated rows come out once each; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, slices, text_of

FOLDS, HELD_OUT = 4, 2
WINDOW, HIDDEN, EMBED = 64, 8, 8
PER_LANG, MAX_DOCS, TEXT_BYTES, SAMPLE_BYTES = 150, 4000, 1 << 20, 32 << 20
ROUNDS, BATCH, RATE = 160, 256, 0.02
_BLOCK = 2048
UNKNOWN = "und"


def windows(data: bytes) -> tuple[np.ndarray, int]:
    """The bytes as rows of WINDOW, padded with blanks."""
    n = -(-len(data) // WINDOW)
    return np.frombuffer(data.ljust(n * WINDOW), np.uint8).reshape(n, WINDOW), len(data)


class Network:
    """Weights by name; gates stand in the order update, reset, candidate."""

    def __init__(self, n_out: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        g = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.w = {"embed": rng.normal(0, 0.5, (256, EMBED)), "bias": np.zeros(n_out)}
        for d in "fb":
            self.w |= {f"{d}x": g(EMBED, 3 * HIDDEN), f"{d}h": g(HIDDEN, 3 * HIDDEN), f"{d}c": np.zeros(3 * HIDDEN), f"{d}o": g(HIDDEN, n_out)}

    def forward(self, x: np.ndarray, d: str) -> list[tuple]:
        """States along one direction: (order, h before, z, r, n, u, h)."""
        steps = range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1)
        into = self.w["embed"] @ self.w[f"{d}x"] + self.w[f"{d}c"]
        h = np.zeros((len(x), HIDDEN))
        out = []
        for t in steps:
            a, s = into[x[:, t]], h @ self.w[f"{d}h"]
            zr = 0.5 + 0.5 * np.tanh(0.5 * (a[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN]))
            z, r, u = zr[:, :HIDDEN], zr[:, HIDDEN:], s[:, 2 * HIDDEN :]
            n = np.tanh(a[:, 2 * HIDDEN :] + r * u)
            before, h = h, n + z * (h - n)
            out.append((t, before, z, r, n, u, h))
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients, through time."""
        runs = {d: self.forward(x, d) for d in "fb"}
        states = {d: {s[0]: s[6] for s in runs[d]} for d in "fb"}
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        back, loss, scale = {}, 0.0, 1 / x.size
        for t in range(WINDOW):
            logit = states["f"][t] @ self.w["fo"] + states["b"][t] @ self.w["bo"] + self.w["bias"]
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            loss -= np.log(p[np.arange(len(y)), y] + 1e-30).sum() * scale
            p[np.arange(len(y)), y] -= 1
            back[t] = p * scale
            grad["bias"] += back[t].sum(0)
        for d in "fb":
            wh, down = self.w[f"{d}h"], np.zeros((len(x), HIDDEN))
            into = np.zeros((256, 3 * HIDDEN))
            for t, before, z, r, n, u, h in reversed(runs[d]):
                grad[f"{d}o"] += h.T @ back[t]
                dh = down + back[t] @ self.w[f"{d}o"].T
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (before - n) * z * (1 - z)
                dr = dn * u * r * (1 - r)
                da = np.concatenate([dz, dr, dn], axis=1)
                ds = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(into, x[:, t], da)
                grad[f"{d}h"] += before.T @ ds
                down = dh * z + ds @ wh.T
            grad[f"{d}c"] = into.sum(0)
            grad[f"{d}x"] = self.w["embed"].T @ into
            grad["embed"] += into @ self.w[f"{d}x"].T
        return loss, grad

    def train(self, x: np.ndarray, y: np.ndarray, count: np.ndarray, rounds: int = ROUNDS, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> float:
        """x: windows, document by document; y: the documents' languages; count: their numbers of windows."""
        rng = np.random.default_rng(seed)
        first = np.cumsum(count) - count
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(a) for k, a in self.w.items()}
        loss = 0.0
        for i in range(1, rounds + 1):
            doc = rng.integers(0, len(count), min(batch, len(x)))
            loss, grad = self.gradients(x[first[doc] + rng.integers(0, count[doc])], y[doc])
            norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
            step = rate * (1 - 0.9 * i / rounds)
            for k, g in grad.items():
                g = g / max(1.0, norm)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.w[k] = self.w[k] - step * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)
        return loss


class Reader:
    """Prediction with a trained network, in single precision; half the gates' scale is folded into the weights."""

    def __init__(self, net: Network):
        half = np.concatenate([np.full(2 * HIDDEN, 0.5), np.ones(HIDDEN)])
        self.side = {}
        for d in "fb":
            into = (net.w["embed"] @ net.w[f"{d}x"] + net.w[f"{d}c"]) * half
            self.side[d] = tuple(a.astype(np.float32) for a in (into, net.w[f"{d}h"] * half, net.w[f"{d}o"]))
        self.bias = net.w["bias"].astype(np.float32)

    def _run(self, x: np.ndarray, d: str) -> Iterator[tuple[int, np.ndarray]]:
        into, wh, _ = self.side[d]
        n, gates = len(x), 2 * HIDDEN
        h = np.zeros((n, HIDDEN), np.float32)
        s, a = np.empty((n, 3 * HIDDEN), np.float32), np.empty((n, 3 * HIDDEN), np.float32)
        half = np.float32(0.5)
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            np.take(into, x[:, t], axis=0, out=a, mode="clip")
            np.matmul(h, wh, out=s)
            zr = s[:, :gates] + a[:, :gates]
            np.tanh(zr, out=zr)
            zr *= half
            zr += half
            c = s[:, gates:]
            c *= zr[:, HIDDEN:]
            c += a[:, gates:]
            c = np.tanh(c)
            h = h - c
            h *= zr[:, :HIDDEN]
            h += c
            yield t, h

    def sums(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each window the sum over its first ``sizes`` bytes of their probabilities."""
        out = np.zeros((len(x), len(self.bias)))
        for k in range(0, len(x), _BLOCK):
            part, size = x[k : k + _BLOCK], sizes[k : k + _BLOCK]
            ahead: list = [None] * WINDOW
            for t, h in self._run(part, "f"):
                ahead[t] = h @ self.side["f"][2] + self.bias
            total = np.zeros((len(part), len(self.bias)), np.float32)
            for t, h in self._run(part, "b"):
                p = ahead[t]
                p += h @ self.side["b"][2]
                np.exp(np.clip(p, -60, 60, out=p), out=p)
                p *= ((size > t) / p.sum(1))[:, None].astype(np.float32)
                total += p
            out[k : k + _BLOCK] = total
        return out


class Model:
    def __init__(self, rows: list[tuple[str, str]], rounds: int = ROUNDS):
        rows = [r for r in rows if r[1]]
        self.langs = sorted({r[0] for r in rows})
        self.reader = None
        if rows:
            cut = [windows(text.encode())[0] for _, text in rows]
            net = Network(len(self.langs))
            net.train(np.concatenate(cut), np.array([self.langs.index(lang) for lang, _ in rows]), np.array([len(x) for x in cut]), rounds)
            self.reader = Reader(net)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        own = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not own or self.reader is None:
            return lang, score
        cut = [windows(texts[i].encode()) for i in own]
        x = np.concatenate([w for w, _ in cut])
        count = np.array([len(w) for w, _ in cut])
        first = np.cumsum(count) - count
        sizes = np.full(len(x), WINDOW)
        length = np.array([n for _, n in cut])
        sizes[first + count - 1] = length - (count - 1) * WINDOW
        p = np.add.reduceat(self.reader.sums(x, sizes), first) / length[:, None]
        for i, k, v in zip(own, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
            lang[i], score[i] = self.langs[k], min(1.0, v)
        return lang, score


def fit_languages(docs: DataFrame, per_lang: int = PER_LANG, max_docs: int = MAX_DOCS, text_bytes: int = TEXT_BYTES, sample_bytes: int = SAMPLE_BYTES, rounds: int = ROUNDS) -> Model:
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    known = known.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT) & (F.octet_length("text") <= text_bytes))
    hashed = F.xxhash64("doc_id")
    w = Window.partitionBy("lang").orderBy(hashed, "doc_id")
    few = known.select("doc_id", "lang").withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= per_lang).orderBy("nth", "lang").limit(max_docs).select("doc_id").distinct()
    rows = known.join(F.broadcast(few), "doc_id").orderBy(hashed, "doc_id", "lang", "text").limit(2 * max_docs)
    drawn = Window.orderBy(hashed, "doc_id", "lang", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("bytes", F.sum(F.octet_length("text")).over(drawn)).filter(F.col("bytes") <= sample_bytes).orderBy("bytes").select("lang", "text").collect()
    return Model([(r["lang"], r["text"]) for r in rows], rounds)


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred and score."""
    d = docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), text_of().alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            lang, score = model.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return d.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
