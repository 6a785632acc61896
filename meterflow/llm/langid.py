"""Language ID (operator 8).

Method: a bidirectional gated recurrent network over bytes. The lower-cased UTF-8
bytes of the whole text are cut into windows of ``WINDOW``; in every window one
recurrence runs forward, one backward, and both states together label every byte.
The label probabilities of all bytes of a document are averaged; the largest wins.
The network is trained in numpy by backpropagation through time (Adam).

Training reads at most ``MAX_PER_LANGUAGE`` documents of each language (least
hashes of doc_id among rows with a lang whose crc32 of doc_id modulo 4 is not 2)
and up to ``TRAIN_WINDOWS`` windows spread over each text. Spark picks and cuts them, the
driver trains. Scoring is a streaming pandas UDF without a shuffle; windows of
many texts run side by side, a long text is simply many windows.

Cases: null texts and texts without a letter are ``und`` with score 0, as is all
when no row can be learnt from; repeated rows agree; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterflow.llm.common import id_mod, ship

HIDDEN = 10
WINDOW = 64
MAX_PER_LANGUAGE = 300
TRAIN_WINDOWS = 12
STEPS = 500
BATCH = 128
RATE = 0.01
HOLD, HELD = 4, 2
UNKNOWN = "und"
_SIDE = 2048  # windows run side by side
_LETTER = regex.compile(r"\p{L}")


def windows_of(text: str) -> np.ndarray:
    """(windows, WINDOW) bytes, the last window filled up with 0."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    n = -(-len(raw) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[:len(raw)] = raw
    return out.reshape(n, WINDOW)


class Gru:
    """One direction; states are (hidden, windows). The gates z, r and the
    candidate are stacked in that order."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.x = (rng.standard_normal((3 * hidden, 256)) * 0.3).astype(np.float32)
        self.u = (rng.standard_normal((3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)

    def step(self, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gates, recurrent part of the candidate, new state)."""
        k = h.shape[0]
        g = np.take(self.x, ids, axis=1, mode="clip")
        rec = self.u @ h
        g[:2 * k] += rec[:2 * k]
        np.multiply(np.tanh(0.5 * g[:2 * k], out=g[:2 * k]), 0.5, out=g[:2 * k])
        g[:2 * k] += 0.5
        g[2 * k:] += g[k:2 * k] * rec[2 * k:]
        np.tanh(g[2 * k:], out=g[2 * k:])
        return g, rec[2 * k:], g[2 * k:] + g[:k] * (h - g[2 * k:])

    def back(self, ids, g, rec, h, dh, dx, du) -> np.ndarray:
        """Adds the gradients of one step to dx and du; the gradient of h."""
        k = h.shape[0]
        z, r, n = g[:k], g[k:2 * k], g[2 * k:]
        dn = dh * (1 - z) * (1 - n * n)
        d = np.concatenate((dh * (h - n) * z * (1 - z), dn * rec * r * (1 - r), dn))
        np.add.at(dx, ids, d.T)
        d[2 * k:] *= r
        du += d @ h.T
        return dh * z + self.u.T @ d


class BiGru:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.ways = [Gru(rng, hidden), Gru(rng, hidden)]
        self.out = (rng.standard_normal((len(languages), 2 * hidden)) * 0.1).astype(np.float32)
        self.bias = np.zeros((len(languages), 1), np.float32)

    def labels(self, hf: np.ndarray, hb: np.ndarray) -> np.ndarray:
        """Label probabilities (languages, windows) at one position."""
        k = self.hidden
        p = self.out[:, :k] @ hf + self.out[:, k:] @ hb + self.bias
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        return p

    def summed(self, w: np.ndarray) -> np.ndarray:
        """Label probabilities of every window, summed over its bytes."""
        out = np.zeros((len(w), len(self.languages)))
        for at in range(0, len(w), _SIDE):
            part = np.ascontiguousarray(w[at:at + _SIDE].T).astype(np.intp)
            h = np.zeros((self.hidden, part.shape[1]), np.float32)
            ahead = []
            for ids in part:
                h = self.ways[0].step(ids, h)[2]
                ahead.append(h)
            h = np.zeros_like(h)
            total = np.zeros((len(self.languages), part.shape[1]), np.float32)
            for t in range(WINDOW - 1, -1, -1):
                h = self.ways[1].step(part[t], h)[2]
                total += self.labels(ahead[t], h) * (part[t] > 0)
            out[at:at + part.shape[1]] = total.T
        return out

    def fit(self, w: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        params = [a for g in self.ways for a in (g.x, g.u)] + [self.out, self.bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        k, eye = self.hidden, np.eye(len(self.languages), dtype=np.float32)
        by_label = [np.flatnonzero(y == c) for c in range(len(self.languages))]
        for step in range(1, steps + 1):
            pick = np.array([rng.choice(by_label[c]) for c in rng.integers(0, len(by_label), BATCH)])
            part, want = w[pick].T.astype(np.intp), eye[y[pick]].T
            mask = (part > 0).astype(np.float32) / max(1, (part > 0).sum())
            runs = []
            for way, order in zip(self.ways, (range(WINDOW), range(WINDOW - 1, -1, -1))):
                h, kept = np.zeros((k, BATCH), np.float32), [None] * WINDOW
                for t in order:
                    g, rec, new = way.step(part[t], h)
                    kept[t] = g, rec, h, new
                    h = new
                runs.append(kept)
            d_out, d_bias, dhs = np.zeros_like(self.out), np.zeros_like(self.bias), []
            for t in range(WINDOW):
                both = np.concatenate((runs[0][t][3], runs[1][t][3]))
                d = (self.labels(runs[0][t][3], runs[1][t][3]) - want) * mask[t]
                d_out += d @ both.T
                d_bias += d.sum(axis=1, keepdims=True)
                dhs.append(self.out.T @ d)
            grads = []
            for i, (way, order) in enumerate(zip(self.ways, (range(WINDOW - 1, -1, -1), range(WINDOW)))):
                dx, du = np.zeros((256, 3 * k), np.float32), np.zeros_like(way.u)
                dh = np.zeros((k, BATCH), np.float32)
                for t in order:
                    g, rec, h, _ = runs[i][t]
                    dh = way.back(part[t], g, rec, h, dh + dhs[t][i * k:(i + 1) * k], dx, du)
                grads += [dx.T, du]
            grads += [d_out, d_bias]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for p, g, (m, v) in zip(params, grads, moments):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lettered = [t is not None and _LETTER.search(t) is not None for t in texts]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        cut, owner, sizes = [], [], 0

        def flush() -> None:
            if not cut:
                return
            sums = self.summed(np.concatenate(cut))
            bounds = np.concatenate(([0], np.cumsum([len(c) for c in cut])[:-1]))
            for i, p in zip(owner, np.add.reduceat(sums, bounds, axis=0)):
                best = int(p.argmax())
                langs[i], scores[i] = self.languages[best], float(min(1.0, p[best] / p.sum()))
            cut.clear()
            owner.clear()

        for i, t in enumerate(texts):
            if lettered[i]:
                cut.append(windows_of(t))
                owner.append(i)
                sizes += len(cut[-1])
                if sizes >= 4 * _SIDE:
                    flush()
                    sizes = 0
        flush()
        return langs, scores


def train(docs: DataFrame, per_language: int = MAX_PER_LANGUAGE) -> BiGru | None:
    """None without a row to learn from."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_mod(F.col("doc_id"), HOLD) != HELD))
    # least hashes of each language: the rank limit is applied before the shuffle
    by = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h")
    ids = (known.select("lang", "doc_id", F.xxhash64("text").alias("h")).distinct()
           .withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= per_language)
           .select(F.col("lang").alias("l"), F.col("doc_id").alias("i"), "h"))
    chosen = known.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("lang") == F.col("l"))
                        & (F.xxhash64("text") == F.col("h")))

    ship(docs.sparkSession)

    @F.pandas_udf("array<binary>")
    def some(texts: pd.Series) -> pd.Series:
        def spread(t: str) -> list[bytes]:
            w = windows_of(t)
            at = np.unique(np.linspace(0, max(0, len(w) - 1), TRAIN_WINDOWS).astype(int))
            return [w[i].tobytes() for i in at] if len(w) else []
        return pd.Series([spread(t) for t in texts])

    got = chosen.select("lang", some("text").alias("w")).distinct().collect()
    pairs = sorted({(r.lang, bytes(w)) for r in got for w in r.w})
    if not pairs:
        return None
    languages = sorted({x for x, _ in pairs})
    w = np.stack([np.frombuffer(b, np.uint8) for _, b in pairs])
    model = BiGru(languages)
    model.fit(w, np.array([languages.index(x) for x, _ in pairs]))
    return model


def predicted(docs: DataFrame, model: BiGru | None) -> DataFrame:
    """docs with lang_pred and score."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})

    ship(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = model.predict(list(texts))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    out = docs.withColumn("__label", label("text"))
    return out.withColumns({"lang_pred": F.col("__label.lang_pred"), "score": F.col("__label.score")}).drop("__label")


def op8(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang")
    return (predicted(docs.select("doc_id", "text"), train(docs))
            .select("doc_id", (id_mod(F.col("doc_id"), HOLD) == HELD).alias("held_out"), "lang_pred", "score"))
