"""Quality scores (operator 9).

Method: generalised additive model with pairwise interactions. Every text becomes
a few numeric features, each cut into quantile bins. Cyclic boosting visits the
features in turn and adds a shallow tree over one feature's bins to that
feature's lookup table; the pairs with the largest gain then get two-dimensional
tables the same way. A score is the sum of the table entries of a text's bins,
added for all rows at once, through the logistic function.

Training reads at most ``MAX_PER_CLASS`` labelled rows of each class (least
hashes among rows whose crc32 of doc_id modulo 4 is not 2); rows stand for as many
as their class was sampled from. A fourth of them, unseen by the boosting, shifts
the scores so that the least expected error is at ``THRESHOLD``. Features are
computed in Spark tasks over whole texts, without a shuffle.

Cases: null and empty texts have all features 0 and are scored like any other;
without both classes in the training rows every score is 0; a doc_id labelled
twice takes its highest label; repeated rows agree; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.llm.common import id_mod, labelled_sample, ship

FEATURES = ("words", "word_length", "upper", "digits", "symbols", "bare_symbols", "symbol_runs", "distinct",
            "repeats", "line_length", "repeated_lines", "short_words", "longest_word", "stops", "non_ascii",
            "top_word", "exclamations", "spaces")
HOLD, HELD = 4, 2
THRESHOLD = 0.7
MAX_PER_CLASS = 4000
BINS = 32
PAIR_BINS = 8
PAIRS = 8
ROUNDS = 120
PAIR_ROUNDS = 40
RATE = 0.1
CALIBRATE = 4
_SMOOTH = 2.0

# byte classes: 0 other, 1 upper, 2 lower, 3 digit, 4 symbol, 5 space, 6 full stop,
# 7 exclamation mark, 8 beyond ASCII
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 4
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[46], _CLASS[33], _CLASS[128:] = 5, 6, 7, 8


def features(text: str | None) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = _CLASS[raw]
    n = np.bincount(kinds, minlength=9)
    symbol = (kinds == 4) | (kinds == 7)
    runs = int((symbol[1:] & symbol[:-1]).sum())
    words = text.split()
    count = max(1, len(words))
    seen = Counter(words)
    lens = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [x for x in text.split("\n") if x]
    letters = max(1, int(n[1] + n[2]))
    return [np.log1p(len(words)), lens.mean(), n[1] / letters, n[3] / len(raw), (n[4] + n[7]) / len(raw),
            sum(k for w, k in seen.items() if len(w) == 1 and not w.isalnum()) / count, runs / count,
            len(seen) / count, sum(map(eq, words, words[1:])) / count, np.log1p(len(text) / max(1, len(lines))),
            1 - len(set(lines)) / max(1, len(lines)), (lens <= 3).mean(), np.log1p(lens.max()), n[6] / count,
            n[8] / len(raw), max(seen.values(), default=0) / count, n[7] / count, n[5] / len(raw)]


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + _SMOOTH)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best cut of consecutive bins: (gain, first bin of the right part)."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Newton steps of a tree of depth two over one feature's bins."""
    out = np.zeros(len(g))
    parts = [(0, len(g))]
    for _ in range(2):
        after = []
        for a, b in parts:
            gain, k = _split(g[a:b], h[a:b]) if b - a > 1 else (0.0, 0)
            after += [(a, a + k), (a + k, b)] if gain > 1e-9 else [(a, b)]
        parts = after
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + _SMOOTH)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, steps) of the best tree that cuts both axes of a pair once."""
    size = g.shape[0]
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    total_g, total_h, best = cg[-1, -1], ch[-1, -1], (0.0, np.zeros_like(g))
    for i in range(1, size):
        gl, hl = cg[i, 1:-1], ch[i, 1:-1]                    # low, low
        gt, ht = cg[i, -1], ch[i, -1]                        # low rows, all columns
        gc, hc = cg[-1, 1:-1], ch[-1, 1:-1]                  # all rows, low columns
        parts = ((gl, hl), (gt - gl, ht - hl), (gc - gl, hc - hl), (total_g - gt - gc + gl, total_h - ht - hc + hl))
        gain = sum(_gain(*p) for p in parts) - _gain(total_g, total_h)
        j = int(gain.argmax()) + 1
        if gain[j - 1] > best[0]:
            step = np.zeros_like(g)
            values = [p[0][j - 1] / (p[1][j - 1] + _SMOOTH) for p in parts]
            step[:i, :j], step[:i, j:], step[i:, :j], step[i:, j:] = values
            best = float(gain[j - 1]), step
    return best


class Gam:
    def __init__(self, x: np.ndarray):
        levels = np.arange(1, BINS) / BINS
        self.cuts = [np.unique(np.quantile(x[:, f], levels)) for f in range(x.shape[1])]
        coarse = np.arange(1, PAIR_BINS) / PAIR_BINS
        self.pair_cuts = [np.unique(np.quantile(x[:, f], coarse)) for f in range(x.shape[1])]
        self.tables = [np.zeros(BINS) for _ in self.cuts]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.bias, self.shift = 0.0, 0.0

    def bins(self, x: np.ndarray, cuts) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        fine, coarse = self.bins(x, self.cuts), self.bins(x, self.pair_cuts)
        z = np.full(len(x), self.bias)
        for f, t in enumerate(self.tables):
            z += t[fine[:, f]]
        for a, b, t in self.pairs:
            z += t[coarse[:, a], coarse[:, b]]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) + self.shift, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        fine, coarse = self.bins(x, self.cuts), self.bins(x, self.pair_cuts)
        w = w / w.mean()
        mean = (w * y).sum() / w.sum()
        self.bias = float(np.log(mean / (1 - mean)))
        z = np.full(len(x), self.bias)

        def slopes():
            p = 1 / (1 + np.exp(-z))
            return w * (y - p), w * p * (1 - p)

        for _ in range(ROUNDS):
            for f, table in enumerate(self.tables):
                g, h = slopes()
                at = fine[:, f]
                step = RATE * shallow_tree(np.bincount(at, g, BINS), np.bincount(at, h, BINS))
                table += step
                z += step[at]

        def grid(values, a, b):
            return np.bincount(coarse[:, a] * PAIR_BINS + coarse[:, b], values, PAIR_BINS ** 2).reshape(PAIR_BINS, -1)

        g, h = slopes()
        gains = sorted(((quadrants(grid(g, a, b), grid(h, a, b))[0], a, b)
                        for a in range(x.shape[1]) for b in range(a)), reverse=True)
        self.pairs = [(a, b, np.zeros((PAIR_BINS, PAIR_BINS))) for gain, a, b in gains[:PAIRS] if gain > 0]
        for _ in range(PAIR_ROUNDS):
            for a, b, table in self.pairs:
                g, h = slopes()
                step = RATE * quadrants(grid(g, a, b), grid(h, a, b))[1]
                table += step
                z += step[coarse[:, a], coarse[:, b]]

    def calibrate(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        """Moves the raw value of least expected error to THRESHOLD."""
        z = self.raw(x)
        order = np.argsort(z, kind="stable")
        z, y, w = z[order], y[order], w[order]
        miss = np.concatenate(([0.0], np.cumsum(w * y)))
        alarm = np.concatenate((np.cumsum((w * (1 - y))[::-1])[::-1], [0.0]))
        # the middle of all best cuts
        best = np.flatnonzero(miss + alarm <= (miss + alarm).min() + 1e-9)
        k = int(best[len(best) // 2])
        edge = (z[max(k - 1, 0)] + z[min(k, len(z) - 1)]) / 2
        self.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - edge)


def train(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS) -> Gam | None:
    """None when the training rows have only one class."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def numbers(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    got = (labelled_sample(docs, labels, "quality", HOLD, HELD, per_class)
           .select("doc_id", "y", "share", numbers("text").alias("x")).collect())
    got.sort(key=lambda r: (r.doc_id, r.x))
    if len({r.y for r in got}) < 2:
        return None
    x, y = np.array([r.x for r in got]), np.array([float(r.y) for r in got])
    w = np.array([r.share for r in got])
    last = np.array([zlib.crc32(f"calibrate {r.doc_id}".encode()) % CALIBRATE == 0 for r in got])
    if len(set(y[last])) < 2 or len(set(y[~last])) < 2:
        last[:] = False
    model = Gam(x[~last])
    model.fit(x[~last], y[~last], w[~last])
    check = last if last.any() else ~last
    model.calibrate(x[check], y[check], w[check])
    return model


def scored(docs: DataFrame, model: Gam | None) -> DataFrame:
    """docs with column score."""
    if model is None:
        return docs.withColumn("score", F.lit(0.0))

    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))
            yield pd.Series(model.scores(x), dtype="float64")

    return docs.withColumn("score", score("text"))


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return (scored(docs.select("doc_id", "text"), train(docs, labels))
            .select("doc_id", (id_mod(F.col("doc_id"), HOLD) == HELD).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
