"""Toxicity scores (operator 7).

Method: convolutional text classifier. A word is the sum of hashed embedding rows
(of the word and of its first letters, so that compounds share); filters of widths 1, 2 and 3 slide over the whole text, each filter's
maximum is pooled, a logistic output reads the maxima. It is trained in numpy by
backpropagation through the pooled positions (Adagrad). Thresholds are calibrated
by language on training rows that the gradient never saw; the language is read
from the text by a hashed-word Bayes head, never from a column. The score is the
logistic of the distance to the language's threshold, so 0.5 is the threshold.

Training reads every labelled row whose crc32 of doc_id modulo 5 is not 0, the whole
text of each. Its rows are dealt by doc_id into shards of about ``SHARD_ROWS``; in each
of ``ROUNDS`` rounds every shard goes on from the common model for ``EPOCHS`` epochs,
and the models are averaged (dense parameters by rows, an embedding row over the shards
that touched it, summed on the executors). Only models and counts reach the driver. The
classes weigh the same in the gradient; language counts and the error counts behind the
thresholds (logits to 1/``GRID``) are sums over all rows. Scoring is a streaming pandas
UDF: no shuffle, long texts in overlapping pieces, maxima combined.

Cases: null and empty texts are one blank word; a doc_id labelled twice takes its
highest label, null labels are left out; without both classes in the training
rows every score is 0; a row is scored by its text alone, so repeated rows agree;
extra columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.llm.common import id_mod, ship
from meterflow.session import new_run_dir

SHARD_ROWS = 8192
ROUNDS = 2
BUCKETS = 1 << 16
PREFIXES = (5, 7)
FORMS = 1 + len(PREFIXES)  # embedding rows of a word
DIM = 12
FILTERS = 8
WIDTHS = (1, 2, 3)
EPOCHS = 2          # of a shard in a round
BATCH = 32
RATE = 0.15
PIECE = 1 << 15
HOLD = 5            # rows with crc32(doc_id) % HOLD == 0 are never learnt from
CALIBRATE = 4       # one training row in this many calibrates thresholds
MIN_LANGUAGE_ROWS = 60
MAX_LANGUAGES = 64  # the most frequent ones have thresholds of their own, the rest share one
GRID = 1024         # steps of a logit in the error counts
BLOCK_WORDS = 1 << 21  # words of a shard held at a time
PIECES = "name string, piece int, at long, part binary"
PIECE_BYTES = 1 << 17  # of a sum of models or counts: what one row of it holds
SUM_TASKS = 8
_CACHE_MAX = 1 << 18
_SLICE = 1000  # texts scored at a time
_WORD = re.compile(r"[^\W\d_]+")


class Words(dict):
    """Word to number; ``rows`` holds each number's embedding rows. Number 0 is
    the blank. Bounded: ``trim`` starts anew when there are too many."""

    def __init__(self):
        super().__init__()
        self.flat = array("i", [0] * FORMS)

    @property
    def rows(self) -> np.ndarray:
        return np.array(self.flat, np.int32).reshape(-1, FORMS)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.flat) // FORMS
        forms = [word] + [f"{k}:{word[:k]}" for k in PREFIXES]
        self.flat.extend(zlib.crc32(x.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) + 1 for x in forms)
        return n

    def trim(self) -> bool:
        if len(self) < _CACHE_MAX:
            return False
        self.clear()
        del self.flat[FORMS:]
        return True


def word_ids(text: str | None, known: Words) -> np.ndarray:
    found = _WORD.findall(text.lower()) if text else []
    return np.fromiter(map(known.__getitem__, found), np.int32, len(found)) if found else np.zeros(1, np.int32)


def _layout(docs: list[np.ndarray], own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Words of all docs, each followed by blanks for the widest filter, and the
    (start, end) bounds for reduceat of its words, or of the first ``own`` only
    (what follows them belongs to the next piece)."""
    pad = np.zeros(max(WIDTHS) - 1, np.int32)
    ids = np.concatenate([x for d in docs for x in (d, pad)])
    lens = np.array([len(d) for d in docs])
    starts = np.concatenate(([0], np.cumsum(lens + len(pad))[:-1]))
    return ids, np.stack((starts, starts + np.minimum(lens, own or len(ids))), axis=1)


class Model:
    """Parameters, forward pass and training."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.e = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
        self.e[0] = 0
        self.w = {w: (rng.standard_normal((w, DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS}
        self.b = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.1).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.languages: list[str] = []
        self.lang_rows = np.zeros((BUCKETS, 1), np.float32)
        self.taps: dict[int, list[np.ndarray]] = {}
        self.lang_of = np.zeros((0, 1), np.float32)
        self.thresholds = np.zeros(1)
        self.known: np.ndarray | None = None
        self.sums = {k: 1e-3 * np.ones_like(v) for k, v in self.parameters().items()}

    def parameters(self) -> dict:
        return {"e": self.e, "b": self.b, "out": self.out, "bias": self.bias, **self.w}

    def learn_words(self, words: Words, anew: bool = False) -> None:
        """Filter taps and language weights of the words not yet seen, so scoring
        only adds table rows."""
        done = 0 if anew or not self.taps else len(self.lang_of)
        new = words.rows[done:]
        if not len(new):
            return
        emb = self.e[new].sum(axis=1)
        taps = {w: [emb @ self.w[w][j] for j in range(w)] for w in WIDTHS}
        lang = self.lang_rows[new[:, 0]]
        if done:
            taps = {w: [np.concatenate(x) for x in zip(self.taps[w], taps[w])] for w in WIDTHS}
            lang = np.concatenate((self.lang_of, lang))
        self.taps, self.lang_of = taps, lang

    def responses(self, ids: np.ndarray) -> np.ndarray:
        """Filter outputs at every position, all widths side by side."""
        n = len(ids) - max(WIDTHS) + 1
        parts = []
        for w in WIDTHS:
            x = self.taps[w][0][ids[:n]]
            for j in range(1, w):
                x += self.taps[w][j][ids[j:n + j]]
            parts.append(x)
        return np.concatenate(parts, axis=1)

    def pooled(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        r = self.responses(ids)
        # reduceat needs every bound inside the array: the last end may be its length
        flat = bounds.ravel()
        if flat[-1] >= len(r):
            flat = flat[:-1]
        return np.maximum.reduceat(r, flat, axis=0)[::2]

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.b, 0) @ self.out + self.bias[0]

    def language(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        flat = bounds.ravel()
        x = np.concatenate((self.lang_of[ids], np.zeros((1, self.lang_of.shape[1]), np.float32)))
        return np.add.reduceat(x, flat, axis=0)[::2]

    def best_positions(self, docs: list[np.ndarray]) -> np.ndarray:
        """Words under each filter's maximum: documents x filters x widest filter.
        Long documents go in pieces; the first maximum counts."""
        span, n_filters = max(WIDTHS), len(self.b)
        best = np.full((len(docs), n_filters), -np.inf, np.float32)
        under = np.zeros((len(docs), n_filters, span), np.int32)
        for i, d in enumerate(docs):
            padded = np.concatenate((d, np.zeros(span - 1, np.int32)))
            for at in range(0, len(d), PIECE):
                ids = padded[at:at + PIECE + span - 1]
                used, local = np.unique(ids, return_inverse=True)
                emb = self.e[self.known[used]].sum(axis=1)
                self.taps = {w: [emb @ self.w[w][j] for j in range(w)] for w in WIDTHS}
                r = self.responses(local)
                where = r.argmax(axis=0)
                top = r[where, np.arange(n_filters)]
                new = np.flatnonzero(top > best[i])
                best[i, new] = top[new]
                under[i, new] = ids[where[new, None] + np.arange(span)]
        return under

    def fit(self, docs: list[np.ndarray], y: np.ndarray, words: Words, weight: np.ndarray, seed: int = 7,
            epochs: int = EPOCHS) -> None:
        """Go on from the model's parameters and gradient sums (``sums``)."""
        self.known = words.rows
        rng = np.random.default_rng(seed)
        sums = self.sums

        def step(name, param, grad, rows=None):
            if rows is None:
                sums[name] += grad * grad
                param -= RATE * 0.2 * grad / np.sqrt(sums[name])
            else:
                sums[name][rows] += grad * grad
                param[rows] -= RATE * grad / np.sqrt(sums[name][rows])

        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for at in range(0, len(docs), BATCH):
                batch = order[at:at + BATCH]
                under = self.best_positions([docs[i] for i in batch])
                used, local = np.unique(under, return_inverse=True)
                local = local.reshape(under.shape)
                emb = self.e[self.known[used]].sum(axis=1)
                best = np.zeros(under.shape[:2], np.float32)
                for k, w in enumerate(WIDTHS):
                    cols = slice(k * FILTERS, (k + 1) * FILTERS)
                    for j in range(w):
                        best[:, cols] += np.einsum("nfd,df->nf", emb[local[:, cols, j]], self.w[w][j])
                act = np.maximum(best + self.b, 0)
                p = 1 / (1 + np.exp(-np.clip(act @ self.out + self.bias[0], -60, 60)))
                g = ((p - y[batch]) * weight[batch] / len(batch)).astype(np.float32)
                d_act = (g[:, None] * self.out) * (act > 0)
                step("out", self.out, act.T @ g + 1e-4 * self.out)
                step("bias", self.bias, np.array([g.sum()], np.float32))
                step("b", self.b, d_act.sum(axis=0))
                d_emb = np.zeros_like(emb)
                for k, w in enumerate(WIDTHS):
                    cols = slice(k * FILTERS, (k + 1) * FILTERS)
                    grad = np.zeros_like(self.w[w])
                    for j in range(w):
                        rows = local[:, cols, j]                      # docs x filters
                        d = d_act[:, cols]
                        grad[j] = np.einsum("nfd,nf->df", emb[rows], d)
                        np.add.at(d_emb, rows.ravel(),
                                  (d[..., None] * self.w[w][j].T[None]).reshape(-1, DIM))
                    step(w, self.w[w], grad)
                d_emb[used == 0] = 0
                rows, at_row = np.unique(self.known[used], return_inverse=True)
                d_rows = np.zeros((len(rows), DIM), np.float32)
                np.add.at(d_rows, at_row.ravel(), np.repeat(d_emb, self.known.shape[1], axis=0))
                step("e", self.e, d_rows, rows)
        self.taps, self.known = {}, None

    def set_languages(self, languages: list[str], counts: np.ndarray) -> None:
        """``counts``: of hashed words (rows) by language."""
        self.languages, counts = languages, counts + 0.5
        self.lang_rows = np.log(counts / counts.sum(axis=0)).astype(np.float32)

    def raw(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(logit, language number) of every document; long ones in pieces."""
        piece_of, pieces = [], []
        overlap = max(WIDTHS) - 1
        for i, d in enumerate(docs):
            for at in range(0, len(d), PIECE):
                piece_of.append(i)
                pieces.append(d[at:at + PIECE + overlap])
        best = np.full((len(docs), len(self.b)), -np.inf, np.float32)
        lang = np.zeros((len(docs), self.lang_rows.shape[1]))
        at = 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (size == 0 or size + len(pieces[end]) <= 2 * PIECE):
                size += len(pieces[end])
                end += 1
            ids, bounds = _layout(pieces[at:end], PIECE)
            np.maximum.at(best, piece_of[at:end], self.pooled(ids, bounds))
            np.add.at(lang, piece_of[at:end], self.language(ids, bounds))
            at = end
        return self.logits(best), lang.argmax(axis=1)

    def set_thresholds(self, lang: np.ndarray, z: np.ndarray, y: np.ndarray, rows: np.ndarray) -> None:
        """Per language the threshold of least error, from counts of equal logits;
        languages with few rows share the common threshold."""
        self.thresholds = np.full(max(1, len(self.languages)), _threshold(z, y, rows))
        for k in range(len(self.languages)):
            at = lang == k
            if rows[at].sum() >= MIN_LANGUAGE_ROWS and 0 < (y * rows)[at].sum() < rows[at].sum():
                self.thresholds[k] = _threshold(z[at], y[at], rows[at])

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        z, lang = self.raw(docs)
        return 1 / (1 + np.exp(-np.clip(z - self.thresholds[lang], -30, 30)))


def _threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    order = np.argsort(z, kind="stable")
    z, y, weight = z[order], y[order], weight[order]
    # cut k: rows below k are called 0
    miss = np.concatenate(([0.0], np.cumsum(weight * y)))
    alarm = np.concatenate((np.cumsum((weight * (1 - y))[::-1])[::-1], [0.0]))
    k = int(np.argmin(miss + alarm))
    below = z[k - 1] if k else z[0] - 1
    above = z[k] if k < len(z) else z[-1] + 1
    return float(below + above) / 2


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """Every training row (shard, doc_id, y, lang, text, last), written once in shards by
    doc_id, and their counts by (y, last). One row a doc_id, that of the least text hash;
    ``last``: it calibrates thresholds."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_mod(F.col("doc_id"), HOLD) != 0))
             .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y")))
    shards = max(1, -(-known.count() // SHARD_ROWS))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", F.coalesce(lang, F.lit("")).alias("lang"))
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "lang")).alias("row")
    last = F.crc32(F.concat(F.lit("calibrate "), F.col("doc_id").cast("string"))) % CALIBRATE == 0
    path = f"{new_run_dir(docs.sparkSession, 'toxicity')}/rows"
    (rows.repartition(shards, "doc_id").join(known.repartition(shards, "doc_id"), "doc_id")
     .groupBy("doc_id", "y").agg(first)
     .select(F.spark_partition_id().alias("shard"), "doc_id", "y", "row.lang", "row.text", last.alias("last"))
     .sortWithinPartitions("doc_id").write.option("compression", "zstd").parquet(path))
    got = docs.sparkSession.read.parquet(path)
    return got, {(r.y, r.last): r.n for r in got.groupBy("y", "last").agg(F.count("*").alias("n")).collect()}


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray], Words]]:
    """Rows of one shard at a time, at most about ``BLOCK_WORDS`` words together."""
    words, held, ids, size = Words(), [], [], 0
    for batch in batches:
        for _, part in batch.groupby("shard", sort=False):
            for at in range(0, len(part), 64):
                piece = part.iloc[at:at + 64]
                if held and (size > BLOCK_WORDS or held[-1].shard.iloc[0] != piece.shard.iloc[0]):
                    yield pd.concat(held), ids, words
                    words, held, ids, size = Words(), [], [], 0
                new = [word_ids(t, words) for t in piece.text]
                held.append(piece.drop(columns="text"))
                ids += new
                size += sum(map(len, new))
    if held:
        yield pd.concat(held), ids, words


def _changes(before: Model, m: Model, n: int, last: bool) -> dict[str, np.ndarray]:
    """A shard's part of the average: changes times rows, and the rows (of the
    embedding: 1 where the shard touched it). After the ``last`` round nobody asks for
    the gradient sums."""
    out = {}
    for k, v in m.parameters().items():
        s0, s1 = before.sums[k], m.sums[k]
        w = (s1 != s0).any(axis=1, keepdims=True).astype(np.float32) if k == "e" else np.float32(n)
        out[str(k)] = w * (v - before.parameters()[k])
        if not last:
            out[f"{k} sums"] = w * (s1 - s0)
        out[f"{k} rows"] = np.asarray(w)
    return out


def _sum(a: dict, b: dict) -> dict:
    return {k: a[k] + b[k] for k in a}


def _pieces(name: str, values: np.ndarray, at: int) -> pd.DataFrame:
    """``values`` as rows (name, piece, at, part) of at most ``PIECE_BYTES``."""
    flat = np.ascontiguousarray(values).tobytes()
    cuts = range(0, len(flat), PIECE_BYTES)
    return pd.DataFrame({"name": name, "piece": np.arange(len(cuts), dtype=np.int32), "at": np.int64(at),
                         "part": [flat[x:x + PIECE_BYTES] for x in cuts]})


def _summed(parts: DataFrame, kind: type) -> dict[str, np.ndarray]:
    """The arrays of ``kind`` whose pieces ``parts`` holds, added up by name on the
    executors, in the order of ``at``: every task holds one piece at a time, and only one
    row a piece reaches the driver."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None
        for batch in batches:
            for name, piece, part in zip(batch.name, batch.piece, batch.part):
                value = np.frombuffer(part, kind)
                if key == (name, piece):
                    total += value
                    continue
                if key is not None:
                    yield pd.DataFrame({"name": [key[0]], "piece": [key[1]], "part": [total.tobytes()]})
                key, total = (name, piece), value.copy()
        if key is not None:
            yield pd.DataFrame({"name": [key[0]], "piece": [key[1]], "part": [total.tobytes()]})

    rows = (parts.repartition(SUM_TASKS, "name", "piece").sortWithinPartitions("name", "piece", "at", "part")
            .mapInPandas(add, "name string, piece int, part binary"))
    found: dict[str, dict[int, bytes]] = {}
    for r in rows.collect():
        found.setdefault(r.name, {})[r.piece] = r.part
    return {k: np.frombuffer(b"".join(bytes(x[i]) for i in range(len(x))), kind) for k, x in found.items()}


def _round(rows: DataFrame, model: Model, weight: np.ndarray, number: int) -> None:
    """Every shard fits on from ``model``; the model takes the average."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)
    last = number == ROUNDS - 1

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, total = shipped.value, None
        m, n, shard, first = None, 0, None, 0

        def closed():
            part = _changes(before, m, n, last)
            return part if total is None else _sum(total, part)

        for part, ids, words in _blocks(batches):
            if m is None or part.shard.iloc[0] != shard:
                if m is None:
                    first = part.shard.iloc[0]
                total = closed() if m is not None else None
                m, n, shard = pickle.loads(pickle.dumps(before)), 0, part.shard.iloc[0]
            y = part.y.to_numpy(np.float32)
            m.fit(ids, y, words, weight[part.y.to_numpy()], 7 + number)
            n += len(ids)
        if m is not None:
            for name, values in closed().items():
                yield _pieces(name, values.astype(np.float32), first)

    total = _summed(rows.select("shard", "y", "text").mapInPandas(fit, PIECES), np.float32)
    shipped.destroy()
    for k, v in model.parameters().items():
        w = np.maximum(total[f"{k} rows"].reshape(-1, 1) if k == "e" else total[f"{k} rows"][0], 1)
        v += total[str(k)].reshape(v.shape) / w
        if not last:
            model.sums[k] += total[f"{k} sums"].reshape(v.shape) / w


def _language_counts(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """Rows of the embedding table by language: occurrences of the words."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(languages), BUCKETS))
        for part, ids, words in _blocks(batches):
            first = words.rows[:, 0]
            for d, x in zip(ids, part.lang):
                if x in languages:
                    np.add.at(total[languages.index(x)], first[d], 1)
        for number, values in enumerate(total):
            yield _pieces(str(number), values, 0)

    total = _summed(rows.select("shard", "lang", "text").mapInPandas(count, PIECES), np.float64)
    return np.stack([total[str(i)] for i in range(len(languages))], axis=1)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """None when the training rows have only one class."""
    spark = docs.sparkSession
    rows, sizes = labelled(docs, labels)
    of = lambda last: [sum(n for (y, x), n in sizes.items() if y == c and x in last) for c in (0, 1)]
    if not all(of((True, False))):
        return None
    split = all(of((True,))) and all(of((False,)))
    fit = rows.where("not last") if split else rows
    check = rows.where("last") if split else rows
    n0, n1 = of((False,)) if split else of((True, False))
    weight = np.array([(n0 + n1) / (2 * n0), (n0 + n1) / (2 * n1)], np.float32)
    ship(spark)
    model = Model()
    for number in range(ROUNDS):
        _round(fit, model, weight, number)
    top = fit.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    languages = sorted(r.lang for r in top)
    model.set_languages(languages, _language_counts(fit, languages))
    shipped = spark.sparkContext.broadcast(model)

    def logits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, ids, words in _blocks(batches):
            m = shipped.value
            m.learn_words(words, anew=True)
            z, lang = m.raw(ids)
            cell = np.round(np.clip(z, -30, 30) * GRID).astype(np.int64)
            yield pd.DataFrame({"lang": lang.astype(np.int64), "cell": cell, "y": part.y.to_numpy(np.int64)})

    cells = (check.select("shard", "y", "text").mapInPandas(logits, "lang long, cell long, y long")
             .groupBy("lang", "cell", "y").count().orderBy("lang", "cell", "y").collect())
    shipped.destroy()
    lang, cell, y, n = (np.array(x, float) for x in zip(*cells))
    model.set_thresholds(lang, cell / GRID, y, n)
    model.sums = {}
    return model


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with column score."""
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    model.taps, model.lang_of = {}, model.lang_of[:0]  # each task builds those of its own words
    ship(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words, m, anew = Words(), shipped.value, True
        for texts in batches:
            out = [np.zeros(0)]
            for at in range(0, len(texts), _SLICE):
                ids = [word_ids(t, words) for t in texts.iloc[at:at + _SLICE]]
                m.learn_words(words, anew)
                out.append(m.scores(ids))
                anew = words.trim()
            yield pd.Series(np.concatenate(out), dtype="float64")

    return docs.withColumn("score", score("text"))


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return (scored(docs.select("doc_id", "text"), train(docs, labels))
            .select("doc_id", (id_mod(F.col("doc_id"), HOLD) == 0).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))
