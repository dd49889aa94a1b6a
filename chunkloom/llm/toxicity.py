"""Toxicity by a classifier chain: linear models in sequence, each fed the probabilities of the categories before it.

The first category is the label ``toxic``. The labels name no finer ones, so two graded ones are derived from the training
sample: ``severe`` (toxic, and as many different attack terms as the median toxic text or more) and ``pervasive`` (toxic, and as
large a share of attack terms), attack terms being those with a high log-odds of ``toxic``. A later model trains on
out-of-fold probabilities of the earlier categories (``FOLDS`` folds) and so never sees a fit to its own rows.

Features are the presence of words, by 64-bit hash, out of the ``TERMS`` terms that tell most about ``toxic`` (chi-square of at
least ``GAIN``, in ``LEAST`` sampled texts or more). The model is fitted on at most ``SAMPLE`` labelled texts per class, chosen by a hash of doc_id: a bounded
sample, as a documented parameter; the model is a few hundred kB. All rows are scored in one map, without a shuffle.

Null and empty texts have no words and get the models' bias, which is low. Labels that are null are not used; repeated labels of an id count
once, and as toxic if one says so; of several texts with a sampled id the one with the least hash trains. Without any labelled
text of both classes nothing counts as toxic (probability 0). Repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.words import chunks, encoded, word_hashes

SAMPLE, TERMS, FOLDS, RIDGE, CUT = 3000, 16384, 5, 0.02, 0.5
#: Texts a term must be in, and its least chi-square (0.1 % by chance).
LEAST, GAIN = 3, 10.83
CATEGORIES = ("toxic", "severe", "pervasive")


def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, text) to (id, label, words: distinct word hashes, counts)."""
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("words", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])
    for batch in batches:
        texts = [encoded(t) for t in batch.column(2).to_pylist()]
        words, counts = [], []
        for a, b in chunks([len(t) for t in texts]):
            h, first = word_hashes(texts[a:b])
            for i in range(b - a):
                u, n = np.unique(h[first[i] : first[i + 1]], return_counts=True)
                words.append(u.view(np.int64))
                counts.append(n.astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(words, schema.types[2]), pa.array(counts, schema.types[3])], schema=schema)


class Linear:
    """Ridge logistic regression on presence features and a few dense ones, fitted by L-BFGS."""

    def __init__(self, n_terms: int, n_dense: int):
        self.n, self.w = n_terms, np.zeros(n_terms + n_dense + 1)

    @staticmethod
    def margin(w, cols, begin, dense, n):
        total = np.concatenate([[0.0], np.cumsum(w[cols])])
        return total[begin[1:]] - total[begin[:-1]] + dense @ w[n:-1] + w[-1]

    def fit(self, cols, begin, dense, y, rows):
        size = np.diff(begin)[rows]
        take = np.concatenate([cols[begin[r] : begin[r + 1]] for r in rows]) if len(rows) else cols[:0]
        begin = np.concatenate([[0], np.cumsum(size)])
        dense, y, n = dense[rows], y[rows].astype(float), self.n
        owner = np.repeat(np.arange(len(rows)), size)

        def loss(w):
            z = self.margin(w, take, begin, dense, n)
            g = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
            grad = np.empty_like(w)
            grad[:n] = np.bincount(take, g[owner], n)
            grad[n:-1] = dense.T @ g
            grad[-1] = g.sum()
            grad[:-1] += RIDGE * w[:-1]
            return np.logaddexp(0, z).sum() - y @ z + RIDGE / 2 * w[:-1] @ w[:-1], grad

        w, past = self.w, []
        f, g = loss(w)
        for _ in range(60):
            d, stack = -g, []
            for s, v in reversed(past):
                a = s @ d / (s @ v)
                d = d - a * v
                stack.append(a)
            if past:
                s, v = past[-1]
                d = d * (s @ v / (v @ v))
            for (s, v), a in zip(past, reversed(stack), strict=True):
                d = d + s * (a - v @ d / (s @ v))
            step = 1.0 if past else 1 / max(1.0, np.abs(g).sum())
            slope = g @ d
            while True:
                w2 = w + step * d
                f2, g2 = loss(w2)
                if f2 <= f + 1e-4 * step * slope or step < 1e-10:
                    break
                step /= 2
            if (w2 - w) @ (g2 - g) > 1e-12:
                past = [*past[-9:], (w2 - w, g2 - g)]
            done = f - f2 <= 1e-6 * max(1.0, abs(f))
            w, f, g = w2, f2, g2
            if done:
                break
        self.w = w
        return self

    def proba(self, cols, begin, dense):
        return 1 / (1 + np.exp(-np.clip(self.margin(self.w, cols, begin, dense, self.n), -500, 500)))


class Chain:
    """terms: sorted hashes; weights: one row per category, with the earlier probabilities' weights and the bias behind the terms'."""

    def __init__(self, terms: np.ndarray, weights: list[np.ndarray]):
        self.terms, self.weights = terms, weights
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(terms >> np.uint64(44)).astype(np.int64)] = True

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities, a row for each text and a column for each category."""
        out = np.zeros((len(texts), len(CATEGORIES)))
        if not len(self.terms):
            return out
        h, first = word_hashes(texts)
        at = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        good = self.terms[place] == h[at]
        docs = np.searchsorted(first, at[good], side="right") - 1
        both = np.unique(docs * len(self.terms) + place[good])
        docs, cols = both // len(self.terms), both % len(self.terms)
        begin = np.searchsorted(docs, np.arange(len(texts) + 1))
        for k, w in enumerate(self.weights):
            m = Linear(len(self.terms), k)
            m.w = w
            out[:, k] = m.proba(cols, begin, out[:, :k])
        return out


def train(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Chain:
    """rows: doc_id, toxic, distinct word hashes (uint64), their counts."""
    rows = sorted(rows, key=lambda r: r[0])
    y = np.array([r[1] for r in rows])
    if not rows or y.min() == y.max():
        return Chain(np.empty(0, np.uint64), [])
    words = np.concatenate([r[2] for r in rows])
    counts = np.concatenate([r[3] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    terms, inverse, df = np.unique(words, return_inverse=True, return_counts=True)
    pos, n, p = np.bincount(inverse, y[owner]), len(rows), y.sum()
    neg = df - pos
    expect = df * p / n
    gain = (pos - expect) ** 2 / expect + (neg - (df - expect)) ** 2 / np.maximum(df - expect, 1e-9)
    gain[df < LEAST] = -1
    best = np.sort(np.argsort(-gain, kind="stable")[: min(TERMS, int((gain >= GAIN).sum()))])
    new = np.full(len(terms), -1)
    new[best] = np.arange(len(best))
    odds = np.log((pos + 0.5) / (p - pos + 0.5)) - np.log((neg + 0.5) / (n - p - neg + 0.5))
    attack = (odds > 2.5) & (df >= 3)
    kinds = np.bincount(owner, attack[inverse].astype(float), n)
    share = np.bincount(owner, attack[inverse] * counts, n) / np.maximum(np.bincount(owner, counts, n), 1)
    targets = [y, y * (kinds >= np.median(kinds[y == 1])), y * (share >= np.median(share[y == 1]))]
    kept = new[inverse] >= 0
    cols = new[inverse][kept]
    begin = np.searchsorted(owner[kept], np.arange(n + 1))
    fold = (np.arange(n) * 2654435761 % 2**32) % FOLDS
    dense, weights = np.zeros((n, 0)), []
    for target in targets:
        weights.append(Linear(len(best), dense.shape[1]).fit(cols, begin, dense, target, np.arange(n)).w)
        out = np.zeros(n)
        for k in range(FOLDS):
            m = Linear(len(best), dense.shape[1]).fit(cols, begin, dense, target, np.flatnonzero(fold != k))
            out[fold == k] = m.proba(cols, begin, dense)[fold == k]
        dense = np.column_stack([dense, out])
    return Chain(terms[best], weights)


def fit(docs: DataFrame, labels: DataFrame) -> Chain:
    """Train on the bounded sample of ``labels`` (doc_id, toxic)."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # rows of both classes by a hash order; with one class, rows of all are few anyway
    chosen = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for c in (0, 1)]
    sample = chosen[0].unionByName(chosen[1])
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most 2 * SAMPLE rows are broadcast
    # of rows that share an id one, by hash, so that the driver gets as many as were chosen
    texts = texts.withColumn("text", F.coalesce("text", F.lit(""))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = texts.mapInArrow(distinct_words, "doc_id long, toxic int, words array<long>, counts array<int>").toArrow().combine_chunks()
    ids, toxic, words, counts = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in got.columns)
    rows = [(i, t, w.values.to_numpy().view(np.uint64), c.values.to_numpy()) for i, t, w, c in zip(ids.to_pylist(), toxic.to_pylist(), words, counts, strict=True)]
    return train(rows)


SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"p_{c}", pa.float64()) for c in CATEGORIES), ("toxic", pa.bool_())])
SQL_SCHEMA = "doc_id long, p_toxic double, p_severe double, p_pervasive double, toxic boolean"


def _scores(chain: Chain, column) -> np.ndarray:
    texts = [encoded(t) for t in column.to_pylist()]
    parts = [chain.score(texts[a:b]) for a, b in chunks([len(t) for t in texts])]
    return np.concatenate(parts) if parts else np.zeros((0, len(CATEGORIES)))


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, a probability for each category, and toxic (the first reaches ``cut``), for each row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _scores(held.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.round(p[:, k], 6)) for k in range(len(CATEGORIES))), pa.array(p[:, 0] >= cut)], schema=SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SQL_SCHEMA)


def without_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT, texts: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not toxic; the labels are of ``texts`` or else of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs if texts is None else texts, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _scores(held.value, batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array(p[:, 0] < cut))

    return docs.mapInArrow(run, docs.schema)
