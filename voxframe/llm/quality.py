"""Quality classifier with supervised subword embeddings.

A text is the mean of the learned vectors of its words and their character n-grams,
which share a hashed table, under a softmax over the labels. Training is plain numpy
stochastic gradient descent on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import map_texts
from voxframe.llm.words import Words, hashed, owners, shingled

BUCKETS_LOG2 = 16
GRAMS = (3, 5)
DIM = 8
EPOCHS = 6
RATE = 0.5
FIT_ROWS = 3000
SEED = 3


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every word and of its character n-grams between word edges, with repeats."""
    marked = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    word_of = owners(np.array([len(m) for m in marked], dtype=np.int64))
    codes, places = [hashed(words, 13)], [np.arange(len(words))]
    for size in range(GRAMS[0], GRAMS[1] + 1):
        whole = np.flatnonzero(word_of[size - 1:] == word_of[:max(0, len(word_of) - size + 1)])
        codes.append(shingled(points, size)[whole])
        places.append(word_of[whole])
    return np.concatenate(places), (np.concatenate(codes) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, share of all the text's features) of a whole text."""
    words, times = np.unique(np.array(text.split(), dtype=object), return_counts=True) if text.split() else ([], [])
    if not len(words):
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    word, bucket = features(list(words))
    buckets, place = np.unique(bucket, return_inverse=True)
    n = np.bincount(place, times[word])
    return buckets, n / n.sum()


def fit(texts: list[bytes], labels: list[int], dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> np.ndarray:
    """Weight of every bucket for label 1 against 0, and the offset last: the trained vectors times the softmax weights."""
    random = np.random.default_rng(seed)
    table = random.uniform(-1, 1, (1 << BUCKETS_LOG2, dim)) / dim
    out, bias = np.zeros((dim, 2)), np.zeros(2)
    rows = [counted(t) for t in texts]
    y = np.asarray(labels, dtype=np.int64)
    if len(y):
        bias = np.log((np.bincount(y, minlength=2) + 1.0) / (len(y) + 2.0))
    steps, step = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            buckets, share = rows[i]
            pace = rate * (1 - step / steps)
            step += 1
            mean = share @ table[buckets]
            logits = mean @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= pace * np.outer(mean, p)
            bias -= 0.1 * pace * p
            table[buckets] -= (pace * len(buckets) ** 0.5) * share[:, None] * back
    gain = out[:, 1] - out[:, 0]
    return np.append(table @ gain, bias[1] - bias[0])


def scorer(weights: np.ndarray) -> Callable[[], Callable[[list[bytes]], dict]]:
    """The model for `map_texts`: as it is linear in the features, a word's sum is worked out once."""

    def make():
        def of_words(new: list[bytes]) -> list[np.ndarray]:
            word, bucket = features(new)
            return [np.bincount(word, weights[bucket], len(new)), np.bincount(word, minlength=len(new)).astype(float)]

        vocab = Words(of_words)

        def score(texts: list[bytes]) -> dict:
            places, lengths = vocab.places(texts)
            text_of = owners(lengths)
            sums, n = (np.bincount(text_of, r[places], len(texts)) for r in vocab.rows)
            return {"score": 1 / (1 + np.exp(-np.clip(sums / np.maximum(n, 1) + weights[-1], -60, 60)))}

        return score

    return make


def labelled_sample(docs: DataFrame, labels: DataFrame, label: list[Column], rows: int, learn: Column, doc_id: str = "doc_id", text: str = "text") -> list:
    """(text, labels ...) of at most `rows` labelled rows, those with the smallest hash of the id: a bounded sample for a fit.

    Only the texts of the chosen ids are read out, whole, and only those rows reach the
    driver. Rows with a NULL label or id are left out.
    """
    named = labels.select(doc_id, *[c.cast("int").alias(f"__y{i}") for i, c in enumerate(label)]).dropna().where(learn)
    chosen = named.orderBy(F.xxhash64(doc_id), doc_id).limit(rows)
    texts = docs.select(F.col(doc_id), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t"))
    got = texts.join(chosen, doc_id).select("__t", *[f"__y{i}" for i in range(len(label))], doc_id)
    return sorted((r[-1], r[0].encode(), *r[1:-1]) for r in got.toLocalIterator())


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """Rows whose labels are not learned from; a NULL id is no label's."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts)) == part, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """`keep` (doc_id) and score, the probability of label 1 by the whole text; every row gets one.

    The fit reads at most `fit_rows` labelled rows that are not held out. NULL and empty
    texts get the score of the labels' share; without labels that is 0.5.
    """
    rows = labelled_sample(docs, labels, [F.col("quality")], fit_rows, ~held_out(), text=text)
    weights = fit([r[1] for r in rows], [r[2] for r in rows])
    return map_texts(docs, text, keep or ["doc_id"], scorer(weights), "score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score_quality(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
