"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models over the words of a
text; each also gets the probabilities of the categories before it. In training
those are out-of-fold predictions, so a later model does not lean on what an earlier one has
learned by heart.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import map_texts
from voxframe.llm.quality import labelled_sample
from voxframe.llm.words import Words, hashed, normal, owners

BUCKETS_LOG2 = 18
FIT_ROWS = 6000
FOLDS = 4
EPOCHS = 6
RATE = 0.3
SPARSE = 0.05
STEMS = (4, 5, 6, 7)
TEXTS = 2000
SEEN_IN = 5
THRESHOLD = 0.5


def features(words: list[bytes]) -> np.ndarray:
    """(word, feature) buckets: the word without case and outer punctuation, and its beginnings.

    Beginnings stand for stems, so that inflected and compound words of a stem count together.
    A word no longer than a beginning repeats the whole word's bucket, which counts once.
    """
    known = [normal(w).decode() for w in words]
    whole = hashed([w.encode() for w in known], 23)
    stems = [np.where([len(w) > n for w in known], hashed([w[:n].encode() for w in known], 29 + n), whole) for n in STEMS]
    return (np.stack([whole, *stems], axis=1).reshape(-1, 1 + len(STEMS)) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)


def seen(text_of: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, log2 of 1 + the number of words with it) from the features of all words of all texts."""
    repeats = np.zeros(found.shape, dtype=bool)
    repeats[:, 1:] = found[:, 1:] == found[:, :1]
    pairs, n = np.unique((text_of[:, None] << BUCKETS_LOG2 | found)[~repeats], return_counts=True)
    return pairs >> BUCKETS_LOG2, pairs & ((1 << BUCKETS_LOG2) - 1), np.log2(1.0 + n)


def texts_seen(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of each text, as views of arrays over many texts, whose memory is given back as a whole."""
    vocab, out = Words(lambda new: [features(new)]), []
    for at in range(0, len(texts), TEXTS):
        part = texts[at:at + TEXTS]
        places, lengths = vocab.places(part)
        text_of, bucket, value = seen(owners(lengths), vocab.rows[0][places])
        out += _by_text(text_of, len(part), bucket.astype(np.int32), value)
    return out


def _by_text(text_of: np.ndarray, n: int, bucket: np.ndarray, value: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    ends = np.cumsum(np.bincount(text_of, minlength=n))[:-1]
    return list(zip(np.split(bucket, ends), np.split(value, ends)))


def frequent(rows: list[tuple[np.ndarray, np.ndarray]], least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The rows without buckets that fewer than `least` of them hold; empties `rows`, so that both are never held at once."""
    if not rows:
        return []
    n, text_of = len(rows), owners(np.array([len(b) for b, _ in rows], dtype=np.int64)).astype(np.int32)
    bucket, value = (np.concatenate(c) for c in zip(*rows))
    rows.clear()
    kept = np.bincount(bucket, minlength=1 << BUCKETS_LOG2)[bucket] >= least
    return _by_text(text_of[kept], n, bucket[kept], value[kept])


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], extra: np.ndarray, y: np.ndarray, seed: int = 0) -> np.ndarray:
    """Logistic model over the features seen and the `extra` columns, by AdaGrad steps with a lasso.

    Returns bucket weights, then those of `extra`, then the offset. The lasso sets the weights
    of words without bearing to zero, so a long text does not gather noise.
    """
    random = np.random.default_rng(seed)
    size = (1 << BUCKETS_LOG2) + extra.shape[1] + 1
    weights, grown = np.zeros(size), np.full(size, 1e-8)
    positive = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    weights[-1] = np.log(positive / (1 - positive))
    rare = (1 - positive) / positive
    tail = np.arange(1 << BUCKETS_LOG2, size)
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            bucket, value = rows[i]
            at, x = np.concatenate([bucket, tail]), np.concatenate([value, extra[i], [1.0]])
            p = 1 / (1 + np.exp(-np.clip(x @ weights[at], -30, 30)))
            g = (p - y[i]) * x * (min(rare, 10.0) ** 0.5 if y[i] else 1.0)
            grown[at] += g * g
            pace = RATE / np.sqrt(grown[at])
            moved = weights[at] - pace * g
            n = len(bucket)
            moved[:n] = np.sign(moved[:n]) * np.maximum(np.abs(moved[:n]) - pace[:n] * SPARSE, 0)
            weights[at] = moved
    return weights


def predict(weights: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], extra: np.ndarray) -> np.ndarray:
    n = 1 << BUCKETS_LOG2
    sums = np.array([weights[b] @ v for b, v in rows]) if rows else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(sums + extra @ weights[n:-1] + weights[-1], -30, 30)))


def fit_chain(texts: list[bytes], labels: np.ndarray, folds: int = FOLDS) -> list[np.ndarray]:
    """A model for each category (column of `labels`); every text belongs to the fold of its place."""
    rows = frequent(texts_seen(texts), SEEN_IN)
    fold, extra, models = np.arange(len(rows)) % folds, np.zeros((len(rows), 0)), []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        models.append(fit_linear(rows, extra, y, k))
        if k + 1 < labels.shape[1]:
            outside = np.zeros(len(rows))
            for f in range(folds):
                inner, outer = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                model = fit_linear([rows[i] for i in inner], extra[inner], y[inner], k)
                outside[outer] = predict(model, [rows[i] for i in outer], extra[outer])
            extra = np.column_stack([extra, outside])
    return models


def scorer(models: list[np.ndarray]) -> Callable[[], Callable[[list[bytes]], dict]]:
    """The chain for `map_texts`, over whole texts."""
    n = 1 << BUCKETS_LOG2
    words, tails = np.array([m[:n] for m in models]), [m[n:] for m in models]

    def make():
        vocab = Words(lambda new: [features(new)])

        def score(texts: list[bytes]) -> dict:
            places, lengths = vocab.places(texts)
            text_of, bucket, value = seen(owners(lengths), vocab.rows[0][places])
            found: list[np.ndarray] = []
            for weights, tail in zip(words, tails):
                logit = np.bincount(text_of, weights[bucket] * value, len(texts)) + tail[-1]
                logit += sum(p * w for p, w in zip(found, tail[:-1]))
                found.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
            return {f"p{k}": p for k, p in enumerate(found)}

        return score

    return make


def score_toxicity(
    docs: DataFrame, labels: DataFrame, categories: dict[str, Column], keep: list[str], fit_rows: int = FIT_ROWS,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """`keep` and a struct `p` with the probability of each category, for every row by its whole text.

    `categories` names the label columns in the order of the chain. The fit reads at most
    `fit_rows` labelled rows; rows with a NULL label are left out. NULL and empty texts are judged by the
    offsets alone; without labels every probability is 0.5.
    """
    rows = labelled_sample(docs, labels, list(categories.values()), fit_rows, F.lit(True), doc_id, text)
    models = fit_chain([r[1] for r in rows], np.array([r[2:] for r in rows]).reshape(len(rows), len(categories)))
    names = list(categories)
    made = map_texts(docs, text, keep, scorer(models), ", ".join(f"p{k} double" for k in range(len(names))))
    return made.select(*keep, F.struct(*[F.col(f"p{k}").alias(n) for k, n in enumerate(names)]).alias("p"))


def categories() -> dict[str, Column]:
    """Chain over the labels of the tables: junk first, as it often carries abuse, then toxic."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The given columns of the documents whose probability of being toxic is below `threshold`."""
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("kept"), "doc_id", "text")
    scored = score_toxicity(packed, labels, categories(), ["kept"])
    return scored.where(F.col("p.toxic") < threshold).select("kept.*")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, toxic) of every document."""
    scored = score_toxicity(docs.select("doc_id", "text"), labels, categories(), ["doc_id"])
    return scored.select(
        "doc_id", F.col("p.low_quality").alias("p_low_quality"), F.col("p.toxic").alias("p_toxic"),
        (F.col("p.toxic") >= THRESHOLD).cast("int").alias("toxic"),
    )
