"""Array-valued score functions, all built from Spark's own higher-order functions.

One row holds one token position with its scores in an array, so none of these
needs a shuffle. `let` binds a value once: a column used inside a lambda would
otherwise be evaluated again for every element.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

_TOP_TYPE = ArrayType(
    StructType([StructField("token_id", IntegerType()), StructField("logit", DoubleType())])
)

IGNORE = -100  # label of a position that takes no part in a loss


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _num(value: float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def _over(v: Column, temperature: float | Column) -> Column:
    plain = not isinstance(temperature, Column) and temperature == 1
    return v if plain else v / _num(temperature)


def log_sum_exp(x: Column, temperature: float | Column = 1.0) -> Column:
    def shifted(a: Column) -> Callable[[Column], Column]:
        return lambda m: _over(m, temperature) + F.log(
            F.aggregate(a, F.lit(0.0), lambda s, v: s + F.exp(_over(v - m, temperature)))
        )

    return let(doubles(x), lambda a: let(F.array_max(a), shifted(a)))


def log_softmax(x: Column, temperature: float | Column = 1.0) -> Column:
    return let(
        doubles(x),
        lambda a: let(
            log_sum_exp(a, temperature),
            lambda z: F.transform(a, lambda v: _over(v, temperature) - z),
        ),
    )


def softmax(x: Column, temperature: float | Column = 1.0) -> Column:
    return F.transform(log_softmax(x, temperature), F.exp)


def align_vocab(a: Column, b: Column) -> tuple[Column, Column]:
    """Cut both score arrays to the shorter of the two."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)


def top_k(x: Column, k: int) -> Column:
    """The k highest scores, descending, as array<struct<token_id, logit>>.

    Equal scores are ordered by the lower token id; NULL and NaN are no scores and are
    never kept. The k-th highest score is found on the plain numbers, which Spark sorts
    without boxing them; only entries that reach it are then ordered together with
    their ids.
    """

    def reaching(a: Column) -> Callable[[Column], Column]:
        return lambda cut: F.array_compact(
            F.transform(
                a,
                lambda v, i: F.when(
                    (v >= cut) & ~F.isnan(v), F.struct((-v).alias("down"), i.alias("token_id"))
                ),
            )
        )

    def best(a: Column) -> Column:
        def kth(clean: Column) -> Column:
            place = -F.least(F.lit(k), F.greatest(F.size(clean), F.lit(1)))
            return F.try_element_at(F.sort_array(clean), place)

        clean = F.filter(a, lambda v: v.isNotNull() & ~F.isnan(v))
        return let(let(clean, kth), reaching(a))

    return F.transform(
        F.slice(F.array_sort(let(doubles(x), best)), 1, k),
        lambda s: F.struct(s["token_id"].alias("token_id"), (-s["down"]).alias("logit")),
    )


def top_k_wide(x: Column, k: int) -> Column:
    """`top_k` in Arrow batches, for arrays of a whole vocabulary.

    Spark's array functions handle one boxed entry at a time (measured at 51,865
    scores: 39 ms a position against 10 ms here).
    """

    @F.arrow_udf(_TOP_TYPE)
    def select(scores: pa.Array) -> pa.Array:
        offsets, values = scores.offsets.to_numpy(), scores.values.to_numpy(zero_copy_only=False)
        ids, ends = [], [0]
        for lo, hi in zip(offsets[:-1], offsets[1:]):
            ids.append(_best(values[lo:hi], k))
            ends.append(ends[-1] + len(ids[-1]))
        places = np.concatenate(ids) if ids else np.empty(0, dtype=np.int64)
        rows = np.repeat(offsets[:-1], np.diff(ends))
        entries = pa.StructArray.from_arrays(
            [pa.array(places, pa.int32()), pa.array(values[rows + places], pa.float64())],
            ["token_id", "logit"],
        )
        mask = pa.array(scores.is_null().to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries, mask=mask)

    return select(doubles(x))


def top_k_renorm(top: Column, temperature: float | Column = 1.0) -> Column:
    """Softmax over the kept scores only."""
    return softmax(F.transform(top, lambda s: s["logit"]), temperature)


def gather(x: Column, ids: Column) -> Column:
    """Entries of `x` at zero-based `ids`."""
    return let(x, lambda a: F.transform(ids, lambda i: F.element_at(a, i.cast("int") + 1)))


def is_scored(label: Column) -> Column:
    return label != IGNORE


def cross_entropy(logits: Column, label: Column) -> Column:
    """Negative log-probability of the label at one position; NULL where masked."""
    ce = let(doubles(logits), lambda a: log_sum_exp(a) - F.element_at(a, label.cast("int") + 1))
    return F.when(is_scored(label), ce)


def _kl_term(log_p: Column, log_q: Column) -> Column:
    # p = 0 counts as 0, also where log p is minus infinity; exp(-746) is 0
    return F.when(log_p > -746.0, F.exp(log_p) * (log_p - log_q)).otherwise(0.0)


def kl_full(teacher: Column, student: Column, temperature: float | Column = 1.0) -> Column:
    """KL(teacher || student) over the shared vocabulary, times T squared."""
    t = _num(temperature)
    a, b = align_vocab(doubles(teacher), doubles(student))
    terms = F.zip_with(log_softmax(a, temperature), log_softmax(b, temperature), _kl_term)
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) * t * t


def kl_top_k(top: Column, student: Column, temperature: float | Column = 1.0) -> Column:
    """KL at the teacher's kept ids, times T squared.

    The teacher is renormalised over the kept ids, the student is not.
    """
    t = _num(temperature)

    def total(kept: Column, s: Column, zt: Column, zs: Column) -> Column:
        return F.aggregate(
            kept,
            F.lit(0.0),
            lambda acc, e: acc
            + _kl_term(
                _over(e["logit"], temperature) - zt,
                _over(F.element_at(s, e["token_id"].cast("int") + 1), temperature) - zs,
            ),
        )

    def with_norms(kept: Column, s: Column) -> Column:
        return let(
            log_sum_exp(F.transform(kept, lambda e: e["logit"]), temperature),
            lambda zt: let(log_sum_exp(s, temperature), lambda zs: total(kept, s, zt, zs)),
        )

    return let(top, lambda kept: let(doubles(student), lambda s: with_norms(kept, s))) * t * t


def _rows(lists: pa.Array) -> list[np.ndarray | None]:
    """The lists as views of one array of doubles; a NULL entry is NaN, a NULL list None."""
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    return [values[a:b] if ok else None for a, b, ok in zip(ends[:-1], ends[1:], lists.is_valid().to_pylist())]


def _best(row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest values, descending, the lower place first on ties; NaN is none."""
    reach = np.flatnonzero(~np.isnan(row))
    kept = min(k, len(reach))
    if kept < len(reach):
        cut = np.partition(row[reach], len(reach) - kept)[len(reach) - kept]
        reach = reach[row[reach] >= cut]
    return reach[np.lexsort((reach, -row[reach]))][:kept]


def _log_norm(x: np.ndarray) -> float:
    top = x.max()
    return top + np.log(np.exp(x - top).sum())


_LOSS_TYPE = StructType([StructField("ce", DoubleType()), StructField("kl", ArrayType(DoubleType()))])


def position_losses(
    student: Column, label: Column, temperatures: Sequence[float], teacher: Column | None = None,
    k: int | None = None, top: Column | None = None,
) -> Column:
    """struct<ce, kl array<double>>: both losses of a position, the KL at each temperature, in Arrow batches.

    The teacher comes as full scores, cut to its `k` best if given, or as stored `top`
    entries. One pass in double precision over the vocabulary for every width; the results
    are those of `cross_entropy`, `kl_full` and `kl_top_k`. A NaN or NULL score makes a loss
    NaN that needs it; a missing array makes it NULL, and so does a label that is NULL or outside of the scores.
    """

    def losses(ids: np.ndarray | None, logits: np.ndarray | None, scores: np.ndarray | None, target: int) -> dict:
        if scores is None:
            return {"ce": None, "kl": None}
        if target is None or not 0 <= target < len(scores):
            return {"ce": None, "kl": None}
        ce, kl = _log_norm(scores) - scores[target], None
        if logits is not None and len(logits):
            held, kl = scores if ids is None else scores[ids], []
            for t in temperatures:
                log_p = logits / t - _log_norm(logits / t)
                log_q = held / t - _log_norm(scores / t)
                terms = np.where(log_p <= -746.0, 0.0, np.exp(log_p) * (log_p - log_q))
                kl.append(float(terms.sum() * t * t))
        return {"ce": float(ce), "kl": kl}

    if top is None:
        inputs = [*align_vocab(doubles(teacher), doubles(student)), label.cast("int")]

        @F.arrow_udf(_LOSS_TYPE)
        def measure(teachers: pa.Array, students: pa.Array, labels: pa.Array) -> pa.Array:
            out = []
            with np.errstate(all="ignore"):
                for t, s, target in zip(_rows(teachers), _rows(students), labels.to_pylist()):
                    ids = None if k is None or t is None else _best(t, k)
                    out.append(losses(ids, t if ids is None else t[ids], s, target))
            return pa.array(out, _ARROW_LOSS)
    else:
        inputs = [F.transform(top, lambda e: e["token_id"].cast("double")), F.transform(top, lambda e: e["logit"].cast("double")),
                  doubles(student), label.cast("int")]

        @F.arrow_udf(_LOSS_TYPE)
        def measure(ids: pa.Array, logits: pa.Array, students: pa.Array, labels: pa.Array) -> pa.Array:
            out = []
            with np.errstate(all="ignore"):
                for i, t, s, target in zip(_rows(ids), _rows(logits), _rows(students), labels.to_pylist()):
                    if i is not None and s is not None:  # ids that the student does not have are left out
                        i, t = i[i < len(s)].astype(np.int64), t[i < len(s)]
                    out.append(losses(i, t, s, target))
            return pa.array(out, _ARROW_LOSS)

    return measure(*inputs)


_ARROW_LOSS = pa.struct([("ce", pa.float64()), ("kl", pa.list_(pa.float64()))])


def js_divergence(teacher: Column, student: Column, temperature: float | Column = 1.0) -> Column:
    """Mean KL of both sides to their mean over the shared vocabulary: symmetric, at most ln 2.

    In Arrow batches, one pass in double precision over the vocabulary. NULL for a missing array or
    temperature, 0 for empty ones, NaN where a score is NaN or NULL.
    """

    def halves(x: np.ndarray, y: np.ndarray, t: float) -> float:
        a, b = x / t - _log_norm(x / t), y / t - _log_norm(y / t)
        mean = np.logaddexp(a, b) - np.log(2.0)
        sides = (np.where(lp <= -746.0, 0.0, np.exp(lp) * (lp - mean)).sum() for lp in (a, b))
        return float(sum(sides) / 2)

    @F.arrow_udf("double")
    def measure(teachers: pa.Array, students: pa.Array, temperatures: pa.Array) -> pa.Array:
        out = []
        with np.errstate(all="ignore"):
            for x, y, t in zip(_rows(teachers), _rows(students), temperatures.to_pylist()):
                missing = x is None or y is None or t is None
                out.append(None if missing else halves(x, y, t) if len(x) else 0.0)
        return pa.array(out, pa.float64())

    return measure(*align_vocab(doubles(teacher), doubles(student)), _num(temperature))


def top_mass(scores: Column, ids: Column) -> Column:
    """Share of the probability that the zero-based `ids` hold; ids outside of the scores hold none.

    In Arrow batches. NULL for a missing array, NaN where a score is NaN or NULL.
    """

    @F.arrow_udf("double")
    def held(rows: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        with np.errstate(all="ignore"):
            for x, wanted in zip(_rows(rows), _rows(lists)):
                if x is None or wanted is None:
                    out.append(None)
                    continue
                inside = wanted[(wanted >= 0) & (wanted < len(x))].astype(np.int64)
                out.append(float(np.exp(x[inside] - _log_norm(x)).sum()) if len(x) else 0.0)
        return pa.array(out, pa.float64())

    return held(doubles(scores), doubles(ids))


def log_probability_at(scores: Column, ids: Column) -> Column:
    """Log-probabilities at zero-based `ids`, array<double>; NULL at ids outside of the scores.

    In Arrow batches: one pass over the vocabulary for its norm, and no array of its width is made.
    """

    @F.arrow_udf("array<double>")
    def gathered(rows: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        with np.errstate(all="ignore"):
            for x, wanted in zip(_rows(rows), _rows(lists)):
                if x is None or wanted is None:
                    out.append(None)
                    continue
                inside = (wanted >= 0) & (wanted < len(x))
                values = x[np.where(inside, wanted, 0).astype(np.int64)] - _log_norm(x) if inside.any() else wanted
                out.append(pa.array(values, mask=~inside).to_pylist())
        return pa.array(out, pa.list_(pa.float64()))

    return gathered(doubles(scores), doubles(ids))


def vector_mse(layers_a: Column, layers_b: Column) -> Column:
    """Mean squared difference over all layers (array<array<double>>) of one example."""
    a, b = doubles(F.flatten(layers_a)), doubles(F.flatten(layers_b))
    total = F.aggregate(
        F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v
    )
    return total / F.size(F.flatten(layers_a))


def pad_or_trim(x: Column, n: int | Column, fill: Column | float = 0.0) -> Column:
    """Exactly n entries: cut the tail or append `fill`.

    Entries may be numbers, arrays or structs, so stored scores can be fitted
    to the length of the labels too.
    """
    n = n if isinstance(n, Column) else F.lit(n)
    fill = fill if isinstance(fill, Column) else F.lit(fill)
    missing = F.greatest(n - F.size(x), F.lit(0))
    return F.slice(F.concat(x, F.array_repeat(fill, missing)), F.lit(1), n)


def truncate_context(feature: Column, n_frames: Column, full: int = 1500) -> Column:
    """First 2n columns of a bins-by-frames feature; all of it from `full` on."""
    cut = F.transform(feature, lambda row: F.slice(row, F.lit(1), n_frames * 2))
    return F.when(n_frames >= full, feature).otherwise(cut)


def shift_right(labels: Column, start_id: int) -> Column:
    """Decoder input: start id first, last label dropped, ignored labels become 0."""
    clean = F.transform(labels, lambda v: F.when(v == IGNORE, 0).otherwise(v))
    kept = F.slice(clean, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0)))
    return F.concat(F.array(F.lit(start_id)), kept)


def pad_mask(labels: Column, pad_id: int) -> Column:
    """Padding ids become the ignored label."""
    return F.transform(labels, lambda v: F.when(v == pad_id, IGNORE).otherwise(v))


def argmax_label(x: Column) -> Column:
    """Id of the best score, the lowest on ties; NaN and NULL are none, as in the top entries. NULL without a score."""
    best = F.array_max(F.filter(x, lambda v: ~F.isnan(v.cast("double"))))
    return F.nullif(F.array_position(x, best), F.lit(0).cast("long")) - 1
