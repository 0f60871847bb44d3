"""Teacher scores, their join to the examples, and the losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions import arrays as A
from voxframe.operators.grid import sweep_grid

POSITION = ["example_pos", "tok_pos"]


def top_k_per_position(df: DataFrame, k: int, scores: str = "teacher") -> DataFrame:
    """Replace the score array of each position by its k best entries, in one way for every width."""
    return df.withColumn("top", A.top_k_wide(F.col(scores), k)).drop(scores)


def top_k_long(df: DataFrame, k: int, score: str = "logit") -> DataFrame:
    """Same from rows (example_pos, tok_pos, token_id, logit).

    `rank <= k` on a row number lets Spark keep k rows per position in every
    task before the shuffle.
    """
    best = Window.partitionBy(*POSITION).orderBy(F.col(score).desc(), "token_id")
    return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def explode_top(df: DataFrame, top: str = "top") -> DataFrame:
    """Array form to rows (example_pos, tok_pos, rank, token_id, logit)."""
    return df.select(*POSITION, F.posexplode(top).alias("r", "e")).select(
        *POSITION,
        (F.col("r") + 1).alias("rank"),
        F.col("e.token_id").alias("token_id"),
        F.col("e.logit").alias("logit"),
    )


def gather_top(top: DataFrame, student: DataFrame) -> DataFrame:
    """Student log-probabilities at the teacher's ids, both in row form.

    Give the student's rows from `kept_log_probabilities`, which holds only the kept ids.
    """
    return top.join(student, [*POSITION, "token_id"])


def kept_log_probabilities(top: DataFrame, student: DataFrame, scores: str = "student", name: str = "log_q") -> DataFrame:
    """(position, token_id, log_q): the student's rows at the ids of `top` (row form), from its score arrays.

    The ids of a position meet its array as one list, so what is exploded is k rows a position and not the
    vocabulary. Ids that the student does not have give no row.
    """
    kept = top.groupBy(*POSITION).agg(F.collect_list("token_id").alias("__ids"))
    both = student.select(*POSITION, scores).join(kept, POSITION)
    zipped = F.arrays_zip(F.col("__ids").alias("token_id"), A.log_probability_at(F.col(scores), F.col("__ids")).alias(name))
    return both.select(*POSITION, F.inline(zipped).alias("token_id", name)).where(F.col(name).isNotNull())


def pack_positions(df: DataFrame) -> DataFrame:
    """One row per example: (example_pos, positions), ordered by token position.

    At most as many positions as an example has labels. Joining packed scores
    keeps wide example columns (samples, features) from being copied to every
    token position.
    """
    rest = [c for c in df.columns if c not in POSITION]
    packed = F.array_sort(F.collect_list(F.struct("tok_pos", *rest)))
    return df.groupBy("example_pos").agg(packed.alias("positions"))


def align_scores(examples: DataFrame, scores: DataFrame, pos: str = "example_pos") -> DataFrame:
    """Pair valid examples with their stored scores by stream position.

    Filter the examples first: a row that was never scored has no partner.
    A plain equi join; the optimiser may merge, hash or broadcast it. Give
    scores from `pack_positions` when the examples carry wide columns.
    """
    return examples.join(scores, pos)


def masked_mean(value: Column, mask: Column) -> Column:
    """Sum over unmasked positions by their count; NULL without any."""
    return F.try_divide(F.sum(F.when(mask, value)), F.count_if(mask))


def mean_or_nan(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(float("nan")))


def vocab_aligned(df: DataFrame, teacher: str = "teacher", student: str = "student") -> DataFrame:
    a, b = A.align_vocab(F.col(teacher), F.col(student))
    return df.withColumns({teacher: a, student: b})


def loss_terms(
    df: DataFrame, k: int | None, temperatures: Sequence[float], label: str = "label_id"
) -> DataFrame:
    """One row per temperature: mean cross-entropy and mean KL over scored positions.

    `k` picks the top-K form, None the full vocabulary. All temperatures are
    computed in one pass over the scores of a position, and only partial sums
    are shuffled. A position whose label is outside of the student's scores has no loss and is not counted.
    """
    losses = A.position_losses(F.col("student"), F.col(label), temperatures, F.col("teacher"), k)
    return _means(df.where(A.is_scored(F.col(label))).select(losses.alias("l")).select("l.*"), temperatures)


def stored_loss_terms(
    df: DataFrame,
    temperatures: Sequence[float],
    label: str = "label_id",
    top: str = "top",
    student: str = "student",
) -> DataFrame:
    """The same from stored top scores joined to the student's full scores.

    Stored ids outside the student's vocabulary are left out.
    """
    losses = A.position_losses(F.col(student), F.col(label), temperatures, top=F.col(top))
    return _means(df.where(A.is_scored(F.col(label))).select(losses.alias("l")).select("l.*"), temperatures)


def _means(per_position: DataFrame, temperatures: Sequence[float]) -> DataFrame:
    sums = per_position.agg(
        F.count("ce").alias("positions"),
        F.sum("ce").alias("ce"),
        *[F.sum(F.col("kl")[i]).alias(f"kl_{i}") for i in range(len(temperatures))],
    )
    cells = F.array(
        *[
            F.struct(F.lit(float(t)).alias("temperature"), F.col(f"kl_{i}").alias("kl"))
            for i, t in enumerate(temperatures)
        ]
    )
    return sums.select("positions", "ce", F.explode(cells).alias("c")).select(
        "c.temperature",
        "positions",
        F.try_divide("ce", "positions").alias("ce"),
        F.try_divide("c.kl", "positions").alias("kl"),
    )


def combined_loss(terms: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """alpha * CE + (1 - alpha) * KL for every alpha."""
    loss = F.col("alpha") * F.col("ce") + (1 - F.col("alpha")) * F.col("kl")
    return sweep_grid(terms, alpha=alphas).withColumn("loss", loss)


def storage_per_row(
    df: DataFrame,
    k: int,
    vocab: int,
    labels: Column,
    example: str = "example_pos",
    id_bytes: int = 2,
    score_bytes: int = 2,
    full_bytes: int = 4,
) -> DataFrame:
    """Bytes per example for kept scores and for the whole vocabulary.

    One row of `df` is one token position. Positions are summed per example
    before anything is counted, so the shuffle carries one row per example.
    """
    per_example = df.groupBy(example).agg(F.sum(labels).alias("positions"))
    return per_example.agg(
        F.count(F.lit(1)).alias("examples"),
        F.sum("positions").alias("positions"),
        (F.sum("positions") * (k * (id_bytes + score_bytes) + 4) / F.count(F.lit(1))).alias(
            "top_bytes_per_row"
        ),
        (F.sum("positions") * (vocab * full_bytes) / F.count(F.lit(1))).alias("full_bytes_per_row"),
    )


def top_k_mass(df: DataFrame, k: int, teacher: str = "teacher", student: str = "student") -> DataFrame:
    """Teacher mass that the top k ids keep, and student mass outside of them, per position."""
    both = vocab_aligned(df, teacher, student).withColumn("__ids", F.transform(A.top_k(F.col(teacher), k), lambda e: e["token_id"]))
    return both.withColumns({
        "kept": A.top_mass(F.col(teacher), F.col("__ids")), "outside": 1 - A.top_mass(F.col(student), F.col("__ids")),
    }).drop("__ids", teacher, student)


def loss_balance(losses: DataFrame) -> DataFrame:
    """KL against cross-entropy, and the KL's share of the combined loss; NULL where the divisor is 0."""
    return losses.withColumns({
        "kl_to_ce": F.try_divide("kl", "ce"), "kl_share": F.try_divide((1 - F.col("alpha")) * F.col("kl"), F.col("loss")),
    })
