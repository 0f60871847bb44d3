import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxframe.functions import text as T
from voxframe.operators import metrics


def table_distance(a, b):
    """The textbook table, as a check."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(*[st.lists(st.sampled_from("abcde"), max_size=40)] * 2)
def test_edit_distance(a, b):
    assert T.edit_distance(a, b) == table_distance(a, b)


def test_edit_distance_long():
    rng = random.Random(1)
    a = [str(rng.randrange(40)) for _ in range(700)]
    b = [w if rng.random() > 0.3 else str(rng.randrange(60)) for w in a if rng.random() > 0.2]
    assert T.edit_distance(a, b) == T.edit_distance(b, a) == table_distance(a, b)


def table_counts(a, b):
    """Substitutions, deletions, insertions by the whole table and the rule that `edit_counts` states."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    table = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (x != y))
    i, j, counts = len(a), len(b), [0, 0, 0]
    while i or j:
        best = table[i][j] - 1
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        elif i and j and table[i - 1][j - 1] == best:
            i, j, counts[0] = i - 1, j - 1, counts[0] + 1
        elif i and table[i - 1][j] == best:
            i, counts[1] = i - 1, counts[1] + 1
        else:
            j, counts[2] = j - 1, counts[2] + 1
    return tuple(counts)


@settings(max_examples=600, deadline=None)
@given(*[st.lists(st.sampled_from("abcde"), max_size=40)] * 2)
def test_edit_counts(a, b):
    assert T.edit_counts(a, b) == table_counts(a, b)
    assert sum(T.edit_counts(a, b)) == T.edit_distance(a, b)


def test_edit_counts_long():
    rng = random.Random(3)
    a = [str(rng.randrange(40)) for _ in range(700)]
    b = [w if rng.random() > 0.3 else str(rng.randrange(60)) for w in a if rng.random() > 0.2]
    assert T.edit_counts(a, b) == table_counts(a, b)
    b = b[::-1]
    assert T.edit_counts(a, b) == table_counts(a, b)
    long = [str(rng.randrange(3000)) for _ in range(20_000)]
    changed = ["x" if i % 50 == 7 else w for i, w in enumerate(long) if i % 90 != 11]
    s, d, i = T.edit_counts(long, changed)
    assert (s + d + i, d - i) == (T.edit_distance(long, changed), len(long) - len(changed))


def test_split_edits(spark):
    df = pairs(spark, ("the cat sat on the mat", "the dog sat mat now"), ("a b", None), (None, "a"), (" ", "a"), ("a", "a b c"), ("a b c", "c"))
    got = [(tuple(r.changes), r.ref_words) for r in metrics.split_edits(df).collect()]
    assert sorted(got) == sorted([(table_counts("the cat sat on the mat".split(), "the dog sat mat now".split()), 6), ((0, 2, 0), 2), ((0, 0, 2), 1), ((0, 2, 0), 3)])


def test_edit_distance_equals_builtin_levenshtein(spark):
    rng = random.Random(2)
    rows = [
        tuple("".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 90))) for _ in range(2)) for _ in range(200)
    ]
    spaced = lambda c: F.array_join(F.split(c, ""), " ")
    df = spark.createDataFrame(rows, ["a", "b"]).select(
        F.levenshtein("a", "b").alias("want"), spaced("a").alias("ref"), spaced("b").alias("hyp")
    )
    assert metrics.word_edits(df).where("want <> edits").count() == 0


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "ref string, hyp string")


def test_word_edits(spark):
    row = metrics.word_edits(pairs(spark, ("the cat  sat on the mat", "the dog sat mat now"))).first()
    assert (row.edits, row.ref_words) == (4, 6)
    null = metrics.word_edits(pairs(spark, ("a b", None), (None, "a"), (" \t", "a"), ("\n a b \n", " "))).collect()
    assert [(r.edits, r.ref_words) for r in null] == [(2, 2), (2, 2)]
    # one line break alone does not part two words
    row = metrics.word_edits(pairs(spark, ("a\nb c", "a b c"), ("a\n\nb c", "a b c"))).collect()
    assert [(r.edits, r.ref_words) for r in row] == [(2, 2), (0, 3)]


def test_wer_corpus(spark):
    wer = lambda *rows, **kw: metrics.wer_corpus(pairs(spark, *rows), **kw).first()
    assert wer(("a b c d", "a b c d"), ("a b", "x y z")).wer == 0.5
    assert wer(("a", "x y z")).wer == 3.0
    empty = wer((" ", "x"))
    assert (empty.wer, empty.samples) == (None, 0)
    assert wer((" ", "x"), empty_value=0.0).wer == 0.0
    assert wer(("a b", "a b")).wer == 0.0


def test_wer_at_n(spark):
    df = spark.createDataFrame(
        [("m", i, "a b", "a b" if i < 2 else "a x") for i in range(4)], "model string, pos long, ref string, hyp string"
    )
    got = {r.n: (r.samples, r.wer) for r in metrics.wer_at_n(df, [2, 3, 0, 99]).collect()}
    assert got == {2: (2, 0.0), 3: (3, pytest.approx(1 / 6)), 0: (4, 0.25), 99: (4, 0.25)}


def test_published_sweep_and_reduction(spark):
    sweep = [(0.5, 1.0, 0.820), (0.5, 2.0, 0.889), (0.7, 1.0, 0.801), (0.7, 2.0, 0.904), (0.9, 1.0, 0.808),
             (0.9, 2.0, 0.852), (0.95, 1.0, None)]
    df = spark.createDataFrame(sweep, "alpha double, temperature double, wer double")
    ranked = metrics.rank_runs(df, ["alpha", "temperature"]).orderBy("rank").collect()
    assert [r.wer for r in ranked] == [0.801, 0.808, 0.820, 0.852, 0.889, 0.904, None]
    assert [r.is_best for r in ranked] == [True] + [False] * 6
    before = spark.createDataFrame([("small", 1.004), ("gone", 0.5)], ["model", "wer"])
    after = spark.createDataFrame([("small", 0.581)], ["model", "wer"])
    row = metrics.vs_baseline(after, before).collect()
    assert len(row) == 1 and row[0].relative_reduction == pytest.approx((1.004 - 0.581) / 1.004)


def test_no_run_is_best_when_all_failed(spark):
    df = spark.createDataFrame([(0.5, None)], "alpha double, wer double")
    assert not metrics.rank_runs(df, ["alpha"]).first().is_best


def test_white_space(spark):
    blanks = ["", " ", "\t\n", " ", " 　", "\x1c\x85"]
    df = spark.createDataFrame([(s,) for s in [*blanks, None, " x ", "​"]], "s string")
    assert [r[0] for r in df.select(T.has_text(F.col("s"))).collect()] == [bool(s.strip()) for s in blanks] + [False, True, True]
    split = df.where("s = ' x '").select(T.tokens(F.lit(" a b \x1cc\n"))).first()[0]
    assert split == " a b \x1cc\n".split() == ["a", "b", "c"]


def test_names(spark):
    names = ["checkpoint-250", "checkpoint-1000", "checkpoint-x", "checkpoint-9-old", "my-checkpoint-3", "step-7"]
    df = spark.createDataFrame([(n,) for n in names], ["n"])
    assert [r[0] for r in df.select(T.step_number(F.col("n"))).collect()] == [250, 1000, None, None, None, None]
    assert df.select(T.step_number(F.col("n"), "step")).collect()[-1][0] == 7
    paths = spark.createDataFrame([("out/run/final", True), ("/a/b/", True), ("org/model-x/y", False), ("solo", True)], ["p", "l"])
    assert [r[0] for r in paths.select(T.run_label(F.col("p"), F.col("l"))).collect()] == ["run/final", "a/b", "org/model-x/y", "solo"]


class CountedWord(str):
    read = 0

    def __hash__(self):
        CountedWord.read += 1
        return str.__hash__(self)


def test_edit_counts_fill_the_table_once(monkeypatch):
    """The way back reads what the forward pass has kept; a table too large to keep gives the same counts."""
    ref = [f"w{i % 90}" for i in range(400)]
    hyp = [CountedWord("new" if i % 5 == 0 else w) for i, w in enumerate(ref) if i % 7]
    CountedWord.read = 0
    counts = T.edit_counts(ref, hyp)
    assert CountedWord.read <= len(hyp) and sum(counts) == T.edit_distance(ref, hyp)
    monkeypatch.setattr(T, "TABLE_BITS", 0)
    assert T.edit_counts(ref, hyp) == counts
