"""Audit of how far the sources of a language diverge, by count-level bitmaps.

The kept terms of a language stand in words of 64 bits, terms of similar frequency
together. Each group (language, source) has one bitmap for each word and count: the
terms that occur so often there. AND and popcount of two groups' bitmaps count the
terms in a joint cell (count here, count there); the divergence of two probabilities
depends on the cell alone. Cells with a count of zero follow by complement: all terms
of a level less those in its joint cells.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.common import chunks, cut
from voxframe.session import whole_div

# Letters A to Z in either case and everything beyond ASCII
TERM = rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 10
TOP = 10
UNIT = 1_000_000_000
WORD_BITS = 64
PIECES = 16
FLUSH = 400_000


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of a group.

    One row with a NULL term for every group. NULL text, lang and source count as ''.
    Terms are added up in each task, in at most FLUSH entries and those of a text, before they are shuffled.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TERM).findall
        seen, held = {}, 0

        def rows() -> pa.RecordBatch:
            lists = [[], [], [], [], []]
            for (lang, source), (n, in_docs) in seen.items():
                size = len(n) + 1
                lists[0] += [lang] * size
                lists[1] += [source] * size
                lists[2] += [None, *n]
                lists[3] += [0, *n.values()]
                lists[4] += [0, *(in_docs[t] for t in n)]
            types = [pa.binary()] * 3 + [pa.int64()] * 2
            arrays = [pa.array(v, type=t) for v, t in zip(lists, types)]
            return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            langs, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for at, texts in chunks(batch.column(0)):
                for i, body in enumerate(texts, at):
                    n, in_docs = seen.setdefault((langs[i], sources[i]), (Counter(), Counter()))
                    terms = Counter(find(body.lower()))
                    held -= len(n)
                    n.update(terms)
                    in_docs.update(terms.keys())
                    held += len(n)
                    if held > FLUSH:
                        yield rows()
                        seen, held = {}, 0
        if seen:
            yield rows()

    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")
    found = docs.select(plain(text).alias("t"), plain(lang).alias("l"), plain(source).alias("s")).mapInArrow(
        apply, "lang binary, source binary, term binary, n long, docs long"
    )
    names = [F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")]
    return found.groupBy(*names).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vocabulary(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, word, bit): the terms in at least `min_docs` documents of a language, with a bit of their own.

    Words hold terms whose totals agree in length and in their first four bits, so they have few levels
    in a group. No window spans more than one such class of totals, in PIECES pieces.
    """
    kept = (
        counts.where("term IS NOT NULL").groupBy("lang", "term")
        .agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    )
    bits = F.bin("total")
    level = F.length(bits).cast("long") * 16 + F.conv(F.substring(bits, 1, 4), 2, 10).cast("long")
    piece = F.pmod(F.xxhash64("term"), F.lit(PIECES))
    number = F.row_number().over(Window.partitionBy("lang", "level", "piece").orderBy("term")) - 1
    placed = kept.withColumns({"level": level, "piece": piece}).withColumn("number", number)
    word = (F.col("level") * PIECES + F.col("piece")) * (1 << 32) + whole_div(F.col("number"), WORD_BITS)
    return placed.select("lang", "term", "total", word.alias("word"), (F.col("number") % WORD_BITS).alias("bit"))


def probability(count: Column, all_counts: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (all + 2 * terms)) in whole numbers; 1 without terms.

    The product is a decimal, as it may exceed a long.
    """
    share = (count + 2).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.when(terms > 0, whole_div(share, all_counts + 2 * terms) + 1).otherwise(F.lit(1).cast("long"))


def divergence(p: Column, q: Column) -> Column:
    return whole_div((p - q) * (p - q), p + q)


def _groups(counts: DataFrame, kept: DataFrame, vocab: DataFrame) -> DataFrame:
    """(lang, source, here, terms, all, zero) of every group: its own sum, the language's terms and sum, p of a count of zero."""
    here = kept.groupBy("lang", "source").agg(F.sum("n").alias("here"))
    there = vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("all"))
    groups = counts.where("term IS NULL").select("lang", "source")
    filled = groups.join(here, ["lang", "source"], "left").join(there, "lang", "left").na.fill(0, ["here", "terms", "all"])
    return filled.withColumn("zero", probability(F.lit(0).cast("long"), F.col("here"), F.col("terms")))


def _pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of groups of a language.

    value = f over the joint cells + f over (level, zero) and (zero, level) by complement + f of (zero, zero).
    With f0 = f(zero, zero), every term starts at f0; a term of a level adds f(level, zero) - f0 for its
    group alone; one in a joint cell adds what then still lacks to f(level, level).
    """
    one = F.lit(1).cast("long")
    bitmaps = cut(
        kept.groupBy("lang", "word", "source", "p", "zero")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    )
    named = lambda n: bitmaps.select(
        "lang", "word", *[F.col(c).alias(f"{c}{n}") for c in ("source", "p", "zero", "bits")]
    )
    f = divergence
    p1, p2, z1, z2 = (F.col(c) for c in ("p1", "p2", "zero1", "zero2"))
    both = F.col("bits1").bitwiseAND(F.col("bits2"))
    lacks = f(p1, p2) - f(p1, z2) - f(z1, p2) + f(z1, z2)
    cells = named(1).join(named(2), ["lang", "word"]).where((F.col("source1") < F.col("source2")) & (both != 0))
    joint = cells.groupBy("lang", "source1", "source2").agg(F.sum(F.bit_count(both) * lacks).alias("value"))
    others = groups.select("lang", F.col("source").alias("source2"), F.col("zero").alias("zero2"))
    levels = bitmaps.groupBy("lang", F.col("source").alias("source1"), F.col("p").alias("p1"), F.col("zero").alias("zero1")).agg(
        F.sum(F.bit_count("bits")).alias("size")
    )
    alone = (
        cut(levels).join(others, "lang").where("source1 <> source2").groupBy("lang", "source1", "source2")
        .agg(F.sum(F.col("size") * (f(p1, z2) - f(z1, z2))).alias("value"))
    )
    start = groups.select("lang", F.col("source").alias("source1"), F.col("zero").alias("zero1"), "terms")
    start = start.join(others, "lang").where("source1 < source2").select(
        "lang", "source1", "source2", (F.col("terms") * f(z1, z2) * one).alias("value")
    )
    parts = start.unionByName(joint).unionByName(alone)
    mirrored = F.explode(F.array(
        F.struct(F.col("source1").alias("source"), F.col("source2").alias("item")),
        F.struct(F.col("source2").alias("source"), F.col("source1").alias("item")),
    ))
    return (
        parts.select("lang", mirrored.alias("s"), "value").groupBy("lang", "s.source", "s.item")
        .agg(F.sum("value").alias("value"))
    )


def audit(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence of each group from the others, and its most typical terms.

    Part `pair`: every other source of the language. Part `term`: the `top` terms that are likelier in the
    group than in the language. Ranks by value, largest first, then by item in UTF-8 order. A language
    without kept terms has pairs of value 0 and no terms; an empty table gives no rows; repeated rows count
    each time. The text is read once; what grows with pairs of sources is the result itself.
    """
    counts = cut(term_counts(docs, text, lang, source))
    vocab = cut(vocabulary(counts, min_docs))
    found = cut(counts.where("term IS NOT NULL").drop("docs").join(vocab, ["lang", "term"]))
    groups = cut(_groups(counts, found, vocab))
    p = probability(F.col("n"), F.col("here"), F.col("terms"))
    q = probability(F.col("total"), F.col("all"), F.col("terms"))
    kept = found.join(groups, ["lang", "source"]).withColumns({"p": p, "q": q})
    ranks = lambda df: df.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    )
    shown = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    pairs = ranks(_pair_values(kept, groups))
    terms = kept.where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    return shown(pairs, "pair").unionByName(shown(ranks(terms).where(F.col("rank") <= top), "term"))
